"""Every query by name, bound to the parameters that suit the driver tables.

The operators default to the published thresholds; dates, bands and volumes differ
here because the driver tables span 1995-2001 and have other amounts.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallkeeper.functions import checkpoint_dir
from stallkeeper.operators import (association, category, checks, churn, cleaning, cohort, customers, forecast, freight,
                                   growth, highvalue, keywords, kpi, logistics, metrics, quality, regions, rfm, risk,
                                   scenario, sellers, structure)
from stallkeeper.plans.session import tune
from stallkeeper.sources import ingest
from stallkeeper.sources.model import UNTRANSLATED, Commerce, documents, from_star_schema


def _text_orders(m: Commerce) -> DataFrame:
    """Orders as raw text; every 101st purchase time is in a form that does not parse."""
    text = m.orders.select([F.col(c).cast("string").alias(c) for c in m.orders.columns])
    return text.withColumn("order_purchase_timestamp", F.when(
        F.col("order_id").cast("bigint") % 101 == 0, F.concat(F.lit("on "), "order_purchase_timestamp")).otherwise(
        F.col("order_purchase_timestamp"))).select(
        "order_id", "order_purchase_timestamp", *[c for c in quality.TIMES if c != "order_purchase_timestamp"])


ModelQuery = Callable[[Commerce], DataFrame]
SPLIT = ("NATION_1", "NATION_2", "NATION_3")
BOUNDS = (50_000, 100_000, 200_000, 500_000)
PERIODS = [("2000-01_to_2000-07", "2000-01", "2000-07"), ("2001-01_to_2001-07", "2001-01", "2001-07")]
BOUNDARY_MONTHS = ["1995-01", "2001-07"]
HOLIDAYS = [("Black Friday", 1997, "1997-11-28", "1997-11-28"), ("Black Friday", 1999, "1999-11-26", "1999-11-26"),
            ("Carnival", 1995, "1995-01-04", "1995-01-07"), ("Carnival", 1998, "1998-02-21", "1998-02-24"),
            ("Christmas", 2000, "2000-12-25", "2000-12-25"), ("Christmas", 2001, "2001-12-25", "2001-12-25")]
OBSERVED = "2001-07-31"
FORECAST_FROM = "2000-06-30"
TARGETS = [("Black Friday", 2000, "2000-11-24", "2000-11-24"), ("Carnival", 2001, "2001-02-24", "2001-02-27"),
           ("Christmas", 2000, "2000-12-24", "2000-12-25"), ("Christmas", 2001, "2001-12-24", "2001-12-25")]
TIER_BOUNDS = (500_000, 1_500_000)
LABEL_CUTOFF = "2001-04-30"
OBSERVED_END = "2001-07-31 23:59:59"
FIRST_DAY = "1995-01-01"
GROWTH_WINDOW = ("1995-01", "2001-07")
AOV_MONTHS = ("2001-01", "2001-07")
LAST_MONTH = "2001-07"
HIGH_AMOUNT = 500_000
HOLIDAY_MONTHS = ["1997-11", "1999-11", "2000-12"]
KPI_FILTER = kpi.Filters("1999-01-01", "2001-12-31", states=list(SPLIT), payments=["voucher"],
                         bands=["100000-200000", "200000-500000", "500000+"])
STRUCTURE_FILTER = kpi.Filters("1998-01-01", "2001-12-31", payments=["voucher", "boleto"],
                               bands=["50000-100000", "100000-200000", "200000-500000", "500000+"])

_MODEL: dict[str, ModelQuery] = {
    **{name: (lambda m, fn=getattr(ingest, name): fn(m.tables())) for name in (
        "table_row_counts", "pk_contract", "fk_contract", "translation_coverage",
        "zip_coverage", "join_cardinality_smoke")},
    **{name: getattr(quality, name) for name in (
        "dq_null_profile", "dq_exact_duplicates", "dq_key_duplicates", "dq_dup_review_detail", "dq_orphans",
        "dq_money_anomaly", "dq_time_null", "dq_chronology", "dq_null_keys", "dq_numeric_long",
        "dq_iqr_summary", "dq_iqr_extremes", "dq_classify", "dq_classify_summary", "dq_issue_register")},
    # KPI series and growth
    **{name: getattr(kpi, name) for name in ("monthly_kpi", "daily_kpi")},
    "kpi_filtered": lambda m: kpi.kpi_filtered(m, KPI_FILTER, BOUNDS),
    "kpi_monthly_trend": lambda m: kpi.kpi_monthly_trend(m, KPI_FILTER, BOUNDS),
    "holiday_windows": lambda m: kpi.holiday_windows(m, HOLIDAYS),
    "holiday_observed_change": lambda m: kpi.holiday_observed_change(m, HOLIDAYS),
    "holiday_month_compare": lambda m: kpi.holiday_month_compare(m, HOLIDAY_MONTHS, BOUNDARY_MONTHS),
    **{name: getattr(growth, name) for name in (
        "growth_mom_yoy", "growth_driver", "growth_extremes", "growth_anomaly_iqr", "month_gap_audit",
        "mom_outlier_trim", "growth_status", "growth_decomposition")},
    "growth_stability": lambda m: growth.growth_stability(m, min_orders=30),
    **{name: (lambda m, fn=getattr(growth, name): fn(m, BOUNDARY_MONTHS)) for name in (
        "trend_diagnostics", "peak_trough", "regime_segmentation")},
    # business structure
    "structure_order_base": lambda m: structure.structure_order_base_report(m, BOUNDS, PERIODS),
    **{name: getattr(structure, name) for name in ("order_payment_split", "primary_payment", "payment_tie_audit")},
    **{name: (lambda m, fn=getattr(structure, name): fn(m, periods=PERIODS)) for name in (
        "payment_structure", "state_structure", "state_concentration", "state_change", "state_segment_counts")},
    "order_value_structure": lambda m: structure.order_value_structure(m, BOUNDS, PERIODS),
    "structure_reconcile": lambda m: structure.structure_reconcile(m, BOUNDS, PERIODS),
    "payment_detail_base": lambda m: structure.payment_detail_report(m, BOUNDS),
    **{name: (lambda m, fn=getattr(structure, name): fn(m, STRUCTURE_FILTER, BOUNDS)) for name in (
        "payment_structure_filtered", "value_structure_filtered", "state_structure_filtered", "structural_signals")},
    # customers
    "customer_order_base": customers.customer_order_base_report,
    "customer_profile": customers.customer_profile_report,
    **{name: getattr(customers, name) for name in (
        "state_profile", "city_profile", "hourly_behavior", "weekday_behavior", "day_type_behavior",
        "growth_periods", "market_growth_base", "market_potential")},
    **{name: (lambda m, fn=getattr(customers, name): fn(m, OBSERVED)) for name in (
        "order_base_audit", "payment_source_reconcile", "installment_audit")},
    # cohorts and lifecycle
    "cohort_monthly": cohort.cohort_monthly,
    "cohort_matrix": cohort.cohort_matrix,
    "short_term_repeat": lambda m: cohort.short_term_repeat(m, OBSERVED_END),
    "observation_windows": lambda m: cohort.observation_windows(m, OBSERVED_END),
    "lifecycle_stage": lambda m: cohort.lifecycle_stage_report(m, OBSERVED),
    "lifecycle_comparison": lambda m: cohort.lifecycle_comparison(m, OBSERVED),
    "lifecycle_diff": lambda m: cohort.lifecycle_diff(m, OBSERVED),
    # value scoring
    "rfm_base": lambda m: rfm.rfm_base_report(m, OBSERVED),
    "rfm_detail": lambda m: rfm.rfm_detail_report(m, OBSERVED),
    **{name: (lambda m, fn=getattr(rfm, name): fn(m, OBSERVED)) for name in (
        "rfm_boundaries", "rfm_frequency_map", "rfm_score_distribution", "rfm_segment_summary")},
    # churn
    **{name: (lambda m, fn=getattr(churn, name): fn(m, OBSERVED)) for name in (
        "churn_comparison", "churn_user_detail", "churn_by_payment", "churn_by_state", "churn_by_city_top30",
        "churn_state_ranking", "churn_by_first_month")},
    **{name: (lambda m, fn=getattr(churn, name): fn(m, OBSERVED, FIRST_DAY)) for name in (
        "churn_by_day_type", "churn_association", "churn_feature_summary")},
    # high-value users
    "user_value_base": lambda m: highvalue.user_value_report(m, OBSERVED),
    "order_payment_base": lambda m: highvalue.order_payment_base_report(m, OBSERVED),
    "high_value_geography_city": lambda m: highvalue.high_value_geography(m, OBSERVED, by_city=True),
    **{name: (lambda m, fn=getattr(highvalue, name): fn(m, OBSERVED)) for name in (
        "rfm_churn_crosscheck", "high_value_users", "high_value_geography", "payment_behavior_groups",
        "payment_order_share_groups", "payment_gmv_share_groups", "order_experience_base", "experience_groups",
        "consumption_hours", "consumption_day_type", "lifecycle_cross", "payment_profile_user",
        "experience_profile_user")},
    "lifecycle_cross_detail": lambda m: highvalue.lifecycle_cross_report(m, OBSERVED),
    "consumption_value_bands": lambda m: highvalue.consumption_value_bands(m, OBSERVED, BOUNDS),
    **{name: (lambda m, fn=getattr(highvalue, name): fn(m, OBSERVED, HIGH_AMOUNT)) for name in (
        "consumption_groups", "consumption_profile_user", "integrated_profile")},
    # categories
    **{name: getattr(category, name) for name in (
        "category_item_base", "category_order_base", "category_sales", "category_monthly_sales", "category_pareto",
        "category_satisfaction", "keyword_candidates", "complaint_top12")},
    **{name: (lambda m, fn=getattr(category, name): fn(m, *GROWTH_WINDOW)) for name in (
        "category_mom", "category_cmgr", "category_class")},
    "category_heatmap_topn": lambda m: category.category_heatmap_topn(m, "2000-01", "2001-07"),
    "category_layer_audit": lambda m: category.category_layer_audit(m, BOUNDARY_MONTHS),
    "association_product": lambda m: association.association_product(m, min_count=2),
    "association_category": association.association_category,
    # scenarios
    **{name: (lambda m, fn=getattr(scenario, name): fn(m, OBSERVED)) for name in ("scenario_repeat", "scenario_recall")},
    **{name: getattr(scenario, name) for name in ("scenario_basket", "scenario_delivery", "scenario_payment_shift")},
    "scenario_aov": lambda m: scenario.scenario_aov(m, *AOV_MONTHS),
    "scenario_region": lambda m: scenario.scenario_region(m, list(SPLIT)),
    "scenario_non_top3": lambda m: scenario.scenario_non_top3(m, LAST_MONTH),
    "scenario_effects": lambda m: scenario.scenario_effects(m, OBSERVED, AOV_MONTHS, list(SPLIT), LAST_MONTH),
    # regional tiers
    **{name: getattr(regions, name) for name in ("region_tiers", "region_tier_summary")},
    # logistics
    **{name: (lambda m, fn=getattr(logistics, name): fn(m, OBSERVED)) for name in ("delivery_survival", "delivery_survival_by_state")},
    **{name: getattr(logistics, name) for name in ("logistics_correlation", "abnormal_orders", "abnormal_order_summary")},
    # freight and sellers
    **{name: getattr(freight, name) for name in ("freight_by_distance", "nearest_supply", "freight_by_size")},
    **{name: getattr(sellers, name) for name in ("seller_scorecard", "seller_grade_summary")},
    # holiday forecast and attribution
    "holiday_forecast": lambda m: forecast.holiday_forecast(m, HOLIDAYS, TARGETS, FORECAST_FROM),
    "holiday_forecast_model": lambda m: forecast.holiday_forecast_model(m, HOLIDAYS, FORECAST_FROM),
    "holiday_by_category": lambda m: forecast.holiday_by_category(m, HOLIDAYS),
    "holiday_by_user_tier": lambda m: forecast.holiday_by_user_tier(m, HOLIDAYS, TIER_BOUNDS),
    # churn warning
    **{name: (lambda m, fn=getattr(risk, name): fn(m, LABEL_CUTOFF)) for name in ("churn_risk_model", "churn_risk_quality")},
    "churn_risk_users": lambda m: risk.churn_risk_users(m, LABEL_CUTOFF, OBSERVED),
    # check registers
    "validate_rfm": lambda m: checks.validate_rfm(m, OBSERVED),
    "validate_dashboard_detail": lambda m: checks.validate_dashboard_detail(m, BOUNDS),
    **{name: getattr(checks, name) for name in ("validate_customer", "validate_metrics", "validate_stage1")},
    "dq_time_unparseable": lambda m: quality.dq_time_unparseable(_text_orders(m)),
    "clean_orders": cleaning.clean_orders,
    "clean_delivery": cleaning.clean_delivery,
    "clean_payments": cleaning.clean_payments,
    "clean_items": cleaning.clean_items,
    "dedup_geolocation": cleaning.dedup_geolocation,
    "clean_reviews": cleaning.clean_reviews,
    "representative_review": cleaning.representative_review,
    **{name: getattr(metrics, name) for name in (
        "m01_gmv", "m02_valid_orders", "m03_aov", "m04_paid_orders", "m05_active_customers",
        "m06_new_customers", "m07_repeat_customers", "m08_repeat_rate", "m09_retention", "m10_ltv",
        "m11_frequency", "m12_repurchase_interval", "m13_delivery_days", "m14_late_rate",
        "m15_review_score", "m16_positive_rate", "m17_cancel_rate", "m17_cancel_monthly",
        "m18_category_share", "metric_monthly_trends", "ltv_distribution", "frequency_distribution",
        "interval_distribution")},
    "metric_category_item_base": lambda m: metrics.metric_category_item_base(m).withColumn(
        "price", metrics.dbl("price")),
    "metric_order_base": metrics.metric_order_base_report,
    "metric_filtered": lambda m: metrics.metric_filtered(m, "1998-01-01", "1999-12-31", list(SPLIT)),
    "cohort_filtered": lambda m: metrics.cohort_filtered(m, "1995-06", "1995-12"),
    "category_share_filtered": lambda m: metrics.category_share_filtered(m, "1998-01-01", "1998-12-31"),
}


def _on_path(fn: ModelQuery) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(from_star_schema(tune(spark), sf_dir))
    return run


def _schema_contract(spark: SparkSession, path: str) -> DataFrame:
    tables = from_star_schema(tune(spark), path).tables()
    return ingest.schema_contract(tables).join(ingest.table_row_counts(tables), "table_name")


# The numbers of the files as they are, before the model casts them.
RAW_NUMBERS = {
    "lineitem": {"l_quantity": "integer", "l_linenumber": "integer", "l_extendedprice": "real", "l_discount": "real",
                 "l_tax": "real"},
    "part": {"p_size": "integer"},
}


def _numeric_contract(spark: SparkSession, path: str) -> DataFrame:
    return ingest.numeric_contract({t: tune(spark).read.parquet(f"{path}/{t}.parquet") for t in RAW_NUMBERS}, RAW_NUMBERS)


# Rows of the driver tables at scale 1; a folder named after its scale ("sf0.01") is held to its share of them.
ROWS_AT_ONE = {"customers": 150_000, "geolocation": 150_000, "products": 200_000, "sellers": 10_000, "orders": 1_500_000,
               "order_items": 6_000_000, "order_payments": 6_000_000, "order_reviews": 6_000_000}


def expected_rows(path: str) -> dict[str, int]:
    scale = re.fullmatch(r"sf(\d+(?:\.\d+)?)", path.rstrip("/").rsplit("/", 1)[-1])
    return {t: round(n * float(scale[1])) for t, n in ROWS_AT_ONE.items()} if scale else {}


def _row_count_contract(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the nine model tables, parsed from the files, against the rows of the files behind them and, where the
    folder names its scale, against the rows that scale has."""
    m = from_star_schema(tune(spark), path)
    raw = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    files = {"customers": "customer", "geolocation": "customer", "products": "part", "sellers": "supplier",
             "orders": "orders", "order_items": "lineitem", "order_payments": "lineitem", "order_reviews": "lineitem"}
    stored = {t: raw(f) for t, f in files.items()} | {"product_category_name_translation": raw("part").select(
        "p_brand").distinct().where(~F.col("p_brand").isin(*UNTRANSLATED))}
    return ingest.row_count_contract(m.tables(), stored, expected_rows(path))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/stallkeeper-{name}-{uuid.uuid4().hex}"


def _ingest_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Orders written as text and read back through the typed reader."""
    where = _scratch(tune(spark), "orders-csv")
    orders = from_star_schema(spark, path).orders
    orders.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(where)
    back = ingest.ingest_typed_csv(spark, where, "orders")
    return back.groupBy("order_status").agg(
        F.count("*").alias("order_count"), F.countDistinct("order_id").alias("distinct_orders"),
        F.min("order_purchase_timestamp").alias("first_purchase"), F.max("order_purchase_timestamp").alias("last_purchase"),
        F.count("order_approved_at").alias("approved"), F.count("order_delivered_carrier_date").alias("handed_over"),
        F.count("order_delivered_customer_date").alias("delivered"))


def _export_table(spark: SparkSession, path: str) -> DataFrame:
    """Monthly series exported with fixed decimals and read back."""
    where = _scratch(tune(spark), "monthly")
    ingest.export_table(kpi.monthly_kpi(from_star_schema(spark, path)), where, {"gmv": 2, "average_order_value": 6})
    return spark.read.parquet(where)


_TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "schema_contract": _schema_contract,
    "numeric_contract": _numeric_contract,
    "row_count_contract": _row_count_contract,
    "ingest_typed_csv": _ingest_typed_csv,
    "export_table": _export_table,
    "negative_keywords": lambda spark, path: keywords.negative_keywords(documents(tune(spark), path)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: _on_path(fn) for name, fn in _MODEL.items()}, **_TABLES}
