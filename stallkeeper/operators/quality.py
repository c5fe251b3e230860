"""Data-quality profiling: nulls, duplicates, orphans, time errors and numeric extremes."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from stallkeeper.functions import (half_up, MICROS_PER_DAY, count_if, dbl, fences, literal_rows, materialize,
                                   micros_between, with_values)
from stallkeeper.operators.cleaning import chronology_error
from stallkeeper.sources.model import Commerce

TIMES = ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
         "order_delivered_customer_date", "order_estimated_delivery_date")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def dq_null_profile(m: Commerce) -> DataFrame:
    """Missing values per table and column (empty text counts as missing): one scan per table."""
    out = []
    for name, df in m.tables().items():
        def missing(field: T.StructField):
            c = F.col(field.name)
            return c.isNull() | (c == "") if isinstance(field.dataType, T.StringType) else c.isNull()
        wide = df.agg(F.count("*").alias("total_records"),
                      *[count_if(missing(f)).alias(f.name) for f in df.schema.fields])
        pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("missing_count")) for c in df.columns])
        out.append(wide.select(F.lit(name).alias("table_name"), "total_records", F.explode(pairs).alias("p"))
                   .select("table_name", "p.variable", "total_records", "p.missing_count"))
    pct = half_up(F.try_divide(F.col("missing_count") * 100.0, dbl("total_records")), 2)
    return _union(out).withColumn("missing_pct", pct)


def dq_exact_duplicates(m: Commerce) -> DataFrame:
    """Rows occurring more than once, as text, for all nine tables."""
    out = []
    for name, df in m.tables().items():
        dup = df.groupBy(*df.columns).agg(F.count("*").alias("dup_count")).where("dup_count > 1")
        out.append(dup.select(F.lit(name).alias("table_name"),
                              F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in df.columns])
                              .alias("record"), "dup_count"))
    return _union(out)


def dq_key_duplicates(m: Commerce) -> DataFrame:
    """Repeated order, customer, item and payment keys."""
    checks = [("orders", m.orders_core, ["order_id"]), ("order_customers", m.orders_core, ["customer_id"]),
              ("order_items", m.items, ["order_id", "order_item_id"]),
              ("order_payments", m.payments, ["order_id", "payment_sequential"])]
    return _union([
        df.groupBy(*keys).agg(F.count("*").alias("repeat_cnt")).where("repeat_cnt > 1")
        .select(F.lit(name).alias("check_name"),
                F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("record_key"), "repeat_cnt")
        for name, df, keys in checks])


def dq_dup_review_detail(m: Commerce) -> DataFrame:
    """Text variants of review ids that occur more than once. Counting per variant first
    makes both the test for repetition and the join run on collapsed rows."""
    variants = m.reviews.groupBy("review_id", "review_comment_title", "review_comment_message").agg(
        F.count("*").alias("row_count"))
    repeated = variants.groupBy("review_id").agg(F.sum("row_count").alias("n")).where("n > 1").select("review_id")
    return variants.join(repeated, "review_id", "left_semi")


def dq_orphans(m: Commerce) -> DataFrame:
    """Rows of five relations whose parent is missing, by record key."""
    key = lambda *c: F.concat_ws(":", *[F.col(x).cast("string") for x in c])
    checks = [
        ("orders_without_customer", m.orders_core, m.customers, "customer_id", key("order_id")),
        ("items_without_order", m.items, m.orders_core, "order_id", key("order_id", "order_item_id")),
        ("items_without_product", m.items, m.products, "product_id", key("order_id", "order_item_id")),
        ("payments_without_order", m.payments, m.orders_core, "order_id", key("order_id", "payment_sequential")),
        ("reviews_without_order", m.reviews, m.orders_core, "order_id", key("review_id", "order_id")),
    ]
    return _union([child.join(parent.select(k), k, "left_anti")
                   .select(F.lit(name).alias("check_name"), record.alias("record_key"))
                   for name, child, parent, k, record in checks])


def dq_money_anomaly(m: Commerce) -> DataFrame:
    price, freight = F.col("price"), F.col("freight_value")
    kind = (F.when(price.isNull() | freight.isNull(), "null")
            .when((price < 0) | (freight < 0), "negative").when(price == 0, "zero"))
    return (m.items.withColumn("anomaly", kind).where(F.col("anomaly").isNotNull())
            .select("order_id", "order_item_id", dbl(price).alias("price"), dbl(freight).alias("freight_value"), "anomaly"))


def dq_time_null(m: Commerce) -> DataFrame:
    return m.orders.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in TIMES]))


def dq_time_unparseable(raw_orders: DataFrame) -> DataFrame:
    """Text timestamps that are present but do not parse. Takes the raw (text) orders."""
    bad = [F.col(c).isNotNull() & F.try_to_timestamp(F.col(c).cast("string")).isNull() for c in TIMES]
    return raw_orders.where(reduce(lambda a, b: a | b, bad))


def dq_chronology(m: Commerce) -> DataFrame:
    return m.orders.where(chronology_error())


def dq_null_keys(m: Commerce) -> DataFrame:
    checks = [("orders", m.orders_core, ["order_id", "customer_id"]),
              ("customers", m.customers, ["customer_id", "customer_unique_id"]),
              ("order_items", m.items, ["order_id", "product_id"])]
    return _union([df.where(F.col(a).isNull() | F.col(b).isNull())
                   .select(F.lit(name).alias("table_name"), F.col(a).cast("string").alias("first_key"),
                           F.col(b).cast("string").alias("second_key"))
                   for name, df, (a, b) in checks])


# ------------------------------------------------------------ numeric extremes

def _numeric_long(payments: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    def long(df: DataFrame, table: str, key, fields: dict) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(n).alias("field_name"), dbl(v).alias("actual_value")) for n, v in fields.items()])
        return (df.select(F.lit(table).alias("source_table"), key.alias("record_key"), F.explode(cells).alias("f"))
                .select("source_table", "f.field_name", "record_key", "f.actual_value")
                .where(F.col("actual_value").isNotNull()))
    key = lambda *c: F.concat_ws(":", *[F.col(x).cast("string") for x in c])
    days = micros_between("order_delivered_customer_date", "order_purchase_timestamp") / MICROS_PER_DAY
    return _union([
        long(payments, "order_payments", key("order_id", "payment_sequential"),
             {"payment_value": F.col("payment_value"), "payment_installments": F.col("payment_installments")}),
        long(items, "order_items", key("order_id", "order_item_id"),
             {"price": F.col("price"), "freight_value": F.col("freight_value")}),
        long(orders, "orders", key("order_id"), {"actual_delivery_days": days})])


def dq_numeric_long(m: Commerce) -> DataFrame:
    """Five numeric fields in long form, each value under the key of its one record. Fields of one table share its
    scan."""
    return _numeric_long(m.payment_records, m.item_records, m.orders)


def _numeric_values(m: Commerce) -> DataFrame:
    """The same values without their records, for readers that need no numbering."""
    return _numeric_long(m.payments, m.items, m.orders).select(*_FIELD, "actual_value")


_FIELD = ["source_table", "field_name"]


def _field_fences(values: DataFrame) -> DataFrame:
    """Five rows, one per field; stored, so that no later pass ranks again."""
    return materialize(fences(values, "actual_value", _FIELD).withColumnRenamed("value_count", "valid_count"))


def dq_iqr_summary(m: Commerce) -> DataFrame:
    """Quartiles, fences and the number of values outside them, per field."""
    values = _numeric_values(m)
    bounds = _field_fences(values)
    v = F.col("actual_value")
    keep = [c for c in bounds.columns if c not in _FIELD]
    return values.join(F.broadcast(bounds), _FIELD).groupBy(*_FIELD).agg(
        *[F.max(c).alias(c) for c in keep], count_if(v < F.col("lower_bound")).alias("lower_extreme_count"),
        count_if(v > F.col("upper_bound")).alias("upper_extreme_count"))


def _beside_fences(m: Commerce) -> DataFrame:
    """Every value with its record, its field's fences and the side on which it lies outside them, if any."""
    b = _field_fences(_numeric_values(m)).select(*_FIELD, "lower_bound", "upper_bound")
    v = F.col("actual_value")
    side = F.when(v < F.col("lower_bound"), "lower").when(v > F.col("upper_bound"), "upper")
    return dq_numeric_long(m).join(F.broadcast(b), _FIELD).withColumn("extreme_direction", side)  # five rows: one per field


def dq_iqr_extremes(m: Commerce) -> DataFrame:
    return _beside_fences(m).where(F.col("extreme_direction").isNotNull()).select(
        *_FIELD, "record_key", "actual_value", "lower_bound", "upper_bound", "extreme_direction")


def dq_classify(m: Commerce) -> DataFrame:
    """Extremes and rule violations as data_error, needs_review or true_extreme. Each record is judged by itself: one
    that breaks a payment rule counts whatever else bears its key."""
    extreme = F.col("extreme_direction").isNotNull()
    no_payment = (F.col("source_table") == "order_payments") & (F.col("actual_value") <= 0)
    found = materialize(_beside_fences(m).where(extreme | no_payment).select(
        *_FIELD, "record_key", "actual_value", extreme.alias("is_extreme")))  # read twice
    evidence = m.orders.select(
        F.col("order_id").cast("string").alias("record_key"), F.lit("orders").alias("source_table"),
        chronology_error().alias("wrong_order"),
        (F.col("order_approved_at").isNull() | F.col("order_delivered_carrier_date").isNull()).alias("step_missing"))
    on_field = lambda t, f: (F.col("source_table") == t) & (F.col("field_name") == f)
    judged = found.where("is_extreme").join(evidence, ["source_table", "record_key"], "left").select(
        *_FIELD, "record_key", "actual_value",
        F.when(F.col("actual_value") < 0, "data_error").when(F.col("wrong_order"), "data_error")
        .when(F.col("step_missing"), "needs_review")
        .when(on_field("order_items", "freight_value") & (F.col("actual_value") == 0), "needs_review")
        .otherwise("true_extreme").alias("classification"))
    extra = found.where("NOT is_extreme").select(
        *_FIELD, "record_key", "actual_value",
        F.when(F.col("field_name") == "payment_value", "data_error").otherwise("needs_review").alias("classification"))
    undated = m.orders.where((F.col("order_status") == "delivered")
                             & (F.col("order_purchase_timestamp").isNull()
                                | F.col("order_delivered_customer_date").isNull())).select(
        F.lit("orders").alias("source_table"), F.lit("actual_delivery_days").alias("field_name"),
        F.col("order_id").cast("string").alias("record_key"), F.lit(None).cast("double").alias("actual_value"),
        F.lit("data_error").alias("classification"))
    return _union([judged, extra, undated])


FIELDS = [("order_payments", "payment_value"), ("order_payments", "payment_installments"),
          ("order_items", "price"), ("order_items", "freight_value"), ("orders", "actual_delivery_days")]
CLASSES = ["data_error", "true_extreme", "needs_review"]


def dq_classify_summary(m: Commerce) -> DataFrame:
    """Every field with every class, zero counts included."""
    grid = with_values(literal_rows(m.spark, "source_table string, field_name string", FIELDS), "classification", CLASSES)
    counts = dq_classify(m).groupBy(*_FIELD, "classification").agg(F.count("*").alias("record_count"))
    c, f = F.col("classification"), F.col("field_name")
    reason = (F.when(c == "true_extreme", "outside a fence, nothing else wrong")
              .when((c == "needs_review") & (f == "freight_value"), "zero freight may be free shipping")
              .when((c == "needs_review") & (f == "payment_installments"), "zero installments cannot be corrected")
              .when((c == "needs_review") & (f == "actual_delivery_days"), "long delivery with a missing step")
              .when((c == "data_error") & (f == "payment_value"), "non-positive payment")
              .when((c == "data_error") & (f == "actual_delivery_days"), "delivery time missing or out of order")
              .otherwise("no record met this rule"))
    action = F.when(c == "data_error", "exclude").when(c == "true_extreme", "retain").otherwise("flag")
    return grid.join(counts, [*_FIELD, "classification"], "left").select(
        *_FIELD, "classification", F.coalesce("record_count", F.lit(0)).cast("bigint").alias("record_count"),
        reason.alias("reason"), action.alias("recommended_action"))


def dq_issue_register(m: Commerce) -> DataFrame:
    """One row per issue found, with how many records it touches and what is done about it."""
    m = m.held("orders")
    n = lambda df: df.agg(F.count("*").alias("record_count"))
    classes = dq_classify(m).groupBy(*_FIELD, "classification").agg(F.count("*").alias("record_count")).select(
        F.concat_ws(".", "source_table", "field_name", "classification").alias("issue"), "record_count",
        F.when(F.col("classification") == "data_error", "exclude")
        .when(F.col("classification") == "true_extreme", "retain").otherwise("flag").alias("handling"))
    missing = dq_null_profile(m).where("missing_count > 0").select(
        F.concat_ws(".", "table_name", "variable", F.lit("missing")).alias("issue"),
        F.col("missing_count").alias("record_count"), F.lit("retain and flag").alias("handling"))
    dup = dq_exact_duplicates(m).groupBy("table_name").agg(
        F.sum(F.col("dup_count") - 1).alias("record_count")).select(
        F.concat_ws(".", "table_name", F.lit("exact_duplicates")).alias("issue"), "record_count",
        F.lit("deduplicate").alias("handling"))
    order = n(dq_chronology(m)).select(F.lit("orders.chronology").alias("issue"), "record_count",
                                       F.lit("flag").alias("handling"))
    return _union([classes, missing, dup, order]).where("record_count > 0")
