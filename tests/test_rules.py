"""Edge cases of the business rules on hand-made rows."""
from __future__ import annotations

import pytest
from builders import SELLER, customer, item, order, payment, review
from pyspark.sql import functions as F

from stallkeeper.operators import association, category, churn, cleaning, cohort, customers, kpi, metrics, rfm, structure
from stallkeeper.operators.keywords import negative_keywords, tokens


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_payments_are_not_multiplied_by_items(commerce):
    m = commerce(customers=[customer("c1")], orders=[order("o1")], sellers=SELLER,
                 payments=[payment("o1", 30, seq=1), payment("o1", 12.5, "voucher", 2)],
                 items=[item("o1", seq=i) for i in (1, 2, 3)])
    assert metrics.m01_gmv(m).head()["gmv"] == 42.5


def test_unpaid_delivered_order_counts_but_not_in_order_value(commerce):
    m = commerce(customers=[customer("c1")], orders=[order("o1"), order("o2")],
                 payments=[payment("o1", 40), payment("o2", 0)])
    assert metrics.m02_valid_orders(m).head()[0] == 2
    assert tuple(metrics.m03_aov(m).head()) == (1, 40.0, 40.0)
    assert rows(customers.customer_order_base_report(m), "order_id", "order_gmv", "is_paid_order") == [
        ("o1", 40.0, 1), ("o2", 0.0, 0)]


def test_mixed_payment_tie_goes_to_first_name(commerce):
    m = commerce(customers=[customer("c1")], orders=[order("o1")],
                 payments=[payment("o1", 50, "voucher", 1), payment("o1", 50, "credit_card", 2)])
    assert structure.primary_payment(m).head()["primary_payment_type"] == "credit_card"
    assert structure.payment_tie_audit(m).head()[0] == 1


def test_representative_review_tie_breaks(commerce):
    m = commerce(customers=[customer("c1")], orders=[order("o1"), order("o2")], reviews=[
        review("o1", 1, "a"), review("o1", 5, "b", made="2018-01-10 01:00:00"), review("o1", 0, "z", answered="2019-01-01 00:00:00"),
        review("o2", 2, "a"), review("o2", 4, "b")])
    assert rows(cleaning.representative_review(m), "order_id", "review_id", "review_score") == [("o1", "b", 5), ("o2", "b", 4)]


def test_latest_address_tie_takes_greatest_order_id(commerce):
    m = commerce(customers=[customer("c1", "u", "SP"), customer("c2", "u", "RJ")],
                 orders=[order("o1", "c1"), order("o2", "c2")], payments=[payment("o1", 1), payment("o2", 1)])
    p = customers.customer_profile(m).head()
    assert (p["customer_state"], p["valid_order_count"], p["is_repeat_customer"]) == ("RJ", 2, 1)


def test_delivery_rules(commerce):
    m = commerce(customers=[customer("c1")], orders=[
        order("early", order_delivered_customer_date="2017-12-31 00:00:00"),
        order("on_time", order_delivered_customer_date="2018-02-01 00:00:00"),
        order("late", order_delivered_customer_date="2018-02-01 00:00:01"),
        order("odd", order_approved_at="2018-01-05 00:00:00", order_delivered_carrier_date="2018-01-04 00:00:00",
              order_delivered_customer_date="2018-01-09 00:00:00"),
        order("orphan", "nobody")])
    assert rows(cleaning.clean_delivery(m), "order_id", "has_intermediate_chronology_error") == [
        ("late", 0), ("odd", 1), ("on_time", 0)]
    assert tuple(metrics.m14_late_rate(m).head())[:2] == (3, 1)
    flags = dict(rows(cleaning.clean_orders(m), "order_id", "has_chronology_error"))
    assert flags == {"early": 1, "on_time": 0, "late": 0, "odd": 1}


def test_zero_installments_are_kept_and_flagged(commerce):
    m = commerce(customers=[customer("c1")], orders=[order("o1")],
                 payments=[payment("o1", 5, installments=0), payment("o1", 0, seq=2), payment("gone", 5)])
    assert rows(cleaning.clean_payments(m), "payment_sequential", "needs_installment_review") == [(1, 1)]


def test_missing_month_blanks_both_neighbours(spark):
    from stallkeeper.operators.growth import _change
    series = spark.createDataFrame([("2018-01", 10.0), ("2018-02", 15.0), ("2018-04", 30.0), ("2018-05", 15.0)],
                                   "month string, gmv double")
    got = kpi.fill_months(series).select("month", _change("gmv", 1).alias("g")).collect()
    assert sorted(map(tuple, got)) == [("2018-01", None), ("2018-02", 0.5), ("2018-03", None), ("2018-04", None), ("2018-05", -0.5)]


def test_recency_and_lifecycle_boundaries(commerce):
    bought = {"a": ["2018-05-02"], "b": ["2018-05-01"], "n": ["2018-07-01"], "e": ["2018-06-30"],
              "g": ["2018-01-02", "2018-07-01"], "m": ["2018-01-01", "2018-07-01"], "late": ["2018-08-01"]}
    orders = [order(f"{u}{i}", u, f"{d} 12:00:00") for u, days in bought.items() for i, d in enumerate(days)]
    m = commerce(customers=[customer(u) for u in bought], orders=orders, payments=[payment(o["order_id"], 10) for o in orders])
    stages = dict(rows(cohort.lifecycle_stage(m, "2018-07-31"), "customer_unique_id", "lifecycle_stage"))
    assert stages == {"a": cohort.EARLY, "b": cohort.DORMANT, "n": cohort.NEW, "e": cohort.EARLY, "g": cohort.GROWING,
                      "m": cohort.MATURE}
    churned = dict(rows(churn.churn_user_detail(m, "2018-07-31"), "customer_unique_id", "churn_flag"))
    assert (churned["a"], churned["b"]) == (0, 1) and "late" not in churned


def test_repeat_window_is_counted_in_hours(commerce):
    second = {"same": "2018-01-01 10:00:00", "edge": "2018-01-08 10:00:00", "over": "2018-01-08 10:00:01"}
    orders = [order(f"{u}1", u) for u in second] + [order(f"{u}2", u, t) for u, t in second.items()]
    orders.append(order("young1", "young", "2018-07-30 10:00:00"))
    m = commerce(customers=[customer(u) for u in (*second, "young")], orders=orders,
                 payments=[payment(o["order_id"], 10) for o in orders])
    r = cohort.short_term_repeat(m, "2018-07-31 23:59:59").head()
    assert (r["total_users"], r["obs_7d"], r["excluded_7d"], r["repeat_7d"], r["repeat_30d"]) == (4, 3, 1, 1, 2)


@pytest.mark.parametrize("amount,band", [(0, "0-50"), (49.99, "0-50"), (50, "50-100"), (100, "100-200"), (200, "200-500"), (500, "500+")])
def test_value_band_edges(spark, amount, band):
    assert spark.range(1).select(structure.value_band(F.lit(amount)).alias("b")).head()["b"] == band


def _shop(commerce, sales: dict[str, list[float]], names=None, **more):
    """One order per sale; a product per category."""
    names = names if names is not None else {c: c for c in sales}
    orders, items, i = [], [], 0
    for c, prices in sales.items():
        for p in prices:
            i += 1
            orders.append(order(f"o{i:03d}"))
            items.append(item(f"o{i:03d}", f"p-{c}", p))
    return commerce(customers=[customer("c1")], orders=orders, items=items, sellers=SELLER,
                    products=[{"product_id": f"p-{c}", "product_category_name": names.get(c)} for c in sales],
                    translation=[{"product_category_name": c, "product_category_name_english": f"{c} " if c != "blank" else " "}
                                 for c in sales if c != "untranslated"], **more)


def test_pareto_crossing_category_is_head(commerce):
    m = _shop(commerce, {"a": [70], "b": [15], "c": [10], "d": [5]})
    assert rows(category.category_pareto(m), "category_name", "category_type") == [
        ("a", "head"), ("b", "head"), ("c", "long_tail"), ("d", "long_tail")]


def test_unknown_category_stays_in_the_total(commerce):
    m = _shop(commerce, {"a": [60], "untranslated": [10], "blank": [20], "none": [10]}, {"a": "a", "untranslated": "untranslated", "blank": "blank"})
    assert rows(category.category_sales(m), "category_name", "sales_amount", "sales_share") == [("a", 60.0, 0.6), ("unknown", 40.0, 0.4)]


def test_satisfaction_sample_limit(spark):
    data = [("small", 5, None)] * 29 + [("big", 1, " ")] * 15 + [("big", 1, "ruim")] * 15 + [("big", None, None)]
    got = category.satisfaction(spark.createDataFrame(data, "category_name string, review_score int, review_comment_message string"))
    assert rows(got, "category_name", "valid_review_orders", "negative_text_review_orders", "sample_status") == [
        ("big", 30, 15, "eligible"), ("small", 29, 0, "small_sample")]


def test_association_thresholds(spark):
    def check(both, total, a, b, lift=1.0):
        data = [(i, x) for i in range(both) for x in "ab"] + [(100 + i, "a") for i in range(a - both)] + [(500 + i, "b") for i in range(b - both)]
        df = spark.createDataFrame(data, "order_id int, item string")
        return rows(association.rules(df, F.lit(total), 5, 0.1, lift), "item_a", "item_b")
    assert check(4, 100, 10, 10) == []
    assert check(5, 100, 10, 10) == [("a", "b"), ("b", "a")]
    assert check(5, 1000, 50, 10) == [("a", "b"), ("b", "a")]  # confidence exactly 0.10 passes
    assert check(5, 1000, 51, 10) == [("b", "a")]
    assert check(10, 40, 20, 20) == []  # lift exactly 1


def test_accent_folding_and_stop_words(spark):
    df = spark.createDataFrame([("Não PÉSSIMO! o produto veio 2x quebrado, ç",)], "t string")
    assert df.select(tokens(F.col("t")).alias("w")).head()["w"] == ["pessimo", "produto", "veio", "quebrado"]
    assert df.select(tokens(F.lit("não péssimo")).alias("w")).head()["w"] == ["pessimo"]


def test_keywords_count_words_and_pairs(spark):
    data = [(i, "c", 1, "produto ruim") for i in range(30)] + [(99, "c", 5, "bom")]
    got = negative_keywords(spark.createDataFrame(data, "order_id int, category_name string, review_score int, review_comment_message string"))
    assert rows(got, "keyword_type", "keyword", "frequency") == [
        ("bigram", "produto ruim", 30), ("unigram", "produto", 30), ("unigram", "ruim", 30)]


def test_payment_filter_keeps_whole_orders(commerce):
    m = commerce(customers=[customer("c1")], orders=[order("o1"), order("o2")],
                 payments=[payment("o1", 30), payment("o1", 20, "voucher", 2), payment("o2", 70)])
    f = kpi.Filters("2018-01-01", "2018-12-31", payments=["voucher"])
    assert rows(structure.filter_detail(m, f), "order_id", "payment_type") == [("o1", "credit_card"), ("o1", "voucher")]
    assert tuple(kpi.kpi_filtered(m, f).head()) == (50.0, 1, 50.0, 1, 1)


def test_equal_frequency_gets_equal_score(commerce):
    counts = {"a": 1, "b": 1, "c": 2, "d": 3, "e": 4, "f": 5, "g": 6}
    orders = [order(f"{u}{i}", u) for u, n in counts.items() for i in range(n)]
    m = commerce(customers=[customer(u) for u in counts], orders=orders, payments=[payment(o["order_id"], 10) for o in orders])
    got = dict(rows(rfm.rfm_detail(m, "2018-07-31"), "customer_unique_id", "f_score"))
    assert got == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 3, "f": 4, "g": 5}


def test_gaps_of_a_user_with_many_orders(commerce):
    import random
    from datetime import datetime, timedelta
    rnd = random.Random(2)
    when = sorted(datetime(2017, 1, 1) + timedelta(seconds=rnd.randrange(40_000_000)) for _ in range(400))
    m = commerce(customers=[customer("c1")], orders=[order(f"o{i:04d}", bought=t.isoformat()) for i, t in enumerate(when)])
    want = sorted(int((b - a).total_seconds() * 1e6) for a, b in zip(when, when[1:]))
    assert sorted(r["gap_micros"] for r in metrics.purchase_gaps(metrics.delivered_users(m)).collect()) == want
    r = metrics.m12_repurchase_interval(m).head()
    assert r["valid_interval_count"] == 399
    assert r["average_repurchase_interval_days"] == pytest.approx(sum(want) / 399 / 86_400e6)


def test_churn_threshold_is_an_argument(commerce):
    m = commerce(customers=[customer("c1"), customer("c2", state="RJ")], orders=[
        order("o1", bought="2018-01-01 10:00:00"), order("o2", customer="c2", bought="2018-02-10 10:00:00")],
        payments=[payment("o1", 10), payment("o2", 10)])
    from stallkeeper.operators import highvalue
    flags = lambda n: {r["customer_unique_id"]: r["churn_flag"] for r in churn.churn_users(m, "2018-03-02", n).collect()}
    assert (flags(90), flags(59), flags(10)) == ({"c1": 0, "c2": 0}, {"c1": 1, "c2": 0}, {"c1": 1, "c2": 1})
    by_state = {r["customer_state"]: r["churned_users"] for r in churn.churn_by_state(m, "2018-03-02", threshold=30).collect()}
    assert by_state == {"SP": 1, "RJ": 0}
    months = {r["first_purchase_month"]: r["churned_users"] for r in churn.churn_by_first_month(m, "2018-03-02", 30).collect()}
    assert months == {"2018-01": 1, "2018-02": 0}
    assert highvalue.rfm_churn_crosscheck(m, "2018-03-02", 10).first()["recency_mismatches"] == 0


def test_metric_register_finds_repeated_payment_keys(commerce):
    from stallkeeper.operators import checks
    def register(*payments):
        arrived = {"order_delivered_customer_date": "2018-01-09 10:00:00"}
        m = commerce(customers=[customer("c1"), customer("c2")], sellers=SELLER, products=[{"product_id": "p1"}],
                     orders=[order("o1", **arrived), order("o2", customer="c2", bought="2018-02-03 10:00:00"),
                             order("o3", bought="2018-02-01 10:00:00", order_delivered_customer_date="2018-02-20 10:00:00")],
                     items=[item("o1"), item("o3")], payments=list(payments), reviews=[review("o1", 5)])
        return {r["check_name"]: r for r in checks.validate_metrics(m).collect()}
    good = register(payment("o1", 10), payment("o1", 5, seq=2), payment("o3", 7))
    assert len(good) == 48 and {r["status"] for r in good.values()} == {"PASS"}
    assert good["M12 gaps"]["actual_value"] == 1 and good["M12 days between purchases"]["actual_value"] == 31
    assert good["M09 cohort months"]["actual_value"] == 3 and good["M13 days"]["actual_value"] == 13.5
    bad = register(payment("o1", 10), payment("o1", 5), payment("o3", 7))
    assert [n for n, r in bad.items() if r["status"] != "PASS"] == ["payment keys are unique"]
