"""Records of the quality profile: each is named and judged by itself."""
from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from builders import customer, order, payment
from pyspark.sql import functions as F

from stallkeeper.operators import quality
from stallkeeper.sources.model import from_star_schema

DAY = datetime(2000, 1, 5)


def star(spark, path: Path, lines):
    """One order of customer 1 with lines of (line number, part, quantity, price)."""
    pq.write_table(pa.table({"o_orderkey": [7], "o_custkey": [1], "o_orderstatus": ["F"], "o_orderdate": [datetime(2000, 1, 1)]}),
                   path / "orders.parquet")
    n = len(lines)
    pq.write_table(pa.table({
        "l_orderkey": [7] * n, "l_partkey": [x[1] for x in lines], "l_suppkey": [1] * n,
        "l_linenumber": pa.array([x[0] for x in lines], pa.int32()), "l_quantity": [float(x[2]) for x in lines],
        "l_extendedprice": [float(x[3]) for x in lines], "l_discount": [0.0] * n, "l_tax": [0.0] * n,
        "l_returnflag": ["A"] * n, "l_linestatus": ["O"] * n, "l_shipdate": [DAY] * n}), path / "lineitem.parquet")
    return from_star_schema(spark, str(path))


def test_lines_that_share_a_number_keep_keys_of_their_own(spark, tmp_path):
    m = star(spark, tmp_path, [(2, 9, 1, 30), (1, 5, 1, 20), (2, 3, 1, 40), (2, 9, 1, 30)])
    prices = quality.dq_numeric_long(m).where("field_name = 'price'")
    assert sorted((r["record_key"], r["actual_value"]) for r in prices.collect()) == [
        ("7:1", 20.0), ("7:2", 40.0), ("7:3", 30.0), ("7:4", 30.0)]
    paid = quality.dq_numeric_long(m).where("field_name = 'payment_value'")
    assert sorted((r["record_key"], r["actual_value"]) for r in paid.collect()) == [
        ("7:1", 20.0), ("7:2", 40.0), ("7:3", 30.0), ("7:4", 30.0)]


def test_extremes_are_told_apart(spark, tmp_path):
    m = star(spark, tmp_path, [(1, i, 1, 10 + i % 3) for i in range(20)] + [(1, 30, 1, 900), (1, 31, 1, 900)])
    keys = [r["record_key"] for r in quality.dq_iqr_extremes(m).where("field_name = 'price'").collect()]
    assert sorted(keys) == ["7:21", "7:22"]


def test_empty_payment_counts_beside_an_extreme_one(spark, tmp_path):
    lines = [(1, i, 1, 10 * i) for i in range(1, 21)] + [(2, 30, 1, 900), (2, 31, 50, 11)]  # 50 pieces: paid nothing
    found = quality.dq_classify(star(spark, tmp_path, lines)).where("field_name = 'payment_value'")
    assert sorted((r["record_key"], r["classification"]) for r in found.collect()) == [
        ("7:21", "true_extreme"), ("7:22", "data_error")]


def test_issue_register_counts_every_empty_payment(commerce):
    m = commerce(customers=[customer("c1")], orders=[order("o1")],
                 payments=[payment("o1", 10 * i, seq=i) for i in range(1, 21)] + [payment("o1", 900, seq=50), payment("o1", 0, seq=50)])
    issues = {r["issue"]: r["record_count"] for r in quality.dq_issue_register(m).collect()}
    assert issues["order_payments.payment_value.data_error"] == issues["order_payments.payment_value.true_extreme"] == 1


def test_replaced_tables_replace_their_records(commerce):
    m = commerce(payments=[payment("o1", 10)])
    doubled = m.with_tables(payments=m.payments.withColumn("payment_value", F.col("payment_value") * 2))
    assert doubled.payment_records.head()["payment_value"] == 20
