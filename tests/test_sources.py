from __future__ import annotations

import pytest

from builders import customer, order
from stallkeeper.sources import ingest


def test_csv_with_byte_order_mark_and_leading_zeros(spark, tmp_path):
    f = tmp_path / "customers.csv"
    f.write_text("﻿customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
                 '"c1","u1","01037","sao paulo","SP"\n', encoding="utf-8")
    assert tuple(ingest.ingest_typed_csv(spark, str(f), "customers").head()) == ("c1", "u1", "01037", "sao paulo", "SP")


def test_reordered_columns_are_rejected(spark, tmp_path):
    f = tmp_path / "sellers.csv"
    f.write_text("seller_zip_code_prefix,seller_id,seller_city,seller_state\n01000,s1,x,SP\n")
    with pytest.raises(ValueError, match="order differs"):
        ingest.ingest_typed_csv(spark, str(f), "sellers")


def test_malformed_number_fails_the_read(spark, tmp_path):
    f = tmp_path / "order_payments.csv"
    f.write_text("order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,1,card,one,3.50\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest.ingest_typed_csv(spark, str(f), "order_payments").collect()


def test_review_text_may_span_lines(spark, tmp_path):
    f = tmp_path / "order_reviews.csv"
    f.write_text("review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
                 'r1,o1,5,,"two\nlines, ""quoted""",2018-01-01 00:00:00,2018-01-02 03:04:05\n')
    r = ingest.ingest_typed_csv(spark, str(f), "order_reviews").head()
    assert r["review_comment_message"] == 'two\nlines, "quoted"' and r["review_score"] == 5


def test_contracts_count_violations(commerce):
    m = commerce(customers=[customer("c1"), customer("c1"), customer(None, "u")], orders=[order("o1"), order("o2", "ghost")])
    pk = {r["table_name"]: r for r in ingest.pk_contract(m.tables()).collect()}
    assert (pk["customers"]["row_count"], pk["customers"]["null_keys"], pk["customers"]["repeated_keys"]) == (3, 1, 1)
    fk = {r["relation"]: r["orphan_rows"] for r in ingest.fk_contract(m.tables()).collect()}
    assert fk["orders.customer_id->customers.customer_id"] == 1
    assert {r["status"] for r in ingest.schema_contract(m.tables()).collect()} == {"pass"}


def test_export_rounds_half_up(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.675)], "k string, v double")
    ingest.export_table(df, str(tmp_path / "x"), {"v": 2})
    assert spark.read.parquet(str(tmp_path / "x")).head()["v"] == 0.68


HEAD = "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"


def test_every_header_and_value_is_checked_whatever_is_selected(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.csv").write_text("﻿" + HEAD + "o1,1,card,2,3.50\n", encoding="utf-8")
    df = ingest.ingest_typed_csv(spark, str(good), "order_payments")
    assert df.count() == 1 and str(df.first()["payment_value"]) == "3.50" and df.schema == ingest.SCHEMAS["order_payments"]
    swapped = tmp_path / "swapped"
    swapped.mkdir()
    (swapped / "a.csv").write_text(HEAD + "o1,1,card,2,3.50\n")
    (swapped / "b.csv").write_text("order_id,payment_sequential,payment_type,payment_value,payment_installments\no2,1,card,7.00,2\n")
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.csv").write_text(HEAD + "o1,1,card,2,abc\n")
    for path in (swapped, bad):
        for use in (lambda d: d.select("order_id").collect(), lambda d: d.count(), lambda d: d.collect()):
            with pytest.raises(Exception):
                use(ingest.ingest_typed_csv(spark, str(path), "order_payments"))


def test_contracts_can_fail(spark, commerce):
    from pyspark.sql import functions as F
    tables = commerce(customers=[customer("c1")]).tables()
    tables["products"] = tables["products"].withColumn("product_weight_g", F.col("product_weight_g").cast("string"))
    tables["orders"] = tables["orders"].drop("order_status")
    rows = {r["table_name"]: r for r in ingest.schema_contract(tables).collect()}
    assert rows["products"]["type_differences"] == 1 and rows["products"]["status"] == "fail"
    assert rows["orders"]["missing_columns"] == 1 and rows["customers"]["status"] == "pass"
    raw = spark.createDataFrame([("1",), ("1.5",), ("inf",), ("x",)], "n string")
    got = ingest.numeric_contract({"t": raw}, {"t": {"n": "integer"}}).first()
    assert (got["non_finite"], got["fractional"]) == (1, 1)
    counts = ingest.row_count_contract({"t": raw}, {"t": raw}, {"t": 5}).first()
    assert counts["status"] == "fail"


def test_row_counts_are_held_to_the_scale_of_the_folder(spark, tmp_path):
    import shutil
    from stallkeeper.plans import registry
    assert registry.expected_rows("/data/sf0.01/")["orders"] == 15_000 and registry.expected_rows("/data/other") == {}
    source, short = "/root/testdata/sf0.001", tmp_path / "sf0.001"
    short.mkdir()
    for t in ("nation", "customer", "part", "orders", "lineitem"):
        shutil.copy(f"{source}/{t}.parquet", short)
    spark.read.parquet(f"{source}/supplier.parquet").limit(7).write.parquet(str(short / "supplier.parquet"))
    full = {r["table_name"]: r["status"] for r in registry.queries()["row_count_contract"](spark, source).collect()}
    cut = {r["table_name"]: r["status"] for r in registry.queries()["row_count_contract"](spark, str(short)).collect()}
    assert set(full.values()) == {"pass"} and len(full) == 9
    assert {t for t, s in cut.items() if s == "fail"} == {"sellers"}


def test_adapter_meets_the_schema_and_keeps_large_amounts(spark, tmp_path):
    from pyspark.sql import functions as F
    from stallkeeper.plans import registry
    source = "/root/testdata/sf0.001"
    assert {r["status"] for r in registry.queries()["schema_contract"](spark, source).collect()} == {"pass"}
    line = spark.read.parquet(f"{source}/lineitem.parquet").limit(1).withColumn("l_extendedprice", F.lit(1_500_000.0))
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    from stallkeeper.sources.model import from_star_schema
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        assert str(from_star_schema(spark, str(tmp_path)).items.first()["price"]) == "1500000.00"
    spark.conf.set("spark.sql.ansi.enabled", "true")


def test_no_shared_folder_is_an_error_off_local_mode(spark, monkeypatch):
    from types import SimpleNamespace
    from stallkeeper.functions import checkpoint_dir
    conf = SimpleNamespace(get=lambda *_: None)
    far = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=far, conf=conf))
    seen = []
    near = SimpleNamespace(getCheckpointDir=lambda: None, master="local[4]", setCheckpointDir=seen.append)
    assert checkpoint_dir(SimpleNamespace(sparkContext=near, conf=conf)) == seen[0]


def test_letters_in_other_forms_are_folded(spark):
    from pyspark.sql import functions as F
    from stallkeeper.operators.keywords import tokens
    row = spark.createDataFrame([("ﬁno ĳs ａbc ção ótimo Ⅷ de não",)], "t string").select(tokens(F.col("t")).alias("w")).first()
    assert [w for w in row["w"]] == ["fino", "ijs", "abc", "cao", "otimo", "viii"]
