"""Typed ingest of the raw files and the contracts every table must meet.

A contract never collects rows: it returns a small DataFrame of violation counts.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallkeeper.functions import count_if, half_up, literal_rows

_S, _D, _I, _TS, _M = (T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampNTZType(),
                       T.DecimalType(18, 2))


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# Column names, order and types of the raw files. Zip codes stay text.
SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(("customer_id", _S), ("customer_unique_id", _S), ("customer_zip_code_prefix", _S),
                         ("customer_city", _S), ("customer_state", _S)),
    "geolocation": _schema(("geolocation_zip_code_prefix", _S), ("geolocation_lat", _D), ("geolocation_lng", _D),
                           ("geolocation_city", _S), ("geolocation_state", _S)),
    "products": _schema(("product_id", _S), ("product_category_name", _S), ("product_name_lenght", _I),
                        ("product_description_lenght", _I), ("product_photos_qty", _I), ("product_weight_g", _I),
                        ("product_length_cm", _I), ("product_height_cm", _I), ("product_width_cm", _I)),
    "sellers": _schema(("seller_id", _S), ("seller_zip_code_prefix", _S), ("seller_city", _S), ("seller_state", _S)),
    "product_category_name_translation": _schema(("product_category_name", _S),
                                                 ("product_category_name_english", _S)),
    "orders": _schema(("order_id", _S), ("customer_id", _S), ("order_status", _S), ("order_purchase_timestamp", _TS),
                      ("order_approved_at", _TS), ("order_delivered_carrier_date", _TS),
                      ("order_delivered_customer_date", _TS), ("order_estimated_delivery_date", _TS)),
    "order_items": _schema(("order_id", _S), ("order_item_id", _I), ("product_id", _S), ("seller_id", _S),
                           ("shipping_limit_date", _TS), ("price", _M), ("freight_value", _M)),
    "order_payments": _schema(("order_id", _S), ("payment_sequential", _I), ("payment_type", _S),
                              ("payment_installments", _I), ("payment_value", _M)),
    "order_reviews": _schema(("review_id", _S), ("order_id", _S), ("review_score", _I), ("review_comment_title", _S),
                             ("review_comment_message", _S), ("review_creation_date", _TS),
                             ("review_answer_timestamp", _TS)),
}
KEYS = {
    "customers": ["customer_id"], "products": ["product_id"], "sellers": ["seller_id"],
    "product_category_name_translation": ["product_category_name"], "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"], "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["review_id", "order_id"],
}
# child table, column, parent table, column
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def check_schema(found: list[str], expected: T.StructType) -> None:
    """Reject missing, extra or reordered columns."""
    want = expected.fieldNames()
    if found != want:
        missing = [c for c in want if c not in found]
        extra = [c for c in found if c not in want]
        raise ValueError(f"columns differ: missing={missing} extra={extra} "
                         f"{'order differs' if not missing and not extra else ''}".strip())


def _typed(name: str, kind: T.DataType):
    """The value of a text field in its declared type; NULL where the text is not of that type."""
    text = F.col(name)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.TimestampNTZType):
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast(kind)
    if isinstance(kind, T.IntegerType):
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(kind))
    return text.try_cast(kind)


def ingest_typed_csv(spark: SparkSession, path: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """Read comma-separated files with declared types; a wrong header in any file, a line of another width and a
    value that is not of its type all fail the read, whatever columns are asked for.

    Every field is read as text and named in one condition, so column pruning cannot pass over a header or a
    value. A file is split over tasks, except review texts: quoted line breaks need ``multiLine``."""
    schema = schema or SCHEMAS[table]
    text = T.StructType([T.StructField(n, T.StringType()) for n in schema.fieldNames()])
    check_schema(_first_header(spark, path), schema)
    rows = (spark.read.schema(text).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
            .option("encoding", "UTF-8").option("multiLine", table == "order_reviews").option("escape", '"').csv(path))
    bad = [F.col(f.name).isNotNull() & _typed(f.name, f.dataType).isNull() for f in schema.fields]
    told = F.concat(F.lit(f"malformed value in {table}: "), F.concat_ws(
        " | ", *[F.coalesce(F.col(n), F.lit("NULL")) for n in schema.fieldNames()]))
    fine = F.when(reduce(lambda a, b: a | b, bad), F.raise_error(told).cast("boolean")).otherwise(
        F.length(F.concat_ws("", *schema.fieldNames())) >= 0)
    return rows.where(fine).select(*[_typed(f.name, f.dataType).alias(f.name) for f in schema.fields])


def _first_header(spark: SparkSession, path: str) -> list[str]:
    """The header of one file, without a byte-order mark, for a clear message; the reader checks every file."""
    first = spark.read.text(path).limit(1).head()
    return [c.strip().strip('"') for c in (first[0] if first else "").lstrip("\ufeff").split(",")]


def export_table(df: DataFrame, path: str, decimals: dict[str, int] | None = None, fmt: str = "parquet") -> None:
    """Write a result; rounding is a projection, so every task writes its own part. Text files begin with a
    byte-order mark on their first header name, as spreadsheet programs expect."""
    out = df.select(*[half_up(c, decimals[c]).alias(c) if decimals and c in decimals else F.col(c) for c in df.columns])
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0]).write.mode("overwrite")
        writer.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        writer.format(fmt).save(path)


# ---------------------------------------------------------------- contracts

#: Keys may be text, as in the raw files, or the numbers of a source that has numbers.
IDENTIFIERS = {"customer_id", "customer_unique_id", "product_id", "seller_id", "order_id", "review_id"}


def _same_type(name: str, want: T.DataType, found: T.DataType) -> bool:
    if name in IDENTIFIERS and isinstance(found, T.IntegralType):
        return True
    if isinstance(want, T.IntegerType):
        return isinstance(found, T.IntegralType)
    return want == found


def schema_contract(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: are the declared columns all there, in order, of their types, with none to spare?"""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        schema = SCHEMAS[name]
        want, found = schema.fieldNames(), df.columns
        other = [c for c in want if c in found and not _same_type(c, schema[c].dataType, df.schema[c].dataType)]
        rows.append((name, len(want), len([c for c in want if c not in found]), len([c for c in found if c not in want]),
                     len(other), "pass" if found == want and not other else "fail"))
    return literal_rows(spark, "table_name string, expected_columns bigint, missing_columns bigint, "
                               "extra_columns bigint, type_differences bigint, status string", rows)


NUMERIC = {
    "geolocation": {"geolocation_lat": "real", "geolocation_lng": "real"},
    "order_items": {"price": "real", "freight_value": "real"},
    "order_payments": {"payment_installments": "integer", "payment_value": "real"},
    "order_reviews": {"review_score": "integer"},
    "products": {c: "integer" for c in ("product_name_lenght", "product_description_lenght", "product_photos_qty",
                                        "product_weight_g", "product_length_cm", "product_height_cm",
                                        "product_width_cm")},
}


def numeric_contract(tables: dict[str, DataFrame], numeric: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Non-finite values, and fractions in integer columns; one pass per table.

    Meant for raw columns (floating point or text), before a cast to decimals or integers hides either."""
    out = []
    for name, columns in (numeric or NUMERIC).items():
        measures = []
        for c, kind in columns.items():
            v = F.col(c).try_cast("double")
            infinite = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
            fraction = (~infinite & (v != F.floor(v))) if kind == "integer" else F.lit(False)
            measures.append(F.struct(F.lit(c).alias("column_name"), count_if(infinite).alias("non_finite"),
                                     count_if(fraction).alias("fractional")).alias(c))
        one = tables[name].agg(*measures)
        out.append(one.select(F.lit(name).alias("table_name"), F.explode(F.array(*columns)).alias("r"))
                   .select("table_name", "r.*"))
    return _union(out)


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([df.agg(F.count("*").alias("total_rows")).select(F.lit(n).alias("table_name"), "total_rows")
                   for n, df in tables.items()])


def row_count_contract(parsed: dict[str, DataFrame], stored: dict[str, DataFrame],
                       expected: dict[str, int] | None = None) -> DataFrame:
    """Parsed rows = stored rows (= the expected count where one is given)."""
    a = table_row_counts(parsed).withColumnRenamed("total_rows", "parsed_rows")
    b = table_row_counts(stored).withColumnRenamed("total_rows", "stored_rows")
    want = F.col("stored_rows")
    for name, n in (expected or {}).items():
        want = F.when(F.col("table_name") == name, F.lit(n).cast("bigint")).otherwise(want)
    return a.join(b, "table_name", "full").select(
        "table_name", "parsed_rows", "stored_rows",
        F.when((F.col("parsed_rows") == F.col("stored_rows")) & (F.col("parsed_rows") == want), "pass")
        .otherwise("fail").alias("status"))


def pk_contract(tables: dict[str, DataFrame]) -> DataFrame:
    """Null and repeated primary keys. Counting per key merges map-side, so a key with a
    third of the rows is one small record per task."""
    out = []
    for name, keys in KEYS.items():
        null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        per_key = tables[name].groupBy(*keys).agg(F.count("*").alias("n"))
        out.append(per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("*").alias("distinct_keys"),
            F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_keys"),
            count_if(F.col("n") > 1).alias("repeated_keys")).select(F.lit(name).alias("table_name"), "*"))
    return _union(out)


def fk_contract(tables: dict[str, DataFrame]) -> DataFrame:
    """Child rows without a parent, per relation."""
    out = []
    for child, ccol, parent, pcol in FOREIGN_KEYS:
        keys = tables[child].groupBy(F.col(ccol).alias("k")).agg(F.count("*").alias("n"))
        orphans = keys.join(tables[parent].select(F.col(pcol).alias("k")), "k", "left_anti")
        out.append(orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"))
                   .select(F.lit(f"{child}.{ccol}->{parent}.{pcol}").alias("relation"), "orphan_rows"))
    return _union(out)


def translation_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """Products and categories that no translation covers."""
    products = tables["products"].where(
        F.col("product_category_name").isNotNull() & (F.col("product_category_name") != ""))
    lone = products.groupBy("product_category_name").agg(F.count("*").alias("n")).join(
        tables["product_category_name_translation"], "product_category_name", "left_anti")
    return lone.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("untranslated_products"),
                    F.count("*").alias("untranslated_categories"))


def zip_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """Customers and sellers whose zip code is not in the geolocation table."""
    known = tables["geolocation"].select(F.col("geolocation_zip_code_prefix").alias("zip")).distinct()
    out = []
    for name, c in (("customers", "customer_zip_code_prefix"), ("sellers", "seller_zip_code_prefix")):
        zips = tables[name].groupBy(F.col(c).alias("zip")).agg(F.count("*").alias("n"))
        out.append(zips.join(known, "zip", "left_anti")
                   .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("uncovered_rows"), F.count("*").alias("uncovered_zips"))
                   .select(F.lit(name).alias("table_name"), "*"))
    return _union(out)


def join_cardinality_smoke(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of three join paths. Child keys are counted before the join, so the
    count of joined rows is a sum of products and no fan-out is materialised."""
    per = lambda t, k: tables[t].groupBy(k).agg(F.count("*").alias("n"))
    orders = tables["orders"].groupBy("order_id", "customer_id").agg(F.count("*").alias("o"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("row_count")
    paths = [
        ("orders-customers", orders.join(per("customers", "customer_id"), "customer_id")
         .agg(total(F.col("o") * F.col("n")))),
        ("orders-items-products",
         tables["order_items"].groupBy("order_id", "product_id").agg(F.count("*").alias("i"))
         .join(orders, "order_id").join(per("products", "product_id"), "product_id")
         .agg(total(F.col("i") * F.col("o") * F.col("n")))),
        ("orders-payments", orders.join(per("order_payments", "order_id"), "order_id")
         .agg(total(F.col("o") * F.col("n")))),
    ]
    return _union([df.select(F.lit(n).alias("join_path"), "row_count") for n, df in paths])
