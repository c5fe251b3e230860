"""The commerce data model and the adapter that builds it from the star-schema tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stallkeeper.functions import stored

# Fixed values of the adapter.
STATUS = {"F": "delivered", "O": "shipped", "P": "canceled"}
PAYMENT_TYPE = {"A": "credit_card", "N": "boleto", "R": "voucher"}
UNTRANSLATED = ("Brand#7", "Brand#13")
BLANK_TRANSLATION = "Brand#21"
ESTIMATE_DAYS = 1000


class Commerce:
    """Nine marketplace tables, built on first use.

    Each source is a DataFrame or a function returning one, so that a query touches only the
    tables it names. ``orders_core`` holds the order columns known at purchase time, for
    operators that need no delivery timestamps; it defaults to those columns of ``orders``.
    ``item_records`` and ``payment_records`` are items and payments under a number that no other row of the order has,
    for operators that name single records; they default to ``items`` and ``payments``.
    """

    DERIVED = {"orders_core": "orders", "item_records": "items", "payment_records": "payments"}
    NAMES = ("customers", "geolocation", "products", "sellers", "translation", "orders", "items", "payments", "reviews",
             *DERIVED)
    CORE = ("order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_estimated_delivery_date")

    def __init__(self, spark: SparkSession, **sources: DataFrame | Callable[[], DataFrame]):
        unknown = set(sources) - set(self.NAMES)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        self.spark = spark
        self._sources = sources

    def __getattr__(self, name: str) -> DataFrame:
        if name == "orders_core" and name not in self._sources:
            frame = self.orders.select(*self.CORE)
        elif name in self.DERIVED and name not in self._sources:
            frame = getattr(self, self.DERIVED[name])
        elif name in self.NAMES and name in self._sources:
            source = self._sources[name]
            frame = source if isinstance(source, DataFrame) else source()
        else:
            raise AttributeError(name)
        self.__dict__[name] = frame
        return frame

    def with_tables(self, **frames: DataFrame) -> Commerce:
        """The same model with some tables replaced, such as by stored ones that many readings share. What derives from
        a replaced table then comes from the new one."""
        kept = {k: v for k, v in self._sources.items() if self.DERIVED.get(k) not in frames}
        return Commerce(self.spark, **{**kept, **frames})

    def held(self, *names: str) -> Commerce:
        """The same model with the named tables stored once, in the shared folder, for operators that read them often."""
        return self.with_tables(**{n: stored(getattr(self, n)) for n in names})

    def tables(self) -> dict[str, DataFrame]:
        return {
            "customers": self.customers,
            "geolocation": self.geolocation,
            "order_items": self.items,
            "order_payments": self.payments,
            "order_reviews": self.reviews,
            "orders": self.orders,
            "product_category_name_translation": self.translation,
            "products": self.products,
            "sellers": self.sellers,
        }


def _lookup(column, mapping: dict[str, str]):
    out = None
    for key, value in mapping.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out


def _zip(nation, number):
    return F.lpad((nation * 10 + number).cast("string"), 5, "0")


def _seconds(n):
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def _hours(n):
    return F.make_dt_interval(F.lit(0), n.cast("int"), F.lit(0), F.lit(0).cast("decimal(18,6)"))


# Declared, so that no read has to open files to learn its columns.
_SOURCE = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string",
    "labels": "doc_id bigint, quality int",
}


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(_SOURCE[name]).parquet(f"{path}/{name}.parquet")


def _hundredths(c: str):
    """A non-negative source number in hundredths (floor is a plain machine operation, where
    ``round`` of a double goes through decimal text)."""
    return F.floor(F.col(c) * 100 + 0.5)


def _amount(cents):
    """Cents as a line amount, in the declared money type."""
    return (cents.cast("decimal(16,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,2)")


class _Star:
    """The customer/orders/lineitem/part/supplier/nation tables as the commerce model.

    Every table but ``orders`` (delivery times come from the order's lines) is a narrow
    projection of its source; amounts are computed on integers. Lines keep the number they
    have in their order, which the source repeats now and then: the key contracts report that.
    Records that are named one by one get a number of their own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        return _read(self.spark, self.path, name)

    def _with_nation(self, name: str, key: str) -> DataFrame:
        return self.read(name).join(self.read("nation"), F.col(key) == F.col("n_nationkey"))

    def customers(self) -> DataFrame:
        return self._with_nation("customer", "c_nationkey").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_custkey").alias("customer_unique_id"),
            _zip(F.col("c_nationkey"), F.col("c_custkey") % 8).alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"), F.col("n_name").alias("customer_state"))

    def geolocation(self) -> DataFrame:
        return self._with_nation("customer", "c_nationkey").select(
            _zip(F.col("c_nationkey"), F.col("c_custkey") % 7).alias("geolocation_zip_code_prefix"),
            (F.col("c_nationkey") * 3.0 - 36.0).alias("geolocation_lat"),
            (F.col("c_nationkey") * 7.0 - 90.0).alias("geolocation_lng"),
            F.col("c_mktsegment").alias("geolocation_city"), F.col("n_name").alias("geolocation_state"))

    def products(self) -> DataFrame:
        size = F.col("p_size")
        return self.read("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(size == 2, "").when(size != 1, F.col("p_brand")).alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"), (size * 10).alias("product_description_lenght"),
            (size % 6).alias("product_photos_qty"), F.when(size != 1, size * 100).alias("product_weight_g"),
            size.alias("product_length_cm"), (size % 20).alias("product_height_cm"),
            (size % 15).alias("product_width_cm"))

    def translation(self) -> DataFrame:
        brand = F.col("p_brand")
        return self.read("part").select(brand).distinct().where(~brand.isin(*UNTRANSLATED)).select(
            brand.alias("product_category_name"),
            F.when(brand == BLANK_TRANSLATION, " ")
            .otherwise(F.concat(F.lit("category_"), F.substring_index(brand, "#", -1))).alias("product_category_name_english"))

    def sellers(self) -> DataFrame:
        return self._with_nation("supplier", "s_nationkey").select(
            F.col("s_suppkey").alias("seller_id"),
            _zip(F.col("s_nationkey"), F.col("s_suppkey") % 9).alias("seller_zip_code_prefix"),
            F.concat(F.lit("city_"), F.col("s_suppkey") % 10).alias("seller_city"), F.col("n_name").alias("seller_state"))

    def _orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        bought = F.col("o_orderdate") + _seconds((key * 7919) % 86400)
        return self.read("orders").select(
            key.alias("order_id"), F.col("o_custkey").alias("customer_id"),
            _lookup(F.col("o_orderstatus"), STATUS).alias("order_status"), bought.alias("order_purchase_timestamp"),
            F.when(key % 97 != 0, bought + _hours(key % 49 - 1)).alias("order_approved_at"),
            (F.col("o_orderdate") + F.expr(f"interval {ESTIMATE_DAYS} days")).alias("order_estimated_delivery_date"))

    def orders_core(self) -> DataFrame:
        return self._orders().select(*Commerce.CORE)

    def orders(self) -> DataFrame:
        shipped = self.read("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
            F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
        return self._orders().join(shipped, "order_id", "left").select(
            "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
            F.col("first_ship").alias("order_delivered_carrier_date"),
            F.when(F.col("order_status") == "delivered", F.col("last_ship") + F.expr("interval 12 hours"))
            .alias("order_delivered_customer_date"), "order_estimated_delivery_date")

    def _lines(self) -> DataFrame:
        return self.read("lineitem").withColumn("_number", F.col("l_linenumber"))

    def _numbered(self) -> DataFrame:
        """Lines numbered within their order by line number, then by their other columns. Lines per order and line
        number are counted first, so that a row is ordered only among those that share its line number."""
        cell = ["l_orderkey", "l_linenumber"]
        before = F.sum("_k").over(W.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(W.unboundedPreceding, -1))
        lines = self.read("lineitem")
        cells = lines.groupBy(*cell).agg(F.count("*").alias("_k")).select(
            *cell, F.coalesce(before, F.lit(0)).alias("_before"))
        inside = F.row_number().over(W.partitionBy(*cell).orderBy(
            "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"))
        return lines.join(cells, cell).withColumn("_number", (F.col("_before") + inside).cast("int"))

    def items(self) -> DataFrame:
        return self._items(self._lines())

    def item_records(self) -> DataFrame:
        return self._items(self._numbered())

    def payments(self) -> DataFrame:
        return self._payments(self._lines())

    def payment_records(self) -> DataFrame:
        return self._payments(self._numbered())

    @staticmethod
    def _items(lines: DataFrame) -> DataFrame:
        cents = _hundredths("l_extendedprice")
        freight = F.floor((cents * _hundredths("l_tax") + 50) / 100)
        return lines.select(
            F.col("l_orderkey").alias("order_id"), F.col("_number").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
            (F.col("l_shipdate") + F.expr("interval 3 days")).alias("shipping_limit_date"),
            _amount(cents).alias("price"), _amount(freight).alias("freight_value"))

    @staticmethod
    def _payments(lines: DataFrame) -> DataFrame:
        qty = F.col("l_quantity").cast("bigint")
        paid = (_hundredths("l_extendedprice") * (100 - _hundredths("l_discount")) * (100 + _hundredths("l_tax")))
        cents = F.when(qty == 50, F.lit(0)).otherwise(F.floor((paid + 5000) / 10000))
        return lines.select(
            F.col("l_orderkey").alias("order_id"), F.col("_number").alias("payment_sequential"),
            _lookup(F.col("l_returnflag"), PAYMENT_TYPE).alias("payment_type"),
            (qty % 13).alias("payment_installments"), _amount(cents).alias("payment_value"))

    def reviews(self) -> DataFrame:
        qty = F.col("l_quantity").cast("bigint")
        score = (F.col("l_linenumber") + qty) % 6
        return self.read("lineitem").select(
            (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("review_id"),
            F.col("l_orderkey").alias("order_id"), score.cast("bigint").alias("review_score"),
            F.lit(None).cast("string").alias("review_comment_title"),
            F.when(score <= 2, F.concat(F.lit("late item "), F.col("l_partkey") % 10)).alias("review_comment_message"),
            F.col("l_shipdate").alias("review_creation_date"),
            (F.col("l_shipdate") + F.make_dt_interval((1 + qty % 4).cast("int"))).alias("review_answer_timestamp"))


def from_star_schema(spark: SparkSession, path: str) -> Commerce:
    star = _Star(spark, path)
    return Commerce(spark, **{name: getattr(star, name) for name in Commerce.NAMES})


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Labelled texts for the keyword operators: doc id, group, score, text."""
    return _read(spark, path, "documents").join(_read(spark, path, "labels"), "doc_id").select(
        F.col("doc_id").alias("order_id"), F.col("lang").alias("category_name"),
        F.when(F.col("quality") == 0, 1).otherwise(5).cast("bigint").alias("review_score"),
        F.col("text").alias("review_comment_message"))
