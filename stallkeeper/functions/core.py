"""Helpers that most operators need.

Everything here builds a logical plan only, but for ``materialize`` and ``stored``, which run their input and store it.
"""
from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

MICROS_PER_DAY = 86_400_000_000.0
MONEY = "decimal(18,2)"


# ---------------------------------------------------------------- columns

def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double, NULL when the denominator is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def flag(cond: Column) -> Column:
    """1 when the condition holds, else 0 (also for an unknown condition)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond: Column, value: str | Column) -> Column:
    """Sum of ``value`` over rows meeting ``cond``; 0 when there are none."""
    return F.coalesce(F.sum(F.when(cond, col(value))), F.lit(0))


def distinct_if(cond: Column, value: str | Column) -> Column:
    return F.countDistinct(F.when(cond, col(value)))


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY)


def dbl(c: str | Column) -> Column:
    return col(c).cast("double")


def half_up(c: str | Column, places: int) -> Column:
    """Round halves away from zero on the decimal value, so that 0.675 becomes 0.68 although
    its binary form lies just below."""
    return F.round(col(c).cast("decimal(38,10)"), places).cast("double")


def month_of(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def month_start(month: str | Column) -> Column:
    """First day of a 'yyyy-MM' month."""
    return F.to_date(F.concat(col(month), F.lit("-01")))


def month_index(month: str | Column) -> Column:
    """Running number of a 'yyyy-MM' month, so that differences count months."""
    m = col(month)
    return (F.substring(m, 1, 4).cast("bigint") * 12
            + F.substring(m, 6, 2).cast("bigint"))


def shift_month(month: str | Column, by: int) -> Column:
    return F.date_format(F.add_months(month_start(month), by), "yyyy-MM")


def iso_weekday(ts: str | Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return (F.weekday(col(ts)) + 1).cast("bigint")


def day_type(ts: str | Column) -> Column:
    return F.when(F.weekday(col(ts)) >= 5, "Weekend").otherwise("Weekday")


def micros_between(later: str | Column, earlier: str | Column) -> Column:
    """Exact microseconds between two timestamps, whatever the session zone."""
    span = (col(later) - col(earlier)).cast("interval second").cast("decimal(18,6)")
    return (span * F.lit(1_000_000)).cast("bigint")


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Fractional days."""
    return micros_between(later, earlier) / F.lit(MICROS_PER_DAY)


def mean_days(micros: str | Column) -> Column:
    """Average of a microsecond column, in days.

    The sum is taken over decimals, so it neither overflows nor depends on the
    order in which partitions are merged.
    """
    c = col(micros)
    return F.try_divide(dbl(F.sum(c.cast("decimal(20,0)"))), dbl(F.count(c))) / MICROS_PER_DAY


def exact_mean(c: str | Column) -> Column:
    """Average of an integer or decimal column from its exact sum."""
    c = col(c)
    return F.try_divide(dbl(F.sum(c.cast("decimal(20,4)"))), dbl(F.count(c)))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's coefficient of two columns without NULLs, from mergeable central moments; NULL where one is constant
    (``corr`` would stop the query)."""
    return F.try_divide(F.covar_pop(dbl(x), dbl(y)), F.stddev_pop(dbl(x)) * F.stddev_pop(dbl(y)))


# ---------------------------------------------------------------- frames

def literal_rows(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A fixed handful of rows as one inline projection (no Python RDD)."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    types = [p.strip().split(" ")[1] for p in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types)])
               for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def with_values(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Every row of ``df`` once per literal value: the dense side of a grid."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def scalar(df: DataFrame, *names: str) -> Column:
    """A one-row frame as a scalar struct column (planned as a subquery)."""
    return df.select(F.struct(*names)).scalar()


def calendar(spark: SparkSession, first: Column, last: Column, step: str, name: str) -> DataFrame:
    """Dates from first to last; both may be scalar subqueries."""
    return spark.range(1).select(
        F.explode(F.sequence(first, last, F.expr(f"interval 1 {step}"))).alias(name))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for stored layers: the one set on the context or named in ``spark.checkpoint.dir``.

    Only a local session may do without: it gets a temporary folder that goes when Python ends. Anywhere else
    executors would each write to a disk of their own, so a missing setting is an error.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="stallkeeper-checkpoint-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Store an aggregated layer that several branches of one query read, so that the fact
    tables behind it are scanned once. Stored reliably: it outlives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, deleted when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Store a large layer by columns: each of its many readers then reads only those it names, where a checkpoint
    brings every row back whole."""
    path, schema = scratch_path(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def top_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key under a total order.

    Written as ``row_number() <= 1`` on purpose: Spark then plans a partial
    WindowGroupLimit, so every map task sends at most one row per key and a key
    holding a third of the table costs no more than any other.
    """
    return nth_row_per_key(df, keys, order, 1)


def nth_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    if n > 1:
        out = out.where(F.col("_rn") == n)
    return out.drop("_rn")


# ---------------------------------------------------------------- quantiles

_STEPS_PER_E = 256
_LN_FLOOR = 746
_STEPS = 4096


def _magnitude_bucket(v: Column) -> Column:
    """An order-preserving coarse bucket: sign and logarithm of the value.

    It is a fixed function of the value (no sampled boundaries), so a task that
    is recomputed after an executor loss lands in the same bucket.
    """
    step = F.floor(F.ln(F.abs(v)) * _STEPS_PER_E) + _LN_FLOOR * _STEPS_PER_E
    return (F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * step)).cast("bigint")


def nearest_rank(df: DataFrame, value: str, probs: Mapping[str, str],
                 by: Sequence[str] = ()) -> DataFrame:
    """Exact nearest-rank quantiles (rank = ceil(p*n)) of a large column.

    One output row per ``by`` group with a column per entry of ``probs`` (name to probability,
    given as text so that it stays decimal) plus ``value_count``, ``min_value``, ``max_value``.
    ``by`` is meant for a short list, such as the fields of a report.

    Narrow passes over the rows, and no task ever sees a whole group: the first counts rows per magnitude
    bucket (a few thousand at most, merged map-side); the second cuts only the buckets that hold a wanted
    rank into equal steps between their own smallest and largest value and counts again; the last collapses
    equal values of the wanted steps map-side and orders what is left.
    """
    by = list(by)
    rows = (df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
            .withColumn("_b", _magnitude_bucket(F.col("_v"))))
    per_bucket = rows.groupBy(*by, "_b").agg(
        F.count(F.lit(1)).alias("_bn"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w_all = W.partitionBy(*by)
    w_cum = w_all.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (per_bucket.withColumn("_cum", F.sum("_bn").over(w_cum)).withColumn("_total", F.sum("_bn").over(w_all))
              .withColumn("_min", F.min("_lo").over(w_all)).withColumn("_max", F.max("_hi").over(w_all)))
    targets = F.array(*[
        F.struct(F.lit(name).alias("name"),
                 F.greatest(F.lit(1), F.ceil(F.lit(p).cast("decimal(6,4)") * F.col("_total")))
                 .cast("bigint").alias("rank"))
        for name, p in probs.items()])
    before = F.col("_cum") - F.col("_bn")
    facts = ["_total", "_min", "_max"]
    wanted = (ranked.withColumn("_t", F.explode(targets))
              .where((F.col("_t.rank") <= F.col("_cum")) & (F.col("_t.rank") > before))
              .select(*by, "_b", F.col("_t.name").alias("_name"), *facts, "_lo", "_hi",
                      (F.col("_t.rank") - before).alias("_need")))
    # One row per group and probability: a handful.
    step = F.least(F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * _STEPS),
                              F.lit(0)), F.lit(_STEPS - 1)).cast("bigint")
    cell = [*by, "_name", "_b"]
    stepped = (rows.join(F.broadcast(wanted), [*by, "_b"]).withColumn("_s", step).groupBy(*cell, "_s").agg(
        F.count(F.lit(1)).alias("_sn"), *[F.max(c).alias(c) for c in (*facts, "_lo", "_hi", "_need")]))
    w_step = W.partitionBy(*cell).orderBy("_s").rowsBetween(W.unboundedPreceding, W.currentRow)
    before_step = F.col("_scum") - F.col("_sn")
    exact = (stepped.withColumn("_scum", F.sum("_sn").over(w_step))
             .where((F.col("_need") <= F.col("_scum")) & (F.col("_need") > before_step))
             .select(*cell, F.col("_s").alias("_step"), *facts, "_lo", "_hi", (F.col("_need") - before_step).alias("_need")))
    inside = (rows.join(F.broadcast(exact), [*by, "_b"]).where(step == F.col("_step")).groupBy(*cell, "_v").agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in ("_need", *facts)]))
    w_in = W.partitionBy(*cell).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = inside.withColumn("_c", F.sum("_n").over(w_in)).where(F.col("_c") >= F.col("_need"))
    return hit.groupBy(*by).agg(
        F.max("_total").alias("value_count"), F.max("_min").alias("min_value"), F.max("_max").alias("max_value"),
        *[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in probs])


QUARTILES = {"q1": "0.25", "median": "0.5", "q3": "0.75"}


def fences(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles with the 1.5 IQR fences."""
    spread = F.col("q3") - F.col("q1")
    return (nearest_rank(df, value, QUARTILES, by)
            .withColumn("lower_bound", F.col("q1") - 1.5 * spread)
            .withColumn("upper_bound", F.col("q3") + 1.5 * spread))


def outside(value: str | Column, bounds: Column) -> Column:
    """1 when the value lies outside the fences held in a scalar struct."""
    v = dbl(value)
    return flag((v < bounds["lower_bound"]) | (v > bounds["upper_bound"]))


_CELLS = 65_536


def _text_cell(text: Column, low: Column, high: Column) -> Column:
    """The three characters after the common beginning of all texts from low to high."""
    shorter = F.least(F.char_length(low), F.char_length(high))
    same = F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: F.substring(
        low, F.lit(1), i) == F.substring(high, F.lit(1), i))
    return F.substring(text, F.size(same) + 1, F.lit(3))


def global_rank(df: DataFrame, by: Sequence[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """Exact row number under (value, tie) inside each ``by`` group, plus the group size ``n``.

    A group, or a single value in it, may hold most of the table. Rows are therefore counted
    in order-preserving cells: magnitude bucket of the value, then the value, then a coarse
    bucket of the tie-break. A row's number is the rows in earlier buckets, plus those with
    smaller values in its bucket, plus those in earlier cells of its value, plus its number
    inside the cell.
    """
    by = list(by)
    ends = scalar(df.agg(F.min(tie).alias("lo"), F.max(tie).alias("hi")), "lo", "hi")
    rows = df.withColumn("_b", _magnitude_bucket(dbl(value))).withColumn("_e", ends).withColumn(
        "_c", _text_cell(F.col(tie), F.col("_e.lo"), F.col("_e.hi")) if dict(df.dtypes)[tie] == "string"
        else F.coalesce(F.floor(F.try_divide(
            dbl(tie) - dbl(F.col("_e.lo")), dbl(F.col("_e.hi")) - dbl(F.col("_e.lo"))) * _CELLS), F.lit(0))).drop("_e")
    cells = rows.groupBy(*by, "_b", value, "_c").agg(F.count(F.lit(1)).alias("_k"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    values = cells.groupBy(*by, "_b", value).agg(F.sum("_k").alias("_kv"))
    whole = W.partitionBy(*by)
    buckets = (values.groupBy(*by, "_b").agg(F.sum("_kv").alias("_kb"), F.min(dbl(value)).alias("_lo"), F.max(dbl(value)).alias("_hi"))
               .withColumn("_before_b", before("_kb", whole.orderBy("_b"))).withColumn("n", F.sum("_kb").over(whole)).drop("_kb"))
    step = F.coalesce(F.floor(F.try_divide(dbl(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * _STEPS), F.lit(0))
    values = values.join(buckets, [*by, "_b"]).withColumn("_s", step.cast("bigint"))
    steps = values.groupBy(*by, "_b", "_s").agg(F.sum("_kv").alias("_ks"))
    steps = steps.withColumn("_before_s", before("_ks", W.partitionBy(*by, "_b").orderBy("_s"))).drop("_ks")
    in_step = before("_kv", W.partitionBy(*by, "_b", "_s").orderBy(value))
    values = values.withColumn("_in_step", in_step).join(steps, [*by, "_b", "_s"]).select(
        *by, value, "n", (F.col("_before_b") + F.col("_before_s") + F.col("_in_step")).alias("_before_v"))
    before_c = before("_k", W.partitionBy(*by, value).orderBy("_c"))
    offsets = (cells.withColumn("_before_c", before_c).join(values, [*by, value])
               .select(*by, value, "_c", "n", (F.col("_before_v") + F.col("_before_c")).alias("_before")))
    inside = F.row_number().over(W.partitionBy(*by, value, "_c").orderBy(tie))
    return (rows.join(offsets, [*by, value, "_c"]).withColumn(name, F.col("_before") + inside)
            .drop("_b", "_c", "_before"))


def counted_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values of a large numeric column per ``by`` group (a short list of them) with ``n``, the rows that hold
    the value, and ``average_rank``, the mean of the places these rows take in the order of the column, from 1. NULLs
    take no part.

    Rows collapse to counted values first. These are ordered in magnitude buckets, in equal steps inside a bucket, and
    one by one only inside a step, so that no task orders more than the values of one step.
    """
    by = list(by)
    counted = materialize(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")))
    rows = counted.withColumn("_b", _magnitude_bucket(dbl(value)))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = rows.groupBy(*by, "_b").agg(F.sum("n").alias("_bn"), F.min(dbl(value)).alias("_lo"), F.max(dbl(value)).alias("_hi"))
    buckets = buckets.withColumn("_before_b", before("_bn", W.partitionBy(*by).orderBy("_b"))).drop("_bn")
    step = F.coalesce(F.floor(F.try_divide(dbl(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * _STEPS), F.lit(0))
    rows = rows.join(buckets, [*by, "_b"]).withColumn("_s", step.cast("bigint"))
    steps = rows.groupBy(*by, "_b", "_s").agg(F.sum("n").alias("_sn"))
    steps = steps.withColumn("_before_s", before("_sn", W.partitionBy(*by, "_b").orderBy("_s"))).drop("_sn")
    inside = before("n", W.partitionBy(*by, "_b", "_s").orderBy(value))
    return rows.withColumn("_before", inside).join(steps, [*by, "_b", "_s"]).select(
        *by, value, "n", (F.col("_before_b") + F.col("_before_s") + F.col("_before") + (F.col("n") + 1) / 2).alias("average_rank"))


def tile(rank: Column, n: Column, tiles: int) -> Column:
    """The ``ntile`` group of a row number: the first groups take the remainder."""
    q, r = F.floor(n / tiles), n % tiles
    return (F.when(rank <= r * (q + 1), F.ceil(rank / (q + 1)))
            .otherwise(r + F.ceil((rank - r * (q + 1)) / F.greatest(q, F.lit(1))))).cast("bigint")
