"""Freight by region and distance, the nearest supply of each place, and freight against weight and volume."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper.functions import count_if, dbl, half_up, materialize, nearest_rank, ratio
from stallkeeper.operators.cleaning import dedup_geolocation, sellable_items
from stallkeeper.operators.metrics import delivered
from stallkeeper.sources.model import Commerce

EARTH_KM = 6371.0088
DISTANCE_BANDS = (100, 500, 1000, 2000)


# ---------------------------------------------------------------- places

def zip_centroids(m: Commerce) -> DataFrame:
    """Mean position of each zip code's distinct points; points off the globe are left out."""
    at = (F.col("geolocation_lat").between(-90, 90)) & (F.col("geolocation_lng").between(-180, 180))
    return dedup_geolocation(m).where(at & F.col("geolocation_zip_code_prefix").isNotNull()).groupBy(
        F.col("geolocation_zip_code_prefix").alias("zip")).agg(
        F.avg("geolocation_lat").alias("lat"), F.avg("geolocation_lng").alias("lng"))


def great_circle_km(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2)
    h = half(lat, lat2) * half(lat, lat2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * half(lng, lng2) * half(lng, lng2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def shipments(m: Commerce) -> DataFrame:
    """One row per delivered order and seller: zips and states of both ends, items, item value and freight."""
    done = m.orders_core.where(delivered()).select("order_id")  # first, so that no other order's items are grouped
    sent = sellable_items(m).join(done, "order_id", "left_semi").groupBy("order_id", "seller_id").agg(
        F.count("*").alias("items"), F.sum("price").alias("price"), F.sum("freight_value").alias("freight"))
    ends = m.orders_core.where(delivered()).join(m.customers, "customer_id").select(
        "order_id", F.col("customer_zip_code_prefix").alias("to_zip"), F.col("customer_state").alias("destination"))
    sellers = m.sellers.select("seller_id", F.col("seller_zip_code_prefix").alias("from_zip"), F.col("seller_state").alias("origin"))
    return sent.join(ends, "order_id").join(sellers, "seller_id")


def _band(km: Column, bands: Sequence[float]) -> Column:
    out = F.when(km.isNull(), "unknown")
    for low, high in zip((0, *bands), bands):
        out = out.when(km < high, f"{low}-{high}")
    return out.otherwise(f"{bands[-1]}+")


def freight_by_distance(m: Commerce, bands: Sequence[float] = DISTANCE_BANDS) -> DataFrame:
    """Freight per origin state, destination state and distance band (km between the zips' centroids; ``unknown``
    where one has none).

    Shipments collapse to pairs of zips before centroids are looked up, so distances are worked out once a pair."""
    pairs = shipments(m).groupBy("origin", "destination", "from_zip", "to_zip").agg(
        F.count("*").alias("shipments"), F.sum("items").alias("items"), F.sum("price").alias("price"), F.sum("freight").alias("freight"))
    at = materialize(zip_centroids(m))
    end = lambda p: at.select(F.col("zip").alias(f"{p}_zip"), F.col("lat").alias(f"{p}_lat"), F.col("lng").alias(f"{p}_lng"))
    rows = pairs.join(end("from"), "from_zip", "left").join(end("to"), "to_zip", "left")
    km = F.round(great_circle_km(F.col("from_lat"), F.col("from_lng"), F.col("to_lat"), F.col("to_lng")), 6)
    out = rows.withColumn("km", km).groupBy("origin", "destination", _band(F.col("km"), bands).alias("distance_band")).agg(
        F.sum("shipments").alias("shipment_count"), F.sum("items").alias("item_count"), F.sum("price").alias("price"),
        F.sum("freight").alias("freight"), F.sum(F.col("km") * F.col("shipments")).alias("_km"))
    return out.select(
        "origin", "destination", "distance_band", "shipment_count", "item_count", dbl("freight").alias("freight_value"),
        half_up(ratio("freight", "shipment_count"), 4).alias("freight_per_shipment"),
        half_up(ratio("freight", "price"), 6).alias("freight_share"), half_up(ratio("_km", "shipment_count"), 3).alias("average_km"))


CELLS = (1, 5, 20, 60, 180)  # degrees; each divides 360, so that cells close around the globe


def _reach(lat: Column, cell: int) -> Column:
    """Kilometres within which the cells around a point's own hold everything: to the parallel one cell away, or to the
    meridian one cell away, whichever is nearer."""
    if cell >= 180:
        return F.lit(math.inf)
    angle = math.radians(cell)
    east = F.asin(F.lit(math.sin(min(angle, math.pi / 2))) * F.cos(F.radians(lat)))
    return F.lit(EARTH_KM) * F.least(F.lit(angle), east)


def nearest_place(places: DataFrame, targets: DataFrame) -> DataFrame:
    """For each place (zip, lat, lng) the nearest target and its distance in km, ties to the smallest zip.

    Both are dealt to grid cells; a place meets only the targets of its own and the eight cells around it, and is done
    if the best of these is nearer than anything outside can be. The rest go on to a coarser grid, in the end to one
    that spans the globe. So no join compares all with all unless places lie further from every target than 60 degrees.
    """
    left, done = materialize(places.select("zip", "lat", "lng")), []
    targets = materialize(targets.select(F.col("zip").alias("near_zip"), F.col("lat").alias("near_lat"), F.col("lng").alias("near_lng")))
    for cell in CELLS:
        around = 360 // cell
        row = lambda c: F.floor(F.col(c) / cell).cast("int")
        column = lambda c: F.pmod(F.floor(F.col(c) / cell).cast("int"), F.lit(around))
        steps = sorted({s % around for s in (-1, 0, 1)})
        spread = left.withColumn("_r", F.explode(F.array(*[row("lat") + i for i in (-1, 0, 1)]))).withColumn(
            "_c", F.explode(F.array(*[F.pmod(column("lng") + i, F.lit(around)) for i in steps])))
        met = spread.join(targets.withColumn("_r", row("near_lat")).withColumn("_c", column("near_lng")), ["_r", "_c"])
        km = F.round(great_circle_km(F.col("lat"), F.col("lng"), F.col("near_lat"), F.col("near_lng")), 6)
        best = met.groupBy("zip", "lat").agg(F.min(F.struct(km.alias("km"), F.col("near_zip").alias("near_zip"))).alias("best"))
        found = materialize(best.where(F.col("best.km") < _reach(F.col("lat"), cell)).select("zip", "best.near_zip", "best.km"))
        done.append(found)
        left = materialize(left.join(found, "zip", "left_anti"))
        if left.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def nearest_supply(m: Commerce) -> DataFrame:
    """Per customer zip with a position: the nearest zip that has sellers, and how far its goods come from instead."""
    at = materialize(zip_centroids(m))
    by_pair = shipments(m).groupBy("from_zip", "to_zip").agg(F.count("*").alias("n"))
    sellers = m.sellers.select(F.col("seller_zip_code_prefix").alias("zip")).distinct().join(at, "zip")
    buyers = m.customers.groupBy(F.col("customer_zip_code_prefix").alias("zip")).agg(F.count("*").alias("customer_count"))
    buyers = materialize(buyers.join(at, "zip"))
    origin = at.select(F.col("zip").alias("from_zip"), F.col("lat").alias("from_lat"), F.col("lng").alias("from_lng"))
    km = F.round(great_circle_km(F.col("lat"), F.col("lng"), F.col("from_lat"), F.col("from_lng")), 6)
    travelled = (by_pair.join(origin, "from_zip").join(at.withColumnRenamed("zip", "to_zip"), "to_zip").groupBy("to_zip").agg(
        F.sum("n").alias("shipment_count"), F.sum(km * F.col("n")).alias("_km")))
    near = nearest_place(buyers, sellers)
    return (buyers.join(near, "zip").join(travelled, F.col("zip") == F.col("to_zip"), "left").select(
        F.col("zip").alias("customer_zip"), "customer_count", F.col("near_zip").alias("nearest_seller_zip"),
        half_up("km", 3).alias("nearest_km"), F.coalesce("shipment_count", F.lit(0)).alias("shipment_count"),
        half_up(ratio("_km", "shipment_count"), 3).alias("average_km")))


# ---------------------------------------------------------------- freight against size

X = ("one", "weight_kg", "volume_litres")


def freight_rows(m: Commerce) -> DataFrame:
    """Delivered items with freight, weight and volume of the product and the state they come from."""
    volume = dbl("product_length_cm") * dbl("product_height_cm") * dbl("product_width_cm") / 1000.0
    sizes = m.products.select("product_id", (dbl("product_weight_g") / 1000.0).alias("weight_kg"), volume.alias("volume_litres"))
    orders = m.orders_core.where(delivered()).select("order_id")
    return (sellable_items(m).select("order_id", "product_id", "seller_id", "freight_value").join(orders, "order_id", "left_semi")
            .join(sizes.where("weight_kg > 0 AND volume_litres > 0"), "product_id")
            .join(m.sellers.select("seller_id", F.col("seller_state").alias("origin")), "seller_id")
            .select("origin", dbl("freight_value").alias("y"), F.lit(1.0).alias("one"), "weight_kg", "volume_litres"))


def _solve(sums: DataFrame, k: int, name: str) -> DataFrame:
    """Adds ``<name>0`` ... : the solution of a x = b for the columns a_i_j (i <= j) and b_i of each row, by Cholesky.
    NULL where a pivot is lost to rounding, that is, where the features depend on each other."""
    df = sums
    col = F.col
    for j in range(k):
        left = col(f"a_{j}_{j}")
        for q in range(j):
            left = left - col(f"_l_{j}_{q}") * col(f"_l_{j}_{q}")
        df = df.withColumn(f"_l_{j}_{j}", F.when(left > F.lit(1e-9) * col(f"a_{j}_{j}"), F.sqrt(left)))
        for i in range(j + 1, k):
            inner = col(f"a_{j}_{i}")
            for q in range(j):
                inner = inner - col(f"_l_{i}_{q}") * col(f"_l_{j}_{q}")
            df = df.withColumn(f"_l_{i}_{j}", inner / col(f"_l_{j}_{j}"))
    for i in range(k):
        inner = col(f"b_{i}")
        for q in range(i):
            inner = inner - col(f"_l_{i}_{q}") * col(f"_f_{q}")
        df = df.withColumn(f"_f_{i}", inner / col(f"_l_{i}_{i}"))
    for i in reversed(range(k)):
        inner = col(f"_f_{i}")
        for q in range(i + 1, k):
            inner = inner - col(f"_l_{q}_{i}") * col(f"{name}{q}")
        df = df.withColumn(f"{name}{i}", inner / col(f"_l_{i}_{i}"))
    return df


def robust_lines(rows: DataFrame, by: str, x: Sequence[str], y: str, scales: int = 3, rounds: int = 4,
                 tuning: float = 1.345, least_rows: int = 30) -> DataFrame:
    """Huber regression of ``y`` on ``x`` in each ``by`` group at once.

    Starts from least squares. ``scales`` times the scale is taken as 1.4826 times the median absolute residual of the
    line so far, and ``rounds`` rounds follow with it: each weighs a row by min(1, tuning * scale / |residual|) and solves the groups' weighted sums: one map-side aggregate over the
    stored rows, joined with one row per group. Columns: the group, row_count, scale, trimmed_count (rows with a weight
    below 1 in the end), plain0 ... (least squares) and w0 ... (Huber). Groups of few rows, or whose features depend on
    each other, have NULL weights."""
    x, k = list(x), len(x)
    rows = materialize(rows.select(by, *x, y))

    def sums(frame: DataFrame, weight: Column) -> DataFrame:
        c = F.col
        return frame.groupBy(by).agg(
            *[F.sum(weight * c(x[i]) * c(x[j])).alias(f"a_{i}_{j}") for i in range(k) for j in range(i, k)],
            *[F.sum(weight * c(x[i]) * c(y)).alias(f"b_{i}") for i in range(k)], F.count(F.lit(1)).alias("row_count"))

    def residual(name: str) -> Column:
        out = F.col(y)
        for i in range(k):
            out = out - F.col(f"{name}{i}") * F.col(x[i])
        return F.abs(out)

    plain = _solve(sums(rows, F.lit(1.0)), k, "plain").where(F.col("row_count") >= least_rows)
    plain = materialize(plain.select(by, "row_count", *[f"plain{i}" for i in range(k)]))
    usable = plain.dropna()
    weights = [f"w{i}" for i in range(k)]
    now = usable.select(by, *[F.col(f"plain{i}").alias(f"w{i}") for i in range(k)])
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(tuning) * F.col("scale"), residual("w")), F.lit(1.0)))
    for _ in range(scales):
        off = rows.join(now, by).select(by, residual("w").alias("v"))
        scale = nearest_rank(off, "v", {"median": "0.5"}, [by]).select(by, (F.lit(1.4826) * F.col("median")).alias("scale"))
        now = materialize(now.select(by, *weights).join(scale, by))
        for _ in range(rounds):
            step = _solve(sums(rows.join(now, by), share), k, "w").select(by, *weights)
            now = materialize(step.join(now.select(by, "scale"), by))
    trimmed = rows.join(now, by).groupBy(by).agg(count_if(share < 1).alias("trimmed_count"))
    return (rows.groupBy(by).agg(F.count(F.lit(1)).alias("row_count")).join(plain.drop("row_count"), by, "left")
            .join(now, by, "left").join(trimmed, by, "left"))


def freight_by_size(m: Commerce) -> DataFrame:
    """Freight of an item by origin state as base + per_kg * weight + per_litre * volume, once by least squares and once
    so that single costly items do not carry the line."""
    lines = robust_lines(freight_rows(m), "origin", X, "y")
    return lines.select(
        F.col("origin").alias("seller_state"), F.col("row_count").alias("item_count"), half_up("scale", 6).alias("scale"),
        "trimmed_count", *[half_up(f"w{i}", 6).alias(n) for i, n in enumerate(("base", "per_kg", "per_litre"))],
        *[half_up(f"plain{i}", 6).alias(f"plain_{n}") for i, n in enumerate(("base", "per_kg", "per_litre"))])
