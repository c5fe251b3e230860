"""Statements whose rounds are written out by a loop: fits in plain SQL, one common table expression per round.

The blocks have the form of the ``.sql`` files. Symmetric systems are solved by Cholesky's method, column by column;
DuckDB lets a column use the ones before it.
"""
from __future__ import annotations

import math

K_MEANS_ROUNDS = 15


def solved(k: int, source: str, ridge: list[str] | None = None, shift: list[str] | None = None, out: str = "x") -> str:
    """Subquery that solves a x = b, with a_i_j (i <= j) and b_i columns of ``source``. Each step is a level of its own:
    a column that names another one of its level would be written out in full."""
    ridge, shift = ridge or ["0"] * k, shift or ["0"] * k
    levels = []
    for j in range(k):
        inner = " ".join(f"- l_{j}_{q} * l_{j}_{q}" for q in range(j))
        levels.append([f"sqrt(a_{j}_{j} + {ridge[j]} {inner}) AS l_{j}_{j}"])
        levels.append([f"(a_{j}_{i} " + " ".join(f"- l_{i}_{q} * l_{j}_{q}" for q in range(j)) + f") / l_{j}_{j} AS l_{i}_{j}"
                       for i in range(j + 1, k)])
    for i in range(k):
        inner = " ".join(f"- l_{i}_{q} * f_{q}" for q in range(i))
        levels.append([f"(b_{i} - ({shift[i]}) {inner}) / l_{i}_{i} AS f_{i}"])
    for i in reversed(range(k)):
        inner = " ".join(f"- l_{q}_{i} * {out}_{q}" for q in range(i + 1, k))
        levels.append([f"(f_{i} {inner}) / l_{i}_{i} AS {out}_{i}"])
    for level in levels:
        if level:
            source = f"(SELECT *, {', '.join(level)} FROM {source})"
    return source


def cross(k: int, x: str, y: str, w: str = "1.0") -> str:
    """Cross products of x0, x1, ... with each other and with y."""
    name = lambda i: x.format(i)
    parts = [f"sum({w} * {name(i)} * {name(j)}) AS a_{i}_{j}" for i in range(k) for j in range(i, k)]
    return ", ".join(parts + [f"sum({name(i)} * {y}) AS b_{i}" for i in range(k)])


def _k_means(k: int, dims: int) -> str:
    """Blocks seed_1 .. centres_0, centres_1, ... over points(key, z0, z1, ...)."""
    far = " + ".join(f"(p.z{d} - c.z{d}) * (p.z{d} - c.z{d})" for d in range(dims))
    zs = ", ".join(f"CAST(z{d} AS DOUBLE) AS z{d}" for d in range(dims))
    ctes = [f"seeds_1 AS MATERIALIZED (SELECT 0 AS i, {zs} FROM points ORDER BY points.z0 DESC, key LIMIT 1)"]
    for s in range(1, k):
        ctes.append(f"""seeds_{s + 1} AS MATERIALIZED (SELECT * FROM seeds_{s} UNION ALL SELECT * FROM (
  SELECT {s} AS i, {', '.join(f'CAST(any_value(p.z{d}) AS DOUBLE)' for d in range(dims))} FROM points p, seeds_{s} c GROUP BY p.key
  ORDER BY min({far}) DESC, p.key LIMIT 1))""")
    ctes.append(f"centres_0 AS MATERIALIZED (SELECT * FROM seeds_{k})")
    for r in range(K_MEANS_ROUNDS):
        means = ", ".join(f"coalesce(s.z{d}, c.z{d}) AS z{d}" for d in range(dims))
        sums = ", ".join(f"CAST(sum(z{d}) AS DOUBLE) / count(*) AS z{d}" for d in range(dims))
        own = ", ".join(f"any_value(p.z{d}) AS z{d}" for d in range(dims))
        ctes.append(f"""centres_{r + 1} AS MATERIALIZED (SELECT c.i, {means} FROM centres_{r} c LEFT JOIN (
  SELECT i, {sums} FROM (SELECT arg_min(c.i, ({far}, c.i)) AS i, {own} FROM points p, centres_{r} c GROUP BY p.key) GROUP BY i) s
  ON s.i = c.i)""")
    return ",\n".join(ctes)


def _regions() -> str:
    dims, last = 4, f"centres_{K_MEANS_ROUNDS}"
    far = " + ".join(f"(p.z{d} - c.z{d}) * (p.z{d} - c.z{d})" for d in range(dims))
    names = ["log_recent_gmv", "gmv_growth_rate", "seller_concentration", "freight_share"]
    z = ", ".join(f"coalesce(CAST(round(({n} - avg({n}) OVER ()) / nullif(stddev_pop({n}) OVER (), 0) * 1000000) AS BIGINT), 0) AS z{d}"
                  for d, n in enumerate(names))
    whole = " AND ".join(f"{n} IS NOT NULL" for n in names)
    tiers = f"""WITH region_supply AS (
  SELECT customer_state, count(*) AS seller_count, sum(price) AS item_value, sum(freight) AS freight,
         sum(CAST(price AS DOUBLE) * CAST(price AS DOUBLE)) AS squares
  FROM (SELECT customer_state, i.seller_id, sum(price) AS price, sum(freight_value) AS freight
        FROM c_items i JOIN c_orders o ON o.order_id = i.order_id JOIN m_customers c ON c.customer_id = o.customer_id
        WHERE order_status = 'delivered' GROUP BY ALL) GROUP BY customer_state),
region_facts AS MATERIALIZED (
  SELECT b.customer_state, recent_gmv, recent_unique_users, coalesce(seller_count, 0) AS seller_count,
         ln(1.0::DOUBLE + recent_gmv) AS log_recent_gmv, gmv_growth_rate,
         squares / (CAST(item_value AS DOUBLE) * CAST(item_value AS DOUBLE)) AS seller_concentration,
         CAST(freight AS DOUBLE) / CAST(item_value AS DOUBLE) AS freight_share
  FROM market_base b LEFT JOIN region_supply s ON s.customer_state = b.customer_state),
points AS MATERIALIZED (SELECT customer_state AS key, {z} FROM region_facts WHERE {whole}),
{_k_means(4, dims)},
ordered AS (SELECT *, row_number() OVER (ORDER BY {', '.join(f'z{d} DESC' for d in range(dims))}) AS tier FROM {last}),
placed AS (SELECT p.key, arg_min(c.tier, ({far}, c.tier)) AS tier, sqrt(min({far})) / 1000000 AS centre_distance
           FROM points p, ordered c GROUP BY p.key),
region_table AS (
  SELECT customer_state, tier, row_number() OVER (ORDER BY tier NULLS LAST, gmv_growth_rate DESC NULLS LAST, customer_state)
           AS expansion_rank, recent_gmv, recent_unique_users, seller_count,
         half_up(gmv_growth_rate, 6) AS gmv_growth_rate, half_up(seller_concentration, 6) AS seller_concentration,
         half_up(freight_share, 6) AS freight_share, half_up(centre_distance, 6) AS centre_distance
  FROM region_facts LEFT JOIN placed ON key = customer_state)
"""
    return f"""
-- @query region_tiers
{tiers}SELECT * FROM region_table

-- @query region_tier_summary
{tiers}SELECT tier, count(*) AS state_count, CAST(sum(CAST(recent_gmv AS DECIMAL(28,2))) AS DOUBLE) AS recent_gmv,
       half_up(sum(recent_gmv) / sum(sum(recent_gmv)) OVER (), 6) AS gmv_share,
       CAST(sum(recent_unique_users) AS BIGINT) AS user_count, half_up(avg(gmv_growth_rate), 4) AS average_gmv_growth_rate,
       half_up(avg(seller_concentration), 4) AS average_seller_concentration, half_up(avg(freight_share), 4) AS average_freight_share,
       count(*) FILTER (gmv_growth_rate > 0) AS growing_state_count
FROM region_table WHERE tier IS NOT NULL GROUP BY tier
"""


LOGISTIC_ROUNDS = 15
RISK_FEATURES = ["log_recency", "log_orders", "log_gmv", "late_share", "average_score", "no_score"]


def _risk() -> str:
    k = len(RISK_FEATURES) + 1

    def users(name: str, cutoff: str) -> str:
        return f"""{name}_orders AS (
  SELECT b.*, review_score,
         CASE WHEN order_delivered_customer_date >= order_purchase_timestamp
              THEN CAST(order_delivered_customer_date > order_estimated_delivery_date AS BIGINT) END AS is_delayed
  FROM cob b LEFT JOIN rep_review r ON r.order_id = b.order_id WHERE purchase_date <= DATE '{cutoff}'),
{name} AS MATERIALIZED (
  SELECT customer_unique_id, ln(1.0::DOUBLE + date_diff('day', CAST(max(order_purchase_timestamp) AS DATE), DATE '{cutoff}')) AS log_recency,
         ln(1.0::DOUBLE + count(*)) AS log_orders, ln(1.0::DOUBLE + CAST(sum(order_gmv) AS DOUBLE)) AS log_gmv,
         coalesce(sum(is_delayed) / nullif(count(is_delayed), 0), 0.0) AS late_share,
         coalesce(CAST(sum(review_score) AS DOUBLE) / nullif(count(review_score), 0), 3.0) AS average_score,
         CASE WHEN count(review_score) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS no_score
  FROM {name}_orders GROUP BY customer_unique_id)"""

    scores = ", ".join(f"coalesce(({f} - m_{i}) / nullif(s_{i}, 0), 0.0) AS x{i + 1}" for i, f in enumerate(RISK_FEATURES))
    stats = ", ".join(f"avg({f}) AS m_{i}, stddev_pop({f}) AS s_{i}" for i, f in enumerate(RISK_FEATURES))
    ridge = ["1e-12"] + ["(1.0 + 1e-12)"] * (k - 1)
    shift = ["0.0"] + [f"w_{i}" for i in range(1, k)]
    eta = " + ".join(f"x{i} * w_{i}" for i in range(k))
    ctes = ["w_0 AS MATERIALIZED (SELECT " + ", ".join(f"0.0::DOUBLE AS w_{i}" for i in range(k)) + ")"]
    for r in range(LOGISTIC_ROUNDS):
        inner = (f"SELECT {cross(k, 'x{}', '(y - p)', '(p * (1.0 - p))')}, " + ", ".join(f"any_value(w_{i}) AS w_{i}" for i in range(k))
                 + f" FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({eta}))) AS p FROM train, w_{r})")
        step = ", ".join(f"w_{i} + x_{i} AS w_{i}" for i in range(k))
        ctes.append(f"w_{r + 1} AS MATERIALIZED (SELECT {step} FROM {solved(k, f'({inner})', ridge, shift)})")
    held = "CAST('0x' || substr(md5(CAST(customer_unique_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0"
    last = f"w_{LOGISTIC_ROUNDS}"
    model = f"""WITH {users('past', '2001-04-30')},
later AS (SELECT DISTINCT customer_unique_id FROM cob
          WHERE purchase_date > DATE '2001-04-30' AND purchase_date <= DATE '2001-04-30' + INTERVAL 90 DAY),
labelled AS MATERIALIZED (
  SELECT p.*, CASE WHEN l.customer_unique_id IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, {held.replace('customer_unique_id', 'p.customer_unique_id')} AS held_out
  FROM past p LEFT JOIN later l ON l.customer_unique_id = p.customer_unique_id),
stats AS MATERIALIZED (SELECT {stats} FROM labelled WHERE NOT held_out),
train AS MATERIALIZED (SELECT 1.0::DOUBLE AS x0, {scores}, y FROM labelled, stats WHERE NOT held_out),
{", ".join(ctes)},
tested AS (SELECT customer_unique_id, y, half_up(1.0::DOUBLE / (1.0::DOUBLE + exp(-({eta}))), 9) AS p
           FROM (SELECT customer_unique_id, 1.0::DOUBLE AS x0, {scores}, y FROM labelled, stats WHERE held_out), {last})
"""
    rows = " UNION ALL ".join(
        [f"SELECT 'constant' AS feature, 0 AS place, NULL::DOUBLE AS mean, NULL::DOUBLE AS deviation, w_0 AS weight FROM {last}"]
        + [f"SELECT '{f}', {i + 1}, m_{i}, s_{i}, w_{i + 1} FROM stats, {last}" for i, f in enumerate(RISK_FEATURES)])
    return f"""
-- @query churn_risk_model
{model}SELECT feature, CAST(place AS BIGINT) AS place, half_up(mean, 6) AS mean, half_up(deviation, 6) AS deviation,
       half_up(weight, 6) AS weight, half_up(exp(weight), 6) AS odds_ratio FROM ({rows})

-- @query churn_risk_quality
{model}, placed AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r,
                           row_number() OVER (ORDER BY p DESC, customer_unique_id) AS n FROM tested)
SELECT count(*) AS user_count, CAST(sum(y) AS BIGINT) AS churned_count, half_up(avg(y), 6) AS churn_rate,
       half_up((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS ranking_quality,
       count(*) FILTER (n <= ceil(0.1 * total)) AS top_count,
       half_up(avg(y) FILTER (n <= ceil(0.1 * total)), 6) AS top_churn_rate,
       half_up(avg(y) FILTER (n <= ceil(0.1 * total)) / nullif(avg(y), 0), 6) AS top_lift,
       half_up(avg((p - y) * (p - y)), 6) AS squared_error
FROM placed, (SELECT count(*) AS total FROM tested)

-- @query churn_risk_users
{model}, {users('present', '2001-07-31')},
at_risk AS (SELECT customer_unique_id, half_up(1.0::DOUBLE / (1.0::DOUBLE + exp(-({eta}))), 9) AS risk, log_recency, log_orders, log_gmv
           FROM (SELECT customer_unique_id, log_recency, log_orders, log_gmv, 1.0::DOUBLE AS x0, {scores} FROM present, stats), {last})
SELECT customer_unique_id, row_number() OVER (ORDER BY risk DESC, customer_unique_id) AS risk_rank, half_up(risk, 6) AS risk,
       CAST(round(exp(log_recency) - 1) AS BIGINT) AS recency_days, CAST(round(exp(log_orders) - 1) AS BIGINT) AS valid_order_count,
       half_up(exp(log_gmv) - 1, 2) AS lifetime_gmv
FROM at_risk QUALIFY row_number() OVER (ORDER BY risk DESC, customer_unique_id) <= ceil(0.1 * count(*) OVER ())
"""


def _forecast() -> str:
    waves = [f"{f}(n * {2 * math.pi * k / period!r})" for period in (7.0, 365.25) for k in (1, 2) for f in ("sin", "cos")]
    x = ["1.0::DOUBLE", "(n - origin) / 365.25::DOUBLE", *waves, "CAST(is_holiday AS DOUBLE)"]
    k = len(x)
    names = (["constant", "trend"] + [f"{kind}_{f}_{i}" for kind in ("week", "year") for i in (1, 2) for f in ("sin", "cos")]
             + ["holiday"])
    xs = ", ".join(f"{e} AS x{i}" for i, e in enumerate(x))
    fit = f"(SELECT {cross(k, 'x{}', 'y')}, sum(y * y) AS yy, count(*) AS n FROM past)"
    left = "yy - 2 * (" + " + ".join(f"x_{i} * b_{i}" for i in range(k)) + ") + " + " + ".join(
        f"{1 if i == j else 2} * x_{i} * x_{j} * a_{i}_{j}" for i in range(k) for j in range(i, k))

    def solve_lower(rhs: list[str], source: str) -> str:
        """v with L v = rhs, so that the sum of its squares is rhs' a^-1 rhs."""
        for i in range(k):
            inner = " ".join(f"- l_{i}_{q} * v_{q}" for q in range(i))
            source = f"(SELECT *, ({rhs[i]} {inner}) / l_{i}_{i} AS v_{i} FROM {source})"
        return source

    squares = " + ".join(f"v_{i} * v_{i}" for i in range(k))
    model = f"""WITH span AS (SELECT min(order_date) AS lo, max(order_date) AS hi FROM daily),
holiday_days AS (SELECT DISTINCT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM holidays),
series AS MATERIALIZED (
  SELECT d AS order_date, coalesce(gmv, 0.0) AS y, CAST(date_diff('day', DATE '1970-01-01', d) AS DOUBLE) AS n,
         CAST(date_diff('day', DATE '1970-01-01', lo) AS DOUBLE) AS origin, d IN (SELECT d FROM holiday_days) AS is_holiday
  FROM (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d, lo FROM span)
  LEFT JOIN daily ON order_date = d),
past AS MATERIALIZED (SELECT y, {xs} FROM series WHERE order_date <= DATE '2000-06-30'),
line AS MATERIALIZED (SELECT *, sqrt(greatest(0.0, {left}) / (n - {k})) AS deviation FROM {solved(k, fit)})
"""
    rows = " UNION ALL ".join(
        f"SELECT '{names[i]}' AS feature, {i} AS place, x_{i} AS weight, deviation * sqrt({squares}) AS std_error, n AS day_count FROM "
        + solve_lower(["1.0::DOUBLE" if q == i else "0.0::DOUBLE" for q in range(k)], "line") for i in range(k))
    point = " + ".join(f"x{i} * x_{i}" for i in range(k))
    ordinary = " + ".join(f"x{i} * x_{i}" for i in range(k - 1))
    return f"""
-- @query holiday_forecast_model
{model}SELECT feature, CAST(place AS BIGINT) AS place, half_up(weight, 2) AS weight, half_up(std_error, 2) AS std_error,
       half_up(weight / std_error, 4) AS t_value, CAST(day_count AS BIGINT) AS day_count FROM ({rows})

-- @query holiday_forecast
{model}, targets AS (SELECT * FROM (VALUES ('Black Friday', 2000, DATE '2000-11-24', DATE '2000-11-24'), ('Carnival', 2001, DATE '2001-02-24', DATE '2001-02-27'),
    ('Christmas', 2000, DATE '2000-12-24', DATE '2000-12-25'), ('Christmas', 2001, DATE '2001-12-24', DATE '2001-12-25')) t(holiday_name, year, a, b)),
target_days AS (SELECT holiday_name, year, d, CAST(date_diff('day', DATE '1970-01-01', d) AS DOUBLE) AS n, true AS is_holiday,
    (SELECT any_value(origin) FROM series) AS origin
  FROM (SELECT holiday_name, year, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM targets)),
target_rows AS (SELECT holiday_name, year, d, {xs} FROM target_days),
forecast AS (SELECT holiday_name, year, d, {point} AS f, {ordinary} AS o, deviation * sqrt(1.0::DOUBLE + {squares}) AS s
  FROM {solve_lower([f"x{i}" for i in range(k)], "(SELECT * FROM target_rows, (SELECT * EXCLUDE (n) FROM line))")})
SELECT holiday_name, CAST(year AS BIGINT) AS year, d AS forecast_date, half_up(f, 2) AS forecast_gmv, half_up(o, 2) AS ordinary_gmv,
       half_up(greatest(0.0, f - 1.959963984540054 * s), 2) AS lower_gmv, half_up(f + 1.959963984540054 * s, 2) AS upper_gmv,
       half_up(y, 2) AS actual_gmv,
       CASE WHEN y IS NOT NULL THEN CAST(y BETWEEN greatest(0.0, f - 1.959963984540054 * s) AND f + 1.959963984540054 * s AS BIGINT) END AS is_inside
FROM forecast LEFT JOIN series ON order_date = d
"""


HUBER_SCALES, HUBER_ROUNDS = 3, 4


def _freight() -> str:
    k, xs = 3, ["x0", "x1", "x2"]
    off = lambda w: "abs(y - " + " - ".join(f"{w}_{i} * {x}" for i, x in enumerate(xs)) + ")"
    share = f"coalesce(least(1.0, 1.345::DOUBLE * scale / nullif({off('w')}, 0)), 1.0)"
    ctes = [f"""size_rows AS MATERIALIZED (
  SELECT seller_state AS g, CAST(freight_value AS DOUBLE) AS y, 1.0::DOUBLE AS x0, CAST(product_weight_g AS DOUBLE) / 1000 AS x1,
         CAST(product_length_cm AS DOUBLE) * product_height_cm * product_width_cm / 1000 AS x2
  FROM sold_items i JOIN m_sellers s ON s.seller_id = i.seller_id JOIN m_products p ON p.product_id = i.product_id
  SEMI JOIN (SELECT order_id FROM m_orders WHERE order_status = 'delivered') o ON o.order_id = i.order_id
  WHERE product_weight_g > 0 AND product_length_cm * product_height_cm * product_width_cm > 0)""",
            f"plain AS MATERIALIZED (SELECT g, n, x_0 AS p_0, x_1 AS p_1, x_2 AS p_2 FROM "
            + solved(k, f"(SELECT g, count(*) AS n, {cross(k, 'x{}', 'y')} FROM size_rows GROUP BY g HAVING count(*) >= 30)") + ")"]
    last, n = "(SELECT g, p_0 AS w_0, p_1 AS w_1, p_2 AS w_2 FROM plain)", 0
    for _ in range(HUBER_SCALES):
        ctes.append(f"w_{n} AS MATERIALIZED (SELECT g, 1.4826::DOUBLE * quantile_disc({off('w')}, 0.5) AS scale, any_value(w_0) AS w_0, "
                    f"any_value(w_1) AS w_1, any_value(w_2) AS w_2 FROM size_rows JOIN {last} USING (g) GROUP BY g)")
        for _ in range(HUBER_ROUNDS):
            sums = (f"(SELECT g, any_value(scale) AS scale, {cross(k, 'x{}', 'y * q', 'q')} FROM "
                    f"(SELECT *, {share} AS q FROM size_rows JOIN w_{n} USING (g)) GROUP BY g)")
            n += 1
            ctes.append(f"w_{n} AS MATERIALIZED (SELECT g, scale, x_0 AS w_0, x_1 AS w_1, x_2 AS w_2 FROM {solved(k, sums)})")
        last, n = f"w_{n}", n + 1
    cols = ", ".join(f"half_up(w_{i}, 6) AS {n}, half_up(p_{i}, 6) AS plain_{n}" for i, n in enumerate(("base", "per_kg", "per_litre")))
    return f"""
-- @query freight_by_size
WITH {", ".join(ctes)},
trimmed AS (SELECT g, count(*) FILTER ({share} < 1) AS t FROM size_rows JOIN {last} USING (g) GROUP BY g)
SELECT a.g AS seller_state, a.n AS item_count, half_up(scale, 6) AS scale, t AS trimmed_count, {cols}
FROM (SELECT g, count(*) AS n FROM size_rows GROUP BY g) a LEFT JOIN plain USING (g) LEFT JOIN {last} USING (g) LEFT JOIN trimmed USING (g)
"""


def text() -> str:
    return _regions() + _risk() + _forecast() + _freight()
