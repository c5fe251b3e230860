-- Attribution of holiday sales; the forecast itself is written out in fits.py.

-- @layer holiday_phases
SELECT holiday_name, CAST(year AS BIGINT) AS year, phase, date_diff('day', x, z) + 1 AS days,
       CAST(unnest(generate_series(CAST(x AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d
FROM (SELECT holiday_name, year, 0 AS phase, a - 28 AS x, a - 1 AS z FROM holidays
      UNION ALL SELECT holiday_name, year, 1, a, b + 6 FROM holidays)

-- @query holiday_by_category
WITH sold AS (
  SELECT category_name AS g, CAST(purchase_timestamp AS DATE) AS d, CAST(sum(price) AS DOUBLE) AS y FROM citems GROUP BY ALL),
grid AS (  -- every day of a holiday for every group that sold in it
  SELECT p.holiday_name, p.year, p.phase, p.days, p.d, k.g, coalesce(s.y, 0.0) AS y
  FROM (SELECT DISTINCT holiday_name, year, g FROM holiday_phases JOIN sold USING (d)) k
  JOIN holiday_phases p USING (holiday_name, year) LEFT JOIN sold s ON s.d = p.d AND s.g = k.g),
tot AS (SELECT *, sum(y) OVER (PARTITION BY holiday_name, year, d) AS t FROM grid),
base AS (SELECT *, sum(y) FILTER (phase = 0) OVER w / nullif(sum(t - y) FILTER (phase = 0) OVER w, 0) AS k FROM tot
         WINDOW w AS (PARTITION BY holiday_name, year, g)),
sums AS (SELECT holiday_name, year, g, max(days) FILTER (phase = 0) AS n0, max(days) FILTER (phase = 1) AS n1,
         avg(y) FILTER (phase = 0) AS y0, avg(y) FILTER (phase = 1) AS y1, avg(k * (t - y)) FILTER (phase = 1) AS e1,
         sqrt(var_samp(y - k * (t - y)) FILTER (phase = 0) / max(days) FILTER (phase = 0)
              + var_samp(y - k * (t - y)) FILTER (phase = 1) / max(days) FILTER (phase = 1)) AS se
         FROM base GROUP BY ALL)
SELECT holiday_name, year, g AS category_name, CAST(n0 AS BIGINT) AS baseline_days, CAST(n1 AS BIGINT) AS window_days,
       half_up(y0, 2) AS baseline_daily, half_up(y1, 2) AS window_daily, half_up(e1, 2) AS expected_daily,
       half_up(y1 - e1, 2) AS effect_daily, half_up(se, 2) AS std_error, half_up((y1 - e1) / nullif(se, 0), 4) AS t_value,
       half_up((y1 - e1) * n1, 2) AS effect_total, half_up((y1 - e1) / nullif(e1, 0), 6) AS lift
FROM sums

-- @query holiday_by_user_tier
WITH paid_days AS (SELECT customer_unique_id, purchase_date AS d, sum(order_gmv) AS amount FROM cob WHERE is_paid_order = 1 GROUP BY ALL),
starts AS (SELECT holiday_name, year, min(d) AS s FROM holiday_phases GROUP BY ALL),
earlier AS (SELECT holiday_name, year, customer_unique_id, sum(amount) AS spent FROM paid_days, starts WHERE d < s GROUP BY ALL),
sold AS (
  SELECT p.holiday_name, p.year, p.d, CAST(sum(amount) AS DOUBLE) AS y,
         CASE WHEN spent IS NULL THEN 'new' WHEN spent < 500000 THEN 'low' WHEN spent < 1500000 THEN 'middle' ELSE 'high' END AS g
  FROM holiday_phases p JOIN paid_days x ON x.d = p.d
  LEFT JOIN earlier e ON e.holiday_name = p.holiday_name AND e.year = p.year AND e.customer_unique_id = x.customer_unique_id
  GROUP BY ALL),
grid AS (
  SELECT p.holiday_name, p.year, p.phase, p.days, p.d, k.g, coalesce(s.y, 0.0) AS y
  FROM (SELECT DISTINCT holiday_name, year, g FROM sold) k JOIN holiday_phases p USING (holiday_name, year)
  LEFT JOIN sold s ON s.holiday_name = p.holiday_name AND s.year = p.year AND s.d = p.d AND s.g = k.g),
tot AS (SELECT *, sum(y) OVER (PARTITION BY holiday_name, year, d) AS t FROM grid),
base AS (SELECT *, sum(y) FILTER (phase = 0) OVER w / nullif(sum(t - y) FILTER (phase = 0) OVER w, 0) AS k FROM tot
         WINDOW w AS (PARTITION BY holiday_name, year, g)),
sums AS (SELECT holiday_name, year, g, max(days) FILTER (phase = 0) AS n0, max(days) FILTER (phase = 1) AS n1,
         avg(y) FILTER (phase = 0) AS y0, avg(y) FILTER (phase = 1) AS y1, avg(k * (t - y)) FILTER (phase = 1) AS e1,
         sqrt(var_samp(y - k * (t - y)) FILTER (phase = 0) / max(days) FILTER (phase = 0)
              + var_samp(y - k * (t - y)) FILTER (phase = 1) / max(days) FILTER (phase = 1)) AS se
         FROM base GROUP BY ALL)
SELECT holiday_name, year, g AS user_tier, CAST(n0 AS BIGINT) AS baseline_days, CAST(n1 AS BIGINT) AS window_days,
       half_up(y0, 2) AS baseline_daily, half_up(y1, 2) AS window_daily, half_up(e1, 2) AS expected_daily,
       half_up(y1 - e1, 2) AS effect_daily, half_up(se, 2) AS std_error, half_up((y1 - e1) / nullif(se, 0), 4) AS t_value,
       half_up((y1 - e1) * n1, 2) AS effect_total, half_up((y1 - e1) / nullif(e1, 0), 6) AS lift
FROM sums
