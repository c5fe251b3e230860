-- @query monthly_kpi
SELECT * REPLACE (CAST(gmv AS DOUBLE) AS gmv) FROM monthly

-- @layer daily
SELECT purchase_date AS order_date, CAST(sum(order_gmv) AS DOUBLE) AS gmv, count(*) AS order_count,
       half_up(CAST(sum(order_gmv) AS DOUBLE) / count(*), 2) AS average_order_value,
       count(DISTINCT customer_unique_id) FILTER (purchase_date = first_day) AS new_users,
       count(DISTINCT customer_unique_id) AS active_users_per_day
FROM (SELECT *, min(purchase_date) OVER (PARTITION BY customer_unique_id) AS first_day FROM cob WHERE is_paid_order = 1)
GROUP BY purchase_date

-- @query daily_kpi
SELECT * FROM daily

-- @layer kpi_selected
SELECT b.*, min(order_purchase_timestamp) OVER (PARTITION BY customer_unique_id) AS first_paid FROM cob b WHERE is_paid_order = 1

-- @layer kpi_slice
SELECT * FROM kpi_selected WHERE purchase_date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31'
  AND customer_state IN ('NATION_1', 'NATION_2', 'NATION_3')
  AND order_id IN (SELECT order_id FROM c_payments WHERE payment_type = 'voucher') AND order_gmv >= 100000

-- @query kpi_filtered
SELECT CAST(coalesce(sum(order_gmv), 0) AS DOUBLE) AS gmv, count(*) AS order_count,
       coalesce(CAST(sum(order_gmv) AS DOUBLE) / nullif(count(*), 0), 0) AS average_order_value,
       count(DISTINCT customer_unique_id) FILTER (order_purchase_timestamp = first_paid) AS new_users,
       count(DISTINCT customer_unique_id) AS active_users FROM kpi_slice

-- @query kpi_monthly_trend
SELECT c.month, CASE WHEN seen THEN CAST(coalesce(sum(order_gmv), 0) AS DOUBLE) END AS gmv,
       CASE WHEN seen THEN count(order_id) END AS order_count,
       CASE WHEN seen THEN count(DISTINCT customer_unique_id) FILTER (order_purchase_timestamp = first_paid) END AS new_users,
       CASE WHEN seen THEN count(DISTINCT customer_unique_id) END AS active_users,
       CAST(sum(order_gmv) AS DOUBLE) / nullif(count(order_id), 0) AS average_order_value
FROM (SELECT strftime(unnest(generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS month) c
LEFT JOIN (SELECT month, true AS seen FROM monthly) k ON k.month = c.month
LEFT JOIN kpi_slice s ON s.purchase_month = c.month GROUP BY c.month, seen

-- @layer holidays
SELECT * FROM (VALUES ('Black Friday', 1997, DATE '1997-11-28', DATE '1997-11-28'), ('Black Friday', 1999, DATE '1999-11-26', DATE '1999-11-26'),
    ('Carnival', 1995, DATE '1995-01-04', DATE '1995-01-07'), ('Carnival', 1998, DATE '1998-02-21', DATE '1998-02-24'),
    ('Christmas', 2000, DATE '2000-12-25', DATE '2000-12-25'), ('Christmas', 2001, DATE '2001-12-25', DATE '2001-12-25')) h(holiday_name, year, a, b)

-- @layer holiday_stats
SELECT holiday_name, year::BIGINT AS year, period_type, start_date, end_date, date_diff('day', start_date, end_date) + 1 AS expected,
       count(d.order_date) AS observed, coalesce(sum(CAST(d.gmv AS DECIMAL(28,2))), 0)::DOUBLE AS gmv, coalesce(sum(d.order_count), 0)::BIGINT AS orders
FROM (SELECT holiday_name, year, 'PRE' AS period_type, a - 7 AS start_date, a - 1 AS end_date FROM holidays UNION ALL
      SELECT holiday_name, year, 'DURING', a, b FROM holidays UNION ALL SELECT holiday_name, year, 'POST', b + 1, b + 7 FROM holidays)
LEFT JOIN daily d ON d.order_date BETWEEN start_date AND end_date GROUP BY ALL

-- @layer holiday_pairs
SELECT s.*, s.period_type <> 'PRE' AND s.observed = s.expected AND p.observed = p.expected AS formal,
       p.gmv AS pre_gmv, p.orders AS pre_orders, p.observed AS pre_observed
FROM holiday_stats s JOIN holiday_stats p ON p.holiday_name = s.holiday_name AND p.year = s.year AND p.period_type = 'PRE'

-- @layer holiday_table
SELECT holiday_name, year, period_type, start_date, end_date, expected AS expected_day_count, observed AS observed_day_count,
       half_up(observed / expected, 6) AS coverage_rate, gmv AS gmv_observed, orders AS order_count_observed,
       half_up(gmv / nullif(orders, 0), 2) AS average_order_value_observed, half_up(gmv / nullif(observed, 0), 2) AS daily_average_gmv_observed,
       half_up(orders / nullif(observed, 0), 6) AS daily_average_orders_observed,
       CASE WHEN formal THEN half_up(gmv / nullif(pre_gmv, 0) - 1, 6) END AS gmv_change_vs_pre,
       CASE WHEN formal THEN half_up(orders / nullif(pre_orders, 0) - 1, 6) END AS order_change_vs_pre,
       CASE WHEN formal THEN half_up((gmv / nullif(orders, 0)) / (pre_gmv / nullif(pre_orders, 0)) - 1, 6) END AS aov_change_vs_pre,
       CASE WHEN formal THEN half_up((gmv / observed) / (pre_gmv / pre_observed) - 1, 6) END AS daily_gmv_change_vs_pre,
       CASE WHEN formal THEN half_up((orders / observed) / (pre_orders / pre_observed) - 1, 6) END AS daily_orders_change_vs_pre,
       CASE WHEN period_type = 'PRE' THEN CASE WHEN observed = expected THEN 'Complete baseline' ELSE 'Incomplete baseline' END
            WHEN formal THEN 'Validated' ELSE 'Observed-only; formal comparison unavailable' END AS comparison_status,
       CASE WHEN observed = expected THEN 'Complete' WHEN observed = 0 THEN 'No observed dates'
            ELSE 'Partial coverage: ' || observed || '/' || expected || ' expected dates observed' END AS data_completeness_note
FROM holiday_pairs

-- @query holiday_windows
SELECT * FROM holiday_table

-- @query holiday_observed_change
SELECT t.holiday_name, t.year, t.period_type, k.metric, coalesce(k.formal, half_up(k.v / nullif(k.p, 0) - 1, 6)) AS change_vs_pre,
       CAST(k.formal IS NULL AND k.v / nullif(k.p, 0) IS NOT NULL AS BIGINT) AS is_observed_only
FROM holiday_table t JOIN holiday_table p ON p.holiday_name = t.holiday_name AND p.year = t.year AND p.period_type = 'PRE',
     LATERAL (VALUES ('daily_gmv', t.daily_gmv_change_vs_pre, t.daily_average_gmv_observed, p.daily_average_gmv_observed),
              ('daily_orders', t.daily_orders_change_vs_pre, t.daily_average_orders_observed, p.daily_average_orders_observed),
              ('average_order_value', t.aov_change_vs_pre, t.average_order_value_observed, p.average_order_value_observed)) k(metric, formal, v, p)
WHERE t.period_type <> 'PRE'

-- @query holiday_month_compare
SELECT month AS holiday_month, gmv::DOUBLE AS gmv, order_count, half_up(average_order_value, 2) AS average_order_value,
       half_up(g, 2) AS avg_gmv_other_months, half_up(o, 2) AS avg_order_count_other_months, half_up(v, 2) AS avg_aov_other_months
FROM monthly, (SELECT avg(gmv::DOUBLE) AS g, avg(order_count) AS o, avg(average_order_value) AS v FROM monthly
               WHERE month NOT IN ('1995-01', '2001-07', '1997-11', '1999-11', '2000-12'))
WHERE month IN ('1997-11', '1999-11', '2000-12')

-- @layer kpi_filled
SELECT c.month, k.gmv::DOUBLE AS gmv, order_count::DOUBLE AS order_count, average_order_value, new_users::DOUBLE AS new_users, active_users::DOUBLE AS active_users
FROM month_calendar c LEFT JOIN monthly k ON k.month = c.month

-- @layer growth_long
SELECT month, metric, value, lag(value) OVER w AS prev, lag(value, 12) OVER w AS prev_year
FROM kpi_filled UNPIVOT INCLUDE NULLS (value FOR metric IN (gmv, order_count, average_order_value, new_users, active_users))
WINDOW w AS (PARTITION BY metric ORDER BY month)

-- @layer growth_rates
SELECT month, replace(metric, 'average_order_value', 'aov') AS metric, half_up((value - prev) / nullif(prev, 0), 4) AS mom,
       half_up((value - prev_year) / nullif(prev_year, 0), 4) AS yoy FROM growth_long

-- @layer growth_wide
SELECT month, max(mom) FILTER (metric = 'gmv') AS gmv_mom, max(yoy) FILTER (metric = 'gmv') AS gmv_yoy,
       max(mom) FILTER (metric = 'order_count') AS order_count_mom, max(yoy) FILTER (metric = 'order_count') AS order_count_yoy,
       max(mom) FILTER (metric = 'aov') AS aov_mom, max(yoy) FILTER (metric = 'aov') AS aov_yoy,
       max(mom) FILTER (metric = 'new_users') AS new_users_mom, max(yoy) FILTER (metric = 'new_users') AS new_users_yoy,
       max(mom) FILTER (metric = 'active_users') AS active_users_mom, max(yoy) FILTER (metric = 'active_users') AS active_users_yoy
FROM growth_rates GROUP BY month

-- @query growth_mom_yoy
SELECT * FROM growth_wide

-- @layer observed_growth
SELECT *, (gmv::DOUBLE - lag(gmv::DOUBLE) OVER w) / nullif(lag(gmv::DOUBLE) OVER w, 0) AS mom,
       gmv > lag(gmv) OVER w AS up_g, order_count > lag(order_count) OVER w AS up_o,
       average_order_value > lag(average_order_value) OVER w AS up_a
FROM monthly WINDOW w AS (ORDER BY month)

-- @query growth_driver
SELECT month, CASE WHEN up_g THEN 'growth' END AS gmv_growth_flag,
       CASE WHEN up_g THEN CASE WHEN up_o AND up_a THEN 'Both' WHEN up_o THEN 'Order volume driven'
            WHEN up_a THEN 'AOV driven' ELSE 'Mixed' END END AS growth_driver FROM observed_growth

-- @query growth_extremes
SELECT month, half_up(mom, 4) AS gmv_mom_rate,
       CASE WHEN mom = hi THEN 'Fastest growth; ' ELSE '' END || CASE WHEN mom = lo THEN 'Largest decline; ' ELSE '' END
       || CASE WHEN abs(mom - mu) > 2 * sd THEN 'Abnormal volatility; ' WHEN mom NOT IN (hi, lo) THEN 'Normal' ELSE '' END AS label
FROM observed_growth, (SELECT max(mom) AS hi, min(mom) AS lo, avg(mom) AS mu, stddev_pop(mom) AS sd FROM observed_growth) WHERE mom IS NOT NULL

-- @query growth_anomaly_iqr
SELECT month, change AS gmv_mom_change, order_count AS monthly_order_count,
       concat_ws(', ', CASE WHEN few THEN 'order_count_too_low' END, CASE WHEN high THEN 'extreme_increase' WHEN low THEN 'extreme_decrease' END) AS diagnosis
FROM (SELECT *, order_count < o1 - 1.5 * (o3 - o1) AS few, change > g3 + 1.5 * (g3 - g1) AS high, change < g1 - 1.5 * (g3 - g1) AS low
      FROM (SELECT month, order_count, half_up(mom, 4) AS change FROM observed_growth),
           (SELECT quantile_disc(order_count, 0.25) AS o1, quantile_disc(order_count, 0.75) AS o3,
                   quantile_disc(half_up(mom, 4), 0.25) AS g1, quantile_disc(half_up(mom, 4), 0.75) AS g3 FROM observed_growth))
WHERE few OR high OR low

-- @query growth_stability
SELECT half_up(stddev_pop(mom), 4) AS growth_rate_std FROM observed_growth WHERE order_count >= 30 AND mom BETWEEN -5 AND 5

-- @layer trend_long
SELECT month, metric, value, edge, prior, gap, NOT edge AND NOT gap AND NOT coalesce(lag(edge) OVER w, true) AS fit,
       (value / nullif(lag(value) OVER w, 0) - 1) * 100 AS pct
FROM (SELECT month, metric, value, month IN ('1995-01', '2001-07') AS edge, lag(month) OVER w AS prior,
             coalesce(date_diff('month', CAST(lag(month) OVER w || '-01' AS DATE), CAST(month || '-01' AS DATE)) <> 1, false) AS gap
      FROM growth_long WHERE value IS NOT NULL WINDOW w AS (PARTITION BY metric ORDER BY month))
WINDOW w AS (PARTITION BY metric ORDER BY month)

-- @layer trend_flags
SELECT t.*, lo, hi, coalesce(fit AND (pct < lo OR pct > hi), false) AS odd
FROM trend_long t JOIN (
    SELECT metric, q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi
    FROM (SELECT metric, quantile_cont(pct, [0.25, 0.75]) AS q FROM trend_long WHERE fit GROUP BY metric)) b ON b.metric = t.metric

-- @layer trend_wide
SELECT month, any_value(edge) AS is_boundary_month, any_value(prior) AS previous_observed_month, any_value(gap) AS data_gap_before, any_value(fit) AS mom_eligible,
       max(value) FILTER (metric = 'gmv') AS gmv, CAST(max(value) FILTER (metric = 'order_count') AS BIGINT) AS order_count,
       max(value) FILTER (metric = 'average_order_value') AS average_order_value,
       CAST(max(value) FILTER (metric = 'new_users') AS BIGINT) AS new_users, CAST(max(value) FILTER (metric = 'active_users') AS BIGINT) AS active_users,
       half_up(max(pct) FILTER (metric = 'gmv'), 6) AS gmv_mom_pct, half_up(max(pct) FILTER (metric = 'order_count'), 6) AS order_count_mom_pct,
       half_up(max(pct) FILTER (metric = 'average_order_value'), 6) AS average_order_value_mom_pct,
       half_up(max(pct) FILTER (metric = 'new_users'), 6) AS new_users_mom_pct, half_up(max(pct) FILTER (metric = 'active_users'), 6) AS active_users_mom_pct,
       half_up(max(lo) FILTER (metric = 'gmv'), 6) AS gmv_iqr_lower_pct, half_up(max(hi) FILTER (metric = 'gmv'), 6) AS gmv_iqr_upper_pct,
       half_up(max(lo) FILTER (metric = 'order_count'), 6) AS order_count_iqr_lower_pct, half_up(max(hi) FILTER (metric = 'order_count'), 6) AS order_count_iqr_upper_pct,
       half_up(max(lo) FILTER (metric = 'average_order_value'), 6) AS average_order_value_iqr_lower_pct, half_up(max(hi) FILTER (metric = 'average_order_value'), 6) AS average_order_value_iqr_upper_pct,
       half_up(max(lo) FILTER (metric = 'new_users'), 6) AS new_users_iqr_lower_pct, half_up(max(hi) FILTER (metric = 'new_users'), 6) AS new_users_iqr_upper_pct,
       half_up(max(lo) FILTER (metric = 'active_users'), 6) AS active_users_iqr_lower_pct, half_up(max(hi) FILTER (metric = 'active_users'), 6) AS active_users_iqr_upper_pct,
       bool_or(odd) FILTER (metric = 'gmv') AS gmv_anomaly, bool_or(odd) FILTER (metric = 'order_count') AS order_count_anomaly,
       bool_or(odd) FILTER (metric = 'average_order_value') AS average_order_value_anomaly,
       bool_or(odd) FILTER (metric = 'new_users') AS new_users_anomaly, bool_or(odd) FILTER (metric = 'active_users') AS active_users_anomaly
FROM trend_flags GROUP BY month

-- @query trend_diagnostics
SELECT *, concat_ws(';', CASE WHEN gmv_anomaly THEN 'gmv' END, CASE WHEN order_count_anomaly THEN 'order_count' END,
         CASE WHEN average_order_value_anomaly THEN 'average_order_value' END, CASE WHEN new_users_anomaly THEN 'new_users' END,
         CASE WHEN active_users_anomaly THEN 'active_users' END) AS anomaly_metrics,
       CAST(gmv_anomaly::INT + order_count_anomaly::INT + average_order_value_anomaly::INT + new_users_anomaly::INT + active_users_anomaly::INT AS BIGINT) AS anomaly_count,
       CASE WHEN NOT (gmv_anomaly OR order_count_anomaly OR average_order_value_anomaly OR new_users_anomaly OR active_users_anomaly) THEN ''
            WHEN NOT gmv_anomaly THEN 'gmv_within_fences'
            WHEN average_order_value_anomaly AND sign(order_count_mom_pct) = sign(average_order_value_mom_pct) THEN 'orders_and_aov_both_anomalous'
            WHEN abs(order_count_mom_pct) > abs(average_order_value_mom_pct) * 2 THEN 'mainly_orders'
            WHEN sign(order_count_mom_pct) = sign(average_order_value_mom_pct) THEN 'orders_and_aov_same_direction'
            ELSE 'opposite_directions' END AS driver
FROM trend_wide

-- @query peak_trough
SELECT metric, arg_max(month, (value, -i)) AS peak_month, max(value) AS peak_value, arg_min(month, (value, i)) AS trough_month, min(value) AS trough_value
FROM (SELECT *, date_diff('month', DATE '1900-01-01', CAST(month || '-01' AS DATE)) AS i FROM growth_long)
WHERE value IS NOT NULL AND month NOT IN ('1995-01', '2001-07') GROUP BY metric

-- @query month_gap_audit
SELECT count(gmv) AS row_count, min(month) AS start_month, max(month) AS end_month, count(*) FILTER (gmv IS NULL) AS missing_month_count,
       coalesce(string_agg(month, ',' ORDER BY month) FILTER (gmv IS NULL), '') AS missing_months, 0::BIGINT AS duplicate_months,
       0::BIGINT AS null_gmv, 0::BIGINT AS null_order_count, 0::BIGINT AS null_average_order_value, 0::BIGINT AS null_new_users, 0::BIGINT AS null_active_users
FROM kpi_filled

-- @query mom_outlier_trim
SELECT month, max(v) FILTER (metric = 'gmv') AS gmv_mom, max(v) FILTER (metric = 'order_count') AS order_count_mom, max(v) FILTER (metric = 'aov') AS aov_mom,
       max(v) FILTER (metric = 'new_users') AS new_users_mom, max(v) FILTER (metric = 'active_users') AS active_users_mom
FROM (SELECT month, metric, CASE WHEN mom BETWEEN q[1] - 1.5 * (q[2] - q[1]) AND q[2] + 1.5 * (q[2] - q[1]) THEN mom END AS v
      FROM (SELECT *, quantile_cont(mom, [0.25, 0.75]) OVER (PARTITION BY metric) AS q FROM growth_rates)) GROUP BY month

-- @query growth_status
SELECT month, metric, comparison, rate AS growth_rate,
       strftime(CAST(month || '-01' AS DATE) - CASE comparison WHEN 'mom' THEN INTERVAL 1 MONTH ELSE INTERVAL 12 MONTH END, '%Y-%m') AS comparison_base_month,
       base AS comparison_base_value, low AS is_low_base, edge AS is_coverage_boundary, low OR edge AS is_interpretation_flag,
       CASE WHEN rate IS NULL THEN 'No comparable period' WHEN low AND edge THEN 'Low comparison base + Coverage-boundary month'
            WHEN low THEN 'Low comparison base' WHEN edge THEN 'Coverage-boundary month' ELSE 'Comparable' END AS status,
       rate * 100 AS growth_pct
FROM (SELECT *, rate IS NOT NULL AND (base IS NULL OR base <= 0 OR base <= cutoff) AS low
      FROM (SELECT month, metric, comparison, base, half_up((value - base) / nullif(base, 0), 4) AS rate, cutoff,
                   month IN ((SELECT min(month) FROM monthly), (SELECT max(month) FROM monthly)) AS edge
            FROM (SELECT month, metric, value, 'mom' AS comparison, prev AS base FROM growth_long UNION ALL
                  SELECT month, metric, value, 'yoy', prev_year FROM growth_long)
            JOIN (SELECT metric, quantile_cont(value, 0.1) AS cutoff FROM growth_long WHERE value > 0 GROUP BY metric) USING (metric)))

-- @query growth_decomposition
SELECT month, k AS comparison, g AS reported_gmv_growth, o AS order_effect, a AS aov_effect, half_up(o * a, 8) AS interaction_effect,
       half_up(o + a + o * a, 8) AS reconstructed_gmv_growth, half_up(g - (o + a + o * a), 8) AS reconstruction_difference
FROM (SELECT month, 'mom' AS k, gmv_mom AS g, order_count_mom AS o, aov_mom AS a FROM growth_wide UNION ALL
      SELECT month, 'yoy', gmv_yoy, order_count_yoy, aov_yoy FROM growth_wide)

-- @layer regime_series
SELECT customer_state, purchase_month AS month, CAST(sum(order_gmv) AS DOUBLE) AS gmv, count(*) AS order_count,
       count(DISTINCT customer_unique_id) FILTER (purchase_month = f) AS new_users, count(DISTINCT customer_unique_id) AS active_users
FROM (SELECT *, min(purchase_month) OVER (PARTITION BY customer_state, customer_unique_id) AS f FROM cob WHERE is_paid_order = 1)
GROUP BY ALL

-- @layer regime_z
SELECT customer_state, month, metric, i, n, (l - avg(l) OVER w) / nullif(stddev_pop(l) OVER w, 0) AS z
FROM (SELECT customer_state, month, metric, ln(1 + v) AS l, row_number() OVER (PARTITION BY customer_state, metric ORDER BY month) AS i,
             count(*) OVER (PARTITION BY customer_state, metric) AS n
      FROM (UNPIVOT (SELECT customer_state, month, gmv, order_count::DOUBLE AS order_count, new_users::DOUBLE AS new_users,
                     active_users::DOUBLE AS active_users FROM regime_series WHERE month NOT IN ('1995-01', '2001-07'))
            ON gmv, order_count, new_users, active_users INTO NAME metric VALUE v))
WINDOW w AS (PARTITION BY customer_state, metric)

-- @layer regime_prefix
SELECT customer_state, metric, n, i, sum(z) OVER w AS s, sum(z * z) OVER w AS q FROM regime_z
WINDOW w AS (PARTITION BY customer_state, metric ORDER BY i)
UNION ALL SELECT DISTINCT customer_state, metric, n, 0, 0, 0 FROM regime_z

-- @layer regime_cost
SELECT a.customer_state, a.n, a.i AS b, e.i AS e, sum(e.q - a.q - (e.s - a.s) * (e.s - a.s) / (e.i - a.i)) AS c
FROM regime_prefix a JOIN regime_prefix e ON e.customer_state = a.customer_state AND e.metric = a.metric AND e.i - a.i >= 3
GROUP BY ALL

-- @layer regime_1
SELECT customer_state, n, e, c AS sse, [e] AS ends FROM regime_cost WHERE b = 0

-- @layer regime_2
SELECT r.customer_state, r.n, k.e, min(sse + c) AS sse, arg_min(list_append(ends, k.e), sse + c) AS ends
FROM regime_1 r JOIN regime_cost k ON k.customer_state = r.customer_state AND k.b = r.e GROUP BY ALL

-- @layer regime_3
SELECT r.customer_state, r.n, k.e, min(sse + c) AS sse, arg_min(list_append(ends, k.e), sse + c) AS ends
FROM regime_2 r JOIN regime_cost k ON k.customer_state = r.customer_state AND k.b = r.e GROUP BY ALL

-- @layer regime_4
SELECT r.customer_state, r.n, k.e, min(sse + c) AS sse, arg_min(list_append(ends, k.e), sse + c) AS ends
FROM regime_3 r JOIN regime_cost k ON k.customer_state = r.customer_state AND k.b = r.e GROUP BY ALL

-- @layer regime_best
SELECT customer_state, arg_min(k, bic) AS stages, arg_min(ends, bic) AS ends, min(bic) AS bic
FROM (SELECT *, n * 4 * ln(greatest(sse, 2.220446049250313e-16) / (n * 4)) + (k * 4 + k - 1) * ln(n) AS bic
      FROM (SELECT *, 1 AS k FROM regime_1 UNION ALL SELECT *, 2 FROM regime_2 UNION ALL SELECT *, 3 FROM regime_3 UNION ALL SELECT *, 4 FROM regime_4)
      WHERE e = n) GROUP BY customer_state

-- @query regime_segmentation
SELECT customer_state, stages::BIGINT AS stage_count, stage, min(month) AS start_month, max(month) AS end_month, count(*) AS observed_months,
       half_up(CAST(sum(CAST(gmv AS DECIMAL(28,2))) AS DOUBLE) / count(*), 4) AS gmv_average, half_up(avg(order_count), 4) AS order_count_average, half_up(avg(new_users), 4) AS new_users_average,
       half_up(avg(active_users), 4) AS active_users_average,
       half_up((arg_max(gmv, month) / nullif(arg_min(gmv, month), 0) - 1) * 100, 4) AS gmv_start_end_pct,
       half_up((arg_max(order_count, month) / nullif(arg_min(order_count, month), 0) - 1) * 100, 4) AS order_count_start_end_pct,
       half_up((arg_max(new_users, month) / nullif(arg_min(new_users, month), 0) - 1) * 100, 4) AS new_users_start_end_pct,
       half_up((arg_max(active_users, month) / nullif(arg_min(active_users, month), 0) - 1) * 100, 4) AS active_users_start_end_pct,
       half_up(any_value(bic), 4) AS bic
FROM (SELECT customer_state, stages, bic, ends, generate_subscripts(ends, 1) AS stage FROM regime_best)
JOIN (SELECT *, row_number() OVER (PARTITION BY customer_state ORDER BY month) AS i FROM regime_series WHERE month NOT IN ('1995-01', '2001-07')) s
     USING (customer_state)
WHERE i <= ends[stage] AND i > CASE WHEN stage = 1 THEN 0 ELSE ends[stage - 1] END
GROUP BY customer_state, stages, stage
