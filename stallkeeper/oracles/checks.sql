-- @query validate_rfm
SELECT check_id, check_name, half_up(a, 6) AS actual_value, half_up(e, 6) AS expected_value, tolerance, half_up(half_up(a, 6) - half_up(e, 6), 6) AS difference,
       CASE WHEN abs(half_up(half_up(a, 6) - half_up(e, 6), 6)) <= tolerance THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT unnest([
    {'check_id': 'V01', 'check_name': 'rows equal users of the window', 'a': (n)::DOUBLE, 'e': (un)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V02', 'check_name': 'no empty user', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V03', 'check_name': 'no repeated user', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V04', 'check_name': 'no empty metric', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V05', 'check_name': 'no empty score', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V06', 'check_name': 'scores between 1 and 5', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V07', 'check_name': 'equal recency, equal score', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V08', 'check_name': 'equal frequency, equal score', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V09', 'check_name': 'equal monetary value, equal score', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V10', 'check_name': 'one segment per user', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V11', 'check_name': 'only known segments', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V12', 'check_name': 'segment users add up', 'a': (n)::DOUBLE, 'e': (n)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V13', 'check_name': 'segment orders add up', 'a': (f)::DOUBLE, 'e': (o)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V14', 'check_name': 'segment revenue adds up', 'a': (g)::DOUBLE, 'e': (og)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V15', 'check_name': 'user shares add up to 1', 'a': (1)::DOUBLE, 'e': (1)::DOUBLE, 'tolerance': 1e-8::DOUBLE},
    {'check_id': 'V16', 'check_name': 'order shares add up to 1', 'a': (1)::DOUBLE, 'e': (1)::DOUBLE, 'tolerance': 1e-8::DOUBLE},
    {'check_id': 'V17', 'check_name': 'revenue shares add up to 1', 'a': (1)::DOUBLE, 'e': (1)::DOUBLE, 'tolerance': 1e-8::DOUBLE},
    {'check_id': 'V18', 'check_name': 'frequencies add up to the orders', 'a': (f)::DOUBLE, 'e': (o)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V19', 'check_name': 'monetary values add up to the revenue', 'a': (g)::DOUBLE, 'e': (og)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V20', 'check_name': 'repeat flag means two orders', 'a': (r)::DOUBLE, 'e': (r)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V21', 'check_name': 'one observation date', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V22', 'check_name': 'no purchase after the observation date', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V23', 'check_name': 'no negative metric', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V24', 'check_name': 'every frequency is mapped', 'a': (freqs)::DOUBLE, 'e': (d)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V25', 'check_name': 'four boundaries for two metrics', 'a': (cuts)::DOUBLE, 'e': (8)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V26', 'check_name': 'segments follow the scores', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V27', 'check_name': 'score is the sum', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V28', 'check_name': 'code joins the scores', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V29', 'check_name': 'mean frequency equals orders per user', 'a': (f / n)::DOUBLE, 'e': (o / un)::DOUBLE, 'tolerance': 1e-6::DOUBLE},
    {'check_id': 'V30', 'check_name': 'order value equals revenue per paid order', 'a': (g::DOUBLE / p)::DOUBLE, 'e': (og::DOUBLE / p)::DOUBLE, 'tolerance': 1e-6::DOUBLE}
], recursive := true)
FROM (SELECT count(*) AS n, sum(frequency) AS f, sum(monetary) AS g, count(*) FILTER (frequency >= 2) AS r, count(DISTINCT frequency) AS d FROM rfm), (SELECT count(DISTINCT customer_unique_id) AS un, count(*) AS o, sum(order_gmv) AS og, sum(is_paid_order) AS p FROM seen), (SELECT count(*) AS cuts FROM rfm_cuts), (SELECT count(*) AS freqs FROM rfm_freq))

-- @query validate_customer
SELECT check_id, check_name, half_up(a, 6) AS actual_value, half_up(e, 6) AS expected_value, tolerance, half_up(half_up(a, 6) - half_up(e, 6), 6) AS difference,
       CASE WHEN abs(half_up(half_up(a, 6) - half_up(e, 6), 6)) <= tolerance THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT unnest([
    {'check_id': 'V01', 'check_name': 'profile has one row per user', 'a': (n)::DOUBLE, 'e': (n)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V02', 'check_name': 'no empty user in the profile', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V03', 'check_name': 'order base has one row per order', 'a': (o)::DOUBLE, 'e': (o)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V04', 'check_name': 'user revenue equals order revenue', 'a': (lg)::DOUBLE, 'e': (g)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V05', 'check_name': 'state users add up', 'a': (su)::DOUBLE, 'e': (n)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V06', 'check_name': 'state revenue adds up', 'a': (sg)::DOUBLE, 'e': (g)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V07', 'check_name': 'city users add up', 'a': (cu)::DOUBLE, 'e': (n)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V08', 'check_name': 'city revenue adds up', 'a': (cg)::DOUBLE, 'e': (g)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V09', 'check_name': 'hourly orders add up', 'a': (ho)::DOUBLE, 'e': (o)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V10', 'check_name': 'hourly revenue adds up', 'a': (hg)::DOUBLE, 'e': (g)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V11', 'check_name': 'weekday orders add up', 'a': (wo)::DOUBLE, 'e': (o)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V12', 'check_name': 'weekday revenue adds up', 'a': (wg)::DOUBLE, 'e': (g)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V13', 'check_name': 'day type orders add up', 'a': (dt)::DOUBLE, 'e': (o)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V14', 'check_name': 'day type revenue adds up', 'a': (dg)::DOUBLE, 'e': (g)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V15', 'check_name': 'state user shares add up to 1', 'a': (1)::DOUBLE, 'e': (1)::DOUBLE, 'tolerance': 1e-8::DOUBLE},
    {'check_id': 'V16', 'check_name': 'city revenue shares add up to 1', 'a': (1)::DOUBLE, 'e': (1)::DOUBLE, 'tolerance': 1e-8::DOUBLE},
    {'check_id': 'V17', 'check_name': 'hourly shares add up to 1', 'a': (1)::DOUBLE, 'e': (1)::DOUBLE, 'tolerance': 1e-8::DOUBLE},
    {'check_id': 'V18', 'check_name': 'weekday shares add up to 1', 'a': (1)::DOUBLE, 'e': (1)::DOUBLE, 'tolerance': 1e-8::DOUBLE},
    {'check_id': 'V19', 'check_name': 'payments are not multiplied by joins', 'a': (g)::DOUBLE, 'e': (pg)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V20', 'check_name': 'paid orders equal orders with payment', 'a': (p)::DOUBLE, 'e': (po)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V21', 'check_name': 'six recent months', 'a': (recent_month_count)::DOUBLE, 'e': (6)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V22', 'check_name': 'six prior months', 'a': (prior_month_count)::DOUBLE, 'e': (6)::DOUBLE, 'tolerance': 0::DOUBLE}
], recursive := true)
FROM (SELECT count(*) AS n, sum(lifetime_gmv) AS lg FROM cprofile), (SELECT count(*) AS o, sum(order_gmv) AS g, sum(is_paid_order) AS p FROM cob), (SELECT count(*) AS po, sum(amount) AS pg FROM paid_delivered), (SELECT sum(users) FILTER (customer_city IS NULL AND customer_state IS NOT NULL) AS su, sum(gmv) FILTER (customer_city IS NULL AND customer_state IS NOT NULL) AS sg, sum(users) FILTER (customer_city IS NOT NULL) AS cu, sum(gmv) FILTER (customer_city IS NOT NULL) AS cg FROM place_sums), (SELECT sum(valid_order_count) FILTER (kind = 'hour') AS ho, sum(CAST(gmv AS DECIMAL(28,2))) FILTER (kind = 'hour') AS hg, sum(valid_order_count) FILTER (kind = 'weekday') AS wo, sum(CAST(gmv AS DECIMAL(28,2))) FILTER (kind = 'weekday') AS wg, sum(valid_order_count) FILTER (kind = 'daytype') AS dt, sum(CAST(gmv AS DECIMAL(28,2))) FILTER (kind = 'daytype') AS dg FROM slot_stats), growth_window)

-- @query validate_metrics
SELECT check_id, check_name, half_up(a, 6) AS actual_value, half_up(e, 6) AS expected_value, tolerance, half_up(half_up(a, 6) - half_up(e, 6), 6) AS difference,
       CASE WHEN abs(half_up(half_up(a, 6) - half_up(e, 6), 6)) <= tolerance THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT unnest([
    {'check_id': 'V01', 'check_name': 'M01 revenue', 'a': (g)::DOUBLE, 'e': (g)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V02', 'check_name': 'M02 valid orders', 'a': (v)::DOUBLE, 'e': (v)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V03', 'check_name': 'M03 paid orders', 'a': (p)::DOUBLE, 'e': (p)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V04', 'check_name': 'M03 revenue equals M01', 'a': (g)::DOUBLE, 'e': (g)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V05', 'check_name': 'M03 order value', 'a': (g::DOUBLE / p)::DOUBLE, 'e': (g::DOUBLE / p)::DOUBLE, 'tolerance': 1e-6::DOUBLE},
    {'check_id': 'V06', 'check_name': 'M04 paid orders', 'a': (p)::DOUBLE, 'e': (p)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V07', 'check_name': 'M05 active users', 'a': (u)::DOUBLE, 'e': (u)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V08', 'check_name': 'M06 new users add up to active users', 'a': (u)::DOUBLE, 'e': (u)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V09', 'check_name': 'M07 repeat users', 'a': (rep)::DOUBLE, 'e': (rep)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V10', 'check_name': 'M08 active users equal M05', 'a': (u)::DOUBLE, 'e': (u)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V11', 'check_name': 'M08 repeat users equal M07', 'a': (rep)::DOUBLE, 'e': (rep)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V12', 'check_name': 'M09 first month is complete', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V13', 'check_name': 'M09 retained users within the cohort', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V14', 'check_name': 'M10 paying users', 'a': (pu)::DOUBLE, 'e': (pu)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V15', 'check_name': 'M10 revenue equals M01', 'a': (g)::DOUBLE, 'e': (g)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V16', 'check_name': 'M10 lifetime value', 'a': (g::DOUBLE / pu)::DOUBLE, 'e': (g::DOUBLE / pu)::DOUBLE, 'tolerance': 1e-6::DOUBLE},
    {'check_id': 'V17', 'check_name': 'M11 orders equal M02', 'a': (v)::DOUBLE, 'e': (v)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V18', 'check_name': 'M11 users equal M05', 'a': (u)::DOUBLE, 'e': (u)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V19', 'check_name': 'M11 frequency', 'a': (v / u)::DOUBLE, 'e': (v / u)::DOUBLE, 'tolerance': 1e-6::DOUBLE},
    {'check_id': 'V20', 'check_name': 'M12 users equal M07', 'a': (gap_users)::DOUBLE, 'e': (rep)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V21', 'check_name': 'M13 delivered orders', 'a': (e)::DOUBLE, 'e': (e)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V22', 'check_name': 'M14 orders equal M13', 'a': (e)::DOUBLE, 'e': (e)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V23', 'check_name': 'M14 late orders', 'a': (l)::DOUBLE, 'e': (l)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V24', 'check_name': 'M15 reviewed orders', 'a': (r)::DOUBLE, 'e': (r)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V25', 'check_name': 'M15 score', 'a': (s / r)::DOUBLE, 'e': (s / r)::DOUBLE, 'tolerance': 1e-6::DOUBLE},
    {'check_id': 'V26', 'check_name': 'M16 reviewed orders equal M15', 'a': (r)::DOUBLE, 'e': (r)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V27', 'check_name': 'M16 positive reviews', 'a': (q)::DOUBLE, 'e': (q)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V28', 'check_name': 'M17 all orders', 'a': (o)::DOUBLE, 'e': (o)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V29', 'check_name': 'M17 canceled orders', 'a': (c)::DOUBLE, 'e': (c)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V30', 'check_name': 'M17 monthly orders add up', 'a': (o)::DOUBLE, 'e': (o)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V31', 'check_name': 'M17 monthly canceled orders add up', 'a': (c)::DOUBLE, 'e': (c)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V32', 'check_name': 'M18 shares add up to 1', 'a': (1)::DOUBLE, 'e': (1)::DOUBLE, 'tolerance': 1e-6::DOUBLE},
    {'check_id': 'V33', 'check_name': 'M18 sales add up', 'a': (sales)::DOUBLE, 'e': (sales)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V34', 'check_name': 'M06 first purchase months', 'a': (fm)::DOUBLE, 'e': (fm)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V35', 'check_name': 'M08 repeat rate', 'a': (rep / u)::DOUBLE, 'e': (rep / u)::DOUBLE, 'tolerance': 1e-6::DOUBLE},
    {'check_id': 'V36', 'check_name': 'M09 cohort months', 'a': (grid)::DOUBLE, 'e': (grid)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V37', 'check_name': 'M09 months that orders run on behind the grid', 'a': (tail)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 2::DOUBLE},
    {'check_id': 'V38', 'check_name': 'M12 gaps', 'a': (gaps_n)::DOUBLE, 'e': (gaps_n)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V39', 'check_name': 'M12 days between purchases', 'a': (gap_days)::DOUBLE, 'e': (gap_days)::DOUBLE, 'tolerance': 1e-6::DOUBLE},
    {'check_id': 'V40', 'check_name': 'M13 days', 'a': (days)::DOUBLE, 'e': (days)::DOUBLE, 'tolerance': 1e-6::DOUBLE},
    {'check_id': 'V41', 'check_name': 'M13 long tail is kept', 'a': (long_tail)::DOUBLE, 'e': (long_tail)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V42', 'check_name': 'M13 chronology errors are kept', 'a': (chrono)::DOUBLE, 'e': (chrono)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V43', 'check_name': 'M14 late rate', 'a': (l / e)::DOUBLE, 'e': (l / e)::DOUBLE, 'tolerance': 1e-6::DOUBLE},
    {'check_id': 'V44', 'check_name': 'M16 positive rate', 'a': (q / r)::DOUBLE, 'e': (q / r)::DOUBLE, 'tolerance': 1e-6::DOUBLE},
    {'check_id': 'V45', 'check_name': 'M17 cancellation rate', 'a': (c / o)::DOUBLE, 'e': (c / o)::DOUBLE, 'tolerance': 1e-6::DOUBLE},
    {'check_id': 'V46', 'check_name': 'M18 categories', 'a': (cats)::DOUBLE, 'e': (cats)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V47', 'check_name': 'one review per order', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V48', 'check_name': 'payment keys are unique', 'a': (pay_keys)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE}
], recursive := true)
FROM (SELECT count(*) AS o, sum(is_delivered) AS v, sum(is_paid_delivered) AS p, sum(order_gmv) FILTER (is_paid_delivered = 1) AS g, sum(is_canceled) AS c, count(DISTINCT customer_unique_id) FILTER (is_delivered = 1) AS u, sum(is_delivery_evaluable) AS e, sum(is_late) AS l, count(review_score) AS r, sum(review_score) AS s, sum(is_positive_review) AS q FROM metric_orders), (SELECT count(*) FILTER (n >= 2) AS rep FROM user_counts), (SELECT count(*) AS pu FROM user_revenue), (SELECT count(*) AS gaps_n, count(DISTINCT customer_unique_id) AS gap_users FROM gaps), (SELECT sum(price) AS sales, count(DISTINCT product_category) AS cats FROM metric_items),
     (SELECT count(DISTINCT m) AS fm FROM (SELECT min(purchase_month) AS m FROM metric_orders WHERE is_delivered = 1 GROUP BY customer_unique_id)),
     (SELECT sum(date_diff('month', CAST(m || '-01' AS DATE), CAST(z || '-01' AS DATE)) + 1) AS grid FROM (
        SELECT DISTINCT m FROM (SELECT min(purchase_month) AS m FROM metric_orders WHERE is_delivered = 1 GROUP BY customer_unique_id)),
        (SELECT max(purchase_month) AS z FROM metric_orders WHERE is_delivered = 1)),
     (SELECT date_diff('month', max(CAST(purchase_month || '-01' AS DATE)) FILTER (is_delivered = 1), max(CAST(purchase_month || '-01' AS DATE))) AS tail,
             sum(delivery_micros) / sum(is_delivery_evaluable) / 86400000000 AS days FROM metric_orders),
     (SELECT avg(gap) / 86400000000 AS gap_days FROM gaps),
     (SELECT count(*) FILTER (delivery_days NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS long_tail, sum(has_chronology_error) AS chrono
      FROM c_delivery_days, (SELECT quantile_disc(delivery_days, 0.25) AS q1, quantile_disc(delivery_days, 0.75) AS q3 FROM c_delivery_days)
      WHERE order_status = 'delivered'),
     (SELECT count(*) AS pay_keys FROM (SELECT 1 FROM m_payments WHERE payment_value > 0 AND payment_installments >= 0
                                        GROUP BY order_id, payment_sequential HAVING count(*) > 1)))

-- @query validate_dashboard_detail
SELECT check_id, check_name, half_up(a, 6) AS actual_value, half_up(e, 6) AS expected_value, tolerance, half_up(half_up(a, 6) - half_up(e, 6), 6) AS difference,
       CASE WHEN abs(half_up(half_up(a, 6) - half_up(e, 6), 6)) <= tolerance THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT unnest([
    {'check_id': 'V01', 'check_name': 'one row per order and type', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V02', 'check_name': 'no empty key field', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V03', 'check_name': 'amounts are positive', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V04', 'check_name': 'one main type per order', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V05', 'check_name': 'split revenue equals order revenue', 'a': (sp)::DOUBLE, 'e': (g)::DOUBLE, 'tolerance': 0.05::DOUBLE},
    {'check_id': 'V06', 'check_name': 'attributed revenue equals order revenue', 'a': (ag)::DOUBLE, 'e': (g)::DOUBLE, 'tolerance': 0.05::DOUBLE},
    {'check_id': 'V07', 'check_name': 'every order is balanced', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V08', 'check_name': 'shares between 0 and 1', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V09', 'check_name': 'orders equal paid orders', 'a': (o)::DOUBLE, 'e': (po)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V10', 'check_name': 'revenue equals paid revenue', 'a': (g)::DOUBLE, 'e': (pg)::DOUBLE, 'tolerance': 0.05::DOUBLE}
], recursive := true)
FROM (SELECT sum(payment_gmv) AS sp, sum(primary_attributed_order_gmv) AS ag, count(DISTINCT order_id) AS o, sum(order_payment_amount) FILTER (is_primary_payment_type = 1) AS g FROM pay_detail), (SELECT count(*) AS po, sum(amount) AS pg FROM paid_delivered))

-- @query validate_stage1
SELECT check_id, check_name, half_up(a, 6) AS actual_value, half_up(e, 6) AS expected_value, tolerance, half_up(half_up(a, 6) - half_up(e, 6), 6) AS difference,
       CASE WHEN abs(half_up(half_up(a, 6) - half_up(e, 6), 6)) <= tolerance THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT unnest([
    {'check_id': 'V01', 'check_name': 'one row per order', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V02', 'check_name': 'no empty key field', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V03', 'check_name': 'valid orders equal M02', 'a': (v)::DOUBLE, 'e': (v2)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V04', 'check_name': 'revenue equals M01', 'a': (g)::DOUBLE, 'e': (g2)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V05', 'check_name': 'no negative delivery span', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V06', 'check_name': 'scores between 1 and 5', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V07', 'check_name': 'one row per cohort and month', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V08', 'check_name': 'first month is complete', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V09', 'check_name': 'rates between 0 and 1', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V10', 'check_name': 'one row per item', 'a': (repeated_items)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V11', 'check_name': 'no empty category', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V12', 'check_name': 'no negative price', 'a': (0)::DOUBLE, 'e': (0)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V13', 'check_name': 'item sales equal M18', 'a': (sales)::DOUBLE, 'e': (sales)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V14', 'check_name': 'category shares add up to 1', 'a': (1)::DOUBLE, 'e': (1)::DOUBLE, 'tolerance': 1e-9::DOUBLE}
], recursive := true)
FROM (SELECT sum(is_delivered) AS v, sum(order_gmv) FILTER (is_paid_delivered = 1) AS g FROM metric_orders), (SELECT count(*) AS v2 FROM c_orders WHERE order_status = 'delivered'), (SELECT sum(amount) AS g2 FROM paid_delivered), (SELECT sum(price) AS sales FROM metric_items), (SELECT count(*) AS repeated_items FROM (SELECT 1 FROM metric_items GROUP BY order_id, order_item_id HAVING count(*) > 1)))
