-- @layer second_orders
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp, order_id) AS rn FROM seen) WHERE rn = 2

-- @layer levels
SELECT * FROM (VALUES ('conservative', 1), ('neutral', 2), ('optimistic', 3)) v(scenario, k)

-- @layer sc_repeat
SELECT scenario, users - repeaters AS target_users, repeaters / users AS formal_repeat_rate, k / 10 AS assumed_relative_uplift,
       (users - repeaters) * (repeaters / users) AS baseline_expected_repeat_users, (users - repeaters) * (repeaters / users) * (k / 10) AS incremental_repeat_users,
       v AS historical_second_order_avg_gmv, half_up((users - repeaters) * (repeaters / users) * (k / 10) * v, 6) AS simulated_incremental_gmv
FROM (SELECT count(*) AS users, count(*) FILTER (frequency >= 2) AS repeaters FROM rfm_users), (SELECT CAST(sum(order_gmv) AS DOUBLE) / count(*) AS v FROM second_orders), levels

-- @query scenario_repeat
SELECT * FROM sc_repeat

-- @layer sc_aov
SELECT scenario, g AS baseline_gmv, n AS baseline_paid_orders, g / n AS baseline_aov, r AS assumed_aov_uplift, (g / n) * (1 + r) AS simulated_aov,
       half_up(n * ((g / n) * (1 + r)), 6) AS simulated_gmv, half_up(n * ((g / n) * (1 + r)) - g, 6) AS simulated_incremental_gmv
FROM (SELECT CAST(sum(gmv) AS DOUBLE) AS g, CAST(sum(order_count) AS BIGINT) AS n FROM monthly WHERE month BETWEEN '2001-01' AND '2001-07'),
     (SELECT scenario, [0.03, 0.05, 0.08][k]::DOUBLE AS r FROM levels)

-- @query scenario_aov
SELECT * FROM sc_aov

-- @layer sc_recall
SELECT scenario, n AS target_users, h AS historical_repeat_users, h / n AS historical_repeat_share, n * (h / n) AS historical_potential_recall_users, r AS assumed_recall_coefficient,
       n * (h / n) * r AS simulated_reactivated_users, v AS historical_second_order_avg_gmv, half_up(n * (h / n) * r * v, 6) AS simulated_incremental_gmv
FROM (SELECT count(*) AS n, count(*) FILTER (frequency >= 2) AS h FROM rfm WHERE rfm_segment_order = 4),
     (SELECT CAST(sum(order_gmv) AS DOUBLE) / count(*) AS v FROM second_orders SEMI JOIN (SELECT * FROM rfm WHERE rfm_segment_order = 4) USING (customer_unique_id)),
     (SELECT scenario, [0.30, 0.45, 0.60][k]::DOUBLE AS r FROM levels)

-- @query scenario_recall
SELECT * FROM sc_recall

-- @layer sc_basket
SELECT scenario, s AS single_product_orders, n AS multi_product_orders, sv AS single_product_avg_gmv, mv AS multi_product_avg_gmv, mv - sv AS historical_value_gap, k / 10 AS assumed_multi_order_uplift,
       n * (k / 10) AS simulated_new_multi_orders, half_up(n * (k / 10) * (mv - sv), 6) AS simulated_incremental_gmv
FROM (SELECT count(*) FILTER (p = 1) AS s, count(*) FILTER (p > 1) AS n, CAST(sum(amount) FILTER (p = 1) AS DOUBLE) / count(amount) FILTER (p = 1) AS sv,
             CAST(sum(amount) FILTER (p > 1) AS DOUBLE) / count(amount) FILTER (p > 1) AS mv
      FROM (SELECT order_id, count(DISTINCT product_id) AS p FROM citems GROUP BY order_id) LEFT JOIN order_paid USING (order_id)), levels

-- @query scenario_basket
SELECT * FROM sc_basket

-- @layer tiled
SELECT category_name, c.order_id, delivery_micros AS d, review_score AS s, ntile(4) OVER (PARTITION BY category_name ORDER BY delivery_micros, c.order_id) AS g
FROM (SELECT DISTINCT order_id, category_name FROM citems) c JOIN c_delivery_days o ON o.order_id = c.order_id AND order_status = 'delivered' JOIN rep_review r ON r.order_id = c.order_id

-- @layer tile_stats
SELECT category_name, g, max(d) AS top, avg(s) AS score, count(*) FILTER (s = 1) / count(*) AS ones FROM tiled GROUP BY ALL

-- @layer tile_moves
SELECT t.category_name, scenario, r, t.g, t.s, coalesce((SELECT min(q.g) FROM tile_stats q WHERE q.category_name = t.category_name AND q.g < 4 AND t.d * (1 - r) <= q.top), 4) AS h
FROM tiled t, (SELECT scenario, [0.05, 0.10, 0.15][k]::DOUBLE AS r FROM levels)

-- @layer sc_delivery
SELECT m.category_name, scenario, count(*) AS review_orders, half_up(avg(s), 6) AS baseline_avg_score, half_up(count(*) FILTER (s = 1) / count(*), 6) AS baseline_one_star_rate, r AS assumed_delivery_reduction,
       count(*) FILTER (h < m.g) AS affected_orders, half_up(count(*) FILTER (h < m.g) / count(*), 6) AS affected_order_share, half_up(avg(q.score), 6) AS historical_reference_avg_score,
       half_up(avg(q.score) - avg(s), 6) AS historical_reference_score_gap, half_up(avg(q.ones), 6) AS historical_reference_one_star_rate,
       half_up(avg(q.ones) - count(*) FILTER (s = 1) / count(*), 6) AS historical_reference_one_star_rate_gap
FROM tile_moves m JOIN tile_stats q ON q.category_name = m.category_name AND q.g = m.h GROUP BY m.category_name, scenario, r

-- @query scenario_delivery
SELECT * FROM sc_delivery

-- @layer market_picks
SELECT customer_state, recent_gmv, recent_start_month, recent_end_month FROM (
    SELECT *, quantile_cont(recent_unique_users::DOUBLE, 0.25) OVER () AS u1, quantile_cont(recent_unique_users::DOUBLE, 0.5) OVER () AS u2, quantile_cont(recent_unique_users::DOUBLE, 0.75) OVER () AS u3,
           quantile_cont(recent_spend_per_user, 0.5) OVER () AS s2, quantile_cont(user_growth_rate, 0.5) OVER () AS ug, quantile_cont(gmv_growth_rate, 0.5) OVER () AS gg
    FROM market_base WHERE prior_unique_users >= (SELECT ceil(quantile_cont(prior_unique_users, 0.25) FILTER (prior_unique_users > 0)) FROM market_base)
      AND recent_unique_users >= (SELECT ceil(quantile_cont(recent_unique_users, 0.25) FILTER (recent_unique_users > 0)) FROM market_base))
WHERE customer_state NOT IN ('NATION_1', 'NATION_2', 'NATION_3')
  AND ((recent_unique_users >= u2 AND recent_spend_per_user < s2) OR (recent_unique_users >= u1 AND recent_unique_users < u3 AND user_growth_rate >= ug AND gmv_growth_rate >= gg))

-- @layer sc_region
SELECT scenario, n AS candidate_state_count, names AS candidate_states, w AS baseline_window, g AS candidate_recent_gmv, r AS assumed_gmv_uplift,
       half_up(g * r, 6) AS simulated_incremental_gmv, half_up(g + g * r, 6) AS simulated_candidate_gmv
FROM (SELECT count(*) AS n, string_agg(customer_state, ',' ORDER BY customer_state) AS names, min(recent_start_month) || '_to_' || max(recent_end_month) AS w,
             CAST(sum(CAST(recent_gmv AS DECIMAL(28,2))) AS DOUBLE) AS g FROM market_picks), (SELECT scenario, [0.05, 0.10, 0.15][k]::DOUBLE AS r FROM levels)

-- @query scenario_region
SELECT * FROM sc_region

-- @layer sc_shift
SELECT scenario, total_gmv, total_paid_orders, split_gmv AS type_gmv, split_gmv / total_gmv AS type_gmv_share, primary_order_count AS type_primary_orders,
       primary_order_count / total_paid_orders AS type_order_share, r AS assumed_share_reduction_pp, half_up(total_gmv * r, 6) AS simulated_shifted_gmv,
       half_up(split_gmv / total_gmv - r, 9) AS simulated_type_share, 0.0::DOUBLE AS simulated_incremental_gmv
FROM pay_structure, (SELECT scenario, [0.02, 0.05, 0.10][k]::DOUBLE AS r FROM levels) WHERE period = 'ALL_DATA' AND payment_type = 'credit_card'

-- @query scenario_payment_shift
SELECT * FROM sc_shift

-- @layer state_order
SELECT customer_state, sum(order_payment_amount) AS g, row_number() OVER (ORDER BY sum(order_payment_amount) DESC, customer_state) AS rk FROM spaid GROUP BY customer_state

-- @layer sc_top3
SELECT scenario, g AS baseline_month_gmv, g / n AS baseline_aov, half_up(sh, 9) AS non_top3_share, half_up(g * sh, 6) AS target_pool_gmv, r AS assumed_gmv_uplift, half_up(g * sh * r, 6) AS simulated_incremental_gmv,
       half_up(g * sh * r / (g / n), 6) AS simulated_incremental_orders, half_up(g + g * sh * r, 6) AS simulated_total_gmv, half_up((g * sh + g * sh * r) / (g + g * sh * r), 9) AS simulated_non_top3_share
FROM (SELECT CAST(sum(order_payment_amount) AS DOUBLE) AS g, count(*) AS n FROM spaid WHERE purchase_month = '2001-07'),
     (SELECT CAST(sum(g) FILTER (rk > 3) AS DOUBLE) / CAST(sum(g) AS DOUBLE) AS sh FROM state_order), (SELECT scenario, [0.015, 0.03, 0.05][k]::DOUBLE AS r FROM levels)

-- @query scenario_non_top3
SELECT * FROM sc_top3

-- @query scenario_effects
SELECT * REPLACE (half_up(primary_effect_value, 6) AS primary_effect_value, half_up(simulated_incremental_gmv, 6) AS simulated_incremental_gmv, half_up(reference_value, 6) AS reference_value) FROM (
SELECT 'repeat_purchase_growth' AS effect_type, scenario, 'all' AS target_scope, 'incremental_repeat_users' AS primary_metric, incremental_repeat_users AS primary_effect_value, simulated_incremental_gmv, historical_second_order_avg_gmv AS reference_value FROM sc_repeat UNION ALL
SELECT 'aov_growth', scenario, 'all', 'simulated_aov', simulated_aov, simulated_incremental_gmv, baseline_aov FROM sc_aov UNION ALL
SELECT 'retention_user_recall', scenario, 'all', 'simulated_reactivated_users', simulated_reactivated_users, simulated_incremental_gmv, historical_second_order_avg_gmv FROM sc_recall UNION ALL
SELECT 'basket_structure', scenario, 'all', 'simulated_new_multi_orders', simulated_new_multi_orders, simulated_incremental_gmv, historical_value_gap FROM sc_basket UNION ALL
SELECT 'delivery_experience', scenario, category_name, 'orders_crossing_to_faster_reference_group', affected_orders, NULL, historical_reference_score_gap FROM sc_delivery UNION ALL
SELECT 'regional_pilot_growth', scenario, candidate_states, 'simulated_candidate_gmv', simulated_candidate_gmv, simulated_incremental_gmv, candidate_recent_gmv FROM sc_region UNION ALL
SELECT 'payment_structure_shift', scenario, 'all', 'simulated_shifted_gmv', simulated_shifted_gmv, simulated_incremental_gmv, type_gmv_share FROM sc_shift UNION ALL
SELECT 'non_top3_region_growth', scenario, 'all', 'simulated_non_top3_share', simulated_non_top3_share, simulated_incremental_gmv, non_top3_share FROM sc_top3)
