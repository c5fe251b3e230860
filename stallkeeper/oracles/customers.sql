-- @query customer_order_base
SELECT customer_unique_id, customer_id, order_id, order_purchase_timestamp, purchase_date, purchase_month,
       purchase_hour, weekday_number, customer_state, customer_city, CAST(order_gmv AS DOUBLE) AS order_gmv,
       CAST(is_paid_order AS BIGINT) AS is_paid_order FROM cob

-- @query customer_profile
SELECT customer_unique_id, first_purchase_timestamp, last_purchase_timestamp, first_purchase_month, latest_purchase_month,
       valid_order_count, CAST(paid_order_count AS BIGINT) AS paid_order_count, CAST(lifetime_gmv AS DOUBLE) AS lifetime_gmv,
       CAST(lifetime_gmv AS DOUBLE) / nullif(paid_order_count, 0) AS average_order_value,
       lifecycle_micros / 86400000000.0::DOUBLE AS customer_lifecycle_days, active_purchase_months,
       CAST(valid_order_count >= 2 AS BIGINT) AS is_repeat_customer, customer_state, customer_city FROM cprofile

-- @layer place_sums
SELECT customer_state, customer_city, count(*) AS users, sum(valid_order_count) AS orders,
       sum(paid_order_count) AS paid, sum(lifetime_gmv) AS gmv FROM cprofile GROUP BY ROLLUP (customer_state, customer_city)

-- @query state_profile
SELECT customer_state, users AS unique_user_count, users / sum(users) OVER () AS user_share, CAST(orders AS BIGINT) AS valid_order_count,
       CAST(paid AS BIGINT) AS paid_order_count, CAST(gmv AS DOUBLE) AS gmv, CAST(gmv AS DOUBLE) / CAST(sum(gmv) OVER () AS DOUBLE) AS gmv_share,
       CAST(gmv AS DOUBLE) / users AS spend_per_user, CAST(gmv AS DOUBLE) / nullif(paid, 0) AS average_order_value,
       rank() OVER (ORDER BY users DESC) AS user_rank, rank() OVER (ORDER BY gmv DESC) AS gmv_rank
FROM place_sums WHERE customer_city IS NULL AND customer_state IS NOT NULL

-- @query city_profile
SELECT customer_state, customer_city, users AS unique_user_count, users / sum(users) OVER () AS user_share, CAST(orders AS BIGINT) AS valid_order_count,
       CAST(paid AS BIGINT) AS paid_order_count, CAST(gmv AS DOUBLE) AS gmv, CAST(gmv AS DOUBLE) / CAST(sum(gmv) OVER () AS DOUBLE) AS gmv_share,
       CAST(gmv AS DOUBLE) / users AS spend_per_user, CAST(gmv AS DOUBLE) / nullif(paid, 0) AS average_order_value,
       rank() OVER (ORDER BY users DESC) AS user_rank, rank() OVER (ORDER BY gmv DESC) AS gmv_rank
FROM place_sums WHERE customer_city IS NOT NULL

-- @layer slot_stats
SELECT kind, slot, count(order_id) AS valid_order_count, count(order_id) / any_value(t.n) AS order_share,
       count(DISTINCT customer_unique_id) AS unique_user_count, CAST(coalesce(sum(is_paid_order), 0) AS BIGINT) AS paid_order_count,
       CAST(coalesce(sum(order_gmv), 0) AS DOUBLE) AS gmv, CAST(coalesce(sum(order_gmv), 0) AS DOUBLE) / CAST(any_value(t.g) AS DOUBLE) AS gmv_share,
       CAST(coalesce(sum(order_gmv), 0) AS DOUBLE) / nullif(sum(is_paid_order), 0) AS average_order_value
FROM (SELECT 'hour' AS kind, i AS slot FROM range(24) r(i) UNION ALL SELECT 'weekday', i FROM range(1, 8) r(i)
      UNION ALL SELECT 'daytype', i FROM range(1, 3) r(i)) s
LEFT JOIN cob ON slot = CASE kind WHEN 'hour' THEN purchase_hour WHEN 'weekday' THEN weekday_number
                        ELSE CASE WHEN weekday_number >= 6 THEN 2 ELSE 1 END END
CROSS JOIN (SELECT count(*) AS n, sum(order_gmv) AS g FROM cob) t
GROUP BY kind, slot

-- @query hourly_behavior
SELECT slot AS hour, * EXCLUDE (kind, slot) FROM slot_stats WHERE kind = 'hour'

-- @query weekday_behavior
SELECT slot AS weekday_number, dayname(DATE '2024-01-01' + CAST(slot - 1 AS INT)) AS weekday_name, * EXCLUDE (kind, slot)
FROM slot_stats WHERE kind = 'weekday'

-- @query day_type_behavior
SELECT slot AS day_type_order, CASE slot WHEN 1 THEN 'Weekday' ELSE 'Weekend' END AS day_type, s.* EXCLUDE (kind, slot),
       days AS calendar_day_count, valid_order_count / days AS average_daily_orders
FROM slot_stats s JOIN (
    SELECT CASE WHEN isodow(d) >= 6 THEN 2 ELSE 1 END AS k, count(*) AS days
    FROM (SELECT unnest(generate_series(min(purchase_date), max(purchase_date), INTERVAL 1 DAY)) AS d FROM cob) GROUP BY 1) c ON c.k = slot
WHERE kind = 'daytype' AND valid_order_count > 0

-- @layer growth_window
SELECT min(month) FILTER (r <= 6) AS recent_start_month, max(month) FILTER (r <= 6) AS recent_end_month,
       min(month) FILTER (r BETWEEN 7 AND 12) AS prior_start_month, max(month) FILTER (r BETWEEN 7 AND 12) AS prior_end_month,
       count(*) FILTER (r <= 6) AS recent_month_count, count(*) FILTER (r BETWEEN 7 AND 12) AS prior_month_count
FROM (SELECT purchase_month AS month, row_number() OVER (ORDER BY purchase_month DESC) - 1 AS r, count(*) OVER () AS n
      FROM (SELECT DISTINCT purchase_month FROM cob)) WHERE r > 0 AND r < n - 1

-- @query growth_periods
SELECT * FROM growth_window

-- @layer market_growth
SELECT customer_state, prior_start_month, prior_end_month, recent_start_month, recent_end_month,
       count(DISTINCT customer_unique_id) FILTER (NOT recent) AS prior_unique_users,
       count(DISTINCT customer_unique_id) FILTER (recent) AS recent_unique_users,
       count(*) FILTER (NOT recent) AS prior_valid_orders, count(*) FILTER (recent) AS recent_valid_orders,
       CAST(coalesce(sum(is_paid_order) FILTER (NOT recent), 0) AS BIGINT) AS prior_paid_orders,
       CAST(coalesce(sum(is_paid_order) FILTER (recent), 0) AS BIGINT) AS recent_paid_orders,
       CAST(coalesce(sum(order_gmv) FILTER (NOT recent), 0) AS DOUBLE) AS prior_gmv,
       CAST(coalesce(sum(order_gmv) FILTER (recent), 0) AS DOUBLE) AS recent_gmv
FROM (SELECT *, purchase_month BETWEEN recent_start_month AND recent_end_month AS recent FROM cob, growth_window
      WHERE purchase_month BETWEEN prior_start_month AND recent_end_month)
GROUP BY ALL

-- @layer market_base
SELECT *, recent_gmv / nullif(recent_unique_users, 0) AS recent_spend_per_user,
       (recent_unique_users - prior_unique_users) / nullif(prior_unique_users, 0) AS user_growth_rate,
       (recent_gmv - prior_gmv) / nullif(prior_gmv, 0) AS gmv_growth_rate,
       recent_unique_users / sum(recent_unique_users) OVER () AS recent_user_share,
       recent_gmv / CAST(sum(CAST(recent_gmv AS DECIMAL(28,2))) OVER () AS DOUBLE) AS recent_gmv_share
FROM market_growth

-- @query market_growth_base
SELECT * FROM market_base
