-- @layer exp_orders
SELECT s.*, review_id, review_score, review_creation_date, review_answer_timestamp,
       CASE WHEN order_delivered_customer_date >= order_purchase_timestamp THEN date_diff('microsecond', order_purchase_timestamp, order_delivered_customer_date) END AS micros,
       CASE WHEN order_delivered_customer_date >= order_purchase_timestamp THEN CAST(order_delivered_customer_date > order_estimated_delivery_date AS BIGINT) END AS is_delayed
FROM seen s LEFT JOIN rep_review r ON r.order_id = s.order_id

-- @layer churners
SELECT customer_unique_id, min(order_purchase_timestamp) AS first_ts, max(order_purchase_timestamp) AS last_ts, count(*) AS orders, sum(is_paid_order) AS paid, sum(order_gmv) AS gmv,
       date_diff('day', CAST(max(order_purchase_timestamp) AS DATE), DATE '2001-07-31') AS recency,
       date_diff('day', CAST(min(order_purchase_timestamp) AS DATE), CAST(max(order_purchase_timestamp) AS DATE)) AS life_days,
       CAST(date_diff('day', CAST(max(order_purchase_timestamp) AS DATE), DATE '2001-07-31') > 90 AS BIGINT) AS churn_flag,
       arg_max(order_gmv, (order_purchase_timestamp, order_id)) AS latest_amount, arg_max(customer_state, (order_purchase_timestamp, order_id)) AS state,
       arg_max(customer_city, (order_purchase_timestamp, order_id)) AS city, count(review_score) AS rn, sum(review_score) AS rs,
       count(micros) AS dn, sum(micros) AS ds, count(is_delayed) AS ln, coalesce(sum(is_delayed), 0) AS ls
FROM exp_orders GROUP BY customer_unique_id

-- @layer churn_cmp
SELECT CASE churn_flag WHEN 1 THEN 'Churned' ELSE 'Non-churned' END AS churn_status, count(*) AS user_count, half_up(100 * (count(*) / sum(count(*)) OVER ()), 2) AS user_share_pct,
       CAST(sum(orders) AS BIGINT) AS total_valid_orders, CAST(sum(paid) AS BIGINT) AS total_paid_orders, half_up(sum(gmv), 2) AS total_gmv, half_up(CAST(sum(gmv) AS DOUBLE) / count(*), 2) AS spend_per_user,
       half_up(sum(orders) / count(*), 4) AS avg_purchase_frequency, count(*) FILTER (orders >= 2) AS repeat_users, half_up(100 * (count(*) FILTER (orders >= 2) / count(*)), 2) AS repeat_rate_pct,
       half_up(sum(life_days) / count(*), 2) AS avg_lifecycle_days, half_up(CAST(sum(gmv) AS DOUBLE) / nullif(sum(paid), 0), 2) AS average_order_value,
       count(latest_amount) AS users_with_latest_order_amount, half_up(CAST(sum(latest_amount) AS DOUBLE) / count(latest_amount), 2) AS avg_latest_order_amount,
       CAST(sum(orders) AS BIGINT) AS order_count, CAST(sum(rn) AS BIGINT) AS review_order_count, CAST(sum(orders) - sum(rn) AS BIGINT) AS excluded_review_orders,
       half_up(sum(rs) / nullif(sum(rn), 0), 3) AS avg_review_score, CAST(sum(dn) AS BIGINT) AS delivery_order_count, CAST(sum(orders) - sum(dn) AS BIGINT) AS excluded_delivery_orders,
       half_up(CAST(sum(ds) AS DOUBLE) / nullif(sum(dn), 0) / 86400000000, 2) AS avg_delivery_days, CAST(sum(ln) AS BIGINT) AS delay_eligible_orders,
       CAST(sum(orders) - sum(ln) AS BIGINT) AS excluded_delay_orders, CAST(sum(ls) AS BIGINT) AS delayed_orders, half_up(100 * (sum(ls) / nullif(sum(ln), 0)), 2) AS delay_rate_pct
FROM churners GROUP BY churn_flag

-- @query churn_comparison
SELECT * FROM churn_cmp

-- @query churn_user_detail
SELECT customer_unique_id, first_ts AS first_purchase_timestamp, last_ts AS last_purchase_timestamp, orders AS valid_order_count, CAST(paid AS BIGINT) AS paid_order_count,
       half_up(gmv, 2) AS lifetime_gmv, half_up(CAST(gmv AS DOUBLE) / nullif(paid, 0), 2) AS average_order_value, recency AS recency_days, life_days AS customer_lifecycle_days,
       CAST(orders >= 2 AS BIGINT) AS is_repeat_customer, churn_flag, '2001-07-31' AS observation_date, half_up(latest_amount, 2) AS latest_order_amount, state AS customer_state, city AS customer_city,
       half_up(rs / nullif(rn, 0), 3) AS avg_review_score, half_up(CAST(ds AS DOUBLE) / nullif(dn, 0) / 86400000000, 2) AS avg_delivery_days, ln AS delay_eligible_orders,
       CAST(ls AS BIGINT) AS delayed_orders, half_up(100 * (ls / nullif(ln, 0)), 2) AS delay_rate_pct
FROM churners

-- @layer churn_orders
SELECT s.*, churn_flag, CASE churn_flag WHEN 1 THEN 'Churned' ELSE 'Non-churned' END AS churn_status, primary_payment_type, CASE WHEN weekday_number >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type
FROM seen s JOIN churners c ON c.customer_unique_id = s.customer_unique_id LEFT JOIN main_type t ON t.order_id = s.order_id

-- @query churn_by_payment
SELECT churn_status, primary_payment_type, count(*) AS order_count, half_up(100 * (count(*) / sum(count(*)) OVER (PARTITION BY churn_status)), 2) AS order_share_pct,
       count(DISTINCT customer_unique_id) AS users_using_payment_type
FROM churn_orders WHERE primary_payment_type IS NOT NULL GROUP BY churn_status, primary_payment_type

-- @layer churn_places
SELECT state, city || ' | ' || state AS place, churn_flag FROM churners

-- @layer churn_states
SELECT state AS customer_state, count(*) AS user_count, CAST(sum(churn_flag) AS BIGINT) AS churned_users, CAST(count(*) - sum(churn_flag) AS BIGINT) AS non_churned_users,
       half_up(100 * (sum(churn_flag) / count(*)), 2) AS churn_rate_pct, half_up(100 * (count(*) / sum(count(*)) OVER ()), 2) AS user_share_pct,
       half_up(100 * (sum(churn_flag) / count(*)) - 100 * (sum(sum(churn_flag)) OVER () / sum(count(*)) OVER ()), 2) AS churn_rate_vs_overall_pct_point
FROM churn_places GROUP BY state

-- @query churn_by_state
SELECT * FROM churn_states

-- @query churn_state_ranking
SELECT * EXCLUDE (churn_rate_vs_overall_pct_point) FROM churn_states ORDER BY user_count DESC, customer_state LIMIT 10

-- @query churn_by_city_top30
SELECT place AS customer_city_state, count(*) AS user_count, CAST(sum(churn_flag) AS BIGINT) AS churned_users, CAST(count(*) - sum(churn_flag) AS BIGINT) AS non_churned_users,
       half_up(100 * (sum(churn_flag) / count(*)), 2) AS churn_rate_pct, half_up(100 * (count(*) / sum(count(*)) OVER ()), 2) AS user_share_pct,
       half_up(100 * (sum(churn_flag) / count(*)) - 100 * (sum(sum(churn_flag)) OVER () / sum(count(*)) OVER ()), 2) AS churn_rate_vs_overall_pct_point
FROM churn_places GROUP BY place ORDER BY user_count DESC, place LIMIT 30

-- @query churn_by_day_type
SELECT churn_status, o.day_type, days AS calendar_day_count, count(*) AS order_count, half_up(count(*) / days, 2) AS orders_per_calendar_day,
       half_up(100 * (count(*) / sum(count(*)) OVER (PARTITION BY churn_status)), 2) AS order_share_pct, count(DISTINCT customer_unique_id) AS users_with_orders,
       CAST(sum(is_paid_order) AS BIGINT) AS paid_order_count, half_up(sum(order_gmv), 2) AS gmv, half_up(CAST(sum(order_gmv) AS DOUBLE) / nullif(sum(is_paid_order), 0), 2) AS average_order_value
FROM churn_orders o JOIN (SELECT CASE WHEN isodow(d) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, count(*) AS days
    FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-07-31', INTERVAL 1 DAY) g(d) GROUP BY 1) c ON c.day_type = o.day_type
GROUP BY churn_status, o.day_type, days

-- @query churn_by_first_month
SELECT strftime(first_ts, '%Y-%m') AS first_purchase_month, count(*) AS cohort_users, CAST(sum(churn_flag) AS BIGINT) AS churned_users, CAST(count(*) - sum(churn_flag) AS BIGINT) AS non_churned_users,
       half_up(100 * (sum(churn_flag) / count(*)), 2) AS churn_rate_pct, count(*) FILTER (CAST(first_ts AS DATE) <= DATE '2001-05-01') AS users_with_full_90d_opportunity,
       half_up(100 * (count(*) / sum(count(*)) OVER ()), 2) AS user_share_pct
FROM churners GROUP BY 1

-- @layer contingency
SELECT 'Primary Payment Type' AS feature, churn_flag AS r, primary_payment_type AS c FROM churn_orders WHERE primary_payment_type IS NOT NULL UNION ALL
SELECT 'Weekday / Weekend', churn_flag, day_type FROM churn_orders UNION ALL SELECT 'Customer State', churn_flag, state FROM churners

-- @layer cramer
SELECT a.feature, 'Cramer''s V' AS association_metric,
       half_up(sqrt(sum((coalesce(o, 0) - rt * ct / t) ** 2 / (rt * ct / t)) / (any_value(t) * (least(count(DISTINCT a.r), count(DISTINCT b.c)) - 1))), 4) AS association_value
FROM (SELECT feature, r, count(*)::DOUBLE AS rt, sum(count(*)) OVER (PARTITION BY feature)::DOUBLE AS t FROM contingency GROUP BY feature, r) a
JOIN (SELECT feature, c, count(*)::DOUBLE AS ct FROM contingency GROUP BY ALL) b ON b.feature = a.feature
LEFT JOIN (SELECT feature, r, c, count(*)::DOUBLE AS o FROM contingency GROUP BY ALL) x ON x.feature = a.feature AND x.r = a.r AND x.c = b.c
GROUP BY a.feature

-- @query churn_association
SELECT * FROM cramer

-- @query churn_feature_summary
SELECT f AS feature, max(v) FILTER (churn_status = 'Churned') AS churned_value, max(v) FILTER (churn_status <> 'Churned') AS non_churned_value,
       half_up(max(v) FILTER (churn_status = 'Churned') - max(v) FILTER (churn_status <> 'Churned'), 6) AS difference, CAST(NULL AS VARCHAR) AS association_metric, CAST(NULL AS DOUBLE) AS association_value
FROM (SELECT churn_status, unnest(['Spend per User', 'Average Purchase Frequency', 'Repeat Rate', 'Average Lifecycle Days', 'Average Order Value', 'Latest Order Amount', 'Average Review Score', 'Average Delivery Days', 'Delay Rate']) AS f,
             unnest([spend_per_user, avg_purchase_frequency, repeat_rate_pct, avg_lifecycle_days, average_order_value, avg_latest_order_amount, avg_review_score, avg_delivery_days, delay_rate_pct]) AS v FROM churn_cmp)
GROUP BY f
UNION ALL SELECT feature, NULL, NULL, NULL, association_metric, association_value FROM cramer
