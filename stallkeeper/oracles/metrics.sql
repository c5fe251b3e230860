-- @layer paid_delivered
SELECT o.*, amount FROM c_orders o JOIN order_paid p ON p.order_id = o.order_id WHERE order_status = 'delivered'

-- @layer user_counts
SELECT customer_unique_id, count(*) AS n FROM delivered_users GROUP BY ALL

-- @query m01_gmv
SELECT CAST(sum(amount) AS DOUBLE) AS gmv FROM paid_delivered

-- @query m02_valid_orders
SELECT count(DISTINCT order_id) AS valid_order_count FROM c_orders WHERE order_status = 'delivered'

-- @query m03_aov
SELECT count(*) AS paid_order_count, CAST(sum(amount) AS DOUBLE) AS paid_order_revenue,
       CAST(sum(amount) AS DOUBLE) / count(*) AS average_order_value FROM paid_delivered

-- @query m04_paid_orders
SELECT count(DISTINCT order_id) AS paid_order_count FROM paid_delivered

-- @query m05_active_customers
SELECT count(DISTINCT customer_unique_id) AS active_customer_count FROM delivered_users

-- @query m06_new_customers
SELECT first_purchase_month, count(*) AS new_customer_count
FROM (SELECT min(month) AS first_purchase_month FROM delivered_users GROUP BY customer_unique_id) GROUP BY ALL

-- @query m07_repeat_customers
SELECT count(*) FILTER (n >= 2) AS repeat_customer_count FROM user_counts

-- @query m08_repeat_rate
SELECT count(*) AS active_customer_count, count(*) FILTER (n >= 2) AS repeat_customer_count,
       count(*) FILTER (n >= 2) / count(*) AS repeat_purchase_rate FROM user_counts

-- @layer user_months
SELECT DISTINCT customer_unique_id, date_trunc('month', order_purchase_timestamp) AS mon FROM delivered_users

-- @layer retention_grid
SELECT cohort, unnest(generate_series(cohort, (SELECT max(mon) FROM user_months), INTERVAL 1 MONTH)) AS mon, size
FROM (SELECT cohort, count(*) AS size FROM (SELECT min(mon) AS cohort FROM user_months GROUP BY customer_unique_id) GROUP BY cohort)

-- @layer retention
SELECT strftime(g.cohort, '%Y-%m') AS cohort_month, date_diff('month', g.cohort, g.mon) AS retention_month_number,
       size AS cohort_customer_count, count(a.customer_unique_id) AS retained_customer_count,
       count(a.customer_unique_id) / size AS customer_retention_rate
FROM retention_grid g LEFT JOIN (
    SELECT *, min(mon) OVER (PARTITION BY customer_unique_id) AS cohort FROM user_months) a
  ON a.cohort = g.cohort AND a.mon = g.mon
GROUP BY g.cohort, g.mon, size

-- @query m09_retention
SELECT * FROM retention

-- @query cohort_filtered
SELECT * FROM retention WHERE cohort_month BETWEEN '1995-06' AND '1995-12'

-- @layer user_revenue
SELECT customer_unique_id, sum(amount) AS revenue FROM paid_delivered o
JOIN m_customers c ON c.customer_id = o.customer_id GROUP BY customer_unique_id

-- @query m10_ltv
SELECT count(*) AS paying_customer_count, CAST(sum(revenue) AS DOUBLE) AS total_customer_revenue,
       CAST(sum(revenue) AS DOUBLE) / count(*) AS customer_lifetime_value FROM user_revenue

-- @query m11_frequency
SELECT count(DISTINCT order_id) AS valid_order_count, count(DISTINCT customer_unique_id) AS active_customer_count,
       count(DISTINCT order_id) / count(DISTINCT customer_unique_id) AS average_purchase_frequency FROM delivered_users

-- @layer gaps
SELECT customer_unique_id, date_diff('microsecond', prev, order_purchase_timestamp) AS gap
FROM (SELECT *, lag(order_purchase_timestamp) OVER (PARTITION BY customer_unique_id
      ORDER BY order_purchase_timestamp, order_id) AS prev FROM delivered_users) WHERE prev IS NOT NULL

-- @query m12_repurchase_interval
SELECT count(DISTINCT customer_unique_id) AS repeat_customer_count, count(*) AS valid_interval_count,
       CAST(sum(gap) AS DOUBLE) / count(*) / 86400000000 AS average_repurchase_interval_days FROM gaps

-- @query m13_delivery_days
SELECT count(*) AS valid_delivery_order_count,
       CAST(sum(delivery_micros) AS DOUBLE) / count(*) / 86400000000 AS average_delivery_days
FROM c_delivery_days WHERE order_status = 'delivered'

-- @query m14_late_rate
SELECT count(*) AS evaluable_order_count, count(*) FILTER (late) AS late_order_count,
       count(*) FILTER (late) / count(*) AS late_delivery_rate
FROM (SELECT order_delivered_customer_date > order_estimated_delivery_date AS late FROM c_delivery_days WHERE order_status = 'delivered')

-- @layer scored
SELECT r.order_id, review_score FROM rep_review r SEMI JOIN (SELECT * FROM c_orders WHERE order_status = 'delivered') o ON o.order_id = r.order_id

-- @query m15_review_score
SELECT count(*) AS reviewed_order_count, CAST(sum(review_score) AS DOUBLE) / count(*) AS average_review_score FROM scored

-- @query m16_positive_rate
SELECT count(*) AS reviewed_order_count, count(*) FILTER (review_score >= 4) AS positive_review_order_count,
       count(*) FILTER (review_score >= 4) / count(*) AS positive_review_rate FROM scored

-- @query m17_cancel_rate
SELECT count(*) AS total_order_count, count(*) FILTER (order_status = 'canceled') AS canceled_order_count,
       count(*) FILTER (order_status = 'canceled') / count(*) AS cancellation_rate FROM c_orders

-- @query m17_cancel_monthly
SELECT strftime(order_purchase_timestamp, '%Y-%m') AS order_month, count(*) AS total_order_count,
       count(*) FILTER (order_status = 'canceled') AS canceled_order_count,
       count(*) FILTER (order_status = 'canceled') / count(*) AS cancellation_rate FROM c_orders GROUP BY 1

-- @layer metric_items
SELECT i.order_id, order_item_id, i.product_id, order_purchase_timestamp,
       strftime(order_purchase_timestamp, '%Y-%m') AS purchase_month,
       coalesce(nullif(product_category_name, ''), 'unknown') AS product_category, price
FROM c_items i JOIN c_orders o ON o.order_id = i.order_id AND order_status = 'delivered'
JOIN m_products p ON p.product_id = i.product_id

-- @query metric_category_item_base
SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM metric_items

-- @query m18_category_share
SELECT product_category, CAST(sum(price) AS DOUBLE) AS category_sales_amount,
       CAST(sum(sum(price)) OVER () AS DOUBLE) AS total_category_sales_amount,
       CAST(sum(price) AS DOUBLE) / CAST(sum(sum(price)) OVER () AS DOUBLE) AS category_sales_share
FROM metric_items GROUP BY product_category

-- @query category_share_filtered
SELECT product_category, CAST(sum(price) AS DOUBLE) AS category_sales_amount,
       CAST(sum(sum(price)) OVER () AS DOUBLE) AS total_category_sales_amount,
       CAST(sum(price) AS DOUBLE) / CAST(sum(sum(price)) OVER () AS DOUBLE) AS category_sales_share
FROM metric_items WHERE CAST(order_purchase_timestamp AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'
GROUP BY product_category

-- @layer metric_orders
SELECT o.order_id, customer_unique_id, customer_state, o.order_status, o.order_purchase_timestamp,
       strftime(o.order_purchase_timestamp, '%Y-%m') AS purchase_month, coalesce(amount, 0) AS order_gmv,
       CAST(o.order_status = 'delivered' AS BIGINT) AS is_delivered,
       CAST(o.order_status = 'delivered' AND coalesce(amount, 0) > 0 AS BIGINT) AS is_paid_delivered,
       CAST(o.order_status = 'canceled' AS BIGINT) AS is_canceled,
       d.delivery_micros, CAST(d.order_id IS NOT NULL AS BIGINT) AS is_delivery_evaluable,
       CAST(coalesce(d.order_delivered_customer_date > d.order_estimated_delivery_date, false) AS BIGINT) AS is_late,
       s.review_score, CAST(coalesce(s.review_score >= 4, false) AS BIGINT) AS is_positive_review
FROM c_orders o JOIN m_customers c ON c.customer_id = o.customer_id
LEFT JOIN order_paid p ON p.order_id = o.order_id
LEFT JOIN (SELECT * FROM c_delivery_days WHERE order_status = 'delivered') d ON d.order_id = o.order_id
LEFT JOIN scored s ON s.order_id = o.order_id

-- @query metric_order_base
SELECT * EXCLUDE (delivery_micros) REPLACE (CAST(order_gmv AS DOUBLE) AS order_gmv),
       delivery_micros / 86400000000.0::DOUBLE AS delivery_days FROM metric_orders

-- @query metric_monthly_trends
SELECT purchase_month, count(*) AS total_order_count, CAST(sum(is_delivered) AS BIGINT) AS valid_order_count,
       CAST(sum(is_paid_delivered) AS BIGINT) AS paid_order_count,
       CAST(coalesce(sum(order_gmv) FILTER (is_paid_delivered = 1), 0) AS DOUBLE) AS gmv,
       CAST(sum(order_gmv) FILTER (is_paid_delivered = 1) AS DOUBLE) / nullif(sum(is_paid_delivered), 0) AS average_order_value,
       count(DISTINCT customer_unique_id) FILTER (is_delivered = 1) AS active_customer_count,
       CAST(sum(delivery_micros) AS DOUBLE) / count(delivery_micros) / 86400000000 AS average_delivery_days,
       CAST(sum(is_late) AS DOUBLE) / nullif(sum(is_delivery_evaluable), 0) AS late_delivery_rate,
       CAST(sum(review_score) AS DOUBLE) / nullif(count(review_score), 0) AS average_review_score,
       CAST(sum(is_positive_review) AS DOUBLE) / nullif(count(review_score), 0) AS positive_review_rate,
       CAST(sum(is_canceled) AS BIGINT) AS canceled_order_count,
       CAST(sum(is_canceled) AS DOUBLE) / count(*) AS cancellation_rate,
       coalesce(any_value(repeaters), 0) AS repeat_customer_count,
       coalesce(any_value(newcomers), 0) AS new_customer_count,
       coalesce(any_value(repeaters), 0) / nullif(count(DISTINCT customer_unique_id) FILTER (is_delivered = 1), 0) AS repeat_purchase_rate
FROM metric_orders
LEFT JOIN (SELECT purchase_month, count(*) AS repeaters FROM (
    SELECT purchase_month, customer_unique_id FROM metric_orders WHERE is_delivered = 1 GROUP BY ALL HAVING count(*) >= 2)
    GROUP BY purchase_month) USING (purchase_month)
LEFT JOIN (SELECT purchase_month, count(*) AS newcomers FROM (
    SELECT min(purchase_month) AS purchase_month FROM metric_orders WHERE is_delivered = 1 GROUP BY customer_unique_id)
    GROUP BY purchase_month) USING (purchase_month)
GROUP BY purchase_month

-- @layer metric_slice
SELECT * FROM metric_orders WHERE CAST(order_purchase_timestamp AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'
   AND customer_state IN ('NATION_1', 'NATION_2', 'NATION_3')

-- @query metric_filtered
SELECT count(*) AS total_order_count, CAST(sum(is_delivered) AS BIGINT) AS valid_order_count,
       CAST(sum(is_paid_delivered) AS BIGINT) AS paid_order_count,
       CAST(coalesce(sum(order_gmv) FILTER (is_paid_delivered = 1), 0) AS DOUBLE) AS gmv,
       CAST(sum(order_gmv) FILTER (is_paid_delivered = 1) AS DOUBLE) / nullif(sum(is_paid_delivered), 0) AS average_order_value,
       count(DISTINCT customer_unique_id) FILTER (is_delivered = 1) AS active_customer_count,
       CAST(sum(delivery_micros) AS DOUBLE) / count(delivery_micros) / 86400000000 AS average_delivery_days,
       CAST(sum(is_late) AS DOUBLE) / nullif(sum(is_delivery_evaluable), 0) AS late_delivery_rate,
       CAST(sum(review_score) AS DOUBLE) / nullif(count(review_score), 0) AS average_review_score,
       CAST(sum(is_positive_review) AS DOUBLE) / nullif(count(review_score), 0) AS positive_review_rate,
       CAST(sum(is_canceled) AS BIGINT) AS canceled_order_count,
       CAST(sum(is_canceled) AS DOUBLE) / count(*) AS cancellation_rate,
       any_value(u.repeat_customer_count) AS repeat_customer_count,
       any_value(u.repeat_purchase_rate) AS repeat_purchase_rate,
       any_value(u.customer_lifetime_value) AS customer_lifetime_value,
       any_value(u.average_purchase_frequency) AS average_purchase_frequency,
       any_value(u.average_repurchase_interval_days) AS average_repurchase_interval_days
FROM metric_slice, (
    SELECT count(*) FILTER (n >= 2) AS repeat_customer_count, count(*) FILTER (n >= 2) / count(*) AS repeat_purchase_rate,
           CAST(sum(revenue) AS DOUBLE) / count(*) FILTER (revenue > 0) AS customer_lifetime_value,
           CAST(sum(n) AS DOUBLE) / count(*) AS average_purchase_frequency,
           CAST(sum(span) AS DOUBLE) / CAST(sum(n - 1) AS DOUBLE) / 86400000000 AS average_repurchase_interval_days
    FROM (SELECT count(*) AS n, sum(order_gmv) AS revenue,
                 date_diff('microsecond', min(order_purchase_timestamp), max(order_purchase_timestamp)) AS span
          FROM metric_slice WHERE is_delivered = 1 GROUP BY customer_unique_id)) u

-- @layer ltv_counts
SELECT CAST(revenue AS DOUBLE) AS v, count(*) AS n FROM user_revenue GROUP BY 1

-- @query ltv_distribution
SELECT bin, min(lo + bin * w) AS bin_start, min(lo + (bin + 1) * w) AS bin_end, CAST(sum(n) AS BIGINT) AS user_count
FROM (SELECT *, CASE WHEN w > 0 THEN least(CAST(floor((v - lo) / w) AS BIGINT), bins - 1) ELSE 0 END AS bin
      FROM ltv_counts, (SELECT min(v) AS lo, least(count(*), 35) AS bins, (max(v) - min(v)) / least(count(*), 35) AS w FROM ltv_counts))
GROUP BY bin

-- @query frequency_distribution
SELECT n AS valid_order_count, count(*) AS user_count FROM user_counts GROUP BY n

-- @layer gap_counts
SELECT gap / 86400000000.0::DOUBLE AS v, count(*) AS n FROM gaps GROUP BY 1

-- @query interval_distribution
SELECT bin, min(lo + bin * w) AS bin_start, min(lo + (bin + 1) * w) AS bin_end, CAST(sum(n) AS BIGINT) AS interval_count
FROM (SELECT *, CASE WHEN w > 0 THEN least(CAST(floor((v - lo) / w) AS BIGINT), bins - 1) ELSE 0 END AS bin
      FROM gap_counts, (SELECT min(v) AS lo, least(count(*), 35) AS bins, (max(v) - min(v)) / least(count(*), 35) AS w FROM gap_counts))
GROUP BY bin
