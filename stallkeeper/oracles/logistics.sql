-- Time to delivery, correlation with the score, orders out of line.

-- @layer spells
SELECT order_id, customer_state, arrived,
       CAST(floor(date_diff('microsecond', order_purchase_timestamp, CASE WHEN arrived = 1 THEN came ELSE TIMESTAMP '2001-08-01' END) / 86400000000.0::DOUBLE) AS BIGINT) AS day
FROM (SELECT *, order_delivered_customer_date AS came,
             CASE WHEN order_delivered_customer_date < TIMESTAMP '2001-08-01' THEN 1 ELSE 0 END AS arrived FROM m_orders) o
JOIN m_customers c ON c.customer_id = o.customer_id
WHERE order_purchase_timestamp < TIMESTAMP '2001-08-01' AND order_status NOT IN ('canceled', 'unavailable')
  AND NOT coalesce(came < order_purchase_timestamp, false) AND NOT (came IS NULL AND order_status = 'delivered')

-- @query delivery_survival
WITH days AS (SELECT day, count(*) AS n, CAST(sum(arrived) AS BIGINT) AS d FROM spells GROUP BY day),
risk AS (SELECT a.day, any_value(a.n) AS n, any_value(a.d) AS d, CAST(sum(b.n) AS BIGINT) AS r FROM days a JOIN days b ON b.day >= a.day GROUP BY a.day),
curve AS (SELECT day, r, d, n - d AS c, product(1 - d / r::DOUBLE) OVER (ORDER BY day) AS s,
                 sum(CASE WHEN d < r THEN d::DOUBLE / (r::DOUBLE * (r - d)) ELSE 0 END) OVER (ORDER BY day) AS v FROM risk)
SELECT day, r AS at_risk, d AS arrivals, c AS censored, half_up(s, 8) AS open_share, half_up(s * sqrt(v), 8) AS std_error FROM curve WHERE d > 0

-- @query delivery_survival_by_state
WITH days AS (SELECT customer_state, day, count(*) AS n, CAST(sum(arrived) AS BIGINT) AS d FROM spells GROUP BY ALL),
risk AS (SELECT *, CAST(sum(n) OVER (PARTITION BY customer_state ORDER BY day DESC) AS BIGINT) AS r FROM days),
curve AS (SELECT *, product(1 - d / r::DOUBLE) OVER (PARTITION BY customer_state ORDER BY day) AS s FROM risk)
SELECT customer_state, CAST(sum(n) AS BIGINT) AS order_count, CAST(sum(d) AS BIGINT) AS arrived_count, CAST(sum(n - d) AS BIGINT) AS open_count,
       min(day) FILTER (round(s, 9) <= 0.5) AS median_days, min(day) FILTER (round(s, 9) <= 0.1) AS ninetieth_days,
       half_up(sum(day * d) / nullif(sum(d), 0), 4) AS mean_days_of_arrived, half_up(min(s), 6) AS open_share_at_end
FROM curve GROUP BY customer_state

-- @layer scored_spans
SELECT measure, micros, review_score FROM (
  SELECT review_score, unnest(['dispatch', 'transport', 'delivery', 'delay']) AS measure,
         unnest([date_diff('microsecond', order_purchase_timestamp, order_delivered_carrier_date),
                 date_diff('microsecond', order_delivered_carrier_date, order_delivered_customer_date),
                 date_diff('microsecond', order_purchase_timestamp, order_delivered_customer_date),
                 date_diff('microsecond', order_estimated_delivery_date, order_delivered_customer_date)]) AS micros
  FROM m_orders o JOIN rep_review r ON r.order_id = o.order_id WHERE order_status = 'delivered')
WHERE micros IS NOT NULL AND (micros >= 0 OR measure = 'delay')

-- @query logistics_correlation
WITH ranked AS (
  SELECT measure, micros / 86400000000.0::DOUBLE AS days, CAST(review_score AS DOUBLE) AS score,
         rank() OVER (PARTITION BY measure ORDER BY micros) + (count(*) OVER (PARTITION BY measure, micros) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER (PARTITION BY measure ORDER BY review_score) + (count(*) OVER (PARTITION BY measure, review_score) - 1) / 2.0::DOUBLE AS ry
  FROM scored_spans)
SELECT measure, count(*) AS order_count, half_up(avg(days), 4) AS mean_days, half_up(avg(score), 4) AS mean_score, half_up(corr(days, score), 8) AS pearson,
       half_up(corr(rx, ry), 8) AS spearman, half_up(regr_slope(score, days), 8) AS score_per_day, half_up(regr_intercept(score, days), 6) AS intercept
FROM ranked GROUP BY measure

-- @layer lane_orders
SELECT *, CASE WHEN count(*) OVER (PARTITION BY origin, destination) < 30 THEN '*' ELSE origin || '>' || destination END AS lane FROM (
  SELECT o.order_id, seller_state AS origin, customer_state AS destination,
         CAST(date_diff('microsecond', order_purchase_timestamp, order_delivered_carrier_date) AS DOUBLE) AS dispatch,
         CAST(date_diff('microsecond', order_delivered_carrier_date, order_delivered_customer_date) AS DOUBLE) AS transport,
         CAST(order_delivered_customer_date > order_estimated_delivery_date AS BIGINT) AS is_late
  FROM m_orders o JOIN m_customers c ON c.customer_id = o.customer_id
  JOIN (SELECT order_id, arg_max(seller_id, (price, -seller_id)) AS seller_id FROM (
          SELECT order_id, i.seller_id, sum(price) AS price FROM m_items i SEMI JOIN m_sellers s ON s.seller_id = i.seller_id
          WHERE price >= 0 AND freight_value >= 0 GROUP BY ALL) GROUP BY order_id) v ON v.order_id = o.order_id
  JOIN m_sellers s ON s.seller_id = v.seller_id
  WHERE order_status = 'delivered' AND order_delivered_carrier_date >= order_purchase_timestamp
    AND order_delivered_customer_date >= order_delivered_carrier_date)

-- @layer lane_scores
SELECT *, (dispatch - m1) / greatest(1.4826::DOUBLE * quantile_disc(abs(dispatch - m1), 0.5) OVER (PARTITION BY lane), 3600000000.0) AS z1,
       (transport - m2) / greatest(1.4826::DOUBLE * quantile_disc(abs(transport - m2), 0.5) OVER (PARTITION BY lane), 3600000000.0) AS z2
FROM (SELECT *, quantile_disc(dispatch, 0.5) OVER (PARTITION BY lane) AS m1, quantile_disc(transport, 0.5) OVER (PARTITION BY lane) AS m2 FROM lane_orders)

-- @layer abnormal_all
SELECT *, CASE WHEN distance > 9.21 AND (z1 > 0 OR z2 > 0) THEN
         CASE WHEN z1 > 3 AND z2 > 3 THEN 'both' WHEN z1 > 3 OR (z2 <= 3 AND z1 >= z2) THEN 'late dispatch' ELSE 'late transport' END END AS cause
FROM (SELECT *, (z1 * z1 - 2 * rho * z1 * z2 + z2 * z2) / (1 - rho * rho) AS distance
      FROM lane_scores, (SELECT coalesce(corr(z1, z2), 0.0) AS rho FROM lane_scores WHERE abs(z1) <= 3 AND abs(z2) <= 3))

-- @query abnormal_orders
SELECT order_id, origin, destination, lane, half_up(dispatch / 86400000000.0::DOUBLE, 6) AS dispatch_days, half_up(transport / 86400000000.0::DOUBLE, 6) AS transport_days,
       half_up(z1, 6) AS dispatch_z, half_up(z2, 6) AS transport_z, half_up(distance, 6) AS distance, cause, is_late
FROM abnormal_all WHERE cause IS NOT NULL

-- @query abnormal_order_summary
SELECT destination AS customer_state, count(*) AS order_count, count(cause) AS abnormal_count, half_up(count(cause) / count(*), 6) AS abnormal_share,
       count(*) FILTER (cause = 'late dispatch') AS late_dispatch_count, count(*) FILTER (cause = 'late transport') AS late_transport_count,
       count(*) FILTER (cause = 'both') AS both_count, CAST(sum(is_late) AS BIGINT) AS late_count, count(*) FILTER (cause IS NOT NULL AND is_late = 1) AS late_abnormal_count,
       CAST(coalesce(sum(amount) FILTER (cause IS NOT NULL), 0) AS DOUBLE) AS abnormal_gmv,
       half_up(CAST(coalesce(sum(amount) FILTER (cause IS NOT NULL), 0) AS DOUBLE) / nullif(CAST(sum(amount) AS DOUBLE), 0), 6) AS abnormal_gmv_share,
       half_up(avg(review_score) FILTER (cause IS NOT NULL), 4) AS abnormal_score, half_up(avg(review_score) FILTER (cause IS NULL), 4) AS other_score
FROM abnormal_all a LEFT JOIN order_paid p ON p.order_id = a.order_id LEFT JOIN rep_review r ON r.order_id = a.order_id GROUP BY destination
