-- @query market_potential
WITH t AS (
    SELECT *, prior_unique_users >= pt AND recent_unique_users >= rt AS is_sample_eligible
    FROM market_base, (SELECT CAST(ceil(quantile_cont(prior_unique_users, 0.25) FILTER (prior_unique_users > 0)) AS BIGINT) AS pt,
                              CAST(ceil(quantile_cont(recent_unique_users, 0.25) FILTER (recent_unique_users > 0)) AS BIGINT) AS rt FROM market_base)),
s AS (SELECT quantile_cont(recent_unique_users::DOUBLE, 0.25) AS u1, quantile_cont(recent_unique_users::DOUBLE, 0.5) AS u2, quantile_cont(recent_unique_users::DOUBLE, 0.75) AS u3,
             quantile_cont(recent_spend_per_user, 0.5) AS s2, quantile_cont(recent_spend_per_user, 0.75) AS s3, quantile_cont(recent_user_share, 0.5) AS h2,
             quantile_cont(user_growth_rate, 0.5) AS ug, quantile_cont(gmv_growth_rate, 0.5) AS gg FROM t WHERE is_sample_eligible),
r AS (SELECT t.*, s.*, is_sample_eligible AND coalesce(recent_unique_users >= u2 AND recent_spend_per_user < s2, false) AS a,
             is_sample_eligible AND coalesce(recent_unique_users >= u1 AND recent_unique_users < u3 AND user_growth_rate >= ug AND gmv_growth_rate >= gg, false) AS b,
             is_sample_eligible AND coalesce(recent_spend_per_user >= s3 AND recent_user_share < h2, false) AS c FROM t, s)
SELECT customer_state, prior_start_month, prior_end_month, recent_start_month, recent_end_month, prior_unique_users, recent_unique_users,
       prior_valid_orders, recent_valid_orders, prior_paid_orders, recent_paid_orders, prior_gmv, recent_gmv, recent_spend_per_user,
       user_growth_rate, gmv_growth_rate, recent_user_share, recent_gmv_share, pt AS sample_prior_user_threshold, rt AS sample_recent_user_threshold,
       is_sample_eligible, a AS is_large_scale_low_spend, b AS is_medium_scale_fast_growth, c AS is_high_spend_low_penetration,
       half_up(u1, 8) AS eligible_recent_users_q25, half_up(u2, 8) AS eligible_recent_users_median, half_up(u3, 8) AS eligible_recent_users_q75,
       half_up(s2, 8) AS eligible_spend_per_user_median, half_up(s3, 8) AS eligible_spend_per_user_q75, half_up(h2, 8) AS eligible_user_share_median,
       half_up(ug, 8) AS eligible_user_growth_median, half_up(gg, 8) AS eligible_gmv_growth_median,
       half_up((user_growth_rate + gmv_growth_rate) / 2, 8) AS growth_strength,
       CASE WHEN NOT is_sample_eligible THEN '样本不足（不做潜力判断）' WHEN NOT (a OR b OR c) THEN '未命中重点类型'
            ELSE concat_ws('；', CASE WHEN a THEN '规模较大但人均消费较低' END, CASE WHEN b THEN '当前规模中等但增长较快' END,
                           CASE WHEN c THEN '人均消费较高但渗透规模较小' END) END AS potential_market_type,
       rank() OVER (ORDER BY recent_unique_users DESC) AS recent_user_rank, rank() OVER (ORDER BY recent_gmv DESC) AS recent_gmv_rank,
       rank() OVER (ORDER BY user_growth_rate DESC NULLS LAST) AS user_growth_rank, rank() OVER (ORDER BY gmv_growth_rate DESC NULLS LAST) AS gmv_growth_rank
FROM r

-- @layer seen
SELECT * FROM cob WHERE purchase_date <= DATE '2001-07-31'

-- @query order_base_audit
SELECT count(*) AS row_count, (SELECT count(*) FROM m_orders o LEFT JOIN m_customers c ON c.customer_id = o.customer_id
        WHERE order_status = 'delivered' AND (customer_unique_id IS NULL OR trim(customer_unique_id::VARCHAR) = '')) AS missing_users, min(order_purchase_timestamp) AS first_purchase,
       max(order_purchase_timestamp) AS last_purchase, count(*) FILTER (b) AS orders_before_cutoff, count(*) FILTER (NOT b) AS orders_after_cutoff,
       count(DISTINCT customer_unique_id) FILTER (b) AS users_before_cutoff, count(*) FILTER (b AND customer_state IS NULL) AS missing_state,
       count(*) FILTER (b AND customer_city IS NULL) AS missing_city, count(*) FILTER (b AND is_paid_order = 1) AS paid_orders,
       count(*) FILTER (b AND order_gmv <= 0) AS zero_gmv_orders, count(DISTINCT order_id) AS distinct_orders,
       count(*) - count(DISTINCT order_id) AS duplicated_orders
FROM (SELECT *, purchase_date <= DATE '2001-07-31' AS b FROM cob)

-- @layer seen_payments
SELECT * FROM c_payments SEMI JOIN seen USING (order_id)

-- @query payment_source_reconcile
SELECT payment_type, count(*) AS payment_rows, count(DISTINCT order_id) AS orders, CAST(sum(payment_value) AS DOUBLE) AS payment_value,
       (SELECT count(*) FROM seen s LEFT JOIN order_paid p USING (order_id) WHERE abs(coalesce(amount, 0) - order_gmv) > 0.01) AS mismatched_orders,
       (SELECT CAST(sum(is_paid_order) AS BIGINT) FROM seen) AS paid_orders,
       (SELECT count(*) FROM seen JOIN order_paid USING (order_id) WHERE payment_types > 1) AS mixed_payment_orders
FROM seen_payments GROUP BY payment_type

-- @query installment_audit
SELECT payment_type, count(*) AS payment_rows, min(payment_installments) AS min_installments,
       quantile_cont(payment_installments::DOUBLE, 0.5) AS median_installments, max(payment_installments) AS max_installments,
       count(*) FILTER (payment_installments = 0) AS zero_installment_rows, count(*) FILTER (payment_installments = 1) AS one_installment_rows,
       count(*) FILTER (payment_installments > 1) AS multi_installment_rows, any_value(o) AS orders, any_value(g) AS groups_with_multiple_rows, any_value(a) AS ambiguous_groups
FROM seen_payments JOIN (SELECT payment_type, count(*) AS o, count(*) FILTER (n > 1) AS g, count(*) FILTER (d > 1) AS a FROM (
    SELECT payment_type, order_id, count(*) AS n, count(DISTINCT payment_installments) AS d FROM seen_payments GROUP BY ALL) GROUP BY ALL) USING (payment_type)
GROUP BY payment_type

-- @layer cohorts
SELECT cohort_month, purchase_month, count(DISTINCT customer_unique_id) AS active_users
FROM (SELECT *, min(purchase_month) OVER (PARTITION BY customer_unique_id) AS cohort_month FROM cob WHERE is_paid_order = 1) GROUP BY ALL

-- @layer cohort_rates
SELECT c.cohort_month, c.purchase_month AS active_month,
       date_diff('month', CAST(c.cohort_month || '-01' AS DATE), CAST(c.purchase_month || '-01' AS DATE)) AS cohort_index,
       s.active_users AS initial_users, c.active_users, half_up(c.active_users / s.active_users, 4) AS retention_rate
FROM cohorts c JOIN cohorts s ON s.cohort_month = c.cohort_month AND s.purchase_month = c.cohort_month

-- @query cohort_monthly
SELECT * FROM cohort_rates

-- @query cohort_matrix
SELECT * FROM (SELECT cohort_month, cohort_index, retention_rate FROM cohort_rates) PIVOT (max(retention_rate) FOR cohort_index IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 77, 78))

-- @layer two_orders
SELECT customer_unique_id, min(order_purchase_timestamp) FILTER (rn = 1) AS t1, min(order_purchase_timestamp) FILTER (rn = 2) AS t2
FROM (SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp, order_id) AS rn
      FROM cob WHERE is_paid_order = 1 AND order_purchase_timestamp <= TIMESTAMP '2001-07-31 23:59:59') GROUP BY ALL

-- @layer repeat_windows
SELECT d, count(*) AS total, count(*) FILTER (ok) AS seen_users, count(*) FILTER (NOT ok) AS cut,
       count(*) FILTER (ok AND t2 > t1 AND t2 - t1 <= to_days(d)) AS hits
FROM (SELECT *, t1 <= TIMESTAMP '2001-07-31 23:59:59' - to_days(d) AS ok FROM two_orders, (VALUES (7), (30), (90)) w(d)) GROUP BY d

-- @query short_term_repeat
SELECT any_value(total) AS total_users, any_value(seen_users) FILTER (d = 7) AS obs_7d, any_value(cut) FILTER (d = 7) AS excluded_7d, any_value(hits) FILTER (d = 7) AS repeat_7d,
       half_up(any_value(hits / seen_users) FILTER (d = 7), 4) AS repeat_rate_7d,
       any_value(seen_users) FILTER (d = 30) AS obs_30d, any_value(cut) FILTER (d = 30) AS excluded_30d, any_value(hits) FILTER (d = 30) AS repeat_30d,
       half_up(any_value(hits / seen_users) FILTER (d = 30), 4) AS repeat_rate_30d,
       any_value(seen_users) FILTER (d = 90) AS obs_90d, any_value(cut) FILTER (d = 90) AS excluded_90d, any_value(hits) FILTER (d = 90) AS repeat_90d,
       half_up(any_value(hits / seen_users) FILTER (d = 90), 4) AS repeat_rate_90d FROM repeat_windows

-- @query observation_windows
SELECT d || 'd' AS "window", TIMESTAMP '2001-07-31 23:59:59' AS observation_end, TIMESTAMP '2001-07-31 23:59:59' - to_days(d) AS latest_eligible_first_purchase,
       d::BIGINT AS window_days, seen_users AS eligible_users, cut AS excluded_users FROM repeat_windows

-- @layer life
SELECT *, CASE WHEN recency_days > 90 THEN 'Dormant Customer' WHEN valid_order_count = 1 THEN CASE WHEN recency_days <= 30 THEN 'New Customer' ELSE 'Early Customer' END
               WHEN customer_lifecycle_days <= 180 THEN 'Growing Customer' ELSE 'Mature Customer' END AS lifecycle_stage, '2001-07-31' AS observation_date
FROM (SELECT customer_unique_id, min(purchase_date) AS first_purchase_date, max(purchase_date) AS last_purchase_date, count(*) AS valid_order_count,
             sum(order_gmv) AS lifetime_gmv, date_diff('day', min(purchase_date), max(purchase_date)) AS customer_lifecycle_days,
             date_diff('day', max(purchase_date), DATE '2001-07-31') AS recency_days FROM seen GROUP BY customer_unique_id)

-- @query lifecycle_stage
SELECT * REPLACE (CAST(lifetime_gmv AS DOUBLE) AS lifetime_gmv) FROM life

-- @query lifecycle_comparison
SELECT lifecycle_stage, count(*) AS user_count, CAST(sum(valid_order_count) AS BIGINT) AS order_count, half_up(sum(lifetime_gmv), 2) AS gmv,
       half_up(CAST(sum(lifetime_gmv) AS DOUBLE) / count(*), 2) AS avg_customer_spend, half_up(CAST(sum(lifetime_gmv) AS DOUBLE) / CAST(sum(valid_order_count) AS DOUBLE), 2) AS gmv_per_valid_order,
       half_up(sum(valid_order_count) / count(*), 2) AS avg_purchase_frequency, count(*) FILTER (valid_order_count >= 2) AS repeat_users,
       half_up(count(*) FILTER (valid_order_count >= 2) / count(*), 4) AS repeat_rate, half_up(sum(customer_lifecycle_days) / count(*), 2) AS avg_lifecycle_days,
       half_up(sum(recency_days) / count(*), 2) AS avg_recency_days, half_up(count(*) / sum(count(*)) OVER (), 4) AS user_percentage
FROM life GROUP BY lifecycle_stage

-- @layer life_other
SELECT customer_unique_id, valid_order_count, lifecycle_micros / 86400000000.0::DOUBLE AS lifetime, r,
       CASE WHEN r > 90 THEN 'Dormant Customer' WHEN valid_order_count = 1 THEN CASE WHEN r <= 30 THEN 'New Customer' ELSE 'Early Customer' END
            WHEN lifecycle_micros <= 180 * 86400000000 THEN 'Growing Customer' ELSE 'Mature Customer' END AS other_stage
FROM (SELECT *, date_diff('microsecond', last_purchase_timestamp, (SELECT max(last_purchase_timestamp) FROM cprofile)) / 86400000000.0::DOUBLE AS r FROM cprofile)

-- @layer life_pairs
SELECT l.*, o.other_stage, CAST(floor(o.r) AS BIGINT) - l.recency_days AS dr, o.valid_order_count <> l.valid_order_count AS dn,
       CAST(floor(o.lifetime) AS BIGINT) <> l.customer_lifecycle_days AS dl
FROM life l LEFT JOIN life_other o ON o.customer_unique_id = l.customer_unique_id

-- @query lifecycle_diff
SELECT 'stage_crosstab' AS section, lifecycle_stage AS official, other_stage AS other, count(*) AS user_count FROM life_pairs GROUP BY ALL UNION ALL
SELECT 'recency_diff', NULL, dr::VARCHAR, count(*) FROM life_pairs GROUP BY ALL UNION ALL
SELECT 'order_count_differs', NULL, dn::VARCHAR, count(*) FROM life_pairs GROUP BY ALL UNION ALL
SELECT 'lifecycle_days_differ', NULL, dl::VARCHAR, count(*) FROM life_pairs GROUP BY ALL

-- @layer rfm_users
SELECT customer_unique_id, arg_max(customer_state, (order_purchase_timestamp, order_id)) AS customer_state, arg_max(customer_city, (order_purchase_timestamp, order_id)) AS customer_city,
       min(purchase_date) AS first_purchase_date, max(purchase_date) AS last_purchase_date, date_diff('day', max(purchase_date), DATE '2001-07-31') AS recency_days,
       count(*) AS frequency, CAST(sum(is_paid_order) AS BIGINT) AS paid_order_count, sum(order_gmv) AS monetary, CAST(count(*) >= 2 AS BIGINT) AS is_repeat_customer,
       arg_max(order_id, (order_purchase_timestamp, order_id)) AS latest_order_id, max(order_purchase_timestamp) AS latest_ts, '2001-07-31' AS observation_date
FROM seen GROUP BY customer_unique_id

-- @query rfm_base
SELECT * EXCLUDE (latest_order_id, latest_ts) REPLACE (CAST(monetary AS DOUBLE) AS monetary) FROM rfm_users

-- @layer rfm_cuts
SELECT metric, k, min(v) AS boundary_value FROM (
    SELECT metric, v, sum(n) OVER (PARTITION BY metric ORDER BY v) AS cum, sum(n) OVER (PARTITION BY metric) AS total
    FROM (SELECT metric, v, count(*) AS n FROM (SELECT unnest(['recency_days', 'monetary']) AS metric, unnest([recency_days::DOUBLE, monetary::DOUBLE]) AS v FROM rfm_users) GROUP BY ALL)),
    range(1, 5) r(k) WHERE cum * 5 >= total * k GROUP BY metric, k

-- @query rfm_boundaries
SELECT metric, 'P' || (k * 20) AS percentile_label, k / 5 AS percentile_value, boundary_value,
       CASE metric WHEN 'monetary' THEN 'higher_is_better' ELSE 'lower_is_better' END AS scoring_direction,
       'empirical_nearest_rank_on_customer_distribution' AS boundary_method FROM rfm_cuts

-- @layer rfm_freq
SELECT frequency, ntile(5) OVER (ORDER BY frequency) AS f_score FROM (SELECT DISTINCT frequency FROM rfm_users)

-- @query rfm_frequency_map
SELECT frequency, f_score, count(*) OVER (PARTITION BY f_score) AS distinct_values_in_score, 'NTILE(5) applied to distinct frequency values only' AS scoring_method FROM rfm_freq

-- @layer rfm
SELECT *, r_score + f_score + m_score AS rfm_score, r_score || '' || f_score || m_score AS rfm_code,
       ['重要价值用户', '重要发展用户', '重要保持用户', '重要挽留用户', '一般用户'][seg] AS rfm_segment, seg::BIGINT AS rfm_segment_order
FROM (SELECT *, CASE WHEN m_score < 4 THEN 5 WHEN r_score >= 4 THEN CASE WHEN f_score >= 4 THEN 1 ELSE 2 END ELSE CASE WHEN f_score >= 4 THEN 3 ELSE 4 END END AS seg
      FROM (SELECT u.*, 5 - (SELECT count(*) FROM rfm_cuts c WHERE c.metric = 'recency_days' AND u.recency_days > c.boundary_value) AS r_score, f.f_score,
                   1 + (SELECT count(*) FROM rfm_cuts c WHERE c.metric = 'monetary' AND u.monetary::DOUBLE > c.boundary_value) AS m_score
            FROM rfm_users u JOIN rfm_freq f ON f.frequency = u.frequency))

-- @query rfm_detail
SELECT * EXCLUDE (latest_order_id, latest_ts, seg) REPLACE (CAST(monetary AS DOUBLE) AS monetary) FROM rfm

-- @query rfm_score_distribution
SELECT g.metric, g.metric_order::BIGINT AS metric_order, s.score, count(x.score) AS user_count, count(x.score) / (SELECT count(*) FROM rfm) AS user_share
FROM (VALUES ('R', 1), ('F', 2), ('M', 3)) g(metric, metric_order) CROSS JOIN range(1, 6) s(score)
LEFT JOIN (SELECT unnest(['R', 'F', 'M']) AS metric, unnest([r_score, f_score, m_score]) AS score FROM rfm) x ON x.metric = g.metric AND x.score = s.score
GROUP BY ALL

-- @query rfm_segment_summary
SELECT k AS rfm_segment_order, ['重要价值用户', '重要发展用户', '重要保持用户', '重要挽留用户', '一般用户'][k] AS rfm_segment, count(r.frequency) AS user_count,
       CAST(coalesce(sum(frequency), 0) AS BIGINT) AS valid_order_count, CAST(coalesce(sum(paid_order_count), 0) AS BIGINT) AS paid_order_count,
       CAST(coalesce(sum(is_repeat_customer), 0) AS BIGINT) AS repeat_customer_count, CAST(coalesce(sum(monetary), 0) AS DOUBLE) AS gmv,
       count(r.frequency) / any_value(t.n) AS user_share, coalesce(sum(frequency), 0) / any_value(t.f) AS order_share,
       CAST(coalesce(sum(monetary), 0) AS DOUBLE) / CAST(any_value(t.m) AS DOUBLE) AS gmv_share,
       CAST(sum(monetary) AS DOUBLE) / nullif(count(r.frequency), 0) AS spend_per_user, CAST(sum(monetary) AS DOUBLE) / nullif(sum(paid_order_count), 0) AS average_order_value,
       CAST(sum(monetary) AS DOUBLE) / nullif(sum(frequency), 0) AS gmv_per_valid_order, sum(frequency) / nullif(count(r.frequency), 0) AS average_purchase_frequency,
       sum(is_repeat_customer) / nullif(count(r.frequency), 0) AS repeat_purchase_rate, sum(recency_days) / nullif(count(r.frequency), 0) AS average_recency,
       sum(frequency) / nullif(count(r.frequency), 0) AS average_frequency, CAST(sum(monetary) AS DOUBLE) / nullif(count(r.frequency), 0) AS average_monetary,
       sum(r_score) / nullif(count(r.frequency), 0) AS average_r_score, sum(f_score) / nullif(count(r.frequency), 0) AS average_f_score, sum(m_score) / nullif(count(r.frequency), 0) AS average_m_score
FROM range(1, 6) s(k) LEFT JOIN rfm r ON r.rfm_segment_order = k CROSS JOIN (SELECT count(*) AS n, sum(frequency) AS f, sum(monetary) AS m FROM rfm) t GROUP BY k
