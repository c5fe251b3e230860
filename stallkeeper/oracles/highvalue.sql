-- @layer value_users
SELECT customer_unique_id, latest_order_id, latest_ts AS latest_order_purchase_timestamp, customer_state AS profile_state, customer_city AS profile_city, recency_days, frequency, monetary,
       r_score, f_score, m_score, rfm_score, rfm_code, rfm_segment, observation_date, CAST(recency_days > 90 AS BIGINT) AS churn_flag,
       CAST(rfm_segment_order = 1 AS BIGINT) AS is_high_value_user, CAST(rfm_segment_order = 1 AND recency_days > 90 AS BIGINT) AS is_high_value_churn_user FROM rfm

-- @query rfm_churn_crosscheck
SELECT count(*) FILTER (r.customer_unique_id IS NOT NULL AND c.customer_unique_id IS NOT NULL) AS matched_users, count(*) FILTER (c.customer_unique_id IS NULL) AS only_rfm_users,
       count(*) FILTER (r.customer_unique_id IS NULL) AS only_churn_users, count(*) FILTER (recency <> recency_days) AS recency_mismatches,
       count(*) FILTER (rfm_segment_order = 1) AS high_value_users, count(*) FILTER (rfm_segment_order = 1 AND churn_flag = 1) AS high_value_churn_users,
       count(*) FILTER (rfm_segment_order = 1 AND churn_flag = 0) AS high_value_non_churn_users,
       count(*) FILTER (rfm_segment_order = 1 AND churn_flag = 1) / nullif(count(*) FILTER (rfm_segment_order = 1), 0) AS high_value_churn_rate
FROM rfm r FULL JOIN churners c ON c.customer_unique_id = r.customer_unique_id

-- @query user_value_base
SELECT * REPLACE (CAST(monetary AS DOUBLE) AS monetary) FROM value_users

-- @query high_value_users
SELECT * REPLACE (CAST(monetary AS DOUBLE) AS monetary), 1::BIGINT AS high_value_rule_ok, 1::BIGINT AS churn_rule_ok FROM value_users WHERE is_high_value_user = 1

-- @layer value_places
SELECT profile_state, profile_city, count(*) AS all_users, CAST(sum(monetary) AS DOUBLE) AS all_user_gmv, count(*) FILTER (is_high_value_user = 1) AS high_value_users,
       CAST(coalesce(sum(monetary) FILTER (is_high_value_user = 1), 0) AS DOUBLE) AS high_value_gmv, CAST(sum(is_high_value_churn_user) AS BIGINT) AS high_value_churn_users
FROM value_users GROUP BY GROUPING SETS ((profile_state), (profile_state, profile_city))

-- @layer value_totals
SELECT count(*)::DOUBLE AS u, count(*) FILTER (is_high_value_user = 1)::DOUBLE AS h, CAST(sum(monetary) AS DOUBLE) AS g, CAST(sum(monetary) FILTER (is_high_value_user = 1) AS DOUBLE) AS hg FROM value_users

-- @layer value_geo
SELECT p.*, all_users / u AS all_user_share, high_value_users / nullif(h, 0) AS high_value_user_share, high_value_users / all_users AS high_value_penetration,
       all_user_gmv / nullif(g, 0) AS all_gmv_share, high_value_gmv / nullif(hg, 0) AS high_value_gmv_share, high_value_users / nullif(h, 0) - all_users / u AS user_share_gap
FROM value_places p, value_totals

-- @query high_value_geography
SELECT * EXCLUDE (profile_city) FROM value_geo WHERE profile_city IS NULL

-- @query high_value_geography_city
SELECT * FROM value_geo WHERE profile_city IS NOT NULL

-- @layer pay_orders
SELECT s.customer_unique_id, customer_id, s.order_id, order_purchase_timestamp, customer_state, customer_city, order_gmv, is_paid_order, payment_rows AS payment_record_count,
       payment_types AS payment_type_count, m.payment_type AS main_payment_type, m.amount AS main_payment_type_value, m.n AS main_payment_type_record_count,
       r.payment_sequential AS representative_payment_sequential, r.payment_installments AS main_payment_installments, r.payment_value AS representative_payment_value,
       CASE WHEN r.payment_installments IS NULL THEN 'no_positive_payment' WHEN r.payment_installments = 0 THEN 'zero_installment_flag'
            WHEN r.payment_installments = 1 THEN 'one_time' ELSE 'installment' END AS installment_status,
       CAST(coalesce(payment_types > 1, false) AS BIGINT) AS is_mixed_payment_order
FROM seen s LEFT JOIN order_paid p ON p.order_id = s.order_id
LEFT JOIN (SELECT order_id, payment_type, sum(payment_value) AS amount, count(*) AS n FROM c_payments GROUP BY order_id, payment_type
           QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY sum(payment_value) DESC, payment_type) = 1) m ON m.order_id = s.order_id
LEFT JOIN (SELECT * FROM c_payments QUALIFY row_number() OVER (PARTITION BY order_id, payment_type ORDER BY payment_value DESC, payment_sequential, payment_installments) = 1) r
       ON r.order_id = m.order_id AND r.payment_type = m.payment_type

-- @query order_payment_base
SELECT * REPLACE (CAST(is_paid_order AS BIGINT) AS is_paid_order, CAST(order_gmv AS DOUBLE) AS order_gmv, CAST(main_payment_type_value AS DOUBLE) AS main_payment_type_value, CAST(representative_payment_value AS DOUBLE) AS representative_payment_value)
FROM pay_orders

-- @layer members
SELECT 'all_users' AS grp, customer_unique_id, frequency FROM value_users UNION ALL SELECT 'high_value_users', customer_unique_id, frequency FROM value_users WHERE is_high_value_user = 1

-- @query payment_behavior_groups
SELECT grp AS "group", CAST(count(*) AS BIGINT) AS orders, count(*) FILTER (is_paid_order = 1) AS paid_orders, CAST(coalesce(sum(order_gmv) FILTER (is_paid_order = 1), 0) AS DOUBLE) AS gmv,
       count(*) FILTER (installment_status = 'one_time') AS one_time_orders, count(*) FILTER (installment_status = 'installment') AS installment_orders,
       count(*) FILTER (installment_status = 'one_time') / nullif(count(*) FILTER (installment_status IN ('one_time', 'installment')), 0) AS one_time_share_valid,
       count(*) FILTER (installment_status = 'installment') / nullif(count(*) FILTER (installment_status IN ('one_time', 'installment')), 0) AS installment_share_valid,
       count(*) FILTER (installment_status = 'zero_installment_flag') AS zero_installment_orders, count(*) FILTER (is_mixed_payment_order = 1) AS mixed_payment_orders,
       count(*) FILTER (is_mixed_payment_order = 1) / nullif(count(*) FILTER (is_paid_order = 1), 0) AS mixed_payment_share, count(DISTINCT o.customer_unique_id) AS users,
       sum(main_payment_installments) / nullif(count(main_payment_installments), 0) AS average_main_payment_installments,
       quantile_cont(main_payment_installments::DOUBLE, 0.5) AS median_main_payment_installments
FROM members m JOIN pay_orders o ON o.customer_unique_id = m.customer_unique_id GROUP BY grp

-- @query payment_order_share_groups
SELECT grp AS "group", main_payment_type, count(*) AS orders, count(*) / sum(count(*)) OVER (PARTITION BY grp) AS order_share
FROM members m JOIN pay_orders o ON o.customer_unique_id = m.customer_unique_id WHERE is_paid_order = 1 GROUP BY grp, main_payment_type

-- @query payment_gmv_share_groups
SELECT grp AS "group", payment_type, CAST(sum(payment_value) AS DOUBLE) AS payment_gmv, CAST(sum(payment_value) AS DOUBLE) / CAST(sum(sum(payment_value)) OVER (PARTITION BY grp) AS DOUBLE) AS gmv_share
FROM members m JOIN seen s ON s.customer_unique_id = m.customer_unique_id JOIN c_payments p ON p.order_id = s.order_id GROUP BY grp, payment_type

-- @query order_experience_base
SELECT customer_unique_id, customer_id, order_id, order_purchase_timestamp, CAST(order_gmv AS DOUBLE) AS order_gmv, CAST(is_paid_order AS BIGINT) AS is_paid_order, order_delivered_customer_date,
       order_estimated_delivery_date, review_id AS representative_review_id, review_score AS representative_review_score, review_creation_date AS representative_review_creation_date,
       review_answer_timestamp AS representative_review_answer_timestamp, CAST(review_score IS NOT NULL AS BIGINT) AS has_valid_review, CAST(micros IS NOT NULL AS BIGINT) AS has_valid_delivery,
       micros / 86400000000.0::DOUBLE AS delivery_days, CAST(is_delayed IS NOT NULL AS BIGINT) AS has_valid_delay_measure, is_delayed FROM exp_orders

-- @query experience_groups
SELECT grp AS "group", count(DISTINCT o.customer_unique_id) AS users, count(*) AS orders, count(review_score) AS reviewed_orders, count(*) - count(review_score) AS excluded_review_orders,
       count(review_score) / count(*) AS review_coverage, sum(review_score) / nullif(count(review_score), 0) AS average_review_score, count(*) FILTER (review_score = 1) AS low_score_orders,
       count(*) FILTER (review_score = 1) / nullif(count(review_score), 0) AS low_score_order_share, count(*) FILTER (review_score >= 4) AS positive_review_orders,
       count(*) FILTER (review_score >= 4) / nullif(count(review_score), 0) AS positive_review_rate, count(micros) AS delivery_orders, count(*) - count(micros) AS excluded_delivery_orders,
       CAST(sum(micros) AS DOUBLE) / nullif(count(micros), 0) / 86400000000 AS average_delivery_days, count(is_delayed) AS delay_eligible_orders,
       CAST(coalesce(sum(is_delayed), 0) AS BIGINT) AS delayed_orders, sum(is_delayed) / nullif(count(is_delayed), 0) AS delay_rate
FROM members m JOIN exp_orders o ON o.customer_unique_id = m.customer_unique_id GROUP BY grp

-- @layer member_orders
SELECT grp, s.* FROM members m JOIN seen s ON s.customer_unique_id = m.customer_unique_id

-- @query consumption_groups
SELECT grp AS "group", count(DISTINCT customer_unique_id) AS users, count(*) AS valid_orders, CAST(sum(is_paid_order) AS BIGINT) AS paid_orders, CAST(sum(order_gmv) AS DOUBLE) AS gmv,
       CAST(sum(order_gmv) AS DOUBLE) / count(DISTINCT customer_unique_id) AS spend_per_user, CAST(sum(order_gmv) AS DOUBLE) / nullif(sum(is_paid_order), 0) AS average_order_value,
       count(*) / count(DISTINCT customer_unique_id) AS average_purchase_frequency, any_value(n) AS repeat_users, any_value(n) / count(DISTINCT customer_unique_id) AS repeat_rate,
       500000.0::DOUBLE AS high_amount_threshold, count(*) FILTER (order_gmv >= 500000) AS high_amount_orders, count(*) FILTER (order_gmv >= 500000) / nullif(sum(is_paid_order), 0) AS high_amount_order_share,
       CAST(coalesce(sum(order_gmv) FILTER (order_gmv >= 500000), 0) AS DOUBLE) AS high_amount_gmv,
       CAST(coalesce(sum(order_gmv) FILTER (order_gmv >= 500000), 0) AS DOUBLE) / CAST(sum(order_gmv) AS DOUBLE) AS high_amount_gmv_share
FROM member_orders JOIN (SELECT grp, count(*) FILTER (frequency >= 2) AS n FROM members GROUP BY grp) USING (grp) GROUP BY grp

-- @query consumption_value_bands
SELECT grp AS "group", CASE WHEN order_gmv < 50000 THEN '0-50000' WHEN order_gmv < 100000 THEN '50000-100000' WHEN order_gmv < 200000 THEN '100000-200000'
            WHEN order_gmv < 500000 THEN '200000-500000' ELSE '500000+' END AS order_value_band, count(*) AS orders, CAST(sum(order_gmv) AS DOUBLE) AS gmv,
       count(*) / sum(count(*)) OVER (PARTITION BY grp) AS order_share, CAST(sum(order_gmv) AS DOUBLE) / CAST(sum(sum(order_gmv)) OVER (PARTITION BY grp) AS DOUBLE) AS gmv_share
FROM member_orders WHERE is_paid_order = 1 GROUP BY 1, 2

-- @query consumption_hours
SELECT grp AS "group", purchase_hour, count(*) AS orders, CAST(sum(order_gmv) AS DOUBLE) AS gmv, count(*) / sum(count(*)) OVER (PARTITION BY grp) AS order_share
FROM member_orders GROUP BY grp, purchase_hour

-- @query consumption_day_type
SELECT grp AS "group", o.day_type, count(*) AS orders, CAST(sum(order_gmv) AS DOUBLE) AS gmv, days AS natural_days, count(*) / days AS avg_daily_orders,
       count(*) / sum(count(*)) OVER (PARTITION BY grp) AS order_share
FROM (SELECT *, CASE WHEN weekday_number >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type FROM member_orders) o
JOIN (SELECT CASE WHEN isodow(d) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, count(*) AS days
      FROM (SELECT unnest(generate_series((SELECT min(purchase_date) FROM seen), DATE '2001-07-31', INTERVAL 1 DAY)) AS d) GROUP BY 1) c ON c.day_type = o.day_type
GROUP BY grp, o.day_type, days

-- @query lifecycle_cross_detail
SELECT v.* REPLACE (CAST(monetary AS DOUBLE) AS monetary), first_purchase_date, last_purchase_date, valid_order_count AS lifecycle_valid_order_count, CAST(lifetime_gmv AS DOUBLE) AS lifecycle_gmv,
       customer_lifecycle_days AS lifecycle_days, l.recency_days AS lifecycle_recency_days, lifecycle_stage
FROM value_users v LEFT JOIN life l ON l.customer_unique_id = v.customer_unique_id WHERE is_high_value_user = 1

-- @query lifecycle_cross
SELECT lifecycle_stage, count(*) FILTER (hv) AS high_value_users, CAST(sum(is_high_value_churn_user) AS BIGINT) AS high_value_churn_users, CAST(coalesce(sum(frequency) FILTER (hv), 0) AS BIGINT) AS total_orders,
       CAST(coalesce(sum(monetary) FILTER (hv), 0) AS DOUBLE) AS total_gmv, sum(v.recency_days) FILTER (hv) / nullif(count(*) FILTER (hv), 0) AS avg_recency_days,
       sum(customer_lifecycle_days) FILTER (hv) / nullif(count(*) FILTER (hv), 0) AS avg_lifecycle_days, count(*) FILTER (hv) / nullif(sum(count(*) FILTER (hv)) OVER (), 0) AS high_value_user_share,
       count(*) FILTER (frequency IS DISTINCT FROM valid_order_count) AS frequency_mismatches, count(*) FILTER (monetary IS DISTINCT FROM lifetime_gmv) AS monetary_mismatches,
       count(*) FILTER (v.recency_days IS DISTINCT FROM l.recency_days) AS recency_mismatches, count(*) FILTER ((churn_flag = 1) <> (lifecycle_stage = 'Dormant Customer')) AS dormant_mismatches
FROM (SELECT *, is_high_value_user = 1 AS hv FROM value_users) v LEFT JOIN life l ON l.customer_unique_id = v.customer_unique_id GROUP BY lifecycle_stage

-- @layer hv_pay
SELECT o.* FROM pay_orders o SEMI JOIN (SELECT * FROM value_users WHERE is_high_value_user = 1) v ON v.customer_unique_id = o.customer_unique_id

-- @layer prof_pay
SELECT customer_unique_id, count(*) FILTER (is_paid_order = 1) AS paid_orders, CAST(coalesce(sum(order_gmv) FILTER (is_paid_order = 1), 0) AS DOUBLE) AS payment_gmv,
       CAST(sum(order_gmv) FILTER (is_paid_order = 1) AS DOUBLE) / nullif(count(*) FILTER (is_paid_order = 1), 0) AS average_order_value,
       sum(main_payment_installments) FILTER (main_payment_installments > 0) / nullif(count(*) FILTER (main_payment_installments > 0), 0) AS avg_main_payment_installments_valid,
       count(*) FILTER (installment_status = 'one_time') AS one_time_orders, count(*) FILTER (installment_status = 'installment') AS installment_orders,
       count(*) FILTER (installment_status = 'zero_installment_flag') AS zero_installment_orders, count(*) FILTER (is_mixed_payment_order = 1) AS mixed_payment_orders,
       any_value(d.t) AS dominant_main_payment_type, any_value(d.n) / nullif(count(*) FILTER (is_paid_order = 1), 0) AS dominant_payment_type_order_share
FROM hv_pay LEFT JOIN (SELECT customer_unique_id, arg_min(main_payment_type, (-n, main_payment_type)) AS t, max(n) AS n
    FROM (SELECT customer_unique_id, main_payment_type, count(*) AS n FROM hv_pay WHERE is_paid_order = 1 GROUP BY ALL) GROUP BY ALL) d USING (customer_unique_id)
GROUP BY customer_unique_id

-- @query payment_profile_user
SELECT * FROM prof_pay

-- @layer prof_exp
SELECT customer_unique_id, count(review_score) AS reviewed_orders, sum(review_score) / nullif(count(review_score), 0) AS average_review_score, count(*) FILTER (review_score = 1) AS low_score_orders,
       count(*) FILTER (review_score = 1) / nullif(count(review_score), 0) AS low_score_order_share, count(*) FILTER (review_score >= 4) / nullif(count(review_score), 0) AS positive_review_rate,
       count(micros) AS delivery_orders, CAST(sum(micros) AS DOUBLE) / nullif(count(micros), 0) / 86400000000 AS average_delivery_days, count(is_delayed) AS delay_eligible_orders,
       CAST(coalesce(sum(is_delayed), 0) AS BIGINT) AS delayed_orders, sum(is_delayed) / nullif(count(is_delayed), 0) AS delay_rate
FROM exp_orders SEMI JOIN (SELECT customer_unique_id FROM value_users WHERE is_high_value_user = 1) USING (customer_unique_id) GROUP BY customer_unique_id

-- @query experience_profile_user
SELECT * FROM prof_exp

-- @layer prof_use
SELECT customer_unique_id, count(*) AS valid_orders, 500000.0::DOUBLE AS high_amount_threshold, count(*) FILTER (order_gmv >= 500000) AS high_amount_orders,
       count(*) FILTER (order_gmv >= 500000) / nullif(sum(is_paid_order), 0) AS high_amount_order_share, count(*) FILTER (weekday_number <= 5) AS weekday_orders,
       count(*) FILTER (weekday_number > 5) AS weekend_orders, count(*) FILTER (weekday_number <= 5) / count(*) AS weekday_order_share,
       any_value(h) AS peak_purchase_hour, any_value(hn) AS peak_hour_orders
FROM member_orders JOIN (SELECT customer_unique_id, arg_min(purchase_hour, (-n, purchase_hour)) AS h, max(n) AS hn
    FROM (SELECT customer_unique_id, purchase_hour, count(*) AS n FROM seen GROUP BY ALL) GROUP BY ALL) USING (customer_unique_id)
WHERE grp = 'high_value_users' GROUP BY customer_unique_id

-- @query consumption_profile_user
SELECT * FROM prof_use

-- @query integrated_profile
SELECT v.* REPLACE (CAST(monetary AS DOUBLE) AS monetary), lifecycle_stage, customer_lifecycle_days AS lifecycle_days, p.* EXCLUDE (customer_unique_id), e.* EXCLUDE (customer_unique_id), c.* EXCLUDE (customer_unique_id)
FROM value_users v LEFT JOIN life l ON l.customer_unique_id = v.customer_unique_id LEFT JOIN prof_pay p ON p.customer_unique_id = v.customer_unique_id
LEFT JOIN prof_exp e ON e.customer_unique_id = v.customer_unique_id LEFT JOIN prof_use c ON c.customer_unique_id = v.customer_unique_id WHERE is_high_value_user = 1
