-- @query clean_orders
SELECT order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at,
       order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date,
       CAST(is_missing_approval_timestamp AS BIGINT) AS is_missing_approval_timestamp,
       CAST(is_missing_carrier_timestamp AS BIGINT) AS is_missing_carrier_timestamp,
       CAST(is_missing_delivery_timestamp AS BIGINT) AS is_missing_delivery_timestamp,
       CAST(has_chronology_error AS BIGINT) AS has_chronology_error
FROM c_orders

-- @query clean_delivery
SELECT order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at,
       order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date, delivery_days,
       CAST(has_chronology_error AS BIGINT) AS has_intermediate_chronology_error,
       CAST(delivery_days NOT BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS BIGINT) AS is_delivery_iqr_extreme
FROM c_delivery_days, (SELECT quantile_disc(delivery_days, 0.25) AS q1, quantile_disc(delivery_days, 0.75) AS q3 FROM c_delivery_days)

-- @query clean_payments
SELECT order_id, payment_sequential, payment_type, payment_installments, CAST(payment_value AS DOUBLE) AS payment_value,
       CAST(payment_installments = 0 AS BIGINT) AS needs_installment_review,
       CAST(CAST(payment_value AS DOUBLE) NOT BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS BIGINT) AS is_payment_value_iqr_extreme
FROM c_payments, (SELECT quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3
                  FROM (SELECT CAST(payment_value AS DOUBLE) AS v FROM m_payments))

-- @query clean_items
SELECT order_id, order_item_id, product_id, seller_id, shipping_limit_date,
       CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value,
       CAST(CAST(price AS DOUBLE) NOT BETWEEN p1 - 1.5::DOUBLE * (p3 - p1) AND p3 + 1.5::DOUBLE * (p3 - p1) AS BIGINT) AS is_price_iqr_extreme,
       CAST(CAST(freight_value AS DOUBLE) NOT BETWEEN f1 - 1.5::DOUBLE * (f3 - f1) AND f3 + 1.5::DOUBLE * (f3 - f1) AS BIGINT) AS is_freight_iqr_extreme,
       CAST(freight_value = 0 AS BIGINT) AS needs_zero_freight_review
FROM c_items, (SELECT quantile_disc(p, 0.25) AS p1, quantile_disc(p, 0.75) AS p3,
                      quantile_disc(f, 0.25) AS f1, quantile_disc(f, 0.75) AS f3
               FROM (SELECT CAST(price AS DOUBLE) AS p, CAST(freight_value AS DOUBLE) AS f FROM m_items))

-- @query dedup_geolocation
SELECT DISTINCT * FROM m_geolocation

-- @query clean_reviews
SELECT review_id, order_id, review_score, review_comment_title, review_comment_message,
       review_creation_date, review_answer_timestamp FROM c_reviews

-- @query representative_review
SELECT review_id, order_id, review_score, review_comment_title, review_comment_message,
       review_creation_date, review_answer_timestamp FROM rep_review
