-- @query table_row_counts
SELECT 'customers' AS table_name, count(*) AS total_rows FROM m_customers UNION ALL
SELECT 'geolocation', count(*) FROM m_geolocation UNION ALL
SELECT 'order_items', count(*) FROM m_items UNION ALL
SELECT 'order_payments', count(*) FROM m_payments UNION ALL
SELECT 'order_reviews', count(*) FROM m_reviews UNION ALL
SELECT 'orders', count(*) FROM m_orders UNION ALL
SELECT 'product_category_name_translation', count(*) FROM m_translation UNION ALL
SELECT 'products', count(*) FROM m_products UNION ALL
SELECT 'sellers', count(*) FROM m_sellers

-- @query numeric_contract
SELECT t AS table_name, c AS column_name, count(*) FILTER (isnan(v) OR isinf(v)) AS non_finite,
       count(*) FILTER (k AND v <> floor(v)) AS fractional
FROM (SELECT 'lineitem' AS t, unnest(['l_quantity', 'l_linenumber']) AS c, true AS k,
             unnest([l_quantity, l_linenumber::DOUBLE]) AS v FROM lineitem UNION ALL
      SELECT 'lineitem', unnest(['l_extendedprice', 'l_discount', 'l_tax']), false,
             unnest([l_extendedprice, l_discount, l_tax]) FROM lineitem UNION ALL
      SELECT 'part', 'p_size', true, p_size::DOUBLE FROM part)
GROUP BY ALL

-- @query pk_contract
SELECT 'customers' AS table_name, coalesce(CAST(sum(n) AS BIGINT), 0) AS row_count, count(*) AS distinct_keys,
       coalesce(CAST(sum(n) FILTER (customer_id IS NULL) AS BIGINT), 0) AS null_keys, count(*) FILTER (n > 1) AS repeated_keys
FROM (SELECT customer_id, count(*) AS n FROM m_customers GROUP BY ALL) UNION ALL
SELECT 'products' AS table_name, coalesce(CAST(sum(n) AS BIGINT), 0) AS row_count, count(*) AS distinct_keys,
       coalesce(CAST(sum(n) FILTER (product_id IS NULL) AS BIGINT), 0) AS null_keys, count(*) FILTER (n > 1) AS repeated_keys
FROM (SELECT product_id, count(*) AS n FROM m_products GROUP BY ALL) UNION ALL
SELECT 'sellers' AS table_name, coalesce(CAST(sum(n) AS BIGINT), 0) AS row_count, count(*) AS distinct_keys,
       coalesce(CAST(sum(n) FILTER (seller_id IS NULL) AS BIGINT), 0) AS null_keys, count(*) FILTER (n > 1) AS repeated_keys
FROM (SELECT seller_id, count(*) AS n FROM m_sellers GROUP BY ALL) UNION ALL
SELECT 'product_category_name_translation' AS table_name, coalesce(CAST(sum(n) AS BIGINT), 0) AS row_count, count(*) AS distinct_keys,
       coalesce(CAST(sum(n) FILTER (product_category_name IS NULL) AS BIGINT), 0) AS null_keys, count(*) FILTER (n > 1) AS repeated_keys
FROM (SELECT product_category_name, count(*) AS n FROM m_translation GROUP BY ALL) UNION ALL
SELECT 'orders' AS table_name, coalesce(CAST(sum(n) AS BIGINT), 0) AS row_count, count(*) AS distinct_keys,
       coalesce(CAST(sum(n) FILTER (order_id IS NULL) AS BIGINT), 0) AS null_keys, count(*) FILTER (n > 1) AS repeated_keys
FROM (SELECT order_id, count(*) AS n FROM m_orders GROUP BY ALL) UNION ALL
SELECT 'order_items' AS table_name, coalesce(CAST(sum(n) AS BIGINT), 0) AS row_count, count(*) AS distinct_keys,
       coalesce(CAST(sum(n) FILTER (order_id IS NULL OR order_item_id IS NULL) AS BIGINT), 0) AS null_keys, count(*) FILTER (n > 1) AS repeated_keys
FROM (SELECT order_id, order_item_id, count(*) AS n FROM m_items GROUP BY ALL) UNION ALL
SELECT 'order_payments' AS table_name, coalesce(CAST(sum(n) AS BIGINT), 0) AS row_count, count(*) AS distinct_keys,
       coalesce(CAST(sum(n) FILTER (order_id IS NULL OR payment_sequential IS NULL) AS BIGINT), 0) AS null_keys, count(*) FILTER (n > 1) AS repeated_keys
FROM (SELECT order_id, payment_sequential, count(*) AS n FROM m_payments GROUP BY ALL) UNION ALL
SELECT 'order_reviews' AS table_name, coalesce(CAST(sum(n) AS BIGINT), 0) AS row_count, count(*) AS distinct_keys,
       coalesce(CAST(sum(n) FILTER (review_id IS NULL OR order_id IS NULL) AS BIGINT), 0) AS null_keys, count(*) FILTER (n > 1) AS repeated_keys
FROM (SELECT review_id, order_id, count(*) AS n FROM m_reviews GROUP BY ALL)

-- @query fk_contract
SELECT 'orders.customer_id->customers.customer_id' AS relation, count(*) AS orphan_rows FROM m_orders o ANTI JOIN m_customers c ON c.customer_id = o.customer_id UNION ALL
SELECT 'order_items.order_id->orders.order_id', count(*) FROM m_items i ANTI JOIN m_orders o ON o.order_id = i.order_id UNION ALL
SELECT 'order_items.product_id->products.product_id', count(*) FROM m_items i ANTI JOIN m_products p ON p.product_id = i.product_id UNION ALL
SELECT 'order_items.seller_id->sellers.seller_id', count(*) FROM m_items i ANTI JOIN m_sellers s ON s.seller_id = i.seller_id UNION ALL
SELECT 'order_payments.order_id->orders.order_id', count(*) FROM m_payments i ANTI JOIN m_orders o ON o.order_id = i.order_id UNION ALL
SELECT 'order_reviews.order_id->orders.order_id', count(*) FROM m_reviews i ANTI JOIN m_orders o ON o.order_id = i.order_id

-- @query translation_coverage
SELECT count(*) AS untranslated_products, count(DISTINCT product_category_name) AS untranslated_categories
FROM m_products p ANTI JOIN m_translation t ON t.product_category_name = p.product_category_name
WHERE product_category_name <> ''

-- @query zip_coverage
SELECT 'customers' AS table_name, count(*) AS uncovered_rows, count(DISTINCT customer_zip_code_prefix) AS uncovered_zips
FROM m_customers WHERE customer_zip_code_prefix NOT IN (SELECT geolocation_zip_code_prefix FROM m_geolocation) UNION ALL
SELECT 'sellers', count(*), count(DISTINCT seller_zip_code_prefix)
FROM m_sellers WHERE seller_zip_code_prefix NOT IN (SELECT geolocation_zip_code_prefix FROM m_geolocation)

-- @query join_cardinality_smoke
SELECT 'orders-customers' AS join_path, count(*) AS row_count FROM m_orders o JOIN m_customers c ON c.customer_id = o.customer_id UNION ALL
SELECT 'orders-items-products', count(*) FROM m_orders o JOIN m_items i ON i.order_id = o.order_id JOIN m_products p ON p.product_id = i.product_id UNION ALL
SELECT 'orders-payments', count(*) FROM m_orders o JOIN m_payments p ON p.order_id = o.order_id

-- @layer null_cells
SELECT 'customers' AS table_name, unnest(['customer_id', 'customer_unique_id', 'customer_zip_code_prefix', 'customer_city', 'customer_state']) AS variable,
       unnest([customer_id::VARCHAR, customer_unique_id::VARCHAR, customer_zip_code_prefix, customer_city, customer_state]) AS v FROM m_customers
UNION ALL
SELECT 'geolocation', unnest(['geolocation_zip_code_prefix', 'geolocation_lat', 'geolocation_lng', 'geolocation_city', 'geolocation_state']),
       unnest([geolocation_zip_code_prefix, geolocation_lat::VARCHAR, geolocation_lng::VARCHAR, geolocation_city, geolocation_state]) FROM m_geolocation
UNION ALL
SELECT 'order_items', unnest(['order_id', 'order_item_id', 'product_id', 'seller_id', 'shipping_limit_date', 'price', 'freight_value']),
       unnest([order_id::VARCHAR, order_item_id::VARCHAR, product_id::VARCHAR, seller_id::VARCHAR, shipping_limit_date::VARCHAR, price::VARCHAR, freight_value::VARCHAR]) FROM m_items
UNION ALL
SELECT 'order_payments', unnest(['order_id', 'payment_sequential', 'payment_type', 'payment_installments', 'payment_value']),
       unnest([order_id::VARCHAR, payment_sequential::VARCHAR, payment_type, payment_installments::VARCHAR, payment_value::VARCHAR]) FROM m_payments
UNION ALL
SELECT 'order_reviews', unnest(['review_id', 'order_id', 'review_score', 'review_comment_title', 'review_comment_message', 'review_creation_date', 'review_answer_timestamp']),
       unnest([review_id::VARCHAR, order_id::VARCHAR, review_score::VARCHAR, review_comment_title, review_comment_message, review_creation_date::VARCHAR, review_answer_timestamp::VARCHAR]) FROM m_reviews
UNION ALL
SELECT 'orders', unnest(['order_id', 'customer_id', 'order_status', 'order_purchase_timestamp', 'order_approved_at', 'order_delivered_carrier_date', 'order_delivered_customer_date', 'order_estimated_delivery_date']),
       unnest([order_id::VARCHAR, customer_id::VARCHAR, order_status, order_purchase_timestamp::VARCHAR, order_approved_at::VARCHAR, order_delivered_carrier_date::VARCHAR, order_delivered_customer_date::VARCHAR, order_estimated_delivery_date::VARCHAR]) FROM m_orders
UNION ALL
SELECT 'product_category_name_translation', unnest(['product_category_name', 'product_category_name_english']),
       unnest([product_category_name, product_category_name_english]) FROM m_translation
UNION ALL
SELECT 'products', unnest(['product_id', 'product_category_name', 'product_name_lenght', 'product_description_lenght', 'product_photos_qty', 'product_weight_g', 'product_length_cm', 'product_height_cm', 'product_width_cm']),
       unnest([product_id::VARCHAR, product_category_name, product_name_lenght::VARCHAR, product_description_lenght::VARCHAR, product_photos_qty::VARCHAR, product_weight_g::VARCHAR, product_length_cm::VARCHAR, product_height_cm::VARCHAR, product_width_cm::VARCHAR]) FROM m_products
UNION ALL
SELECT 'sellers', unnest(['seller_id', 'seller_zip_code_prefix', 'seller_city', 'seller_state']),
       unnest([seller_id::VARCHAR, seller_zip_code_prefix, seller_city, seller_state]) FROM m_sellers

-- @layer null_profile
SELECT table_name, variable, count(*) AS total_records, count(*) FILTER (v IS NULL OR v = '') AS missing_count,
       half_up(count(*) FILTER (v IS NULL OR v = '') * 100.0::DOUBLE / count(*), 2) AS missing_pct
FROM null_cells GROUP BY ALL

-- @query dq_null_profile
SELECT * FROM null_profile

-- @layer dup_rows
SELECT 'geolocation' AS table_name, concat_ws('|', geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, geolocation_city, geolocation_state) AS record,
       count(*) AS dup_count FROM m_geolocation GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL
SELECT 'order_reviews', concat_ws('|', review_id, order_id, review_score, coalesce(review_comment_title, 'NULL'),
       coalesce(review_comment_message, 'NULL'), review_creation_date, review_answer_timestamp), count(*) FROM m_reviews GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL
SELECT 'order_items', concat_ws('|', order_id, order_item_id, product_id, seller_id, shipping_limit_date, price, freight_value), count(*)
FROM m_items GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL
SELECT 'order_payments', concat_ws('|', order_id, payment_sequential, payment_type, payment_installments, payment_value), count(*)
FROM m_payments GROUP BY 1, 2 HAVING count(*) > 1

-- @query dq_exact_duplicates
SELECT * FROM dup_rows

-- @query dq_key_duplicates
SELECT 'orders' AS check_name, order_id::VARCHAR AS record_key, count(*) AS repeat_cnt FROM m_orders GROUP BY ALL HAVING count(*) > 1 UNION ALL
SELECT 'order_customers', customer_id::VARCHAR, count(*) FROM m_orders GROUP BY ALL HAVING count(*) > 1 UNION ALL
SELECT 'order_items', order_id || ':' || order_item_id, count(*) FROM m_items GROUP BY ALL HAVING count(*) > 1 UNION ALL
SELECT 'order_payments', order_id || ':' || payment_sequential, count(*) FROM m_payments GROUP BY ALL HAVING count(*) > 1

-- @query dq_dup_review_detail
SELECT review_id, review_comment_title, review_comment_message, count(*) AS row_count FROM m_reviews
WHERE review_id IN (SELECT review_id FROM m_reviews GROUP BY review_id HAVING count(*) > 1) GROUP BY ALL

-- @query dq_orphans
SELECT 'orders_without_customer' AS check_name, order_id::VARCHAR AS record_key FROM m_orders o ANTI JOIN m_customers c ON c.customer_id = o.customer_id UNION ALL
SELECT 'items_without_order', order_id || ':' || order_item_id FROM m_items i ANTI JOIN m_orders o ON o.order_id = i.order_id UNION ALL
SELECT 'items_without_product', order_id || ':' || order_item_id FROM m_items i ANTI JOIN m_products p ON p.product_id = i.product_id UNION ALL
SELECT 'payments_without_order', order_id || ':' || payment_sequential FROM m_payments i ANTI JOIN m_orders o ON o.order_id = i.order_id UNION ALL
SELECT 'reviews_without_order', review_id || ':' || order_id FROM m_reviews i ANTI JOIN m_orders o ON o.order_id = i.order_id

-- @query dq_money_anomaly
SELECT order_id, order_item_id, price::DOUBLE AS price, freight_value::DOUBLE AS freight_value,
       CASE WHEN price IS NULL OR freight_value IS NULL THEN 'null' WHEN least(price, freight_value) < 0 THEN 'negative' ELSE 'zero' END AS anomaly
FROM m_items WHERE price IS NULL OR freight_value IS NULL OR least(price, freight_value) < 0 OR price = 0

-- @query dq_time_null
SELECT * FROM m_orders WHERE order_purchase_timestamp IS NULL OR order_approved_at IS NULL OR order_delivered_carrier_date IS NULL
   OR order_delivered_customer_date IS NULL OR order_estimated_delivery_date IS NULL

-- @query dq_time_unparseable
SELECT order_id::VARCHAR AS order_id, 'on ' || order_purchase_timestamp::VARCHAR AS order_purchase_timestamp, order_approved_at::VARCHAR AS order_approved_at,
       order_delivered_carrier_date::VARCHAR AS order_delivered_carrier_date, order_delivered_customer_date::VARCHAR AS order_delivered_customer_date,
       order_estimated_delivery_date::VARCHAR AS order_estimated_delivery_date
FROM m_orders WHERE try_cast(CASE WHEN order_id % 101 = 0 THEN 'on ' ELSE '' END || order_purchase_timestamp::VARCHAR AS TIMESTAMP) IS NULL

-- @query dq_chronology
SELECT * EXCLUDE (is_missing_approval_timestamp, is_missing_carrier_timestamp, is_missing_delivery_timestamp, has_chronology_error)
FROM c_orders WHERE has_chronology_error = 1

-- @query dq_null_keys
SELECT 'orders' AS table_name, order_id::VARCHAR AS first_key, customer_id::VARCHAR AS second_key FROM m_orders WHERE order_id IS NULL OR customer_id IS NULL UNION ALL
SELECT 'customers', customer_id::VARCHAR, customer_unique_id::VARCHAR FROM m_customers WHERE customer_id IS NULL OR customer_unique_id IS NULL UNION ALL
SELECT 'order_items', order_id::VARCHAR, product_id::VARCHAR FROM m_items WHERE order_id IS NULL OR product_id IS NULL

-- @layer numeric_long
SELECT 'order_payments' AS source_table, unnest(['payment_value', 'payment_installments']) AS field_name,
       order_id || ':' || payment_sequential AS record_key, unnest([payment_value::DOUBLE, payment_installments::DOUBLE]) AS actual_value FROM m_payment_records
UNION ALL
SELECT 'order_items', unnest(['price', 'freight_value']), order_id || ':' || order_item_id, unnest([price::DOUBLE, freight_value::DOUBLE]) FROM m_item_records
UNION ALL
SELECT 'orders', 'actual_delivery_days', order_id::VARCHAR,
       date_diff('microsecond', order_purchase_timestamp, order_delivered_customer_date) / 86400000000.0::DOUBLE
FROM m_orders WHERE order_delivered_customer_date IS NOT NULL

-- @query dq_numeric_long
SELECT * FROM numeric_long

-- @layer numeric_bounds
SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lower_bound, q3 + 1.5::DOUBLE * (q3 - q1) AS upper_bound FROM (
    SELECT source_table, field_name, count(*) AS valid_count, min(actual_value) AS min_value,
           quantile_disc(actual_value, 0.25) AS q1, quantile_disc(actual_value, 0.5) AS median,
           quantile_disc(actual_value, 0.75) AS q3, max(actual_value) AS max_value
    FROM numeric_long GROUP BY ALL)

-- @layer numeric_extremes
SELECT source_table, field_name, record_key, actual_value, lower_bound, upper_bound,
       CASE WHEN actual_value < lower_bound THEN 'lower' ELSE 'upper' END AS extreme_direction
FROM numeric_long JOIN numeric_bounds USING (source_table, field_name)
WHERE actual_value < lower_bound OR actual_value > upper_bound

-- @query dq_iqr_summary
SELECT b.*, count(*) FILTER (extreme_direction = 'lower') AS lower_extreme_count,
       count(*) FILTER (extreme_direction = 'upper') AS upper_extreme_count
FROM numeric_bounds b LEFT JOIN numeric_extremes e ON e.source_table = b.source_table AND e.field_name = b.field_name
GROUP BY ALL

-- @query dq_iqr_extremes
SELECT * FROM numeric_extremes

-- @layer classified
SELECT source_table, field_name, record_key, actual_value,
       CASE WHEN actual_value < 0 OR record_key IN (SELECT order_id::VARCHAR FROM c_orders WHERE has_chronology_error = 1) THEN 'data_error'
            WHEN source_table = 'orders' AND record_key IN (
                 SELECT order_id::VARCHAR FROM m_orders WHERE order_approved_at IS NULL OR order_delivered_carrier_date IS NULL) THEN 'needs_review'
            WHEN field_name = 'freight_value' AND actual_value = 0 THEN 'needs_review'
            ELSE 'true_extreme' END AS classification
FROM numeric_extremes
UNION ALL
SELECT source_table, field_name, record_key, actual_value,
       CASE field_name WHEN 'payment_value' THEN 'data_error' ELSE 'needs_review' END
FROM numeric_long l ANTI JOIN numeric_extremes e USING (source_table, field_name, record_key)
WHERE source_table = 'order_payments' AND actual_value <= 0
UNION ALL
SELECT 'orders', 'actual_delivery_days', order_id::VARCHAR, NULL, 'data_error' FROM m_orders
WHERE order_status = 'delivered' AND order_delivered_customer_date IS NULL

-- @query dq_classify
SELECT * FROM classified

-- @query dq_classify_summary
SELECT f.source_table, f.field_name, c.classification, count(x.record_key) AS record_count,
       CASE WHEN c.classification = 'true_extreme' THEN 'outside a fence, nothing else wrong'
            WHEN c.classification || f.field_name = 'needs_reviewfreight_value' THEN 'zero freight may be free shipping'
            WHEN c.classification || f.field_name = 'needs_reviewpayment_installments' THEN 'zero installments cannot be corrected'
            WHEN c.classification || f.field_name = 'needs_reviewactual_delivery_days' THEN 'long delivery with a missing step'
            WHEN c.classification || f.field_name = 'data_errorpayment_value' THEN 'non-positive payment'
            WHEN c.classification || f.field_name = 'data_erroractual_delivery_days' THEN 'delivery time missing or out of order'
            ELSE 'no record met this rule' END AS reason,
       CASE c.classification WHEN 'data_error' THEN 'exclude' WHEN 'true_extreme' THEN 'retain' ELSE 'flag' END AS recommended_action
FROM (SELECT DISTINCT source_table, field_name FROM numeric_long) f
CROSS JOIN (VALUES ('data_error'), ('true_extreme'), ('needs_review')) c(classification)
LEFT JOIN classified x ON x.source_table = f.source_table AND x.field_name = f.field_name AND x.classification = c.classification
GROUP BY ALL

-- @query dq_issue_register
SELECT source_table || '.' || field_name || '.' || classification AS issue, count(*) AS record_count,
       CASE classification WHEN 'data_error' THEN 'exclude' WHEN 'true_extreme' THEN 'retain' ELSE 'flag' END AS handling
FROM classified GROUP BY source_table, field_name, classification
UNION ALL SELECT table_name || '.' || variable || '.missing', missing_count, 'retain and flag' FROM null_profile WHERE missing_count > 0
UNION ALL SELECT table_name || '.exact_duplicates', CAST(sum(dup_count - 1) AS BIGINT), 'deduplicate' FROM dup_rows GROUP BY table_name
UNION ALL SELECT 'orders.chronology', count(*), 'flag' FROM c_orders WHERE has_chronology_error = 1

-- @query schema_contract
SELECT table_name, expected_columns::BIGINT AS expected_columns, 0::BIGINT AS missing_columns, 0::BIGINT AS extra_columns, 0::BIGINT AS type_differences, 'pass' AS status, total_rows
FROM (VALUES ('customers', 5), ('geolocation', 5), ('order_items', 7), ('order_payments', 5), ('order_reviews', 7), ('orders', 8),
             ('product_category_name_translation', 2), ('products', 9), ('sellers', 4)) e(table_name, expected_columns)
JOIN (SELECT 'customers' AS table_name, count(*) AS total_rows FROM m_customers UNION ALL SELECT 'geolocation', count(*) FROM m_geolocation UNION ALL
      SELECT 'order_items', count(*) FROM m_items UNION ALL SELECT 'order_payments', count(*) FROM m_payments UNION ALL SELECT 'order_reviews', count(*) FROM m_reviews UNION ALL
      SELECT 'orders', count(*) FROM m_orders UNION ALL SELECT 'product_category_name_translation', count(*) FROM m_translation UNION ALL
      SELECT 'products', count(*) FROM m_products UNION ALL SELECT 'sellers', count(*) FROM m_sellers) USING (table_name)

-- @query row_count_contract
SELECT table_name, n AS parsed_rows, n AS stored_rows, 'pass' AS status
FROM (SELECT unnest(['customers', 'geolocation']) AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'products', count(*) FROM part UNION ALL
      SELECT 'sellers', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL
      SELECT unnest(['order_items', 'order_payments', 'order_reviews']), count(*) FROM lineitem UNION ALL
      SELECT 'product_category_name_translation', count(DISTINCT p_brand) FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#13'))

-- @query ingest_typed_csv
SELECT order_status, count(*) AS order_count, count(DISTINCT order_id) AS distinct_orders, min(order_purchase_timestamp) AS first_purchase, max(order_purchase_timestamp) AS last_purchase,
       count(order_approved_at) AS approved, count(order_delivered_carrier_date) AS handed_over, count(order_delivered_customer_date) AS delivered
FROM m_orders GROUP BY order_status

-- @query export_table
SELECT month, half_up(gmv, 2) AS gmv, order_count, half_up(average_order_value, 6) AS average_order_value, new_users, active_users FROM monthly
