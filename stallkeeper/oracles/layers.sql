-- The commerce model over the driver tables, then the shared layers.
-- Each block is one common table expression; a query pulls in those it names.

-- @layer m_customers
SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id,
       lpad(CAST(c_nationkey * 10 + c_custkey % 8 AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
       c_mktsegment AS customer_city, n_name AS customer_state
FROM customer JOIN nation ON c_nationkey = n_nationkey

-- @layer m_geolocation
SELECT lpad(CAST(c_nationkey * 10 + c_custkey % 7 AS VARCHAR), 5, '0') AS geolocation_zip_code_prefix,
       CAST(c_nationkey AS DOUBLE) * 3 - 36 AS geolocation_lat,
       CAST(c_nationkey AS DOUBLE) * 7 - 90 AS geolocation_lng,
       c_mktsegment AS geolocation_city, n_name AS geolocation_state
FROM customer JOIN nation ON c_nationkey = n_nationkey

-- @layer m_products
SELECT p_partkey AS product_id,
       CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN '' ELSE p_brand END AS product_category_name,
       length(p_name) AS product_name_lenght, p_size * 10 AS product_description_lenght,
       p_size % 6 AS product_photos_qty,
       CASE WHEN p_size <> 1 THEN p_size * 100 END AS product_weight_g,
       p_size AS product_length_cm, p_size % 20 AS product_height_cm, p_size % 15 AS product_width_cm
FROM part

-- @layer m_translation
SELECT DISTINCT p_brand AS product_category_name,
       CASE WHEN p_brand = 'Brand#21' THEN ' '
            ELSE 'category_' || split_part(p_brand, '#', 2) END AS product_category_name_english
FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#13')

-- @layer m_sellers
SELECT s_suppkey AS seller_id,
       lpad(CAST(s_nationkey * 10 + s_suppkey % 9 AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
       'city_' || (s_suppkey % 10) AS seller_city, n_name AS seller_state
FROM supplier JOIN nation ON s_nationkey = n_nationkey

-- @layer m_shipping
SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM lineitem GROUP BY l_orderkey

-- @layer m_orders
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
       CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status,
       o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS order_purchase_timestamp,
       CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate + to_seconds((o_orderkey * 7919) % 86400)
            + to_hours(CAST(o_orderkey % 49 - 1 AS INTEGER)) END AS order_approved_at,
       first_ship AS order_delivered_carrier_date,
       CASE WHEN o_orderstatus = 'F' THEN last_ship + INTERVAL 12 HOUR END AS order_delivered_customer_date,
       o_orderdate + INTERVAL 1000 DAY AS order_estimated_delivery_date
FROM orders LEFT JOIN m_shipping ON l_orderkey = o_orderkey

-- @layer m_lines
SELECT *, l_linenumber AS line_key,
       CAST(l_quantity AS BIGINT) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS list_price
FROM lineitem

-- @layer m_numbered
SELECT *, CAST(row_number() OVER (
         PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax,
                  l_returnflag, l_linestatus) AS INTEGER) AS record_number
FROM m_lines

-- @layer m_items
SELECT l_orderkey AS order_id, line_key AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
       l_shipdate + INTERVAL 3 DAY AS shipping_limit_date, list_price AS price,
       CAST(list_price * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS freight_value
FROM m_lines

-- @layer m_payments
SELECT l_orderkey AS order_id, line_key AS payment_sequential,
       CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'boleto' ELSE 'voucher' END AS payment_type,
       qty % 13 AS payment_installments,
       CASE WHEN qty = 50 THEN 0 ELSE CAST(list_price * (1 - CAST(l_discount AS DECIMAL(4,2)))
            * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,2)) END AS payment_value
FROM m_lines

-- @layer m_item_records
SELECT l_orderkey AS order_id, record_number AS order_item_id, list_price AS price,
       CAST(list_price * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS freight_value
FROM m_numbered

-- @layer m_payment_records
SELECT l_orderkey AS order_id, record_number AS payment_sequential, qty % 13 AS payment_installments,
       CASE WHEN qty = 50 THEN 0 ELSE CAST(list_price * (1 - CAST(l_discount AS DECIMAL(4,2)))
            * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,2)) END AS payment_value
FROM m_numbered

-- @layer m_reviews
SELECT l_partkey * 8 + l_linenumber AS review_id, l_orderkey AS order_id,
       (l_linenumber + qty) % 6 AS review_score, CAST(NULL AS VARCHAR) AS review_comment_title,
       CASE WHEN (l_linenumber + qty) % 6 <= 2 THEN 'late item ' || (l_partkey % 10) END AS review_comment_message,
       l_shipdate AS review_creation_date,
       l_shipdate + to_days(CAST(1 + qty % 4 AS INTEGER)) AS review_answer_timestamp
FROM m_lines

-- @layer m_documents
SELECT d.doc_id AS order_id, d.lang AS category_name,
       CASE WHEN l.quality = 0 THEN 1 ELSE 5 END AS review_score, d.text AS review_comment_message
FROM documents d JOIN labels l ON l.doc_id = d.doc_id

-- @layer c_orders
SELECT o.*,
       CAST(order_approved_at IS NULL AS INT) AS is_missing_approval_timestamp,
       CAST(order_delivered_carrier_date IS NULL AS INT) AS is_missing_carrier_timestamp,
       CAST(order_delivered_customer_date IS NULL AS INT) AS is_missing_delivery_timestamp,
       CAST(coalesce(order_approved_at < order_purchase_timestamp, false)
            OR coalesce(order_delivered_carrier_date < order_approved_at, false)
            OR coalesce(order_delivered_customer_date < order_delivered_carrier_date, false)
            OR coalesce(order_delivered_customer_date < order_purchase_timestamp, false) AS INT) AS has_chronology_error
FROM m_orders o SEMI JOIN m_customers c ON c.customer_id = o.customer_id
WHERE order_id IS NOT NULL AND order_purchase_timestamp IS NOT NULL AND order_estimated_delivery_date IS NOT NULL

-- @layer c_delivery_days
SELECT *, date_diff('microsecond', order_purchase_timestamp, order_delivered_customer_date) AS delivery_micros,
       date_diff('microsecond', order_purchase_timestamp, order_delivered_customer_date) / 86400000000.0::DOUBLE AS delivery_days
FROM c_orders WHERE order_delivered_customer_date >= order_purchase_timestamp

-- @layer c_payments
SELECT * FROM m_payments p SEMI JOIN m_orders o ON o.order_id = p.order_id
WHERE payment_value > 0 AND payment_installments >= 0

-- @layer c_items
SELECT i.* FROM m_items i
SEMI JOIN m_orders o ON o.order_id = i.order_id
SEMI JOIN m_products p ON p.product_id = i.product_id
SEMI JOIN m_sellers s ON s.seller_id = i.seller_id
WHERE price >= 0 AND freight_value >= 0

-- @layer c_reviews
SELECT r.* FROM m_reviews r SEMI JOIN m_orders o ON o.order_id = r.order_id
WHERE review_score BETWEEN 1 AND 5

-- @layer rep_review
SELECT * FROM c_reviews
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY review_answer_timestamp DESC,
        review_creation_date DESC, review_id DESC, review_score DESC) = 1

-- @layer order_paid
SELECT order_id, sum(payment_value) AS amount, count(*) AS payment_rows, count(DISTINCT payment_type) AS payment_types
FROM c_payments GROUP BY order_id

-- @layer cob
SELECT customer_unique_id, o.customer_id, o.order_id, order_purchase_timestamp,
       CAST(order_purchase_timestamp AS DATE) AS purchase_date,
       strftime(order_purchase_timestamp, '%Y-%m') AS purchase_month,
       hour(order_purchase_timestamp) AS purchase_hour, isodow(order_purchase_timestamp) AS weekday_number,
       customer_state, customer_city, coalesce(amount, 0) AS order_gmv,
       CASE WHEN amount > 0 THEN 1 ELSE 0 END AS is_paid_order,
       order_delivered_customer_date, order_estimated_delivery_date
FROM c_orders o JOIN m_customers c ON c.customer_id = o.customer_id
LEFT JOIN order_paid p ON p.order_id = o.order_id
WHERE order_status = 'delivered'

-- @layer cprofile
SELECT customer_unique_id, min(order_purchase_timestamp) AS first_purchase_timestamp,
       max(order_purchase_timestamp) AS last_purchase_timestamp,
       min(purchase_month) AS first_purchase_month, max(purchase_month) AS latest_purchase_month,
       count(*) AS valid_order_count, sum(is_paid_order) AS paid_order_count, sum(order_gmv) AS lifetime_gmv,
       count(DISTINCT purchase_month) AS active_purchase_months,
       date_diff('microsecond', min(order_purchase_timestamp), max(order_purchase_timestamp)) AS lifecycle_micros,
       arg_max(customer_state, (order_purchase_timestamp, order_id, customer_id)) AS customer_state,
       arg_max(customer_city, (order_purchase_timestamp, order_id, customer_id)) AS customer_city
FROM cob GROUP BY customer_unique_id

-- @layer monthly
SELECT b.purchase_month AS month, sum(order_gmv) AS gmv, count(*) AS order_count,
       CAST(sum(order_gmv) AS DOUBLE) / count(*) AS average_order_value,
       coalesce(any_value(n.users), 0) AS new_users, count(DISTINCT customer_unique_id) AS active_users
FROM cob b LEFT JOIN (
    SELECT first_month, count(*) AS users FROM (
        SELECT min(purchase_month) AS first_month FROM cob WHERE is_paid_order = 1 GROUP BY customer_unique_id)
    GROUP BY first_month) n ON n.first_month = b.purchase_month
WHERE is_paid_order = 1 GROUP BY b.purchase_month

-- @layer month_calendar
SELECT strftime(unnest(generate_series(CAST(min(month) || '-01' AS TIMESTAMP),
       CAST(max(month) || '-01' AS TIMESTAMP), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM monthly

-- @layer delivered_users
SELECT o.order_id, o.customer_id, order_purchase_timestamp, customer_unique_id,
       strftime(order_purchase_timestamp, '%Y-%m') AS month
FROM c_orders o JOIN m_customers c ON c.customer_id = o.customer_id WHERE order_status = 'delivered'
