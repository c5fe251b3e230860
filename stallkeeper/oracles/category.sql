-- @layer citems
SELECT i.order_id, order_item_id, i.product_id, coalesce(nullif(trim(product_category_name_english), ''), 'unknown') AS category_name,
       order_purchase_timestamp AS purchase_timestamp, strftime(order_purchase_timestamp, '%Y-%m') AS purchase_month, price, freight_value
FROM c_items i JOIN c_orders o ON o.order_id = i.order_id AND order_status = 'delivered' JOIN m_products p ON p.product_id = i.product_id
LEFT JOIN m_translation t ON t.product_category_name = p.product_category_name

-- @query category_item_base
SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value) FROM citems

-- @layer corders
SELECT order_id, category_name, purchase_month, count(*) AS category_item_count, sum(price) AS amount FROM citems GROUP BY ALL

-- @query category_order_base
SELECT order_id, category_name, purchase_month, category_item_count, CAST(amount AS DOUBLE) AS category_sales_amount FROM corders

-- @layer csales
SELECT category_name, sum(amount) AS sales, count(*) AS orders, CAST(sum(category_item_count) AS BIGINT) AS items, sum(sum(amount)) OVER () AS total,
       row_number() OVER (ORDER BY sum(amount) DESC, category_name) AS sales_rank FROM corders GROUP BY category_name

-- @layer csales_table
SELECT category_name, CAST(sales AS DOUBLE) AS sales_amount, CAST(sales AS DOUBLE) / CAST(total AS DOUBLE) AS sales_share, orders AS category_order_count, items AS item_count,
       CAST(sales AS DOUBLE) / items AS avg_item_price, items / orders AS items_per_order, sales_rank FROM csales

-- @query category_sales
SELECT * FROM csales_table

-- @layer cmonths
SELECT purchase_month, category_name, sum(amount) AS sales, count(*) AS orders, CAST(sum(category_item_count) AS BIGINT) AS items FROM corders GROUP BY ALL

-- @query category_monthly_sales
SELECT purchase_month, category_name, CAST(sales AS DOUBLE) AS monthly_sales_amount, orders AS monthly_order_count, items AS monthly_item_count,
       CAST(sales AS DOUBLE) / items AS avg_item_price, items / orders AS items_per_order FROM cmonths

-- @query category_pareto
SELECT category_name, CAST(sales AS DOUBLE) AS sales_amount, CAST(sales AS DOUBLE) / CAST(total AS DOUBLE) AS sales_share, CAST(cum AS DOUBLE) AS cumulative_sales_amount,
       CAST(cum AS DOUBLE) / CAST(total AS DOUBLE) AS cumulative_sales_share, sales_rank, CASE WHEN (cum - sales) * 100 < total * 80 THEN 'head' ELSE 'long_tail' END AS category_type
FROM (SELECT *, sum(sales) OVER (ORDER BY sales_rank) AS cum FROM csales)

-- @query category_mom
SELECT a.purchase_month, a.category_name, CAST(a.sales AS DOUBLE) AS monthly_sales_amount, (CAST(a.sales AS DOUBLE) - CAST(b.sales AS DOUBLE)) / CAST(nullif(b.sales, 0) AS DOUBLE) AS sales_mom_growth,
       a.orders AS monthly_order_count, (a.orders - b.orders) / nullif(b.orders, 0) AS order_mom_growth, a.items AS monthly_item_count, (a.items - b.items) / nullif(b.items, 0) AS item_mom_growth
FROM cmonths a LEFT JOIN cmonths b ON b.category_name = a.category_name
     AND b.purchase_month = strftime(CAST(a.purchase_month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')
WHERE a.purchase_month BETWEEN '1995-01' AND '2001-07'

-- @layer cgrowth
SELECT level, category_name, start_month, end_month, start_sales, end_sales, n AS month_diff,
       half_up(CASE WHEN start_sales > 0 AND n > 0 AND (level = 'platform' OR (start_month = '1995-01' AND end_month = '2001-07')) THEN pow(end_sales / start_sales, 1.0::DOUBLE / n) - 1 END, 9) AS category_cmgr
FROM (SELECT *, date_diff('month', CAST(start_month || '-01' AS DATE), CAST(end_month || '-01' AS DATE)) AS n
      FROM (SELECT CASE WHEN grouping(category_name) = 1 THEN 'platform' ELSE 'category' END AS level, coalesce(category_name, 'ALL') AS category_name,
                   min(purchase_month) AS start_month, max(purchase_month) AS end_month,
                   CAST(CASE WHEN grouping(category_name) = 1 THEN sum(sales) FILTER (purchase_month = all_lo) ELSE sum(sales) FILTER (purchase_month = lo) END AS DOUBLE) AS start_sales,
                   CAST(CASE WHEN grouping(category_name) = 1 THEN sum(sales) FILTER (purchase_month = all_hi) ELSE sum(sales) FILTER (purchase_month = hi) END AS DOUBLE) AS end_sales
            FROM (SELECT *, CAST(min(purchase_month) OVER (PARTITION BY category_name) AS VARCHAR) AS lo, max(purchase_month) OVER (PARTITION BY category_name) AS hi,
                         min(purchase_month) OVER () AS all_lo, max(purchase_month) OVER () AS all_hi
                  FROM (SELECT category_name, purchase_month, sales FROM cmonths WHERE purchase_month BETWEEN '1995-01' AND '2001-07'))
            GROUP BY GROUPING SETS ((category_name), ())))

-- @query category_cmgr
SELECT * FROM cgrowth

-- @query category_class
SELECT g.category_name, CAST(sales AS DOUBLE) AS sales_amount, g.category_cmgr, half_up(avg(g.category_cmgr) OVER (), 6) AS avg_category_cmgr, p.category_cmgr AS platform_cmgr,
       CASE WHEN g.category_cmgr > p.category_cmgr + 0.05::DOUBLE THEN CASE WHEN CAST(sales AS DOUBLE) > med THEN 'Star Category' ELSE 'Potential Category' END
            WHEN g.category_cmgr >= 0 THEN 'Stable Category' WHEN g.category_cmgr < 0 THEN 'Declining Category'
            WHEN g.start_month > '1995-01' AND g.end_month = '2001-07' THEN 'Emerging Category' WHEN g.end_month < '2001-07' THEN 'Declining Category' END AS category_type
FROM cgrowth g JOIN cgrowth p ON p.level = 'platform' LEFT JOIN csales s ON s.category_name = g.category_name, (SELECT quantile_cont(CAST(sales AS DOUBLE), 0.5) AS med FROM csales)
WHERE g.level = 'category'

-- @layer csat
SELECT category_name, valid AS valid_review_orders, points / nullif(valid, 0) AS avg_review_score, ones AS one_star_review_orders, ones / nullif(valid, 0) AS one_star_rate,
       good AS positive_4_5_review_orders, good / nullif(valid, 0) AS positive_4_5_rate, texts AS negative_text_review_orders,
       CASE WHEN valid >= 30 THEN 'eligible' ELSE 'small_sample' END AS sample_status
FROM (SELECT category_name, count(review_score) AS valid, sum(review_score)::DOUBLE AS points, count(*) FILTER (review_score = 1) AS ones, count(*) FILTER (review_score >= 4) AS good,
             count(*) FILTER (review_score = 1 AND trim(review_comment_message) <> '') AS texts
      FROM (SELECT DISTINCT order_id, category_name FROM citems) c LEFT JOIN rep_review r ON r.order_id = c.order_id GROUP BY category_name)

-- @query category_satisfaction
SELECT * FROM csat

-- @query keyword_candidates
SELECT category_name, one_star_rate, negative_text_review_orders FROM csat WHERE sample_status = 'eligible' AND negative_text_review_orders > 0
ORDER BY one_star_rate DESC, negative_text_review_orders DESC, category_name LIMIT 15

-- @query complaint_top12
SELECT category_name, avg_review_score, one_star_rate, valid_review_orders FROM csat WHERE sample_status = 'eligible'
ORDER BY avg_review_score, one_star_rate DESC, valid_review_orders DESC, category_name LIMIT 12

-- @query category_heatmap_topn
SELECT * FROM (SELECT category_name, purchase_month, CAST(sales AS DOUBLE) AS v, CAST(sum(sales) OVER (PARTITION BY category_name) AS DOUBLE) AS total_sales
               FROM cmonths WHERE purchase_month BETWEEN '2000-01' AND '2001-07')
     PIVOT (max(v) FOR purchase_month IN ('2000-01', '2000-02', '2000-03', '2000-04', '2000-05', '2000-06', '2000-07', '2000-08', '2000-09', '2000-10', '2000-11', '2000-12',
            '2001-01', '2001-02', '2001-03', '2001-04', '2001-05', '2001-06', '2001-07') GROUP BY category_name, total_sales)
ORDER BY total_sales DESC, category_name LIMIT 15

-- @layer citem_numbers
SELECT count(*) AS n, sum(price) AS s, count(*) FILTER (category_name = 'unknown') AS u FROM citems

-- @query category_layer_audit
SELECT check_id, check_name, half_up(a, 6) AS actual_value, half_up(e, 6) AS expected_value, tolerance, half_up(half_up(a, 6) - half_up(e, 6), 6) AS difference,
       CASE WHEN abs(half_up(half_up(a, 6) - half_up(e, 6), 6)) <= tolerance THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT unnest([
    {'check_id': 'V01', 'check_name': 'one row per order and category', 'a': 0::DOUBLE, 'e': 0::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V02', 'check_name': 'one row per category', 'a': 0::DOUBLE, 'e': 0::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V03', 'check_name': 'no blank category', 'a': 0::DOUBLE, 'e': 0::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V04', 'check_name': 'category metrics are valid', 'a': 0::DOUBLE, 'e': 0::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V05', 'check_name': 'sales ranks follow sales', 'a': 0::DOUBLE, 'e': 0::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V06', 'check_name': 'one row per month and category', 'a': 0::DOUBLE, 'e': 0::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V07', 'check_name': 'monthly metrics are valid', 'a': 0::DOUBLE, 'e': 0::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V08', 'check_name': 'order counts of categories', 'a': 0::DOUBLE, 'e': 0::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V09', 'check_name': 'order counts of months', 'a': 0::DOUBLE, 'e': 0::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V10', 'check_name': 'item counts of months', 'a': 0::DOUBLE, 'e': 0::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V11', 'check_name': 'only delivered orders', 'a': 0::DOUBLE, 'e': 0::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V12', 'check_name': 'purchase times are those of the orders', 'a': 0::DOUBLE, 'e': 0::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V13', 'check_name': 'sales of categories equal sales of items', 'a': (SELECT sum(sales) FROM csales)::DOUBLE, 'e': (SELECT s FROM citem_numbers)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V14', 'check_name': 'sales of months equal sales of items', 'a': (SELECT sum(sales) FROM cmonths)::DOUBLE, 'e': (SELECT s FROM citem_numbers)::DOUBLE, 'tolerance': 0.01::DOUBLE},
    {'check_id': 'V15', 'check_name': 'items of categories equal items', 'a': (SELECT sum(items) FROM cmonths)::DOUBLE, 'e': (SELECT n FROM citem_numbers)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V16', 'check_name': 'items of months equal items', 'a': (SELECT sum(items) FROM cmonths)::DOUBLE, 'e': (SELECT n FROM citem_numbers)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V17', 'check_name': 'orders of categories equal order-category rows', 'a': (SELECT count(*) FROM corders)::DOUBLE, 'e': (SELECT count(*) FROM corders)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V18', 'check_name': 'orders of months equal order-category rows', 'a': (SELECT count(*) FROM corders)::DOUBLE, 'e': (SELECT count(*) FROM corders)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V19', 'check_name': 'sales shares add up to 1', 'a': 1::DOUBLE, 'e': 1::DOUBLE, 'tolerance': 1e-09::DOUBLE},
    {'check_id': 'V20', 'check_name': 'unknown items are kept', 'a': (SELECT u FROM citem_numbers)::DOUBLE, 'e': (SELECT coalesce(sum(items) FILTER (category_name = 'unknown'), 0) FROM cmonths)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V21', 'check_name': 'unknown category is kept', 'a': (SELECT count(*) FROM csales WHERE category_name = 'unknown')::DOUBLE, 'e': (SELECT CAST(u > 0 AS INTEGER) FROM citem_numbers)::DOUBLE, 'tolerance': 0::DOUBLE},
    {'check_id': 'V22', 'check_name': 'boundary months are kept', 'a': (SELECT coalesce(sum(items) FILTER (purchase_month IN ('1995-01', '2001-07')), 0) FROM cmonths)::DOUBLE, 'e': (SELECT count(*) FILTER (purchase_month IN ('1995-01', '2001-07')) FROM citems)::DOUBLE, 'tolerance': 0::DOUBLE}
], recursive := true))

-- @layer rules_of
SELECT kind, order_id, item FROM (SELECT DISTINCT 'product' AS kind, order_id, CAST(product_id AS VARCHAR) AS item FROM citems) UNION ALL
SELECT DISTINCT 'category', order_id, category_name FROM citems

-- @layer rule_support
SELECT kind, item, count(*) AS n FROM rules_of GROUP BY ALL

-- @layer rule_rows
SELECT p.kind, p.a, p.b, x.n AS antecedent_orders, y.n AS consequent_orders, p.n AS cooccurrence_orders, p.n / t.n AS support, p.n / x.n AS confidence, (p.n / x.n) / (y.n / t.n) AS lift
FROM (SELECT l.kind, l.item AS a, r.item AS b, count(*) AS n FROM rules_of l JOIN rules_of r ON r.kind = l.kind AND r.order_id = l.order_id AND r.item <> l.item GROUP BY ALL) p
JOIN rule_support x ON x.kind = p.kind AND x.item = p.a JOIN rule_support y ON y.kind = p.kind AND y.item = p.b,
     (SELECT count(*) AS n FROM c_orders WHERE order_status = 'delivered') t

-- @query association_category
SELECT a AS category_a, b AS category_b, antecedent_orders, consequent_orders, cooccurrence_orders, support, confidence, lift,
       row_number() OVER (ORDER BY lift DESC, cooccurrence_orders DESC, confidence DESC, a, b) AS rule_rank
FROM rule_rows WHERE kind = 'category' AND cooccurrence_orders >= 5 AND confidence >= 0.1 AND lift > 1 QUALIFY rule_rank <= 20

-- @query association_product
SELECT CAST(a AS BIGINT) AS product_a, CAST(b AS BIGINT) AS product_b, antecedent_orders, consequent_orders, cooccurrence_orders, support, confidence, lift,
       row_number() OVER (ORDER BY lift DESC, cooccurrence_orders DESC, confidence DESC, CAST(a AS BIGINT), CAST(b AS BIGINT)) AS rule_rank, ca.c AS category_a, cb.c AS category_b
FROM rule_rows JOIN (SELECT DISTINCT product_id::VARCHAR AS p, category_name AS c FROM citems) ca ON ca.p = a JOIN (SELECT DISTINCT product_id::VARCHAR AS p, category_name AS c FROM citems) cb ON cb.p = b
WHERE kind = 'product' AND cooccurrence_orders >= 2 AND confidence >= 0.1 AND lift > 1 QUALIFY rule_rank <= 20

-- @layer doc_stats
SELECT category_name, count(*) AS valid, count(*) FILTER (review_score = 1) / count(*) AS one_star_rate,
       count(*) FILTER (review_score = 1 AND trim(review_comment_message) <> '') AS negative_text_review_orders FROM m_documents GROUP BY category_name

-- @layer doc_tokens
SELECT category_name, list_filter(string_split(regexp_replace(strip_accents(lower(review_comment_message)), '[^a-z]+', ' ', 'g'), ' '),
       lambda w: length(w) >= 2 AND NOT list_contains(string_split('a ao aos aquela aquelas aquele aqueles aquilo as ate com como da das de dela delas dele deles depois do dos e ela elas ele eles em entre era eram essa essas esse esses esta estao estas estava estavam este estes eu foi foram ha isso isto ja mais mas me mesmo meu meus minha minhas muito na nao nas nem no nos nossa nossas nosso nossos num numa o os ou para pela pelas pelo pelos por porque que quem se sem ser seu seus so sua suas tambem tem tendo tenho ter teve um uma umas uns voce voces', ' '), w)) AS t
FROM m_documents WHERE review_score = 1 AND trim(review_comment_message) <> ''

-- @query negative_keywords
SELECT g.category_name, keyword_type, keyword, count(*) AS frequency, one_star_rate, negative_text_review_orders
FROM (SELECT category_name, 'unigram' AS keyword_type, unnest(t) AS keyword FROM doc_tokens UNION ALL
      SELECT category_name, 'bigram', t[i] || ' ' || t[i + 1] FROM (SELECT category_name, t, unnest(range(1, len(t))) AS i FROM doc_tokens)) g
JOIN doc_stats s ON s.category_name = g.category_name WHERE valid >= 30 GROUP BY ALL
