-- Freight by distance, nearest supply, seller scorecard; freight against size is written out in fits.py.

-- @layer centroids
SELECT geolocation_zip_code_prefix AS zip, avg(geolocation_lat) AS lat, avg(geolocation_lng) AS lng
FROM (SELECT DISTINCT * FROM m_geolocation) WHERE geolocation_lat BETWEEN -90 AND 90 AND geolocation_lng BETWEEN -180 AND 180 GROUP BY zip

-- @layer sold_items
SELECT i.* FROM m_items i SEMI JOIN m_sellers s ON s.seller_id = i.seller_id WHERE price >= 0 AND freight_value >= 0

-- @layer zip_pairs
SELECT a.zip AS from_zip, b.zip AS to_zip, round(2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0,
         sin((radians(b.lat) - radians(a.lat)) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin((radians(b.lng) - radians(a.lng)) / 2) ** 2))), 6) AS km
FROM centroids a, centroids b

-- @layer sent
SELECT s.order_id, s.seller_id, items, price, freight, from_zip, origin, to_zip, destination FROM (
  SELECT order_id, seller_id, count(*) AS items, sum(price) AS price, sum(freight_value) AS freight FROM sold_items GROUP BY ALL) s
JOIN (SELECT order_id, customer_zip_code_prefix AS to_zip, customer_state AS destination FROM m_orders o
      JOIN m_customers c ON c.customer_id = o.customer_id WHERE order_status = 'delivered') o ON o.order_id = s.order_id
JOIN (SELECT seller_id, seller_zip_code_prefix AS from_zip, seller_state AS origin FROM m_sellers) x ON x.seller_id = s.seller_id

-- @query freight_by_distance
SELECT origin, destination, CASE WHEN km IS NULL THEN 'unknown' WHEN km < 100 THEN '0-100' WHEN km < 500 THEN '100-500' WHEN km < 1000 THEN '500-1000'
         WHEN km < 2000 THEN '1000-2000' ELSE '2000+' END AS distance_band,
       count(*) AS shipment_count, CAST(sum(items) AS BIGINT) AS item_count, CAST(sum(freight) AS DOUBLE) AS freight_value,
       half_up(CAST(sum(freight) AS DOUBLE) / count(*), 4) AS freight_per_shipment,
       half_up(CAST(sum(freight) AS DOUBLE) / nullif(CAST(sum(price) AS DOUBLE), 0), 6) AS freight_share, half_up(avg(km), 3) AS average_km
FROM sent s LEFT JOIN zip_pairs p ON p.from_zip = s.from_zip AND p.to_zip = s.to_zip GROUP BY ALL

-- @query nearest_supply
WITH buyers AS (SELECT customer_zip_code_prefix AS zip, count(*) AS customer_count FROM m_customers GROUP BY zip),
near AS (SELECT to_zip, arg_min(from_zip, (km, from_zip)) AS z, min(km) AS km FROM zip_pairs
         WHERE from_zip IN (SELECT seller_zip_code_prefix FROM m_sellers) GROUP BY to_zip),
went AS (SELECT s.to_zip, count(*) AS n, avg(km) AS km FROM sent s JOIN zip_pairs p ON p.from_zip = s.from_zip AND p.to_zip = s.to_zip GROUP BY ALL)
SELECT b.zip AS customer_zip, customer_count, z AS nearest_seller_zip, half_up(n.km, 3) AS nearest_km, coalesce(w.n, 0) AS shipment_count,
       half_up(w.km, 3) AS average_km
FROM buyers b JOIN near n ON n.to_zip = b.zip LEFT JOIN went w ON w.to_zip = b.zip

-- @layer seller_sums
SELECT s.seller_id, count(*) AS order_count, CAST(sum(items) AS BIGINT) AS item_count, sum(price) AS gmv,
       count(*) FILTER (order_delivered_carrier_date IS NOT NULL AND lim IS NOT NULL) AS dn,
       count(*) FILTER (order_delivered_carrier_date <= lim) AS dx, count(review_score) AS sn, count(*) FILTER (review_score >= 4) AS sx
FROM (SELECT order_id, seller_id, count(*) AS items, sum(price) AS price, max(shipping_limit_date) AS lim FROM sold_items GROUP BY ALL) s
JOIN m_orders o ON o.order_id = s.order_id AND order_status = 'delivered' LEFT JOIN rep_review r ON r.order_id = s.order_id GROUP BY s.seller_id

-- @layer seller_priors
SELECT dp, sp, CASE WHEN dv > 0 THEN greatest(0.0, dp * (1 - dp) / dv - 1) END AS dm, CASE WHEN sv > 0 THEN greatest(0.0, sp * (1 - sp) / sv - 1) END AS sm
FROM (SELECT *, (dq - (dk - 1) * dp * (1 - dp)) / nullif(d1 - d2 / d1, 0) AS dv, (sq - (sk - 1) * sp * (1 - sp)) / nullif(s1 - s2 / s1, 0) AS sv
      FROM (SELECT any_value(dp) AS dp, any_value(sp) AS sp, CAST(sum(dn) AS DOUBLE) AS d1, CAST(sum(sn) AS DOUBLE) AS s1,
                   CAST(sum(dn * dn) AS DOUBLE) AS d2, CAST(sum(sn * sn) AS DOUBLE) AS s2,
                   sum(dn * (dx / nullif(dn, 0)::DOUBLE - dp) ** 2) AS dq, sum(sn * (sx / nullif(sn, 0)::DOUBLE - sp) ** 2) AS sq,
                   count(*) FILTER (dn > 0) AS dk, count(*) FILTER (sn > 0) AS sk
            FROM seller_sums, (SELECT sum(dx)::DOUBLE / nullif(sum(dn), 0) AS dp, sum(sx)::DOUBLE / nullif(sum(sn), 0) AS sp FROM seller_sums)))

-- @layer seller_cards
SELECT *, half_up(0.4 * p1 + 0.3 * p2 + 0.3 * p3, 6) AS total FROM (
  SELECT *, coalesce(100 * (rank() OVER (ORDER BY gmv) - 1 + (count(*) OVER (PARTITION BY gmv) - 1) / 2.0::DOUBLE) / nullif(count(*) OVER () - 1, 0), 50.0) AS p1,
         coalesce(100 * (rank() OVER (ORDER BY dr) - 1 + (count(*) OVER (PARTITION BY dr) - 1) / 2.0::DOUBLE) / nullif(count(*) OVER () - 1, 0), 50.0) AS p2,
         coalesce(100 * (rank() OVER (ORDER BY sr) - 1 + (count(*) OVER (PARTITION BY sr) - 1) / 2.0::DOUBLE) / nullif(count(*) OVER () - 1, 0), 50.0) AS p3
  FROM (SELECT *, round(coalesce((dx + dm * dp) / nullif(dn + dm, 0), dp), 9) AS dr, round(coalesce((sx + sm * sp) / nullif(sn + sm, 0), sp), 9) AS sr
        FROM seller_sums, seller_priors))

-- @layer seller_table
SELECT seller_id, order_count, item_count, CAST(gmv AS DOUBLE) AS gmv, half_up(dx / nullif(dn, 0)::DOUBLE, 6) AS on_time_rate, half_up(dr, 6) AS shrunk_on_time_rate,
       half_up(sx / nullif(sn, 0)::DOUBLE, 6) AS positive_rate, half_up(sr, 6) AS shrunk_positive_rate, half_up(p1, 4) AS sales_score, half_up(p2, 4) AS dispatch_score,
       half_up(p3, 4) AS service_score, half_up(total, 4) AS score,
       CASE WHEN total >= 75 THEN 'A' WHEN total >= 50 THEN 'B' WHEN total >= 25 THEN 'C' ELSE 'D' END AS grade
FROM seller_cards

-- @query seller_scorecard
SELECT * FROM seller_table

-- @query seller_grade_summary
SELECT grade, count(*) AS seller_count, CAST(sum(order_count) AS BIGINT) AS order_count, CAST(sum(CAST(gmv AS DECIMAL(28,2))) AS DOUBLE) AS gmv,
       half_up(CAST(sum(CAST(gmv AS DECIMAL(28,2))) AS DOUBLE) / CAST(sum(sum(CAST(gmv AS DECIMAL(28,2)))) OVER () AS DOUBLE), 6) AS gmv_share,
       half_up(avg(score), 4) AS average_score, half_up(avg(shrunk_on_time_rate), 4) AS average_on_time_rate,
       half_up(avg(shrunk_positive_rate), 4) AS average_positive_rate, count(*) FILTER (order_count < 5) AS small_seller_count
FROM seller_table GROUP BY grade
