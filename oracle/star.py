"""The raw tables and the star schema as common table expressions over the generated tables."""

from __future__ import annotations

RAW = """
raw_nation AS (
  SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
),
raw_shipped AS (
  SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
  FROM lineitem GROUP BY l_orderkey
),
raw_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
              ELSE 'processing' END AS order_status,
         o_orderdate + to_minutes(o_orderkey % 1440) AS order_purchase_timestamp,
         CASE WHEN o_orderpriority <> '5-LOW'
              THEN o_orderdate + to_minutes(o_orderkey % 1440) END AS order_approved_at,
         first_ship AS order_delivered_carrier_date,
         last_ship AS order_delivered_customer_date,
         o_orderdate + INTERVAL 30 DAY AS order_estimated_delivery_date
  FROM orders LEFT JOIN raw_shipped ON l_orderkey = o_orderkey
),
raw_lines AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey, l_suppkey, l_returnflag, l_linestatus,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
         CAST(l_discount AS DECIMAL(4,2)) AS discount, CAST(l_tax AS DECIMAL(4,2)) AS tax
  FROM lineitem
),
raw_order_items AS (
  SELECT order_id, line AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
         CAST(amount AS DECIMAL(18,2)) AS price, CAST(amount * tax AS DECIMAL(18,2)) AS freight_value
  FROM raw_lines
),
raw_payments AS (
  SELECT order_id, l_returnflag AS payment_type, line AS payment_installments,
         CAST(amount * CAST(1 - discount AS DECIMAL(4,2)) * CAST(1 + tax AS DECIMAL(4,2))
              AS DECIMAL(18,2)) AS payment_value
  FROM raw_lines
),
raw_reviews AS (
  SELECT order_id, CAST(l_partkey % 5 + 1 AS INTEGER) AS review_score,
         nullif(l_returnflag, 'N') AS review_comment_title,
         nullif(l_linestatus, 'O') AS review_comment_message
  FROM raw_lines
),
raw_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_size <> 1 THEN p_type || ' ' || p_brand END AS product_category_name,
         length(p_name) AS product_name_lenght, nullif(p_size, 2) AS product_photos_qty,
         p_retailprice AS product_weight_g, CAST(p_size AS DOUBLE) AS product_length_cm,
         CAST(p_size + 1 AS DOUBLE) AS product_height_cm, CAST(p_size + 2 AS DOUBLE) AS product_width_cm
  FROM part
),
raw_category_xlat AS (
  SELECT DISTINCT p_type || ' ' || p_brand AS product_category_name,
         lower(p_type || '_' || replace(p_brand, '#', '')) AS product_category_name_english
  FROM part WHERE p_type <> 'PROMO' AND p_size <> 1
),
raw_customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_unique_id,
         CAST(c_nationkey * 100 + c_custkey % 100 AS INTEGER) AS customer_zip_code_prefix,
         c_mktsegment AS customer_city, n_name AS customer_state
  FROM customer JOIN raw_nation ON c_nationkey = n_nationkey
),
raw_sellers AS (
  SELECT s_suppkey AS seller_id,
         CAST(s_nationkey * 100 + s_suppkey % 100 AS INTEGER) AS seller_zip_code_prefix,
         r_name AS seller_city, n_name AS seller_state
  FROM supplier JOIN raw_nation ON s_nationkey = n_nationkey
),
raw_geo AS (
  SELECT zip AS geolocation_zip_code_prefix, floor(balance / 1000) AS geolocation_lat,
         CAST(nation_id AS DOUBLE) AS geolocation_lng, place AS geolocation_city,
         n_name AS geolocation_state
  FROM (SELECT c_nationkey AS nation_id, CAST(c_nationkey * 100 + c_custkey % 100 AS INTEGER) AS zip,
               c_acctbal AS balance, c_mktsegment AS place FROM customer
        UNION ALL
        SELECT s_nationkey, CAST(s_nationkey * 100 + s_suppkey % 100 AS INTEGER), s_acctbal, 'DEPOT'
        FROM supplier)
  JOIN raw_nation ON nation_id = n_nationkey
)
"""

STAR = (
    RAW
    + """,
dim_date AS (
  SELECT full_date, CAST(strftime(full_date, '%Y%m%d') AS INTEGER) AS date_key,
         CAST(year(full_date) AS INTEGER) AS year, CAST(quarter(full_date) AS INTEGER) AS quarter,
         CAST(month(full_date) AS INTEGER) AS month, monthname(full_date) AS month_name,
         CAST(weekofyear(full_date) AS INTEGER) AS week, dayname(full_date) AS day_of_week,
         isodow(full_date) >= 6 AS is_weekend
  FROM (SELECT CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS full_date
        FROM (SELECT min(CAST(order_purchase_timestamp AS DATE)) AS first_day,
                     max(CAST(order_purchase_timestamp AS DATE)) AS last_day FROM raw_orders))
),
dim_customer AS (
  SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id, customer_unique_id,
         customer_zip_code_prefix AS zip_code, customer_city AS city, customer_state AS state
  FROM raw_customers
),
dim_product AS (
  SELECT row_number() OVER (ORDER BY product_id) AS product_key, product_id,
         coalesce(product_category_name_english, category) AS category_en,
         product_weight_g AS weight_g, product_length_cm AS length_cm,
         product_height_cm AS height_cm, product_width_cm AS width_cm
  FROM (SELECT *, coalesce(product_category_name, 'unknown') AS category FROM raw_products) p
  LEFT JOIN raw_category_xlat x ON x.product_category_name = p.category
),
dim_seller AS (
  SELECT row_number() OVER (ORDER BY seller_id) AS seller_key, seller_id,
         seller_zip_code_prefix AS zip_code, seller_city AS city, seller_state AS state
  FROM raw_sellers
),
geo_first AS (
  SELECT * FROM raw_geo
  QUALIFY row_number() OVER (PARTITION BY geolocation_zip_code_prefix ORDER BY geolocation_lat,
            geolocation_lng, geolocation_city, geolocation_state) = 1
),
state_region AS (SELECT n_name AS state, r_name AS region FROM raw_nation WHERE r_name <> 'MIDDLE EAST'),
dim_geography AS (
  SELECT row_number() OVER (ORDER BY geolocation_zip_code_prefix) AS geo_key,
         geolocation_zip_code_prefix AS zip_code, geolocation_city AS city,
         geolocation_state AS state, coalesce(region, 'Other') AS region,
         geolocation_lat AS lat, geolocation_lng AS lng
  FROM geo_first LEFT JOIN state_region ON state = geolocation_state
),
payment_mode AS (
  SELECT order_id, payment_type FROM raw_payments GROUP BY order_id, payment_type
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, payment_type) = 1
),
order_payments AS (
  SELECT order_id, CAST(sum(coalesce(payment_value, 0)) AS DECIMAL(18,2)) AS total_payment,
         max(payment_installments) AS num_installments, any_value(m.payment_type) AS payment_type
  FROM raw_payments JOIN payment_mode m USING (order_id) GROUP BY order_id
),
order_reviews AS (
  SELECT order_id, CAST(sum(review_score) AS DOUBLE) / count(review_score) AS avg_review_score
  FROM raw_reviews GROUP BY order_id
),
item_first AS (
  SELECT order_id, product_id, seller_id FROM raw_order_items
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY order_item_id, product_id, seller_id) = 1
),
order_items AS (
  SELECT order_id, any_value(f.product_id) AS product_id, any_value(f.seller_id) AS seller_id,
         CAST(sum(coalesce(freight_value, 0)) AS DECIMAL(18,2)) AS total_freight,
         CAST(sum(coalesce(price, 0)) AS DECIMAL(18,2)) AS total_price, count(order_item_id) AS qty
  FROM raw_order_items JOIN item_first f USING (order_id) GROUP BY order_id
),
filled_orders AS (
  SELECT *, coalesce(order_delivered_customer_date, order_estimated_delivery_date) AS delivered_at,
         epoch_us(coalesce(order_delivered_customer_date, order_estimated_delivery_date))
           - epoch_us(order_purchase_timestamp) AS took
  FROM raw_orders
),
fact AS (
  SELECT o.order_id, CAST(strftime(order_purchase_timestamp, '%Y%m%d') AS INTEGER) AS date_key,
         customer_key, product_key, seller_key, geo_key, order_status,
         total_price, total_freight, total_payment, qty, num_installments, payment_type,
         (took - ((took % 86400000000) + 86400000000) % 86400000000) // 86400000000 AS delivery_days,
         coalesce(CAST(delivered_at > order_estimated_delivery_date AS INTEGER), 0) AS is_late,
         avg_review_score,
         CASE WHEN total_price <= 0 THEN NULL WHEN total_price <= 100000 THEN 'budget'
              WHEN total_price <= 250000 THEN 'mid-range' WHEN total_price <= 400000 THEN 'premium'
              WHEN total_price > 400000 THEN 'luxury' END AS price_bucket
  FROM filled_orders o
  LEFT JOIN order_items i USING (order_id)
  LEFT JOIN order_payments p USING (order_id)
  LEFT JOIN order_reviews v USING (order_id)
  LEFT JOIN dim_customer c USING (customer_id)
  LEFT JOIN dim_product d USING (product_id)
  LEFT JOIN dim_seller s USING (seller_id)
  LEFT JOIN dim_geography g ON g.zip_code = c.zip_code
),
sales AS (
  SELECT f.*, d.full_date, d.year, d.quarter, d.month, d.month_name, d.day_of_week, d.is_weekend,
         p.category_en, c.state, c.city
  FROM fact f LEFT JOIN dim_date d USING (date_key) LEFT JOIN dim_product p USING (product_key)
  LEFT JOIN dim_customer c USING (customer_key)
)
"""
)


def over_raw(statement: str) -> str:
    return f"WITH {RAW} {statement}"


def over_star(statement: str, *more: str) -> str:
    """``statement`` over the star schema; ``more`` are further named expressions."""
    return f"WITH {', '.join([STAR, *more])} {statement}"


def round2(value: str) -> str:
    """Two digits, halves away from zero, by the same steps as the Spark side."""
    return f"(sign({value}) * floor(abs({value}) * 100 + 0.5) / 100)"


def quotient(top: str, bottom: str) -> str:
    return f"(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0))"
