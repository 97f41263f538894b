"""One statement per registered query."""

from __future__ import annotations

from oracle.star import over_raw, over_star, quotient, round2

RAW_NAMES = (
    "orders", "order_items", "products", "customers", "sellers", "payments", "reviews", "geo",
    "category_xlat",
)

# Columns of the raw tables with the fixes that the quality reports look at.
RAW_COLUMNS = {
    "orders": (
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date",
        "order_estimated_delivery_date",
    ),
    "order_items": ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"),
    "products": (
        "product_id", "product_category_name", "product_name_lenght", "product_photos_qty",
        "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
    ),
    "customers": (
        "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
        "customer_state",
    ),
    "sellers": ("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"),
    "payments": ("order_id", "payment_type", "payment_installments", "payment_value"),
    "reviews": ("order_id", "review_score", "review_comment_title", "review_comment_message"),
    "geo": (
        "geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city",
        "geolocation_state",
    ),
    "category_xlat": ("product_category_name", "product_category_name_english"),
}

_PROFILE = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count,"
    f" count(*) - count({c}) AS null_count FROM raw_{t}"
    for t, columns in RAW_COLUMNS.items()
    for c in columns
)
_DUPLICATES = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM raw_{t})"
    f" - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_{t})) AS duplicate_rows"
    for t in RAW_NAMES
)

_FACT_COLUMNS = """order_id, date_key, customer_key, product_key, seller_key, geo_key, order_status,
  CAST(total_price AS DOUBLE) AS total_price, CAST(total_freight AS DOUBLE) AS total_freight,
  CAST(total_payment AS DOUBLE) AS total_payment, qty, num_installments, payment_type,
  delivery_days, is_late, avg_review_score, price_bucket"""

_SUM_PAID = "CAST(coalesce(sum(total_payment), 0) AS DOUBLE)"
_PERIOD = "CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0')"
_MEAN_PAID = quotient("sum(total_payment)", "count(total_payment)")
_MEAN_DAYS = quotient("sum(delivery_days)", "count(delivery_days)")
# Means of up to twenty scores as whole numbers of parts.
_PARTS = 232792560
_SCORE = f"CAST(round(avg_review_score * {_PARTS}) AS DECIMAL(20,0))"
_MEAN_SCORE = quotient(f"sum({_SCORE})", f"count(avg_review_score) * {_PARTS}")
_LATE_PCT = "(CAST(sum(is_late) AS DOUBLE) * 100 / nullif(CAST(count(is_late) AS DOUBLE), 0))"
_LATE_MEASURE = "(CAST(count(*) FILTER (is_late = 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100)"


def _mean(column: str, order: str, over: str = "") -> str:
    """The unweighted mean, added up in a fixed order."""
    listed = f"list({column} ORDER BY {order}) FILTER ({column} IS NOT NULL) {over}"
    total = f"list_reduce(list_prepend(CAST(0 AS DOUBLE), {listed}), lambda a, b: a + b)"
    return f"({total} / CAST(count({column}) {over} AS DOUBLE))"


def _share(value: str, by: str = "") -> str:
    return f"(CAST({value} AS DOUBLE) * 100 / nullif(CAST(sum({value}) OVER ({by}) AS DOUBLE), 0))"


DAILY = f"""daily AS (
  SELECT full_date AS order_date, year, month, month_name, day_of_week, count(*) AS order_count,
         sum(total_payment) AS paid, {round2(_MEAN_PAID)} AS avg_order_value
  FROM sales WHERE order_status = 'delivered' AND full_date IS NOT NULL
  GROUP BY ALL
)"""
ROLLING = f"""rolling AS (
  SELECT order_date, year, month_name, day_of_week, order_count,
         CAST(paid AS DOUBLE) AS daily_revenue, avg_order_value,
         CAST(sum(paid) OVER month_back AS DOUBLE) AS rolling_30d_revenue,
         CAST(sum(paid) OVER week_back AS DOUBLE) AS rolling_7d_revenue,
         CAST(sum(paid) OVER so_far AS DOUBLE) AS cumulative_revenue,
         {round2("change")} AS dod_change_pct
  FROM (SELECT *, CAST(paid - lag(paid) OVER (ORDER BY order_date) AS DOUBLE) * 100
               / nullif(CAST(lag(paid) OVER (ORDER BY order_date) AS DOUBLE), 0) AS change FROM daily)
  WINDOW month_back AS (ORDER BY order_date ROWS 29 PRECEDING),
         week_back AS (ORDER BY order_date ROWS 6 PRECEDING),
         so_far AS (ORDER BY order_date ROWS UNBOUNDED PRECEDING)
)"""
COHORT = f"""life AS (
  SELECT customer_key, CAST(date_trunc('month', full_date) AS DATE) AS order_month, total_payment,
         CAST(date_trunc('month', min(full_date) OVER (PARTITION BY customer_key)) AS DATE) AS cohort_month
  FROM sales WHERE customer_key IS NOT NULL AND full_date IS NOT NULL
),
sizes AS (SELECT cohort_month, count(DISTINCT customer_key) AS cohort_size FROM life GROUP BY cohort_month),
retention AS (
  SELECT cohort_month, any_value(cohort_size) AS cohort_size, order_month,
         CAST(datediff('month', cohort_month, order_month) AS BIGINT) AS months_since_first,
         count(DISTINCT customer_key) AS active_customers,
         {round2("(CAST(count(DISTINCT customer_key) AS DOUBLE) * 100 / any_value(cohort_size))")}
           AS retention_rate_pct,
         count(*) AS total_orders, CAST(sum(total_payment) AS DOUBLE) AS cohort_revenue
  FROM life JOIN sizes USING (cohort_month) GROUP BY cohort_month, order_month
)"""
# The thresholds and the order of the segment rules.
RFM = f"""metrics AS (
  SELECT customer_key, city, state,
         CAST(datediff('day', max(full_date), (SELECT max(full_date) FROM sales)) AS BIGINT) AS recency_days,
         count(DISTINCT order_id) AS frequency, sum(total_payment) AS spent,
         {round2(_MEAN_PAID)} AS avg_order_value, {round2(_MEAN_SCORE)} AS avg_review_score,
         max(full_date) AS last_order_date
  FROM sales WHERE customer_key IS NOT NULL AND full_date IS NOT NULL
  GROUP BY customer_key, city, state
),
scores AS (
  SELECT *,
    CAST(ntile(4) OVER (ORDER BY recency_days DESC NULLS LAST, customer_key) AS BIGINT) AS r_score,
    CAST(ntile(4) OVER (ORDER BY frequency NULLS LAST, customer_key) AS BIGINT) AS f_score,
    CAST(ntile(4) OVER (ORDER BY spent NULLS LAST, customer_key) AS BIGINT) AS m_score
  FROM metrics
),
rfm AS (
  SELECT *, concat(r_score, f_score, m_score) AS rfm_score,
    r_score + f_score + m_score AS total_rfm_score,
    CASE WHEN r_score = 4 AND f_score = 4 AND m_score = 4 THEN 'Champions'
         WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal Customers'
         WHEN r_score = 4 AND f_score <= 2 THEN 'Recent Customers'
         WHEN r_score >= 3 AND f_score <= 2 AND m_score >= 3 THEN 'Potential Loyalists'
         WHEN r_score = 1 AND f_score >= 3 THEN 'At Risk'
         WHEN r_score = 1 AND f_score = 4 AND m_score = 4 THEN 'Cannot Lose Them'
         WHEN r_score <= 2 AND f_score <= 2 THEN 'Hibernating'
         ELSE 'Need Attention' END AS segment
  FROM scores
)"""
_METRIC_COLUMNS = """customer_key, city, state, recency_days, frequency,
  CAST(spent AS DOUBLE) AS monetary, avg_order_value, avg_review_score, last_order_date"""

MONTHLY_AOV = f"""aov AS (
  SELECT year, month, {_PERIOD} AS period, {_MEAN_PAID} AS avg_order_value
  FROM sales WHERE year IS NOT NULL GROUP BY year, month
)"""
STATE_DAYS = f"""state_days AS (
  SELECT state, {_MEAN_DAYS} AS avg_delivery_days FROM sales WHERE state IS NOT NULL
  GROUP BY state HAVING count(delivery_days) > 0
)"""
LATE_MONTHS = f"""late_months AS (
  SELECT year, month, {_PERIOD} AS period, {_LATE_PCT} AS late_rate_pct
  FROM sales WHERE year IS NOT NULL GROUP BY year, month
)"""
STATE_REVENUE = f"""leaders AS (
  SELECT state, {_SUM_PAID} AS revenue, coalesce(sum(total_payment), 0) AS exact,
         row_number() OVER (ORDER BY coalesce(sum(total_payment), 0) DESC, state) AS place
  FROM sales WHERE state IS NOT NULL GROUP BY state
  ORDER BY place LIMIT 10
)"""
CUSTOMER_ORDERS = """customer_orders AS (
  SELECT customer_key, count(order_id) AS order_count FROM fact WHERE customer_key IS NOT NULL
  GROUP BY customer_key
),
buyer AS (
  SELECT CASE WHEN order_count = 1 THEN 'One-time' ELSE 'Repeat' END AS buyer_type, count(*) AS customers
  FROM customer_orders GROUP BY 1
)"""
BY_DAY = """by_day AS (
  SELECT d.*, revenue FROM dim_date d
  LEFT JOIN (SELECT date_key, sum(total_payment) AS revenue FROM fact GROUP BY date_key) USING (date_key)
)"""

GROUP_DAYS = """group_days AS (
  SELECT {0}, full_date, sum(total_payment) AS revenue FROM sales
  WHERE full_date IS NOT NULL AND total_payment IS NOT NULL GROUP BY {0}, full_date
)"""


def _histogram(condition: str, mean_condition: str) -> str:
    return over_star(
        f"""SELECT CAST(bin AS INTEGER) AS bin,
          (CAST(low AS DOUBLE) * 2 + CAST((high - low) * 2 AS DOUBLE) * bin / 40) / 2 AS bin_start,
          (CAST(low AS DOUBLE) * 2 + CAST((high - low) * 2 AS DOUBLE) * (bin + 1) / 40) / 2 AS bin_end,
          (SELECT count(*) FROM kept
            WHERE least(((delivery_days - low) * 40) // (high - low), 39) = bin) AS orders,
          (SELECT {_MEAN_DAYS} FROM fact WHERE {mean_condition}) AS mean_days
        FROM edges, generate_series(0, 39) s(bin)""",
        f"kept AS (SELECT delivery_days FROM fact WHERE {condition})",
        "edges AS (SELECT min(delivery_days) AS low, max(delivery_days) AS high FROM kept)",
    )


_YEAR = "year = 1996"


def _of_year(named: str) -> str:
    """A named expression over the sales of one year."""
    return named.replace("FROM sales WHERE", f"FROM sales WHERE {_YEAR} AND")


def _metrics(table: str) -> str:
    rows = f"(SELECT count(*) FROM raw_{table})"
    doubles = f"{rows} - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_{table}))"
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS row_count,"
        f" count(*) - count({c}) AS null_count, {doubles} AS duplicate_rows FROM raw_{table}"
        for c in RAW_COLUMNS[table]
    )


def _yoy(grain: str) -> str:
    return over_star(
        f"""SELECT {grain}, CAST(revenue AS DOUBLE) AS revenue, CAST(prior_revenue AS DOUBLE) AS prior_revenue,
          coalesce({quotient("coalesce(revenue, 0) - prior_revenue", "prior_revenue")}, 0) * 100
            AS revenue_yoy_pct
        FROM (SELECT {grain}, sum(revenue) AS revenue FROM by_day GROUP BY {grain})
        LEFT JOIN (SELECT {grain}, sum(e.revenue) AS prior_revenue
                   FROM by_day d JOIN (SELECT CAST(full_date + INTERVAL 1 YEAR AS DATE) AS moved, revenue
                                       FROM by_day) e ON e.moved = d.full_date
                   GROUP BY {grain}) USING ({grain})""",
        BY_DAY,
    )


def _measures(by: str) -> str:
    keys, group = (f"{by},", f"GROUP BY {by}") if by else ("", "")
    return over_star(
        f"""SELECT {keys} CAST(sum(total_payment) AS DOUBLE) AS total_revenue, count(*) AS total_orders,
          coalesce({quotient("sum(total_payment)", "count(*)")}, 0) AS avg_order_value,
          {_LATE_MEASURE} AS late_order_rate_pct, {_MEAN_DAYS} AS avg_delivery_days,
          {_MEAN_SCORE} AS avg_review_score
        FROM sales {group}"""
    )


_STATUS = "CASE WHEN {0} <= 5 THEN 'Good' WHEN {0} <= 10 THEN 'Watch' ELSE 'Critical' END"
_SLICE = "year = 1997 AND state = 'NATION_3'"
_KPIS = f"""{_SUM_PAID} AS total_revenue, count(*) AS total_orders, {_MEAN_PAID} AS avg_order_value,
  {_MEAN_DAYS} AS avg_delivery_days, {_LATE_PCT} AS late_order_rate_pct,
  {_MEAN_SCORE} AS avg_review_score, count(DISTINCT customer_key) AS unique_customers,
  count(DISTINCT category_en) AS unique_categories"""

# Chosen segments of the segment filter.
CHOSEN_SEGMENTS = ("Champions", "At Risk")

STATEMENTS: dict[str, str] = {
    # Raw tables: counts, quality, fixes.
    "table_row_counts": over_raw(
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM raw_{t}" for t in RAW_NAMES)
    ),
    "profile_nulls": over_raw(_PROFILE),
    "dq_null_counts": over_raw(
        f"SELECT table_name, column_name, null_count FROM ({_PROFILE}) WHERE null_count > 0"
    ),
    "dq_duplicate_rows": over_raw(_DUPLICATES),
    "dq_issue_count": over_raw(
        f"""SELECT (SELECT count(DISTINCT table_name) FROM ({_PROFILE}) WHERE null_count > 0)
          + (SELECT count(*) FROM ({_DUPLICATES}) WHERE duplicate_rows > 0) AS issues"""
    ),
    "clean_fill_defaults": over_raw(
        """SELECT 'product_category_name' AS column_name, coalesce(product_category_name, 'unknown') AS value,
             count(*) AS row_count FROM raw_products GROUP BY ALL
           UNION ALL
           SELECT 'review_comment_title', coalesce(review_comment_title, ''), count(*)
           FROM raw_reviews GROUP BY ALL
           UNION ALL
           SELECT 'review_comment_message', coalesce(review_comment_message, ''), count(*)
           FROM raw_reviews GROUP BY ALL"""
    ),
    "dedup_first_per_key": over_star("SELECT * FROM geo_first"),
    # Star schema.
    "star_row_counts": over_star(
        " UNION ALL ".join(
            f"SELECT '{shown}' AS table_name, count(*) AS row_count FROM {name}"
            for shown, name in {
                "dim_date": "dim_date", "dim_customer": "dim_customer", "dim_product": "dim_product",
                "dim_seller": "dim_seller", "dim_geography": "dim_geography", "fact_orders": "fact",
            }.items()
        )
    ),
    "dim_date": over_star("SELECT * FROM dim_date"),
    "dim_customer": over_star("SELECT * FROM dim_customer"),
    "dim_product": over_star("SELECT * FROM dim_product"),
    "dim_seller": over_star("SELECT * FROM dim_seller"),
    "dim_geography": over_star("SELECT * FROM dim_geography"),
    "region_map": over_star(
        """SELECT customer_state AS state, coalesce(region, 'Other') AS region, count(*) AS customers
           FROM raw_customers LEFT JOIN state_region ON state = customer_state GROUP BY ALL"""
    ),
    "order_payments_agg": over_star(
        """SELECT order_id, CAST(total_payment AS DOUBLE) AS total_payment, num_installments, payment_type
           FROM order_payments"""
    ),
    "order_review_agg": over_star("SELECT * FROM order_reviews"),
    "order_items_agg": over_star(
        """SELECT order_id, product_id, seller_id, CAST(total_freight AS DOUBLE) AS total_freight,
             CAST(total_price AS DOUBLE) AS total_price, qty FROM order_items"""
    ),
    "delivery_days": over_star("SELECT order_id, delivery_days, is_late FROM fact"),
    "price_bucket": over_star(
        """SELECT order_id, CAST(total_price AS DOUBLE) AS total_price, price_bucket FROM fact"""
    ),
    "fact_orders": over_star(f"SELECT {_FACT_COLUMNS} FROM fact"),
    "fact_geography": over_star(
        """SELECT order_id, customer_key, geo_key, zip_code, state AS geo_state, region
           FROM fact LEFT JOIN dim_geography USING (geo_key)"""
    ),
    "enriched_fact": over_star(
        f"""SELECT {_FACT_COLUMNS}, year, quarter, month, month_name, day_of_week, is_weekend, category_en,
            state, city FROM sales"""
    ),
    "semi_join_active_dates": over_star(
        "SELECT * FROM dim_date WHERE EXISTS (SELECT 1 FROM fact WHERE fact.date_key = dim_date.date_key)"
    ),
    # Revenue.
    "daily_revenue": over_star(
        """SELECT order_date, year, month, month_name, day_of_week, order_count,
             CAST(paid AS DOUBLE) AS daily_revenue, avg_order_value FROM daily""",
        DAILY,
    ),
    "rolling_revenue": over_star("SELECT * FROM rolling", DAILY, ROLLING),
    "peak_rolling_revenue": over_star(
        "SELECT max(rolling_30d_revenue) AS peak_rolling_30d_revenue FROM rolling", DAILY, ROLLING
    ),
    "monthly_revenue": over_star(
        f"""SELECT year, month, month_name, {_PERIOD} AS period, {_SUM_PAID} AS revenue
            FROM sales WHERE year IS NOT NULL GROUP BY year, month, month_name"""
    ),
    "monthly_aov": over_star("SELECT * FROM aov", MONTHLY_AOV),
    "monthly_aov_mean": over_star(
        f"SELECT {_mean('avg_order_value', 'year, month')} AS mean_monthly_aov FROM aov", MONTHLY_AOV
    ),
    "top_categories": over_star(
        f"""SELECT category_en, {_SUM_PAID} AS revenue FROM sales WHERE category_en IS NOT NULL
            GROUP BY category_en ORDER BY sum(total_payment) DESC NULLS LAST, category_en LIMIT 10"""
    ),
    "top_states": over_star("SELECT state, revenue, place = 1 AS is_leader FROM leaders", STATE_REVENUE),
    "leader_share": over_star(
        f"SELECT state, revenue, {_share('exact')} AS share_of_top_pct FROM leaders QUALIFY place = 1",
        STATE_REVENUE,
    ),
    "revenue_by_dow": over_star(
        """SELECT day_of_week, position, CAST(revenue AS DOUBLE) AS revenue, position >= 6 AS is_weekend
           FROM (SELECT unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'])
                   AS day_of_week, CAST(unnest([1, 2, 3, 4, 5, 6, 7]) AS INTEGER) AS position)
           LEFT JOIN (SELECT day_of_week, coalesce(sum(total_payment), 0) AS revenue FROM sales
                      GROUP BY day_of_week) USING (day_of_week)"""
    ),
    "revenue_by_price_bucket": over_star(
        """SELECT price_bucket, position, CAST(revenue AS DOUBLE) AS revenue, order_count
           FROM (SELECT unnest(['budget', 'mid-range', 'premium', 'luxury']) AS price_bucket,
                        CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS position)
           LEFT JOIN (SELECT price_bucket, coalesce(sum(total_payment), 0) AS revenue,
                        count(total_payment) AS order_count FROM fact GROUP BY price_bucket)
           USING (price_bucket)"""
    ),
    "revenue_heatmap": over_star(
        "SELECT month_name, month, "
        + ", ".join(
            f"CAST(coalesce(sum(total_payment) FILTER (day_of_week = '{day}'), 0) AS DOUBLE) AS {day.lower()}"
            for day in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
        )
        + " FROM sales WHERE month_name IS NOT NULL GROUP BY month_name, month"
    ),
    # Delivery.
    "delivery_by_state": over_star(
        f"""SELECT state, avg_delivery_days,
              avg_delivery_days > (SELECT {_mean('avg_delivery_days', 'state')} FROM state_days) AS above_mean
            FROM state_days""",
        STATE_DAYS,
    ),
    "delivery_national_avg": over_star(
        f"""SELECT (SELECT {_MEAN_DAYS} FROM fact) AS mean_of_orders,
              (SELECT {_mean('avg_delivery_days', 'state')} FROM state_days) AS mean_of_state_means""",
        STATE_DAYS,
    ),
    "ontime_vs_late": over_star(
        f"""SELECT is_late, CASE is_late WHEN 0 THEN 'On-Time' ELSE 'Late' END AS label, orders,
              {_share('orders')} AS share_pct
            FROM (SELECT is_late, count(*) AS orders FROM fact GROUP BY is_late)"""
    ),
    "monthly_late_rate": over_star("SELECT * FROM late_months", LATE_MONTHS),
    "monthly_late_rate_mean": over_star(
        f"SELECT {_mean('late_rate_pct', 'year, month')} AS mean_monthly_late_rate_pct FROM late_months", LATE_MONTHS
    ),
    "delivery_histogram": _histogram("delivery_days BETWEEN 0 AND 60", "delivery_days BETWEEN 0 AND 60"),
    "delivery_histogram_lt60": _histogram("delivery_days < 60", "delivery_days IS NOT NULL"),
    "freight_pct_by_category": over_star(
        f"SELECT *, (SELECT {_mean('freight_pct', 'category_en')} FROM listed) AS mean_freight_pct FROM listed",
        f"""listed AS (SELECT *, avg_freight * 100 / nullif(avg_price, 0) AS freight_pct
                  FROM (SELECT category_en, {quotient("sum(total_price)", "count(total_price)")} AS avg_price,
                          {quotient("sum(total_freight)", "count(total_freight)")} AS avg_freight
                        FROM sales WHERE category_en IS NOT NULL GROUP BY category_en)
                  WHERE avg_price IS NOT NULL AND avg_freight IS NOT NULL
                  ORDER BY avg_freight DESC, category_en LIMIT 15)"""
    ),
    # Customers, reviews, payments, status.
    "repeat_buyers": over_star(
        f"SELECT buyer_type, customers, {_share('customers')} AS share_pct FROM buyer", CUSTOMER_ORDERS
    ),
    "repeat_order_histogram": over_star(
        """SELECT bins.order_count, count(o.order_count) AS customers
           FROM (SELECT unnest(generate_series(2, (SELECT max(order_count) FROM customer_orders))) AS order_count) bins
           LEFT JOIN customer_orders o ON o.order_count = bins.order_count GROUP BY bins.order_count""",
        CUSTOMER_ORDERS,
    ),
    "review_distribution": over_star(
        """SELECT CAST(round_even(avg_review_score, 0) AS INTEGER) AS score, count(*) AS orders,
             CAST(round_even(avg_review_score, 0) AS INTEGER) < 4 AS is_low
           FROM fact WHERE avg_review_score IS NOT NULL GROUP BY ALL"""
    ),
    "five_star_pct": over_star(
        """SELECT CAST(count(*) FILTER (round_even(avg_review_score, 0) = 5) AS DOUBLE) * 100
             / CAST(count(*) AS DOUBLE) AS five_star_pct
           FROM fact WHERE avg_review_score IS NOT NULL"""
    ),
    "payment_type_split": over_star(
        f"""SELECT payment_type, count(order_id) AS orders, {_SUM_PAID} AS revenue FROM fact
            WHERE payment_type IS NOT NULL GROUP BY payment_type"""
    ),
    "order_status_breakdown": over_star(
        f"""SELECT order_status, orders, {_share('orders')} AS share_pct,
              order_status = 'delivered' AS is_delivered
            FROM (SELECT order_status, count(*) AS orders FROM fact WHERE order_status IS NOT NULL
                  GROUP BY order_status)"""
    ),
    # Cohorts.
    "customer_first_order": over_star(
        """SELECT customer_key, CAST(min(year * 100 + month) AS INTEGER) AS cohort_month_key,
             min(full_date) AS first_order_date,
             CAST(date_trunc('month', min(full_date)) AS DATE) AS cohort_month
           FROM sales WHERE customer_key IS NOT NULL AND full_date IS NOT NULL GROUP BY customer_key"""
    ),
    "customer_month_orders": over_star(
        """SELECT customer_key, order_month, count(*) AS orders_that_month,
             CAST(sum(total_payment) AS DOUBLE) AS revenue_that_month
           FROM life GROUP BY customer_key, order_month""",
        COHORT,
    ),
    "cohort_size": over_star("SELECT * FROM sizes", COHORT),
    "cohort_retention": over_star("SELECT * FROM retention", COHORT),
    "avg_month1_retention": over_star(
        f"""SELECT {quotient("sum(CAST(retention_rate_pct AS DECIMAL(20,2)))", "count(*)")}
              AS avg_month1_retention_pct
            FROM retention WHERE months_since_first = 1""",
        COHORT,
    ),
    # Recency, frequency, monetary.
    "rfm_metrics": over_star(f"SELECT {_METRIC_COLUMNS} FROM metrics", RFM),
    "rfm_scores": over_star(f"SELECT {_METRIC_COLUMNS}, r_score, f_score, m_score FROM scores", RFM),
    "rfm_segments": over_star(
        f"""SELECT {_METRIC_COLUMNS}, r_score, f_score, m_score, rfm_score, total_rfm_score, segment
            FROM rfm""",
        RFM,
    ),
    "rfm_segment_filter": over_star(
        f"SELECT customer_key, segment FROM rfm WHERE segment IN {CHOSEN_SEGMENTS}", RFM
    ),
    "rfm_segment_distribution": over_star(
        f"""SELECT segment, customers, {_share('customers')} AS share_pct
            FROM (SELECT segment, count(*) AS customers FROM rfm GROUP BY segment)""",
        RFM,
    ),
    "rfm_segment_revenue": over_star(
        """SELECT segment, CAST(coalesce(sum(spent), 0) AS DOUBLE) AS total_spend FROM rfm GROUP BY segment""",
        RFM,
    ),
    "rfm_top_customers": over_star(
        """SELECT customer_key, city, state, recency_days, frequency,
             'R$' || format('{:,.2f}', CAST(spent AS DOUBLE)) AS monetary, segment, r_score, f_score, m_score
           FROM rfm ORDER BY spent DESC NULLS LAST, customer_key LIMIT 20""",
        RFM,
    ),
    "customer_kpis": over_star(
        """SELECT count(*) AS total_customers, count(*) FILTER (segment = 'Champions') AS champions,
             CAST(count(*) FILTER (segment = 'Champions') AS DOUBLE) / count(*) * 100 AS champions_pct,
             count(*) FILTER (segment = 'At Risk') AS at_risk,
             CAST(count(*) FILTER (segment = 'At Risk') AS DOUBLE) / count(*) * 100 AS at_risk_pct
           FROM rfm""",
        RFM,
    ),
    # Headline figures and slices.
    "headline_kpis": over_star(f"SELECT {_KPIS} FROM sales"),
    "kpi_vs_benchmark": over_star(
        f"""SELECT {_LATE_PCT} AS late_order_rate_pct,
              CASE WHEN {_LATE_PCT} > 7.9 THEN 'Above' ELSE 'Below' END AS vs_benchmark,
              {_STATUS.format(_LATE_PCT)} AS late_rate_status FROM fact"""
    ),
    "dashboard_slice": over_star(
        f"""SELECT order_id, date_key, customer_key, product_key, order_status,
              CAST(total_payment AS DOUBLE) AS total_payment FROM sales WHERE {_SLICE}"""
    ),
    "dashboard_slice_kpis": over_star(f"SELECT {_KPIS} FROM sales WHERE {_SLICE}"),
    "dashboard_slice_monthly_revenue": over_star(
        f"""SELECT year, month, month_name, {_PERIOD} AS period, {_SUM_PAID} AS revenue
            FROM sales WHERE category_en = 'unknown' GROUP BY year, month, month_name"""
    ),
    # Pages of the dashboard, sliced.
    "revenue_page_kpis": over_star(f"SELECT {_KPIS} FROM sales WHERE {_SLICE}"),
    "revenue_page_monthly_revenue": over_star(
        f"""SELECT year, month, month_name, {_PERIOD} AS period, {_SUM_PAID} AS revenue
            FROM sales WHERE {_SLICE} GROUP BY year, month, month_name"""
    ),
    "revenue_page_top_categories": over_star(
        f"""SELECT category_en, {_SUM_PAID} AS revenue FROM sales WHERE {_SLICE} AND category_en IS NOT NULL
            GROUP BY category_en ORDER BY coalesce(sum(total_payment), 0) DESC, category_en LIMIT 10"""
    ),
    "revenue_page_revenue_by_price_bucket": over_star(
        f"""SELECT price_bucket, position, CAST(revenue AS DOUBLE) AS revenue, order_count
           FROM (SELECT unnest(['budget', 'mid-range', 'premium', 'luxury']) AS price_bucket,
                        CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS position)
           LEFT JOIN (SELECT price_bucket, coalesce(sum(total_payment), 0) AS revenue,
                        count(total_payment) AS order_count FROM sales WHERE {_SLICE} GROUP BY price_bucket)
           USING (price_bucket)"""
    ),
    "revenue_page_monthly_aov": over_star(
        f"""SELECT year, month, {_PERIOD} AS period, {_MEAN_PAID} AS avg_order_value
            FROM sales WHERE {_SLICE} GROUP BY year, month"""
    ),
    "delivery_page_monthly_late_rate_mean": over_star(
        f"SELECT {_mean('late_rate_pct', 'year, month')} AS mean_monthly_late_rate_pct FROM late_months",
        _of_year(LATE_MONTHS),
    ),
    "delivery_page_kpis": over_star(f"SELECT {_KPIS} FROM sales WHERE {_YEAR}"),
    "delivery_page_delivery_by_state": over_star(
        f"""SELECT state, avg_delivery_days,
              avg_delivery_days > (SELECT {_mean('avg_delivery_days', 'state')} FROM state_days) AS above_mean
            FROM state_days""",
        _of_year(STATE_DAYS),
    ),
    "delivery_page_monthly_late_rate": over_star("SELECT * FROM late_months", _of_year(LATE_MONTHS)),
    "delivery_page_delivery_histogram": _histogram(
        "delivery_days BETWEEN 0 AND 60", "delivery_days BETWEEN 0 AND 60"
    ).replace("FROM fact WHERE delivery_days", f"FROM sales WHERE {_YEAR} AND delivery_days"),
    "delivery_page_ontime_vs_late": over_star(
        f"""SELECT is_late, CASE is_late WHEN 0 THEN 'On-Time' ELSE 'Late' END AS label, orders,
              {_share('orders')} AS share_pct
            FROM (SELECT is_late, count(*) AS orders FROM sales WHERE {_YEAR} GROUP BY is_late)"""
    ),
    "customer_page_segment_revenue": over_star(
        f"""SELECT segment, CAST(coalesce(sum(spent), 0) AS DOUBLE) AS total_spend FROM rfm
            WHERE segment IN {CHOSEN_SEGMENTS} GROUP BY segment""",
        RFM,
    ),
    "customer_page_review_distribution": over_star(
        f"""SELECT CAST(round_even(avg_review_score, 0) AS INTEGER) AS score, count(*) AS orders,
             CAST(round_even(avg_review_score, 0) AS INTEGER) < 4 AS is_low
           FROM sales WHERE {_YEAR} AND avg_review_score IS NOT NULL GROUP BY ALL"""
    ),
    "customer_page_payment_type_split": over_star(
        f"""SELECT payment_type, count(order_id) AS orders, {_SUM_PAID} AS revenue FROM sales
            WHERE {_YEAR} AND payment_type IS NOT NULL GROUP BY payment_type"""
    ),
    "customer_page_top_customers": over_star(
        f"""SELECT customer_key, city, state, recency_days, frequency,
              'R$' || format('{{:,.2f}}', CAST(spent AS DOUBLE)) AS monetary, segment, r_score, f_score, m_score
            FROM rfm WHERE segment IN {CHOSEN_SEGMENTS}
            ORDER BY spent DESC NULLS LAST, customer_key LIMIT 20""",
        RFM,
    ),
    "scaled_display": over_star(
        f"""SELECT year, 'R$' || format('{{:,.2f}}', CAST(sum(total_payment) AS DOUBLE) / 1e6) || 'M' AS revenue,
              'R$' || format('{{:,.1f}}', {quotient("sum(total_payment)", "count(*)")} / 1e3) || 'K' AS order_value,
              format('{{:,.2f}}', {_MEAN_SCORE}) || ' / 5' AS review_score
            FROM sales GROUP BY year"""
    ),
    "sql_over_views": over_star(
        """SELECT state, year, count(*) AS orders, CAST(sum(total_payment) AS DOUBLE) AS revenue
           FROM sales WHERE state IS NOT NULL AND year IS NOT NULL GROUP BY state, year"""
    ),
    # CSV out and in.
    "csv_round_trip": over_raw(" UNION ALL ".join(_metrics(t) for t in RAW_NAMES)),
    "csv_rejects": over_raw(
        """SELECT * FROM (
             SELECT 'orders' AS table_name, 'order_approved_at' AS column_name, count(*) AS rejected
             FROM raw_orders WHERE order_status = 'processing'
             UNION ALL SELECT 'order_items', 'price', count(*) FROM raw_order_items WHERE order_item_id = 3
             UNION ALL SELECT 'products', 'product_photos_qty', count(*) FROM raw_products WHERE product_photos_qty = 5)
           WHERE rejected > 0"""
    ),
    "result_round_trip": over_star(
        f"""SELECT state, {_SUM_PAID} AS revenue,
              row_number() OVER (ORDER BY coalesce(sum(total_payment), 0) DESC, state) = 1 AS is_leader
            FROM sales WHERE state IS NOT NULL GROUP BY state"""
    ),
    "slicer_values": over_star(
        """SELECT DISTINCT 'year' AS slicer, CAST(year AS VARCHAR) AS value FROM sales WHERE year IS NOT NULL
           UNION ALL SELECT DISTINCT 'category_en', category_en FROM sales WHERE category_en IS NOT NULL
           UNION ALL SELECT DISTINCT 'state', state FROM sales WHERE state IS NOT NULL"""
    ),
    "share_of_total": over_star(
        f"""SELECT chart, label, CAST(value AS DOUBLE) AS value,
              {_share('value', 'PARTITION BY chart')} AS share_pct
            FROM (
              SELECT 'revenue by price bucket' AS chart, price_bucket AS label,
                CAST(coalesce(sum(total_payment), 0) AS DECIMAL(38,2)) AS value
              FROM fact WHERE price_bucket IS NOT NULL GROUP BY price_bucket
              UNION ALL SELECT 'orders by delivery', CASE is_late WHEN 0 THEN 'On-Time' ELSE 'Late' END, count(*)
              FROM fact GROUP BY is_late
              UNION ALL SELECT 'customers by buyer type', buyer_type, customers FROM buyer
              UNION ALL SELECT 'orders by payment type', payment_type, count(order_id) FROM fact
              WHERE payment_type IS NOT NULL GROUP BY payment_type
              UNION ALL SELECT 'revenue by payment type', payment_type, coalesce(sum(total_payment), 0) FROM fact
              WHERE payment_type IS NOT NULL GROUP BY payment_type
              UNION ALL SELECT 'customers by segment', segment, count(*) FROM rfm GROUP BY segment)""",
        CUSTOMER_ORDERS,
        RFM,
    ),
    # Measures.
    "measure_totals": _measures(""),
    "measure_totals_by_month": _measures("year, month"),
    "measure_totals_by_category_year": _measures("category_en, year"),
    "measure_display": over_star(
        f"""SELECT year, 'R$' || format('{{:,.2f}}', CAST(sum(total_payment) AS DOUBLE)) AS total_revenue,
              format('{{:,}}', count(*)) AS total_orders,
              'R$' || format('{{:,.2f}}', {quotient("sum(total_payment)", "count(*)")}) AS avg_order_value,
              format('{{:,.1f}}', {_LATE_MEASURE}) || '%' AS late_order_rate_pct,
              format('{{:,.1f}}', {_MEAN_DAYS}) AS avg_delivery_days,
              format('{{:,.2f}}', {_MEAN_SCORE}) AS avg_review_score
            FROM sales GROUP BY year"""
    ),
    "late_rate_status": over_star(
        f"""SELECT year, month, {_LATE_MEASURE} AS late_order_rate_pct,
              {_STATUS.format(_LATE_MEASURE)} AS late_rate_status FROM sales GROUP BY year, month"""
    ),
    "revenue_yoy": _yoy("year, month"),
    "revenue_yoy_by_year": _yoy("year"),
    "rolling_30d_calendar": over_star(
        """SELECT full_date, CAST(sum(revenue) OVER (ORDER BY full_date
             RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS rolling_30d_revenue
           FROM by_day""",
        BY_DAY,
    ),
    "revenue_mtd": over_star(
        """SELECT full_date, CAST(sum(revenue) OVER (PARTITION BY year, month ORDER BY full_date
             ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS revenue_mtd
           FROM by_day""",
        BY_DAY,
    ),
    "revenue_mtd_by_month": over_star(
        """SELECT year, month, max(full_date) AS last_date, CAST(sum(revenue) AS DOUBLE) AS revenue_mtd
           FROM by_day GROUP BY year, month""",
        BY_DAY,
    ),
    "revenue_yoy_by_category_month": over_star(
        f"""SELECT category_en, year, month, CAST(now AS DOUBLE) AS revenue, CAST(before AS DOUBLE) AS prior_revenue,
              coalesce({quotient("coalesce(now, 0) - before", "before")}, 0) * 100 AS revenue_yoy_pct
            FROM (SELECT category_en, year, month, sum(now) AS now, sum(before) AS before
                  FROM (SELECT category_en, full_date, revenue AS now, NULL AS before FROM group_days
                        UNION ALL
                        SELECT category_en, CAST(full_date + INTERVAL 1 YEAR AS DATE), NULL, revenue FROM group_days)
                  JOIN dim_date USING (full_date) GROUP BY category_en, year, month)""",
        GROUP_DAYS.format("category_en"),
    ),
    "rolling_30d_by_state": over_star(
        """SELECT state, d.full_date, CAST(sum(revenue) AS DOUBLE) AS rolling_30d_revenue
           FROM dim_date d JOIN group_days g ON g.full_date BETWEEN d.full_date - 29 AND d.full_date
           GROUP BY state, d.full_date""",
        GROUP_DAYS.format("state"),
    ),
    "revenue_mtd_by_category": over_star(
        """SELECT category_en, year, month, last_date, CAST(sum(revenue) AS DOUBLE) AS revenue_mtd
           FROM group_days JOIN dim_date USING (full_date)
           JOIN (SELECT year, month, max(full_date) AS last_date FROM dim_date GROUP BY year, month) USING (year, month)
           GROUP BY category_en, year, month, last_date""",
        GROUP_DAYS.format("category_en"),
    ),
}
