"""Every analysis as Spark SQL text over the role views (``r_<role>``).

The texts ask the questions of the DataFrame functions with their default
parameters; tests check that both agree.  The tails of the significance tests
are temporary SQL functions (``FUNCTIONS``), created with the views.
"""

from __future__ import annotations

from emporia.functions.stats import LANCZOS, TERMS

_LANCZOS_SUM = " + ".join([f"{LANCZOS[0]}D"] + [f"({c}D) / (x + {i}D)" for i, c in enumerate(LANCZOS[1:])])

#: name -> (parameters, body): series and continued fractions, as in emporia.functions.stats.
FUNCTIONS = {
    "log_gamma": ("x DOUBLE", f"0.9189385332046727D + (x - 0.5D) * ln(x + 6.5D) - (x + 6.5D) + ln({_LANCZOS_SUM})"),
    "gamma_sf": ("a DOUBLE, x DOUBLE", f"""
        CASE WHEN x <= 0 THEN 1D
             WHEN x < a + 1 THEN 1D - exp(a * ln(x) - x - log_gamma(a)) * aggregate(
               sequence(1, {TERMS}), named_struct('t', 1D / a, 's', 1D / a),
               (v, n) -> named_struct('t', v.t * x / (a + n), 's', v.s + v.t * x / (a + n)), v -> v.s)
             ELSE exp(a * ln(x) - x - log_gamma(a)) / aggregate(
               sequence(1, {TERMS + 1}), x + 2D * {TERMS + 1} + 1D - a,
               (v, n) -> x + 2D * ({TERMS + 1} - n) + 1D - a - ({TERMS + 1} - n + 1D) * ({TERMS + 1} - n + 1D - a) / v)
        END"""),
    "beta_part": ("a DOUBLE, b DOUBLE, x DOUBLE", f"""
        exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * ln(x) + b * ln(1D - x)) / (a * aggregate(
          sequence(0, {TERMS}), 1D, (v, n) -> 1D + CASE WHEN ({TERMS} - n) % 2 = 0
            THEN -(a + floor(({TERMS} - n) / 2)) * (a + b + floor(({TERMS} - n) / 2)) * x
                 / ((a + 2D * floor(({TERMS} - n) / 2)) * (a + 2D * floor(({TERMS} - n) / 2) + 1D))
            ELSE floor(({TERMS} - n + 1) / 2) * (b - floor(({TERMS} - n + 1) / 2)) * x
                 / ((a + 2D * floor(({TERMS} - n + 1) / 2) - 1D) * (a + 2D * floor(({TERMS} - n + 1) / 2))) END / v))"""),
    "beta_sf": ("a DOUBLE, b DOUBLE, x DOUBLE", """
        CASE WHEN x <= 0 THEN 0D WHEN x >= 1 THEN 1D WHEN x < (a + 1D) / (a + b + 2D) THEN beta_part(a, b, x)
             ELSE 1D - beta_part(b, a, 1D - x) END"""),
    "normal_sf": ("z DOUBLE", "CASE WHEN z >= 0 THEN 0.5D * gamma_sf(0.5D, z * z / 2D) ELSE 1D - 0.5D * gamma_sf(0.5D, z * z / 2D) END"),
    "student_sf": ("t DOUBLE, df DOUBLE", """
        CASE WHEN df > 10000 THEN greatest(0D, normal_sf(t) + exp(-t * t / 2D) / 2.5066282746310002D * t * (
                    (t * t + 1D) / (4D * df) + (((3D * t * t - 7D) * t * t - 5D) * t * t - 3D) / (96D * df * df)))
             WHEN t >= 0 THEN 0.5D * beta_sf(df / 2D, 0.5D, df / (df + t * t)) ELSE 1D - 0.5D * beta_sf(df / 2D, 0.5D, df / (df + t * t)) END"""),
}


def create_functions(spark) -> None:
    """Create the temporary SQL functions that the texts use."""
    for name, (parameters, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {body}")


_PERSONS = """
per_order_pay AS (SELECT order_id, sum(value) AS amount FROM r_payment GROUP BY order_id),
attributed AS (
  SELECT o.*, c.person_id, c.state, c.city FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id
),
per_person AS (
  SELECT a.person_id, sum(p.amount) AS amount, count(*) AS orders
  FROM attributed a LEFT JOIN per_order_pay p ON p.order_id = a.order_id GROUP BY a.person_id
),
top AS (SELECT * FROM per_person ORDER BY amount DESC NULLS LAST, person_id LIMIT 100),
top_orders AS (SELECT order_id, person_id FROM attributed WHERE person_id IN (SELECT person_id FROM top))
"""

_REVIEW = "latest AS (SELECT order_id, max_by(score, struct(review_ts, score)) AS score FROM r_review GROUP BY order_id)"

_GAPS = """
days AS (
  SELECT c.person_id, to_date(o.purchase_ts) AS day, count(*) AS n
  FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id GROUP BY ALL
),
steps AS (
  SELECT datediff(day, lag(day) OVER (PARTITION BY person_id ORDER BY day)) AS gap_days, n - 1 AS same_day FROM days
),
hist AS (
  SELECT gap_days, sum(gaps) AS gaps FROM (
    SELECT gap_days, 1L AS gaps FROM steps WHERE gap_days IS NOT NULL
    UNION ALL SELECT 0, same_day FROM steps WHERE same_day > 0)
  GROUP BY gap_days
)
"""

_MONTHS = """
order_sales AS (SELECT order_id, sum(price) AS sales FROM r_item GROUP BY order_id),
per_month AS (
  SELECT trunc(to_date(o.purchase_ts), 'month') AS month, sum(s.sales) AS sales,
         min(to_date(o.purchase_ts)) AS lo, max(to_date(o.purchase_ts)) AS hi
  FROM r_order o LEFT JOIN order_sales s ON s.order_id = o.order_id GROUP BY 1
),
bounds AS (SELECT min(lo) AS lo, max(hi) AS hi FROM per_month),
spine AS (SELECT lo, hi, explode(sequence(trunc(lo, 'month'), trunc(hi, 'month'), interval 1 month)) AS month FROM bounds),
months AS (
  SELECT s.month, coalesce(m.sales, 0) AS sales, s.month >= s.lo AND last_day(s.month) <= s.hi AS complete
  FROM spine s LEFT JOIN per_month m ON m.month = s.month
)
"""

_UNITS = """
product_units AS (SELECT product_id, sum(units) AS units FROM r_item GROUP BY product_id),
classes AS (
  SELECT product_id, units,
         CASE WHEN units <= (SELECT percentile(units, 0.25) FROM product_units) THEN 'slow'
              WHEN units >= (SELECT percentile(units, 0.75) FROM product_units) THEN 'hot' ELSE 'mid' END AS class
  FROM product_units
)
"""

_FREIGHT = """
order_freight AS (SELECT order_id, sum(freight) AS freight FROM r_item GROUP BY order_id),
top AS (SELECT * FROM order_freight ORDER BY freight DESC NULLS LAST, order_id LIMIT 100),
places AS (
  SELECT i.*, pow(sin((radians(sg.lat) - radians(cg.lat)) / 2), 2)
              + cos(radians(cg.lat)) * cos(radians(sg.lat)) * pow(sin((radians(sg.lng) - radians(cg.lng)) / 2), 2) AS h
  FROM r_item i
  LEFT JOIN r_seller s ON s.seller_id = i.seller_id LEFT JOIN r_geo sg ON sg.geo_key = s.geo_key
  LEFT JOIN r_order o ON o.order_id = i.order_id
  LEFT JOIN r_customer c ON c.customer_id = o.customer_id LEFT JOIN r_geo cg ON cg.geo_key = c.geo_key
),
features AS (
  SELECT i.order_id, count(*) AS items, sum(i.freight) AS freight, sum(p.weight_g) AS weight_g,
         sum(p.length_cm * p.height_cm * p.width_cm) AS volume_cm3,
         max(CAST(round(12742D * asin(sqrt(CASE WHEN h > 1 THEN 1D ELSE h END)) * 1000) AS BIGINT)) AS distance_m
  FROM places i LEFT JOIN r_product p ON p.product_id = i.product_id GROUP BY i.order_id
)
"""

_CITIES = """
order_sales AS (SELECT order_id, sum(price) AS sales FROM r_item GROUP BY order_id),
per_order_pay AS (SELECT order_id, sum(value) AS amount FROM r_payment GROUP BY order_id),
latest AS (SELECT add_months(trunc(date_add(max(to_date(purchase_ts)), 1), 'quarter'), -3) AS cur FROM r_order),
per_buyer AS (
  SELECT c.state, c.city, c.person_id, count(*) AS orders, sum(s.sales) AS sales, sum(p.amount) AS amount,
         count_if(to_date(o.purchase_ts) >= add_months((SELECT cur FROM latest), -3) AND to_date(o.purchase_ts) < (SELECT cur FROM latest)) AS before,
         count_if(to_date(o.purchase_ts) >= (SELECT cur FROM latest) AND to_date(o.purchase_ts) < add_months((SELECT cur FROM latest), 3)) AS recent
  FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id
  LEFT JOIN order_sales s ON s.order_id = o.order_id LEFT JOIN per_order_pay p ON p.order_id = o.order_id
  GROUP BY c.state, c.city, c.person_id
),
cities AS (
  SELECT state, city, sum(orders) AS orders, coalesce(sum(sales), 0) AS sales, count(*) AS customers,
         CAST(coalesce(sum(amount), 0) AS DOUBLE) / CAST(sum(orders) AS DOUBLE) AS aov,
         try_divide(CAST(sum(recent) AS DOUBLE), CAST(nullif(sum(before), 0) AS DOUBLE)) - 1D AS growth
  FROM per_buyer GROUP BY state, city
)
"""

_STATES = """
crossed AS (
  SELECT i.order_id, i.product_id, i.freight, s.state <> c.state AS cross
  FROM r_item i JOIN r_order o ON o.order_id = i.order_id
  LEFT JOIN r_seller s ON s.seller_id = i.seller_id LEFT JOIN r_customer c ON c.customer_id = o.customer_id
)
"""

_METHODS = """
methods AS (SELECT DISTINCT order_id, coalesce(payment_type, 'unknown') AS payment_type FROM r_payment),
paid AS (SELECT m.payment_type, o.order_id, o.status FROM methods m JOIN r_order o ON o.order_id = m.order_id)
"""

_SELLERS = f"""
{_REVIEW},
rated AS (SELECT DISTINCT i.order_id, i.seller_id, r.score FROM r_item i JOIN latest r ON r.order_id = i.order_id),
sellers AS (SELECT seller_id, count(*) AS reviews, count_if(score <= 2) AS bad FROM rated GROUP BY seller_id)
"""


# Sellers by number of bad reviews: at most about sqrt(2 * all bad reviews) rows, so one task may order them.
_ABOVE = """
above AS (
  SELECT bad AS value, count(*) AS n,
         coalesce(sum(count(*)) OVER (ORDER BY bad DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         coalesce(sum(count(*) * bad) OVER (ORDER BY bad DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_bad
  FROM sellers GROUP BY bad
)
"""

#: Expected number of cut points (seller ids picked by hash) that split the sellers of one value into ranges.
_SLICES = 256


def _welch(direction: str) -> str:
    """CTE ``test`` over ``m`` (n1, m1, v1, n2, m2, v2), and the select list of t, df, p."""
    sign = "" if direction == "greater" else "-"
    return f"""
parts AS (SELECT *, n1 >= 2 AND n2 >= 2 AND v1 / n1 + v2 / n2 > 0 AS ok, v1 / n1 AS a, v2 / n2 AS b FROM m),
test AS (
  SELECT *, CASE WHEN ok THEN (m1 - m2) / sqrt(a + b) END AS t0,
         CASE WHEN ok THEN (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) END AS df0 FROM parts
),
tested AS (SELECT *, student_sf({sign}t0, df0) AS p0 FROM test)
"""


_TEST = "round(t0, 6) AS t, round(df0, 6) AS df, round(p0, 9) AS p_one_sided"


def _groups(flag: str) -> str:
    """Moments of x on both sides of a flag."""
    return (f"count_if({flag}) AS n1, avg(x) FILTER (WHERE {flag}) AS m1, var_samp(x) FILTER (WHERE {flag}) AS v1, "
            f"count_if(NOT {flag}) AS n2, avg(x) FILTER (WHERE NOT {flag}) AS m2, var_samp(x) FILTER (WHERE NOT {flag}) AS v2")


SPARK_SQL = {
    "top_customers": f"""
        WITH {_PERSONS}
        SELECT person_id, CAST(amount AS DOUBLE) AS order_amount, CAST(orders AS BIGINT) AS orders,
               CAST(row_number() OVER (ORDER BY amount DESC NULLS LAST, person_id) AS BIGINT) AS rank
        FROM top
    """,
    "top_customer_geo": f"""
        WITH {_PERSONS},
        home AS (
          SELECT person_id, max_by(struct(state, city), struct(purchase_ts, order_id)) AS at
          FROM attributed WHERE person_id IN (SELECT person_id FROM top) GROUP BY person_id
        )
        SELECT at.state AS state, at.city AS city, count(*) AS customers, CAST(sum(amount) AS DOUBLE) AS order_amount,
               round(CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS customer_share
        FROM top JOIN home USING (person_id) GROUP BY at.state, at.city
    """,
    "top_customer_categories": f"""
        WITH {_PERSONS},
        bought AS (
          SELECT i.product_id, t.person_id, sum(i.units) AS units, sum(i.price) AS sales
          FROM r_item i JOIN top_orders t ON t.order_id = i.order_id GROUP BY ALL
        ),
        per_category AS (
          SELECT coalesce(p.category, 'unknown') AS category, count(DISTINCT person_id) AS customers, sum(units) AS units, sum(sales) AS sales
          FROM bought b LEFT JOIN r_product p ON p.product_id = b.product_id GROUP BY 1
        )
        SELECT category, customers, units, CAST(sales AS DOUBLE) AS sales,
               CAST(row_number() OVER (ORDER BY units DESC, category) AS BIGINT) AS rank
        FROM per_category
    """,
    "top_customer_category_profile": f"""
        WITH {_PERSONS},
        bought AS (
          SELECT i.product_id, sum(i.units) AS units FROM r_item i
          WHERE i.order_id IN (SELECT order_id FROM top_orders) GROUP BY i.product_id
        ),
        known AS (
          SELECT coalesce(p.category, 'unknown') AS category, b.units, d.desc_len, p.photo_cnt, p.name_len, p.weight_g
          FROM bought b LEFT JOIN r_product p ON p.product_id = b.product_id
          LEFT JOIN r_description d ON d.product_id = b.product_id
        )
        SELECT category, sum(units) AS units,
               round(CAST(sum(units * desc_len) AS DOUBLE) / sum(units) FILTER (WHERE desc_len IS NOT NULL), 6) AS avg_desc_len,
               round(CAST(sum(units * photo_cnt) AS DOUBLE) / sum(units) FILTER (WHERE photo_cnt IS NOT NULL), 6) AS avg_photos,
               round(CAST(sum(units * name_len) AS DOUBLE) / sum(units) FILTER (WHERE name_len IS NOT NULL), 6) AS avg_name_len,
               round(CAST(sum(units * weight_g) AS DOUBLE) / sum(units) FILTER (WHERE weight_g IS NOT NULL), 6) AS avg_weight
        FROM known GROUP BY category ORDER BY units DESC, category LIMIT 20
    """,
    "top_customer_payment_aov": f"""
        WITH {_PERSONS},
        paid AS (
          SELECT order_id, coalesce(payment_type, 'unknown') AS payment_type, sum(value) AS value FROM r_payment
          WHERE order_id IN (SELECT order_id FROM top_orders) GROUP BY ALL
        )
        SELECT payment_type, count(DISTINCT order_id) AS orders, CAST(sum(value) AS DOUBLE) AS payment_value,
               round(CAST(sum(value) AS DOUBLE) / count(DISTINCT order_id), 6) AS aov
        FROM paid GROUP BY ROLLUP (payment_type)
    """,
    "user_growth": """
        WITH per_person AS (
          SELECT c.person_id, trunc(to_date(min(o.purchase_ts)), 'month') AS month
          FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id GROUP BY c.person_id
        ),
        counts AS (SELECT month, count(*) AS n FROM per_person GROUP BY month),
        spine AS (SELECT explode(sequence(min(month), max(month), interval 1 month)) AS month FROM counts),
        filled AS (
          SELECT s.month, CAST(coalesce(c.n, 0) AS BIGINT) AS new_users FROM spine s LEFT JOIN counts c ON c.month = s.month
        )
        SELECT month, new_users,
               CAST(sum(new_users) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_users
        FROM filled
    """,
    "repeat_rate": """
        WITH per_person AS (
          SELECT c.person_id, count(*) AS n
          FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id GROUP BY c.person_id
        )
        SELECT CAST(count(*) AS BIGINT) AS customers, CAST(count_if(n >= 2) AS BIGINT) AS repeat_customers,
               round(try_divide(CAST(count_if(n >= 2) AS DOUBLE), CAST(count(*) AS DOUBLE)), 6) AS repeat_rate
        FROM per_person
    """,
    "repurchase_gaps": f"""
        WITH {_GAPS},
        buckets AS (
          SELECT * FROM VALUES ('0', 0L, 0L), ('1-7', 1L, 7L), ('8-30', 8L, 30L), ('31-90', 31L, 90L), ('91-180', 91L, 180L),
            ('181-365', 181L, 365L), ('366+', 366L, 1000000L) AS b(bucket, bucket_lo, bucket_hi)
        ),
        labelled AS (
          SELECT CASE WHEN gap_days = 0 THEN '0' WHEN gap_days <= 7 THEN '1-7' WHEN gap_days <= 30 THEN '8-30' WHEN gap_days <= 90 THEN '31-90'
                      WHEN gap_days <= 180 THEN '91-180' WHEN gap_days <= 365 THEN '181-365' ELSE '366+' END AS bucket, gaps FROM hist
        ),
        counted AS (
          SELECT b.bucket, b.bucket_lo, coalesce(sum(l.gaps), 0L) AS gaps
          FROM buckets b LEFT JOIN labelled l ON l.bucket = b.bucket GROUP BY b.bucket, b.bucket_lo
        )
        SELECT bucket, bucket_lo, gaps,
               round(try_divide(CAST(gaps AS DOUBLE), CAST(sum(gaps) OVER () AS DOUBLE)), 6) AS share
        FROM counted
    """,
    "repurchase_gap_summary": f"""
        WITH {_GAPS}
        SELECT coalesce(sum(gaps), 0L) AS gaps, round(try_divide(CAST(sum(gap_days * gaps) AS DOUBLE), CAST(sum(gaps) AS DOUBLE)), 6) AS avg_days,
               round(percentile(gap_days, 0.5, gaps), 6) AS p50, round(percentile(gap_days, 0.9, gaps), 6) AS p90
        FROM hist
    """,
    "first_vs_repeat_categories": """
        WITH attributed AS (
          SELECT o.order_id, c.person_id, coalesce(o.purchase_ts, TIMESTAMP_NTZ '0001-01-01 00:00:00') AS at
          FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id
        ),
        per_person AS (SELECT person_id, min(at) AS at, count(*) AS n FROM attributed GROUP BY person_id),
        firsts AS (
          SELECT min(a.order_id) AS order_id, p.n FROM attributed a JOIN per_person p ON p.person_id = a.person_id AND p.at = a.at
          GROUP BY a.person_id, p.n
        ),
        flags AS (
          SELECT a.order_id, f.n IS NOT NULL AS is_first FROM attributed a LEFT JOIN firsts f ON f.order_id = a.order_id
          WHERE f.n IS NULL OR f.n >= 2
        ),
        per_category AS (
          SELECT coalesce(p.category, 'unknown') AS category, sum(CASE WHEN is_first THEN i.units ELSE 0 END) AS fu,
                 sum(CASE WHEN is_first THEN 0 ELSE i.units END) AS ru
          FROM r_item i JOIN flags f ON f.order_id = i.order_id LEFT JOIN r_product p ON p.product_id = i.product_id GROUP BY 1
        ),
        shares AS (
          SELECT *, try_divide(CAST(fu AS DOUBLE), CAST(sum(fu) OVER () AS DOUBLE)) AS fs,
                 try_divide(CAST(ru AS DOUBLE), CAST(sum(ru) OVER () AS DOUBLE)) AS rs,
                 row_number() OVER (ORDER BY ru DESC, category) AS rk
          FROM per_category
        )
        SELECT category, fu AS first_units, ru AS repeat_units, round(fs, 6) AS first_share, round(rs, 6) AS repeat_share,
               round(try_divide(rs, nullif(fs, 0)), 6) AS lift, CAST(rk AS BIGINT) AS repeat_rank
        FROM shares WHERE rk <= 20
    """,
    "repeat_vs_single_score": f"""
        WITH {_REVIEW},
        per_person AS (
          SELECT c.person_id, count(*) >= 2 AS rep, sum(r.score) / count(r.score) AS x
          FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id LEFT JOIN latest r ON r.order_id = o.order_id
          GROUP BY c.person_id HAVING count(r.score) > 0
        ),
        m AS (SELECT {_groups("rep")} FROM per_person), {_welch("greater")}
        SELECT n1 AS n_repeat, round(m1, 6) AS mean_repeat, n2 AS n_single, round(m2, 6) AS mean_single, {_TEST} FROM tested
    """,
    "sales_growth": f"""
        WITH {_MONTHS},
        pairs AS (SELECT *, lag(sales) OVER (ORDER BY month) AS prev FROM months)
        SELECT month, CAST(sales AS DOUBLE) AS sales, CAST(prev AS DOUBLE) AS prev_sales,
               round(try_divide(CAST(sales AS DOUBLE), CAST(nullif(prev, 0) AS DOUBLE)) - 1D, 6) AS growth, complete
        FROM pairs
    """,
    "sales_seasonality": f"""
        WITH {_MONTHS},
        by_month AS (
          SELECT month(month) AS moy, CAST(sum(sales) AS DOUBLE) / count(*) AS mean, sum(sales) AS s, count(*) AS n
          FROM months WHERE complete GROUP BY 1
        )
        SELECT CAST(moy AS BIGINT) AS month_of_year, round(mean, 6) AS avg_sales,
               round(try_divide(mean, nullif(CAST(sum(s) OVER () AS DOUBLE) / sum(n) OVER (), 0)), 6) AS index
        FROM by_month
    """,
    "top_categories_share": """
        WITH per_cat AS (
          SELECT coalesce(p.category, 'unknown') AS category, sum(i.price) AS sales
          FROM r_item i LEFT JOIN r_product p ON p.product_id = i.product_id GROUP BY 1
        ),
        shares AS (
          SELECT category, sales, CAST(sales AS DOUBLE) / CAST((SELECT sum(sales) FROM per_cat) AS DOUBLE) AS share FROM per_cat
        ),
        top AS (SELECT * FROM shares ORDER BY sales DESC, category LIMIT 10)
        SELECT category, CAST(sales AS DOUBLE) AS sales, round(share, 6) AS share,
               CAST(row_number() OVER (ORDER BY sales DESC, category) AS BIGINT) AS rank
        FROM top
    """,
    "fastest_growing_categories": """
        WITH latest AS (SELECT add_months(trunc(date_add(max(to_date(purchase_ts)), 1), 'quarter'), -3) AS cur FROM r_order),
        sold AS (
          SELECT i.product_id, to_date(o.purchase_ts) >= (SELECT cur FROM latest) AS is_cur, i.units
          FROM r_item i JOIN r_order o ON o.order_id = i.order_id
          WHERE to_date(o.purchase_ts) >= add_months((SELECT cur FROM latest), -3)
            AND to_date(o.purchase_ts) < add_months((SELECT cur FROM latest), 3)
        ),
        per_category AS (
          SELECT coalesce(p.category, 'unknown') AS category, sum(CASE WHEN is_cur THEN 0 ELSE units END) AS prev_units,
                 sum(CASE WHEN is_cur THEN units ELSE 0 END) AS cur_units
          FROM sold s LEFT JOIN r_product p ON p.product_id = s.product_id GROUP BY 1
        ),
        grown AS (SELECT *, CAST(cur_units AS DOUBLE) / CAST(prev_units AS DOUBLE) - 1D AS g FROM per_category WHERE prev_units >= 1),
        ranked AS (SELECT *, row_number() OVER (ORDER BY g DESC, category) AS rk FROM grown)
        SELECT category, (SELECT cur FROM latest) AS period, prev_units, cur_units, round(g, 6) AS growth, CAST(rk AS BIGINT) AS rank
        FROM ranked WHERE rk <= 10
    """,
    "hot_slow_products": f"""
        WITH {_UNITS} SELECT product_id, units, class FROM classes
    """,
    "hot_slow_bad_review_rate": f"""
        WITH {_UNITS}, {_REVIEW},
        rated AS (
          SELECT c.class, r.score <= 2 AS bad
          FROM (SELECT DISTINCT order_id, product_id FROM r_item) i JOIN latest r ON r.order_id = i.order_id
          JOIN classes c ON c.product_id = i.product_id WHERE r.score IS NOT NULL
        ),
        m AS (
          SELECT count_if(class = 'slow') AS n1, count_if(class = 'slow' AND bad) AS x1,
                 count_if(class = 'hot') AS n2, count_if(class = 'hot' AND bad) AS x2 FROM rated
        ),
        e AS (SELECT *, try_divide(CAST(x1 + x2 AS DOUBLE), CAST(n1 + n2 AS DOUBLE)) AS pooled FROM m),
        s AS (SELECT *, sqrt(pooled * (1D - pooled) * (try_divide(1D, n1) + try_divide(1D, n2))) AS se FROM e),
        z AS (SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2 AND se > 0 THEN (CAST(x1 AS DOUBLE) / n1 - CAST(x2 AS DOUBLE) / n2) / se END AS z0 FROM s),
        t AS (SELECT *, normal_sf(z0) AS p0 FROM z)
        SELECT n1 AS n_slow, x1 AS bad_slow, round(try_divide(CAST(x1 AS DOUBLE), n1), 6) AS rate_slow,
               n2 AS n_hot, x2 AS bad_hot, round(try_divide(CAST(x2 AS DOUBLE), n2), 6) AS rate_hot,
               round(z0, 6) AS z, round(p0, 9) AS p_one_sided
        FROM t
    """,
    "top_freight_orders": f"""
        WITH {_FREIGHT}
        SELECT f.order_id, CAST(f.freight AS DOUBLE) AS freight, f.distance_m / 1000D AS distance_km, f.weight_g, f.volume_cm3, f.items,
               CAST(row_number() OVER (ORDER BY f.freight DESC NULLS LAST, f.order_id) AS BIGINT) AS rank
        FROM features f JOIN top t ON t.order_id = f.order_id
    """,
    "freight_order_profile": f"""
        WITH {_FREIGHT},
        flagged AS (SELECT f.*, t.order_id IS NOT NULL AS is_top FROM features f LEFT JOIN top t ON t.order_id = f.order_id)
        SELECT is_top, count(*) AS orders, round(CAST(sum(freight) AS DOUBLE) / count(freight), 6) AS avg_freight,
               round(try_divide(CAST(sum(distance_m) AS DOUBLE), count(distance_m)) / 1000D, 6) AS avg_distance,
               round(try_divide(sum(weight_g), count(weight_g)), 6) AS avg_weight,
               round(try_divide(sum(volume_cm3), count(volume_cm3)), 6) AS avg_volume
        FROM flagged GROUP BY is_top
    """,
    "late_vs_ontime_score": f"""
        WITH {_REVIEW},
        known AS (
          SELECT to_date(o.delivered_ts) > to_date(o.promised_ts) AS late, CAST(r.score AS DOUBLE) AS x
          FROM r_order o JOIN latest r ON r.order_id = o.order_id WHERE o.delivered_ts IS NOT NULL AND o.promised_ts IS NOT NULL
        ),
        m AS (SELECT {_groups("late")} FROM known), {_welch("less")}
        SELECT n1 AS n_late, round(m1, 6) AS mean_late, n2 AS n_ontime, round(m2, 6) AS mean_ontime, {_TEST} FROM tested
    """,
    "late_orders_by_city": """
        WITH per_city AS (
          SELECT c.state, c.city, count_if(to_date(o.delivered_ts) > to_date(o.promised_ts)) AS late,
                 count(to_date(o.delivered_ts) > to_date(o.promised_ts)) AS known
          FROM r_order o JOIN r_customer c ON c.customer_id = o.customer_id GROUP BY c.state, c.city
        )
        SELECT state, city, late AS late_orders, known AS delivered_orders,
               round(CAST(late AS DOUBLE) / nullif(known, 0), 6) AS late_rate,
               round(CAST(late AS DOUBLE) / nullif((SELECT sum(late) FROM per_city), 0), 6) AS late_share
        FROM per_city
    """,
    "city_penetration": f"""
        WITH {_CITIES} SELECT state, city, orders, CAST(sales AS DOUBLE) AS sales, customers FROM cities
    """,
    "low_penetration_high_potential": f"""
        WITH {_CITIES}
        SELECT state, city, orders, CAST(sales AS DOUBLE) AS sales, customers, round(aov, 6) AS aov,
               round(growth, 6) AS order_growth
        FROM cities WHERE orders >= 1 AND orders <= (SELECT percentile(orders, 0.5) FROM cities)
          AND aov >= (SELECT percentile(aov, 0.75) FROM cities)
    """,
    "cross_state_order_share": f"""
        WITH {_STATES},
        per_order AS (SELECT order_id, max(CAST(cross AS INT)) AS x FROM crossed GROUP BY order_id)
        SELECT count(x) AS orders, coalesce(sum(x), 0L) AS cross_orders,
               round(try_divide(CAST(sum(x) AS DOUBLE), CAST(count(x) AS DOUBLE)), 6) AS share,
               count(*) - count(x) AS unknown_orders
        FROM per_order
    """,
    "cross_state_freight": f"""
        WITH {_STATES},
        weighed AS (
          SELECT c.cross, c.freight, CAST(c.freight AS DOUBLE) AS x, p.weight_g
          FROM crossed c LEFT JOIN r_product p ON p.product_id = c.product_id
        ),
        m AS (
          SELECT {_groups("cross")}, count(*) - count(cross) AS n0,
                 sum(freight) FILTER (WHERE cross AND weight_g IS NOT NULL) AS f1, sum(weight_g) FILTER (WHERE cross) AS w1,
                 sum(freight) FILTER (WHERE NOT cross AND weight_g IS NOT NULL) AS f2, sum(weight_g) FILTER (WHERE NOT cross) AS w2
          FROM weighed
        ), {_welch("greater")}
        SELECT n1 AS n_cross, round(m1, 6) AS mean_cross, n2 AS n_same, round(m2, 6) AS mean_same,
               round(CAST(f1 AS DOUBLE) / nullif(w1 / 1000D, 0), 6) AS per_kg_cross,
               round(CAST(f2 AS DOUBLE) / nullif(w2 / 1000D, 0), 6) AS per_kg_same, n0 AS n_unknown, {_TEST}
        FROM tested
    """,
    "completion_rate_by_payment": f"""
        WITH {_METHODS}
        SELECT payment_type, count(*) AS orders, count_if(status = 'delivered') AS completed,
               round(CAST(count_if(status = 'delivered') AS DOUBLE) / count(*), 6) AS completion_rate
        FROM paid GROUP BY payment_type
    """,
    "completion_payment_chi2": f"""
        WITH {_METHODS},
        cells AS (
          SELECT payment_type, CAST(count(*) AS DOUBLE) AS o, CAST(count_if(status = 'delivered') AS DOUBLE) AS c FROM paid GROUP BY payment_type
        ),
        margins AS (SELECT *, sum(o) OVER () AS n_all, sum(c) OVER () AS c_all, count(*) OVER () AS methods FROM cells),
        x AS (
          SELECT sum(pow(c - o * c_all / n_all, 2) / (o * c_all / n_all)
                     + pow(o - c - o * (n_all - c_all) / n_all, 2) / (o * (n_all - c_all) / n_all)) AS x2, max(methods) - 1 AS k
          FROM margins WHERE c_all > 0 AND c_all < n_all AND methods > 1
        ),
        p AS (SELECT *, gamma_sf(k / 2D, x2 / 2D) AS p0 FROM x)
        SELECT round(x2, 6) AS statistic, k AS dof, round(p0, 9) AS p_value FROM p
    """,
    "avg_order_amount_by_payment": f"""
        WITH {_METHODS},
        amounts AS (SELECT order_id, sum(value) AS amount FROM r_payment GROUP BY order_id)
        SELECT p.payment_type, count(*) AS orders, round(CAST(sum(a.amount) AS DOUBLE) / count(*), 6) AS avg_order_amount
        FROM paid p JOIN amounts a ON a.order_id = p.order_id GROUP BY p.payment_type
    """,
    "installment_avg_payment": """
        SELECT CAST(installments AS BIGINT) AS installments, CAST(count(*) AS BIGINT) AS payments,
               round(try_divide(CAST(sum(value) AS DOUBLE), CAST(count(*) AS DOUBLE)), 6) AS avg_value,
               round(try_divide(sum(CAST(value AS DOUBLE) / installments), CAST(count(*) AS DOUBLE)), 6) AS avg_installment
        FROM r_payment WHERE installments >= 2
        GROUP BY ROLLUP (installments)
    """,
    "seller_bad_review_concentration": f"""
        WITH {_SELLERS}, {_ABOVE},
        totals AS (SELECT CAST(sum(bad) AS DOUBLE) AS tb, CAST(sum(reviews) AS DOUBLE) AS tr FROM sellers),
        cuts AS (
          SELECT collect_list(seller_id) AS ids FROM sellers
          WHERE pmod(xxhash64(seller_id), (SELECT greatest(count(*), 1) FROM sellers)) < {_SLICES}
        ),
        cut AS (SELECT *, (SELECT ids FROM cuts) AS ids FROM sellers),
        sliced AS (SELECT seller_id, reviews, bad, size(filter(ids, c -> c <= seller_id)) AS slice FROM cut),
        earlier AS (
          SELECT bad AS b, slice AS s, coalesce(sum(count(*)) OVER (PARTITION BY bad ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip
          FROM sliced GROUP BY bad, slice
        ),
        placed AS (SELECT *, row_number() OVER (PARTITION BY bad, slice ORDER BY seller_id) AS place FROM sliced),
        ranked AS (
          SELECT p.*, a.before + e.skip + p.place AS rk, a.before_bad + p.bad * (e.skip + p.place) AS running,
                 (SELECT tb FROM totals) AS tb, (SELECT tb / tr FROM totals) AS p0
          FROM placed p JOIN earlier e ON e.b = p.bad AND e.s = p.slice JOIN above a ON a.value = p.bad
        )
        SELECT seller_id, reviews, bad, round(CAST(bad AS DOUBLE) / reviews, 6) AS bad_rate, round(try_divide(CAST(bad AS DOUBLE), tb), 6) AS bad_share,
               round(try_divide(CAST(running AS DOUBLE), tb), 6) AS cum_share, CAST(rk AS BIGINT) AS rank,
               round(CASE WHEN reviews >= 2 AND p0 > 0 AND p0 < 1
                          THEN (CAST(bad AS DOUBLE) / reviews - p0) / sqrt(p0 * (1D - p0) / reviews) END, 6) AS z
        FROM ranked
    """,
    "seller_bad_review_summary": f"""
        WITH {_SELLERS}, {_ABOVE},
        top AS (SELECT CAST(ceil(CAST(sum(n) AS DECIMAL(20, 0)) * 0.100000) AS BIGINT) AS top_n FROM above),
        parts AS (SELECT *, (SELECT top_n FROM top) AS top_n FROM above)
        SELECT coalesce(sum(n), 0) AS sellers, sum(n * value) AS bad, max(top_n) AS top_sellers,
               round(try_divide(CAST(sum(value * greatest(least(n, top_n - before), 0)) AS DOUBLE), CAST(sum(n * value) AS DOUBLE)), 6) AS top_share,
               round(try_divide(CAST(sum(n * value * value) AS DOUBLE), pow(CAST(sum(n * value) AS DOUBLE), 2)), 6) AS hhi
        FROM parts
    """,
}
