"""Oracle SQL: customer behaviour."""

from oracle.roles import with_roles
from oracle.stats_sql import welch_select

_PA = """
pa AS (
  SELECT c.person_id, sum(p.order_amount) AS amt, count(*) AS orders
  FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id
  LEFT JOIN r_order_pay p ON p.order_id = o.order_id
  GROUP BY c.person_id
),
top AS (
  SELECT person_id, amt, orders, rn FROM (
    SELECT *, row_number() OVER (ORDER BY amt DESC NULLS LAST, person_id) AS rn FROM pa)
  WHERE rn <= 100
),
top_items AS (
  SELECT c.person_id, i.product_id, i.units, i.price, coalesce(p.category, 'unknown') AS category,
         p.desc_len, p.photo_cnt, p.name_len, p.weight_g
  FROM r_item i JOIN r_order o ON i.order_id = o.order_id
  JOIN r_customer c ON o.customer_id = c.customer_id
  LEFT JOIN r_product p ON p.product_id = i.product_id
  WHERE c.person_id IN (SELECT person_id FROM top)
)
"""

TOP_CUSTOMERS = with_roles(f"""
WITH {_PA}
SELECT person_id, CAST(amt AS DOUBLE) AS order_amount, CAST(orders AS BIGINT) AS orders,
       CAST(rn AS BIGINT) AS rank
FROM top
""")

TOP_CUSTOMER_GEO = with_roles(f"""
WITH {_PA},
addr AS (
  SELECT person_id, state, city FROM (
    SELECT c.person_id, c.state, c.city,
           row_number() OVER (PARTITION BY c.person_id ORDER BY o.purchase_ts DESC, o.order_id DESC) AS rn
    FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id
    WHERE c.person_id IN (SELECT person_id FROM top))
  WHERE rn = 1
)
SELECT a.state, a.city, CAST(count(*) AS BIGINT) AS customers,
       CAST(sum(t.amt) AS DOUBLE) AS order_amount,
       round(CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS customer_share
FROM top t JOIN addr a ON a.person_id = t.person_id
GROUP BY a.state, a.city
""")

TOP_CUSTOMER_CATEGORIES = with_roles(f"""
WITH {_PA}
SELECT category, CAST(count(DISTINCT person_id) AS BIGINT) AS customers,
       CAST(sum(units) AS BIGINT) AS units, CAST(sum(price) AS DOUBLE) AS sales,
       CAST(row_number() OVER (ORDER BY sum(units) DESC, category) AS BIGINT) AS rank
FROM top_items GROUP BY category
""")

TOP_CUSTOMER_CATEGORY_PROFILE = with_roles(f"""
WITH {_PA},
agg AS (
  SELECT category, sum(units) AS units,
    CAST(sum(units * desc_len) AS DOUBLE) / NULLIF(CAST(sum(CASE WHEN desc_len IS NOT NULL THEN units END) AS DOUBLE), 0) AS a1,
    CAST(sum(units * photo_cnt) AS DOUBLE) / NULLIF(CAST(sum(CASE WHEN photo_cnt IS NOT NULL THEN units END) AS DOUBLE), 0) AS a2,
    CAST(sum(units * name_len) AS DOUBLE) / NULLIF(CAST(sum(CASE WHEN name_len IS NOT NULL THEN units END) AS DOUBLE), 0) AS a3,
    CAST(sum(units * weight_g) AS DOUBLE) / NULLIF(CAST(sum(CASE WHEN weight_g IS NOT NULL THEN units END) AS DOUBLE), 0) AS a4
  FROM top_items GROUP BY category
  ORDER BY units DESC, category LIMIT 20
)
SELECT category, CAST(units AS BIGINT) AS units, round(a1, 6) AS avg_desc_len,
       round(a2, 6) AS avg_photos, round(a3, 6) AS avg_name_len, round(a4, 6) AS avg_weight
FROM agg
""")

TOP_CUSTOMER_PAYMENT_AOV = with_roles(f"""
WITH {_PA},
pays AS (
  SELECT y.order_id, coalesce(y.payment_type, 'unknown') AS payment_type, sum(y.value) AS value
  FROM r_payment y
  WHERE y.order_id IN (SELECT o.order_id FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id
                       WHERE c.person_id IN (SELECT person_id FROM top))
  GROUP BY ALL
)
SELECT payment_type, CAST(count(DISTINCT order_id) AS BIGINT) AS orders, CAST(sum(value) AS DOUBLE) AS payment_value,
       round(CAST(sum(value) AS DOUBLE) / CAST(count(DISTINCT order_id) AS DOUBLE), 6) AS aov
FROM pays GROUP BY ROLLUP (payment_type)
""")

USER_GROWTH = with_roles("""
WITH first AS (
  SELECT c.person_id, CAST(date_trunc('month', min(o.purchase_ts)) AS DATE) AS month
  FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id GROUP BY c.person_id
),
counts AS (SELECT month, count(*) AS n FROM first GROUP BY month),
spine AS (
  SELECT CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP),
                                     INTERVAL 1 MONTH)) AS DATE) AS month
  FROM counts
)
SELECT s.month, CAST(coalesce(c.n, 0) AS BIGINT) AS new_users,
       CAST(sum(coalesce(c.n, 0)) OVER (ORDER BY s.month) AS BIGINT) AS cumulative_users
FROM spine s LEFT JOIN counts c ON c.month = s.month
""")

REPEAT_RATE = with_roles("""
WITH po AS (
  SELECT c.person_id, count(*) AS n
  FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id GROUP BY c.person_id
)
SELECT CAST(count(*) AS BIGINT) AS customers, CAST(count_if(n >= 2) AS BIGINT) AS repeat_customers,
       round(CAST(count_if(n >= 2) AS DOUBLE) / NULLIF(CAST(count(*) AS DOUBLE), 0), 6) AS repeat_rate
FROM po
""")

_GAPS = """
op AS (
  SELECT c.person_id, CAST(o.purchase_ts AS DATE) AS d, o.purchase_ts, o.order_id
  FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id
),
g AS (
  SELECT date_diff('day', lag(d) OVER (PARTITION BY person_id ORDER BY purchase_ts, order_id), d) AS gap
  FROM op
),
gaps AS (SELECT gap FROM g WHERE gap IS NOT NULL)
"""

REPURCHASE_GAPS = with_roles(f"""
WITH {_GAPS},
b AS (
  SELECT CASE WHEN gap = 0 THEN '0' WHEN gap <= 7 THEN '1-7' WHEN gap <= 30 THEN '8-30'
              WHEN gap <= 90 THEN '31-90' WHEN gap <= 180 THEN '91-180'
              WHEN gap <= 365 THEN '181-365' ELSE '366+' END AS bucket,
         count(*) AS n
  FROM gaps GROUP BY 1
),
labels AS (
  SELECT * FROM (VALUES ('0', 0), ('1-7', 1), ('8-30', 8), ('31-90', 31), ('91-180', 91),
                        ('181-365', 181), ('366+', 366)) v(bucket, bucket_lo)
)
SELECT l.bucket, CAST(l.bucket_lo AS BIGINT) AS bucket_lo, CAST(coalesce(b.n, 0) AS BIGINT) AS gaps,
       round(CAST(coalesce(b.n, 0) AS DOUBLE) / NULLIF(CAST(sum(coalesce(b.n, 0)) OVER () AS DOUBLE), 0), 6) AS share
FROM labels l LEFT JOIN b ON b.bucket = l.bucket
""")

REPURCHASE_GAP_SUMMARY = with_roles(f"""
WITH {_GAPS}
SELECT CAST(count(*) AS BIGINT) AS gaps, round(avg(gap), 6) AS avg_days,
       round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.9), 6) AS p90
FROM gaps
""")

FIRST_VS_REPEAT_CATEGORIES = with_roles("""
WITH op AS (
  SELECT o.order_id, c.person_id,
         row_number() OVER (PARTITION BY c.person_id ORDER BY o.purchase_ts, o.order_id) AS rn,
         count(*) OVER (PARTITION BY c.person_id) AS n
  FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id
),
it AS (
  SELECT coalesce(p.category, 'unknown') AS category, i.units, op.rn = 1 AS is_first
  FROM r_item i JOIN op ON i.order_id = op.order_id
  LEFT JOIN r_product p ON p.product_id = i.product_id
  WHERE op.n >= 2
),
agg AS (
  SELECT category, sum(CASE WHEN is_first THEN units ELSE 0 END) AS fu,
         sum(CASE WHEN NOT is_first THEN units ELSE 0 END) AS ru
  FROM it GROUP BY category
),
sh AS (
  SELECT category, fu, ru,
         CAST(fu AS DOUBLE) / NULLIF(CAST(sum(fu) OVER () AS DOUBLE), 0) AS fs,
         CAST(ru AS DOUBLE) / NULLIF(CAST(sum(ru) OVER () AS DOUBLE), 0) AS rs,
         row_number() OVER (ORDER BY ru DESC, category) AS rk
  FROM agg
)
SELECT category, CAST(fu AS BIGINT) AS first_units, CAST(ru AS BIGINT) AS repeat_units,
       round(fs, 6) AS first_share, round(rs, 6) AS repeat_share,
       round(CASE WHEN fs <> 0 THEN rs / fs END, 6) AS lift, CAST(rk AS BIGINT) AS repeat_rank
FROM sh WHERE rk <= 20
""")

REPEAT_VS_SINGLE_SCORE = with_roles(f"""
WITH op AS (
  SELECT o.order_id, c.person_id
  FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id
),
pp AS (
  SELECT op.person_id, count(*) AS n_orders, sum(r.score) AS s, count(r.score) AS nr
  FROM op LEFT JOIN r_review r ON r.order_id = op.order_id GROUP BY op.person_id
),
x AS (SELECT n_orders >= 2 AS rep, CAST(s AS DOUBLE) / nr AS x FROM pp WHERE nr > 0),
m AS (
  SELECT count_if(rep) AS n1, avg(x) FILTER (WHERE rep) AS m1, var_samp(x) FILTER (WHERE rep) AS v1,
         count_if(NOT rep) AS n2, avg(x) FILTER (WHERE NOT rep) AS m2,
         var_samp(x) FILTER (WHERE NOT rep) AS v2
  FROM x
)
SELECT CAST(n1 AS BIGINT) AS n_repeat, round(m1, 6) AS mean_repeat,
       CAST(n2 AS BIGINT) AS n_single, round(m2, 6) AS mean_single, {welch_select("greater")}
FROM m
""")

SQL = {
    "top_customers": TOP_CUSTOMERS,
    "top_customer_geo": TOP_CUSTOMER_GEO,
    "top_customer_categories": TOP_CUSTOMER_CATEGORIES,
    "top_customer_category_profile": TOP_CUSTOMER_CATEGORY_PROFILE,
    "top_customer_payment_aov": TOP_CUSTOMER_PAYMENT_AOV,
    "user_growth": USER_GROWTH,
    "repeat_rate": REPEAT_RATE,
    "repurchase_gaps": REPURCHASE_GAPS,
    "repurchase_gap_summary": REPURCHASE_GAP_SUMMARY,
    "first_vs_repeat_categories": FIRST_VS_REPEAT_CATEGORIES,
    "repeat_vs_single_score": REPEAT_VS_SINGLE_SCORE,
}
