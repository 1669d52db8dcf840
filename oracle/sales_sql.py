"""Oracle SQL: sales and products."""

from oracle.roles import with_roles
from oracle.stats_sql import two_prop_select

_MONTHS = """
od AS (SELECT order_id, CAST(purchase_ts AS DATE) AS d FROM r_order),
os AS (SELECT order_id, sum(price) AS s FROM r_item GROUP BY order_id),
ms AS (
  SELECT CAST(date_trunc('month', od.d) AS DATE) AS m, sum(coalesce(os.s, 0)) AS s
  FROM od LEFT JOIN os ON os.order_id = od.order_id GROUP BY 1
),
b AS (SELECT min(d) AS lo, max(d) AS hi FROM od),
spine AS (
  SELECT CAST(unnest(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP),
                                     CAST(date_trunc('month', hi) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m
  FROM b
),
j AS (
  SELECT s.m, coalesce(ms.s, 0) AS sales,
         (s.m >= b.lo AND CAST(s.m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) <= b.hi) AS complete
  FROM spine s CROSS JOIN b LEFT JOIN ms ON ms.m = s.m
)
"""

SALES_GROWTH = with_roles(f"""
WITH {_MONTHS},
l AS (SELECT m, sales, lag(sales) OVER (ORDER BY m) AS prev, complete FROM j)
SELECT m AS month, CAST(sales AS DOUBLE) AS sales, CAST(prev AS DOUBLE) AS prev_sales,
       round(CASE WHEN prev <> 0 THEN CAST(sales AS DOUBLE) / CAST(prev AS DOUBLE) - 1.0 END, 6) AS growth,
       complete
FROM l
""")

SALES_SEASONALITY = with_roles(f"""
WITH {_MONTHS},
c AS (SELECT * FROM j WHERE complete),
o AS (SELECT CAST(sum(sales) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS overall FROM c),
g AS (
  SELECT month(m) AS moy, CAST(sum(sales) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_sales
  FROM c GROUP BY 1
)
SELECT CAST(moy AS BIGINT) AS month_of_year, round(avg_sales, 6) AS avg_sales,
       round(CASE WHEN overall <> 0 THEN avg_sales / overall END, 6) AS "index"
FROM g CROSS JOIN o
""")

TOP_CATEGORIES_SHARE = with_roles("""
WITH cs AS (
  SELECT coalesce(p.category, 'unknown') AS category, sum(i.price) AS sales
  FROM r_item i LEFT JOIN r_product p ON p.product_id = i.product_id GROUP BY 1
),
r AS (
  SELECT category, sales, CAST(sales AS DOUBLE) / CAST(sum(sales) OVER () AS DOUBLE) AS share,
         row_number() OVER (ORDER BY sales DESC, category) AS rk
  FROM cs
)
SELECT category, CAST(sales AS DOUBLE) AS sales, round(share, 6) AS share, CAST(rk AS BIGINT) AS rank
FROM r WHERE rk <= 10
""")

FASTEST_GROWING_CATEGORIES = with_roles("""
WITH b AS (
  SELECT CAST(CAST(date_trunc('quarter', max(CAST(purchase_ts AS DATE)) + 1) AS DATE) - INTERVAL 3 MONTH AS DATE) AS cur
  FROM r_order
),
w AS (
  SELECT o.order_id, CAST(o.purchase_ts AS DATE) >= b.cur AS is_cur, b.cur
  FROM r_order o CROSS JOIN b
  WHERE CAST(o.purchase_ts AS DATE) >= CAST(b.cur - INTERVAL 3 MONTH AS DATE)
    AND CAST(o.purchase_ts AS DATE) < CAST(b.cur + INTERVAL 3 MONTH AS DATE)
),
agg AS (
  SELECT coalesce(p.category, 'unknown') AS category, min(w.cur) AS period,
         sum(CASE WHEN NOT w.is_cur THEN i.units ELSE 0 END) AS pu,
         sum(CASE WHEN w.is_cur THEN i.units ELSE 0 END) AS cu
  FROM r_item i JOIN w ON w.order_id = i.order_id
  LEFT JOIN r_product p ON p.product_id = i.product_id
  GROUP BY 1
),
g AS (
  SELECT *, CAST(cu AS DOUBLE) / CAST(pu AS DOUBLE) - 1.0 AS growth FROM agg WHERE pu >= 1
),
r AS (SELECT *, row_number() OVER (ORDER BY growth DESC, category) AS rk FROM g)
SELECT category, period, CAST(pu AS BIGINT) AS prev_units, CAST(cu AS BIGINT) AS cur_units,
       round(growth, 6) AS growth, CAST(rk AS BIGINT) AS rank
FROM r WHERE rk <= 10
""")

_CLASSES = """
pu AS (SELECT product_id, sum(units) AS u FROM r_item GROUP BY product_id),
cut AS (SELECT quantile_cont(u, 0.25) AS p25, quantile_cont(u, 0.75) AS p75 FROM pu),
cls AS (
  SELECT product_id, u,
         CASE WHEN u <= p25 THEN 'slow' WHEN u >= p75 THEN 'hot' ELSE 'mid' END AS class
  FROM pu CROSS JOIN cut
)
"""

HOT_SLOW_PRODUCTS = with_roles(f"""
WITH {_CLASSES}
SELECT product_id, CAST(u AS BIGINT) AS units, class FROM cls
""")

HOT_SLOW_BAD_REVIEW_RATE = with_roles(f"""
WITH {_CLASSES},
pairs AS (SELECT DISTINCT order_id, product_id FROM r_item),
pr AS (
  SELECT cls.class, r.score <= 2 AS bad
  FROM pairs p JOIN r_review r ON r.order_id = p.order_id
  JOIN cls ON cls.product_id = p.product_id
),
m AS (
  SELECT count_if(class = 'slow') AS n1, count_if(class = 'slow' AND bad) AS x1,
         count_if(class = 'hot') AS n2, count_if(class = 'hot' AND bad) AS x2
  FROM pr
)
SELECT CAST(n1 AS BIGINT) AS n_slow, CAST(x1 AS BIGINT) AS bad_slow,
       round(CAST(x1 AS DOUBLE) / CAST(n1 AS DOUBLE), 6) AS rate_slow,
       CAST(n2 AS BIGINT) AS n_hot, CAST(x2 AS BIGINT) AS bad_hot,
       round(CAST(x2 AS DOUBLE) / CAST(n2 AS DOUBLE), 6) AS rate_hot,
       {two_prop_select("greater")}
FROM m
""")

SQL = {
    "sales_growth": SALES_GROWTH,
    "sales_seasonality": SALES_SEASONALITY,
    "top_categories_share": TOP_CATEGORIES_SHARE,
    "fastest_growing_categories": FASTEST_GROWING_CATEGORIES,
    "hot_slow_products": HOT_SLOW_PRODUCTS,
    "hot_slow_bad_review_rate": HOT_SLOW_BAD_REVIEW_RATE,
}
