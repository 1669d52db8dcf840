"""Oracle SQL: market and geography (M1-M4)."""

from oracle.roles import with_roles
from oracle.stats_sql import welch_select

_CITY = """
oi AS (SELECT order_id, sum(price) AS s FROM r_item GROUP BY order_id),
oc AS (
  SELECT c.state, c.city, c.person_id, o.order_id, oi.s, op.order_amount, CAST(o.purchase_ts AS DATE) AS day, q.cur
  FROM r_order o JOIN r_customer c ON c.customer_id = o.customer_id
  CROSS JOIN (SELECT CAST(date_trunc('quarter', max(CAST(purchase_ts AS DATE)) + 1) AS DATE) - INTERVAL 3 MONTH AS cur FROM r_order) q
  LEFT JOIN oi ON oi.order_id = o.order_id
  LEFT JOIN r_order_pay op ON op.order_id = o.order_id
),
cities AS (
  SELECT state, city, count(*) AS orders, coalesce(sum(s), 0) AS sales,
         count(DISTINCT person_id) AS customers,
         CAST(coalesce(sum(order_amount), 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS aov,
         count_if(day >= cur AND day < cur + INTERVAL 3 MONTH) AS recent, count_if(day >= cur - INTERVAL 3 MONTH AND day < cur) AS earlier
  FROM oc GROUP BY state, city
)
"""

CITY_PENETRATION = with_roles(f"""
WITH {_CITY}
SELECT state, city, CAST(orders AS BIGINT) AS orders, CAST(sales AS DOUBLE) AS sales,
       CAST(customers AS BIGINT) AS customers
FROM cities
""")

LOW_PENETRATION_HIGH_POTENTIAL = with_roles(f"""
WITH {_CITY},
cut AS (SELECT quantile_cont(orders, 0.5) AS mo, quantile_cont(aov, 0.75) AS ma FROM cities)
SELECT state, city, CAST(orders AS BIGINT) AS orders, CAST(sales AS DOUBLE) AS sales,
       CAST(customers AS BIGINT) AS customers, round(aov, 6) AS aov,
       round(CAST(recent AS DOUBLE) / nullif(CAST(earlier AS DOUBLE), 0) - 1.0, 6) AS order_growth
FROM cities CROSS JOIN cut
WHERE orders <= mo AND aov >= ma AND orders >= 1
""")

_ITEMS = """
it AS (
  SELECT i.order_id, i.freight, p.weight_g, s.state <> c.state AS x
  FROM r_item i
  LEFT JOIN r_seller s ON s.seller_id = i.seller_id
  JOIN r_order o ON o.order_id = i.order_id
  LEFT JOIN r_customer c ON c.customer_id = o.customer_id
  LEFT JOIN r_product p ON p.product_id = i.product_id
)
"""

CROSS_STATE_ORDER_SHARE = with_roles(f"""
WITH {_ITEMS},
po AS (SELECT order_id, bool_or(x) AS x FROM it GROUP BY order_id)
SELECT CAST(count(x) AS BIGINT) AS orders, CAST(count_if(x) AS BIGINT) AS cross_orders,
       round(CAST(count_if(x) AS DOUBLE) / nullif(CAST(count(x) AS DOUBLE), 0), 6) AS share,
       CAST(count(*) - count(x) AS BIGINT) AS unknown_orders
FROM po
""")

CROSS_STATE_FREIGHT = with_roles(f"""
WITH {_ITEMS},
m AS (
  SELECT count_if(x) AS n1, sum(freight) FILTER (WHERE x) AS s1,
         var_samp(CAST(freight AS DOUBLE)) FILTER (WHERE x) AS v1,
         count_if(NOT x) AS n2, sum(freight) FILTER (WHERE NOT x) AS s2,
         var_samp(CAST(freight AS DOUBLE)) FILTER (WHERE NOT x) AS v2,
         sum(freight) FILTER (WHERE x AND weight_g IS NOT NULL) AS f1,
         sum(weight_g) FILTER (WHERE x) AS w1,
         sum(freight) FILTER (WHERE NOT x AND weight_g IS NOT NULL) AS f2,
         sum(weight_g) FILTER (WHERE NOT x) AS w2,
         count(*) FILTER (WHERE x IS NULL) AS n0
  FROM it
),
mm AS (
  SELECT *, CAST(s1 AS DOUBLE) / CAST(n1 AS DOUBLE) AS m1, CAST(s2 AS DOUBLE) / CAST(n2 AS DOUBLE) AS m2
  FROM m
)
SELECT CAST(n1 AS BIGINT) AS n_cross, round(m1, 6) AS mean_cross,
       CAST(n2 AS BIGINT) AS n_same, round(m2, 6) AS mean_same,
       round(CAST(f1 AS DOUBLE) / NULLIF(w1 / 1000.0::DOUBLE, 0), 6) AS per_kg_cross,
       round(CAST(f2 AS DOUBLE) / NULLIF(w2 / 1000.0::DOUBLE, 0), 6) AS per_kg_same,
       CAST(n0 AS BIGINT) AS n_unknown,
       {welch_select("greater")}
FROM mm
""")

SQL = {
    "city_penetration": CITY_PENETRATION,
    "low_penetration_high_potential": LOW_PENETRATION_HIGH_POTENTIAL,
    "cross_state_order_share": CROSS_STATE_ORDER_SHARE,
    "cross_state_freight": CROSS_STATE_FREIGHT,
}
