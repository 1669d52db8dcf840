"""Oracle SQL: logistics (L1-L4)."""

from oracle.roles import with_roles
from oracle.stats_sql import welch_select

_DIST = """
CAST(round(12742.0::DOUBLE * asin(sqrt(CASE WHEN h > 1.0 THEN 1.0::DOUBLE ELSE h END)) * 1000.0::DOUBLE) AS BIGINT)
"""

_FEATURES = f"""
oi AS (SELECT order_id, sum(freight) AS fr FROM r_item GROUP BY order_id),
top AS (
  SELECT order_id, fr, rk FROM (
    SELECT order_id, fr, row_number() OVER (ORDER BY fr DESC NULLS LAST, order_id) AS rk FROM oi)
  WHERE rk <= 100
),
feat AS (
  SELECT i.order_id, count(*) AS items, sum(i.freight) AS freight, sum(p.weight_g) AS weight_g,
         sum(p.length_cm * p.height_cm * p.width_cm) AS volume_cm3,
         max({_DIST}) AS dm
  FROM (
    SELECT i.*, pow(sin((radians(sg.lat) - radians(cg.lat)) / 2), 2)
                + cos(radians(cg.lat)) * cos(radians(sg.lat))
                  * pow(sin((radians(sg.lng) - radians(cg.lng)) / 2), 2) AS h
    FROM r_item i
    LEFT JOIN r_seller s ON s.seller_id = i.seller_id
    LEFT JOIN r_geo sg ON sg.geo_key = s.geo_key
    LEFT JOIN r_order o ON o.order_id = i.order_id
    LEFT JOIN r_customer c ON c.customer_id = o.customer_id
    LEFT JOIN r_geo cg ON cg.geo_key = c.geo_key
  ) i
  LEFT JOIN r_product p ON p.product_id = i.product_id
  GROUP BY i.order_id
)
"""

TOP_FREIGHT_ORDERS = with_roles(f"""
WITH {_FEATURES}
SELECT f.order_id, CAST(f.freight AS DOUBLE) AS freight, f.dm / 1000.0::DOUBLE AS distance_km,
       CAST(f.weight_g AS DOUBLE) AS weight_g, CAST(f.volume_cm3 AS DOUBLE) AS volume_cm3,
       CAST(f.items AS BIGINT) AS items, CAST(t.rk AS BIGINT) AS rank
FROM feat f JOIN top t ON t.order_id = f.order_id
""")

FREIGHT_ORDER_PROFILE = with_roles(f"""
WITH {_FEATURES},
fl AS (SELECT f.*, t.order_id IS NOT NULL AS is_top FROM feat f LEFT JOIN top t ON t.order_id = f.order_id)
SELECT is_top, CAST(count(*) AS BIGINT) AS orders,
       round(CAST(sum(freight) AS DOUBLE) / CAST(count(freight) AS DOUBLE), 6) AS avg_freight,
       round(CAST(sum(dm) AS DOUBLE) / NULLIF(CAST(count(dm) AS DOUBLE), 0) / 1000.0::DOUBLE, 6) AS avg_distance,
       round(sum(weight_g) / NULLIF(CAST(count(weight_g) AS DOUBLE), 0), 6) AS avg_weight,
       round(sum(volume_cm3) / NULLIF(CAST(count(volume_cm3) AS DOUBLE), 0), 6) AS avg_volume
FROM fl GROUP BY is_top
""")

LATE_VS_ONTIME_SCORE = with_roles(f"""
WITH lo AS (
  SELECT order_id, CAST(delivered_ts AS DATE) > CAST(promised_ts AS DATE) AS late
  FROM r_order WHERE delivered_ts IS NOT NULL AND promised_ts IS NOT NULL
),
x AS (SELECT lo.late, CAST(r.score AS DOUBLE) AS x FROM lo JOIN r_review r ON r.order_id = lo.order_id),
m AS (
  SELECT count_if(late) AS n1, avg(x) FILTER (WHERE late) AS m1, var_samp(x) FILTER (WHERE late) AS v1,
         count_if(NOT late) AS n2, avg(x) FILTER (WHERE NOT late) AS m2,
         var_samp(x) FILTER (WHERE NOT late) AS v2
  FROM x
)
SELECT CAST(n1 AS BIGINT) AS n_late, round(m1, 6) AS mean_late,
       CAST(n2 AS BIGINT) AS n_ontime, round(m2, 6) AS mean_ontime, {welch_select("less")}
FROM m
""")

LATE_ORDERS_BY_CITY = with_roles("""
WITH ol AS (
  SELECT c.state, c.city,
         CASE WHEN o.delivered_ts IS NOT NULL AND o.promised_ts IS NOT NULL
              THEN CAST(o.delivered_ts AS DATE) > CAST(o.promised_ts AS DATE) END AS late
  FROM r_order o JOIN r_customer c ON c.customer_id = o.customer_id
),
g AS (
  SELECT state, city, count_if(late) AS late, count(late) AS known FROM ol GROUP BY state, city
)
SELECT state, city, CAST(late AS BIGINT) AS late_orders, CAST(known AS BIGINT) AS delivered_orders,
       round(CAST(late AS DOUBLE) / NULLIF(CAST(known AS DOUBLE), 0), 6) AS late_rate,
       round(CAST(late AS DOUBLE) / NULLIF(CAST(sum(late) OVER () AS DOUBLE), 0), 6) AS late_share
FROM g
""")

SQL = {
    "top_freight_orders": TOP_FREIGHT_ORDERS,
    "freight_order_profile": FREIGHT_ORDER_PROFILE,
    "late_vs_ontime_score": LATE_VS_ONTIME_SCORE,
    "late_orders_by_city": LATE_ORDERS_BY_CITY,
}
