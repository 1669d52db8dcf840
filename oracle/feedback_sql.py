"""Oracle SQL: payments and review feedback."""

from oracle.roles import with_roles
from oracle.stats_sql import chi2_tail

_METHODS = """
om AS (SELECT DISTINCT order_id, coalesce(payment_type, 'unknown') AS payment_type FROM r_payment),
x AS (SELECT om.payment_type, o.status, o.order_id FROM om JOIN r_order o ON o.order_id = om.order_id)
"""

COMPLETION_RATE_BY_PAYMENT = with_roles(f"""
WITH {_METHODS}
SELECT payment_type, CAST(count(*) AS BIGINT) AS orders,
       CAST(count_if(status = 'delivered') AS BIGINT) AS completed,
       round(CAST(count_if(status = 'delivered') AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS completion_rate
FROM x GROUP BY payment_type
""")

COMPLETION_PAYMENT_CHI2 = with_roles(f"""
WITH {_METHODS},
g AS (
  SELECT payment_type, CAST(count(*) AS DOUBLE) AS o,
         CAST(count_if(status = 'delivered') AS DOUBLE) AS c
  FROM x GROUP BY payment_type
),
mg AS (SELECT sum(o) AS n_all, sum(c) AS c_all, count(*) AS r FROM g),
e AS (SELECT g.*, mg.*, o * c_all / n_all AS ec, o * (n_all - c_all) / n_all AS en FROM g CROSS JOIN mg),
s AS (
  SELECT sum(pow(c - ec, 2) / ec + pow((o - c) - en, 2) / en) AS x, CAST(min(r) - 1 AS BIGINT) AS k
  FROM e WHERE c_all > 0 AND c_all < n_all AND r > 1
)
SELECT round(x, 6) AS statistic, k AS dof, round({chi2_tail("x", "k")}, 9) AS p_value FROM s
""")

AVG_ORDER_AMOUNT_BY_PAYMENT = with_roles(f"""
WITH {_METHODS}
SELECT x.payment_type, CAST(count(*) AS BIGINT) AS orders,
       round(CAST(sum(op.order_amount) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS avg_order_amount
FROM x JOIN r_order_pay op ON op.order_id = x.order_id
GROUP BY x.payment_type
""")

INSTALLMENT_AVG_PAYMENT = with_roles("""
SELECT CAST(installments AS BIGINT) AS installments, CAST(count(*) AS BIGINT) AS payments,
       round(CAST(sum(value) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS avg_value,
       round(sum(CAST(value AS DOUBLE) / installments) / CAST(count(*) AS DOUBLE), 6) AS avg_installment
FROM r_payment WHERE installments >= 2
GROUP BY ROLLUP (installments)
""")

_SELLERS = """
pr AS (SELECT DISTINCT i.order_id, i.seller_id, r.score FROM r_item i JOIN r_review r ON r.order_id = i.order_id),
ps AS (SELECT seller_id, count(*) AS reviews, count_if(score <= 2) AS bad FROM pr GROUP BY seller_id)
"""

SELLER_BAD_REVIEW_CONCENTRATION = with_roles(f"""
WITH {_SELLERS},
tot AS (SELECT sum(bad) AS tb, sum(reviews) AS tr, CAST(sum(bad) AS DOUBLE) / CAST(sum(reviews) AS DOUBLE) AS p0 FROM ps),
r AS (
  SELECT ps.*, tot.tb, tot.p0,
         row_number() OVER (ORDER BY bad DESC, seller_id) AS rk,
         sum(bad) OVER (ORDER BY bad DESC, seller_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cb
  FROM ps CROSS JOIN tot
)
SELECT seller_id, CAST(reviews AS BIGINT) AS reviews, CAST(bad AS BIGINT) AS bad,
       round(CAST(bad AS DOUBLE) / CAST(reviews AS DOUBLE), 6) AS bad_rate,
       round(CAST(bad AS DOUBLE) / NULLIF(CAST(tb AS DOUBLE), 0), 6) AS bad_share,
       round(CAST(cb AS DOUBLE) / NULLIF(CAST(tb AS DOUBLE), 0), 6) AS cum_share,
       CAST(rk AS BIGINT) AS rank,
       round(CASE WHEN reviews >= 2 AND sqrt(p0 * (1.0::DOUBLE - p0) / CAST(reviews AS DOUBLE)) > 0
                  THEN (CAST(bad AS DOUBLE) / CAST(reviews AS DOUBLE) - p0)
                       / sqrt(p0 * (1.0::DOUBLE - p0) / CAST(reviews AS DOUBLE)) END, 6) AS z
FROM r
""")

SELLER_BAD_REVIEW_SUMMARY = with_roles(f"""
WITH {_SELLERS},
n AS (SELECT count(*) AS sellers, sum(bad) AS tb, sum(bad * bad) AS sq, ceil(count(*) * 0.1) AS top_n FROM ps),
top AS (
  SELECT sum(bad) AS top_bad FROM (
    SELECT bad, row_number() OVER (ORDER BY bad DESC, seller_id) AS rk FROM ps) q CROSS JOIN n
  WHERE rk <= top_n
)
SELECT CAST(sellers AS BIGINT) AS sellers, CAST(tb AS BIGINT) AS bad, CAST(top_n AS BIGINT) AS top_sellers,
       round(CAST(top_bad AS DOUBLE) / NULLIF(CAST(tb AS DOUBLE), 0), 6) AS top_share,
       round(CAST(sq AS DOUBLE) / NULLIF(pow(CAST(tb AS DOUBLE), 2), 0), 6) AS hhi
FROM n CROSS JOIN top
""")

SQL = {
    "completion_rate_by_payment": COMPLETION_RATE_BY_PAYMENT,
    "completion_payment_chi2": COMPLETION_PAYMENT_CHI2,
    "avg_order_amount_by_payment": AVG_ORDER_AMOUNT_BY_PAYMENT,
    "installment_avg_payment": INSTALLMENT_AVG_PAYMENT,
    "seller_bad_review_concentration": SELLER_BAD_REVIEW_CONCENTRATION,
    "seller_bad_review_summary": SELLER_BAD_REVIEW_SUMMARY,
}
