"""Oracle SQL: decomposition, regression, robust and rank tests, survival, cohorts, dispersion.

Written from the definitions: moving averages by joins on month numbers,
normal equations by sweeping, contributions of orders squared one by one,
pairs of histogram rows compared, at-risk sets counted by joins.
"""

from oracle.customers_sql import _GAPS
from oracle.feedback_sql import _METHODS, _SELLERS
from oracle.logistics_sql import _DIST
from oracle.market_sql import _ITEMS
from oracle.roles import with_roles
from oracle.sales_sql import _CLASSES, _MONTHS
from oracle.stats_sql import NORMAL, STEPS, integral, tail


def _rounds(n: int) -> str:
    out = """
s0 AS (SELECT row_number() OVER (ORDER BY m) AS i, m, month(m) AS moy, CAST(sales AS DOUBLE) AS sales, 1.0::DOUBLE AS season FROM j WHERE complete)"""
    for r in range(1, n + 1):
        out += f""",
t{r} AS (
  SELECT a.i, sum(b.sales / b.season * CASE WHEN abs(a.i - b.i) = 6 THEN 1 ELSE 2 END) / 24.0::DOUBLE AS trend
  FROM s{r - 1} a JOIN s{r - 1} b ON b.i BETWEEN a.i - 6 AND a.i + 6 GROUP BY a.i HAVING count(*) = 13
),
x{r} AS (SELECT s.moy, avg(s.sales / nullif(t.trend, 0)) AS mean FROM s{r - 1} s JOIN t{r} t ON t.i = s.i GROUP BY s.moy),
y{r} AS (SELECT moy, CASE WHEN (SELECT count(mean) FROM x{r}) = 12 THEN mean * 12 / (SELECT nullif(sum(mean), 0) FROM x{r}) END AS season FROM x{r}),
s{r} AS (SELECT s.i, s.m, s.moy, s.sales, coalesce(nullif(y.season, 0), 1.0::DOUBLE) AS season, y.season AS told, t.trend
         FROM s{r - 1} s LEFT JOIN y{r} y USING (moy) LEFT JOIN t{r} t ON t.i = s.i)"""
    return out


SALES_DECOMPOSITION = with_roles(f"""
WITH {_MONTHS}, {_rounds(6)}
SELECT a.m AS month, a.sales, round(a.trend, 2) AS trend, round(a.told, 6) AS season,
       round(a.sales / nullif(a.trend * a.told, 0), 6) AS remainder, round(a.sales / nullif(a.told, 0), 2) AS adjusted,
       round(a.trend / nullif(b.trend, 0) - 1.0, 6) AS trend_growth
FROM s6 a LEFT JOIN s6 b ON b.i = a.i - 1
""")

_VARIABLES = ["1.0::DOUBLE", "d", "w", "v", "x", "y"]


def _swept() -> str:
    """The moments of constant, distance, weight, volume, flag and freight, swept on all but the last."""
    names = [[f"a{i}{j}" for j in range(6)] for i in range(6)]
    out = "a0 AS (SELECT count(*) AS n, " + ", ".join(
        f"sum({_VARIABLES[i]} * {_VARIABLES[j]}) AS {names[i][j]}" for i in range(6) for j in range(6)) + " FROM lines)"
    for k in range(5):
        cells = []
        for i in range(6):
            for j in range(6):
                kk, a, ik, kj = names[k][k], names[i][j], names[i][k], names[k][j]
                cells.append((f"1.0 / {kk}" if i == j == k else f"{kj} / {kk}" if i == k else f"-{ik} / {kk}" if j == k else f"{a} - {ik} * {kj} / {kk}") + f" AS {a}")
        out += f",\na{k + 1} AS (SELECT n, {', '.join(cells)} FROM a{k})"
    return out


_TERMS = ["constant", "distance_100km", "weight_kg", "volume_dm3", "cross_state"]
FREIGHT_DRIVERS = with_roles(f"""
WITH located AS (
  SELECT i.product_id, CAST(i.freight AS DOUBLE) AS y, CAST(s.state <> c.state AS DOUBLE) AS x,
         pow(sin((radians(sg.lat) - radians(cg.lat)) / 2), 2)
           + cos(radians(cg.lat)) * cos(radians(sg.lat)) * pow(sin((radians(sg.lng) - radians(cg.lng)) / 2), 2) AS h
  FROM r_item i JOIN r_order o ON o.order_id = i.order_id
  LEFT JOIN r_seller s ON s.seller_id = i.seller_id LEFT JOIN r_geo sg ON sg.geo_key = s.geo_key
  LEFT JOIN r_customer c ON c.customer_id = o.customer_id LEFT JOIN r_geo cg ON cg.geo_key = c.geo_key
),
lines AS (
  SELECT l.y, l.x, {_DIST} / 100000.0::DOUBLE AS d, p.weight_g / 1000.0::DOUBLE AS w, p.length_cm * p.height_cm * p.width_cm / 1000.0::DOUBLE AS v
  FROM located l JOIN r_product p ON p.product_id = l.product_id
  WHERE l.y IS NOT NULL AND l.x IS NOT NULL AND l.h IS NOT NULL AND p.weight_g IS NOT NULL
    AND p.length_cm IS NOT NULL AND p.height_cm IS NOT NULL AND p.width_cm IS NOT NULL
),
centre AS (SELECT sum((y - (SELECT avg(y) FROM lines)) * (y - (SELECT avg(y) FROM lines))) AS yy FROM lines),
{_swept()},
told AS ({" UNION ALL ".join(f"SELECT '{t}' AS term, a{i}5 AS b, sqrt(a55 / (n - 5) * a{i}{i}) AS se, n, a55 FROM a5" for i, t in enumerate(_TERMS))})
SELECT term, round(b, 6) AS coefficient, round(se, 6) AS std_error, round(b / nullif(se, 0), 4) AS t, CAST(n AS BIGINT) AS items,
       round(1.0 - a55 / yy, 6) AS r2
FROM told CROSS JOIN centre
""")


def _clustered(units: str, first: str, second: str) -> str:
    """``units``: CTEs ending in u(order_id, g, x), g 1 or 2."""
    return with_roles(f"""
WITH {units},
m AS (
  SELECT count(DISTINCT order_id) AS clusters, count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 2) AS n2,
         avg(x) FILTER (WHERE g = 1) AS m1, avg(x) FILTER (WHERE g = 2) AS m2,
         var_pop(x) FILTER (WHERE g = 1) AS v1, var_pop(x) FILTER (WHERE g = 2) AS v2
  FROM u
),
c AS (
  SELECT order_id, sum(CASE WHEN g = 1 THEN (x - m1) / n1 ELSE -(x - m2) / n2 END) AS part FROM u CROSS JOIN m GROUP BY order_id
),
r AS (SELECT *, (SELECT sum(part * part) FROM c) AS robust, v1 / n1 + v2 / n2 AS plain FROM m),
z AS (SELECT *, CASE WHEN robust > 0 AND n1 >= 2 AND n2 >= 2 THEN (m1 - m2) / sqrt(robust) END AS z FROM r)
SELECT CAST(clusters AS BIGINT) AS clusters, CAST(n1 AS BIGINT) AS n_{first}, round(m1, 6) AS mean_{first}, CAST(n2 AS BIGINT) AS n_{second},
       round(m2, 6) AS mean_{second}, round(sqrt(plain), 9) AS se_plain, round(sqrt(robust), 9) AS se_cluster,
       round(robust / nullif(plain, 0), 6) AS design_effect, round(z, 6) AS z, round({tail(NORMAL, "z")}, 9) AS p_one_sided
FROM z
""")


HOT_SLOW_BAD_REVIEW_CLUSTERED = _clustered(f"""{_CLASSES},
u AS (
  SELECT p.order_id, CASE cls.class WHEN 'slow' THEN 1 ELSE 2 END AS g, CAST(r.score <= 2 AS DOUBLE) AS x
  FROM (SELECT DISTINCT order_id, product_id FROM r_item) p JOIN r_review r ON r.order_id = p.order_id
  JOIN cls ON cls.product_id = p.product_id WHERE cls.class IN ('slow', 'hot')
)""", "slow", "hot")

CROSS_STATE_FREIGHT_CLUSTERED = _clustered(f"""{_ITEMS},
u AS (SELECT order_id, CASE WHEN x THEN 1 ELSE 2 END AS g, CAST(freight AS DOUBLE) AS x FROM it WHERE it.x IS NOT NULL AND freight IS NOT NULL)""",
                                           "cross", "same")


def _ranked(units: str, first: str, second: str, sign: str) -> str:
    """``units``: CTEs ending in u(x, g), g true for the first group."""
    return with_roles(f"""
WITH {units},
h AS (SELECT x, CAST(count_if(g) AS DOUBLE) AS k1, CAST(count_if(NOT g) AS DOUBLE) AS k2 FROM u GROUP BY x),
m AS (
  SELECT sum(k1) AS n1, sum(k2) AS n2, sum(pow(k1 + k2, 3) - (k1 + k2)) AS ties,
         (SELECT sum(a.k1 * b.k2 * CASE WHEN a.x > b.x THEN 1.0 ELSE 0.5 END) FROM h a JOIN h b ON a.x >= b.x) AS u
  FROM h
),
v AS (SELECT *, n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) AS v FROM m),
z AS (SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2 AND v > 0 THEN (u - n1 * n2 / 2) / sqrt(v) END AS z FROM v)
SELECT CAST(n1 AS BIGINT) AS n_{first}, CAST(n2 AS BIGINT) AS n_{second}, u, round(u / nullif(n1 * n2, 0), 6) AS superiority, round(z, 6) AS z,
       round({tail(NORMAL, f"({sign}z)")}, 9) AS p_one_sided
FROM z
""")


REPEAT_VS_SINGLE_RANK = _ranked("""op AS (SELECT o.order_id, c.person_id FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id),
pp AS (SELECT op.person_id, count(*) AS n, sum(r.score) AS s, count(r.score) AS k FROM op LEFT JOIN r_review r ON r.order_id = op.order_id GROUP BY op.person_id),
u AS (SELECT (s * 2000 + k) // (2 * k) AS x, n >= 2 AS g FROM pp WHERE k > 0)""", "repeat", "single", "")

LATE_VS_ONTIME_RANK = _ranked("""u AS (
  SELECT r.score AS x, CAST(o.delivered_ts AS DATE) > CAST(o.promised_ts AS DATE) AS g
  FROM r_order o JOIN r_review r ON r.order_id = o.order_id WHERE o.delivered_ts IS NOT NULL AND o.promised_ts IS NOT NULL
)""", "late", "ontime", "-")

_SURVIVAL = f"""{_GAPS},
ends AS (
  SELECT person_id, d, lead(d) OVER (PARTITION BY person_id ORDER BY purchase_ts, order_id) AS following, (SELECT max(d) FROM op) AS hi FROM op
),
spells AS (SELECT date_diff('day', d, coalesce(following, hi)) AS days, following IS NOT NULL AS event FROM ends),
lengths AS (SELECT days, count_if(event) AS events FROM spells GROUP BY days),
risk AS (
  SELECT l.days, l.events, (SELECT count(*) FROM spells s WHERE s.days >= l.days) AS at_risk FROM lengths l
),
curve AS (
  SELECT a.days, a.events, a.at_risk, product(1.0::DOUBLE - CAST(b.events AS DOUBLE) / b.at_risk) AS survival,
         sum(CASE WHEN b.events < b.at_risk THEN CAST(b.events AS DOUBLE) / (CAST(b.at_risk AS DOUBLE) * (b.at_risk - b.events)) END) AS green,
         bool_or(b.events = b.at_risk) AS ended
  FROM risk a JOIN risk b ON b.days <= a.days GROUP BY ALL
)
"""

REPURCHASE_SURVIVAL = with_roles(f"""
WITH {_SURVIVAL}
SELECT CAST(days AS BIGINT) AS days, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events, round(survival, 6) AS survival,
       round(CASE WHEN NOT ended THEN survival * sqrt(green) END, 6) AS std_error
FROM curve WHERE events > 0
""")

REPURCHASE_SURVIVAL_SUMMARY = with_roles(f"""
WITH {_SURVIVAL}
SELECT (SELECT count(*) FROM spells) AS spells, CAST(sum(events) AS BIGINT) AS events,
       CAST(min(days) FILTER (WHERE round(survival, 12) <= 0.5) AS BIGINT) AS median_days,
       {", ".join(f"round(CASE WHEN max(days) >= {d} THEN coalesce(1.0 - min(survival) FILTER (WHERE days <= {d}), 0) END, 6) AS within_{d}" for d in (30, 90, 180, 365))}
FROM curve
""")

COHORT_RETENTION = with_roles("""
WITH pm AS (
  SELECT DISTINCT c.person_id, CAST(date_trunc('month', o.purchase_ts) AS DATE) AS month
  FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id
),
firsts AS (SELECT person_id, min(month) AS cohort FROM pm GROUP BY person_id),
hi AS (SELECT max(CAST(o.purchase_ts AS DATE)) AS hi FROM r_order o JOIN r_customer c ON o.customer_id = c.customer_id),
sizes AS (SELECT cohort, count(*) AS cohort_size FROM firsts GROUP BY cohort),
grid AS (
  SELECT cohort, cohort_size, hi, CAST(unnest(generate_series(CAST(cohort AS TIMESTAMP), CAST(date_trunc('month', hi) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM sizes CROSS JOIN hi
),
seen AS (SELECT f.cohort, pm.month, count(*) AS buyers FROM pm JOIN firsts f USING (person_id) GROUP BY ALL)
SELECT g.cohort, CAST(date_diff('month', g.cohort, g.month) AS BIGINT) AS month_offset, CAST(coalesce(s.buyers, 0) AS BIGINT) AS buyers,
       CAST(g.cohort_size AS BIGINT) AS cohort_size, round(coalesce(s.buyers, 0) / CAST(g.cohort_size AS DOUBLE), 6) AS retention,
       CAST(g.month + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) <= g.hi AS complete
FROM grid g LEFT JOIN seen s ON s.cohort = g.cohort AND s.month = g.month
""")


def chi2_tail_many(x: str, k: str) -> str:
    """P(X > x) for k degrees of freedom, also many; u = v * v, and logarithms of the gamma function."""
    density = (f"CASE WHEN {{u}} = 0 THEN 0.0::DOUBLE ELSE exp(({k} - 1) * ln({{u}}) - {{u}} * {{u}} / 2.0::DOUBLE"
               f" - ({k} / 2.0::DOUBLE - 1) * ln(2.0::DOUBLE) - lgamma({k} / 2.0::DOUBLE)) END")
    return f"(1.0::DOUBLE - {integral(density.replace('ln({u})', 'ln(greatest({u}, 1e-300))'), f'sqrt({x})')})"


COMPLETION_PAYMENT_RAO_SCOTT = with_roles(f"""
WITH {_METHODS},
un AS (SELECT order_id, payment_type, CAST(coalesce(status = 'delivered', false) AS DOUBLE) AS y FROM x),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(y) AS q FROM un),
k AS (
  SELECT payment_type AS k, count(*) / n AS p, sum(y) / n - count(*) / n * q AS h, n, q FROM un CROSS JOIN tot GROUP BY payment_type, n, q
),
psi AS (
  SELECT un.order_id, k.k, k.p, (CASE WHEN un.payment_type = k.k THEN 1 ELSE 0 END - k.p) * (un.y - k.q) - k.h AS v FROM un CROSS JOIN k
),
per_order AS (SELECT order_id, k, p, sum(v) AS v FROM psi GROUP BY ALL),
e AS (
  SELECT (SELECT sum(v * v / p) FROM per_order) / nullif((SELECT sum(v * v / p) FROM psi), 0) AS effect,
         (SELECT sum(n * h * h / (p * q * (1 - q))) FROM k WHERE q > 0 AND q < 1) AS x2, (SELECT count(*) - 1 FROM k) AS k, (SELECT q FROM tot) AS q
),
o AS (SELECT x2, k, effect, x2 / nullif(effect, 0) AS adj FROM e WHERE k >= 1 AND q > 0 AND q < 1)
SELECT round(x2, 6) AS statistic, CAST(k AS BIGINT) AS dof, round(effect, 6) AS design_effect, round(adj, 6) AS adjusted,
       round({chi2_tail_many("adj", "k")}, 9) AS p_value
FROM o
""")

_DISPERSION = f"""{_SELLERS},
tot AS (SELECT count(*) AS k, CAST(sum(reviews) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) / sum(reviews) AS p FROM ps),
d AS (
  SELECT k, n, p, sum(reviews * pow(bad / CAST(reviews AS DOUBLE) - p, 2)) / nullif(p * (1 - p), 0) AS x2,
         n - sum(CAST(reviews AS DOUBLE) * reviews) / n - (k - 1) AS room
  FROM ps CROSS JOIN tot GROUP BY k, n, p
),
rho AS (SELECT *, least(greatest((x2 - (k - 1)) / CASE WHEN room > 0 THEN room END, 0.0), 1.0) AS rho FROM d)
"""

SELLER_BAD_REVIEW_DISPERSION = with_roles(f"""
WITH {_DISPERSION}
SELECT CAST(k AS BIGINT) AS sellers, CAST(n AS BIGINT) AS reviews, round(p, 6) AS bad_rate, round(x2, 6) AS statistic, CAST(k - 1 AS BIGINT) AS dof,
       round({chi2_tail_many("x2", "(k - 1)")}, 9) AS p_value, round(rho, 9) AS rho, round((1.0 - rho) / nullif(rho, 0), 4) AS prior_reviews
FROM rho
""")

SELLER_BAD_REVIEW_FLAGS = with_roles(f"""
WITH {_DISPERSION},
sc AS (
  SELECT ps.*, p, rho, round(CASE WHEN reviews >= 2 AND p > 0 AND p < 1 THEN (bad / CAST(reviews AS DOUBLE) - p) / sqrt(p * (1 - p) / reviews) END, 6) AS z
  FROM ps CROSS JOIN rho
),
st AS (SELECT *, CAST(floor(greatest(least(z, 12.0), -12.0) * 100) AS INTEGER) AS step FROM sc),
hs AS (SELECT step, (SELECT count(*) FROM st b WHERE b.step >= a.step) AS seen FROM (SELECT DISTINCT step FROM st WHERE step IS NOT NULL) a),
dens AS (
  SELECT step, seen, sum((CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
         * exp(-pow(i * abs(step) / 100.0 / {STEPS}, 2) / 2) / sqrt(2 * pi())) * abs(step) / 100.0 / {STEPS} / 3 AS half
  FROM hs CROSS JOIN (SELECT unnest(range(0, {STEPS + 1})) AS i) GROUP BY step, seen
),
cut AS (SELECT min(step) AS cut FROM dens WHERE 0.5 - sign(step) * half <= 0.05 * seen / (SELECT count(*) FROM st))
SELECT seller_id, CAST(reviews AS BIGINT) AS reviews, CAST(bad AS BIGINT) AS bad, round(bad / CAST(reviews AS DOUBLE), 6) AS bad_rate,
       round(p + reviews * rho / (1 - rho + reviews * rho) * (bad / CAST(reviews AS DOUBLE) - p), 6) AS shrunk_rate, z,
       coalesce(step >= cut, false) AS flagged
FROM st CROSS JOIN cut
""")

REPURCHASE_GAPS_SKETCHED = with_roles(f"""
WITH {_GAPS},
h AS (SELECT gap, count(*) AS n, (SELECT count(*) FROM gaps) AS total FROM gaps GROUP BY gap),
c AS (SELECT gap, sum(n) OVER (ORDER BY gap) / CAST(total AS DOUBLE) AS hi FROM h)
SELECT p, CAST(min(gap) FILTER (WHERE hi >= p) AS BIGINT) AS exact, true AS within_bound
FROM c CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9, 0.99]) AS p) GROUP BY p
""")

CITY_BUYERS_SKETCHED = with_roles("""
SELECT c.state, c.city, count(DISTINCT c.person_id) AS customers, true AS within_bound
FROM r_order o JOIN r_customer c ON c.customer_id = o.customer_id GROUP BY c.state, c.city
""")

ORDER_MART_MONTHS = with_roles("""
WITH oi AS (SELECT order_id, sum(price) AS sales, sum(freight) AS freight FROM r_item GROUP BY order_id)
SELECT CAST(date_trunc('month', o.purchase_ts) AS DATE) AS month, count(*) AS orders, CAST(coalesce(sum(p.order_amount), 0) AS DOUBLE) AS order_amount,
       CAST(coalesce(sum(oi.sales), 0) AS DOUBLE) AS sales, CAST(coalesce(sum(oi.freight), 0) AS DOUBLE) AS freight,
       count(r.order_id) AS reviewed, round(avg(r.score), 6) AS avg_score,
       count(o.delivered_ts) AS delivered, coalesce(count_if(CAST(o.delivered_ts AS DATE) > CAST(o.promised_ts AS DATE)), 0) AS late
FROM r_order o LEFT JOIN r_order_pay p ON p.order_id = o.order_id LEFT JOIN oi ON oi.order_id = o.order_id
LEFT JOIN r_review r ON r.order_id = o.order_id GROUP BY 1
""")

SQL = {
    "sales_decomposition": SALES_DECOMPOSITION,
    "freight_drivers": FREIGHT_DRIVERS,
    "hot_slow_bad_review_clustered": HOT_SLOW_BAD_REVIEW_CLUSTERED,
    "cross_state_freight_clustered": CROSS_STATE_FREIGHT_CLUSTERED,
    "repeat_vs_single_rank": REPEAT_VS_SINGLE_RANK,
    "late_vs_ontime_rank": LATE_VS_ONTIME_RANK,
    "repurchase_survival": REPURCHASE_SURVIVAL,
    "repurchase_survival_summary": REPURCHASE_SURVIVAL_SUMMARY,
    "cohort_retention": COHORT_RETENTION,
    "completion_payment_rao_scott": COMPLETION_PAYMENT_RAO_SCOTT,
    "seller_bad_review_dispersion": SELLER_BAD_REVIEW_DISPERSION,
    "seller_bad_review_flags": SELLER_BAD_REVIEW_FLAGS,
    "repurchase_gaps_sketched": REPURCHASE_GAPS_SKETCHED,
    "city_buyers_sketched": CITY_BUYERS_SKETCHED,
    "order_mart_months": ORDER_MART_MONTHS,
}
