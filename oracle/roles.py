"""Role stand-ins written directly in DuckDB SQL (FIXTURES.md §2).

Written from the fixture definitions, not generated from the Spark plans, so
the oracle checks the binding as well as the analyses.
"""

ROLE_CTES = """
r_place AS (
  SELECT n.n_nationkey AS nationkey, n.n_name AS city, r.r_name AS state,
         CAST(n.n_nationkey AS BIGINT) AS geo_key
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
),
r_customer AS (
  SELECT c.c_custkey AS customer_id, c.c_custkey AS person_id, p.city, p.state, p.geo_key
  FROM customer c JOIN r_place p ON c.c_nationkey = p.nationkey
),
r_seller AS (
  SELECT s.s_suppkey AS seller_id, p.city, p.state, p.geo_key
  FROM supplier s JOIN r_place p ON s.s_nationkey = p.nationkey
),
r_geo AS (
  SELECT CAST(n_nationkey AS BIGINT) AS geo_key,
         CAST(-30 + n_nationkey AS DOUBLE) AS lat,
         -60.0 + 1.5 * n_nationkey AS lng
  FROM nation
),
r_product AS (
  SELECT p.p_partkey AS product_id, p.p_brand AS category,
         CAST(length(p.p_name) AS INTEGER) AS name_len,
         CAST(d.n_chars AS INTEGER) AS desc_len,
         CAST(p.p_size % 6 + 1 AS INTEGER) AS photo_cnt,
         CAST(p.p_size * 100 AS DOUBLE) AS weight_g,
         CAST(p.p_size AS DOUBLE) AS length_cm,
         CAST(p.p_size % 7 + 2 AS DOUBLE) AS height_cm,
         CAST(p.p_size % 11 + 5 AS DOUBLE) AS width_cm
  FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey
),
r_item AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
         CAST(l_quantity AS BIGINT) AS units,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(16,4)) AS freight
  FROM lineitem
),
r_delay AS (
  SELECT l.l_orderkey AS order_id,
         max(((date_diff('day', o.o_orderdate, l.l_shipdate) % 60) + 60) % 60) AS delay_days
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY l.l_orderkey
),
r_order AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id,
         CASE o.o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                              WHEN 'P' THEN 'canceled' END AS status,
         o.o_orderdate AS purchase_ts,
         CASE WHEN o.o_orderstatus = 'F' AND d.delay_days IS NOT NULL
              THEN o.o_orderdate + to_days(CAST(d.delay_days AS INTEGER)) END AS delivered_ts,
         o.o_orderdate + INTERVAL 55 DAY AS promised_ts
  FROM orders o LEFT JOIN r_delay d ON d.order_id = o.o_orderkey
),
r_payment AS (
  SELECT o_orderkey AS order_id, 1 AS seq, o_orderpriority AS payment_type,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1 + o_orderkey % 10 ELSE 1 END AS installments,
         CASE WHEN o_orderkey % 20 = 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) - 10.00
              ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS value
  FROM orders
  UNION ALL
  SELECT o_orderkey, 2, 'VOUCHER', 1, CAST(10.00 AS DECIMAL(12,2))
  FROM orders WHERE o_orderkey % 20 = 0
),
r_review AS (
  SELECT l_orderkey AS order_id,
         CASE WHEN r = 0 THEN 5 WHEN 10 * r < 3 * n THEN 4 WHEN 20 * r < 9 * n THEN 3
              WHEN 10 * r < 7 * n THEN 2 ELSE 1 END AS score
  FROM (SELECT l_orderkey, count(*) AS n, count_if(l_returnflag = 'R') AS r
        FROM lineitem GROUP BY l_orderkey)
),
r_order_pay AS (
  SELECT order_id, sum(value) AS order_amount FROM r_payment GROUP BY order_id
)
"""


def with_roles(body: str) -> str:
    """Prefix a query body with the role CTEs (the body may add its own CTEs after a comma)."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ROLE_CTES.strip() + ",\n" + body[5:]
    return "WITH " + ROLE_CTES.strip() + "\n" + body
