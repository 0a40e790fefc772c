"""SQL that an independent engine runs for the same results, by query name."""

from __future__ import annotations

from plumbline.plans import metadata as m

BASE = """WITH o AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus AS status FROM orders),
i AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue FROM lineitem),
c AS (SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer),
p AS (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_retailprice AS price FROM part),
n AS (SELECT max(order_date) AS now FROM o),
so AS (SELECT order_id, customer_id, order_date, CAST(CASE WHEN status IN ('F','O') THEN 1 ELSE 0 END AS INTEGER) AS is_fulfilled FROM o),
sc AS (SELECT customer_id, customer_name, CASE WHEN strpos(customer_name, '#') > 0 THEN substr(customer_name, strpos(customer_name, '#') + 1) END AS name_tail, segment FROM c),
s AS (SELECT i.order_id, line_no, order_date, customer_id, product_id, quantity, revenue FROM i JOIN o ON i.order_id = o.order_id),
f AS (SELECT order_id, customer_id, order_date, status, product_id, quantity, CAST(revenue AS DOUBLE) AS revenue, CAST(CASE WHEN status IN ('F','O') THEN 1 ELSE 0 END AS INTEGER) AS is_fulfilled
      FROM o JOIN i USING (order_id)),
dy AS (SELECT order_date, CAST(sum(quantity) AS BIGINT) AS total_quantity, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM s GROUP BY order_date)
"""


def _metrics(months: int) -> str:
    return f"""mx AS (SELECT customer_id, customer_name, segment, count(DISTINCT w.order_id) AS total_orders, count(DISTINCT product_id) AS unique_products, CAST(sum(quantity) AS BIGINT) AS total_items,
       CAST(sum(revenue) AS DOUBLE) AS total_revenue, max(order_date) AS last_order_date, min(order_date) AS first_order_date
  FROM c JOIN (SELECT * FROM o, n WHERE order_date BETWEEN now - INTERVAL {months} MONTH AND now) w USING (customer_id) LEFT JOIN i ON w.order_id = i.order_id
  GROUP BY customer_id, customer_name, segment),
mt AS (SELECT customer_id, customer_name, segment, total_orders, unique_products, total_items, total_revenue, last_order_date,
  CAST(date_diff('day', last_order_date, now) AS INTEGER) AS days_since_last_order,
  CASE WHEN last_order_date >= now - INTERVAL 1 MONTH THEN 'Active' WHEN last_order_date >= now - INTERVAL 3 MONTH THEN 'Recent' WHEN last_order_date >= now - INTERVAL 6 MONTH THEN 'Occasional' ELSE 'Inactive' END AS activity,
  CASE WHEN total_orders > 1 THEN round(total_orders / nullif(CAST(date_diff('day', first_order_date, last_order_date) AS DOUBLE), 0), 6) ELSE 0.0 END AS orders_per_day
  FROM mx, n WHERE total_orders > 0)"""


_RECENT = "order_date >= (SELECT now FROM n) - INTERVAL {} DAY"
WAREHOUSE = {
    "stg_orders": "SELECT * FROM so",
    "stg_order_items": "SELECT order_id, line_no, product_id, quantity, CAST(revenue AS DOUBLE) AS revenue FROM i",
    "stg_customers": "SELECT * FROM sc",
    "vw_recent_orders": f"SELECT order_id, customer_id, order_date FROM so WHERE {_RECENT.format(30)}",
    "dim_customer": "SELECT * FROM sc",
    "dim_product": "SELECT * FROM p",
    "fct_sales": "SELECT order_id, line_no, order_date, customer_id, product_id, quantity, CAST(revenue AS DOUBLE) AS revenue FROM s",
    "agg_sales_by_day": "SELECT * FROM dy",
    "vw_orders_all": "SELECT * FROM o",
    "vw_products_all": "SELECT * FROM p",
    "vw_orders_all_enriched": f"SELECT o.*, CAST(CASE WHEN {_RECENT.format(7)} THEN 1 ELSE 0 END AS INTEGER) AS is_recent FROM o",
    "vw_order_details_star": "SELECT o.*, i.product_id, i.quantity FROM o JOIN i ON o.order_id = i.order_id",
    "vw_recent_orders_star_cte": f"SELECT * FROM o WHERE {_RECENT.format(30)}",
    "vw_orders_in_status": "SELECT * FROM o WHERE status IN ('F','O')",
    "vw_orders_union_star": "SELECT * FROM o WHERE status = 'F' UNION ALL SELECT * FROM o WHERE status = 'O'",
    "vw_customer_order_analysis": """SELECT order_id, customer_id, order_date, status, CAST(row_number() OVER w AS INTEGER) AS order_rank, lag(order_id, 1) OVER w AS previous_order, count(*) OVER (PARTITION BY customer_id) AS lifetime_orders,
       round(avg(order_id) OVER (PARTITION BY customer_id ORDER BY order_date, order_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS rolling_avg FROM o WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)""",
    "vw_customer_order_ranking": """SELECT order_id, customer_id, order_date, CAST(row_number() OVER w AS INTEGER) AS order_sequence, lag(order_id, 1) OVER w AS previous_order, rank() OVER (ORDER BY order_id DESC) AS amount_rank
       FROM o WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)""",
    "vw_sales_analytics": """SELECT order_id, customer_id, product_id, order_date, CAST(r AS DOUBLE) AS revenue, CAST(sum(r) OVER (PARTITION BY customer_id) AS DOUBLE) AS customer_total,
       CAST(sum(r) OVER (PARTITION BY product_id ORDER BY order_date, order_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving_sum,
       CAST(dense_rank() OVER (PARTITION BY customer_id ORDER BY r DESC) AS INTEGER) AS revenue_rank FROM (SELECT order_id, customer_id, product_id, order_date, sum(revenue) AS r FROM s GROUP BY ALL)""",
    "usp_refresh_sales": f"SELECT now AS snapshot_date, order_id, line_no, order_date, customer_id, product_id, CAST(revenue AS DOUBLE) AS revenue FROM s, n WHERE {_RECENT.format(7)}",
    "usp_snapshot_recent_orders": f"SELECT now AS snapshot_date, o.* FROM o, n WHERE {_RECENT.format(30)}",
    "usp_rebuild_recent_sales": f"SELECT order_id, customer_id, order_date, product_id, CAST(revenue AS DOUBLE) AS revenue FROM s WHERE {_RECENT.format(14)}",
    "usp_top_products": f"""SELECT product_id, CAST(sum(quantity) AS BIGINT) AS total_quantity, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM s WHERE {_RECENT.format(30)}
       GROUP BY product_id ORDER BY sum(revenue) DESC, product_id LIMIT 100""",
    "fn_customer_orders_inline": "SELECT * FROM f",
    "fn_customer_orders_mstvf": "SELECT f.*, CAST(date_diff('day', order_date, now) AS INTEGER) AS days_since_order FROM f, n",
    "usp_customer_metrics": f", {_metrics(12)} SELECT * FROM mt",
    "demo_tvf_proc": f""", {_metrics(120)} SELECT f.customer_id, order_id, product_id, revenue, total_revenue, activity, CASE WHEN total_revenue >= 1000000 THEN 'High' WHEN total_revenue >= 500000 THEN 'Medium' ELSE 'Standard' END AS tier,
       round(revenue / nullif(total_revenue, 0) * 100, 4) AS percent_of_total FROM f JOIN mt USING (customer_id) WHERE activity IN ('Active','Recent','Occasional')""",
    "merge_upsert": """SELECT customer_id, CASE WHEN customer_id % 10 = 0 THEN 'MERGED' ELSE segment END AS segment, CAST(balance AS DOUBLE) * CASE WHEN customer_id % 10 = 0 THEN 2 ELSE 1 END AS balance FROM c
       UNION ALL SELECT -customer_id, 'NEW', CAST(balance AS DOUBLE) FROM c WHERE customer_id % 100 = 1""",
    "update_from_join": "SELECT order_id, o.customer_id, CASE WHEN balance < 0 THEN 'H' ELSE status END AS status FROM o LEFT JOIN c ON o.customer_id = c.customer_id",
    "update_output_into": "SELECT product_id, price AS old_price, round(price * 0.5, 4) AS new_price FROM p WHERE price > 900",
    "delete_output_into": "SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.order_id = o.order_id AND quantity >= 10)",
    "truncate_insert": "SELECT status, count(*) AS orders, max(order_date) AS last_date FROM o GROUP BY status",
    "set_intersect": "SELECT customer_id FROM o WHERE status = 'F' INTERSECT SELECT customer_id FROM o WHERE status = 'O'",
    "set_except": "SELECT DISTINCT customer_id FROM (SELECT customer_id, count(*) AS n, max(CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS p FROM o GROUP BY customer_id) WHERE n > p",
    "pivot_status": "SELECT CAST(year(order_date) AS INTEGER) AS year, count(*) FILTER (status = 'F') AS n_f, count(*) FILTER (status = 'O') AS n_o, count(*) FILTER (status = 'P') AS n_p FROM o GROUP BY 1",
    "unpivot_measures": "SELECT order_date, 'quantity' AS measure, CAST(total_quantity AS DOUBLE) AS value FROM dy UNION ALL SELECT order_date, 'revenue', total_revenue FROM dy",
    "semi_join_customers": "SELECT customer_id, customer_name FROM c WHERE EXISTS (SELECT 1 FROM o WHERE o.customer_id = c.customer_id AND year(order_date) = 1997)",
    "anti_join_parts": "SELECT product_id, product_name FROM p WHERE product_id NOT IN (SELECT product_id FROM i WHERE quantity >= 49)",
    "correlated_scalar": "SELECT order_id, customer_id, order_date FROM o WHERE order_date = (SELECT max(x.order_date) FROM o x WHERE x.customer_id = o.customer_id)",
}

WAREHOUSE |= {
    "optional_parameters": "SELECT * FROM o WHERE (NULL IS NULL OR customer_id = NULL) AND ('F' IS NULL OR status = 'F')",
    "cross_join_now": "SELECT order_id, CAST(date_diff('day', order_date, now) AS INTEGER) AS age_days FROM o CROSS JOIN n",
    "theta_join": "SELECT customer_id, tier FROM c JOIN (VALUES (NULL, 0, 'debt'), (0, 2500, 'low'), (2500, 7500, 'middle'), (7500, NULL, 'high')) AS t(low, high, tier) ON (low IS NULL OR balance >= low) AND (high IS NULL OR balance < high)",
    "window_frames": """SELECT order_id, CAST(ntile(4) OVER w AS INTEGER) AS quarter, lead(order_id) OVER w AS next_order, first_value(order_id) OVER a AS first_order, last_value(order_id) OVER a AS last_order,
       count(*) OVER (PARTITION BY customer_id ORDER BY date_diff('day', DATE '1970-01-01', order_date) RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS orders_90_days
       FROM o WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id), a AS (PARTITION BY customer_id ORDER BY order_date, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "global_row_number": "SELECT order_id, row_number() OVER (ORDER BY order_id DESC) AS row_no FROM o",
    "order_by_multiple": f", {_metrics(12)} SELECT * FROM mt ORDER BY total_revenue DESC, customer_id",
    "agg_text_and_spread": "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, round(stddev_samp(c_acctbal), 4) AS spread, round(var_samp(c_acctbal), 2) AS variance, count(*) AS customers FROM customer GROUP BY c_nationkey",
}

EDGES = """e(s, t) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)"""


def _impact(seed: str, direction: str, depth: int = 0) -> str:
    near, far = ("t", "s") if direction == "upstream" else ("s", "t")
    limit = f"WHERE dn.lvl < {depth}" if depth else ""
    return f"""WITH RECURSIVE {EDGES}, r(k, lvl) AS (SELECT '{seed}', 0 UNION SELECT e.{far}, lvl + 1 FROM r JOIN e ON e.{near} = k WHERE lvl < 6),
d AS (SELECT k, min(lvl) AS lvl FROM r GROUP BY k)
SELECT e.s AS from_key, e.t AS to_key, '{direction}' AS direction, CAST(coalesce(nullif(df.lvl, 0), 999999) AS INTEGER) AS level FROM e JOIN d dn ON dn.k = e.{near} LEFT JOIN d df ON df.k = e.{far} {limit}"""


_TABLES = "region nation customer supplier part orders lineitem".split()


def _of(sql: str) -> str:
    return "(" + sql.format(**{t: t for t in _TABLES}) + ")"


_B, _H = (f"(SELECT lower(object) AS object, object_type, lower(column_name) AS column_name, data_type, nullable, ordinal FROM {_of(x)})" for x in (m.BASE_SQL, m.HEAD_SQL))
_SAFE = "(('INT','BIGINT'), ('DECIMAL(10,2)','DECIMAL(18,2)'), ('VARCHAR(50)','VARCHAR(100)'), ('NVARCHAR(50)','NVARCHAR(100)'))"
_CATALOGUES = f"""WITH b AS {_B}, h AS {_H},
gone AS (SELECT * FROM b WHERE object IN (SELECT object FROM h) AND NOT EXISTS (SELECT 1 FROM h WHERE h.object = b.object AND h.column_name = b.column_name)),
come AS (SELECT * FROM h WHERE object IN (SELECT object FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.object = h.object AND b.column_name = h.column_name)),
sc AS (SELECT gone.object, gone.column_name AS old_column, come.column_name AS new_column, gone.ordinal AS place, CASE WHEN upper(trim(gone.data_type)) = upper(trim(come.data_type)) THEN 2 ELSE 0 END + CASE WHEN gone.nullable = come.nullable THEN 2 ELSE 0 END
  + $LINEAGE + CASE WHEN regexp_extract(gone.data_type, '\\(([^)]*)\\)', 1) = regexp_extract(come.data_type, '\\(([^)]*)\\)', 1) THEN 1 ELSE 0 END AS score FROM gone JOIN come ON gone.object = come.object $JOINS),
top AS (SELECT *, count(*) OVER (PARTITION BY object, old_column) AS ties FROM (SELECT *, max(score) OVER (PARTITION BY object, old_column) AS best FROM sc) WHERE score = best AND score >= 4),
rn AS (SELECT object, old_column, new_column, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY object, new_column ORDER BY score DESC, place, old_column) AS nth FROM top WHERE ties = 1) WHERE nth = 1),
pairs AS (SELECT b.object, h.column_name, b.data_type AS bt, h.data_type AS ht, b.nullable AS bn, h.nullable AS hn, b.ordinal AS bo, h.ordinal AS ho
  FROM b LEFT JOIN rn ON b.object = rn.object AND b.column_name = rn.old_column JOIN h ON h.object = b.object AND h.column_name = coalesce(rn.new_column, b.column_name)),
ob AS (SELECT object, CAST(NULL AS VARCHAR) AS column_name, 'OBJECT_ADDED' AS change_type, 'NON_BREAKING' AS severity, CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value FROM h WHERE object NOT IN (SELECT object FROM b) GROUP BY object
  UNION ALL SELECT object, NULL, 'OBJECT_REMOVED', 'BREAKING', NULL, NULL FROM b WHERE object NOT IN (SELECT object FROM h) GROUP BY object
  UNION ALL SELECT x.object, NULL, 'OBJECT_TYPE_CHANGED', 'BREAKING', x.t, y.t FROM (SELECT object, max(object_type) AS t FROM b GROUP BY object) x JOIN (SELECT object, max(object_type) AS t FROM h GROUP BY object) y ON x.object = y.object AND x.t <> y.t),
ty AS (SELECT object, column_name, 'COLUMN_TYPE_CHANGED' AS change_type, CASE WHEN (upper(bt), upper(ht)) IN {_SAFE} THEN 'NON_BREAKING'
  WHEN (upper(bt) LIKE '%VARCHAR%' AND upper(ht) LIKE '%VARCHAR%') OR (upper(bt) LIKE '%DECIMAL%' AND upper(ht) LIKE '%DECIMAL%') THEN 'POTENTIALLY_BREAKING' ELSE 'BREAKING' END AS severity, bt AS old_value, ht AS new_value FROM pairs WHERE bt <> ht),
co AS (SELECT object, column_name, 'COLUMN_ADDED' AS change_type, 'POTENTIALLY_BREAKING' AS severity FROM come WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.object = come.object AND rn.new_column = come.column_name)
  UNION ALL SELECT object, column_name, 'COLUMN_REMOVED', 'BREAKING' FROM gone WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.object = gone.object AND rn.old_column = gone.column_name)
  UNION ALL SELECT object, new_column, 'COLUMN_RENAMED', 'POTENTIALLY_BREAKING' FROM rn UNION ALL SELECT object, column_name, change_type, severity FROM ty
  UNION ALL SELECT object, column_name, 'COLUMN_ORDER_CHANGED', 'POTENTIALLY_BREAKING' FROM pairs WHERE bo <> ho
  UNION ALL SELECT object, column_name, 'COLUMN_NULLABILITY_CHANGED', CASE WHEN hn THEN 'POTENTIALLY_BREAKING' ELSE 'BREAKING' END FROM pairs WHERE bn <> hn)
"""
_SET = "list_sort(list_distinct(list_transform(string_split({}, ','), lambda x: regexp_replace(lower(x), '^[^.]+\\.([^.]+\\.[^.]+\\.[^.]+)$', '\\1'))))"
_LINEAGE = f"""j AS (SELECT b.object, b.column_name, b.transformation AS bt, h.transformation AS ht, array_to_string({_SET.format('b.inputs')}, ',') AS bi, array_to_string({_SET.format('h.inputs')}, ',') AS hi
  FROM {_of(m.BASE_LINEAGE_SQL)} b JOIN {_of(m.HEAD_LINEAGE_SQL)} h ON lower(b.object) = lower(h.object) AND lower(b.column_name) = lower(h.column_name)),
li AS (SELECT object, column_name, 'LINEAGE_TYPE_CHANGED' AS change_type, 'POTENTIALLY_BREAKING' AS severity, bt AS old_value, ht AS new_value FROM j WHERE bt <> ht
       UNION ALL SELECT object, column_name, 'LINEAGE_INPUTS_CHANGED', 'POTENTIALLY_BREAKING', bi, hi FROM j WHERE bi <> hi)"""
_NEAR = "CASE WHEN abs(gone.ordinal - come.ordinal) <= 1 THEN 1 ELSE 0 END"
CATALOGUES = _CATALOGUES.replace("$LINEAGE", _NEAR).replace("$JOINS", "")
#: Renames with the lineage of both versions: equal inputs count 3, and without old inputs the place counts.
_INPUTS = "(SELECT lower(object) AS o, lower(column_name) AS c, " + _SET.format("inputs") + " AS ins FROM {})"
WITH_LINEAGE = _CATALOGUES.replace("$LINEAGE", f"CASE WHEN len(lb.ins) > 0 THEN CASE WHEN lb.ins = lh.ins THEN 3 ELSE 0 END ELSE {_NEAR} END").replace(
    "$JOINS", f"LEFT JOIN {_INPUTS.format(_of(m.BASE_LINEAGE_SQL))} lb ON lb.o = gone.object AND lb.c = gone.column_name LEFT JOIN {_INPUTS.format(_of(m.HEAD_LINEAGE_SQL))} lh ON lh.o = come.object AND lh.c = come.column_name"
).replace("gone AS (SELECT * FROM b", _LINEAGE + ", gone AS (SELECT * FROM b", 1)
_NODES = _of(m.NODES_SQL)
_VOTES = f"v AS (SELECT key, db, CAST(sum(weight) AS BIGINT) AS n FROM {_of(m.VOTES_SQL)} GROUP BY key, db), k AS (SELECT *, row_number() OVER w AS rn, lead(n, 1, 0) OVER w AS n2 FROM v WINDOW w AS (PARTITION BY key ORDER BY n DESC, db))"
_TEMPS = _of(m.TEMPS_SQL)
# the last parts of a table's name, and the column, that each selector names
_NAMED = "VALUES ('Orders.CustomerID', 'dbo.orders', 'customerid'), ('dbo.Customers.customerid', 'dbo.customers', 'customerid'), ('MART.dbo.fct_sales.revenue', 'mart.dbo.fct_sales', 'revenue'), ('STG.dbo.nation_3.Customer#000000011', 'stg.dbo.nation_3', 'customer#000000011'), ('dbo.Orders.Custom', 'dbo.orders', 'custom')"
_THREE = r"([\[\]\w]+\s*\.\s*[\[\]\w]+\s*\.\s*[\[\]\w#]+)"
_BARE = r"regexp_replace(x, '[\[\]\s]', '', 'g')"
_SAID = r"sc AS (SELECT name, regexp_replace(regexp_replace(sql_text, '/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g') AS sql_text FROM " + _of(m.SCRIPTS_SQL) + ")"
METADATA = {
    "graph_edges": f"WITH {EDGES} SELECT s AS from_key, t AS to_key, 'IDENTITY' AS transformation, s[1:1] || '>' || t[1:1] AS description FROM e",
    "graph_nodes": f"WITH {EDGES} SELECT s AS key FROM e UNION SELECT t FROM e",
    "impact_downstream": _impact(m.SEED, "downstream"),
    "impact_upstream": _impact(m.LEAF, "upstream"),
    "impact_both": f"SELECT * FROM ({_impact('n3', 'upstream')}) UNION ALL SELECT * FROM ({_impact('n3', 'downstream')})",
    "impact_depth2": _impact(m.SEED, "downstream", 2),
    "graph_stats": f"""SELECT (SELECT count(*) FROM ({_impact('n3', 'upstream')})) AS upstream_edges, (SELECT count(DISTINCT from_key[1:1]) FROM ({_impact('n3', 'upstream')})) AS upstream_tables,
       (SELECT count(DISTINCT from_key) FROM ({_impact('n3', 'upstream')})) AS upstream_columns, (SELECT count(*) FROM ({_impact('n3', 'downstream')})) AS downstream_edges,
       (SELECT count(DISTINCT to_key[1:1]) FROM ({_impact('n3', 'downstream')})) AS downstream_tables, (SELECT count(DISTINCT to_key) FROM ({_impact('n3', 'downstream')})) AS downstream_columns""",
    "graph_degree_rank": f"WITH {EDGES} SELECT key, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT s AS key, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, 0, 1 FROM e) GROUP BY key",
    "table_neighbourhood": "SELECT * FROM (VALUES ('r', 2), ('n', 1), ('c', 0), ('o', 1), ('p', 2)) AS t(\"table\", level)",
    "topo_waves": f"WITH RECURSIVE {EDGES}, r(k, lvl) AS (SELECT s, 0 FROM e WHERE s NOT IN (SELECT t FROM e) UNION SELECT e.t, lvl + 1 FROM r JOIN e ON e.s = k) SELECT k AS key, CAST(max(lvl) AS INTEGER) AS wave FROM r GROUP BY k",
    "edge_colours": f"WITH {EDGES} SELECT s AS from_key, t AS to_key, CAST((row_number() OVER (PARTITION BY s ORDER BY t) - 1) % 6 AS INTEGER) AS colour FROM e",
    "dependency_graph": f"WITH e AS {_TEMPS}, d AS (SELECT DISTINCT regexp_replace(to_key, '[.][^.]*$', '') AS object, regexp_replace(from_key, '[.][^.]*$', '') AS input FROM e) SELECT * FROM d WHERE object <> input AND input IN (SELECT object FROM d)",
    "dependency_base": f"""WITH RECURSIVE e AS {_TEMPS}, d AS (SELECT DISTINCT regexp_replace(to_key, '[.][^.]*$', '') AS object, regexp_replace(from_key, '[.][^.]*$', '') AS input FROM e),
       r(object, input) AS (SELECT object, input FROM d WHERE object NOT LIKE '%#%' UNION SELECT r.object, d.input FROM r JOIN d ON r.input = d.object WHERE r.input LIKE '%#%') SELECT object, input FROM r WHERE input NOT LIKE '%#%' OR input NOT IN (SELECT object FROM d)""",
    "wildcard_table": f"SELECT table_name, column_name FROM {_NODES} WHERE lower(table_name) LIKE '%dbo.orders'",
    "wildcard_contains": f"SELECT table_name, column_name FROM {_NODES} WHERE lower(table_name) LIKE 'stg%' AND lower(column_name) LIKE '%customer%'",
    "wildcard_glob": f"SELECT table_name, column_name FROM {_NODES} WHERE lower(column_name) LIKE '%id'",
    "wildcard_prefix": f"SELECT table_name, column_name FROM {_NODES} WHERE table_name = 'MART.dbo.fct_sales'",
    "wildcard_space": f"SELECT table_name, column_name FROM {_NODES} WHERE lower(namespace) LIKE 'mssql://localhost/building%' AND lower(column_name) LIKE 'customer#0000000_5%'",
    "selector_exact": f"SELECT selector, table_name, column_name FROM {_NODES} JOIN ({_NAMED}) AS s(selector, t, c) ON lower(column_name) = c AND ('.' || lower(table_name)) LIKE ('%.' || replace(t, '_', '\\_')) ESCAPE '\\'",
    "temp_bypass_edges": f"WITH e AS {_TEMPS} SELECT from_key, to_key FROM e UNION SELECT a.from_key, b.to_key FROM e a JOIN e b ON a.to_key = b.from_key WHERE a.to_key LIKE '%#%' AND a.from_key <> b.to_key",
    "temp_owner_unique": f"""WITH e AS {_TEMPS}, w AS (SELECT '#' || split_part(to_key, '#', 2) AS short, min(to_key) AS owned FROM (SELECT DISTINCT to_key FROM e WHERE to_key LIKE '%_#%') GROUP BY 1 HAVING count(*) = 1)
       SELECT coalesce(owned, from_key) AS from_key, to_key FROM e LEFT JOIN w ON from_key = short""",
    "diff_objects": CATALOGUES + "SELECT * FROM ob",
    "diff_columns": CATALOGUES + "SELECT * FROM co",
    "diff_types": CATALOGUES + "SELECT * FROM ty",
    "diff_renames": CATALOGUES + "SELECT * FROM rn",
    "diff_lineage": f"WITH {_LINEAGE} SELECT * FROM li",
    "diff_summary": f"""{WITH_LINEAGE} SELECT severity, change_type, count(*) AS changes FROM (SELECT severity, change_type FROM ob
       UNION ALL SELECT severity, change_type FROM co UNION ALL SELECT severity, change_type FROM li) GROUP BY 1, 2""",
    "db_votes": f"WITH {_VOTES} SELECT key, db, n FROM v",
    "db_leader": f"WITH {_VOTES} SELECT key, db FROM k WHERE rn = 1 AND n > n2",
    "registry_promote": f"WITH {_VOTES} SELECT key, db FROM k WHERE rn = 1 AND n >= 2 AND n - n2 >= 1",
    "registry_resolve": f"""WITH {_VOTES}, hd AS {_of(m.HARD_SQL)} SELECT q.key, coalesce(CASE WHEN lower(a.db) NOT LIKE 'warehousedb%' AND lower(a.db) NOT LIKE 'warehousedw%' THEN a.db END,
       CASE WHEN lower(b.db) NOT LIKE 'warehousedb%' AND lower(b.db) NOT LIKE 'warehousedw%' THEN b.db END, l.db, a.db, b.db, 'DEFAULTDB') AS db
       FROM {_of(m.KEYS_SQL)} q LEFT JOIN hd a ON a.key = q.key LEFT JOIN hd b ON b.key = '*::' || split_part(q.key, '::', 2) LEFT JOIN (SELECT key, db FROM k WHERE rn = 1 AND n > n2) l ON l.key = '*::' || split_part(q.key, '::', 2)""",
    "regex_dependencies": f"""SELECT DISTINCT name, lower(array_to_string(list_slice(x, greatest(len(x) - 2, 1), len(x)), '.')) AS dependency
       FROM (SELECT name, list_filter(string_split(regexp_replace(r, '[\\[\\]]', '', 'g'), '.'), lambda p: p <> '') AS x FROM (SELECT name, unnest(regexp_extract_all(regexp_replace(regexp_replace(sql_text, '/\\*.*?\\*/', ' ', 'g'),
       '--[^\n]*', ' ', 'g'), '(?i)\\b(?:from|join|update|merge\\s+into)\\s+([\\[\\]\\w.#@]+)', 1)) AS r FROM {_of(m.SCRIPTS_SQL)}))""",
    "script_votes": f"""WITH {_SAID}, one AS (SELECT name, unnest(regexp_extract_all(sql_text, '{_THREE}', 1)) AS x, 1 AS w FROM sc UNION ALL SELECT name, unnest(regexp_extract_all(sql_text, '(?i)\\bINTO\\s+{_THREE}', 1)), 3 FROM sc)
       SELECT name, split_part({_BARE}, '.', 1) AS db, CAST(sum(w) AS BIGINT) AS n FROM one WHERE lower(split_part({_BARE}, '.', 1)) NOT IN ('view', 'function', 'procedure', 'tempdb') GROUP BY 1, 2""",
    "registry_learn": f"""WITH {_SAID}, one AS (SELECT unnest(regexp_extract_all(sql_text, '(?i)\\b(?:INTO|UPDATE)\\s+{_THREE}', 1)) AS x, 10 AS w FROM sc UNION ALL SELECT unnest(regexp_extract_all(sql_text, '(?i)\\b(?:FROM|JOIN)\\s+{_THREE}', 1)), 1 FROM sc)
       SELECT '*::' || lower(split_part({_BARE}, '.', 2) || '.' || split_part({_BARE}, '.', 3)) AS key, upper(split_part({_BARE}, '.', 1)) AS db, CAST(sum(w) AS BIGINT) AS n FROM one
       WHERE lower(split_part({_BARE}, '.', 1)) NOT IN ('view', 'function', 'procedure', 'tempdb') GROUP BY 1, 2""",
    "name_normalise": f"""SELECT name, array_to_string(list_slice(x, greatest(len(x) - 2, 1), len(x)), '.') AS plain, CASE WHEN len(x) = 1 THEN 'dbo.' || x[1] ELSE x[-2] || '.' || x[-1] END AS schema_table
       FROM (SELECT name, string_split(regexp_replace(trim(name), '[\\[\\]"]', '', 'g'), '.') AS x FROM {_of(m.NAMES_SQL)})""",
}

# What the scripts of BASE_DDL say, worked out by hand.
METADATA |= {
    "schema_registry": """SELECT * FROM (VALUES ('STG.dbo.Orders','OrderID','int',FALSE,0),('STG.dbo.Orders','CustomerID','int',FALSE,1),('STG.dbo.Orders','OrderDate','datetime',TRUE,2),
       ('STG.dbo.Orders','Price','decimal(10,2)',TRUE,3),('STG.dbo.Orders','Status','nvarchar(50)',TRUE,4)) AS t(object, column_name, data_type, nullable, ordinal)""",
    "extract_lineage": """SELECT * FROM (VALUES ('STG.dbo.stg_orders','OrderID','IDENTITY','STG.dbo.Orders.OrderID'),('STG.dbo.stg_orders','OrderDay','CAST','STG.dbo.Orders.OrderDate'),('STG.dbo.stg_orders','IsFulfilled','CASE','STG.dbo.Orders.Status'),
       ('MART.dbo.star','OrderID','IDENTITY','STG.dbo.stg_orders.OrderID'),('MART.dbo.star','OrderDay','IDENTITY','STG.dbo.stg_orders.OrderDay'),('MART.dbo.star','IsFulfilled','IDENTITY','STG.dbo.stg_orders.IsFulfilled'),('MART.dbo.star','Version','CONSTANT',''),
       ('MART.dbo.both','OrderID','UNION','STG.dbo.Orders.CustomerID,STG.dbo.stg_orders.OrderID'),('MART.dbo.refresh#t','CustomerID','IDENTITY','STG.dbo.Orders.CustomerID'),('MART.dbo.refresh#t','Total','ARITHMETIC_AGGREGATION','STG.dbo.Orders.Price'),
       ('MART.dbo.totals','Customer','IDENTITY','MART.dbo.refresh#t.CustomerID'),('MART.dbo.totals','Amount','IDENTITY','MART.dbo.refresh#t.Total')) AS t(object, column_name, transformation, inputs)""",
    "ol_inputs": """SELECT * FROM (VALUES ('STG.dbo.stg_orders','STG.dbo.Orders'),('MART.dbo.star','STG.dbo.stg_orders'),('MART.dbo.both','STG.dbo.stg_orders'),('MART.dbo.both','STG.dbo.Orders'),
       ('MART.dbo.refresh#t','STG.dbo.Orders'),('MART.dbo.totals','MART.dbo.refresh#t')) AS t(object, input)""",
    "lineage_coverage": """SELECT object, n AS columns, covered, CAST(covered AS DOUBLE) / n AS coverage FROM (VALUES ('STG.dbo.Orders',CAST(5 AS BIGINT),CAST(0 AS BIGINT)),('STG.dbo.stg_orders',3,3),('MART.dbo.star',4,4),('MART.dbo.both',1,1),
       ('MART.dbo.refresh#t',2,2),('MART.dbo.totals',2,2)) AS t(object, n, covered)""",
}


METADATA["ol_column_lineage"] = """SELECT * FROM (VALUES ('STG.dbo.stg_orders','OrderID','IDENTITY','STG.dbo.Orders','OrderID'),('STG.dbo.stg_orders','OrderDay','CAST','STG.dbo.Orders','OrderDate'),('STG.dbo.stg_orders','IsFulfilled','CASE','STG.dbo.Orders','Status'),
       ('MART.dbo.star','OrderID','IDENTITY','STG.dbo.stg_orders','OrderID'),('MART.dbo.star','OrderDay','IDENTITY','STG.dbo.stg_orders','OrderDay'),('MART.dbo.star','IsFulfilled','IDENTITY','STG.dbo.stg_orders','IsFulfilled'),('MART.dbo.star','Version','CONSTANT',NULL,NULL),
       ('MART.dbo.both','OrderID','UNION','STG.dbo.Orders','CustomerID'),('MART.dbo.both','OrderID','UNION','STG.dbo.stg_orders','OrderID'),('MART.dbo.refresh#t','CustomerID','IDENTITY','STG.dbo.Orders','CustomerID'),('MART.dbo.refresh#t','Total','ARITHMETIC_AGGREGATION','STG.dbo.Orders','Price'),
       ('MART.dbo.totals','Customer','IDENTITY','MART.dbo.refresh#t','CustomerID'),('MART.dbo.totals','Amount','IDENTITY','MART.dbo.refresh#t','Total')) AS t(object, column_name, transformation, input, field)"""


def oracles() -> dict[str, str]:
    return {k: BASE + (v if v.startswith(",") else v) for k, v in WAREHOUSE.items()} | METADATA
