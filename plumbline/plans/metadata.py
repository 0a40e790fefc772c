"""Queries of the metadata operators: over a graph that the driver's keys span, and over catalogues, names and votes made of its
tables, beside a few rows of special cases."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import diff, graph, registry
from plumbline.storage import table, values
from plumbline.tsql import artifacts
from plumbline.tsql.frontend import Extractor, columns_of_ddl

#: The region from which impact queries start, and the node from which they look upstream.
SEED, LEAF = "r0", "p1"

BASE_COLUMNS = """('stg.orders','table','order_id','INT',FALSE,0),('stg.orders','table','customer','INT',FALSE,1),('stg.orders','table','amount','DECIMAL(10,2)',TRUE,2),
('stg.orders','table','note','VARCHAR(50)',TRUE,3),('stg.orders','table','state','VARCHAR(20)',TRUE,4),('stg.orders','table','flag','INT',TRUE,5),('mart.sales','view','revenue','DECIMAL(18,2)',TRUE,0),
('mart.sales','view','day','DATE',FALSE,1),('mart.sales','view','qty','INT',TRUE,2),('mart.old','table','id','INT',FALSE,0),('mart.flip','table','id','INT',FALSE,0)"""
HEAD_COLUMNS = """('STG.orders','table','order_id','BIGINT',FALSE,0),('stg.orders','table','customer_id','INT',FALSE,1),('stg.orders','table','amount','DECIMAL(18,2)',FALSE,2),
('stg.orders','table','note','VARCHAR(100)',TRUE,3),('stg.orders','table','flag','DATE',TRUE,4),('stg.orders','table','extra','XML',FALSE,9),('mart.sales','view','revenue','DECIMAL(10,2)',TRUE,0),
('mart.sales','view','qty','INT',FALSE,1),('mart.sales','view','day','DATE',TRUE,2),('mart.new','table','id','INT',FALSE,0),('mart.flip','view','id','INT',FALSE,0)"""
BASE_LINEAGE = "('mart.sales','revenue','AGGREGATION','stg.orders.amount'),('mart.sales','day','IDENTITY','stg.orders.day'),('mart.sales','qty','AGGREGATION','stg.orders.qty,stg.orders.amount')"
HEAD_LINEAGE = "('mart.sales','revenue','ARITHMETIC','stg.orders.amount'),('mart.sales','day','IDENTITY','stg.orders.order_day'),('mart.sales','qty','AGGREGATION','stg.orders.amount,stg.orders.qty')"
VOTES = "('table::dbo.a','STG',1),('*::dbo.a','STG',10),('*::dbo.a','EDW',3),('*::dbo.b','EDW',2),('*::dbo.b','STG',2),('*::dbo.c','MART',1),('*::dbo.d','MART',2),('*::dbo.d','EDW',1),('*::dbo.d','MART',3)"
HARD = "('table::dbo.a','STG'),('*::dbo.c','warehousedw'),('view::dbo.d','warehousedb'),('*::dbo.e','EDW')"
KEYS = "('table::dbo.a'),('view::dbo.a'),('table::dbo.b'),('view::dbo.c'),('view::dbo.d'),('table::dbo.e'),('table::dbo.f')"
TEMP_EDGES = "('stg.orders.id','p1#tmp.id'),('p1#tmp.id','mart.sales.id'),('stg.orders.qty','p1#tmp.qty'),('p1#tmp.qty','mart.sales.qty'),('#tmp.qty','mart.copy.qty'),('#both.x','mart.copy.x'),('stg.a.x','p1#both.x'),('stg.b.x','p2#both.x')"
SCRIPTS = """('a','SELECT * FROM STG.dbo.Orders o JOIN [STG].[dbo].[Items] i ON 1=1 -- from nowhere'),('b','UPDATE t SET x=1 FROM dbo.T t /* join x */ INNER JOIN #tmp z ON 1=1'),('c','MERGE INTO mart.dbo.f USING dbo.s ON 1=1'),('d','SELECT 1'),('e','INSERT INTO [DW].dbo.f SELECT * FROM STG.dbo.s JOIN tempdb.dbo.x ON 1=1'),('f','SELECT a INTO EDW.dbo.g FROM STG.dbo.s -- FROM X.y.z')"""
NAMES = "('[STG].[dbo].[Orders]'),('Orders'),('dbo.Orders'),('srv.STG.dbo.Orders'),('\"a\".\"b\"'),(' x ')"


#: Relations that both engines read: special cases, and a row per row of the tables in braces. Text that Spark and the oracle share.
def _rows(literal: str, columns: str, *more: str) -> str:
    return f"SELECT * FROM (VALUES {literal}) AS t({columns})" + "".join(f" UNION ALL {m}" for m in more)


COLUMN_NAMES = "object, object_type, column_name, data_type, nullable, ordinal"
CORPUS_NODES = """('mssql://localhost/DW','STG.dbo.Customers','CustomerID'),('mssql://localhost/DW','STG.dbo.Customers','CustomerName'),('mssql://localhost/DW','STG.dbo.Orders','OrderID'),
('mssql://localhost/DW','STG.dbo.Orders','CustomerID'),('mssql://localhost/DW','STG.dbo.Orders','Revenue'),('mssql://localhost/DW','MART.dbo.fct_sales','Revenue'),('mssql://localhost/DW','MART.dbo.fct_sales','CustomerID'),('mssql://localhost/DW','MART.dbo.dim_customer','customer_id')"""
NODES_SQL = _rows(CORPUS_NODES, "namespace, table_name, column_name", "SELECT 'mssql://localhost/' || c_mktsegment, 'STG.dbo.' || n_name, c_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
VOTES_SQL = _rows(VOTES, "key, db, weight", "SELECT '*::dbo.n' || c_nationkey, c_mktsegment, 1 FROM {customer}", "SELECT '*::dbo.c' || o_custkey, o_orderpriority, 3 FROM {orders}")
HARD_SQL = _rows(HARD, "key, db", "SELECT 'table::dbo.n' || n_nationkey, CASE WHEN n_regionkey = 1 THEN 'EDW' ELSE 'WarehouseDB' END FROM {nation}")
KEYS_SQL = _rows(KEYS, "key", "SELECT 'table::dbo.n' || n_nationkey FROM {nation}", "SELECT 'view::dbo.c' || c_custkey FROM {customer}")
TEMPS_SQL = _rows(TEMP_EDGES, "from_key, to_key", "SELECT 'stg.orders.c' || o_custkey, 'p' || o_custkey || '#t.o' || o_orderkey FROM {orders}", "SELECT '#t.o' || l_orderkey, 'mart.parts.p' || l_partkey FROM {lineitem}")
SCRIPTS_SQL = _rows(SCRIPTS, "name, sql_text", "SELECT 'part' || p_partkey, 'SELECT x FROM [STG].[dbo].[P' || p_partkey || '] AS a /* FROM none */ JOIN dbo.' || p_type || ' ON 1=1 -- JOIN nothing' FROM {part}")
NAMES_SQL = _rows(NAMES, "name", "SELECT '[DW].[' || c_mktsegment || '].\"' || c_name || '\"' FROM {customer}")
# an object per brand and type, a column per part; of the second version, parts of some sizes are gone, renamed, retyped, moved or loose
_PART_OBJECT = "'wh.' || lower(replace(p_brand, '#', '')) || '.' || lower(p_type)"
BASE_SQL = _rows(BASE_COLUMNS, COLUMN_NAMES, f"SELECT {_PART_OBJECT}, 'table', 'col' || p_partkey, CASE WHEN p_size < 10 THEN 'INT' WHEN p_size < 20 THEN 'VARCHAR(50)' WHEN p_size < 30 THEN 'nvarchar(50)' ELSE 'DECIMAL(10,2)' END, p_size > 25, p_partkey FROM {{part}}")
HEAD_SQL = _rows(HEAD_COLUMNS, COLUMN_NAMES, f"""SELECT upper({_PART_OBJECT}), CASE WHEN p_type = 'PROMO' THEN 'view' ELSE 'table' END, CASE WHEN p_size = 3 THEN 'named' || p_partkey ELSE 'col' || p_partkey END,
  CASE WHEN p_size < 5 THEN 'BIGINT' WHEN p_size < 10 THEN 'INT' WHEN p_size = 11 THEN 'VARCHAR(100)' WHEN p_size = 12 THEN 'VARCHAR(20)' WHEN p_size < 20 THEN 'VARCHAR(50)' WHEN p_size = 21 THEN 'NVARCHAR(100)' WHEN p_size < 30 THEN 'nvarchar(50)' WHEN p_size = 40 THEN 'DATE' ELSE 'DECIMAL(10,2)' END,
  CASE WHEN p_size = 31 THEN FALSE WHEN p_size = 7 THEN TRUE ELSE p_size > 25 END, CASE WHEN p_size = 33 THEN p_partkey + 5 ELSE p_partkey END FROM {{part}} WHERE p_size <> 17""")
_LINEAGE = "object, column_name, transformation, inputs"
BASE_LINEAGE_SQL = _rows(BASE_LINEAGE, _LINEAGE, f"SELECT {_PART_OBJECT}, 'col' || p_partkey, CASE WHEN p_size < 20 THEN 'IDENTITY' ELSE 'CAST' END, 'stg.dbo.a.x' || p_size || ',dbo.b.y' FROM {{part}}")
HEAD_LINEAGE_SQL = _rows(HEAD_LINEAGE, _LINEAGE, f"SELECT {_PART_OBJECT}, 'col' || p_partkey, CASE WHEN p_size < 25 THEN 'IDENTITY' ELSE 'CAST' END, CASE WHEN p_size = 9 THEN 'dbo.b.y' ELSE 'dbo.b.y,STG.dbo.a.x' || p_size END FROM {{part}}")


def relation(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """One of the relations above, with the tables of folder d."""
    named = {name for _, name, _, _ in Formatter().parse(sql) if name}
    return spark.sql(sql, **{name: table(spark, d, name) for name in named})


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """region → nation → customer → order → part, by the driver's keys, as often as rows say so."""
    pair = lambda name, a, x, b, y: table(spark, d, name).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("from_key"), F.concat(F.lit(b), F.col(y).cast("string")).alias("to_key"))
    steps = [pair("nation", "r", "n_regionkey", "n", "n_nationkey"), pair("customer", "n", "c_nationkey", "c", "c_custkey"), pair("orders", "c", "o_custkey", "o", "o_orderkey"), pair("lineitem", "o", "l_orderkey", "p", "l_partkey")]
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def _described(pairs: DataFrame) -> DataFrame:
    return pairs.select("from_key", "to_key", F.lit("IDENTITY").alias("transformation"), F.concat(F.substring("from_key", 1, 1), F.lit(">"), F.substring("to_key", 1, 1)).alias("description"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return _described(_pairs(spark, d).distinct())


def seeds(spark: SparkSession, *keys: str) -> DataFrame:
    return values(spark, ",".join(f"('{k}')" for k in keys), "key")


def _impact(spark: SparkSession, d: str, key: str, direction: str, depth: int = 0) -> DataFrame:
    return graph.impact(_described(_pairs(spark, d)), seeds(spark, key), direction, depth).select("from_key", "to_key", "direction", "level")


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_edges(edges(spark, d))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes_of(_pairs(spark, d))


def impact_downstream(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, SEED, "downstream")


def impact_upstream(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, LEAF, "upstream")


def impact_both(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, "n3", "both")


def impact_depth2(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, SEED, "downstream", 2)


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.traversal_stats(_described(_pairs(spark, d)), seeds(spark, "n3"), F.substring("key", 1, 1))


def graph_degree_rank(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edges(spark, d))


def table_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(edges(spark, d), "c", lambda k: F.substring(k, 1, 1))


def topo_waves(spark: SparkSession, d: str) -> DataFrame:
    return graph.waves(edges(spark, d))


def edge_colours(spark: SparkSession, d: str) -> DataFrame:
    return graph.colour_index(edges(spark, d), 6).select("from_key", "to_key", "colour")


def _matching(spark: SparkSession, d: str, pattern: str) -> DataFrame:
    nodes = relation(spark, d, NODES_SQL)
    return nodes.where(graph.matches(pattern, F.col("namespace"), F.col("table_name"), F.col("column_name"))).select("table_name", "column_name")


def wildcard_table(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "dbo.Orders.*")


def wildcard_contains(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "STG..customer")


def wildcard_glob(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "..*id")


def wildcard_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "mssql://localhost/DW.MART.dbo.fct_sales.*")


def wildcard_space(spark: SparkSession, d: str) -> DataFrame:
    return _matching(spark, d, "mssql://localhost/BUILDING..customer#0000000?5*")


def selector_exact(spark: SparkSession, d: str) -> DataFrame:
    """Columns that selectors of two, three and four parts name; `id` doesn't mean `id_old`."""
    out = None
    for pattern in ("Orders.CustomerID", "dbo.Customers.customerid", "MART.dbo.fct_sales.revenue", "STG.dbo.nation_3.Customer#000000011", "dbo.Orders.Custom"):
        found = _matching(spark, d, pattern).withColumn("selector", F.lit(pattern))
        out = found if out is None else out.unionByName(found)
    return out


def _temp_edges(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, TEMPS_SQL).select("*", F.lit("IDENTITY").alias("transformation"), F.lit("").alias("description"))


def temp_bypass_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.bypass_temps(_temp_edges(spark, d), F.col("key").contains("#")).select("from_key", "to_key")


def temp_owner_unique(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve_temps(_temp_edges(spark, d)).select("from_key", "to_key")


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    owner = lambda c: F.regexp_replace(c, r"[.][^.]*$", "")
    return _temp_edges(spark, d).select(owner("to_key").alias("object"), owner("from_key").alias("input")).distinct()


def dependency_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.object_graph(_dependencies(spark, d))


def dependency_base(spark: SparkSession, d: str) -> DataFrame:
    """What each object comes from, temps passed through."""
    return graph.base_inputs(_dependencies(spark, d), lambda c: c.contains("#"))


def _catalogues(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(relation(spark, d, sql).withColumnRenamed("column_name", "column") for sql in (BASE_SQL, HEAD_SQL))


def _lineages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(relation(spark, d, sql).withColumnRenamed("column_name", "column").withColumn("inputs", F.split("inputs", ",")) for sql in (BASE_LINEAGE_SQL, HEAD_LINEAGE_SQL))


def _told(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("column", "column_name")


def diff_objects(spark: SparkSession, d: str) -> DataFrame:
    return _told(diff.object_changes(*_catalogues(spark, d)))


def diff_columns(spark: SparkSession, d: str) -> DataFrame:
    """All changes of columns; those of types are in diff_types with their values."""
    return _told(diff.column_changes(*_catalogues(spark, d)).select("object", "column", "change_type", "severity"))


def diff_types(spark: SparkSession, d: str) -> DataFrame:
    return _told(diff.column_changes(*_catalogues(spark, d)).where("change_type = 'COLUMN_TYPE_CHANGED'"))


def diff_lineage(spark: SparkSession, d: str) -> DataFrame:
    return _told(diff.lineage_changes(*_lineages(spark, d)))


def diff_renames(spark: SparkSession, d: str) -> DataFrame:
    return diff.renames(*_catalogues(spark, d))


def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all changes, with the lineage of both versions."""
    return diff.summary(diff.changes(*_catalogues(spark, d), *_lineages(spark, d)))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return registry.tally(relation(spark, d, VOTES_SQL))


def db_votes(spark: SparkSession, d: str) -> DataFrame:
    return _votes(spark, d)


def db_leader(spark: SparkSession, d: str) -> DataFrame:
    return registry.leaders(_votes(spark, d))


def registry_promote(spark: SparkSession, d: str) -> DataFrame:
    return registry.promoted(_votes(spark, d))


def registry_resolve(spark: SparkSession, d: str) -> DataFrame:
    return registry.resolve(relation(spark, d, KEYS_SQL), relation(spark, d, HARD_SQL), _votes(spark, d), "DEFAULTDB")


def regex_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, SCRIPTS_SQL).select("name", F.explode(registry.referenced(F.col("sql_text"))).alias("dependency"))


def script_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes of each script for the database it belongs to."""
    return registry.script_votes(relation(spark, d, SCRIPTS_SQL))


def registry_learn(spark: SparkSession, d: str) -> DataFrame:
    """Tallied votes that the scripts teach."""
    return registry.tally(registry.learn(relation(spark, d, SCRIPTS_SQL))[1])


def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, NAMES_SQL).select("name", registry.plain_name(F.col("name")).alias("plain"), registry.schema_and_table(F.col("name")).alias("schema_table"))


BASE_DDL = """
CREATE TABLE STG.dbo.Orders (OrderID INT NOT NULL PRIMARY KEY, CustomerID INT NOT NULL, OrderDate DATETIME NULL, Price DECIMAL(10, 2) NULL, Status NVARCHAR(50) NULL);
GO
CREATE VIEW STG.dbo.stg_orders AS SELECT o.OrderID, CAST(o.OrderDate AS DATE) AS OrderDay, CASE WHEN o.Status IN ('shipped', 'delivered') THEN 1 ELSE 0 END AS IsFulfilled FROM STG.dbo.Orders AS o;
GO
CREATE VIEW MART.dbo.star AS WITH r AS (SELECT * FROM STG.dbo.stg_orders) SELECT r.*, 1 AS Version FROM r;
GO
CREATE VIEW MART.dbo.both AS SELECT OrderID FROM STG.dbo.stg_orders UNION ALL SELECT CustomerID FROM STG.dbo.Orders;
GO
CREATE PROCEDURE MART.dbo.refresh AS BEGIN
  SELECT CustomerID, SUM(Price * 2) AS Total INTO #t FROM STG.dbo.Orders GROUP BY CustomerID;
  INSERT INTO MART.dbo.totals (Customer, Amount) SELECT t.CustomerID, t.Total FROM #t AS t;
END
"""


def _extracted(spark: SparkSession) -> Extractor:
    found = Extractor(spark)
    found.script(BASE_DDL)
    return found


def schema_registry(spark: SparkSession, d: str) -> DataFrame:
    """The declared columns of base tables, as DDL gives them."""
    return _told(columns_of_ddl(spark, BASE_DDL))


def extract_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Every column's transformation and inputs, from the scripts through Catalyst's plans."""
    return _told(_extracted(spark).tables()[2].drop("description").withColumn("inputs", F.array_join(F.array_sort("inputs"), ",")))


def ol_inputs(spark: SparkSession, d: str) -> DataFrame:
    """(object, input) pairs of the OpenLineage events."""
    found = _extracted(spark)
    return artifacts.inputs(found.tables()[2], found.dependencies())


def ol_column_lineage(spark: SparkSession, d: str) -> DataFrame:
    """The columnLineage facets of the OpenLineage events, a row an input field."""
    found = _extracted(spark)
    facet = "struct<inputFields:array<struct<namespace:string,name:string,field:string>>,transformationType:string>"
    path = F.get_json_object("event", "$.outputs[0].facets.columnLineage.fields")
    rows = artifacts.events(*found.tables(), dependencies=found.dependencies()).select(F.col("name").alias("object"), F.explode(F.from_json(path, f"map<string,{facet}>")).alias("column_name", "l"))
    rows = rows.select("object", "column_name", F.col("l.transformationType").alias("transformation"), F.explode_outer("l.inputFields").alias("i"))
    return rows.select("object", "column_name", "transformation", F.concat_ws(".", F.element_at(F.split("i.namespace", "/"), -1), "i.name").alias("input"), F.col("i.field").alias("field")).withColumn("input", F.when(F.col("field").isNotNull(), F.col("input")))


def lineage_coverage(spark: SparkSession, d: str) -> DataFrame:
    _, columns, told = _extracted(spark).tables()
    return artifacts.coverage(columns, told)
