"""The warehouse workload: staging, facts, stars, windows, procedures and data changes, over the driver's tables.

Money is DECIMAL(18,2) inside sums, so results don't depend on the order of addition, and DOUBLE outside. "Now" is the
last order's date. `lineitem` has no key: orders on it name enough columns to be total, or stay with ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.storage import dealt, table

MONEY = "decimal(18,2)"
FULFILLED = ("F", "O")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_orderstatus").alias("status"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_extendedprice").cast(MONEY).alias("revenue")
    )


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast(MONEY).alias("balance"))


def products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"))


def as_of(spark: SparkSession, d: str):
    """The last order's date: a subquery of one value, which runs with the query."""
    return orders(spark, d).agg(F.max("order_date")).scalar()


def since(spark: SparkSession, d: str, days: int):
    return F.date_sub(as_of(spark, d), days)


def money(name: str):
    return F.col(name).cast("double").alias(name)


def total(name: str, alias: str):
    return F.sum(name).cast("double").alias(alias)


# views


def stg_orders(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("order_id", "customer_id", "order_date", F.when(F.col("status").isin(*FULFILLED), 1).otherwise(0).alias("is_fulfilled"))


def stg_order_items(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).withColumn("revenue", F.col("revenue").cast("double"))


def stg_customers(spark: SparkSession, d: str) -> DataFrame:
    at = F.locate("#", F.col("customer_name"))
    return customers(spark, d).select("customer_id", "customer_name", F.when(at > 0, F.expr("substring(customer_name, locate('#', customer_name) + 1, length(customer_name))")).alias("name_tail"), "segment")


def vw_recent_orders(spark: SparkSession, d: str) -> DataFrame:
    return stg_orders(spark, d).where(F.col("order_date") >= since(spark, d, 30)).select("order_id", "customer_id", "order_date")


def dim_customer(spark: SparkSession, d: str) -> DataFrame:
    return stg_customers(spark, d)


def dim_product(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d)


def lines(spark: SparkSession, d: str) -> int:
    """Rows of `lineitem`, from the files' footers."""
    return table(spark, d, "lineitem").count()


def sales(spark: SparkSession, d: str) -> DataFrame:
    n = lines(spark, d)
    return dealt(items(spark, d), n, "order_id").join(dealt(orders(spark, d), n, "order_id"), "order_id").select("order_id", "line_no", "order_date", "customer_id", "product_id", "quantity", "revenue")


def fct_sales(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).withColumn("revenue", F.col("revenue").cast("double"))


def agg_sales_by_day(spark: SparkSession, d: str) -> DataFrame:
    return sales(spark, d).groupBy("order_date").agg(F.sum("quantity").alias("total_quantity"), total("revenue", "total_revenue"))


def vw_orders_all(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("*")


def vw_products_all(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d).select("*")


def vw_orders_all_enriched(spark: SparkSession, d: str) -> DataFrame:
    return vw_orders_all(spark, d).select("*", F.when(F.col("order_date") >= since(spark, d, 7), 1).otherwise(0).alias("is_recent"))


def vw_order_details_star(spark: SparkSession, d: str) -> DataFrame:
    return vw_orders_all(spark, d).alias("o").join(items(spark, d).alias("i"), "order_id").select("o.*", "i.product_id", "i.quantity")


def vw_recent_orders_star_cte(spark: SparkSession, d: str) -> DataFrame:
    return vw_orders_all(spark, d).where(F.col("order_date") >= since(spark, d, 30)).select("*")


def vw_orders_in_status(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).where(F.col("status").isin(*FULFILLED))


def vw_orders_union_star(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).where("status = 'F'").unionAll(orders(spark, d).where("status = 'O'"))


def vw_customer_order_analysis(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("customer_id")
    order = by.orderBy("order_date", "order_id")
    return orders(spark, d).select(
        "order_id", "customer_id", "order_date", "status",
        F.row_number().over(order).alias("order_rank"),
        F.lag("order_id", 1).over(order).alias("previous_order"),
        F.count(F.lit(1)).over(by).alias("lifetime_orders"),
        F.round(F.avg("order_id").over(order.rowsBetween(-2, 0)), 4).alias("rolling_avg"),
    )


def vw_customer_order_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The rank over all orders follows from counts below each key, summed by key range, not from one sorted partition."""
    order = Window.partitionBy("customer_id").orderBy("order_date", "order_id")
    own = orders(spark, d)
    return own.select("order_id", "customer_id", "order_date", F.row_number().over(order).alias("order_sequence"), F.lag("order_id", 1).over(order).alias("previous_order")).join(global_rank(own.select("order_id"), "order_id"), "order_id")


def global_rank(rows: DataFrame, column: str, alias: str = "amount_rank") -> DataFrame:
    """(column, alias): RANK() OVER (ORDER BY column DESC) of each distinct value of an integer column, without a single partition.

    Values fall into buckets of about equal rows, between quantiles of the column; a value's rank is one more than the rows of
    higher buckets and those above it in its own. Only the buckets' counts are ordered in one place.
    """
    n = rows.agg(F.count(column)).first()[0]
    buckets = min(1024, max(1, n // 50_000))
    bounds = rows.approxQuantile(column, [k / buckets for k in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else []
    above_bound = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda x: x < F.col(column))) if bounds else F.lit(0)
    counted = rows.where(F.col(column).isNotNull()).groupBy(column).count().withColumn("bucket", above_bound)
    inside = Window.partitionBy("bucket").orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy("bucket").agg(F.sum("count").alias("rows"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("bucket", F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("start"))
    ranked = counted.withColumn("here", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(F.broadcast(starts), "bucket")  # 1024 rows at most
    return ranked.select(column, (F.col("start") + F.col("here") + 1).alias(alias))


def vw_sales_analytics(spark: SparkSession, d: str) -> DataFrame:
    """Sales by order and product, as single lines have no key. Each window has its own partitions, as many as the lines need."""
    n = lines(spark, d)
    own = sales(spark, d).groupBy("order_id", "customer_id", "product_id", "order_date").agg(F.sum("revenue").alias("revenue"))
    by, moving = Window.partitionBy("customer_id"), Window.partitionBy("product_id").orderBy("order_date", "order_id").rowsBetween(-2, 0)
    of_customer = dealt(own, n, "customer_id").select("*", F.sum("revenue").over(by).cast("double").alias("customer_total"), F.dense_rank().over(by.orderBy(F.desc("revenue"))).alias("revenue_rank"))
    return dealt(of_customer, n, "product_id").select(
        "order_id", "customer_id", "product_id", "order_date", money("revenue"), "customer_total", F.sum("revenue").over(moving).cast("double").alias("moving_sum"), "revenue_rank"
    )


# procedures and functions


def usp_refresh_sales(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot of the last week's sales, through two stages that are temp tables in the source."""
    now = as_of(spark, d)
    recent = orders(spark, d).where(F.col("order_date") >= F.date_sub(now, 7)).select("order_id", "customer_id", "order_date")
    sold = recent.join(items(spark, d), "order_id").select("order_id", "line_no", "order_date", "customer_id", "product_id", money("revenue"))
    return sold.select(now.alias("snapshot_date"), "*")


def usp_snapshot_recent_orders(spark: SparkSession, d: str) -> DataFrame:
    return vw_recent_orders_star_cte(spark, d).select(as_of(spark, d).alias("snapshot_date"), "*")


def usp_rebuild_recent_sales(spark: SparkSession, d: str) -> DataFrame:
    recent = orders(spark, d).where(F.col("order_date") >= since(spark, d, 14)).select("order_id", "customer_id", "order_date")
    return recent.join(items(spark, d), "order_id").select("order_id", "customer_id", "order_date", "product_id", money("revenue"))


def usp_top_products(spark: SparkSession, d: str) -> DataFrame:
    recent = orders(spark, d).where(F.col("order_date") >= since(spark, d, 30)).select("order_id")
    sums = items(spark, d).join(recent, "order_id", "left_semi").groupBy("product_id").agg(F.sum("quantity").alias("total_quantity"), F.sum("revenue").alias("total_revenue"))
    return sums.orderBy(F.desc("total_revenue"), "product_id").limit(100).withColumn("total_revenue", F.col("total_revenue").cast("double"))


def customer_orders(spark: SparkSession, d: str, low: int | None = None, high: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The inline table function: sales of all customers and dates, or within the bounds given; these reach the scan of orders."""
    own = orders(spark, d)
    for column, least, most in (("customer_id", low, high), ("order_date", start and F.to_date(F.lit(start)), end and F.to_date(F.lit(end)))):
        own = own if least is None else own.where(F.col(column) >= least)
        own = own if most is None else own.where(F.col(column) <= most)
    return own.join(items(spark, d), "order_id").select("order_id", "customer_id", "order_date", "status", "product_id", "quantity", "revenue", F.when(F.col("status").isin(*FULFILLED), 1).otherwise(0).alias("is_fulfilled"))


def fn_customer_orders_inline(spark: SparkSession, d: str) -> DataFrame:
    return customer_orders(spark, d).withColumn("revenue", F.col("revenue").cast("double"))


def fn_customer_orders_mstvf(spark: SparkSession, d: str) -> DataFrame:
    return fn_customer_orders_inline(spark, d).withColumn("days_since_order", F.datediff(as_of(spark, d), "order_date"))


def customer_metrics(spark: SparkSession, d: str, months: int = 12) -> DataFrame:
    """Totals per customer over the last months.

    Lines are summed by customer and product first and orders are counted apart, so no row is expanded for a distinct count.
    """
    now = as_of(spark, d)
    own = orders(spark, d).where(F.col("order_date").between(F.add_months(now, -months), now))
    age = lambda m: F.col("last_order_date") >= F.add_months(now, -m)
    ordered = own.groupBy("customer_id").agg(F.count("order_id").alias("total_orders"), F.max("order_date").alias("last_order_date"), F.min("order_date").alias("first_order_date"))
    by_product = own.select("order_id", "customer_id").join(items(spark, d), "order_id").groupBy("customer_id", "product_id").agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))
    sold = by_product.groupBy("customer_id").agg(F.count("product_id").alias("unique_products"), F.sum("quantity").alias("total_items"), F.sum("revenue").alias("total_revenue"))
    grouped = customers(spark, d).join(ordered, "customer_id").join(sold, "customer_id", "left").withColumn("unique_products", F.coalesce("unique_products", F.lit(0)))
    span = F.datediff("last_order_date", "first_order_date")
    return grouped.where("total_orders > 0").select(
        "customer_id", "customer_name", "segment", "total_orders", "unique_products", "total_items", money("total_revenue"), "last_order_date",
        F.datediff(now, "last_order_date").alias("days_since_last_order"),
        F.when(age(1), "Active").when(age(3), "Recent").when(age(6), "Occasional").otherwise("Inactive").alias("activity"),
        F.when(F.col("total_orders") > 1, F.round(F.col("total_orders") / F.nullif(span.cast("double"), F.lit(0.0)), 6)).otherwise(F.lit(0.0)).alias("orders_per_day"),
    )


def usp_customer_metrics(spark: SparkSession, d: str) -> DataFrame:
    return customer_metrics(spark, d)


def _tiers(spark: SparkSession, d: str, sold: DataFrame) -> DataFrame:
    """The table function's rows joined to the procedure's result, with tiers and each line's share of the customer's revenue."""
    metrics = customer_metrics(spark, d, 120).where(F.col("activity").isin("Active", "Recent", "Occasional"))
    tier = F.when(F.col("total_revenue") >= 1_000_000, "High").when(F.col("total_revenue") >= 500_000, "Medium").otherwise("Standard")
    own = metrics.select("customer_id", "total_revenue", "activity", tier.alias("tier"))
    lines = sold.select("customer_id", "order_id", "product_id", "revenue")
    return lines.join(own, "customer_id").withColumn("percent_of_total", F.round(F.col("revenue") / F.nullif("total_revenue", F.lit(0.0)) * 100, 4))


def demo_tvf_proc(spark: SparkSession, d: str) -> DataFrame:
    return _tiers(spark, d, fn_customer_orders_inline(spark, d))


# data changes, as the state they leave behind


def merge_upsert(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """MERGE: rows of `source` replace those of `target` with the same key, or are added."""
    kept = target.join(source.select(key), key, "left_anti")
    return kept.select(key, *columns).unionByName(source.select(key, *columns))


def q_merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    base = customers(spark, d).select("customer_id", "segment", money("balance"))
    changed = base.where("customer_id % 10 = 0").select("customer_id", F.lit("MERGED").alias("segment"), (F.col("balance") * 2).alias("balance"))
    new = base.where("customer_id % 100 = 1").select((-F.col("customer_id")).alias("customer_id"), F.lit("NEW").alias("segment"), "balance")
    return merge_upsert(base, changed.unionByName(new), "customer_id", ["segment", "balance"])


def q_update_from_join(spark: SparkSession, d: str) -> DataFrame:
    """UPDATE … FROM: orders of customers in debt are put on hold."""
    debt = customers(spark, d).where("balance < 0").select("customer_id", F.lit(True).alias("in_debt"))
    return orders(spark, d).join(debt, "customer_id", "left").select("order_id", "customer_id", F.when(F.col("in_debt"), "H").otherwise(F.col("status")).alias("status"))


def q_update_output_into(spark: SparkSession, d: str) -> DataFrame:
    """What UPDATE … OUTPUT deleted.x, inserted.x INTO an audit table records."""
    return products(spark, d).where("price > 900").select("product_id", F.col("price").alias("old_price"), F.round(F.col("price") * 0.5, 4).alias("new_price"))


def q_delete_output_into(spark: SparkSession, d: str) -> DataFrame:
    """Rows that DELETE … OUTPUT deleted.* moves away: orders without any line of ten units or more."""
    large = items(spark, d).where("quantity >= 10").select("order_id")
    return orders(spark, d).join(large, "order_id", "left_anti")


def q_truncate_insert(spark: SparkSession, d: str) -> DataFrame:
    """TRUNCATE + INSERT: only the new rows are left."""
    return orders(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("orders"), F.max("order_date").alias("last_date"))


# set operations, pivots, subqueries


def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).where("status = 'F'").select("customer_id").intersect(orders(spark, d).where("status = 'O'").select("customer_id"))


def set_except(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("customer_id").exceptAll(orders(spark, d).where("status = 'P'").select("customer_id").distinct()).distinct()


def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    years = orders(spark, d).withColumn("year", F.year("order_date"))
    return years.groupBy("year").pivot("status", ["F", "O", "P"]).agg(F.count(F.lit(1))).select("year", *[F.coalesce(s, F.lit(0)).alias(f"n_{s.lower()}") for s in "FOP"])


def unpivot_measures(spark: SparkSession, d: str) -> DataFrame:
    wide = agg_sales_by_day(spark, d).select("order_date", F.col("total_quantity").cast("double").alias("quantity"), F.col("total_revenue").alias("revenue"))
    return wide.unpivot(["order_date"], ["quantity", "revenue"], "measure", "value")


def semi_join_customers(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).join(orders(spark, d).where("year(order_date) = 1997"), "customer_id", "left_semi").select("customer_id", "customer_name")


def anti_join_parts(spark: SparkSession, d: str) -> DataFrame:
    sold = items(spark, d).where("quantity >= 49").select("product_id")
    return products(spark, d).join(sold, "product_id", "left_anti").select("product_id", "product_name")


def correlated_scalar(spark: SparkSession, d: str) -> DataFrame:
    """Orders later than all others of their customer: the correlated MAX as an aggregate and a join."""
    own = orders(spark, d)
    last = own.groupBy("customer_id").agg(F.max("order_date").alias("order_date"))
    return own.join(last, ["customer_id", "order_date"]).select("order_id", "customer_id", "order_date")



# joins, windows and aggregates that the scripts use besides


def optional(df: DataFrame, **given) -> DataFrame:
    """`(@p IS NULL OR column = @p)` for each parameter: one that is None filters nothing, and the plan has no trace of it."""
    for column, value in given.items():
        df = df if value is None else df.where(F.col(column) == value)
    return df


def optional_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one status; the customer is left open."""
    return optional(orders(spark, d), status="F", customer_id=None)


def cross_join_now(spark: SparkSession, d: str) -> DataFrame:
    """Orders beside one row, the last date."""
    now = orders(spark, d).agg(F.max("order_date").alias("now"))
    return orders(spark, d).crossJoin(F.broadcast(now)).select("order_id", F.datediff("now", "order_date").alias("age_days"))


#: Ranges of balances, from and below.
TIERS = ((None, 0, "debt"), (0, 2500, "low"), (2500, 7500, "middle"), (7500, None, "high"))


def theta_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers joined to the range that holds their balance."""
    tiers = spark.createDataFrame(list(TIERS), "low int, high int, tier string")
    holds = (F.col("low").isNull() | (F.col("balance") >= F.col("low"))) & (F.col("high").isNull() | (F.col("balance") < F.col("high")))
    return customers(spark, d).join(F.broadcast(tiers), holds).select("customer_id", "tier")


def window_frames(spark: SparkSession, d: str) -> DataFrame:
    """NTILE, LEAD, first and last values, and a RANGE frame of days, by customer: one sort serves all but the last."""
    by = Window.partitionBy("customer_id").orderBy("order_date", "order_id")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = Window.partitionBy("customer_id").orderBy("day").rangeBetween(-90, 0)
    own = orders(spark, d).withColumn("day", F.unix_date("order_date"))
    return own.select("order_id", F.ntile(4).over(by).alias("quarter"), F.lead("order_id", 1).over(by).alias("next_order"), F.first("order_id").over(whole).alias("first_order"), F.last("order_id").over(whole).alias("last_order"), F.count(F.lit(1)).over(days).alias("orders_90_days"))


def global_row_number(spark: SparkSession, d: str) -> DataFrame:
    """ROW_NUMBER() OVER (ORDER BY order_id DESC) without a single partition: ids are unique, so it is their rank."""
    return global_rank(orders(spark, d).select("order_id"), "order_id", "row_no")


def order_by_multiple(spark: SparkSession, d: str) -> DataFrame:
    return usp_customer_metrics(spark, d).orderBy(F.desc("total_revenue"), "customer_id")


def agg_text_and_spread(spark: SparkSession, d: str) -> DataFrame:
    """STRING_AGG, STDEV and VAR by nation."""
    own = table(spark, d, "customer")
    return own.groupBy("c_nationkey").agg(
        F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"), F.round(F.stddev_samp("c_acctbal"), 4).alias("spread"), F.round(F.var_samp("c_acctbal"), 2).alias("variance"), F.count(F.lit(1)).alias("customers")
    )
