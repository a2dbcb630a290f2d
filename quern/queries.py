"""Named queries over the engine's operators, and the SQL that each of them equals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import LoadError
from quern.functions.predicates import between, equals, float_value, greater_than, int_value, less_than
from quern.model import Table
from quern.operators.cache import ResultCache
from quern.operators.results import Result
from quern.plans.query import Query
from quern.sources.delimited import read_csv
from quern.sources.generate import prices, sales, write_csv
from quern.sources.tables import from_dataframe, from_parquet

Run = Callable[[SparkSession, str], DataFrame]
_RUNS: dict[str, Run] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        _RUNS[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return from_parquet(spark, f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Sums and averages of doubles depend on the order of rows in their last digits."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@_query(
    "flagship_multidim",
    """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS price_sum,
       CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber_sum, round(avg(l_discount), 6) AS discount_avg, count(l_quantity) AS l_quantity_count
       FROM lineitem WHERE l_quantity BETWEEN 5.0 AND 30.0 GROUP BY ALL""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = (
        _table(spark, sf_dir, "lineitem").query().where("l_quantity", between(5.0, 30.0)).group_by("l_returnflag", "l_linestatus")
        .aggregate("l_extendedprice", "sum", "price_sum").aggregate("l_linenumber", "sum")
        .aggregate("l_discount", "avg", "discount_avg").aggregate("l_quantity", "count")
    )
    return _rounded(query.to_df(), price_sum=2, discount_avg=6)


def _filters() -> None:
    orders = {
        "filter_eq_int": ("o_custkey", equals(370), "o_custkey = 370"),
        "filter_gt_int": ("o_custkey", greater_than(700), "o_custkey > 700"),
        "filter_lt_int": ("o_custkey", less_than(100), "o_custkey < 100"),
        "filter_between_int": ("o_custkey", between(100, 200), "o_custkey BETWEEN 100 AND 200"),
        "filter_gt_float": ("o_totalprice", greater_than(300000.0), "o_totalprice > 300000.0"),
        "filter_lt_float": ("o_totalprice", less_than(50000.0), "o_totalprice < 50000.0"),
        "filter_between_float": ("o_totalprice", between(100000.0, 120000.0), "o_totalprice BETWEEN 100000.0 AND 120000.0"),
        "filter_type_mismatch": ("o_totalprice", greater_than(int_value(0)), "false"),
        "filter_nan_literal": ("o_totalprice", less_than(float_value(float("nan"))), "false"),
    }
    for name, (column, predicate, sql) in orders.items():
        run = lambda spark, d, c=column, p=predicate: _table(spark, d, "orders").filter(c, p)
        _query(name, f"SELECT o_orderkey AS row_index FROM orders WHERE {sql}")(run)
    for op, sql in (("=", "= 'error'"), (">", "> 'purchase'"), ("<", "< 'error'")):
        name = {"=": "filter_eq_str", ">": "filter_gt_str", "<": "filter_lt_str"}[op]
        run = lambda spark, d, o=op, v=sql.split("'")[1]: _table(spark, d, "events").query().where("event_type", o, v).to_df()
        _query(name, f"SELECT event_id AS row_index FROM events WHERE event_type {sql}")(run)


_filters()


@_query("filter_eq_float", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_quantity = 25.0")
def filter_eq_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").query().where("l_quantity", equals(25.0)).select("l_orderkey", "l_linenumber").to_df()


@_query(
    "filter_conjunction",
    """SELECT o_orderkey AS row_index FROM orders WHERE o_totalprice BETWEEN 100000.0 AND 300000.0 AND o_orderstatus = 'O'
       AND o_orderpriority = '1-URGENT'""",
)
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = [("o_totalprice", between(100000.0, 300000.0)), ("o_orderstatus", equals("O")), ("o_orderpriority", equals("1-URGENT"))]
    return _table(spark, sf_dir, "orders").query().filters(conditions).to_df()


@_query(
    "filter_between_str",
    """SELECT event_type, count(value) AS value_count FROM events
       WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-15' GROUP BY event_type""",
)
def filter_between_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return from_dataframe(events).query().where("day", between("2024-01-05", "2024-01-15")).group_by("event_type").aggregate("value", "count").to_df()


def _measure(op: str, column: str, whole: bool) -> tuple[str, int | None]:
    """SQL of an aggregate, and the digits it is rounded to."""
    if op == "avg":
        return f"round(avg({column}), 6)", 6
    if op == "sum":
        return (f"CAST(sum({column}) AS BIGINT)", None) if whole else (f"round(sum({column}), 2)", 2)
    if whole and op in ("min", "max"):
        return f"CAST({op}({column}) AS BIGINT)", None
    return f"{op}({column})", None


def _aggregates() -> None:
    plain = [("agg", "{}_int", "orders", "o_custkey", True), ("agg", "{}_float", "orders", "o_totalprice", False)]
    grouped = [
        ("{}_int", "part", "p_brand", "p_size", True),
        ("{}_float", "orders", "o_orderstatus", "o_totalprice", False),
    ]
    for op in ("sum", "count", "avg", "min", "max"):
        for _, name, table, column, whole in plain:
            sql, digits = _measure(op, column, whole)

            def run(spark, d, t=table, c=column, o=op, n=digits):
                out = _table(spark, d, t).query().aggregate(c, o).to_df()
                return out if n is None else _rounded(out, **{f"{c}_{o}": n})

            _query(f"agg_{name.format(op)}", f"SELECT {sql} AS {column}_{op} FROM {table}")(run)
        for column, table, where, whole in (("value", "events", "event_type = 'error'", False), ("user_id", "events", "event_type = 'error'", True)):
            sql, digits = _measure(op, column, whole)

            def run(spark, d, t=table, c=column, o=op, n=digits):
                out = _table(spark, d, t).query().where("event_type", equals("error")).aggregate(c, o, "out").to_df()
                return out if n is None else _rounded(out, out=n)

            _query(f"agg_filtered_{op}_{'int' if whole else 'float'}", f"SELECT {sql} AS out FROM {table} WHERE {where}")(run)
        for name, table, key, column, whole in grouped:
            sql, digits = _measure(op, column, whole)

            def run(spark, d, t=table, k=key, c=column, o=op, n=digits):
                out = _table(spark, d, t).group_by(k, c, o)
                return out if n is None else _rounded(out, **{f"{c}_{o}": n})

            _query(f"group_{name.format(op)}", f"SELECT {key}, {sql} AS {column}_{op} FROM {table} GROUP BY {key}")(run)


_aggregates()


@_query(
    "agg_multi",
    """SELECT min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, count(o_custkey) AS o_custkey_count,
       round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders""",
)
def agg_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = [("o_totalprice", "min"), ("o_totalprice", "max"), ("o_custkey", "count"), ("o_totalprice", "sum")]
    return _rounded(_table(spark, sf_dir, "orders").query().aggregates(measures).to_df(), o_totalprice_sum=2)


@_query("agg_empty", "SELECT sum(o_totalprice) AS o_totalprice_sum, count(o_custkey) AS o_custkey_count FROM orders WHERE o_custkey < -1")
def agg_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _table(spark, sf_dir, "orders").query().where("o_custkey", "<", -1)
    return query.aggregates([("o_totalprice", "sum"), ("o_custkey", "count")]).to_df()


@_query("group_filtered", "SELECT event_type, round(sum(value), 2) AS value_sum FROM events WHERE value > 100.0 GROUP BY event_type")
def group_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _table(spark, sf_dir, "events").query().where("value", greater_than(100.0)).group_by("event_type").aggregate("value", "sum")
    return _rounded(query.to_df(), value_sum=2)


@_query("group_filtered_empty", "SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS o_custkey_sum FROM orders WHERE false GROUP BY o_orderstatus")
def group_filtered_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _table(spark, sf_dir, "orders").query().where("o_totalprice", equals(int_value(1)))
    return query.group_by("o_orderstatus").aggregate("o_custkey", "sum").to_df()


@_query(
    "group_multi_agg",
    """SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most
       FROM customer GROUP BY c_mktsegment""",
)
def group_multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = [("c_acctbal", "count", "n"), ("c_acctbal", "avg", "mean"), ("c_acctbal", "min", "least"), ("c_acctbal", "max", "most")]
    return _rounded(_table(spark, sf_dir, "customer").query().group_by("c_mktsegment").aggregates(measures).to_df(), mean=6)


@_query(
    "multidim_three_keys",
    """SELECT l_returnflag, l_linestatus, strftime(l_shipdate, '%Y') AS ship_year, round(sum(l_quantity), 2) AS l_quantity_sum,
       count(l_orderkey) AS l_orderkey_count FROM lineitem GROUP BY ALL""",
)
def multidim_three_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ship_year", F.date_format("l_shipdate", "yyyy"))
    query = from_dataframe(items).query().group_by("l_returnflag", "l_linestatus").group_by("ship_year")
    return _rounded(query.aggregates([("l_quantity", "sum"), ("l_orderkey", "count")]).to_df(), l_quantity_sum=2)


@_query("group_numeric_key", "SELECT CAST(p_size AS BIGINT) AS p_size, count(p_partkey) AS p_partkey_count FROM part GROUP BY p_size")
def group_numeric_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").query().group_by("p_size", allow_any_key=True).aggregate("p_partkey", "count").to_df()


@_query("group_limit", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS p_size_sum FROM part GROUP BY p_brand ORDER BY p_brand LIMIT 5")
def group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").query().group_by("p_brand").aggregate("p_size", "sum").limit(5).to_df()


@_query("select_filtered", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def select_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _table(spark, sf_dir, "events").query().where("event_type", equals("purchase"))
    return query.select("ts").select("event_id", "user_id", "value").to_df()


@_query("select_limit", "SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 10")
def select_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").query().where("event_type", equals("error")).select("event_id", "value").limit(10).to_df()


@_query("row_index_limit", "SELECT o_orderkey AS row_index FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 7")
def row_index_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").query().where("o_orderstatus", equals("P")).limit(7).to_df()


@_query("row_index_dataframe", "SELECT o_orderkey AS row_index FROM orders WHERE o_orderstatus = 'F'")
def row_index_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_dataframe(spark.read.parquet(f"{sf_dir}/orders.parquet")).filter("o_orderstatus", equals("F"))


@_query("aliased_aggregate", "SELECT round(avg(o_totalprice), 6) AS mean_price, count(o_orderkey) AS orders FROM orders WHERE o_orderstatus = 'F'")
def aliased_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _table(spark, sf_dir, "orders").query().where("o_orderstatus", equals("F"))
    return _rounded(query.aggregate("o_totalprice", "AVG", "mean_price").aggregate("o_orderkey", "count", "orders").to_df(), mean_price=6)


@_query("cached_repeat", "SELECT CAST(sum(o_custkey) AS BIGINT) AS first, CAST(sum(o_custkey) AS BIGINT) AS second, 1 AS hits FROM orders")
def cached_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, cache = _table(spark, sf_dir, "orders"), ResultCache()
    one, two = (table.query(cache).aggregate("o_custkey", "sum").execute().value for _ in range(2))
    return spark.createDataFrame([(one, two, cache.hits)], "first bigint, second bigint, hits int")


@_query("cached_filter", "SELECT o_orderstatus, count(o_custkey) AS o_custkey_count FROM orders WHERE o_totalprice > 250000.0 GROUP BY o_orderstatus")
def cached_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _table(spark, sf_dir, "orders").query(ResultCache(persist_filters=True)).where("o_totalprice", greater_than(250000.0))
    query.aggregate("o_custkey", "count").execute()
    counted = query.group_by("o_orderstatus").aggregate("o_custkey", "count").execute().value
    query.cache.clear()  # what it persisted goes
    return spark.createDataFrame(list(counted.items()), "o_orderstatus string, o_custkey_count bigint")


def _twice(query: Query) -> tuple[Result, int]:
    """A result that was asked for twice, and how often the cache had it."""
    query.execute()
    return query.execute(), query.cache.hits


@_query(
    "cached_group_by",
    "SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS o_custkey_sum, 1 AS hits FROM orders WHERE o_totalprice > 100000.0 GROUP BY o_orderstatus",
)
def cached_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _table(spark, sf_dir, "orders").query(ResultCache()).where("o_totalprice", greater_than(100000.0))
    got, hits = _twice(query.group_by("o_orderstatus").aggregate("o_custkey", "sum"))
    return spark.createDataFrame([(key, n, hits) for key, n in got.value.items()], "o_orderstatus string, o_custkey_sum bigint, hits int")


@_query(
    "cached_group_by_keys",
    """SELECT o_orderstatus, o_orderpriority, CAST(sum(o_custkey) AS BIGINT) AS total, max(o_totalprice) AS most, 1 AS hits
       FROM orders GROUP BY o_orderstatus, o_orderpriority""",
)
def cached_group_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _table(spark, sf_dir, "orders").query(ResultCache()).group_by("o_orderstatus", "o_orderpriority")
    got, hits = _twice(query.aggregates([("o_custkey", "sum", "total"), ("o_totalprice", "max", "most")]))
    rows = [(*keys, of["total"], of["most"], hits) for keys, of in got.value.items()]
    return spark.createDataFrame(rows, "o_orderstatus string, o_orderpriority string, total bigint, most double, hits int")


@_query(
    "cached_multi_aggregate",
    "SELECT min(o_totalprice) AS least, max(o_totalprice) AS most, count(o_custkey) AS n, 1 AS hits FROM orders WHERE o_orderstatus = 'F'",
)
def cached_multi_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _table(spark, sf_dir, "orders").query(ResultCache()).where("o_orderstatus", equals("F"))
    got, hits = _twice(query.aggregates([("o_totalprice", "min", "least"), ("o_totalprice", "max", "most"), ("o_custkey", "count", "n")]))
    return spark.createDataFrame([(got.value["least"], got.value["most"], got.value["n"], hits)], "least double, most double, n bigint, hits int")


@_query("cached_select", "SELECT event_id AS row_index, event_type, value, 1 AS hits FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20")
def cached_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _table(spark, sf_dir, "events").query(ResultCache()).where("event_type", equals("error"))
    got, hits = _twice(query.select("event_type", "value").limit(20))
    rows = [(at, kind, value, hits) for at, kind, value in zip(got.rows, got.value["event_type"], got.value["value"])]
    return spark.createDataFrame(rows, "row_index bigint, event_type string, value double, hits int")


def _folder(spark: SparkSession) -> str:
    """A new folder that all machines share; only a session on one machine can do without a named one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise LoadError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or tempfile.gettempdir()
    path = f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


@_query("csv_roundtrip_group", "SELECT p_type, CAST(sum(p_size) AS BIGINT) AS p_size_sum FROM part GROUP BY p_type")
def csv_roundtrip_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    write_csv(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_size", "p_retailprice"), path)
    table, _ = read_csv(spark, path)
    return table.group_by("p_type", "p_size", "sum")


@_query("csv_parse_errors", "SELECT * FROM (VALUES (3, '', 'Expected 2 fields, got 1', NULL), (4, 'v', 'x', 'not a bigint')) t(row, \"column\", value, error)")
def csv_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    lines = spark.createDataFrame([("k,v\nA,1\nB\nC,x\n\nD,4",)], "value string").coalesce(1)
    lines.write.text(path)
    return read_csv(spark, path)[1].errors.select(F.col("row").cast("int").alias("row"), "column", "value", "error")


@_query("generate_sales", "SELECT 1000 AS rows, 0 AS least_id, 999 AS most_id, 4 AS categories, 6 AS regions, true AS in_range")
def generate_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, 1000).agg(
        F.count("*").cast("int").alias("rows"), F.min("id").cast("int").alias("least_id"), F.max("id").cast("int").alias("most_id"),
        F.countDistinct("category").cast("int").alias("categories"), F.countDistinct("region").cast("int").alias("regions"),
        F.bool_and(F.col("value").between(1, 999)).alias("in_range"),
    )


@_query(
    "generate_prices",
    """SELECT 'cat_' || (i % 100) AS category, CAST(sum(10 * i) AS BIGINT) AS value_sum, round(sum(1.5::DOUBLE * i), 2) AS price_sum
       FROM range(1000) t(i) GROUP BY ALL""",
)
def generate_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prices(spark, 1000).withColumn("price", F.col("price").cast("double"))
    query = from_dataframe(made).query().group_by("category").aggregates([("value", "sum"), ("price", "sum")])
    return _rounded(query.to_df(), price_sum=2)


@_query("arrow_export", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def arrow_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_table(spark, sf_dir, "region").to_arrow())


def queries() -> dict[str, Run]:
    return dict(_RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
