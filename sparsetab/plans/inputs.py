"""Input tables of the registered queries, in Spark and as SQL text.

Matrix: ``embeddings`` with one row per vector; class +1 for labels below 5.
Graph: parts joined by the orders that hold both, a problem per month.  Trials: ``events`` with the event type as method and the day as ``n``.
Every input covers its whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparsetab.lineage import shared_dir
from sparsetab.operators.relational import attach_row, dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, if there is one, its SQL twin."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def r6(column, name: str):
    return F.round(column, 6).alias(name)


# -- matrix ----------------------------------------------------------------------

def class_cuts(*cuts: int):
    """One problem per class cut: labels below the cut are the positive class."""
    return F.posexplode(F.array(*[F.lit(c) for c in cuts]))


def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", "label", class_cuts(5).alias("problem", "cut")).select(
        F.col("problem").cast("long").alias("problem_id"), F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("label") < F.col("cut"), 1.0).otherwise(-1.0).alias("y"),
    )


def label_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One problem per label: its vectors against all others."""
    rows = table(spark, sf_dir, "embeddings")
    labels = rows.agg(F.array_sort(F.collect_set(F.col("label").cast("long"))).alias("labels"))
    return attach_row(rows, labels).select(
        F.explode("labels").alias("problem_id"), F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("x"), "label",
    ).withColumn("y", F.when(F.col("label") == F.col("problem_id"), 1.0).otherwise(-1.0)).drop("label")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("col_id", "value"))


def response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_rows(spark, sf_dir).select("row_id", "y")


CELLS = """cells AS (SELECT vec_id AS row_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS col_id,
  CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
resp AS (SELECT vec_id AS row_id, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM embeddings)"""

# -- graph -----------------------------------------------------------------------

def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought in one order, a problem for each month; an order of many parts is a clique, so there are cycles.

    The cost of an edge is the least quantity that either part was bought in; an
    order has at most a handful of lines, so the pairs of an order are few.
    """
    line, order = (table(spark, sf_dir, t) for t in ("lineitem", "orders"))
    lines, orders = line.count(), order.count()  # from the footers of the files
    month = (12 * F.year(F.to_date("o_orderdate")) + F.month(F.to_date("o_orderdate"))).cast("long").alias("problem_id")
    line = dealt(line.select("l_orderkey", "l_partkey", "l_quantity"), lines, "l_orderkey")
    here, there = (line.select(*[F.col(f"l_{c}").alias(f"{side}_{c}") for c in ("orderkey", "partkey", "quantity")]) for side in "ab")
    # both sides of the pairs read one shuffle of the lines
    pairs = here.join(dealt(order.select("o_orderkey", month), lines, "o_orderkey"), F.col("a_orderkey") == F.col("o_orderkey")).join(
        there, (F.col("a_orderkey") == F.col("b_orderkey")) & (F.col("a_partkey") < F.col("b_partkey")))
    # pairs seldom repeat, so they are told apart once, after the shuffle; the least of structs comes by a sort, which holds less than two hash tables
    found = pairs.select("problem_id", (F.col("a_partkey") * 2).alias("src"), (F.col("b_partkey") * 2).alias("dst"), F.struct(F.least("a_quantity", "b_quantity").alias("cost")).alias("_m"))
    many = lines * lines // max(orders, 1)  # a line is paired with the others of its order
    least = dealt(found.repartition("problem_id", "src", "dst"), many, "problem_id", "src", "dst").groupBy("problem_id", "src", "dst").agg(F.min("_m").alias("_m"))
    return least.select("problem_id", "src", "dst", "_m.cost")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prize of a node: value of its lines in that month, in units of 1000; parts bought alone are nodes without an edge."""
    line, order = (table(spark, sf_dir, t) for t in ("lineitem", "orders"))
    lines, day = line.count(), F.to_date("o_orderdate")
    line = dealt(line.select("l_orderkey", "l_partkey", "l_extendedprice"), lines, "l_orderkey")
    order = dealt(order.select("o_orderkey", (12 * F.year(day) + F.month(day)).cast("long").alias("problem_id")), lines, "o_orderkey")
    bought = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select("problem_id", (F.col("l_partkey") * 2).alias("node"), "l_extendedprice")
    sums = dealt(bought, lines, "problem_id", "node").groupBy("problem_id", "node")
    return sums.agg((F.sum("l_extendedprice") / 1000).alias("prize"))


EDGES = """bought AS (SELECT CAST(12 * year(CAST(o_orderdate AS DATE)) + month(CAST(o_orderdate AS DATE)) AS BIGINT) AS problem_id, l_orderkey, 2 * l_partkey AS node,
  l_quantity, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pz AS (SELECT problem_id, node, sum(l_extendedprice) / 1000 AS prize FROM bought GROUP BY 1, 2),
edges AS (SELECT a.problem_id, a.node AS src, b.node AS dst, min(least(a.l_quantity, b.l_quantity)) AS cost
  FROM bought a JOIN bought b ON a.l_orderkey = b.l_orderkey AND a.node < b.node GROUP BY ALL),
both_ends AS (SELECT problem_id, src AS a, dst AS b, cost FROM edges UNION ALL SELECT problem_id, dst, src, cost FROM edges)"""

COMPONENTS = EDGES + """,
reach(problem_id, node, other) AS (SELECT DISTINCT problem_id, a, a FROM both_ends
  UNION SELECT r.problem_id, r.node, e.b FROM reach r JOIN both_ends e ON e.problem_id = r.problem_id AND e.a = r.other),
comps AS (SELECT problem_id, node, min(other) AS comp, count(*) AS size FROM reach GROUP BY problem_id, node)"""

# -- trials ----------------------------------------------------------------------

def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trial"), F.col("event_type").alias("method"), F.dayofmonth("ts").alias("n"),
        F.col("user_id").alias("user_id"), F.col("value").alias("err"))


TRIALS = """trials AS (SELECT event_id AS trial, event_type AS method, CAST(day(ts) AS INTEGER) AS n, user_id, value AS err FROM events)"""

TRIMMED = TRIALS + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY method, n ORDER BY err, trial) AS rn,
  count(*) OVER (PARTITION BY method, n) AS cnt FROM trials),
kept AS (SELECT * FROM placed WHERE rn > round(0.05 * cnt) AND rn <= cnt - round(0.05 * cnt))"""

# -- scored rows -------------------------------------------------------------------

def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of a vector: its first coordinate rounded to one digit, so that scores tie."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", class_cuts(5).alias("k", "cut")).select(
        "k", F.col("vec_id").alias("row_id"), F.round(F.col("embedding")[0].cast("double"), 1).alias("score"),
        F.when(F.col("label") < F.col("cut"), 1).otherwise(-1).alias("y"))


SCORED = """scored AS (SELECT vec_id AS row_id, round(CAST(embedding[1] AS DOUBLE), 1) AS score,
  CASE WHEN label < 5 THEN 1 ELSE -1 END AS y FROM embeddings)"""


def small_weights(name: str = "w"):
    """Fixed weights by column: 0.01, -0.01, 0.01, ..."""
    return F.when(F.col("col_id") % 2 == 0, 0.01).otherwise(-0.01).alias(name)
