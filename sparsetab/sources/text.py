"""Delimited and tagged text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparsetab.functions.scalar import fixed
from sparsetab.operators.relational import attach_row

QUOTE = "|"


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], numeric: Sequence[str] = (), sep: str = "\t") -> DataFrame:
    """S1. Delimited text without its header lines.

    A header is told by content, not by position: it has no number where the
    ``numeric`` columns expect one.  Splits of a large file can thus be read
    independently.
    """
    raw = spark.read.csv(path, sep=sep, quote=QUOTE, schema=", ".join(f"`{c}` string" for c in columns))
    for name in numeric:
        raw = raw.withColumn(name, F.expr(f"try_cast(`{name}` as double)"))
    return raw.dropna(subset=list(numeric)) if numeric else raw


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """S2. One-based pairs to zero-based edges of unit cost."""
    pairs = read_delimited(spark, path, ["src", "dst"], ["src", "dst"])
    return pairs.select(
        (F.col("src").cast("long") - 1).alias("src"), (F.col("dst").cast("long") - 1).alias("dst"), F.lit(1.0).alias("cost")
    )


def read_mapping(spark: SparkSession, path: str, key: str = "pathway_id", value: str = "entrez") -> DataFrame:
    """S3. Two-column mapping in long form."""
    pairs = read_delimited(spark, path, [key, value], [key, value])
    return pairs.select(F.col(key).cast("long").alias(key), F.col(value).cast("long").alias(value))


def read_gene_names(spark: SparkSession, path: str, ids: str, names: str, columns: Sequence[str]) -> DataFrame:
    """F3. Names of every id in file order: several ids by comma, several names by blank."""
    raw = read_delimited(spark, path, columns)
    ids_of = F.filter(F.split(ids, ","), lambda i: F.length(i) > 0)
    parts = raw.select(F.explode(ids_of).alias("_id"), F.posexplode(F.filter(F.split(names, " "), lambda n: F.length(n) > 0)).alias("pos", "name"))
    return parts.select(F.expr("try_cast(trim(_id) as long)").alias("entrez"), "name", "pos").dropna(subset=["entrez"])


def read_tagged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S4. Tagged lines as three tables: rows, edges and node values.

    Lines are ``x_tr v1 .. vp y``, ``E u v cost`` and ``N node value``.
    """
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    numbers = F.transform(F.slice("p", 2, F.size("p") - 2), lambda v: v.cast("double"))
    rows = parts.filter(F.get("p", F.lit(0)) == "x_tr").select(numbers.alias("x"), F.element_at("p", -1).cast("double").alias("y"))
    at = lambda i, kind: F.get("p", F.lit(i)).cast(kind)
    edges = parts.filter(F.get("p", F.lit(0)) == "E").select(
        at(1, "long").alias("src"), at(2, "long").alias("dst"), at(3, "double").alias("cost")
    )
    nodes = parts.filter(F.get("p", F.lit(0)) == "N").select(at(1, "long").alias("node"), at(2, "double").alias("value"))
    return rows, edges, nodes


def tagged_lines(rows: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """S5. The lines ``read_tagged`` reads, numbers with 8 decimals."""
    sizes = attach_row(rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p")), edges.agg(F.count(F.lit(1)).alias("m")))
    head = sizes.select(F.format_string("P %d %d %d", "n", "p", "m").alias("value"))
    xs = F.array_join(F.transform("x", lambda v: fixed(v)), " ")
    return (
        head.unionByName(rows.select(F.concat(F.lit("x_tr "), xs, F.lit(" "), F.col("y").cast("string")).alias("value")))
        .unionByName(edges.select(F.concat(F.format_string("E %d %d ", "src", "dst"), fixed(F.col("cost"))).alias("value")))
        .unionByName(nodes.select(F.concat(F.format_string("N %d ", "node"), fixed(F.col("value"))).alias("value")))
    )


def write_tagged(rows: DataFrame, edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """S5."""
    tagged_lines(rows, edges, nodes).write.mode("overwrite").text(path)


def network_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """S6. A network as text: node lines first, then ``a pp b`` for every edge."""
    names = nodes.select(F.lit(0).alias("part"), F.col("node").cast("string").alias("value"))
    links = edges.select(F.lit(1).alias("part"), F.concat_ws(" pp ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    return names.unionByName(links)


def write_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """S6. Node lines go to the first files, edge lines to the last ones.

    The hash of the line only spreads either kind over many tasks.
    """
    network_lines(nodes, edges).sort("part", F.xxhash64("value")).select("value").write.mode("overwrite").text(path)


def read_sample_blocks(spark: SparkSession, path: str, offsets: DataFrame, measures: Sequence[str], sep: str = "\t") -> DataFrame:
    """S7, M14. Files of successive samples as one long table.

    A line holds substance, gene and the measures of one sample after another.
    ``offsets(file_path, offset)`` gives the number of the first sample of each
    file.  Header lines have no number in the third field.
    """
    size = len(measures)
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.split("value", sep).alias("p"))
    body = raw.filter(F.expr("try_cast(get(p, 2) as double) is not null")).join(offsets, "file_path")
    sample = F.sequence(F.lit(0), F.floor((F.size("p") - 2) / size).cast("int") - 1)
    lines = body.withColumn("_s", F.explode(sample))
    values = [F.expr(f"try_cast(get(p, 2 + _s * {size} + {i}) as double)").alias(m) for i, m in enumerate(measures)]
    return lines.select(
        F.get("p", F.lit(0)).alias("substance"), F.get("p", F.lit(1)).alias("gene"), (F.col("_s") + F.col("offset")).cast("int").alias("sample_id"), *values
    )
