"""The thirteen queries over ``documents``, ``labels`` and ``embeddings``, and their SQL twins where SQL can say it.

Each query reads whole tables, calls its operator with the parameters of production, and derives the columns of
its contract from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparsetab.llm import (
    exact, language, minhash, mixing, nearest, periodic, pieces, quality, samples, substrings, suffixes, toxicity, variants, vectors as vectors_of,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1


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


def quality_weights(labels: DataFrame) -> DataFrame:
    """Sampling weight by document: 2 for good ones, 0.5 for bad ones."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_labelled")).agg(
        F.when(F.max("quality") >= 1, 2.0).otherwise(0.5).alias("quality"))


@query("op3_mix_sources", r"""
WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix' || chr(1) || coalesce(CAST(doc_id AS VARCHAR), chr(2) || md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS draw FROM documents),
q AS (SELECT doc_id AS labelled, CASE WHEN max(quality) >= 1 THEN 2.0 ELSE 0.5 END AS w FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, -ln((CAST(draw AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE) / CAST(coalesce(w, 1.0) AS DOUBLE) AS key FROM d LEFT JOIN q ON doc_id = labelled),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS ss, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * ss / w AS ratio, sum(ss) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(3.0::DOUBLE * ss) OVER (ORDER BY ratio, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(w) OVER (ORDER BY ratio, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
m AS (SELECT (SELECT lev FROM l WHERE lev * w <= 3.0::DOUBLE * ss ORDER BY ratio, turn LIMIT 1) AS level,
    (SELECT min(ratio) FROM l WHERE lev * w <= 3.0::DOUBLE * ss) AS least),
t AS (SELECT source, ss, CASE WHEN ratio < least OR least IS NULL THEN 3.0::DOUBLE * ss ELSE least(level * w, 3.0::DOUBLE * ss) END AS target FROM l, m),
b AS (SELECT *, CASE WHEN ss > 0 THEN least(floor(target / ss), 3) ELSE 0 END AS whole FROM t),
o AS (SELECT k.doc_id, k.size, b.ss, b.target, b.whole, greatest(b.target - b.whole * b.ss, 0.0::DOUBLE) AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
    FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target,
    CAST(size * (whole + CASE WHEN whole < 3 AND bef + CAST(size AS DOUBLE) / 2 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
""")
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.n_words("text").alias("size"), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("tie"))
    docs = docs.join(quality_weights(table(spark, sf_dir, "labels")), F.col("doc_id") == F.col("_labelled"), "left")
    mixed = mixing.mix(docs.select(F.col("doc_id").alias("row"), "source", "size", "quality", "tie"), tie="tie")
    return mixed.select(F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(samples.labelled(docs, table(spark, sf_dir, "labels"), "quality", 4, 2, quality.ROWS))
    return quality.score(docs, weights).select(
        "doc_id", samples.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.fit(samples.labelled(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, toxicity.ROWS))
    return toxicity.score(docs, weights).select(
        "doc_id", samples.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def spoken(spark: SparkSession, docs: DataFrame) -> language.Model:
    """Language model from the documents of all folds but the one held out."""
    return language.fit(docs, ~samples.held_out("doc_id", 4, 2))


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = spoken(spark, docs)
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", samples.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def encoded(docs: DataFrame) -> DataFrame:
    """``docs(id columns..., text)`` with ``text`` replaced by ``n_pieces``, ``ids`` and whether the ids decode to the text."""
    rows = pieces.encode(docs, pieces.load(VOCABULARY), rate=DROPOUT, seed=1, check=True)
    return rows.select(*[c for c in docs.columns if c != "text"], F.coalesce(F.array_size("ids").cast("bigint"), F.lit(0).cast("bigint")).alias("n_pieces"),
                       "ids", "lossless")


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_embedding_near_dedup", r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0 AND len([e FOR e IN embedding IF e <> 0]) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
t(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
c AS (SELECT a, min(b) AS low FROM t GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.low AS component_id, vec_id = c.low AS kept FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
""")
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), "label")
    return vectors_of.near_duplicates(vectors, 0.93)


@query("op10_top_k", r"""
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.x, c.x)]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), nearest.whole_numbers("embedding", 64.0).alias("x"))
    return nearest.top_k(vectors, F.col("id") % 20 == 0, 20).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op1_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g FROM p),
r AS (SELECT doc_id, i FROM h WHERE g IN (SELECT g FROM h GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS k FROM r),
l AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[k] FOR k IN generate_series(1, len(w)) IF NOT list_contains(gone, k)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_suffix_dedup", r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, CAST(length(x) / 2 - 399 AS BIGINT))) AS i, x FROM d WHERE length(x) >= 800),
h AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 800)) AS g FROM p),
r AS (SELECT doc_id, i FROM h WHERE g IN (SELECT g FROM h GROUP BY g HAVING count(*) > 1)),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM
    (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM r)),
b AS (SELECT doc_id, span, min(i) AS a, max(i) + 399 AS z FROM s GROUP BY doc_id, span),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1 AS f FROM b),
g AS (SELECT doc_id, count(*) AS n, sum(z - a + 1) AS gone, max(z) AS last, string_agg(substr(x, 2 * f - 1, 2 * (a - f)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN n IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
""")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"), keep_first=False).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_minhash_near_dedup", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]]
    ELSE [w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS same FROM s GROUP BY doc_id),
c AS (SELECT same, min(doc_id) AS rep, any_value(n) AS n FROM n GROUP BY same),
r AS (SELECT s.doc_id, s.g, c.n FROM s JOIN c ON s.doc_id = c.rep),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) AS nx, any_value(b.n) AS ny FROM r a JOIN r b
    ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT x, y FROM i WHERE 100 * common >= 80 * (nx + ny - common)),
u AS (SELECT x AS a, y AS b FROM e UNION SELECT y, x FROM e),
t(a, b) AS (SELECT rep, rep FROM c UNION SELECT t.a, u.b FROM t JOIN u ON t.b = u.a),
m AS (SELECT a, min(b) AS low FROM t GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id, d.doc_id = coalesce(m.low, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON n.same = c.same LEFT JOIN m ON m.a = c.rep
""")
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80).drop("text_hash")


@query("op11_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT h, first(doc_id ORDER BY points DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN k USING (h)
""")
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(table(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = periodic.collapse(docs).select("doc_id", "runs", "collapsed", periodic.longest("runs").alias("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_spelling_variants", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{6,}') AS w FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL),
bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT i, c FROM bits WHERE k = 8),
b AS (SELECT word, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word)) AS x FROM o),
crc(word, n, x, i, c) AS (SELECT word, n, x, 0, 4294967295 FROM b
  UNION ALL SELECT word, n, x, crc.i + 1, xor(crc.c // 256, tab.c) FROM crc JOIN tab ON tab.i = xor(crc.c % 256, CAST('0x' || substr(x, 2 * crc.i + 1, 2) AS BIGINT)) WHERE crc.i < length(x) // 2),
h AS (SELECT word, n, xor(c, 4294967295) AS h FROM crc WHERE i = length(x) // 2),
e AS (SELECT CASE WHEN h % 199 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
s AS (SELECT word, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS p FROM v)),
u AS (SELECT DISTINCT a.word AS a, b.word AS b FROM s a JOIN s b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT s.word, v.word FROM s JOIN v ON s.rest = v.word UNION SELECT v.word, s.word FROM s JOIN v ON s.rest = v.word),
f AS (SELECT u.a AS word, count(*) AS n_near, first(u.b ORDER BY vb.n DESC, u.b) AS best, max(vb.n) AS best_n FROM u JOIN v vb ON vb.word = u.b GROUP BY u.a),
g AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN f USING (word)),
c(word, here, form) AS (SELECT word, word, form FROM g UNION ALL SELECT c.word, g.word, g.form FROM c JOIN g ON g.word = c.form)
SELECT g.word, g.form, c.here AS root, g.n, g.n_near, g.form_n FROM g JOIN c ON c.word = g.word AND c.form IS NULL
""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = variants.counted(table(spark, sf_dir, "documents"), changed=199)
    return variants.group(counts, times=5).select("word", "form", "root", "n", "n_near", "form_n")
