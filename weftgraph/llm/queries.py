"""Queries of the llm problems (p2, p4 to p8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.vertexkey import code_text, coded, once, plain, plain_key, sql_key
from weftgraph.llm.components import components
from weftgraph.llm.copies import canonical, mark_copies
from weftgraph.llm.leaks import find_leaks
from weftgraph.llm.neighbours import exact_nearest, nearest, neighbour_pairs
from weftgraph.llm.packing import pack_documents, packing_checks
from weftgraph.llm.sentences import sentence_units
from weftgraph.plans.tables import table
from weftgraph.session import written


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vertex key with the smallest key of its group."""
    codes = coded(table(spark, sf_dir, "test_tsv"), {"a": F.col("c0"), "b": F.col("c1")})
    return components(codes, "a", "b").select(code_text(F.col("group")).alias("group_vkey"), code_text(F.col("v")).alias("vkey"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vertices of which at least one is among the five most similar to the other."""
    return neighbour_pairs(nearest(table(spark, sf_dir, "vertex_data"), "vid", "factor", 20, 5))


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the vertices whose vid is divisible by 50: their number, and whether at least 0.95 of their five most similar vertices
    by brute force are found."""
    vectors = table(spark, sf_dir, "vertex_data")
    asked = F.pmod("vid", F.lit(50)) == 0
    exact = exact_nearest(vectors, asked, "vid", "factor", 20, 5).select("vid", "other")
    found = nearest(vectors, "vid", "factor", 20, 5).filter(asked).select("vid", "other", F.lit(1).alias("hit"))
    both = exact.join(found, ["vid", "other"], "left")
    return both.agg(F.countDistinct("vid").alias("n_queries"), (F.count("hit") >= 0.95 * F.count("*")).alias("recall_enough"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with units, and whether units begin at a character that isn't white space and the first one begins the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    units = p8_found(spark, sf_dir).groupBy("doc_id").agg(F.min("start_pos").alias("first"), F.count("*").alias("n"), F.countDistinct("start_pos").alias("places"), F.collect_list("start_pos").alias("starts"))
    joined = docs.join(units, "doc_id")
    blank = lambda c: c.rlike(r"^[\s\p{IsWhite_Space}\x1c-\x1f]*$")
    begins = F.exists("starts", lambda p: blank(F.substring("text", p + 1, F.lit(1))))
    head = blank(F.substring("text", F.lit(1), F.col("first")))
    return joined.agg(F.count("*").alias("n_documents"), F.bool_and(head & ~begins & (F.col("n") == F.col("places"))).alias("well_placed"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record is usable if both fields are vertex keys; its canonical text has the fields in order."""
    rows = table(spark, sf_dir, "test_tsv").select("row_id", "c0", "c1")
    rows = once(rows, {"p0": plain(F.col("c0")), "p1": plain(F.col("c1"))})
    usable = plain_key(F.col("p0")).isNotNull() & plain_key(F.col("p1")).isNotNull()
    return mark_copies(rows, "row_id", F.when(usable, canonical("p0", "p1")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat an earlier row's record, with the first row of that record."""
    return _marked(spark, sf_dir).filter("row_id <> first_row_id").select("first_row_id", F.col("row_id").alias("copy_row_id"))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with the number of its copies."""
    return _marked(spark, sf_dir).filter("row_id = first_row_id").select("first_row_id", "n_copies")


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document with text lies in containers of 2,048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing."""
    return packing_checks(written(p6_packing(spark, sf_dir), "packing"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a run of at least 40 letters and digits with an evaluation item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked, each with the number of documents that contain it in whole or in part."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sentence units of every document begin."""
    return sentence_units(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_recall, p5_found, p5_records, p6_packing, p6_checks, p7_found, p7_leaked_items, p8_found, p8_checks)}

_PAIRS = f"keyed AS (SELECT row_id, {sql_key('c0')} AS a, {sql_key('c1')} AS b FROM test_tsv), pairs AS (SELECT row_id, least(a, b) AS a, greatest(a, b) AS b FROM keyed WHERE a IS NOT NULL AND b IS NOT NULL)"

_GRAMS = """items AS (SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS t FROM eval_items WHERE text IS NOT NULL),
docs AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
item_grams AS (SELECT DISTINCT item_id, substr(t, k, 40) AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - 38)) AS k FROM items WHERE length(t) >= 40)),
doc_grams AS (SELECT doc_id, substr(t, k, 40) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 38)) AS k FROM docs WHERE length(t) >= 40)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM doc_grams JOIN item_grams USING (g))"""

_USABLE = "len(factor) = 20 AND list_bool_and(list_transform(factor, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(factor, lambda x: x <> 0))"
_HAS_TEXT = r"regexp_matches(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{2028}\x{2029}\p{Zs}]')"


def _groups_sql(rounds: int) -> str:
    """Minimum labels with hooking and jumping; the rounds are enough for chains of some thousand links."""
    keyed = f"keyed AS MATERIALIZED (SELECT {sql_key('c0')} AS a, {sql_key('c1')} AS b FROM test_tsv)"
    near = "near AS MATERIALIZED (SELECT DISTINCT a, b FROM keyed WHERE a <> b UNION SELECT b, a FROM keyed WHERE a <> b)"
    steps = ["g0 AS MATERIALIZED (SELECT a AS v, a AS l FROM keyed WHERE a IS NOT NULL UNION SELECT b, b FROM keyed WHERE b IS NOT NULL)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"n{k} AS MATERIALIZED (SELECT x.v, x.l, least(x.l, m) AS n FROM g{k - 1} x LEFT JOIN (SELECT a, min(l) AS m FROM near JOIN g{k - 1} ON v = b GROUP BY a) ON a = x.v), "
            f"h{k} AS MATERIALIZED (SELECT l AS h, min(n) AS hn FROM n{k} WHERE n < l GROUP BY l), "
            f"j{k} AS MATERIALIZED (SELECT v, least(n, hn) AS n FROM n{k} LEFT JOIN h{k} ON h = v), "
            f"g{k} AS MATERIALIZED (SELECT x.v, least(x.n, y.n) AS l FROM j{k} x LEFT JOIN j{k} y ON y.v = x.n)"
        )
    return f"WITH {keyed}, {near}, {', '.join(steps)} SELECT l AS group_vkey, v AS vkey FROM g{rounds}"


ORACLES = {
    "p2_found": _groups_sql(16),
    "p4_recall": f"SELECT count(*) AS n_queries, TRUE AS recall_enough FROM vertex_data WHERE vid % 50 = 0 AND {_USABLE}",
    "p8_checks": f"SELECT count(*) AS n_documents, TRUE AS well_placed FROM documents WHERE {_HAS_TEXT}",
    "p6_checks": r"SELECT count(DISTINCT doc_id) AS n_documents, TRUE AS whole_and_once, TRUE AS none_overfull, TRUE AS near_the_least FROM documents WHERE regexp_matches(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{2028}\x{2029}\p{Zs}]')",
    "p7_found": f"WITH {_GRAMS} SELECT doc_id, item_id FROM leaks",
    "p7_leaked_items": f"WITH {_GRAMS} SELECT item_id, count(*) AS n_documents FROM leaks GROUP BY item_id",
    "p5_found": f"WITH {_PAIRS}, firsts AS (SELECT row_id, min(row_id) OVER (PARTITION BY a, b) AS first_row_id FROM pairs) SELECT first_row_id, row_id AS copy_row_id FROM firsts WHERE row_id <> first_row_id",
    "p5_records": f"WITH {_PAIRS} SELECT min(row_id) AS first_row_id, count(*) AS n_copies FROM pairs GROUP BY a, b",
}
