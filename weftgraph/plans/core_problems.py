"""Queries of problems 1 (a few keys holding most records) and 3 (rows that fail to parse)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.vertexkey import code_text, coded, sql_key
from weftgraph.operators.heavy import heavy_keys, skew_key_stats
from weftgraph.plans.tables import table
from weftgraph.session import written
from weftgraph.sources.quarantine import load_match_lines

#: p1_found: the share of all rows from which on a key is a case.
CASE_PERCENT = 1


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fk, other): every field of every test_tsv row; fk = 2 * key code + field, NULL where the field is unusable."""
    codes = coded(table(spark, sf_dir, "test_tsv"), {"a": F.col("c0"), "b": F.col("c1")})
    pair = lambda i, x, y: F.struct((F.col(x) * 2 + i).alias("fk"), F.col(y).alias("other"))
    return codes.select(F.inline(F.array(pair(0, "a", "b"), pair(1, "b", "a"))))


def _key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once: three passes follow, and each would parse the texts again.
    sides = written(_sides(spark, sf_dir), "sides")
    found = skew_key_stats(sides, "fk", "other", heavy_keys(sides, F.col("fk"))).all_keys
    field = F.concat(F.lit("c"), F.pmod("fk", F.lit(2)).cast("string"))
    code = F.shiftright("fk", 1)
    return found.select(field.alias("field_name"), code_text(code).alias("vkey"), "n_rows", "n_partners")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold at least 1 % of all rows of test_tsv within one field."""
    total = table(spark, sf_dir, "test_tsv").count()
    return _key_stats(spark, sf_dir).filter(F.col("n_rows") * 100 >= CASE_PERCENT * total).select("field_name", "vkey")


def p1_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct partners of every key of either field."""
    return _key_stats(spark, sf_dir)


def p1_busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 keys with most rows of each field; ties by key."""
    order = Window.partitionBy("field_name").orderBy(F.desc("n_rows"), "vkey")
    return _key_stats(spark, sf_dir).withColumn("place", F.row_number().over(order)).filter("place <= 20").withColumn("place", F.col("place").cast("long"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are neither good nor blank, with the first reason."""
    return load_match_lines(table(spark, sf_dir, "test_tsv_raw")).bad.select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good lines as (line_id, c0, c1) with the keys they hold."""
    good = load_match_lines(table(spark, sf_dir, "test_tsv_raw")).good
    return good.select("line_id", "c0", "c1", code_text(F.col("v0")).alias("vkey0"), code_text(F.col("v1")).alias("vkey1"))


_SIDES = f"""sides AS (
  SELECT 'c0' AS field_name, {sql_key("c0")} AS vkey, {sql_key("c1")} AS other FROM test_tsv
  UNION ALL SELECT 'c1', {sql_key("c1")}, {sql_key("c0")} FROM test_tsv),
stats AS (SELECT field_name, vkey, count(*) AS n_rows, count(DISTINCT other) AS n_partners FROM sides WHERE vkey IS NOT NULL GROUP BY 1, 2)"""

_FIELD = r'("([^"]|"")*"|[^"\t]*)'
_LINES = rf"""parsed AS (
  SELECT line_id, line, regexp_full_match(line, '{_FIELD}(\t{_FIELD})*') AS well,
    regexp_replace(line, '"([^"]|"")*"', '', 'g') AS bare FROM test_tsv_raw WHERE NOT regexp_full_match(line, '[\s\x{{0B}}\x{{85}}\x{{2028}}\x{{2029}}\p{{Zs}}]*')),
counted AS (SELECT *, CASE WHEN well THEN length(bare) - length(replace(bare, chr(9), '')) + 1 END AS n FROM parsed),
cells AS (SELECT *, CASE WHEN n = 2 THEN regexp_extract(line, '^{_FIELD}\t{_FIELD}$', 1) END AS f0, CASE WHEN n = 2 THEN regexp_extract(line, '^{_FIELD}\t{_FIELD}$', 3) END AS f1 FROM counted),
texts AS (SELECT line_id, well, n, CASE WHEN f0[1] = '"' THEN replace(f0[2:length(f0) - 1], '""', '"') ELSE f0 END AS c0,
    CASE WHEN f1[1] = '"' THEN replace(f1[2:length(f1) - 1], '""', '"') ELSE f1 END AS c1 FROM cells),
keys AS (SELECT *, {sql_key("c0")} AS vkey0, {sql_key("c1")} AS vkey1 FROM texts)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_key_stats, p1_busiest, p3_found, p3_loaded)}

ORACLES = {
    "p1_found": f"WITH {_SIDES} SELECT field_name, vkey FROM stats WHERE n_rows * 100 >= {CASE_PERCENT} * (SELECT count(*) FROM test_tsv)",
    "p1_key_stats": f"WITH {_SIDES} SELECT field_name, vkey, n_rows, n_partners FROM stats",
    "p1_busiest": f"WITH {_SIDES}, placed AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY n_rows DESC, vkey) AS place FROM stats) SELECT field_name, vkey, n_rows, n_partners, place FROM placed WHERE place <= 20",
    "p3_found": f"WITH {_LINES} SELECT line_id, CASE WHEN NOT well THEN 'quoting' WHEN n <> 2 THEN 'column_count' ELSE 'bad_value' END AS reason FROM keys WHERE NOT well OR n <> 2 OR vkey0 IS NULL OR vkey1 IS NULL",
    "p3_loaded": f"WITH {_LINES} SELECT line_id, c0, c1, vkey0, vkey1 FROM keys WHERE well AND n = 2 AND vkey0 IS NOT NULL AND vkey1 IS NOT NULL",
}
