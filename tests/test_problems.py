"""Problems 1 and 3: skewed keys and rows that fail to parse."""

from collections import defaultdict

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions.vertexkey import code_text, vertex_code, vertex_key
from weftgraph.operators.heavy import heavy_share, heavy_keys, skew_key_stats
from weftgraph.sources.quarantine import load_match_lines

KEYS = [
    ("acc-000000205", "acc000000205"), ("ACC 000.000.205", "acc000000205"), ("«Usr-000000001»\r", "usr000000001"), ("a.b.c_123456789", "abc123456789"), ("zzz999999999", "zzz999999999"),
    ("000000205-acc", None), ("acc-00000020", None), ("acc-0000002051", None), ("acc-00000020O", None), ("", None), (None, None), ("äcc-000000205", None), ("\\N", None), ("acc-000000205 x", None), ("aaa000000000", "aaa000000000"), ("acc-000000205\n", "acc000000205"),
]


def test_vertex_keys(spark):
    df = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(KEYS)], "i int, k string")
    got = df.select("i", code_text(vertex_code(F.col("k"))).alias("a"), vertex_key(F.col("k")).alias("b")).orderBy("i").collect()
    assert [r["a"] for r in got] == [want for _, want in KEYS]
    assert [r["b"] for r in got] == [want for _, want in KEYS]


def brute(data):
    n, partners = defaultdict(int), defaultdict(set)
    for k, p in data:
        if k is not None:
            n[k] += 1
            if p is not None:
                partners[k].add(p)
    return sorted((k, n[k], len(partners[k])) for k in n)


def test_a_key_with_a_third_of_the_rows(spark):
    data = [(1, i % 700) for i in range(2000)] + [(i, i % 5) for i in range(10, 4000)] + [(None, 1), (2, None), (2, None)]
    df = spark.createDataFrame([(k, p, "x", 0) for k, p in data], "k long, p long, n_rows string, __k int")
    heavy = heavy_keys(df, F.col("k"), 0.05)
    assert 1 in heavy and len(heavy) <= 40
    stats = skew_key_stats(df, "k", "p", heavy)
    assert rows(stats.all_keys, "k", "n_rows", "n_partners") == brute(data)
    assert rows(stats.heavy, "k")[0] == (1,)
    assert rows(skew_key_stats(df, "k", "p", []).all_keys, "k", "n_rows", "n_partners") == brute(data)


def test_sketch_finds_every_heavy_key(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 15).otherwise(F.col("id") + 1000).alias("k"))
    assert {0, 3, 6, 9, 12} <= set(heavy_keys(df, F.col("k"), 0.05))
    with pytest.raises(ValueError, match="too large"):
        heavy_keys(df, F.col("k"), 1e-7)


def test_sketches_of_many_tasks_are_merged_as_a_tree(spark):
    df = spark.range(0, 40_000, 1, 30).select(F.when(F.col("id") % 50 == 0, 7).otherwise(F.col("id") + 1000).alias("k"))
    assert 7 in heavy_keys(df, F.col("k"), 0.02)
    assert heavy_share(spark) == 0.001


def test_no_rows(spark):
    df = spark.createDataFrame([], "k long, p long")
    assert heavy_keys(df, F.col("k")) == []
    assert rows(skew_key_stats(df, "k", "p", []).all_keys) == []


GOOD, BAD = "acc-000000001\tusr-000000002", None
LINES = [
    (GOOD, "good"), ('"acc-000000001"\tusr-000000002', "good"), ('" ACC-000000001\t"\tusr-000000002', "good"), ('"""acc-000000001"""\tusr-000000002', "good"),
    ("", "blank"), (" 　\r", "blank"), (None, "blank"), ('"acc-000000001\tusr-000000002', "quoting"), ('"acc-000000001"x\tusr-000000002', "quoting"), ('acc-0"00000001\tusr-000000002', "quoting"), ('usr-000000002\t"acc-000000001" "', "quoting"),
    ("acc-000000001", "column_count"), ("acc-000000001\tusr-000000002\t0.5", "column_count"), ("\tacc-000000001\tusr-000000002", "column_count"), ('"a\tb"', "column_count"), ("acc-000000001\t", "bad_value"), ("acc-000000001\tusr-00000002", "bad_value"), ('"\n"\tusr-000000002', "bad_value"), (GOOD, "good"),
]


def test_lines_are_split_by_reason(spark):
    df = spark.createDataFrame([(i, x, "c", 1) for i, (x, _) in enumerate(LINES)], "line_id long, line string, c0 string, errors int")
    split = load_match_lines(df)
    assert rows(split.bad, "line_id", "reason") == [(i, k) for i, (_, k) in enumerate(LINES) if k not in ("good", "blank")]
    good = {r["line_id"]: (r["c0"], r["c1"]) for r in split.good.collect()}
    assert sorted(good) == [i for i, (_, k) in enumerate(LINES) if k == "good"]
    assert good[2] == (" ACC-000000001\t", "usr-000000002") and good[3][0] == '"acc-000000001"'


def test_very_long_lines_and_no_lines(spark):
    long = [(0, '"' + '""' * 300_000 + '"\tb'), (1, '"' + "a" * 1_000_000), (2, "a\t" * 200_000)]
    assert rows(load_match_lines(spark.createDataFrame(long, "line_id long, line string")).bad, "line_id", "reason") == [(0, "bad_value"), (1, "quoting"), (2, "column_count")]
    empty = load_match_lines(spark.createDataFrame([], "line_id long, line string"))
    assert rows(empty.bad) == [] and rows(empty.good) == []


def reference(line):
    """The quoting rule as a plain scan: the fields, or None."""
    fields, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            j, text = i + 1, ""
            while True:
                k = line.find('"', j)
                if k < 0:
                    return None
                text += line[j:k]
                if line[k + 1 : k + 2] == '"':
                    text, j = text + '"', k + 2
                else:
                    i = k + 1
                    break
        else:
            k = line.find("\t", i)
            k = len(line) if k < 0 else k
            text, i = line[i:k], k
            if '"' in text:
                return None
        fields.append(text)
        if i == len(line):
            return fields
        if line[i] != "\t":
            return None
        i += 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='"\ta b', min_size=1, max_size=9).filter(str.strip), min_size=60, max_size=60))
def test_quoting_against_a_scan(spark, texts):
    bad = {r["line_id"]: r["reason"] for r in load_match_lines(spark.createDataFrame(list(enumerate(texts)), "line_id long, line string")).bad.collect()}
    for i, t in enumerate(texts):
        f = reference(t)
        assert bad[i] == ("quoting" if f is None else "column_count" if len(f) != 2 else "bad_value"), t
