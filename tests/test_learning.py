"""Learning toolkits against small known results and invariants."""

import itertools
import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from weftgraph.algorithms import cluster, graphical, linalg, recommend, topics
from weftgraph.functions.batches import grouped_vector_sum, matrix
from weftgraph.functions.factors import Table, agreement, laplace
from weftgraph.functions.sparse import cosamp
from weftgraph.graph import Graph
from weftgraph.operators.neighborhood import reservoir_one
from weftgraph.plans import ml_queries
from weftgraph.streaming import incremental

A = [[1.8147, 0.9134, 0.2785], [0.9058, 1.6324, 0.5469], [0.1270, 0.0975, 1.9575]]
B = [0.9649, 0.1576, 0.9706]


def coo(spark, m, base=0):
    return spark.createDataFrame([(i + base, j + base, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "i long, j long, v double")


def test_jacobi_golden(spark):
    a, b = coo(spark, A, 1), spark.createDataFrame([(i + 1, v) for i, v in enumerate(B)], "i long, v double")
    x = dict(rows(linalg.jacobi(a, b, 10)))
    assert [x[i] for i in (1, 2, 3)] == pytest.approx([0.67806771, -0.43984914, 0.47337334], abs=1e-7)
    assert linalg.residual_norm(a, linalg.jacobi(a, b, 10), b) == pytest.approx(0.00507232, abs=1e-7)
    assert [v for _, v in rows(linalg.matvec(a, b, transpose=True))] == pytest.approx(list(np.array(A).T @ B))


def test_svd_against_numpy(spark):
    m = np.random.default_rng(1).normal(size=(7, 5))
    values, u, v, residuals = linalg.svd(coo(spark, m), 3, steps=5)
    want = np.linalg.svd(m)[1]
    assert list(values) == pytest.approx(list(want[:3]), rel=1e-8) and residuals.max() < 1e-6
    left = {(i, k): x for i, k, x in rows(u)}
    right = {(i, k): x for i, k, x in rows(v)}
    made = sum(values[k] * np.outer([left[i, k] for i in range(7)], [right[j, k] for j in range(5)]) for k in range(3))
    full = np.linalg.svd(m)
    assert np.allclose(made, full[0][:, :3] @ np.diag(want[:3]) @ full[2][:3], atol=1e-6)


@pytest.mark.parametrize("small", [0, 10**6])
def test_svd_goes_on_until_values_converge(spark, small):
    n = 30  # a path: the leading values lie close together, far more than 2 k + 4 steps are needed
    m = np.eye(n) * 2 + np.eye(n, k=1) + np.eye(n, k=-1)
    cells = coo(spark, m).filter("v <> 0")
    values, u, v, residuals = linalg.svd(cells, 2, steps=None if small else 14, small=small)
    assert list(values) == pytest.approx(list(np.linalg.svd(m)[1][:2]), rel=1e-9) and residuals.max() < 4e-8
    left, right = (np.array([x for _, _, x in rows(f, "k", "i", "v")]).reshape(2, n) for f in (u, v))
    assert np.abs(m @ right.T - left.T * values).max() < 1e-7 and np.abs(m.T @ left.T - right.T * values).max() < 1e-7
    with pytest.raises(RuntimeError, match="not converged"):
        linalg.svd(cells, 2, steps=5, max_steps=5, small=small)


@pytest.mark.parametrize("small", [0, 10**6])
def test_svd_of_a_wide_matrix(spark, small):
    m = np.random.default_rng(2).normal(size=(3, 6))
    assert list(linalg.svd(coo(spark, m), 3, small=small)[0]) == pytest.approx(list(np.linalg.svd(m)[1]), rel=1e-8)


def test_cosamp_golden():
    a = np.array([[0.2785, 0.9649, 0.9572], [0.5469, 0.1576, 0.4854], [0.9575, 0.9706, 0.8003]])
    x = np.array([0, 1.2, 0])
    assert cosamp(a, a @ x, 1) == pytest.approx(x, abs=1e-4)


def test_vector_sums_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("f"))
    got = dict(rows(grouped_vector_sum(df, "id", lambda b: matrix(b.column("f")))))
    assert got[0] == [sum(range(0, 5000, 3)), len(range(0, 5000, 3))] and got[7] == [7.0, 1.0] and len(got) == 1 + 5000 - len(range(0, 5000, 3))


def ratings(spark):
    return recommend.synthetic_ratings(spark, 60, 30, per_user=12)


@pytest.mark.parametrize("name", ["als", "wals", "sparse", "sgd", "bias", "svdpp", "nmf", "ccd"])
def test_recommenders_beat_the_mean(spark, name):
    r = ratings(spark)
    fit = {
        "als": lambda: recommend.als(r, d=3, iterations=3),
        "wals": lambda: recommend.als(r.withColumn("weight", F.lit(2.0)), d=3, iterations=3, scaled=False),
        "sparse": lambda: recommend.als(r, d=4, iterations=2, sparse="both", sparsity=0.5),
        "sgd": lambda: recommend.sgd(r, d=3, epochs=12, gamma=0.05),
        "bias": lambda: recommend.sgd(r, d=3, epochs=6, gamma=0.05, bias=True),
        "svdpp": lambda: recommend.svdpp(r, d=3, epochs=4, gamma=0.05),
        "nmf": lambda: recommend.nmf(r, d=3, iterations=4),
        "ccd": lambda: recommend.ccd(r, d=2, iterations=2),
    }[name]
    errors = {k: e for k, _, e in rows(recommend.rmse(recommend.predict(fit(), r)))}
    spread, size = r.filter("role = 'train'").agg(F.stddev_pop("rating"), F.sqrt(F.avg(F.col("rating") * F.col("rating")))).first()
    # Few non-zero entries, and unrated cells that count as zeros, can't come near the ratings; they must still explain some.
    assert errors["train"] < {"sgd": 1.2 * spread, "sparse": 0.8 * size, "nmf": 0.8 * size}.get(name, spread)


def test_als_objective_falls(spark):
    r = ratings(spark)
    costs = [recommend.als_objective(recommend.als(r, d=3, iterations=k, lam=1e-6), r) for k in (1, 3)]
    assert costs[1] <= costs[0] + 1e-6


def test_ratings_with_nulls_and_unknown_users(spark):
    r = spark.createDataFrame([(1, 1, 4.0, "train"), (1, 2, 3.0, "train"), (None, 1, 5.0, "train"), (2, 1, None, "train"), (2, 2, 2.0, "train"), (9, 9, None, "predict"), (1, 1, 4.0, "train")], "user long, item long, rating double, role string")
    p = recommend.predict(recommend.als(r, d=2, iterations=2), r, 0.5, 5.0)
    assert p.filter("user = 9").first()["prediction"] is None and p.filter("user = 1 and item = 1").first()["prediction"] == pytest.approx(4.0, abs=0.7)
    more = recommend.implicit_ratings(r, 0.5, 1.0)
    assert more.count() > r.count() and more.filter("rating = 1.0").join(r, ["user", "item"], "left_semi").isEmpty()
    with pytest.raises(Exception, match="negative"):
        recommend.nmf(r.withColumn("rating", -F.col("rating")), d=2, iterations=1)


def test_drawn_pairs_are_made_without_joins(spark, monkeypatch):
    cells = [(u * 3_000_000_001 - 5 * 10**9, i * 7 - 30, 3.0, "train") for u in range(12) for i in range(40) if (u * i) % 5 < 2 or u == 3]
    r = spark.createDataFrame([*cells, (77, None, 1.0, "train"), (None, 5, 1.0, "train"), (77, None, 2.0, "train")], "user long, item long, rating double, role string")
    quick = recommend.implicit_ratings(r, 1.5, 2.5, 0.1, seed=7)
    # Joins and a distinct of all drawn pairs filled the disk, or the driver if one was taken for a small table.
    assert "Join" not in quick._jdf.queryExecution().executedPlan().toString()
    got = rows(quick.filter("weight < 1"))
    monkeypatch.setattr(recommend, "BROADCAST_ROWS", 0)
    assert got == rows(recommend.implicit_ratings(r, 1.5, 2.5, 0.1, seed=7).filter("weight < 1")) and len(got) > 100
    given = [u for u, *_ in cells]
    assert {u for u, *_ in got} == {u for u in given if given.count(u) < 40} | {77}


@pytest.mark.parametrize("fraction", [0.002, 0.3])
def test_implicit_als_is_that_of_the_drawn_rows(spark, fraction):
    r = ratings(spark).unionByName(spark.createDataFrame([(9_000, None, 1.0, "train"), (None, 1, 1.0, "train"), (9_001, 0, None, "predict")], "user long, item long, rating double, role string"))
    want = list(recommend.als_rounds(recommend.implicit_ratings(r, fraction, 2.5, 0.1), d=3, iterations=2, lam=0.3))
    for n, got in enumerate(recommend.als_implicit(r, fraction, 2.5, 0.1, d=3, iterations=2, lam=0.3)):
        for side in ("users", "items"):
            a, b = (dict(rows(getattr(m, side), "id", "f")) for m in (got, want[n]))
            assert a.keys() == b.keys() and all(x == pytest.approx(b[i], abs=1e-9) for i, x in a.items())
    assert n == 1 and got.users.count() == want[1].users.count()  # the last model stays


def test_adpredictor_learns_the_sign(spark):
    clicks = spark.createDataFrame([(i, 1 if i % 2 else -1, f) for i in range(200) for f in (i % 2, 7)], "row_id long, label int, feature long")
    got = {f: (m, s) for f, m, s in rows(recommend.adpredictor(clicks))}
    assert got[1][0] > 0 > got[0][0] and all(0 < s <= 1 for _, s in got.values())


def blobs(spark, n, k):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal((10 * (i % k), 5 * (i % k) ** 2), 0.3)], i % k) for i in range(n)], "id long, point array<double>, label int")


def test_generated_blobs_repeat(spark):
    p = cluster.gaussian_blobs(spark, 50, 2)
    assert rows(p) == rows(cluster.gaussian_blobs(spark, 50, 2)) and p.select("label").distinct().count() == 2


def test_kmeans_finds_blobs(spark):
    p = blobs(spark, 300, 3)
    found, centres = cluster.kmeans(p, 3, 20)
    assert len(centres) == 3 and found.join(p, "id").select("cluster", "label").distinct().count() == 3
    assert found.join(cluster.kmeans_with_rewards(p, spark.createDataFrame([(0, 1, 0.1)], "i long, j long, w double"), 3).toDF("id", "c2"), "id").select("cluster", "c2").distinct().count() == 3
    with pytest.raises(ValueError, match="more clusters"):
        cluster.kmeans(p.limit(2), 3)
    with pytest.raises(ValueError, match="dimension"):
        cluster.kmeans(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, None)], "id long, point array<double>"), 1)
    assert cluster.kmeans(spark.createDataFrame([], "id long, point array<double>"), 2)[0].count() == 0


def test_similarities_and_spectral_clustering(spark):
    p = blobs(spark, 60, 2)
    assert cluster.similarity_graph(p, 1.0).count() == 60 * 59 // 2
    near = cluster.similarity_graph(p, 1.0, t=3)
    assert 60 * 3 // 2 <= near.count() <= 60 * 3
    found = cluster.spectral_clustering(p, 2, 3.0, t=None).join(p, "id").select("cluster", "label").distinct().count()
    assert found == 2
    g = Graph.build(spark.createDataFrame([(a, b) for q in (0, 10) for a, b in itertools.combinations(range(q, q + 5), 2)] + [(0, 10)], "src long, dst long"))
    parts = dict(rows(cluster.partition_graph(g, 2), "id", "cluster"))
    assert len({parts[i] for i in range(5)}) == 1 and parts[0] != parts[10]


def test_topics(spark):
    tokens = [(d, w + 10 * (d % 2), 3) for d in range(20) for w in range(5)]
    bag = topics.bag_of_words(spark.createDataFrame([*tokens, (None, 1, 1), (0, 0, 500)], "doc long, word long, n long"))
    assert bag.filter("doc = 0 and word = 0").first()["n"] == 100
    for fit in (topics.lda_cvb0, topics.lda_gibbs):
        docs, words, trend = fit(bag, 2, 8, alpha=0.1, beta=0.01)
        assert trend[-1] > trend[0] and docs.count() == 20
        total = words.select(F.aggregate("total", F.lit(0.0), lambda a, x: a + x).alias("t")).agg(F.sum("t")).first()[0]
        assert total == pytest.approx(bag.agg(F.sum("n")).first()[0])
    assert topics.top_words(words, 3).count() == 6


def exact(priors, tables, maximum=False):
    """Marginals (or max-marginals) by enumeration; tables: {(i, j): matrix}."""
    n, best = len(priors), [np.full(len(p), -np.inf) for p in priors]
    for x in itertools.product(*(range(len(p)) for p in priors)):
        s = sum(p[v] for p, v in zip(priors, x, strict=True)) + sum(t[x[i], x[j]] for (i, j), t in tables.items())
        for i in range(n):
            best[i][x[i]] = max(best[i][x[i]], s) if maximum else np.logaddexp(best[i][x[i]], s)
    return [b - np.logaddexp.reduce(b) for b in best]


def test_belief_propagation_is_exact_on_trees(spark):
    rng = np.random.default_rng(0)
    priors = [np.log(rng.dirichlet(np.ones(3))) for _ in range(5)]
    links = [(0, 1), (1, 2), (1, 3), (3, 4)]
    potts = np.where(np.eye(3, dtype=bool), 0.0, -1.0)
    v = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(priors)], "id long, prior array<double>")
    e = spark.createDataFrame(links, "src long, dst long")
    for maximum in (False, True):
        want = exact(priors, {k: potts for k in links}, maximum)
        got = graphical.potts_bp(v, e, smoothing=1.0, damping=0.0, iterations=6, maximum=maximum)
        assert all(np.allclose(b, want[i], atol=1e-6) for i, b in rows(got, "id", "belief"))
        f = spark.createDataFrame([(k, list(s), [3, 3], [float(x) for x in potts.ravel()]) for k, s in enumerate(links)], "fid long, scope array<long>, sizes array<int>, logp array<double>")
        got = graphical.factor_graph_bp(v, f, 6, maximum=maximum)
        assert all(np.allclose(b, want[i], atol=1e-6) for i, b in rows(got, "id", "belief"))


def test_map_relaxations(spark):
    rng = np.random.default_rng(2)
    theta = rng.normal(size=(5, 2))
    links = [(0, 1), (1, 2), (2, 3), (3, 4)]
    tables = {k: rng.normal(size=(2, 2)) for k in links}
    best = max(itertools.product(range(2), repeat=5), key=lambda x: sum(theta[i, v] for i, v in enumerate(x)) + sum(t[x[i], x[j]] for (i, j), t in tables.items()))
    value = sum(theta[i, v] for i, v in enumerate(best)) + sum(t[best[i], best[j]] for (i, j), t in tables.items())
    u = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(theta)], "id long, theta array<double>")
    p = spark.createDataFrame([(k, i, j, [float(x) for x in tables[i, j].ravel()]) for k, (i, j) in enumerate(links)], "eid long, i long, j long, theta array<double>")
    got, duals = graphical.mplp(u, p, 14)
    assert all(a >= b - 1e-9 for a, b in zip(duals, duals[1:])) and duals[-1] >= value - 1e-9 and duals[-1] == pytest.approx(value, abs=0.05)
    assert [x for _, x in rows(got, "id", "map_state")] == list(best)
    for method in ("projected", "symmetric", "admm"):
        _, duals, primals = graphical.dual_decomposition(u, p, 3, method=method)
        assert min(duals) >= value - 1e-9 and max(primals) <= value + 1e-9


def test_factor_tables():
    t = Table((1, 2), np.log(np.array([[0.1, 0.2], [0.3, 0.4]])))
    assert np.exp(t.marginalize((1,)).logp) == pytest.approx([0.3, 0.7]) and np.exp(t.condition({1: 0}).normalize().logp) == pytest.approx([1 / 3, 2 / 3])
    m = Table((2,), np.log(np.array([0.5, 0.25])))
    assert np.exp(t.convolve(m).logp) == pytest.approx([0.1, 0.25]) and np.allclose(((t * m) / m).logp, t.logp)
    assert t.best() == (1, 1) and t.sample(0.05) == (0, 0) and t.sample(0.999) == (1, 1)
    assert t.expectation() == pytest.approx([0.7, 0.6]) and t.l1_diff(t) == 0 and np.exp((t + t).normalize().logp) == pytest.approx(np.exp(t.logp))
    assert t.damp(t, 0.3).logp == pytest.approx(t.logp) and t.shift_normalize().logp.max() == 0
    assert agreement((0, 1), 2, 3.0).logp.tolist() == [[0, -3], [-3, 0]] and laplace((0, 1), 3, 1.0).logp[0, 2] == -2


def test_noisy_image_gets_cleaner(spark):
    pixels, links = graphical.noisy_image(spark, 12, 12)
    wrong = lambda df, c: df.filter(F.col(c) != F.col("truth")).count()
    seen = pixels.withColumn("seen", F.array_position("prior", F.array_max("prior")) - 1)
    cleaned = graphical.potts_bp(pixels, links, smoothing=1.0, iterations=5).join(pixels, "id")
    assert wrong(cleaned, "map_state") < wrong(seen, "seen")


def test_reservoir_is_proportional_and_repeatable(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 9.0), (3, 0.0), (4, None)], "id long, w double")
    drawn = [reservoir_one(df, F.col("w"), F.col("id"), s).first()["id"] for s in range(30)]
    assert set(drawn) <= {1, 2} and drawn.count(2) > 20


def test_stream_of_edges(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, 2), (5, 6)], "src long, dst long")
    df.coalesce(1).write.mode("append").parquet(source)
    for step, extra in enumerate(([], [(2, 5), (8, 9)])):
        if extra:
            spark.createDataFrame(extra, "src long, dst long").coalesce(1).write.mode("append").parquet(source)
        q = incremental.follow_edges(spark.readStream.schema("src long, dst long").parquet(source), out)
        q.awaitTermination(120)
        got = dict(rows(spark.read.parquet(f"{out}/v{step}"), "id", "component"))
        assert got == ({1: 1, 2: 1, 5: 5, 6: 5} if step == 0 else {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8})


def test_event_stream_windows(spark, tmp_path):
    rows_ = [(1, "2024-01-01 00:10:00", 1, "a", 2.0, None), (2, "2024-01-01 00:50:00", 1, "a", 3.0, None), (3, "2024-01-01 01:10:00", 1, None, None, None)]
    df = spark.createDataFrame(rows_, "event_id long, t string, user_id long, event_type string, value double, props string").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props")
    df.write.parquet(str(tmp_path / "e"))
    table = incremental.event_windows(df)
    q = incremental.event_windows(incremental.read_event_stream(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, table.collect())) and table.count() == 2
    assert math.isclose(table.filter("event_type = 'a'").first()["sum_value"], 5.0)


def test_words_of_all_scripts(spark, tmp_path):
    texts = ["Été à Zürich, a é", "委員会です。了", "ขอบคุณ", "हिन्दी में", "42 !", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for doc, w in rows(ml_queries.words(spark, str(tmp_path)), "doc", "w"):
        found.setdefault(doc, set()).add(w)
    assert found == {0: {"été", "à", "zürich", "a", "é"}, 1: {"委員", "員会", "会で", "です", "了"}, 2: {"ขอ", "อบ", "บคุ", "คุณ"}, 3: {"हिन्दी", "में"}}


def test_kmeans_goes_on_until_no_assignment_changes(spark, monkeypatch):
    # Four centres at the left end of a line: the borders move by a few points a round.
    x = np.arange(1, 401, dtype=float) ** 1.1
    p = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "id long, point array<double>").coalesce(1)
    centres, rounds = x[:4], 0
    while True:
        near = np.abs(x[:, None] - centres).argmin(axis=1)
        moved = np.array([x[near == c].mean() for c in range(4)])
        if np.allclose(moved, centres, rtol=1e-14):
            break
        centres, rounds = moved, rounds + 1
    monkeypatch.setattr(cluster, "MOST_ROUNDS", rounds + 3)
    found, got = cluster.kmeans(p, centres=x[:4, None])
    assert rounds > 20
    assert list(got[:, 0]) == pytest.approx(list(centres)) and [c for _, c in rows(found, "id", "cluster")] == list(near)
    monkeypatch.setattr(cluster, "MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="still change"):
        cluster.kmeans(p, centres=x[:4, None])
