"""Queries of the learning toolkits: ratings, clustering, topics, linear systems, graphical models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.algorithms import cluster, graphical, linalg, recommend, topics
from weftgraph.algorithms.analytics import hashed, label_propagation, normalized_rows
from weftgraph.algorithms.linalg import axb, matvec
from weftgraph.functions.draws import mixed, sql_draw, sql_mixed
from weftgraph.graph import Graph
from weftgraph.operators.neighborhood import reservoir_one, vector_sum
from weftgraph.plans.graph_queries import CONSEC, NEAR, SEGMENTS, TREE, consecutive_customers, place_tree
from weftgraph.plans.tables import table
from weftgraph.session import written

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


# -- ratings -----------------------------------------------------------------------------------------------------------
def clean_ratings(spark: SparkSession, d: str) -> DataFrame:
    """(user, item, rating, role): one row per user, item and role, the one rated last; roles in one spelling; ratings
    outside [0.5, 5] and rows without user, item or role dropped, as are training and validation rows without a rating."""
    r = table(spark, d, "ratings").select("user_id", "item_id", "rating", F.lower(F.trim("split_role")).alias("role"), "rated_at")
    r = r.filter("user_id IS NOT NULL AND item_id IS NOT NULL AND role IN ('train', 'validate', 'predict')").filter("(role = 'predict' AND rating IS NULL) OR rating BETWEEN 0.5 AND 5")
    one = r.groupBy("user_id", "item_id", "role").agg(F.max(F.struct(F.coalesce("rated_at", F.lit("1970-01-01").cast("timestamp_ntz").cast(r.schema["rated_at"].dataType)).alias("at"), "rating")).alias("m"))
    return one.select(F.col("user_id").alias("user"), F.col("item_id").alias("item"), F.col("m.rating").alias("rating"), "role")


_RATINGS = """ratings_clean AS MATERIALIZED (SELECT "user", item, role, rating FROM (SELECT user_id AS "user", item_id AS item, role, rating, row_number() OVER (PARTITION BY user_id, item_id, role ORDER BY coalesce(rated_at, TIMESTAMP '1970-01-01') DESC, rating DESC NULLS LAST) AS p FROM (SELECT *, lower(trim(split_role)) AS role FROM ratings) WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND role IN ('train', 'validate', 'predict') AND ((role = 'predict' AND rating IS NULL) OR rating BETWEEN 0.5 AND 5)) WHERE p = 1)"""


@query(f'WITH {_RATINGS} SELECT "user", item, rating, role FROM ratings_clean')
def m_clean_ratings(spark: SparkSession, d: str) -> DataFrame:
    return clean_ratings(spark, d)


@query(f"WITH {_RATINGS}, mean AS (SELECT item, avg(rating) AS prediction FROM ratings_clean WHERE role = 'train' GROUP BY item) SELECT role, count(*) AS n, round(sqrt(avg((rating - prediction) * (rating - prediction))), 6) AS rmse FROM ratings_clean JOIN mean USING (item) WHERE rating IS NOT NULL GROUP BY role")
def m_rmse_of_item_means(spark: SparkSession, d: str) -> DataFrame:
    r = written(clean_ratings(spark, d), "ratings")
    means = recommend.training(r).groupBy("item").agg(F.avg("rating").alias("prediction"))
    return recommend.rmse(r.join(means, "item")).select("role", "n", F.round("rmse", 6).alias("rmse"))


def _scored(model: recommend.Model, r: DataFrame) -> DataFrame:
    return recommend.rmse(recommend.predict(model, r, 0.5, 5.0)).select("role", "n", F.round("rmse", 5).alias("rmse"))


_TRAIN = f"""{_RATINGS}, train AS MATERIALIZED (SELECT "user" AS u, item AS v, rating AS r FROM ratings_clean WHERE role = 'train'), mean AS (SELECT avg(r) AS m FROM train)"""
GAMMA, LAMBDA, DECAY = 0.02, 0.02, 0.9


def _factors_sql(side: str, width: int, scale: float, positive: bool, seed: int = 0) -> str:
    column = {"user": "u", "item": "v"}[side]
    return f"SELECT id, k, ({sql_draw('id', side, seed, ('k',))} - {0.0 if positive else 0.5}) * {scale} AS f FROM (SELECT DISTINCT {column} AS id FROM train), range({width}) t(k)"


def _score_sql(users: str, items: str, d: int, bias: bool) -> str:
    """(u, v, role, rating, p): clipped predictions of all cleaned ratings, NULL where a side is unknown."""
    extra = f"(SELECT m FROM mean) + sum(CASE WHEN x.k = {d} THEN x.f + y.f ELSE x.f * y.f END)" if bias else "sum(x.f * y.f)"
    return f"""scored AS MATERIALIZED (SELECT c."user" AS u, c.item AS v, role, any_value(rating) AS rating, greatest(0.5, least(5.0, {extra})) AS p FROM ratings_clean c JOIN {users} x ON x.id = c."user" JOIN {items} y ON y.id = c.item AND y.k = x.k GROUP BY 1, 2, 3)"""


_RMSE = "SELECT role, count(*) AS n, round(sqrt(avg((rating - p) * (rating - p))), 5) AS rmse FROM scored WHERE rating IS NOT NULL GROUP BY role"


def _descent_sql(d: int, epochs: int, bias: bool) -> str:
    width, scale, positive = (d + 1, 0.5, False) if bias else (d, 0.5, True)
    steps = [f"u0 AS MATERIALIZED ({_factors_sql('user', width, scale, positive)})", f"v0 AS MATERIALIZED ({_factors_sql('item', width, scale, positive)})"]
    gamma = GAMMA
    for e in range(epochs):
        said = f"(SELECT m FROM mean) + sum(CASE WHEN x.k = {d} THEN x.f + y.f ELSE x.f * y.f END)" if bias else "sum(x.f * y.f)"
        other = lambda o: f"CASE WHEN x.k = {d} THEN 1.0 ELSE {o}.f END" if bias else f"{o}.f"
        steps.append(f"e{e} AS MATERIALIZED (SELECT t.u, t.v, any_value(r) - ({said}) AS e FROM train t JOIN u{e} x ON x.id = u JOIN v{e} y ON y.id = v AND y.k = x.k GROUP BY 1, 2)")
        for side, mine, theirs in (("u", "x", "y"), ("v", "y", "x")):
            steps.append(f"{side}{e + 1} AS MATERIALIZED (SELECT {mine}.id, x.k, any_value({mine}.f) + sum({gamma!r} * (e * ({other(theirs)}) - {LAMBDA} * {mine}.f)) / greatest(1.0, count(*) * {gamma!r} * 4) AS f FROM e{e} JOIN u{e} x ON x.id = u JOIN v{e} y ON y.id = v AND y.k = x.k GROUP BY 1, 2)")
        gamma *= DECAY
    return f"WITH {_TRAIN}, {', '.join(steps)}, {_score_sql(f'u{epochs}', f'v{epochs}', d, bias)} "


@query(_descent_sql(20, 5, False) + _RMSE)
def m_sgd(spark: SparkSession, d: str) -> DataFrame:
    """Errors of gradient descent on training and validation ratings."""
    r = written(clean_ratings(spark, d), "ratings")
    return _scored(recommend.sgd(r, d=20, epochs=5), r)


@query(_descent_sql(20, 5, True) + _RMSE)
def m_bias_sgd(spark: SparkSession, d: str) -> DataFrame:
    r = written(clean_ratings(spark, d), "ratings")
    return _scored(recommend.sgd(r, d=20, epochs=5, bias=True), r)


@query(_descent_sql(20, 3, True) + """SELECT c."user", c.item, round(p, 5) AS prediction FROM ratings_clean c LEFT JOIN scored s ON s.u = c."user" AND s.v = c.item AND s.role = c.role WHERE c.role = 'predict'""")
def m_predictions(spark: SparkSession, d: str) -> DataFrame:
    """What bias-SGD predicts for the rows to be predicted."""
    r = written(clean_ratings(spark, d), "ratings")
    return recommend.predict(recommend.sgd(r, d=20, epochs=3, bias=True), r, 0.5, 5.0).filter("role = 'predict'").select("user", "item", F.round("prediction", 5).alias("prediction"))


def _svdpp_sql(d: int, epochs: int) -> str:
    steps = [f"u0 AS MATERIALIZED ({_factors_sql('user', d + 1, 0.2, False)})", f"v0 AS MATERIALIZED ({_factors_sql('item', d + 1, 0.2, False)})", f"y0 AS MATERIALIZED ({_factors_sql('item', d, 0.2, False, 1)})", "cu AS (SELECT u, count(*) AS n FROM train GROUP BY u)"]
    gamma = GAMMA
    whole = lambda e: f"w{e} AS MATERIALIZED (SELECT x.id, x.k, x.f + coalesce(s / sqrt(n), 0) AS f FROM u{e} x JOIN cu ON cu.u = x.id LEFT JOIN (SELECT t.u, k, sum(f) AS s FROM train t JOIN y{e} ON id = t.v GROUP BY 1, 2) q ON q.u = x.id AND q.k = x.k)"
    for e in range(epochs):
        steps.append(whole(e))
        steps.append(f"e{e} AS MATERIALIZED (SELECT t.u, t.v, any_value(r) - ((SELECT m FROM mean) + sum(CASE WHEN x.k = {d} THEN x.f + y.f ELSE x.f * y.f END)) AS e FROM train t JOIN w{e} x ON x.id = u JOIN v{e} y ON y.id = v AND y.k = x.k GROUP BY 1, 2)")
        move = lambda mine, theirs: f"sum({gamma!r} * (e * (CASE WHEN x.k = {d} THEN 1.0 ELSE {theirs}.f END) - {LAMBDA} * {mine}.f)) / greatest(1.0, count(*) * {gamma!r} * 4)"
        steps.append(f"c{e} AS MATERIALIZED (SELECT x.id, x.k, {move('x', 'y')} AS c FROM e{e} JOIN w{e} x ON x.id = u JOIN v{e} y ON y.id = v AND y.k = x.k GROUP BY 1, 2)")
        steps.append(f"v{e + 1} AS MATERIALIZED (SELECT y.id, x.k, any_value(y.f) + {move('y', 'x')} AS f FROM e{e} JOIN w{e} x ON x.id = u JOIN v{e} y ON y.id = v AND y.k = x.k GROUP BY 1, 2)")
        steps.append(f"u{e + 1} AS MATERIALIZED (SELECT x.id, x.k, x.f + c AS f FROM u{e} x JOIN c{e} c ON c.id = x.id AND c.k = x.k)")
        steps.append(f"y{e + 1} AS MATERIALIZED (SELECT y.id, y.k, any_value(y.f) + sum(c / sqrt(n)) / count(*) AS f FROM train t JOIN cu USING (u) JOIN c{e} c ON c.id = t.u JOIN y{e} y ON y.id = t.v AND y.k = c.k GROUP BY 1, 2)")
        gamma *= DECAY
    return f"WITH {_TRAIN}, {', '.join(steps)}, {whole(epochs)}, {_score_sql(f'w{epochs}', f'v{epochs}', d, True)} {_RMSE}"


@query(_svdpp_sql(20, 3))
def m_svdpp(spark: SparkSession, d: str) -> DataFrame:
    r = written(clean_ratings(spark, d), "ratings")
    return _scored(recommend.svdpp(r, d=20, epochs=3), r)


def _nmf_sql(d: int, iterations: int) -> str:
    steps = [f"u0 AS MATERIALIZED ({_factors_sql('user', d, 1.0, True)})", f"v0 AS MATERIALIZED ({_factors_sql('item', d, 1.0, True)})"]
    for i in range(iterations):
        for mine, theirs, a, b in (("u", "v", f"u{i}", f"v{i}"), ("v", "u", f"v{i}", f"u{i + 1}")):
            steps.append(f"q{mine}{i} AS MATERIALIZED (SELECT t.u, t.v, any_value(r) / greatest(sum(x.f * y.f), 1e-12) AS q FROM train t JOIN {a} x ON x.id = t.{mine} JOIN {b} y ON y.id = t.{theirs} AND y.k = x.k GROUP BY 1, 2)")
            steps.append(f"{mine}{i + 1} AS MATERIALIZED (SELECT x.id, x.k, greatest(any_value(x.f) * sum(y.f * q) / greatest(any_value(total), 1e-12), 1e-12) AS f FROM q{mine}{i} t JOIN {a} x ON x.id = t.{mine} JOIN {b} y ON y.id = t.{theirs} AND y.k = x.k JOIN (SELECT k, sum(f) AS total FROM {b} GROUP BY k) z ON z.k = x.k GROUP BY 1, 2)")
    return f"WITH {_TRAIN}, {', '.join(steps)}, {_score_sql(f'u{iterations}', f'v{iterations}', d, False)} {_RMSE}"


@query(_nmf_sql(20, 4))
def m_nmf(spark: SparkSession, d: str) -> DataFrame:
    r = written(clean_ratings(spark, d), "ratings")
    return _scored(recommend.nmf(r, d=20, iterations=4), r)


def _ccd_sql(d: int, iterations: int, lam: float = 0.01) -> str:
    steps = ["e0 AS MATERIALIZED (SELECT u, v, r AS e FROM train)", *(f"u{k}_0 AS (SELECT DISTINCT u AS id, 0.0::DOUBLE AS x FROM train), v{k}_0 AS MATERIALIZED (SELECT id, f AS x FROM ({_factors_sql('item', d, 0.5, True)}) WHERE k = {k})" for k in range(d))]
    n = 0
    for i in range(iterations):
        for k in range(d):
            steps.append(f"t{n} AS MATERIALIZED (SELECT u, v, e + p.x * q.x AS t, q.x AS q FROM e{n} JOIN u{k}_{i} p ON p.id = u JOIN v{k}_{i} q ON q.id = v)")
            steps.append(f"u{k}_{i + 1} AS MATERIALIZED (SELECT u AS id, sum(t * q) / ({lam} + sum(q * q)) AS x FROM t{n} GROUP BY u)")
            steps.append(f"v{k}_{i + 1} AS MATERIALIZED (SELECT v AS id, sum(t * x) / ({lam} + sum(x * x)) AS x FROM t{n} JOIN u{k}_{i + 1} ON id = u GROUP BY v)")
            steps.append(f"e{n + 1} AS MATERIALIZED (SELECT u, v, t - p.x * q.x AS e FROM t{n} JOIN u{k}_{i + 1} p ON p.id = u JOIN v{k}_{i + 1} q ON q.id = v)")
            n += 1
    both = " UNION ALL ".join(f"SELECT '{s}' AS s, id, {k} AS k, x AS f FROM {s}{k}_{iterations}" for s in "uv" for k in range(d))
    return f"WITH {_TRAIN}, {', '.join(steps)}, every AS MATERIALIZED ({both}), {_score_sql('(SELECT id, k, f FROM every WHERE s = $$u$$)', '(SELECT id, k, f FROM every WHERE s = $$v$$)', d, False)} {_RMSE}"


@query(_ccd_sql(5, 2))
def m_ccd(spark: SparkSession, d: str) -> DataFrame:
    r = written(clean_ratings(spark, d), "ratings")
    return _scored(recommend.ccd(r, d=5, iterations=2), r)


#: Training ratings, and validation ratings whose user and item the training knows.
_KNOWN = f"""WITH {_TRAIN} SELECT role, count(*) AS n, TRUE AS better_than_item_means, TRUE AS falls FROM ratings_clean WHERE rating IS NOT NULL AND "user" IN (SELECT u FROM train) AND item IN (SELECT v FROM train) GROUP BY role"""


def _checked_als(spark: SparkSession, d: str, fit, slack: float = 1.33) -> DataFrame:
    """By role: ratings with a prediction, whether the error is below that of the items' means (times ``slack``, on ratings not
    trained on), and whether the training error falls from the first round to the last."""
    r = written(clean_ratings(spark, d), "ratings")
    means = recommend.training(r).groupBy("item").agg(F.avg("rating").alias("prediction"))
    plain = recommend.rmse(r.join(means, "item")).select("role", F.col("rmse").alias("plain"))
    last, errors = None, []
    for n, last in enumerate(fit(r, 4)):
        if n in (0, 3):
            errors.append(recommend.als_objective(last, r))
    falls = errors[-1] < errors[0]
    scored = recommend.rmse(recommend.predict(last, r, 0.5, 5.0)).join(plain, "role")
    return scored.select("role", "n", (F.col("rmse") < F.col("plain") * F.when(F.col("role") == "train", 1.0).otherwise(slack)).alias("better_than_item_means"), F.lit(falls).alias("falls"))


def _drawn_pairs_sql(fraction: float, seed: int = 0) -> str:
    return f"""items AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS slot FROM (SELECT DISTINCT item FROM ratings_clean)), n AS (SELECT count(*) AS n, greatest(1, round({fraction} * count(*)))::BIGINT AS draws FROM items),
drawn AS (SELECT DISTINCT "user", {sql_mixed('"user"', ('k',), seed)} % n AS slot FROM (SELECT DISTINCT "user" FROM ratings_clean), n, range(1, draws + 1) t(k)),
drawn_pairs AS (SELECT "user", item, 2.5::DOUBLE AS rating, 0.1::DOUBLE AS weight FROM drawn JOIN items USING (slot) WHERE ("user", item) NOT IN (SELECT ("user", item) FROM ratings_clean))"""


@query(_KNOWN)
def m_als(spark: SparkSession, d: str) -> DataFrame:
    return _checked_als(spark, d, lambda r, n: recommend.als_rounds(r, d=20, iterations=n, lam=0.3))


@query(_KNOWN)
def m_weighted_als(spark: SparkSession, d: str) -> DataFrame:
    return _checked_als(spark, d, lambda r, n: recommend.als_rounds(r.withColumn("weight", 1 + hashed(F.col("user"), F.col("item"))), d=20, iterations=n, lam=0.3))


@query(_KNOWN)
def m_sparse_als(spark: SparkSession, d: str) -> DataFrame:
    return _checked_als(spark, d, lambda r, n: recommend.als_rounds(r, d=20, iterations=n, lam=0.3, sparse="both", sparsity=0.5), 1.6)


@query(f"""WITH {_TRAIN}, {_drawn_pairs_sql(0.005)}, known AS (SELECT item FROM drawn_pairs UNION SELECT v FROM train) SELECT role, count(*) AS n, TRUE AS better_than_item_means, TRUE AS falls FROM ratings_clean WHERE rating IS NOT NULL AND item IN (SELECT item FROM known) AND "user" IN (SELECT "user" FROM drawn_pairs UNION SELECT u FROM train) GROUP BY role""")
def m_als_implicit(spark: SparkSession, d: str) -> DataFrame:
    """With random unrated pairs of a middling value and little weight among the training rows."""
    return _checked_als(spark, d, lambda r, n: recommend.als_implicit(r, 0.005, 2.5, 0.1, d=20, iterations=n, lam=0.3))


@query(f"""WITH {_RATINGS}, {_drawn_pairs_sql(0.02)} SELECT "user", item, rating, weight FROM drawn_pairs""")
def m_implicit_ratings(spark: SparkSession, d: str) -> DataFrame:
    """The random rows added for implicit ratings."""
    r = written(clean_ratings(spark, d), "ratings")
    return recommend.implicit_ratings(r, 0.02, 2.5, 0.1).filter("weight < 1").select("user", "item", "rating", "weight")


def _power_sql(steps: int) -> str:
    out = ["x0 AS (SELECT DISTINCT v AS id, 1.0::DOUBLE AS x FROM train)"]
    for k in range(1, steps + 1):
        out.append(f"y{k} AS MATERIALIZED (SELECT u AS id, sum(r * x) AS y FROM train JOIN x{k - 1} ON id = v GROUP BY u)")
        out.append(f"x{k} AS MATERIALIZED (SELECT v AS id, sum(r * y) AS x FROM train JOIN y{k} ON id = u GROUP BY v)")
    return f"WITH {_TRAIN}, {', '.join(out)}, top AS (SELECT round(sqrt(sqrt((SELECT sum(x * x) FROM x{steps}) / (SELECT sum(x * x) FROM x{steps - 1}))), 3) AS s) SELECT k::INT AS k, CASE WHEN k = 0 THEN s END AS largest, TRUE AS converged, TRUE AS falling FROM top, range(3) t(k)"


@query(_power_sql(25))
def m_svd_ratings(spark: SparkSession, d: str) -> DataFrame:
    """The largest singular value of the ratings, which a power iteration gives as well; residuals and order of the first three."""
    r = recommend.training(clean_ratings(spark, d)).select(F.col("user").alias("i"), F.col("item").alias("j"), F.col("rating").alias("v"))
    values, _, _, residuals = linalg.svd(r, 3)
    rows = [(k, round(float(s), 3) if k == 0 else None, bool(e <= 1e-8 * s), bool(k == 0 or s <= values[k - 1])) for k, (s, e) in enumerate(zip(values, residuals, strict=True))]
    return spark.createDataFrame(rows, "k int, largest double, converged boolean, falling boolean")


def _probit_sql(iterations: int) -> str:
    brand, discount = "regexp_extract(p_brand, '[0-9]+')::BIGINT", "1000 + round(l_discount * 100)::BIGINT"
    base = f"given AS (SELECT l_orderkey * 100 + l_linenumber AS row_id, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE -1.0 END AS label, unnest([{brand}, {discount}]) AS feature FROM lineitem JOIN part ON l_partkey = p_partkey), rows_ AS MATERIALIZED (SELECT row_id, feature, max(label) AS label FROM given GROUP BY 1, 2), s0 AS (SELECT DISTINCT feature, 0.0::DOUBLE AS mu, 1.0::DOUBLE AS s2 FROM rows_)"
    steps = []
    for k in range(1, iterations + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT row_id, max(label) AS label, sum(s2) + 1 AS s, max(label) * sum(mu) / sqrt(sum(s2) + 1) AS t FROM rows_ JOIN s{k - 1} USING (feature) GROUP BY row_id)")
        steps.append(f"e{k} AS (SELECT *, abs(t) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * abs(t) / sqrt(2.0)) AS q FROM r{k})")
        steps.append(f"f{k} AS (SELECT *, q * (0.254829592 + q * (-0.284496736 + q * (1.421413741 + q * (-1.453152027 + q * 1.061405429)))) * exp(-x * x) AS erfc FROM e{k})")
        steps.append(f"v{k} AS MATERIALIZED (SELECT row_id, label, s, t, exp(-t * t / 2) / sqrt(2 * pi()) / greatest(CASE WHEN t < 0 THEN erfc / 2 ELSE 1 - erfc / 2 END, 1e-12) AS v FROM f{k})")
        steps.append(f"s{k} AS MATERIALIZED (SELECT feature, any_value(mu) + sum(label * s2 / sqrt(s) * v) AS mu, greatest(1e-9, any_value(s2) * product(greatest(1e-6, 1 - s2 / s * v * (v + t)))) AS s2 FROM rows_ JOIN v{k} USING (row_id) JOIN s{k - 1} USING (feature) GROUP BY feature)".replace("any_value(mu) + sum(label", f"any_value(mu) + sum(v{k}.label"))
    return f"WITH {base}, {', '.join(steps)} SELECT feature, round(mu, 4) AS mu, round(s2, 6) AS sigma2 FROM s{iterations}"


@query(_probit_sql(1))
def m_adpredictor(spark: SparkSession, d: str) -> DataFrame:
    """Whether a line item is returned, from its part's brand and its discount, as binary features."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    row = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    label = F.when(F.col("l_returnflag") == "R", 1).otherwise(-1)
    features = F.array(F.regexp_extract("p_brand", "[0-9]+", 0).cast("long"), 1000 + F.round(F.col("l_discount") * 100).cast("long"))
    found = recommend.adpredictor(li.select(row.alias("row_id"), label.alias("label"), F.explode(features).alias("feature")), iterations=1)
    return found.select("feature", F.round("mu", 4).alias("mu"), F.round("sigma2", 6).alias("sigma2"))


# -- clustering --------------------------------------------------------------------------------------------------------
def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("point"), "label")


_STEP = """p AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS point, label FROM embeddings),
flat AS (SELECT label, unnest(point) AS x, generate_subscripts(point, 1) AS k FROM p),
centres AS MATERIALIZED (SELECT label AS cluster, list(x ORDER BY k) AS c FROM (SELECT label, k, round(avg(x), 6) AS x FROM flat GROUP BY 1, 2) GROUP BY 1),
dists AS (SELECT id, cluster, list_sum(list_transform(list_zip(point, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM p, centres),
best AS (SELECT id, cluster FROM (SELECT id, cluster, row_number() OVER (PARTITION BY id ORDER BY dist, cluster) AS place FROM dists) WHERE place = 1)"""


@query(f"WITH {_STEP} SELECT cluster, count(*) AS n FROM best GROUP BY 1")
def m_lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    """Sizes after one round from the label means."""
    p = points(spark, d)
    means = vector_sum(p, ["label"], "point").join(p.groupBy("label").agg(F.count("*").alias("n")), "label")
    centres = means.select(F.col("label").alias("cluster"), F.transform("point", lambda x: F.round(x / F.col("n"), 6)).alias("c"))
    return cluster.lloyd_step(p, centres).select("cluster", "n")


@query("SELECT label, list(x ORDER BY k) AS total FROM (SELECT label, k, round(sum(x), 4) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def m_vector_sum(spark: SparkSession, d: str) -> DataFrame:
    return vector_sum(points(spark, d), ["label"], "point").select("label", F.transform("point", lambda x: F.round(x, 4)).alias("total"))


def _means(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, c): the means of the clusters."""
    placed = points.select("id", "point").join(labels.select("id", "cluster"), "id")
    sums = vector_sum(placed, ["cluster"], "point").join(placed.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
    return sums.select("cluster", F.transform("point", lambda x: x / F.col("n")).alias("c"))


@query("SELECT count(*) AS n_points, 10 AS n_clusters, TRUE AS settled, TRUE AS cheaper FROM embeddings")
def m_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Whether one more round, by another way of computing, changes no cluster's size, and whether the cost is below that of one
    cluster."""
    p = points(spark, d)
    found = written(cluster.kmeans(p, 10)[0], "kmeans")
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("dist").alias("cost"))
    again = cluster.lloyd_step(p, _means(p, found)).select("cluster", F.col("n").alias("m"))
    middle = _means(p, p.select("id", F.lit(0).alias("cluster"))).select(F.col("c").alias("middle"))
    one = p.crossJoin(F.broadcast(middle)).agg(F.sum(cluster.squared_distance("point", "middle")).alias("whole"))  # one row
    both = sizes.join(again, "cluster", "full").agg(F.sum("n").alias("n_points"), F.count("*").cast("int").alias("n_clusters"), F.bool_and(F.col("n").eqNullSafe(F.col("m"))).alias("settled"), F.sum("cost").alias("cost"))
    return both.crossJoin(F.broadcast(one)).select("n_points", "n_clusters", "settled", (F.col("cost") < F.col("whole")).alias("cheaper"))


@query("SELECT count(*) AS n_points, TRUE AS rewarded FROM embeddings")
def m_kmeans_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive vectors reward each other for being together: more of them are than without rewards."""
    p = points(spark, d)
    links = p.select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1.0).alias("w"))
    together = lambda x: links.join(x.toDF("i", "a"), "i").join(x.toDF("j", "b"), "j").filter("a = b").count()
    found = written(cluster.kmeans_with_rewards(p, links, 10, 5), "rewards")
    plain = written(cluster.kmeans(p, 10)[0].select("id", "cluster"), "plain")
    return found.agg(F.countDistinct("id").alias("n_points")).withColumn("rewarded", F.lit(together(found) > together(plain)))


def _cut(edges: DataFrame, labels: DataFrame) -> float:
    """The weight between clusters as a share of all."""
    placed = edges.join(labels.toDF("i", "a"), "i").join(labels.toDF("j", "b"), "j")
    return placed.agg(F.sum(F.when(F.col("a") != F.col("b"), F.col("w")).otherwise(0.0)) / F.sum("w")).first()[0]


@query("SELECT count(*) AS n_points, 4 AS n_clusters, TRUE AS better_than_chance FROM embeddings")
def m_spectral_clustering(spark: SparkSession, d: str) -> DataFrame:
    """Whether less of the similarity lies between the clusters than between hashed ones."""
    p = points(spark, d)
    found = written(cluster.spectral_clustering(p, 4, 2.0), "clusters")
    near = written(cluster.similarity_graph(p, 2.0, 10), "near")
    chance = found.select("id", F.pmod(mixed(F.col("id")), F.lit(4)).alias("cluster"))
    return found.agg(F.countDistinct("id").alias("n_points"), F.countDistinct("cluster").cast("int").alias("n_clusters")).withColumn("better_than_chance", F.lit(_cut(near, found) < _cut(near, chance)))


@query("WITH p AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), w AS MATERIALIZED (SELECT a.id AS i, b.id AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p a JOIN p b ON a.id <> b.id), near AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d) AS place FROM w) WHERE place <= 5) SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM near")
def m_similarity_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of points of which at least one is among the five most similar to the other."""
    return cluster.similarity_graph(points(spark, d), 2.0, 5).select("i", "j")


@query("WITH p AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON a.id < b.id WHERE exp(-round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) / 2.0) >= 0.5")
def m_similarity_graph(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of points whose Gaussian similarity is at least one half."""
    return cluster.similarity_graph(points(spark, d), 1.0, threshold=0.5).select("i", "j")


@query(f"WITH {CONSEC} SELECT count(*) AS n_vertices, 3 AS n_clusters, TRUE AS better_than_chance FROM ids")
def m_partition_graph(spark: SparkSession, d: str) -> DataFrame:
    """Whether fewer edges are cut than by hashed parts of the same number."""
    g = Graph.build(written(consecutive_customers(spark, d).edges.select("src", "dst"), "consecutive"))
    found = written(cluster.partition_graph(g, 3), "parts")
    # Both labels of an end in one pass: the hashed one is a function of the id.
    end = lambda x, label: found.select(F.col("id").alias(x), F.col("cluster").alias(label)).hint("shuffle_hash")
    placed = g.edges.join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    chance = lambda x: F.pmod(mixed(F.col(x)), F.lit(3))
    cut, by_chance = placed.agg(F.count(F.when(F.col("a") != F.col("b"), 1)), F.count(F.when(chance("src") != chance("dst"), 1))).first()
    return found.agg(F.countDistinct("id").alias("n_vertices"), F.countDistinct("cluster").cast("int").alias("n_clusters")).withColumn("better_than_chance", F.lit(cut < by_chance))


@query("SELECT vec_id AS i, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 6)) AS vector FROM embeddings")
def m_normalized_rows(spark: SparkSession, d: str) -> DataFrame:
    cells = points(spark, d).select(F.col("id").alias("i"), F.posexplode("point").alias("k", "v"))
    return normalized_rows(cells).select("i", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


# -- topics ------------------------------------------------------------------------------------------------------------
#: Letters of scripts written without spaces; what is cut from them are pairs of letters with their marks.
SPACELESS = r"[\p{L}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]"
WORDS = rf"[\p{{L}}&&[^{SPACELESS}]][\p{{L}}\p{{M}}&&[^{SPACELESS}]]*"
PAIRS = rf"(?=({SPACELESS}(?:\p{{M}}*+{SPACELESS}\p{{M}}*+|(?<!{SPACELESS}\p{{M}}{{0,8}}{SPACELESS})\p{{M}}*+(?!{SPACELESS}))))"


def words(spark: SparkSession, d: str) -> DataFrame:
    """(doc, text of the word, n): runs of letters in lower case; of scripts without spaces all pairs of neighbouring letters,
    or the letter that stands alone."""
    text = F.lower("text")
    found = F.concat(F.regexp_extract_all(text, F.lit(WORDS), 0), F.regexp_extract_all(text, F.lit(PAIRS), 1))
    return _counted(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(found).alias("w")))


def _counted(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc", "w").agg(F.least(F.count("*"), F.lit(topics.MAX_COUNT)).alias("n"))


#: The same in the SQL's dialect, which has no look-around: a letter of a spaceless script with its marks, runs of such, and words.
_SCRIPTS = r"\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"


def _words_sql() -> str:
    # Letters of those scripts: no digits, marks or punctuation, which the script classes also hold.
    word = rf"[^\P{{L}}{_SCRIPTS}](?:[^\P{{L}}{_SCRIPTS}]|\p{{M}})*"
    unit = rf"(?:[^\P{{L}}])\p{{M}}*"
    return f"""raw AS (SELECT doc_id AS doc, lower(text) AS t FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc, unnest(regexp_extract_all(regexp_replace(t, '[^\\p{{L}}\\p{{M}}]|[^\\P{{L}}{_SCRIPTS}]', ' ', 'g'), '[^ ]+')) AS run FROM raw),
units AS (SELECT doc, regexp_extract_all(run, '{unit}') AS u FROM runs),
tokens AS (SELECT doc, unnest(regexp_extract_all(t, '{word}')) AS w FROM raw
UNION ALL SELECT doc, unnest(CASE WHEN len(u) = 1 THEN u ELSE list_transform(range(1, len(u)), lambda i: u[i] || u[i + 1]) END) FROM units)"""


@query(f"WITH {_words_sql()} SELECT doc, w, least(count(*), 100) AS n FROM tokens GROUP BY 1, 2")
def m_bag_of_words(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).select("doc", "w", F.col("n").cast("long").alias("n"))


def _bag(spark: SparkSession, d: str) -> DataFrame:
    return written(topics.bag_of_words(words(spark, d).select("doc", F.xxhash64("w").alias("word"), "n")), "bag")


def _checked_topics(spark: SparkSession, d: str, fit) -> DataFrame:
    """Documents with words, whether the topics of words and of documents hold all tokens, and whether the likelihood rises."""
    bag = _bag(spark, d)
    docs, words_, trend = fit(bag)
    held = lambda x: x.agg(F.sum(F.aggregate("total", F.lit(0.0), lambda a, y: a + y))).first()[0]
    tokens = bag.agg(F.sum("n")).first()[0]
    conserved = abs(held(docs) - tokens) < 1e-6 * tokens and abs(held(words_) - tokens) < 1e-6 * tokens
    top = topics.top_words(words_, 10).count()
    return docs.agg(F.count("*").alias("n_documents")).withColumns({"conserved": F.lit(bool(conserved)), "rises": F.lit(bool(trend[-1] > trend[0])), "n_top_words": F.lit(top).cast("long")})


_TOPICS = r"SELECT count(*) AS n_documents, TRUE AS conserved, TRUE AS rises, 50::BIGINT AS n_top_words FROM documents WHERE regexp_matches(text, '\p{L}')"


@query(_TOPICS)
def m_lda_cvb0(spark: SparkSession, d: str) -> DataFrame:
    return _checked_topics(spark, d, lambda bag: topics.lda_cvb0(bag, 5, 3))


@query(_TOPICS)
def m_lda_gibbs(spark: SparkSession, d: str) -> DataFrame:
    return _checked_topics(spark, d, lambda bag: topics.lda_gibbs(bag, 5, 3))


# -- linear systems ----------------------------------------------------------------------------------------------------
def system(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A diagonally dominant matrix over the customers of consecutive orders, and the right side 1."""
    e = consecutive_customers(spark, d).edges
    w = e.groupBy(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg(F.sum("weight").alias("w"))
    off = w.select((-F.col("w")).alias("v"), F.inline(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).select("i", "j", "v")
    off = written(off, "off")
    diagonal = off.groupBy("i").agg((1 - F.sum("v")).alias("v")).select("i", F.col("i").alias("j"), "v")
    return off.unionByName(diagonal), diagonal.select("i", F.lit(1.0).alias("v"))


_SYSTEM = f"{CONSEC}, w AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM edges GROUP BY 1, 2), off AS MATERIALIZED (SELECT a AS i, b AS j, -w AS v FROM w UNION ALL SELECT b, a, -w FROM w), diag AS MATERIALIZED (SELECT i, 1 - sum(v) AS d FROM off GROUP BY i)"


def _jacobi_sql(n: int) -> str:
    steps = ["x0 AS (SELECT i, 0.0::DOUBLE AS x FROM diag)"]
    for k in range(1, n + 1):
        steps.append(f"x{k} AS MATERIALIZED (SELECT diag.i, (1 - coalesce(p, 0)) / d AS x FROM diag LEFT JOIN (SELECT off.i, sum(v * x) AS p FROM off JOIN x{k - 1} ON x{k - 1}.i = off.j GROUP BY off.i) q ON q.i = diag.i)")
    return f"WITH {_SYSTEM}, {', '.join(steps)} SELECT i, round(x, 6) AS x FROM x{n}"


@query(_jacobi_sql(10))
def m_jacobi(spark: SparkSession, d: str) -> DataFrame:
    a, b = system(spark, d)
    return linalg.jacobi(a, b, 10).select("i", F.round("x", 6).alias("x"))


@query(f"WITH {_SYSTEM} SELECT i, sum(v) + any_value(d) AS v FROM off JOIN diag USING (i) GROUP BY i")
def m_matvec(spark: SparkSession, d: str) -> DataFrame:
    """The matrix times the vector of ones."""
    a, b = system(spark, d)
    return matvec(a, b)


@query(f"WITH {_SYSTEM} SELECT diag.i, round((2 * (coalesce(sum(v), 0) + any_value(d)) - 3) / 4, 6) AS v FROM diag LEFT JOIN off ON off.j = diag.i GROUP BY diag.i")
def m_axb(spark: SparkSession, d: str) -> DataFrame:
    a, b = system(spark, d)
    return axb(a, b, b, 2.0, -3.0, 4.0, transpose=True).select("i", F.round("v", 6).alias("v"))


# -- graphical models and draws ----------------------------------------------------------------------------------------
def _potts_sql(iterations: int, damping: float, smoothing: float = 0.5) -> str:
    """Belief propagation on the tree of places, one row for each message and state."""
    states = ", ".join(f"({i}, '{x}')" for i, x in enumerate(SEGMENTS))
    steps = [
        f"raw AS (SELECT ids.id, s, CASE WHEN c_mktsegment IS NULL OR c_mktsegment = name THEN 0.0 ELSE -2.0 END::DOUBLE AS p FROM ids LEFT JOIN customer ON c_custkey = ids.id, (VALUES {states}) t(s, name))",
        "prior AS MATERIALIZED (SELECT id, s, p - ln(sum(exp(p)) OVER (PARTITION BY id)) AS p FROM raw)",
        "m0 AS MATERIALIZED (SELECT a, b, s, 0.0::DOUBLE AS m FROM near, range(5) t(s))",
    ]
    for k in range(1, iterations + 1):
        steps.append(f"b{k} AS MATERIALIZED (SELECT id, p.s, any_value(p) + coalesce(sum(m), 0) AS b FROM prior p LEFT JOIN m{k - 1} m ON m.b = id AND m.s = p.s GROUP BY 1, 2)")
        steps.append(f"c{k} AS (SELECT o.a, o.b, o.s, o.m, x.b - back.m AS c FROM m{k - 1} o JOIN m{k - 1} back ON back.a = o.b AND back.b = o.a AND back.s = o.s JOIN b{k} x ON x.id = o.a AND x.s = o.s)")
        steps.append(f"o{k} AS (SELECT a, b, s, m, ln(exp(c) + exp(-{smoothing}) * (sum(exp(c)) OVER (PARTITION BY a, b) - exp(c))) AS o FROM c{k})")
        steps.append(f"m{k} AS MATERIALIZED (SELECT a, b, s, {1 - damping} * (o - ln(sum(exp(o)) OVER (PARTITION BY a, b))) + {damping} * m AS m FROM o{k})")
    steps.append(f"last AS (SELECT id, p.s, any_value(p) + coalesce(sum(m), 0) AS b FROM prior p LEFT JOIN m{iterations} m ON m.b = id AND m.s = p.s GROUP BY 1, 2)")
    return f"WITH {TREE}, {NEAR}, {', '.join(steps)} SELECT id, s::INT AS state, round(b - ln(sum(exp(b)) OVER (PARTITION BY id)), 5) AS belief FROM last"


def _place_priors(spark: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    g = place_tree(spark, d)
    seen = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    prior = F.array(*(F.when(F.col("c_mktsegment").isNull(), 0.0).when(F.col("c_mktsegment") == s, 0.0).otherwise(-2.0) for s in SEGMENTS))
    return g, g.vertices.join(seen, "id", "left").select("id", prior.alias("prior"))


@query(_potts_sql(4, 0.1))
def m_potts_bp(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs about the segment of places from that of their customers, after four damped rounds."""
    g, priors = _place_priors(spark, d)
    found = graphical.potts_bp(priors, g.edges, smoothing=0.5, iterations=4)
    return found.select("id", F.posexplode("belief").alias("state", "belief")).withColumn("belief", F.round("belief", 5))


@query(_potts_sql(6, 0.0))
def m_factor_graph_bp(spark: SparkSession, d: str) -> DataFrame:
    """The same as a factor graph with a table for each link; six rounds are enough for the exact beliefs of this tree."""
    g, priors = _place_priors(spark, d)
    n = len(SEGMENTS)
    table_ = F.array(*(F.lit(0.0 if i == j else -0.5) for i in range(n) for j in range(n)))
    factors = g.edges.select(F.col("src").alias("fid"), F.array("src", "dst").alias("scope"), F.array(F.lit(n), F.lit(n)).alias("sizes"), table_.alias("logp"))
    found = graphical.factor_graph_bp(priors, factors, iterations=6)
    return found.select("id", F.posexplode("belief").alias("state", "belief")).withColumn("belief", F.round("belief", 5))


def _picture(spark: SparkSession, pixels: int) -> tuple[int, DataFrame, DataFrame]:
    """(pixels, unaries, pairs) of a noisy picture of at most so many pixels."""
    n = int(pixels**0.5)
    seen, links = graphical.noisy_image(spark, n, n)
    potts = F.array(*(F.lit(0.0 if i == j else -1.0) for i in range(3) for j in range(3)))
    pairs = links.select((F.col("src") * (n * n) + F.col("dst")).alias("eid"), F.col("src").alias("i"), F.col("dst").alias("j"), potts.alias("theta"))
    return n * n, seen.select("id", F.col("prior").alias("theta")), pairs


def _value(unaries: DataFrame, pairs: DataFrame, labels: DataFrame) -> float:
    """What an assignment is worth."""
    own = unaries.join(labels, "id").agg(F.sum(F.col("theta")[F.col("map_state").cast("int")])).first()[0]
    ends = pairs.join(labels.toDF("i", "a"), "i").join(labels.toDF("j", "b"), "j")
    return own + ends.agg(F.sum(F.col("theta")[(F.col("a") * 3 + F.col("b")).cast("int")])).first()[0]


@query("SELECT (floor(sqrt(count(*))) * floor(sqrt(count(*))))::BIGINT AS n_pixels, TRUE AS dual_falls, TRUE AS dual_bounds FROM orders")
def m_mplp_image(spark: SparkSession, d: str) -> DataFrame:
    """A noisy picture with a pixel for each order, cleaned: the dual never rises and stays above what the labels are worth."""
    n, unaries, pairs = _picture(spark, table(spark, d, "orders").count())
    labels, duals = graphical.mplp(unaries, pairs, 3)
    labels = written(labels.select("id", "map_state"), "labels")
    falls, bounds = all(b <= a + 1e-6 for a, b in zip(duals, duals[1:])), _value(unaries, pairs, labels) <= duals[-1] + 1e-6
    return labels.agg(F.countDistinct("id").alias("n_pixels")).withColumns({"dual_falls": F.lit(falls), "dual_bounds": F.lit(bool(bounds))})


@query("SELECT m AS method, (floor(sqrt(count(*))) * floor(sqrt(count(*))))::BIGINT AS n_pixels, TRUE AS better, TRUE AS dual_bounds FROM customer, (VALUES ('ad3'), ('admm'), ('projected'), ('symmetric')) t(m) GROUP BY m")
def m_dual_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """By method: the labels are worth at least those of the pixels alone, and every dual is above every primal value."""
    n, unaries, pairs = _picture(spark, table(spark, d, "customer").count())
    alone = unaries.select("id", (F.array_position("theta", F.array_max("theta")) - 1).alias("map_state"))
    least, rows = _value(unaries, pairs, alone), []
    for method in ("ad3", "admm", "projected", "symmetric"):
        if method == "ad3":
            labels, duals, primals = graphical.alternating_decomposition(unaries, pairs, 6)
        else:
            labels, duals, primals = graphical.dual_decomposition(unaries, pairs, 6, method=method)
        worth = _value(unaries, pairs, labels)
        rows.append((method, labels.select("id").distinct().count(), bool(worth >= least - 1e-6 and abs(worth - max(primals)) < 1e-6), bool(min(duals) >= max(primals) - 1e-6)))
    return spark.createDataFrame(rows, "method string, n_pixels long, better boolean, dual_bounds boolean")


@query(f"SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY -ln({sql_draw('c_custkey', 0)}) / c_acctbal, c_custkey LIMIT 1")
def m_reservoir_one(spark: SparkSession, d: str) -> DataFrame:
    """A customer drawn in proportion to its balance."""
    return reservoir_one(table(spark, d, "customer"), F.col("c_acctbal"), F.col("c_custkey")).select("c_custkey")


@query("SELECT l_returnflag, round(product(1 + l_discount / 1000), 6) AS growth FROM lineitem GROUP BY 1")
def m_product(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.product(1 + F.col("l_discount") / 1000), 6).alias("growth"))


@query("WITH l AS (SELECT id, lower(trim(label)) AS label FROM labelled WHERE id IS NOT NULL AND label IS NOT NULL AND trim(label) NOT IN ('', '?')), c AS (SELECT id, label, count(*) AS n FROM l GROUP BY 1, 2) SELECT id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS p FROM c) WHERE p = 1")
def m_labels(spark: SparkSession, d: str) -> DataFrame:
    """One label per user: the most frequent spelling-free one, the smallest of several."""
    rows = table(spark, d, "labelled").select("id", F.lower(F.trim("label")).alias("label")).filter("id IS NOT NULL AND label IS NOT NULL AND label NOT IN ('', '?')")
    counts = rows.groupBy("id", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"))
    return best.select("id", "b.label", (-F.col("b.m")).alias("n"))


def _spread_sql(rounds: int) -> str:
    labels = ORACLES["m_labels"].removeprefix("WITH ").split(" SELECT id, label, n FROM ")
    steps = [f"given AS MATERIALIZED (SELECT id, label FROM {labels[1]})", "l0 AS MATERIALIZED (SELECT id, label FROM (SELECT id FROM ids UNION SELECT id FROM given) LEFT JOIN given USING (id))"]
    for k in range(1, rounds + 1):
        steps.append(f"n{k} AS MATERIALIZED (SELECT a, label, count(*) AS n FROM near JOIN l{k - 1} ON id = b WHERE label IS NOT NULL GROUP BY 1, 2), l{k} AS MATERIALIZED (SELECT x.id, coalesce(z.label, x.label) AS label FROM l{k - 1} x LEFT JOIN (SELECT a, label FROM (SELECT a, label, row_number() OVER (PARTITION BY a ORDER BY n DESC, label) AS p FROM n{k}) WHERE p = 1) z ON z.a = x.id)")
    return f"""WITH {_RATINGS}, {labels[0]}, edges AS MATERIALIZED (SELECT DISTINCT "user" AS src, item + {10**10} AS dst FROM ratings_clean), ids AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges), {NEAR}, {', '.join(steps)} SELECT id, label FROM l{rounds} WHERE id < {10**10}"""


@query(_spread_sql(3))
def m_label_users(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all users, spread over common ratings for three rounds."""
    r = clean_ratings(spark, d).select(F.col("user").alias("src"), (F.col("item") + 10**10).alias("dst")).distinct()
    g = Graph.build(r, m_labels(spark, d).select("id", "label"))
    return label_propagation(g, max_iterations=3).vertices.filter(F.col("id") < 10**10).select("id", "label")
