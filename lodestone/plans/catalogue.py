"""Registered queries of the analytics operators and their SQL twins, over whole tables.

Results are rounded on both sides, so that the order of additions does not show.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import stats
from lodestone.operators import decomp, linear, neighbors, nonlinear, pairs, spline, split, svm, trees
from lodestone.operators.cluster import DBSCAN, KMeans
from lodestone.sources.csvio import read_csv
from lodestone.sources.persist import load_model, model_metadata, save_model
from lodestone.sources.staging import shared_dir
from lodestone.sources.store import DataStore, drop_missing, transpose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; -0.0 becomes 0.0."""
    return df.select(*(F.round(F.col(f"`{c}`"), digits).__add__(0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For joins that widen components where they compare them."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))


def columns(template: str, names=PRICES) -> str:
    return ", ".join(template.format(c=c) for c in names)


# descriptive statistics


@query(f"SELECT {columns('round(avg({c}), 4) AS {c}')} FROM lineitem")
def stats_mean(spark, sf_dir):
    return rounded(stats.mean(table(spark, sf_dir, "lineitem"), PRICES), 4)


@query(f"SELECT l_returnflag, {columns('round(avg({c}), 4) AS {c}')} FROM lineitem GROUP BY l_returnflag")
def stats_mean_grouped(spark, sf_dir):
    return rounded(stats.mean(table(spark, sf_dir, "lineitem"), PRICES, group_by=("l_returnflag",)), 4)


@query("SELECT round(exp(avg(ln(l_quantity))), 4) AS l_quantity, round(exp(avg(ln(l_extendedprice))), 4) AS l_extendedprice FROM lineitem")
def stats_geometric_mean(spark, sf_dir):
    return rounded(stats.geometric_mean(table(spark, sf_dir, "lineitem"), PRICES[:2]), 4)


@query("SELECT round(count(*) / sum(1 / l_quantity), 4) AS l_quantity, round(count(*) / sum(1 / l_extendedprice), 4) AS l_extendedprice FROM lineitem")
def stats_harmonic_mean(spark, sf_dir):
    return rounded(stats.harmonic_mean(table(spark, sf_dir, "lineitem"), PRICES[:2]), 4)


@query(f"SELECT {columns('round(var_samp({c}), 2) AS {c}')} FROM lineitem")
def stats_variance(spark, sf_dir):
    return rounded(stats.variance(table(spark, sf_dir, "lineitem"), PRICES), 2)


_SHARES = ["l_quantity", "l_discount", "l_tax"]


@query(f"SELECT {columns('round(sum(({c} - m_{c}) * ({c} - m_{c})) / 7, 4) AS {c}', _SHARES)} FROM lineitem, (SELECT {columns('avg({c}) AS m_{c}', _SHARES)} FROM lineitem)")
def stats_variance_dof(spark, sf_dir):
    return rounded(stats.variance(table(spark, sf_dir, "lineitem"), _SHARES, dof=7), 4)


@query(
    f"SELECT {columns('round(sqrt(count(*)) * sum(pow({c} - m_{c}, 3)) / pow(sum(pow({c} - m_{c}, 2)), 1.5), 6) AS {c}')} "
    f"FROM lineitem, (SELECT {columns('avg({c}) AS m_{c}')} FROM lineitem)"
)
def stats_skewness(spark, sf_dir):
    return rounded(stats.skewness(table(spark, sf_dir, "lineitem"), PRICES))


@query(f"SELECT {columns('round(kurtosis_pop({c}), 6) AS {c}')} FROM lineitem")
def stats_kurtosis(spark, sf_dir):
    return rounded(stats.kurtosis(table(spark, sf_dir, "lineitem"), PRICES))


@query("SELECT round(avg(pow((o_totalprice - m) / 1000, 3)), 2) AS price FROM orders, (SELECT avg(o_totalprice) AS m FROM orders)")
def stats_moment(spark, sf_dir):
    return rounded(stats.moment(table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("price")), ["price"], 3), 2)


@query("SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 3, 6) AS value FROM lineitem")
def stats_mean_rows(spark, sf_dir):
    return rounded(stats.mean(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "row").select("l_orderkey", "l_linenumber", "value"))


@query("SELECT round(var_samp(v), 6) AS value FROM (SELECT unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem)")
def stats_variance_all(spark, sf_dir):
    return rounded(stats.variance(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], axis="all"))


@query(f"SELECT {columns('round(sum({c}), 1) AS {c}')} FROM lineitem")
def stats_sum(spark, sf_dir):
    return rounded(stats.total(table(spark, sf_dir, "lineitem"), PRICES), 1)


_Q = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
_H = {
    1: "n * q", 2: "n * q + 0.5", 3: "n * q - 0.5", 4: "n * q", 5: "n * q + 0.5", 6: "(n + 1) * q", 7: "(n - 1) * q + 1",
    8: "(n + CAST(1 AS DOUBLE) / 3) * q + CAST(1 AS DOUBLE) / 3", 9: "(n + 0.25) * q + CAST(0.375 AS DOUBLE)",
}


def _quantile_sql(kind: int, qs=_Q, method=True) -> str:
    h = f"(CAST({_H[kind]} AS DOUBLE) - 1)"
    low, high, w = {
        1: (f"ceil({h})", f"ceil({h})", "0"),
        2: (f"ceil({h} - 0.5)", f"floor({h} + 0.5)", "0.5"),
        3: (f"round_even({h}, 0)", f"round_even({h}, 0)", "0"),
    }.get(kind, (f"floor({h})", f"ceil({h})", None))
    clamp = lambda x: f"greatest(0, least(n - 1, {x}))"
    w = w or f"CASE WHEN {clamp(low)} = {clamp(high)} THEN 0 ELSE {h} - {clamp(low)} END"
    return (
        f"SELECT {f'{kind} AS method, ' if method else ''}'l_extendedprice' AS \"column\", q, round(a.x + w * (b.x - a.x), 4) AS value FROM "
        f"(SELECT q, CAST({clamp(low)} AS BIGINT) AS lo, CAST({clamp(high)} AS BIGINT) AS hi, {w} AS w FROM (SELECT unnest({qs}::DOUBLE[]) AS q), (SELECT CAST(count(*) AS DOUBLE) AS n FROM lineitem)) p "
        "JOIN s a ON a.r = p.lo JOIN s b ON b.r = p.hi"
    )


_SORTED = "WITH s AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r FROM lineitem) "


@query(_SORTED + " UNION ALL ".join(_quantile_sql(k) for k in range(1, 10)))
def quantile_types(spark, sf_dir):
    return rounded(stats.quantile(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], _Q, list(range(1, 10))), 4)


@query(_SORTED + _quantile_sql(6, [0.0, 0.25, 0.5, 0.75, 1.0], False))
def five_point_summary(spark, sf_dir):
    return rounded(stats.five_point_summary(table(spark, sf_dir, "lineitem"), ["l_extendedprice"]), 4)


def _pair_sql(fn: str, digits: int) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS \"row\", '{b}' AS col, round({fn.format(a=a, b=b)}, {digits}) AS value FROM lineitem" for a in PRICES for b in PRICES)


@query(_pair_sql("covar_samp({a}, {b})", 4))
def covariance_matrix(spark, sf_dir):
    return rounded(stats.covariance_matrix(table(spark, sf_dir, "lineitem"), PRICES), 4)


def _corr_sql(a: str, b: str) -> str:
    if a == b or "one" in (a, b):
        return f"SELECT '{a}' AS \"row\", '{b}' AS col, CAST({int(a == b)} AS DOUBLE) AS value"
    return f"SELECT '{a}' AS \"row\", '{b}' AS col, round(corr({a}, {b}), 6) AS value FROM lineitem"


@query(" UNION ALL ".join(_corr_sql(a, b) for a in (*PRICES, "one") for b in (*PRICES, "one")))
def correlation_matrix(spark, sf_dir):
    return rounded(stats.correlation_matrix(table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0)), [*PRICES, "one"]))


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS p_size FROM part")
def standardize(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return rounded(stats.standardize(df, ["p_retailprice", "p_size"]))


@query("SELECT p_partkey, round(p_retailprice * 2 + 10, 4) AS p_retailprice FROM part")
def standardize_reverse(spark, sf_dir):
    return rounded(stats.standardize(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], [10.0], [2.0], reverse=True), 4)


@query("SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linestatus) = 1 AS is_mode FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)")
def most_frequent_class(spark, sf_dir):
    return stats.most_frequent(table(spark, sf_dir, "lineitem"), "l_linestatus", ("l_returnflag",))


# tables, selections, files


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS row_id, c_custkey, c_name FROM customer QUALIFY (row_id BETWEEN 10 AND 99 OR row_id BETWEEN 120 AND 140) AND NOT row_id BETWEEN 50 AND 60")
def store_selection(spark, sf_dir):
    store = DataStore(table(spark, sf_dir, "customer"), ["c_custkey"])
    store.select_columns("s", 0, 2).select_rows("s", 10, 99).remove_columns("s", 2, 2).select_rows("s", 120, 140)
    return store.remove_rows("s", 50, 60).extract("s")


@query("SELECT event_id, CASE WHEN value < 20 THEN NULL ELSE value END AS value FROM events WHERE NOT value < 20")
def drop_missing_rows(spark, sf_dir):
    gaps = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") < 20, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return drop_missing(gaps, ["value"])


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_id, o_orderkey, o_totalprice, o_custkey FROM orders")
def store_hconcat(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    left = DataStore(df.select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    right = DataStore(df.select("o_custkey", F.col("o_orderkey").alias("k")), ["k"])
    store = left.hconcat(right)
    return store.df.select("row_id", "o_orderkey", "o_totalprice", "o_custkey")


@query("SELECT CAST(row_number() OVER (ORDER BY s, k) - 1 AS BIGINT) AS row_id, k, name FROM (SELECT 0 AS s, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)")
def store_append_rows(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return DataStore(first, ["k"]).append_rows(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), ["k"]).df


@query("SELECT 'p_size' AS \"column\", p_partkey AS id, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT 'p_retailprice', p_partkey, p_retailprice FROM part")
def transpose_table(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return transpose(df, "p_partkey", ["p_size", "p_retailprice"])


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_acctbal > 0 AS good FROM customer")
def csv_round_trip(spark, sf_dir):
    import uuid

    path = f"{shared_dir(spark)}/lodestone/csv-{uuid.uuid4().hex}"
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", (F.col("c_acctbal") > 0).alias("good"))
    df.coalesce(1).write.csv(path, header=True)
    return read_csv(spark, path, header=True).drop("__row")


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS row_id, c_name AS name, CASE WHEN c_acctbal < 0 THEN -1 ELSE c_acctbal END AS balance FROM customer")
def csv_options(spark, sf_dir):
    """Another delimiter, decimal commas, and words for missing numbers, which a forced type reads as nulls."""
    import uuid

    path = f"{shared_dir(spark)}/lodestone/csv-{uuid.uuid4().hex}"
    amount = F.when(F.col("c_acctbal") < 0, F.lit("none")).otherwise(F.regexp_replace(F.col("c_acctbal").cast("string"), "[.]", ","))
    df = table(spark, sf_dir, "customer").orderBy("c_custkey").select(amount.alias("balance"), F.col("c_custkey").alias("key"))
    df.coalesce(1).write.csv(path, header=True, sep=";")
    found = read_csv(spark, path, header=True, delimiter=";", decimal=",", datatype="double", missing="warn").drop("__row")
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double").alias("key"), F.col("c_name").alias("name"))
    return DataStore(found.join(names, "key").select("key", "name", F.coalesce("balance", F.lit(-1.0)).alias("balance")), ["key"]).df.select("row_id", "name", "balance")


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS row_id, c_name, c_nationkey FROM customer QUALIFY row_id BETWEEN 20 AND 79")
def store_slice(spark, sf_dir):
    store = DataStore().load_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"])
    return store.select_slice("s", 20, 79, 1, 2).extract("s")


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS row_id, CASE WHEN row_number() OVER (ORDER BY c_custkey) = 8 THEN 'seven' ELSE c_name END AS name FROM customer")
def store_element(spark, sf_dir):
    """A labelled column is taken out by its label; one element of it was set."""
    store = DataStore(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    store.label_column(1, "name")
    store.set_element(7, 1, "seven")
    if store.get_element(7, 1) != "seven" or store.index("name") != 1 or store.label(1) != "name":
        raise RuntimeError("the element was not set")
    return store.extract_column("name")


_SPLIT = "md5(concat('0:', CAST({id} AS VARCHAR)))"


@query(f"SELECT doc_id, quality, CASE WHEN r <= floor(0.75 * n) THEN 'train' ELSE 'test' END AS part FROM (SELECT doc_id, quality, row_number() OVER (ORDER BY {_SPLIT.format(id='doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM labels)")
def train_test_split(spark, sf_dir):
    return split.train_test_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", train_size=0.75)


@query(
    f"""WITH c AS (SELECT quality, count(*) AS k FROM labels GROUP BY quality), t AS (SELECT CAST(floor(0.75 * sum(k)) AS BIGINT) AS tr, CAST(sum(k) AS DOUBLE) AS n FROM c),
e AS (SELECT quality, k, tr, floor(k * tr / n) AS f, k * tr / n - floor(k * tr / n) AS rest FROM c, t),
a AS (SELECT quality, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, quality) <= tr - sum(f) OVER () THEN 1 ELSE 0 END AS m FROM e)
SELECT l.doc_id, l.quality, CASE WHEN row_number() OVER (PARTITION BY l.quality ORDER BY {_SPLIT.format(id='l.doc_id')}, l.doc_id) <= m THEN 'train' ELSE 'test' END AS part FROM labels l JOIN a USING (quality)"""
)
def train_test_split_stratified(spark, sf_dir):
    return split.train_test_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", train_size=0.75, stratify="quality")


# distances, kernels, neighbours

_E = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
_FORMS = {
    "euclidean": "list_distance(a.x, b.x)", "sqeuclidean": "pow(list_distance(a.x, b.x), 2)",
    "manhattan": "list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2])))",
    "minkowski": "pow(list_sum(list_transform(list_zip(a.x, b.x), lambda z: pow(abs(z[1] - z[2]), 3))), CAST(1 AS DOUBLE) / 3)",
    "cosine": "CASE WHEN a.id = b.id THEN 0.0::DOUBLE ELSE list_cosine_distance(a.x, b.x) END", "inner product": "list_inner_product(a.x, b.x)",
    "euclidean_gemm": "list_distance(a.x, b.x)",
}


def _pairwise(metric: str):
    def run(spark, sf_dir):
        return pairs.pairwise_distances(stored_vectors(spark, sf_dir), metric=metric, p=3.0, digits=5)

    name = f"pairwise_{metric.replace(' ', '_')}"
    QUERIES[name] = run
    ORACLES[name] = f"SELECT a.id AS id_x, b.id AS id_y, round({_FORMS[metric]}, 5) + 0.0 AS dist FROM {_E} a, {_E} b"


for _metric in _FORMS:
    _pairwise(_metric)

_KERNEL_SQL = {
    "rbf": "exp(-0.05 * pow(list_distance(a.x, b.x), 2))", "linear": "list_inner_product(a.x, b.x)",
    "polynomial": "pow(0.05 * list_inner_product(a.x, b.x) + 1, 3)", "sigmoid": "tanh(0.05 * list_inner_product(a.x, b.x) + 1)",
}


def _kernel(name: str):
    def run(spark, sf_dir):
        return pairs.kernel_matrix(stored_vectors(spark, sf_dir), kernel=name, gamma=0.05, digits=5)

    QUERIES[f"kernel_{name}"] = run
    ORACLES[f"kernel_{name}"] = f"SELECT a.id AS id_x, b.id AS id_y, round({_KERNEL_SQL[name]}, 5) + 0.0 AS value FROM {_E} a, {_E} b"


for _name in _KERNEL_SQL:
    _kernel(_name)

_KNN = f"""SELECT id_x, rank, id_y, round(d, 5) AS dist FROM (SELECT a.id AS id_x, b.id AS id_y, {{d}} AS d,
CAST(row_number() OVER (PARTITION BY a.id ORDER BY {{d}} {{way}}, b.id) AS INTEGER) AS rank FROM {_E} a JOIN {_E} b ON a.id <> b.id) WHERE rank <= 5"""


@query(_KNN.format(d="list_distance(a.x, b.x)", way=""))
def knn_euclidean(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(pairs.knn(v, v, 5, exclude_self=True), 5)


@query(_KNN.format(d="list_inner_product(a.x, b.x)", way="DESC"))
def knn_inner_product(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(pairs.knn(v, v, 5, "inner product", exclude_self=True), 5)


@query(f"SELECT a.id AS id_x, b.id AS id_y, round(list_cosine_distance(a.x, b.x), 5) + 0.0 AS dist FROM {_E} a JOIN {_E} b ON a.id <> b.id AND list_cosine_distance(a.x, b.x) <= 0.5")
def radius_cosine(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(pairs.radius_join(v, v, 0.5, "cosine", exclude_self=True), 5)


@query("SELECT DISTINCT label FROM embeddings")
def knn_classes(spark, sf_dir):
    return neighbors.NearestNeighbors().fit(vectors(spark, sf_dir), label="label").classes()


@query(f"SELECT id, round(list_sum(list_transform(x, lambda e: e / sqrt(list_inner_product(x, x)))), 6) AS total, round(sqrt(list_inner_product(x, x)), 6) AS size FROM {_E}")
def normalized_rows(spark, sf_dir):
    from lodestone.functions.vectors import normalize

    v = vectors(spark, sf_dir).withColumn("u", normalize(F.col("x")))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    return rounded(v.select("id", add(F.col("u")).alias("total"), (add(F.zip_with("x", "u", lambda a, b: a * b))).alias("size")))


_VOTES = f"""WITH k AS ({_KNN.format(d="list_distance(a.x, b.x)", way="")}), v AS (SELECT id_x, label, sum({{w}}) AS w FROM k JOIN embeddings e ON e.vec_id = k.id_y GROUP BY ALL),
p AS (SELECT id_x AS id, label, w / sum(w) OVER (PARTITION BY id_x) AS proba FROM v) """


@query(_VOTES.format(w="1.0") + "SELECT id, label FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(proba, 12) DESC, label) = 1")
def knn_classify(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return neighbors.NearestNeighbors().fit(v, label="label").predict(v, exclude_self=True)


@query(_VOTES.format(w="1 / dist").replace("round(d, 5) AS dist", "d AS dist") + "SELECT id, label, round(proba, 5) AS proba FROM p")
def knn_proba_weighted(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(neighbors.NearestNeighbors(weights="distance").fit(v, label="label").predict_proba(v, exclude_self=True), 5)


@query(f"""WITH k AS ({_KNN.format(d="list_distance(a.x, b.x)", way="")}) SELECT id_x AS id, round(avg(CAST(label AS DOUBLE)), 5) AS prediction FROM k JOIN embeddings e ON e.vec_id = k.id_y GROUP BY id_x""")
def knn_regress(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(neighbors.NearestNeighbors().fit(v, target="label").predict_target(v, exclude_self=True), 5)


@query(
    f"""WITH n AS (SELECT a.id AS id, b.label AS label FROM {_E} a JOIN {_E} b ON a.id <> b.id AND list_distance(a.x, b.x) <= 0.6), c AS (SELECT id, label, count(*) AS k FROM n GROUP BY ALL),
f AS (SELECT id, label FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC, label) = 1), m AS (SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT e.vec_id AS id, coalesce(f.label, m.label) AS label FROM embeddings e CROSS JOIN m LEFT JOIN f ON f.id = e.vec_id"""
)
def radius_classify_outliers(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return neighbors.NearestNeighbors(radius=0.6, outlier_handling="most frequent").fit(v, label="label").predict(v, "radius", exclude_self=True)


_CENTROIDS = "(SELECT row_number() OVER (ORDER BY vec_id) - 1 AS g, CAST(embedding AS DOUBLE[]) AS c FROM embeddings ORDER BY vec_id LIMIT 8)"


@query(
    f"""WITH l AS (SELECT e.id, e.x, c.g, row_number() OVER (PARTITION BY e.id ORDER BY round(pow(list_distance(e.x, c.c), 2), 9), c.g) AS r FROM {_E} e, {_CENTROIDS} c),
f AS (SELECT q.id AS id_x, b.id AS id_y, pow(list_distance(q.x, b.x), 2) AS d FROM l q JOIN l b ON q.g = b.g AND q.r <= 6 AND b.r = 1),
t AS (SELECT id_x, id_y, d, CAST(row_number() OVER (PARTITION BY id_x ORDER BY round(d, 9), id_y) AS INTEGER) AS rank FROM f)
SELECT e.vec_id AS id_x, p.rank, t.id_y, round(coalesce(t.d, 'inf'::DOUBLE), 5) AS dist FROM embeddings e CROSS JOIN (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS rank) p LEFT JOIN t ON t.id_x = e.vec_id AND t.rank = p.rank"""
)
def ivf_search(spark, sf_dir):
    v = vectors(spark, sf_dir)
    centroids = [r.x for r in v.orderBy("id").limit(8).collect()]  # eight rows, as supplied centroids
    index = neighbors.ApproximateNeighbors(n_list=8, n_probe=6, n_neighbors=4).train_and_add(v, centroids)
    return rounded(index.kneighbors(v), 5)


# clustering

_START = [(5.0, 920.0), (25.0, 950.0), (45.0, 980.0)]
_POINTS = "(SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part)"
_NEAREST = "SELECT p.id, p.a, p.b, c.k, pow(p.a - c.a, 2) + pow(p.b - c.b, 2) AS d FROM {points} p, {centres} c QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY d, c.k) = 1"
_C0 = "(VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_START)) + ")"
_ROUNDS = f"""WITH c0(k, a, b) AS {_C0},
c1 AS (SELECT c0.k, coalesce(avg(n.a), any_value(c0.a)) AS a, coalesce(avg(n.b), any_value(c0.b)) AS b FROM c0 LEFT JOIN ({_NEAREST.format(points=_POINTS, centres='c0')}) n ON n.k = c0.k GROUP BY c0.k),
c2 AS (SELECT c1.k, coalesce(avg(n.a), any_value(c1.a)) AS a, coalesce(avg(n.b), any_value(c1.b)) AS b FROM c1 LEFT JOIN ({_NEAREST.format(points=_POINTS, centres='c1')}) n ON n.k = c1.k GROUP BY c1.k),
l AS ({_NEAREST.format(points=_POINTS, centres='c2')}) """


def part_points(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("x"))


def _kmeans(spark, sf_dir) -> tuple[KMeans, DataFrame]:
    points = part_points(spark, sf_dir)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        return KMeans(n_clusters=3, initialization_method="supplied", C=_START, max_iter=2, tol=0.0).fit(points), points


@query(_ROUNDS + "SELECT CAST(k AS BIGINT) AS cluster, round(a, 4) AS size, round(b, 4) AS price FROM c2")
def kmeans_centres(spark, sf_dir):
    model, _ = _kmeans(spark, sf_dir)
    return rounded(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(model.cluster_centres)], "cluster long, size double, price double"), 4)


@query(_ROUNDS + "SELECT id, CAST(k AS INTEGER) AS label FROM l")
def kmeans_predict(spark, sf_dir):
    model, points = _kmeans(spark, sf_dir)
    return model.predict(points).select("id", "label")


@query(_ROUNDS + "SELECT round(sum(d), 2) AS inertia FROM l")
def kmeans_inertia(spark, sf_dir):
    model, _ = _kmeans(spark, sf_dir)
    return rounded(spark.createDataFrame([(float(model.inertia),)], "inertia double"), 2)


@query(_ROUNDS + f"SELECT p.id, CAST(c.k AS BIGINT) AS cluster, round(sqrt(pow(p.a - c.a, 2) + pow(p.b - c.b, 2)), 4) AS dist FROM {_POINTS} p, c2 c")
def kmeans_transform(spark, sf_dir):
    model, points = _kmeans(spark, sf_dir)
    return rounded(model.transform(points).select("id", F.posexplode("distances").alias("cluster", "dist")).withColumn("cluster", F.col("cluster").cast("long")), 4)


_FAR = [*_START, (1e6, 1e6)]
_EMPTY = _ROUNDS.replace(_C0, "(VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_FAR)) + ")")


@query(_EMPTY + "SELECT CAST(k AS BIGINT) AS cluster, round(a, 4) AS size, round(b, 4) AS price FROM c2")
def kmeans_empty_cluster(spark, sf_dir):
    """A centre that no row is near stays where it is."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        model = KMeans(n_clusters=4, initialization_method="supplied", C=_FAR, max_iter=2, tol=0.0, algorithm="elkan").fit(part_points(spark, sf_dir))
    return rounded(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(model.cluster_centres)], "cluster long, size double, price double"), 4)


@query(
    """WITH p AS (SELECT c_custkey AS id, c_acctbal AS x FROM customer), n AS (SELECT id, x, count(*) OVER (ORDER BY x RANGE BETWEEN 9.0 PRECEDING AND 9.0 FOLLOWING) AS k FROM p),
c AS (SELECT id, x, CASE WHEN x - lag(x) OVER (ORDER BY x) <= 9.0 THEN 0 ELSE 1 END AS gap FROM n WHERE k >= 4), g AS (SELECT id, x, sum(gap) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS isle FROM c),
f AS (SELECT isle, min(id) AS first FROM g GROUP BY isle), m AS (SELECT g.id, g.x, dense_rank() OVER (ORDER BY first) - 1 AS label FROM g JOIN f USING (isle)),
b AS (SELECT n.id, min(m.label) AS label FROM n JOIN m ON abs(n.x - m.x) <= 9.0 WHERE n.k < 4 GROUP BY n.id)
SELECT n.id, CAST(coalesce(m.label, b.label, -1) AS INTEGER) AS label, n.k >= 4 AS is_core FROM n LEFT JOIN m USING (id) LEFT JOIN b USING (id)"""
)
def dbscan_balances(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array("c_acctbal").alias("x"))
    return DBSCAN(eps=9.0, min_samples=4).fit_predict(points)


# linear and nonlinear models


def _line(spark, model, names):
    return spark.createDataFrame(list(zip(names, map(float, model.coef), strict=True)), "term string, coef double")


@query("SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 3) AS coef FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 3) FROM lineitem")
def ols_one_feature(spark, sf_dir):
    model = linear.LinearModel(intercept=True).fit(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return rounded(_line(spark, model, ["l_quantity", "intercept"]), 3)


_TWO = """WITH m AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my FROM lineitem),
g AS (SELECT sum((l_quantity - ma) * (l_quantity - ma)) + {lam} AS aa, sum((l_quantity - ma) * (l_discount - mb)) AS ab, sum((l_discount - mb) * (l_discount - mb)) + {lam} AS bb,
sum((l_quantity - ma) * (l_extendedprice - my)) AS ay, sum((l_discount - mb) * (l_extendedprice - my)) AS bh FROM lineitem, m),
w AS (SELECT (ay * bb - bh * ab) / (aa * bb - ab * ab) AS a, (bh * aa - ay * ab) / (aa * bb - ab * ab) AS b FROM g)
SELECT 'l_quantity' AS term, round(a, 3) AS coef FROM w UNION ALL SELECT 'l_discount', round(b, 3) FROM w UNION ALL SELECT 'intercept', round(my - a * ma - b * mb, 3) FROM w, m"""


@query(_TWO.format(lam="0"))
def ols_two_features(spark, sf_dir):
    model = linear.LinearModel(intercept=True).fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return rounded(_line(spark, model, ["l_quantity", "l_discount", "intercept"]), 3)


@query(_TWO.format(lam="0"))
def ols_qr(spark, sf_dir):
    model = linear.LinearModel(intercept=True, solver="qr").fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return rounded(_line(spark, model, ["l_quantity", "l_discount", "intercept"]), 3)


@query(_TWO.format(lam="0"))
def ols_svd(spark, sf_dir):
    model = linear.LinearModel(intercept=True, solver="svd").fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return rounded(_line(spark, model, ["l_quantity", "l_discount", "intercept"]), 3)


@query(_TWO.format(lam="0"))
def ols_cg(spark, sf_dir):
    model = linear.LinearModel(intercept=True, solver="cg").fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return rounded(_line(spark, model, ["l_quantity", "l_discount", "intercept"]), 3)


@query(_TWO.format(lam="0"))
def ols_lbfgs(spark, sf_dir):
    model = linear.LinearModel(intercept=True, solver="lbfgs").fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return rounded(_line(spark, model, ["l_quantity", "l_discount", "intercept"]), 3)


@query(_TWO.format(lam="0"))
def ols_scaled(spark, sf_dir):
    """Features are scaled for the solver; the coefficients are those of the data."""
    model = linear.LinearModel(intercept=True, scaling="standardize").fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return rounded(_line(spark, model, ["l_quantity", "l_discount", "intercept"]), 3)


@query("SELECT round((regr_syy(l_extendedprice, l_quantity) - pow(regr_slope(l_extendedprice, l_quantity), 2) * regr_sxx(l_extendedprice, l_quantity)) / (2 * count(*)), 0) AS loss, CAST(1 AS INTEGER) AS n_iter FROM lineitem")
def ols_info(spark, sf_dir):
    model = linear.LinearModel(intercept=True).fit(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return rounded(model.info(spark).select("loss", "n_iter"), 0)


@query(_TWO.format(lam="50"))
def ridge_two_features(spark, sf_dir):
    model = linear.LinearModel(intercept=True, reg_lambda=50.0).fit(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return rounded(_line(spark, model, ["l_quantity", "l_discount", "intercept"]), 3)


@query(
    """WITH m AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice) AS my, count(*) AS n FROM lineitem),
g AS (SELECT sum((l_quantity - ma) * (l_quantity - ma)) AS aa, sum((l_quantity - ma) * (l_extendedprice - my)) AS ay, any_value(n) AS n FROM lineitem, m),
w AS (SELECT sign(ay) * greatest(abs(ay) - n * 2000 * 0.6, 0) / (aa + n * 2000 * 0.4) AS a FROM g)
SELECT 'l_quantity' AS term, round(a, 4) AS coef FROM w UNION ALL SELECT 'intercept', round(my - a * ma, 4) FROM w, m"""
)
def elastic_net_one_feature(spark, sf_dir):
    model = linear.LinearModel(intercept=True, reg_lambda=2000.0, reg_alpha=0.6).fit(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return rounded(_line(spark, model, ["l_quantity", "intercept"]), 4)


@query(ORACLES["elastic_net_one_feature"])
def elastic_net_warm_start(spark, sf_dir):
    """A second fit starts from the coefficients of another penalty."""
    df = table(spark, sf_dir, "lineitem")
    model = linear.LinearModel(intercept=True, reg_lambda=100.0, reg_alpha=0.6, warm_start=True).fit(df, ["l_quantity"], "l_extendedprice")
    return rounded(_line(spark, model.set_params(reg_lambda=2000.0).fit(df, ["l_quantity"], "l_extendedprice"), ["l_quantity", "intercept"]), 4)


@query("SELECT round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_r2(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return rounded(linear.LinearModel(intercept=True).fit(df, ["l_quantity"], "l_extendedprice").evaluate(df, "l_extendedprice").select("r2"))


@query("SELECT l_orderkey, l_linenumber, round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem) + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity, 2) AS prediction FROM lineitem")
def ols_predict(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    found = linear.LinearModel(intercept=True).fit(df, ["l_quantity"], "l_extendedprice").predict(df)
    return rounded(found.select("l_orderkey", "l_linenumber", "prediction"), 2)


def flagship(spark, sf_dir):
    """Standardised least squares of price on quantity, discount and tax."""
    df = stats.standardize(drop_missing(table(spark, sf_dir, "lineitem"), PRICES).select(*PRICES), PRICES)
    names = ["l_quantity", "l_discount", "l_tax"]
    return rounded(_line(spark, linear.LinearModel(intercept=True).fit(df, names, "l_extendedprice"), [*names, "intercept"]))


@query(
    """WITH r AS (SELECT corr(l_quantity, l_discount) AS ab, corr(l_quantity, l_tax) AS ac, corr(l_discount, l_tax) AS bc,
corr(l_quantity, l_extendedprice) AS ay, corr(l_discount, l_extendedprice) AS "by", corr(l_tax, l_extendedprice) AS cy FROM lineitem),
d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r)
SELECT 'l_quantity' AS term, round((ay * (1 - bc * bc) - ab * ("by" - bc * cy) + ac * ("by" * bc - cy)) / det, 6) + 0.0 AS coef FROM d
UNION ALL SELECT 'l_discount', round(("by" - bc * cy - ay * (ab - bc * ac) + ac * (ab * cy - "by" * ac)) / det, 6) + 0.0 FROM d
UNION ALL SELECT 'l_tax', round((cy - bc * "by" - ab * (ab * cy - "by" * ac) + ay * (ab * bc - ac)) / det, 6) + 0.0 FROM d
UNION ALL SELECT 'intercept', 0.0"""
)
def ols_standardized(spark, sf_dir):
    return flagship(spark, sf_dir)


def labelled(spark, sf_dir):
    """Documents with a label: scaled length and words as features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.log1p(F.col("n_chars").cast("double")).alias("a"), (F.size(F.split("text", " ")) / 100.0).alias("b"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.array("a", "b").alias("x"), F.col("quality").alias("label"))


@query()
def logistic_embeddings(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return linear.LinearModel(mod="logistic", intercept=True, reg_lambda=1.0).fit(v, "x", "label").predict(v, name="predicted").select("id", "label", "predicted")


@query()
def nlls_daily_events(spark, sf_dir):
    """level + swing * sin(hour / 24 turns + phase), fitted to the events' values."""
    import numpy as np

    df = table(spark, sf_dir, "events").select((F.hour("ts") / 24.0).alias("t"), F.col("value"))
    turn = lambda x, c: c["t"] * 2 * np.pi + x[2]
    fit = nonlinear.NonlinearLeastSquares(n_coef=3)
    fit.fit(df, ["t", "value"], [1.0, 1.0, 0.0], lambda x, c: x[0] + x[1] * np.sin(turn(x, c)) - c["value"])
    return rounded(spark.createDataFrame(list(zip(("level", "swing", "phase"), map(float, fit.x), strict=True)), "term string, coef double"), 4)


# decomposition


@query(
    """WITH m AS (SELECT covar_samp(a, a) AS aa, covar_samp(a, b) AS ab, covar_samp(b, b) AS bb FROM (SELECT CAST(p_size AS DOUBLE) AS a, p_retailprice / 10 AS b FROM part)),
e AS (SELECT aa, ab, bb, (aa + bb) / 2 AS mid, sqrt(pow((aa - bb) / 2, 2) + ab * ab) AS half FROM m)
SELECT 0 AS component, round(mid + half, 3) AS variance FROM e UNION ALL SELECT 1, round(mid - half, 3) FROM e"""
)
def pca_variance(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 10).alias("x"))
    return rounded(decomp.PCA(n_components=2).fit(df).results(spark).select("component", "variance"), 3)


@query()
def pca_embeddings(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(decomp.PCA(n_components=4).fit(v).transform(v).select("id", F.posexplode("scores").alias("component", "score")), 4)


def _part_matrix(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 10).alias("x"))


@query("SELECT p_partkey AS id, round(CAST(p_size AS DOUBLE), 5) AS size, round(p_retailprice / 10, 5) AS price FROM part")
def pca_inverse(spark, sf_dir):
    """All components give the rows back, whitened or not."""
    df = _part_matrix(spark, sf_dir)
    model = decomp.PCA(n_components=2, method="correlation", whiten=True).fit(df)
    back = model.inverse_transform(model.transform(df).select("id", "scores"))
    return rounded(back.select("id", F.element_at("x", 1).alias("size"), F.element_at("x", 2).alias("price")), 5)


@query("SELECT p_partkey AS id, round(pow(p_size - (SELECT avg(p_size) FROM part), 2) + pow(p_retailprice / 10 - (SELECT avg(p_retailprice / 10) FROM part), 2), 3) AS energy FROM part")
def pca_energy(spark, sf_dir):
    """The squared scores of a row add up to its squared distance from the mean."""
    df = _part_matrix(spark, sf_dir)
    scores = decomp.PCA(n_components=2, solver="gesdd").fit(df).transform(df)
    return rounded(scores.select("id", F.aggregate("scores", F.lit(0.0), lambda a, b: a + b * b).alias("energy")), 3)


@query()
def kernel_pca_embeddings(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(decomp.KernelPCA(n_components=2, kernel="rbf").fit(v).transform(v).select("id", F.posexplode("scores").alias("component", "score")), 4)


@query()
def tsne_embeddings(spark, sf_dir):
    v = vectors(spark, sf_dir)
    model = decomp.TSNE(max_iter=300).fit(v.select("id", "x"))
    ids = v.select("id").orderBy("id").toArrow().column("id")
    return spark.createDataFrame(pa.table({"id": ids, "a": model.embedding[:, 0], "b": model.embedding[:, 1]}))


# trees and support vectors


@query(
    """WITH d AS (SELECT CAST(n_chars AS DOUBLE) AS x, quality AS y FROM documents JOIN labels USING (doc_id)),
v AS (SELECT x, count(*) AS n, sum(y) AS k FROM d GROUP BY x), c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER (ORDER BY x) AS n, sum(k) OVER (ORDER BY x) AS k FROM v),
t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k FROM v),
s AS (SELECT (c.x + c.nx) / 2 AS cut, (c.n * (1 - pow(c.k / c.n, 2) - pow(1 - c.k / c.n, 2)) + (t.n - c.n) * (1 - pow((t.k - c.k) / (t.n - c.n), 2) - pow(1 - (t.k - c.k) / (t.n - c.n), 2))) / t.n AS child FROM c, t WHERE c.nx IS NOT NULL)
SELECT cut AS threshold FROM s ORDER BY round(child, 14), cut LIMIT 1"""
)
def tree_stump(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    data = docs.select(F.col("doc_id").alias("id"), F.array(F.col("n_chars").cast("double")).alias("x"), F.col("quality").alias("label"))
    return spark.createDataFrame([(float(trees.DecisionTree(max_depth=1).fit(data).nodes[0][0][1]),)], "threshold double")


@query()
def tree_embeddings(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return trees.DecisionTree(max_depth=6, histogram=True, maximum_bins=64).fit(v).predict(v).select("id", "label", "prediction")


@query()
def forest_embeddings(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return trees.RandomForest(n_trees=10, max_depth=6, histogram=True, maximum_bins=32, seed=3).fit(v).predict(v).select("id", "label", "prediction")


@query()
def svc_embeddings(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return svm.SVC(kernel="linear").fit(v).predict(v).select("id", "label", "prediction")


@query()
def svr_embeddings(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(svm.SVR().fit(v).predict(v).select("id", "prediction"), 2)


# interpolation

_DAYS = "(SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS DOUBLE) AS x, avg(value) AS y FROM events GROUP BY 1)"


def daily(spark, sf_dir):
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "events").groupBy(day.alias("x")).agg(F.avg("value").alias("y"))


@query(
    f"""WITH s AS (SELECT x, y, y / 100 AS g, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1, lead(y / 100) OVER (ORDER BY x) AS g1 FROM {_DAYS}),
c AS (SELECT x, y, g, x1 - x AS h, (y1 - y) / (x1 - x) AS m, g1 FROM s WHERE x1 IS NOT NULL), p AS (SELECT x + h / 4 AS pos, h / 4 AS t, y, g, (3 * m - 2 * g - g1) / h AS b, (g + g1 - 2 * m) / (h * h) AS a FROM c)
SELECT round(pos, 4) AS x, round(((a * t + b) * t + g) * t + y, 4) AS d0, round((3 * a * t + 2 * b) * t + g, 4) AS d1 FROM p"""
)
def spline_hermite(spark, sf_dir):
    from pyspark.sql import Window

    days = daily(spark, sf_dir)
    model = spline.CubicSpline("hermite").fit(days.withColumn("dy", F.col("y") / 100), dy="dy")
    nxt = F.lead("x").over(Window.orderBy("x"))  # one row a day
    points = days.select((F.col("x") + (nxt - F.col("x")) / 4).alias("x")).where("x IS NOT NULL")
    return rounded(model.evaluate(points, orders=(0, 1)), 4)


# second derivatives at the sites by elimination from the left, then substitution from the right
_NATURAL = f"""WITH RECURSIVE s AS (SELECT CAST(row_number() OVER (ORDER BY x) AS INTEGER) AS i, x, y FROM {_DAYS}), n AS (SELECT max(i) AS n FROM s),
g AS (SELECT b.i, b.x - a.x AS h0, c.x - b.x AS h1, 6 * ((c.y - b.y) / (c.x - b.x) - (b.y - a.y) / (b.x - a.x)) AS r FROM s a JOIN s b ON b.i = a.i + 1 JOIN s c ON c.i = b.i + 1),
f(i, c, d) AS (SELECT 1, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
  SELECT g.i, g.h1 / (2 * (g.h0 + g.h1) - g.h0 * f.c), (g.r - g.h0 * f.d) / (2 * (g.h0 + g.h1) - g.h0 * f.c) FROM f JOIN g ON g.i = f.i + 1),
m(i, v) AS (SELECT n, CAST(0 AS DOUBLE) FROM n UNION ALL SELECT f.i, f.d - f.c * m.v FROM m JOIN f ON f.i = m.i - 1),
k AS (SELECT a.x, a.y, b.x - a.x AS h, (b.y - a.y) / (b.x - a.x) - (b.x - a.x) * (2 * p.v + q.v) / 6 AS c, p.v / 2 AS b, (q.v - p.v) / (6 * (b.x - a.x)) AS a, a.i
  FROM s a JOIN s b ON b.i = a.i + 1 JOIN m p ON p.i = a.i JOIN m q ON q.i = b.i),
t AS (SELECT s.x + 0.5 AS pos, k.*, s.x + 0.5 - k.x AS u FROM s JOIN k ON k.i = least(s.i, (SELECT n - 1 FROM n)))
SELECT round(pos, 4) AS x, round(((a * u + b) * u + c) * u + y, 4) + 0.0 AS d0, round((3 * a * u + 2 * b) * u + c, 4) + 0.0 AS d1, round(6 * a * u + 2 * b, 4) + 0.0 AS d2 FROM t"""


@query(_NATURAL)
def spline_natural(spark, sf_dir):
    days = daily(spark, sf_dir)
    return rounded(spline.CubicSpline("natural").fit(days).evaluate(days.select((F.col("x") + 0.5).alias("x")), orders=(0, 1, 2)), 4)


@query("SELECT CAST(i AS BIGINT) AS i, round(2 + i * CAST(3 AS DOUBLE) / 999, 9) AS x FROM range(1000) t(i)")
def spline_uniform_sites(spark, sf_dir):
    return rounded(spline.CubicSpline.uniform_sites(spark, 1000, 2.0, 5.0), 9)


# models on disk, streams


@query()
def model_round_trip(spark, sf_dir):
    import uuid

    model, points = _kmeans(spark, sf_dir)
    path = f"{shared_dir(spark)}/lodestone/model-{uuid.uuid4().hex}"
    save_model(model, spark, path)
    model_metadata(spark, path)
    return load_model(spark, path).predict(points).select("id", "label")


ORACLES["model_round_trip"] = ORACLES["kmeans_predict"]


@query("SELECT 'KMeans' AS model, 'double' AS precision")
def model_description(spark, sf_dir):
    """What a saved model is, read without loading it."""
    import uuid

    path = f"{shared_dir(spark)}/lodestone/model-{uuid.uuid4().hex}"
    save_model(_kmeans(spark, sf_dir)[0], spark, path)
    return model_metadata(spark, path).select("model", "precision")


@query("SELECT j AS term, CAST(0 AS DOUBLE) AS gradient FROM range(65) t(j)")
def logistic_optimality(spark, sf_dir):
    """At the coefficients of a binary regression the gradient, summed here by expressions, is nought (label 0 or not)."""
    v = vectors(spark, sf_dir).withColumn("y", (F.col("label") == 0).cast("int"))
    model = linear.LinearModel(mod="logistic", intercept=True, reg_lambda=1.0, tol=1e-8).fit(v, "x", "y")
    w = [float(c) for c in model.coef.ravel()]
    x = F.concat("x", F.array(F.lit(1.0)))
    score = F.aggregate(F.zip_with(x, F.lit(w), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    miss = v.select(x.alias("x"), (1 / (1 + F.exp(-score)) - F.col("y")).alias("r"))
    sums = miss.select(F.posexplode("x").alias("j", "e"), "r").groupBy("j").agg(F.sum(F.col("e") * F.col("r")).alias("g"))
    penalty = F.element_at(F.lit([*w[:-1], 0.0]), F.col("j") + 1)
    return sums.select(F.col("j").cast("long").alias("term"), (F.round(F.col("g") + penalty, 4) + 0.0).alias("gradient"))


@query(ORACLES["ivf_search"])
def ivf_search_streamed(spark, sf_dir):
    """The index is filled by a stream over the table's file."""
    import uuid

    from lodestone.streaming.index_stream import add_stream, load_index

    v = vectors(spark, sf_dir)
    centroids = [r.x for r in v.orderBy("id").limit(8).collect()]
    index = neighbors.ApproximateNeighbors(n_list=8, n_probe=6, n_neighbors=4).train(v, centroids)
    base = f"{shared_dir(spark)}/lodestone/stream-{uuid.uuid4().hex}"
    raw = table(spark, sf_dir, "embeddings")
    files = raw.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    files.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(files.schema).parquet(f"{base}/in")
    add_stream(stream, index, f"{base}/index", f"{base}/check").awaitTermination()
    return rounded(load_index(spark, index, f"{base}/index").kneighbors(v), 5)
