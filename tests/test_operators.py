"""Operators against brute-force numpy, closed forms and defined edge cases."""

import math
import os
import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import stats, vectors
from lodestone.operators import compat, decomp, linear, neighbors, nonlinear, pairs, split, spline, svm, trees
from lodestone.operators.cluster import DBSCAN, KMeans
from lodestone.operators.components import connected_components, local_roots
from lodestone.operators.matrix import gram, moments
from lodestone.plans import catalogue
from lodestone.sources.csvio import numbered, read_csv
from lodestone.sources.persist import load_model, model_metadata, save_model
from lodestone.sources.store import DataStore, check_data, drop_missing

RNG = np.random.default_rng(5)


def frame(spark, x, **more):
    x = np.asarray(x, float)
    rows = [(i, [float(v) for v in r], *(c[i].item() if hasattr(c[i], "item") else c[i] for c in more.values())) for i, r in enumerate(x)]
    kinds = ", ".join(f"{k} {'double' if np.asarray(v).dtype.kind == 'f' else 'int'}" for k, v in more.items())
    return spark.createDataFrame(rows, "id long, x array<double>" + (", " + kinds if kinds else ""))


def wide(spark, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(len(x[0]))))


def values(df, column="x"):
    return np.array([r[column] for r in df.orderBy("id").collect()])


# statistics


def test_statistics_of_constant_and_single_rows(spark):
    df = wide(spark, [[2.0, 3.0]])
    assert stats.variance(df, ["c0"]).first()[0] == 0
    flat = wide(spark, [[2.0, 1.0]] * 4)
    assert stats.skewness(flat, ["c0"]).first()[0] == 0
    assert stats.kurtosis(flat, ["c0"]).first()[0] == -3
    assert {(r["row"], r["col"]): r.value for r in stats.correlation_matrix(wide(spark, [[1, 2], [1, 3], [1, 5]]), ["c0", "c1"]).collect()} == {
        ("c0", "c0"): 1, ("c1", "c1"): 1, ("c0", "c1"): 0, ("c1", "c0"): 0,
    }


def test_geometric_and_harmonic_edges(spark):
    assert stats.geometric_mean(wide(spark, [[0.0], [4.0]]), ["c0"]).first()[0] == 0
    with pytest.raises(Exception, match="negative"):
        stats.geometric_mean(wide(spark, [[-1.0], [4.0]]), ["c0"]).collect()
    assert stats.harmonic_mean(wide(spark, [[1.0], [-1.0]]), ["c0"]).first()[0] == 0
    assert stats.harmonic_mean(wide(spark, [[0.0], [4.0]]), ["c0"]).first()[0] == 0


def test_nulls_fail_unless_allowed_and_nan_passes(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "c0 double")
    with pytest.raises(Exception, match="missing value"):
        stats.mean(df, ["c0"]).collect()
    assert stats.mean(df, ["c0"], allow_null=True).first()[0] == 1
    assert math.isnan(stats.mean(wide(spark, [[1.0], [math.nan]]), ["c0"]).first()[0])


def test_row_statistics(spark):
    x = RNG.normal(size=(6, 5))
    df = wide(spark, x)
    cols = [f"c{i}" for i in range(5)]
    d = x - x.mean(1, keepdims=True)
    got = [sorted(r[0] for r in fn(df, cols, axis="row").select("value").collect()) for fn in (stats.variance, stats.skewness, stats.kurtosis)]
    want = [(d**2).sum(1) / 4, np.sqrt(5) * (d**3).sum(1) / (d**2).sum(1) ** 1.5, 5 * (d**4).sum(1) / (d**2).sum(1) ** 2 - 3]
    for g, w in zip(got, want, strict=True):
        np.testing.assert_allclose(g, np.sort(w), rtol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 7, 10])
def test_quantiles_equal_numpy(spark, n):
    x = RNG.integers(0, 6, n).astype(float)
    names = list(stats.METHODS)
    got = {(r.method, r.q): r.value for r in stats.quantile(wide(spark, x[:, None]), ["c0"], [0.0, 0.3, 0.5, 1.0], names).collect()}
    for name in names:
        if name == "closest_observation":  # numpy rounds its ties on another index
            continue
        for q in (0.0, 0.3, 0.5, 1.0):
            assert got[stats.METHODS[name], q] == pytest.approx(np.quantile(x, q, method=name)), (name, q)


def test_standardize_restores(spark):
    x = RNG.normal(3, 2, (8, 2))
    x[:, 1] = 5
    df = wide(spark, x)
    z = np.array([list(r) for r in stats.standardize(df, ["c0", "c1"]).collect()])
    np.testing.assert_allclose(np.sort(z[:, 0]), np.sort((x[:, 0] - x[:, 0].mean()) / x[:, 0].std(ddof=1)), rtol=1e-9)
    assert (z[:, 1] == 0).all()
    back = stats.standardize(stats.standardize(df, ["c0"], [3.0], [2.0]), ["c0"], [3.0], [2.0], reverse=True)
    np.testing.assert_allclose(sorted(r.c0 for r in back.collect()), np.sort(x[:, 0]), rtol=1e-12)


# tables and files


def test_csv_types_options_and_errors(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('# note\na,b,c,d,e\n1, 2.5,TRUE,x,"q ""w"", z"\n2, 3,false,,y\n\n3,4e1,True,7,"1"\n')
    df = read_csv(spark, str(p), header=True)
    assert [t for _, t in df.drop("__row").dtypes] == ["bigint", "double", "boolean", "string", "string"]
    rows = df.orderBy("__row").collect()
    assert (rows[0].e, rows[0].b, rows[0].c, rows[2].b) == ('q "w", z', 2.5, True, 40.0)
    p.write_text("1,2\n3\n")
    with pytest.raises(ValueError, match="line 2 has 1 cells"):
        read_csv(spark, str(p))
    p.write_text("1;x\n2;3\n")
    with pytest.raises(Exception, match="no double"):
        read_csv(spark, str(p), delimiter=";", datatype="double").collect()
    assert read_csv(spark, str(p), delimiter=";", datatype="double", missing="warn").orderBy("__row").first().c1 is None
    p.write_text("skip\n1.000,5  2\nfoot\n")
    got = read_csv(spark, str(p), whitespace=True, thousands=".", decimal=",", skip_rows=[0], skip_footer=True).first()
    assert (got.c0, got.c1) == (1000.5, 2)


def test_store(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 3 else i * 2.0) for i in range(8)], "k long, a double, b double")
    s = DataStore(df, ["k"])
    with pytest.warns(UserWarning, match="whole store"):
        assert s.extract("none").count() == 8
    s.select_slice("s", 0, 2, 0, 1).select_slice("s", 5, 6, 2, 2).remove_rows("s", 1, 1)
    out = s.extract("s")
    assert out.columns == ["row_id", "k", "a", "b"] and sorted(r.k for r in out.collect()) == [0, 2, 5, 6]
    with pytest.raises(ValueError, match="no selection"):
        s.extract("other")
    with pytest.raises(ValueError, match="interval"):
        s.select_rows("s", 5, 9)
    s.select_non_missing("full")
    assert s.extract("full").count() == 7
    s.set_element(3, 2, 9.0)
    assert s.get_element(3, 2) == 9.0
    s.label_column(1, "z")
    assert (s.index("z"), s.label(1), s.n_cols()) == (1, "z", 3)
    with pytest.raises(ValueError, match="rows beside"):
        s.hconcat(DataStore(spark.range(3), ["id"]))
    assert s.append_rows(spark.createDataFrame([(99, 1.0, 1.0)], "k long, z double, b double"), ["k"]).get_element(8, 0) == 99
    with pytest.raises(ValueError, match="types"):
        s.append_rows(spark.createDataFrame([("x", 1.0, 1.0)], "k string, z double, b double"), ["k"])


def test_missing_values(spark):
    df = wide(spark, [[1.0, 2.0], [math.nan, 1.0]])
    assert drop_missing(df).count() == 1
    with pytest.raises(ValueError, match="c0"):
        check_data(df)


def test_numbered_rows_are_consecutive(spark):
    df = numbered(spark.range(100).repartition(7).withColumn("k", F.col("id") % 10), ["k", "id"])
    rows = df.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(100)) and [(r.k, r.id) for r in rows] == sorted((i % 10, i) for i in range(100))


@pytest.mark.parametrize("stratify", [None, "c"])
def test_split_sizes(spark, stratify):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id long, c int")
    parts = split.train_test_split(df, "id", test_size=0.3, stratify=stratify)
    n = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert n == {"train": 35, "test": 15}
    if stratify:
        per = parts.where("part = 'test'").groupBy("c").count().collect()
        assert all(r["count"] == 5 for r in per)
    with pytest.raises(ValueError):
        split.train_test_split(spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, c int"), "id", stratify="c")


# pairs and neighbours


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "manhattan", "minkowski", "cosine", "inner product", "euclidean_gemm", "sqeuclidean_gemm"])
def test_distances_agree_with_expressions(spark, metric):
    x = RNG.normal(size=(7, 4))
    x[2] = 0
    df = frame(spark, x)
    got = {(r.id_x, r.id_y): r.dist for r in pairs.pairwise_distances(df, df.withColumn("id", F.col("id")), metric, 3.0).collect()}
    both = df.crossJoin(df.select(F.col("id").alias("j"), F.col("x").alias("y")))
    for r in both.select("id", "j", vectors.distance(metric, F.col("x"), F.col("y"), 3.0).alias("d")).collect():
        assert got[r.id, r.j] == pytest.approx(r.d, abs=1e-7)
    if metric == "cosine":
        assert got[2, 0] == 1


def test_a_join_sends_few_copies(spark):
    """Each row goes to the parts of the other side, which grow with what a cell holds and not with the block."""
    x = RNG.normal(size=(40, 2))
    df = frame(spark, x).withColumn("g", F.lit(0))
    assert pairs._dealt(df, df, 1).count() == 40 * (16 + 4)  # blocks of both sides: 40 * (40 + 40)
    found = pairs.block_join(df, df, lambda ia, a, ib, b: {"i": np.repeat(ia, len(ib)), "j": np.tile(ib, len(ia))}, "i long, j long", 1)
    assert found.distinct().count() == found.count() == 1600


@pytest.mark.parametrize("rows, block", [(40, 1), (40, 7), (3, 2), (1, 1), (0, 1)])
def test_all_pairs_of_a_table_meet_once(spark, rows, block):
    """Each two parts share a cell, and each pair is listed once in each order."""
    x = RNG.normal(size=(rows, 2))
    df = spark.createDataFrame([(5 * i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    parts = min(-(-rows // block), 8)
    assert pairs._dealt_once(df, block).count() == rows * parts  # in two sides: rows * (16 + 4)
    found = pairs.all_pairs(df, None, lambda ia, a, ib, b: a @ b.T, "v", block).collect()
    got = {(r.id_x, r.id_y): r.v for r in found}
    assert len(found) == len(got) == rows * rows
    for (i, j), v in got.items():
        assert v == pytest.approx(x[i // 5] @ x[j // 5])


@pytest.mark.parametrize("m, n", [(64, 128), (70, 200), (130, 9), (5, 3), (64, 10), (3, 64)])
def test_tiles_list_each_pair(m, n):
    a, b, v = np.arange(m), 1000 + np.arange(n), RNG.normal(size=(m, n))
    one = {(i, 1000 + j): v[i, j] for i in range(m) for j in range(n)}
    both = one | {(j, i): x for (i, j), x in one.items()}
    w = v @ v.T + (v @ v.T).T
    square = {(i, j): w[i, j] for i in range(m) for j in range(m)}
    found = [(one, pairs._listed(a, b, v, "v")), (both, pairs._listed(a, b, v, "v", mirrored=True)), (square, pairs._listed(a, a, w, "v", same=True))]
    for want, made in found:
        got = list(zip(*(c.to_pylist() for c in made.columns), strict=True))
        assert len(got) == len(want) and {(i, j): x for i, j, x in got} == want


def test_pages_of_pairs_repeat_values():
    """The writer keeps its dictionary if the first 20,000 values of a group have fewer than 15,600 different ones."""
    a = RNG.normal(size=(512, 4))
    for found in (pairs._listed(np.arange(512), np.arange(512), a @ RNG.normal(size=(512, 4)).T, "v", mirrored=True), pairs._listed(np.arange(512), np.arange(512), a @ a.T, "v", same=True)):
        v = found.column(2).to_numpy()
        assert max(len(np.unique(v[lo : lo + 20_000])) for lo in range(0, len(v) - 20_000, 500)) < 15_600


def test_all_pairs_in_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_TASKS", 3)
    x = RNG.normal(size=(30, 2))
    found = pairs.all_pairs(frame(spark, x), None, lambda ia, a, ib, b: a @ b.T, "v", 2)
    assert found.rdd.getNumPartitions() == 3
    assert {(r.id_x, r.id_y): pytest.approx(r.v) for r in found.collect()} == {(i, j): x[i] @ x[j] for i in range(30) for j in range(30)}


def test_ids_of_all_pairs_take_little_space(spark, tmp_path):
    """A column file stores two ids in a bit and a half (in more than two bits, if y goes on for 2,048 rows)."""
    pq = pytest.importorskip("pyarrow.parquet")
    n = 2048
    df = spark.range(n).select("id", F.array(F.rand(1), F.rand(2)).alias("x"))
    for made in (pairs.kernel_matrix(df, kernel="sigmoid", gamma=0.05, digits=5), pairs.pairwise_distances(df, digits=5)):
        at = str(tmp_path / made.columns[2])
        made.coalesce(1).write.parquet(at)
        groups = [pq.ParquetFile(os.path.join(at, f)).metadata for f in os.listdir(at) if f.endswith(".parquet")]
        columns = [m.row_group(g).column(c) for m in groups for g in range(m.num_row_groups) for c in (0, 1)]
        assert sum(m.num_rows for m in groups) == n * n
        assert sum(c.total_compressed_size for c in columns) < 0.18 * n * n


def stored_values(df, at):
    """Rows of a result and the bytes that a column file needs for the value of each."""
    pq = pytest.importorskip("pyarrow.parquet")
    df.coalesce(1).write.parquet(at)
    (found,) = [pq.ParquetFile(os.path.join(at, f)).metadata for f in os.listdir(at) if f.endswith(".parquet")]
    return found.num_rows, sum(found.row_group(g).column(2).total_compressed_size for g in range(found.num_row_groups)) / found.num_rows


def test_values_of_mirrored_pairs_are_stored_once(spark, tmp_path):
    """Values of (b, a) repeat those of (a, b) in the same order (else each takes 1.6 bytes, the width of a dictionary's entry)."""
    x = RNG.normal(size=(2048, 64))
    rows, each = stored_values(pairs.kernel_matrix(frame(spark, x / np.linalg.norm(x, axis=1)[:, None]), gamma=0.05, digits=5), str(tmp_path / "rbf"))
    assert rows == 2048 * 2048 and each < 1.2
    rows, each = stored_values(pairs.pairwise_distances(frame(spark, x / np.linalg.norm(x, axis=1)[:, None]), digits=5), str(tmp_path / "euclidean"))
    assert rows == 2048 * 2048 and each < 1.4


@pytest.mark.parametrize("name", ["pairwise_euclidean_gemm", "kernel_rbf", "pairwise_euclidean"])
def test_query_of_all_pairs_sends_floats_as_they_are_stored(spark, name):
    """Components are widened in the task that compares them, not before they are sent to each part."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "embedding" in plan and "array<double>" not in plan


def test_floats_and_doubles_of_the_same_value_have_equal_distances(spark):
    x = RNG.normal(size=(30, 5)).astype("float32")
    df = frame(spark, x.astype(float))
    wide = {(r.id_x, r.id_y): r.dist for r in pairs.pairwise_distances(df).collect()}
    assert {(r.id_x, r.id_y): r.dist for r in pairs.pairwise_distances(df.withColumn("x", F.col("x").cast("array<float>"))).collect()} == wide


@pytest.mark.parametrize("name", ["kernel_rbf", "pairwise_euclidean_gemm", "pairwise_euclidean"])
def test_query_of_all_pairs_sends_a_row_to_each_part_once(spark, name):
    """500 vectors are one part: one task lists 250,000 pairs, after one shuffle of 500 rows and no broadcast of sizes."""
    made = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "round(" not in plan
    assert made.count() == 250_000


def test_rounded_as_sql_does():
    duckdb = pytest.importorskip("duckdb")
    v = np.array([0.125, -0.125, 0.375, 2.5, -2.5, 0.5, -0.5, 0.49999999999999994, -0.001, 0.0, -0.0, 1e300, -1e300, 4503599627370497.5, 9007199254740993.0, *RNG.normal(size=200)])
    for digits in (0, 2, 5):
        want = np.array(duckdb.execute("SELECT round(v, ?) + 0.0 FROM (SELECT unnest(?::DOUBLE[]) AS v)", [digits, v.tolist()]).fetchall())[:, 0]
        got = pairs.rounded(v, digits)
        kept = v != 0.49999999999999994
        assert (got[kept] == want[kept]).all() and not np.signbit(got[got == 0]).any()
    odd = pairs.rounded(np.array([np.nan, np.inf, -np.inf, 1.5e308]), 5)
    assert np.isnan(odd[0]) and odd[1:].tolist() == [np.inf, -np.inf, 1.5e308]
    assert pairs.rounded(v, None) is v


@pytest.mark.parametrize("p", [0.5, 1.0, 2.0, 2.5, 3.0, 4.0])
def test_minkowski_powers(p):
    a, b = RNG.normal(size=(70, 5)), RNG.normal(size=(9, 5))
    want = (np.abs(a[:, None] - b[None]) ** p).sum(2) ** (1 / p)
    np.testing.assert_allclose(pairs.block_distance("minkowski", a, b, p), want, rtol=1e-12)


def test_whole_powers_are_products():
    a, b = RNG.normal(size=(256, 32)), RNG.normal(size=(512, 32))

    def seconds(p):
        began = time.process_time()
        pairs.block_distance("minkowski", a, b, p)
        return time.process_time() - began

    assert min(seconds(3.0) for _ in range(3)) < 0.6 * min(seconds(2.5) for _ in range(3))


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "minkowski", "manhattan", "cosine"])
def test_pairs_within_a_radius(metric):
    a = np.round(RNG.normal(size=(60, 4)), 1) + 1e3  # many ties at the radius, far from the origin
    b = np.vstack([a[:30] + np.array([0.3, 0, 0, 0.4]), [[np.nan] * 4, [np.inf] * 4, [1e200] * 4]])
    d = pairs.block_distance(metric, a, b)
    i, j, got = pairs.within(metric, a, b, float(np.sort(d[np.isfinite(d)])[40]))
    r = np.sort(d[np.isfinite(d)])[40]
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(d <= r)), strict=True))
    assert (got == d[i, j]).all()


def test_few_pairs_within_a_radius_are_found_by_products(monkeypatch):
    a = RNG.normal(size=(512, 64))
    monkeypatch.setattr(pairs, "block_distance", None)  # which adds coordinate by coordinate
    i, j, d = pairs.within("euclidean", a, a, 0.6)
    assert (i == j).all() and len(i) == 512 and not d.any()


def test_knn_in_small_blocks(spark):
    x = np.round(RNG.normal(size=(60, 2)), 1)
    df = frame(spark, x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {(r.id_x, r["rank"]): r.id_y for r in pairs.knn(df, df, 3, exclude_self=True, block=7).collect()}
    for i in range(60):
        want = sorted(range(60), key=lambda j, i=i: (d[i, j], j))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == want
    assert pairs.knn(df.limit(2), df.limit(2), 5).count() == 4
    with pytest.raises(ValueError):
        pairs.knn(df, df, 3, "minkowski", -1.0)


def test_radius_outliers(spark):
    df = frame(spark, [[0.0], [0.1], [9.0]], label=np.array([1, 1, 2]), y=np.array([1.0, 3.0, 5.0]))
    q = frame(spark, [[0.05], [50.0]])
    with pytest.raises(Exception, match="no neighbours"):
        neighbors.NearestNeighbors(radius=1.0).fit(df, label="label").predict(q, "radius").collect()
    manual = neighbors.NearestNeighbors(radius=1.0, outlier_handling="manual", outlier_label=7).fit(df, label="label").predict(q, "radius")
    assert {r.id: r.label for r in manual.collect()} == {0: 1, 1: 7}
    often = neighbors.NearestNeighbors(radius=1.0, outlier_handling="most frequent").fit(df, target="y").predict_target(q, "radius")
    assert {r.id: r.prediction for r in often.collect()} == {0: 2.0, 1: 3.0}
    exact = neighbors.NearestNeighbors(n_neighbors=2, weights="distance").fit(df, label="label").predict_proba(frame(spark, [[0.0]]))
    assert {r.label: r.proba for r in exact.collect()} == {1: 1.0}


def test_ivf_with_all_lists_is_exact(spark):
    x = RNG.normal(size=(80, 3))
    df = frame(spark, x)
    index = neighbors.ApproximateNeighbors(n_list=5, n_probe=5, n_neighbors=4, kmeans_iter=3).train_and_add(df)
    got = {(r.id_x, r["rank"]): r.id_y for r in index.kneighbors(df).collect()}
    want = {(r.id_x, r["rank"]): r.id_y for r in pairs.knn(df, df, 4, "sqeuclidean").collect()}
    assert got == want
    assert sum(r.n for r in index.list_sizes().collect()) == 80
    few = index.kneighbors(df, n_neighbors=80, n_probe=1).where("id_x = 0")
    assert few.count() == 80 and few.where("id_y IS NULL AND dist = 'Infinity'").count() > 0
    with pytest.raises(ValueError):
        index.kneighbors(df, n_probe=9)


TABLES = "/root/testdata/sf0.1"


def recall(spark, found, k=4):
    """Share of the k nearest other rows of each embedding that found (id_x, id_y) holds beside the row itself."""
    v = catalogue.vectors(spark, TABLES)
    true = pairs.knn(v, v, k - 1, "sqeuclidean", exclude_self=True).select("id_x", "id_y")
    return true.join(found.select("id_x", "id_y"), ["id_x", "id_y"], "left_semi").count() / true.count()


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_ivf_recall_of_trained_lists(spark):
    v = catalogue.vectors(spark, TABLES)
    index = neighbors.ApproximateNeighbors(n_list=8, n_probe=6, n_neighbors=4, train_fraction=0.5).train_and_add(v)
    assert recall(spark, index.kneighbors(v)) >= 0.9


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", ["ivf_search", "ivf_search_streamed"])
def test_ivf_recall_of_the_queries(spark, name):
    assert recall(spark, catalogue.QUERIES[name](spark, TABLES)) >= 0.9


# clustering


def blobs(n=40, k=3, seed=1):
    r = np.random.default_rng(seed)
    return np.vstack([r.normal(8 * i, 0.5, (n, 2)) for i in range(k)]), np.repeat(np.arange(k), n)


@pytest.mark.parametrize("options", [{}, {"initialization_method": "random", "n_init": 4}, {"initialization_method": "random partitions"}, {"initialization_method": "afk-mc2"}, {"algorithm": "hartigan-wong"}, {"algorithm": "macqueen"}])
def test_kmeans_finds_blobs(spark, options):
    x, y = blobs()
    df = frame(spark, x).cache()
    model = KMeans(n_clusters=3, **({"n_init": 2, "seed": 1} | options)).fit(df)
    label = np.array([r.label for r in model.predict(df).orderBy("id").collect()])
    if "random" not in str(options):
        assert all(len(set(label[y == k])) == 1 for k in range(3)) and len(set(label)) == 3
    d = values(model.transform(df), "distances")
    np.testing.assert_allclose(d, np.sqrt(((x[:, None] - model.cluster_centres) ** 2).sum(2)), rtol=1e-9)
    assert model.inertia == pytest.approx((d.min(1) ** 2).sum())


def test_kmeans_rules(spark):
    df = frame(spark, [[0.0], [1.0], [10.0]])
    with pytest.raises(ValueError):
        KMeans(n_clusters=4).fit(df)
    with pytest.raises(RuntimeError):
        KMeans().predict(df)
    far = [[0.0], [900.0], [901.0]]
    with pytest.raises(ValueError, match="empty"):
        KMeans(n_clusters=3, initialization_method="supplied", C=far, empty_clusters="error").fit(df)
    split_ = KMeans(n_clusters=3, initialization_method="supplied", C=far, empty_clusters="split").fit(df)
    assert split_.inertia == pytest.approx(0)
    round_ = KMeans(n_clusters=2, distance="cosine", normalize_data=True, initialization_method="supplied", C=[[1.0, 0.1], [0.1, 1.0]]).fit(frame(spark, [[1, 0], [2, 0.1], [0, 3], [0.1, 1]]))
    assert np.allclose(np.linalg.norm(round_.cluster_centres, axis=1), 1)


def brute_dbscan(x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label, k = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                a = todo.pop()
                if label[a] < 0:
                    label[a] = k
                    if core[a]:
                        todo += [b for b in np.flatnonzero(near[a]) if label[b] < 0]
            k += 1
    return label, core


def test_dbscan_equals_brute_force(spark):
    x = RNG.uniform(0, 6, (120, 2))
    got = DBSCAN(eps=0.5, min_samples=4).fit_predict(frame(spark, x)).orderBy("id").collect()
    label, core = brute_dbscan(x, 0.5, 4)
    assert [r.is_core for r in got] == core.tolist() and [r.label for r in got] == label.tolist()


def test_slabs_send_rows_to_near_cells(spark):
    """One wide coordinate, many equal values, a row that is no number: all pairs within reach, few copies."""
    x = np.round(RNG.uniform(-500, 500, (400, 2)), 1)
    x[:60, 0], x[60], x[61] = 7.25, np.nan, np.inf
    df = frame(spark, x)
    d = pairs.block_distance("euclidean", x, x)
    got = pairs.block_join(df, df, lambda ia, a, ib, b: {"i": np.repeat(ia, len(ib)), "j": np.tile(ib, len(ia))}, "i long, j long", 8, reach=5.0).collect()
    assert len(set(got)) == len(got) < 0.2 * 160000 and {r.i for r in got} >= set(range(62, 400))
    assert {(i.item(), j.item()) for i, j in zip(*np.nonzero(d <= 5.0), strict=True)} <= {(r.i, r.j) for r in got}
    found = pairs.radius_join(df, df, 5.0).collect()
    assert {(r.id_x, r.id_y) for r in found} == {(i.item(), j.item()) for i, j in zip(*np.nonzero(d <= 5.0), strict=True)}


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "manhattan"])
def test_dbscan_in_slabs(spark, metric, monkeypatch):
    monkeypatch.setattr(pairs, "SLABS", 16)
    x = np.round(RNG.uniform(0, 30000, (3000, 1)), 0)
    got = DBSCAN(eps=9.0, min_samples=4, metric=metric).fit_predict(frame(spark, x)).orderBy("id").collect()
    label, core = brute_dbscan(x, 3.0 if metric == "sqeuclidean" else 9.0, 4)
    assert [r.is_core for r in got] == core.tolist() and [r.label for r in got] == label.tolist()


def test_linked_rows(spark):
    from lodestone.operators.cluster import linked

    near = RNG.random((40, 50)) < 0.03
    u, v = linked(near, np.arange(40), np.arange(100, 150))
    i, j = np.nonzero(near)
    root = local_roots(150, i, j + 100)
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {k: r for k, r in enumerate(root.tolist()) if k != r}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (40, 45), (45, 41)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30, 40: 40, 41: 40, 45: 40}


# regression


@pytest.mark.parametrize("held", [2, 40, 10**6])
def test_components_of_any_share(spark, held):
    """Whatever tasks hold: rounds alone, rounds and one task, one task alone."""
    r = np.random.default_rng(8)
    hub = [(1000, int(i)) for i in r.permutation(60)]
    line = r.permutation(np.arange(2000, 2030))
    path = [(int(a), int(b)) for a, b in zip(line, line[1:], strict=False)]
    pairs_ = [(int(a), int(b)) for a, b in r.integers(3000, 3060, (40, 2))]
    edges = hub + path + pairs_ + pairs_
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(3), held=held).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: c for n, c in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_logistic_by_gradients_reaches_the_same_optimum(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 3))
    y = (x @ r.normal(size=(3, 3)) + r.normal(size=(300, 3))).argmax(1)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y int")
    fit = lambda: linear.LinearModel(mod="logistic", intercept=True, reg_lambda=1.0, tol=1e-6).fit(df, ["a", "b", "c"], "y")
    newton = fit()
    monkeypatch.setattr(linear, "NEWTON", 0)
    steps = fit()
    assert steps.loss == pytest.approx(newton.loss, rel=1e-8) and np.allclose(steps.coef, newton.coef, atol=1e-4)
    with pytest.warns(UserWarning, match="max_iter"):
        linear.LinearModel(mod="logistic", intercept=True, max_iter=2, tol=0.0).fit(df, ["a", "b", "c"], "y")


def test_trees_of_many_bins_and_nodes(spark):
    """Features, bins and trees whose numbers exceed what a double holds."""
    r = np.random.default_rng(6)
    x = r.random((400, 3))
    y = (x[:, 1] > 0.5).astype(int) * 2 + (x[:, 2] > 0.3)
    df = spark.createDataFrame([(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, label int")
    forest = trees.RandomForest(n_trees=3, max_depth=4, seed=1, features_selection="all").fit(df)
    found = forest.predict(df).collect()
    assert np.mean([a.label == a.prediction for a in found]) > 0.97
    sums = [sum(n[4]) for n in forest.nodes[2] if n[0] >= 0]
    assert all(n[4] is not None for t in forest.nodes for n in t) and sums[0] == max(sums)


def test_spline_points_over_many_ranges(spark):
    """Ranges without sites take the last site of the ranges before them."""
    sites = spark.createDataFrame([(0, float(x), float(x * x)) for x in range(4)] + [(1, float(x), 1.0) for x in (0, 10)], "s long, x double, y double")
    points = spark.createDataFrame([(s, -1 + i / 100) for s in (0, 1) for i in range(1000)], "s long, x double").repartition(7)
    fitted = spline.CubicSpline("natural").fit(sites, series="s")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = fitted.search_cells(points, series="s").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == 2000
    for r in got:
        assert r.cell == (min(2, max(0, math.floor(r.x + 1e-12))) if r.s == 0 else 0), r


def test_coupled_probabilities_are_the_least():
    r = np.random.default_rng(5)
    a = r.uniform(0.05, 0.95, (20, 4, 4))
    a = np.triu(a, 1) + np.tril(1 - a.transpose(0, 2, 1), -1)
    p = svm._couple(a)
    cost = lambda p: ((a.transpose(0, 2, 1) * p[:, :, None] - a * p[:, None, :]) ** 2 * (1 - np.eye(4))).sum((1, 2))
    assert np.allclose(p.sum(1), 1) and (p > 0).all()
    for _ in range(30):
        d = r.normal(size=p.shape) * 1e-3
        assert (cost(p + d - d.mean(1, keepdims=True)) >= cost(p) - 1e-12).all()
    true = np.array([[0.1, 0.2, 0.3, 0.4]])
    assert np.allclose(svm._couple(true[:, :, None] / (true[:, :, None] + true[:, None, :])), true)


def test_checked_data_and_inert_options(spark):
    bad = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, [float("nan"), 1.0], 2.0), (3, [1.0, 1.0], None)], "id long, x array<double>, y double")
    good = bad.where("id = 1")
    for model in (KMeans(n_clusters=1, check_data=True), decomp.PCA(check_data=True), neighbors.NearestNeighbors(check_data=True)):
        with pytest.raises(ValueError, match="non-finite values in x"):
            model.fit(bad)
    with pytest.raises(ValueError, match="non-finite values in y"):
        linear.LinearModel(check_data=True).fit(bad.where("id <> 2"), "x", "y")
    with pytest.raises(ValueError, match="non-finite"):
        DBSCAN(check_data=True).fit_predict(bad)
    assert decomp.PCA(check_data=True).fit(good).n_samples == 1 and decomp.PCA().fit(bad).n_samples == 3
    for make in (lambda: KMeans(mixed_precision=True), lambda: neighbors.NearestNeighbors(algorithm="kd tree"), lambda: DBSCAN(leaf_size=9), lambda: nonlinear.NonlinearLeastSquares(method="powell-dogleg")):
        with pytest.warns(UserWarning, match="has no effect"):
            make()


def test_names_of_clustering_libraries(spark):
    x, _ = blobs()
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "id long, x array<double>")
    found = compat.Kmeans(2, 3, niter=20, nredo=3, seed=2)
    cost = found.train(df)
    rows = found.assign(df).collect()
    assert len({r.I for r in rows}) == 3 and sum(r.D for r in rows) == pytest.approx(cost) and found.index.ntotal == 3
    assert compat.get_version() and compat.get_arch_info(spark).first().parallelism > 0


def test_randomized_kernel_pca(spark):
    x, _ = blobs()
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "id long, x array<double>")
    exact = decomp.KernelPCA(n_components=2, kernel="rbf", gamma=0.05).fit(df)
    quick = decomp.KernelPCA(n_components=2, kernel="rbf", gamma=0.05, eigensolver="randomized", seed=1).fit(df)
    assert np.allclose(exact.eigenvalues, quick.eigenvalues, rtol=1e-6)


def test_gram(spark):
    x = RNG.normal(size=(30, 5))
    df = frame(spark, x)
    n, m = moments(df)
    np.testing.assert_allclose(gram(df, m), (x - x.mean(0)).T @ (x - x.mean(0)), rtol=1e-10)
    assert n == 30


@pytest.mark.parametrize("solver", ["auto", "svd", "qr", "cg", "lbfgs", "coord"])
@pytest.mark.parametrize("intercept", [True, False])
def test_least_squares(spark, solver, intercept):
    x = RNG.normal(2, 1, (50, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + RNG.normal(size=50) * 0.1
    m = linear.LinearModel(intercept=intercept, solver=solver, tol=1e-9, dual_gap_tol=1e-12).fit(frame(spark, x, y=y), "x", "y")
    a = np.hstack([x, np.ones((50, 1))]) if intercept else x
    np.testing.assert_allclose(m.coef, np.linalg.lstsq(a, y, rcond=None)[0], atol=1e-4)


def test_rank_deficient_falls_back(spark):
    x = RNG.normal(size=(20, 2))
    x = np.hstack([x, x[:, :1]])
    m = linear.LinearModel().fit(frame(spark, x, y=x[:, 0] * 2), "x", "y")
    np.testing.assert_allclose(m.coef, [1, 0, 1], atol=1e-6)


def test_lasso_meets_its_conditions(spark):
    x = RNG.normal(size=(60, 4))
    y = x @ [2.0, 0, 0, -1] + RNG.normal(size=60)
    lam = 0.3
    m = compat.Lasso(lam, fit_intercept=False, tol=1e-10, dual_gap_tol=1e-12).fit(frame(spark, x, y=y), "x", "y")
    g = x.T @ (y - x @ m.coef) / 60
    for w, s in zip(m.coef, g, strict=True):
        assert (abs(s) <= lam + 1e-6) if w == 0 else s == pytest.approx(lam * np.sign(w), abs=1e-6)
    with pytest.raises(ValueError):
        linear.LinearModel(solver="cholesky", reg_lambda=1.0, reg_alpha=1.0).fit(frame(spark, x, y=y), "x", "y")


@pytest.mark.parametrize("constraint", ["ssc", "rsc"])
def test_logistic(spark, constraint):
    x, y = blobs(25, 3)
    x = x / 8 + RNG.normal(size=x.shape) * 0.3
    df = frame(spark, x, label=y)
    m = linear.LinearModel(mod="logistic", intercept=True, constraint=constraint, reg_lambda=0.1, tol=1e-7).fit(df, "x", "label")
    assert m.evaluate(df, "label").first().accuracy > 0.85 and m.nrm_gradient_loss < 1e-4
    two = linear.LinearModel(mod="logistic", intercept=True, reg_lambda=1.0).fit(df.where("label < 2"), "x", "label")
    assert two.coef.shape == (1, 3) and two.evaluate(df.where("label < 2"), "label").first().accuracy > 0.9
    with pytest.raises(ValueError, match="L1"):
        linear.LinearModel(mod="logistic", reg_lambda=1.0, reg_alpha=1.0).fit(df, "x", "label")


def test_nonlinear_fit(spark):
    t = np.linspace(0, 2, 40)
    y = 3 * np.exp(-1.5 * t) + 0.5
    df = wide(spark, np.stack([t, y], 1))
    r = lambda p, c: p[0] * np.exp(-p[1] * c["c0"]) + p[2] - c["c1"]
    m = nonlinear.NonlinearLeastSquares(n_coef=3).fit(df, ["c0", "c1"], [1.0, 1.0, 0.0], r)
    np.testing.assert_allclose(m.x, [3, 1.5, 0.5], atol=1e-4)
    held = nonlinear.NonlinearLeastSquares(n_coef=3, upper_bounds=[2.0, 9.0, 9.0]).fit(df, ["c0", "c1"], [1.0, 1.0, 0.0], r)
    assert held.x[0] == pytest.approx(2.0)
    wrong = lambda p, c: np.stack([np.exp(-p[1] * c["c0"]), c["c0"], np.ones(len(c["c0"]))], 1)
    with pytest.raises(ArithmeticError):
        nonlinear.NonlinearLeastSquares(n_coef=3, check_derivatives="yes").fit(df, ["c0", "c1"], [1.0, 1.0, 0.0], r, wrong)


# decomposition


@pytest.mark.parametrize("method", ["covariance", "correlation", "svd"])
def test_pca(spark, method):
    x = RNG.normal(size=(40, 5)) @ RNG.normal(size=(5, 5))
    a = x if method == "svd" else x - x.mean(0)
    if method == "correlation":
        a = a / x.std(0, ddof=1)
    s = np.linalg.svd(a, compute_uv=False)
    df = frame(spark, x)
    m = decomp.PCA(n_components=5, method=method).fit(df)
    np.testing.assert_allclose(m.sigma, s, rtol=1e-6)
    assert m.total_variance == pytest.approx((a**2).sum() / 39)
    back = m.inverse_transform(m.transform(df).drop("x"))
    np.testing.assert_allclose(values(back), x, atol=1e-8)
    white = decomp.PCA(n_components=2, method=method, whiten=True).fit(df)
    np.testing.assert_allclose((values(white.transform(df), "scores") ** 2).sum(0) / 39, 1, rtol=1e-6)


def test_kernel_pca(spark):
    x = RNG.normal(size=(30, 3))
    df = frame(spark, x)
    m = decomp.KernelPCA(n_components=3, fit_inverse_transform=True, alpha=1e-9).fit(df)
    p = decomp.PCA(n_components=3).fit(df)
    np.testing.assert_allclose(m.eigenvalues, p.sigma**2, rtol=1e-6)
    np.testing.assert_allclose(values(m.transform(df), "scores"), m.scores, atol=1e-8)
    r = decomp.KernelPCA(n_components=2, kernel="rbf").fit(df)
    np.testing.assert_allclose(values(r.transform(df), "scores"), r.scores, atol=1e-8)


@pytest.mark.parametrize("kernel", ["rbf", "linear", "poly"])
def test_kernel_pca_without_the_kernel(spark, kernel, monkeypatch):
    x = RNG.normal(size=(400, 6)) * np.array([3, 2.5, 2, 1, 1, 1])
    df = frame(spark, x).repartition(3)
    options = {"n_components": 3, "kernel": kernel, "gamma": 0.05, "degree": 2}
    want = decomp.KernelPCA(**options).fit(df)
    monkeypatch.setattr(decomp.KernelPCA, "LIMIT", 100)
    got = decomp.KernelPCA(**options).fit(df)
    np.testing.assert_allclose(got.eigenvalues, want.eigenvalues, rtol=1e-9)
    np.testing.assert_allclose(got.scores, want.scores, atol=1e-5)
    np.testing.assert_allclose(values(got.transform(df), "scores"), want.scores, atol=1e-5)
    with pytest.raises(ValueError):
        decomp.KernelPCA(kernel=kernel).fit(df)


def test_tsne_separates(spark):
    x, y = blobs(20, 2)
    m = decomp.TSNE(perplexity=8.0, max_iter=400).fit(frame(spark, x))
    a, b = m.embedding[y == 0], m.embedding[y == 1]
    assert np.linalg.norm(a.mean(0) - b.mean(0)) > 2 * max(a.std(), b.std()) and m.kl_divergence < 1
    with pytest.raises(ValueError):
        decomp.TSNE(perplexity=50.0).fit(frame(spark, x))


def test_tsne_of_listed_neighbours(spark, monkeypatch):
    x, _ = blobs(40, 3)
    df = frame(spark, x).repartition(3)
    start = RNG.normal(size=(120, 2)) * 1e-2
    want = decomp.TSNE(perplexity=8.0, max_iter=12, init="supplied").fit(df, start)
    monkeypatch.setattr(decomp.TSNE, "LIMIT", 50)
    got = decomp.TSNE(perplexity=8.0, max_iter=12, init="supplied").fit(df, start)
    np.testing.assert_allclose(got.embedding, want.embedding, rtol=1e-6, atol=1e-9)
    assert got.kl_divergence == pytest.approx(want.kl_divergence, abs=1e-6)
    with pytest.raises(ValueError):
        decomp.TSNE(perplexity=8.0, theta=0.0).fit(df)


# trees and support vectors


@pytest.mark.parametrize("criterion", ["gini", "entropy", "misclass"])
def test_tree_fits_training_rows(spark, criterion):
    x = RNG.normal(size=(60, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    df = frame(spark, x, label=y)
    m = trees.DecisionTree(criterion=criterion).fit(df)
    if criterion != "misclass":
        assert m.score(df) == 1.0
    found = m.predict(df).select("prediction", m.case_expression().alias("c"))
    assert found.where("prediction <> c").count() == 0
    stump = trees.DecisionTree(max_depth=1, criterion=criterion).fit(df)
    assert stump.depth <= 1
    p = values(stump.predict_proba(df), "proba")
    np.testing.assert_allclose(p.sum(1), 1)


def test_stump_is_the_best_split(spark):
    x = np.round(RNG.normal(size=(40, 2)), 1)
    y = RNG.integers(0, 3, 40)
    m = trees.DecisionTree(max_depth=1).fit(frame(spark, x, label=y))
    best = None
    for f in range(2):
        v = np.unique(x[:, f])
        for cut in (v[:-1] + v[1:]) / 2:
            left = x[:, f] <= cut
            s = sum(k.sum() * (1 - sum((np.bincount(y[k], minlength=3) / k.sum()) ** 2)) for k in (left, ~left)) / 40
            if best is None or s < best[0] - 1e-12:
                best = s, f, cut
    assert m.nodes[0][0][0] == best[1] and m.nodes[0][0][1] == pytest.approx(best[2])


def test_forest(spark):
    x, y = blobs(40, 3)
    df = frame(spark, x, label=y)
    m = trees.RandomForest(n_trees=8, max_depth=4, seed=2).fit(df)
    assert m.score(df) > 0.95 and len(m.nodes) == 8
    p = values(m.predict_proba(df), "proba")
    np.testing.assert_allclose(p.sum(1), 1)
    assert trees.RandomForest(n_trees=3, histogram=True, maximum_bins=16, seed=1).fit(df).score(df) > 0.9


def test_categories_one_vs_all(spark):
    x = np.repeat([[0.0], [1.0], [2.0], [3.0]], 10, axis=0)
    y = (x[:, 0] == 2).astype(int)
    m = trees.DecisionTree(max_depth=1, detect_categorical_data=True, category_split_strategy="one-vs-all").fit(frame(spark, x, label=y))
    assert m.score(frame(spark, x, label=y)) == 1.0 and m.nodes[0][0][3] == 1


@pytest.mark.parametrize("model", [svm.SVC(probability=True), svm.NuSVC(nu=0.3), svm.SVC(kernel="linear"), svm.SVC(kernel="poly")])
def test_svm_classification(spark, model):
    x, y = blobs(20, 3)
    df = frame(spark, x, label=y)
    assert model.fit(df).score(df) == 1.0
    d = values(model.decision_function(df), "decision")
    assert (d.argmax(1) == y).all()
    if model.probability:
        p = values(model.predict_proba(df), "proba")
        np.testing.assert_allclose(p.sum(1), 1, atol=1e-6)
        assert (p.argmax(1) == y).mean() > 0.95


def test_svc_meets_its_conditions():
    x = RNG.normal(size=(40, 2))
    y = np.where(x[:, 0] + 0.5 * RNG.normal(size=40) > 0, 1.0, -1.0)
    k = x @ x.T
    a, g, _ = svm.smo(k, y, -np.ones(40), np.zeros(40), np.ones(40), 1e-6, 0)
    b = -svm._bias(y, g, a, np.ones(40))
    f = y * (k @ (a * y) + b)
    assert abs(a @ y) < 1e-9
    assert (f[a < 1e-9] >= 1 - 1e-4).all() and (f[a > 1 - 1e-9] <= 1 + 1e-4).all()
    np.testing.assert_allclose(f[(a > 1e-6) & (a < 1 - 1e-6)], 1, atol=1e-4)


@pytest.mark.parametrize("model", [svm.SVC(tol=1e-5), svm.SVC(kernel="linear", tol=1e-5), svm.NuSVC(nu=0.4, tol=1e-5), svm.SVR(epsilon=0.05, tol=1e-5), svm.NuSVR(tol=1e-5)])
def test_working_sets_reach_the_same_machine(model, monkeypatch):
    x = RNG.normal(size=(300, 3))
    y = x[:, 0] + 0.5 * RNG.normal(size=300)
    y = np.where(y > 0, 1.0, -1.0) if model.CLASSIFY else y
    model.gamma_ = 0.3
    coef, bias, _ = model._solve(x, y)
    monkeypatch.setattr(svm, "LIMIT", 100)
    monkeypatch.setattr(svm.decomposed, "__defaults__", (False, 40, False))
    found, other, steps = model._solve(x, y)
    k = model._kernel(x, x)
    assert steps and np.abs(k @ (found - coef) + other - bias).max() < 2e-3


def test_no_limit_of_training_rows(spark, monkeypatch):
    monkeypatch.setattr(svm, "LIMIT", 20)
    x, y = blobs(20, 3)
    df = frame(spark, x, label=y)
    for kernel in ("linear", "rbf"):
        model = svm.SVC(kernel=kernel)
        monkeypatch.setattr(model, "_smo", lambda *a, m=model, **b: svm.decomposed(a[0], m._kernel, np.arange(len(a[1])), *a[1:], m.tol, 0, **b))
        assert model.fit(df).score(df) == 1.0
    df = frame(spark, np.linspace(-2, 2, 40)[:, None], label=np.sin(np.linspace(-2, 2, 40)))
    assert svm.SVR(C=10.0, epsilon=0.05).fit(df).score(df) > 0.97


@pytest.mark.parametrize("model", [svm.SVR(C=10.0, epsilon=0.05), svm.NuSVR(C=10.0)])
def test_svm_regression(spark, model):
    x = np.linspace(-2, 2, 40)[:, None]
    df = frame(spark, x, label=np.sin(x[:, 0]))
    assert model.fit(df).score(df) > 0.97


# interpolation


@pytest.mark.parametrize("kind", ["natural", "clamped", "custom"])
def test_spline(spark, kind):
    x = np.array([0.0, 1, 2.5, 4, 5])
    y = np.sin(x)
    m = spline.CubicSpline(kind, (1, 1.0), (2, 0.3)).fit(wide(spark, np.stack([x, y], 1)), x="c0", y="c1")
    at = lambda v, o: np.array([r[f"d{o}"] for r in m.evaluate(wide(spark, np.array(v)[:, None]), x="c0", orders=(0, 1, 2)).orderBy("c0").collect()])
    np.testing.assert_allclose(at(x, 0), y, atol=1e-12)
    for o in (0, 1, 2):  # smooth at the inner sites
        np.testing.assert_allclose(at(x[1:-1] - 1e-9, o), at(x[1:-1] + 1e-9, o), atol=1e-6)
    ends = at(x, 2)[[0, -1]] if kind == "natural" else at(x, 1)[[0, -1]]
    if kind == "custom":
        assert at([0.0], 1)[0] == pytest.approx(1.0) and at([5.0], 2)[0] == pytest.approx(0.3)
    else:
        np.testing.assert_allclose(ends, 0, atol=1e-9)
    assert at([9.0], 0)[0] == pytest.approx(at([5.0], 0)[0] + 4 * at([5.0], 1)[0] + 8 * at([5.0], 2)[0] + _third(m) * 64 / 6)


def _third(m):
    return 6 * m.cells.orderBy(F.desc("cell")).first().a


# models


def test_models_survive_disk(spark, tmp_path):
    x, y = blobs(15, 3)
    df = frame(spark, x, label=y, y=y.astype(float))
    for model, run in (
        (KMeans(n_clusters=3, seed=1, n_init=1).fit(df), lambda m: m.predict(df)),
        (decomp.PCA(n_components=2).fit(df), lambda m: m.transform(df)),
        (decomp.KernelPCA(n_components=2, kernel="rbf").fit(df), lambda m: m.transform(df)),
        (linear.LinearModel(intercept=True).fit(df, "x", "y"), lambda m: m.predict(df)),
        (trees.DecisionTree().fit(df), lambda m: m.predict(df)),
        (trees.RandomForest(n_trees=2).fit(df), lambda m: m.predict(df)),
        (svm.SVC().fit(df), lambda m: m.predict(df)),
        (neighbors.NearestNeighbors().fit(df, label="label"), lambda m: m.predict(df)),
        (neighbors.ApproximateNeighbors(n_list=2).train_and_add(df), lambda m: m.kneighbors(df)),
    ):
        path = f"{tmp_path}/{type(model).__name__}"
        save_model(model, spark, path)
        assert model_metadata(spark, path).first().model == type(model).__name__
        got, want = (sorted(map(_near, run(m).collect())) for m in (load_model(spark, path), model))
        assert got == want


def _near(row):
    """The row as text, floats to nine digits."""
    cut = lambda v: f"{v:.9g}" if isinstance(v, float) else [cut(x) for x in v] if isinstance(v, list) else v
    return str([cut(v) for v in row])


def test_options(spark):
    with pytest.raises(ValueError):
        KMeans(n_clusters=0)
    with pytest.raises(ValueError):
        KMeans(colour="red")
    m = KMeans(n_clusters=2)
    assert "n_clusters = 2 ('user')" not in m.print_options() and "(user)" in m.print_options()
    with pytest.raises(RuntimeError):
        m.set_params(n_clusters=3).need_fit()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert isinstance(compat.index_factory(3, "IVF4,Flat"), compat.IndexIVFFlat)
    flat = compat.index_factory(2, "Flat")
    flat.add(frame(spark, [[0.0, 0.0], [1.0, 1.0]]))
    assert flat.ntotal == 2 and flat.search(frame(spark, [[0.9, 0.9]]), 1).first().id_y == 1
