"""Exact search, the quality classifier, and the pipeline."""

import random
import zlib

import numpy as np
import pytest

from lodestone.llm import quality_crf, topk_search


def brute_top(x, ids, k):
    out = {}
    for q, v in zip(ids, x, strict=True):
        s = sorted(((-int(v @ w), j) for j, w in zip(ids, x, strict=True) if j != q))[:k]
        out[q] = [(r, j, -t) for r, (t, j) in enumerate(s, 1)]
    return out


@pytest.mark.parametrize(("candidate_block", "query_block"), [(8192, 4096), (20, 7)])
def test_top_k_equals_brute_force(spark, candidate_block, query_block):
    r = np.random.default_rng(1)
    x = r.integers(-4, 5, (130, 6))
    x[20:60] = x[3]
    ids = r.permutation(1000)[:130]
    df = spark.createDataFrame([(int(i), [int(v) for v in row], "z") for i, row in zip(ids, x, strict=True)], "vec_id long, vector array<long>, score string")
    got = {}
    for row in topk_search.top_k(df, df, 5, candidate_block=candidate_block, query_block=query_block).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert {q: sorted(v) for q, v in got.items()} == brute_top(x, ids.tolist(), 5)
    assert topk_search.top_k(df.limit(0), df, 5).count() == 0
    assert topk_search.top_k(df.limit(3), df.limit(3), 5).count() == 6


def test_search_stops_before_the_end_of_the_lists():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 3)) * 100
    q = np.array([[300.0, 0.5, 0.1]])
    _, c, s = topk_search.threshold_search(np.rint(x), np.arange(3000), np.rint(q), np.array([-1]), 5)
    want = np.sort(np.rint(x) @ np.rint(q)[0])[::-1][:5]
    assert sorted(s.tolist(), reverse=True) == want.tolist() and len(c) == 5


def test_unusable_vectors_take_no_part(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None), (3, [float("nan")]), (4, [None]), (5, []), (6, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(r.vec_id for r in df.where(topk_search.finite("embedding")).collect()) == [1, 6]
    assert df.where("vec_id = 1").select(topk_search.integers("embedding", 64.0).alias("v")).first().v == [64]


# quality


def made(n, seed=1):
    r = random.Random(seed)
    word = lambda: r.choice("the of and a house river stone light under people water long time".split())
    line = lambda: " ".join(word() for _ in range(r.randint(4, 12))) + "."
    noise = [lambda: line().upper().replace(" ", "!! "), lambda: " | ".join(line().split()), lambda: line().replace(" ", "&&& "), lambda: (word() + " ") * 20]
    texts, labels = [], []
    for _ in range(n):
        good = r.random() < 0.7
        texts.append("\n".join((line if good or r.random() < 0.1 else r.choice(noise))() for _ in range(r.randint(2, 8))))
        labels.append(int(good))
    return texts, labels


def test_held_out_accuracy():
    field = quality_crf.fit(*made(300))
    texts, labels = made(300, 2)
    s = field.score(texts)
    assert ((s >= 0.7) == np.array(labels)).mean() > 0.97 and s.min() >= 0 and s.max() <= 1
    assert field.score([]).shape == (0,) and 0 <= field.score([""])[0] <= 1
    assert quality_crf.fit(["a"], [1]).score(["x", ""]).tolist() == [1.0, 1.0]
    assert quality_crf.fit([], []).score(["x"]).tolist() == [0.5]


def mixed(n, seed):
    """Documents with the labels of their lines; a bad one has good lines around its bad ones."""
    r = random.Random(seed)
    word = lambda: r.choice("the of and a house river stone light under people water long time".split())
    line = lambda: " ".join(word() for _ in range(r.randint(5, 12))) + "."
    noise = [lambda: line().upper().replace(" ", "!! "), lambda: " | ".join(line().split()), lambda: line().replace(" ", "&&& "), lambda: (word() + " ") * 20]
    out = []
    for _ in range(n):
        marks = [1] * r.randint(3, 9)
        if r.random() < 0.4:
            marks = [int(r.random() < 0.5) for _ in marks]
        out.append(("\n".join(line() if m else r.choice(noise)() for m in marks), marks))
    return out


def test_bad_lines_of_mixed_documents_are_found():
    """Learned from the labels of whole documents alone."""
    known = mixed(300, 4)
    field = quality_crf.fit([t for t, _ in known], [int(all(m)) for _, m in known])
    fresh = mixed(200, 5)
    p, _, first = field.marginals([t for t, _ in fresh])
    want = np.array([m for _, marks in fresh for m in marks])
    assert ((p >= 0.5) == want).mean() > 0.97
    parts = [p[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    both = [(x.min() < 0.5 < x.max()) for x, (_, m) in zip(parts, fresh, strict=True) if 0 < sum(m) < len(m)]
    assert np.mean(both) > 0.95
    s = field.score([t for t, _ in fresh])
    share = np.array([sum(len(x) for x, m in zip(t.split("\n"), marks, strict=True) if m) / sum(map(len, t.split("\n"))) for t, marks in fresh])
    assert np.abs(s - share).mean() < 0.05


def test_score_equals_enumeration():
    """Every path over the lines of a text, its weight from the field, and the mean of the lines' bytes."""
    field = quality_crf.fit(*made(80))
    texts = ["one line", "", "A!! B!!\nthe house of the people.\n\na | b", "x\nx\nx", "é é\nthe river"]
    for text, got in zip(texts, field.score(texts), strict=True):
        lines = text.split("\n")
        x = (plain_features(lines) - field.mean) / field.scale
        good = x @ field.weights[:-1] + field.weights[-1]
        total, on = 0.0, np.zeros(len(lines))
        for path in np.ndindex(*(2,) * len(lines)):
            w = np.exp(sum(g for g, s in zip(good, path, strict=True) if s) + sum(field.move[a, b] for a, b in zip(path, path[1:], strict=False)))
            total, on = total + w, on + w * np.array(path)
        size = np.array([max(1, len(x.encode())) for x in lines])
        assert got == pytest.approx((on / total) @ size / size.sum(), abs=1e-9)


def plain_features(lines):
    """The features of one text's lines, character by character."""
    own = []
    for i, line in enumerate(lines):
        raw, w = line.encode(), line.split()
        n, some = max(1, len(raw)), max(1, len(w))
        count = lambda chars, raw=raw: sum(chr(b) in chars for b in raw)
        upper, lower = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("abcdefghijklmnopqrstuvwxyz")
        own.append(
            [
                upper / max(1, upper + lower), (count("#$%&*<>{}[]^~_=+/\\@`") / n) ** 0.5, min(count("!") / some, 2), min(count("|") / some, 1), sum(a == b for a, b in zip(w, w[1:], strict=False)) / some,
                1 - len(set(w)) / some, np.log1p(len(raw)), float(i > 0 and lines[i - 1] == line), (count("0123456789") / n) ** 0.5, min(count(".,;:?'\"()-") / some, 2), min(len(raw) / some, 30) / 10,
                sum(b >= 128 for b in raw) / n, float(len(w) < 4), float(line[-1:] in (".", "?")),
            ]
        )
    none = [0.0] * 8
    return np.array([row + (own[i - 1][:8] if i else none) + (own[i + 1][:8] if i + 1 < len(own) else none) + [float(i == 0), float(i + 1 == len(own))] for i, row in enumerate(own)])


def test_gradient_of_the_latent_likelihood():
    texts, labels = made(12)
    x, _, first = quality_crf.line_features(texts)
    assert quality_crf.OWN == plain_features(["a"]).shape[1] - 18
    r = np.random.default_rng(0)
    v = r.normal(size=x.shape[1] + 4) * 0.3
    of = lambda v: quality_crf.latent_loss(v, x, first, np.array(labels), 1.0)
    grad = of(v)[1]
    for k in range(len(v)):
        step = np.zeros(len(v))
        step[k] = 1e-5
        assert (of(v + step)[0] - of(v - step)[0]) / 2e-5 == pytest.approx(grad[k], rel=1e-4, abs=1e-4)


def test_training_bytes_are_bounded(spark):
    texts, labels = made(80)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in enumerate(texts)] + [(None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(i, y) for i, y in enumerate(labels)] + [(None, 0)], "doc_id long, quality int")
    once = quality_crf.train(docs.dropDuplicates(), marks)
    np.testing.assert_array_equal(quality_crf.train(docs, marks).weights, once.weights)
    # a text that does not fit is passed over, the others are still learned from
    long = docs.union(spark.createDataFrame([(1000, "A!! " * 100_000)], "doc_id long, text string"))
    more = marks.union(spark.createDataFrame([(1000, 0)], "doc_id long, quality int"))
    np.testing.assert_array_equal(quality_crf.train(long, more, label_bytes=200_000).weights, once.weights)
    assert not quality_crf.train(docs, marks, label_bytes=0).weights.any()


def test_accuracy_on_rows_never_learned_from(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    field = quality_crf.train(docs, labels)
    rows = labels.where(quality_crf.held_out(labels.doc_id)).join(docs, "doc_id").select("text", "quality").collect()
    texts, want = [r.text or "" for r in rows], np.array([r.quality for r in rows])
    assert ((field.score(texts) >= quality_crf.GOOD_FROM) == want).mean() >= 0.99
    p, _, first = field.marginals(texts)
    parts = [p[a:b] for a, b, y in zip(first[:-1], first[1:], want, strict=True) if not y]
    assert sum(x.min() < 0.5 < x.max() for x in parts) >= 10  # bad documents with good lines


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    first = np.array([0, 4, 5, 9])
    good, move = r.normal(size=9), r.normal(size=(2, 2))
    p, pair, z = quality_crf.forward_backward(good, move, first)
    for d in range(3):
        n = first[d + 1] - first[d]
        total, on, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in np.ndindex(*(2,) * n):
            w = np.exp(sum(good[first[d] + i] for i in range(n) if path[i]) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            on += w * np.array(path)
        np.testing.assert_allclose(p[first[d] : first[d + 1]], on / total)
        assert z[d] == pytest.approx(np.log(total))
    assert pair.sum() == pytest.approx(6)


def test_training_keeps_to_its_rows(spark):
    texts, labels = made(120)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(999, None, "en")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(5000, 1), (1, None)], "doc_id long, quality int")
    a = quality_crf.train(docs, marks)
    turned = marks.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end AS quality")
    b = quality_crf.train(docs, turned)
    np.testing.assert_array_equal(a.weights, b.weights)
    got = quality_crf.score(docs, a)
    assert got.count() == 121
    rows = got.select("doc_id", quality_crf.held_out(got.doc_id).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert 0 < quality_crf.keep_good(docs, a).count() < 121


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts, labels = made(60, 3)
    r = random.Random(9)
    texts = [t if y == 0 else t + "\n" + " ".join(f"word{r.randint(0, 10**6)}" for _ in range(30)) for t, y in zip(texts, labels, strict=True)]
    i = labels.index(1)
    texts += [texts[i], texts[i] + " end"]
    labels += [1, 1]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        ids = {x.doc_id for x in docs.select("doc_id").collect()}
        if name == "quality":
            assert ids == {k for k, y in enumerate(labels) if y}
    assert i in ids and len(texts) - 1 not in ids and len(texts) - 2 not in ids
    assert all(x.n_chars == len(x.text) for x in docs.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == ids


def test_vectors_without_an_id_take_no_part(spark):
    df = spark.createDataFrame([(None, [9, 9]), (1, [1, 0]), (2, [2, 1])], "vec_id long, vector array<long>")
    got = sorted(tuple(r) for r in topk_search.top_k(df, df, k=5).collect())
    assert got == [(1, 1, 2, 2), (2, 1, 1, 2)]


def test_ties_of_large_scores_go_to_the_smaller_id():
    x = np.full((8192, 2), 2.0**22)
    x[::3] -= 1
    q, c, s = topk_search.threshold_search(x, np.arange(8192), np.array([[2.0**23, 2.0**23]]), np.array([-1]), 20)
    assert sorted(c) == [i for i in range(40) if i % 3][:20] and set(s) == {2**46}


def test_repeated_queries_have_results_of_their_own(spark):
    df = spark.createDataFrame([(1, [1, 0]), (1, [1, 0]), (1, [0, 1]), (2, [3, 1]), (3, [2, 5]), (4, [0, 0])], "vec_id long, vector array<long>")
    got = [tuple(r) for r in topk_search.top_k(df, df.where("vec_id = 1"), k=2).collect()]
    assert sorted(got) == sorted(2 * [(1, 1, 2, 3), (1, 2, 3, 2)] + [(1, 1, 3, 5), (1, 2, 2, 1)])
