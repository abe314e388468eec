"""Deduplication operators against brute force."""

import random
import re

import numpy as np
import pytest

from lodestone.llm import cells, embedding_dedup, ngram_join, suffix_dedup


def union_find(n, pairs):
    root = list(range(n))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


# vectors


def vector_rows(seed=1, n=150, d=64):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 5, d))
    x = np.vstack([base[i % len(base)] + r.normal(size=d) * r.choice([0.15, 0.25, 0.35]) for i in range(n)])
    x[10:40] = x[9]
    return x.astype(np.float32)


def brute_vectors(x, threshold=0.95):
    x = x.astype(float)
    n = np.linalg.norm(x, axis=1)
    near = x @ x.T / np.outer(n, n) >= threshold - 1e-12
    np.fill_diagonal(near, False)
    return near.sum(1), union_find(len(x), list(zip(*np.nonzero(near), strict=True)))


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors_equal_brute_force(spark, block):
    x = vector_rows()
    rows = [(i, [float(v) for v in r], "k") for i, r in enumerate(x)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] * 64), (1004, [None] * 64), (1005, [1.0, 2.0]), (1006, [float("inf")] * 64)]
    df = spark.createDataFrame(rows + [(*b, "k") for b in bad], "vec_id long, embedding array<float>, rep string")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    links, part = brute_vectors(x)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], part[i], part[i] == i), i
    for i, _ in bad:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    r = np.random.default_rng(3)
    a = r.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    h = embedding_dedup.CrossPolytope(64, 10, 2, 7)
    x, y = h.buckets(a), h.buckets(b)
    met = (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean()
    assert met > 0.998
    far = r.permutation(len(a))
    assert (x[:, :, :, None] == x[far][:, :, None, :]).any((1, 2, 3)).mean() < 0.05


def test_rotations_keep_lengths():
    h = embedding_dedup.CrossPolytope(48, 1, 1, 1)
    x = np.random.default_rng(1).normal(size=(5, 48))
    np.testing.assert_allclose(np.linalg.norm(h.rotate(x, 0), axis=1), np.linalg.norm(x, axis=1))


# texts


def near_texts(seed=2):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu".split()) + str(r.randint(0, 30))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, 6)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = word()
            rows.append(" ".join(t).replace("eta", r.choice(["eta", "ETA", "eta,"])))
    return rows + ["", None, "one", "one", "ONE.", "...", "a b c d e", "a b c d e f"]


def brute_texts(rows, threshold=0.8):
    sets = []
    for t in rows:
        w = re.findall("[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9]
    links = np.bincount([k for p in pairs for k in p], minlength=len(rows))
    return links, union_find(len(rows), pairs)


@pytest.mark.parametrize("block", [1024, 2])
def test_texts_equal_brute_force(spark, block):
    rows = near_texts()
    df = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(rows)], "doc_id long, text string, key string, component long")
    got = {r.doc_id: r for r in ngram_join.ngram_join(df, block=block).collect()}
    links, part = brute_texts(rows)
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], part[i], part[i] == i), rows[i]
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    from corpus_pipeline import near_copies

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (2, b), (5, b + " more"), (5, c), (6, c + " more"), (7, None), (7, None), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.ngram_join(df).collect()), key=str)
    want = [(1, 1, 1, True), (1, 1, 1, False), (2, 1, 2, True), (5, 1, 2, False), (5, 2, 5, True), (6, 2, 5, False), (7, 0, 7, True), (7, 0, 7, True), (None, 2, 5, False)]
    assert got == sorted(want, key=str)
    left = sorted((tuple(r) for r in near_copies(spark, df, "").collect()), key=str)
    assert left == sorted([(1, a), (2, b), (5, c), (7, None), (7, None)], key=str)


def test_pairs_with_frequent_members():
    r = np.random.default_rng(1)
    sets = [np.unique(np.concatenate([np.arange(k % 3 * 100, k % 3 * 100 + 60), r.integers(1000, 1200, 8)])).astype(np.uint64) for k in range(60)]
    i, j = ngram_join.similar_pairs(sets, 0.8)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) > 100


def test_bands_meet_the_target_recall():
    r = np.random.default_rng(2)
    h, met = ngram_join.BandHasher(ngram_join.BANDS, ngram_join.ROWS), []
    for _ in range(300):
        common, own = r.integers(0, 1 << 62, 160).astype(np.uint64), r.integers(0, 1 << 62, 40).astype(np.uint64)
        b = h([np.unique(np.concatenate([common, own[:20]])), np.unique(np.concatenate([common, own[20:]]))])
        met.append((b[0] == b[1]).any())
    assert np.mean(met) > 0.99


def test_local_roots():
    i, j = np.array([5, 4, 3, 9]), np.array([4, 3, 2, 8])
    assert cells.local_roots(10, i, j).tolist() == [0, 1, 2, 2, 2, 2, 6, 7, 8, 8]


# repeated passages


def brute_repeats(docs, length=100):
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0))
        out[doc] = (len(raw), edge[::2].tolist(), edge[1::2].tolist(), raw, gone)
    return out


def repeat_docs(seed=4):
    r = random.Random(seed)
    words = ["alpha", "beta", "the", "of", "and", "été", "ñandú", "kappa"]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = [r.choice(base)[r.randint(0, 50) : r.randint(100, 300)] if r.random() < 0.5 else " ".join(str(r.random()) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 4))]
        docs.append((i, r.choice([" ", "\n", ""]).join(parts)))
    return docs + [(200, "a" * 500), (201, "ab" * 300), (202, None), (203, ""), (204, "a" * 99), (205, "a" * 100), (206, "x" * 30 + "a" * 101), (207, "\0" * 300), (208, docs[7][1])]


@pytest.mark.parametrize(("options", "sort_bytes"), [({"unit_bytes": 3000, "split_total": 1}, 3000), ({"unit_bytes": 300, "split_from": 9, "split_total": 4}, 1 << 20), ({"unit_bytes": 3000}, 1 << 20), ({"unit_bytes": 3000, "split_from": 1}, 2000), ({}, 1 << 20)])
def test_repeats_equal_brute_force(spark, options, sort_bytes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", sort_bytes)
    docs = repeat_docs()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, blob string").repartition(3)
    want = brute_repeats(docs)
    got = suffix_dedup.remove_repeats(df, **options).collect()
    assert len(got) == len(docs)
    for r in got:
        n, starts, ends, raw, gone = want[r.doc_id]
        assert (r.n_bytes, r.starts, r.ends) == (n, starts, ends), r.doc_id
        assert r.kept == bytes(np.frombuffer(raw, np.uint8)[~gone])
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_documents_without_an_id_come_last(spark):
    from corpus_pipeline import repeats

    long = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(None, long, "x", 1), (7, long, "y", 1), (None, "short", "x", 1)], "doc_id long, text string, lang string, n_chars long")
    got = sorted(((r.doc_id, len(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(7, len(long)), (None, 0), (None, 5)], key=str)
    assert sorted((tuple(r) for r in repeats(spark, df, "").collect()), key=str) == sorted([(7, long, "y", len(long)), (None, "", "x", 0), (None, "short", "x", 5)], key=str)


def test_cuts_keep_whole_characters(spark):
    passage = "é" * 120
    df = spark.createDataFrame([(1, "x" + passage), (2, "y" + passage + "z"), (3, "ü" + passage)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(df, as_text=True).collect()}
    assert got[2] == "yz" and all("�" not in t for t in got.values())


def test_suffix_array_lists_maximal_repeats():
    r = random.Random(5)
    data = bytes(r.choice(b"ab") for _ in range(400))
    starts = np.arange(400 - 8)
    array = suffix_dedup.SuffixArray(data, np.array([0]), np.array([400]), starts, np.zeros(len(starts), int), 8)
    found = {}
    for n, lo, hi in array.repeats(8):
        at = sorted(array.suffixes[lo : hi + 1].tolist())
        found[data[at[0] : at[0] + n]] = at
    want = {}
    for n in range(8, 60):
        where = {}
        for i in range(400 - n + 1):
            if i < len(starts):
                where.setdefault(data[i : i + n], []).append(i)
        for s, at in where.items():
            if len(at) < 2:
                continue
            before = {data[i - 1] if i else -1 for i in at}
            after = {data[i + n] if i + n < 400 else -k for k, i in enumerate(at, 1)}
            if (len(before) > 1 or 0 in at) and len(after) > 1:
                want[s] = at
    assert found == want
