"""Token operators against the public libraries."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from lodestone.llm import packing, sentencepieces, token_counts
from lodestone.llm.pieces import Vocabulary

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b\n", "a", "aaaaaaaaaaaa", "中文字符串测试龘龘", "<s></s><unk> <0x0A>", "▁ x", "😀😀 a😀", "a\tb\r\n c", "é̀ É", "ab" * 900, "Don't I'LL <|endoftext|>x", "\x1ca b\x85c\xa0d", "ΣΑΣ İ of!!", "x,.y,. z&&&"]


def texts(n=300, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlu éñ.,!0123") for _ in range(r.randint(1, 9)))
    return ODD + [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(rows)] + [(10**6, None, "en", 7), (5, rows[5], "de", 8)], "doc_id long, text string, lang string, n_tokens int")


def test_counts_equal_the_library(spark):
    t = texts()
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.token_counts(table(spark, t), PIECES, limit=100).collect()
    assert len(got) == len(t) + 2
    want = {i: len(x) for i, x in enumerate(lib.encode(t))} | {10**6: 0}
    for r in got:
        assert r.n_tokens == want[r.doc_id] and r.over_limit == (r.n_tokens > 100)
        assert r.n_bytes == (len(t[r.doc_id].encode()) if r.doc_id < 10**6 else 0)
    assert token_counts.token_counts(table(spark, t).limit(0), PIECES).count() == 0


def test_counts_survive_a_forgetful_worker():
    t = texts(60, 2)
    want = token_counts.count_texts(t, PIECES)
    np.testing.assert_array_equal(token_counts.count_texts(t, PIECES, remembered=3), want)


def test_merges_of_a_word_are_sequential():
    table_ = token_counts.MergeTable(Vocabulary(PIECES))
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(4)
    words = ["▁" + "".join(r.choice("abcdehiorst") for _ in range(r.randint(1, 40))) for _ in range(400)]
    np.testing.assert_array_equal(table_.counts(words), [len(x) for x in lib.encode([w[1:] for w in words])])


def unigram_library(scores):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    with open(PIECES, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.piece in scores and p.type == 1:
            p.score = scores[p.piece]
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_viterbi_equals_the_library_for_the_same_unigram_model():
    search = sentencepieces.PrefixViterbi(Vocabulary(PIECES))
    lib = unigram_library(search.scores)
    t = [x[:300] for x in texts(200, 3)]
    for text, got, want in zip(t, search.encode(t), lib.encode(t), strict=True):
        assert np.frombuffer(got, "<i4").tolist() == want, text


def test_viterbi_finds_the_best_sum():
    search = sentencepieces.PrefixViterbi(Vocabulary(PIECES))
    def best(word):  # all cuts
        score = {0: 0.0}
        for end in range(1, len(word) + 1):
            score[end] = max(score[s] + search.scores.get(word[s:end], search.unknown if end - s == 1 else -np.inf) for s in range(end))
        return score[len(word)]

    words = sorted({w for t in texts(40, 5) for w in search.vocabulary.words(t)})
    for w, ids in search.encode_words(words).items():
        pieces = [search.vocabulary.pieces[i] for i in np.frombuffer(ids, "<i4")]
        if all(p in search.scores for p in pieces):
            assert sum(search.scores[p] for p in pieces) == pytest.approx(best(w))


def test_encode_and_decode_round_trip(spark):
    t = [x for x in texts(100) if "▁" not in x]
    got = sentencepieces.decode(sentencepieces.encode(table(spark, t), PIECES), PIECES).collect()
    assert len(got) == len(t) + 2
    for r in got:
        assert r.text == (t[r.doc_id] if r.doc_id < 10**6 else "")


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(WORDS), packing.WordIds(WORDS, remembered=500)
    t = texts(300, 7)
    want = [e.ids for e in lib.encode_batch(t, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for k in range(0, len(t), 64) for x in mine(t[k : k + 64])]
    assert got == want


@pytest.mark.parametrize("size", [16, 4096])
def test_pieces_partition_the_tokens(spark, size):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    t = texts(200, 8)
    rows = packing.pack(table(spark, t).repartition(3), WORDS, size).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in [*enumerate(t), (10**6, "")]:
        ids = lib.encode(text, add_special_tokens=False).ids + [2]
        got = np.zeros(len(ids), int) - 1
        for r in by_doc[i]:
            assert r.doc_tokens == len(ids)
            got[r.start : r.start + r.length] = np.frombuffer(r.ids, "<u4")
        assert got.tolist() == ids
        assert sum(r.length for r in by_doc[i]) == len(ids) * (2 if i == 5 else 1)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at & (at - 1) == 0
    assert packing.pack(table(spark, t).limit(0), WORDS).count() == 0


def test_level_rule():
    p = packing.SumOfSquares(10)
    for i, n in enumerate([6, 6, 3]):
        p.place((i, 0, n, b"\0" * 4 * n, n))
    assert p.count.tolist() == [0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0]  # 6+3 rather than a third window
    assert len(p.place((3, 0, 1, b"\0" * 4, 1))) == 3  # fills the window of 9


@pytest.mark.parametrize("text", ["the" * 20_000, "ab" * 500 + "ba" * 20_000, "a" * 50_000, "Zq9+/" * 20_000, "x" + "é" * 10_000, " ".join(["thethethe" * 50] * 100)])
def test_long_unbroken_strings(text):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    began = time.process_time()
    assert token_counts.count_texts([text], path).tolist() == [len(library.encode(text, num_threads=1))]
    assert time.process_time() - began < 20


def test_packing_reads_how_the_tokenizer_cuts():
    texts = ["The house, isn't it?", "A b\u001cC", "", "café İstanbul ǅ x2y 'S don'T", "##a " * 50]
    for name, words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        encode = packing.WordIds(path)
        assert encode.by_words == words
        library = tokenizers.Tokenizer.from_file(path)
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
        assert encode(texts) == want
