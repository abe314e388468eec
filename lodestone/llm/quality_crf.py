"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe its own characters and words and those of the
lines beside it; transition weights tie neighbours. Forward-backward gives each line's marginal
probability of being good, and their mean weighted by line length is the document's score.

Only documents carry labels, so the lines' labels are latent. A document of label 1 has good lines
only, one of label 0 at least one bad line. A first field, of the lines' own features alone, is
fitted to make these two events likely; the probability that all lines are good is the weight of
one path over the chain's partition sum, so value and gradient come from the forward-backward pass.
It tells which lines of a bad document are bad (many have good lines too), as no feature of a
neighbour can stand for the line. The field that scores is then fitted to these labels of lines,
with the features of their neighbours.

The field is fitted on the driver from a sample of labelled documents: at most `per_label` of each
label (those of least hash of their id) and at most `label_bytes` of their texts (documents that no
longer fit are passed over), so its cost does not grow with the corpus. Scores use the text alone.

Defined cases: a null or empty text is one empty line and gets a score; texts of any length are
scored whole, in memory that is a small multiple of the batch's bytes; repeated rows are scored
each, and of repeated ids the least text is learned from; a row without an id is scored, but never
learned from; a label row without a document, or with a null label, is ignored; with no labelled
rows, or one label alone, the prior rate of label 1 (0.5 if unknown) is every score; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import documents, map_arrow, stage

#: Training documents of each label, at most.
PER_LABEL = 2000
#: Bytes of the training texts of each label, at most.
LABEL_BYTES = 16 << 20
#: Strength of the quadratic penalty on standardised weights.
PENALTY = 1.0
#: Score from which a document is predicted to be good.
GOOD_FROM = 0.7

#: Features of the line itself; those of its neighbours follow.
OWN = 14

_SYMBOL, _UPPER, _LETTER, _DIGIT, _STOP, _BANG, _BAR, _HIGH = range(8)
_KIND = np.full(256, 99, np.uint8)
_KIND[[ord(c) for c in "#$%&*<>{}[]^~_=+/\\@`"]] = _SYMBOL
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
_KIND[ord("!")] = _BANG
_KIND[ord("|")] = _BAR
_KIND[128:] = _HIGH


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, bytes of each line, and the first line of each text (with an end)."""
    lines = [t.split("\n") for t in texts]
    first = np.cumsum([0, *map(len, lines)])
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-8", "surrogatepass") or b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    kind = _KIND[raw]
    count = np.stack([np.add.reduceat(kind == k, starts, dtype=np.int64) for k in range(8)]).astype(float)
    size = (ends - starts).astype(float)
    words, distinct, twice, again = (np.empty(len(ends)) for _ in range(4))
    i = 0
    for doc in lines:
        before = None
        for line in doc:
            w = line.split()
            words[i], distinct[i], twice[i], again[i] = len(w), len(set(w)), sum(map(eq, w, w[1:])), line == before
            before = line
            i += 1
    n, some = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(count[_UPPER] + count[_LETTER], 1)
    last = raw[np.maximum(ends - 1, 0)]
    own = np.stack(
        [
            count[_UPPER] / letters,
            np.sqrt(count[_SYMBOL] / n),
            np.minimum(count[_BANG] / some, 2),
            np.minimum(count[_BAR] / some, 1),
            twice / some,
            1 - distinct / some,
            np.log1p(size),
            again,
            np.sqrt(count[_DIGIT] / n),
            np.minimum(count[_STOP] / some, 2),
            np.minimum(size / some, 30) / 10,
            count[_HIGH] / n,
            (words < 4).astype(float),
            ((last == 46) | (last == 63)).astype(float),
        ],
        1,
    )
    beside = own[:, :8]
    before, after = np.zeros_like(beside), np.zeros_like(beside)
    before[1:], after[:-1] = beside[:-1], beside[1:]
    head, tail = np.zeros(len(own)), np.zeros(len(own))
    head[first[:-1]], tail[first[1:] - 1] = 1, 1
    before[head == 1], after[tail == 1] = 0, 0
    return np.hstack([own, before, after, head[:, None], tail[:, None]]), np.maximum(size, 1), first


def _steps(first: np.ndarray) -> list[np.ndarray]:
    """For each t, the t-th line of every text that has one; longer texts stand in front."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
    return [first[order[:n]] + t for t, n in enumerate(alive)]


def forward_backward(good: np.ndarray, move: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """good: each line's score for state 1 against 0. move[a, b]: score of state b after a.

    Gives P(state 1) of each line, the expected moves (summed over the texts, by their weight) and
    log Z of each text."""
    steps = _steps(first)
    n = len(good)
    emit = np.stack([np.zeros(n), good], 1)
    a, b = emit.copy(), np.zeros((n, 2))
    for t in range(1, len(steps)):
        at = steps[t]
        from_bad, from_good = a[at - 1].T
        for k in (0, 1):
            a[at, k] += np.logaddexp(from_bad + move[0, k], from_good + move[1, k])
    for t in range(len(steps) - 1, 0, -1):
        at = steps[t]
        to_bad, to_good = (b[at] + emit[at]).T
        for k in (0, 1):
            b[at - 1, k] = np.logaddexp(move[k, 0] + to_bad, move[k, 1] + to_good)
    z = np.logaddexp.reduce(a[first[1:] - 1], axis=1)
    each = np.repeat(z, np.diff(first))
    p = np.exp(np.minimum(a[:, 1] + b[:, 1] - each, 0))
    later = np.ones(n, bool)
    later[first[:-1]] = False
    at = np.flatnonzero(later)
    pair = np.exp(a[at - 1][:, :, None] + move + (b[at] + emit[at])[:, None, :] - each[at][:, None, None])
    if weight is not None:
        pair *= np.repeat(weight, np.diff(first))[at][:, None, None]
    return p, pair.sum(0), z


@dataclass
class LineField:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, then the bias
    move: np.ndarray
    prior: float

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, size, first = line_features(texts)
        good = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return forward_backward(good, self.move, first)[0], size, first

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not self.weights.any():
            return np.full(len(texts), self.prior)
        p, size, first = self.marginals(texts)
        return np.clip(np.add.reduceat(p * size, first[:-1]) / np.add.reduceat(size, first[:-1]), 0, 1)


def minimise(fn, x: np.ndarray, rounds: int = 150, memory: int = 10, tol: float = 1e-5) -> np.ndarray:
    """L-BFGS with a backtracking line search; fn gives the value and the gradient."""
    value, grad = fn(x)
    s_list, y_list = [], []
    for _ in range(rounds):
        q = grad.copy()
        kept = []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            alpha = (s @ q) / (y @ s)
            kept.append(alpha)
            q -= alpha * y
        if s_list:
            q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        for (s, y), alpha in zip(zip(s_list, y_list, strict=True), reversed(kept), strict=True):
            q += s * (alpha - (y @ q) / (y @ s))
        step = -q if s_list else -q / max(1.0, np.linalg.norm(q))
        slope = grad @ step
        if slope >= 0:
            step, slope = -grad, -(grad @ grad)
        rate = 1.0
        for _ in range(30):
            new_value, new_grad = fn(x + rate * step)
            if new_value <= value + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = rate * step, new_grad - grad
        x = x + s
        if s @ y > 1e-12:
            s_list, y_list = [*s_list, s][-memory:], [*y_list, y][-memory:]
        done = abs(value - new_value) <= tol * max(1.0, abs(value))
        value, grad = new_value, new_grad
        if done:
            break
    return x


def fit(texts: list[str], labels: list[int], penalty: float = PENALTY) -> LineField:
    """The field of the lines' labels that the texts' labels imply."""
    y = np.asarray(labels, float)
    prior = float(y.mean()) if len(y) else 0.5
    d = line_features([""])[0].shape[1]
    if len(set(labels)) < 2:
        return LineField(np.zeros(d), np.ones(d), np.zeros(d + 1), np.zeros((2, 2)), prior)
    x, _, first = line_features(texts)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    own = np.append(np.arange(OWN), d)  # features of the line itself, and the bias
    gold = infer_lines(x[:, own], first, y, penalty)
    later = np.ones(len(gold), bool)
    later[first[:-1]] = False
    at = np.flatnonzero(later)
    moves = np.zeros((2, 2))
    np.add.at(moves, (gold[at - 1].astype(int), gold[at].astype(int)), 1)

    def loss(v):
        w, move = v[:-4], v[-4:].reshape(2, 2)
        good = x @ w
        p, pair, z = forward_backward(good, move, first)
        value = z.sum() - gold @ good - (moves * move).sum() + penalty * (v @ v) / 2
        return value, np.concatenate([x.T @ (p - gold), (pair - moves).ravel()]) + penalty * v

    v = minimise(loss, np.zeros(x.shape[1] + 4))
    return LineField(mean, scale, v[:-4], v[-4:].reshape(2, 2), prior)


def latent_loss(v: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Value and gradient: texts of label 1 have good lines only, the others do not."""
    moves = np.diff(first) - 1.0
    w, move = v[:-4], v[-4:].reshape(2, 2)
    good = x @ w
    z = forward_backward(good, move, first)[2]
    # log of the probability that all lines of a text are good
    whole = np.minimum(np.add.reduceat(good, first[:-1]) + moves * move[1, 1] - z, -1e-12)
    value = -whole[y == 1].sum() - np.log(-np.expm1(whole[y == 0])).sum()
    slope = np.where(y == 1, -1.0, -np.exp(whole) / np.expm1(whole))  # of the value by `whole`
    p, pair, _ = forward_backward(good, move, first, slope)
    by_move = -pair
    by_move[1, 1] += slope @ moves
    by_good = np.repeat(slope, np.diff(first)) * (1 - p)
    return value + penalty * (v @ v) / 2, np.concatenate([x.T @ by_good, by_move.ravel()]) + penalty * v


def infer_lines(x: np.ndarray, first: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """A label for every line: 1 in texts of label 1; in the others the likelier one, at least one of them 0."""
    v = minimise(lambda v: latent_loss(v, x, first, y, penalty), np.zeros(x.shape[1] + 4))
    p = forward_backward(x @ v[:-4], v[-4:].reshape(2, 2), first)[0]
    least = np.repeat(np.minimum.reduceat(p, first[:-1]), np.diff(first))
    return ((p >= 0.5) & (p > least) | (np.repeat(y, np.diff(first)) == 1)).astype(float)


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(
    df: DataFrame,
    labels: DataFrame,
    per_label: int = PER_LABEL,
    label_bytes: int = LABEL_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "quality",
) -> LineField:
    """Fits a field on at most per_label documents and label_bytes of text of each label, none of them held out."""
    known = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).distinct()
    sample = None
    for k in (0, 1):
        part = known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        sample = part if sample is None else sample.union(part)
    texts = documents(df, id_col, text_col).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    texts = stage(texts, "quality-sample")
    room, chosen = {0: label_bytes, 1: label_bytes}, []
    for r in texts.select("doc_id", "label", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():  # at most 2 * per_label rows
        if r.size <= room[r.label]:
            room[r.label] -= r.size
            chosen.append((r.doc_id, r.label))
    fits = df.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    rows = sorted(texts.join(F.broadcast(fits), ["doc_id", "label"]).collect())
    return fit([r.text for r in rows], [r.label for r in rows])


def score(df: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield {"doc_id": part.column(0), "score": field.score(part.column(1).to_pylist())}

    return map_arrow(documents(df, id_col, text_col), run, "doc_id long, score double")


def keep_good(df: DataFrame, field: LineField, least: float = GOOD_FROM, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is at least `least`."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = ["" if t is None else t for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(field.score(texts) >= least))

    return df.mapInArrow(run, df.schema)


def crc_text(n: int) -> int:
    return zlib.crc32(str(n).encode())
