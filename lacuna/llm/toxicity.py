"""Toxicity: a subword-bag classifier trained here in numpy.

A token (lower-cased, between white space, punctuation stripped off its ends; one
that repeats among the last ``WINDOW`` does not count again) is
the mean of the embeddings of its character n-grams and of itself, hashed into a
table, so a misspelling never seen still shares most of a known word's vectors.
A bag is the mean of its tokens, and a linear softmax over it gives the class;
embeddings and softmax are trained jointly.  Bags are whole documents at first,
then each document's most toxic window of ``WINDOW`` tokens, picked anew as
training goes on.  A text's score is that of its most toxic window, so one abusive
passage shows in a long document; all of the text is read.

Only subwords whose share of toxic and of clean training texts differs by more than
chance among so many are learnt; with few labelled texts the others could only be
learnt by heart.

The classifier learns from at most ``SAMPLE`` labelled texts of either class, the
first by a hash of the id, whole texts of any length, as far as they come to
``SAMPLE_BYTES``; scores cover every row.  Null labels teach nothing, several
labels of an id count as the largest.  Null and empty texts are scored as an empty
bag.  Repeated rows and null ids are scored row by row; a null id is not held out.
An empty table gives no rows.  Without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, identified, small_batches, text_slices, within_bytes

WINDOW = 48
#: A bag counts as so many tokens at least, so that one odd word is not all of a short text.
LEAST = 24
#: Subwords in fewer training texts stay at zero: they can only be learnt by heart.
MIN_TEXTS = 4
#: The share of subwords that chance may have among those learnt.
FALSE = 0.05
#: What steps are damped by: rows that move few texts move little.
EPS = 1e-6
#: How strongly embeddings are drawn to zero.
DECAY = 1e-5
#: What the toxic class counts for in training, whatever its share of the sample.
PRIOR = 0.35
GRAMS = (3, 4, 5)
TABLE = 1 << 18
DIM = 8
#: Labelled texts of each class that training sees at most, and their bytes in all.
SAMPLE = 2400
SAMPLE_BYTES = 48 << 20
THRESHOLD = 0.3
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»…–—“”‘’"
#: Tokens a worker remembers at most, and their longest.
MEMO_TOKENS, MEMO_CHARS = 300_000, 12
_MUL = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words' subwords, and the word of each, in the words' order."""
    text = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    room = ends[word] - np.arange(len(points))
    rows, owners = [], []
    mixed = (points + np.uint64(1)) * _MUL
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(points), np.uint64)
        known = max(0, len(points) - n + 1)
        shifted[:known] = mixed[len(points) - known :]
        rolled = (rolled * np.uint64(0xC2B2AE3D27D4EB4F)) ^ shifted
        if n in GRAMS:
            at = np.flatnonzero(room >= n)
            rows.append(rolled[at] * _MUL + np.uint64(n))
            owners.append(word[at])
    place = np.arange(len(points)) - (ends - sizes)[word]
    whole = np.add.reduceat(mixed * ((place.astype(np.uint64) << np.uint64(1)) + np.uint64(1)), ends - sizes)
    rows.append(whole * _MUL + np.uint64(99))
    owners.append(np.arange(len(words)))
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    rows = ((rows ^ (rows >> np.uint64(33))) * _MUL) >> np.uint64(64 - TABLE.bit_length() + 1)
    by = np.argsort(owners, kind="stable")
    return rows[by].astype(np.int64), owners[by]


def tokens(text: str) -> list[str]:
    """The text's tokens but for those that repeat one of the last ``WINDOW``."""
    last: dict[str, int] = {}
    seen, out = last.get, []
    for i, t in enumerate(text.lower().split()):
        if i - seen(t, -WINDOW - 1) > WINDOW:
            out.append(t)
        last[t] = i
    return out


def _stripped(token: str) -> str:
    return token.strip(_STRIP)


def _best_window(scores: np.ndarray) -> tuple[int, float]:
    """Start and mean of the highest window; a shorter text is one window, of ``LEAST`` tokens at least."""
    n = len(scores)
    if not n:
        return 0, 0.0
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    w = min(WINDOW, n)
    means = (sums[w:] - sums[:-w]) / max(w, LEAST)
    at = int(np.argmax(means))
    return at, float(means[at])


@dataclass
class Model:
    """What scoring needs: each table row's pull towards the toxic class, and the bias."""

    pull: np.ndarray
    bias: float

    def of_tokens(self, found: list[str]) -> np.ndarray:
        words = [_stripped(t) for t in found]
        if not words:
            return np.zeros(0)
        rows, owners = features(words)
        n = len(words)
        return np.bincount(owners, self.pull[rows], n) / np.bincount(owners, minlength=n)


def _screened(rows: np.ndarray, spans: np.ndarray, docs: list[np.ndarray], y: np.ndarray, n_rows: int) -> np.ndarray:
    """Rows whose share of toxic and of clean texts differ by more than chance among so many rows.

    The bound holds the expected share of chance among those kept at ``FALSE``
    (Benjamini and Hochberg), so it falls as more rows are found to differ.
    """
    held = np.zeros((2, n_rows))
    for d, label in zip(docs, y, strict=True):
        if len(d):
            held[label, np.unique(np.concatenate([rows[spans[i] : spans[i + 1]] for i in set(d.tolist())]))] += 1
    sizes = np.array([max(1, (y == k).sum()) for k in (0, 1)])
    tried = held.sum(0) >= MIN_TEXTS
    share = held.sum(0) / sizes.sum()
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / sizes).sum())
    apart = np.abs(held[1] / sizes[1] - held[0] / sizes[0]) / spread
    most = np.sort(apart[tried])[::-1]
    chance = np.array([math.erfc(x / math.sqrt(2)) for x in most.tolist()])
    under = np.flatnonzero(chance <= FALSE * np.arange(1, len(most) + 1) / max(1, len(most)))
    return tried & (apart >= most[under[-1]]) if len(under) else np.zeros(n_rows, bool)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit on whole bags, then on each text's most toxic window."""
    if len(set(labels)) < 2:
        return Model(np.zeros(TABLE), -50.0)
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(_stripped(t), len(index)) for t in tokens(x)], np.int32) for x in texts]
    words, y = list(index), np.array(labels)
    rows, counts = [], []
    for at in range(0, len(words), 20_000):  # slices, and no array of owners, bound the memory
        r, o = features(words[at : at + 20_000])
        rows.append(r.astype(np.int32))
        counts.append(np.bincount(o, minlength=len(words[at : at + 20_000])))
    rows, counts = np.concatenate(rows), np.concatenate(counts)
    spans = np.concatenate(([0], np.cumsum(counts)))
    per = counts.astype(np.float32)
    known = _screened(rows, spans, docs, y, TABLE)
    keep = known[rows]
    # what is not learnt adds nothing to any sum: from here on only the screened rows are held
    owners = np.repeat(np.arange(len(words), dtype=np.int32), counts)[keep]
    rows, table = rows[keep], np.flatnonzero(known)
    rows = np.searchsorted(table, rows)
    emb = rng.normal(0, 0.1, (len(table), DIM)).astype(np.float32)
    soft = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moments = [np.zeros_like(x) for x in (emb, emb, soft, soft, bias, bias)]
    step = 0
    weight = np.where(y == 1, PRIOR / max(1, (y == 1).sum()), (1 - PRIOR) / max(1, (y == 0).sum()))
    speaks = np.zeros(len(words), bool)
    speaks[owners] = True

    def epoch_set(bags: list[np.ndarray]):
        sizes = np.array([len(b) for b in bags])
        flat = np.concatenate(bags) if bags else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(len(bags)), sizes)
        heard = speaks[flat]
        return flat[heard], doc[heard], np.maximum(sizes, LEAST)

    def sums(of: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(of, what[:, k], n) for k in range(what.shape[1])], 1)

    def descend(prepared, rate: float) -> None:
        nonlocal step
        step += 1
        flat, doc, most = prepared
        word = sums(owners, emb[rows], len(words)) / per[:, None]
        bag = sums(doc, word[flat], len(most)) / most[:, None]
        z = bag @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = p * weight[:, None]
        d_bag = (g @ soft.T) / most[:, None]
        d_word = sums(flat, d_bag[doc], len(words)) / per[:, None]
        d_emb = sums(rows, d_word[owners], len(emb))
        for i, (x, d) in enumerate(((emb, d_emb + DECAY * emb), (soft, bag.T @ g), (bias, g.sum(0)))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + EPS)

    def pulls() -> np.ndarray:
        return np.bincount(owners, (emb @ (soft[:, 1] - soft[:, 0]))[rows], len(words)) / per

    whole = epoch_set(docs)
    for _ in range(20):
        descend(whole, 0.05)
    for _ in range(8):
        pull = pulls()
        starts = [_best_window(pull[d])[0] for d in docs]
        windows = epoch_set([d[a : a + WINDOW] for d, a in zip(docs, starts, strict=True)])
        for _ in range(8):
            descend(windows, 0.05)
    out = np.zeros(TABLE)
    out[table] = emb @ (soft[:, 1] - soft[:, 0])
    return Model(out, float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, *, held_out: int | None = 2) -> DataFrame:
    """The bounded training sample ``doc_id, text, y``, whole texts of any length: no row that is held out."""
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    if held_out is not None:
        one = one.filter(part != held_out)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    one = one.join(text.select("doc_id"), "doc_id", "left_semi")
    chosen = None
    for label in (0, 1):
        some = bounded_sample(one.filter((F.col("toxic") > 0) == bool(label)), SAMPLE, "doc_id")
        chosen = some if chosen is None else chosen.unionAll(some)
    # at most 2 x SAMPLE ids
    rows = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = within_bytes(rows, "text", SAMPLE_BYTES, "doc_id")
    return rows.select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("y"))


def fit(some: DataFrame) -> Model:
    """``train`` on a bounded sample, in one task: neither texts nor embeddings come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch["text"].to_pylist()
            labels += batch["y"].to_pylist()
        model = train(texts, labels)
        yield pa.RecordBatch.from_pydict({"pull": [model.pull.tobytes()], "bias": [model.bias]})

    small_batches(some.sparkSession)
    made = some.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "pull binary, bias double").head()
    return Model(np.frombuffer(made.pull), made.bias) if made else train([], [])


def score_texts(model: Model, texts: list[str], memo: dict[str, float]) -> np.ndarray:
    split = [tokens(t) for t in texts]
    missing = list(set().union(*split).difference(memo)) if split else []
    room = len(memo) < MEMO_TOKENS
    for at in range(0, len(missing), 50_000):
        part = missing[at : at + 50_000]
        memo.update(zip(part, model.of_tokens(part).tolist(), strict=True))
    pick = memo.__getitem__
    best = np.array([_best_window(np.array([*map(pick, s)]))[1] for s in split])
    for t in missing:
        if not room or len(t) > MEMO_CHARS:
            del memo[t]
    return 1 / (1 + np.exp(-np.clip(best + model.bias, -500, 500)))


def toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> DataFrame:
    """``doc_id, score`` of every row, and with ``rest`` a struct of the row's own columns."""
    rows = identified(docs, id_col, text_col, rest).drop("tag")
    keep = ["doc_id"] + ["rest"] * rest
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE numbers, whatever the corpus

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in text_slices(batches):
            scores = score_texts(shared.value, batch["text"].to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(scores)], names=[*keep, "score"])

    return rows.mapInArrow(emit, rows.select(*keep, F.lit(0.0).alias("score")).schema)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = toxicity(docs, fit(sample(docs, labels)))
    return found.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
