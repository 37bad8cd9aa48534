"""Quality classifier: supervised sub-word embeddings, trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convrec.llm.common import cut, id_text

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
# Features without meaning (zero vectors) added to every average, so that a text of a few
# words does not get an extreme score.
PAD = 64
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[name] = np.cumprod(steps)
    return have[:n]


def hashed_features(texts: Sequence[str], sizes: Sequence[int], log_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, text index)`` of every feature of the texts: each word (one that repeats the
    word before it counts as the bigram "same again" instead), and each character n-gram (``sizes``) inside a word, where the white space on either side counts as one
    character.  Case is kept.  One prefix sum over the code points gives the hash of any
    window, so there is no loop over words."""
    joined = " " + " ".join(texts) + " "
    x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts])  # position of the blank after each text
    blank = (x == 32) | ((x >= 9) & (x <= 13)) | (x == 0x85) | (x == 0xA0)
    x[blank] = 32
    n = len(x)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x * _powers(_P, "p", n), out=total[1:])
    inverse = _powers(_P_INV, "i", n + 1)
    blanks_before = np.zeros(n + 1, np.int64)
    np.cumsum(blank, out=blanks_before[1:])
    buckets, places = [], []

    def add(begin, end, salt):
        h = (total[end] - total[begin]) * inverse[begin] + np.uint64(salt)
        h = (h ^ (h >> np.uint64(29))) * _MIX
        buckets.append(((h ^ (h >> np.uint64(32))) * _MIX >> np.uint64(64 - log_buckets)).astype(np.int64))
        places.append(begin)

    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begin, end = edge[::2], edge[1::2]  # the text starts and ends with a blank: edges alternate
    word = (total[end] - total[begin]) * inverse[begin]
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    add(begin[~again], end[~again], 1)
    add(begin[again], begin[again], 2)  # bigram of a word with itself: one feature whatever the word
    for size in sizes:
        begin = np.arange(n - size + 1)
        inner = blanks_before[begin + size - 1] - blanks_before[begin + 1]
        begin = begin[inner == 0]
        add(begin, begin + size, size)
    place = np.concatenate(places)
    return np.concatenate(buckets), np.searchsorted(ends, np.maximum(place, 1), side="right")


@dataclass(frozen=True)
class SubwordModel:
    """``gain[b]``: what a feature in bucket b adds to the log-odds of label 1 (its vector times
    the difference of the two output vectors); a text's log-odds are the mean over its features
    plus ``bias``."""

    gain: np.ndarray
    bias: float
    sizes: tuple[int, ...]
    log_buckets: int
    pad: int = PAD

    def scores(self, texts: Sequence[str], part: int = 1 << 18) -> np.ndarray:
        """P(label 1) of whole texts; an empty one has no feature and gets the bias alone."""
        out = np.zeros(len(texts))
        begin = 0
        while begin < len(texts):  # texts together up to about ``part`` characters, always whole
            end, length = begin, 0
            while end < len(texts) and (end == begin or length + len(texts[end]) <= part):
                length += len(texts[end])
                end += 1
            bucket, which = hashed_features(texts[begin:end], self.sizes, self.log_buckets)
            sums = np.bincount(which, self.gain[bucket], end - begin)
            out[begin:end] = sums / (np.bincount(which, minlength=end - begin) + self.pad)
            begin = end
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.bias, -30, 30)))


def train(
    texts: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    importance: np.ndarray,
    sizes: tuple[int, ...],
    log_buckets: int,
    dim: int = 8,
    epochs: int = 6,
    steps: int = 18_000,
    rate: float = 0.5,
    seed: int = 7,
) -> SubwordModel:
    """Stochastic gradient descent on the log loss of softmax(W mean(vectors)).  ``texts``:
    per text its distinct buckets and their counts.  Steps have per-bucket Adagrad sizes; few
    texts are gone through more often, for about ``steps`` steps (60 epochs at most)."""
    if not texts:
        return SubwordModel(np.zeros(1 << log_buckets, np.float32), 0.0, sizes, log_buckets)
    epochs = max(epochs, min(60, steps // max(1, len(texts))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / dim, 1.0 / dim, (1 << log_buckets, dim)).astype(np.float32)
    heat = np.full(1 << log_buckets, 1e-6, np.float32)
    out = rng.uniform(-0.5, 0.5, (dim, 2)).astype(np.float32)
    out_heat = np.full((dim, 2), 1e-3, np.float32)
    prior = float(np.average(labels, weights=importance)) if len(labels) else 0.5
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    bias = np.array([np.log(1 - prior), np.log(prior)], np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(texts)):
            ids, counts = texts[k]
            if not len(ids):
                continue
            share = (counts / (counts.sum() + PAD)).astype(np.float32)
            rows = vectors[ids]
            hidden = share @ rows
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            err = p
            err[int(labels[k])] -= 1
            err *= importance[k]
            pull = out @ err
            g_out = np.outer(hidden, err)
            out_heat += g_out**2
            out -= step * g_out / np.sqrt(out_heat)
            heat[ids] += share**2 * float(pull @ pull)
            vectors[ids] = rows - (step * share / np.sqrt(heat[ids]))[:, None] * pull
    return SubwordModel((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), sizes, log_buckets)


def held_out(id_col: str, parts: int, rest: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == rest


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, parts: int, rest: int, per_class: int
) -> tuple[DataFrame, dict[int, int]]:
    """Up to ``per_class`` training texts of each label as ``(id, text, label)``, chosen by a
    hash of the id, and the number of training rows of each label.  Held-out rows, null labels
    and labels without a document take no part; a document labelled twice counts once, by its
    larger label."""
    known = labels.filter(F.col(label_col).isNotNull() & ~F.coalesce(held_out(id_col, parts, rest), F.lit(True)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).filter("label in (0, 1)")
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    known = cut(known.join(ids, "id", "left_semi"))
    counts = {int(r["label"]): int(r["n"]) for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    chosen = cut(picks[0].unionByName(picks[1]))  # at most 2 * per_class rows
    sample = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "id")
    return sample, counts


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int = 5,
    rest: int = 0,
    per_class: int = 1500,
    sizes: tuple[int, ...] = (3, 4),
    log_buckets: int = 18,
) -> SubwordModel:
    """Train on a bounded sample: at most ``per_class`` documents of each label outside the
    held-out part; classes are weighted back to their shares among all training rows.
    Executors turn whole texts into bucket counts; only those counts reach the driver.

    Defined cases: without training rows every text scores 0.5; with one label only, near it;
    null and empty texts teach the bias alone; other columns are ignored."""
    sample, counts = labelled_sample(docs, labels, label_col, id_col, text_col, parts, rest, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts = [], []
            for t in b.column("text"):
                u, c = np.unique(hashed_features([t.as_py()], sizes, log_buckets)[0], return_counts=True)
                ids.append(u.astype(np.int32))
                counts.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").cast(pa.string()), b.column("label").cast(pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["id", "label", "ids", "counts"],
            )

    got = sample.mapInArrow(run, "id string, label int, ids array<int>, counts array<int>").toArrow()
    got = got.sort_by([("id", "ascending")]) if got.num_rows else got
    seen, texts, ys = set(), [], []
    for i, y, u, c in zip(*(got.column(k) for k in ("id", "label", "ids", "counts"))):
        if i.as_py() not in seen:  # repeated documents teach once
            seen.add(i.as_py())
            texts.append((u.values.to_numpy(), c.values.to_numpy()))
            ys.append(y.as_py())
    y = np.array(ys, np.int64)
    importance = np.ones(len(y))
    for label, n in counts.items():
        if (y == label).any():
            importance[y == label] = n / (y == label).sum()
    importance /= importance.mean() if len(y) else 1.0
    return train(texts, y, importance, sizes, log_buckets)


def score_texts(docs: DataFrame, model: SubwordModel, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score``: P(label 1) of each whole text, null like
    empty.  An input column called ``score`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^log_buckets floats, whatever the input
    kept = docs.drop("score") if keep is None else docs.select(*keep, text_col)
    wanted = [c for c in kept.columns if keep is None or c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            cols = [b.column(c) for c in wanted]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(shared.value.scores(texts), pa.float64())], names=[*wanted, "score"])

    return kept.mapInArrow(run, T.StructType([*kept.select(*wanted).schema.fields, T.StructField("score", T.DoubleType())]))
