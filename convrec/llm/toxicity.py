"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
import re
import weakref
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convrec.llm.common import cut, forget_kept, id_text, shuffle_width
from convrec.llm.quality import labelled_sample

_LETTERS = re.compile(r"[^\W\d_]+")
# The same letters below U+10000, spelled out: one look into a table per character.
_BMP_LETTERS = re.compile("[" + "".join(m.group()[0] + "-" + m.group()[-1] for m in _LETTERS.finditer("".join(map(chr, range(0x10000))))) + "]+")
SEARCHES = 64  # texts searched together
KNOWN_WORDS = 100_000  # words whose terms a worker remembers
PACKED = 256  # examples handled together while an index is made


def word_terms(word: str) -> tuple[str, ...]:
    """The terms of a lower-cased word: itself and its beginnings of four and five letters,
    which stand for inflected and compounded forms."""
    return (word, *(word[:n] + "-" for n in (4, 5) if len(word) > n))


def text_words(text: str) -> list[str]:
    """Runs of letters of a text, lower-cased."""
    low = text.lower()
    if low.isascii() or len(low.encode("utf-16-le", "surrogatepass")) == 2 * len(low):
        return _BMP_LETTERS.findall(low)
    return _LETTERS.findall(low)


def text_terms(text: str) -> Iterator[str]:
    for w in text_words(text):
        yield from word_terms(w)


@dataclass
class BlockMaxIndex:
    """Inverted index over unit vectors in blocks of ``block`` examples.  Terms of many examples
    (more than one in ``often``) are held as a dense matrix with the largest weight of every
    term in every block, the others as postings.  ``nearest_many`` is exact: the postings are
    summed in full, a block's bound is its largest such sum plus the bounds of the dense terms,
    and every block whose bound reaches the k-th cosine found is opened, for many queries at a
    time.  Opening works in single precision; what comes within its rounding error of the k-th
    cosine is computed again in double precision, from the examples' own weights."""

    examples: int
    terms: int
    block: int = 64
    often: int = 16
    start: np.ndarray = field(default=None)  # per term: first posting (none of dense terms)
    row: np.ndarray = field(default=None)
    weight: np.ndarray = field(default=None)
    column: np.ndarray = field(default=None)  # per term: column of the dense matrix or -1
    dense: np.ndarray = field(default=None)  # single precision
    bound: np.ndarray = field(default=None)  # dense terms x blocks
    own: tuple[np.ndarray, np.ndarray, np.ndarray] = field(default=None)  # per example: first entry; columns and exact weights

    @classmethod
    def build(cls, vectors: Sequence[tuple[np.ndarray, np.ndarray]], terms: int, block: int = 64) -> BlockMaxIndex:
        def slices() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for at in range(0, len(vectors), PACKED):
                t, w = zip(*vectors[at : at + PACKED])
                yield np.array([len(x) for x in t], np.int64), np.concatenate(t), np.concatenate(w)

        return cls.of_slices(slices, len(vectors), terms, block)

    @classmethod
    def of_slices(cls, slices: Callable[[], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], examples: int, terms: int, block: int = 64) -> BlockMaxIndex:
        """The index of the vectors that ``slices()`` gives, some at a time: their sizes, and their terms
        and weights behind one another.  They are gone through three times (sizes, dense part,
        postings), so that nothing but the index itself is ever held for all examples."""
        self = cls(examples, terms, block)
        held = np.zeros(terms, np.int64)
        for _, term, _ in slices():
            held += np.bincount(term, minlength=terms)
        many = np.flatnonzero(held * self.often > examples)
        self.column = np.full(terms, -1, np.int32)
        self.column[many] = np.arange(len(many))
        self.dense = np.zeros((examples, len(many)), np.float32)
        entries = int(held[many].sum())
        held[many] = 0
        self.start = np.concatenate([[0], np.cumsum(held)])
        self.row, self.weight = np.empty(self.start[-1], np.int32), np.empty(self.start[-1])
        self.own = np.zeros(examples + 1, np.int64), np.empty(entries, np.int32), np.empty(entries)
        free = self.start[:-1].copy()  # per term: where its next posting goes
        first_row = filled = 0
        for size, term, weight in slices():
            row = np.repeat(np.arange(first_row, first_row + len(size), dtype=np.int32), size)
            column = self.column[term]
            on = column >= 0
            self.dense[row[on], column[on]] = weight[on]
            now = filled + np.count_nonzero(on)
            self.own[0][first_row + 1 : first_row + len(size) + 1] = filled + np.cumsum(np.bincount(row[on] - first_row, minlength=len(size)))
            self.own[1][filled:now], self.own[2][filled:now] = column[on], weight[on]
            first_row, filled = first_row + len(size), now
            row, term, weight = row[~on], term[~on], weight[~on]
            order = np.argsort(term, kind="stable")
            term = term[order]
            begins = np.flatnonzero(np.diff(term, prepend=-1))
            counts = np.diff(begins, append=len(term))
            to = np.repeat(free[term[begins]] - begins, counts) + np.arange(len(term))
            self.row[to], self.weight[to] = row[order], weight[order]
            free[term[begins]] += counts
        self.bound = np.maximum.reduceat(self.dense, np.arange(0, examples, block)).T if examples else np.zeros((len(many), 0))
        return self

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """``nearest_many`` for one query."""
        return self.nearest_many([(terms, weights)], k, [skip])[0]

    def nearest_many(
        self, queries: Sequence[tuple[np.ndarray, np.ndarray]], k: int, skip: Sequence[int] | None = None
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and cosines of the k nearest examples of positive cosine of every query, nearest
        first, ties to the smaller row; ``skip`` leaves one row out of each.

        The blocks of the highest bounds are opened first, enough of them to hold k examples
        twice over; then those whose bound reaches the k-th cosine found, and no others."""
        if not self.examples or not queries:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        partial = np.zeros((len(queries), self.examples))
        asked = np.zeros((len(queries), self.dense.shape[1]))
        for i, (terms, weights) in enumerate(queries):
            column = self.column[terms]
            on = column >= 0
            asked[i, column[on]] = weights[on]
            partial[i] = self._postings(terms[~on], weights[~on])
        upper = np.maximum.reduceat(partial, np.arange(0, self.examples, self.block), axis=1) + asked @ self.bound
        slack = 1.2e-7 * (self.dense.shape[1] + 8)  # more than single precision can be off by
        cos = np.zeros(partial.shape, np.float32)
        first = np.argsort(-upper, axis=1, kind="stable")[:, : max(2, -(-2 * k // self.block))]
        opened = np.zeros(upper.shape, bool)
        np.put_along_axis(opened, first, True, axis=1)
        opened &= upper > 0
        self._open(opened, partial, asked, cos)
        own = np.full(len(queries), -1) if skip is None else np.asarray(skip)
        left_out = np.flatnonzero(own >= 0)
        cos[left_out, own[left_out]] = 0.0
        rest = (upper >= self._least(cos, k)[:, None] - slack) & (upper > 0) & ~opened
        self._open(rest, partial, asked, cos)
        cos[left_out, own[left_out]] = 0.0
        least = self._least(cos, k)
        out = []
        for c, low, rare, a in zip(cos, least, partial, asked):
            rows = np.flatnonzero((c > 0) & (c >= low - 2 * slack))
            first, column, weight = self.own
            parts = [slice(first[r], first[r + 1]) for r in rows]
            exact = rare[rows] + np.array([weight[p] @ a[column[p]] for p in parts])
            best = np.lexsort((rows, -exact.round(12)))[:k]
            out.append((rows[best], exact[best]))
        return out

    def _postings(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sum of the products over the terms held as postings, for every example."""
        begin, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.row[at], self.weight[at] * np.repeat(weights, size), self.examples)

    def _least(self, cos: np.ndarray, k: int) -> np.ndarray:
        """The k-th cosine found of every query (0 while there are fewer)."""
        return np.partition(cos, self.examples - k, axis=1)[:, self.examples - k] if k <= self.examples else np.zeros(len(cos))

    def _open(self, chosen: np.ndarray, partial: np.ndarray, asked: np.ndarray, cos: np.ndarray) -> None:
        asked = asked.astype(np.float32)
        share = chosen.sum(axis=0) / max(1, len(chosen))
        blocks = np.flatnonzero(share)
        if share[blocks].sum() > 0.5 * len(share):  # most of everything: at once, whoever asked
            np.add(partial, asked @ self.dense.T, out=cos, casting="same_kind")
            return
        for b in blocks:
            rows = slice(b * self.block, (b + 1) * self.block)
            q = np.flatnonzero(chosen[:, b])
            cos[q, rows] = partial[q, rows] + asked[q] @ self.dense[rows].T


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the weighted non-decreasing fit of ``y`` on ``x``, each
    pool smoothed by one observation of the overall mean."""
    pools: list[list[float]] = []  # sum of w x, sum of w y, sum of w
    at = None
    for a, b, c in sorted(zip(x.tolist(), y.tolist(), w.tolist())):
        if a == at:
            last = pools.pop()
            pools.append([last[0] + a * c, last[1] + b * c, last[2] + c])
        else:
            pools.append([a * c, b * c, c])
        at = a
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            q = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], q)]
    mean = float(np.average(y, weights=w))
    share = np.array([(p[1] + mean) / (p[2] + 1) for p in pools])
    return np.array([p[0] / p[2] for p in pools]), np.maximum.accumulate(share)


def unit(ids: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(tf)) * idf[ids]
    return ids, w / math.sqrt(float(w @ w)) if len(w) else w


class WordTerms(dict):
    """Lower-cased word -> its number; ``terms`` holds its (up to three) terms, -1 for none.  Words
    are forgotten all at once when there are ``KNOWN_WORDS`` of them."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.terms = vocabulary, array("q")

    def __missing__(self, word: str) -> int:
        get, letters = self.vocabulary.get, len(word)  # word_terms, spelled out
        at = self[word] = len(self)
        self.terms.extend((get(word, -1), get(word[:4] + "-", -1) if letters > 4 else -1, get(word[:5] + "-", -1) if letters > 5 else -1))
        return at

    def start(self) -> None:
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.terms = array("q")


# The models of one fit share their words in a worker, as long as one of them is held.
_SHARED: weakref.WeakValueDictionary[bytes, WordTerms] = weakref.WeakValueDictionary()


def shared_words(names: bytes) -> WordTerms:
    forget_kept()
    words = _SHARED.get(names)
    if words is None:
        text = zlib.decompress(names).decode()
        words = _SHARED[names] = WordTerms({t: i for i, t in enumerate(text.split("\n"))} if text else {})
    return words


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    ids: list
    labels: np.ndarray
    base: float  # share of label 1 among training texts without any term
    k: int
    knots: tuple[np.ndarray, np.ndarray] | None = None
    words: WordTerms | None = None
    counts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # terms of the examples and how often
    importance: np.ndarray = field(default_factory=lambda: np.zeros(0))  # training rows that each example stands for

    def __getstate__(self):
        """What travels is small: terms and counts, from which each worker makes the index."""
        packed = []
        for at in range(0, len(self.counts), PACKED):
            some = self.counts[at : at + PACKED]
            both = [np.concatenate([np.diff(t, prepend=0) for t, _ in some]), np.concatenate([n for _, n in some])]
            packed.append((np.array([len(t) for t, _ in some], np.int64), *(zlib.compress(x.astype(np.int32).tobytes(), 1) for x in both)))
        names = zlib.compress("\n".join(self.vocabulary).encode(), 1)
        return self.__dict__ | {"vocabulary": names, "counts": packed, "index": None, "words": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.words = shared_words(self.vocabulary)
        self.vocabulary = self.words.vocabulary
        packed, self.counts = self.counts, []  # a worker only searches

        def slices() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for size, *both in packed:
                gaps, n = (np.frombuffer(zlib.decompress(x), np.int32) for x in both)
                ends = np.cumsum(size)
                term = np.cumsum(gaps, dtype=np.int64)
                term -= np.repeat(np.concatenate([[0], term[ends[:-1] - 1]]), size)
                weight = (1 + np.log(n)) * self.idf[term]
                weight /= np.repeat(np.sqrt(np.add.reduceat(weight**2, ends - size)), size)
                yield size, term, weight

        self.index = BlockMaxIndex.of_slices(slices, sum(len(size) for size, *_ in packed), len(self.vocabulary))

    def frequencies(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The terms of the vocabulary that stand in each whole text, ascending, and how often."""
        counts = [Counter(text_words(t)) for t in texts]
        n = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64)
        bits = int(n.max(initial=0)).bit_length()  # key and count sort as one number
        terms, key = self._keys(counts)
        both = np.sort(((key << bits) + n[:, None])[terms >= 0])
        key = both >> bits
        first = np.flatnonzero(np.diff(key, prepend=-1))
        tf = np.add.reduceat(both & ((1 << bits) - 1), first).astype(float) if len(first) else np.zeros(0)
        key = key[first]
        cuts = np.searchsorted(key, np.arange(1, len(texts)) * len(self.vocabulary))
        return [(k - i * len(self.vocabulary), f) for i, (k, f) in enumerate(zip(np.split(key, cuts), np.split(tf, cuts)))]

    def document_frequencies(self, texts: Sequence[str]) -> np.ndarray:
        """The number of these whole texts that hold each term of the vocabulary."""
        terms, key = self._keys([set(text_words(t)) for t in texts])
        key = np.sort(key[terms >= 0])
        key = key[np.flatnonzero(np.diff(key, prepend=-1))]
        return np.bincount(key % max(1, len(self.vocabulary)), minlength=len(self.vocabulary))

    def _keys(self, words: Sequence[Collection[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The (up to three) terms of the distinct words of each text, and numbers that put the terms of
        one text behind those of the text before."""
        self.words = self.words if self.words is not None else WordTerms(self.vocabulary)
        self.words.start()
        word = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), np.int64)
        terms = np.frombuffer(self.words.terms, np.int64).reshape(-1, 3)[word]
        return terms, terms + np.repeat(np.arange(len(words)), [len(w) for w in words])[:, None] * len(self.vocabulary)

    def term_frequencies(self, text: str) -> dict[int, int]:
        """``frequencies`` of one text."""
        ids, tf = self.frequencies([text])[0]
        return dict(zip(ids.tolist(), tf.astype(int).tolist()))

    def vectors(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Unit TF-IDF vectors ((1 + ln tf) idf) of whole texts over the vocabulary."""
        return [unit(ids, tf, self.idf) for ids, tf in self.frequencies(texts)]

    def vote(self, rows: np.ndarray, cos: np.ndarray) -> float:
        """Distance-weighted vote of the nearest examples."""
        if not len(rows):
            return self.base
        w = 1.0 / (0.1 + np.sqrt(np.maximum(0.0, 2 - 2 * cos)))
        return float((w @ self.labels[rows] + 0.5 * self.base) / (w.sum() + 0.5))

    def calibrate(self, vectors: Sequence[tuple[np.ndarray, np.ndarray]], importance: np.ndarray) -> None:
        """Isotonic map from votes to shares of label 1, each example judged by the others."""
        if len(vectors) >= 20:
            votes = []
            for at in range(0, len(vectors), SEARCHES):
                some = vectors[at : at + SEARCHES]
                votes += [self.vote(*found) for found in self.index.nearest_many(some, self.k, range(at, at + len(some)))]
            self.knots = isotonic(np.array(votes), self.labels, importance)

    def judge(self, texts: Sequence[str]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Score, nearest examples and their cosines of every text."""
        for at in range(0, len(texts), SEARCHES):
            yield from self.judge_counts(self.frequencies(texts[at : at + SEARCHES]))

    def judge_counts(self, counts: Sequence[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """``judge`` for texts of these ``frequencies``."""
        for at in range(0, len(counts), SEARCHES):
            some = [unit(ids, tf, self.idf) for ids, tf in counts[at : at + SEARCHES]]
            for rows, cos in self.index.nearest_many(some, self.k):
                v = self.vote(rows, cos)
                if len(rows) and self.knots is not None:
                    v = float(np.interp(v, *self.knots))
                yield min(1.0, max(0.0, v)), rows, cos


def pack_counts(ids: np.ndarray, tf: np.ndarray) -> bytes:
    """Terms (ascending) and how often, as few bytes: gaps, then numbers."""
    return zlib.compress(np.concatenate([np.diff(ids, prepend=0), tf]).astype("<u4").tobytes(), 1)


def unpack_counts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, tf = np.frombuffer(zlib.decompress(packed), "<u4").reshape(2, -1)
    return np.cumsum(gaps, dtype=np.int64), tf.astype(float)


def fit(docs: DataFrame, labels: DataFrame, *args, **options) -> ToxicityModel:
    """``fit_and_count`` for the model alone."""
    return fit_and_count(docs, labels, *args, **options)[0]


def fit_and_count(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int = 4,
    rest: int = 2,
    per_class: int = 6000,
    max_examples: int = 6000,
    k: int = 15,
    keep: Sequence[str] | None = None,
) -> tuple[ToxicityModel, DataFrame | None]:
    """Learn from a bounded sample of labelled rows outside the held-out part: up to
    ``per_class`` of each label, weighted back to the labels' shares among all training rows.

    Examples: up to ``max_examples`` of the sample, chosen by another hash of the id, so they keep
    its mix of labels.  Terms: all that
    stand in an example, none selected.  Their document frequencies come from whole texts of
    all documents.  The votes of the examples on each other calibrate the score.

    Defined cases: no training rows: 0.5 for every text; one label only, or no term: the share
    of label 1; a document labelled twice counts once, by its larger label.

    With ``keep`` (columns) the terms of every document, which the document frequencies are taken
    from, are also written beside these columns, so that ``score_counted`` need not find them
    again; the second result reads them (None without terms or without ``keep``)."""
    sample, sizes = labelled_sample(docs, labels, label_col, id_col, text_col, parts, rest, per_class)
    sample = cut(sample.dropDuplicates(["id"]))
    had = {int(r["label"]): int(r["n"]) for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    everything_n = sum(sizes.values())
    share = sizes.get(1, 0) / everything_n if everything_n else 0.5
    if len(had) < 2:
        return ToxicityModel({}, np.zeros(0), BlockMaxIndex.build([], 0), [], np.zeros(0), share, k), None
    # another hash than the sample's own, which is already the smallest of each class
    other = F.xxhash64("id", F.lit(1))
    chosen = cut(sample.select("id", F.col("label").cast("int").alias("label"), "text").orderBy(other, "id").limit(max_examples))
    chosen_of = {int(r["label"]): int(r["n"]) for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = {y: sizes[y] / n for y, n in chosen_of.items()}  # examples back to all training rows
    chosen = chosen.repartition(shuffle_width(docs.sparkSession))

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for b in batches:
            for t in b.column("text"):
                found.update(text_terms(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["term"])

    terms = chosen.mapInArrow(terms_of, "term string").distinct().toArrow().column("term").to_pylist()  # those of max_examples texts
    vocabulary = {t: i for i, t in enumerate(sorted(terms))}

    blank = ToxicityModel(vocabulary, np.ones(len(vocabulary)), BlockMaxIndex.build([], 0), [], np.zeros(0), 0.0, k)
    shared = docs.sparkSession.sparkContext.broadcast(blank)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        df = np.zeros(len(model.vocabulary) + 1, np.int64)  # the last counts documents
        for b in batches:
            for at in range(0, b.num_rows, SEARCHES):
                df[:-1] += model.document_frequencies(b.column("text").slice(at, SEARCHES).to_pylist())
            df[-1] += b.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["t", "n"])

    def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SEARCHES):
                b = whole.slice(at, SEARCHES)
                found = model.frequencies([t or "" for t in b.column("__text").to_pylist()])
                packed = pa.array([pack_counts(*x) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), packed], names=[*keep, "__terms"])

    def packed_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value.vocabulary) + 1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, SEARCHES):
                found = [unpack_counts(x.as_py())[0] for x in b.column("__terms").slice(at, SEARCHES)]
                df[:-1] += np.bincount(np.concatenate(found), minlength=len(df) - 1)
            df[-1] += b.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["t", "n"])

    if keep is None:
        counted, partial = None, id_text(docs, id_col, text_col).mapInArrow(frequencies, "t bigint, n bigint")
    else:
        held = docs.select(*keep, F.col(text_col).alias("__text"))
        counted = cut(held.mapInArrow(count_rows, T.StructType([*docs.select(*keep).schema.fields, T.StructField("__terms", T.BinaryType())])))
        partial = counted.select("__terms").mapInArrow(packed_frequencies, "t bigint, n bigint")
    sums = partial.groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[sums.column("t").to_numpy()] = sums.column("n").to_numpy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1

    def example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tf = shared.value.frequencies(b.column("text").to_pylist())
            lists = [pa.array([x[i].astype(np.int32) for x in tf], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("label"), *lists], names=["id", "label", "terms", "tf"])

    held = chosen.mapInArrow(example_terms, "id string, label int, terms array<int>, tf array<int>").toArrow().combine_chunks()
    ids, ys = held.column("id").to_pylist(), held.column("label").to_numpy().astype(float)
    lists = [[x.values.to_numpy() for x in held.column(c)] for c in ("terms", "tf")]
    vectors = [unit(t, f.astype(float), idf) for t, f in zip(*lists)]
    empty = [weight[int(y)] * np.array([y, 1.0]) for y, (t, _) in zip(ys, vectors) if not len(t)]
    toxic, of = np.sum(empty, axis=0) if empty else (0.0, 0.0)
    base = (toxic + share) / (of + 1)
    # examples alike share a block, which keeps its bounds tight: those with the same heaviest terms
    heavy = [tuple(t[np.argsort(-w, kind="stable")[:3]].tolist()) for t, w in vectors]
    order = sorted((r for r in range(len(ids)) if len(vectors[r][0])), key=lambda r: (heavy[r], ids[r]))  # no terms: no cosine
    vectors, counts = [vectors[r] for r in order], [(lists[0][r], lists[1][r]) for r in order]
    ids, ys = [ids[r] for r in order], ys[order]
    importance = np.array([weight[int(y)] for y in ys])
    model = ToxicityModel(vocabulary, idf, BlockMaxIndex.build(vectors, len(vocabulary)), ids, ys, base, k, counts=counts, importance=importance)
    model.calibrate(vectors, importance)
    return model, counted


def score_texts(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: Sequence[str] | None = None, shown: int = 3) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` (calibrated share of label 1, 0 to 1)
    and ``evidence``: the ``shown`` nearest examples (id, label, cosine).  Null and empty texts,
    and texts without any term, get the base share and no evidence.  Input columns of these
    names are replaced."""
    kept = docs.drop("score", "evidence") if keep is None else docs.select(*keep, text_col)
    wanted = [c for c in kept.columns if keep is None or c in keep]
    return _scored(kept, model, wanted, shown, text_col, lambda m, texts: m.judge([t or "" for t in texts]))


def score_counted(counted: DataFrame, model: ToxicityModel, shown: int = 3) -> DataFrame:
    """``score_texts`` for the rows that ``fit_and_count`` wrote, from their counted terms."""
    wanted = [c for c in counted.columns if c != "__terms"]
    return _scored(counted, model, wanted, shown, "__terms", lambda m, packed: m.judge_counts([unpack_counts(p) for p in packed]))


def _scored(rows: DataFrame, model: ToxicityModel, wanted: Sequence[str], shown: int, read: str, judge: Callable) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by max_examples
    pair = pa.struct([("id", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 16 * SEARCHES):
                b = whole.slice(at, 16 * SEARCHES)
                scores, evidence = [], []
                for s, near, cos in judge(m, b.column(read).to_pylist()):
                    scores.append(s)
                    evidence.append([{"id": m.ids[r], "label": int(m.labels[r]), "cosine": float(c)} for r, c in zip(near[:shown], cos)])
                cols = [*(b.column(c) for c in wanted), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pair))]
                yield pa.RecordBatch.from_arrays(cols, names=[*wanted, "score", "evidence"])

    found = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))
    fields = [*rows.select(*wanted).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", found)]
    return rows.mapInArrow(run, T.StructType(fields))
