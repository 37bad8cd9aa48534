"""Ranked lexical search over document FP-trees.

Every document is restricted to the terms that some item asks for, most frequent first.  The
documents of a block, in the order of these vectors, are the leaves of a trie: documents that
begin with the same frequent terms share a path.  A node knows, for each term, the largest tf
below it, and the smallest m and document below it; a term's share of the score grows with tf
and falls with m, so these bound every score below the node.  An item is searched depth first,
best bound first, and a branch is left out as soon as it cannot reach the k best found."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convrec.llm.common import LOWER, UPPER, cut, id_text

# Bytes to terms: ASCII letters and digits and all of UTF-8's other bytes stay (A-Z lower-cased),
# the rest separates.
SPLIT = bytearray(b" " * 128 + bytes(range(128, 256)))
for _kept, _as in ((b"0123456789", b"0123456789"), (LOWER.encode(), LOWER.encode()), (UPPER.encode(), LOWER.encode())):
    for _a, _b in zip(_kept, _as):
        SPLIT[_a] = _b
SPLIT = bytes(SPLIT)


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(SPLIT).split()


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of the score before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class DocumentTree:
    """FP-tree of restricted vectors.  ``rank`` holds terms by falling frequency; documents are
    rows ``start[i]:start[i+1]`` of ``rank`` and ``tf``; ``place`` orders documents of equal score.

    A node is a range of documents in the order of their vectors.  Paths are compressed: a node
    splits where its documents first differ; while one branch keeps over seven eighths of a
    node's documents, the others are cut off it as the node's own children, so the tree's depth
    is logarithmic.  Ranges of up to ``leaf`` documents are not split."""

    def __init__(self, rank: np.ndarray, tf: np.ndarray, start: np.ndarray, m: np.ndarray, place: np.ndarray, terms: int, leaf: int = 64):
        docs = len(start) - 1
        doc = np.repeat(np.arange(docs), np.diff(start))
        by_rank = np.lexsort((rank, doc))
        rank, tf = rank[by_rank], tf[by_rank]
        path = rank.astype(">u4").tobytes()
        keys = [(path[4 * a : 4 * b], x, y) for a, b, x, y in zip(start[:-1].tolist(), start[1:].tolist(), m.tolist(), place.tolist())]
        self.order = np.array(sorted(range(docs), key=keys.__getitem__), np.int64)
        size = np.diff(start)[self.order]
        self.start = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(start[self.order] - self.start[:-1], size) + np.arange(self.start[-1])
        self.rank, tf = rank[at], tf[at]
        self.m, self.place = m[self.order], place[self.order]
        self.part = share(tf, np.repeat(self.m, size))
        self.leaf, self.terms = leaf, terms
        self.common = self._common()
        self._grow()
        self._bounds(tf, size)

    def _common(self) -> np.ndarray:
        """Terms at the beginning that a document shares with the one before it."""
        out = np.zeros(len(self.order), np.int64)
        paths = np.split(self.rank, self.start[1:-1])
        for i in range(1, len(paths)):
            n = min(len(paths[i - 1]), len(paths[i]))
            differ = np.flatnonzero(paths[i - 1][:n] != paths[i][:n])
            out[i] = differ[0] if len(differ) else n
        return out

    def _packed(self, edges: list[int]) -> list[tuple[int, int]]:
        """Neighbouring ranges put together up to a leaf's size."""
        out: list[tuple[int, int]] = []
        for a, b in zip(edges, edges[1:]):
            if out and b - out[-1][0] <= self.leaf:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def _pieces(self, lo: int, hi: int) -> list[tuple[int, int]]:
        whole, out = hi - lo, []
        while hi - lo > self.leaf:
            inner = self.common[lo + 1 : hi]
            edges = [lo, *(lo + 1 + np.flatnonzero(inner == inner.min())).tolist(), hi]
            big = int(np.argmax(np.diff(edges)))
            if (edges[big + 1] - edges[big]) * 8 <= whole * 7:
                return out + self._packed(edges)
            out += self._packed(edges[: big + 1]) + self._packed(edges[big + 1 :])
            lo, hi = edges[big], edges[big + 1]
        return out + [(lo, hi)]

    def _grow(self) -> None:
        self.range, self.parent, self.level = [(0, len(self.order))], [-1], [0]
        self.children: list[np.ndarray | None] = []
        v = 0
        while v < len(self.range):
            lo, hi = self.range[v]
            if hi - lo <= self.leaf:
                self.children.append(None)
            else:
                pieces = self._pieces(lo, hi)
                first = len(self.range)
                self.range += pieces
                self.parent += [v] * len(pieces)
                self.level += [self.level[v] + 1] * len(pieces)
                self.children.append(np.arange(first, len(self.range)))
            v += 1

    def _bounds(self, tf: np.ndarray, size: np.ndarray) -> None:
        """Per term, the nodes that have it and the most it can add there."""
        parent, level = np.array(self.parent), np.array(self.level)
        self.least_place = np.array([self.place[a:b].min() for a, b in self.range])
        least_m = np.array([self.m[a:b].min() for a, b in self.range])
        leaf_of = np.zeros(len(self.order), np.int64)
        for v, kids in enumerate(self.children):
            if kids is None:
                leaf_of[slice(*self.range[v])] = v

        def largest(node: np.ndarray, rank: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key = node * self.terms + rank
            by_key = np.argsort(key, kind="stable")
            key = key[by_key]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return key[first] // self.terms, key[first] % self.terms, np.maximum.reduceat(tf[by_key], first)

        node, rank, top = largest(np.repeat(leaf_of, size), self.rank.astype(np.int64), tf)
        found = []
        for at in range(level.max(), 0, -1):
            here = level[node] == at
            now = node[here], rank[here], top[here]
            found.append(now)
            up = largest(
                np.concatenate([node[~here], parent[now[0]]]), np.concatenate([rank[~here], now[1]]), np.concatenate([top[~here], now[2]])
            )
            node, rank, top = up
        found.append((node, rank, top))
        node, rank, top = (np.concatenate(x) for x in zip(*found))
        by_term = np.lexsort((node, rank))
        self.node, rank, top = node[by_term], rank[by_term], top[by_term]
        self.most = share(top, least_m[self.node])
        self.first = np.searchsorted(rank, np.arange(self.terms + 1))

    def search(self, ranks: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (their input positions) of the k best scores above 0, best first, ties by
        ``place``, and the scores."""
        bound = np.zeros(len(self.range), np.int64)
        for r, w in zip(ranks.tolist(), weights.tolist()):
            on = slice(self.first[r], self.first[r + 1])
            bound[self.node[on]] += w * self.most[on]
        weight = np.zeros(self.terms, np.int64)
        weight[ranks] = weights
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least, last = 1, np.iinfo(np.int64).max  # score and place to reach
        stack = [0]
        while stack:
            v = stack.pop()
            if bound[v] < least or (bound[v] == least and self.least_place[v] > last):
                continue
            kids = self.children[v]
            if kids is not None:
                kids = kids[bound[kids] >= least]
                stack.extend(kids[np.argsort(bound[kids], kind="stable")].tolist())
                continue
            lo, hi = self.range[v]
            a, b = self.start[lo], self.start[hi]
            got = np.add.reduceat(weight[self.rank[a:b]] * self.part[a:b], self.start[lo:hi] - a)
            good = np.flatnonzero(got >= least)
            if not len(good):
                continue
            docs, scores = np.concatenate([docs, lo + good]), np.concatenate([scores, got[good]])
            best = np.lexsort((self.place[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(docs) == k:
                least, last = int(scores[-1]), int(self.place[docs[-1]])
        return self.order[docs], scores


def restricted_vectors(texts: DataFrame, vocabulary) -> DataFrame:
    """``(id, n, terms, tfs)`` of every row with a term: number of terms, and the term numbers of
    the ``vocabulary`` (a broadcast dictionary) that it holds with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for b in batches:
            kept, n, terms, tfs = [], [], [], []
            for i, t in enumerate(b.column("text")):
                words = terms_of(t.as_py())
                if words:
                    held = Counter(map(number, words))
                    held.pop(None, None)
                    kept.append(i)
                    n.append(len(words))
                    terms.append(list(held))
                    tfs.append(list(held.values()))
            ids = b.column("id").take(pa.array(kept, pa.int32()))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, n bigint, terms array<int>, tfs array<int>")


def item_groups(items: DataFrame, item_id: str, text_col: str, group_bytes: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and distinct terms of the items, in groups of about ``group_bytes`` of text (one item's
    text is never cut); one row an id, the smallest text."""
    rows = items.select(F.col(item_id).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("item is not null")
    rows = cut(rows.groupBy("item").agg(F.min("text").alias("text")))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    groups = max(1, -(-total // group_bytes))
    for g in range(groups):
        some = rows.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).orderBy("item").collect()
        if some:
            yield [r["item"] for r in some], [sorted(set(terms_of(r["text"]))) for r in some]


def block_search(shipped, n_docs: int, n_terms: int, k: int) -> Callable[[pa.Table], pa.Table]:
    """Search of one block of vectors for all items of the broadcast ``(rank, asked, item ids)``."""

    def search(t: pa.Table) -> pa.Table:
        rank, asked, names = shipped.value
        held = t.column("terms").combine_chunks()
        start = np.concatenate([[0], np.cumsum(pc.list_value_length(held).to_numpy())])
        terms, tfs = held.flatten().to_numpy(), t.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 50 + (50 * t.column("n").to_numpy() * n_docs) // n_terms
        place = np.empty(len(m), np.int64)
        place[pc.sort_indices(t.column("id"), null_placement="at_end").to_numpy()] = np.arange(len(m))
        tree = DocumentTree(rank[terms], tfs, start, m, place, len(rank))
        hits = [tree.search(r, w, k) for r, w in asked]
        item = np.repeat(np.arange(len(hits)), [len(d) for d, _ in hits])
        ids = t.column("id").take(pa.array(np.concatenate([d for d, _ in hits])))
        return pa.table({"item": names.take(pa.array(item)), "id": ids, "score": np.concatenate([s for _, s in hits])})

    return search


def best_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    group_bytes: int = 4 << 20,
    block_postings: int = 1 << 20,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for every item the k documents of highest score above 0.

    Items are searched in groups of bounded size, each against all documents: a group's terms go
    to all tasks, the documents come back as restricted vectors (written once), these are dealt
    into blocks of about ``block_postings`` entries, and a task grows the tree of a block and
    searches it for the group's items.  A block returns k rows an item, which are cut to k again
    before and after their shuffle.  Frequencies and lengths are counted over all documents.

    Defined cases: a null text, or one without a term, is no document of the statistics and is
    never found; of rows that repeat an item's id, the smallest text is the item; an item
    without an id has no result; rows that repeat a document's id are documents of their own;
    documents without an id come last among equal scores; empty tables: empty result; other
    columns are ignored."""
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    id_type, item_type = texts.schema["id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"item {item_type}, id {id_type}, score bigint"
    found = spark.createDataFrame([], schema)
    for item_ids, item_terms in item_groups(items, item_id, item_text, group_bytes):
        numbers = {t: i for i, t in enumerate(sorted({t for terms in item_terms for t in terms}))}
        vectors = cut(restricted_vectors(texts, spark.sparkContext.broadcast(numbers)).withColumn("row", F.monotonically_increasing_id()))
        whole = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        df = np.zeros(len(numbers), np.int64)
        counted = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toPandas()
        df[counted["t"]] = counted["df"]  # one number a term of the group
        if not df.any():
            continue
        n_docs, n_terms = whole["n"], whole["l"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
        asked = []
        for terms in item_terms:
            t = np.array([numbers[x] for x in terms], np.int64)
            t = t[(df[t] > 0) & (weights[t] > 0)]
            asked.append((rank[t], weights[t]))
        blocks = max(1, -(-int(df.sum()) // block_postings))
        shipped = spark.sparkContext.broadcast((rank, asked, pa.array(item_ids)))

        dealt = vectors.filter(F.size("terms") > 0).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        found = found.unionByName(dealt.groupBy("block").applyInArrow(block_search(shipped, n_docs, n_terms, k), schema))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    out = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
