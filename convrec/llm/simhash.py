"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convrec.llm.common import cut, id_text, shuffle_width
from convrec.llm.components import smallest_reachable

BITS = 64


def fingerprint(text: str, shingle: int = 4) -> int:
    """Signed 64-bit SimHash of a whole text: A-Z lower-cased, words between ASCII white space,
    shingles of ``shingle`` words (repeats included; a shorter text is one shingle; no word:
    0), XXH64 with seed 42; a bit is set if over half of the hashes set it."""
    words = text.encode("utf-8").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(flat, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        begins = [0, *ends[: len(words) - shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a : b - 1], 42) for a, b in zip(begins, ends[shingle - 1 :].tolist())]
    h = np.array(hashes, dtype="<u8")
    set_bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)`` of every row; whole texts, one at a time, null like empty."""
    narrow = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps, pa.int64())], names=["id", "fp"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, fp bigint")


def block_masks(max_bits: int, levels: int) -> list[list[int]]:
    """Signed bit masks by level.  Two fingerprints that differ in at most ``max_bits`` bits
    agree on one of ``max_bits + 1`` disjoint blocks; level 1 holds those blocks, and each
    mask of level l + 1 adds one of ``max_bits + 1`` blocks of the bits its parent leaves."""
    out, parents = [], [0]
    for _ in range(levels):
        masks = []
        for m in parents:
            free = [b for b in range(BITS) if not m >> b & 1]
            cuts = np.array_split(np.array(free, dtype=np.int64), max_bits + 1)
            masks += [m | sum(1 << int(b) for b in c) for c in cuts]
        out.append([int(np.uint64(m).astype(np.int64)) for m in masks])
        parents = masks
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence: neighbours differ in one bit."""
    r = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


class GrayIndex:
    """Hierarchy over fingerprints of several groups, each in Gray order.

    A node stands for up to ``fan`` consecutive nodes (or fingerprints) of one group and
    keeps the bits on which they all agree (``mask``) and their values (``pattern``).  A
    search goes down from the group's top nodes and adds up the differences on the bits each
    node fixes beyond its parent; once the sum exceeds the limit the whole group of
    fingerprints below is dropped."""

    def __init__(self, group: np.ndarray, codes: np.ndarray, fan: int = 8):
        """``group``: dense ids, ascending; ``codes`` sorted by Gray rank inside a group."""
        self.codes = codes
        zero = np.zeros(len(codes), np.uint64)
        self.levels = [(np.arange(len(codes) + 1), ~zero, codes)]  # first child, mask, pattern
        owner = group
        while len(owner) and len(owner) > len(np.unique(group)):
            first = np.r_[True, owner[1:] != owner[:-1]]
            starts = np.flatnonzero(first)
            within = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
            begin = np.flatnonzero(within % fan == 0)
            _, mask, pattern = self.levels[-1]
            all_mask = np.bitwise_and.reduceat(mask, begin)
            agree = ~(np.bitwise_or.reduceat(pattern, begin) ^ np.bitwise_and.reduceat(pattern | ~mask, begin))
            mask_up = all_mask & agree
            pattern_up = np.bitwise_or.reduceat(pattern, begin) & mask_up
            self.levels.append((np.r_[begin, len(owner)], mask_up, pattern_up))
            owner = owner[begin]
        self.top = np.searchsorted(owner, np.arange(owner[-1] + 1 if len(owner) else 0))

    def search(self, query: np.ndarray, group: np.ndarray, limit: int, width: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index into ``query``, index of a fingerprint) at most ``limit`` bits apart
        inside the query's group, in parts of bounded size."""
        todo = [(len(self.levels) - 1, np.arange(len(query)), self.top[group], np.zeros(len(query), np.uint8), np.zeros(len(query), np.uint64))]
        while todo:
            level, q, node, far, seen = todo.pop()
            if len(q) > width:
                half = len(q) // 2
                todo += [(level, q[s], node[s], far[s], seen[s]) for s in (slice(half), slice(half, None))]
                continue
            first, mask, pattern = self.levels[level]
            far = far + np.bitwise_count((query[q] ^ pattern[node]) & mask[node] & ~seen)
            keep = far <= limit
            q, node, far = q[keep], node[keep], far[keep]
            if level == 0:
                if len(q):
                    yield q, node
                continue
            count = first[node + 1] - first[node]
            at = np.repeat(first[node] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            todo.append((level - 1, np.repeat(q, count), at, np.repeat(far, count), np.repeat(mask[node], count)))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-index labels after joining the classes of ``a`` and ``b``."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt


def linked_in_task(pieces: dict[str, np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to one representative of those it is linked with inside a
    task.  ``pieces``: per row the key of its comparison (``path``, ``value``, ``i``, ``j``),
    its chunk and ``fp``; rows of one key with i = j meet each other, else chunk i meets j."""
    codes = pieces["fp"].view(np.uint64)
    order = np.lexsort((gray_rank(codes), pieces["j"], pieces["i"], pieces["value"], pieces["path"]))
    path, value, i, j, chunk = (pieces[k][order] for k in ("path", "value", "i", "j", "chunk"))
    codes = codes[order]
    new = np.r_[True, (path[1:] != path[:-1]) | (value[1:] != value[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    group = np.cumsum(new) - 1
    index = GrayIndex(group, codes)
    asks = np.flatnonzero((i == j) | (chunk == i))  # of two chunks, the first asks the second
    label = np.arange(len(codes))
    for q, e in index.search(codes[asks], group[asks], limit):
        q = asks[q]
        useful = np.where(i[q] == j[q], q < e, chunk[e] != i[q])
        label = merge_labels(label, q[useful], e[useful])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return codes[moved].view(np.int64), codes[label[moved]].view(np.int64)


def links(fps: DataFrame, max_bits: int = 4, chunk_rows: int = 1024, levels: int = 3) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of different fingerprints at
    most ``max_bits`` bits apart.  ``fps``: distinct ``fp``.

    Fingerprints are dealt out by blocks of bits (pigeonhole, exact).  A block value shared by
    more than ``chunk_rows`` fingerprints is split by further blocks, up to ``levels`` times,
    and what is still larger is cut into chunks that meet pairwise, so no group is ever held by
    one task whole and none is capped."""
    masks = block_masks(max_bits, levels)
    ways = max_bits + 1
    rows = fps.select(F.lit(0).cast("long").alias("path"), "fp")
    ready: list[DataFrame] = []
    for level, level_masks in enumerate(masks):
        paths = F.explode(F.sequence(F.col("path") * ways, F.col("path") * ways + (ways - 1)))
        rows = rows.select(paths.alias("path"), "fp")
        mask = F.element_at(F.array(*[F.lit(m) for m in level_masks]), (F.col("path") + 1).cast("int"))
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(mask))
        sizes = cut(rows.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        here = rows.join(sizes, ["path", "value"])
        last = level == levels - 1 or sizes.filter(F.col("n") > chunk_rows).isEmpty()
        done = here if last else here.filter(F.col("n") <= chunk_rows)
        ready.append(done.withColumn("level", F.lit(level)))
        if last:
            break
        rows = here.filter(F.col("n") > chunk_rows).select("path", "fp")
    out = ready[0]
    for r in ready[1:]:
        out = out.unionByName(r)
    chunks = F.ceil(F.col("n") / chunk_rows)
    out = out.withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    out = out.select(
        (F.col("level") * 1_000_000 + F.col("path")).alias("path"), "value", "fp", "chunk",
        F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
    )
    out = out.repartition(shuffle_width(fps.sparkSession), "path", "value", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is not None and t.num_rows:
            a, b = linked_in_task({c: t.column(c).to_numpy() for c in t.column_names}, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return out.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """``(id, fp, component_id)``, one row per input row: the SimHash of the whole text and
    the smallest id reachable over fingerprints at most ``max_bits`` bits apart.

    Equal fingerprints are one node of the graph, so a group of copies of any size is a
    single row from there on.  Defined cases: null or wordless text: fingerprint 0, linked
    like any other; repeated rows: one output row each; null id: keeps its row, never the
    smallest; empty table: empty result; other columns are ignored."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = smallest_reachable(links(nodes.select("fp"), max_bits))
    nodes = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    nodes = cut(nodes)
    best = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = nodes.join(best, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("id", "fp", "component_id")
