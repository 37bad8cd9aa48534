"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convrec.llm.common import cut
from convrec.llm.vectors import one_per_id, ranked


class BitSlices:
    """Bit-sliced block of integer vectors: bitmap (d, j) holds bit j of component d (less the
    block's smallest value there) of all rows, packed 64 rows to a word.  ``table`` has the
    bitmaps, then their complements, then an empty one."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, bits: int, table: np.ndarray):
        self.ids, self.low, self.bits, self.table = ids, low, bits, table

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> BitSlices:
        """``values``: (rows, components); rows are put in the order of their ids."""
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        low = values.min(axis=0) if values.shape[1] else np.zeros(0, np.int64)
        shifted = values.view(np.uint64) - low.view(np.uint64)  # exact: differences of 64-bit numbers fit
        bits = max(1, int(shifted.max(initial=0)).bit_length())
        rows = -(-len(ids) // 64) * 64
        planes = np.zeros((values.shape[1], bits, rows), np.uint8)
        for j in range(bits):
            planes[:, j, : len(ids)] = ((shifted >> np.uint64(j)) & np.uint64(1)).T
        packed = np.packbits(planes, axis=2, bitorder="little").reshape(values.shape[1] * bits, rows // 8).view(np.uint64)
        valid = np.zeros(rows, np.uint8)
        valid[: len(ids)] = 1
        valid = np.packbits(valid, bitorder="little").view(np.uint64)
        table = np.concatenate([packed, ~packed & valid, np.zeros((1, rows // 64), np.uint64), valid[None]])
        return cls(ids, low, bits, table)

    @property
    def empty(self) -> int:
        return len(self.table) - 2

    def exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products of one query with the rows at these positions, in numbers of any size; an
        error where one leaves 64 bits."""
        out = []
        words, bit = rows // 64, (rows % 64).astype(np.uint64)
        on = (self.table[: len(self.low) * self.bits, words] >> bit & np.uint64(1)).reshape(len(self.low), self.bits, len(rows))
        for r in range(len(rows)):
            values = [low + sum(int(b) << j for j, b in enumerate(on[d, :, r])) for d, low in enumerate(self.low.tolist())]
            out.append(sum(a * b for a, b in zip(query.tolist(), values)))
            if not -(1 << 63) <= out[-1] < 1 << 63:
                raise OverflowError("an inner product does not fit 64 bits")
        return np.array(out, np.int64)

    def sums(self, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Bitmaps of the inner products with each query (least significant first, one row a
        query) and what to add to the numbers they spell.

        A component adds its slices once per set bit of the query's component, shifted; a
        negative one adds complements.  All bitmaps of one weight are added three at a time
        (sum and carry), so nothing but bitwise operations on bitmaps happens.  The numbers may
        have any width; what to add is kept to 64 bits."""
        dims = len(self.low)
        q = np.zeros((len(queries), dims), np.int64)
        width = min(dims, queries.shape[1])
        q[:, :width] = queries[:, :width]
        size = np.abs(q)
        most = (1 << self.bits) - 1
        offset = q @ self.low - np.where(q < 0, size, 0).sum(axis=1) * np.int64(most if most < 1 << 63 else most - (1 << 64))
        base = np.arange(dims) * self.bits + np.where(q < 0, dims * self.bits, 0)
        by_weight: dict[int, list[list[int]]] = {}
        for i in range(int(size.max(initial=0)).bit_length()):
            on = (size >> i) & 1
            for r in range(len(q)):
                chosen = base[r][on[r] == 1]
                for j in range(self.bits):
                    by_weight.setdefault(i + j, [[] for _ in range(len(q))])[r].extend((chosen + j).tolist())
        carried: list[np.ndarray] = []
        out = []
        weight = 0
        while by_weight or carried:
            stack = carried
            carried = []
            if weight in by_weight:
                picks = by_weight.pop(weight)
                most = max(map(len, picks))
                index = np.array([p + [self.empty] * (most - len(p)) for p in picks], np.int64).reshape(len(q), most)
                if most:
                    stack = [*stack, self.table[index]]
            x = np.concatenate(stack, axis=1) if stack else self.table[np.full((len(q), 1), self.empty)]
            while x.shape[1] > 1:
                n = x.shape[1] // 3
                if n:
                    a, b, c = x[:, :n], x[:, n : 2 * n], x[:, 2 * n : 3 * n]
                    ab = a ^ b
                    carried.append((a & b) | (c & ab))
                    x = np.concatenate([ab ^ c, x[:, 3 * n :]], axis=1)
                else:
                    carried.append(x[:, :1] & x[:, 1:2])
                    x = x[:, :1] ^ x[:, 1:2]
            out.append(x[:, 0])
            weight += 1
        return out, offset

    def top(self, slices: list[np.ndarray], k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and sums of the k largest numbers spelt by ``slices`` (one query): from the
        most significant slice down, rows that are certain collect, rows that tie so far stay
        candidates; the tie that is left at the end goes to the smallest ids.  ``skip``: an id
        that takes no part."""
        sure = np.zeros_like(self.table[0])
        maybe = self.table[-1].copy()
        own = np.searchsorted(self.ids, skip)
        if own < len(self.ids) and self.ids[own] == skip:
            maybe[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        have = 0
        for s in reversed(slices):
            both = maybe & s
            n = int(np.bitwise_count(both).sum())
            if have + n > k:
                maybe = both
            else:
                sure |= both
                have += n
                maybe &= ~s
                if have == k:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if have < k:
            tied = np.flatnonzero(np.unpackbits(maybe.view(np.uint8), bitorder="little"))
            rows = np.concatenate([rows, tied[: k - have]])
        total = np.zeros(len(rows), np.int64)
        for j, s in enumerate(slices[:64]):
            total += ((s[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << j
        return rows, total


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers, shorter vectors filled up with zeros."""
    rows = lists.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(id, q)``: floor(scale * x) of every component of the usable rows."""
    rows = one_per_id(vectors, id_col, vec_col)
    fits = lambda x: F.abs(x * scale) < F.lit(float(1 << 63))
    large = F.raise_error(F.lit("a quantised component does not fit 64 bits")).cast("long")
    return rows.select("id", F.transform("v", lambda x: F.when(fits(x), F.floor(x * scale).cast("long")).otherwise(large)).alias("q"))


INDEX = "block bigint, ids binary, low binary, bits int, slices binary"


def _pack(t: pa.Table) -> pa.Table:
    s = BitSlices.build(t.column("id").to_numpy(), _matrix(t.column("q")))
    return pa.table({
        "block": t.column("block")[:1], "ids": [s.ids.tobytes()], "low": [s.low.tobytes()],
        "bits": pa.array([s.bits], pa.int32()), "slices": [s.table.tobytes()],
    })


def _unpack(row: dict) -> BitSlices:
    ids = np.frombuffer(row["ids"], np.int64)
    table = np.frombuffer(row["slices"], np.uint64).reshape(-1, -(-len(ids) // 64))
    return BitSlices(ids, np.frombuffer(row["low"], np.int64), row["bits"], table)


def _answers(index: BitSlices, asked_ids: np.ndarray, values: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The k best of a block for each query: its id, the ids found and their scores."""
    reach = index.low.astype(float)
    reach = np.maximum(np.abs(reach), np.abs(reach + 2.0**index.bits))
    for begin in range(0, len(values), 8):
        some = values[begin : begin + 8]
        sums, offset = index.sums(some)
        for r, q in enumerate(some):
            own = int(asked_ids[begin + r])
            rows, total = index.top([s[r] for s in sums], k, own)
            width = min(len(q), len(reach))
            wide = np.abs(q[:width].astype(float)) @ reach[:width] >= 2.0**62
            yield own, index.ids[rows], index.exact(q[:width], rows) if wide else total + offset[r]


def top_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 64,
    block_rows: int = 8192,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row where ``is_query`` (over the column
    ``id``) holds, the k rows of largest integer inner product, the row itself left out.

    Rows are packed into bit-sliced blocks.  The queries go to every block, never a block to
    several tasks: a task reads a block and then the queries behind it in its sorted partition, a
    batch at a time, and holds one of each.  Only k rows per query and block are shuffled on.

    Defined cases: null id, null vector, null or non-finite component: no part; a repeated id
    counts once (its smallest vector); vectors of different length: the missing components
    are 0; a quantised component, or one of the best scores, beyond 64 bits: an error; fewer than
    k candidates: all; empty table: empty result; other columns are ignored."""
    rows = cut(quantised(vectors, id_col, vec_col, scale))
    blocks = max(1, -(-rows.count() // block_rows))
    index = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInArrow(_pack, INDEX)
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    asked = rows.filter(is_query).withColumn("block", F.explode(every)).withColumn("kind", F.lit(1))
    both = index.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    both = both.repartition(blocks, "block").sortWithinPartitions("block", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of = None, -1
        for b in batches:
            kind, block = (b.column(c).to_numpy() for c in ("kind", "block"))
            edges = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (block[1:] != block[:-1])])) if b.num_rows else []
            for begin, end in zip(edges, [*edges[1:], b.num_rows]):
                part = b.slice(begin, end - begin)
                if not kind[begin]:
                    index, of = _unpack(part.to_pylist()[0]), block[begin]
                elif of == block[begin]:  # a block without rows has no answers
                    found = list(_answers(index, part.column("id").to_numpy(), _matrix(part.column("q")), k))
                    flat = lambda at: np.concatenate([f[at] for f in found]).astype(np.int64)
                    own = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, flat(1), flat(2))], names=["query_id", "vec_id", "score"])

    return ranked(both.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint"), k)
