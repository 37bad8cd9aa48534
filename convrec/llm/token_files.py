"""Token-id files: an adaptive context-mixing range coder over independently reset blocks."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convrec.llm.bpe import FAST, RULE, byte_alphabet
from convrec.llm.common import id_text, kept, shuffle_width
from convrec.session import scratch_path

_RULE_OR_END = re.compile(RULE.pattern + r"|\n")
_PIECE_END = b"|"  # no id has one byte
_ODD = f"<[|]|[^{FAST.pattern[1:-2]}]"  # what Python's rules don't split, or may be of a special token

MAGIC = b"CMR2"
BLOCK = 1024  # ids of a block; every block starts from an empty model
WINDOW = 62  # bits of the coder's interval; words of 32 bits leave at its top
LEAST = 1 << 30  # a shorter interval is widened by a word
WEIGHT = 1 << 20  # about the order-0 total, over which every id below 2^16 has at least 1, whatever was seen
MOST = 15  # highest odds of a guess, so that the total stays below 2^29
REFRESH = (32, 64)  # ids after which the order-0 cumulative counts are taken anew: at first, later
GAIN = 24  # of an id's range when the id was seen
LANES = 256  # whose counts are taken anew together

# Order-0 counts are kept for ranges of ids (widths are powers of 2), narrow where ids are
# frequent (small).
_EDGES = np.concatenate([np.arange(0, 2048, 32), np.arange(2048, 16384, 128), np.arange(16384, 65537, 1024)]).astype(np.int32)
_RANGES = len(_EDGES) - 1  # 224, searched as 28 groups of 8
_GROUP = 8
_RANGE_OF = (np.searchsorted(_EDGES, np.arange(65536), side="right") - 1).astype(np.uint8)
_FROM, _WIDTH = _EDGES[:-1], np.diff(_EDGES)
_WIDE, _INSIDE, _LOG = _WIDTH.astype(np.float32), _WIDTH - 1, np.log2(_WIDTH).astype(np.int32)

# A lane's 2^11 slots are lines of 16: the first 8 are for order 1, the others for order 2.
# A slot holds its guess and, in the low 3 bits, how sure it is.
_SLOTS, _LINE, _IN_LINE = 11, 0x7F0, 0x7F7
_SURER = np.array([0, -1, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0], np.int32)  # wrong: halved, right: one more
_RIGHT = np.array([((c + 1) << 16) + 11 - c for c in range(8)] * 2, np.int32)  # how often right, how often wrong


class Model:
    """Predictions of the next id for many blocks in lockstep, one lane each.

    The ids seen last after the same one and after the same two ids (order 1 and 2) are guesses; how often
    slots of like confidence were right in this block, to how often they were wrong, are a guess's odds
    against the orders below it.  Order 0 has adaptive counts of id ranges over a uniform floor.
    The mix is one cumulative function over ids, in whole numbers: floats only make weights, by
    single operations that IEEE 754 fixes, so encoder and decoder agree on every platform."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.at_range, self.at_slot = lane * (_RANGES + 1), lane << _SLOTS
        self.at_sure = np.stack([lane * 16, lane * 16 + 8])
        self.counts = np.ones((lanes, _RANGES), np.float32)
        self.cumulative = np.zeros((lanes, _RANGES + 1), np.int32)
        self.flat = self.cumulative.ravel()
        self.coarse = np.empty((_RANGES // _GROUP, lanes), np.int32)
        self.slots = np.zeros(lanes << _SLOTS, np.int32)
        self.rights = np.tile(_RIGHT, lanes)
        self.last = [np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)]
        self.recent: list[np.ndarray] = []  # ranges of the ids that are not in the counts yet
        self.until_refresh, self.steps = 0, 0

    def refresh(self) -> None:
        lanes = len(self.counts)
        for s in range(0, lanes, LANES):
            e = min(s + LANES, lanes)
            counts = self.counts[s:e]
            if self.recent:
                cells = np.stack([b[s:e] for b in self.recent], axis=1) + np.arange(0, (e - s) * _RANGES, _RANGES)[:, None]
                counts += GAIN * np.bincount(cells.ravel(), minlength=counts.size).reshape(counts.shape).astype(np.float32)
            share = counts / _WIDE
            share *= np.float32(WEIGHT) / counts.sum(axis=1, keepdims=True)
            each = share.astype(np.int32)
            each += 1
            each <<= _LOG
            np.cumsum(each, axis=1, out=self.cumulative[s:e, 1:])
            self.coarse[:, s:e] = self.cumulative[s:e, :-1:_GROUP].T
        self.whole = self.cumulative[:, -1].copy()
        self.recent = []
        self.until_refresh = REFRESH[self.steps > REFRESH[0]]

    def predict(self) -> None:
        if not self.until_refresh:
            self.refresh()
        one, two = self.last
        first = one * 40503 >> 4
        slot = np.empty((2, len(one)), np.int64)
        np.bitwise_and(first, _IN_LINE, out=slot[0])
        np.add(first & _LINE, (two * 30011 >> 5 & 7) + 8, out=slot[1])
        slot += self.at_slot
        self.slot, self.held = slot, self.slots.take(slot)
        self.p, self.c = self.held >> 3, self.held & 7
        self.cell = self.at_sure + self.c
        self.seen = self.rights.take(self.cell)
        odds = (self.seen >> 16).astype(np.float32)
        odds /= (self.seen & 0xFFFF).astype(np.float32)
        np.minimum(odds, MOST, out=odds)
        self.m = np.empty_like(self.seen)
        self.m[0] = self.whole * odds[0]
        self.total = self.whole + self.m[0]
        self.m[1] = self.total * odds[1]
        self.total += self.m[1]

    def order0(self, x: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of the share of x, of range b, without the guesses."""
        at = self.at_range + b
        low = self.flat.take(at)
        at += 1
        size = self.flat.take(at)
        size -= low
        size >>= _LOG.take(b)
        low += (x & _INSIDE.take(b)) * size
        return low, size

    def interval(self, x: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of x's share, from those without the guesses."""
        self.hit = (self.p == x).astype(np.int32)
        below, own = self.m * (self.p < x), self.m * self.hit
        return low + below[0] + below[1], size + own[0] + own[1]

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The id whose share holds v, its range, its share's begin and length."""
        p, m = self.p, self.m
        both = m[1] * (p[0] == p[1])  # the same guess twice counts as one
        m[0] += both
        m[1] -= both
        alone, size = self.order0(p, _RANGE_OF.take(p))
        low = alone.copy()
        less = p[0] < p[1]
        low[1] += m[0] * less
        low[0] += m[1] * ~less
        past = v - low
        size += m
        inside = past.view(np.uint32) < size.view(np.uint32)
        skip = m * (past >= size)
        u = v - skip[0]
        u -= skip[1]
        for k in (0, 1):  # a guess is found where order 0 has it
            np.copyto(u, alone[k], where=inside[k])
        b = np.add.reduce((self.coarse <= u).view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)
        b -= 1
        b *= _GROUP
        b += self.at_range
        for half in (4, 2, 1):  # the range within its group
            b += (self.flat.take(b + half) <= u) * half
        low = self.flat.take(b)
        size = self.flat.take(b + 1)
        b -= self.at_range
        size -= low
        size >>= _LOG.take(b)
        u -= low
        u //= size
        low += u * size
        u += _FROM.take(b)
        return (u, b, *self.interval(u, low, size))

    def learn(self, x: np.ndarray, b: np.ndarray) -> None:
        self.recent.append(b)
        self.steps += 1
        self.until_refresh -= 1
        k = self.hit << 3
        k += self.c
        held = _SURER.take(k)
        held += self.held
        np.copyto(held, x << 3, where=k == 0)
        self.slots[self.slot] = held
        self.rights[self.cell] = self.seen + (self.hit * 0xFFFF + 1)
        self.last = [x.astype(np.int64), self.last[0]]


def lanes_of(count: int) -> tuple[int, int]:
    """Number of blocks and of steps; the last block is filled up with zeros."""
    blocks = -(-count // BLOCK)
    return blocks, BLOCK if blocks > 1 else count


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Each block of ids (below 2^16) range coded on its own; all blocks go step by step together."""
    if not len(ids):
        return []
    n, steps = lanes_of(len(ids))
    m = np.zeros(n * BLOCK, np.uint16)
    m[: len(ids)] = ids
    m = np.ascontiguousarray(m.reshape(n, BLOCK)[:, :steps].T)
    model = Model(n)
    low, span = np.zeros(n, np.int64), np.full(n, 1 << WINDOW, np.int64)
    out = np.zeros((steps + 2, n), np.int64)  # a row has the next word of each lane, with its carry
    flat, at = out.ravel(), np.arange(n)
    for t in range(steps):
        model.predict()
        x = m[t].astype(np.int32)
        b = _RANGE_OF.take(x)
        begin, size = model.interval(x, *model.order0(x, b))
        r = span // model.total
        low += r * begin
        span = r * size
        short = np.flatnonzero(span < LEAST)
        part, to = low[short], at[short]
        flat[to] = part >> 30
        at[short] = to + n
        low[short] = (part & (LEAST - 1)) << 32
        span[short] <<= 32
        model.learn(x, b)
    flat[at] = low >> 30
    at += n
    flat[at] = (low & (LEAST - 1)) << 2
    out = out[: at.max() // n + 1]
    for t in range(len(out) - 1, 0, -1):
        out[t - 1] += out[t] >> 32
    words = np.ascontiguousarray(out.T.astype("<u4"))
    return [w[:e].tobytes() for w, e in zip(words, (at // n + 1).tolist())]


def decode_blocks(blocks: Sequence[bytes], count: int) -> np.ndarray:
    """The ``count`` ids of the blocks."""
    if not count:
        return np.zeros(0, np.uint16)
    n, steps = lanes_of(count)
    if n != len(blocks):
        raise ValueError("blocks are missing")
    model = Model(n)
    lengths = np.array([len(b) // 4 for b in blocks])
    at = np.cumsum(lengths) - lengths
    words = np.frombuffer(b"".join(blocks) + bytes(8), "<u4").astype(np.uint32)
    code = (words[at].astype(np.int64) << 30) | (words[at + 1] >> 2)
    words = ((words[:-1] & 3) << 30) | (words[1:] >> 2)  # as they follow the first 62 bits
    span, at = np.full(n, 1 << WINDOW, np.int64), at + 1
    out = np.zeros((steps, n), np.uint16)
    for t in range(steps):
        model.predict()
        r = span // model.total
        x, b, begin, size = model.find(np.minimum(code // r, model.total - 1).astype(np.int32))
        code -= r * begin
        span = r * size
        short = np.flatnonzero(span < LEAST)
        to = at[short]
        code[short] = (code[short] << 32) | words[to]
        at[short] = to + 1
        span[short] <<= 32
        out[t] = x
        model.learn(x, b)
    return np.ascontiguousarray(out.T).ravel()[:count]


def pack_segment(doc_ids: Sequence[int | None], sizes: Sequence[int], ids: np.ndarray) -> bytes:
    """One segment of a file: header, document ids (with a byte that tells null ids) and lengths,
    then per block its length and CRC-32, then the blocks."""
    blocks = encode_blocks(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = struct.pack("<4sIQQI", MAGIC, BLOCK, len(doc_ids), len(ids), len(blocks))
    parts = [head, known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(sizes, "<u8").tobytes()]
    parts.append(np.array([[len(b), zlib.crc32(b)] for b in blocks], "<u4").reshape(-1, 2).tobytes())
    return b"".join(parts + blocks)


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a segment; a damaged block raises."""
    magic, block, docs, count, blocks = struct.unpack_from("<4sIQQI", data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a segment of this format")
    at = struct.calcsize("<4sIQQI")
    known = np.frombuffer(data, np.uint8, docs, at)
    doc_ids = np.frombuffer(data, "<i8", docs, at + docs)
    sizes = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    table = np.frombuffer(data, "<u4", 2 * blocks, at + 17 * docs).reshape(-1, 2)
    at += 17 * docs + 8 * blocks
    found = []
    for i, (length, crc) in enumerate(table.tolist()):
        found.append(data[at : at + length])
        at += length
        if len(found[-1]) != length or zlib.crc32(found[-1]) != crc:
            raise ValueError(f"block {i} is damaged")
    return [int(d) if k else None for d, k in zip(doc_ids, known)], sizes, decode_blocks(found, count)


class LibraryPieces:
    """Ids by the tokenizers library.  A text's ids are those of its pieces between white space,
    one after the other (nothing in the tokenizer file looks across white space).  Pieces of common
    characters are cut into words in Python, by the file's own rule, and each distinct word goes to
    the library's model; other pieces, and those that may hold a special token, go to the library
    as they are.  A worker keeps up to ``cache`` pieces and half as many words, and those met again outlive the
    others."""

    def __init__(self, path: str, cache: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(1 << 16, bool)  # ids that end a word
        for token, i in spec["model"]["vocab"].items():
            self.last[i] = token.endswith(self.end)
        # the file's model alone: words in the byte alphabet, between spaces
        alone = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "truncation": None, "padding": None}
        self.model = Tokenizer.from_str(json.dumps(spec | alone))
        self.alphabet = byte_alphabet()
        self.cache = cache
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def model_ids(self, words: Sequence[str], together: int = 100) -> list[bytes]:
        """The ids of each word, some words to a text."""
        table = self.alphabet
        coded = [w if w.isascii() else "".join([table[b] for b in w.encode()]) for w in words]
        texts = [" ".join(coded[i : i + together]) for i in range(0, len(coded), together)]
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable([e.ids for e in found]), "<u2")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word's last id ends no word")
        raw, ends = ids.tobytes(), (2 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, pieces: Sequence[str]) -> None:
        """Adds new distinct pieces to the known ones."""
        odd, common = [], pieces
        low = "\n".join(pieces)
        if not FAST.fullmatch(low) or "<|" in low:
            strange = pc.match_substring_regex(pa.array(pieces, pa.string()), _ODD).to_numpy(zero_copy_only=False)
            odd, common = list(compress(pieces, strange)), list(compress(pieces, ~strange))
            low = "\n".join(common)
        low = low.lower()
        if not FAST.fullmatch(low):  # a lower-case letter may lie elsewhere
            odd += [p for p in common if not FAST.fullmatch(p.lower())]
            common = [p for p in common if FAST.fullmatch(p.lower())]
            low = "\n".join(common).lower()
        for p, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False)):
            self.known[p] = np.array(e.ids, "<u2").tobytes()
        if not common:
            return
        if len(self.words) > self.cache // 4:
            self.words, self.older_words = {}, self.words
        words, older, new = self.words, self.older_words, []
        split = _RULE_OR_END.findall(low + "\n")
        words["\n"] = _PIECE_END
        for w in set(split) - words.keys():
            if (was := older.get(w)) is not None:
                words[w] = was
            else:
                new.append(w)
        words.update(zip(new, self.model_ids(new)))
        coded = [words[w] for w in split]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(size)[size == len(_PIECE_END)]
        raw, begins, ends = b"".join(coded), [0, *ends.tolist()], (ends - len(_PIECE_END)).tolist()
        self.known.update(zip(common, [raw[a:b] for a, b in zip(begins, ends)]))

    def encode(self, texts: pa.Array, end_id: int, part: int = 1 << 22) -> Iterator[np.ndarray]:
        """The ids of each whole text, with ``end_id`` behind them; texts are taken together up to
        about ``part`` bytes."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(texts):
            before = int(size[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + part, "right")))
            yield from self.encode_part(texts.slice(begin, end - begin), end_id)
            begin = end

    def encode_part(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy().astype(np.int64)
        pieces = split.flatten().dictionary_encode()
        ends, distinct = ends[1:] - ends[0], pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.cache // 2:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        coded = list(map(known.get, distinct))
        for i, p in enumerate(distinct):
            if coded[i] is None:
                if (was := older.get(p)) is not None:
                    coded[i] = known[p] = was
                else:
                    new.append(i)
        self.learn([distinct[i] for i in new])
        for i in new:
            coded[i] = known[distinct[i]]
        coded.append(np.array([end_id], "<u2").tobytes())
        length = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
        pool, at = np.frombuffer(b"".join(coded), "<u2"), np.cumsum(length) - length
        order = np.insert(pieces.indices.to_numpy(), ends, len(distinct))  # the end id behind each text
        length = length[order]
        to = np.cumsum(length)
        ids = pool[np.repeat(at[order] - (to - length), length) + np.arange(to[-1])]
        ends = to[ends + np.arange(len(ends))].tolist()
        for a, b in zip([0, *ends], ends):
            yield ids[a:b]


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 1 << 22
) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, in ascending id order.

    The folder ``path`` gets one file per range of document ids, its rows the segments of
    that range in order: ``(part, segment, n_ids, data)`` with ``data`` as of pack_segment.
    Spark's own writer commits the files, so any shared store will do and a lost executor
    leaves nothing half written.  A segment ends with the document that brings it to
    ``segment_ids`` ids."""
    narrow = id_text(docs, id_col, text_col)
    ordered = narrow.repartitionByRange(shuffle_width(docs.sparkSession), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core already
        pieces = kept(("pieces", vocabulary), lambda: LibraryPieces(vocabulary))
        part = TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        segment = 0

        def close() -> pa.RecordBatch:
            sizes = [len(i) for i in ids]
            flat = np.concatenate(ids)
            cols = [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([pack_segment(doc_ids, sizes, flat)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "segment", "n_ids", "data"])

        held = 0
        for b in batches:
            for d, i in zip(b.column("id").to_pylist(), pieces.encode(b.column("text"), end_id)):
                doc_ids.append(d)
                ids.append(i)
                held += len(i)
                if held >= segment_ids:
                    yield close()
                    ids, doc_ids, held, segment = [], [], 0, segment + 1
        if doc_ids:
            yield close()

    ordered.mapInArrow(run, "part int, segment int, n_ids bigint, data binary").write.option("compression", "none").parquet(path)


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32, ids)`` of every document in the files; ``start``: ids of
    all documents before it; the CRC is over the ids as little-endian unsigned 32-bit
    integers.  Without ``with_ids`` the ids themselves stay out.  Only segment sizes are summed
    up: within a range, then over ranges."""

    schema = "part int, segment int, id bigint, within bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, segment, data in zip(*(b.column(c) for c in ("part", "segment", "data"))):
                doc_ids, sizes, ids = unpack_segment(data.as_py())
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4")
                for s in range(0, len(sizes), 2000):  # rows in parts of bounded size
                    e = min(s + 2000, len(sizes))
                    begin = ends[s:e] - sizes[s:e]
                    crc = [zlib.crc32(raw[x:y]) for x, y in zip(begin.tolist(), ends[s:e].tolist())]
                    cols = [
                        pa.array(np.full(e - s, part.as_py(), np.int32)), pa.array(np.full(e - s, segment.as_py(), np.int32)),
                        pa.array(doc_ids[s:e], pa.int64()), pa.array(begin), pa.array(sizes[s:e]), pa.array(crc, pa.int64()),
                    ]
                    if with_ids:
                        offsets = pa.array(np.r_[begin[0], ends[s:e]] - begin[0], pa.int32())
                        cols.append(pa.ListArray.from_arrays(offsets, pa.array(ids[begin[0] : ends[e - 1]].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    segments = files.select("part", "segment", "n_ids")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per file
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    base = segments.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    base = base.select("part", "segment", (F.col("before") + F.col("inside")).alias("base"))
    read = files.select("part", "segment", "data").mapInArrow(run, schema).join(base, ["part", "segment"])
    return read.select("id", (F.col("base") + F.col("within")).alias("start"), *names[4:])


def store_and_read(docs: DataFrame, vocabulary: str, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Writes the documents' token files to a new folder under the shared checkpoint folder and
    reads them back.  Defined cases: null text: the end id alone; null id: before all others;
    repeated rows: one entry each, next to each other; empty table: no row; other columns
    are ignored."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_token_files(docs, path, vocabulary, end_id)
    return read_token_files(spark.read.parquet(path), with_ids)
