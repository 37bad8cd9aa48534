"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes.  The distinct blocks of all texts are
sorted and numbered: equal blocks, and only those, have one integer name.  Then the distinct
pairs of adjacent names are sorted and numbered, and so on, each round halving a text's names,
until one name is left.  A name stands for one sequence of bytes, so two texts are equal exactly
if they end in the same round with the same name; no hash decides anything.

A 64-bit key of the block only says where its text is compared: the distinct texts of a key are
collected (nearly always one), each gets its own name, and rows of a key with several texts find
theirs by the text itself."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convrec.llm.common import id_text
from convrec.session import Generations

Key = Callable[[bytes], int]


def block_key(block: bytes) -> int:
    return xxhash.xxh64_intdigest(block) - (1 << 63)


def blocks_of(data: bytes, size: int) -> list[bytes]:
    """``data`` in blocks of ``size`` bytes, the last one shorter; nothing is one empty block."""
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]


def distinct_blocks(texts: DataFrame, size: int, key: Key) -> DataFrame:
    """``(key, block)`` of every block; a task leaves out those it has just emitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {block for t in b.column("text") for block in blocks_of(t.as_py().encode().lower(), size)}
            keys = pa.array(map(key, found), pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.binary())], names=["key", "block"])

    return texts.select("text").mapInArrow(run, "key bigint, block binary")


def placed_blocks(texts: DataFrame, size: int, key: Key, with_text: bool) -> DataFrame:
    """``(row, pos, key, block, n, id, sha)``: the blocks of every text in order, ``n`` of them; id
    and SHA-256 of the text stand with the first one.  The block itself only ``with_text``."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pos, keys, block, n, first, sha = [], [], [], [], [], [], []
            for i, (r, t) in enumerate(zip(b.column("row").to_pylist(), b.column("text"))):
                data = t.as_py().encode().lower()
                parts = blocks_of(data, size)
                more = len(parts) - 1
                row += [r] * len(parts)
                pos += range(len(parts))
                keys += map(key, parts)
                block += parts if with_text else [None] * len(parts)
                n += [len(parts)] * len(parts)
                first += [i] + [None] * more
                sha += [hashlib.sha256(data).hexdigest()] + [None] * more
            ids = b.column("id").take(pa.array(first, pa.int32()))
            longs = [pa.array(x, pa.int64()) for x in (row, pos, keys)]
            arrays = [*longs, pa.array(block, pa.binary()), pa.array(n, pa.int64()), ids, pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "pos", "key", "block", "n", "id", "sha"])

    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(run, f"row bigint, pos bigint, key bigint, block binary, n bigint, id {id_type}, sha string")


def identities(texts: DataFrame, size: int, key: Key, tables: Generations) -> tuple[DataFrame, DataFrame]:
    """``(row, id, sha)`` of every row of ``texts`` and ``(row, round, name)``, the identity of its text."""
    by_key = distinct_blocks(texts, size, key).groupBy("key").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    several = F.size("blocks") > 1
    sorted_blocks = by_key.sortWithinPartitions("key").select(
        "key", F.explode(F.transform("blocks", lambda b: F.struct(F.when(several, b).alias("block")))).alias("b")
    )
    names = tables.put("blocks", sorted_blocks.select("key", "b.block", F.monotonically_increasing_id().alias("name")))
    shared = names.filter(F.col("block").isNotNull())
    with_text = not shared.isEmpty()
    placed = placed_blocks(texts, size, key, with_text)
    if with_text:
        # one row a key: few, whatever the number of texts; AQE decides how to join them
        keys = shared.select("key").distinct().withColumn("several", F.lit(True))
        placed = placed.join(keys, "key", "left").withColumn("block", F.when(F.col("several"), F.col("block"))).drop("several")
    wanted = names.withColumnsRenamed({"key": "k", "block": "b"})
    named = placed.join(wanted, (F.col("key") == F.col("k")) & F.col("block").eqNullSafe(F.col("b")), "left")
    name = F.coalesce("name", F.raise_error(F.lit("a block without a name: the texts changed between two readings")).cast("long"))
    named = tables.put("placed", named.select("row", "pos", "n", "id", "sha", name.alias("name")))
    rows = named.filter("pos = 0").select("row", "id", "sha")
    done = [named.filter("n = 1").select("row", F.lit(0).alias("round"), "name")]
    left = named.filter("n > 1").select("row", "pos", "n", "name")
    turn = 0
    while not left.isEmpty():
        turn += 1
        at = lambda r: F.max(F.when(F.col("pos") % 2 == r, F.col("name")))
        pair = F.floor(F.col("pos") / 2).cast("long").alias("pos")
        halves = F.ceil(F.first("n") / 2).cast("long").alias("n")
        pairs = left.groupBy("row", pair).agg(halves, at(0).alias("a"), F.coalesce(at(1), F.lit(-1)).alias("b"))
        pairs = tables.put("pairs", pairs)
        names = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
        names = tables.put("names", names.withColumn("name", F.monotonically_increasing_id()))
        named = tables.put("left", pairs.join(names, ["a", "b"]).select("row", "pos", "n", "name"))
        done.append(tables.put(f"done-{turn}", named.filter("n = 1").select("row", F.lit(turn).alias("round"), "name")))
        left = named.filter("n > 1")
        tables.sweep()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return rows, out


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, key: Key = block_key
) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)``, one row per input row: the group of texts
    that are equal after lower-casing A-Z, and the row of largest id that stays of it.

    The texts are shuffled once, as distinct blocks combined before the shuffle, so copies cost
    a task one row a block; all else are integers.  A round more halves a text's names: the
    number of rounds is the logarithm of the blocks of the longest text.  All state is written
    tables.

    Defined cases: a null text is an empty one, and all empty ones are equal; repeated rows (one
    id, one text) count one by one and one of them stays; a null id is smaller than any other,
    and ``keep_id`` is null where all are; empty table: empty result; other columns are ignored."""
    texts = id_text(docs, id_col, text_col)
    tables = Generations(docs.sparkSession, "block-naming")
    rows, identity = identities(texts, block_bytes, key, tables)
    known = tables.put("known", rows.join(identity, "row"))
    last = F.max(F.struct("id", "row"))
    groups = known.groupBy("round", "name").agg(last.alias("last"), F.count(F.lit(1)).alias("group_size"))
    out = known.join(groups, ["round", "name"])
    kept = F.col("row") == F.col("last.row")
    return out.select("id", F.col("last.id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
