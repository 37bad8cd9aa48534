"""BPE encoding by a pair occurrence index, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from convrec.llm.common import id_text, kept

# Text whose characters all lie below U+0250 (without information separators, superscript
# digits and fractions, which libraries class differently) is split by Python's own rules; other text goes through the
# tokenizer file's normalizer and pre-tokenizer.
_PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
# A text of these characters (white space and printable ones of the range above) is split as a whole.
FAST = re.compile("[\t-\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
RULE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in own)
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


Known = tuple[int, tuple[int, ...], str, str]
CODED, ALONE = "\x00", "\x01"  # no word begins with these
WIDTH = 1 << 20  # more than a vocabulary has tokens


class WordBpe:
    """Encoder for a tokenizer file with byte-level symbols and word ends.

    Texts of common characters are cut into words as a whole, others piece by piece between white
    space.  A worker keeps what it has learned of up to ``cache`` words (those met again outlive
    the others); all words of a batch that it doesn't know are encoded together."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.cache = path, cache
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.end = model["end_of_word_suffix"] or ""
        self.alphabet = byte_alphabet()
        self.rank: dict[int, tuple[int, int]] = {}  # left * WIDTH + right -> rank, token
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[self.vocab[a] * WIDTH + self.vocab[b]] = (r, self.vocab[a + b])
        # symbols of the byte alphabet inside a word and at its end
        self.inner, self.final = (np.full(max(map(ord, self.alphabet)) + 1, -1, np.int64) for _ in range(2))
        for c in self.alphabet:
            self.inner[ord(c)], self.final[ord(c)] = self.vocab.get(c, -1), self.vocab.get(c + self.end, -1)
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._library = None
        # word -> (number of ids, ids, ids in decimal, decoded): now, and of the generation before
        self.known: dict[str, Known] = {}
        self.older: dict[str, Known] = {}
        self.odd: dict[str, list[str]] = {}  # words of pieces that Python's rules don't split

    def library_words(self, piece: str) -> list[str]:
        """Words of a piece by the tokenizer file's own normalizer and pre-tokenizer."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        text = self._library.normalizer.normalize_str(piece)
        return [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def piece_words(self, piece: str) -> list[str]:
        """Words of a piece without special tokens, in the byte alphabet."""
        if not _PLAIN.fullmatch(piece):
            return self.library_words(piece)
        low = unicodedata.normalize("NFC", piece).lower()
        if not _PLAIN.fullmatch(low):
            return self.library_words(piece)
        if low.isascii():
            return [w for m in RULE.finditer(low) if (w := m.group())] if low.isprintable() else self.library_words(piece)
        return ["".join(self.alphabet[b] for b in m.group().encode("utf-8")) for m in RULE.finditer(low)] if low.isprintable() else self.library_words(piece)

    def encode_words(self, words: Sequence[str]) -> list[tuple[int, ...]]:
        """Ids of distinct words.  One linked list holds the symbols of all words; an index maps
        each mergeable pair to all its positions.  Active pairs are taken in ascending rank;
        all positions of a pair are merged from left to right and the lists of the pairs that
        appear beside them are extended (positions that a merge has used up are skipped).  A
        pair of rank r joins tokens that only earlier ranks make, so taking the whole batch in
        rank order merges every word as alone."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(size) - 1
        first = last - size + 1
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        start = self.inner[chars]
        start[last] = self.final[chars[last]]
        n = len(start)
        follows, precedes = np.arange(1, n + 1), np.arange(-1, n - 1)
        follows[last], precedes[first] = -1, -1
        where: dict[int, list[int]] = {}  # rank -> positions of its pair's left symbol
        made: dict[int, tuple[int, int, int]] = {}  # rank -> pair and the token it makes
        left = np.flatnonzero(follows >= 0)
        pairs = start[left] * WIDTH + start[left + 1]
        by_pair = np.argsort(pairs, kind="stable")
        distinct, begin = np.unique(pairs[by_pair], return_index=True)
        rank = self.rank
        for pair, at in zip(distinct.tolist(), np.split(left[by_pair], begin[1:])):
            if hit := rank.get(pair):
                where[hit[0]], made[hit[0]] = at.tolist(), (pair // WIDTH, pair % WIDTH, hit[1])
        symbol, after, before = start.tolist(), follows.tolist(), precedes.tolist()
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, t = made[r]
            positions = where.pop(r)
            positions.sort()
            from_t = t * WIDTH
            for i in positions:
                j = after[i]
                if symbol[i] != a or j < 0 or symbol[j] != b:
                    continue
                symbol[i], symbol[j] = t, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if hit := rank.get(from_t + symbol[k]):
                        s, made_t = hit
                        if (at := where.get(s)) is None:
                            where[s], made[s] = [i], (t, symbol[k], made_t)
                            heapq.heappush(active, s)
                        else:
                            at.append(i)
                h = before[i]
                if h >= 0 and (hit := rank.get(symbol[h] * WIDTH + t)):
                    s, made_t = hit
                    if (at := where.get(s)) is None:
                        where[s], made[s] = [h], (symbol[h], t, made_t)
                        heapq.heappush(active, s)
                    else:
                        at.append(h)
        whole = np.array(symbol)
        ends = np.cumsum(np.add.reduceat(whole >= 0, first)).tolist()
        ids = whole[whole >= 0].tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def words(self, text: str) -> list[str]:
        """The words of a whole text in order, as they are (lower-cased), in the byte alphabet behind
        ``CODED``, or, for special tokens (matched before lower-casing), behind ``ALONE``."""
        if self._cut is None or "<|" not in text:
            return self.part_words(text)
        out = []
        for part in self._cut.split(text):
            out += [ALONE + part] if part in self.special else self.part_words(part)
        return out

    def part_words(self, part: str) -> list[str]:
        if FAST.fullmatch(part) and FAST.fullmatch(low := part.lower()):
            return RULE.findall(low)
        out = []
        for piece in self.white_split(part):
            if FAST.fullmatch(piece) and FAST.fullmatch(low := piece.lower()):
                out += RULE.findall(low)
            else:
                if (coded := self.odd.get(piece)) is None:
                    coded = self.odd[piece] = [CODED + w for w in self.piece_words(piece)]
                out += coded
        return out

    @staticmethod
    def white_split(text: str) -> list[str]:
        # U+001C..U+001F end a piece for str.split but are no white space for the tokenizer
        return text.split() if not _SEPARATORS.search(text) else _WHITE.split(text)

    def learn(self, words: set[str]) -> dict[str, Known]:
        """What is known of the words (and of others); new ones are encoded as one batch."""
        if len(self.known) > self.cache // 2:
            self.known, self.older = {}, self.known
        if len(self.odd) > self.cache // 8:
            self.odd = {}
        known, older = self.known, self.older
        new = []
        for w in words - known.keys():
            if (was := older.get(w)) is not None:
                known[w] = was
            elif w[0] == ALONE:
                known[w] = (1, (self.special[w[1:]],), str(self.special[w[1:]]), w[1:])
            else:
                new.append(w)
        table = self.alphabet
        coded = [w[1:] if w[0] == CODED else w if w.isascii() else "".join([table[b] for b in w.encode()]) for w in new]
        for w, ids in zip(new, self.encode_words(coded)):
            known[w] = (len(ids), ids, " ".join(map(str, ids)), self.decode(ids))
        return known

    def decode(self, ids: Sequence[int]) -> str:
        """The tokens with one space between them: the file names no decoder."""
        return " ".join([self.tokens[i] for i in ids])


_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")


def encoder(path: str) -> WordBpe:
    """One encoder per worker process, with the words it has met."""
    return kept(("bpe", path), lambda: WordBpe(path))


def encode_in_words(bpe: WordBpe, texts: Sequence[str], part: int = 1 << 22) -> Iterator[list[Known]]:
    """Per whole text, what is known of its words; texts are taken together up to about ``part``
    characters."""
    begin = 0
    while begin < len(texts):
        end, length, split = begin, 0, []
        while end < len(texts) and (end == begin or length + len(texts[end]) <= part):
            length += len(texts[end])
            split.append(bpe.words(texts[end]))
            end += 1
        known = bpe.learn(set().union(*split))
        for s in split:
            yield [known[w] for w in s]
        begin = end


def encode_texts(bpe: WordBpe, texts: Sequence[str]) -> Iterator[list[int]]:
    """Ids of each whole text."""
    for found in encode_in_words(bpe, texts):
        yield [i for k in found for i in k[1]]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: every whole text (null: empty) as the tokenizer file encodes it without
    extra special tokens.  Repeated rows give repeated rows, an empty text an empty array, an
    empty table no row; other columns are ignored."""
    narrow = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            ids = pa.array(list(encode_texts(bpe, b.column("text").to_pylist())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], names=["id", "ids"])

    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_documents(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)``: the decoded text of every row of ids (null like empty)."""
    narrow = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            texts = pa.array([bpe.decode(i.as_py() or ()) for i in b.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), texts], names=["id", "text"])

    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encodes and decodes every whole text in one
    pass and keeps the digests (the ids in decimal and the decoded text, in UTF-8)."""
    narrow = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            sizes, first, second = [], [], []
            for found in encode_in_words(bpe, b.column("text").to_pylist()):
                sizes.append(sum([k[0] for k in found]))
                first.append(hashlib.sha256(" ".join([k[2] for k in found]).encode()).hexdigest())
                second.append(hashlib.sha256(" ".join([k[3] for k in found]).encode()).hexdigest())
            cols = [b.column("id"), pa.array(sizes, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    text = [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], T.StructField("n_tokens", T.LongType()), *text]))
