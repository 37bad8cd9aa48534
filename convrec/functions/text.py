"""String and array helpers used across the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convrec.config import SPECIAL_TOKEN

# Python-style Unicode whitespace strip / split.  ``trim`` only removes spaces.
_SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Fixed values (formats of the data): shortest bracketed span of one line, item tags.  Only
# the newline ends a line ((?d)), not CR or the Unicode line separators.
TITLE_BRACKETS_RE = r"(?d)[\(\[].*?[\)\]]"
TAG_RE = r"(?d)<id_(.*?)>"
TAG_RE_STRICT = r"<id_([^<>]+)>"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace.  (``\\s+$`` as a pattern would be tried at every
    character of the text.)"""
    return F.btrim(col_(c).cast("string"), F.lit(_SPACES))


def usplit(c) -> Column:
    """``str.split()``: split on runs of Unicode whitespace, no empty pieces (after the strip
    only an empty text can give an empty piece, so no per-element filter is needed)."""
    return split_stripped(ustrip(c))


def split_stripped(s: Column) -> Column:
    """``usplit`` of a text that is stripped already."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"(?U)\s+"))


def clean_title(c) -> Column:
    """Delete every shortest bracketed span; outer spaces stay."""
    return F.regexp_replace(F.coalesce(col_(c).cast("string"), F.lit("None")), TITLE_BRACKETS_RE, "")


def item_tag(c) -> Column:
    """``<id_{key}>``."""
    return F.concat(F.lit("<id_"), col_(c).cast("string"), F.lit(">"))


def extract_tags(c, strict: bool = False) -> Column:
    """Keys of all ``<id_X>`` tags, in text order, repeats kept."""
    return F.regexp_extract_all(col_(c), F.lit(TAG_RE_STRICT if strict else TAG_RE), 1)


def unwrap_tags(c, special_token: str = SPECIAL_TOKEN) -> Column:
    """Drop the special token, ``<id_X>`` -> ``X``, then strip."""
    return ustrip(F.regexp_replace(F.replace(col_(c), F.lit(special_token), F.lit("")), TAG_RE, "$1"))


def replace_all(text, pairs) -> Column:
    """Apply literal replacements ``array<struct<old,new>>`` one after the other."""
    return F.aggregate(col_(pairs), col_(text), lambda acc, p: F.replace(acc, p["old"], p["new"]))


def comma_join(c) -> Column:
    """N15."""
    return F.array_join(col_(c), ", ")


def stable_id(c) -> Column:
    """A stable non-negative 60-bit integer id from text (first 15 hex digits of md5)."""
    return F.conv(F.substring(F.md5(col_(c).cast("string")), 1, 15), 16, 10).cast("bigint")


def seeded_bucket(key, n: int, seed: int = 42) -> Column:
    """``int(md5(f"{seed}:{key}")[:8], 16) % n`` - uniform, seeded, stable."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), col_(key).cast("string"))), 1, 8), 16, 10)
    return F.pmod(h.cast("bigint"), F.lit(n))


def seeded_order_key(key, seed: int = 42) -> Column:
    """Deterministic shuffle order key (a string that sorts uniformly at random)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col_(key).cast("string")))


def file_label(special_token: str) -> str:
    """The special token without its frame characters, as a part of file names."""
    return special_token.translate(dict.fromkeys(map(ord, "<|>")))


def is_liked(rating) -> Column:
    """rating > 3 (a null rating counts as not liked)."""
    return F.coalesce(col_(rating) > 3, F.lit(False))


def has_items(c) -> Column:
    """F16: list present and non-empty."""
    return F.coalesce(F.size(col_(c)) > 0, F.lit(False))


def has_text(c) -> Column:
    """F16: string longer than 2 characters."""
    return F.coalesce(F.length(col_(c)) > 2, F.lit(False))


def let(value, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (lambda bodies get no common-subexpression
    elimination, so a value used several times inside a higher-order function is bound here)."""
    return F.transform(F.array(value), fn).getItem(0)



def compute_then_filter(df, cols: dict, predicate: Column):
    """Add the computed ``cols``, then keep rows where ``predicate`` (over those columns) holds.

    Catalyst pushes a filter below the projection that defines its columns (and through
    repartitions and sorts), substituting the expressions: an expensive expression would
    then run twice, and before any repartition meant to spread it.  The projection here
    also carries a non-deterministic column that the filter reads, which keeps the filter
    above it, so every expression runs once per row, where it is written."""
    out = df.select("*", *[c.alias(n) for n, c in cols.items()], F.spark_partition_id().alias("__pid"))
    return out.filter(predicate & (F.col("__pid") >= 0)).drop("__pid")
