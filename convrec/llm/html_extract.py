"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of element paths.  A path whose look
(sequence of child elements) and content (texts) hardly differ from page to page is part of
the site's frame; the entropy of both over the host's pages is its importance, and branches
of low importance are cut out of every page."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convrec.llm.common import cut
from convrec.llm.url_filter import host_and_path

# A quote opens a value only right after "="; elsewhere, and inside a value without quotes, it is a
# character like others.  A quote that nothing closes is one too.
_VALUE = r"(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+|(?=[\"'\s>]|$))"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+{_VALUE})*+)>?", re.S
)
_ATTR = re.compile(r"([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>][^\s>]*))")
_TOKEN = re.compile(r"[a-z]+")

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
SCOPES = frozenset("article aside body div footer header html main nav ol section table ul".split())

# Elements that by their meaning are frame, never main text, and the words of a class, id or
# role that say the same of any element.
FRAME_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe svg canvas button select option textarea dialog menu object embed noframes title".split()
)
FRAME_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
    complementary consent contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation
    newsletter notice notices paywall popup promo promoted promotion related replies reply respond search share sharing
    sidebar signup skip social sponsor sponsored subscribe toolbar widget""".split()
)
MAIN_TAGS = frozenset(["article", "main"])
# Words that make a name say how a page is laid out, not what the element is.
LAYOUT_WORDS = frozenset("has with without no not is layout".split())

# What a block's place says before any page of its host is compared: the factor its measured
# importance is multiplied by.  FRAME (by its element or by a name that says nothing else) is a
# rule; HINT (a compound name with a frame word in it) is a prior that high entropy outvotes.
FRAME, HINT, PLAIN, ARTICLE = "frame", "hint", "plain", "article"
PRIOR = {FRAME: 0.0, HINT: 0.35, PLAIN: 1.0, ARTICLE: 1.0}


def frame_element(tag: str, names: str, inside_article: bool) -> str | None:
    """FRAME for an element that is frame by its meaning (a header is, unless it opens an
    article) or by one of its names as a whole, HINT for one with a frame word inside a
    longer name, else None.  Names of a layout (has-sidebar) say nothing."""
    if tag in FRAME_TAGS or (tag == "header" and not inside_article):
        return FRAME
    if tag in ("html", "body", "article", "main"):
        return None
    tokens = [t for t in map(_TOKEN.findall, names.lower().split()) if not FRAME_WORDS.isdisjoint(t) and LAYOUT_WORDS.isdisjoint(t)]
    return None if not tokens else FRAME if any(FRAME_WORDS.issuperset(t) for t in tokens) else HINT


class Path:
    """A chain of block elements: a 64-bit key made from its parent's and the last element."""

    __slots__ = ("key", "parent", "least")

    def __init__(self, key: int, parent: Path | None = None):
        self.key, self.parent = key, parent
        self.least: float | None = None  # once asked for

    def child(self, step: str) -> Path:
        return Path(xxhash.xxh64_intdigest(step, self.key), self)


def path_key(path: str) -> int:
    """Key of a path written as ``/html/body.name/...``."""
    at = Path(0)
    for step in path.split("/")[1:]:
        at = at.child(step)
    return signed(at.key)


def signed(key: int) -> int:
    return key - (1 << 63)


def blocks(page: str) -> list[tuple[Path, str, str]]:
    """The blocks of ``blocks_and_looks``."""
    return blocks_and_looks(page)[0]


def blocks_and_looks(page: str) -> tuple[list[tuple[Path, str, str]], dict[int, list[str]]]:
    """``(path, text, place)`` of the blocks of a page, in page order; the place is FRAME inside an
    element that is frame by its meaning, HINT inside one whose name only hints at it, else
    ARTICLE inside an article, else PLAIN.  An article or main element is not under the names of
    the elements around it, only (an article) under those that say FRAME, and a hint on an
    element that holds most of the page's text outside FRAME says nothing.

    A path is the chain of block elements with their classes (digits left out).  Formatting
    elements belong to the text of their block, left open or not.  Character references are
    decoded after the markup is cut, so they never make markup.  Comments, scripts and styles
    never reach the text; a truncated page ends where it ends.

    The look of a path (by its key) is the sequence of the child elements (with their classes) of
    the elements it stands for, in page order, those of an element after a "|".

    An open element costs the same at any depth: paths are chains, not texts, and an end tag
    looks for its element only if one of its kind is open."""
    stack: list[tuple[str, Path, str | None, bool, int]] = [("", Path(0), None, False, 0)]  # tag, path, frame, in article, hinting element
    out: list[tuple[Path, str, str, bool, int]] = []
    looks: dict[int, list[str]] = {}
    opened: Counter[str] = Counter()
    text: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            _, path, frame, article, hinting = stack[-1]
            if words:
                out.append((path, words, frame or (ARTICLE if article else PLAIN), article, hinting))

    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        closing = m.group(1)
        if tag in INLINE:
            if tag in ("br", "img"):
                text.append(" ")
            continue
        flush()
        if closing:
            for depth in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[depth][0] == tag:
                    opened.subtract(x[0] for x in stack[depth:])
                    del stack[depth:]
                    break
                if tag not in SCOPES and stack[depth][0] in SCOPES:
                    break  # an end tag does not reach beyond the part of the page it stands in
            continue
        if tag in VOID:
            looks.setdefault(stack[-1][1].key, []).append(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        while len(stack) > 1 and tag in CLOSES.get(stack[-1][0], ()):
            opened[stack.pop()[0]] -= 1
        _, path, frame, article, hinting = stack[-1]
        names, classes = "", ""
        for a in _ATTR.finditer(m.group(3)):
            key, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
            if key in ("class", "id", "role"):
                names += " " + value
            if key == "class":
                classes = "." + ".".join(sorted(_TOKEN.findall(value.lower())))
        if tag in MAIN_TAGS and (frame == HINT or (tag == "main" and not any(x[0] in FRAME_TAGS or x[0] == "header" for x in stack))):
            frame = None
        if frame != FRAME:
            own = frame_element(tag, names, article)
            hinting = at if own == HINT and frame is None else hinting
            frame = own or frame
        article = article or tag in MAIN_TAGS
        looks.setdefault(path.key, []).append(tag + classes)
        if not m.group(3).endswith("/"):
            path = path.child(tag + classes)
            looks.setdefault(path.key, []).append("|")
            stack.append((tag, path, frame, article, hinting))
            opened[tag] += 1
    flush()
    length: dict[int, int] = {}
    for _, words, place, _, hinting in out:
        if place != FRAME:
            under = hinting if place == HINT else 0
            length[under] = length.get(under, 0) + len(words)
    most = {x for x, n in length.items() if x and 2 * n > sum(length.values())}
    return [
        (path, words, (ARTICLE if article else PLAIN) if place == HINT and hinting in most else place)
        for path, words, place, article, hinting in out
    ], looks


def text_key(text: str) -> int:
    return signed(xxhash.xxh64_intdigest(text))


def branch_key(path: Path, place: str) -> int:
    """Blocks that their element's name hints at are measured apart from others of their path."""
    return signed(path.child(" hint").key if place == HINT else path.key)


def style_tree(pages: DataFrame) -> DataFrame:
    """``(host, path, hint, pages, look, content)``: per element path of a host (all of them, main text
    and frame) the number of different pages that have it and the entropies (0 to 1) of its look and of its content over them.

    ``pages``: ``(host, html)``.  Pages whose blocks are all the same count once.  Counts are
    partial sums per host, path and value, so a host with a third of all pages is
    never gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths, hints, looks, contents, whole = [], [], [], [], [], []
            for h, page in zip(b.column("host").to_pylist(), b.column("html")):
                parts, children = blocks_and_looks(page.as_py() or "")
                here: dict[int, tuple[Path, str, list[str]]] = {}
                for path, words, place in parts:
                    here.setdefault(branch_key(path, place), (path, place, []))[2].append(words)
                everything = text_key("\n".join(w for _, w, _ in parts))
                for key, (path, place, texts) in here.items():
                    hosts.append(h)
                    paths.append(key)
                    hints.append(place == HINT)
                    looks.append(text_key(" ".join(children.get(path.key, ()))))
                    contents.append(text_key("\n".join(texts)))
                    whole.append(everything)
            cols = [pa.array(hosts, pa.string()), pa.array(hints, pa.bool_()), *(pa.array(c, pa.int64()) for c in (paths, looks, contents, whole))]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "hint", "path", "look", "content", "whole"])

    seen = cut(pages.mapInArrow(run, "host string, hint boolean, path bigint, look bigint, content bigint, whole bigint").distinct())
    total = seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))

    def entropy(col: str) -> DataFrame:
        each = seen.groupBy("host", "path", col).agg(F.count(F.lit(1)).alias("n"), F.first("hint").alias("hint")).join(total, ["host", "path"])
        share = F.col("n") / F.col("pages")
        bits = each.groupBy("host", "path").agg(F.first("pages").alias("pages"), F.first("hint").alias("hint"), F.sum(-share * F.log(share)).alias("bits"))
        scaled = F.when(F.col("pages") > 1, F.col("bits") / F.log(F.greatest("pages", F.lit(2)))).otherwise(1.0)  # one page tells nothing
        return bits.select("host", "path", "hint", "pages", scaled.alias(f"{col}_entropy"))

    look = entropy("look").drop("pages", "hint")
    return entropy("content").join(look, ["host", "path"]).select(
        "host", "path", "hint", "pages", F.col("look_entropy").alias("look"), F.col("content_entropy").alias("content")
    )


def extract_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_pages: int = 4,
    sure_pages: int = 8,
    least_importance: float = 0.3,
    weight: float = 0.9,
) -> DataFrame:
    """``(id, url, text)``, one row per input row: the main text of every page, its blocks in page
    order, one newline between them.

    Measured importance of a path = ``weight`` times the entropy of its content plus the rest
    times the entropy of its look, over the different pages of the host (1 while fewer than
    ``least_pages`` have it).  It is multiplied by the prior of the path's place.  Settled by
    rule, whatever the texts: elements that are frame by their meaning (menus, headers, footers,
    sidebars, notices, adverts, forms, comments; many of them differ from page to page) go.
    Where ``sure_pages`` different pages of a host have a path, the measure also decides over
    the text of articles, and over names that only hint at a frame; with fewer, articles stay
    and hinted branches go.  Branches below ``least_importance`` are cut from every page.

    Only the paths to cut (a site's template) and the hinted ones to keep are joined to the pages, by host, so pages are
    not shuffled while that table is small, and otherwise once (AQE splits a hot host).

    Defined cases: null or empty html: empty text; null url: host empty (a site of its own);
    repeated rows: one output row each; empty table: empty result; other columns ignored."""
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    importance = weight * F.col("content") + (1 - weight) * F.col("look")
    tree = style_tree(rows.select("host", "html")).withColumn("importance", importance)
    cuts = ~F.col("hint") & (F.col("pages") >= least_pages) & (F.col("importance") < least_importance)
    keeps = F.col("hint") & (F.col("pages") >= sure_pages) & (F.col("importance") * PRIOR[HINT] >= least_importance)
    sure = (F.col("pages") >= sure_pages).alias("sure")
    low = cut(tree.filter(cuts | keeps).groupBy("host").agg(F.collect_list(F.struct("path", "importance", sure)).alias("low")))
    rows = rows.join(low, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, low in zip(b.column("html"), b.column("low")):
                measured = {x["path"]: (x["importance"], x["sure"]) for x in low.as_py() or ()}
                kept = [w for path, w, place in blocks(page.as_py()) if branch_importance(path, place, measured) >= least_importance]
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return rows.select("id", "url", "html", "low").mapInArrow(
        run, T.StructType([rows.schema["id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    )


def branch_importance(path: Path, place: str, measured: dict[int, tuple[float, bool]]) -> float:
    """The smallest importance of the path and those above it (1 where nothing was measured)
    times the prior of its place.  In an article and under a hint the path's own counts, if
    enough pages have it (else 1 and 0)."""
    if place in (ARTICLE, HINT):
        importance, sure = measured.get(branch_key(path, place), (0.0, False))
        return PRIOR[place] * importance if sure else float(place == ARTICLE)
    if place == FRAME or not measured:
        return PRIOR[place]
    above, at = [], path
    while at is not None and at.least is None:
        above.append(at)
        at = at.parent
    for p in reversed(above):  # each path of a page is looked up once
        own = measured.get(signed(p.key), (1.0, False))[0] if p.parent is not None else 1.0
        p.least = own if p.parent is None else min(own, p.parent.least)
    return PRIOR[place] * path.least
