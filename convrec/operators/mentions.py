"""Entity mention detection.

Semantics per (message, entity): the entity (lowercased) needs at least one
whitespace word in common with the lowercased message; then score 1.0 when
``\\b entity \\b`` occurs (case-insensitive), else, for entities with at least
two n-grams, the Jaccard similarity of the n-gram sets when it reaches the
threshold.  Blank messages have no mentions.

Plan (no pair enumeration over shared common words):

* exact path - when ``\\b entity \\b`` occurs in a text, every maximal run of
  word characters of the entity is also a whole run of the text.  So each
  entity is joined to the texts only through its *rarest* run (document
  frequencies from one partial aggregate), which is an equi join; candidates
  are then verified with the regex and the shared-word rule.  The runs of the
  entity are also neighbours in the text, so an entity all of whose runs are
  frequent ("a of b") is joined through its rarest pair of neighbouring runs
  instead.  Entities without any word character (rare) fall back to the
  shared-word join.
* fuzzy path - Jaccard >= t implies ``t|E| <= |T| <= |E|/t`` and, with all
  n-grams in one global order (rarest first), that the first
  ``|X| - ceil(t|X|) + 1`` n-grams of the two sets intersect (prefix
  filter).  Texts whose n-gram set is too large for any entity drop out
  before the join; the remaining prefixes are equi-joined on the n-gram and
  the size of the text's set, for which an entity stands once per size it can
  meet (length filter: a frequent n-gram is split by size before the join),
  and only where as many n-grams follow as the overlap still needs
  (positional filter, which the first n-gram in common always passes).

Both joins are equi joins on a token; AQE splits skewed tokens (skew join)
and broadcasts the entity side when its runtime size allows.  Results are
exact: no candidate cap, no sampling.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from convrec.config import ENTITY_STOP_WORDS
from convrec.functions.ngrams import adjacent_runs, char_ngrams, char_ngrams_of_normalized, normalize_for_ngrams, whole_word_pattern, word_runs
from convrec.functions.text import compute_then_filter, usplit, ustrip
from convrec.session import shuffle_partitions, staged

EPS = 1e-9


def entity_set(names: DataFrame, name_col: str = "name", stop_words=ENTITY_STOP_WORDS) -> DataFrame:
    """Distinct names minus the stop set (compared before lowercasing), then lowercased
    and de-duplicated: one row per entity."""
    return (
        names.select(F.col(name_col).alias("entity"))
        .filter(F.col("entity").isNotNull() & ~F.col("entity").isin(*stop_words))
        .select(F.lower("entity").alias("entity"))
        .distinct()
    )


def _prepare_entities(entities: DataFrame, n: int) -> DataFrame:
    return entities.select(
        "entity",
        F.array_distinct(usplit("entity")).alias("e_words"),
        char_ngrams("entity", n).alias("e_grams"),
        word_runs("entity").alias("e_runs"),
    )


def exact_candidates(t: DataFrame, ents: DataFrame, key_cols: list[str], frequent: int = 1000) -> DataFrame:
    """``(key, entity)`` rows among which every exact mention of an entity with word characters
    is.  ``t`` has ``tl`` (lower-cased text) and ``t_runs``, ``ents`` has ``e_runs``; both are read
    more than once."""

    def rarest(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
        """``(entity, token, df)`` of the token in the fewest texts; an entity with a token that no
        text has cannot match exactly."""
        df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        known = wanted.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        least = known.groupBy("entity").agg(F.min(F.struct("df", "token")).alias("a"))
        return least.filter("a.df > 0").select("entity", "a.token", "a.df")

    runs = t.select(*key_cols, F.explode("t_runs").alias("token"))
    anchors = staged(rarest(runs, ents.select("entity", F.explode("e_runs").alias("token"))), "mention-anchors")
    hot = (F.col("df") > frequent) & (F.size(adjacent_runs("entity")) > 0)
    found = runs.join(anchors.filter(~hot).select("entity", "token"), "token").select(*key_cols, "entity")
    paired = anchors.filter(hot)
    if paired.isEmpty():
        return found
    pairs_of = staged(paired.select("entity", F.explode(adjacent_runs("entity")).alias("token")), "mention-pairs")
    pairs = t.select(*key_cols, F.explode(adjacent_runs("tl")).alias("token")).join(pairs_of.select("token").distinct(), "token", "left_semi")
    pairs = staged(pairs, "mention-text-pairs")
    by_pair = pairs.join(rarest(pairs, pairs_of).select("entity", "token"), "token").select(*key_cols, "entity")
    return found.unionByName(by_pair)


def detect_mentions(
    texts: DataFrame,
    entities: DataFrame,
    *,
    key_cols: list[str],
    text_col: str = "text",
    n: int = 3,
    threshold: float = 0.7,
    frequent: int = 1000,
) -> DataFrame:
    """T9 + T11 (via J10 candidates): one row per (key, entity, score) with a mention.  Runs of word
    characters in more than ``frequent`` texts are not used alone to find an entity of several.

    The keys keep their names throughout, so the columns made here must have others."""
    made = {"tl", "token", "t_at", "e_at", "t_words", "t_runs", "t_grams", "t_n", "entity", "e_words", "e_grams", "e_runs", "e_n", "run", "df", "w", "g", "g_both", "g_any", "score"}
    if clash := made.intersection(key_cols):
        raise ValueError(f"key columns {sorted(clash)} need other names")
    t = texts.select(*key_cols, F.col(text_col).alias("__text")).repartition(shuffle_partitions(texts.sparkSession), *key_cols).filter(
        F.col("__text").isNotNull() & (ustrip("__text") != "")
    )
    t = (
        t.select(*key_cols, F.lower("__text").alias("tl"))
        .withColumn("t_words", F.array_distinct(usplit("tl")))
        .withColumn("t_runs", word_runs("tl"))
    )
    # four plan branches read the texts with their word lists: compute those once and cut
    # the lineage with a written table instead of re-running the regexes per branch
    t = staged(t, "mention-texts")
    # The entity side (one row per entity) is read by a dozen plan branches below; it is
    # written once in the shared checkpoint folder as well.
    ents = staged(_prepare_entities(entities, n).filter(F.size("e_words") > 0), "mention-entities")

    # ---- exact path (T9) -------------------------------------------------------------
    cand = exact_candidates(t, ents, key_cols, frequent)
    # entities without word characters: shared whitespace word join (J10 as written)
    odd = ents.filter(F.size("e_runs") == 0).select("entity", F.explode("e_words").alias("w"))
    odd_c = t.select(*key_cols, F.explode("t_words").alias("w")).join(odd, "w").select(*key_cols, "entity")
    # only keys and entities are shuffled to the texts, which stay where they are (one text's
    # candidates are rows, never a collected set)
    x = t.join(cand.unionByName(odd_c).distinct(), key_cols).select(*key_cols, "tl", "t_words", "t_runs", "entity")
    x = compute_then_filter(
        x,
        {"e_words": F.array_distinct(usplit("entity")), "e_runs": word_runs("entity")},
        F.arrays_overlap("t_words", "e_words") & (F.size(F.array_except("e_runs", "t_runs")) == 0),
    )
    # rows of one entity next to each other: the regex is compiled once per entity and task
    x = x.sortWithinPartitions("entity")
    exact = compute_then_filter(x, {"__hit": F.regexp_like(F.col("tl"), whole_word_pattern(F.col("entity")))}, F.col("__hit")).select(
        *key_cols, "entity", F.lit(1.0).alias("score")
    )

    # ---- fuzzy path (T11) --------------------------------------------------------------
    fe = ents.filter(F.size("e_grams") >= 2).withColumn("e_n", F.size("e_grams"))
    max_e = fe.agg(F.max("e_n")).first()[0]
    if max_e is None:
        return exact
    limit = int(math.floor(max_e / threshold + EPS))
    # Jaccard >= t needs |T| <= |E|/t <= limit.  Exclusion test without building every
    # n-gram of a long text: the n-grams of the first ``limit + n`` normalized characters
    # are a subset of the text's, so more than ``limit`` of them rules the text out.
    t_n = compute_then_filter(t, {"__norm": normalize_for_ngrams(F.col("tl"))}, F.lit(True))
    t_n = compute_then_filter(
        t_n, {"__head": F.size(char_ngrams_of_normalized(F.col("__norm").substr(F.lit(1), F.lit(limit + n)), n))}, F.col("__head") <= limit
    )
    # the short texts are read three times below: written once
    tf = compute_then_filter(
        t_n, {"t_grams": char_ngrams_of_normalized(F.col("__norm"), n)}, (F.size("t_grams") >= 1) & (F.size("t_grams") <= limit)
    )
    tf = staged(tf.withColumn("t_n", F.size("t_grams")).drop("__norm", "__head"), "mention-short-texts")
    # global n-gram order: rarest first (ties by the n-gram)
    g_all = tf.select(F.explode("t_grams").alias("g")).unionByName(fe.select(F.explode("e_grams").alias("g")))
    g_freq = g_all.groupBy("g").agg(F.count(F.lit(1)).alias("f"))

    def prefixes(df, grams, size, ids, place):
        ex = df.select(*ids, size, F.explode(grams).alias("g")).join(g_freq, "g")
        w2 = Window.partitionBy(*ids).orderBy("f", "g")
        plen = F.col(size) - F.ceil(F.col(size) * F.lit(threshold) - F.lit(EPS)) + 1
        return ex.withColumn(place, F.row_number().over(w2)).filter(F.col(place) <= plen).select(*ids, size, "g", place)

    cand_f = fuzzy_candidates(
        prefixes(tf, "t_grams", "t_n", key_cols, "t_at"), prefixes(fe, "e_grams", "e_n", ["entity"], "e_at"), key_cols, threshold
    )
    scored = (
        cand_f.join(tf.select(*key_cols, "t_words", "t_grams", "t_n", "tl"), key_cols)
        .join(fe.select("entity", "e_words", "e_grams", "e_n"), "entity")
        .filter(
            (F.col("t_n") >= F.col("e_n") * F.lit(threshold) - F.lit(EPS))
            & (F.col("t_n") * F.lit(threshold) <= F.col("e_n") + F.lit(EPS))
            & F.arrays_overlap("t_words", "e_words")
        )
        .withColumn("g_both", F.size(F.array_intersect("t_grams", "e_grams")))
        .withColumn("g_any", F.size(F.array_union("t_grams", "e_grams")))
        .filter(F.col("g_both") >= F.col("e_n") * F.lit(threshold))
        .withColumn("score", F.col("g_both") / F.col("g_any"))
        .filter((F.col("score") >= threshold) & ~F.regexp_like(F.col("tl"), whole_word_pattern(F.col("entity"))))
        .select(*key_cols, "entity", "score")
    )
    return exact.unionByName(scored)


def fuzzy_candidates(tp: DataFrame, ep: DataFrame, key_cols: list[str], threshold: float) -> DataFrame:
    """``(key, entity)`` rows among which every pair of Jaccard similarity ``threshold`` is, from the
    prefixes ``(key, t_n, g, t_at)`` of the texts and ``(entity, e_n, g, e_at)`` of the entities:
    n-gram, size of its set and its place (from 1) in the global order."""
    least, most = F.ceil(F.col("e_n") * F.lit(threshold) - F.lit(EPS)), F.floor(F.col("e_n") / F.lit(threshold) + F.lit(EPS))
    sized = ep.withColumn("t_n", F.explode(F.sequence(least.cast("int"), most.cast("int"))))
    overlap = (F.col("t_n") + F.col("e_n")) * F.lit(threshold / (1 + threshold)) - F.lit(EPS)
    reach = F.least(F.col("t_n") - F.col("t_at"), F.col("e_n") - F.col("e_at")) + 1
    return tp.join(sized, ["g", "t_n"]).filter(reach >= overlap).select(*key_cols, "entity").distinct()


def mentions_per_text(mentions: DataFrame, key_cols: list[str]) -> DataFrame:
    """Per text, ``array<struct<entity, score>>`` sorted by score desc, then entity asc."""
    return mentions.groupBy(*key_cols).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("ns"), "entity"))),
            lambda x: F.struct(x["entity"].alias("entity"), (-x["ns"]).alias("score")),
        ).alias("mentions")
    )


def dialogue_mentions(
    dialogues: DataFrame,
    entities: DataFrame,
    *,
    key_col: str = "conv_id",
    conv_col: str = "conversation",
    n: int = 3,
    threshold: float = 0.7,
) -> DataFrame:
    """Mentions for every message of every dialogue, nested back into the dialogue as
    ``array<struct<role, content, mentions>>`` (message order kept).  The dialogues are read twice
    (their messages, and the rows that the mentions are joined to): they are written once first."""
    dialogues = staged(dialogues, "mention-dialogues")
    msgs = dialogues.select(key_col, F.posexplode(conv_col).alias("__i", "m")).select(
        key_col, "__i", F.col("m.content").alias("text")
    )
    found = mentions_per_text(detect_mentions(msgs, entities, key_cols=[key_col, "__i"], n=n, threshold=threshold), [key_col, "__i"])
    per_conv = found.groupBy(key_col).agg(F.collect_list(F.struct("__i", "mentions")).alias("__ms"))
    empty = F.array().cast("array<struct<entity:string,score:double>>")
    d = dialogues.join(per_conv, key_col, "left")
    conv = F.transform(
        F.col(conv_col),
        lambda m, i: F.struct(
            m["role"].alias("role"),
            m["content"].alias("content"),
            F.coalesce(F.try_element_at(F.filter(F.col("__ms"), lambda x: x["__i"] == i), F.lit(1))["mentions"], empty).alias("mentions"),
        ),
    )
    return d.withColumn(conv_col, conv).drop("__ms")
