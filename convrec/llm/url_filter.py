"""URL filter: listed rules first, then a ratio of two character language models.

Native DataFrame code only: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convrec.llm.common import ascii_lower, cut

START, END = "\u0002", "\u0003"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
    Path: from there up to ``?``, ``#`` or the end.  A null url or one without ``://`` gives
    two empty strings."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits, else null.  ``rules`` holds
    ``(verdict, "host/path")`` pairs; a rule fits its host and every subdomain when the url's
    path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest ends up outermost
        at = rule.index("/")
        h, p = rule[:at], rule[at:]
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(strings: DataFrame, order: int) -> DataFrame:
    """One row per character of ``s`` (and its end): the character with ``order`` before it."""
    padded = F.concat(F.lit(START * order), F.col("s"), F.lit(END))
    return strings.withColumn("__p", padded).select(
        *strings.columns,
        F.explode(F.transform(F.sequence(F.lit(1), F.length("s") + 1), lambda i: F.substring(F.col("__p"), i, F.lit(order + 1)))).alias("g"),
    )


def log_ratios(all_grams: DataFrame, order: int) -> DataFrame:
    """``(g, llr)``: log P_accepted(c | context) - log P_rejected(c | context) of every gram.

    Both classes have an interpolated variable-order Markov model (Witten-Bell): at each
    order the weight of the lower order is the number of distinct characters seen after
    the context over its count plus that number, so a context never seen hands over to
    the next shorter one.  Order -1 is uniform over the characters of all strings.

    Everything is derived from one small table, the counts of the distinct grams."""
    base = all_grams.groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    base = cut(base)
    vocab = max(1, base.select(F.substring("g", order + 1, 1)).distinct().count())
    out = base.select("g", F.lit(1.0 / vocab).alias("pa"), F.lit(1.0 / vocab).alias("pr"))
    for k in range(order + 1):
        # gram of this order: the last k + 1 characters of g; its context: the first k of those
        gram = base.groupBy(F.substring("g", order + 1 - k, k + 1).alias("gk")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
        ctx = gram.groupBy(F.substring("gk", 1, k).alias("hk")).agg(
            F.sum("na").alias("ha"),
            F.sum("nr").alias("hr"),
            F.sum((F.col("na") > 0).cast("long")).alias("ta"),
            F.sum((F.col("nr") > 0).cast("long")).alias("tr"),
        )
        both = gram.withColumn("hk", F.substring("gk", 1, k)).join(ctx, "hk")
        out = out.withColumn("gk", F.substring("g", order + 1 - k, k + 1)).join(both, "gk")

        def step(n, h, t, p):
            return F.when(F.col(h) + F.col(t) > 0, (F.col(n) + F.col(t) * F.col(p)) / (F.col(h) + F.col(t))).otherwise(F.col(p))

        out = out.select("g", step("na", "ha", "ta", "pa").alias("pa"), step("nr", "hr", "tr", "pr").alias("pr"))
    return out.select("g", (F.log("pa") - F.log("pr")).alias("llr"))


def equal_z(m_allow: float | None, s_allow: float | None, m_block: float | None, s_block: float | None) -> float | None:
    """The score equally many standard deviations from both class means (None: a class is empty)."""
    if m_allow is None or m_block is None:
        return None
    if s_allow + s_block == 0:
        return (m_allow + m_block) / 2
    return (m_allow * s_block + m_block * s_allow) / (s_allow + s_block)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    order: int = 3,
    default: str = "allow",
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """``(id, host, path, rule, verdict, score)``, one row per input row.

    The urls a rule allows or blocks (each distinct host and path once) are the accepted
    and rejected training strings of two smoothed variable-order character models.  A
    url's ``score`` is the mean over its characters of the log-likelihood difference.
    The cut between the classes is calibrated on the training strings: the point equally
    many standard deviations from both class means.  Without rows of both classes the
    verdict of a url no rule fits is ``default``.

    Defined cases: null url or one without ``://``: empty host and path, judged by the
    method like any other string; repeated rows: one output row each; empty table: empty
    result; other columns of the input are ignored.

    The only table joined to the characters is the one of distinct grams (bounded by the
    alphabet to the power ``order + 1``).  Its rows are counted first: up to
    ``broadcast_rows`` it is broadcast, beyond it the same join shuffles (AQE splits hot
    grams).  A string's characters stay in one task up to the partial sum, so a hot host
    costs nothing extra."""
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("__r", fitting_rule(F.col("host"), F.col("path"), rules))
    judged = judged.select("id", "host", "path", F.col("__r.rule").alias("rule"), F.col("__r.verdict").alias("listed"))

    strings = judged.select("host", "path", "listed").distinct()
    strings = cut(strings.withColumn("s", F.concat("host", "path")))
    is_a = (F.col("listed") == "allow").cast("long")
    is_r = (F.col("listed") == "block").cast("long")
    all_grams = grams(strings.select("s", "listed"), order).select(
        "g", F.coalesce(is_a, F.lit(0)).alias("a"), F.coalesce(is_r, F.lit(0)).alias("r")
    )
    llr = cut(log_ratios(all_grams, order))
    small = llr.count() <= broadcast_rows
    scored = (
        grams(strings, order)
        .join(F.broadcast(llr) if small else llr, "g")
        .groupBy("host", "path", "listed")
        .agg(F.avg("llr").alias("score"))
    )
    scored = cut(scored)
    stats = scored.agg(
        *[
            f(F.when(F.col("listed") == v, F.col("score"))).alias(n + v)
            for v in ("allow", "block")
            for n, f in (("m_", F.avg), ("s_", F.stddev_pop))
        ]
    )
    cutoff = equal_z(**stats.first().asDict())
    if cutoff is None:
        by_method = F.lit(default)
    else:
        by_method = F.when(F.col("score") >= F.lit(cutoff), "allow").otherwise("block")
    verdicts = scored.filter(F.col("listed").isNull()).select("host", "path", by_method.alias("verdict"), "score")
    return judged.join(verdicts, ["host", "path"], "left").select(
        "id", "host", "path", "rule", F.coalesce("listed", "verdict").alias("verdict"), "score"
    )
