"""Dialogue queries: marker / chat parsing, rendering, id<->title replacement, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from convrec.functions.dialogue import last_marker_line, parse_chat, parse_markers, parse_prompt_chat
from convrec.operators import dialogue as dl
from convrec.operators.split import random_split, stratified_split
from convrec.plans import fixtures as fx
from convrec.plans import oracle as sql
from convrec.plans.registry import register


def _explode_conv(df, conv_col="conversation", key="conv_id"):
    return df.select(key, F.posexplode(conv_col).alias("idx", "m")).select(
        key, F.col("idx").cast("bigint").alias("idx"), F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


@register(
    "t4_marker_parse",
    sql.with_(sql.MARKER, sql.marker_parse_sql("marker")) + "SELECT conv_id, CAST(idx AS BIGINT) AS idx, role, content FROM mp_out",
)
def t4_marker_parse(spark, sf_dir):
    m = fx.marker_texts(spark, sf_dir)
    return _explode_conv(m.select("conv_id", parse_markers("response").alias("conversation")))


@register(
    "t4_f9_parsed_dialogue_counts",
    sql.with_(sql.MARKER, sql.marker_parse_sql("marker"))
    + "SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns FROM mp_out GROUP BY conv_id",
)
def t4_f9_counts(spark, sf_dir):
    m = fx.marker_texts(spark, sf_dir).select("conv_id", parse_markers("response").alias("conversation"))
    return dl.non_empty(m).select("conv_id", F.size("conversation").cast("bigint").alias("n_turns"))


@register(
    "t5_w5_last_marker_line",
    sql.with_(sql.MARKER)
    + """, lines AS (
  SELECT conv_id, unnest(string_split(regexp_replace(response, '^\\s+|\\s+$', '', 'g'), chr(10))) AS line,
         unnest(range(1, len(string_split(regexp_replace(response, '^\\s+|\\s+$', '', 'g'), chr(10))) + 1)) AS i
  FROM marker),
kept AS (
  SELECT conv_id, i, CASE WHEN starts_with(line, '[USR]:') THEN 'user' ELSE 'AI' END AS role,
         regexp_replace(replace(line, CASE WHEN starts_with(line, '[USR]:') THEN '[USR]:' ELSE '[AI]:' END, ''), '^\\s+|\\s+$', '', 'g') AS content,
         row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS rd
  FROM lines WHERE starts_with(line, '[USR]:') OR starts_with(line, '[AI]:'))
SELECT conv_id, role, content FROM kept WHERE rd = 1""",
)
def t5_last_line(spark, sf_dir):
    m = fx.marker_texts(spark, sf_dir).select("conv_id", last_marker_line("response").alias("t"))
    return m.filter(F.col("t").isNotNull()).select("conv_id", F.col("t.role").alias("role"), F.col("t.content").alias("content"))


_T8_SQL = sql.with_(sql.CAT, sql.TAGGED) + """, t8 AS (
  SELECT conv_id, turn, role, text, regexp_extract_all(text, '<id_(.*?)>', 1) AS tags,
         regexp_split_to_array(text, '<id_.*?>') AS pieces FROM tagged),
occ AS (SELECT conv_id, turn, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS i FROM t8),
dict AS (SELECT CAST(item_id AS VARCHAR) AS k, min(regexp_replace(title, '[\\(\\[].*?[\\)\\]]', '', 'g')) AS title FROM cat GROUP BY 1),
rep AS (
  SELECT o.conv_id, o.turn, o.i, o.tag, d.title FROM occ o LEFT JOIN dict d ON o.tag = d.k),
agg AS (
  SELECT r.conv_id, r.turn,
         string_agg(t8.pieces[r.i] || CASE WHEN r.title IS NULL THEN '<id_' || r.tag || '>'
                                          WHEN t8.role = 'AI' THEN '<|reserved_special_token_10|> ' || r.title
                                          ELSE r.title END, '' ORDER BY r.i) AS body,
         CAST(count(*) FILTER (WHERE r.title IS NULL) AS BIGINT) AS nf,
         count(*) FILTER (WHERE r.title IS NOT NULL) AS nk
  FROM rep r JOIN t8 ON r.conv_id = t8.conv_id AND r.turn = t8.turn GROUP BY r.conv_id, r.turn),
t8_out AS (
  SELECT t8.conv_id, t8.turn, t8.role,
         CASE WHEN coalesce(agg.nk, 0) = 0 THEN t8.text
              ELSE regexp_replace(agg.body || t8.pieces[len(t8.tags) + 1], '^\\s+|\\s+$', '', 'g') END AS content,
         coalesce(agg.nf, 0) AS nf
  FROM t8 LEFT JOIN agg ON t8.conv_id = agg.conv_id AND t8.turn = agg.turn)
"""


def _t8(spark, sf_dir):
    d = fx.tagged_dialogues(spark, sf_dir)
    cat = fx.cat(spark, sf_dir)
    dic = dl.title_dictionary(cat, "item_id", "title")
    return dl.replace_ids_with_titles(d, dic)


@register(
    "t8_j9_id_to_title",
    _T8_SQL
    + "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS idx, role, content FROM t8_out",
)
def t8_id_to_title(spark, sf_dir):
    return _explode_conv(_t8(spark, sf_dir))


@register(
    "a13_a14_a16_dialogue_items",
    _T8_SQL
    + """, known AS (SELECT DISTINCT r.conv_id, '<id_' || r.tag || '>' AS tag, t8.role FROM rep r JOIN t8 ON r.conv_id = t8.conv_id AND r.turn = t8.turn
              WHERE r.title IS NOT NULL)
SELECT c.conv_id, CAST(c.nf AS BIGINT) AS not_found,
       coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM known k WHERE k.conv_id = c.conv_id), '') AS named_items,
       coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM known k WHERE k.conv_id = c.conv_id AND k.role = 'AI'), '') AS recommended,
       coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM known k WHERE k.conv_id = c.conv_id AND tag NOT IN
                  (SELECT tag FROM known k2 WHERE k2.conv_id = c.conv_id AND k2.role = 'AI')), '') AS exclusive_items,
       '<id_' || CAST((c.conv_id * 5) % (SELECT count(*) * 12 // 10 FROM part) AS VARCHAR) || '>' AS target
FROM (SELECT conv_id, sum(nf) AS nf FROM t8_out GROUP BY conv_id) c""",
)
def a13_a14_items(spark, sf_dir):
    r = _t8(spark, sf_dir)
    return r.select(
        "conv_id",
        F.col("not_found").cast("bigint").alias("not_found"),
        F.array_join("named_items", ",").alias("named_items"),
        F.array_join("recommended", ",").alias("recommended"),
        F.array_join("exclusive_items", ",").alias("exclusive_items"),
        F.array_join("target", ",").alias("target"),
    )


@register(
    "w7_first_mentions",
    sql.with_(sql.TAGGED)
    + """, occ AS (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '<id_(.*?)>', 1)) AS item,
                  unnest(range(0, len(regexp_extract_all(text, '<id_(.*?)>', 1)))) AS pos FROM tagged),
idxd AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t FROM occ),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, item ORDER BY turn, pos) AS rn FROM idxd)
SELECT conv_id, item, CAST(t AS INTEGER) AS turn, CAST(pos AS INTEGER) AS pos, role = 'AI' AS by_assistant FROM r WHERE rn = 1""",
)
def w7_first_mentions(spark, sf_dir):
    return dl.first_mentions(fx.tagged_dialogues(spark, sf_dir))


@register(
    "t3_t15_render_dialogues",
    sql.with_(sql.TAGGED)
    + """SELECT conv_id, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || '{sp}' || '<|eot_id|>'
       || string_agg('<|start_header_id|>' || CASE WHEN role = 'AI' THEN 'assistant' ELSE role END || '<|end_header_id|>' || chr(10) || chr(10)
       || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '<|eot_id|>', '' ORDER BY turn) AS text
FROM tagged GROUP BY conv_id""".replace("{sp}", __import__("convrec.config", fromlist=["x"]).DIALOGUE_SYSTEM_PROMPT.replace("'", "''")),
)
def t3_t15_render(spark, sf_dir):
    d = dl.format_dialogues(fx.tagged_dialogues(spark, sf_dir))
    return dl.render_dialogues(d).select("conv_id", "text")


@register(
    "t7_chat_parse",
    sql.with_(sql.CHAT)
    + """, p AS (SELECT conv_id,
   regexp_extract_all(text, '(?s)<\\|start_header_id\\|>(.*?)<\\|end_header_id\\|>\\s*\\n\\n(.*?)<\\|eot_id\\|>', 1) AS roles,
   regexp_extract_all(text, '(?s)<\\|start_header_id\\|>(.*?)<\\|end_header_id\\|>\\s*\\n\\n(.*?)<\\|eot_id\\|>', 2) AS contents FROM chat)
SELECT conv_id, CAST(unnest(range(0, len(roles))) AS BIGINT) AS idx, regexp_replace(unnest(roles), '^\\s+|\\s+$', '', 'g') AS role,
       regexp_replace(unnest(contents), '^\\s+|\\s+$', '', 'g') AS content FROM p""",
)
def t7_chat_parse(spark, sf_dir):
    c = fx.chat_texts(spark, sf_dir)
    return _explode_conv(c.select("conv_id", parse_chat("text").alias("conversation")))


@register(
    "t6_prompt_chat_parse",
    sql.with_(sql.CHAT, sql.MARKER)
    + """, g AS (SELECT c.conv_id, c.text || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt, m.response
           FROM chat c JOIN marker m ON c.conv_id = m.conv_id),
b AS (SELECT conv_id, response, unnest(string_split(prompt, '<|eot_id|>')) AS blk, unnest(range(1, len(string_split(prompt, '<|eot_id|>')) + 1)) AS i FROM g),
c AS (SELECT conv_id, response, i, replace(regexp_replace(blk, '^\\s+|\\s+$', '', 'g'), '<|begin_of_text|>', '') AS blk FROM b),
d AS (SELECT conv_id, response, i,
        regexp_replace(regexp_extract(blk, '(?s)^<\\|start_header_id\\|>(.*?)<\\|end_header_id\\|>(.*)$', 1), '^\\s+|\\s+$', '', 'g') AS role,
        regexp_replace(regexp_extract(blk, '(?s)^<\\|start_header_id\\|>(.*?)<\\|end_header_id\\|>(.*)$', 2), '^\\s+|\\s+$', '', 'g') AS content
      FROM c WHERE regexp_matches(blk, '(?s)^<\\|start_header_id\\|>(.*?)<\\|end_header_id\\|>(.*)$'))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS BIGINT) AS idx, role,
       CASE WHEN role = 'assistant' THEN response
            WHEN role = 'system' THEN regexp_replace(replace(content, 'Cutting Knowledge Date: December 2023' || chr(10) || 'Today Date: 26 Jul 2024', ''), '^\\s+|\\s+$', '', 'g')
            ELSE content END AS content
FROM d""",
)
def t6_prompt_parse(spark, sf_dir):
    c = fx.chat_texts(spark, sf_dir)
    m = fx.marker_texts(spark, sf_dir)
    g = c.join(m, "conv_id").select(
        "conv_id", F.concat("text", F.lit("<|start_header_id|>assistant<|end_header_id|>\n\n")).alias("prompt"), "response"
    )
    return _explode_conv(g.select("conv_id", parse_prompt_chat("prompt", "response").alias("conversation")))


_SCEN = sql.scen_idx("conv_id")


@register(
    "p2_stratified_split",
    f"""WITH s AS (SELECT DISTINCT conv_id FROM conversations),
r AS (SELECT conv_id, {_SCEN} AS scenario, count(*) OVER (PARTITION BY {_SCEN}) AS n,
        row_number() OVER (PARTITION BY {_SCEN} ORDER BY md5('42:' || CAST(conv_id AS VARCHAR)), conv_id) AS rn FROM s),
q AS (SELECT *, greatest(1, floor(n * 0.1)) AS nt, greatest(1, floor(n * 0.1)) AS nv FROM r)
SELECT conv_id, scenario, CASE WHEN rn <= greatest(n - nt - nv, 0) THEN 'train' WHEN rn <= n - nt THEN 'valid' ELSE 'test' END AS split FROM q""",
)
def p2_split(spark, sf_dir):
    from convrec.functions.text import seeded_bucket

    d = fx.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    d = d.withColumn("scenario", seeded_bucket("conv_id", 5).cast("int"))
    return stratified_split(d, "scenario", "conv_id", valid=0.1, test=0.1).select("conv_id", "scenario", "split")


@register(
    "p1_random_split",
    """WITH s AS (SELECT DISTINCT conv_id FROM conversations),
r AS (SELECT conv_id, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || CAST(conv_id AS VARCHAR)), conv_id) AS rn FROM s)
SELECT conv_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM r""",
)
def p1_split(spark, sf_dir):
    d = fx.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return random_split(d, "conv_id", 0.8, 0.1, 0.1).select("conv_id", "split")


def stage_c(spark, sf_dir, stratify: bool = True):
    """Stage C end to end: T4 -> F9 -> T8 -> F10 -> T15 -> T3 -> F8 -> P2 (or P1)."""
    g = fx.tagged_marker_texts(spark, sf_dir)
    d = dl.non_empty(g.withColumn("conversation", parse_markers("response")))
    dic = dl.title_dictionary(fx.cat(spark, sf_dir), "item_id", "title")
    r = dl.with_target(dl.replace_ids_with_titles(d, dic))
    r = dl.render_dialogues(dl.format_dialogues(r))
    r = dl.with_token(r)
    from convrec.operators.split import split_dataset

    return split_dataset(r, stratify=stratify, key="conv_id", stratum="scenario")


_STAGE_C_SQL = sql.with_(sql.CAT, sql.TAGGED, sql.TAGGED_MARKER, sql.marker_parse_sql("tmarker")) + """, t8 AS (
  SELECT conv_id, idx AS turn, role, content AS text, regexp_extract_all(content, '<id_(.*?)>', 1) AS tags,
         regexp_split_to_array(content, '<id_.*?>') AS pieces FROM mp_out),
""" + _T8_SQL[_T8_SQL.index("occ AS (") :]


@register(
    "f8_p2_stage_c_split",
    _STAGE_C_SQL
    + f""", known AS (SELECT DISTINCT r.conv_id, '<id_' || r.tag || '>' AS tag FROM rep r WHERE r.title IS NOT NULL),
texts AS (
  SELECT conv_id, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || '{{sp}}' || '<|eot_id|>'
         || string_agg('<|start_header_id|>' || CASE WHEN role = 'AI' THEN 'assistant' ELSE role END || '<|end_header_id|>' || chr(10) || chr(10)
                       || regexp_replace(content, '^\\s+|\\s+$', '', 'g') || '<|eot_id|>', '' ORDER BY turn) AS text
  FROM t8_out GROUP BY conv_id),
kept AS (SELECT * FROM texts WHERE contains(text, '<|reserved_special_token_10|>')),
r AS (SELECT conv_id, text, {sql.SCEN_NAMES}[{_SCEN} + 1] AS scenario, count(*) OVER (PARTITION BY {_SCEN}) AS n,
        row_number() OVER (PARTITION BY {_SCEN} ORDER BY md5('42:' || CAST(conv_id AS VARCHAR)), conv_id) AS rn FROM kept),
q AS (SELECT *, greatest(1, floor(n * 0.1)) AS nt, greatest(1, floor(n * 0.1)) AS nv FROM r)
SELECT conv_id, scenario, CASE WHEN rn <= greatest(n - nt - nv, 0) THEN 'train' WHEN rn <= n - nt THEN 'valid' ELSE 'test' END AS split,
       '<id_' || CAST((conv_id * 5) % (SELECT count(*) * 12 // 10 FROM part) AS VARCHAR) || '>' AS target, text,
       coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM known k WHERE k.conv_id = q.conv_id), '') AS named_items
FROM q""".replace("{sp}", __import__("convrec.config", fromlist=["x"]).DIALOGUE_SYSTEM_PROMPT.replace("'", "''")),
)
def f8_p2_stage_c(spark, sf_dir):
    return stage_c(spark, sf_dir).select(
        "conv_id", "scenario", "split", F.array_join("target", ",").alias("target"), "text", F.array_join("named_items", ",").alias("named_items")
    )


@register(
    "f12_f13_f14_limits",
    sql.with_(sql.CHAT, sql.MARKER, sql.marker_parse_sql("marker"))
    + """, g AS (SELECT c.conv_id, length(c.text) + length(m.response) AS len FROM chat c JOIN marker m ON c.conv_id = m.conv_id),
n AS (SELECT conv_id, count(*) AS n_turns FROM mp_out GROUP BY conv_id)
SELECT g.conv_id, CAST(len AS INTEGER) AS len, CAST(coalesce(n_turns, 0) AS INTEGER) AS n_turns
FROM g LEFT JOIN n USING (conv_id) WHERE len < 4000 AND coalesce(n_turns, 0) < 7""",
)
def f12_f13_limits(spark, sf_dir):
    g = fx.chat_texts(spark, sf_dir).withColumnRenamed("text", "prompt").join(fx.marker_texts(spark, sf_dir), "conv_id")
    d = dl.max_length(dl.text_lengths(g), 4000).withColumn("conversation", parse_markers("response"))
    d = dl.max_turns(d, 7).select("conv_id", "len", F.size("conversation").alias("n_turns"))
    return d


@register(
    "a15_missing_token_audit",
    sql.with_(sql.CAT, sql.TAGGED)
    + """, kept AS (
  SELECT DISTINCT conv_id FROM (SELECT conv_id, unnest(regexp_extract_all(text, '<id_(.*?)>', 1)) AS tag FROM tagged WHERE role = 'AI') x
  WHERE tag IN (SELECT CAST(item_id AS VARCHAR) FROM cat))
SELECT CAST((SELECT count(DISTINCT conv_id) FROM tagged WHERE role <> 'system' AND conv_id % 25 <> 3) AS BIGINT) AS n_rows,
       CAST((SELECT count(DISTINCT conv_id) FROM tagged WHERE role <> 'system' AND conv_id % 25 <> 3)
            - (SELECT count(*) FROM kept WHERE conv_id % 25 <> 3) AS BIGINT) AS n_missing""",
)
def a15_audit(spark, sf_dir):
    g = fx.tagged_marker_texts(spark, sf_dir)
    d = dl.non_empty(g.withColumn("conversation", parse_markers("response")))
    dic = dl.title_dictionary(fx.cat(spark, sf_dir), "item_id", "title")
    r = dl.render_dialogues(dl.format_dialogues(dl.replace_ids_with_titles(d, dic)))
    return dl.missing_token_audit(r)


def _t14(spark, sf_dir):
    r = _t8(spark, sf_dir)
    f = dl.format_dialogues(r).drop("conversation").withColumnRenamed("messages", "conversation")
    dic = dl.title_dictionary(fx.cat(spark, sf_dir), "item_id", "title")
    return dl.names_to_ids(f, dic)


_SP = __import__("convrec.config", fromlist=["x"]).DIALOGUE_SYSTEM_PROMPT.replace("'", "''")
_T14_SQL = (
    _T8_SQL
    + f""", known AS (SELECT DISTINCT r.conv_id, r.tag FROM rep r WHERE r.title IS NOT NULL),
tgt AS (SELECT DISTINCT conv_id, CAST((conv_id * 5) % (SELECT count(*) * 12 // 10 FROM part) AS VARCHAR) AS tag FROM tagged),
msgs AS (SELECT conv_id, 0 AS idx, 'system' AS role, '{_SP}' AS content FROM (SELECT DISTINCT conv_id FROM tagged)
         UNION ALL SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER),
                CASE WHEN role = 'AI' THEN 'assistant' ELSE role END, content FROM t8_out),
cand AS (SELECT conv_id, 'user' AS kind, tag FROM known UNION SELECT conv_id, 'other', tag FROM tgt),
cand_t AS (SELECT c.conv_id, c.kind, '<id_' || c.tag || '>' AS tagf, d.title FROM cand c JOIN dict d ON c.tag = d.k WHERE d.title <> ''),
best AS (SELECT conv_id, kind, title, max(tagf) AS tagf FROM cand_t GROUP BY ALL),
plist AS (SELECT conv_id, kind, list(title || chr(1) || tagf ORDER BY tagf) AS pairs FROM best GROUP BY ALL)
"""
)


@register(
    "t14_names_to_ids",
    _T14_SQL
    + """SELECT m.conv_id, CAST(m.idx AS BIGINT) AS idx, m.role,
       CASE WHEN p.pairs IS NULL THEN m.content
            ELSE list_reduce(p.pairs, lambda acc, x: replace(acc, split_part(x, chr(1), 1), split_part(x, chr(1), 2)), m.content) END AS content
FROM msgs m LEFT JOIN plist p ON m.conv_id = p.conv_id AND p.kind = CASE WHEN m.role = 'user' THEN 'user' ELSE 'other' END""",
)
def t14_names_to_ids(spark, sf_dir):
    return _explode_conv(_t14(spark, sf_dir))


_TOOLKIT_SQL = """, t14 AS (
  SELECT m.conv_id, m.idx, m.role,
       CASE WHEN p.pairs IS NULL THEN m.content
            ELSE list_reduce(p.pairs, lambda acc, x: replace(acc, split_part(x, chr(1), 1), split_part(x, chr(1), 2)), m.content) END AS content
  FROM msgs m LEFT JOIN plist p ON m.conv_id = p.conv_id AND p.kind = CASE WHEN m.role = 'user' THEN 'user' ELSE 'other' END
  WHERE m.role <> 'system'),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS utt FROM t14),
mv AS (SELECT u.conv_id, u.utt, u.role, x.tag, x.pos FROM u,
         (SELECT unnest(regexp_extract_all(u.content, '<id_([^<>]+)>', 1)) AS tag, unnest(range(1, len(regexp_extract_all(u.content, '<id_([^<>]+)>', 1)) + 1)) AS pos) x),
mvt AS (SELECT mv.*, regexp_replace(coalesce(d.title, '<id_' || mv.tag || '>'), '^\\s+|\\s+$', '', 'g') AS title FROM mv LEFT JOIN dict d ON mv.tag = d.k),
mvk AS (SELECT a.* FROM mvt a WHERE a.role <> 'assistant'
          OR NOT EXISTS (SELECT 1 FROM mvt b WHERE b.conv_id = a.conv_id AND b.utt < a.utt AND b.title = a.title)),
movies AS (SELECT conv_id, utt, string_agg(title, '|' ORDER BY pos) AS movies FROM mvk GROUP BY ALL),
words AS (SELECT conv_id, utt,
            regexp_replace(regexp_replace(replace(content, '<|reserved_special_token_10|>', ''), '<id_(.*?)>', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') AS w FROM u)
"""
_TOOLKIT_ROW = """SELECT CAST(u.conv_id AS VARCHAR) AS conv_id, CAST(u.utt AS INTEGER) AS utt_id,
       CASE WHEN u.role = 'user' THEN 'Seeker' WHEN u.role = 'assistant' THEN 'Recommender' END AS role,
       coalesce(movies.movies, '') AS movies,
       CASE WHEN words.w = '' THEN '' ELSE array_to_string(string_split_regex(words.w, '\\s+'), '|') END AS word
FROM u LEFT JOIN movies ON u.conv_id = movies.conv_id AND u.utt = movies.utt JOIN words ON u.conv_id = words.conv_id AND u.utt = words.utt"""


@register("t16_w8_w9_toolkit_rows", _T14_SQL + _TOOLKIT_SQL + _TOOLKIT_ROW)
def t16_toolkit(spark, sf_dir):
    dic = dl.title_dictionary(fx.cat(spark, sf_dir), "item_id", "title")
    t = dl.toolkit_rows(_t14(spark, sf_dir), dic, mentions_col=None)
    return t.select("conv_id", F.explode("conv").alias("u")).select(
        "conv_id",
        F.col("u.utt_id").alias("utt_id"),
        F.col("u.role").alias("role"),
        F.array_join("u.movies", "|").alias("movies"),
        F.array_join("u.word", "|").alias("word"),
    )


def stage_d(spark, sf_dir):
    """Stage D in one plan over stage C's rendered dialogues: T7 (parse the chat text) -> T14 (names to
    ids) -> T12 (mentions of every turn, joined back on dialogue and turn) -> F11 (system turns
    go) -> T16 (toolkit rows; items already named earlier in the dialogue, W8)."""
    from convrec.operators.mentions import dialogue_mentions, entity_set

    dic = dl.title_dictionary(fx.cat(spark, sf_dir), "item_id", "title")
    texts = dl.render_dialogues(dl.format_dialogues(_t8(spark, sf_dir))).select("conv_id", "text", "named_items", "target")
    parsed = texts.withColumn("conversation", parse_chat("text")).drop("text")
    found = dialogue_mentions(dl.names_to_ids(parsed, dic), entity_set(fx.mention_names(spark, sf_dir)))
    return dl.toolkit_rows(found, dic)


_STAGE_D_SQL = (
    _T14_SQL.replace("END, content FROM t8_out", "END, regexp_replace(content, '^\\s+|\\s+$', '', 'g') FROM t8_out")
    + _TOOLKIT_SQL.rstrip()
    + ",\n" + sql.MENTION_NAMES
    + ",\nturns AS (SELECT conv_id, utt AS idx, content AS text FROM u)"
    + sql.unicode_mentions_sql(src="turns")
    + ",\nent AS (SELECT conv_id, idx, string_agg(entity, '|' ORDER BY score DESC, entity) AS entity FROM m GROUP BY ALL)\n"
    + _TOOLKIT_ROW.replace("AS word\nFROM u", "AS word, coalesce(ent.entity, '') AS entity\nFROM u")
    + " LEFT JOIN ent ON u.conv_id = ent.conv_id AND u.utt = ent.idx"
)


@register("t7_t14_t12_f11_t16_stage_d", _STAGE_D_SQL)
def t16_stage_d(spark, sf_dir):
    return stage_d(spark, sf_dir).select("conv_id", F.explode("conv").alias("u")).select(
        "conv_id",
        F.col("u.utt_id").alias("utt_id"),
        F.col("u.role").alias("role"),
        F.array_join("u.movies", "|").alias("movies"),
        F.array_join("u.word", "|").alias("word"),
        F.array_join("u.entity", "|").alias("entity"),
    )
