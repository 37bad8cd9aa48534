"""DuckDB SQL twins of the registered queries (the correctness oracle).

The stand-in views are written once here as SQL (the same definitions as
``fixtures.py``) and prefixed to every oracle query as CTEs.
"""

from __future__ import annotations

INTER = """inter AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(1 + (CAST(l_quantity AS INTEGER) % 5) AS INTEGER) AS rating, l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

CAT = """cat AS (
  SELECT p_partkey AS item_id, p_name || ' (' || p_brand || ') [' || p_type || ']' AS title FROM part)"""

TITLED = """meta AS (
  SELECT CAST(p_partkey AS VARCHAR) AS parent_asin,
         CASE WHEN p_size % 10 = 1 THEN 'ab' WHEN p_size % 10 <> 0 THEN p_name || ' (' || p_brand || ') [' || p_type || ']' END AS title
  FROM part),
movies AS (SELECT CAST(p_partkey AS VARCHAR) AS asin FROM part WHERE p_size % 10 <> 2)"""

TAGGED = """tagged AS (
  SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'AI' ELSE role END AS role,
         text || ' <id_' || CAST((conv_id * 37 + turn * 11) % (SELECT count(*) * 12 // 10 FROM part) AS VARCHAR) || '> <id_'
              || CAST((conv_id * 5) % (SELECT count(*) * 12 // 10 FROM part) AS VARCHAR) || '>' AS text
  FROM conversations)"""


def kcore_cte(k: int, rounds: int, src: str = "inter") -> str:
    """Unrolled k-core: ``rounds`` filter steps (must be >= the rounds the data needs)."""
    parts = [f"r0 AS (SELECT * FROM {src})"]
    for i in range(1, rounds + 1):
        p = f"r{i-1}"
        parts.append(
            f"r{i} AS (SELECT * FROM {p} WHERE user_id IN (SELECT user_id FROM {p} GROUP BY user_id HAVING count(*) >= {k})"
            f" AND item_id IN (SELECT item_id FROM {p} GROUP BY item_id HAVING count(*) >= {k}))"
        )
    parts.append(f"core AS (SELECT * FROM r{rounds})")
    return ",\n".join(parts)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

REVIEWS = """reviews AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(1 + (CAST(l_quantity AS INTEGER) % 5) AS INTEGER) AS rating,
         'order ' || CAST(o_orderkey AS VARCHAR) AS title,
         CASE WHEN l_returnflag = 'R' THEN 'ok' ELSE o_orderpriority || ' ' || l_returnflag || l_linestatus END AS text,
         l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# Catalogue expected from the relational source of the movie-metadata stand-in.
CATQ = """ps AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
psx AS (SELECT ps.l_partkey, s_suppkey, s_name, s_acctbal, s_nationkey FROM ps JOIN supplier ON ps.l_suppkey = s_suppkey),
act AS (SELECT l_partkey, string_agg(s_name, ', ' ORDER BY s_acctbal DESC, s_suppkey) AS acting FROM (
          SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY s_acctbal DESC, s_suppkey) AS rn
          FROM psx WHERE s_suppkey % 4 <> 0) WHERE rn <= 10 GROUP BY l_partkey),
pnat AS (SELECT DISTINCT psx.l_partkey, n_nationkey, n_name FROM psx JOIN nation ON s_nationkey = n_nationkey),
crewq AS (SELECT l_partkey,
          coalesce(string_agg(n_name, ', ' ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 3 = 0), '') AS directing,
          coalesce(string_agg(n_name, ', ' ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 3 = 1), '') AS sound,
          coalesce(string_agg(n_name, ', ' ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 3 = 2), '') AS production
          FROM pnat GROUP BY l_partkey),
catq AS (SELECT CAST(p_partkey AS VARCHAR) AS item, p_name || ' (' || p_brand || ') [' || p_type || ']' AS title,
          p_type AS genres, replace(p_name, ' ', ', ') AS keywords, coalesce(acting, '') AS acting,
          coalesce(directing, '') AS directing, coalesce(sound, '') AS sound, coalesce(production, '') AS production,
          CASE WHEN p_size > 25 THEN p_type || ' collection' ELSE '' END AS collection,
          'A ' || lower(p_type) || ' ' || p_name || ' of size ' || CAST(p_size AS VARCHAR) AS overview,
          p_brand AS country,
          p_name || ' on a ' || lower(p_type) || ' shelf' AS caption
   FROM part LEFT JOIN act ON act.l_partkey = p_partkey LEFT JOIN crewq ON crewq.l_partkey = p_partkey)"""

SCEN_NAMES = "['Cold-Start Browser', 'Cold-Start Task-Oriented', 'History-Only Explorer', 'History + Hint Seeker', 'Fully Expressive Seeker']"


def scen_idx(key: str) -> str:
    return f"CAST((('0x' || substr(md5('42:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT) % 5 AS INTEGER)"


def item_text_sql(p: str, flag) -> str:
    """SQL of one item block; ``p`` is the column prefix, ``flag(feature)`` the SQL condition."""
    def line(feat, label, expr, cond):
        return f"CASE WHEN {flag(feat)} AND {cond} THEN '{label}: ' || {expr} || chr(10) ELSE '' END"

    return " || ".join(
        [
            f"'Item: ' || coalesce({p}title, '') || ', ID: <id_' || {p}item || '>' || chr(10)",
            line("Genres", "Genres", f"{p}genres", f"{p}genres <> ''"),
            line("Keywords", "Keywords", f"{p}keywords", f"{p}keywords <> ''"),
            line("Actors", "Actors", f"{p}acting", f"{p}acting <> ''"),
            line("Directors", "Directors", f"{p}directing", f"{p}directing <> ''"),
            line("Collection", "Collection", f"{p}collection", f"length({p}collection) > 2"),
            line("Overview", "Overview", f"{p}overview", f"length({p}overview) > 2"),
            line("Visual Caption", "Visual Caption", f"{p}caption", f"length({p}caption) > 2"),
            f"CASE WHEN {flag('Review')} AND length({p}rtext) > 2 THEN 'User Review Title: ' || {p}rtitle || chr(10)"
            f" || 'User Review: ' || {p}rtext || chr(10) ELSE '' END",
        ]
    )


HIST_FLAGS = {
    "Genres": (2, 3, 4), "Keywords": (2, 3, 4), "Actors": (4,), "Directors": (4,), "Overview": (4,),
    "Review": (4,), "Collection": (4,), "Visual Caption": (4,),
}
TARGET_FLAGS = {
    "Genres": (0, 1, 3, 4), "Keywords": (0, 1, 3, 4), "Actors": (1, 4), "Directors": (1, 4), "Overview": (1, 4),
    "Collection": (1, 4), "Visual Caption": (1, 4), "Review": (4,),
}


def flag_fn(table):
    return lambda feat: f"sidx IN ({', '.join(str(i) for i in table[feat])})"


def prompt_sql(k: int, n: int, rounds: int) -> str:
    """Oracle of the stage-A minimum slice (prompt per core user)."""
    ht = item_text_sql("", flag_fn(HIST_FLAGS))
    tt = item_text_sql("t_", flag_fn(TARGET_FLAGS))
    return (
        with_(INTER, REVIEWS, kcore_cte(k, rounds), CATQ)
        + f""", rev AS (
  SELECT * FROM reviews WHERE user_id IN (SELECT user_id FROM core) AND item_id IN (SELECT item_id FROM core)),
ranked AS (
  SELECT user_id, CAST(item_id AS VARCHAR) AS item, rating, title AS rtitle, text AS rtext, {scen_idx('user_id')} AS sidx,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, rating DESC, CAST(item_id AS VARCHAR) DESC, title DESC, text DESC) AS rd
  FROM rev),
j AS (SELECT r.*, c.title, c.genres, c.keywords, c.acting, c.directing, c.collection, c.overview, c.caption
      FROM ranked r LEFT JOIN catq c ON r.item = c.item),
h AS (SELECT *, ({ht}) || chr(10) AS block FROM j WHERE rd BETWEEN 2 AND {n}),
hu AS (SELECT user_id,
         coalesce(string_agg(block, '' ORDER BY rd DESC) FILTER (WHERE rating > 3), '') AS liked,
         coalesce(string_agg(block, '' ORDER BY rd DESC) FILTER (WHERE NOT (rating > 3)), '') AS disliked,
         count(*) AS nh
       FROM h GROUP BY user_id),
t AS (SELECT user_id, sidx, item AS t_item, title AS t_title, genres AS t_genres, keywords AS t_keywords, acting AS t_acting,
         directing AS t_directing, collection AS t_collection, overview AS t_overview, caption AS t_caption,
         rtitle AS t_rtitle, rtext AS t_rtext
      FROM j WHERE rd = 1)
SELECT t.user_id, {SCEN_NAMES}[t.sidx + 1] AS scenario, t.t_item AS target_item,
  regexp_replace(
    CASE WHEN t.sidx IN (2, 3, 4) AND coalesce(hu.nh, 0) > 0 THEN
      'The user has interacted with the following items:' || chr(10)
      || CASE WHEN length(hu.liked) > 2 THEN 'User liked the following items:' || chr(10) || hu.liked || chr(10) ELSE '' END
      || CASE WHEN length(hu.disliked) > 2 THEN 'User disliked the following items:' || chr(10) || hu.disliked || chr(10) ELSE '' END
    ELSE '' END
    || chr(10) || 'Consider the following one the target item to recommend:' || chr(10) || ({tt}),
    '^\\s+|\\s+$', '', 'g') AS prompt
FROM t LEFT JOIN hu ON t.user_id = hu.user_id"""
    )

def history_sql(k: int, n: int, rounds: int) -> str:
    """Per core user the sampled history items (W3, W4): ``user_id, item, place``; a user
    without any has one row whose item is null."""
    return (
        with_(INTER, REVIEWS, kcore_cte(k, rounds))
        + f""", ranked AS (
  SELECT user_id, CAST(item_id AS VARCHAR) AS item,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, rating DESC, CAST(item_id AS VARCHAR) DESC, title DESC, text DESC) AS rd
  FROM reviews WHERE user_id IN (SELECT user_id FROM core) AND item_id IN (SELECT item_id FROM core))
SELECT user_id, CASE WHEN rd > 1 THEN item END AS item, -rd AS place FROM ranked WHERE rd <= {n}"""
    )


MARKER = """marker AS (
  SELECT conv_id, string_agg(CASE WHEN conv_id % 25 = 3 THEN '' WHEN role = 'user' THEN '[USR]: ' WHEN role = 'assistant' THEN '[AI]: ' ELSE '' END
                             || text, chr(10) ORDER BY turn) AS response
  FROM conversations GROUP BY conv_id)"""

TAGGED_MARKER = """tmarker AS (
  SELECT conv_id, string_agg(CASE WHEN conv_id % 25 = 3 THEN '' WHEN role = 'user' THEN '[USR]: ' WHEN role = 'AI' THEN '[AI]: ' ELSE '' END
                             || text, chr(10) ORDER BY turn) AS response
  FROM tagged GROUP BY conv_id)"""

CHAT = """chat AS (
  SELECT conv_id, '<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)
         || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '<|eot_id|>', '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id)"""


def marker_parse_sql(src: str, text_col: str = "response") -> str:
    """T4 oracle: emulate the split with captured markers, strip/drop blanks, then pair.

    A piece is content iff the run of consecutive markers right before it has odd length.
    """
    return f"""mp_split AS (
  SELECT conv_id, regexp_split_to_array({text_col}, '\\[USR\\]:?|\\[AI\\]:?') AS pieces,
         regexp_extract_all({text_col}, '\\[USR\\]:?|\\[AI\\]:?') AS marks FROM {src}),
mp_tok AS (
  SELECT conv_id, unnest(list_concat([pieces[1]], flatten(list_transform(range(1, len(marks) + 1), lambda i: [marks[i], pieces[i + 1]])))) AS tok,
         unnest(range(1, 2 * len(marks) + 2)) AS pos
  FROM mp_split),
mp_clean AS (
  SELECT conv_id, pos, regexp_replace(tok, '^\\s+|\\s+$', '', 'g') AS tok, (pos % 2 = 0) AS is_marker FROM mp_tok),
mp_ne AS (
  SELECT conv_id, tok, is_marker, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM mp_clean WHERE tok <> ''),
mp_runs AS (
  SELECT *, i - 1 - coalesce(max(CASE WHEN NOT is_marker THEN i END) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run_before,
         lag(tok) OVER (PARTITION BY conv_id ORDER BY i) AS prev_tok
  FROM mp_ne),
mp_out AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS idx,
         CASE WHEN prev_tok LIKE '[USR]%' THEN 'user' ELSE 'AI' END AS role, tok AS content
  FROM mp_runs WHERE run_before % 2 = 1)"""

ENT_P = """ents AS (SELECT DISTINCT lower(p_name) AS entity FROM part WHERE p_name NOT IN ('about', 'by', 'of', 'for'))"""
TEXT_P = """texts AS (SELECT p.p_partkey AS text_id, 'i like the ' || p.p_name || ', and ' || p2.p_name || '!' AS text
                 FROM part p JOIN part p2 ON p2.p_partkey = (p.p_partkey * 7) % (SELECT count(*) FROM part))"""
FUZZY_P = """texts AS (SELECT p_partkey AS text_id, substr(p_name, 1, length(p_name) - 1) || 'x' AS text FROM part)"""


def ngram_sql(x: str, n: int = 3) -> str:
    s = f"regexp_replace(trim(regexp_replace(regexp_replace(lower({x}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+', ' ', 'g')"
    return f"list_distinct(list_transform(range(1, length({s}) - {n} + 2), lambda i: substr({s}, i, {n})))"


def mentions_sql(threshold: float = 0.7, n: int = 3) -> str:
    """Brute-force oracle over all (text, entity) pairs (ASCII text: RE2's \\b is ASCII)."""
    return f""", tw AS (SELECT text_id, lower(text) AS tl, list_distinct(string_split_regex(trim(lower(text)), '\\s+')) AS words,
               {ngram_sql('text', n)} AS tg FROM texts WHERE trim(text) <> ''),
ew AS (SELECT entity, list_distinct(string_split_regex(trim(entity), '\\s+')) AS ewords, {ngram_sql('entity', n)} AS eg FROM ents),
pairs AS (SELECT text_id, entity, tl, tg, eg,
            regexp_matches(tl, '\\b' || regexp_escape(entity) || '\\b') AS exact,
            len(list_intersect(tg, eg)) AS i, len(list_distinct(list_concat(tg, eg))) AS u
          FROM tw, ew WHERE list_has_any(words, ewords))
SELECT text_id, entity, CASE WHEN exact THEN 1.0 ELSE round(i / u, 6) END AS score FROM pairs
WHERE exact OR (len(eg) >= 2 AND i >= {threshold} * len(eg) AND i / u >= {threshold})"""

KG = """kg AS (SELECT CAST(s_nationkey AS VARCHAR) AS head_id, 0 AS relation_id, CAST(s_suppkey AS VARCHAR) AS tail_id FROM supplier
        UNION ALL SELECT CAST(n_regionkey AS VARCHAR), 1, CAST(n_nationkey AS VARCHAR) FROM nation)"""
KG_ENT = """kgent AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation
           UNION ALL SELECT CAST(r_regionkey + 1000 AS VARCHAR), r_name FROM region)"""
DICT = """dict AS (SELECT CAST(item_id AS VARCHAR) AS k, min(regexp_replace(title, '[\\(\\[].*?[\\)\\]]', '', 'g')) AS title FROM cat GROUP BY 1)"""


def sid(x: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 15)) AS BIGINT)"

MENTION_NAMES = """names AS (SELECT p_name AS name FROM part UNION ALL SELECT s_name FROM supplier
  UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region),
ents AS (SELECT DISTINCT lower(name) AS entity FROM names WHERE name IS NOT NULL AND name NOT IN ('about', 'by', 'of', 'for'))"""
MENTION_TURNS = """np AS (SELECT count(*) AS n FROM part),
mturns AS (SELECT c.conv_id, c.turn, c.role, c.text || ' ' || p.p_name AS text
           FROM conversations c, np JOIN part p ON p.p_partkey = (c.conv_id * 37 + c.turn * 11) % np.n
           UNION ALL SELECT d.conv_id, 100000, 'user', substr(p.p_name, 1, length(p.p_name) - 1) || 'x'
           FROM (SELECT DISTINCT conv_id FROM conversations) d, np JOIN part p ON p.p_partkey = (d.conv_id * 7) % np.n)"""

_W = "\\p{L}\\p{N}\\p{M}_"  # Unicode word characters


def uni_ngram_sql(x: str, n: int = 3) -> str:
    s = (
        f"regexp_replace(trim(regexp_replace(regexp_replace(lower({x}), '[^{_W}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+', ' ', 'g')"
    )
    return f"list_distinct(list_transform(range(1, length({s}) - {n} + 2), lambda i: substr({s}, i, {n})))"


def unicode_mentions_sql(threshold: float = 0.7, n: int = 3, src: str = "msgs") -> str:
    """Brute-force mention oracle with Unicode word boundaries: ``\\b`` before the entity is
    ``(^|[^W])`` when it starts with a word character, else ``[W]`` (and mirrored after)."""
    left = f"CASE WHEN regexp_matches(entity, '^[{_W}]') THEN '(^|[^{_W}])' ELSE '[{_W}]' END"
    right = f"CASE WHEN regexp_matches(entity, '[{_W}]$') THEN '([^{_W}]|$)' ELSE '[{_W}]' END"
    return f""", tw AS (SELECT conv_id, idx, lower(text) AS tl, list_distinct(string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '\\s+')) AS words,
               {uni_ngram_sql('text', n)} AS tg FROM {src} WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
ew AS (SELECT entity, list_distinct(string_split_regex(trim(entity), '\\s+')) AS ewords, {uni_ngram_sql('entity', n)} AS eg,
              {left} || regexp_escape(entity) || {right} AS pat FROM ents WHERE trim(entity) <> ''),
pairs AS (SELECT conv_id, idx, entity, regexp_matches(tl, pat) AS exact,
            len(list_intersect(tg, eg)) AS i, len(list_distinct(list_concat(tg, eg))) AS u, eg
          FROM tw, ew WHERE list_has_any(words, ewords)),
m AS (SELECT conv_id, idx, entity, CASE WHEN exact THEN 1.0 ELSE round(i / u, 6) END AS score FROM pairs
      WHERE exact OR (len(eg) >= 2 AND i >= {threshold} * len(eg) AND i / u >= {threshold}))"""
