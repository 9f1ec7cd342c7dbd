"""DuckDB SQL for consistent form, distinctiveness and clusters, written from their definitions in relational steps."""

from __future__ import annotations

import sys
import unicodedata

from phraseworks.llm import glyphs

BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LATIN, ARABIC = r"[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{1e00}-\x{1eff}]", r"[\x{620}-\x{64a}\x{66e}-\x{6d3}\x{6d5}\x{6ee}-\x{6ef}\x{6fa}-\x{6ff}]"
FOREIGN, GREEK = r"\x{370}-\x{52f}\x{1f00}-\x{1fff}", r"[\x{370}-\x{3ff}\x{1f00}-\x{1fff}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(chars: set[int]) -> str:
    """A character class of code points, as ranges."""
    parts, listed = [], sorted(chars)
    begin = before = None
    for c in [*listed, None]:
        if before is not None and c == before + 1:
            before = c
            continue
        if begin is not None:
            parts.append(f"\\x{{{begin:x}}}-\\x{{{before:x}}}")
        begin = before = c
    return f"[{''.join(parts)}]"


def undone(x: str) -> str:
    """Forms of letters undone, invisible characters and stretching strokes dropped, blanks made spaces."""
    tags = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>")
    single, several, gone, blank = {}, {}, set(), {9, 0xB, 0xC, *range(0x1C, 0x20)}
    for c in range(sys.maxunicode + 1):
        ch, kind = chr(c), unicodedata.category(chr(c))
        tag = unicodedata.decomposition(ch).partition(" ")[0]
        if c == 0x640 or kind == "Cf" and not (0x600 <= c < 0x606 or c in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)) or 0xFE00 <= c < 0xFE10 or c in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            gone.add(c)
        elif kind == "Zs" and c != 0x20:
            blank.add(c)
        elif tag in tags or tag == "<compat>" and 0xFB00 <= c <= 0xFB4F:
            to = unicodedata.normalize("NFKC", ch)
            (single if len(to) == 1 else several)[ch] = to
    made = f"regexp_replace(regexp_replace({x}, '{_class(gone)}', '', 'g'), '{_class(blank)}', ' ', 'g')"
    made = f"translate({made}, {lit(''.join(single))}, {lit(''.join(single.values()))})"
    for a, b in several.items():
        if 0xFB00 <= ord(a) < 0xFB07 or 0xFEF5 <= ord(a) < 0xFEFD:  # Latin ligatures and lam-alef; the others are not in the tables
            made = f"replace({made}, {lit(a)}, {lit(b)})"
    return made


def consistent(source: str) -> str:
    """Tables down to ``form (id, given, text, changed)`` of ``source (id, given)``, one row per text."""
    look = {**glyphs.CYRILLIC, **glyphs.GREEK, **glyphs.LATIN_LIKE}
    all_look = "".join(look)
    own = f"[{FOREIGN}]"
    return (
        f"u AS (SELECT id, given, {undone('given')} AS x FROM {source}), n AS (SELECT id, given, x, nfc_normalize(x) AS y FROM u), "
        r"p AS (SELECT id, y, regexp_extract_all(y, '[\p{L}\p{M}]+|[^\p{L}\p{M}]+') AS ps FROM n), t AS (SELECT id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos FROM p), "
        rf"l AS (SELECT id, pos, piece, regexp_matches(piece, '^[\p{{L}}\p{{M}}]') AS word, regexp_matches(piece, '{LATIN}') AS latin, regexp_matches(piece, '{own}') AS alien, "
        rf"regexp_matches(translate(piece, {lit(all_look)}, ''), '{own}') AS truly, length(piece) > 1 AND regexp_matches(piece, '[{glyphs.RARE}]') AS rare, length(piece) = 1 AND regexp_matches(piece, '{GREEK}') AS symbol, "
        rf"regexp_matches(piece, '{ARABIC}') AND NOT regexp_matches(piece, '[پچژگٹڈڑںے]') AS arabic FROM t), "
        "w AS (SELECT *, alien AND NOT latin AS other, lag(alien AND NOT latin) OVER (PARTITION BY id ORDER BY pos) AS before FROM l WHERE word), "
        "g AS (SELECT *, sum(CASE WHEN other AND coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS grp FROM w), "
        "h AS (SELECT id, pos, CASE WHEN arabic THEN translate(z, 'کیہھە', 'كيههه') ELSE z END AS piece FROM (SELECT *, CASE WHEN latin OR (NOT truly AND (NOT bool_or(truly) OVER (PARTITION BY id, grp) OR rare) AND NOT symbol) "
        f"THEN translate(piece, {lit(all_look)}, {lit(''.join(look.values()))}) ELSE piece END AS z FROM g)), "
        "r AS (SELECT id, string_agg(coalesce(h.piece, l.piece), '' ORDER BY l.pos) AS text FROM l LEFT JOIN h USING (id, pos) GROUP BY 1), "
        "form AS (SELECT n.id, n.given, CASE WHEN n.given IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, coalesce(n.given <> n.x OR length(n.x) <> length(n.y) OR coalesce(r.text, '') <> n.y, false) AS changed FROM n LEFT JOIN r USING (id))"
    )


DOCS = "docs AS (SELECT doc_id AS id, any_value(text) AS given FROM session_docs GROUP BY 1)"
PHRASES = "phrases AS (SELECT phrase_id AS id, any_value(text) AS given, any_value(topic_key) AS topic_key, any_value(df_ratio) AS df_ratio FROM phrase_rows GROUP BY 1)"


def key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{BLANKS}', ' ', 'g'))"


KEYS = f"{PHRASES}, {consistent('phrases')}, keyed AS (SELECT id AS phrase_id, topic_key, df_ratio, {key('text')} AS k FROM form JOIN phrases USING (id) WHERE topic_key IS NOT NULL AND text IS NOT NULL)"
SCORED = (
    f"WITH {KEYS}, total AS (SELECT count(DISTINCT topic_key) AS t FROM topics_local), held AS (SELECT k, count(DISTINCT topic_key) AS n FROM keyed GROUP BY 1), "
    "scored AS (SELECT topic_key, phrase_id, df_ratio * ln(t::DOUBLE / n) AS score FROM keyed JOIN held USING (k), total WHERE n > 1 AND df_ratio BETWEEN 0 AND 1 AND NOT isnan(df_ratio)), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY score DESC, phrase_id) AS rank FROM scored)"
)
CLUSTERS = (
    f"WITH RECURSIVE {KEYS}, f AS (SELECT DISTINCT topic_key, k FROM keyed), s AS (SELECT topic_key, count(*) AS n FROM f GROUP BY 1), "
    "b AS (SELECT a.topic_key AS x, b.topic_key AS y, count(*) AS n FROM f a JOIN f b ON a.k = b.k AND a.topic_key <> b.topic_key GROUP BY 1, 2), "
    "e AS (SELECT x, y FROM b JOIN s p ON p.topic_key = x JOIN s q ON q.topic_key = y WHERE 2 * b.n >= p.n + q.n - b.n), "
    "reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y), "
    "c AS (SELECT t.topic_key, least(t.topic_key, coalesce(min(reach.y), t.topic_key)) AS first_key FROM (SELECT DISTINCT topic_key FROM topics_local) t LEFT JOIN reach ON reach.x = t.topic_key GROUP BY 1)"
)

ORACLE = {
    "p2_found": f"{CLUSTERS} SELECT first_key, topic_key FROM c WHERE first_key <> topic_key",
    "p2_topic_clusters": f"{CLUSTERS} SELECT first_key, topic_key FROM c",
    "p4_found": f"WITH {DOCS}, {consistent('docs')}, a AS (SELECT 'session_docs' AS tbl, id AS row_id FROM form WHERE changed) SELECT * FROM a UNION ALL (WITH {PHRASES}, {consistent('phrases')} SELECT 'phrase_rows' AS tbl, id AS row_id FROM form WHERE changed)",
    "p4_session_docs": f"WITH {DOCS}, {consistent('docs')} SELECT id AS doc_id, text, changed FROM form",
    "p4_phrase_rows": f"WITH {PHRASES}, {consistent('phrases')} SELECT id AS phrase_id, topic_key, text, {key('text')} AS phrase_key, changed FROM form JOIN phrases USING (id)",
    "p5_found": f"{SCORED} SELECT topic_key, phrase_id FROM ranked WHERE rank <= 3",
    "p5_top_phrases": f"{SCORED} SELECT topic_key, phrase_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3",
    "p5_word_scores": (
        f"WITH {KEYS}, total AS (SELECT count(DISTINCT topic_key) AS t FROM topics_local), phrase AS (SELECT row_number() OVER () AS i, topic_key, string_split(k, ' ') AS ws FROM (SELECT DISTINCT topic_key, k FROM keyed)), "
        "word AS (SELECT i, topic_key, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM phrase), degree AS (SELECT a.topic_key, a.word, count(DISTINCT b.word) AS degree FROM word a JOIN word b ON a.i = b.i AND abs(a.pos - b.pos) BETWEEN 1 AND 3 AND a.word <> b.word GROUP BY 1, 2), "
        "held AS (SELECT DISTINCT topic_key, word FROM word WHERE word <> ''), often AS (SELECT word, count(*) AS n FROM held GROUP BY 1) "
        "SELECT topic_key, word, coalesce(degree, 0) AS degree, n, CASE WHEN n > 1 THEN round(coalesce(degree, 0) * ln(t::DOUBLE / n), 9) END AS score FROM held LEFT JOIN degree USING (topic_key, word) JOIN often USING (word), total"
    ),
    "p2_described": (
        f"{CLUSTERS}, held AS (SELECT c.first_key, f.topic_key, f.k FROM f JOIN c USING (topic_key)), sums AS (SELECT first_key, k, count(*) AS m FROM held GROUP BY 1, 2), sizes AS (SELECT first_key, count(*) AS n_topics FROM c GROUP BY 1), "
        "squares AS (SELECT first_key, sum(m * m)::DOUBLE AS square FROM sums GROUP BY 1), dots AS (SELECT topic_key, sum(m)::DOUBLE AS dot, count(*) AS own FROM held JOIN sums USING (first_key, k) GROUP BY 1), "
        "away AS (SELECT c.first_key, c.topic_key, n_topics, round(sqrt(greatest(coalesce(own, 0) - 2 * coalesce(dot, 0) / n_topics + coalesce(square, 0) / (n_topics * n_topics)::DOUBLE, 0)), 9) AS d "
        "FROM c JOIN sizes USING (first_key) LEFT JOIN squares USING (first_key) LEFT JOIN dots USING (topic_key)), "
        "named AS (SELECT topic_key, arg_max(name, (loaded_at, name)) AS name FROM topic_previews WHERE name IS NOT NULL GROUP BY 1), "
        r"good AS (SELECT first_key, arg_min(name, (d, topic_key)) AS name FROM away JOIN named USING (topic_key) WHERE NOT regexp_matches(lower(name), '^\s*(topic \d+|general topic|untitled topic|single document topic)\s*$') GROUP BY 1), "
        "docs AS (SELECT first_key, count(DISTINCT doc) AS n_docs FROM (SELECT first_key, unnest(doc_ids) AS doc FROM topics_local JOIN c USING (topic_key)) GROUP BY 1), "
        "near AS (SELECT *, row_number() OVER (PARTITION BY first_key ORDER BY d, topic_key) AS place FROM away), shown AS (SELECT first_key, any_value(n_topics) AS n_topics, string_agg(topic_key, ',' ORDER BY place) AS typical FROM near WHERE place <= 3 GROUP BY 1) "
        "SELECT first_key AS cluster, n_topics, coalesce(n_docs, 0) AS n_docs, name, typical FROM shown LEFT JOIN good USING (first_key) LEFT JOIN docs USING (first_key)"
    ),
}
