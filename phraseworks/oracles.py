"""DuckDB SQL equal to the core queries, written from their definitions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from phraseworks.functions.text import match_tokens
from phraseworks.operators import identifiers, stopwords
from phraseworks.plans.rules import Join, Node, Phrase, Rule

BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TOKEN = r"[A-Za-z0-9\x{0600}-\x{06FF}]+"
ARABIC = r"\x{0600}-\x{06FF}"
NOT_W = r"[^\p{L}\p{N}_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{BLANKS}', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANKS}|{BLANKS}$', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{TOKEN}')"


def match_form(x: str) -> str:
    """NFKC changes one character of the corpus, the superscript two."""
    quoted = f"translate(lower(coalesce({x}, '')), '“”’', '\"\"''')"
    folded = rf"regexp_replace({quoted}, '[\x{{0640}}\x{{064B}}-\x{{065F}}\x{{0670}}\x{{06D6}}-\x{{06ED}}]', '', 'g')"
    return ws(f"translate({folded}, 'أإآ²', 'ااا2')")


def compatible(x: str) -> str:
    """NFKC: forms of one character by one translation, those of several by a map over characters, then composed."""
    single, several = {}, {}
    for code in [*range(0xA0, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F252)]:
        made = unicodedata.normalize("NFKC", chr(code))
        if made != chr(code):
            (single if len(made) == 1 else several)[chr(code)] = made
    mapped = f"translate({x}, {lit(''.join(single))}, {lit(''.join(single.values()))})"
    pairs = ", ".join(f"{lit(a)}: {lit(b)}" for a, b in several.items())
    chars = f"[{''.join(several)}]"
    whole = f"array_to_string(list_transform(string_split({mapped}, ''), lambda c: coalesce(MAP {{{pairs}}}[c], c)), '')"
    return f"nfc_normalize(CASE WHEN regexp_matches({mapped}, {lit(chars)}) THEN {whole} ELSE {mapped} END)"


def match_text(x: str) -> str:
    return f"' ' || array_to_string(regexp_extract_all({match_form(x)}, '{TOKEN}'), ' ') || ' '"


def grams(k: str) -> str:
    two = f"CASE WHEN len({k}) >= 2 THEN list_transform(range(1, len({k})), lambda i: {k}[i] || ' ' || {k}[i+1]) ELSE [] END"
    three = f"CASE WHEN len({k}) >= 3 THEN list_transform(range(1, len({k}) - 1), lambda i: {k}[i] || ' ' || {k}[i+1] || ' ' || {k}[i+2]) ELSE [] END"
    return f"list_concat(list_concat({k}, {two}), {three})"


CORPUS = f"corpus AS (SELECT doc_id, {ws('text')} AS text, lang, source FROM documents WHERE length({ws('text')}) > 0)"
LABELS = "labels AS (SELECT doc_id, CASE lang WHEN 'ar' THEN 0 WHEN 'en' THEN 1 WHEN 'mixed' THEN 2 ELSE 3 END AS label FROM corpus)"


def counted(source: str = "corpus", name: str = "counts") -> str:
    return (
        f"{name}_k AS (SELECT doc_id, {tokens('text')}[1:120000] AS k FROM {source}), "
        f"{name}_g AS (SELECT doc_id, {grams('k')} AS g FROM {name}_k), "
        f"{name}_o AS (SELECT doc_id, unnest(g) AS term, generate_subscripts(g, 1) AS place FROM {name}_g), "
        f"{name} AS (SELECT doc_id, term, count(*) AS tf, min(place) AS place FROM {name}_o GROUP BY 1, 2)"
    )


STATS = (
    f"WITH {CORPUS}, {counted()}, n AS (SELECT count(*) AS n FROM corpus), "
    "stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df, count(*) / any_value(n) AS df_ratio, min((doc_id, place)) AS seen FROM counts, n GROUP BY 1)"
)
FIRST = "row_number() OVER (ORDER BY df DESC, tf DESC, seen)"
VECTORS = (
    f"{STATS}, vocab AS (SELECT term, df FROM stats ORDER BY tf DESC, term LIMIT 25000), "
    "raw AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM counts JOIN vocab USING (term), n), "
    "norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1), weights AS (SELECT doc_id, term, w / norm AS weight FROM raw JOIN norms USING (doc_id))"
)
LOW = (
    r"(trim(term) = '' OR regexp_matches(term, '^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}$') OR NOT regexp_matches(replace(term, ' ', ''), '\p{L}') "
    r"OR (len(string_split(term, ' ')) >= 2 AND len(list_distinct(string_split(term, ' '))) = 1) OR (regexp_matches(term, '\p{Nd}{3}') AND NOT contains(term, ' ')) "
    r"OR (length(term) >= 18 AND regexp_matches(term, '\p{Nd}') AND contains(term, '-')))"
)


def truth(node: Node, text: str = "m") -> str:
    match node:
        case Phrase():
            return f"contains({text}, {lit(f' {node.sequence} ')})" if node.sequence else "false"
        case Join(word, left, right):
            return f"({truth(left, text)} {word} {truth(right, text)})"
    return "false"


def contributing(node: Node, above: str = "true") -> list[tuple[str, str]]:
    match node:
        case Phrase():
            return [(node.key, f"{above} AND {truth(node)}")]
        case Join(word, left, right):
            around = f"{above} AND {truth(node)}" if word == "AND" else above
            return [*contributing(left, around), *contributing(right, around)]
    return []


def written(expression: str) -> str:
    """The truth of an expression with SQL's own precedence: its text, phrases replaced. Owes nothing to our reader of rules."""
    return "(" + re.sub(r'"([^"]+)"', lambda m: f"contains(m, {lit(' ' + ' '.join(match_tokens(m[1])) + ' ')})", expression) + ")"


def matches(rules: Sequence[Rule], source: str) -> str:
    """``(doc_id, rule_id, rule_name, phrase)`` of each contributing phrase."""
    rows = [f"SELECT doc_id, {i} AS rule_id, {lit(r.name)} AS rule_name, {lit(key)} AS phrase FROM texts WHERE {written(r.expression)} AND {when}" for i, r in enumerate(rules, 1) for key, when in contributing(r.tree)]
    return f"texts AS (SELECT doc_id, {match_text('text')} AS m FROM ({source})), hits AS ({' UNION '.join(rows)})"


def mask(rules: Sequence[Rule]) -> str:
    return " + ".join(f"CASE WHEN {written(r.expression)} THEN {1 << i} ELSE 0 END" for i, r in enumerate(rules))


def lines() -> str:
    break_ = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
    norm = ws("line")
    # boundaries consumed and given back; repeated so that neighbours that share a boundary are found too
    page = rf"regexp_replace({norm}, '(?i)(^|{NOT_W})page\s*\p{{Nd}}+\s*(?:of\s*\p{{Nd}}+)?($|{NOT_W})', '\1page\2', 'g')"
    arabic = rf"regexp_replace({page}, 'صفحة\s*\p{{Nd}}+', 'صفحة', 'g')"
    number = rf"(^|{NOT_W})\p{{Nd}}{{2,}}($|{NOT_W})"
    replaced = arabic
    for _ in range(2):
        replaced = rf"regexp_replace({replaced}, '{number}', '\1' || chr(1) || '\2', 'g')"
    return (
        f"split AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{break_}') AS ls FROM documents), "
        f"raw AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM split), "
        f"stripped AS (SELECT doc_id, pos, {strip('line')} AS line FROM raw), "
        f"normed AS (SELECT doc_id, pos, line, lower(replace({replaced}, chr(1), '0')) AS norm FROM stripped WHERE length(line) >= 8), "
        "counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS repeats, count(*) OVER (PARTITION BY doc_id) AS n FROM normed), "
        rf"marked AS (SELECT *, repeats >= greatest(3, floor(n * 0.35::DOUBLE * 0.05::DOUBLE)) OR regexp_matches(line, '(?i)(^|{NOT_W})(document control|version|generated by|template)($|{NOT_W})') AS boilerplate FROM counted)"
    )


def phrase_row() -> str:
    return "(SELECT phrase_id, any_value(topic_key) AS topic_key, any_value(phrase_rank) AS phrase_rank, any_value(text) AS text FROM phrase_rows GROUP BY 1)"


def between_words(text: str, phrase: str) -> str:
    """``phrase`` is of letters and blanks, so it needs no escapes."""
    return f"regexp_matches({text}, {lit(f'(^|{NOT_W}){phrase.lower()}($|{NOT_W})')})"


def presence(listed: Sequence[str]) -> str:
    values = ", ".join(f"({i}, {lit(p)})" for i, p in enumerate(listed))
    lc = f"lower({ws('text')})"
    found = " UNION ALL ".join(f"SELECT doc_id, {i} AS idx FROM lower_texts WHERE {between_words('lc', p)}" for i, p in enumerate(listed))
    return (
        f"WITH {CORPUS}, {LABELS}, phrase(idx, phrase) AS (VALUES {values}), sizes AS (SELECT label, count(*) AS docs FROM labels GROUP BY 1), "
        f"lower_texts AS (SELECT doc_id, {lc} AS lc FROM corpus), "
        f"present AS (SELECT label, doc_id, CAST(idx AS INTEGER) AS idx FROM labels JOIN ({found}) USING (doc_id)), "
        "lp AS (SELECT l AS label, CAST(idx AS INTEGER) AS idx, phrase FROM phrase, range(4) t(l)), "
        "df AS (SELECT CAST(lp.label AS INTEGER) AS label, lp.idx, lp.phrase, count(doc_id) AS df FROM lp LEFT JOIN present USING (label, idx) GROUP BY ALL), "
        "pairs AS (SELECT a.label, a.idx AS i, b.idx AS j, count(*) AS n FROM present a JOIN present b ON a.label = b.label AND a.doc_id = b.doc_id AND a.idx < b.idx GROUP BY ALL)"
    )


def groups_sql(generic: str) -> str:
    return (
        f", eligible AS (SELECT df.*, docs, df / greatest(docs, 1) AS r FROM df JOIN sizes USING (label) WHERE df >= 2 AND phrase <> {lit(generic)}), "
        "anchors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY r * (1.0::DOUBLE - r) DESC, df DESC, idx DESC) AS rank FROM eligible) WHERE rank <= 3), "
        "linked AS (SELECT label, i AS a, j AS idx, n FROM pairs WHERE n >= 2 UNION ALL SELECT label, j, i, n FROM pairs WHERE n >= 2), "
        "scored AS (SELECT b.label, e.idx, e.phrase, e.df, e.docs, b.n AS pair_docs, a.rank AS anchor, (b.n / e.docs) / ((a.df / e.docs) * (e.df / e.docs)) AS lift FROM linked b JOIN anchors a ON a.label = b.label AND a.idx = b.a "
        "JOIN eligible e ON e.label = b.label AND e.idx = b.idx WHERE NOT EXISTS (SELECT 1 FROM anchors x WHERE x.label = e.label AND x.idx = e.idx)), "
        "best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY label, idx ORDER BY lift DESC, anchor) = 1), "
        "context AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY lift DESC, pair_docs DESC, df DESC, idx DESC) AS rank FROM best), "
        "controls AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rank) AS rank2 FROM context WHERE rank BETWEEN 7 AND 26 AND df / docs BETWEEN 0.35::DOUBLE AND 0.85::DOUBLE), "
        "bare AS (SELECT label, phrase, row_number() OVER (PARTITION BY label ORDER BY idx) AS rank FROM df WHERE label NOT IN (SELECT label FROM anchors)), "
        "parts AS (SELECT label, 1 AS part, rank, phrase FROM anchors UNION ALL SELECT label, 2, rank, phrase FROM context WHERE rank <= 6 UNION ALL SELECT label, 3, rank2, phrase FROM controls WHERE rank2 <= 6 "
        "UNION ALL SELECT label, 1, rank, phrase FROM bare WHERE rank <= 6)"
    )


def words_list(words: Sequence[str]) -> str:
    return ", ".join(lit(w) for w in words)


def quoted(x: str) -> str:
    """A phrase between straight quotes, its own at the ends taken off."""
    return f"""chr(34) || regexp_replace(regexp_replace({ws(x)}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') || chr(34)"""


def group_text(items: str) -> str:
    """The items of a list as a group of a rule."""
    return f"CASE len({items}) WHEN 0 THEN '' WHEN 1 THEN {items}[1] ELSE '(' || array_to_string({items}, ' OR ') || ')' END"


def penalty_row(i: int, groups: list[list[str]]) -> str:
    if len(groups) < 2:
        return f"SELECT {i} AS rule_id, 999.0::DOUBLE AS penalty"
    small = sum({1: 2.0, 2: 1.0}.get(len(g), 0.0) for g in groups)
    every = words_list([p for g in groups for p in g])
    common = f"SELECT sum(CASE WHEN df_ratio >= 0.85::DOUBLE THEN 2.0 WHEN df_ratio >= 0.70::DOUBLE THEN 1.0 ELSE 0.0 END) FROM stats WHERE term IN ({every})"
    return f"SELECT {i} AS rule_id, ({small}::DOUBLE + coalesce(({common}), 0)::DOUBLE)::DOUBLE AS penalty"


def chosen_rules(selectable: Sequence[tuple[int, list[list[str]]]], base: int) -> str:
    """Greedy choice by recursion: each step takes the rule that adds most documents less its penalty."""
    tests = [" AND ".join("(" + " OR ".join(f"contains(m, {lit(f' {p} ')})" for p in g) + ")" for g in groups) for _, groups in selectable]
    shown = ["(" + " AND ".join((f'"{g[0]}"' if len(g) == 1 else "(" + " OR ".join(f'"{p}"' for p in g) + ")") for g in groups) + ")" for _, groups in selectable]
    names = ", ".join(f"({k}, {i}, 'Rule {i}', {lit(text)})" for k, ((i, _), text) in enumerate(zip(selectable, shown, strict=True)))
    bits = " + ".join(f"CASE WHEN {test} THEN {1 << k} ELSE 0 END" for k, test in enumerate(tests))
    return (
        f"{STATS.replace('WITH', 'WITH RECURSIVE', 1)}, pen AS ({' UNION ALL '.join(penalty_row(i, g) for i, g in selectable)}), rules AS (SELECT v.k, v.name, v.text, pen.penalty FROM (VALUES {names}) v(k, rule_id, name, text) JOIN pen USING (rule_id)), "
        f"hist AS (SELECT CAST({bits} AS BIGINT) AS mask, count(*) AS docs FROM (SELECT {match_text('text')} AS m FROM documents) GROUP BY 1), goal AS (SELECT ceil(0.85::DOUBLE * greatest(1, sum(docs))) AS docs FROM hist), "
        "pick AS (SELECT 0 AS step, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS passed, CAST(0 AS BIGINT) AS covered, -1 AS k UNION ALL SELECT step + 1, taken | (1 << k2), passed | (1 << k2), covered + gain, k2 FROM ("
        "SELECT p.step, p.taken, p.passed, p.covered, r.k AS k2, g.gain, row_number() OVER (ORDER BY g.gain - r.penalty DESC, r.k) AS place FROM pick p, rules r, "
        "LATERAL (SELECT CAST(coalesce(sum(docs), 0) AS BIGINT) AS gain FROM hist WHERE (mask >> r.k) & 1 = 1 AND mask & p.taken = 0) g WHERE (p.passed >> r.k) & 1 = 0 AND p.covered < (SELECT docs FROM goal)) WHERE place = 1 AND gain > 0), "
        f"first AS (SELECT step AS position, k FROM pick WHERE k >= 0), rest AS (SELECT (SELECT count(*) FROM first) + row_number() OVER (ORDER BY k) AS position, k FROM rules WHERE k NOT IN (SELECT k FROM first)) "
        f"SELECT CAST(position AS INTEGER) AS position, name, text AS expression FROM (SELECT * FROM first UNION ALL SELECT * FROM rest WHERE position <= {base}) JOIN rules USING (k)"
    )


def build(policy: str, listed: Sequence[str], rule_groups: Sequence[tuple[int, list[list[str]]]], selectable: Sequence[tuple[int, list[list[str]]]]) -> dict[str, str]:
    rules = [Rule(name, expression) for name, expression in re.findall(r"^## Rule \d+: (.+)\n`(.+)`$", policy, re.M)]
    docs = "SELECT doc_id, text FROM documents"
    flat = "SELECT doc_id, rule_id, rule_name, array_to_string(list_sort(list(phrase))[1:12], '|') AS hits FROM hits GROUP BY ALL"
    title = ws("name")
    kept = rf"trim(regexp_replace({title}, '[^\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}\s&/-]+', '', 'g'))"
    quote = "chr(34)"
    bare = f"""regexp_replace(regexp_replace({title}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')"""
    top = f"{STATS} SELECT * FROM (SELECT CAST({FIRST} AS INTEGER) AS rank, term, tf, df, CAST(round_even(df_ratio * 100, 0) AS INTEGER) AS pct, CAST(trunc(df_ratio * 100) AS INTEGER) AS pct_cut FROM stats) WHERE rank <= 60"
    stop = [w for w in [*stopwords.ENGLISH, *stopwords.ARABIC] if len(w) >= 2]
    mined = ws("replace(replace(text, chr(8207), ' '), chr(8206), ' ')")
    last_topic = "SELECT topic_key, arg_max(name, (loaded_at, name)) AS name FROM topic_previews GROUP BY 1"
    centroid = f"{VECTORS}, {LABELS}, cn AS (SELECT label, count(*) AS n FROM labels GROUP BY 1), cent AS (SELECT label, term, round(sum(weight) / any_value(cn.n), 9) AS weight FROM weights JOIN labels USING (doc_id) JOIN cn USING (label) GROUP BY 1, 2)"
    spaced = r"regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
    cut = (
        rf"runs AS (SELECT doc_id, regexp_extract_all(lower({mined}), '[\p{{L}}\p{{N}}_/-]+') AS r FROM corpus), "
        rf"cut AS (SELECT doc_id, list_filter(list_transform(r, lambda x: regexp_replace(x, '^[/-]+|[/-]+$', '', 'g')), lambda x: length(x) >= 2 AND x NOT IN ({words_list(stop)})) AS k FROM runs), "
        rf"g AS (SELECT doc_id, {grams('k')} AS g FROM cut), o AS (SELECT doc_id, unnest(g) AS term FROM g), c AS (SELECT doc_id, term, count(*) AS tf FROM o GROUP BY 1, 2)"
    )
    stopworded = (
        f"WITH {CORPUS}, n AS (SELECT count(*) AS n FROM corpus), {cut}, stats AS (SELECT term, count(*) AS df, count(*) / any_value(n) AS df_ratio FROM c, n GROUP BY 1), "
        "raw AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM c JOIN stats USING (term), n), norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1), "
        "weights AS (SELECT doc_id, term, w / norm AS weight FROM raw JOIN norms USING (doc_id))"
    )
    q: dict[str, str] = {
        "normalize_ws_docs": f"SELECT doc_id, {ws('text')} AS text FROM documents",
        "readable_docs": f"SELECT doc_id, length({ws('text')}) > 0 AS readable FROM documents",
        "clean_text_docs": f"SELECT doc_id, substring({strip(spaced)}, 1, 2000000) AS text FROM documents",
        "doc_tokens_count": f"SELECT doc_id, CAST(len(k) AS BIGINT) AS n, CAST(len(list_distinct(k)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {tokens('text')} AS k FROM documents)",
        "match_tokens_count": f"SELECT doc_id, CAST(len(k) AS BIGINT) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all({match_form('text')}, '{TOKEN}') AS k FROM documents)",
        "identifier_token_stats": rf"SELECT token, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_./-]+|[\x{{0600}}-\x{{06FF}}0-9_./-]+'))) AS token FROM documents) GROUP BY 1",
        "topic_titles": f"SELECT topic_key, CASE WHEN length({kept}) > 0 THEN substring({kept}, 1, 80) ELSE 'Untitled Topic' END AS title, {quote} || {bare} || {quote} AS quoted, replace(coalesce(name, ''), '|', chr(92) || '|') AS escaped FROM ({last_topic})",
        "letter_garbage_docs": f"SELECT doc_id, len(k) >= 4 AND 2 * len(list_filter(k, lambda x: length(x) = 1)) >= len(k) AS garbage FROM (SELECT doc_id, regexp_extract_all({match_form('text')}, '{TOKEN}') AS k FROM documents)",
        "quoted_phrases_docs": "SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, unnest(p) AS phrase FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '“”', '\"\"'), '\"([^\"]+)\"', 1) AS p FROM documents)",
        "corpus_summary": f"SELECT substring(regexp_replace(substring(string_agg(text, chr(10) ORDER BY doc_id), 1, 200000), '{BLANKS}', ' ', 'g'), 1, 2500) AS summary FROM documents WHERE text IS NOT NULL",
        "doc_ngrams_123": f"WITH {counted('documents')} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n, count(*) AS n_distinct, max(tf) AS max_tf FROM counts GROUP BY 1",
        "term_stats": f"{STATS} SELECT term, tf, df, df_ratio FROM stats",
        "term_stats_window": f"{STATS} SELECT term, tf, df, df_ratio FROM stats WHERE df_ratio BETWEEN 0.10::DOUBLE AND 0.85::DOUBLE",
        "top_terms": top,
        "top_terms_md": f"{STATS} SELECT 'Term | TF | DF | DF%' || chr(10) || '---|---:|---:|---:' || chr(10) || string_agg(term || ' | ' || tf || ' | ' || df || ' | ' || CAST(round_even(df_ratio * 100, 0) AS INTEGER) || '%', chr(10) ORDER BY rank) AS md FROM (SELECT *, {FIRST} AS rank FROM stats) WHERE rank <= 45",
        "fallback_topic_candidates": f"{STATS} SELECT term, tf, df, df_ratio FROM stats WHERE df_ratio BETWEEN 0.10::DOUBLE AND 0.85::DOUBLE AND length(term) BETWEEN 2 AND 60 ORDER BY df_ratio DESC, tf DESC, term LIMIT 25",
        "single_doc_topic": f"WITH {CORPUS}, largest AS (SELECT source, arg_max(doc_id, (length(text), -doc_id)) AS doc_id FROM corpus WHERE source IS NOT NULL GROUP BY 1), own AS (SELECT * FROM corpus SEMI JOIN largest USING (doc_id)), {counted('own')} "
        "SELECT source, CAST(rank AS INTEGER) AS rank, term, tf FROM (SELECT l.source, term, tf, row_number() OVER (PARTITION BY l.source ORDER BY tf DESC, term) AS rank FROM counts JOIN largest l USING (doc_id)) WHERE rank <= 20",
        "mine_terms": f"WITH {CORPUS}, n AS (SELECT count(*) AS n FROM corpus), {cut} "
        "SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df, count(*) / any_value(n) AS df_ratio FROM c, n WHERE length(term) >= 3 GROUP BY 1 ORDER BY df_ratio DESC, tf DESC, term LIMIT 200",
        "low_generalization_terms": f"{STATS} SELECT CAST(len(string_split(term, ' ')) AS INTEGER) AS n_words, {LOW} AS low, count(*) AS n FROM stats GROUP BY 1, 2",
        "heuristic_exclude": f"{STATS} SELECT term FROM stats WHERE df_ratio > 0.80::DOUBLE OR length(term) <= 3",
        "auto_stopwords": rf"{STATS}, {lines()}, words AS (SELECT lower(unnest(regexp_extract_all(line, '[A-Za-z0-9_./-]+|[\x{{0600}}-\x{{06FF}}0-9_./-]+'))) AS word FROM marked WHERE boilerplate) "
        f"SELECT word FROM words WHERE length(word) > 2 UNION SELECT term FROM stats WHERE df_ratio >= 0.85::DOUBLE OR length(term) <= 2 UNION SELECT unnest([{words_list(stopwords.UNIVERSAL)}])",
        "include_exclude_review": f"{STATS} SELECT term, df, CASE WHEN term IN ({words_list(stopwords.ENGLISH)}) THEN 'exclude' ELSE 'include' END AS decision FROM stats WHERE term IN ({words_list([*stopwords.ENGLISH, *[w for p in listed for w in p.split()]])})",
        "tfidf_weights": f"{VECTORS} SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, weight FROM (SELECT doc_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rank FROM weights) WHERE rank <= 5",
        "tfidf_column_sums": f"{VECTORS} SELECT term, round(sum(weight), 6) AS score FROM weights GROUP BY 1",
        "tfidf_stopworded": f"{stopworded} SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, weight FROM (SELECT doc_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rank FROM weights) WHERE rank <= 5",
        "inferred_topics": f"{stopworded}, cent AS (SELECT term, round(sum(weight) / any_value(n), 9) AS weight FROM weights, n GROUP BY 1), fit AS (SELECT term, df_ratio, row_number() OVER (ORDER BY weight DESC, term DESC) AS rank FROM cent JOIN stats USING (term) WHERE df_ratio BETWEEN 0.05::DOUBLE AND 0.85::DOUBLE AND NOT {LOW}) "
        "SELECT 0 AS label, CAST(rank AS INTEGER) AS rank, term AS phrase, df_ratio FROM fit WHERE rank <= 24",
        "topic_tfidf_sums": f"{centroid}, scan AS (SELECT * FROM cent QUALIFY row_number() OVER (PARTITION BY label ORDER BY weight DESC, term DESC) <= 250), "
        r"fit AS (SELECT label, term, df_ratio, row_number() OVER (PARTITION BY label ORDER BY weight DESC, term DESC) AS rank FROM scan JOIN stats USING (term) WHERE df_ratio BETWEEN 0.10::DOUBLE AND 0.85::DOUBLE AND length(term) >= 3 AND NOT regexp_matches(term, '^[0-9\x{0660}-\x{0669}\x{06F0}-\x{06F9}]+$')) "
        "SELECT label, CAST(rank AS INTEGER) AS rank, term AS phrase, df_ratio FROM fit WHERE rank <= 40",
        "aux_topic_phrases": f"{centroid}, fit AS (SELECT label, term, df_ratio, row_number() OVER (PARTITION BY label ORDER BY weight DESC, term DESC) AS rank FROM cent JOIN stats USING (term) WHERE df_ratio BETWEEN 0.05::DOUBLE AND 0.85::DOUBLE AND NOT {LOW}) "
        "SELECT label, CAST(rank AS INTEGER) AS rank, term AS phrase, df_ratio FROM fit WHERE rank <= 24",
        "topic_sizes": f"WITH {CORPUS}, s AS (SELECT source AS label, count(*) AS n, min(doc_id) AS first_doc FROM corpus WHERE source IS NOT NULL GROUP BY 1) SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, first_doc) AS INTEGER) AS rank FROM s) WHERE rank <= 20",
        "topic_members": "SELECT topic_key, CAST(len(doc_ids) AS BIGINT) AS n, array_to_string(list_sort(doc_ids), ',') AS doc_ids FROM topics_local WHERE len(doc_ids) > 0",
        "cooc_presence": f"{presence(listed)} SELECT label, doc_id, idx FROM present",
        "cooc_phrase_df": f"{presence(listed)} SELECT label, idx, df FROM df",
        "cooc_pair_df": f"{presence(listed)} SELECT label, i, j, n FROM pairs",
        "cooc_lift": f"{presence(listed)} SELECT p.label, i, j, n, round((n / docs) / ((a.df / docs) * (b.df / docs)), 9) AS lift FROM pairs p JOIN df a ON a.label = p.label AND a.idx = i JOIN df b ON b.label = p.label AND b.idx = j JOIN sizes s ON s.label = p.label",
        "topic_anchors": f"{presence(listed)}{groups_sql('internal use only')} SELECT label, CAST(rank AS INTEGER) AS rank, phrase, df FROM anchors",
        "topic_groups": f'{presence(listed)}{groups_sql("internal use only")} SELECT CAST(label AS INTEGER) AS label, CAST(dense_rank() OVER (PARTITION BY label ORDER BY part) AS INTEGER) AS "group", CAST(rank AS INTEGER) AS rank, phrase FROM parts',
        "default_groups": f"WITH p AS (SELECT topic_key, list({ws('text')} ORDER BY phrase_rank, phrase_id) AS ps FROM {phrase_row()} WHERE phrase_rank <= 12 GROUP BY 1) SELECT topic_key, array_to_string(ps[1:6], '|') AS group1, array_to_string(CASE WHEN len(ps) > 6 THEN ps[7:12] ELSE ps[1:6] END, '|') AS group2 FROM p",
        "test_policy_flat": f"WITH {matches(rules, docs)} {flat}",
        "test_policy_stream": f"WITH {matches(rules, docs)} {flat}",
        "test_policy_hits": f"WITH {matches(rules, docs)} SELECT rule_id, phrase, count(*) AS docs FROM hits GROUP BY ALL",
        "policy_on_eval_items": f"WITH {matches(rules, 'SELECT item_id AS doc_id, text FROM eval_items')}, flat AS ({flat}) SELECT doc_id, rule_id, hits FROM flat",
        "phrase_equi_match": f"WITH texts AS (SELECT doc_id, {match_text('text')} AS m FROM documents), phrase(phrase, s) AS (VALUES {', '.join(f'({lit(p)}, {lit(chr(32) + chr(32).join(match_tokens(p)) + chr(32))})' for p in listed)}) SELECT phrase, count(*) AS docs, min(doc_id) AS first_doc FROM texts JOIN phrase ON contains(m, s) GROUP BY 1",
        "phrase_present_variants": f"WITH texts AS (SELECT {match_text('text')} AS m, lower({ws('text')}) AS lc, {match_form('text')} AS form FROM documents) "
        + " UNION ALL ".join(
            f"SELECT {lit(p)} AS phrase, count(*) FILTER (contains(m, {lit(f' {p} ')})) AS in_tokens, count(*) FILTER ({between_words('lc', p)}) AS between_words, "
            rf"count(*) FILTER (regexp_matches(form, {lit(f'(^|[^A-Za-z0-9{ARABIC}]){p}($|[^A-Za-z0-9{ARABIC}])')})) AS between_alphanumerics FROM texts"
            for p in listed
        ),
        "rule_coverage": f"WITH texts AS (SELECT {match_text('text')} AS m FROM documents) {' UNION ALL '.join(f'SELECT {i} AS rule_id, count(*) FILTER ({written(r.expression)}) AS docs FROM texts' for i, r in enumerate(rules, 1))}",
        "rule_mask_histogram": f"WITH texts AS (SELECT {match_text('text')} AS m FROM documents) SELECT CAST({mask(rules)} AS BIGINT) AS mask, count(*) AS n FROM texts GROUP BY 1",
        "combined_expression": f"WITH c AS (SELECT topic_key, list_transform(list_filter(list_transform(candidates[1:3], lambda x: x.phrase), lambda p: length({ws('p')}) > 0), lambda p: {quoted('p')}) AS a, "
        f"list_transform(list_filter(list_transform(candidates[4:6], lambda x: x.phrase), lambda p: length({ws('p')}) > 0), lambda p: {quoted('p')}) AS b FROM topics_local), "
        f"g AS (SELECT topic_key, {group_text('a')} AS x, {group_text('b')} AS y FROM c) SELECT topic_key, CASE WHEN coalesce(x, '') = '' THEN coalesce(y, '') WHEN coalesce(y, '') = '' THEN x ELSE '(' || x || ' AND ' || y || ')' END AS expression FROM g",
        "regex_catalogue_hits": " UNION ALL ".join(f"SELECT {lit(n)} AS name, count(*) FILTER (c > 0) AS docs, CAST(coalesce(sum(c), 0) AS BIGINT) AS hits FROM (SELECT len(regexp_extract_all(coalesce(text, ''), {lit(p)})) AS c FROM documents)" for n, p in identifiers.CATALOGUE),
        "boilerplate_lines": f"WITH {lines()} SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM marked WHERE boilerplate) WHERE r <= 200",
        "boilerplate_counts": f"WITH {lines()} SELECT norm, count(*) AS n, count(*) FILTER (boilerplate) AS n_boilerplate FROM marked GROUP BY 1",
        "cleaned_text": f"WITH {lines()}, c AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM marked WHERE NOT boilerplate GROUP BY 1) SELECT doc_id, CAST(length(coalesce(t, '')) AS BIGINT) AS n_chars, md5(coalesce(t, '')) AS digest FROM documents LEFT JOIN c USING (doc_id)",
        "structured_previews": "WITH n AS (SELECT topic_key, arg_max(struct_pack(a := name, b := doc_count), (loaded_at, name, doc_count)) AS p FROM topic_previews GROUP BY 1), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY phrase_rank, phrase_id) AS r FROM {phrase_row()}), s AS (SELECT topic_key, string_agg(text, '|' ORDER BY r) AS phrases FROM r WHERE r <= 18 GROUP BY 1) "
        "SELECT topic_key, p.a AS name, p.b AS doc_count, phrases FROM n LEFT JOIN s USING (topic_key)",
        "session_term_rows": f"WITH c AS (SELECT run_id, lower({ws('term')}) AS term, arg_max(struct_pack(tf := tf, df := df), (loaded_at, tf, df)) AS x FROM term_rows WHERE term IS NOT NULL AND tf IS NOT NULL AND df IS NOT NULL GROUP BY 1, 2), "
        "r AS (SELECT run_id, term, x.tf, x.df, row_number() OVER (PARTITION BY run_id ORDER BY x.df DESC, x.tf DESC, term) AS rank FROM c) SELECT run_id, CAST(rank AS INTEGER) AS rank, term, tf, df FROM r WHERE rank <= 60",
    }
    q["rule_penalty"] = f"{STATS} {' UNION ALL '.join(penalty_row(i, g) for i, g in rule_groups)}"
    q["selected_policy"] = chosen_rules(selectable, 4)
    hinted = {family: " OR ".join(f"contains(x, {lit(w)})" for w in words) for family, words in identifiers.HINTS}
    by_name = [(n, " OR ".join(f"({hinted[f]})" for f in hinted if f in n.lower())) for n, _ in identifiers.CATALOGUE]
    cases = ", ".join(f"CASE WHEN {when or 'false'} THEN {lit(n)} END" for n, when in by_name)
    q["regex_suggestions"] = (
        "WITH c AS (SELECT topic_key, lower(concat_ws(' ', topic_name, array_to_string(list_transform(candidates, lambda c: c.phrase), ' '))) AS x FROM topics_local), "
        f"k AS (SELECT topic_key, list_filter([{cases}], lambda n: n IS NOT NULL) AS names FROM c) SELECT topic_key, unnest(CASE WHEN len(names) > 0 THEN names ELSE [{words_list([n for n, _ in by_name[:4]])}] END) AS pattern FROM k"
    )
    text = lambda x: f"chr(34) || {x} || chr(34)"
    inside = lambda a, b, word: f"'(' || chr(92) || chr(34) || t[{a}] || chr(92) || chr(34) || ' {word} ' || chr(92) || chr(34) || t[{b}] || chr(92) || chr(34) || ')'"
    one, two, three = inside(1, 2, "OR"), inside(3, 4, "AND"), inside(5, 6, "OR")
    group = lambda a, b, word: f"""'{{"terms": [' || {text(f't[{a}]')} || ', ' || {text(f't[{b}]')} || '], "match": "{word}"}}'"""
    notes = ", ".join(f'"{n}"' for n in (
        "In Symantec DLP, create a Keyword Rule and paste the boolean expression in the rule logic (or build equivalent groups in UI).",
        "Add Include terms as a Keyword List. Add Exclude terms as exceptions where possible.", "Tune: reduce max_df/min_df and increase threshold to reduce false positives.",
    ))
    commas = lambda x: f"array_to_string(list_transform({x}, lambda v: chr(34) || v || chr(34)), ', ')"
    q["near_policy_payload"] = (
        "WITH c AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(candidates, lambda c: c.phrase)) AS term FROM topics_local) WHERE term IS NOT NULL GROUP BY 1 ORDER BY n DESC, term LIMIT 6), "
        "g AS (SELECT term, count(*) AS n FROM (SELECT unnest(generic_terms) AS term FROM analyze_runs) WHERE term IS NOT NULL GROUP BY 1 ORDER BY n DESC, term LIMIT 5), "
        "l AS (SELECT (SELECT list(term ORDER BY n DESC, term) FROM c) AS t, (SELECT list(n ORDER BY n DESC, term) FROM c) AS n, (SELECT list(term ORDER BY term) FROM g) AS x) "
        f"""SELECT '{{"keyword_list_include": [' || {commas('list_sort(t)')} || '], "keyword_list_exclude": [' || {commas('x')} || '], "term_groups": [' || {group(1, 2, 'OR')} || ', ' || {group(3, 4, 'AND')} || ', ' || {group(5, 6, 'OR')} """
        f"""|| '], "policy": {{"type": "symantec_keyword_policy_like", "boolean_expression": "(' || {one} || ' NEAR/10 ' || {two} || ') OR (' || {one} || ' NEAR/10 ' || {three} || ') OR (' || {two} || ' NEAR/10 ' || {three} || ')", """
        f""""proximity": {{"mode": "NEAR", "distance": 10}}, "threshold": 2, "notes": [{notes}]}}, "debug": {{"top_terms": [' || array_to_string(list_transform(range(1, 7), lambda i: '{{"term": ' || chr(34) || t[i] || chr(34) || ', "n": ' || n[i] || '}}'), ', ') || ']}}}}' AS payload FROM l"""
    )
    # Phrases and files in full match form
    folded = rf"regexp_replace(translate(lower(coalesce(<<COLUMN>>, '')), '“”’', '\"\"'''), '[\x{{0640}}\x{{064B}}-\x{{065F}}\x{{0670}}\x{{06D6}}-\x{{06ED}}]', '', 'g')"
    form = compatible("translate(" + folded + ", 'أإآ', 'ااا')")
    key = lambda x: ws(form.replace("<<COLUMN>>", x))
    small = "(length(key) < 3 OR (len(k) = 1 AND length(k[1]) < 3))"
    garbage = "(len(k) >= 4 AND 2 * len(list_filter(k, lambda x: length(x) = 1)) >= len(k))"
    offered = f"p AS (SELECT phrase_id, topic_key, lower({ws('text')}) AS phrase FROM {phrase_row()} WHERE text IS NOT NULL), pk AS (SELECT *, {key('phrase')} AS key FROM p), pt AS (SELECT *, regexp_extract_all(key, '{TOKEN}') AS k FROM pk)"
    allowed = f"allowed AS (SELECT key, arg_min({ws('phrase')}, phrase_id) AS canonical FROM pt WHERE length({ws('phrase')}) > 0 AND NOT {garbage} AND length(key) >= 3 GROUP BY 1)"
    q["candidate_filter"] = (
        f"{STATS}, {offered} SELECT phrase_id, phrase, df_ratio FROM pt JOIN stats ON term = phrase WHERE NOT {garbage} AND NOT {small} AND df_ratio BETWEEN 0.001::DOUBLE AND 0.85::DOUBLE "
        r"AND NOT regexp_matches(phrase, '^[0-9\x{0660}-\x{0669}\x{06F0}-\x{06F9}]+$')"
    )
    q["whitelist_allowed"] = f"WITH {offered}, {allowed} SELECT key, canonical FROM allowed"
    q["whitelist_clean"] = (
        f"WITH {offered}, {allowed}, c AS (SELECT topic_key, unnest(candidates).phrase AS phrase, generate_subscripts(candidates, 1) - 1 AS pos FROM topics_local), ck AS (SELECT topic_key, pos, {key(ws('phrase'))} AS key FROM c), "
        f"ct AS (SELECT *, regexp_extract_all(key, '{TOKEN}') AS k FROM ck), banned AS (SELECT DISTINCT {key('g')} AS key FROM (SELECT unnest(generic_terms) AS g FROM analyze_runs) WHERE length({ws('g')}) > 0) "
        f"SELECT topic_key, CAST(pos AS INTEGER) AS pos, canonical FROM ct JOIN allowed USING (key) WHERE NOT {garbage} AND NOT {small} AND {key('canonical')} NOT IN (SELECT key FROM banned)"
    )
    files = f"SELECT doc_id, any_value(name) AS name, any_value(text) AS text FROM session_docs GROUP BY 1"
    sums = " + ".join(f"CAST({written(r.expression)} AS BIGINT)" for r in rules)
    q["test_policy_files"] = (
        f"WITH f AS ({files}), x AS (SELECT doc_id, coalesce(name, 'unknown') AS name, length({ws('text')}) > 0 AS readable, ' ' || array_to_string(regexp_extract_all({key('text')}, '{TOKEN}'), ' ') || ' ' AS m FROM f), "
        f"s AS (SELECT doc_id, name, readable, CASE WHEN readable THEN {sums} ELSE 0 END AS n_rules FROM x) SELECT doc_id, name, readable, n_rules > 0 AS matched_any, CAST(n_rules AS BIGINT) AS n_rules FROM s"
    )
    return q
