"""One consistent character form for text that looks the same (problem 4).

Method: each Arrow batch of texts is exploded into a relation of positioned code points ``(row, source position, code
point)`` held as flat arrays; that relation is joined with replicated decomposition and look-alike mappings (dense tables
indexed by code point, the vectorised form of a broadcast join), combining marks are ordered by their class and
recomposed (Hangul letters to syllables too), and the strings are rebuilt. The explosion lives inside a batch: no shuffle,
no re-aggregation by row. The look-alike mapping is made by rule: the Unicode confusables data that Spark's own ICU library
holds (``confusables``: the letters whose skeleton is one Latin letter), small capitals by their names, and a short list
for the Greek and Cyrillic alphabets, where the data also pair letters that only resemble each other.

What changes: presentation, full-width and font forms and ligatures are decomposed; invisible characters and Arabic
stretching strokes go; every blank except line breaks becomes a space; base letters take up their combining marks where
one composed letter exists; letters of another script or a neighbouring alphabet that stand in for Latin or Arabic ones
become those. What stays: quotes, dashes, superscripts, bullets, digits of any script, vowel signs, words truly written
in another script, single Greek symbols, case, and the number of blanks.

Defined results: null gives null and is no case; an empty text stays empty; marks that only change their order are put
in canonical order but are no case; any text length is processed whole.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_CODES = 0x110000
#: Compatibility tags of forms that look like their plain letter.
FORM_TAGS = frozenset({"<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>"})

# Look-alike letters and the letter each stands in for.
CYRILLIC = dict(zip("АВЕКМНОРСТХУЅІЈаеорсухѕіјһԁԛԝ", "ABEKMHOPCTXYSIJaeopcyxsijhdqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυχϲ", "ABEZHIKMNOPTYXovaipuxc", strict=True))
LATIN_LIKE = dict(zip("ɑɡոօս", "agnou", strict=True))
PERSIAN = dict(zip("کیہھە", "كيههه", strict=True))
#: Look-alikes that the common alphabet of their script lacks: a word of such letters is none of that script.
RARE = "ЅІЈѕіјһԁԛԝϲ"
TATWEEL = 0x640
#: Visible format characters (Arabic number signs and the like).
VISIBLE_FORMAT = frozenset([*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD])
#: Invisible characters that are not of category Cf.
INVISIBLE_OTHER = frozenset([0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0)])
LINE_BREAKS = frozenset([0x0A, 0x0D, 0x85, 0x2028, 0x2029])

_RARE = [ord(c) for c in RARE]
# Script bits of the token step. MIXED: a look-alike of a script whose own words may consist of such letters, so only next to Latin ones.
LETTER, LATIN, FOREIGN, ARABIC, PERSIAN_ONLY, GREEK_BIT, MIXED, PHONETIC = 1, 2, 4, 8, 16, 32, 64, 128
#: Scripts of which whole words of look-alikes are still words of that script.
OWN_WORDS = frozenset(["HEBREW", "CANADIAN", "ETHIOPIC", "NKO", "ORIYA", "MALAYALAM", "MYANMAR", "GEORGIAN", "BAMUM", "TIFINAGH", "MIAO"])
Alikes = tuple[tuple[int, int], ...]


@functools.lru_cache(maxsize=1)
def small_capitals() -> Alikes:
    """Small capitals, which phonetic writing has beside the common letters, by their names."""
    named = ((c, unicodedata.name(chr(c), "").rpartition("LATIN LETTER SMALL CAPITAL ")) for c in [*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0xA720, 0xA800)])
    return tuple((c, ord(to.lower())) for c, (_, found, to) in named if found and len(to) == 1)


def confusables(spark: SparkSession) -> Alikes:
    """``(letter, Latin letter)`` of all letters whose skeleton, by the Unicode confusables data, is one Latin letter.

    The data come with ICU, a library of Spark itself; it is asked once, for all letters in one text. Greek and Cyrillic
    letters of the common alphabets, common Latin and Arabic letters are left to the lists above. No answer of ICU is an
    error: without its pairs a result would lack cases and look whole.
    """
    letters = [c for c in [*range(0x250, 0x370), *range(0x460, 0x600), *range(0x700, 0x3400), *range(0xA000, 0xAC00), *range(0x10000, 0x1E000)] if unicodedata.category(chr(c))[0] == "L"]
    letters = [c for c in letters if not unicodedata.decomposition(chr(c)) and not unicodedata.name(chr(c), "ARABIC").startswith(("ARABIC", "GREEK"))]
    try:
        checker = getattr(spark._jvm, "com.ibm.icu.text.SpoofChecker$Builder")().build()
        skeletons = checker.getSkeleton("\n".join(map(chr, letters))).split("\n")
    except (TypeError, Py4JError) as e:
        raise RuntimeError("the Unicode confusables data cannot be read: ICU (com.ibm.icu, a library of Spark 4) has to answer in the driver's JVM") from e
    pairs = []
    for c, to in zip(letters, skeletons, strict=True):
        if len(to) == 1 and to.isascii() and to.isalpha():
            upper = to == "l" and unicodedata.category(chr(c)) == "Lu"  # the data pair I and l
            pairs.append((c, ord("I" if upper else to)))
    if not pairs:
        raise RuntimeError("the confusables data of ICU hold no letter that looks like a Latin one")
    return tuple(pairs)


def _form(ch: str) -> str:
    """``ch`` with its presentation forms undone, level by level."""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    ligature = tag == "<compat>" and 0xFB00 <= ord(ch) <= 0xFB4F
    if tag in FORM_TAGS or ligature:
        return "".join(_form(chr(int(x, 16))) for x in rest.split())
    return ch


@functools.lru_cache(maxsize=2)
def tables(alikes: Alikes = ()) -> dict[str, np.ndarray]:
    """The replicated mappings, built once per Python process from the Unicode database and the confusables given."""
    width = np.ones(N_CODES, np.int8)  # code points that one becomes: 0 dropped, 1 kept or replaced, more for ligatures
    offset = np.full(N_CODES, -1, np.int32)  # into target, -1: stays
    ccc = np.zeros(N_CODES, np.uint8)
    script = np.zeros(N_CODES, np.uint8)
    look = np.zeros(N_CODES, np.int32)
    target: list[int] = []

    def put(code: int, to: str) -> None:
        width[code], offset[code] = len(to), len(target)
        target.extend(map(ord, to))

    for code in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7B0, 0xD800), *range(0xF900, 0x20000), *range(0xE0000, 0xE0200)]:
        ch = chr(code)
        kind = unicodedata.category(ch)
        ccc[code] = min(unicodedata.combining(ch), 255)
        if kind[0] == "L" or kind[0] == "M":
            script[code] |= LETTER
        if code in LINE_BREAKS or kind == "Cn":
            continue
        if code == TATWEEL or code in INVISIBLE_OTHER or (kind == "Cf" and code not in VISIBLE_FORMAT):
            width[code], offset[code] = 0, 0
        elif (kind == "Zs" and code != 0x20) or code in (0x09, 0x0B, 0x0C, *range(0x1C, 0x20)):
            put(code, " ")
        elif kind == "Cc":
            width[code], offset[code] = 0, 0
        elif (to := _form(ch)) != ch:
            put(code, to)
        if kind[0] == "L":
            if code < 0x250 or 0x1E00 <= code < 0x1F00:
                script[code] |= LATIN
            elif 0x370 <= code < 0x530 or 0x1F00 <= code < 0x2000:
                script[code] |= FOREIGN | (GREEK_BIT if code < 0x400 or code >= 0x1F00 else 0)
            elif 0x620 <= code < 0x700:
                script[code] |= ARABIC
            elif 0x250 <= code < 0x2B0 or 0x1D00 <= code < 0x1DC0:
                script[code] |= PHONETIC
            elif (code < 0x750 or 0x780 <= code < 0x860 or 0x900 <= code < 0x3040 or code >= 0xA000) and not unicodedata.name(ch, "").startswith(("LATIN", "ARABIC", "HANGUL", "CJK", "MODIFIER")) and code >= 0x530:
                script[code] |= FOREIGN
    for a, b in (*small_capitals(), *alikes):
        if width[a] == 1 and offset[a] < 0:
            look[a] = b
            name = unicodedata.name(chr(a)).split()[0]
            script[a] = LETTER if name == "LATIN" else script[a] | (MIXED if name in OWN_WORDS else 0)
    for mapping in (CYRILLIC, GREEK, LATIN_LIKE, PERSIAN):
        for a, b in mapping.items():
            look[ord(a)] = ord(b)
    for ch in "پچژگٹڈڑںے":
        script[ord(ch)] |= PERSIAN_ONLY
    for ch in LATIN_LIKE:
        script[ord(ch)] = LETTER
    return {"width": width, "offset": offset, "ccc": ccc, "script": script, "look": look, "target": np.array(target, np.int32)}


@functools.lru_cache(maxsize=1)
def _compositions() -> dict[tuple[str, str], str]:
    pairs = {}
    for code in [*range(0x3400), *range(0xF900, 0xFB50), *range(0x11000, 0x12000)]:
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            a, b = (chr(int(x, 16)) for x in parts)
            if unicodedata.normalize("NFC", a + b) == chr(code):  # not one of the excluded compositions
                pairs[a, b] = chr(code)
    return pairs


@functools.lru_cache(maxsize=65536)
def recompose(run: str) -> tuple[str, bool]:
    """A base with its marks, marks ordered by class and taken up by the base where one composed letter exists; whether more than their order changed."""
    flat = unicodedata.normalize("NFD", run)
    ordered: list[str] = []
    marks: list[str] = []
    for ch in flat:
        if unicodedata.combining(ch):
            marks.append(ch)
        else:
            ordered += [*sorted(marks, key=unicodedata.combining), ch]
            marks = []
    ordered += sorted(marks, key=unicodedata.combining)
    out: list[str] = []
    base, last = -1, 0
    for ch in ordered:
        ccc = unicodedata.combining(ch)
        if base >= 0 and (last < ccc or last == 0 and base == len(out) - 1) and (made := _compositions().get((out[base], ch))):
            out[base] = made
            continue
        if ccc == 0:
            base, last = len(out), 0
        else:
            last = ccc
        out.append(ch)
    done = "".join(out)
    first = next((i for i, ch in enumerate(run) if unicodedata.combining(ch)), len(run))
    return done, done != run[:first] + "".join(sorted(run[first:], key=unicodedata.combining))


class Exploded:
    """A batch of texts as positioned code points. ``row`` and ``source`` (offset in the joined batch) follow every step."""

    def __init__(self, texts: list[str], alikes: Alikes = ()):
        self.n, self.alikes = len(texts), alikes
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int64), lengths)
        self.source = np.arange(len(self.code), dtype=np.int64)
        self.changed = np.zeros(self.n, bool)

    def mapped(self) -> None:
        """Join with the decomposition mapping: forms undone, invisible characters dropped, blanks made spaces."""
        t = tables(self.alikes)
        hit = t["offset"][self.code] >= 0
        if not hit.any():
            return
        self.changed[self.row[hit]] = True
        width = t["width"][self.code].astype(np.int64)
        within = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        hit, code = np.repeat(hit, width), np.repeat(self.code, width)
        self.row, self.source = np.repeat(self.row, width), np.repeat(self.source, width)
        code[hit] = t["target"][t["offset"][code[hit]] + within[hit]]
        self.code = code

    def composed(self) -> None:
        """Order the marks of each base by class and recompose."""
        mark = tables(self.alikes)["ccc"][self.code] > 0
        if not mark.any():
            return
        at = np.flatnonzero(mark)
        first = at[np.concatenate([[True], np.diff(at) > 1])]
        last = at[np.concatenate([np.diff(at) > 1, [True]])]
        with_base = np.where((first > 0) & (self.row[first - 1] == self.row[first]), first - 1, first)
        keep = np.ones(len(self.code), bool)
        code = self.code.copy()
        more_at: list[int] = []  # what a run has beyond its old length, where a composed letter has no composed form of its own
        more: list[int] = []
        for a, b in zip(with_base.tolist(), last.tolist(), strict=True):
            for x, y in self._rows(a, b + 1):  # a run of marks at the start of a text belongs to no base of the text before
                run = self.code[x:y].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                to, taken = recompose(run)
                if to == run:
                    continue
                if taken:
                    self.changed[self.row[x]] = True
                made = np.frombuffer(to.encode("utf-32-le"), "<u4").astype(np.int32)
                code[x : min(x + len(made), y)] = made[: y - x]
                keep[x + len(made) : y] = False
                more_at += [y] * (len(made) - (y - x))
                more += made[y - x :].tolist()
        row, source = self.row, self.source
        if more:
            at = np.array(more_at)
            code, keep, row, source = np.insert(code, at, more), np.insert(keep, at, True), np.insert(row, at, row[at - 1]), np.insert(source, at, source[at - 1])
        self.code, self.row, self.source = code[keep], row[keep], source[keep]

    def joined(self) -> None:
        """Hangul letters to syllables: a first and a middle letter, then a last one."""
        for first, following in (((0x1100, 0x1113), (0x1161, 0x1176)), ((0xAC00, 0xD7A4), (0x11A8, 0x11C3))):
            second = (self.code >= following[0]) & (self.code < following[1])
            if not second.any():
                continue
            at = np.flatnonzero(second[1:] & (self.code[:-1] >= first[0]) & (self.code[:-1] < first[1]) & (self.row[1:] == self.row[:-1]))
            if first[0] == 0xAC00:
                at = at[(self.code[at] - 0xAC00) % 28 == 0]
                made = self.code[at] + self.code[at + 1] - 0x11A7
            else:
                made = 0xAC00 + ((self.code[at] - 0x1100) * 21 + self.code[at + 1] - 0x1161) * 28
            self.code = self.code.copy()
            self.code[at] = made
            self.changed[self.row[at]] = True
            keep = np.ones(len(self.code), bool)
            keep[at + 1] = False
            self.code, self.row, self.source = self.code[keep], self.row[keep], self.source[keep]

    def _rows(self, a: int, b: int) -> list[tuple[int, int]]:
        rows = self.row[a:b]
        if rows[0] == rows[-1]:
            return [(a, b)]
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(rows))).tolist(), b]
        return list(zip(cuts, cuts[1:], strict=False))

    def unmasked(self) -> None:
        """Replace letters that stand in for Latin or Arabic ones, token by token (a token is a run of letters and marks)."""
        t = tables(self.alikes)
        look_all = t["look"][self.code] > 0
        if not look_all.any():
            return
        chosen = np.zeros(self.n, bool)
        chosen[self.row[look_all]] = True
        at = np.flatnonzero(chosen[self.row])
        code, row = self.code[at], self.row[at]
        bits, look = t["script"][code], look_all[at]
        letter = (bits & LETTER) > 0
        start = letter & np.concatenate([[True], ~letter[:-1] | (row[1:] != row[:-1])])
        token = np.cumsum(start) - 1
        n = int(start.sum())
        if not n:
            return

        def has(which: np.ndarray) -> np.ndarray:
            return np.bincount(token[letter & which], minlength=n) > 0

        persian = np.isin(code, [ord(c) for c in PERSIAN])
        latin, arabic = has((bits & LATIN) > 0), has((bits & ARABIC) > 0)
        truly = has(((bits & FOREIGN) > 0) & ~look)
        persian_only = has((bits & PERSIAN_ONLY) > 0)
        single_greek = (np.bincount(token[letter], minlength=n) == 1) & has((bits & GREEK_BIT) > 0)
        # neighbouring tokens of another script are one phrase of it as soon as one of them is truly of that script
        token_row = row[start]
        other = has((bits & FOREIGN) > 0) & ~latin
        phrase = np.cumsum(np.concatenate([[True], (token_row[1:] != token_row[:-1]) | ~other[1:] | ~other[:-1]])) - 1
        in_phrase = np.bincount(phrase, truly, minlength=n)[phrase] > 0
        rare = has(np.isin(code, _RARE)) & (np.bincount(token[letter], minlength=n) > 1)
        fold = latin | (~truly & (~in_phrase | rare) & ~single_greek)
        fold_arabic = arabic & ~persian_only
        phonetic = has(((bits & PHONETIC) > 0) & ~look)  # truly phonetic writing keeps its small capitals
        here = np.where((bits & MIXED) > 0, latin[token], np.where(code < 0x370, (fold & ~phonetic)[token], fold[token]))
        replaced = look & letter & np.where(persian, fold_arabic[token], here)
        if replaced.any():
            self.code[at[replaced]] = t["look"][code[replaced]]
            self.changed[row[replaced]] = True

    def rebuilt(self) -> list[str]:
        whole = self.code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(np.bincount(self.row, minlength=self.n)).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def sources(self) -> list[np.ndarray]:
        """For each row, the position in the original text of each rebuilt character."""
        ends = np.cumsum(np.bincount(self.row, minlength=self.n)).tolist()
        local = self.source - self.starts[self.row]
        return [local[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def consistent_batch(texts: list[str], alikes: Alikes = ()) -> Exploded:
    x = Exploded(texts, alikes)
    x.mapped()
    x.composed()
    x.joined()
    x.unmasked()
    return x


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])
#: Code points exploded at a time; bounds the arrays when single texts are very long.
BATCH_CODES = 4_000_000


def pieces(texts: list[str]):
    """Bounds of runs of texts of at most ``BATCH_CODES`` code points, single longer ones by themselves."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CODES:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def _consistent(column: pd.Series, alikes: Alikes) -> pd.DataFrame:
    null = column.isna().to_numpy()
    texts = ["" if z else s for s, z in zip(column, null, strict=True)]
    out: list[str | None] = []
    changed: list[bool] = []
    for a, b in pieces(texts):
        x = consistent_batch(texts[a:b], alikes)
        out += x.rebuilt()
        changed += x.changed.tolist()
    return pd.DataFrame({"text": [None if z else s for s, z in zip(out, null, strict=True)], "changed": changed})


def consistent(column: Column | str, alikes: Alikes = ()) -> Column:
    """Struct ``(text, changed)``: the consistent form and whether the row is a case."""

    @F.pandas_udf(_RESULT)
    def made(texts: pd.Series) -> pd.DataFrame:
        return _consistent(texts, alikes)

    return made(column)


def phrase_key(text: Column) -> Column:
    """The key of a phrase whose text is in consistent form: lower-cased, blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f]+", " "))


#: A text of characters only that are never part of a case, the commonest ranges first (a class is tested in order). One
#: greedy run over the text: the scan drops all such rows before any leaves the JVM.
IN_FORM = (
    r"\A[\x20-\x7e\n\r\x{627}-\x{63a}\x{641}-\x{652}\x{61d}-\x{626}\x{606}-\x{61b}\x{660}-\x{6a8}\xa1-\xac\xae-\x{24f}"
    r"\x{2010}-\x{2029}\x{2030}-\x{205e}\x{2070}-\x{20c0}\x{2190}-\x{2bff}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30a0}-\x{30fe}\x{3400}-\x{9fff}\x{ac00}-\x{d7a3}\x85]*\z"
)
#: Vowel signs in a row, whose order may have to change though the row is no case.
UNORDERED = r"[\x{64b}-\x{652}\x{670}]{2}"


def suspect(text: Column) -> Column:
    """Whether a text may be a case (null for null)."""
    return ~text.rlike(IN_FORM)


def with_consistent_form(df: DataFrame, text: str, into: str = "consistent", flag: str = "changed") -> DataFrame:
    """``df`` with the consistent form of column ``text`` in ``into`` and the case flag in ``flag`` (existing columns of these names are replaced)."""
    made = "__consistent"
    while made in df.columns:
        made += "_"
    kept = [c for c in df.columns if c not in (into, flag)]
    given = F.col(f"`{text}`")
    # rows without any suspect character are in consistent form already: only the others' texts leave the JVM
    inside = df.select("*", consistent(F.when(suspect(given) | given.rlike(UNORDERED), given), confusables(df.sparkSession)).alias(made))
    return inside.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(made)["text"], given).alias(into), F.coalesce(F.col(made)["changed"], F.lit(False)).alias(flag))


def inconsistent_rows(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``row_id`` of every row whose text is a case, once each."""
    rows = df.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), F.col(f"`{text}`").alias("text")).where(suspect(F.col("text")))
    return rows.where(consistent("text", confusables(df.sparkSession))["changed"]).select("row_id").distinct()
