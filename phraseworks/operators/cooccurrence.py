"""Co-occurrence of phrases in the documents of their topic, and the phrase groups made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phraseworks.functions import text as t
from phraseworks.operators.matching import phrase_present

ANCHORS, GROUP, CONTROL_SCAN = 3, 6, 20
MIN_DOCS, MIN_PAIR = 2, 2


def presence(docs: DataFrame, labels: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(label, doc_id, idx)`` where a topic's phrase is in a topic's document; phrases ``(label, idx, phrase)``.

    Topics are few and have some tens of phrases each, so the distinct phrases are literals of one projection: each is
    sought as a plain substring, then between word boundaries, by a pattern compiled once. Texts stay where they are;
    what is joined to the labels is a document's id and the numbers of the phrases it holds.
    """
    listed = [(r["label"], r["idx"], t.ws(r["phrase"]).lower()) for r in phrases.select("label", "idx", "phrase").collect()]
    distinct = sorted({p for _, _, p in listed if p})
    if not distinct:
        return labels.select("label", "doc_id").where("false").select("label", "doc_id", F.lit(0).alias("idx"))
    number = {p: i for i, p in enumerate(distinct)}
    texts = docs.select("doc_id", F.explode(F.array(t.norm_lc(F.col("text")))).alias("lc"))
    flags = [F.when(F.contains("lc", F.lit(p)) & phrase_present(F.col("lc"), p), F.lit(i)) for i, p in enumerate(distinct)]
    found = texts.select("doc_id", F.explode(F.array_compact(F.array(*flags))).alias("phrase"))
    kind = phrases.schema["idx"].dataType.simpleString()
    wanted = phrases.sparkSession.createDataFrame([(label, idx, number[p]) for label, idx, p in listed if p], f"label {phrases.schema['label'].dataType.simpleString()}, idx {kind}, phrase int")
    return found.join(labels, "doc_id").join(wanted, ["label", "phrase"]).select("label", "doc_id", "idx")


def phrase_df(present: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(label, idx, df)``, zero where no document has the phrase."""
    counted = present.groupBy("label", "idx").agg(F.count("*").alias("df"))
    return phrases.select("label", "idx").join(counted, ["label", "idx"], "left").select("label", "idx", F.coalesce("df", F.lit(0)).cast("bigint").alias("df"))


def pair_df(present: DataFrame) -> DataFrame:
    """``(label, i, j, n)``, i < j: documents with both. A document's indices are gathered once; pairs are made inside its row."""
    rows = present.groupBy("label", "doc_id").agg(F.array_sort(F.collect_list("idx")).alias("ids"))
    firsts = rows.select("label", "ids", F.posexplode("ids").alias("at", "i"))
    pairs = firsts.select("label", "i", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("j"))
    return pairs.groupBy("label", "i", "j").agg(F.count("*").alias("n"))


def lift(df: DataFrame, pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(label, i, j, n, lift)``: p(ab) / (p(a) p(b)), 0 where a marginal is."""
    a, b = df.select("label", F.col("idx").alias("i"), F.col("df").alias("da")), df.select("label", F.col("idx").alias("j"), F.col("df").alias("db"))
    n = F.greatest("docs", F.lit(1))
    joined = pairs.join(a, ["label", "i"]).join(b, ["label", "j"]).join(sizes.select("label", F.col("n").alias("docs")), "label")
    value = F.when((F.col("da") > 0) & (F.col("db") > 0), (F.col("n") / n) / ((F.col("da") / n) * (F.col("db") / n))).otherwise(0.0)
    return joined.select("label", "i", "j", "n", value.alias("lift"))


def _eligible(phrases: DataFrame, df: DataFrame, generic: list[str]) -> DataFrame:
    listed = sorted({t.ws(g).lower() for g in generic if t.ws(g)})
    key = t.norm_lc(F.col("phrase"))
    rows = phrases.join(df, ["label", "idx"]).where((F.length(key) > 0) & (F.col("df") >= MIN_DOCS))
    return rows.where(~key.isin(listed)) if listed else rows


def anchors(phrases: DataFrame, df: DataFrame, sizes: DataFrame, generic: list[str] = ()) -> DataFrame:
    """``(label, rank, idx, phrase, df)``: phrases in the middle of the range, r (1 - r), then df, then the later one."""
    r = F.col("df") / F.greatest("n", F.lit(1))
    fit = _eligible(phrases, df, generic).where(~t.is_digits(t.norm_lc(F.col("phrase")))).join(sizes.select("label", "n"), "label").withColumn("midness", r * (1.0 - r))
    w = Window.partitionBy("label").orderBy(F.desc("midness"), F.desc("df"), F.desc("idx"))
    return fit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= ANCHORS).select("label", "rank", "idx", "phrase", "df")


def context(phrases: DataFrame, df: DataFrame, pairs: DataFrame, sizes: DataFrame, anchored: DataFrame, generic: list[str] = ()) -> DataFrame:
    """``(label, rank, idx, phrase, df, lift, pair_docs)``: other phrases by their best lift to an anchor.

    Only pairs with an anchor are scored. Of equal lifts the first anchor's pair count stands.
    """
    a = anchored.select("label", F.col("rank").alias("anchor"), F.col("idx").alias("a_idx"), F.col("df").alias("a_df"))
    both = pairs.where(F.col("n") >= MIN_PAIR).select("label", F.explode(F.array(F.struct(F.col("i").alias("a_idx"), F.col("j").alias("idx")), F.struct(F.col("j").alias("a_idx"), F.col("i").alias("idx")))).alias("p"), F.col("n").alias("pair_docs")).select("label", "p.a_idx", "p.idx", "pair_docs")
    others = _eligible(phrases, df, generic).join(anchored.select("label", "idx"), ["label", "idx"], "left_anti")
    scored = both.join(a, ["label", "a_idx"]).join(others, ["label", "idx"]).join(sizes.select("label", F.col("n").alias("docs")), "label")
    n = F.greatest("docs", F.lit(1))
    scored = scored.withColumn("lift", (F.col("pair_docs") / n) / ((F.col("a_df") / n) * (F.col("df") / n)))
    best = scored.groupBy("label", "idx", "phrase", "df").agg(F.max(F.struct("lift", -F.col("anchor"), "pair_docs")).alias("b")).where("b.lift > 0")
    w = Window.partitionBy("label").orderBy(F.desc("b.lift"), F.desc("b.pair_docs"), F.desc("df"), F.desc("idx"))
    return best.withColumn("rank", F.row_number().over(w)).select("label", "rank", "idx", "phrase", "df", F.col("b.lift").alias("lift"), F.col("b.pair_docs").alias("pair_docs"))


def groups(phrases: DataFrame, df: DataFrame, pairs: DataFrame, sizes: DataFrame, generic: list[str] = (), max_groups: int = 4) -> DataFrame:
    """``(label, group, rank, phrase)``: anchors, context, and controls of a higher share; without candidates the first phrases."""
    anchored = anchors(phrases, df, sizes, generic)
    ranked = context(phrases, df, pairs, sizes, anchored, generic)
    near = ranked.where(F.col("rank") <= GROUP)
    share = F.col("df") / F.greatest("n", F.lit(1))
    further = ranked.where(F.col("rank").between(GROUP + 1, GROUP + CONTROL_SCAN)).join(sizes.select("label", "n"), "label").where(share.between(0.35, 0.85))
    control = further.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("rank"))).where(F.col("rank") <= GROUP)
    bare = phrases.join(anchored.select("label").distinct(), "label", "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("idx"))).where(F.col("rank") <= GROUP)
    parts = [x.select("label", F.lit(i).alias("part"), "rank", "phrase") for i, x in enumerate((anchored, near, control), 1)] + [bare.select("label", F.lit(1).alias("part"), "rank", "phrase")]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    # groups are numbered without gaps: a topic may lack context
    w = Window.partitionBy("label").orderBy("part")
    return every.withColumn("group", F.dense_rank().over(w)).where(F.col("group") <= max_groups).select("label", "group", "rank", "phrase")


def default_groups(phrases: DataFrame) -> DataFrame:
    """``(label, groups)``: groups where co-occurrence says nothing, the first and the second six phrases of ``(label, pos, phrase)``.

    Where there are no second six, the first stand twice. Phrases beyond the twelfth are cut before they are gathered.
    """
    w = Window.partitionBy("label").orderBy("pos")
    first = phrases.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 2 * GROUP)
    own = first.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "phrase"))), lambda x: x["phrase"]).alias("ps"))
    one, two = F.slice("ps", 1, GROUP), F.slice("ps", GROUP + 1, GROUP)
    return own.select("label", F.array(one, F.when(F.size(two) > 0, two).otherwise(one)).alias("groups"))
