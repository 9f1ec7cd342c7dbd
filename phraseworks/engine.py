"""The engine: analyze documents, generate a policy, test a policy."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseworks.functions.text import safe_title, ws
from phraseworks.operators import cooccurrence, kmeans, matching, selection, terms, topics, vectors, whitelist
from phraseworks.plans import render
from phraseworks.plans.rules import Rule
from phraseworks.plans.writer import DeterministicWriter, PolicyWriter, topic_refinement
from phraseworks.session import cut_lineage
from phraseworks.sources.store import SessionStore

HARD_CAP, EXTRA_CAP = 20, 8


class NoReadableText(ValueError):
    pass


class NoRules(ValueError):
    pass


class WriterRequired(ValueError):
    pass


@dataclass(frozen=True)
class Analysis:
    """What ``analyze`` returns: small values, and tables of the session."""

    session_id: str
    n_docs: int
    topics_preview: list[dict]
    top_terms: list[dict]
    generic_terms: list[str]
    topics_preview_md: str
    top_terms_md: str


class Engine:
    def __init__(self, spark: SparkSession, folder: str, writer: PolicyWriter | None = None):
        self.spark, self.store, self.writer = spark, SessionStore(spark, folder), writer or DeterministicWriter()

    def _require(self, writer_required: bool) -> None:
        """Whoever asks for a language model gets an error where only the deterministic writer is at hand."""
        if writer_required and isinstance(self.writer, DeterministicWriter):
            raise WriterRequired("a policy writer is required, but none was given to the engine")

    def health(self) -> dict:
        return {"ok": True}

    def analyze(self, docs: DataFrame, max_topics: int = 8, low: float = 0.10, high: float = 0.85, corpus_hint: str = "", labels: DataFrame | None = None, writer_required: bool = False) -> Analysis:
        """Statistics, topics and previews of ``docs (doc_id, text)``, kept as a session with the names and sizes of files.

        ``docs`` may have ``name`` and ``n_bytes``. ``labels (doc_id, label int)`` replaces clustering where given.
        """
        self._require(writer_required)
        max_topics = max(2, min(max_topics, 20))
        name = F.coalesce("name", F.lit("unknown")) if "name" in docs.columns else F.lit("unknown")
        n_bytes = F.col("n_bytes").cast("bigint") if "n_bytes" in docs.columns else F.octet_length("text").cast("bigint")
        readable = cut_lineage(terms.readable(docs.select("doc_id", "text", name.alias("name"), n_bytes.alias("n_bytes"))))
        n_docs = readable.count()
        if not n_docs:
            raise NoReadableText("no readable text extracted from the documents")
        counts = cut_lineage(terms.doc_term_counts(readable))
        stats = whole = cut_lineage(terms.term_stats(counts, n_docs))
        if not readable.where(F.length("text") > terms.MAX_TOKENS).isEmpty():  # only statistics are capped, vectors are not
            stats = cut_lineage(terms.term_stats(terms.doc_term_counts(readable, cap=terms.MAX_TOKENS), n_docs))
        if n_docs == 1 and labels is None:
            found = topics.single_topic(stats.select(F.lit(0).alias("label"), "term", "tf"))
            labelled, names = readable.select("doc_id", F.lit(0).alias("label")), {0: "Single Document Topic"}
        else:
            vocab = cut_lineage(vectors.vocabulary(whole))
            weights = vectors.tfidf(counts, vocab, n_docs)
            labelled = cut_lineage(labels) if labels is not None else kmeans.kmeans_labels(*vectors.document_counts(readable, vocab, n_docs), vectors.topic_count(n_docs, max_topics))
            found, names = topics.candidates(topics.centroid_weights(weights, labelled), stats, low, high), {}
        sizes = topics.topic_sizes(labelled, max_topics).collect()  # at most 20 rows
        found = cut_lineage(found)
        listed: dict[int, list] = {}
        for r in found.collect():  # at most 20 topics of 40 phrases
            listed.setdefault(r["label"], []).append((r["rank"], r["phrase"], r["df_ratio"]))
        local = [{"label": r["label"], "topic_name": names.get(r["label"], f"Topic {int(r['label']) + 1}"), "doc_count": r["n"], "candidates": [{"phrase": p, "df_ratio": x} for _, p, x in sorted(listed.get(r["label"], []))]} for r in sizes]
        top = sorted(terms.top_terms(stats, readable, 60).collect(), key=lambda r: r["rank"])
        asked = {
            "department_hint": corpus_hint,
            "top_terms": [{"term": r["term"], "df": r["df"], "df_pct": int(r["df_ratio"] * 100)} for r in top],
            "topics": [{"old_name": x["topic_name"], "docs": x["doc_count"], "candidates": [{"p": c["phrase"], "df_pct": int(c["df_ratio"] * 100)} for c in x["candidates"][:25]]} for x in local],
        }
        generic, renamed, picked = topic_refinement(self.writer.refine_topics(asked))
        ratios = self._ratios(stats, [p for ps in picked.values() for p in ps] + [c["phrase"] for x in local for c in x["candidates"]])
        shown = []
        for x in local:
            chosen = picked.get(x["topic_name"]) or [c["phrase"] for c in x["candidates"][:12]]
            shown.append({"name": renamed.get(x["topic_name"], x["topic_name"]), "doc_count": x["doc_count"], "phrases": [(p, ratios.get(p, 0.0)) for p in chosen]})
        rows = [f"{r['term']} | {r['tf']} | {r['df']} | {round(r['df_ratio'] * 100)}%" for r in top[:45]]
        key = self.store.put(
            {"docs": readable, "stats": stats, "labels": labelled},
            {"n_docs": n_docs, "topics_local": local, "generic_terms": generic, "topic_names": renamed, "topic_phrases": picked, "corpus_hint": corpus_hint},
        )
        return Analysis(
            key, n_docs, [{**x, "phrases": [{"text": p, "df_ratio": r} for p, r in x["phrases"][:18]]} for x in shown],
            [{k: r[k] for k in ("term", "tf", "df", "df_ratio")} for r in top], generic, render.topics_markdown(shown), "\n".join(["Term | TF | DF | DF%", "---|---:|---:|---:", *rows]),
        )

    def _ratios(self, stats: DataFrame, phrases: list[str]) -> dict[str, float]:
        if not phrases:
            return {}
        wanted = self.spark.createDataFrame([(p,) for p in sorted(set(phrases))], "term string")
        return {r["term"]: r["df_ratio"] for r in stats.join(F.broadcast(wanted), "term").select("term", "df_ratio").collect()}

    def _proposals(self, session: str, values: Mapping, topic_list: list[dict], low: float, high: float) -> list[dict]:
        """Per topic its candidates and proposed groups."""
        docs, stats, labels = (self.store.get(session, n) for n in ("docs", "stats", "labels"))
        rows = []
        for x in topic_list:
            chosen = values["topic_phrases"].get(x["topic_name"]) or [c["phrase"] for c in x["candidates"][:30]]
            rows += [(int(x["label"]), i, ws(p)) for i, p in enumerate(chosen) if ws(p)]
        if not rows:
            return [{**x, "phrases": [], "groups": []} for x in topic_list]
        given = self.spark.createDataFrame(rows, "label int, pos int, phrase string")
        fit = sorted(whitelist.candidate_filter(given, stats, low, high).collect(), key=lambda r: (r["label"], r["pos"]))
        own: dict[int, list[str]] = {}
        for r in fit:
            own.setdefault(r["label"], []).append(r["phrase"])
        defaults = {r["label"]: r["groups"] for r in cooccurrence.default_groups(self.spark.createDataFrame([(r["label"], r["pos"], r["phrase"]) for r in fit], "label int, pos int, phrase string")).collect()} if fit else {}
        dense = {int(x["label"]) for x in topic_list if x["doc_count"] >= 2 and len(own.get(int(x["label"]), [])) >= 8}
        proposed: dict[int, dict[int, list]] = {}
        if dense:
            phrases = self.spark.createDataFrame([(label, i, p) for label in dense for i, p in enumerate(own[label][:40])], "label int, idx int, phrase string")
            sizes = self.spark.createDataFrame([(int(x["label"]), int(x["doc_count"])) for x in topic_list], "label int, n bigint")
            present = cut_lineage(cooccurrence.presence(docs, labels.select("doc_id", F.col("label").cast("int").alias("label")), phrases))
            df = cut_lineage(cooccurrence.phrase_df(present, phrases))
            for r in cooccurrence.groups(phrases, df, cut_lineage(cooccurrence.pair_df(present)), sizes, values["generic_terms"]).collect():
                proposed.setdefault(r["label"], {}).setdefault(r["group"], []).append((r["rank"], r["phrase"]))
        made = []
        for x in topic_list:
            mine, found = own.get(int(x["label"]), []), proposed.get(int(x["label"]))
            groups = [[p for _, p in sorted(g)] for _, g in sorted(found.items())] if found else defaults.get(int(x["label"]), [[], []])
            made.append({**x, "phrases": mine, "groups": groups})
        return made

    def generate_policy(self, session: str, title: str = "DLP Keyword Policy (Proposed)", corpus_hint: str = "", max_rules: int = 5, low: float = 0.10, high: float = 0.85, include_patterns: bool = True, max_patterns: int = 8, writer_required: bool = False) -> str:
        """The policy as markdown: one rule a topic, cleaned against what was offered, chosen by coverage."""
        values = self.store.values(session)
        self._require(writer_required)
        base = max(1, min(int(max_rules), HARD_CAP))
        listed = values["topics_local"][: base + min(EXTRA_CAP, HARD_CAP - base)]
        proposals = self._proposals(session, values, listed, low, high)
        stats, docs = self.store.get(session, "stats"), self.store.get(session, "docs")
        ratios = self._ratios(stats, [p for x in proposals for p in [*x["phrases"], *whitelist.flattened(x["groups"])]])
        answer = self.writer.write_rules({
            "policy_title": title, "department_hint": corpus_hint or values["corpus_hint"], "generic_terms_to_avoid": values["generic_terms"][:60],
            "topics": [{"topic_name": safe_title(values["topic_names"].get(x["topic_name"], x["topic_name"])), "doc_count": x["doc_count"], "candidate_phrases": [{"p": p, "df_pct": round(ratios.get(p, 0.0) * 100)} for p in x["phrases"][:25]], "proposed_groups": x["groups"]} for x in proposals],
        })
        rules = []
        for i, (rule, x) in enumerate(zip(answer.get("rules") or [], proposals, strict=False), 1):
            offered = whitelist.allowed_map([*x["phrases"], *whitelist.flattened(x["groups"])])
            groups = whitelist.clean_groups(rule.get("groups"), x["groups"], offered, values["generic_terms"])
            if groups:
                rules.append({"title": safe_title(str(rule.get("rule_title") or f"Rule {i}")), "groups": groups, "expr": render.all_of(groups), "why": rule.get("why", [])})
        if not rules:
            raise NoRules("no rule is left after cleaning")
        truths = matching.rule_truths(docs, [Rule(r["title"], r["expr"]) for r in rules])
        histogram = {r["mask"]: r["n"] for r in selection.mask_histogram(truths).collect()}
        costs = [selection.penalty(r["groups"], ratios) for r in rules]
        chosen = selection.select_rules(histogram, costs, values["n_docs"], base, same=[(r["title"], r["expr"]) for r in rules])
        patterns = answer.get("optional_regex_suggestions") or [] if include_patterns else []
        return render.policy_markdown(title, [rules[i] for i in chosen], patterns, max_patterns)

    def test_policy(self, policy_text: str, docs: DataFrame) -> DataFrame:
        return matching.test_policy(docs, policy_text)
