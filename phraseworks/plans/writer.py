"""Who names topics and writes rules: a deterministic writer by default, or any callable that answers prompts with JSON.

Writers see a few rows (at most 20 topics of 40 phrases) on the driver, never executors' data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import Protocol

from phraseworks.functions.text import safe_title, ws


class PolicyWriter(Protocol):
    def refine_topics(self, payload: Mapping) -> Mapping:
        """``generic_terms`` and ``topics [{old_name, new_name, phrases [{p}]}]``; may be empty."""

    def write_rules(self, payload: Mapping) -> Mapping:
        """``rules [{rule_title, groups, why}]`` in the order of the topics, ``optional_regex_suggestions``."""

    def refine_stopwords(self, payload: Mapping) -> Mapping:
        """``stopwords``, ``maybe_stopwords``, ``keep_terms``, ``rationale``."""


class DeterministicWriter:
    """Keeps topic names and turns each topic's proposed groups into its rule."""

    def refine_topics(self, payload: Mapping) -> Mapping:
        return {}

    def write_rules(self, payload: Mapping) -> Mapping:
        return {"rules": [{"rule_title": x["topic_name"], "groups": x["proposed_groups"], "why": []} for x in payload["topics"]], "optional_regex_suggestions": []}

    def refine_stopwords(self, payload: Mapping) -> Mapping:
        certain = [x["term"] for x in payload["candidate_terms"] if x["df_ratio"] >= 0.85]
        return {"stopwords": certain, "maybe_stopwords": [], "keep_terms": [], "rationale": "df_ratio of at least 0.85"}


class CallableWriter:
    """Sends each payload as JSON to ``answer(task, payload)`` and reads JSON from its text."""

    def __init__(self, answer: Callable[[str, str], str]):
        self.answer = answer

    def _ask(self, task: str, payload: Mapping) -> Mapping:
        return read_json(self.answer(task, json.dumps(payload, ensure_ascii=False)))

    def refine_topics(self, payload: Mapping) -> Mapping:
        return self._ask("refine_topics", payload)

    def write_rules(self, payload: Mapping) -> Mapping:
        return self._ask("write_rules", payload)

    def refine_stopwords(self, payload: Mapping) -> Mapping:
        return self._ask("refine_stopwords", payload)


class JsonFixtureWriter(CallableWriter):
    """Answers from ``<task>.json`` files of a folder, for offline use and tests."""

    def __init__(self, folder: str):
        super().__init__(lambda task, _: (Path(folder) / f"{task}.json").read_text(encoding="utf-8"))


def read_json(text: str) -> dict:
    """A JSON object, or the outermost braces of a text around one."""
    body = text.strip()
    if not body:
        raise ValueError("empty answer")
    try:
        return json.loads(body)
    except ValueError:
        found = re.search(r"\{.*\}", body, re.S)
        if not found:
            raise ValueError(f"no JSON object in the answer: {body[:200]}") from None
        return json.loads(found[0])


def topic_refinement(answer: Mapping) -> tuple[list[str], dict[str, str], dict[str, list[str]]]:
    """Generic terms, new names by old name, phrases by old name; blanks dropped."""
    generic = [x for x in map(ws, answer.get("generic_terms", [])) if x]
    names, phrases = {}, {}
    for topic in answer.get("topics", []):
        old = ws(topic.get("old_name"))
        if old:
            names[old] = safe_title(ws(topic.get("new_name")))
            if own := [p for x in topic.get("phrases", []) if (p := ws(x.get("p")))]:
                phrases[old] = own
    return generic, names, phrases


def stopword_payload(terms: Sequence[Mapping], boilerplate: Sequence[str], hint: str = "") -> dict:
    """At most 120 terms (cut before blanks are dropped), df_ratio to 3 and score to 6 places."""
    listed = [{"term": x, "df_ratio": round(float(c.get("df_ratio") or 0), 3), "score": round(float(c.get("score") or 0), 6), "kind": c.get("kind", "general")} for c in terms[:120] if (x := (c.get("term") or "").strip())]
    return {"corpus_hint": hint, "boilerplate_examples": [*boilerplate[:12]], "candidate_terms": listed}
