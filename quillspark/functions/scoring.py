"""Scorers: what answers the questions about a candidate.

``RuleScorer`` is a deterministic set of rules in Column expressions. ``ModelScorer`` wraps a model that a loader
builds once in each Python worker; prompts go through Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import find_urls, make_prompt, question

LICENSES = r"(Apache License|MIT License|GNU General Public License|CC BY(?:-[A-Z]+)*)"
VERSION = r"(?:[Vv]ersion|v\.?)\s*([0-9]+(?:\.[0-9]+)*)"
OWNING = r"\b(?:[Ww]e|[Oo]ur|[Rr]eleased|[Ii]ntroduce|[Pp]resent)\b"
USING = r"\b(?:[Uu]se|[Uu]sed|[Uu]sing|[Bb]ased|[Ll]icensed|[Cc]ode)\b"


class Scorer(Protocol):
    """Takes candidates with ``annotated, text, start, end, phrase, kind, type``."""

    expensive: bool

    def yes(self, name: str) -> Column:
        """Probability of Yes to the artifact, ownership or reuse question."""

    def answer(self, name: str) -> Column:
        """Text answer to the name, license, version, url or list question; null for N/A."""


class RuleScorer:
    expensive = False

    def yes(self, name: str) -> Column:
        text = F.col("text")
        if name == "artifact":
            marks = [(text.rlike(LICENSES), 0.3), (text.rlike(VERSION), 0.2), (text.rlike(r"\b[A-Z]{2,}\b"), 0.1), (F.col("kind").startswith("gaz_"), 0.2)]
            return F.round(sum((F.when(hit, w).otherwise(0.0) for hit, w in marks), F.lit(0.15)), 6)
        pattern = {"ownership": OWNING, "reuse": USING}[name]
        return F.when(text.rlike(pattern), 0.9).otherwise(0.2)

    def answer(self, name: str) -> Column:
        text = F.col("text")
        if name == "license":
            return _found(text, LICENSES)
        if name == "version":
            return _found(text, VERSION)
        if name == "url":
            return F.get(find_urls(text), F.lit(0))
        if name == "name":
            before = F.substr(text, F.lit(1), F.col("start"))
            named = _found(before, r"([A-Z][A-Za-z0-9-]*(?: [A-Z][A-Za-z0-9-]*)*) $")
            return F.when(F.col("kind").startswith("gaz_"), F.substr(text, F.col("start") + 1, F.col("end") - F.col("start"))).otherwise(named)
        return F.concat(F.col("type"), F.lit(" : "), F.col("phrase"))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


class Model(Protocol):
    def classify(self, prompts: list[str]) -> list[float]:
        """Probability of Yes for each prompt."""

    def generate(self, prompts: list[str]) -> list[str]:
        """Text for each prompt; N/A where there is none."""


class ModelScorer:
    expensive = True

    def __init__(self, load: Callable[[], Model], batch: int = 8):
        token = uuid.uuid4().hex
        self._classify = _udf(load, "classify", "double", batch, token)
        self._generate = _udf(load, "generate", "string", batch, token)

    def yes(self, name: str) -> Column:
        return self._classify(make_prompt("annotated", question(name, "type")))

    def answer(self, name: str) -> Column:
        context = "paragraph" if name == "list" else "annotated"
        return F.nullif(self._generate(make_prompt(context, question(name, "type"))), F.lit("N/A"))


#: The model that a worker holds, by the token of its scorer.
_HELD: dict[str, Model] = {}


def _udf(load, method: str, kind: str, batch: int, token: str):
    @F.pandas_udf(kind)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from quillspark.functions import scoring

        if token not in scoring._HELD:  # once for each worker, which holds one model at a time
            scoring._HELD.clear()
            scoring._HELD[token] = load()
        model = scoring._HELD[token]
        for prompts in series:
            unique = list(dict.fromkeys(prompts))
            answers = {}
            for at in range(0, len(unique), batch):
                part = unique[at : at + batch]
                answers.update(zip(part, getattr(model, method)(part), strict=True))
            yield prompts.map(answers)

    return run
