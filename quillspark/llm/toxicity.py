"""Toxicity by a weighted lexicon.

Text is folded (case, accents, homoglyphs, digits and signs that stand for letters), an Aho-Corasick automaton finds
the lexicon's entries in one pass, matches inside exception phrases don't count, and the weights are summed, divided
by a power of the length and put through a logistic curve.

The lexicon is learned: whole words and word beginnings whose share among toxic rows exceeds that among others give
entries with their log odds as weights. It is learned on a bounded sample of labelled rows; the bound is a parameter.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._rows import batches_of, numbered, rows, slices, small_batches
from quillspark.plans.storage import Workspace

#: Letters of other scripts that look like Latin ones (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l", "ø": "o", "ł": "l", "đ": "d", "ß": "ss",
    "æ": "ae", "œ": "oe",
}
#: Digits and signs that stand for letters inside a word (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e", "£": "l"}
#: Signs that end sentences as often as they stand for letters: they count as letters only before one.
ENDS = re.compile(r"[!|+](?![^\W\d_])")
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "white trash bag", "idiot proof", "idiot board", "loser bracket", "pathetic fallacy", "stupid mistake of mine")


class Folder(dict):
    """A translation table of single characters, filled as characters occur."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        out = []
        for c in unicodedata.normalize("NFKD", char).lower():
            if unicodedata.combining(c):
                continue
            c = HOMOGLYPHS.get(c, c)
            c = SUBSTITUTES.get(c, c)
            out.append(c if c.isalpha() else " ")
        self[code] = found = "".join(out)
        return found


def fold(text: str | None, table: Folder) -> str:
    """Lower-case words without accents, single spaces between and around them; null is empty."""
    return f" {' '.join(ENDS.sub(' ', text or '').translate(table).split())} "


def features(folded: str, shortest: int = 4, longest: int = 7) -> set[str]:
    """Entries that a folded text could give: its words, and their beginnings by length."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) >= 3} | {f" {w[:n]}" for w in words for n in range(shortest, min(longest, len(w)) + 1)}


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    length_power: float = 0.5
    slope: float = 1.0
    offset: float = -3.0
    table: Folder = field(default_factory=Folder)

    def __post_init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        harmless = {fold(phrase, self.table) for phrase in self.exceptions} - {"  "}
        for entry in sorted(self.weights.keys() | harmless):
            self.automaton.add_word(entry, (len(entry), self.weights.get(entry), entry in harmless))
        if len(self.automaton):
            self.automaton.make_automaton()

    def strength(self, text: str | None) -> tuple[float, int]:
        """The matches' weights over a power of the word count, and the number of matches; 0 without words.

        Of matches that begin at one place the heaviest counts; none that begins inside an exception phrase does, nor
        an entry that is such a phrase itself.
        """
        folded = fold(text, self.table)
        best: dict[int, float] = {}
        spans = []
        if len(self.automaton):
            for end, (size, weight, harmless) in self.automaton.iter(folded):
                start = end - size + 1
                if harmless:
                    spans.append((start, end))
                if weight is not None:
                    best[start] = max(weight, best.get(start, weight))
        if spans:
            best = dict(_outside(best, spans))
        n = max(1, folded.count(" ") - 1)
        return sum(best.values()) / n**self.length_power, len(best)

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * strength + self.offset))))


def _outside(best: dict[int, float], spans: list[tuple[int, int]]) -> Iterator[tuple[int, float]]:
    """The matches that begin in none of the half-open spans, by one sweep over both."""
    spans.sort()
    k, end = 0, -1
    for start in sorted(best):
        while k < len(spans) and spans[k][0] <= start:
            end = max(end, spans[k][1])
            k += 1
        if start >= end:
            yield start, best[start]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, seen = Folder(), (Counter(), Counter())
    schema = pa.schema([("entry", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])

    def drain():
        for entry in seen[0].keys() | seen[1].keys():
            yield entry, seen[1][entry], seen[0][entry]
        for counter in seen:
            counter.clear()

    for text, toxic in rows(batches):
        seen[1 if toxic else 0].update(features(fold(text, table)))
        if len(seen[0]) + len(seen[1]) > 300_000:
            yield from batches_of(schema, drain(), size=50_000)
    yield from batches_of(schema, drain(), size=50_000)


def learn(docs: DataFrame, labels: DataFrame, max_label_rows: int = 20_000, max_entries: int = 2_000, least_rows: int = 3, least_weight: float = 2.0) -> Lexicon:
    """A lexicon from labelled rows outside the held-out fifth.

    At most about ``max_label_rows`` labelled rows, chosen evenly by a hash of the id, are read; labels and ids serve
    for choosing and learning only. Rows with null texts, labels or ids don't teach. Without toxic rows the lexicon is
    empty and every text scores the base rate's floor.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id_")).agg(F.max("toxic").alias("toxic_"))
    total = known.count()
    share = min(1.0, max_label_rows / max(1, total))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "id_"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col("doc_id").cast("long").alias("id_"), F.col("text").alias("text_")).where("text_ IS NOT NULL")
    # the sample's ids are bounded by max_label_rows, so texts need not move to meet them; its texts are read three times
    small_batches(docs.sparkSession)
    sample = texts.join(F.broadcast(known), "id_").select("text_", (F.col("toxic_") > 0).alias("toxic_"))
    sample = Workspace(docs.sparkSession, "toxicity").save(sample)
    sizes = {bool(r[0]): r[1] for r in sample.groupBy("toxic_").count().collect()}
    n_toxic, n_other = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_other:
        return Lexicon({})
    counted = sample.mapInArrow(_counts, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("o") + 0.5) / (n_other + 1))
    strong = counted.select("entry", "t", weight.alias("w")).where((F.col("t") >= least_rows) & (F.col("w") >= least_weight))
    # the bound on entries is on the model, by evidence; ties by entry
    best = strong.orderBy((F.col("w") * F.sqrt("t")).desc(), "entry").limit(max_entries).collect()
    lexicon = Lexicon(prune({r.entry: (r.w, r.t) for r in best}))
    found = sample.mapInArrow(_strengths(lexicon), "x double, toxic boolean").toPandas()
    lexicon.slope, lexicon.offset = fit(found.x.to_numpy(), found.toxic.to_numpy(bool))
    return lexicon


def prune(found: dict[str, tuple[float, int]], near: float = 0.7) -> dict[str, float]:
    """Leaves out entries that a shorter kept beginning covers about as well."""
    kept: dict[str, float] = {}
    for entry in sorted(found, key=lambda e: (len(e.rstrip()), e)):
        word = entry.rstrip()
        if not any(kept.get(word[:n], -9.0) >= found[entry][0] - near for n in range(4, len(word) + 1)):
            kept[entry] = found[entry][0]
    return kept


def _strengths(lexicon: Lexicon):
    state = (lexicon.weights, lexicon.exceptions, lexicon.length_power)
    schema = pa.schema([("x", pa.float64()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*state)
        yield from batches_of(schema, ((own.strength(text)[0], toxic) for text, toxic in rows(batches)))

    return run


def fit(x: np.ndarray, toxic: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve with equal weight for both classes, by Newton's method."""
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum())) * len(x)
    a = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (toxic - p)) - ridge * beta
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, n_matches`` for each row; the text alone decides the score.

    Null and empty texts score as texts without matches. Repeated rows and null ids are rows like others.
    """
    state = (lexicon.weights, lexicon.exceptions, lexicon.length_power, lexicon.slope, lexicon.offset)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_matches", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*state)

        def out():
            for doc, text in rows(batches):
                strength, n = own.strength(text)
                yield doc, own.score(strength), n

        yield from batches_of(schema, out())

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, n_matches long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns; rows with a null id stay if they are clean."""
    state = (lexicon.weights, lexicon.exceptions, lexicon.length_power, lexicon.slope, lexicon.offset)
    names = docs.columns
    at = [name.lower() for name in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*state)
        for batch in slices(batches):
            clean = [own.score(own.strength(text)[0]) < 0.5 for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_())).rename_columns(names)

    return numbered(docs).mapInArrow(run, docs.schema)
