"""Quality rules with repetition coverage.

The words of a text become exact ids. For each n-gram length a rolling hash gives all windows one number; windows of
one hash are compared word by word, so a collision can't count as a repetition. Coverage is the share of the text's
word characters inside duplicated n-grams, inside the most frequent n-gram, and inside duplicated lines. Of n-grams
that tie for the most frequent, the one that covers most characters counts. Characters are code points of words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._rows import batches_of, rows, small_batches

SYMBOLS = "#*$%&|<>"
FACTOR = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Limits:
    """Largest shares of word characters that a kept text may have inside its most frequent n-gram, inside repeated
    n-grams (the first occurrence is content) and inside repeated lines.

    They follow the values published for the repetition filters of large web corpora, with 0.05 more for repeated
    n-grams: one line that a short text repeats is no junk.
    """

    top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    duplicated: dict[int, float] = field(default_factory=lambda: {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15})
    line_chars: float = 0.20


def window_groups(ids: np.ndarray, n: int) -> np.ndarray:
    """For each n-word window the number of its group of equal windows."""
    count = len(ids) - n + 1
    if count < 1:
        return np.empty(0, np.int64)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total = total * np.uint64(FACTOR) + ids[i : i + count].astype(np.uint64) + np.uint64(1)
    _, first, group = np.unique(total, return_index=True, return_inverse=True)
    if len(first) < count:
        windows = np.lib.stride_tricks.sliding_window_view(ids, n)
        odd = np.flatnonzero(first[group] != np.arange(count))
        for at in range(0, len(odd), 65536):
            part = odd[at : at + 65536]
            if (windows[part] != windows[first[group[part]]]).any():  # a collision: group by the words themselves
                return np.unique(windows, axis=0, return_inverse=True)[1].reshape(-1)
    return group


def covered(inside: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a marked n-word window."""
    steps = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(inside)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def widest(group: np.ndarray, chosen: np.ndarray, n: int, sizes: np.ndarray) -> int:
    """The most characters that the n-word windows of one of the chosen groups cover; overlaps count once."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    at = np.flatnonzero(chosen[group])
    at = at[np.argsort(group[at], kind="stable")]
    new = np.diff(group[at], prepend=-1) != 0
    begin = np.where(new, at, np.maximum(at, np.roll(at, 1) + n))
    return int(np.add.reduceat(upto[at + n] - upto[begin], np.flatnonzero(new)).max())


def measure(text: str | None, limits: Limits) -> dict:
    """Counts and coverages of one text; a null text counts as an empty one."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    known: dict[bytes, int] = {}
    words = data.split()
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    length_of = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in known), np.int64, len(known))
    sizes = length_of[ids] if len(ids) else np.empty(0, np.int64)
    chars = int(sizes.sum())

    lines = [x for x in data.split(b"\n") if x.strip()]
    times = Counter(lines)
    # the first of equal lines is content; characters of words count, as in the n-grams
    again = sum((n - 1) * sum(int(length_of[known[w]]) for w in x.split()) for x, n in times.items() if n > 1)

    out = {"n_words": len(words), "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": len(lines) - len(times)}
    out["line_char_share"] = again / chars if chars else 0.0
    failed = ["line_char_share"] if again > limits.line_chars * chars else []
    repeat_words = 0
    for n in sorted({*limits.top, *limits.duplicated, 8}):
        group = window_groups(ids, n)
        count = np.bincount(group) if len(group) else np.zeros(1, np.int64)
        if count.max(initial=0) < 2:
            break  # a longer n-gram that repeats would hold a shorter one that does
        if n in limits.top:
            worth = widest(group, count == count.max(), n, sizes)
            out[f"top_{n}"] = worth / chars
            if worth > limits.top[n] * chars:
                failed.append(f"top_{n}")
        if n == 8:
            repeat_words = int(covered(count[group] > 1, 8, len(ids)).sum())
        if n in limits.duplicated:
            # the first of the equal windows is content, the later ones are repetition
            later = np.ones(len(group), bool)
            later[np.unique(group, return_index=True)[1]] = False
            again_chars = int(sizes[covered(later, n, len(ids))].sum())
            out[f"dup_{n}"] = again_chars / chars
            if again_chars > limits.duplicated[n] * chars:
                failed.append(f"dup_{n}")
    out["n_repeat_words"], out["failed_rules"] = repeat_words, failed
    return out


RESULT = pa.schema(
    [("doc_id", pa.int64())]
    + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("line_char_share", pa.float64()), ("dup_ngram_share", pa.float64()), ("failed_rules", pa.string())]
)
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_char_share double, dup_ngram_share double, failed_rules string"


def quality_rules(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """Counts, coverages and verdict of each row.

    ``base_failed`` holds for texts of under ``min_words`` words or with over ``repeat_percent`` percent of their
    words in repeated 8-word windows; so null, empty and blank texts fail. ``kept`` is false for those, and for
    texts over one of the limits, which ``failed_rules`` names. Rows are independent: repeated rows, null ids and
    further columns don't matter.
    """
    limits = limits or Limits()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for doc, text in rows(batches):
                m = measure(text, limits)
                base = m["n_words"] < min_words or 100 * m["n_repeat_words"] > repeat_percent * m["n_words"]
                shares = [m.get(f"dup_{n}", 0.0) for n in limits.duplicated]
                yield (
                    doc, m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"],
                    base, not base and not m["failed_rules"], m["line_char_share"], max(shares, default=0.0), ",".join(m["failed_rules"]),
                )

        yield from batches_of(RESULT, out())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DDL)
