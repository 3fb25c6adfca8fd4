"""Substring dedup by hashing pieces of lines.

Words are runs without ASCII white space, A-Z lower-cased. A line is cut into pieces after every word whose MD5 digest
begins with a digit of ``ANCHORS``, so a passage is cut alike wherever it stands in a line; the last word of a line ends
a piece too. A unit is two neighbouring pieces, or one piece of enough words. A unit's digest is grouped over the whole
corpus; the occurrence in the smallest document id, and in it the first place, stays. Repeated units that follow each
other are a run, and a run goes if its different pieces have enough words together: single lines and short phrases
repeat by chance. Offsets are code points of the original text.

Digests have 64 bits. Two units that differ share one with a chance of 2^-64, and a wrong removal needs that for every
unit of a run of ``min_words`` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._rows import col, free, numbered, slices, small_batches
from quillspark.llm.shingles import GOLDEN, mix
from quillspark.plans.storage import Workspace

#: First hexadecimal digits of the MD5 digests of words that end a piece: 3 words of 16.
ANCHORS = "012"
REMOVED = "array<struct<start:long,end:long,words:long,keeper:{id}>>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Words(dict):
    """64 bits of the MD5 digests of words, remembered up to a number of entries that bounds the memory. The digest's
    first hexadecimal digit is the highest one."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 50_000:
            self.clear()
        self[word] = found = int.from_bytes(md5(word).digest()[:8], "big")
        return found


@dataclass
class Pieces:
    """Pieces of a text in order: first word, word after the last, digest."""

    first: np.ndarray
    last: np.ndarray
    digest: np.ndarray

    @property
    def words(self) -> np.ndarray:
        return self.last - self.first


def pieces_of(text: str | None, words: Words) -> Pieces:
    found, line_ends = [], []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        found += line.split()
        line_ends.append(len(found))
    if not found:
        none = np.empty(0, np.int64)
        return Pieces(none, none, none.astype(np.uint64))
    of = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    ends = (of >> np.uint64(60)) < len(ANCHORS)
    ends[np.array([n for n in line_ends if n], np.int64) - 1] = True
    last = np.flatnonzero(ends) + 1
    first = np.concatenate([[0], last[:-1]])
    # place of a word in its piece, mixed in, so that order counts
    place = np.arange(len(found), dtype=np.int64) - np.repeat(first, last - first)
    return Pieces(first, last, mix(np.add.reduceat(mix(of + place.astype(np.uint64) * np.uint64(GOLDEN)), first)))


def units_of(pieces: Pieces, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first piece, piece after the last) of every unit, in order of the first piece."""
    n = len(pieces.digest)
    twos = mix(pieces.digest[:-1] * np.uint64(3) + mix(pieces.digest[1:])) if n > 1 else np.empty(0, np.uint64)
    ones = np.flatnonzero(pieces.words >= min_words)
    at = np.arange(max(0, n - 1))
    digest, first, last = np.concatenate([twos, pieces.digest[ones]]), np.concatenate([at, ones]), np.concatenate([at + 2, ones + 1])
    order = np.lexsort((last, first))
    return digest[order], first[order], last[order]


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, 128):
            units, again, rows = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found, count = np.unique(units_of(pieces_of(text, words), min_words)[0], return_counts=True)
                units.append(found.view(np.int64))
                again.append(count > 1)
                rows.append(np.full(len(found), row))
            if units:
                ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(units)), pa.array(np.concatenate(again))], names=["id_", "unit_", "again_"])

    return run


def repeated_units(units: DataFrame) -> DataFrame:
    """``id_, unit_, keeper_``: units that a document of a smaller id has too, or that a document repeats itself.

    Takes each document's different units once. Counting combines before it shuffles, and the join is plain, so a
    unit that is everywhere is split.
    """
    shared = units.groupBy("unit_").agg(F.min("id_").alias("keeper_"), F.max("id_").alias("last_")).where("keeper_ != last_").select("unit_", "keeper_")
    elsewhere = units.join(shared, "unit_").where("id_ != keeper_").select("id_", "unit_", "keeper_")
    return elsewhere.unionByName(units.where("again_").select("id_", "unit_", F.col("id_").alias("keeper_")))


def removed_name(columns: Iterable[str]) -> str:
    """The name of the column that ``substring_dedup`` adds to these."""
    return free("removed_", columns)


def substring_dedup(docs: DataFrame, min_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns with repeated runs removed from the text, and what was removed.

    Adds ``removed_``: an array of (start, end, words, keeper) in order, with a run's half-open span of code points in
    the original text, its number of words and the smallest id that keeps one of its units; empty where nothing went.
    The white space after a run goes with it, but not a line feed that ends a line of which words stay. Documents rank
    by id, so the smallest id keeps a unit; within one, the first place. Null and empty texts and rows with a null id
    stay as they are. Rows that repeat an id are one document and keep what they share with each other. Other columns
    pass whatever their names; if one is called ``removed_``, the added name takes underscores until it is free
    (``removed_name``). Texts are read whole, whatever their length. An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "units")
    small_batches(docs.sparkSession)
    id_field = docs.select(col(id_col).alias("id_")).schema["id_"]
    known = docs.where(col(id_col).isNotNull() & col(text_col).isNotNull()).select(col(id_col).alias("id_"), col(text_col).alias("text_"))
    units = work.save(known.mapInArrow(_units(min_words), T.StructType([id_field, *T.StructType.fromDDL("unit_ long, again_ boolean").fields])))
    key, gone_name, added = free("id_", docs.columns), free("gone_", docs.columns), removed_name(docs.columns)
    gone = work.save(repeated_units(units).groupBy("id_").agg(F.collect_list(F.struct("unit_", "keeper_")).alias("gone_")).toDF(key, gone_name))
    work.drop(units)
    joined = docs.join(gone, col(id_col) == col(key), "left").select(*map(col, docs.columns), col(gone_name))
    names = [name.lower() for name in docs.columns]
    removed = T.DataType.fromDDL(REMOVED.format(id=id_field.dataType.simpleString()))
    schema = T.StructType([*docs.schema.fields, T.StructField(added, removed)])
    return numbered(joined).mapInArrow(_cut(names.index(id_col.lower()), names.index(text_col.lower()), schema.names, min_words), schema)


def _cut(id_at: int, text_at: int, names: list[str], min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, 128):
            id_type = batch.schema.field(id_at).type
            removed_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("keeper", id_type)]))
            ids, texts = batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist()
            removed = []
            for row, gone in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                spans = repeated_runs(ids[row], texts[row], gone, min_words, words) if gone and texts[row] else []
                if spans:
                    texts[row] = without(texts[row], spans)
                removed.append(spans)
            columns = list(batch.columns)[:-1]
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, removed_type)], names=names)

    return run


def repeated_runs(doc_id, text: str, gone: Iterable[dict], min_words: int, words: Words) -> list[dict]:
    """The spans to remove, given the document's repeated units and who keeps them."""
    keepers: dict[int, object] = {}
    for x in gone:
        keepers[x["unit_"]] = min(x["keeper_"], keepers.get(x["unit_"], x["keeper_"]))
    pieces = pieces_of(text, words)
    digest, first, last = units_of(pieces, min_words)
    digest = digest.view(np.int64)
    runs, seen = [], set()
    for k in np.flatnonzero(np.isin(digest, np.fromiter(keepers, np.int64, len(keepers)))):
        unit, keeper = int(digest[k]), keepers[int(digest[k])]
        if keeper != doc_id or unit in seen:
            if runs and first[k] < runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], int(last[k])), min(runs[-1][2], keeper))
            else:
                runs.append((int(first[k]), int(last[k]), keeper))
        seen.add(unit)
    spans = []
    for a, b, keeper in runs:
        different = np.unique(pieces.digest[a:b], return_index=True)[1] + a
        if pieces.words[different].sum() >= min_words:
            spans.append((int(pieces.first[a]), int(pieces.last[b - 1]), keeper))
    return _places(text, spans) if spans else []


def _places(text: str, spans: list[tuple]) -> list[dict]:
    """Spans of words as spans of code points, with the white space that goes."""
    at = [m.span() for m in WORD.finditer(text)]
    out = []
    for a, b, keeper in spans:
        start, end, after = at[a][0], at[b - 1][1], at[b][0] if b < len(at) else len(text)
        begins_line = a == 0 or "\n" in text[at[a - 1][1] : start]
        if begins_line or "\n" not in text[end:after]:
            end = after
        out.append({"start": start, "end": end, "words": b - a, "keeper": keeper})
    return out


def without(text: str, spans: list[dict]) -> str:
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : span["start"]])
        at = span["end"]
    return "".join([*kept, text[at:]])
