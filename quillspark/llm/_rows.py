"""Rows of Arrow batches, one key's rows at a time, and small helpers that the operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def numbered(df: DataFrame) -> DataFrame:
    """The columns under plain names, since rows can't go to Python under names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def free(wanted: str, taken: Iterable[str]) -> str:
    """The name with as many underscores at its end as it needs to differ from all names taken, whatever the case."""
    held = {name.lower() for name in taken}
    while wanted.lower() in held:
        wanted += "_"
    return wanted


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of at most ``most`` bytes in this session, unless it has a smaller bound: texts can be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).removesuffix("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))


def frees(taken: Iterable[str], *wanted: str) -> list[str]:
    """A free name for each wanted one."""
    held, out = list(taken), []
    for name in wanted:
        out.append(free(name, held))
        held.append(out[-1])
    return out


def worker_cache() -> dict:
    """Objects that a Python worker keeps from task to task."""
    return sys.modules.setdefault("_quillspark_worker", types.ModuleType("_quillspark_worker")).__dict__


def rows(batches: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Rows as tuples; few at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def slices(batches: Iterable[pa.RecordBatch], step: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts, for work on whole columns in bounded memory."""
    for batch in batches:
        yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in their first ``keys`` columns; the rows must be sorted by them."""
    now, found = None, []
    for row in rows(batches):
        if row[:keys] != now:
            if found:
                yield now, found
            now, found = row[:keys], []
        found.append(row[keys:])
    if found:
        yield now, found


def batches_of(schema: pa.Schema, out: Iterable[tuple], size: int = 4096, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` tuples and about ``max_bytes`` of strings and binaries."""
    pending, held = [], 0
    for row in out:
        pending.append(row)
        held += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(pending) >= size or held >= max_bytes:
            yield _batch(schema, pending)
            pending, held = [], 0
    if pending:
        yield _batch(schema, pending)


def _batch(schema: pa.Schema, pending: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*pending, strict=True), schema, strict=True)], schema=schema)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows (n of them) and columns (numbered from n on)."""
    n = links.shape[0]
    rows_left, cols_left = links.any(1), links.any(0)
    edges = []
    for root in np.flatnonzero(rows_left):
        if not rows_left[root]:
            continue
        rows_left[root] = False
        front = np.array([root])
        while len(front):
            cols = np.flatnonzero(links[front].any(0) & cols_left)
            cols_left[cols] = False
            edges += [(int(root), int(n + c)) for c in cols]
            front = np.flatnonzero(links[:, cols].any(1) & rows_left) if len(cols) else cols
            rows_left[front] = False
            edges += [(int(root), int(r)) for r in front]
    return edges
