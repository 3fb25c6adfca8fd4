"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and rotated onto the principal axes of all vectors of their dimension, which keeps every
cosine. Within a label, unit vectors of cosine t or more differ by at most sqrt(2 - 2t) along each axis, so strips of that
width along the first axis are compared with themselves and the next strip only. A strip is dealt into blocks; a pair
of blocks is a tile. In a tile the leading dimensions are multiplied first, the rest of a product is bounded by the
product of the suffix norms, and pairs that cannot reach the threshold stop there; what is left goes on in steps, and
a pair that comes to the end is decided by its cosine in double precision on the original vectors.

Equal vectors of a label are one row until the end. A tile returns counts of links and a spanning forest, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._rows import batches_of, col, forest, groups
from quillspark.plans.components import connected_components
from quillspark.plans.storage import Workspace

#: Slack of bounds against rounding; pairs within it are decided by the exact cosine.
EPSILON = 1e-7
STEPS = (8, 16, 32)
#: Dimensions, the most frequent ones, that are rotated, and the largest of them: axes are sent to every executor.
MAX_AXES, MAX_TURNED = 4, 2048


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows, each scaled by a power of two, so that no square overflows; that changes no cosine."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(flat, -np.frexp(np.abs(flat).max(1, keepdims=True))[1])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            vectors = matrix(batch.column(0))
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            part = vectors.T @ vectors
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for part in batch.column(0):
            part = np.frombuffer(part.as_buffer())
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Axes by falling second moment, from one pass over all vectors; partial sums are added in a tree, and one matrix
    comes to the driver."""
    parts = vectors.mapInArrow(_moments, "part binary").repartition(16).mapInArrow(_add, "part binary").coalesce(1).mapInArrow(_add, "part binary").collect()
    total = sum((np.frombuffer(p.part) for p in parts), np.zeros(size * size)).reshape(size, size)
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()


def near_links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of rotated unit vectors whose products can reach the threshold: leading dimensions, then bounds."""
    size = a.shape[1]
    steps = [s for s in STEPS if s < size] + [size]
    first = steps[0]
    product = a[:, :first] @ b[:, :first].T
    tail_a = [np.sqrt((a[:, s:] ** 2).sum(1)) for s in steps]
    tail_b = [np.sqrt((b[:, s:] ** 2).sum(1)) for s in steps]
    rows, cols = np.nonzero(product + np.outer(tail_a[0], tail_b[0]) >= threshold - EPSILON)
    done = product[rows, cols]
    for k, (low, high) in enumerate(zip(steps, steps[1:], strict=False), 1):
        keep = np.empty(len(rows), bool)
        for at in range(0, len(rows), 200_000):
            p = slice(at, at + 200_000)
            done[p] += np.einsum("ij,ij->i", a[rows[p], low:high], b[cols[p], low:high])
            keep[p] = done[p] + tail_a[k][rows[p]] * tail_b[k][cols[p]] >= threshold - EPSILON
        rows, cols, done = rows[keep], cols[keep], done[keep]
    return np.stack([rows, cols], 1)


def exact_links(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Of the pairs those whose cosine of the original vectors, in double precision, reaches the threshold."""
    links = np.zeros((len(a), len(b)), bool)
    norm_a, norm_b = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    for at in range(0, len(pairs), 200_000):
        i, j = pairs[at : at + 200_000].T
        cosine = np.einsum("ij,ij->i", a[i], b[j]) / (norm_a[i] * norm_b[j])
        links[i, j] = cosine >= threshold
    return links


def _placed(axes: dict[int, np.ndarray], width: float):
    schema = pa.schema([("label", pa.int64()), ("size", pa.int32()), ("id", pa.int64()), ("copies", pa.int64()), ("strip", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                vectors = matrix(part.column(4))
                first = (vectors @ axes[size][:, 0] if size in axes else vectors[:, 0]) / np.linalg.norm(vectors, axis=1)
                strip = np.floor(first / width).astype(np.int64)
                packed = [v.tobytes() for v in vectors]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(strip), pa.array(packed, pa.binary())], schema=schema)

    return run


def _tiles(axes: dict[int, np.ndarray], threshold: float):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for _, found in groups(batches, 6):
                side = np.array([x[0] for x in found])
                ids, copies = np.array([x[1] for x in found]), np.array([x[2] for x in found])
                vectors = np.stack([np.frombuffer(x[3]) for x in found])
                left = np.flatnonzero(side != 1)
                right = np.flatnonzero(side != 0)
                if not len(left) or not len(right):
                    continue
                turned = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                if vectors.shape[1] in axes:
                    turned = turned @ axes[vectors.shape[1]]
                links = exact_links(vectors[left], vectors[right], near_links(turned[left], turned[right], threshold), threshold)
                links &= ids[left][:, None] != ids[right][None, :]
                nodes = np.concatenate([ids[left], ids[right]])
                for i, n in zip(ids[left], links @ copies[right], strict=True):
                    if n:
                        yield int(i), int(n), None
                if side[left[0]] == 0:  # a tile of two blocks; one against itself has both directions already
                    for i, n in zip(ids[right], copies[left] @ links, strict=True):
                        if n:
                            yield int(i), int(n), None
                for a, b in forest(links):
                    if nodes[a] != nodes[b]:
                        yield int(nodes[a]), 0, int(nodes[b])

        yield from batches_of(schema, out())

    return run


def near_dedup(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = 512) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Vectors of one non-null label and one dimension link when their cosine is at least the threshold. Vectors that are
    null, empty or zero, or hold a null or non-finite number, and rows with a null label, link with nothing. Rows with
    a null id have null in all but ``n_links`` (0) and ``kept`` (true). Rows that repeat an id count as one vector if
    equal. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "embeddings")
    all_rows = vectors.select(col(id_col).cast("long").alias("id"), col(label_col).cast("long").alias("label"), col(vector_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = all_rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))
    usable = usable.select("label", "id", "v").distinct()
    # equal vectors of a label: one row with its number of copies
    same = work.save(usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("size", F.size("v")))
    sizes = [r["size"] for r in same.groupBy("size").count().orderBy(F.desc("count"), "size").limit(MAX_AXES).collect()]
    # vectors of other dimensions are compared along their own axes: that changes work, not links
    axes = {n: principal_axes(same.where(F.col("size") == n).select("v"), n) for n in sizes if n <= MAX_TURNED}
    width = math.sqrt(2 - 2 * threshold) * (1 + 1e-6) if threshold < 1 else 1e-3
    sent = same.select("label", "size", F.col("rep").alias("id"), "copies", "v")
    placed = work.save(sent.mapInArrow(_placed(axes, width), "label long, size int, id long, copies long, strip long, vector binary"))
    strips = ["label", "size", "strip"]
    held = placed.groupBy(*strips).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    after = held.select("label", "size", (F.col("strip") - 1).alias("strip"), F.col("blocks").alias("blocks_after"))
    before = held.select("label", "size", (F.col("strip") + 1).alias("strip"), F.col("blocks").alias("blocks_before"))
    counts = held.join(after, strips, "left").join(before, strips, "left").na.fill(0)
    dealt = placed.join(counts, strips).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    zero = F.lit(0).cast("long")

    def upto(n):
        return F.when(F.col(n) > 0, F.sequence(zero, F.col(n) - 1)).otherwise(F.array().cast("array<long>"))

    # a tile is (strip, block, next strip or the same, other block); side 0 and 1 are its two blocks, 2 is both
    within = F.transform(upto("blocks"), lambda o: F.struct(F.col("strip").alias("s"), F.least("own", o).alias("i"), zero.alias("d"), F.greatest("own", o).alias("j"), F.when(F.col("own") == o, 2).when(F.col("own") < o, 0).otherwise(1).alias("side")))
    onward = F.transform(upto("blocks_after"), lambda o: F.struct(F.col("strip").alias("s"), F.col("own").alias("i"), (zero + 1).alias("d"), o.alias("j"), F.lit(0).alias("side")))
    back = F.transform(upto("blocks_before"), lambda o: F.struct((F.col("strip") - 1).alias("s"), o.alias("i"), (zero + 1).alias("d"), F.col("own").alias("j"), F.lit(1).alias("side")))
    tiles = dealt.select("label", "size", "id", "copies", "vector", F.explode(F.concat(within, onward, back)).alias("t"))
    keys = ["label", "size", "s", "i", "d", "j"]
    tiles = tiles.select("label", "size", "t.s", "t.i", "t.d", "t.j", "t.side", "id", "copies", "vector").repartition(*keys).sortWithinPartitions(*keys, "side", "id")
    found = work.save(tiles.mapInArrow(_tiles(axes, threshold), "id long, n long, other long"))
    work.drop(placed)
    linked = connected_components(found.where("other IS NOT NULL").select(F.col("id").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))

    reps = same.join(links, same.rep == links.id, "left").drop("id").join(linked, F.col("rep") == linked.node, "left")
    reps = reps.select("label", "v", (F.coalesce("n", zero) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # distinct ids only: a row that repeats an id takes the values of that id
    by_id = usable.join(reps, ["label", "v"]).groupBy(F.col("id").alias("of_id")).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = all_rows.select("id").join(by_id, F.col("id") == F.col("of_id"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", zero).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
