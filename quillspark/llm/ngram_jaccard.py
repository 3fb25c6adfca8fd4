"""N-gram Jaccard join by vertical partitioning.

The global order of the n-grams is the order of their hashes, which needs no counting pass, is the same in every
task and cuts into even ranges. A document's sorted set is cut at fixed points of that order into fragments.

1. Sizes fall into levels whose ends differ by at most 1 / threshold; a pair that can link shares a level. In a
   level, linked sets differ in at most D elements, so of F > D fragments at least F - D are equal. Each fragment of
   a set that is not empty becomes one key. F exceeds D by 1 and some slack, so two sets of which one has no more
   empty fragments than the slack share a key. Sets with more also give their first n-grams in the global order as
   keys, ``PREFIX`` more than a linked set can lack, so two such sets share as many of those. No key gathers documents
   for lacking n-grams. Texts are cut into n-grams once; keys are written with the sets.
2. A key of up to ``BUCKET`` documents gives its pairs. Equal sets become one node, and a pair stays only if its sets
   differ in no more fragments than they may differ in elements, judged by one byte for each fragment; this removes
   pairs that share a common n-gram alone. A key of more documents is large. Sets that share no small key can link
   only by large ones, and then share as many keys as step 1 says; so a set with fewer large keys than that drops out
   of them. Those that stay get edges to the smallest one of their key, n - 1 for n documents. A common n-gram alone
   joins nothing. The components of all these edges hold all pairs that can link.
3. Sets that are equal count once from here on. A component is dealt into blocks of bounded size; each pair of
   blocks is one unit of work. In it the partial overlaps are counted fragment by fragment of the global order and
   summed for each pair. Counts of links and a spanning forest leave it, so no task returns all pairs of a group.
4. The components of the forests are the result.

"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._rows import batches_of, col, forest, groups, rows, small_batches
from quillspark.llm.shingles import GOLDEN, MIX_1, MIX_2, Shingler, mix
from quillspark.plans.components import connected_components
from quillspark.plans.storage import Workspace

SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("marks", pa.binary()), ("keys", pa.binary()), ("parts", pa.binary())])
SETS_DDL = "doc_id long, n_shingles long, h1 long, h2 long, marks binary, keys binary, parts binary"
#: ``about`` holds part and need, and whether the row goes elsewhere, since its key is known to have many documents;
#: ``key`` is then changed by a bijection of the document.
KEYS = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("about", pa.int64())])
KEYS_DDL = "key long, u long, about long"
ELSEWHERE = 1 << 62
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
#: A pair of a small key, or a document's membership in a large one.
BUCKETS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("part", pa.int32()), ("need", pa.int32())])
BUCKETS_DDL = "u long, v long, key long, part int, need int"
MEMBERS = pa.schema([("cluster", pa.int64()), ("blocks", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("copies", pa.int64()), ("items", pa.binary())])
MEMBERS_DDL = "cluster long, blocks long, block long, doc_id long, h1 long, h2 long, copies long, items binary"
#: An edge of a forest, or the number of a set's links.
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())])

#: N-grams that two linked sets with many empty fragments share among their first ones, at least.
PREFIX = 3
#: Documents of a key that still gives all its pairs: at most 7.5 pairs for each document.
BUCKET = 16
#: Bits of the bitmap that spares texts the way to the members of candidate groups.
ID_BITS = 1 << 27


@dataclass(frozen=True)
class Level:
    no: int
    least: int
    most: int
    differ: int
    percent: int

    @property
    def slack(self) -> int:
        return 2 + self.differ // 12

    @property
    def fragments(self) -> int:
        return self.differ + 1 + self.slack


class Levels:
    """Ranges of set sizes, and for a size the levels in which it has to give keys."""

    def __init__(self, percent: int):
        self.percent, self.all, self.known = percent, [], {}

    def _reach(self, n: int) -> list[Level]:
        while not self.all or self.all[-1].most < n * 100 // self.percent + 1:
            least = self.all[-1].most + 1 if self.all else 1
            most = max(least, least * 100 // self.percent)
            differ = 2 * most * (100 - self.percent) // (100 + self.percent)
            self.all.append(Level(len(self.all), least, most, differ, self.percent))
        return self.all

    def of(self, n: int) -> list[Level]:
        """The level of n, and those above in which larger partners can be; none where only equal sets can link."""
        if n not in self.known:
            self.known[n] = [x for x in self._reach(n) if x.most >= n and 100 * n >= self.percent * x.least and x.differ]
        return self.known[n]


def _fragments(items: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the fragments that are not empty, and a key of each."""
    count = np.uint64(level.fragments)
    at = ((items >> np.uint64(32)) * count) >> np.uint64(32)
    starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    used = at[starts]
    sums = np.add.reduceat(mix(items ^ np.uint64(MIX_1)), starts)
    return used, mix(sums ^ mix(_salt(used, level)))


def _salt(fragments: np.ndarray, level: Level) -> np.ndarray:
    return fragments * np.uint64(GOLDEN) + np.uint64((level.no + 1) * MIX_2 % (1 << 64))


def fragment_keys(items: np.ndarray, level: Level) -> list[tuple[np.ndarray, int]]:
    """64-bit keys, and how many of them two linked sets share at least: one key for each fragment that is not empty;
    if more are empty than the slack, also keys of the first items."""
    n, used_keys = len(items), _fragments(items, level)[1]
    differ = min(level.differ, (n + n * 100 // level.percent) * (100 - level.percent) // (100 + level.percent))
    out = [(used_keys, max(1, len(used_keys) - differ))]
    if level.fragments - len(used_keys) > level.slack:
        shared = (level.percent * n + 99) // 100
        out.append((mix(items[: n - shared + PREFIX] ^ np.uint64(GOLDEN)), min(PREFIX, shared)))
    return out


def fragment_marks(items: np.ndarray, levels: list[Level]) -> bytes:
    """One byte for each fragment of each level: 0 if it is empty, else a digest."""
    out = []
    for level in levels:
        used, keys = _fragments(items, level)
        marks = np.zeros(level.fragments, np.uint8)
        marks[used.astype(np.int64)] = keys % np.uint64(255) + np.uint64(1)
        out.append(marks.tobytes())
    return b"".join(out)


def can_link(n_a: int, marks_a: bytes, n_b: int, marks_b: bytes, levels: Levels) -> bool:
    """Whether the sets may differ in as many elements as fragments differ, in a level that both have."""
    differ = (n_a + n_b) * (100 - levels.percent) // (100 + levels.percent)
    if 100 * min(n_a, n_b) < levels.percent * max(n_a, n_b):
        return False
    places = []
    for n in (n_a, n_b):
        start, found = 0, {}
        for level in levels.of(n):
            found[level.no] = (start, level.fragments)
            start += level.fragments
        places.append(found)
    common = max(places[0].keys() & places[1].keys(), default=None)
    if common is None:
        return False
    (a, size), (b, _) = places[0][common], places[1][common]
    x, y = np.frombuffer(marks_a, np.uint8, size, a), np.frombuffer(marks_b, np.uint8, size, b)
    return int(np.count_nonzero(x != y)) <= differ


def _distinct(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([u, v], 1), axis=0) if len(u) else np.empty((0, 2), np.int64)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 512, block_items: int = 250_000) -> DataFrame:
    """Links documents whose shingle sets have 100 * intersection >= percent * union; gives their components.

    Returns one row for each input row: ``doc_id, n_shingles, component_id`` (the smallest id reachable, itself
    included) and ``n_links`` (other rows linked directly). Null and empty texts, and texts without words, have no
    shingles and link with nothing; a row with a null id links with nothing and keeps a null component. Rows that
    repeat an id are linked one by one, each by its own text. Texts are read whole. Other columns are not read,
    whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    small_batches(spark)
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    sets = work.save(texts.mapInArrow(_sets(width, percent), SETS_DDL))

    # equal sets have one representative, the smallest id
    full = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = work.save(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")))
    alone = sets.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", "h1", "h2", F.lit(None).cast("long").alias("rep"), F.lit(1).cast("long").alias("copies"))
    every = full.select("doc_id", "n_shingles", "h1", "h2").join(same.select("h1", "h2", "rep", "copies"), ["h1", "h2"])
    every = work.save(every.select("doc_id", "n_shingles", "h1", "h2", "rep", "copies").unionByName(alone))
    rep_of = every.where("rep IS NOT NULL").select("doc_id", "rep")

    # copies give the keys of their representative: they stay out, but for ids of several rows
    copies = rep_of.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("rep").alias("rep")).where("rows = 1 AND doc_id != rep").select("doc_id")
    copies = work.save(copies)  # of a known size, so that keys need not move to meet a few of them
    keyed = full.select("doc_id", "keys", "parts").join(copies, "doc_id", "left_anti").mapInArrow(_keys, KEYS_DDL)
    buckets = work.save(keyed.repartition("key").sortWithinPartitions("key", "u").mapInArrow(_buckets, BUCKETS_DDL))
    ends = work.save(_by_rep(buckets.where("v IS NOT NULL").select("u", "v").distinct(), rep_of).unionByName(_by_rep(_stars(buckets), rep_of).withColumn("large", F.lit(True)), allowMissingColumns=True))
    work.drop(buckets)
    work.drop(copies)
    marks = full.select(F.col("doc_id").alias("id_"), F.col("n_shingles").alias("n_"), F.col("marks").alias("marks_"))
    marks = marks.join(same.select(F.col("rep").alias("id_")), "id_", "left_semi").distinct()
    few = ends.where("large IS NULL").select("u", "v")
    few = few.join(marks.toDF("u", "n_u", "marks_u"), "u").join(marks.toDF("v", "n_v", "marks_v"), "v").select("u", "n_u", "marks_u", "v", "n_v", "marks_v")
    candidates = few.mapInArrow(_likely(percent), "u long, v long").unionByName(ends.where("large").select("u", "v"))
    clusters = connected_components(candidates)
    members = clusters.join(same.withColumnRenamed("rep", "node"), "node")
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / block_rows), F.ceil(F.col("items") / block_items)).cast("long")
    dealt = members.join(size.select("component", blocks.alias("blocks")), "component").select(
        F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "h1", "h2", "copies"
    )
    dealt = work.save(dealt)
    work.drop(sets)
    work.drop(ends)
    work.drop(same)
    held = _marked(texts, dealt).join(dealt, "doc_id").select("cluster", "blocks", "block", "doc_id", "h1", "h2", "copies", "text")
    held = held.mapInArrow(_members(width), MEMBERS_DDL)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = held.select("cluster", "block", "doc_id", "h1", "h2", "copies", "items", other).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "h1", "h2", "copies", "items"
    )
    tiles = tiles.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block", "doc_id")
    links = work.save(tiles.mapInArrow(_links(percent), "u long, v long, h1 long, h2 long, n long"))
    work.drop(dealt)
    linked = connected_components(links.where("v IS NOT NULL").select("u", "v"))
    counts = links.where("v IS NULL").groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    found = every.where("rep IS NOT NULL").join(counts, ["h1", "h2"], "left").join(linked, F.col("rep") == F.col("node"), "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = every.where("rep IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(alone)


def _marked(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Texts whose id's bit is set in a bitmap of the members' ids, so the others don't move to the join that decides.

    The bitmap has ``ID_BITS`` bits whatever the number of members, in rows of 4 KB: 16 MB at most. With more members
    more texts pass for nothing; none that belongs is lost.
    """
    at = (F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS)) + 1).cast("long")
    bits = members.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("place"))
    bits = bits.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.col("bits").substr((F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = texts.withColumn("bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "bucket")
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).select("doc_id", "text")


def _by_rep(edges: DataFrame, rep_of: DataFrame) -> DataFrame:
    """Edges between the representatives of their ends' sets, each once."""
    ends = edges.join(rep_of.toDF("u", "a"), "u").join(rep_of.toDF("v", "b"), "v").where("a != b")
    return ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _stars(buckets: DataFrame) -> DataFrame:
    """Edges of large keys: documents with enough of them, each with the smallest one of the key."""
    large = buckets.where("v IS NULL").select("key", "u", "part", "need")
    enough = large.groupBy("u", "part").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need").select("u", "part")
    kept = large.select("key", "u", "part").join(enough, ["u", "part"], "left_semi")
    least = kept.groupBy("key").agg(F.min("u").alias("v"))
    return kept.select("key", "u").join(least, "key").where("u != v").select("u", "v").distinct()


def _sets(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, levels = Shingler(width), Levels(percent)

        def out():
            for doc, text in rows(batches):
                items = shingles(text)
                digest = xxhash.xxh3_128_digest(items.tobytes())
                found = levels.of(len(items)) if len(items) else []
                keys = [(2 * level.no + k, need, part) for level in found for k, (part, need) in enumerate(fragment_keys(items, level))]
                parts = np.array([(no, need, len(part)) for no, need, part in keys], np.int32).tobytes()
                yield doc, len(items), *np.frombuffer(digest, "<i8").tolist(), fragment_marks(items, found), b"".join(part.tobytes() for _, _, part in keys), parts

        yield from batches_of(SETS, out())

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of a set."""
    keys, docs, parts, held = [], [], [], 0
    for doc, packed, about in rows(batches):
        if packed:
            sizes = np.frombuffer(about, np.int32).reshape(-1, 3)
            keys.append(np.frombuffer(packed, np.uint64))
            docs.append(np.full(len(keys[-1]), doc, np.int64))
            parts.append(np.repeat(sizes[:, :2], sizes[:, 2], axis=0))
            held += len(keys[-1])
        if held >= 200_000:
            yield _spread(keys, docs, parts)
            keys, docs, parts, held = [], [], [], 0
    if held:
        yield _spread(keys, docs, parts)


def _places(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key and document: the number of the row's document among those of its key, and how many those are."""
    new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
    new_doc = new_key | np.concatenate([[True], docs[1:] != docs[:-1]])
    count, starts = np.cumsum(new_doc), np.flatnonzero(new_key)
    rows_of = np.diff(np.append(starts, len(keys)))
    size = np.diff(np.append(count[starts], count[-1] + 1))
    return count - np.repeat(count[starts], rows_of), np.repeat(size, rows_of)


def _spread(keys: list[np.ndarray], docs: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of keys; of a key with more than BUCKET documents one more than that go to its task, the others anywhere."""
    key, doc, part = np.concatenate(keys), np.concatenate(docs), np.concatenate(parts)
    order = np.lexsort((doc, key))
    key, doc, part = key[order], doc[order], part[order]
    away = _places(key, doc)[0] > BUCKET
    to = np.where(away, key ^ mix(doc.astype(np.uint64)), key)
    about = part[:, 0].astype(np.int64) << 32 | part[:, 1] | np.where(away, ELSEWHERE, 0)
    return pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(doc), pa.array(about)], schema=KEYS)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of small keys and memberships in large ones, of rows sorted by key and document; of a key that goes on
    no more than a batch and a few rows are held."""

    def member(table: np.ndarray) -> pa.RecordBatch:
        key, doc, about = table
        part, need = (about >> 32).astype(np.int32), (about & 0xFFFFFFFF).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.nulls(len(doc), pa.int64()), pa.array(key), pa.array(part), pa.array(need)], schema=BUCKETS)

    def drain(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, doc = table[0], table[1]
        place, size = _places(key, doc)
        if (size > BUCKET).any():
            yield member(table[:, size > BUCKET])
        first = (size > 1) & (size <= BUCKET) & np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[first], doc[first]
        pairs = []
        for step in range(1, BUCKET):
            i = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else np.empty(0, np.int64)
            if not len(i):
                break
            pairs.append(np.stack([doc[i], doc[i + step]], 1))
        if pairs:
            found = _distinct(*np.concatenate(pairs).T)
            none = pa.nulls(len(found), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.nulls(len(found), pa.int64()), none, none], schema=BUCKETS)

    held, hot = np.empty((3, 0), np.int64), None
    for batch in batches:
        table = np.stack([column.to_numpy() for column in batch.columns])
        known = table[2] >= ELSEWHERE
        if known.any():
            away = table[:, known]
            away[0] ^= mix(away[1].astype(np.uint64)).view(np.int64)
            away[2] -= ELSEWHERE
            yield member(away)
            table = table[:, ~known]
        if hot is not None and table.shape[1]:  # more rows of a key that has been found to be large
            more = table[0] == hot
            if more.any():
                yield member(table[:, more])
                table = table[:, ~more]
            if table.shape[1]:
                hot = None
        held = np.concatenate([held, table], axis=1)
        if held.shape[1]:
            last = int(np.searchsorted(held[0], held[0, -1]))
            if last:
                yield from drain(held[:, :last])
            held = held[:, last:]
            if held.shape[1] > 4096 and _places(held[0], held[1])[1][0] > BUCKET:
                yield member(held)
                hot, held = int(held[0, 0]), held[:, :0]
    if held.shape[1]:
        yield from drain(held)


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(percent)
        yield from batches_of(EDGES, ((u, v) for u, n_u, marks_u, v, n_v, marks_v in rows(batches) if can_link(n_u, marks_u, n_v, marks_v, levels)))

    return run


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)

        def out():
            for cluster, blocks, block, doc, h1, h2, copies, text in rows(batches):
                items = shingles(text).tobytes()
                # of rows that share an id those with another set are members of their own
                if np.frombuffer(xxhash.xxh3_128_digest(items), "<i8").tolist() == [h1, h2]:
                    yield cluster, blocks, block, doc, h1, h2, copies, items

        yield from batches_of(MEMBERS, out(), size=1024)

    return run


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for (_, i, j), found in groups(batches, 3):
                # rows that repeat an id have the same set: one of them counts
                found = list({x[2:4]: x for x in found}.values())
                block, ids, copies = (np.array([x[k] for x in found]) for k in (0, 1, 4))
                items = [np.frombuffer(x[5], np.uint64) for x in found]
                left = np.flatnonzero(block == i)
                right = left if i == j else np.flatnonzero(block == j)
                if len(left) and len(right):
                    links = linked([items[x] for x in left], [items[x] for x in right], percent)
                    if i == j:
                        np.fill_diagonal(links, False)
                    for at, n in [*zip(left, links @ copies[right], strict=True), *(zip(right, copies[left] @ links, strict=True) if i != j else ())]:
                        if n:
                            yield None, None, *found[at][2:4], int(n)
                    nodes = np.concatenate([ids[left], ids[right]])
                    yield from ((int(nodes[a]), int(nodes[b]), None, None, None) for a, b in forest(links) if nodes[a] != nodes[b])

        yield from batches_of(LINKS, out())

    return run


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """Which pairs link. Partial overlaps are counted in one fragment of the global order after another and summed."""
    a, b = np.concatenate(left), np.concatenate(right)
    size_a, size_b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    row_a, row_b = np.repeat(np.arange(len(left)), size_a), np.repeat(np.arange(len(right)), size_b)
    shared = np.intersect1d(a, b)
    at_a, at_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    in_a = (at_a < len(shared)) & (shared[np.minimum(at_a, len(shared) - 1)] == a) if len(shared) else np.zeros(len(a), bool)
    in_b = (at_b < len(shared)) & (shared[np.minimum(at_b, len(shared) - 1)] == b) if len(shared) else np.zeros(len(b), bool)
    at_a, row_a, at_b, row_b = at_a[in_a], row_a[in_a], at_b[in_b], row_b[in_b]
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    at_a, row_a, at_b, row_b = at_a[order_a], row_a[order_a], at_b[order_b], row_b[order_b]
    overlap = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, len(shared), columns):
        width = min(columns, len(shared) - start)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        p, q = np.searchsorted(at_a, [start, start + width])
        x[row_a[p:q], at_a[p:q] - start] = 1
        p, q = np.searchsorted(at_b, [start, start + width])
        y[row_b[p:q], at_b[p:q] - start] = 1
        overlap += (x @ y.T).astype(np.int64)
    union = size_a[:, None] + size_b[None, :] - overlap
    return (100 * overlap >= percent * union) & (union > 0)
