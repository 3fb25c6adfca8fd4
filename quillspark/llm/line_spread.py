"""Line dedup by the spread of a line over distinct sites. DataFrame operations only.

Each line's digest gets a HyperLogLog sketch of the sites it occurs on; sketches merge by aggregation, first in each
task. Lines whose estimate is far from the threshold are decided by it; those near it get exact distinct counts. A
line spread over enough sites is boilerplate: its first occurrence stays, all others go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._rows import col, free
from quillspark.plans.storage import Workspace


@dataclass(frozen=True)
class Spread:
    """min_sites: distinct sites that make a line boilerplate. band: the share around it that is counted exactly.
    lg_k: logarithm of a sketch's registers; at 8 the standard error is 6.5 %, a seventh of the band."""

    min_sites: int = 10
    band: float = 0.5
    lg_k: int = 8


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``id_, site_, at_, line_``: every line with a character besides white space, trimmed of ASCII white space."""
    split = F.posexplode(F.split(F.coalesce(col(text_col), F.lit("")), "\n", -1)).alias("at_", "line_")
    lines = docs.select(col(id_col).alias("id_"), col(site_col).alias("site_"), split)
    return lines.withColumn("line_", F.regexp_replace("line_", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).where("line_ != ''")


def boilerplate_lines(lines: DataFrame, spread: Spread) -> DataFrame:
    """``digest_, first_``: digests of lines on enough distinct sites, with the place of the first occurrence.

    Null sites count as no site. Lines need ``digest_, site_, id_, at_``. What the sketches leave open is written
    once, and only lines near the threshold are counted exactly: a semi join keeps the others out of that count.
    """
    low, high = spread.min_sites * (1 - spread.band), spread.min_sites * (1 + spread.band)
    # sketches begin in each task, so a line that is everywhere shuffles as a row for each task
    sketched = lines.groupBy("digest_").agg(F.hll_sketch_agg("site_", spread.lg_k).alias("sketch"), F.min(F.struct("id_", "at_")).alias("first_"))
    estimated = sketched.select("digest_", "first_", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= low)
    estimated = Workspace(lines.sparkSession, "spread").save(estimated)
    sure = estimated.where(F.col("estimate") > high).select("digest_", "first_")
    near = estimated.where(F.col("estimate") <= high).select("digest_", "first_")
    sites = lines.where("site_ IS NOT NULL").select("digest_", "site_").join(near.select("digest_"), "digest_", "left_semi").distinct()
    counted = sites.groupBy("digest_").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= spread.min_sites)
    return sure.unionByName(near.join(counted.select("digest_"), "digest_", "left_semi"))


def removed_name(columns: list[str]) -> str:
    """The name of the column that ``remove_boilerplate`` adds to these."""
    return free("removed_", columns)


def remove_boilerplate(docs: DataFrame, spread: Spread | None = None, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The input's rows and columns, with the text less its boilerplate lines, and ``removed_`` (how many lines went).

    A kept line keeps its white space and order. The first occurrence, by id and line number, of a boilerplate line
    stays. Null texts stay null, blank lines stay, rows with a null id keep their text. Rows that repeat an id are
    taken as one document for what is first. Lines are compared after trimming ASCII white space. Texts are read whole,
    whatever their length. Other columns pass whatever their names; if one is called ``removed_``, the added name takes
    underscores until it is free (``removed_name``). An empty table gives an empty result.
    """
    spread = spread or Spread()
    work = Workspace(docs.sparkSession, "lines")
    lines = lines_of(docs.where(col(id_col).isNotNull()), id_col, text_col, site_col).select("id_", "site_", "at_", F.unhex(F.md5("line_")).alias("digest_"))
    lines = work.save(lines)
    spread_wide = work.save(boilerplate_lines(lines, spread))
    gone = lines.join(spread_wide, "digest_").where(F.struct("id_", "at_") != F.col("first_"))
    key, places = free("id_", docs.columns), free("gone_", docs.columns)
    gone = work.save(gone.groupBy("id_").agg(F.array_sort(F.collect_set("at_")).alias("gone_")).toDF(key, places))
    work.drop(lines)
    work.drop(spread_wide)
    split = F.split(col(text_col), "\n", -1)
    # the places of the lines that stay, by a hash-based difference, so that the work is linear in the lines
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), col(places))
    text = F.when(col(places).isNull(), col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    # the same join at every size: a broadcast of what goes would not last as it grows with the corpus
    joined = docs.join(gone.hint("merge"), col(id_col) == col(key), "left")
    kept = [col(c) if c.lower() != text_col.lower() else text.alias(c) for c in docs.columns]
    return joined.select(*kept, F.coalesce(F.size(col(places)), F.lit(0)).alias(removed_name(docs.columns)))
