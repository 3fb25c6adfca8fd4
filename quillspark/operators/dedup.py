"""Dedup of mentions within a document and type: names, coreference scores, shared citations and acronyms.

Everything is keyed by (doc_id, type). Only linkage and components, whose size a document bounds, run in Python.
A group's id is its smallest candidate number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import acronym, all_citations, contains_acronym, is_acronym, quoted, starts_of
from quillspark.plans.storage import Workspace

KEYS = ["doc_id", "type"]


def name_groups(mentions: DataFrame) -> DataFrame:
    """``doc_id, type, name, first, n``: each exact name with its first candidate number and mentions."""
    return mentions.where("name IS NOT NULL").groupBy(*KEYS, "name").agg(F.min("cand_no").alias("first"), F.count(F.lit(1)).alias("n"))


def name_paragraphs(mentions: DataFrame) -> DataFrame:
    """The paragraphs in which a name occurs."""
    return mentions.where("name IS NOT NULL").groupBy(*KEYS, "name").agg(F.array_sort(F.collect_set(F.struct("sec", "par"))).alias("places"))


def name_pairs(names: DataFrame) -> DataFrame:
    """Each two names of a document and type once, the earlier first."""
    a, b = names.select(*KEYS, F.col("name").alias("name_a"), F.col("first").alias("first_a")), names.select(*KEYS, F.col("name").alias("name_b"), F.col("first").alias("first_b"))
    return a.join(b, KEYS).where("first_a < first_b OR (first_a = first_b AND name_a < name_b)").select(*KEYS, "name_a", "name_b")


def mean_pair_scores(pairs: DataFrame) -> DataFrame:
    """Mean of corefer + parent + child over the scored pairs of two names."""
    return pairs.groupBy(*KEYS, "name_a", "name_b").agg(F.avg(F.col("corefer") + F.col("parent") + F.col("child")).alias("score"))


def average_linkage(n: int, scores: dict[tuple[int, int], float], cut: float = 0.5) -> list[int]:
    """Labels 0.. in order of first members: clusters merge while their mean distance (1 - score) is below the cut.

    Sums of distances between clusters are kept and added when two merge; no mean is computed anew from the members.
    """
    total = np.ones((n, n))
    for (i, j), score in scores.items():
        total[i, j] = total[j, i] = 1 - score
    clusters, sizes = [[i] for i in range(n)], np.ones(n)
    while len(clusters) > 1:
        mean = np.where(np.triu(np.ones_like(total), 1) > 0, total / np.outer(sizes, sizes), np.inf)
        a, b = divmod(int(mean.argmin()), len(clusters))
        if mean[a, b] >= cut:
            break
        clusters[a] += clusters.pop(b)
        total[a] += total[b]
        total[:, a] += total[:, b]
        sizes[a] += sizes[b]
        total, sizes = np.delete(np.delete(total, b, 0), b, 1), np.delete(sizes, b)
    labels = [0] * n
    for label, members in enumerate(sorted(map(sorted, clusters))):
        for i in members:
            labels[i] = label
    return labels


def group_names(names: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Adds ``grp``: the group of a name. Without coreference scores every name is its own."""
    if scores is None:
        return names.withColumn("grp", F.col("first"))
    schema = f"{_ddl(names)}, grp int"

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["first", "name"]).reset_index(drop=True)
        at = {name: i for i, name in enumerate(left["name"])}
        found = {(at[a], at[b]): s for a, b, s in zip(right["name_a"], right["name_b"], right["score"], strict=True)}
        label = pd.Series(average_linkage(len(left), found), dtype="int64")
        return left.assign(grp=left.groupby(label)["first"].transform("min").astype("int32"))

    right = scores.select(*KEYS, "name_a", "name_b", "score").toDF(*KEYS, "name_a", "name_b", "score")
    return names.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInPandas(run, schema)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def attach_unnamed(mentions: DataFrame, similarity: Callable[[str, str], float] | None = None, least: float = 0.5) -> DataFrame:
    """Adds ``label``: the name of a mention's cluster, or Unnamed_k for those without one, k by first mention.

    With a similarity of two annotated texts, a mention without a name joins the most similar name of its paragraph if
    the mean similarity exceeds ``least``; others of one paragraph cluster by average linkage, and each such cluster
    joins the most similar name of any paragraph on the same condition. Clusters are frozen while a step compares.
    """
    if similarity is None:
        order = Window.partitionBy(*KEYS, F.col("name").isNull()).orderBy("cand_no")
        return mentions.withColumn("label", F.coalesce("name", F.concat(F.lit("Unnamed_"), F.row_number().over(order) - 1)))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("cand_no").reset_index(drop=True)
        texts, places = df["annotated"].tolist(), list(zip(df["sec"], df["par"], strict=True))
        names = df["name"].where(df["name"].notna(), None).tolist()
        members: dict[str, list[int]] = {}
        for i, name in enumerate(names):
            if name is not None:
                members.setdefault(name, []).append(i)
        label = list(names)

        def best(rows: list[int], among: list[str]) -> str | None:
            means = [(sum(similarity(texts[i], texts[j]) for i in rows for j in members[n]) / (len(rows) * len(members[n])), -k, n) for k, n in enumerate(among)]
            top = max(means, default=None)
            return top[2] if top and top[0] > least else None

        left = []
        for i in (i for i, name in enumerate(names) if name is None):
            label[i] = best([i], [n for n, rows in members.items() if any(places[j] == places[i] for j in rows)])
            if label[i] is None:
                left.append(i)
        scores = {(a, b): similarity(texts[left[a]], texts[left[b]]) for a in range(len(left)) for b in range(a + 1, len(left)) if places[left[a]] == places[left[b]]}
        clusters: dict[int, list[int]] = {}
        for i, k in zip(left, average_linkage(len(left), scores), strict=True):
            clusters.setdefault(k, []).append(i)
        number = 0
        for rows in clusters.values():
            name = best(rows, list(members))
            if name is None:
                name, number = f"Unnamed_{number}", number + 1
            for i in rows:
                label[i] = name
        return df.assign(label=label)

    return mentions.groupBy(*KEYS).applyInPandas(run, f"{_ddl(mentions)}, label string")


def closest_citation(mentions: DataFrame) -> DataFrame:
    """``doc_id, type, name, cand_no, citation``: the citation nearest to a mention's name in its snippet.

    Distances are between starts; ties go to the smaller citation text, then the earlier place. A citation is dropped
    if another name of the document and type begins nearer to it, unless that name lies inside the citation.
    """
    named = mentions.where("name IS NOT NULL").select(*KEYS, "name", "cand_no", "text", F.array_distinct(all_citations("citations")).alias("marks"))
    others = named.groupBy(*KEYS).agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = named.where(F.size("marks") > 0).join(others, KEYS)
    own = starts_of("text", quoted("name"), F.length("name"))
    spans = F.flatten(F.transform("marks", lambda m: F.transform(starts_of(F.col("text"), quoted(m), F.length(m)), lambda s: F.struct(m.alias("mark"), s.alias("at")))))
    rows = rows.withColumn("own", own).withColumn("spans", spans)
    ranked = F.flatten(F.transform("spans", lambda c: F.transform("own", lambda o: F.struct(F.abs(c["at"] - o).alias("dist"), c["mark"].alias("mark"), c["at"].alias("at")))))
    rows = rows.withColumn("best", F.array_min(ranked)).where("best IS NOT NULL")

    def nearer(n):
        def start_is(s):
            inside = (s >= F.col("best.at")) & (s + F.length(n) <= F.col("best.at") + F.length("best.mark"))
            return ~inside & (F.abs(F.col("best.at") - s) < F.col("best.dist"))

        return (n != F.col("name")) & F.exists(starts_of(F.col("text"), quoted(n), F.length(n)), start_is)

    return rows.where(~F.exists("names", nearer)).select(*KEYS, "name", "cand_no", F.col("best.mark").alias("citation"))


def citation_of_name(closest: DataFrame) -> DataFrame:
    """``doc_id, type, name, citation``: the most frequent one, the first mentioned among equals."""
    counted = closest.groupBy(*KEYS, "name", "citation").agg(F.count(F.lit(1)).alias("k"), F.min("cand_no").alias("at"))
    return counted.groupBy(*KEYS, "name").agg(F.max_by("citation", F.struct("k", -F.col("at"))).alias("citation"))


def citation_edges(groups: DataFrame, citations: DataFrame) -> DataFrame:
    """``doc_id, type, a, b``: groups whose names share a citation, each with the smallest such group."""
    shared = groups.join(citations, [*KEYS, "name"]).select(*KEYS, "citation", "grp").distinct()
    least = F.min("grp").over(Window.partitionBy(*KEYS, "citation"))
    return shared.withColumn("a", least).where("a < grp").select(*KEYS, "a", F.col("grp").alias("b")).distinct()


def acronym_edges(groups: DataFrame) -> DataFrame:
    """``doc_id, type, a, b``: a group of a single name that is an acronym with two mentions or more, and a group with
    a name that contains it or whose first letters it is."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "grp"))
    short = groups.withColumn("names", size).where((F.col("names") == 1) & (F.col("n") >= 2) & is_acronym("name")).select(*KEYS, F.col("name").alias("short"), F.col("grp").alias("b"))
    joined = groups.select(*KEYS, "name", F.col("grp").alias("a")).join(short, KEYS).where("a != b")
    return joined.where(contains_acronym("name", "short") | (acronym("name") == F.col("short"))).select(*KEYS, "a", "b").distinct()


def merge_groups(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups with ``grp`` replaced by the smallest group reachable by edges of the document and type.

    Only documents and types with edges go through Python, one row each and many rows a batch.
    """
    kind = groups.schema["grp"].dataType.simpleString()

    def reached(edges) -> list[dict]:
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for edge in edges:
            a, b = sorted((root(edge["a"]), root(edge["b"])))
            parent[b] = a
        return [{"grp": x, "root": root(x)} for x in parent]

    @F.pandas_udf(f"array<struct<grp:{kind},root:{kind}>>")
    def roots(edges: pd.Series) -> pd.Series:
        return edges.map(reached)

    held = edges.groupBy(*KEYS).agg(F.collect_set(F.struct(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))).alias("e"))
    found = held.select(*KEYS, F.inline(roots("e"))).toDF(*KEYS, "grp", "root_")  # new column identities: both sides come from the groups
    return groups.join(found, [*KEYS, "grp"], "left").withColumn("grp", F.coalesce("root_", "grp")).select(*groups.columns)


def deduplicate(mentions: DataFrame, scores: DataFrame | None = None, similarity: Callable[[str, str], float] | None = None) -> DataFrame:
    """Valid mentions with ``label`` (the name, or Unnamed_k) and ``cluster`` (name_cluster_k, or Unnamed).

    Labelled mentions and groups are written once, since several steps read them, and so is the result.
    """
    work = Workspace(mentions.sparkSession, "dedup")
    labelled = work.save(attach_unnamed(mentions.where("valid AND NOT skipped"), similarity))
    groups = work.save(group_names(name_groups(labelled), scores))
    by_citation = citation_edges(groups, citation_of_name(closest_citation(labelled)))
    merged = work.save(merge_groups(groups, by_citation))
    merged = merge_groups(merged, acronym_edges(merged)).select(*KEYS, F.col("name").alias("label"), "grp")
    cluster = F.when(F.col("grp").isNull(), "Unnamed").otherwise(F.concat(F.lit("name_cluster_"), "grp"))
    return work.save(labelled.join(merged, [*KEYS, "label"], "left").withColumn("cluster", cluster).drop("grp"))


def without_dedup(mentions: DataFrame) -> DataFrame:
    """Each name its own cluster, as when dedup is switched off."""
    labelled = attach_unnamed(mentions.where("valid AND NOT skipped"))
    first = F.min("cand_no").over(Window.partitionBy(*KEYS, "name"))
    return labelled.withColumn("cluster", F.when(F.col("name").isNull(), "Unnamed").otherwise(F.concat(F.lit("name_cluster_"), first)))
