"""Ranked entity search, lookup, similarity shortlists and name joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.names import SHORTEST_PREFIX, SIMILAR, normalize_name, word_similarity, word_trigrams
from ..plans.params import SearchParams

# What lifts a hit.
PREFIX, OPEN, MONEY_SCALE, MONEY_MOST = 0.35, 0.15, 5_000_000.0, 0.15
#: Names of either side that are compared in memory at a time, and shared rare trigrams a pair from which that is done.
TILE_LEFT, TILE_RIGHT, DENSE = 1 << 14, 1 << 15, 1 / 64
#: Buckets of trigrams whose counts are broadcast; those that share one count as equally rare.
BUCKETS = 1 << 16


def search_score(name: Column, needle: Column, traversable: Column, received: Column) -> Column:
    lifted = F.when(F.startswith(name, needle), PREFIX).otherwise(0.0) + F.when(traversable, OPEN).otherwise(0.0)
    return (word_similarity(name, needle) + lifted + F.least(F.coalesce(received, F.lit(0)).cast("double") / MONEY_SCALE, F.lit(MONEY_MOST))).cast("float")


def search(entities: DataFrame, p: SearchParams) -> DataFrame:
    """The best hits. A needle that normalizes to nothing is part of every name."""
    n, name = normalize_name(F.lit(p.q)), F.col("normalized_name")
    hits = entities.filter(F.contains(name, n) | (word_similarity(name, n) >= SIMILAR))
    if p.traversable_only:
        hits = hits.filter("is_traversable")
    return hits.withColumn("score", search_score(name, n, F.col("is_traversable"), F.col("total_received"))).orderBy(F.desc("score"), F.desc("total_received"), "id").limit(p.limit)


def lookup(entities: DataFrame, entity: str) -> DataFrame:
    return entities.filter(F.col("id") == entity).withColumn("score", F.lit(1.0).cast("float"))


def exact_resolve(names: DataFrame, entities: DataFrame) -> DataFrame:
    """``names`` (n) with the smallest id of that normal form, or null."""
    return names.join(entities.groupBy(F.col("normalized_name").alias("n")).agg(F.min("id").alias("entity_id")), "n", "left")


def alias_resolve(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``names`` (n) with the entity of the most confident alias, ties by id. Aliases aggregate first."""
    order = F.struct(-F.col("confidence"), F.col("entity_id"))
    best = aliases.groupBy(F.col("normalized_alias").alias("n")).agg(F.min_by(F.struct("entity_id", "confidence"), order).alias("b"))
    return names.join(best.select("n", "b.entity_id", "b.confidence"), "n")


def prefix_resolve(names: DataFrame, entities: DataFrame, shortest: int = SHORTEST_PREFIX) -> DataFrame:
    """``names`` (n) that begin exactly one entity's normal form: n and entity_id. An equi-join on the first letters
    carries the prefix test, as a bare one would compare all with all."""
    key = lambda c: F.substring(c, 1, shortest)
    left = names.filter(F.length("n") >= shortest).select("n", key("n").alias("_k"))
    right = entities.filter(F.length("normalized_name") >= shortest).select("id", "normalized_name", key("normalized_name").alias("_k"))
    hits = left.join(right, "_k").filter(F.startswith("normalized_name", "n"))
    return hits.groupBy("n").agg(F.count("*").alias("_c"), F.min("id").alias("entity_id")).filter("_c = 1").drop("_c")


def _alike_in_tiles(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs (id, other) of similarity ``least`` or more, maybe a few others: each tile of ``a`` (id, g) meets each of ``b`` in memory.

    Trigrams are counted by 32-bit hashes without removing equal ones, so a clash can only raise what a pair has in common.
    """
    p, q = (-(-d.count() // size) or 1 for d, size in ((a, TILE_LEFT), (b, TILE_RIGHT)))
    tiled = lambda d, own, tiles, other, others: d.select("id", F.transform("g", lambda t: F.hash(t)).alias("h"), F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))
    schema = StructType([StructField("id", a.schema["id"].dataType), StructField("other", b.schema["id"].dataType)])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = left["h"].combine_chunks(), right["h"].combine_chunks()
        rows, others = [], []
        if len(x) and len(y):
            (sx, tx), (sy, ty) = ((v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)) for v in (x, y))
            order = np.argsort(ty, kind="stable")
            owner = np.repeat(np.arange(len(sy)), sy)[order]
            low, high, ends, most = np.searchsorted(ty[order], tx), np.searchsorted(ty[order], tx, "right"), np.cumsum(sx), least * sy
            for i, (end, size) in enumerate(zip(ends, sx, strict=True)):
                common = np.bincount(np.concatenate([owner[j:k] for j, k in zip(low[end - size : end], high[end - size : end], strict=True)]), minlength=len(sy))
                hit = np.flatnonzero(common * (1 + least) >= most + least * size - 1e-6)
                rows.append(np.full(len(hit), i))
                others.append(hit)
        take = lambda t, at: t["id"].take(pa.array(np.concatenate(at) if at else [], pa.int64()))
        return pa.table({"id": take(left, rows), "other": take(right, others)})

    return tiled(a, "p", p, "q", q).groupBy("p", "q").cogroup(tiled(b, "q", q, "p", p).groupBy("p", "q")).applyInArrow(compare, schema)


def similarity_shortlist(left: DataFrame, right: DataFrame, k: int | None = 10, least: float = SIMILAR, dense: float | None = None) -> DataFrame:
    """For each name of ``left`` (id, n) the ``k`` most similar of ``right`` (id, n): id, other, similarity, rank.

    Prefix filter: with all trigrams in one order, rare ones first, two names of similarity t or more share one of the first
    size - ceil(t * size) + 1. Only those are joined, so common trigrams, which stand last, seldom are; candidates are then
    compared on their full sets. No pair is lost.

    Where names are of few trigrams, none is rare, and the join has more rows than any disk. With ``dense``, its rows are counted
    first, and if they are that many a pair of names or more, names are compared in tiles instead; the result is the same. That
    shuffles names, not their trigrams: counts of buckets are broadcast, and a name's trigrams are put in order where they are made.
    """
    a, b = (d.select("id", "n", word_trigrams(F.col("n")).alias("g")).filter(F.size("g") > 0) for d in (left, right))
    met_with = F.col("t") if dense is None else F.pmod(F.hash("t"), F.lit(BUCKETS))
    counts = a.select(F.explode("g").alias("t")).unionByName(b.select(F.explode("g").alias("t"))).groupBy(met_with.alias("k")).agg(F.count("*").alias("c"))

    def probes(d: DataFrame) -> DataFrame:
        if dense is not None:  # a number of partitions, or so few bytes would come into one
            parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            d = d.select("id", "n").repartition(parts, "id").select("id", word_trigrams(F.col("n")).alias("g"))
        flat = d.select("id", F.size("g").alias("s"), F.explode("g").alias("t")).withColumn("k", met_with).join(counts if dense is None else F.broadcast(counts), "k")
        ordered = flat.groupBy("id", "s").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("o"))  # a name's own trigrams
        return ordered.select("id", "s", F.explode(F.slice(F.col("o.t"), F.lit(1), F.col("s") - F.ceil(F.col("s") * least - 1e-9).cast("int") + 1)).alias("t"))

    pa_, pb = probes(a), probes(b).withColumnsRenamed({"id": "other", "s": "s2"})
    if dense is not None:
        each = pa_.groupBy("t").agg(F.count("*").alias("x")).join(pb.groupBy("t").agg(F.count("*").alias("y")), "t")
        met = each.agg(F.sum(F.col("x").cast("double") * F.col("y"))).first()[0] or 0.0
    if dense is not None and met >= dense * a.count() * b.count():
        pairs = _alike_in_tiles(a, b, least).distinct()
    else:
        pairs = pa_.join(pb, "t").filter((F.least("s", "s2") >= least * F.greatest("s", "s2"))).select("id", "other").distinct()
    full = pairs.join(a.select("id", "g"), "id").join(b.select(F.col("id").alias("other"), F.col("g").alias("h")), "other")
    common = F.size(F.array_intersect("g", "h"))
    scored = full.withColumn("similarity", common / (F.size("g") + F.size("h") - common)).filter(F.col("similarity") >= least).select("id", "other", "similarity")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other")))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)
