"""Entity resolution of a batch of names: exact, alias, unambiguous prefix, similarity, else a new entity.

The outcome is that of taking the mentions one by one in order, each seeing the entities that earlier ones created. Names are
resolved once each, at their first mention. The cheap steps are joins. The rest depends on order only through pairs of new
names that are alike enough to matter, so those pairs' connected components are decided independently, in order within each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.text import classify_contributor, kind_from_hint
from ..plans.store import cut
from ..schemas import digest_id
from .components import components
from .load import first_by
from .search import DENSE, similarity_shortlist


def entity_kind(recipient: Column, tag: Column, hint: Column, raw: Column, occupation: Column) -> Column:
    """A recipient with a type tag is a committee, without one a candidate; a contributor goes by hint, else by its name."""
    return F.when(recipient, F.when(tag.isNotNull(), "committee").otherwise("candidate")).otherwise(F.coalesce(kind_from_hint(hint), classify_contributor(raw, occupation)))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components in order of first mention. Rows, in order of comp, place and n: name n, place, truncated, candidate x (None: a name
    without any), old (whether x is an entity already), target (its id), similarity, score, starts (x begins with n)."""
    made: set[str] = set()  # names of this component that became entities
    comp = None

    def one(rows: list[dict]) -> tuple:
        n, own = rows[0]["n"], rows[0]["own"]
        seen = [r for r in rows if r["x"] is not None and (r["old"] or r["x"] in made)]
        begun = [r for r in seen if r["starts"]]
        link, confidence, method, miss, near = None, 1.0, "created", None, None
        if rows[0]["truncated"] and len(n) >= N.SHORTEST_PREFIX and len(begun) == 1:
            link, confidence, method = begun[0]["target"], N.PREFIX_SCORE, "prefix"
        elif seen:
            short = sorted(seen, key=lambda r: (-r["similarity"], r["target"]))[: rows[0]["limit"] or None]
            best = max(short, key=lambda r: -1.0 if r["score"] is None else r["score"])  # the first of equal ones
            score = -1.0 if best["score"] is None else best["score"]
            if score >= N.AUTO_LINK:
                link, confidence, method = best["target"], score, "similarity"
            elif score >= N.REVIEW_FLOOR:
                miss, near = best["target"], score
        if link is None:
            made.add(n)
        return n, link or own, confidence, method, miss, near

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.float64())
        columns = zip(*out, strict=True) if out else ((),) * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["n", "entity_id", "confidence", "method", "miss", "miss_score"])

    rows: list[dict] = []
    for b in batches:
        out = []
        for r in b.to_pylist():
            if rows and (r["comp"], r["n"]) != (rows[0]["comp"], rows[0]["n"]):
                out.append(one(rows))
                rows = []
            if r["comp"] != comp:
                comp = r["comp"]
                made.clear()
            rows.append(r)
        yield batch(out)
    if rows:
        yield batch([one(rows)])


def resolve_batch(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, shortlist: int | None = 10, strict_prefix: bool = False, alias_floor: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, new entities, new aliases).

    ``mentions``: place (long, the order), raw, recipient (boolean), hint, zip, city, occupation. ``entities``: id, name,
    normalized_name, zip, city. ``aliases``: entity_id, normalized_alias, confidence. ``resolved``: place, n, entity_id,
    confidence, method; later mentions of a name have confidence 1 and method cache. Names that normalize to nothing are left
    out; the caller counts them as skipped. ``shortlist``: only that many most similar candidates are scored, and components
    hold all pairs of similarity .3 and more; with None, all candidates that can matter are scored.
    """
    named = mentions.withColumns({"n": N.normalize_name(F.col("raw")), "truncated": N.looks_truncated(F.col("raw"))}).filter("n <> ''")
    first = cut(first_by(named, ["n"], ["place"]))
    old = entities.groupBy("normalized_name").agg(F.min_by(F.struct("id", "name", "zip", "city"), "id").alias("e")).select(F.col("normalized_name").alias("x"), "e.*")
    exact = first.join(old.select(F.col("x").alias("n"), F.col("id").alias("entity_id")), "n").select("n", "entity_id", F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"))
    best = aliases.filter(F.col("confidence") >= alias_floor).groupBy(F.col("normalized_alias").alias("n")).agg(F.min_by(F.struct("entity_id", "confidence"), F.struct(-F.col("confidence"), F.col("entity_id"))).alias("b"))
    alias = first.join(exact.select("n"), "n", "left_anti").join(best, "n").select("n", "b.entity_id", F.col("b.confidence").cast("double").alias("confidence"), F.lit("alias").alias("method"))
    rest = cut(first.join(exact.select("n").unionByName(alias.select("n")), "n", "left_anti").withColumns({"own": digest_id(F.col("n")), "shown": N.display_name(F.col("raw"))}))

    pool = old.select("x", F.col("id").alias("target"), N.normalize_name(F.col("name")).alias("normal"), "zip", "city", F.lit(True).alias("old"), F.lit(-1).cast("long").alias("at"))
    pool = cut(pool.unionByName(rest.select(F.col("n").alias("x"), F.col("own").alias("target"), N.normalize_name(F.col("shown")).alias("normal"), "zip", "city", F.lit(False).alias("old"), F.col("place").alias("at"))))
    alike = similarity_shortlist(rest.select(F.col("n").alias("id"), "n"), pool.select(F.col("x").alias("id"), F.col("x").alias("n")), None, dense=DENSE).select(F.col("id").alias("n"), F.col("other").alias("x"), "similarity")
    key = lambda c: F.substring(c, 1, N.SHORTEST_PREFIX)
    prefixed = rest.filter(F.length("n") >= N.SHORTEST_PREFIX).select("n", key("n").alias("k")).join(pool.filter(F.length("x") >= N.SHORTEST_PREFIX).select("x", key("x").alias("k")), "k").filter(F.startswith("x", "n")).select("n", "x")
    pairs = alike.unionByName(prefixed.withColumn("similarity", N.word_similarity(F.col("n"), F.col("x")))).distinct()
    # Profiles are made below the joins, once a name, from stored normal forms.
    a = rest.select("n", N.profile_from(F.col("n")).alias("pa"), "place", "truncated", F.col("zip").alias("za"), F.col("city").alias("ca"))
    both = pairs.join(a, "n").join(pool.withColumn("pb", N.profile_from(F.col("normal"))).drop("normal"), "x").filter("n <> x AND at < place")
    scored = both.withColumn("score", N.score_profiles(F.col("pa"), F.col("pb"), F.col("truncated"), F.col("za"), F.col("zip"), F.col("ca"), F.col("city"), strict_prefix)["score"]).withColumn("starts", F.startswith("x", "n"))
    if shortlist is None:
        scored = scored.filter((F.col("score") >= N.REVIEW_FLOOR) | (F.col("truncated") & F.col("starts")))
    scored = cut(scored.select("n", "x", "target", "old", "similarity", "score", "starts"))
    groups = components(scored.filter("NOT old").select(F.col("n").alias("a"), F.col("x").alias("b"))).select(F.col("id").alias("n"), "comp")
    rows = rest.select("n", "own", "place", "truncated").join(scored, "n", "left").join(groups, "n", "left").withColumns({"comp": F.coalesce("comp", "n"), "limit": F.lit(shortlist or 0)})
    decided = rows.repartition("comp").sortWithinPartitions("comp", "place", "n").mapInArrow(_decide, "n string, entity_id string, confidence double, method string, miss string, miss_score double")
    decided = cut(decided)

    by_name = cut(exact.unionByName(alias).unionByName(decided.select("n", "entity_id", "confidence", "method")))
    again = named.select("place", "n").join(first.select("n", F.col("place").alias("_first")), "n")
    later = F.col("place") != F.col("_first")
    resolved = again.join(by_name, "n").withColumns({"confidence": F.when(later, 1.0).otherwise(F.col("confidence")), "method": F.when(later, "cache").otherwise(F.col("method"))}).drop("_first")
    fresh = rest.join(decided.filter("method = 'created'").select("n"), "n", "left_semi")
    tag = N.split_type_tag(F.col("raw"))[1]
    kind = entity_kind(F.col("recipient"), tag, F.col("hint"), F.col("raw"), F.col("occupation"))
    created = fresh.withColumn("kind", kind).select(
        F.col("own").alias("id"), "kind", F.when(F.col("kind") == "individual", F.col("shown")).otherwise(N.split_type_tag(F.col("raw"))[0]).alias("name"), F.col("n").alias("normalized_name"),
        tag.alias("committee_type"), "zip", "city", "occupation", F.col("recipient").alias("is_traversable"),
    )
    learned = decided.filter("method IN ('prefix', 'similarity')").select("entity_id", "n", F.col("confidence"), (F.col("method") == "prefix").alias("is_truncated"))
    missed = decided.filter("miss IS NOT NULL").select(F.col("miss").alias("entity_id"), "n", F.col("miss_score").alias("confidence"), F.lit(False).alias("is_truncated"))
    new_aliases = learned.unionByName(missed).join(first.select("n", F.col("raw").alias("alias")), "n").withColumnRenamed("n", "normalized_alias").withColumn("origin", F.lit("resolved"))
    return resolved, created, new_aliases
