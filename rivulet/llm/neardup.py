"""MinHash near-duplicates with sequential Bayesian verification.

Equal word sequences are one node. Each node's shingle set gets a signature of ``BANDS * ROWS`` minima; nodes that agree in
all rows of a band are candidates. A candidate pair compares its signatures in batches and goes as soon as the posterior
chance that its similarity reaches the threshold falls below ``MISS`` (the similarity's prior is uniform, so the posterior
after m of n matches is Beta(1 + m, 1 + n - m)). Survivors are verified on their full shingle sets.

Only the components are wanted, so a band isn't paired out. First each node meets the smallest node of all its bands, then,
among those it is still apart from, the one it shares most bands with. Where that leaves several components in a band of two nodes, that pair is
compared unless it was; in a larger band, its nodes are compared across components in tiles, first by signatures and then by full sets,
and of the pairs found only those come out that join components; pairs inside a component need no comparison.
With 48 bands of 6 rows a pair of similarity 0.8 shares no band with a chance of 5e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..plans.store import release
from .common import FOLD, fresh, table, text_bytes, written

BANDS, ROWS = 48, 6
BATCH, MISS = 32, 1e-6
#: Members that meet one copy of the hub's text in verification.
SALT = 128
#: Nodes that are compared with as many others at a time, and bytes of their signatures and sets.
TILE, TILE_BYTES = 512, 4 << 20

_RANDOM = np.random.default_rng(20)
_MUL = (_RANDOM.integers(1, 2**63, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RANDOM.integers(0, 2**63, BANDS * ROWS, np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()  # bytes.split() parts at \x20 and \x09-\x0D, as wanted


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words are one shingle, none give an empty set."""
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(s: np.ndarray) -> bytes:
    """16 bits of each minimum."""
    low = np.full(len(_MUL), 2**64 - 1, np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, (s[i : i + 2048, None] * _MUL + _ADD).min(0))
    return ((low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype("<u2").tobytes()


def least_matches(n: int, percent: int, miss: float = MISS) -> int:
    """Fewest matches among n hashes with which a pair goes on: P(similarity >= percent) is then ``miss`` at least."""
    t, total = percent / 100, 0.0
    if t >= 1:
        return n
    for m in range(n + 1):  # P(Beta(1 + m, 1 + n - m) >= t) = P(Binomial(n + 1, t) <= m)
        total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
        if total >= miss:
            return m
    return n


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _key(words: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


#: What tells a row's text from others: its id and two hashes of the text. A common id or a common text alone is not a hot key then.
_ROW = ("doc", "th", "tm")


def _rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    said = F.col(text).cast("string")
    return docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(said).alias("th"), F.hash(said).alias("tm"), said.alias("text"))


def _texts(docs: DataFrame, wanted: DataFrame, doc: str, text: str) -> DataFrame:
    """``wanted`` (doc, th, tm and others, id among them) with ``text``, one row an id."""
    rows = _rows(docs, doc, text).select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("tm").alias("_tm"), "text")
    same = F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_th") == F.col("th")) & (F.col("_tm") == F.col("tm"))
    return rows.join(wanted, same).drop("_doc", "_th", "_tm", *_ROW).dropDuplicates(["id"])


def _signed(docs: DataFrame, doc: str, text: str, width: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in text_bytes(b.column("text")):
                words = words_of(t)
                s = shingles(words, width)
                rows.append((len(s), _key(words), signature(s) if len(s) else None))
            n, key, sig = zip(*rows, strict=True) if rows else ((), (), ())
            own = [pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _ROW), *own], names=[*_ROW, "n", "key", "sig"])

    return _rows(docs, doc, text).mapInArrow(sign, "doc long, th long, tm int, n long, key binary, sig binary")


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) that the posterior doesn't rule out."""
    least = [(n, least_matches(n, percent)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
            alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
            for n, m in least:
                matches = matches + (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1)
                on = matches >= m
                alive, matches = alive[on], matches[on]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("a", "b")], names=["a", "b"])

    one = nodes.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    two = nodes.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    sized = pairs.join(one, "a").join(two, "b").filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    return sized.select("a", "b", "sa", "sb").mapInArrow(keep, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, doc: str, text: str, width: int) -> DataFrame:
    """``wanted`` (id, doc, th, tm and others) with ``items``, the node's sorted shingles as little-endian unsigned 64-bit numbers."""
    names = [c for c in wanted.columns if c not in _ROW]
    schema = T.StructType([*[wanted.schema[c] for c in names], T.StructField("items", T.BinaryType())])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = pa.array([shingles(words_of(t), width).astype("<u8").tobytes() for t in text_bytes(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], items], names=[*names, "items"])

    return _texts(docs, wanted, doc, text).select("text", *names).mapInArrow(own, schema)


def _shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b: products of incidence matrices, a block of items at a time."""
    flat = np.concatenate([*a, *b])
    both, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    often = times[at] > 1  # an item of one set alone is in no intersection
    column = (np.cumsum(times > 1) - 1)[at[often]]
    owner, out = owner[often], np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int((times > 1).sum()), 4096):
        i, j = np.searchsorted(column, [start, start + 4096])
        hits = np.zeros((len(a) + len(b), 4096), np.float32)
        hits[owner[i:j], column[i:j] - start] = 1
        out += hits[: len(a)] @ hits[len(a) :].T
    return out.astype(np.int64)


def compare_tiles(one: dict, two: dict, percent: int, same: bool) -> list[tuple[int, int]]:
    """Links that join components: those of the nodes in tile ``one`` with those in ``two`` that are verified to be similar.

    Signatures are compared in batches, the posterior rules pairs out, and the rest is verified on the full sets. A tile has
    ``id``, ``comp``, ``n``, ``sig`` and ``items``. The links span what the pairs join, and so are fewer than the nodes.
    """
    (c1, n1, s1), (c2, n2, s2) = ((np.array(t["comp"]), np.array(t["n"]), np.frombuffer(b"".join(t["sig"]), "<u2").reshape(-1, BANDS * ROWS)) for t in (one, two))
    x, y = np.nonzero((c1[:, None] != c2) & (100 * np.minimum(n1[:, None], n2) >= percent * np.maximum(n1[:, None], n2)))
    if same:
        x, y = x[x < y], y[x < y]
    matches = np.zeros(len(x), np.int64)
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for i in range(0, len(x), 1 << 15):
            matches[i : i + (1 << 15)] += (s1[x[i : i + (1 << 15)], n - BATCH : n] == s2[y[i : i + (1 << 15)], n - BATCH : n]).sum(1)
        on = matches >= least_matches(n, percent)
        x, y, matches = x[on], y[on], matches[on]
    if not len(x):
        return []
    left, right = np.unique(x), np.unique(y)
    load = lambda t, i: np.frombuffer(t["items"][i], "<u8")
    common = _shared_counts([load(one, i) for i in left], [load(two, i) for i in right])[np.searchsorted(left, x), np.searchsorted(right, y)]
    good = 100 * common >= percent * (n1[x] + n2[y] - common)
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = i = root[root[i]]
        return i

    links = []
    for a, b in np.unique(np.stack([c1[x[good]], c2[y[good]]], 1), axis=0).tolist():
        if (i := find(a)) != (j := find(b)):
            root[max(i, j)] = min(i, j)
            links.append((a, b))
    return links


def _small(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Broadcast if it is: ``most`` rows of a few numbers."""
    return F.broadcast(df) if df.count() <= most else df


def _across(spark: SparkSession, entries: DataFrame, nodes: DataFrame, docs: DataFrame, doc: str, text: str, width: int, percent: int, tile: int) -> DataFrame:
    """Links (a, b) between different components that meet in open bands.

    ``entries``: a (the band's smallest node), id, comp. Nodes that open bands connect are a family. Its nodes lie in tiles of about ``tile``
    nodes: by class of size, as similar sets differ by a fifth at most, apart for the family's largest component, and by hash.
    Two tiles at a time are compared in memory, and only links that join components come out, so no pair is a row.
    """
    family = components(entries.select("a", F.col("id").alias("b"))).withColumnRenamed("comp", "family")
    members = written(spark, entries.select("id", "comp").distinct().join(family, "id").join(nodes, "id"), "families")
    counted = members.groupBy("family", "comp").agg(F.count("*").alias("_k"))
    # Families of several tiles are as few as tiles, so what is known of them is broadcast, unless even that is large.
    main = counted.groupBy("family").agg(F.max(F.struct("_k", "comp")).alias("_m"), F.sum("_k").alias("_total")).filter(F.col("_total") > tile)
    main = written(spark, main.select("family", F.col("_m.comp").alias("_main")), "large-families")
    # ceil: the ratio of sizes within a class is percent / 100 at least, so similar sets are in one class or in neighbours.
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent + 1e-9))).cast("int") if percent < 100 else F.col("n").cast("int")
    classed = members.join(_small(main), "family", "left").withColumns({"cls": size_class, "inner": F.coalesce(F.col("comp") == F.col("_main"), F.lit(False))}).drop("_main")
    weight = F.lit(2 * BANDS * ROWS) + 8 * F.col("n")
    tiles = written(spark, classed.groupBy("family", "cls", "inner").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum(weight) / TILE_BYTES)).cast("int").alias("tiles")), "tile-counts")
    key = ["family", "cls", "inner"]
    several = written(spark, tiles.filter("tiles > 1"), "several-tiles")
    placed = classed.join(_small(several), key, "left").withColumn("k", F.pmod(F.xxhash64("id"), F.coalesce("tiles", F.lit(1))).cast("int")).select("id", "comp", "n", "sig", *_ROW, *key, "k")
    full = _sets(docs, placed, doc, text, width).groupBy(*key, "k").agg(F.collect_list(F.struct("id", "comp", "n", "sig", "items")).alias("t"))
    full = written(spark, full, "tiles")
    # Which tiles meet: all of the family's of one class or of neighbours, but not two of the largest component.
    one = tiles.select("family", F.col("cls").alias("cls1"), F.col("inner").alias("inner1"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("k1"))
    two = tiles.select("family", F.col("cls").alias("cls2"), F.col("inner").alias("inner2"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("k2"))
    first, second = F.struct("cls1", "inner1", "k1"), F.struct("cls2", "inner2", "k2")
    meet = one.join(two, "family").filter((F.col("cls2") - F.col("cls1")).between(-1, 1) & (first <= second) & ~(F.col("inner1") & F.col("inner2")))
    side = lambda j: full.select("family", F.col("cls").alias(f"cls{j}"), F.col("inner").alias(f"inner{j}"), F.col("k").alias(f"k{j}"), F.col("t").alias(f"t{j}"))
    both = meet.join(side(1), ["family", "cls1", "inner1", "k1"]).join(side(2), ["family", "cls2", "inner2", "k2"])
    both = both.select((first == second).alias("same"), "t1", "t2")
    whole = ("comp", "n", "sig", "items")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i in range(len(batch)):
                t = [{c: batch.column(f"t{j}")[i].values.field(c).to_pylist() for c in whole} for j in (1, 2)]
                out += compare_tiles(t[0], t[1], percent, batch.column("same")[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zip(*out, strict=True) if out else ((), ()))], names=["a", "b"])

    found = written(spark, both.mapInArrow(compare, "a long, b long"), "across")
    release(members, main, tiles, several, full)
    return found


def _verified(spark: SparkSession, pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc: str, text: str, width: int, percent: int) -> DataFrame:
    """Pairs (a: hub, b: member) whose full sets are similar. Each hub's text comes before its members', so one set is held."""
    involved = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id").join(nodes.select("id", *_ROW), "id")
    texts = written(spark, _texts(docs, involved, doc, text).select("id", "text"), "candidate-texts")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    hubs = salts.join(texts, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    members = pairs.join(salts, "a").join(texts, F.col("b") == F.col("id")).select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), "b", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: np.ndarray | None = None
        for batch in batches:
            good = []
            for i, (b, t) in enumerate(zip(batch.column("b").to_pylist(), text_bytes(batch.column("text")), strict=True)):
                s = shingles(words_of(t), width)
                if b is None:
                    hub = s
                elif similar(hub, s, percent):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    lined = hubs.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    links = written(spark, lined.mapInArrow(verify, "a long, b long"), "links")
    release(texts)
    return links


def _grouped(spark: SparkSession, docs: DataFrame, doc: str, text: str, width: int, percent: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs``: doc, n, key and signature; and per node: key, id, doc and comp, the component's own number (a node id)."""
    signed = written(spark, _signed(docs, doc, text, width), "signatures")
    row = F.min(F.struct(F.col("doc").isNull().alias("none"), *_ROW)).alias("row")  # the node's row: with the smallest id, if any has one
    nodes = signed.filter("key IS NOT NULL").groupBy("key").agg(row, F.max("n").alias("n"), F.first("sig").alias("sig"))
    nodes = written(spark, nodes.select("key", "row.doc", "row.th", "row.tm", "n", "sig", F.xxhash64("key").alias("id")), "nodes")
    entries = nodes.select("id", F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sig, b * {2 * ROWS} + 1, {2 * ROWS})))")).alias("band"))
    busy = entries.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("_max")).filter("a <> _max").drop("_max")
    shared = written(spark, entries.join(busy, "band"), "bands")  # entries of the bands that nodes share, with the smallest id

    tried: list[DataFrame] = []
    confirmed: list[DataFrame] = []

    def confirm(candidates: DataFrame) -> DataFrame:
        left = written(spark, _plausible(candidates, nodes, percent), "plausible")
        tried.append(left)
        if left.isEmpty():
            return left
        confirmed.append(_verified(spark, left, nodes, docs, doc, text, width, percent))
        return confirmed[-1]

    def components_of(df: DataFrame, name: str, to: str) -> DataFrame:
        return df.join(found.withColumnsRenamed({"id": name, "comp": to}), name, "left").withColumn(to, F.coalesce(to, name))

    # Each node meets the smallest of its bands' smallest nodes; then, of those it isn't joined with, the one in most of its bands.
    met = written(spark, shared.filter("id <> a").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).select("a", "b"), "met")
    links = confirm(met)
    found = components(links)
    apart = components_of(components_of(shared.filter("id <> a").select("a", F.col("id").alias("b")).groupBy("a", "b").agg(F.count("*").alias("times")), "a", "ca"), "b", "cb").filter("ca <> cb")
    second = apart.groupBy("b").agg(F.max(F.struct("times", "a")).alias("_best")).select(F.col("_best.a").alias("a"), "b").join(met, ["a", "b"], "left_anti")
    second = written(spark, second, "second")
    more = confirm(second)
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links)
    # Bands that still hold several components: of two nodes, the pair if it wasn't tried; of more, pairs across components, by signatures and sets, in tiles.
    labelled = components_of(shared, "id", "comp").select("band", "a", "id", "comp")
    open_bands = labelled.groupBy("band").agg(F.min("comp").alias("_c0"), F.max("comp").alias("_c1"), F.count("*").alias("_size"), F.min("a").alias("a"), F.max("id").alias("b")).filter("_c0 <> _c1")
    open_bands = written(spark, open_bands.select("band", "a", "b", "_size"), "open")
    last = open_bands.filter("_size = 2").select("a", "b").distinct().join(met.unionByName(second), ["a", "b"], "left_anti")
    entries = written(spark, labelled.join(open_bands.filter("_size > 2").select("band"), "band").select("a", "id", "comp").distinct(), "open-bands")
    more = confirm(last)
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links)
    if not entries.isEmpty():
        more = _across(spark, entries, nodes, docs, doc, text, width, percent, tile)
        if not more.isEmpty():
            links = links.unionByName(more)
            found = components(links)
        release(more)
    release(entries, open_bands, shared, met, second, *tried, *confirmed)
    roots = nodes.select("key", "id", "doc").join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    return signed, roots


def near_duplicates(spark: SparkSession, docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc`` long, ``n`` long (distinct shingles), ``key`` binary (hash of the word sequence, null without words) and
    ``component`` long, the smallest doc_id reachable over links of similarity ``percent`` or more, its own included.

    Every row gives one row. Rows without words or text have n = 0 and are linked with nothing. Rows of equal words are linked
    however few they have. Null ids lose against others; a component of null ids only has the component null. Repeated ids are
    separate rows. An empty table gives an empty result. Other columns are ignored, whatever they are called.
    """
    signed, roots = _grouped(spark, docs, doc, text, width, percent)
    least = roots.groupBy("comp").agg(F.min("doc").alias("component"))
    classes = roots.join(least, "comp").select("key", "component")
    return signed.select("doc", "n", "key").join(classes, "key", "left").withColumn("component", F.when(F.col("key").isNull(), F.col("doc")).otherwise(F.col("component")))


def keep_one(spark: SparkSession, docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest doc_id; rows without words all stay. Other columns stay as they are."""
    _, roots = _grouped(spark, docs, doc, text, width, percent)
    # By the component's own number: unlike components may have the same smallest id, or none. Of an id's texts the smallest key stays.
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key")).alias("first")
    key, own = fresh(docs, "_key", "_id")
    stays = roots.groupBy("comp").agg(first).select(F.col("first.key").alias(key), F.col("first.doc").alias(own))

    names = docs.columns

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([_key(words_of(t)) for t in text_bytes(b.column(text))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, keys], names=[*names, key])

    rows = docs.mapInArrow(keyed, docs.withColumn(key, F.lit(None).cast("binary")).schema)
    empty = docs.filter(~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    kept = rows.filter(F.col(key).isNotNull()).join(stays, key).filter(F.col(doc).cast("long").eqNullSafe(F.col(own))).dropDuplicates([key])
    return kept.select(names).unionByName(empty)


def op6_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[p : p + 3], ' ') END AS g
  FROM d, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 2))) AS p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

QUERIES = {"op6_bayesian_minhash": op6_bayesian_minhash}
ORACLES = {"op6_bayesian_minhash": ORACLE}
