"""Best-fit packing by bin completion.

Items are alike when their lengths are, so the search works on the histogram of lengths, whose size is bounded by the
capacity, not by the data. Starting from the largest length left, it enumerates the undominated fillings of the rest of the
bin, takes one as often as the counts allow, and goes on; waste bounds prune, the best-fit solution is the incumbent. The
resulting plan (patterns and how often each is used) is small; every item finds its place in it by its rank among the items
of its length, which comes from counts of (length, bucket) and a rank inside the bucket, so that no length, however common,
meets in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table, whole_text, written
from .tokens import Encoder, default_tokenizer

CAPACITY = 2048
#: Nodes that the search may visit beyond the incumbents; the best plan found by then is used.
NODES = 3000
#: Fillings kept a node, least waste first.
WIDTH = 12

Pattern = tuple[tuple[int, int], ...]
Plan = list[tuple[Pattern, int]]


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Bins needed at least: by volume, and by items too large to share a bin (Martello and Toth's L2)."""
    best = -(-sum(n * c for n, c in hist.items()) // capacity)
    for k in sorted({n for n in hist if n <= capacity // 2} | {0}):
        alone = sum(c for n, c in hist.items() if n > capacity - k)
        half = [(n, c) for n, c in hist.items() if capacity // 2 < n <= capacity - k]
        small = sum(n * c for n, c in hist.items() if k <= n <= capacity // 2)
        free = sum((capacity - n) * c for n, c in half)
        best = max(best, alone + sum(c for _, c in half) + max(0, -(-(small - free) // capacity)))
    return best


def _bins(plan: Plan) -> int:
    return sum(times for _, times in plan)


def _times(pattern: Counter, hist: dict[int, int]) -> int:
    return min(hist[n] // c for n, c in pattern.items())


def _take(pattern: Counter, times: int, hist: dict[int, int]) -> None:
    for n, c in pattern.items():
        hist[n] -= c * times
        if not hist[n]:
            del hist[n]


def best_fit(hist: dict[int, int], capacity: int) -> Plan:
    """The incumbent: each bin takes the largest item left, and then again the largest that fits."""
    left, sizes, plan = dict(hist), sorted(hist), []
    while left:
        pattern, room, at = Counter(), capacity, len(sizes)
        while (at := bisect_right(sizes, room, 0, at) - 1) >= 0:  # the largest that fits, below the last one taken
            n = sizes[at]
            pattern[n] = min(left[n], room // n)
            room -= n * pattern[n]
        times = _times(pattern, left)
        _take(pattern, times, left)
        sizes = [n for n in sizes if n in left]
        plan.append((tuple(sorted(pattern.items(), reverse=True)), times))
    return plan


def fillings(hist: dict[int, int], room: int, width: int = WIDTH, tries: int = 400) -> list[Counter]:
    """Undominated ways to fill ``room``, least waste first: of those found in ``tries`` steps, ``width`` at most.

    A filling is dominated if another item could be added, or one of its items exchanged for a larger one that is left and
    still fits: whatever can be done after it can be done after the other.
    """
    sizes = sorted((n for n in hist if n <= room), reverse=True)
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def descend(start: int, room: int, chosen: list[int]) -> None:
        nonlocal steps
        fits = False
        for at in range(start, len(sizes)):
            n = sizes[at]
            if n > room:
                continue
            fits = True
            for c in range(min(hist[n], room // n), 0, -1):  # a run of equal items is one step
                steps += 1
                if steps > tries:
                    return
                descend(at + 1, room - c * n, [*chosen, *[n] * c])
                if found and found[-1][0] == 0 and sum(1 for x in found if x[0] == 0) >= width:
                    return
        if not fits:
            used = Counter(chosen)
            more = any(m <= room and used[m] < hist[m] for m in sizes)
            if not more and not any(m for n in used for m in sizes if n < m <= n + room and used[m] < hist[m]):
                found.append((room, tuple(chosen)))

    descend(0, room, [])
    best = dict.fromkeys(x for x in sorted(found, key=lambda x: (x[0], len(x[1]))))
    return [Counter(x[1]) for x in list(best)[:width]] or [Counter()]


def complete(hist: dict[int, int], capacity: int, nodes: int = NODES) -> Plan:
    """The plan with the fewest bins found; provably the fewest if it meets ``lower_bound``."""
    incumbent, least = best_fit(hist, capacity), lower_bound(hist, capacity)
    total = sum(n * c for n, c in hist.items())
    if _bins(incumbent) <= least:
        return incumbent
    left, path = dict(hist), []  # one state, changed and restored along the path; only untried fillings are kept a level
    bins = waste = 0

    def children() -> Iterator[Counter]:
        largest = max(left)
        rest = dict(left)
        _take(Counter([largest]), 1, rest)
        return iter([filling + Counter([largest]) for filling in fillings(rest, capacity - largest)])  # the least waste is visited first

    levels = [children()]
    while levels and nodes:
        pattern = next(levels[-1], None)
        if pattern is None:
            levels.pop()
            if path:  # restore what led here
                pattern, times, wasted = path.pop()
                bins, waste = bins - times, waste - wasted
                for n, c in pattern.items():
                    left[n] = left.get(n, 0) + c * times
            continue
        nodes -= 1
        times = _times(pattern, left)
        wasted = times * (capacity - sum(n * c for n, c in pattern.items()))
        if -(-(total + waste + wasted) // capacity) >= _bins(incumbent):
            continue  # its waste alone rules it out
        _take(pattern, times, left)
        path.append((pattern, times, wasted))
        bins, waste = bins + times, waste + wasted
        if left:
            levels.append(children())
            continue
        if bins < _bins(incumbent):
            incumbent = [(tuple(sorted(x.items(), reverse=True)), t) for x, t, _ in path]
            if bins <= least:
                break
        levels.append(iter(()))  # a full plan has no children; the next step takes it back
    return incumbent


class Places:
    """The plan as intervals of ranks for each length."""

    def __init__(self, plan: Plan):
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        reached: Counter = Counter()
        base = 0
        for pattern, times in plan:
            offset = 0
            for n, c in pattern:
                by.setdefault(n, []).append((reached[n], c, base, offset))
                reached[n] += c * times
                offset += n * c
            base += times
        self.by = {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in by.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of the items with these lengths and ranks from 0."""
        bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            n = int(length[rows[0]])
            first, count, base, offset = self.by[n]
            at = np.searchsorted(first, rank[rows], "right") - 1
            inside = rank[rows] - first[at]
            bins[rows] = base[at] + inside // count[at]
            offsets[rows] = offset[at] + inside % count[at] * n
        return bins, offsets


def pack(spark: SparkSession, items: DataFrame, length: str = "length", order: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id``, ``offset`` (both long) and ``fewest`` (boolean) to ``items``: sequences of at most ``capacity``, offsets
    gapless from 0. ``fewest``: the plan meets the lower bound, so no other has fewer sequences; else it is the best that the search found.

    ``items`` must read the same rows each time (a stored table). Lengths are 1 to ``capacity``. ``order``: columns that tell
    items of one length apart; equal items are separate, and interchangeable. An empty table gives an empty result. Columns
    named sequence_id, offset or fewest give way.
    """
    order = order or [length]
    items = items.drop("sequence_id", "offset", "fewest")
    _bucket, _rank, _start = fresh(items, "_bucket", "_rank", "_start")
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucketed = items.withColumn(_bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy(length, _bucket).agg(F.count("*").alias("_n"))
    hist = {r[length]: r["n"] for r in counts.groupBy(length).agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    plan = complete(hist, capacity)
    fewest = _bins(plan) <= lower_bound(hist, capacity)
    places = spark.sparkContext.broadcast(Places(plan))  # at most capacity**2 / 2 intervals
    per_length = Window.partitionBy(length).orderBy(_bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(length, _bucket, F.coalesce(F.sum("_n").over(per_length), F.lit(0)).alias(_start))
    inside = Window.partitionBy(length, _bucket).orderBy(*order)
    ranked = bucketed.withColumn(_rank, F.row_number().over(inside) - 1).join(starts, [length, _bucket])

    names = items.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(_rank).to_numpy(zero_copy_only=False) + b.column(_start).to_numpy(zero_copy_only=False)
            bins, offsets = places.value.find(b.column(length).to_numpy(zero_copy_only=False), rank)
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(bins), pa.array(offsets), pa.array([fewest] * len(b), pa.bool_())], names=[*names, "sequence_id", "offset", "fewest"])

    schema = items.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "fewest": F.lit(True)}).schema
    return ranked.mapInArrow(place, schema)


def token_pieces(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Tokenized documents, each closed by the id ``end``, cut only where longer than ``capacity``.

    Only the first piece may be shorter than ``capacity`` then. Null text counts as empty. One row a piece: doc_id, piece,
    start, length, ids (binary, little-endian unsigned 32-bit).
    """
    path = tokenizer or default_tokenizer()
    tail = int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            out: list[tuple] = []
            for name, x in zip(b.column(doc).to_pylist(), b.column(text).to_pylist(), strict=True):
                ids = encoder.encode(x or "") + tail
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    stop = start + ((n - start) % capacity or capacity)
                    out.append((name, piece, start, stop - start, ids[4 * start : 4 * stop]))
                    start, piece = stop, piece + 1
            columns = [*zip(*out, strict=True)] or [[]] * 5
            types = (b.schema.field(doc).type, pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[doc, "piece", "start", "length", "ids"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, text).mapInArrow(cut, f"`{doc}` {kind}, piece int, start long, length long, ids binary")


def pack_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Pieces of ``token_pieces`` with digests of their ids in place of them, and their places."""
    pieces = token_pieces(docs, **options)
    light = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    stored = written(spark, light, "pieces")
    return pack(spark, stored, "length", ["doc_id", "piece", "ids_crc32"])


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """Training rows: sequence_id and its ids, joined in order of offset (at most the capacity each)."""
    both = pieces.join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    return pack_documents(spark, docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fewest")


QUERIES = {"op4_bin_completion": op4_bin_completion}
ORACLES: dict[str, str] = {}  # SQL has no BPE; tests compare ids with the tokenizer's and check every packing rule
