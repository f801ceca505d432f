"""Benchmark decontamination by winnowing.

Both sides keep the minimum k-gram hash of each sliding window of w k-grams (the rightmost one on ties). With
k + w - 1 = 13, any 13 words that a document shares with an item select the same fingerprint in both, so no shared span of
13 words is missed. A fingerprint that meets one of the test set is a hit, which is verified and extended word by word to
the longest common span; spans of 13 words or more count. Items of fewer words are one window each and are looked up whole.

The test set travels to the documents in blocks of bounded bytes, dealt by hash: the driver holds one block at a time, and each
block is a narrow pass over the documents, stored before the next one, so no worker holds two either and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.store import release
from .common import FOLD, shielded, table, text_bytes, whole_text, written

#: Words are runs of digits, letters and anything beyond ASCII; all else in ASCII separates them.
_SEPARATORS = bytes(x for x in range(128) if not (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122))
WORDS = bytes(32 if x in _SEPARATORS else FOLD[x] for x in range(256))
SPAN, K = 13, 5
BLOCK_BYTES = 16 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs to equal outputs, else as good as random."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n] + np.uint64(j + 1))
    return out


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the minimum of each window of w hashes, the rightmost on ties; the ends of shorter runs count as one window."""
    n = len(hashes) - w + 1
    if len(hashes) == 0:
        return np.empty(0, np.int64)
    if n <= 1:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    best, place = hashes[:n].copy(), np.arange(n)
    for j in range(1, w):
        here = hashes[j : j + n]
        less = here <= best
        best[less] = here[less]
        place[less] = np.flatnonzero(less) + j
    return np.unique(place)


class TestBlock:
    """Fingerprints of some benchmark items, ready to be matched."""

    def __init__(self, items: list[tuple[object, bytes]], span: int = SPAN, k: int = K):
        self.span, self.k, self.w = span, k, span - k + 1
        self.names, self.vocabulary, self.texts = [], {}, []
        entries, self.short = [], {}
        alike: dict[tuple[bytes, ...], list] = {}  # items of equal words are one text with several names
        for name, text in items:
            if words := words_of(text):
                alike.setdefault(tuple(words), []).append(name)
        for words, names in alike.items():
            ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words], np.int64)
            i = len(self.names)
            self.names.append([x for x in names if x is not None])
            self.texts.append(ids)
            if len(ids) < span:
                self.short.setdefault(len(ids), {}).setdefault(ids.tobytes(), []).append(i)
            else:
                h = _gram_hashes(ids, k)
                entries += [(int(h[p]), i, int(p)) for p in winnow(h, self.w)]
        entries.sort()
        self.prints = np.array([e[0] for e in entries], np.uint64)
        self.where = [(e[1], e[2]) for e in entries]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [from, to) of hit words, and the items with an occurring window."""
        ids = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))
        spans: set[tuple[int, int]] = set()
        found: set[int] = set()
        known = ids > 0
        if not known.any():
            return [], found
        for length, texts in self.short.items():
            # only runs of known words can be an item; their places come from a running sum
            if len(ids) >= length:
                full = np.convolve(known, np.ones(length, np.int64), "valid") == length
                for p in np.flatnonzero(full):
                    if hit := texts.get(ids[p : p + length].tobytes()):
                        found.update(hit)
                        spans.add((int(p), int(p) + length))
        if len(ids) >= self.span and len(self.prints):
            h = _gram_hashes(ids, self.k)
            places = winnow(h, self.w)
            mine = h[places]
            left, right = np.searchsorted(self.prints, mine, "left"), np.searchsorted(self.prints, mine, "right")
            done: dict[tuple[int, int], int] = {}  # (item, shift between document and item): end of the last span
            for j in np.flatnonzero(right > left):
                p = int(places[j])
                for i, q in self.where[left[j] : right[j]]:
                    if done.get((i, p - q), -1) > p:
                        continue
                    a, b, item = p, p, self.texts[i]
                    while a > 0 and q - (p - a) > 0 and ids[a - 1] == item[q - (p - a) - 1]:
                        a -= 1
                    while b < len(ids) and q + (b - p) < len(item) and ids[b] == item[q + (b - p)]:
                        b += 1
                    done[i, p - q] = b
                    if b - a >= self.span:
                        spans.add((a, b))
                        found.add(i)
        return sorted(spans), found


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[object, bytes]]]:
    """The test set in blocks of about ``most`` bytes of text, or one item; one at a time."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), whole_text(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 1).alias("n")).first()["n"] or 0
    n = max(1, -(-size // most))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"].encode()) for r in part.collect()]


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words`` long, ``hit_spans`` array<struct<start, stop>> (disjoint, in words) and ``hit_items`` array<string>.

    Every row of ``docs`` is kept with all its columns, repeated rows too. Null and empty texts have no words. Items that are
    null or have no words match nothing; an item without an id marks words as hit but isn't named. Equal items under several
    ids are all named. An empty test set leaves every document clean. Columns of ``docs`` named like the new ones give way.
    """
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "hit_spans": F.array().cast(kind), "hit_items": F.array().cast("array<string>")})
    schema = out.schema
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    stored: list[DataFrame] = []
    for turn, items in enumerate(_blocks(benchmark, item, text, block_bytes)):
        if turn:  # the pass before this one ends here
            stored.append(written(spark, out, "contamination"))
            out = stored[-1]
            release(*stored[:-1])
            del stored[:-1]
        sent = spark.sparkContext.broadcast(items)

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = TestBlock(sent.value, span, k)
            for b in batches:
                counts, spans, names = [], [], []
                earlier = zip(b.column("hit_spans").to_pylist(), b.column("hit_items").to_pylist(), strict=True)
                for x, (old, told) in zip(text_bytes(b.column(text)), earlier, strict=True):
                    words = words_of(x)
                    new, found = block.match(words)
                    merged: list[list[int]] = []
                    for a, z in sorted([*((s["start"], s["stop"]) for s in old), *new]):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], z)
                        else:
                            merged.append([a, z])
                    counts.append(len(words))
                    spans.append([{"start": a, "stop": z} for a, z in merged])
                    names.append(sorted({*told, *(x for i in found for x in block.names[i])}))
                done = {"n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array(spans, spans_type), "hit_items": pa.array(names, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([done.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)

        out = out.mapInArrow(match, schema)
    return out


def contamination_report(found: DataFrame, share: int = 20) -> dict[str, F.Column]:
    """Columns: n_hit, n_items, items_sha256 and contaminated (a hit, and hit words at least one in ``share``)."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return {
        "n_hit": hit,
        "n_items": F.size("hit_items").cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256),
        "contaminated": (hit > 0) & (F.lit(share) * hit >= F.col("n_words")),
    }


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, unchanged."""
    inner, restore = shielded(docs, "text")
    found = find_contamination(spark, inner, benchmark)
    return restore(found.filter(~contamination_report(found)["contaminated"]))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(spark, docs, table(spark, sf_dir, "benchmark"))
    return found.withColumns(contamination_report(found)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM benchmark),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM i, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS p)),
sizes AS (SELECT DISTINCT n FROM i),
dw AS (SELECT r, p, s.n, array_to_string(w[p : p + s.n - 1], ' ') AS g FROM d, sizes s, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - s.n + 2))) AS p)),
hits AS (SELECT dw.r, dw.p, dw.n, win.item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
marked AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(m.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AND 20 * coalesce(m.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN marked m USING (r) LEFT JOIN named n USING (r)
"""

QUERIES = {"op10_winnowing": op10_winnowing}
ORACLES = {"op10_winnowing": ORACLE}
