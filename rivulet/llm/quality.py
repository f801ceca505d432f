"""Quality classifier by Bradley-Terry ranking.

A document's worth is a linear function of features of its whole text. Each labelled row is compared with the average row of
the other label, whose worth is that label's average worth: a row labelled 1 is to be preferred, one labelled 0 is not. The weights
minimize the logistic loss of the features' differences, where both labels count alike: the chance that the first is preferred is the
logistic function of the worths' difference. The decision threshold is the exact quantile of the worths of the labelled rows at the
share of label 0. A score is the logistic function of the distance to it, placed so that the threshold is at ``cut``.

The fit sees every labelled row. Their features are stored once, and each step of the fit is a pass over them that brings sums alone
to the driver. Features of all rows are computed again to be scored, in one narrow pass.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import release
from .common import FOLD, fresh, table, text_bytes, written

CUT, RIDGE, ROUNDS = 0.7, 1e-3, 25
#: Labels that are broadcast; of more, features of all documents are computed and meet the labels in place of the texts.
FEW = 1 << 16

_GROUPS = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t", "line": b"\n\r", "stop": b".,;:?",
    "exclaim": b"!", "pipe": b"|", "mark": b"#$%&*@^~+=_\\/<>", "bracket": b"()[]{}\"'`-", "beyond": bytes(range(128, 256)), "control": bytes([*range(9), *range(14, 32), 127]),
}
_SUMS = np.zeros((256, len(_GROUPS)))
for _j, _x in enumerate(_GROUPS.values()):
    _SUMS[list(_x), _j] = 1
_STRIP = b".,;:?!#$%&*|@^~()[]{}\"'"
FEATURES = [*_GROUPS, "length", "word length", "distinct", "top word", "again", "bare", "short", "long", "line words", "same lines", "dot ends", "capitals"]
WIDTH = 2 * len(FEATURES)


def features(text: bytes) -> np.ndarray:
    """Shares and means that describe a text, each also as a square root; an empty text has zeros."""
    out = np.zeros(len(FEATURES))
    words = text.split()
    if words:
        n, g = len(words), len(_GROUPS)
        out[:g] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _SUMS / len(text)
        folded = [w.translate(FOLD, _STRIP) for w in words]
        counts = Counter(folded)
        sizes = np.fromiter(map(len, words), np.float64, n)
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[g:] = (
            math.log1p(len(text)) / 10, sizes.mean() / 10, len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, folded[1:], folded)) / n,
            folded.count(b"") / n, (sizes <= 2).mean(), (sizes >= 15).mean(), math.log1p(n / len(lines)) / 5, 1 - len(set(lines)) / len(lines),
            sum(x.rstrip()[-1:] in b".?!" for x in lines) / len(lines), sum(w[:1].isupper() for w in words) / n,
        )
    return np.concatenate([out, np.sqrt(out)])


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        """Summed row by row, so that a text's worth is the same to the bit in whatever batch it comes."""
        return ((x - self.mean) / self.scale * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.worth(x) - self.threshold + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _ordered(worth: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of these."""
    bits = (worth + 0.0).view(np.uint64)  # + 0.0: no negative zero
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _number(key: int) -> float:
    return float(np.array([key ^ (1 << 63) if key >> 63 else key ^ (2**64 - 1)], np.uint64).view(np.float64)[0])


def fit_sums(total: Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray], cut: float = CUT, ridge: float = RIDGE) -> Ranker:
    """Newton's method on the Bradley-Terry loss. ``total(f)`` is the sum of ``f(x, y)``, an array, over all blocks of labelled rows.

    Without rows of both labels all worths are equal and meet the threshold. Sums are rounded so that the order of rows, which
    moves their last bits, doesn't matter.
    """
    by_label = lambda x, y: np.concatenate([[(y == k).sum(), *x[y == k].sum(0)] for k in (0, 1)])
    sums = np.asarray(total(by_label)).reshape(2, -1)
    n = sums[:, 0]
    if not n.all():
        return Ranker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, cut)
    mean = np.round(sums[:, 1:].sum(0) / n.sum(), 12)
    scale = np.round(np.sqrt(total(lambda x, y: ((x - mean) ** 2).sum(0)) / n.sum()), 12)
    scale[scale < 1e-9] = 1
    average = (sums[:, 1:] / n[:, None] - mean) / scale
    w = np.zeros(WIDTH)
    for _ in range(ROUNDS):

        def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            d = np.where(y == 1, 1, -1)[:, None] * ((x - mean) / scale - average[1 - y])
            p, share = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40))), 0.5 / n[y]
            return np.concatenate([(d * (p * (1 - p) * share)[:, None]).T @ d, (d.T @ ((1 - p) * share))[None]])

        got = total(slopes)
        step = np.linalg.solve(got[:-1] + ridge * np.eye(WIDTH), got[-1] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    ranker = Ranker(mean, scale, np.round(w, 9), 0.0, cut)
    place = n[0] / n.sum() * (n.sum() - 1)
    low, key, bits, below = int(place), 0, 64, 0
    while bits:  # the worth of this rank: twelve bits of it a pass

        def counts(x: np.ndarray, y: np.ndarray, key: int = key, bits: int = bits, part: int = min(12, bits)) -> np.ndarray:
            k = _ordered(ranker.worth(x))
            k = k[k >> np.uint64(bits) == np.uint64(key)] if bits < 64 else k
            return np.bincount(((k >> np.uint64(bits - part)) & np.uint64((1 << part) - 1)).astype(np.int64), minlength=1 << part)

        upto = np.cumsum(total(counts))
        digit = int(np.searchsorted(upto, low - below, "right"))
        below += int(upto[digit - 1]) if digit else 0
        key, bits, equal = key << min(12, bits) | digit, bits - min(12, bits), int(upto[digit] - (upto[digit - 1] if digit else 0))
    at = after = _number(key)
    if below + equal <= low + 1 < n.sum():  # the next rank has another worth
        least = lambda x, y: -np.min(ranker.worth(x), where=ranker.worth(x) > at, initial=np.inf, keepdims=True)
        after = -float(total(least, np.maximum)[0])
    return Ranker(mean, scale, ranker.weights, at + (after - at) * (place - low), cut)


def fit(x: np.ndarray, y: np.ndarray, cut: float = CUT, ridge: float = RIDGE) -> Ranker:
    """``fit_sums`` over rows in memory."""
    y = np.asarray(y, np.int64)
    return fit_sums(lambda f, join=None: f(x, y), cut, ridge)


def id_remainder(column: str, modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fit_ranker(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", few: int = FEW, **options) -> Ranker:
    """Learns from all labelled documents. Rows whose id or label is null don't count; an id with several labels takes the larger,
    and one with several texts takes one of them, always the same. The driver gets sums.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    half = WIDTH // 2  # the square roots are made again

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column("_text"))
            x, k = [features(t)[:half].tolist() for t in texts], [xxhash.xxh3_64_intdigest(t) - 2**63 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(k, pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["_id", "k", "x"])

    rows = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text")).filter("_id IS NOT NULL")
    measured = lambda d: d.mapInArrow(measure, f"_id {docs.schema[doc].dataType.simpleString()}, k long, x array<double>")
    if known.count() <= few:
        found = measured(rows.join(F.broadcast(known), "_id", "left_semi")).join(F.broadcast(known), "_id")
    else:
        found = measured(rows).join(known.hint("merge"), "_id")
    stored = written(spark, found.groupBy("_id").agg(F.min(F.struct("k", "x", "_label")).alias("row")).select("row.x", F.col("row._label").alias("y")), "labelled-features")

    def total(f: Callable[[np.ndarray, np.ndarray], np.ndarray], join: Callable = np.add) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, half)
                part = f(np.concatenate([x, np.sqrt(x)], 1), b.column("y").to_numpy(zero_copy_only=False).astype(np.int64))
                out = part if out is None else join(out, part)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float64).tobytes()], pa.binary())], names=["part"])

        out, shape = None, f(np.zeros((0, WIDTH)), np.zeros(0, np.int64))
        for r in stored.mapInArrow(sums, "part binary").collect():
            part = np.frombuffer(r["part"], np.float64).reshape(shape.shape)
            out = part if out is None else join(out, part)
        return shape if out is None else out

    ranker = fit_sums(total, **options)
    release(stored)
    return ranker


def score_documents(spark: SparkSession, docs: DataFrame, ranker: Ranker, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` double (0 to 1) and ``predicted`` int (1 from the threshold on), or under other ``names``.

    Every row is kept, with all its columns, but a column of one of these names gives way to the new one; only ``text`` is
    looked at. Null and empty texts are scored like any other; equal texts have equal scores. An empty table gives an empty result.
    """
    docs = docs.drop(*(n for n in names if n.lower() != text.lower()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in text_bytes(b.column(text))]).reshape(-1, WIDTH)
            s = ranker.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= ranker.cut).astype(np.int32))], names=[*b.schema.names, *names])

    return docs.mapInArrow(score, docs.withColumns({names[0]: F.lit(0.0), names[1]: F.lit(0)}).schema)


def ranked(spark: SparkSession, docs: DataFrame, labels: DataFrame, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Scores of all documents by a ranker that never sees the held-out labels."""
    ranker = fit_ranker(spark, docs, labels.filter(id_remainder("doc_id", 4) != 2))
    return score_documents(spark, docs, ranker, names=names)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents at or above the threshold, unchanged, whatever their other columns are called."""
    score, predicted = fresh(docs, "score", "predicted")
    return ranked(spark, docs, labels, (score, predicted)).filter(F.col(predicted) == 1).select(docs.columns)


def op2_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ranked(spark, docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


QUERIES = {"op2_bradley_terry": op2_bradley_terry}
ORACLES: dict[str, str] = {}  # learned; tests measure it on held-out labels
