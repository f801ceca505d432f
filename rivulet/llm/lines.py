"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: its number of tokens, then its leading tokens, with variable fields (tokens that hold
a digit) as ``<*>``. In the leaf it is compared in place, token by token, with the lines of earlier documents that stay: it
joins one's template if ``AGREE`` percent of the tokens agree, or if all tokens that don't lie in one of ``STRETCHES`` fixed
stretches of the rest. A line that joins is dropped; one that doesn't stays in the document with the smallest doc_id, and is
dropped from all others. So each line that goes has a line like it that stays.

Leaves in which several documents meet are few, so a first pass finds them by aggregation of keys alone, and only their
lines are fetched. A leaf of many lines isn't gathered: its earliest lines are settled, the others meet those that stay, dealt
out to many tasks, and so on with what is left. A common line is one of its leaf however often it occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, shielded, table, text_bytes, written

FIELD = b"<*>"
#: Leading tokens that choose the leaf; stretches that the rest is cut into; lines of fewer tokens match only as they are.
LEADING, STRETCHES, SHORTEST = 3, 5, 8
#: Percent of the tokens that agree with the template.
AGREE = 80
#: Tokens of a leaf that are compared in one task.
CELLS = 1 << 21
#: A line that is one in so many occurrences is dealt out to ``SALTS`` tasks where documents are looked up.
COMMON, SALTS = 1000, 64
#: Stands for a null doc_id, so that those rows count as one document.
NO_ID = -(2**63)
_DIGIT = re.compile(rb"[0-9]")


def tokens_of(line: bytes) -> list[bytes]:
    """The line's tokens, variable fields masked."""
    tokens = line.split()
    return [FIELD if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def _hash(x: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(x, seed) - 2**63


def line_key(tokens: list[bytes]) -> int:
    return _hash(b" ".join(tokens))


def leaf_key(tokens: list[bytes]) -> int | None:
    # The number is hashed with the text: as a seed it can cancel out in short texts.
    return _hash(b"%d " % len(tokens) + b" ".join(tokens[:LEADING])) if len(tokens) >= SHORTEST else None


def _cuts(n: int) -> list[int]:
    return [LEADING + (n - LEADING) * j // STRETCHES for j in range(STRETCHES + 1)]


def template_keys(tokens: list[bytes]) -> list[int]:
    """One key for each stretch left variable; none for short lines. Lines that share one are alike."""
    n = len(tokens)
    if n < SHORTEST:
        return []
    cuts = _cuts(n)
    return [_hash(b" ".join(tokens[: cuts[j]]) + b"\n" + b" ".join(tokens[cuts[j + 1] :]), n * STRETCHES + j) for j in range(STRETCHES)]


def _numbered(lines: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    """The lines of one leaf as rows of word numbers."""
    return np.array([[number.setdefault(t, len(number)) for t in x.split(b" ")] for x in lines], np.int32)


def alike(line: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether the line and each of the others, all of one leaf, are of one template."""
    n = len(line)
    same_leaf = (others[:, :LEADING] == line[:LEADING]).all(1)  # false if leaf keys collide
    differs = (others != line)[:, LEADING:]
    return same_leaf & ((100 * differs.sum(1) <= (100 - AGREE) * n) | (np.logical_or.reduceat(differs, np.array(_cuts(n)[:-1]) - LEADING, axis=1).sum(1) <= 1))


def settle(first: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Where each line of a leaf stays, if they come in order of ``first``: there, or else in the document of an earlier one that stays."""
    keep, left = first.copy(), np.arange(len(first))
    while len(left):
        stays, left = left[0], left[1:]
        joins = (first[left] > first[stays]) & alike(lines[stays], lines[left])
        keep[left[joins]] = first[stays]
        left = left[~joins]
    return keep


def _lines(docs: DataFrame, doc: str, text: str, leaves: bool) -> DataFrame:
    """doc and h of each line that isn't blank, th (a hash of the whole text), and its number of tokens and leaf if asked."""
    names = ["doc", "h", *(["n", "leaf"] if leaves else ["th"])]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for d, th, x in zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), text_bytes(b.column("text")), strict=True):
                for line in x.split(b"\n"):
                    if t := tokens_of(line):
                        rows[0].append(d)
                        rows[1].append(line_key(t))
                        if leaves:
                            rows[2].append(len(t))
                            rows[3].append(leaf_key(t))
                        else:
                            rows[2].append(th)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=names)

    source = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    return source.mapInArrow(split, ", ".join(f"{n} long" for n in names))


def _fetched(spark: SparkSession, docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (h, leaf and others) with ``line``, the masked tokens. Other lines are sorted out by a bitmap of leaves first."""
    leaves = wanted.select("leaf").distinct()
    bits, slices = min(27, max(16, (16 * leaves.count()).bit_length())), 16
    low = bits - 4

    def mark(t: pa.Table) -> pa.Table:
        places = np.zeros(1 << low, bool)
        places[t["place"].to_numpy() & ((1 << low) - 1)] = True
        return pa.table({"part": t["part"][:1], "places": [np.packbits(places, bitorder="little").tobytes()]})

    placed = leaves.select(F.shiftrightunsigned("leaf", 64 - bits).alias("place")).withColumn("part", F.shiftright("place", low))
    parts = {r["part"]: r["places"] for r in placed.groupBy("part").applyInArrow(mark, "part long, places binary").collect()}  # 16 MB at most
    bitmap = spark.sparkContext.broadcast(b"".join(bytes(parts.get(i) or bytes(1 << low - 3)) for i in range(slices)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shift = bitmap.value, 64 - bits
        for b in batches:
            rows: dict[int, bytes] = {}
            for x in text_bytes(b.column("text")):
                for line in x.split(b"\n"):
                    t = tokens_of(line)
                    if len(t) >= SHORTEST:
                        place = (leaf_key(t) & 2**64 - 1) >> shift
                        if known[place >> 3] >> (place & 7) & 1:
                            rows[line_key(t)] = b" ".join(t)
            yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.int64()), pa.array(rows.values(), pa.binary())], names=["h", "line"])

    lines = docs.select(F.col(text).alias("text")).mapInArrow(pick, "h long, line binary")
    return wanted.join(lines.join(wanted.select("h"), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")), "h")


def _packed(rows: Iterable[tuple], names: tuple[str, ...], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


LEAF_LINE = ("h", "leaf", "n", "first", "line")
_TYPES = [pa.int64()] * 4 + [pa.binary()]
_KIND = "h long, leaf long, n long, first long, line binary"


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in names), strict=True)


def _settled(lines: DataFrame) -> DataFrame:
    """Lines of whole leaves with ``keep_doc``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, group in groupby(_rows(batches, LEAF_LINE), itemgetter(1, 2)):
                group = list(group)
                keep = settle(np.array([x[3] for x in group], np.int64), _numbered([x[4] for x in group], {}))
                yield from ((*x, k) for x, k in zip(group, keep.tolist(), strict=True))

        return _packed(rows(), (*LEAF_LINE, "keep_doc"), [*_TYPES, pa.int64()])

    return lines.select(*LEAF_LINE).repartition("leaf").sortWithinPartitions("leaf", "n", "first", "h").mapInArrow(run, f"{_KIND}, keep_doc long")


def _met(lines: DataFrame, stays: DataFrame, sizes: DataFrame, cells: int) -> DataFrame:
    """Lines with ``keep_doc`` of the earliest line of ``stays`` that each joins, or null. A leaf's lines are dealt out, each part with all that stays."""
    parts = sizes.select("leaf", F.ceil(F.col("cells") / cells).cast("int").alias("parts"))
    members = lines.join(parts, "leaf").select(*LEAF_LINE, F.pmod(F.xxhash64("h"), "parts").cast("int").alias("part"), F.lit(1).alias("late"))
    copies = stays.join(parts, "leaf").select(*LEAF_LINE, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("late"))
    names = (*LEAF_LINE, "part", "late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, group in groupby(_rows(batches, names), itemgetter(1, 5, 2)):
                number: dict[bytes, int] = {}
                early, first, kept = [], None, None
                for x in group:
                    if not x[6]:
                        early.append(x)
                        continue
                    if first is None:
                        first, kept = np.array([y[3] for y in early], np.int64), _numbered([y[4] for y in early], number)
                    hit = np.flatnonzero((first < x[3]) & alike(_numbered([x[4]], number)[0], kept))
                    yield (*x[:5], int(first[hit[0]]) if len(hit) else None)

        return _packed(rows(), (*LEAF_LINE, "keep_doc"), [*_TYPES, pa.int64()])

    both = copies.unionByName(members).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "n", "late", "first", "h")
    return both.mapInArrow(run, f"{_KIND}, keep_doc long")


def recurring_lines(spark: SparkSession, docs: DataFrame, doc: str = "doc_id", text: str = "text", cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """Lines that occur in several documents or join a template of an earlier one: ``h`` (key of the line) and ``keep_doc``, where the line
    or its template stays. And the common ones: ``h`` of lines that are one in ``COMMON`` of all occurrences, so no more than that many.
    """
    distinct = _lines(docs, doc, text, True).groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.first("n").alias("n"), F.first("leaf").alias("leaf"), F.count("*").alias("times"))
    known = written(spark, distinct, "lines")
    all_lines = known.agg(F.sum("times").alias("n")).first()["n"] or 0
    common = known.filter(F.col("times") > F.lit(all_lines // COMMON)).filter("first <> last").select("h")
    equal = known.filter("first <> last").select("h", F.col("first").alias("keep_doc"))
    busy = known.filter("leaf IS NOT NULL").groupBy("leaf").agg(F.min("first").alias("_a"), F.max("first").alias("_b")).filter("_a <> _b").select("leaf")
    wanted = written(spark, known.join(busy, "leaf").select("h", "leaf", "n", "first"), "leaf-keys")
    left = written(spark, _fetched(spark, docs, text, wanted).select(*LEAF_LINE), "leaf-lines")
    joined: list[DataFrame] = []
    while True:
        sizes = left.groupBy("leaf").agg(F.sum("n").alias("cells")).filter(F.col("cells") > cells)
        sizes = written(spark, sizes, "large-leaves")
        if sizes.isEmpty():
            break
        # The earliest lines of a large leaf can be settled by themselves; the others meet those that stay.
        large = left.join(sizes, "leaf").select(*LEAF_LINE)
        place = F.row_number().over(Window.partitionBy("leaf", "n").orderBy("first", "h"))
        heads = written(spark, large.select("leaf", "h", "first", "n").withColumn("_place", place).filter(F.col("_place") <= F.greatest(F.lit(1), F.floor(F.lit(cells) / 2 / F.col("n")))).select("h"), "leaf-heads")
        head = written(spark, _settled(large.join(heads, "h", "left_semi")), "leaf-settled")
        met = written(spark, _met(large.join(heads, "h", "left_anti"), head.filter("keep_doc = first"), sizes, cells), "leaf-met")
        joined += [head.filter("keep_doc <> first"), met.filter("keep_doc IS NOT NULL")]
        left = written(spark, left.join(sizes, "leaf", "left_anti").select(*LEAF_LINE).unionByName(met.filter("keep_doc IS NULL").select(*LEAF_LINE)), "leaf-lines")
    out = equal
    for x in [*joined, _settled(left).filter("keep_doc <> first")]:
        out = out.unionByName(x.select("h", "keep_doc"))
    return out.groupBy("h").agg(F.min("keep_doc").alias("keep_doc")), common


def dedup_lines(spark: SparkSession, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``, plus ``n_lines`` and ``n_dropped`` (long).

    Every row stays, with all its columns; texts without recurring lines are unchanged to the byte. Blank lines are never
    dropped. Null text stays null (no lines). Rows that repeat a doc_id are one document, as are rows without one; it holds
    lines once or several times alike. An empty table gives an empty result. Columns named n_lines or n_dropped give way.
    """
    docs = docs.drop("n_lines", "n_dropped")
    _doc, _th, _drop = fresh(docs, "_doc", "_th", "_drop")
    recurring, common = recurring_lines(spark, docs, doc, text)
    common = F.broadcast(common.withColumn("common", F.lit(True)))  # COMMON rows at most
    every = F.explode(F.when(F.col("common"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    salted = recurring.join(common, "h", "left").select("h", "keep_doc", every.alias("salt"))
    salt = F.when(F.col("common"), F.pmod(F.xxhash64("doc", "th"), F.lit(SALTS)).cast("int")).otherwise(0)
    found = _lines(docs, doc, text, False).join(common, "h", "left").withColumn("salt", salt).join(salted, ["h", "salt"]).filter("doc <> keep_doc")
    # By text as well as by id, so that an id that many rows have, or rows without one, are no group of their own.
    gone = found.groupBy(F.col("doc").alias(_doc), F.col("th").alias(_th)).agg(F.collect_set("h").alias(_drop))
    marked = docs.withColumns({_doc: F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)), _th: F.xxhash64(F.col(text))}).join(gone, [_doc, _th], "left").drop(_doc, _th)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, dropped = [], [], []
            for x, drop in zip(b.column(text).to_pylist(), b.column(_drop).to_pylist(), strict=True):
                lines = [] if x is None else x.split("\n")
                left = lines
                if drop:
                    drop = set(drop)
                    left = [y for y in lines if not (t := tokens_of(y.encode())) or line_key(t) not in drop]
                texts.append(x if len(left) == len(lines) else "\n".join(left))
                n.append(len(lines))
                dropped.append(len(lines) - len(left))
            columns = {text: pa.array(texts, b.schema.field(text).type), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            out = [*names, "n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays([columns[c] if c in columns else b.column(c) for c in out], names=out)

    return marked.mapInArrow(cut, docs.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents after line dedup; those of which nothing but blank lines is left go. ``n_chars`` follows the text."""
    inner, restore = shielded(docs, "doc_id", "text", "n_chars")
    done = dedup_lines(spark, inner).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return restore(done)


def op1_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(spark, docs).select("doc_id", "text", "n_lines", "n_dropped")


QUERIES = {"op1_template_tree": op1_template_tree}
ORACLES: dict[str, str] = {}  # DuckDB has no such hash tree at whole tables' speed; tests compare with a plain loop over lines
