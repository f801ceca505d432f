"""Edit-aware token counts.

A document is a segment tree whose leaves are runs of whole pre-tokens; each node knows the characters and tokens below it.
An edit descends to the leaves it touches, takes in neighbours until both ends are pre-token boundaries again, re-encodes just
that text, and updates the sums on the way up. All other leaves keep their counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shielded, table, written
from .tokens import Encoder, default_tokenizer

#: Characters a leaf, before it reaches the next boundary.
LEAF = 512
#: A pre-token ends where white space begins after something else; white space itself is only cut at its start.
_BOUNDARY = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n\t\r])")

#: The edits of the registered query: personal data and its placeholder.
REDACTIONS = ((re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "<EMAIL>"), (re.compile(r"\+?\d[\d ().-]{5,}\d"), "<NUMBER>"))


def _bounded(left: str, right: str) -> bool:
    """Whether no pre-token can reach across: always at the ends of the text."""
    return not left or not right or (right[0] in " \n\t\r" and not left[-1].isspace())


class TokenTree:
    def __init__(self, text: str, encoder: Encoder, leaf: int = LEAF):
        leaves, start = [], 0
        for m in _BOUNDARY.finditer(text):
            if m.start() - start >= leaf:
                leaves.append(text[start : m.start()])
                start = m.start()
        leaves.append(text[start:])
        self._build(leaves, [encoder.count(x) for x in leaves], encoder)

    @classmethod
    def stored(cls, leaves: list[str], counts: list[int], encoder: Encoder) -> "TokenTree":
        """The tree of these leaves, whose tokens are counted already."""
        tree = cls.__new__(cls)
        tree._build(list(leaves) or [""], list(counts) or [0], encoder)
        return tree

    def _build(self, leaves: list[str], counts: list[int], encoder: Encoder) -> None:
        self.encoder, self.leaves, self.reencoded = encoder, leaves, 0
        self.base = 1 << (len(leaves) - 1).bit_length()
        self.tokens, self.chars = [0] * (2 * self.base), [0] * (2 * self.base)
        self.tokens[self.base : self.base + len(leaves)] = counts
        self.chars[self.base : self.base + len(leaves)] = map(len, leaves)
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def leaf_counts(self) -> list[int]:
        return self.tokens[self.base : self.base + len(self.leaves)]

    def _sum(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def _set(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        i = self.base + leaf
        self.tokens[i], self.chars[i] = self.encoder.count(text) if text else 0, len(text)
        while i := i // 2:
            self._sum(i)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and the place in it; the end of the text is in the last leaf."""
        i = 1
        at = min(at, self.chars[1])
        while i < self.base:
            i *= 2
            if at >= self.chars[i] and self.chars[i + 1]:
                at -= self.chars[i]
                i += 1
        return i - self.base, at

    def _beside(self, leaf: int, step: int) -> int | None:
        """The next leaf that way that isn't empty."""
        leaf += step
        while 0 <= leaf < len(self.leaves) and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.leaves) else None

    @property
    def count(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Puts ``new`` in place of the characters from ``start`` to ``stop`` of the present text."""
        first, a = self._find(start)
        last, b = self._find(max(start, stop - 1)) if stop > start else (first, a - 1)
        text = self.leaves[first][:a] + new + self.leaves[last][b + 1 :]
        for i in range(first + 1, last + 1):
            self._set(i, "")
        while (i := self._beside(first, -1)) is not None and not (text and _bounded(self.leaves[i], text)):
            text = self.leaves[i] + text
            self._set(first, "")
            first = i
        while (i := self._beside(max(first, last), 1)) is not None and not _bounded(text, self.leaves[i]):
            text += self.leaves[i]
            self._set(i, "")
        self._set(first, text)
        self.reencoded += len(text)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, stop, new) from left to right that don't overlap; the earlier rule wins."""
    found = sorted((m.start(), m.end(), new) for pattern, new in REDACTIONS for m in pattern.finditer(text))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


_TREE, _COUNTS = ("leaves", "leaf_tokens"), ("n_tokens", "n_edits", "n_tokens_edited", "chars_reencoded")


def token_trees(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with ``leaves`` array<string> and ``leaf_tokens`` array<int> in place of ``text``, which is the leaves joined.

    Every row gives a tree; a null text has null leaves, an empty one a single empty leaf. Columns named like the new ones give way.
    """
    docs = docs.drop(*_TREE)
    path, names = tokenizer or default_tokenizer(), [c for c in docs.columns if c != text]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            trees = [None if x is None else TokenTree(x, encoder) for x in b.column(text).to_pylist()]
            leaves = pa.array([t and t.leaves for t in trees], pa.list_(pa.string()))
            counts = pa.array([t and t.leaf_counts() for t in trees], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), leaves, counts], names=[*names, *_TREE])

    kinds = {"leaves": F.lit(None).cast("array<string>"), "leaf_tokens": F.lit(None).cast("array<int>")}
    return docs.mapInArrow(build, docs.drop(text).withColumns(kinds).schema)


def edit_trees(trees: DataFrame, edits=redactions, tokenizer: str | None = None) -> DataFrame:
    """``trees`` after the edits, with ``n_tokens`` (before), ``n_edits``, ``n_tokens_edited`` and ``chars_reencoded`` (long).

    ``edits``: a function of a text that gives its edits (start, stop, new), in order and apart, or the name of a column of such
    structs (null: none). They are applied from the right, so places hold. Columns named like the counts give way.
    """
    trees = trees.drop(*(c for c in _COUNTS if c != edits))
    path, names = tokenizer or default_tokenizer(), trees.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            out: list[list] = [[] for _ in (*_TREE, *_COUNTS)]
            given = [None] * len(b) if callable(edits) else b.column(edits).to_pylist()
            for leaves, counts, mine in zip(b.column("leaves").to_pylist(), b.column("leaf_tokens").to_pylist(), given, strict=True):
                todo = edits("".join(leaves or [])) if callable(edits) else [(e["start"], e["stop"], e["new"]) for e in mine or []]
                before, again = sum(counts or []), 0
                if todo:
                    tree = TokenTree.stored(leaves or [], counts or [], encoder)
                    for start, stop, new in reversed(todo):
                        tree.edit(start, stop, new)
                    leaves, counts, again = tree.leaves, tree.leaf_counts(), tree.reencoded
                for column, x in zip(out, (leaves, counts, before, len(todo), sum(counts or []), again), strict=True):
                    column.append(x)
            new = {"leaves": pa.array(out[0], pa.list_(pa.string())), "leaf_tokens": pa.array(out[1], pa.list_(pa.int32())), **{n: pa.array(x, pa.int64()) for n, x in zip(_COUNTS, out[2:], strict=True)}}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in (*names, *_COUNTS)], names=[*names, *_COUNTS])

    return trees.mapInArrow(run, trees.withColumns({n: F.lit(0).cast("long") for n in _COUNTS}).schema)


def count_tokens(docs: DataFrame, edits=redactions, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_edits``, ``n_tokens_edited`` and ``chars_reencoded`` (long), by trees that are stored and then edited.

    ``edits`` gives a text's edits as (start, stop, new), in order and apart. Every row stays, with all its columns, repeated rows
    too. Null and empty texts have no tokens and no edits. An empty table gives an empty result. Columns named like the new ones give way.
    """
    docs = docs.drop(*_COUNTS)
    inner, _ = shielded(docs, text)
    trees = written(docs.sparkSession, token_trees(inner, text, tokenizer), "token-trees")
    done = edit_trees(trees.withColumn("leaves_before", F.col("leaves")), edits, tokenizer).withColumn(text, F.array_join("leaves_before", ""))
    return done.select(*inner.columns, *_COUNTS).toDF(*docs.columns, *_COUNTS)


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).drop("text")


QUERIES = {"op3_edit_counts": op3_edit_counts}
ORACLES: dict[str, str] = {}  # SQL has no BPE; tests recount edited texts as a whole
