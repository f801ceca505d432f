"""LM scoring by a probabilistic suffix tree over words.

Contexts are the last word or the last two (the tree's depth). A context is retained if a divergence test speaks for it: with
each training occurrence left out in turn, its next-word distribution must predict better than its parent's by more than
``DIVERGENCE`` nats in all, where a word seen elsewhere in the context has its discounted share, and one that isn't what is left
for new words. A context seen once can't be tested and isn't retained. Distributions are smoothed by absolute discounting into the
parent's, down to the additive base distribution, and a word is scored in the longest suffix retained.

The counts grow with the corpus, so nothing but totals goes to the driver. Documents are read in chunks of bounded bytes. A
chunk asks the shards of the tree for its distinct words, pairs and triples once each, with its training counts of them; a
shard adds up what all chunks ask, tests its contexts, and answers each chunk in the order of its questions. Requests are
packed arrays, a row for each chunk and shard. A shard has all pairs and triples that share a last context word.

A context of ``limit`` occurrences or more is hot: its pairs are split over many shards by the next word. Each shard tells every
chunk its sums of size, kinds and gain beside the plain counts, and the chunk adds them up, so a hot context has the same
distribution and test as any other. Two-word contexts that end in a hot word are split by their first word. Their parent's part
of the test takes the hot word's pairs and sums of all slices, which the slices by word tell those by first word beforehand, so
what is hot changes no result. (With ``exact=False`` it is estimated from the slice's occurrences instead.)

The base probability of a word in the test comes from a count sketch of fixed size, the lesser of two cells; it is the word's own
unless both cells are shared. Scores use true counts alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, table, text_bytes, whole_text, written

DISCOUNT, DIVERGENCE = 0.8, 1.0
#: Bytes of text a chunk, and bytes of the corpus a shard answers for.
CHUNK, SHARE = 16 << 20, 8 << 20
#: Occurrences from which a context is split; it is a 4096th of all tokens at least, so hot contexts are few.
LIMIT = 1 << 22
#: Two-word contexts can be hot if both words are a 512th of a chunk each.
OFTEN = 9
#: Classes of the sketch by a word's first 16 bits, cells a class.
CLASSES, CELLS = 1 << 16, 32
FOLDS, HELD_OUT = 5, 1
_U = np.uint64
END, START, NOTHING = b"", _U(xxhash.xxh3_64_intdigest(b"\x00start")), _U(xxhash.xxh3_64_intdigest(b"\x00nothing"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _pack(x: np.ndarray) -> bytes:
    """Compressed by planes of bytes, as high bytes are alike."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"", 1)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.decompress(x), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _pack_shares(x: np.ndarray) -> bytes:
    """Probabilities in single precision without their lowest byte: right to 1 in 100,000, which is a hundred-thousandth in a logarithm."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<f4").view(np.uint8).reshape(len(x), 4).T[1:]).tobytes(), 3)


def _unpack_shares(x: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(3, -1)
    return np.concatenate([np.zeros((1, raw.shape[1]), np.uint8), raw]).T.copy().view("<f4").reshape(-1).astype(np.float64)


def _joined(sums: np.ndarray, last: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of words with these counts in hot contexts, and weights of the parent, from the sums of all slices."""
    wanted = (last.astype(_U) << _U(24)) | first.astype(_U)
    name, of = np.unique(wanted, return_inverse=True)
    have = _find(name, (sums[0].astype(_U) << _U(24)) | sums[1].astype(_U))
    size, kinds, once, again = (np.bincount(have[have >= 0], x[have >= 0], len(name)) for x in sums[2:])
    keep = ((size > 1) & (left_out(size, kinds, once, again) > DIVERGENCE))[of]
    size, kinds = np.maximum(size[of], 1), kinds[of]
    return np.where(keep, np.maximum(count - DISCOUNT, 0) / size, 0), np.where(keep, DISCOUNT * kinds / size, 1)


def is_held_out(doc: object) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % FOLDS == HELD_OUT


class Chunk:
    """Some documents as word numbers, with what they ask of the tree."""

    def __init__(self, docs: list, texts: list[bytes]):
        self.docs, number = docs, {}
        flat: list[int] = []
        ends = []
        for t in texts:
            flat += [number.setdefault(w, len(number)) for w in t.translate(FOLD).split()]
            flat.append(number.setdefault(END, len(number)))
            ends.append(len(flat))
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.train = np.array([not is_held_out(d) for d in docs], bool)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, number), _U, len(number))
        self.words = np.sort(h)
        place = np.searchsorted(self.words, h)
        self.index = place[np.array(flat, np.int64)]  # of each token among the sorted words
        self.weight = np.repeat(self.train, self.ends - self.starts)
        self.counts = np.bincount(self.index[self.weight], minlength=len(self.words)).astype(_U)

        w = self.words[self.index]
        self.one, self.two = np.empty_like(w), np.empty_like(w)  # the last and the last but one word before each token
        self.one[1:], self.two[2:] = w[:-1], w[:-2]
        self.one[self.starts], self.two[self.starts] = START, NOTHING
        self.two[self.starts[self.ends - self.starts > 1] + 1] = START

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts, other than words, that may be hot, with their training counts: the start, and pairs of common words."""
        least = max(1, int(self.counts.sum()) >> OFTEN)
        often = np.append(self.words[self.counts >= least], [START, NOTHING])
        some = np.isin(self.one, often) & np.isin(self.two, often) & self.weight
        name, n = np.unique(gram(self.two[some], self.one[some]), return_counts=True)
        name, n = np.append(name, START), np.append(n, self.train.sum())
        order = np.argsort(name)
        name, n = name[order], n[order]
        return name[n >= least], n[n >= least].astype(_U)

    def contexts(self, hot: "Hot") -> None:
        """Sorts the tokens by context, word and longer context. A pair's key: 40 bits of context, 24 of the word; 8 more bits of the word beside.

        A token in a hot context asks twice: for the context's pair in the slice of the word, and for the longer context, if that
        isn't hot itself, in the slice of the context's own first word.
        """
        w, n = self.words[self.index], len(self.index)
        self.hot1 = hot.find(self.one)
        self.hot2 = np.full(n, -1)
        at = np.flatnonzero(self.hot1 >= 0)
        self.hot2[at] = hot.find(gram(self.two[at], self.one[at]))
        again = at[self.hot2[at] < 0]
        context = _mix(self.one)
        context[at] = hot.by_word(self.one[at], self.hot1[at], w[at])
        longer = _mix(self.two) >> _U(40)
        longer[again] = 0
        context = np.concatenate([context, hot.by_first(self.one[again], self.hot1[again], self.two[again])])
        longer = np.concatenate([longer, _mix(self.two[again]) >> _U(40)])
        w, weight = np.concatenate([w, w[again]]), np.concatenate([self.weight, self.weight[again]])
        a = (context >> _U(24) << _U(24)) | (w >> _U(40))
        b = ((w >> _U(32) & _U(255)) << _U(24) | longer).astype(np.uint32)
        del context, longer, w
        order = np.lexsort((b, a))
        a, b, weight = a[order], b[order], weight[order]
        low = (b >> np.uint32(24)).astype(np.uint8)
        new_pair = np.ones(len(a), bool)
        new_pair[1:] = (a[1:] != a[:-1]) | (low[1:] != low[:-1])
        new_triple = new_pair.copy()
        new_triple[1:] |= b[1:] != b[:-1]
        of_pair, of_triple = np.cumsum(new_pair) - 1, np.cumsum(new_triple) - 1
        pair, triple = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        pair[order], triple[order] = of_pair, of_triple
        self.pair, self.triple = pair[:n], triple[:n]
        self.triple[again] = triple[n:]
        self.pairs, self.lows = a[new_pair], low[new_pair]
        self.pair_counts = np.bincount(of_pair[weight], minlength=len(self.pairs)).astype(np.uint32)
        self.longer = (b[new_triple] & np.uint32(0xFFFFFF)).astype(np.uint32)
        self.triple_pair = of_pair[new_triple]
        self.triple_counts = np.bincount(of_triple[weight], minlength=len(self.longer)).astype(np.uint32)


def gram(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The name of a context of two words, of which the first counts by the 24 bits that a triple has of it."""
    return _mix((_mix(two) >> _U(40)) + _mix(one) * _U(0x9E3779B97F4A7C15))


def _slice(x: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Of first words, by the 24 bits that a triple has of them: words that are one in a whole context are one in its slices."""
    return (_mix(_mix(x) >> _U(40) ^ _U(0xA5A5A5A5)) >> _U(40)) & (slices - 1).astype(_U)


class Hot:
    """The hot contexts: names of one-word and two-word contexts, and into how many slices (a power of two) each is split."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, limit: int):
        order = np.argsort(names)
        self.names, self.counts = names[order], counts[order].astype(np.int64)
        self.slices = np.array([1 << (int(c) // limit).bit_length() for c in self.counts], np.int64)
        self.part, self.part_of = self._parts(1)
        self.first, self.first_of = self._parts(1 << 40)

    def _parts(self, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (40 bits) of all slices, sorted, and whose they are."""
        part = sorted((int(_mix(np.array([h ^ _mix(np.array([t + salt], _U))[0]], _U))[0] >> _U(24)), j) for j, h in enumerate(self.names) for t in range(self.slices[j]))
        return np.array([x for x, _ in part], _U), np.array([j for _, j in part], np.int64)

    def find(self, names: np.ndarray) -> np.ndarray:
        """The place of each name, -1 for those that aren't hot."""
        return _find(self.names, names)

    def by_word(self, h: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        return _mix(h ^ _mix(((_mix(word >> _U(32)) >> _U(40)) & (self.slices[place] - 1).astype(_U)) + _U(1)))

    def by_first(self, h: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _mix(h ^ _mix(_slice(first, self.slices[place]) + _U(1 << 40)))

    def of(self, contexts: np.ndarray) -> np.ndarray:
        """The hot context whose slice by word has this number (40 bits), or -1."""
        at = _find(self.part, contexts)
        return np.where(at >= 0, self.part_of[at], -1) if len(self.part) else at

    def of_first(self, contexts: np.ndarray) -> np.ndarray:
        """The same for slices by first word."""
        at = _find(self.first, contexts)
        return np.where(at >= 0, self.first_of[at], -1) if len(self.first) else at


def _find(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, at, -1)


def _cells(word32: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word's two cells in the sketch, from the first 32 bits of its hash."""
    word32 = word32.astype(np.int64)
    return (word32 >> 16) * CELLS + (word32 >> 11 & 31), (word32 >> 16) * CELLS + (word32 >> 6 & 31)


def left_out(size, kinds, once, again):
    """What the test makes of a context's sums: ``again`` is that of c log((c - 1 - DISCOUNT) / parent) over words seen twice or more."""
    with np.errstate(divide="ignore", invalid="ignore"):
        new = np.where(once > 0, once * np.log(DISCOUNT * (kinds - 1) / (size - 1)), 0)
        return np.where(size > 1, again - (size - once) * np.log(np.maximum(size - 1, 1)) + new, 0)


def _sums(of: np.ndarray, count: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Size, kinds, words seen once, and the sum of the others, for each context."""
    with np.errstate(divide="ignore"):
        again = np.where(count > 1, count * np.log(np.maximum(count - 1 - DISCOUNT, 1e-9) / parent), 0)
    return tuple(np.bincount(of, x) for x in (count, count > 0, count == 1, again))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """Chunks of the partition with ids that are the same in each run over the same files."""
    base, at = TaskContext.get().partitionId() << 32, 0
    docs: list = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for d, t in zip(b.column("doc").to_pylist(), text_bytes(b.column("text")), strict=True):
            if docs and size + len(t) > CHUNK:
                yield base + at, docs, texts
                docs, texts, size, at = [], [], 0, at + 1
            docs.append(d)
            texts.append(t)
            size += len(t) + 1
    if docs:
        yield base + at, docs, texts


def _row(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _cuts(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard's keys begin in sorted keys; the shard is the key's top bits."""
    return np.searchsorted(keys >> _U(64 - bits), np.arange(shards + 1).astype(_U)) if bits else np.array([0, len(keys)])


def score_texts(spark: SparkSession, docs: DataFrame, doc: str = "doc_id", text: str = "text", share: int = SHARE, limit: int | None = None, exact: bool | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc``, ``held_out`` boolean, ``n_tokens``, ``n_known``, ``train_tokens`` (long), ``base_score`` and ``score`` (double).

    ``docs`` must give the same rows in the same partitions each time it is read (a table does). Every row gives one row, repeated
    rows too. A null text is empty; an empty text has its end alone. A null id counts as the empty text in the fold. Scores are
    sums of log10 probabilities; with no training rows the base knows no token. An empty table gives an empty result. Other
    columns are ignored.

    ``limit``: occurrences from which a context is split (``LIMIT``). ``exact``: it changes no score; that is so unless a caller
    names a limit of its own, and then if asked for.
    """
    exact, limit = limit is None if exact is None else exact, LIMIT if limit is None else limit
    source = docs.select(F.col(doc).cast("long").alias("doc"), whole_text(text).alias("text"))
    volume = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(24, max(0, (int(volume) // share).bit_length()))
    shards = 1 << bits

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in _chunks(batches):
            c = Chunk(ids, texts)
            cuts = _cuts(c.words, bits, shards)
            grams, times = c.common()
            parts = _cuts(grams, bits, shards)
            yield _row(
                shard=pa.array(range(shards), pa.int32()), chunk=pa.array([name] * shards, pa.int64()),
                keys=[_pack(np.diff(c.words[i:j], prepend=_U(0))) for i, j in zip(cuts, cuts[1:], strict=False)],
                counts=[_pack(c.counts[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)],
                grams=[np.stack([grams[i:j], times[i:j]]).tobytes() for i, j in zip(parts, parts[1:], strict=False)],
            )

    def answer_words(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(x, "<u8"), dtype=_U) for x in t["keys"].to_pylist()]
        counts = np.concatenate([_unpack(x, "<u8") for x in t["counts"].to_pylist()])
        word, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(word), _U)
        np.add.at(total, of, counts)
        first, second = (np.bincount(x, total, CLASSES * CELLS) for x in _cells(word >> _U(32)))
        shard = t["shard"][0].as_py()
        span = slice(shard * CLASSES >> bits, max((shard + 1) * CLASSES >> bits, (shard * CLASSES >> bits) + 1))
        sketch = np.log1p(np.stack([first, second]).reshape(2, CLASSES, CELLS)[:, span]).astype(np.float16)
        grams = np.concatenate([np.frombuffer(x, _U).reshape(2, -1) for x in t["grams"].to_pylist()], 1)
        gram_names, of_gram = np.unique(grams[0], return_inverse=True)
        times = np.bincount(of_gram, grams[1], len(gram_names)).astype(_U)
        names, times = np.append(word, gram_names), np.append(total, times)
        hot = np.stack([names, times])[:, times >= limit]
        answers = np.split(total[of], np.cumsum([len(k) for k in keys])[:-1])
        blank = [None] * len(keys)
        return pa.table({
            "chunk": pa.array([*t["chunk"].to_pylist(), None], pa.int64()), "shard": pa.array([shard] * (len(keys) + 1), pa.int32()), "counts": [*map(_pack, answers), None],
            "n": pa.array([*blank, int(total.sum())], pa.int64()), "v": pa.array([*blank, int((total > 0).sum())], pa.int64()),
            "sketch": [*blank, zstandard.compress(sketch.tobytes(), 1)], "hot": [*blank, hot.tobytes()],
        })

    asked = source.mapInArrow(ask_words, "shard int, chunk long, keys binary, counts binary, grams binary")
    words = written(spark, asked.groupBy("shard").applyInArrow(answer_words, "chunk long, shard int, counts binary, n long, v long, sketch binary, hot binary"), "word-counts")
    totals = words.filter("chunk IS NULL").orderBy("shard").collect()  # one row a shard: its part of the sketch, and hot contexts
    tokens, kinds = sum(t["n"] for t in totals), sum(t["v"] for t in totals)
    sketch = np.zeros((2, CLASSES, CELLS), np.float32)
    for t in totals:
        part = np.frombuffer(zstandard.decompress(t["sketch"]), np.float16).reshape(2, -1, CELLS).astype(np.float32)
        at = t["shard"] * CLASSES >> bits
        sketch[:, at : at + part.shape[1]] = np.log1p(np.expm1(sketch[:, at : at + part.shape[1]]) + np.expm1(part))
    told_sketch = spark.sparkContext.broadcast(zstandard.compress(np.minimum(sketch, 30).astype(np.float16).tobytes(), 1))  # 8 MB at most
    found = np.concatenate([np.frombuffer(t["hot"], _U).reshape(2, -1) for t in totals], 1) if totals else np.zeros((2, 0), _U)
    most = max(limit, tokens >> 12)
    hot = Hot(*found[:, found[1] >= _U(most)], most)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in _chunks(batches):
            c = Chunk(ids, texts)
            c.contexts(hot)
            del c.one, c.two, c.index, c.weight, c.hot1, c.hot2, c.pair, c.triple  # what asks doesn't need
            cuts = _cuts(c.pairs, bits, shards)
            part = np.searchsorted(c.triple_pair, cuts)
            fan = np.bincount(c.triple_pair, minlength=len(c.pairs)).astype(np.uint32)
            longer = np.stack([c.longer & np.uint32(255), c.longer >> np.uint32(8) & np.uint32(255), c.longer >> np.uint32(16)]).astype(np.uint8)
            spans, triples = list(zip(cuts, cuts[1:], strict=False)), list(zip(part, part[1:], strict=False))
            yield _row(
                shard=pa.array(range(shards), pa.int32()), chunk=pa.array([name] * shards, pa.int64()), keys=[_pack(np.diff(c.pairs[i:j], prepend=_U(0))) for i, j in spans],
                lows=[_pack(c.lows[i:j]) for i, j in spans], counts=[_pack(c.pair_counts[i:j]) for i, j in spans], fan=[_pack(fan[i:j]) for i, j in spans],
                longer=[zstandard.compress(longer[:, i:j].tobytes(), 1) for i, j in triples], longer_counts=[_pack(c.triple_counts[i:j]) for i, j in triples],
            )

    def base_of(word32: np.ndarray) -> np.ndarray:
        cells = _cells(word32)
        sketch = np.frombuffer(zstandard.decompress(told_sketch.value), np.float16).reshape(2, -1)
        return (np.expm1(np.minimum(sketch[0][cells[0]], sketch[1][cells[1]]).astype(np.float64)) + 0.5) / (tokens + 0.5 * (kinds + 1))

    def tell_hot(t: pa.Table) -> pa.Table:
        """For each hot context with a slice here, to each shard with a slice of it: the slices' sums, and to slices by first word the pairs seen twice or more."""
        out: dict[str, list] = {x: [] for x in ("shard", "hot", "sums", "words", "times")}
        home = lambda x: x >> _U(40 - bits) if bits else x * _U(0)
        if (home(hot.part) == _U(t["shard"][0].as_py())).any():
            keys = [np.cumsum(_unpack(x, "<u8"), dtype=_U) for x in t["keys"].to_pylist()]
            key, low, count = np.concatenate(keys), *(np.concatenate([_unpack(x, kind) for x in t[n].to_pylist()]) for n, kind in (("lows", "u1"), ("counts", "<u4")))
            of = hot.of(key >> _U(24))
            at = np.flatnonzero((of >= 0) & (count > 0))
            pair, which = np.unique((of[at].astype(_U) << _U(32)) | (key[at] & _U(0xFFFFFF)) << _U(8) | low[at], return_inverse=True)
            times, of, word = np.bincount(which, count[at], len(pair)), (pair >> _U(32)).astype(np.int64), pair & _U(0xFFFFFFFF)
            base = base_of(word)
            for j in np.unique(of):
                mine = of == j
                sums = np.concatenate(_sums(np.zeros(mine.sum(), np.int64), times[mine], base[mine])).astype(np.float64).tobytes()
                again = mine & (times > 1)
                words, counts = _pack(np.diff(word[again], prepend=_U(0)).astype(np.uint32)), _pack(times[again].astype(np.uint32))
                by_first = set(home(hot.first[hot.first_of == j]).tolist())
                for to in by_first | set(home(hot.part[hot.part_of == j]).tolist()):
                    for name, x in (("shard", to), ("hot", int(j)), ("sums", sums), ("words", words if to in by_first else None), ("times", counts if to in by_first else None)):
                        out[name].append(x)
        return pa.table([pa.array(x, k) for x, k in zip(out.values(), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=list(out))

    def exact_parent(told: pa.Table, of: np.ndarray, by_first: np.ndarray, word: np.ndarray, c1: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The share in hot context ``of`` with one occurrence left out, or the base; in slices by first word, ``c1`` counts a part of the occurrences alone."""
        told_of = np.array(told["hot"].to_pylist(), np.int64)
        sums = np.array([np.frombuffer(x, np.float64) for x in told["sums"].to_pylist()]).reshape(-1, 4)
        size, many, once, again = (np.bincount(told_of, x, len(hot.names)) for x in sums.T)
        keep = (size > 1) & (left_out(size, many, once, again) > DIVERGENCE)
        pairs = [np.zeros(0, _U), *((_U(j) << _U(32)) | np.cumsum(_unpack(w, "<u4"), dtype=_U) for j, w in zip(told_of, told["words"].to_pylist(), strict=True) if w is not None)]
        times = np.concatenate([np.zeros(0, np.uint32), *(_unpack(x, "<u4") for x in told["times"].to_pylist() if x is not None)])
        pairs = np.concatenate(pairs)
        order = np.argsort(pairs)
        at = _find(pairs[order], (of.astype(_U) << _U(32)) | word)
        all1 = np.where(by_first, np.where(at >= 0, times[order][at], 1) if len(times) else 1, c1)
        loo = (np.maximum(all1 - 1 - DISCOUNT, 0) + DISCOUNT * (many[of] - (all1 == 1)) * base) / np.maximum(size[of] - 1, 1)
        return np.where(keep[of] & (loo > 0), loo, base)

    def answer_pairs(t: pa.Table, hot_told: pa.Table | None = None) -> pa.Table:
        load = lambda name, kind: [_unpack(x, kind) for x in t[name].to_pylist()]
        keys = [np.cumsum(x, dtype=_U) for x in load("keys", "<u8")]
        sizes, d = [len(k) for k in keys], DISCOUNT
        key, low, fan = np.concatenate(keys), np.concatenate(load("lows", "u1")), np.concatenate(load("fan", "<u4"))
        _, first, of = np.unique(_mix(key) * _U(0x9E3779B97F4A7C15) + low, return_index=True, return_inverse=True)
        c1 = np.bincount(of, np.concatenate(load("counts", "<u4")))
        key, low = key[first], low[first]
        name, ctx = np.unique(key >> _U(24), return_inverse=True)
        hot1 = hot.of(name)  # of each context: the hot one that it is a slice of
        word = (key & _U(0xFFFFFF)) << _U(8) | low
        base = base_of(word)
        sums1 = size1, kinds1, _, _ = _sums(ctx, c1, base)
        keep1 = ((size1 > 1) & (left_out(*sums1) > DIVERGENCE))[ctx]
        a1 = np.where(keep1, np.maximum(c1 - d, 0) / np.maximum(size1[ctx], 1), 0)
        b1 = np.where(keep1, d * kinds1[ctx] / np.maximum(size1[ctx], 1), 1)
        split1 = hot1[ctx] >= 0
        a1, b1 = np.where(split1, c1, a1), np.where(split1, 0, b1)
        # A word's parent in the test of longer contexts: the pair's share with one occurrence left out, or the base.
        loo1 = (np.maximum(c1 - 1 - d, 0) + d * (kinds1[ctx] - (c1 == 1)) * base) / np.maximum(size1[ctx] - 1, 1)
        parent = np.where(keep1 & (loo1 > 0), loo1, base)
        if hot_told is not None:
            first1 = np.where(split1, -1, hot.of_first(name)[ctx])
            at = np.flatnonzero(split1 | (first1 >= 0))
            parent[at] = exact_parent(hot_told, np.where(split1, hot1[ctx], first1)[at], ~split1[at], word[at], c1[at], base[at])
        elif split1.any():  # within a slice the context's own size is known, its kinds are not
            parent = np.where(split1, np.where(c1 > 1, np.maximum(c1 - 1 - d, 1e-9) / np.maximum(hot.counts[hot1[ctx]] - 1, 1), base), parent)

        raw = [np.frombuffer(zstandard.decompress(x), np.uint8).reshape(3, -1).astype(_U) for x in t["longer"].to_pylist()]
        more = np.concatenate([x[0] | x[1] << _U(8) | x[2] << _U(16) for x in raw])
        pair = np.repeat(of, fan)  # of each triple asked
        _, first, of3 = np.unique((pair.astype(_U) << _U(24)) | more, return_index=True, return_inverse=True)
        c2 = np.bincount(of3, np.concatenate(load("longer_counts", "<u4")), minlength=len(first))
        pair3, more = pair[first], more[first]
        name2, ctx2 = np.unique((ctx[pair3].astype(_U) << _U(24)) | more, return_inverse=True)
        sums2 = size2, kinds2, _, _ = _sums(ctx2, c2, parent[pair3])
        keep2 = ((size2 > 1) & (left_out(*sums2) > DIVERGENCE))[ctx2]
        split2 = split1[pair3]
        a2 = np.where(split2, c2, np.where(keep2, np.maximum(c2 - d, 0) / np.maximum(size2[ctx2], 1), 0))
        b2 = np.where(split2, 0, np.where(keep2, d * kinds2[ctx2] / np.maximum(size2[ctx2], 1), 1))

        # Sums of the slices here of hot contexts: which context (by last word and first word, 0 for one-word ones) and its four sums.
        mine, mine2 = np.flatnonzero(hot1 >= 0), np.flatnonzero(hot1[(name2 >> _U(24)).astype(np.int64)] >= 0)
        last = hot1[(name2[mine2] >> _U(24)).astype(np.int64)]
        rows = [np.stack([hot1[mine], np.zeros(len(mine)), *(x[mine] for x in sums1)]), np.stack([last, (name2[mine2] & _U(0xFFFFFF)).astype(np.float64), *(x[mine2] for x in sums2)])]
        rows = np.concatenate(rows, 1)
        slices = zstandard.compress(rows[:, (rows[1] > 0) | (np.arange(rows.shape[1]) < len(mine))].astype(np.float64).tobytes(), 1)

        at, at3 = np.cumsum(sizes)[:-1], np.cumsum([x.shape[1] for x in raw])[:-1]
        out = {n: [_pack_shares(p) for p in np.split(x[o], cut)] for n, x, o, cut in (("a1", a1, of, at), ("b1", b1, of, at), ("a2", a2, of3, at3), ("b2", b2, of3, at3))}
        return pa.table({"chunk": t["chunk"], "shard": t["shard"], **out, "slices": [slices] * len(keys)})

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in _chunks(batches):
            yield _row(chunk=pa.array([name], pa.int64()), docs=pa.array([ids], pa.list_(pa.int64())), sizes=_one(np.array([len(x) for x in texts], np.int64)), texts=[zstandard.compress(b"".join(texts), 6)])

    def _one(x: np.ndarray) -> list[bytes]:
        return [_pack(x)]

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        docs, sizes, blob = own["docs"][0].as_py(), _unpack(own["sizes"][0].as_py(), "<i8"), zstandard.decompress(own["texts"][0].as_py())
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        c = Chunk(docs, [blob[i:j] for i, j in zip(cuts, cuts[1:], strict=False)])
        c.contexts(hot)
        told = told.sort_by("shard")
        gather = lambda name, load: np.concatenate([load(x) for x in told[name].to_pylist() if x is not None])
        counts, a1, b1, a2, b2 = gather("counts", lambda x: _unpack(x, "<u8")), *(gather(x, _unpack_shares) for x in ("a1", "b1", "a2", "b2"))
        if len(counts) != len(c.words) or len(a1) != len(c.pairs) or len(a2) != len(c.longer):
            raise RuntimeError("the documents changed between two reads")
        known = counts[c.index]
        base = (known + 0.5) / (tokens + 0.5 * (kinds + 1))
        sums = gather("slices", lambda x: np.frombuffer(zstandard.decompress(x), np.float64).reshape(6, -1).T).T
        a1, b1, a2, b2 = a1[c.pair], b1[c.pair], a2[c.triple], b2[c.triple]
        for place, first, a, b in ((c.hot1, np.zeros(len(base)), a1, b1), (c.hot2, _mix(c.two) >> _U(40), a2, b2)):
            at = np.flatnonzero(place >= 0)
            if len(at):
                a[at], b[at] = _joined(sums, c.hot1[at], first[at], a[at])
        p = a1 + b1 * base
        p = a2 + b2 * p
        per_doc = lambda x: np.add.reduceat(x, c.starts)
        return pa.table({
            "doc": pa.array(docs, pa.int64()), "held_out": ~c.train, "n_tokens": c.ends - c.starts, "n_known": per_doc((known > 0).astype(np.int64)),
            "train_tokens": np.full(len(docs), tokens, np.int64), "base_score": per_doc(np.log10(base)), "score": per_doc(np.log10(np.minimum(p, 1.0))),
        })

    pairs = source.mapInArrow(ask_pairs, "shard int, chunk long, keys binary, lows binary, counts binary, fan binary, longer binary, longer_counts binary")
    answered = "chunk long, shard int, a1 binary, b1 binary, a2 binary, b2 binary, slices binary"
    if exact and len(hot.names):  # the pairs are dealt out once and read twice
        told_hot = pairs.groupBy("shard").applyInArrow(tell_hot, "shard int, hot int, sums binary, words binary, times binary")
        answers = pairs.groupBy("shard").cogroup(told_hot.groupBy("shard")).applyInArrow(lambda t, h: answer_pairs(t, h), answered)
    else:
        answers = pairs.groupBy("shard").applyInArrow(lambda t: answer_pairs(t), answered)
    told = answers.unionByName(words.filter("chunk IS NOT NULL").select("chunk", "shard", "counts"), allowMissingColumns=True)
    own = source.mapInArrow(carry, "chunk long, docs array<long>, sizes binary, texts binary")
    return own.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, "doc long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("doc", "doc_id")


QUERIES = {"op5_suffix_tree": op5_suffix_tree}
ORACLES: dict[str, str] = {}  # learned; tests compare base_score with brute force and score with a plain suffix tree
