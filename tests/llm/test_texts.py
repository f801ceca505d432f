"""Operators on documents, each against a plain version of its contract."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import counting, decontaminate, lines, neardup, packing, quality, sharding, suffix, tokens

KIND = "doc_id long, text string, n long, key string, id long, h long"
WORDS = "the of and river stone Light WATER über naïve a1 b2 c3 x-y it's end".split()


def corpus(seed=1, n=60):
    r = random.Random(seed)
    out = [(None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "ONE"), (6, "a b c"), (6, "a b c"), (7, "\n\n"), (8, "x" * 5000), (9, "emoji 🙂 　 wide")]
    base = [" ".join(r.choice(WORDS) for _ in range(r.randint(3, 90))) for _ in range(12)]
    for i in range(20, 20 + n):
        t = r.choice(base).split(" ")
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice(WORDS)
        sep = r.choice([" ", " ", "\n"])
        out.append((i, sep.join(t)))
    out.append((15, " ".join(r.choice(WORDS) for _ in range(9000))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns, clashing names among them."""
    return spark.createDataFrame([(d, t, 7, "k", 1, 2) for d, t in corpus()], KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_shards(spark, docs, none, tmp_path):
    sized = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), "n")
    got = sharding.shard_by_bytes(spark, sized, "size", ["doc_id", "size"]).collect()
    assert len(got) == len(corpus())
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(8))
    for s in range(8):
        assert abs(sum(r["size"] for r in by[s]) - total / 8) <= largest
        assert sorted(r["slot"] for r in by[s]) == list(range(len(by[s])))
    order = [(r["shard"], r["slot"]) for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["slot"]))]
    assert order == sorted(order)
    assert sharding.shard_by_bytes(spark, none.select("doc_id", F.lit(1).cast("long").alias("size")), "size", ["doc_id"]).isEmpty()
    sharding.write_shards(spark, docs.select("doc_id", "text"), f"{tmp_path}/out", 3)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(corpus())
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(spark, docs.withColumn("slot", F.lit(1)), "n", ["doc_id"])


def brute_hits(text, items):
    w = decontaminate.words_of((text or "").encode())
    hit, names = set(), set()
    for name, item in items:
        x = decontaminate.words_of((item or "").encode())
        n = min(13, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                if name is not None:
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_contamination(spark, docs, none, block):
    r = random.Random(3)
    texts = [t for _, t in corpus() if t and len(t.split()) > 20]
    items = [(i, " ".join(x.split()[2 : 2 + r.randint(11, 30)])) for i, x in enumerate(texts[:8])] + [(100, None), (101, ""), (102, "one"), (None, "ONE!"), (103, "river stone"), (104, texts[0]), (105, texts[0]), (11, "river  stone")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(spark, docs, bench, block_bytes=block)
    assert found.columns[: len(docs.columns)] == docs.columns
    got = found.withColumns(decontaminate.contamination_report(found)).collect()
    want = Counter()
    for d, t in corpus():
        n, hit, names = brute_hits(t, items)
        want[(d, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= n)] += 1
    assert Counter((x["doc_id"], x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) for x in got) == want
    clean = decontaminate.find_contamination(spark, docs, bench.limit(0))
    assert clean.filter(F.size("hit_items") > 0).isEmpty() and clean.count() == len(corpus())
    assert decontaminate.find_contamination(spark, none, bench).isEmpty()


def test_winnowing_guarantee():
    r = random.Random(4)
    for _ in range(200):
        shared = [r.randrange(1, 5) for _ in range(13)]
        sides = [np.array([r.randrange(1, 5) for _ in range(r.randrange(20))] + shared + [r.randrange(1, 5) for _ in range(r.randrange(20))]) for _ in range(2)]
        prints = [{int(h[p]) for h in [decontaminate._gram_hashes(s, 5)] for p in decontaminate.winnow(h, 9)} for s in sides]
        assert prints[0] & prints[1]


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(neardup.FOLD).split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, docs, none, width):
    got = neardup.near_duplicates(spark, docs, width=width).collect()
    assert Counter((r["doc"], r["n"], r["component"]) for r in got) == brute_components(corpus(), width, 80)
    assert neardup.near_duplicates(spark, none, width=width).isEmpty()
    kept = neardup.keep_one(spark, docs, width=width)
    assert kept.columns == docs.columns
    have = [(r["doc_id"], r["text"]) for r in kept.collect()]
    classes = [c for c in Counter(r["component"] for r in got if r["n"])]
    assert sum(1 for _, t in have if (t or "").encode().split()) == len(classes)
    assert sum(1 for _, t in have if not (t or "").encode().split()) == sum(1 for r in got if not r["n"])


def test_keep_one_of_each_component(spark):
    """Unrelated texts without an id all stay, and so do unlike texts of one id; copies go, whatever their id."""
    texts = [" ".join(f"{a}{i}" for i in range(20)) for a in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[4]), (None, texts[5]), (8, texts[5]), (8, texts[5] + " more")]
    kept = neardup.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4])]
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert {k: n for k, n in got.items() if k[0] != 8} == dict.fromkeys(want, 1)
    assert [n for k, n in got.items() if k[0] == 8] == [1]


def test_near_duplicates_in_chains(spark):
    """Each is like the next but the ends are not alike; one large group of copies besides."""
    base = [f"w{i}" for i in range(100)]
    rows = [(1000 + k, " ".join(f"v{i}" if i < 3 * k else w for i, w in enumerate(base))) for k in range(12)] + [(5000 + i, "same words in each of them here") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(spark, df, width=4).collect()
    assert Counter((r["doc"], r["n"], r["component"]) for r in got) == brute_components(rows, 4, 80)


def test_bayesian_bounds():
    assert [neardup.least_matches(n, 80) for n in (32, 288)] == sorted(neardup.least_matches(n, 80) for n in (32, 288))
    for n in (32, 64, 128, 288):
        m = neardup.least_matches(n, 80)
        draws = np.random.default_rng(1).beta(1 + m, 1 + n - m, 200_000)
        assert 0 < m < 0.8 * n and (draws >= 0.8).mean() < 1e-3


def test_lines(spark, none):
    long = "passage of words that comes again and again in several documents of the corpus, well over fifty words of it"
    rows = [
        (1, f"own line one here\n{long}\n\nPage 3 of 10 in the yearly report of 2020"), (2, f"{long}\nanother own line"), (3, f"third\nPage 4 of 12 in the yearly report of 2021\n{long}"), (4, "unlike all others\r\nkept  as it is \n"), (5, None), (6, ""),
        (None, f"nobody's line\n{long}"), (None, "nobody's line"), (7, "twice here\ntwice here"), (8, long.replace("several", "some")), (9, long),
    ]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_chars long")
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(spark, df).collect()}
    kept_by_none = lines.NO_ID  # rows without an id come first of all
    assert kept_by_none < 0
    assert got == {
        (1, "own line one here\n\nPage 3 of 10 in the yearly report of 2020", 4, 1), (2, "another own line", 2, 1), (3, "third", 3, 2), (4, rows[3][1], 3, 0), (5, None, 0, 0), (6, "", 1, 0),
        (None, rows[6][1], 2, 0), (None, rows[7][1], 1, 0), (7, rows[8][1], 2, 0), (8, "", 1, 1), (9, "", 1, 1),
    }
    out = lines.drop_recurring_lines(spark, df)
    assert out.columns == df.columns
    left = {(r["doc_id"], r["n_chars"]) for r in out.collect()}
    assert {d for d, _ in left} == {1, 2, 3, 4, 5, 6, None, 7} and (2, len("another own line")) in left and (4, 0) in left
    assert lines.dedup_lines(spark, none).isEmpty()


def plain_lines(rows):
    """The lines that are left of each document, by comparison with all that stay in earlier ones."""

    def is_like(a, b):
        same = len(a) == len(b) >= lines.SHORTEST and a[: lines.LEADING] == b[: lines.LEADING]
        return a == b or (same and (100 * sum(x == y for x, y in zip(a, b, strict=True)) >= 80 * len(a) or bool(set(lines.template_keys(a)) & set(lines.template_keys(b)))))

    stay, out = [], {}
    for d, t in sorted(rows):
        own = [(x, lines.tokens_of(x.encode())) for x in t.split("\n")]
        left = [(x, k) for x, k in own if not any(is_like(k, y) for y in stay)]
        stay += [k for _, k in left]
        out[d] = "\n".join(x for x, _ in left)
    return out


@pytest.mark.parametrize("cells", [200, 1 << 21])
def test_lines_agree_in_place(spark, cells, monkeypatch):
    """Changes in several stretches, chains, leaves of many lines, lines of one document that are alike."""
    r = random.Random(11)
    base = [[f"b{'abcdefgh'[i]}" for _ in range(3)] + [r.choice("pqrstuvw") * (1 + j % 3) for j in range(n)] for i, n in enumerate((54, 7, 17, 17, 5))]
    rows = []
    for d in range(90):
        own = []
        for _ in range(r.randint(1, 4)):
            t = list(r.choice(base))
            for _ in range(r.choice([0, 1, 2, 3, 5, len(t) // 3])):
                t[r.randrange(3, len(t))] = r.choice("xyz")
            own.append(" ".join(t))
        rows.append((d, "\n".join(own)))
    far = base[0][:20] + ["other"] + base[0][21:45] + ["words"] + base[0][46:]  # 57 tokens, two stretches
    rows += [(200, " ".join(far)), (300, "keep this line\n" + " ".join(far[:30] + ["third"] + far[31:]))]
    chain = [f"chain of lines that go {'xyzw'[i]} {'x' * (i > 0)}y {'x' * (i > 1)}z now then" for i in range(4)]
    rows += [(400 + i, x) for i, x in enumerate(chain)]
    monkeypatch.setattr(lines.recurring_lines, "__defaults__", ("doc_id", "text", cells))
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_lines(rows)
    assert got[200] == "" and got[300] == "keep this line"


def test_lines_that_go_have_one_that_stays(spark):
    """B goes because of A; C, like B alone, stays and takes D along."""
    a = "the head of a line with ten more words in it all told".split()
    b, c, d = list(a), list(a), list(a)
    b[4:6] = c[4:6] = d[4:6] = ["x", "y"]
    c[8:10] = d[8:10] = ["z", "w"]
    d[12] = "v"
    assert len({lines.leaf_key([x, b"b", b"c"] + [b"d"] * n) for x in (b"a", b"b") for n in range(5, 3000)}) == 2 * 2995
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate((a, b, c, d), 1)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark, df).collect()}
    assert got == {1: " ".join(a), 2: "", 3: " ".join(c), 4: ""}


def test_template_keys():
    a = lines.tokens_of(b"one two three four five six seven eight nine ten")
    b = lines.tokens_of(b"one two three four five six seven eight other ten")
    c = lines.tokens_of(b"one two three four five six seven other nine else")
    assert set(lines.template_keys(a)) & set(lines.template_keys(b)) and not set(lines.template_keys(a)) & set(lines.template_keys(c))
    assert lines.tokens_of(b"on 2024-01-02 at 5pm") == [b"on", b"<*>", b"at", b"<*>"] and lines.template_keys(a[:7]) == []


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_tokenizer())
    plain.encode_special_tokens = True
    got = packing.pack_documents(spark, docs).collect()
    want = Counter()
    for d, t in corpus():
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        start, piece = 0, 0
        while start < len(ids):
            stop = start + ((len(ids) - start) % 2048 or 2048)
            want[(d, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes()))] += 1
            start, piece = stop, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    check_packing(got)
    used = len({r["sequence_id"] for r in got})
    assert used == packing.lower_bound(Counter(r["length"] for r in got), 2048)
    assert packing.pack_documents(spark, none).isEmpty()
    pieces = packing.token_pieces(docs.filter("doc_id = 15"))
    rows = packing.sequences(pieces, spark.createDataFrame([r for r in got if r["doc_id"] == 15])).collect()
    assert sum(len(r["ids"]) for r in rows) == 4 * sum(r["length"] for r in got if r["doc_id"] == 15)


def test_added_tokens(spark):
    """The added token's string, whole, cut, repeated or made by an edit, against the library's defaults."""
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(tokens.default_tokenizer()), tokens.Encoder(tokens.default_tokenizer())
    r, parts = random.Random(8), ["<|endoftext|>", "<|endof", "text|>", "<", "|>", "a", " ", "  ", "\n", " b", "é", "1", "'s"]
    texts = ["a<|endoftext|>b", *("".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(500))]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        tree = counting.TokenTree(t, encoder, leaf=r.choice([1, 3, 8]))
        a = r.randint(0, len(t))
        b, new = r.randint(a, len(t)), r.choice(parts)
        tree.edit(a, b, new)
        assert tree.count == len(library.encode(t[:a] + new + t[b:], add_special_tokens=False).ids)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in enumerate(texts)}
    assert {x["doc_id"]: bytes(x["ids"]) for x in packing.token_pieces(df).collect()} == want
    assert {x["doc_id"]: 4 * x["n_tokens"] + 4 for x in counting.count_tokens(df).collect()} == {i: len(x) for i, x in want.items()}


def check_packing(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion(seed):
    r = random.Random(seed)
    hist = Counter(r.randint(200, 1500) for _ in range(r.choice([3, 12, 60, 300])))
    plan = packing.complete(hist, 2048, 300)
    assert sum((Counter({n: c * times for n, c in pattern}) for pattern, times in plan), Counter()) == hist
    assert all(sum(n * c for n, c in pattern) <= 2048 for pattern, _ in plan)
    assert packing.lower_bound(hist, 2048) <= sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(hist, 2048))
    assert packing.complete({}, 2048) == []


def test_fillings_of_many_tiny_items():
    assert packing.fillings({1: 5000}, 1000) == [Counter({1: 1000})]
    assert packing.fillings({1: 5000, 2: 1}, 548)[0] == Counter({2: 1, 1: 546})
    assert packing.fillings({5: 2, 3: 2}, 9) == [Counter({5: 1, 3: 1})] and packing.fillings({9: 1}, 5) == [Counter()]


def test_bin_completion_beats_best_fit():
    hist = Counter([6, 6, 5, 5, 5, 4, 4, 3, 2, 2])  # 42 in bins of 14: three suffice
    assert sum(t for _, t in packing.complete(hist, 14)) == 3


def test_token_trees(spark, docs, none):
    encoder = tokens.Encoder(tokens.default_tokenizer())
    r, letters = random.Random(6), "ab '1!.\n\t  é\xa0 \x1dß"
    for _ in range(300):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        tree = counting.TokenTree(text, encoder, leaf=r.choice([1, 3, 8]))
        for _ in range(3):
            a = r.randint(0, len(text))
            b = r.randint(a, len(text))
            new = "".join(r.choice(letters) for _ in range(r.randint(0, 6)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.count == encoder.count(text)
    long = " ".join(r.choice(WORDS) for _ in range(5000))
    tree = counting.TokenTree(long, encoder)
    tree.edit(9000, 9004, "x")
    assert tree.reencoded < 2000
    got = {r["doc_id"]: r for r in counting.count_tokens(docs).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[15]["n_tokens"] == encoder.count(dict(corpus())[15])
    edited = spark.createDataFrame([(1, "mail a.b@c.org or +1 (555) 123-4567 now"), (2, "plain")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in counting.count_tokens(edited).collect()}
    assert rows[1]["n_edits"] == 2 and rows[1]["n_tokens_edited"] == encoder.count("mail <EMAIL> or <NUMBER> now") and rows[2]["n_edits"] == 0
    assert counting.count_tokens(none).isEmpty()


def test_quality(spark, docs, none):
    r = random.Random(7)
    good = [(i, ". ".join(" ".join(r.choice(WORDS) for _ in range(9)).capitalize() for _ in range(r.randint(2, 9))) + ".", 1) for i in range(400)]
    bad = [(400 + i, r.choice(["BUY!! NOW!! ", "a | b | ", "w### x%%% "]) * r.randint(3, 40), 0) for i in range(150)]
    rows = good + bad
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(3, None, 0), (None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.ranked(spark, df, labels)
    truth = {i: y for i, _, y in rows}
    held = [x for x in got.collect() if zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2]
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) / len(held) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in held)
    same = {x["doc_id"]: x["score"] for x in got.collect()}
    assert same == {x["doc_id"]: x["score"] for x in quality.ranked(spark, df.repartition(5), labels).collect()}
    odd = quality.score_documents(spark, docs, quality.fit(np.zeros((0, quality.WIDTH)), np.zeros(0)))
    assert odd.count() == len(corpus()) and odd.filter("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert quality.ranked(spark, none, labels).isEmpty()
    assert quality.keep_good(spark, df, labels).columns == df.columns


def plain_tree(rows):
    """base and n_known by brute force, from all training tokens."""
    toks = [(d, t.encode().translate(suffix.FOLD).split() + [b""]) for d, t in ((d, t or "") for d, t in rows)]
    train = Counter(w for d, ws in toks if not suffix.is_held_out(d) for w in ws)
    n, v = sum(train.values()), len(train)
    out = []
    for d, ws in toks:
        out.append((d, suffix.is_held_out(d), len(ws), sum(train[w] > 0 for w in ws), n, round(sum(np.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)))
    return Counter(out)


@pytest.mark.parametrize("share", [1 << 23, 2000])
def test_suffix_tree(spark, docs, none, share):
    got = suffix.score_texts(spark, docs, share=share).collect()
    assert Counter((r["doc"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == plain_tree(corpus())
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # near copies are in the training part
    assert all(r["score"] <= 0 for r in got)
    assert suffix.score_texts(spark, none).isEmpty()


def test_suffix_tree_is_a_distribution(spark):
    """Over all words that may follow, the probabilities sum to about one."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    train = [(d, " ".join(r.choices(words, [2 ** -(i % 5) for i in range(12)], k=30))) for d in range(400) if not suffix.is_held_out(d)]
    probe = [d for d in range(1000, 3000) if suffix.is_held_out(d)][:14]
    starts = "w0 w1"
    ends = [*words, "unseen"]
    rows = train + [(d, f"{starts} {w}") for d, w in zip(probe, ends, strict=False)] + [(probe[13], starts)]
    got = {r["doc"]: r["score"] for r in suffix.score_texts(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # P(end | ...) differs with the word before it, so compare with the document that ends there: sum of P(w) P(end | w) + P(end)
    assert sum(10 ** got[d] for d in probe[:13]) < 10 ** (max(got.values()) + 6)
    assert all(s <= 0 for s in got.values())


@pytest.mark.parametrize("tile", [8])
def test_near_duplicates_of_middling_similarity(spark, tile, monkeypatch):
    """Many texts that share a base and are hardly like one another: links among them are found, and rows made don't grow with pairs."""
    r = random.Random(17)
    base = [f"w{i}" for i in range(120)]

    def text(changes):
        return " ".join("x%d" % r.randrange(10**6) if i in changes else w for i, w in enumerate(base))

    rows = [(i, text(set(r.sample(range(120), r.choice([2, 3, 4, 5, 6])))) ) for i in range(160)]
    rows += [(None, t) for _, t in rows[:40]] + [(200 + i, rows[i][1] + " end") for i in range(0, 40, 7)]
    made = []

    def seen(*a, **b):
        out = across(*a, **b)
        made.append(out.count())
        return out

    across = neardup._across
    monkeypatch.setattr(neardup, "_across", seen)
    monkeypatch.setattr(neardup._grouped, "__defaults__", (tile,))
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=4).collect()
    assert Counter((x["doc"], x["n"], x["component"]) for x in got) == brute_components(rows, 4, 80)
    assert made and made[0] < 200


def test_tiles_against_brute_force():
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 2**63, 200, np.uint64))
    sets = [np.unique(np.concatenate([r.choice(base, 180, False), r.integers(0, 2**63, r.integers(0, 30), np.uint64)])) for _ in range(90)]
    tile = lambda rows: {"comp": list(rows), "n": [len(sets[i]) for i in rows], "sig": [neardup.signature(sets[i]) for i in rows], "items": [sets[i].astype("<u8").tobytes() for i in rows]}
    for one, two in ((range(90), range(90)), (range(40), range(40, 90))):
        got = neardup.compare_tiles(tile(one), tile(two), 80, one == two)
        want = [(a, b) for a in one for b in two if a < b and neardup.similar(sets[a], sets[b], 80)]
        assert want and set(got) <= set(want)

        def groups(links):
            root = {i: i for i in range(90)}
            for a, b in links:
                i, j = root[a], root[b]
                root = {k: min(i, j) if v in (i, j) else v for k, v in root.items()}
            return root

        assert groups(got) == groups(want) and len(got) < 90
    counts = neardup._shared_counts(sets[:5], sets[5:9])
    assert (counts == [[len(np.intersect1d(a, b)) for b in sets[5:9]] for a in sets[:5]]).all()


def plain_scores(rows, limit):
    """Scores by a suffix tree of dictionaries. Contexts of ``limit`` occurrences or more take their part in the test as they do when split."""
    d, start, nothing = suffix.DISCOUNT, "START", "NOTHING"
    name = {start: suffix.START, nothing: suffix.NOTHING}
    number = lambda w: name[w] if w in name else np.uint64(suffix.xxhash.xxh3_64_intdigest(w))
    texts = [(doc, (t or "").encode().translate(suffix.FOLD).split() + [b""]) for doc, t in rows]
    train = [ws for doc, ws in texts if not suffix.is_held_out(doc)]
    count = Counter(w for ws in train for w in ws)
    tokens = sum(count.values())
    base = lambda w: (count[w] + 0.5) / (tokens + 0.5 * (len(count) + 1))
    walk = lambda ws: zip([nothing, start, *ws], [start, *ws], ws, strict=False)
    one, two = defaultdict(Counter), defaultdict(Counter)
    for ws in train:
        for u, h, w in walk(ws):
            one[h][w] += 1
            two[u, h][w] += 1
    most = max(limit, tokens >> 12)
    total = lambda c: sum(c.values())
    slices = {h: 1 << (total(c) // most).bit_length() for h, c in one.items() if total(c) >= most}

    def gain(c, parent):
        size, once = total(c), sum(n == 1 for n in c.values())
        if size < 2:
            return 0
        again = sum(n * np.log((n - 1 - d) / parent(w)) for w, n in c.items() if n > 1)
        return again - (size - once) * np.log(size - 1) + (once * np.log(d * (len(c) - 1) / (size - 1)) if once else 0)

    def parent_in(c):
        kept = gain(c, base) > suffix.DIVERGENCE
        loo = lambda w: (max(c[w] - 1 - d, 0) + d * (len(c) - (c[w] == 1)) * base(w)) / max(total(c) - 1, 1)
        return lambda w: loo(w) if kept and loo(w) > 0 else base(w)

    def parent_of(u, h):
        c = one[h]
        if h not in slices:
            return parent_in(c)
        if total(two[u, h]) >= most:
            return lambda w: (c[w] - 1 - d) / (total(c) - 1) if c[w] > 1 else base(w)
        place = lambda x: int(suffix._slice(np.array([number(x)]), np.array([slices[h]]))[0])
        return parent_in(sum((x for (v, g), x in two.items() if g == h and total(x) < most and place(v) == place(u)), Counter()))

    kept1 = {h for h, c in one.items() if gain(c, base) > suffix.DIVERGENCE}
    kept2 = {k for k, c in two.items() if gain(c, parent_of(*k)) > suffix.DIVERGENCE}
    out = []
    for doc, ws in texts:
        score = 0
        for u, h, w in walk(ws):
            p = base(w)
            for kept, c, key in ((kept1, one, h), (kept2, two, (u, h))):
                if key in kept:
                    p = max(c[key][w] - d, 0) / total(c[key]) + d * len(c[key]) / total(c[key]) * p
            score += np.log10(p)
        out.append((-1 if doc is None else doc, len(ws), score))
    return sorted(out), len(kept1), len(kept2), len(slices)


@pytest.mark.parametrize(("limit", "share"), [(1 << 22, 1 << 23), (40, 3000)])
def test_suffix_tree_against_a_plain_one(spark, limit, share):
    r = random.Random(23)
    start = {"the": ["cat", "dog", "end", "river"], "a": ["cat", "stone"]}
    rows = [(None, "the cat"), (1, None), (2, ""), (3, "THE Cat sat"), (3, "THE Cat sat")]
    for i in range(10, 170):
        words = ["the"]
        while len(words) < r.randint(2, 40):
            words.append(r.choice(start.get(words[-1], ["the", "a", "of the", "in a", f"w{r.randrange(60)}", "the"])))
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    want, one, two, hot = plain_scores(rows, limit)
    assert one > 3 and two > 3 and (hot > 2) == (limit == 40)
    got = sorted((-1 if x["doc"] is None else x["doc"], x["n_tokens"], x["score"]) for x in suffix.score_texts(spark, df, limit=limit, share=share).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert max(abs(x[2] - y[2]) / x[1] for x, y in zip(got, want, strict=True)) < 1e-4


def test_packing_by_search(spark):
    """A table on which best-fit isn't the best: the search is entered and finds the fewest sequences."""
    rows = [(i, n) for i, n in enumerate([6, 6, 5, 5, 5, 4, 4, 3, 2, 2] * 3)]
    hist = Counter(n for _, n in rows)
    assert sum(t for _, t in packing.best_fit(hist, 14)) > packing.lower_bound(hist, 14)
    df = spark.createDataFrame([(i, n, 1, 2) for i, n in rows], "id long, length long, offset int, _rank int")
    got = packing.pack(spark, df, "length", ["id"], 14).collect()
    by = defaultdict(list)
    for x in got:
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    assert len(by) == packing.lower_bound(hist, 14) and all(x["fewest"] and x["_rank"] == 2 for x in got)
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 14


def test_stored_trees_take_edits(spark):
    """Trees from a table, edits from another: counts are those of the edited texts, and little is encoded again."""
    encoder, r = tokens.Encoder(tokens.default_tokenizer()), random.Random(12)
    texts = {i: " ".join(r.choice(WORDS) for _ in range(r.choice([0, 3, 40, 3000]))) for i in range(40)}
    edits, want = [], {}
    for i, t in texts.items():
        cuts = sorted(r.sample(range(len(t) + 1), 4)) if len(t) > 4 else []
        mine = [(a, b, r.choice(["", "x y", " NEW "])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)] if i % 3 else []
        for a, b, new in reversed(mine):
            t = t[:a] + new + t[b:]
        edits.append((i, [(a, min(b, a + 9), new) for a, b, new in mine]))
        want[i] = t
    whole = {}
    for i, mine in edits:
        t = texts[i]
        for a, b, new in reversed(mine):
            t = t[:a] + new + t[b:]
        whole[i] = t
    trees = counting.token_trees(spark.createDataFrame([*texts.items(), (None, None)], "doc_id long, text string"))
    both = trees.join(spark.createDataFrame(edits, "doc_id long, edits array<struct<start:long,stop:long,new:string>>"), "doc_id", "left")
    got = {x["doc_id"]: x for x in counting.edit_trees(both, "edits").collect()}
    assert {i: "".join(got[i]["leaves"]) for i in texts} == whole and got[None]["leaves"] is None and got[None]["n_tokens"] == 0
    assert all(got[i]["n_tokens"] == encoder.count(texts[i]) and got[i]["n_tokens_edited"] == encoder.count(whole[i]) == sum(got[i]["leaf_tokens"]) for i in texts)
    assert all(x["chars_reencoded"] < 4000 for x in got.values())


@pytest.mark.parametrize("names", [("score", "n_lines", "n_words", "_key", "offset"), ("Predicted", "_drop", "hit_spans", "_doc", "sequence_id"), ("n_dropped", "hit_items", "_bucket", "_rank", "_id")])
def test_stages_with_clashing_names(spark, names):
    """Stages return the columns of documents whatever they are called."""
    import corpus_pipeline

    rows = [(d, t, "en", "s", 0, *range(len(names))) for d, t in corpus()[:30]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    items = spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string")
    for done in (lines.drop_recurring_lines(spark, docs), neardup.keep_one(spark, docs), decontaminate.drop_contaminated(spark, docs, items), quality.keep_good(spark, docs, spark.createDataFrame([], "doc_id long, quality int"))):
        assert done.columns == docs.columns
        assert done.filter(" OR ".join(f"`{n}` <> {i}" for i, n in enumerate(names))).isEmpty() and not done.isEmpty()
    assert not corpus_pipeline.best_fit_packing(spark, docs, "").isEmpty()
    assert counting.count_tokens(docs).count() == len(rows)


def test_near_duplicates_in_bands_of_two(spark):
    """A text of several partners that are unlike each other: bands that hold only it and one of them are all looked into."""
    rows = []
    for n, seed in enumerate([685, 952]):  # the whole text is the last node of its bands and shares most with two partners
        r = random.Random(seed)
        words = [f"w{r.randrange(10**9)}" for _ in range(15)]
        rows += [(4 * n + k, " ".join(w for j, w in enumerate(words) if not 3 * k <= j < 3 * k + 3)) for k in range(3)] + [(4 * n + 3, " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc"]: r["component"] for r in neardup.near_duplicates(spark, df, width=1).collect()}
    assert got == {i: i - i % 4 for i, _ in rows}


def test_quality_learns_from_every_label(spark):
    """Mean, weights and threshold are those of all labelled rows, however many there are and whichever way texts meet labels."""
    rows = [(i, f"w{i} " * (1 + i % 3) + ("!" if i % 2 else ""), int(i % 5 > 0)) for i in range(20_400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    x = np.array([quality.features(t.encode()) for _, t, _ in rows])
    want = quality.fit(x, np.array([y for _, _, y in rows]))
    for options in ({}, {"few": 30_000}):
        got = quality.fit_ranker(spark, df.select("doc_id", "text"), df.select("doc_id", "quality"), few=options.get("few", 0))
        assert np.allclose(got.mean, x.mean(0), atol=1e-11) and np.allclose(got.weights, want.weights, atol=1e-8)
        assert abs(got.threshold - np.quantile(got.worth(x), 0.2)) < 1e-9


def test_suffix_tree_does_not_depend_on_what_is_hot(spark):
    """Splitting contexts changes no score: contexts that end in a hot word are tested against that word's true distribution."""
    r = random.Random(29)
    after = {"the": ["cat", "dog", "end", "river"], "a": ["cat", "stone"]}
    rows = []
    for i in range(170):
        words = ["the"]
        while len(words) < r.randint(2, 40):
            words.append(r.choice(after.get(words[-1], ["the", "a", "of the", "in a", f"w{r.randrange(60)}", "the"])))
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    want = plain_scores(rows, 1 << 22)[0]
    assert max(abs(x[2] - y[2]) / x[1] for x, y in zip(want, plain_scores(rows, 40)[0], strict=True)) > 0.01  # the estimate would show
    for options in ({"limit": 40, "exact": True, "share": 3000}, {"limit": 150, "exact": True}, {}):
        got = sorted((x["doc"], x["n_tokens"], x["score"]) for x in suffix.score_texts(spark, df, **options).collect())
        assert max(abs(x[2] - y[2]) / x[1] for x, y in zip(got, want, strict=True)) < 1e-4


def test_pipeline_learns_from_every_label(spark, tmp_path, monkeypatch):
    """The stage's ranker has the mean, weights and threshold of all labelled rows that aren't held out, more than 20000 here."""
    import corpus_pipeline

    rows = [(i, f"w{i} " * (1 + i % 3) + ("!" if i % 2 else ""), int(i % 5 > 0)) for i in range(27_400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    df.select("doc_id", "quality").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    monkeypatch.setattr(quality, "score_documents", lambda s, d, ranker, *a, f=quality.score_documents, **b: seen.append(ranker) or f(s, d, ranker, *a, **b))
    kept = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, df.select("doc_id", "text"), str(tmp_path)).collect()}
    learned = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    x = np.array([quality.features(t.encode()) for t, _ in learned])
    want = quality.fit(x, np.array([y for _, y in learned]))
    assert len(learned) > 20_000 and np.allclose(seen[0].mean, x.mean(0), atol=1e-11)
    assert np.allclose(seen[0].weights, want.weights, atol=1e-8) and abs(seen[0].threshold - want.threshold) < 1e-8
    sure = [(i, quality.features(t.encode())) for i, t, _ in rows]
    worth = want.worth(np.array([f for _, f in sure])) - want.threshold
    assert {i for (i, _), w in zip(sure, worth, strict=True) if w > 1e-6} <= kept <= {i for (i, _), w in zip(sure, worth, strict=True) if w > -1e-6}
