"""Chat formatting, top-k search, the registry and the pipeline."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rivulet.llm import chat, registry, topk


def test_chat_reads_back(spark):
    rows = [
        (1, 1, "user", "a < b [x] \\0 </s>", "z"), (1, 0, "system", None, "z"), (1, 2, "assistant", "<s>[ROLE]user[/ROLE] \\1", "z"), (1, 2, "assistant", "<s>[ROLE]user[/ROLE] \\1", "z"), (2, None, None, "", "z"),
        (None, 5, "assistant", "é🙂", "z"), (None, 1, "odd [role]", "x\ny", "z"), (3, 0, "user", "", "z"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in done.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}).collect()}
    by = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == by
    assert {c: r["loss"] for c, r in got.items()} == {c: "".join(x for role, x in v if role == "assistant") for c, v in by.items()}
    assert {c: r["n_turns"] for c, r in got.items()} == {c: len(v) for c, v in by.items()}
    assert chat.format_conversations(df.limit(0)).isEmpty()


def test_chat_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3://a.png", 1.2), (None, "<|image:0.1|>", None, None), ("audio", None, "b.wav", 3.0), ("odd", None, None, float("nan"))]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None), ("document", None, "c.pdf", 2.0)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, content {chat.PARTS}")
    r = chat.format_conversations(df, content="content").withColumn("turns", chat.read_turns(F.col("formatted"))).first()
    assert [tuple(a) for a in r["attachments"]] == [(0, 1, "image", "s3://a.png", 85 + 340), (0, 3, "audio", "b.wav", 77), (0, 4, "odd", None, 1), (1, 1, "document", "c.pdf", 1204)]
    assert r["attachment_tokens"] == 85 + 340 + 77 + 1 + 1204
    assert r["turns"][0]["text"] == "see <|image:0.1|><|image:0.1|><|audio:0.3|><|odd:0.4|>" and r["turns"][2]["text"] == ""
    assert r["formatted"].count("<|image:0.1|>") == 1  # the one in the text is escaped


def test_op7_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_top(vectors, k, every):
    ok = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [float(x) for x in v]
        ok[i] = min(ok.get(i, w), w)
    whole = {i: [math.floor(64 * x) for x in v] for i, v in ok.items()}
    out = []
    for q in whole:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("cell", "block"), [(8192, 4096), (16, 8)])
def test_top_k(spark, cell, block):
    r = random.Random(1)
    vectors = [(i, [r.choice([-1.0, 0.5, 0.25, r.gauss(0, 1)]) for _ in range(8)]) for i in range(120)]
    vectors += [(200 + i, [1.0] * 8) for i in range(30)] + [(300, None), (320, [1.0, None]), (340, [float("nan")] * 8), (360, [float("inf")] * 8), (None, [1.0] * 8), (20, [9.0] * 8), (380, [1.0, 2.0]), (400, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, label int, score int")
    got = topk.top_k(spark, df, df.filter("vec_id % 20 = 0"), 20, cell=cell, block=block)
    assert sorted(tuple(x) for x in got.collect()) == brute_top(vectors, 20, 20)
    few = df.filter("vec_id < 5")
    assert topk.top_k(spark, few, few.filter("vec_id % 20 = 0"), 20).count() == 4
    assert topk.top_k(spark, df.limit(0), df.limit(0), 20).isEmpty()


def test_top_k_of_huge_components(spark):
    df = spark.createDataFrame([(0, [1e9, 3.0]), (1, [1e9, 1.0]), (2, [1e9, 2.0]), (3, [-1e9, 2.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(spark, df, df.filter("vec_id = 0"), 2).collect()
    exact = lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True))
    cap = 2**63 - 1
    assert [r["score"] for r in sorted(got, key=lambda r: r["rank"])] == [min(cap, exact([1e9, 3.0], [1e9, 2.0])), min(cap, exact([1e9, 3.0], [1e9, 1.0]))]


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_pipeline(spark, tmp_path):
    """Planted rows go, clean ones stay, and the result packs what is left."""
    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    clean = [(i, "\n".join(sentence(r.randint(8, 20)) for _ in range(r.randint(2, 6)))) for i in range(300)]
    passage = sentence(60)
    planted = [(300 + i, f"{passage}\n{sentence(30)}") for i in range(5)]
    items = [(1, sentence(20)), (2, sentence(9))]
    leaked = [(310, f"{sentence(5)} {items[0][1]}"), (311, items[1][1])]
    near = [(320 + i, " ".join(w if j != 7 * i + 3 else "zzz" for j, w in enumerate(clean[5][1].replace("\n", " ").split(" ")))) for i in range(3)]
    junk = [(400 + i, "SHOUT!! " * r.randint(20, 60)) for i in range(60)]
    rows = clean + planted + leaked + near + junk
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        at = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = {x["doc_id"]: x["text"] if "text" in x else None for x in (y.asDict() for y in at.collect())}
        if k < 4:
            assert at.columns == docs.columns
    ids = {k: set(v) for k, v in seen.items()}
    assert not any(i >= 400 for i in ids["quality classifier"]) and len(ids["quality classifier"] & set(range(300))) >= 297
    assert sum(passage in t for t in seen["line dedup"].values()) == 1
    assert {i: seen["line dedup"].get(i) for i in range(300) if i in ids["quality classifier"]} == {i: t for i, t in clean if i in ids["quality classifier"]}
    assert len(ids["MinHash near-dedup"] & {320, 321, 322}) <= 1
    assert ids["benchmark decontamination"] == ids["MinHash near-dedup"] - {310, 311}
    assert ids["best-fit packing"] == ids["benchmark decontamination"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(x["doc_id"] for x in whole.collect()) == Counter(x["doc_id"] for x in at.collect())


def test_top_k_collects_few_rows():
    """The uniform threshold keeps all that belongs to the best, and few others."""
    import numpy as np

    r = np.random.default_rng(4)
    x = np.floor(64 * r.normal(0, 0.1, (4000, 64)))
    ids, q = np.arange(4000), np.arange(0, 4000, 80)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    first = topk.local_lists(q, x[q], ids, x, 20)
    cutoff = np.array([np.sort(s)[-20] for s in first[2]])
    assert (cutoff <= np.sort(scores, 1)[:, -20]).all()
    query, found, score, kept = topk.collected(q, x[q], ids, x, cutoff, 20)
    assert kept < 0.3 * len(q) * len(ids)
    for i in range(len(q)):
        assert sorted(score[i], reverse=True) == sorted(scores[i], reverse=True)[:20] and set(query[i]) == {q[i]}


def test_top_k_orders_scores_beyond_64_bits(spark):
    """In different cells, of both signs."""
    rows = [(0, [1e12, 1e12])] + [(i, [1e12 + 1e9 * (i * 7 % 11), 1e12]) for i in range(1, 12)] + [(20 + i, [-1e12 - 1e9 * (i * 7 % 11), -1e12]) for i in range(1, 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = sorted((i for i in whole if i), key=lambda i: (-sum(a * b for a, b in zip(whole[0], whole[i], strict=True)), i))
    got = topk.top_k(spark, df, df.filter("vec_id = 0"), 22, cell=4, block=1).orderBy("rank").collect()
    assert [x["vec_id"] for x in got] == want
