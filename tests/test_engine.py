import datetime
import hashlib
import json
import random
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rivulet.operators import graph as G
from rivulet.operators import ledger as L
from rivulet.operators import load as D
from rivulet.operators import saved as V
from rivulet.operators import search as S
from rivulet.operators.components import components
from rivulet.operators.resolve import resolve_batch
from rivulet.plans import catalog_upkeep
from rivulet.plans.params import CrawlParams, LedgerParams, SearchParams
from rivulet.plans.store import Store
from rivulet.schemas import SAVED
from rivulet.sources import county, state
from rivulet.streaming.ingest import TRANSACTION, apply_batch, level_events, stream_ingest

DAY = datetime.date(2024, 1, 1)


def txns(spark, rows):
    full = [(f"t{i}", f, t, Decimal(a), DAY + datetime.timedelta(days=i % 90), s) for i, (f, t, a, s) in enumerate(rows)]
    return spark.createDataFrame(full, TRANSACTION)


def people(spark, ids, traversable=()):
    return spark.createDataFrame([(i, f"Name {i}", f"NAME {i}", "organization", None, i in traversable, "src") for i in ids], "id string, name string, normalized_name string, kind string, committee_type string, is_traversable boolean, source_id string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def random_txns(seed, n=60, ids=9):
    r = random.Random(seed)
    return [(f"e{r.randrange(ids)}", f"e{r.randrange(ids)}", r.choice([10, 20, 20, 30, 55]), r.choice(["a", "b"])) for _ in range(n)]


def test_five_cheques_are_one_edge(spark):
    entities, edges = D.rebuild_all(people(spark, ["A", "B"]), txns(spark, [("A", "B", 250_000, "s")] * 5))
    assert rows(edges, "from_id", "to_id", "total_amount", "txn_count", "is_direct_link") == [("A", "B", Decimal("1250000.00"), 5, False)]
    assert rows(entities, "id", "in_degree", "out_degree", "is_traversable") == [("A", 0, 1, False), ("B", 1, 0, True)]


def test_invariants_and_purge(spark):
    t = txns(spark, random_txns(1))
    entities, edges = D.rebuild_all(people(spark, [f"e{i}" for i in range(9)]), t)
    total = t.agg(F.sum("amount")).first()[0]
    assert edges.agg(F.sum("total_amount")).first()[0] == total
    assert entities.agg(F.sum("total_received"), F.sum("total_given")).first()[:] == (total, total)
    left, left_edges, kept = D.purge_source(entities, edges, t, None, "a")
    assert kept.filter("source_id = 'a'").isEmpty()
    assert rows(left_edges, "edge_id", "total_amount") == rows(D.rebuild_all(people(spark, [f"e{i}" for i in range(9)]), kept)[1], "edge_id", "total_amount")


def test_incremental_equals_rebuild(spark, tmp_path):
    data = random_txns(2, 80)
    all_rows = txns(spark, data)
    store = Store(spark, f"file://{tmp_path}/s")
    parts = [all_rows.filter(F.abs(F.hash("id")) % 3 == i) for i in range(3)]
    for p in [*parts, parts[1]]:
        counts = apply_batch(store, p)
    assert counts["inserted"] == 0 and counts["skipped"] == counts["fetched"]
    ids = spark.createDataFrame([(f"e{i}", False) for i in range(9)], "id string, is_traversable boolean")
    entities, edges = D.rebuild_all(ids, all_rows)
    assert rows(store.read("edges"), "edge_id", "total_amount", "txn_count", "is_direct_link") == rows(edges, "edge_id", "total_amount", "txn_count", "is_direct_link")
    assert rows(store.read("entities"), "id", "total_received", "in_degree", "is_traversable") == rows(entities, "id", "total_received", "in_degree", "is_traversable")


def test_stream_equals_batch(spark, tmp_path):
    all_rows = txns(spark, random_txns(3, 40))
    for i in range(3):
        all_rows.filter(F.abs(F.hash("id")) % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/s")
    counts = stream_ingest(spark, f"{tmp_path}/in", store, f"{tmp_path}/c")
    assert sum(c["inserted"] for c in counts) == 40 and len(counts) >= 3
    assert stream_ingest(spark, f"{tmp_path}/in", store, f"{tmp_path}/c") == []
    assert store.read("transactions").count() == 40
    store.vacuum("edges", 1)
    assert store.read("edges").count() > 0


def crawl_model(entities, edges, p):
    """Plain breadth-first search; entities: id to traversable, edges: (id, from, to, amount, direct)."""
    if p.seed not in entities:
        return []
    seen, frontier, seen_edges, out = {p.seed}, [p.seed], set(), [({p.seed}, set(), False)]
    for _ in range(p.depth):
        if not frontier:
            break
        fresh, order = set(), []
        for f in frontier:
            for branch, mine, other in ((0, 2, 1), (1, 1, 2)):
                if p.direction != "both" and (p.direction == "upstream") != (branch == 0):
                    continue
                hits = sorted((e for e in edges if e[mine] == f and (p.link_mode == "donor" or e[4])), key=lambda e: (-e[3], e[0]))[: p.max_per_node]
                fresh |= {e[0] for e in hits}
                order += [e[other] for e in hits]
        new = [x for x in dict.fromkeys(order) if x not in seen]
        take = p.max_nodes - len(seen)
        out.append((set(new[:take]), fresh - seen_edges, len(new) > take))
        seen_edges |= fresh
        seen |= set(new[:take])
        frontier = [x for x in new[:take] if entities[x]]
    return out


@pytest.mark.parametrize(("direction", "mode", "k", "cap"), [("both", "donor", 3, 600), ("upstream", "donor", 2, 10), ("downstream", "direct", 25, 600)])
def test_crawl_against_model(spark, direction, mode, k, cap):
    t = txns(spark, random_txns(4, 90, 16))
    entities, edges = (x.cache() for x in D.rebuild_all(people(spark, [f"e{i}" for i in range(16)]), t))
    model_nodes = {r["id"]: r["is_traversable"] for r in entities.collect()}
    model_edges = [(r["edge_id"], r["from_id"], r["to_id"], r["total_amount"], r["is_direct_link"]) for r in edges.collect()]
    p = CrawlParams("e3", 3, direction, mode, max_per_node=k, max_nodes=cap)
    got = [({r["id"] for r in x.nodes.collect()}, {r["edge_id"] for r in x.edges.collect()}, x.truncated) for x in G.crawl(spark, entities, edges, p)]
    assert got == crawl_model(model_nodes, model_edges, p)
    assert list(G.crawl(spark, entities, edges, CrawlParams("nobody"))) == []


def test_crawl_edge_cases(spark):
    data = [("S", "A", 100), ("A", "B", 90), ("B", "S", 80), ("A", "A", 50), *((f"D{i}", "A", i) for i in range(1, 31)), ("B", "V", 70), ("B", "W", 70), ("X", "Y", 5)]
    t = txns(spark, [(*x, "s") for x in data])
    ids = sorted({x for d in data for x in d[:2]})
    entities, edges = (x.cache() for x in D.rebuild_all(people(spark, ids), t))
    up = G.hop(edges, spark.createDataFrame([("A",)], "id string"), "upstream", 25, G.edge_filter("donor"))
    assert {r["neighbour"] for r in up.collect()} == {"S", "A", *(f"D{i}" for i in range(8, 31))}
    direct = G.hop(edges, spark.createDataFrame([("A",)], "id string"), "upstream", 25, G.edge_filter("direct"))
    assert {r["neighbour"] for r in direct.collect()} == {"S"}
    levels = list(G.crawl(spark, entities, edges, CrawlParams("A", 1, "upstream", "donor", max_nodes=10)))
    assert levels[1].truncated and levels[1].nodes.count() == 9 and levels[1].edges.count() == 25
    nodes, links, cut = G.crawl_all(spark, entities, edges, CrawlParams("A", 1, "upstream", "donor", max_nodes=10))
    assert cut and G.prune_dangling(nodes, links).count() == 10  # nine neighbours and the loop
    last = list(G.crawl(spark, entities, edges, CrawlParams("V", 3, "downstream", "donor")))
    assert [(x.level, x.nodes.count()) for x in last] == [(0, 1), (1, 0)]
    assert edges.filter(G.edge_filter("donor", date_from="2030-01-01")).isEmpty()
    events = [json.loads(x) for x in level_events(spark, entities, edges, CrawlParams("A", 1))]
    assert [e["event"] for e in events] == ["start", "level", "level", "done"]
    ids, at = G.ego_network(edges, "V")
    assert rows(ids, "id") == [("B",), ("V",)] and at.count() == 1


def test_ledger(spark, tmp_path):
    t = txns(spark, [("A", "B", 10, "s"), ("B", "A", 7, "s"), ("A", "A", 5, "s"), ("C", "A", 10, "s")])
    entities, edges = D.rebuild_all(people(spark, ["A", "B", "C"]), t)
    both = L.sources(entities, edges, "A", LedgerParams(direction="all"))
    assert rows(both, "entity_id", "flow", "is_self") == [("A", "in", True), ("A", "out", True), ("B", "in", False), ("B", "out", False), ("C", "in", False)]
    line = t.selectExpr("id", "from_id", "to_id", "from_id AS raw_from_name", "to_id AS raw_to_name", "amount", "day AS txn_date", "'c' AS txn_type_code", "'d' AS description", "'x' AS city", "'FL' AS state_code", "'o' AS occupation", "source_id")
    items = L.transactions(line, spark.createDataFrame([("s", "key")], "id string, key string"), "A", LedgerParams(view="transactions", direction="all"))
    assert items.count() == 4 and items.filter("flow = 'in'").count() == 3  # a loop is money in, once
    pages = [[r["entity_id"] + r["flow"] for r in L.page(both, LedgerParams(direction="all", limit=2, offset=o)).collect()] for o in (0, 2, 4)]
    assert sorted(sum(pages, [])) == sorted(r["entity_id"] + r["flow"] for r in both.collect())
    assert L.sources(entities, edges, "A", LedgerParams(q="?!")).count() == 3  # nothing to look for
    assert L.sources(entities, edges, "A", LedgerParams(q="name c")).count() >= 1
    assert L.totals(both).first()[:] == (5, "37.00")
    L.export_csv(both.select("name", "amount").withColumn("q", F.lit('a"b')), f"{tmp_path}/csv")
    content = next(tmp_path.glob("csv/part*")).read_text().splitlines()
    assert content[0] == '"name","amount","q"' and content[1].endswith(',"a""b"')


def test_params():
    for bad in ({"depth": 7}, {"max_nodes": 9}, {"max_per_node": 0}, {"direction": "x"}, {"date_from": "2024-13-01"}, {"min_amount": -1}):
        with pytest.raises(ValueError):
            CrawlParams("s", **bad)
    with pytest.raises(ValueError):
        SearchParams("x")
    with pytest.raises(ValueError):
        LedgerParams(limit=501)


def test_saved_searches(spark):
    empty = spark.createDataFrame([], SAVED)
    one = V.create(empty, "mine", "A", {"depth": 2, "direction": "both"}, positions={"A": (1.0, 2.0)}).cache()
    row = V.listing(one, people(spark, ["A"])).first()
    assert (row["name"], row["seed_name"], row["params"]["depth"], row["node_positions"]["A"]["y"]) == ("mine", "Name A", 2, 2.0)
    assert V.update(one, row["id"], name="new").first()["name"] == "new"
    assert V.delete(one, row["id"]).isEmpty()
    assert V.without_entities(one, people(spark, ["A"])).isEmpty()
    with pytest.raises(KeyError):
        V.delete(one, "none")


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 40), (40, 35), (50, 50)]
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 40: 30, 35: 30}


def test_similarity_shortlist_loses_nothing(spark):
    r = random.Random(5)
    names = list({" ".join(r.choice(["ALPHA", "BETA", "GAMMA", "ALPHABET", "DELTAS", "DELTA"]) for _ in range(r.randint(1, 3))) for _ in range(60)})
    df = spark.createDataFrame([(n, n) for n in names], "id string, n string")

    def grams(s):
        return {p[i : i + 3] for w in s.split() for p in [f"  {w} "] for i in range(len(p) - 2)}

    want = sorted((a, b) for a in names for b in names if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.3)
    assert rows(S.similarity_shortlist(df, df, None), "id", "other") == want


def test_similarity_shortlist_in_tiles(spark, monkeypatch):
    """Names of few trigrams, of which none is rare: no pair is lost, and the rows of the join aren't made."""
    monkeypatch.setattr(S, "TILE_LEFT", 7)
    monkeypatch.setattr(S, "TILE_RIGHT", 11)
    r = random.Random(6)
    names = sorted({" ".join("".join(r.choice("ABC") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 3))) for _ in range(50)})
    df = spark.createDataFrame([(n, n) for n in [*names, ""]], "id string, n string")
    want = rows(S.similarity_shortlist(df, df, None), "id", "other", "similarity")
    got = S.similarity_shortlist(df, df.filter("id > 'B'"), None, dense=1 / 64)
    assert rows(got, "id", "other", "similarity") == [x for x in want if x[1] > "B"] and len(want) > len(names)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
    assert S.similarity_shortlist(df, df.limit(0), None, dense=0.0).isEmpty()


def written_mb(spark, f):
    """What ``f`` gives, and the MB that its shuffles wrote."""
    sc = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    return f(), (total() - before) / 1e6


def test_similarity_shortlist_counts_without_shuffling_trigrams(spark):
    """Whether to compare in tiles is found out at the cost of shuffling names: no row a trigram goes to disk."""
    names = sorted({hashlib.md5(str(i).encode()).hexdigest().upper() for i in range(3000)})
    df = spark.createDataFrame([(n, n) for n in names], "id string, n string").repartition(2).cache()
    df.count()
    got, mb = written_mb(spark, lambda: S.similarity_shortlist(df, df, None, dense=S.DENSE))
    assert mb < 1.5 and "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
    df.unpersist()


MENTIONS = "place long, raw string, recipient boolean, hint string, zip string, city string, occupation string"


def test_resolve(spark):
    entities = spark.createDataFrame([("e1", "Florida Chamber of Commerce PAC", "FLORIDA CHAMBER OF COMMERCE PAC", "32301", "Tampa"), ("e2", "Associated Builders of the Northern Coast Region", "ASSOCIATED BUILDERS OF THE NORTHERN COAST REGION", None, None)], "id string, name string, normalized_name string, zip string, city string")
    aliases = spark.createDataFrame([("e1", "THE CHAMBER", 0.9), ("e2", "THE CHAMBER", 0.7)], "entity_id string, normalized_alias string, confidence double")
    raw = ["Florida Chamber of Commerce PAC", "The Chamber", "Associated Builders of the Northern Coast", "Secure Florida's Future Inc.", "SECURE FLORIDA'S FUTURE", "Secure Florida's Future Inc.", "DOE, JANE", "!!", "FLORIDA CHAMBER PAC"]
    mentions = spark.createDataFrame([(i, x, False, None, None, None, None) for i, x in enumerate(raw)], MENTIONS)
    for k in (None, 10):
        resolved, created, learned = resolve_batch(mentions, entities, aliases, k)
        got = {r["place"]: (r["method"], r["entity_id"], round(r["confidence"], 3)) for r in resolved.collect()}
        own = got[3][1]
        assert got[0] == ("exact", "e1", 1.0) and got[1] == ("alias", "e1", 0.9) and got[2] == ("prefix", "e2", 0.95)
        assert got[3][0] == "created" and got[4] == ("similarity", own, 0.912) and got[5] == ("cache", own, 1.0)
        assert got[6][0] == "created" and got[8][0] == "created" and 7 not in got
        assert {r["name"]: r["kind"] for r in created.collect()}["JANE DOE"] == "individual"
        assert {(r["normalized_alias"], r["entity_id"]) for r in learned.collect()} == {("ASSOCIATED BUILDERS OF THE NORTHERN COAST", "e2"), ("SECURE FLORIDAS FUTURE", own), ("FLORIDA CHAMBER PAC", "e1")}


EXPORT = '''"Rpt Code","Line Number","Item Date","Cont/Exp","Name","Address 1","Address 2","City","State","Zip","Cont. Type","Occupation","Item Type","Description","Amount"
Q1,1,2024-01-15,C,"DOE, JANE","1 Main St","Apt 2",Tampa,FL,33601,I,RETIRED,CH,,"$1,000.00"
Q1,2,1/20/2024,C,ACME SUGAR CORP,,,Clewiston,FL,33440,B,AGRICULTURE,CH,,250000
Q1,3,0000-00-00,E,"Print &#34;Fast&#34; Shop",,,Tampa,FL,33602,,,CH,Mailers,-12.345
Q1,4,2026-02-30,X,Friends of Jane Doe,,,,,,C,,CH,,5
Q1,5,2024-02-01,C,,,,,,,I,,CH,,10
Q1,6,2024-02-01,C,BAD AMOUNT LLC,,,,,,B,,CH,,12a
'''


def test_county_export(spark, tmp_path):
    (tmp_path / "17.csv").write_text(EXPORT)
    (tmp_path / "18.csv").write_text("no,such,header\n1,2,3\n")
    filers = spark.createDataFrame([("17.csv", "Jane Doe", "Mayor", "REP", False), ("18.csv", "x", None, None, True)], "file string, filer_raw string, filer_office string, filer_party string, filer_is_committee boolean")
    good, bad = county.read_exports(spark, str(tmp_path), filers, "clay")
    got = {r["counterparty_raw"]: r for r in good.collect()}
    assert set(got) == {"DOE, JANE", "ACME SUGAR CORP", 'Print "Fast" Shop', "Friends of Jane Doe"}
    assert sorted(r["reason"] for r in bad.collect()) == ["amount", "name"]
    assert [str(got[n]["date"]) for n in ("DOE, JANE", "ACME SUGAR CORP", 'Print "Fast" Shop', "Friends of Jane Doe")] == ["2024-01-15", "2024-01-20", "None", "None"]
    assert [got[n]["counterparty_kind"] for n in ("DOE, JANE", "ACME SUGAR CORP", 'Print "Fast" Shop', "Friends of Jane Doe")] == ["individual", "business", "unknown", "committee"]
    assert got['Print "Fast" Shop']["direction"] == "expenditure" and got["Friends of Jane Doe"]["direction"] == "contribution"
    assert got["DOE, JANE"]["address"] == "1 Main St Apt 2" and str(got['Print "Fast" Shop']["amount"]) == "-12.35"
    assert good.select("row_hash").distinct().count() == 4


def test_county_pages(spark, tmp_path):
    html = """<select name="el"><option value='12'>2024 General</option><option value='9'>Special</option></select>Office: Mayor |
<a href="candidate_pr.php?c=x&ca=17&el=1&committee=N&z"><div role="gridcell">Jane Doe (REP)</div><div>(Active-Qualified)</div></a>
Office: Clerk<a href="candidate_pr.php?ca=18&committee=Y"><div role="gridcell">Good Group</div></a><a href="candidate_pr.php?ca=17&committee=N">Twice</a>"""
    (tmp_path / "a.html").write_text(html)
    (tmp_path / "b.html").write_text("Internal Server Error")
    pages = county.read_pages(spark, str(tmp_path))
    assert rows(county.elections(pages), "id", "label", "year") == [("12", "2024 General", 2024), ("9", "Special", None)]
    assert sorted(county.entity_index(pages).drop("path").collect()) == [("17", "Jane Doe", False, "Mayor", "REP", "Active-Qualified"), ("18", "Good Group", True, None, None, None)]
    assert county.find_county(spark, "St-Johns ").first()["code"] == "FL-STJOHNS"


def test_state_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("Recipient\tContributor\tAmount\tDate\tType\nGood Fund (PAC)\tDOE, JANE\t100.00\t01/02/2024\tCHE\nGood Fund (PAC)\tACME\t250\t03/02/2024\tCHE\nOther\tACME\t5\t\tCHE\n")
    c = state.read_contributions(spark, str(tmp_path / "c.tsv"))
    assert rows(state.contributions(c, recipient="good"), "counterparty_raw", "amount") == [("ACME", Decimal("250.00")), ("DOE, JANE", Decimal("100.00"))]
    assert state.contributions(c, contributor="ACME", match="starts_with", min_amount=100).count() == 1
    assert state.contributions(c, recipient="Gud Fund", match="sounds_like").count() == 2
    assert rows(state.contribution_totals(c), "counterparty_raw", "n") == [("ACME", 2), ("DOE, JANE", 1)]
    (tmp_path / "r.tsv").write_text("name\ttype\tstatus\nX PAC\tPAC\tclosed\nX PAC\tPAC\tactive\nY\tECO\tclosed\n")
    r = state.read_registry(spark, str(tmp_path / "r.tsv"))
    assert rows(r, "name", "status") == [("X PAC", "active"), ("Y", "closed")]
    assert state.committees_by_prefix(r, "x").count() == 1


def test_dml(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert rows(D.upsert(t, new, ["k"]), "k", "v") == [("a", 1), ("b", 3), ("c", 4)]
    al = spark.createDataFrame([("e", "x", "X", 0.5)], "entity_id string, alias string, normalized_alias string, confidence double")
    more = spark.createDataFrame([("e", "x2", "X", 0.9), ("e", "y", "Y", 0.7)], al.schema)
    assert rows(D.add_aliases(al, more), "normalized_alias", "confidence") == [("X", 0.5), ("Y", 0.7)]
    ents = spark.createDataFrame([("i", "organization", "old", "N", None, "unknown", False)], "id string, kind string, name string, normalized_name string, committee_type string, status string, is_traversable boolean")
    reg = spark.createDataFrame([("N", "New", "PAC", "active")], "normalized_name string, name string, type string, status string")
    assert rows(D.apply_registry(ents, reg), "kind", "name", "normalized_name", "is_traversable") == [("committee", "New", "N", True)]
    assert D.run_record(spark, "s", 3, 2, 1, "boom").first()["status"] == "failed"


@pytest.mark.parametrize("name", ["resolver_stats", "created_entities"])
def test_resolution_of_names_of_few_trigrams(spark, tmp_path, monkeypatch, name):
    """Digests share no rare trigram: the names are compared in tiles, not by a join that outgrows the disk, and SQL agrees."""
    duckdb = pytest.importorskip("duckdb")
    pq.write_table(pa.table({"s_suppkey": pa.array(range(60), pa.int64())}), tmp_path / "supplier.parquet")
    tiled = []
    monkeypatch.setattr(S, "_alike_in_tiles", lambda *a, f=S._alike_in_tiles: tiled.append(1) or f(*a))
    got = catalog_upkeep.C.QUERIES[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog_upkeep.C.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and tiled


def test_resolution_shuffles_names_not_trigrams(spark, tmp_path):
    """2000 mentions: 1.9 MB of shuffles in all; 3.0 with a row a trigram in the count of the candidates."""
    pq.write_table(pa.table({"s_suppkey": pa.array(range(2000), pa.int64())}), tmp_path / "supplier.parquet")
    got, mb = written_mb(spark, lambda: catalog_upkeep.C.QUERIES["created_entities"](spark, str(tmp_path)).collect())
    assert len(got) == 1000 and mb < 2.5
