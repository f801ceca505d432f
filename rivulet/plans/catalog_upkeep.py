"""Queries on what surrounds the graph: aliases, registry, saved searches, exports, streams, parameters, resolution, expansion."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.register import register
from ..operators import graph as G
from ..operators import ledger as L
from ..operators import load as D
from ..operators import saved as V
from ..operators import search as S
from ..operators.expand import expand
from ..operators.resolve import resolve_batch
from ..schemas import SAVED
from ..sources import adapter as A
from ..streaming import ingest as I
from . import catalog as C
from . import fixtures as T
from .catalog import query, text
from .params import CrawlParams, LedgerParams, SearchParams
from .store import Store, work_folder

# --- loading and upkeep -----------------------------------------------------------------------------------------------

_ALIAS = "concat('S', CAST(l_suppkey AS VARCHAR)) AS entity_id, concat('A', CAST(l_partkey % 20 AS VARCHAR)) AS normalized_alias, CAST(l_quantity AS INTEGER) AS confidence, concat('a', CAST(l_linenumber AS VARCHAR)) AS alias"


@query(f"""WITH i AS (SELECT {_ALIAS} FROM lineitem), old AS (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS entity_id, concat('A', CAST(s_suppkey % 20 AS VARCHAR)) AS normalized_alias, 100 AS confidence, 'old' AS alias FROM supplier),
 f AS (SELECT entity_id, normalized_alias, confidence, alias FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, normalized_alias ORDER BY confidence DESC, alias) AS n FROM i) WHERE n = 1)
 SELECT * FROM old UNION ALL SELECT * FROM f WHERE (entity_id, normalized_alias) NOT IN (SELECT entity_id, normalized_alias FROM old)""")
def aliases_added(spark, sf):
    string = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    incoming = T.read(spark, sf, "lineitem").select(string("S", F.col("l_suppkey")).alias("entity_id"), string("A", F.col("l_partkey") % 20).alias("normalized_alias"), F.col("l_quantity").cast("int").alias("confidence"), string("a", F.col("l_linenumber")).alias("alias"))
    old = T.read(spark, sf, "supplier").select(string("S", F.col("s_suppkey")).alias("entity_id"), string("A", F.col("s_suppkey") % 20).alias("normalized_alias"), F.lit(100).alias("confidence"), F.lit("old").alias("alias"))
    return D.add_aliases(old, incoming)


_KEPT = C.FLOW + ", kept AS (SELECT * FROM flow WHERE source_id <> 'q1')," + C.PARTY


@query(_KEPT + """ SELECT (SELECT count(*) FROM party WHERE left(id, 1) = 'C' AND id NOT IN (SELECT from_id FROM kept UNION SELECT to_id FROM kept)) AS entities_removed,
 (SELECT count(*) FROM edge e WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.from_id = e.from_id AND k.to_id = e.to_id)) AS edges_removed, (SELECT count(*) FROM flow WHERE source_id = 'q1') AS transactions_removed""")
def purge_counts(spark, sf):
    before = T.graph(spark, sf)
    return D.removed_counts(before, D.purge_source(*before, None, "q1", "qC"))


@query(C.ENT + " SELECT (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM edge WHERE is_direct_link) AS direct_links, count(*) FILTER (WHERE in_degree + out_degree > 0) AS entities_with_totals, count(*) FILTER (WHERE is_traversable) AS traversable FROM ent")
def rebuild_counts(spark, sf):
    return D.rebuild_counts(*D.rebuild_all(T.parties(spark, sf), T.flows(spark, sf)))


@query(C.PARTY.replace("\nparty AS", "WITH party AS") + """, reg AS (SELECT normalized_name, concat('The ', name) AS name, 'PAC' AS type, 'active' AS status FROM party WHERE id LIKE '%7')
 SELECT p.id, coalesce(r.name, p.name) AS name, CASE WHEN r.name IS NULL THEN p.kind ELSE 'committee' END AS kind, coalesce(r.type, p.committee_type) AS committee_type, r.status, r.name IS NOT NULL AS is_traversable FROM party p LEFT JOIN reg r USING (normalized_name)""")
def registry_applied(spark, sf):
    people = T.parties(spark, sf).withColumn("status", F.lit(None).cast("string"))
    listed = people.filter("id LIKE '%7'").select("normalized_name", F.concat(F.lit("The "), "name").alias("name"), F.lit("PAC").alias("type"), F.lit("active").alias("status"))
    return D.apply_registry(people, listed).select("id", "name", "kind", "committee_type", "status", "is_traversable")


@query("""SELECT concat('search ', s_suppkey) AS name, CASE WHEN s_suppkey = 4 THEN 'changed' END AS description, concat('S', s_suppkey) AS seed_entity_id, CASE WHEN s_suppkey <= 6 THEN s_name END AS seed_name, CAST(s_suppkey % 6 + 1 AS INTEGER) AS depth, true AS ordered
 FROM supplier WHERE s_suppkey BETWEEN 1 AND 8 AND s_suppkey NOT IN (2, 3)""")
def saved_searches(spark, sf):
    """Eight searches are made, one is changed, one deleted, one goes with its seed; two seeds have no name any more."""
    saved = spark.createDataFrame([], SAVED)
    for k in range(1, 9):
        saved = V.create(saved, f"search {k}", f"S{k}", {"depth": k % 6 + 1, "direction": "both"})
    saved = spark.createDataFrame(saved.collect(), saved.schema)  # a user's few rows, with their times
    ids = {r["name"]: r["id"] for r in saved.collect()}
    saved = V.delete(V.update(saved, ids["search 4"], description="changed"), ids["search 2"])
    saved = V.without_entities(saved, spark.createDataFrame([("S3",)], "id string"))
    listed = V.listing(saved, T.parties(spark, sf).filter("id IN ('S1', 'S2', 'S3', 'S4', 'S5', 'S6')"))
    return listed.select("name", "description", "seed_entity_id", "seed_name", "params.depth", (F.col("updated_at") >= F.col("created_at")).alias("ordered"))


@query(C._sources_sql("all") + " SELECT entity_id, name, CAST(amount AS VARCHAR) AS amount, CAST(txn_count AS VARCHAR) AS txn_count, coalesce(CAST(last_date AS VARCHAR), '') AS last_date, flow FROM led ORDER BY led.amount DESC, entity_id, flow LIMIT 20000")
def export_read_back(spark, sf):
    """The ledger as a CSV file, read again; no more than the export's most rows."""
    g = T.stored_graph(spark, sf)
    rows = L.sources(g.entities, g.edges, C._SEED, LedgerParams(direction="all"), g.edges_from).orderBy(F.desc("amount"), "entity_id", "flow")
    path = f"{work_folder(spark)}/export-{uuid.uuid4().hex}"
    L.export_csv(rows.select("entity_id", "name", "amount", "txn_count", "last_date", "flow"), path)
    return spark.read.csv(path, header=True, quote='"', escape='"', emptyValue="", schema="entity_id string, name string, amount string, txn_count string, last_date string, flow string")


# --- streams ----------------------------------------------------------------------------------------------------------

@query(C.FLOW + f" SELECT {C.EDGE_OUT} FROM edge")
def streamed_edges(spark, sf):
    """All transactions as a stream of three files, one of them twice: the edges are those of a single load."""
    folder = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = T.flows(spark, sf).select("id", "from_id", "to_id", "amount", "day", "source_id")
    for k in ("q0", "q1", "q2", "q1"):
        rows.filter(F.col("source_id") == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    I.stream_ingest(spark, f"{folder}/in", store, f"{folder}/checkpoint", files_per_batch=2)
    return C.edges_out(store.read("edges"))


@query(C.FLOW + """ SELECT CAST(count(*) + (SELECT count(*) FROM flow WHERE source_id = 'q1') AS BIGINT) AS fetched, CAST(count(DISTINCT id) AS BIGINT) AS inserted,
 CAST(count(*) + (SELECT count(*) FROM flow WHERE source_id = 'q1') - count(DISTINCT id) AS BIGINT) AS skipped, (SELECT count(*) FROM (SELECT from_id FROM flow UNION SELECT to_id FROM flow)) AS created FROM flow""")
def ingest_counters(spark, sf):
    """The counters of three loads, one of them repeated."""
    store = Store(spark, f"{work_folder(spark)}/counters-{uuid.uuid4().hex}")
    rows = T.flows(spark, sf).select("id", "from_id", "to_id", "amount", "day", "source_id")
    counts = [I.apply_batch(store, rows.filter(F.col("source_id") == k)) for k in ("q0", "q1", "q2", "q1")]
    return spark.createDataFrame([tuple(sum(c[k] for c in counts) for k in ("fetched", "inserted", "skipped", "created"))], "fetched long, inserted long, skipped long, created long")


@query(C._crawl_sql("capped") + """, n AS (SELECT level, count(*) AS nodes FROM nodes GROUP BY level), e AS (SELECT level, count(*) AS edges FROM links GROUP BY level)
 SELECT CAST(n.level AS INTEGER) AS level, n.nodes, coalesce(e.edges, 0) AS edges FROM n LEFT JOIN e USING (level)""")
def crawl_events(spark, sf):
    """A crawl as the stream of events that a client gets, one a level."""
    direction, _, k, cap, mode = C._CRAWLS["capped"]
    g = T.stored_graph(spark, sf)
    events = [json.loads(x) for x in I.level_events(spark, g.entities, g.edges, CrawlParams(C._SEED, 2, direction, mode, max_per_node=k, max_nodes=cap))]
    assert events[0]["event"] == "start" and events[-1]["event"] == "done"
    return spark.createDataFrame([(e["level"], len(e["nodes"]), len(e["edges"])) for e in events if e["event"] == "level"], "level int, nodes long, edges long")


# --- parameters -------------------------------------------------------------------------------------------------------

_GRID = [0, 1, 2, 6, 7, 9, 10, 50, 51, 120, 200, 201, 500, 501, 5000, 5001]
_RANGES = [
    ("crawl", "depth", 1, 6), ("crawl", "max_per_node", 1, 200), ("crawl", "max_nodes", 10, 5000), ("crawl", "min_amount", 0, 10**9), ("search", "limit", 1, 50), ("search", "q", 2, 120),
    ("ledger", "limit", 1, 500), ("ledger", "offset", 0, 10**9), ("ledger", "q", 0, 120),
]


@query(f"WITH g(x) AS (VALUES {', '.join(f'({x})' for x in _GRID)}), r(entry, field, low, high) AS (VALUES {', '.join(map(str, _RANGES))}) SELECT entry, field, CAST(x AS INTEGER) AS value, x BETWEEN low AND high AS accepted FROM g, r")
def parameters(spark, sf):
    """Which values the entry points accept; of a text its length."""
    make = {"crawl": lambda **a: CrawlParams("S1", **a), "search": lambda **a: SearchParams(**({"q": "some name"} | a)), "ledger": lambda **a: LedgerParams(**a)}

    def accepted(entry: str, field: str, x: int) -> bool:
        try:
            make[entry](**{field: "x" * x if field == "q" else x})
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(e, f, x, accepted(e, f, x)) for e, f, _, _ in _RANGES for x in _GRID], "entry string, field string, value int, accepted boolean")


# --- graph ------------------------------------------------------------------------------------------------------------

@query(C._crawl_sql("capped") + "," + C.PARTY + f""", x AS (SELECT from_id AS entity_id, 'in' AS flow FROM edge WHERE to_id = '{C._SEED}' UNION ALL SELECT to_id, 'out' FROM edge WHERE from_id = '{C._SEED}')
 SELECT entity_id, flow, entity_id IN (SELECT id FROM nodes) AS in_graph FROM x JOIN party ON party.id = entity_id""")
def ledger_in_graph(spark, sf):
    g = T.stored_graph(spark, sf)
    rows = L.sources(g.entities, g.edges, C._SEED, LedgerParams(direction="all"), g.edges_from)
    return G.in_graph(rows, C._crawl(spark, sf, "capped")[0], "entity_id").select("entity_id", "flow", "in_graph")


@query("""WITH r AS (SELECT l_suppkey AS id, l_linenumber AS level, max(l_partkey) AS v FROM lineitem GROUP BY ALL) SELECT id, max(level) AS level, arg_max(v, level) AS v FROM r GROUP BY id""")
def levels_merged(spark, sf):
    """Of each id the row of the latest level."""
    rows = T.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("level")).agg(F.max("l_partkey").alias("v"))
    return G.merge_levels(rows)


@query(C._crawl_sql("d2") + " SELECT id, CAST(length(id) AS DOUBLE) AS x, CAST(level AS DOUBLE) AS y FROM nodes")
def saved_layout(spark, sf):
    """A crawl's tiles as the map of places that a saved search holds, and back."""
    nodes = C._crawl(spark, sf, "d2")[0].select("id", F.length("id").cast("double").alias("x"), F.col("level").cast("double").alias("y"))
    return G.saved_positions(nodes).select(F.explode("node_positions").alias("id", "at")).select("id", "at.x", "at.y")


@query(C.BASE + """, l0 AS (SELECT * FROM flow WHERE direction = 'contribution'), later AS (SELECT * FROM flow WHERE direction = 'expenditure'),
f1 AS (SELECT to_id AS id FROM l0 WHERE to_id NOT IN (SELECT from_id FROM l0) GROUP BY to_id ORDER BY sum(amount) DESC, id LIMIT 8), l1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM later WHERE from_id IN (SELECT id FROM f1)),
f2 AS (SELECT to_id AS id FROM l1 WHERE to_id NOT IN (SELECT from_id FROM l1) AND to_id NOT IN (SELECT id FROM f1) GROUP BY to_id ORDER BY sum(amount) DESC, id LIMIT 8)
SELECT 1 AS round, id, (SELECT count(*) FROM later WHERE from_id IN (SELECT id FROM f1)) AS inserted FROM f1 UNION ALL SELECT 2, id, (SELECT count(*) FROM later WHERE from_id IN (SELECT id FROM f2)) FROM f2""")
def expansion_rounds(spark, sf):
    """Suppliers' expenditures are asked for in two rounds of eight."""
    flows = T.flows(spark, sf)
    later = flows.filter("direction = 'expenditure'")
    ask = lambda people: later.join(F.broadcast(people.select(F.col("id").alias("from_id"))), "from_id", "left_semi")  # noqa: E731  eight rows at most
    out = None
    for r in expand(T.parties(spark, sf), flows.filter("direction = 'contribution'"), ask, rounds=2):
        rows = r.asked.select(F.lit(r.number).alias("round"), "id", F.lit(r.inserted).cast("long").alias("inserted"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- names and resolution ---------------------------------------------------------------------------------------------

_PLACES = """CASE WHEN na = nb THEN 1.0::DOUBLE WHEN length(a) % 2 = 0 AND least(length(na), length(nb)) >= 12 AND (CASE WHEN length(na) <= length(nb) THEN starts_with(nb, na) ELSE starts_with(na, nb) END) THEN 0.95::DOUBLE
 ELSE least(CASE WHEN KEYS THEN greatest(0.55::DOUBLE * (TRI) + 0.45::DOUBLE * (OVER), 0.8::DOUBLE) ELSE 0.55::DOUBLE * (TRI) + 0.45::DOUBLE * (OVER) END
  + CASE WHEN za <> '' AND zb <> '' AND left(za, 5) = left(zb, 5) THEN 0.08::DOUBLE WHEN length(za) >= 5 AND length(zb) >= 5 AND left(za, 3) = left(zb, 3) THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN length(a) % 3 = length(b) % 3 THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END, 0.99::DOUBLE) END""".replace("KEYS", f"{C.key_sql('na')} = {C.key_sql('nb')}").replace("TRI", C._TRI).replace("OVER", C._OVER)


@query(C._PAIRS + f", z AS (SELECT *, CASE length(a) % 4 WHEN 0 THEN '33601-11' WHEN 1 THEN '33602' ELSE '' END AS za, CASE length(b) % 3 WHEN 0 THEN '33601' WHEN 1 THEN '12345' ELSE '' END AS zb FROM m) SELECT a, b, round({_PLACES}, 9) AS score FROM z")
def score_with_places(spark, sf):
    """The match score with truncated names, ZIP codes and cities."""
    a, b = F.length("a"), F.length("b")
    za, zb = F.when(a % 4 == 0, "33601-11").when(a % 4 == 1, "33602").otherwise(""), F.when(b % 3 == 0, "33601").when(b % 3 == 1, "12345").otherwise("")
    pairs = C._pairs(spark, sf)
    names = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("x"), N.profile(F.col("a")).alias("p"))
    both = pairs.join(names.select(F.col("x").alias("a"), F.col("p").alias("pa")), "a").join(names.select(F.col("x").alias("b"), F.col("p").alias("pb")), "b")
    city = lambda n: F.concat(F.lit(" Tampa "), (n % 3).cast("string"))
    score = N.score_profiles(F.col("pa"), F.col("pb"), a % 2 == 0, za, zb, city(a), city(b))["score"]
    return both.select("a", "b", F.round(score, 9).alias("score"))


@query(f"WITH e AS (SELECT {C.norm_sql('c_name')} AS n, min(concat('C', c_custkey)) AS entity_id FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) SELECT {C.norm_sql('c_name')} AS n, entity_id FROM customer LEFT JOIN e ON e.n = {C.norm_sql('c_name')}")
def exact_resolve(spark, sf):
    c = T.read(spark, sf, "customer").select(N.normalize_name(F.col("c_name")).alias("n"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey")
    return S.exact_resolve(c.select("n"), c.filter("c_custkey % 2 = 0").select("id", F.col("n").alias("normalized_name")))


# Names that only meet where they should: hexadecimal digests. By the last digit of the key: exact, person (created), alias, committee (created), prefix, candidate (created),
# equal blocking key at one ZIP, business (created), nothing known (created), and the person again (cache).
_H = "upper(md5(concat('{0}', CAST(s_suppkey AS STRING))))"
_LETTERS = "translate(" + _H.format("p") + ", '0123456789', 'GHIJKLMNOP')"
_EARLIER = _LETTERS.replace("s_suppkey", "s_suppkey - 8")
_NAME = f"CASE WHEN s_suppkey % 10 = 6 THEN {_H.format('a')} ELSE concat({_H.format('a')}, ' ', {_H.format('b')}) END"
_RAW = f"""CASE CAST(s_suppkey % 10 AS INT) WHEN 0 THEN lower({_NAME}) WHEN 1 THEN concat({_LETTERS}, ', Jo') WHEN 2 THEN {_H.format('c')} WHEN 3 THEN concat({_H.format('d')}, ' (pac)') WHEN 4 THEN left({_NAME}, 40) WHEN 5 THEN {_H.format('e')}
 WHEN 6 THEN concat({_H.format('a')}, ' Inc.') WHEN 7 THEN {_H.format('f')} WHEN 8 THEN {_H.format('g')} ELSE concat({_EARLIER}, ', Jo') END"""
_RESOLVED = f"""WITH m AS (SELECT s_suppkey AS place, CAST(s_suppkey % 10 AS INT) AS k, {_RAW} AS raw FROM supplier),
 o AS (SELECT *, {C.norm_sql('raw')} AS n, CASE k WHEN 0 THEN 'exact' WHEN 2 THEN 'alias' WHEN 4 THEN 'prefix' WHEN 6 THEN 'similarity' WHEN 9 THEN 'cache' ELSE 'created' END AS method FROM m)"""


def _resolution(spark, sf):
    s = T.read(spark, sf, "supplier")
    zip5 = F.concat(F.lit("33"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"))
    none, k = F.lit(None).cast("string"), F.col("s_suppkey") % 10
    entities = s.filter("s_suppkey % 2 = 0 AND s_suppkey % 10 <> 8").selectExpr("concat('E', CAST(s_suppkey AS STRING)) AS id", f"{_NAME} AS name", "s_suppkey").withColumns({"normalized_name": N.normalize_name(F.col("name")), "zip": zip5, "city": none})
    aliases = s.filter("s_suppkey % 10 = 2").selectExpr("concat('E', CAST(s_suppkey AS STRING)) AS entity_id", f"{_H.format('c')} AS normalized_alias", "CAST(0.5 AS DOUBLE) AS confidence")
    mentions = s.select(F.col("s_suppkey").alias("place"), F.expr(_RAW).alias("raw"), k.isin(3, 5).alias("recipient"), F.when(k == 7, "business").alias("hint"), zip5.alias("zip"), none.alias("city"), none.alias("occupation"))
    return resolve_batch(mentions, entities.drop("s_suppkey"), aliases)


@query(_RESOLVED + """ SELECT place, n, CASE WHEN method IN ('created', 'cache') THEN substring(sha256(n), 1, 32) ELSE concat('E', CAST(place AS VARCHAR)) END AS entity_id,
 CASE method WHEN 'alias' THEN 0.5::DOUBLE WHEN 'prefix' THEN 0.95::DOUBLE WHEN 'similarity' THEN NULL ELSE 1.0::DOUBLE END AS confidence, method FROM o""")
def resolve_cascade(spark, sf):
    """Every supplier's mention against known names: each step of the cascade, new entities, and names met before."""
    resolved, _, _ = _resolution(spark, sf)
    return resolved.select("place", "n", "entity_id", F.when(F.col("method") != "similarity", F.round("confidence", 9)).alias("confidence"), "method")


@query(_RESOLVED + " SELECT method, count(*) AS n FROM o GROUP BY method")
def resolver_stats(spark, sf):
    """How many mentions each step resolved."""
    return _resolution(spark, sf)[0].groupBy("method").agg(F.count("*").alias("n"))


@query(_RESOLVED + """ SELECT substring(sha256(n), 1, 32) AS id, CASE k WHEN 1 THEN 'individual' WHEN 3 THEN 'committee' WHEN 5 THEN 'candidate' ELSE 'organization' END AS kind,
 CASE k WHEN 1 THEN concat('Jo ', split_part(raw, ',', 1)) WHEN 3 THEN trim(split_part(raw, '(', 1)) ELSE raw END AS name, CASE WHEN k = 3 THEN 'PAC' END AS committee_type, k IN (3, 5) AS is_traversable FROM o WHERE method = 'created'""")
def created_entities(spark, sf):
    """Kind and display name of those made anew."""
    return _resolution(spark, sf)[1].select("id", "kind", "name", "committee_type", "is_traversable")


# --- SQL functions and adapters ---------------------------------------------------------------------------------------

@query(f"""SELECT p_partkey, {C.norm_sql("concat(p_name, ' & Co. (PAC)')")} AS name, regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') AS slug, CAST(CASE WHEN p_size % 3 <> 0 THEN CAST(p_retailprice AS DECIMAL(16,2)) END AS VARCHAR) AS amount,
 CASE WHEN p_size % 2 = 0 THEN '2021-03-04' END AS day, substring(sha256(p_name), 1, 32) AS id FROM part""")
def sql_functions(spark, sf):
    """The library's functions in SQL text."""
    register(spark)
    return T.read(spark, sf, "part").selectExpr(
        "p_partkey", "flow_name(concat(p_name, ' & Co. (PAC)')) AS name", "flow_slug(p_type) AS slug", "CAST(flow_amount(CASE WHEN p_size % 3 = 0 THEN 'n/a' ELSE concat('$', CAST(CAST(p_retailprice AS DECIMAL(16,2)) AS STRING)) END) AS STRING) AS amount",
        "CAST(flow_day(CASE WHEN p_size % 2 = 0 THEN '3/4/2021' ELSE '2021-02-31' END) AS STRING) AS day", "flow_id(p_name) AS id",
    )


class _Filings:
    key, name = "tables", "line items as filings"

    def __init__(self, sf: str):
        self.sf = sf

    def rows(self, spark) -> DataFrame:
        return T.filings(spark, self.sf).select(F.col("filer").alias("filer_raw"), F.col("counterparty").alias("counterparty_raw"), "direction", "amount", F.col("day").alias("date"), F.col("id").alias("row_hash"))


@query(C.BASE + """ SELECT DISTINCT id, substring(sha256(from_id), 1, 32) AS from_id, substring(sha256(to_id), 1, 32) AS to_id, CAST(amount AS VARCHAR) AS amount, CAST(day AS VARCHAR) AS day, direction, 'tables' AS source_id FROM flow""")
def adapter_load(spark, sf):
    """A source of its own behind the adapter protocol."""
    source = _Filings(sf)
    assert isinstance(source, A.Adapter)
    rows = A.load(spark, source)
    return rows.select("id", "from_id", "to_id", *text("amount", "day"), "direction", "source_id")
