"""The registered queries, each beside its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..operators import graph as G
from ..operators import ledger as L
from ..operators import load as D
from ..operators import search as S
from . import fixtures as T
from .params import CrawlParams, LedgerParams, SearchParams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def text(*columns: str):
    """Columns as strings, so that both engines render money and days alike."""
    return [F.col(c).cast("string").alias(c) for c in columns]


# --- SQL pieces -------------------------------------------------------------------------------------------------------

TAGS = N.TAGS


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def norm_sql(c: str) -> str:
    bare = f"regexp_replace({c}, '(?i)\\s*\\(({TAGS})\\)\\s*$', '')"
    upper = f"strip_accents(upper(replace({bare}, 'ß', 'ss')))"
    return f"trim(regexp_replace(regexp_replace(replace({upper}, '&', ' AND '), '''S\\b', 'S', 'g'), '[^A-Z0-9]+', ' ', 'g'))"


def words_sql(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


def key_sql(n: str) -> str:
    noise = sql_list(N.STOPWORDS + N.CORPORATE + N.POLITICAL)
    bare = f"list_filter({words_sql(n)}, lambda t: NOT list_contains({noise}, t))"
    return f"array_to_string(list_sort(CASE WHEN len({bare}) > 0 THEN {bare} ELSE {words_sql(n)} END), ' ')"


def tokens_sql(n: str) -> str:
    return f"list_distinct(list_filter({words_sql(n)}, lambda t: length(t) > 1 AND NOT list_contains({sql_list(N.STOPWORDS)}, t)))"


def grams_sql(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length({c}) + 2), lambda i: substring(concat('  ', {c}, ' '), i, 3)))"


def word_grams_sql(c: str) -> str:
    return f"list_distinct(flatten(list_transform({words_sql(c)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring(concat('  ', w, ' '), i, 3)))))"


def jaccard_sql(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"({common} / nullif(len({a}) + len({b}) - {common}, 0))"


BASE = """
WITH raw AS (
  SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS filer, concat('C', CAST(o_custkey AS VARCHAR)) AS counterparty,
    CASE WHEN l_returnflag = 'R' AND l_quantity >= 50 THEN 'expenditure' ELSE 'contribution' END AS direction,
    CAST(l_extendedprice AS DECIMAL(16,2)) AS amount, CAST(l_shipdate AS DATE) AS day, l_linestatus AS type_code, o_orderpriority AS description,
    concat('q', CAST(l_linenumber % 3 AS VARCHAR)) AS source_id, substring(sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 32) AS id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
flow AS (SELECT id, CASE WHEN direction = 'expenditure' THEN filer ELSE counterparty END AS from_id, CASE WHEN direction = 'expenditure' THEN counterparty ELSE filer END AS to_id,
  amount, day, direction, type_code, description, source_id FROM raw)"""


def edges_sql(flow: str = "flow", trav: str = "trav", name: str = "edge") -> str:
    return f"""
{name} AS (SELECT substring(sha256(concat_ws('|', from_id, to_id)), 1, 32) AS edge_id, from_id, to_id, total_amount, txn_count, first_date, last_date,
  f.id IS NOT NULL AND t.id IS NOT NULL AND from_id <> to_id AS is_direct_link
  FROM (SELECT from_id, to_id, CAST(sum(amount) AS DECIMAL(16,2)) AS total_amount, CAST(count(*) AS INTEGER) AS txn_count, min(day) AS first_date, max(day) AS last_date FROM {flow} GROUP BY ALL) e
  LEFT JOIN {trav} f ON f.id = from_id LEFT JOIN {trav} t ON t.id = to_id)"""


FLOW = BASE + ",\ntrav AS (SELECT DISTINCT to_id AS id FROM flow)," + edges_sql()
PARTY = f"""
party AS (SELECT p.*, n_name AS city, {norm_sql('p.name')} AS normalized_name FROM (
  SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'organization' ELSE 'individual' END AS kind, c_name AS name, NULL AS committee_type, c_nationkey AS nation FROM customer
  UNION ALL SELECT concat('S', CAST(s_suppkey AS VARCHAR)), 'committee', s_name, ['PAC', 'CCE', 'ECO', 'ECI', 'IXO', 'PAP', 'PTY'][s_suppkey % 7 + 1], s_nationkey FROM supplier) p
  LEFT JOIN nation ON n_nationkey = p.nation)"""


def totals_sql(edge: str = "edge", name: str = "tot") -> str:
    return f"""
{name} AS (SELECT id, CAST(coalesce(sum(a) FILTER (WHERE i = 1), 0) AS DECIMAL(16,2)) AS total_received, CAST(coalesce(sum(a) FILTER (WHERE i = 0), 0) AS DECIMAL(16,2)) AS total_given,
  CAST(sum(i) AS INTEGER) AS in_degree, CAST(sum(1 - i) AS INTEGER) AS out_degree, min(d0) AS first_seen, max(d1) AS last_seen
  FROM (SELECT to_id AS id, 1 AS i, total_amount AS a, first_date AS d0, last_date AS d1 FROM {edge} UNION ALL SELECT from_id, 0, total_amount, first_date, last_date FROM {edge}) GROUP BY id)"""


ENT = FLOW + "," + PARTY + "," + totals_sql() + """,
ent AS (SELECT p.*, t.id IS NOT NULL AS is_traversable, coalesce(total_received, 0) AS total_received, coalesce(total_given, 0) AS total_given, coalesce(in_degree, 0) AS in_degree,
  coalesce(out_degree, 0) AS out_degree, first_seen, last_seen FROM party p LEFT JOIN tot USING (id) LEFT JOIN trav t ON t.id = p.id)"""
EDGE_OUT = "edge_id, from_id, to_id, CAST(total_amount AS VARCHAR) AS total_amount, txn_count, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, is_direct_link"
TOTAL_OUT = "CAST(total_received AS VARCHAR) AS total_received, CAST(total_given AS VARCHAR) AS total_given, in_degree, out_degree, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen"


def edges_out(e: DataFrame) -> DataFrame:
    return e.select("edge_id", "from_id", "to_id", *text("total_amount"), "txn_count", *text("first_date", "last_date"), "is_direct_link")


def totals_out(e: DataFrame, *more: str) -> DataFrame:
    return e.select("id", *more, *text("total_received", "total_given"), "in_degree", "out_degree", *text("first_seen", "last_seen"))


# --- canonical rows and loading ---------------------------------------------------------------------------------------

@query(BASE + " SELECT filer, counterparty, direction, CAST(amount AS VARCHAR) AS amount, CAST(day AS VARCHAR) AS day, type_code, description, source_id, id FROM raw")
def canonical_rows(spark, sf):
    return T.filings(spark, sf).select("filer", "counterparty", "direction", *text("amount", "day"), "type_code", "description", "source_id", "id")


@query(BASE + " SELECT id, from_id, to_id, direction, CAST(amount AS VARCHAR) AS amount FROM flow")
def directed_ends(spark, sf):
    return T.flows(spark, sf).select("id", "from_id", "to_id", "direction", *text("amount"))


_DEDUPE = "substring(sha256(concat_ws('|', l_orderkey, l_linenumber)), 1, 32)"


@query(f"""SELECT row_hash, l_partkey, l_suppkey FROM (SELECT {_DEDUPE} AS row_hash, l_partkey, l_suppkey,
 row_number() OVER (PARTITION BY {_DEDUPE} ORDER BY l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def row_hash_dedupe(spark, sf):
    rows = T.read(spark, sf, "lineitem").select(X.row_hash(F.col("l_orderkey"), F.col("l_linenumber")).alias("row_hash"), "l_partkey", "l_suppkey")
    return D.insert_if_absent(None, rows, "row_hash", ["l_partkey", "l_suppkey"])


@query(f"""WITH r AS (SELECT {_DEDUPE} AS row_hash, l_partkey, l_suppkey, l_returnflag FROM lineitem), known AS (SELECT row_hash FROM r WHERE l_returnflag = 'A'),
 fresh AS (SELECT *, row_number() OVER (PARTITION BY row_hash ORDER BY l_partkey, l_suppkey) AS n FROM r)
 SELECT row_hash, l_partkey, l_suppkey FROM fresh WHERE n = 1 AND row_hash NOT IN (SELECT row_hash FROM known)""")
def insert_if_absent(spark, sf):
    rows = T.read(spark, sf, "lineitem").select(X.row_hash(F.col("l_orderkey"), F.col("l_linenumber")).alias("row_hash"), "l_partkey", "l_suppkey", "l_returnflag")
    known = rows.filter("l_returnflag = 'A'")
    return D.insert_if_absent(known, rows.drop("l_returnflag"), "row_hash", ["l_partkey", "l_suppkey"])


_CLEAN = "trim(regexp_replace(v, '[$,]', '', 'g'))"


@query(f"""WITH c AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS name,
 CASE event_type WHEN 'click' THEN concat('$', CAST(value AS VARCHAR)) WHEN 'view' THEN concat(CAST(value AS VARCHAR), 'a') ELSE CAST(value AS VARCHAR) END AS v FROM events)
 SELECT event_id, CAST(CASE WHEN regexp_matches({_CLEAN}, '^-?\\d+(\\.\\d+)?$') THEN CAST({_CLEAN} AS DECIMAL(16,2)) END AS VARCHAR) AS amount,
 name <> '' AND regexp_matches({_CLEAN}, '^-?\\d+(\\.\\d+)?$') AS good FROM c""")
def rows_quarantine(spark, sf):
    e = T.read(spark, sf, "events")
    name = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    v = F.col("value").cast("string")
    raw = F.when(F.col("event_type") == "click", F.concat(F.lit("$"), v)).when(F.col("event_type") == "view", F.concat(v, F.lit("a"))).otherwise(v)
    amount = X.clean_amount(raw)
    return e.select("event_id", amount.cast("string").alias("amount"), ((name != "") & amount.isNotNull()).alias("good"))


@query(FLOW + f" SELECT {EDGE_OUT} FROM edge")
def edge_rollup(spark, sf):
    return edges_out(T.graph(spark, sf)[1])


@query(BASE + ", early AS (SELECT * FROM flow WHERE day < DATE '2000-01-01'), trav AS (SELECT DISTINCT to_id AS id FROM flow)," + edges_sql() + f" SELECT {EDGE_OUT} FROM edge")
def edge_rollup_touched(spark, sf):
    """Edges of the early transactions, then the late ones added by recomputing what they touch."""
    txns = T.flows(spark, sf)
    early, late = txns.filter("day < DATE '2000-01-01'"), txns.filter("day >= DATE '2000-01-01'")
    trav = txns.select(F.col("to_id").alias("id")).distinct()
    old = D.rollup_edges(early, early.select(F.col("to_id").alias("id")))
    touched = late.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    promoted = trav.join(early.select(F.col("to_id").alias("id")), "id", "left_anti")
    return edges_out(D.refresh_edges(old, txns, trav, touched.union(promoted).distinct()))


_NATION = ENT + ", nf AS (SELECT a.city AS from_id, b.city AS to_id, amount, day FROM flow JOIN party a ON a.id = from_id JOIN party b ON b.id = to_id), nt AS (SELECT DISTINCT to_id AS id FROM nf)," + edges_sql("nf", "nt", "ne")


@query(_NATION + f" SELECT {EDGE_OUT}, from_id = to_id AS is_self FROM ne")
def nation_flow_self_loops(spark, sf):
    e = T.nation_edges(spark, sf)
    return edges_out(e).withColumn("is_self", F.col("from_id") == F.col("to_id"))


@query(FLOW + "," + totals_sql() + f" SELECT id, {TOTAL_OUT} FROM tot")
def entity_totals(spark, sf):
    return totals_out(D.entity_totals(T.graph(spark, sf)[1]))


@query(ENT + f" SELECT id, name, kind, is_traversable, {TOTAL_OUT} FROM ent")
def rebuilt_entities(spark, sf):
    return totals_out(T.graph(spark, sf)[0], "name", "kind", "is_traversable")


@query(ENT + " SELECT id, is_traversable FROM ent")
def traversability(spark, sf):
    return D.promote(T.parties(spark, sf), T.flows(spark, sf)).select("id", "is_traversable")


_KEEP = BASE + """, kept AS (SELECT * FROM flow WHERE source_id <> 'q1'), trav AS (SELECT DISTINCT to_id AS id FROM flow),"""


@query(_KEEP + edges_sql("kept") + "," + PARTY + "," + totals_sql() + f""" SELECT party.id, coalesce(CAST(total_received AS VARCHAR), '0.00') AS total_received, coalesce(CAST(total_given AS VARCHAR), '0.00') AS total_given,
 coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen FROM party LEFT JOIN tot USING (id)
 WHERE party.id IN (SELECT from_id FROM kept UNION SELECT to_id FROM kept) OR left(party.id, 1) <> 'C'""")
def purge_source(spark, sf):
    """Source q1's transactions go, and customers left without any."""
    entities, edges, txns = T.graph(spark, sf)
    return totals_out(D.purge_source(entities, edges, txns, None, "q1", "qC")[0])


@query(FLOW + ", kept AS (SELECT * FROM flow WHERE source_id = 'q0') SELECT edge_id FROM edge WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.from_id = edge.from_id AND k.to_id = edge.to_id)")
def orphan_edges(spark, sf):
    _, edges, txns = T.graph(spark, sf)
    return D.orphan_edges(edges, txns.filter("source_id = 'q0'")).select("edge_id")


@query(BASE + ", kept AS (SELECT * FROM flow WHERE direction = 'expenditure')," + PARTY + " SELECT id FROM party WHERE left(id, 1) = 'C' AND id NOT IN (SELECT from_id FROM kept UNION SELECT to_id FROM kept)")
def orphan_entities(spark, sf):
    return D.orphan_entities(T.parties(spark, sf), T.flows(spark, sf).filter("direction = 'expenditure'"), None, "qC").select("id")


@query("""WITH r AS (SELECT c_mktsegment AS name, concat('T', CAST(c_nationkey AS VARCHAR)) AS type, CASE WHEN c_acctbal < 0 THEN 'active' ELSE 'closed' END AS status, c_custkey AS pos FROM customer)
 SELECT name, type, status FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY status <> 'active', pos) AS n FROM r) WHERE n = 1""")
def registry_keep_best(spark, sf):
    c = T.read(spark, sf, "customer")
    return D.registry_keep_best(c.select(F.col("c_mktsegment").alias("name"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("type"), F.when(F.col("c_acctbal") < 0, "active").otherwise("closed").alias("status"), F.col("c_custkey").alias("pos")))


@query("""WITH old AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey < 12 THEN s_name END AS city, CASE WHEN s_nationkey > 18 THEN 'z' END AS zip FROM supplier),
 new AS (SELECT l_suppkey AS id, l_partkey AS o, CASE WHEN l_returnflag = 'R' THEN concat('p', CAST(l_partkey AS VARCHAR)) END AS city, CASE WHEN l_returnflag = 'A' THEN concat('a', CAST(l_partkey AS VARCHAR)) END AS zip FROM lineitem),
 f AS (SELECT id, arg_min(city, o) FILTER (WHERE city IS NOT NULL) AS city, arg_min(zip, o) FILTER (WHERE zip IS NOT NULL) AS zip FROM new GROUP BY id)
 SELECT old.id, coalesce(old.city, f.city) AS city, coalesce(old.zip, f.zip) AS zip FROM old LEFT JOIN f USING (id)""")
def fill_blanks(spark, sf):
    old = T.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") < 12, F.col("s_name")).alias("city"), F.when(F.col("s_nationkey") > 18, "z").alias("zip"))
    part = F.col("l_partkey").cast("string")
    new = T.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("o"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("p"), part)).alias("city"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("a"), part)).alias("zip"))
    return D.fill_blanks(old, new, "id", ["city", "zip"], ["o"])


# --- graph ------------------------------------------------------------------------------------------------------------

def hop_sql(frontier: str, direction: str, k: int, where: str = "true", edge: str = "edge") -> str:
    parts = []
    if direction in ("upstream", "both"):
        parts.append(f"SELECT *, to_id AS frontier_id, 0 AS branch, from_id AS neighbour, row_number() OVER (PARTITION BY to_id ORDER BY total_amount DESC, edge_id) AS rank FROM {edge} WHERE to_id IN ({frontier}) AND {where}")
    if direction in ("downstream", "both"):
        parts.append(f"SELECT *, from_id AS frontier_id, 1 AS branch, to_id AS neighbour, row_number() OVER (PARTITION BY from_id ORDER BY total_amount DESC, edge_id) AS rank FROM {edge} WHERE from_id IN ({frontier}) AND {where}")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rank <= {k}"


def _hop(name: str, direction: str, k: int, where: str = "true", **options) -> None:
    """A hop from every supplier."""
    sql = FLOW + f", h AS ({hop_sql('SELECT DISTINCT concat(chr(83), CAST(s_suppkey AS VARCHAR)) FROM supplier', direction, k, where)}) SELECT {EDGE_OUT}, frontier_id, branch, neighbour, CAST(rank AS INTEGER) AS rank FROM h"

    def run(spark, sf):
        g = T.stored_graph(spark, sf)
        frontier = T.read(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"))
        h = G.hop(g.edges, frontier, direction, k, G.edge_filter(**options), g.edges_from)
        return h.select("edge_id", "from_id", "to_id", *text("total_amount"), "txn_count", *text("first_date", "last_date"), "is_direct_link", "frontier_id", "branch", "neighbour", "rank")

    run.__name__ = name
    query(sql)(run)


_hop("hop_upstream", "upstream", 25, link_mode="donor")
_hop("hop_downstream", "downstream", 25, link_mode="donor")
_hop("hop_both", "both", 25, link_mode="donor")
_hop("hop_direct", "both", 25, "is_direct_link", link_mode="direct")
_hop("hop_min_amount", "both", 25, "total_amount >= 100000", link_mode="donor", min_amount=100000.0)
_hop("hop_date_overlap", "upstream", 25, "last_date >= DATE '1998-01-01' AND first_date <= DATE '1999-06-30'", link_mode="donor", date_from="1998-01-01", date_to="1999-06-30")

_SEED = "S7"


def crawl_sql(direction: str, where: str, k: int, cap: int) -> str:
    """Two levels unrolled."""
    order = "min(place * 1000000 + branch * 1000 + rank)"
    return FLOW + f""", h1 AS (SELECT *, 0 AS place FROM ({hop_sql(f"SELECT '{_SEED}'", direction, k, where)})),
n1 AS (SELECT id, row_number() OVER (ORDER BY o) AS r, count(*) OVER () AS c FROM (SELECT neighbour AS id, {order} AS o FROM h1 WHERE neighbour <> '{_SEED}' GROUP BY ALL)),
k1 AS (SELECT * FROM n1 WHERE r <= {cap - 1}),
f2 AS (SELECT id, row_number() OVER (ORDER BY r) - 1 AS place FROM k1 WHERE id IN (SELECT id FROM trav)),
h2 AS (SELECT h.*, f2.place FROM ({hop_sql('SELECT id FROM f2', direction, k, where)}) h JOIN f2 ON f2.id = h.frontier_id),
n2 AS (SELECT id, row_number() OVER (ORDER BY o) AS r FROM (SELECT neighbour AS id, {order} AS o FROM h2 WHERE neighbour <> '{_SEED}' AND neighbour NOT IN (SELECT id FROM k1) GROUP BY ALL)),
k2 AS (SELECT * FROM n2 WHERE r <= {cap - 1} - (SELECT count(*) FROM k1)),
nodes AS (SELECT '{_SEED}' AS id, 0 AS level UNION ALL SELECT id, 1 FROM k1 UNION ALL SELECT id, 2 FROM k2),
links AS (SELECT DISTINCT edge_id, from_id, to_id, total_amount, 1 AS level FROM h1 UNION ALL SELECT DISTINCT edge_id, from_id, to_id, total_amount, 2 FROM h2 WHERE edge_id NOT IN (SELECT edge_id FROM h1))"""


_CRAWLS = {"d2": ("both", "is_direct_link", 25, 600, "direct"), "capped": ("both", "true", 25, 100, "donor"), "up": ("upstream", "true", 10, 600, "donor")}


def _crawl(spark, sf, name):
    direction, _, k, cap, mode = _CRAWLS[name]
    g = T.stored_graph(spark, sf)
    return G.crawl_all(spark, g.entities, g.edges, CrawlParams(_SEED, 2, direction, mode, max_per_node=k, max_nodes=cap), g.edges_from)


def _crawl_sql(name: str) -> str:
    direction, where, k, cap, _ = _CRAWLS[name]
    return crawl_sql(direction, where, k, cap)


_LINKS = " SELECT edge_id, from_id, to_id, CAST(total_amount AS VARCHAR) AS total_amount, level FROM links"


def _links(e: DataFrame) -> DataFrame:
    return e.select("edge_id", "from_id", "to_id", *text("total_amount"), "level")


@query(_crawl_sql("d2") + " SELECT id, level FROM nodes")
def crawl_d2_nodes(spark, sf):
    return _crawl(spark, sf, "d2")[0].select("id", "level")


@query(_crawl_sql("d2") + _LINKS)
def crawl_d2_edges(spark, sf):
    return _links(_crawl(spark, sf, "d2")[1])


@query(_crawl_sql("capped") + " SELECT id, level FROM nodes")
def crawl_capped(spark, sf):
    return _crawl(spark, sf, "capped")[0].select("id", "level")


@query(_crawl_sql("capped") + _LINKS)
def crawl_capped_edges(spark, sf):
    return _links(_crawl(spark, sf, "capped")[1])


@query(_crawl_sql("up") + _LINKS)
def crawl_upstream_edges(spark, sf):
    return _links(_crawl(spark, sf, "up")[1])


@query(_crawl_sql("capped") + _LINKS + " WHERE from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes)")
def crawl_pruned(spark, sf):
    nodes, edges, _ = _crawl(spark, sf, "capped")
    return _links(G.prune_dangling(nodes, edges))


@query(_crawl_sql("d2") + " SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT max(level) FROM nodes) AS max_level, count(*) AS edges, CAST(coalesce(sum(total_amount), 0) AS VARCHAR) AS amount, CAST(coalesce(max(total_amount), 0) AS VARCHAR) AS max_amount FROM links")
def crawl_totals(spark, sf):
    nodes, edges, _ = _crawl(spark, sf, "d2")
    return G.crawl_totals(nodes, edges).select("nodes", "max_level", "edges", *text("amount", "max_amount"))


@query(FLOW + f" SELECT DISTINCT id FROM (SELECT '{_SEED}' AS id UNION ALL SELECT from_id FROM edge WHERE to_id = '{_SEED}' UNION ALL SELECT to_id FROM edge WHERE from_id = '{_SEED}')")
def ego_network(spark, sf):
    return G.ego_network(T.stored_graph(spark, sf).edges, _SEED)[0]


@query(ENT + " SELECT id, is_traversable AND in_degree + out_degree > 0 AS has_more FROM ent")
def has_more(spark, sf):
    return G.expandable(T.stored_graph(spark, sf).entities).select("id", "has_more")


@query(ENT + " SELECT id, name, CAST(total_received AS VARCHAR) AS total_received FROM ent WHERE is_traversable AND out_degree = 0 ORDER BY ent.total_received DESC, id LIMIT 8")
def expand_frontier(spark, sf):
    return G.expansion_frontier(T.stored_graph(spark, sf).entities).select("id", "name", *text("total_received"))


@query(FLOW + " SELECT edge_id, CAST(round(1 + 7 * log10(CAST(total_amount AS DOUBLE) + 1) / log10((SELECT CAST(max(total_amount) AS DOUBLE) FROM edge) + 1), 6) AS VARCHAR) AS width FROM edge")
def edge_width(spark, sf):
    edges = T.stored_graph(spark, sf).edges
    top = edges.agg(F.max("total_amount").alias("top"))
    return edges.join(F.broadcast(top)).select("edge_id", F.round(X.edge_width(F.col("total_amount"), F.col("top")), 6).cast("string").alias("width"))


# --- ledger, search, summaries ----------------------------------------------------------------------------------------

def _sources_sql(direction: str) -> str:
    parts = {"in": f"SELECT from_id AS entity_id, total_amount AS amount, txn_count, first_date, last_date, 'in' AS flow FROM edge WHERE to_id = '{_SEED}'", "out": f"SELECT to_id, total_amount, txn_count, first_date, last_date, 'out' FROM edge WHERE from_id = '{_SEED}'"}
    base = " UNION ALL ".join(parts[x] for x in (["in", "out"] if direction == "all" else [direction]))
    if direction == "out":
        base = base.replace("SELECT to_id,", "SELECT to_id AS entity_id,").replace("total_amount,", "total_amount AS amount,").replace("'out'", "'out' AS flow")
    return ENT + f", x AS ({base}), led AS (SELECT entity_id, name, kind, committee_type, amount, txn_count, first_date, last_date, flow, entity_id = '{_SEED}' AS is_self, normalized_name FROM x JOIN ent ON ent.id = entity_id)"


_SOURCES_OUT = " SELECT entity_id, name, kind, committee_type, CAST(amount AS VARCHAR) AS amount, txn_count, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, flow, is_self FROM led"


def _sources_out(rows: DataFrame) -> DataFrame:
    return rows.select("entity_id", "name", "kind", "committee_type", *text("amount"), "txn_count", *text("first_date", "last_date"), "flow", "is_self")


def _ledger(name: str, p: LedgerParams) -> None:
    def run(spark, sf):
        g = T.stored_graph(spark, sf)
        return _sources_out(L.sources(g.entities, g.edges, _SEED, p, g.edges_from))

    run.__name__ = name
    query(_sources_sql(p.direction) + _SOURCES_OUT)(run)


for _d in ("in", "out", "all"):
    _ledger(f"ledger_sources_{_d}", LedgerParams(direction=_d))


@query(_sources_sql("all") + _SOURCES_OUT + " WHERE amount >= 50000 AND normalized_name LIKE '%0001%' ORDER BY last_date DESC NULLS LAST, entity_id, flow LIMIT 20 OFFSET 5")
def ledger_page(spark, sf):
    g = T.stored_graph(spark, sf)
    p = LedgerParams(direction="all", q="0001", sort="date", limit=20, offset=5, min_amount=50000)
    return _sources_out(L.page(L.sources(g.entities, g.edges, _SEED, p, g.edges_from), p))


@query(_sources_sql("all") + " SELECT CAST(count(*) AS INTEGER) AS total, CAST(CAST(coalesce(sum(amount), 0) AS DECIMAL(26,2)) AS VARCHAR) AS total_amount FROM led")
def ledger_totals(spark, sf):
    g = T.stored_graph(spark, sf)
    return L.totals(L.sources(g.entities, g.edges, _SEED, LedgerParams(direction="all"), g.edges_from))


def _txn_rows(spark, sf):
    rows = T.stored_graph(spark, sf).txns.withColumnsRenamed({"day": "txn_date", "type_code": "txn_type_code"})
    sources = rows.select("source_id").distinct().filter("source_id <> 'q2'").select(F.col("source_id").alias("id"), F.concat(F.lit("source "), "source_id").alias("key"))
    return rows.withColumns({"state_code": F.lit(None).cast("string"), "occupation": F.lit(None).cast("string")}), sources


def _txns_sql(where: str) -> str:
    return ENT + f""", led AS (SELECT flow.id, CASE WHEN to_id = '{_SEED}' THEN from_id ELSE to_id END AS counterparty_id, CASE WHEN to_id = '{_SEED}' THEN a.name ELSE b.name END AS counterparty_name,
 CAST(amount AS VARCHAR) AS amount, CAST(day AS VARCHAR) AS txn_date, CASE WHEN to_id = '{_SEED}' THEN 'in' ELSE 'out' END AS flow, type_code AS txn_type_code, description, a.city,
 CASE WHEN source_id <> 'q2' THEN concat('source ', source_id) END AS source_key FROM flow JOIN party a ON a.id = from_id JOIN party b ON b.id = to_id WHERE {where}) SELECT * FROM led"""


def _txns(name: str, direction: str, where: str) -> None:
    def run(spark, sf):
        rows, sources = _txn_rows(spark, sf)
        out = L.transactions(rows, sources, _SEED, LedgerParams(view="transactions", direction=direction))
        return out.select("id", "counterparty_id", "counterparty_name", *text("amount", "txn_date"), "flow", "txn_type_code", "description", "city", "source_key")

    run.__name__ = name
    query(_txns_sql(where))(run)


_txns("ledger_txns_in", "in", f"to_id = '{_SEED}'")
_txns("ledger_txns_all", "all", f"to_id = '{_SEED}' OR from_id = '{_SEED}'")


@query(_sources_sql("all") + """ SELECT entity_id, flow, concat_ws(' · ', kind, CASE WHEN txn_count > 1 THEN concat(CAST(txn_count AS VARCHAR), ' transactions') END, CAST(last_date AS VARCHAR)) AS subtitle,
 concat(CASE WHEN flow = 'out' THEN '−' ELSE '' END, CAST(amount AS VARCHAR)) AS signed FROM led""")
def ledger_subtitle(spark, sf):
    g = T.stored_graph(spark, sf)
    rows = L.sources(g.entities, g.edges, _SEED, LedgerParams(direction="all"), g.edges_from)
    signed = F.concat(F.when(F.col("flow") == "out", "−").otherwise(""), F.col("amount").cast("string"))
    return rows.select("entity_id", "flow", X.source_subtitle(F.col("kind"), F.col("txn_count"), F.col("last_date")).alias("subtitle"), signed.alias("signed"))


def _search_sql(q: str, more: str = "true") -> str:
    n = norm_sql(f"'{q}'")
    sim = f"coalesce({jaccard_sql('g', 'q')}, 0.0)"
    return ENT + f""", s AS (SELECT *, {word_grams_sql('normalized_name')} AS g, {word_grams_sql(n)} AS q FROM ent)
 SELECT id, name, kind, CAST(total_received AS VARCHAR) AS total_received, CAST({sim} + (CASE WHEN starts_with(normalized_name, {n}) THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN is_traversable THEN 0.15::DOUBLE ELSE 0 END)
   + least(CAST(total_received AS DOUBLE) / 5000000.0::DOUBLE, 0.15::DOUBLE) AS FLOAT) AS score
 FROM s WHERE (contains(normalized_name, {n}) OR {sim} >= 0.3) AND {more} ORDER BY score DESC, s.total_received DESC, id LIMIT 20"""


@query(_search_sql("supplier 00000004"))
def entity_search(spark, sf):
    return S.search(T.stored_graph(spark, sf).entities, SearchParams("supplier 00000004")).select("id", "name", "kind", *text("total_received"), "score")


@query(_search_sql("Customer #0000001", "is_traversable"))
def entity_search_traversable(spark, sf):
    return S.search(T.stored_graph(spark, sf).entities, SearchParams("Customer #0000001", traversable_only=True)).select("id", "name", "kind", *text("total_received"), "score")


@query(ENT + f" SELECT id, name, kind, committee_type, city, is_traversable, {TOTAL_OUT}, CAST(1 AS FLOAT) AS score FROM ent WHERE id = '{_SEED}'")
def entity_lookup(spark, sf):
    return totals_out(S.lookup(T.stored_graph(spark, sf).entities, _SEED), "name", "kind", "committee_type", "city", "is_traversable", "score")


@query(ENT + """ SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM ent WHERE is_traversable) AS traversable, (SELECT count(*) FROM flow) AS transactions,
 (SELECT count(*) FROM edge) AS edges, (SELECT CAST(CAST(coalesce(sum(amount), 0) AS DECIMAL(26,2)) AS VARCHAR) FROM flow) AS amount""")
def summary(spark, sf):
    entities, edges, txns = T.graph(spark, sf)
    a = entities.agg(F.count("*").alias("entities"), F.count_if("is_traversable").alias("traversable"))
    b = txns.agg(F.count("*").alias("transactions"), F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(26,2)").cast("string").alias("amount"))
    return a.join(b).join(edges.agg(F.count("*").alias("edges"))).select("entities", "traversable", "transactions", "edges", "amount")


@query(ENT + " SELECT id, name, CAST(total_received AS VARCHAR) AS total_received, in_degree FROM ent ORDER BY ent.total_received DESC NULLS LAST, id LIMIT 8")
def top_recipients(spark, sf):
    return T.stored_graph(spark, sf).entities.orderBy(F.desc_nulls_last("total_received"), "id").limit(8).select("id", "name", *text("total_received"), "in_degree")


@query(BASE + """ SELECT filer, count(*) FILTER (WHERE direction = 'contribution') AS contributions, count(*) FILTER (WHERE direction = 'expenditure') AS expenditures,
 CAST(coalesce(sum(amount) FILTER (WHERE direction = 'contribution'), 0) AS VARCHAR) AS money_in, CAST(coalesce(sum(amount) FILTER (WHERE direction = 'expenditure'), 0) AS VARCHAR) AS money_out FROM raw GROUP BY filer""")
def filer_in_out(spark, sf):
    rows = T.filings(spark, sf)
    money = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0).cast("decimal(26,2)")).cast("string")
    return rows.groupBy("filer").agg(F.count_if(F.col("direction") == "contribution").alias("contributions"), F.count_if(F.col("direction") == "expenditure").alias("expenditures"), money("contribution").alias("money_in"), money("expenditure").alias("money_out"))


@query("SELECT o_orderpriority AS office, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, office LIMIT 10")
def office_histogram(spark, sf):
    return T.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("office")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "office").limit(10)


@query(BASE + " SELECT count(DISTINCT counterparty) AS donors FROM raw WHERE direction = 'contribution'")
def distinct_donors(spark, sf):
    return T.filings(spark, sf).filter("direction = 'contribution'").select("counterparty").distinct().agg(F.count("*").alias("donors"))


@query(BASE + " SELECT type_code, count(*) AS n FROM raw GROUP BY ALL")
def count_by_method(spark, sf):
    return T.filings(spark, sf).groupBy("type_code").agg(F.count("*").alias("n"))


# --- names and cells --------------------------------------------------------------------------------------------------

_LABEL = "concat(p_name, CASE p_size % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' PAC (PAC)' WHEN 2 THEN '''s Friends & Co' ELSE ', The' END)"


def _labels(spark, sf):
    m = F.col("p_size") % 4
    return T.read(spark, sf, "part").select("p_size", F.concat("p_name", F.when(m == 0, " Inc.").when(m == 1, " PAC (PAC)").when(m == 2, "'s Friends & Co").otherwise(", The")).alias("name")).distinct()


@query(f"SELECT doc_id, {norm_sql('text')} AS normalized FROM documents")
def name_normalize(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", N.normalize_name(F.col("text")).alias("normalized"))


@query(f"""WITH n AS (SELECT DISTINCT {_LABEL} AS name FROM part), m AS (SELECT name, {norm_sql('name')} AS n FROM n)
 SELECT name, n, {key_sql('n')} AS key, array_to_string(list_sort({tokens_sql('n')}), ' ') AS tokens FROM m""")
def blocking_key(spark, sf):
    c = F.col("name")
    return _labels(spark, sf).select("name").distinct().select("name", N.normalize_name(c).alias("n"), N.blocking_key(c).alias("key"), F.array_join(F.array_sort(N.significant_tokens(c)), " ").alias("tokens"))


@query(f"""WITH n AS (SELECT DISTINCT {_LABEL} AS name FROM part) SELECT name, trim(regexp_replace(name, '(?i)\\s*\\(({TAGS})\\)\\s*$', '')) AS bare,
 upper(nullif(regexp_extract(name, '(?i)\\(({TAGS})\\)\\s*$', 1), '')) AS tag FROM n""")
def split_type_tag(spark, sf):
    bare, tag = N.split_type_tag(F.col("name"))
    return _labels(spark, sf).select("name").distinct().select("name", bare.alias("bare"), tag.alias("tag"))


@query("SELECT doc_id, length(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) >= 40 AS looks_truncated FROM documents")
def looks_truncated(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", N.looks_truncated(F.col("text")).alias("looks_truncated"))


_PERSON = "concat(p_type, CASE WHEN p_size % 2 = 0 THEN ', ' ELSE ' ' END, p_name, CASE p_size % 3 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' LLC' ELSE '' END)"


def _persons(spark, sf):
    p = T.read(spark, sf, "part")
    end = F.when(F.col("p_size") % 3 == 0, " Jr.").when(F.col("p_size") % 3 == 1, " LLC").otherwise("")
    return p.select(F.concat("p_type", F.when(F.col("p_size") % 2 == 0, ", ").otherwise(" "), "p_name", end).alias("name")).distinct()


_IS_PERSON = "(NOT regexp_matches(name, '(?i)\\b(INC|LLC|CORP|COMPANY|PAC|COMMITTEE|ASSOCIATION|UNION|FUND|TRUST|LP|LLP)\\b') AND regexp_matches(name, '^[A-Za-z''.\\- ]+,\\s*[A-Za-z][A-Za-z''.\\- ]*$'))"


@query(f"WITH n AS (SELECT DISTINCT {_PERSON} AS name FROM part) SELECT name, {_IS_PERSON} AS person, CASE WHEN {_IS_PERSON} THEN concat(regexp_extract(name, '^([^,]+),\\s*(.+)$', 2), ' ', regexp_extract(name, '^([^,]+),\\s*(.+)$', 1)) ELSE name END AS display FROM n")
def looks_like_person(spark, sf):
    c = F.col("name")
    return _persons(spark, sf).select("name", N.looks_like_person(c).alias("person"), N.display_name(c).alias("display"))


_ENDS = "CASE length({0}) % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' of Commerce PAC' ELSE '' END"
_PAIRS = f"""WITH w AS (SELECT DISTINCT p_name AS id, {norm_sql('p_name')} AS n FROM part), g AS (SELECT id, {word_grams_sql('n')} AS g FROM w),
 sim AS (SELECT a.id, b.id AS other, {jaccard_sql('a.g', 'b.g')} AS similarity FROM g a, g b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM sim WHERE similarity >= 0.3),
 p AS (SELECT concat(id, {_ENDS.format('other')}) AS a, concat(other, {_ENDS.format('id')}) AS b FROM r WHERE rank <= 10),
 m AS (SELECT DISTINCT a, b, {norm_sql('a')} AS na, {norm_sql('b')} AS nb FROM p)"""


def _pairs(spark, sf):
    """Each name with the ten most similar ones, with endings that change from pair to pair."""
    n = T.read(spark, sf, "part").select(F.col("p_name").alias("id"), N.normalize_name(F.col("p_name")).alias("n")).distinct()
    short = S.similarity_shortlist(n, n)
    end = lambda c: F.when(F.length(c) % 3 == 0, " Inc.").when(F.length(c) % 3 == 1, " of Commerce PAC").otherwise("")
    return short.select(F.concat("id", end("other")).alias("a"), F.concat("other", end("id")).alias("b")).distinct()


def _scored(pairs: DataFrame) -> DataFrame:
    """a, b, score. What a name's score needs is computed once a name, not once a pair."""
    names = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("x"), N.profile(F.col("a")).alias("p"))
    side = lambda c: names.select(F.col("x").alias(c), F.col("p").alias(f"p{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", F.round(N.score_profiles(F.col("pa"), F.col("pb"))["score"], 9).alias("score"))


_TRI = f"CASE WHEN na = nb THEN 1.0::DOUBLE WHEN na = '' OR nb = '' THEN 0.0::DOUBLE ELSE {jaccard_sql(grams_sql('na'), grams_sql('nb'))} END"
_OVER = f"coalesce(len(list_intersect({tokens_sql('na')}, {tokens_sql('nb')})) / nullif(least(len({tokens_sql('na')}), len({tokens_sql('nb')})), 0), 0.0::DOUBLE)"


@query(_PAIRS + f" SELECT a, b, {_TRI} AS similarity FROM m")
def trigram_app(spark, sf):
    return _pairs(spark, sf).select("a", "b", N.string_similarity(N.normalize_name(F.col("a")), N.normalize_name(F.col("b"))).alias("similarity"))


@query(_PAIRS + f" SELECT a, b, coalesce({jaccard_sql(word_grams_sql('na'), word_grams_sql('nb'))}, 0.0::DOUBLE) AS similarity FROM m")
def trigram_pg(spark, sf):
    return _pairs(spark, sf).select("a", "b", N.word_similarity(N.normalize_name(F.col("a")), N.normalize_name(F.col("b"))).alias("similarity"))


@query(_PAIRS + f" SELECT a, b, {_OVER} AS overlap FROM m")
def token_overlap(spark, sf):
    return _pairs(spark, sf).select("a", "b", N.token_overlap(F.col("a"), F.col("b")).alias("overlap"))


_SCORE = f"""CASE WHEN na = nb THEN 1.0::DOUBLE ELSE least(CASE WHEN {key_sql('na')} = {key_sql('nb')} THEN greatest(0.55::DOUBLE * ({_TRI}) + 0.45::DOUBLE * ({_OVER}), 0.8::DOUBLE)
 ELSE 0.55::DOUBLE * ({_TRI}) + 0.45::DOUBLE * ({_OVER}) END, 0.99::DOUBLE) END"""


@query(_PAIRS + f", s AS (SELECT a, b, round({_SCORE}, 9) AS score FROM m) SELECT a, b, score, CASE WHEN score >= 0.88 THEN 'LINK' WHEN score >= 0.62 THEN 'review' ELSE '-' END AS verdict FROM s")
def score_match(spark, sf):
    return _scored(_pairs(spark, sf)).withColumn("verdict", N.verdict(F.col("score")))


@query(_PAIRS + f", s AS (SELECT a, b, round({_SCORE}, 9) AS score FROM m WHERE a <> b) SELECT a, arg_min(b, (-score, b)) AS best, max(score) AS score FROM s GROUP BY a")
def best_match(spark, sf):
    scored = _scored(_pairs(spark, sf).filter("a <> b"))
    return scored.groupBy("a").agg(F.min_by("b", F.struct(-F.col("score"), F.col("b"))).alias("best"), F.max("score").alias("score"))


_FULL = "concat(p_name, ' ', p_brand, ' ', p_type)"


@query(f"""WITH e AS (SELECT {norm_sql(_FULL)} AS nn, min(p_partkey) AS id FROM part GROUP BY 1), q AS (SELECT DISTINCT {norm_sql("concat(p_name, ' ', p_brand)")} AS n FROM part)
 SELECT n, min(id) AS entity_id FROM q JOIN e ON starts_with(nn, n) WHERE length(n) >= 12 GROUP BY n HAVING count(*) = 1""")
def prefix_resolve(spark, sf):
    p = T.read(spark, sf, "part")
    entities = p.select(N.normalize_name(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("normalized_name"), "p_partkey").groupBy("normalized_name").agg(F.min("p_partkey").alias("id"))
    names = p.select(N.normalize_name(F.concat_ws(" ", "p_name", "p_brand")).alias("n")).distinct()
    return S.prefix_resolve(names, entities)


@query(f"""WITH a AS (SELECT {norm_sql("concat(p_name, ' ', p_brand)")} AS n, concat('P', CAST(p_size AS VARCHAR)) AS entity_id, CAST(p_size / 50.0::DOUBLE AS FLOAT) AS confidence FROM part),
 q AS (SELECT DISTINCT {norm_sql("concat(p_name, ' ', p_brand)")} AS n FROM part)
 SELECT n, arg_min(entity_id, (-confidence, entity_id)) AS entity_id, max(confidence) AS confidence FROM q JOIN a USING (n) GROUP BY n""")
def alias_resolve(spark, sf):
    p = T.read(spark, sf, "part")
    n = N.normalize_name(F.concat_ws(" ", "p_name", "p_brand"))
    aliases = p.select(n.alias("normalized_alias"), F.concat(F.lit("P"), F.col("p_size").cast("string")).alias("entity_id"), (F.col("p_size") / 50.0).cast("float").alias("confidence"))
    return S.alias_resolve(p.select(n.alias("n")).distinct(), aliases)


@query(f"""WITH n AS (SELECT DISTINCT p_name AS id, {norm_sql('p_name')} AS n FROM part), g AS (SELECT id, {word_grams_sql('n')} AS g FROM n),
 s AS (SELECT a.id, b.id AS other, {jaccard_sql('a.g', 'b.g')} AS similarity FROM g a, g b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM s WHERE similarity >= 0.3)
 SELECT id, other, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def similarity_shortlist(spark, sf):
    n = T.read(spark, sf, "part").select(F.col("p_name").alias("id"), N.normalize_name(F.col("p_name")).alias("n")).distinct()
    return S.similarity_shortlist(n, n)


@query(ENT + """ SELECT id, CASE WHEN committee_type IS NULL THEN CASE kind WHEN 'individual' THEN 'Individual' WHEN 'organization' THEN 'Organization' END ELSE
 CASE committee_type WHEN 'PAC' THEN 'Political Committee' WHEN 'CCE' THEN 'Committee of Continuous Existence' WHEN 'ECO' THEN 'Electioneering Comm. Org.' WHEN 'ECI' THEN 'Electioneering Comm. Individual'
 WHEN 'IXO' THEN 'Independent Expenditure Org.' WHEN 'PAP' THEN 'Affiliated Party Committee' ELSE 'Party Executive Committee' END END AS label FROM ent""")
def kind_label(spark, sf):
    return T.parties(spark, sf).select("id", X.kind_label(F.col("kind"), F.col("committee_type")).alias("label"))


def money_sql(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    whole = lambda y: f"CAST(CAST(floor({y} + 0.5) AS BIGINT) AS VARCHAR)"
    return f"""CASE WHEN {x} = 0 THEN '$0' WHEN abs({x}) >= 1e9 THEN format('${{:.1f}}B', {x} / 1e9) WHEN abs({x}) >= 1e7 THEN format('${{:.0f}}M', {x} / 1e6)
 WHEN abs({x}) >= 1e6 THEN format('${{:.1f}}M', {x} / 1e6) WHEN abs({x}) >= 1e3 THEN concat('$', {whole(x + ' / 1e3')}, 'K') ELSE concat('$', {whole(x)}) END"""


@query(ENT + f" SELECT id, {money_sql('total_received')} AS received, {money_sql('total_given')} AS given FROM ent")
def money_format(spark, sf):
    return T.stored_graph(spark, sf).entities.select("id", X.format_money(F.col("total_received")).alias("received"), X.format_money(F.col("total_given")).alias("given"))


@query(ENT + f""" SELECT id, concat_ws(chr(10), name, nullif(array_to_string(list_filter([CASE WHEN total_received > 0 THEN concat('in ', {money_sql('total_received')}) END,
 CASE WHEN total_given > 0 THEN concat('out ', {money_sql('total_given')}) END], lambda p: p IS NOT NULL), ' · '), '')) AS label FROM ent""")
def tile_label(spark, sf):
    return T.stored_graph(spark, sf).entities.select("id", X.tile_label(F.col("name"), F.col("total_received"), F.col("total_given")).alias("label"))


@query("SELECT doc_id, CASE WHEN length(s) <= 38 THEN s ELSE concat(rtrim(left(s, 37)), '…') END AS label FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents)")
def fit_label(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", X.fit_label(F.col("text")).alias("label"))


@query("SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g') AS slug, try_cast(nullif(regexp_extract(html, '\\b(19|20)\\d{2}\\b'), '') AS INTEGER) AS year FROM pages")
def page_slug_year(spark, sf):
    return T.read(spark, sf, "pages").select("page_id", X.slug(F.col("url")).alias("slug"), X.year_of_label(F.col("html")).alias("year"))


@query("""SELECT page_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g'),
 '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '"', 'g'), '(?i)&apos;', '''', 'g'), '(?i)&nbsp;', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS decoded FROM pages""")
def html_decode(spark, sf):
    return T.read(spark, sf, "pages").select("page_id", X.decode_plain(F.col("html")).alias("decoded"))


@query("""WITH d AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN concat(CAST(month(ts) AS VARCHAR), '/', CAST(day(ts) AS VARCHAR), '/', CAST(year(ts) AS VARCHAR)) WHEN 2 THEN '0000-00-00' WHEN 3 THEN '2026-02-30' ELSE event_type END AS raw, ts FROM events)
 SELECT event_id, CASE WHEN event_id % 5 < 2 THEN strftime(ts, '%Y-%m-%d') END AS day FROM d""")
def date_normalize(spark, sf):
    e = T.read(spark, sf, "events")
    m = F.col("event_id") % 5
    us = F.concat_ws("/", F.month("ts").cast("string"), F.dayofmonth("ts").cast("string"), F.year("ts").cast("string"))
    raw = F.when(m == 0, F.date_format("ts", "yyyy-MM-dd")).when(m == 1, us).when(m == 2, "0000-00-00").when(m == 3, "2026-02-30").otherwise(F.col("event_type"))
    return e.select("event_id", X.normalize_date(raw).cast("string").alias("day"))


@query("""WITH h AS (SELECT user_id, event_id, event_type = 'signup' AS mark FROM events)
 SELECT a.event_id, max(b.event_id) AS heading FROM h a LEFT JOIN h b ON a.user_id = b.user_id AND b.mark AND b.event_id < a.event_id WHERE NOT a.mark GROUP BY a.event_id""")
def office_asof(spark, sf):
    """The nearest heading strictly before each row, as office headings bind the links after them."""
    e = T.read(spark, sf, "events").withColumn("mark", F.col("event_type") == "signup")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("heading", F.last(F.when(F.col("mark"), F.col("event_id")), ignorenulls=True).over(w)).filter(~F.col("mark")).select("event_id", "heading")


# --- codes, kinds, labels, and resolution -----------------------------------------------------------------------------

@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'I' THEN 'individual' WHEN 'B' THEN 'business' WHEN 'C' THEN 'committee' WHEN 'P' THEN 'party' WHEN 'O' THEN 'other' WHEN 'S' THEN 'self' ELSE 'unknown' END AS from_flag,
 CASE l_linestatus WHEN 'O' THEN 'other' ELSE 'unknown' END AS from_status, CASE WHEN l_linestatus = 'E' THEN 'expenditure' ELSE 'contribution' END AS flow FROM lineitem""")
def code_maps(spark, sf):
    c = T.read(spark, sf, "lineitem")
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.contributor_kind(F.col("l_returnflag")).alias("from_flag"), X.contributor_kind(F.col("l_linestatus")).alias("from_status"), X.direction(F.col("l_linestatus")).alias("flow"))


@query(f"""WITH n AS (SELECT p_partkey, {_PERSON} AS name, CASE p_size % 5 WHEN 0 THEN 'Retired' WHEN 1 THEN 'self-employed' WHEN 2 THEN NULL ELSE p_type END AS job, CASE p_size % 6 WHEN 0 THEN 'business' WHEN 1 THEN 'self' WHEN 2 THEN 'other' END AS hint FROM part)
 SELECT p_partkey, CASE hint WHEN 'business' THEN 'organization' WHEN 'self' THEN 'individual' END AS hinted,
 CASE WHEN {_IS_PERSON} OR coalesce(regexp_matches(job, '(?i)\\b(RETIRED|HOMEMAKER|ATTORNEY|PHYSICIAN|SELF[- ]EMPLOYED)\\b'), false) THEN 'individual' ELSE 'organization' END AS classified FROM n""")
def entity_kinds(spark, sf):
    p = T.read(spark, sf, "part")
    end = F.when(F.col("p_size") % 3 == 0, " Jr.").when(F.col("p_size") % 3 == 1, " LLC").otherwise("")
    name = F.concat("p_type", F.when(F.col("p_size") % 2 == 0, ", ").otherwise(" "), "p_name", end)
    m5, m6 = F.col("p_size") % 5, F.col("p_size") % 6
    job = F.when(m5 == 0, "Retired").when(m5 == 1, "self-employed").when(m5 == 2, F.lit(None)).otherwise(F.col("p_type"))
    hint = F.when(m6 == 0, "business").when(m6 == 1, "self").when(m6 == 2, "other")
    return p.select("p_partkey", X.kind_from_hint(hint).alias("hinted"), X.classify_contributor(name, job).alias("classified"))


@query("""SELECT c_custkey, concat(CASE WHEN c_acctbal < 0 AND r <> 0 THEN '-' ELSE '' END, '$', format('{:,}', r)) AS full_money
 FROM (SELECT c_custkey, c_acctbal, CAST(round(CAST(abs(c_acctbal) AS DECIMAL(16,2)), 0) AS BIGINT) AS r FROM customer)""")
def money_full(spark, sf):
    return T.read(spark, sf, "customer").select("c_custkey", X.format_money_full(F.col("c_acctbal").cast("decimal(16,2)")).alias("full_money"))


@query("SELECT o_orderkey, concat_ws(' · ', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), nullif(o_orderstatus, ''), nullif(o_orderpriority, '')) AS subtitle, nullif(concat_ws(' ', nullif(o_orderstatus, ''), nullif(o_orderpriority, '')), '') AS address FROM orders")
def txn_subtitle(spark, sf):
    o = T.read(spark, sf, "orders")
    return o.select("o_orderkey", X.transaction_subtitle(F.col("o_orderdate").cast("date"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("")).alias("subtitle"), X.join_address(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("address"))


@query(BASE + " SELECT DISTINCT id FROM (SELECT from_id AS id FROM flow WHERE day >= DATE '2000-01-01' UNION ALL SELECT to_id FROM flow WHERE day >= DATE '2000-01-01')")
def touched_ids(spark, sf):
    return T.flows(spark, sf).filter("day >= DATE '2000-01-01'").select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()


@query("""WITH old AS (SELECT s_suppkey AS k, s_name AS v FROM supplier), new AS (SELECT l_suppkey AS k, max(l_returnflag) AS v FROM lineitem WHERE l_quantity >= 50 GROUP BY ALL)
 SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new""")
def upsert_rows(spark, sf):
    old = T.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    new = T.read(spark, sf, "lineitem").filter("l_quantity >= 50").groupBy(F.col("l_suppkey").alias("k")).agg(F.max("l_returnflag").alias("v"))
    return D.upsert(old, new, ["k"])


@query(_txns_sql(f"from_id = '{_SEED}'"))
def ledger_txns_out(spark, sf):
    rows, sources = _txn_rows(spark, sf)
    out = L.transactions(rows, sources, _SEED, LedgerParams(view="transactions", direction="out"))
    return out.select("id", "counterparty_id", "counterparty_name", *text("amount", "txn_date"), "flow", "txn_type_code", "description", "city", "source_key")


@query(_txns_sql(f"to_id = '{_SEED}' OR from_id = '{_SEED}'") + " WHERE contains(upper(counterparty_name), '0001') ORDER BY CAST(amount AS DECIMAL(16,2)) DESC, id LIMIT 25")
def ledger_txns_page(spark, sf):
    rows, sources = _txn_rows(spark, sf)
    p = LedgerParams(view="transactions", direction="all", q="0001", sort="count", limit=25)
    return L.page(L.transactions(rows, sources, _SEED, p), p).select("id", "counterparty_id", "counterparty_name", *text("amount", "txn_date"), "flow", "txn_type_code", "description", "city", "source_key")


@query("SELECT event_id, event_type = 'error' OR (contains(props, 'Error in /cgi-bin/') OR (regexp_matches(props, '(?i)internal server error') AND length(props) < 4000)) AS bad FROM events")
def error_pages(spark, sf):
    return T.read(spark, sf, "events").select("event_id", ((F.col("event_type") == "error") | X.is_error_page(F.col("props"))).alias("bad"))


@query()
def resolve_batch(spark, sf):
    """All part labels against the catalogued names: exact, alias, prefix, similarity, or a new entity. ``resolve_cascade`` does the same on mentions whose outcome SQL can tell."""
    from ..operators.resolve import resolve_batch as run

    p = T.read(spark, sf, "part")
    full = F.col("p_name")
    entities = p.groupBy(full.alias("name")).agg(F.min("p_partkey").cast("string").alias("id")).select(F.concat(F.lit("P"), "id").alias("id"), "name", N.normalize_name(F.col("name")).alias("normalized_name"), F.lit(None).cast("string").alias("zip"), F.lit(None).cast("string").alias("city"))
    aliases = entities.select(F.col("id").alias("entity_id"), F.concat(F.lit("THE "), "normalized_name").alias("normalized_alias"), F.lit(0.9).alias("confidence"))
    none = F.lit(None).cast("string")
    mentions = p.groupBy(F.concat(full, F.when(F.col("p_size") % 3 == 0, " Inc.").when(F.col("p_size") % 3 == 1, " PAC").otherwise("")).alias("raw")).agg(F.min("p_partkey").alias("place"))
    mentions = mentions.select("place", "raw", F.lit(True).alias("recipient"), none.alias("hint"), none.alias("zip"), none.alias("city"), none.alias("occupation"))
    resolved, _, _ = run(mentions, entities, aliases)
    return resolved.select("place", "n", "entity_id", F.round("confidence", 9).alias("confidence"), "method")
