"""Queries over file sources: exports, pages and registries are written from the tables into the shared folder and read by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..operators import load as D
from ..sources import county, state
from . import fixtures as T
from .catalog import norm_sql, query, text
from .store import work_folder

# Cells as both engines write them: markup, odd dates and amounts, blanks, and every contributor code.
_CELLS = {
    "rpt": "concat('Q', CAST(c_custkey % 4 + 1 AS STRING))",
    "line": "CAST(c_custkey AS STRING)",
    "day": "CASE c_custkey % 4 WHEN 0 THEN '2020-02-03' WHEN 1 THEN concat(CAST(c_custkey % 12 + 1 AS STRING), '/', CAST(c_custkey % 28 + 1 AS STRING), '/2021') WHEN 2 THEN '0000-00-00' ELSE '2026-02-30' END",
    "flow": "CASE c_custkey % 5 WHEN 0 THEN 'E' WHEN 1 THEN 'e ' WHEN 2 THEN 'X' ELSE 'C' END",
    "name": "CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('Doe, ', c_name) WHEN 2 THEN concat('Print &#34;', c_name, '&#x22; &amp; Co') WHEN 3 THEN concat(' ', c_name, ' O&#39;Neil<br>Sons ') ELSE c_name END",
    "address1": "concat(CAST(c_custkey AS STRING), ' Main &amp; 1st')",
    "address2": "CASE WHEN c_custkey % 2 = 0 THEN 'Apt \"B\"' ELSE '' END",
    "city": "CASE c_custkey % 3 WHEN 0 THEN 'St. John&#39;s' WHEN 1 THEN '' ELSE c_mktsegment END",
    "state": "'FL'",
    "zip": "CAST(33000 + c_custkey % 900 AS STRING)",
    "type": "substring('IBCPOSX', CAST(c_custkey % 7 + 1 AS INT), 1)",
    "job": "CASE c_custkey % 2 WHEN 0 THEN 'R&amp;D' ELSE '' END",
    "item": "'CH'",
    "amount": "CASE c_custkey % 7 WHEN 0 THEN '12a' WHEN 1 THEN concat('$', CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING)) WHEN 2 THEN concat('1,', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '.5') WHEN 3 THEN '-12.345' ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) END",
    "note": "CASE c_custkey % 9 WHEN 0 THEN '' ELSE concat('note ', c_mktsegment) END",
}
_HEADER = '"Rpt Code","LINE NUMBER",Item Date,"Cont/Exp",Name,"Address 1","Address 2",City,State,Zip,"Cont. Type",Occupation,"Item Type",Amount,Description'
_COUNTY = "clay"


def _export_files(spark: SparkSession, sf: str, broken: int = 0) -> str:
    """One export a nation, in a folder ``file=N<key>`` each. Every ``broken``-th lacks a column that it must have."""
    quoted = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in list(_CELLS)[:-1]])
    cells = T.read(spark, sf, "customer").selectExpr("c_nationkey AS nation", "c_custkey AS k", *[f"{x} AS {c}" for c, x in _CELLS.items()])
    # A row without a note ends early, as short rows do.
    lines = cells.select("nation", "k", F.concat(quoted, F.when(F.col("note") != "", F.concat(F.lit(","), F.col("note"))).otherwise("")).alias("line"))
    body = lines.groupBy("nation").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("rows"))  # a nation's file is one row, as it is read
    end = F.when(F.col("nation") % 2 == 0, "\r\n").otherwise("\r")
    header = F.when(F.col("nation") % F.lit(broken) == 0, _HEADER.replace(",Amount,", ",Sum,")).otherwise(_HEADER) if broken else F.lit(_HEADER)
    joined = F.aggregate(F.col("rows.line"), F.concat(F.lit("﻿"), header, end), lambda a, x: F.concat(a, end, x))
    path = f"{work_folder(spark)}/exports-{broken}-{abs(hash(sf))}"
    body.select(F.concat(F.lit("N"), F.col("nation").cast("string")).alias("file"), joined.alias("value")).write.mode("overwrite").partitionBy("file").text(path)
    return path


def _filers(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return T.read(spark, sf, "nation").select(
        F.concat(F.lit("file=N"), n.cast("string")).alias("file"), F.concat(F.lit("Friends of the People of "), "n_name", F.when(n % 3 == 0, " and Neighbours").otherwise("")).alias("filer_raw"),
        F.when(n % 2 == 0, "Mayor").alias("filer_office"), F.when(n % 2 == 0, "REP").alias("filer_party"), (n % 2 == 1).alias("filer_is_committee"),
    )


def _decoded(c: str) -> str:
    for a, b in (("<br>", " "), ("&#34;", '"'), ("&#x22;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


_PLAIN = "trim(regexp_replace(amount, '[$,]', '', 'g'))"
_EXPORT = f"""WITH cells AS (SELECT c_nationkey AS nation, c_custkey AS k, {', '.join(f'{x} AS {c}' for c, x in _CELLS.items())} FROM customer),
 d AS (SELECT nation, k, rpt, line, trim(flow) AS flow, {_decoded('name')} AS name, {_decoded('address1')} AS address1, address2, {_decoded('city')} AS city, state, zip, type, {_decoded('job')} AS job, item, amount, note,
  CASE k % 4 WHEN 0 THEN DATE '2020-02-03' WHEN 1 THEN make_date(2021, CAST(k % 12 + 1 AS INTEGER), CAST(k % 28 + 1 AS INTEGER)) END AS day,
  concat('Friends of the People of ', n_name, CASE WHEN nation % 3 = 0 THEN ' and Neighbours' ELSE '' END) AS filer_raw, row_number() OVER (PARTITION BY nation ORDER BY k) - 1 AS place
  FROM cells JOIN nation ON n_nationkey = nation),
 e AS (SELECT *, CASE WHEN upper(flow) = 'E' THEN 'expenditure' ELSE 'contribution' END AS direction, CASE WHEN amount <> '12a' THEN CAST({_PLAIN} AS DECIMAL(16,2)) END AS money FROM d),
 rows AS (SELECT nation, place, filer_raw, length(filer_raw) >= 40 AS filer_truncated, CASE WHEN nation % 2 = 0 THEN 'Mayor' END AS filer_office, CASE WHEN nation % 2 = 0 THEN 'REP' END AS filer_party, nation % 2 = 1 AS filer_is_committee,
  name AS counterparty_raw, CASE type WHEN 'I' THEN 'individual' WHEN 'B' THEN 'business' WHEN 'C' THEN 'committee' WHEN 'P' THEN 'party' WHEN 'O' THEN 'other' WHEN 'S' THEN 'self' ELSE 'unknown' END AS counterparty_kind,
  direction, CAST(money AS VARCHAR) AS amount, CAST(day AS VARCHAR) AS date, item AS type_code, nullif(note, '') AS description, concat_ws(' ', address1, nullif(address2, '')) AS address, nullif(city, '') AS city, state, zip, nullif(job, '') AS occupation,
  substring(sha256(concat_ws('|', '{_COUNTY}', filer_raw, rpt, line, coalesce(CAST(day AS VARCHAR), ''), direction, name, {_PLAIN}, item)), 1, 32) AS row_hash FROM e)"""
_GOOD = "counterparty_raw <> '' AND amount IS NOT NULL"
_ROW = "filer_raw, filer_truncated, filer_office, filer_party, filer_is_committee, counterparty_raw, counterparty_kind, direction, amount, date, type_code, description, address, city, state, zip, occupation, row_hash"


@query(_EXPORT + f" SELECT {_ROW} FROM rows WHERE {_GOOD}")
def county_export(spark, sf):
    """Exports with byte order marks, quotes, markup in every cell, lone carriage returns, blank lines and short rows."""
    good, _ = county.read_exports(spark, _export_files(spark, sf), _filers(spark, sf), _COUNTY)
    return good.withColumns({c: F.col(c).cast("string") for c in ("amount", "date")}).select(*_ROW.split(", "))


@query(_EXPORT + f" SELECT filer_raw, place AS line, counterparty_raw, CASE WHEN counterparty_raw = '' THEN 'name' ELSE 'amount' END AS reason FROM rows WHERE NOT ({_GOOD})")
def county_export_rejects(spark, sf):
    _, bad = county.read_exports(spark, _export_files(spark, sf), _filers(spark, sf), _COUNTY)
    return bad.select("filer_raw", "line", "counterparty_raw", "reason")


_SWEEP = _EXPORT + f""", r AS (SELECT 'file=N' || nation AS scope, nation % 5 = 0 AS broken, count(*) AS n, count(*) FILTER (WHERE {_GOOD}) AS good, count(DISTINCT row_hash) FILTER (WHERE {_GOOD}) AS inserted FROM rows GROUP BY nation)"""


def _sweep(spark, sf):
    path, filers = _export_files(spark, sf, broken=5), _filers(spark, sf)
    return county.sweep(spark, path, filers, _COUNTY)


@query(_SWEEP + """ SELECT scope, CASE WHEN broken THEN 'failed' ELSE 'succeeded' END AS status, CAST(CASE WHEN broken THEN 0 ELSE n END AS INTEGER) AS rows_fetched, CAST(CASE WHEN broken THEN 0 ELSE inserted END AS INTEGER) AS rows_inserted,
 CAST(CASE WHEN broken THEN 0 ELSE n - inserted END AS INTEGER) AS rows_skipped, CASE WHEN broken THEN 'no column amount' END AS error, true AS in_order FROM r""")
def county_sweep(spark, sf):
    """A run record a filer: files that can't be read fail alone, all others are loaded."""
    _, runs = _sweep(spark, sf)
    records = D.run_records(runs, _COUNTY, F.current_timestamp())
    return records.select("scope", "status", "rows_fetched", "rows_inserted", "rows_skipped", "error", (F.col("started_at") <= F.col("finished_at")).alias("in_order"))


_NAMES = norm_sql("counterparty_raw")


@query(_SWEEP + f""" SELECT CAST((SELECT count(*) FROM r WHERE NOT broken AND good > 0) AS BIGINT) AS filers_with_data, CAST((SELECT sum(n) FROM r WHERE NOT broken) AS BIGINT) AS rows_fetched, CAST((SELECT sum(inserted) FROM r WHERE NOT broken) AS BIGINT) AS rows_inserted,
 (SELECT count(*) FROM (SELECT DISTINCT {_NAMES} FROM rows WHERE nation % 5 <> 0 AND {_GOOD})) AS created""")
def county_sweep_totals(spark, sf):
    rows, runs = _sweep(spark, sf)
    sums = runs.agg(F.count_if(F.col("rows_inserted") > 0).alias("filers_with_data"), F.sum("rows_fetched").alias("rows_fetched"), F.sum("rows_inserted").alias("rows_inserted"))
    return sums.join(rows.agg(F.count_distinct(N.normalize_name(F.col("counterparty_raw"))).alias("created")))  # one row each


# --- pages ------------------------------------------------------------------------------------------------------------

_OPTION = "concat('<option value=\"', CAST(n_nationkey AS STRING), '\">', CAST(2000 + n_nationkey AS STRING), ' ', n_name, ' &amp; General', CASE WHEN n_nationkey % 2 = 0 THEN ' ' ELSE '<br>' END, '</option>')"


def _written_pages(spark: SparkSession, rows: DataFrame, name: str, sf: str) -> DataFrame:
    """``rows``: file, value. Stored one page a folder and read back, error pages left out."""
    path = f"{work_folder(spark)}/{name}-{abs(hash(sf))}"
    rows.write.mode("overwrite").partitionBy("file").text(path)
    return county.read_pages(spark, path).withColumn("path", F.regexp_extract("path", "file=([^/]*)/", 1))


@query("SELECT concat('R', CAST(n_regionkey AS VARCHAR)) AS path, CAST(n_nationkey AS VARCHAR) AS id, concat(CAST(2000 + n_nationkey AS VARCHAR), ' ', n_name, ' & General') AS label, CAST(2000 + n_nationkey AS INTEGER) AS year FROM nation WHERE n_regionkey <> 4")
def county_elections(spark, sf):
    """A page a region with its nations as elections; one page is an error page, and another list must not be read."""
    rows = T.read(spark, sf, "nation").selectExpr("n_regionkey", f"{_OPTION} AS option").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("option")), "").alias("options"))
    page = F.concat(F.lit("<html><select name='year'><option value='1'>2020</option></select><SELECT id=x name=\"el\">"), "options", F.lit("</select>"), F.when(F.col("n_regionkey") == 4, "Internal Server Error").otherwise(""))
    return county.elections(_written_pages(spark, rows.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("file"), page.alias("value")), "elections", sf))


_LINK = "concat(CASE WHEN s_suppkey % 4 = 0 THEN concat('<h3>Office: Seat &amp; ', CAST(s_suppkey AS STRING), '</h3>') ELSE '' END, '<a class=x href=\"candidate_pr.php?c=1&amp;ca=', CAST(s_suppkey AS STRING), '&amp;committee=', CASE WHEN s_suppkey % 3 = 0 THEN 'Y' ELSE 'N' END, '\"><div role=\"gridcell\">', s_name, CASE s_suppkey % 3 WHEN 1 THEN ' (REP)' WHEN 2 THEN ' (N/P) ' ELSE '' END, '</div><div>(', CASE WHEN s_suppkey % 2 = 0 THEN 'Active-Qualified' ELSE ' Inactive - Lost ' END, ')</div></a>')"


@query("""WITH s AS (SELECT *, max(CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS heading FROM supplier)
 SELECT concat('N', CAST(s_nationkey AS VARCHAR)) AS path, CAST(s_suppkey AS VARCHAR) AS cand_id, s_name AS name, s_suppkey % 3 = 0 AS is_committee, CASE WHEN s_suppkey % 3 <> 0 AND heading IS NOT NULL THEN concat('Seat & ', CAST(heading AS VARCHAR)) END AS office,
 CASE s_suppkey % 3 WHEN 1 THEN 'REP' WHEN 2 THEN 'N/P' END AS party, CASE WHEN s_suppkey % 2 = 0 THEN 'Active-Qualified' ELSE 'Inactive - Lost' END AS status FROM s""")
def county_entity_index(spark, sf):
    """A page a nation: suppliers as links under office headings, each link there twice."""
    rows = T.read(spark, sf, "supplier").selectExpr("s_nationkey", "s_suppkey AS k", f"{_LINK} AS link").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("k", "link"))).alias("links"))
    page = F.concat(F.lit("<html><a href='other.php?ca=9&committee=N'>Skip</a>"), F.array_join(F.col("links.link"), "\n"), F.array_join(F.col("links.link"), " "))
    return county.entity_index(_written_pages(spark, rows.select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("file"), page.alias("value")), "index", sf))


_COUNTIES = ", ".join(f"('{s}', '{n}', '{c}')" for s, n, c in county.COUNTIES)


@query(f"""WITH c(slug, name, code) AS (VALUES {_COUNTIES}), asked AS (SELECT DISTINCT n_nationkey, c.name AS asked FROM nation JOIN c ON c.slug = ['orange', 'lee', 'stjohns', 'miamidade', 'none'][n_nationkey % 5 + 1])
 SELECT n_nationkey, concat(upper(asked), CASE WHEN n_nationkey % 2 = 0 THEN '!' ELSE ' 1' END) AS asked, slug, name, code FROM asked JOIN c ON c.name = asked""")
def county_lookup(spark, sf):
    """Counties by any spelling of their letters."""
    k = F.col("n_nationkey")
    spelled = F.element_at(F.array(*map(F.lit, ["ORANGE", "LEE", "ST. JOHNS", "MIAMI-DADE", "NOWHERE"])), (k % 5 + 1).cast("int"))
    asked = T.read(spark, sf, "nation").select("n_nationkey", F.concat(spelled, F.when(k % 2 == 0, "!").otherwise(" 1")).alias("asked"))
    return asked.join(F.broadcast(county.counties(spark)), F.col("slug") == X.county_slug(F.col("asked")))


# --- state files ------------------------------------------------------------------------------------------------------

_STATE = {
    "recipient": "concat('Friends of ', CAST(o_custkey % 40 AS STRING), ' Fund', CASE o_custkey % 3 WHEN 0 THEN ' (PAC)' WHEN 1 THEN ' (cce)' ELSE '' END)",
    "contributor": "concat('Donor ', CAST(o_custkey AS STRING))",
    "amount": "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)",
    "date": "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    "type": "'CHE'",
    "address": "concat(CAST(o_orderkey AS STRING), ' Main')",
    "zip": "CAST(33000 + o_custkey % 900 AS STRING)",
    "occupation": "CASE WHEN o_custkey % 2 = 0 THEN 'Baker' ELSE '' END",
}
_TSV = f"""WITH f AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _STATE.items())} FROM orders),
 rows AS (SELECT regexp_replace(recipient, '\\s*\\((PAC|cce)\\)$', '') AS filer_raw, upper(nullif(regexp_extract(recipient, '\\((PAC|cce)\\)$', 1), '')) AS filer_type_tag, contributor AS counterparty_raw, CAST(amount AS DECIMAL(16,2)) AS amount, CAST(nullif(date, '') AS DATE) AS date,
 type AS type_code, address, zip, nullif(occupation, '') AS occupation, substring(sha256(concat_ws('|', recipient, contributor, date, amount, type, address)), 1, 32) AS row_hash FROM f)"""
_TSV_OUT = " filer_raw, filer_type_tag, counterparty_raw, CAST(amount AS VARCHAR) AS amount, CAST(date AS VARCHAR) AS date, type_code, address, zip, occupation, row_hash"


def _contributions(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_folder(spark)}/contributions-{abs(hash(sf))}"
    T.read(spark, sf, "orders").selectExpr(*[f"{x} AS {c}" for c, x in _STATE.items()]).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")
    return state.read_contributions(spark, path)


def _state_out(rows: DataFrame) -> DataFrame:
    return rows.select("filer_raw", "filer_type_tag", "counterparty_raw", *text("amount", "date"), "type_code", "address", "zip", "occupation", "row_hash")


def _state_query(name: str, where: str, order: str, limit: int, **asked) -> None:
    def run(spark, sf):
        return _state_out(state.contributions(_contributions(spark, sf), row_limit=limit, **asked))

    run.__name__ = name
    query(_TSV + f" SELECT {_TSV_OUT} FROM rows WHERE {where} ORDER BY {order}, counterparty_raw, row_hash LIMIT {limit}")(run)


_state_query("state_into_committee", "starts_with(upper(filer_raw), 'FRIENDS OF 1')", "rows.amount DESC", 200, recipient="friends of 1", match="starts_with")
_state_query("state_into_candidate", "filer_raw = 'Friends of 8 Fund' OR filer_raw LIKE '%8 Fund'", "rows.date DESC NULLS LAST", 50, recipient="8 fund", sort="DAT")
_state_query("state_out_of_contributor", "contains(upper(counterparty_raw), 'DONOR 12') AND rows.date >= DATE '1996-01-01' AND rows.date <= DATE '1997-12-31' AND rows.amount >= 1000", "filer_raw", 100, contributor="donor 12", sort="CAN", date_from="1996-01-01", date_to="1997-12-31", min_amount=1000)
_state_query("state_by_name", "starts_with(upper(counterparty_raw), 'DONOR 9')", "counterparty_raw", 99_999, contributor="Donor 9", match="starts_with", sort="NAM")


@query(_TSV + " SELECT counterparty_raw, CAST(CAST(sum(amount) AS DECIMAL(16,2)) AS VARCHAR) AS amount, CAST(count(*) AS INTEGER) AS n FROM rows GROUP BY counterparty_raw")
def state_totals(spark, sf):
    return state.contribution_totals(_contributions(spark, sf)).select("counterparty_raw", *text("amount"), "n")


_REGISTRY = {"name": "concat('Fund ', CAST(s_suppkey % 60 AS STRING), ' of ', CAST(s_nationkey AS STRING))", "type": "concat('pa', CASE WHEN s_suppkey % 2 = 0 THEN 'c' ELSE 'p' END)", "status": "CASE WHEN s_acctbal < 3000 THEN 'Active' ELSE 'Closed' END"}


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    """Every name at most once a status and type, so that the best of a name doesn't depend on the order of files."""
    path = f"{work_folder(spark)}/registry-{abs(hash(sf))}"
    rows = T.read(spark, sf, "supplier").selectExpr(*[f"{x} AS {c}" for c, x in _REGISTRY.items()])
    rows.groupBy("name", "status").agg(F.min("type").alias("type")).select("name", "type", "status").write.mode("overwrite").csv(path, sep="\t", header=True, quote="")
    return state.read_registry(spark, path)


_BEST = f"""WITH f AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _REGISTRY.items())} FROM supplier), g AS (SELECT name, status, min(type) AS type FROM f GROUP BY ALL),
 best AS (SELECT name, upper(arg_min(type, status <> 'Active')) AS type, lower(arg_min(status, status <> 'Active')) AS status FROM g GROUP BY name)"""


@query(_BEST + " SELECT * FROM best")
def registry_sweep(spark, sf):
    return _registry(spark, sf).select("name", "type", "status")


@query(_BEST + " SELECT * FROM best WHERE starts_with(upper(name), 'FUND 1')")
def registry_prefix(spark, sf):
    return state.committees_by_prefix(_registry(spark, sf), "fund 1").select("name", "type", "status")


@query(f"SELECT p_partkey, trim(concat('ABC FI ', {norm_sql('p_name')}, ' 5 IJ')) AS n FROM part")
def name_compatibility(spark, sf):
    """Full-width letters, ligatures and other variants come to the same normal form as plain ones."""
    return T.read(spark, sf, "part").select("p_partkey", N.normalize_name(F.concat(F.lit("ＡＢＣ ﬁ "), "p_name", F.lit(" ⁵ ĳ"))).alias("n"))


_CODES = "CASE event_id % 6 WHEN 0 THEN 9 WHEN 1 THEN 1114112 + event_id WHEN 2 THEN 55296 ELSE 33 + event_id % 90 END"


@query(f"""WITH c AS (SELECT event_id, CAST({_CODES} AS INTEGER) AS code FROM events WHERE event_id >= 0)
 SELECT event_id, trim(regexp_replace(concat('a', CASE WHEN code < 32 OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN ' ' ELSE chr(code) END, 'b<&nope;'), '\\s+', ' ', 'g')) AS decoded FROM c""")
def numeric_entities(spark, sf):
    """Numbers as characters where they are any, else as blanks, by decimal and by hexadecimal."""
    code = F.expr(_CODES)
    written = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("&#"), code.cast("string"), F.lit(";"))).otherwise(F.concat(F.lit("&#x"), F.lower(F.hex(code.cast("long"))), F.lit(";")))
    return T.read(spark, sf, "events").select("event_id", X.decode_markup(F.concat(F.lit("<b>a"), written, F.lit("b</b>&lt;&nope;"))).alias("decoded"))
