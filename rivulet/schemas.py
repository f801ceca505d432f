"""Tables of a money-flow graph, as Spark DDL, and the values their code columns may hold."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What code columns hold.
LEVELS = ["federal", "state", "county", "municipal", "special_district"]
KINDS = ["committee", "candidate", "individual", "organization", "party", "unknown"]
COMMITTEE_TYPES = ["PAC", "CCE", "ECO", "ECI", "IXO", "PAP", "PTY"]
STATUSES = ["active", "closed", "unknown"]
ALIAS_ORIGINS = ["registry", "observed", "resolved", "manual"]
DIRECTIONS = ["contribution", "expenditure"]
RUN_STATUSES = ["running", "succeeded", "failed", "partial"]

RAW_TRANSACTION = """filer_raw string, filer_truncated boolean, filer_type_tag string, filer_office string, filer_party string,
 filer_is_committee boolean, counterparty_raw string, counterparty_kind string, direction string, amount decimal(16,2), date date,
 type_code string, description string, address string, city string, state string, zip string, occupation string, row_hash string"""
JURISDICTIONS = "id string, code string, name string, level string, state string, parent_id string, created_at timestamp"
SOURCES = "id string, key string, name string, url string, jurisdiction_id string, last_run_at timestamp, notes string"
ENTITIES = """id string, kind string, name string, normalized_name string, committee_type string, status string, jurisdiction_id string,
 office string, district string, party string, address string, city string, state_code string, zip string, occupation string,
 is_traversable boolean, source_id string, source_ref string, total_received decimal(16,2), total_given decimal(16,2),
 in_degree int, out_degree int, first_seen date, last_seen date, created_at timestamp, updated_at timestamp"""
ALIASES = "id string, entity_id string, alias string, normalized_alias string, origin string, confidence float, is_truncated boolean, created_at timestamp"
TRANSACTIONS = """id string, from_entity_id string, to_entity_id string, raw_from_name string, raw_to_name string, amount decimal(16,2),
 txn_date date, direction string, txn_type_code string, inkind_description string, election_cycle string, from_address string,
 from_city string, from_state string, from_zip string, from_occupation string, source_id string, source_row_hash string,
 from_confidence float, to_confidence float, ingested_at timestamp"""
EDGES = """id string, from_entity_id string, to_entity_id string, total_amount decimal(16,2), txn_count int, first_date date,
 last_date date, is_direct_link boolean, updated_at timestamp"""
SAVED = """id string, name string, description string, seed_entity_id string,
 params struct<depth:int,direction:string,link_mode:string,min_amount:double,date_from:string,date_to:string,max_per_node:int,max_nodes:int>,
 node_positions map<string,struct<x:double,y:double>>, created_at timestamp, updated_at timestamp"""
RUNS = "id string, source_id string, status string, scope string, rows_fetched int, rows_inserted int, rows_skipped int, error string, started_at timestamp, finished_at timestamp"


def digest_id(*parts: Column) -> Column:
    """A reproducible id: 32 hex digits of the parts, null as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of a table, absent ones null."""
    from pyspark.sql.types import StructType

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)])
