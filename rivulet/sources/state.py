"""State filings: tab-separated contributions and the committee registry.

The columns are our own choice: recipient, contributor, amount, date, type, inkind, address, city, state, zip, occupation for
contributions, and name, type, status for the registry. They are bound by header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.names import looks_truncated, split_type_tag
from ..operators.load import first_by

# Match modes, sort orders and the row ceiling.
MATCH = ("containing", "starts_with", "sounds_like")
SORTS = {"AMT": ("amount", True), "DAT": ("date", True), "NAM": ("counterparty_raw", False), "CAN": ("filer_raw", False)}
ROW_CEILING, ROWS = 99_999, 5_000


def name_match(c: Column, needle: str, mode: str = "containing") -> Column:
    if mode not in MATCH:
        raise ValueError(f"match is one of {', '.join(MATCH)}")
    c, n = F.upper(c), F.upper(F.lit(needle))
    return {"containing": F.contains(c, n), "starts_with": F.startswith(c, n), "sounds_like": F.soundex(c) == F.soundex(n)}[mode]


def read_contributions(spark: SparkSession, path: str) -> DataFrame:
    """Canonical rows, all contributions. Rows whose amount is no number have a null amount."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", enforceSchema=False)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    c = lambda name: F.col(name) if name in raw.columns else F.lit(None).cast("string")
    bare, tag = split_type_tag(c("recipient"))
    day = X.normalize_date(c("date"))
    return raw.select(
        bare.alias("filer_raw"), looks_truncated(c("recipient")).alias("filer_truncated"), tag.alias("filer_type_tag"), F.lit(None).cast("string").alias("filer_office"), F.lit(None).cast("string").alias("filer_party"),
        tag.isNotNull().alias("filer_is_committee"), X.strip(c("contributor")).alias("counterparty_raw"), F.lit("unknown").alias("counterparty_kind"), F.lit("contribution").alias("direction"), X.clean_amount(c("amount")).alias("amount"),
        day.alias("date"), X.blank_to_null(c("type")).alias("type_code"), X.blank_to_null(c("inkind")).alias("description"), X.blank_to_null(c("address")).alias("address"), X.blank_to_null(c("city")).alias("city"),
        X.blank_to_null(c("state")).alias("state"), X.blank_to_null(c("zip")).alias("zip"), X.blank_to_null(c("occupation")).alias("occupation"),
        X.row_hash(c("recipient"), c("contributor"), day, c("amount"), c("type"), c("address")).alias("row_hash"),
    )


def contributions(rows: DataFrame, recipient: str | None = None, contributor: str | None = None, match: str = "containing", date_from: str | None = None, date_to: str | None = None, min_amount: float | None = None, sort: str = "AMT", row_limit: int = ROWS) -> DataFrame:
    """Into a committee or candidate (``recipient``) or out of a ``contributor``: filtered, sorted, and cut at the row limit."""
    for needle, column in ((recipient, "filer_raw"), (contributor, "counterparty_raw")):
        if needle is not None:
            rows = rows.filter(name_match(F.col(column), needle, match))
    if date_from is not None:
        rows = rows.filter(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        rows = rows.filter(F.col("date") <= F.lit(date_to).cast("date"))
    if min_amount is not None:
        rows = rows.filter(F.col("amount") >= F.lit(min_amount))
    column, down = SORTS[sort]
    return rows.orderBy(F.desc_nulls_last(column) if down else F.asc_nulls_last(column), "counterparty_raw", "row_hash").limit(min(row_limit, ROW_CEILING))


def contribution_totals(rows: DataFrame) -> DataFrame:
    """The totals search: one row a contributor."""
    return rows.groupBy("counterparty_raw").agg(F.sum("amount").cast("decimal(16,2)").alias("amount"), F.count("*").cast("int").alias("n"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """name, type, status of each committee, the active one where a name is there twice."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", enforceSchema=False)
    rows = raw.select("name", F.upper("type").alias("type"), F.lower("status").alias("status"), F.struct("_metadata.file_path", F.monotonically_increasing_id()).alias("pos"))
    return first_by(rows, ["name"], [F.when(F.col("status") == "active", 0).otherwise(1), "pos"]).drop("pos")


def committees_by_prefix(registry: DataFrame, prefix: str) -> DataFrame:
    return registry.filter(F.startswith(F.upper("name"), F.upper(F.lit(prefix))))
