"""What the operators share: the shared work folder, whole-text columns and ASCII folding."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import cut

UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Lower-cases A-Z and nothing else; UTF-8 continuation bytes are untouched.
FOLD = bytes.maketrans(UPPER, UPPER.lower())


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it again; ``release`` deletes it.

    Every reader sees the same rows, also after an executor was lost, and nothing upstream runs twice.
    """
    return cut(df, name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    return [next(x for k in count() if (x := n + "_" * k).lower() not in taken) for n in names]


def shielded(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``own`` under names that clash with nothing, and what brings their names back (and drops others)."""
    names = docs.columns
    inner = [c if c in own else f"_kept_{i}" for i, c in enumerate(names)]
    return docs.toDF(*inner), lambda df: df.select(inner).toDF(*names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def whole_text(name: str = "text"):
    """The text with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_sql(column: str) -> str:
    """DuckDB: A-Z lower-cased, nothing else."""
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
