"""What the operators of this subpackage share: column picking, row iteration, written tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regrove.session import let_workers_import, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes to bytes: A-Z to a-z. UTF-8 keeps every other character clear of these bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Rows that a Python worker holds as objects at a time, so long texts don't add up.
STEP = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Those columns alone, found by their exact names: no extra column can clash with them or with later ones."""
    let_workers_import(df.sparkSession)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(c)}").alias(c) for c in columns])


def blocks(batches: Iterator[pa.RecordBatch], step: int = STEP) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words `[^\\x20\\x09-\\x0D]+` as UTF-8; none for null. `bytes.split` parts at exactly those six bytes."""
    return text.encode().translate(LOWER_BYTES).split() if text else []


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    let_workers_import(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of(column: str) -> Column:
    """crc32 of an id as text; that of the empty text for null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def lower_sql(column: str) -> str:
    """DuckDB: A-Z to a-z and nothing else."""
    return f"translate({column}, '{UPPER}', '{LOWER}')"
