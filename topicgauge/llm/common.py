"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are handed on to Spark once they hold about this many bytes.
BATCH_BYTES = 2 << 20
#: Bytes and rows of the batches in which Spark hands long texts to Python: they are held on both sides.
ARROW_BYTES, ARROW_ROWS = 8 << 20, 1000
LETTERS_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS_LOW = LETTERS_UP.lower()


def hand_over_in_small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to what texts need; lower limits stay, and no result depends on them."""
    for name, limit in (("maxBytesPerBatch", ARROW_BYTES), ("maxRecordsPerBatch", ARROW_ROWS)):
        setting = f"spark.sql.execution.arrow.{name}"
        number, unit = re.match(r"(-?\d+)\s*([a-z]?)", spark.conf.get(setting).lower()).groups()
        now = int(number) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(unit, 1)
        if now <= 0 or now > limit:
            spark.conf.set(setting, str(limit))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    hand_over_in_small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, LETTERS_UP, LETTERS_LOW)


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_schema(fields: str) -> pa.Schema:
    """``"doc_id long, text binary"`` as an Arrow schema."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
        "boolean": pa.bool_(),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(","))])


class Rows:
    """Collects rows and hands them on in batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = BATCH_BYTES):
        self.schema, self.limit = schema, limit
        self.columns: list[list] = [[] for _ in schema]
        self.bytes = 0

    def add(self, values: Sequence, size: int = 0) -> Iterator[pa.RecordBatch]:
        for column, value in zip(self.columns, values):
            column.append(value)
        self.bytes += size + 64
        if self.bytes >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema
            )
        self.columns = [[] for _ in self.schema]
        self.bytes = 0


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, strings and binaries as bytes, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            columns = [
                (c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in part.columns
            ]
            yield from zip(*columns)


def grouped(rows: Iterable[tuple], key_width: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first columns; the rows come sorted by them."""
    key, run = None, []
    for row in rows:
        if row[:key_width] != key:
            if run:
                yield key, run
            key, run = row[:key_width], []
        run.append(row)
    if run:
        yield key, run
