"""Helpers that the operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from busloom.session import cut_lineage

#: Spark's string of white space in the word patterns: space and the five controls.
SPACE = " \t\n\x0b\x0c\r"
#: Steps in which a share of hashes is measured.
SHARES = 1 << 40


def keep(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: later reads survive lost executors."""
    return cut_lineage(df)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int) -> pd.DataFrame:
    """At most `rows` rows picked by the hash of the key, the same in every run.

    A share of the hashes that leaves about twice as many goes on, so that what tasks send for the final pick doesn't grow with them.
    """
    total, h = df.count(), F.xxhash64(F.col(key))
    if total > 2 * rows:
        df = df.where(F.pmod(h, F.lit(SHARES)) < F.lit(-(-SHARES * 2 * rows // total)))
    return df.orderBy(h, F.col(key)).limit(rows).toPandas()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def unsigned_crc32(text: str) -> int:
    return zlib.crc32(utf8(text))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = 512, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a slice holds few rows and few bytes of text."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        start, held = 0, 0
        for at in range(batch.num_rows):
            if at > start and (at - start >= rows or held + size[at] > chars):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size[at]
        if batch.num_rows > start:
            yield batch.slice(start)


def over_texts(df: DataFrame, fn: Callable[[list[str]], dict], fields: str, carry: tuple[str, ...] = ("doc_id",), text: str = "text", chars: int = 2_000_000) -> DataFrame:
    """The carried columns as they are, and fields that fn makes from each text (null: empty), slice by slice."""
    out = StructType([df.schema[c] for c in carry] + StructType.fromDDL(fields).fields)
    kinds = to_arrow_schema(out)

    def run(batches):
        for part in slices(batches, text, chars=chars):
            made = fn(["" if x is None else x for x in part.column(text).to_pylist()])
            columns = [part.column(c).cast(kinds.field(c).type) if c in carry else pa.array(made[c], type=kinds.field(c).type) for c in kinds.names]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return df.select(*carry, *([text] if text not in carry else [])).mapInArrow(run, out)


def filter_texts(df: DataFrame, fn: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """The rows for whose text fn says True, with all columns."""

    def run(batches):
        for part in slices(batches, text):
            yield part.filter(pa.array(fn(["" if x is None else x for x in part.column(text).to_pylist()]), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def rewrite_texts(df: DataFrame, fn: Callable[[list[str]], list[str]], text: str = "text") -> DataFrame:
    """All columns, each text replaced by what fn makes of it; null stays null."""

    def run(batches):
        for part in slices(batches, text):
            given = part.column(text).to_pylist()
            made = fn(["" if x is None else x for x in given])
            at = part.schema.get_field_index(text)
            yield part.set_column(at, part.schema.field(at), pa.array([None if x is None else y for x, y in zip(given, made)], part.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
