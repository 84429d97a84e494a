"""What the operators share: the shared folder, written tables, row keys and word splitting.

Words are split on the UTF-8 bytes: a byte of 0x80 or more only occurs inside a character beyond ASCII,
so the classes of the contracts, which all are ASCII sets or their complements, hold byte by byte.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.sources.shared import shared_path, written

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Bytes to which each byte goes: A-Z to a-z, what is no word byte to a space.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

def alnum_words(text: bytes) -> list[bytes]:
    """Words of digits, a-z and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_ALNUM).split()


def space_words(text: bytes, lower: bool = True) -> list[bytes]:
    """Words between white space of ASCII (0x20, 0x09-0x0D); ``lower`` folds A-Z only."""
    return (text.lower() if lower else text).split()


def file_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI and the path in it, for files that are no tables. Spark's names of one object store are one here."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


#: Rows of an Arrow batch at most. All operators use this one bound, so none changes what another was made for; Spark's
#: own bound on a batch's bytes (spark.sql.execution.arrow.maxBytesPerBatch) holds beside it.
BATCH_ROWS = 2000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def merged(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` or somewhat more, for rows that are small."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def fresh(columns: Iterable[str], name: str) -> str:
    """A name that none of the columns bears, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key of more than one row in HEAVY is heavy: there are HEAVY of them at most, whatever the table.
HEAVY = 4096


def joined_to_one(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """The inner join of ``left`` with ``right``, a written table of one row a key that says in ``weight`` how many rows of
    ``left`` have it. Heavy keys meet by a broadcast of at most HEAVY rows, so none of them fills a task; all others are
    exchanged. ``weight`` does not come along."""
    limit = int(right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]) // HEAVY
    heavy = F.broadcast(right.where(F.col(weight) > limit).drop(weight))
    light = right.where(F.col(weight) <= limit).drop(weight)
    return left.join(heavy, key).unionByName(left.join(heavy, key, "left_anti").join(light, key))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def rows_to_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH_ROWS at most (fewer where the session says so); a worker gives its memory back
    when a task is done, as it may idle then beside others."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_KEY)) <= BATCH_ROWS:
        conf.set(_BATCH_KEY, str(BATCH_ROWS))

    def run(batches):
        yield from function(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
