"""Length-delimited binary records of token ids, with a separate index of offsets.

A shard is a sequence of frames, all integers little-endian:

    length u64 | masked checksum of the length's bytes u32 | payload | masked checksum of the payload u32

A checksum is CRC-32, rotated right by 15 bits, plus 0xA282EAD8 modulo 2**32, so that records may hold checksums
themselves. A payload is: width of an id in bytes u8 (2 or 4) | 1 if there is a document id, else 0, u8 |
document id i64 | number of ids u32 | ids. Shards are ranges of document ids in ascending order, and so are the
records in a shard. The index is a Parquet table (shard, ordinal, doc_id, byte_offset, byte_length, n_tokens):
any record can be read alone by seeking, in any order.

Executors write a shard under a name of the attempt and rename it when it is whole: a task that runs again
writes the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.base import file_store, mapped, shared_path
from foliate.llm.tokens import default_vocabulary, encoder

_HEAD, _LENGTH, _CRC = struct.Struct("<BBqI"), struct.Struct("<Q"), struct.Struct("<I")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """A record from ids of 32 bits; they take 16 where all fit."""
    values = np.frombuffer(ids, "<u4")
    narrow = not len(values) or int(values.max()) < 1 << 16
    payload = _HEAD.pack(2 if narrow else 4, doc_id is not None, doc_id or 0, len(values)) + (values.astype("<u2").tobytes() if narrow else ids)
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CRC.pack(masked(length)), payload, _CRC.pack(masked(payload))))


def unframe(data: bytes) -> tuple[int | None, bytes]:
    """Document id and ids (32 bits each) of one whole record; ValueError if a length or checksum is wrong."""
    (size,) = _LENGTH.unpack_from(data)
    if len(data) != size + 16 or _CRC.unpack_from(data, 8)[0] != masked(data[:8]):
        raise ValueError("a record's length is damaged")
    payload = data[12:-4]
    if _CRC.unpack_from(data, len(data) - 4)[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    width, has_id, doc_id, n = _HEAD.unpack_from(payload)
    body = payload[_HEAD.size :]
    if len(body) != n * width:
        raise ValueError("a record holds another number of ids than it says")
    return (doc_id if has_id else None), np.frombuffer(body, f"<u{width}").astype("<u4").tobytes()


def records(stream):
    """The records of an open shard in order, as bytes."""
    while head := stream.read(12):
        if len(head) < 12 or _CRC.unpack_from(head, 8)[0] != masked(head[:8]):
            raise ValueError("a record's length is damaged")
        rest = stream.read(_LENGTH.unpack_from(head)[0] + 4)
        yield head + rest


def _shard(path: str, number: int) -> str:
    return f"{path}/shard-{number:08d}.rec"


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes the records below ``path`` (a URI that the executors can open) and returns the index, read back.

    A null or empty text is its end id alone. Null ids come first, without an id. Rows of equal ids are ordered by
    a hash of their text; repeated rows give a record each. No rows give no shard and an empty index. Very long texts are
    encoded whole into one record. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    vocab = vocabulary or default_vocabulary()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "h")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")

    def run(batches):
        store, base = file_store(path)
        shard, at, ordinal, sink, temp = TaskContext.get().partitionId(), 0, 0, None, ""
        for batch in batches:
            index = []
            for doc, coded in zip(batch.column(0).to_pylist(), encoder(vocab).encode(batch.column(1))):
                if sink is None:
                    store.create_dir(base, recursive=True)
                    temp = f"{base}/_attempt-{shard}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temp)
                data = frame(doc, coded + b"\0\0\0\0")
                sink.write(data)
                index.append((shard, ordinal, doc, at, len(data), len(coded) // 4 + 1))
                ordinal += 1
                at += len(data)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*index)], names)
        if sink is not None:
            sink.close()
            store.move(temp, _shard(base, shard))

    names = ["shard", "ordinal", "doc_id", "byte_offset", "byte_length", "n_tokens"]
    schema = ", ".join(f"{n} long" for n in names)
    mapped(rows, run, schema).write.parquet(f"{path}/index")
    return spark.read.schema(schema).parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard and ordinal of every record, from the shards in their order.

    Each shard is read by one task, front to back, and every length and checksum is verified.
    """
    index = spark.read.parquet(f"{path}/index")
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row a shard
    first, starts = 0, []
    for r in sizes:
        starts.append((r["shard"], first))
        first += r["n"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "ordinal"]
    schema = ", ".join(f"{n} long" for n in names)
    if not starts:
        return spark.createDataFrame([], schema)

    def run(batches):
        store, base = file_store(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard, at = starts[k]
                out = []
                with store.open_input_stream(_shard(base, shard), buffer_size=1 << 20) as stream:
                    for ordinal, data in enumerate(records(stream)):
                        doc, ids = unframe(data)
                        out.append((doc, at, len(ids) // 4, zlib.crc32(ids), shard, ordinal))
                        at += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return mapped(spark.range(0, len(starts), 1, len(starts)), run, schema)


def read_records(path: str, index_rows: list) -> list[tuple[int | None, list[int]]]:
    """Document id and ids of the records of some index rows, by seeking; the rows come in any order."""
    store, base = file_store(path)
    out = []
    for row in index_rows:
        with store.open_input_file(_shard(base, row["shard"])) as file:
            doc, ids = unframe(file.read_at(row["byte_length"], row["byte_offset"]))
        out.append((doc, np.frombuffer(ids, "<u4").tolist()))
    return out


def fetch(index_rows: DataFrame, path: str, at_once: int = 4096) -> DataFrame:
    """shard, ordinal, doc_id and ids of the records that some rows of the index name, in any order and as often as they name
    them: the distributed shuffled read. Rows meet in tasks by shard and stretch of ``at_once`` records, so a large shard
    is shared; each task opens a shard once for a stretch and seeks in ascending order."""
    stretch = F.floor(F.col("ordinal") / at_once)
    rows = index_rows.select("shard", "ordinal", "byte_offset", "byte_length").repartition("shard", stretch).sortWithinPartitions("shard", "ordinal")

    def run(batches):
        store, base = file_store(path)
        for batch in batches:
            shards = batch.column(0).to_pylist()
            docs, ids, file, opened = [], [], None, None
            for shard, at, size in zip(shards, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if shard != opened:
                    if file is not None:
                        file.close()
                    file, opened = store.open_input_file(_shard(base, shard)), shard
                doc, coded = unframe(file.read_at(size, at))
                docs.append(doc)
                ids.append(np.frombuffer(coded, "<u4").astype(np.int64))
            if file is not None:
                file.close()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["shard", "ordinal", "doc_id", "ids"])

    return mapped(rows, run, "shard long, ordinal long, doc_id long, ids array<long>")


def token_file_query(docs: DataFrame) -> DataFrame:
    path = shared_path(docs.sparkSession, "token-files")
    write(docs, path)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")
