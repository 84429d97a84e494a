"""Content-addressed WARC archive.

Two tables in a folder: ``payloads`` (digest, payload) holds each distinct payload once under its SHA-256, and
``headers`` (page_id, header, digest) the exact bytes of every record's header block. A record is header + payload +
CRLF CRLF; joining the tables on the digest gives all original records back. Reading verifies every payload against
its digest, takes each record's bytes apart again and holds lengths, end marks and digests against what is there, and stops
the query at the first difference. ``export`` writes the records as plain WARC files.

Of records with equal payloads of at least ``min_revisit`` bytes the one of largest page_id is a response, the others
are revisits that refer to it and have no block of their own; smaller payloads are always responses.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.base import file_store, mapped, shared_path

CRLF = "\r\n"
MIN_REVISIT = 1000


def _uuid(*parts: Column) -> Column:
    h = F.sha1(F.concat_ws("|", *parts).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is null is left out."""
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit(CRLF)), F.lit("")) for name, value in fields], F.lit(CRLF))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, min_revisit: int = MIN_REVISIT) -> None:
    """Writes the two tables below ``path``. WARC-Date is the time in ``date_col``, else that of the query's begin.

    A null payload is empty, a null url leaves out WARC-Target-URI (line breaks in a url become spaces, so no url can
    forge a header). Rows that repeat a page_id are records each, with ids of their own; rows of the largest page_id are
    all responses, and revisits refer to the last of them. A null page_id is no candidate for a response unless no
    other row has the payload; then those rows are responses. Very long payloads are stored whole. No rows give empty
    tables; other columns, whatever their names, are not read. ``pages`` must give the same rows in the same partitions
    each time it is read, as tables do.
    """
    now = F.current_timestamp()
    date = F.coalesce(F.col(date_col).cast("timestamp"), now) if date_col else now
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.col(url_col).cast("string"), r"[\r\n]+", " ").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"), F.date_format(F.to_utc_timestamp(date, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.monotonically_increasing_id().alias("row"),
    ).select("*", F.sha2("payload", 256).alias("digest"))
    rows.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")

    light = rows.select("page_id", "url", "date", "row", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    first = light.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("best"))
    light = light.join(first, "digest", "left").withColumns({"winner": F.col("best.page_id"), "winner_row": F.col("best.row")})
    revisit = F.coalesce((F.col("size") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("winner")), F.lit(False))
    refers = F.when(revisit, F.col("winner"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    urn = lambda row: F.concat(F.lit("<urn:uuid:"), _uuid(F.lit("record"), row.cast("string"), F.col("digest"), F.col("date")), F.lit(">"))
    header = _lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", urn(F.col("row"))), ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("X-Page-ID", F.col("page_id")),
        ("X-Payload-Length", F.col("size")), ("X-Refers-To-Page", refers), ("WARC-Refers-To", F.when(revisit, urn(F.col("winner_row")))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.length(http) + F.when(revisit, 0).otherwise(F.col("size"))),
    )
    light.select("page_id", F.concat(header, http).cast("binary").alias("header"), "digest", revisit.alias("bare")).write.parquet(f"{path}/headers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload (the full one, of revisits too), record (the WARC record's exact bytes)."""
    headers = spark.read.schema("page_id long, header binary, digest string, bare boolean").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    sound = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("binary")))
    joined = headers.join(sound, "digest", "left")
    payload = F.coalesce(F.col("payload"), F.raise_error(F.lit("a record's payload is missing")).cast("binary"))
    end = F.lit(CRLF * 2).cast("binary")
    return joined.select("page_id", "header", payload.alias("payload"), F.when(F.col("bare"), F.concat("header", end)).otherwise(F.concat("header", payload, end)).alias("record"))


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def parsed(records: DataFrame) -> DataFrame:
    """What the records' own bytes say, taken apart again: the WARC header ends at the first empty line, Content-Length
    octets are the block, two line ends close it; a response's block is an HTTP header, an empty line and the payload. A
    revisit has no payload of its own: that of the response stands for it. Lengths, end marks and digests are held
    against the bytes; a difference stops the query."""
    end = CRLF * 2
    whole, text = F.col("record"), F.col("record").cast("string")  # bytes as they are
    head = F.concat(F.substring_index(text, end, 1), F.lit(CRLF))
    begin = F.octet_length(F.substring_index(text, end, 1)) + len(end)
    block = F.substring(whole, begin + 1, F.octet_length(whole) - begin - len(end))
    own = F.substring(block, F.octet_length(F.substring_index(block.cast("string"), end, 1)) + len(end) + 1, F.octet_length(whole))
    shut = (F.octet_length(block) == _field(head, "Content-Length").cast("long")) & F.endswith(text, F.lit(end))
    payload = F.when(_field(head, "WARC-Type") == "response", own).otherwise(F.col("payload"))
    records = records.select("record", F.when(shut, payload).otherwise(F.raise_error(F.lit("a record's length is damaged")).cast("binary")).alias("payload"))
    size, sha1 = F.octet_length("payload"), F.sha1("payload")
    rows = records.select(
        _field(head, "X-Page-ID").cast("long").alias("page_id"), size.cast("long").alias("payload_bytes"),
        F.regexp_replace(_field(head, "WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        _field(head, "WARC-Type").alias("record_type"), _field(head, "X-Refers-To-Page").cast("long").alias("refers_to"),
        sha1.alias("_sha1"), _field(head, "X-Payload-Length").cast("long").alias("_size"),
    )
    right = (F.col("_sha1") == F.col("payload_digest")) & (F.col("_size") == F.col("payload_bytes"))
    digest = F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header differs from its payload")).cast("string"))
    return rows.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def export(records: DataFrame, path: str) -> DataFrame:
    """Writes the records (rows of ``read``) as WARC files below ``path`` (a URI that the executors can open), one for each
    partition that has rows, and returns (file, page_id, byte_offset, byte_length), read back. A file is written under a name
    of the attempt and renamed when it is whole."""
    spark = records.sparkSession
    names, schema = ["file", "page_id", "byte_offset", "byte_length"], "file string, page_id long, byte_offset long, byte_length long"

    def run(batches):
        store, base = file_store(path)
        name, temp, sink, at = f"part-{TaskContext.get().partitionId():06d}.warc", "", None, 0
        for batch in batches:
            rows = []
            for page, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sink is None:
                    store.create_dir(base, recursive=True)
                    temp = f"{base}/_attempt-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temp)
                sink.write(record)
                rows.append((name, page, at, len(record)))
                at += len(record)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names)
        if sink is not None:
            sink.close()
            store.move(temp, f"{base}/{name}")

    mapped(records.select("page_id", "record"), run, schema).write.parquet(f"{path}/index")
    return spark.read.schema(schema).parquet(f"{path}/index")


def archive_query(pages: DataFrame) -> DataFrame:
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path)
    return parsed(read(pages.sparkSession, path))


ARCHIVE_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
s as (select page_id, cast(octet_length(b) as bigint) as payload_bytes, sha1(b) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as winner from s)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> winner then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> winner then winner end as refers_to
from m
"""
