"""Documents in and graphs out. A document is a row (source_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions.text import is_blank, let


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """One document a file, named after the file without its folder and extension."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"(?<=.)\.[^.]*$", "")
    # a path's escapes are of the form %20; a plus stands for itself
    return spark.read.text(path, wholetext=True).select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("source_id"), F.col("value").alias("text"))


def from_table(rows: DataFrame, id_col: str | Column | None, text_col: str = "text") -> DataFrame:
    """Documents of a table; without an id the text's own SHA-256 names it."""
    own = F.sha2(F.col(text_col), 256) if id_col is None else F.col(id_col) if isinstance(id_col, str) else id_col
    return rows.select(own.cast("string").alias("source_id"), F.col(text_col).alias("text"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over as many partitions as there are cores, if they come in fewer; larger tables are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def checked(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Without blank documents and ids; with ``strict`` the first of them stops the query."""
    bad = is_blank(F.col("text")) | is_blank(F.col("source_id"))
    if not strict:
        return docs.where(~bad)
    return docs.withColumn("text", F.when(bad, F.raise_error(F.lit("a document or its source_id is blank")).cast("string")).otherwise(F.col("text")))


def overlaid(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of plain prose with heading marks put before some lines, by the document's number and the line's place:
    for tables that hold no structure of their own. A remainder below zero, of a number below zero, puts no mark."""
    key = lambda i: (F.col(id_col) * 7 + i * 13) % 16
    deep = lambda i: F.element_at(F.array(F.lit("1. "), F.lit("1.2 "), F.lit("1.2.3 ")), (F.pmod(i, F.lit(3)) + 1).cast("int"))

    def line(x: Column, i: Column) -> Column:
        out = F.when(F.length(x) == 0, x)
        for k, mark in enumerate(OVERLAY):
            out = out.when(key(i) == k, F.concat(deep(i) if mark is None else F.lit(mark), x))
        return out.otherwise(x)

    text = F.array_join(F.transform(F.split(text_col, r"[\r\n]", -1), line), "\n")
    return rows.select(F.col(id_col).cast("string").alias("source_id"), text.alias("text"))


OVERLAY = ("# ", "## ", "### ", None, "§ 42 ", "Appendix A: ", "B. ", "IV. ", "#### ", "##### ", "###### ")


def overlaid_markdown(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with one Markdown block a line: headings, items, code and links."""
    d = F.col(id_col)
    t = lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z0-9 .,]", ""))

    def block(x: Column, i: Column) -> Column:
        return let(F.struct(F.pmod(d * 7 + i * 13, F.lit(16)).alias("k"), t(x).alias("s")), lambda v: marked(v["k"], v["s"], i))

    def marked(k: Column, s: Column, i: Column) -> Column:
        n = lambda c: c.cast("string")
        return F.when(s == "", None).otherwise(
            F.when(k == 0, F.concat(F.lit("# "), s)).when(k == 1, F.concat(F.lit("## "), s)).when(k == 2, F.concat(F.lit("#### "), s)).when(k == 3, F.concat(F.lit("- "), s))
            .when(k == 4, F.concat(F.lit("See [doc"), n(i), F.lit("](./d"), n(d), F.lit(".md) "), s)).when(k == 5, F.concat(F.lit("Go [site](https://x.org/"), n(d), F.lit(") "), s))
            .when(k == 6, F.concat(F.lit("```\n"), s, F.lit("\n```"))).when(k == 7, F.concat(F.lit("Mail [m](mailto:a@b.c) and [s](#s"), n(i), F.lit(") "), s)).otherwise(F.concat(F.lit("Text "), s))
        )

    parts = F.array_compact(F.transform(F.split(text_col, r"[\r\n]", -1), block))
    return rows.select(d.cast("string").alias("source_id"), F.array_join(parts, "\n\n").alias("text"))


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).json(path)


def as_json(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(source_id, json): a row as a JSON object; null fields are left out."""
    columns = columns or rows.columns
    return rows.select("source_id", F.to_json(F.struct(*columns)).alias("json"))
