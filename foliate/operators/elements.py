"""Chunks, structural elements and typed edges from parsed Markdown blocks; all inside a document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions.folds import running
from foliate.functions.text import let, link_type
from foliate.operators.graph import CONTAINS, HAS_NESTED_SECTION, HAS_SUBSECTION, LINKS_TO, TREE

_OPEN = "struct<level:int,ord:bigint>"
_TIE = "struct<parent:bigint,kind:string>"
_STATE = f"struct<stack:array<{_OPEN}>,current:bigint,n:bigint>"
_LINKS = "array<struct<url:string,text:string,type:string,title:string>>"


def block_chunks(parsed: DataFrame) -> DataFrame:
    """One chunk a block, inside quotes and tables too. Titles count all chunks; there are no parents."""
    rows = parsed.select("source_id", F.posexplode("blocks").alias("i", "b"))
    kind, n = F.col("b.kind"), (F.col("i") + 1).cast("string")
    heading = kind == "heading"
    name = F.when(kind == "paragraph", "Paragraph ").when(kind == "list", "List ").otherwise("Code Block ")
    original = F.col("b.original")
    return rows.select(
        "source_id", F.concat_ws("#", "source_id", F.concat(F.lit("b"), n)).alias("chunk_id"), (F.col("i") + 1).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("parent_id"),
        F.col("b.level").alias("level"), F.when(heading, "Markdown").when(kind == "paragraph", "Paragraph").when(kind == "list", "List").otherwise("Code").alias("chunk_type"),
        F.when(heading, original).otherwise("").alias("raw_title"), F.when(heading, F.col("b.content")).otherwise(F.concat(name, n)).alias("clean_title"), F.col("b.content").alias("content"),
        original.alias("original_markdown"), F.col("b.start").alias("start_offset"), F.col("b.stop").alias("end_offset"), F.col("b.level").alias("section_level"), heading.alias("is_heading"),
        F.when(heading, "Header").otherwise("Content").alias("chunk_type_enum"),
    )


def _typed(links: Column) -> Column:
    return F.transform(links, lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"), link_type(x["url"]).alias("type"), x["title"].alias("title")))


def _top(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["top"])


def _placed(parsed: DataFrame) -> DataFrame:
    """Rows of top-level blocks (i, b), each with its tie to the element above it (t) and its typed links, and of the virtual
    elements (k from 0, l) that stand for the internal links of blocks other than headings: one parse for elements,
    edges and what is asked of both."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    start = F.struct(none(_OPEN).alias("stack"), F.lit(None).cast("bigint").alias("current"), F.lit(0).cast("bigint").alias("n"))

    def step(s: Column, b: Column) -> tuple[Column, Column]:
        stack = F.filter(s["stack"], lambda o: o["level"] < b["level"])
        above = F.get(stack, F.size(stack) - 1)
        near = F.when(b["level"] - above["level"] == 1, HAS_SUBSECTION).otherwise(HAS_NESTED_SECTION)
        tie = lambda parent, kind: F.when(parent.isNotNull(), F.struct(parent.alias("parent"), kind.alias("kind")).cast(_TIE))
        opened = F.concat(stack, F.array(F.struct(b["level"].alias("level"), s["n"].alias("ord")).cast(_OPEN)))
        heading = b["kind"] == "heading"
        under = F.struct(opened.alias("stack"), s["n"].alias("current"), (s["n"] + 1).alias("n")).cast(_STATE)
        beside = F.struct(s["stack"].alias("stack"), s["current"].alias("current"), (s["n"] + 1).alias("n")).cast(_STATE)
        return F.when(heading, under).otherwise(beside), F.when(heading, tie(above["ord"], near)).otherwise(tie(s["current"], F.lit(CONTAINS)))

    both = let(_top(F.col("blocks")), lambda top: F.arrays_zip(top.alias("b"), running(top, start, step, _STATE, _TIE).alias("t")))
    rows = parsed.select("source_id", F.posexplode(both).alias("i", "x")).select("source_id", "i", "x.b", "x.t").withColumn("links", _typed(F.col("b.links")))
    own = F.struct(F.lit(-1).alias("k"), F.lit(None).cast("struct<url:string,text:string,type:string,title:string>").alias("l"))
    inner = F.filter("links", lambda x: (x["type"] == "Internal") & (F.col("b.kind") != "heading"))
    return rows.select("*", F.explode(F.concat(F.array(own), F.transform(inner, lambda x, k: F.struct(k.alias("k"), x.alias("l"))))).alias("e")).select("*", "e.*").drop("e")


def elements(parsed: DataFrame) -> DataFrame:
    """Top-level blocks, each followed by a virtual element for every internal link of it, unless it is a heading."""
    return _placed(parsed).select(*_element())


def root_elements(parsed: DataFrame) -> DataFrame:
    """Elements that no tree edge leads to, straight from the parsed documents."""
    return _placed(parsed).where((F.col("k") >= 0) | ~F.coalesce(F.col("t.kind").isin(*TREE), F.lit(False))).select(*_element())


def parent_elements(parsed: DataFrame) -> DataFrame:
    """(source_id, element_id, parent_element_id) of the elements that a tree edge leads to."""
    rows = _placed(parsed).where((F.col("k") < 0) & F.col("t.kind").isin(*TREE))
    return rows.select("source_id", element_id(F.col("source_id"), F.col("i")).alias("element_id"), element_id(F.col("source_id"), F.col("t.parent")).alias("parent_element_id"))


def child_elements(parsed: DataFrame, parent: Column) -> DataFrame:
    """Elements that a tree edge leads to from an element whose id fulfils the condition ``parent`` (of column parent_element_id)."""
    rows = _placed(parsed).where((F.col("k") < 0) & F.col("t.kind").isin(*TREE)).withColumn("parent_element_id", element_id(F.col("source_id"), F.col("t.parent")))
    return rows.where(parent).select(*_element())


def has_structure(parsed: DataFrame) -> DataFrame:
    """(source_id, has_structure): whether a document has any element, which any top-level block is. One parse, and only the
    answers are exchanged: documents of one id share theirs."""
    own = F.coalesce(F.exists("blocks", lambda b: b["top"]), F.lit(False))
    return parsed.select("source_id", own.alias("own")).select("source_id", F.max("own").over(Window.partitionBy("source_id")).alias("has_structure"))


def _element() -> list[Column]:
    virtual = F.col("k") >= 0
    only = lambda c: F.when(~virtual, c)
    link = F.create_map(F.lit("LinkUrl"), F.col("l.url"), F.lit("LinkType"), F.col("l.type"), F.lit("LinkTitle"), F.coalesce("l.title", F.lit("")))
    block = F.create_map(F.lit("BlockType"), F.col("b.kind"), F.lit("HasChildren"), F.col("b.has_children").cast("string"), F.lit("LinkCount"), F.size("links").cast("string"))
    return [
        F.col("source_id"), element_id(F.col("source_id"), F.col("i"), F.col("k")).alias("element_id"), F.when(virtual, "link").otherwise(F.col("b.kind")).alias("element_type"),
        F.when(virtual, F.col("l.text")).otherwise(F.col("b.content")).alias("content"), F.when(virtual, 0).otherwise(F.col("b.level")).alias("level"),
        F.coalesce(only(F.col("b.start")), F.lit(0)).alias("start_offset"), F.coalesce(only(F.col("b.stop")), F.lit(0)).alias("end_offset"), F.coalesce(only(F.col("b.line")), F.lit(0)).alias("start_line"),
        F.coalesce(only(F.col("b.line")), F.lit(0)).alias("end_line"), F.when(virtual, "").otherwise(F.col("b.original")).alias("original_markdown"),
        F.when(virtual, F.array().cast(_LINKS)).otherwise(F.col("links")).alias("links"), F.when(virtual, link).otherwise(block).alias("metadata"),
    ]


def element_id(source: Column, i: Column, k: Column | None = None) -> Column:
    name = F.concat(F.lit("e"), (i + 1).cast("string"))
    if k is not None:
        name = F.concat(name, F.when(k >= 0, F.concat(F.lit("l"), (k + 1).cast("string"))).otherwise(""))
    return F.concat_ws("#", source, name)


def links(parsed: DataFrame) -> DataFrame:
    """(source_id, element_id, ord, url, text, type, title) of the links of top-level blocks."""
    rows = parsed.select("source_id", F.posexplode(_top(F.col("blocks"))).alias("i", "b"))
    each = rows.select("source_id", element_id(F.col("source_id"), F.col("i")).alias("element_id"), F.posexplode(_typed(F.col("b.links"))).alias("ord", "l"))
    return each.select("source_id", "element_id", F.col("ord").cast("bigint").alias("ord"), "l.*")


def edges(parsed: DataFrame) -> DataFrame:
    """Heading to heading (a step of one level or more than one), heading to what stands under it, element to its
    internal links. ``edge_ord`` is the order within a document; all weights are 1; ``created_at`` is when the query began."""
    virtual = F.col("k") >= 0
    name = lambda i, k=None: element_id(F.col("source_id"), i, k)
    ord_ = (F.col("i").cast("bigint") * 1_000_000 + F.col("k") + 1).alias("edge_ord")
    said = F.create_map(F.lit("LinkUrl"), F.col("l.url"), F.lit("LinkText"), F.col("l.text"), F.lit("LinkType"), F.col("l.type"))
    return _placed(parsed).where(virtual | F.col("t.parent").isNotNull()).select(
        "source_id", F.concat_ws("#", "source_id", F.concat(F.lit("x"), ord_.cast("string"))).alias("edge_id"), ord_,
        F.when(virtual, name(F.col("i"))).otherwise(name(F.col("t.parent"))).alias("source_element_id"), name(F.col("i"), F.col("k")).alias("target_element_id"),
        F.when(virtual, LINKS_TO).otherwise(F.col("t.kind")).alias("relationship_type"), F.lit(1.0).alias("weight"),
        F.when(virtual, said).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"), F.current_timestamp().alias("created_at"),
    )
