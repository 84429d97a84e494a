"""Navigation of chunk trees and element graphs."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.functions.text import let
from foliate.operators.structure import each
from foliate.sources.shared import written

CONTAINS, HAS_SUBSECTION, HAS_NESTED_SECTION, LINKS_TO = "CONTAINS", "HAS_SUBSECTION", "HAS_NESTED_SECTION", "LINKS_TO"
#: What makes one element another's child; nested sections and links don't.
TREE = (HAS_SUBSECTION, CONTAINS)


def closure(chunks: DataFrame) -> DataFrame:
    """(source_id, chunk_id, ancestor_id, depth): all ancestors, the parent at depth 1, for trees of any depth.

    Not lazy: after a round all ancestors up to a power of two are known, and the next round puts those behind the farthest
    of them, so rounds grow with the logarithm of the depth. A chunk found above itself ends them with an error. Each round
    writes its pairs to the shared folder; sections of documents need none of this (``closure_by_stack``).
    """
    parents = chunks.where("parent_id is not null").select("source_id", "chunk_id", "parent_id")
    known = chunks.select("source_id", F.col("chunk_id").alias("parent_id"))
    pairs = parents.join(known, ["source_id", "parent_id"], "left_semi").select("source_id", "chunk_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth"))
    pairs = written(pairs, "pairs")
    for k in count():
        far = pairs.where(F.col("depth") == 1 << k)
        found = pairs.agg(F.count_if(F.col("depth") == 1 << k).alias("n"), F.count_if(F.col("chunk_id") == F.col("ancestor_id")).alias("loops")).first()
        if found["loops"]:
            raise ValueError("a chunk is its own ancestor")
        if not found["n"]:
            return pairs
        above = pairs.select("source_id", F.col("chunk_id").alias("ancestor_id"), F.col("ancestor_id").alias("above"), F.col("depth").alias("more"))
        beyond = far.join(above, ["source_id", "ancestor_id"]).select("source_id", "chunk_id", F.col("above").alias("ancestor_id"), (F.col("depth") + F.col("more")).alias("depth"))
        pairs = written(pairs.unionByName(beyond), "pairs")


def closure_by_stack(chunks_of_documents: DataFrame) -> DataFrame:
    """The same from rows (source_id, sections): a document's whole tree is in its row, so nothing is exchanged."""

    def above(all_, s):
        parent = lambda seq: F.get(all_, (seq - 1).cast("int"))["parent_seq"]
        # heading numbers are places in the array; an ancestor's level falls with every step, so the level bounds them
        start = F.struct(s["parent_seq"].alias("next"), F.array().cast("array<bigint>").alias("out")).cast("struct<next:bigint,out:array<bigint>>")
        step = lambda a, _: F.when(a["next"].isNull(), a).otherwise(F.struct(parent(a["next"]).alias("next"), F.concat(a["out"], F.array(a["next"])).alias("out")).cast("struct<next:bigint,out:array<bigint>>"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(s["level"], F.lit(1))), start, step, lambda a: a["out"])

    made = let(F.col("sections"), lambda all_: F.transform(all_, lambda s: F.struct(s["seq"].alias("seq"), above(all_, s).alias("up"))))
    rows = each(chunks_of_documents.select("source_id", made.alias("x")), "x")
    rows = rows.select("source_id", F.col("x.seq").alias("seq"), F.posexplode("x.up").alias("d", "up"))
    name = lambda c: F.concat_ws("#", "source_id", F.col(c).cast("string"))
    return rows.select("source_id", name("seq").alias("chunk_id"), name("up").alias("ancestor_id"), (F.col("d") + 1).alias("depth"))


def descendants(closed: DataFrame, chunk_id: str | None = None) -> DataFrame:
    """(source_id, chunk_id, descendant_id, depth), of one chunk if given."""
    out = closed.select("source_id", F.col("ancestor_id").alias("chunk_id"), F.col("chunk_id").alias("descendant_id"), "depth")
    return out.where(F.col("chunk_id") == chunk_id) if chunk_id else out


def find_child(chunks: DataFrame, parent_id: str, chunk_id: str) -> DataFrame:
    return chunks.where((F.col("parent_id") == parent_id) & (F.col("chunk_id") == chunk_id))


def find_descendant(closed: DataFrame, ancestor_id: str, chunk_id: str) -> DataFrame:
    return closed.where((F.col("ancestor_id") == ancestor_id) & (F.col("chunk_id") == chunk_id))


def _tree(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relationship_type").isin(*TREE))


def root_elements(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements that no tree edge leads to; targets of links and nested sections are among them."""
    return elements.join(_tree(edges).select("source_id", F.col("target_element_id").alias("element_id")), ["source_id", "element_id"], "left_anti")


def child_elements(elements: DataFrame, edges: DataFrame, element_id: str) -> DataFrame:
    kids = _tree(edges).where(F.col("source_element_id") == element_id).select("source_id", F.col("target_element_id").alias("element_id"))
    return elements.join(kids, ["source_id", "element_id"], "left_semi")


def parent_elements(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, element_id, parent_element_id): by the first tree edge; elements without one are left out."""
    first = _tree(edges).groupBy("source_id", "target_element_id").agg(F.min_by("source_element_id", "edge_ord").alias("parent_element_id"))
    return elements.select("source_id", "element_id").join(first.withColumnRenamed("target_element_id", "element_id"), ["source_id", "element_id"])


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def has_structure(elements: DataFrame, documents: DataFrame) -> DataFrame:
    """(source_id, has_structure): whether a document has any element."""
    some = elements.select("source_id").distinct().withColumn("found", F.lit(True))
    return documents.select("source_id").join(some, "source_id", "left").select("source_id", F.coalesce("found", F.lit(False)).alias("has_structure"))
