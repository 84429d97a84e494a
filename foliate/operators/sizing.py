"""Size control: greedy packing of sentences or words, part names and overlap, all inside a document's row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.functions.folds import running
from foliate.functions.text import let, trim_all
from foliate.operators.structure import SECTION


def sentences(c: Column) -> Column:
    """Cut behind each ``.``, ``!`` or ``?`` before white space; blank ones are left out."""
    return F.filter(F.split(c, r"(?<=[.!?])(?=(?U:\s))"), lambda s: s.rlike(r"(?U)\S"))


def _packed(pieces: Column, full, added) -> Column:
    def step(cur: Column, x: Column) -> tuple[Column, Column]:
        flush = full(cur, x) & (F.length(cur) > 0)
        return added(F.when(flush, "").otherwise(cur), x), F.when(flush, trim_all(cur))

    return F.array_compact(running(pieces, F.lit(""), step, "string", "string", lambda cur: F.when(F.length(cur) > 0, trim_all(cur))))


def pack_sentences(c: Column, max_size: int) -> Column:
    """Parts of whole sentences, started anew when the next sentence would exceed the size; a sentence not ending in a
    space gets one, and its successor keeps its own leading space. A longer sentence stands alone."""
    return _packed(
        sentences(c), lambda cur, s: F.length(cur) + F.length(s) > max_size, lambda cur, s: F.concat(cur, s, F.when(s.endswith(" "), "").otherwise(" "))
    )


def pack_words(c: Column, max_size: int) -> Column:
    """Parts of whole words joined by one space; line breaks are lost."""
    pieces = F.filter(F.split(c, r"[ \t\n\r]+"), lambda w: w != "")
    return _packed(
        pieces, lambda cur, w: F.length(cur) + F.length(w) + 1 > max_size, lambda cur, w: F.when(F.length(cur) > 0, F.concat(cur, F.lit(" "), w)).otherwise(w)
    )


def split_sections(sections: Column, max_size: int = 1000, on_sentences: bool = True) -> Column:
    """Sections whose content is longer than ``max_size`` become parts, named from the second on."""
    pack = pack_sentences if on_sentences else pack_words
    names = [x.split(":")[0] for x in SECTION[7:-1].split(",")]

    def parts(s: Column) -> Column:
        def part(content: Column, i: Column) -> Column:
            suffix = F.when(i > 0, F.concat(F.lit(" (Part "), (i + 1).cast("string"), F.lit(")"))).otherwise("")
            new = {"part": (i + 1).cast("bigint"), "content": content, "raw_title": F.concat(s["raw_title"], suffix), "clean_title": F.concat(s["clean_title"], suffix)}
            return F.struct(*[new.get(n, s[n]).alias(n) for n in names], F.lit(True).alias("part_of_split"))

        whole = F.array(F.struct(*[s[n].alias(n) for n in names], F.lit(False).alias("part_of_split")))
        packed = F.transform(pack(s["content"], max_size), part)
        return F.when((F.length(s["content"]) > max_size) & (F.size(packed) > 0), packed).otherwise(whole)

    return F.flatten(F.transform(sections, parts))


def overlapped(chunks: Column, overlap: int) -> Column:
    """Every chunk's content behind the last ``overlap`` characters of the chunk before it in the document, if that is
    longer than ``overlap``; what is repeated is the earlier chunk's own content, without its overlap."""
    if overlap <= 0:
        return chunks

    def lead(all_: Column, x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(all_, i - 1)["content"])
        content = F.when(F.length(before) > overlap, F.concat(F.right(before, F.lit(overlap)), F.lit("\n\n"), x["content"])).otherwise(x["content"])
        return x.withField("content", content)

    return let(chunks, lambda all_: F.transform(all_, lambda x, i: lead(all_, x, i)))
