"""Keyword extraction and merging, inside a chunk's row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.folds import run_lengths
from foliate.functions.text import clean_markup, distinct_ignoring_case, is_blank, is_stop_word, long_words


def frequencies(tokens: Column) -> Column:
    """(word, n) of the distinct tokens. Equal ones are counted as runs of the sorted array, so nothing is exchanged."""
    return run_lengths(tokens)


def _top(content: Column, k: int) -> Column:
    """Stop words are told after equal words are counted: the result is that of ``keyword_tokens``."""
    counted = F.filter(frequencies(long_words(content)), lambda x: ~is_stop_word(x["word"]))
    ranked = F.sort_array(F.transform(counted, lambda x: F.struct((-x["n"]).alias("n"), x["word"].alias("word"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["word"])


def simple_keywords(content: Column, k: int = 10) -> Column:
    """The ``k`` most frequent tokens, ties by the word."""
    return F.when(is_blank(content), F.array().cast("array<string>")).otherwise(_top(content, k))


def cleaned_keywords(content: Column, k: int = 10) -> Column:
    """The same after marks of Markdown are gone, so words joined by an underscore count as words."""
    return F.when(is_blank(content), F.array().cast("array<string>")).otherwise(_top(clean_markup(content), k))


EXTRACTORS = {"simple": simple_keywords, "cleaned": cleaned_keywords}


def section_keywords(title: Column, mappings: Mapping[str, Sequence[str]]) -> Column:
    """Keywords of the patterns that are found in the title, ignoring case, in the mapping's order."""
    none = F.array().cast("array<string>")
    if not mappings:
        return none
    return F.concat(*[F.when(title.rlike("(?iu)" + p) & (title != ""), F.array(*map(F.lit, words)) if words else none).otherwise(none) for p, words in mappings.items()])


def combined(extracted: Column, title: Column, custom: Sequence[str] = (), mappings: Mapping[str, Sequence[str]] | None = None, inherited: Column | None = None, k: int = 10) -> Column:
    """Custom keywords, then mapped, inherited and extracted ones: first casings, ``k`` at most."""
    none = F.array().cast("array<string>")
    own = F.array(*map(F.lit, custom)) if custom else none
    given = F.concat(own, section_keywords(title, mappings or {}), F.coalesce(inherited, none) if inherited is not None else none)
    return F.slice(distinct_ignoring_case(F.concat(given, extracted)), 1, k)


def inherited_from_parents(chunks: DataFrame, k: int = 10) -> DataFrame:
    """``chunks`` whose keywords come before those of their parent chunk: one level, first casings, ``k`` at most."""
    above = chunks.select("source_id", F.col("chunk_id").alias("parent_id"), F.col("keywords").alias("_above"))
    both = chunks.join(above, ["source_id", "parent_id"], "left")
    merged = F.slice(distinct_ignoring_case(F.concat(F.coalesce("_above", F.array().cast("array<string>")), F.col("keywords"))), 1, k)
    return both.withColumn("keywords", merged).drop("_above").select(*chunks.columns)
