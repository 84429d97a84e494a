"""Checks of custom keywords and section mappings: on the driver for options, as columns for data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.functions.patterns import java_error, slow_error
from foliate.functions.text import is_blank, trim_all

#: The greatest length, and the words of the messages below.
MAX_LENGTH = 100


def keyword_errors(keywords: Sequence[str | None] | None) -> list[str]:
    """Messages in the order of the keywords, those for repeats at the end."""
    if keywords is None:
        return ["Keywords collection cannot be null"]
    errors, seen = [], {}
    for i, word in enumerate(keywords):
        if word is not None:
            seen[word.lower()] = seen.get(word.lower(), 0) + 1
        if word is None or not word.strip():
            errors.append(f"Keyword at index {i} is null or empty")
            continue
        checks = (
            (len(word) > MAX_LENGTH, f"exceeds maximum length of {MAX_LENGTH} characters"),
            ("\n" in word or "\r" in word, "contains line breaks"),
            (word.strip() != word, "has leading or trailing whitespace"),
        )
        errors += [f"Keyword '{word}' {said}" for bad, said in checks if bad]
    return errors + [f"Duplicate keyword found: '{w}'" for w, n in seen.items() if n > 1 and w]


def mapping_errors(mappings: Mapping[str, Sequence[str] | None] | None) -> list[str]:
    if mappings is None:
        return ["Section mappings cannot be null"]
    errors = []
    for pattern, words in mappings.items():
        if not (pattern or "").strip():
            errors.append("Section mapping pattern cannot be null or empty")
            continue
        if said := java_error(pattern) or slow_error(pattern):
            errors.append(f"Invalid regex pattern '{pattern}': {said}")
            continue
        errors += [f"Pattern '{pattern}': {e}" for e in keyword_errors(words)]
    return errors


def keyword_error_rows(rows: DataFrame, id_col: str = "list_id", keywords_col: str = "keywords") -> DataFrame:
    """(id, ord, message): the same checks over a column of keyword arrays. Messages about a keyword have its index as
    ord; those about repeats have null. Nearly all pairs of list and keyword stand alone, so they are dealt out before they are
    counted: no task counts more than one of ``spark.sql.shuffle.partitions`` pieces, however much of the table it reads."""
    each = rows.select(id_col, F.posexplode(keywords_col).alias("i", "k"))
    said = lambda text: F.concat(F.lit("Keyword '"), F.col("k"), F.lit(f"' {text}"))
    messages = F.when(is_blank(F.col("k")), F.array(F.concat(F.lit("Keyword at index "), F.col("i").cast("string"), F.lit(" is null or empty")))).otherwise(
        F.array_compact(F.array(
            F.when(F.length("k") > MAX_LENGTH, said(f"exceeds maximum length of {MAX_LENGTH} characters")), F.when(F.col("k").rlike(r"[\r\n]"), said("contains line breaks")),
            F.when(trim_all(F.col("k")) != F.col("k"), said("has leading or trailing whitespace")),
        ))
    )
    single = each.select(id_col, F.col("i").cast("bigint").alias("ord"), F.explode(messages).alias("message"))
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = each.where("k is not null and k <> ''").select(id_col, F.lower("k").alias("w")).repartition(pieces, id_col, "w")
    twice = words.groupBy(id_col, "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return single.unionByName(twice.select(id_col, F.lit(None).cast("bigint").alias("ord"), F.concat(F.lit("Duplicate keyword found: '"), F.col("w"), F.lit("'")).alias("message")))
