"""Column functions over text. Lengths and places are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will",
    "with", "would", "could", "should", "this", "these", "those", "they", "them", "their", "there", "where", "when", "what", "who", "how", "why", "which",
    "can", "may", "might", "must", "shall", "have", "had", "do", "does", "did", "been", "being", "am", "were", "but", "or", "not", "no", "yes", "if",
    "then", "else", "than", "more", "most", "less", "least", "very", "much", "many", "some", "any", "all", "each", "every", "both", "either", "neither",
    "one", "two", "three", "first", "second", "third", "last", "next", "previous", "before", "after", "during", "while", "until", "since", "because",
    "so", "therefore", "however", "although", "though", "unless", "except", "instead", "rather", "quite", "just", "only", "also", "too", "even", "still",
    "yet", "already", "again", "once", "twice", "here", "everywhere", "anywhere", "somewhere", "nowhere", "up", "down", "left", "right", "above", "below",
    "over", "under", "through", "across", "around", "between", "among", "within", "without", "inside", "outside", "near", "far", "close", "away", "back",
    "forward", "toward", "against", "along", "beside", "behind", "beyond", "beneath",
)

#: All that Unicode calls white space at either end.
_EDGES = r"(?U)^\s+|\s+$"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, though lambdas within ``use`` name it many times."""
    return F.get(F.transform(F.array(value), use), 0)


def trim_all(c: Column) -> Column:
    """Without white space of any kind at the ends. Most texts have none there and are not searched."""
    open_ = lambda t: F.substring(t, 1, 1).rlike(r"(?U)\s") | F.substring(t, -1, 1).rlike(r"(?U)\s")
    return let(c, lambda t: F.when(open_(t), F.regexp_replace(t, _EDGES, "")).otherwise(t))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


#: What words are made of; the ASCII part comes first, as it is told in one step.
_IN_WORD = r"a-zA-Z0-9_\p{L}\p{Mn}\p{Nd}\p{Pc}"


def long_words(c: Column) -> Column:
    """Runs of three ASCII letters or more that stand between characters which are no letters, digits, marks or connectors, in
    lower case. One pass finds them, and they are put in lower case together."""
    found = F.array_remove(F.regexp_extract_all(c, F.lit(rf"([a-zA-Z]{{3,}}+)(?![{_IN_WORD}])|[{_IN_WORD}]++"), F.lit(1)), "")
    return let(F.lower(F.array_join(found, " ")), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def is_stop_word(w: Column) -> Column:
    return w.isin(*STOP_WORDS)


def keyword_tokens(c: Column) -> Column:
    """Words of three letters or more, no stop words, in lower case."""
    return F.filter(long_words(c), lambda w: ~is_stop_word(w))


def clean_markup(c: Column) -> Column:
    r"""Marks of Markdown become spaces, runs of white space one space."""
    return trim_all(F.regexp_replace(F.regexp_replace(c, r"[#*_`\[\](){}]", " "), r"(?U)\s+", " "))


def sanitized_keyword(c: Column) -> Column:
    """Trimmed, white space squeezed, in lower case; null if blank."""
    return F.when(~is_blank(c), F.lower(F.regexp_replace(trim_all(c), r"(?U)\s+", " ")))


def distinct_ignoring_case(a: Column) -> Column:
    """First casings, in order."""
    kept = lambda p: F.filter(p["a"], lambda x, i: F.array_position(p["u"], F.get(p["u"], i)) == i + 1)
    return let(a, lambda v: let(F.struct(v.alias("a"), F.transform(v, F.upper).alias("u")), kept))


def sanitized_keywords(a: Column) -> Column:
    return distinct_ignoring_case(F.filter(F.transform(a, sanitized_keyword), lambda x: x.isNotNull()))


def with_context(content: Column, titles: Column) -> Column:
    """Content behind its ancestors' non-blank titles, root first."""
    kept = F.filter(titles, lambda t: ~is_blank(t))
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, ": "), F.lit(": "), content)).otherwise(content)


def e5_prefixed(c: Column, is_query: bool | Column = False) -> Column:
    query = is_query if isinstance(is_query, Column) else F.lit(is_query)
    return F.concat(F.when(query, "query: ").otherwise("passage: "), c)


def full_path(path: Column) -> Column:
    return F.array_join(path, " > ")


def link_type(url: Column) -> Column:
    """External, Email, Anchor, Internal or Other; the checks are made in this order."""
    relative = url.startswith("./") | url.startswith("../")
    local = ~url.contains("://") & (url.endswith(".md") | url.endswith(".html") | url.contains("/"))
    return (
        F.when(url.isNull() | (url == ""), "Other").when(url.startswith("http://") | url.startswith("https://"), "External")
        .when(url.startswith("mailto:"), "Email").when(url.startswith("#"), "Anchor").when(relative | local, "Internal").otherwise("Other")
    )


def subwords(c: Column, max_length: int = 512) -> Column:
    """Lower-cased words between spaces and line breaks; of words longer than six the windows of four characters, every
    three. At most ``max_length`` - 2, room for the two special tokens."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(c), r"[\n\r\t]", " "), " "), lambda w: w != "")
    cut = F.transform(parts, lambda w: F.when(F.length(w) <= 6, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w), F.lit(3)), lambda i: F.substring(w, i, F.lit(4)))))
    return F.slice(F.flatten(cut), 1, max_length - 2)


def subword_ids(c: Column, max_length: int = 512) -> Column:
    """Struct of input_ids and attention_mask: 101, hashed ids from 1000 to 29999, 102 if there is room, zeros.

    The hash is xxhash64, so ids are the same in every process.
    """
    return let(subwords(c, max_length), lambda parts: _ids(parts, max_length))


def _ids(parts: Column, max_length: int) -> Column:
    ids = F.transform(parts, lambda w: (F.pmod(F.xxhash64(w), F.lit(29000)) + 1000).cast("int"))
    full = F.concat(F.array(F.lit(101)), ids, F.when(F.size(parts) < max_length - 2, F.array(F.lit(102))).otherwise(F.array().cast("array<int>")))
    used = F.size(full)
    pad = F.array_repeat(F.lit(0), F.lit(max_length) - used)
    return F.struct(F.concat(full, pad).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), used), pad).alias("attention_mask"))
