"""Quality rules whose cutoffs are chosen by risk control on labelled documents.

A text is rejected if any of its measures, all from 0 to 1, exceeds the cutoff of its stratum (language): one cutoff for
the largest of them. For each cutoff of a fixed grid the labelled good documents that it would reject are counted. The
cutoffs are tested in a fixed order, from the highest down (fixed-sequence testing), and the first whose exact
(Clopper-Pearson) upper bound of false rejections, at the level ``delta`` divided by the number of strata, is above
``alpha`` ends the test. The last cutoff before it is used; a stratum without one rejects nothing, and says so. By
the union bound over strata, with probability 1 - ``delta`` none loses more than ``alpha`` of its good documents.
"""

from __future__ import annotations

from collections import Counter
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm.base import mapped, written

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_LETTERS = bytes(b for b in range(256) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
_DIGITS = bytes(b for b in range(256) if not 0x30 <= b <= 0x39)

#: Measures, each a fraction of its own whole, so that 0 to 1 is the range of all.
RULES = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "shout_rate", "digit_rate", "one_word_rate")
_WIDE = 2_000_000
GRID = tuple(round(0.02 * i, 2) for i in range(1, 50))

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{r} double" for r in RULES)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    if n < 60:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        hit = set()
        for i, w in enumerate(windows):
            if seen[w] > 1:
                hit.update((i, i + 1, i + 2))
        return len(hit)
    put = ids.setdefault
    w = np.array([put(x, len(ids)) for x in words], np.int64)
    v = len(ids)
    pair = w[:-1] * v + w[1:]
    if v >= _WIDE:  # three ids no longer fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * v + w[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def measures(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    letters = len(raw.translate(None, _LETTERS))
    rate = lambda a, b: a / b if b else 0.0
    return (
        n, chars, symbols, dups, repeats,
        min(1.0, rate(symbols, chars)), rate(dups, len(lines)), rate(repeats, n), rate(len(raw.translate(None, _UPPER)), letters),
        min(1.0, rate(text.count("!"), n)), min(1.0, rate(len(raw.translate(None, _DIGITS)), chars)), rate(sum(1 for x in words if len(x) == 1), n),
    )


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the measures. A null text has no words and all measures zero. Columns of a
    measure's name are replaced."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    keep = [c for c in docs.columns if c not in names and c != text_col]
    rows = docs.select(*keep, text_col)

    def run(batches):
        for batch in batches:
            got = [measures(t) for t in batch.column(len(keep)).to_pylist()]
            cols = list(zip(*got)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *(pa.array(c, pa.int64() if i < 5 else pa.float64()) for i, c in enumerate(cols))], [*keep, *names]
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != text_col)
    return mapped(rows, run, fields + MEASURES)


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the p at which k or fewer of n have the probability ``level``."""
    if n == 0 or k >= n:
        return 1.0
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - np.arange(k)) / np.arange(1, k + 1)))])
    i = np.arange(k + 1)
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        terms = logs + i * np.log(p) + (n - i) * np.log1p(-p) if 0 < p < 1 else np.full(k + 1, -np.inf)
        top = terms.max()
        if top + np.log(np.exp(terms - top).sum()) > np.log(level) if np.isfinite(top) else False:
            lo = p
        else:
            hi = p
    return hi


def cutoffs(counts: dict[str, tuple[int, list[list[int]]]], alpha: float = 0.02, delta: float = 0.05) -> dict[str, list[float | None]]:
    """For each stratum the cutoff of each rule or None. ``counts``: of a stratum, the labelled good documents, and
    for each rule how many of them each cutoff of GRID rejects. Rules share ``alpha`` and ``delta`` evenly; a rule's cutoffs
    are one sequence of tests."""
    out: dict[str, list[float | None]] = {}
    for stratum, (n, rejected) in counts.items():
        level, share = delta / (len(counts) * len(rejected)), alpha / len(rejected)
        out[stratum] = []
        for row in rejected:
            passed = takewhile(lambda x: x[1] <= n * share and upper_bound(x[1], n, level) <= share, zip(reversed(GRID), reversed(row)))
            out[stratum].append(min((c for c, _ in passed), default=None))
    return out


def worst() -> Column:
    """The largest measure: what the one cutoff of a stratum is held against."""
    return F.greatest(*RULES)


def calibrated(rows: DataFrame, labels: DataFrame, stratum: str, alpha: float = 0.02, delta: float = 0.05) -> dict[str, float | None]:
    """Cutoffs from the measures of labelled documents: all of them are the holdout, as nothing else is fitted (rules and grid are
    fixed beforehand). Equal texts of a stratum count once, since copies are no independent cases; ``rows`` have a hash of
    the text in ``key``. A document labelled more than once is good if no label says otherwise; labels without an id or
    quality, and null ids, teach nothing. Strata go to the driver, one row each."""
    said = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = rows.join(said.where(F.col("quality") == 1), "doc_id").groupBy(stratum, "key").agg(*(F.first(r).alias(r) for r in RULES))
    over = [F.count_if(worst() > c).alias(str(i)) for i, c in enumerate(GRID)]
    got = good.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *over).collect()
    return {k: c for k, (c,) in cutoffs({r["stratum"]: (r["n"], [[r[str(i)] for i in range(len(GRID))]]) for r in got}, alpha, delta).items()}


def quality_query(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, the rates and the cutoff: null where none could be certified and
    the base rule decides alone. A null language is a stratum of its own, a null or empty text has no words, very long
    ones are measured whole; a measure that equals the cutoff passes. Repeated rows are judged each; no rows give none, no
    labels no cutoffs. Other columns, whatever their names, are not read."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = written(measured(docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), key.alias("key"), "text")), "measures")
    chosen = calibrated(rows, labels.select("doc_id", "quality"), "stratum", alpha, delta)
    table = docs.sparkSession.createDataFrame([(k, c) for k, c in sorted(chosen.items()) if c is not None], "stratum string, cutoff double")
    rows = rows.join(F.broadcast(table), "stratum", "left")  # a row a language, from the driver
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.coalesce(worst() > F.col("cutoff"), F.lit(False))).alias("kept"), *RULES, "cutoff",
    )
