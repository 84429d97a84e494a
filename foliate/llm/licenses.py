"""Fuzzy search for short license notices.

A notice that occurs with at most k edits holds at least one of any k + 1 pieces of itself unchanged (pigeonhole).
The pieces are looked for exactly; around each place the ``regex`` library's bounded-error matching decides whether
the notice is there, with how many edits and where. Texts are folded first: A-Z to a-z, words joined by one
space, so edits count what differs beyond case, punctuation and line breaks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.base import alnum_words, mapped

#: The phrases of the base count and their labels.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

#: Short notices, their labels and the edits allowed. About one edit in twelve characters.
NOTICES = (
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2 0", "apache", 3),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("mozilla public license", "mpl", 1),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("licensed under cc by 4", "cc-by", 0),
    ("creative commons attribution", "cc-by", 2),
    ("all rights reserved", "reserved", 1),
)


def pieces(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """``edits`` + 1 runs that make up the notice, with their places."""
    n, k = len(notice), edits + 1
    cuts = [round(i * n / k) for i in range(k + 1)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=None)
def _matchers(notices: tuple) -> list[tuple]:
    out = []
    for notice, label, k in notices:
        body = regex.escape(notice.encode(), special_only=True)
        out.append((label, len(notice), k, pieces(notice, k), regex.compile(b"(?b)(?:" + body + b"){e<=%d}" % k)))
    return out


def _places(text: bytes, seed: bytes) -> list[int]:
    out, at = [], text.find(seed)
    while at >= 0:
        out.append(at)
        at = text.find(seed, at + 1)
    return out


def fuzzy(folded: bytes, notices: tuple = NOTICES) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of the notices in a folded text, in bytes; of a notice's matches that overlap the one
    of fewer edits, then the first."""
    out = []
    for label, n, k, parts, pattern in _matchers(notices):
        windows = sorted({(max(0, p - at - k), p - at + n + k) for at, seed in parts for p in _places(folded, seed)})
        merged: list[list[int]] = []
        for a, b in windows:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            left = [(a, min(b, len(folded)))]
            while left:  # the best match of a part, then what is before and behind it
                a, b = left.pop()
                if a < b and (m := pattern.search(folded, a, b)):
                    out.append((label, m.start(), m.end(), sum(m.fuzzy_counts)))
                    left += [(a, m.start()), (max(m.end(), m.start() + 1), b)]
    return out


def scan_text(text: str | None, notices: tuple = NOTICES) -> dict:
    words = alnum_words((text or "").encode("utf-8", "replace"))
    folded = b" " + b" ".join(words) + b" "
    base: list[tuple[int, str]] = []
    spaces = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)
    word_at = lambda place: int(np.searchsorted(spaces, place))
    for phrase, label in BASE:
        base += [(word_at(p), label) for p in _places(folded, b" " + phrase + b" ")]
    found = fuzzy(folded, notices)
    # a byte's word: the spaces up to it, less the leading one; a match may begin or end on the space beside a word
    spans = sorted((label, word_at(a + 1) - 1, word_at(b) - (folded[b - 1 : b] == b" "), edits) for label, a, b, edits in found)
    best = max([1.0] * bool(base) + [1 - e / max(1, b - a) for _, a, b, e in found], default=0.0)
    places = [p for p, _ in base]
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted({x for _, x in base})), "labels": ",".join(sorted({x for _, x in base} | {x[0] for x in found})),
        "score": max(0.0, best), "spans": [{"label": x, "word": a, "end": b, "edits": e} for x, a, b, e in spans],
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,word:long,end:long,edits:long>>"


def scan(docs: DataFrame, text_col: str = "text", notices: tuple = NOTICES) -> DataFrame:
    """``docs`` without its text, with what was found; spans are places of words, from 0, ends exclusive.

    A null or empty text has no words and no labels, null places, score 0; very long texts are searched whole. Of a notice's
    overlapping matches that of fewest edits stays, of ties the first; different notices may overlap. Repeated rows are
    scanned each; columns that bear an output's name are replaced; no rows give none.
    """
    kinds = pa.schema([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))),
    ])
    keep = [c for c in docs.columns if c not in kinds.names and c != text_col]
    rows = docs.select(*keep, text_col)

    def run(batches):
        for batch in batches:
            got = [scan_text(t, notices) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array([g[f.name] for g in got], f.type) for f in kinds)], [*keep, *kinds.names])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != text_col)
    return mapped(rows, run, fields + SCHEMA)


def license_query(docs: DataFrame) -> DataFrame:
    out = scan(docs.select("doc_id", "text"))
    return out
