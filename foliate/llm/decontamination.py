"""Benchmark decontamination by a distributed positional inverted index.

The index is sharded by documents: each segment holds, for some documents, the posting list of every term of theirs, as
places in the segment's words, sorted by term. Segments are rows of a table, written once and independent of any test.
A test phrase is looked up in a segment from its rarest term: that term's postings, less its offset in the phrase, are the
candidate starts; the postings of the next rarest term, less its own offset, are intersected with them, and so on
until no candidate or no term is left. Proximity works the same way with a distance: each term within so many words of
its place. Test phrases go to the segments as a broadcast, in blocks of a bounded size, so neither a large benchmark nor
a frequent term meets all documents in one task, documents are never shuffled by term, and texts are never read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.base import alnum_words, fresh, mapped, written

WINDOW = 8
#: Words of test items in one broadcast block.
BLOCK_WORDS = 200_000
#: Documents of a segment.
SEGMENT_DOCS = 500
#: Words by which a term may stand from its place in a proximity match.
DISTANCE = 2

SEGMENT = "rows binary, ids array<long>, lengths binary, terms array<binary>, starts binary, places binary"


@dataclass
class Phrases:
    """Distinct windows of a block of test items: term numbers of each, -1 beyond its end, and the items that hold it."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def phrases_of(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    """Windows of ``window`` consecutive words; a shorter item is one window, an item without words has none."""
    vocabulary: dict[bytes, int] = {}
    holders: dict[tuple, dict[str, None]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in alnum_words((text or "").encode("utf-8", "replace"))]
        if ids:
            for i in range(max(1, len(ids) - window + 1)):
                holders.setdefault(tuple(ids[i : i + window]), {})[item] = None
    terms = np.full((len(holders), window), -1, np.int64)
    for row, key in zip(terms, holders):
        row[: len(key)] = key
    return Phrases(vocabulary, terms, np.array([len(k) for k in holders], np.int64), [list(v) for v in holders.values()])


def blocks(benchmark: DataFrame, id_col: str, text_col: str, words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, str | None]]]:
    """The items in id order, streamed to the driver in blocks of about ``words`` words. Null ids are left out."""
    block, size = [], 0
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col))
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        size += len(text or "") // 5 + 1
        if size >= words:
            yield block
            block, size = [], 0
    if block:
        yield block


_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(term of each word, distinct terms, words of each text) of a binary array; a null has none."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    folded = texts.buffers()[2].to_pybytes().translate(_FOLD) if texts.buffers()[2] is not None else b""
    flat = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.array(bounds).buffers()[1], pa.py_buffer(folded)])
    parts = pc.ascii_split_whitespace(flat)
    owner, words = pc.list_parent_indices(parts), parts.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.view(pa.binary()), np.bincount(owner.filter(real).to_numpy(), minlength=len(texts))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """Segments of the postings of all terms: a written table. Rows have numbers of their own, those in ``row_col`` if given, beside
    their ids (as longs, null or repeated as they are)."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    kinds = [pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def run(batches):
        for batch in (whole.slice(lo, segment_docs) for whole in batches for lo in range(0, whole.num_rows, segment_docs)):
            term, distinct, lengths = _terms(pc.fill_null(batch.column(2), b""))
            base = np.cumsum(lengths + WINDOW) - lengths - WINDOW  # so no phrase reaches into the next document
            place = np.arange(len(term)) + np.repeat(base - (np.cumsum(lengths) - lengths), lengths)
            order = np.argsort(term, kind="stable")
            starts = np.append(0, np.cumsum(np.bincount(term, minlength=len(distinct))))
            cols = [
                batch.column(0).to_numpy().astype("<i8").tobytes(), batch.column(1).to_pylist(), lengths.astype("<i4").tobytes(), None, starts.astype("<i8").tobytes(),
                place[order].astype("<i4").tobytes() if place.max(initial=0) < 1 << 31 else place[order].astype("<i8").tobytes(),
            ]
            arrays = [pa.array([c], k) if i != 3 else pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct) for i, (c, k) in enumerate(zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return written(mapped(docs.select(row.alias("row"), F.col(id_col).cast("long"), F.col(text_col).cast("binary")), run, SEGMENT), "postings")


class Segment:
    def __init__(self, rows: pa.Scalar, ids: pa.Scalar, lengths: pa.Scalar, terms: pa.Scalar, starts: pa.Scalar, places: pa.Scalar):
        self.rows, self.ids = np.frombuffer(rows.as_py(), "<i8"), ids.values
        self.lengths = np.frombuffer(lengths.as_py(), "<i4").astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.lengths + WINDOW)])
        self.starts, self.terms = np.frombuffer(starts.as_py(), "<i8"), terms.values
        kind = "<i4" if len(places.as_py()) == 4 * int(self.starts[-1]) else "<i8"
        self.places = np.frombuffer(places.as_py(), kind)
        self.counts = np.diff(self.starts)
        # postings of all terms as one sorted list
        self.span = int(self.base[-1]) + WINDOW
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.span + self.places

    def found(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """The phrases of which all terms are here, and for each phrase the terms' numbers here."""
        local = pc.fill_null(pc.index_in(pa.array(list(phrases.vocabulary), pa.binary()), value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        terms = np.append(local, -1)[phrases.terms]
        return np.flatnonzero(((phrases.terms < 0) | (terms >= 0)).all(axis=1)), terms

    def laid(self, phrases: Phrases, distance: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, place of its start, document's place in the segment) of all ways to lay a phrase over a document so that every term of it stands there at most
        ``distance`` words from its place. All phrases go together: from the rarest term of each, then the next rarest."""
        whole, terms = self.found(phrases)
        rarest = np.where(terms[whole] >= 0, self.counts[terms[whole]], np.iinfo(np.int64).max) if len(whole) else np.zeros((0, WINDOW), np.int64)
        order = np.argsort(rarest, axis=1, kind="stable")
        some = np.take_along_axis(rarest, order[:, :1], axis=1)[:, 0] * (2 * distance + 1)
        which, starts, docs, lo = [], [], [], 0
        while lo < len(whole):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(some[lo:]), 1 << 20, side="right")))
            p, left, doc = self._laid(terms[whole[lo:hi]], order[lo:hi], phrases.lengths[whole[lo:hi]], distance)
            which.append(whole[lo:hi][p])
            starts.append(left)
            docs.append(doc)
            lo = hi
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *x]) for x in (which, starts, docs))

    def _laid(self, terms: np.ndarray, order: np.ndarray, lengths: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.take_along_axis(terms, order[:, :1], axis=1)[:, 0]
        n = self.counts[first]
        which = np.repeat(np.arange(len(terms)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[first], n)
        place = self.places[at].astype(np.int64)
        doc = np.searchsorted(self.base, place, side="right") - 1
        shifts = np.arange(-distance, distance + 1)
        left = np.repeat(place - order[which, 0], len(shifts)) + np.tile(shifts, len(place))
        which, doc = np.repeat(which, len(shifts)), np.repeat(doc, len(shifts))
        for r in range(1, terms.shape[1]):
            asked = np.flatnonzero(r < lengths[which])
            j = order[which[asked], r]
            term, wanted, d = terms[which[asked], j] * self.span, left[asked] + j, doc[asked]
            low = np.maximum(wanted - distance, self.base[d])
            high = np.minimum(wanted + distance, self.base[d] + self.lengths[d] - 1)
            stay = np.ones(len(which), bool)
            stay[asked] = (low <= high) & (np.searchsorted(self.keys, term + low) < np.searchsorted(self.keys, term + high, side="right"))
            which, left, doc = which[stay], left[stay], doc[stay]
            if not len(which):
                break
        return which, left, doc


def _segments(batches) -> Iterator[Segment]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Segment(*(c[i] for c in batch.columns))


def indexed(segments: DataFrame) -> DataFrame:
    """(row, id, n_words) of every indexed row."""

    def run(batches):
        for s in _segments(batches):
            yield pa.RecordBatch.from_arrays([pa.array(s.rows), s.ids, pa.array(s.lengths)], ["row", "id", "n_words"])

    return mapped(segments.select("rows", "ids", "lengths", F.array().cast("array<binary>").alias("t"), F.lit(bytes(8)).alias("s"), F.lit(b"").alias("p")), run, "row long, id long, n_words long")


MATCHES = "row long, first array<long>, last array<long>, items array<string>, near array<string>"


def matches(segments: DataFrame, phrases: Broadcast, distance: int | None = None) -> DataFrame:
    """For every row with a match the merged ranges of words in exact matches, the items with an exact one, and those with
    a proximity match within ``distance`` (None: not asked; exact ones are among them)."""
    names, kinds = [x.split()[0] for x in MATCHES.split(", ")], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches):
        test = phrases.value
        for s in _segments(batches):
            which, starts, doc = s.laid(test)
            at = np.argsort(starts, kind="stable")
            which, starts, doc = which[at], starts[at], doc[at]
            hits: dict[int, tuple[list, list, set, set]] = {}
            for d, p, a, b in zip(doc.tolist(), which.tolist(), starts.tolist(), (starts + test.lengths[which]).tolist()):
                first, last, items, _ = hits.setdefault(d, ([], [], set(), set()))
                items.update(test.items[p])
                a, b = a - int(s.base[d]), b - int(s.base[d])
                if last and a <= last[-1]:
                    last[-1] = max(b, last[-1])
                else:
                    first.append(a)
                    last.append(b)
            if distance is not None:
                which, _, doc = s.laid(test, distance)
                for p, d in sorted({*zip(which.tolist(), doc.tolist())}):
                    hits.setdefault(d, ([], [], set(), set()))[3].update(test.items[p])
            cols = [[int(s.rows[d]) for d in hits], *([sorted(h[i]) for h in hits.values()] for i in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return mapped(segments, run, MATCHES)


def search(segments: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", distance: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, n_hit, items, near) of the rows with a match: how many words stand in exact matches, the sorted ids (as strings) of
    the items with one, and of those with a proximity match. One index serves any benchmark; a block of it is one broadcast."""
    context, out = segments.sparkSession.sparkContext, None
    for block in blocks(benchmark, item_col, item_text, block_words):
        found = matches(segments, context.broadcast(phrases_of(block)), distance)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = matches(segments, context.broadcast(phrases_of([])), distance)

    def run(batches):
        for batch in batches:
            row, first, last, items, near = (c.to_pylist() for c in batch.columns)
            hit = []
            for a, b in zip(first, last):
                total, end = 0, 0
                for lo, hi in sorted((lo, hi) for x, y in zip(a, b) for lo, hi in zip(x, y)):
                    total += max(0, hi - max(lo, end))
                    end = max(end, hi)
                hit.append(total)
            merged_items, merged_near = ([sorted({i for x in found for i in x}) for found in part] for part in (items, near))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(hit, pa.int64()), *(pa.array(x, pa.list_(pa.string())) for x in (merged_items, merged_near))], ["row", "n_hit", "items", "near"])

    grouped = out.groupBy("row").agg(*(F.collect_list(c).alias(c) for c in ("first", "last", "items", "near")))  # of a row: one a block
    return mapped(grouped, run, "row long, n_hit long, items array<string>, near array<string>")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", distance: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The id (a long), n_words, n_hit, n_items and items_sha256 of every row, in any order; with a ``distance`` n_near and
    near_sha256 of the items that match within it, exact ones among them.

    A null text has no words; so does an empty one. Very long texts are indexed whole. Ids may be null or repeat: each row
    gets a result of its own. Items of equal id count once, items of a null id never; without items nothing is hit, and a
    table without rows gives none. Other columns of ``docs``, whatever their names, are not read.
    """
    segments = index(docs, id_col, text_col)
    found = search(segments, benchmark, item_col, item_text, distance, block_words)
    digest = lambda c: F.sha2(F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), 256)
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    full = indexed(segments).join(found, "row", "left")
    near = [F.greatest(count(F.col("near")), F.lit(0)).alias("n_near"), digest(F.col("near")).alias("near_sha256")] if distance is not None else []
    return full.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.greatest(count(F.col("items")), F.lit(0)).alias("n_items"), digest(F.col("items")).alias("items_sha256"), *near,
    )


def proximity(docs: DataFrame, benchmark: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(the row's id as a long, item as text), each pair of row and item once: some window of the item can be laid over the
    row so that each of its terms stands at most ``distance`` words from its place, in any order; one word may stand for
    two equal terms. Null ids are kept."""
    segments = index(docs, id_col, text_col)
    found = search(segments, benchmark, item_col, item_text, distance, block_words).select("row", F.explode("near").alias("item"))
    return indexed(segments).join(found, "row").select(F.col("id").alias(id_col), "item")


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return hits(docs, benchmark, distance=DISTANCE).withColumn("contaminated", F.col("n_items") >= 2)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w"
DECONTAMINATION_SQL = f"""
with dw as (select doc_id, row_number() over () as r, {_WORDS} from documents),
bw as (select item_id, {_WORDS} from benchmark where item_id is not null),
bp as (
  select distinct cast(item_id as varchar) as item, least(8, len(w)) as n, w[i + 1:i + 8] as terms, array_to_string(w[i + 1:i + 8], ' ') as phrase
  from bw, unnest(range(greatest(1, len(w) - 7))) as t(i) where len(w) > 0),
sizes as (select distinct n from bp),
dp as (
  select r, s.n, i, array_to_string(w[i + 1:i + s.n], ' ') as phrase
  from dw, sizes s, unnest(range(len(w) - s.n + 1)) as t(i) where len(w) >= s.n),
hit as (select r, dp.n, i, item from dp join bp on dp.phrase = bp.phrase and dp.n = bp.n),
words as (select r, count(distinct i + k) as n_hit from hit, unnest(range(n)) as t(k) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hit) group by r),
places as (select r, w[i + 1] as term, i from dw, unnest(range(len(w))) as t(i)),
lists as (select r, term, list(i) as at, count(*) as n from places group by r, term),
freq as (select term, sum(n) as n from lists group by term),
phrases as (select distinct phrase, terms, n from bp),
parts as (select phrase, n, terms[j + 1] as term, j from phrases, unnest(range(n)) as t(j)),
rare as (
  select phrase, any_value(p.n) as n, arg_min(term, (coalesce(f.n, 0), j)) as term, arg_min(j, (coalesce(f.n, 0), j)) as j
  from parts p left join freq f using (term) group by phrase having min(coalesce(f.n, 0)) > 0),
starts as (
  select distinct phrase, c.n, r, i - j + d as s from rare c join places using (term), unnest(range(-{DISTANCE}, {DISTANCE} + 1)) as t(d)),
laid as (
  select s.phrase, s.r, s.s from starts s join parts p on p.phrase = s.phrase join lists l on l.r = s.r and l.term = p.term
  where len(list_filter(l.at, lambda x: x between s.s + p.j - {DISTANCE} and s.s + p.j + {DISTANCE})) > 0
  group by s.phrase, s.n, s.r, s.s having count(*) = s.n),
near as (
  select r, count(*) as n_near, string_agg(item, ',' order by item) as ids
  from (select distinct r, item from laid join bp using (phrase)) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items.ids, '')) as items_sha256, cast(coalesce(n_near, 0) as bigint) as n_near, sha256(coalesce(near.ids, '')) as near_sha256, coalesce(n_items, 0) >= 2 as contaminated
from dw left join words using (r) left join items using (r) left join near using (r)
"""


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without rows that hold a window of ``window`` words of an item. Items of fewer words, which common words may
    make up, take a row out only where two items match. Null and empty texts stay, repeated rows go or stay alike, very
    long texts are searched whole; all columns stay as they are, whatever their names; no rows give none. ``docs`` must give
    the same rows in the same partitions each time it is read, as tables do: its texts are never written."""
    row = fresh(docs.columns, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    segments = index(numbered, row, text_col, row_col=row)
    found = search(segments, benchmark, item_col, item_text)
    words = F.size(F.regexp_extract_all(F.col(item_text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    short = benchmark.where(words < window).select(F.col(item_col).cast("string").alias("item")).distinct()
    each = found.select("row", F.explode("items").alias("item")).join(short.withColumn("short", F.lit(True)), "item", "left")
    leaks = each.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("short").isNull()).alias("long")).where("long > 0 or n >= 2")
    return numbered.join(leaks.select(F.col("row").alias(row)), row, "left_anti").drop(row)
