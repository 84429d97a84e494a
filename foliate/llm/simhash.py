"""SimHash near-duplicates found through a covering code.

A fingerprint's 64 bits are two halves of 32. Fingerprints that differ in at most 3 bits differ in at most one bit of
some half. On a half, the anchors are the words of the perfect Hamming code of length 31 on its lower bits, with any
highest bit: a covering code of radius 1, so each half has one home anchor within 1. A fingerprint is replicated to
every anchor within the radius plus the threshold of the half, 1 + 1 = 2 (17 anchors, or 2 for a word of the code);
whoever is at most one bit away in this half has its home among them. Per anchor, homes are compared with replicas.

Only distinct fingerprints go through this. An anchor with many homes is cut into tiles of homes x replicas; each
tile returns a spanning forest of its links, so rows grow with members and not with pairs. Components are found by
alternating large-star and small-star steps over tables in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.base import fresh, joined_to_one, mapped, merged, space_words, written

THRESHOLD = 3
TILE = 2048
KIND = 40
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is set if it is in over half of the shingles' XXH64; no words give zero."""
    words = space_words(text)
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], "<u8")
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit numbers."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """``docs`` with the fingerprint of each row as a (signed) long. A null text has none: zero."""
    names = [c for c in docs.columns if c != out]
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint((t or "").encode("utf-8", "replace"), shingle) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got.view(np.int64))], [*names, out])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema)
    return mapped(docs.select(*names), run, f"{fields}`{out}` long")


#: Of the Hamming code, position i (1 to 31) has the check value i: for each value, the pairs of positions that make it.
_CHECKS = np.array([sum(1 << (i - 1) for i in range(1, 32) if i >> b & 1) for b in range(5)], np.uint64)
_PAIRS = np.array([[0] * 15] + [[1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i ^ s > i] for s in range(1, 32)], np.uint64)
_SINGLE = np.array([0] + [1 << (i - 1) for i in range(1, 32)], np.uint64)
_TOP = np.uint64(1 << 31)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place in ``fps``, home) of all anchors within 2 of either half; an anchor carries its half's number."""
    out = []
    every = np.arange(len(fps))
    for which in range(2):
        half = fps >> np.uint64(32 * which) & np.uint64(0xFFFFFFFF)
        value = sum(((np.bitwise_count(half & c) & 1) << b for b, c in enumerate(_CHECKS)), np.zeros(len(fps), np.int64))
        home = half ^ _SINGLE[value]
        off = np.flatnonzero(value)  # a word of the code has no other within 2 but by its highest bit
        tag = np.uint64(which << 33)
        out.append((home | tag, every, np.ones(len(fps), bool)))
        out.append((home ^ _TOP | tag, every, np.zeros(len(fps), bool)))
        out.append(((half[off, None] ^ _PAIRS[value[off]]).reshape(-1) | tag, np.repeat(off, 15), np.zeros(15 * len(off), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def anchored(fps: DataFrame) -> DataFrame:
    """(anchor, fp, home) for the distinct fingerprints in column ``fp``, of each ``kind`` apart: an anchor carries it above KIND bits."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            anchor, at, home = anchors(fp.view(np.uint64))
            anchor = anchor | batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)[at] << np.uint64(KIND)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[at]), pa.array(home)], ["anchor", "fp", "home"])

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(fps.select("fp", "kind").repartition(parts, "fp"), run, "anchor long, fp long, home boolean")


def _forest(homes: np.ndarray, all_: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links between ``homes`` and ``all_`` connect, one a member at most."""
    members = np.union1d(homes, all_)
    label = np.arange(len(members))
    h, r = np.searchsorted(members, homes), np.searchsorted(members, all_)
    near = np.bitwise_count(homes[:, None] ^ all_[None, :]) <= threshold
    a, b = np.nonzero(near)
    a, b = h[a], r[b]
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(members)))
    return members[moved], members[label[moved]]


def _compare(threshold: int):
    def links(anchor, tile, fp, home):
        """Of whole groups of (anchor, tile)."""
        edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1])) + 1
        bounds = np.concatenate([[0], edge, [len(anchor)]])
        sizes = np.diff(bounds)
        n_home = np.add.reduceat(home.astype(np.int64), bounds[:-1]) if len(anchor) else np.zeros(0, int)
        left, right, kind = [], [], []
        small = (n_home > 0) & (sizes > 1) & (sizes * n_home <= 64)
        if small.any():  # few pairs each: all groups at once
            rows = np.flatnonzero(np.repeat(small, sizes) & home)
            group = np.searchsorted(bounds, rows, side="right") - 1
            k = sizes[group]
            a = np.repeat(rows, k)
            b = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(bounds[group], k)
            hit = (fp[a] != fp[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= threshold)
            left.append(fp[a[hit]])
            right.append(fp[b[hit]])
            kind.append(anchor[a[hit]] >> KIND)
        for g in np.flatnonzero((n_home > 0) & (sizes > 1) & (sizes * n_home > 64)).tolist():
            own = slice(bounds[g], bounds[g + 1])
            homes = fp[own][home[own]]
            step = max(16, min(256, 4_000_000 // int(sizes[g])))
            for at in range(0, len(homes), step):
                x, y = _forest(np.unique(homes[at : at + step]), np.unique(fp[own]), threshold)
                left.append(x)
                right.append(y)
                kind.append(np.full(len(x), anchor[bounds[g]] >> KIND))
        return (np.concatenate(left), np.concatenate(right), np.concatenate(kind)) if left else (fp[:0], fp[:0], anchor[:0])

    def run(batches):
        held = None
        for batch in merged(batches, 50_000):
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[2] = cols[2].view(np.uint64)  # a signed number's bits are counted without its sign
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            changed = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            cut = int(changed[-1]) + 1 if len(changed) else 0  # the last group may go on
            held = [c[cut:] for c in cols]
            if cut:
                a, b, k = links(*(c[:cut] for c in cols))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(k, pa.int32())], ["u", "v", "kind"])
        if held is not None and len(held[0]):
            a, b, k = links(*held)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(k, pa.int32())], ["u", "v", "kind"])

    return run


def links(fps: DataFrame, threshold: int = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(u, v, kind), u > v: links that connect the same fingerprints as all pairs at most ``threshold`` (up to 3) bits apart, of
    each ``kind`` (a number below 2**20, if there is such a column) apart."""
    rows = anchored(fps if "kind" in fps.columns else fps.withColumn("kind", F.lit(0)))
    crowded = rows.where("home").groupBy("anchor").count().where(F.col("count") > tile).select("anchor", F.ceil(F.col("count") / tile).cast("int").alias("g"))
    rows = rows.join(crowded, "anchor", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    # tile (i, j) holds the i-th part of the homes and the j-th part of all members
    own = F.pmod(F.hash("fp"), F.col("g"))
    every = F.sequence(F.lit(0), F.col("g") - 1)
    as_member = F.transform(every, lambda i: F.struct((i * F.col("g") + own).alias("tile"), F.lit(False).alias("home")))
    as_home = F.transform(every, lambda j: F.struct((own * F.col("g") + j).alias("tile"), F.lit(True).alias("home")))
    places = F.when(F.col("g") == 1, F.array(F.struct(F.lit(0).alias("tile"), F.col("home").alias("home")))).otherwise(F.when(F.col("home"), F.concat(as_member, as_home)).otherwise(as_member))
    rows = rows.select("anchor", "fp", F.explode(places).alias("p")).select("anchor", F.col("p.tile").alias("tile"), "fp", F.col("p.home").alias("home"))
    rows = rows.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile")
    found = mapped(rows, _compare(threshold), "u long, v long, kind int")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "kind").where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge (u, v), root being the least node that it reaches.

    Large-star ties a node's larger neighbours to the least of all, small-star the smaller ones; both keep
    components and end in stars after a logarithmic number of rounds.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = joined_to_one(both.where("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = joined_to_one(large, low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(rows: DataFrame, id_col: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """(fp, least, n), a written table: for each fingerprint in ``rows`` (id, fp) the least id that its component holds, nulls
    last, and how many rows have the fingerprint."""
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    ties = written(components(links(nodes.select("fp"), threshold)), "components")
    inner = ties.join(nodes, ties["node"] == nodes["fp"]).select("fp", "root", "least")
    best = inner.groupBy("root").agg(F.min("least").alias("best"))
    tied = inner.join(best, "root").select(F.col("fp"), F.col("best"))
    least = F.when(F.col("best").isNotNull(), F.col("best")).otherwise(F.col("least"))
    return written(nodes.join(tied, "fp", "left").select("fp", least.alias("least"), "n"), "least")


def simhash_query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id. Null and empty texts share fingerprint zero, very long ones are read whole. A null
    id is never the least unless all of its component are null: then component_id is null. Repeated rows stay, in one
    component; of ties the least id names it. No rows give none; other columns, whatever their names, are not read."""
    rows = written(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    least = near_duplicates(rows)
    return joined_to_one(rows, least, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


#: Fingerprints of a row by which the pipeline links: by as many independent hashes of the same shingles.
SIGNALS = 3


def signals(text: bytes, shingle: int = 3, n: int = SIGNALS) -> list[int]:
    """The fingerprint, and others made the same way from other hashes of the same shingles."""
    words = space_words(text)
    if not words:
        return [0] * n
    size = max(1, len(words) - shingle + 1)
    parts = [b" ".join(words[i : i + shingle]) for i in range(size)]
    out = [_majority(np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], "<u8"))]
    for seed in range(1, n, 2):  # one hash of 128 bits makes two
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p, seed) for p in parts]), "<u8").reshape(-1, 2)
        out += [_majority(both[:, 0].copy()), _majority(both[:, 1].copy())]
    return out[:n]


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = SIGNALS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the least id, nulls last; of equal ids the first row.

    Rows are linked if any of ``n`` fingerprints, each of independent hashes of their three-word shingles, differ in three
    bits at most: edits that happen to move one fingerprint too far rarely move all. Groups are what links connect. Null and
    empty texts are one group, very long texts are read whole, repeated rows are one group each. All columns stay
    as they are, whatever their names; no rows give none. ``docs`` must give the same rows in the same partitions each time
    it is read, as tables do: its texts are read twice and never written.
    """
    row = fresh(docs.columns, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    names = [f"fp{k}" for k in range(n)]

    def run(batches):
        for batch in batches:
            got = np.array([signals(t or b"", n=n) for t in batch.column(2).to_pylist()], np.uint64).reshape(-1, n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(got[:, k].copy().view(np.int64)) for k in range(n))], ["r", "i", *names])

    source = numbered.select(F.col(row).alias("r"), F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    kind = source.schema["i"].dataType.simpleString()
    rows = written(mapped(source, run, f"r long, i {kind}, {', '.join(f'{x} long' for x in names)}"), "fingerprints")
    # nodes: rows of equal fingerprints, and each fingerprint of a kind that leads from one such node to another
    order = F.struct(F.col("i").isNull().alias("n"), F.col("i").alias("i"), F.col("r").alias("r"))
    nodes = written(rows.groupBy(*names).agg(F.min(order).alias("least")).withColumn("node", F.xxhash64(F.lit(-1), *names)), "nodes")
    each = nodes.select("node", F.posexplode(F.array(*names)).alias("kind", "fp"))
    found = written(each.groupBy("kind", "fp").agg(F.count(F.lit(1)).alias("n")), "distinct")
    tied = written(links(found.select("kind", "fp")), "links")
    ends = [tied.select("kind", F.col(c).alias("fp")) for c in ("u", "v")]
    leads = found.where("n > 1").select("kind", "fp").unionByName(ends[0]).unionByName(ends[1]).distinct()
    number = lambda c: F.xxhash64("kind", c)
    edges = each.join(leads, ["kind", "fp"]).select(F.col("node").alias("u"), number("fp").alias("v")).unionByName(tied.select(number("u").alias("u"), number("v").alias("v")))
    ties = components(edges)
    rooted = nodes.join(ties, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.r").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
