"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts, fitted on a bounded sample and then frozen. A symbol
unseen in a context escapes (method D) to the next shorter one, whose distribution is renormalized over the
symbols that the longer context doesn't hold, so every context gives a true distribution and the sum of
-log2 p over a text is an exact code length. The language of least code length wins.

As the statistics are frozen, the cost of (context node, symbol, language) is one table, and finding the node
of a position is a walk of at most ``order`` steps: both are vectorized over whole batches of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.base import fresh, mapped, remainder

ORDER = 4
_SEGMENT = 1 << 18
#: Costs that all nodes, symbols and languages may make up: 64 MB.
MAX_COSTS = 1 << 24


@dataclass
class PpmModel:
    langs: list[str]
    lut: np.ndarray  # byte -> symbol
    child: np.ndarray  # (2 * nodes * symbols): the node one byte further back; the second half stands still
    cost: np.ndarray  # (nodes * symbols, languages): bits
    symbols: int

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language, whole texts."""
        total = np.zeros((len(texts), len(self.langs)))
        group: list[bytes] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), _SEGMENT):
                lead = text[max(0, at - ORDER) : at]
                group.append(b" " * (ORDER - len(lead)) + lead + text[at : at + _SEGMENT])
                owner.append(i)
                size += len(group[-1])
                if size > _SEGMENT:
                    self._add(group, owner, total)
                    group, owner, size = [], [], 0
        if group:
            self._add(group, owner, total)
        return total

    def _add(self, group: list[bytes], owner: list[int], total: np.ndarray) -> None:
        sym = self.lut[np.frombuffer(b"".join(group), np.uint8)]
        ends = np.cumsum([len(x) for x in group])
        node = np.zeros(len(sym), np.int32)
        for k in range(1, ORDER + 1):
            node[k:] = self.child[node[k:] * self.symbols + sym[:-k]]
        half = len(self.child) // (2 * self.symbols)
        node[node >= half] -= half
        costs = self.cost[node * self.symbols + sym]
        starts = np.concatenate([[0], ends[:-1]])
        for k in range(ORDER):
            costs[starts + k] = 0
        np.add.at(total, np.array(owner), np.add.reduceat(costs, starts, axis=0, dtype=np.float64))


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ORDER + 1 bytes as integers, and how often each occurs."""
    raw = np.frombuffer(b"".join(b" " * ORDER + t for t in texts), np.uint8).astype(np.int64)
    key = np.zeros(len(raw) - ORDER, np.int64)
    for k in range(ORDER + 1):
        key = (key << 8) | raw[k : len(raw) - ORDER + k]
    ends = np.cumsum([len(t) + ORDER for t in texts])[:-1]
    keep = np.ones(len(key), bool)
    for k in range(1, ORDER + 1):  # those that reach over a text's start
        keep[ends[ends - k < len(key)] - k] = False
    return np.unique(key[keep], return_counts=True)


def _prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 600, all_docs: int = 20_000, max_nodes: int = 8192) -> PpmModel:
    """A model from rows whose crc32(id) mod 3 is not 1, with text and language.

    ``sample_docs`` and ``all_docs`` bound the sample: about so many documents of each language and of all together, chosen by
    a hash of the id, each read whole; so what reaches the driver is bounded however many languages there are. ``max_nodes``
    bounds the tree: the most frequent contexts stay, fewer where the tables of many languages would exceed MAX_COSTS
    numbers; a context left out costs what the next shorter one says.
    Null texts, languages and ids teach nothing. Without any usable row the model knows no language.
    """
    usable = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(
        F.col("t").isNotNull() & F.col("l").isNotNull() & (remainder("i", 3) != 1)
    )
    sizes = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return PpmModel([], np.zeros(256, np.int32), np.zeros(2, np.int32), np.zeros((1, 0), np.float32), 1)
    share = F.pmod(F.xxhash64(F.col("i"), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for lang in langs:
        chosen = chosen | ((F.col("l") == lang) & (share < min(1.0, min(sample_docs, all_docs / len(langs)) / sizes[lang])))

    def count(batches):
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(_prepared(text))
            for lang, texts in by.items():
                key, n = _grams(texts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], ["l", "key", "n"])

    grams = mapped(usable.where(chosen).select("l", "t"), count, "l string, key long, n long").groupBy("l", "key").agg(F.sum("n").alias("n"))
    got = grams.toArrow()
    which = np.searchsorted(np.array(langs), np.array(got.column("l").to_pylist(), dtype=object).astype(str)) if got.num_rows else np.zeros(0, int)
    return _compile(langs, which, got.column("key").to_numpy(), got.column("n").to_numpy(), max_nodes)


def _compile(langs: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray, max_nodes: int) -> PpmModel:
    n_langs = len(langs)
    shifts = [8 * k for k in range(ORDER + 1)]  # the newest byte comes last
    seen = np.unique(np.concatenate([(key >> s) & 255 for s in shifts])) if len(key) else np.array([32])
    lut = np.full(256, len(seen), np.int32)
    lut[seen] = np.arange(len(seen))
    symbols = len(seen) + 1
    unseen = 256 - len(seen)  # bytes that share the last symbol: it has their room, and each of them costs its part
    max_nodes = min(max_nodes, max(1, MAX_COSTS // (symbols * n_langs)))
    sym = lut[key & 255]
    # contexts of each order with their totals; the most frequent are nodes, a suffix before what extends it
    found = []
    for order in range(1, ORDER + 1):
        ctx, at = np.unique((key >> 8) & ((1 << 8 * order) - 1), return_inverse=True)
        found.append((np.bincount(at, n, len(ctx)), np.full(len(ctx), order), ctx))
    total, orders, ctx = (np.concatenate(x) for x in zip(*found))
    pick = np.lexsort((ctx, orders, -total))[: max_nodes - 1]
    nodes = {(0, 0): 0}
    for order, c in zip(orders[pick].tolist(), ctx[pick].tolist()):
        nodes[order, c] = len(nodes)
    size = len(nodes)
    child = np.zeros((2 * size, symbols), np.int32)
    child[:size] = np.arange(size)[:, None] + size
    child[size:] = np.arange(size, 2 * size)[:, None]
    parent = np.zeros(size, int)
    for (order, c), i in nodes.items():
        if order:
            up = nodes[order - 1, c & ((1 << 8 * (order - 1)) - 1)]
            parent[i] = up
            child[up, lut[c >> 8 * (order - 1)]] = i
    prob = np.zeros((size, symbols, n_langs))
    for order in range(ORDER + 1):
        mask = (1 << 8 * order) - 1
        uniq, at = np.unique((key >> 8) & mask, return_inverse=True)
        node = np.array([nodes.get((order, c), -1) for c in uniq.tolist()], int)[at]
        own = np.array([i for (o, _), i in nodes.items() if o == order], int)
        if not len(own):
            continue
        place = np.full(size, -1)
        place[own] = np.arange(len(own))
        use = node >= 0
        counts = np.zeros((len(own), symbols, n_langs))
        np.add.at(counts, (place[node[use]], sym[use], lang[use]), n[use])
        below = prob[parent[own]] if order else np.broadcast_to(np.append(np.full(symbols - 1, 1 / 256), unseen / 256)[None, :, None], (1, symbols, n_langs))
        t = counts.sum(axis=1, keepdims=True)
        q = (counts > 0).sum(axis=1, keepdims=True)
        rest = np.where(counts > 0, 0, below)
        rest_sum = rest.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(counts > 0, (2 * counts - 1) / (2 * t), np.where(rest_sum > 0, q / (2 * t) * rest / rest_sum, 0))
        prob[own] = np.where(t > 0, p, below)
    cost = -np.log2(np.maximum(prob, 1e-12)).astype(np.float32)
    cost[:, -1] += np.log2(max(unseen, 1))
    return PpmModel(langs, lut, child.reshape(-1), cost.reshape(size * symbols, n_langs), symbols)


def identify(docs: DataFrame, model: PpmModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", bits_out: str = "bits_per_byte") -> DataFrame:
    """``docs`` with the predicted language, its posterior under equal priors, and the bits a byte of its code.

    Null texts and texts without a letter give ``und``, score 0 and null bits; so does a model of no language.
    Columns of ``docs`` keep their values; those that bear an output's name are replaced. Each row stands alone:
    repeated rows get equal results, ties go to the language first by name; very long texts are coded whole, and no rows
    give none.
    """
    outs = (lang_out, score_out, bits_out)
    docs = docs.select(*[c for c in docs.columns if c not in outs])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            use = [i for i, t in enumerate(texts) if t and m.langs and any(map(str.isalpha, t))]
            coded = [_prepared(texts[i]) for i in use]
            lang, score, per_byte = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if use:
                bits = m.bits(coded)
                best = bits.argmin(axis=1)
                post = 1 / np.exp2(np.minimum(0, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
                for i, b, p, row, t in zip(use, best.tolist(), post.tolist(), bits, coded):
                    lang[i], score[i], per_byte[i] = m.langs[b], p, float(row[b]) / len(t)
            cols = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(per_byte, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *outs])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mapped(docs, run, f"{fields}, `{lang_out}` string, `{score_out}` double, `{bits_out}` double")


def language_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of each document; a null id is not held out."""
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows)
    held = rows.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return identify(held, model).drop("text")


#: Bits a byte above which a text is no prose of a known language: a uniform choice among 90 symbols.
MAX_BITS = 6.5


def known_language(docs: DataFrame) -> DataFrame:
    """``docs`` without those of no language (null, no letter) or that every learned language codes as noise. Columns stay
    as they are, whatever their names; repeated rows go or stay alike, very long texts are coded whole, no rows give none."""
    model = fit(docs)
    lang, score, bits = (fresh(docs.columns, x) for x in ("_lang", "_score", "_bits"))
    kept = identify(docs, model, lang_out=lang, score_out=score, bits_out=bits)
    return kept.where((F.col(lang) != "und") & (F.col(bits) <= MAX_BITS)).select(*docs.columns)
