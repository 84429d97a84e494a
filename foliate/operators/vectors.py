"""Embedding-ready vectors: pooling, L2 normalization, a deterministic vector of a text, and model inference."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.text import is_blank, let

DIMENSION = 1024


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column) -> Column:
    """``v`` of length 1; a zero vector stays."""

    def scaled(v: Column) -> Column:
        return let(l2_norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))

    return let(v, scaled)


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(l2_normalized(a), l2_normalized(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean_pooled(states: DataFrame, group: str = "id", vector: str = "vec", mask: str | None = None, normalize: bool = True) -> DataFrame:
    """(group, vector): the mean of a group's vectors, weighted by ``mask``; a group of no weight gives zeros.

    Sums are made per (group, place) with map-side partial sums, so a large group is no large task.
    """
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    each = states.select(group, weight.alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = each.groupBy(group, "i").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    mean = sums.select(group, "i", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0).alias("m"))
    pooled = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("vector"))
    return pooled.withColumn("vector", l2_normalized(F.col("vector"))) if normalize else pooled


def pooled(hidden: Column, mask: Column | None = None) -> Column:
    """The same for one text's token vectors in a row: array<array<float>> and an optional array<int>."""
    weights = mask if mask is not None else F.array_repeat(F.lit(1), F.size(hidden))
    return let(F.struct(hidden.alias("h"), weights.alias("m")), lambda x: _pooled(x["h"], x["m"]))


def _pooled(hidden: Column, weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda a, m: a + m)
    zero = F.transform(F.get(hidden, 0), lambda _: F.lit(0.0))
    summed = F.aggregate(F.arrays_zip(hidden.alias("h"), weights.alias("m")), zero, lambda a, x: F.zip_with(a, x["h"], lambda s, v: s + v.cast("double") * x["m"]))
    return l2_normalized(let(total, lambda t: F.transform(summed, lambda s: F.when(t > 0, s / t).otherwise(0.0))))


def hash_vector(text: Column, dimension: int = DIMENSION) -> Column:
    """A unit vector that depends on the text alone: four hashed series in turn, from the text, its lower case, the text
    without spaces and its length; features of the text on the first four places, of its first words on the others.
    Hashes are xxhash64, so values are the same in every process. A blank text gives zeros."""
    kinds = F.array(F.xxhash64(text), F.xxhash64(F.lower(text)), F.xxhash64(F.replace(text, F.lit(" "), F.lit(""))), F.xxhash64(F.length(text)))
    words = F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: w != "")
    n = F.size(words)
    chars = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    features = (
        F.least(F.length(text) / 1000, F.lit(1.0)), F.least(n / 100, F.lit(1.0)), F.least(F.size(F.array_distinct(F.split(text, ""))) / 50, F.lit(1.0)),
        F.when(n > 0, chars / n / 10).otherwise(0.0),
    )
    hits = F.transform(F.slice(words, 1, dimension // 20), lambda w: F.pmod(F.xxhash64(w), F.lit(dimension - 20)) + 20)
    parts = F.struct(kinds.alias("k"), hits.alias("h"), F.array(*features).alias("f"))

    def vector(b: Column) -> Column:
        def value(i: Column) -> Column:
            noise = F.pmod(F.xxhash64(F.get(b["k"], i % 4), i), F.lit(1 << 53)) / float(1 << 52) - 1
            extra = F.when(i < 4, F.get(b["f"], i) * 0.1).otherwise(F.size(F.filter(b["h"], lambda h: h == i)) * 0.03)
            return noise + extra

        return l2_normalized(F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), value))

    return F.when(is_blank(text), F.array_repeat(F.lit(0.0), dimension)).otherwise(let(parts, vector))


def check_model(path: str) -> None:
    """ValueError unless ``path`` is an .onnx file of 1 MB to 10 GB."""
    if not path.endswith(".onnx") or not os.path.isfile(path):
        raise ValueError(f"no .onnx file: {path}")
    if not 1 << 20 <= os.path.getsize(path) <= 10 << 30:
        raise ValueError(f"the model's size is out of range: {path}")


#: Names of outputs that hold token vectors, in the order of preference.
OUTPUTS = ("last_hidden_state", "hidden_states", "encoder_outputs", "output", "logits")


def chosen_output(names: list[str]) -> str:
    """The first of OUTPUTS that the model has, whatever its case, else the model's first output."""
    by_low = {n.lower(): n for n in reversed(names)}
    return next((by_low[o] for o in OUTPUTS if o in by_low), names[0])


def model_vectors(texts: DataFrame, model_path: str, tokenize: Callable[[list[str], int], tuple[np.ndarray, np.ndarray]], text_col: str = "text", max_length: int = 512, use_mask: bool = True) -> DataFrame:
    """``texts`` with ``vector``, inferred by an ONNX model that the executors can open; a failure fails the task.

    ``tokenize`` gives ids and mask, both (texts, max_length). Each worker opens the model once. The output that
    ``chosen_output`` names is pooled over the mask, or over all places without ``use_mask``.
    """
    check_model(model_path)
    columns = texts.columns

    def run(batches):
        import onnxruntime

        session = onnxruntime.InferenceSession(model_path)
        wanted = {i.name for i in session.get_inputs()}
        names = [o.name for o in session.get_outputs()]
        out = chosen_output(names)
        for batch in batches:
            ids, mask = tokenize(batch[text_col].fillna("").tolist(), max_length)
            feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            hidden = session.run([out], {k: v for k, v in feed.items() if k in wanted})[0]
            weight = mask[:, :, None] if use_mask else np.ones_like(mask)[:, :, None]
            v = (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
            yield batch.assign(vector=list(v.astype(np.float32)))

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema)
    return texts.select(*columns).mapInPandas(run, f"{fields}vector array<float>")
