"""Texts to vectors: by a model where there is one, else by the deterministic hash vector; each row says which."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.functions.text import e5_prefixed, is_blank
from foliate.operators.vectors import DIMENSION, check_model, hash_vector, model_vectors

Tokenize = Callable[[list[str], int], tuple[np.ndarray, np.ndarray]]


def wordpiece(vocabulary: str, lowercase: bool = True) -> Tokenize:
    """A BERT tokenizer from a ``vocab.txt`` (or the folder that holds one): [CLS], at most ``max_length`` - 2 pieces,
    [SEP], zeros. Each worker loads the file once."""
    path = os.path.join(vocabulary, "vocab.txt") if os.path.isdir(vocabulary) else vocabulary
    if not os.path.isfile(path):
        raise ValueError(f"no vocabulary: {path}")
    loaded: dict[str, object] = {}

    def tokenize(texts: list[str], max_length: int) -> tuple[np.ndarray, np.ndarray]:
        if path not in loaded:
            from tokenizers import BertWordPieceTokenizer

            loaded[path] = BertWordPieceTokenizer(path, lowercase=lowercase)
        ids, mask = np.zeros((len(texts), max_length), np.int64), np.zeros((len(texts), max_length), np.int64)
        for row, (text, coded) in enumerate(zip(texts, loaded[path].encode_batch(texts, add_special_tokens=False))):
            full = [101, *coded.ids[: max_length - 2], 102]
            ids[row, : len(full)] = full
            mask[row, : len(full)] = 1
        return ids, mask

    return tokenize


@dataclass(frozen=True)
class Vectorizer:
    """``model_path`` and ``tokenize`` together name a model; without them vectors are hashed. A missing model file is an
    error at once and a failing inference fails its task: nothing falls back unseen."""

    model_path: str | None = None
    tokenize: Tokenize | None = None
    max_length: int = 512
    dimension: int = DIMENSION
    use_mask: bool = True

    def __post_init__(self):
        if (self.model_path is None) != (self.tokenize is None):
            raise ValueError("a model needs a tokenizer, and a tokenizer a model")
        if self.model_path:
            check_model(self.model_path)

    @classmethod
    def deterministic(cls) -> Vectorizer:
        return cls()

    @classmethod
    def with_paths(cls, model_path: str, vocabulary: str, max_length: int = 512) -> Vectorizer:
        return cls(model_path, wordpiece(vocabulary), max_length)

    @classmethod
    def default(cls, folder: str = "models") -> Vectorizer:
        """The model and vocabulary in their usual places below ``folder``."""
        return cls.with_paths(os.path.join(folder, "multilingual-e5-large.onnx"), os.path.join(folder, "tokenizer"))

    @classmethod
    def short_text(cls, model_path: str | None = None, vocabulary: str | None = None) -> Vectorizer:
        return cls(model_path, wordpiece(vocabulary) if vocabulary else None, 256)

    @classmethod
    def long_text(cls, model_path: str | None = None, vocabulary: str | None = None) -> Vectorizer:
        return cls(model_path, wordpiece(vocabulary) if vocabulary else None, 1024)

    def vectorize(self, texts: DataFrame, text_col: str = "text", is_query: bool = False) -> DataFrame:
        """``texts`` with ``vector`` (float array) and ``vector_source``: model, hash or blank. Blank texts give zeros;
        all others are vectorized behind their prefix. Columns of these names are replaced."""
        rows = texts.drop("vector", "vector_source")
        blank = is_blank(F.col(text_col))
        zeros = F.array_repeat(F.lit(0.0).cast("float"), self.dimension)
        if self.model_path is None:
            vector = hash_vector(e5_prefixed(F.col(text_col), is_query), self.dimension).cast("array<float>")
            return rows.withColumns({"vector": F.when(blank, zeros).otherwise(vector), "vector_source": F.when(blank, "blank").otherwise("hash")})
        prefixed = rows.withColumn("_prefixed", F.when(blank, "").otherwise(e5_prefixed(F.col(text_col), is_query)))
        found = model_vectors(prefixed, self.model_path, self.tokenize, "_prefixed", self.max_length, self.use_mask).drop("_prefixed")
        size = F.size("vector")
        return found.withColumns({"vector": F.when(blank, F.array_repeat(F.lit(0.0).cast("float"), size)).otherwise(F.col("vector")), "vector_source": F.when(blank, "blank").otherwise("model")})
