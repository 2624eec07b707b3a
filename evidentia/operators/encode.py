"""Texts as vectors: an encoder is a parameter; the default needs no model's weights."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators.rerank import DIM, _token_vectors


class Encoder(Protocol):
    """Gives a row of `dim` numbers for each text of an Arrow batch; `tokens` are its words. It is sent to the executors."""

    dim: int

    def __call__(self, texts: pa.Array, tokens: pa.ListArray) -> np.ndarray: ...


class HashEncoder:
    """The mean of the unit vectors that MD5 gives for a text's words: the same in every engine."""

    dim = DIM

    def __init__(self):
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, texts: pa.Array, tokens: pa.ListArray) -> np.ndarray:
        coded = tokens.flatten().dictionary_encode()
        vectors = _token_vectors(coded.dictionary.to_pylist(), self.known)
        lengths = tokens.value_lengths().to_numpy(zero_copy_only=False)
        row, word = np.repeat(np.arange(len(tokens)), lengths), coded.indices.to_numpy(zero_copy_only=False)
        sums = np.stack([np.bincount(row, vectors[word, j], len(tokens)) for j in range(DIM)], axis=1)
        return sums / lengths[:, None]


def encode(rows: DataFrame, key: str, text: str, encoder: Encoder | None = None) -> DataFrame:
    """(key, v) of every text with a word: its vector, of length 1.

    Texts that are null or have no word, and texts whose vector has no length,
    have no row. Keys are taken as they are, with repeats. Whole texts are read.
    """
    encoder = encoder or HashEncoder()
    worded = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), X.tokenize(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)

    def batches(arrived):
        for batch in arrived:
            if not batch.num_rows:
                continue
            v = np.asarray(encoder(batch.column("text"), batch.column("tokens")), np.float64)
            length = np.sqrt((v * v).sum(axis=1))
            good = np.isfinite(length) & (length > 0)
            unit = v[good] / length[good][:, None]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), encoder.dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("key").filter(pa.array(good)), lists], ["key", "v"])

    kind = worded.schema["key"].dataType.simpleString()
    return worded.mapInArrow(batches, f"key {kind}, v array<double>").withColumnRenamed("key", key)


def item_id(key: Column) -> Column:
    """A number for a text key: the first 15 hexadecimal digits of its MD5; the order of ties among vectors of chunks."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
