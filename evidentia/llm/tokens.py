"""Sizes of texts in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import cut

#: Where the vocabulary is read from, on every executor; a parameter of all functions here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's own pattern for cutting a text before pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, id_col: str, text_col: str, *, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens, and the columns `keep`), written once: a row per usable id.

    Null ids and texts, and texts without tokens, give no row. A repeated id
    counts once, with its row of most tokens. A column of `keep` named id or
    tokens gets `_kept` added.
    """

    def run(batches):
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) for t in batch.column("text").to_pylist()], pa.int64())
            columns = [batch.column(c) if c != "text" else sizes for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, [c if c != "text" else "tokens" for c in batch.schema.names])

    source = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)], F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    sized = source.mapInArrow(run, ", ".join([*fields, "tokens long"]))
    once = sized.groupBy("id").agg(F.max(F.struct("tokens", *[f"kept_{k}" for k in range(len(keep))])).alias("row")).select("id", "row.*")
    return cut(once.withColumnsRenamed({f"kept_{k}": f"{c}_kept" if c in ("id", "tokens") else c for k, c in enumerate(keep)}), "tokens")
