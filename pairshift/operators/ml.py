"""Model hooks.

The transformer models of the original (generation, hidden states,
fine-tuning) run on one machine and stay outside Spark; their outputs enter as
tables. What runs here is distributed: a subword tokenizer applied through an
Arrow-batched iterator UDF (loaded once per Python worker) and an arbitrary
predictor applied per partition with ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def subword_tokenizer(tokenizer_json: str, add_special_tokens: bool = True) -> Callable[[Column], Column]:
    """A ``tokenizers`` tokenizer file as a Column -> array<string> (token ids as strings).

    The file must be readable from every executor (shared storage). The
    tokenizer is loaded once per Python worker and applied to Arrow batches.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_json)
        for s in batches:
            enc = tok.encode_batch(s.fillna("").tolist(), add_special_tokens=add_special_tokens)
            yield pd.Series([[str(i) for i in e.ids] for e in enc])

    return lambda c: _ids(c)


def predict(df: DataFrame, fn: Callable[[pd.Series], pd.Series], prompt_col: str = "prompt",
            out_col: str = "prediction") -> DataFrame:
    """Apply a user predictor (prompts -> texts) to every row, batch by batch.

    ``fn`` runs inside the executors on pandas batches; the result keeps every
    input column plus ``out_col``.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b[out_col] = list(fn(b[prompt_col].fillna("")))
            yield b

    return df.mapInPandas(run, schema)
