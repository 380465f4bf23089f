"""Structured Streaming form of the example builder.

Perturbation, prompts and per-pair token deltas are stateless row functions
with keyed draws, so the streaming plan is the batch plan: new source pairs
arriving in a folder become two example rows each, written exactly once to a
file sink. No state store is involved and no watermark is needed. Progress is
kept in a checkpoint folder under the session's ``spark.checkpoint.dir`` (a
shared location on a cluster), so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pairshift.functions.perturb import DEFAULT_NOISE_P, DEFAULT_P_SWITCH
from pairshift.operators.build import build_examples, perturbed_pairs, prompt_pairs
from pairshift.operators.tokens import pair_token_deltas
from pairshift.session import ensure_checkpoint_dir

PAIR_SOURCE_SCHEMA = T.StructType([
    T.StructField("pair_id", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("a_clean", T.StringType()),
    T.StructField("a_insert", T.StringType()),
    T.StructField("b_clean", T.StringType()),
    T.StructField("b_insert", T.StringType()),
    T.StructField("label", T.StringType()),
])


def stream_pairs(spark: SparkSession, source_dir: str, schema: T.StructType = PAIR_SOURCE_SCHEMA,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of source pairs from Parquet files landing in ``source_dir``."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def start_examples_stream(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    task: str = "nli",
    clean_lang: str = "fr",
    insert_lang: str = "en",
    seed=42,
    p_switch: float = DEFAULT_P_SWITCH,
    noise_p: float = DEFAULT_NOISE_P,
    checkpoint_location: str | None = None,
    available_now: bool = True,
):
    """Start the streaming build; returns the ``StreamingQuery``.

    ``available_now`` processes everything present and stops (batch-like
    catch-up); otherwise the query keeps running on a 10 s trigger.
    """
    ckpt = checkpoint_location or os.path.join(ensure_checkpoint_dir(spark), f"examples-stream-{uuid.uuid4().hex}")
    ex = build_examples(stream_pairs(spark, source_dir), task, clean_lang, insert_lang, seed=seed,
                        p_switch=p_switch, noise_p=noise_p)
    w = ex.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(out_dir)


def start_deltas_stream(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    task: str = "nli",
    dataset: str = "stream",
    tokenizer="simple",
    seed=42,
    checkpoint_location: str | None = None,
    available_now: bool = True,
):
    """M2 per pair on a stream: both twins of a pair are derived from the same
    source row, so the token deltas need no pairing state."""
    ckpt = checkpoint_location or os.path.join(ensure_checkpoint_dir(spark), f"deltas-stream-{uuid.uuid4().hex}")
    pp = prompt_pairs(perturbed_pairs(stream_pairs(spark, source_dir), seed=seed), task, dataset)
    d = pair_token_deltas(pp, tokenizer)
    w = d.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(out_dir)
