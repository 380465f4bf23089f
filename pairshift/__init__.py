"""pairshift: paired text-robustness analytics on Spark DataFrames.

Build clean/perturbed twins of every record (code-switching + informal noise
with keyed, partition-independent draws), re-group them into pairs, and compute
paired statistics and robustness reports as DataFrame/SQL plans.

The most used entry points are re-exported here; everything takes and returns
DataFrames (or Columns) and runs on whatever SparkSession they belong to.
"""

__version__ = "0.1.0"

from pairshift.functions.labels import parse_nli_label
from pairshift.functions.perturb import with_code_switch, with_informal_noise, with_perturbation
from pairshift.operators.build import (
    build_examples,
    build_from_parallel,
    parallel_zip,
    positions,
    sample_n,
    sample_per_split,
    synthetic_nli,
    synthetic_qa,
)
from pairshift.operators.inspect import counts_by_dim, length_stats, pair_size_histogram, perturbation_rates, show_pairs
from pairshift.operators.pairing import pair_rows
from pairshift.operators.reports import (
    all_results,
    cross_language,
    cross_language_pivot,
    efficiency_summary,
    model_size_lookup,
    paper_table,
)
from pairshift.operators.scoring import (
    accuracy,
    exact_match,
    f1_per_example,
    mean_f1,
    robustness_drop,
    robustness_report,
    scaling_table,
)
from pairshift.operators.tokens import js_divergence, pair_token_deltas, token_histogram, tokenizer_stats
from pairshift.operators.vectors import pool, representation_shift, vector_drift
from pairshift.session import build_session
from pairshift.sources.io import read_examples, read_metric_tables, write_dataset, write_examples

__all__ = [
    "accuracy", "all_results", "build_examples", "build_from_parallel", "build_session", "counts_by_dim",
    "cross_language", "cross_language_pivot", "efficiency_summary", "exact_match", "f1_per_example",
    "js_divergence", "length_stats", "mean_f1", "model_size_lookup", "pair_rows", "pair_size_histogram",
    "pair_token_deltas", "paper_table", "parallel_zip", "parse_nli_label", "perturbation_rates", "pool",
    "positions", "read_examples", "read_metric_tables", "representation_shift", "robustness_drop",
    "robustness_report", "sample_n", "sample_per_split", "scaling_table", "show_pairs", "synthetic_nli",
    "synthetic_qa", "token_histogram", "tokenizer_stats", "vector_drift", "with_code_switch",
    "with_informal_noise", "with_perturbation", "write_dataset", "write_examples",
]
