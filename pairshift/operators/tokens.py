"""Tokenizer statistics over clean/perturbed pairs.

Plan shape: pairing shuffle by ``(dataset, pair_id)`` -> one tokenization -> one ``explode`` per pair into its tokens,
tagged by side, and a few entries that carry the pair's own measures (counts, ratios) -> one aggregation by
``(group, entry, token)`` with map-side partial sums (skewed tokens such as ``le``/``the``, and the measures, collapse
before the shuffle). Its exchange is the only wide one after the pairing: means and token totals are sums over its
measure entries, Jensen-Shannon divergence is two relational sums over its token entries, and both read the same
exchange because both ask for the same columns of it and select entries by an aggregate, not by a key that a filter
could be pushed through.

Nothing is collected: the vocabulary never leaves the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairshift.functions import text as tx
from pairshift.operators.pairing import pair_rows
from pairshift.session import materialize

GROUP = ["dataset", "task", "split"]
JS_EPS = 1e-12


def _fake_ids(s: Column) -> Column:
    n = F.greatest(F.size(tx.ws_tokens(s)), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string"))


def _char_trigrams(s: Column) -> Column:
    t = tx.normalize_ws(s)
    n = F.length(t)
    return F.when(n < 3, F.array(t)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(t, i, 3))
    )


# Built-in tokenizers (Column -> array<string>), all JVM-side.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "whitespace": tx.ws_tokens,
    "simple": tx.simple_tokenize,
    "positions": _fake_ids,  # one id per whitespace token, at least one: ids 0..n-1
    "char3": _char_trigrams,
}


def get_tokenizer(tokenizer) -> Callable[[Column], Column]:
    if callable(tokenizer):
        return tokenizer
    try:
        return TOKENIZERS[tokenizer]
    except KeyError:
        raise ValueError(f"Unknown tokenizer: {tokenizer!r}; known: {sorted(TOKENIZERS)}") from None


def _token_table(pairs: DataFrame, tokenizer) -> DataFrame:
    """Per pair: both token arrays plus the word and character counts of both texts."""
    tok = get_tokenizer(tokenizer)
    one = F.lit(1)
    return pairs.select(
        *GROUP, "pair_id",
        tok(F.col("clean_text")).alias("ct"), tok(F.col("perturbed_text")).alias("pt"),
        F.greatest(one, tx.word_count("clean_text")).alias("_cw"),
        F.greatest(one, tx.word_count("perturbed_text")).alias("_pw"),
        F.greatest(one, tx.chars_no_ws("clean_text")).alias("_cc"),
        F.greatest(one, tx.chars_no_ws("perturbed_text")).alias("_pc"),
    )


def _measures() -> dict[str, Column]:
    c, p = F.size("ct"), F.size("pt")
    one = F.lit(1)
    return {
        "clean_tokens": c, "perturbed_tokens": p, "token_increase": p - c, "length_inflation": p / F.greatest(one, c),
        "fragmentation_clean": c / F.col("_cw"), "fragmentation_perturbed": p / F.col("_pw"),
        "tokens_per_char_clean": c / F.col("_cc"), "tokens_per_char_perturbed": p / F.col("_pc"),
    }


def _deltas(tt: DataFrame) -> DataFrame:
    return tt.select(*GROUP, "pair_id", *[m.alias(name) for name, m in _measures().items()])


TOKEN = 0  # the kind of an entry that is a token; measure entries have kinds from 1


def _entries(tt: DataFrame, measures: list[tuple[Column, Column]]) -> DataFrame:
    """One row per group and token, and one per group and pair of measures: ``kind``, and the sums ``n_clean``, ``n_perturbed``.

    Tokens are counted per side; the i-th measure entry (from 1) sums its two columns over the group's pairs. Counts are
    doubles, exact up to 2^53.
    """
    def entry(kind: int, token: Column, c: Column, p: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), token.cast("string").alias("token"), c.cast("double").alias("c"), p.cast("double").alias("p"))

    own = F.array(*[entry(i, F.lit(None), c, p) for i, (c, p) in enumerate(measures, 1)])
    clean = F.transform("ct", lambda t: entry(TOKEN, t, F.lit(1), F.lit(0)))
    perturbed = F.transform("pt", lambda t: entry(TOKEN, t, F.lit(0), F.lit(1)))
    grouped = [F.col(g).isNotNull() for g in GROUP]  # as the joins on the group ask, and the same in every branch
    return (
        tt.where(grouped[0] & grouped[1] & grouped[2]).select(*GROUP, F.explode(F.concat(own, clean, perturbed)).alias("e"))
        .groupBy(*GROUP, F.col("e.kind").alias("_kind"), F.col("e.token").alias("token"))
        .agg(F.max("e.kind").alias("kind"), F.sum("e.c").alias("n_clean"), F.sum("e.p").alias("n_perturbed"))
    )


def _sum_of(kind: int, side: str) -> Column:
    """The group's sum of one side of a measure entry."""
    return F.max(F.when(F.col("kind") == kind, F.col(side)))


def _token_totals(entries: DataFrame, kind: int) -> DataFrame:
    return entries.groupBy(*GROUP).agg(_sum_of(kind, "n_clean").alias("_tc"), _sum_of(kind, "n_perturbed").alias("_tp"))


def _histogram(tt: DataFrame) -> DataFrame:
    tagged = F.concat(
        F.transform(F.col("ct"), lambda t: F.struct(t.alias("token"), F.lit(1).alias("c"), F.lit(0).alias("p"))),
        F.transform(F.col("pt"), lambda t: F.struct(t.alias("token"), F.lit(0).alias("c"), F.lit(1).alias("p"))),
    )
    return (
        tt.select(*GROUP, F.explode(tagged).alias("t"))
        .groupBy(*GROUP, F.col("t.token").alias("token"))
        .agg(F.sum("t.c").cast("long").alias("n_clean"), F.sum("t.p").cast("long").alias("n_perturbed"))
    )


def pair_token_deltas(pairs: DataFrame, tokenizer="simple") -> DataFrame:
    """M2: per-pair lengths, increase, inflation, fragmentation, tokens per character.

    All denominators are floored at 1, as in the definition.
    """
    return _deltas(_token_table(pairs, tokenizer))


def token_histogram(pairs: DataFrame, tokenizer="simple") -> DataFrame:
    """``(dataset, task, split, token, n_clean, n_perturbed)``.

    One ``explode`` over both sides (tagged), then a hash aggregate whose
    partial step runs before the shuffle.
    """
    return _histogram(_token_table(pairs, tokenizer).select(*GROUP, "ct", "pt"))


def _clipped(hist: DataFrame, sides: DataFrame, eps: float, *more: str) -> DataFrame:
    """Both sides' shares ``x``, ``y`` of the group's tokens, in [eps, 1]; null where a row is no token."""
    def share(n: str, total: str) -> Column:
        return F.when(F.col("kind") == TOKEN, F.least(F.greatest(F.col(n) / F.greatest(F.lit(1.0), F.col(total)), F.lit(eps)), F.lit(1.0)))

    return hist.join(sides, on=GROUP).select(*GROUP, *more, share("n_clean", "_tc").alias("x"), share("n_perturbed", "_tp").alias("y"))


def _divergence(clipped: DataFrame, *more: Column) -> DataFrame:
    """Per group the divergence of its renormalised shares (0 without tokens) and further aggregates."""
    sums = clipped.groupBy(*GROUP).agg(F.sum("x").alias("_sx"), F.sum("y").alias("_sy"))
    p = F.col("x") / F.col("_sx")
    q = F.col("y") / F.col("_sy")
    m = (p + q) * 0.5
    term = 0.5 * p * F.log2(p / m) + 0.5 * q * F.log2(q / m)
    return clipped.join(sums, on=GROUP).groupBy(*GROUP).agg(*more, F.coalesce(F.sum(term), F.lit(0.0)).alias("token_js_divergence_bits"))


def js_divergence(hist: DataFrame, groups: DataFrame, eps: float = JS_EPS) -> DataFrame:
    """Jensen-Shannon divergence in bits per group, from a token histogram.

    Each side is normalised by ``max(1, total)``, clipped to ``[eps, 1]``,
    renormalised, and compared with base-2 logs. ``groups`` lists every group
    (``GROUP`` columns); a group with an empty vocabulary gets 0. The per-group
    totals and sums have one row per group; AQE broadcasts them where they measure small.
    """
    sides = hist.groupBy(*GROUP).agg(F.sum("n_clean").alias("_tc"), F.sum("n_perturbed").alias("_tp"))
    js = _divergence(_clipped(hist.withColumn("kind", F.lit(TOKEN)), sides, eps))
    return groups.select(*GROUP).join(js, on=GROUP, how="left").select(
        *GROUP, F.coalesce(F.col("token_js_divergence_bits"), F.lit(0.0)).alias("token_js_divergence_bits"))


def js_divergence_of_examples(
    examples: DataFrame,
    tokenizer="simple",
    dataset_col: str | None = None,
    max_pairs: int | None = None,
    order_col: str | None = None,
    materialize_pairs: bool = False,
    keyed: bool = False,
) -> DataFrame:
    """A9 end to end. Histogram and token totals share one exchange; with ``materialize_pairs`` the
    tokenized pairs are written once before it (the caller then removes them with ``session.cleanup_materialized``)."""
    pairs = pair_rows(examples, order_col=order_col, dataset_col=dataset_col, max_pairs=max_pairs, keyed=keyed)
    tt = _token_table(pairs, tokenizer).select(*GROUP, "ct", "pt")
    if materialize_pairs:
        tt = materialize(tt, "tokens")
    entries = _entries(tt, [(F.size("ct"), F.size("pt"))])
    return _divergence(_clipped(entries, _token_totals(entries, 1), JS_EPS))


def tokenizer_stats(
    examples: DataFrame,
    tokenizer="simple",
    tokenizer_name: str | None = None,
    dataset_col: str | None = None,
    max_pairs: int | None = None,
    order_col: str | None = None,
    materialize_pairs: bool = False,
    keyed: bool = False,
) -> DataFrame:
    """Per (dataset, task, split): pair count, eight means and the JS divergence.

    Texts are tokenized once; means and histogram come from one aggregation (see the module's plan shape), and nothing
    is written. With ``materialize_pairs`` the tokenized pairs (no raw text) are written once under the checkpoint folder
    first; ``session.cleanup_materialized`` removes them. ``keyed``: the examples are a stored pair table
    (``io.write_pair_table``) and are paired without a shuffle.
    """
    pairs = pair_rows(examples, order_col=order_col, dataset_col=dataset_col, max_pairs=max_pairs, keyed=keyed)
    tt = _token_table(pairs, tokenizer)
    if materialize_pairs:
        tt = materialize(tt, "tokens")
    m = _measures()
    names = list(m)
    pairs_of = list(zip(names[::2], names[1::2]))  # the first holds the token counts
    entries = _entries(tt, [*[(m[a], m[b]) for a, b in pairs_of], (F.lit(1), F.lit(1))])
    sums = [_sum_of(i, side).alias(name) for i, pair in enumerate(pairs_of, 1) for name, side in zip(pair, ("n_clean", "n_perturbed"))]
    clipped = _clipped(entries, _token_totals(entries, 1), JS_EPS, "kind", "n_clean", "n_perturbed")
    stats = _divergence(clipped, *sums, _sum_of(len(pairs_of) + 1, "n_clean").alias("n_pairs"))
    name = tokenizer_name or (tokenizer if isinstance(tokenizer, str) else "custom")
    return stats.select(
        F.col("dataset").alias("data_path"), "task", "split", F.lit(name).alias("tokenizer"), F.col("n_pairs").cast("long").alias("n_pairs"),
        *[(F.col(c) / F.col("n_pairs")).alias(f"avg_{c}") for c in names], "token_js_divergence_bits")
