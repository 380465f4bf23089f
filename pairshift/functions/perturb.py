"""Code-switching and informal noise (G1-G5) as staged column expressions.

Every random decision is a keyed md5 draw (``draws.u01``) over
``seed | key parts | field | draw name [| token index]`` so the perturbed text is
a pure function of the row: identical under any partitioning, retry or engine.

The work is split over consecutive ``select``s; Catalyst's CollapseProject does
not inline an expensive expression into several consumers, so each array is built
once per row. Noise draws are only evaluated for tokens in the lexicon: a draw
for any other token cannot change it, so skipping those md5 calls leaves the
result unchanged and keeps the cost proportional to lexicon hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairshift.functions.draws import u01
from pairshift.functions.text import ws_tokens

# FIXED VALUES: default perturbation parameters and lexicons of the benchmark.
DEFAULT_P_SWITCH = 0.35
DEFAULT_NOISE_P = 0.15
DEFAULT_MIN_TOKENS = 6
DEFAULT_MAX_SPAN = 6
DROP_WORDS = ("ne", "pas")
ABBREVIATIONS = (("you", "u"), ("are", "r"))
PUNCT_CHOICES = ("!", "!!", "...", " :)")
PERTURBATION_TYPE = "switchmix+informal_noise"

CODE_SWITCH_TYPE = T.StructType([
    T.StructField("p_switch", T.DoubleType()),
    T.StructField("seed", T.StringType()),
    T.StructField("applied", T.BooleanType()),
    T.StructField("span_len", T.IntegerType()),
    T.StructField("insert_pos", T.IntegerType()),
    T.StructField("insert_lang_span", T.StringType()),
])
NOISE_TYPE = T.StructType([
    T.StructField("p", T.DoubleType()),
    T.StructField("seed", T.StringType()),
    T.StructField("dropped_tokens", T.IntegerType()),
    T.StructField("abbreviations", T.IntegerType()),
    T.StructField("punct_added", T.StringType()),
])
FIELD_META_TYPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("code_switch", CODE_SWITCH_TYPE),
    T.StructField("noise", NOISE_TYPE),
])


def _key(seed, keys: Sequence[str], field: str) -> list:
    return [seed, *[F.col(k) for k in keys], field]


def _named_keys(df: DataFrame, key_parts: Sequence, out: str) -> tuple[DataFrame, tuple[str, ...]]:
    """The key parts as string columns under names of their own: cached stages refer to names, never to a
    column of one DataFrame."""
    names = tuple(f"_{out}_key{i}" for i in range(len(key_parts)))
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key_parts]
    return df.withColumns({n: p.cast("string") for n, p in zip(names, parts)}), names


def _memo(fn):
    """Cache the unresolved Column stages per parameter set.

    Building these expressions costs thousands of JVM round trips; they refer to
    columns by name only and the parameters are plain values, so they are built
    once per JVM gateway and parameter set.
    """
    cache: dict = {}

    def norm(x):
        if isinstance(x, (list, tuple)):
            return tuple(norm(y) for y in x)
        return ("val", repr(x))

    def wrapped(*args, **kwargs):
        from pyspark import SparkContext

        key = (id(SparkContext._gateway), norm(args), norm(sorted(kwargs.items())))
        if key not in cache:
            cache[key] = fn(*args, **kwargs)
        return cache[key]

    return wrapped


@_memo
def _code_switch_stages(base, insert, key_parts, field, out, seed, p_switch, min_tokens, max_span):
    k = _key(seed, key_parts, field)
    b, s = f"_{out}_b", f"_{out}_s"
    ap, sl, st, ps = f"_{out}_ap", f"_{out}_sl", f"_{out}_st", f"_{out}_ps"
    nb, ni = F.size(F.col(b)), F.size(F.col(s))
    stages = [{b: ws_tokens(F.col(base)), s: ws_tokens(F.col(insert))}]
    stages.append({ap: (nb >= min_tokens) & (ni >= min_tokens) & (u01(*k, "switch") <= F.lit(p_switch))})
    span_len = F.lit(2) + F.floor(u01(*k, "len") * (F.least(F.lit(max_span), ni - 1) - 1))
    stages.append({sl: F.when(F.col(ap), span_len.cast("int"))})
    start = F.floor(u01(*k, "start") * (ni - F.col(sl) + 1))
    pos = F.lit(1) + F.floor(u01(*k, "pos") * (nb - 2))
    stages.append({st: F.when(F.col(ap), start.cast("int")), ps: F.when(F.col(ap), pos.cast("int"))})
    span = F.slice(F.col(s), F.col(st) + 1, F.col(sl))
    mixed_tokens = F.concat(F.slice(F.col(b), F.lit(1), F.col(ps)), span, F.slice(F.col(b), F.col(ps) + 1, nb))
    stages.append({
        f"{out}_tokens": F.when(F.col(ap), mixed_tokens).otherwise(F.col(b)),
        f"_{out}_span": F.when(F.col(ap), F.array_join(span, " ")).otherwise(F.lit("")),
    })
    stages.append({
        f"{out}_mixed": F.when(F.col(ap), F.array_join(F.col(f"{out}_tokens"), " ")).otherwise(F.col(base)),
        f"{out}_cs": F.struct(
            F.lit(float(p_switch)).alias("p_switch"),
            F.concat_ws("|", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in k]).alias("seed"),
            F.col(ap).alias("applied"),
            F.coalesce(F.col(sl), F.lit(0)).alias("span_len"),
            F.col(ps).alias("insert_pos"),
            F.col(f"_{out}_span").alias("insert_lang_span"),
        ),
    })
    return stages, [b, s, ap, sl, st, ps, f"_{out}_span"]


def _apply(df: DataFrame, stages, drop) -> DataFrame:
    for st in stages:
        df = df.withColumns(st)
    return df.drop(*drop)


def with_code_switch(
    df: DataFrame,
    base: str,
    insert: str,
    key_parts: Sequence,
    field: str,
    out: str,
    seed=42,
    p_switch: float = DEFAULT_P_SWITCH,
    min_tokens: int = DEFAULT_MIN_TOKENS,
    max_span: int = DEFAULT_MAX_SPAN,
) -> DataFrame:
    """Add ``{out}_tokens`` (tokens of the mixed text), ``{out}_mixed`` and ``{out}_cs``.

    With probability ``p_switch``, and only if both sides have at least
    ``min_tokens`` whitespace tokens, a span of 2..min(max_span, n_insert-1)
    insert tokens is spliced in at position 1..n_base-2; otherwise the base text
    is returned verbatim.
    """
    df, keys = _named_keys(df, key_parts, out)
    stages, drop = _code_switch_stages(base, insert, keys, field, out, seed, p_switch, min_tokens, max_span)
    return _apply(df, stages, [*drop, *keys])


@_memo
def _noise_stages(tokens, key_parts, field, out, seed, noise_p, drop_words, abbreviations, punct_choices):
    k = _key(seed, key_parts, field)
    lex = list(drop_words) + [a for a, _ in abbreviations]
    max_len = max(len(w) for w in lex)
    hits, pc = f"_{out}_hits", f"_{out}_punct"

    def hit(t: Column, i: Column) -> Column:
        low = F.lower(t)
        eligible = (F.length(t) <= max_len) & low.isin(lex)
        return F.when(eligible & (u01(*k, "noise", i) < F.lit(noise_p)), low)

    def apply(t: Column, h: Column) -> Column:
        out_c = F.when(h.isin(list(drop_words)), F.lit(None).cast("string"))
        for src, dst in abbreviations:
            out_c = out_c.when(h == F.lit(src), F.lit(dst))
        return out_c.otherwise(t)

    punct = F.when(
        u01(*k, "punct") < F.lit(noise_p),
        F.element_at(
            F.array(*[F.lit(p) for p in punct_choices]),
            (F.floor(u01(*k, "which") * len(punct_choices)) + 1).cast("int"),
        ),
    ).otherwise(F.lit(""))
    noised = F.zip_with(F.col(tokens), F.col(hits), apply)
    abbr_src = [a for a, _ in abbreviations]
    stages = [
        {hits: F.transform(F.col(tokens), hit), pc: punct},
        {
            f"{out}_text": F.concat(F.array_join(noised, " "), F.col(pc)),
            f"{out}_noise": F.struct(
                F.lit(float(noise_p)).alias("p"),
                F.concat_ws("|", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in k]).alias("seed"),
                F.size(F.filter(F.col(hits), lambda h: h.isin(list(drop_words)))).alias("dropped_tokens"),
                F.size(F.filter(F.col(hits), lambda h: h.isin(abbr_src))).alias("abbreviations"),
                F.col(pc).alias("punct_added"),
            ),
        },
    ]
    return stages, [hits, pc]


def with_informal_noise(
    df: DataFrame,
    tokens: str,
    key_parts: Sequence,
    field: str,
    out: str,
    seed=42,
    noise_p: float = DEFAULT_NOISE_P,
    drop_words: Sequence[str] = DROP_WORDS,
    abbreviations: Sequence[tuple[str, str]] = ABBREVIATIONS,
    punct_choices: Sequence[str] = PUNCT_CHOICES,
) -> DataFrame:
    """Add ``{out}_text`` and ``{out}_noise`` from a token array column.

    Token ``i`` (from 0) is hit with probability ``noise_p``; a hit drop word is
    removed, a hit abbreviation source is replaced. Then, with probability
    ``noise_p``, one of ``punct_choices`` is appended without a space. Tokens are
    re-joined with single spaces, so the output is whitespace-normalised even
    when nothing fired.
    """
    df, keys = _named_keys(df, key_parts, out)
    stages, drop = _noise_stages(
        tokens, keys, field, out, seed, noise_p,
        tuple(drop_words), tuple(tuple(a) for a in abbreviations), tuple(punct_choices),
    )
    return _apply(df, stages, [*drop, *keys])


def with_perturbation(
    df: DataFrame,
    base: str,
    insert: str,
    key_parts: Sequence,
    field: str,
    out: str,
    seed=42,
    p_switch: float = DEFAULT_P_SWITCH,
    noise_p: float = DEFAULT_NOISE_P,
    **lexicon,
) -> DataFrame:
    """Code-switch then noise; adds ``{out}`` (text) and ``{out}_meta`` (struct).

    Code-switching and noise use independent draw names, so the first noise
    draw never coincides with the switch decision.
    """
    cs_keys = {k: lexicon[k] for k in ("min_tokens", "max_span") if k in lexicon}
    nz_keys = {k: lexicon[k] for k in ("drop_words", "abbreviations", "punct_choices") if k in lexicon}
    df = with_code_switch(df, base, insert, key_parts, field, f"_{out}", seed, p_switch, **cs_keys)
    df = with_informal_noise(df, f"_{out}_tokens", key_parts, field, f"_{out}", seed, noise_p, **nz_keys)
    df = df.withColumns({
        out: F.col(f"_{out}_text"),
        f"{out}_meta": F.struct(
            F.lit(PERTURBATION_TYPE).alias("type"),
            F.col(f"_{out}_cs").alias("code_switch"),
            F.col(f"_{out}_noise").alias("noise"),
        ),
    })
    return df.drop(f"_{out}_tokens", f"_{out}_mixed", f"_{out}_cs", f"_{out}_text", f"_{out}_noise")
