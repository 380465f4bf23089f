"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (leftmost, non-overlapping per kind; a match that fails its check is dropped and not retried): e-mail
addresses, IPv4 addresses with parts up to 255, card numbers of 13 to 19 digits that pass Luhn, international phone
numbers of 9 to 15 digits. They always stay. Added kinds: ``iban``, confirmed by mod-97; ``local_phone``, numbers of 7
to 12 digits without a plus sign; ``account``, undivided numbers of 6 to 18 digits with up to two letters before
them; and ``secret``, runs of 24 to 128 letters, digits, underscores and hyphens with at least one letter and one digit. Every span has a score: the pattern's own worth, plus what a passed checksum adds, plus what a word of its kind
within ``CONTEXT`` code points adds; an added kind needs ``threshold``, which the last two only reach by such a word.

Only built-in functions run. ``regexp_extract_all`` and ``split`` with one pattern walk the same matches, so the
lengths of gaps and matches give offsets in code points; running sums go block by block, so a text with very many
matches stays cheap. Patterns use possessive quantifiers and start only where a run starts, which keeps them linear
and gives the matches of the plain patterns.

Edge cases: null and empty texts have no spans; repeated rows are scanned one by one; an empty table gives an empty
table; other columns do not matter. Spans of different kinds may overlap; masking joins overlapping spans and names
the first of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairshift.llm.common import fresh, whole_text

CONTEXT = 40
BLOCK = 256
CHUNK = 4096
BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    may: str  # a cheaper pattern that every text with a match has
    check: Callable[[Column], Column]
    worth: float
    confirmed: float  # what a passed checksum adds
    words: str  # context words, as a regular expression


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass: from the right, every second digit doubled, the sum a multiple of ten."""
    d = F.reverse(_digits(m))
    one = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(one(i) > 4, 2 * one(i) - 9).otherwise(2 * one(i))
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(i)).otherwise(one(i)))
    return total % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an IBAN's remainder is 1: first four characters moved to the end, letters as 10 to 35."""
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))

    def step(r: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 65, (r * 10 + code - 48) % 97).otherwise((r * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _all_parts_small(m: Column) -> Column:
    return m.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m: F.lit(True), 0.8, 0.0, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]",
         _all_parts_small, 0.6, 0.1, r"\bip\b|address|server|host|adresse"),
    Kind("card", r"[0-9]++(?:[ -][0-9]++)*+", r"(?:[0-9][ -]?){12}[0-9]",
         lambda m: F.length(_digits(m)).between(13, 19) & luhn(m), 0.4, 0.4, "card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]",
         lambda m: F.length(_digits(m)).between(9, 15), 0.6, 0.0, "phone|call|tel|mobile|fax|telefon"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}",
         lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m), 0.3, 0.4, "iban|account|bank|konto|cuenta|compte"),
    # these two take what runs on behind a number into the match, which the check then drops, so no scan starts anew inside it
    Kind("local_phone", r"\+[0-9][ ().0-9-]+[0-9]|(?<![A-Za-z0-9.,@_-])\(?[0-9]++(?:[ ()/-]{1,2}+[0-9]++)*+(?:[A-Za-z@_]|[.,:][0-9])?+", r"(?:[0-9][ ()/-]{0,2}){6}[0-9]",
         lambda m: m.rlike(r"^[0-9(][0-9 ()/-]*[0-9]$") & F.length(_digits(m)).between(7, 12), 0.55, 0.0,
         r"\b(phone|call|tel|telephone|mobile|cell|fax|telefon|telefono|teléfono|téléphone|handy|móvil)\b"),
    Kind("account", r"(?<![A-Za-z0-9.,@_+-])[A-Za-z]{0,2}+[0-9]++(?:[A-Za-z@_]|[.,:-][0-9])?+", "[0-9]{6}",
         lambda m: m.rlike("^[A-Za-z]{0,2}[0-9]{6,18}$"), 0.55, 0.0,
         r"\b(account|acct|passport|customer (no|number|id)|ssn|konto|kontonummer|kundennummer|ausweis|cuenta|pasaporte|compte|passeport)\b"),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+", "[A-Za-z0-9_-]{24}",
         lambda m: (F.length(m) <= 128) & m.rlike("[0-9]") & m.rlike("[A-Za-z]"), 0.55, 0.0,
         r"\b(token|secret|password|passwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|bearer|passwort|contraseña)\b"),
)
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _running(parts: Column) -> Column:
    """Where each part begins: sums within blocks of ``BLOCK`` parts, on top of the sums of the blocks before."""
    def sums(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))
    heads = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, v: s + v)), F.lit(0))
    return F.flatten(F.zip_with(blocks, heads, sums))


def _with_spans(df: DataFrame, text: str, kind: Kind, out: str) -> DataFrame:
    """Adds ``out``: the confirmed spans of one kind, in order."""
    body, found = F.col(text), fresh(df, f"{out}_found")
    n = F.col(f"{found}.n")
    df = df.withColumn(found, F.when(body.rlike(kind.may), F.struct(
        F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(body, kind.pattern, -1).alias("g"))))
    df = df.withColumn(found, F.when(F.size(f"{found}.m") > 0, F.struct(
        F.col(f"{found}.m").alias("m"), F.col(f"{found}.g").alias("g"), F.size(f"{found}.m").alias("n"))))
    before = F.transform(F.slice(f"{found}.g", F.lit(1), n), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("near")))
    after = F.transform(F.slice(f"{found}.g", F.lit(2), n), lambda g: F.left(g, F.lit(CONTEXT)))
    steps = F.zip_with(before, F.zip_with(F.col(f"{found}.m"), after, lambda m, a: F.struct(m.alias("m"), a.alias("near"))), lambda b, m: F.struct(
        b["n"].alias("gap"), F.length(m["m"]).alias("size"), m["m"].alias("m"), F.concat(b["near"], F.lit(" "), m["near"]).alias("near")))
    df = df.withColumn(found, F.when(n > 0, F.struct(steps.alias("s"), n.alias("n"))))
    begins = _running(F.transform(f"{found}.s", lambda s: s["gap"] + s["size"]))
    spans = F.zip_with(F.col(f"{found}.s"), begins, lambda s, at: F.struct(
        kind.check(s["m"]).alias("ok"), F.lit(kind.name).alias("kind"), (at + s["gap"]).alias("start"), (at + s["gap"] + s["size"]).alias("end"),
        F.least(F.lit(1.0), F.lit(kind.worth + kind.confirmed) + F.when(F.lower(s["near"]).rlike(kind.words), 0.1).otherwise(0.0)).alias("score")))
    good = F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["kind"], s["start"], s["end"], s["score"])).cast(SPAN)
    return df.withColumn(out, F.when(n > 0, good).otherwise(F.array().cast(SPAN))).drop(found)


def with_pii(df: DataFrame, text: str, prefix: str, threshold: float = THRESHOLD) -> DataFrame:
    """Adds one span column per kind, named ``prefix`` + kind. ``text`` must not be null."""
    for kind in KINDS:
        df = _with_spans(df, text, kind, prefix + kind.name)
        if kind.name not in BASE:
            df = df.withColumn(prefix + kind.name, F.filter(prefix + kind.name, lambda s: s["score"] >= threshold))
    return df


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the id column, counts of the base kinds, ``base_sha256``, ``spans`` and ``scores`` as text."""
    df = with_pii(docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")), "body", "p_", threshold)
    df = df.select("id", *[F.col("p_" + k.name) for k in KINDS])

    def joined(kinds: tuple[str, ...], score: bool = False) -> Column:
        def one(s: Column) -> Column:
            parts = [s["kind"], s["start"].cast("string"), s["end"].cast("string")] + ([F.format_number(s["score"], 2)] if score else [])
            return F.concat_ws(":", *parts)

        return F.array_join(F.concat(*[F.transform("p_" + k, one) for k in kinds]), ",")

    every = tuple(k.name for k in KINDS)
    return df.select(
        F.col("id").alias(id_col), *[F.size("p_" + k).cast("long").alias("n_" + k) for k in BASE],
        F.sha2(joined(BASE), 256).alias("base_sha256"), joined(every).alias("spans"), joined(every, True).alias("scores"))


def mask_pii(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; texts without spans, nulls too, are unchanged."""
    body, prefix = fresh(docs, "pii_body"), fresh(docs, "pii_span_")
    names = [prefix + k.name for k in KINDS]
    df = with_pii(docs.withColumn(body, whole_text(text_col)), body, prefix, threshold)
    every, merged = fresh(df, "pii_every"), fresh(df, "pii_merged")
    df = df.withColumn(every, F.array_sort(F.transform(F.concat(*names), lambda s: F.struct(s["start"], s["end"], s["kind"])))).drop(*names)
    # a span that begins inside the reach of an earlier one belongs to it; the reach is a running maximum by position
    first = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("out"))

    def merge(s: Column, v: Column) -> Column:
        last = F.element_at(s["out"], -1)
        longer = F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], v["end"]).alias("end"), last["kind"].alias("kind"))))
        out = F.when(v["start"] < s["reach"], longer).otherwise(F.concat(s["out"], F.array(v)))
        return F.struct(F.greatest(s["reach"], v["end"]).alias("reach"), out.alias("out"))

    df = df.withColumn(merged, F.aggregate(every, first, merge, lambda s: s["out"]))
    chunks = F.regexp_extract_all(F.col(body), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def masked(chunk: Column, j: Column) -> Column:
        base = j * CHUNK
        here = F.filter(merged, lambda s: (s["start"] < base + CHUNK) & (s["end"] > base))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(chunk, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - base - acc["at"]))
            tag = F.when(s["start"] >= base, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))
            return F.struct(F.least(s["end"] - base, F.lit(CHUNK)).alias("at"), F.concat(acc["out"], gap, tag).alias("out"))

        return F.aggregate(here, start, step, lambda a: F.concat(a["out"], F.substring(chunk, a["at"] + 1, F.lit(CHUNK))))

    text = F.when(F.size(merged) > 0, F.array_join(F.transform(chunks, masked), "")).otherwise(F.col(text_col))
    return df.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
