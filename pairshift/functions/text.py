"""Text scalars as Column -> Column functions (all JVM-side, no Python UDFs).

Whitespace: Python's ``str.split()``/``strip()``/``\\s`` treat 29 code points as
whitespace, while Java's ``\\s`` is ASCII only. ``WS_CHARS`` lists exactly those
29 code points so token lists agree with the Python definitions, including the
narrow no-break spaces of French typography. Word characters are
``[\\p{L}\\p{N}_]``, the exact equivalent of Python's ``\\w``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java-regex body of the whitespace class (raw string: the regex engine reads the escapes).
WS_CHARS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WS = f"[{WS_CHARS}]"
WS_RUN = f"{WS}+"
WORD_CHARS = r"\p{L}\p{N}_"

# The same classes for DuckDB (RE2) in the oracle SQL.
SQL_WS_CHARS = (
    r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SQL_WS = f"[{SQL_WS_CHARS}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ws_tokens(s) -> Column:
    """``str.split()``: whitespace-separated tokens, no empty pieces."""
    return F.filter(F.split(_c(s), WS_RUN), lambda t: t != F.lit(""))


def strip_ws(s) -> Column:
    """``str.strip()`` with the full whitespace class."""
    return F.regexp_replace(_c(s), f"^{WS_RUN}|{WS_RUN}$", "")


def normalize_ws(s) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return F.array_join(ws_tokens(s), " ")


def simple_tokenize(s) -> Column:
    """Word runs and single punctuation marks, ``\\w+|[^\\w\\s]``."""
    pattern = f"([{WORD_CHARS}]+|[^{WORD_CHARS}{WS_CHARS}])"
    return F.regexp_extract_all(_c(s), F.lit(pattern), 1)


def normalize_answer(s) -> Column:
    """Lower, strip, collapse whitespace, then delete punctuation (that order).

    Collapsing before deleting keeps ``a - b`` as ``a  b`` (two spaces), exactly
    like the definition being reproduced.
    """
    x = F.lower(F.coalesce(_c(s), F.lit("")))
    x = strip_ws(x)
    x = F.regexp_replace(x, WS_RUN, " ")
    return F.regexp_replace(x, f"[^{WORD_CHARS}{WS_CHARS}]", "")


def answer_tokens(s) -> Column:
    """T4: whitespace tokens of the normalised answer."""
    return ws_tokens(normalize_answer(s))


def chars_no_ws(s) -> Column:
    """Number of non-whitespace characters (code points)."""
    return F.length(F.regexp_replace(_c(s), WS, "")).cast("int")


def word_count(s) -> Column:
    """Number of whitespace words."""
    return F.size(ws_tokens(s)).cast("int")


def text_of(input_col="input", prompt_col="prompt") -> Column:
    """``input``, else ``prompt``, else empty; empty counts as missing."""
    return F.coalesce(
        F.nullif(_c(input_col), F.lit("")), F.nullif(_c(prompt_col), F.lit("")), F.lit("")
    )


def eval_prompt(prompt_col="prompt", input_col="input") -> Column:
    """``prompt``, else ``input``; a row with neither raises."""
    p = F.coalesce(_c(prompt_col), _c(input_col))
    return F.when(p.isNull(), F.raise_error(F.lit("Example missing both 'prompt' and 'input'"))).otherwise(p)


# ---------------------------------------------------------------------------
# Prompt templates. FIXED VALUES: the wording must equal the benchmark's
# prompts character for character, so it is stated here as plain text.
# ---------------------------------------------------------------------------
NLI_PROMPT_HEAD = (
    "You are an NLI classifier.\n"
    "Return exactly ONE label from: entailment, contradiction, neutral.\n"
    "Do not explain.\n\n"
    "Premise: "
)
NLI_PROMPT_MID = "\nHypothesis: "
NLI_PROMPT_TAIL = "\n\nLabel:"

QA_PROMPT_HEAD = (
    "Task: Question Answering\n"
    "Answer the question using only the provided context.\n\n"
    "Context: "
)
QA_PROMPT_MID = "\nQuestion: "
QA_PROMPT_TAIL = "\n\nAnswer:"

LEGACY_CLEAN_HEAD = (
    "Tâche: inférence en langage naturel (NLI).\n"
    "Détermine si l'hypothèse est une conséquence logique de la prémisse.\n\n"
    "Prémisse: "
)
LEGACY_CLEAN_MID = "\nHypothèse: "
LEGACY_CLEAN_TAIL = "\n\nRéponds avec une seule étiquette: entailment, neutral, contradiction."

LEGACY_MIX_HEAD = (
    "Task: Natural Language Inference.\n"
    "Tu dois décider si l'hypothèse suit logiquement la prémisse.\n\n"
    "Premise: "
)
LEGACY_MIX_MID = "\nHypothesis: "
LEGACY_MIX_TAIL_OPEN = "\n\n("
LEGACY_MIX_TAIL_CLOSE = ") Réponds avec: entailment, neutral, contradiction."

# FIXED VALUES: the seven English discourse markers of the legacy prompt frame.
LEGACY_MARKERS = [
    "to be honest",
    "in my opinion",
    "I mean",
    "basically",
    "you know",
    "for real",
    "actually",
]


def nli_prompt(premise, hypothesis) -> Column:
    """T9."""
    return F.concat(
        F.lit(NLI_PROMPT_HEAD), _c(premise), F.lit(NLI_PROMPT_MID), _c(hypothesis), F.lit(NLI_PROMPT_TAIL)
    )


def qa_prompt(context, question) -> Column:
    """T10."""
    return F.concat(
        F.lit(QA_PROMPT_HEAD), _c(context), F.lit(QA_PROMPT_MID), _c(question), F.lit(QA_PROMPT_TAIL)
    )


def legacy_clean_prompt(premise, hypothesis) -> Column:
    """The French frame of the legacy dataset."""
    return F.concat(
        F.lit(LEGACY_CLEAN_HEAD), _c(premise), F.lit(LEGACY_CLEAN_MID), _c(hypothesis),
        F.lit(LEGACY_CLEAN_TAIL),
    )


def legacy_mix_prompt(premise, hypothesis, marker) -> Column:
    """English frame with a discourse marker; premise and hypothesis untouched."""
    return F.concat(
        F.lit(LEGACY_MIX_HEAD), _c(premise), F.lit(LEGACY_MIX_MID), _c(hypothesis),
        F.lit(LEGACY_MIX_TAIL_OPEN), _c(marker), F.lit(LEGACY_MIX_TAIL_CLOSE),
    )


# every line break that Python's splitlines() knows
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def _last_field_line(prompt: Column, field: str) -> Column:
    lines = F.split(prompt, LINE_BREAK)
    hits = F.filter(lines, lambda ln: F.lower(strip_ws(ln)).startswith(field + ":"))
    last = F.element_at(hits, -1)
    # text after the FIRST colon of that line
    pos = F.instr(last, ":")
    after = F.substring(last, pos + 1, F.length(last))
    return F.when(F.size(hits) > 0, strip_ws(after)).otherwise(F.lit(""))


def prompt_fields(text_a="text_a", text_b="text_b", input_col="input", prompt_col="prompt"):
    """(premise, hypothesis) from ``text_a/text_b`` or else from prompt lines.

    When both structured fields are present they win; otherwise the last line
    starting with ``premise:`` / ``hypothesis:`` (case-insensitive, after
    stripping) gives the text after its first colon, stripped.
    """
    have = _c(text_a).isNotNull() & _c(text_b).isNotNull()
    prompt = F.coalesce(F.nullif(_c(input_col), F.lit("")), F.nullif(_c(prompt_col), F.lit("")), F.lit(""))
    prem = F.when(have, _c(text_a)).otherwise(_last_field_line(prompt, "premise"))
    hyp = F.when(have, _c(text_b)).otherwise(_last_field_line(prompt, "hypothesis"))
    return prem, hyp


def strip_echo(text, prompt, kind) -> Column:
    """A causal model may echo the prompt; keep what follows its first copy."""
    t = _c(text)
    p = _c(prompt)
    pos = F.instr(t, p)
    tail = F.substring(t, pos + F.length(p), F.length(t) + 1)
    echoed = (_c(kind) == F.lit("causal")) & (F.length(p) > 0) & (pos > 0)
    return strip_ws(F.when(echoed, strip_ws(tail)).otherwise(t))


def first_answer(answers_text, answer) -> Column:
    """First of ``answers.text`` if non-empty, else ``answer``, else ``''``."""
    first = F.when(F.size(_c(answers_text)) > 0, F.element_at(_c(answers_text), 1))
    return F.coalesce(first, _c(answer).cast("string"), F.lit(""))


def display_text(s, n: int = 400) -> Column:
    """First ``n`` characters for display."""
    return F.substring(_c(s), 1, n)


def fruit_answer(phrase) -> Column:
    """Answer string from a fruit phrase: drop ``des `` and strip."""
    return strip_ws(F.replace(_c(phrase), F.lit("des "), F.lit("")))
