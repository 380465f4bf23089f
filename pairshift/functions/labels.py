"""Label parsing (T5, T6) and label lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairshift.functions import text as tx

# FIXED VALUES: label vocabulary in the parser's search order, and label ids.
PARSE_ORDER = ("entailment", "neutral", "contradiction")
ENTAIL_FORMS = ("entails", "entailed")
CONTRADICT_FORMS = ("contradicts", "contradicted")
LABEL2ID = {"entailment": 0, "neutral": 1, "contradiction": 2}
# Label list drawn from by the random baseline, in its own order.
BASELINE_LABELS = ("entailment", "contradiction", "neutral")


def parse_nli_label(text, variants: bool = True) -> Column:
    """T5 (``variants=True``) / T6: free-text model output -> label or ``""``.

    Lower-case, turn ``. , :`` into spaces, collapse whitespace; with variants,
    verb forms map first; then the first label (entailment, neutral,
    contradiction) contained in the text wins. Null behaves like ``""``.
    """
    c = F.col(text) if isinstance(text, str) else text
    t = tx.normalize_ws(F.translate(F.lower(F.coalesce(c.cast("string"), F.lit(""))), ".,:", "   "))
    out = None
    if variants:
        out = F.when(t.contains(ENTAIL_FORMS[0]) | t.contains(ENTAIL_FORMS[1]), F.lit("entailment"))
        out = out.when(t.contains(CONTRADICT_FORMS[0]) | t.contains(CONTRADICT_FORMS[1]), F.lit("contradiction"))
    for lab in PARSE_ORDER:
        cond = t.contains(lab)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out.otherwise(F.lit(""))


def label_id(label) -> Column:
    """Label name (lower-cased, stripped) -> id, null when unknown."""
    c = F.col(label) if isinstance(label, str) else label
    m = F.create_map(*[x for k, v in LABEL2ID.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, F.lower(tx.strip_ws(F.coalesce(c.cast("string"), F.lit("")))))
