"""DuckDB SQL fragments used to write the independent oracle for each query.

These re-state the operator definitions in plain SQL (window functions, list
lambdas, md5 draws) over the same Parquet views; they share no code path with
the Spark implementation beyond the fixed constants.
"""

from __future__ import annotations

from pairshift.functions import text as tx
from pairshift.functions.draws import TWO_POW_52
from pairshift.functions.perturb import ABBREVIATIONS, DROP_WORDS, PUNCT_CHOICES

SEED = 42
WS = tx.SQL_WS
WORD = r"\p{L}\p{N}_"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def U(*parts: str) -> str:
    """Keyed uniform draw; ``parts`` are SQL expressions (cast to VARCHAR)."""
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((('0x' || substr(md5(concat_ws('|', {joined})), 1, 13))::BIGINT)::DOUBLE / {TWO_POW_52})"


def TOK(x: str, var: str = "w") -> str:
    """Whitespace tokens (``str.split()``)."""
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda {var}: {var} <> '')"


def SIMPLE(x: str) -> str:
    return f"regexp_extract_all({x}, '([{WORD}]+|[^{WORD}{tx.SQL_WS_CHARS}])', 1)"


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def NORM_ANSWER(x: str) -> str:
    y = f"lower(coalesce({x}, ''))"
    y = STRIP(y)
    y = f"regexp_replace({y}, '{WS}+', ' ', 'g')"
    return f"regexp_replace({y}, '[^{WORD}{tx.SQL_WS_CHARS}]', '', 'g')"


def CHARS_NO_WS(x: str) -> str:
    return f"length(regexp_replace({x}, '{WS}', '', 'g'))"


def WORDS(x: str) -> str:
    return f"len({TOK(x)})"


def NLI_PROMPT(a: str, b: str) -> str:
    return f"({q(tx.NLI_PROMPT_HEAD)} || {a} || {q(tx.NLI_PROMPT_MID)} || {b} || {q(tx.NLI_PROMPT_TAIL)})"


def QA_PROMPT(a: str, b: str) -> str:
    return f"({q(tx.QA_PROMPT_HEAD)} || {a} || {q(tx.QA_PROMPT_MID)} || {b} || {q(tx.QA_PROMPT_TAIL)})"


def LABEL_NAME(x: str) -> str:
    return f"(CASE {x} WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' WHEN 2 THEN 'contradiction' ELSE 'neutral' END)"


def corpus(lang: str) -> str:
    return (
        f"SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text, "
        f"row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents WHERE lang = {q(lang)}"
    )


def halves(src: str, text: str, first: str, second: str, extra: str = "*") -> str:
    """Select ``extra`` plus the two halves of ``text``'s whitespace tokens."""
    return (
        f"SELECT {extra}, array_to_string(tok[1:(len(tok) + 1) // 2], ' ') AS {first}, "
        f"array_to_string(tok[(len(tok) + 1) // 2 + 1:len(tok)], ' ') AS {second} "
        f"FROM (SELECT *, {TOK(text)} AS tok FROM ({src}))"
    )


def nli_corpus(lang: str) -> str:
    h = halves(corpus(lang), "text", "premise", "hypothesis", "id, doc_id, idx")
    return (
        f"SELECT id, idx, premise, hypothesis, CAST(doc_id % 4 AS INTEGER) AS label, "
        f"CASE WHEN doc_id % 5 < 4 THEN 'train' ELSE 'test' END AS split FROM ({h})"
    )


def nli_pairs(clean: str = "fr", insert: str = "en") -> str:
    ds = f"docs_{clean}-{insert}"
    return (
        f"SELECT coalesce(nullif(b.id, ''), concat_ws('_', {q(ds)}, {q(clean)}, b.split, CAST(b.idx AS VARCHAR))) AS pair_id, "
        f"b.split AS split, b.premise AS a_clean, i.premise AS a_insert, b.hypothesis AS b_clean, "
        f"i.hypothesis AS b_insert, {LABEL_NAME('b.label')} AS label "
        f"FROM ({nli_corpus(clean)}) b JOIN ({nli_corpus(insert)}) i ON b.idx = i.idx"
    )


def qa_pairs(insert: str = "en") -> str:
    turns = (
        "SELECT concat_ws('_', CAST(u.conv_id AS VARCHAR), CAST(u.turn AS VARCHAR)) AS id, "
        "u.conv_id, u.turn, a.text AS context, u.text AS question, a.text AS answer, "
        "CASE WHEN u.conv_id % 5 < 4 THEN 'train' ELSE 'test' END AS split "
        "FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
        "WHERE u.role = 'user' AND a.role = 'assistant'"
    )
    base = f"SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM ({turns})"
    ins = halves(corpus(insert), "text", "context", "question", "idx")
    ds = f"conv_fr-{insert}"
    return (
        f"SELECT coalesce(nullif(b.id, ''), concat_ws('_', {q(ds)}, 'fr', b.split, CAST(b.idx AS VARCHAR))) AS pair_id, "
        f"b.split AS split, b.context AS a_clean, i.context AS a_insert, b.question AS b_clean, "
        f"i.question AS b_insert, b.answer AS label "
        f"FROM ({base}) b JOIN ({ins}) i ON b.idx = i.idx"
    )


def perturb_field(src: str, f: str, p_switch: float = 0.35, noise_p: float = 0.15,
                  min_tokens: int = 6, max_span: int = 6, seed: int = SEED) -> str:
    """Adds ``{f}_pert`` plus provenance columns for field ``f`` (``a``/``b``).

    Input must have ``split, pair_id, {f}_clean, {f}_insert``.
    """
    k = [str(seed), "split", "pair_id", q(f)]
    lex = list(DROP_WORDS) + [a for a, _ in ABBREVIATIONS]
    lex_sql = ", ".join(q(w) for w in lex)
    maxlen = max(len(w) for w in lex)
    punct = "[" + ", ".join(q(p) for p in PUNCT_CHOICES) + "]"
    drop_sql = ", ".join(q(w) for w in DROP_WORDS)
    abbr_case = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in ABBREVIATIONS)
    abbr_src = ", ".join(q(a) for a, _ in ABBREVIATIONS)
    s1 = f"SELECT *, {TOK(f + '_clean')} AS _b, {TOK(f + '_insert')} AS _s FROM ({src})"
    s2 = (
        f"SELECT *, (len(_b) >= {min_tokens} AND len(_s) >= {min_tokens} AND {U(*k, q('switch'))} <= {p_switch}) AS _ap "
        f"FROM ({s1})"
    )
    s3 = (
        f"SELECT *, CASE WHEN _ap THEN CAST(2 + floor({U(*k, q('len'))} * (least({max_span}, len(_s) - 1) - 1)) AS INTEGER) END AS _sl "
        f"FROM ({s2})"
    )
    s4 = (
        f"SELECT *, CASE WHEN _ap THEN CAST(floor({U(*k, q('start'))} * (len(_s) - _sl + 1)) AS INTEGER) END AS _st, "
        f"CASE WHEN _ap THEN CAST(1 + floor({U(*k, q('pos'))} * (len(_b) - 2)) AS INTEGER) END AS _ps FROM ({s3})"
    )
    s5 = (
        f"SELECT *, CASE WHEN _ap THEN list_concat(list_concat(_b[1:_ps], _s[_st + 1:_st + _sl]), _b[_ps + 1:len(_b)]) ELSE _b END AS _mt, "
        f"CASE WHEN _ap THEN array_to_string(_s[_st + 1:_st + _sl], ' ') ELSE '' END AS _span FROM ({s4})"
    )
    s6 = (
        f"SELECT *, list_transform(_mt, lambda t, i: CASE WHEN length(t) <= {maxlen} AND lower(t) IN ({lex_sql}) "
        f"AND {U(*k, q('noise'), '(i - 1)')} < {noise_p} THEN lower(t) END) AS _hits, "
        f"CASE WHEN {U(*k, q('punct'))} < {noise_p} THEN {punct}[CAST(1 + floor({U(*k, q('which'))} * {len(PUNCT_CHOICES)}) AS INTEGER)] ELSE '' END AS _pc "
        f"FROM ({s5})"
    )
    s7 = (
        f"SELECT * EXCLUDE (_b, _s, _ap, _sl, _st, _ps, _mt, _span, _hits, _pc), "
        f"array_to_string(list_transform(_mt, lambda t, i: CASE WHEN _hits[i] IN ({drop_sql}) THEN NULL "
        f"{abbr_case.replace('WHEN ', 'WHEN _hits[i] = ')} ELSE t END), ' ') || _pc AS {f}_pert, "
        f"CASE WHEN _ap THEN array_to_string(_mt, ' ') ELSE {f}_clean END AS {f}_mixed, "
        f"_ap AS {f}_applied, coalesce(_sl, 0) AS {f}_span_len, _ps AS {f}_insert_pos, _span AS {f}_span, "
        f"CAST(len(list_filter(_hits, lambda h: h IN ({drop_sql}))) AS INTEGER) AS {f}_dropped, "
        f"CAST(len(list_filter(_hits, lambda h: h IN ({abbr_src}))) AS INTEGER) AS {f}_abbr, _pc AS {f}_punct "
        f"FROM ({s6})"
    )
    return s7


def examples(pairs_sql: str, task: str, variant: str = "perturbed") -> str:
    """Two rows per pair (flat provenance columns on the perturbed row)."""
    prompt = NLI_PROMPT if task == "nli" else QA_PROMPT
    p = f"SELECT * EXCLUDE (a_mixed, b_mixed) FROM ({perturb_field(perturb_field(pairs_sql, 'a'), 'b')})"
    meta_cols = [
        "a_applied", "a_span_len", "a_insert_pos", "a_span", "a_dropped", "a_abbr", "a_punct",
        "b_applied", "b_span_len", "b_insert_pos", "b_span", "b_dropped", "b_abbr", "b_punct",
    ]
    nulls = {
        "applied": "CAST(NULL AS BOOLEAN)", "span_len": "CAST(NULL AS INTEGER)", "insert_pos": "CAST(NULL AS INTEGER)",
        "span": "CAST(NULL AS VARCHAR)", "dropped": "CAST(NULL AS INTEGER)", "abbr": "CAST(NULL AS INTEGER)",
        "punct": "CAST(NULL AS VARCHAR)",
    }
    clean_meta = ", ".join(f"{nulls[c.split('_', 1)[1]]} AS {c}" for c in meta_cols)
    pert_meta = ", ".join(meta_cols)
    common = "pair_id, '{task}' AS task, split"
    clean = (
        f"SELECT pair_id || '__clean' AS id, {common.format(task=task)}, 'clean' AS variant, "
        f"{prompt('a_clean', 'b_clean')} AS input, a_clean AS text_a, b_clean AS text_b, label, {clean_meta} FROM p"
    )
    pert = (
        f"SELECT pair_id || '__{variant}' AS id, {common.format(task=task)}, '{variant}' AS variant, "
        f"{prompt('a_pert', 'b_pert')} AS input, a_pert AS text_a, b_pert AS text_b, label, {pert_meta} FROM p"
    )
    return f"WITH p AS ({p}) {clean} UNION ALL {pert}"
