"""DuckDB oracle SQL, one statement per registered query (same column names).

Written independently of the Spark code from the operator definitions: plain
window functions where Spark uses the distributed dense index, ``unnest`` +
``GROUP BY`` where Spark explodes, lists where Spark uses arrays.
"""

from __future__ import annotations

from pairshift.functions import text as tx
from pairshift.functions.labels import BASELINE_LABELS
from pairshift.operators import build as B
from pairshift.operators.reports import MODEL_SIZE_MILLIONS
from pairshift.plans import sqlparts as S
from pairshift.sources.tables import ADAPTER_MODELS, NLI_LABELS

q, U, TOK = S.q, S.U, S.TOK
SEED = "42"
ORACLE: dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = fn().strip()
        return fn
    return deco


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def r6(x: str, alias: str) -> str:
    return f"floor(CAST({x} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS {alias}"


# ---------------------------------------------------------------- shared inputs
def ex_nli(insert: str = "en") -> str:
    return f"SELECT *, {q('docs_fr-' + insert)} AS dataset FROM ({S.examples(S.nli_pairs('fr', insert), 'nli')})"


def ex_qa() -> str:
    return f"SELECT *, 'conv_fr-en' AS dataset FROM ({S.examples(S.qa_pairs('en'), 'qa')})"


def damaged(ex: str) -> str:
    return f"""
    WITH e AS (SELECT *, CAST(floor({U(SEED, q('damage'), 'id')} * 20) AS INTEGER) AS _r FROM ({ex})),
    k AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE _r = 1)
    SELECT * EXCLUDE (_r, pair_id, variant),
           CASE WHEN _r = 2 THEN NULL ELSE pair_id END AS pair_id,
           CASE WHEN _r = 0 THEN 'draft' WHEN _r = 3 AND variant = 'perturbed' THEN 'switchmix' ELSE variant END AS variant
    FROM k"""


def models_values() -> str:
    return "(VALUES " + ", ".join(f"({q(m)})" for m in ADAPTER_MODELS) + ") mm(model)"


def nli_preds(insert: str = "en") -> str:
    labs = lst(NLI_LABELS)
    verb = ("CASE l WHEN 'entailment' THEN 'It entails the premise.' "
            "WHEN 'contradiction' THEN 'The hypothesis contradicts it.' ELSE 'Neutral, I think.' END")
    base = f"""
      SELECT e.*, mm.model,
             coalesce(list_position({labs}, e.label) - 1, 0) AS gold,
             {U(SEED, q('pred'), 'mm.model', 'e.id')} < CASE WHEN e.variant = 'clean' THEN 0.62 ELSE 0.41 END AS hit,
             1 + CAST(floor({U(SEED, q('wrong'), 'mm.model', 'e.id')} * 2) AS INTEGER) AS shift,
             CAST(floor({U(SEED, q('style'), 'mm.model', 'e.id')} * 6) AS INTEGER) AS s
      FROM ({ex_nli(insert)}) e CROSS JOIN {models_values()}"""
    lab = f"""SELECT *, {labs}[1 + CASE WHEN hit THEN gold ELSE (gold + shift) % 3 END] AS l,
                       {labs}[1 + (gold + 1) % 3] AS o FROM ({base})"""
    return f"""
    SELECT * EXCLUDE (gold, hit, shift, s, l, o), {q('fr-' + insert)} AS language_pair,
      CASE s WHEN 0 THEN l WHEN 1 THEN 'The answer is ' || upper(l[1]) || l[2:] || '.'
             WHEN 2 THEN {verb} WHEN 3 THEN 'Label: ' || upper(l) WHEN 4 THEN ''
             ELSE 'not ' || o || ' but ' || l END AS prediction
    FROM ({lab})"""


def qa_preds() -> str:
    base = f"""
      SELECT e.*, mm.model, {TOK('e.label')} AS t,
             CAST(floor({U(SEED, q('qa_op'), 'mm.model', 'e.id')} * 4) AS INTEGER) AS op
      FROM ({ex_qa()}) e CROSS JOIN {models_values()}"""
    j = f"SELECT *, CAST(floor({U(SEED, q('qa_pos'), 'model', 'id')} * greatest(len(t), 1)) AS INTEGER) + 1 AS j FROM ({base})"
    return f"""
    SELECT * EXCLUDE (t, op, j), 'fr-en' AS language_pair, array_to_string(CASE op
        WHEN 1 THEN list_concat(t[1:j - 1], t[j + 1:len(t)])
        WHEN 2 THEN list_concat(t[1:j], t[j:len(t)])
        WHEN 3 THEN list_concat(t, ['extra'])
        ELSE t END, ' ') AS prediction
    FROM ({j})"""


def parse_label(x: str, variants: bool) -> str:
    t = f"array_to_string({TOK(f'translate(lower(coalesce({x}, {q("")})), {q(".,:")}, {q("   ")})', 'pw')}, ' ')"
    parts = []
    if variants:
        parts.append(f"WHEN contains({t}, 'entails') OR contains({t}, 'entailed') THEN 'entailment'")
        parts.append(f"WHEN contains({t}, 'contradicts') OR contains({t}, 'contradicted') THEN 'contradiction'")
    for lab in ("entailment", "neutral", "contradiction"):
        parts.append(f"WHEN contains({t}, {q(lab)}) THEN {q(lab)}")
    return "(CASE " + " ".join(parts) + " ELSE '' END)"


def pairs(ex: str, keep_len: bool = False) -> str:
    """J1 pairing: last row per (dataset, pair key, variant) by id; complete pairs only."""
    row = "{'id': id, 'task': task, 'split': split, 'text': coalesce(nullif(input, ''), '')}"
    return f"""
    SELECT dataset, pk AS pair_id, coalesce(c.task, p.task, '') AS task, coalesce(c.split, p.split, '') AS split,
           c.id AS clean_id, p.id AS perturbed_id, c.text AS clean_text, p.text AS perturbed_text
    FROM (
      SELECT dataset, coalesce(pair_id, split_part(coalesce(id, ''), '__', 1)) AS pk,
             arg_max({row}, CASE WHEN variant = 'clean' THEN id END) AS c,
             coalesce(arg_max({row}, CASE WHEN variant = 'perturbed' THEN id END),
                      arg_max({row}, CASE WHEN variant = 'switchmix' THEN id END)) AS p
      FROM ({ex}) GROUP BY dataset, pk)
    WHERE c IS NOT NULL AND p IS NOT NULL"""


def inspector_pairs(ex: str) -> str:
    row = "{'label': label, 'text': coalesce(nullif(input, ''), '')}"
    return f"""
    SELECT pk AS pair_id, count(*) AS n_rows,
           arg_min({row}, CASE WHEN variant = 'clean' THEN id END) AS c,
           arg_min({row}, CASE WHEN variant IN ('perturbed', 'switchmix') THEN id END) AS p
    FROM (SELECT *, coalesce(nullif(pair_id, ''), split_part(nullif(id, ''), '__', 1)) AS pk FROM ({ex}))
    WHERE pk IS NOT NULL GROUP BY pk"""


# ---------------------------------------------------------------- text scalars
@oracle("normalize_ws")
def _():
    return f"SELECT doc_id, array_to_string({TOK('text')}, ' ') AS normalized FROM documents"


@oracle("simple_tokenize")
def _():
    return f"SELECT doc_id, CAST(len({S.SIMPLE('text')}) AS INTEGER) AS n_tokens, array_to_string({S.SIMPLE('text')}, ' ') AS tokens FROM documents"


@oracle("normalize_answer")
def _():
    return f"SELECT conv_id, turn, {S.NORM_ANSWER('text')} AS normalized FROM conversations"


@oracle("char_word_counts")
def _():
    return f"SELECT doc_id, CAST({S.CHARS_NO_WS('text')} AS INTEGER) AS chars_no_ws, CAST({S.WORDS('text')} AS INTEGER) AS words FROM documents"


# ---------------------------------------------------------------- sources, zip, sampling
@oracle("parallel_zip")
def _():
    return f"""SELECT b.idx AS idx, b.id AS base_id, i.id AS insert_id, b.split
               FROM ({S.nli_corpus('fr')}) b JOIN ({S.nli_corpus('en')}) i ON b.idx = i.idx"""


@oracle("parallel_zip_file_order")
def _():
    return """WITH b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, text FROM documents),
                   i AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, conv_id, turn, text FROM conversations)
              SELECT idx, doc_id AS b_doc_id, conv_id AS i_conv_id, turn AS i_turn, CAST(length(b.text) AS BIGINT) AS base_chars,
                     CAST(length(i.text) AS BIGINT) AS insert_chars FROM b JOIN i USING (idx)"""


@oracle("label_map")
def _():
    return f"SELECT pair_id, label FROM ({S.nli_pairs()})"


@oracle("sample_n")
def _():
    return f"SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY {U(SEED, q('sample'), 'doc_id')}, doc_id LIMIT 100"


@oracle("sample_half")
def _():
    return f"SELECT doc_id, lang, n_chars FROM documents ORDER BY {U(SEED, q('sample'), 'doc_id')}, doc_id LIMIT 500"


@oracle("sample_per_split")
def _():
    return f"""SELECT pair_id, split FROM (
        SELECT pair_id, split, row_number() OVER (PARTITION BY split ORDER BY {U(SEED, 'split', q('sample'), 'pair_id')}, pair_id) AS rn
        FROM ({S.nli_pairs()}))
      WHERE rn <= CASE split WHEN 'train' THEN 60 WHEN 'test' THEN 15 ELSE 0 END"""


# ---------------------------------------------------------------- perturbation
def _pa(p_switch: float = 0.35) -> str:
    return S.perturb_field(f"SELECT pair_id, split, a_clean, a_insert FROM ({S.nli_pairs()})", "a", p_switch=p_switch)


@oracle("code_switch")
def _():
    return f"SELECT pair_id, a_mixed AS mixed FROM ({_pa()})"


@oracle("code_switch_meta")
def _():
    return f"SELECT pair_id, a_applied AS applied, a_span_len AS span_len, a_insert_pos AS insert_pos, a_span AS span FROM ({_pa()})"


@oracle("informal_noise")
def _():
    return f"SELECT pair_id, a_pert AS noised FROM ({_pa(-1.0)})"


@oracle("informal_noise_meta")
def _():
    return f"SELECT pair_id, a_dropped AS dropped, a_abbr AS abbr, a_punct AS punct FROM ({_pa(-1.0)})"


@oracle("perturb")
def _():
    return f"SELECT pair_id, a_pert, b_pert FROM ({S.perturb_field(S.perturb_field(S.nli_pairs(), 'a'), 'b')})"


# ---------------------------------------------------------------- prompts
@oracle("nli_prompt")
def _():
    return f"SELECT pair_id, {S.NLI_PROMPT('a_clean', 'b_clean')} AS prompt FROM ({S.nli_pairs()})"


@oracle("qa_prompt")
def _():
    return f"SELECT pair_id, {S.QA_PROMPT('a_clean', 'b_clean')} AS prompt FROM ({S.qa_pairs()})"


def legacy_sql() -> str:
    raw = S.halves("SELECT doc_id, text FROM documents WHERE lang = 'fr'", "text", "premise", "hypothesis", "doc_id")
    marker = f"{lst(tx.LEGACY_MARKERS)}[CAST(1 + floor({U(SEED, q('frame'), 'id')} * {len(tx.LEGACY_MARKERS)}) AS INTEGER)]"
    r = f"SELECT 'docs_fr_' || CAST(doc_id AS VARCHAR) AS id, premise, hypothesis, {S.LABEL_NAME('doc_id % 4')} AS label FROM ({raw})"
    clean = (f"{q(tx.LEGACY_CLEAN_HEAD)} || premise || {q(tx.LEGACY_CLEAN_MID)} || hypothesis || {q(tx.LEGACY_CLEAN_TAIL)}")
    mix = (f"{q(tx.LEGACY_MIX_HEAD)} || premise || {q(tx.LEGACY_MIX_MID)} || hypothesis || {q(tx.LEGACY_MIX_TAIL_OPEN)}"
           f" || {marker} || {q(tx.LEGACY_MIX_TAIL_CLOSE)}")
    return f"""
    SELECT id || '_clean' AS id, 'clean' AS variant, {clean} AS input, label FROM ({r})
    UNION ALL SELECT id || '_switchmix' AS id, 'switchmix' AS variant, {mix} AS input, label FROM ({r})"""


@oracle("legacy_frame")
def _():
    return legacy_sql()


def _field_line(x: str, field: str) -> str:
    hits = f"list_filter(string_split({x}, chr(10)), lambda ln: starts_with(lower({S.STRIP('ln')}), {q(field + ':')}))"
    last = f"({hits})[-1]"
    return f"(CASE WHEN len({hits}) > 0 THEN {S.STRIP(f'substr({last}, strpos({last}, {q(":")}) + 1)')} ELSE '' END)"


@oracle("prompt_parse")
def _():
    leg = f"SELECT id, input, CAST(NULL AS VARCHAR) AS text_a, CAST(NULL AS VARCHAR) AS text_b FROM ({legacy_sql()})"
    ex = f"SELECT id, input, text_a, text_b FROM ({ex_nli()})"
    have = "(text_a IS NOT NULL AND text_b IS NOT NULL)"
    return f"""SELECT id, CASE WHEN {have} THEN text_a ELSE {_field_line('input', 'premise')} END AS premise,
                      CASE WHEN {have} THEN text_b ELSE {_field_line('input', 'hypothesis')} END AS hypothesis
               FROM ({leg} UNION ALL {ex})"""


@oracle("strip_echo")
def _():
    causal = f"(model = {q(ADAPTER_MODELS[1])})"
    raw = f"CASE WHEN {causal} THEN input || chr(10) || prediction ELSE prediction END"
    return f"""SELECT id, model, {S.STRIP(f"CASE WHEN {causal} AND length(input) > 0 AND strpos(raw, input) > 0 THEN {S.STRIP('substr(raw, strpos(raw, input) + length(input))')} ELSE raw END")} AS answer
               FROM (SELECT *, {raw} AS raw FROM ({nli_preds()}))"""


# ---------------------------------------------------------------- builders
@oracle("build_nli_examples")
def _():
    return S.examples(S.nli_pairs(), "nli")


@oracle("build_qa_examples")
def _():
    return S.examples(S.qa_pairs(), "qa")


@oracle("build_legacy_pairs")
def _():
    return S.examples(S.nli_pairs(), "nli", variant="switchmix")


def _pick(values, key: str, name: str) -> str:
    return f"{lst(values)}[CAST(floor({U(SEED, key, 'doc_id', q(name))} * {len(values)}) AS INTEGER) + 1]"


def syn_nli_sql() -> str:
    pre = q("syn_nli")
    d = f"""SELECT doc_id, {_pick(B.SYN_NLI_LABELS, pre, 'label')} AS label, {_pick(B.SYN_NAMES, pre, 'name')} AS nm,
                   {_pick(B.SYN_CITIES, pre, 'city')} AS city,
                   CAST(floor({U(SEED, pre, 'doc_id', q('item'))} * {len(B.SYN_ITEMS_FR)}) AS INTEGER) + 1 AS it,
                   CAST(floor({U(SEED, pre, 'doc_id', q('hobby'))} * {len(B.SYN_HOBBIES_FR)}) AS INTEGER) + 1 AS hb
            FROM documents"""
    ifr, ien = f"{lst(B.SYN_ITEMS_FR)}[it]", f"{lst(B.SYN_ITEMS_EN)}[it]"
    hfr, hen = f"{lst(B.SYN_HOBBIES_FR)}[hb]", f"{lst(B.SYN_HOBBIES_EN)}[hb]"

    def by(e, c, n):
        return f"CASE label WHEN 'entailment' THEN {e} WHEN 'contradiction' THEN {c} ELSE {n} END"

    return f"""
    SELECT doc_id, 'syn_nli_42_' || printf('%06d', doc_id) AS pair_id,
      {by(f"nm || ' a acheté ' || {ifr} || ' hier.'", "'Il pleut aujourd''hui à ' || city || '.'", f"nm || ' aime ' || {hfr} || '.'")} AS premise_fr,
      {by(f"nm || ' bought ' || {ien} || ' yesterday.'", "'It is raining today in ' || city || '.'", f"nm || ' likes ' || {hen} || '.'")} AS premise_en,
      {by("nm || ' a acheté quelque chose.'", "'Le temps est sec aujourd''hui à ' || city || '.'", f"nm || ' a acheté ' || {ifr} || '.'")} AS hypothesis_fr,
      {by("nm || ' bought something.'", "'The weather is dry today in ' || city || '.'", f"nm || ' bought ' || {ien} || '.'")} AS hypothesis_en,
      label
    FROM ({d})"""


@oracle("synthetic_nli")
def _():
    return f"SELECT * EXCLUDE (doc_id) FROM ({syn_nli_sql()})"


@oracle("synthetic_qa")
def _():
    pre = q("syn_qa")
    d = f"""SELECT doc_id, {_pick(B.SYN_NAMES, pre, 'name')} AS nm,
                   CAST(floor({U(SEED, pre, 'doc_id', q('place'))} * {len(B.SYN_PLACES_FR)}) AS INTEGER) + 1 AS pl,
                   CAST(floor({U(SEED, pre, 'doc_id', q('fruit'))} * {len(B.SYN_FRUITS_FR)}) AS INTEGER) + 1 AS fr
            FROM documents"""
    ffr = f"{lst(B.SYN_FRUITS_FR)}[fr]"
    return f"""
    SELECT 'syn_qa_42_' || printf('%06d', doc_id) AS pair_id,
      nm || ' est allé ' || {lst(B.SYN_PLACES_FR)}[pl] || ' ce matin pour acheter des fruits. Il a choisi ' || {ffr} || '.' AS context_fr,
      nm || ' went ' || {lst(B.SYN_PLACES_EN)}[pl] || ' this morning to buy fruit. He chose ' || {lst(B.SYN_FRUITS_EN)}[fr] || '.' AS context_en,
      'Quels fruits ' || nm || ' a-t-il achetés ?' AS question_fr,
      'What fruits did ' || nm || ' buy?' AS question_en,
      {S.STRIP(f"replace({ffr}, 'des ', '')")} AS answer
    FROM ({d})"""


@oracle("build_synthetic_examples")
def _():
    p = f"""SELECT pair_id, CASE WHEN doc_id % 5 < 4 THEN 'train' ELSE 'test' END AS split,
                   premise_fr AS a_clean, premise_en AS a_insert, hypothesis_fr AS b_clean, hypothesis_en AS b_insert, label
            FROM ({syn_nli_sql()})"""
    return S.examples(p, "nli")


# ---------------------------------------------------------------- pairing
@oracle("pair_key")
def _():
    return f"SELECT id, variant, coalesce(pair_id, split_part(coalesce(id, ''), '__', 1)) AS pair_key FROM ({damaged(ex_nli())})"


@oracle("pair_rows")
def _():
    return f"""SELECT dataset, pair_id, clean_id, perturbed_id, task, split,
                      CAST(length(clean_text) AS BIGINT) AS clean_len, CAST(length(perturbed_text) AS BIGINT) AS perturbed_len
               FROM ({pairs(damaged(ex_nli()))})"""


@oracle("build_from_parallel")
def _():
    def side(lang):
        src = (f"SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, text, CASE WHEN doc_id % 5 < 4 THEN 'train' ELSE 'test' END AS split, "
               f"CAST(doc_id % 4 AS INTEGER) AS label FROM documents WHERE lang = {q(lang)}")
        return S.halves(f"SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS idx FROM ({src})", "text", "premise", "hypothesis",
                        "id, split, idx, label")
    pairs_ = (f"SELECT b.id AS pair_id, b.split, b.premise AS a_clean, i.premise AS a_insert, b.hypothesis AS b_clean, i.hypothesis AS b_insert, "
              f"{S.LABEL_NAME('b.label')} AS label FROM ({side('fr')}) b JOIN ({side('en')}) i ON b.split = i.split AND b.idx = i.idx")
    chosen = f"""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {U(SEED, 'split', q('sample'), 'pair_id')}, pair_id) AS rn
                 FROM ({pairs_})) WHERE rn <= CASE split WHEN 'train' THEN 30 ELSE 10 END"""
    return f"SELECT id, pair_id, split, variant, label, CAST(length(input) AS BIGINT) AS input_len FROM ({S.examples(chosen, 'nli')})"


@oracle("pair_rows_without_id")
def _():
    return f"""SELECT dataset, pair_id, task, split, CAST(length(clean_text) AS BIGINT) AS clean_len, CAST(length(perturbed_text) AS BIGINT) AS perturbed_len
               FROM ({pairs(ex_nli())})"""


@oracle("max_pairs_limit")
def _():
    both = f"SELECT * FROM ({damaged(ex_nli())}) UNION ALL BY NAME SELECT * FROM ({damaged(ex_qa())})"
    row = "{'id': id}"
    return f"""
    SELECT dataset, pk AS pair_id FROM (
      SELECT dataset, pk, c, p, row_number() OVER (PARTITION BY dataset ORDER BY first_seen, pk) AS rn FROM (
        SELECT dataset, coalesce(pair_id, split_part(coalesce(id, ''), '__', 1)) AS pk, min(id) AS first_seen,
               arg_max({row}, CASE WHEN variant = 'clean' THEN id END) AS c,
               coalesce(arg_max({row}, CASE WHEN variant = 'perturbed' THEN id END),
                        arg_max({row}, CASE WHEN variant = 'switchmix' THEN id END)) AS p
        FROM ({both}) GROUP BY dataset, pk))
    WHERE rn <= 40 AND c IS NOT NULL AND p IS NOT NULL"""


@oracle("pair_size_histogram")
def _():
    return f"""SELECT CAST(n_rows AS BIGINT) AS pair_size, CAST(count(*) AS BIGINT) AS n_pairs
               FROM ({inspector_pairs(damaged(ex_nli()))}) GROUP BY n_rows"""


# ---------------------------------------------------------------- tokens
def _tokenized(pairs_sql: str, tok) -> str:
    return f"SELECT *, {tok('clean_text')} AS ct, {tok('perturbed_text')} AS pt FROM ({pairs_sql})"


@oracle("pair_token_deltas")
def _():
    t = _tokenized(pairs(ex_nli()), S.SIMPLE)
    d = f"""SELECT dataset, task, split, pair_id, CAST(len(ct) AS INTEGER) AS c, CAST(len(pt) AS INTEGER) AS p,
                   greatest(1, {S.WORDS('clean_text')}) AS cw, greatest(1, {S.WORDS('perturbed_text')}) AS pw,
                   greatest(1, {S.CHARS_NO_WS('clean_text')}) AS cc, greatest(1, {S.CHARS_NO_WS('perturbed_text')}) AS pc
            FROM ({t})"""
    return f"""SELECT dataset, task, split, pair_id, c AS clean_tokens, p AS perturbed_tokens, p - c AS token_increase,
                      {r6('p / greatest(1, c)', 'length_inflation')}, {r6('c / cw', 'fragmentation_clean')},
                      {r6('p / pw', 'fragmentation_perturbed')}, {r6('c / cc', 'tokens_per_char_clean')},
                      {r6('p / pc', 'tokens_per_char_perturbed')}
               FROM ({d})"""


def hist_sql(pairs_sql: str, tok) -> str:
    t = _tokenized(pairs_sql, tok)
    return f"""SELECT dataset, task, split, tok AS token, CAST(sum(cn) AS BIGINT) AS n_clean, CAST(sum(pn) AS BIGINT) AS n_perturbed FROM (
                 SELECT dataset, task, split, unnest(ct) AS tok, 1 AS cn, 0 AS pn FROM ({t})
                 UNION ALL SELECT dataset, task, split, unnest(pt) AS tok, 0 AS cn, 1 AS pn FROM ({t}))
               GROUP BY dataset, task, split, tok"""


def js_sql(pairs_sql: str, tok) -> str:
    eps = 1e-12
    return f"""
    WITH h AS ({hist_sql(pairs_sql, tok)}),
    tot AS (SELECT dataset, task, split, sum(n_clean) AS tc, sum(n_perturbed) AS tp FROM h GROUP BY ALL),
    cl AS (SELECT h.dataset, h.task, h.split,
                  least(greatest(n_clean / greatest(1.0, tc), {eps}), 1.0) AS x,
                  least(greatest(n_perturbed / greatest(1.0, tp), {eps}), 1.0) AS y
           FROM h JOIN tot USING (dataset, task, split)),
    sm AS (SELECT dataset, task, split, sum(x) AS sx, sum(y) AS sy FROM cl GROUP BY ALL),
    js AS (SELECT dataset, task, split,
                  sum(0.5 * (x / sx) * log2((x / sx) / (0.5 * (x / sx + y / sy)))
                    + 0.5 * (y / sy) * log2((y / sy) / (0.5 * (x / sx + y / sy)))) AS js
           FROM cl JOIN sm USING (dataset, task, split) GROUP BY ALL),
    g AS (SELECT DISTINCT dataset, task, split FROM ({pairs_sql}))
    SELECT g.dataset, g.task, g.split, floor(coalesce(js.js, 0.0) * 1e6 + 0.5) / 1e6 AS token_js_divergence_bits
    FROM g LEFT JOIN js USING (dataset, task, split)"""


@oracle("token_histogram")
def _():
    return hist_sql(pairs(ex_nli()), TOK)


@oracle("js_divergence")
def _():
    return js_sql(pairs(ex_nli()), TOK)


@oracle("tokenizer_stats")
def _():
    pr = pairs(ex_nli())
    t = _tokenized(pr, S.SIMPLE)
    return f"""
    WITH d AS (SELECT dataset, task, split, len(ct) AS c, len(pt) AS p,
                 greatest(1, {S.WORDS('clean_text')}) AS cw, greatest(1, {S.WORDS('perturbed_text')}) AS pw,
                 greatest(1, {S.CHARS_NO_WS('clean_text')}) AS cc, greatest(1, {S.CHARS_NO_WS('perturbed_text')}) AS pc
               FROM ({t})),
    m AS (SELECT dataset, task, split, CAST(count(*) AS BIGINT) AS n_pairs,
                 avg(c) AS a1, avg(p) AS a2, avg(p - c) AS a3, avg(p / greatest(1, c)) AS a4, avg(c / cw) AS a5,
                 avg(p / pw) AS a6, avg(c / cc) AS a7, avg(p / pc) AS a8
          FROM d GROUP BY ALL),
    js AS ({js_sql(pr, S.SIMPLE)})
    SELECT m.dataset AS data_path, m.task, m.split, 'simple' AS tokenizer, n_pairs,
           {r6('a1', 'avg_clean_tokens')}, {r6('a2', 'avg_perturbed_tokens')}, {r6('a3', 'avg_token_increase')},
           {r6('a4', 'avg_length_inflation')}, {r6('a5', 'avg_fragmentation_clean')},
           {r6('a6', 'avg_fragmentation_perturbed')}, {r6('a7', 'avg_tokens_per_char_clean')},
           {r6('a8', 'avg_tokens_per_char_perturbed')}, js.token_js_divergence_bits
    FROM m JOIN js USING (dataset, task, split)"""


# ---------------------------------------------------------------- scoring
@oracle("parse_label_variants")
def _():
    return f"SELECT id, model, prediction, {parse_label('prediction', True)} AS parsed FROM ({nli_preds()})"


@oracle("parse_label_plain")
def _():
    return f"SELECT id, model, prediction, {parse_label('prediction', False)} AS parsed FROM ({nli_preds()})"


def f1_sql(preds: str) -> str:
    return f"""
    WITH r AS (SELECT id, model, variant, {TOK(S.NORM_ANSWER('prediction'))} AS pt, {TOK(S.NORM_ANSWER('label'))} AS gt FROM ({preds})),
    c AS (SELECT id, model, sum(least(np, ng)) AS common FROM (
            SELECT id, model, tok, sum(p) AS np, sum(g) AS ng FROM (
              SELECT id, model, unnest(pt) AS tok, 1 AS p, 0 AS g FROM r
              UNION ALL SELECT id, model, unnest(gt) AS tok, 0 AS p, 1 AS g FROM r) GROUP BY ALL) GROUP BY ALL),
    z AS (SELECT r.id, r.model, r.variant, len(pt) AS np, len(gt) AS ng, coalesce(c.common, 0) AS common
          FROM r LEFT JOIN c USING (id, model))
    SELECT id, model, variant, CAST(np AS INTEGER) AS n_pred, CAST(ng AS INTEGER) AS n_gold,
           CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 WHEN common = 0 THEN 0.0
                ELSE 2 * (common / np) * (common / ng) / ((common / np) + (common / ng)) END AS f1
    FROM z"""


@oracle("f1_per_example")
def _():
    return f"SELECT id, model, n_pred, n_gold, {r6('f1', 'f1')} FROM ({f1_sql(qa_preds())})"


def acc_sql(rows: str, pred: str, name: str = "accuracy") -> str:
    return f"""SELECT model, variant, {r6(f"coalesce(avg(CAST({S.NORM_ANSWER(pred)} = {S.NORM_ANSWER('label')} AS DOUBLE)), 0.0)", name)},
                      CAST(count(*) AS BIGINT) AS n FROM ({rows}) GROUP BY model, variant"""


@oracle("accuracy_normalized")
def _():
    return acc_sql(f"SELECT *, {parse_label('prediction', True)} AS parsed FROM ({nli_preds()})", "parsed")


@oracle("exact_match")
def _():
    return acc_sql(qa_preds(), "prediction", "exact_match")


@oracle("mean_f1")
def _():
    return f"SELECT model, variant, {r6('avg(f1)', 'mean_f1')}, CAST(count(*) AS BIGINT) AS n FROM ({f1_sql(qa_preds())}) GROUP BY model, variant"


@oracle("robustness_drop")
def _():
    ok = f"CAST(lower({S.STRIP('parsed')}) = lower({S.STRIP('label')}) AS DOUBLE)"
    return f"""SELECT model, {r6("avg(CASE WHEN variant = 'clean' THEN ok END)", 'clean_accuracy')},
                      {r6("avg(CASE WHEN variant IN ('perturbed', 'switchmix') THEN ok END)", 'perturbed_accuracy')},
                      {r6("avg(CASE WHEN variant = 'clean' THEN ok END) - avg(CASE WHEN variant IN ('perturbed', 'switchmix') THEN ok END)", 'robustness_drop')}
               FROM (SELECT *, {ok} AS ok FROM (SELECT *, {parse_label('prediction', True)} AS parsed FROM ({nli_preds()})))
               GROUP BY model"""


def report_sql(preds: str) -> str:
    ok = (f"CASE WHEN task = 'nli' THEN CAST({parse_label('prediction', False)} = label AS DOUBLE) "
          f"ELSE CAST({S.NORM_ANSWER('prediction')} = {S.NORM_ANSWER('label')} AS DOUBLE) END")
    g = f"""SELECT language_pair, task, model,
                   sum(CASE WHEN variant = 'clean' THEN ok ELSE 0.0 END) AS cs,
                   sum(CASE WHEN variant IN ('perturbed', 'switchmix') THEN ok ELSE 0.0 END) AS ms,
                   CAST(count(CASE WHEN variant = 'clean' THEN 1 END) AS BIGINT) AS n_clean,
                   CAST(count(CASE WHEN variant IN ('perturbed', 'switchmix') THEN 1 END) AS BIGINT) AS n_switchmix
            FROM (SELECT *, {ok} AS ok FROM ({preds})) GROUP BY language_pair, task, model"""
    return f"""SELECT language_pair, task, model, CASE WHEN task = 'nli' THEN 'accuracy' ELSE 'exact_match' END AS metric,
                      cs / greatest(1, n_clean) AS clean_score, ms / greatest(1, n_switchmix) AS switchmix_score,
                      cs / greatest(1, n_clean) - ms / greatest(1, n_switchmix) AS robustness_drop, n_clean, n_switchmix
               FROM ({g})"""


def _round_report(x: str) -> str:
    return f"""SELECT language_pair, task, model, metric, {r6('clean_score', 'clean_score')}, {r6('switchmix_score', 'switchmix_score')},
                      {r6('robustness_drop', 'robustness_drop')}, n_clean, n_switchmix FROM ({x})"""


@oracle("robustness_report")
def _():
    both = f"SELECT id, task, variant, label, model, prediction, language_pair FROM ({nli_preds()}) UNION ALL " \
           f"SELECT id, task, variant, label, model, prediction, language_pair FROM ({qa_preds()})"
    return _round_report(report_sql(both))


@oracle("score_join")
def _():
    ex = ex_nli()
    j = f"""SELECT e.id, e.variant, e.label, p.model, p.prediction FROM ({ex}) e
            JOIN (SELECT id, model, prediction FROM ({nli_preds()})) p ON e.id = p.id"""
    return acc_sql(f"SELECT *, {parse_label('prediction', True)} AS parsed FROM ({j})", "parsed")


@oracle("baseline_random")
def _():
    pick = f"{lst(BASELINE_LABELS)}[CAST(floor({U(SEED, q('baseline'), 'id')} * 3) AS INTEGER) + 1]"
    both = f"SELECT id, task FROM ({ex_nli()}) UNION ALL SELECT id, task FROM ({ex_qa()})"
    return f"""SELECT id, task, 'baseline_random' AS model, CASE WHEN task = 'nli' THEN {pick} ELSE '' END AS prediction
               FROM ({both})"""


@oracle("filter_task_split")
def _():
    both = f"SELECT id, task, split, variant FROM ({ex_nli()}) UNION ALL SELECT id, task, split, variant FROM ({ex_qa()})"
    return f"SELECT id FROM ({both}) WHERE task = 'nli' AND split = 'test' AND variant = 'clean'"


@oracle("first_n_examples")
def _():
    return f"SELECT id, label FROM ({ex_nli()}) ORDER BY id LIMIT 25"


def valid_sql(x: str) -> str:
    lid = (f"CASE lower({S.STRIP('coalesce(label, ' + q('') + ')')}) WHEN 'entailment' THEN 0 WHEN 'neutral' THEN 1 "
           f"WHEN 'contradiction' THEN 2 END")
    return (f"SELECT *, (coalesce(length(text_a), 0) > 0 AND coalesce(length(text_b), 0) > 0 AND ({lid}) IS NOT NULL) AS valid, "
            f"{lid} AS label_id FROM ({x})")


@oracle("skip_counts")
def _():
    return f"""SELECT split, variant, CAST(count(CASE WHEN valid THEN 1 END) AS BIGINT) AS n_valid,
                      CAST(count(CASE WHEN NOT valid THEN 1 END) AS BIGINT) AS n_skipped
               FROM ({valid_sql(ex_nli())}) GROUP BY split, variant"""


# ---------------------------------------------------------------- reports
def cross_sql() -> str:
    reps = " UNION ALL ".join(f"SELECT * FROM ({report_sql(nli_preds(i))})" for i in ("en", "es", "de"))
    return f"""SELECT language_pair, model, clean_score AS clean_accuracy, switchmix_score AS switchmix_accuracy, robustness_drop
               FROM ({reps})"""


@oracle("cross_language")
def _():
    return f"""SELECT language_pair, model, {r6('clean_accuracy', 'clean_accuracy')}, {r6('switchmix_accuracy', 'switchmix_accuracy')},
                      {r6('robustness_drop', 'robustness_drop')} FROM ({cross_sql()})"""


@oracle("cross_language_pivot")
def _():
    a, b = ADAPTER_MODELS
    return f"""SELECT language_pair,
                      {r6(f"coalesce(avg(CASE WHEN model = {q(a)} THEN robustness_drop END), 0.0)", 'drop_model_a')},
                      {r6(f"coalesce(avg(CASE WHEN model = {q(b)} THEN robustness_drop END), 0.0)", 'drop_model_b')}
               FROM ({cross_sql()}) WHERE NOT (language_pair = 'fr-de' AND model = {q(b)}) GROUP BY language_pair"""


@oracle("paper_table")
def _():
    return f"""SELECT model, language_pair, {r6('clean_accuracy', 'clean_accuracy')}, {r6('switchmix_accuracy', 'switchmix_accuracy')},
                      {r6('robustness_drop', 'robustness_drop')} FROM ({cross_sql()})"""


@oracle("all_results")
def _():
    rep = _round_report(report_sql(nli_preds()))
    cross = f"""SELECT language_pair, model, {r6('clean_accuracy', 'clean_accuracy')}, {r6('switchmix_accuracy', 'switchmix_accuracy')},
                       {r6('robustness_drop', 'robustness_drop')} FROM ({cross_sql()})"""
    return f"SELECT * FROM ({rep}) UNION ALL BY NAME SELECT * FROM ({cross})"


# ---------------------------------------------------------------- inspection
@oracle("counts_by_dim")
def _():
    dm = ex_nli()
    return " UNION ALL ".join(
        f"SELECT {q(d)} AS dimension, coalesce(CAST({d} AS VARCHAR), '') AS value, CAST(count(*) AS BIGINT) AS n_rows FROM ({dm}) GROUP BY {d}"
        for d in ("variant", "task", "split")
    )


@oracle("length_stats")
def _():
    ip = inspector_pairs(ex_nli())
    lens = f"""SELECT 'clean' AS side, length(c.text) AS len FROM ({ip}) WHERE c IS NOT NULL
               UNION ALL SELECT 'perturbed' AS side, length(p.text) AS len FROM ({ip}) WHERE p IS NOT NULL"""
    g = f"SELECT side, count(*) AS n, avg(len) AS mean, list_sort(list(len)) AS xs, max(len) AS mx FROM ({lens}) GROUP BY side"
    return f"""SELECT side, CAST(n AS BIGINT) AS n, {r6('mean', 'mean')},
                      {r6('xs[CAST(round_even((n - 1) * 0.5, 0) AS INTEGER) + 1]', 'p50')},
                      {r6('xs[CAST(round_even((n - 1) * 0.9, 0) AS INTEGER) + 1]', 'p90')},
                      {r6('mx', 'max')} FROM ({g})"""


@oracle("perturbation_rates")
def _():
    cols = ["CAST(count(*) AS BIGINT) AS n_rows"]
    for f in ("a", "b"):
        cols += [
            r6(f"avg(CAST({f}_applied AS DOUBLE))", f"{f}_applied_rate"),
            r6(f"avg(CASE WHEN {f}_applied THEN {f}_span_len END)", f"{f}_avg_span_len"),
            f"CAST(sum({f}_dropped) AS BIGINT) AS {f}_dropped_tokens",
            f"CAST(sum({f}_abbr) AS BIGINT) AS {f}_abbreviations",
            r6(f"avg(CAST({f}_punct <> '' AS DOUBLE))", f"{f}_punct_rate"),
        ]
    return f"""SELECT task, split, label, {', '.join(cols)} FROM ({ex_nli()})
               WHERE variant IN ('perturbed', 'switchmix') GROUP BY task, split, label"""


@oracle("show_pairs")
def _():
    ip = inspector_pairs(ex_nli())
    return f"""SELECT pair_id, c.label AS clean_label, substr(c.text, 1, 400) AS clean_text,
                      p.label AS perturbed_label, substr(p.text, 1, 400) AS perturbed_text
               FROM ({ip}) ORDER BY {U(SEED, q('show'), 'pair_id')}, pair_id LIMIT 5"""


# ---------------------------------------------------------------- vectors, efficiency, models
def vectors_sql() -> str:
    v = """SELECT vec_id // 2 AS pair_id, CASE WHEN vec_id % 2 = 0 THEN 'clean' ELSE 'perturbed' END AS variant,
                  CAST(layer AS INTEGER) AS layer,
                  CAST(embedding[layer * (len(embedding) // 8) + 1 : layer * (len(embedding) // 8) + len(embedding) // 8] AS DOUBLE[]) AS vec
           FROM embeddings, range(8) t(layer)"""
    zero = f"layer = 0 AND variant = 'clean' AND {U(SEED, q('zero'), 'pair_id')} < 0.02"
    return f"""SELECT pair_id, variant, layer, CASE WHEN {zero} THEN list_transform(vec, lambda x: 0.0) ELSE vec END AS vec
               FROM ({v})"""


def cos_sql(a: str, b: str) -> str:
    dot = f"list_sum(list_transform({a}, lambda x, i: x * {b}[i]))"
    na = f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"
    nb = f"sqrt(list_sum(list_transform({b}, lambda x: x * x)))"
    return f"(coalesce({dot}, 0.0) / (greatest(coalesce({na}, 0.0), 1e-8) * greatest(coalesce({nb}, 0.0), 1e-8)))"


def drift_sql() -> str:
    v = vectors_sql()
    return f"""SELECT c.pair_id, c.layer, CASE WHEN c.pair_id % 5 < 4 THEN 'train' ELSE 'test' END AS split,
                      {cos_sql('c.vec', 'p.vec')} AS cosine
               FROM ({v}) c JOIN ({v}) p ON c.pair_id = p.pair_id AND c.layer = p.layer
               WHERE c.variant = 'clean' AND p.variant = 'perturbed'"""


@oracle("vector_drift")
def _():
    return f"SELECT pair_id, layer, {r6('cosine', 'cosine')}, {r6('1.0 - cosine', 'drift')} FROM ({drift_sql()})"


@oracle("representation_shift")
def _():
    return f"""SELECT 'embeddings' AS data_path, 'embeddings' AS model, 'cls' AS pool, 'nli' AS task, split, layer,
                      CAST(count(*) AS BIGINT) AS n_pairs, {r6('avg(cosine)', 'mean_cosine')},
                      {r6('stddev_pop(cosine)', 'std_cosine')}, {r6('avg(1.0 - cosine)', 'mean_drift')}
               FROM ({drift_sql()}) GROUP BY split, layer"""


def token_vectors_sql() -> str:
    keep = f"(pos = 0 OR {U(SEED, q('mask'), 'pair_id', 'variant', 'pos')} >= 0.3)"
    v = """SELECT vec_id // 2 AS pair_id, CASE WHEN vec_id % 2 = 0 THEN 'clean' ELSE 'perturbed' END AS variant,
                  CAST(pos AS INTEGER) AS pos,
                  CAST(embedding[pos * (len(embedding) // 8) + 1 : pos * (len(embedding) // 8) + len(embedding) // 8] AS DOUBLE[]) AS vec
           FROM embeddings, range(8) t(pos)"""
    return f"SELECT *, CASE WHEN pair_id = 3 THEN 0 WHEN {keep} THEN 1 ELSE 0 END AS mask FROM ({v})"


def pooled_drift_sql(pooled: str, method: str) -> str:
    cos = cos_sql("c.vec", "p.vec")
    return f"""SELECT c.pair_id, {q(method)} AS pool, {r6(cos, 'cosine')}, {r6('1.0 - ' + cos, 'drift')}
               FROM ({pooled}) c JOIN ({pooled}) p ON c.pair_id = p.pair_id
               WHERE c.variant = 'clean' AND p.variant = 'perturbed'"""


@oracle("pool_cls")
def _():
    return pooled_drift_sql(f"SELECT pair_id, variant, vec FROM ({token_vectors_sql()}) WHERE pos = 0", "cls")


@oracle("pool_mean")
def _():
    e = f"SELECT pair_id, variant, mask, unnest(vec) AS v, unnest(range(len(vec))) AS dim FROM ({token_vectors_sql()})"
    s = f"""SELECT pair_id, variant, dim, sum(v * mask) / greatest(CAST(sum(mask) AS DOUBLE), 1.0) AS val
            FROM ({e}) GROUP BY pair_id, variant, dim"""
    pooled = f"SELECT pair_id, variant, list(val ORDER BY dim) AS vec FROM ({s}) GROUP BY pair_id, variant"
    return pooled_drift_sql(pooled, "mean")


@oracle("efficiency_summary")
def _():
    t = f"""SELECT dataset, task, split, least(len({S.SIMPLE('clean_text')}), 256) AS c, least(len({S.SIMPLE('perturbed_text')}), 256) AS p
            FROM ({pairs(ex_nli())})"""
    g = f"SELECT dataset, task, split, CAST(count(*) AS BIGINT) AS n_pairs, avg(c) AS ac, avg(p) AS ap FROM ({t}) GROUP BY ALL"
    act_c = "CAST(round_even(ac, 0) AS BIGINT) * 512 * 4"
    act_p = "CAST(round_even(ap, 0) AS BIGINT) * 512 * 4"
    return f"""SELECT dataset AS data_path, task, split, 'encoder-512' AS model, 'cpu' AS device, 256 AS max_length, n_pairs,
                      {r6('ac', 'avg_seq_len_clean')}, {r6('ap', 'avg_seq_len_perturbed')}, {r6('ap - ac', 'avg_seq_len_delta')},
                      CAST(0.0 AS DOUBLE) AS avg_latency_ms_clean, CAST(0.0 AS DOUBLE) AS avg_latency_ms_perturbed, CAST(0.0 AS DOUBLE) AS avg_latency_ms_delta,
                      CAST(512 AS BIGINT) AS hidden_size, {act_c} AS activation_bytes_clean_est, {act_p} AS activation_bytes_perturbed_est,
                      {act_p} - {act_c} AS activation_bytes_delta_est, FALSE AS include_tokenization_time
               FROM ({g})"""


def logits_sql() -> str:
    lg = "[" + ", ".join(f"floor({U(SEED, q('logit'), 'mm.model', 'e.id', str(k))} * 10 + 0.5) / 10" for k in range(3)) + "]"
    return f"""SELECT e.*, mm.model, {lg} AS logits FROM ({ex_nli()}) e CROSS JOIN {models_values()}"""


@oracle("logits_accuracy")
def _():
    v = valid_sql(logits_sql())
    hit = "CAST(list_position(logits, list_max(logits)) - 1 = label_id AS DOUBLE)"
    return f"""SELECT model, split, variant, {r6(f'avg({hit})', 'accuracy')}, CAST(count(*) AS BIGINT) AS n
               FROM ({v}) WHERE valid GROUP BY model, split, variant"""


def sizes_values() -> str:
    return "(VALUES " + ", ".join(f"({q(k)}, CAST({v} AS BIGINT))" for k, v in MODEL_SIZE_MILLIONS.items()) + ") sz(model, estimated_model_size)"


@oracle("scaling_table")
def _():
    v = valid_sql(logits_sql())
    hit = "CAST(list_position(logits, list_max(logits)) - 1 = label_id AS DOUBLE)"
    tr, tc, tp = ("split = 'train' AND variant = 'clean'", "split = 'test' AND variant = 'clean'",
                  "split = 'test' AND variant = 'perturbed'")
    g = f"""SELECT model,
              CAST(count(CASE WHEN {tr} AND valid THEN 1 END) AS BIGINT) AS n_train,
              CAST(count(CASE WHEN {tc} AND valid THEN 1 END) AS BIGINT) AS n_test_clean,
              CAST(count(CASE WHEN {tp} AND valid THEN 1 END) AS BIGINT) AS n_test_perturbed,
              CAST(count(CASE WHEN {tr} AND NOT valid THEN 1 END) AS BIGINT) AS train_skipped,
              CAST(count(CASE WHEN {tc} AND NOT valid THEN 1 END) AS BIGINT) AS test_clean_skipped,
              CAST(count(CASE WHEN {tp} AND NOT valid THEN 1 END) AS BIGINT) AS test_perturbed_skipped,
              coalesce(avg(CASE WHEN {tc} AND valid THEN {hit} END), 0.0) AS ca,
              coalesce(avg(CASE WHEN {tp} AND valid THEN {hit} END), 0.0) AS pa
            FROM ({v}) WHERE task = 'nli' GROUP BY model"""
    return f"""SELECT 'nli' AS task, g.model, 42 AS seed, 'train' AS train_split, 'test' AS test_split,
                      n_train, n_test_clean, n_test_perturbed, train_skipped, test_clean_skipped, test_perturbed_skipped,
                      {r6('ca', 'clean_accuracy')}, {r6('pa', 'perturbed_accuracy')}, {r6('ca - pa', 'robustness_gap_delta')},
                      g.model AS model_name, sz.estimated_model_size, {r6('pa', 'switchmix_accuracy')}, {r6('ca - pa', 'robustness_drop')}
               FROM ({g}) g LEFT JOIN {sizes_values()} ON g.model = sz.model"""


@oracle("model_size_lookup")
def _():
    return f"""SELECT m.model, sz.estimated_model_size FROM (SELECT DISTINCT model FROM ({nli_preds()})) m
               LEFT JOIN {sizes_values()} ON m.model = sz.model"""


@oracle("eval_prompt")
def _():
    return f"""SELECT id, coalesce(CASE WHEN {U(SEED, q('no_prompt'), 'id')} < 0.3 THEN NULL ELSE input END, input) AS text
               FROM ({ex_nli()})"""


@oracle("first_answer")
def _():
    turns = (
        "SELECT concat_ws('_', CAST(u.conv_id AS VARCHAR), CAST(u.turn AS VARCHAR)) AS id, "
        "a.text AS answer, u.text AS question "
        "FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
        "WHERE u.role = 'user' AND a.role = 'assistant'"
    )
    return f"""SELECT id, coalesce(CASE WHEN {U(SEED, q('no_answers'), 'id')} < 0.3 THEN NULL ELSE answer END, question, '') AS answer
               FROM ({turns})"""


# ---------------------------------------------------------------- predictors, latencies, sweep
@oracle("qa_f1_report")
def _():
    return f"""SELECT 'fr-en' AS language_pair, model, {r6("avg(f1) FILTER (variant = 'clean')", 'clean_f1')},
                      {r6("avg(f1) FILTER (variant = 'perturbed')", 'switchmix_f1')},
                      {r6("avg(f1) FILTER (variant = 'clean') - avg(f1) FILTER (variant = 'perturbed')", 'robustness_drop')},
                      CAST(count(*) FILTER (variant = 'clean') AS BIGINT) AS n_clean, CAST(count(*) FILTER (variant = 'perturbed') AS BIGINT) AS n_switchmix
               FROM ({f1_sql(qa_preds())}) GROUP BY model"""


@oracle("sweep_plan")
def _():
    v = valid_sql(ex_nli())
    n = lambda side, split, ok: f"CAST(count(*) FILTER (variant = '{side}' AND split = '{split}' AND valid = {ok}) AS BIGINT)"
    return f"""SELECT capacity, {n('clean', 'train', 'true')} AS n_train, {n('clean', 'test', 'true')} AS n_test_clean, {n('perturbed', 'test', 'true')} AS n_test_perturbed,
                      {n('clean', 'train', 'false')} AS train_skipped, {n('clean', 'test', 'false')} AS test_clean_skipped,
                      {n('perturbed', 'test', 'false')} AS test_perturbed_skipped, CAST(3 * capacity + 3 AS BIGINT) AS n_parameters
               FROM ({v}) CROSS JOIN (VALUES (256), (1024), (4096)) c(capacity) GROUP BY capacity"""


@oracle("predict_hook")
def _():
    return f"""SELECT id, variant, CASE length(input) % 3 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' ELSE 'contradiction' END AS prediction
               FROM ({ex_nli()})"""


@oracle("filter_task")
def _():
    return f"SELECT id, split, variant FROM ({ex_qa()})"


@oracle("distinct_models")
def _():
    return f"SELECT 'model' AS \"column\", model AS value FROM {models_values()} UNION ALL SELECT 'language_pair', unnest(['fr-en', 'fr-es'])"


@oracle("efficiency_latency")
def _():
    ms = f"{U(SEED, q('latency'), 'id')} * 50"
    return f"""SELECT dataset AS data_path, task, split, CAST(count(DISTINCT pair_id) AS BIGINT) AS n_pairs,
                      {r6(f"avg({ms}) FILTER (variant = 'clean')", 'avg_latency_ms_clean')},
                      {r6(f"avg({ms}) FILTER (variant = 'perturbed')", 'avg_latency_ms_perturbed')}
               FROM ({ex_nli()}) GROUP BY dataset, task, split"""


# ---------------------------------------------------------------- round trips
@oracle("examples_jsonl_roundtrip")
def _():
    return f"""SELECT pair_id, CAST(length(clean_text) AS BIGINT) AS clean_len, CAST(length(perturbed_text) AS BIGINT) AS perturbed_len
               FROM ({pairs(ex_nli())})"""


@oracle("examples_parquet_roundtrip")
def _():
    return f"SELECT id, pair_id, variant, input, label, a_span_len FROM ({ex_nli()})"


@oracle("metric_table_roundtrip")
def _():
    return f"SELECT model, task, clean_score, switchmix_score, robustness_drop FROM ({_round_report(report_sql(nli_preds()))})"


@oracle("metric_tables_layouts")
def _():
    names = ("model", "task", "clean_score", "switchmix_score", "clean_accuracy", "switchmix_accuracy", "robustness_drop")
    columns = lambda have, size, pair, file: ", ".join(
        [c if c in have else f"NULL AS {c}" for c in names] + [f"{size} AS estimated_model_size", f"{pair} AS language_pair", f"{q(file)} AS source_file"])
    summary = columns(("model", "task", "clean_score", "switchmix_score", "robustness_drop"), "NULL", q("fr-es"), "robustness_summary_fr-es.csv")
    cross = columns(("model", "clean_accuracy", "switchmix_accuracy", "robustness_drop"), "NULL", "language_pair", "cross_language_robustness.csv")
    sizes = columns(("model",), "estimated_model_size", "NULL", "model_sizes.csv")
    return f"""SELECT {summary} FROM ({_round_report(report_sql(nli_preds("es")))})
               UNION ALL SELECT {cross} FROM ({ORACLE["cross_language"]})
               UNION ALL SELECT {sizes} FROM ({ORACLE["model_size_lookup"]})"""


@oracle("pair_table")
def _():
    return ORACLE["pair_rows"]


@oracle("json_array_documents")
def _():
    return "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
