"""DuckDB SQL fragments mirroring the Spark column functions, for oracles.

These build *oracle* SQL strings only; the engine itself never parses SQL.
"""

from __future__ import annotations

import re

from parallax import constants as K


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def vocal(e: str) -> str:
    return f"regexp_replace({e}, {lit(K.DIACRITICS_CLASS)}, '', 'g')"


def punct(e: str) -> str:
    return f"regexp_replace({e}, {lit(K.ARABIC_PUNCT_CLASS)}, ' ', 'g')"


def quotes(e: str) -> str:
    return f"trim(trim({e}, '\"'), '''')"


def strip(e: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in K.WS_LITERAL)
    return f"trim({e}, {chars})"


def ws(e: str) -> str:
    return f"regexp_replace({strip(e)}, {lit(K.WS_CLASS + '+')}, ' ', 'g')"


def norm(e: str) -> str:
    return f"translate({e}, {lit(K.NORMALIZE_FROM)}, {lit(K.NORMALIZE_TO)})"


def clean(e: str, normalize: bool = False) -> str:
    out = ws(quotes(punct(vocal(e))))
    return norm(out) if normalize else out


def tokens(e: str) -> str:
    return f"list_filter(string_split_regex({e}, {lit(K.WS_CLASS + '+')}), lambda t: t <> '')"


def en_ratio(e: str) -> str:
    t = tokens(e)
    n_en = f"len(list_filter({t}, lambda x: regexp_matches(x, {lit(K.ENGLISH_TOKEN)})))"
    return f"(CASE WHEN len({t}) > 0 THEN {n_en} / len({t}) END)"


def mostly_english(e: str, threshold: float = K.MOSTLY_ENGLISH_THRESHOLD) -> str:
    return f"coalesce({en_ratio(e)} >= {threshold}, false)"


def english_only(e: str) -> str:
    return f"coalesce(regexp_matches({e}, {lit(K.ENGLISH_ONLY)}), false)"


def template(tpl: str, **slots: str) -> str:
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", tpl):
        if m.start() > pos:
            parts.append(lit(tpl[pos:m.start()]))
        parts.append(slots[m.group(1)])
        pos = m.end()
    if pos < len(tpl):
        parts.append(lit(tpl[pos:]))
    return "(" + " || ".join(parts) + ")"


def translit(e: str) -> str:
    return f"translate(lower({e}), {lit(K.AR_FROM)}, {lit(K.AR_TO)})"


def rkey(id_expr: str, seed: int = K.SEED) -> str:
    return f"md5('{seed}:' || CAST({id_expr} AS VARCHAR))"


# Views over the driver tables, mirroring parallax.plans.inputs -------------

CONV_PAIRS = """conv_pairs AS (
  SELECT u.conv_id || ':' || u.turn AS pair_id, u.conv_id, u.turn, u.text AS src, a.text AS tgt
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

AR_DOCS = f"""ar_docs AS (SELECT doc_id, {translit('text')} AS text FROM documents)"""


def emb_pred(binary: bool = False, name: str = "emb_pred") -> str:
    from parallax.plans.inputs import head_weights
    weights, bias = head_weights(2 if binary else 10)
    logits = ", ".join(" + ".join(f"{w!r}::DOUBLE * e[{i + 1}]" for i, w in enumerate(row)) + f" + {b!r}::DOUBLE"
                       for row, b in zip(weights, bias))
    gold = "label % 2" if binary else "label"
    return f"""{name} AS (
  SELECT vec_id, gold, logits, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred
  FROM (SELECT vec_id, gold, [{logits}] AS logits
        FROM (SELECT vec_id, CAST({gold} AS INTEGER) AS gold,
                     list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)))"""


EMB_CAND = """emb_cand AS (
  SELECT vec_id AS group_id, CAST(i - 1 AS BIGINT) AS candidate_id,
         CAST(embedding[i] AS DOUBLE) AS logit
  FROM (SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS i FROM embeddings))"""

EVT_FEEDBACK = """feedback AS (
  SELECT event_id, user_id AS pair_key, 'u' || CAST(user_id AS VARCHAR) AS egyptian_arabic,
         concat_ws(' ', event_type, props) AS generated_msa,
         CASE WHEN event_id % 3 = 0 THEN 'incorrect' ELSE 'correct' END AS user_label,
         event_id % 6 AS user_rating,
         CASE WHEN event_id % 4 = 0 THEN 'fix ' || CAST(event_id AS VARCHAR) ELSE '' END AS corrected_msa,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp
  FROM events)"""

EVT_LOGS = """logs AS (
  SELECT user_id AS run,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
         value AS dev_loss
  FROM events)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
