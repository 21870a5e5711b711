"""DuckDB text of operators whose oracle needs more than a line."""

from __future__ import annotations

from critica.functions.language import FUNCTION_WORDS, LANGS


def detect_language_sql(text_sql: str, langs=None) -> str:
    """DuckDB twin of ``detect_language`` (for the oracle)."""
    langs = list(langs or LANGS)
    toks = f"regexp_extract_all(lower({text_sql}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    hits = {}
    for lang in langs:
        words = ", ".join("'" + w + "'" for w in FUNCTION_WORDS[lang])
        hits[lang] = f"len(list_filter({toks}, lambda t: list_contains([{words}], t)))"
    parts = []
    for i, lang in enumerate(langs[:-1]):
        cond = " AND ".join(f"{hits[lang]} >= {hits[o]}" for o in langs[i + 1:])
        parts.append(f"WHEN {cond} THEN '{lang}'")
    return "CASE " + " ".join(parts) + f" ELSE '{langs[-1]}' END"


def chunk_by_budget_sql(table: str, keys, budget: int, id_col: str = "review_id",
                        tokens_col: str = "n_tokens") -> str:
    """Recursive-CTE twin of ``chunk_by_budget`` (for the oracle)."""
    k = ", ".join(keys)
    on = " AND ".join(f"o.{c} = r.{c}" for c in keys)
    return f"""ordered AS (
  SELECT {k}, {id_col}, {tokens_col} AS t, row_number() OVER (PARTITION BY {k} ORDER BY {id_col}) AS pos FROM {table}),
chunks AS (
  SELECT {k}, {id_col}, pos, t AS used, 0 AS chunk FROM ordered WHERE pos = 1
  UNION ALL
  SELECT o.{keys[0]}{''.join(', o.' + c for c in keys[1:])}, o.{id_col}, o.pos,
         CASE WHEN r.used > 0 AND r.used + o.t > {budget} THEN o.t ELSE r.used + o.t END,
         CASE WHEN r.used > 0 AND r.used + o.t > {budget} THEN r.chunk + 1 ELSE r.chunk END
  FROM chunks r JOIN ordered o ON {on} AND o.pos = r.pos + 1)"""
