"""The term mapping as one SQL statement, by comparing every value with every spelling: the truth that the join is held to."""

from __future__ import annotations

from .terms import _ACCENTS, QUALIFIERS, SYNONYMS, TWO_SLIPS_FROM


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fold(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), {_quote(_ACCENTS[0])}, {_quote(_ACCENTS[1])}), '[\\s\\x{{a0}}\\x{{200b}}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")


def _bare(x: str) -> str:
    y = f"regexp_replace({x}, '^(?:#|secteur ?: ?|sector ?: ?|exp\\. |exp |expert )+', '')"
    y = f"regexp_replace({y}, '(?: ?\\((?:fr|en|de|es|confirme|expert|notions)\\)| sector| ?/ ?expert| ?- ?notions| ?\\*)+$', '')"
    return f"trim(regexp_replace({y}, '([a-z0-9+#)])[.;,:]+$', '\\1'))"


def _squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, ' and | et | und ', '', 'g'), '[^\\p{{L}}0-9+#]', '', 'g')".replace("{{", "{").replace("}}", "}")


def _unqualified(x: str) -> str:
    words = "|".join(QUALIFIERS)
    y = f"trim(regexp_replace(regexp_replace({x}, '[ -]?v?[0-9]+(?:\\.[0-9x]+)*(?:\\.x)?$', ''), '^(?:{words}) | \\(?(?:{words})\\)?$', '', 'g'))"
    return f"(CASE WHEN length({y}) > 0 THEN {y} ELSE {x} END)"


def mapping_sql() -> str:
    synonyms = ", ".join(f"({_quote(k)}, {_quote(label)}, {_quote(s)})" for k, by in SYNONYMS.items() for label, all_ in by.items() for s in all_)
    return f"""
WITH typed AS (
  SELECT DISTINCT id, kind, raw_value FROM (
    SELECT id, 'sector' AS kind, end_client_sector AS raw_value FROM jobs
    UNION ALL SELECT id, 'technology', unnest(technologies) FROM jobs
    UNION ALL SELECT id, 'industry', unnest(company_info.industry) FROM jobs)
  WHERE raw_value IS NOT NULL AND (kind, raw_value) NOT IN (SELECT (kind, label) FROM ref_terms)),
extra(kind, label, spelling) AS (VALUES {synonyms}),
listed AS (
  SELECT kind, term_id, 0 AS rank, label AS spelling FROM ref_terms
  UNION ALL SELECT kind, term_id, 1, unnest(known_aliases) FROM ref_terms
  UNION ALL SELECT kind, term_id, 2, spelling FROM extra JOIN ref_terms USING (kind, label)),
folded AS (SELECT kind, term_id, rank, {_fold('spelling')} AS f FROM listed),
every AS (SELECT * FROM folded UNION ALL SELECT kind, term_id, 3, {_unqualified('f')} FROM folded WHERE kind = 'technology'),
ref AS (SELECT kind, ref, min([rank, term_id]) AS best FROM (SELECT kind, term_id, rank, {_squeeze('f')} AS ref FROM every WHERE length(f) > 0) WHERE length(ref) > 0 GROUP BY 1, 2),
forms AS (SELECT DISTINCT kind, raw_value, {_fold('raw_value')} AS f FROM typed),
bared AS (SELECT kind, raw_value, f, {_bare('f')} AS b FROM forms),
keys AS (
  SELECT kind, raw_value, 0 AS step, {_squeeze('f')} AS key FROM bared
  UNION SELECT kind, raw_value, 1, {_squeeze('b')} FROM bared
  UNION SELECT kind, raw_value, 2, CASE WHEN kind = 'technology' THEN {_squeeze(_unqualified('b'))} ELSE {_squeeze('b')} END FROM bared),
exact_of AS (SELECT e.kind, e.raw_value, best[3] AS term_id FROM (SELECT keys.kind, keys.raw_value, min([step, ref.best[1], ref.best[2]]) AS best FROM keys JOIN ref ON keys.kind = ref.kind AND keys.key = ref.ref WHERE length(keys.key) > 0 GROUP BY 1, 2) e),
slips AS (
  SELECT k.kind, k.raw_value, min([levenshtein(k.key, r.ref), r.best[1], r.best[2]]) AS best
  FROM keys k JOIN ref r ON k.kind = r.kind AND length(k.key) >= 4 AND length(r.ref) >= 4 AND abs(length(k.key) - length(r.ref)) <= 2
  WHERE NOT EXISTS (SELECT 1 FROM exact_of x WHERE x.kind = k.kind AND x.raw_value = k.raw_value)
    AND (levenshtein(k.key, r.ref) <= 1 OR (levenshtein(k.key, r.ref) = 2 AND length(k.key) = length(r.ref) AND list_sort(string_split(k.key, '')) = list_sort(string_split(r.ref, '')))
      OR (levenshtein(k.key, r.ref) = 2 AND least(length(k.key), length(r.ref)) >= {TWO_SLIPS_FROM}))
  GROUP BY 1, 2),
mapped AS (SELECT kind, raw_value, term_id FROM exact_of UNION ALL SELECT kind, raw_value, best[3] FROM slips)
SELECT id, kind, raw_value, CAST(coalesce(term_id, 0) AS BIGINT) AS term_id FROM typed LEFT JOIN mapped USING (kind, raw_value)"""
