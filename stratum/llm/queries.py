"""The subpackage's queries, by name, and their SQL."""
from __future__ import annotations

from . import ann, bpe, line_dedup, packing, quality, quality_mil, secrets, simhash, substring_dedup, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_mil": quality_mil.op2_quality_mil,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_secrets": secrets.op4_secrets,
    "op5_bpe": bpe.op5_bpe,
    "op6_packing": packing.op6_packing,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_ann": ann.op10_ann,
}
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op3_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
 g AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
 r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
 gone AS (SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest(range(20)) AS k)),
 each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
 SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_quality_rules": f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
 g AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
 r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
 c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
 l AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
 m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(l.n - l.u, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0) AS n_lines, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper, len([x for x in ws if NOT regexp_matches(x, '\\p{{L}}')]) AS n_bare
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_upper > word_chars OR 2 * n_bare > n_words) AS kept FROM m""",
}
