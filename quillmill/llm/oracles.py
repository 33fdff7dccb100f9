"""DuckDB SQL with the results of the operators' queries, where SQL can express them."""

from __future__ import annotations

from .quality import RiskConfig
from .secrets import RULES

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def line_dedup(least: int = 10) -> str:
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {least} GROUP BY key HAVING min(doc_id) <> max(doc_id)),
d AS (SELECT k.doc_id, k.line, k.i, h.first IS NOT NULL AND h.first <> k.doc_id AS lost FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256 FROM d GROUP BY doc_id"""


def secret_scan(rules=RULES) -> str:
    """Every match is taken with the text before it, so lengths add up to positions."""
    parts = []
    for k, r in enumerate(rules):
        flags = "(?is)" if "I" in str(r.flags) or r.flags & 2 else "(?s)"
        # The group that a least length is asked of is the last one of the rule.
        group = 2 + r.group
        parts.append(f"SELECT doc_id, {k} AS k, {_q(r.kind)} AS kind, {str(r.base).lower()} AS base, {r.least} AS least, unnest(regexp_extract_all(t, {_q(f'{flags}(.*?)({r.pattern})')}, 1)) AS pre, unnest(regexp_extract_all(t, {_q(f'{flags}(.*?)({r.pattern})')}, 2)) AS hit, unnest(regexp_extract_all(t, {_q(f'{flags}(.*?)({r.pattern})')}, {group})) AS part, generate_subscripts(regexp_extract_all(t, {_q(f'{flags}(.*?)({r.pattern})')}, 1), 1) AS i FROM t")
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT *, sum(length(pre) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM m),
f AS (SELECT doc_id, k, kind, base, CAST(stop - length(hit) AS BIGINT) AS start, kind || ':' || CAST(stop - length(hit) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM s WHERE length(part) >= least),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = {_q(r.kind)}) AS n_{r.kind}" for r in rules if r.base)}, string_agg(span, ',' ORDER BY start, k) FILTER (base) AS b, string_agg(span, ',' ORDER BY start, k) AS spans FROM f GROUP BY doc_id)
SELECT t.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, upper(sha256(t.t)) AS blob FROM t LEFT JOIN g USING (doc_id)"""


def quality_rules(c: RiskConfig = RiskConfig()) -> str:
    a = c.alpha / len(c.ladders)
    steps = " UNION ALL ".join(f"SELECT '{r}' AS rule, {j} AS step, CAST({x} AS DOUBLE) AS cutoff" for r, xs in c.ladders.items() for j, x in enumerate(xs))
    case = lambda col: "CASE rule " + " ".join(f"WHEN '{r}' THEN {col}_{r}" for r in c.ladders) + " END"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, 'und') AS stratum FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
gk AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM gk, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, len(l) AS n_lines FROM w LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS s_symbols, n_upper / greatest(word_chars, 1) AS s_upper, n_repeat_words / greatest(n_words, 1) AS s_repeats, n_dup_lines / greatest(n_lines, 1) AS s_dup_lines FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
steps AS ({steps}),
k AS (SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER ({case('s')} > cutoff) AS k FROM s JOIN good USING (doc_id), steps WHERE NOT base_failed GROUP BY ALL),
p AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a!r}::DOUBLE) + (n - i) * ln(1 - {a!r}::DOUBLE)))) AS p FROM k),
cut AS (SELECT stratum, rule, arg_max(cutoff, step) AS cutoff FROM p WHERE k < n * {a!r}::DOUBLE AND p <= {c.delta!r}::DOUBLE / ({len(c.ladders)} * (SELECT count(DISTINCT stratum) FROM k)) GROUP BY ALL),
bad AS (SELECT DISTINCT s.doc_id FROM s JOIN cut ON s.stratum = cut.stratum AND {case('s')} > cutoff)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept, stratum FROM s LEFT JOIN bad ON s.doc_id = bad.doc_id"""


def warc_revisits(least_bytes: int = 0) -> str:
    groups = " || ".join(f"lpad(to_base(CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT), 32), 4, '0')" for k in range(8))
    return f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, translate(lower({groups}), '0123456789abcdefghijklmnopqrstuv', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest, max(page_id) FILTER (n >= {least_bytes}) OVER (PARTITION BY h) AS o FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN o <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN o <> page_id THEN o END AS refers_to FROM d"""


ORACLES = {"op4_secret_scan": secret_scan(), "op7_line_dedup": line_dedup(), "op9_quality_rules": quality_rules(), "op10_warc_revisits": warc_revisits()}
