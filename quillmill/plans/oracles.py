"""DuckDB SQL with the results of the registered queries, written apart from them.

DuckDB's patterns have no lookaround and ASCII classes, so boundaries are spelled
out with character classes.
"""

from __future__ import annotations

from ..functions import constants as K

_L = r"[\p{L}\p{N}_]"
_N = r"[^\p{L}\p{N}_]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_q, items)) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _last(x: str) -> str:
    return f"right({_strip(x)}, 1)"


_REGISTERS = [r[0] for r in K.REGISTERS]
_WORDS = f"regexp_extract_all(text, {_q(K.WORD)})"
_SENTENCE = rf"([{K.SENTENCE_END}])\s+([{K.SENTENCE_START}])"
_MASK = rf"(?i)(^|{_N})({'|'.join(K.ABBREVIATIONS)})\."
_PASSIVE = rf"(?i)(?:(?:^|{_N})(?:{'|'.join(K.BE_FORMS)})|{_L}(?:{'|'.join(K.BE_CONTRACTIONS)}))(?:\s+{_L}{{2,}}){{0,3}}\s+(?:{_L}{{3,}}ed|{'|'.join(K.IRREGULAR_PARTICIPLES)})(?:$|{_N})"
_TOKEN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]"

DOCS = f"docs AS (SELECT doc_id, text, source AS author, list_extract({_list(_REGISTERS)}, CAST(substr(source, 4, 10) AS INT) % 5 + 1) AS register FROM documents)"

STATS = f"""{DOCS},
p AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS paras, {_WORDS} AS words, regexp_extract_all(text, {_q(_L + '+')}) AS runs FROM docs),
s AS (SELECT *, list_transform(paras, lambda x: list_transform(string_split(regexp_replace(regexp_replace(x, {_q(_MASK)}, '\\1\\2' || chr(1), 'g'), {_q(_SENTENCE)}, '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda y: replace(y, chr(1), '.'))) AS by_para FROM p WHERE len(paras) > 0),
f AS (SELECT *, flatten(by_para) AS sents FROM s),
stats AS (SELECT doc_id, author, register, CAST(length(text) AS BIGINT) AS n_chars, CAST(greatest(len(words), 1) AS BIGINT) AS n_words,
  CAST(len(list_distinct(list_transform(words, lambda x: lower(x)))) AS BIGINT) AS n_unique_words, CAST(greatest(len(sents), 1) AS BIGINT) AS n_sentences, CAST(len(paras) AS BIGINT) AS n_paragraphs,
  CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS total_word_chars,
  CAST(len(list_filter(runs, lambda x: regexp_matches(x, {_q('(?i)^' + _L + '+ly$')}))) AS BIGINT) AS ly_words,
  CAST(length(text) - length(replace(text, ',', '')) AS BIGINT) AS commas, CAST(length(text) - length(replace(text, ';', '')) AS BIGINT) AS semis,
  CAST(len(list_filter(paras, lambda x: regexp_matches(x, '["“][^"”]+["”]'))) AS BIGINT) AS dialogue_paras,
  CAST(len(list_filter(sents, lambda x: regexp_matches(x, {_q(_PASSIVE)}))) AS BIGINT) AS passive_sentences,
  CAST(len(list_filter(runs, lambda x: regexp_matches(x, {_q('(?i)^' + _L + '{2,}(' + '|'.join(K.NOMINAL_SUFFIXES) + ')$')}))) AS BIGINT) AS nominalization_hits,
  CAST(len(list_filter(words, lambda x: list_contains({_list(K.FUNCTION_WORDS)}, lower(x)))) AS BIGINT) AS function_word_hits,
  CAST(len(list_filter(sents, lambda x: {_last('x')} = '.')) AS BIGINT) AS end_period, CAST(len(list_filter(sents, lambda x: {_last('x')} = '!')) AS BIGINT) AS end_excl, CAST(len(list_filter(sents, lambda x: {_last('x')} = '?')) AS BIGINT) AS end_quest,
  list_transform(by_para, lambda x: len(x)) AS para_sentence_counts FROM f)"""

_COUNTERS = "n_chars n_words n_unique_words n_sentences n_paragraphs total_word_chars ly_words commas semis dialogue_paras passive_sentences nominalization_hits function_word_hits end_period end_excl end_quest".split()

PROFILE = f"""{STATS},
sums AS (SELECT author, any_value(register) AS register, count(*) AS chapters, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _COUNTERS)}, avg(n_unique_words / n_words) AS ttr, list_sort(flatten(list(para_sentence_counts))) AS lens FROM stats GROUP BY author),
profile AS (SELECT author, register, chapters, n_words AS total_words, n_sentences AS total_sentences, n_paragraphs AS total_paragraphs,
  total_word_chars / greatest(n_words, 1) AS mean_word_length_chars, greatest(n_words, 1) / greatest(n_sentences, 1) AS mean_sentence_length_words, greatest(n_sentences, 1) / greatest(n_paragraphs, 1) AS mean_paragraph_length_sentences,
  CAST(lens[len(lens) // 2 + 1] AS BIGINT) AS median_paragraph_length_sentences, round(ttr, 6) AS type_token_ratio_chapter_avg, ly_words / greatest(n_words, 1) * 100 AS adverb_ly_density_pct,
  commas / greatest(n_sentences, 1) AS commas_per_sentence, semis / greatest(n_words, 1) * 1000 AS semicolons_per_1k_words, dialogue_paras / greatest(n_paragraphs, 1) * 100 AS dialogue_paragraph_pct,
  passive_sentences / greatest(n_sentences, 1) * 100 AS passive_ratio_pct_of_sentences, nominalization_hits / greatest(n_words, 1) * 1000 AS nominalization_per_1k_words, (1 - function_word_hits / greatest(n_words, 1)) * 100 AS lexical_density_pct,
  {', '.join(f'end_{e} / greatest(end_period + end_excl + end_quest, 1) * 100 AS end_{e}_pct' for e in ('period', 'excl', 'quest'))} FROM sums)"""

QUARTILES = f"""{PROFILE},
long AS ({' UNION ALL '.join(f"SELECT register, '{a}' AS axis, CAST({a} AS DOUBLE) AS v FROM profile" for a in K.AXES)}),
g AS (SELECT register, axis, count(*) AS n, list_sort(list(v)) AS s FROM long GROUP BY ALL),
q AS (SELECT register, axis, n, s[n // 4 + 1] AS q1, s[n // 2 + 1] AS median, s[3 * n // 4 + 1] AS q3 FROM g)"""

COUNTS = f"""{DOCS},
t AS (SELECT doc_id, register, unnest(list_transform({_WORDS}, lambda x: lower(x))) AS word FROM docs),
counts AS (SELECT doc_id, register, word, count(*) AS n FROM t GROUP BY ALL),
mfw AS (SELECT word, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY word ORDER BY total DESC, word LIMIT 150)"""

SCALE = f"""{COUNTS},
ch AS (SELECT doc_id, register, sum(n) AS all_words FROM counts GROUP BY ALL),
dense AS (SELECT ch.doc_id, ch.register, mfw.word, coalesce(c.n, 0) / ch.all_words AS freq FROM ch CROSS JOIN mfw LEFT JOIN counts c ON c.doc_id = ch.doc_id AND c.word = mfw.word),
scale AS (SELECT word, avg(freq) AS mu, greatest(stddev_pop(freq), 1e-9) AS sigma FROM dense GROUP BY word),
z AS (SELECT doc_id, register, word, (freq - mu) / sigma AS z FROM dense JOIN scale USING (word)),
cent AS (SELECT register, word, avg(z) AS z, count(*) AS n FROM z GROUP BY ALL)"""

_PARAS = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"


def _chunks(separator: int) -> str:
    """Chunks of at most 200 tokens; separator is what a blank line between paragraphs counts as.

    Paragraphs of more tokens are packed by sentences (runs), longer sentences are
    sliced; both stand alone. Two folds, over sentences and over paragraphs.
    """
    return f"""RECURSIVE {DOCS},
pp AS (SELECT doc_id, unnest({_PARAS}) AS p, generate_subscripts({_PARAS}, 1) AS i FROM docs),
pc AS (SELECT doc_id, p, i, len(regexp_extract_all(p, {_q(_TOKEN)})) AS n FROM pp),
ls AS (SELECT doc_id, i, string_split(regexp_replace(p, {_q(_SENTENCE)}, '\\1' || chr(2) || '\\2', 'g'), chr(2)) AS s FROM pc WHERE n > 200),
lt AS (SELECT doc_id, i, unnest(s) AS p, generate_subscripts(s, 1) AS j FROM ls),
lw AS (SELECT *, regexp_extract_all(p, {_q(_TOKEN)}) AS t FROM lt),
lk AS (SELECT *, unnest(range(0, len(t), 200)) AS k FROM lw WHERE len(t) > 200),
lp AS (SELECT doc_id, i, j, 0 AS k, p, len(t) AS n, false AS alone FROM lw WHERE len(t) BETWEEN 1 AND 200 UNION ALL
  SELECT doc_id, i, j, k, array_to_string(t[k + 1 : k + 200], ' ') AS p, least(200, len(t) - k) AS n, true AS alone FROM lk),
ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY j, k) AS r FROM lp),
runs AS (SELECT doc_id, i, r, p, n, alone, n AS used, 0 AS run FROM ln WHERE r = 1 UNION ALL
  SELECT x.doc_id, x.i, x.r, x.p, x.n, x.alone, CASE WHEN NOT f.alone AND NOT x.alone AND f.used + x.n <= 200 THEN f.used + x.n ELSE x.n END, CASE WHEN NOT f.alone AND NOT x.alone AND f.used + x.n <= 200 THEN f.run ELSE f.run + 1 END
  FROM runs f JOIN ln x ON x.doc_id = f.doc_id AND x.i = f.i AND x.r = f.r + 1),
pieces AS (SELECT doc_id, i, run, string_agg(p, ' ' ORDER BY r) AS p, CAST(sum(n) AS BIGINT) AS n, true AS alone FROM runs GROUP BY doc_id, i, run UNION ALL SELECT doc_id, i, 0 AS run, p, n, false AS alone FROM pc WHERE n BETWEEN 1 AND 200),
pn AS (SELECT doc_id, p, n, alone, row_number() OVER (PARTITION BY doc_id ORDER BY i, run) AS i FROM pieces),
fold AS (SELECT doc_id, i, n, p, alone, n AS used, 0 AS chunk_idx FROM pn WHERE i = 1 UNION ALL
  SELECT x.doc_id, x.i, x.n, x.p, x.alone, CASE WHEN NOT f.alone AND NOT x.alone AND f.used + {separator} + x.n <= 200 THEN f.used + {separator} + x.n ELSE x.n END, CASE WHEN NOT f.alone AND NOT x.alone AND f.used + {separator} + x.n <= 200 THEN f.chunk_idx ELSE f.chunk_idx + 1 END
  FROM fold f JOIN pn x ON x.doc_id = f.doc_id AND x.i = f.i + 1),
chunks AS (SELECT doc_id AS path, chunk_idx, count(*) AS n_paragraphs, CAST(sum(n) + {separator} * (count(*) - 1) AS BIGINT) AS n_tokens, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text, chunk_idx = max(chunk_idx) OVER (PARTITION BY doc_id) AS is_chapter_end FROM fold GROUP BY doc_id, chunk_idx)"""


CHUNKS = f"""{_chunks(1)},
named AS (SELECT c.*, d.author, d.register FROM chunks c JOIN docs d ON d.doc_id = c.path),
b0 AS (SELECT path, chunk_idx, author, register, string_split(regexp_replace(regexp_replace({_strip('text')}, '\\n+', ' ', 'g'), {_q(_SENTENCE)}, '\\1' || chr(2) || '\\2', 'g'), chr(2))[1] AS b FROM named),
briefs AS (SELECT path, chunk_idx, author, register, trim({_strip("regexp_replace(" + _strip('b') + ", " + _q('(?i)' + K.BRIEF_LABEL) + ", '')")}, '"'' ') AS brief FROM b0 WHERE length(trim({_strip("regexp_replace(" + _strip('b') + ", " + _q('(?i)' + K.BRIEF_LABEL) + ", '')")}, '"'' ')) >= 20)"""

SPLIT = f"""{CHUNKS},
j AS (SELECT n.path, n.chunk_idx, n.n_tokens, n.text, b.author, b.register, b.brief FROM named n JOIN briefs b ON n.path = b.path AND n.chunk_idx = b.chunk_idx),
cap AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY md5(concat_ws('|', '42', path, chunk_idx)), path, chunk_idx) AS r FROM j QUALIFY r <= 200),
sp AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY md5(concat_ws('|', '43', path, chunk_idx)), path, chunk_idx) AS pos, count(*) OVER (PARTITION BY author) AS n FROM cap),
ns AS (SELECT *, CASE WHEN n < 10 THEN 0 ELSE greatest(round_even(n * 0.1, 0), 1) END AS held FROM sp),
split AS (SELECT path, chunk_idx, n_tokens, text, author, register, brief, CASE WHEN pos <= held THEN 2 WHEN pos <= 2 * held THEN 1 ELSE 0 END AS split FROM ns)"""

POOL = f"""{SPLIT},
pool AS (SELECT b.path, b.chunk_idx, b.register, b.brief, CASE WHEN len(list_filter(regexp_split_to_array(b.brief, '\\s+'), lambda x: x <> '')) NOT BETWEEN 10 AND 80 THEN 'length' WHEN regexp_matches(b.brief, {_q('(?i)' + K.LEAKED_BRIEF)}) THEN 'leakage' ELSE 'kept' END AS reason
  FROM briefs b JOIN split s ON b.path = s.path AND b.chunk_idx = s.chunk_idx WHERE s.split = 2)"""

_BIGRAMS = f"""bw AS (SELECT author, list_transform({_WORDS}, lambda x: lower(x)) AS w FROM docs),
bg AS (SELECT author, unnest(list_transform(range(1, len(w)), lambda i: struct_pack(a := w[i], b := w[i + 1]))) AS g FROM bw),
bc AS (SELECT author, g.a AS w1, g.b AS w2, count(*) AS n FROM bg GROUP BY ALL),
bm AS (SELECT author, sum(n) AS mine FROM bc GROUP BY author),
bs AS (SELECT c.author, c.w1, c.w2, c.n, c.n / greatest(m.mine, 1) AS my_rate, (sum(c.n) OVER (PARTITION BY c.w1, c.w2) - c.n) / greatest((SELECT sum(n) FROM bc) - m.mine, 1) AS other_rate FROM bc c JOIN bm m ON c.author = m.author),
br AS (SELECT *, my_rate / other_rate AS ratio FROM bs WHERE n >= 30 AND other_rate >= 1e-7),
k AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ratio DESC, w1 DESC, w2 DESC) AS place FROM br WHERE ratio >= 2)"""

_DISPLAY = "CASE register " + " ".join(f"WHEN {_q(n)} THEN {_q(d)}" for n, d, _, _ in K.REGISTERS) + " END"


def _ids(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {_q(_TOKEN)}), lambda x: CAST('0x' || substr(md5(x), 1, 7) AS INT))"


def _windows(size: int) -> str:
    return f"""{DOCS},
ww AS (SELECT doc_id, register, regexp_extract_all(regexp_replace(text, '\\n+', ' ', 'g'), {_q(K.WORD)}) AS w FROM docs),
win0 AS (SELECT doc_id, register, w, unnest(range(0, len(w), {size})) AS s FROM ww),
win AS (SELECT doc_id, register, s // {size} AS win_idx, array_to_string(w[s + 1 : s + {size}], ' ') AS win FROM win0 WHERE len(w) - s >= {size // 2})"""


_GRAMS = f"""{_windows(500)},
gw AS (SELECT doc_id || '/' || win_idx AS key, list_transform(regexp_extract_all(win, {_q("[a-zA-Z][a-zA-Z'-]*[a-zA-Z]|[a-zA-Z][a-zA-Z]")}), lambda x: lower(x)) AS w FROM win),
tt AS (SELECT key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM gw),
tf AS (SELECT key, term, count(*) AS tf FROM tt GROUP BY ALL),
voc AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term HAVING count(*) >= 5 ORDER BY total DESC, term LIMIT 20000),
vi AS (SELECT *, ln((1 + (SELECT count(*) FROM win)) / (1 + df)) + 1 AS idf FROM voc)"""

_AUTHORS = [a for r in K.REGISTERS for a in r[2]]
_CATALOG_FIELDS = ("Austen, Jane, 1775-1817", "BRONTE, EMILY", "Brontë, Charlotte, 1816-1855; Gaskell, Elizabeth Cleghorn", "Le Fanu, Joseph Sheridan, 1814-1873", "James, M. R. (Montague Rhodes)", "Twain, Mark", "Nobody, At All", "Crane, Stephen; London, Jack")
_CATALOG = f"""au AS (SELECT unnest({_list(_AUTHORS)}) AS author),
parts AS (SELECT author, string_split(author, ' ') AS p FROM au),
needles AS (SELECT DISTINCT author, lower(strip_accents(unnest(list_transform(range(1, len(p)), lambda i: array_to_string(p[i + 1 :], ' ') || ', ' || array_to_string(p[: i], ' '))))) AS needle FROM parts),
cat AS (SELECT CAST(doc_id AS VARCHAR) AS pg_id, doc_id AS position, string_split(text, chr(10))[1] || chr(10) || 'A subtitle, "quoted"' AS title, list_extract({_list(_CATALOG_FIELDS)}, CAST(substr(source, 4, 10) AS INT) % 8 + 1) AS authors FROM documents WHERE source <> 'src3' AND lang = 'en'),
works AS (SELECT DISTINCT n.author, c.* FROM cat c JOIN needles n ON contains(lower(strip_accents(c.authors)), n.needle))"""


def _slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


_TITLE = _strip("string_split(title, chr(10))[1]")
_SLUGGED = f"""s0 AS (SELECT *, {_slug('author')} AS author_slug, left({_slug(_TITLE)}, 60) AS w, row_number() OVER (PARTITION BY author ORDER BY position) AS place FROM works),
s AS (SELECT *, CASE WHEN w = '' THEN 'pg-' || pg_id ELSE w END AS work_slug FROM s0)"""

PACKED = f"""{SPLIT},
i0 AS (SELECT path, chunk_idx, split, {_ids(f"'{K.PROMPT[0]}' || {_DISPLAY} || '{K.PROMPT[1]}' || brief || '{K.PROMPT[2]}'")} AS p, {_ids('text')} AS c FROM split),
i1 AS (SELECT *, CASE WHEN list_concat(p, c)[-1] = 2 THEN list_concat(p, c) ELSE list_append(list_concat(p, c), 2) END AS ids FROM i0),
i2 AS (SELECT path, chunk_idx, split, len(ids) > 256 AS was_cut, CASE WHEN len(ids) > 256 THEN list_append(ids[:255], 2) ELSE ids END AS ids, least(len(p), 256) AS pl FROM i1),
i3 AS (SELECT *, list_transform(range(1, 257), lambda i: coalesce(ids[i], 2)) AS full_ids FROM i2)"""
_PACKED_COLUMNS = """path, chunk_idx, split, CAST(pl AS INT) AS prompt_length, CAST(len(ids) AS INT) AS n_tokens, was_cut, md5(array_to_string(full_ids, ',')) AS ids_md5,
  md5(array_to_string(list_transform(range(1, 257), lambda i: CASE WHEN i <= pl OR i > len(ids) THEN -100 ELSE full_ids[i] END), ',')) AS labels_md5"""

_CHAPTERS = rf"""w0 AS (SELECT doc_id // 10 AS work, 'Front matter' || chr(10) || '*** START OF THE PROJECT GUTENBERG EBOOK WORK ***' || chr(10) || string_agg('CHAPTER ' || (doc_id % 10 + 1) || chr(10) || text || chr(10), '' ORDER BY doc_id) || '*** END OF THE PROJECT GUTENBERG EBOOK WORK ***' || chr(10) || 'licence' AS text FROM documents GROUP BY 1),
w1 AS (SELECT work, {_strip(rf"regexp_replace(regexp_replace(text, {_q('(?is)^.*?' + K.START_MARKER)}, ''), {_q('(?is)' + K.END_MARKER + '.*$')}, '')")} AS text FROM w0),
w2 AS (SELECT work, text, string_split(regexp_replace(text, {_q('(?m)' + K.CHAPTER_HEADING)}, chr(1), 'g'), chr(1)) AS parts FROM w1),
w3 AS (SELECT work, CASE WHEN len(parts) < 3 THEN list_filter([text], lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) > 500) ELSE list_filter(list_transform(parts[2:], lambda x: {_strip('x')}), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) > 100) END AS bodies FROM w2),
ch AS (SELECT work, unnest(bodies) AS body, CAST(generate_subscripts(bodies, 1) AS INT) AS chapter_num FROM w3)"""

_PREDICTIONS = "pr AS (SELECT CAST(quality AS VARCHAR) AS label, CASE WHEN length(text) >= 400 THEN '1' ELSE '0' END AS predicted FROM labels JOIN documents USING (doc_id)), l AS (SELECT DISTINCT label AS x FROM pr UNION SELECT DISTINCT predicted FROM pr), cells AS (SELECT a.x AS label, b.x AS predicted, (SELECT count(*) FROM pr WHERE pr.label = a.x AND pr.predicted = b.x) AS n FROM l a, l b)"

ORACLES: dict[str, str] = {
    "chapter_paragraphs": f"WITH {STATS} SELECT doc_id, n_paragraphs, n_sentences FROM stats",
    "document_chunks": f"""WITH {_chunks(0)}, c AS (SELECT path AS doc_id, chunk_idx, is_chapter_end, {_ids('text')} AS ids FROM chunks), e AS (SELECT *, CASE WHEN is_chapter_end THEN list_append(ids[:199], 2) ELSE ids END AS out FROM c)
SELECT doc_id, chunk_idx, CAST(len(out) AS INT) AS n_tokens, is_chapter_end, md5(array_to_string(out, ',')) AS ids_md5 FROM e""",
    "stored_manifest": rf"""WITH {_CHAPTERS} SELECT format('source/author-{{}}/work-{{}}/chapter-{{:03d}}.txt', CAST(work % 7 AS BIGINT), CAST(work AS BIGINT), chapter_num) AS path, list_extract({_list(_REGISTERS)}, CAST(work % 5 + 1 AS INT)) AS cluster, CAST(CAST(work AS BIGINT) AS VARCHAR) AS pg_id, chapter_num,
  CAST(len(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(length(body) AS BIGINT) AS chars, md5(body) AS body_md5 FROM ch""",
    "whole_text_scan": rf"WITH {_CHAPTERS} SELECT CAST(work AS BIGINT) AS work, CAST(length(text) AS INT) AS chars, md5(text) AS text_md5 FROM w1",
    "resumed_briefs": f"WITH {CHUNKS} SELECT CAST(path AS VARCHAR) AS path, chunk_idx, author, register AS cluster, CASE WHEN path % 10 = 0 THEN 'later: ' || brief ELSE brief END AS brief FROM briefs",
    "profile_documents": f"""WITH {PROFILE}, {_BIGRAMS}, nb AS (SELECT author, count(*) FILTER (place <= 30) AS n, max(w1 || ' ' || w2) FILTER (place = 1) AS b FROM k GROUP BY author)
SELECT author, total_words, median_paragraph_length_sentences, round_even(mean_word_length_chars, 2) AS mean_word_length_chars, round_even(mean_sentence_length_words, 2) AS mean_sentence_length_words, round_even(adverb_ly_density_pct, 3) AS adverb_ly_density_pct, round_even(commas_per_sentence, 3) AS commas_per_sentence, round_even(nominalization_per_1k_words, 3) AS nominalization_per_1k_words,
  CAST(coalesce(nb.n, 0) AS INT) AS n_bigrams, nb.b AS first_bigram, CAST((SELECT count(*) FROM profile) AS INT) AS n_authors FROM profile LEFT JOIN nb USING (author)""",
    "register_members": f"WITH {DOCS} SELECT author, count(*) AS chapters FROM docs WHERE register = {_q(_REGISTERS[2])} GROUP BY author",
    "cluster_titles": f"WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS path, source AS author, {_strip('string_split(text, chr(10))[1]')} AS title FROM documents WHERE lang = 'en') SELECT path, author FROM t WHERE NOT regexp_matches(title, {_q('(?i)' + K.NOT_PROSE_TITLE)}) QUALIFY row_number() OVER (PARTITION BY author ORDER BY md5('42|' || path), path) <= 20",
    "optimizer_groups": """WITH p AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'lora_A' WHEN 1 THEN 'lora_B' ELSE 'other' END AS "group" FROM part WHERE p_size > 10) SELECT "group", CASE WHEN "group" = 'lora_B' THEN 8e-4::DOUBLE ELSE 1e-4::DOUBLE END AS learning_rate, count(*) AS n FROM p GROUP BY ALL""",
    "generated_texts": f"""WITH u AS (SELECT conv_id, turn, '{K.PROMPT[0]}Plain realism{K.PROMPT[1]}' || text || '{K.PROMPT[2]}' AS p FROM conversations WHERE role = 'user'),
w AS (SELECT *, list_reverse(list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> ''))[:40] AS w FROM u), g AS (SELECT *, p || ' 7 ' || array_to_string(w, ' ') AS g FROM w)
SELECT conv_id, turn, md5({_strip("substr(g, strpos(g, '[/INST]') + 7)")}) AS generated_md5 FROM g""",
    "chapter_stats": f"WITH {STATS} SELECT doc_id, {', '.join(_COUNTERS)}, array_to_string(para_sentence_counts, ',') AS para_sentence_counts FROM stats",
    "author_profile": f"WITH {PROFILE} SELECT * EXCLUDE (register) FROM profile",
    "word_stats_by_author": f"WITH {DOCS}, w AS (SELECT author, {_WORDS} AS w FROM docs) SELECT author, count(*) AS chapters, CAST(sum(len(w)) AS BIGINT) AS words, sum(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)) / greatest(sum(len(w)), 1) AS mean_word_length FROM w GROUP BY author",
    "distinguishing_bigrams": f"WITH {DOCS}, {_BIGRAMS} SELECT author, CAST(place AS INT) AS place, w1 || ' ' || w2 AS bigram, round(my_rate, 9) AS my_rate, round(other_rate, 9) AS other_rate, round(ratio, 9) AS ratio FROM k WHERE place <= 30",
    "register_axis_quartiles": f"WITH {QUARTILES} SELECT * FROM q",
    "register_separation": f"""WITH {QUARTILES},
e AS (SELECT q.*, median = min(median) OVER (PARTITION BY axis) OR median = max(median) OVER (PARTITION BY axis) AS is_extreme,
  NOT EXISTS (SELECT 1 FROM q o WHERE o.axis = q.axis AND o.register <> q.register AND NOT (q.q3 < o.q1 OR o.q3 < q.q1)) AS is_strong FROM q)
SELECT register, CAST(count(*) FILTER (is_strong) AS INT) AS n_strong, CAST(count(*) FILTER (is_extreme) AS INT) AS n_extreme, coalesce(string_agg(axis, ',' ORDER BY axis) FILTER (is_strong), '') AS strong, coalesce(string_agg(axis, ',' ORDER BY axis) FILTER (is_extreme), '') AS extreme,
  count(*) FILTER (is_strong) >= 1 OR count(*) FILTER (is_extreme) >= 2 AS valid FROM e GROUP BY register""",
    "frequent_words": f"WITH {COUNTS} SELECT word, total, CAST(row_number() OVER (ORDER BY total DESC, word) AS INT) AS place FROM mfw",
    "word_scale": f"WITH {SCALE} SELECT word, round(mu, 9) AS mu, round(sigma, 9) AS sigma FROM scale",
    "register_centroids": f"WITH {SCALE} SELECT register, n, word, round(z, 6) AS z FROM cent",
    "pairwise_delta": f"WITH {SCALE} SELECT a.register AS register_a, b.register AS register_b, round(avg(abs(a.z - b.z)), 6) AS delta FROM cent a JOIN cent b ON a.word = b.word AND a.register <> b.register GROUP BY ALL",
    "register_cohesion": f"WITH {SCALE}, d AS (SELECT doc_id, z.register, avg(abs(z.z - cent.z)) AS delta FROM z JOIN cent ON z.register = cent.register AND z.word = cent.word GROUP BY ALL) SELECT register, count(*) AS n, round(avg(delta), 6) AS delta FROM d GROUP BY register",
    "nearest_register": f"WITH {SCALE}, d AS (SELECT doc_id, cent.register AS r, avg(abs(z.z - cent.z)) AS delta FROM z JOIN cent ON z.word = cent.word GROUP BY ALL) SELECT doc_id, arg_min(r, delta) AS nearest, round(min(delta), 6) AS delta FROM d GROUP BY doc_id",
    "greedy_chunks": f"WITH {CHUNKS} SELECT path, chunk_idx, n_paragraphs, n_tokens, is_chapter_end, md5(text) AS text_md5 FROM chunks",
    "chunks_join_briefs": f"WITH {CHUNKS} SELECT n.path, n.chunk_idx, n.n_tokens, b.author, b.register, b.brief FROM named n JOIN briefs b ON n.path = b.path AND n.chunk_idx = b.chunk_idx",
    "chunks_to_do": f"WITH {CHUNKS} SELECT author, count(*) AS n, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM named n WHERE NOT EXISTS (SELECT 1 FROM briefs b WHERE n.path = b.path AND n.chunk_idx = b.chunk_idx) GROUP BY author",
    "stratified_split": f"WITH {SPLIT} SELECT path, chunk_idx, author, split FROM split",
    "split_tally": f"WITH {SPLIT} SELECT CASE WHEN grouping(author) = 1 THEN 'TOTAL' ELSE author END AS author, count(*) FILTER (split = 0) AS train, count(*) FILTER (split = 1) AS val, count(*) FILTER (split = 2) AS test, count(*) AS total, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM split GROUP BY ROLLUP (author)",
    "author_vocabulary": f"WITH {SPLIT} SELECT author, CAST(row_number() OVER (ORDER BY count(*) DESC, min(path), author) - 1 AS INT) AS author_id FROM split GROUP BY author",
    "packed_rows": f"WITH {PACKED} SELECT {_PACKED_COLUMNS} FROM i3",
    "stored_training_set": f"WITH {PACKED} SELECT {_PACKED_COLUMNS}, 256 AS seq_len FROM i3 WHERE split = 2",
    "split_replay_check": f"""WITH {SPLIT}, c AS (SELECT register, count(*) FILTER (split = 0) AS train, count(*) FILTER (split = 1) AS val, count(*) FILTER (split = 2) AS test FROM split GROUP BY register)
SELECT 'replayed' AS stored, register, train, val, test, true AS same FROM c UNION ALL SELECT 'drifted', register, train, val, test, NOT (register = {_q(_REGISTERS[0])} AND val > 0) FROM c""",
    "eval_brief_attrition": f"WITH {POOL} SELECT register, count(*) AS raw, count(*) FILTER (reason = 'length') AS dropped_length, count(*) FILTER (reason = 'leakage') AS dropped_leakage, count(*) FILTER (reason = 'kept') AS kept FROM pool GROUP BY register",
    "eval_sample": f"WITH {POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY register ORDER BY md5(concat_ws('|', '42', path, chunk_idx)), path, chunk_idx) AS place FROM pool WHERE reason = 'kept') SELECT format('{{}}-{{:03d}}', register, chunk_idx) AS brief_id, concat_ws('/', register, path, chunk_idx) AS brief_key, register, CAST(place AS INT) AS place, brief FROM r WHERE place <= 2",
    "instruction_probe": f"WITH {POOL}, r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '43', path, chunk_idx)), path, chunk_idx) AS place FROM pool WHERE reason = 'kept'), c AS (SELECT unnest({_list(i for i, _ in K.CONSTRAINTS)}) AS constraint_id, unnest({_list(t for _, t in K.CONSTRAINTS)}) AS constraint_text, unnest(range(1, 9)) AS place) SELECT format('instr-{{:02d}}-{{}}', r.place - 1, constraint_id) AS brief_id, constraint_id, path, chunk_idx, brief || ' ' || constraint_text AS brief FROM r JOIN c ON r.place = c.place",
    "constraint_checks": f"""WITH t AS (SELECT text FROM documents), o AS (SELECT 'ends_question' AS constraint_id, right({_strip('text')}, 1) = '?' AS ok FROM t UNION ALL SELECT 'no_dialogue', NOT regexp_matches(text, '["“][^"”]+["”]') FROM t
UNION ALL SELECT 'under_200_words', len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) < 200 FROM t UNION ALL SELECT 'named_eleanor', regexp_matches(text, '(^|{_N})Eleanor($|{_N})') FROM t UNION ALL SELECT 'first_person', regexp_matches(text, '(^|{_N})(I|me|my|we)($|{_N})') FROM t
UNION ALL SELECT 'set_at_dawn', regexp_matches(text, '(?i)(^|{_N})(dawn|daybreak|sunrise)($|{_N})') FROM t UNION ALL SELECT 'weather', NULL FROM t UNION ALL SELECT 'object_held', NULL FROM t) SELECT constraint_id, count(ok) AS checked, count(*) FILTER (ok) AS kept FROM o GROUP BY constraint_id""",
    "word_window_split": f"WITH {_windows(100)}, g AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= ceil((SELECT count(DISTINCT doc_id) FROM win) * 0.2) AS is_test FROM (SELECT DISTINCT doc_id FROM win)) SELECT register, is_test, count(*) AS windows, count(DISTINCT doc_id) AS chapters, CAST(sum(length(win)) AS BIGINT) AS chars FROM win JOIN g USING (doc_id) GROUP BY ALL",
    "tfidf_terms": f"WITH {_GRAMS} SELECT term, df, total, round(idf, 6) AS idf FROM vi",
    "tfidf_weights": f"WITH {_GRAMS}, w AS (SELECT key, (1 + ln(tf)) * idf AS w FROM tf JOIN vi USING (term)), n AS (SELECT key, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM w) SELECT key, count(*) AS n, round(sum(w), 5) AS total FROM n GROUP BY key",
    "confusion_matrix": f"WITH {_PREDICTIONS} SELECT label, predicted, n, n / greatest(sum(n) OVER (PARTITION BY label), 1) * 100 AS row_pct FROM cells",
    "class_report": f"""WITH {_PREDICTIONS}, per AS (SELECT a.x AS class, (SELECT CAST(sum(n) AS BIGINT) FROM cells WHERE label = a.x) AS support, (SELECT n FROM cells WHERE label = a.x AND predicted = a.x) AS hits, (SELECT sum(n) FROM cells WHERE predicted = a.x) AS guessed FROM l a),
m AS (SELECT class, support, hits, CASE WHEN guessed = 0 THEN 0 ELSE hits / guessed END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m),
o AS (SELECT class, support, precision, recall, f1 FROM f UNION ALL SELECT 'macro avg', sum(support), avg(precision), avg(recall), avg(f1) FROM f UNION ALL SELECT 'weighted avg', sum(support), sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM f UNION ALL SELECT 'accuracy', sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support) FROM f)
SELECT class, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM o""",
    "catalog_matches": f"WITH {_CATALOG} SELECT author, count(*) AS n, min(pg_id) AS first_id, max({_strip('string_split(title, chr(10))[1]')}) AS last_title FROM works GROUP BY author",
    "resumed_works": f"""WITH {_CATALOG}, {_SLUGGED}, f AS (SELECT * FROM s WHERE place <= 30 QUALIFY row_number() OVER (PARTITION BY author_slug, work_slug ORDER BY position) = 1)
SELECT author_slug, work_slug, pg_id FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.place <= 5 AND s.author_slug = f.author_slug AND s.work_slug = f.work_slug)""",
    "ingested_works": f"""WITH {_CATALOG}, f AS (SELECT *, {_slug('author')} AS author_slug, {_strip("string_split(title, chr(10))[1]")} AS work_title FROM works QUALIFY row_number() OVER (PARTITION BY author ORDER BY position) <= 30),
s AS (SELECT *, CASE WHEN left({_slug('work_title')}, 60) = '' THEN 'pg-' || pg_id ELSE left({_slug('work_title')}, 60) END AS work_slug FROM f),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY author_slug, work_slug ORDER BY position) = 1) SELECT author, author_slug, work_slug, work_title, pg_id FROM d QUALIFY row_number() OVER (PARTITION BY author ORDER BY position) <= 10""",
    "chapter_split": rf"WITH {_CHAPTERS} SELECT work, chapter_num, CAST(len(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '')) AS INT) AS words, CAST(length(body) AS INT) AS chars, md5(body) AS body_md5 FROM ch",
    "manifest_tally": rf"WITH {_CHAPTERS}, m AS (SELECT list_extract({_list(_REGISTERS)}, CAST(work % 5 + 1 AS INT)) AS cluster, len(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '')) AS words FROM ch) SELECT CASE WHEN grouping(cluster) = 1 THEN 'TOTAL' ELSE cluster END AS cluster, count(*) AS chapters, CAST(sum(words) AS BIGINT) AS words FROM m GROUP BY ROLLUP (cluster)",
    "prose_titles": f"WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS path, source AS author, {_strip('string_split(text, chr(10))[1]')} AS title FROM documents) SELECT path, author FROM t WHERE NOT regexp_matches(title, {_q('(?i)' + K.NOT_PROSE_TITLE)}) QUALIFY row_number() OVER (PARTITION BY author ORDER BY md5('42|' || path), path) <= 50",
    "conversation_responses": f"""WITH u AS (SELECT conv_id, turn, text, '{K.PROMPT[0]}Plain realism{K.PROMPT[1]}' || text || '{K.PROMPT[2]}' AS p FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(p) AS prompt_md5, md5('[INST] ' || {_q(K.BASELINE_GENERIC)} || chr(10) || chr(10) || text || chr(10) || chr(10) || '{K.BASELINE_START} {K.INSTRUCTION_END}') AS baseline_md5, md5({_strip("substr(p || ' reply to ' || text, strpos(p || ' reply to ' || text, '[/INST]') + 7)")}) AS response_md5 FROM u""",
    "brief_requests": f"""SELECT doc_id, md5('[INST] ' || {_q(K.BRIEF_INSTRUCTION)} || chr(10) || chr(10) || 'Scene:' || chr(10) || left(text, 1500) || chr(10) || '[/INST]') AS request_md5, trim({_strip("regexp_replace(" + _strip("string_split(text, chr(10))[1]") + ", " + _q('(?i)' + K.BRIEF_LABEL) + ", '')")}, '"'' ') AS brief FROM documents""",
    "text_scalars": rf"""WITH r AS (SELECT doc_id, text, regexp_extract_all(text, {_q(_L + '+')}) AS runs FROM documents)
SELECT doc_id, md5({_slug('text')}) AS slug_md5, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INT) AS words, CAST(len(list_filter(runs, lambda x: regexp_matches(x, {_q('(?i)^' + _L + '+ly$')}))) AS INT) AS adverbs,
  CAST(len(list_filter(runs, lambda x: regexp_matches(x, {_q('(?i)^' + _L + '{2,}(' + '|'.join(K.NOMINAL_SUFFIXES) + ')$')}))) AS INT) AS nominalizations, CAST(length(text) - length(replace(text, ',', '')) AS INT) AS commas,
  CAST(length(regexp_replace(text, '\n+', ' ', 'g')) AS INT) AS chars, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')) AS INT) AS paragraphs FROM r""",
    "adapter_choice": r"WITH p AS (SELECT lang AS register, 'adapters\' || lang || '\' || CASE WHEN lang = 'fr' AND n_chars > 20000 THEN 'final' ELSE 'checkpoint-' || n_chars END AS path, CASE WHEN lang = 'fr' AND n_chars > 20000 THEN 4611686018427387904 ELSE n_chars END AS r FROM documents) SELECT register, arg_max(path, r) AS path FROM p GROUP BY register",
    "projection": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), d AS (SELECT vec_id, v, list_sum(list_transform(v, lambda x: x * 0.125::DOUBLE)) AS dot FROM e) SELECT vec_id, round(list_sum(list_transform(v, lambda x: (x - dot * 0.125::DOUBLE) * (x - dot * 0.125::DOUBLE))), 6) AS square, round(v[1] - dot * 0.125::DOUBLE, 6) AS first FROM d",
    "label_centroids": "WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS r, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT r, i, avg(x) AS x FROM e GROUP BY ALL), d AS (SELECT vec_id, c.r, avg(abs(e.x - c.x)) AS delta FROM e JOIN c ON e.i = c.i GROUP BY ALL) SELECT vec_id, arg_min(r, delta) AS nearest, round(min(delta), 6) AS delta FROM d GROUP BY vec_id",
    "parameter_tally": "SELECT CAST(sum(CASE WHEN p_type = 'ECONOMY' THEN p_size ELSE 0 END) AS BIGINT) AS trainable, CAST(sum(p_size) AS BIGINT) AS total, sum(CASE WHEN p_type = 'ECONOMY' THEN p_size ELSE 0 END) / greatest(sum(p_size), 1) AS share FROM part",
    "event_windows": "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
