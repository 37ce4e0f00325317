"""DuckDB SQL with the results of ``lectern.queries``, written on its own from the rules (RE2 has no lookaround)."""

from __future__ import annotations

from lectern import bank
from lectern.functions.text import PAGE_REF, STOPWORDS, STRUCTURAL_HEADS
from lectern.operators import classify

SQL: dict[str, str] = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def clean(x: str) -> str:
    return squeeze(f"strip_accents(translate({x}, '‘’“”–—­', '''''\"\"--'))")


def normal(x: str) -> str:
    return f"regexp_replace(lower({clean(x)}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: length(w) > 0)"


def digest(x: str) -> str:
    return f"md5(coalesce({x}, ''))"


def pick(items: list[str], at: str) -> str:
    return f"list_extract([{', '.join(q(x) for x in items)}], ({at})::INT)"


def windows(size: int, overlap: int, least: int) -> str:
    step = size - overlap
    merged = f"(n - last * {step} < {least} AND last > 0)" if least else "false"
    return f"""
  cw AS (SELECT source, doc_id AS page_number, {words(clean('text'))} AS w FROM documents),
  cn AS (SELECT *, len(w) AS n, (len(w) - 1) // {step} AS last FROM cw WHERE len(w) > 0),
  cm AS (SELECT *, {merged} AS merged FROM cn),
  ci AS (SELECT *, unnest(range(0, CASE WHEN merged THEN last ELSE last + 1 END)) AS ix FROM cm),
  c AS (SELECT source, page_number, ix::INT AS ix, CASE WHEN merged AND ix = last - 1
          THEN list_concat(list_slice(w, ix * {step} + 1, ix * {step} + {size}), list_slice(w, last * {step} + 1, last * {step} + {size}))
          ELSE list_slice(w, ix * {step} + 1, ix * {step} + {size}) END AS cut FROM ci),
  chunks AS (SELECT source, page_number, ix, array_to_string(cut, ' ') AS text, len(cut)::INT AS n_words FROM c)"""


MERGED = windows(400, 50, 60)
SQL["extraction_audit"] = f"""WITH d AS (SELECT source, len({words("coalesce(text, '')")}) AS n, doc_id % 7 = 0 AS ocr FROM documents)
SELECT source, count(*) AS pages, sum(n)::BIGINT AS words, median(n) AS median_words, count(*) FILTER (n < 30) AS short_pages, sum(ocr::INT)::BIGINT AS ocr_pages FROM d GROUP BY source"""
SQL["chunks_merged"] = f"WITH {MERGED} SELECT source, page_number, ix, n_words, {digest('text')} AS text_md5 FROM chunks"
SQL["chunks_folded"] = SQL["chunks_merged"]
SQL["chunks_plain"] = f"WITH {windows(200, 30, 0)} SELECT source, page_number, (row_number() OVER (PARTITION BY source ORDER BY page_number, ix) - 1)::INT AS chunk_id, n_words, {digest('text')} AS text_md5 FROM chunks"
SQL["chunk_audit"] = f"WITH {MERGED} SELECT source, count(*) AS chunks, round(avg(n_words), 6) AS mean_words, min(n_words) AS min_words, max(n_words) AS max_words FROM chunks GROUP BY source"
SQL["chunk_context"] = f"""WITH {MERGED}, o AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY page_number, ix) - 1)::INT AS chunk_id FROM chunks)
SELECT source, chunk_id, {digest('right(lag(text) OVER w, 300)')} AS before_md5, {digest('left(lead(text) OVER w, 300)')} AS after_md5 FROM o WINDOW w AS (PARTITION BY source ORDER BY chunk_id)"""
SQL["chunk_fingerprint"] = f"""WITH {MERGED}, o AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY page_number, ix) - 1 AS chunk_id, length(text) AS len FROM chunks),
  r AS (SELECT concat_ws('#', source, chunk_id, len) AS p, row_number() OVER (ORDER BY source, chunk_id) - 1 AS rn, count(*) OVER () AS n FROM o)
SELECT max(n) || '::' || left(sha1(max(n) || '|' || max(p) FILTER (rn = 0) || '|' || max(p) FILTER (rn = n // 2) || '|' || max(p) FILTER (rn = n - 1)), 12) AS fingerprint FROM r"""
SQL["distinct_documents"] = f"""WITH d AS (SELECT doc_id, source, trim({normal('text')}) AS t FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS rn FROM d)
SELECT doc_id, source FROM r WHERE rn = 1 OR t = ''"""
LINES = "WITH l AS (SELECT source, doc_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS raw, generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r'), 1) AS pos FROM documents), s AS (SELECT *, trim(raw) AS line FROM l WHERE trim(raw) <> ''), u AS (SELECT DISTINCT source, doc_id, line FROM s WHERE length(line) <= 140 AND NOT regexp_full_match(line, '\\d{1,3}')), p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source), rep AS (SELECT u.source, line, count(*) AS n FROM u JOIN p USING (source) GROUP BY u.source, line, pages HAVING count(*) / pages >= 0.02)"
SQL["repeated_lines"] = LINES + " SELECT source, line, n FROM rep"
SQL["without_repeated_lines"] = LINES + f", k AS (SELECT s.* FROM s ANTI JOIN rep USING (source, line)), t AS (SELECT source, doc_id, trim(string_agg(raw, chr(10) ORDER BY pos)) AS text FROM k GROUP BY ALL) SELECT source, doc_id AS page_number, {digest('text')} AS text_md5 FROM t WHERE text <> ''"
SQL["full_text"] = f"WITH t AS (SELECT source, string_agg(text, chr(10) ORDER BY doc_id, text) AS text FROM documents GROUP BY source) SELECT source, length(text)::INT AS n, {digest('text')} AS text_md5 FROM t"
SQL["page_of_offset"] = """WITH o AS (SELECT source, doc_id, coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM documents),
  a AS (SELECT source, unnest(range(0, sum(length(text))::BIGINT, 5000)) AS pos FROM documents GROUP BY source)
SELECT a.source, a.pos::BIGINT AS "offset", (SELECT max_by(doc_id, start) FROM o WHERE o.source = a.source AND o.start <= a.pos)::INT AS page_number FROM a"""
SQL["paragraph_tails"] = r"""WITH p AS (SELECT source, doc_id, (CASE WHEN doc_id % 4 = 1 THEN '12 and 13), ' ELSE '' END) || regexp_replace(text, '[()]', '', 'g') || (CASE WHEN doc_id % 5 = 0 THEN ' see (paragraph ' ELSE '' END) AS t FROM documents),
  e AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)\(\s*paragraphs?\s*$') THEN 1 WHEN contains(t, ')') THEN 0 END AS ev FROM p),
  c AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS carried FROM e),
  x AS (SELECT source, doc_id, CASE WHEN carried = 1 AND contains(t, ')') THEN ltrim(regexp_replace(t, '(?s)^[^)]*\)', ''), ' .,:;-' || chr(10) || chr(9)) ELSE t END AS t FROM c)
SELECT source, doc_id AS page_number, CASE WHEN regexp_matches(t, '(?i)\(\s*paragraphs?\s*$') THEN rtrim(regexp_replace(t, '(?i)\(\s*paragraphs?\s*$', ''), ' .,:;-' || chr(10) || chr(9)) ELSE t END AS text FROM x"""
SQL["layout_text"] = f"""WITH s AS (SELECT 'r' || (l_suppkey % 5) AS source, (l_partkey % 40)::INT AS page, l_orderkey || '-' || l_linenumber AS text, l_linenumber * 50.0 AS x0, ((l_orderkey * 7 + l_linenumber * 131) % 1000)::DOUBLE AS y0, CASE WHEN l_orderkey % 4 = 0 THEN 8.0 ELSE 11.0 END AS size FROM lineitem),
  i AS (SELECT * FROM s WHERE y0 >= 80 AND y0 + 10 <= 920), m AS (SELECT source, page, list_sort(list(size))[len(list(size)) // 2 + 1] AS median FROM i GROUP BY ALL),
  k AS (SELECT i.* FROM i JOIN m USING (source, page) WHERE NOT (size <= 0.9 * median AND y0 >= 700)), t AS (SELECT source, page, string_agg(text, chr(10) ORDER BY y0, x0, text) AS t FROM k GROUP BY ALL)
SELECT source, page, length(t)::INT AS n, {digest('t')} AS text_md5 FROM t"""
SQL["ocr_usage"] = "SELECT source, sum((doc_id % 7 = 0)::INT)::BIGINT AS ocr_pages FROM documents GROUP BY source HAVING sum((doc_id % 7 = 0)::INT) > 0"
_meta = [" Crown copyright 2020.", " ISBN 978-1-5286-2222-3 Printed in the UK", " Open Government Licence; Crown Copyright"]
_strip = "t"
for _p in (r"all content is available under the open government licence v?3\.0[^.\n]*\.?", r"open government licence v?3\.0[^.\n]*\.?", r"\bogl\b", r"©?\s*crown copyright[^.\n]*\.?", r"nationalarchives\.gov\.uk[^ \n]*", r"https?://www\.gov\.uk/government/publications/[^\s]+"):
    _strip = f"regexp_replace({_strip}, {q('(?i)' + _p)}, '', 'g')"
SQL["metadata_flags"] = f"""WITH d AS (SELECT doc_id, text || {pick(['', *_meta], 'doc_id % 4 + 1')} AS t FROM documents)
SELECT doc_id, (contains(lower(t), 'crown copyright')::INT + contains(lower(t), 'open government licence')::INT + contains(lower(t), 'isbn')::INT + contains(lower(t), 'printed in the uk')::INT + contains(lower(t), 'nationalarchives.gov.uk')::INT) >= 2 AS metadata,
  {digest(f"trim(regexp_replace(regexp_replace({_strip}, '[ \t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))")} AS stripped_md5 FROM d"""
_lines = "list_filter(list_transform(string_split_regex(t, '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: length(x) > 0)"


def _share(test: str) -> str:
    return f"CASE WHEN len({_lines}) = 0 THEN 0.0 ELSE len(list_filter({_lines}, lambda x: {test})) / len({_lines}) END"


_title = r"""(len(w) < 35 AND NOT regexp_matches(regexp_replace(trim(t), '^\s*\d+[.\)]\s*', ''), '[.!?](\s|$)') AND
   (regexp_matches(trim(t), '^\s*(\d+|[A-Z])[\.\)]\s+\S')::INT + (length(regexp_replace(t, '\P{Lu}', '', 'g')) / greatest(length(regexp_replace(t, '\P{L}', '', 'g')), 1) >= 0.5)::INT + (NOT contains(trim(t), chr(10)) AND len(w) < 20)::INT) >= 2)"""
_ref_test = f"regexp_matches(x, {q(PAGE_REF)})"
_ends = r"len(regexp_extract_all(t, '[.!?](\s|$)'))"
SQL["passage_flags"] = f"""WITH d AS (SELECT doc_id, text AS t, {words('text')} AS w FROM documents),
  f AS (SELECT doc_id, {_title} AS title_only, regexp_matches(trim(t), '(?i)^\\s*contents\\b') OR ({_share("regexp_matches(x, '^.{3,80}(\\.{3,}|\\s{2,})\\s*\\d{1,3}\\s*$')")}) >= 0.4 AS contents,
    len(w) AS n, {_share(_ref_test)} AS refs, regexp_matches(left(t, 200), {q(STRUCTURAL_HEADS)}) AS head, {_ends} / greatest(len(w), 1) < 0.025 AS few FROM d)
SELECT doc_id, title_only, contents, title_only OR (n >= 10 AND ((head::INT + (refs > 0.25)::INT + few::INT) >= 2 OR refs > 0.5)) AS structural FROM f"""

# -- text functions -------------------------------------------------------------------------------

_stop = "[" + ", ".join(q(s) for s in STOPWORDS) + "]"


SQL["text_functions"] = f"""WITH d AS (SELECT doc_id, text, {clean('text')} AS c, {normal('text')} AS n, trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) AS k,
    trim(regexp_replace(replace(translate(text, '­"“”', ''), chr(10), ' '), '[ \t]+', ' ', 'g')) AS e, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT list_contains({_stop}, w)) AS ts FROM documents),
  f AS (SELECT doc_id, t, min(i) AS i FROM (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM d) GROUP BY doc_id, t),
  g AS (SELECT doc_id, array_to_string(list_slice(list(t ORDER BY i), 1, 6), ' ') AS terms FROM f GROUP BY doc_id)
SELECT d.doc_id, {digest('c')} AS clean_md5, {digest('n')} AS normal_md5, left(k, 220) AS dedup_key, {digest('e')} AS extraction_md5, len(list_filter(string_split_regex(n, '\\s+'), lambda w: length(w) >= 2))::INT AS n_tokens, coalesce(g.terms, '') AS terms FROM d LEFT JOIN g USING (doc_id)"""


def sentence_list(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 0)"


SQL["sentences"] = f"WITH d AS (SELECT doc_id, {sentence_list('trim(text)')} AS s FROM documents) SELECT doc_id, len(s)::INT AS n, {digest('s[1]')} AS first_md5, {digest('s[-1]')} AS last_md5 FROM d"
SQL["headings"] = f"""WITH d AS (SELECT doc_id, trim(string_split_regex(trim(left({pick(bank.LEADS, f'doc_id % {len(bank.LEADS)} + 1')} || text, 120)), '[.\\n]')[1]) AS lead FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(lead, '^([Rr]ecommendations?\\s+\\d+[:.]?|[Rr]ec\\s+\\d+|\\d+[.\\)]\\s+[A-Z][A-Za-z\\s]{{3,}}|[A-Z][A-Z\\s\\-,]{{5,}}[A-Z])') THEN lead END AS heading FROM d"""
_labels = "(VALUES " + ", ".join(f"({i}, {q(x)})" for i, x in enumerate(bank.LABELS)) + ") v(id, raw)"
_packed = r"regexp_replace(replace(regexp_replace(regexp_replace(trim(raw), '\s+', '', 'g'), '^\((\d+)\)$', '\1'), '.(', '('), '\.$', '')"
SQL["label_functions"] = rf"""SELECT id::INT AS id, regexp_replace(lower(trim(raw)), '\.+$', '') AS label, CASE WHEN regexp_matches(trim(raw), '(?i)^\d+[a-z] [ivx]+$') THEN trim(raw) ELSE {_packed} END AS item_label,
  nullif(coalesce(list_position(['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv'], lower(trim(raw))), 0), 0)::INT AS roman, lower(regexp_replace(regexp_replace(raw, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM {_labels}"""
_alnum = "regexp_extract_all(lower({}), '[a-z0-9]+')"
SQL["token_overlap"] = f"""WITH p AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
  d AS (SELECT conv_id, turn, list_distinct({words(normal('text'))}) AS a, list_distinct({words(normal('next'))}) AS b, {_alnum.format('text')} AS x, {_alnum.format('next')} AS y FROM p WHERE next IS NOT NULL AND role = 'user'),
  m AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]), false) - 1, least(len(x), len(y))) AS matched0 FROM d),
  k AS (SELECT *, (CASE WHEN matched0 < 0 THEN least(len(x), len(y)) ELSE matched0 END)::INT AS matched FROM m)
SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS jaccard,
  CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round(len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(x)), 6) END AS containment, matched, CASE WHEN len(x) = 0 THEN 0.0 ELSE round(matched / len(x), 6) END AS ratio FROM k"""
_tags = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _e, _ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
    _tags = f"replace({_tags}, {q(_e)}, {q(_ch)})"
SQL["strip_tags"] = f"SELECT page_id, {digest(squeeze(_tags))} AS text_md5 FROM pages"
SQL["preview_sentences"] = f"""WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace({squeeze('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 0) AS s FROM documents),
  u AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(left(t, 55)) ORDER BY i) AS rn FROM u),
  k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS t FROM r WHERE length(t) < 25 OR rn = 1 GROUP BY doc_id)
SELECT d.doc_id, {digest('k.t')} AS text_md5 FROM d LEFT JOIN k USING (doc_id)"""
SQL["preview_window"] = f"""WITH d AS (SELECT doc_id, {words(squeeze('text'))} AS w FROM documents), u AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d WHERE len(w) > 0),
  s AS (SELECT doc_id, n, i, sum((contains(lower(x), 'the') OR contains(lower(x), 'que'))::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 64 FOLLOWING) AS hits FROM u),
  r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) AS rn FROM s WHERE i <= greatest(n - 65, 0)) SELECT doc_id, i::INT AS start FROM r WHERE rn = 1"""
_esc = "text"
for _ch, _e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
    _esc = f"replace({_esc}, {q(_ch)}, {q(_e)})"
SQL["highlight"] = f"SELECT doc_id, {digest(f"regexp_replace({_esc}, '(?i)(then|que|the)', '<mark>\\1</mark>', 'g')")} AS text_md5 FROM documents"
SQL["source_titles"] = "SELECT DISTINCT source, CASE WHEN source = 'src0' THEN 'First source' ELSE upper(left(source, 1)) || lower(substr(source, 2)) END AS title FROM documents"

# -- retrieval ------------------------------------------------------------------------------------


def grams(src: str, key: str, text: str, name: str) -> str:
    """``{name}(id, term, tf)`` of unigrams and bigrams."""
    return f"""
  {name}t AS (SELECT {key} AS id, list_filter(string_split_regex({normal(text)}, '\\s+'), lambda w: length(w) >= 2) AS t FROM {src}),
  {name}g AS (SELECT id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM {name}t),
  {name} AS (SELECT id, term, count(*) AS tf FROM {name}g GROUP BY ALL)"""


def index(src: str, key: str, text: str) -> str:
    return grams(src, key, text, "ct") + f""",
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {src})) / (1 + count(*))) + 1 AS idf FROM ct GROUP BY term),
  cr AS (SELECT id, term, tf * idf AS raw FROM ct JOIN idf USING (term)), cnorm AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM cr GROUP BY id)"""


def asked(src: str, text: str = "query") -> str:
    return grams(src, "query_id", text, "qt") + """,
  qr AS (SELECT id, term, tf * idf AS raw FROM qt JOIN idf USING (term)), qnorm AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM qr GROUP BY id),
  cos AS (SELECT qr.id AS query_id, cr.id AS chunk_id, sum(qr.raw * cr.raw) / any_value(qnorm.norm * cnorm.norm) AS score FROM qr JOIN cr USING (term) JOIN qnorm ON qnorm.id = qr.id JOIN cnorm ON cnorm.id = cr.id GROUP BY ALL)"""


def factor(src: str) -> str:
    return f"""
  pf AS (SELECT chunk_id, text AS t, {words('text')} AS w FROM {src}),
  fl AS (SELECT chunk_id, {_title} AS title_only, regexp_matches(trim(t), '(?i)^\\s*contents\\b') OR ({_share("regexp_matches(x, '^.{3,80}(\\.{3,}|\\s{2,})\\s*\\d{1,3}\\s*$')")}) >= 0.4 AS contents, len(w) AS n, {_share(_ref_test)} AS refs, regexp_matches(left(t, 200), {q(STRUCTURAL_HEADS)}) AS head, {_ends} / greatest(len(w), 1) < 0.025 AS few FROM pf),
  fa AS (SELECT chunk_id, CASE WHEN contents THEN 0.45 WHEN title_only OR (n >= 10 AND ((head::INT + (refs > 0.25)::INT + few::INT) >= 2 OR refs > 0.5)) THEN 0.65 ELSE 1.0 END AS f FROM fl)"""


PASSAGES = MERGED + ", passages AS (SELECT *, page_number::BIGINT * 1000000 + ix AS chunk_id FROM chunks)"
QUESTIONS = f"questions AS (SELECT item_id AS query_id, {clean('text')} AS query, text FROM benchmark)"


def keyword(src: str, k: int) -> str:
    return f"{index(src, 'chunk_id', 'text')}, {QUESTIONS}, {asked('questions')}, {factor(src)}, ks AS (SELECT query_id, chunk_id, score * f AS score FROM cos JOIN fa USING (chunk_id)), kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ks WHERE score > 0), found AS (SELECT query_id, rank::INT AS rank, chunk_id, source, text, score FROM kr JOIN {src} USING (chunk_id) WHERE rank <= {k})"


SQL["keyword_search"] = f"WITH {PASSAGES}, {keyword('passages', 5)} SELECT query_id, rank, chunk_id, source, round(score, 6) AS score FROM found"
SQL["scoped_search"] = f"WITH {PASSAGES}, scope AS (SELECT * FROM passages WHERE source IN ('src1', 'src2')), {keyword('scope', 3)} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM found"
SQL["idf_weights"] = f"WITH {index('documents', 'doc_id', 'text')} SELECT term, round(idf, 6) AS idf FROM idf"
DENSE = f"""dp AS (SELECT doc_id AS chunk_id, source, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
  dq AS (SELECT item_id AS query_id, {clean('text')} AS query, embedding AS qe FROM benchmark JOIN embeddings ON vec_id = item_id),
  qterm AS (SELECT DISTINCT query_id, t FROM (SELECT query_id, unnest(list_filter(string_split_regex(lower(query), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT list_contains({_stop}, w))) AS t FROM dq)),
  pn AS (SELECT *, {normal('text')} AS norm FROM dp), qn AS (SELECT *, {normal('query')} AS qnorm_text FROM dq),
  pair AS (SELECT query_id, chunk_id, source, qnorm_text <> '' AND contains(norm, qnorm_text) AS phrase, list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS cs FROM pn CROSS JOIN qn)"""
SQL["semantic_search"] = f"""WITH {DENSE}, cov AS (SELECT query_id, chunk_id, avg(contains(lower(text), t)::INT) AS cov FROM qterm CROSS JOIN dp GROUP BY ALL),
  s AS (SELECT query_id, chunk_id, cs + CASE WHEN cov IS NULL THEN 0 ELSE 0.5 * cov + 1.5 * phrase::INT END AS score FROM pair LEFT JOIN cov USING (query_id, chunk_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM s) SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 5"""


def qtype(n: str) -> str:
    return rf"""CASE WHEN regexp_matches(query, '(?i)\brec(ommendations?)?\s+(\d+)\b') OR length(query) - length(replace(query, '"', '')) >= 2 THEN 'exact_phrase'
  WHEN regexp_matches(query, '(?i)\b\d{{2,}}\b|(thousand|million|billion|per\s*cent|\d+\s*%|19\d{{2}}|20\d{{2}})\b') THEN 'numeric' WHEN {n} <= 2 THEN 'short' WHEN {n} >= 8 THEN 'exploratory' ELSE 'general' END"""


_alpha = "CASE kind WHEN 'exact_phrase' THEN 0.80 WHEN 'numeric' THEN 0.85 WHEN 'short' THEN 0.40 WHEN 'exploratory' THEN 0.25 ELSE 0.55 END::DOUBLE"
_nterms = f"len(list_distinct(list_filter(string_split_regex(lower(query), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT list_contains({_stop}, w))))"
SQL["query_types"] = f"""WITH a AS (SELECT item_id AS query_id, {clean('text')} AS query FROM benchmark UNION ALL SELECT * FROM (VALUES {', '.join(f'({1000 + i}, {q(x)})' for i, x in enumerate(bank.QUERIES))}) v(query_id, query)),
  k AS (SELECT query_id, {qtype(_nterms)} AS kind FROM a), m AS (SELECT query_id, kind, {_alpha} AS alpha FROM k) SELECT query_id, kind, alpha, CASE WHEN alpha >= 0.7 THEN 'keyword-heavy' WHEN alpha >= 0.45 THEN 'balanced' ELSE 'semantic-heavy' END AS mix FROM m"""
SQL["hybrid_search"] = f"""WITH {DENSE}, {index('dp', 'chunk_id', 'text')}, {asked('dq')}, {factor('dp')}, lex AS (SELECT query_id, chunk_id, score * f AS lex FROM cos JOIN fa USING (chunk_id)), most AS (SELECT query_id, max(lex) AS most FROM lex GROUP BY query_id),
  qk AS (SELECT query_id, {qtype(_nterms)} AS kind FROM dq), qa AS (SELECT query_id, {_alpha} AS alpha FROM qk),
  tw AS (SELECT query_id, t, coalesce(idf, (SELECT max(idf) FROM idf)) AS w FROM qterm LEFT JOIN idf ON term = t), cov AS (SELECT query_id, chunk_id, sum(CASE WHEN contains(lower(text), t) THEN w ELSE 0 END) / sum(w) AS cov FROM tw CROSS JOIN dp GROUP BY ALL),
  s AS (SELECT query_id, chunk_id, alpha * coalesce(lex, 0) / (coalesce(most, 0) + 1e-9) + (1 - alpha) * least(1, greatest(0, cs)) + 0.45 * coalesce(cov, 0) + 0.15 * phrase::INT + CASE WHEN source = 'src1' THEN 0.12 ELSE 0 END AS score
    FROM pair JOIN qa USING (query_id) LEFT JOIN lex USING (query_id, chunk_id) LEFT JOIN most USING (query_id) LEFT JOIN cov USING (query_id, chunk_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM s) SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 5"""
SQL["source_boost"] = f"""WITH {PASSAGES}, {keyword('passages', 5)}, b AS (SELECT query_id, chunk_id, round(score, 6) + CASE WHEN source IN ('src0', 'src3') THEN 0.12 ELSE 0 END AS score FROM found)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank, chunk_id, round(score, 6) AS score FROM b"""
SQL["enriched_results"] = rf"""WITH {PASSAGES}, {keyword('passages', 3)}, j AS (SELECT f.*, questions.query FROM found f JOIN questions USING (query_id)),
  t AS (SELECT DISTINCT query_id, t FROM (SELECT query_id, unnest(list_filter(string_split_regex(lower(query), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT list_contains({_stop}, w))) AS t FROM questions)),
  m AS (SELECT query_id, chunk_id, string_agg(t, ' ' ORDER BY t) AS terms FROM j JOIN t USING (query_id) WHERE contains(lower(text), t) GROUP BY ALL), l AS (SELECT query_id, chunk_id, score, trim(string_split_regex(trim(left(text, 120)), '[.\n]')[1]) AS lead FROM j)
SELECT query_id, chunk_id, coalesce(terms, '') AS matched_terms, CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.2 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN regexp_matches(lead, '^([Rr]ecommendations?\s+\d+[:.]?|[Rr]ec\s+\d+|\d+[.\)]\s+[A-Z][A-Za-z\s]{{3,}}|[A-Z][A-Z\s\-,]{{5,}}[A-Z])') THEN lead END AS heading FROM l LEFT JOIN m USING (query_id, chunk_id)"""

# -- evaluation -----------------------------------------------------------------------------------

HITS = f"a AS (SELECT item_id, trim({normal('text')}) AS t FROM benchmark), d AS (SELECT doc_id, {normal('text')} AS t FROM documents), hits AS (SELECT item_id AS anchor_id, doc_id AS chunk_id FROM a JOIN d ON a.t <> '' AND contains(d.t, a.t))"
SQL["anchors"] = f"WITH {HITS} SELECT * FROM hits"
SQL["unresolved_anchors"] = f"WITH {HITS} SELECT item_id AS anchor_id FROM benchmark WHERE item_id NOT IN (SELECT anchor_id FROM hits)"
LABELLED = f"""{PASSAGES}, {keyword('passages', 5)},
  kw0 AS (SELECT query_id, t, min(i) AS i FROM (SELECT query_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT query_id, list_filter(string_split_regex(lower(query), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND NOT list_contains({_stop}, w)) AS ts FROM questions)) GROUP BY ALL),
  kw1 AS (SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM kw0), kw AS (SELECT query_id, t FROM kw1 WHERE n <= 4),
  modes AS (SELECT 'keyword' AS mode, f.* FROM found f UNION ALL SELECT 'short', f.* FROM found f WHERE rank <= 3),
  cov AS (SELECT query_id, chunk_id, avg(contains(lower(text), t)::INT) AS keyword_coverage FROM found JOIN kw USING (query_id) GROUP BY ALL),
  anc AS (SELECT query_id, {normal(f"array_to_string(list_slice({words('text')}, 1, 6), ' ')")} AS a FROM questions WHERE query_id % 5 = 0),
  l0 AS (SELECT m.*, CASE WHEN query_id % 4 <> 0 THEN regexp_matches(source, '^src(0|2|4|6|8|10|12|14|16|18)$') END AS doc_match, keyword_coverage, coalesce(contains({normal('text')}, a), false) AS anchor_match, CASE query_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'broad' ELSE 'topic' END AS query_type
    FROM modes m LEFT JOIN cov USING (query_id, chunk_id) LEFT JOIN anc USING (query_id)),
  labelled AS (SELECT *, CASE WHEN anchor_match THEN 'relevant' WHEN doc_match AND keyword_coverage >= 0.5 THEN 'likely_relevant' WHEN doc_match AND keyword_coverage >= 0.25 THEN 'partial' WHEN doc_match THEN 'doc_match_only' WHEN NOT doc_match THEN 'irrelevant' ELSE 'unknown' END AS auto_relevance FROM l0)"""
SQL["relevance_labels"] = f"WITH {LABELLED} SELECT mode, query_id, rank, doc_match, round(keyword_coverage, 6) AS keyword_coverage, anchor_match, auto_relevance FROM labelled"
SQL["retrieval_metrics"] = f"""WITH {LABELLED}, g AS (SELECT *, (auto_relevance IN ('relevant', 'likely_relevant'))::INT AS hit, CASE auto_relevance WHEN 'relevant' THEN 3 WHEN 'likely_relevant' THEN 2 WHEN 'partial' THEN 1 WHEN 'doc_match_only' THEN 1 ELSE 0 END AS grade FROM labelled),
  b AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY grade DESC, rank) AS best FROM g),
  p AS (SELECT mode, query_type, query_id, coalesce(sum(hit) FILTER (rank <= 1), 0) AS h1, coalesce(sum(hit) FILTER (rank <= 3), 0) AS h3, coalesce(sum(hit) FILTER (rank <= 5), 0) AS h5, count(*) FILTER (rank <= 5) AS n5, min(rank) FILTER (hit = 1) AS first,
    sum(CASE WHEN rank <= 5 THEN grade / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 5 THEN grade / log2(best + 1) ELSE 0 END) AS idcg, max((rank = 1 AND coalesce(doc_match, false))::INT) AS doc1 FROM b GROUP BY ALL)
SELECT mode, CASE WHEN grouping(query_type) = 1 THEN 'ALL' ELSE query_type END AS query_type, count(*) AS n_queries, round(avg(h1), 3) AS recall_at_1, round(avg((h3 > 0)::INT), 3) AS recall_at_3, round(avg((h5 > 0)::INT), 3) AS recall_at_5,
  round(avg(h1), 3) AS precision_at_1, round(avg(h3 / 3), 3) AS precision_at_3, round(avg(h5 / greatest(n5, 1)), 3) AS precision_at_5, round(avg(coalesce(1 / first, 0)), 3) AS mrr, round(avg(h1), 3) AS top1_accuracy, round(avg(doc1), 3) AS doc_accuracy,
  round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 3) AS ndcg_at_5 FROM p GROUP BY GROUPING SETS ((mode), (mode, query_type))"""


def _error(n: str) -> str:
    return f"CASE WHEN auto_relevance IN ('relevant', 'likely_relevant') THEN '' WHEN {n} < 60 THEN 'chunk_too_small' WHEN {n} > 450 THEN 'chunk_too_large' WHEN NOT coalesce(doc_match, false) AND score > 0.15 THEN 'wrong_doc_similar_topic' WHEN NOT coalesce(doc_match, false) THEN 'wrong_document' WHEN coalesce(keyword_coverage, 0) < 0.2 THEN 'paraphrase_miss' ELSE 'ranking_issue' END"


FAILED = f"{LABELLED}, failed AS (SELECT l.*, q2.query, {_error(f'len({words('text')})').replace('text', 'l.text')} AS cat FROM labelled l JOIN (SELECT query_id, query FROM questions) q2 USING (query_id) WHERE rank = 1 AND mode = 'keyword' AND auto_relevance NOT IN ('relevant', 'likely_relevant'))"
SQL["error_table"] = f"WITH {FAILED} SELECT cat AS error_category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM failed), 1) AS pct, CASE cat {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in bank.ERRORS.items())} ELSE '' END AS description, left(min_by(query, query_id), 80) AS example FROM failed GROUP BY cat"
SQL["error_crosstab"] = f"WITH {FAILED} SELECT query_type, " + ", ".join(f"count(*) FILTER (cat = {q(k)}) AS {k}" for k in ("chunk_too_small", "wrong_document", "wrong_doc_similar_topic", "paraphrase_miss", "ranking_issue")) + " FROM failed GROUP BY query_type"
PAIRS = "lp AS (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' WHEN quality = 1 THEN 'partially_accepted' WHEN toxic = 1 THEN 'rejected' ELSE 'not_addressed' END AS truth, " + pick(["accepted", "partially_accepted", "accepted", "rejected"], "doc_id % 4 + 1") + " AS prediction FROM labels), ls AS (SELECT unnest(['accepted', 'partially_accepted', 'rejected', 'not_addressed']) AS l)"
SQL["confusion_matrix"] = f"WITH {PAIRS} SELECT t.l AS truth, p.l AS prediction, (SELECT count(*) FROM lp WHERE truth = t.l AND prediction = p.l) AS n FROM ls t CROSS JOIN ls p"
SQL["class_scores"] = f"""WITH {PAIRS}, c AS (SELECT l AS label, (SELECT count(*) FROM lp WHERE truth = l) AS support, (SELECT count(*) FROM lp WHERE prediction = l) AS predicted, (SELECT count(*) FROM lp WHERE truth = l AND prediction = l) AS tp FROM ls),
  s AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM c), f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM f"""

# -- alignment ------------------------------------------------------------------------------------


def pair_cos(left: str, right: str, pad: int, name: str) -> str:
    """``{name}(pair_id, l, r, score)`` of texts in ``left(pair_id, l, text)`` and ``right(pair_id, r, text)``."""
    return f"""
  {name}_s AS (SELECT pair_id, 'l' AS side, l AS id, {normal('text')} AS t FROM {left} UNION ALL SELECT pair_id, 'r', r, {normal('text')} FROM {right}),
  {name}_n AS (SELECT pair_id, count(*) + {pad} AS n FROM {name}_s WHERE side = 'l' OR t <> '' GROUP BY pair_id),
  {name}_t AS (SELECT pair_id, side, id, list_filter(string_split_regex(t, '\\s+'), lambda w: length(w) >= 2) AS t FROM {name}_s),
  {name}_g AS (SELECT pair_id, side, id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM {name}_t),
  {name}_c AS (SELECT pair_id, side, id, term, count(*) AS tf FROM {name}_g GROUP BY ALL), {name}_d AS (SELECT pair_id, term, count(*) AS df FROM {name}_c GROUP BY ALL),
  {name}_w AS (SELECT c.pair_id, side, id, c.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM {name}_c c JOIN {name}_d d ON c.pair_id = d.pair_id AND c.term = d.term JOIN {name}_n n ON n.pair_id = c.pair_id),
  {name}_o AS (SELECT pair_id, side, id, sqrt(sum(w * w)) AS norm FROM {name}_w GROUP BY ALL),
  {name} AS (SELECT a.pair_id, a.id AS l, b.id AS r, sum(a.w * b.w) / any_value(x.norm * y.norm) AS score FROM {name}_w a JOIN {name}_w b ON a.pair_id = b.pair_id AND a.term = b.term AND a.side = 'l' AND b.side = 'r'
    JOIN {name}_o x ON x.pair_id = a.pair_id AND x.side = 'l' AND x.id = a.id JOIN {name}_o y ON y.pair_id = b.pair_id AND y.side = 'r' AND y.id = b.id GROUP BY ALL)"""


TURNS = """u AS (SELECT conv_id AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS l, text FROM conversations WHERE role = 'user'),
  v AS (SELECT conv_id AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, text FROM conversations WHERE role = 'assistant')"""
SQL["similarity_join"] = f"WITH {TURNS}, {pair_cos('u', 'v', 0, 'sim')}, k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, l ORDER BY round(score, 9) DESC, r) AS rank FROM sim WHERE score >= 0.05) SELECT pair_id, l::INT AS rec_id, r::INT AS chunk_id, rank::INT AS rank, round(score, 6) AS score FROM k WHERE rank <= 3"
UNITS = f"""{TURNS}, e AS (SELECT pair_id, l AS r, {squeeze('text')} AS echo FROM u),
  units AS (SELECT v.pair_id, v.r AS unit_id, v.text AS response, CASE WHEN v.r % 2 = 0 THEN [(v.r + 1)::VARCHAR, '9'] ELSE ['x', '9'] END AS labels, CASE WHEN v.pair_id % 2 = 0 THEN echo END AS quote, concat_ws(' ', echo, v.text) AS block FROM v LEFT JOIN e USING (pair_id, r)),
  li AS (SELECT pair_id, label, min(unit_id) AS unit_id FROM (SELECT pair_id, unit_id, unnest(labels) AS label FROM units) GROUP BY ALL)"""
SQL["label_index"] = f"WITH {UNITS} SELECT pair_id, label, unit_id::INT AS unit_id FROM li"
MATCHES = f"""{UNITS}, ur AS (SELECT pair_id, unit_id AS r, response AS text FROM units), uq AS (SELECT pair_id, unit_id AS r, coalesce(quote, '') AS text FROM units), {pair_cos('u', 'ur', 1, 'rs')}, {pair_cos('u', 'uq', 1, 'ss')},
  bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, l ORDER BY round(score, 9) DESC, r) AS k FROM ss WHERE score >= 0.18) WHERE k = 1), br AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, l ORDER BY round(score, 9) DESC, r) AS k FROM rs WHERE score >= 0.05) WHERE k = 1),
  t0 AS (SELECT u.pair_id, u.l, li.unit_id AS named, bs.r AS sr, bs.score AS sscore, br.r AS rr, br.score AS rscore FROM u LEFT JOIN li ON li.pair_id = u.pair_id AND u.pair_id % 3 = 0 AND li.label = (u.l + 1)::VARCHAR LEFT JOIN bs ON bs.pair_id = u.pair_id AND bs.l = u.l LEFT JOIN br ON br.pair_id = u.pair_id AND br.l = u.l),
  tiers AS (SELECT pair_id, l AS rec_id, coalesce(named, sr, rr) AS unit_id, CASE WHEN named IS NOT NULL THEN 'exact_label' WHEN sr IS NOT NULL THEN 'structure' WHEN rr IS NOT NULL THEN 'semantic' END AS match_method, CASE WHEN named IS NOT NULL THEN 0.95 ELSE coalesce(sscore, rscore) END AS score FROM t0),
  prim AS (SELECT * FROM tiers WHERE unit_id IS NOT NULL), alt AS (SELECT * FROM (SELECT rs.pair_id, rs.l AS rec_id, rs.r AS unit_id, rs.score, row_number() OVER (PARTITION BY rs.pair_id, rs.l ORDER BY round(rs.score, 9) DESC, rs.r) AS k FROM rs JOIN prim p ON p.pair_id = rs.pair_id AND p.rec_id = rs.l AND p.unit_id <> rs.r WHERE rs.score >= 0.05) WHERE k <= 2),
  known AS (SELECT pair_id, rec_id, unit_id, match_method, score, true AS "primary" FROM prim UNION ALL SELECT pair_id, rec_id, unit_id, 'semantic', score, false FROM alt),
  late AS (SELECT pair_id, rec_id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY rec_id DESC) AS e FROM tiers) WHERE e <= 3 AND unit_id IS NULL), taken AS (SELECT pair_id, unit_id, min(rec_id) AS since FROM known GROUP BY ALL),
  sq AS (SELECT late.pair_id, late.rec_id, max(units.unit_id) AS unit_id FROM late JOIN units ON units.pair_id = late.pair_id LEFT JOIN taken ON taken.pair_id = units.pair_id AND taken.unit_id = units.unit_id WHERE since IS NULL OR since > late.rec_id GROUP BY ALL),
  matches AS (SELECT * FROM known UNION ALL SELECT pair_id, rec_id, unit_id, 'sequence_correction', 0.3, true FROM sq)"""
SQL["unit_matches"] = f'WITH {MATCHES} SELECT pair_id, rec_id::INT AS rec_id, unit_id::INT AS unit_id, match_method, round(score, 6) AS score, "primary" FROM matches'
SQL["best_matches"] = f"""WITH {MATCHES}, sh AS (SELECT pair_id, unit_id FROM matches WHERE "primary" GROUP BY ALL HAVING count(DISTINCT rec_id) > 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, rec_id ORDER BY round(score, 9) DESC, "primary" DESC, unit_id) AS k FROM matches) WHERE k = 1)
SELECT u.pair_id, u.l::INT AS rec_id, b.unit_id::INT AS unit_id, b.match_method, round(b.score, 6) AS score, CASE WHEN b.match_method = 'exact_label' THEN 'exact' WHEN sh.unit_id IS NOT NULL THEN 'shared' WHEN b.match_method = 'structure' OR b.score >= 0.35 THEN 'matched' WHEN b.score > 0 THEN 'weak' ELSE 'none' END AS status
FROM u LEFT JOIN b ON b.pair_id = u.pair_id AND b.rec_id = u.l LEFT JOIN sh ON sh.pair_id = b.pair_id AND sh.unit_id = b.unit_id"""
SQL["alignment_summary"] = f"WITH {MATCHES} SELECT match_method, count(*) AS n, round(avg(score), 6) AS mean_score FROM matches GROUP BY match_method"

# -- stance, confidence, export -------------------------------------------------------------------

#: What RE2 lacks: phrases with a negative lookahead are matched after the exception is masked.
MASKS = [(r"in\s+part(\s+(?:to|of|by))", r"in_part\1"), (r"partially\s+accepted", "partially_accepted_"), (r"recommendation\s+accepted\s+in\s+principle", "recommendation_accepted_in_principle"), (r"(government\s+accepts?\s+(?:this|the|that)\s+recommendation)(\s+in\s+principle)", r"\1_\2"), (r"noted\s+and\s+accepted", "noted_and_accepted")]


def tests(x: str) -> str:
    """One boolean column per stance test over text column ``x``."""
    out = []
    for name, phrases in classify.TESTS.items():
        plain = [p for p in phrases if " ! " not in p]
        masked = [p.split(" ! ")[0] for p in phrases if " ! " in p]
        sql = f"regexp_matches({x}, {q(classify.pattern(plain))})"
        if masked:
            m = x
            for pat, to in MASKS:
                m = f"regexp_replace({m}, {q('(?i)' + pat)}, {q(to)}, 'g')"
            sql = f"({sql} OR regexp_matches({m}, {q(classify.pattern(masked))}))"
        out.append(f"{sql} AS {name}")
    return ", ".join(out)


REPLIES = f"""rp AS (SELECT doc_id, source, {pick(bank.REPLIES, f'doc_id % {len(bank.REPLIES)} + 1')} || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' ' || text END AS t, (doc_id % 10) / 10.0::DOUBLE AS sim, {pick(bank.METHODS, f'doc_id % {len(bank.METHODS)} + 1')} AS method FROM documents),
  ts AS (SELECT *, {tests('t')} FROM rp), tz AS (SELECT *, negated OR reject AS against, strong1 OR strong2 OR soft OR partial OR strong_hedge OR hedge AS signal FROM ts),
  st AS (SELECT *, CASE WHEN trim(t) = '' THEN 'not_addressed' WHEN not_for THEN 'not_addressed' WHEN against AND signal THEN 'partially_accepted' WHEN against THEN 'rejected' WHEN retained OR hedge OR override THEN 'partially_accepted' WHEN strong1 THEN 'accepted' WHEN strong2 AND strong_hedge THEN 'partially_accepted'
      WHEN strong2 THEN 'accepted' WHEN soft AND strong_hedge THEN 'partially_accepted' WHEN soft THEN 'accepted' WHEN strong_hedge OR partial THEN 'partially_accepted' ELSE 'not_addressed' END AS label,
    CASE WHEN trim(t) = '' THEN 0.0 WHEN not_for THEN 0.9 WHEN against AND signal THEN 0.7 WHEN against THEN 0.85 WHEN retained THEN 0.75 WHEN hedge THEN 0.8 WHEN override THEN 0.75 WHEN strong1 THEN CASE WHEN strong_hedge OR partial THEN 0.85 ELSE 0.92 END WHEN strong2 AND strong_hedge THEN 0.7
      WHEN strong2 THEN 0.82 WHEN soft AND strong_hedge THEN 0.7 WHEN soft THEN CASE WHEN partial THEN 0.78 ELSE 0.75 END WHEN strong_hedge THEN 0.65 WHEN partial THEN 0.6 ELSE 0.0 END::DOUBLE AS conf FROM tz)"""
SQL["stance"] = f"WITH {REPLIES} SELECT doc_id, label, conf AS confidence FROM st"
EXPORT = f"""{REPLIES}, e0 AS (SELECT *, CASE label WHEN 'partially_accepted' THEN 'partial' ELSE label END AS classification FROM st),
  e1 AS (SELECT *, length(trim(t)) AS n, list_filter([CASE WHEN method = 'chunk_fallback' THEN 'chunk_fallback −0.15' END, CASE WHEN method = 'sequence_correction' THEN 'sequence_correction −0.10' END, CASE WHEN length(trim(t)) < 30 THEN 'very_short_response −0.25' END,
    CASE WHEN length(trim(t)) >= 30 AND length(trim(t)) < 100 THEN 'short_response −0.10' END, CASE WHEN classification = 'not_addressed' AND regexp_matches(t, '(?i)\\b(?:accepts?|agrees?|rejects?|does not agree|will |has already|is already|intends?|plans? to|noted|welcomed?)\\b') THEN 'possible_misclassification −0.10' END,
    CASE WHEN classification IN ('accepted', 'partial', 'rejected') AND sim < 0.3 THEN 'low_alignment_for_stance −0.15' END], lambda x: x IS NOT NULL) AS f0 FROM e0),
  ex AS (SELECT *, CASE WHEN t = '' THEN []::VARCHAR[] ELSE f0 END AS factors, CASE WHEN t = '' THEN 0.0 ELSE round(greatest(0, least(1, sim - list_sum(list_concat([0.0], list_transform(f0, lambda x: right(x, 4)::DOUBLE))))), 6) END::DOUBLE AS confidence, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE 'rule_based' END AS classifier FROM e1)"""
SQL["match_confidence"] = f"WITH {EXPORT} SELECT doc_id::VARCHAR AS id, classification, confidence, array_to_string(factors, '|') AS factors FROM ex"
SQL["export_flat"] = f"WITH {EXPORT} SELECT source AS document_pair, doc_id::VARCHAR AS id, classification, confidence, sim AS debug_alignment_confidence, method AS debug_alignment_method, array_to_string(factors, '; ') AS debug_confidence_factors, conf AS debug_classification_confidence, classifier AS debug_classifier_method FROM ex"
SQL["metadata_failures"] = "SELECT source AS document_pair, doc_id::VARCHAR AS id, unnest(['debug.classifier_method missing', 'classifier_method']) AS failure FROM documents WHERE doc_id % 50 = 7"
SQL["golden_diff"] = """WITH b AS (SELECT source AS p, doc_id::VARCHAR AS id, doc_id AS n, lang::VARCHAR AS c, n_chars::VARCHAR AS f FROM documents), k AS (SELECT p, id, n, c, CASE WHEN n % 7 = 0 THEN 'xx' ELSE c END AS c2, f, CASE WHEN n % 5 = 0 THEN NULL ELSE f END AS f2 FROM b WHERE n % 11 <> 3)
SELECT p AS document_pair, id, 'classification' AS field, c AS before, c2 AS after, CASE WHEN n % 35 = 0 THEN 'allowed' ELSE 'unexpected' END AS kind FROM k WHERE c IS DISTINCT FROM c2
UNION ALL SELECT p, id, 'confidence', f, f2, 'unexpected' FROM k WHERE f IS DISTINCT FROM f2 UNION ALL SELECT p, id, NULL, NULL, NULL, 'missing' FROM b WHERE n % 11 = 3 UNION ALL SELECT p, 'new' || id, NULL, NULL, NULL, 'extra' FROM b WHERE n % 13 = 0"""
SQL["export_duplicates"] = "SELECT source AS document_pair, (doc_id % 17)::VARCHAR AS id, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1"
SQL["export_leaks"] = f"WITH {EXPORT} SELECT source AS document_pair, doc_id::VARCHAR AS id, 'the government' AS pattern FROM ex WHERE regexp_matches(ltrim(t), '(?i)^the government') UNION ALL SELECT source, doc_id::VARCHAR, '\\bnoted\\b' FROM ex WHERE regexp_matches(ltrim(t), '(?i)\\bnoted\\b')"
SQL["expectation_failures"] = f"WITH {EXPORT} SELECT source AS document_pair, doc_id::VARCHAR AS id, 'accepted' AS expected, classification FROM ex WHERE doc_id % 9 = 0 AND classification <> 'accepted'"
PRED = f"{EXPORT}, pr AS (SELECT source AS pair_id, doc_id, doc_id::VARCHAR AS id, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE classification END AS label, confidence, factors, method, sim AS score, t, doc_id % 6 = 0 AS shared FROM ex)"
SQL["prediction_summary"] = f"""WITH {PRED}, l AS (SELECT *, coalesce(label, 'not_addressed') AS k FROM pr) SELECT count(*) AS total, count(*) FILTER (k = 'accepted') AS accepted, count(*) FILTER (k = 'partial') AS partial, count(*) FILTER (k = 'rejected') AS rejected, count(*) FILTER (k = 'not_addressed') AS not_addressed,
  round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (confidence < 0.5) AS low_confidence, count(*) FILTER (len(factors) > 0) AS with_factors, count(*) FILTER (method IN ('chunk_fallback', 'sequence_correction')) AS fallback FROM l"""
SQL["alignment_errors"] = f"""WITH {PRED} SELECT * FROM (SELECT 1 AS position, 'no_match' AS category, count(*) FILTER (score IS NULL) AS n FROM pr UNION ALL SELECT 2, 'weak_match', count(*) FILTER (score < 0.3) FROM pr UNION ALL SELECT 3, 'label_pending', count(*) FILTER (score IS NOT NULL AND label IS NULL) FROM pr
  UNION ALL SELECT 4, 'sequence_correction', count(*) FILTER (method = 'sequence_correction') FROM pr UNION ALL SELECT 5, 'shared_response', count(*) FILTER (shared) FROM pr) WHERE n > 0"""
SQL["label_distribution"] = f"WITH {PRED}, e AS (SELECT * FROM (VALUES ('accepted', 100), ('partial', 5), ('rejected', 7), ('not_addressed', 0), ('unknown', 0)) v(label, expected)), c AS (SELECT e.label, expected, count(pr.label) AS n FROM e LEFT JOIN pr ON pr.label = e.label GROUP BY ALL) SELECT label, n, round(100.0 * n / (SELECT count(*) FROM pr), 1) AS pct, n = expected AS as_expected FROM c"
SQL["confidence_spread"] = f"WITH {PRED} SELECT 'confidence' AS field, round(avg(confidence), 3) AS mean, round(min(confidence), 3) AS least, round(max(confidence), 3) AS most FROM pr UNION ALL SELECT 'score', round(avg(score), 3), round(min(score), 3), round(max(score), 3) FROM pr"
SQL["pair_summary"] = f"WITH {PRED} SELECT pair_id, count(*) AS n, count(*) FILTER (label = 'accepted') AS accepted, count(*) FILTER (label = 'partial') AS partial, count(*) FILTER (label = 'rejected') AS rejected, count(*) FILTER (coalesce(label, 'not_addressed') = 'not_addressed') AS not_addressed, round(avg(confidence), 6) AS mean_confidence FROM pr GROUP BY pair_id"
SQL["label_counts"] = f"WITH {PRED} SELECT label AS value, count(*) AS n FROM pr GROUP BY label"
SQL["filtered_page"] = f"WITH {PRED} SELECT pair_id, id, confidence FROM pr WHERE coalesce(label, 'not_addressed') = 'accepted' AND confidence >= 0.2 AND contains(lower(t), 'government') ORDER BY doc_id LIMIT 15 OFFSET 15"

# -- extraction, sources, log ---------------------------------------------------------------------

_items = "it AS (SELECT DISTINCT source, v.* FROM documents CROSS JOIN (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {d}::DOUBLE)" for a, b, c, d in bank.ITEMS) + ") v(label, level, text, confidence))"
SQL["merged_letters"] = rf"""WITH {_items} SELECT source, label, level, text, confidence FROM it WHERE level <> 'alpha' UNION ALL
SELECT source, regexp_extract(label, '^(.*)\(([a-h])\)$', 1) AS label, 'numeric', string_agg('(' || regexp_extract(label, '^(.*)\(([a-h])\)$', 2) || ') ' || regexp_replace(text, '(?i)^\s*\(?[a-h]\s*[.)]\s*', ''), ' ' ORDER BY label), max(confidence) FROM it WHERE level = 'alpha' GROUP BY ALL"""
SQL["collapsed_numerals"] = rf"""WITH {_items}, s AS (SELECT *, CASE WHEN regexp_matches(label, '^\d+[a-h] [ivx]+$') THEN regexp_extract(label, '^(\d+[a-h]) ', 1) ELSE label END AS stem FROM it),
  n AS (SELECT *, count(*) FILTER (level = 'roman-nested') OVER (PARTITION BY source, stem) AS n, bool_or(level = 'alpha-nested') OVER (PARTITION BY source, stem) AS plain FROM s),
  c AS (SELECT source, CASE WHEN level = 'roman-nested' AND n = 1 AND NOT plain THEN stem ELSE label END AS label, CASE WHEN level = 'roman-nested' AND n = 1 AND NOT plain THEN 'alpha-nested' ELSE level END AS level FROM n)
SELECT * FROM c WHERE NOT (level = 'numeric' AND regexp_matches(label, '^\d{{1,2}}\.?$') AND EXISTS (SELECT 1 FROM c x WHERE x.source = c.source AND x.level IN ('alpha-nested', 'roman-nested') AND regexp_extract(x.label, '^(\d+)', 1) = regexp_replace(c.label, '\D', '', 'g')))"""
SQL["best_candidates"] = """WITH d AS (SELECT source, doc_id::VARCHAR AS span_id, (doc_id % 5) / 5.0::DOUBLE AS confidence, left(trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')), 220) AS k FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY confidence DESC, span_id) AS rn FROM d) SELECT source, span_id, confidence FROM r WHERE rn = 1"""
SQL["corpus_round_trip"] = f"WITH {MERGED} SELECT source AS pair_id, count(*) AS chunks, sum(n_words)::BIGINT AS words FROM chunks WHERE source IN ('src0', 'src1', 'src2') GROUP BY source"
SQL["csv_round_trip"] = f"WITH {PRED} SELECT pair_id, id, label, confidence, array_to_string(factors, '; ') AS factors FROM pr"
SQL["json_round_trip"] = f"WITH {EXPORT} SELECT source AS document_pair, doc_id::VARCHAR AS id, classification, confidence, method AS alignment_method FROM ex"
SQL["missing_pairs"] = "SELECT 'src' || n_nationkey AS pair_id FROM nation WHERE 'src' || n_nationkey NOT IN (SELECT source FROM documents)"
SQL["stage_status"] = """WITH e AS (SELECT (user_id % 50)::VARCHAR AS pair_id, event_type AS stage, ts, event_id::VARCHAR AS status FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, stage ORDER BY ts DESC, status DESC) AS rn FROM e) SELECT pair_id, stage, status FROM r WHERE rn = 1"""
SQL["windowed_events"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"
SQL["first_per_group"] = "SELECT o_custkey, rank, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 2"
SQL["priority_pivot"] = "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority"

# -- views, truth ---------------------------------------------------------------------------------

SQL["detector_labels"] = "SELECT doc_id, ['explicit label', 'structured section', 'embedded / heuristic', 'X'][(doc_id % 4 + 1)::INT] || CASE WHEN doc_id % 3 = 0 THEN ' (OCR-derived)' ELSE '' END AS shown FROM documents"
SQL["display_rows"] = f"""WITH {MATCHES}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, rec_id ORDER BY (match_method <> 'exact_label')::INT, round(score, 9) DESC, unit_id) AS k FROM matches) WHERE k = 1),
  c AS (SELECT pair_id, rec_id, count(*) AS n FROM matches GROUP BY ALL)
SELECT u.pair_id, u.l::INT AS rec_id, CASE WHEN u.pair_id % 3 = 0 THEN 'Recommendation ' || (u.l + 1) || '.' ELSE (u.l + 1)::VARCHAR END AS shown, b.unit_id::INT AS unit_id, b.match_method, round(b.score, 6) AS score, coalesce(c.n, 0) AS n_matches,
  CASE WHEN coalesce(b.score, 0) >= 0.5 THEN 'matched' WHEN coalesce(b.score, 0) >= 0.3 THEN 'weak' ELSE 'none' END AS status FROM u LEFT JOIN b ON b.pair_id = u.pair_id AND b.rec_id = u.l LEFT JOIN c ON c.pair_id = u.pair_id AND c.rec_id = u.l"""
SQL["page_units"] = f"WITH {MERGED}, t AS (SELECT source, page_number, count(*) AS n_chunks, string_agg(text, ' ' ORDER BY ix) AS t FROM chunks GROUP BY ALL) SELECT source || '::' || page_number AS uid, n_chunks, {digest('t')} AS text_md5 FROM t"
SQL["pair_lookup"] = f"WITH {PASSAGES} SELECT chunk_id, source, CASE WHEN page_number % 3 <> 1 THEN 'pair-' || source END AS pair_id FROM passages"
SQL["row_lookup"] = f"WITH {PRED}, f AS (SELECT pair_id, (doc_id % 40)::VARCHAR AS id, min(doc_id) AS d FROM pr GROUP BY ALL), a AS (SELECT 'src' || n_nationkey AS pair_id, n_nationkey::VARCHAR AS id FROM nation) SELECT a.pair_id, a.id, f.d AS at, pr.label FROM a LEFT JOIN f ON f.pair_id = a.pair_id AND f.id = a.id LEFT JOIN pr ON pr.doc_id = f.d"
_kind = "CASE item_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'broad' ELSE 'topic' END"
SQL["type_summary"] = f"SELECT {_kind} AS query_type, count(*) AS n_queries, sum((item_id % 5 = 0 AND text IS NOT NULL)::INT)::BIGINT AS n_anchors FROM benchmark GROUP BY 1"
SQL["run_matrix"] = f"""WITH {PASSAGES}, {keyword('passages', 5)}, m AS (SELECT query_id, rank, chunk_id, 'keyword' AS mode FROM found UNION ALL SELECT query_id, rank, chunk_id, 'short' FROM found WHERE rank <= 3)
SELECT * FROM m WHERE mode = 'keyword' OR query_id % 3 <> 0"""
SQL["recall_pivot"] = f"WITH r AS ({SQL['retrieval_metrics']}) SELECT query_type, coalesce(max(recall_at_5) FILTER (mode = 'keyword'), 0.0) AS keyword, coalesce(max(recall_at_5) FILTER (mode = 'short'), 0.0) AS short FROM r WHERE query_type <> 'ALL' GROUP BY query_type"
_k = "coalesce(label, 'not_addressed')"
SQL["counters"] = f"WITH {PRED} SELECT count(*) AS shown, " + ", ".join(f"count(*) FILTER ({_k} = '{x}') AS {x}" for x in ("accepted", "partial", "rejected", "not_addressed")) + ", round(coalesce(avg(confidence), 0), 6) AS mean_confidence FROM pr WHERE coalesce(confidence, 0) >= 0.2"
SQL["stage_summary"] = f"WITH {PRED} SELECT pair_id, count(*) AS recommendations, count(*) FILTER (method IS NOT NULL AND coalesce(score, 0) > 0) AS aligned, count(label) AS classified, round(avg(score), 6) AS mean_alignment, round(avg(confidence), 6) AS mean_confidence FROM pr GROUP BY pair_id"
SQL["sources_found"] = f"WITH {PASSAGES}, {keyword('passages', 5)} SELECT source, count(*) AS n FROM found GROUP BY source"
SQL["filter_values"] = f"WITH {PRED} SELECT DISTINCT * FROM (SELECT 'pair_id' AS field, pair_id AS value FROM pr UNION ALL SELECT 'label', label FROM pr UNION ALL SELECT 'match_method', method FROM pr) WHERE value IS NOT NULL"
SQL["issues"] = f"""WITH {PRED} SELECT 'low_confidence' AS issue, pair_id, id FROM pr WHERE confidence < 0.5 UNION ALL SELECT 'confidence_factors', pair_id, id FROM pr WHERE len(factors) > 0 UNION ALL SELECT 'rejected', pair_id, id FROM pr WHERE label = 'rejected'
UNION ALL SELECT 'not_addressed', pair_id, id FROM pr WHERE {_k} = 'not_addressed' UNION ALL SELECT 'fallback', pair_id, id FROM pr WHERE method IN ('chunk_fallback', 'sequence_correction')"""
_grid = "SELECT t.l AS truth, p.l AS prediction, (SELECT count(*) FROM tp WHERE tp.truth = t.l AND tp.prediction = p.l) AS n FROM ls t CROSS JOIN ls p"
_truth = PAIRS.replace("SELECT CASE", "SELECT doc_id, CASE", 1)
SQL["truth_by_label"] = f"WITH {_truth}, tp AS (SELECT CASE WHEN doc_id % 5 <> 2 THEN truth ELSE 'not_addressed' END AS truth, prediction FROM lp) {_grid}"
SQL["truth_by_position"] = f"WITH {_truth}, tp AS (SELECT CASE WHEN doc_id < 100 THEN truth ELSE 'not_addressed' END AS truth, prediction FROM lp) {_grid}"
SQL["benchmark_rows"] = f"WITH {PRED} SELECT pair_id, id, label, CASE WHEN doc_id % 4 = 0 THEN 'partially_accepted' END AS true_label, CASE WHEN doc_id % 4 = 0 THEN coalesce(label, '') = 'partial' END AS correct FROM pr"
SQL["truth_status"] = "SELECT *, CASE WHEN n_truth = 0 THEN 'no ground truth' WHEN n_truth <> n_predictions THEN 'counts differ' ELSE 'available' END AS status FROM (SELECT (SELECT count(*) FROM labels) AS n_predictions, (SELECT count(*) FROM documents) AS n_truth)"
SCORES = f"""{PASSAGES}, {keyword('passages', 5)}, {HITS}, rel AS (SELECT DISTINCT hits.anchor_id AS query_id, passages.chunk_id FROM hits JOIN passages ON passages.page_number = hits.chunk_id),
  h AS (SELECT f.query_id, f.rank FROM found f JOIN rel ON rel.query_id = f.query_id AND rel.chunk_id = f.chunk_id), p AS (SELECT query_id, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, min(rank) AS first FROM h GROUP BY query_id),
  got AS (SELECT query_id, count(*) AS n FROM found GROUP BY query_id), rc AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY query_id),
  sc AS (SELECT query_id, relevant, coalesce(got.n, 0) AS retrieved, coalesce(h3, 0) AS hits_at_3, coalesce(h5, 0) AS hits_at_5, round(coalesce(h3, 0) / 3, 6) AS precision_at_3, round(coalesce(h5, 0) / relevant, 6) AS recall_at_5, round(coalesce(1 / first, 0), 6) AS mrr, first::INT AS first_relevant_rank
    FROM rc LEFT JOIN got USING (query_id) LEFT JOIN p USING (query_id))"""
SQL["retrieval_scores"] = f"WITH {SCORES} SELECT * FROM sc"
SQL["retrieval_summary"] = f"WITH {SCORES}, av AS (SELECT count(*)::DOUBLE AS n, avg(precision_at_3) AS p, avg(recall_at_5) AS r, avg(mrr) AS m FROM sc) SELECT 'Queries' AS metric, n AS value FROM av UNION ALL SELECT 'Mean Precision@3', round(p, 6) FROM av UNION ALL SELECT 'Mean Recall@5', round(r, 6) FROM av UNION ALL SELECT 'Mean MRR', round(m, 6) FROM av"
_next = "trim(regexp_replace(replace(translate(t0, '­\"“”', ''), chr(10), ' '), '[ \t]+', ' ', 'g'))"
SQL["next_sections"] = f"""WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN '. 12: Further matters of note' ELSE ' 12 more' END AS t0 FROM documents), c AS (SELECT doc_id, {_next} AS t FROM d),
  m AS (SELECT *, regexp_extract(t, '^(.*?[.!?])\\s+\\d{{1,2}}\\s*:\\s+[A-Za-z].*$', 1) AS cut FROM c) SELECT doc_id, {digest("CASE WHEN cut <> '' THEN trim(cut) ELSE t END")} AS text_md5 FROM m"""

# -- SQL functions, encoders, CSV sets ------------------------------------------------------------

SQL["sql_stance"] = SQL["stance"]
SQL["sql_passages"] = f"WITH {windows(200, 30, 0)} SELECT source, page_number, ix, n_words, {digest('text')} AS text_md5 FROM chunks"
_vowels = ", ".join(f"length(text) - length(replace(text, '{v}', '')) AS n{v}" for v in "aeiou")
_size = "sqrt(na * na + ne * ne + ni * ni + no * no + nu * nu)"
SQL["encoded_documents"] = f"SELECT doc_id, {', '.join(f'round(CASE WHEN {_size} = 0 THEN 0 ELSE n{v} / {_size} END, 6)::DOUBLE AS {v}' for v in 'aeiou')} FROM (SELECT doc_id, {_vowels} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"
SQL["retriever_fallback"] = f"WITH {PASSAGES}, {keyword('passages', 5)} SELECT query_id, rank, chunk_id, round(score, 6) AS score, 'tfidf' AS retriever FROM found"
SQL["recommendations_csv"] = f"""WITH {EXPORT} SELECT doc_id::VARCHAR AS id, source AS document_pair, NULL::VARCHAR AS recommendation_page, NULL::VARCHAR AS recommendation_text, NULL::VARCHAR AS matched_response_page,
  nullif(t, '') AS matched_response_text, classification, printf('%.3f', confidence) AS confidence FROM ex"""
SQL["predictions_csv"] = f"""WITH {EXPORT} SELECT source AS document_pair, doc_id::VARCHAR AS id, NULL::VARCHAR AS recommendation_page, NULL::VARCHAR AS matched_response_page, classification, confidence, method AS alignment_method, sim AS alignment_confidence,
  conf AS classification_confidence, classifier AS classifier_method, nullif(array_to_string(factors, '; '), '') AS confidence_factors, NULL::VARCHAR AS recommendation_text, nullif(t, '') AS matched_response_text,
  CASE WHEN doc_id % 4 = 0 THEN 'partial' END AS true_label, CASE WHEN doc_id % 4 = 0 THEN (classification = 'partial')::VARCHAR END AS correct FROM ex"""
SQL["results_csv"] = rf"""WITH {PASSAGES}, {keyword('passages', 3)}, l AS (SELECT f.*, query, page_number, trim(string_split_regex(trim(left(f.text, 120)), '[.\n]')[1]) AS lead FROM found f JOIN questions USING (query_id) JOIN (SELECT chunk_id, page_number FROM passages) USING (chunk_id))
SELECT rank::VARCHAR AS rank, query, 'tfidf' AS retriever, source, NULL::VARCHAR AS pair_id, page_number::VARCHAR AS page, round(score, 6) AS score, CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.2 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN regexp_matches(lead, '^([Rr]ecommendations?\s+\d+[:.]?|[Rr]ec\s+\d+|\d+[.\)]\s+[A-Z][A-Za-z\s]{{3,}}|[A-Z][A-Z\s\-,]{{5,}}[A-Z])') THEN lead END AS heading, text, NULL::VARCHAR AS display_preview FROM l"""
