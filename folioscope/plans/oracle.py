"""The registered queries as SQL over the same tables, written from the definitions alone.

``PARTS`` are named common table expressions; ``sql`` puts those a query needs in front of it.
"""

from __future__ import annotations

import re

from ..functions.textcols import STOPWORDS
from ..operators.answers import EXTRACTIVE_HEADER, NO_ANSWER, REFUSAL
from ..operators.metrics import MISS_TITLES, REPLY_TITLES
from ..settings import Settings

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _clean(t: str) -> str:
    for bad, good in (("64256", "ff"), ("64257", "fi"), ("64258", "fl"), ("64259", "ffi"), ("64260", "ffl"), ("8217", "''"), ("8220", '"'), ("8221", '"'), ("8211", "-"), ("8212", "-")):
        t = f"replace({t}, chr({bad}), '{good}')"
    t = rf"regexp_replace({t}, '-\n([a-z])', '\1', 'g')"
    t = rf"regexp_replace({t}, '\s*\n\s*', ' ', 'g')"
    t = rf"regexp_replace({t}, '[ \t]{{2,}}', ' ', 'g')"
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def _noise(t: str) -> str:
    return rf"(length({t}) < 25 OR regexp_full_match({t}, '[\d\s\-–.ivxlIVXL]+') OR length(regexp_replace({t}, '\PL', '', 'g')) / greatest(length({t}), 1) < 0.45::DOUBLE)"


def _tokens(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w))"


def _unit(ids: str, source: str) -> str:
    return f"""SELECT c.{ids}, c.slot, c.n / greatest(sqrt(sum(c.n * c.n) OVER (PARTITION BY c.{ids})), 1e-12::DOUBLE) AS v
  FROM (SELECT {ids}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS slot, count(*)::DOUBLE AS n
        FROM (SELECT {ids}, unnest(t) AS w FROM {source}) GROUP BY 1, 2) c"""


_SENTENCES = r"string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"

_STREAKS = """SELECT run, qid, outcome, sum((outcome = 'error')::INTEGER) OVER (PARTITION BY run, g ORDER BY qid)::BIGINT AS streak FROM
  (SELECT *, sum((outcome <> 'error')::INTEGER) OVER (PARTITION BY run ORDER BY qid) AS g FROM
    (SELECT floor(doc_id / 50)::BIGINT AS run, doc_id AS qid, CASE WHEN quality = 0 OR toxic = 1 OR doc_id % 2 = 0 THEN 'error' ELSE 'answered' END AS outcome FROM labels))"""

PARTS: dict[str, str] = {
    "lines": """SELECT doc_id || '.pdf' AS source, unnest(string_split(text, chr(10))) AS text,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents""",
    "blocks": """SELECT source, (1 + ln // 6)::INTEGER AS page, ln::INTEGER AS ord, text,
  CASE ln % 4 WHEN 0 THEN 50.0 WHEN 1 THEN 50.0 ELSE 320.0 END::DOUBLE AS x0, (((ln * 5) % 6) * 40.0)::DOUBLE AS y0,
  CASE ln % 4 WHEN 0 THEN 560.0 WHEN 1 THEN 290.0 ELSE 560.0 END::DOUBLE AS x1, 306.0::DOUBLE AS mid,
  CASE WHEN ln % 11 = 10 THEN 1 ELSE 0 END AS block_type FROM lines""",
    "sided": "SELECT *, CASE WHEN x1 <= mid + 20 THEN -1 WHEN x0 >= mid - 20 THEN 1 ELSE 0 END AS side FROM blocks WHERE block_type = 0",
    "banded": """SELECT *, (CASE WHEN side = 0 THEN row_number() OVER (PARTITION BY source, page, side ORDER BY round_even(y0, 1), round_even(x0, 1), ord)
  ELSE coalesce(sum((side = 0)::INTEGER) OVER (PARTITION BY source, page ORDER BY y0 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) END)::INTEGER AS band FROM sided""",
    "ordered": """SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY band, CASE side WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END,
  round_even(y0, 1), round_even(x0, 1), ord)::INTEGER AS pos FROM banded""",
    "cleaned": f"SELECT source, page, pos, {_clean('text')} AS text FROM ordered",
    "kept": f"SELECT * FROM cleaned WHERE text <> '' AND NOT {_noise('text')}",
    "lagged": "SELECT *, length(text) > 900 AS big, coalesce(lag(length(text) > 900) OVER (PARTITION BY source, page ORDER BY pos), false) AS was FROM kept",
    "ran": "SELECT *, sum((big OR was)::INTEGER) OVER (PARTITION BY source, page ORDER BY pos) AS run FROM lagged",
    "pieces": f"""SELECT source, page, run, row_number() OVER (PARTITION BY source, page, run ORDER BY pos) AS k, text AS piece FROM ran WHERE NOT big
  UNION ALL SELECT source, page, run, generate_subscripts({_SENTENCES}, 1) AS k, unnest({_SENTENCES}) AS piece FROM ran WHERE big""",
    "fold": """SELECT source, page, run, k, piece AS buf, NULL::VARCHAR AS out FROM pieces WHERE k = 1
  UNION ALL SELECT f.source, f.page, f.run, p.k,
    CASE WHEN length(f.buf) + 1 + length(p.piece) <= 900 THEN f.buf || ' ' || p.piece
         WHEN least(150, 900 - length(p.piece) - 1) > 0 THEN right(f.buf, least(150, 900 - length(p.piece) - 1)) || ' ' || p.piece ELSE p.piece END,
    CASE WHEN length(f.buf) + 1 + length(p.piece) > 900 THEN f.buf END
  FROM fold f JOIN pieces p ON p.source = f.source AND p.page = f.page AND p.run = f.run AND p.k = f.k + 1""",
    "closed": """SELECT source, page, run, k, out AS text FROM fold WHERE out IS NOT NULL
  UNION ALL SELECT source, page, run, max(k) + 1, max_by(buf, k) FROM fold GROUP BY 1, 2, 3""",
    "packed": "SELECT source, page, (row_number() OVER (PARTITION BY source, page ORDER BY run, k) - 1)::INTEGER AS i, text FROM closed",
    "chunks": """SELECT regexp_replace(source, '\\.[^.]*$', '') || '::p' || page || '::c' || i AS chunk_id, regexp_replace(source, '\\.[^.]*$', '') AS doc_id,
  source, page, i, text, row_number() OVER (ORDER BY source, page, i) - 1 AS ord FROM packed WHERE length(text) >= 120""",
    "tokened": f"SELECT ord, {_tokens('text')} AS t FROM chunks",
    "lengths": "SELECT ord, len(t) AS len FROM tokened",
    "stats": "SELECT count(*) AS n, coalesce(avg(len), 0.0)::DOUBLE AS avg_len FROM lengths",
    "postings": "SELECT word, ord, count(*) AS tf FROM (SELECT ord, unnest(t) AS word FROM tokened) GROUP BY 1, 2",
    "words": "SELECT word, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM postings, stats GROUP BY 1",
    "questions": "SELECT item_id + 1 AS qid, text AS question, item_id % 5 < 3 AS answerable FROM benchmark",
    "qtokened": f"SELECT qid, {_tokens('question')} AS t FROM questions",
    "asked": "SELECT DISTINCT qid, unnest(t) AS word FROM qtokened",
    "keyword": """SELECT qid, ord, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / greatest(avg_len, 1e-9::DOUBLE)))), 9) AS keyword
  FROM asked JOIN words USING (word) JOIN postings USING (word) JOIN lengths USING (ord), stats GROUP BY 1, 2""",
    "kranked": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY keyword DESC, ord)::INTEGER AS rank FROM keyword WHERE keyword > 0",
    "vecs": _unit("ord", "tokened"),
    "qvecs": _unit("qid", "qtokened"),
    "dots": "SELECT qid, ord, sum(q.v * d.v) AS s FROM qvecs q JOIN vecs d USING (slot) GROUP BY 1, 2",
    "cosines": "SELECT q.qid, c.ord, round(coalesce(s, 0.0), 9) AS cosine FROM questions q CROSS JOIN chunks c LEFT JOIN dots d ON d.qid = q.qid AND d.ord = c.ord",
    "dranked": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, ord)::INTEGER AS rank FROM cosines",
    "fused": """SELECT d.qid, d.ord, d.cosine, d.rank AS dense_rank, k.rank AS keyword_rank,
  round(1.0::DOUBLE / (60 + d.rank) + coalesce(1.0::DOUBLE / (60 + k.rank), 0.0), 12) AS fused FROM dranked d LEFT JOIN kranked k USING (qid, ord)""",
    "franked": "SELECT f.*, source, page, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, dense_rank)::INTEGER AS rank FROM fused f JOIN chunks USING (ord)",
    "paged": """SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY rank)::INTEGER AS rank
  FROM (SELECT * FROM franked QUALIFY row_number() OVER (PARTITION BY qid, source, page ORDER BY rank) = 1)""",
    "hits": "SELECT p.qid, p.rank AS n, p.ord, chunk_id, c.doc_id, c.source, c.page, c.text, p.cosine AS score, p.fused FROM paged p JOIN chunks c USING (ord) WHERE p.rank <= 5",
    "tops": "SELECT q.qid, q.question, q.answerable, coalesce(max(cosine), 0.0) AS top_score FROM questions q LEFT JOIN cosines USING (qid) GROUP BY 1, 2, 3",
    "guarded": r"SELECT *, (regexp_full_match(question, '\s*') OR top_score < 0.5::DOUBLE) AS abstain FROM tops",
    "expected": """SELECT qid, source, page, CASE qid % 4 WHEN 0 THEN substr(text, 5, 5) WHEN 2 THEN substr(text, 5, 40) ELSE substr(text, 5, 20) || 'zz' END AS evidence
  FROM questions JOIN kranked USING (qid) JOIN chunks USING (ord) WHERE answerable AND rank = 1 + qid % 3""",
    "pages_": r"SELECT source, page, regexp_replace(regexp_replace(lower(string_agg(text, ' ' ORDER BY ord)), '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM chunks GROUP BY 1, 2",
    "found": r"""SELECT DISTINCT e.qid, p.source, p.page FROM expected e JOIN pages_ p ON p.source = e.source
  AND contains(p.text, regexp_replace(regexp_replace(lower(e.evidence), '\s+', ' ', 'g'), '^ | $', '', 'g'))""",
    "truth": "SELECT qid, source, page FROM expected UNION SELECT qid, source, page FROM found",
    "absent": """SELECT q.qid, t.term FROM questions q JOIN (SELECT qid, min(w) AS w FROM (SELECT qid, unnest(t) AS w FROM qtokened) GROUP BY 1) m USING (qid),
  unnest(['zzqx' || q.qid, m.w]) AS t(term) WHERE NOT answerable AND q.qid % 4 <> 0""",
}


def _setup(name: str, table: str) -> str:
    return f"""SELECT '{name}' AS setup, g.qid, g.question, answerable, top_score, abstain, h.source, h.page, h.rank
  FROM guarded g LEFT JOIN (SELECT qid, source, page, rank FROM {table} WHERE rank <= 5) h USING (qid)"""


PARTS["densed"] = "SELECT d.qid, d.ord, d.cosine, d.rank, c.source, c.page FROM dranked d JOIN chunks c USING (ord)"
PARTS["setups"] = " UNION ALL ".join(_setup(n, t) for n, t in (("dense", "densed"), ("hybrid", "franked"), ("hybrid, 1 per page", "paged")))
PARTS["judged"] = """SELECT s.setup, s.qid, any_value(s.question) AS question, any_value(s.answerable) AS answerable, any_value(top_score) AS top_score, any_value(abstain) AS abstain,
  count(DISTINCT s.source || ' p.' || s.page) AS n_pages, coalesce(bool_or(t.qid IS NOT NULL), false) AS overlap,
  coalesce(bool_or(t.qid IS NOT NULL AND s.rank = 1), false) AS first_overlap, string_agg(s.source || ' p.' || s.page, ', ' ORDER BY s.rank) AS cited
  FROM setups s LEFT JOIN truth t ON t.qid = s.qid AND t.source = s.source AND t.page = s.page GROUP BY 1, 2"""
PARTS["outcomes"] = """SELECT j.*, w.wanted, answerable AND NOT abstain AND w.qid IS NOT NULL AS checked, answerable AND NOT abstain AND overlap AS hit,
  answerable AND NOT abstain AND first_overlap AS first_hit
  FROM judged j LEFT JOIN (SELECT qid, string_agg(source || ' p.' || page, ', ' ORDER BY source, page) AS wanted FROM truth GROUP BY 1) w USING (qid)"""
PARTS["missed"] = """SELECT setup, CASE WHEN NOT answerable AND NOT abstain THEN 'answered_unanswerable' WHEN answerable AND abstain THEN 'refused_answerable'
  WHEN checked AND NOT hit THEN 'wrong_page' END AS kind, qid, question, top_score, wanted, cited FROM outcomes"""
PARTS["records"] = """SELECT g.qid, g.answerable, CASE WHEN g.qid % 7 = 3 THEN 'error' WHEN g.qid % 5 = 2 THEN 'refused' ELSE 'answered' END AS outcome FROM guarded g WHERE NOT abstain"""

PARTS["replied"] = """SELECT r.qid, g.question, outcome, c.cited, CASE WHEN outcome = 'error' THEN 'error' WHEN NOT r.answerable AND outcome = 'answered' THEN 'answered'
      WHEN r.answerable AND outcome = 'refused' THEN 'refused' WHEN r.answerable AND outcome = 'answered' AND t.qid IS NOT NULL AND NOT coalesce(c.hit, false) THEN 'wrong_page' END AS kind
    FROM records r JOIN guarded g USING (qid) LEFT JOIN (SELECT DISTINCT qid FROM truth) t USING (qid)
    LEFT JOIN (SELECT h.qid, h.source || ' p.' || h.page AS cited, t.qid IS NOT NULL AS hit FROM hits h LEFT JOIN truth t ON t.qid = h.qid AND t.source = h.source AND t.page = h.page
      WHERE h.n = 1 + h.qid % 2) c USING (qid)"""


def sql(query: str) -> str:
    """``query`` with the parts it names, and those they name, in front."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                visit(PARTS[name])

    visit(query)
    ctes = ",\n".join(f"{n} AS ({PARTS[n]})" for n in PARTS if n in needed)
    return f"WITH RECURSIVE {ctes}\n{query}" if ctes else query


_METRICS = """count(*) AS n_total, count_if(answerable)::BIGINT AS n_answerable, count_if(NOT answerable)::BIGINT AS n_unanswerable,
  round(count_if(NOT answerable) / count(*) * 100, 1) AS unsupported_before_pct, round(count_if(NOT answerable AND NOT abstain) / count(*) * 100, 1) AS unsupported_after_pct,
  round(count_if(answerable AND abstain) / greatest(count_if(answerable), 1) * 100, 1) AS false_refusal_pct,
  round(count_if(hit) / nullif(count_if(checked), 0) * 100, 1) AS citation_hit_rate_pct, round(count_if(first_hit) / nullif(count_if(checked), 0) * 100, 1) AS first_hit_rate_pct,
  count_if(checked)::BIGINT AS answered_checked, count_if(hit)::BIGINT AS cited_right_page, count_if(first_hit)::BIGINT AS cited_right_page_first,
  round(avg(n_pages) FILTER (WHERE checked), 1) AS pages_cited_avg, count_if(NOT answerable AND abstain)::BIGINT AS refused_unanswerable"""

_INJECTED = "replace(replace(replace(replace(text, 'th', chr(64257)), ', ', '-' || chr(10)), ' of ', '   of' || chr(8212)), '. ', '.' || chr(8217) || ' ' || chr(10) || ' ')"
_REFUSAL = "printf(" + _quote(REFUSAL) + ", top_score, 0.5::DOUBLE)"
_EXTRACT = f"{_quote(EXTRACTIVE_HEADER)} || string_agg('[' || n || '] ' || source || ' p.' || page || ' (similarity ' || printf('%.3f', score) || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY n)"



def _titles(titles: dict[str, str]) -> str:
    return ", ".join(f"({_quote(k)}, {_quote(v)})" for k, v in titles.items())


QUERIES: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {_clean(_INJECTED)} AS text FROM documents",
    "noise_filter": f"SELECT source, ln::INTEGER AS ln, {_noise(r'''regexp_replace(text, '^\s+|\s+$', '', 'g')''')} AS noise FROM lines",
    "column_side": "SELECT source, page, ord, side FROM sided",
    "reading_order": "SELECT source, page, ord, side, band, pos FROM ordered",
    "page_blocks": "SELECT source, page, pos, text FROM kept",
    "sentence_split": f"SELECT source, ln::INTEGER AS ln, generate_subscripts({_SENTENCES}, 1)::INTEGER AS k, unnest({_SENTENCES}) AS sentence FROM lines",
    "tokenize": f"SELECT doc_id, (generate_subscripts({_tokens('text')}, 1))::INTEGER AS k, unnest({_tokens('text')}) AS word FROM documents",
    "normalise_text": r"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents",
    "pack_chunks": "SELECT source, page, i, text FROM packed",
    "chunk_table": "SELECT ord, chunk_id, doc_id, source, page, text FROM chunks",
    "skipped_docs": "SELECT DISTINCT doc_id || '.pdf' AS source FROM documents WHERE doc_id || '.pdf' NOT IN (SELECT source FROM chunks)",
    "index_stats": """SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS pdfs, (SELECT count(*) FROM chunks) AS chunks, 384 AS dim,
  (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id || '.pdf' NOT IN (SELECT source FROM chunks)) AS skipped""",
    "index_sync": "SELECT ord, CASE WHEN ord % 97 = 5 THEN 'chunks' ELSE 'vectors' END AS side FROM chunks WHERE ord % 97 = 5 OR ord % 89 = 3 AND ord % 97 <> 5",
    "term_postings": "SELECT word, ord, tf FROM postings",
    "passage_lengths": "SELECT ord, len FROM lengths",
    "corpus_stats": "SELECT n, round(avg_len, 6) AS avg_len FROM stats",
    "idf_table": "SELECT word, df, round(idf, 6) AS idf FROM words",
    "bm25_scores": "SELECT qid, ord, round(keyword, 6) AS keyword FROM keyword",
    "keyword_topk": "SELECT qid, rank AS n, chunk_id, source, page, round(keyword, 6) AS keyword FROM kranked JOIN chunks USING (ord) WHERE rank <= 5",
    "hashed_vectors": "SELECT ord, slot::INTEGER AS slot, round(v, 6) AS v FROM vecs",
    "dense_topk": """SELECT qid, vec_id, rank, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id)::INTEGER AS rank FROM
  (SELECT q.vec_id AS qid, d.vec_id, round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) /
    (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))), 9) AS cosine
   FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""",
    "dense_text_topk": "SELECT qid, rank AS n, chunk_id, round(cosine, 6) AS score FROM dranked JOIN chunks USING (ord) WHERE rank <= 5",
    "top_score": "SELECT qid, round(top_score, 6) AS top_score FROM tops",
    "rrf_fusion": "SELECT qid, rank::BIGINT AS rank, ord, fused FROM franked",
    "one_per_page": "SELECT qid, rank::BIGINT AS rank, ord, source, page FROM paged",
    "hybrid_topk": "SELECT qid, n, chunk_id, source, page, text, round(score, 6) AS score, round(fused, 9) AS fused FROM hits",
    "abstention_guard": "SELECT qid, round(top_score, 6) AS top_score, abstain FROM guarded",
    "refusal_text": f"SELECT qid, {_REFUSAL} AS answer FROM guarded WHERE abstain",
    "extractive_answer": f"SELECT qid, {_EXTRACT} AS answer FROM hits JOIN guarded USING (qid) WHERE NOT abstain GROUP BY 1",
    "prompt_context": "SELECT qid, string_agg('[' || n || '] (' || source || ' p.' || page || ') ' || text, chr(10) || chr(10) ORDER BY n) AS context FROM hits GROUP BY 1",
    "citations": "SELECT qid, n, source, page, round(score, 4) AS score, chunk_id FROM hits JOIN guarded USING (qid) WHERE NOT abstain",
    "sentinel_guard": f"""SELECT qid, abstain OR qid % 3 = 0 AS abstained, CASE WHEN abstain THEN {_REFUSAL} WHEN qid % 3 = 0 THEN {_quote(NO_ANSWER)} ELSE a.answer END AS answer
  FROM guarded LEFT JOIN (SELECT qid, {_EXTRACT} AS answer FROM hits GROUP BY 1) a USING (qid)""",
    "request_validation": """SELECT conv_id, turn, (conv_id % 23)::INTEGER AS top_k, ((turn % 5) - 2) / 2.0::DOUBLE AS threshold,
  coalesce(length(text) BETWEEN 3 AND 1000 AND conv_id % 23 BETWEEN 1 AND 20 AND ((turn % 5) - 2) / 2.0::DOUBLE BETWEEN -1 AND 1 AND role <> 'system', false) AS valid FROM conversations""",
    "cited_pages": """SELECT DISTINCT h.qid, h.n, h.source, h.page FROM hits h WHERE h.n IN (1 + h.qid % 4, 2 + h.qid % 3)""",
    "page_texts": "SELECT source, page, text FROM pages_",
    "evidence_pages": "SELECT qid, source, page FROM found",
    "expected_pages": "SELECT qid, source, page FROM truth",
    "question_problems": r"""SELECT qid, 'incomplete' AS kind, '' AS detail FROM questions WHERE answerable AND qid NOT IN (SELECT qid FROM expected)
  UNION ALL SELECT e.qid, 'evidence_missing', e.source || ' p.' || e.page FROM expected e JOIN pages_ p USING (source, page)
    WHERE NOT contains(p.text, regexp_replace(regexp_replace(lower(e.evidence), '\s+', ' ', 'g'), '^ | $', '', 'g'))
  UNION ALL SELECT qid, 'no_absent_terms', '' FROM questions WHERE NOT answerable AND qid NOT IN (SELECT qid FROM absent)
  UNION ALL SELECT qid, 'term_appears', term || ': ' || string_agg(source || ' p.' || page, ', ' ORDER BY source, page) FROM
    (SELECT qid, term, source, page, row_number() OVER (PARTITION BY qid, term ORDER BY source, page) AS k FROM (SELECT DISTINCT qid, term FROM absent) a
     JOIN pages_ p ON list_contains(regexp_split_to_array(p.text, '[^\pL\pN_]+'), term)) WHERE k <= 3 GROUP BY qid, term
  UNION ALL SELECT NULL, 'few_unanswerable', count_if(NOT answerable) || ' of ' || count(*) FROM questions HAVING count_if(NOT answerable) * 3 < count(*)""",
    "question_notes": """SELECT f.qid, string_agg(f.source || ' p.' || f.page, ', ' ORDER BY f.source, f.page) AS pages FROM found f
  LEFT JOIN expected e ON e.qid = f.qid AND e.source = f.source AND e.page = f.page WHERE e.qid IS NULL GROUP BY 1""",
    "eval_metrics": f"SELECT {_METRICS} FROM outcomes WHERE setup = 'hybrid, 1 per page'",
    "latency_percentiles": "SELECT round(quantile_cont(value, 0.5), 1) AS latency_ms_p50, round(quantile_cont(value, 0.95), 1) AS latency_ms_p95 FROM events",
    "eval_misses": "SELECT kind, qid, question, CASE WHEN kind <> 'wrong_page' THEN round(top_score, 6) END AS top_score, CASE WHEN kind = 'wrong_page' THEN wanted END AS wanted, CASE WHEN kind = 'wrong_page' THEN cited END AS cited FROM missed WHERE setup = 'hybrid, 1 per page' AND kind IS NOT NULL",
    "setup_diff": """SELECT 'fixed' AS change, m.qid, after AS setup FROM (VALUES ('dense', 'hybrid'), ('hybrid', 'hybrid, 1 per page')) pairs(before, after)
    JOIN missed m ON m.kind = 'wrong_page' AND m.setup = before WHERE NOT EXISTS (SELECT 1 FROM missed o WHERE o.kind = 'wrong_page' AND o.setup = after AND o.qid = m.qid)
  UNION ALL SELECT 'lost', m.qid, after FROM (VALUES ('dense', 'hybrid'), ('hybrid', 'hybrid, 1 per page')) pairs(before, after)
    JOIN missed m ON m.kind = 'wrong_page' AND m.setup = after WHERE NOT EXISTS (SELECT 1 FROM missed o WHERE o.kind = 'wrong_page' AND o.setup = before AND o.qid = m.qid)""",
    "setup_compare": f"SELECT setup, {_METRICS} FROM outcomes GROUP BY 1",
    "threshold_sweep": """SELECT t.threshold, round(count_if(NOT answerable AND NOT top_score < t.threshold) / count(*) * 100, 1) AS unsupported_after_pct,
  round(count_if(answerable AND top_score < t.threshold) / greatest(count_if(answerable), 1) * 100, 1) AS false_refusal_pct,
  round(count_if(answerable AND NOT top_score < t.threshold AND overlap) / nullif(count_if(answerable AND NOT top_score < t.threshold AND wanted IS NOT NULL), 0) * 100, 1) AS citation_hit_rate_pct
  FROM outcomes, (SELECT round(0.2 + 0.02 * i, 2)::DOUBLE AS threshold FROM range(24) r(i)) t WHERE setup = 'hybrid, 1 per page' GROUP BY 1""",
    "llm_metrics": """SELECT count_if(NOT answerable)::BIGINT AS passed_unanswerable, count_if(NOT answerable AND outcome = 'refused')::BIGINT AS refused_unanswerable,
  count_if(answerable)::BIGINT AS passed_answerable, count_if(answerable AND outcome = 'refused')::BIGINT AS refused_answerable, count_if(answerable AND outcome = 'answered')::BIGINT AS answered,
  count_if(answerable AND outcome = 'answered' AND c.cited)::BIGINT AS cite_a_passage, count_if(answerable AND outcome = 'answered' AND c.hit AND t.qid IS NOT NULL)::BIGINT AS cite_right_page,
  count_if(answerable AND outcome = 'answered' AND t.qid IS NOT NULL)::BIGINT AS checked_pages, count_if(outcome = 'error')::BIGINT AS no_reply
  FROM records r LEFT JOIN (SELECT DISTINCT qid FROM truth) t USING (qid)
  LEFT JOIN (SELECT h.qid, true AS cited, bool_or(t.qid IS NOT NULL) AS hit FROM hits h LEFT JOIN truth t ON t.qid = h.qid AND t.source = h.source AND t.page = h.page WHERE h.n = 1 + h.qid % 2 GROUP BY 1) c USING (qid)""",
    "error_streaks": f"SELECT run, qid, outcome, streak FROM ({_STREAKS})",
    "stops_after": f"SELECT run, min(qid) AS qid FROM ({_STREAKS}) WHERE streak = 3 GROUP BY 1",
    "setup_report": """SELECT setup, 'Right page among the citations' AS figure, printf('%d of %d (', count_if(hit)::BIGINT, count_if(checked)::BIGINT) ||
    coalesce(round(count_if(hit) / nullif(count_if(checked), 0) * 100, 1)::VARCHAR, '0') || '%)' AS value FROM outcomes GROUP BY 1
  UNION ALL SELECT setup, 'Right page cited first', printf('%d of %d (', count_if(first_hit)::BIGINT, count_if(checked)::BIGINT) ||
    coalesce(round(count_if(first_hit) / nullif(count_if(checked), 0) * 100, 1)::VARCHAR, '0') || '%)' FROM outcomes GROUP BY 1
  UNION ALL SELECT setup, 'Different pages cited (average)', round(avg(n_pages) FILTER (WHERE checked), 1)::VARCHAR FROM outcomes GROUP BY 1
  UNION ALL SELECT ['dense', 'hybrid', 'hybrid, 1 per page'][event_id % 3 + 1], 'Retrieval time, median / p95 (ms)',
    round(quantile_cont(value, 0.5), 1)::VARCHAR || ' / ' || round(quantile_cont(value, 0.95), 1)::VARCHAR FROM events GROUP BY 1""",
    "guard_report": """SELECT unnest([1, 2, 3, 4]) AS n, unnest([
    printf('Threshold 0.5, top 5 citations, %d questions (%d answerable, %d unanswerable).', count(*), count_if(answerable)::BIGINT, count_if(NOT answerable)::BIGINT),
    'The guard is the same in every column:',
    printf('  unanswerable questions that got an answer   %d of %d  (with no guard, all %d)', count_if(NOT answerable AND NOT abstain)::BIGINT, count_if(NOT answerable)::BIGINT, count_if(NOT answerable)::BIGINT),
    printf('  answerable questions refused                %d of %d', count_if(answerable AND abstain)::BIGINT, count_if(answerable)::BIGINT)]) AS line FROM guarded""",
    "miss_report": f"""SELECT t.kind, 0 AS n, t.title || ' (' || count(m.qid) || '):' AS line FROM (VALUES {_titles(MISS_TITLES)}) t(kind, title)
    LEFT JOIN missed m ON m.kind = t.kind AND m.setup = 'hybrid, 1 per page' GROUP BY t.kind, t.title
  UNION ALL SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY qid)::INTEGER, CASE WHEN kind = 'wrong_page' THEN '  ' || question || chr(10) || '      wanted ' || wanted || '; cited ' || cited
    ELSE '  ' || printf('%.3f', top_score) || '  ' || question END FROM missed WHERE setup = 'hybrid, 1 per page' AND kind IS NOT NULL""",
    "reply_report": f"""SELECT t.kind, 0 AS n, t.title || ' (' || count(k.qid) || '):' AS line FROM (VALUES {_titles(REPLY_TITLES)}) t(kind, title) LEFT JOIN replied k ON k.kind = t.kind GROUP BY t.kind, t.title
  UNION ALL SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY qid)::INTEGER, '  ' || question
    || CASE WHEN outcome = 'answered' THEN chr(10) || '      answer: It is so [' || (1 + qid % 2) || '].' || coalesce(chr(10) || '      cited: ' || cited, '') ELSE '' END
    || CASE WHEN outcome = 'error' THEN chr(10) || '      error: no reply' ELSE '' END FROM replied WHERE kind IS NOT NULL""",
    "asked_in_order": """SELECT qid, outcome FROM (SELECT *, coalesce(sum((streak = 3)::INTEGER) OVER (ORDER BY qid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM
    (SELECT *, sum((outcome = 'error')::INTEGER) OVER (PARTITION BY g ORDER BY qid) AS streak FROM (SELECT *, sum((outcome <> 'error')::INTEGER) OVER (ORDER BY qid) AS g FROM
      (SELECT qid, CASE WHEN length(question) % 5 < 2 THEN 'error' WHEN length(question) % 7 = 3 THEN 'refused' ELSE 'answered' END AS outcome FROM guarded WHERE NOT abstain)))) WHERE over = 0""",
}
QUERIES["llm_report"] = f"""SELECT unnest([1, 2, 3, 4, 5, 6]) AS n, unnest([
    printf('Mistral mode ({Settings().llm_model}) on the %d questions the score guard let through:', passed_unanswerable + passed_answerable),
    printf('  unanswerable ones it refused (second guard)   %d of %d', refused_unanswerable, passed_unanswerable), printf('  answerable ones it refused                    %d of %d', refused_answerable, passed_answerable),
    printf('  answers that cite a passage, like [1]         %d of %d', cite_a_passage, answered), printf('  answers citing a passage from the right page  %d of %d', cite_right_page, checked_pages),
    printf('  no answer from Mistral                        %d', no_reply)]) AS line FROM ({QUERIES["llm_metrics"]})"""

QUERIES |= {
    "error_reasons": r"""SELECT conv_id, turn, CASE WHEN turn % 4 = 2 OR r = '' THEN 'no details' ELSE r END AS reason FROM
    (SELECT conv_id, turn, left(regexp_replace(regexp_replace(CASE WHEN turn % 4 = 1 AND text = '' THEN '{"message":"","detail":""}' WHEN turn % 4 = 0 AND text = '' THEN '{"message":""}' ELSE text END,
      '\s+', ' ', 'g'), '^ | $', '', 'g'), 200) AS r FROM conversations)""",
    "blank_questions": """SELECT q.qid, CASE WHEN q.qid % 5 = 0 THEN 0.0 ELSE round(top_score, 6) END AS top_score, q.qid % 5 = 0 OR abstain AS abstain,
    CASE WHEN q.qid % 5 = 0 THEN 0 ELSE coalesce(h.n, 0) END::INTEGER AS hits FROM guarded q LEFT JOIN (SELECT qid, count(*) AS n FROM hits GROUP BY 1) h USING (qid)""",
    "index_health": "SELECT 'ok' AS status, count(*) AS chunks, 'extractive' AS gen_mode, 0.5::DOUBLE AS threshold FROM chunks",
    "ask_responses": """SELECT g.qid, abstain AS abstained, 'extractive' AS mode, round(top_score, 4) AS top_score, 0.5::DOUBLE AS threshold, round(g.qid / 3.0::DOUBLE, 2) AS latency_ms,
    CASE WHEN g.qid % 7 = 0 THEN 502 ELSE 200 END::INTEGER AS status, CASE WHEN abstain THEN 0 ELSE coalesce(h.n, 0) END::INTEGER AS citations
    FROM guarded g LEFT JOIN (SELECT qid, count(*) AS n FROM hits GROUP BY 1) h USING (qid)""",
}
QUERIES["clustered_topk"] = QUERIES["dense_topk"]
QUERIES["keyword_pruned"] = QUERIES["keyword_topk"]

ORACLE_SQL = {name: sql(q) for name, q in QUERIES.items()}
