"""Ranking queries: document paragraphs act as chunks, pages as search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.q_documents import READABLE_SQL
from tidemark.catalog.q_functions import _STOPS
from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.functions import strings as S
from tidemark.operators import extract as X
from tidemark.operators import question_index as I
from tidemark.operators import rank as R
from tidemark.sources.readers import search_results

c = F.col
GROUPS = [["thorou", "with"], ["und", "der"]]
Q1 = {"text": "thorou eration the latest outlook", "ticker": "SRC1", "company": "Hation", "theme": "en", "layer": 2}
Q2 = {"text": "und nicht margin", "ticker": "SRC2", "company": "Nicht", "theme": "de", "layer": 1}
REPUTABLE = ["example.com"]


def words(q: dict) -> list[str]:
    out = [w for w in R._tokens(f"{q['text']} {q['ticker']} {q['company']} {q['theme']} layer {q['layer']}") if w not in S.STOP_WORDS]
    for g in GROUPS:
        if any(w in out for w in g):
            out += [w for w in g if w not in out]
    return list(dict.fromkeys(out))


def chunks(v: Views):
    docs = v.table("documents").select("doc_id", F.upper("source").alias("ticker"), c("lang").alias("theme"))
    return v.paragraphs().join(docs, "doc_id").select(
        F.concat_ws("-", c("doc_id").cast("string"), F.lpad(c("pos").cast("string"), 6, "0")).alias("chunk_id"), F.concat(F.lit("Section "), c("theme")).alias("heading"), c("text").alias("content"),
        "ticker", "theme", F.when(c("pos") == 1, 11).otherwise(4).alias("base"), (c("pos") > 2).alias("meaningful"))


_TOK = f"list_filter(list_distinct(string_split(trim(regexp_replace(lower({{x}}), '[^a-z0-9.+-]+', ' ', 'g')), ' ')), lambda w: length(w) > 1 AND NOT list_contains([{_STOPS}], w))"
_CH = """ch AS (SELECT CAST(p.doc_id AS VARCHAR) || '-' || lpad(CAST(pos AS VARCHAR), 6, '0') AS chunk_id, 'Section ' || lang AS heading, p.text AS content, upper(source) AS ticker, lang AS theme, CASE WHEN pos = 1 THEN 11 ELSE 4 END AS base, pos > 2 AS meaningful
 FROM v_paragraphs p JOIN documents d ON p.doc_id = d.doc_id)"""


def scored_sql(q: dict) -> str:
    lst = words(q)
    return f"""SELECT chunk_id, meaningful, CAST(base + CASE WHEN ticker = '{q['ticker']}' THEN 10 ELSE 0 END + CASE WHEN contains(lower(content), '{q['company'].lower()}') THEN 8 ELSE 0 END
 + CASE WHEN theme = '{q['theme']}' OR contains(lower(content), '{q['theme']}') THEN 4 ELSE 0 END + CASE WHEN contains(lower(content), 'layer {q['layer']}') THEN 5 ELSE 0 END + 5 * len(list_intersect({lst}, {_TOK.format(x='heading')}))
 + 2 * len(list_intersect({lst}, t)) + len(list_filter(list_intersect({lst}, t), lambda w: length(w) >= 6)) AS INTEGER) AS score FROM (SELECT *, {_TOK.format(x='content')} AS t FROM ch)"""


@query("X20_score_chunks", f"WITH {_CH} SELECT chunk_id, score FROM ({scored_sql(Q1)})")
def x20(v: Views):
    return R.score_chunks(chunks(v), Q1, GROUPS).select("chunk_id", "score")


@query("T06_top_chunks", f"WITH {_CH} SELECT chunk_id, score FROM ({scored_sql(Q1)}) ORDER BY score DESC, chunk_id LIMIT 10")
def t06(v: Views):
    return R.top_chunks(R.score_chunks(chunks(v), Q1, GROUPS)).select("chunk_id", "score")


_CTX = f"""ranked AS (SELECT * FROM (SELECT '{Q1['text']}' AS query, * FROM ({scored_sql(Q1)}) ORDER BY score DESC, chunk_id LIMIT 10) UNION ALL SELECT * FROM (SELECT '{Q2['text']}' AS query, * FROM ({scored_sql(Q2)}) ORDER BY score DESC, chunk_id LIMIT 10))"""


@query("V14_context_for_query", f"""
WITH {_CH}, {_CTX} SELECT r.query, chunk_id, score, m AS meaningful_count, m < 2 AS thin FROM ranked r JOIN (SELECT query, count(*) FILTER (meaningful) AS m FROM ranked GROUP BY query) USING (query)""")
def v14(v: Views):
    return R.context_for_queries(chunks(v), [Q1, Q2], groups=GROUPS).select("query", "chunk_id", "score", "meaningful_count", "thin")


@query("X25_thin_context", f"WITH {_CH}, {_CTX} SELECT query, count(*) FILTER (meaningful) < 2 AS thin FROM ranked GROUP BY query")
def x25(v: Views):
    return R.thin_context(R.top_chunks_of_queries(chunks(v), [Q1, Q2], groups=GROUPS))


def questions(v: Views):
    """The first words of every conversation as a question."""
    first = v.table("conversations").where("turn = 0").select("conv_id", "text")
    long_word = F.nullif(F.regexp_extract(F.lower("text"), "[a-z0-9.+-]{5,}", 0), F.lit(""))
    n = c("conv_id")
    theme = F.when(n % 4 == 0, "en").when(n % 4 == 1, "de").when(n % 4 == 2, "fr").otherwise("es")
    return first.select(n.alias("question_id"), "text", F.concat(F.lit("SRC"), (n % 7).cast("string")).alias("ticker"), F.coalesce(long_word, F.lit("none")).alias("company"),
                        theme.alias("theme"), (n % 3 + 1).alias("layer"))


_QS = f"""q0 AS (SELECT conv_id AS question_id, text, 'SRC' || conv_id % 7 AS qt, coalesce(nullif(regexp_extract(lower(text), '[a-z0-9.+-]{{5,}}', 0), ''), 'none') AS company, ['en', 'de', 'fr', 'es'][conv_id % 4 + 1] AS qm, conv_id % 3 + 1 AS layer FROM conversations WHERE turn = 0),
q1 AS (SELECT *, text || ' ' || qt || ' ' || company || ' ' || qm || ' layer ' || layer AS words FROM q0), q2 AS (SELECT *, {_TOK.format(x='words')} AS w0 FROM q1),
q3 AS (SELECT *, CASE WHEN list_has_any(w0, {GROUPS[0]}) THEN list_distinct(w0 || {GROUPS[0]}) ELSE w0 END AS w1 FROM q2), qs AS (SELECT *, CASE WHEN list_has_any(w1, {GROUPS[1]}) THEN list_distinct(w1 || {GROUPS[1]}) ELSE w1 END AS w FROM q3),
ct AS (SELECT *, {_TOK.format(x='content')} AS t, {_TOK.format(x='heading')} AS h, lower(content) AS low FROM ch),
sc AS (SELECT question_id, chunk_id, meaningful, CAST(base + CASE WHEN ticker = qt THEN 10 ELSE 0 END + CASE WHEN contains(low, company) THEN 8 ELSE 0 END + CASE WHEN theme = qm OR contains(low, qm) THEN 4 ELSE 0 END + CASE WHEN contains(low, 'layer ' || layer) THEN 5 ELSE 0 END
 + 5 * len(list_intersect(w, h)) + 2 * len(list_intersect(w, t)) + len(list_filter(list_intersect(w, t), lambda x: length(x) >= 6)) AS INTEGER) AS score FROM qs, ct),
tops AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS place FROM sc QUALIFY place <= 10)"""


@query("V14_context_for_questions", f"""
WITH {_CH}, {_QS} SELECT question_id, chunk_id, score, CAST(place AS INTEGER) AS place, count(*) FILTER (meaningful) OVER (PARTITION BY question_id) AS meaningful_count, count(*) FILTER (meaningful) OVER (PARTITION BY question_id) < 2 AS thin FROM tops""")
def v14_many(v: Views):
    ranked = I.with_thinness(I.context_for_questions(chunks(v), questions(v), groups=GROUPS))
    return ranked.select("question_id", "chunk_id", "score", "place", "meaningful_count", "thin")


def results(v: Views):
    """One payload of results per page: the page itself, then the same address with a slash."""
    base = v.table("pages").withColumn("u", F.regexp_replace(F.regexp_extract("url", r"^[^?#]*", 0), "/$", ""))
    title = F.concat(F.lit("Page "), "u")
    item = lambda url, score: F.struct(title.alias("title"), url.alias("url"), F.lit("earnings snippet").alias("content"), score.cast("double").alias("score"), F.lit("2024-01-15").alias("publishedDate"))
    return base.select(F.lit("q").alias("query"), F.array(item(c("u"), F.lit(None)), item(F.concat("u", F.lit("/")), F.lit(3.5))).alias("results"))


_RES = r"""
pg AS (SELECT page_id, html, u, 'Page ' || u AS title FROM (SELECT *, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '/$', '') AS u FROM pages)),
res AS (SELECT p AS pos, title, CASE p WHEN 0 THEN u ELSE u || '/' END AS url, 'earnings snippet' AS snippet, regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, CASE p WHEN 0 THEN 10.0 ELSE 3.5 END AS score, DATE '2024-01-15' AS published
 FROM pg, (VALUES (0), (1)) t(p))"""


@query("S21_read_search_results", f"WITH {_RES} SELECT CAST(pos AS INTEGER) AS pos, title, url, host, CAST(score AS DOUBLE) AS score, published FROM res")
def s21(v: Views):
    return search_results(results(v)).select("pos", "title", "url", "host", "score", "published")


@query("U06_distinct_by_url", f"WITH {_RES} SELECT DISTINCT rtrim(url, '/') || '/' AS url FROM res WHERE pos = 1")
def u06(v: Views):
    return R.distinct_by_url(search_results(results(v))).select("url")


_HAY = "lower(title || ' ' || snippet || ' ' || url)"
_W = [w for w in dict.fromkeys(R._tokens(Q1["text"])) if len(w) > 1 and w not in S.STOP_WORDS]
_XS = f"""
xs AS (SELECT *, CAST(score + CASE WHEN contains({_HAY}, 'src1') THEN 12 ELSE 0 END + CASE WHEN contains({_HAY}, 'hation') THEN 14 ELSE 0 END + CASE WHEN contains({_HAY}, 'en') THEN 3 ELSE 0 END + CASE WHEN contains({_HAY}, 'layer 2') THEN 2 ELSE 0 END
 + {" + ".join(f"CASE WHEN contains({_HAY}, '{w}') THEN {3 if len(w) >= 6 else 2} ELSE 0 END" for w in _W)} + CASE WHEN host = 'sec.gov' OR suffix(host, '.sec.gov') THEN 24 ELSE 0 END
 + CASE WHEN regexp_matches(lower(url), '(investor|investors|investor-relations|/ir/)') THEN 18 ELSE 0 END + CASE WHEN regexp_matches({_HAY}, '(earnings|results|quarter|10-q|10-k|8-k|transcript)') THEN 12 ELSE 0 END
 + CASE WHEN host = 'example.com' OR suffix(host, '.example.com') THEN 8 ELSE 0 END + 6 AS DOUBLE) AS total,
 CASE WHEN contains(host, 'hation') THEN 'official_company' WHEN host = 'example.com' OR suffix(host, '.example.com') THEN 'reputable_news' ELSE 'generic_web' END AS quality FROM res)"""
AS_OF = "2024-04-01"


def scored(v: Views):
    rows = R.score_results(search_results(results(v)), Q1, REPUTABLE, F.to_date(F.lit(AS_OF)))
    return rows.withColumn("quality", R.source_quality(c("host"), S.url_path(c("url")), F.concat_ws(" ", "title", "snippet", "url"), ["hation"], REPUTABLE))


@query("X21_score_results", f"WITH {_RES}, {_XS} SELECT url, total AS score FROM xs")
def x21(v: Views):
    return scored(v).select("url", "score")


@query("X22_source_quality", f"WITH {_RES}, {_XS} SELECT url, quality FROM xs")
def x22(v: Views):
    return scored(v).select("url", "quality")


_QR = "CASE quality WHEN 'official_company' THEN 1 WHEN 'reputable_news' THEN 4 WHEN 'generic_web' THEN 5 ELSE 6 END"


@query("T07_rank_web_results", f"WITH {_RES}, {_XS} SELECT url, quality, total AS score FROM xs ORDER BY {_QR}, total DESC, url LIMIT 15")
def t07(v: Views):
    return R.rank_web_results(scored(v)).select("url", "quality", "score")


@query("T08_merge_rank_chunks", f"""
WITH {_RES}, {_XS}, {_CH}, m AS (SELECT url AS chunk_id, quality, 0 AS pr, total AS score FROM xs WHERE page_ok UNION ALL SELECT chunk_id, 'local_context', CASE WHEN meaningful THEN 1 ELSE 0 END, CAST(score AS DOUBLE) FROM ({scored_sql(Q1)}))
SELECT chunk_id, quality, score FROM m ORDER BY {_QR}, CASE WHEN quality = 'local_context' THEN pr ELSE 0 END, score DESC, chunk_id LIMIT 18""".replace("WHERE page_ok", "WHERE quality = 'official_company'"))
def t08(v: Views):
    web = scored(v).where("quality = 'official_company'").select(c("url").alias("chunk_id"), "quality", F.lit(0).alias("local_priority"), "score")
    local = R.score_chunks(chunks(v), Q1, GROUPS).select("chunk_id", F.lit("local_context").alias("quality"), F.when(c("meaningful"), 1).otherwise(0).alias("local_priority"), c("score").cast("double").alias("score"))
    return R.merge_rank_chunks(web, local).select("chunk_id", "quality", "score")


_LINES = rf"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 45)"


@query("X23_relevant_lines", f"""
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(CAST(contains(lower(line), 'thorou') AS INTEGER) + CAST(contains(lower(line), 'nicht') AS INTEGER) AS INTEGER) AS hits FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, {_LINES} AS l FROM documents))""")
def x23(v: Views):
    return R.relevant_lines(v.table("documents"), "doc_id", ["thorou", "nicht"]).select("doc_id", "pos", "hits")


@query("X26_question_kinds", """
SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS analytical, o_orderpriority = '3-MEDIUM' AS current, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 3 ELSE 1 END AS queries FROM orders""")
def x26(v: Views):
    p = c("o_orderpriority")
    text = F.when(p == "1-URGENT", "What is the bull case?").when(p == "2-HIGH", "margin outlook").when(p == "3-MEDIUM", "What is the latest price").otherwise("Who runs it")
    queries = R.search_queries(F.lit("Acme"), F.lit("ACM"), text, F.lit("optics"), F.lit("2"))
    return v.table("orders").select("o_orderkey", R.is_analytical(text).alias("analytical"), R.asks_for_current(text).alias("current"), F.size(queries).alias("queries"))


@query("X29_record_chunks", """
WITH l AS (SELECT map_name, layer, count(*) AS n FROM v_universe GROUP BY ALL)
SELECT 'profile-' || ticker AS chunk_id, company || ' ( ' || ticker || ' ) in ' || layer || ' of ' || map_name || ' with ' || (n - 1) || ' peers' AS content FROM v_universe JOIN l USING (map_name, layer)
UNION ALL SELECT 'layer-' || map_name || '-' || layer, layer || ' of ' || map_name || ' lists ' || n || ' companies' FROM l""")
def x29(v: Views):
    return R.record_chunks(v.universe()).select("chunk_id", "content")


@query("V15_web_context", f"""
WITH {_RES}, {_XS}, best AS (SELECT url, quality, total FROM (SELECT DISTINCT url, quality, total FROM xs WHERE pos = 1) ORDER BY {_QR}, total DESC, url LIMIT 15), txt AS (SELECT u || '/' AS url, lower(max({READABLE_SQL})) AS t FROM pg GROUP BY u)
SELECT b.url, quality, total AS score, CAST({" + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in _W)} AS INTEGER) AS page_hits FROM best b LEFT JOIN txt USING (url)""")
def v15(v: Views):
    address = F.concat(F.regexp_replace(F.regexp_extract("url", r"^[^?#]*", 0), "/$", ""), F.lit("/"))
    texts = X.readable_text(v.table("pages").select(address.alias("url"), "html"))
    pages = texts.groupBy("url").agg(F.max("text").alias("text"))
    return R.web_context(search_results(results(v)), pages, Q1, REPUTABLE, F.to_date(F.lit(AS_OF))).select("url", "quality", "score", "page_hits")


def asked_results(v: Views):
    """The results of every page, found for one question each."""
    base = v.table("pages").withColumn("u", F.regexp_replace(F.regexp_extract("url", r"^[^?#]*", 0), "/$", ""))
    host = F.regexp_replace(F.lower(F.regexp_extract("u", r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")
    pos = F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")
    rows = base.select((c("page_id") % 50).alias("question_id"), F.concat(F.lit("Page "), "u").alias("title"), host.alias("host"), "u", pos)
    return rows.select("question_id", "pos", "title", "host", F.when(c("pos") == 0, c("u")).otherwise(F.concat("u", F.lit("/"))).alias("url"), F.lit("earnings snippet").alias("snippet"),
                       F.when(c("pos") == 0, 10.0).otherwise(3.5).alias("score"), F.to_date(F.lit("2024-01-15")).alias("published"))


_ASKED = _RES + rf""",
qw AS (SELECT *, {_TOK.format(x='text')} AS tw FROM q0), ar AS (SELECT DISTINCT page_id % 50 AS question_id, title, u || '/' AS url, 'earnings snippet' AS snippet, regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pg),
ax AS (SELECT *, lower(title || ' ' || snippet || ' ' || url) AS hay FROM ar),
aq AS (SELECT question_id, url, tw, CASE WHEN contains(host, company) AND length(company) >= 4 THEN 'official_company' WHEN host = 'example.com' OR suffix(host, '.example.com') THEN 'reputable_news' ELSE 'generic_web' END AS quality,
 CAST(3.5 + CASE WHEN contains(hay, lower(qt)) THEN 12 ELSE 0 END + CASE WHEN contains(hay, company) THEN 14 ELSE 0 END + CASE WHEN contains(hay, qm) THEN 3 ELSE 0 END + CASE WHEN contains(hay, 'layer ' || layer) THEN 2 ELSE 0 END
  + coalesce(list_sum(list_transform(list_filter(tw, lambda w: contains(hay, w)), lambda w: CASE WHEN length(w) >= 6 THEN 3 ELSE 2 END)), 0) + CASE WHEN host = 'sec.gov' OR suffix(host, '.sec.gov') THEN 24 ELSE 0 END
  + CASE WHEN regexp_matches(lower(url), '(investor|investors|investor-relations|/ir/)') THEN 18 ELSE 0 END + 12 + CASE WHEN host = 'example.com' OR suffix(host, '.example.com') THEN 8 ELSE 0 END
  + CASE WHEN regexp_matches(text, '{R.CURRENT}') THEN 6 ELSE 0 END AS DOUBLE) AS score FROM ax JOIN qw USING (question_id))"""


@query("V15_web_context_for_questions", f"""
WITH {_CH}, {_QS}, {_ASKED}, best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {_QR}, score DESC, url) AS place FROM aq QUALIFY place <= 15), txt AS (SELECT u || '/' AS url, lower(max({READABLE_SQL})) AS t FROM pg GROUP BY u)
SELECT question_id, b.url, CAST(place AS INTEGER) AS place, quality, score, CAST(len(list_filter(tw, lambda w: coalesce(contains(t, w), false))) AS INTEGER) AS page_hits FROM best b LEFT JOIN txt USING (url)""")
def v15_many(v: Views):
    address = F.concat(F.regexp_replace(F.regexp_extract("url", r"^[^?#]*", 0), "/$", ""), F.lit("/"))
    texts = X.readable_text(v.table("pages").select(address.alias("url"), "html"))
    pages = texts.groupBy("url").agg(F.max("text").alias("text"))
    out = I.web_contexts(asked_results(v), pages, questions(v), REPUTABLE, F.to_date(F.lit(AS_OF)))
    return out.select("question_id", "url", "place", "quality", "score", "page_hits")


@query("T08_merge_for_questions", f"""
WITH {_CH}, {_QS}, {_ASKED}, m AS (SELECT question_id, url AS chunk_id, quality, 0 AS pr, score FROM aq WHERE quality <> 'generic_web' UNION ALL SELECT question_id, chunk_id, 'local_context', CASE WHEN meaningful THEN 1 ELSE 0 END, CAST(score AS DOUBLE) FROM sc)
SELECT question_id, chunk_id, quality, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {_QR}, CASE WHEN quality = 'local_context' THEN pr ELSE 0 END, score DESC, chunk_id) AS place FROM m) WHERE place <= 18""")
def t08_many(v: Views):
    web = I.scored_results(asked_results(v), questions(v), REPUTABLE, F.to_date(F.lit(AS_OF))).where("quality <> 'generic_web'")
    web = web.select("question_id", c("url").alias("chunk_id"), "quality", F.lit(0).alias("local_priority"), "score")
    local = I.context_for_questions(chunks(v), questions(v), 18, GROUPS, plain_first=True).select(
        "question_id", "chunk_id", F.lit("local_context").alias("quality"), c("meaningful").cast("int").alias("local_priority"), c("score").cast("double").alias("score"))
    return I.merged_contexts(web, local).select("question_id", "chunk_id", "quality", "score", "place")
