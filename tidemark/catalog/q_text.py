"""Text queries: documents act as call texts, conversations as calls. Rules use words of the invented languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.q_functions import _NUM_SQL
from tidemark.catalog.registry import query
from tidemark.catalog.views import Views
from tidemark.operators import text as T

c = F.col
CUE = r"(?i)\b(the|und|les|que|of)\b"
RULES = [("alpha", r"(?i)\b(the|and)\b"), ("beta", r"(?i)tion"), ("gamma", r"(?i)\b(les|une)\b")]
_SPLIT = r"string_split(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '([.!?]) ([A-Z0-9])', '\1␞\2', 'g'), '␞')"
_SENT = (r"list_filter(list_transform(" + _SPLIT + r", lambda s: trim(s)), lambda s: length(s) > 45 AND length(s) < 360)")
SENT = f"sent AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM (SELECT doc_id, {_SENT.format(x='text')} AS l FROM documents))"
_ANS = (r"list_filter(list_transform(list_filter(list_transform(" + _SPLIT + r", lambda s: trim(s)), lambda s: length(s) > 20 AND length(s) < 900), "
        r"lambda s: trim(regexp_replace(regexp_replace(s, '(?i)^(yeah|yes|no|sure|okay|right|well|so|look|i mean|you know)[,. ]+', ''), '\s+,', ',', 'g'))), lambda s: s <> '' AND NOT regexp_matches(s, '"
        + T.NOT_USEFUL + "'))")


def sentences(v: Views):
    return T.sentence_rows(v.table("documents"), "doc_id")


@query("X09_sentences", f"WITH {SENT} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM sent")
def x09(v: Views):
    return sentences(v)


@query("X02_question_flags", rf"""
SELECT call_id, seq, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 25 AND (contains(text, '?') OR regexp_matches(text, '{CUE}')) AS question, role = 'Analyst - Northfield Research' AS analyst, replace(role, 'Analyst - ', '- ') AS firm FROM v_blocks""")
def x02(v: Views):
    return v.blocks().select("call_id", "seq", T.is_question(c("text"), CUE).alias("question"), T.is_analyst(c("role")).alias("analyst"), T.firm(c("role")).alias("firm"))


_QA = rf"""
q AS (SELECT *, role LIKE 'Analyst%' AND length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 25 AND (contains(text, '?') OR regexp_matches(text, '{CUE}')) AS ask, role LIKE 'Analyst%' AS ana FROM v_blocks),
st AS (SELECT call_id, min(seq) AS s0, bool_or(ask) AS has FROM q WHERE ana GROUP BY call_id),
n AS (SELECT q.*, sum(CASE WHEN ask AND has THEN 1 ELSE 0 END) OVER (PARTITION BY q.call_id ORDER BY seq) AS sequence, ask AND has AS isq FROM q JOIN st USING (call_id) WHERE seq >= s0),
parts AS (SELECT call_id, sequence, CASE WHEN isq THEN 'question' ELSE 'answer' END AS part, seq, text FROM n WHERE sequence > 0 AND (isq OR (NOT ana AND role <> 'Operator'))),
cnt AS (SELECT call_id, sequence, count(*) FILTER (part = 'answer') AS k FROM parts GROUP BY ALL),
bor AS (SELECT * FROM (SELECT call_id, sequence AS t, k, min(CASE WHEN k > 0 THEN sequence END) OVER (PARTITION BY call_id ORDER BY sequence ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM cnt) WHERE k = 0 AND f IS NOT NULL),
ex AS (SELECT * FROM parts UNION ALL SELECT p.call_id, b.t, p.part, p.seq, p.text FROM parts p JOIN bor b ON p.call_id = b.call_id AND p.sequence = b.f WHERE p.part = 'answer')"""


def exchanges(v: Views):
    return T.qa_exchanges(v.blocks(), CUE)


@query("X03_qa_exchanges", f"WITH {_QA} SELECT call_id, CAST(sequence AS BIGINT) AS sequence, part, seq, md5(text) AS text_md5 FROM ex")
def x03(v: Views):
    return exchanges(v).select("call_id", "sequence", "part", "seq", F.md5("text").alias("text_md5"))


@query("X04_answer_sentences", f"SELECT call_id, seq, array_to_string({_ANS.format(x='text')}, '|') AS sentences FROM v_blocks")
def x04(v: Views):
    return v.blocks().select("call_id", "seq", F.array_join(T.answer_sentences(c("text")), "|").alias("sentences"))


_TH = " ".join(f"+ CASE WHEN regexp_matches(sentence, '{p}') THEN 1 ELSE 0 END" for _, p in RULES)


@query("X05_sentence_themes", f"""
WITH {SENT} SELECT doc_id, CAST(pos AS INTEGER) AS pos, coalesce(nullif(concat_ws(',', {", ".join(f"CASE WHEN regexp_matches(sentence, '{p}') THEN '{n}' END" for n, p in RULES)}), ''), 'general') AS themes FROM sent""")
def x05(v: Views):
    return sentences(v).select("doc_id", "pos", F.array_join(T.sentence_themes(c("sentence"), RULES), ",").alias("themes"))


_SCORE = f"2 * (0 {_TH}) + CASE WHEN regexp_matches(sentence, '{T.HARD_DETAIL}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(sentence, '{T.ACTION}') THEN 2 ELSE 0 END + greatest(2 - pos, 0)"


@query("X06_sentence_score", f"WITH {SENT} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST({_SCORE} AS INTEGER) AS score FROM sent")
def x06(v: Views):
    return sentences(v).select("doc_id", "pos", T.sentence_score(c("sentence"), c("pos"), RULES).alias("score"))


@query("X07_coverage_sentences")
def x07(v: Views):
    return v.blocks().select("call_id", "seq", F.array_join(T.coverage_sentences(c("text"), 10, RULES), " ").alias("summary"))


@query("X08_answer_summary", f"""
SELECT call_id, seq, list_distinct(s) IS NOT NULL AS ok, CAST(len(list_distinct(s)) AS INTEGER) AS n FROM (SELECT call_id, seq, {_ANS.format(x='text')} AS s FROM v_blocks)""")
def x08(v: Views):
    rows = v.blocks().select("call_id", "seq", T.answer_summary(c("text")).alias("summary"))
    return rows.select("call_id", "seq", c("summary").isNotNull().alias("ok"), F.size(F.filter(F.split("summary", "; "), lambda x: x != "")).alias("n"))


PATTERNS = [r"(?i)\bthorou", r"(?i)tion\b", r"(?i)\bder\b"]


@query("X10_first_matching", f"""
WITH {SENT}, h AS (SELECT doc_id, sentence, CASE {" ".join(f"WHEN regexp_matches(sentence, '{p}') THEN {i}" for i, p in enumerate(PATTERNS))} END AS rule, pos FROM sent),
u AS (SELECT doc_id, sentence, min({{'r': rule, 'p': pos}}) AS k FROM h WHERE rule IS NOT NULL GROUP BY ALL)
SELECT doc_id, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rn FROM u) WHERE rn <= 4""")
def x10(v: Views):
    return T.first_matching(sentences(v), "doc_id", PATTERNS, 4).select("doc_id", "sentence")


GROUPS = [{"group": "Results", "limit": 3, "patterns": [r"(?i)tion\b", r"(?i)\bthe\b"], "exclude": r"(?i)\bof\b"},
          {"group": "Outlook", "limit": 2, "patterns": [r"(?i)\bund\b", r"(?i)\band\b"], "require": r"(?i)\b(by|der|with)\b"}]
SUBJECTS = [("First", r"(?i)\bwith\b"), ("Second", r"(?i)\bfor\b")]


@query("X11_takeaways", rf"""
WITH {SENT}, g AS (SELECT doc_id, pos, sentence, CASE WHEN regexp_matches(sentence, '{SUBJECTS[0][1]}') THEN 'First' WHEN regexp_matches(sentence, '{SUBJECTS[1][1]}') THEN 'Second' END AS subject, gp AS "group" FROM sent,
 (VALUES ('Results'), ('Outlook')) t(gp) WHERE CASE gp WHEN 'Results' THEN regexp_matches(sentence, '(?i)tion\b|\bthe\b') AND NOT regexp_matches(sentence, '(?i)\bof\b') ELSE regexp_matches(sentence, '(?i)\bund\b|\band\b') AND regexp_matches(sentence, '(?i)\b(by|der|with)\b') END),
u AS (SELECT doc_id, "group", coalesce(subject, "group") AS subject, lower(sentence) AS k, min(pos) AS pos, arg_min(sentence, pos) AS sentence FROM g GROUP BY ALL)
SELECT doc_id, "group", subject, sentence, CAST(item AS INTEGER) AS item FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, "group" ORDER BY pos) AS item FROM u) WHERE item <= CASE "group" WHEN 'Results' THEN 3 ELSE 2 END""")
def x11(v: Views):
    return T.takeaways(sentences(v), "doc_id", GROUPS, SUBJECTS).select("doc_id", "group", "subject", "sentence", "item")


TOPICS = [("A", r"(?i)(\bthe|and\b)"), ("B", r"(?i)(tion\b)"), ("C", r"(?i)(\bder|die|und\b)"), ("D", r"(?i)(\bles\b)")]


@query("X12_topics", f"""
SELECT doc_id, label, CAST(score AS INTEGER) AS score, CAST(item AS INTEGER) AS item FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rule) AS item FROM (
 SELECT doc_id, unnest({[n for n, _ in TOPICS]}) AS label, unnest([0, 1, 2, 3]) AS rule, unnest([{", ".join(f"len(regexp_extract_all(text, '{p}', 1))" for _, p in TOPICS)}]) AS score FROM documents) WHERE score > 0) WHERE item <= 2""")
def x12(v: Views):
    return T.topics(v.table("documents"), "doc_id", TOPICS, 2).select("doc_id", "label", "score", "item")


@query("T09_top_topics", f"""
SELECT lang, label, CAST(sum(score) AS BIGINT) AS hits FROM (SELECT lang, unnest({[n for n, _ in TOPICS]}) AS label, unnest([{", ".join(f"len(regexp_extract_all(text, '{p}', 1))" for _, p in TOPICS)}]) AS score FROM documents) WHERE score > 0 GROUP BY ALL""")
def t09(v: Views):
    rows = T.topics(v.table("documents"), "doc_id", TOPICS, 6).join(v.table("documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang", "label").agg(F.sum("score").cast("bigint").alias("hits"))


METRICS = [("Alpha", r"(?i)\bthorou"), ("Adjusted Beta", r"(?i)tion\b"), ("Gamma", r"(?i)\bden\b")]


@query("X13_guidance_metric", f"""
WITH {SENT} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN regexp_matches(sentence, '{METRICS[0][1]}') THEN 'GAAP Alpha' WHEN regexp_matches(sentence, '{METRICS[1][1]}') THEN 'Non-GAAP Adjusted Beta' WHEN regexp_matches(sentence, '{METRICS[2][1]}') THEN 'GAAP Gamma' END AS metric,
 CASE WHEN regexp_matches(sentence, '{T.QUARTERLY}') THEN 'quarterly' WHEN regexp_matches(sentence, '{T.ANNUAL}') THEN 'annual' ELSE 'outlook' END AS period, regexp_matches(sentence, '{T.HARD_NUMBER}') AS hard FROM sent""")
def x13(v: Views):
    s = c("sentence")
    return sentences(v).select("doc_id", "pos", T.guidance_metric(s, METRICS).alias("metric"), T.guidance_period(s).alias("period"), T.hard_number(s).alias("hard"))


HEADING, FWD = r"(?i)\bthatnd\b", r"(?i)\b(the|with|of)\b"


def guidance_rows(v: Views):
    """Sentences with a percentage put at their end, so that guidance rules have numbers to find."""
    return sentences(v).withColumn("sentence", F.concat("sentence", F.lit(" 12.5% for the "), F.when(c("pos") < 3, "quarter").otherwise("full year")))


_GUIDE = rf"""
gs AS (SELECT doc_id, pos, sentence || ' 12.5% for the ' || CASE WHEN pos < 3 THEN 'quarter' ELSE 'full year' END AS sentence FROM sent),
sc AS (SELECT g.* FROM gs g LEFT JOIN (SELECT doc_id, min(pos) AS s0 FROM gs WHERE regexp_matches(sentence, '{HEADING}') GROUP BY doc_id) h USING (doc_id) WHERE s0 IS NULL OR (pos >= s0 AND pos < s0 + 35)),
lb AS (SELECT *, CASE WHEN regexp_matches(sentence, '{METRICS[0][1]}') THEN 'GAAP Alpha' WHEN regexp_matches(sentence, '{METRICS[1][1]}') THEN 'Non-GAAP Adjusted Beta' WHEN regexp_matches(sentence, '{METRICS[2][1]}') THEN 'GAAP Gamma' END AS label FROM sc WHERE regexp_matches(sentence, '{FWD}')),
un AS (SELECT doc_id, label, lower(sentence) AS k, min(pos) AS pos, arg_min(sentence, pos) AS sentence FROM lb WHERE label IS NOT NULL GROUP BY ALL),
hg AS (SELECT *, CASE WHEN pos < 3 THEN 'quarterly' ELSE 'annual' END AS period FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, label) AS item FROM un) WHERE item <= 16)"""


def guidance(v: Views):
    return T.hard_guidance(guidance_rows(v), "doc_id", HEADING, FWD, METRICS)


@query("X14_hard_guidance", f"WITH {SENT}, {_GUIDE} SELECT doc_id, label, period, CAST(item AS INTEGER) AS item, sentence FROM hg")
def x14(v: Views):
    return guidance(v).select("doc_id", "label", "period", "item", "sentence")


@query("X15_guidance_groups", f"""
WITH {SENT}, {_GUIDE}, f AS (SELECT * FROM hg WHERE label = 'GAAP Alpha'), t AS (SELECT * FROM hg WHERE label <> 'GAAP Alpha' AND (doc_id, period) NOT IN (SELECT doc_id, period FROM f)), b AS (SELECT *, 'FILING' AS source FROM f UNION ALL SELECT *, 'TRANSCRIPT' FROM t)
SELECT doc_id, period, source, label, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, period ORDER BY pos, label, sentence) AS rn FROM b) WHERE rn <= 10""")
def x15(v: Views):
    items = guidance(v).drop("item")
    return T.guidance_groups(items.where("label = 'GAAP Alpha'"), items.where("label <> 'GAAP Alpha'"), "doc_id").select("doc_id", "period", "source", "label", "sentence")


_EV = rf"""
rec AS (SELECT doc_id, pos, CASE WHEN pos <= 2 THEN 'Filing' ELSE 'Transcript' END AS source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM v_paragraphs),
ev AS (SELECT doc_id, source, min(pos) AS pos, arg_min(text, pos) AS text FROM rec WHERE length(text) >= 18 GROUP BY doc_id, source, lower(text))"""


@query("X16_evidence", f"""
WITH {_EV} SELECT doc_id, 'E' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS evidence_id, source, pos, text, array_to_string({_NUM_SQL.format(x='text')}, '|') AS numbers FROM ev""")
def x16(v: Views):
    records = v.paragraphs().withColumn("source", F.when(c("pos") <= 2, "Filing").otherwise("Transcript"))
    return T.evidence(records, "doc_id").select("doc_id", "evidence_id", "source", "pos", "text", F.array_join("numbers", "|").alias("numbers"))


@query("T10_first_n_per_key", f"WITH {_EV} SELECT doc_id, 'E' || rn AS evidence_id, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, source) AS rn FROM ev) WHERE rn <= 5")
def t10(v: Views):
    records = v.paragraphs().withColumn("source", F.when(c("pos") <= 2, "Filing").otherwise("Transcript"))
    return T.evidence(records, "doc_id", cap=5).select("doc_id", "evidence_id", "text")


_STOPS = ",".join(f"'{w}'" for w in T.EVIDENCE_STOPS)
_TERMS = r"list_filter(list_distinct(string_split(regexp_replace(lower(trim(regexp_replace({x}, '\s+', ' ', 'g'))), '[^a-z0-9.-]+', ' ', 'g'), ' ')), lambda w: length(w) >= 4 AND NOT list_contains([" + _STOPS + "], w))"


def claims(v: Views):
    """Each second and later paragraph as a claim on the paragraph before it in the same document."""
    p = v.paragraphs()
    cited = p.select("doc_id", (c("pos") + 1).alias("pos"), c("text").alias("cited"))
    return p.join(cited, ["doc_id", "pos"])


@query("X17_claim_support", f"""
SELECT p.doc_id, p.pos, len(list_filter({_NUM_SQL.format(x='p.text')}, lambda n: NOT list_contains({_NUM_SQL.format(x='q.text')}, n))) = 0
 AND (len(a) = 0 OR len(list_intersect(a, b)) >= least(2, len(a))) AS supported
FROM v_paragraphs p JOIN v_paragraphs q ON p.doc_id = q.doc_id AND p.pos = q.pos + 1, LATERAL (SELECT {_TERMS.format(x='p.text')} AS a, {_TERMS.format(x='q.text')} AS b)""")
def x17(v: Views):
    return T.support_of_previous(v.paragraphs(), "doc_id", "pos").select("doc_id", "pos", "supported")


_SIG = r"array_to_string(list_filter(string_split(regexp_replace(lower(trim(regexp_replace({x}, '\s+', ' ', 'g'))), '[^a-z0-9%$]+', ' ', 'g'), ' '), lambda w: w <> '')[1:14], ' ')"


@query("X18_dedupe_items", f"""
SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, sig ORDER BY pos) AS rn FROM (SELECT doc_id, pos, {_SIG.format(x='text')} AS sig FROM v_paragraphs) WHERE sig <> '') WHERE rn = 1""")
def x18(v: Views):
    return T.dedupe_items(v.paragraphs(), "doc_id").select("doc_id", "pos")


@query("X19_answer_block_covered", f"""
SELECT p.doc_id, p.pos, len(a) = 0 OR len(list_intersect(a, b)) >= least(3, len(a)) AS covered FROM v_paragraphs p JOIN v_paragraphs q ON p.doc_id = q.doc_id AND p.pos = q.pos + 1,
 LATERAL (SELECT list_filter({_TERMS.format(x='p.text')}, lambda w: NOT regexp_matches(w, '^[0-9]')) AS a, list_filter({_TERMS.format(x='q.text')}, lambda w: NOT regexp_matches(w, '^[0-9]')) AS b)""")
def x19(v: Views):
    return claims(v).select("doc_id", "pos", T.answer_covered(c("text"), c("cited")).alias("covered"))


@query("U08_not_covered_guidance", f"""
WITH t AS (SELECT doc_id, pos, text, {_NUM_SQL.format(x='text')} AS n, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS low FROM v_paragraphs), g AS (SELECT * FROM t WHERE pos <= 3), f AS (SELECT * FROM t WHERE pos > 3)
SELECT doc_id, pos FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = f.doc_id AND CASE WHEN len(f.n) > 0 THEN len(list_filter(f.n, lambda x: NOT list_contains(g.n, x))) = 0 ELSE g.low = f.low END)""")
def u08(v: Views):
    p = v.paragraphs()
    return T.not_covered_guidance(p.where("pos <= 3"), p.where("pos > 3"), "doc_id").select("doc_id", "pos")


@query("X28_validated_groups")
def x28(v: Views):
    draft = claims(v).withColumn("group", F.when(c("pos") < 6, "Results").otherwise("Outlook"))
    fallback = v.paragraphs().where("pos <= 2").withColumn("group", F.when(c("pos") == 1, "Results").otherwise("Outlook"))
    return T.validated_groups(draft.select("doc_id", "group", "pos", "text", "cited"), fallback.select("doc_id", "group", "pos", "text"), "doc_id").select("doc_id", "group", "pos", "origin")


@query("J24_exchange_with_analysis", f"""
WITH {_QA},
points AS (SELECT call_id, sequence, string_agg(text, '; ' ORDER BY seq, text) AS points FROM ex WHERE part = 'answer' GROUP BY ALL)
SELECT call_id, CAST(sequence AS BIGINT) AS sequence, coalesce(points, text) AS summary FROM ex LEFT JOIN points USING (call_id, sequence) WHERE part = 'question'""")
def j24(v: Views):
    # a question that no answer follows keeps its summary
    summaries = exchanges(v).where("part = 'question'").select("call_id", "sequence", c("text").alias("summary"))
    points = exchanges(v).where("part = 'answer'").select("call_id", "sequence", c("seq").alias("pos"), c("text").alias("point"))
    return T.exchange_with_analysis(summaries, points)


@query("X24_clean_answer", r"""
SELECT conv_id, turn, trim(replace(text, chr(10) || ' ', chr(10))) IS NOT NULL AS ok, CASE turn WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE 'Medium' END AS confidence, text AS cleaned FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+([,.;:!?])', '\1', 'g'), '(^|\n)\s*[,;:]\s*', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), '\n[ \t]+', chr(10), 'g')) AS text FROM conversations)""")
def x24(v: Views):
    noisy = F.concat(F.lit("According to the retrieved context "), "text", F.lit(" [C 1, 2]"))
    level = F.when(c("turn") == 0, "Confidence: high").when(c("turn") == 1, "confidence : LOW").otherwise("")
    return v.table("conversations").select("conv_id", "turn", T.clean_answer(noisy).isNotNull().alias("ok"), T.confidence(F.concat("text", F.lit("\n"), level)).alias("confidence"),
                                           T.clean_answer(noisy).alias("cleaned"))


@query("X27_qa_fallback", rf"""
WITH tail AS (SELECT doc_id AS call_id, substr(text, CAST(floor(length(text) * 0.55) AS INTEGER) + 1) AS text FROM documents),
s AS (SELECT call_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM (SELECT call_id, {_SENT.format(x='text')} AS l FROM tail)),
h AS (SELECT call_id, sentence, CASE {" ".join(f"WHEN regexp_matches(sentence, '{p}') THEN {i}" for i, p in enumerate(PATTERNS))} END AS rule, pos FROM s),
u AS (SELECT call_id, sentence, min({{'r': rule, 'p': pos}}) AS k FROM h WHERE rule IS NOT NULL GROUP BY ALL)
SELECT call_id, sentence FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY k) AS rn FROM u) WHERE rn <= 4""")
def x27(v: Views):
    return T.qa_fallback(v.table("documents").select(c("doc_id").alias("call_id"), "text"), PATTERNS).select("call_id", "sentence")


@query("X01_blocks", """
SELECT call_id, CAST(row_number() OVER (PARTITION BY call_id ORDER BY seq) - 1 AS INTEGER) AS seq, speaker, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM v_blocks WHERE NOT contains(text, '<') AND NOT contains(text, '&')""")
def x01(v: Views):
    card = F.concat(F.lit('<div class="border-t x"><div class="text-lg font-bold a">'), "speaker", F.lit('</div><div class="text-sm italic text-muted">'), "role",
                    F.lit('</div><p class="a text-default">'), "text", F.lit("</p></div>"))
    # one page per call; a page holds the turns of a single conversation
    rows = v.blocks().where("NOT contains(text, '<') AND NOT contains(text, '&')").select("call_id", F.struct("seq", card.alias("card")).alias("x"))
    pages = rows.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["card"]), "\n").alias("html"))
    return T.card_blocks(pages)


@query("W18_budgeted_select", r"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) >= 45) AS lines FROM documents),
s AS (SELECT doc_id, list_sort(list_transform(range(1, len(lines) + 1), lambda i: {'score': -len(regexp_extract_all(lines[i], '(?i)the')), 'pos': i, 'line': lines[i]})) AS ranked FROM l),
k AS (SELECT doc_id, list_reduce(list_transform(ranked, lambda x: {'used': 0, 'score': x.score, 'kept': [{'pos': x.pos, 'line': x.line}]}), lambda acc, x:
  CASE WHEN (x.score < 0 OR len(acc.kept) < 2) AND acc.used + length(x.kept[1].line) <= 1200 THEN {'used': (acc.used + length(x.kept[1].line) + 1)::INTEGER, 'score': acc.score, 'kept': acc.kept || x.kept} ELSE acc END,
  {'used': 0, 'score': 0, 'kept': CAST([] AS STRUCT(pos BIGINT, line VARCHAR)[])}).kept AS kept FROM s)
SELECT doc_id, array_to_string(list_transform(list_sort(kept), lambda x: x.line), chr(10)) AS chunk FROM k""")
def w18(v: Views):
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 45), lambda x, i: F.named_struct(
        F.lit("score"), -F.size(F.regexp_extract_all(x, F.lit("(?i)(the)"), F.lit(1))), F.lit("pos"), i, F.lit("line"), x))
    return v.table("documents").select("doc_id", T.budgeted_select(lines, 1200).alias("chunk"))


@query("W19_recent_messages", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE trim(text) <> ''),
l AS (SELECT *, 1500 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY back ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r WHERE back <= 4)
SELECT conv_id, turn, CASE WHEN length(text) > room THEN right(text, CAST(room AS INTEGER)) ELSE text END AS text FROM l WHERE room > 0""")
def w19(v: Views):
    return T.recent_messages(v.table("conversations").select("conv_id", "turn", "text"), 4, 1500)


@query("W20_chunk_text", r"""
WITH p AS (SELECT doc_id, list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: [x]) AS parts FROM documents),
k AS (SELECT doc_id, list_filter(list_reduce(parts, lambda acc, x: CASE WHEN length(acc[-1]) + length(x[1]) + 1 <= 1050 THEN acc[1:len(acc) - 1] || [acc[-1] || ' ' || x[1]] ELSE acc || x END), lambda x: x <> '') AS chunks FROM p)
SELECT doc_id, unnest(range(len(chunks)))::INTEGER AS chunk_index, unnest(chunks) AS content FROM k""")
def w20(v: Views):
    chunks = v.table("documents").select("doc_id", F.posexplode(T.chunk_text(c("text"), 1050)).alias("chunk_index", "content"))
    return chunks


def cards(v: Views):
    return v.filings().select("ticker", c("accession").alias("card_id"), F.concat(F.lit("Q"), F.quarter("filing_date").cast("string"), F.lit(" "), F.year("filing_date").cast("string")).alias("label"),
                              F.when(c("form").startswith("10-Q"), "quarter").otherwise("other").alias("type"), c("filing_date").alias("day"), "primary_document")


@query("T11_select_call", """
SELECT ticker, card_id FROM (SELECT ticker, accession AS card_id, row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN lower('q' || quarter(filing_date) || '-' || year(filing_date)) = 'q2-1998' THEN 0 WHEN form LIKE '10-Q%' THEN 1 ELSE 2 END, filing_date DESC, accession) AS rn FROM v_filings) WHERE rn = 1""")
def t11(v: Views):
    return T.select_call(cards(v), "q2-1998").select("ticker", "card_id")


@query("U07_unique_calendar_periods", """
SELECT ticker, calendar_label, card_id FROM (SELECT ticker, 'Q' || quarter(filing_date) || ' ' || year(filing_date) AS calendar_label, accession AS card_id, row_number() OVER (PARTITION BY ticker, quarter(filing_date), year(filing_date) ORDER BY filing_date DESC, accession) AS rn FROM v_filings) WHERE rn = 1""")
def u07(v: Views):
    return T.unique_calendar_periods(cards(v).withColumnRenamed("label", "calendar_label")).select("ticker", "calendar_label", "card_id")


@query("S23_read_transcripts", """
SELECT ticker, accession AS card_id, length(repeat('x', CAST(o_orderkey AS INTEGER) % 900) || 'Full Transcript body ') - instr(repeat('x', CAST(o_orderkey AS INTEGER) % 900) || 'Full Transcript body ', 'Full') + 1 + 390 AS n_chars
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, accession) AS rn FROM v_filings WHERE form LIKE '10-Q%') WHERE rn <= 2""")
def s23(v: Views):
    text = F.concat(F.repeat(F.lit("x"), (c("o_orderkey") % 900).cast("int")), F.lit("Full Transcript body "), F.lit("y" * 390))
    rows = v.filings().select("ticker", c("accession").alias("card_id"), F.when(c("form").startswith("10-Q"), "quarter").otherwise("other").alias("type"), c("filing_date").alias("day"), text.alias("text"))
    return T.read_transcripts(rows, 2).select("ticker", "card_id", F.length("text").cast("bigint").alias("n_chars"))


@query("S20_read_transcript_cards", """
SELECT ticker, 0 AS pos, 'https://calls.example.org/transcripts/' || accession || '/' AS url, 'Earnings Call: Q' || quarter(filing_date) || ' ' || year(filing_date) AS title, 'Q' || quarter(filing_date) || ' ' || year(filing_date) AS quarter FROM v_filings""")
def s20(v: Views):
    link = F.concat(F.lit('<a class="x" href="/transcripts/'), c("card_id"), F.lit('/"><b>Earnings Call: '), c("label"), F.lit("</b></a>"))
    # every page lists its call twice
    return T.transcript_cards(cards(v).select("ticker", F.concat(link, link).alias("html")), "https://calls.example.org")


REQUIRED = ["Overview", "Risks", "Peers"]


def context_sections(v: Views):
    from tidemark.sources.readers import sections

    body = F.concat(F.lit("# "), "c_name", F.lit("\n## Overview\n"), F.when(c("c_mktsegment") == "BUILDING", "TBD").otherwise(c("c_mktsegment")), F.lit("\n## Risks\n"),
                    F.when(c("c_mktsegment") == "MACHINERY", "").otherwise("none known"), F.when(c("c_mktsegment") != "FURNITURE", "\n## Peers\nsome").otherwise("\n## Risks\nagain"))
    return sections(v.table("customer").select(F.concat("c_name", F.lit(".md")).alias("file"), body.alias("text")))


@query("S19_read_sections", """
SELECT c_name || '.md' AS file, h AS heading, CAST(CASE WHEN h = c_name THEN 1 ELSE 2 END AS INTEGER) AS level FROM (SELECT c_name, unnest([c_name, 'Overview', 'Risks', CASE WHEN c_mktsegment <> 'FURNITURE' THEN 'Peers' ELSE 'Risks' END]) AS h FROM customer)""")
def s19(v: Views):
    return context_sections(v).select("file", "heading", "level")


@query("Q18_context_file_check", """
SELECT c_name || '.md' AS file, CASE c_mktsegment WHEN 'BUILDING' THEN 'Overview' WHEN 'MACHINERY' THEN 'Risks' ELSE h END AS heading, CASE c_mktsegment WHEN 'BUILDING' THEN 'PLACEHOLDER' WHEN 'MACHINERY' THEN 'EMPTY' ELSE i END AS issue
FROM customer LEFT JOIN (VALUES ('FURNITURE', 'Peers', 'MISSING'), ('FURNITURE', 'Risks', 'DUPLICATE')) t(s, h, i) ON s = c_mktsegment WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')""")
def q18(v: Views):
    return T.context_file_check(context_sections(v), REQUIRED)


@query("Q19_commentary_audit")
def q19(v: Views):
    items = claims(v).withColumn("group", F.when(c("pos") < 6, "Results").otherwise("Outlook"))
    return T.commentary_audit(items, "doc_id")


@query("Q20_answer_quality", r"""
SELECT item_id, CAST(n AS INTEGER) AS words, concat_ws(',', CASE WHEN n < 20 THEN 'TOO_SHORT' END, CASE WHEN n > 40 THEN 'TOO_LONG' END, CASE WHEN regexp_matches(text, '(?i)\bthat\b') THEN 'BANNED_that' END, CASE WHEN NOT regexp_matches(text, '(?i)\bwith\b') THEN 'MISSING_with' END) AS failures
FROM (SELECT *, len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '')) AS n FROM benchmark)""")
def q20(v: Views):
    out = T.answer_quality(v.table("benchmark"), [("that", r"(?i)\bthat\b")], [("with", r"(?i)\bwith\b")], 20, 40)
    return out.select("item_id", "words", F.array_join("failures", ",").alias("failures"))


