"""Calls, guidance and evidence: sentences, questions and answers, rule tables and support checks.

Rules are (label, pattern) tables given as parameters; the defaults are finance terms. Sentences stay rows of
their document, and every cap is a rank filter, so long documents and large calls spread over tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import strings as S
from tidemark.operators.keyed import once, running_sum, top_n_per_key

BOUNDARY = r"(?<=[.!?])\s+(?=[A-Z0-9])"

# Question cues, sentence themes, guidance metrics and topics.
QUESTION_CUE = (r"(?i)\b(wondering|can you|could you|would you|how do|how should|what is|what are|what's|when do|where do|why|talk about|"
                r"help us understand|give us|provide|update us|color on)\b")
THEMES = [
    ("timing", r"(?i)\blag|latency|quarter|month|later|timing|produced|ship|shipment|ramp|transition\b"),
    ("financial", r"(?i)\brevenue|growth|margin|gross margin|operating margin|earnings|profit|cash|ASP|EPS\b"),
    ("guidance", r"(?i)\bguidance|outlook|expect|forecast|target|plan|fiscal|calendar\b"),
    ("demand", r"(?i)\bdemand|orders?|backlog|customer|bookings|visibility|LTA|agreement\b"),
    ("supply", r"(?i)\bcapacity|supply|inventory|utilization|wafer|fab|production|yield|capex|investment\b"),
    ("technology", r"(?i)\bAI|data center|photonics|optical|indium phosphide|InP|transceiver|laser|CPO|OCS|800G|1\.6T\b"),
    ("competitive", r"(?i)\bcompetitive|differentiat|share|competitor|alternative|qualification|reliability|power\b"),
]
HARD_DETAIL = r"(?i)\$|\d|%|\b(first|second|third|next|prior|current|fiscal|calendar|quarter|month|year|basis points?|bps|million|billion)\b"
ACTION = r"(?i)\b(expect|expects|expected|continue|drive|driven|ramp|ship|produce|qualif|convert|translate|improve|increase|reduce|support|enable)\b"
NOT_USEFUL = (r"(?i)^(thanks|thank you|got it|great|okay|sure|yep|yeah|yes|no|oh,?\s+yeah|all right|appreciate it|good question)\.?$"
              r"|\b(back to you|next question|your line is open|can you hear me)\b")
GUIDANCE_METRICS = [
    ("Net Revenue", r"(?i)\bnet revenue\b"), ("Revenue", r"(?i)\brevenue|sales\b"),
    ("Adjusted EBITDA", r"(?i)\badjusted ebitda|adj\.?\s*ebitda|non-gaap ebitda|ebitda\b"),
    ("Adjusted EBIT", r"(?i)\badjusted ebit\b|adj\.?\s*ebit\b|non-gaap ebit\b"), ("Operating Income / EBIT", r"(?i)\boperating income|EBIT\b"),
    ("Net Income", r"(?i)\bnet income|net earnings\b"), ("EPS", r"(?i)\bEPS|earnings per share|net income per diluted share|diluted net income per share\b"),
    ("Gross Margin", r"(?i)\bgross margin\b"), ("Operating Margin", r"(?i)\boperating margin\b"), ("Operating Expenses", r"(?i)\boperating expenses?|opex\b"),
    ("Free Cash Flow", r"(?i)\bfree cash flow|cash flow\b"), ("CapEx", r"(?i)\bcapex|capital expenditures?\b"),
    ("Diluted Shares Outstanding", r"(?i)\bdiluted shares|shares outstanding|share count\b"),
]
QUARTERLY = (r"(?i)\b(next|current|coming)?\s*(first|second|third|fourth)\s+quarter\b|\bq[1-4]\b|\bfor the quarter\b|\bquarterly\b|\bmarch quarter\b|"
             r"\bjune quarter\b|\bseptember quarter\b|\bdecember quarter\b")
ANNUAL = r"(?i)\bfull year\b|\bfiscal year\b|\bfiscal 20\d{2}\b|\bfy\s?20?\d{2}\b|\bcalendar year\b|\bannual\b"
HARD_NUMBER = r"(?i)\$\s?\d[\d,.]*(?:\s?(?:million|billion|m|bn))?|\b\d+(?:\.\d+)?\s*%|\b\d[\d,.]*\s?(?:million|billion|shares)\b"
FORWARD = r"(?i)\bexpected|expects|projected|forecast|guidance|outlook|between|range|approximately|target\b"
OUTLOOK_HEADING = r"(?i)\bbusiness outlook|guidance and outlook|financial outlook|quarter.*outlook|annual guidance|quarterly guidance\b"
TOPICS = [
    ("AI Infrastructure", r"(?i)(\bAI|artificial intelligence|data center|accelerator\b)"), ("Photonics-SOI", r"(?i)(\bphotonics|silicon photonics|optical|optics\b)"),
    ("Inventory Correction", r"(?i)(\binventory|destocking|correction\b)"), ("Margins / Fab Loading", r"(?i)(\bmargin|fab loading|utilization|gross margin\b)"),
    ("Free Cash Flow", r"(?i)(\bcash flow|liquidity|working capital|balance sheet\b)"), ("Guidance / Outlook", r"(?i)(\bguidance|outlook|expect|forecast|target\b)"),
    ("Customer Demand", r"(?i)(\bdemand|customer|order|bookings|backlog\b)"), ("CapEx Discipline", r"(?i)(\bcapex|capital expenditure|investment|capacity\b)"),
    ("Mobile / RF-SOI", r"(?i)(\bmobile|smartphone|RF-SOI|RFSOI|radio frequency\b)"), ("Power / SiC", r"(?i)(\bpower|SiC|silicon carbide|EV\b)"),
    ("Indium Phosphide", r"(?i)(\bindium phosphide|InP\b)"), ("Cost Control", r"(?i)(\bcost|opex|restructuring|efficiency\b)"),
]
# Words too common to support a claim.
EVIDENCE_STOPS = [
    "about", "after", "again", "against", "also", "and", "because", "been", "being", "between", "company", "could", "from", "into", "investor",
    "investors", "more", "quarter", "revenue", "said", "that", "their", "there", "these", "they", "this", "through", "under", "with", "would",
]


#: Lengths between which sentences are read for guidance.
GUIDANCE_LOW, GUIDANCE_HIGH = 35, 520


def sentences(text: Column, low: int = 45, high: int = 360) -> Column:
    """Sentences longer than ``low`` and shorter than ``high`` characters."""
    parts = F.transform(F.split(S.normalize_ws(text), BOUNDARY), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (F.length(s) > low) & (F.length(s) < high))


def sentence_rows(df: DataFrame, key: str, column: str = "text", low: int = 45, high: int = 360) -> DataFrame:
    return df.select(key, F.posexplode(sentences(F.col(column), low, high)).alias("pos", "sentence"))


def is_question(text: Column, cue: str = QUESTION_CUE) -> Column:
    plain = S.normalize_ws(text)
    return (F.length(plain) >= 25) & ~plain.rlike(S.rx(r"(?i)\bcan you hear me|hear me now|you hear me\b")) & (plain.contains("?") | plain.rlike(S.rx(cue)))


def is_analyst(role: Column) -> Column:
    return F.coalesce(role.rlike(S.rx(r"(?i)\banalyst\b")), F.lit(False))


def firm(role: Column) -> Column:
    parts = F.filter(F.transform(F.split(role, ","), lambda p: F.trim(p)), lambda p: p != "")
    return (
        F.when(F.coalesce(role, F.lit("")) == "", "").when(role.rlike(S.rx("(?i)investor relations")), "Pre-submitted investor question")
        .when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.trim(F.regexp_replace(role, r"(?i)^Analyst,?\s*", ""))))


def card_blocks(pages: DataFrame) -> DataFrame:
    """Transcript page to speaker blocks in order. Columns: call_id, html."""
    parts = F.split("html", r'(?i)<div class="border-t[^"]*"')
    rows = pages.select("call_id", F.posexplode(parts).alias("seq", "block")).where("seq > 0").withColumn("seq", F.col("seq") - 1)
    grab = lambda pattern: S.strip_html(F.regexp_extract("block", pattern, 1))
    paragraphs = F.regexp_extract_all("block", F.lit(r'(?is)<p class="[^"]*\btext-default\b[^"]*"[^>]*>(.*?)</p>'), F.lit(1))
    body = F.when(F.size(paragraphs) > 0, S.strip_html(F.array_join(paragraphs, " "))).otherwise(grab(r"(?is)<p[^>]*>(.*?)</p>"))
    return rows.select("call_id", "seq", grab(r'(?is)<div class="text-lg font-bold[^"]*">(.*?)</div>').alias("speaker"),
                       grab(r'(?is)<div class="text-sm italic text-muted">(.*?)</div>').alias("role"), body.alias("text")).where("speaker <> '' AND text <> ''")


# Wording that opens the questions and closes the call.
QNA_START = r"(?i)q&a|question-and-answer|questions and answers|open the call|first question|next question|begin the question"
CLOSING = r"(?i)\b(?:thank you,\s*operator|thanks everybody for joining|that concludes today's call)\b.*"


def qa_exchanges(blocks: DataFrame, cue: str = QUESTION_CUE) -> DataFrame:
    """Question and answer blocks of every call: one row per block with its exchange number and part.

    A question without answers takes those of the next exchange that has some.
    """
    c = F.col
    relations = F.coalesce(c("role").rlike(S.rx("(?i)investor relations")), F.lit(False))
    operator = F.lower("speaker") == "operator"
    asks = is_question(c("text"), cue)
    rows = once(blocks, {
        "__analyst": is_analyst(c("role")), "__ir": relations, "__operator": operator, "__asks": asks,
        "__opens": operator & c("text").rlike(S.rx(QNA_START)), "__submits": relations & c("text").rlike(S.rx("(?i)submitted questions|submit questions|questions ahead of time"))})
    starts = rows.groupBy("call_id").agg(F.coalesce(
        F.min(F.when(c("__opens"), c("seq"))), F.min(F.when(c("__submits"), c("seq"))), F.min(F.when(c("__analyst"), c("seq")))).alias("__start"),
    ).where("__start IS NOT NULL")
    inside = rows.join(starts, "call_id").where("seq >= __start")
    kinds = inside.groupBy("call_id").agg(F.bool_or(c("__analyst") & c("__asks")).alias("__has_analyst"))
    marked = inside.join(kinds, "call_id").withColumn("__question", F.when(c("__has_analyst"), c("__analyst") & c("__asks")).otherwise(c("__ir") & c("__asks")))
    numbered = running_sum(marked, ["call_id"], "seq", c("__question").cast("int"), "sequence").where("sequence > 0")
    answer = ~c("__question") & ~c("__operator") & ~c("__analyst") & ~c("__ir") & (c("text") != "")
    parts = numbered.withColumn("part", F.when(c("__question"), "question").when(answer, "answer")).where("part IS NOT NULL").select(
        "call_id", "sequence", "part", "seq", "speaker", "role", "text")
    counts = parts.groupBy("call_id", "sequence").agg(F.count_if(c("part") == "answer").alias("n"))
    later = Window.partitionBy("call_id").orderBy("sequence").rowsBetween(1, Window.unboundedFollowing)
    borrowed = counts.withColumn("__from", F.min(F.when(c("n") > 0, c("sequence"))).over(later)).where("n = 0 AND __from IS NOT NULL").select(
        "call_id", c("sequence").alias("__to"), c("__from").alias("sequence"))
    extra = parts.where("part = 'answer'").join(borrowed, ["call_id", "sequence"]).withColumn("sequence", c("__to")).drop("__to")
    last = counts.groupBy("call_id").agg(F.max("sequence").alias("__last"))
    whole = parts.unionByName(extra).join(last, "call_id")
    cut = F.when((c("part") == "answer") & (c("sequence") == c("__last")), F.trim(F.regexp_replace("text", f"(?s){CLOSING}", ""))).otherwise(c("text"))
    return whole.withColumn("text", cut).where("text <> ''").drop("__last")


def answer_sentences(text: Column) -> Column:
    """Useful sentences of an answer with filler words cut."""
    parts = F.filter(F.transform(F.split(S.normalize_ws(text), BOUNDARY), lambda s: F.trim(s)), lambda s: (F.length(s) > 20) & (F.length(s) < 900))
    cut = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"(?i)^(yeah|yes|no|sure|okay|right|well|so|look|i mean|you know)[,. ]+", ""), r"\s+,", ","))
    return F.filter(F.transform(parts, cut), lambda s: (s != "") & ~s.rlike(S.rx(NOT_USEFUL)))


def sentence_themes(sentence: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    found = F.array_compact(F.array(*[F.when(sentence.rlike(S.rx(p)), name) for name, p in (rules or THEMES)]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def sentence_score(sentence: Column, position: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    themes = F.array_compact(F.array(*[F.when(sentence.rlike(S.rx(p)), name) for name, p in (rules or THEMES)]))
    return (F.size(themes) * 2 + F.when(sentence.rlike(S.rx(HARD_DETAIL)), 2).otherwise(0) + F.when(sentence.rlike(S.rx(ACTION)), 2).otherwise(0)
            + F.greatest(F.lit(2) - position, F.lit(0)))


def coverage_sentences(text: Column, limit: int = 10, rules: list[tuple[str, str]] | None = None, least: int = 6) -> Column:
    """Sentences of an answer in reading order: the first, the first that scores, ranked ones with a new theme or hard detail,
    then from the front until there are ``least``, and the last; at most ``limit``. Up to eight are all kept."""
    items = F.transform(answer_sentences(text), lambda s, i: F.named_struct(
        F.lit("score"), -sentence_score(s, i, rules), F.lit("pos"), i, F.lit("sentence"), s, F.lit("themes"), sentence_themes(s, rules)))
    empty = F.slice(items, 1, 0)
    has = lambda chosen, x: F.exists(chosen, lambda y: y["sentence"] == x["sentence"])
    add = lambda chosen, x: F.when(has(chosen, x), chosen).otherwise(F.concat(chosen, F.array(x)))
    first = F.slice(items, 1, 1)
    scored = F.slice(F.filter(items, lambda x: x["score"] < 0), 1, 1)
    start = F.aggregate(F.concat(first, scored), empty, add)
    novel = lambda chosen, x: F.size(F.array_except(x["themes"], F.flatten(F.transform(chosen, lambda y: y["themes"])))) > 0
    wanted = lambda chosen, x: (F.size(chosen) < limit) & ((x["score"] <= -6) | x["sentence"].rlike(S.rx(HARD_DETAIL)) | novel(chosen, x))
    # what is chosen never exceeds the limit, so a step costs the same however long the answer
    ranked = F.aggregate(F.array_sort(items), start, lambda acc, x: F.when(wanted(acc, x), add(acc, x)).otherwise(acc))
    filled = F.aggregate(F.slice(items, 1, least + limit), ranked, lambda acc, x: F.when(F.size(acc) < least, add(acc, x)).otherwise(acc))
    chosen = F.aggregate(F.slice(items, -1, 1), filled, add)
    kept = F.when(F.size(items) <= 8, items).otherwise(chosen)
    ordered = F.array_sort(F.transform(kept, lambda x: F.named_struct(F.lit("pos"), x["pos"], F.lit("s"), x["sentence"])))
    return F.slice(F.transform(ordered, lambda x: x["s"]), 1, limit)


def answer_summary(text: Column) -> Column:
    """Useful sentences of one turn, each once, joined."""
    return F.array_join(F.array_distinct(answer_sentences(text)), "; ")


def first_matching(rows: DataFrame, key: str, patterns: list[str], n: int) -> DataFrame:
    """First sentences that fit, pattern by pattern in order of the text, each sentence once."""
    hit = F.array_compact(F.array(*[F.when(F.col("sentence").rlike(S.rx(p)), i) for i, p in enumerate(patterns)]))
    ranked = once(rows, {"rule": F.array_min(hit)}).where("rule IS NOT NULL")
    each = ranked.groupBy(key, "sentence").agg(F.min(F.struct("rule", "pos")).alias("r"))
    return top_n_per_key(each.select(key, "sentence", "r.rule", "r.pos"), [key], [F.col("rule"), F.col("pos")], n)


def takeaways(rows: DataFrame, key: str, groups: list[dict], subjects: list[tuple[str, str]]) -> DataFrame:
    """Sentences per group: any of its patterns, none of its exclusions, capped; the subject is the first rule that fits."""
    c = F.col
    subject = F.lit(None).cast("string")
    for name, pattern in reversed(subjects):
        subject = F.when(c("sentence").rlike(S.rx(pattern)), name).otherwise(subject)
    fits = lambda g: c("sentence").rlike(S.rx("|".join(f"(?:{p})" for p in g["patterns"]))) & (
        c("sentence").rlike(S.rx(g["require"])) if g.get("require") else F.lit(True)) & (~c("sentence").rlike(S.rx(g["exclude"])) if g.get("exclude") else F.lit(True))
    matched = F.array_compact(F.array(*[F.when(fits(g), F.struct(F.lit(i).alias("group_pos"), F.lit(g["group"]).alias("group"), F.lit(g["limit"]).alias("cap"))) for i, g in enumerate(groups)]))
    spread = once(rows, {"subject": subject, "groups": matched}).select(key, "pos", "sentence", "subject", F.inline("groups"))
    named = spread.withColumn("subject", F.coalesce("subject", "group"))
    unique = named.groupBy(key, "group", "subject", F.sha2(F.lower("sentence"), 256).alias("__k")).agg(
        F.min(F.struct("pos", "sentence")).alias("r"), F.max("cap").alias("cap"))
    ranked = top_n_per_key(unique.select(key, "group", "subject", "cap", "r.pos", "r.sentence"), [key, "group"], [c("pos")], max(g["limit"] for g in groups), rank="item")
    return ranked.where("item <= cap").drop("cap")


def topics(documents: DataFrame, key: str, rules: list[tuple[str, str]] | None = None, n: int = 6) -> DataFrame:
    """Themes by number of matches in the whole text, best ``n`` per call."""
    counts = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(name).alias("label"), F.regexp_count("text", F.lit(S.rx(p))).alias("score"))
                       for i, (name, p) in enumerate(rules or TOPICS)])
    rows = documents.select(key, F.inline(counts)).where("score > 0")
    return top_n_per_key(rows, [key], [F.desc("score"), F.col("rule")], n, rank="item")


def guidance_metric(sentence: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Accounting basis and metric a guidance sentence speaks of."""
    metric = F.lit(None).cast("string")
    for name, pattern in reversed(rules or GUIDANCE_METRICS):
        metric = F.when(sentence.rlike(S.rx(pattern)), name).otherwise(metric)
    basis = F.when(sentence.rlike(S.rx(r"(?i)\bnon-gaap\b|\badjusted\b")) | metric.rlike(S.rx(r"^Adjusted\b")), "Non-GAAP").when(metric.isNotNull(), "GAAP")
    return F.when(metric.isNotNull(), F.concat_ws(" ", basis, metric))


def guidance_period(sentence: Column) -> Column:
    return F.when(sentence.rlike(S.rx(QUARTERLY)), "quarterly").when(sentence.rlike(S.rx(ANNUAL)), "annual").otherwise("outlook")


def hard_number(sentence: Column) -> Column:
    return sentence.rlike(S.rx(HARD_NUMBER))


def hard_guidance(rows: DataFrame, key: str, heading: str = OUTLOOK_HEADING, forward: str = FORWARD, rules=None, span: int = 35, n: int = 16) -> DataFrame:
    """Sentences with a metric, a number and forward wording, from the outlook heading on when there is one."""
    c = F.col
    starts = rows.where(c("sentence").rlike(S.rx(heading))).groupBy(key).agg(F.min("pos").alias("__start"))
    scoped = rows.join(starts, key, "left").where("__start IS NULL OR (pos >= __start AND pos < __start + %d)" % span)
    labelled = once(scoped, {"label": guidance_metric(c("sentence"), rules)})
    hits = labelled.where(c("label").isNotNull() & hard_number(c("sentence")) & c("sentence").rlike(S.rx(forward)) & ~c("sentence").rlike(S.rx(r"(?i)\btax rate\b")))
    unique = hits.groupBy(key, "label", F.sha2(F.lower("sentence"), 256).alias("__k")).agg(F.min(F.struct("pos", "sentence")).alias("r"))
    best = top_n_per_key(unique.select(key, "label", "r.pos", "r.sentence"), [key], [c("pos"), c("label")], n, rank="item")
    return best.withColumn("period", guidance_period(c("sentence")))


def guidance_groups(filing: DataFrame, transcript: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Filing items of a period before transcript items; transcript items only where the filing has none."""
    has = filing.select(key, "period").distinct()
    rest = transcript.join(has, [key, "period"], "left_anti")
    both = filing.withColumn("source", F.lit("FILING")).unionByName(rest.withColumn("source", F.lit("TRANSCRIPT")))
    return top_n_per_key(both, [key, "period"], [F.col("pos"), F.col("label"), F.col("sentence")], n, rank="item")


def evidence(records: DataFrame, key: str, cap: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Distinct evidence texts per source with an id, their numbers and accounting basis. Columns: pos, source, text."""
    text = S.normalize_ws(F.col("text"))
    text = text if max_chars is None else F.left(text, F.lit(max_chars))
    rows = records.withColumn("text", text).where(F.length("text") >= 18)
    unique = rows.groupBy(key, "source", F.lower("text").alias("__k")).agg(F.min(F.struct("pos", "text")).alias("r")).select(key, "source", "r.pos", "r.text")
    numbered = running_sum(unique, [key], "pos", F.lit(1), "__n") if cap is None else top_n_per_key(unique, [key], [F.col("pos"), F.col("source")], cap, rank="__n")
    return numbered.select(key, F.concat(F.lit("E"), F.col("__n").cast("string")).alias("evidence_id"), "source", "pos", "text",
                           S.number_tokens(F.col("text")).alias("numbers"), S.accounting_basis(F.col("text")).alias("basis"))


def evidence_terms(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(S.normalize_ws(text)), r"[^a-z0-9.-]+", " "), " ")
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 4), F.array(*[F.lit(w) for w in EVIDENCE_STOPS]))


def support_features(text: Column) -> Column:
    """What a text brings as a claim or as its evidence: terms, numbers and accounting wording."""
    return F.struct(
        evidence_terms(text).alias("terms"), S.number_tokens(text).alias("numbers"), S.accounting_basis(text).alias("basis"),
        text.rlike(S.rx(r"(?i)\bEPS|earnings per share|gross margin|operating margin|operating income|EBITDA|EBIT|net income\b")).alias("labelled"),
        text.rlike(S.rx(r"(?i)\bnon-gaap\b|\badjusted\b")).alias("adjusted"), text.rlike(S.rx(r"(?i)\bgaap\b")).alias("gaap"))


def is_supported(claim: Column, cited: Column) -> Column:
    """No number in the claim beyond those cited, enough shared terms, the accounting label kept; of two ``support_features``."""
    n = F.size(claim["terms"])
    numbers = F.size(F.array_except(claim["numbers"], cited["numbers"])) == 0
    enough = (n == 0) | (F.size(F.array_intersect(claim["terms"], cited["terms"])) >= F.least(F.lit(2), n))
    missing = claim["labelled"] & F.when(cited["basis"] == "non-GAAP", ~claim["adjusted"]).when(cited["basis"] == "GAAP", ~claim["gaap"]).otherwise(F.lit(False))
    return numbers & enough & ~missing


def with_support(df: DataFrame) -> DataFrame:
    """Add ``supported``: whether ``text`` holds by what it ``cited``."""
    rows = once(df, {"__claim": support_features(F.col("text")), "__cited": support_features(F.col("cited"))})
    return once(rows, {"supported": is_supported(F.col("__claim"), F.col("__cited"))}).select(*df.columns, "supported")


def support_of_previous(paragraphs: DataFrame, key: str, pos: str) -> DataFrame:
    """Paragraphs with one right before them, each as a claim on that one; every paragraph's features are found once, behind the one
    exchange that brings a document together."""
    placed = once(paragraphs.repartition(key), {"__own": support_features(F.col("text"))})
    w = Window.partitionBy(key).orderBy(pos)
    before = placed.withColumns({"__cited": F.lag("__own").over(w), "__at": F.lag(pos).over(w)}).where(F.col("__at") == F.col(pos) - 1)
    return before.withColumn("supported", is_supported(F.col("__own"), F.col("__cited"))).drop("__own", "__cited", "__at")


def signature(text: Column, words: int = 14) -> Column:
    # no more of a text is read than its first words
    head = F.regexp_extract(F.lower(text), f"(?s)^[^a-z0-9%$]*+(?:[a-z0-9%$]++[^a-z0-9%$]*+){{0,{words}}}", 0)
    return F.trim(F.regexp_replace(head, r"[^a-z0-9%$]+", " "))


def dedupe_items(items: DataFrame, key: str) -> DataFrame:
    """First item of each signature of fourteen words."""
    rows = once(items, {"__s": signature(F.col("text"))}).where("__s <> ''")
    return top_n_per_key(rows, [key, "__s"], [F.col("pos")]).drop("__s")


def answer_covered(block: Column, points: Column) -> Column:
    """At least three of the terms of a block (or all of fewer) appear in the points."""
    words = lambda t: F.filter(evidence_terms(t), lambda w: ~w.rlike(S.rx(r"^\d")))
    own = words(block)
    return (F.size(own) == 0) | (F.size(F.array_intersect(own, words(points))) >= F.least(F.lit(3), F.size(own)))


def not_covered_guidance(generated: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Fallback items whose numbers no generated item holds; items without numbers are compared by text."""
    numbered = lambda df: df.withColumn("__numbers", S.number_tokens(F.col("text")))
    left = numbered(fallback).withColumn("__token", F.when(F.size("__numbers") > 0, F.get("__numbers", F.lit(0))).otherwise(F.lower(S.normalize_ws(F.col("text")))))
    right = numbered(generated).select(F.col(key).alias("__key"), F.col("__numbers").alias("__have"), F.explode(F.array_append("__numbers", F.lower(S.normalize_ws(F.col("text"))))).alias("__have_token"))
    covered = (left[key] == right["__key"]) & (left["__token"] == right["__have_token"]) & (F.size(F.array_except("__numbers", "__have")) == 0)
    return left.join(right, covered, "left_anti").drop("__numbers", "__token")


def validated_groups(draft: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Supported draft items per group, else the fallback items of the group. ``draft`` has cited text per item."""
    good = dedupe_items(with_support(draft).where("supported").drop("supported").withColumn("__g", F.concat_ws("|", key, "group")), "__g").drop("__g", "cited")
    both = good.withColumn("origin", F.lit("DRAFT")).unionByName(fallback.withColumn("origin", F.lit("FALLBACK")))
    # support is found once: a group is known by its own rows, not by a join with them
    drafted = F.count_if(F.col("origin") == "DRAFT").over(Window.partitionBy(key, "group")) > 0
    return both.withColumn("__drafted", drafted & F.col(key).isNotNull() & F.col("group").isNotNull()).where("origin = 'DRAFT' OR NOT __drafted").drop("__drafted")


def exchange_with_analysis(exchanges: DataFrame, analyses: DataFrame) -> DataFrame:
    """Exchanges with the points of their analysis, the plain summary where there is none."""
    points = analyses.groupBy("call_id", "sequence").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "point"))), lambda x: x["point"]), "; ").alias("points"))
    joined = exchanges.join(points, ["call_id", "sequence"], "left")
    return joined.withColumn("summary", F.coalesce("points", "summary")).drop("points")


def qa_fallback(calls: DataFrame, patterns: list[str], marker: str = r"(?i)q&a session|open the q&a|question-and-answer|questions and answers", n: int = 4) -> DataFrame:
    """Sentences after the question marker (or the last 45 % of the text) for calls without exchanges."""
    at = F.regexp_instr("text", F.lit(S.rx(marker)))
    start = F.when(at > 0, at).otherwise(F.floor(F.length("text") * 0.55) + 1).cast("int")
    tail = calls.withColumn("text", F.substr("text", start))
    return first_matching(sentence_rows(tail, "call_id"), "call_id", patterns, n)


def recent_messages(messages: DataFrame, count: int = 8, total: int = 6000) -> DataFrame:
    """Last messages of a conversation, cut from the newest backwards to a total length."""
    c = F.col
    recent = top_n_per_key(messages.where(F.trim("text") != ""), ["conv_id"], [F.desc("turn")], count, rank="back")
    newer = Window.partitionBy("conv_id").orderBy("back").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(total) - F.coalesce(F.sum(F.length("text")).over(newer), F.lit(0))
    room = recent.withColumn("__left", left).where("__left > 0")
    return room.withColumn("text", F.when(F.length("text") > c("__left"), F.right("text", c("__left"))).otherwise(c("text"))).drop("__left", "back")


def chunk_text(text: Column, size: int = 1050) -> Column:
    """Greedy packing of sentences into chunks of at most ``size`` characters, one linear pass per text over Arrow batches."""

    @F.pandas_udf("array<string>")
    def pack(batch: pd.Series) -> pd.Series:
        def chunks(parts):
            out, held, length = [], [], 0
            for part in parts:
                if held and length + len(part) + 1 > size:
                    out.append(" ".join(held))
                    held, length = [], 0
                length += len(part) + (1 if held else 0)
                held.append(part)
            return [x for x in [*out, " ".join(held)] if x]

        return batch.map(lambda parts: None if parts is None else chunks(parts))

    return pack(F.split(S.normalize_ws(text), r"(?<=[.!?])\s+"))


def budgeted_select(lines: Column, budget: int) -> Column:
    """Ranked lines (score, pos, line) taken while their length fits, back in text order."""
    ranked = F.array_sort(lines)
    start = F.named_struct(F.lit("used"), F.lit(0), F.lit("kept"), F.slice(lines, 1, 0))
    step = lambda acc, x: F.when(
        ((x["score"] < 0) | (F.size(acc["kept"]) < 2)) & (acc["used"] + F.length(x["line"]) <= budget),
        F.named_struct(F.lit("used"), acc["used"] + F.length(x["line"]) + 1, F.lit("kept"), F.concat(acc["kept"], F.array(x)))).otherwise(acc)
    kept = F.aggregate(ranked, start, step)["kept"]
    ordered = F.array_sort(F.transform(kept, lambda x: F.named_struct(F.lit("pos"), x["pos"], F.lit("line"), x["line"])))
    return F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")


def select_call(cards: DataFrame, wanted: str | None = None) -> DataFrame:
    """Requested card by id or quarter label, else the newest quarterly one, else the newest."""
    c = F.col
    hit = F.lit(False) if wanted is None else ((F.lower("card_id") == wanted.lower()) | (F.lower(F.regexp_replace("label", r"\s+", "-")) == wanted.lower()))
    rank = F.when(hit, 0).when(c("type") == "quarter", 1).otherwise(2)
    return top_n_per_key(cards, ["ticker"], [rank, F.desc("day"), c("card_id")])


def read_transcripts(pages: DataFrame, n: int = 8, marker: str = "Full Transcript", minimum: int = 400) -> DataFrame:
    """Newest quarterly calls per ticker with their text from the marker on, long ones only."""
    recent = top_n_per_key(pages.where("type = 'quarter'"), ["ticker"], [F.desc("day"), F.col("card_id")], n)
    at = F.locate(marker, F.col("text"))
    text = F.when(at > 0, F.substr("text", at)).otherwise(F.col("text"))
    return recent.withColumn("text", text).where(F.length("text") >= minimum)


def transcript_cards(pages: DataFrame, base: str) -> DataFrame:
    """Call list page (ticker, html) to one row per linked call, first of each address."""
    anchors = pages.select("ticker", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?is)(<a\b[^>]*href="[^"]*transcripts/[^"]+"[^>]*>.*?</a>)'), F.lit(1))).alias("pos", "a"))
    url = F.concat(F.lit(base), F.regexp_extract("a", r'href="([^"]+)"', 1))
    title = S.strip_html(F.col("a"))
    rows = anchors.select("ticker", "pos", url.alias("url"), title.alias("title"), F.regexp_extract(title, r"(?i)\b([QH][1-4] \d{4})\b", 1).alias("quarter"))
    return top_n_per_key(rows, ["ticker", "url"], [F.col("pos")])


def unique_calendar_periods(cards: DataFrame) -> DataFrame:
    return top_n_per_key(cards, ["ticker", "calendar_label"], [F.desc("day"), F.col("card_id")])


def context_file_check(sections: DataFrame, required: list[str], placeholder: str = r"(?i)\b(todo|tbd|placeholder|to be added)\b") -> DataFrame:
    """Missing, duplicate, empty and placeholder headings of each file."""
    c = F.col
    counts = sections.where("level = 2").groupBy("file", "heading").agg(
        F.count("*").alias("n"), F.max(F.length("content")).alias("chars"), F.bool_or(c("content").rlike(S.rx(placeholder))).alias("stub"))
    wanted = sections.select("file").distinct().select("file", F.explode(F.array(*[F.lit(h) for h in required])).alias("heading"))
    joined = wanted.join(counts, ["file", "heading"], "full")
    issue = F.when(c("n").isNull(), "MISSING").when(c("n") > 1, "DUPLICATE").when(c("chars") == 0, "EMPTY").when(c("stub"), "PLACEHOLDER")
    return joined.withColumn("issue", issue).where("issue IS NOT NULL").select("file", "heading", "issue")


def commentary_audit(items: DataFrame, key: str) -> DataFrame:
    """Checks of a commentary: number support, duplicates, empty groups. Columns: group, text, cited."""
    c = F.col
    # whole texts count as repeats, not their first words
    marked = once(with_support(items), {"sig": F.sha2(F.lower(S.normalize_ws(c("text"))), 256)})
    per_sig = marked.groupBy(key, "group", "sig").agg(F.count("*").alias("n"), F.bool_and("supported").alias("supported"))
    return per_sig.groupBy(key).agg(F.bool_and("supported").alias("numbers_supported"), F.bool_and(c("n") == 1).alias("no_duplicates"),
                                    F.count_distinct("group").alias("groups"), F.sum("n").alias("items"))


def answer_quality(texts: DataFrame, banned: list[tuple[str, str]], required: list[tuple[str, str]], low: int, high: int) -> DataFrame:
    """Rules an answer breaks: length, banned wording, missing channels."""
    c = F.col
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    rules = [F.when(words < low, "TOO_SHORT"), F.when(words > high, "TOO_LONG")]
    rules += [F.when(c("text").rlike(S.rx(p)), f"BANNED_{name}") for name, p in banned] + [F.when(~c("text").rlike(S.rx(p)), f"MISSING_{name}") for name, p in required]
    return texts.withColumns({"words": words, "failures": F.array_compact(F.array(*rules))})


# Wording removed from or replaced in an answer.
CLEANING = [
    (r"(?i)\baccording to\s+(?:the\s+)?(?:retrieved\s+)?context\s*", ""), (r"(?i)\bPrivate research material\b\s*:?\s*", ""),
    (r"(?i)\bResearch section\b\s*:?\s*", ""), (r"(?i)\s*,?\s+as mentioned in (?:the )?research material", ""),
    (r"(?i)\b(?:the\s+)?retrieved context\b", "the available information"), (r"(?i)\bcontext chunks?\b", "source material"),
    (r"(?i)\bprovided context\b", "available evidence"), (r"(?i)\[(?:C\s*)?\d+(?:\s*[,–-]\s*(?:C\s*)?\d+)*\]", ""),
    (r"[ \t]+([,.;:!?])", "$1"), (r"(^|\n)\s*[,;:]\s*", "$1"), (r"[ \t]{2,}", " "), (r"\n[ \t]+", "\n"),
]


def clean_answer(text: Column) -> Column:
    for pattern, replacement in CLEANING:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


def confidence(text: Column, default: str = "Medium") -> Column:
    found = F.regexp_extract(text, r"(?i)confidence\s*:\s*(high|medium|low)", 1)
    return F.when(found != "", F.initcap(found)).otherwise(default)
