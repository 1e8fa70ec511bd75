"""Relevance of context chunks and search results for questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import strings as S
from tidemark.operators.keyed import once, top_n_per_key

# Order of source classes, and hosts of reputable news.
QUALITY_ORDER = ["official_company", "sec", "transcript", "reputable_news", "generic_web", "local_context"]
ANALYTICAL = (r"(?i)\b(bull|bear|thesis|break|risk|downside|upside|chokepoint|bottleneck|catalyst|debate|valuation|multiple|estimate|margin|earnings|outlook|"
              r"guidance|competition|alternative|scenario|sensitivity|what\s+would)\b")
CURRENT = r"(?i)\b(latest|current|today|recent|new|this quarter|this year|now)\b"


def _token_score(content: Column, tokens: Column, hit: int) -> Column:
    """Points of shared tokens: three for six letters or more, else two; or a flat number."""
    shared = F.array_intersect(tokens, content)
    if hit:
        return F.size(shared) * hit
    return F.size(shared) * 2 + F.size(F.filter(shared, lambda t: F.length(t) >= 6))


def _folded(chunks: DataFrame) -> DataFrame:
    """Chunks with the tokens of content and heading and the content in lower case."""
    c = F.col
    return once(chunks, {"__c": S.tokenize(c("content")), "__h": S.tokenize(c("heading")), "__low": F.lower("content")})


def _score(question: dict, groups: list[list[str]] | None) -> Column:
    """Score of a folded chunk for one question."""
    c = F.col
    words = [w for w in _tokens(" ".join(str(question.get(k, "")) for k in ("text", "ticker", "company", "theme")) + f" layer {question['layer']}") if w not in S.STOP_WORDS]
    for group in S.SYNONYM_GROUPS if groups is None else groups:
        if any(w in words for w in group):
            words += [w for w in group if w not in words]
    tokens = F.array(*[F.lit(w) for w in dict.fromkeys(words)]).cast("array<string>")
    bonus = lambda condition, points: F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)
    return (
        F.coalesce("base", F.lit(0)) + bonus(F.upper("ticker") == question["ticker"], 10) + bonus(c("__low").contains(question["company"].lower()), 8)
        + bonus((c("theme") == question["theme"]) | c("__low").contains(question["theme"]), 4) + bonus(c("__low").contains(f"layer {question['layer']}"), 5)
        + _token_score(c("__h"), tokens, 5) + _token_score(c("__c"), tokens, 0))


def score_chunks(chunks: DataFrame, question: dict, groups: list[list[str]] | None = None) -> DataFrame:
    """Score of every chunk for one question. Chunks: chunk_id, heading, content, ticker, theme, base."""
    return _folded(chunks).withColumn("score", _score(question, groups)).drop("__c", "__h", "__low")


def _tokens(text: str) -> list[str]:
    return "".join(ch if ch.isascii() and (ch.isalnum() or ch in ".+-") else " " for ch in text.lower()).split()


def top_chunks(scored: DataFrame, n: int = 10) -> DataFrame:
    return scored.orderBy(F.desc("score"), "chunk_id").limit(n)


def top_chunks_of_queries(chunks: DataFrame, questions: list[dict], n: int = 10, groups: list[list[str]] | None = None) -> DataFrame:
    """(query, chunk_id, score, meaningful) of the best chunks of a few questions; chunks are read and folded once for all of them."""
    each = F.array(*[F.struct(F.lit(q["text"]).alias("query"), _score(q, groups).alias("score")) for q in questions])
    scored = _folded(chunks).select("chunk_id", "meaningful", F.inline(each))
    return top_n_per_key(scored, ["query"], [F.desc("score"), F.col("chunk_id")], n)


def context_for_queries(chunks: DataFrame, questions: list[dict], n: int = 10, groups: list[list[str]] | None = None) -> DataFrame:
    """Best chunks of each question with the number of meaningful ones among them."""
    rows = top_chunks_of_queries(chunks, questions, n, groups)
    rows = rows.withColumn("meaningful_count", F.count_if(F.col("meaningful")).over(Window.partitionBy("query")))
    return rows.withColumn("thin", F.col("meaningful_count") < 2)


def thin_context(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("query").agg((F.count_if(F.col("meaningful")) < 2).alias("thin"))


def source_quality(host: Column, path: Column, text: Column, company_tokens: list[str], reputable: list[str], regulator: str = "sec.gov") -> Column:
    """Class of a result by host, path and wording, first match wins."""
    under = lambda name: (host == name) | host.endswith(f".{name}")
    own = reduce(lambda a, b: a | b, [host.contains(t) for t in company_tokens], F.lit(False))
    news = reduce(lambda a, b: a | b, [under(d) for d in reputable], F.lit(False))
    relations = host.rlike(S.rx(r"^(investor|investors)\.")) | path.rlike(S.rx(r"/(investor-relations|investors?|ir)(/|$)"))
    return (
        F.when(under(regulator), "sec").when(relations | own, "official_company").when(text.rlike(S.rx(r"(?i)\b(transcript|earnings call|conference call)\b")), "transcript")
        .when(news, "reputable_news").otherwise("generic_web"))


def quality_rank(quality: Column) -> Column:
    return F.array_position(F.array(*[F.lit(q) for q in QUALITY_ORDER]), quality)


def score_results(results: DataFrame, question: dict, reputable: list[str], as_of: Column, regulator: str = "sec.gov") -> DataFrame:
    """Score of search results for one question. Columns: title, url, snippet, host, score, published."""
    c = F.col
    words = [w for w in dict.fromkeys(_tokens(question["text"])) if len(w) > 1 and w not in S.STOP_WORDS]
    rows = once(results, {"__hay": F.lower(F.concat_ws(" ", "title", "snippet", "url")), "__url": F.lower("url")})
    bonus = lambda condition, points: F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)
    has = lambda text: c("__hay").contains(text.lower())
    under = lambda name: (c("host") == name) | c("host").endswith(f".{name}")
    score = c("score") + bonus(has(question["ticker"]), 12) + bonus(has(question["company"]), 14) + bonus(has(question["theme"]), 3) + bonus(has(f"layer {question['layer']}"), 2)
    for word in words:
        score = score + bonus(has(word), 3 if len(word) >= 6 else 2)
    news = reduce(lambda a, b: a | b, [under(d) for d in reputable], F.lit(False))
    score = score + bonus(under(regulator), 24) + bonus(c("__url").rlike(S.rx(r"(investor|investors|investor-relations|/ir/)")), 18)
    score = score + bonus(c("__hay").rlike(S.rx(r"(earnings|results|quarter|10-q|10-k|8-k|transcript)")), 12) + bonus(news, 8)
    import re

    if re.search(CURRENT, question["text"]):
        age = F.greatest(F.datediff(as_of, "published"), F.lit(0))
        score = score + F.when(age <= 45, 10).when(age <= 180, 6).when(age <= 730, 2).otherwise(0)
    return rows.withColumn("score", score.cast("double")).drop("__hay", "__url")


def rank_web_results(scored: DataFrame, n: int = 15) -> DataFrame:
    return scored.orderBy(quality_rank(F.col("quality")), F.desc("score"), "url").limit(n)


def merge_rank_chunks(web: DataFrame, local: DataFrame, n: int = 18) -> DataFrame:
    """Web and local chunks by quality, local ones by kind, then by score."""
    both = web.unionByName(local)
    kind = F.when(F.col("quality") == "local_context", F.col("local_priority")).otherwise(0)
    return both.orderBy(quality_rank(F.col("quality")), kind, F.desc("score"), "chunk_id").limit(n)


def distinct_by_url(results: DataFrame) -> DataFrame:
    """One result per address without its trailing slash; the last one stays."""
    rows = results.withColumn("url_key", F.regexp_replace("url", "/$", ""))
    return top_n_per_key(rows, ["url_key"], [F.desc("pos")]).drop("url_key")


def relevant_lines(pages: DataFrame, key: str, words: list[str], minimum: int = 45) -> DataFrame:
    """Lines of a page with the number of question words in each."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) >= minimum)
    rows = pages.select(key, F.posexplode(lines).alias("pos", "line"))
    hits = reduce(lambda a, b: a + b, [F.lower("line").contains(w).cast("int") for w in words])
    return rows.withColumn("hits", hits)


def is_analytical(question: Column) -> Column:
    return question.rlike(S.rx(ANALYTICAL))


def asks_for_current(question: Column) -> Column:
    return question.rlike(S.rx(CURRENT))


def search_queries(company: Column, ticker: Column, question: Column, theme: Column, layer: Column) -> Column:
    """Primary query and, for analytical questions, two more."""
    quoted = F.concat(F.lit('"'), company, F.lit('"'))
    keys = F.array_join(F.slice(S.tokenize(question), 1, 10), " ")
    primary = F.concat_ws(" ", quoted, ticker, question, theme, F.concat(F.lit("Layer "), layer), keys)
    more = F.array(F.concat_ws(" ", quoted, ticker, F.lit("investor relations earnings release 10-Q 8-K")),
                   F.concat_ws(" ", quoted, ticker, F.lit("earnings call transcript guidance outlook")))
    return F.when(is_analytical(question), F.concat(F.array(primary), more)).otherwise(F.array(primary))


def record_chunks(universe: DataFrame) -> DataFrame:
    """Profile chunk per company and overview chunk per layer; peers stay counts, not lists."""
    c = F.col
    layers = universe.groupBy("map_name", "layer").agg(F.count("*").alias("n"), F.min("company_pos").alias("p"))
    profile = universe.join(layers, ["map_name", "layer"]).select(
        F.concat_ws("-", F.lit("profile"), "ticker").alias("chunk_id"), F.lit("Company profile").alias("heading"), "ticker", c("map_name").alias("theme"),
        F.concat_ws(" ", "company", F.lit("("), "ticker", F.lit(")"), F.lit("in"), "layer", F.lit("of"), "map_name", F.lit("with"), (c("n") - 1).cast("string"), F.lit("peers")).alias("content"))
    overview = layers.select(
        F.concat_ws("-", F.lit("layer"), "map_name", "layer").alias("chunk_id"), F.lit("Layer overview").alias("heading"), F.lit(None).cast("string").alias("ticker"),
        c("map_name").alias("theme"), F.concat_ws(" ", "layer", F.lit("of"), "map_name", F.lit("lists"), c("n").cast("string"), F.lit("companies")).alias("content"))
    return profile.unionByName(overview)


def web_context(results: DataFrame, pages: DataFrame, question: dict, reputable: list[str], as_of: Column, n: int = 15) -> DataFrame:
    """Deduplicated, ranked results with the readable text of their page and the hits in it."""
    scored = score_results(distinct_by_url(results), question, reputable, as_of)
    quality = source_quality(F.col("host"), S.url_path(F.col("url")), F.concat_ws(" ", "title", "snippet", "url"), [w for w in _tokens(question["company"]) if len(w) >= 4], reputable)
    best = rank_web_results(scored.withColumn("quality", quality), n)
    attached = best.join(pages.select("url", F.col("text").alias("page_text")), "url", "left")
    words = [w for w in dict.fromkeys(_tokens(question["text"])) if len(w) > 1 and w not in S.STOP_WORDS]
    hits = reduce(lambda a, b: a + b, [F.coalesce(F.lower("page_text").contains(w), F.lit(False)).cast("int") for w in words], F.lit(0))
    return attached.withColumn("page_hits", hits)
