"""Deterministic call commentary: exchanges, takeaways, guidance and topics as rows of one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import text as T


def call_commentary(blocks: DataFrame, groups: list[dict], subjects: list[tuple[str, str]], topic_rules=None, metric_rules=None, cue: str = T.QUESTION_CUE,
                    heading: str = T.OUTLOOK_HEADING, forward: str = T.FORWARD) -> DataFrame:
    """(call_id, section, label, text) for every call. Sentence positions follow block and sentence order."""
    c = F.col
    rows = lambda low, high: blocks.select("call_id", "seq", F.posexplode(T.sentences(c("text"), low, high)).alias("s", "sentence")).select(
        "call_id", (c("seq").cast("long") * (1 << 32) + c("s")).alias("pos"), "sentence")
    sentences, guided = rows(45, 360), rows(T.GUIDANCE_LOW, T.GUIDANCE_HIGH)
    part = lambda df, section, label, text: df.select("call_id", F.lit(section).alias("section"), label.alias("label"), text.alias("text"))
    exchanges = T.qa_exchanges(blocks, cue)
    # topics are counted per block and added up, so a call never has to be one row
    counted = T.topics(blocks.select("call_id", "seq", "text").withColumn("__k", F.struct("call_id", "seq")), "__k", topic_rules, len(topic_rules or T.TOPICS))
    totals = counted.groupBy(c("__k.call_id").alias("call_id"), "label").agg(F.sum("score").alias("score"), F.min("rule").alias("rule"))
    best = T.top_n_per_key(totals, ["call_id"], [F.desc("score"), c("rule")], 6)
    sections = [
        part(exchanges, "qna", F.concat_ws(" ", "part", c("sequence").cast("string")), c("text")),
        part(T.takeaways(sentences, "call_id", groups, subjects), "takeaways", F.concat_ws(": ", "group", "subject"), c("sentence")),
        part(T.hard_guidance(guided, "call_id", heading, forward, metric_rules), "guidance", F.concat_ws(" ", "period", "label"), c("sentence")),
        part(best, "topics", c("label"), c("score").cast("string")),
    ]
    return reduce(lambda a, b: a.unionByName(b), sections)
