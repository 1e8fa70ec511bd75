"""Identifiers, clean-up, hashing and tokens as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _starts_with_word(pattern: str) -> bool:
    """Whether every match of the pattern's first item begins with an ASCII word character, as far as a glance tells."""
    if re.match(r"[A-Za-z0-9_](?![?*{])", pattern):
        return True
    group = re.match(r"\((?:\?:)?(?!\?)", pattern)
    if not group:
        return False
    depth, place, begin = 0, group.end(), True
    while place < len(pattern):
        ch = pattern[place]
        if begin and depth == 0 and not re.match(r"[A-Za-z0-9_](?![?*{])", pattern[place:]):
            return False
        begin = False
        if ch == "\\":
            place += 1
        elif ch == "[":
            return False
        elif ch == "(":
            depth += 1
        elif ch == ")":
            if depth == 0:
                # an optional group may be skipped
                return not re.match(r"[?*{]", pattern[place + 1 :])
            depth -= 1
        elif ch == "|" and depth == 0:
            begin = True
        place += 1
    return False


def rx(pattern: str) -> str:
    """Pattern whose word edges look at ASCII letters only, whatever the Java version does with accents.

    Where a word character must follow, the edge is only that none goes before, which is tried at every place of a text far faster;
    likewise where one must go before.
    """
    parts = pattern.split(r"\b")
    out = parts[0]
    for before, after in zip(parts, parts[1:], strict=False):
        if _starts_with_word(after):
            edge = f"(?<!{_WORD})"
        elif re.search(r"(?:^|[^\\])[A-Za-z0-9_]$", before):
            edge = f"(?!{_WORD})"
        else:
            edge = _EDGE
        out += edge + after
    return out


def pad_cik(cik: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(cik.cast("string"), F.lit("")), r"\D", "")
    return F.lpad(digits, 10, "0")


def compact_cik(cik: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(cik.cast("string"), F.lit("")), r"\D", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(0)).cast("string")


def encode_path(path: Column) -> Column:
    """Percent-encode every path segment; a blank stays %20, not a plus sign."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(F.url_encode(p), r"\+", "%20")), "/")


def filing_url(cik: Column, accession: Column, document: Column, base: str) -> Column:
    """Archive address of a filing document, null when a part is malformed."""
    name = F.trim(document)
    safe = (name != "") & ~name.startswith("/") & ~name.rlike(r"(^|[/\\])\.{1,2}([/\\]|$)")
    valid = cik.rlike(r"^\d{1,10}$") & accession.rlike(r"^\d{10}-\d{2}-\d{6}$") & safe
    return F.when(
        valid,
        F.concat_ws("/", F.lit(base), cik.try_cast("bigint").cast("string"), F.regexp_replace(accession, "-", ""), encode_path(name)),
    )


def normalize_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Character entities and their text.
ENTITIES = [
    ("&nbsp;|&#160;", " "), ("&amp;", "&"), ("&quot;|&rdquo;|&ldquo;", '"'), ("&#149;|&bull;", "•"),
    ("&#39;|&apos;|&rsquo;|&lsquo;", "'"), ("&ndash;|&mdash;", "-"), ("&lt;", "<"), ("&gt;", ">"),
]


def decode_entities(text: Column) -> Column:
    for pattern, replacement in ENTITIES:
        text = F.regexp_replace(text, f"(?i){pattern}", replacement)
    return text


def strip_html(html: Column) -> Column:
    """Visible text of a page on one line."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return normalize_ws(decode_entities(F.regexp_replace(bare, r"<[^>]+>", " ")))


def html_to_lines(html: Column, separator: str = "\n") -> Column:
    """Visible text with a separator where a block element ends."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    lines = F.regexp_replace(bare, r"(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])[^>]*>", "\u0001")
    text = normalize_ws(decode_entities(F.regexp_replace(lines, r"<[^>]+>", " ")))
    parts = F.filter(F.transform(F.split(text, "\u0001"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(parts, separator)


def humanize_concept(concept: Column) -> Column:
    spaced = F.regexp_replace(concept, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(spaced, r"[_-]+", " "))


def safe_key(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)[^A-Z0-9._-]", "_")


def record_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def content_hash(*fields: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def definition_fingerprint(label: Column, rows: Column) -> Column:
    """Hash of the wording of a table: numbers become #, other signs a blank."""
    joined = F.lower(F.concat_ws("|", label, rows))
    words = F.regexp_replace(F.regexp_replace(joined, r"\d+(?:\.\d+)?", "#"), r"[^a-z#]+", " ")
    return F.sha2(F.trim(words), 256)


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def url_path(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("PATH")))


# Words that carry no meaning in a question.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "company", "do", "for", "from", "how", "i", "if", "in",
    "is", "it", "of", "on", "or", "our", "that", "the", "their", "this", "to", "was", "what", "when", "where", "which",
    "who", "why", "with", "would", "you",
]

# Groups of words treated alike in a question.
SYNONYM_GROUPS = [
    ["bull", "upside", "growth", "catalyst", "opportunity"],
    ["bear", "downside", "risk", "disconfirm", "break", "thesis"],
    ["competitor", "competition", "alternative", "substitute", "peer"],
    ["chokepoint", "bottleneck", "constraint", "capacity", "supply"],
    ["margin", "profitability", "ebit", "ebitda", "earnings"],
    ["demand", "orders", "backlog", "visibility"],
    ["capex", "capital", "expenditure", "investment"],
    ["customer", "qualification", "qualified", "adoption"],
    ["product", "portfolio", "exposure", "segment"],
    ["valuation", "multiple", "price", "marketcap"],
]


def tokenize(text: Column, stop_words: list[str] | None = None) -> Column:
    """Distinct lower-case tokens of two characters or more, stop words dropped."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9.+-]+", " ")), " ")
    kept = F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))
    stops = STOP_WORDS if stop_words is None else stop_words
    return F.array_except(kept, F.array(*[F.lit(w) for w in stops])) if stops else kept


def expand_synonyms(tokens: Column, groups: list[list[str]] | None = None) -> Column:
    """Tokens plus every member of a synonym group that a token belongs to, groups in order."""
    out = tokens
    for group in SYNONYM_GROUPS if groups is None else groups:
        members = F.array(*[F.lit(w) for w in group])
        out = F.when(F.arrays_overlap(out, members), F.array_union(out, members)).otherwise(out)
    return out


_NUMBER = (
    r"(?i)((?:[$€£¥]\s*)?\d[\d,.]*(?:\.\d+)?\s*"
    r"(?:%|x|bps?|basis points?|million|billion|thousand|m|bn|shares?)?)"
)


def number_tokens(text: Column) -> Column:
    """Numbers with their signs and units in one spelling; bare one- and two-digit numbers dropped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_NUMBER), F.lit(1))

    def spell(token):
        low = F.regexp_replace(F.lower(token), ",", "")
        return F.regexp_replace(F.regexp_replace(low, r"\b([mbt])(?:illion|housand)\b", "$1"), r"\s+", "")

    return F.filter(F.transform(found, spell), lambda t: (t != "") & ~t.rlike(r"^\d{1,2}$"))


def accounting_basis(text: Column) -> Column:
    return (
        F.when(text.rlike(rx(r"(?i)\bnon-gaap\b|\badjusted\b")), "non-GAAP")
        .when(text.rlike(rx(r"(?i)\bgaap\b")), "GAAP").otherwise("unspecified")
    )


def company_score(name: Column, ticker: Column, query: Column) -> Column:
    """Match quality of a company for a query; zero when nothing matches."""
    q, t, n = F.lower(query), F.lower(ticker), F.lower(name)
    return (
        F.when(t == q, 1000.0)
        .when(t.startswith(q), F.lit(800.0) - F.length(t))
        .when(n == q, 700.0)
        .when(n.startswith(q), F.lit(600.0) - F.length(n) / 100)
        .when(n.contains(q), F.lit(400.0) - (F.position(q, n) - 1))
        .otherwise(0.0)
    )
