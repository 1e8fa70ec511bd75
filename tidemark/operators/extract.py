"""Facts out of filing documents.

HTML tables are the one place that needs a parser: ``parsed_tables`` reads documents one by one over Arrow batches,
inside Spark tasks; markup that is not plain goes to the standard library's parser. Everything after that is columns.
Contexts, units and tagged numbers of a document are matched inside its row, without a shuffle.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import chain, islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import dates as D
from tidemark.functions import numbers as N
from tidemark.functions import strings as S
from tidemark.operators import facts as FA
from tidemark.operators.keyed import once
from tidemark.session import written

# the parser travels inside the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARSED = "table_no int, row int, col int, origin_col int, text string, is_header boolean, is_origin boolean, context string"
CONTEXT_CHARS = 2000


class _Tables(HTMLParser):
    """Cells of every table of one document, spans recorded, and the text before each table."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.before = ""
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            table = {"rows": [], "caption": [], "in": None, "context": self.before}
            self.tables.append(table)
            self.open.append(table)
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
            self.open[-1]["in"] = None
        elif self.open and tag in ("td", "th"):
            span = {k: v for k, v in attrs}
            cell = {"text": [], "header": tag == "th", "cols": _span(span.get("colspan")), "rows": _span(span.get("rowspan"))}
            if not self.open[-1]["rows"]:
                self.open[-1]["rows"].append([])
            self.open[-1]["rows"][-1].append(cell)
            self.open[-1]["in"] = cell["text"]
        elif self.open and tag == "caption":
            self.open[-1]["in"] = self.open[-1]["caption"]

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.open:
            self.open.pop()
        elif self.open and tag in ("td", "th", "caption"):
            self.open[-1]["in"] = None

    def handle_data(self, data):
        if self.hidden:
            return
        if words := data.split():
            self.before = " ".join([self.before, *words] if self.before else words)[-CONTEXT_CHARS:]
        if self.open and self.open[-1]["in"] is not None:
            self.open[-1]["in"].append(data)


#: Widest column span that HTML knows.
MOST_COLUMNS = 1000


def _span(value) -> int:
    return max(1, int(value)) if value and value.isdecimal() else 1


#: Markup that every HTML parser reads alike: text, end tags, start tags with quoted attributes, scripts, comments, document types.
PLAIN = re.compile(
    r"""([^<]+)|</([a-zA-Z][-.a-zA-Z0-9:_]*)>"""
    r"""|<script(?: [^<>"'/]*)?>(?:(?!</|<!--)[\s\S])*</script>|<style(?: [^<>"'/]*)?>(?:(?!</|<!--)[\s\S])*</style>"""
    r"""|<([a-zA-Z][-.a-zA-Z0-9:_]*)((?:[ \t\r\n]+[a-zA-Z][-a-zA-Z0-9:_]*=(?:"[^"<>]*"|'[^'<>]*'))*)(/?)>"""
    r"""|<!--(?![->])(?:(?!--)[\s\S])+-->|<!doctype [^<>]*>""", re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z][-a-zA-Z0-9:_]*)=(?:"([^"]*)"|'([^']*)')""")
HANDLED = {"table", "tr", "td", "th", "caption"}
#: Elements whose content may not be markup.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


#: What a tag says, by its text; tags repeat. A process keeps so many, of at most so many characters.
_TAGS: dict[str, tuple | None] = {}
MOST_TAGS, TAG_CHARS = 4096, 200


def _tag(text: str) -> tuple | None:
    """(is start, is end, name, columns, rows) of a tag that counts here, () of one that does not; None where it is not plain."""
    found = PLAIN.fullmatch(f"<{text}>")
    if found is None or not (found.group(2) or found.group(3)):
        return None
    _, ended, started, attributes, empty = found.groups()
    name = (ended or started).lower()
    if name not in HANDLED:
        return None if name in RAW else ()
    span = {k.lower(): unescape(x or y) for k, x, y in ATTRIBUTE.findall(attributes)} if attributes else {}
    return bool(started), bool(ended or empty), name, _span(span.get("colspan")), _span(span.get("rowspan"))


def _known_tag(text: str) -> tuple | None:
    tag = _tag(text)
    if len(text) <= TAG_CHARS:
        if len(_TAGS) >= MOST_TAGS:
            _TAGS.clear()
        _TAGS[text] = tag
    return tag


def _plain(html: str) -> list[dict] | None:
    """Tables of a document that is plain markup throughout; None for any other. A tag is looked up by its text."""
    pieces = html.split("<")
    data = pieces[0]
    tables, opened, now, before = [], [], None, []
    # where the next tag starts, and up to where scripts, styles and comments were read
    follows, done = len(data), 0
    if data:
        before += (unescape(data) if "&" in data else data).split()
    for piece in islice(pieces, 1, None):
        start, follows = follows, follows + len(piece) + 1
        if start < done:
            data = html[done:follows] if done < follows else ""
        else:
            text, closed, data = piece.partition(">")
            if text in _TAGS:
                tag = _TAGS[text]
            elif text[:1] == "!" or text[:6].lower() == "script" or text[:5].lower() == "style":
                # these may hold signs of markup
                found = PLAIN.match(html, start)
                if found is None or found.group(3) and found.group(3).lower() in RAW:
                    return None
                done, tag, closed = found.end(), (), ">"
                data = html[done:follows] if done < follows else ""
            else:
                tag = _known_tag(text)
            if tag is None or not closed:
                return None
            if tag:
                starts, ends, name, cols, rows = tag
                if starts:
                    if name == "table":
                        before = [" ".join(before)[-CONTEXT_CHARS:]] if before else []
                        now = {"rows": [], "caption": [], "in": None, "context": before[0] if before else ""}
                        tables.append(now)
                        opened.append(now)
                    elif now is None:
                        pass
                    elif name == "tr":
                        now["rows"].append([])
                        now["in"] = None
                    elif name == "caption":
                        now["in"] = now["caption"]
                    else:
                        words = now["in"] = []
                        if not now["rows"]:
                            now["rows"].append([])
                        now["rows"][-1].append({"text": words, "header": name == "th", "cols": cols, "rows": rows})
                if ends and now is not None:
                    if name == "table":
                        opened.pop()
                        now = opened[-1] if opened else None
                    elif name != "tr":
                        now["in"] = None
        if data:
            if "&" in data:
                data = unescape(data)
            before += data.split()
            if now is not None and now["in"] is not None:
                now["in"].append(data)
    return tables


def _parse(html) -> list[dict]:
    html = html or ""
    tables = _plain(html)
    if tables is None:
        parser = _Tables()
        parser.feed(html)
        parser.close()
        tables = parser.tables
    return tables


def _grid(table: dict) -> Iterator[tuple]:
    """(row, col, origin column, text, is header, is origin) of every position, spans filled in."""
    if all(cell["cols"] == cell["rows"] == 1 for cells in table["rows"] for cell in cells):
        for r, cells in enumerate(table["rows"]):
            for c, cell in enumerate(cells):
                yield r, c, c, " ".join("".join(cell["text"]).split()), cell["header"], True
        return
    taken: set[tuple[int, int]] = set()
    height = len(table["rows"])
    for r, cells in enumerate(table["rows"]):
        c = 0
        for cell in cells:
            while (r, c) in taken:
                c += 1
            text = " ".join("".join(cell["text"]).split())
            # a span ends with the table, as in HTML
            width = min(cell["cols"], MOST_COLUMNS)
            for dr in range(min(cell["rows"], height - r)):
                for dc in range(width):
                    taken.add((r + dr, c + dc))
                    yield r + dr, c + dc, c, text, cell["header"], dr == 0 and dc == 0
            c += width


def parsed_tables(documents: DataFrame) -> DataFrame:
    """(doc_id, html) to one row per table position, and a row -1 per table with its caption as text and what stands before it.

    ``cells_of`` and ``contexts_of`` take either part; a caller that needs both writes this table once.
    """

    fields = [("table_no", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("origin_col", pa.int32()), ("text", pa.string()), ("is_header", pa.bool_()),
              ("is_origin", pa.bool_()), ("context", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (
                (i, t, *cell) for i, html in enumerate(batch.column("html").to_pylist()) for t, table in enumerate(_parse(html))
                for cell in chain([(-1, -1, -1, " ".join("".join(table["caption"]).split()), False, False, table["context"])], ((*x, None) for x in _grid(table))))
            while part := list(islice(rows, 20_000)):
                document, *columns = zip(*part)
                arrays = [pa.array(column, kind) for column, (_, kind) in zip(columns, fields)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(document)), *arrays], ["doc_id", *[name for name, _ in fields]])

    schema = T.StructType([documents.schema["doc_id"], *T.StructType.fromDDL(PARSED)])
    return documents.select("doc_id", "html").mapInArrow(run, schema)


def cells_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("row >= 0").drop("context")


def contexts_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("row = -1").select("doc_id", "table_no", F.col("text").alias("caption"), "context")


def explode_tables(documents: DataFrame) -> DataFrame:
    """(doc_id, html) to one row per table position."""
    return cells_of(parsed_tables(documents))


def table_contexts(documents: DataFrame) -> DataFrame:
    """(doc_id, html) to caption and preceding text of every table."""
    return contexts_of(parsed_tables(documents))


def _duration(text: Column) -> Column:
    """(type, months) named by an 'N months ended' phrase."""
    def kind(name, months):
        return F.struct(F.lit(name).alias("type"), F.lit(months).alias("months"))

    return (
        F.when(text.rlike("(?i)three months ended"), kind("QUARTER", 3)).when(text.rlike("(?i)six months ended"), kind("YTD_6M", 6))
        .when(text.rlike("(?i)nine months ended"), kind("YTD_9M", 9)).when(text.rlike(r"(?i)(?:\bltm|trailing twelve months) ended"), kind("LTM", 12))
        .when(text.rlike(r"(?i)(?:twelve months|years?) ended"), kind("FISCAL_YEAR", 12)))


def with_period(df: DataFrame, labels: Column, fye_month: Column, fye_day: Column, context: Column) -> DataFrame:
    """Add ``period``: the period named by the header labels of a column, the text around the table as a fallback.

    Every piece is a column of its own, so it is computed once per row.
    """
    c = F.col
    quarter = r"(?i)\b(?:q([1-4])\s*['-]?\s*(?:20)?(\d{2})|([1-4])q\s*['-]?\s*(?:20)?(\d{2}))\b"
    # a pattern is tried where a word that it needs is there
    holds = lambda word: F.contains(F.lower("__text"), F.lit(word))
    group = lambda i: F.when(holds("q"), F.regexp_extract("__text", quarter, i)).otherwise("")
    prefix = r"(?i)\b(?:(?:three|six|nine|twelve) months|years?) ended\s+([A-Za-z]+ \d{1,2})\b"
    rows = df.withColumns({"__text": F.array_join(F.array_distinct(labels), " "), "__m": fye_month, "__d": fye_day})
    rows = rows.withColumns({
        "__qn": F.concat(group(1), group(3)).try_cast("int"), "__qy": F.concat(group(2), group(4)).try_cast("int") + 2000,
        "__end": D.parse_date_header(c("__text")), "__dur": _duration(c("__text")),
        "__cal": F.when(holds("cy"), F.regexp_extract("__text", r"(?i)\bCY\s*(20\d{2})\b", 1)).try_cast("int"),
        "__ann": F.regexp_extract("__text", r"(?i)(?:\bFY\s*)?\b(20\d{2})(?:A)?\b", 1).try_cast("int"),
    })
    # the surrounding text matters only for a bare year
    bare = c("__ann").isNotNull() & (c("__end").isNull() | c("__dur").isNull()) & c("__cal").isNull() & c("__qn").isNull()
    rows = rows.withColumns({
        "__around": F.when(bare, _duration(context)), "__near_text": F.when(bare, F.nullif(F.regexp_extract(context, prefix, 1), F.lit("")))})
    rows = rows.withColumn("__near", D.parse_date_header(F.when(c("__near_text").isNotNull(), F.concat_ws(", ", "__near_text", c("__ann").cast("string")))))
    # one end date and duration, whichever source gave them
    rows = rows.withColumns({
        "__stop": F.when(c("__dur").isNotNull() & c("__end").isNotNull(), c("__end")).when(bare & c("__around").isNotNull(), c("__near")),
        "__span": F.when(c("__dur").isNotNull() & c("__end").isNotNull(), c("__dur")).when(bare, c("__around")),
    })
    first = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    last = lambda y: F.make_date(y, F.lit(12), F.lit(31))

    def period(kind, start, end, authority, explicit, fy, fq=F.lit(None)):
        return F.struct(kind.alias("type"), start.alias("start_date"), end.alias("end_date"), F.lit(authority).alias("authority"),
                        F.lit(explicit).alias("explicit"), fy.cast("int").alias("fiscal_year"), fq.cast("int").alias("fiscal_quarter"))

    q_start, q_end = D.fiscal_quarter_range(c("__qy"), c("__qn"), c("__m"), c("__d"))
    f_start, f_end = D.fiscal_year_range(c("__ann"), c("__m"), c("__d"))
    year_end = (c("__span.type") == "FISCAL_YEAR") & (F.date_format("__stop", "MM-dd") == "12-31")
    stated = period(F.when(year_end, "CALENDAR_YEAR").otherwise(c("__span.type")), F.add_months(F.date_add("__stop", 1), -c("__span.months")), c("__stop"),
                    "DERIVED_FROM_REPORTED_BOUNDARIES", True, F.coalesce(F.when(bare, c("__ann")), F.year("__stop")))
    calendar_fye = (c("__m") == 12) & (c("__d") == 31)
    found = (
        F.when(c("__qn").isNotNull() & c("__qy").isNotNull(), period(F.lit("QUARTER"), q_start, q_end, "INFERRED", False, c("__qy"), c("__qn")))
        .when(c("__span").isNotNull(), F.when(c("__stop").isNotNull(), stated))
        .when(c("__cal").isNotNull(), period(F.lit("CALENDAR_YEAR"), first(c("__cal")), last(c("__cal")), "INFERRED", False, c("__cal")))
        .when(c("__ann").isNotNull() & calendar_fye, period(F.lit("CALENDAR_YEAR"), first(c("__ann")), last(c("__ann")), "INFERRED", False, c("__ann")))
        .when(c("__ann").isNotNull() & f_start.isNotNull(), period(F.lit("FISCAL_YEAR"), f_start, f_end, "INFERRED", False, c("__ann"))))
    return once(rows, {"period": found}).select(*df.columns, "period")


# Labels of the company metric and wording that marks its tables.
COMPANY_METRIC_LABEL = (
    r"(?i)^(?:total |consolidated )?adjusted ebitda(?:\s*\(non-gaap\))?(?:\s*/\s*\(?loss\)?)?(?: attributable to (?:the company|[\w .&'-]+))?$"
    r"|^total segment adjusted ebitda (?:loss|profit)$")
SEGMENT_TOTAL = r"(?i)^total segment adjusted ebitda (?:loss|profit)$"
SEGMENT_TABLE = r"(?i)\b(?:summary of reportable segments|segment results|segment adjusted ebitda|segment ebitda)\b"
STATEMENT_SEGMENT = r"(?i)\b(?:segment\s+results|reportable\s+segments|by\s+segment|segment\s+(?:adjusted\s+)?ebitda|other\s+segment|geographic\s+information)"
ADJUSTMENT_ROW = (
    r"(?i)^(?:add|less|deduct):?|^(?:depreciation|amortization|interest|income taxes?|provision|benefit|stock-based compensation|impairment|"
    r"restructuring|unrealized (?:loss|gain))")
PERIOD_ROW = r"(?i)\b(?:three|six|nine|twelve) months ended|\byear ended|\bCY\s*20\d{2}|\bFY\s*20\d{2}|\bQ[1-4]\b|\b[1-4]Q\b"
PERIOD_CELL = r"(?i)\b20\d{2}(?:A)?\b|\bQ[1-4]\b|\b[1-4]Q\b"
VARIANCE = r"(?i)^(?:v|var(?:iance)?|change|chg|yoy)(?:\s*%)?$|^%$"
TABLE = ["doc_id", "table_no"]


def _table_text(cells: DataFrame) -> DataFrame:
    """Whole text of each table and the text of its first rows, in reading order; a table fits one document."""
    origin = cells.where("is_origin AND text <> ''")
    item = F.struct("row", "col", "text")
    # texts and places are never null here, so the plain order needs no comparison function
    items = origin.groupBy(*TABLE).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return once(items, {"table_text": F.array_join("items.text", " ")})


def _with_units(tables: DataFrame, first_rows: int, upto: Column | None = None) -> DataFrame:
    """Add ``currency`` and ``scale`` named around a table or in its first rows; every step is read once per table."""
    c = F.col
    inside = lambda x: (x["row"] < first_rows) if upto is None else ((x["row"] <= upto) & (x["row"] < first_rows))
    head = F.array_join(F.transform(F.filter("items", inside), lambda x: x["text"]), " ")
    rows = once(tables, {"__low": N.unit_text(F.concat_ws(" ", "context", "caption", head))})
    rows = once(rows, {"__word": N.unit_word(c("__low"))})
    currency, scale = N.named_units(c("__low"), c("__word"))
    rows = once(rows, {"__currency": currency, "__scale": scale})
    both = c("__currency").isNotNull() & c("__scale").isNotNull()
    return rows.select(*tables.columns, F.when(both, c("__currency")).alias("currency"), F.when(both, c("__scale")).alias("scale"))


def _numbered(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Number cells right of the label of each wanted row, with the header labels above them."""
    c = F.col
    # only cells of wanted rows are read as numbers
    numbers = once(cells.where("is_origin").join(rows, [*TABLE, "row"]).where("col > label_col"), {
        "number": N.parse_cell_number(c("text"))}).where("number IS NOT NULL").select(*TABLE, "row", "col", "label", "text", "number")
    # headers are looked for in tables of wanted rows only
    marked = cells.where("text <> ''").join(rows.select(*TABLE).distinct(), TABLE, "left_semi").withColumn("__period", c("is_origin") & c("text").rlike("[0-9]") & c("text").rlike(PERIOD_CELL))
    usable = marked.groupBy(*TABLE, "row").agg(
        F.array_join(F.collect_list(F.when(c("is_origin"), c("text"))), " ").alias("__text"), F.count_if(c("__period")).alias("__periods"))
    heads = marked.join(usable, [*TABLE, "row"]).where(c("is_header") | c("__text").rlike(PERIOD_ROW) | (c("__periods") >= 2)).select(
        *TABLE, c("row").alias("__head_row"), "col", c("text").alias("__head"))
    joined = numbers.join(heads, [*TABLE, "col"], "left")
    above = F.when(c("__head_row") < c("row"), F.struct("__head_row", "__head"))
    grouped = joined.groupBy(*TABLE, "row", "col", "label", "text", "number").agg(F.array_sort(F.collect_list(above)).alias("h"))
    return grouped.withColumn("labels", F.transform("h", lambda x: x["__head"])).drop("h")


def recon_facts(cells: DataFrame, contexts: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Company-metric facts of reconciliation tables: (facts, rejected tables with the reason).

    ``filings`` gives doc_id with fye_month and fye_day.
    """
    c = F.col
    # most cells are told apart without the pattern
    named = F.when(F.lower("text").contains("adjusted ebitda"), F.regexp_replace("text", r"[\s*†‡]+$", "").rlike(COMPANY_METRIC_LABEL)).otherwise(False)
    labelled = cells.where("is_origin AND text <> ''").withColumn("metric_label", named)
    labels = labelled.where(N.parse_cell_number(c("text")).isNull()).groupBy(*TABLE, "row").agg(
        F.min(F.struct("col", "text"))["text"].alias("row_label"), F.min(F.when(c("metric_label"), F.struct("col", "text"))).alias("m"))
    tables = labels.groupBy(*TABLE).agg(
        F.count("m").alias("metric_rows"), F.bool_or(c("row_label").rlike(r"(?i)^net (?:income|loss)(?: \(loss\))?")).alias("net_row"),
        F.count_if(c("row_label").rlike(ADJUSTMENT_ROW)).alias("adjustments"), F.max(F.when(c("m").isNotNull(), c("row"))).alias("row"),
        F.max("m.text").alias("label"), F.max("m.col").alias("label_col"),
        F.array_join(F.sort_array(F.collect_list(F.struct("row", "row_label")))["row_label"], "|").alias("row_labels"))
    texts = _table_text(cells)
    # inputs that a function reads many times are columns first, or they would be computed at every place
    joined = once(tables.join(texts, TABLE).join(contexts, TABLE, "left"), {"around": F.concat_ws(" ", "context", "caption", "table_text")})
    recon = c("around").rlike("(?i)reconciliation") | (c("net_row") & (c("adjustments") >= 2))
    reason = (
        F.when(c("metric_rows") != 1, "ADJUSTED_EBITDA_ROW_COUNT")
        .when(~recon | ~c("around").rlike("(?i)non-gaap|adjusted ebitda"), "RECONCILIATION_CONTEXT_MISSING")
        .when(c("around").rlike(SEGMENT_TABLE) & ~c("label").rlike(SEGMENT_TOTAL), "SEGMENT_TABLE_EXCLUDED")
        .when(c("scale").isNull(), "EXPLICIT_UNITS_MISSING"))
    mentioned = (c("metric_rows") > 0) | c("table_text").rlike("(?i)adjusted ebitda")
    judged = once(_with_units(joined.where(mentioned), 6, c("row")), {"reason": reason})
    # three branches read the verdicts
    judged = written(judged.select(*TABLE, "row", "label", "label_col", "currency", "scale", "around", "row_labels", "reason"), "judged-tables")
    good = judged.where("reason IS NULL").select(*TABLE, "row", "label", "label_col", "currency", "scale", "around", "row_labels")
    numbers = _numbered(cells, good.select(*TABLE, "row", "label", "label_col"))
    placed = numbers.join(good.select(*TABLE, "currency", "scale", "around", "row_labels"), TABLE).join(filings.select("doc_id", "fye_month", "fye_day"), "doc_id")
    mapped = with_period(placed, c("labels"), c("fye_month"), c("fye_day"), c("around"))
    kept = mapped.where(c("period").isNotNull())
    keys = kept.groupBy(*TABLE).agg(F.count("*").alias("__n"), F.count_distinct("period.type", "period.start_date", "period.end_date").alias("__distinct"))
    facts = kept.join(keys.where("__n = __distinct").select(TABLE), TABLE).select(
        *TABLE, "row", "col", "label", c("text").alias("raw_text"), "number", "currency", "scale", F.round(c("number") * c("scale"), 2).alias("value"),
        "period.*", S.definition_fingerprint(c("label"), F.array("row_labels")).alias("definition"))
    duplicated = keys.where("__n <> __distinct").select(*TABLE, F.lit("PERIOD_MAPPING_DUPLICATE_OR_EMPTY").alias("reason"))
    rejected = judged.where("reason IS NOT NULL").select(*TABLE, "reason").unionByName(duplicated)
    return facts, rejected


# Metrics read from statement tables.
STATEMENT_METRICS = ["revenue", "grossProfit", "costOfRevenue", "ebit", "operatingCashFlow", "capitalExpenditures", "depreciationAmortization",
                     "depreciation", "amortization"]
COST_ALLOCATION = (r"(?i)\b(?:share\W*based compensation|expense allocation|allocation of (?:an? )?expense|expenses? by (?:function|category)|"
                   r"depreciation and amortization expenses?)\b")


def statement_facts(cells: DataFrame, contexts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts of labelled metric rows in financial tables; segment tables and cost allocations are left out."""
    c = F.col
    wording = F.trim(F.when(c("text").rlike(r"[)*†‡]\s*$"), F.regexp_replace("text", r"(?:\s*(?:\(\d+\)|[*†‡]))+\s*$", "")).otherwise(c("text")))
    found = F.array_intersect(FA.metric_candidates(F.lit("company-table"), F.lit(""), c("wording")), F.array(*[F.lit(m) for m in STATEMENT_METRICS]))
    # labels repeat across documents: each distinct wording is classified once
    labels = cells.where("is_origin AND text <> ''").select(*TABLE, "row", "col", "text", wording.alias("wording")).where(c("text").rlike("[A-Za-z]"))
    classes = once(labels.select("wording").distinct(), {"metrics": found}).where(F.size("metrics") > 0)
    labelled = labels.join(classes, "wording")
    rows = labelled.groupBy(*TABLE, "row").agg(F.min(F.struct("col", "text", "metrics")).alias("m")).select(
        *TABLE, "row", c("m.text").alias("label"), c("m.col").alias("label_col"), c("m.metrics").alias("metrics"))
    tables = rows.groupBy(*TABLE).agg(F.array_distinct(F.flatten(F.collect_list("metrics"))).alias("table_metrics"))
    texts = _table_text(cells)
    joined = once(tables.join(texts, TABLE).join(contexts, TABLE, "left"), {"around": F.concat_ws(" ", "context", "caption", "table_text")})
    low = F.lower("around")
    segment = (low.contains("segment") | low.contains("geographic")) & c("around").rlike(STATEMENT_SEGMENT)
    usable = _with_units(joined.where(~segment), 8).where(c("scale").isNotNull())
    isolated = c("table_text").rlike(COST_ALLOCATION) & ~F.arrays_overlap("table_metrics", F.array(F.lit("revenue"), F.lit("grossProfit")))
    good = usable.withColumn("isolated", isolated).select(*TABLE, "currency", "scale", "around", "isolated")
    wanted = rows.join(good, TABLE).where(~(c("isolated") & F.array_contains("metrics", "costOfRevenue")))
    wanted = written(wanted.select(*TABLE, "row", "label", "label_col", "metrics", "currency", "scale", "around"), "statement-rows")
    numbers = _numbered(cells, wanted.select(*TABLE, "row", "label", "label_col"))
    placed = numbers.join(wanted.select(*TABLE, "row", "metrics", "currency", "scale", "around"), [*TABLE, "row"]).join(filings, "doc_id")
    mapped = with_period(placed, c("labels"), c("fye_month"), c("fye_day"), c("around")).where(c("period").isNotNull())
    quarterly = F.col("form").isin("10-Q", "10-Q/A") & c("period.type").isin("QUARTER", "YTD_6M", "YTD_9M")
    same_day = F.date_format("period.end_date", "MM-dd") == F.date_format("report_date", "MM-dd")
    fits = mapped.where(~F.coalesce(quarterly & ~same_day, F.lit(False)))
    return fits.select(*TABLE, "row", "col", "label", F.explode("metrics").alias("metric"), "currency", F.round(c("number") * c("scale"), 2).alias("value"), "period.*")


def slide_facts(texts: DataFrame) -> DataFrame:
    """Company-metric values of reconciliation slides in a text layer (doc_id, text)."""
    title = r"(?i)Adjusted EBITDA Reconciliation\s*\((US|USD|EUR|GBP)\s*\$?m\)"
    blocks = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"({title}[\s\S]*?Adjusted EBITDA Margin)"), F.lit(1))).alias("block")).where(F.length("block") < 8000)
    dates = F.regexp_extract_all("block", F.lit(r"(?i)Quarter ended\s+([A-Z][a-z]+\s+\d{1,2},?\s+20\d{2})"), F.lit(1))
    lines = F.regexp_extract_all("block", F.lit(r"(?i)Adjusted EBITDA\s+((?:\(?-?[\d,.]+\)?\s*)+)"), F.lit(1))
    values = F.split(F.trim(F.element_at(lines, -1)), r"\s+")
    code = F.upper(F.regexp_extract("block", title, 1))
    rows = blocks.where((F.size(lines) > 0) & F.size(dates).between(1, 4)).select("doc_id", F.when(code == "US", "USD").otherwise(code).alias("currency"), dates.alias("d"), F.slice(values, 1, 4).alias("v"))
    paired = rows.where(F.size("v") >= F.size("d")).select("doc_id", "currency", F.posexplode("d").alias("i", "label"), "v")
    end = D.parse_date_header(F.col("label"))
    return paired.select("doc_id", "currency", F.add_months(F.date_add(end, 1), -3).alias("start_date"), end.alias("end_date"),
                         (N.parse_cell_number(F.get("v", F.col("i"))) * 1e6).alias("value"))


def _attr(source: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(source, rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def _tagged(documents: DataFrame, pattern: str, name: Column, body: Column, column: str) -> DataFrame:
    """Tagged numbers of each document with the dates and unit their ids point to; of equal ids the first one counts.

    One scan turns a document into nodes (context, unit, fact). Facts meet their context, then their unit, under the id that they
    share, so the work is in proportion to the nodes of a document, however many contexts it has.
    """
    c = F.col
    context = r"(?is)(<(?:\w+:)?context\b.*?</(?:\w+:)?context>)"
    unit = r"(?is)(<(?:\w+:)?unit\b.*?</(?:\w+:)?unit>)"
    inner = lambda x, tag: F.nullif(F.trim(F.regexp_extract(x, rf"(?is)<(?:\w+:)?{tag}\b[^>]*>([^<]+)<", 1)), F.lit(""))
    found = lambda p: F.regexp_extract_all(column, F.lit(p), F.lit(1))
    node = lambda kind, p, space, attribute: F.transform(found(p), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), F.concat(F.lit(space), _attr(x, attribute)).alias("key"), i.alias("pos"), x.alias("xml")))
    nodes = documents.select("doc_id", F.inline(F.concat(node("context", context, "c:", "id"), node("unit", unit, "u:", "id"), node("fact", pattern, "c:", "contextRef"))))
    of = lambda kind: F.min(F.when(c("kind") == kind, F.struct("pos", "xml")))["xml"]
    met = nodes.where("key IS NOT NULL").groupBy("doc_id", "key").agg(of("context").alias("x"), of("unit").alias("u"), F.collect_list(F.when(c("kind") == "fact", c("xml"))).alias("tags"))
    # read once per context and unit, before facts multiply them
    dated = met.select("doc_id", "key", "tags", F.substring_index(inner(c("u"), "measure"), ":", -1).alias("measure"), F.struct(
        inner(c("x"), "startDate").try_cast("date").alias("start_date"), inner(c("x"), "endDate").try_cast("date").alias("end_date"),
        F.when(c("x").rlike(r"(?i)<(?:\w+:)?(?:segment|scenario)\b"), S.strip_html(c("x"))).alias("segment")).alias("context"))
    facts = dated.select("doc_id", "measure", "context", "key", F.explode_outer("tags").alias("tag")).where(c("tag").isNotNull() | c("measure").isNotNull())
    target = F.when(c("tag").isNotNull(), F.concat(F.lit("u:"), F.coalesce(_attr(c("tag"), "unitRef"), F.lit("")))).otherwise(c("key"))
    units = facts.withColumn("target", target).groupBy("doc_id", "target").agg(F.max("measure").alias("measure"), F.collect_list(F.when(c("tag").isNotNull(), F.struct("tag", "context"))).alias("f"))
    rows = units.select("doc_id", "measure", F.inline("f"))
    tagged = rows.withColumns({"qname": name, "body": S.strip_html(body), "unit": F.coalesce("measure", _attr(c("tag"), "unitRef"))})
    namespace = F.when(F.col("qname").contains(":"), F.substring_index("qname", ":", 1)).otherwise("extension")
    concept = F.substring_index("qname", ":", -1)
    value = N.parse_tagged_number(F.col("body"), _attr(F.col("tag"), "scale"), _attr(F.col("tag"), "sign"), _attr(F.col("tag"), "nil"))
    out = tagged.withColumns({"namespace": namespace, "concept": concept, "value": value, "start_date": F.col("context.start_date"),
                              "end_date": F.col("context.end_date"), "segment": F.col("context.segment")})
    out = out.withColumn("label", S.humanize_concept(F.col("concept")))
    metrics = FA.metric_candidates(F.col("namespace"), F.col("concept"), F.col("label"))
    days = D.inclusive_days(F.col("start_date"), F.col("end_date"))
    kept = once(out, {"metrics": metrics}).where((F.size("metrics") > 0) & N.finite(F.col("value")) & F.col("unit").rlike("^[A-Z]{3}$") & days.between(45, 400))
    return kept.select("doc_id", "namespace", "concept", "metrics", "value", F.col("unit").alias("currency"), "start_date", "end_date", "segment")


def inline_facts(documents: DataFrame, column: str = "html") -> DataFrame:
    """Facts tagged inside the page."""
    body = F.regexp_extract("tag", r"(?is)^<[^>]*>(.*)</ix:nonfraction>$", 1)
    return _tagged(documents, r"(?is)(<ix:nonfraction\b[^>]*>.*?</ix:nonfraction>)", _attr(F.col("tag"), "name"), body, column)


def instance_facts(documents: DataFrame, column: str = "xml") -> DataFrame:
    """Facts of an instance document: elements that point to a context."""
    body = F.regexp_extract("tag", r"(?is)^<[^>]*>([^<]*)</", 1)
    name = F.regexp_extract("tag", r"^<([A-Za-z_][\w.-]*:[A-Za-z_][\w.-]*)", 1)
    return _tagged(documents, r"(?is)(<[A-Za-z_][\w.-]*:[A-Za-z_][\w.-]*\b[^>]*\bcontextRef\s*=\s*[\"'][^\"']+[\"'][^>]*>[^<]*</[A-Za-z_][\w.:-]*>)", name, body, column)


EXHIBIT = r"(?i)(?:ex(?:hibit)?[-_]?99|earnings|release|results)"


def linked_exhibits(documents: DataFrame, base: str) -> DataFrame:
    """Distinct earnings exhibits a filing page links to, inside its own folder. Columns: doc_id, html, folder."""
    anchors = documents.select("doc_id", "folder", F.explode(F.regexp_extract_all(
        "html", F.lit(r"(?is)(<a\b[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>)"), F.lit(1))).alias("a"))
    href, label = _attr(F.col("a"), "href"), S.strip_html(F.col("a"))
    rows = anchors.withColumns({"href": href, "label": label}).where(
        F.concat_ws(" ", "href", "label").rlike(EXHIBIT) | F.col("label").rlike(r"^99(?:\.\d+)?$"))
    url = F.when(F.col("href").rlike("(?i)^https?://"), F.col("href")).otherwise(F.concat(F.lit(base), F.lit("/"), "folder", F.lit("/"), "href"))
    inside = F.col("url").startswith(base) & F.col("url").contains(F.concat(F.lit("/"), F.col("folder"), F.lit("/"))) & F.col("url").rlike(r"(?i)\.html?$")
    return rows.withColumn("url", url).where(inside).select("doc_id", "url", F.substring_index("url", "/", -1).alias("name")).distinct()


# Elements without readable text and line starts to drop.
NOISE = ["script", "style", "noscript", "svg", "canvas", "template", "nav", "footer", "form", "aside"]
DROPPED_LINE = r"(?i)^(cookie|privacy policy|terms of use|subscribe|sign in)\b"


def _meta(html: Column, keys: list[str]) -> Column:
    out = [F.nullif(F.trim(F.regexp_extract(html, rf"(?i)<meta[^>]+(?:name|property)=[\"']{k}[\"'][^>]+content=[\"']([^\"']+)[\"'][^>]*>", 1)), F.lit("")) for k in keys]
    return S.decode_entities(F.coalesce(*out))


def readable_text(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Title, publication date and body lines of at least 35 characters."""
    noise = "|".join(rf"<{tag}[^>]*>.*?</{tag}>" for tag in NOISE)
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<!--.*?-->", " "), rf"(?is){noise}", " ")
    lines = F.regexp_replace(F.regexp_replace(bare, r"(?i)<(?:br|hr)\s*/?>", "\n"), r"(?i)</(?:p|div|section|article|main|li|h[1-6]|tr)>", "\n")
    text = S.decode_entities(F.regexp_replace(F.regexp_replace(lines, r"<[^>]+>", " "), "\r", ""))
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (F.length(x) >= 35) & ~x.rlike(DROPPED_LINE))
    body = F.array_join(kept, "\n")
    title = F.coalesce(_meta(F.col("html"), ["og:title", "twitter:title"]), F.nullif(S.decode_entities(S.normalize_ws(
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit("")))
    published = _meta(F.col("html"), ["article:published_time", "date", "datePublished", "publish-date", "pubdate"])
    keep = [x for x in pages.columns if x != "html"]
    return pages.select(*keep, title.alias("title"), published.alias("published_at"), (F.left(body, F.lit(max_chars)) if max_chars else body).alias("text"))


def forecast_row(texts: DataFrame, label: str, year: int, stops: list[str]) -> DataFrame:
    """Value of a forecast row for a fiscal year; the first value when the year is not listed."""
    block = F.regexp_extract("text", r"(?is)Fiscal Year\s+(.*?)Period Ending", 1)
    years = F.regexp_extract_all(block, F.lit(r"(?i)FY\s*(\d{4})"), F.lit(1))
    row = F.regexp_extract("text", rf"(?is){label}\s+(.*?)\n(?:{'|'.join(stops)})\b", 1)
    values = F.transform(F.regexp_extract_all(row, F.lit(r"(?i)(-?\d+(?:\.\d+)?\s?[KMBT]?)"), F.lit(1)), lambda x: N.parse_compact_number(F.trim(x)))
    place = F.array_position(years, F.lit(str(year))).cast("int")
    return texts.select("doc_id", F.when(place > 0, F.get(values, place - 1)).otherwise(F.get(values, F.lit(0))).alias("value"))


def evidence_documents(calls: DataFrame, linked: DataFrame, filings: DataFrame, documents: DataFrame, exhibits: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Distinct documents behind a call: linked ones, filings of the period, and up to three exhibits of each current report."""
    from tidemark.operators.filings import filings_for_call
    from tidemark.operators.keyed import top_n_per_key

    near = filings_for_call(calls, filings).select("call_id", "accession", "form")
    first = top_n_per_key(exhibits, ["accession"], [F.col("url")], 3).select("accession", F.col("url").alias("exhibit_url"))
    attached = near.where(F.col("form").isin("8-K", "6-K")).join(first, "accession").select("call_id", F.col("exhibit_url").alias("url"), F.concat(F.lit("Exhibit of "), "form").alias("source"))
    main = near.join(documents.select("accession", "url"), "accession").select("call_id", "url", F.col("form").alias("source"))
    every = linked.select("call_id", "url", F.lit("Company Document").alias("source")).unionByName(main).unionByName(attached)
    once = every.groupBy("call_id", "url").agg(F.min("source").alias("source"))
    text = documents.select("url", (F.left("text", F.lit(max_chars)) if max_chars else F.col("text")).alias("text"))
    return once.join(text, "url", "left")
