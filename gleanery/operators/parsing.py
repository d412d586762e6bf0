"""Pages to text and tables, and the sections of filings."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import WS

MIN_SECTION_CHARS = 500
# The items of an annual report and the patterns of their headings.
_GAP = "[.\\-–—:]?"
ITEM_PATTERNS = [
    ("Item 1 Business", rf"item\s*1\s*{_GAP}\s*business"),
    ("Item 1A Risk Factors", rf"item\s*1a\s*{_GAP}\s*risk\s*factors"),
    ("Item 1B Unresolved Staff Comments", rf"item\s*1b\s*{_GAP}\s*unresolved"),
    ("Item 2 Properties", rf"item\s*2\s*{_GAP}\s*propert"),
    ("Item 3 Legal Proceedings", rf"item\s*3\s*{_GAP}\s*legal"),
    ("Item 5 Market for Common Equity", rf"item\s*5\s*{_GAP}\s*market\s*for"),
    ("Item 7 MD&A", rf"item\s*7\s*{_GAP}\s*management.{{0,5}}s\s*discussion"),
    ("Item 7A Market Risk", rf"item\s*7a\s*{_GAP}\s*quantitative"),
    ("Item 8 Financial Statements", rf"item\s*8\s*{_GAP}\s*financial\s*statements"),
    ("Item 9A Controls and Procedures", rf"item\s*9a\s*{_GAP}\s*controls"),
]
# Elements whose content is no text, and elements that end a line.
HIDDEN = "script style head title meta link".split()
BREAKING = "p div br tr li h1 h2 h3 h4 h5 h6 table thead tbody section article hr".split()


def _squeeze(text: str) -> str:
    lines = text.replace("\xa0", " ").replace("\r\n", "\n").replace("\r", "\n")
    for c in "\t\f\v":
        lines = lines.replace(c, " ")
    while "  " in lines:
        lines = lines.replace("  ", " ")
    while "\n\n\n" in lines:
        lines = lines.replace("\n\n\n", "\n\n")
    return lines.strip()


def linear_table(rows: list[list[str]]) -> str:
    """Rows of cells as lines: cells padded to their column and joined by " | "."""
    widths: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            if k == len(widths):
                widths.append(0)
            widths[k] = max(widths[k], len(cell))
    return "\n".join(" | ".join((row[k] if k < len(row) else "").ljust(w) for k, w in enumerate(widths)).rstrip() for row in rows)


class _Page(HTMLParser):
    """Collects text; tables are held back until they close."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.hidden = 0
        self.open: list[dict] = []

    def line_end(self) -> None:
        if self.parts and self.parts[-1][-1:] != "\n":
            self.parts.append("\n")

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag == "table":
            self.line_end()
            self.open.append({"rows": [], "row": [], "cell": []})
        elif self.open and tag == "tr":
            self.open[-1]["row"] = []
        elif self.open and tag in ("td", "th"):
            self.open[-1]["cell"] = []
        elif tag in BREAKING:
            self.line_end()

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            return
        if self.hidden:
            return
        top = self.open[-1] if self.open else None
        if top and tag in ("td", "th"):
            top["row"].append(_squeeze("".join(top["cell"])))
            top["cell"] = []
        elif top and tag == "tr":
            if any(top["row"]):
                top["rows"].append(top["row"])
            top["row"] = []
        elif top and tag == "table":
            self.open.pop()
            if top["rows"]:
                self.tables.append(top["rows"])
                self.parts.append(linear_table(top["rows"]) + "\n")
        elif tag in BREAKING:
            self.line_end()

    def handle_data(self, data):
        if not self.hidden and data:
            (self.open[-1]["cell"] if self.open else self.parts).append(data)


def page_text(html: str | None) -> tuple[str | None, list[dict]]:
    """Normalised text of a page and its tables, each found again in it from the end of the one before, else anywhere."""
    if html is None:
        return None, []
    page = _Page()
    page.feed(html)
    page.close()
    text, tables, at = _squeeze("".join(page.parts)), [], 0
    for rows in page.tables:
        drawn = _squeeze(linear_table(rows))
        start = text.find(drawn, at) if drawn else -1
        if start < 0 and drawn:
            start = text.find(drawn)
        if start >= 0:
            at = start + len(drawn)
            tables.append({"grid": rows, "caption": None, "char_start": start, "char_end": at})
    return text, tables


TABLES = "array<struct<grid:array<array<string>>,caption:string,char_start:int,char_end:int>>"


def parse_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, text, doc_tables) of HTML pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("grid", pa.list_(pa.list_(pa.string()))), ("caption", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())]))
        for batch in batches:
            parsed = [page_text(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in parsed], pa.string()), pa.array([g for _, g in parsed], kind)], names=[id_col, "text", "doc_tables"])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, text string, doc_tables {TABLES}")


def strip_tags(html: Column) -> Column:
    """Text of a page by patterns alone, on one line."""
    hidden = F.regexp_replace(html, r"(?is)<(script|style|head|title)\b[^>]*>.*?</(script|style|head|title)>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(hidden, "<[^>]*>", " "), r"\s+", " "))


def find_sections(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section_name, section_order, char_start, char_end): for every item its last heading, up to the next one.

    A section below MIN_SECTION_CHARS is dropped unless it is the last; the next one still starts where it starts.
    """
    text = F.col(text_col)
    found = F.array_compact(
        F.array(
            *(
                F.when(
                    text.rlike("(?is)" + pattern),
                    F.struct(F.lit(name).alias("section_name"), F.lit(order).alias("section_order"), (F.length(F.regexp_extract(F.concat(F.lit("#"), text), f"(?is)^(.*){pattern}", 1)) - 1).alias("char_start")),
                )
                for order, (name, pattern) in enumerate(ITEM_PATTERNS)
            )
        )
    )
    each = documents.select(F.col(id_col), F.length(text).alias("n_chars"), F.explode(found).alias("s")).select(id_col, "n_chars", "s.*")
    following = F.lead("char_start").over(Window.partitionBy(id_col).orderBy("char_start", "section_order"))
    ended = each.withColumn("following", following)
    kept = ended.filter(F.col("following").isNull() | (F.col("following") - F.col("char_start") >= MIN_SECTION_CHARS))
    return kept.select(id_col, "section_name", "section_order", "char_start", F.coalesce("following", "n_chars").alias("char_end"))


def content_start(sections: Column) -> Column:
    """Where the first section begins: what is before is front matter. Without sections the text begins at 0."""
    return F.coalesce(F.array_min(F.transform(sections, lambda s: s["char_start"])), F.lit(0))


def section_at(sections: Column, offset: Column) -> Column:
    """The first section that contains an offset."""
    return F.try_element_at(F.filter(sections, lambda s: (s["char_start"] <= offset) & (offset < s["char_end"])), F.lit(1))


def tables_overlapping(tables: Column, start: Column, end: Column) -> Column:
    return F.filter(tables, lambda t: F.least(t["char_end"], end) > F.greatest(t["char_start"], start))


def slice_span(text: Column, doc_id: Column, span_doc_id: Column, start: Column, end: Column) -> Column:
    """The part of a text that a span names; a span of another document is an error."""
    wrong = F.raise_error(F.concat(F.lit("span of document "), span_doc_id, F.lit(", text of "), doc_id)).cast("string")
    return F.when(doc_id == span_doc_id, F.substr(text, start + 1, end - start)).otherwise(wrong)


def parse_filings(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of pages (html, company, cik, form_type, fiscal_year, accession).

    A document has doc_id, text, doc_tables, sections, metadata, content_hash. A page without html, cik, accession or
    form type gives a failure (accession, problem) instead, so one bad page never stops a job.
    """
    from gleanery.functions.text import stable_id

    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("html", "cik", "accession", "form_type"))))
    judged = pages.withColumn("lacking", lacking)
    failures = judged.filter(F.size("lacking") > 0).select("accession", F.concat(F.lit("lacks "), F.array_join("lacking", ", ")).alias("problem"))
    good = judged.filter(F.size("lacking") == 0).withColumn("doc_id", stable_id(F.col("cik").cast("string"), F.col("accession"), F.col("form_type")))
    parsed = parse_pages(good.select("doc_id", "html"), "doc_id", "html")
    sections = find_sections(parsed, "doc_id", "text").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "section_name", "section_order"))).alias("sections"))
    metadata = F.create_map(*[x for c in ("company", "cik", "form_type", "fiscal_year", "accession") for x in (F.lit(c), F.col(c).cast("string"))])
    made = parsed.join(sections, "doc_id", "left").join(good.select("doc_id", metadata.alias("metadata")), "doc_id").withColumn("content_hash", F.sha2("text", 256))
    return made, failures
