"""HTML pages as passages: visible blocks in order, and table rows with their headers.

The reader only cuts a page into blocks and the cells of its tables, each with its place on the table's grid. Header rows, row names,
figures whose signs are in cells of their own, column names and offsets come from windows over (doc, block, row).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.session import materialize

BLOCKS = {"p", "li", "blockquote", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "div", "caption", "td", "th", "tr", "table", "ul", "ol", "article", "section", "body", "nav", "header", "footer"}
HIDDEN = {"script", "style", "noscript", "template", "iframe", "head"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
# Fixed value: styles that hide a node; a font size of 0 in any unit does, one of 0.9em doesn't.
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?![\d.]*[1-9])", re.I)
SUPERSCRIPT = re.compile("[²³¹⁰-⁹]+")
NOTHING = re.compile("[\u200b-\u200f\u2060\ufeff\U000e0000-\U000e007f]")
SPAN_OF_CELL = re.compile(r"[1-9]\d?")

# How a currency sign, a sign that ends a figure, the dash of a range, a figure, a year and a note are written, and how long names may be.
SYMBOL = r"^(?:US|C|A|HK)?[$€£¥]$"
CLOSER = r"^(?:[)%]+|pts|bps)$"
DASH = r"^(?:[-–—]|to)$"
VALUE = r"^\(?-?(?:US|C|A|HK)?[$€£¥]?\s?\d[\d,]*(?:\.\d+)?\s?%?\)?%?$"
YEAR, ANY_YEAR, NOTE = r"^(?:19|20)\d{2}$", r"(?:19|20)\d{2}", r"^\(.+\)$"
SHORT_NAME, LONG_NAME = 40, 120
#: Pieces and characters after which a task hands on what it has read.
PIECES, CHARACTERS = 10_000, 4_000_000

PIECE = T.StructType(
    [
        T.StructField("block", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
        T.StructField("text", T.StringType()), T.StructField("th", T.BooleanType()), T.StructField("carried", T.BooleanType()), T.StructField("caption", T.StringType()),
    ]
)


def normalize(text: str) -> str:
    """One line of comparable text; raised digits are marked, so that a note's number doesn't join a figure."""
    if text.isascii():  # nothing to mark, compose or drop
        return " ".join(text.split())
    text = SUPERSCRIPT.sub(lambda m: "^" + m.group(), text)
    return " ".join(NOTHING.sub("", unicodedata.normalize("NFKC", text)).split())


class Table:
    """A table that is being read: its place among the blocks, its rows of (text, header, columns, rows) and its caption."""

    def __init__(self, block: int):
        self.block, self.rows, self.caption, self.cell = block, [], "", None

    def pieces(self) -> Iterator[tuple]:
        """The cells on the grid. One that spans rows is carried into the rows below, whose own cells take the columns that are left."""
        carry: list[tuple[tuple, int]] = []
        for r, row in enumerate(self.rows):
            placed, later, column = [c for c, _ in carry], [], 0
            taken = [(c[0], c[1]) for c in placed]
            for text, th, columns, rows in row:
                while over := [last for first, last in taken if first <= column <= last]:
                    column = over[0] + 1
                cell = (column, column + columns - 1, text, th)
                placed.append((*cell, False))
                if rows > 1:
                    later.append(((*cell, True), rows - 1))
                column += columns
            carry = [(c, n - 1) for c, n in carry if n > 1] + later
            yield from ((self.block, "table_row", r, first, last, text, th, carried, self.caption or None) for first, last, text, th, carried in placed)


class Reader(HTMLParser):
    """Collects PIECE tuples: blocks of text, and the cells of tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[tuple] = []
        self.words: list[str] = []
        self.kind, self.hidden, self.stack, self.block = "paragraph", 0, [], 0
        self.tables: list[Table] = []

    def close_block(self):
        text = normalize("".join(self.words))
        self.words = []
        if text and not self.tables:
            self.pieces.append((self.block, self.kind, None, None, None, text, False, False, None))
            self.block += 1

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in VOID:
            self.words.append(" " if tag == "br" else "")
            return
        unseen = tag in HIDDEN or "hidden" in a or a.get("aria-hidden") == "true" or bool(INVISIBLE.search(a.get("style") or ""))
        self.stack.append((tag, unseen))
        self.hidden += unseen
        if self.hidden:
            return
        if tag == "sup":
            self.words.append("^")
        if tag not in BLOCKS:
            return
        inside = self.tables[-1] if self.tables else None
        if tag == "table":
            if inside is None:
                self.close_block()
            self.tables.append(Table(self.block))
            self.block += 1
        elif inside is None:
            self.close_block()
            note = "footnote" in f"{a.get('class') or ''} {a.get('id') or ''}".lower()
            self.kind = "footnote" if note else "heading" if re.fullmatch("h[1-6]", tag) else "caption" if tag == "figcaption" else "paragraph"
        elif tag in ("td", "th"):
            self.words = []
            span = lambda k: int(a[k]) if SPAN_OF_CELL.fullmatch((a.get(k) or "").strip()) else 1
            inside.cell = (tag == "th", span("colspan"), span("rowspan"))
        elif tag == "tr":
            inside.rows.append([])
        else:
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self.stack]:
            return
        while self.stack:
            last, unseen = self.stack.pop()
            was = self.hidden
            self.hidden -= unseen
            if not was:
                self.end(last)
            if last == tag:
                break

    def end(self, tag):
        inside = self.tables[-1] if self.tables else None
        if inside is None:
            if tag in BLOCKS:
                self.close_block()
                self.kind = "paragraph"
        elif tag in ("td", "th") and inside.cell:
            text = normalize("".join(self.words))
            if not inside.rows:
                inside.rows.append([])
            inside.rows[-1].append((text, *inside.cell))
            self.words, inside.cell = [], None
        elif tag == "caption":
            inside.caption, self.words = normalize("".join(self.words)), []
        elif tag == "table":
            self.pieces += inside.pieces()
            self.tables.pop()
            self.words = []
        elif tag in BLOCKS:
            self.words.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def read_page(text: str) -> list[tuple]:
    reader = Reader()
    reader.feed(text)
    reader.close()
    reader.close_block()
    return reader.pieces


def pieces(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """doc and PIECE of every page: the only step that reads markup. A null page has none."""
    schema = T.StructType([T.StructField("doc", pages.schema[doc].dataType), *PIECE.fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"integer": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

        def handed_on(docs, at: list[int], read: list[tuple]):
            columns = [pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(zip(*read), PIECE.fields)]
            return pa.RecordBatch.from_arrays([docs.take(pa.array(at, pa.int32())), *columns], names=schema.names)

        for batch in batches:  # many pages make one batch, as a batch costs more than a page
            docs, at, read, n = batch.column(0), [], [], 0
            for i, text in enumerate(batch.column(1)):
                found = read_page(text.as_py() or "")
                at += [i] * len(found)
                read += found
                n += sum(len(p[5]) for p in found)
                if len(read) >= PIECES or n >= CHARACTERS:
                    yield handed_on(docs, at, read)
                    at, read, n = [], [], 0
            if read:
                yield handed_on(docs, at, read)

    return pages.selectExpr(f"`{doc}` as d", f"`{html}` as h").mapInArrow(run, schema)


TABLE = ["doc", "block"]
ROW = [*TABLE, "row"]


def is_value(text: Column) -> Column:
    """A figure; a year is a column's name far more often."""
    return text.rlike(VALUE) & ~text.rlike(YEAR)


def with_header_rows(cells: DataFrame) -> DataFrame:
    """The cells of rows that hold text, with head: whether the row is one of the table's leading header rows.

    Such a row is all header cells; or only a note in brackets; or holds no figure, and either its name is empty or a note, or the others are short names of
    periods, or it is the first (or, below it, the second) to name columns. Titles above count if header rows follow.
    """
    row = W.partitionBy(*ROW)
    own = (F.col("text") != "") & ~F.col("carried")
    cells = cells.withColumn("own", own).withColumn("filled", F.max("own").over(row)).where("filled").drop("filled")
    text = F.col("text")
    other = F.col("own") & (F.col("first") != 0)
    every = lambda test: F.coalesce(F.min(F.when(other, test)), F.lit(True))
    label = F.coalesce(F.max(F.when(F.col("own") & (F.col("first") == 0), text)), F.lit(""))
    rows = cells.groupBy(*ROW).agg(
        F.max(other).alias("others"), label.alias("name"), F.coalesce(F.min(F.when(F.col("own"), F.col("th"))), F.lit(False)).alias("all_th"), F.coalesce(F.max(F.when(other, is_value(text))), F.lit(False)).alias("figures"),
        every((F.length("text") <= SHORT_NAME) & text.rlike(ANY_YEAR)).alias("periods"), every(F.length("text") <= LONG_NAME).alias("fits"), every((F.length("text") <= SHORT_NAME) & ~text.rlike("[0-9]")).alias("names"),
    )
    order = W.partitionBy(*TABLE).orderBy("row")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("named", (F.col("name") != "") & ~F.col("name").rlike(NOTE))
    so_far = lambda c: F.coalesce(F.max(c).over(before), F.lit(False))
    rows = rows.withColumns({"columns_named": so_far(F.col("others")), "names_seen": so_far(F.col("named") & F.col("others")), "more": F.lead("row").over(order).isNotNull()})
    title = ~F.col("others") & F.col("named") & ~F.col("columns_named")
    first_names, second_names = ~F.col("columns_named") & F.col("more") & F.col("fits"), F.col("columns_named") & ~F.col("names_seen") & F.col("names")
    plain = F.col("others") & ~F.col("figures") & (~F.col("named") | F.col("periods") | first_names | second_names)
    note = ~F.col("others") & (F.col("name") != "") & ~F.col("named")
    rows = rows.withColumn("title", title).withColumn("may", title | F.col("all_th") | note | plain)
    rows = rows.withColumn("leading", F.min("may").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = W.partitionBy(*TABLE)
    follow = F.max(F.col("leading") & (F.col("others") | ~F.col("title"))).over(whole)
    return cells.join(rows.select(*ROW, (F.col("leading") & follow).alias("head")), ROW)


def header_cells(cells: DataFrame) -> DataFrame:
    """doc, block, h_row, h_first, h_last, h_text of the cells that name columns. A row name that ends in a comma is the first half of the years beside it."""
    row = W.partitionBy(*ROW)
    names = (F.col("first") != 0) & (F.col("text") != "") & ~F.col("text").rlike(NOTE)
    label = F.max(F.when(F.col("first") == 0, F.col("text"))).over(row)
    halves = label.endswith(",") & F.coalesce(F.min(F.when(names, F.col("text").rlike(YEAR))).over(row), F.lit(False))
    text = F.when(F.coalesce(halves, F.lit(False)), F.concat_ws(" ", label, "text")).otherwise(F.col("text"))
    return cells.where("head").withColumns({"names": names, "h_text": text}).where("names").select(*TABLE, F.col("row").alias("h_row"), F.col("first").alias("h_first"), F.col("last").alias("h_last"), "h_text")


def in_order(text: Column, *order: Column) -> Column:
    """Distinct texts of a group, in order, as one line."""
    listed = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*order, text.alias("t")))))
    return F.array_join(F.array_distinct(F.transform(listed, lambda x: x["t"])), " ")


def captions(cells: DataFrame) -> DataFrame:
    """doc, block, caption: the table's own, or the header rows' text that applies to every row: notes, titles, periods beside the names."""
    others = F.max((F.col("text") != "") & (F.col("first") != 0)).over(W.partitionBy(*ROW))
    kept = F.col("own") & (F.col("text").rlike(NOTE) | ((F.col("first") == 0) & (F.col("text").rlike(ANY_YEAR) | ~F.col("others"))))
    text = F.when(F.col("head") & kept, F.col("text"))
    out = cells.withColumn("others", others).groupBy(*TABLE).agg(F.max("caption").alias("own"), in_order(text, F.col("row"), F.col("first")).alias("kept"))
    return out.select(*TABLE, F.coalesce("own", F.nullif("kept", F.lit(""))).alias("caption"))


def row_values(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The data rows' names (doc, block, row, name) and values (doc, block, row, v, first, last, value).

    Signs in cells of their own are joined to their figure, and a dash directly between two figures joins them into one.
    """
    order = W.partitionBy(*ROW).orderBy("first")
    filled = cells.where(~F.col("head") & (F.col("text") != "")).select(*ROW, "first", "last", "text")
    filled = filled.withColumns({"n": F.row_number().over(order), "of": F.count(F.lit(1)).over(W.partitionBy(*ROW))})
    text = F.col("text")
    no_name = is_value(text) | text.rlike(SYMBOL) | text.rlike(DASH)
    filled = filled.withColumn("is_name", (F.col("n") == 1) & ((F.col("first") == 0) | ((F.col("of") > 1) & ~no_name)))
    names = filled.where("is_name").select(*ROW, F.col("text").alias("name"))
    rest = filled.where("not is_name")
    symbol = text.rlike(SYMBOL)
    rest = rest.withColumns({"symbol": symbol, "body": ~symbol & ~text.rlike(CLOSER)})
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ended = F.last(F.when(~F.col("symbol"), F.col("last")), ignorenulls=True).over(before)
    rest = rest.withColumns({"ended": ended, "after": F.lead("text").over(order), "after_first": F.lead("first").over(order)})
    range_ = text.rlike(DASH) & (F.col("ended") == F.col("first") - 1) & (F.col("after_first") == F.col("last") + 1) & (is_value(F.col("after")) | F.col("after").rlike(YEAR))
    rest = rest.withColumn("dash", F.coalesce(range_, F.lit(False)))
    joined = F.coalesce(F.lag("dash").over(order), F.lit(False))
    ends_one = ~F.col("body") & ~F.col("symbol") & F.col("ended").isNotNull()
    rest = rest.withColumn("starts", ~F.col("symbol") & ~ends_one & ~F.col("dash") & ~joined).withColumn("uses", F.col("starts") | (joined & F.col("body") & ~F.col("dash")))
    rest = rest.withColumns({"v": F.sum(F.col("starts").cast("int")).over(order), "used": F.coalesce(F.sum(F.col("uses").cast("int")).over(before), F.lit(0))})
    sign = F.last(F.when(F.col("symbol"), text), ignorenulls=True).over(W.partitionBy(*ROW, "used").orderBy("first").rowsBetween(W.unboundedPreceding, -1))
    part = F.when(F.col("symbol"), "").when(F.col("uses"), F.concat(F.coalesce("sign", F.lit("")), text)).when(F.col("dash"), F.concat(F.lit(" "), text, F.lit(" "))).otherwise(text)
    rest = rest.withColumn("sign", sign).withColumn("part", part)
    at_start = lambda c: F.max(F.when(F.col("starts"), F.col(c))).alias(c)
    parts = F.array_sort(F.collect_list(F.struct("n", "part")))  # of one figure
    values = rest.where("v > 0").groupBy(*ROW, "v").agg(at_start("first"), at_start("last"), F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("value"))
    return names, values


def table_rows(cells: DataFrame) -> DataFrame:
    """doc, block, row, text: each data row as `caption | name | header: value | …`. Stacked headers of a value's columns are read downward; a value that has none takes those of the column before it."""
    cells = materialize(with_header_rows(cells), "html-cells")  # names, values, headers and captions all start from these
    names, values = row_values(cells)
    values = materialize(values, "html-values")
    heads = header_cells(cells)
    near = values.join(heads, TABLE).where((F.col("h_first") <= F.col("last")) & (F.col("h_last") >= F.col("first") - 1))
    over = F.col("h_last") >= F.col("first")
    beside = (F.col("h_first") <= F.col("first") - 1) & (F.col("h_last") >= F.col("first") - 1)
    place = (F.col("h_row"), F.col("h_first"))
    named = near.groupBy(*ROW, "v").agg(in_order(F.when(over, F.col("h_text")), *place).alias("over"), in_order(F.when(beside, F.col("h_text")), *place).alias("beside"))
    values = values.join(named, [*ROW, "v"], "left").withColumn("header", F.coalesce(F.nullif("over", F.lit("")), F.nullif("beside", F.lit(""))))
    said = F.when(F.col("header").isNotNull(), F.concat_ws(": ", "header", "value")).otherwise(F.col("value"))
    lines = values.groupBy(*ROW).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", said.alias("said")))), lambda x: x["said"]), " | ").alias("values"))
    rows = cells.where("not head").select(*ROW).distinct().join(names, ROW, "left").join(lines, ROW, "left").join(captions(cells), TABLE, "left")
    return rows.select(*ROW, F.concat_ws(" | ", "caption", "name", "values").alias("text"))


def spans(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """doc, i, kind, text, start, end: a page's blocks in order with offsets into their text joined by blank lines. A null page has none."""
    read = materialize(pieces(pages, doc, html), "html-pieces")  # markup is read once
    cells = read.where("row is not null")
    rows = table_rows(cells).withColumn("kind", F.lit("table_row"))
    every = read.where("row is null").select(*ROW, "text", "kind").unionByName(rows.where("text <> ''"))
    order = W.partitionBy("doc").orderBy("block", "row")
    end = F.sum(F.length("text") + 2).over(order) - 2
    return every.select("doc", (F.row_number().over(order) - 1).alias("i"), "kind", "text", (end - F.length("text")).cast("int").alias("start"), end.cast("int").alias("end"))
