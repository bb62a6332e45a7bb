"""Tables of pages: header rows, row names, figures in several cells, spans."""

import pytest

from claimspark.sources import html

CELL = {"h": "th", "d": "td"}


def table(*rows, caption=None):
    """Rows of cells; a cell is text, or (text, attributes), or (text, attributes, 'h')."""
    out = f"<caption>{caption}</caption>" if caption else ""
    for row in rows:
        out += "<tr>"
        for cell in row:
            text, attributes, kind = (cell, "", "d") if isinstance(cell, str) else (*cell, "d")[:3]
            out += f"<{CELL[kind]} {attributes}>{text}</{CELL[kind]}>"
        out += "</tr>"
    return f"<table>{out}</table>"


WIDE = 'colspan="2"'
CASES = {
    "years in plain cells are headers": (table(["", "2024", "2023"], ["Revenue", "10", "6"]), ["Revenue | 2024: 10 | 2023: 6"]),
    "stacked headers read downward": (table(["", ("Three months", WIDE)], ["", "2024", "2023"], ["Costs", "1", "2"]), ["Costs | Three months 2024: 1 | Three months 2023: 2"]),
    "half a date beside years": (table(["Year ended June 30,", "2024", "2023"], ["Costs", "1", "2"]), ["Costs | Year ended June 30, 2024: 1 | Year ended June 30, 2023: 2"]),
    "a note applies to every row": (table(["(in millions)", "2024"], ["Costs", "1"]), ["(in millions) | Costs | 2024: 1"]),
    "a title above headers": (table([("Results", WIDE)], ["", "2024"], ["Costs", "1"]), ["Results | Costs | 2024: 1"]),
    "signs in their own cells": (table(["", ("2024", 'colspan="3"'), ("2023", 'colspan="3"')], ["Share", "$", "10", ")%", "€", "7", "bps"]), ["Share | 2024: $10)% | 2023: €7bps"]),
    "a dash between figures is a range": (table(["", ("Guidance", 'colspan="3"'), "Actual"], ["Sales", "10", "to", "12", "11"]), ["Sales | Guidance: 10 to 12 | Actual: 11"]),
    "a dash alone is a figure": (table(["", "2024", "2023", "2022"], ["Sales", "10", "-", ""]), ["Sales | 2024: 10 | 2023: -"]),
    "a rowspan carries its cell": (table(["Region", "Item", "2024"], [("North", 'rowspan="2"'), "Sales", "1"], ["Costs", "2"]), ["North | Item: Sales | 2024: 1", "North | Item: Costs | 2024: 2"]),
    "a span beyond 99 is 1": (table(["", ("2024", 'colspan="150"'), "2023"], ["Sales", "1", "2"]), ["Sales | 2024: 1 | 2023: 2"]),
    "no header row": (table(["Sales", "1"], ["Costs", "2"]), ["Sales | 1", "Costs | 2"]),
    "text headers, then text": (table(["Number", "Description", "Form"], ["3.1", "By-laws", "10-K"]), ["3.1 | Description: By-laws | Form: 10-K"]),
    "all header cells": (table([("A", "", "h"), ("B", "", "h")], ["x", "1"]), ["x | B: 1"]),
    "an indented name": (table(["", "", "2024"], ["", "Sales", "1"]), ["Sales | 2024: 1"]),
    "empty rows go": (table(["", ""], ["Sales", "1"]), ["Sales | 1"]),
    "a caption": (table(["", "2024"], ["Sales", "1"], caption="Group"), ["Group | Sales | 2024: 1"]),
    "section names are data": (table(["", "2024"], ["Assets", ""], ["Cash", "1"]), ["Assets", "Cash | 2024: 1"]),
}


@pytest.fixture(scope="module")
def read(spark):
    names = list(CASES)
    pages = spark.createDataFrame([(i, f"<body>{CASES[n][0]}</body>") for i, n in enumerate(names)], "doc long, html string")
    out = {n: [] for n in names}
    for r in html.spans(pages).orderBy("doc", "i").collect():
        out[names[r["doc"]]].append(r["text"])
    return out


@pytest.mark.parametrize("name", CASES)
def test_table(read, name):
    assert read[name] == CASES[name][1]


def test_blocks(spark):
    page = """<div>One<p>Two</p>Three</div><p style="font-size:0.0em">no</p><p style="font-size: 0rem;">no</p><p style="font-size:0.5em">yes</p>
    <table><tr><td>a<table><tr><td>in</td><td>1</td></tr></table></td><td>2</td></tr></table><p>end"""
    rows = html.spans(spark.createDataFrame([(1, page), (2, ""), (3, None)], "doc long, html string")).orderBy("i").collect()
    assert [r["text"] for r in rows][:4] == ["One", "Two", "Three", "yes"] and rows[-1]["text"] == "end" and "in | 1" in [r["text"] for r in rows]
    assert all(b["start"] == a["end"] + 2 for a, b in zip(rows, rows[1:])) and all(r["end"] - r["start"] == len(r["text"]) for r in rows)
    assert html.spans(spark.createDataFrame([], "doc long, html string")).count() == 0
