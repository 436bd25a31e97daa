"""HTML tables, links and titles from page sources."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES = "page_id long, table_no int, header array<string>, row_no int, cells array<string>"


def unique_headers(names: list[str]) -> list[str]:
    """Lower-cased headers; the n-th repetition of a name gets the suffix _n."""
    seen: dict[str, int] = {}
    out = []
    for name in (x.strip().lower() for x in names):
        out.append(f"{name}_{seen[name]}" if name in seen else name)
        seen[name] = seen.get(name, 0) + 1
    return out


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data) -> None:
        if self.cell is not None:
            self.cell.append(data)


def parse_tables(html: str | None, commented: bool = False) -> list[tuple[list[str], list[list[str]]]]:
    """(header, rows) of each table; rows of fewer than two cells go. With `commented`, tables inside comments count too."""
    text = html or ""
    if commented:
        text = text.replace("<!--", "").replace("-->", "")
    parser = _Tables()
    parser.feed(text)
    out = []
    for rows in parser.tables:
        rows = [r for r in rows if len(r) >= 2]
        if rows:
            out.append((unique_headers(rows[0]), rows[1:]))
    return out


def html_tables(pages: DataFrame, commented: bool = False) -> DataFrame:
    """A row per table row of (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(page, t, header, r, cells) for page, html in zip(frame.page_id, frame.html, strict=True) for t, (header, body) in enumerate(parse_tables(html, commented)) for r, cells in enumerate(body)]
            yield pd.DataFrame(rows, columns=["page_id", "table_no", "header", "row_no", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, TABLES)


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def links(html: Column) -> Column:
    """All href values of anchors in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))
