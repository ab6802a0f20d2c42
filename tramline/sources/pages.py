"""Structured pages of transit providers, by a small event parser inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from tramline.functions import timeofday


class _Lines(HTMLParser):
    """Sections with a data-...-line attribute, and their stations in order."""

    def __init__(self) -> None:
        super().__init__()
        self.line, self.rows = None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        line = next((v for k, v in attrs if k.startswith("data-") and k.endswith("-line")), None)
        if line is not None:
            self.line = line
        if "data-station-name" in a and self.line is not None:
            at = (a.get("data-sequence") or "").strip()
            self.rows.append((self.line, a["data-station-name"], int(at) if at.isdigit() else None, (a.get("data-interchange") or "").lower() in ("true", "1", "yes")))

    def handle_endtag(self, tag):
        if tag == "section":
            self.line = None


class _Detail(HTMLParser):
    """Cells of table rows, and of rows of four divs below a row.sud block."""

    def __init__(self) -> None:
        super().__init__()
        self.cells, self.rows, self.depth, self.block = [], [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            self.cells.append("")
        elif tag == "div":
            self.depth += 1
            if {"row", "sud"} <= set((dict(attrs).get("class") or "").split()):
                self.block, self.cells = self.depth, []
            elif self.block and self.depth == self.block + 1:
                self.cells.append("")

    def handle_endtag(self, tag):
        if tag == "tr" and self.cells:
            self.rows.append(("field", [" ".join(c.split()) for c in self.cells]))
            self.cells = []
        elif tag == "div":
            if self.block == self.depth:
                self.rows.append(("call", [" ".join(c.split()) for c in self.cells]))
                self.block, self.cells = None, []
            self.depth -= 1

    def handle_data(self, data):
        if self.cells:
            self.cells[-1] += data


def metro_lines(pages: DataFrame) -> DataFrame:
    """Stations of structured line pages: page_id, line, name, seq, interchange."""

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, html in zip(frame["page_id"], frame["html"], strict=True):
                parser = _Lines()
                parser.feed(html or "")
                rows += [(page_id, *r) for r in parser.rows]
            yield pd.DataFrame(rows, columns=["page_id", "line", "name", "seq", "interchange"]).astype({"seq": "Int64"})

    return pages.select("page_id", "html").mapInPandas(read, "page_id bigint, line string, name string, seq bigint, interchange boolean")


def bus_detail(pages: DataFrame) -> DataFrame:
    """Rows of bus pages: page_id, kind (field or call), n and up to four cells; times that aren't any are null."""

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, html in zip(frame["page_id"], frame["html"], strict=True):
                parser = _Detail()
                parser.feed(html or "")
                rows += [(page_id, kind, n, *[*cells, None, None, None, None][:4]) for n, (kind, cells) in enumerate(parser.rows) if cells]
            yield pd.DataFrame(rows, columns=["page_id", "kind", "n", "a", "b", "c", "d"])

    return pages.select("page_id", "html").mapInPandas(read, "page_id bigint, kind string, n bigint, a string, b string, c string, d string")


def bus_calls(details: DataFrame) -> DataFrame:
    """The calls of bus_detail(): page_id, seq, stop, up, down; for mapping.up_down()."""
    from pyspark.sql import functions as F

    calls = details.filter("kind = 'call' and c <> ''")
    return calls.select(F.col("page_id").alias("id"), F.col("n").alias("seq"), F.col("c").alias("stop"), timeofday.usable(F.col("b")).alias("up"), timeofday.usable(F.col("d")).alias("down"))
