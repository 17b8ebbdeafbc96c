"""Reading documents of several forms as text."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Block tags and what they become in Markdown.
HEADS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### "}
BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "br", "header", "footer", "main"}
SKIPPED = {"script", "style", "noscript", "template", "head"}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.line, self.skip = [], "", 0

    def _break(self) -> None:
        done = " ".join(self.line.split())
        if done and done not in ("-", *(h.strip() for h in HEADS.values())):
            self.lines.append(done)
        self.line = ""

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in HEADS or tag in BLOCKS or tag == "li":
            self._break()
            self.line = HEADS.get(tag, "- " if tag == "li" else "")
        elif tag in ("td", "th"):
            self.line += " "

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in HEADS or tag in BLOCKS or tag == "li":
            self._break()

    def handle_data(self, data):
        if not self.skip:
            self.line += data


def to_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    parser._break()
    return "\n".join(parser.lines)


def html_to_markdown(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, text) of HTML pages; null pages give empty texts."""

    def run(batches):
        for rows in batches:
            yield pd.DataFrame({id_col: rows[id_col], "text": [to_markdown(x) for x in rows[html_col]]})

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, text string")


def looks_like_markdown(text) -> F.Column:
    """Headings, lists, emphasis, links or fences anywhere in the text."""
    return text.rlike(r"(?m)^#{1,6} |^[-*+] |^\d+\. |^```|\*\*[^*]+\*\*|\[[^\]]+\]\([^)]+\)")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the files under a path: HTML as Markdown, all others as UTF-8 text, bad bytes replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        for rows in batches:
            texts = [bytes(c).decode("utf-8", "replace").removeprefix("﻿") for c in rows["content"]]
            yield pd.DataFrame({"path": rows["path"], "text": [to_markdown(x) if p.lower().endswith((".html", ".htm")) else x for p, x in zip(rows["path"], texts)]})

    return files.mapInPandas(run, "path string, text string")
