"""Visible text of HTML pages."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Subtrees without visible text, and tags that start a new line.
HIDDEN = ("script", "style", "noscript", "svg")
BLOCKS = ("p", "div", "section", "article", "main", "li", "h1", "h2", "h3", "h4", "br")

_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_REMARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
_RAW = re.compile(rf"<(script|style)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_HIDDEN = re.compile(rf"<(/?)({'|'.join(HIDDEN)})\b{_ATTRIBUTES}>", re.I)
_BLOCK = re.compile(rf"</?(?:{'|'.join(BLOCKS)})(?![\w:-]){_ATTRIBUTES}>", re.I)
_TAG = re.compile(rf"</?[a-zA-Z]{_ATTRIBUTES}>")


def _shown(page: str) -> str:
    """The page without hidden subtrees, which may lie in each other."""
    out, depth, at = [], 0, 0
    for m in _HIDDEN.finditer(page):
        if not depth:
            out.append(page[at : m.start()])
        depth = max(0, depth - 1) if m[1] else depth + 1
        at = m.end()
    return "".join(out) + ("" if depth else page[at:])


def visible_text(page: str) -> str:
    """Text outside hidden subtrees, a line a block, blanks collapsed, empty lines left out: first the parts without text
    are cut out, then block tags become line ends and other tags nothing, then entities are decoded."""
    page = _shown(_RAW.sub("", _REMARK.sub("", page)))
    text = entities.unescape(_TAG.sub("", _BLOCK.sub("\n", page)))
    lines = (" ".join(line.split()) for line in text.splitlines())
    return "\n".join(line for line in lines if line)


def pages_to_text(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(id_col, text)``; null pages stay null. Pages are gone through in batches."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({id_col: frame[id_col], "text": [None if h is None else visible_text(h) for h in frame[html_col]]})

    return df.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, text string")
