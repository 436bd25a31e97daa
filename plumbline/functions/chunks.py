"""Sentence-aware chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks(text: str | None, most: int = 3500) -> list[str]:
    """Pieces of at most `most` code points, cut after the last sentence end that fits, else at the last space, else hard."""
    rest, out = (text or "").strip(), []
    while len(rest) > most:
        head = rest[:most]
        ends = [m.end() for m in re.finditer(r"[.!?]\s", head)]
        cut = ends[-1] if ends else (head.rfind(" ") + 1 or most)
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return [x for x in [*out, rest] if x]


def chunked(docs: DataFrame, most: int = 3500) -> DataFrame:
    """(doc_id, chunk_no, chunk) of (doc_id, text)."""

    def run(frames):
        for f in frames:
            rows = [(d, i, c) for d, x in zip(f.doc_id, f.text, strict=True) for i, c in enumerate(chunks(x, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "chunk"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, chunk_no int, chunk string")
