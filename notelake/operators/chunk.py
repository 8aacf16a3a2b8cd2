"""Chunks: paragraphs packed greedily up to a number of characters, a fold per note."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def split_long(paragraph: str, target: int) -> list[str]:
    """A paragraph over one and a half targets falls apart at lines, then at sentences, then at ``target``."""
    if len(paragraph) * 2 <= target * 3:
        return [paragraph]
    out: list[str] = []
    for line in paragraph.split("\n"):
        parts = [line] if len(line) * 2 <= target * 3 else re.split(r"(?<=[.!?]) +", line)
        for part in parts:
            while len(part) * 2 > target * 3:
                out.append(part[:target])
                part = part[target:]
            if part.strip():
                out.append(part)
    return out


def chunk_text(text: str, target: int = 800) -> list[str]:
    """Pieces in order; one is closed when the next would take it past ``target`` characters."""
    pieces = [p for para in re.split(r"\n[ \t]*\n", text) if para.strip() for p in split_long(para.strip(), target)]
    out: list[str] = []
    for piece in pieces:
        if out and len(out[-1]) + 1 + len(piece) <= target:
            out[-1] += "\n" + piece
        else:
            out.append(piece)
    return out


def chunks(notes: DataFrame, target: int = 800) -> DataFrame:
    """(note, chunk_idx, text) of (note, body); a null or blank body has none."""
    kind = dict(notes.dtypes)["note"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, i, t) for n, body in zip(b["note"], b["body"]) for i, t in enumerate(chunk_text(body or "", target))]
            yield pd.DataFrame(rows, columns=["note", "chunk_idx", "text"])

    return notes.select("note", "body").mapInPandas(cut, f"note {kind}, chunk_idx int, text string")
