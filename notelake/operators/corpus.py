"""Every derived table of one snapshot of notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from notelake.operators import extract
from notelake.operators.chunk import chunks


def build_corpus(notes: DataFrame, embedder: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Lazy tables: notes, links, tags, facts, blocks, chunks and, with an embedder, vectors.

    ``embedder`` takes (note, chunk_idx, text) and adds an ``embedding``. Encrypted bodies are left out.
    """
    open_notes = notes.where("body is not null and not startswith(body, '-----ENCRYPTED')")
    cut = chunks(open_notes.selectExpr("path as note", "body"))
    parts = {
        "notes": open_notes,
        "links": extract.links(open_notes),
        "tags": extract.tags(open_notes).distinct(),
        "facts": extract.facts(open_notes),
        "blocks": extract.blocks(open_notes),
        "chunks": cut,
    }
    if embedder:
        parts["vectors"] = embedder(cut)
    return parts
