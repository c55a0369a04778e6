"""Suffix-array dedup: longest-previous-factor arrays over bytes.

Positions in suffix order with the previous and the next smaller document give each
position's longest factor that an earlier document has. The array is built over blocks, each a partition of stretches that
share anchors (see windows.py; a stretch can share a window with no other block). Only
whether a factor is as long as a window matters, so suffixes are compared, and factors measured, up to that length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.windows import Windows, remove_repeats, smaller_neighbours, suffix_ranks


def longest_previous(tok: np.ndarray, at: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """For each position of `at`, `depth` if the `depth` tokens there also start at one of them with a smaller `doc`, else 0.

    Positions are in suffix order; where suffixes differ within `depth`, a factor is shorter than asked, so
    smaller neighbours are sought within each run of suffixes that agree so far. Any smaller document of a run
    makes the previous or the next one exist.
    """
    rank = suffix_ranks(tok, depth, at)
    order = np.argsort(rank, kind="stable")
    r = rank[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
    stop = np.append(first[1:], len(r))
    prev, nxt = smaller_neighbours(doc[order], np.repeat(first, stop - first), np.repeat(stop, stop - first))
    out = np.empty(len(at), np.int64)
    out[order] = np.where((prev >= 0) | (nxt >= 0), depth, 0)
    return out


def kernel(spec: Windows, tok: np.ndarray, off: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor at each position is a window; not so too near a stretch's end."""
    size = np.diff(off)
    into = np.arange(len(tok)) - np.repeat(off[:-1], size)
    starts = np.flatnonzero(into <= np.repeat(size, size) - spec.window)
    out = np.zeros(len(tok), bool)
    out[starts] = longest_previous(tok, starts, np.repeat(least, size)[starts], spec.window) >= spec.window
    return out


def suffix_dedup(docs: DataFrame, min_bytes: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Remove every byte covered by a `min_bytes` string that also starts in a document with a smaller id.

    Null texts count as empty. Equal ids never match each other; a null id is after no
    other, so its text stays whole, and gives nothing to others. Repeated rows each get a
    row. Other columns of `docs` come back in the struct `row`, whatever their names.
    Columns: id, row, n, n_removed, n_spans, kept_sha256, kept (null unless `with_text`;
    where a cut splits a character, its stray bytes show as U+FFFD).
    """
    return remove_repeats(docs, Windows("bytes", min_bytes, max(1, min(20, min_bytes // 2))), kernel, id_col, text_col, with_text)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from memlake.llm.common import table

    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
