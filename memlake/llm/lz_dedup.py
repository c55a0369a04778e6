"""Substring dedup by relative Lempel-Ziv parsing over words.

Stretches of words under one anchor form the reference block of that anchor (see
windows.py); a stretch can share a window with no other block, so parsing it against its
block is parsing it against every block. A block is indexed by one suffix array. Each
stretch is factored greedily: the longest piece that a stretch of an earlier document
also has, or one word where none has any, and on from there. Windows within a factor are
repeats; those that start within one factor and end past it are looked up by themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.windows import Windows, dense, remove_repeats, smaller_neighbours


class Block:
    """A suffix array over stretches of words, each of a document."""

    def __init__(self, tok: np.ndarray, off: np.ndarray, doc: np.ndarray):
        size = np.diff(off)
        n = len(size)
        # each stretch ends with an own code, so that no factor passes its end
        self.start = off[:-1] + np.arange(n)
        self.doc = np.repeat(doc, size + 1)
        codes = np.empty(len(tok) + n, np.int64)
        end = np.zeros(len(codes), bool)
        end[self.start + size] = True
        codes[~end] = dense(tok) + n
        codes[end] = np.arange(n)
        self.ends = end
        # ranks[k] orders positions by the 2^k codes from there on; a place past the end comes first
        self.ranks = [dense(codes).astype(np.int32)]
        while 2 ** (len(self.ranks) - 1) <= int(size.max(initial=0)):
            r, step = self.ranks[-1].astype(np.int64), 2 ** (len(self.ranks) - 1)
            after = np.zeros(len(r), np.int64)
            after[:-step] = r[step:] + 1
            self.ranks.append(dense(r * (int(r.max(initial=0)) + 3) + after).astype(np.int32))
        self.order = np.argsort(self.ranks[-1], kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words that the suffixes at a and b begin with alike."""
        n, last = np.zeros(len(a), np.int64), len(self.ends) - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            same = (self.ranks[k][np.minimum(a + n, last)] == self.ranks[k][np.minimum(b + n, last)]) & (np.maximum(a, b) + n <= last)
            n += same << k
        return n

    def longest(self) -> np.ndarray:
        """For each position, the words from there on that a stretch of an earlier document has.

        The longest match is with one of the nearest suffixes of an earlier document on either side.
        """
        prev, nxt = smaller_neighbours(self.doc[self.order])
        out = np.zeros(len(self.order), np.int64)
        for near in (prev, nxt):
            some = np.flatnonzero(near >= 0)
            here = self.order[some]
            out[here] = np.maximum(out[here], self.common(here, self.order[near[some]]))
        return out


def parse(block: Block, window: int) -> np.ndarray:
    """Positions of the block whose window an earlier document has, by greedy factors of every stretch, all stretches a factor at a time."""
    longest = block.longest()
    inside, check = np.zeros(len(longest) + 1, np.int64), np.zeros(len(longest) + 1, np.int64)
    at = block.start[~block.ends[block.start]]
    while len(at):
        n = longest[at]
        long = n >= window
        np.add.at(inside, at[long], 1)
        np.add.at(inside, at[long] + n[long] - window + 1, -1)
        end = at + np.maximum(n, 1)
        low = np.maximum(at + 1, end - window + 1)
        np.add.at(check, low, 1)
        np.add.at(check, end, -1)
        at = end[~block.ends[end]]
    return (np.cumsum(inside)[:-1] > 0) | ((np.cumsum(check)[:-1] > 0) & (longest >= window))


def kernel(spec: Windows, tok: np.ndarray, off: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the window at each position is in a stretch of an earlier document."""
    block = Block(tok, off, least)
    return parse(block, spec.window)[~block.ends]


def lz_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Remove every word covered by a run of `min_words` words that also starts in a document with a smaller id.

    Words are runs of other than ASCII white space, unchanged. Null texts have none. Equal
    ids never match each other; a null id is after no other, so its text stays whole, and
    gives nothing to others. Repeated rows each get a row. Other columns come back in the
    struct `row`. Words are compared by 64-bit hashes.
    Columns: id, row, n, n_removed, n_spans, kept_sha256 (of the kept words joined by one
    space), kept (null unless `with_text`: the text itself where nothing went, else the
    kept words joined by one space).
    """
    return remove_repeats(docs, Windows("words", min_words, max(1, min(8, min_words // 2))), kernel, id_col, text_col, with_text)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from memlake.llm.common import table

    out = lz_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "n_removed", "kept_sha256")
