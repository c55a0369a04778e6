"""SentencePiece encoding and decoding by suffix-array matching.

Texts of a batch are cut before each run of escaped spaces, where no piece can cross, and
the distinct cuts are concatenated. A suffix array indexes them to the longest piece's
length; every piece is binary-searched for its range of suffixes, which are its
occurrences; the occurrences are edges, sorted by the position where they end, and are relaxed
from left to right. For a BPE model the edge that ends the encoding of a prefix is the one
that starts where a prefix's encoding ends and whose piece would not have merged otherwise
with the piece there; there is just one, so relaxing finds the library's own ids.
Characters without a piece are bytes. Runs of two spaces or more, whose pieces share one
score, are merged step by step instead.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import table
from memlake.llm.windows import C1, U, mix, suffix_ranks

SPACE = "▁"
CUT = re.compile(f"{SPACE}+[^{SPACE}]*")
LIMIT = np.int64(2**40)
CHUNK = 3_000_000  # characters that are indexed at once
KEPT = 400_000  # cuts whose ids a process remembers


class Pieces:
    """A BPE model's pieces, in the order in which they merge."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        normal = [(i, sp.id_to_piece(i)) for i in range(n) if i not in special and not sp.is_byte(i)]
        single = [x for x in normal if len(x[1]) == 1]
        longer = sorted((x for x in normal if len(x[1]) > 1), key=lambda x: (-sp.get_score(x[0]), x[0]))
        self.score = {p: sp.get_score(i) for i, p in normal}
        self.id = np.array([i for i, _ in single + longer], np.int64)
        self.text = [p for _, p in single + longer]
        self.number = {p: k for k, p in enumerate(self.text)}
        self.out = [b"" if i in special else bytes([b]) if (b := next((b for b, j in self.byte.items() if j == i), None)) is not None else sp.id_to_piece(i).encode() for i in range(n)]
        # how each piece is built, and which pieces are ever built
        self.split = np.tile(np.arange(len(self.text)), (2, 1))
        valid = np.ones(len(self.text), bool)
        pairs = []
        for k in range(len(single), len(self.text)):
            p = self.text[k]
            if SPACE in p[1:]:
                valid[k] = False
                continue
            pairs += [(self.number[p[:i]], self.number[p[i:]], k) for i in range(1, len(p)) if p[:i] in self.number and p[i:] in self.number]
            last = self.merge(p, stop=2)
            if last is None or len(last) != 2:
                valid[k] = False
            else:
                self.split[:, k] = [self.number[x] for x in last]
        pairs.sort()
        a = np.array(pairs, np.int64).reshape(-1, 3)
        self.pair, self.joined = (a[:, 0] << 20) | a[:, 1], a[:, 2]
        self.searched = np.flatnonzero(valid)
        self.longest = max(len(self.text[k]) for k in self.searched)
        self.size = np.array([len(p) for p in self.text])
        self.codes = np.full((self.longest, len(self.searched)), -1, np.int64)
        for j, k in enumerate(self.searched.tolist()):
            for i, c in enumerate(self.text[k]):
                self.codes[i, j] = ord(c) + 1
        self.memo_key, self.memo = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.known: dict[str, bytes] = {}

    def merge(self, text: str, stop: int = 1) -> list[str] | None:
        """Merge the best pair, leftmost first, till none is left or `stop` parts are."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts if stop == 1 else None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a text of any length: pairs wait in a heap, best score and leftmost first."""
        part: list[str] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(part) and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, len(part[i]) + len(part[j])))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= len(part) or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has merged otherwise since
            part[i], part[j] = part[i] + part[j], ""
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in part if p]

    def stepwise(self, text: str) -> list[int]:
        out = []
        for p in self.merged(text):
            out += [int(self.id[self.number[p]])] if p in self.number else [self.byte[b] for b in p.encode()]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a, b side by side are what merging makes of their text."""
        key = (a << 20) | b
        slot = (mix(key.view(U) + C1) & U(len(self.memo) - 1)).astype(np.int64)
        hit = self.memo_key[slot] == key
        out = self.memo[slot]
        if not hit.all():
            ask, back = np.unique(key[~hit], return_inverse=True)
            ok = self._compatible(ask >> 20, ask & 0xFFFFF)
            out[~hit] = ok[back]
            self.memo_key[slot[~hit]], self.memo[slot[~hit]] = key[~hit], ok[back]
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), LIMIT)
        while len(live):
            x, y = a[live], b[live]
            key = (x << 20) | y
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            bad = (self.pair[at] == key) & (self.joined[at] < limit[live])
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            left = x > y
            # take back the later merge; where that side can't be split further, the other
            nx, ny = self.split[1][x], self.split[0][y]
            cut_x, cut_y = nx != x, ny != y
            use_x = np.where(left, cut_x, ~cut_y & cut_x)
            use_y = np.where(left, ~cut_x & cut_y, cut_y)
            limit[live] = np.where(use_x, x, np.where(use_y, y + 1, limit[live]))
            a[live], b[live] = np.where(use_x, nx, x), np.where(use_y, ny, y)
            live = live[use_x | use_y]
        return ok

    def ranges(self, tok: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that start with each searched piece, narrowed a character at a time."""
        lo, hi = np.zeros(len(self.searched), np.int64), np.full(len(self.searched), len(order), np.int64)
        padded = np.append(tok, np.zeros(self.longest, np.int64))
        for k in range(self.longest):
            live = np.flatnonzero((self.codes[k] >= 0) & (lo < hi))
            if not len(live):
                break
            want = self.codes[k, live]
            bounds = []
            for right in (False, True):
                a, b = lo[live].copy(), hi[live].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    c = padded[order[np.minimum(mid, len(order) - 1)] + k]
                    less = (c <= want) if right else (c < want)
                    a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
                bounds.append(a)
            lo[live], hi[live] = bounds
        return lo, hi

    def learn(self, cuts: list[str]) -> None:
        """Encode distinct cuts, each of one leading space at most, into `known`."""
        size = np.array([len(c) for c in cuts], np.int64)
        whole = "\0".join(cuts) + "\0"
        tok = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        end = np.cumsum(size + 1) - 1
        first = end - size
        tok[end] = 0  # what parts the cuts starts no piece and ends every match
        order = np.argsort(suffix_ranks(tok.view(U), self.longest))
        lo, hi = self.ranges(tok, order)
        count = hi - lo
        piece = np.repeat(self.searched, count)
        start = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        cut_of = np.repeat(np.arange(len(cuts)), size + 1)
        plain = np.ones(len(tok), bool)
        one = self.size[piece] == 1
        plain[start[one]] = False
        plain[end] = False
        unknown = np.flatnonzero(plain)
        start = np.r_[start, unknown]
        piece = np.r_[piece, np.full(len(unknown), -1)]
        length = np.where(piece < 0, 1, self.size[piece])
        stop = start + length
        step = stop - first[cut_of[start]]
        # edges by where they end within their cut, longest first
        by = np.lexsort((-length, stop, step))
        start, piece, length, stop, step = start[by], piece[by], length[by], stop[by], step[by]
        new = np.r_[True, stop[1:] != stop[:-1]] if len(stop) else np.empty(0, bool)
        head = np.flatnonzero(new)
        many = np.diff(np.append(head, len(stop)))
        level = step[head]
        last = np.full(len(tok) + 1, -2, np.int64)  # the piece that ends a prefix's encoding; -2 none
        last[first] = -3  # the start
        cut = np.flatnonzero(np.r_[True, level[1:] != level[:-1]]) if len(level) else np.empty(0, np.int64)
        for s, e in zip(cut.tolist(), np.append(cut[1:], len(head)).tolist(), strict=True):
            at, left = head[s:e].copy(), many[s:e].copy()
            while len(at):
                p, before = piece[at], last[start[at]]
                before = np.where(start[at] == first[cut_of[start[at]]], -3, before)
                ok = (before == -3) | ((p == -1) & (before != -2)) | (before == -1)
                ask = np.flatnonzero(~ok & (before >= 0) & (p >= 0))
                ok[ask] = self.compatible(before[ask], p[ask])
                last[stop[at[ok]]] = p[ok]
                keep = ~ok & (left > 1)
                at, left = at[keep] + 1, left[keep] - 1
        # back from each cut's end
        on = np.zeros(len(tok) + 1, bool)
        at = end[size > 0]
        begin = first[size > 0]
        while len(at):
            on[at] = True
            p = last[at]
            at = at - np.where(p < 0, 1, self.size[p])
            keep = at > begin
            at, begin = at[keep], begin[keep]
        where = np.flatnonzero(on)
        p = last[where]
        ids = np.where(p >= 0, self.id[p], -tok[where - 1])
        bound = np.r_[0, np.searchsorted(where, end, side="right")]
        odd = set(np.unique(cut_of[where[p < 0] - 1]).tolist())
        for i, c in enumerate(cuts):
            own = ids[bound[i] : bound[i + 1]]
            if i in odd:
                own = np.array([x for v in own.tolist() for x in ([v] if v >= 0 else [self.byte[b] for b in chr(-v - 1).encode("utf-8", "surrogatepass")])])
            self.known[c] = own.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian 32-bit numbers."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            held: list[list[str]] = []
            n = 0
            if len(self.known) > KEPT:
                self.known.clear()
            while i < len(texts) and (n == 0 or n + len(texts[i]) <= CHUNK):
                t = texts[i]
                held.append(CUT.findall(SPACE + t.replace(" ", SPACE)) if t else [])
                n += len(t) + 1
                i += 1
            new = {c for h in held for c in h} - self.known.keys()
            for c in [c for c in new if c.startswith(SPACE * 2) or "\0" in c]:
                new.discard(c)
                self.known[c] = np.array(self.stepwise(c), "<u4").tobytes()
            if new:
                self.learn(sorted(new))
            out += [b"".join([self.known[c] for c in h]) for h in held]
        return out

    def decode(self, ids: np.ndarray) -> str:
        t = b"".join([self.out[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return t[1:] if t.startswith(" ") else t


_model: tuple[str, Pieces] | None = None


def model(name: str) -> Pieces:
    global _model
    if _model is None or _model[0] != name:
        import public_tokenizers

        _model = (name, Pieces(public_tokenizers.path(name)))
    return _model[1]


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) of every document; a null or empty text has none. Repeated rows each get a row."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model(name).encode(b["text"].to_pylist())
            for s in range(0, len(got), 1000):
                part = got[s : s + 1000]
                flat = np.frombuffer(b"".join(part), "<u4").astype(np.int32)
                off = np.r_[0, np.cumsum([len(x) // 4 for x in part])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b["id"].slice(s, len(part)), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["id", "ids"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).mapInArrow(f, "id long, ids array<int>")


def decode(encoded: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """id, text of rows of `encode`; the escape of spaces itself comes back as a space. Null ids give an empty text."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = model(name)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([m.decode(np.array(x or [], np.int64)) for x in b["ids"].to_pylist()])], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(f, "id long, text string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids), decoded_sha256 (UTF-8), round_trip: whether decoding gives the text back."""
    name = "piece_bpe_32k.model"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, texts = model(name), b["text"].to_pylist()
            ids = m.encode(texts)
            back = [m.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == t for x, t in zip(back, texts, strict=True)])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(f, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
