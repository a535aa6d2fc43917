"""Byte-level BPE: boundaries by transition-function scans over codepoint classes, cached merges.

The splitting pattern is a small automaton over classes of code points (letter, number, space that
precedes text, and so on; look-ahead is part of the class).  The effect of a code point is a function from
states to states; functions compose associatively, so the text is cut into blocks, all blocks
compose their functions at once, block results are chained, and all blocks then replay from their
true first state.  No regular expression touches a text.  The slices between boundaries are merged
by rank once per distinct slice and worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from splatlake.llm import query
from splatlake.llm.common import bound_batches, slices, table

LETTER, NUMBER, OTHER, MARK1, MARK2, BLANKS, SPACE, BLANK, RESET = range(9)
# states: nothing open, in letters, in numbers, in other signs, in blanks, after a leading space, one or two letters of a suffix to come
NONE, LET, NUM, OTH, BLK, LEAD, ONE, TWO = range(8)
SLICE_CHARS = 500_000
CACHE_SLICES = 400_000
BLOCK = 128


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token begins) by class and state."""
    after = np.zeros((9, 8), np.uint8)
    begins = np.ones((9, 8), bool)
    for cls, state, joins in ((LETTER, LET, (LET, LEAD)), (NUMBER, NUM, (NUM, LEAD)), (OTHER, OTH, (OTH, LEAD)), (BLANKS, BLK, (BLK,))):
        after[cls] = state
        begins[cls, list(joins)] = False
    after[LETTER, ONE], after[LETTER, TWO] = NONE, ONE
    begins[LETTER, [ONE, TWO]] = False
    for cls, state in ((MARK1, ONE), (MARK2, TWO)):  # an apostrophe opens a suffix only where a token may begin
        after[cls] = state
        after[cls, [OTH, LEAD]] = OTH
        begins[cls, [OTH, LEAD]] = False
    after[SPACE], after[BLANK], after[RESET] = LEAD, NONE, NONE
    return after, begins


AFTER, BEGINS = automaton()
_BASE: list[np.ndarray] = []


def base_classes() -> np.ndarray:
    """Letter, number, blank or other for every code point, from the Unicode tables of ``regex``."""
    if not _BASE:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        out = np.full(0x110000, OTHER, np.uint8)
        for pattern, cls in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANKS)):
            for m in regex.finditer(pattern, every):
                skip = [c + 0x800 if c >= 0xD800 else c for c in (m.start(), m.end() - 1)]
                out[skip[0]: skip[1] + 1] = cls
        out[0xD800:0xE000] = OTHER
        _BASE.append(out)
    return _BASE[0]


def classes_of(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Class of each code point; ``resets`` are the separators that follow every text."""
    cls = base_classes()[points]
    cls[resets] = RESET
    blank = cls == BLANKS
    followed = np.append(cls[1:], RESET)
    last = blank & (followed != BLANKS) & (followed != RESET)
    cls[last] = np.where(points[last] == 0x20, SPACE, BLANK)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.append(points, [0, 0])
        padded[resets] = 0
        one, two = padded[quotes + 1], padded[quotes + 2]
        cls[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = MARK1
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        cls[quotes[long]] = MARK2
    return cls


def token_starts(cls: np.ndarray) -> np.ndarray:
    """Positions where a token begins, by composing the transition functions of blocks."""
    n = len(cls)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, RESET, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    made = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))  # each block's function so far
    for column in grid:
        made = AFTER[column[:, None], made]
    state = np.zeros(blocks, np.uint8)
    step, prefix = 1, made.copy()
    while step < blocks:  # prefix compositions by doubling
        prefix[step:] = np.take_along_axis(prefix[step:], prefix[:-step].astype(np.int64), axis=1)
        step *= 2
    state[1:] = prefix[:-1, NONE]
    begins = np.empty(grid.shape, bool)
    for k, column in enumerate(grid):
        begins[k] = BEGINS[column, state]
        state = AFTER[column, state]
    return np.flatnonzero(np.ascontiguousarray(begins.T).reshape(-1)[:n])


def split_texts(texts: list[str]) -> list[tuple[list[int], list[int]]]:
    """(starts, ends) of the tokens of every text, in code points."""
    joined = "\x00".join(texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = token_starts(classes_of(points, ends))
    cut_at = np.searchsorted(starts, ends)  # the separator itself always begins a token
    out, first = [], 0
    for begin, end, at in zip(ends - lengths, ends, cut_at):
        own = starts[first:at] - begin
        out.append((own.tolist(), [*own[1:].tolist(), int(end - begin)] if len(own) else []))
        first = at + 1
    return out


class Merges(dict):
    """Ids of a slice as bytes, merged by rank on first use."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece

    def __missing__(self, text: str) -> bytes:
        piece = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(piece)
        ids = [whole] if whole is not None else self.merge(piece)
        made = np.array(ids, "<u4").tobytes()
        if len(self) >= CACHE_SLICES:
            self.clear()
        if len(piece) <= 64:
            self[text] = made
        return made

    def merge(self, piece: bytes) -> list[int]:
        """Joins the neighbouring pair of lowest rank, leftmost first, until none is known."""
        if len(piece) > 256:
            return self.merge_long(piece)
        ranks, parts = self.ranks, [piece[i: i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = ranks.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same order of merges from a heap, for slices of any length."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n:
                rank = ranks.get(piece[a: end[b]])
                if rank is not None:
                    heapq.heappush(heap, (rank, a, end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, stop = heapq.heappop(heap)
            if not alive[a] or end[a] >= n or end[end[a]] != stop or not alive[end[a]]:
                continue
            alive[end[a]] = False
            end[a] = stop
            if stop < n:
                prev[stop] = a
            offer(a)
            if prev[a] >= 0:
                offer(prev[a])
        return [ranks[piece[a: end[a]]] for a in range(n) if alive[a]]


MODELS: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """One table per worker process, kept between tasks."""
    if path not in MODELS:
        MODELS[path] = Merges(path)
    return MODELS[path]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids, offsets) for every row of (doc_id, text).

    ``ids`` holds little-endian unsigned 32-bit ids; ``offsets`` the code points where the slices
    between boundaries begin, in the same form.  Null texts count as empty and have no ids; null ids
    and repeated rows are encoded like others; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    path = ranks or default_ranks()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = merges(path)
        for pdf in slices(frames, "text", SLICE_CHARS):
            texts = [t or "" for t in pdf["text"].tolist()]
            ids, offsets = [], []
            for text, (starts, ends) in zip(texts, split_texts(texts)):
                ids.append(b"".join([table_[text[a:b]] for a, b in zip(starts, ends)]))
                offsets.append(np.array(starts, "<u4").tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "offsets": offsets})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, ids binary, offsets binary")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``, to every row."""
    path = ranks or default_ranks()

    def bytes_of(ids: pd.Series) -> pd.Series:
        known = merges(path).bytes_of
        return pd.Series([b"".join([known[k] for k in np.frombuffer(x, "<u4").tolist()]) for x in ids], dtype=object)

    return encoded.withColumn("decoded", F.pandas_udf(bytes_of, "binary")("ids"))


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents")).select("doc_id", "ids"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
