"""Packing token sequences by exact complements of single, pair and triple lengths.

Documents become ids, pieces of at most ``capacity`` ids, and a histogram of piece lengths: at most
``capacity`` numbers, whatever the corpus.  A plan is made on the histogram alone.  It opens a
sequence with the longest length left and looks for one, two or three available lengths that fill
the gap exactly; while there are none, it adds the longest length that fits (best fit) and looks
again.  A pattern is used as often as the counts allow, so each one uses up a length and the plan
has at most a few thousand patterns.  Pieces then find their place by their rank among the pieces
of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T, Window as W

from splatlake.llm import query
from splatlake.llm.common import bound_batches, cut, slices, table

CAPACITY, END_ID = 4096, 1
CACHE_RUNS = 700_000
SLICE_CHARS = 2_000_000
MARKS = '.,!?;:&*$%#|"()-'  # no apostrophe: it opens suffixes


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of a text, looked up by runs between ASCII blanks: no token of this vocabulary spans one.

    New runs that are a Latin word, or one followed by marks, are put together from the lower-case
    word, which the vocabulary gives the same ids, and the marks, which are a token group of their
    own; new words are encoded many at a time
    and told apart by their word-end tokens.  A text that may hold an added token (``<|endoftext|>``)
    goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocabulary = self.tokenizer.get_vocab()
        # lower-case Latin words need none of the tokenizer's normalizers and no splitting but at blanks
        from tokenizers import pre_tokenizers

        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def learn(self, fresh: set[str]) -> None:
        known, words, tails, made, others = self.known, set(), set(), [], []
        for run in fresh:
            core = run.rstrip(MARKS)
            if core.isalpha():
                low = core.lower()
                if low.isascii() or (low.isalpha() and max(low) < "\u0370"):
                    if low not in known:
                        words.add(low)
                    if low != run:
                        tail = run[len(core):]
                        tails.add(tail)
                        made.append((run, low, tail))
                    continue
            others.append(run)
        self.learn_words(list(words))
        self.learn_others([*tails, *others])
        for run, low, tail in made:
            known[run] = known[low] + known[tail]

    def learn_words(self, words: list[str]) -> None:
        for k in range(0, len(words), 2048):
            part = words[k: k + 2048]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(part):
                raise ValueError("a word of letters is more than one token group in this vocabulary")
            raw, begin = ids.tobytes(), 0
            for word, end in zip(part, ends.tolist()):
                self.known[word] = raw[begin:end]
                begin = end

    def learn_others(self, runs: list[str]) -> None:
        for k in range(0, len(runs), 4096):
            part = runs[k: k + 4096]
            made = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(made.ids, "<u4")
            owner = np.array([-1 if w is None else w for w in made.word_ids], np.int64)
            begin = 0
            for run, end in zip(part, np.searchsorted(owner, np.arange(len(part)), side="right")):
                self.known[run] = ids[begin:end].tobytes()
                begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        special = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        whole = {k: np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes() for k in special}
        # the vocabulary is lower case; lowering plain ASCII first makes more runs alike
        runs = [[] if k in whole else (t.lower() if t.isascii() else t).replace("\n", " ").split(" ") for k, t in enumerate(texts)]
        every = set().union(*runs)
        if len(self.known) > CACHE_RUNS:
            self.known.clear()
        self.learn(every - self.known.keys())
        return [whole[k] if k in whole else b"".join(map(self.known.__getitem__, r)) for k, r in enumerate(runs)]


MODELS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder per worker process and vocabulary, kept between tasks."""
    if path not in MODELS:
        MODELS[path] = WordIds(path)
    return MODELS[path]


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth [, ids]): pieces and their rank per length within a task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        model, part = encoder(vocabulary), TaskContext.get().partitionId()
        counts = np.zeros(capacity + 1, np.int64)
        for pdf in slices(frames, "text", SLICE_CHARS):
            rows: list[tuple] = []
            for doc_id, ids in zip(pdf["doc_id"].tolist(), model.encode([t or "" for t in pdf["text"].tolist()])):
                ids += END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at: at + 4 * capacity]
                    length = len(own) // 4
                    rows.append((doc_id, k, at // 4, length, zlib.crc32(own), part, counts[length], *([own] if keep_ids else [])))
                    counts[length] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if keep_ids else [])])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, schema)


def fill_exactly(gap: int, counts: np.ndarray) -> list[int] | None:
    """One, two or three available lengths with the sum ``gap``, longest first."""
    def enough(*lengths: int) -> bool:
        return all(counts[x] >= lengths.count(x) for x in lengths)

    if counts[gap] > 0:
        return [gap]
    have = counts[: gap + 1] > 0
    pair = pair_with_sum(gap, have, counts)
    if pair:
        return pair
    for a in np.flatnonzero(have[: gap - 1])[::-1]:
        if 3 * a < gap:
            break
        rest = pair_with_sum(gap - int(a), have, counts)
        if rest and enough(int(a), *rest):
            return [int(a), *rest]
    return None


def pair_with_sum(gap: int, have: np.ndarray, counts: np.ndarray) -> list[int] | None:
    if gap < 2:
        return None
    low = np.arange(1, gap // 2 + 1)
    hits = np.flatnonzero(have[low] & have[gap - low])
    for k in hits[:2]:  # only the middle one, a twice, can lack a copy
        a, b = gap - int(low[k]), int(low[k])
        if a != b or counts[a] >= 2:
            return [a, b]
    return None


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(copies, lengths) patterns that use every piece of the histogram once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns: list[tuple[int, list[int]]] = []
    while counts.any():
        lengths, gap = [], capacity
        spare = counts.copy()
        while gap:
            if lengths and gap:
                rest = fill_exactly(gap, spare)
                if rest:
                    lengths += rest
                    break
            fits = np.flatnonzero(spare[: gap + 1])
            if not len(fits):
                break
            lengths.append(int(fits[-1]))
            spare[fits[-1]] -= 1
            gap -= int(fits[-1])
        used, times = np.unique(lengths, return_counts=True)
        copies = int((counts[used] // times).min())
        counts[used] -= copies * times
        patterns.append((copies, lengths))
    return patterns


def slots(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length the ranges of its ranks: first rank, first sequence, offset, copies."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    begin: dict[int, int] = {}
    sequence = 0
    for copies, lengths in patterns:
        offset = 0
        for length in lengths:
            out.setdefault(length, []).append((begin.get(length, 0), sequence, offset, copies))
            begin[length] = begin.get(length, 0) + copies
            offset += length
        sequence += copies
    return {length: np.array(v, np.int64) for length, v in out.items()}


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids]) for every piece of (doc_id, text).

    A null or empty text is the single end id.  Null ids and repeated rows are packed like others.
    An empty table gives an empty result; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    pieces = cut(tokenized_pieces(docs, vocabulary or default_vocabulary(), capacity, keep_ids))
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(per_task.select("length", "part", "n", before.alias("before")))
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = docs.sparkSession.sparkContext.broadcast(slots(plan_patterns(histogram, capacity)))  # bounded by the number of patterns

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(rows):
                    ranges = places.value[int(lengths[rows[0]])]
                    at = ranges[np.searchsorted(ranges[:, 0], ranks[rows], side="right") - 1]
                    sequence[rows], offset[rows] = at[:, 1] + ranks[rows] - at[:, 0], at[:, 2]
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    ranked = pieces.join(offsets.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "rank"]
    ranked = ranked.select(*names)
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "rank"]).add("sequence_id", T.LongType()).add("offset", T.LongType())
    return ranked.mapInPandas(place, schema)


@query("op7_exact_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
