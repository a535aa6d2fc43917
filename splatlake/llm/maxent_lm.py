"""Document scores of a hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) x P(word | class).  Frequent words are classes of their own;
all others go by their last bytes, hashed to BUCKETS endings, and endings that follow alike words are
one class (k-means on counts of fixed size).  The class softmax is a log-linear model over four features of the history (none, the last
word, the word before it as a skip feature, both), each hashed to a row of CLASSES weights; within a
class the maximum-entropy distribution with one feature per word is the smoothed share of the word.

Training reads every training text once, dealt into ROUNDS parts.  In a round every task takes
gradient steps over its share from the common weights, and the changes are averaged by tokens
(mixture weights, Mann et al. 2009).  Weights have a fixed size.  Word counts are exact and stay
distributed: texts are scored with the frequent words at hand, and the others are joined by hash.
Words are told apart by 64-bit hashes; V distinct words hold V^2 / 2^65 colliding pairs on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from splatlake.llm import query
from splatlake.llm.common import bound_batches, byte_classes, cut, mix, slices, table

CLASSES, OWN = 64, 24  # classes, at most so many of them single words
ROWS, FEATURES = 1 << 13, 4  # weight rows, active features of a token
NEAR = 1 << 17  # a word with this share of all tokens, at least, is kept at hand: at most NEAR words
ROUNDS, BATCH, RATE = 4, 2048, 0.4
SUFFIX, BUCKETS, CONTEXTS = 3, 1 << 11, 32  # last bytes of a word, endings, and groups of endings before a word
SLICE_CHARS = 1_000_000
END = int(mix(np.array([0x0E5D], np.uint64))[0])  # hash of the end token, and of what stands before a text
WORD_STEP = 0x9E3779B97F4A7C15


def left_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending, text number) of every word and, behind each text, of its end."""
    ends = [lower(t) + b" \x00 " for t in texts]  # the end stands as a word of its own and is renamed below
    data = np.frombuffer(b"".join(ends), np.uint8)
    live = byte_classes(False)[data]
    edge = np.diff(live.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans = np.diff(np.concatenate(([0], starts[1:], [len(data)])))  # from one word to the next
    place = (np.arange(len(data)) - np.repeat(starts, spans)).clip(0)
    factor = mix((np.arange(int((stops - starts).max(initial=0)) + 4, dtype=np.uint64) + np.uint64(1)) * np.uint64(WORD_STEP)) | np.uint64(1)
    value = (data.astype(np.uint64) + np.uint64(1)) * factor[np.minimum(place, len(factor) - 1)] * live
    lengths = (stops - starts).astype(np.uint64)
    hashes = mix(np.add.reduceat(value, starts) + lengths * np.uint64(0xD6E8FEB86659FD93))
    tail = np.zeros(len(starts), np.uint64)
    for k in range(1, SUFFIX + 1):
        at = stops - k
        tail = tail * np.uint64(257) + np.where(at >= starts, data[at] + 1, 0).astype(np.uint64)
    owner = np.searchsorted(np.cumsum([len(e) for e in ends]), starts, side="right")
    last = np.flatnonzero(np.diff(owner, append=-1))
    hashes[last] = END
    return hashes, (mix(tail) % np.uint64(BUCKETS)).astype(np.int64), owner


def word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, ending, trained, n): counts of a slice of texts, in training texts and in all.

    A row without ending counts one cell of the table of endings behind endings, once for the task.
    """
    cells = np.zeros(BUCKETS * CONTEXTS, np.int64)
    for pdf in slices(frames, "text", 4 * SLICE_CHARS):
        hashes, ending, owner = tokens(pdf["text"].tolist())
        words, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        train = ~pdf["held_out"].to_numpy(bool)[owner]
        near = train[1:] & (owner[1:] == owner[:-1])
        cells += np.bincount(ending[1:][near] * CONTEXTS + ending[:-1][near] % CONTEXTS, minlength=len(cells))
        yield pd.DataFrame({"word": words.view(np.int64), "ending": ending[first], "trained": np.bincount(where, weights=train).astype(np.int64),
                            "n": np.bincount(where)})
    used = np.flatnonzero(cells)
    yield pd.DataFrame({"word": used, "ending": np.full(len(used), -1), "trained": cells[used], "n": cells[used]})


def ending_classes(cells: np.ndarray, count: int, rounds: int = 20) -> np.ndarray:
    """The class (0 to count - 1) of each ending: k-means on square roots of its shares of contexts."""
    mass = cells.sum(axis=1).astype(float)
    x = np.sqrt((cells + 0.1) / (mass + 0.1 * CONTEXTS)[:, None])
    centers = x[[int(np.argmax(mass))]]
    while len(centers) < count:  # the next centre is the heaviest and farthest ending
        far = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).min(axis=1)
        centers = np.vstack((centers, x[int(np.argmax(far * mass))]))
    for _ in range(rounds):
        of = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(count):
            if mass[of == c].sum() > 0:
                centers[c] = np.average(x[of == c], axis=0, weights=mass[of == c])
    return of


class Lexicon:
    """Frequent words by hash: their counts and classes; any other word has the class of its ending."""

    def __init__(self, words: np.ndarray, trained: np.ndarray, own: np.ndarray, endings: np.ndarray):
        self.endings = endings
        order = np.argsort(words)
        self.words, self.trained = words[order], trained[order]
        self.own = own[order]  # class number, or -1

    def find(self, hashes: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1, class)."""
        if not len(self.words):
            return np.full(len(hashes), -1), self.endings[ending]
        at = np.searchsorted(self.words, hashes).clip(max=len(self.words) - 1)
        at = np.where(self.words[at] == hashes, at, -1)
        own = np.where(at >= 0, self.own[at], -1)
        return at, np.where(own >= 0, own, self.endings[ending])


def history_rows(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """(FEATURES, tokens): the weight row of every active feature."""
    def back(k: int) -> np.ndarray:
        moved = np.concatenate((np.full(min(k, len(hashes)), END, np.uint64), hashes[:-k] if k < len(hashes) else hashes[:0]))
        same = np.concatenate((np.zeros(min(k, len(hashes)), bool), owner[k:] == owner[:-k]))
        return np.where(same, moved, np.uint64(END))

    one, two = back(1), back(2)
    rows = np.zeros((FEATURES, len(hashes)), np.int16)
    for k, h in enumerate((one, two * np.uint64(3), one * np.uint64(5) + two * np.uint64(7)), 1):
        rows[k] = 1 + (mix(h + np.uint64(k)) % np.uint64(ROWS - 1)).astype(np.int16)
    return rows


def odds(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logits with their maximum at 0, sums of their exponentials) of the classes for every token."""
    z = weights[rows[1]]
    for k in range(2, FEATURES):
        z += weights[rows[k]]
    z += weights[0]  # the feature of no history
    z -= z.max(axis=1, keepdims=True)
    return z, np.exp(z).sum(axis=1)


def log_class(weights: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Log probability of the class of every token."""
    z, total = odds(weights, rows)
    return z[np.arange(len(cls)), cls] - np.log(total)


def row_sums(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the rows from each cut to the next: second, third, ... rows of all runs at once, then long runs one by one."""
    lengths = np.diff(np.append(cuts, len(x)))
    out, left, n = x[cuts], np.flatnonzero(lengths > 1), 1
    while n < 8 and len(left) > 3:
        out[left] += x[cuts[left] + n]
        n += 1
        left = left[lengths[left] > n]
    for k in left:
        out[k] += x[cuts[k] + n: cuts[k] + lengths[k]].sum(axis=0)
    return out


def gradient_step(weights: np.ndarray, scale: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> None:
    """One step on a batch; ``scale`` sums the squared gradients of each row (Duchi et al. 2011)."""
    d, total = odds(weights, rows)
    np.exp(d, out=d)
    d /= total[:, None]
    d[np.arange(len(cls)), cls] -= 1
    for k in range(FEATURES):
        if k:
            order = np.argsort(rows[k], kind="stable")
            mine = rows[k][order]
            cuts = np.flatnonzero(np.diff(mine, prepend=-1))
            used, g = mine[cuts], row_sums(d[order], cuts)
        else:
            used, g = np.array([0]), d.sum(axis=0, keepdims=True)
        scale[used] += (g * g).mean(axis=1)
        weights[used] -= (RATE / np.sqrt(scale[used] + 1.0))[:, None].astype(np.float32) * g


def trained_weights(docs: DataFrame, lexicon: Lexicon, class_totals: np.ndarray) -> np.ndarray:
    """Class weights from all training texts; (ROWS, CLASSES) numbers whatever the corpus."""
    spark = docs.sparkSession
    weights = np.zeros((ROWS, CLASSES), np.float32)
    weights[0] = np.log((class_totals + 1) / (class_totals.sum() + CLASSES))
    for part in range(ROUNDS):
        shared = spark.sparkContext.broadcast((weights, lexicon))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start, words = shared.value
            w, scale, seen = start.copy(), np.zeros(ROWS), 0
            for pdf in slices(frames, "text", SLICE_CHARS):
                hashes, ending, owner = tokens(pdf["text"].tolist())
                _, cls = words.find(hashes, ending)
                rows = history_rows(hashes, owner)
                for at in range(0, len(cls), BATCH):
                    gradient_step(w, scale, rows[:, at: at + BATCH], cls[at: at + BATCH])
                seen += len(cls)
            if seen:
                moved = (w - start).astype(np.float64) * seen
                used = np.flatnonzero(np.abs(moved).sum(axis=1))
                yield pd.DataFrame({"row": used, "moved": list(moved[used]), "seen": seen})

        mine = docs.where(~F.col("held_out") & (F.col("part") == part)).select("text")
        made = mine.mapInPandas(run, "row int, moved array<double>, seen bigint")
        sums = made.select("row", "seen", *[F.col("moved")[c].alias(f"m{c}") for c in range(CLASSES)]).groupBy("row").agg(
            F.sum("seen").alias("seen"), *[F.sum(f"m{c}").alias(f"m{c}") for c in range(CLASSES)])
        got = sums.toPandas()  # at most ROWS rows
        if len(got):
            # a row that a task never met has no say in its mean
            weights[got["row"].to_numpy()] += (got[[f"m{c}" for c in range(CLASSES)]].to_numpy() / got["seen"].to_numpy()[:, None]).astype(np.float32)
        shared.unpersist()
    return weights


def document_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of (doc_id, text).

    Null, empty and blank texts have one token, the end.  Rows with null ids are learned from and
    scored; repeated rows count and are scored each.  Without any training text every word is
    unknown: base_score is 0 (one word, the unseen one) and the classes are equally likely.  An empty
    table gives an empty result; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), left_out(F.col("doc_id")).alias("held_out"))
    sums = cut(rows.select("text", "held_out").mapInPandas(word_counts, "word bigint, ending int, trained bigint, n bigint").groupBy(
        F.col("ending") < 0, "word").agg(F.min("ending").alias("ending"), F.sum("trained").alias("trained"), F.sum("n").alias("n")))
    counts = sums.where("ending >= 0").select("word", "ending", "trained", "n")
    table_ = sums.where("ending < 0").select("word", "n").toPandas()  # BUCKETS x CONTEXTS rows at most
    cells = np.zeros(BUCKETS * CONTEXTS, np.int64)
    cells[table_["word"].to_numpy(np.int64)] = table_["n"]
    endings = OWN + ending_classes(cells.reshape(BUCKETS, CONTEXTS), CLASSES - OWN)
    total = counts.agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"), F.sum(F.when(F.col("trained") > 0, 1)).alias("words")).first()
    all_n, n_train, n_words = (total[k] or 0 for k in ("n", "trained", "words"))
    near = counts.where(F.col("n") * NEAR >= all_n).select("word", "trained").toPandas()  # NEAR rows at most
    trained = near["trained"].to_numpy(np.int64)
    words = near["word"].to_numpy(np.int64)
    often = np.flatnonzero(trained * OWN >= max(n_train, 1))  # OWN words at most
    own = np.full(len(near), -1)
    own[often] = np.argsort(np.argsort(words[often]))
    lexicon = Lexicon(words.view(np.uint64), trained, own, endings)
    # tokens and distinct words of each class, without those that are a class of their own
    rest = counts.where("trained > 0").where(~F.col("word").isin(words[often].tolist()))
    class_n, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest.groupBy("ending").agg(F.sum("trained").alias("n"), F.count("*").alias("words")).collect():  # BUCKETS rows at most
        class_n[endings[r["ending"]]] += r["n"]
        class_words[endings[r["ending"]]] += r["words"]
    class_n[own[often]], class_words[own[often]] = trained[often], 1
    parts = rows.withColumn("part", F.pmod(F.xxhash64("text", "doc_id"), F.lit(ROUNDS)))
    weights = trained_weights(parts, lexicon, class_n)
    scored = cut(scored_texts(rows.withColumn("rid", F.monotonically_increasing_id()), weights, lexicon, class_n, class_words))
    far = scored.select("rid", F.explode("far").alias("word")).join(counts.select("word", "trained"), "word").select(
        "rid", F.log10(F.col("trained") + 1).alias("logs"), F.when(F.col("trained") > 0, 1).otherwise(0).alias("known"))
    whole = scored.select("rid", "logs", "known", "doc_id", "held_out", "n_tokens", "class_logs").unionByName(far, allowMissingColumns=True).groupBy("rid").agg(
        F.sum("logs").alias("logs"), F.sum("known").cast("bigint").alias("n_known"), *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "class_logs")])
    return whole.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"),
                        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n_train + n_words + 1)))).alias("base_score"),
                        (F.col("logs") + F.col("class_logs")).alias("score"))


def scored_texts(rows: DataFrame, weights: np.ndarray, lexicon: Lexicon, class_n: np.ndarray, class_words: np.ndarray) -> DataFrame:
    """Per text what the frequent words and the classes give, and the hashes of all other words (``far``)."""
    # a class of one word has no room for unseen ones: they have the class of their ending
    room = np.log10(np.where(np.arange(CLASSES) < OWN, class_n + 1, class_n + class_words + 1))
    shared = rows.sparkSession.sparkContext.broadcast((weights, lexicon, room))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, words, denominators = shared.value
        for pdf in slices(frames, "text", SLICE_CHARS // 2):
            hashes, ending, owner = tokens(pdf["text"].tolist())
            at, cls = words.find(hashes, ending)
            features = history_rows(hashes, owner)
            logs = np.empty(len(cls))
            for a in range(0, len(cls), BATCH):
                some = slice(a, a + BATCH)
                logs[some] = log_class(w, features[:, some], cls[some])
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            total = lambda v: np.add.reduceat(v, starts)
            trained = np.where(at >= 0, words.trained[at] if len(words.trained) else 0, 0)
            away = at < 0
            far = np.split(hashes[away].view(np.int64), np.cumsum(total(away.astype(np.int64)))[:-1])
            yield pd.DataFrame({"rid": pdf["rid"].to_numpy(), "doc_id": pdf["doc_id"].to_numpy(), "held_out": pdf["held_out"].to_numpy(),
                                "n_tokens": np.diff(np.append(starts, len(hashes))), "known": total((trained > 0).astype(np.int64)),
                                "logs": total(np.where(at >= 0, np.log10(trained + 1.0), 0.0)),
                                "class_logs": total(logs / np.log(10) - denominators[cls]), "far": far})

    return rows.select("rid", "doc_id", "held_out", "text").mapInPandas(
        run, "rid bigint, doc_id string, held_out boolean, n_tokens bigint, known bigint, logs double, class_logs double, far array<bigint>")


@query("op12_maxent_scores")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_scores(table(spark, sf_dir, "documents"))
