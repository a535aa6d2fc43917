"""Quality rules: a decision list learned by sequential covering, emitted as one CASE expression.

Statistics of a text are SQL expressions, computed once.  Learning never sees a text: candidate
thresholds are quantiles of the labelled statistics, and every step of growing or pruning a rule is
one aggregation that counts good and bad rows per statistic and threshold.  The driver holds these
counts only, at most statistics x thresholds x 2.  A rule is a conjunction of thresholds that
rejects; the list is ordered, and what no rule takes is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from splatlake.llm import query
from splatlake.llm.common import LETTERS, cut, held_out, labelled, table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
THRESHOLDS, MAX_RULES, MAX_TERMS = 16, 6, 3
SURE = 0.9  # share of bad rows, smoothed, that a rule needs on both halves of the labelled rows
STATISTICS = ["words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks", "distinct"]


def without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """Base counts of every row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and three more.

    Null texts count as empty.  A word in a 5-word window that occurs twice or more in the text
    counts once in n_repeat_words, however many windows cover it.
    """
    t = F.coalesce("text", F.lit(""))
    d = docs.withColumn("_t", t).withColumn("_h", F.transform(F.filter(F.split("_t", r"[ \t-\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    d = d.withColumn("n_words", F.size("_h").cast("bigint"))
    h = F.col("_h")
    windows = F.when(F.col("n_words") > 5, F.transform(F.sequence(F.lit(0), F.size("_h") - 5), lambda i: F.xxhash64(*[h[i + k] for k in range(5)])))
    d = d.withColumn("_w", windows)
    d = d.withColumn("_again", F.coalesce(F.size(F.array_distinct("_w")) < F.size("_w"), F.lit(False)))
    d = d.withColumn("_s", F.when(F.col("_again"), F.array_sort(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s, n = F.col("_s"), F.size("_s")
    twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"])) | (
        (k < n - 1) & (s[F.least(k + 1, n - 1)]["h"] == s[k]["h"])))
    starts = F.array_sort(F.transform(twice, lambda k: s[k]["i"]))
    d = d.withColumn("_p", F.when(F.col("_again"), starts))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, p: F.struct(
        (acc["n"] + p + 5 - F.greatest(p, acc["end"])).alias("n"), (p + 5).alias("end")), lambda acc: acc["n"])
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    d = d.withColumn("_lines", lines)
    return d.select(
        *keep, "n_words", without(F.col("_t"), SPACES).cast("bigint").alias("word_chars"),
        (F.char_length("_t") - without(F.col("_t"), SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        (F.char_length("_t") - without(F.col("_t"), LETTERS)).cast("bigint").alias("n_capitals"),
        (F.char_length("_t") - without(F.col("_t"), "!?")).cast("bigint").alias("n_marks"),
        F.size(F.array_distinct("_h")).cast("bigint").alias("n_distinct"), F.size("_lines").cast("bigint").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistics() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {"words": F.log2(words.cast("double")), "word_length": F.col("word_chars") / words, "symbols": F.col("n_symbols") / chars,
            "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeats": F.col("n_repeat_words") / words,
            "capitals": F.col("n_capitals") / chars, "marks": F.col("n_marks") / chars, "distinct": F.col("n_distinct") / words}


Term = tuple[str, bool, float]  # statistic, above, threshold


def holds(terms: list[Term]) -> Column:
    out = F.lit(True)
    for name, above, at in terms:
        out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
    return out


def smoothed(bad: float, good: float) -> float:
    return (bad + 1) / (bad + good + 2)


def learn_rules(rows: DataFrame) -> list[list[Term]]:
    """Ordered conjunctions from (statistics..., y, prune); y = 0 is bad, ``prune`` marks the pruning half."""
    rows = cut(rows.select(*STATISTICS, "y", "prune"))
    cuts = rows.agg(*[F.percentile_approx(c, [(k + 0.5) / THRESHOLDS for k in range(THRESHOLDS)], 10_000).alias(c) for c in STATISTICS]).first()
    grid = {c: sorted(set(cuts[c] or [])) for c in STATISTICS}
    rules: list[list[Term]] = []
    left = rows
    while len(rules) < MAX_RULES:
        rule = grow(left.where("NOT prune"), grid)
        rule = prune(left.where("prune"), rule) if rule else rule
        if not rule:
            return rules
        rules.append(rule)
        left = left.where(~holds(rule))
    return rules


def grow(rows: DataFrame, grid: dict[str, list[float]]) -> list[Term]:
    """Adds the threshold with the best information gain until hardly any good row is left."""
    rule: list[Term] = []
    bin_of = lambda c: F.lit(0) if not grid[c] else sum(((F.col(c) > at).cast("int") for at in grid[c]), F.lit(0))
    binned = rows.select(*STATISTICS, "y", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), bin_of(c).alias("bin")) for c in STATISTICS])).alias("_b"))
    while len(rule) < MAX_TERMS:
        counted = binned.where(holds(rule)).groupBy("_b.name", "_b.bin", "y").count().collect()
        hist = {c: ([0] * (len(grid[c]) + 1), [0] * (len(grid[c]) + 1)) for c in STATISTICS}
        for r in counted:
            hist[r["name"]][r["y"]][r["bin"]] += r["count"]
        bad, good = (sum(hist[STATISTICS[0]][y]) for y in (0, 1))
        if not bad:
            return []
        if rule and good <= 0.01 * (bad + good):
            return rule
        best: tuple[float, Term] | None = None
        for c in STATISTICS:
            for k, at in enumerate(grid[c]):
                low_bad, low_good = sum(hist[c][0][: k + 1]), sum(hist[c][1][: k + 1])
                for above, b, g in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                    gain = b * (math.log(smoothed(b, g)) - math.log(smoothed(bad, good)))
                    if b and (best is None or gain > best[0] + 1e-12):
                        best = gain, (c, above, at)
        if best is None or best[0] <= 1e-9:
            return rule
        rule.append(best[1])
    return rule


def prune(rows: DataFrame, rule: list[Term]) -> list[Term]:
    """The prefix that separates best on the other half; nothing if none is sure enough."""
    sums = rows.agg(*[F.sum((holds(rule[: k + 1]) & (F.col("y") == y)).cast("int")).alias(f"n{k}_{y}") for k in range(len(rule)) for y in (0, 1)]).first()
    scored = [(smoothed(sums[f"n{k}_0"] or 0, sums[f"n{k}_1"] or 0), -k) for k in range(len(rule))]
    best = max(scored)
    return rule[: 1 - best[1]] if best[0] >= SURE else []


def verdict(rules: list[list[Term]]) -> Column:
    """Keep unless a rule takes the row, as one ordered conditional expression."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(holds(rule), False).otherwise(out)
    return out


def judged(counts: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[list[Term]]]:
    """Adds base_failed and kept to rows of :func:`text_counts` with a doc_id; also the rules.

    Rules are learned from the labelled rows that pass the base rules and are not held out, half of
    them for pruning.  Without such rows there are no rules.  A null id is judged and never learned.
    """
    known = labelled(labels, "quality").where(~held_out(F.col("doc_id")))
    stats = statistics()
    rows = counts.where(~base_failed()).select("doc_id", *[stats[c].alias(c) for c in STATISTICS]).join(known, "doc_id")
    rules = learn_rules(rows.withColumn("prune", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1))
    out = counts.withColumns(stats).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop(*STATISTICS), rules


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts..., base_failed, kept) for every row of (doc_id, text).

    Null, empty and very short texts fail the base rules; repeated rows are judged each; an empty
    table gives an empty result; other columns are ignored.
    """
    counts = cut(text_counts(docs.select("doc_id", "text"), "doc_id"))
    return judged(counts, labels)[0]


def keep_passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass; columns as given.

    Statistics are narrow, so learning shuffles no text; the list is then applied in place, which
    counts every text a second time instead of joining texts with verdicts.
    """
    counts = cut(text_counts(docs.select("doc_id", "text"), "doc_id"))
    rules = judged(counts, labels)[1]
    rows = text_counts(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), "text"), "_row")
    passed = ~base_failed() & verdict(rules)
    # a generator instead of a filter: the optimizer would copy all counts into a filter and push that below them
    return rows.withColumns(statistics()).select(F.explode(F.when(passed, F.array("_row")).otherwise(F.slice(F.array("_row"), 1, 0))).alias("_row")).select("_row.*")


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
