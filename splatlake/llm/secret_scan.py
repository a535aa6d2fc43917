"""Secret scan through a trigram index: Boolean trigram queries, postings, intersection, verification.

Each rule's regular expression is reduced to a query, an OR of trigram sets of which a match must
hold one in full.  The index holds postings (trigram, doc_id) of the trigrams that some query names.
Postings meet the query terms, and a document is a candidate of a rule where all terms of one set
meet.  Candidates are verified by the expression itself, which also gives the spans.  Rules without
a mandatory trigram scan every text.  Trigrams and texts are compared in lower case, which can only
add candidates.
"""

from __future__ import annotations

import re
from re import _constants as sre, _parser

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from splatlake.llm import query
from splatlake.llm.common import cut, table

# kind, expression, group whose length counts, least length; the first three are the base
RULES: list[tuple[str, str, int, int]] = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 1),
    ("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}", 0, 1),
]
BASE = 3
MARK = "[SECRET]"
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Trigram sets (lower case) of which any match of ``pattern`` holds one in full; empty if there is no such set."""
    def grams(strings: set[str]) -> list[frozenset[str]] | None:
        sets = [frozenset(s[i: i + 3] for i in range(len(s) - 2)) for s in strings]
        return sets if sets and all(sets) else None

    def both(a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        return [x | y for x in a for y in b] if len(a) * len(b) <= MOST_STRINGS else a

    def walk(nodes) -> tuple[set[str] | None, list | None]:
        """The strings that the nodes match, if few; and the query they imply."""
        run: set[str] = {""}
        whole, found = True, None

        def close() -> None:
            nonlocal run, found, whole
            found, run, whole = both(found, grams(run)), {""}, False

        for op, arg in nodes:
            strings = implied = None
            if op is sre.LITERAL:
                strings = {chr(arg).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                strings = {chr(c).lower() for _, c in arg}
            elif op is sre.SUBPATTERN:
                strings, implied = walk(arg[3])
            elif op is sre.BRANCH:
                parts = [walk(p) for p in arg[1]]
                if all(s is not None for s, _ in parts):
                    strings = set().union(*(s for s, _ in parts))
                else:
                    asked = [both(q, grams(s) if s else None) for s, q in parts]
                    implied = None if any(a is None for a in asked) else [x for a in asked for x in a]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, inner = arg
                s, q = walk(inner)
                if s is not None and (low, high) == (0, 1):
                    strings = s | {""}
                elif low >= 1:
                    implied = both(q, grams(s) if s else None)
            if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
                run = {a + b for a in run for b in strings}
                continue
            close()
            if strings is not None:
                run = set(strings)
            else:
                found = both(found, implied)
        if whole:
            return run, None
        return None, both(found, grams(run))

    strings, found = walk(_parser.parse(pattern))
    return both(found, grams(strings) if strings else None) or []


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(doc_id, trigram) of the given trigrams in the lowered texts."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    low = docs.select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.explode(F.filter(wanted, lambda t: F.contains(F.col("low"), t))).alias("trigram"))


def candidates(docs: DataFrame, rules: list[tuple[str, str, int, int]]) -> DataFrame:
    """(doc_id, asked): a bit for each rule whose trigram query the document's postings satisfy."""
    spark = docs.sparkSession
    terms, full = [], []
    for number, rule in enumerate(rules):
        for want in trigram_query(rule[1]):
            full.append((number, len(want)))
            terms += [(t, len(full) - 1, bit) for bit, t in enumerate(sorted(want))]
    if not terms:
        return docs.sparkSession.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 0L AS asked").where("false")
    values = lambda rows: ", ".join("(" + ", ".join("'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}L" for v in r) + ")" for r in rows)
    asked = spark.sql(f"SELECT * FROM VALUES {values(terms)} AS t(trigram, clause, bit)")
    clauses = spark.sql(f"SELECT * FROM VALUES {values([(k, *c) for k, c in enumerate(full)])} AS c(clause, rule, size)")
    # both tables are bounded by the rules
    met = postings(docs, sorted({t[0] for t in terms})).join(F.broadcast(asked), "trigram")
    met = met.groupBy("doc_id", "clause").agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS INT))")).alias("held"))
    met = met.join(F.broadcast(clauses), "clause").where("held = shiftleft(1L, CAST(size AS INT)) - 1L")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, CAST(rule AS INT))")).alias("asked"))


def rule_spans(text: Column, number: int, rule: tuple[str, str, int, int]) -> Column:
    """array<struct<start, kind, end>> of a rule's matches in code points, end exclusive."""
    _, pattern, group, least = rule
    rx = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    found = F.transform(F.regexp_extract_all(text, rx, F.lit(0)), lambda x: F.char_length(x))
    counted = F.transform(F.regexp_extract_all(text, rx, F.lit(group)), lambda x: F.char_length(x)) if group else found
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    row = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), counted,
                     lambda x, c: F.struct(x["g"].alias("g"), x["m"].alias("m"), c.alias("c")))
    made = F.aggregate(row, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, x: F.struct(
        (acc["at"] + x["g"] + x["m"]).alias("at"),
        F.when(x["c"] >= least, F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + x["g"]).alias("start"), F.lit(number).alias("kind"), (acc["at"] + x["g"] + x["m"]).alias("end"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(F.rlike(text, rx), made).otherwise(none)


def secret_spans(docs: DataFrame, rules: list[tuple[str, str, int, int]] = RULES) -> DataFrame:
    """(row, text, spans) for every row: all columns as one struct, and its spans sorted by start and kind.

    Null and empty texts have no spans.  Rows with one id share the candidates of all of them and are
    verified each on their own text, so repeated rows and null ids are right; an empty table gives an
    empty result; other columns are carried in ``row`` whatever their names.
    """
    found = cut(candidates(docs.select("doc_id", "text"), rules)).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(found, F.col("_doc").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for number, rule in enumerate(rules):
        spans = rule_spans(F.col("text"), number, rule)
        asked = F.coalesce(F.col("asked"), F.lit(0)).bitwiseAND(1 << number) != 0
        parts.append(F.when(asked, spans).otherwise(none) if trigram_query(rule[1]) else spans)
    return rows.select("row", "text", F.array_sort(F.concat(*parts)).alias("spans"))


def told(spans: Column, rules: list[tuple[str, str, int, int]] = RULES) -> Column:
    """The spans as comma-joined kind:start:end."""
    kinds = F.array(*[F.lit(r[0]) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: list[tuple[str, str, int, int]] = RULES) -> DataFrame:
    """The documents with every span replaced by a mark and ``n_chars`` counted anew where a text changed; columns as given."""
    found = secret_spans(docs, rules)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")
    step = lambda acc, s: F.struct(  # noqa: E731  a span that begins inside the last one only extends it
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MARK))).alias("out"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    hit = F.size("spans") > 0
    rows = found.select("row", F.when(hit, clean).alias("_clean"))
    new = {"text": F.coalesce("_clean", "row.text"), "n_chars": F.when(F.col("_clean").isNull(), F.col("row.n_chars")).otherwise(F.char_length("_clean").cast("bigint")) if "n_chars" in docs.columns else None}
    return rows.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def _oracle() -> str:
    q = lambda s: s.replace("'", "''")
    kinds = []
    for number, (kind, pattern, group, least) in enumerate(RULES):
        rx = q(pattern)
        kinds.append(f"""
  list_filter(list_transform(range(1, 1 + len(regexp_extract_all(t, '{rx}', 0))), lambda i: {{
    's': CAST(list_sum(list_transform(string_split_regex(t, '{rx}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{rx}', 0)[1:i-1], lambda x: length(x))), 0) AS BIGINT),
    'k': {number}, 'n': '{kind}', 'm': CAST(length(regexp_extract_all(t, '{rx}', 0)[i]) AS BIGINT), 'c': CAST(length(regexp_extract_all(t, '{rx}', {group})[i]) AS BIGINT)}}), lambda x: x.c >= {least})""")
    text = lambda cond: (f"array_to_string(list_transform(list_sort(list_filter(sp, lambda x: {cond})), "  # noqa: E731
                         "lambda x: x.n || ':' || x.s || ':' || (x.s + x.m)), ',')")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_concat({", ".join(kinds)}) AS sp FROM d)
SELECT doc_id, CAST(len(list_filter(sp, lambda x: x.k = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(sp, lambda x: x.k = 1)) AS BIGINT) AS n_access,
       CAST(len(list_filter(sp, lambda x: x.k = 2)) AS BIGINT) AS n_hex, sha256({text(f"x.k < {BASE}")}) AS base_sha256, {text("true")} AS spans
FROM f"""


@query("op10_secret_scan", _oracle())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint")
    base = F.sha2(told(F.filter(spans, lambda s: s["kind"] < BASE)).cast("binary"), 256)
    return found.select(F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        base.alias("base_sha256"), told(spans).alias("spans"))
