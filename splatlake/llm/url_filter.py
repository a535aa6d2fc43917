"""URL filter: host and path rules, and beyond them a tree of path templates per host.

Segments are reduced to their shape first (numbers and long hexadecimal runs become marks), and rows
with one host and shape are counted together, so the tree works on counts.  It is built level by
level over all hosts at once: a branch joins the wildcard when its statistics (share of bad labels,
share of labelled rows, share of rows that end there) do not differ significantly from its siblings',
however many they are.  Branches are compared with the sum of their siblings, never in pairs.  A
template is rejected by the smoothed share of bad labels among its rows; rows without a label draw it
to the rates of the node above and of the same shapes on other hosts, which alone decide where no row
has a label.  Rows that a rule decides are the labels, unless others are given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from splatlake.llm import query
from splatlake.llm.common import LETTERS, cut, table
from splatlake.operators.skew import skew_join

Rule = tuple[str, str, str]  # verdict, host, path
RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SIGNIFICANT = 1.96
PRIOR_ROWS, REJECT = 2.0, 0.8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url or one without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, LETTERS, LETTERS.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path with numbers and long hexadecimal runs replaced by marks."""
    long = F.regexp_replace(path, r"[0-9a-fA-F]{8}[0-9a-fA-F-]*", "{h}")
    return F.regexp_replace(long, r"[0-9]+", "{n}")


def templates(counts: DataFrame) -> DataFrame:
    """(host, shape, n, bad, good, template, up, rate, seen) from (host, shape, n, bad, good, rate).

    Segments that all rows of a node share are taken in one step, so a round costs a real branching
    and the tree runs to the end of every path.  ``rate`` is the smoothed block rate of the last node
    on the way, ``seen`` its rows and ``up`` the rate of the node above it.
    """
    rows = counts.withColumns({"segs": F.split("shape", "/"), "template": F.lit(""), "at": F.lit(1), "up": F.lit(0.5), "seen": F.lit(2**63 - 1)})
    rows = cut(rows)
    left = F.col("at") < F.size("segs")
    done, rows = [rows.where(~left)], rows.where(left)
    while not rows.isEmpty():
        rest = F.slice("segs", F.col("at") + 1, F.size("segs") - F.col("at"))
        node = rows.groupBy("host", "template").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "good")])
        same = F.array_position(F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        node = cut(node.withColumn("common", F.when(same == 0, F.size("lo")).otherwise(same - 1).cast("int")).drop("lo", "hi"))
        rows = skew_join(rows, node, ["host", "template"], ["shape"])
        fresh = F.col("all_n") < F.col("seen")  # else the same rows, whose evidence is in the rate
        rate = smoothed(F.col("all_bad"), F.col("all_good"), F.col("all_n"), F.col("rate"))
        path = F.array_join(F.transform(F.slice("segs", F.col("at") + 1, F.col("common")), lambda x: F.concat(F.lit("/"), x)), "")
        rows = rows.withColumns({"up": F.when(fresh, F.col("rate")).otherwise(F.col("up")), "rate": F.when(fresh, rate).otherwise(F.col("rate")),
                                 "seen": F.least("seen", "all_n"), "template": F.concat("template", path), "at": F.col("at") + F.col("common")})
        rows = cut(rows.drop("common", "all_n", "all_bad", "all_good").withColumn("seg", F.get("segs", F.col("at"))))
        done.append(rows.where(~left).drop("seg"))
        rows = rows.where(left)
        branch = cut(rows.groupBy("host", "template", "seg").agg(
            *[F.sum(c).alias(c) for c in ("n", "bad", "good")], F.sum(F.when(F.size("segs") == F.col("at") + 1, F.col("n")).otherwise(0)).alias("last")))
        total = branch.groupBy("host", "template").agg(F.count("*").alias("children"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "good", "last")])
        both = skew_join(branch, cut(total), ["host", "template"], ["seg"])
        others = {c: F.col(f"all_{c}") - F.col(c) for c in ("n", "bad", "good", "last")}
        told, told_rest = F.col("bad") + F.col("good"), others["bad"] + others["good"]
        alike = comparable(F.col("bad"), told, others["bad"], told_rest) & comparable(F.col("last"), F.col("n"), others["last"], others["n"])
        alike = alike & comparable(told, F.col("n"), told_rest, others["n"]) & (F.col("children") > 1)
        named = both.select("host", "template", "seg", F.when(alike, "*").otherwise(F.col("seg")).alias("_to"))
        rows = rows.join(named, ["host", "template", "seg"])
        rows = cut(rows.withColumns({"template": F.concat("template", F.lit("/"), "_to"), "at": F.col("at") + 1}).drop("_to", "seg"))
        done.append(rows.where(~left))
        rows = rows.where(left)
    return reduce(DataFrame.unionByName, done).drop("segs", "at")


def smoothed(bad: Column, good: Column, n: Column, prior: Column) -> Column:
    """The share of bad labels, drawn to ``prior`` by two rows and the root of the number of rows without a label."""
    weight = PRIOR_ROWS + F.sqrt(n - bad - good)
    return (bad + weight * prior) / (bad + good + weight)


def borrowed(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(host, keys, other): the block rate of the same keys on all other hosts, narrowed domain by domain down to the host's own.

    The host's own rows are taken out of every domain, and a domain that adds no rows to the next
    wider one is no new evidence.
    """
    sums = ("n", "bad", "good")
    own = counts.groupBy("host", *keys).agg(*[F.sum(c).alias(c) for c in sums])
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    wide = cut(own.select("*", F.posexplode(domains).alias("depth", "domain")))
    total = cut(wide.groupBy("domain", "depth", *keys).agg(*[F.sum(c).alias(f"all_{c}") for c in sums]))
    rest = skew_join(wide, total, ["domain", "depth", *keys], ["host"])
    steps = F.sort_array(F.collect_list(F.struct("depth", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in sums])))
    start = F.struct(F.lit(0.5).alias("rate"), F.lit(-1).cast("bigint").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        rate = F.when(x["n"] == acc["n"], acc["rate"]).otherwise(smoothed(x["bad"], x["good"], x["n"], acc["rate"]))
        return F.struct(rate.alias("rate"), x["n"].alias("n"))

    return rest.groupBy("host", *keys).agg(steps.alias("_steps")).select("host", *keys, F.aggregate("_steps", start, step)["rate"].alias("other"))


def rejected(counts: DataFrame) -> DataFrame:
    """(host, shape, template, _reject) from (host, shape, n, bad, good).

    A template's prior is the mean of two rates: that of the node above it, which starts from the
    host's domains, and that of its shapes on other hosts.  Either is one half where nothing is known,
    so a template without labels is rejected only where both speak against it.
    """
    counts = cut(counts)
    hosts = borrowed(counts, []).withColumnRenamed("other", "rate")
    tree = cut(templates(skew_join(counts, cut(hosts), ["host"], ["shape"])).join(borrowed(counts, ["shape"]), ["host", "shape"]))
    leaf = tree.groupBy("host", "template").agg(
        *[F.sum(c).alias(c) for c in ("n", "bad", "good")], *[F.max(c).alias(c) for c in ("up", "rate", "seen")], F.sum(F.col("n") * F.col("other")).alias("_other"))
    above = F.when(F.col("n") < F.col("seen"), F.col("rate")).otherwise(F.col("up"))
    purity = smoothed(F.col("bad"), F.col("good"), F.col("n"), (above + F.col("_other") / F.col("n")) / 2)
    leaf = leaf.select("host", "template", (purity >= REJECT).alias("_reject"))
    return cut(tree.select("host", "shape", "template").join(leaf, ["host", "template"]))


def comparable(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Whether two shares a / n and b / m do not differ significantly; true also where one side is empty."""
    pooled = (a + b) / F.greatest(n + m, F.lit(1))
    gap = F.abs(a / F.greatest(n, F.lit(1)) - b / F.greatest(m, F.lit(1)))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(m, F.lit(1))))
    return (n == 0) | (m == 0) | (gap <= SIGNIFICANT * spread)


def judge_urls(pages: DataFrame, rules: list[Rule], label: str | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) for every row of (page_id, url).

    ``label`` names a column of ``pages`` with 'block' or 'allow' for some rows; by default the
    verdicts of the rules are the labels.  A rule's verdict always stands; the other rows are blocked
    where their template is rejected.  Null urls and urls without ``://`` have empty parts and are
    judged as such; null ids and repeated rows are judged like others; other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), *([F.col(label).alias("_label")] if label else []))
    rule, verdict = rule_of(rules)
    rows = rows.withColumns({"rule": rule, "_said": verdict})
    told = F.col("_label") if label else F.col("_said")
    rows = rows.withColumn("shape", shape(F.col("path")))
    counts = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(F.when(told == "block", 1)).alias("bad"), F.count(F.when(told == "allow", 1)).alias("good"))
    judged = rejected(counts)
    out = rows.join(judged, ["host", "shape"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(F.col("_reject"), "block").otherwise("allow")).alias("verdict"), "template")


@query("op9_url_templates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES).drop("template")
