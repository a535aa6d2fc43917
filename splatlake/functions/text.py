"""Label, key and text columns (all codegen-friendly built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalize_label(c: Column) -> Column:
    """Lower case, trimmed, runs of other characters become one underscore."""
    lowered = F.lower(F.trim(c))
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def detection_label(*names: Column) -> Column:
    """First non-empty name; only blanks become underscores (not the same as normalize_label)."""
    first = F.coalesce(*[F.nullif(n, F.lit("")) for n in names])
    return F.coalesce(F.replace(F.lower(F.trim(first)), F.lit(" "), F.lit("_")), F.lit("unknown"))


def detection_score(*values: Column) -> Column:
    """First value that parses as a number, else 1."""
    return F.coalesce(*[v.try_cast("double") for v in values], F.lit(1.0))


def stem(c: Column) -> Column:
    """File name without folders and without its last extension."""
    name = F.regexp_extract(c, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def normalize_key(c: Column) -> Column:
    """``frame_%06d`` when the stem ends in a frame number, else the lower-case stem."""
    low = F.lower(stem(c))
    digits = F.coalesce(
        F.nullif(F.regexp_extract(low, r"(?:frame|image|img)[_\- ]*0*(\d+)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(low, r"^(\d+)$", 1), F.lit("")),
    )
    number = F.regexp_replace(digits, "^0+(?=.)", "")
    padded = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    return F.when(digits.isNotNull(), F.concat(F.lit("frame_"), padded)).otherwise(low)


def frame_key(c: Column, depth: bool = False) -> Column:
    """Stem without the role suffix; the depth variant also drops depth suffixes first."""
    s = stem(c)
    if depth:
        s = F.regexp_replace(s, "(_median_depth|_expected_depth|_rendered_depth|_depth)$", "")
    return F.regexp_replace(s, "(_rgb|_image|_mask|_overlay)$", "")


def object_key(label: Column, instance: Column) -> Column:
    """Instance id when it already carries the label, else ``label__instance``; empty raises."""
    lab, ins = normalize_label(label), normalize_label(instance)
    carries = (ins == lab) | ins.startswith(F.concat(lab, F.lit("_")))
    return (
        F.when(F.coalesce(ins, F.lit("")) == "", F.raise_error(F.lit("empty instance id")).cast("string"))
        .when(carries, ins)
        .otherwise(F.concat(lab, F.lit("__"), ins))
    )


def label_color(label: Column) -> Column:
    """First three SHA-1 bytes, each at least 55."""
    digest = F.sha1(label.cast("binary"))
    return F.array(*[F.greatest(_byte(digest, i), F.lit(55)) for i in range(3)])


def track_color(track_id: Column) -> Column:
    """First three SHA-256 bytes folded into 70..239."""
    digest = F.sha2(track_id.cast("binary"), 256)
    return F.array(*[(_byte(digest, i) % 170 + 70).cast("int") for i in range(3)])


def _byte(hex_digest: Column, i: int) -> Column:
    return F.conv(F.substring(hex_digest, 2 * i + 1, 2), 16, 10).cast("int")


def containment_values(line: Column) -> Column:
    """``key=value`` pairs of one log line as a map of text."""
    keys = F.regexp_extract_all(line, F.lit(r"([a-z_]+)=([-+0-9.eE]+)"), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(r"([a-z_]+)=([-+0-9.eE]+)"), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    # a repeated key keeps its last value
    last = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))),
        lambda p: F.array_position(F.slice(F.reverse(keys), 1, F.size(keys) - 1 - p["i"]), p["k"]) == 0,
    )
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))
