"""Camera registries, detection files, listings, depth rasters, reports and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from splatlake.functions import camera, text

FRAME_FIELDS = ("file_path string, filename string, image_path string, transform_matrix array<array<double>>, "
                "fl_x double, fl_y double, cx double, cy double, camera_angle_x double")
SCENE = ("fl_x double, fl_y double, cx double, cy double, w int, h int, camera_angle_x double, frames array<struct<"
         + ", ".join(f.replace(" ", ": ", 1) for f in FRAME_FIELDS.split(", ")) + ">>")
ITEM = ("label: string, class_name: string, name: string, category: string, class: string, score: string, confidence: string, probability: string, "
        "mask_path: string")
GROUPS = ("detections", "objects", "instances", "layout_masks", "layout", "planes")
DETECTION_FILE = "schema string, image_path string, file_path string, frame_path string, segmentation_fingerprint string, layout_fingerprint string, " + ", ".join(
    f"{g} array<struct<{ITEM}>>" for g in GROUPS)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """File metadata (path, name, size, modified) without reading contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(
        "path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def scan_of(rows: DataFrame, scan_id: str | None):
    """The given name, a partition column of that name, or the folder that holds the file."""
    if scan_id is not None:
        return F.lit(scan_id)
    return F.col("scan_id").cast("string") if "scan_id" in rows.columns else F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]*$", 1)


def read_frames(spark: SparkSession, path: str, scan_id: str | None = None, max_frames: int | None = None) -> DataFrame:
    """Registered frames with dense index and key = file stem; a duplicate key or an empty list raises.

    ``path`` may hold the registries of any number of scans; without ``scan_id`` a scan is named by
    its partition value ``scan_id=...`` or its folder.
    """
    j = spark.read.schema(SCENE).option("multiLine", True).json(path)
    j = j.withColumn("scan_id", scan_of(j, scan_id))
    empty = F.coalesce(F.size("frames"), F.lit(0)) < 1
    j = j.withColumn("frames", F.when(empty, F.raise_error(F.concat(F.lit("no frames in scan "), F.col("scan_id"))).cast(j.schema["frames"].dataType)).otherwise(F.col("frames")))
    f = j.select("*", F.posexplode("frames").alias("source_index", "f")).drop("frames")
    if max_frames is not None:
        f = f.where(F.col("source_index") < max_frames)
    name = F.coalesce("f.file_path", "f.filename", "f.image_path")
    m = F.flatten("f.transform_matrix")
    fx = camera.intrinsics({k: F.col(f"f.{k}") for k in ("fl_x", "fl_y", "camera_angle_x", "cx", "cy")},
                           {k: F.col(k) for k in ("fl_x", "fl_y", "camera_angle_x", "cx", "cy")}, F.col("w"), F.col("h"))
    out = f.select("scan_id", F.col("source_index").alias("frame_index"), "source_index", text.stem(name).alias("frame_key"), name.alias("image_path"),
                   F.col("w").alias("width"), F.col("h").alias("height"), *[c.alias(n) for c, n in zip(fx, ("fx", "fy", "cx", "cy"))], m.alias("c2w"))
    n = F.count("*").over(W.partitionBy("scan_id", "frame_key"))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate frame key "), F.col("frame_key"))).cast("string")).otherwise(F.col("frame_key"))
    return out.withColumn("frame_key", checked).withColumn("w2c", camera.invert_affine("c2w"))


def read_frames_tolerant(spark: SparkSession, path: str, files: DataFrame, scan_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames whose image is listed and whose matrix is 4 x 4, frames whose image is missing).

    ``files``: (scan_id, name); an image counts for its own scan alone.
    """
    f = read_frames(spark, path, scan_id).withColumn("name", F.regexp_extract("image_path", "([^/]+)$", 1))
    names = files.select("scan_id", "name").distinct()
    whole = (F.size("c2w") == 16) & F.forall("c2w", lambda x: x.isNotNull())
    return f.where(whole).join(names, ["scan_id", "name"], "left_semi").drop("name"), f.join(names, ["scan_id", "name"], "left_anti").drop("name")


def frame_aliases(frames: DataFrame) -> DataFrame:
    """(scan_id, alias, frame_key): normalised spellings of each frame."""
    a = F.explode(F.array_distinct(F.array(text.normalize_key(F.col("frame_key")), text.normalize_key(F.col("image_path")))))
    return frames.select("scan_id", a.alias("alias"), "frame_key").groupBy("scan_id", "alias").agg(F.min("frame_key").alias("frame_key"))


def resolve_paths(refs: DataFrame, directories: list[str], files: DataFrame) -> DataFrame:
    """First existing candidate of each reference, directories in order."""
    d = F.posexplode(F.array(*[F.lit(x) for x in directories])).alias("rank", "dir")
    c = refs.select("*", d).withColumn("path", F.concat("dir", F.lit("/"), "ref"))
    best = c.join(files.select("path"), "path", "left_semi").groupBy("ref").agg(F.min_by("path", "rank").alias("path"))
    return refs.join(best, "ref", "left")


def match_frames(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Frame by image reference, else by file stem; unmatched rows drop."""
    def side(n):
        return aliases.select("scan_id", F.col("alias").alias(n), F.col("frame_key").alias(f"_{n}"))

    j = rows.join(side("image_alias"), ["scan_id", "image_alias"], "left").join(side("stem_alias"), ["scan_id", "stem_alias"], "left")
    return j.withColumn("frame_key", F.coalesce("_image_alias", "_stem_alias")).where("frame_key IS NOT NULL").drop("_image_alias", "_stem_alias", "image_alias", "stem_alias")


def detection_documents(spark: SparkSession, path: str, scan_id: str | None = None) -> DataFrame:
    """Documents of detection files with their file and scan; a file holds one document or an array of them."""
    j = spark.read.schema(DETECTION_FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("_file", F.col("_metadata.file_path"))
    return j.withColumn("scan_id", scan_of(j, scan_id))


def detection_masks(documents: DataFrame, aliases: DataFrame, packed: bool = False) -> DataFrame:
    """Masks listed in :func:`detection_documents`, named after their file, or with ``packed`` after their frame's image."""
    tagged = F.concat(*[F.coalesce(F.transform(g, lambda d, g=g: F.struct(F.lit(g).alias("group"), d.alias("d"))), F.array()) for g in GROUPS])
    ref = F.coalesce("image_path", "file_path", "frame_path", "_file")
    # names are read and frames matched per document; a mask only carries the result
    d = documents.select("scan_id", text.normalize_key(ref).alias("image_alias"), text.normalize_key(F.col("_file")).alias("stem_alias"),
                         text.stem(ref if packed else F.col("_file")).alias("_stem"), tagged.alias("_tagged"))
    r = match_frames(d, aliases).select("scan_id", "_stem", "frame_key", F.posexplode("_tagged").alias("ordinal", "t"))
    label = text.detection_label(*[F.col(f"t.d.{n}") for n in ("label", "class_name", "name", "category", "class")])
    score = text.detection_score(*[F.col(f"t.d.{n}") for n in ("score", "confidence", "probability")])
    role = F.when(label.isin("wall", "floor", "ceiling", "door", "window") | F.col("t.group").startswith("layout"), F.lit("structural")).otherwise(F.lit("small"))
    return r.where(F.col("t.d.mask_path").isNotNull()).select(
        "scan_id", F.format_string("%s_%03d_%s", F.col("_stem"), F.col("ordinal"), label).alias("mask_id"), label.alias("label"),
        role.alias("role"), score.alias("score"), F.col("t.group").alias("source_group"), F.col("t.d.mask_path").alias("mask_path"), "frame_key")


def read_detections(spark: SparkSession, path: str, scan_id: str | None, aliases: DataFrame, packed: bool = False) -> DataFrame:
    """Masks listed in JSON files, one per frame; unreadable files leave no rows.

    Many small files cost more than their contents: with ``packed`` a file is an array of the documents of
    several frames, each naming its image.
    """
    return detection_masks(detection_documents(spark, path, scan_id), aliases, packed)


def read_detections_strict(spark: SparkSession, path: str, aliases: DataFrame, schema: str = "tracked_semantic_frame.v2", scan_id: str | None = None,
                           packed: bool = False) -> DataFrame:
    """Masks of :func:`read_detections`; raises unless a scan has one schema and one of each fingerprint.

    The files are read once: the documents of a scan meet in a window over their own columns.
    """
    j, w = detection_documents(spark, path, scan_id), W.partitionBy("scan_id")
    bad = F.count(F.when(~F.col("schema").eqNullSafe(schema), 1)).over(w) > 0
    for name in ("segmentation_fingerprint", "layout_fingerprint"):
        bad = bad | ~F.coalesce(F.min(name).over(w) == F.max(name).over(w), F.lit(False))
    fails = F.raise_error(F.concat(F.lit("mixed or unsupported detection files in scan "), F.col("scan_id"))).cast("boolean")
    sound = j.withColumn("_bad", bad).where(F.when(F.col("_bad"), fails).otherwise(F.lit(True))).drop("_bad")
    return detection_masks(sound, aliases, packed)


def masks_from_filenames(files: DataFrame, frames: DataFrame, label: str) -> DataFrame:
    """(scan_id, frame_key, path) of mask files (scan_id, path, name) named after a frame of their scan and the label."""
    s = text.stem(F.col("name"))
    hit = F.array_contains(F.split(s, "_"), label) | s.endswith(f"_{label}") | F.contains(s, F.lit(f"_{label}_"))
    f = files.where(hit).withColumn("_s", s)
    # candidate keys are the file stem's own prefixes, so frames are met by equality
    parts = F.split("_s", "_")
    pre = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_")))
    best = f.select("scan_id", "path", pre.alias("frame_key")).join(frames.select("scan_id", "frame_key").distinct(), ["scan_id", "frame_key"], "left_semi").groupBy("scan_id", "path").agg(
        F.max_by("frame_key", F.length("frame_key")).alias("frame_key"))
    fallback = F.nullif(F.regexp_extract("_s", r"(frame_\d+)", 1), F.lit(""))
    return f.join(best, ["scan_id", "path"], "left").select("scan_id", F.coalesce("frame_key", fallback).alias("frame_key"), "path").where("frame_key IS NOT NULL")


def depth_index(files: DataFrame, directories: list[str], strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """First depth file per frame key in directory order; ``by`` names columns, such as the scan, that keep equal names apart."""
    rank = F.coalesce(*[F.when(F.contains(F.col("path"), F.lit(f"/{d}/")), F.lit(i)) for i, d in enumerate(directories)])
    key = text.frame_key(F.col("path"), depth=True) if strict else text.normalize_key(F.col("path"))
    f = files.where(F.lower("path").rlike(r"\.(npy|npz|png|tif|tiff|exr)$")).select(*by, key.alias("frame_key"), "path", rank.alias("_r")).where("_r IS NOT NULL")
    return f.groupBy(*by, "frame_key").agg(F.min_by("path", F.struct("_r", "path")).alias("path"))


def normalize_depth(depth: DataFrame, confidence: DataFrame | None = None, min_confidence: float = 0.05, integer: bool = True) -> DataFrame:
    """Millimetre rasters to metres; invalid, negative and low-confidence pixels become 0."""
    z = F.when(F.isnan("z") | (F.abs(F.col("z")) == float("inf")) | (F.col("z") < 0), F.lit(0.0)).otherwise(F.col("z").cast("double"))
    d = depth.withColumn("z", z)
    if integer:
        top = d.groupBy("scan_id", "frame_index").agg(F.max("z").alias("_m"))
        d = d.join(top, ["scan_id", "frame_index"]).withColumn("z", F.when(F.col("_m") > 255, F.col("z") / 1000).otherwise(F.col("z"))).drop("_m")
    if confidence is not None:
        keys = ["scan_id", "frame_index", "v", "u"]
        d = d.join(confidence.select(*keys, "confidence"), keys, "left").withColumn(
            "z", F.when(F.col("confidence") < min_confidence, F.lit(0.0)).otherwise(F.col("z"))).drop("confidence")
    return d


def depth_stats(depth: DataFrame, by: list[str]) -> DataFrame:
    """Valid count and ratio, min, 1st/50th/99th percentile and max of positive finite depth."""
    z = F.when((F.col("z") > 0) & ~F.isnan("z") & (F.col("z") < float("inf")), F.col("z"))
    g = depth.groupBy(*by).agg(F.count(z).alias("valid"), (F.count(z) / F.count("*")).alias("valid_ratio"), F.min(z).alias("min"),
                               F.percentile(z, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("_p"), F.max(z).alias("max"))
    return g.withColumns({"p01": F.col("_p")[0], "median": F.col("_p")[1], "p99": F.col("_p")[2]}).drop("_p")


def primary_variant(stats: DataFrame, priority: list[str]) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("variant") == v, F.lit(i)) for i, v in enumerate(priority)], F.lit(len(priority)))
    return stats.groupBy("scan_id", "frame_index").agg(F.min_by("variant", F.struct(rank, F.col("variant"))).alias("variant"))


def inventory_hash(files: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 over the sorted (name, size, modified) rows of a group of files.

    Rows are hashed first, so only 64 characters per file are gathered.
    """
    row = F.sha2(F.to_json(F.struct("name", "size", "modified")), 256)
    return files.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ""), 256).alias("fingerprint"), F.count("*").alias("files"))


def write_report(tables: list[DataFrame], path: str) -> None:
    """CSV with the union of all columns; missing values stay empty."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_report(spark: SparkSession, path: str, schema: dict[str, str] | None = None) -> DataFrame:
    """All-text rows, cast where ``schema`` names a type."""
    d = spark.read.option("header", True).csv(path)
    return d.withColumns({c: F.col(c).try_cast(t) for c, t in (schema or {}).items()})


def write_manifest(rows: DataFrame, path: str) -> None:
    """One JSON object per line; the commit protocol makes the replacement atomic."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
