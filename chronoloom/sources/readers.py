"""Readers: every file format of the engine as a DataFrame with an explicit schema.

All paths go through Spark, so files can lie in any store that it reads. Nothing infers a
schema; values that do not parse are null. Empty strings become null here, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dates import in_scope
from ..functions.predicates import out_of_scope_label

#: Column names of a gold file and of an output file, by the name that the engine uses.
GOLD_COLUMNS = {"pot": "Pot_name", "typ": "Typology", "start": "Start_date", "end": "End_date", "site": "Site_name", "quote": "Original_text", "page": "Page"}
OUTPUT_COLUMNS = {"pot": "pottery", "typ": "typology", "start": "start_date", "end": "end_date", "site": "site_name", "quote": "original_text", "page": "page", "label": "context_label", "term": "term_found_normalized_en"}
DROPPED_LABELS = ("absent", "comparison", "citation", "irrelevant")
PATTERN_SCHEMA = "pattern_id string, type_id string, code string, category string, description string, regex string, canonical_hint string, preferred_label string, ware_type string, vessel_form string, chronology_id string, phase_code string, date_start int, date_end int"
PERIOD_SCHEMA = "code string, label string, label_en string, start int, end int, kind string, prompt string, terms array<string>"


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_table(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """A CSV with a header, all strings, trimmed, empty as null, with its file's stem as report_id.

    Columns are found by name in any order; blank-named ones are dropped; missing required
    ones are an error that names them.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    first = raw.columns[0] if raw.columns else ""
    raw = raw.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else raw
    names = [c for c in raw.columns if c.strip() and not c.startswith("_c")]
    absent = [c for c in required or () if c not in names]
    if absent:
        raise ValueError(f"{path} lacks the columns {', '.join(absent)}")
    return raw.select(*[tx.blank_to_null(F.trim(F.col(f"`{c}`"))).alias(c) for c in names], stem(F.input_file_name()).alias("report_id"))


def to_int(value: Column) -> Column:
    """The integer that a text begins with."""
    return F.regexp_extract(F.trim(value), r"^-?\d+", 0).try_cast("int")


def read_finds(spark: SparkSession, path: str, columns: dict[str, str], present_only: bool = False, window: tuple[int, int] | None = None) -> DataFrame:
    """Finds of gold or output files under the engine's names, with comparable keys.

    With ``present_only`` rows whose label says that they are no finds go, with ``window`` those
    dated outside it and undated ones whose texts name another period only.
    """
    table = read_table(spark, path, [columns["pot"], columns["typ"]])
    has = lambda k: k in columns and columns[k] in table.columns
    null = F.lit(None).cast("string")
    rows = table.select("report_id", *[(F.col(f"`{columns[k]}`") if has(k) else null).alias(k) for k in ("pot", "typ", "start", "end", "site", "quote", "page", "label", "term")])
    if present_only:
        rows = rows.where(F.col("label").isNull() | ~F.col("label").isin(*DROPPED_LABELS))
    if window:
        start, end = to_int(F.col("start")), to_int(F.col("end"))
        words = F.concat_ws(" ", "pot", "term", "quote")
        rows = rows.where(in_scope(start, end, window) & ~(start.isNull() & end.isNull() & out_of_scope_label(words)))
    order = Window.partitionBy("report_id").orderBy(F.monotonically_increasing_id())
    return rows.select("report_id", F.row_number().over(order).cast("long").alias("id"), "pot", tx.typology_form(F.col("typ")).alias("typ"), F.col("typ").alias("raw_typ"), to_int(F.col("start")).alias("start"), to_int(F.col("end")).alias("end"), F.lower("site").alias("site"), F.col("site").alias("raw_site"), "quote", to_int(F.col("page")).alias("page"), tx.only_alnum(F.coalesce("pot", F.lit(""))).alias("key"), tx.tokens(F.coalesce("pot", F.lit(""))).alias("toks"))


def read_patterns(spark: SparkSession, *paths: str) -> DataFrame:
    """Pattern files, one after the other, each a JSON array."""
    return spark.read.schema(PATTERN_SCHEMA).option("multiLine", True).json(list(paths))


def read_periods(spark: SparkSession, *paths: str, default: list[dict] | None = None) -> DataFrame:
    """Period tables narrowest first; of equal widths in order of their source."""
    if paths:
        rows = spark.read.schema(PERIOD_SCHEMA).option("multiLine", True).json(list(paths)).withColumn("source", F.input_file_name())
    else:
        rows = spark.createDataFrame(default or [], PERIOD_SCHEMA).withColumn("source", F.lit("default"))
    rows = rows.withColumn("label", F.coalesce("label", "label_en")).withColumn("width", F.col("end") - F.col("start"))
    return rows.withColumn("position", F.row_number().over(Window.orderBy("width", "source", "start", "label")))


def period_terms(periods: DataFrame) -> DataFrame:
    """(term, start, end): every synonym; the first period in order keeps a term that several have."""
    terms = periods.select(F.lower(F.trim(F.explode("terms"))).alias("term"), "start", "end", "position").where("term <> ''")
    return terms.groupBy("term").agg(F.min_by(F.struct("start", "end"), "position").alias("r")).select("term", "r.start", "r.end")


def frequent_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the most frequent name of a base code, capitalised; the first of equals."""
    rows = rows.select(F.trim(F.split(key, ":")[0]).alias("key"), F.trim(F.col(name)).alias("name"), F.monotonically_increasing_id().alias("at")).where("key <> '' and name <> ''")
    counts = rows.groupBy("key", "name").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = counts.groupBy("key").agg(F.max_by("name", F.struct("n", -F.col("at"))).alias("name"))
    return best.select("key", F.concat(F.upper(F.left("name", F.lit(1))), F.substring("name", 2, 1 << 20)).alias("name"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples or N-Quads, plain or gzipped; literals without quotes and tags."""
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*(?:<[^>]*>\s*)?\.\s*$'
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = lambda k: F.regexp_extract("value", pattern, k)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r'^<(.*)>$', "$1"), r'^"(.*)"(?:@[\w-]+|\^\^<[^>]*>)?$', "$1")
    return lines.select(bare(part(1)).alias("s"), part(2).alias("p"), bare(part(3)).alias("o"))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """One row per GeoJSON feature: its properties and its geometry as JSON texts."""
    whole = spark.read.text(path, wholetext=True)
    features = F.from_json("value", "struct<features:array<struct<properties:string,geometry:string>>>")["features"]
    return whole.select(F.inline(features))


def find_column(columns: list[str], aliases: tuple[str, ...], required: bool = False) -> str | None:
    """The first column that has one of the names, whatever its case."""
    folded = {c.strip().casefold(): c for c in columns}
    found = next((folded[a.casefold()] for a in aliases if a.casefold() in folded), None)
    if required and found is None:
        raise ValueError(f"none of the columns {', '.join(aliases)} is there")
    return found


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Sites with coordinates in kilometres; points without both are left out, numbered by position."""
    raw = read_table(spark, path)
    x = find_column(raw.columns, ("X-coordinate", "X-coordinate_RD", "x_coordinate", "site_x_coordinate", "x"), True)
    y = find_column(raw.columns, ("Y-coordinate", "Y-coordinate_RD", "y_coordinate", "site_y_coordinate", "y"), True)
    text = lambda *a: F.col(f"`{c}`") if (c := find_column(raw.columns, a)) else F.lit(None).cast("string")
    rows = raw.select(text("SiteID", "site_id").alias("site_id"), text("Name", "name").alias("name"), text("Toponym", "toponym").alias("toponym"), (F.col(f"`{x}`").try_cast("double") / 1000).alias("x_km"), (F.col(f"`{y}`").try_cast("double") / 1000).alias("y_km"), text("LiteratureID", "literature_id").alias("literature_id"))
    rows = rows.where("x_km is not null and y_km is not null")
    return rows.withColumn("map_number", F.row_number().over(Window.orderBy(F.coalesce("name", F.lit("")), "site_id")))


def in_box(points: DataFrame, west: float, east: float, south: float, north: float) -> DataFrame:
    return points.where(F.col("x_km").between(west, east) & F.col("y_km").between(south, north))


def without_targets(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Other sites once each, without the targets."""
    return points.join(targets.select("site_id"), "site_id", "left_anti").groupBy("site_id").agg(*[F.min(c).alias(c) for c in points.columns if c != "site_id"])


def map_labels(points: DataFrame) -> DataFrame:
    """A toponym with the numbers of its points."""
    return points.groupBy("toponym").agg(F.array_join(F.array_sort(F.collect_list("map_number")).cast("array<string>"), ", ").alias("numbers"), F.min("map_number").alias("first_number"))


def read_granular_summary(spark: SparkSession, path: str) -> DataFrame:
    """(report, field, verdict, n) of a summary file; its TOTAL row is left out."""
    raw = read_table(spark, path, ["report"])
    cells = [c for c in raw.columns if c not in ("report", "report_id") and not c.startswith("total_")]
    pairs = F.array(*[F.struct(F.lit(c.rpartition("_")[0]).alias("field"), F.lit(c.rpartition("_")[2]).alias("verdict"), F.coalesce(to_int(F.col(f"`{c}`")), F.lit(0)).alias("n")) for c in cells])
    return raw.where(F.upper("report") != "TOTAL").select("report", F.inline(pairs))


def read_total_row(spark: SparkSession, path: str, run: str) -> DataFrame:
    raw = read_table(spark, path, ["report"])
    return raw.where(F.upper("report") == "TOTAL").select(F.lit(run).alias("run"), *[to_int(F.col(f"`{c}`")).alias(c) for c in raw.columns if c not in ("report", "report_id")])


def read_vocabulary(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The layout of a vocabulary (``normalized`` or ``legacy``, by its header) and its rows."""
    table = read_table(spark, path)
    return ("normalized" if "typology_code" in table.columns else "legacy"), table


def list_reports(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(report_id, path, bucket, bucket_rank, number) of the reports in a folder, in their custom order.

    The bucket is the name before its last number, or all of it; known buckets go first.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path")
    name = stem(F.col("path"))
    shape = r"^([a-z_-]*?)[_-]?(\d+)$"
    fits = name.rlike(shape)
    bucket = F.when(fits, F.rtrim(F.regexp_extract(name, shape, 1), F.lit("_-"))).otherwise(name)
    rank = F.when(bucket == "old_rep", 0).when(bucket == "table", 1).when(bucket == "ocr", 2).when(bucket == "new_rep", 3).otherwise(9)
    number = F.when(fits, F.regexp_extract(name, shape, 2).try_cast("int")).otherwise(0)
    return files.select(name.alias("report_id"), "path", bucket.alias("bucket"), rank.alias("bucket_rank"), number.alias("number")).orderBy("bucket_rank", "bucket", "number", "report_id")


def tagged_grids(text: Column) -> Column:
    """An array of (page, table_no, grid) of a text with ``[[pN table K]]`` marks."""
    mark = r"\[\[p(\d+) table (\d+)\]\]"
    found = lambda k: F.transform(F.regexp_extract_all(text, F.lit(mark), F.lit(k)), lambda x: x.cast("int"))
    bodies = F.transform(F.split(text, mark, -1), lambda x: F.trim(x))
    zipped = F.arrays_zip(found(1).alias("page"), found(2).alias("table_no"), F.slice(bodies, 2, F.size(bodies)).alias("grid"))
    return F.filter(zipped, lambda z: z["page"].isNotNull())


def first_folder(spark: SparkSession, *paths: str) -> str:
    """The first folder that exists, e.g. live outputs before frozen ones; an error names them all."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return path
    raise FileNotFoundError(f"none of these folders exists: {', '.join(paths)}")


#: The nested reply of a layout service: pages, blocks, paragraphs, words, symbols.
_LEAF = "boundingBox:struct<vertices:array<struct<x:double,y:double>>>"
LAYOUT_SCHEMA = f"struct<pages:array<struct<width:double,height:double,blocks:array<struct<{_LEAF},paragraphs:array<struct<words:array<struct<symbols:array<struct<text:string>>>>>>>>>>>"


def layout_blocks(reply: Column) -> Column:
    """An array of (text, x0, y0, x1, y1) of the blocks in a layout reply."""
    parsed = F.from_json(reply, LAYOUT_SCHEMA)
    blocks = F.flatten(F.transform(parsed["pages"], lambda p: p["blocks"]))

    def words(block: Column) -> Column:
        return F.array_join(F.transform(F.flatten(F.transform(block["paragraphs"], lambda p: p["words"])), lambda w: F.array_join(F.transform(w["symbols"], lambda s: s["text"]), "")), " ")

    def edge(block: Column, axis: str, pick) -> Column:
        return pick(F.transform(block["boundingBox"]["vertices"], lambda v: v[axis]))

    return F.transform(blocks, lambda b: F.struct(words(b).alias("text"), edge(b, "x", F.array_min).alias("x0"), edge(b, "y", F.array_min).alias("y0"), edge(b, "x", F.array_max).alias("x1"), edge(b, "y", F.array_max).alias("y1")))


def interval_records(spark: SparkSession, path: str) -> DataFrame:
    """Research records: numeric ends, both there, of positive duration."""
    raw = read_table(spark, path, ["site_id", "start_date", "end_date"])
    rows = raw.withColumns({"start": F.col("start_date").try_cast("double"), "end": F.col("end_date").try_cast("double")})
    return rows.where(F.col("end") > F.col("start"))
