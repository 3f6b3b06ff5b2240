"""Sources with explicit schemas: artifacts, images, JSON stores, recognised words, annotations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.schemas import POINT_RING, VALUE

SESSIONS = (
    "capture_session_id string, package_id string, client struct<platform:string,app_version:string,device_model:string>,"
    "context struct<jurisdiction:struct<country:string,state:string>,sale_channel:string,is_imported:boolean,is_for_retail:boolean,is_ecommerce_listing:boolean>"
)
LINES = f"run_id string, package_id string, artifact_id string, seq int, text string, geom {POINT_RING}, confidence double, script string, language string"
ANNOTATIONS = (
    f"images array<struct<image:string,surface:string,conditions:array<string>,extraction_failed:boolean,"
    f"regions:array<struct<geom:{POINT_RING},text:string,field:string,value:{VALUE},script:string>>>>"
)


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256, content) of every file below a folder, local or in an object store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images for ``quality.measure_images``: bytes in rows, blue first."""
    raw = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    return raw.select(F.col("origin").alias("image_id"), "height", "width", F.col("nChannels").alias("channels"), "data")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSIONS).json(path)


def annotations(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Annotated regions of the images that exist: one row per region with its ordinal."""
    listed = spark.read.schema(ANNOTATIONS).option("multiLine", "true").json(path)
    found = listed.select(F.explode("images").alias("i")).select("i.*").join(files.select("image").distinct(), "image", "left_semi")
    return found.select("image", "surface", "conditions", F.coalesce("extraction_failed", F.lit(False)).alias("extraction_failed"), F.posexplode_outer("regions").alias("ordinal", "r")).select(
        "image", "surface", "conditions", "extraction_failed", "ordinal", "r.*"
    )


def json_or_null(text: Column, schema: str) -> Column:
    """A stored document; null where it is missing, blank or corrupt."""
    parsed = F.from_json(F.when(F.trim(text) != "", text), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return F.when(parsed["_corrupt"].isNull(), parsed)


def exif_kept(tags: Column, longest: int = 256) -> Column:
    """Tags without maker notes, thumbnails and empty values, values cut to a bounded length."""
    kept = F.map_filter(tags, lambda k, v: ~(k.contains("MakerNote") | k.startswith("Thumbnail") | k.contains("JPEGThumbnail")) & (v != ""))
    return F.transform_values(kept, lambda k, v: F.substring(v, 1, longest))


def words_to_lines(words: DataFrame) -> DataFrame:
    """Recognised words to lines: joined in order, box around all, mean confidence over 100.

    words: image, page, block, par, line, seq, text, confidence, x, y, w, h. Blank words and those
    with negative confidence are left out; lines keep the order in which they first appear.
    """
    good = words.filter((F.trim("text") != "") & (F.col("confidence") >= 0))
    keys = ["image", "page", "block", "par", "line"]
    lines = good.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ").alias("text"), F.min("seq").alias("first"),
        F.min("x").alias("l"), F.min("y").alias("t"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"), (F.avg("confidence") / 100).alias("confidence"),
    )
    return lines.withColumn("seq", F.row_number().over(W.partitionBy("image").orderBy("first", *keys)) - 1).drop("first")


def _elements(text: Column) -> Column:
    """Elements of a JSON array as JSON texts; empty where it is no array. A text without a bracket is none: parsing it would be an exception, made and caught."""
    return F.coalesce(F.when(text.contains("["), F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and pass it to ``body`` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ring(corners: Column) -> Column:
    """Points of a JSON array of corners, parsed at once if all are numbers; else each for itself, one that can't be read having null coordinates."""
    points = lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))
    numbers = lambda c: F.forall(c, lambda p: p.isNotNull() & F.forall(p, lambda v: v.isNotNull()))
    each = F.transform(_elements(corners), lambda p: F.from_json(p, "array<double>"))
    return F.transform(_let(F.from_json(corners, "array<array<double>>"), lambda c: F.when(numbers(c), c).otherwise(each)), points)


def recognised_entries(passes: DataFrame) -> DataFrame:
    """Nested results of several recognition passes an image to lines with quadrilaterals.

    passes: image, pass, language, result (JSON: blocks of entries, an entry being four corners and a
    pair of text and confidence). Null blocks hold nothing; an entry that is malformed, has no text or
    not exactly four corners is left out and spoils no other. Lines are in the order of pass, block and
    entry; a confidence that is missing or no number stays null, it is never made up.
    """

    def entry(e: Column, block: Column, place: Column) -> Column:
        says = lambda read: (F.size(read) == 2) & (F.trim(F.get(read, F.lit(0))) != "")  # noqa: E731  corners of others are not parsed
        cornered = lambda parts, read: F.when(says(read), _let(_ring(F.get(parts, F.lit(0))), lambda ring: told(read, ring, block, place)))
        return _let(_elements(e), lambda parts: _let(_elements(F.get(parts, F.lit(1))), lambda read: cornered(parts, read)))

    def told(read: Column, ring: Column, block: Column, place: Column) -> Column:
        text = F.get(read, F.lit(0))
        whole = (F.size(ring) == 4) & F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        confidence = F.get(read, F.lit(1)).try_cast("double")
        made = {"pass": F.col("pass"), "block": block, "entry": place, "text": text, "ring": ring, "confidence": confidence, "language": F.col("language")}
        return F.when(whole, F.struct(*[c.alias(name) for name, c in made.items()]))

    # Bound in lambdas, a text is parsed once; as columns, every use in a filter would parse it again.
    good = F.filter(F.flatten(F.transform(_elements(F.col("result")), lambda b, i: F.transform(_elements(b), lambda e, k: entry(e, i, k)))), lambda x: x.isNotNull())
    lines = passes.select("image", good.alias("lines")).groupBy("image").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"))
    each = lines.select("image", F.posexplode("lines").alias("seq", "l"))
    geom = F.struct(F.lit("QUADRILATERAL").alias("type"), F.col("l.ring").alias("points"), F.lit("original_image_px").alias("space"))
    return each.select("image", "l.text", geom.alias("geom"), "l.confidence", "l.language", "seq")


def recognition_errors(passes: DataFrame, lines: DataFrame) -> DataFrame:
    """(image, error): what went wrong in the passes of images of which no line was read (passes: image, pass, language, error)."""
    none = passes.filter("error IS NOT NULL").join(lines.select("image").distinct(), "image", "left_anti")
    told = none.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("pass", "language", "error"))).alias("e"))
    return told.select("image", F.array_join(F.transform("e", lambda e: F.concat(e["language"], F.lit(": "), e["error"])), "; ").alias("error"))


def scripted_lines(images: DataFrame, script: DataFrame) -> DataFrame:
    """A stand-in for recognition: the lines a script table has for each image."""
    return images.select("image").join(script, "image")


#: Recognition engines by name: functions from a table of images to a table of lines.
ENGINES: dict[str, Callable[..., DataFrame]] = {"words": words_to_lines, "entries": recognised_entries, "scripted": scripted_lines}


def register_engine(name: str, engine: Callable[..., DataFrame]) -> None:
    ENGINES[name] = engine


def build_engine(name: str) -> Callable[..., DataFrame]:
    """The engine of that name; a KeyError names those there are."""
    if name not in ENGINES:
        raise KeyError(f"unknown engine {name!r}; known: {', '.join(sorted(ENGINES))}")
    return ENGINES[name]


def barcode_records(scans: DataFrame) -> DataFrame:
    """Scans (code, format) as records: symbology from the format or else the length, and validity."""
    bare = F.trim("code")
    named = F.lower("format")
    symbology = (
        F.when(named.isin("ean13", "upca", "qr", "code128"), named).when(bare.rlike("^[0-9]{13}$"), "ean13").when(bare.rlike("^[0-9]{12}$"), "upca").otherwise("other")
    )
    entry = F.when(named.isNull(), "manualEntry").otherwise("liveScan")
    return scans.select("*", symbology.alias("symbology"), entry.alias("entry_mode"), T.valid_gtin(bare).alias("valid_gtin"), F.lit(False).alias("is_compliance_evidence"))
