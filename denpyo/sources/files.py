"""Image and document files, page images, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_PIXELS, LONGEST = 40 * 1024 * 1024, 60_000_000, 4000
# Endings of image files.
IMAGE_ENDINGS = r"(?i)\.(png|jpe?g|webp|gif|bmp|avif|hei[cf])$"
# Settings and what they are where nothing is stored.
SETTINGS = {"mode": "standard", "engine": "paddle", "autoRotate": True, "deskew": True, "invert": True, "maxTiles": 9}


def is_pdf(name: Column, kind: Column | None = None) -> Column:
    """Whether a file is a PDF, by its media type or its name."""
    named = name.rlike(r"(?i)\.pdf$")
    return named if kind is None else F.coalesce(kind == "application/pdf", F.lit(False)) | named


def files(spark: SparkSession, path: str, glob: str = "*", stream: bool = False) -> DataFrame:
    """path, length, content and kind (pdf, image, other) of the files below a landing folder; as a stream, those that arrive."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    kind = F.when(is_pdf(F.col("path")), "pdf").when(F.col("path").rlike(IMAGE_ENDINGS), "image").otherwise("other")
    return reader.load(path).select("path", "length", "content", kind.alias("kind"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels and pixels (rows of BGR or grey bytes) of the PNG, JPEG, GIF and BMP files of a folder; files that are no image are left out."""
    read = spark.read.format("image").option("dropInvalid", "true").load(path)
    return read.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))


def accepted(length: Column, width: Column, height: Column) -> Column:
    """Why an upload is refused (null: accepted): more than 40 MiB is too large, more than 60 megapixels or nothing is no image."""
    return F.when(length > MOST_BYTES, 413).when(width.isNull() | height.isNull() | (width.cast("long") * height <= 0) | (width.cast("long") * height > MOST_PIXELS), 400)


def fitted_size(width: Column, height: Column, longest: int = LONGEST) -> Column:
    """struct<width, height> of an image whose longer side is `longest` at most."""
    share = F.least(F.lit(1.0), longest / F.greatest(width, height))
    return F.struct(*(F.greatest(F.lit(1), F.floor(n * share + 0.5)).cast("int").alias(c) for n, c in ((width, "width"), (height, "height"))))


def page_facts(atoms: DataFrame, fonts: DataFrame, samples: DataFrame) -> DataFrame:
    """Diagnostics of each page: characters, fonts, embedded ones, ink (share of the sampled pixels with a channel below 200) and whether it is blank.

    `atoms`: page, text. `fonts`: page, name, embedded. `samples`: page, r, g, b of every 16th pixel.
    """
    dark = F.least("r", "g", "b") < 200
    ink = samples.groupBy("page").agg((F.count_if(dark) / F.count("*")).alias("ink"))
    chars = atoms.groupBy("page").agg(F.sum(F.length("text")).alias("characters"))
    known = fonts.groupBy("page").agg(F.count_distinct("name").alias("fonts"), F.count_if("embedded").alias("embedded"))
    out = ink.join(chars, "page", "full").join(known, "page", "full")
    return out.select("page", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("characters", "fonts", "embedded")), "ink", F.coalesce(F.col("ink") < 0.002, F.lit(False)).alias("blank"))


def settings(stored: DataFrame) -> DataFrame:
    """user and every setting of `stored` (user, json): what is stored, else its default; text that is no JSON counts as nothing."""
    kinds = {str: "string", bool: "boolean", int: "int"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in SETTINGS.items())
    parsed = F.from_json("json", schema, {"mode": "PERMISSIVE"})
    return stored.select("user", parsed.alias("s")).select("user", *(F.coalesce(F.col(f"s.{k}"), F.lit(v)).alias(k) for k, v in SETTINGS.items()))


def sample_bills(spark: SparkSession, n: int, parts: int = 8) -> DataFrame:
    """Synthetic bills as rows of text (doc, row, text), the same each time: title, date, number, items and total."""
    from ..functions.numbers import check_digit

    base = F.lpad((F.col("id") * 7919 + 12345).cast("string"), 12, "0")
    bill = spark.range(0, n, 1, parts).select(F.col("id").alias("doc"), F.concat(F.lit("登録番号 T"), check_digit(base).cast("string"), base).alias("number"), (F.col("id") % 5 + 1).cast("int").alias("k"))
    price = lambda i: (i * 130 + F.col("doc") % 97 * 11).cast("long")
    items = F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.concat(F.lit("商品"), i.cast("string"), F.lit(" ¥"), F.format_number(price(i), 0)))
    total = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda t, i: t + price(i))
    rows = F.concat(F.array(F.lit("請求書"), F.lit("2026年10月1日"), F.col("number")), items, F.array(F.concat(F.lit("合計 ¥"), F.format_number(total, 0))))
    return bill.select("doc", F.posexplode(rows).alias("row", "text"))
