"""Digests of files of any size, by byte ranges.

Files are read in splits as pieces between line feeds, which any bytes are made of; a piece's place in
the file follows from the sizes of the splits and pieces before it. Pieces are cut where ranges of
`size` bytes begin, each range is hashed by itself, and the hashes of up to `FAN` neighbours are
hashed together until one is left. No row holds more than a range or a piece, so a file may be of any
size; the digest of a file of one range is its plain SHA-256.

The digest depends on the bytes and on `size` alone, not on how Spark splits the file. A file whose
name ends as a compressed file's does is opened by Spark's readers as what is inside; such a file
is hashed from its whole bytes in one row, which Spark bounds at 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.session import cut_lineage

RANGE = 8 << 20
FAN = 256  # hashes under one node
PACKED = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|xz|Z)$"


def one_slash(path: Column) -> Column:
    """A local path as one spelling: readers differ in the slashes after `file:`."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def packed(file_name: Column) -> Column:
    """Whether Spark's readers open a file as what is inside. On a reader's own `_metadata.file_name`, this
    chooses files before any is opened; on its `path` column, only after a whole file was read."""
    return file_name.rlike(PACKED)


def _pieces(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, block, seq, data): the bytes of files between line feeds."""
    options = {"lineSep": "\n", "pathGlobFilter": glob, "recursiveFileLookup": "true"}
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    plain = spark.read.options(**options).text(path).where(~packed(F.col("_metadata.file_name")))
    return plain.select(*place, F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("data"))


def _placed(pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, at, data): pieces with their line feeds at their places. `sizes`: (path, bytes)."""
    lone = cut_lineage(pieces)
    size = F.octet_length("data").cast("long") + 1
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per split: what lies before it, and what the reader left out at the file's start.
    blocks = lone.groupBy("path", "block").agg(F.sum(size).alias("n"))
    whole = Window.partitionBy("path")
    starts = blocks.select("path", "block", F.coalesce(F.sum("n").over(before(["path"], "block")), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("read"))
    known = starts.join(sizes, "path").withColumn("mark", F.col("read") < F.col("bytes"))  # a byte order mark was skipped
    rows = lone.join(known, ["path", "block"])
    inner = F.coalesce(F.sum(size).over(before(["path", "block"], "seq")), F.lit(0))
    first = (F.col("start") == 0) & (F.col("inner") == 0)
    at = F.col("start") + F.col("inner") + F.when(F.col("mark") & ~first, 3).otherwise(0)
    data = F.concat(F.when(F.col("mark") & first, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit(""))), "data", F.unhex(F.lit("0A")))
    out = rows.withColumn("inner", inner).select("path", "bytes", at.alias("at"), data.alias("data"))
    # The last piece has a line feed only if the file ends with one.
    return out.select("path", "at", F.substring("data", F.lit(1), F.least(F.octet_length("data").cast("long"), F.col("bytes") - F.col("at")).cast("int")).alias("data")).where(F.octet_length("data") > 0)


def _hash(parts: Column) -> Column:
    """SHA-256 of binary parts in order, as bytes."""
    return F.unhex(F.sha2(F.aggregate(parts, F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x["data"])), 256))


def range_hashes(placed: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, place, data): the hash of every range."""
    end = F.col("at") + F.octet_length("data") - 1
    ranges = F.explode(F.sequence(F.floor(F.col("at") / size), F.floor(end / size)))
    cut = placed.select("*", ranges.alias("place")).withColumn("low", F.greatest("at", F.col("place") * size))
    upto = F.least(F.col("at") + F.octet_length("data"), (F.col("place") + 1) * size)
    part = F.substring("data", (F.col("low") - F.col("at") + 1).cast("int"), (upto - F.col("low")).cast("int"))
    ordered = F.sort_array(F.collect_list(F.struct("low", "data")))
    # Joined as text: one buffer, not one copy for every piece.
    return cut.withColumn("data", part).groupBy("path", "place").agg(ordered.alias("parts")).select(
        "path", "place", F.unhex(F.sha2(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), "")), 256)).alias("data")
    )


def file_digests(spark: SparkSession, path: str, glob: str = "*", size: int = RANGE) -> DataFrame:
    """(path, bytes, digest) of the files under `path`, as hexadecimal text."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    listed = cut_lineage(reader.load(path).select("path", F.col("length").alias("bytes")))
    plain = listed.where(~packed(F.col("path")))
    pieces = _pieces(spark, path, glob)
    same = lambda df: df.withColumn("path", one_slash(F.col("path")))
    nodes = range_hashes(_placed(same(pieces), same(plain)), size)
    left = (listed.agg(F.max("bytes")).first()[0] or 0) // size + 1  # ranges of the largest file
    while left > 1:
        up = F.floor(F.col("place") / FAN)
        ordered = F.sort_array(F.collect_list(F.struct("place", "data")))
        many = nodes.groupBy("path", up.alias("up")).agg(ordered.alias("parts"))
        # A node that stands alone goes up as it is.
        one = F.when(F.size("parts") == 1, F.col("parts")[0]["data"]).otherwise(_hash(F.col("parts")))
        nodes = many.select("path", F.col("up").alias("place"), one.alias("data"))
        left = -(-left // FAN)
    whole = reader.load(path).where(packed(F.col("_metadata.file_name"))).select("path", F.sha2("content", 256).alias("digest"))
    found = nodes.select("path", F.lower(F.hex("data")).alias("digest")).unionByName(same(whole))
    # Only a lone byte order mark has bytes and no pieces. Spark's readers do not list empty files.
    return same(listed).join(found, "path", "left").withColumn("digest", F.coalesce("digest", F.sha2(F.unhex(F.lit("EFBBBF")), 256)))
