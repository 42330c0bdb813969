"""File sources and sinks: whole files, images, delimited text, metadata documents."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import delimited
from gridloom.operators import images as pixels


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, channels, data); files that don't decode are dropped, see `corrupt_images`."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def gray_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, pixels, color_variance, mean_colors): what the image operators read, pixels in rows of ``width``."""
    found = images(spark, path).withColumn("color", pixels.colors("data", "channels"))
    return found.select("origin", "width", "height", pixels.gray("data", "channels").alias("pixels"), F.col("color.variance").alias("color_variance"), F.col("color.means").alias("mean_colors"))


def corrupt_images(spark: SparkSession, path: str) -> DataFrame:
    """(name, issue, severity) of the image files that don't decode."""
    bad = spark.read.format("image").load(path).where("image.width < 0 or image.data is null")
    return bad.select(F.regexp_extract("image.origin", "[^/]*$", 0).alias("name"), F.lit("corrupt_image").alias("issue"), F.lit("critical").alias("severity"))


def png_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of a folder's PNG files by name, for images without metadata."""
    return binary_files(spark, path, "*.png").select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content")


def delimited_grids(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Each delimited text file as a grid of cells, quoted ones unquoted; null cells where a file doesn't parse."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.input_file_name().alias("path"), "value").select("path", delimited.grid("value", delimiter).alias("cells"))


def table_files(grids: DataFrame) -> DataFrame:
    """(name, content) of grids (name, cells): each one's delimited text, quoted where it must be."""
    return grids.select("name", delimited.text(F.col("cells")).alias("content"))


def write_files(files: DataFrame, path: str) -> int:
    """Write files (name, content; text or bytes) as rows of Parquet, many to a file, through Spark's committer, so that readers never see half of them,
    and in place of what was there. Returns how many; raises where the rows read back aren't as many."""
    files.select("name", "content").write.mode("overwrite").parquet(path)
    written, given = read_files(files.sparkSession, path).count(), files.count()
    if written != given:
        raise OSError(f"{path}: {written} of {given} files were written")
    return written


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_grids(grids: DataFrame, path: str) -> int:
    """Write grids (name, cells) as delimited texts; see `write_files`."""
    return write_files(table_files(grids), path)


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """(name, cells) of what `write_grids` wrote."""
    return read_files(spark, path).select("name", delimited.grid("content").alias("cells"))


def export_files(files: DataFrame, path: str) -> None:
    """One folder a file, ``name=<name>/``, for tools that want files; for thousands of them, not for a corpus. Text contents only."""
    files.repartition("name").select("name", F.regexp_replace("content", "\n$", "").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Write JSON texts (document) one a line, in place of what was there."""
    documents.select("document").write.mode("overwrite").text(path)


def write_summary(tables: DataFrame, path: str) -> None:
    """Write a catalog as delimited text with a header; nothing without rows. It is kept out of the folder of the tables."""
    if not tables.isEmpty():
        tables.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def metadata_json(spark: SparkSession, path: str) -> DataFrame:
    """Metadata documents; a file that doesn't parse gives nulls."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or a temporary one where that is unset and the master is local; deleted when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    path = f"{root.rstrip('/')}/gridloom-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return path
