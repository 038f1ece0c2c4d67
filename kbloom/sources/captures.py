"""Saved site captures: a manifest beside gzipped pages, and documents as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kbloom.functions import urls

MANIFEST = (
    "slug string, name string, url string, capturedAt string, durationMs bigint, pagesDiscovered int, "
    "pages array<struct<file: string, url: string, role: string, status: int, bytes: bigint, fetchedAt: string>>, "
    "warnings array<struct<code: string, message: string, url: string>>"
)


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each capture in ``folder``: its manifest, and the folder it lies in."""
    held = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{folder}/*/manifest.json")
    return held.withColumn("folder", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))


def captured_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, page_id, url, role, status, bytes, fetched_at, html) of every page that a manifest names.

    Files are read whole and unpacked by their extension; a page whose file is
    missing has a null html, a file that no manifest names is left out.  page_id
    is the page's place in its manifest.
    """
    listed = manifests(spark, folder).select("slug", "folder", F.posexplode("pages").alias("page_id", "p"))
    files = spark.read.text(f"{folder}/*/*.html*", wholetext=True).select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("html"))
    named = listed.withColumn("at", F.concat("folder", F.lit("/"), F.col("p.file")))
    return named.join(files, "at", "left").select("slug", "page_id", "p.url", "p.role", "p.status", "p.bytes", F.col("p.fetchedAt").alias("fetched_at"), "html")


def crawls(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved captures as finished crawls: pages, sites and warnings, as `documents.build` takes them.

    Which pages were read is the capture's, what role each plays is told anew by
    its URL.  A site's clock is the time of its capture.
    """
    held = manifests(spark, folder)
    read = captured_pages(spark, folder).select(
        F.col("slug").alias("site"), F.col("page_id").alias("place"), F.xxhash64("slug", "page_id").alias("page_id"), "url", urls.classify(F.col("url"))["role"].alias("role"), "html", "status", "bytes", "fetched_at",
    )
    sites = held.select(F.col("slug").alias("site"), F.coalesce(urls.normalize_url(F.col("url")), F.col("url")).alias("origin"), F.try_to_timestamp("capturedAt").cast("timestamp_ntz").alias("now"))
    said = held.select(F.col("slug").alias("site"), F.posexplode("warnings").alias("seq", "w")).select("site", "seq", "w.*")
    return read, sites, said


def export_json(documents: DataFrame, path: str, key: str = "slug") -> None:
    """Write ``documents(key, document)`` as text, one JSON document a line, in folders by key."""
    documents.select(key, F.col("document").alias("value")).write.partitionBy(key).text(path)


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Documents of `export_json`: as JSON text, or parsed by a schema; keys are kept."""
    if schema is None:
        return spark.read.text(path).withColumnRenamed("value", "document")
    return spark.read.schema(schema).json(path)
