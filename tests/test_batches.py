"""Batches of pages to Python are bounded by their text."""

from pyspark.sql import functions as F

from kbloom.operators import crawl


def test_batches_of_pages_are_bounded_by_bytes(spark):

    def rows(batches):
        for batch in batches:
            yield batch.iloc[:1].assign(n=len(batch))[["n"]]

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    pages = spark.range(4000, numPartitions=1).select(F.col("id").alias("page_id"), F.lit("https://a.com/").alias("url"), F.repeat(F.lit("some text "), 500).alias("html"))
    assert crawl.links(pages).count() == 0
    assert max(r.n for r in pages.mapInPandas(rows, "n long").collect()) < 1000
