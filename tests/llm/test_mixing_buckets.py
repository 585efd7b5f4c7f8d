"""Keys of rows of any quality are spread evenly over a source's buckets, in key order."""

import numpy as np
from pyspark.sql import functions as F

from trackloom.llm import mixing


def test_low_quality_rows_fill_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 200)
    i = F.col("id")
    text = F.when(i % 3 == 0, F.lit(None).cast("string")).when(i % 3 == 1, F.lit("#### 1234")).otherwise(F.concat(F.lit("plain words "), F.col("id").cast("string")))
    docs = spark.range(20_000).select(i.alias("doc_id"), text.alias("text"), F.when(i % 10 == 0, "b").otherwise("a").alias("source"))
    rows = mixing.bucketed(docs, [5, 2, 1], 3).select("source", "bucket", "rank_key").toPandas()
    for _, own in rows.groupby("source"):
        sizes = own.groupby("bucket").size()
        assert sizes.max() < 2 * 200 and len(sizes) == int(np.ceil(len(own) / 200))
        low, high = own.groupby("bucket").rank_key.min(), own.groupby("bucket").rank_key.max()
        assert (high.to_numpy()[:-1] <= low.to_numpy()[1:]).all()
