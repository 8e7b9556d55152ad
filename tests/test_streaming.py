"""The row-local scorer runs unchanged on a file stream."""

import os
import tempfile

from kestrel.sources import tables
from kestrel.streaming.scoring import transform_stream


def test_stream_scoring_matches_batch(spark, sf_small):
    src = tempfile.mkdtemp(prefix="kestrel-stream-src-")
    probs = tables.probs(spark, sf_small).select("id", "p0", "p1", "p2")
    probs.repartition(3).write.mode("overwrite").parquet(os.path.join(src, "part"))
    stream = spark.readStream.schema(probs.schema).parquet(os.path.join(src, "part"))
    out = transform_stream(stream, factors=(1.15, 1.05, 0.92))
    q = (out.writeStream.format("memory").queryName("kestrel_stream_test")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="kestrel-stream-ck-")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT id, label FROM kestrel_stream_test").toPandas().sort_values("id")
    exp = transform_stream(probs, factors=(1.15, 1.05, 0.92)).select("id", "label").toPandas().sort_values("id")
    assert len(got) == probs.count()
    assert (got.label.to_numpy() == exp.label.to_numpy()).all()
