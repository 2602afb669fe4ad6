"""The row-local feature projection gives the same rows on a stream."""

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.session import scratch_path
from quire.sources.fixtures import document_listings
from quire.streaming.features import feature_projection, stream_features
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    src = scratch_path(spark, "stream-src")
    d = document_listings(spark, SF_SMALL).select("sku_id", "title", "short_description")
    d.write.parquet(src)
    feats = {"title_len": X.char_len("title"), "digits": X.digit_count("short_description"),
             "shape_n": X.shape_nunique("title")}
    sink = scratch_path(spark, "stream-sink")
    q = stream_features(spark, src, d.schema, "sku_id", feats, sink)
    q.awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(sink).collect()))
    want = sorted(map(tuple, feature_projection(spark.read.parquet(src), "sku_id", feats).collect()))
    assert got == want and len(got) > 0
