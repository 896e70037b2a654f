"""Serving a stream of requests (the reference answers HTTP requests one at a time;
here requests arrive as a Structured Streaming source and every micro-batch is
answered by the batch router against the trained models).

Each micro-batch is written to its own ``batch_id=<n>`` folder with overwrite, so
a replayed batch after a failure replaces its earlier output: the sink is
idempotent and the query restarts from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketry.operators import content, router
from basketry.sources.store import TrainedModels

REQUEST_SCHEMA = "user_id string, state string, n int"
SIMILAR_SCHEMA = "product_id string, n int"


def _writer(sink: str, answer):
    def write(batch: DataFrame, batch_id: int) -> None:
        (answer(batch).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}"))
    return write


def serve_recommendations(requests: DataFrame, models: TrainedModels, sink: str,
                          checkpoint: str, available_now: bool = True,
                          envelopes: bool = False) -> StreamingQuery:
    """R1 over a request stream ([request_id], user_id, state, n). With ``envelopes`` one
    row per request is written (R3), also for rejected and unanswered ones."""
    def answer(batch: DataFrame) -> DataFrame:
        asked = router.prepared(batch).drop("accepted")
        recs = router.recommend_for_users(asked, models.popularity, models.als,
                                          models.history, models.product_profiles)
        return router.answers(asked, recs) if envelopes else recs
    w = (requests.writeStream.foreachBatch(_writer(sink, answer))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def serve_similar(requests: DataFrame, models: TrainedModels, sink: str,
                  checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """R2 over a stream of (product_id, n) requests."""
    def answer(batch: DataFrame) -> DataFrame:
        sim = content.similar(models.content, batch)
        recs = sim.select(F.col("product_id").alias("query_product_id"), "rank",
                          F.col("similar_id").alias("product_id"))
        return router.enrich(recs, models.product_profiles)
    w = (requests.writeStream.foreachBatch(_writer(sink, answer))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
