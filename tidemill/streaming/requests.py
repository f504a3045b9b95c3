"""A stream of requests through the retrieval plan: stateless, so append mode needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import retrieval


def read_requests(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """JSON lines {"request_id": ..., "args": "..."} as they arrive in a folder."""
    return spark.readStream.schema("request_id long, args string").option("maxFilesPerTrigger", files_per_trigger).json(path)


def serve(requests: DataFrame, dns: DataFrame, responses: DataFrame, out: str, checkpoint: str, robots: DataFrame | None = None, settings: retrieval.Settings | None = None) -> StreamingQuery:
    """Answers all requests that are there, and stops; results go to Parquet, each once. The lookups are static tables,
    read anew by each batch."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        edges = retrieval.redirect_edges(responses, dns, settings or retrieval.Settings())
        retrieval.run(batch, dns, responses, robots, settings, edges).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        edges.unpersist()

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
