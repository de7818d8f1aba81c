"""Scoring an observation stream: an extension; each row is scored by itself, so no state or watermark is needed.

The ranking over a row's few candidates is done inside each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.dual_view import score_dual_view


def score_stream(observations: DataFrame, profiles: DataFrame, path: str, checkpoint: str, key: str = "obs_id", once: bool = False) -> StreamingQuery:
    """Write the five best candidates of each observation of a stream to Parquet under ``path``, by batch.

    A batch tried again overwrites its own folder, so every observation is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        score_dual_view(batch, profiles, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = observations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
