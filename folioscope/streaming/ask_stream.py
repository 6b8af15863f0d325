"""Questions from a stream, answered batch by batch against a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import answers, fusion
from ..settings import Settings


def answer_stream(questions: DataFrame, index: fusion.Index, checkpoint: str, sink: str, settings: Settings | None = None, **trigger) -> StreamingQuery:
    """``questions(qid, question)``, a stream, to Parquet answers below ``sink``. A batch that is run again
    after a failure overwrites its own folder, so answers are written once."""

    def each(batch: DataFrame, number: int) -> None:
        found = answers.answer(fusion.retrieve(batch, index, settings))
        found.drop("error").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
