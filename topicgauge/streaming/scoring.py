"""Documents arriving as a stream.

Cutting, embedding and scoring keep no state between documents, so a micro-batch runs the
same plan as a table. Each batch is written to its own folder, so a repeated batch replaces
its earlier output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from topicgauge.operators import diagnostics
from topicgauge.operators.embedding import Embedder
from topicgauge.plans.compare import score_documents
from topicgauge.sources.storage import write_table


def start_coverage(
    documents: DataFrame,
    queries: DataFrame,
    embedder: Embedder,
    out: str,
    checkpoint: str,
    strategy: str = "flat",
    trigger: dict[str, object] | None = None,
) -> StreamingQuery:
    """Append coverage rows per micro-batch below ``out``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        reports = diagnostics.coverage(score_documents(batch, queries, embedder, strategy))
        write_table(reports, f"{out}/batch={batch_id}")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
