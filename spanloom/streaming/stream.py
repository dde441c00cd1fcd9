"""Documents from a stream: no operator crosses doc_id, so each micro-batch is analysed by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans.analyze import Analysis, Analyzer


def analyze_stream(stream: DataFrame, analyzer: Analyzer, sink: Callable[[Analysis, int], None], checkpoint: str, key: str = "doc_id", text: str = "text"):
    """Start a query that hands the analysis of each micro-batch to sink(analysis, batch_id).

    A batch may be handed over again after a failure, under the same batch_id: sinks replace by it.
    """
    return stream.writeStream.foreachBatch(lambda batch, n: sink(analyzer.analyze(batch, key, text), n)).option("checkpointLocation", checkpoint).start()
