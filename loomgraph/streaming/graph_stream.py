"""An extension: graph tables kept up to date from a stream of triples, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.graph import edge_rows, gate_direction, with_ids


def edge_stream(triples: DataFrame, event_time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Edges of each window with support and largest confidence; triples later than `late` are dropped, so state is bounded."""
    gated = with_ids(gate_direction(edge_rows(triples)).where("action <> 'drop'"))
    return gated.withWatermark(event_time, late).groupBy(F.window(event_time, window), "src_id", "rel_type", "dst_id").agg(F.count(F.lit(1)).alias("support_count"), F.max("conf").alias("conf_max"))


def write_edges(edges: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished windows as Parquet until the stream has no more data for now."""
    return edges.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
