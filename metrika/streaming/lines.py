"""Line parsing of streams: the line plan is stateless, so it runs on a stream as it does on a table.

Poem-level analysis needs whole texts and is not offered on streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from metrika.operators import parse, tokens, units


def units_of_stream(stream: DataFrame, text_id: str = "doc_id") -> DataFrame:
    """A stream of (id, text) as encoded parse units: append mode, no state."""
    return units.encoded(tokens.line_parts(stream, text_id))


def parse_stream(stream: DataFrame, path: str, checkpoint: str, text_id: str = "doc_id", meter: parse.Meter = parse.DEFAULT) -> StreamingQuery:
    """Parse every batch of a stream and append the best parses as Parquet at `path`, once per batch number."""

    def batch(rows: DataFrame, number: int) -> None:
        best = parse.with_properties(parse.best_of(tokens.line_parts(rows, text_id), meter))
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
