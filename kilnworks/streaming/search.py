"""The same search's term statistics over a stream of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kilnworks.operators.search import term_freq


def term_freq_stream(files: DataFrame) -> DataFrame:
    """Running (kb, doc_id, token, tf); write it in update mode. State grows with the
    distinct terms of the files that have arrived, as the batch result does."""
    if not files.isStreaming:
        raise ValueError("files isn't a stream")
    return term_freq(files)
