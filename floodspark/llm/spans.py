"""Removing byte ranges from documents: shared by the substring operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import runs, utf8

REDUCED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def row_key() -> Column:
    """Names a document's row by its key and text; rows that repeat both have one name."""
    return F.xxhash64("doc_id", "text", F.lit(1))


def without_ranges(docs: DataFrame, ranges: DataFrame, *counts: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the bytes that stay.

    ``docs`` has doc_id, text and doc_row; ``ranges`` has doc_row and an array ``cut`` of byte ranges (start, end),
    which may overlap. Columns ``counts`` of ``ranges`` are carried along, 0 where a row has none. A null text is empty.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            cuts = batch.column(2)
            rows = []
            for k in range(batch.num_rows):
                text = data[at[k]:at[k + 1]]
                if not cuts[k].is_valid or not len(cuts[k]):
                    rows.append((len(text), 0, 0, text.tobytes()))
                    continue
                pair = cuts[k].values
                change = np.zeros(len(text) + 1, np.int32)
                np.add.at(change, pair.field(0).to_numpy(), 1)
                np.add.at(change, pair.field(1).to_numpy(), -1)
                gone = np.cumsum(change)[:len(text)] > 0
                rows.append((len(text), int(gone.sum()), len(runs(gone)[0]), text[~gone].tobytes()))
            columns = zip(*rows) if rows else ((),) * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds)), *batch.columns[3:]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *counts])

    joined = docs.join(ranges.select("doc_row", "cut", *counts), "doc_row", "left").select(
        "doc_id", "text", "cut", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))
    return joined.mapInArrow(work, REDUCED + "".join(f", {c} long" for c in counts))
