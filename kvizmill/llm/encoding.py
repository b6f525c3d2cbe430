"""Problem 8: token ids of every document."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvizmill.llm.bytebpe import default_vocabulary, encoder
from kvizmill.session import spread

#: Ids in one batch handed back to Spark, so that long documents don't add up in memory.
BATCH_IDS = 2_000_000


def shipped(docs: DataFrame, path: str) -> str:
    """The name under which a vocabulary file of the driver goes with the job to every executor."""
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def _encode(batches: Iterator[pa.RecordBatch], name: str, sizes_only: bool) -> Iterator[pa.RecordBatch]:
    bpe = encoder(SparkFiles.get(name))

    def batch(keys: list, ids: list[bytes]) -> pa.RecordBatch:
        sizes = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
        key = pa.array(keys, type=pa.int64())
        if sizes_only:
            return pa.RecordBatch.from_arrays([key, pa.array(sizes)], names=["doc_id", "size"])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
        return pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "ids"])

    for b in batches:
        keys, ids, held = [], [], 0
        for key, text in zip(b.column(0).to_pylist(), b.column(1)):
            keys.append(key)
            ids.append(bpe.encode_bytes(text.as_py()))
            held += len(ids[-1]) // 4
            if held >= BATCH_IDS:
                yield batch(keys, ids)
                keys, ids, held = [], [], 0
        if keys:
            yield batch(keys, ids)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids``: one row for each row of ``docs``.

    Needs ``doc_id`` and ``text``; other columns are left behind, whatever they
    are called. A null, empty or missing text has an empty list, never null; a
    text of white space has the ids of the white space. A repeated row comes out
    as often as it came in, and a null ``doc_id`` stays null. Each partition is
    encoded where it is read, but for inputs of fewer splits than cores.
    """
    name = shipped(docs, vocabulary or default_vocabulary())
    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(
        lambda batches: _encode(batches, name, False), "doc_id long, ids array<int>"
    )


def document_sizes(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, size``: the number of ids ``encode_documents`` gives, without the ids."""
    name = shipped(docs, vocabulary or default_vocabulary())
    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(
        lambda batches: _encode(batches, name, True), "doc_id long, size long"
    )
