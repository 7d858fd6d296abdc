"""Helpers that the operators share: tables, durable lineage cuts, words."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table  # noqa: F401 (the operators take it from here)
from ..session import durable, stored  # noqa: F401

#: The separators of words: ``[\x20\x09-\x0D]``.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True


#: Ids of at most this many documents are broadcast; more meet the documents in a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose ids (null is one) are not among the ``ids`` (one column)."""
    gone = durable(ids.toDF("gone_id").distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]), "left_anti")


def give_back() -> None:
    """Return memory that a worker has freed but keeps: workers of one executor live on between stages, and share its bounds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (byte offsets) of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text."""
    if not data:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty
    space = _IS_SPACE[np.frombuffer(data, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def normal_words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space each, with the starts and ends of the words in the joined bytes."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    return b" ".join(words), ends - sizes, ends


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
