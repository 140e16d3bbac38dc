"""Packing by power-of-two decomposition: no sequence holds parts of two documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.functions.lineage import shared_folder, stored
from tabscout.llm.ship import ship
from tabscout.llm.tokens import word_encoder

# Texts that are encoded before their pieces are handed on.
_TEXTS = 128


def binary_lengths(tokens: int, longest: int) -> list[int]:
    """``tokens`` as whole sequences of ``longest`` and the powers of two of the rest, largest first."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in reversed(range(longest.bit_length())) if rest >> b & 1]


def token_pieces(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, key: str = "doc_id") -> DataFrame:
    """One row per piece: ``<key>, start, length, doc_tokens, ids``.

    ``ids`` are little-endian unsigned 32-bit token ids; a document's last id is
    ``end_id``. A null text counts as empty, so it has that one id. Repeated
    rows each give their own pieces. ``longest`` is a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    fields = [("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for whole in batches:
            for begin in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(begin, _TEXTS)
                rows, out = [], ([], [], [], [])
                for row, ids in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids += end
                    start, tokens = 0, len(ids) // 4
                    for length in binary_lengths(tokens, longest):
                        rows.append(row)
                        for column, value in zip(out, (start, length, tokens, ids[4 * start : 4 * (start + length)]), strict=True):
                            column.append(value)
                        start += length
                columns = [pa.array(x, kind) for x, (_, kind) in zip(out, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], [key, *(n for n, _ in fields)])

    long = T.LongType()
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType)]
        + [T.StructField(n, long) for n in ("start", "length", "doc_tokens")]
        + [T.StructField("ids", T.BinaryType())]
    )
    return docs.select(F.col(f"`{key}`").alias(key), F.col("text").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Packed sequences: the pieces of ``token_pieces`` plus ``sequence_id`` and ``offset``.

    Every piece is a power of two long and is a sequence by itself, so there is
    no padding and no sequence crosses documents. Pieces are written to ``path``
    (a new folder of the shared one if None) in one directory per length, from
    which a trainer reads batches of one length. ``sequence_id`` counts the
    sequences of the shortest length first, then the next, without gaps: the
    position in its file plus the rows of the files before it, so nothing but
    one counter per file is moved. An empty table gives no sequence.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, tokenizer, longest, end_id, key)
    path = path or f"{shared_folder(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
    pieces.write.partitionBy("length").parquet(path)
    written = spark.read.schema(pieces.schema).parquet(path)
    placed = written.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = stored(placed.groupBy("length", "_file").agg(F.count(F.lit(1)).alias("rows")))
    before = W.partitionBy("length").orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    shorter = W.orderBy("length").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    lengths = counts.groupBy("length").agg(F.sum("rows").alias("rows")).select("length", F.coalesce(F.sum("rows").over(shorter), zero).alias("base"))
    files = (
        counts.withColumn("before", F.coalesce(F.sum("rows").over(before), zero))
        .join(F.broadcast(lengths), "length")  # one row per power of two
        .select("_file", (F.col("base") + F.col("before")).alias("first"))
    )
    # Written first, so that Spark knows its size and moves the smaller side.
    return placed.join(stored(files), "_file").select(
        f"`{key}`", "start", "length", "doc_tokens", "ids", (F.col("first") + F.col("_row")).alias("sequence_id"), zero.alias("offset")
    )
