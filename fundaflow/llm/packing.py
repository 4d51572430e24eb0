"""Packing by power-of-two decomposition.

A document's ids are cut into pieces of the longest power of two that still fits, at most `width`: as many
whole widths as there are, then the binary digits of the rest from the highest down.  Every piece is one
sequence of exactly its own length, so no sequence crosses documents and none is padded; pieces of the same
length form a bucket, which a trainer reads batch by batch.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundaflow.llm.shared import arrow_map, pick
from fundaflow.llm.tokens import tokenizer

WIDTH = 4096


def piece_lengths(n: int, width: int = WIDTH) -> list[int]:
    """Powers of two, falling, that add up to n and do not exceed width (itself a power of two)."""
    if width < 1 or width & (width - 1):
        raise ValueError("the width has to be a power of two")
    rest = n % width
    return [width] * (n // width) + [1 << b for b in range(width.bit_length() - 2, -1, -1) if rest >> b & 1]


def packed(docs: DataFrame, path: str, end_id: int = 2, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 length), ids if asked for.

    ids_crc32 is over the piece's ids as little-endian unsigned 32-bit numbers.  A null or empty text is the
    end id alone, one piece of length 1.  Repeated rows and null ids are documents like any other.  Each
    sequence holds one piece, at offset 0; sequence_id numbers the pieces within the partitions, without a
    shuffle or a sort.
    """
    piece_lengths(0, width)
    source = pick(docs, _id=id_col, _text=text_col)
    kind = source.schema["_id"].dataType.simpleString()
    end = np.array([end_id], np.uint32).tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, start, length, crc, total, ids = [], [], [], [], [], []
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for row, body in enumerate(tokenizer(path).id_bytes(texts)):
            data = memoryview(body + end)
            n, at = len(data) // 4, 0
            for size in piece_lengths(n, width):
                piece = data[4 * at : 4 * (at + size)]
                rows.append(row)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(piece))
                total.append(n)
                if with_ids:
                    ids.append(bytes(piece))
                at += size
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
        return pa.record_batch([*columns, pa.array(ids, pa.binary())], names=[*names, "ids"]) if with_ids else pa.record_batch(columns, names=names)

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = arrow_map(source, cut, schema, rows=1000)
    return pieces.select(
        f"`{id_col}`", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"), *(["ids"] if with_ids else []),
    )


def write_sequences(pieces: DataFrame, folder: str) -> None:
    """The sequences in one folder per bucket, for a reader that batches equal lengths."""
    pieces.write.partitionBy("bucket").mode("overwrite").parquet(folder)
