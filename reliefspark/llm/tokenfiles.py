"""Token ids in Parquet: list columns, one row for each document, in order of doc_id.

Columns of the files: ``doc_id``, ``part`` (number of the file in the order of
doc_id), ``part_start`` (ids of the file before this document), ``n_tokens`` and
``ids`` (array<int>). Numbers that ascend are delta-encoded, ids by a dictionary
(or delta too); row groups and pages are small enough that page indexes let a
reader of few documents, or of metadata alone, skip the rest.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefspark.llm.bpe import Encoder, Vocabulary, default_tokenizer, vocabulary
from reliefspark.llm.shared import fresh_dir, table
from reliefspark.llm.textkit import slices

ROWS = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


@lru_cache(2)
def library_encoder(path: str) -> Encoder:
    """An encoder whose ids are the tokenizers library's; it is asked once for each distinct piece."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    vocab: Vocabulary = vocabulary(path)

    # An ASCII word, with or without signs behind it, is split as PATTERN does without asking the
    # library, whose model then merges it; the library's own splitting takes most of its time.
    simple, merge = re.compile(r"( ?[A-Za-z]+)([!-/:-@\[-`{-~]*)").fullmatch, library.model.tokenize

    def exact(texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if m := simple(t):
                word, signs = m.groups()
                out[i] = [x.id for x in merge(f"Ġ{word[1:]}" if word[0] == " " else word)] + ([x.id for x in merge(signs)] if signs else [])
            else:
                rest.append(i)
        for part in batched(rest, 512):  # few at a time: the library's result is far larger than the ids in it
            for i, e in zip(part, library.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    return Encoder(vocab, exact)


def write_tokens(docs: DataFrame, to: str, tokenizer: str, *, end_id: int | None = 0, ids_encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 64 << 10, page_rows: int = 256) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the files to the folder ``to``.

    Null ids of documents come first, rows that repeat one are ordered by their
    text, and equal rows are rows of their own; null text is empty, and has the
    end id alone. Texts of any length are one row. No documents make files
    without rows. One range shuffle of the text puts the documents in order.
    Extra columns, whatever their names, are left out.
    """
    if ids_encoding not in ("dictionary", "delta"):
        raise ValueError("ids_encoding is 'dictionary' or 'delta'")

    def encode(batches):
        encoder, part, before = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch, data, offsets in slices(batches, max_bytes=2 << 20):
            ids, bounds = encoder.encode(data, offsets)
            if end_id is not None:
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
            n = np.diff(bounds)
            lists = pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(before + bounds[:-1]), pa.array(n), lists], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
            before += int(bounds[-1])

    text = F.coalesce("text", F.lit("")).alias("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(ids_encoding == "dictionary").lower()}
    ordered.mapInArrow(encode, ROWS).write.options(**options).parquet(to)


def read_tokens(spark: SparkSession, path: str, *, where: Column | None = None, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """Documents of the files with their global ``start``; conditions on doc_id and absent columns are left to the scan.

    The starts of the files come from metadata columns alone: one row for each file.
    """
    rows = spark.read.schema(ROWS).parquet(path)
    sums = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    found = rows if where is None else rows.where(where)
    start = (F.col("_first") + F.col("part_start")).alias("start")
    return found.join(F.broadcast(firsts), "part").select(*(start if c == "start" else c for c in columns))


def with_crc32(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, bounds = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B"), ids.offsets.to_numpy() * 4
            sums = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token files of all documents, written and read back; nulls, empty and long texts, ties, repeated rows and an empty table as in ``write_tokens``."""
    to = fresh_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), to, tokenizer or default_tokenizer())
    return with_crc32(read_tokens(spark, to))
