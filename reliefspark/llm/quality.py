"""Quality rules: repetition within a document, and lines that many documents of a host share.

``quality`` measures and judges, ``without_frequent_lines`` gives the documents
that are kept, without the lines that too many documents of their host have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm.shared import table, written
from reliefspark.llm.textkit import U64, Spans, grouped, hash_spans, mix, slices, spans, words

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between each two offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def repeat_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, window: int = 5) -> np.ndarray:
    """By row: words in windows that the row has twice or more. ``rows``: number of words before each row.

    Words are numbered by their bytes, so windows are equal where all numbers are.
    """
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    keys = Spans(data, starts, ends).groups()[2]
    inside = np.flatnonzero(row[: max(0, len(row) - window + 1)] == row[window - 1 :]) if len(row) >= window else np.zeros(0, np.int64)
    number = row[inside]
    for i in range(window):  # pairs of the number so far and the next word's, numbered in turn
        number = np.unique(number << 32 | keys[inside + i], return_inverse=True)[1]
    twice = inside[np.bincount(number)[number] > 1] if len(number) else inside
    steps = np.bincount(twice, minlength=len(keys) + 1) - np.bincount(twice + window, minlength=len(keys) + 1)[: len(keys) + 1]
    return by_row(np.cumsum(steps[: len(keys)]) > 0, rows)


def worded_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end and words of each line with a word, such lines before each document); ``starts``: where the words begin."""
    begins, closes, line_rows = spans(data != 0x0A, offsets)
    held = np.diff(np.searchsorted(starts, np.append(begins, len(data))))
    with_word = held > 0
    kept = np.concatenate([[0], np.cumsum(with_word)])[line_rows]
    return begins[with_word], closes[with_word], held[with_word], kept


def line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Hash of each line by its words, without case and spacing."""
    keys, first = hash_spans(data, starts, ends, lower=True), np.searchsorted(starts, begins)
    order = np.arange(len(keys)) - np.repeat(first, held)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(keys + mix(order.astype(U64))))])
    return mix(sums[first + held] - sums[first])


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Metrics by document; and of the lines with a word: hash without case and spacing, words, and lines before each document."""
    starts, ends, rows = words(data, offsets)
    out = {"n_words": np.diff(rows)}
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    in_word = np.cumsum(inside[:-1]).astype(bool)
    out["word_chars"] = by_row(in_word & ((data & 0xC0) != 0x80), offsets)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = by_row(symbol[data], offsets)
    out["n_repeat_words"] = repeat_words(data, starts, ends, rows)
    begins, closes, held, kept = worded_lines(data, offsets, starts)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(kept))
    number = Spans(data, begins, closes).groups()[2]
    distinct = np.unique(row << 32 | number) >> 32
    out["n_dup_lines"] = np.diff(kept) - np.bincount(distinct, minlength=len(offsets) - 1)
    return out, line_hashes(data, starts, ends, begins, held), held, kept


LINES = "row long, doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h: long, n: int>>"


def line_table(docs: DataFrame, host: str) -> DataFrame:
    """Metrics of each document and its distinct lines (hash, words in all its occurrences); written, as it is read thrice."""

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch, data, offsets in slices(batches):
            metrics, normal, held, kept = measure(data, offsets)
            row = np.repeat(np.arange(len(batch)), np.diff(kept))
            _, first, number = grouped(normal ^ mix(row.astype(U64) + U64(1)))
            first_row = row[first]
            order = np.argsort(first_row, kind="stable")
            n = np.bincount(number, weights=held, minlength=len(first)).astype(np.int32)[order]
            lists = pa.ListArray.from_arrays(np.searchsorted(first_row[order], np.arange(len(batch) + 1)).astype(np.int32), pa.StructArray.from_arrays([pa.array(normal[first][order].view(np.int64)), pa.array(n)], ["h", "n"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(batch))), *(batch.column(c) for c in ("doc_id", "host", "text_key")), *(pa.array(metrics[m].astype(np.int64)) for m in METRICS), lists], names=["row", "doc_id", "host", "text_key", *METRICS, "lines"])
            at += len(batch)

    return written(docs.select(*names_of(docs, host), "text").mapInArrow(run, LINES), "lines")


def names_of(docs: DataFrame, host: str) -> list[Column]:
    """What a document is known by: doc_id, host and text_key; documents with the same three have the same lines and verdict."""
    return [docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[host].cast("string"), F.lit("")).alias("host"), F.xxhash64(docs["text"]).alias("text_key")]


def judged(rows: DataFrame, min_docs: int, share: float, least_words: int, least_share: float) -> DataFrame:
    """``rows`` of the line table with verdicts, and the hashes of each document's frequent lines (null for none)."""
    lines = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.n")
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("_docs"))
    counts = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_docs)
    frequent = counts.join(sizes, "host").where(F.col("_n") > share * F.col("_docs")).select("host", "h")
    removed = lines.join(frequent, ["host", "h"]).groupBy("row").agg(F.sum("n").alias("_gone"), F.collect_list("h").alias("frequent"))
    left = F.col("n_words") - F.coalesce("_gone", F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (left >= least_words) & (left >= least_share * F.col("n_words"))
    return rows.drop("lines").join(removed, "row", "left").withColumns({"base_failed": failed, "kept": kept, "n_words_left": left})


def quality(docs: DataFrame, *, host: str = "source", min_docs: int = 20, share: float = 0.002, least_words: int = 3, least_share: float = 0.2) -> DataFrame:
    """Metrics and verdict of each row of ``docs`` (doc_id, text and the column ``host``).

    A line is removed where more than ``min_docs`` documents of its host, and
    more than ``share`` of them, have it (lines are compared without case and
    spacing). ``base_failed``: under 10 words, or over 20 % of them repeated. A
    document is kept if it didn't fail and at least ``least_words`` words and
    ``least_share`` of its words remain. Null text is empty, a null host is a
    host of its own, rows that repeat an id are documents of their own. A line
    that just as many documents have as the limits say stays. Texts of any
    length are measured whole; no rows give none; other columns, whatever their
    names, are left out.

    A host or line that a third of all rows share is summed up before the
    shuffle; the join back has one row for each frequent line on its other side.
    """
    found = judged(line_table(docs, host), min_docs, share, least_words, least_share)
    return found.select("doc_id", *METRICS, "base_failed", "kept", F.coalesce(F.size("frequent"), F.lit(0)).cast("long").alias("n_frequent_lines"), "n_words_left")


def without_frequent_lines(docs: DataFrame, *, host: str = "source", min_docs: int = 20, share: float = 0.002, least_words: int = 3, least_share: float = 0.2) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, all their columns, without the frequent lines in ``text``.

    Nulls, empty and long texts, ties, repeated rows and empty tables as in
    ``quality``; of the columns' names only _i, _h, _k and _gone may not be used.
    """
    found = judged(line_table(docs, host), min_docs, share, least_words, least_share).where("kept")
    found = found.select(F.col("doc_id").alias("_i"), F.col("host").alias("_h"), F.col("text_key").alias("_k"), F.col("frequent").alias("_gone")).dropDuplicates(["_i", "_h", "_k"])
    (i, h, k), names = names_of(docs, host), docs.columns
    joined = docs.withColumns({"_ri": i, "_rh": h, "_rk": k})
    joined = joined.join(found, F.col("_ri").eqNullSafe(F.col("_i")) & (F.col("_rh") == F.col("_h")) & (F.col("_rk") == F.col("_k"))).select(*docs.columns, "_gone")

    def clean(batches):
        for batch, data, offsets in slices(batches):
            starts, ends, _ = words(data, offsets)
            begins, closes, held, kept = worded_lines(data, offsets, starts)
            normal = line_hashes(data, starts, ends, begins, held).view(np.int64)
            texts = batch.column("text").to_pylist()
            for r, gone in enumerate(batch.column("_gone").to_pylist()):
                if gone:
                    own = slice(kept[r], kept[r + 1])
                    hit = np.isin(normal[own], np.array(gone, np.int64))
                    out, at = [], int(offsets[r])
                    for a, b in zip(begins[own][hit].tolist(), closes[own][hit].tolist(), strict=True):
                        out.append(data[at:a].tobytes())
                        at = min(b + 1, int(offsets[r + 1]))
                    texts[r] = (b"".join(out) + data[at : offsets[r + 1]].tobytes()).decode("utf-8")
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(clean, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of all documents; their source is the host. Nulls, empty and long texts, ties, repeated rows and an empty table as in ``quality``."""
    return quality(table(spark, sf_dir, "documents"))
