"""Line dedup by content-defined chunks, in DataFrame functions alone.

A rolling hash over the last two lines is taken at every line (a line of many
words has one of its own). A chunk begins where this hash comes again anywhere
in the corpus and ends where it stops to, so its bounds depend on its lines
alone, wherever it stands. Chunks are compared byte by byte with their first
occurrence, and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm.shared import table, written

#: Stands for a null doc_id: last in the order of documents.
LAST = (1 << 63) - 1


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds what names a row: ``_id`` (doc_id) and ``_mark`` (hash of the text)."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_mark": F.xxhash64("text")})


def windows(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(_id, _mark, w): the least stretches of each document that count when they come again.

    These are any ``min_lines`` lines of which one has a word, fewer lines of
    ``min_words`` words, and two lines with words that so many empty ones part
    that the other windows don't reach across. Each has a start (from 0), n and h.
    """
    lines = docs.select("_id", "_mark", F.split("text", "\n", -1).alias("lines")).where(F.size("lines") > 0)
    hashed = lines.withColumns({"_h": F.transform("lines", lambda x: F.xxhash64(x)), "_w": F.transform("lines", n_words)})
    window = lambda i, n: F.struct(i.cast("int").alias("start"), F.lit(n).cast("int").alias("n"), F.xxhash64(F.slice("_h", i + 1, n)).alias("h"))
    places = F.sequence(F.lit(0), F.size("lines") - 1)

    def of(n: int) -> Column:
        """All windows of ``n`` lines; places past the end have no words that could be counted."""
        held = lambda i: sum((F.get("_w", i + k) for k in range(1, n)), F.get("_w", i)) >= (1 if n == min_lines else min_words)
        return F.transform(F.filter(places, lambda i: F.coalesce(held(i), F.lit(False))), lambda i: window(i, n))

    found = [of(n) for n in range(1, min_lines + 1)]
    with_word = hashed.withColumn("_at", F.filter(places, lambda i: F.get("_w", i) > 0))
    apart = F.filter(F.transform("_at", lambda i, k: F.struct(i.alias("i"), (F.get("_at", k + 1) - i + 1).alias("n"))), lambda x: x["n"] > 2 * min_lines)
    found.append(F.transform(apart, lambda x: window(x["i"], x["n"])))
    # unfolded as an expression: of a column, Spark would infer a filter and push it below the hashes, which every line would then compute anew
    return with_word.select("_id", "_mark", F.explode(F.concat(*found)).alias("w"))


def repeated_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 50) -> DataFrame:
    """(_id, _mark, gone, chunks): numbers of the lines to remove from each document that has such, and how many stretches they make.

    A maximal run of lines that an earlier place has too goes where it has
    ``min_lines`` lines or ``min_words`` words, with at most ``min_lines`` - 1
    lines without a word at either end. Such a run is covered by windows that
    come again, and a window that comes again lies in such a run; so windows
    alone are looked up. The smallest (doc_id, place) keeps each, and with it
    every line stays where it comes first. Hashes find candidates in narrow
    rows, summed up before the shuffle; the lines of windows that come again
    are then shuffled once and compared.
    """
    docs = keyed(docs).select("_id", "_mark", "text")
    narrow = windows(docs, min_lines, min_words).select(F.struct("_id", "_mark", "w.start", "w.n").alias("at"), "w.h")
    narrow = written(narrow, "windows")
    firsts = narrow.groupBy("h").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").select("h", "first")
    again = written(narrow.join(firsts, "h").where("at <> first").select("at", "first").distinct(), "again")

    own = again.groupBy("at._id", "at._mark").agg(F.collect_list(F.struct("at.start", "at.n", "first")).alias("mine"))
    asked = again.select("first").distinct().groupBy("first._id", "first._mark").agg(F.collect_list(F.struct("first.start", "first.n")).alias("asked"))
    needs = own.join(asked, ["_id", "_mark"], "full")
    # what leaves a document: its windows that come again, and those that others are compared with
    held = docs.join(needs, ["_id", "_mark"]).dropDuplicates(["_id", "_mark"]).withColumn("lines", F.split("text", "\n", -1))
    body = lambda x: F.slice("lines", x["start"] + 1, x["n"]).alias("body")
    mine = F.transform("mine", lambda x: F.struct(F.lit(False).alias("whole"), x["first"].alias("key"), x["start"].alias("start"), body(x)))
    theirs = F.transform("asked", lambda x: F.struct(F.lit(True).alias("whole"), F.struct("_id", "_mark", x["start"].alias("start"), x["n"].alias("n")).alias("key"), x["start"].alias("start"), body(x)))
    empty = F.array().cast("array<struct<whole:boolean,key:struct<_id:bigint,_mark:bigint,start:int,n:int>,start:int,body:array<string>>>")
    both = held.select("_id", "_mark", F.explode(F.concat(F.coalesce(mine, empty), F.coalesce(theirs, empty))).alias("p")).select("_id", "_mark", "p.*")
    both = written(both, "pieces")
    wholes = both.where("whole").select("key", F.col("body").alias("o_body"))
    equal = both.where("not whole").join(wholes, "key").where(F.col("body") == F.col("o_body"))
    found = equal.groupBy("_id", "_mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("key.n") - 1))))).alias("gone"))
    # a stretch begins at a line that doesn't follow another
    return found.withColumn("chunks", F.size(F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", i - 1) != x - 1))))


def line_dedup(docs: DataFrame, *, drop_emptied: bool = False, **how) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and n_lines, n_removed and n_chunks besides.

    Null texts stay null, with no lines; an empty text is one line without a
    word. Texts and passages of any length are looked at whole. Rows that repeat
    both id and text are one document: each keeps what the other keeps. Of equal
    passages the one in the smallest doc_id stays, within a document the first;
    a null doc_id comes last in the order of documents. No rows give none. All
    columns stay, but input columns n_lines, n_removed and n_chunks are replaced
    and _id, _mark, gone and chunks may not be used. With ``drop_emptied`` rows
    go that lose all their words.
    """
    gone = repeated_lines(docs, **how)
    joined = keyed(docs).join(gone, ["_id", "_mark"], "left")
    lines = F.split("text", "\n", -1)
    n = F.coalesce(F.size(lines), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n)
    # the lines between two removed ones, in order
    ends = F.concat("gone", F.array(F.size(lines)))
    rest = F.flatten(F.transform(ends, lambda e, i: F.slice(lines, F.coalesce(F.get("gone", i - 1), F.lit(-1)) + 2, F.greatest(e - F.coalesce(F.get("gone", i - 1), F.lit(-1)) - 1, F.lit(0)))))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    out = joined.withColumns({"_text": text, "_n": n})
    if drop_emptied:
        out = out.where(F.col("gone").isNull() | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    kept = [F.col("_text").alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed", "n_chunks")]
    return out.select(*kept, F.col("_n").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.coalesce("chunks", F.lit(0)).alias("n_chunks"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier place has; nulls, empty and long texts, ties, repeated rows and an empty table as in ``line_dedup``."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_chunks", "text")
