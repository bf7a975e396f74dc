"""Benchmark decontamination by greedy string tiling.

Words are compared without case, signs and spacing. Documents and items are
joined on shared seeds (windows of ``seed`` words); for each pair the longest
common stretches are marked one after another, never twice on either side, by
running Karp-Rabin, until none of ``seed`` words is left. What share of the
item's words is marked, in any order, is its coverage.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm.shared import table, written
from reliefspark.llm.textkit import U64, chained, hash_spans, ragged, slices, spans, words

#: Words end at white space and at ASCII signs.
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
#: Bytes of seeds and items that are sent to every worker at once; a larger benchmark is taken in blocks of this size.
BLOCK_BYTES = 32 << 20


def word_keys(texts: DataFrame, key: str) -> DataFrame:
    """(key, keys): the word hashes of each text as array<long>."""

    def run(batches):
        for batch, data, offsets in slices(batches):
            starts, ends, rows = words(data, offsets, SIGNS)
            lists = pa.ListArray.from_arrays(rows.astype(np.int32), hash_spans(data, starts, ends, lower=True).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], names=[key, "keys"])

    return texts.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, keys array<long>")


#: Prime and bases of the running hashes.
PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 1_812_433_253)


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the power of 0, 1, ..., modulo PRIME: ``n`` of them."""
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate([out, out * U64(pow(base, len(out), PRIME)) % U64(PRIME)])
    return out[:n]


class Rolling:
    """Karp-Rabin hashes of all windows of any length over one sequence of hashed words, by prefix sums.

    Two polynomials modulo a prime, over the two halves of each word's hash.
    """

    def __init__(self, keys: np.ndarray):
        self.parts = []
        for half, base in zip((keys & U64(0xFFFFFFFF), keys >> U64(32)), BASES, strict=True):
            sums = np.zeros(len(keys) + 1, U64)
            np.cumsum(half % U64(PRIME) * powers(pow(base, -1, PRIME), len(keys)) % U64(PRIME), out=sums[1:])
            self.parts.append((powers(base, len(keys) + 1), sums))

    def windows(self, length: int, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), U64)
        for up, sums in self.parts:
            out = out << U64(31) | (sums[at + length] - sums[at]) % U64(PRIME) * up[at + length] % U64(PRIME)
        return out


def unmarked(free: np.ndarray, length: int) -> np.ndarray:
    """Where windows of ``length`` begin that have no marked place."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[length:] == taken[:-length])


def tile(runs: list[np.ndarray], item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of ``item`` by ``runs``: (position in the item, position in the runs, length) of each tile.

    Longest matches first, of equal ones the first in the item, then in the
    runs. Tiles overlap on neither side and don't cross from one run to another.
    Positions in the runs count one place between each two.
    """
    bounds = [x for r in runs for x in (r, np.zeros(1, U64))]
    text = np.concatenate(bounds) if bounds else np.zeros(0, U64)
    free_t, free_i = np.ones(len(text), bool), np.ones(len(item), bool)
    free_t[np.cumsum([len(r) + 1 for r in runs], dtype=np.int64) - 1] = False
    roll_t, roll_i = Rolling(text), Rolling(item)

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at_t, at_i = unmarked(free_t, length), unmarked(free_i, length)
        found = roll_t.windows(length, at_t)
        hit = np.isin(found, roll_i.windows(length, at_i))
        return at_t[hit], found[hit], at_i

    tiles, most = [], min(len(text), len(item))
    while most >= least:
        # the longest match: where one of some length is, ones of all lesser lengths are
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < least:
            break
        at_t, found, at_i = common(low)
        by = defaultdict(list)
        for q, h in zip(at_t[::-1].tolist(), found[::-1].tolist(), strict=True):
            by[h].append(q)
        for p, h in zip(at_i.tolist(), roll_i.windows(low, at_i).tolist(), strict=True):
            spots = by.get(h, [])
            while spots and not free_t[spots[-1] : spots[-1] + low].all():
                spots.pop()
            if not free_i[p : p + low].all():
                continue
            for q in reversed(spots):
                if free_t[q : q + low].all() and np.array_equal(item[p : p + low], text[q : q + low]):
                    free_i[p : p + low] = free_t[q : q + low] = False
                    tiles.append((p, q, low))
                    break
        most = low - 1  # nothing of this length is left; where hashes clashed, there was nothing
    return tiles


def seeds_of(items: DataFrame, seed: int) -> DataFrame:
    """(item_id, n_words, h, pos): the seeds of each item; one of fewer words is a single shorter seed."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for item, keys in zip(batch.column("item_id").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                found = chained(np.array(keys, np.int64).view(U64), min(seed, len(keys)))
                for r, x in zip(rows, ([item] * len(found), [len(keys)] * len(found), found.view(np.int64).tolist(), range(len(found))), strict=True):
                    r.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["item_id", "n_words", "h", "pos"])

    return items.mapInArrow(run, "item_id long, n_words long, h long, pos long")


RUNS = "row long, doc_id long, text_key long, seeds array<long>, starts array<int>, keys array<long>"


def seeded_runs(docs: DataFrame, wanted: np.ndarray, lengths: list[int]) -> DataFrame:
    """Of each document that has some of the ``wanted`` seeds: those, and the stretches of words that they cover.

    All tiles lie within these stretches, so tiling needs nothing else of the document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(wanted))

    def run(batches):
        wanted, at = shared.value, TaskContext.get().partitionId() << 40
        for batch, data, offsets in slices(batches):
            starts, ends, rows = words(data, offsets, SIGNS)
            keys = hash_spans(data, starts, ends, lower=True)
            covered, hits = np.zeros(len(keys) + 1, np.int64), []
            for n in lengths:
                found = chained(keys, n)
                place = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                hit = np.flatnonzero(wanted[place] == found)
                row = np.searchsorted(rows, hit, "right") - 1
                inside = hit + n <= rows[row + 1]
                hit, row = hit[inside], row[inside]
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + n, -1)
                hits.append((row, found[hit]))
            # neighbouring stretches of two documents are told apart by the documents' bounds
            begins, closes, per = spans(np.cumsum(covered[:-1]) > 0, rows)
            row, h = (np.concatenate(x) for x in zip(*hits, strict=True))
            out: list[list] = [[], [], [], [], [], []]
            ids, marks = batch.column("doc_id"), batch.column("text_key")
            for r in np.unique(row).tolist():
                lo, hi = per[r], per[r + 1]
                spots, _ = ragged(begins[lo:hi], (closes - begins)[lo:hi])
                values = (at + r, ids[r].as_py(), marks[r].as_py(), np.unique(h[row == r]).view(np.int64), np.cumsum(np.append(0, (closes - begins)[lo:hi]))[:-1].astype(np.int32), keys[spots].view(np.int64))
                for o, v in zip(out, values, strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["row", "doc_id", "text_key", "seeds", "starts", "keys"])
            at += len(batch)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, RUNS)


TILED = "doc_id long, text_key long, item_id long, n_words long, n_tiles int, n_matched int, coverage double"


def contaminated(docs: DataFrame, benchmark: DataFrame, *, seed: int = 5, coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and a benchmark item of which it has at least ``coverage`` of the words, in tiles of ``seed`` words or more.

    An item of fewer words than ``seed`` is one tile of all its words. Items
    without words or without an id match nothing; null text is empty and holds
    nothing; a null doc_id stays null; rows that repeat a doc_id or an item_id
    are taken each, equal rows too. ``text_key`` (xxhash64 of the text) tells such
    documents apart. Texts of any length are searched whole. Of equally long
    matches the first in the item is marked, there the first in the document; a
    coverage just at the limit counts. Without documents or items there are no
    pairs. Other columns, whatever their names, are left out.

    Seeds of the benchmark are sent to all workers in blocks of at most
    ``block_bytes``, and the documents are read once for each block. Only hits
    are shuffled, by document; an item that very many documents hold makes one
    pair for each of them.
    """
    spark = docs.sparkSession
    items = written(word_keys(benchmark.where("item_id is not null"), "item_id").where(F.size("keys") > 0).withColumn("row_i", F.monotonically_increasing_id()), "items")
    total = items.agg(F.coalesce(F.sum(16 * F.size("keys")), F.lit(0))).first()[0]
    blocks, out = max(1, -(-total // (block_bytes // 2))), []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("row_i"), F.lit(blocks)) == block)
        seeds = written(seeds_of(own.select(F.col("row_i").alias("item_id"), "keys"), seed), "seeds")
        wanted = np.unique(seeds.select("h").distinct().toArrow().column("h").to_numpy().view(U64))
        if not len(wanted):
            continue
        lengths = sorted(r[0] for r in seeds.select(F.least("n_words", F.lit(seed))).distinct().collect())
        runs = written(seeded_runs(docs, wanted, lengths), "runs")
        hits = runs.select("row", F.explode("seeds").alias("h")).join(seeds, "h").groupBy("row", "item_id", "n_words").agg(F.count(F.lit(1)).alias("n"))
        # seeds cover at most ``seed`` words each, so what falls short here can't reach the coverage
        pairs = hits.where(F.col("n") * seed >= coverage * F.col("n_words")).select("row", F.col("item_id").alias("row_i"), "n_words")
        names = own.select("row_i", "item_id", F.col("keys").alias("item"))
        both = pairs.join(names, "row_i").join(runs.select("row", "doc_id", "text_key", "starts", "keys"), "row")
        out.append(both.select("doc_id", "text_key", "item_id", "n_words", "item", "starts", "keys").mapInArrow(tiling(seed), TILED).where(F.col("coverage") >= coverage))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], TILED)


def tiling(seed: int):
    def run(batches):
        for batch in batches:
            n_tiles, n_matched = [], []
            for item, starts, keys in zip(*(batch.column(c) for c in ("item", "starts", "keys")), strict=True):
                item, keys = (np.asarray(x.values).view(U64) for x in (item, keys))
                tiles = tile(np.split(keys, np.asarray(starts.values)[1:]), item, min(seed, len(item)))
                n_tiles.append(len(tiles))
                n_matched.append(sum(n for _, _, n in tiles))
            share = np.array(n_matched) / batch.column("n_words").to_numpy() if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "item_id", "n_words")), pa.array(n_tiles, pa.int32()), pa.array(n_matched, pa.int32()), pa.array(share, pa.float64())], names=["doc_id", "text_key", "item_id", "n_words", "n_tiles", "n_matched", "coverage"])

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay, names of any kind but _i and _k; nulls, empty and long texts, ties, repeated rows and empty tables as in ``contaminated``."""
    found = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("_i"), F.col("text_key").alias("_k")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("_i")) & (F.xxhash64(docs["text"]) == F.col("_k")), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, a row for each pair; nulls, empty and long texts, ties, repeated rows and empty tables as in ``contaminated``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
