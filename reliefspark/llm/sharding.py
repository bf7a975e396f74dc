"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

Documents with equal texts are linked. As such documents are alike, labels are
kept for blocks: how many documents of a group are in a shard. In each round the
blocks are joined with their group's votes, the shards where most neighbours
are (as many shards as the group needs, one but for groups above a quota), and
propose to move there; proposals are accepted as far as the shard has room, and
beyond that against as many documents that move the other way. Rounds end when
three in a row have not helped; the one that cut fewest links counts. Documents without links fill what is left, so the shards' counts differ
by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefspark.llm.shared import forget, table, written


def buckets(size: Column) -> Column:
    """Into how many buckets ``size`` rows are dealt for numbering: the bucket grows with the square root, as does their number."""
    return F.when(size < 1000, F.lit(1)).otherwise(F.ceil(4 * F.sqrt(size))).cast("long")


def running(rows: DataFrame, keys: list[str], size: Column, order: list[str], value: Column, out: str, rank: Column | None = None) -> DataFrame:
    """Sum of ``value`` over the rows before, for each of the ``keys``, in two steps: within hashed buckets, then over the sums of the buckets before.

    ``size``: about how many rows the row's key has. No key, however frequent, is sorted by one task.
    Rows of a smaller ``rank`` (a small whole number) come before others.
    """
    bucket = F.pmod(F.xxhash64(*order), buckets(size))
    bucket = bucket if rank is None else F.shiftleft(rank.cast("long"), 40) + bucket
    parted = rows.withColumns({"_b": bucket, "_v": value.cast("long")})
    by = [*keys, "_b"]
    sums = parted.groupBy(*by).agg(F.sum("_v").alias("_s"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select(*by, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parted.join(firsts, by).withColumn(out, F.col("_first") + F.coalesce(F.sum("_v").over(within), F.lit(0))).drop("_b", "_v", "_first")


def lookup(values: list, at: Column) -> Column:
    """``values[at]`` of a short list of numbers."""
    return F.get(F.array(*map(F.lit, values)) if len(values) <= 64 else F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), at.cast("int"))


def cut_links(blocks: DataFrame) -> int:
    """How many pairs of linked documents are in different shards."""
    sums = blocks.groupBy("g").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("together"))
    return int(sums.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("together")).cast("decimal(38,0)") / 2), F.lit(0))).first()[0])


def dealt(groups: DataFrame, shards: int) -> DataFrame:
    """(g, shard, n): the documents of ``groups`` (g, n) one after another to the shards in turn."""
    spread = running(groups, [], F.lit(groups.count()), ["g"], F.col("n"), "start")
    parts = F.transform(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(shards)) - 1), lambda i: F.struct(F.pmod(F.col("start") + i, F.lit(shards)).cast("int").alias("shard"), (F.floor((F.col("n") - i - 1) / shards) + 1).alias("n")))
    return spread.select("g", F.explode(parts).alias("p")).select("g", "p.*")


def propagated(groups: DataFrame, quotas: list[int], rounds: int) -> tuple[DataFrame, list[int], list[int]]:
    """(blocks g, shard, n; linked documents of each shard; cut links before the first round and after each) of at most ``rounds`` rounds.

    ``groups`` (g, n) are dealt out over all shards at first. Small blocks are
    accepted first. After a round that has not helped, equal votes are counted in
    another order, and every other time the blocks' sizes don't count, so that
    blocks find others to change places with. Only numbers for each shard, or
    pair of shards, reach the driver.
    """
    shards = len(quotas)
    blocks = written(dealt(groups, shards), "blocks")
    cuts = [cut_links(blocks)]
    best, idle, turn = blocks, 0, 0
    for _ in range(rounds):
        held = dict(blocks.groupBy("shard").agg(F.sum("n")).collect())
        room = [q - held.get(s, 0) for s, q in enumerate(quotas)]
        # a group's votes: shards with room first, then those with most of its documents; one block for each shard, so they are few
        most = F.col("n") if turn % 2 == 0 else F.lit(0)
        vote = F.struct((lookup(room, F.col("shard")) > 0).alias("room"), most.alias("most"), F.xxhash64("g", "shard", F.lit(turn)).alias("turn"), "shard")
        wanted = F.ceil(F.sum("n") / min(quotas)).cast("int") if min(quotas) else F.lit(shards)
        votes = blocks.groupBy("g").agg(F.sort_array(F.collect_list(vote), asc=False).alias("votes"), wanted.alias("wanted"))
        votes = votes.where(F.size("votes") > F.col("wanted")).select("g", F.slice("votes.shard", F.lit(1), "wanted").alias("best"))
        asking = blocks.join(votes, "g").where(~F.array_contains("best", F.col("shard")))
        moves = asking.select("g", "shard", "n", F.get("best", F.pmod(F.xxhash64("g", "shard", F.lit(turn)), F.size("best")).cast("int")).alias("to"))
        moves = written(moves, "moves")
        asked = {(r.shard, r.to): (r.n, r.k) for r in moves.groupBy("shard", "to").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
        accepted, sizes = [0] * shards**2, [0] * shards**2
        for (i, j), (n, k) in sorted(asked.items()):
            swapped = min(n, asked.get((j, i), (0, 0))[0])
            extra = min(n - swapped, room[j])
            room[j] -= extra
            accepted[i * shards + j], sizes[i * shards + j] = swapped + extra, k
        if not any(accepted):
            if (idle := idle + 1) == 3:
                break
            turn += 1
            continue
        pair = F.col("shard") * shards + F.col("to")
        first = running(moves, ["shard", "to"], lookup(sizes, pair), ["g"], F.col("n"), "before", rank=F.floor(F.log2("n")))
        taken = first.select("g", "shard", "to", F.greatest(F.lit(0), F.least(F.col("n"), lookup(accepted, pair) - F.col("before"))).alias("k")).where("k > 0")
        changes = taken.select("g", "shard", (-F.col("k")).alias("n")).union(taken.select("g", F.col("to").alias("shard"), F.col("k").alias("n")))
        before = blocks
        blocks = written(blocks.select("g", "shard", "n").union(changes).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "blocks")
        cuts.append(cut_links(blocks))
        forget(moves)
        if before is not best:
            forget(before)
        if cuts[-1] < min(cuts[:-1]):
            forget(best)
            best, idle = blocks, 0
        elif (idle := idle + 1) == 3:
            break
        else:
            turn += 1
    held = dict(best.groupBy("shard").agg(F.sum("n")).collect())
    return best, [held.get(s, 0) for s in range(shards)], cuts


def balanced_shards(docs: DataFrame, shards: int = 40, rounds: int = 12) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), linked and n_cut of each row of ``docs`` (doc_id, text).

    ``size`` is the text's bytes in UTF-8 plus 16; null text counts as empty and
    is linked with empty texts. Counts of shards differ by one at most; slots of
    a shard run from 0 without gaps, linked documents of a group together.
    ``n_cut``: how many documents of equal text are in other shards.

    Rows that repeat a doc_id, or have none, are documents of their own. Shards
    with equally many of a group's documents are told apart by a hash of group
    and shard, documents of a group by their ids. Texts of any length are
    compared by 128 bits of their SHA-256. No rows give no rows. Extra columns,
    whatever their names, are left out.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("g"))
    rows = written(rows, "rows")
    groups = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    blocks, held, _ = propagated(groups, quotas, rounds)

    # where each block's documents begin: within the group, and within the shard
    placed = running(blocks, ["shard"], F.lit(blocks.count() // shards), ["g"], F.col("n"), "slot0")
    # a group has a block for each shard at most
    lists = placed.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("shard", "slot0", "n"))).alias("blocks"), F.sum("n").alias("_n"))
    los = F.transform("blocks", lambda x, i: F.aggregate(F.slice("blocks", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["n"]))
    lists = lists.select("g", "_n", F.zip_with("blocks", los, lambda x, lo: F.struct(x["shard"].alias("shard"), x["slot0"].alias("slot0"), x["n"].alias("n"), lo.alias("lo"))).alias("blocks"))

    marked = rows.join(groups.select("g", "n"), "g", "left")
    one = F.lit(1)
    linked = running(marked.where("n is not null"), ["g"], F.col("n"), ["doc_id"], one, "r").join(lists, "g")
    linked = linked.withColumn("at", F.element_at(F.filter("blocks", lambda x: x["lo"] <= F.col("r")), -1))
    linked = linked.select("doc_id", "size", "text_crc32", F.col("at.shard").alias("shard"), (F.col("at.slot0") + F.col("r") - F.col("at.lo")).alias("slot"), F.lit(True).alias("linked"), (F.col("_n") - F.col("at.n")).alias("n_cut"))

    alone = running(marked.where("n is null"), [], F.lit(total), ["doc_id", "g"], one, "r")
    bounds = [sum(q - h for q, h in zip(quotas[:s], held, strict=False)) for s in range(shards)]
    starts = F.array(*(F.lit(b).cast("long") for b in bounds))
    # the last shard that begins at or before the number; ones without room begin with the next
    shard = F.size(F.filter(starts, lambda b: b <= F.col("r"))) - 1
    alone = alone.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "shard", (lookup(held, F.col("shard")) + F.col("r") - F.get(starts, F.col("shard"))).alias("slot"), F.lit(False).alias("linked"), F.lit(0).cast("long").alias("n_cut"))
    both = linked.union(alone)
    return both.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked", "n_cut")


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal counts; nulls, empty and long texts, ties, repeated rows and an empty table as in ``balanced_shards``."""
    return balanced_shards(table(spark, sf_dir, "documents"))


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of op4's shards, and their slots: first, last and how many different ones."""
    found = op4_shards(spark, sf_dir)
    return found.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("n_slots"))
