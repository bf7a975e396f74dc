"""Near-duplicates by HyperMinHash.

Each distinct shingle of a document is hashed to a bucket; a bucket keeps the
smallest hash as a 16-bit register: the count of its leading zeros and the
mantissa bits that follow. Bands of registers find candidates; their registers
estimate the similarity, corrected for registers that are equal by chance; what
passes with a margin is verified on the full sets.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm.graph import components
from reliefspark.llm.shared import partitions, table, written
from reliefspark.llm.textkit import U64, chained, hash_spans, mix, slices, words

#: 40 bands of 4 registers: two sets of similarity 0.8 miss all bands with a probability of (1 - 0.8^4)^40 < 1e-9.
BANDS, ROWS = 40, 4
BUCKETS = BANDS * ROWS
MANTISSA = 10


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one, of all its words."""
    starts, ends, rows = words(data, offsets)
    keys = hash_spans(data, starts, ends, lower=True)
    chain = chained(keys, size)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(chain[a : b - size + 1]))
        elif b > a:
            out.append(chained(keys[a:b], b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def bucket_edges() -> np.ndarray:
    return np.array([(i << 64) // BUCKETS + ((i << 64) % BUCKETS > 0) for i in range(BUCKETS)], U64)


#: By bucket: where the hash range of each begins, and in which order an empty bucket asks others for their register.
EDGES = bucket_edges()
ASKS = np.stack([mix(np.arange(BUCKETS, dtype=U64) * U64(1 << 20) + U64(t + 1)) % U64(BUCKETS) for t in range(512)]).astype(np.int64)


def registers(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit registers, which of them were filled by the set itself), a row for each set; an empty set has none filled."""
    least, filled = np.zeros((len(sets), BUCKETS), U64), np.zeros((len(sets), BUCKETS), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, EDGES)
            ends = np.append(at[1:], len(s))
            filled[i] = at < ends
            least[i] = s[np.minimum(at, len(s) - 1)]
    # the place in the bucket's range is uniform in [0, 1): leading zeros, then mantissa bits
    place = ((least - EDGES) * U64(BUCKETS)).astype(np.float64)
    fraction, exponent = np.frexp(place)
    zeros = np.clip(64 - exponent, 0, 63)
    mantissa = np.minimum(((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1)
    return np.where(filled, (zeros << MANTISSA) | np.maximum(mantissa, 0), 0).astype(np.uint16), filled


def densified(regs: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fills empty buckets with the register of the first filled bucket that they ask."""
    out, open_ = regs.copy(), ~filled & filled.any(1)[:, None]
    rows, cols = np.nonzero(open_)
    for asks in ASKS:
        if not len(rows):
            return out
        source = asks[cols]
        have = filled[rows, source]
        out[rows[have], cols[have]] = regs[rows[have], source[have]]
        rows, cols = rows[~have], cols[~have]
    for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
        source = np.flatnonzero(filled[r])
        out[r, c] = regs[r, source[c % len(source)]]
    return out


def band_keys(dense: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    packed = np.ascontiguousarray(dense).view(U64).reshape(len(dense), BANDS)
    return mix(packed ^ mix(np.arange(1, BANDS + 1, dtype=U64)))


def chance(n_a: float, n_b: float) -> float:
    """Probability that a bucket's registers are equal for two unrelated sets of these sizes."""
    x, y = max(n_a, 1) / BUCKETS, max(n_b, 1) / BUCKETS
    z = np.arange(64)
    width = 2.0 ** -(z + 1)
    within = np.exp(-(x + y) * width) - np.exp(-(x + y) * 2 * width)
    return float((width / (1 << MANTISSA) * x * y / (x + y) * within).sum())


def estimates(regs: np.ndarray, filled: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the row pairs (a, b): equal registers among the buckets that either fills, less the expected chance ones."""
    both, either = filled[a] & filled[b], filled[a] | filled[b]
    equal = (both & (regs[a] == regs[b])).sum(1)
    sizes = np.unique(np.stack([n[a], n[b]]), axis=1) if len(a) else np.zeros((2, 0))
    by = {tuple(s): chance(*s) for s in sizes.T.tolist()}
    noise = np.array([by[s] for s in zip(n[a].tolist(), n[b].tolist(), strict=True)])
    used = np.maximum(either.sum(1), 1)
    return np.maximum(0, equal / used - noise) / (1 - noise) if len(a) else np.zeros(0)


SIGNATURE = "doc_id long, n_shingles long, set_key string, bands array<long>, regs binary, filled binary"


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, set size, a 128-bit key of the set, band keys and registers of each document; no bands for an empty one."""

    def run(batches):
        for batch, data, offsets in slices(batches):
            sets = shingle_sets(data, offsets, size)
            regs, filled = registers(sets)
            bands = band_keys(densified(regs, filled))
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            bits = np.packbits(filled, axis=1)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32), bands[n > 0].reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(keys, pa.string()), lists, pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([b.tobytes() for b in bits], pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands", "regs", "filled"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNATURE)


def stored_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, set) with the shingle hashes as array<long>."""

    def run(batches):
        for batch, data, offsets in slices(batches):
            sets = shingle_sets(data, offsets, size)
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those (a, b) whose full sets have den * intersection >= num * union."""
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa").cast("long") + F.size("sb").cast("long") - shared
    return both.where(den * shared >= num * union).select("a", "b")


def promising(pairs: DataFrame, sketches: DataFrame, floor: float, num: int, den: int) -> DataFrame:
    """Those (a, b) whose sizes allow the similarity and whose registers estimate at least ``floor``."""

    def run(batches):
        for batch in batches:
            regs = np.stack([np.frombuffer(x, np.uint16) for c in ("ra", "rb") for x in batch.column(c).to_pylist()]) if len(batch) else np.zeros((0, BUCKETS), np.uint16)
            filled = np.stack([np.unpackbits(np.frombuffer(x, np.uint8)) for c in ("fa", "fb") for x in batch.column(c).to_pylist()]).astype(bool) if len(batch) else np.zeros((0, BUCKETS), bool)
            n = np.concatenate([batch.column("na").to_numpy(), batch.column("nb").to_numpy()])
            a = np.arange(len(batch))
            yield batch.select(["a", "b"]).filter(pa.array(estimates(regs, filled, n, a, a + len(batch)) >= floor))

    side = lambda x: sketches.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"), F.col("filled").alias(f"f{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    return joined.select("a", "b", "na", "nb", "ra", "rb", "fa", "fb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, size: int = 5, num: int = 80, den: int = 100, star_rounds: int = 3, margin: float = 0.16) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text).

    Documents with equal sets are one class, named by its smallest doc_id. Where
    classes share a band, each is first compared with one class of its bands
    that is in another component (with another one in each of ``star_rounds``),
    which joins large groups at a cost in proportion to their size. Then what
    shares a band but no component yet is compared in blocks: every such member
    with all members of a large component, and the pairs of small ones. So no
    link between different texts is lost but to the bands' miss rate. The estimate's ``margin`` is five standard errors for sets that fill
    the buckets; smaller sets leave few elements out of their registers, so
    their estimates are closer.

    Null or empty texts are linked with nothing. Texts of any length are taken
    whole: a set is held by one task at a time, with those of its block. Two
    sets just at the limit are linked. Rows without a doc_id are kept, have no
    component and no links; rows that repeat a doc_id belong to the component of
    that id. No rows give none. Extra columns, whatever their names, are left
    out.
    """
    rows = written(signatures(docs, size), "signatures")
    full = rows.where("doc_id is not null and set_key is not null")
    keyed = full.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("_copies"))
    named = full.withColumnRenamed("doc_id", "id").join(keyed.select("set_key", "id"), ["set_key", "id"])
    heads = written(named.dropDuplicates(["id", "set_key"]), "classes")
    sketches = heads.select("id", "n_shingles", "regs", "filled")

    banded = heads.select("id", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("band")
    members = written(banded.join(crowded, "band"), "bands")
    wanted = members.select("id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id")
    sets = written(stored_sets(texts, size).dropDuplicates(["id", "set"]), "sets")

    links, labels = [], members.select("id").distinct().withColumn("component", F.col("id"))
    for turn in range(star_rounds):
        placed = members.join(labels, "id") if turn else members.withColumn("component", F.col("id"))
        order = lambda c: F.xxhash64(c, F.lit(turn))
        centre = placed.groupBy("band").agg(F.min_by(F.struct("id", "component"), order("id")).alias("c"))
        apart = placed.join(centre, "band").where("component <> c.component")
        nearest = apart.groupBy("id").agg(F.min_by("c.id", order("c.id")).alias("to"))
        pairs = nearest.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()
        found = written(verified(promising(pairs, sketches, floor_of(num, den, margin), num, den), sets, num, den), "links")
        links.append(found)
        labels = written(hooked(labels, found), "labels")
    floor = floor_of(num, den, margin)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    placed = written(members.join(labels.join(sizes, "component"), "id"), "placed")
    links.append(written(visiting_links(placed, labels, sketches.join(sets, "id"), floor, num, den), "links"))
    small = placed.where(F.col("members") < LARGE).drop("members")
    edges = weak_edges(small, heads.select("id", "n_shingles", "regs", "filled"), floor, num, den)
    weak = components(edges).select(F.col("id").alias("component"), F.col("component").alias("host"))
    links.append(written(cluster_links(labels.join(weak, "component"), sketches.join(sets, "id"), floor, num, den), "links"))
    final = components(reduce(DataFrame.union, links))
    classes = keyed.join(final, "id", "left").select("set_key", F.coalesce("component", "id").alias("_c"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def floor_of(num: int, den: int, margin: float) -> float:
    return num / den - margin


def hooked(labels: DataFrame, links: DataFrame, steps: int = 2) -> DataFrame:
    """``labels`` (id, component) after ``links``: a component takes the smallest one that a link leads to, and where that led in turn.

    Only components that links join become one, but not all of those at once:
    chains longer than 2 ** ``steps`` stay apart here. ``components`` is exact.
    """
    side = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    apart = links.join(side("a"), "a").join(side("b"), "b").where("ca <> cb")
    moves = apart.groupBy(F.greatest("ca", "cb").alias("component")).agg(F.min(F.least("ca", "cb")).alias("to"))
    for _ in range(steps):
        beyond = moves.select(F.col("component").alias("to"), F.col("to").alias("beyond"))
        moves = moves.join(beyond, "to", "left").select("component", F.coalesce("beyond", "to").alias("to"))
    return labels.join(moves, "component", "left").select("id", F.coalesce("to", "component").alias("component"))


#: Members from which a component is large.
LARGE = 32


def visiting_links(placed: DataFrame, labels: DataFrame, full: DataFrame, floor: float, num: int, den: int, block: int = 1024) -> DataFrame:
    """Links (a, b) between members of large components and what shares a band with one of these.

    ``placed``: band, id, component, members; ``full``: id, n_shingles, regs,
    filled, set. A large component is dealt into blocks, and each visitor goes to
    every block.
    """
    large = placed.where(F.col("members") >= LARGE).groupBy("band", "component").agg(F.first("members").alias("m")).select("band", F.col("component").alias("host"), "m")
    # of two large components the smaller one's members visit
    smaller = (F.col("members") < F.col("m")) | ((F.col("members") == F.col("m")) & (F.col("component") < F.col("host")))
    visits = placed.join(large, "band").where((F.col("component") != F.col("host")) & smaller).select("id", "component", "host", "m").distinct()
    visits = written(visits, "visits")
    hosts = visits.select("host", F.ceil(F.col("m") / block).cast("int").alias("blocks")).distinct()
    at_home = labels.join(hosts.withColumnRenamed("host", "component"), "component").select("id", "component", F.col("component").alias("host"), "blocks")
    guests = visits.join(hosts, "host").select("id", "component", "host", "blocks")
    return block_links(at_home, guests, full, floor, num, den)


def cluster_links(members: DataFrame, full: DataFrame, floor: float, num: int, den: int, block: int = 1 << 19) -> DataFrame:
    """Links between different components of each cluster: ``members`` has id, component and host (the cluster).

    A cluster is dealt into blocks of about ``block`` shingles, and all its members visit each.
    """
    sizes = members.join(full.select("id", "n_shingles"), "id").groupBy("host").agg(F.ceil(F.sum("n_shingles") / block).cast("int").alias("blocks"))
    rows = members.join(sizes, "host").select("id", "component", "host", "blocks")
    return block_links(rows, rows, full, floor, num, den, twice=True)


def block_links(at_home: DataFrame, guests: DataFrame, full: DataFrame, floor: float, num: int, den: int, twice: bool = False) -> DataFrame:
    """Links (a, b) of guests with what is at home in the blocks of their host, in another component than theirs.

    Both have id, component, host and blocks (how many the host has). Pairs are
    compared by the estimate and then on the full sets, unless links of the same
    block have joined their components already; so a block puts out fewer links
    than it has components. A task holds one block, guests pass by.
    """
    at_home = at_home.select("id", "component", "host", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("visitor"))
    guests = guests.select("id", "component", "host", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visitor"))
    rows = at_home.union(guests).join(full, "id").repartition(partitions(full.sparkSession), "host", "block").sortWithinPartitions("host", "block", "visitor")

    def sketch(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(len(batch), BUCKETS)
        filled = np.unpackbits(np.frombuffer(b"".join(batch.column("filled").to_pylist()), np.uint8).reshape(len(batch), -1), axis=1).astype(bool)
        sets = batch.column("set")
        lo = sets.offsets.to_numpy()
        return batch.column("id").to_numpy(), batch.column("component").to_numpy(), batch.column("n_shingles").to_numpy(), regs, filled, [sets.values.to_numpy()[a:b] for a, b in zip(lo[:-1], lo[1:], strict=True)]

    def run(batches):
        home, key, parts = None, None, []
        root: dict[int, int] = {}  # which components the links of the block have joined

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("host", "block")])
            guest = batch.column("visitor").to_numpy(zero_copy_only=False)
            change = (keys[:, 1:] != keys[:, :-1]).any(0) | (guest[1:] != guest[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
            out: list[list[int]] = [[], []]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if tuple(keys[:, lo].tolist()) != key:
                    home, key, parts = None, tuple(keys[:, lo].tolist()), []
                    root.clear()
                if not guest[lo]:
                    parts.append(sketch(part))
                    continue
                if home is None and parts:
                    home = (*(np.concatenate(x) for x in list(zip(*parts, strict=True))[:5]), [s for p in parts for s in p[5]])
                    parts = []
                if home is None:
                    continue
                ids, comp, n, regs, filled, sets = home
                for a, ca, na, ra, fa, sa in zip(*sketch(part), strict=True):
                    y = np.flatnonzero((comp != ca) & (den * np.minimum(n, na) >= num * np.maximum(n, na)))
                    if len(y):
                        guess = estimates(np.concatenate([regs[y], ra[None]]), np.concatenate([filled[y], fa[None]]), np.append(n[y], na), np.arange(len(y)), np.full(len(y), len(y)))
                        for k in y[np.argsort(-guess, kind="stable")][: int((guess >= floor).sum())].tolist():
                            # each pair of a cluster meets twice; the smaller component's member looks at it
                            if (twice and comp[k] < ca) or (mine := top(int(ca))) == (other := top(int(comp[k]))):
                                continue
                            shared = len(np.intersect1d(sa, sets[k], assume_unique=True))
                            if den * shared >= num * (len(sa) + len(sets[k]) - shared):
                                out[0].append(min(int(a), int(ids[k])))
                                out[1].append(max(int(a), int(ids[k])))
                                root[mine] = other
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return rows.select("host", "block", "visitor", "id", "component", "n_shingles", "regs", "filled", "set").mapInArrow(run, "a long, b long")


def weak_edges(placed: DataFrame, sketches: DataFrame, floor: float, num: int, den: int, block: int = 2048) -> DataFrame:
    """Edges (a, b) between components that have promising pairs in some band: of each group that is compared, a spanning forest.

    Bands whose members are in one component are done. Of the others, members
    are dealt into blocks of about ``block``, and each pair of blocks is compared
    in one group: the registers of two blocks are all that a task holds, and it
    puts out fewer edges than it has members.
    """
    open_ = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("band", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    dealt = placed.join(open_, "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = both.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component", "id").join(sketches, "id")
    rows = rows.repartition(partitions(rows.sparkSession), "band", "i", "j").sortWithinPartitions("band", "i", "j")

    def compare(rows: list[pa.RecordBatch], diagonal: bool) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        ids, comp, own, n = (t.column(c).to_numpy() for c in ("id", "component", "own", "n_shingles"))
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(len(ids), BUCKETS)
        filled = np.unpackbits(np.frombuffer(b"".join(t.column("filled").to_pylist()), np.uint8).reshape(len(ids), -1), axis=1).astype(bool)
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        out_a, out_b = [], []
        for x in range(len(ids)):
            y = np.flatnonzero((comp != comp[x]) & (ids > ids[x]) & ((own != own[x]) if not diagonal else True) & (den * np.minimum(n, n[x]) >= num * np.maximum(n, n[x])))
            if len(y):
                y = y[estimates(regs, filled, n, np.full(len(y), x), y) >= floor]
                for c in np.unique(comp[y]).tolist():
                    a, b = top(int(comp[x])), top(c)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out_a.append(a)
                        out_b.append(b)
        return pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    def run(batches):
        held, at = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, lo].tolist()) if hi > lo else at
                if key != at and held:
                    yield compare(held, at[1] == at[2])
                    held = []
                at = key
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield compare(held, at[1] == at[2])

    return rows.mapInArrow(run, "a long, b long").distinct()


def without_copies(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each component, the one of the smallest doc_id; all columns but ``_gone`` stay.

    Rows that repeat a doc_id count as one document; rows without one, and null,
    empty and long texts, ties and empty tables as in ``near_duplicates``.
    """
    gone = near_duplicates(docs, **how).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on shingles of two words, similarity 0.8; nulls, empty and long texts, ties, repeated rows and an empty table as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, star_rounds=4)
