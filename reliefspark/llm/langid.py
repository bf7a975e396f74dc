"""Language identification by interpolated Kneser-Ney character models.

Letters are folded to lower case, everything between them to one space. Grams of
four symbols are counted over all training texts, and Spark makes of the counts
all probabilities and back-off weights of each language. These go to files of
hashes in order with a value each, dealt by the hashes' leading bits; workers
map the files, look up what a text has, and remember it. A gram that a language
lacks backs off to the next order. Nothing of the model is bounded but a file's
size, and of the model only the names of the files pass the driver.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from reliefspark.llm.shared import fresh_dir, local_or_remote, mapped_file, table, written
from reliefspark.llm.textkit import U64, grouped, mix, ragged, slices

ORDER, SPACE = 4, 32
#: Letters beyond the basic plane are folded into the private area.
FOLDED, FOLD = 0xE000, 0x1000


@lru_cache
def letters() -> np.ndarray:
    """By code point below 0x10000: the letter in lower case, or SPACE."""
    out = np.full(1 << 16, SPACE, np.uint16)
    for c in range(1 << 16):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()[0]
            out[c] = ord(low) if ord(low) < 1 << 16 else c
    return out


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their offsets by text, whether each text has a letter): runs of what isn't a letter are one space."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    bounds = sums[offsets]
    out = letters()[np.minimum(points, 0xFFFF)]
    wide = np.flatnonzero(points > 0xFFFF)
    for i, c in zip(wide.tolist(), points[wide].tolist(), strict=True):
        out[i] = FOLDED + c % FOLD if unicodedata.category(chr(c))[0] == "L" else SPACE
    letter = out != SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of spaces, but not at a text's start
    begins = bounds[:-1][bounds[1:] > bounds[:-1]]
    keep[begins] = letter[begins]
    counts = np.zeros(len(out) + 1, np.int64)
    np.cumsum(letter, out=counts[1:])
    has = counts[bounds[1:]] > counts[bounds[:-1]]
    np.cumsum(keep, out=counts[1:])
    return out[keep], counts[bounds], has


def grams(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed grams of four symbols, their offsets by text): one for each symbol and one for a closing space, after three spaces in front."""
    lengths = np.diff(bounds)
    padded = bounds - bounds[0]
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out = np.full(len(text) + ORDER * len(lengths), SPACE, np.uint64)
    out[np.arange(len(text)) + ORDER * rows + ORDER - 1] = text
    packed = (out[:-3] << U64(48)) | (out[1:-2] << U64(32)) | (out[2:-1] << U64(16)) | out[3:] if len(out) > 3 else np.zeros(0, U64)
    # of each padded text of n + 4 symbols the first n + 1 windows are its own
    begins = padded[:-1] + ORDER * np.arange(len(lengths))
    own, offsets = ragged(begins, lengths + 1)
    return packed[own], offsets


def training(column: str = "doc_id") -> Column:
    """Whether a row may be learnt from, by the crc32 of its id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(3)) != 1, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull()


def gram_counts(docs: DataFrame, flush: int = 1_000_000) -> DataFrame:
    """(lang, gram, n) over all texts; each task sums up its own first, in bounded memory."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}

        def out():
            for lang, (keys, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch, data, offsets in slices(batches):
            text, bounds, has = folded(data, offsets)
            packed, own = grams(text, bounds)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                rows = np.flatnonzero((langs == lang) & has)
                at, _ = ragged(own[rows], own[rows + 1] - own[rows])
                keys, _, number = grouped(packed[at])
                n = np.bincount(number, minlength=len(keys))
                if lang in held:
                    both, _, number = grouped(np.concatenate([held[lang][0], keys]))
                    keys, n = both, np.bincount(number, weights=np.concatenate([held[lang][1], n]), minlength=len(both)).astype(np.int64)
                held[lang] = [keys, n]
            if sum(len(k) for k, _ in held.values()) > flush:
                yield from out()
        yield from out()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def low(keys, order: int):
    """The last ``order`` symbols of packed grams (an array or a Column)."""
    most = (1 << (16 * order)) - 1
    return keys & U64(most) if isinstance(keys, np.ndarray) else keys.bitwiseAND(F.lit(most).cast("long"))


#: What is kept of each language and order: log probabilities of grams, log weights of contexts.
PROBABILITY, WEIGHT = 0, 1
#: Entries of a file of the model, about.
SEGMENT = 1 << 20


def entry_hash(grams: np.ndarray, lang: np.ndarray, order: int | np.ndarray, what: int | np.ndarray) -> np.ndarray:
    """Hash, in signed order, under which a gram's value stands."""
    return mix(grams ^ mix(np.asarray((lang * 8 + order) * 2 + what, U64))).view(np.int64)


def smoothed(counts: DataFrame) -> tuple[DataFrame, int]:
    """((lang, ord, gram, what, value) of all orders, number of symbols) from the counts (lang, gram, n) of the longest grams.

    Orders below count the distinct symbols before a gram. A language's discount
    in each order comes from its grams counted once and twice.
    """
    levels = [counts.select("lang", "gram", F.col("n").cast("double").alias("n"))]
    for order in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].groupBy("lang", low(F.col("gram"), order).alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("n")))
    levels = [written(x, f"grams{ORDER - i}") for i, x in enumerate(levels)]
    n_symbols = levels[-1].select("gram").distinct().count()
    out, lower = [], None
    for order, level in enumerate(reversed(levels), start=1):
        kinds = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
        d = F.when((F.col("ones") > 0) & (F.col("twos") > 0), F.col("ones") / (F.col("ones") + 2 * F.col("twos"))).otherwise(0.5)
        above = level.withColumn("context", F.shiftrightunsigned("gram", 16))
        sums = above.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        # one row for each language
        sums = sums.join(kinds.select("lang", d.alias("d")), "lang").select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("gamma"))
        both = above.join(sums, ["lang", "context"])
        if lower is None:
            both = both.withColumn("beyond", F.lit(1 / (n_symbols + 1)))
        else:
            both = both.withColumn("suffix", low(F.col("gram"), order - 1)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("beyond")), ["lang", "suffix"])
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("beyond")
        lower = written(both.select("lang", "gram", p.alias("p")), f"order{order}")
        row = lambda df, key, what, value, order=order: df.select("lang", F.lit(order).alias("ord"), F.col(key).alias("gram"), F.lit(what).alias("what"), F.log(value).cast("float").alias("value"))
        out += [row(lower, "gram", PROBABILITY, "p"), row(sums, "context", WEIGHT, "gamma")]
    return reduce(DataFrame.union, out), n_symbols


def store_entries(entries: DataFrame, langs: list[str], segment: int = SEGMENT) -> tuple[str, int]:
    """Writes the model's files: (URI of the folder, leading bits of the hash that name the file)."""
    bits = max(0, (entries.count() // segment).bit_length())
    uri, places = fresh_dir(entries.sparkSession, "language-model"), {x: i for i, x in enumerate(langs)}

    def hashed(batches):
        for batch in batches:
            lang = np.array([places[x] for x in batch.column("lang").to_pylist()], np.uint64)
            keys = entry_hash(batch.column("gram").to_numpy().view(U64), lang, batch.column("ord").to_numpy().astype(np.uint64), batch.column("what").to_numpy().astype(np.uint64))
            part = (keys.view(U64) >> U64(63 - bits)) >> U64(1)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(keys), batch.column("value")], names=["part", "h", "value"])

    def write(batches):
        store, folder = local_or_remote(uri)
        store.create_dir(folder, recursive=True)
        held: list = []

        def out():
            part, keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            with store.open_output_stream(f"{folder}/{part[0]}") as f:  # a lost task's file is written anew, with the same bytes
                f.write(keys.tobytes() + values.tobytes())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(part[:1])], names=["part"])

        for batch in batches:
            part, keys, values = (batch.column(c).to_numpy() for c in ("part", "h", "value"))
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and lo < hi and held[-1][0][0] != part[lo]:
                    yield out()
                if lo < hi:
                    held.append((part[lo:hi], keys[lo:hi], values[lo:hi]))
        if held:
            yield out()

    rows = entries.mapInArrow(hashed, "part int, h long, value float").repartition("part").sortWithinPartitions("part", "h")
    rows.mapInArrow(write, "part int").count()
    return uri, bits


@lru_cache(1 << 14)
def segment_arrays(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, values) of a file of the model, mapped into memory; none where there is no such file."""
    data = mapped_file(uri)
    n = 0 if data is None else len(data) // 12
    return (np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float32, n, 8 * n)) if n else (np.zeros(0, np.int64), np.zeros(0, np.float32))


class Store:
    """Values of a model's entries by their hashes."""

    def __init__(self, uri: str, bits: int):
        self.uri, self.bits = uri, bits

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each, NaN where there is none."""
        out = np.full(len(keys), np.nan, np.float32)
        part = ((keys.view(U64) >> U64(63 - self.bits)) >> U64(1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange((1 << self.bits) + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[p] : cuts[p + 1]]
            hashes, values = segment_arrays(f"{self.uri}/{p}")
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, keys[own]), len(hashes) - 1)
                out[own] = np.where(hashes[at] == keys[own], values[at], np.nan)
        return out


class Remembered:
    """Rows of values by gram: sorted hashes, found through an index of their leading bits, and those that came last beside them."""

    def __init__(self, width: int, most_bytes: int = 64 << 20):
        self.width, self.most = width, max(1 << 12, most_bytes // (4 * width + 16))
        self.clear()

    def clear(self) -> None:
        self.values = np.zeros((0, self.width), np.float32)
        self.tables = [self._table(np.zeros(0, U64), np.zeros(0, np.int64))] * 2

    @staticmethod
    def _table(hashes: np.ndarray, places: np.ndarray) -> tuple:
        order = np.argsort(hashes)
        hashes, bits = hashes[order], max(1, len(hashes).bit_length())
        first = np.searchsorted(hashes >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64))
        return hashes, places[order], U64(64 - bits), first, int(np.diff(first).max()) if len(hashes) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each gram, -1 for others."""
        hashes = mix(keys)
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for held, places, shift, first, deepest in self.tables:
            at = first[(hashes[rest] >> shift).astype(np.int64)] if len(held) else rest[:0]
            for step in range(deepest if len(held) else 0):
                place = np.minimum(at + step, len(held) - 1)
                hit = held[place] == hashes[rest]
                out[rest[hit]] = places[place[hit]]
                rest, at = rest[~hit], at[~hit]
                if not len(rest):
                    return out
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Takes distinct grams that it hasn't; forgets the others where it would hold too many."""
        if len(self.values) + len(keys) > self.most:
            self.clear()
        old, late = self.tables
        late = self._table(np.concatenate([late[0], mix(keys)]), np.concatenate([late[1], len(self.values) + np.arange(len(keys))]))
        if len(late[0]) > max(20_000, len(old[0]) // 4):
            old, late = self._table(np.concatenate([old[0], late[0]]), np.concatenate([old[1], late[1]])), self._table(late[0][:0], late[1][:0])
        self.tables, self.values = [old, late], np.concatenate([self.values, values])


class LanguageModels:
    """Interpolated Kneser-Ney models of several languages, over the files of a store."""

    def __init__(self, langs: list[str], n_symbols: int, store: Store):
        self.langs, self.floor, self.store = langs, float(np.log(1 / (n_symbols + 1))), store

    def _log(self, grams: np.ndarray, lang: np.ndarray, order: int) -> np.ndarray:
        """Log probability of the last symbol of each gram after the others, in the language of the same place."""
        if order == 0:
            return np.full(len(grams), self.floor, np.float32)
        out = self.store.find(entry_hash(grams, lang, order, PROBABILITY))
        rest = np.flatnonzero(np.isnan(out))
        if len(rest):
            weight = self.store.find(entry_hash(grams[rest] >> U64(16), lang[rest], order, WEIGHT))
            out[rest] = self._log(low(grams[rest], order - 1), lang[rest], order - 1) + np.nan_to_num(weight)
        return out

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """The same of grams of the highest order under all languages."""
        width = len(self.langs)
        return self._log(np.repeat(grams, width), np.tile(np.arange(width, dtype=U64), len(grams)), ORDER).reshape(len(grams), width)

    def entropies(self, data: np.ndarray, offsets: np.ndarray, held: Remembered | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats a symbol of each text under each language, symbols, whether the text has a letter)."""
        text, bounds, has = folded(data, offsets)
        packed, own = grams(text, bounds)
        width = max(1, len(self.langs))
        held = Remembered(width) if held is None else held
        total = np.zeros((len(has), len(self.langs)))
        step = max(1, min(1 << 18, (16 << 20) // (8 * width), held.most))
        for lo in range(0, len(packed), step):  # bounded memory whatever the length of a text
            part = packed[lo : lo + step]
            at = held.find(part)
            if (at < 0).any():
                new = np.unique(part[at < 0])
                values = np.concatenate([self.logs(new[i : i + 50_000]) for i in range(0, len(new), 50_000)])
                if len(held.values) + len(new) > held.most:  # nothing of the part is remembered any more
                    held.clear()
                    new = np.unique(part)
                    values = np.concatenate([self.logs(new[i : i + 50_000]) for i in range(0, len(new), 50_000)])
                held.add(new, values)
                at = held.find(part)
            values = held.values[at].astype(np.float64)
            row = np.searchsorted(own, np.arange(lo, lo + len(values)), "right") - 1
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            total[row[starts]] += np.add.reduceat(values, starts)
        n = np.diff(own)
        return -total / n[:, None], n, has


@lru_cache(2)
def remembered(uri: str, width: int) -> Remembered:
    """One for each worker process and model: what it remembers serves all its tasks."""
    return Remembered(width)


def fit_models(counts: DataFrame, segment: int = SEGMENT) -> LanguageModels:
    """Models of the languages of ``counts`` (lang, gram, n)."""
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    entries, n_symbols = smoothed(counts)
    return LanguageModels(langs, n_symbols, Store(*store_entries(entries, langs, segment)))


@dataclass(frozen=True)
class Model:
    models: LanguageModels
    limits: np.ndarray  # nats a symbol above which a text isn't taken for each language
    sharpness: float = 0.5
    most_symbols: int = 60

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or 'und', score, whether the entropy is above what the language's own texts have)."""
        if not self.models.langs:
            n = len(offsets) - 1
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        nats, n, has = self.models.entropies(data, offsets, remembered(self.models.store.uri, len(self.models.langs)))
        best = nats.argmin(1)
        gap = (nats - nats.min(1, keepdims=True)) * self.sharpness * np.minimum(n, self.most_symbols)[:, None]
        score = np.where(has, 1 / np.exp(-gap).sum(1), 0)
        langs = [self.models.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        return langs, score, ~has | (nats.min(1) > self.limits[best])


def fit(docs: DataFrame, *, few: int = 30, segment: int = SEGMENT) -> Model:
    """Models of all training rows of ``docs`` (doc_id, text, lang), and limits of rejection.

    Rows without a doc_id, text or lang are not learnt from; rows that repeat
    count each time; a text without a letter adds nothing, and a language that
    has no other texts isn't learnt. Texts of any length are counted whole, in
    bounded memory. Without training rows every text is 'und'. Extra columns are
    left out.

    The limits come from all training rows: mean and four deviations of the nats
    a symbol. A language of under ``few`` rows has at least the deviation of all
    languages together, and no limit where that is 0. ``segment`` is about how
    many entries a file of the model has. Only the languages and two sums of
    each reach the driver.
    """
    known = docs.where(training()).select(F.col("lang").cast("string").alias("lang"), "text")
    models = fit_models(written(gram_counts(known), "grams"), segment)
    limits, places = np.full(len(models.langs), np.inf), {x: i for i, x in enumerate(models.langs)}

    def run(batches):
        held = remembered(models.store.uri, len(models.langs))
        for batch, data, offsets in slices(batches):
            nats, _, has = models.entropies(data, offsets, held)
            at = np.array([places.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            rows = np.flatnonzero(has & (at >= 0))
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(rows)), pa.array(nats[rows, at[rows]])], names=["lang", "nats"])

    if models.langs:
        nats = known.select("lang", "text").mapInArrow(run, "lang string, nats double")
        sums = nats.groupBy("lang").agg(F.count("nats"), F.avg("nats"), F.var_pop("nats")).collect()
        together = sum(n * var for _, n, _, var in sums) / max(1, sum(n for _, n, _, _ in sums))
        for lang, n, mean, var in sums:
            spread = var if n >= few else max(var, together)
            limits[places[lang]] = mean + 4 * spread**0.5 if spread or n >= few else np.inf
    return Model(models, limits)


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names are replaced, others stay.

    A text that is null, empty or without a letter is 'und' with score 0 and
    rejected. Of languages that are equally likely the first by name is taken.
    Texts are scored whole; rows that repeat are scored each; no rows give none.
    """

    def run(batches):
        for batch, data, offsets in slices(batches):
            langs, score, rejected = model.predict(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    docs = docs.drop("lang_pred", "score", "rejected")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; nulls, empty and long texts, ties, repeated rows and an empty table as in ``fit`` and ``with_language``.

    A row of a null doc_id is neither learnt from nor held out. Only doc_id and text are kept of the table.
    """
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    found = with_language(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
