"""Toxicity by noisy-channel deobfuscation.

Words that may be disguised (digits or signs for letters, look-alikes of other
scripts, letters drawn out or doubled, words spelled apart) are restored by
Viterbi search: every character has a lattice of what it may stand for, paths
are weighed by a character language model of the whole corpus, and the best one
is taken, which for most words is the word itself. Documents are then scored by
their words and the restored ones, under weights learnt from labelled documents.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from reliefspark.llm.shared import table, written
from reliefspark.llm.textkit import SPACES, U64, Spans, chained, grouped, hash_spans, lowered, mix, ragged, slices, spans, words

# What letters a sign may stand for, letters of other scripts that look like Latin ones, and the log cost of each way to disguise.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
LOOK_ALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ω": "w", "ı": "i", "ɡ": "g"}
SUBSTITUTED, LOOKS_ALIKE, DROPPED_SIGN, DROPPED_DIGIT, DRAWN_OUT, DOUBLED, BREAK = -1.5, -0.5, -0.3, -8.0, -0.5, -4.0, -1.0
ALPHABET = 64
#: Words of more characters are restored each time, not remembered.
REMEMBERED = 64
PREFIXES = (4, 5, 6, 7, 8)
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())


@lru_cache
def symbol_table() -> np.ndarray:
    """By code point below 0x10000: 0 for what ends a word, 1 to 26 for a to z, others share the rest."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % (ALPHABET - 27)
    return out


def symbols(data: np.ndarray) -> np.ndarray:
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return symbol_table()[np.minimum(points, 0xFFFF)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all symbol trigrams of the corpus: one array of fixed size, to which each task adds its sums."""

    def run(batches):
        held = np.zeros(ALPHABET**3, np.int64)
        for _, data, offsets in slices(batches):
            # documents follow one another after two word ends, which keeps them apart
            text = symbols(np.insert(np.insert(data, offsets[1:-1], 10), offsets[1:-1] + np.arange(len(offsets) - 2), 10)) if len(offsets) > 2 else symbols(data)
            text = np.concatenate([[0, 0], text, [0, 0]]).astype(np.int64)
            held += np.bincount((text[:-2] * ALPHABET + text[1:-1]) * ALPHABET + text[2:], minlength=ALPHABET**3)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["gram", "n"])

    out = np.zeros(ALPHABET**3)
    for gram, n in docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():
        out[gram] = n
    return out.reshape((ALPHABET,) * 3)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of each symbol after two others: orders 3 to 0, each discounted (Witten-Bell) towards the next."""
    p = np.full(ALPHABET, 1 / ALPHABET)
    for axes in ((0, 1), (0,), ()):
        c = counts.sum(axis=axes) if axes else counts
        kinds, total = (c > 0).sum(-1, keepdims=True), c.sum(-1, keepdims=True)
        p = (c + kinds * p) / np.maximum(total + kinds, 1e-9) + (total + kinds == 0) * p
    return np.log(p)


@lru_cache(1 << 16)
def meanings(c: str, again: bool, drawn: bool, apart: bool) -> tuple[tuple[str, tuple[int, ...], float], ...]:
    """What a character may stand for: (letters, '' for none or a space for a word's end; their symbols; log cost).

    ``again``: it repeats the one before; ``drawn``: of three or more; ``apart``: a word may end before it.
    """
    if c.isalpha():
        found = [(c, 0.0)]
        if c in LOOK_ALIKES:
            found.append((LOOK_ALIKES[c], LOOKS_ALIKE))
        elif 0xFF21 <= ord(c) <= 0xFF5A:  # the wide forms of ASCII
            found.append((chr(ord(c) - 0xFEE0), LOOKS_ALIKE))
        if again:
            found.append(("", DRAWN_OUT if drawn else DOUBLED))
    else:
        found = [(x, SUBSTITUTED) for x in LEET.get(c, "")]
        found.append(("", DROPPED_SIGN if not c.isdigit() else DOUBLED if again else DROPPED_DIGIT))
        if len(found) == 1 and not c.isdigit():
            found.append((" ", DROPPED_SIGN))
    if apart:
        found += [(f" {x}", cost + BREAK) for x, cost in found if x not in ("", " ")]
    table = symbol_table()
    return tuple((x, tuple(int(table[min(ord(y), 0xFFFF)]) for y in x), cost) for x, cost in found)


class Restorer:
    """Most likely letters of a disguised word."""

    def __init__(self, logp: np.ndarray):
        self.logp = logp.astype(np.float64).ravel().tolist()
        self.known: dict[tuple[str, bool], str] = {}

    def restore(self, word: str, apart: bool = False) -> str:
        """``apart``: the characters stood apart, so that nothing shows where words end."""
        key = (word, apart)
        found = self.known.get(key)
        if found is None:
            found = self.viterbi(self.lattice(word.lower(), apart))
            if len(word) <= REMEMBERED:
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[key] = found
        return found

    @staticmethod
    def lattice(word: str, apart: bool = False) -> Iterator[tuple]:
        """What each character may stand for."""
        for i, c in enumerate(word):
            again = i > 0 and word[i - 1] == c
            drawn = again and ((i > 1 and word[i - 2] == c) or word[i + 1 : i + 2] == c)
            yield meanings(c, again, drawn, apart and i > 0)

    def viterbi(self, lattice: Iterable[tuple]) -> str:
        """The best path through a lattice of any length, in one search; what all paths have in common is put out on the way."""
        logp, done = self.logp, []
        best = {(0, 0): (0.0, "")}
        for i, choices in enumerate(lattice):
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in best.items():
                for spelled, letters, cost in choices:
                    x, y, total = a, b, score + cost
                    for s in letters:
                        total += logp[(x * ALPHABET + y) * ALPHABET + s]
                        x, y = y, s
                    found = (total, text + spelled)
                    if (x, y) not in new or found > new[x, y]:
                        new[x, y] = found
            best = new
            if i % 32 == 31 and (shared := os.path.commonprefix([t for _, t in best.values()])):
                done.append(shared)
                best = {k: (score, t[len(shared) :]) for k, (score, t) in best.items()}
        done.append(max((score + logp[(a * ALPHABET + b) * ALPHABET], text) for (a, b), (score, text) in best.items())[1])
        return "".join(done)


#: Signs at a word's ends that stand for no letter.
EDGES = ".,;:?\"'*#%&"


@lru_cache
def kinds() -> np.ndarray:
    """By byte: 1 letter, 2 digit of LEET, 3 sign of LEET, 4 other sign."""
    out = np.zeros(256, np.uint8)
    for b in range(33, 127):
        out[b] = 1 if chr(b).isalpha() else (2 if chr(b).isdigit() else 3) if chr(b) in LEET else 4
    return out


@lru_cache
def look_alike_pairs() -> np.ndarray:
    """Which two bytes are a letter of LOOK_ALIKES."""
    out = np.zeros(1 << 16, bool)
    for c in LOOK_ALIKES:
        for x in (c, c.upper()):
            if len(coded := x.encode("utf-8")) == 2:
                out[coded[0] << 8 | coded[1]] = True
    return out


def disguised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[str, bool]]]:
    """(document, number of the word) of all that may be disguised, and the distinct words: text, and whether it was spelled apart.

    These are words of letters with a LEET sign or digit, a repeated letter, a
    sign between letters or a look-alike among ASCII letters; words of LEET
    signs and digits alone that have both; and three or more single characters
    in a row that may stand for letters, not all of them signs.
    """
    starts, ends, rows = words(data, offsets, SPACES)
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    kind = kinds()[data]
    letter, edge = kind == 1, np.zeros(n + 1, bool)
    edge[offsets] = True  # what stands before belongs to another document
    low, alike, mark = lowered()[data], np.zeros(n, bool), np.zeros(n, bool)
    mark[1:] |= letter[1:] & (low[1:] == low[:-1]) & ~edge[1:-1]
    mark[1:-1] |= letter[:-2] & (kind[1:-1] >= 2) & letter[2:] & ~edge[1:-2] & ~edge[2:-1]
    if (data >= 0x80).any():
        alike[:-1] = look_alike_pairs()[data[:-1].astype(np.int64) << 8 | data[1:]]
        alike[:-1] |= (data[:-1] == 0xEF) & ((data[1:] == 0xBC) | (data[1:] == 0xBD))

    def count(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(a.astype(np.int64) | b.astype(np.int64) << 32, out=sums[1:])
        found = sums[ends] - sums[starts]
        return found & 0xFFFFFFFF, found >> 32

    letters, digits = count(letter, kind == 2)
    signs, marks = count(kind == 3, mark)
    likes, points = count(alike, (data & 0xC0) != 0x80)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    chosen = np.flatnonzero(((letters > 0) & (digits + signs + marks + likes > 0)) | ((letters == 0) & (digits > 0) & (signs > 0)))
    chosen = chosen[points[chosen] > 1]
    found = Spans(data, starts[chosen], ends[chosen])
    _, first, number, _ = found.groups()
    texts: list[tuple[str, bool]] = []
    for i in chosen[first].tolist():
        text = data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")
        texts.append((text.strip(EDGES) or text, False))
    begins, closes, _ = spans((points == 1) & (letters + digits + signs + likes > 0), rows)
    lettered = np.concatenate([[0], np.cumsum(letters + likes)])
    runs = np.flatnonzero((closes - begins >= 3) & (lettered[closes] > lettered[begins]))
    for a, b in zip(begins[runs].tolist(), closes[runs].tolist(), strict=True):
        texts.append((b"".join(data[starts[i] : ends[i]].tobytes() for i in range(a, b)).decode("utf-8", "replace"), True))
    return np.concatenate([row[chosen], row[begins[runs]]]), np.concatenate([number, len(first) + np.arange(len(runs))]), texts


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, a row for the words and one for each length of their prefixes; words before each document). 0 where a word has no such prefix."""
    starts, ends, rows = words(data, offsets, SIGNS)
    out = [hash_spans(data, starts, ends, lower=True)]
    for n in PREFIXES:
        keys = mix(hash_spans(data, starts, np.minimum(ends, starts + n), lower=True) + U64(n))
        keys[ends - starts <= n] = 0
        out.append(keys)
    return np.stack(out), rows


def all_features(data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """(features, document of each) of the words as they are and of the restored ones."""
    plain, rows = features(data, offsets)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    where, number, texts = disguised(data, offsets)
    restored = [restorer.restore(w, apart) for w, apart in texts]
    changed = np.array([apart or r != w.lower() for r, (w, apart) in zip(restored, texts, strict=True)], bool)
    if not changed.any():
        return plain, row
    coded = [r.encode("utf-8") if c else b"" for r, c in zip(restored, changed.tolist(), strict=True)]
    more, more_rows = features(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
    at, _ = ragged(more_rows[:-1][number], counts := np.diff(more_rows)[number])
    return np.concatenate([plain, more[:, at]], axis=1), np.concatenate([row, np.repeat(where, counts)])


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    prior: float  # log odds without any feature
    logp: np.ndarray
    slope: float = 1.0

    def scores(self, data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> np.ndarray:
        """Probability that each document is toxic."""
        return 1 / (1 + np.exp(-np.clip(self.prior + self.slope * self.evidence(data, offsets, restorer), -30, 30)))

    def evidence(self, data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> np.ndarray:
        """By document: of each distinct word, the weight of its heaviest feature, summed up."""
        n = len(offsets) - 1
        found, row = all_features(data, offsets, restorer)
        total = np.zeros(n)
        if len(self.keys) and len(row):
            weight = np.zeros(len(row))
            for keys in found:
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                np.maximum(weight, np.where(self.keys[at] == keys, self.weights[at], 0), out=weight)
            hit = np.flatnonzero(weight)
            _, first, _ = grouped(found[0][hit] ^ mix(row[hit].astype(U64) + U64(1)))
            total += np.bincount(row[hit[first]], weights=weight[hit[first]], minlength=n)
        return total


def tail(k: int, n: int, p: float) -> float:
    """An upper bound of P[at least k of n] at rate p (Chernoff)."""
    if k <= n * p:
        return 1.0
    q = k / n
    return math.exp(-n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)))


def shared_ids(texts: DataFrame, window: int = 5, hashes: int = 6) -> DataFrame:
    """(doc_id) of a bounded table without the near copies: those that have a least window hash in common with a smaller doc_id."""

    def run(batches):
        for batch, data, offsets in slices(batches):
            starts, ends, rows = words(data, offsets, SIGNS)
            keys = hash_spans(data, starts, ends, lower=True)
            chain = chained(keys, window)
            least = [[mix(chain[a : b - window + 1] ^ U64(k)).min() for k in range(hashes)] if b - a >= window else [] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.array(x, U64).view(np.int64) for x in least], pa.list_(pa.int64()))], names=["doc_id", "least"])

    kept, seen = [], set()
    for doc_id, least in sorted(tuple(r) for r in texts.select("doc_id", "text").mapInArrow(run, "doc_id long, least array<long>").collect()):
        own = set(enumerate(least))
        if not own & seen:
            kept.append((doc_id,))
        seen |= own
    return texts.sparkSession.createDataFrame(kept, "doc_id long")


def fit(docs: DataFrame, labels: DataFrame, *, most_labels: int = 20_000, purity: float = 0.5) -> Model:
    """Language model of all ``docs``; word weights from at most ``most_labels`` labelled documents.

    Labels are (doc_id, toxic); the documents of the smallest hashes of doc_id
    are taken (of equal hashes the smaller ids), of the training part alone
    (crc32 of doc_id modulo 5 is not 0). Three quarters of them give the
    weights, the others the prior and slope. A word or prefix has a weight where
    toxic documents have it more often than chance allows, all words counted
    together (5 % of one false one), and where at least ``purity`` of the
    documents that have it are toxic. Of near copies one is counted, as their
    words don't stand for independent documents.

    Rows of ``labels`` without a doc_id or label are left out, of several for a
    document the highest label counts; rows that repeat a document count once.
    Null text is empty. Texts of any length are read whole, and a word of any
    length is restored in one search. Without documents or without labels of
    both kinds no word has a weight, and the score is the share of toxic labels.
    Other columns, whatever their names, are not looked at.
    """
    logp = language_model(trigram_counts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(logp)
    known = labels.where("doc_id is not null and toxic is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    texts = written(texts.repartition("doc_id"), "labelled")
    single = shared_ids(texts)

    def run(batches):
        restorer, keys, sums = Restorer(shared.value), np.zeros(0, U64), np.zeros((0, 2), np.int64)
        total = np.zeros(2, np.int64)
        for batch, data, offsets in slices(batches):
            toxic = batch.column("toxic").to_numpy()
            total += np.bincount(toxic, minlength=2)[:2]
            found, row = all_features(data, offsets, restorer)
            flat, rows = found.ravel(), np.tile(row, len(found))
            flat, rows = flat[flat != 0], rows[flat != 0]
            _, first, _ = grouped(flat ^ mix(rows.astype(U64) + U64(1)))
            flat, rows = np.concatenate([keys, flat[first]]), rows[first]
            counts = np.concatenate([sums, np.stack([toxic[rows] == 0, toxic[rows] == 1], axis=1).astype(np.int64)])
            keys, _, number = grouped(flat)
            sums = np.stack([np.bincount(number, weights=c, minlength=len(keys)) for c in counts.T], axis=1).astype(np.int64)
        keys, sums = np.append(keys, U64(0)), np.concatenate([sums, total[None]])  # key 0: the documents
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())], names=["h", "clean", "toxic"])

    texts = texts.join(F.broadcast(single), "doc_id").select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).alias("_quarter"))
    counted = texts.where("not _quarter").select("text", "toxic").mapInArrow(run, "h long, clean long, toxic long").groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = counted.where("toxic >= 3 or h = 0").toArrow()
    h, neg, pos = (found.column(c).to_numpy() for c in ("h", "clean", "toxic"))
    clean, toxic = int(neg[h == 0].sum()), int(pos[h == 0].sum())
    if not toxic or not clean:
        return Model(np.zeros(0, U64), np.zeros(0), math.log((toxic + 0.5) / (clean + 0.5)), logp)
    rate = toxic / (toxic + clean)
    weight = np.log((pos + 0.5) / (toxic + 1)) - np.log((neg + 0.5) / (clean + 1))
    likely = np.flatnonzero((h != 0) & (weight > 0) & ((pos + 0.5) / (pos + neg + 1) >= purity))
    chosen = np.array([i for i in likely.tolist() if tail(int(pos[i]), int(pos[i] + neg[i]), rate) * len(h) < 0.05], np.int64)
    keys = h[chosen].view(U64)
    chosen, keys = chosen[np.argsort(keys)], np.sort(keys)
    model = Model(keys, weight[chosen], math.log((toxic + 0.5) / (clean + 0.5)), logp)
    return calibrated(model, texts.where("_quarter"))


def calibrated(model: Model, texts: DataFrame, least: int = 5) -> Model:
    """The model with prior and slope fitted (logistic regression) on a bounded table of other labelled texts; as it is where a class has too few."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        restorer = Restorer(shared.value.logp)
        for batch, data, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.evidence(data, offsets, restorer)), batch.column("toxic")], names=["x", "toxic"])

    rows = texts.select("text", "toxic").mapInArrow(run, "x double, toxic int").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)
    if min(y.sum(), (1 - y).sum()) < least:
        return model
    design, w = np.stack([np.ones(len(x)), x], axis=1), np.array([model.prior, 1.0])

    def likelihood(w: np.ndarray) -> float:
        z = design @ w
        return float((y * z - np.logaddexp(0, z)).sum() - (w[1] - 1) ** 2 / 4)

    for _ in range(100):  # Newton's steps, halved until they climb
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        uphill = design.T @ (y - p) - np.array([0, 0.5]) * (w - [0, 1])
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-9, 0.5]), uphill)
        while likelihood(w + step) < likelihood(w) and np.abs(step).max() > 1e-12:
            step = step / 2
        if np.abs(step).max() < 1e-10:
            break
        w = w + step
    return Model(model.keys, model.weights, float(w[0]), model.logp, max(0.05, float(w[1])))


def with_scores(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is toxic, in a column ``out`` that replaces one of its name; other columns stay.

    Null and empty texts have the probability of a text without known words.
    Equal texts have equal scores; rows that repeat are scored each, texts of any
    length whole; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        restorer = Restorer(model.logp)
        for batch, data, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(data, offsets, restorer))], names=[*batch.schema.names, out])

    docs = docs.drop(out)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows of a score of ``limit`` or more; all columns but ``_toxicity`` stay, also where a doc_id is null or repeats."""
    name = "_toxicity"
    return with_scores(docs, fit(docs, labels), name).where(F.col(name) < limit).drop(name)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; nulls, empty and long texts, ties, repeated rows and empty tables as in ``fit`` and ``with_scores``.

    A null doc_id has no label and isn't held out; a score of 0.5 is predicted toxic. Only doc_id and text are kept of the table.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
