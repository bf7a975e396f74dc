"""Byte-level BPE by a minimal acyclic transducer, with exact merging beside it.

The most frequent words of the corpus are encoded once and compiled into a
minimal acyclic automaton: words share prefixes and suffixes, and the numbers on
the arcs of a word's path add up to the word's rank, which points to its ids.
The automaton is a few flat arrays in one file, mapped into memory by every
worker. Words outside it are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
from collections.abc import Callable, Iterable
from functools import cached_property, lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from reliefspark.llm.shared import fresh_dir, local_or_remote, mapped_file, table, written
from reliefspark.llm.textkit import SPACES, Growing, KnownSpans, Spans, grouped, hash_spans, not_in, ragged, release, slices, strings

#: Fixed value: the pattern by which byte-level BPE splits a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache
def byte_symbols() -> dict[str, int]:
    """The character by which vocabulary files write each byte: printable Latin-1
    stands for itself, the other bytes for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file's vocabulary, merges and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"] != spec["pre_tokenizer"] | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE without a normalizer is known")
        symbols = byte_symbols()
        self.token_id = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.id_bytes: list[bytes] = [b""] * (1 + max([*self.token_id.values(), *self.added.values()]))
        for t, i in self.token_id.items():
            self.id_bytes[i] = t
        for t, i in self.added.items():
            self.id_bytes[i] = t.encode("utf-8")
        self.path, self.ignore_merges = path, spec["model"].get("ignore_merges", False)
        self.byte_ids = [self.token_id[bytes([b])] for b in range(256)]
        self.split_added = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, id of the result) of each pair of ids that is merged."""
        symbols, out = byte_symbols(), {}
        with open(self.path, encoding="utf-8") as f:
            pairs = [m.split(" ") if isinstance(m, str) else m for m in json.load(f)["model"]["merges"]]
        for rank, (a, b) in enumerate(pairs):
            left, right = (bytes(symbols[c] for c in x) for x in (a, b))
            out.setdefault((self.token_id[left], self.token_id[right]), (rank, self.token_id[left + right]))
        return out

    @cached_property
    def _compiled(self):
        """A compiled encoder, where ids stand in the order of merges (then the lowest id is the lowest rank)."""
        results = [new for _, new in sorted(self.merges.values())]
        if self.ignore_merges or results != sorted(set(results)) or (results and min(results) < 256):
            return None
        try:
            import tiktoken
        except ImportError:
            return None
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=self.token_id, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        """Exact ids of a text without added tokens."""
        if self._compiled is not None:
            return self._compiled(text)
        return [i for w in regex.findall(PATTERN, text) for i in self.merge(w.encode("utf-8"))]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank is merged first, the leftmost of equal ones.

        By a heap over a linked list: n log n for words of any length.
        """
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.merges[a, b][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y]))
        return [x for x, keep in zip(ids, alive, strict=True) if keep]

    def segments(self, text: str) -> list[tuple[str, int]]:
        """(ordinary text, id of the added token after it or -1) in order."""
        if self.split_added is None or not any(t in text for t in self.added):
            return [(text, -1)]
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out.append((text[at : m.start()], self.added[m[0]]))
            at = m.end()
        return [*out, (text[at:], -1)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Transducer:
    """Minimal acyclic automaton of words with an id list each.

    Arrays: ``arcs`` (state * 256 + byte, sorted), ``targets``, ``skips`` (words
    passed over by taking the arc), ``final`` (by state), ``starts`` and ``ids``
    (id list of each word, in the order of the words).
    """

    MAGIC, NAMES = b"RLFMAT01", (("arcs", np.uint64), ("targets", np.uint32), ("skips", np.uint32), ("final", np.uint8), ("starts", np.uint32), ("ids", np.uint32))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, entries: Iterable[tuple[bytes, list[int]]]) -> Transducer:
        """Of distinct non-empty words; states with equal futures are made one as soon as they are closed."""
        entries = sorted(entries)
        register: dict[tuple, int] = {}
        closed: list[tuple[bool, tuple]] = []  # by state: final, ((byte, state), ...)

        def close(final: bool, arcs: list) -> int:
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(closed)
                closed.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # the open states of the last word
        last = b""
        for word, _ in entries:
            if not word or word == last:
                raise ValueError("words must be distinct and not empty")
            shared = len(os.path.commonprefix([last, word]))
            while len(path) > shared + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], close(final, arcs)))
            path += [[False, []] for _ in word[shared:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], close(final, arcs)))
        root = len(closed)
        closed.append((path[0][0], tuple(path[0][1])))
        count = [0] * len(closed)  # words from each state on; targets are closed before their sources
        rows = []
        for state, (final, arcs) in enumerate(closed):
            n = int(final)
            for byte, target in arcs:
                rows.append((state * 256 + byte, target, n))
                n += count[target]
            count[state] = n
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        lists = [ids for _, ids in entries]
        return cls(
            arcs=np.array(columns[0], np.uint64), targets=np.array(columns[1], np.uint32), skips=np.array(columns[2], np.uint32),
            final=np.array([f for f, _ in closed], np.uint8), starts=np.cumsum([0, *map(len, lists)]).astype(np.uint32), ids=np.array([i for x in lists for i in x], np.uint32), root=root,
        )

    def dump(self) -> bytes:
        parts = [getattr(self, n).astype(t, copy=False).tobytes() for n, t in self.NAMES]
        head = self.MAGIC + struct.pack("<Q6Q", self.root, *map(len, parts))
        return head + b"".join(p + b"\0" * (-len(p) % 8) for p in parts)

    @classmethod
    def view(cls, data) -> Transducer:
        """Over a buffer, such as a mapped file, without a copy."""
        if bytes(data[:8]) != cls.MAGIC:
            raise ValueError("not a transducer file")
        root, *sizes = struct.unpack("<Q6Q", data[8:64])
        arrays, at = {}, 64
        for (name, kind), n in zip(cls.NAMES, sizes, strict=True):
            arrays[name] = np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at)
            at += n + -n % 8
        return cls(root=root, **arrays)

    def ranks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of each span of ``data`` among the compiled words, -1 for others; all spans step together."""
        n, lengths = len(starts), ends - starts
        out = np.full(n, -1, np.int64)
        if not n or not len(self.arcs):
            return out
        live, state, rank, depth = np.flatnonzero(lengths), np.full(n, self.root, np.uint64), np.zeros(n, np.int64), 0
        while len(live):
            key = state[live] * np.uint64(256) + data[starts[live] + depth]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            found = self.arcs[at] == key
            live, at = live[found], at[found]
            state[live] = self.targets[at]
            rank[live] += self.skips[at]
            depth += 1
            ended = lengths[live] == depth
            done = live[ended]
            accepted = done[self.final[state[done].astype(np.int64)] == 1]
            out[accepted] = rank[accepted]
            live = live[~ended]
        return out


@lru_cache(4)
def mapped(uri: str) -> Transducer:
    """The transducer at a URI, mapped into memory."""
    return Transducer.view(mapped_file(uri))


#: White space beyond ASCII starts with one of these bytes in UTF-8.
WIDE_LEADS = bytes([0xC2, 0xE1, 0xE2, 0xE3])


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts split before single spaces and newlines: (starts, ends, number of pieces before each text and at the end).

    Where the characters on both sides of a space or newline are no white space,
    PATTERN splits before it and looks no further back, so that each piece can be
    split and encoded on its own. What might be white space beyond ASCII counts
    as white space; pieces then are longer, and no less exact.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    # beyond ASCII's own, 0x1C to 0x1F count too: some tables have them as white space
    plain = not_in(SPACES + bytes(range(0x1C, 0x20)))[data]
    wide = ~not_in(WIDE_LEADS)[data]
    cut = (data == 0x20) | (data == 0x0A)
    cut[0] = cut[-1] = False
    cut[1:] &= plain[:-1]
    cut[:-1] &= plain[1:] & ~wide[1:]
    cut[2:] &= ~wide[:-2]
    cut[3:] &= ~wide[:-3]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    cut[filled] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


class Encoder:
    """Encodes batches of texts by their distinct pieces, remembering the first ``remember`` pieces that it meets.

    Pieces are looked up in the lexicon; the others are encoded exactly by ``exact``, which gets distinct texts.
    Hashes only find what is remembered: bytes are compared.
    """

    def __init__(self, vocab: Vocabulary, exact: Callable[[list[str]], list[list[int]]], lexicon: Transducer | None = None, remember: int = 1_000_000):
        self.vocab, self.exact, self.lexicon, self.remember = vocab, exact, lexicon, remember
        self.marks = [t.encode("utf-8") for t in vocab.added]
        # two sorted tables of hash, start and length in ``ids`` and place in ``known``: all but the latest pieces, and the latest
        self.tables = [self._table(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)] * 2
        self.ids, self.known = Growing(np.uint32), KnownSpans()

    @staticmethod
    def _table(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(columns[0])
        return tuple(c[order] for c in columns)

    def _remember(self, *columns: np.ndarray) -> None:
        """Joins pieces to the latest, and those to all where they have become many."""
        old, late = self.tables
        late = self._table(*map(np.concatenate, zip(late, columns, strict=True)))
        if len(late[0]) > max(20_000, len(old[0]) // 4):
            old, late = self._table(*map(np.concatenate, zip(old, late, strict=True))), tuple(c[:0] for c in late)
        self.tables = [old, late]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start and length in them for each of the distinct pieces)."""
        ranks = self.lexicon.ranks(data, starts, np.where(ends - starts <= LONGEST, ends, starts)) if self.lexicon is not None else np.full(len(keys), -1)
        rest = np.flatnonzero(ranks < 0)
        lists = self.exact(strings(data, starts[rest], ends[rest]).to_pylist())
        lengths = np.zeros(len(keys), np.int64)
        lengths[rest] = np.fromiter(map(len, lists), np.int64, len(lists))
        own = np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum()))
        begins = np.cumsum(lengths) - lengths
        known = np.flatnonzero(ranks >= 0)
        if len(known):
            bounds = self.lexicon.starts.astype(np.int64)
            begins[known] = bounds[ranks[known]] + len(own)
            lengths[known] = bounds[ranks[known] + 1] + len(own) - begins[known]
            at, _ = ragged(begins[known] - len(own), lengths[known])
            begins[known] = len(own) + np.cumsum(lengths[known]) - lengths[known]
            own = np.concatenate([own, self.lexicon.ids[at]])
        return own, begins, lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, their offsets)."""
        whole = data.tobytes()
        if any(m in whole for m in self.marks):
            return self._with_added(data, offsets)
        starts, ends, rows = pieces(data, offsets)
        parts = [self._encode(data, starts[lo : lo + CHUNK], ends[lo : lo + CHUNK]) for lo in range(0, len(starts), CHUNK)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(np.concatenate([n for _, n in parts]), out=bounds[1:])
        return np.concatenate([i for i, _ in parts]), bounds[rows]

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of some pieces one after another, number of each piece's)."""
        begin_byte = int(starts[0])
        spans = Spans(data[begin_byte : int(ends[-1])], starts - begin_byte, ends - begin_byte)
        distinct, first, number, own = spans.groups()
        have, taken = np.zeros(len(distinct), bool), np.arange(len(distinct)) >= own
        begin, length = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        for keys, begins, lengths, places in self.tables:
            at = np.minimum(np.searchsorted(keys, distinct), max(0, len(keys) - 1))
            here = np.flatnonzero(keys[at] == distinct) if len(keys) else at[:0]
            taken[here] = True
            here = here[spans.equal(first[here], places[at[here]], self.known)]
            have[here] = True
            begin[here], length[here] = begins[at[here]], lengths[at[here]]
        new = np.flatnonzero(~have)
        ids, begins, lengths = self._learn(distinct[new], data, starts[first[new]], ends[first[new]])
        begin[new], length[new] = begins, lengths
        n = length[number]
        if len(new) and sum(len(t[0]) for t in self.tables) + len(new) <= self.remember:
            begin[new] += self.ids.size
            free = new[~taken[new]]
            self._remember(distinct[free], begin[free], length[free], len(self.known.lengths) + np.arange(len(free)))
            self.ids.add(ids)
            self.known.add(spans, first[free])
            have[:] = True
        out, offsets = np.empty(int(n.sum()), np.uint32), np.cumsum(n) - n
        for source, chosen in ((self.ids.values, have[number]), (ids, ~have[number])):
            out[ragged(offsets[chosen], n[chosen])[0]] = source[ragged(begin[number[chosen]], n[chosen])[0]]
        return out, n

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where the texts hold added tokens: each stretch between two of them is a text of its own."""
        stretches, follows, counts = [], [], []
        for a, b in pairwise(offsets.tolist()):
            parts = self.vocab.segments(data[a:b].tobytes().decode("utf-8"))
            stretches += [p.encode("utf-8") for p, _ in parts]
            follows += [i for _, i in parts]
            counts.append(len(parts))
        marks, self.marks = self.marks, []
        ids, bounds = self.encode(np.frombuffer(b"".join(stretches), np.uint8), np.cumsum([0, *map(len, stretches)]))
        self.marks = marks
        added = np.array(follows, np.int64)
        at = np.flatnonzero(added >= 0)
        ids = np.insert(ids, bounds[1:][at], added[at].astype(np.uint32))
        bounds = bounds + np.concatenate([[0], np.cumsum(added >= 0)])
        return ids, bounds[np.cumsum([0, *counts])]


#: Pieces above so many bytes are not compiled.
LONGEST = 64
#: Pieces that are looked up together.
CHUNK = 1 << 17


@lru_cache(2)
def worker_encoder(tokenizer: str, lexicon: str | None) -> Encoder:
    """One for each worker process: what it remembers serves all its tasks."""
    vocab = vocabulary(tokenizer)
    return Encoder(vocab, lambda texts: list(map(vocab.encode, texts)), mapped(lexicon) if lexicon else None)


def word_counts(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """(word, n): pieces of at most LONGEST bytes over all texts. Each task sums up its own first, in bounded memory."""

    def count(batches):
        keys, n, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def out():
            names = pa.concat_arrays(held) if held else pa.array([], pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(n)], names=["word", "n"])

        for _, data, offsets in slices(batches):
            starts, ends, _ = pieces(data, offsets)
            short = ends - starts <= LONGEST
            starts, ends = starts[short], ends[short]
            distinct, first, number = grouped(hash_spans(data, starts, ends))
            sums = np.bincount(number, minlength=len(distinct))
            order = np.argsort(keys)
            at = np.searchsorted(keys, distinct, sorter=order)
            have = np.zeros(len(distinct), bool)
            inside = at < len(keys)
            have[inside] = keys[order[at[inside]]] == distinct[inside]
            n[order[at[have]]] += sums[have]
            keys, n = np.concatenate([keys, distinct[~have]]), np.concatenate([n, sums[~have]])
            held.append(strings(data, starts[first[~have]], ends[first[~have]]))
            if len(keys) > flush:
                yield out()
                keys, n, held = keys[:0], n[:0], []
        if len(keys):
            yield out()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, size: int = 1 << 16) -> str:
    """Compiles the most frequent words of the corpus, at most ``size``, and returns the file's URI.

    The least count is the lowest step of a 16th of a power of two above which there
    are no more than ``size`` words, so that only those leave the executors. ``size``
    bounds what reaches the driver and what workers map; it has no effect on ids.
    """
    vocab = vocabulary(tokenizer)
    counts = written(word_counts(docs).where("n > 1"), "words").withColumn("step", F.floor(16 * F.log2("n")))
    least, held = 1 << 30, 0
    for step, n in sorted((tuple(r) for r in counts.groupBy("step").count().collect()), reverse=True):
        held += n
        if held > size:
            break
        least = step
    top = counts.where(F.col("step") >= least).select("word").toArrow().column("word").to_pylist()
    words = [w for w in top if not any(t in w for t in vocab.added)]
    data = Transducer.build([(w.encode("utf-8"), vocab.encode(w)) for w in words]).dump()
    uri = fresh_dir(docs.sparkSession, "lexicon")
    store, folder = local_or_remote(uri)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/words.mat") as f:
        f.write(data)
    # the driver has no further use of what building took
    vocabulary.cache_clear()
    del vocab, top, words, data
    release()
    return f"{uri}/words.mat"


def encode_column(docs: DataFrame, tokenizer: str, lexicon: str | None = None, column: str = "text", out: str = "ids") -> DataFrame:
    """Appends the ids of a text column (null or empty text: no ids) as array<int>; a column ``out`` is replaced, all others and all rows stay."""

    def encode(batches):
        encoder = worker_encoder(tokenizer, lexicon)
        for batch, data, offsets in slices(batches, column):
            ids, bounds = encoder.encode(data, offsets)
            lists = pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    docs = docs.drop(out)
    return docs.mapInArrow(encode, StructType([*docs.schema.fields, StructField(out, ArrayType(IntegerType()))]))


def decode_column(docs: DataFrame, tokenizer: str, column: str = "ids", out: str = "text") -> DataFrame:
    """Appends the text that an array<int> column of ids stands for (null ids: empty)."""

    def decode(batches):
        vocab = vocabulary(tokenizer)
        for batch in batches:
            texts = [b"".join(map(vocab.id_bytes.__getitem__, ids or [])).decode("utf-8", "replace") for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    docs = docs.drop(out)
    return docs.mapInArrow(decode, StructType([*docs.schema.fields, StructField(out, StringType())]))


class Spelling:
    """Joins what stands for each id: its bytes, or its decimal digits and a comma."""

    def __init__(self, parts: list[bytes]):
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts, self.data = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(parts), np.uint8)

    def join(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, offsets = ragged(self.starts[ids], self.lengths[ids])
        return self.data[at], offsets[bounds]


@lru_cache(2)
def spellings(tokenizer: str) -> tuple[Spelling, Spelling]:
    parts = vocabulary(tokenizer).id_bytes
    return Spelling(parts), Spelling([b"%d," % i for i in range(len(parts))])


ROUND_TRIP = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, tokenizer: str, lexicon: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the text decoded from them, by document.

    Without ``with_ids`` only the digests of each side leave the worker. Null and
    empty texts have no ids; texts and words of any length are encoded whole; a
    null doc_id stays null; rows that repeat are rows of their own; no rows give
    none. Merges of equal rank are made from the left. Columns besides doc_id and
    text, whatever their names, are left out.
    """

    def run(batches):
        encoder, (letters, digits) = worker_encoder(tokenizer, lexicon), spellings(tokenizer)
        for batch, data, offsets in slices(batches, max_bytes=2 << 20):
            ids, bounds = encoder.encode(data, offsets)
            (decoded, a), (decimal, b) = letters.join(ids, bounds), digits.join(ids, bounds)
            decoded, decimal, rows = memoryview(decoded), memoryview(decimal), [[], []]
            for i in range(len(batch)):
                rows[0].append(hashlib.sha256(decimal[b[i] : max(b[i], b[i + 1] - 1)]).hexdigest())
                text = str(decoded[a[i] : a[i + 1]], "utf-8", "replace")
                rows[1].append(hashlib.sha256(text.encode("utf-8")).hexdigest())
            lists = [pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))] * with_ids
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), *(pa.array(r, pa.string()) for r in rows), *lists], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {ROUND_TRIP}" + ", ids array<int>" * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document encoded and decoded again; nulls, empty and long texts, ties, repeated rows and an empty table as in ``round_trip``."""
    docs, tokenizer = table(spark, sf_dir, "documents"), tokenizer or default_tokenizer()
    return round_trip(docs, tokenizer, build_lexicon(docs, tokenizer))
