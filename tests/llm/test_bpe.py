import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reliefspark.llm import bpe, tokenfiles
from reliefspark.llm.shared import fresh_dir
from tests.llm.conftest import TRICKY

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encode(encoder, texts):
    coded = [t.encode() for t in texts]
    ids, bounds = encoder.encode(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_texts_by_the_library():
    rng, vocab = random.Random(5), bpe.vocabulary(PATH)
    points = [*range(1, 0xD800), *range(0xE000, 0x20000)]
    texts = [t or "" for t in TRICKY] + ["".join(rng.choice([chr(rng.randrange(128)), chr(rng.choice(points)), " ", "\n", "'s", "ab", "<|endoftext|>"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    lexicon = bpe.Transducer.build([(w.encode(), vocab.encode(w)) for w in {" the", "\nab", " ab", "ab"}])
    for encoder in (bpe.Encoder(vocab, lambda x: [vocab.encode(t) for t in x], lexicon, remember=200), tokenfiles.library_encoder(PATH)):
        got = [ids for i in range(0, len(texts), 70) for ids in encode(encoder, texts[i : i + 70])]
        assert got == [library(t) for t in texts]


def test_plain_merging_agrees():
    vocab, rng = bpe.vocabulary(PATH), random.Random(2)
    for word in [b"", b" the", b"aaaaaaaaaaaaaaaa", bytes(range(256)), *(bytes(rng.choices(b" abcdefgthesion\xc3\xa9", k=rng.randrange(60))) for _ in range(500))]:
        text = word.decode("utf-8", "ignore")
        assert [i for w in bpe.regex.findall(bpe.PATTERN, text) for i in vocab.merge(w.encode())] == vocab.encode(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abß ", min_size=1, max_size=7).map(str.encode), st.lists(st.integers(0, 99), max_size=4), max_size=40))
def test_transducer(entries):
    made = bpe.Transducer.view(bpe.Transducer.build(entries.items()).dump())
    asked = [*entries, b"", b"nope", *(w + b"a" for w in entries), *(w[:-1] for w in entries)]
    ends = np.cumsum([0, *map(len, asked)])
    ranks = made.ranks(np.frombuffer(b"".join(asked), np.uint8), ends[:-1], ends[1:])
    got = [None if r < 0 else made.ids[made.starts[r] : made.starts[r + 1]].tolist() for r in ranks]
    assert got == [entries.get(w) for w in asked]


def test_transducer_is_minimal():
    words = [a + b for a in (b"walk", b"talk", b"stalk") for b in (b"", b"s", b"ed", b"ing")]
    made = bpe.Transducer.build((w, []) for w in words)
    ends = {bytes(w[i:]) for w in words for i in range(len(w) + 1)}
    futures = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(made.final) == len(futures) < len(ends)


def check(rows, texts):
    want = sorted(((i, len(ids := library(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, t in texts), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == want


def test_round_trip(spark, tricky, no_documents):
    for lexicon in (None, bpe.build_lexicon(tricky, PATH, size=20)):
        check(bpe.round_trip(tricky, PATH, lexicon).collect(), [(r.doc_id, r.text) for r in tricky.collect()])
    assert bpe.round_trip(no_documents, PATH, bpe.build_lexicon(no_documents, PATH)).count() == 0


def test_query(spark, sf, documents):
    check(bpe.op2_bpe(spark, sf).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_columns(tricky):
    got = bpe.decode_column(bpe.encode_column(tricky, PATH).drop("text"), PATH).collect()
    assert sorted(r.text for r in got) == sorted(r.text or "" for r in tricky.collect())


def digests(pairs):
    out, start = [], 0
    for i, t in pairs:
        ids = [*library(t), 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, sf, documents):
    got = sorted(tuple(r) for r in tokenfiles.op3_tokens(spark, sf).collect())
    assert got == digests(sorted((r.doc_id, r.text) for r in documents.collect()))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_tricky_token_files(spark, tricky, encoding):
    to = fresh_dir(spark, "t")
    tokenfiles.write_tokens(tricky, to, PATH, ids_encoding=encoding, page_rows=2)
    got = tokenfiles.with_crc32(tokenfiles.read_tokens(spark, to)).collect()
    want = digests(sorted(((r.doc_id, r.text) for r in tricky.collect()), key=lambda x: -1 if x[0] is None else x[0]))
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    one = tokenfiles.read_tokens(spark, to, where=bpe.F.col("doc_id") == 5, columns=("doc_id", "start")).distinct()
    assert len(one.collect()) == 3 and "ids" not in str(one._jdf.queryExecution().executedPlan().toString()).split("ReadSchema")[1]


def test_no_token_files(spark, no_documents):
    to = fresh_dir(spark, "t")
    tokenfiles.write_tokens(no_documents, to, PATH)
    assert tokenfiles.with_crc32(tokenfiles.read_tokens(spark, to)).count() == 0


def metadata(to):
    import glob

    import pyarrow.parquet as pq

    return [pq.ParquetFile(p) for p in sorted(glob.glob(f"{to.removeprefix('file:').replace('//', '/', 1)}/part-*.parquet"))]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_encodings_and_page_indexes(spark, encoding):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> concat('w', (i * id) % 97))) as text")
    to = fresh_dir(spark, "t")
    tokenfiles.write_tokens(docs, to, PATH, ids_encoding=encoding, page_rows=64, page_bytes=4 << 10, row_group_bytes=128 << 10)
    files = metadata(to)
    assert sum(f.metadata.num_rows for f in files) == 4000 and max(f.metadata.num_row_groups for f in files) > 1
    for f in files:
        for g in range(f.metadata.num_row_groups):
            columns = {c.path_in_schema: c for i in range(f.metadata.num_columns) for c in [f.metadata.row_group(g).column(i)]}
            ids = next(c for n, c in columns.items() if n.startswith("ids"))
            assert all(c.has_offset_index for c in columns.values()) and all(c.has_column_index for n, c in columns.items() if not n.startswith("ids"))
            assert ("RLE_DICTIONARY" in ids.encodings) == (encoding == "dictionary")
            assert encoding == "dictionary" or "DELTA_BINARY_PACKED" in ids.encodings
            assert all("DELTA_BINARY_PACKED" in columns[n].encodings for n in ("doc_id", "part_start", "n_tokens"))


def read_rows(spark, to, **how):
    """Rows and bytes that the scan of the files gives to a query, by its metrics."""
    df = tokenfiles.read_tokens(spark, to, **how)
    found = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    scans, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
            continue
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if p.nodeName().startswith("Scan parquet"):
            scans.append(p)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found, text, [s.metrics().apply("numOutputRows").value() for s in scans]


def test_selective_reads_skip_pages(spark):
    """A condition on doc_id reads pages, not files or row groups; metadata reads leave the ids alone."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('some words of document ', id) as text").repartition(1)
    to = fresh_dir(spark, "t")
    tokenfiles.write_tokens(docs, to, PATH, page_rows=100)
    assert max(f.metadata.num_row_groups for f in metadata(to)) == 1  # so that it is pages that are skipped
    found, text, scanned = read_rows(spark, to, where=(bpe.F.col("doc_id") >= 7000) & (bpe.F.col("doc_id") < 7010))
    assert sorted(r.doc_id for r in found) == list(range(7000, 7010))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,7000)" in text and min(scanned) <= 300
    found, text, _ = read_rows(spark, to, columns=("doc_id", "start", "n_tokens"))
    assert len(found) == 20_000 and "ids:" not in text.split("ReadSchema")[1]
