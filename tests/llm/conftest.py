import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, path string, ids string, n string, h string"

TRICKY = [
    None, "", " ", "\n\n", "one", "one two", "Ünï cödé ÇA", "a  b\t\tc", "x\x1cy z", "tab\there", "<|endoftext|>mid<|endoftext|> end", "½²Ⅷ 三 1234", "I'LL we'll it's", "🎉👩‍👩‍👧 ok", "z" * 3000, "w " * 2000,
    "The cat sat.\nThe cat sat.\n the  CAT sat. \nnew line here", "# $ % & | < > *", "퟿�　wide space",
]


@pytest.fixture(scope="session")
def tricky(spark):
    """Documents with nulls, empty and very long texts, repeated rows and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", f"s{i % 2}" if i % 5 else None, None, "p", "q", "r", "s") for i, t in enumerate(TRICKY)]
    rows += [rows[5], rows[5], (None, "no id at all", None, None, None, None, None, None, None), (40, TRICKY[16], None, "s1", 1, "p", "q", "r", "s")]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
