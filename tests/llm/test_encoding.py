import base64

import pytest

from sagekeep.llm.bpe import SPLIT, VOCABULARY, encoder
from sagekeep.llm.encoding import count_tokens, encode

TEXTS = [
    "", None, " ", "  two  blanks ", "line\n\n- item\r\n\tend", "it's we'll I'M don't", "<|endoftext|> is text",
    "naïve Größe 中文 ½ ² Ⅷ 12345", "🙂🙂 zero\x00byte \x1c", "a" * 3000, "ab" * 2500 + " tail", "aaaa " * 500,
]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_public_library(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode(df).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}


def test_ids_lead_back_to_the_text(reference):
    bpe = encoder()
    for text in filter(None, TEXTS):
        assert reference.decode(bpe.encode(text)) == text
        assert bpe.count(text) == len(bpe.encode(text))


def test_backtracking_gives_the_plain_merges():
    import random

    random.seed(5)
    bpe = encoder()
    for _ in range(3000):
        data = "".join(random.choice("aeinrst hod\xc3\xa9") for _ in range(random.randint(1, 25)))
        assert bpe.encode_bytes(data) == bpe.merge(data)


def test_whole_table_agrees(spark, data, reference):
    df = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in encode(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in texts.items()}


def test_empty_tables_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b b"), (1, "b b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encode(df).collect()) == [(0, 1), (1, 2), (1, 2)]
    assert encode(df.filter("false")).collect() == []
    assert sorted(r.n_tokens for r in count_tokens(df, ["doc_id"]).collect()) == [1, 2, 2]
