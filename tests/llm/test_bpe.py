import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lavka.llm import bpe
from lavka.llm.text_queries import word_vocabulary

PARTS = list("abcdefgABCÉéßİΣςñ  \t\n'sdt.,!0193\x85\xa0\x1cẞ漢​　<|>")
PARTS += ["<|endoftext|>", "<|startoftext|>", "'ll", "aaaa", "lolol", "\U0001f600", "é"]


@pytest.fixture(scope="module")
def path():
    return word_vocabulary()


def test_ids_equal_the_library(path):
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    encoder = bpe.Encoder(bpe.Vocabulary(open(path, encoding="utf-8").read()))
    ids, counts = encoder.encode(texts)
    start = 0
    for text, count in zip(texts, counts.tolist()):
        assert ids[start : start + count].tolist() == library.encode(text, add_special_tokens=False).ids, text
        start += count


def test_columns_with_odd_rows(spark, path):
    library = Tokenizer.from_file(path)
    long = "Lorem ipsum dolor " * 20_000 + "x" * 50_000
    texts = [None, "", " \n", "one Two", "one Two", long]
    rows = spark.createDataFrame([(n, t, "mine") for n, t in enumerate(texts)], "doc_id int, text string, ids string")
    coded = rows.withColumn("ids", bpe.encode(spark, F.col("text"), path))  # a clashing name is replaced
    found = coded.withColumn("back", bpe.decode(spark, F.col("ids"), path)).collect()
    for row in found:
        expected = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == expected
        assert row.back == library.decode(expected, skip_special_tokens=False)
    assert coded.filter("false").count() == 0
    odd = spark.createDataFrame([([320, 999_999, -1, 320],), (None,)], "ids array<int>")
    back = [r[0] for r in odd.select(bpe.decode(spark, F.col("ids"), path)).collect()]
    assert back == [library.decode([320, 320], skip_special_tokens=False), None]


def test_memory_is_forgotten_without_changing_ids(path, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "INDEXED", 5)
    encoder = bpe.Encoder(bpe.Vocabulary(open(path, encoding="utf-8").read()))
    library = Tokenizer.from_file(path)
    for text in ("alpha beta gamma delta", "alpha beta", "zeta alpha"):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
