"""Cuts against a plain tokenizer, exact round trips, and what the cache is asked for."""

import random
import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lavka.llm import fill_in_middle as fim
from lavka.llm.registry import QUERIES


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def same(text, cache=None):
    index, plain = fim.TokenIndex(text.encode(), cache or fim.ChunkCache()), units(text)
    assert index.n == len(plain)
    for k in {0, 1, len(plain) // 3, len(plain) // 2, len(plain) - 1, len(plain)} & set(range(len(plain) + 1)):
        assert index.characters_before(k) == len("".join(plain[:k]))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abZé😀ß \n<>\x00", max_size=80), st.integers(1, 4))
def test_short_texts_in_tiny_chunks(text, bits):
    old = fim.MASK_BITS, fim.LONGEST
    fim.MASK_BITS, fim.LONGEST = bits - 1, 7
    try:
        same(text)
    finally:
        fim.MASK_BITS, fim.LONGEST = old


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_long_texts(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = random.Random(2)
    for text in ("x" * 20_000, " " * 9_000, "é" * 9_000, "".join(rng.choice("ab ñ\n.😀") for _ in range(30_000))):
        same(text)


def test_hash_depends_on_the_last_bytes_only():
    rng = random.Random(8)
    shared = bytes(rng.randrange(256) for _ in range(20_000))
    ends = [fim.chunk_ends(head + shared) for head in (b"", b"q" * 1000, b"other head")]
    inside = [{e - len(h) for e in found if e - len(h) > fim.SPAN + fim.LONGEST} for h, found in zip((b"", b"q" * 1000, b"other head"), ends)]
    assert len(inside[0]) > 20 and inside[0] == inside[1] == inside[2]


def test_shared_passages_are_counted_once():
    rng = random.Random(5)
    passage = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(3_000))
    cache = fim.ChunkCache()
    for n in range(20):
        same(f"head {n} " + passage, cache)
    assert cache.counted < cache.asked / 10
    small = fim.ChunkCache(1_000)  # a cache that is emptied all the time changes nothing
    for n in range(3):
        same(f"head {n} " + passage, small)
    assert small.held <= 1_000 + fim.LONGEST


def test_query(spark, tmp_path):
    rng = random.Random(6)
    texts = [None, "", "a", "<", "a<P>b", "x <S> y", "m<M>", "<<<>>> P> <M", "é" * 50, "word " * 40_000, "ends with <", "<P", "S>"]
    texts += ["".join(rng.choice("ab <>PSM\n😀") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(n, t, "x") for n, t in enumerate(texts)] + [(5, texts[5], "y"), (None, "no id here", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, output string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.restored_sha256): r for r in QUERIES["op13_fill_in_middle"](spark, str(tmp_path)).collect()}
    forms = set()
    for doc_id, text, _ in rows:
        text = text or ""
        u, drawn = units(text), sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(drawn[8 * n : 8 * n + 8], 16) for n in range(4)]
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        plain = text == "" or any(x in text for x in fim.MARKS) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        r = found[(doc_id, sha256(text.encode()).hexdigest())]
        assert (r.n, r.form, r.output_sha256) == (len(u), form, sha256(output.encode()).hexdigest())
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if plain else (len(p), len(m)))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    made = fim.fill_in_middle(F.col("text"), fim.draws(F.col("doc_id")))
    assert docs.select(made.alias("made")).count() == 0
