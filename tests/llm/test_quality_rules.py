"""Counts against a plain recount, sketches against sorted values, verdicts on planted junk."""

import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lavka.llm import quality_rules as rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    repeated_lines = sum(x in lines[:n] for n, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated_lines, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aé😀  \x1c #|\n\t\r\x0b\x0c", max_size=60))
def test_counts_of_odd_characters(text):
    assert rules.text_counts(text.encode()) == plain_counts(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_counts_of_repeats(words):
    text = " ".join(words)
    assert rules.text_counts(text.encode()) == plain_counts(text)


def documents(spark):
    rng = random.Random(4)
    words = [f"{'abcdefgh'[n % 8] * (3 + n % 5)}{n}" for n in range(200)]
    rows = []
    for n in range(900):
        lang, source = [("en", "a"), ("en", "b"), ("de", None), (None, "c")][n % 4]
        rows.append((n, " ".join(rng.choice(words) for _ in range(rng.randrange(12, 80))), lang, source))
    for n in range(900, 940):  # symbols, and words run together
        rows.append((n, " ".join(x for w in rng.sample(words, 30) for x in (w, rng.choice("|#$%"))), "en", "a"))
    for n in range(940, 960):
        rows.append((n, " ".join("".join(rng.sample(words, 30)) for _ in range(40)), "de", None))
    rows += [(960, None, "en", "a"), (961, "", "xx", "a"), (None, "one two", "en", None), (962, "a " * 50, "en", "b"), (962, "a " * 50, "en", "b")]
    rows += [(963, " ".join(rng.choice(words) for _ in range(200_000)), "en", "b")]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_words int").repartition(5)


def test_verdicts(spark):
    rows, docs = documents(spark)
    found = rules.judged(docs).collect()
    assert len(found) == len(rows)
    texts = Counter((i, plain_counts(t or "")) for i, t, *_ in rows if i != 963)
    assert Counter((r.doc_id, tuple(r[1:6])) for r in found if r.doc_id != 963) == texts
    for r in found:
        expected = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == expected and (not expected or not r.kept)
        if not expected and r.doc_id is not None:
            assert r.kept == (not 900 <= r.doc_id < 960), r
    assert all("symbols" in r.far_out for r in found if r.doc_id and 900 <= r.doc_id < 940)
    kept = rules.passing(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found if r.kept)
    empty = docs.filter("false")
    assert rules.judged(empty).count() == 0 and rules.passing(empty).count() == 0


def test_sketches_merge_and_bound_their_error(spark):
    _, docs = documents(spark)
    counted = docs.select("lang", "source", rules.base_counts(docs.text).alias("c")).select("lang", "source", "c.*")
    found = {(r.level, r.lang, r.source): r for r in rules.quartiles(rules.sketches(counted)).collect()}
    values = {}
    for r in counted.filter("n_words > 0").collect():
        for key in ((2, r.lang, r.source), (1, r.lang, None), (0, None, None)):
            values.setdefault(key, []).append((1000 * r.word_chars // r.n_words, r.n_words))
    assert set(found) == set(values)
    for key, held in values.items():
        lengths, n = sorted(v for v, _ in held), len(held)
        assert found[key].held == n
        for q in (1, 3):
            exact, mine = lengths[-(-q * n // 4) - 1], found[key][f"length_{q}"]
            assert mine <= exact < mine * (1 + 1 / 64) + 1
    twice = {(r.level, r.lang, r.source): r for r in rules.quartiles(rules.sketches(counted.repartition(13))).collect()}
    assert found == twice


def test_small_groups_take_the_limits_above(spark):
    _, docs = documents(spark)
    counted = docs.select("lang", "source", rules.base_counts(docs.text).alias("c")).select("lang", "source", "c.*")
    held = {(r.lang, r.source): r["limits"]["held"] for r in rules.limits(counted).collect()}
    assert held[("en", None)] == held[("en", "a")] + held[("en", "b")] + 1  # its own single row
    assert held[("de", None)] > rules.LEAST_ROWS
