import random

from lavka.llm import decontamination as d


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_search_equals_comparing_everything(spark):
    rng = random.Random(2)
    items = [words(rng, n) for n in (5, 6, 9, 14, 20, 33, 70, 140, 600)]
    texts = []
    for n in range(120):
        text = words(rng, rng.choice([3, 40, 900, 6000]))
        for item in rng.sample(items, rng.choice([0, 1, 2])):
            part = list(item)
            for _ in range(rng.choice([0, 0, 1, len(item) // 20])):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(text))
            text[at:at] = part
        texts.append(" ".join(text).title() + ".")
    given = [" ".join(i) for i in items]
    block = d.Items(given)
    found = {(n, i) for n, hits in enumerate(block.contained(texts)) for i, _ in hits}
    wanted = set()
    for n, text in enumerate(texts):
        own = d.shingles(text)
        for i, item in enumerate(given):
            share = d.shingles(item)
            if len(share & own) / len(share) >= d.CONTAINED:
                wanted.add((n, i))
    assert found == wanted and len(wanted) > 40


def test_odd_rows(spark, monkeypatch):
    passage = "the quick brown fox jumps over the lazy dog near the old mill by the river"
    long = " ".join(f"filler{n}" for n in range(60_000)) + " " + passage.upper() + "! " + "x" * 600_000
    docs = [(1, passage), (1, passage), (2, None), (3, ""), (None, f"So:\n{passage}."), (4, long), (5, "nothing of it here at all")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, item_id int")
    items = [(7, passage), (8, passage), (None, passage + " and more words than that"), (9, None), (10, ""), (11, "too few words")]
    items = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r.doc_id or -1, r.item_id or -1, round(r.containment, 3)) for r in d.contaminations(docs, items).collect())
    assert found == sorted((i, n, 1.0) for i in (1, 1, -1, 4) for n in (7, 8))
    clean = d.uncontaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 5]
    monkeypatch.setattr(d, "BLOCK_ITEMS", 1)  # several blocks find the same
    again = sorted((r.doc_id or -1, r.item_id or -1, round(r.containment, 3)) for r in d.contaminations(docs, items).collect())
    assert again == found
    assert d.contaminations(docs, items.filter("false")).count() == 0
    assert d.contaminations(docs.filter("false"), items).count() == 0


def test_items_of_few_words_and_without_spaces(spark):
    texts = [
        "What is the Capital of France, again?", "the capital, of france", "capital of Frances", "法国的首都是哪里？答案是巴黎。", "前文。请问法国的首都是哪里", "法国 首都", "เมืองหลวงของฝรั่งเศสคือ",
        "a b c d", None, "", "yes", "x " * 70_000 + "capital of france",
    ]
    items = ["capital of France", "法国的首都是哪里？", "เมืองหลวงของฝรั่งเศส", "b  c", "yes!", "", "...", None, "capital of france", "法国"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.containment) for r in d.contaminations(docs, asked).collect())
    expected = []
    for n, text in enumerate(texts):
        for i, item in enumerate(items):
            words = d.all_words(item or "")
            if words:
                size = min(5, len(words))
                share = d.shingles(item, size)
                part = len(share & d.shingles(text or "", size)) / len(share)
                expected += [(n, i, part)] if part >= d.CONTAINED else []
    assert found == expected
    assert {(0, 0), (1, 8), (3, 1), (4, 1), (6, 2), (7, 3), (10, 4), (11, 0), (5, 9)} <= {(n, i) for n, i, _ in found} and (2, 0, 1.0) not in found
