import random

from quillspark.llm import leaks
from quillspark.llm.looks import letters


def test_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    items = [(i, word(rng.choice([10, 80, 120, 300]))) for i in range(20)] + [(20, None), (21, "")]
    docs = []
    for d in range(60):
        x = word(200)
        for _ in range(rng.randrange(3)):
            t = rng.choice(items[:20])[1]
            n = rng.choice([79, 80, 81, 100])
            i = rng.randrange(max(1, len(t) - n))
            cut = t[i : i + n].upper()
            cut = cut[:40] + " ，​" + cut[40:]
            k = rng.randrange(len(x))
            x = x[:k] + cut + x[k:]
        docs.append((d, x))
    docs += [(60, None), (61, ""), (62, docs[0][1])]
    want = set()
    for d, x in docs:
        form = letters(x or "")
        grams = {form[i : i + 80] for i in range(len(form) - 79)}
        for i, t in items:
            t = letters(t or "")
            if any(t[k : k + 80] in grams for k in range(len(t) - 79)):
                want.add((d, i))
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame(items, "item_id long, text string")
    for block in (100, 10_000):  # several automata and one
        got = leaks.leaked_passages(dd, ii, "doc_id", "text", "item_id", "text", block_letters=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    texts = dict(docs)
    for r in got:
        assert len(letters(texts[r["doc_id"]][r["start"] : r["end"]])) == r["n_letters"] >= 80


def test_nothing_to_find(spark):
    dd = spark.createDataFrame([(1, "a" * 100)], "doc_id long, text string")
    ii = spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaked_passages(dd, ii, "doc_id", "text", "item_id", "text").count() == 0


def test_short_texts_with_many_letters_and_blocks_of_items(spark):
    form = "abcdefgh" * 10
    wide = "Ⅷ" * 20 + "x" * 5  # 25 characters, 85 letters
    docs = spark.createDataFrame([(1, wide), (2, form), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "viii" * 20), (2, form), (3, form + "z")], "item_id long, text string")
    for letters_a_block in (20_000_000, 100, 1):
        got = leaks.leaked_passages(docs, items, "doc_id", "text", "item_id", "text", block_letters=letters_a_block)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1), (2, 2), (2, 3)}
