import numpy as np
import pytest

from quillspark.llm import mix


def test_permutations():
    for n in (1, 2, 3, 10, 257, 1000):
        for k in (1, 9):
            assert sorted(mix.permuted(np.arange(n), np.full(n, n), np.full(n, k))) == list(range(n))


def build(spark):
    docs = [(i, f"word number {i} " * (20 + i % 7), ["a", "A ", "b", "B", None, "other"][i % 6]) for i in range(600)] + [(600, None, "a"), (601, "", "b")]
    targets = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 9)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(targets, "source string, weight double, max_repeats int")


def test_shares_caps_and_blocks(spark):
    docs, targets = build(spark)
    m = mix.mixture(docs, targets, block=64, shard_slots=16)
    report = {r["source"]: r for r in m.report.collect()}
    assert report["a"]["documents"] == 200 and report["c"]["documents"] == 0
    total = sum(r["tokens"] for r in report.values())
    for r in report.values():
        assert r["short"] == (r["max_repeats"] * r["tokens"] < r["weight"] * total)
        assert r["most_times"] <= r["max_repeats"] and r["slots_filled"] <= r["slots_drawn"]
    assert sum(r["slots_drawn"] for r in report.values()) == total // 64
    assert abs(report["b"]["share_of_wanted"] - 0.3) < 0.08
    slots = m.slots.where("block >= 0").groupBy("source_no", "turn", "block").count()
    assert slots.where("count > 1").count() == 0
    chosen = m.chosen.collect()
    assert len({r["doc_id"] for r in chosen}) == len(chosen) and {r["source"] for r in chosen} <= {"a", "b"}


def test_same_seed_same_mixture(spark):
    docs, targets = build(spark)
    a, b = (sorted(map(tuple, mix.mixture(docs, targets, block=64, shard_slots=16).chosen.collect())) for _ in range(2))
    assert a == b


def test_empty_and_wrong_tables(spark):
    docs, targets = build(spark)
    assert mix.mixture(docs.limit(0), targets).chosen.count() == 0
    assert mix.mixture(docs, targets.limit(0)).report.count() == 0
    twice = spark.createDataFrame([("a", 0.5, 1), ("A", 0.5, 1)], "source string, weight double, max_repeats int")
    with pytest.raises(ValueError, match="spellings"):
        mix.mixture(docs, twice)


def test_stretches_do_not_cut_words(spark):
    import base64
    import random

    import tiktoken

    rng = random.Random(1)
    text = "".join(rng.choice(["灯塔", "harbour ", "'s ", "12 ", "\n\n", "  ", "。", "été "]) for _ in range(4000))
    parts = list(mix.stretches(text, 500))
    assert "".join(parts) == text and len(parts) > 5 and max(map(len, mix.stretches("a" * 3000, 500))) == 3000
    with open(f"{mix.TOKENIZERS}/byte_bpe_multi_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    coder = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert sum(len(coder.encode_ordinary(x)) for x in parts) == len(coder.encode_ordinary(text))
