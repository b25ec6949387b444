"""Problem 7: combining sources so that each holds its target share of the tokens."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import saved, shuffle_partitions

TOKENIZERS = os.environ.get("QUILL_TOKENIZERS", "/opt/tokenizers")
BLOCK, SHARD_SLOTS, SEED = 1024, 256, 20240
MAX_SOURCES = 10_000  # the target list goes to every task; a longer one is refused
_BORDER = re.compile(r"(?<=\S)(?=\s)")
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # odd multipliers of the permutation's rounds


def source_form(source: Column) -> Column:
    """A source name without case, blanks and signs; spellings that differ only there are one source. Null stays null."""
    form = F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "")
    return F.when(form != "", form)


def token_counts(text: Column, path: str | None = None) -> Column:
    """Tokens of ``text`` by a public subword tokenizer (tiktoken ranks under ``path``); null and empty texts have none."""
    file = path or f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        # Fixed value: the tokenizer's pattern of words before byte pairs are merged.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        with open(file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield texts.map(lambda x: sum(len(coder.encode_ordinary(part)) for part in stretches(x)) if x else 0)

    return count(text)


def stretches(text: str, size: int = 100_000) -> Iterator[str]:
    """``text`` in stretches of ``size`` characters or more, cut only before blanks that follow a word, where no word of the tokenizer goes on."""
    start = 0
    while start < len(text):
        border = _BORDER.search(text, start + size)
        stop = border.start() if border else len(text)
        yield text[start:stop]
        start = stop


def running_total(df: DataFrame, group: str, spread: Column, order: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of ``group`` before each row, in the order of bucket, ``order``.

    ``spread`` is a hash that deals a group into ``buckets``: sums of buckets are added up first, which are few rows
    whatever the data, then rows within their bucket; no task ever sees a whole group.
    """
    dealt = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    sums = dealt.groupBy(group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(group, "_bucket", before.alias("_before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inside", inside).join(offsets, [group, "_bucket"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of ``range(size)`` for each key: a Feistel network, walked until it lands inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(rounds):
            f = (right + k * np.uint64(MIX[0]) + np.uint64((r + 1) * MIX[1] % 2**64)) * np.uint64(MIX[2])
            f ^= f >> np.uint64(31)
            f = f * np.uint64(MIX[1])
            left, right = right, left ^ (f >> np.uint64(17) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


class Mixture:
    """The parts of one mixture; see ``mixture``."""

    def __init__(self, documents: DataFrame, slots: DataFrame, report: DataFrame, chosen: DataFrame) -> None:
        self.documents, self.slots, self.report, self.chosen = documents, slots, report, chosen


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mixture:
    """Combines ``docs`` so that each source of ``targets`` (source, weight, max_repeats) holds its weight in tokens.

    Documents of a source, in a pseudorandom order, are packed into blocks of ``block`` tokens. The output has as many
    tokens as all documents of listed sources; its shards of ``shard_slots`` blocks each draw multinomial counts of
    sources, a source's k-th slot takes the block that its permutation of the ``k // blocks``-th pass puts there. Passes
    beyond ``max_repeats`` are left empty, so no document comes more often than that.

    ``report``: per source tokens, drawn and placed blocks, weight, the share
    reached of the tokens placed and of those wanted, and whether it is short, that is,
    ``max_repeats`` times its tokens are less than its weight of all tokens. ``chosen``: key, source, the most times a block of it
    is used, tokens used, its tokens, and tokens used over its tokens. Sources with other spellings are one; documents of null or unlisted sources, null and empty texts take no
    part; a source without documents is reported with none. Weights need not add up to 1.
    """
    spark = docs.sparkSession
    wanted = targets.select(F.col("source").alias("source"), source_form(F.col("source")).alias("form"), F.col("weight").cast("double"), F.col("max_repeats").cast("long")).where("form is not null")
    listed = wanted.orderBy("form", "source").limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    forms = [r["form"] for r in listed]
    if len(set(forms)) < len(forms):
        raise ValueError("target sources that are spellings of one another")
    few = spark.createDataFrame([(i, r["source"], r["form"], r["weight"] or 0.0, r["max_repeats"] or 0) for i, r in enumerate(listed)], "source_no int, source string, form string, weight double, max_repeats long")
    sized = docs.select(F.col(key).alias("key"), source_form(F.col(source)).alias("form"), F.col(text).alias("text")).join(F.broadcast(few.select("form", "source_no")), "form")
    tokens = saved(sized.select("key", "source_no", token_counts(F.col("text")).alias("n_tokens")).where("n_tokens > 0"), "mix-tokens")

    buckets = 4 * shuffle_partitions(spark)
    # the totals are as many rows as there are target sources
    total = {r["source_no"]: r["n"] for r in tokens.groupBy("source_no").agg(F.sum("n_tokens").alias("n")).collect()}
    everything = sum(total.values())
    weights = np.array([r["weight"] or 0.0 for r in listed])
    shares = weights / weights.sum() if weights.sum() > 0 else weights
    blocks = {i: -(-total.get(i, 0) // block) for i in range(len(listed))}
    slots_wanted = max(1, everything // block) if everything and weights.sum() > 0 else 0  # whole blocks, or one that is not full
    n_shards = -(-slots_wanted // shard_slots)

    order = F.xxhash64("key", F.lit(seed))
    placed = running_total(tokens.withColumn("_h", order), "source_no", F.col("_h"), ["_h", "key"], "n_tokens", "start", buckets)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block)
    parts = placed.withColumn("block", F.explode(F.sequence(first, last)))
    inside = F.least(F.col("start") + F.col("n_tokens"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    parts = parts.select("key", "source_no", "block", inside.alias("tokens"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for shard in batch["id"]:
                n = min(shard_slots, slots_wanted - shard * shard_slots)
                counts = np.random.default_rng([seed, shard]).multinomial(n, shares)
                rows += [(shard, i, int(c)) for i, c in enumerate(counts) if c]
            yield pd.DataFrame(rows, columns=["shard", "source_no", "n"])

    drawn = spark.range(0, max(0, n_shards), 1, max(1, min(n_shards, shuffle_partitions(spark)))).mapInPandas(draw, "shard long, source_no int, n long")
    drawn = running_total(drawn, "source_no", F.xxhash64("shard"), ["shard"], "n", "first", buckets)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caps = np.array([r["max_repeats"] or 0 for r in listed])
        sizes = np.array([blocks[i] for i in range(len(listed))])
        for batch in batches:
            if not len(batch):
                continue
            n = batch["n"].to_numpy()
            at = np.repeat(np.arange(len(batch)), n)
            k = batch["first"].to_numpy()[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            s = batch["source_no"].to_numpy()[at]
            size = np.maximum(sizes[s], 1)
            turn = k // size
            ok = (turn < caps[s]) & (sizes[s] > 0)
            index = permuted(k % size, size, (turn + 1) * 1_000_003 + s + seed)
            yield pd.DataFrame({"shard": batch["shard"].to_numpy()[at], "source_no": s, "slot": k, "block": np.where(ok, index, -1), "turn": turn})

    slots = drawn.select("shard", "source_no", "n", "first").mapInPandas(assign, "shard long, source_no int, slot long, block long, turn long")
    filled = slots.where("block >= 0").groupBy("source_no", "block").agg(F.count("*").alias("times"))
    used = parts.join(filled, ["source_no", "block"])
    chosen = used.groupBy("key", "source_no").agg(F.max("times").alias("times"), F.sum(F.col("tokens") * F.col("times")).alias("tokens_used"))
    chosen = chosen.join(tokens, ["key", "source_no"]).join(F.broadcast(few.select("source_no", "source")), "source_no")
    chosen = saved(chosen.select(F.col("key").alias(key), "source", "times", "tokens_used", "n_tokens", F.round(F.col("tokens_used") / F.col("n_tokens"), 6).alias("repeats")), "mix-chosen")

    got = chosen.groupBy("source").agg(F.sum("tokens_used").alias("tokens_used"), F.max("times").alias("most_times"))
    counts = slots.groupBy("source_no").agg(F.count("*").alias("slots_drawn"), F.count_if(F.col("block") >= 0).alias("slots_filled"))
    sizes = tokens.groupBy("source_no").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    rows = few.join(sizes, "source_no", "left").join(counts, "source_no", "left").join(got, "source", "left")
    rows = rows.select("source", "weight", "max_repeats", *(zero(c) for c in ("documents", "tokens", "slots_drawn", "slots_filled", "tokens_used", "most_times")))
    all_used = F.sum("tokens_used").over(Window.partitionBy())
    shares_got = rows.withColumn("share", F.when(all_used > 0, F.col("tokens_used") / all_used).otherwise(0.0)).withColumn("share_of_wanted", F.col("tokens_used") / F.lit(max(1, everything)))
    # a source is short if its draws use up its blocks, give or take six deviations and the blocks that are not full; tokens then decide
    spent = F.col("slots_drawn") + 6 * F.sqrt(F.col("slots_drawn") + 1.0) + F.col("max_repeats") + 1 >= F.col("max_repeats") * F.ceil(F.col("tokens") / block)
    report = shares_got.withColumn("short", spent & (F.col("max_repeats") * F.col("tokens") < F.col("weight") * F.lit(everything)))
    return Mixture(tokens, slots, report, chosen)
