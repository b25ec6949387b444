"""Problem 6: held-out passages inside training documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.looks import letters, letters_spans
from quillspark.session import saved_parts

RUN = 80
BLOCK_LETTERS = 20_000_000  # letters of items per automaton; more items are taken in several blocks


def anchors(items: list[tuple[int, str]], run: int) -> ahocorasick.Automaton:
    """Automaton over grams of ``(run+1)//2`` letters at every ``run - gram + 1``-th place: each run holds a whole one."""
    gram = (run + 1) // 2
    step = run - gram + 1
    found: dict[str, list[tuple[int, int]]] = {}
    for k, (_, form) in enumerate(items):
        for p in range(0, len(form) - gram + 1, step):
            found.setdefault(form[p : p + gram], []).append((k, p))
    tree = ahocorasick.Automaton()
    for word, places in found.items():
        tree.add_word(word, places)
    if found:
        tree.make_automaton()
    return tree


def _grown(a: str, i: int, b: str, j: int, n: int) -> tuple[int, int]:
    """How far the equal stretch ``a[i:i+n] == b[j:j+n]`` goes on to the left and to the right."""
    left = 0
    while i - left > 0 and j - left > 0 and a[i - left - 1] == b[j - left - 1]:
        left += 1
    right, most = n, min(len(a) - i, len(b) - j)
    while right < most and a[i + right] == b[j + right]:
        right += 1
    return left, right


def leaked_passages(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, run: int = RUN, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """One row per document and held-out item of which it holds ``run`` consecutive letters or digits.

    Texts are compared as they look, without case, blanks and punctuation. ``start`` and ``end`` bound the longest such
    stretch in the stored text, ``n_letters`` is its length. Items shorter than ``run`` letters, null and blank texts
    match nothing; repeated documents give a row each by key. The items are the stated query set: they go to the tasks in
    blocks of bounded size, each block with one automaton and one scan of the documents, which is written before the block
    after the next is fetched; the documents are not shuffled.
    """
    types = dict(docs.dtypes) | {"item": dict(items.dtypes)[item_key]}
    schema = f"`{key}` {types[key]}, `{item_key}` {types['item']}, `start` int, `end` int, n_letters int"
    rows = docs.select(key, text).where(F.col(text).isNotNull())

    def found(block: list[tuple[int, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = shared.value
            tree = anchors(own, run)
            gram = (run + 1) // 2
            for batch in batches:
                hits = []
                for name, x in zip(batch[key], batch[text]):
                    form = letters(x)
                    if len(form) < run or not len(tree):
                        continue
                    best: dict[int, tuple[int, int]] = {}
                    for last, places in tree.iter(form):
                        i = last - gram + 1
                        for k, p in places:
                            if k in best and best[k][0] <= i and last < sum(best[k]):
                                continue
                            left, right = _grown(form, i, own[k][1], p, gram)
                            if left + right >= run and (k not in best or left + right > best[k][1]):
                                best[k] = (i - left, left + right)
                    if best:
                        at = letters_spans(x)[1]
                        hits += [(name, own[k][0], at[i], at[i + n - 1] + 1, n) for k, (i, n) in sorted(best.items())]
                yield pd.DataFrame(hits, columns=[key, item_key, "start", "end", "n_letters"])

        return rows.mapInPandas(scan, schema)

    blocks = item_blocks(items, item_key, item_text, run, block_letters)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return found(first)
    return saved_parts(map(found, chain((first, second), blocks)), "leaks")


def item_blocks(items: DataFrame, key: str, text: str, run: int, block_letters: int) -> Iterator[list[tuple[int, str]]]:
    """Items with their letters in lists of at most ``block_letters`` letters or one item; a list or two are on the driver at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        form = letters(row[1])
        if len(form) < run:
            continue
        if block and size + len(form) > block_letters:
            yield block
            block, size = [], 0
        block.append((row[0], form))
        size += len(form)
    if block:
        yield block
