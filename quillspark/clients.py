"""Pluggable models and their offline stand-ins; nothing here calls the network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillspark.functions import fixed

_RUNS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in fixed.CJK_RANGES) + "]+|[A-Za-z0-9]+")


class Embedder(Protocol):
    batch: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Scorer(Protocol):
    """A reranking model: scores of some of the documents, each with its place among those asked for."""

    model: str

    def score(self, query: str, documents: list[str]) -> list[tuple[int, float]]: ...


class OverlapScorer:
    """The share of a query's distinct terms that a text holds, as ``plans.retrieval.lexical_overlap`` has it."""

    model = "overlap"

    def score(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        asked = set(text_terms(query))
        return [(i, round(len(asked & set(text_terms(d))) / len(asked), 9) if asked else 0.0) for i, d in enumerate(documents)]


def text_terms(text: str) -> list[str]:
    """``functions.exprs.terms`` of one text, outside of Spark."""
    out = []
    for run in _RUNS.findall(text):
        out += [run.lower()] if run.isascii() else [run[i : i + k] for k in fixed.GRAMS for i in range(len(run) - k + 1)]
    return out


def aligned(scores: list[tuple[int, float]], n: int) -> list[float]:
    """Scores in the order of the documents; 0 for one that the model left out, an error for a place out of range."""
    out = [0.0] * n
    for i, score in scores:
        if not 0 <= i < n:
            raise ValueError(f"a score for document {i} of {n}")
        out[i] = float(score)
    return out


class HashEmbedder:
    """A deterministic vector for each text, for tests."""

    def __init__(self, dims: int = 64, batch: int = 10) -> None:
        self.dims, self.batch = dims, batch

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[b / 127.5 - 1 for b in hashlib.shake_256(t.encode()).digest(self.dims)] for t in texts]


def embed_column(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """``df`` with a vector for each text, computed in the tasks in batches of the model's size; null stays null."""
    schema = T.StructType([*df.drop(out).schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wanted = [i for i, t in enumerate(batch[text]) if t is not None]
            vectors: list = [None] * len(batch)
            for k in range(0, len(wanted), embedder.batch):
                part = wanted[k : k + embedder.batch]
                got = embedder.embed([batch[text].iloc[i] for i in part])
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(got)} vectors")
                for i, v in zip(part, got):
                    vectors[i] = v
            yield batch.drop(columns=[out], errors="ignore").assign(**{out: vectors})

    return df.drop(out).mapInPandas(run, schema)
