"""Problem 8: the language of documents and of stretches in another language.

A language is scored by a unigram model over the pieces of a fixed public vocabulary: the forward algorithm sums the
probabilities of all segmentations of a run into pieces (bytes for characters outside the vocabulary). Piece
probabilities are fitted by expectation maximisation on a bounded number of labelled samples.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import looks

TOKENIZERS = os.environ.get("QUILL_TOKENIZERS", "/opt/tokenizers")
MAX_SAMPLES_PER_LANGUAGE = 2000  # bound of the labelled sample that the model is fitted on
LEAST_CHARS = 40
SWITCH = 8.0  # nats that a change of language between two sentences costs
# Usual codes and names of the languages, lower case, without region.
LANGUAGE_NAMES = {
    "zh": "zh zho chi cmn chinese mandarin hans hant 中文 汉语 漢語 华语 華語 普通话 普通話 国语 國語 简体中文 繁體中文 zh_hans zh_hant chs cht",
    "ja": "ja jpn jp japanese 日本語 日语 日文 nihongo",
    "ko": "ko kor kr korean 한국어 韩语 韓語 hangul",
    "en": "en eng english 英语 英文",
    "de": "de deu ger german deutsch 德语",
    "fr": "fr fra fre french français francais 法语",
    "es": "es spa spanish español espanol castellano castilian 西班牙语",
    "pt": "pt por portuguese português portugues brazilian 葡萄牙语",
}
SENTENCE = re.compile(r"[^\n\r。！？!?…\.]*(?:[。！？!?…]+[”’」』»）)\"']*|\.+(?![^\s”’」』»）)\"'\]])[”’」』»）)\"']*|\.|[\n\r]+|$)")


def named_language(label: Column) -> Column:
    """The two-letter code a label states by any usual code or name, whatever the case or region; null where it states none of them."""
    form = F.lower(F.trim(label))
    base = F.regexp_extract(form, r"^([^-_ (]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in LANGUAGE_NAMES.items():
        out = F.when(form.isin(names.split()) | base.isin(names.split()), F.lit(code)).otherwise(out)
    return out


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of the public vocabulary; its 256 byte pieces come first, as one-character strings U+F0000 + byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or f"{TOKENIZERS}/piece_bpe_32k.model")
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i)]
    return [chr(0xF0000 + b) for b in range(256)] + [p for p in pieces if set(p) != {"▁"} or len(p) == 1]


def drawn(text: str) -> str:
    """``text`` in lower case with look-alike characters exchanged, character by character: offsets stay."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    to = looks._plain()[codes]
    same = np.where(to >= 0, to, codes).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    lower = same.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in same)


class Lattice:
    """Piece look-up and the forward and backward sums over all segmentations of a run."""

    def __init__(self, pieces: list[str]) -> None:
        self.id = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        inner = sorted({c for p in pieces if len(p) > 1 for c in p if c != "▁"})
        self.inner = set(inner)  # characters that may stand in a piece with others; any other is a run of its own
        self.runs = re.compile("[" + "".join(map(re.escape, inner)) + "]+")

    def edges(self, run: str) -> Iterator[list[tuple[int, tuple[int, ...]]]]:
        """For each end in ``run`` the starts and piece ids of the pieces that end there."""
        for end in range(1, len(run) + 1):
            here = [(s, (i,)) for s in range(max(0, end - self.longest), end) if (i := self.id.get(run[s:end])) is not None]
            if run[end - 1] not in self.id:
                here.append((end - 1, tuple(run[end - 1].encode("utf-8", "surrogatepass"))))
            yield here

    def forward(self, run: str, logp: np.ndarray) -> np.ndarray:
        """Log probabilities (positions + 1, languages) of all segmentations of each prefix of ``run``."""
        alpha = np.full((len(run) + 1, logp.shape[1]), -np.inf)
        alpha[0] = 0
        for end, here in enumerate(self.edges(run), 1):
            alpha[end] = np.logaddexp.reduce([alpha[s] + logp[list(ids)].sum(0) for s, ids in here], axis=0)
        return alpha

    def split(self, text: str) -> Iterator[tuple[int, str]]:
        """Runs with their offsets: maximal stretches of inner characters, with ▁ at a word's start, and single others."""
        end = 0
        for m in self.runs.finditer(text):
            for k in range(end, m.start()):
                yield k, text[k]
            yield m.start(), ("▁" if m.start() == 0 or text[m.start() - 1].isspace() else "") + m.group()
            end = m.end()
        for k in range(end, len(text)):
            yield k, text[k]


@dataclass
class Model:
    """Languages, pieces and the log probability of each piece in each language (pieces, languages)."""

    languages: list[str]
    pieces: list[str]
    logp: np.ndarray


def fit(samples: list[tuple[str, str]], pieces: list[str], rounds: int = 4, own: float = 0.9) -> Model:
    """Piece probabilities by expectation maximisation over (language, text); mixed with those of all languages together."""
    lattice = Lattice(pieces)
    languages = sorted({lang for lang, _ in samples})
    runs = [Counter() for _ in languages]
    for lang, text in samples:
        runs[languages.index(lang)].update(r for _, r in lattice.split(drawn(text)) if not r.isspace())
    edges = {r: list(lattice.edges(r)) for c in runs for r in c}
    p = np.full((len(pieces), len(languages)), 1.0)
    for i, piece in enumerate(pieces):  # longer pieces start likelier than the product of their characters
        p[i] = 4.0 ** len(piece)
    p /= p.sum(0)
    for _ in range(rounds):
        count = np.zeros_like(p)
        for k, own_runs in enumerate(runs):
            logp = np.log(np.maximum(p[:, k], 1e-300))
            for run, n in own_runs.items():
                e = edges[run]
                a = [0.0] + [-np.inf] * len(run)
                w = [[(s, ids, sum(logp[i] for i in ids)) for s, ids in here] for here in e]
                for end, here in enumerate(w, 1):
                    a[end] = np.logaddexp.reduce([a[s] + x for s, _, x in here]) if len(here) > 1 else a[here[0][0]] + here[0][2]
                b = [-np.inf] * len(run) + [0.0]
                for end in range(len(run), 0, -1):
                    for s, ids, x in w[end - 1]:
                        b[s] = np.logaddexp(b[s], b[end] + x)
                        share = n * np.exp(a[s] + x + b[end] - a[-1])
                        for i in ids:
                            count[i, k] += share
        p = (count + 1e-9) / (count + 1e-9).sum(0)
    share = (count + 0.02) / (count + 0.02).sum(0)
    mixed = own * share + (1 - own) * share.mean(1, keepdims=True)
    return Model(languages, pieces, np.log(mixed))


class Scorer:
    """Scores texts by a model; keeps the sums of runs met before, and those of single characters as a table."""

    def __init__(self, model: Model) -> None:
        self.model, self.lattice = model, Lattice(model.pieces)
        n = len(model.languages)
        self.rows = np.zeros((1024, n))  # row 0: not scored
        self.used = 1
        self.row_of_code = np.zeros(0x110000, np.int32)
        self.known: dict[str, np.ndarray] = {}

    def _char_row(self, code: int) -> int:
        c = chr(code)
        if c.isspace():
            return 0
        if self.used == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        i = self.lattice.id.get(c)
        self.rows[self.used] = self.model.logp[i] if i is not None else self.model.logp[list(c.encode("utf-8", "surrogatepass"))].sum(0)
        self.used += 1
        return self.used - 1

    def total(self, text: str) -> np.ndarray:
        """Log probability of the whole text in each language."""
        return self._each(text).sum(0)

    def totals(self, texts: list[str], letters: int = 200_000) -> np.ndarray:
        """``total`` of each text (texts, languages); texts are scored together, about ``letters`` characters at a time."""
        out, low = np.zeros((len(texts), len(self.model.languages))), 0
        while low < len(texts):
            high, n = low, 0
            while high < len(texts) and (high == low or n + len(texts[high]) < letters):
                n += len(texts[high])
                high += 1
            own = texts[low:high]
            each = self._each("".join(x + "\n" for x in own))  # a line end ends a run and is not scored
            starts = np.cumsum([0] + [len(x) + 1 for x in own[:-1]])
            out[low:high] = np.add.reduceat(each, starts, axis=0)
            low = high
        return out

    def sums(self, text: str) -> np.ndarray:
        """Cumulative log probability (characters + 1, languages); a run counts at its first character."""
        each = self._each(text)
        out = np.zeros((len(each) + 1, each.shape[1]))
        np.cumsum(each, axis=0, out=out[1:])
        return out

    def _each(self, text: str) -> np.ndarray:
        text = drawn(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = self.row_of_code[codes]
        if not rows.all():
            for code in np.unique(codes[rows == 0]):
                self.row_of_code[code] = -1 if chr(code) in self.lattice.inner else self._char_row(int(code)) or -1
            rows = self.row_of_code[codes]
        each = self.rows[np.maximum(rows, 0)]
        for m in self.lattice.runs.finditer(text):
            at = m.start()
            run = ("▁" if at == 0 or text[at - 1].isspace() else "") + m.group()
            if (got := self.known.get(run)) is None:
                got = self.lattice.forward(run, self.model.logp)[-1]
                if len(run) < 1000 and len(self.known) < 100_000:
                    self.known[run] = got
            each[at] = got
        return each

    def segments(self, text: str) -> list[tuple[int, int, str, float]]:
        """Stretches of whole sentences in one language: start, end, language, confidence.

        The most probable sequence of sentence languages is taken, where a change costs ``SWITCH`` nats. The confidence
        is the posterior of the language for a text of at most 40 characters with the stretch's mean log probability.
        """
        spans = []
        for m in SENTENCE.finditer(text):
            s = m.group()
            if s.strip():
                begin = m.start() + len(s) - len(s.lstrip())
                spans.append((begin, m.start() + len(s.rstrip())))
        if not spans:
            return []
        total = self.sums(text)
        score = np.array([total[b] - total[a] for a, b in spans])
        best, back = score[0], []
        for x in score[1:]:
            jump = int(best.argmax())
            change = best[jump] - SWITCH > best
            back.append(np.where(change, jump, np.arange(len(best))))
            best = np.where(change, best[jump] - SWITCH, best) + x
        k = int(best.argmax())
        path = [k]
        for step in reversed(back):
            path.append(k := int(step[k]))
        path.reverse()
        out, i = [], 0
        for j in range(1, len(spans) + 1):
            if j == len(spans) or path[j] != path[i]:
                a, b = spans[i][0], spans[j - 1][1]
                x = score[i:j].sum(0) * min(1.0, LEAST_CHARS / max(1, b - a))
                out.append((a, b, self.model.languages[path[i]], float(1 / np.exp(x - x[path[i]]).sum())))
                i = j
        return out


_FITTED: dict[tuple, Model] = {}  # models by their samples and vocabulary, as queries of one session share them


def fit_on(samples: DataFrame, lang: str = "lang", text: str = "text", vocabulary_path: str | None = None, per_language: int = MAX_SAMPLES_PER_LANGUAGE) -> Model:
    """Fits a model on at most ``per_language`` labelled samples of each language (those with the smallest hashes), once a session."""
    from pyspark.sql import Window

    rows = samples.select(named_language(F.col(lang)).alias("lang"), F.col(text).alias("text")).where("lang is not null and trim(text) <> ''")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    few = sorted((r["lang"], r["text"]) for r in rows.withColumn("n", rank).where(F.col("n") <= per_language).collect())
    key = (hash(tuple(few)), len(few), vocabulary_path)
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = fit(few, vocabulary(vocabulary_path))
    return _FITTED[key]


def language_segments(docs: DataFrame, model: Model, key: str, text: str, keep: str | None = None) -> DataFrame:
    """One row per stretch of whole sentences in one language: key, segment number, start, end, language, confidence.

    Null and blank texts give no row; equal texts give equal rows by key. ``keep`` names a column to carry along.
    No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary, whatever the documents
    kinds, kept = dict(docs.dtypes), [key] + [keep] * bool(keep)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = [(*own, n, *seg) for *own, x in zip(*(batch[c] for c in kept), batch[text]) for n, seg in enumerate(scorer.segments(x))]
            yield pd.DataFrame(rows, columns=[*kept, "segment", "start", "end", "detected", "confidence"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return docs.select(*kept, text).where(F.col(text).isNotNull()).mapInPandas(label, f"{schema}, segment int, `start` int, `end` int, detected string, confidence double")


def document_languages(segments: DataFrame, key: str) -> DataFrame:
    """The main language of each document: that of most characters, its share as measure of mixture, mean confidence."""
    size = F.col("end") - F.col("start")
    by = segments.groupBy(key, "detected").agg(F.sum(size).alias("n"), F.sum(size * F.col("confidence")).alias("c"))
    return by.groupBy(key).agg(
        F.max_by("detected", F.struct("n", "detected")).alias("detected"),
        (F.max("n") / F.greatest(F.sum("n"), F.lit(1))).alias("share"),
        (F.max_by("c", F.struct("n", "detected")) / F.greatest(F.max("n"), F.lit(1))).alias("confidence"),
        F.array_sort(F.collect_list("detected")).alias("languages"),
    )
