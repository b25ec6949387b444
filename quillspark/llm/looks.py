"""Problem 3: one form for strings that a reader cannot tell apart.

A mapping from characters and grapheme clusters to one canonical drawing is computed from Unicode
properties plus a short list of look-alikes, checked for conflicts, and compiled into one
longest-match pattern that rewrites a text in a single pass.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata as ud
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that are drawn as the Latin letter to their right.
CYRILLIC_AS_LATIN = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW аa сc ԁd еe һh іi јj ӏl оo рp ԛq ѕs ԝw хx уy"
ARMENIAN_AS_LATIN = "ՕO օo"
CHEROKEE_AS_LATIN = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ"
LISU_AS_LATIN = "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ"
KATAKANA_AS_HIRAGANA = "ヘへ ベべ ペぺ"
GREEK_AS_LATIN = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϳj"
# Dots and dashes of several blocks with one drawing; the first of each line stands for all.
SAME_SIGNS = ("·‧•∙⋅・ᐧ⸱･", "…⋯", "-‐‑", "–‒−", "—―─", "~〜∼", ":∶", "'ʼ’", "|∣", "/∕⁄")
# Radicals without a Unicode decomposition that are drawn as the ideograph to their right.
RADICAL_AS_IDEOGRAPH = "⺁厂 ⺇几 ⺌小 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺛旡 ⺝月 ⺟母 ⺠民 ⻁虎 ⻄西 ⻅见 ⻆角 ⻉贝 ⻋车 ⻑長 ⻒镸 ⻓长 ⻔门 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻡饣 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻬齐 ⻮齿 ⻯竜 ⻰龙 ⻲亀"
# Format characters with a drawing of their own (signs that stand before or around numbers).
DRAWN_FORMAT = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
JOINERS = "\u200c\u200d"
# Scripts in which joiners change the drawing of letters, and emoji, which they combine.
JOINED = "\u0620-\u065f\u066e-\u06d5\u0700-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u17d3\u1800-\u18af\ua840-\ua87f\ua8e0-\ua8ff\U0001e900-\U0001e95f"
EMOJI = "\u2190-\u21ff\u2300-\u23ff\u2600-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff"
TAGS = "\U000e0020-\U000e007f"  # after an emoji they say which flag is drawn
INVISIBLE_EXTRA = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u3164\uffa0"  # joiners and fillers outside the format category


def _points() -> Iterator[str]:
    """All characters but those of the large blocks of ideographs and syllables, which have no rule, and surrogates."""
    for low, high in ((0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)):
        yield from map(chr, range(low, high))


def _rule(c: str) -> str | None:
    """The canonical form of one character by Unicode property, or None where it stays as it is."""
    cat = ud.category(c)
    if c in DRAWN_FORMAT:
        return None
    if cat == "Cf" or c in INVISIBLE_EXTRA or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    if cat == "Zs" or c == "\t":
        return " "
    if c in "\u2028\u2029\u0085":
        return "\n"
    kind = ud.decomposition(c)
    if kind.startswith(("<wide>", "<narrow>")):
        return ud.normalize("NFKC", c)
    if kind.startswith("<compat>") and ("⺀" <= c <= "⿟" or "Ⅰ" <= c <= "ⅿ" or "ㄱ" <= c <= "ㆎ"):
        return ud.normalize("NFKC", c)
    if ud.normalize("NFC", c) != c:
        return ud.normalize("NFC", c)
    return None


def _put(table: dict[str, str], key: str, to: str) -> None:
    """Enters a rule; two rules for one key that differ are a conflict."""
    if table.setdefault(key, to) != to:
        raise ValueError(f"conflict: {key!r} becomes {table[key]!r} and {to!r}")


@functools.cache
def mapping() -> dict[str, str]:
    """Canonical form of every single character that has another one; raises if two rules conflict."""
    listed: dict[str, str] = {}
    for pair in f"{CYRILLIC_AS_LATIN} {GREEK_AS_LATIN} {ARMENIAN_AS_LATIN} {CHEROKEE_AS_LATIN} {LISU_AS_LATIN} {KATAKANA_AS_HIRAGANA} {RADICAL_AS_IDEOGRAPH}".split():
        _put(listed, pair[0], pair[1])
    for row in SAME_SIGNS:
        for c in row[1:]:
            _put(listed, c, row[0])
    table: dict[str, str] = {}
    for c in _points():
        parts, to = ud.normalize("NFD", c), _rule(c)
        if len(parts) > 1 and parts[0] in listed and c not in listed:  # precomposed over a look-alike base
            to = ud.normalize("NFC", listed[parts[0]] + parts[1:])
        elif to is not None:
            to = "".join(listed.get(x, x) for x in to)
        elif c in listed:
            to = listed[c]
        if to is not None and to != c:
            _put(table, c, to)
    check(table)
    return table


@functools.cache
def clusters() -> dict[str, str]:
    """Canonical form of every sequence of a base and marks that one character stands for, as decomposed in full.

    Raises if a sequence would have two forms. The form of its character and of any other spelling is the same.
    """
    single, table = mapping(), {}
    for c in _points():
        parts = ud.normalize("NFD", c)
        if len(parts) > 1:
            _put(table, parts, single.get(c, c))
    return table


@functools.cache
def _decomposed() -> dict[str, str]:
    return {c: parts for c in _points() if len(parts := ud.normalize("NFD", c)) > 1}


def check(table: dict[str, str]) -> None:
    """Every image must be final, plain ASCII must stay (but the tab), and no key may be both dropped and drawn."""
    for key, to in table.items():
        if any(table.get(c, c) != c for c in to):
            raise ValueError(f"conflict: {key!r} becomes {to!r}, which is mapped again")
        if key.isascii() and key != "\t":
            raise ValueError(f"conflict: {key!r} is plain ASCII")


def _char_class(chars: list[str]) -> str:
    points, out, i = sorted(map(ord, chars)), [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}" + (f"-\\U{points[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


@functools.cache
def _compiled() -> re.Pattern:
    """Longest match at each place: joiners and tags that show, Hangul letters, a base with its marks, a single character."""
    table = mapping()
    m, inv = _char_class(_marks()), _char_class([c for c, to in table.items() if to == ""])
    within = _char_class([c for c, to in table.items() if to == "" and c not in JOINERS])
    shown = f"(?<=[{JOINED}{m}])[{JOINERS}]+(?=[{JOINED}])|(?<=[{EMOJI}\ufe0f\U0001f3fb-\U0001f3ff])\u200d(?=[{EMOJI}])|(?<=\U0001f3f4)[{TAGS}]+"
    hangul = "[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?|[\uac00-\ud7a3][\u11a8-\u11c2]"
    cluster = f"[^{m}{inv}{JOINED}\\s][{inv}]*[{m}][{m}{inv}]*|[{JOINED}][{within}]*[{m}][{m}{within}]*"
    return re.compile(f"(?P<shown>{shown})|(?P<hangul>{hangul})|{cluster}|[{_char_class(list(table))}]")


def _rewritten(m: re.Match, memo: dict[str, str]) -> str:
    """What stands in the place of a match; clusters are looked up in the table, by their longest part that is there."""
    s = m.group()
    if m.lastgroup == "shown":
        return s
    if (to := memo.get(s)) is not None:
        return to
    if m.lastgroup == "hangul":
        first, rest = s[0], s[1:]
        if first < "\uac00":
            first, rest = chr(0xAC00 + ((ord(s[0]) - 0x1100) * 21 + ord(s[1]) - 0x1161) * 28), s[2:]
        if rest:
            first = chr(ord(first) + ord(rest) - 0x11A7) if (ord(first) - 0xAC00) % 28 == 0 else first + rest
        return first
    single, apart, table = mapping(), _decomposed(), clusters()
    drawn = "".join(single.get(c, c) for c in s)
    parts = [x for c in drawn for x in apart.get(c, c)]
    base, marks = "".join(c for c in parts if not ud.combining(c)), sorted((c for c in parts if ud.combining(c)), key=ud.combining)
    whole = base + "".join(marks)
    to = whole
    for n in range(len(whole), 1, -1):
        if whole[:n] in table:
            to = table[whole[:n]] + whole[n:]
            break
    to = "".join(single.get(c, c) for c in to)
    if len(memo) < 200_000:
        memo[s] = to
    return to


@functools.cache
def _memo() -> dict[str, str]:
    """Forms of matches: all single characters, and clusters that have been met."""
    return dict(mapping())


@functools.cache
def _plain() -> np.ndarray:
    """For each code point the one in its place, -1 where it is dropped, -2 where what stands beside it has to be looked at."""
    out = np.arange(sys.maxunicode + 1, dtype=np.int32)
    for c, to in mapping().items():
        out[ord(c)] = -1 if to == "" else ord(to) if len(to) == 1 else -2
    out[[ord(c) for c in (*_marks(), *JOINERS)]] = -2
    out[0xE0020:0xE0080] = -2
    out[0x1100:0x1113] = out[0x1161:0x1176] = out[0x11A8:0x11C3] = -2
    return out


@functools.cache
def _marks() -> list[str]:
    """Characters that belong to the one before them: combining marks and vowel signs that make one character with another."""
    later = {x for c in _points() for x in ud.normalize("NFD", c)[1:]}
    return sorted({c for c in _points() if ud.combining(c)} | later | {"ﾞ", "ﾟ"})


def canonical(text: str) -> str:
    """The one form of ``text``; texts that look the same have the same form. Idempotent."""
    if text.isascii():
        return text.replace("\t", " ")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    to = _plain()[codes]
    if to.min() >= -1:  # every cluster is one character with at most one in its place: a plain table does it
        return to[to >= 0].tobytes().decode("utf-32-le", "surrogatepass")
    memo = _memo()
    return _compiled().sub(lambda m: _rewritten(m, memo), text)


def canonical_spans(text: str) -> tuple[str, list[int]]:
    """The canonical form and, for each of its characters, the offset in ``text`` it came from."""
    memo = _memo()
    out, at, end = [], [], 0
    for m in _compiled().finditer(text):
        out.append(text[end : m.start()])
        at.extend(range(end, m.start()))
        to = _rewritten(m, memo)
        out.append(to)
        at.extend([m.start()] * len(to))
        end = m.end()
    out.append(text[end:])
    at.extend(range(end, len(text)))
    return "".join(out), at


_NOT_WORD = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """Letters and digits of ``text`` as they look, without case, blanks and punctuation."""
    return _NOT_WORD.sub("", canonical(text).lower())


@functools.cache
def _letter_table() -> np.ndarray:
    """For each code point the letter or digit it counts as, -1 where it counts as none, -2 where its text is looked at."""
    plain, out = _plain(), np.full(sys.maxunicode + 1, -1, np.int32)
    points = np.arange(sys.maxunicode + 1, dtype="<u4")
    points[0xD800:0xE000] = ord(" ")
    every = points.tobytes().decode("utf-32-le")
    for m in re.finditer(r"[^\W_]+", every):
        out[m.start() : m.end()] = range(m.start(), m.end())
    changed = [ord(c) for c in _points() if c.lower() != c]
    for p in {*changed, *np.flatnonzero(plain != np.arange(len(plain))).tolist()}:
        to = int(plain[p])
        form = chr(to).lower() if to >= 0 else ""
        kept = [c for c in form if c.isalnum()]
        out[p] = -2 if to == -2 or kept and len(form) > 1 else ord(kept[0]) if kept else -1
    return out


def letter_codes(text: str) -> np.ndarray:
    """The code points of ``letters(text)``."""
    to = _letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(to) and to.min() == -2:
        return np.frombuffer(letters(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    return to[to >= 0].view(np.uint32)


def letters_spans(text: str) -> tuple[str, list[int]]:
    """``letters(text)`` and the offset in ``text`` of each of its characters."""
    form, at = canonical_spans(text)
    out, pos = [], []
    for c, p in zip(form, at):
        for x in c.lower():
            if x.isalnum():
                out.append(x)
                pos.append(p)
    return "".join(out), pos


@F.pandas_udf(T.StringType())
def canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else canonical(x))


@F.pandas_udf(T.StructType([T.StructField("look", T.BinaryType()), T.StructField("raw", T.BinaryType())]))
def look_keys(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for x in texts:
            if x is None or not any(map(str.isalpha, form := canonical(x))):
                rows.append((None, None))
            else:
                rows.append((xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass")), xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass"))))
        yield pd.DataFrame(rows, columns=["look", "raw"])


def canonical_text(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of column ``text`` in column ``out`` (which replaces a column of that name).

    Null stays null, empty stays empty; rows are neither dropped nor merged. Work is one Arrow pass, no shuffle.
    """
    return df.withColumn(out, canonical_udf(F.col(text)))


def look_alikes(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """Pairs of keys with texts that look the same and are different strings: ``key_a < key_b``, each pair once.

    Null texts and texts without a letter take no part. A key may hold several texts. Keys with the same string are
    one class, so equal copies are never paired with each other: classes of a form are paired, then their members.
    """
    rows = df.select(key.alias("key"), look_keys(text).alias("k")).select("key", "k.look", "k.raw").where("look is not null and key is not null")
    members = rows.distinct()
    classes = members.select("look", "raw").distinct()
    many = classes.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    classes = classes.join(many, "look", "left_semi")
    pairs = classes.withColumnRenamed("raw", "raw_a").join(classes.withColumnRenamed("raw", "raw_b"), "look").where("raw_a < raw_b")
    a, b = (members.select("look", F.col("raw").alias(f"raw_{x}"), F.col("key").alias(f"key_{x}")) for x in "ab")
    pairs = pairs.join(a, ["look", "raw_a"]).join(b, ["look", "raw_b"]).where("key_a <> key_b")
    low, high = F.least("key_a", "key_b"), F.greatest("key_a", "key_b")
    return pairs.select(low.alias("key_a"), high.alias("key_b")).distinct()


def look_classes(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, look, raw``: of every text with a letter the digest of its form and of its own characters.

    Texts of one ``look`` and another ``raw`` look the same and differ; this is what ``look_alikes`` pairs, without the
    pairs. A key that holds a text twice has one row for it.
    """
    rows = df.select(key.alias("key"), look_keys(text).alias("k")).select("key", F.hex("k.look").alias("look"), F.hex("k.raw").alias("raw"))
    return rows.where("look is not null and key is not null").distinct()
