"""Column expressions; all of them stay in the JVM."""

from __future__ import annotations

import unicodedata as ud
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import fixed

CJK_CLASS = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in fixed.CJK_RANGES)
RUNS = rf"([{CJK_CLASS}]+|[A-Za-z0-9]+)"


def terms(text: Column) -> Column:
    """Search terms: grams of 2, 3 and 4 of each CJK run, each run of ASCII letters and digits in lower case.

    A CJK run of one character gives none; any other character separates. Null gives null, empty text an empty array.
    """

    def grams(run: Column) -> Column:
        n = F.length(run)
        def of(k: int) -> Column:
            at = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
            return F.when(n >= k, F.transform(at, lambda i: F.substring(run, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

        each = [of(k) for k in fixed.GRAMS]
        return F.when(run.rlike("^[A-Za-z0-9]"), F.array(F.lower(run))).otherwise(F.concat(*each))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RUNS), F.lit(1)), grams))


def term_count(text: Column) -> Column:
    """``size(terms(text))`` without building the terms."""

    def size(run: Column) -> Column:
        n = F.length(run)
        return F.when(run.rlike("^[A-Za-z0-9]"), 1).otherwise(reduce(lambda a, b: a + b, [F.greatest(n - (k - 1), F.lit(0)) for k in fixed.GRAMS]))

    return F.aggregate(F.transform(F.regexp_extract_all(text, F.lit(RUNS), F.lit(1)), size), F.lit(0), lambda a, x: a + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of double; 0 where either is empty or all zero, an error where lengths differ, null for null."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(value.when(norms == 0, 0.0).otherwise(dot(a, b) / norms))


def usable_vector(v: Column, dims: int) -> Column:
    """Whether ``v`` holds ``dims`` finite numbers."""
    return F.coalesce((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def normalized(score: Column, most: Column) -> Column:
    """``score / most``, or 0 where the maximum is not positive or null."""
    return F.when(most > 0, score / most).otherwise(0.0)


def preview(text: Column, limit: int = fixed.PREVIEW_CHARS) -> Column:
    """``text`` with blanks collapsed, cut after ``limit`` characters with three dots."""
    one = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit), F.lit("..."))).otherwise(one)


def book_from_id(key: Column, unknown: str = fixed.UNKNOWN_BOOK_EVAL) -> Column:
    """The part of a chunk id before its last hyphen; ``unknown`` where it has none or nothing before it."""
    book = F.regexp_extract(key, r"(?s)^(.*)-[^-]*$", 1)
    return F.when(F.instr(key, "-") == 0, F.lit(unknown)).when(book == "", F.lit(unknown)).otherwise(book)


def inline_blanks(text: Column) -> Column:
    """Every run of blanks, wide and non-breaking ones too, as one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def is_chapter_title(line: Column) -> Column:
    return line.rlike("(?Ud)" + fixed.CHAPTER_TITLE)


def is_credit_line(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(line, F.lit(p)) for p in fixed.CREDIT_PREFIXES])


def paragraph_form(text: Column) -> Column:
    """A paragraph as it is kept: blanks collapsed, a line of three or more stars as the separator, credit lines empty."""
    one = inline_blanks(text)
    return F.when(is_credit_line(one), "").when(one.rlike("(?U)" + fixed.STAR_LINE), fixed.SCENE_SEPARATOR).otherwise(one)


@cache
def _compatible(letters: str) -> tuple[str, str]:
    """Characters that are one of ``letters``, in any case, in another form of the same (NFKC), and these."""
    pairs = [(chr(c), to.upper()) for c in range(0x80, 0x30000) if (d := ud.decomposition(chr(c))) and len(to := ud.normalize("NFKC", chr(c))) == 1 and to.upper() in letters]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def is_toc_heading(text: Column) -> Column:
    """Whether a paragraph is the heading of a table of contents; letters count in whatever compatible form they are."""
    return F.upper(F.translate(inline_blanks(text), *_compatible("".join(fixed.TOC_HEADINGS)))).isin(*fixed.TOC_HEADINGS)


def utc_day(at: Column) -> Column:
    """The day of an instant in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(at) / 86_400_000_000).cast("int"))


def sentences(line: Column) -> Column:
    """``line`` cut after each of the sentence ends; no empty parts."""
    return F.filter(F.split(line, rf"(?<=[{fixed.SENTENCE_ENDS}])"), lambda s: s != "")


def paragraph_count(text: Column) -> Column:
    """Paragraphs (parts between empty lines) that are not blank."""
    return F.size(F.filter(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"(?U)\s+", "") != ""))


def natural_key(name: Column) -> Column:
    """A key in whose order numbers inside names count as numbers: digit runs padded, all in lower case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def insufficient(answer: Column) -> Column:
    """Whether an answer is blank or bears a mark of missing evidence."""
    marks = reduce(lambda a, b: a | b, [F.contains(answer, F.lit(m)) for m in fixed.INSUFFICIENT_MARKS])
    return F.coalesce((F.regexp_replace(answer, r"(?U)\s+", "") == "") | marks, F.lit(True))
