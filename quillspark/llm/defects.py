"""Problem 2: prompt and response pairs whose response is unusable."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.langs import Model, Scorer
from quillspark.llm.looks import canonical
from quillspark.llm.refusals import Refusals, form

# Letters of fillers that stand for "no value".
FILLERS = set(
    "na none null nil nan undefined empty blank missing novalue noanswer todo tbd 无 無 空 空白 暂无 暫無 未填 未填写 待补 待补充 待定 无答案 無答案 无内容 略 "
    "なし 無し 該当なし 未記入 未入力 없음 해당없음 미입력 내용없음 keine keineangabe leer aucun aucune néant vide ninguno ninguna vacío vacio nenhum nenhuma vazio".split()
)
# How a question asks for an answer in a language.
ASKED = {
    "en": r"[用以]英[语語文]|英語で|영어로|\bin english\b|\bauf englisch\b|\ben anglais\b|\ben inglés\b|\bem inglês\b",
    "zh": r"[用以][中汉漢][语語文]|中国語で|중국어로|\bin chinese\b|\bauf chinesisch\b|\ben chinois\b|\ben chino\b|\bem chinês\b",
    "ja": r"[用以]日[语語文本]|日本語で|일본어로|\bin japanese\b|\bauf japanisch\b|\ben japonais\b|\ben japonés\b|\bem japonês\b",
    "ko": r"[用以][韩韓][语語文国國]|韓国語で|한국어로|\bin korean\b|\bauf koreanisch\b|\ben coréen\b|\ben coreano\b|\bem coreano\b",
    "de": r"[用以]德[语語文]|ドイツ語で|독일어로|\bin german\b|\bauf deutsch\b|\ben allemand\b|\ben alemán\b|\bem alemão\b",
    "fr": r"[用以]法[语語文]|フランス語で|프랑스어로|\bin french\b|\bauf französisch\b|\ben français\b|\ben francés\b|\bem francês\b",
    "es": r"[用以]西班牙[语語文]|スペイン語で|스페인어로|\bin spanish\b|\bauf spanisch\b|\ben espagnol\b|\ben español\b|\bem espanhol\b",
    "pt": r"[用以]葡萄牙[语語文]|ポルトガル語で|포르투갈어로|\bin portuguese\b|\bauf portugiesisch\b|\ben portugais\b|\ben portugués\b|\bem português\b",
}
# Scripts of the languages; those not named are written in Latin letters.
SCRIPTS = {"zh": {"CJK"}, "ja": {"CJK", "HIRAGANA", "KATAKANA"}, "ko": {"HANGUL"}}
SURE, A_LETTER = 12, 2  # nats by which another language must lead: for the whole text, and for each letter of a short one
LEAST = 6
TERMINAL = "。.!?…！？｡؟"
CLOSERS = "”’」』»）)》】]\"'*_`〉"
OPEN_CLOSE = ("“”", "「」", "『』", "《》", "（）", "()", "【】", "«»", "[]")
SENTENCE_ENDS = "。.!?…\n"
# A phrase without full stop may be complete whatever its last word; a longer text is a sentence, and that has to end.
SHORT_PHRASE = 12  # letters; counts of words for scripts with blanks are below
SHORT_WORDS = 6
# Words that cannot end a phrase, of the languages with blanks, and endings of those without.
OPEN_WORDS = set(
    "the a an of to in on at by for with from into onto upon and or but that which whose his her its their my your our is was are were be been as if than because while when although between among under over through toward towards "
    "der die das den dem des ein eine einen einem einer eines und oder mit von zu zum zur im am an auf bei für nach über unter als dass weil wenn aber sein seine seinen ihr ihre ihren "
    "le la les un une des de du au aux et ou que qui dans sur avec pour par sans sous vers chez son sa ses leur leurs mon ma mes ce cette ces "
    "el los las una unos unas del al y o que en con por para sin sobre hacia desde su sus mi mis este esta "
    "o os as um uma uns umas do da dos das em no na nos nas e ou com por para sem sob sobre seu sua seus suas meu minha ao à".split()
)
OPEN_ENDS = ("把", "被", "和", "与", "跟", "向", "往", "而且", "但是", "并且", "或者", "因为", "所以", "如果", "虽然", "然后", "于是", "以及", "一个", "将", "を", "は", "それから", "そして", "를", "을", "그리고", "하지만")
_NOT_WORD = re.compile(r"[\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")


def _letters(form: str) -> str:
    return _NOT_WORD.sub("", form.lower())


def shingles(form: str, n: int = 3) -> set[str]:
    return {form[i : i + n] for i in range(len(form) - n + 1)} or ({form} if form else set())


def containment(a: set[str], b: set[str]) -> float:
    """The share of ``a`` that is in ``b``."""
    return len(a & b) / len(a) if a else 0.0


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: one step per character of ``b``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        x = row & at.get(c, 0)
        row = (row + x | row - x) & full
    return len(a) - row.bit_count()


def gives_back(asked: str, said: str, refusals: Refusals) -> bool:
    """Whether the response is the prompt and no more, but for a lead-in before it, whatever its words.

    Letters of both are aligned: all of the prompt is in the response, in order and in one stretch but for a twentieth,
    and nothing follows it. What stands before it is a lead-in if it is no sentence of its own, or says nothing but
    courtesies.
    """
    prompt, response = _letters(asked), _letters(said)
    if not prompt or not response:
        return False
    if prompt in response:
        head, _, tail = response.partition(prompt)
        if tail.replace(prompt, ""):
            return False
        if not head:
            return True
        at = _offset(said, len(head))
        before = said[:at]
        if asked[-1:] in "?" and not said.rstrip(CLOSERS + " ").endswith("?"):
            return False
        return not any(c in SENTENCE_ENDS for c in before) or all(refusals.courtesy(form(x)) for x in re.split(r"[。.!?\n]+", before) if x.strip())
    if len(response) < 0.9 * len(prompt):  # it cannot hold enough of the prompt
        return False
    a, b = shingles(prompt), shingles(response)
    if containment(a, b) < 0.95:
        return False
    rest = response[-len(prompt) - len(prompt) // 20 :]  # an altered copy ends the response, if there is one
    return containment(shingles(rest), a) >= 0.9 and common(prompt, rest) >= 0.95 * len(prompt) and (len(response) <= 1.1 * len(prompt) or said.rstrip(CLOSERS + " ").endswith("?") and not any(c in SENTENCE_ENDS for c in said[: _offset(said, len(response) - len(rest))]))


def _offset(text: str, n: int) -> int:
    """The offset behind which ``text`` has had ``n`` letters, and the signs after them."""
    k = 0
    for i, c in enumerate(text):
        if k == n and c.isalnum():
            return i
        k += len(_letters(c))
    return len(text)


def open_word(core: str) -> bool:
    """Whether a text ends in a word that cannot end a phrase: an article, a preposition, a conjunction, a particle."""
    last = re.search(r"[^\W_]+$", core)
    if not last:
        return False
    word = last.group()
    if word.lower() in OPEN_WORDS:
        return word.islower() and " " in core
    return len(core) > 1 and core.endswith(OPEN_ENDS)


def breaks_off(form: str) -> bool:
    """Whether a response ends before its sentence, quotation or list is finished."""
    text = form.rstrip()
    if re.search(r"(?:^|\n)\s*(?:\d{1,3}[.、)]|[-*•·])\s*$", text):
        return True
    for open_, close in OPEN_CLOSE:
        if text.count(open_) > text.count(close):
            return True
    if text.count('"') % 2:
        return True
    core = text.rstrip(CLOSERS)
    if text == core and open_word(core):
        return True
    if core and core[-1] in TERMINAL or text != core and core:
        return False
    if not core[-1:].isalnum() and core[-1:] not in "%℃°":
        return True
    if re.search(r"[。.!?…，,、:;；]\s|[。!?…，、；]|[,:;]\s*\S|\n", core):
        return True
    spaced = core.count(" ") + 1
    return spaced > SHORT_WORDS if core.isascii() or spaced > 3 else len(_letters(core)) > SHORT_PHRASE


def scripts(text: str) -> set[str]:
    """The scripts of the letters of a text, by the first words of their names."""
    return {x for c in set(text) if (x := _script(c))}


@functools.lru_cache(65_536)
def _script(c: str) -> str:
    name = unicodedata.name(c, "").split("-")[0].split(" ")[0] if c.isalpha() else ""
    return "CJK" if name == "IDEOGRAPHIC" else name


def is_sign(text: str) -> bool:
    """Whether a text has no word that belongs to a language: numbers with units, abbreviations."""
    words = re.findall(r"[^\W_]+", text)
    return not any(w.isalpha() and not (w.isascii() and (len(w) < 2 or w.isupper())) for w in words) or text.isascii() and any(c.isdigit() for c in text)


class Judge:
    """The one defect of a pair, or None; in this order: empty, refusal, echo, language, truncated."""

    def __init__(self, model: Model) -> None:
        self.refusals, self.scorer = Refusals(), Scorer(model)
        self.asked = {lang: re.compile(pattern, re.IGNORECASE) for lang, pattern in ASKED.items()}

    def other_language(self, asked: str, said: str, prompt_letters: str, letters: str, p: np.ndarray, r: np.ndarray) -> bool:
        """Whether the answer is in a language that the question neither has nor asks for.

        Another language must lead by a margin that grows with a short answer's letters; an answer without a letter
        of a script that the question's language has is in another one; ``p`` and ``r`` are the scores of both. Names from the question and signs are no language.
        """
        if not any(map(str.isalpha, letters)) or not any(map(str.isalpha, prompt_letters)):
            return False
        names = self.scorer.model.languages
        own, best = int(p.argmax()), int(r.argmax())
        if (own == best or r[best] - r[own] <= LEAST) and letters[0].isalpha() and _script(letters[0]) == _script(prompt_letters[0]):
            return False  # no other language leads, and a script is in both
        wanted = lambda x: x in self.asked and bool(self.asked[x].search(asked))
        if len(letters) >= 6 and len(prompt_letters) >= 4 and own != best and r[best] - r[own] > SURE:
            return not wanted(names[best])
        if letters in prompt_letters or is_sign(said):
            return False
        held, asking = scripts(letters), scripts(prompt_letters)
        for x, at in zip(names, p):
            if p[own] - at <= SURE and SCRIPTS.get(x, {"LATIN"}) & asking:
                asking = asking | SCRIPTS.get(x, {"LATIN"})
        need = max(LEAST, min(SURE, A_LETTER * len(letters)))
        other = not held & asking or own != best and r[best] - r[own] > need and p[own] - p[best] > LEAST
        return bool(other) and not any(wanted(x) for x in names if held <= SCRIPTS.get(x, {"LATIN"}))

    def defect(self, prompt: str | None, response: str | None) -> str | None:
        return self.defects([prompt], [response])[0]

    def defects(self, prompts: list[str | None], responses: list[str | None]) -> list[str | None]:
        """The defect of each pair; languages are scored for all pairs together."""
        asked = [canonical(p or "").strip() for p in prompts]
        said = [_TAG.sub(" ", canonical(r)).strip() if r is not None else "" for r in responses]
        scores = zip(self.scorer.totals(asked), self.scorer.totals(said))
        return [self._defect(a, s, p, r) for a, s, (p, r) in zip(asked, said, scores)]

    def _defect(self, asked: str, said: str, p: np.ndarray, r: np.ndarray) -> str | None:
        letters = _letters(said)
        if not letters or letters in FILLERS:
            return "empty"
        prompt_letters = _letters(asked)
        if self.refusals.found(said, asked):
            return "refusal"
        if gives_back(asked, said, self.refusals):
            return "echo"
        if self.other_language(asked, said, prompt_letters, letters, p, r):
            return "language"
        return "truncated" if breaks_off(said) else None


def defective_pairs(pairs: DataFrame, model: Model, key: str, prompt: str, response: str) -> DataFrame:
    """``key`` and ``defect`` of each pair whose response is unusable; a key that comes twice with one defect counts once.

    A null or blank response is empty; a null prompt can neither be given back nor differ in language. Of repeated keys
    with other texts every defect is given. The pairs are judged where they lie, only the flagged keys are shuffled.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = Judge(shared.value)
        for prompts, responses in batches:
            yield pd.Series(own.defects(prompts.to_list(), responses.to_list()), dtype=object)

    flagged = pairs.select(F.col(key).alias("key"), judge(F.col(prompt), F.col(response)).alias("defect"))
    return flagged.where("defect is not null").distinct()


