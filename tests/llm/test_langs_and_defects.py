import pytest
from pyspark.sql import functions as F

from quillspark.llm import defects, langs
from quillspark.session import table

TEXTS = {
    "en": "The keeper handed the old map to the captain and walked back to the harbour.",
    "de": "Der Wächter gab dem Kapitän die alte Karte und ging danach zum Hafen zurück.",
    "fr": "Le gardien remit la vieille carte au capitaine puis retourna près du port.",
    "es": "El guardián entregó el viejo mapa al capitán y luego volvió hacia el puerto.",
    "pt": "O guarda entregou o velho mapa ao capitão e depois voltou para o porto.",
    "zh": "守门人把旧地图交给船长，然后走回了港口，没有人再追问那件事。",
    "ja": "番人は古い地図を船長に渡して、それから港へ戻っていったそうです。",
    "ko": "문지기는 선장에게 낡은 지도를 건네주고 항구로 돌아갔다고 합니다.",
}


@pytest.fixture(scope="module")
def model(spark, sf):
    return langs.fit_on(table(spark, sf, "lang_samples"))


def test_held_out_accuracy(spark, sf):
    rows = [(r["lang"], r["text"]) for r in table(spark, sf, "lang_samples").collect()]
    train, test = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    scorer = langs.Scorer(langs.fit(sorted(train), langs.vocabulary()))
    right = [scorer.model.languages[int(scorer.sums(x)[-1].argmax())] == lang for lang, x in test]
    assert sum(right) / len(right) >= 0.97


def test_forward_sums_all_segmentations():
    lattice = langs.Lattice([chr(0xF0000 + b) for b in range(256)] + ["a", "b", "ab", "ba", "aba"])
    import numpy as np

    p = np.full((261, 1), 0.01)
    for piece, x in {"a": 0.3, "b": 0.2, "ab": 0.1, "ba": 0.05, "aba": 0.02}.items():
        p[lattice.id[piece]] = x
    want = 0.3 * 0.2 * 0.3 + 0.1 * 0.3 + 0.3 * 0.05 + 0.02
    assert abs(np.exp(lattice.forward("aba", np.log(p))[-1, 0]) - want) < 1e-12


def test_segments(spark, model):
    scorer = langs.Scorer(model)
    for lang, x in TEXTS.items():
        assert [s[2] for s in scorer.segments(x)] == [lang]
        assert [s[2] for s in scorer.segments(x.upper())] == [lang]
    mixed = TEXTS["zh"] + "\n" + TEXTS["de"] + " " + TEXTS["de"] + "\n" + TEXTS["zh"]
    got = scorer.segments(mixed)
    assert [s[2] for s in got] == ["zh", "de", "zh"] and mixed[got[1][0] : got[1][1]] == TEXTS["de"] + " " + TEXTS["de"]
    assert scorer.segments("") == [] and scorer.segments(" \n") == []
    df = spark.createDataFrame([(1, TEXTS["fr"]), (1, TEXTS["fr"]), (2, None), (3, "")], "doc_id long, text string")
    assert [r["detected"] for r in langs.language_segments(df, model, "doc_id", "text").collect()] == ["fr", "fr"]
    assert langs.document_languages(langs.language_segments(df.limit(0), model, "doc_id", "text"), "doc_id").count() == 0


def test_labels(spark):
    labels = {"zh_TW": "zh", "ZHO": "zh", "Chinese": "zh", " en-US ": "en", "Português": "pt", "jpn": "ja", "und": None, "??": None, "": None, "it": None, None: None}
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert {r["l"]: r["c"] for r in df.select("l", langs.named_language(F.col("l")).alias("c")).collect()} == labels


PAIRS = [
    ("夏在盐仓找到了什么？", None, "empty"), ("夏在盐仓找到了什么？", "（空）", "empty"), ("夏在盐仓找到了什么？", "……", "empty"), ("夏在盐仓找到了什么？", "<p></p>", "empty"), ("夏在盐仓找到了什么？", " N/A ", "empty"),
    ("夏在盐仓找到了什么？", "你好，根据现有片段，信息不足，无法判断。", "refusal"), ("Who came?", "Sorry, I can't help with that.", "refusal"), ("夏在盐仓找到了什么？", "Sorry, I can't help with that.", "refusal"),
    ("夏第一次见到梅是在哪里？", "夏无法确认来人是谁，于是守着灯笼等到天亮。", None), ("夏第一次见到梅是在哪里？", "对不起，这是梅留给夏的最后一句话，之后便去了盐仓。", None),
    ("夏在盐仓找到了什么？", "问题：夏在盐仓找到了什么？", "echo"), ("夏在盐仓找到了什么？", "“夏在盐仓找到了什么⁠？”", "echo"), ("夏在盐仓找到了什么？", "夏在盐仓找到了什么？夏在盐仓找到了旧地图。", None),
    ("Who gave the late miller's seal to Denniv?", "Corvath gave the late miller's seal to Denniv.", None),
    ("夏在盐仓找到了什么？", TEXTS["en"], "language"), ("请用英语回答：夏在盐仓找到了什么？", TEXTS["en"], None), ("What did he find there?", TEXTS["de"], "language"),
    ("夏在盐仓找到了什么？", "夏在盐仓找到了旧地图。后来他把", "truncated"), ("夏在盐仓找到了什么？", "夏在盐仓找到了旧地图，", "truncated"), ("夏在盐仓找到了什么？", "他说：“先救人要紧。", "truncated"), ("夏在盐仓找到了什么？", "1. 旧地图。\n2.", "truncated"),
    ("夏在盐仓找到了什么？", "沉甸甸的信匣", None), ("夏在盐仓找到了什么？", "六件", None), (None, "六件", None), ("", "", "empty"),
]


def test_defects(spark, model):
    rows = [(i, q, a) for i, (q, a, _) in enumerate(PAIRS)] + [(0, *PAIRS[0][:2])]
    got = {r["key"]: r["defect"] for r in defects.defective_pairs(spark.createDataFrame(rows, "id long, q string, a string"), model, "id", "q", "a").collect()}
    assert got == {i: d for i, (_, _, d) in enumerate(PAIRS) if d}


def test_longest_common_subsequence():
    assert defects.common("abcde", "xaybzc") == 3 and defects.common("", "a") == 0 and defects.common("a" * 100, "a" * 70) == 70


def test_no_pairs(spark, model):
    df = spark.createDataFrame([], "id long, q string, a string")
    assert defects.defective_pairs(df, model, "id", "q", "a").count() == 0


def test_refusals_anywhere_and_of_any_length():
    refusals, judged = defects.Refusals(), lambda q, a: refusals.found(defects.canonical(a), defects._letters(defects.canonical(q)))
    assert judged("Who came?", "Hello. Thanks for asking. I checked the passages. Sorry, I can't help with that.")
    assert judged("夏在盐仓找到了什么？", "你好。谢谢你的提问。我看过了给出的段落。根据现有片段，信息不足，无法判断。")
    question = "the keeper of the northern harbour who gave the captain of the third ship an old map of the salt stores, a sealed letter from the late miller, two lanterns without oil, a silver key for the hidden gate below the bridge and the promise of his brother"
    assert len(defects._letters(question)) > 180 and judged(f"What is said of {question}?", f"There is no mention of {question} in the provided excerpts, so I won't guess.")
    story = "夏在盐仓找到了旧地图和一只信匣，把它们带回了灯塔。梅追问地图的来历，两人沿着海岸走了整整一夜。天亮时守门人才开口。"
    assert not judged("夏在盐仓找到了什么？", story + "“我不知道。”他说。") and not judged("夏在盐仓找到了什么？", story + "梅也不清楚。")


def test_short_answers_in_another_language(model):
    judge = defects.Judge(model)
    for q, a in (("What did the keeper hand to the captain?", "一张旧地图"), ("夏在盐仓找到了什么？", "지도"), ("夏在盐仓找到了什么？", "map"), ("지도는 어디에 있었습니까?", "港口"), ("谁来了？", "선장"), ("Who?", "守门人")):
        assert judge.defect(q, a) == "language", (q, a)
    for q, a in (("夏在盐仓找到了什么？", "旧地图"), ("夏见到了 Mei 还是 Bob？", "Bob"), ("地图有多长？", "5 km"), ("信匣上写着什么？", "NASA"), ("请用英语回答：夏在盐仓找到了什么？", "map"), ("船長は何を受け取りましたか。", "地図"), ("Who came?", "Corva"), ("Wie viele?", "drei"), ("谁来了？", "船长"), ("How many?", "12")):
        assert judge.defect(q, a) is None, (q, a)
