import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import pieces


def test_ornament_lines():
    for line in ["***", "* * *", "★ ★ ★", "◆", "═════", "～～～", "※※※", "-----", "□■□■"]:
        assert pieces.is_ornament(line), line
    for line in ["“……”", "……", "。。。", "「」", "", "  ", "—", "一", "1", "·", "‧‧‧", "​"]:
        assert not pieces.is_ornament(line), line


def test_range_maximum_equals_scanning():
    rng = random.Random(5)
    at = sorted(rng.sample(range(1000), 60))
    strength = [rng.randrange(4) for _ in at]
    index = pieces.StrongestCut(at, strength)
    for _ in range(500):
        low, high = sorted((rng.randrange(1000), rng.randrange(1000)))
        inside = [(s, a) for a, s in zip(at, strength) if low <= a <= high]
        assert index.between(low, high) == (max(inside)[1] if inside else None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["一二三四五。", "六七，八九", "\n", "\n\n", "★★★\n", "\n***\n", "x" * 30, "  "]), max_size=40), st.integers(5, 60), st.integers(0, 3))
def test_pieces_cover_scenes_within_the_limit(parts, limit, overlap):
    text = "".join(parts)
    got = pieces.cut(text, limit, overlap)
    covered = set()
    for n, scene, a, b in got:
        assert 0 <= b - a <= limit and scene <= a
        covered |= set(range(a, b))
    for k, (start, first, end) in enumerate(pieces.scenes(text)):
        own = [(a, b) for n, _, a, b in got if n == k]
        assert own and all(first <= a and b <= end for a, b in own)
        assert all(x in covered or text[x].isspace() for x in range(first, end))
        for (a, b), (c, d) in zip(own, own[1:]):
            assert c > a and d > b


def test_scene_starts():
    text = "一" * 990 + "\n★★★\n\n  二二\n◆\n***\n三"
    assert [s for s, _, _ in pieces.scenes(text)] == [0, 998, 1007]


def test_rows(spark):
    df = spark.createDataFrame([(1, "字" * 1001, "p"), (1, "字" * 1001, "p"), (2, "短", "q"), (3, None, "r"), (4, "", "s")], "id int, text string, part_name string")
    got = pieces.split_oversized(df).select("id", "part.*").collect()
    assert sorted((r["id"], r["start"], r["end"]) for r in got) == [(1, 0, 1000), (1, 0, 1000), (1, 1000, 1001), (1, 1000, 1001)]
    assert pieces.split_oversized(df.limit(0)).count() == 0


def test_scenes_come_from_the_strongest_boundaries():
    text = "\n".join(("他走了。" * 60 + ("\n★★★" if i % 3 else "")) for i in range(9))
    want = [s for s, _, _ in pieces.scenes(text)]
    got = pieces.cut(text, 200)
    assert sorted({p[1] for p in got}) == want and [p[0] for p in got] == sorted(p[0] for p in got)
    assert all(b - a <= 200 for _, _, a, b in got)
