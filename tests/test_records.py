import json

import pytest
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.clients import HashEmbedder, embed_column
from quillspark.operators import answers, evaluate, rerank, rewrite, usage
from quillspark.plans import record_queries
from quillspark.sources import relations as rel
from tests.conftest import rows


def entities(spark):
    return spark.createDataFrame([("e1", "person", "岚梅", ["阿岚", "岚梅·朵卡", " ", None, "阿岚"]), ("e2", None, "Rana", None)], "id string, entity_type string, canonical string, aliases array<string>")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "q int, t string")


def test_short_alias_has_three_rewrites(spark):
    got = rewrite.rewrites(asked(spark, "阿岚去了哪里"), "q", "t", entities(spark)).orderBy("rewrite_no").collect()
    assert [r["rewrite"] for r in got] == ["岚梅去了哪里", "阿岚 岚梅 去了哪里", "岚梅·朵卡去了哪里"]


def test_canonical_name_has_no_rewrite_but_a_longer_alias_has(spark):
    assert rewrite.rewrites(asked(spark, "岚梅去了哪里"), "q", "t", entities(spark)).count() == 0
    got = rewrite.rewrites(asked(spark, "岚梅·朵卡去了哪里"), "q", "t", entities(spark)).collect()
    assert "岚梅去了哪里" in [r["rewrite"] for r in got]


def test_merge_orders_by_hits_then_score(spark):
    lists = spark.createDataFrame([(1, "a", 0, 1, 0.9), (1, "b", 0, 2, 0.5), (1, "b", 1, 1, 0.6), (1, "c", 1, 2, 0.95)], "q int, k string, l int, r int, s double")
    assert [r["k"] for r in rewrite.merge_lists(lists, "q", "k", "l", "r", "s").orderBy("out_rank").collect()] == ["b", "c", "a"]


def test_judgements(spark):
    body = json.dumps({"answerable": "True", "missing_info": [" a ", "a", "", "b"], "clarification_questions": ["x"] * 2 + ["y", "z", "w"]})
    rows = spark.createDataFrame([(0, body), (1, f"```json\n{body}\n```"), (2, f"ok {body} !"), (3, "nothing"), (4, "[1]"), (5, None), (6, '{"answerable": 1}')], "i int, t string")
    got = [r["j"] for r in rows.select("i", answers.judgement(F.col("t")).alias("j")).orderBy("i").collect()]
    for j in got[:3]:
        assert j["answerable"] is True and j["missing_info"] == ["a", "b"] and j["clarification_questions"] == ["x", "y", "z"]
    assert got[3] is None and got[4] is None and got[5] is None and got[6]["answerable"] is False


def test_metrics_of_three_results(spark):
    rows = spark.createDataFrame([(1, 1, 1, "x"), (2, 2, 1, "x"), (3, None, None, "y")], "eval_id int, gold_rank int, candidate_rank int, book string")
    m = evaluate.metrics(evaluate.scored(rows)).first()
    assert (m["recall_at_1"], m["recall_at_3"], m["mrr"], m["avg_gold_rank"], m["missed"]) == (0.333333, 0.666667, 0.5, 1.5, 1)
    assert evaluate.metrics(evaluate.scored(rows), "book").count() == 3
    none = evaluate.metrics(evaluate.scored(rows.limit(0))).first()
    assert none["n"] == 0 and none["mrr"] == 0.0 and none["avg_gold_rank"] is None


def test_samples_are_exact(spark):
    rows = spark.createDataFrame([(f"{b}-{i}", b) for b in "xy" for i in range(30)], "id string, book string")
    assert evaluate.sample_exact(rows, "id", 7).count() == 7
    got = evaluate.sample_stratified(rows, "id", "book", {"x": 25, "y": 5}).groupBy("book").count().collect()
    assert {r["book"]: r["count"] for r in got} == {"x": 25, "y": 5}
    with pytest.raises(ValueError, match="z has 0"):
        evaluate.sample_stratified(rows, "id", "book", {"z": 1})


def test_failures_are_of_every_reason(spark):
    rows = [(i, None, f"g{i}", "candidate_miss") for i in range(8)] + [(8, None, "g8", "rerank_lost"), (9, None, "g9", "book_cap_filtered"), (10, 1, "g10", None)]
    df = spark.createDataFrame(rows, "eval_id int, gold_rank int, gold_chunk_id string, failure_reason string")
    got = [r["eval_id"] for r in evaluate.representative_failures(df, "eval_id").collect()]
    assert sorted(got) == [0, 1, 2, 8, 9]


def test_usage(spark):
    rows = [(i, "v", f"2020-01-01 00:00:0{i}", 0) for i in range(7)] + [(8, "v", "2020-01-01 00:00:09", 1), (0, "v", "2020-01-01 00:00:00", 0)]
    log = spark.createDataFrame(rows, "id long, visitor_id string, c string, used_custom_api_key int").withColumn("created_at", F.to_timestamp("c")).withColumn("loaded_at", F.col("created_at"))
    r = usage.daily_usage(usage.once(log)).first()
    assert (r["asked"], r["used_count"], r["remaining"]) == (7, 5, 0)


def test_chunk_index_round_trip_and_errors(spark, tmp_path):
    good = {"id": "a-1", "book_name": "a", "chunk_index": 1, "start": 0, "end": 1, "text": "x"}
    (tmp_path / "ok.jsonl").write_text(json.dumps(good) + "\n\n")
    r = rel.read_chunks(spark, str(tmp_path / "ok.jsonl")).first()
    assert (r["scene_id"], r["chapter_index"], r["chapter_title"]) == ("scene-000", 0, None)
    (tmp_path / "bad.jsonl").write_text(json.dumps(good) + "\n{broken\n")
    with pytest.raises(Exception, match="bad line"):
        rel.read_chunks(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "less.jsonl").write_text(json.dumps({k: v for k, v in good.items() if k != "text"}) + "\n")
    with pytest.raises(Exception, match="without text"):
        rel.read_chunks(spark, str(tmp_path / "less.jsonl")).collect()
    out = str(tmp_path / "index")
    chunks = rel.read_chunks(spark, str(tmp_path / "ok.jsonl"))
    rel.write_chunks(chunks, out)
    rel.write_chunks(chunks, out)
    assert rel.read_chunks(spark, out, "parquet").count() == 1


def test_entities_and_caches(spark, tmp_path):
    assert rel.read_entities(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "e.json").write_text(json.dumps([{"id": "1", "type": "person", "canonical": " A ", "aliases": ["b"]}]))
    assert rel.read_entities(spark, str(tmp_path / "e.json")).first()["canonical"] == "A"
    (tmp_path / "c.json").write_text('{"key": "k", "score": 0.5}\nbroken\n{"key": null, "score": 1}\n')
    cache = rel.read_cache(spark, str(tmp_path / "c.json"), "score double")
    hit, miss = rel.split_by_cache(spark.createDataFrame([("k",), ("z",)], "key string"), cache)
    assert [r["score"] for r in hit.collect()] == [0.5] and [r["key"] for r in miss.collect()] == ["z"]


def test_texts_and_embeddings(spark, tmp_path):
    (tmp_path / "一书.txt").write_text("a\nb")
    r = rel.read_texts(spark, str(tmp_path)).first()
    assert r["text"] == "a\nb"
    got = embed_column(spark.createDataFrame([("x",), (None,)], "text string"), "text", HashEmbedder(4)).collect()
    assert sorted(len(r["embedding"] or []) for r in got) == [0, 4]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_every_query_gives_what_its_sql_gives(spark, sf, sql, name):
    got = catalog.QUERIES[name](spark, sf)
    found = [tuple(r) for r in got.collect()]
    assert name in catalog.ORACLE, "every query has SQL"
    columns, wanted = sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, found) == rows(columns, wanted)


def test_load_order_is_that_of_files_and_lines(spark, tmp_path):
    n = 0
    for f in range(3):
        lines = []
        for i in range([400, 3, 50][f]):
            lines.append(json.dumps({"id": f"a-{n}", "book_name": "a", "chunk_index": n, "start": 0, "end": 1, "text": "x" * 50}))
            n += 1
        (tmp_path / f"part-{f}.json").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = rel.read_chunks(spark, str(tmp_path)).select("ord", "chunk_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == n and all(r["ord"] == r["chunk_index"] for r in got)


def test_book_names(spark, tmp_path):
    assert rel.resolve_book_names(["a", "b"]) == {"a": "a", "b": "b"} and rel.resolve_book_names(["a"], [" x "]) == {"a": "x"}
    for names in (["x"], ["x", " "], ["x", "x"]):
        with pytest.raises(rel.SourceError):
            rel.resolve_book_names(["a", "b"], names)
    (tmp_path / "一 书%.txt").write_text("a\n\nb")
    assert rel.read_texts(spark, str(tmp_path)).first()["book_name"] == "一 书%"
    assert rel.read_texts(spark, str(tmp_path), ["二"]).first()["book_name"] == "二"
    counts = rel.write_texts(rel.read_texts(spark, str(tmp_path)), str(tmp_path / "out")).first()
    assert (counts["paragraphs"], counts["chars"]) == (2, 4)
    with pytest.raises(rel.SourceError):
        rel.write_texts(spark.createDataFrame([("a", " ")], "book_name string, text string"), str(tmp_path / "none"))


class HalfScorer:
    model = "half"

    def score(self, query, documents):
        return [(i, 0.5) for i in range(0, len(documents), 2)]


class WildScorer:
    model = "wild"

    def score(self, query, documents):
        return [(len(documents), 1.0)]


def test_scores_are_aligned_and_cached(spark, tmp_path):
    pairs = spark.createDataFrame([(q, f"c{i}", "x", i, f"t{i}") for q in (1, 2) for i in range(3)], "eval_id long, id string, question string, cand_rank int, text string")
    none = spark.createDataFrame([], "key string, score double")
    every, grown, stats = rerank.cached_scores(pairs, none, HalfScorer())
    assert {(r["id"], r["rerank_score"]) for r in every.collect()} == {("c0", 0.5), ("c1", 0.0), ("c2", 0.5)}
    assert tuple(stats.first()) == (0, 6, 2) and grown.count() == 3  # both queries ask the same
    rel.write_cache(grown, str(tmp_path / "cache"))
    assert tuple(rerank.cached_scores(pairs, rel.read_cache(spark, str(tmp_path / "cache"), "score double"), HalfScorer())[2].first()) == (6, 0, 0)
    with pytest.raises(Exception, match="a score for document"):
        rerank.model_scores(pairs, WildScorer(), "eval_id", "question", "cand_rank", "text").collect()


def test_stand_in_scores_as_the_plan_does(spark):
    from quillspark.clients import OverlapScorer, text_terms
    from quillspark.functions.exprs import terms

    texts = ["海边的灯塔 Old 12", "", "a", "海", "𠀀𠀁𠀂x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(terms(F.col("t"))).collect()] == [text_terms(t) for t in texts]
    assert OverlapScorer().score("灯塔", ["海边的灯塔", ""]) == [(0, 1.0), (1, 0.0)]


def test_the_whole_evaluation(spark, sf, tmp_path):
    from quillspark.plans.record_queries import run_evaluation

    got = run_evaluation(spark, sf, str(tmp_path / "run"))
    overall = got.where("book is null").first()
    back = spark.read.json(str(tmp_path / "run" / "results"))
    assert overall["n"] == back.count() > 0 and back.where("gold_rank is null").count() == overall["missed"]
    assert spark.read.json(str(tmp_path / "run" / "metrics")).count() == got.count()


def test_late_rows_and_days_in_utc(spark, tmp_path):
    from quillspark.streaming import usage as stream

    log = [(1, "v", "2020-01-01 23:30:00", 0), (2, "v", "2020-01-20 12:00:00", 0)]
    late = [(3, "v", "2020-01-01 10:00:00", 0), (4, "v", "2020-01-19 10:00:00", 0)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    between = [(5, "v", "2020-01-20 13:00:00", 0), (5, "v", "2020-01-20 13:00:00", 0)]  # a batch later the watermark holds
    for k, part in enumerate((log, between, late)):
        df = spark.createDataFrame(part, "id long, visitor_id string, c string, used_custom_api_key int").withColumn("created_at", F.to_timestamp("c")).drop("c")
        df.coalesce(1).write.parquet(str(tmp_path / "log" / f"part={k}"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "log" / "part=0")).schema).option("maxFilesPerTrigger", 1)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = stream.run_once(stream.daily_counts(source.parquet(str(tmp_path / "log" / "part=*"))), "late-" + tmp_path.name).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    counts = {(str(r["usage_date"]), r["asked"]) for r in got}
    assert {("2020-01-01", 1), ("2020-01-20", 2), ("2020-01-19", 1)} == counts  # the row of the first day came after it was closed


def test_texts_are_one_file_each_with_their_own_bytes(spark, tmp_path):
    """No folder for each, and what is written is what is read; a name that comes twice raises."""
    texts = {"一 书%": "a\n\nb\n", "x.y": "c\r\nd", "d1": "\ufeffé", "blank": "e\n\n"}
    made = spark.createDataFrame(list(texts.items()), "book_name string, text string")
    out = tmp_path / "out"
    for _ in range(2):
        assert {r["book_name"]: r["chars"] for r in rel.write_texts(made, str(out)).collect()} == {k: len(v) for k, v in texts.items()}
    assert {p.name for p in out.iterdir()} == {f"{k}.txt" for k in texts}
    assert {p.stem: p.read_bytes().decode() for p in out.iterdir()} == texts
    assert {r["book_name"]: r["text"] for r in rel.read_texts(spark, str(out)).collect()} == texts
    with pytest.raises(rel.SourceError, match="twice"):
        rel.write_texts(made.unionAll(made), str(out))


def test_texts_go_round_in_rounds_whose_files_go(spark, sf, sql, monkeypatch):
    from pathlib import Path

    from quillspark.session import scratch

    monkeypatch.setattr(record_queries, "TEXTS_A_ROUND", 30)
    folder, held = Path(scratch(spark).removeprefix("file:")), []
    read = record_queries.read_texts
    monkeypatch.setattr(record_queries, "read_texts", lambda s, path: held.append(len(list(Path(path.removeprefix("file:")).iterdir()))) or read(s, path))
    before = set(folder.glob("texts-*"))
    got = record_queries.texts_round_trip(spark, sf)
    columns, wanted = sql(catalog.ORACLE["texts_round_trip"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, wanted)
    assert len(held) == 4 and sum(held) == len(wanted) and max(held) < 60
    assert {p.name.split("-")[1] for p in set(folder.glob("texts-*")) - before} == {"read"}
