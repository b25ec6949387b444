from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.functions.exprs import terms
from quillspark.operators import dense, fusion, sparse
from quillspark.plans import retrieval

ROWS = "ord long, book string, chunk_index int, scene_id string"


def place(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_dense_order_ties_and_zero_vectors(spark):
    rows = spark.createDataFrame([(3, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (4, [0.0, 0.0])], "ord long, v array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "q long, qv array<double>")
    got = dense.top_dense(q, rows, "q", "qv", "ord", "v", 3).orderBy("vec_rank").collect()
    assert [(r["q"], r["ord"], r["cos"]) for r in got] == [(7, 1, 1.0), (7, 2, 1.0), (7, 3, 0.0)]


def test_dense_of_nothing(spark):
    rows = spark.createDataFrame([], "ord long, v array<double>")
    q = spark.createDataFrame([], "q long, qv array<double>")
    assert dense.top_dense(q, rows, "q", "qv", "ord", "v", 3).count() == 0


def test_bm25_finds_the_only_text_with_the_term(spark):
    docs = spark.createDataFrame([(1, "海边的灯塔很高"), (2, "山里的屋子"), (3, None), (4, "")], "ord long, text string")
    q = spark.createDataFrame([(1, "灯塔"), (2, "没有这个"), (3, None)], "q long, t string")
    got = sparse.bm25(q, docs, "q", "t", "ord", "text").collect()
    assert [(r["q"], r["ord"]) for r in got] == [(1, 1)] and got[0]["bm25"] > 0


def test_repeated_query_terms_count_twice(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "ord long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "alpha alpha")], "q long, t string")
    got = {r["q"]: r["bm25"] for r in sparse.bm25(q, docs, "q", "t", "ord", "text").collect()}
    assert abs(got[2] - 2 * got[1]) < 1e-8


def test_cap_with_backfill_is_the_greedy_rule(spark):
    import random

    rng = random.Random(4)
    for trial in range(5):
        rows = [(1, f"b{rng.randrange(3)}", i) for i in range(1, 13)]
        cap, k = rng.choice([(1, 5), (2, 7), (3, 20)])
        taken, count = [], {}
        for _, b, i in rows:
            if count.get(b, 0) < cap and len(taken) < k:
                taken.append(i)
                count[b] = count.get(b, 0) + 1
        taken += [i for _, _, i in rows if i not in taken][: k - len(taken)]
        got = fusion.capped(spark.createDataFrame(rows, "q int, b string, r int"), "q", "b", "r", k, cap).orderBy("out_rank").collect()
        assert [r["r"] for r in got] == taken


def test_scene_expansion_takes_neighbours_then_the_scene(spark):
    rows = place(spark, [(i, "A", i, s) for i, s in enumerate("aabbc")])
    ranked = spark.createDataFrame([(1, 2, 1)], "q int, ord long, rank int")
    got = fusion.expand_scenes(ranked, rows, ["q"], "ord", top_k=3, vector_top_n=1, scenes=1).orderBy("out_rank").collect()
    assert [r["ord"] for r in got] == [0, 1, 2]


def test_scene_expansion_stays_in_the_book(spark):
    rows = place(spark, [(0, "A", 0, "s"), (1, "A", 1, "s"), (2, "B", 1, "s")])
    ranked = spark.createDataFrame([(1, 0, 1)], "q int, ord long, rank int")
    got = fusion.expand_scenes(ranked, rows, ["q"], "ord", top_k=5, vector_top_n=1).collect()
    assert sorted(r["ord"] for r in got) == [0, 1]


def rescue_case(spark, strength):
    rows = place(spark, [(i, "A", i, "s") for i in (0, 1, 2, 3, 4)] + [(10, "A", 10, "t")])
    base = spark.createDataFrame([(1, i, i + 1) for i in range(5)], "q int, ord long, out_rank int")
    d = spark.createDataFrame([(1, i, 0.5, i + 1) for i in range(5)], "q int, ord long, cos double, rank int")
    b = spark.createDataFrame([(1, 10, strength, 1), (1, 0, 1.0, 2)], "q int, ord long, bm25 double, rank int")
    cov = spark.createDataFrame([(1, 10, 1.0)], "q int, ord long, rare_coverage double")
    return [r["ord"] for r in fusion.rescue(base, d, b, cov, rows, ["q"], "ord").orderBy("out_rank").collect()]


def test_rescue_replaces_the_fifth(spark):
    assert rescue_case(spark, 9.0) == [0, 1, 2, 3, 10]


def test_weak_evidence_keeps_the_fifth(spark):
    assert rescue_case(spark, 0.2) == [0, 1, 2, 3, 4]


def test_bm25_hits_without_a_vector_are_not_returned(spark):
    d = spark.createDataFrame([(1, 5, 0.9, 1)], "q int, ord long, cos double, vec_rank int")
    b = spark.createDataFrame([(1, 6, 3.0, 1)], "q int, ord long, bm25 double, bm25_rank int")
    got = fusion.fuse(d, b, spark.createDataFrame([(5,)], "ord long"), "q", "ord").collect()
    assert [(r["ord"], r["score"]) for r in got] == [(5, 0.8)]


def corpus(spark, folder, books):
    """Tables of one question whose vector is that of the first row: per book a name and its rows' scenes and cosines."""
    rows = [(f"{name}-{i}", name, i, scene, f"{name} 的灯塔", [cos, (1 - cos * cos) ** 0.5] + [0.0] * 62) for name, own in books for i, (scene, cos) in enumerate(own)]
    rows = [(*r, n) for n, r in enumerate(rows)]
    spark.createDataFrame(rows, "id string, book_name string, chunk_index int, scene_id string, text string, embedding array<double>, ord long").write.parquet(f"{folder}/chunks.parquet")
    spark.createDataFrame([(20, "海边", rows[0][0])], "eval_id long, question string, gold_chunk_id string").write.parquet(f"{folder}/eval_items.parquet")
    return str(folder)


def test_reranked_candidates_come_from_the_whole_retrieval(spark, tmp_path):
    long = [("s1", 1.0), ("s1", 0.5)] + [(f"s{i // 20 + 2}", 0.9 - i / 200) for i in range(38)]  # row 1 is the 40th, next to the first
    sf = corpus(spark, tmp_path, [("A", long), ("B", [("s1", 0.1 - i / 1000) for i in range(10)])])
    got = {r["ord"]: r["cand_rank"] for r in retrieval.candidates(retrieval.wide_stages(spark, sf)).collect()}
    assert len(got) == 30 and got[0] == 1 and got[1] == 30


def test_books_without_scenes_are_not_expanded(spark, tmp_path):
    best = {0: 1.0, 5: 0.9, 10: 0.8, 15: 0.7, 19: 0.6}
    legacy = ("L", [(None if i % 2 else "scene-000", best.get(i, 0.3)) for i in range(20)])
    sf = corpus(spark, tmp_path / "two", [legacy, ("B", [("s1", 0.1), ("s1", 0.05)])])
    got = {r["ord"] for r in retrieval.routed(retrieval.stages(spark, sf)).collect()}
    assert got == {0, 5, 10, 20, 21}  # the best three of the legacy book, then the other book
    s = retrieval.stages(spark, corpus(spark, tmp_path / "one", [legacy]))
    for found in (retrieval.expanded(s), retrieval.unrouted(s)):
        assert [r["ord"] for r in found.orderBy("out_rank").collect()] == [0, 5, 10, 15, 19]


def test_scores_of_all_pairs_are_not_stored(spark, tmp_path):
    """Every question shares a term with every chunk: what is stored on the way grows with either, not with both."""
    from quillspark.session import scratch

    n = 400
    docs = spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("共同的话 w"), "id").alias("text"))
    asked = sparse.query_terms(spark.range(n).select(F.col("id").alias("q"), F.concat(F.lit("共同 w"), "id").alias("t")), "q", "t")
    vocab = sparse.vocabulary(asked)
    held = sparse.doc_terms(docs, "ord", "text", vocab).cache()
    weights = sparse.term_weights(asked.join(vocab, "term"), held, "q").cache()
    before = set(Path(scratch(spark).removeprefix("file:")).iterdir())
    top = sparse.top_bm25(weights, held, held.agg(F.avg("len")).first()[0], "q", "ord", 3).collect()
    new = [p for p in Path(scratch(spark).removeprefix("file:")).iterdir() if p not in before]
    stored = sum(spark.read.parquet(str(p)).count() for p in new)
    assert len(top) == 3 * n and stored <= 3 * n * spark.sparkContext.defaultParallelism < n * n
    full = sparse.bm25(None, None, "q", "t", "ord", "text", held.select("ord", "len", F.explode(F.arrays_zip("tids", "tfs")).alias("x")).select("ord", "len", F.col("x.tids").alias("tid"), F.col("x.tfs").alias("tf")).join(vocab, "tid").drop("tid"), held.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")), asked)
    by = Window.partitionBy("q").orderBy(F.desc("bm25"), "ord")
    best = full.withColumn("rank", F.row_number().over(by)).where("rank <= 3").collect()
    assert {(r["q"], r["ord"], r["bm25"], r["bm25_rank"]) for r in top} == {(r["q"], r["ord"], r["bm25"], r["rank"]) for r in best}


def test_terms_found_in_texts_are_those_of_the_expression(spark):
    texts = ["", "甲乙丙丁戊 Ab1ab1 甲乙丙丁", "甲", "x甲乙y丙丁", "𠀀𠀁甲乙", "甲乙\0丙丁", "。？！"]
    asked = spark.createDataFrame([(1, "甲乙丙丁 AB1 𠀀𠀁甲乙 丙丁 x"), (2, "丁戊 ab1ab1")], "q int, t string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord long, text string")
    vocab = sparse.vocabulary(sparse.query_terms(asked, "q", "t"))
    got = sparse.doc_terms(docs, "ord", "text", vocab)
    words = {r["tid"]: r["term"] for r in vocab.collect()}
    want = {(r["ord"], r["term"]): r["tf"] for r in sparse.postings(docs, "ord", "text", only=sparse.query_terms(asked, "q", "t")).collect()}
    assert {(r["ord"], words[t]): f for r in got.collect() for t, f in zip(r["tids"], r["tfs"])} == want
    sizes = {r["ord"]: r["n"] for r in docs.select("ord", F.size(terms(F.col("text"))).alias("n")).collect()}
    assert {r["ord"]: r["len"] for r in got.collect()} == sizes


def test_evidence_of_pairs_is_that_of_all_rows(spark):
    """Scores and coverage made for candidates only are those made over all pairs; a term that no text holds weighs in the total."""
    docs = spark.createDataFrame([(i, "甲乙丙 w%d w%d" % (i % 3, i), "b", True) for i in range(8)], "ord long, text string, book string, has_vec boolean")
    asked = sparse.query_terms(spark.createDataFrame([(1, "甲乙 w1 w4 none"), (2, "zz yy"), (3, "甲乙丙丁")], "q long, t string"), "q", "t")
    vocab = sparse.vocabulary(asked)
    held = sparse.doc_terms(docs, "ord", "text", vocab, ("book",))
    named = asked.join(vocab, "term")
    weights = sparse.term_weights(named, held, "q")
    rare = fusion.rare_weights(named, docs, "q", held.select(F.explode("tids").alias("tid")), term="tid")
    scored = weights.join(rare, ["q", "tid"], "left").withColumn("total", F.max("total").over(Window.partitionBy("q")))
    avg_len = held.agg(F.avg("len")).first()[0]
    pairs = spark.createDataFrame([(q, i) for q in (1, 2, 3) for i in range(8)], "q long, ord long")
    got = {(r["q"], r["ord"]): (r["bm25"], r["rare_coverage"]) for r in sparse.pair_scores(pairs, scored, held, avg_len, ["q"], "ord").collect()}
    postings = sparse.postings(docs, "ord", "text", only=asked, carry=("book",))
    bm25 = {(r["q"], r["ord"]): r["bm25"] for r in sparse.bm25(None, docs, "q", "t", "ord", "text", postings, None, asked).collect()}
    cov = {(r["q"], r["ord"]): r["rare_coverage"] for r in fusion.rare_coverage(asked, docs, "q", "ord", postings).collect()}
    for k in set(bm25) | set(cov):
        assert got[k] == (bm25.get(k, 0.0), cov.get(k, 0.0))
    assert all(v == (0.0, 0.0) for k, v in got.items() if k not in bm25)
    every = {(r["q"], r["ord"]): r["bm25"] for r in sparse.every_bm25(weights, held, avg_len, "q", "ord").collect()}
    assert every == bm25


def test_blocks_of_queries_leave_their_results_only(spark, tmp_path):
    """Queries retrieved in blocks give what all give at once, and what is stored for a block goes with it."""
    from quillspark.session import scratch

    sf = corpus(spark, tmp_path, [("A", [("s1", 1.0 - i / 20) for i in range(12)]), ("B", [("s2", 0.3 - i / 50) for i in range(8)])])
    asked = [(20 * i, t, "A-0" if i % 2 else "B-1") for i, t in enumerate(("灯塔", "海边", "", "A 的灯塔", "B"))]
    vectors = spark.read.parquet(f"{sf}/chunks.parquet").select(F.col("id").alias("gold_chunk_id"), F.col("embedding").alias("qvec"))
    queries = spark.createDataFrame(asked, "eval_id long, question string, gold_chunk_id string").join(vectors, "gold_chunk_id")
    s = retrieval.Stages(spark, sf, queries=queries)
    folder = Path(scratch(spark).removeprefix("file:"))
    form = lambda found: {(r["eval_id"], r["ord"], r["out_rank"]) for r in found.collect()}
    for way in (retrieval.routed, retrieval.unrouted):
        s.places, s.weights
        before = set(folder.iterdir())
        got = form(s.in_blocks(way, 2))
        new = [p.name.split("-")[0] for p in folder.iterdir() if p not in before]
        assert set(new) == {"block", "blocks"} and len(new) <= 4
        assert got == form(way(s)) and len({q for q, *_ in got}) == 5


def test_overlaps_are_those_of_the_texts(spark, tmp_path):
    """Counted from stored terms, without the texts; a question without terms has 0."""
    sf = corpus(spark, tmp_path, [("A", [("s1", 1.0), ("s1", 0.5)]), ("B", [("s2", 0.3)])])
    asked = spark.createDataFrame([(1, "A 的灯塔的灯塔", "A-0", None), (2, "。", "A-0", None), (3, "没有这个 b", "A-0", None)], "eval_id long, question string, gold_chunk_id string, qvec array<double>")
    s = retrieval.Stages(spark, sf, queries=asked)
    pairs = asked.select("eval_id", "question").crossJoin(s.texts)
    form = lambda rows: {(r["eval_id"], r["ord"]): r["rerank_score"] for r in rows.collect()}
    got = form(retrieval.overlaps(s, pairs.select("eval_id", "ord")))
    assert got == form(retrieval.lexical_overlap(pairs, "question", "text")) and len(got) == 9 and 0 < got[3, 2] < got[1, 0]
    assert {r["ord"]: r["text"] for r in s.texts_of(spark.createDataFrame([(2,), (0,), (2,)], "ord long")).collect()} == {0: "A 的灯塔", 2: "B 的灯塔"}


def test_dense_keeps_no_more_partial_tops_than_cores(spark, monkeypatch):
    """Rows in many files make no more partial tops than there are cores."""
    kept, stored = [], dense.saved_parts

    def counted(parts, name):
        out = stored(parts, name)
        kept.append(out.count())
        return out

    monkeypatch.setattr(dense, "saved_parts", counted)
    monkeypatch.setattr(dense, "AT_ONCE", 2)  # a block in several products
    rows = spark.range(0, 320, 1, 32).select(F.col("id").alias("ord"), F.array(F.cos(F.col("id") / 320), F.sin(F.col("id") / 320)).alias("v"))
    q = spark.createDataFrame([(i, [1.0, i / 9]) for i in range(3)], "q long, qv array<double>")
    got = dense.top_dense(q, rows, "q", "qv", "ord", "v", 2)
    assert got.count() == 6 and [r["ord"] for r in got.where("q = 0").orderBy("vec_rank").collect()] == [0, 1]
    assert kept[0] <= spark.sparkContext.defaultParallelism * 2 * 3


def test_normalising_stores_the_highest_scores_only(spark, sf, monkeypatch):
    from quillspark.plans import retrieval_queries

    kept, stored = [], sparse.saved_parts

    def counted(parts, name):
        out = stored(parts, name)
        kept.append((name, out.count()))
        return out

    monkeypatch.setattr(sparse, "saved_parts", counted)
    got = retrieval_queries.max_normalize(spark, sf)
    asked = got.select("eval_id").distinct().count()
    assert [name for name, _ in kept] == ["bm25-best"] and kept[0][1] <= asked * spark.sparkContext.defaultParallelism
    assert got.where("norm = 1").select("eval_id").distinct().count() == asked


def test_terms_of_the_same_queries_are_scored_as_one():
    """Fewer products, the same scores; a query that holds a term twice keeps it in a class of its own."""
    import numpy as np

    rng = np.random.default_rng(3)
    idf = rng.random(12) + 0.1
    holds = [(t, q, 2 if (t, q) == (9, 1) else 1) for t in range(12) for q in range(6) if (q + t // 4) % 3 == 0 or t >= 10]
    holds += [(9, 5, 1)]
    tid, q, count = (np.array(x) for x in zip(*sorted(holds)))
    w = count * idf[tid]
    d, t = (x.ravel() for x in np.indices((5, 14)))  # terms 12 and 13 are not asked
    p = rng.random(len(d))
    known, ct, cq, cw = sparse._classes(tid, q, w)
    own, docs, value = sparse._in_classes(known, t, d, p)
    assert len(known[0]) == 12 and known[1].max() + 1 == 5 and len(ct) < len(tid) and len(own) == 5 * 5
    want = sparse._products(6, tid, q, w, 5, t, d, p)
    assert np.abs(sparse._products(6, ct, cq, cw, 5, own, docs, value) - want).max() < 1e-12


WHOLE = ["bm25_topk", "eval_metrics", "eval_metrics_by_book", "evaluate_plain", "gold_rank", "representative_failures", "rerank_select", "retrieve_online", "retrieve_routed"]


@pytest.mark.parametrize("name", WHOLE)
def test_every_evaluation_item_is_asked(spark, tmp_path, name):
    """Not only those of the stated set; two of the items have a gold chunk that is not there."""
    sf = corpus(spark, tmp_path, [("A", [("s1", 1.0), ("s1", 0.5)]), ("B", [("s2", 0.3)])])
    items = [(1, "灯塔", "A-0", "A"), (2, "灯塔", "none-1", "A"), (20, "的灯塔", "A-1", None), (21, "灯塔", "none-2", None)]
    spark.createDataFrame(items, "eval_id long, question string, gold_chunk_id string, gold_book_name string").write.mode("overwrite").parquet(f"{sf}/eval_items.parquet")
    got = catalog.QUERIES[name](spark, sf)
    if "eval_id" in got.columns:
        some = {"representative_failures": {2, 21}, "retrieve_routed": {1, 20}}  # within a book nothing is found without a vector
        assert {r["eval_id"] for r in got.collect()} == some.get(name, {1, 2, 20, 21})
    else:
        assert max(r["n"] for r in got.collect()) == 4
    assert "% 20" not in catalog.ORACLE[name]
