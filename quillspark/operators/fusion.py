"""Fusion, routing, expansion, rescue and capping of ranked lists; every list is partitioned by its query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed
from quillspark.functions.exprs import normalized
from quillspark.session import saved


def fuse(dense: DataFrame, sparse: DataFrame, rows: DataFrame, query: str, key: str, vector_top_n: int = fixed.VECTOR_TOP_N, bm25_top_n: int = fixed.BM25_TOP_N) -> DataFrame:
    """``query, key, score, fused_rank`` of the rows with a vector that stand in ``dense`` or in the BM25 top.

    ``dense`` (query, key, cos, vec_rank) has the rows of highest cosine, at least the top ``vector_top_n`` and as many
    as shall be ranked; ``sparse`` (query, key, bm25, bm25_rank) the BM25 top at least; ``rows`` the keys that have a vector.
    The score is 0.8 of the cosine normalised by the best, for the vector top, plus 0.2 of the normalised BM25, for the
    BM25 top; ties go to the better vector rank, then to the smaller key. A BM25 hit without a vector takes its place in
    the BM25 top but is not returned.
    """
    top_v = dense.where(F.col("vec_rank") <= vector_top_n)
    top_b = sparse.where(F.col("bm25_rank") <= bm25_top_n)
    most = top_v.groupBy(query).agg(F.max("cos").alias("max_cos")).join(top_b.groupBy(query).agg(F.max("bm25").alias("max_bm25")), query, "full")
    hits = top_b.join(rows.select(key), key, "left_semi").select(query, key, "bm25")
    both = dense.select(query, key, "cos", "vec_rank").join(hits, [query, key], "full").join(most, query)
    cos = F.when(F.col("vec_rank") <= vector_top_n, F.col("cos")).otherwise(0.0)
    score = fixed.VECTOR_WEIGHT * normalized(cos, F.col("max_cos")) + fixed.BM25_WEIGHT * normalized(F.coalesce("bm25", F.lit(0.0)), F.col("max_bm25"))
    by = Window.partitionBy(query).orderBy(F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc(key))
    return both.withColumn("score", F.round(score, 9)).withColumn("fused_rank", F.row_number().over(by)).select(query, key, "score", "fused_rank", "vec_rank")


def route_books(fused: DataFrame, sparse: DataFrame, rows: DataFrame, query: str, key: str, routes: int = fixed.ROUTE_BOOKS, candidates: int = 40) -> DataFrame:
    """``query, book, book_score, route_rank``: the books of the best candidates.

    A book scores its best fused row among the first ``candidates``; its best normalised BM25 hit among as many takes
    the place if it is strictly higher. Ties go to the better rank, then to books with a fused row, then to the name.
    ``rows`` (key, book) are those with a vector.
    """
    own = rows.select(key, "book")
    best = lambda df, rank, score, source: df.where(F.col(rank) <= candidates).join(own, key).groupBy(query, "book").agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(rank)).alias("r"))).alias("x")).select(query, "book", F.col("x.s").alias(f"s_{source}"), (-F.col("x.r")).alias(f"r_{source}"))
    most = sparse.groupBy(query).agg(F.max("bm25").alias("most"))  # rank 1 is always there
    f = best(fused, "fused_rank", "score", "f")
    b = best(sparse.join(most, query).withColumn("norm", F.round(normalized(F.col("bm25"), F.col("most")), 9)), "bm25_rank", "norm", "b")
    both = f.join(b, [query, "book"], "full")
    swap = F.col("s_f").isNull() | (F.coalesce("s_b", F.lit(-1e9)) > F.coalesce("s_f", F.lit(-1e9)))
    both = both.select(query, "book", F.when(swap, F.col("s_b")).otherwise(F.col("s_f")).alias("book_score"), F.when(swap, F.col("r_b")).otherwise(F.col("r_f")).alias("best_rank"), F.col("s_f").isNull().alias("late"))
    by = Window.partitionBy(query).orderBy(F.desc("book_score"), "best_rank", "late", "book")
    return both.withColumn("route_rank", F.row_number().over(by)).where(F.col("route_rank") <= routes).select(query, "book", "book_score", "route_rank")


def capped(candidates: DataFrame, query: str, group: str, rank: str, k: int, cap: int | None) -> DataFrame:
    """The first ``k`` rows of each query with at most ``cap`` of a group, filled up from the rest where these run out.

    ``out_rank`` counts from 1: rows within their group's cap come first, in the order of ``rank``. No cap (None, or not
    positive) takes the first ``k``.
    """
    inside = F.lit(True)
    if cap and cap > 0:
        inside = F.row_number().over(Window.partitionBy(query, group).orderBy(rank)) <= cap
    by = Window.partitionBy(query).orderBy(F.desc("_inside"), F.asc(rank))
    return candidates.withColumn("_inside", inside).withColumn("out_rank", F.row_number().over(by)).where(F.col("out_rank") <= k).drop("_inside")


def neighbours(seeds: DataFrame, rows: DataFrame, before: int = fixed.BEFORE, after: int = fixed.AFTER) -> DataFrame:
    """Rows of ``rows`` (key, book, chunk_index) near each seed (book, chunk_index and other columns) in its book.

    The few offsets are exploded into an equi-join; ``offset`` says which one a row has.
    """
    near = seeds.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("near_index", F.col("chunk_index") + F.col("offset")).drop("chunk_index")
    return near.join(rows.withColumnRenamed("chunk_index", "near_index"), ["book", "near_index"])


def expand_scenes(ranked: DataFrame, rows: DataFrame, scope: list[str], key: str, top_k: int = fixed.TOP_K, vector_top_n: int = fixed.VECTOR_TOP_N, scenes: int = fixed.TOP_SCENES, before: int = fixed.BEFORE, after: int = fixed.AFTER) -> DataFrame:
    """``scope, key, book, chunk_index, out_rank``: the best scenes' rows, each candidate's neighbours first, in document order.

    ``ranked`` (scope, key, rank) are candidates by rank, ``rows`` (key, book, chunk_index, scene_id) those with a
    vector. Scenes are ordered by their best candidate; for each scene come the neighbourhoods of its candidates, then
    the rest of the scene. The first ``top_k`` rows stay and are then put in the order of book and position. No
    candidates, no rows.
    """
    place = rows.select(key, "book", "chunk_index", "scene_id")
    cand = ranked.where(F.col("rank") <= vector_top_n).select(*scope, key, "rank").join(place, key)
    scene = cand.groupBy(*scope, "book", "scene_id").agg(F.min("rank").alias("best"))
    scene = scene.withColumn("scene_no", F.row_number().over(Window.partitionBy(*scope).orderBy("best"))).where(F.col("scene_no") <= scenes).drop("best")
    seeds = cand.drop(key).join(scene, [*scope, "book", "scene_id"]).drop("scene_id")
    near = neighbours(seeds, place.drop("scene_id"), before, after).select(*scope, key, "scene_no", F.lit(0).alias("phase"), F.col("rank").alias("p1"), F.col("offset").alias("p2"))
    rest = scene.join(place, ["book", "scene_id"]).select(*scope, key, "scene_no", F.lit(1).alias("phase"), F.lit(0).alias("p1"), F.col("chunk_index").alias("p2"))
    first = near.unionByName(rest).groupBy(*scope, key).agg(F.min(F.struct("scene_no", "phase", "p1", "p2")).alias("at"))
    chosen = first.withColumn("n", F.row_number().over(Window.partitionBy(*scope).orderBy("at", key))).where(F.col("n") <= top_k)
    placed = chosen.join(place.drop("scene_id"), key)
    by = Window.partitionBy(*scope).orderBy("book", "chunk_index", key)
    return placed.withColumn("out_rank", F.row_number().over(by)).select(*scope, key, "book", "chunk_index", "out_rank")


def rare_weights(asked: DataFrame, rows: DataFrame, query: str, held: DataFrame, routes: DataFrame | None = None, term: str = "term") -> DataFrame:
    """``query, term, weight, total`` of the terms that count in the coverage, see there; with ``routes`` in each ``route_book``.

    ``held`` (term, with routes also route_book) has a row for each term of each row. ``term`` may be another column that
    names the terms, which are a column of ``asked`` all the same.
    """
    asked = asked.where(~F.col("term").isin(*fixed.RESCUE_STOP_TERMS)).select(query, term)
    book = [F.col("book").alias("route_book")] * (routes is not None)
    cols, on = ([query], [term]) if routes is None else ([query, "route_book"], [term, "route_book"])
    sizes = rows.groupBy(*book).agg(F.count("*").alias("n"))
    if routes is None:
        every = asked.crossJoin(F.broadcast(sizes))  # one row
    else:
        every = asked.join(routes.select(*cols), query).join(sizes, "route_book")
    df = held.groupBy(*on).agg(F.count("*").alias("df"))
    every = every.join(df, on, "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = (F.col("df") > 0) & (F.col("df") <= F.greatest(F.lit(3), F.floor(F.col("n") * 0.1)))
    by = Window.partitionBy(*cols)
    every = every.withColumn("rare", rare).withColumn("some", F.max("rare").over(by))
    weight = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return every.where("rare or not some").select(*cols, term, weight.alias("weight")).withColumn("total", F.sum("weight").over(by))


def rare_coverage(asked: DataFrame, rows: DataFrame, query: str, key: str, found: DataFrame, routes: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """``query, key, rare_coverage``: the weight of a query's rare terms that a row holds, as a share of all of them.

    ``asked`` (query, term) has the terms of each query, ``found`` (key, term, book) the rows of ``rows`` (key, book) that
    hold them. Rare is a term in at least one and at most max(3, a tenth) of the rows; if a query has none such, all its
    terms are taken. ``among`` (query, key) are the rows it is wanted of, else all that hold a term. With ``routes``
    (query, route_book) this is done book by book and ``route_book`` is a column of ``among`` and of the result; else
    over all rows.
    """
    book = [F.col("book").alias("route_book")] * (routes is not None)
    cols, on = ([query], ["term"]) if routes is None else ([query, "route_book"], ["term", "route_book"])
    held = found.select(key, "term", *book)
    chosen = rare_weights(asked, rows, query, held, routes)
    if among is not None:  # rows that no query wants leave before the join on terms, a query's own rows are kept after it
        held = held.join(among.select(key, *cols[1:]).distinct(), [key, *cols[1:]], "left_semi")
    hits = held.join(chosen, on)
    if among is not None:
        hits = hits.join(among.select(*cols, key), [*cols, key], "left_semi")
    matched = hits.groupBy(*cols, key).agg(F.sum("weight").alias("w"), F.first("total").alias("total"))
    return matched.select(*cols, key, F.round(F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(0.0), 9).alias("rare_coverage"))


def evidence_score(bm25_norm: Column, rare: Column, vector_norm: Column) -> Column:
    return F.round(fixed.RESCUE_BM25 * bm25_norm + fixed.RESCUE_RARE * rare + fixed.RESCUE_VECTOR * vector_norm, 9)


def rescue_candidates(baseline: DataFrame, dense: DataFrame, sparse: DataFrame, rows: DataFrame, scope: list[str], key: str, vector_top_n: int = fixed.VECTOR_TOP_N, bm25_top_n: int = fixed.BM25_TOP_N, before: int = fixed.BEFORE, after: int = fixed.AFTER) -> DataFrame:
    """``scope, key, slot_key``: the fifth row of each baseline and the rows that may take its place.

    These are the neighbourhoods of the BM25 and vector tops, without the first four rows.
    """
    slot = baseline.where(F.col("out_rank") == fixed.RESCUE_RANK).select(*scope, F.col(key).alias("slot_key"))
    locked = baseline.where(F.col("out_rank") < fixed.RESCUE_RANK).select(*scope, key)
    tops = dense.where(F.col("rank") <= vector_top_n).select(*scope, key).unionByName(sparse.where(F.col("rank") <= bm25_top_n).select(*scope, key)).distinct()
    place = rows.select(key, "book", "chunk_index")
    seeds = tops.join(slot, scope).join(place, key).drop(key)
    near = neighbours(seeds, place, before, after).select(*scope, key, "slot_key")
    return near.unionByName(slot.select(*scope, F.col("slot_key").alias(key), "slot_key")).distinct().join(locked, [*scope, key], "left_anti")


def rescue(baseline: DataFrame, dense: DataFrame, sparse: DataFrame, coverage: DataFrame, rows: DataFrame, scope: list[str], key: str, top_k: int = fixed.TOP_K, vector_top_n: int = fixed.VECTOR_TOP_N, bm25_top_n: int = fixed.BM25_TOP_N, before: int = fixed.BEFORE, after: int = fixed.AFTER, candidates: DataFrame | None = None, max_bm25: DataFrame | None = None) -> DataFrame:
    """``scope, key, out_rank``: the baseline with its fifth row replaced by one of much stronger evidence, if there is one.

    ``dense`` (scope, key, cos, rank) and ``sparse`` (scope, key, bm25, rank) are ranked within the scope, ``coverage``
    (scope, key, rare_coverage) likewise; ``baseline`` (scope, key, out_rank). Ranks behind the tops may be null.
    ``candidates`` are those of ``rescue_candidates`` and ``max_bm25`` (scope, max_bm25) the highest scores, where they are
    there already; ``sparse`` need then only have the candidates. The best by score, then BM25, then
    coverage, then key decides; queries with fewer than five rows stay as they are.
    """
    slot_rank = fixed.RESCUE_RANK
    if top_k < slot_rank:
        return baseline.select(*scope, key, "out_rank")
    cand = rescue_candidates(baseline, dense, sparse, rows, scope, key, vector_top_n, bm25_top_n, before, after) if candidates is None else candidates
    top_v = dense.where(F.col("rank") <= vector_top_n)
    most_b = sparse.groupBy(*scope).agg(F.max("bm25").alias("max_bm25")) if max_bm25 is None else max_bm25
    most = top_v.groupBy(*scope).agg(F.max("cos").alias("max_cos")).join(most_b, scope, "full")
    scored = cand.join(top_v.select(*scope, key, "cos"), [*scope, key], "left").join(sparse.select(*scope, key, "bm25"), [*scope, key], "left").join(coverage, [*scope, key], "left").join(most, scope, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = scored.withColumn("bm25_norm", F.round(normalized(zero("bm25"), F.col("max_bm25")), 9)).withColumn("vector_norm", F.round(normalized(zero("cos"), F.col("max_cos")), 9)).withColumn("rare", zero("rare_coverage"))
    scored = scored.withColumn("evidence", evidence_score(F.col("bm25_norm"), F.col("rare"), F.col("vector_norm"))).select(*scope, key, "slot_key", "bm25_norm", "rare", "evidence")
    own = Window.partitionBy(*scope)
    scored = scored.withColumn("slot_evidence", F.max(F.when(F.col(key) == F.col("slot_key"), F.col("evidence"))).over(own))
    best = scored.withColumn("n", F.row_number().over(own.orderBy(F.desc("evidence"), F.desc("bm25_norm"), F.desc("rare"), F.asc(key)))).where("n = 1")
    strong = (F.col(key) != F.col("slot_key")) & (F.col("bm25_norm") >= fixed.RESCUE_MIN_BM25) & (F.col("rare") >= fixed.RESCUE_MIN_RARE) & (F.col("evidence") >= fixed.RESCUE_MIN_SCORE) & (F.col("evidence") >= F.col("slot_evidence") + fixed.RESCUE_MARGIN)
    rescued = saved(best.where(strong).select(*scope, F.col(key).alias("new_key")), "rescued")
    moved = baseline.join(rescued, scope, "left")
    moved = moved.where(F.col("new_key").isNull() | (F.col("out_rank") < slot_rank) | (F.col(key) != F.col("new_key")))
    later = F.when(F.col("new_key").isNotNull() & (F.col("out_rank") >= slot_rank), F.col("out_rank") + 0.5).otherwise(F.col("out_rank"))
    both = moved.select(*scope, key, later.cast("double").alias("r")).unionByName(rescued.select(*scope, F.col("new_key").alias(key), F.lit(float(slot_rank)).alias("r")))
    both = both.withColumn("out_rank", F.row_number().over(Window.partitionBy(*scope).orderBy("r")))
    return both.where(F.col("out_rank") <= top_k).select(*scope, key, "out_rank")
