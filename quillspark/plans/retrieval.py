"""Hybrid retrieval of many queries in one plan."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed
from quillspark.functions.exprs import book_from_id, cosine, terms, usable_vector
from quillspark.operators import dense, fusion, sparse
from quillspark.session import few, saved, saved_parts, settled, spread, table

DIMS = 64
QUERIES_A_BLOCK = 4096  # as many as are scored in one pass; tables on the way are kept for so many
QUERY_STEP = 20  # the stated query set: evaluation items whose id is divisible by this


def chunks_once(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk relation with one row per id (the first loaded), defaults filled in, and ``has_vec``.

    Only ids and load order are shuffled to find the later rows, which are then left out by an anti-join; texts and vectors
    are shuffled only if these are too many to be broadcast.
    """
    chunks = table(spark, sf, "chunks")
    later = chunks.select("id", "ord").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("_n > 1").select("ord")
    return spread(chunks).join(few(saved(later, "later")), "ord", "left_anti").select(
        "id",
        "ord",
        F.coalesce("book_name", book_from_id(F.col("id"))).alias("book"),
        "chunk_index",
        F.coalesce("scene_id", F.lit(fixed.NO_SCENE)).alias("scene_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        "embedding",
        usable_vector(F.col("embedding"), DIMS).alias("has_vec"),
    )


def stated_queries(spark: SparkSession, sf: str, chunks: DataFrame, whole: bool = False) -> DataFrame:
    """``eval_id, question, gold_chunk_id, qvec`` of the stated query set, or of the ``whole`` table; a question's vector is that of its gold chunk."""
    items = table(spark, sf, "eval_items")
    items = items if whole else items.where(F.col("eval_id") % QUERY_STEP == 0)
    items = items.select("eval_id", F.coalesce("question", F.lit("")).alias("question"), "gold_chunk_id").distinct()
    items = saved(items, "items")
    wanted = few(saved(items.select("gold_chunk_id").distinct(), "wanted"))
    vectors = chunks.where("has_vec").select(F.col("id").alias("gold_chunk_id"), F.col("embedding").alias("qvec")).join(wanted, "gold_chunk_id", "left_semi")
    return items.join(vectors, "gold_chunk_id", "left").select("eval_id", "question", "gold_chunk_id", "qvec")


class Stages:
    """The tables of one retrieval, keyed by ``eval_id`` and ``ord``; each is made and written once, when it is asked for.

    Dense and BM25 lists are as long as the longest use of them: the tops, the candidates of routing, ``results``.
    ``queries`` (eval_id, question, gold_chunk_id, qvec) take the place of the stated ones; ``whole`` takes all evaluation items.
    """

    def __init__(self, spark: SparkSession, sf: str, vector_top_n: int = fixed.VECTOR_TOP_N, bm25_top_n: int = fixed.BM25_TOP_N, results: int = 100, queries: DataFrame | None = None, whole: bool = False) -> None:
        if vector_top_n <= 0 or bm25_top_n <= 0:
            raise ValueError("vector_top_n and bm25_top_n must be positive")
        self.chunks = chunks_once(spark, sf)
        self.queries = saved(stated_queries(spark, sf, self.chunks, whole) if queries is None else queries, "queries")
        self.tops, self.depth = (vector_top_n, bm25_top_n), max(results, vector_top_n, bm25_top_n, 8 * fixed.ROUTE_BOOKS)

    @cached_property
    def places(self) -> DataFrame:
        """Every chunk but for text and vector: ``ord, id, book, chunk_index, scene_id, has_vec``."""
        return saved(self.chunks.select("ord", "id", "book", "chunk_index", "scene_id", "has_vec"), "places")

    @property
    def rows(self) -> DataFrame:
        """The places of the chunks with a vector, which alone are returned."""
        return self.places.where("has_vec")

    @property
    def texts(self) -> DataFrame:
        return self.chunks.where("has_vec").select("ord", "text")

    @property
    def vectors(self) -> DataFrame:
        return self.chunks.where("has_vec").select("ord", "book", "embedding")

    @cached_property
    def dense(self) -> DataFrame:
        """The rows of highest cosine: ``cos, vec_rank``."""
        return dense.top_dense(self.queries, self.vectors, "eval_id", "qvec", "ord", "embedding", self.depth)

    @cached_property
    def asked(self) -> DataFrame:
        """The queries' terms: ``eval_id, term, qc``."""
        return saved(sparse.query_terms(spread(self.queries), "eval_id", "question"), "asked")

    @cached_property
    def vocab(self) -> DataFrame:
        """The queries' terms by number: ``term, tid``."""
        return saved(sparse.vocabulary(self.asked), "vocab")

    @cached_property
    def postings(self) -> DataFrame:
        """Of the queries' terms: ``ord, term, tf, len, book, has_vec``."""
        return saved(sparse.postings(self.chunks, "ord", "text", only=self.asked, carry=("book", "has_vec")), "postings")

    @cached_property
    def held(self) -> DataFrame:
        """The queries' terms in every chunk, one row each: ``ord, book, has_vec, len, tids, tfs``."""
        return saved(sparse.doc_terms(self.chunks, "ord", "text", self.vocab, ("book", "has_vec")), "held")

    @property
    def found(self) -> DataFrame:
        """``held`` of the chunks with a vector."""
        return self.held.where("has_vec")

    @cached_property
    def avg_len(self) -> float:
        return self.held.agg(F.avg("len")).first()[0] or 0.0

    @cached_property
    def weights(self) -> DataFrame:
        """What each term of a query weighs in its BM25 scores: ``eval_id, tid, w``."""
        return saved(sparse.term_weights(self.asked.join(self.vocab, "term"), self.held, "eval_id"), "weights")

    @property
    def scores(self) -> DataFrame:
        """All rows with a BM25 score, in no order: ``bm25``. As many as pairs with a term in common, so they are made as they are read."""
        return sparse.every_bm25(self.weights, self.held, self.avg_len, "eval_id", "ord")

    @cached_property
    def sparse(self) -> DataFrame:
        """The rows of highest BM25 score: ``bm25, bm25_rank``. Each task keeps its own best before they are sorted."""
        return sparse.top_bm25(self.weights, self.held, self.avg_len, "eval_id", "ord", self.depth)

    @cached_property
    def fused(self) -> DataFrame:
        """``score, fused_rank`` of the rows with a vector."""
        return saved(fusion.fuse(self.dense, self.sparse, self.rows, "eval_id", "ord", *self.tops), "fused")

    def texts_of(self, rows: DataFrame) -> DataFrame:
        """``rows`` (ord) with their ``text``; other texts leave before they are shuffled where few are wanted."""
        wanted = few(saved(rows.select("ord").distinct(), "wanted"))
        return rows.join(self.texts.join(wanted, "ord", "left_semi"), "ord")

    def in_blocks(self, found: Callable[[Stages], DataFrame], size: int | None = None) -> DataFrame:
        """What ``found`` gives for all queries, stored; it is called for blocks of them, and what a block stores goes with it."""
        shared = self.places, self.weights  # all that they are made of and what tells about the chunks is made here and stays
        spark, blocks = shared[0].sparkSession, list(sparse.query_blocks(self.queries, "eval_id", size or QUERIES_A_BLOCK))
        self.avg_len

        def part(low: object, high: object) -> Stages:
            own, within = copy(self), F.col("eval_id").between(low, high)
            for name in ("dense", "sparse", "fused"):
                own.__dict__.pop(name, None)
            own.queries, own.asked, own.weights = (x.where(within) for x in (self.queries, self.asked, self.weights))
            return own

        return saved_parts((settled(spark, lambda a=a, b=b: found(part(a, b)), "block") for a, b in blocks or [(None, None)]), "blocks")


def stages(spark: SparkSession, sf: str, whole: bool = False) -> Stages:
    return Stages(spark, sf, whole=whole)


def wide_stages(spark: SparkSession, sf: str, whole: bool = False) -> Stages:
    """With the longer dense and BM25 tops that candidates for reranking are made of."""
    return Stages(spark, sf, fixed.WIDE_TOP_N, fixed.WIDE_TOP_N, whole=whole)


def _places(s: Stages) -> DataFrame:
    return s.rows.select("ord", "book", "chunk_index", "scene_id")


def _scened(rows: DataFrame) -> DataFrame:
    """Per book of ``rows`` whether any of them has a scene: ``route_book, scened``."""
    return rows.groupBy(F.col("book").alias("route_book")).agg(F.bool_or(F.col("scene_id") != fixed.NO_SCENE).alias("scened"))


def has_scenes(s: Stages) -> bool:
    return not s.rows.where(F.col("scene_id") != fixed.NO_SCENE).isEmpty()


def has_many_books(s: Stages) -> bool:
    return s.places.select("book").distinct().limit(2).count() > 1


def expanded(s: Stages, top_k: int = fixed.TOP_K) -> DataFrame:
    """``eval_id, ord, out_rank``: scenes of the best candidates in document order, or the best rows where no row has a scene."""
    fused = s.fused.withColumnRenamed("fused_rank", "rank")
    if not has_scenes(s):
        return fused.where(F.col("rank") <= top_k).select("eval_id", "ord", F.col("rank").alias("out_rank"))
    return fusion.expand_scenes(fused, _places(s), ["eval_id"], "ord", top_k, s.tops[0]).select("eval_id", "ord", "out_rank")


def unrouted(s: Stages, top_k: int = fixed.TOP_K) -> DataFrame:
    """``eval_id, ord, out_rank`` without routing: scenes of the best candidates in document order, then the rescue slot.

    Where no row has a scene there is neither, and the best rows stay.
    """
    if not has_scenes(s):
        return expanded(s, top_k)
    base = saved(expanded(s, top_k), "expanded")
    top_b = sparse.top_bm25(s.weights, s.found, s.avg_len, "eval_id", "ord", s.tops[1]).withColumnRenamed("bm25_rank", "rank")
    return _rescued(s, base, s.dense.withColumnRenamed("vec_rank", "rank"), top_b, ["eval_id"], top_k)


def _rescued(s: Stages, base: DataFrame, d: DataFrame, top_b: DataFrame, scope: list[str], top_k: int, routes: DataFrame | None = None) -> DataFrame:
    """The rescue slot with evidence made for its candidates only; ``top_b`` are the BM25 tops."""
    cand = saved(fusion.rescue_candidates(base, d, top_b, _places(s), scope, "ord", *s.tops), "rescue")
    asked = s.asked.join(s.vocab, "term")
    held = s.found.select(*[F.col("book").alias("route_book")] * (routes is not None), F.explode("tids").alias("tid"))
    rare = fusion.rare_weights(asked, s.rows, "eval_id", held, routes, "tid")
    terms = s.weights if routes is None else s.weights.join(routes, "eval_id")
    # the total is the scope's, with those of its terms that no text holds
    terms = terms.join(rare, [*scope, "tid"], "left").withColumn("total", F.max("total").over(Window.partitionBy(*scope)))
    evidence = sparse.pair_scores(cand.select(*scope, "ord"), saved(terms, "terms"), s.found, s.avg_len, scope, "ord")
    coverage = evidence.select(*scope, "ord", "rare_coverage")
    own = evidence.select(*scope, "ord", "bm25").withColumn("rank", F.lit(None).cast("int"))
    most = top_b.where("rank = 1").select(*scope, F.col("bm25").alias("max_bm25"))
    return fusion.rescue(base, d, own, coverage, _places(s), scope, "ord", top_k, *s.tops, candidates=cand, max_bm25=most)


def in_books(s: Stages, routes: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each routed book (``eval_id, route_book``): dense ranks, the BM25 top, and fused ranks up to ``most``.

    A fused rank is by score, then cosine. Only rows of the vector or BM25 top have a score that is not 0, which are so
    many at most; so the best rows by cosine, as many more than are wanted, hold all others that can have a rank.
    """
    scope = ["eval_id", "route_book"]
    own = routes.select("eval_id", F.col("book").alias("route_book"))
    vectors = s.vectors.withColumnRenamed("book", "route_book")
    d = dense.top_dense(s.queries, vectors, "eval_id", "qvec", "ord", "embedding", most + sum(s.tops), own, "route_book").withColumnRenamed("vec_rank", "rank")
    asking = s.queries.where("qvec is not null").select("eval_id", "qvec")
    scored = s.fused.where("score <> 0").join(s.rows.select("ord", F.col("book").alias("route_book")), "ord").join(own, scope).select(*scope, "ord", "score")
    far = scored.join(d, [*scope, "ord"], "left_anti").join(asking, "eval_id").join(s.vectors.select("ord", "embedding"), "ord")
    far = far.select(*scope, "ord", (F.round(cosine(F.col("qvec"), F.col("embedding")), 9) + 0.0).alias("cos"), "score")
    near = d.join(scored, [*scope, "ord"], "left").select(*scope, "ord", "cos", F.coalesce("score", F.lit(0.0)).alias("score"))
    by = lambda *order: F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    f = near.unionByName(far).withColumn("rank", by(F.desc("score"), F.desc("cos"), "ord")).where(F.col("rank") <= most)
    top_b = sparse.top_bm25(s.weights, s.found.withColumnRenamed("book", "route_book"), s.avg_len, "eval_id", "ord", s.tops[1], own, "route_book")
    return d, top_b.withColumnRenamed("bm25_rank", "rank"), f.select(*scope, "ord", "rank")


def routed(s: Stages, top_k: int = fixed.TOP_K, cap: int = fixed.BOOK_CAP, routes: int = fixed.ROUTE_BOOKS) -> DataFrame:
    """``eval_id, ord, book, score, out_rank``: each routed book expanded and rescued by itself, then merged under the cap.

    A book none of whose rows has a scene gives its best rows as they are.
    """
    books = saved(fusion.route_books(s.fused, s.sparse, s.rows, "eval_id", "ord", routes, max(*s.tops, 8 * routes)), "routes")
    scope = ["eval_id", "route_book"]
    d, top_b, f = in_books(s, books, max(s.tops[0], top_k))
    f = saved(f.join(_scened(s.rows), "route_book"), "in-books")
    base = saved(fusion.expand_scenes(f.where("scened"), _places(s), scope, "ord", top_k, s.tops[0]).select(*scope, "ord", "out_rank"), "expanded")
    found = _rescued(s, base, d, top_b, scope, top_k, books.select("eval_id", F.col("book").alias("route_book")))
    found = found.unionByName(f.where(~F.col("scened") & (F.col("rank") <= top_k)).select(*scope, "ord", F.col("rank").alias("out_rank")))
    merged = found.join(s.fused.select("eval_id", "ord", "score"), ["eval_id", "ord"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    merged = merged.join(books.select("eval_id", F.col("book").alias("route_book"), "route_rank"), scope)
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("eval_id").orderBy(F.desc("score"), "route_rank", "out_rank"))).drop("out_rank")
    return fusion.capped(ranked, "eval_id", "route_book", "rank", top_k, cap).select("eval_id", "ord", F.col("route_book").alias("book"), "score", "out_rank")


def retrieve(s: Stages, top_k: int = fixed.TOP_K, cap: int | None = None, routes: int = fixed.ROUTE_BOOKS) -> DataFrame:
    """``eval_id, ord, base_score, out_rank``: the whole retrieval, routed if there is more than one book and ``routes`` is not 0.

    No ``top_k`` gives no rows. A query for which no book yields a row takes the first fused rows. Wrong parameters raise.
    """
    if routes < 0 or cap is not None and cap <= 0:
        raise ValueError("routes must not be negative, a cap must be positive")
    return s.in_blocks(lambda b: _retrieve(b, top_k, cap, routes))


def _retrieve(s: Stages, top_k: int, cap: int | None, routes: int) -> DataFrame:
    fused = s.fused.select("eval_id", "ord", F.col("score").alias("base_score"), F.col("fused_rank").alias("out_rank"))
    if top_k <= 0:
        return fused.limit(0)
    if routes and has_many_books(s):
        found = routed(s, top_k, cap or fixed.BOOK_CAP, routes).select("eval_id", "ord", F.col("score").alias("base_score"), "out_rank")
    else:
        found = unrouted(s, top_k).join(fused.drop("out_rank"), ["eval_id", "ord"], "left").select("eval_id", "ord", F.coalesce("base_score", F.lit(0.0)).alias("base_score"), "out_rank")
    found = saved(found, "retrieved")
    return found.unionByName(fused.where(F.col("out_rank") <= top_k).join(found.select("eval_id"), "eval_id", "left_anti"))


def lexical_overlap(pairs: DataFrame, query_text: str, text: str) -> DataFrame:
    """The offline stand-in for an external scorer: the share of a query's distinct terms that a text holds."""
    asked = F.array_distinct(terms(F.col(query_text)))
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, terms(F.col(text)))) / F.size(asked)).otherwise(0.0)
    return pairs.withColumn("rerank_score", F.round(share, 9))


def overlaps(s: Stages, pairs: DataFrame) -> DataFrame:
    """``eval_id, ord, rerank_score``: the ``lexical_overlap`` of the pairs, counted from the queries' terms in each text."""
    asked = s.asked.join(s.vocab, "term").select("eval_id", "tid")
    counted = saved(asked.select("*", F.lit(0.0).alias("w"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("total")), "terms")
    held = sparse.pair_scores(pairs, counted, s.found, s.avg_len, ["eval_id"], "ord").select("eval_id", "ord", F.col("rare_coverage").alias("held"))
    both = pairs.join(held, ["eval_id", "ord"], "left").join(asked.groupBy("eval_id").agg(F.count("*").alias("n")), "eval_id", "left")
    return both.select("eval_id", "ord", F.round(F.coalesce(F.col("held") / F.col("n"), F.lit(0.0)), 9).alias("rerank_score"))


def candidates(s: Stages, count: int = fixed.RERANK_CANDIDATES) -> DataFrame:
    """``eval_id, ord, base_score, cand_rank``: what the whole retrieval finds for each query, with ``count`` as size and cap."""
    return retrieve(s, count, count).withColumnRenamed("out_rank", "cand_rank")


def reranked(s: Stages, count: int = fixed.RERANK_CANDIDATES) -> DataFrame:
    """``eval_id, ord, book, base_score, cand_rank, rerank_score, rerank_rank`` of the candidates of each query."""
    pairs = candidates(s, count)
    scored = pairs.join(overlaps(s, pairs.select("eval_id", "ord")), ["eval_id", "ord"]).join(s.rows.select("ord", "book"), "ord")
    by = Window.partitionBy("eval_id").orderBy(F.desc("rerank_score"), "cand_rank")
    return saved(scored.withColumn("rerank_rank", F.row_number().over(by)), "reranked")


def rerank_select(s: Stages, top_k: int = fixed.TOP_K, cap: int = fixed.BOOK_CAP) -> DataFrame:
    return fusion.capped(reranked(s), "eval_id", "book", "rerank_rank", top_k, cap)
