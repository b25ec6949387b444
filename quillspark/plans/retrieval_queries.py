"""Registered queries of scoring, fusion and retrieval, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import fixed
from quillspark.functions.exprs import CJK_CLASS, cosine, normalized, term_count, terms
from quillspark.operators import fusion, sparse
from quillspark.plans import retrieval
from quillspark.session import few, spread, table


def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of every chunk: how many, how many different ones, and the largest."""
    t = terms(F.col("text"))
    return spread(table(spark, sf, "chunks")).select("ord", term_count(F.col("text")).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"), F.array_max(t).alias("last_term")).where("n_terms is not null")


def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.term_stats(retrieval.chunks_once(spark, sf), "ord", "text")


def bm25_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = sparse.corpus_stats(retrieval.chunks_once(spark, sf), "text")
    return s.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best rows of every evaluation item by BM25."""
    s = retrieval.stages(spark, sf, whole=True)
    top = s.in_blocks(lambda b: sparse.top_bm25(b.weights, b.held, b.avg_len, "eval_id", "ord", fixed.BM25_TOP_N))
    return top.select("eval_id", "ord", F.round("bm25", 6).alias("bm25"), "bm25_rank")


def dense_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    s = retrieval.stages(spark, sf)
    return s.dense.where(F.col("vec_rank") <= fixed.VECTOR_TOP_N).select("eval_id", "ord", F.round("cos", 6).alias("cos"), "vec_rank")


def next_chunk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of every chunk with the next one of its book."""
    rows = retrieval.chunks_once(spark, sf).where("has_vec").select("ord", "book", "chunk_index", "embedding")
    nxt = rows.select("book", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("ord").alias("next_ord"), F.col("embedding").alias("next_embedding"))
    return rows.join(nxt, ["book", "chunk_index"]).select("ord", "next_ord", (F.round(cosine(F.col("embedding"), F.col("next_embedding")), 6) + 0.0).alias("cos"))


def max_normalize(spark: SparkSession, sf: str) -> DataFrame:
    s = retrieval.stages(spark, sf)
    best = sparse.top_bm25(s.weights, s.held, s.avg_len, "eval_id", "ord", 1)  # nothing but the highest is needed
    most = best.select("eval_id", F.col("bm25").alias("most"))
    return s.scores.join(few(most), "eval_id").select("eval_id", "ord", F.round(normalized(F.col("bm25"), F.col("most")), 6).alias("norm"))


def hybrid_fusion_topk(spark: SparkSession, sf: str) -> DataFrame:
    s = retrieval.stages(spark, sf)
    return s.fused.where("fused_rank <= 30").select("eval_id", "ord", F.round("score", 6).alias("score"), "fused_rank")


def book_route(spark: SparkSession, sf: str) -> DataFrame:
    s = retrieval.stages(spark, sf)
    return fusion.route_books(s.fused, s.sparse, s.rows, "eval_id", "ord").select("eval_id", "book", F.round("book_score", 6).alias("book_score"), "route_rank")


def neighbor_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk's neighbours from two before to one after in its book."""
    rows = retrieval.chunks_once(spark, sf).select("ord", "book", "chunk_index")
    seeds = rows.withColumnRenamed("ord", "seed_ord")
    return fusion.neighbours(seeds, rows).select("seed_ord", "offset", "ord")


def scene_expand(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.expanded(retrieval.stages(spark, sf))


def rescue_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Rare-term coverage of every row for every stated query."""
    s = retrieval.stages(spark, sf)
    return fusion.rare_coverage(s.asked, s.rows, "eval_id", "ord", s.postings.where("has_vec")).select("eval_id", "ord", F.round("rare_coverage", 6).alias("rare_coverage"))


def retrieve_single_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.stages(spark, sf).in_blocks(retrieval.unrouted).select("eval_id", "ord", "out_rank")


def retrieve_routed(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.stages(spark, sf, whole=True).in_blocks(retrieval.routed).select("eval_id", "ord", "book", F.round("score", 6).alias("score"), "out_rank")


def book_cap_backfill(spark: SparkSession, sf: str) -> DataFrame:
    s = retrieval.stages(spark, sf)
    cand = s.fused.where("fused_rank <= 30").join(s.rows.select("ord", "book"), "ord")
    return fusion.capped(cand, "eval_id", "book", "fused_rank", 10, 2).select("eval_id", "ord", "book", "out_rank")


def retrieve_online(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates of the online path, which are to be reranked: long tops, routed, as many as the cap."""
    return retrieval.candidates(retrieval.wide_stages(spark, sf, whole=True)).select("eval_id", "ord", F.round("base_score", 6).alias("base_score"), F.col("cand_rank").alias("out_rank"))


def rerank_select(spark: SparkSession, sf: str) -> DataFrame:
    s = retrieval.wide_stages(spark, sf, whole=True)
    return retrieval.rerank_select(s).select("eval_id", "ord", "book", "cand_rank", F.round("rerank_score", 6).alias("rerank_score"), "out_rank")


QUERIES = {f.__name__: f for f in (tokenize_terms, bm25_term_stats, bm25_corpus_stats, bm25_topk, dense_cosine_topk, next_chunk_cosine, max_normalize, hybrid_fusion_topk, book_route, neighbor_expand, scene_expand, rescue_evidence, retrieve_single_corpus, retrieve_routed, retrieve_online, book_cap_backfill, rerank_select)}

# SQL -----------------------------------------------------------------------------------------------------------------

BOOK = "CASE WHEN instr(id, '-') = 0 OR regexp_extract(id, '(?s)^(.*)-[^-]*$', 1) = '' THEN 'unknown' ELSE regexp_extract(id, '(?s)^(.*)-[^-]*$', 1) END"
USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def sql_terms(text: str) -> str:
    grams = ", ".join(f"list_transform(range(1, length(r) - {k - 2}), lambda i: substring(r, i, {k}))" for k in fixed.GRAMS)
    return f"flatten(list_transform(regexp_extract_all({text}, '[{CJK_CLASS}]+|[A-Za-z0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z0-9]') THEN [lower(r)] ELSE list_concat({grams}) END))"


def sql_cos(a: str, b: str) -> str:
    norms = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"(round(CASE WHEN {norms} = 0 THEN 0 ELSE list_dot_product({a}, {b}) / {norms} END, 9) + 0.0)"


STOP = ", ".join(f"'{t}'" for t in fixed.RESCUE_STOP_TERMS)
def base_parts(top_v: int, top_b: int) -> dict[str, str]:
    """Parts up to the routes, for these tops of the dense and BM25 lists."""
    depth = max(100, top_v, top_b)
    return {
        "ck": f"SELECT id, ord, coalesce(book_name, {BOOK}) AS book, chunk_index, coalesce(scene_id, 'scene-000') AS scene_id, coalesce(text, '') AS text, embedding, coalesce({USABLE}, false) AS has_vec FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM chunks) WHERE rn = 1",
        "q": "SELECT e.eval_id, e.question, e.gold_chunk_id, c.embedding AS qvec FROM (SELECT DISTINCT eval_id, coalesce(question, '') AS question, gold_chunk_id FROM eval_items WHERE eval_id % 20 = 0) e LEFT JOIN ck c ON c.id = e.gold_chunk_id AND c.has_vec",
        "vec": f"SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY cos DESC, ord) AS vec_rank FROM (SELECT q.eval_id, c.ord, c.book, {sql_cos('q.qvec', 'c.embedding')} AS cos FROM q JOIN ck c ON c.has_vec AND q.qvec IS NOT NULL)",
        "dense": f"SELECT * FROM vec WHERE vec_rank <= {depth}",
        "qt": f"SELECT eval_id, term, count(*) AS qc FROM (SELECT eval_id, unnest({sql_terms('question')}) AS term FROM q) GROUP BY ALL",
        "toks": f"SELECT *, len(ts) AS n_ts FROM (SELECT ord, book, has_vec, {sql_terms('text')} AS ts FROM ck)",
        "post": "SELECT ord, term, count(*) AS tf FROM (SELECT ord, unnest(ts) AS term FROM toks) GROUP BY ALL",
        "st": "SELECT count(*) AS n_docs, avg(n_ts) AS avg_len FROM toks",
        "sc": "SELECT qt.eval_id, p.ord, round(sum(qc * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * k.n_ts / avg_len))), 9) AS bm25 FROM qt JOIN post p USING (term) JOIN (SELECT term, count(*) AS df FROM post GROUP BY term) d USING (term) JOIN toks k ON k.ord = p.ord CROSS JOIN st GROUP BY ALL",
        "sp": "SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY bm25 DESC, ord) AS bm25_rank FROM sc WHERE bm25 > 0",
        "mx": f"SELECT coalesce(a.eval_id, b.eval_id) AS eval_id, a.m AS max_cos, b.m AS max_bm25 FROM (SELECT eval_id, max(cos) AS m FROM dense WHERE vec_rank <= {top_v} GROUP BY 1) a FULL JOIN (SELECT eval_id, max(bm25) AS m FROM sp WHERE bm25_rank <= {top_b} GROUP BY 1) b ON a.eval_id = b.eval_id",
        "fu0": f"SELECT coalesce(d.eval_id, h.eval_id) AS eval_id, coalesce(d.ord, h.ord) AS ord, CASE WHEN vec_rank <= {top_v} THEN cos ELSE 0 END AS v, coalesce(bm25, 0) AS b, vec_rank FROM dense d FULL JOIN (SELECT sp.* FROM sp JOIN ck USING (ord) WHERE has_vec AND bm25_rank <= {top_b}) h ON d.eval_id = h.eval_id AND d.ord = h.ord",
        "fused": "SELECT eval_id, ord, score, row_number() OVER (PARTITION BY eval_id ORDER BY score DESC, vec_rank NULLS LAST, ord) AS fused_rank FROM (SELECT f.eval_id, ord, vec_rank, round(0.8 * CASE WHEN max_cos > 0 THEN v / max_cos ELSE 0 END + 0.2 * CASE WHEN max_bm25 > 0 THEN b / max_bm25 ELSE 0 END, 9) AS score FROM fu0 f JOIN mx ON mx.eval_id = f.eval_id)",
        "rt0": f"SELECT eval_id, book, max(score) AS s, arg_max(-fused_rank, struct_pack(a := score, b := -fused_rank)) AS r FROM fused JOIN ck USING (ord) WHERE fused_rank <= {max(top_v, top_b, 40)} GROUP BY ALL",
        "rt1": f"SELECT eval_id, book, max(norm) AS s, arg_max(-bm25_rank, struct_pack(a := norm, b := -bm25_rank)) AS r FROM (SELECT sp.eval_id, sp.ord, bm25_rank, round(bm25 / max(bm25) OVER (PARTITION BY sp.eval_id), 9) AS norm FROM sp) JOIN ck USING (ord) WHERE has_vec AND bm25_rank <= {max(top_v, top_b, 40)} GROUP BY ALL",
        "routes": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY book_score DESC, best_rank, late, book) AS route_rank FROM (SELECT coalesce(f.eval_id, b.eval_id) AS eval_id, coalesce(f.book, b.book) AS book, CASE WHEN f.s IS NULL OR coalesce(b.s, -1e9) > f.s THEN b.s ELSE f.s END AS book_score, -CASE WHEN f.s IS NULL OR coalesce(b.s, -1e9) > f.s THEN b.r ELSE f.r END AS best_rank, f.s IS NULL AS late FROM rt0 f FULL JOIN rt1 b ON f.eval_id = b.eval_id AND f.book = b.book)) WHERE route_rank <= 5",
    }


PARTS = base_parts(fixed.VECTOR_TOP_N, fixed.BM25_TOP_N)
WHOLE = {"q": PARTS["q"].replace(" WHERE eval_id % 20 = 0", "")}  # in place of the stated queries


def with_parts(final: str, *names: str, more: dict[str, str] | None = None) -> str:
    """``final`` after the parts it needs, in their order."""
    every = PARTS | (more or {})
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({every[n]})" for n in every if n in names) + " " + final


def expand_sql(scope: str, ranked: str, pre: str, top_v: int, top_k: int) -> dict[str, str]:
    """Parts that expand scenes of ``ranked`` (scope, ord, rank) into ``{pre}out``, where the book, or without routing any row, has one.

    ``{pre}plain`` are the best rows where none has.
    """
    scened = "c.book IN (SELECT book FROM ck WHERE has_vec AND scene_id <> 'scene-000')" if "route_book" in scope else "(SELECT bool_or(scene_id <> 'scene-000') FROM ck WHERE has_vec)"
    cols = ", ".join(scope.split())
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in scope.split())
    pick = lambda a: ", ".join(f"{a}.{c}" for c in scope.split())
    return {
        f"{pre}cand": f"SELECT r.*, c.book AS bk, c.chunk_index, c.scene_id FROM {ranked} r JOIN ck c ON c.ord = r.ord WHERE rank <= {top_v} AND {scened}",
        f"{pre}plain": f"SELECT {pick('r')}, r.ord, rank AS out_rank FROM {ranked} r JOIN ck c ON c.ord = r.ord WHERE rank <= {top_k} AND NOT {scened}",
        f"{pre}scene": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {cols} ORDER BY best) AS scene_no FROM (SELECT {cols}, bk, scene_id, min(rank) AS best FROM {pre}cand GROUP BY ALL)) WHERE scene_no <= 3",
        f"{pre}near": f"SELECT {pick('a')}, c.ord, s.scene_no, 0 AS ph, a.rank AS p1, o AS p2 FROM {pre}cand a JOIN {pre}scene s ON {on('a', 's')} AND a.bk = s.bk AND a.scene_id = s.scene_id CROSS JOIN (SELECT unnest([-2, -1, 0, 1]) AS o) JOIN ck c ON c.book = a.bk AND c.chunk_index = a.chunk_index + o AND c.has_vec UNION ALL SELECT {pick('s')}, c.ord, s.scene_no, 1, 0, c.chunk_index FROM {pre}scene s JOIN ck c ON c.book = s.bk AND c.scene_id = s.scene_id AND c.has_vec",
        f"{pre}first": f"SELECT *, row_number() OVER (PARTITION BY {cols} ORDER BY scene_no, ph, p1, p2, ord) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {cols}, ord ORDER BY scene_no, ph, p1, p2) AS k FROM {pre}near) WHERE k = 1",
        f"{pre}out": f"SELECT {pick('f')}, f.ord, row_number() OVER (PARTITION BY {pick('f')} ORDER BY c.book, c.chunk_index, f.ord) AS out_rank FROM {pre}first f JOIN ck c ON c.ord = f.ord WHERE n <= {top_k}",
    }


def coverage_sql(by_book: bool, pre: str) -> dict[str, str]:
    """Parts that give rare-term coverage as ``{pre}cov``."""
    cols = "eval_id, route_book" if by_book else "eval_id"
    return {
        f"{pre}held": "SELECT DISTINCT p.ord, p.term" + (", c.book AS route_book" if by_book else "") + " FROM post p JOIN ck c ON c.ord = p.ord WHERE c.has_vec",
        f"{pre}df": f"SELECT term{', route_book' if by_book else ''}, count(*) AS df FROM {pre}held GROUP BY ALL",
        f"{pre}every": f"SELECT *, max(CASE WHEN rare THEN 1 ELSE 0 END) OVER (PARTITION BY {cols}) AS any_rare FROM (SELECT a.*, n, coalesce(df, 0) AS df, coalesce(df, 0) > 0 AND coalesce(df, 0) <= greatest(3, floor(n * 0.1)) AS rare FROM "
        + (
            f"(SELECT DISTINCT qt.eval_id, r.book AS route_book, term FROM qt JOIN routes r ON r.eval_id = qt.eval_id WHERE term NOT IN ({STOP})) a JOIN (SELECT book, count(*) AS n FROM ck WHERE has_vec GROUP BY 1) z ON z.book = a.route_book LEFT JOIN {pre}df d ON d.term = a.term AND d.route_book = a.route_book)"
            if by_book
            else f"(SELECT DISTINCT eval_id, term FROM qt WHERE term NOT IN ({STOP})) a CROSS JOIN (SELECT count(*) AS n FROM ck WHERE has_vec) LEFT JOIN {pre}df d ON d.term = a.term)"
        ),
        f"{pre}w": f"SELECT *, ln(1.0 + (n - df + 0.5) / (df + 0.5)) AS w FROM {pre}every WHERE rare OR any_rare = 0",
        f"{pre}tot": f"SELECT {cols}, sum(w) AS t FROM {pre}w GROUP BY ALL",
        f"{pre}cov": f"SELECT {', '.join('w.' + c for c in cols.split(', '))}, h.ord, round(CASE WHEN t > 0 THEN sum(w) / t ELSE 0 END, 9) AS rare_coverage FROM {pre}held h JOIN {pre}w w ON w.term = h.term{' AND w.route_book = h.route_book' if by_book else ''} JOIN {pre}tot s ON s.eval_id = w.eval_id{' AND s.route_book = w.route_book' if by_book else ''} GROUP BY {', '.join('w.' + c for c in cols.split(', '))}, h.ord, t",
    }


def rescue_sql(scope: str, base: str, dense: str, sp: str, cov: str, pre: str, top_v: int, top_b: int, top_k: int) -> dict[str, str]:
    """Parts that apply the rescue slot to ``base`` and give ``{pre}out``; ``dense`` and ``sp`` have a column rank."""
    cs = scope.split()
    cols = ", ".join(cs)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cs)
    pick = lambda a: ", ".join(f"{a}.{c}" for c in cs)
    return {
        f"{pre}slot": f"SELECT {cols}, ord AS slot FROM {base} WHERE out_rank = 5",
        f"{pre}seed": f"SELECT DISTINCT {pick('t')}, t.ord FROM (SELECT {cols}, ord FROM {dense} WHERE rank <= {top_v} UNION SELECT {cols}, ord FROM {sp} WHERE rank <= {top_b}) t JOIN {pre}slot s ON {on('t', 's')}",
        f"{pre}cand": f"SELECT * FROM (SELECT {pick('s')}, n.ord FROM {pre}seed s JOIN ck c ON c.ord = s.ord CROSS JOIN (SELECT unnest([-2, -1, 0, 1]) AS o) JOIN ck n ON n.book = c.book AND n.chunk_index = c.chunk_index + o AND n.has_vec UNION SELECT {cols}, slot FROM {pre}slot) x WHERE NOT EXISTS (SELECT 1 FROM {base} l WHERE l.out_rank < 5 AND l.ord = x.ord AND {on('l', 'x')})",
        f"{pre}most": f"SELECT {pick('s')}, v.m AS max_cos, b.m AS max_bm25 FROM {pre}slot s LEFT JOIN (SELECT {cols}, max(cos) AS m FROM {dense} WHERE rank <= {top_v} GROUP BY ALL) v ON {on('v', 's')} LEFT JOIN (SELECT {cols}, max(bm25) AS m FROM {sp} GROUP BY ALL) b ON {on('b', 's')}",
        f"{pre}ev0": f"SELECT {pick('x')}, x.ord, slot, round(CASE WHEN max_bm25 > 0 THEN coalesce(bm25, 0) / max_bm25 ELSE 0 END, 9) AS bn, round(CASE WHEN max_cos > 0 THEN coalesce(cos, 0) / max_cos ELSE 0 END, 9) AS vn, coalesce(rare_coverage, 0) AS rare FROM {pre}cand x JOIN {pre}slot s ON {on('s', 'x')} JOIN {pre}most m ON {on('m', 'x')} LEFT JOIN {dense} v ON {on('v', 'x')} AND v.ord = x.ord AND v.rank <= {top_v} LEFT JOIN {sp} b ON {on('b', 'x')} AND b.ord = x.ord LEFT JOIN {cov} c ON {on('c', 'x')} AND c.ord = x.ord",
        f"{pre}ev": f"SELECT *, max(CASE WHEN ord = slot THEN ev END) OVER (PARTITION BY {cols}) AS slot_ev, row_number() OVER (PARTITION BY {cols} ORDER BY ev DESC, bn DESC, rare DESC, ord) AS n FROM (SELECT *, round(0.7 * bn + 0.2 * rare + 0.1 * vn, 9) AS ev FROM {pre}ev0)",
        f"{pre}new": f"SELECT {cols}, ord AS new_ord FROM {pre}ev WHERE n = 1 AND ord <> slot AND bn >= 0.35 AND rare >= 0.2 AND ev >= 0.45 AND ev >= slot_ev + 0.08",
        f"{pre}out": f"SELECT * FROM (SELECT {cols}, ord, row_number() OVER (PARTITION BY {cols} ORDER BY r) AS out_rank FROM (SELECT {pick('b')}, b.ord, b.out_rank + CASE WHEN new_ord IS NOT NULL AND out_rank >= 5 THEN 0.5 ELSE 0 END AS r FROM {base} b LEFT JOIN {pre}new n ON {on('n', 'b')} WHERE new_ord IS NULL OR out_rank < 5 OR b.ord <> new_ord UNION ALL SELECT {cols}, new_ord, 5 FROM {pre}new)) WHERE out_rank <= {top_k}",
    }


BASE = ("ck", "q", "vec", "dense")
BM = ("ck", "q", "qt", "toks", "post", "st", "sc", "sp")
FUSED = (*dict.fromkeys((*BASE, *BM)), "mx", "fu0", "fused")
ROUTES = (*FUSED, "rt0", "rt1", "routes")
FR = {"fr": "SELECT eval_id, ord, score, fused_rank AS rank FROM fused"}
DR = {"dr": "SELECT eval_id, ord, cos, vec_rank AS rank FROM dense", "sr": "SELECT eval_id, ord, bm25, row_number() OVER (PARTITION BY eval_id ORDER BY bm25 DESC, ord) AS rank FROM sp JOIN ck USING (ord) WHERE has_vec"}
IN_BOOKS = {
    "bd": "SELECT r.eval_id, r.book AS route_book, v.ord, v.cos, row_number() OVER (PARTITION BY r.eval_id, r.book ORDER BY v.cos DESC, v.ord) AS rank FROM routes r JOIN vec v ON v.eval_id = r.eval_id AND v.book = r.book",
    "bb": "SELECT r.eval_id, r.book AS route_book, sp.ord, bm25, row_number() OVER (PARTITION BY r.eval_id, r.book ORDER BY bm25 DESC, sp.ord) AS rank FROM routes r JOIN sp ON sp.eval_id = r.eval_id JOIN ck ON ck.ord = sp.ord AND ck.book = r.book WHERE has_vec",
    "bf": "SELECT eval_id, route_book, ord, score, row_number() OVER (PARTITION BY eval_id, route_book ORDER BY score DESC, cos DESC, ord) AS rank FROM (SELECT bd.*, coalesce(f.score, 0) AS score FROM bd LEFT JOIN fused f ON f.eval_id = bd.eval_id AND f.ord = bd.ord)",
}
CAP = "SELECT {cols}, row_number() OVER (PARTITION BY eval_id ORDER BY inside DESC, {rank}) AS out_rank FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY eval_id, {book} ORDER BY {rank}) <= {cap} THEN 1 ELSE 0 END AS inside FROM {src})"


def single_parts(top_v: int, top_b: int, top_k: int) -> dict[str, str]:
    """Parts of the retrieval without routing, from the fused list to ``single``."""
    more = FR | DR | expand_sql("eval_id", "fr", "x_", top_v, top_k) | coverage_sql(False, "c_") | rescue_sql("eval_id", "x_out", "dr", "sr", "c_cov", "y_", top_v, top_b, top_k)
    return more | {"single": "SELECT * FROM y_out UNION ALL SELECT * FROM x_plain"}


def routed_parts(top_v: int, top_b: int, top_k: int, cap: int) -> dict[str, str]:
    """Parts of the routed retrieval, from the routes to ``routed`` and, with what a query without a row takes, ``retrieved``."""
    scope = "eval_id route_book"
    more = IN_BOOKS | expand_sql(scope, "bf", "x_", top_v, top_k) | coverage_sql(True, "c_") | rescue_sql(scope, "x_out", "bd", "bb", "c_cov", "y_", top_v, top_b, top_k)
    src = "(SELECT y.eval_id, y.route_book, y.ord, f.score, row_number() OVER (PARTITION BY y.eval_id ORDER BY f.score DESC, route_rank, y.out_rank) AS rank FROM (SELECT * FROM y_out UNION ALL SELECT * FROM x_plain) y JOIN bf f ON f.eval_id = y.eval_id AND f.ord = y.ord AND f.route_book = y.route_book JOIN routes r ON r.eval_id = y.eval_id AND r.book = y.route_book)"
    more["routed"] = "SELECT * FROM (" + CAP.format(cols="*", rank="rank", book="route_book", cap=cap, src=src) + f") WHERE out_rank <= {top_k}"
    more["retrieved"] = f"SELECT eval_id, ord, score, out_rank FROM routed UNION ALL SELECT eval_id, ord, score, fused_rank FROM fused WHERE fused_rank <= {top_k} AND eval_id NOT IN (SELECT eval_id FROM routed)"
    return more


SINGLE = single_parts(fixed.VECTOR_TOP_N, fixed.BM25_TOP_N, fixed.TOP_K)
ROUTED = routed_parts(fixed.VECTOR_TOP_N, fixed.BM25_TOP_N, fixed.TOP_K, fixed.BOOK_CAP)
WIDE = base_parts(fixed.WIDE_TOP_N, fixed.WIDE_TOP_N) | routed_parts(fixed.WIDE_TOP_N, fixed.WIDE_TOP_N, fixed.RERANK_CANDIDATES, fixed.RERANK_CANDIDATES)
RERANK = WIDE | {
    "rr0": f"SELECT f.eval_id, f.ord, c.book, f.score AS base_score, f.out_rank AS cand_rank, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, {sql_terms('c.text')})) / len(a) ELSE 0 END, 9) AS rerank_score FROM retrieved f JOIN ck c ON c.ord = f.ord JOIN (SELECT eval_id, list_distinct({sql_terms('question')}) AS a FROM q) z ON z.eval_id = f.eval_id",
    "rr": "SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY rerank_score DESC, cand_rank) AS rerank_rank FROM rr0",
    "rs": "SELECT * FROM (" + CAP.format(cols="*", rank="rerank_rank", book="book", cap=fixed.BOOK_CAP, src="rr") + f") WHERE out_rank <= {fixed.TOP_K}",
}

ORACLE = {
    "tokenize_terms": f"SELECT ord, len(ts) AS n_terms, len(list_distinct(ts)) AS n_distinct, list_max(ts) AS last_term FROM (SELECT ord, {sql_terms('text')} AS ts FROM chunks WHERE text IS NOT NULL)",
    "bm25_term_stats": with_parts("SELECT term, count(*) AS df, sum(tf) AS tf FROM post GROUP BY 1", "ck", "toks", "post"),
    "bm25_corpus_stats": with_parts("SELECT n_docs, round(avg_len, 6) AS avg_len FROM st", "ck", "toks", "st"),
    "bm25_topk": with_parts("SELECT eval_id, ord, round(bm25, 6) AS bm25, bm25_rank FROM sp WHERE bm25_rank <= 20", *BM, more=WHOLE),
    "dense_cosine_topk": with_parts("SELECT eval_id, ord, round(cos, 6) AS cos, vec_rank FROM dense WHERE vec_rank <= 20", *BASE),
    "next_chunk_cosine": with_parts(f"SELECT a.ord, b.ord AS next_ord, round({sql_cos('a.embedding', 'b.embedding')}, 6) + 0.0 AS cos FROM ck a JOIN ck b ON a.book = b.book AND b.chunk_index = a.chunk_index + 1 WHERE a.has_vec AND b.has_vec", "ck"),
    "max_normalize": with_parts("SELECT eval_id, ord, round(bm25 / max(bm25) OVER (PARTITION BY eval_id), 6) AS norm FROM sp", *BM),
    "hybrid_fusion_topk": with_parts("SELECT eval_id, ord, round(score, 6) AS score, fused_rank FROM fused WHERE fused_rank <= 30", *FUSED),
    "book_route": with_parts("SELECT eval_id, book, round(book_score, 6) AS book_score, route_rank FROM routes", *ROUTES),
    "neighbor_expand": with_parts("SELECT s.ord AS seed_ord, o AS \"offset\", n.ord FROM ck s CROSS JOIN (SELECT unnest([-2, -1, 0, 1]) AS o) JOIN ck n ON n.book = s.book AND n.chunk_index = s.chunk_index + o", "ck"),
    "scene_expand": with_parts("SELECT eval_id, ord, out_rank FROM x_out UNION ALL SELECT eval_id, ord, out_rank FROM x_plain", *FUSED, *SINGLE, more=SINGLE),
    "rescue_evidence": with_parts("SELECT eval_id, ord, round(rare_coverage, 6) AS rare_coverage FROM c_cov", *BM, *coverage_sql(False, "c_"), more=coverage_sql(False, "c_")),
    "retrieve_single_corpus": with_parts("SELECT eval_id, ord, out_rank FROM single", *FUSED, *SINGLE, more=SINGLE),
    "retrieve_routed": with_parts("SELECT eval_id, ord, route_book AS book, round(score, 6) AS score, out_rank FROM routed", *ROUTES, *ROUTED, more=ROUTED | WHOLE),
    "retrieve_online": with_parts("SELECT eval_id, ord, round(score, 6) AS base_score, out_rank FROM retrieved", *WIDE, more=WIDE | WHOLE),
    "book_cap_backfill": with_parts("SELECT eval_id, ord, book, out_rank FROM (" + CAP.format(cols="*", rank="fused_rank", book="book", cap=2, src="(SELECT f.*, c.book FROM fused f JOIN ck c ON c.ord = f.ord WHERE fused_rank <= 30)") + ") WHERE out_rank <= 10", *FUSED),
    "rerank_select": with_parts("SELECT eval_id, ord, book, cand_rank, round(rerank_score, 6) AS rerank_score, out_rank FROM rs", *RERANK, more=RERANK | WHOLE),
}
