"""Registered queries of texts, entities, evaluation and usage, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.clients import HashEmbedder, OverlapScorer
from quillspark.functions import exprs, fixed
from quillspark.operators import answers, evaluate, fusion, rerank, rewrite, text, usage
from quillspark.plans import retrieval
from quillspark.plans.retrieval_queries import FUSED, PARTS, RERANK, ROUTED, ROUTES, WHOLE, sql_terms, with_parts
from quillspark.session import delete, saved, saved_parts, scratch, small_files, spread, table
from quillspark.sources.relations import SourceError, cache_key, read_cache, read_chunks, read_texts, split_by_cache, write_cache, write_chunks, write_json_lines, write_texts
from quillspark.streaming import usage as stream

TITLE = exprs.is_chapter_title


def scan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    return c.select("ord", "id", F.coalesce("book_name", exprs.book_from_id(F.col("id"))).alias("book"), "chapter_title", F.coalesce("chapter_index", F.lit(0)).alias("chapter_index"), F.coalesce("scene_index", F.lit(0)).alias("scene_index"), F.coalesce("scene_id", F.lit(fixed.NO_SCENE)).alias("scene_id"), F.length("text").alias("n_chars"), F.size("embedding").alias("n_dims"))


def book_stats(spark: SparkSession, sf: str) -> DataFrame:
    return usage.book_stats(table(spark, sf, "chunks"))


def book_from_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select("eval_id", exprs.book_from_id(F.col("gold_chunk_id")).alias("book"))


def natural_order(spark: SparkSession, sf: str) -> DataFrame:
    """Books in the order in which numbers in their names count as numbers."""
    books = retrieval.chunks_once(spark, sf).groupBy("book").agg(F.count("*").alias("n"))
    keyed = books.withColumn("key", exprs.natural_key(F.col("book")))
    before = F.lag("book").over(Window.partitionBy(F.regexp_extract("key", r"^(\D*)", 1)).orderBy("key", "book"))
    return keyed.select("book", "n", before.alias("before"))


def line_units(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"))
    return text.text_units(docs, "doc_id", "text").select("doc_id", "line_no", "start", F.length("line").alias("n_chars"), "chapter_index", "scene_index", "scene_id")


def chunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every chunk text with their offsets."""
    c = table(spark, sf, "chunks")
    return text.lines(c, "ord", "text").select("ord", "line_no", "start", "line")


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(exprs.sentences(F.col("text"))).alias("sentence_no", "sentence"))
    return docs.select("doc_id", "sentence_no", "sentence")


def chunk_pack_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as books: chunks with overlap, scene by scene."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text")
    return text.build_chunks(docs, "doc_id", "text")


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = text.numbered(retrieval.chunks_once(spark, sf).select("ord", "book", "chunk_index"), "book", "chunk_index", "ord")
    width = F.greatest(F.lit(6), F.length(F.col("of").cast("string")))
    return c.select("ord", "book", "n", F.concat("book", F.lit("-"), F.lpad(F.col("n").cast("string"), width, F.lit("0"))).alias("new_id"))


def chapter_titles(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").where("chapter_title is not null")
    return c.select("ord", TITLE(F.col("chapter_title")).alias("is_title"), exprs.inline_blanks(F.col("chapter_title")).alias("title"))


def paragraph_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every chunk as a paragraph is kept: blanks collapsed, star lines as separator, credit lines empty."""
    rows = text.lines(table(spark, sf, "chunks"), "ord", "text")
    return rows.select("ord", "line_no", exprs.paragraph_form(F.col("line")).alias("para"))


def consecutive_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each book whose title is not that of the chunk before."""
    c = retrieval.chunks_once(spark, sf).select("id", "book", "chunk_index")
    titles = table(spark, sf, "chunks").groupBy("id").agg(F.min("chapter_title").alias("title"))
    return text.drop_repeats(c.join(titles, "id"), "book", "chunk_index", "title").select("id", "title")


def front_matter_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every document from its second line that asks something, read as titles and front matter."""
    rows = text.lines(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "line_no", F.when(F.contains("line", F.lit("？")), F.concat(F.lit("第1话 "), "line")).otherwise(F.col("line")).alias("para"))
    return text.trim_front(rows, "doc_id", "line_no", "para").select("doc_id", "line_no")


def contents_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of each book's chunks, put after a heading of contents: what is left once the contents are dropped."""
    titled = table(spark, sf, "chunks").where("chapter_title is not null").groupBy("id").agg(F.min("ord").alias("n"), F.min("chapter_title").alias("para"), F.min(F.coalesce("book_name", exprs.book_from_id(F.col("id")))).alias("book"))
    heads = titled.groupBy("book").agg((F.min("n") - 1).alias("n")).withColumn("para", F.lit("ＣＯＮＴＥＮＴＳ"))
    every = titled.select("book", "n", "para").unionByName(heads.select("book", "n", "para"))
    return text.drop_contents(every, "book", "n", "para").select("book", "n")


def html_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of HTML, and the paragraphs read from them."""
    docs = spread(table(spark, sf, "documents")).where("text is not null")
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    page = F.concat(F.lit("<html><head><title>x</title><style>p{}</style></head><body><h1>"), F.coalesce("chapter_title", F.lit("")), F.lit("</h1><p>"), F.regexp_replace(safe, r"\n+", "</p><p>"), F.lit("</p><script>var a;</script></body></html>"))
    return text.html_paragraphs(docs.select("doc_id", page.alias("html")), "doc_id", "html")


def text_preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").where("text is not null").select("ord", exprs.preview(F.col("text")).alias("preview"))


def paragraph_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").where("text is not null").select("ord", exprs.paragraph_count(F.col("text")).alias("n_paragraphs"), F.length("text").alias("n_chars"))


def entity_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return rewrite.entity_aliases(table(spark, sf, "entities")).select("id", "canonical", F.posexplode("aliases").alias("alias_pos", "alias"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").where("question is not null").select("eval_id", "question").distinct()


def entity_match(spark: SparkSession, sf: str) -> DataFrame:
    return rewrite.mentions(_questions(spark, sf), "eval_id", "question", table(spark, sf, "entities")).select("eval_id", "id", "alias", "pos")


def entity_full_names(spark: SparkSession, sf: str) -> DataFrame:
    return rewrite.full_names(table(spark, sf, "entities"))


def entity_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    return rewrite.rewrites(_questions(spark, sf), "eval_id", "question", table(spark, sf, "entities"))


def merge_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The fused, dense and BM25 lists of each stated query merged."""
    s = retrieval.stages(spark, sf)
    lists = s.fused.where("fused_rank <= 10").select("eval_id", "ord", F.lit(0).alias("list_no"), F.col("fused_rank").alias("rank"), "score")
    lists = lists.unionByName(s.dense.where("vec_rank <= 10").select("eval_id", "ord", F.lit(1).alias("list_no"), F.col("vec_rank").alias("rank"), F.col("cos").alias("score")))
    lists = lists.unionByName(s.sparse.where("bm25_rank <= 10").select("eval_id", "ord", F.lit(2).alias("list_no"), F.col("bm25_rank").alias("rank"), (F.col("bm25") / 100).alias("score")))
    return rewrite.merge_lists(lists, "eval_id", "ord", "list_no", "rank", "score").select("eval_id", "ord", "hits", F.round("best_score", 6).alias("best_score"), "out_rank")


LISTS = fixed.REWRITE_LIMIT + 1  # a question and its rewrites


def retrieve_with_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """Each stated question and its rewrites retrieved by themselves in one plan, and their results merged.

    A rewrite has the vector of its question, as there is no model here to embed it.
    """
    asked = saved(retrieval.stated_queries(spark, sf, retrieval.chunks_once(spark, sf)), "asked")
    other = rewrite.rewrites(asked, "eval_id", "question", table(spark, sf, "entities"))
    every = asked.withColumn("eval_id", F.col("eval_id") * LISTS).unionByName(other.join(asked.drop("question"), "eval_id").select((F.col("eval_id") * LISTS + F.col("rewrite_no")).alias("eval_id"), F.col("rewrite").alias("question"), "gold_chunk_id", "qvec"))
    found = retrieval.retrieve(retrieval.Stages(spark, sf, queries=every), fixed.TOP_K, fixed.BOOK_CAP)
    lists = found.select(F.floor(F.col("eval_id") / LISTS).alias("eval_id"), "ord", (F.col("eval_id") % LISTS).alias("list_no"), F.col("out_rank").alias("rank"), F.col("base_score").alias("score"))
    return rewrite.merge_lists(lists, "eval_id", "ord", "list_no", "rank", "score").select("eval_id", "ord", "hits", F.round("best_score", 6).alias("best_score"), "out_rank")


def answer_insufficient(spark: SparkSession, sf: str) -> DataFrame:
    return usage.once(table(spark, sf, "visitor_queries")).select("id", exprs.insufficient(F.col("answer")).alias("insufficient"))


def answerability_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements written around each answer in several shapes, and what is read from them."""
    items = table(spark, sf, "eval_items").select("eval_id", "reference_answer")
    body = F.to_json(F.struct((F.col("eval_id") % 3 == 0).alias("answerable"), F.array(F.lit(" a "), F.lit("a"), F.lit("")).alias("missing_info"), F.array(F.coalesce("reference_answer", F.lit(""))).alias("clarification_questions")))
    reply = F.when(F.col("eval_id") % 4 == 0, body).when(F.col("eval_id") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("eval_id") % 4 == 2, F.concat(F.lit("Sure: "), body, F.lit(" ."))).otherwise(F.col("reference_answer"))
    j = answers.judgement(reply)
    return items.select("eval_id", j["answerable"].alias("answerable"), F.size(j["missing_info"]).alias("n_missing"), F.size(j["clarification_questions"]).alias("n_questions"))


def context_format(spark: SparkSession, sf: str) -> DataFrame:
    s = retrieval.stages(spark, sf)
    top = s.texts_of(s.fused.where("fused_rank <= 5").join(s.rows.select("ord", "id", "book"), "ord"))
    return answers.context_block(top, "eval_id", "fused_rank", "book", "id", "score", "text").select("eval_id", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5"), F.regexp_count("context", F.lit(r"\[片段 ")).alias("n_passages"))


def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of the log whose key no evaluation question has: those a cache of these would leave to compute."""
    asked = F.regexp_replace("question", r"(?U)^\s+|\s+$", "").alias("question")
    log = table(spark, sf, "visitor_queries").where("question is not null").select(asked).distinct().withColumn("key", cache_key("question"))
    cache = table(spark, sf, "eval_items").where("question is not null").select(asked).distinct().select(cache_key("question").alias("key"))
    return split_by_cache(log, cache)[1].select("key", "question")


def sample_exact(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.sample_exact(retrieval.chunks_once(spark, sf).select("id", "book"), "id")


def sample_stratified(spark: SparkSession, sf: str) -> DataFrame:
    """Three chunks of every book, chosen by hash."""
    return evaluate.sample_stratified(retrieval.chunks_once(spark, sf).select("id", "book"), "id", "book", 3)


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    s = retrieval.wide_stages(spark, sf, whole=True)
    every = retrieval.reranked(s)
    final = fusion.capped(every, "eval_id", "book", "rerank_rank", fixed.TOP_K, fixed.BOOK_CAP)
    ids = s.rows.select("ord", "id")
    items = _items(spark, sf, s)
    for results, rank, name in ((final, "out_rank", "gold_rank"), (every, "cand_rank", "candidate_rank"), (every, "rerank_rank", "unbounded_rank")):
        items = evaluate.gold_ranks(items, results.select("eval_id", "ord", rank).join(ids, "ord"), "eval_id", "gold_chunk_id", "id", rank, name)
    out = evaluate.scored(items)
    reason = evaluate.failure_reason(F.col("gold_rank"), F.col("candidate_rank"), F.col("unbounded_rank"))
    return out.withColumn("failure_reason", reason).withColumn("book", evaluate.gold_book(F.col("gold_book_name"), F.col("gold_chunk_id")))


def _items(spark: SparkSession, sf: str, s: retrieval.Stages) -> DataFrame:
    return s.queries.select("eval_id", "gold_chunk_id").join(table(spark, sf, "eval_items").select("eval_id", "gold_book_name").distinct(), "eval_id")


def rerank_cached(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates scored by the model's stand-in, where half of the scores come from a cache written and read before."""
    s = retrieval.stages(spark, sf)
    pairs = s.texts_of(s.fused.where("fused_rank <= 30").join(s.rows.select("ord", "id"), "ord")).join(s.queries.select("eval_id", "question"), "eval_id")
    pairs = saved(pairs.select("eval_id", "ord", "id", "question", "text", F.col("fused_rank").alias("cand_rank")), "pairs")
    path = f"{scratch(spark)}/scores-{uuid.uuid4().hex}"
    none = spark.createDataFrame([], "key string, score double")
    write_cache(rerank.cached_scores(pairs.where("ord % 2 = 0"), none, OverlapScorer())[1], path)
    every, grown, stats = rerank.cached_scores(pairs, read_cache(spark, path, "score double"), OverlapScorer())
    return every.select("eval_id", "ord", F.round("rerank_score", 6).alias("rerank_score")).crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(grown.agg(F.count("*").alias("in_cache"))))  # one row each


def eval_results(spark: SparkSession, sf: str) -> DataFrame:
    """The table of results that an evaluation leaves behind: each item with what was retrieved for it, written and read again."""
    s = retrieval.wide_stages(spark, sf)
    path = f"{scratch(spark)}/results-{uuid.uuid4().hex}"
    write_json_lines(evaluate.results_table(_items(spark, sf, s), s.texts_of(retrieval.rerank_select(s).join(s.rows.select("ord", "id"), "ord")), "eval_id"), path)
    back = spark.read.schema("eval_id bigint, gold_chunk_id string, retrieved_chunks array<struct<chunk_id: string, book_name: string, base_score: double, rerank_score: double, text_preview: string>>").json(path)
    return back.select("eval_id", "gold_chunk_id", F.posexplode("retrieved_chunks").alias("place", "r")).select("eval_id", "gold_chunk_id", "place", F.col("r.chunk_id").alias("chunk_id"), F.col("r.book_name").alias("book_name"), F.round("r.base_score", 6).alias("base_score"), F.round("r.rerank_score", 6).alias("rerank_score"), F.md5("r.text_preview").alias("preview_md5"))


def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk index written as lines of JSON and as parquet by book, read again, and both joined."""
    c = retrieval.chunks_once(spark, sf).where("has_vec").select("id", F.col("book").alias("book_name"), "chunk_index", F.lit(0).alias("start"), F.length("text").alias("end"), "text", "scene_id", "embedding")
    base = f"{scratch(spark)}/index-{uuid.uuid4().hex}"
    write_chunks(c, f"{base}/lines", "json")
    write_chunks(c.withColumn("ord", F.lit(0).cast("long")), f"{base}/books")
    lines, books = read_chunks(spark, f"{base}/lines"), read_chunks(spark, f"{base}/books", "parquet")
    same = lines.join(books.select("id", F.col("text").alias("other")), "id").where(F.col("text") == F.col("other"))
    every = F.count("*").over(Window.partitionBy())
    return same.withColumn("n", every).select("id", "book_name", "chunk_index", "scene_id", "chapter_index", F.md5("text").alias("text_md5"), F.round(F.element_at("embedding", 1), 6).alias("first_value"), ((F.col("ord") >= 0) & (F.col("ord") < F.col("n"))).alias("counted"))


TEXTS_A_ROUND, ROUNDS = 20_000, 16  # a file holds a block of the disk at least


def texts_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as text files, one for each, and read again; in rounds whose files are deleted when they are read."""
    every = table(spark, sf, "documents")
    rounds = max(1, min(ROUNDS, -(-every.count() // TEXTS_A_ROUND)))

    def texts(own: DataFrame) -> DataFrame:
        return own.where(F.regexp_replace("text", r"(?U)\s+", "") != "").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("book_name"), "text")

    def parts() -> Iterator[DataFrame]:
        for i in range(rounds):
            own = texts(every.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == i))
            if rounds > 1 and own.isEmpty():
                continue
            path = f"{scratch(spark)}/texts-{uuid.uuid4().hex}"
            counts = write_texts(own, path)
            with small_files(spark):
                yield read_texts(spark, path).select("book_name", F.md5("text").alias("text_md5")).join(counts, "book_name")
            delete(spark, path)

    if texts(every).isEmpty():
        raise SourceError("no text to write")
    return saved_parts(parts(), "texts-read")


def embeddings_cached(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with vectors of the stand-in, half of them from a cache."""
    questions = _questions(spark, sf)
    none = spark.createDataFrame([], "key string, embedding array<double>")
    half = rerank.cached_embeddings(questions.where("eval_id % 2 = 0"), none, HashEmbedder(), "hash")[1]
    every, grown = rerank.cached_embeddings(questions, half, HashEmbedder(), "hash")
    return every.select("eval_id", F.size("embedding").alias("n_dims")).crossJoin(F.broadcast(grown.agg(F.count("*").alias("in_cache"))))  # one row


def evaluate_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation without reranking: the routed retrieval is the result, and there are no candidates beside it."""
    s = retrieval.stages(spark, sf, whole=True)
    found = retrieval.retrieve(s, fixed.TOP_K, fixed.BOOK_CAP).join(s.rows.select("ord", "id"), "ord")
    items = evaluate.gold_ranks(_items(spark, sf, s), found, "eval_id", "gold_chunk_id", "id", "out_rank")
    out = evaluate.scored(items.withColumn("candidate_rank", F.lit(None).cast("int")))
    reason = evaluate.failure_reason(F.col("gold_rank"), F.col("candidate_rank"), F.lit(None).cast("int"))
    return out.select("eval_id", "gold_rank", "hit_at_1", "hit_at_3", "hit_at_5", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), reason.alias("failure_reason"))


def run_evaluation(spark: SparkSession, sf: str, out: str) -> DataFrame:
    """The whole flow: evaluates all items, writes ``results`` and ``metrics`` under ``out``, returns the metrics.

    No items raise, as there is nothing to evaluate.
    """
    results = saved(_evaluated(spark, sf), "evaluated")
    if results.isEmpty():
        raise ValueError("no evaluation items")
    write_json_lines(results, f"{out}/results")
    metrics = saved(evaluate.metrics(results, "book"), "metrics")
    write_json_lines(metrics, f"{out}/metrics")
    return metrics


def gold_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf).select("eval_id", "gold_rank", "candidate_rank", "hit_at_1", "hit_at_3", "hit_at_5", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "failure_reason")


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metrics(_evaluated(spark, sf))


def eval_metrics_by_book(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metrics(_evaluated(spark, sf), "book")


def representative_failures(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.representative_failures(_evaluated(spark, sf), "eval_id").select("eval_id", "gold_chunk_id", "failure_reason")


def daily_usage(spark: SparkSession, sf: str) -> DataFrame:
    return usage.daily_usage(usage.once(table(spark, sf, "visitor_queries")))


def usage_order(spark: SparkSession, sf: str) -> DataFrame:
    return usage.in_order(usage.once(table(spark, sf, "visitor_queries"))).select("id", "day_rank")


def usage_recount(spark: SparkSession, sf: str) -> DataFrame:
    return usage.recount(usage.once(table(spark, sf, "visitor_queries")), table(spark, sf, "visitor_daily_usage"))


def usage_stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    counts = stream.daily_counts(stream.read_log(spark, f"{sf}/visitor_queries.parquet"))
    return stream.run_once(counts, uuid.uuid4().hex)


def event_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Events by user and day."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.greatest(F.lit(fixed.DAILY_QUOTA) - F.count("*"), F.lit(0)).alias("remaining"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_chunks, book_stats, book_from_id, natural_order, line_units, chunk_lines, sentence_split, chunk_pack_overlap, chunk_ids, chapter_titles, paragraph_forms, consecutive_dedup, front_matter_trim,
        contents_drop, html_paragraphs, text_preview, paragraph_counts, entity_aliases, entity_match, entity_full_names, entity_rewrites, merge_contexts, retrieve_with_rewrites, answer_insufficient, answerability_parse, context_format,
        cache_misses, sample_exact, sample_stratified, rerank_cached, eval_results, index_round_trip, texts_round_trip, embeddings_cached, evaluate_plain, gold_rank, eval_metrics, eval_metrics_by_book, representative_failures, daily_usage, usage_order, usage_recount, usage_stream_daily, event_usage,
    )
}
# SQL -----------------------------------------------------------------------------------------------------------------

def _put(pattern: str, value: str) -> str:
    return pattern.replace("{0}", value)


WS = r"[\s\x{0B}\x{85}\p{Z}]"
TITLE_RE = fixed.CHAPTER_TITLE.replace("\\s", WS).replace("\\d]", "\\p{Nd}]")
STARS = fixed.STAR_LINE.replace("\\s", WS)
ENDS = fixed.SENTENCE_ENDS
BOOK_OF = "CASE WHEN instr({0}, '-') = 0 OR regexp_extract({0}, '(?s)^(.*)-[^-]*$', 1) = '' THEN 'unknown' ELSE regexp_extract({0}, '(?s)^(.*)-[^-]*$', 1) END"
ONE = "regexp_replace(regexp_replace({0}, '" + WS + "+', ' ', 'g'), '^ | $', '', 'g')"
CREDIT = "(" + " OR ".join("starts_with({0}, '" + p + "')" for p in fixed.CREDIT_PREFIXES) + ")"
FORM = "CASE WHEN " + CREDIT + " THEN '' WHEN regexp_matches({0}, '" + STARS + "') THEN '★★★' ELSE {0} END"


def lines_sql(key: str, source: str) -> str:
    raw = f"SELECT {key}, unnest(ls) AS raw, unnest(range(0, len(ls))) AS line_no FROM (SELECT {key}, string_split_regex(text, '[\\r\\n]') AS ls FROM {source})"
    cut = f"SELECT *, regexp_replace(raw, '^{WS}+', '') AS lt, coalesce(sum(length(raw) + 1) OVER (PARTITION BY {key} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ({raw})"
    return f"SELECT {key}, line_no, regexp_replace(lt, '{WS}+$', '') AS line, (b + length(raw) - length(lt))::BIGINT AS start FROM ({cut}) WHERE regexp_replace(lt, '{WS}+$', '') <> ''"


ALIASES = f"SELECT id, entity_type, canonical, alias, (row_number() OVER (PARTITION BY id ORDER BY p) - 1)::INTEGER AS alias_pos FROM (SELECT id, entity_type, canonical, alias, min(p) AS p FROM (SELECT id, entity_type, trim(canonical) AS canonical, regexp_replace(unnest(l), '^{WS}+|{WS}+$', '', 'g') AS alias, unnest(range(0, len(l))) AS p FROM (SELECT *, list_concat([canonical], coalesce(aliases, [])) AS l FROM entities WHERE trim(canonical) <> '')) WHERE alias <> '' GROUP BY ALL)"
QUESTIONS = "SELECT DISTINCT eval_id, question FROM eval_items WHERE question IS NOT NULL"
MENTIONS = "SELECT * FROM (SELECT q.eval_id, q.question, a.id, a.canonical, a.alias, instr(q.question, a.alias) AS pos, row_number() OVER (PARTITION BY q.eval_id, a.id ORDER BY length(a.alias) DESC, alias_pos) AS k FROM qs q JOIN al a ON a.alias <> a.canonical AND instr(q.question, a.alias) > 0 AND (instr(q.question, a.canonical) = 0 OR instr(a.alias, a.canonical) > 0)) WHERE k = 1"
FULL = "SELECT id, alias AS full_name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY starts_with(alias, canonical) DESC, length(alias) DESC, alias_pos) AS k FROM al WHERE alias <> canonical AND instr(alias, canonical) > 0) WHERE k = 1"
PUT = "substring(question, 1, pos - 1) || {0} || substring(question, pos + length(alias))"
REWRITES = {
    "al": ALIASES,
    "qs": QUESTIONS,
    "me": MENTIONS,
    "fn": FULL,
    "op": f"SELECT eval_id, question, m, unnest([0, 1, 2]) AS o, unnest([{_put(PUT, 'canonical')}, {_put(PUT, "alias || ' ' || canonical || ' '")}, {_put(PUT, 'full_name')}]) AS r FROM (SELECT me.*, full_name, row_number() OVER (PARTITION BY eval_id ORDER BY pos, length(alias) DESC, id) AS m FROM me LEFT JOIN fn USING (id))",
    "rw": f"SELECT eval_id, r, min((m, o)) AS first_at FROM (SELECT eval_id, question, m, o, regexp_replace(r, '^{WS}+|{WS}+$', '', 'g') AS r FROM op) WHERE r <> '' AND r <> question GROUP BY 1, 2",
}
WITH_REWRITES = (
    {"ck": PARTS["ck"], "q0": PARTS["q"], **REWRITES, "qs": "SELECT eval_id, question FROM q0"}
    | {"rws": "SELECT * FROM (SELECT eval_id, row_number() OVER (PARTITION BY eval_id ORDER BY first_at) AS rewrite_no, r AS rewrite FROM rw) WHERE rewrite_no <= 3"}
    | {"q": "SELECT eval_id * 4 AS eval_id, question, gold_chunk_id, qvec FROM q0 UNION ALL SELECT eval_id * 4 + rewrite_no, rewrite, gold_chunk_id, qvec FROM q0 JOIN rws USING (eval_id)"}
    | {n: q for n, q in PARTS.items() if n not in ("ck", "q")}
    | ROUTED
)
DAY = "(DATE '1970-01-01' + CAST(epoch_us(created_at) // 86400000000 AS INTEGER))"
LOG = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS rn FROM visitor_queries) WHERE rn = 1"
USED = f"SELECT visitor_id, {DAY} AS usage_date, count(*) AS asked FROM ({LOG}) WHERE coalesce(used_custom_api_key, 0) = 0 GROUP BY ALL"
EVALUATED = RERANK | {
    "ev0": "SELECT q.eval_id, q.gold_chunk_id, coalesce(e.gold_book_name, " + _put(BOOK_OF, "q.gold_chunk_id") + ") AS book, f.out_rank AS gold_rank, c.cand_rank AS candidate_rank, c.rerank_rank AS unbounded FROM q JOIN (SELECT DISTINCT eval_id, gold_book_name FROM eval_items) e ON e.eval_id = q.eval_id LEFT JOIN ck ON ck.id = q.gold_chunk_id LEFT JOIN rs f ON f.eval_id = q.eval_id AND f.ord = ck.ord LEFT JOIN rr c ON c.eval_id = q.eval_id AND c.ord = ck.ord",
    "ev": "SELECT *, coalesce(gold_rank <= 1, false) AS hit_at_1, coalesce(gold_rank <= 3, false) AS hit_at_3, coalesce(gold_rank <= 5, false) AS hit_at_5, coalesce(1.0 / gold_rank, 0)::DOUBLE AS reciprocal_rank, CASE WHEN gold_rank IS NOT NULL THEN NULL WHEN candidate_rank IS NULL THEN 'candidate_miss' WHEN unbounded <= 5 THEN 'book_cap_filtered' ELSE 'rerank_lost' END AS failure_reason FROM ev0",
}
PLAIN = ROUTED | {
    "pl": "SELECT q.eval_id, f.out_rank AS gold_rank FROM q JOIN (SELECT DISTINCT eval_id, gold_book_name FROM eval_items) e ON e.eval_id = q.eval_id LEFT JOIN ck ON ck.id = q.gold_chunk_id LEFT JOIN retrieved f ON f.eval_id = q.eval_id AND f.ord = ck.ord",
}
METRICS = "count(*) AS n, round(coalesce(avg(hit_at_1::INT), 0), 6) AS recall_at_1, round(coalesce(avg(hit_at_3::INT), 0), 6) AS recall_at_3, round(coalesce(avg(hit_at_5::INT), 0), 6) AS recall_at_5, round(coalesce(avg(reciprocal_rank), 0), 6) AS mrr, round(avg(gold_rank), 6) AS avg_gold_rank, count(*) FILTER (gold_rank IS NULL) AS missed, round(coalesce(avg((candidate_rank IS NOT NULL)::INT), 0), 6) AS candidate_hit_rate, count(*) FILTER (candidate_rank IS NULL) AS candidate_miss, count(*) FILTER (candidate_rank IS NOT NULL AND gold_rank IS NULL) AS rerank_lost"
CK_TITLES = "SELECT k.id, k.book, k.chunk_index, t.title FROM ck k JOIN (SELECT id, min(chapter_title) AS title FROM chunks GROUP BY 1) t ON t.id = k.id"
TITLED = "SELECT id, min(ord) AS n, min(chapter_title) AS para, min(coalesce(book_name, " + _put(BOOK_OF, "id") + ")) AS book FROM chunks WHERE chapter_title IS NOT NULL GROUP BY id"

PREVIEW = "CASE WHEN length({0}) > 220 THEN substring({0}, 1, 220) || '...' ELSE {0} END"
PACK = {
    "un": f"SELECT *, CASE WHEN chapter_index > 0 OR scene_index > 0 THEN printf('chapter-%03d-scene-%03d', chapter_index, scene_index) ELSE 'scene-000' END AS scene_id FROM (SELECT *, (sum(sep) OVER (PARTITION BY doc_id, chapter_index ORDER BY line_no))::BIGINT AS scene_index, last_value(CASE WHEN ch = 1 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS chapter_title FROM (SELECT *, (sum(ch) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS chapter_index FROM (SELECT *, regexp_matches(line, '{TITLE_RE}')::INT AS ch, (line = '★★★')::INT AS sep FROM ({lines_sql('doc_id', 'documents')})))) WHERE ch = 0 AND sep = 0",
    "se": f"SELECT doc_id, line_no, k, s, length(s) AS n, sum(length(s)) OVER (PARTITION BY doc_id, line_no ORDER BY k) - length(s) AS off FROM (SELECT doc_id, line_no, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS s FROM (SELECT doc_id, line_no, regexp_extract_all(line, '[^{ENDS}]*[{ENDS}]|[^{ENDS}]+') AS l FROM un))",
    "fi": "SELECT doc_id, line_no, k, 1 AS p, CASE WHEN n > 1000 THEN 0 ELSE n END AS held FROM se WHERE k = 1 UNION ALL SELECT s.doc_id, s.line_no, s.k, p + CASE WHEN held = 0 OR held + n > 1000 THEN 1 ELSE 0 END, CASE WHEN n > 1000 THEN 0 WHEN held = 0 OR held + n > 1000 THEN n ELSE held + n END FROM fi JOIN se s ON s.doc_id = fi.doc_id AND s.line_no = fi.line_no AND s.k = fi.k + 1",
    "pi": "SELECT doc_id, line_no, p, string_agg(s, '' ORDER BY k) AS s, min(off) AS off FROM se JOIN fi USING (doc_id, line_no, k) GROUP BY ALL",
    "pa": "SELECT doc_id, line_no, off + i AS off, substring(s, i + 1, 1000) AS part FROM (SELECT *, unnest(range(0, greatest(length(s), 1), 1000)) AS i FROM pi)",
    "sn": "SELECT doc_id, chapter_index, scene_index, chapter_title, scene_id, list(part ORDER BY line_no, off) AS parts, list(start + off ORDER BY line_no, off) AS starts, list(length(part) ORDER BY line_no, off) AS ns FROM pa JOIN un USING (doc_id, line_no) GROUP BY ALL",
    "pk": "SELECT doc_id, chapter_index, scene_index, 1 AS k, 1 AS f, ns[1] AS z, NULL::INTEGER AS was FROM sn UNION ALL SELECT doc_id, chapter_index, scene_index, k + 1, CASE WHEN over THEN k + 1 - t ELSE f END, ns[k + 1] + CASE WHEN over THEN coalesce(list_sum(ns[k + 1 - t : k]), 0) * (t > 0)::INT + 2 * greatest(0, t - 1) + 2 * (t > 0)::INT ELSE z + 2 END, CASE WHEN over THEN f END FROM (SELECT pk.*, ns, z + 2 + ns[k + 1] > 1000 OR z >= 800 AS over, least(3, k - f) AS t FROM pk JOIN sn USING (doc_id, chapter_index, scene_index) WHERE k < len(ns))",
    "ck2": "SELECT doc_id, chapter_index, scene_index, was AS a, k - 1 AS b FROM pk WHERE was IS NOT NULL UNION ALL SELECT doc_id, chapter_index, scene_index, f, k FROM pk JOIN sn USING (doc_id, chapter_index, scene_index) WHERE k = len(ns)",
    "co": "SELECT doc_id, chapter_index, scene_index, chapter_title, scene_id, starts[a] AS start_pos, starts[b] + ns[b] AS end_pos, array_to_string(parts[a : b], chr(10) || chr(10)) AS chunk_text FROM ck2 JOIN sn USING (doc_id, chapter_index, scene_index)",
}

ORACLE = {
    "chunk_pack_overlap": "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in PACK.items()) + " SELECT * EXCLUDE (c), doc_id || '-' || lpad(chunk_index::VARCHAR, greatest(6, length(c::VARCHAR))::INT, '0') AS id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter_index, scene_index, start_pos, end_pos) AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS c FROM co)",
    "sample_exact": with_parts(f"SELECT id, book FROM ck ORDER BY md5('{fixed.EVAL_SEED}|' || id), id LIMIT {fixed.EVAL_SAMPLE}", "ck"),
    "sample_stratified": with_parts(f"SELECT id, book FROM (SELECT id, book, row_number() OVER (PARTITION BY book ORDER BY md5('{fixed.EVAL_SEED}|' || id), id) AS n FROM ck) WHERE n <= 3", "ck"),
    "rerank_cached": with_parts(f"SELECT f.eval_id, f.ord, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, {sql_terms('c.text')})) / len(a) ELSE 0 END, 6) AS rerank_score, count(*) FILTER (f.ord % 2 = 0) OVER () AS cache_hits, count(*) FILTER (f.ord % 2 = 1) OVER () AS api_scored, (SELECT count(DISTINCT eval_id) FROM fused WHERE fused_rank <= 30 AND ord % 2 = 1) AS api_calls, (SELECT count(DISTINCT (question, g.id, g.text)) FROM fused h JOIN ck g ON g.ord = h.ord JOIN q ON q.eval_id = h.eval_id WHERE fused_rank <= 30) AS in_cache FROM fused f JOIN ck c ON c.ord = f.ord JOIN (SELECT eval_id, list_distinct({sql_terms('question')}) AS a FROM q) z ON z.eval_id = f.eval_id WHERE fused_rank <= 30", *FUSED),
    "eval_results": with_parts("SELECT q.eval_id, q.gold_chunk_id, (out_rank - 1)::INTEGER AS place, c.id AS chunk_id, c.book AS book_name, round(base_score, 6) AS base_score, round(rerank_score, 6) AS rerank_score, md5(" + _put(PREVIEW, _put(ONE, "c.text")) + ") AS preview_md5 FROM rs JOIN q USING (eval_id) JOIN ck c ON c.ord = rs.ord", *RERANK, more=RERANK),
    "index_round_trip": with_parts("SELECT id, book AS book_name, chunk_index, scene_id, 0 AS chapter_index, md5(text) AS text_md5, round(embedding[1], 6) AS first_value, true AS counted FROM ck WHERE has_vec", "ck"),
    "texts_round_trip": "SELECT 'd' || doc_id AS book_name, md5(text) AS text_md5, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '" + WS + "+', '', 'g') <> ''))::INTEGER AS paragraphs, length(text)::INTEGER AS chars FROM documents WHERE regexp_replace(text, '" + WS + "+', '', 'g') <> ''",
    "embeddings_cached": f"SELECT eval_id, 64 AS n_dims, (SELECT count(DISTINCT question) FROM ({QUESTIONS})) AS in_cache FROM ({QUESTIONS})",
    "scan_chunks": "SELECT ord, id, coalesce(book_name, " + _put(BOOK_OF, "id") + ") AS book, chapter_title, coalesce(chapter_index, 0) AS chapter_index, coalesce(scene_index, 0) AS scene_index, coalesce(scene_id, 'scene-000') AS scene_id, length(text)::INTEGER AS n_chars, len(embedding)::INTEGER AS n_dims FROM chunks",
    "book_stats": "SELECT coalesce(nullif(book_name, ''), '未知书籍') AS book, count(*) AS chunks, min(ord) AS first_ord FROM chunks GROUP BY 1",
    "book_from_id": "SELECT eval_id, " + _put(BOOK_OF, "gold_chunk_id") + " AS book FROM eval_items",
    "natural_order": with_parts("SELECT book, n, lag(book) OVER (PARTITION BY regexp_extract(k, '^([^0-9]*)', 1) ORDER BY k, book) AS before FROM (SELECT *, array_to_string(list_transform(regexp_extract_all(lower(book), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '') AS k FROM (SELECT book, count(*) AS n FROM ck GROUP BY 1))", "ck"),
    "line_units": f"SELECT doc_id, line_no, start, length(line)::INTEGER AS n_chars, chapter_index, scene_index, CASE WHEN chapter_index > 0 OR scene_index > 0 THEN printf('chapter-%03d-scene-%03d', chapter_index, scene_index) ELSE 'scene-000' END AS scene_id FROM (SELECT *, (sum(sep) OVER (PARTITION BY doc_id, chapter_index ORDER BY line_no))::BIGINT AS scene_index FROM (SELECT *, (sum(ch) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS chapter_index FROM (SELECT *, regexp_matches(line, '{TITLE_RE}')::INT AS ch, (line = '★★★')::INT AS sep FROM ({lines_sql('doc_id', 'documents')})))) WHERE ch = 0 AND sep = 0",
    "chunk_lines": f"SELECT ord, line_no, start, line FROM ({lines_sql('ord', 'chunks')})",
    "sentence_split": f"SELECT doc_id, unnest(range(0, len(s))) AS sentence_no, unnest(s) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '[^{ENDS}]*[{ENDS}]|[^{ENDS}]+') AS s FROM documents)",
    "chunk_ids": with_parts("SELECT ord, book, n, book || '-' || lpad(n::VARCHAR, greatest(6, length(c::VARCHAR))::INT, '0') AS new_id FROM (SELECT ord, book, row_number() OVER (PARTITION BY book ORDER BY chunk_index, ord) AS n, count(*) OVER (PARTITION BY book) AS c FROM ck)", "ck"),
    "chapter_titles": f"SELECT ord, regexp_matches(chapter_title, '{TITLE_RE}') AS is_title, {_put(ONE, 'chapter_title')} AS title FROM chunks WHERE chapter_title IS NOT NULL",
    "paragraph_forms": f"SELECT ord, line_no, {_put(FORM, 'one')} AS para FROM (SELECT ord, line_no, {_put(ONE, 'line')} AS one FROM ({lines_sql('ord', 'chunks')}))",
    "consecutive_dedup": with_parts(f"SELECT id, title FROM (SELECT *, lag(title) OVER (PARTITION BY book ORDER BY chunk_index) AS b FROM ({CK_TITLES})) WHERE title IS DISTINCT FROM b OR b IS NULL", "ck"),
    "front_matter_trim": f"SELECT doc_id, line_no FROM (SELECT *, min(CASE WHEN regexp_matches(CASE WHEN contains(line, '？') THEN '第1话 ' || line ELSE line END, '{TITLE_RE}') THEN line_no END) OVER (PARTITION BY doc_id) AS f FROM ({lines_sql('doc_id', 'documents')})) WHERE f IS NULL OR line_no >= f",
    "contents_drop": f"SELECT book, n FROM (SELECT *, max(CASE WHEN NOT t OR again THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY n) AS closed FROM (SELECT book, n, regexp_matches(para, '{TITLE_RE}') AS t, row_number() OVER (PARTITION BY book, regexp_replace(para, '{WS}+', '', 'g') ORDER BY n) > 1 AS again FROM ({TITLED}))) WHERE closed = 1",
    "html_paragraphs": f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS para_no, para FROM (SELECT doc_id, k, {_put(FORM, 'one')} AS para FROM (SELECT doc_id, unnest(range(0, len(l))) AS k, {_put(ONE, 'unnest(l)')} AS one FROM (SELECT doc_id, list_concat([coalesce(chapter_title, '')], string_split_regex(text, '\\n+')) AS l FROM documents WHERE text IS NOT NULL))) WHERE para <> ''",
    "text_preview": f"SELECT ord, CASE WHEN length(one) > 220 THEN substring(one, 1, 220) || '...' ELSE one END AS preview FROM (SELECT ord, {_put(ONE, 'text')} AS one FROM chunks WHERE text IS NOT NULL)",
    "paragraph_counts": f"SELECT ord, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '{WS}+', '', 'g') <> ''))::INTEGER AS n_paragraphs, length(text)::INTEGER AS n_chars FROM chunks WHERE text IS NOT NULL",
    "entity_aliases": f"SELECT id, canonical, alias_pos, alias FROM ({ALIASES})",
    "entity_match": with_parts("SELECT eval_id, id, alias, pos FROM me", *REWRITES, more=REWRITES),
    "entity_full_names": with_parts("SELECT * FROM fn", "al", "fn", more=REWRITES),
    "entity_rewrites": with_parts("SELECT * FROM (SELECT eval_id, row_number() OVER (PARTITION BY eval_id ORDER BY first_at) AS rewrite_no, r AS rewrite FROM rw) WHERE rewrite_no <= 3", *REWRITES, more=REWRITES),
    "merge_contexts": with_parts("SELECT * FROM (SELECT eval_id, ord, hits, round(best, 6) AS best_score, row_number() OVER (PARTITION BY eval_id ORDER BY hits DESC, best DESC, seen, ord) AS out_rank FROM (SELECT eval_id, ord, count(DISTINCT l) AS hits, max(s) AS best, min((l, r)) AS seen FROM (SELECT eval_id, ord, 0 AS l, fused_rank AS r, score AS s FROM fused WHERE fused_rank <= 10 UNION ALL SELECT eval_id, ord, 1, vec_rank, cos FROM dense WHERE vec_rank <= 10 UNION ALL SELECT eval_id, ord, 2, bm25_rank, bm25 / 100 FROM sp WHERE bm25_rank <= 10) GROUP BY 1, 2)) WHERE out_rank <= 5", *FUSED),
    "retrieve_with_rewrites": "WITH " + ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in WITH_REWRITES.items()) + " SELECT * FROM (SELECT eval_id, ord, hits, round(best, 6) AS best_score, row_number() OVER (PARTITION BY eval_id ORDER BY hits DESC, best DESC, seen, ord) AS out_rank FROM (SELECT eval_id // 4 AS eval_id, ord, count(*) AS hits, max(score) AS best, min((eval_id % 4, out_rank)) AS seen FROM retrieved GROUP BY 1, 2)) WHERE out_rank <= 5",
    "answer_insufficient": f"SELECT id, coalesce(regexp_replace(answer, '{WS}+', '', 'g') = '' OR " + " OR ".join(f"contains(answer, '{m}')" for m in fixed.INSUFFICIENT_MARKS) + f", true) AS insufficient FROM ({LOG})",
    "answerability_parse": "SELECT eval_id, CASE WHEN eval_id % 4 < 3 THEN eval_id % 3 = 0 END AS answerable, CASE WHEN eval_id % 4 < 3 THEN 1 END AS n_missing, CASE WHEN eval_id % 4 < 3 THEN (trim(coalesce(reference_answer, '')) <> '')::INT END AS n_questions FROM eval_items",
    "context_format": with_parts("SELECT eval_id, length(string_agg('[片段 ' || fused_rank || ' | book=' || book || ' | chunk_id=' || id || ' | score=' || printf('%.4f', score) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY fused_rank))::INTEGER AS n_chars, md5(string_agg('[片段 ' || fused_rank || ' | book=' || book || ' | chunk_id=' || id || ' | score=' || printf('%.4f', score) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY fused_rank)) AS context_md5, count(*)::INTEGER AS n_passages FROM fused JOIN ck USING (ord) WHERE fused_rank <= 5 GROUP BY 1", *FUSED),
    "cache_misses": f"SELECT sha256(q) AS key, q AS question FROM (SELECT DISTINCT regexp_replace(question, '^{WS}+|{WS}+$', '', 'g') AS q FROM visitor_queries WHERE question IS NOT NULL) WHERE q NOT IN (SELECT regexp_replace(question, '^{WS}+|{WS}+$', '', 'g') FROM eval_items WHERE question IS NOT NULL)",
    "evaluate_plain": with_parts("SELECT eval_id, gold_rank, coalesce(gold_rank <= 1, false) AS hit_at_1, coalesce(gold_rank <= 3, false) AS hit_at_3, coalesce(gold_rank <= 5, false) AS hit_at_5, round(coalesce(1.0 / gold_rank, 0), 6)::DOUBLE AS reciprocal_rank, CASE WHEN gold_rank IS NULL THEN 'candidate_miss' END AS failure_reason FROM pl", *ROUTES, *PLAIN, more=PLAIN | WHOLE),
    "gold_rank": with_parts("SELECT eval_id, gold_rank, candidate_rank, hit_at_1, hit_at_3, hit_at_5, round(reciprocal_rank, 6) AS reciprocal_rank, failure_reason FROM ev", *EVALUATED, more=EVALUATED | WHOLE),
    "eval_metrics": with_parts(f"SELECT {METRICS} FROM ev", *EVALUATED, more=EVALUATED | WHOLE),
    "eval_metrics_by_book": with_parts(f"SELECT book, {METRICS} FROM ev GROUP BY ROLLUP (book)", *EVALUATED, more=EVALUATED | WHOLE),
    "representative_failures": with_parts("SELECT eval_id, gold_chunk_id, failure_reason FROM (SELECT *, row_number() OVER (ORDER BY p, eval_id) AS z FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY failure_reason ORDER BY eval_id) = 1 THEN CASE failure_reason WHEN 'candidate_miss' THEN 0 WHEN 'rerank_lost' THEN 1 ELSE 2 END ELSE 3 END AS p FROM (SELECT *, row_number() OVER (PARTITION BY gold_chunk_id ORDER BY eval_id) AS k FROM ev WHERE gold_rank IS NULL) WHERE k = 1)) WHERE z <= 5 AND (SELECT count(*) FROM ev WHERE gold_rank IS NULL) > 5 UNION ALL SELECT eval_id, gold_chunk_id, failure_reason FROM ev WHERE gold_rank IS NULL AND (SELECT count(*) FROM ev WHERE gold_rank IS NULL) <= 5", *EVALUATED, more=EVALUATED | WHOLE),
    "daily_usage": f"SELECT visitor_id, usage_date, asked, least(asked, 5) AS used_count, greatest(5 - asked, 0) AS remaining FROM ({USED})",
    "usage_order": f"SELECT id, row_number() OVER (PARTITION BY visitor_id, {DAY} ORDER BY created_at, id) AS day_rank FROM ({LOG}) WHERE coalesce(used_custom_api_key, 0) = 0",
    "usage_recount": f"SELECT coalesce(s.visitor_id, c.visitor_id) AS visitor_id, coalesce(s.usage_date, c.usage_date) AS usage_date, coalesce(s.used_count, 0)::BIGINT AS stored, coalesce(least(asked, 5), 0) AS counted FROM visitor_daily_usage s FULL JOIN ({USED}) c ON c.visitor_id = s.visitor_id AND c.usage_date = s.usage_date WHERE coalesce(s.used_count, 0) <> coalesce(least(asked, 5), 0)",
    "usage_stream_daily": USED,
    "event_usage": "SELECT user_id, ts::DATE AS day, count(*) AS n, greatest(5 - count(*), 0) AS remaining FROM events GROUP BY ALL",
}
