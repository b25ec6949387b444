"""Entity aliases, query rewrites and the merging of several result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed


def entity_aliases(entities: DataFrame) -> DataFrame:
    """``id, entity_type, canonical, aliases``: trimmed, without blanks and repeats, the canonical name first.

    Entities without an id or a canonical name are left out; a null alias list has the canonical name alone.
    """
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    every = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    kept = F.array_distinct(F.filter(F.transform(every, trim), lambda a: a.isNotNull() & (a != "")))
    return entities.where("id is not null and trim(canonical) <> ''").select("id", "entity_type", trim(F.col("canonical")).alias("canonical"), kept.alias("aliases"))


def mentions(queries: DataFrame, query: str, text: str, entities: DataFrame, gram: int = 2) -> DataFrame:
    """``query, id, canonical, alias, pos``: for each entity the longest alias that stands in the text.

    The canonical name is no match; where it stands in the text, only aliases that contain it count. An alias can only
    stand in a text that holds its first ``gram`` characters, so these are joined on and the few candidates compared;
    aliases of one character are joined on it.
    """
    names = entity_aliases(entities)
    alias = names.select("id", "canonical", F.posexplode("aliases").alias("alias_pos", "alias")).where("alias <> canonical")
    alias = alias.withColumn("head", F.substring("alias", 1, gram))
    n = F.length(text)
    heads = F.concat(*[F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), _sub(text, k))).otherwise(F.array().cast("array<string>")) for k in range(1, gram + 1)])
    asked = queries.select(query, text, F.explode(F.array_distinct(heads)).alias("head"))
    hits = asked.join(alias, "head").withColumn("pos", F.instr(F.col(text), F.col("alias"))).where("pos > 0")
    hits = hits.where((F.instr(F.col(text), F.col("canonical")) == 0) | (F.instr(F.col("alias"), F.col("canonical")) > 0))
    by = Window.partitionBy(query, "id").orderBy(F.desc(F.length("alias")), "alias_pos")
    return hits.withColumn("_n", F.row_number().over(by)).where("_n = 1").select(query, text, "id", "canonical", "alias", "pos")


def _sub(text: str, k: int):
    return lambda i: F.substring(F.col(text), i, F.lit(k))


def full_names(entities: DataFrame) -> DataFrame:
    """``id, full_name``: the longest alias that contains the canonical name, one that starts with it first."""
    names = entity_aliases(entities).select("id", "canonical", F.posexplode("aliases").alias("p", "alias")).where((F.col("alias") != F.col("canonical")) & (F.instr(F.col("alias"), F.col("canonical")) > 0))
    best = F.max_by("alias", F.struct(F.startswith("alias", "canonical").alias("s"), F.length("alias").alias("n"), (-F.col("p")).alias("p")))
    return names.groupBy("id").agg(best.alias("full_name"))


def rewrites(queries: DataFrame, query: str, text: str, entities: DataFrame, limit: int = fixed.REWRITE_LIMIT) -> DataFrame:
    """``query, rewrite_no, rewrite``: up to ``limit`` other wordings of each query.

    For each mention by its place, longer ones first: the alias replaced by the canonical name, the canonical name put
    after it, the alias replaced by the full name; none that is blank, the query itself or a repeat.
    """
    found = mentions(queries, query, text, entities).join(full_names(entities), "id", "left")
    put = lambda new: F.overlay(F.col(text), new, F.col("pos"), F.length("alias"))
    options = F.array(put(F.col("canonical")), put(F.concat("alias", F.lit(" "), "canonical", F.lit(" "))), F.when(F.col("full_name").isNotNull(), put(F.col("full_name"))))
    order = Window.partitionBy(query).orderBy("pos", F.desc(F.length("alias")), "id")
    each = found.withColumn("m", F.row_number().over(order)).select(query, text, "m", F.posexplode(options).alias("o", "rewrite"))
    each = each.withColumn("rewrite", F.regexp_replace("rewrite", r"(?U)^\s+|\s+$", "")).where((F.col("rewrite") != "") & (F.col("rewrite") != F.col(text)))
    first = each.groupBy(query, "rewrite").agg(F.min(F.struct("m", "o")).alias("at"))
    return first.withColumn("rewrite_no", F.row_number().over(Window.partitionBy(query).orderBy("at"))).where(F.col("rewrite_no") <= limit).select(query, "rewrite_no", "rewrite")


def merge_lists(lists: DataFrame, query: str, key: str, list_no: str, rank: str, score: str, k: int = fixed.TOP_K) -> DataFrame:
    """``query, key, hits, best_score, out_rank``: rows of several lists by number of lists, best score, first place seen."""
    by_key = lists.groupBy(query, key).agg(F.count_distinct(list_no).alias("hits"), F.max(score).alias("best_score"), F.min(F.struct(list_no, rank)).alias("seen"))
    order = Window.partitionBy(query).orderBy(F.desc("hits"), F.desc("best_score"), "seen", key)
    return by_key.withColumn("out_rank", F.row_number().over(order)).where(F.col("out_rank") <= k).drop("seen")
