"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

Each text is cut where its own content says so, so equal stretches give equal chunks wherever they stand. A chunk is
named by a 64-bit key; the chunk dictionary, grouped by key and content, proves that a key names one content only.
Keys that fail are widened by the content's SHA-256. A document is then its ordered list of identifiers, and lists,
not texts, are compared. A text is moved once at most, as its chunks, after map-side combination of equal chunks.

Defined results: null text counts as empty; the empty text has an empty recipe, so all empty texts are equal. Of equal
texts the largest id stays; rows that repeat an id stay or go together. A null id is never kept unless all ids of its
group are null. Other columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktap.llm.keep import without
from sparktap.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the chunker: a chunk ends after letters of two classes in this order, or after a full stop of a
#: script that has no spaces, but not before the least and no later than the largest length.
LEAST, MOST = 512, 8192
X, Y = "[bdfhjlnprtvxz13579]", "[^bdfhjlnprtvxz13579]"
ENDS = f"(?:{X}{Y}{Y}{X}{Y}{X}{Y}|[\\u3002\\uff0c\\u3001\\u0964\\u061f])"
CHUNK = f"(?s).{{{LEAST},{MOST}}}?{ENDS}|.{{1,{MOST}}}"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() is the same, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    """The text's chunks in order; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_key(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def unproven_keys(occurrences: DataFrame) -> DataFrame:
    """Keys that name more than one content, from rows (key, chunk)."""
    dictionary = occurrences.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    return dictionary.groupBy("key").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("key")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=chunk_key) -> DataFrame:
    """Rows (id, text_sha256, recipe): the ordered, verified identifiers of each text's chunks."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    cut = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    occurrences = cut.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(key(F.col("chunk")).alias("key"), "chunk")
    unproven = materialise(unproven_keys(occurrences), "unproven")
    plain = lambda c: F.struct(key(c).alias("key"), F.lit(None).cast("string").alias("wide"))
    if unproven.isEmpty():
        return cut.select("id", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), plain).alias("recipe"))
    # Only documents that hold such a key are dealt out by chunk; a document's identifiers meet again in its order.
    at = cut.withColumn("row", F.monotonically_increasing_id())
    at = materialise(at.select("row", "id", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), lambda c: F.struct(key(c).alias("key"), F.sha2(c, 256).alias("sha"))).alias("cut")), "cut")
    each = at.select("row", F.posexplode("cut").alias("pos", "c")).select("row", "pos", F.col("c.key").alias("key"), F.col("c.sha").alias("sha"))
    named = each.join(unproven.withColumn("unproven", F.lit(True)), "key", "left")
    ident = F.struct(F.col("key"), F.when(F.col("unproven"), F.col("sha")).alias("wide"))
    lists = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", ident.alias("ident")))).alias("all"))
    lists = lists.select("row", F.transform("all", lambda x: x["ident"]).alias("recipe"))
    return at.drop("cut").join(lists, "row", "left").select("id", "text_sha256", F.coalesce("recipe", F.array().cast(lists.schema["recipe"].dataType)).alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=chunk_key) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    listed = materialise(recipes(docs, id_col, text_col, key), "recipes")
    groups = listed.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    out = listed.join(groups, listed["recipe"].eqNullSafe(groups["recipe"]), "left").select(
        listed["id"], F.when(F.col("group_size").isNull(), listed["id"]).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256"
    )
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Rows that repeat an id go only together."""
    marked = exact_dedup(docs, id_col, text_col)
    return without(docs, marked.groupBy(id_col).agg(F.max("kept").alias("kept")).where("NOT kept").select(id_col), id_col)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB's lower() changes letters outside A-Z too, so translate() is used.
SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""
