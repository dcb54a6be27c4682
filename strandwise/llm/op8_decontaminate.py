"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window of an item is the set of its 3-word shingles.  A document holds the
window only if it holds all of them, so the join needs one shingle a window,
the rarest over all documents (the prefix of a containment of 1).  Candidates
pass a positional bound (the window starts in the document) and a length bound
(it ends there), and then all words of the window are compared.  A Bloom filter
of the benchmark's shingles thins those of the documents before they become
rows; of what passes only hash and place are kept, and the words of documents
with candidates are fetched when they are compared.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.bloom import hash_filter
from strandwise.llm.storage import write_table

#: Fixed values of the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHINGLE = 3

def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() equals the mapping of A-Z on ASCII and is much faster than translate()
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _hash(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(words, i + j) for j in range(k)))


def _hashes(words: Column, k: int) -> Column:
    """``array<struct<i, h>>`` of the shingles of k words; one that starts less than k words before the end is of fewer."""
    return F.transform(words, lambda _, i: F.struct(i.alias("i"), _hash(words, i, k).alias("h")))


def item_windows(bench: DataFrame, window: int) -> DataFrame:
    """``(win array<string>, k, items array<string>)``: each distinct window with the items that have it.

    A null ``item_id`` counts as the empty string; an item without words has no window.
    """
    w, n = F.col("words"), F.size("words")
    size = F.least(n, F.lit(window))
    own = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).where(n > 0)
    flat = own.select("item", F.explode(F.transform(F.sequence(F.lit(0), n - size), lambda p: F.slice(w, p + 1, size))).alias("win"))
    return flat.groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("k", F.least(F.size("win"), F.lit(SHINGLE)))


def _window_shingles(windows: DataFrame, ks: list[int]) -> DataFrame:
    """A row ``(win, items, k, o, h)`` for every shingle of every window."""
    w = F.col("win")
    parts = None
    for k in ks:
        rows = windows.where(F.col("k") == k).select(
            "win", "items", "k", F.inline(F.slice(_hashes(w, k), F.lit(1), F.size(w) - k + 1)).alias("o", "h")
        )
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key`` and ``key2``, which rows of equal ``doc_id`` and text share."""
    doc_id = F.col("doc_id").cast("bigint")
    return docs.withColumns({"key": F.coalesce(doc_id, F.lit(0)), "key2": F.xxhash64(F.coalesce("text", F.lit("")), doc_id.isNull())})


def _hits(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, key, key2, n_words)`` of all rows, and :func:`_verified` of those with a window."""
    windows = write_table(spark, item_windows(bench, window), "windows")
    ks = [r.k for r in windows.select("k").distinct().collect()]  # at most SHINGLE of them
    w = F.col("words")
    base = _keyed(docs.select("doc_id", "text")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "key", "key2", words_of(F.col("text")).alias("words"))
    found = F.array().cast("array<struct<i:int,h:bigint>>")
    if ks:
        grams = write_table(spark, _window_shingles(windows, ks), "window-shingles")
        passes = hash_filter(grams.select("h"))
        for k in ks:
            at = F.filter(_hashes(w, k), lambda x: passes(x["h"]))  # a short one at the end cannot pass the comparison of words
            found = at if k == ks[0] else F.concat(found, at)
    rows = write_table(spark, base.select("doc_id", "key", "key2", F.size(w).alias("n_words"), found.alias("hits")), "document-shingles")
    bare = rows.select("doc_id", "key", "key2", "n_words")
    if not ks:
        return bare, bare.where("false").select("key", "key2", F.lit(0).alias("n_hit"), F.lit(0).alias("n_items"), F.lit("").alias("items"))
    return bare, _verified(spark, docs, rows, grams)


def contamination(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs(doc_id, text)``.

    ``n_hit`` counts words inside any occurrence of a window of
    ``bench(item_id, text)``.  A null text has no words; rows with equal
    ``doc_id`` and text get equal results, each its own row; a null ``doc_id``
    is a value like any other; empty tables on either side are fine; other
    columns are ignored.
    """
    bare, hit = _hits(spark, docs, bench, window)
    return (
        bare.join(hit, ["key", "key2"], "left")
        .select(
            "doc_id",
            F.col("n_words").cast("bigint").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def without_benchmark(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs(doc_id, text, ..)`` in which no window of the benchmark occurs, with all their columns.

    A null text stays, rows with equal ``doc_id`` and text share their fate, a
    null ``doc_id`` is a value like any other, texts of any length are searched
    whole, columns may have any names, and empty tables on either side are fine.
    """
    hit = write_table(spark, _hits(spark, docs, bench, window)[1].select(F.col("key").alias("_k"), F.col("key2").alias("_k2")), "contaminated")
    keyed = _keyed(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")).drop("doc_id", "text")
    maybe = hash_filter(hit.select("_k2"))(F.col("key2"))
    rest = keyed.where(maybe).join(hit, (F.col("key") == F.col("_k")) & (F.col("key2") == F.col("_k2")), "left_anti")
    return keyed.where(~maybe).unionByName(rest).select("_row.*")  # texts that surely stay are not moved


def _verified(spark: SparkSession, docs: DataFrame, rows: DataFrame, grams: DataFrame) -> DataFrame:
    """``(key, key2, n_hit, n_items, items)`` of the documents with a window."""
    cands = rows.select("key", "key2", "n_words", F.inline("hits").alias("i", "h"))
    often = cands.groupBy("h").agg(F.count("*").alias("df"))
    # a window whose rarest shingle is nowhere has no row here: the inner join would keep its other shingles, hence left
    rare = grams.join(often, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "o")).alias("first"), F.first("items").alias("items"))
    prefix = write_table(spark, rare.where("first.df > 0").select("win", "items", F.col("first.h").alias("h"), F.col("first.o").alias("o")), "prefixes")
    start = F.col("i") - F.col("o")
    bounded = cands.join(prefix, "h").where((start >= 0) & (start + F.size("win") <= F.col("n_words")))
    offered = bounded.groupBy("key", "key2").agg(F.collect_set(F.struct(start.alias("p"), "win", "items")).alias("offers"))
    offered = write_table(spark, offered, "candidates")
    texts = _keyed(docs.select("doc_id", "text")).select("key", "key2", "text")
    texts = texts.where(hash_filter(offered.select("key2"))(F.col("key2"))).join(offered, ["key", "key2"])  # other texts are not moved
    # the words are bound by a lambda of their own, so that they are cut once a text and not once an offer
    same = F.transform(F.array(words_of(F.col("text"))), lambda w: F.filter("offers", lambda x: F.slice(w, (x["p"] + 1).cast("int"), F.size(x["win"])) == x["win"]))
    found = texts.select("key", "key2", F.element_at(same, 1).alias("found")).where(F.size("found") > 0)
    found = found.dropDuplicates(["key", "key2"])  # equal rows have equal windows
    spans = F.array_sort(F.array_distinct(F.transform("found", lambda x: F.struct(x["p"].alias("p"), (x["p"] + F.size(x["win"])).alias("e")))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["p"], a["to"]))).alias("n"), F.greatest(a["to"], s["e"]).alias("to")),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"]))))
    return found.select("key", "key2", covered.alias("n_hit"), F.size(items).alias("n_items"), F.concat_ws(",", items).alias("items"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in ("documents", "benchmark"))
    return contamination(spark, docs, bench)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_decontaminate": op8_decontaminate}
ORACLES: dict[str, str] = {
    "op8_decontaminate": rf"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
bw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM bw WHERE len(w) > 0)),
grams AS (
  SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM dw, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
occ AS (SELECT r, p, size, item FROM grams JOIN win USING (size, g)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM occ) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
}
