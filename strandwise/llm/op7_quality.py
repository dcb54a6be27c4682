"""Quality rules whose cutoffs come from quantile sketches per language and source.

Each document's measures are taken once.  Mergeable quantile sketches of every
measure are built per (language, source), per language and of all documents,
partial ones merging on the way.  A group's quantiles are drawn towards those
of its language, and these towards all, with a weight that fades as documents
come, so a group of any size has fences of its own.  A fence is an upper
quantile plus a multiple of its distance from the median; no cutoff is fixed.
The fences are joined back and a document passes if it is inside all of them.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.llm.storage import write_table
from strandwise.llm.tokenize import bounded_batches

#: Fixed values of the contract.
LEAST_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"

#: Each measure as (count, of how many, upper quantile, distances added to it).  Symbols and word lengths hardly
#: vary among most texts; repeated text has a long tail of its own, so its fences start further up.
RULES = {
    "symbol_share": ("n_symbols", "word_chars", 0.90, 3.0),
    "dup_line_share": ("n_dup_lines", "n_words", 0.99, 1.0),
    "repeat_share": ("n_repeat_words", "n_words", 0.99, 1.0),
    "long_words": ("word_chars", "n_words", 0.90, 3.0),
}
#: Documents that the level above counts for.
PRIOR = 100
#: Counts up to this are within chance where the expected count is zero (the rule of three); lengths are no rare counts.
CHANCE = {"symbol_share": 3, "dup_line_share": 3, "repeat_share": 3, "long_words": 0}
ACCURACY = 10_000


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    if n < 4:
        return n, chars, symbols, dup, 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    kinds = len(ids)
    pair = code[:-1] * kinds + code[1:]
    if kinds > 1 << 20:  # keys of three words stay within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, where, count = np.unique(pair[:-1] * kinds + code[2:], return_inverse=True, return_counts=True)
    start = np.flatnonzero(count[where] > 1)
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[start + k] = True
    return n, chars, symbols, dup, int(hit.sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(spark: SparkSession, docs: DataFrame, row: list[str]) -> DataFrame:
    """``row`` (a struct of these columns), ``lang``, ``source`` and the five counts of each ``text``."""

    def run(batches):
        for batch in batches:
            counts = [measures(t) for t in batch.column(3).to_pylist()]
            cols = np.array(counts, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in cols)], ["row", "lang", "source", *COUNTS])

    bounded_batches(spark)
    own = docs.select(F.struct(*row).alias("row"), "lang", "source", "text")
    schema = T.StructType([*own.schema.fields[:3], *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return own.mapInArrow(run, schema)


def _shares() -> dict[str, Column]:
    return {name: F.col(count) / F.greatest(F.col(size), F.lit(1)) for name, (count, size, _, _) in RULES.items()}


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _levels(rows: DataFrame) -> DataFrame:
    """``_lang, _source, level, n`` and the median and upper quantile of each measure, of documents that pass the base rules.

    ``level`` is 0 for a language and source, 1 for a language, 3 for all; one
    sketch a group and measure, and one shuffle of partial sketches for all levels.
    """
    passes = ~base_failed()
    sketch = [F.percentile_approx(F.when(passes, share), [0.5, RULES[name][2]], ACCURACY).alias(f"q_{name}") for name, share in _shares().items()]
    levels = rows.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count(F.when(passes, 1)).alias("n"), *sketch)
    return levels.withColumnsRenamed({"lang": "_lang", "source": "_source"})


def fences(spark: SparkSession, rows: DataFrame, prior: int = PRIOR) -> DataFrame:
    """``_lang, _source`` and the fence of each measure for every language and source; null where no document passes."""
    levels = write_table(spark, _levels(rows), "quantiles")

    def drawn(level: DataFrame, above: str) -> list[Column]:
        own = [F.get(F.col(f"q_{name}"), F.lit(i)) for name in RULES for i in (0, 1)]
        return [((F.col("n") * F.coalesce(q, F.lit(0.0)) + prior * F.col(f"{above}{k}")) / (F.col("n") + prior)) for k, q in enumerate(own)]

    tops = [F.get(F.col(f"q_{name}"), F.lit(i)) for name in RULES for i in (0, 1)]
    top = levels.where("level = 3").select(*(q.alias(f"a{k}") for k, q in enumerate(tops)))
    top = top.unionByName(spark.range(1).select(*(F.lit(None).cast("double").alias(f"a{k}") for k in range(len(tops))))).agg(*(F.max(f"a{k}").alias(f"a{k}") for k in range(len(tops))))  # one row even of an empty table
    langs = levels.where("level = 1").crossJoin(F.broadcast(top))
    langs = langs.select(F.col("_lang").alias("_of"), *(q.alias(f"l{k}") for k, q in enumerate(drawn(langs, "a"))))
    own = levels.where("level = 0").join(langs, F.col("_lang").eqNullSafe(F.col("_of")))
    own = own.select("_lang", "_source", *(q.alias(f"s{k}") for k, q in enumerate(drawn(own, "l"))))
    fence = [F.col(f"s{2 * i + 1}") + RULES[name][3] * (F.col(f"s{2 * i + 1}") - F.col(f"s{2 * i}")) for i, name in enumerate(RULES)]
    # written, so that the planner knows its size when it chooses the join
    return write_table(spark, own.select("_lang", "_source", *(f.alias(f"max_{name}") for f, name in zip(fence, RULES, strict=True))), "fences")


def _verdicts(spark: SparkSession, docs: DataFrame, row: list[str], narrow: bool, prior: int) -> DataFrame:
    rows = write_table(spark, measured(spark, docs, row if narrow else ["doc_id"]), "measures")
    own = fences(spark, rows, prior)
    rows = rows if narrow else measured(spark, docs, row)
    joined = rows.join(own, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for name, (count, size, _, _) in RULES.items():
        inside = inside & F.coalesce(F.col(count) - CHANCE[name] <= F.col(f"max_{name}") * F.greatest(F.col(size), F.lit(1)), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)


def judged(spark: SparkSession, docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed`` and ``kept`` for each row of ``docs(doc_id, text, lang, source)``.

    A null text has no words and fails; null languages and sources are groups
    like any other; where no document passes the base rules no fence applies.
    Repeated rows are judged alike; a text of any length is one row; an empty
    table gives no rows; other columns are ignored.
    """
    return _verdicts(spark, docs, ["doc_id"], True, prior).select("row.doc_id", *COUNTS, "base_failed", "kept")


def passing(spark: SparkSession, docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, with all their columns; texts are measured twice and not shuffled."""
    return _verdicts(spark, docs, docs.columns, False, prior).where("kept").select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_quality": op7_quality}


def _drawn_sql(above: str, to: str) -> str:
    out, k = [], 0
    for name in RULES:
        for i in (1, 2):
            out.append(f"(n * coalesce(q_{name}[{i}], 0.0) + {PRIOR} * {above}{k}) / (n + {PRIOR}) AS {to}{k}")
            k += 1
    return ", ".join(out)


_TOPS = ", ".join(f"q_{name}[{i + 1}] AS a{2 * j + i}" for j, name in enumerate(RULES) for i in (0, 1))
_SKETCHES = ", ".join(f"quantile_disc({c} / greatest({z}, 1)::DOUBLE, [0.5, {p}]) FILTER (WHERE NOT base_failed) AS q_{name}" for name, (c, z, p, _) in RULES.items())
_FENCES = ", ".join(f"s{2 * i + 1} + {r[3]} * (s{2 * i + 1} - s{2 * i}) AS max_{name}" for i, (name, r) in enumerate(RULES.items()))
_INSIDE = " AND ".join(f"coalesce({c} - {CHANCE[name]} <= max_{name} * greatest({z}, 1), true)" for name, (c, z, _, _) in RULES.items())

# sketches are exact up to ACCURACY documents a group, so quantiles of small tables have an exact oracle
ORACLES: dict[str, str] = {
    "op7_quality": rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
h AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM (
 SELECT w.r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words
 FROM w LEFT JOIN h ON h.r = w.r LEFT JOIN l ON l.r = w.r)),
q AS (SELECT lang, source, grouping(lang, source) AS level, count(*) FILTER (WHERE NOT base_failed) AS n, {_SKETCHES} FROM m GROUP BY ROLLUP (lang, source)),
top AS (SELECT {_TOPS} FROM q WHERE level = 3),
langs AS (SELECT lang, {_drawn_sql("a", "l")} FROM q, top WHERE level = 1),
own AS (SELECT q.lang, q.source, {_drawn_sql("l", "s")} FROM q JOIN langs ON q.lang IS NOT DISTINCT FROM langs.lang WHERE level = 0),
f AS (SELECT lang, source, {_FENCES} FROM own)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_INSIDE} AS kept
FROM m LEFT JOIN f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source
"""
}
