"""An index on disk: built once, loaded by any session that reads the folder."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators import index


@dataclass(frozen=True)
class IndexTables:
    """``seqs(rid, .., offset, len, l_pac, seq)``, ``kmers(kmer, rid, gpos, before, after, l_pac)`` in buckets of ``kmer``, ``holes``."""

    k: int
    l_pac: int
    seqs: DataFrame
    kmers: DataFrame
    holes: DataFrame


def complete(spark: SparkSession, path: str) -> bool:
    """Whether an index was built whole below ``path``: its description is written last."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/about/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def build_index(spark: SparkSession, fasta: DataFrame, path: str, k: int, per_bucket: int = 4_000_000) -> IndexTables:
    """Contigs, runs of ambiguous letters and packed k-mers of ``fasta(doc_id, seq)`` below ``path``.

    K-mers lie in sorted buckets, one file each, so a search shuffles its reads
    alone.  Buckets grow in number with the reference and are no fewer than
    the session's shuffle partitions, below which the planner would shuffle
    the index too.  What a broken build left is overwritten; a whole index is
    never.
    """
    if complete(spark, path):
        raise FileExistsError(path)
    index.sequences(fasta).write.mode("overwrite").parquet(f"{path}/contigs")
    seqs = spark.read.parquet(f"{path}/contigs")
    index.holes(seqs).write.mode("overwrite").parquet(f"{path}/holes")
    l_pac = seqs.agg(F.coalesce(F.max("l_pac"), F.lit(0)).alias("n")).first().n
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-l_pac // per_bucket))
    rows = index.kmers(seqs, k).drop("l_pac").repartition(buckets, "kmer")
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    rows.write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer").option("path", f"{path}/kmers").saveAsTable(_name(path))
    spark.createDataFrame([(k, buckets, l_pac)], "k int, buckets int, l_pac bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> IndexTables:
    """The index below ``path``, whichever session built it."""
    if not complete(spark, path):
        raise FileNotFoundError(path)
    about = spark.read.parquet(f"{path}/about").first()
    if not spark.catalog.tableExists(_name(path)):
        place = f"{path}/kmers".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {_name(path)} (kmer BIGINT, rid BIGINT, gpos BIGINT, before TINYINT, after TINYINT) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {about.buckets} BUCKETS LOCATION '{place}'")
    kmers = spark.table(_name(path)).withColumn("l_pac", F.lit(about.l_pac).cast("bigint"))
    return IndexTables(about.k, about.l_pac, spark.read.parquet(f"{path}/contigs"), kmers, spark.read.parquet(f"{path}/holes"))


def _name(path: str) -> str:
    return f"strandwise_kmers_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
