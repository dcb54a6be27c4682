"""Sources and sinks, each through files where there are any."""

from __future__ import annotations

from pyspark.sql import functions as F

import strandwise.plans.fixtures  # noqa: F401  (defines the derived tables)
from strandwise.functions import sequence as S
from strandwise.operators import index
from strandwise.plans.prefix import running_totals
from strandwise.plans.registry import FIXTURES, fixture, query
from strandwise.plans.scratch import scratch_folder
from strandwise.sources import records, sam


def _written(spark, df, label: str) -> str:
    path = scratch_folder(spark, label)
    df.write.text(path)
    records.register(spark)
    return path


_FQ = "SELECT name, comment, seq, qual FROM {fastq} WHERE length(seq) > 0"


def _fastq_text(spark, d):
    return fixture(spark, d, "fastq").where("length(seq) > 0").select(F.concat(F.lit("@"), "name", F.lit(" "), "comment", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


@query("src_fastq4", _FQ)
def src_fastq4(spark, d):
    return spark.read.format("fastq4").load(_written(spark, _fastq_text(spark, d), "fastq"))


@query("src_split", _FQ)
def src_split(spark, d):
    return spark.read.format("fastq4").option("split_bytes", 50_000).load(_written(spark, _fastq_text(spark, d), "fastq"))


@query("src_fastx", "SELECT name, comment, seq, CASE WHEN ordinal % 2 = 0 THEN qual END AS qual FROM {fastq} WHERE length(seq) > 0")
def src_fastx(spark, d):
    x = fixture(spark, d, "fastq").where("length(seq) > 0")
    wrap = lambda c: F.regexp_replace(c, "(.{60})(?=.)", "$1\n")
    fq = F.concat(F.lit("@"), "name", F.lit(" "), "comment", F.lit("\n"), wrap("seq"), F.lit("\n+\n"), wrap("qual"))
    fa = F.concat(F.lit(">"), "name", F.lit(" "), "comment", F.lit("\n"), wrap("seq"))
    return spark.read.format("fastx").load(_written(spark, x.select(F.when(F.expr("ordinal % 2 = 0"), fq).otherwise(fa).alias("value")), "fastx"))


@query("src_bam", "SELECT name, CASE WHEN ordinal % 3 = 2 THEN '4' ELSE CAST(1 + ordinal % 3 AS VARCHAR) END AS comment, upper(seq) AS seq, qual FROM {fastq} WHERE length(seq) > 0 AND ordinal % 3 <> 1")
def src_bam(spark, d):
    folder = scratch_folder(spark, "bam")
    rows = fixture(spark, d, "fastq").where("length(seq) > 0").select("ordinal", "name", "seq", "qual")

    def write(batches):
        import gzip

        import pyarrow as pa
        from pyspark import TaskContext

        system, path = records.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        system.create_dir(path, recursive=True)
        name = f"{path}/part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}.bam"
        n = 0
        with system.open_output_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, compresslevel=6) as out:
            out.write(records.bam_header())
            for batch in batches:
                for k, read, seq, qual in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    turned = k % 2 == 1  # stored on the other strand
                    flag = {0: 0x41, 1: 0x81, 2: 0}[k % 3] | (0x10 if turned else 0)
                    stored = (seq.upper()[::-1].translate(records.COMPLEMENT), qual[::-1]) if turned else (seq.upper(), qual)
                    out.write(records.bam_record(read, flag, *stored))
                    n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    records.register(spark)
    return spark.read.format("bam").option("which", 5).load(folder)


@query("src_pairs", "SELECT row_number() OVER (ORDER BY pair_id) - 1 AS ordinal, pair_id, r1, r2, CAST((row_number() OVER (ORDER BY pair_id) - 1) * 120 // 12000 AS BIGINT) AS batch FROM {reads_pe}")
def src_pairs(spark, d):
    x = fixture(spark, d, "reads_pe")
    r1 = running_totals(x.select("pair_id", "r1"), "pair_id", {"ordinal": "1", "bases": "length(r1)"})
    r2 = running_totals(x.select(F.col("pair_id").alias("id2"), "r2"), "id2", {"ordinal": "1", "bases2": "length(r2)"})
    return r1.join(r2, "ordinal").select("ordinal", "pair_id", "r1", "r2", F.floor((F.col("bases") + F.col("bases2")) / 12000).alias("batch"))


FIXTURES["named"] = "SELECT doc_id AS ordinal, CASE WHEN doc_id % 5 = 0 THEN concat('s', CAST(doc_id AS STRING)) ELSE concat('r', CAST(doc_id - doc_id % 2 AS STRING)) END AS name FROM {documents}"


@query("src_classify", "SELECT a.ordinal, a.name, CASE WHEN n % 2 = 1 AND i = n THEN 0 ELSE 1 END AS paired FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ordinal) AS i, count(*) OVER (PARTITION BY name) AS n FROM {named}) a")
def src_classify(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy("ordinal")
    x = fixture(spark, d, "named").withColumn("run", F.col("ordinal") - F.row_number().over(w))  # adjacent reads of a name are a run
    r = Window.partitionBy("name", "run")
    nth, n = F.row_number().over(r.orderBy("ordinal")), F.count("*").over(r)
    return x.withColumn("i", nth).withColumn("n", n).select("ordinal", "name", F.when((F.col("n") % 2 == 1) & (F.col("i") == F.col("n")), 0).otherwise(1).alias("paired"))


@query("src_legacy", "SELECT ordinal, regexp_replace(name, '/[12]$', '') AS name, array_to_string([CASE WHEN ascii(qual[i]) - 33 < 13 THEN lower(seq[i]) ELSE upper(seq[i]) END FOR i IN range(1, 5)], '') AS bc, substring(seq, 5) AS seq, substring(qual, 5) AS qual FROM {fastq} WHERE length(seq) > 4 AND NOT regexp_matches(comment, '^[^:]*:Y')")
def src_legacy(spark, d):
    x = fixture(spark, d, "fastq").where(~S.failed_casava(F.col("comment"))).where("length(seq) > 4")
    return x.select("ordinal", F.regexp_replace("name", "/[12]$", "").alias("name"), S.barcode(F.col("seq"), F.col("qual"), 4).alias("bc"), F.expr("substring(seq, 5)").alias("seq"), F.expr("substring(qual, 5)").alias("qual"))


@query("src_alt", "SELECT rid, doc_id AS name, len, doc_id % 13 = 0 AS is_alt FROM {contigs}")
def src_alt(spark, d):
    c = index.contigs(fixture(spark, d, "dna"))
    alt = fixture(spark, d, "dna").where("doc_id % 13 = 0").select(F.concat(F.col("doc_id"), F.lit("\t0\tchr1")).alias("value")).select(F.split("value", "\t")[0].cast("bigint").alias("name"), F.lit(True).alias("is_alt"))
    return c.join(alt, "name", "left").select("rid", "name", "len", F.coalesce("is_alt", F.lit(False)).alias("is_alt"))


@query("read_ordinal", "SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS ordinal FROM {reads}")
def read_ordinal(spark, d):
    return running_totals(fixture(spark, d, "reads").select("read_id"), "read_id", {"ordinal": "1"})


@query("qualfa2fq", "SELECT doc_id, seq, translate(seq, 'acgt', '+5?I') AS qual FROM {dna}")
def qualfa2fq(spark, d):
    x = fixture(spark, d, "dna")
    numbers = F.concat_ws(" ", F.transform(F.split("seq", ""), lambda b: F.when(b == "a", F.lit("10")).when(b == "c", F.lit("20")).when(b == "g", F.lit("30")).when(b == "t", F.lit("40"))))
    quals = x.select("doc_id", numbers.alias("numbers"))
    text = F.array_join(F.transform(F.filter(F.split("numbers", " "), lambda v: v != ""), lambda v: F.char(v.cast("int") + 33)), "")
    return x.join(quals.select("doc_id", text.alias("qual")), "doc_id")


_SAM = "SELECT concat('q.', CAST(id * 10 + n AS STRING)) AS qname, CAST(16 * (p % 2) AS INT) AS flag, concat('c', CAST(s % 25 AS STRING)) AS rname, CAST(p + 1 AS INT) AS pos, CAST(q AS INT) AS mapq, cigar, concat('NM:i:', CAST(q % 7 AS STRING)) AS t1, CASE WHEN p % 2 = 0 THEN concat('XA:Z:c1,+', CAST(p AS STRING), ',50M,1;c2,-', CAST(s + 1 AS STRING), ',40M,', CAST(n AS STRING), ';') ELSE '' END AS t2 FROM {cigars}"
FIXTURES["sam"] = _SAM


@query("src_sam", "SELECT qname, flag, rname, pos, mapq, cigar, t1[6:] AS nm, CASE WHEN t2 <> '' THEN t2[6:] END AS xa FROM {sam}")
def src_sam(spark, d):
    text = fixture(spark, d, "sam").select(F.concat_ws("\t", "qname", "flag", "rname", "pos", "mapq", "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("*"), "t1", "t2").alias("value"))
    path = _written(spark, text, "sam")
    return sam.scan(spark.read.text(path)).select("qname", "flag", "rname", "pos", "mapq", "cigar", F.col("tags")["NM"].alias("nm"), F.col("tags")["XA"].alias("xa"))


@query("xa2multi", "SELECT qname, flag, rname, pos, cigar, 'ACGTT' AS seq, NULL::INT AS nm FROM {sam} UNION ALL SELECT qname, CASE WHEN p[1] = '-' THEN 272 ELSE 256 END, c, CAST(p[2:] AS INT), g, CASE WHEN (p[1] = '-') <> (flag = 16) THEN 'AACGT' ELSE 'ACGTT' END, CAST(m AS INT) FROM (SELECT qname, flag, split_part(e, ',', 1) AS c, split_part(e, ',', 2) AS p, split_part(e, ',', 3) AS g, split_part(e, ',', 4) AS m FROM (SELECT qname, flag, unnest(string_split(rtrim(t2[6:], ';'), ';')) AS e FROM {sam} WHERE t2 <> ''))")
def xa2multi(spark, d):
    x = fixture(spark, d, "sam").select("qname", "flag", "rname", "pos", "cigar", F.lit("ACGTT").alias("seq"), F.when(F.col("t2") != "", F.expr("substring(t2, 6)")).alias("xa"))
    return sam.expand_alternatives(x)


@query("sam_hdr", "SELECT '@SQ\tSN:' || doc_id || '\tLN:' || len || CASE WHEN doc_id % 13 = 0 THEN '\tAH:*' ELSE '' END AS line FROM {contigs} UNION ALL SELECT '@HD\tVN:1.5\tSO:unsorted\tGO:query' UNION ALL SELECT '@PG\tID:strandwise\tPN:strandwise'")
def sam_hdr(spark, d):
    return sam.header(index.contigs(fixture(spark, d, "dna")).withColumn("is_alt", F.expr("name % 13 = 0"))).select("line")


@query("sam_sort", "SELECT qname, CAST(row_number() OVER (ORDER BY CAST(split_part(qname, '.', 2) AS BIGINT)) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT qname FROM {sam})")
def sam_sort(spark, d):
    names = fixture(spark, d, "sam").select("qname").distinct().withColumn("number", sam.read_number(F.col("qname")))
    return running_totals(names, "number", {"place": "1"}).select("qname", "place")


@query("shm_list")
def shm_list(spark, d):
    from strandwise.operators.store import IndexStore

    store = IndexStore(spark)
    store.stage("contigs", index.contigs(fixture(spark, d, "dna")))
    out = store.listing()
    store.drop("contigs")
    return out
