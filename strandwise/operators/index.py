"""Reference tables: contigs, ambiguity runs, k-mers of both strands, suffix ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import revcomp
from strandwise.plans.prefix import running_totals


def contigs(fasta: DataFrame, order: str = "doc_id") -> DataFrame:
    """``rid, name, offset, len, n_ambs`` of sequences in the order of an integer column.

    ``rid`` counts from 0 and ``offset`` is the place on the concatenated axis.
    """
    runs = F.size(F.filter(F.split("seq", r"(?<=(.))(?!\1)"), lambda x: x.rlike("^[^ACGTacgt]")))
    base = fasta.select(F.col(order), F.length("seq").cast("bigint").alias("len"), runs.cast("bigint").alias("n_ambs"))
    placed = running_totals(base, order, {"rid": "1", "offset": "len"})
    return placed.select("rid", F.col(order).alias("name"), "offset", "len", "n_ambs")


def sequences(fasta: DataFrame, order: str = "doc_id") -> DataFrame:
    """:func:`contigs` with their ``seq``, and ``l_pac``, the length of the whole axis."""
    with_len = fasta.select(order, "seq").withColumn("len", F.length("seq").cast("bigint"))
    placed = running_totals(with_len, order, {"rid": "1", "offset": "len"})
    whole = fasta.agg(F.coalesce(F.sum(F.length("seq").cast("bigint")), F.lit(0)).alias("l_pac"))
    return placed.withColumn("l_pac", F.lit(whole.first().l_pac).cast("bigint"))


def axis(fasta: DataFrame, order: str = "doc_id") -> DataFrame:
    """``order, rid, offset, len, l_pac`` of sequences: their places on the axis without the sequences themselves."""
    light = fasta.select(order, F.length("seq").cast("bigint").alias("len"))
    whole = light.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("l_pac")).first().l_pac
    return running_totals(light, order, {"rid": "1", "offset": "len"}).withColumn("l_pac", F.lit(whole).cast("bigint"))


def holes(fasta: DataFrame) -> DataFrame:
    """Runs of one ambiguous letter: ``doc_id, start, len, amb``, each from the letters that differ from their left neighbour."""
    at = fasta.where(F.col("seq").rlike("[^ACGTacgt]")).select("doc_id", F.posexplode(F.split("seq", "")).alias("i", "b")).where(~F.col("b").rlike("^[ACGTacgt]?$"))
    left = Window.partitionBy("doc_id", "b").orderBy("i")
    runs = at.withColumn("island", F.col("i") - F.row_number().over(left))
    return runs.groupBy("doc_id", "b", "island").agg(F.min("i").cast("bigint").alias("start"), F.count("*").alias("len")).select("doc_id", "start", "len", F.col("b").alias("amb"))


def tiles(contig_seqs: DataFrame, overlap: int, width: int = 8192) -> DataFrame:
    """``rid, offset, len, l_pac, tile, lead, bases``: contigs as pieces of ``width`` bases.

    Each has ``overlap`` bases of the next piece behind it and ``lead`` bases,
    one but for the first, of the piece before.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(width))
    at = contig_seqs.select("rid", "offset", "len", "l_pac", F.col("seq").cast("binary").alias("raw"), F.explode(starts).alias("start"))
    lead = F.least(F.col("start"), F.lit(1))
    piece = F.substring("raw", F.col("start") - lead + 1, lead + width + overlap).cast("string")
    return at.select("rid", "offset", "len", "l_pac", F.expr(f"start div {width}").alias("tile"), lead.alias("lead"), piece.alias("bases"))


def packed_kmers(table: DataFrame, seq: Column, k: int, keep: list) -> DataFrame:
    """``keep, n, pos, kmer, before, after``: k-mers of a sequence of ``n`` bases without an ambiguous base, two bits a base.

    ``before`` and ``after`` are the neighbours as digits in ASCII, 0 where
    there is none.  Sequences are turned to digits once; k-mers are then cut
    from bytes, so each costs k whatever its place.
    """
    if not 0 < k <= 31:
        raise ValueError("a packed k-mer has 1 to 31 bases")
    digits = F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "n"), "ACGTacgt", "01230123").cast("binary")
    read = table.select(*keep, digits.alias("_raw")).withColumn("n", F.length("_raw"))
    at = read.where(F.col("n") >= k).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - k)))
    text = at.withColumn("_text", F.substring("_raw", F.col("pos") + 1, F.lit(k)).cast("string")).where(~F.contains("_text", F.lit("n")))
    before = F.when(F.col("pos") > 0, F.ascii(F.substring("_raw", F.col("pos"), F.lit(1)).cast("string"))).otherwise(0).cast("tinyint")
    after = F.ascii(F.substring("_raw", F.col("pos") + k + 1, F.lit(1)).cast("string")).cast("tinyint")
    return text.select(*keep, "n", "pos", packed(F.col("_text")).alias("kmer"), before.alias("before"), after.alias("after"))


def same_base(a: Column, b: Column) -> Column:
    """Whether two neighbours of :func:`packed_kmers` are one and the same base."""
    return (a == b) & a.between(48, 51)


def packed(digits: Column) -> Column:
    return F.conv(digits, 4, 10).cast("bigint")


def unpacked(kmer: Column, k: int) -> Column:
    """The lower-case bases of a packed k-mer."""
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "acgt")


def packed_bases(bases: Column) -> Column:
    """A k-mer given as text, packed; null with an ambiguous base."""
    return F.when(~bases.rlike("[^ACGTacgt]"), packed(F.translate(bases, "ACGTacgt", "01230123")))


def kmers(contig_seqs: DataFrame, k: int) -> DataFrame:
    """``kmer, rid, gpos, before, after, l_pac``: every k-mer without an ambiguous base of the forward strand, by its place on the axis.

    Searches turn their reads around instead of the reference, which halves
    the larger side of every join.
    """
    # tiles of one long contig are dealt to many tasks before their k-mers are made
    n = int(contig_seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = 8192
    dealt = tiles(contig_seqs, k, width).drop("len").repartition(n, "rid", "tile")
    flat = packed_kmers(dealt, F.col("bases"), k, ["rid", "offset", "l_pac", "tile", "lead"])
    own = flat.withColumn("pos", F.col("pos") - F.col("lead")).where((F.col("pos") >= 0) & (F.col("pos") < width))
    return own.select("kmer", "rid", (F.col("offset") + F.col("tile") * width + F.col("pos")).cast("bigint").alias("gpos"), "before", "after", "l_pac")


def both_strands(forward: DataFrame, k: int) -> DataFrame:
    """``kmer, rid, strand, gpos`` of both strands on the doubled axis, where the reverse of the whole axis follows it; k-mers as text."""
    text = forward.withColumn("kmer", unpacked(F.col("kmer"), k))
    turned = text.select(revcomp(F.col("kmer")).alias("kmer"), "rid", F.lit(1).alias("strand"), (2 * F.col("l_pac") - F.col("gpos") - k).alias("gpos"))
    return text.select("kmer", "rid", F.lit(0).alias("strand"), "gpos").unionByName(turned)


def suffix_ranks(spark: SparkSession, text: DataFrame) -> DataFrame:
    """Ranks of all suffixes of each sequence of ``text(doc_id, seq)`` by prefix doubling: ``doc_id, pos, rank``.

    A round ranks pairs of ranks at distance h and doubles h; ranks are window
    functions per sequence, so sequences are independent.  Rounds stop when
    every rank is unique; each is materialised to cut the lineage.
    """
    from strandwise.plans.scratch import materialise

    at = text.select("doc_id", F.posexplode(F.split("seq", "")).alias("pos", "b")).where("b <> ''")
    ranks = materialise(spark, at.select("doc_id", "pos", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("b")).alias("rank")))
    h = 1
    while True:
        ahead = ranks.select("doc_id", (F.col("pos") - h).alias("pos"), F.col("rank").alias("after"))
        pair = ranks.join(ahead, ["doc_id", "pos"], "left").withColumn("after", F.coalesce("after", F.lit(0)))
        ranks = materialise(spark, pair.select("doc_id", "pos", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("rank", "after")).alias("rank")))
        h *= 2
        if ranks.groupBy("doc_id", "rank").count().where("count > 1").isEmpty():
            return ranks.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("rank").cast("bigint").alias("rank"))
