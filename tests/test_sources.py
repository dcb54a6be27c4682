"""File sources: malformed input, splits, and records of every kind."""

import gzip
import io

import pytest

from strandwise.operators.store import IndexStore
from strandwise.sources import records


@pytest.mark.parametrize("size", [16, 40, 100, 1 << 20])
def test_splits_read_every_record_once(spark, tmp_path, size):
    rows = [(f"r{i}", "@+"[i % 2] * (i % 7 + 1)) for i in range(120)]  # qualities that look like headers
    (tmp_path / "x.fq").write_text("".join(f"@{n} c:{n}\n{'A' * len(q)}\n+\n{q}\n" for n, q in rows))
    records.register(spark)
    got = spark.read.format("fastq4").option("split_bytes", size).load(str(tmp_path / "x.fq")).collect()
    assert sorted((r.name, r.qual) for r in got) == sorted(rows)


def test_malformed_records_raise():
    for text in ("@a\nACGT\n+\nII\n", "@a\nACGT\nx\nIIII\n", "@a\nACGT\n"):
        with pytest.raises(ValueError, match="malformed"):
            list(records.four_line_records(iter(io.BytesIO(text.encode()))))
    with pytest.raises(ValueError, match="truncated"):
        list(records.mixed_records(iter(["@a", "ACGT", "+", "II"])))


def test_mixed_records():
    lines = [">a x y", "AC", "GT", "", "@b", "AC", "GT", "+b", "@I", "II", ">c", ">d", "A"]
    assert list(records.mixed_records(iter(lines))) == [("a", "x y", "ACGT", None), ("b", None, "ACGT", "@III"), ("c", None, "", None), ("d", None, "A", None)]


def test_bam_kinds():
    body = records.bam_header("@HD\n") + records.bam_record("p", 0x41, "ACGTN", "IIIII") + records.bam_record("p", 0x91, "AACC", "ABCD") + records.bam_record("s", 4, "G", None)
    stream = lambda: gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(body[:30]) + gzip.compress(body[30:])))
    assert list(records.bam_reads(stream())) == [("p", "1", "ACGTN", "IIIII"), ("p", "2", "GGTT", "DCBA"), ("s", "4", "G", None)]
    assert [r[0] for r in records.bam_reads(stream(), 4)] == ["s"]
    with pytest.raises(ValueError, match="BAM"):
        list(records.bam_reads(io.BytesIO(b"nope")))


def test_store(spark):
    store = IndexStore(spark)
    store.stage("a", spark.range(3))
    assert store.staged("a") and store.attach("a").count() == 3 and [tuple(r) for r in store.listing().collect()] == [("a", 3)]
    with pytest.raises(ValueError, match="already"):
        store.stage("a", spark.range(1))
    store.drop()
    assert not store.staged("a")


def test_a_task_reads_many_splits_and_hands_on_small_batches(tmp_path):
    rows = [(f"r{i}", "c", "A" * 3000, "I" * 3000) for i in range(1500)]
    (tmp_path / "x.fq").write_text("".join(f"@{n} {c}\n{s}\n+\n{q}\n" for n, c, s, q in rows))
    reader = records.FastqReader({"path": str(tmp_path / "x.fq"), "split_bytes": "50000"})
    parts = reader.partitions()
    assert len(parts) == 1  # 181 splits of 50,000 bytes were as many tasks
    batches = list(reader.read(parts[0]))
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == rows
    assert max(b.nbytes for b in batches) < 2 * records.BLOCK_BYTES


def test_bam_letters_and_quality_bounds():
    body = records.bam_header() + records.bam_record("x", 0, "=acmgrsvtwyhkdbn?", "!" * 8 + "~" * 9) + records.bam_record("e", 0, "", None)
    assert list(records.bam_reads(io.BytesIO(body))) == [("x", "4", "=ACMGRSVTWYHKDBNN", "!" * 8 + "~" * 9), ("e", "4", "", "")]
