"""Token files: exact round trips."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from helpers import empty, table
from strandwise.llm import op2_bitplane as B
from strandwise.llm import op9_separators as S
from strandwise.llm.tokenize import ChunkEncoder, tokenizer_path

TOK = Tokenizer.from_file(tokenizer_path())


def whole(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def test_chunks_equal_whole_texts():
    r = random.Random(1)
    odd = ["İstanbul Σίσυφος", "a's 'tis don't 'S \"'ll\" (he's)", "x\x1cy\x1d z\x85q", "é é ,́ a.́b", "<|endoftext|> foo<|startoftext|>bar", "日本語 ١٢٣ ½x x½", "", "  ", "a.b,c!?d..", "🎉hi🎉 #$%", "ǅ ǆ ß ſ K"]
    alphabet = "abcXYZ'.,;:!?()<|> \n\t0123éßİſ日́ \xa0#&"
    odd += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(400)]
    got = ChunkEncoder(tokenizer_path(), 2, entries=50).encode_all(pa.array([*odd, None]))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [whole(t) for t in [*odd, None]]


def test_added_tokens_in_any_case():
    r = random.Random(2)
    added = ["<|endoftext|>", "<|startoftext|>"]
    mixed = lambda s: "".join(c.upper() if r.random() < 0.3 else c for c in s)
    texts = ["<|ENDOFTEXT|> hi", "A<|endoftext|>B <|EndOfText|>"]
    texts += [" ".join(r.choice(["Hi", "é", "x.Y", mixed(r.choice(added)), r.choice(added) + "z", "Q" + mixed(r.choice(added))]) for _ in range(r.randint(1, 8))) for _ in range(1000)]
    got = ChunkEncoder(tokenizer_path(), 2).encode_all(pa.array(texts))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [whole(t) for t in texts]


def test_full_caches_change_nothing():
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdé,.'") for _ in range(r.randint(1, 4))) for _ in range(50)) for _ in range(60)]
    encoder = ChunkEncoder(tokenizer_path(), 2, entries=20)
    got = [encoder.encode_all(pa.array([t]))[0] for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [whole(t) for t in texts]


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(planes, width):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << (8 * width), n, dtype=np.uint64).astype(f"<u{width}")
        assert np.array_equal(B.from_planes(B.to_planes(ids, planes), n, width), ids)


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_file_reads_any_block(planes):
    rng = np.random.default_rng(1)
    out = io.BytesIO()
    writer = B.PlaneWriter(out, 2, planes, block_ids=64)
    docs = [(i if i % 5 else None, rng.integers(0, 50_000, int(rng.integers(0, 200)), dtype=np.uint16)) for i in range(40)]
    for i, ids in docs:
        writer.add(i, ids.tobytes())
    writer.close()
    reader = B.PlaneReader(pa.BufferReader(out.getvalue()))
    flat = np.concatenate([ids for _, ids in docs])
    for k in range(reader.n_blocks):
        assert np.array_equal(reader.read_block(k), flat[64 * k : 64 * k + 64])
    assert list(reader.documents()) == [(i, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, ids in docs]


def test_torn_file_is_refused():
    with pytest.raises(ValueError, match="complete"):
        B.PlaneReader(pa.BufferReader(b"SWBP0001" + b"\0" * 40))


def test_documents_in_order_with_starts(spark):
    docs = table(spark, clash=("ids", "start", "part", "n_tokens"))
    got = sorted((tuple(r) for r in B.round_trip(spark, docs).collect()), key=lambda r: r[1])
    rows = docs.collect()
    assert len(got) == len(rows)
    order = [r[0] for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    at = 0
    want = {}
    for r in rows:
        ids = np.array([*whole(r.text), 2], "<u4")
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for doc_id, start, n, crc in got:
        assert start == at
        assert (n, crc) in want[doc_id]
        at += n
    assert B.round_trip(spark, empty(spark)).count() == 0


@pytest.mark.parametrize("split", [2, 6, 64, 1 << 20])
def test_separators_stitch_over_any_split(spark, tmp_path, split):
    rng = np.random.default_rng(split)
    stream = rng.choice([5, 6, 7, S.END_ID], 700, p=[0.5, 0.3, 0.1, 0.1]).astype("<u2")
    cuts = [0, 1, 1, 350, 700]
    paths = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        paths.append(f"file://{tmp_path}/{k}.ids")
        (tmp_path / f"{k}.ids").write_bytes(stream[a:b].tobytes())
    ends = np.flatnonzero(stream == S.END_ID)
    want = [(i, int(n), True) for i, n in enumerate(np.diff(ends, prepend=-1))]
    if len(stream) - ends[-1] - 1:
        want.append((len(ends), int(len(stream) - ends[-1] - 1), False))
    assert sorted(tuple(r) for r in S.token_counts(spark, paths, split_bytes=split).collect()) == want


def test_counts_of_documents(spark, tmp_path):
    docs = table(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in S.op9_separators(spark, str(tmp_path)).collect())
    assert got == sorted((r.doc_id if r.doc_id is not None else -1, len(whole(r.text)) + 1) for r in docs.collect())
    assert S.token_counts(spark, []).count() == 0
