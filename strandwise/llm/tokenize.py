"""Whole texts to token ids with the ``tokenizers`` library, one cache a worker."""

from __future__ import annotations

import itertools
import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "word_bpe_49k.json"
CACHE_ENTRIES = 600_000
HELD_BYTES = 4_000_000

#: ASCII punctuation; an apostrophe before letters may be a contraction for the tokenizer, so none leads.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LEADING = PUNCTUATION.replace("'", "")
#: Letters below this have no case mapping that depends on context, but for the dotted capital I, and are stable under NFC.
PLAIN_END, DOTTED_I = "\u0250", "\u0130"
SEPARATORS = "\x1c\x1d\x1e\x1f"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    return public_tokenizers.path(name)


def _plain(core: str) -> bool:
    return core.isascii() or (max(core) < PLAIN_END and DOTTED_I not in core)


def _strings(array: pa.Array) -> list[str]:
    """``to_pylist`` of strings without a scalar for each."""
    return array.to_numpy(zero_copy_only=False).tolist()


class ChunkEncoder:
    """Texts to little-endian ids, remembering chunks between white space.

    The tokenizer's pre-tokenizer never crosses white space, and its normaliser
    works on single characters and combining sequences, so a text's ids are
    those of its chunks in order; the tests hold this against whole-text
    encoding.  Within a chunk, ASCII punctuation around letters is a token run
    of its own, and plain letters are looked up in lower case.  Chunks are told apart by Arrow,
    so Python sees each only once a block of texts.  New words go to
    the library together, as one text whose words the end-of-word tokens part;
    any other chunk goes there alone.  A full cache becomes the older one, from
    which chunks that come again move up, so frequent words are never relearned.
    """

    def __init__(self, path: str, width: int, literal_specials: bool = False, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = literal_specials
        vocab = self._tok.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._dtype = np.dtype(f"<u{width}")
        self._entries = entries
        self._cache: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._specials = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, self._specials)) or "(?!)").search

    def _library(self, chunk: str) -> bytes:
        return np.array(self._tok.encode(chunk, add_special_tokens=False).ids, self._dtype).tobytes()

    def _missing(self, chunks) -> list[str]:
        """Those of the chunks that no cache holds; the ones that only the older cache holds move up."""
        cache, old, out = self._cache, self._old, []
        for chunk in chunks:
            if chunk not in cache:
                if (ids := old.get(chunk)) is None:
                    out.append(chunk)
                else:
                    cache[chunk] = ids
        return out

    def _learn_words(self, words: list[str]) -> None:
        """Put words of plain lower-case letters into the cache."""
        ids = np.array(self._tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids if words else [], np.int64)
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):  # another kind of vocabulary
            self._cache.update((w, self._library(w)) for w in words)
            return
        flat, size = ids.astype(self._dtype).tobytes(), self._dtype.itemsize
        at = 0
        for word, end in zip(words, (ends * size).tolist(), strict=True):
            self._cache[word] = flat[at:end]
            at = end

    def _learn(self, chunks: list[str]) -> None:
        cache, parts, runs, alone = self._cache, [], set(), []
        special = self._special
        array = pa.array(chunks, pa.string())
        bare = pc.and_(pc.ascii_is_alpha(array), pc.ascii_is_lower(array))  # most chunks are words already
        words = set(_strings(array.filter(bare)))
        for chunk in _strings(array.filter(pc.invert(bare))):
            if chunk.isalpha() and (chunk.isascii() or _plain(chunk)):
                low = chunk.lower()
                words.add(low)
                if low != chunk:
                    parts.append((chunk, "", low, ""))
                continue
            tail = chunk.rstrip(PUNCTUATION)
            core = tail.lstrip(LEADING)
            if core.isalpha() and _plain(core) and not special(chunk):
                low = core.lower()
                lead, end = chunk[: len(tail) - len(core)], chunk[len(tail) :]
                parts.append((chunk, lead, low, end))
                words.add(low)
                runs.add(lead)
                runs.add(end)
            else:
                alone.append(chunk)
        for chunk in itertools.chain(alone, self._missing(runs), self._missing([""])):
            cache[chunk] = self._library(chunk)
        self._learn_words(self._missing(words))
        for chunk, lead, low, end in parts:
            cache[chunk] = cache[lead] + cache[low] + cache[end]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string array (null is empty), some million bytes at a time."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, size + HELD_BYTES)))
            out += self._encode_held(texts.slice(at, to - at))
            at = to
        return out

    def _encode_held(self, texts: pa.Array) -> list[bytes]:
        # only ASCII is lowered ahead of the tokenizer, and no text that then holds an added token, which the
        # library matches in its own case; what it takes for white space parts other chunks inside
        low = pc.ascii_lower(texts)
        plain = pc.string_is_ascii(texts)
        for added in self._specials:
            plain = pc.and_not(plain, pc.match_substring(low, added, ignore_case=True))
        texts = pc.if_else(plain, low, texts)
        odd = pc.match_substring_regex(texts, f"[{SEPARATORS}]")  # white space for Arrow, none for the tokenizer
        parted = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = parted.flatten().dictionary_encode()
        chunks = _strings(coded.dictionary)
        if len(self._cache) > self._entries // 2:
            self._old, self._cache = self._cache, {}
        self._learn(self._missing(chunks))
        values = list(map(self._cache.__getitem__, chunks))
        flat = np.frombuffer(b"".join(values), self._dtype)
        sizes = np.array(list(map(len, values)), np.int64) // self._dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        pick = coded.indices.to_numpy()
        sizes = sizes[pick]
        to = np.cumsum(sizes)
        ids = flat[np.repeat(starts[pick] - to + sizes, sizes) + np.arange(to[-1] if len(to) else 0)].tobytes()
        cuts = np.concatenate([[0], to])[parted.offsets.to_numpy() - parted.offsets[0].as_py()] * self._dtype.itemsize
        out = [ids[a:b] for a, b in itertools.pairwise(cuts.tolist())]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._library(texts[i].as_py())
        return out


@lru_cache(maxsize=2)
def encoder(path: str, width: int, literal_specials: bool) -> ChunkEncoder:
    """The worker's encoder, kept between tasks."""
    return ChunkEncoder(path, width, literal_specials)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, rows)


def id_buckets(docs: DataFrame, n: int) -> tuple[list, int]:
    """At most ``n - 1`` ascending cuts of ``doc_id`` that deal rows evenly; reads that column only."""
    cuts = docs.select("doc_id").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0]
    cuts = sorted(set(cuts or []))
    return cuts, len(cuts) + 1


def bucket_of(column, cuts: list):
    """The bucket of a value: the number of cuts below it; null goes first."""
    low = F.lit(0)
    if not cuts:
        return low
    # width_bucket(v, cuts) over an array of ascending cuts, written as a balanced tree of comparisons
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column <= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(column.isNull(), low).otherwise(tree(0, len(cuts)))


def token_rows(spark: SparkSession, docs: DataFrame, path: str, end_id: int, width: int, literal_specials: bool) -> DataFrame:
    """``(doc_id, ids binary)``: little-endian ids of ``width`` bytes with ``end_id`` appended; a null text is empty."""
    end = np.array([end_id], f"<u{width}").tobytes()

    def run(batches):
        enc = encoder(path, width, literal_specials)
        for batch in batches:
            ids = [x + end for x in enc.encode_all(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    bounded_batches(spark)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids binary")


def in_id_order(spark: SparkSession, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Deal token rows to ascending ranges of ``doc_id``, sorted within; partition k holds range k."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts, parts = id_buckets(docs, n)
    # ties of doc_id are ordered by their ids, which makes the files of a rerun the same
    return rows.repartitionById(parts, bucket_of(F.col("doc_id"), cuts)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
