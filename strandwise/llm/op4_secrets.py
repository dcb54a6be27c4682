"""Secret scans: base patterns, and credential-context values by their guess cost.

The guess cost of a value is the least cost of any segmentation into ranked
words, dates, repeats, sequences, keyboard walks and brute-force spans of any
length, found by dynamic programming over its positions; repeats, sequences and
walks go as far as they reach from where they begin.  A value after a credential keyword
is a secret if guessing it costs more than a threshold, so ``changeme`` and
``qwerty2019`` are left alone while short but random values are found.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.tokenize import bounded_batches, tokenizer_path

KINDS = ("assign", "access", "hex")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base patterns and the least lengths.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(rf"({'|'.join(map(_either, KEYWORDS))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Credential context beyond the base keywords, with a separator and a value of any printable characters.
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "api", "auth", "credential", "private", "bearer", "login", "key")
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|(?:client[_-]?)?secret(?:[_-]?key)?|(?:auth|access)?[_-]?token|(?:api|access|private|secret)[_-]?key|auth(?:orization)?|credentials?|bearer|login)"
    r"[\"']?[\x20\t]{0,8}(?::=|=>|[:=]|\x20is\x20)[\x20\t]{0,8}(?:[\"'](?P<quoted>[^\"'\n]{6,}+)[\"']|(?P<bare>[^\s\"',;<>]{6,}+))",
    re.IGNORECASE | re.ASCII,
)

#: Common parts of weak passwords, by rank; the words of a public vocabulary follow in its order.
WORDS = (
    "password passwd pass qwerty abc admin welcome login letmein monkey dragon master hello freedom whatever shadow sunshine princess football baseball "
    "iloveyou trustno superman batman secret access default changeme change guest root user test testing example sample demo temp foobar foo bar "
    "none null true false token key value api your here insert placeholder xxx todo redacted hidden masked string number name company service server "
    "database data prod production dev staging local host mail email web app client summer winter spring autumn monday friday january june july "
    "love baby angel michael jordan hunter ranger buster soccer hockey killer george charlie andrew michelle jessica pepper daniel computer internet "
    "cheese corvette cookie ginger maggie summer silver orange purple yellow green blue black white red house money power star magic secure safe "
    "the and for with this that not are was you has have from"
).split()
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
THRESHOLD_BITS = 38.0
SEGMENT_BITS = 1.0
LEAST_WORD = 3


@lru_cache(maxsize=2)
def _ranks(vocabulary: str) -> tuple[dict[str, float], int]:
    """Bits of each word by its rank, and the length of the longest; vocabularies list frequent pieces first."""
    with open(vocabulary, encoding="utf-8") as file:
        pieces = json.load(file)["model"]["vocab"]
    whole = (t.removesuffix("</w>") for t in sorted(pieces, key=pieces.get) if t.endswith("</w>"))
    ranked = dict.fromkeys([*WORDS, *(w for w in whole if len(w) >= LEAST_WORD and w.isascii() and w.isalpha())])
    return {w: math.log2(i + 2) for i, w in enumerate(ranked)}, max(map(len, ranked))


@lru_cache(maxsize=1)
def _neighbours() -> dict[str, set[str]]:
    """Keys next to each key on the same or an adjoining row."""
    at = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    return {c: {d for d, (s, j) in at.items() if d != c and abs(r - s) <= 1 and abs(i - j) <= 1} for c, (r, i) in at.items()}


LEET = str.maketrans("@4310$57!", "aaeiossti")


def _char_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if c.isascii() and c.isalpha():
        return math.log2(26)
    return math.log2(33) if c.isascii() else 8.0


def _runs(follows: list[bool]) -> list[int]:
    """The number of true values from each place on."""
    out = [0] * (len(follows) + 1)
    for a in range(len(follows) - 1, -1, -1):
        out[a] = out[a + 1] + 1 if follows[a] else 0
    return out


def brute_bits(value: str) -> list[float]:
    """Bits of guessing each beginning of the value character by character."""
    out = [0.0]
    for c in value:
        out.append(out[-1] + _char_bits(c) + (0.5 if c.isupper() else 0.0))
    return out


def patterns(value: str, vocabulary: str | None = None) -> Callable[[int], list[tuple[int, float]]]:
    """``a -> [(b, bits)]``: the words, dates, repeats, sequences and walks that begin at ``a`` and end before ``b``."""
    low, n = value.lower(), len(value)
    leet = low.translate(LEET)
    (ranks, longest), near = _ranks(vocabulary or tokenizer_path()), _neighbours()
    brute = brute_bits(value)
    again = [_runs([low[i] == low[i + unit] for i in range(n - unit)]) + [0] * unit for unit in range(1, 5)]
    walks = _runs([low[i + 1] in near.get(low[i], ()) for i in range(n - 1)])

    def at(a: int) -> list[tuple[int, float]]:
        out = []
        for b in range(a + LEAST_WORD, min(n, a + longest) + 1):
            word = low[a:b]
            bits = ranks.get(word)
            if bits is None and leet[a:b] != word and (hit := ranks.get(leet[a:b])) is not None:
                bits = hit + 1
            if bits is not None:
                cased = value[a:b]
                out.append((b, bits + (0 if cased == word else 1 if cased in (word.upper(), word.capitalize()) else 2 + (b - a) / 2)))
        for size in (4, 6, 8, 10):
            if a + size <= n and (date := _date_bits(value[a : a + size])) is not None:
                out.append((a + size, date))
        for unit in range(1, 5):  # repeats of one to four characters
            times = 1 + again[unit - 1][a] // unit
            if times >= (3 if unit == 1 else 2):
                out.append((a + times * unit, brute[a + unit] - brute[a] + math.log2(times)))
        step, b = None, a + 1
        while b < n and low[b].isalnum() and (d := ord(low[b]) - ord(low[b - 1])) in (-1, 1) and step in (None, d):
            step, b = d, b + 1
        if b - a >= 3:
            out.append((b, _char_bits(low[a]) + math.log2(b - a) + 1))
        if a < n and walks[a] >= 3:
            out.append((a + 1 + walks[a], math.log2(47) + walks[a] * 1.5))
        return out

    return at


def guess_bits(value: str, enough: float = math.inf, vocabulary: str | None = None) -> float:
    """log2 of the guesses for ``value``: the cheapest segmentation over all cuts; linear in its length.

    Where that is ``enough`` or more, any number from ``enough`` up may be given instead.
    """
    n = len(value)
    brute, begin = brute_bits(value), patterns(value, vocabulary)
    best = [0.0] + [math.inf] * n
    least_start = math.inf  # the least of best[a] - brute[a] so far: where the cheapest brute-force span begins
    look = 32
    for a in range(n + 1):
        best[a] = min(best[a], least_start + brute[a] + SEGMENT_BITS)
        if a == look:  # every segmentation has a cut from here on, or a brute-force span that reaches here
            if (least := min(min(best[a:]), least_start + brute[a] + SEGMENT_BITS)) >= enough:
                return least
            look *= 2
        least_start = min(least_start, best[a] - brute[a])
        if a < n:
            for b, bits in begin(a):
                best[b] = min(best[b], best[a] + bits + SEGMENT_BITS)
    return best[n]


def _date_bits(text: str) -> float | None:
    """Bits of a year or of a day written with or without separators."""
    if len(text) == 4:
        return math.log2(130) if text.isdigit() and 1900 <= int(text) < 2030 else None
    digits = re.sub(r"[-/._]", "", text)
    if not digits.isdigit() or (len(text) != len(digits) and len(text) != len(digits) + 2):
        return None
    if len(digits) == 8:
        parts = [(digits[:4], digits[4:6], digits[6:]), (digits[4:], digits[2:4], digits[:2]), (digits[4:], digits[:2], digits[2:4])]
    elif len(digits) == 6:
        parts = [("20" + digits[:2], digits[2:4], digits[4:]), ("20" + digits[4:], digits[2:4], digits[:2]), ("20" + digits[4:], digits[:2], digits[2:4])]
    else:
        return None
    if any(1900 <= int(y) < 2100 and 1 <= int(m) <= 12 and 1 <= int(d) <= 31 for y, m, d in parts):
        return math.log2(365 * 130) + (2 if len(text) != len(digits) else 0)
    return None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, in order."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, base: list[tuple[int, int, int]], threshold: float = THRESHOLD_BITS) -> list[tuple[int, int, int]]:
    """Credential-context values that cost ``threshold`` bits or more, clear of base spans."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        name = "quoted" if m["quoted"] is not None else "bare"
        value = m[name].rstrip(".)]}!?:") if name == "bare" else m[name]
        end = m.start(name) + len(value)
        if any(a < end and m.start() < b for a, _, b in base):
            continue
        if len(value) >= 6 and not (name == "quoted" and value.count(" ") > 1) and guess_bits(value, threshold) >= threshold:
            out.append((m.start(), 0, end))
    return out


def secrets(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD_BITS) -> DataFrame:
    """``doc_id, base, added`` of ``docs(doc_id, text)``, each ``array<struct<s, k, e>>`` in code points.

    ``k`` is the index in KINDS; added spans are of the kind ``assign`` and
    never overlap a base span.  A null text is empty; every row is scanned
    whole and alone, so repeated rows, ties, null ids and very long texts need no
    care; an empty table gives no rows; other columns are ignored.
    """
    spans = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))

    def run(batches):
        for batch in batches:
            base, added = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text) if text else []
                base.append([dict(zip("ske", x, strict=True)) for x in found])
                added.append([dict(zip("ske", x, strict=True)) for x in (added_spans(text, found, threshold) if text else [])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(added, spans)], ["doc_id", "base", "added"])

    bounded_batches(spark)
    kind = "array<struct<s:int,k:int,e:int>>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, f"doc_id bigint, base {kind}, added {kind}")


def _joined(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[x['k']]}:{x['s']}:{x['e']}" for x in sorted(spans, key=lambda x: (x["s"], x["k"], x["e"])))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(spark, spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, base, added in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((doc_id, *(sum(x["k"] == k for x in base) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return found.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_secrets": op4_secrets}
ORACLES: dict[str, str] = {}
