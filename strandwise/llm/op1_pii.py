"""Personal data: base patterns, and candidates chosen by boosted trees; DataFrame operations only.

High-recall generators propose spans that may overlap, for forms that the base
patterns miss (spelled-out mail addresses, IPv6, dotted card numbers, national
phone numbers).  Boosted trees score format and context features of each, and
a threshold per kind, calibrated on rows of their own for a stated precision,
selects those to redact.  The trees are trained here on a bounded generated
sample and become one expression, so texts never leave the JVM.
"""

from __future__ import annotations

import os
import random
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.boosting import Forest, calibrate, fit

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, each written without useless backtracking.  A match can only start where a
#: run of its first characters starts or where the match before ended (\G), since a later start in the same run
#: meets the same continuation.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

GENERATORS = {
    "email": r"(?i)(?<![a-z0-9])[a-z0-9][a-z0-9._+-]{0,63}(?:@| ?[(\[{] ?at ?[)\]}] ?| at )[a-z0-9-]{1,63}(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?| dot )[a-z0-9-]{2,24})++",
    "ip": r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){3,7}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}",
    "phone": r"(?<![0-9])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){1,7}",
}
#: Cheap tests that a text must pass before its generator runs; whatever a generator matches passes.
GATES = {"email": r"@|(?i: at |[(\[{] ?at)", "ip": r":[0-9A-Fa-f]{0,4}:|[0-9]\.[0-9]", "card": r"[0-9][\x20./_-]{0,2}[0-9]", "phone": r"[0-9]\)?[\x20./-]{1,2}\(?[0-9]"}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login from|client|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell|sms|telefon|teléfono|appel)\b",
}
AGAINST = r"(?i)\b(?:version|v|release|order|isbn|page|pages|chapter|section|id|ref|no|invoice|row|total|date|between|score)\b[^a-z]*$"
FEATURES = ("kind", "size", "digits", "letters", "marks", "blanks", "luhn", "before", "after", "context", "against", "zero", "colons", "groups")
SAMPLE_ROWS = 2400
PRECISION = 0.97
REACH = 40


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.split(F.reverse(digits), "")
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        F.lit(0),
        lambda a, i: a
        + F.when(i % 2 == 0, F.get(back, i).cast("int")).otherwise(
            F.get(back, i).cast("int") * 2 - F.when(F.get(back, i).cast("int") > 4, F.lit(9)).otherwise(F.lit(0))
        ),
    )
    return total % 10 == 0


def _running(values: str, combine: Callable[[Column, Column], Column], zero: int, block: int = 256) -> Column:
    """Inclusive running values of a column of integers; in two levels, so that no long array is copied for each value.

    ``values`` is the name of a column: an expression would be computed again for every block.
    """
    start = F.lit(zero)
    bare = F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / block).cast("int")), lambda j: F.slice(values, j * block + 1, block))

    def extend(a: Column, at: Column, value: Column) -> Column:
        return F.struct(at.alias("at"), F.concat(a["out"], F.array(value)).alias("out"))

    totals = F.transform(blocks, lambda b: F.aggregate(b, start, combine))
    earlier = F.aggregate(totals, F.struct(start.alias("at"), bare.alias("out")), lambda a, t: extend(a, combine(a["at"], t), a["at"]), lambda a: a["out"])
    within = lambda b, z: F.aggregate(b, F.struct(z.alias("at"), bare.alias("out")), lambda a, v: extend(a, combine(a["at"], v), combine(a["at"], v)), lambda a: a["out"])
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(blocks, earlier, within))).otherwise(bare)


def _matched(docs: DataFrame, to: str, kind: str, pattern: str, gate: Column) -> DataFrame:
    """``docs(.., body)`` with the matches of a pattern as ``array<struct<s, k, e, m, b, a>>`` in code points.

    What splits at the pattern is what lies between matches, so places are
    running sums.  ``b`` is what comes before, up to REACH characters and not
    past the match before, and ``a`` the character after.  Every step is a
    column of its own, since an expression inside a lambda is computed for
    each element.
    """
    body, none = F.col("body"), F.array().cast("array<string>")
    m, p, i0 = F.col("_m"), F.col("_p"), F.size("_m")
    docs = docs.withColumn("_m", F.when(gate, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(none))
    docs = docs.withColumn("_p", F.when(F.size("_m") > 0, F.split(body, pattern, -1)).otherwise(none))

    def piece(i: Column) -> Column:
        gap, own = F.get(p, i), F.get(m, i)
        near = F.concat_ws("", F.right(F.get(p, i - 1), F.lit(REACH)), F.get(m, i - 1), F.right(gap, F.lit(REACH)))
        after = F.concat_ws("", F.left(F.get(p, i + 1), F.lit(1)), F.left(F.get(m, i + 1), F.lit(1)))
        return F.struct(F.length(gap).alias("g"), F.length(own).alias("n"), own.alias("m"), F.right(near, F.lit(REACH)).alias("b"), F.left(after, F.lit(1)).alias("a"))

    empty = F.array().cast("array<struct<g:int,n:int,m:string,b:string,a:string>>")
    docs = docs.withColumn("_z", F.when(i0 > 0, F.transform(F.sequence(F.lit(0), F.greatest(i0, F.lit(1)) - 1), piece)).otherwise(empty)).drop("_m", "_p")
    docs = docs.withColumn("_v", F.transform("_z", lambda z: z["g"] + z["n"]))
    docs = docs.withColumn("_e", _running("_v", lambda a, b: a + b, 0))
    k = F.lit(KINDS.index(kind))
    placed = F.zip_with("_z", "_e", lambda z, e: F.struct((e - z["n"]).alias("s"), k.alias("k"), e.alias("e"), z["m"].alias("m"), z["b"].alias("b"), z["a"].alias("a")))
    return docs.withColumn(to, placed).drop("_z", "_v", "_e")


def _clear(docs: DataFrame) -> DataFrame:
    """``docs(.., base, cands)`` with ``fresh``: the candidates that overlap no base span, in order of start.

    In order of start a candidate is hit by the furthest end of the base spans
    up to it or by the next start of one after it.
    """
    both = F.concat(
        F.transform("base", lambda b: F.struct(b["s"].alias("s"), F.lit(0).alias("c"), b["e"].alias("e"), F.lit(-1).alias("i"))),
        F.transform("cands", lambda c, i: F.struct(c["s"].alias("s"), F.lit(1).alias("c"), c["e"].alias("e"), i.alias("i"))),
    )
    far = (1 << 31) - 1
    docs = docs.withColumn("_x", F.when((F.size("base") > 0) & (F.size("cands") > 0), F.array_sort(both)).otherwise(F.array().cast("array<struct<s:int,c:int,e:int,i:int>>")))
    docs = docs.withColumn("_v", F.transform("_x", lambda x: F.when(x["c"] == 0, x["e"]).otherwise(F.lit(0))))
    docs = docs.withColumn("_w", F.reverse(F.transform("_x", lambda x: F.when(x["c"] == 0, x["s"]).otherwise(F.lit(far)))))
    docs = docs.withColumn("_until", _running("_v", lambda a, b: F.greatest(a, b), 0)).withColumn("_next", F.reverse(_running("_w", lambda a, b: F.least(a, b), far)))
    docs = docs.withColumn("_y", F.arrays_zip(F.col("_x").alias("x"), F.col("_until").alias("u"), F.col("_next").alias("n")))
    free = F.filter("_y", lambda y: (y["x"]["c"] == 1) & (y["u"] <= y["x"]["s"]) & (y["n"] >= y["x"]["e"]))
    docs = docs.withColumn("_f", free).drop("_x", "_v", "_w", "_until", "_next", "_y")
    fresh = F.when(F.size("base") == 0, F.col("cands")).otherwise(F.transform("_f", lambda y: F.get("cands", y["x"]["i"])))
    return docs.withColumn("fresh", fresh).drop("_f")


def _valid(kind: str) -> Callable[[Column], Column]:
    def check(span: Column) -> Column:
        m = span["m"]
        if kind == "ip":
            return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
        digits = F.regexp_replace(m, "[^0-9]", "")
        if kind == "card":
            return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
        return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)

    return check


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _features(span: Column) -> Column:
    """Format and context of one candidate."""
    m, before, k = span["m"], span["b"], span["k"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    hint = F.lit(False)
    for i, kind in enumerate(KINDS):
        hint = F.when(k == i, before.rlike(CONTEXT[kind])).otherwise(hint)
    number = lambda c: c.cast("double")
    return F.struct(
        number(k).alias("kind"),
        number(F.length(m)).alias("size"),
        number(F.length(digits)).alias("digits"),
        number(_count(m, r"[A-Za-z]")).alias("letters"),
        number(_count(m, r"[./_@()\[\]-]")).alias("marks"),
        number(_count(m, r"\x20")).alias("blanks"),
        number(F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False)).cast("int")).alias("luhn"),
        number(before.rlike(r"[\p{L}\p{N}$€£#._:/-]$").cast("int")).alias("before"),
        number(span["a"].rlike(r"[\p{L}\p{N}%€°]").cast("int")).alias("after"),
        number(hint.cast("int")).alias("context"),
        number(before.rlike(AGAINST).cast("int")).alias("against"),
        number(m.rlike(r"^\(?0").cast("int")).alias("zero"),
        number(_count(m, ":")).alias("colons"),
        number(F.size(F.split(F.trim(m), r"[^0-9A-Za-z]+"))).alias("groups"),
    )


def _candidates(docs: DataFrame) -> DataFrame:
    """``docs(.., body)`` with ``cands array<struct<s, k, e, m, b, a>>`` of all generators."""
    for kind in KINDS:
        docs = _matched(docs, f"_{kind}", kind, GENERATORS[kind], F.col("body").rlike(GATES[kind]))
    return docs.withColumn("cands", F.concat(*(F.col(f"_{kind}") for kind in KINDS))).drop(*(f"_{kind}" for kind in KINDS))


# ---- the model -------------------------------------------------------------------------------------------------


def training_sample(rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[str, int]]:
    """A generated, bounded sample of ``(text, private?)``; each text holds one candidate form."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def luhn(n: int, ok: bool) -> str:
        body = str(r.randint(3, 6)) + digits(n - 2)
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str((10 - total % 10 + (0 if ok else r.randint(1, 9))) % 10)

    def grouped(number: str, sep: str, size: int = 4) -> str:
        return sep.join(number[i : i + size] for i in range(0, len(number), size))

    def national() -> str:
        sep = r.choice(" -./")
        return r.choice([f"({digits(3)}) {digits(3)}{sep}{digits(4)}", f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}", f"0{digits(3)}{sep}{digits(3)}{sep}{digits(3)}"])

    yes = {
        "mail": lambda: f"{word()}{r.choice([' at ', ' (at) ', '[at]', ' [at] '])}{word()}{r.choice([' dot ', ' (dot) ', '[dot]'])}{r.choice(['com', 'org', 'net', 'de'])}",
        "phone": national,
        "card": lambda: grouped(luhn(16, True), r.choice("./_-")),
        "ip": lambda: ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8)),
    }
    hints = {"mail": ["mail me", "contact", "write to"], "phone": ["call", "tel", "phone", "mobile"], "card": ["card", "visa", "payment by"], "ip": ["from host", "ip", "server"]}
    no = [
        lambda: f"{r.choice(['between', 'page', 'total', 'rows'])} {digits(2)} {digits(3)} {digits(2)}",
        lambda: f"{r.choice(['version', 'release'])} {digits(1)}.{digits(2)}.{digits(3)}.{digits(3)}",
        lambda: f"{r.randint(1990, 2030)}-{digits(2)}-{digits(2)} {digits(2)}",
        lambda: f"{digits(2)}/{digits(2)}/{r.randint(1990, 2030)}",
        lambda: f"{r.choice(['order', 'invoice', 'ref'])} {grouped(luhn(16, False), r.choice('./-'))}",
        lambda: f"isbn {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        lambda: f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}",
        lambda: f"score {digits(2)} - {digits(2)}",
        lambda: f"{word()} at {word()} dot {word()}{word()}",
        lambda: f"{digits(4)} {digits(4)}",
        lambda: f"{grouped(digits(12), '.', 3)}",
        lambda: f"${digits(2)}.{digits(3)}.{digits(3)}",
    ]
    out = []
    for i in range(rows):
        if i % 2:
            kind = r.choice(list(yes))
            lead = r.choice(hints[kind]) if r.random() < 0.75 else word()
            out.append((f"{word()} {word()} {lead} {yes[kind]()} {word()} {word()}", 1))
        else:
            out.append((f"{word()} {word()} {r.choice(no)()} {word()} {word()}", 0))
    return out


@lru_cache(maxsize=4)
def _trained(rows: int, precision: float) -> tuple[Forest, tuple[float, ...], tuple[float, float]]:
    spark = SparkSession.active()
    sample = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(training_sample(rows))], "i int, body string, y int")
    spans = _candidates(sample).select("i", "y", "body", F.explode("cands").alias("c"))
    got = spans.select("i", "y", _features(F.col("c")).alias("f")).orderBy("i", "f").collect()
    x = np.array([[g.f[name] for name in FEATURES] for g in got], float)
    y = np.array([g.y for g in got], float)
    split = np.array([g.i // 2 % 4 for g in got])  # two parts for the trees, one for the thresholds, one for the accuracy
    forest = fit(x[split > 1], y[split > 1], FEATURES)
    margin, kind = forest.margin(x), x[:, 0]
    cuts = tuple(max(0.0, calibrate(margin[(kind == k) & (split == 1)], y[(kind == k) & (split == 1)], precision)) for k in range(len(KINDS)))
    chosen = (margin >= np.array(cuts)[kind.astype(int)])[split == 0]
    truth = y[split == 0]
    return forest, cuts, (float(truth[chosen].mean()), float(chosen[truth == 1].mean()))


def trained(spark: SparkSession, rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> tuple[Forest, tuple[float, ...], tuple[float, float]]:
    """The trees, a threshold for each kind, and precision and recall on rows that gave neither; at most ``rows`` generated texts."""
    return _trained(rows, precision)


# ---- the operator ----------------------------------------------------------------------------------------------


def personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, text, base, added`` of ``docs(doc_id, text)``.

    ``base`` and ``added`` are ``array<struct<s, k, e, m>>``: code points, end
    exclusive, ``k`` the index in KINDS, ordered by start.  A null text is
    empty and has no span; each row is its own, repeated ones included; a null
    ``doc_id`` is kept; a text of any length is one row, and the work grows with
    its length and matches; an empty table gives no rows; other columns are ignored.  An added span never
    overlaps a base span, and of added spans that overlap the one
    with the higher score stays.
    """
    forest, cuts, _ = trained(spark)
    body = F.col("body")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    gate = {"email": body.contains("@"), "phone": body.contains("+"), "ip": body.rlike(r"[0-9]\.[0-9]"), "card": F.lit(True)}
    bare = lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["m"].alias("m"))
    for kind in KINDS:
        own = _matched(own, f"_base_{kind}", kind, BASE[kind], gate[kind])
    base = F.concat(*(F.transform(F.filter(f"_base_{kind}", _valid(kind)), bare) for kind in KINDS))
    own = own.withColumn("base", F.array_sort(base)).drop(*(f"_base_{kind}" for kind in KINDS))
    own = _clear(_candidates(own))
    seen = F.transform("fresh", lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["m"].alias("m"), _features(c).alias("f")))
    own = own.withColumn("seen", seen)
    cut = lambda k: F.element_at(F.array(*map(F.lit, cuts)), k + 1)
    scored = F.transform("seen", lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["m"].alias("m"), forest.column(lambda n: c["f"][n]).alias("score")))
    own = own.withColumn("scored", F.array_sort(F.filter(scored, lambda c: c["score"] >= cut(c["k"]))))
    empty = F.array().cast("array<struct<s:int,k:int,e:int,m:string,score:double>>")

    def pick(a: Column, c: Column) -> Column:
        last = F.element_at(a, -1)
        clear = (F.size(a) == 0) | (F.coalesce(F.try_element_at(a, F.lit(-1))["e"], F.lit(0)) <= c["s"])
        return F.when(clear, F.concat(a, F.array(c))).when(last["score"] < c["score"], F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(c))).otherwise(a)

    chosen = F.aggregate("scored", empty, pick)
    return own.select("doc_id", F.col("body").alias("text"), "base", F.transform(chosen, bare).alias("added"))


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in angle brackets; overlapping spans are one."""
    found = personal_data(spark, docs).withColumn("spans", F.array_sort(F.concat("base", "added")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    names = F.array(*map(F.lit, KINDS))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
        inside = x["s"] < a["at"]
        return F.struct(F.when(inside, a["out"]).otherwise(F.concat(a["out"], gap, F.lit("<"), F.element_at(names, x["k"] + 1), F.lit(">"))).alias("out"), F.greatest(a["at"], x["e"]).alias("at"))

    text = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return found.select("doc_id", text.alias("text"))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark, spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))
    counts = [F.size(F.filter("base", _is(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "added"), KINDS).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


def _is(k: int) -> Callable[[Column], Column]:
    return lambda x: x["k"] == k


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
