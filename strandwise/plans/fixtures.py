"""Sequence tables derived from the driver's tables, whole tables throughout."""

from __future__ import annotations

from strandwise.plans.registry import FIXTURES

_DNA = "translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', ''<g>), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac')"

FIXTURES |= {
    "num": "SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f FROM {lineitem}",
    "dna": f"SELECT doc_id, {_DNA} AS seq FROM {{documents}}",
    # reads of 100 bases from every document that has 400
    "reads": "SELECT doc_id * 2 AS read_id, doc_id, substring(seq, CAST((doc_id * 7919) % (length(seq) - 100) + 1 AS INT), 100) AS seq FROM {dna} WHERE length(seq) >= 400 "
    "UNION ALL SELECT doc_id * 2 + 1 AS read_id, doc_id, concat(substring(seq, 1, 49), translate(substring(seq, 50, 1), 'acgt', 'cgta'), substring(seq, 51, 50)) AS seq FROM {dna} WHERE length(seq) >= 400",
    # both ends of an insert
    "reads_pe": "SELECT doc_id AS pair_id, substring(seq, CAST(st AS INT), 60) AS r1, translate(reverse(substring(seq, CAST(st + ins - 60 AS INT), 60)), 'acgt', 'tgca') AS r2, ins "
    "FROM (SELECT doc_id, seq, (doc_id * 7919) % (length(seq) - 300) + 1 AS st, 170 + (doc_id * 31) % 161 - 80 AS ins FROM {dna} WHERE length(seq) >= 400) AS x",
    # regions: each line of an order is a hit of the read that the order is
    "regions": "SELECT id AS read_id, CAST(n AS BIGINT) AS k, p % 25 AS rid, (p * 7919 + s * 31) % 20000 AS rb, (p * 7919 + s * 31) % 20000 + 30 + q AS re, (s * 7 + q) % 60 AS qb, (s * 7 + q) % 60 + 30 + q AS qe, "
    "20 + (p * 13 + s * 5 + n) % 80 AS score, CASE WHEN p % 9 = 0 THEN 1 ELSE 0 END AS is_alt FROM {num}",
    # seeds of the read that the order is, on few diagonals
    "seeds": "SELECT id AS read_id, (s * 11 + q) % 90 AS qbeg, 19 + q % 30 AS len, (p % 3) * 100000 + (s * 11 + q) % 90 + (p % 5) * 4 AS rbeg, 1 + (p * s) % 900 AS n_occ FROM {num}",
    # two ends with a position each
    "ends": "SELECT o_orderkey AS pair_id, o_custkey AS c, 100000 AS l_pac, (o_orderkey * 7919) % 99000 AS b1, CASE WHEN o_custkey % 10 < 7 THEN 199999 - ((o_orderkey * 7919) % 99000 + 100 + o_custkey % 120) "
    "WHEN o_custkey % 10 = 7 THEN (o_orderkey * 7919) % 99000 + o_custkey % 700 ELSE (o_orderkey * 104729) % 200000 END AS b2, 60 + o_custkey % 40 AS s1, 60 + (o_custkey * 7) % 40 AS s2, (o_custkey * 3) % 80 AS sub1, (o_custkey * 11) % 70 AS sub2, o_custkey % 30 AS batch FROM {orders}",
    "cigars": "SELECT id, n, p, s, q, concat(CASE WHEN p % 3 = 0 THEN concat(CAST(1 + p % 9 AS STRING), 'S') ELSE '' END, CAST(10 + q AS STRING), 'M', CASE WHEN s % 2 = 0 THEN concat(CAST(1 + s % 5 AS STRING), 'D') ELSE concat(CAST(1 + s % 4 AS STRING), 'I') END, CAST(20 + p % 40 AS STRING), 'M') AS cigar FROM {num}",
    "fastq": "SELECT doc_id AS ordinal, concat('read.', CAST(doc_id AS STRING), '/', CAST(1 + doc_id % 2 AS STRING)) AS name, concat(CAST(1 + doc_id % 2 AS STRING), CASE WHEN doc_id % 5 = 0 THEN ':Y:0' ELSE ':N:0' END) AS comment, "
    "seq, translate(seq, 'acgt', CASE WHEN doc_id % 3 = 0 THEN 'I5#(' ELSE 'HB+&' END) AS qual FROM {dna}",
}
