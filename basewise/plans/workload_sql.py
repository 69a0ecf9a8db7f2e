"""DuckDB SQL of `workload`, written from the definitions, not from the plans: common table expressions by name."""

from __future__ import annotations

import re

from .workload import AS_BASES, LETTERS, K

_SEQ = f"translate(lower(text), '{LETTERS}', '{AS_BASES}')"
_CANON = "greatest(translate(w, 'CGAT', '0123'), translate(reverse(w), 'CGAT', '1032'))"


def _windows(prefix: str, source: str, keys: str) -> dict[str, str]:
    """<prefix>w: every window of source.s as string w at pos."""
    return {
        f"{prefix}c": f"SELECT {keys}, c * 256 AS off_, substr(s, c * 256 + 1, {256 + K - 1}) AS cs FROM {source}, unnest(range(0, CAST(ceil((length(s) - {K - 1}) / 256.0) AS BIGINT))) t(c) WHERE length(s) >= {K}",
        f"{prefix}w": f"SELECT {keys}, off_ + i AS pos, substr(cs, i + 1, {K}) AS w FROM {prefix}c, unnest(range(0, least(256, length(cs) - {K - 1}))) u(i)",
        f"{prefix}k": f"SELECT {keys}, pos, CASE WHEN regexp_matches(w, '[^CGAT]') THEN NULL ELSE {_CANON} END AS kmer FROM {prefix}w",
    }


PARTS = {
    "reg": "SELECT 'r' || r_regionkey AS tax_id, r_regionkey AS rk, r_name AS name FROM region",
    "nat": "SELECT 'n' || n_nationkey AS tax_id, 'r' || n_regionkey AS parent_id, n_regionkey AS rk, n_nationkey AS nk, n_name AS name FROM nation",
    "sup": "SELECT 's' || s_suppkey AS tax_id, 'n' || s_nationkey AS parent_id, rk, nk, s_suppkey AS sk, s_name AS name FROM supplier JOIN nat ON nk = s_nationkey",
    "node": """SELECT '1' AS tax_id, CAST(NULL AS VARCHAR) AS parent_id, 'root' AS name, 'no rank' AS rank, 0 AS depth, -1 AS a, -1 AS b, -1 AS c
        UNION ALL SELECT tax_id, '1', name, 'superkingdom', 1, rk, -1, -1 FROM reg
        UNION ALL SELECT tax_id, parent_id, name, 'genus', 2, rk, nk, -1 FROM nat
        UNION ALL SELECT tax_id, parent_id, name, 'species', 3, rk, nk, sk FROM sup""",
    "tax": """SELECT tax_id, parent_id, name, rank, CAST(depth AS INTEGER) AS depth, row_number() OVER (ORDER BY a, b, c) - 1 AS pre, a, b, c FROM node""",
    "up": """SELECT tax_id AS node, tax_id AS anc FROM tax
        UNION ALL SELECT tax_id, '1' FROM tax WHERE depth > 0
        UNION ALL SELECT tax_id, 'r' || a FROM tax WHERE depth > 1
        UNION ALL SELECT tax_id, 'n' || b FROM tax WHERE depth > 2""",
    "genome": f"SELECT doc_id, source AS file, lang, 'n' || (doc_id % 25) AS tax_id, {_SEQ} AS s FROM documents WHERE text IS NOT NULL",
    **_windows("g", "genome", "doc_id, file, tax_id"),
    "db": """SELECT kmer, CASE WHEN min(tax_id) = max(tax_id) THEN min(tax_id) WHEN min(rk) = max(rk) THEN 'r' || min(rk) ELSE '1' END AS tax_id
        FROM gk JOIN nat USING (tax_id) WHERE kmer IS NOT NULL GROUP BY kmer""",
    "dbn": "SELECT tax_id, count(*) AS n FROM db GROUP BY tax_id",
    "read": f"SELECT 'k' || (conv_id % 2) AS key, 'f' || (conv_id % 4) AS file, conv_id * 1000 + turn AS read_no, 'c' || conv_id || '.' || turn AS name, role, {_SEQ} AS s FROM conversations WHERE text IS NOT NULL",
    **_windows("r", "read", "key, file, read_no"),
    "hit": "SELECT key, file, read_no, pos, kmer, CASE WHEN kmer IS NULL THEN 'A' ELSE coalesce(tax_id, '0') END AS label FROM rk LEFT JOIN db USING (kmer)",
    "runs": """SELECT *, sum(fresh) OVER (PARTITION BY key, file, read_no ORDER BY pos) AS run FROM (
        SELECT *, CASE WHEN lag(label) OVER (PARTITION BY key, file, read_no ORDER BY pos) = label THEN 0 ELSE 1 END AS fresh FROM hit)""",
    "seg": "SELECT key, file, read_no, min(pos) AS start, min(label) AS label, count(*) AS n FROM runs GROUP BY key, file, read_no, run",
    "bad": f"""SELECT key, file, read_no, count(*) AS bad FROM (
        SELECT key, file, read_no, p, coalesce(lag(p) OVER (PARTITION BY key, file, read_no ORDER BY p), -1) AS q, len FROM (
          SELECT key, file, read_no, length(s) AS len, unnest(list_filter(range(0, length(s)), lambda i: NOT contains('CGAT', s[i + 1]))) AS p FROM read))
        WHERE q + 1 < len - {K - 1} GROUP BY key, file, read_no""",
    "err": f"""SELECT key, file, read_no, length(s) AS len, greatest(length(s) - {K - 1}, 0) AS win, coalesce(m, 0) + coalesce(bad, 0) AS errors
        FROM read LEFT JOIN (SELECT key, file, read_no, sum(n) AS m FROM seg WHERE label = '0' GROUP BY ALL) USING (key, file, read_no) LEFT JOIN bad USING (key, file, read_no)""",
    "h": "SELECT key, file, read_no, label AS tax_id, sum(n) AS h FROM seg WHERE label NOT IN ('0', 'A') GROUP BY ALL",
    "cand": """SELECT key, file, read_no, tax_id AS cand FROM h WHERE NOT EXISTS (
        SELECT 1 FROM h AS o JOIN up ON up.node = o.tax_id WHERE o.key = h.key AND o.file = h.file AND o.read_no = h.read_no AND up.anc = h.tax_id AND o.tax_id <> h.tax_id)""",
    "score": "SELECT key, file, read_no, cand, sum(h.h) AS score FROM cand JOIN up ON node = cand JOIN h USING (key, file, read_no) WHERE h.tax_id = anc GROUP BY ALL",
    "win": "SELECT * FROM score QUALIFY score = max(score) OVER (PARTITION BY key, file, read_no)",
    # the least common ancestor: the deepest of the ancestors that all winners have
    "cls": """SELECT key, file, read_no, arg_max(anc, depth) AS class_id, min(score) AS read_kmers FROM (
        SELECT key, file, read_no, anc, min(score) AS score, count(*) AS met, any_value(total) AS total FROM (
          SELECT *, count(*) OVER (PARTITION BY key, file, read_no) AS total FROM win) JOIN up ON node = cand GROUP BY key, file, read_no, anc)
        JOIN tax ON tax_id = anc WHERE met = total GROUP BY key, file, read_no""",
    "stat": """SELECT key, class_id AS tax_id, count(*) AS reads, sum(read_kmers) AS reads_kmers, sum(len) AS reads_bps, sum(errors / CAST(win AS DOUBLE)) AS es, sum(pow(errors / CAST(win AS DOUBLE), 2)) AS es2,
        sum((win - read_kmers) / CAST(win AS DOUBLE)) AS cs, sum(pow((win - read_kmers) / CAST(win AS DOUBLE), 2)) AS cs2 FROM cls JOIN err USING (key, file, read_no) GROUP BY ALL""",
    "contig": """SELECT key, label AS tax_id, sum(n) AS kmers, count(*) AS contigs, sum(n * n) AS squared_sum, max(n) AS max_len, count(DISTINCT file || '/' || read_no) AS reads_1kmer FROM seg WHERE label NOT IN ('0', 'A') GROUP BY ALL""",
    "longest": """SELECT key, label AS tax_id, name AS max_desc FROM (SELECT *, row_number() OVER (PARTITION BY key, label ORDER BY n DESC, file, read_no, start) AS r FROM seg WHERE label NOT IN ('0', 'A')) JOIN read USING (key, file, read_no) WHERE r = 1""",
    "uniq": "SELECT key, label AS tax_id, count(DISTINCT kmer) AS unique_kmers FROM hit WHERE label NOT IN ('0', 'A') GROUP BY ALL",
    "own": """SELECT key, tax_id, coalesce(reads, 0) AS reads, coalesce(reads_kmers, 0) AS reads_kmers, coalesce(reads_bps, 0) AS reads_bps, coalesce(kmers, 0) AS kmers, coalesce(unique_kmers, 0) AS unique_kmers, coalesce(contigs, 0) AS contigs,
        coalesce(squared_sum, 0) AS squared_sum, coalesce(max_len, 0) AS max_len, coalesce(reads_1kmer, 0) AS reads_1kmer, coalesce(es, 0) AS es, coalesce(es2, 0) AS es2, coalesce(cs, 0) AS cs, coalesce(cs2, 0) AS cs2
        FROM contig LEFT JOIN uniq USING (key, tax_id) FULL JOIN stat USING (key, tax_id)""",
    "shown": "SELECT DISTINCT key, anc AS tax_id FROM own JOIN up ON node = tax_id",
    "rep": """SELECT key, tax_id, coalesce(reads, 0) AS reads, coalesce(reads_kmers, 0) AS reads_kmers, coalesce(reads_bps, 0) AS reads_bps, coalesce(kmers, 0) AS kmers, coalesce(unique_kmers, 0) AS unique_kmers, coalesce(contigs, 0) AS contigs,
        coalesce(squared_sum, 0) AS squared_sum, coalesce(max_len, 0) AS max_len, coalesce(reads_1kmer, 0) AS reads_1kmer, coalesce(es, 0) AS es, coalesce(es2, 0) AS es2, coalesce(cs, 0) AS cs, coalesce(cs2, 0) AS cs2, coalesce(n, 0) AS db_kmers
        FROM shown LEFT JOIN own USING (key, tax_id) LEFT JOIN dbn USING (tax_id)""",
    "acc": """SELECT key, anc AS tax_id, sum(kmers) AS acc_kmers, sum(reads) AS acc_reads, sum(unique_kmers) AS acc_unique_kmers, sum(contigs) AS acc_contigs, sum(reads_kmers) AS acc_reads_kmers,
        sum(CASE WHEN db_kmers > 0 THEN kmers / CAST(db_kmers AS DOUBLE) ELSE 0 END) AS acc_norm_kmers, sum(es) AS acc_es, sum(es2) AS acc_es2, sum(cs) AS acc_cs FROM rep JOIN up ON node = tax_id GROUP BY key, anc""",
}


def sql(body: str, **more: str) -> str:
    """body with the common table expressions that it names, in order, each with those it names."""
    parts = PARTS | more
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in parts:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                add(parts[name])

    add(body)
    given = ",\n".join(f"{n} AS (SELECT * FROM ({parts[n]}))" for n in parts if n in needed)
    return f"WITH {given}\n{body}" if given else body
