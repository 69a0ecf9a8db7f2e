"""DuckDB SQL of the operators that SQL can express, written from their definitions."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]"
#: Measure: expression, levels in thousandths (low, high), margin, and the least value where a cut between two classes limits it.
_MEASURES = {
    "word_length": ("word_chars * 1000000 // greatest(n_words, 1)", 10, 900, 2, -1),
    "symbols": ("greatest(n_symbols * 1000000 // (word_chars + 1000), 1000)", None, 750, 3, 1000),
    "dup_lines": ("n_dup_lines * 1000000 // greatest(n_lines, 1)", None, 995, 0, -1),
    "repeats": ("n_repeat_words * 1000000 // greatest(n_words, 1)", None, 995, 0, -1),
}


def _limits(measure: str, low: int | None, high: int, margin: int, least: int) -> str:
    """(lang, source, low, high) of a measure."""
    levels = []
    for name, keys in (("own", "lang, source, "), ("by_lang", "lang, "), ("whole", "")):
        part = f"PARTITION BY {keys[:-2]}" if keys else ""
        reached = lambda level, value: f"min({value}) FILTER (upto * 1000 >= total * {level})"
        quantiles = f"hi + {margin} * greatest(hi - mid, 0)"
        limit = quantiles if least < 0 else f"CASE WHEN hi_from > {least} AND {quantiles} >= coalesce(cut, 0) THEN {quantiles} ELSE cut END"
        levels.append(
            f"{name} AS (SELECT {keys}max(total) AS n, {reached(500, 'v')} AS mid, {reached(low or 0, 'v')} AS lo, {reached(high, 'top')} AS hi, {reached(high, 'v')} AS hi_from, "
            f"max(CAST(floor(sqrt(CAST(top AS DOUBLE) * next)) AS BIGINT)) FILTER (best = 1) AS cut FROM ("
            f"SELECT *, row_number() OVER ({part} ORDER BY upto * (total - upto) * (apart * apart) DESC NULLS LAST, v) AS best FROM ("
            f"SELECT *, CASE WHEN next IS NOT NULL THEN logs_upto / upto - (logs - logs_upto) / (total - upto) END AS apart FROM ("
            f"SELECT *, v + (1 << s) - 1 AS top, CAST(sum(n) OVER ({part} ORDER BY v) AS DOUBLE) AS upto, CAST(sum(n) OVER ({part}) AS DOUBLE) AS total, lead(v) OVER ({part} ORDER BY v) AS next, "
            f"CAST(sum(n * (32 * s + (v >> s))) OVER ({part} ORDER BY v) AS DOUBLE) AS logs_upto, CAST(sum(n * (32 * s + (v >> s))) OVER ({part}) AS DOUBLE) AS logs FROM ("
            f"SELECT {keys}({measure} >> s) << s AS v, s, count(*) AS n FROM (SELECT *, greatest(length(bin({measure})) - 6, 0) AS s FROM measured WHERE NOT base_failed) GROUP BY ALL)))) GROUP BY ALL), "
            f"{name}_f AS (SELECT {keys}CAST(n AS BIGINT) AS n, lo - {margin} * (mid - lo) AS low, {limit} AS high FROM {name})"
        )
    mixed = lambda n, x, y: f"coalesce(({n} * {x} + 200 * {y}) // ({n} + 200), {x}, {y})"
    shrunk = lambda c: f"CAST({mixed('o.n', f'o.{c}', mixed('l.n', f'l.{c}', f'w.{c}'))} AS BIGINT) AS {c}"
    return f"WITH {', '.join(levels)} SELECT o.lang, o.source, {shrunk('low')}, {shrunk('high')} FROM own_f o JOIN by_lang_f l ON o.lang IS NOT DISTINCT FROM l.lang, whole_f w"


def _quality_rules() -> str:
    limits = ", ".join(f"l_{m} AS ({_limits(m, *levels)})" for m, (_, *levels) in _MEASURES.items())
    joins = " ".join(f"LEFT JOIN l_{m} ON measured.lang IS NOT DISTINCT FROM l_{m}.lang AND measured.source IS NOT DISTINCT FROM l_{m}.source" for m in _MEASURES)
    inside = " AND ".join(f"coalesce({m} <= l_{m}.high, true)" + (f" AND {m} >= l_{m}.low" if low else "") for m, (_, low, *_) in _MEASURES.items())
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS words FROM documents),
lined AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM texts),
grams AS (SELECT rid, p, array_to_string(words[p:p + 4], ' ') AS gram FROM texts, unnest(range(1, greatest(len(words) - 3, 1))) t(p)),
twice AS (SELECT rid, p FROM grams QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
repeated AS (SELECT rid, count(DISTINCT p + i) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) o(i) GROUP BY rid),
counted AS (SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM lined LEFT JOIN repeated USING (rid)),
measured AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {", ".join(f"CAST({e} AS BIGINT) AS {m}" for m, (e, *_) in _MEASURES.items())} FROM counted),
{limits}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {inside}, false) AS kept, n_lines, {", ".join(_MEASURES)} FROM measured {joins}"""


_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def _url_filters() -> str:
    by_length = sorted(_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in by_length]
    case = lambda i, other: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + f" ELSE {other} END"
    k = lambda level: (
        f"(SELECT CASE WHEN coalesce(sum((n - 1) * v), 0) = 0 OR sum(n * d * d) - sum(v) <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, round(sum((n - 1) * v) / (sum(n * d * d) - sum(v)) - 1))) END "
        f"FROM (SELECT CAST(n AS DOUBLE) AS n, y / CAST(n AS DOUBLE) - py / CAST(pn AS DOUBLE) AS d, py / CAST(pn AS DOUBLE) * (1 - py / CAST(pn AS DOUBLE)) AS v FROM {level} WHERE n > 0))"
    )
    post = lambda level: f"SELECT *, (y + k * prior) / (n + k) AS rate, n + k AS m FROM {level}, (SELECT {k(level)} AS k)"
    return rf"""
WITH parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
good AS (SELECT doc_id, min(quality) AS label FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
seen AS (SELECT host, label FROM (SELECT host, TRY_CAST(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})', 1) AS BIGINT) AS doc_id FROM parts) JOIN good USING (doc_id)),
counted AS (SELECT host, coalesce(sum(label), 0) AS y, count(label) AS n FROM (SELECT host, label FROM seen UNION ALL SELECT DISTINCT host, NULL FROM parts) GROUP BY host),
cut AS (SELECT *, string_split(host, '.') AS p, regexp_matches(host, '^[0-9.:\[\]]*$') AS numeric FROM counted),
named AS (SELECT host, y, n, CASE WHEN numeric OR len(p) < 2 THEN host WHEN long AND len(p) < 3 THEN host WHEN long THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
  CASE WHEN numeric OR len(p) < 2 THEN host WHEN long THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix
  FROM (SELECT *, len(p) >= 2 AND array_to_string(p[-2:], '.') IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'org.uk') AS long FROM cut)),
domains AS (SELECT domain, min(suffix) AS suffix, sum(y) AS y, sum(n) AS n FROM named GROUP BY domain),
suffixes AS (SELECT suffix, sum(y) AS y, sum(n) AS n FROM domains GROUP BY suffix),
total AS (SELECT sum(y) AS py, sum(n) AS pn, CASE WHEN sum(n) > 0 THEN sum(y) / CAST(sum(n) AS DOUBLE) ELSE 0.9 END AS prior FROM suffixes),
s0 AS (SELECT suffix, y, n, py, pn, prior FROM suffixes, total), s1 AS ({post('s0')}),
d0 AS (SELECT domain, d.y, d.n, s1.y AS py, s1.n AS pn, s1.rate AS prior FROM domains d JOIN s1 USING (suffix)), d1 AS ({post('d0')}),
h0 AS (SELECT host, h.y, h.n, d1.y AS py, d1.n AS pn, d1.rate AS prior FROM named h JOIN d1 USING (domain)), h1 AS ({post('h0')}),
judged AS (SELECT host, rate, rate + 1.645 * sqrt(rate * (1 - rate) / (m + 1)) AS bound FROM h1)
SELECT page_id, host, path, {case(1, 'NULL')} AS rule, {case(2, "CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END")} AS verdict, round(rate, 9) AS host_rate, round(bound, 9) AS host_bound FROM parts JOIN judged USING (host)"""


def _merkle_manifest() -> str:
    field = lambda e: f"coalesce(strlen(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    levels = lambda tree, first: (
        f"{first} UNION ALL SELECT tree, level + 1, place // 8, sha256(string_agg(hash, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY tree, level) AS c FROM {tree}) WHERE c > 1 GROUP BY tree, level, place // 8"
    )
    above = lambda tree, leaves: (
        f"(SELECT l.rid, n.level, string_agg(n.hash, '' ORDER BY n.place) FILTER (n.place < l.place >> (3 * n.level)) AS lefts, string_agg(n.hash, '' ORDER BY n.place) FILTER (n.place > l.place >> (3 * n.level)) AS rights "
        f"FROM {leaves} l JOIN (SELECT *, count(*) OVER (PARTITION BY tree, level) AS c FROM {tree}) n ON n.tree = l.tree AND n.c > 1 AND n.place // 8 = l.place >> (3 * n.level + 3) GROUP BY l.rid, n.level)"
    )
    return rf"""
WITH RECURSIVE bits AS (SELECT list(list_reduce(list_prepend(i, list_transform(range(8), lambda x: CAST(0 AS BIGINT))), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS crc FROM documents, bits),
leaves AS (SELECT row_number() OVER () AS rid, doc_id, tree, leaf, CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS claimed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
nodes AS ({levels('nodes', "SELECT tree, 0 AS level, place, leaf AS hash FROM leaves")}),
subs AS (SELECT tree AS name, arg_max(hash, level) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes GROUP BY tree),
tops AS ({levels('tops', "SELECT '' AS tree, 0 AS level, place, subroot AS hash FROM subs")}),
whole AS (SELECT arg_max(hash, level) AS root FROM tops),
groups AS (SELECT name AS rid, '' AS tree, place FROM subs),
beside AS (SELECT rid, level, coalesce(lefts, '') AS lefts, coalesce(rights, '') AS rights FROM {above('nodes', 'leaves')}
  UNION ALL SELECT l.rid, 1000 + b.level, coalesce(b.lefts, ''), coalesce(b.rights, '') FROM leaves l JOIN {above('tops', 'groups')} b ON b.rid = l.tree),
steps AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level) AS step FROM beside),
fold AS (SELECT rid, CAST(0 AS BIGINT) AS step, claimed AS hash FROM leaves UNION ALL SELECT f.rid, s.step, sha256(s.lefts || f.hash || s.rights) FROM fold f JOIN steps s ON s.rid = f.rid AND s.step = f.step + 1),
ends AS (SELECT rid, arg_max(hash, step) AS folded_root FROM fold GROUP BY rid),
proofs AS (SELECT rid, string_agg(lefts || rights, '' ORDER BY step) AS proof FROM steps GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subs ON name = leaves.tree JOIN ends USING (rid) LEFT JOIN proofs USING (rid), whole"""


SQL: dict[str, str] = {"op11_merkle_manifest": _merkle_manifest(), "op2_quality_rules": _quality_rules(), "op8_url_filters": _url_filters()}
