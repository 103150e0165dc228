"""DuckDB SQL for the queries that SQL can express over whole tables: sets and links of op5, rules and link scores of op10,
counts and limits of op4, records of op6, divergences of op11, trees of op12."""

from __future__ import annotations

import string

from .quality import GROWTH, LEAST_ROWS, LOG_GROWTH, MEASURES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

NEAR_DUPLICATES = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
         s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
         n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
         c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
         e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
         both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
         r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT b, root FROM r JOIN both_ways ON node = a WHERE root < b),
         m AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON node = d.doc_id"""


def _host(url: str) -> str:
    return f"CASE WHEN {url} LIKE '%://%' THEN translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), {_LOWER}) ELSE '' END"


def url_verdicts(rules: list[tuple[str, str, str]]) -> str:
    """Rules, and PageRank by the length of walks: mass of the seeds that a host receives over links, as a part of the mass that
    it receives from seeds of 1 at every host; walks go on by the share of a host's URLs that no rule judges."""
    whens = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}" for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])))
    link = r"""(?i)\bhref\s*=\s*["'']?((?:https?:)?//[^\s"''<>]+)"""
    return rf"""
    WITH RECURSIVE p AS (SELECT page_id, html, {_host("url")} AS host, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
         q AS (SELECT page_id, html, coalesce(host, '') AS host, coalesce(path, '') AS path FROM p),
         j AS (SELECT *, CASE {whens} END AS r FROM q),
         h AS (SELECT host, avg(CASE WHEN r.verdict = 'block' THEN 1.0 ELSE 0.0 END) AS blocked, avg(CASE WHEN r.verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS trusted FROM j WHERE host <> '' GROUP BY 1),
         l0 AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM j),
         l1 AS (SELECT src, 'x:' || regexp_replace(link, '^https?:', '', 'i') AS link FROM l0),
         l AS (SELECT src, {_host("link")} AS dst FROM l1),
         e0 AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
         e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM e0),
         f0 AS (SELECT 'trust' AS kind, src AS "from", dst AS "to", share AS w FROM e UNION ALL SELECT 'distrust', dst, src, share / sum(share) OVER (PARTITION BY dst) FROM e),
         f AS (SELECT f0.*, coalesce(1 - blocked - trusted, 1.0) AS open FROM f0 LEFT JOIN h ON h.host = "from"),
         nodes AS (SELECT host FROM h UNION SELECT "to" FROM f),
         s AS (SELECT kind, nodes.host, coalesce(CASE kind WHEN 'distrust' THEN blocked ELSE trusted END, 0.0) AS seed FROM nodes LEFT JOIN h USING (host), (SELECT unnest(['trust', 'distrust']) AS kind)),
         m AS (SELECT kind, host, CAST(seed AS DOUBLE) AS mass, CAST(1 AS DOUBLE) AS one, 0 AS i FROM s
               UNION ALL SELECT f.kind, f."to", 0.85 * sum(f.w * m.mass * CASE WHEN m.i > 0 THEN f.open ELSE 1 END), 0.85 * sum(f.w * m.one * CASE WHEN m.i > 0 THEN f.open ELSE 1 END), any_value(m.i) + 1 FROM m JOIN f ON f.kind = m.kind AND f."from" = m.host WHERE m.i < 30 GROUP BY f.kind, f."to"),
         n AS (SELECT kind, host, 0.85 * sum(mass) / sum(one) AS part FROM m WHERE i > 0 GROUP BY 1, 2),
         v AS (SELECT host, greatest(blocked, coalesce(b.part, 0)) - greatest(trusted, coalesce(g.part, 0)) AS over FROM h LEFT JOIN (SELECT host, part FROM n WHERE kind = 'distrust') b USING (host) LEFT JOIN (SELECT host, part FROM n WHERE kind = 'trust') g USING (host))
    SELECT page_id, j.host, path, j.r.rule AS rule, coalesce(j.r.verdict, CASE WHEN v.over > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN v ON j.host = v.host"""


def _limits(depth: int) -> str:
    """Two tables: merged sketches of the first ``depth`` group columns with running counts, and their limits."""
    keys = ["lang", "source"][:depth]
    by = "".join(f"{k}, " for k in keys)
    of = lambda rank: f"min(value) FILTER (WHERE cum >= {rank})"
    columns = []
    for m, (_, lower, least, wide) in MEASURES.items():
        a, b, far = (f"max({c}) FILTER (WHERE measure = '{m}')" for c in ("a", "b", "far"))
        room = f"greatest(4.0 * ({b} - {a}), {least})"
        columns.append(f"{f'{a} - {room}' if lower else 'CAST(NULL AS DOUBLE)'} AS low_{m}")
        columns.append(f"{f'greatest({b} + {room}, {far})' if wide else f'{b} + {room}'} AS high_{m}")
    return f"""m{depth} AS (SELECT {by}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
         c{depth} AS (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {by}measure) AS every, CASE WHEN bucket = {-(1 << 30)} THEN 0.0 ELSE 2 * pow({GROWTH!r}, bucket) / (1 + {GROWTH!r}) END AS value FROM m{depth}),
         q{depth} AS (SELECT {by}measure, max(every) AS every, {of("floor((every - 1) * 0.25) + 1")} AS a, {of("floor((every - 1) * 0.75) + 1")} AS b, {of("greatest(1, least(floor((every - 1) * 0.99) + 1, every - 2))")} AS far FROM c{depth} GROUP BY ALL),
         l{depth} AS (SELECT {by}{", ".join(columns)} FROM q{depth} {"GROUP BY " + by[:-2] if keys else ""} HAVING max(every) >= {LEAST_ROWS if depth else 1})"""


_SKETCH = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, CAST({e} AS DOUBLE) AS x FROM base WHERE NOT base_failed" for m, (e, *_) in MEASURES.items())
_FAILS = " OR ".join(f"{e} > coalesce(l2.high_{m}, l1.high_{m}, l0.high_{m})" + (f" OR {e} < coalesce(l2.low_{m}, l1.low_{m}, l0.low_{m})" if lower else "") for m, (e, lower, *_) in MEASURES.items())

QUALITY = rf"""
    WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
         win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM t WHERE len(w) >= 8),
         txt AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM win),
         twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM txt) WHERE k > 1),
         again AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1),
         line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
         dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
         base0 AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
                   coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id)),
         base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base0),
         x AS ({_SKETCH}),
         sketch AS (SELECT lang, source, measure, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / {LOG_GROWTH!r}) AS BIGINT) ELSE {-(1 << 30)} END AS bucket, count(*) AS n FROM x GROUP BY ALL),
         {", ".join(_limits(d) for d in (2, 1, 0))}
    SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce({_FAILS}, false) AS kept
    FROM base b LEFT JOIN l2 ON b.lang IS NOT DISTINCT FROM l2.lang AND b.source IS NOT DISTINCT FROM l2.source LEFT JOIN l1 ON b.lang IS NOT DISTINCT FROM l1.lang LEFT JOIN l0 ON true"""

_BASE32 = "list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1))"

RECORDS = f"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string({_BASE32}, '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM m"""

DIVERGENCES = rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
         t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
         c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY ALL),
         k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
         v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
         g AS (SELECT DISTINCT lang, source FROM d),
         o AS (SELECT lang, source, sum(c.n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
         p AS (SELECT lang, g.source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(o.n, 0) + v.v)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v)::HUGEINT AS q
               FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN o USING (lang, source) LEFT JOIN c USING (lang, source, term)),
         pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
         pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
         r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 200"""


def _fields(n_chars: str) -> str:
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def manifest(tampered: str) -> str:
    """Trees level by level as a recursion over (lang, level, place), then every row's path up both trees. tampered: of
    which rows n_chars is one more."""
    up = "sha256(string_agg(h, '' ORDER BY i))"
    return f"""
    WITH RECURSIVE leaf AS (SELECT doc_id, lang, {_fields("n_chars")} AS h, CASE WHEN {tampered} THEN {_fields("n_chars + 1")} ELSE {_fields("n_chars")} END AS t FROM documents),
         x AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
         a AS (SELECT lang, 0 AS level, i, h, n FROM x UNION ALL SELECT lang, level + 1, i // 2, {up}, any_value((n + 1) // 2) FROM a WHERE n > 1 GROUP BY lang, level, i // 2),
         s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM a WHERE n = 1),
         b AS (SELECT 0 AS level, i, h, n FROM s UNION ALL SELECT level + 1, i // 2, {up}, any_value((n + 1) // 2) FROM b WHERE n > 1 GROUP BY level, i // 2),
         f AS (SELECT doc_id, lang, h, i, n, 0 AS level, t, '' AS proof FROM x
               UNION ALL SELECT doc_id, lang, f.h, i // 2, (n + 1) // 2, level + 1, sha256(CASE WHEN i % 2 = 1 THEN coalesce(o.h, '') || t ELSE t || coalesce(o.h, '') END), proof || coalesce(o.h, '')
               FROM f LEFT JOIN (SELECT lang AS lg, level AS lv, i AS at, h FROM a) o ON o.lg IS NOT DISTINCT FROM lang AND o.lv = level AND o.at = xor(i, 1) WHERE n > 1),
         e AS (SELECT doc_id, s.h AS subroot, f.h, s.i, s.n, 0 AS level, t, proof FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
               UNION ALL SELECT doc_id, subroot, e.h, i // 2, (n + 1) // 2, level + 1, sha256(CASE WHEN i % 2 = 1 THEN coalesce(o.h, '') || t ELSE t || coalesce(o.h, '') END), proof || coalesce(o.h, '')
               FROM e LEFT JOIN (SELECT level AS lv, i AS at, h FROM b) o ON o.lv = level AND o.at = xor(i, 1) WHERE n > 1)
    SELECT doc_id, e.h AS leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, t AS folded_root, t = b.h AS verified FROM e JOIN b ON b.n = 1 WHERE e.n = 1"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    bits = f"list_transform(range(0, 8 * length({text})), lambda k: CAST((ascii(substr({text}, CAST(k // 8 + 1 AS BIGINT), 1)) >> CAST(k % 8 AS INTEGER)) & 1 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, bit: CASE WHEN xor(c, bit) & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT)"


MANIFEST = manifest(f"{crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0")
