"""DuckDB SQL for the llm queries that SQL can express."""

WS = r"\x20\x09-\x0D"

OP9 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{WS}]+'))::BIGINT AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
b AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS ws,
         coalesce(sum(cap) OVER o, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER o, 0)::BIGINT AS weight_before
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * (ws - weight_before) <= weight * (total - cap_before) AS is_full FROM b),
g AS (
  SELECT *, total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)::BIGINT AS rest,
         ws - coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0)::BIGINT AS shared_by FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(shared_by AS DOUBLE) END AS target FROM g),
r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(budget - epochs * source_size - ahead, size)))::BIGINT AS taken
FROM e
"""

OP10 = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{WS}]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""

#: documents padded with zero bytes can't be hashed as binary in plain SQL; WARC facts can
OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html)
SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN octet_length(encode(p.html)) >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(p.html)) >= 1000 AND page_id <> keeper THEN keeper END AS refers_to, url AS target_uri
FROM p JOIN g ON p.html = g.html JOIN (SELECT page_id, url FROM pages) u USING (page_id)
"""



def url_filter_sql(damping: int = 85, scale: int = 10**9, change: int = 10**6) -> str:
    """The rules and the propagation until no score changes by more than `change`, in whole numbers."""

    def host(url: str) -> str:
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        return f"translate(regexp_extract(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END, '^[^/?#]*'), '{upper}', '{lower}')"

    def rule(h: str, p: str) -> str:
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"

    return f"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce({host("url")}, '') AS host,
         coalesce(regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(html, '') AS html FROM pages),
r AS (
  SELECT page_id, host, path,
         CASE WHEN {rule("example.net", "/en/")} THEN 'example.net/en/' WHEN {rule("example.com", "/de/")} THEN 'example.com/de/'
              WHEN {rule("org", "/fr/")} THEN 'org/fr/' WHEN {rule("net", "/")} THEN 'net/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS link FROM p),
m AS (
  SELECT src, CASE WHEN starts_with(link, '//') THEN {host("('x:' || link)")}
                   WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {host("link")}
                   WHEN NOT regexp_matches(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|#)') THEN src END AS dst FROM l),
links AS MATERIALIZED (SELECT src, dst, count(*)::BIGINT AS weight FROM m WHERE src <> '' AND dst <> '' GROUP BY ALL),
seen AS (
  SELECT host, (count(*) FILTER (ruled = 'allow') * {scale} // count(*))::BIGINT AS allowed,
         (count(*) FILTER (ruled = 'block') * {scale} // count(*))::BIGINT AS blocked FROM v WHERE host <> '' GROUP BY host),
hosts AS MATERIALIZED (
  SELECT host, coalesce(allowed, 0) AS allowed, coalesce(blocked, 0) AS blocked
  FROM seen FULL JOIN (SELECT src AS host FROM links UNION SELECT dst FROM links) USING (host)),
totals AS (SELECT src, sum(weight)::BIGINT AS total FROM links GROUP BY src),
e AS MATERIALIZED (
  SELECT l.src, l.dst, l.weight, o.total FROM links l JOIN totals o USING (src)
  UNION ALL SELECT host, host, 1, 1 FROM hosts WHERE host NOT IN (SELECT src FROM totals)),
walk AS (
  SELECT 0 AS i, host, allowed AS trust, blocked AS distrust, {scale}::BIGINT AS moved FROM hosts
  UNION ALL
  SELECT n.i, n.host, n.trust, n.distrust, max(greatest(abs(n.trust - n.t), abs(n.distrust - n.d))) OVER () AS moved FROM (
    SELECT w.i + 1 AS i, h.host, ((h.allowed * {100 - damping} + coalesce(a.given, 0) * {damping}) // 100)::BIGINT AS trust,
           ((h.blocked * {100 - damping} + coalesce(b.given, 0) * {damping}) // 100)::BIGINT AS distrust, w.trust AS t, w.distrust AS d
    FROM walk w JOIN hosts h ON w.host = h.host
    LEFT JOIN (SELECT e.dst, sum(x.trust::HUGEINT * e.weight // e.total)::BIGINT AS given FROM e JOIN walk x ON e.src = x.host GROUP BY e.dst) a ON a.dst = h.host
    LEFT JOIN (SELECT e.src, sum(x.distrust::HUGEINT * e.weight // e.total)::BIGINT AS given FROM e JOIN walk x ON e.dst = x.host GROUP BY e.src) b ON b.src = h.host
    WHERE w.moved > {change}) n),
s AS (SELECT host, trust, distrust FROM walk WHERE i = (SELECT max(i) FROM walk))
SELECT page_id, v.host, path, rule,
       coalesce(ruled, CASE WHEN distrust >= {scale // 2} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0)::DOUBLE / {scale} AS trust, coalesce(distrust, 0)::DOUBLE / {scale} AS distrust
FROM v LEFT JOIN s ON v.host = s.host
""".replace("\\\\s", "\\s")


#: SQL has no CRC-32: its table (fixed by the polynomial), and crc(key) of ASCII text
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tbl
  FROM (SELECT unnest(range(256)) AS i))"""


def crc32(key: str) -> str:
    byte = f"list_transform(range(1, length({key}) + 1), lambda i: ascii(substr({key}, i, 1))::BIGINT)"
    return f"xor(4294967295, list_reduce([4294967295] || {byte}, lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])))"


def kneser_ney_sql() -> str:
    """Interpolated modified Kneser-Ney of pairs of tokens."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ratio = "(n1 / (n1 + 2 * n2))"
    each = {1: f"1 - 2 * {ratio} * n2 / n1", 2: f"2 - 3 * {ratio} * n3 / n2", 3: f"3 - 4 * {ratio} * n4 / n3"}
    sound = "n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0 AND " + " AND ".join(f"{d} BETWEEN 0 AND {i}" for i, d in each.items())

    def sizes(of: str) -> str:
        have = ", ".join(f"(count(*) FILTER (c = {i}))::DOUBLE AS n{i}" for i in (1, 2, 3, 4))
        some = ", ".join(f"CASE WHEN {sound} THEN {d} ELSE {fixed} END AS d{i}" for (i, d), fixed in zip(each.items(), (0.5, 1.0, 1.5)))
        return f"SELECT *, {some} FROM (SELECT coalesce(sum(c), 0)::DOUBLE AS total, (count(*) FILTER (c > 2))::DOUBLE AS more, {have} FROM {of})"

    def less(count: str, d: str) -> str:
        return f"greatest({count} - CASE {count} WHEN 0 THEN 0 WHEN 1 THEN {d}.d1 WHEN 2 THEN {d}.d2 ELSE {d}.d3 END, 0)"

    return f"""
WITH {CRC_TABLE},
k AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, row_number() OVER () AS r,
             regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^{WS}]+') || [' >'] AS ws FROM documents),
d AS MATERIALIZED (SELECT doc_id, r, ws, {crc32('key')} % 5 = 1 AS held_out FROM k, crc_table),
t AS MATERIALIZED (SELECT r, held_out, unnest(ws) AS w, unnest([' <'] || ws[:-2]) AS v FROM d),
u AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
z AS (SELECT coalesce(sum(c), 0)::BIGINT AS tokens, count(*) AS words FROM u),
g AS MATERIALIZED (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY ALL),
b AS MATERIALIZED (SELECT w, count(*) AS c FROM g GROUP BY w),
x AS MATERIALIZED (SELECT v, sum(c)::DOUBLE AS total, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c > 2) AS more FROM g GROUP BY v),
s1 AS MATERIALIZED ({sizes('b')}), s2 AS MATERIALIZED ({sizes('g')}),
p AS (SELECT t.r, u.c, log10((coalesce(u.c, 0) + 0.5) / (z.tokens + 0.5 * (z.words + 1))) AS base,
             CASE WHEN s1.total > 0 THEN {less('coalesce(b.c, 0)', 's1')} / s1.total + (s1.d1 * s1.n1 + s1.d2 * s1.n2 + s1.d3 * s1.more) / s1.total / (z.words + 1) ELSE 1 / (z.words + 1) END AS one,
             x.total, {less('coalesce(g.c, 0)', 's2')} / x.total AS own, (s2.d1 * x.n1 + s2.d2 * x.n2 + s2.d3 * x.more) / x.total AS below
      FROM t LEFT JOIN u USING (w) LEFT JOIN b USING (w) LEFT JOIN g USING (v, w) LEFT JOIN x USING (v), s1, s2, z),
q AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, round(sum(base), 6) AS base_score,
             round(sum(log10(CASE WHEN total > 0 THEN own + below * one ELSE one END)), 6) AS score FROM p GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, tokens AS train_tokens, base_score, score FROM d JOIN q USING (r), z
"""


def repair_sql() -> str:
    """Damage, faults, and the cheapest repairs from each state of (s?(ua)+)?, from the last row to the first.

    A state's value is {cost, audit, lines}; those of START, SYSTEM, USER and ASSISTANT are v0 to v3.
    """
    after, step = (2, 2, 3, 2), {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    name = {2: "user", 3: "assistant"}
    nl = "chr(10)"

    def value(cost: str, audit: str, lines: str) -> str:
        return f"{{'c': {cost}, 'a': {audit}, 'l': {lines}}}"

    def row(q: int) -> str:
        v, t = f"h.v{q}", f"h.v{after[q]}"
        ways = [value(f"{v}.c + 4", f"'D' || {v}.a", f"{v}.l")]
        line = lambda role, to: f"{role} || ':' || r.text || {nl} || h.v{to}.l"
        sound = "r.fault IN ('ok', 'truncated')"
        ways.append(f"CASE WHEN {sound} THEN {value(f'{t}.c + 3 + r.extra', f"'R' || {t}.a", line(f"'{name[after[q]]}'", after[q]))} END")
        for initial, to in step[q].items():
            ways.append(f"CASE WHEN {sound} AND r.initial = '{initial}' THEN {value(f'h.v{to}.c + r.extra', f"'K' || h.v{to}.a", line('r.role', to))} END")
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1] AS v{q}"

    def inserted(of: str, q: int) -> str:
        t = f"{of}.v{after[q]}"
        more = value(f"{t}.c + 3", f"'I' || {t}.a", f"'{name[after[q]]}:' || {nl} || {t}.l")
        return f"list_sort([{of}.v{q}, {more}])[1] AS v{q}"

    all_of = lambda f: ", ".join(f(q) for q in range(4))
    end = [value("0::BIGINT", "''", "''"), value("6::BIGINT", "'II'", f"'user:' || {nl} || 'assistant:' || {nl}"), value("3::BIGINT", "'I'", f"'assistant:' || {nl}"), value("0::BIGINT", "''", "''")]
    last = f"right(rtrim(text, ' ' || chr(9) || {nl} || chr(11) || chr(12) || chr(13)), 1)"
    return f"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
x AS (SELECT conv_id, turn, role, text, {crc32('key')} % 20 AS x FROM k, crc_table),
d AS (SELECT conv_id, turn, CASE x WHEN 4 THEN 'user' ELSE role END AS role,
             CASE x WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE x WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM x WHERE x <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, {last} AS last FROM d),
f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i), '') || left(role, 1) AS two,
             CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last IN ('.', '!', '?') THEN 'ok' ELSE 'truncated' END AS fault FROM n),
r AS MATERIALIZED (SELECT *, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra FROM f),
o AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (i > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
h AS (
  SELECT conv_id, rows AS i, {", ".join(f"{v} AS v{q}" for q, v in enumerate(end))} FROM o
  UNION ALL
  SELECT conv_id, i, {all_of(lambda q: inserted("t", q))} FROM (
    SELECT conv_id, i, {all_of(lambda q: inserted("s", q))} FROM (
      SELECT h.conv_id, h.i - 1 AS i, {all_of(row)} FROM h JOIN r ON h.conv_id IS NOT DISTINCT FROM r.conv_id AND h.i = r.i) s) t),
b AS (SELECT conv_id, v0 FROM h WHERE i = 0)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0) AS cost, coalesce(v0.a, '') AS audit,
       sha256(coalesce(left(v0.l, length(v0.l) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN o ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd's algorithm in whole numbers, all distances, a pair of views a round."""
    steps = [f"""
w AS (SELECT vec_id, label, list_transform(embedding, lambda c: greatest(-{1 << 28}, least({1 << 28}, floor({scale} * c::DOUBLE)))::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {parts} = 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rank, first(len(v)) OVER (ORDER BY vec_id NULLS LAST, v) AS dims FROM w),
x AS MATERIALIZED (SELECT rank, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM n, unnest(range({parts})) t(p) WHERE len(v) = dims),
e0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY rank) - 1)::BIGINT AS e, x AS c FROM x QUALIFY e < {entries})"""]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT rank, x.p, any_value(x) AS x, min({{'d': {far}, 'e': e}}) AS best FROM x JOIN e{r} USING (p) GROUP BY rank, x.p)")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL),
m{r} AS (SELECT p, e, list(((s - (s % n + n) % n) / n)::BIGINT ORDER BY i) AS c FROM (SELECT p, e, i, s::HUGEINT AS s, n::HUGEINT AS n FROM s{r}) GROUP BY p, e),
e{r + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.c, o.c) AS c FROM e{r} o LEFT JOIN m{r} m ON o.p = m.p AND o.e = m.e)""")
    return "WITH" + ",\n".join(steps) + f""",
y AS (SELECT rank, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY rank),
g AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM e{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM y JOIN n USING (rank), g
"""


ORACLES = {
    "op2_warc": OP2, "op3_url_filter": url_filter_sql(), "op9_mixing": OP9, "op10_exact_dedup": OP10,
    "op11_kneser_ney": kneser_ney_sql(),
    "op12_conversation_repair": repair_sql(), "op13_vector_codes": vector_codes_sql(),
}
