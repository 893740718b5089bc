"""Text functions over documents, pages and papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import spread
from .registry import query


def ids(t) -> DataFrame:
    """Ids as people write them: pages' numbers in several forms."""
    p = F.col("page_id")
    number = F.concat(F.lpad((p % 9000 + 1000).cast("string"), 4, "0"), F.lit("."), F.lpad((p * 7 % 100000).cast("string"), 5, "0"))
    forms = (F.concat(F.lit("https://arxiv.org/abs/"), number, F.lit("v2")), F.concat(F.lit("arXiv:"), number), F.concat(number, F.lit("V1")), F.concat(F.lit("https://doi.org/10.1234/AbC."), p.cast("string")), F.concat(F.lit("see doi: 10.5555/x"), p.cast("string"), F.lit(").")), F.col("url"))
    return t.pages.select("page_id", F.element_at(F.array(*forms), (p % 6 + 1).cast("int")).alias("raw"))


IDS = """ids AS (SELECT page_id, [ 'https://arxiv.org/abs/' || n || 'v2', 'arXiv:' || n, n || 'V1', 'https://doi.org/10.1234/AbC.' || page_id, 'see doi: 10.5555/x' || page_id || ').', url][(page_id % 6 + 1)::INT] AS raw
FROM (SELECT *, lpad((page_id % 9000 + 1000)::VARCHAR, 4, '0') || '.' || lpad((page_id * 7 % 100000)::VARCHAR, 5, '0') AS n FROM pages))"""


def one(fname: str, sql: str, make, source=lambda t: t.documents, key: str = "doc_id", views: str = "") -> None:
    """Registers a query of key and value = make(row)."""

    def f(t) -> DataFrame:
        return source(t).select(key, make().alias("value"))

    f.__name__ = fname
    f.__doc__ = make.__doc__
    query(sql, views)(f)


C = F.col
TITLE = "regexp_extract(text, '^[^.\\n]*')"


def title(t: str = "text"):
    """A document's first sentence or line."""
    return F.regexp_extract(t, "^[^.\n]*", 0)


one("normalize_arxiv", f"WITH {IDS} SELECT page_id, replace(nullif(regexp_extract(regexp_replace(replace(lower(raw), '/', ''), 'v[0-9]+$', ''), '[0-9]{{4}}[._][0-9]{{4,6}}'), ''), '_', '.') AS value FROM ids", lambda: X.normalize_arxiv(C("raw")), ids, "page_id")
one("normalize_ids", f"""WITH {IDS} SELECT page_id, coalesce(nullif(regexp_extract(trim(raw), '^(?:[aA][rR][xX][iI][vV]:)?([0-9]{{4}}\\.[0-9]{{4,5}})(?:v[0-9]+)?$', 1), ''),
  lower(nullif(regexp_extract(trim(raw), '^(?:https?://(?:dx\\.)?doi\\.org/|doi:)?(10\\.[0-9]{{4,9}}/[^ ]+)$', 1), ''))) AS value FROM ids""", lambda: X.anchored_id(C("raw")), ids, "page_id")
one("extract_arxiv", f"""WITH {IDS} SELECT page_id, coalesce(nullif(regexp_extract(raw, 'arxiv\\.org/(?:abs|pdf|html)/([0-9]{{4}}\\.[0-9]{{4,6}})', 1), ''),
  nullif(regexp_extract(raw, '(?:^|[^0-9.])([0-9]{{4}}\\.[0-9]{{4,5}})(?:v[0-9]+)?$', 1), '')) AS value FROM ids""", lambda: X.extract_arxiv(C("raw")), ids, "page_id")
one("extract_doi", f"""WITH {IDS} SELECT page_id, regexp_replace(coalesce(nullif(regexp_extract(raw, 'doi\\.org/(10\\.[0-9]{{4,9}}/[^ \\n<>"]+)', 1), ''),
  nullif(regexp_extract(raw, '[dD][oO][iI]:? *(10\\.[0-9]{{4,9}}/[^ \\n<>"]+)', 1), ''), nullif(regexp_extract(raw, '(?:^|[ \\n])(10\\.[0-9]{{4,9}}/[^ \\n<>"]+)', 1), '')), '[.,;:)!?\\]}}]+$', '') AS value FROM ids""", lambda: X.extract_doi(C("raw")), ids, "page_id")
GATE = "CASE WHEN page_id % 7 = 0 THEN 'https://www.ResearchGate.net/publication/' || page_id || '_Some_Title/link/' || page_id || '?x=1' WHEN page_id % 7 = 1 THEN 'http://Host.org/' WHEN page_id % 7 = 2 THEN url || '/' ELSE raw END"


def addresses(t) -> DataFrame:
    p, n = F.col("page_id") % 7, F.col("page_id").cast("string")
    gate = F.concat(F.lit("https://www.ResearchGate.net/publication/"), n, F.lit("_Some_Title/link/"), n, F.lit("?x=1"))
    raw = F.when(p == 0, gate).when(p == 1, "http://Host.org/").when(p == 2, F.concat("url", F.lit("/"))).otherwise(F.col("raw"))
    return ids(t).join(t.pages.select("page_id", "url"), "page_id").select("page_id", raw.alias("raw"))


one("canonical_url", f"""WITH {IDS}, g AS (SELECT page_id, {GATE} AS raw FROM ids JOIN (SELECT page_id, url FROM pages) USING (page_id)),
m AS (SELECT *, regexp_extract(raw, '(?i)arxiv\\.org/(?:abs|pdf|html)/([0-9]{{4}}\\.[0-9]{{4,6}})', 1) AS a, regexp_extract(raw, '(?i)doi\\.org/(10\\.[^?#]+)', 1) AS d,
  regexp_extract(raw, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)', ['s', 'h', 'p']) AS u FROM g)
SELECT page_id, CASE WHEN a <> '' THEN 'arxiv.org/abs/' || a WHEN d <> '' THEN 'https://doi.org/' || lower(d) WHEN u.s = '' THEN ''
  WHEN contains(lower(u.h), 'researchgate.net') AND regexp_matches(u.p, '^/publication/[0-9]+_') THEN lower(u.s) || '://' || lower(u.h) || lower(regexp_extract(u.p, '^/publication/[0-9]+_[^/]+'))
  ELSE lower(u.s) || '://' || lower(u.h) || coalesce(nullif(rtrim(u.p, '/'), ''), '/') END AS value FROM m""", lambda: X.canonical_url(C("raw")), addresses, "page_id")
one("slugify", "SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE left(s, 60) END AS value FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents)", lambda: X.slug(C("text")))
FILES = f"files AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN source_file WHEN 1 THEN doc_id || '__' || replace({TITLE}, '/', ' ') || '.pdf' ELSE 'notes/' || source || '.txt' END AS path FROM docs)"


def files(t) -> DataFrame:
    d, n = F.col("doc_id"), F.col("doc_id").cast("string")
    path = F.when(d % 3 == 0, C("source_file")).when(d % 3 == 1, F.concat(n, F.lit("__"), F.replace(title(), F.lit("/"), F.lit(" ")), F.lit(".pdf"))).otherwise(F.concat(F.lit("notes/"), "source", F.lit(".txt")))
    return t.docs.select("doc_id", "text", path.alias("path"))


one("norm_source", f"WITH {FILES}, p AS (SELECT *, string_split(path, '/') AS s FROM files) SELECT doc_id, regexp_replace(CASE WHEN s[-1] IN ('source.pdf', 'pdf.txt', 'web.txt', 'content_list.json') AND len(s) > 1 THEN s[-2] ELSE s[-1] END, '\\.txt$', '') AS value FROM p", lambda: X.norm_source(C("path")), files, views="docs")
one("partition_of", f"WITH {FILES} SELECT doc_id, nullif(regexp_extract(path, '(?:^|/)sources/([^/]+)/', 1), '') AS value FROM files", lambda: X.found(C("path"), "(?:^|/)sources/([^/]+)/", 1), files, views="docs")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'arxiv' WHEN doc_id % 4 = 1 THEN 'doi' WHEN doc_id % 4 = 2 THEN 'url' ELSE 'title' END AS id_type,
  CASE WHEN doc_id % 4 = 0 THEN '2401.' || doc_id WHEN doc_id % 4 = 1 THEN '10.1/x' || doc_id WHEN doc_id % 4 = 2 THEN 'https://a.org/' || doc_id ELSE left(sha256({TITLE} || '/' || lang), 16) END AS id FROM documents""")
def canonical_id(t) -> DataFrame:
    d, n = C("doc_id"), C("doc_id").cast("string")
    x = X.canonical_id(F.when(d % 4 == 0, F.concat(F.lit("2401."), n)), F.when(d % 4 <= 1, F.concat(F.lit("10.1/X"), n)), F.when(d % 4 <= 2, F.concat(F.lit("https://a.org/"), n)), title(), C("lang"))
    return t.documents.select("doc_id", x["id"].alias("id"), x["id_type"].alias("id_type"))


@query("SELECT doc_id, left(sha256(text), 16) AS exact, left(sha256(left(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')), 2048)), 16) AS soft FROM documents")
def doc_hashes(t) -> DataFrame:
    return t.documents.select("doc_id", X.exact_hash(C("text")).alias("exact"), X.soft_hash(C("text")).alias("soft"))


one("truncate_utf8", "SELECT doc_id, decode(encode(text)[1:CASE WHEN octet_length(encode(text)) <= 100 THEN 100 WHEN hex(encode(text)[101:101])[1:1] NOT IN ('8', '9', 'A', 'B') THEN 100 ELSE 99 END]) AS value FROM documents", lambda: X.truncate_utf8(C("text"), 100))
one("cap_text", "SELECT doc_id, CASE WHEN length(text) > 4096 THEN left(text, 4090) || ' …' ELSE text END AS value FROM documents", lambda: X.cap_text(C("text")))
LONGEST = "coalesce(list_max(list_transform(string_split(text, '{}'), lambda x: length(trim(x, ' ')))), 0)"
quoted = lambda x: "'" + x.replace("'", "''") + "'"
SIGNS = " ".join(f"WHEN contains(lower(left(text, 1500)), {quoted(s)}) THEN {quoted(s)}" for s in X.FAIL_SIGNS)
FAIL = f"CASE {SIGNS} WHEN {LONGEST.format(chr(10))} < 70 THEN 'no_prose' END"
one("fail_signature", f"SELECT doc_id, {FAIL} AS value FROM documents", lambda: X.fail_signature(C("text")))
one("longest_paragraph", f"SELECT doc_id, {LONGEST.format(chr(10) * 2)}::BIGINT AS value FROM documents", lambda: X.longest_paragraph(C("text")).cast("long"))
one("quality_score", f"SELECT doc_id, (CASE WHEN {FAIL} IS NULL AND length(text) >= 400 THEN 10000 + length(text) ELSE length(text) END)::BIGINT AS value FROM documents", lambda: X.quality_score(C("text")).cast("long"))
GARBAGE = " ".join(f"WHEN regexp_matches(left(text, 2000), {quoted('(?im)' + p)}) THEN '{n}'" for p, n in X.GARBAGE)
STRIPPED = f"length(trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), {quoted(X.NOISE_LINE)})), chr(10))))"
one("garbage_reason", f"SELECT doc_id, CASE WHEN length(text) < 1000 THEN 'too_small' {GARBAGE} WHEN {STRIPPED} < 800 THEN 'low_signal_after_strip' END AS value FROM documents", lambda: X.garbage_reason(C("text")))
one("toc_detect", """WITH l AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[.]\\n', '.... 12' || chr(10), 'g'), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)
SELECT doc_id, len(ls) >= 5 AND (len(list_filter(ls, lambda x: regexp_matches(x, '\\.{3,}\\s*\\d+\\s*$'))) >= 0.4 * len(ls) OR len(list_filter(ls, lambda x: regexp_matches(trim(x), '^\\d+(\\.\\d+)*\\s+\\S.*\\s+\\d+\\s*$'))) >= 0.6 * len(ls)) AS value FROM l""", lambda: X.looks_like_toc(F.regexp_replace("text", "[.]\\n", ".... 12\n")))
CLEAN = f"""list_filter(list_transform(string_split_regex(t, {quoted(X.LINE_END)}), lambda x, i: CASE WHEN i = 1 AND regexp_matches(x, '^\\s*#') THEN x ELSE NAVLESS END), lambda x: x IS NOT NULL)"""
NAVLESS = f"""(CASE WHEN NOT (length(STRIPPED) > 0 AND (lower(STRIPPED) IN ({', '.join(map(quoted, X.NAV_PHRASES))}) OR regexp_matches(STRIPPED, {quoted(X.NAV_LINE)}) OR (length(STRIPPED) <= 40 AND regexp_matches(lower(STRIPPED), {quoted(X.NAV_INSIDE)})))) THEN PLAIN END)"""
EDGE = lambda x: f"regexp_replace({x}, {quoted(X.EDGES)}, '', 'g')"
PLAIN = f"regexp_replace(x, {quoted(X.WIKI_EDIT)}, '')"
CLEAN = CLEAN.replace("NAVLESS", NAVLESS).replace("STRIPPED", EDGE("PLAIN")).replace("PLAIN", PLAIN)
one("clean_nav", f"""SELECT doc_id, CASE WHEN t = '' THEN t ELSE {EDGE(f"regexp_replace(array_to_string({CLEAN}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")} || chr(10) END AS value
FROM (SELECT doc_id, '# Home' || chr(10) || '[Edit | source edit]Menu' || chr(10) || replace(text, '. ', '.' || chr(10) || ' Share this ' || chr(10) || chr(10) || '[edit]' || chr(10)) || chr(10) || 'https://a.org/x' AS t FROM documents)""",
    lambda: X.clean_nav(F.concat(F.lit("# Home\n[Edit | source edit]Menu\n"), F.replace("text", F.lit(". "), F.lit(".\n Share this \n\n[edit]\n")), F.lit("\nhttps://a.org/x"))))
one("tail_strip", f"""WITH m AS (SELECT doc_id, t, regexp_extract(t, {quoted(X.TAIL)}, 1) AS head FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Related  posts ' || repeat('more ', (doc_id % 90)::INT) ELSE '' END AS t FROM documents))
SELECT doc_id, CASE WHEN t <> '' AND regexp_matches(t, {quoted(X.TAIL)}) AND length(head) >= floor(0.8::DOUBLE * length(t)) THEN regexp_replace(head, '[\\s\\x0b]+$', '') || chr(10) ELSE t END AS value FROM m""",
    lambda: X.tail_strip(F.concat("text", F.when(C("doc_id") % 2 == 0, F.concat(F.lit("\nRelated  posts "), F.expr("repeat('more ', cast(doc_id % 90 as int))"))).otherwise(""))))
STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
STEM = "regexp_replace(regexp_replace(string_split(lower(path), '/')[-1], '\\.[a-z0-9]{1,5}$', ''), '^[0-9]+__', '')"
TOK = f"""toks AS (SELECT doc_id, text, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS tokens FROM (
  SELECT doc_id, text, CASE WHEN regexp_matches(p, '^https?[_-]') THEN [] ELSE list_filter(regexp_extract_all(p, '[a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains({STOP}, w)) END AS ws FROM (SELECT *, {STEM} AS p FROM files)))"""
one("filename_tokens", f"WITH {FILES}, {TOK} SELECT doc_id, array_to_string(tokens, ' ') AS value FROM toks", lambda: F.array_join(X.descriptive_tokens(C("path")), " "), files, views="docs")


@query(f"""WITH {FILES}, {TOK} SELECT doc_id, CASE WHEN len(tokens) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(tokens, lambda w: contains(lower(left(text, 5000)), w)))::DOUBLE / len(tokens), 6) END AS head,
  CASE WHEN len(tokens) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(tokens, lambda w: contains(lower(text), w)))::DOUBLE / len(tokens), 6) END AS whole FROM toks""", "docs")
def filename_overlap(t) -> DataFrame:
    rows = files(t).withColumn("tokens", X.descriptive_tokens(C("path")))
    return rows.select("doc_id", F.round(X.overlap_ratio(C("tokens"), F.substring("text", 1, 5000)), 6).alias("head"), F.round(X.overlap_ratio(C("tokens"), C("text")), 6).alias("whole"))


one("content_nouns", f"""WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{4,}}') AS ws FROM documents)),
f AS (SELECT doc_id, w, min(i) AS i, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS n FROM w WHERE w NOT IN ({', '.join(map(quoted, X.NOUN_STOP_WORDS))}) GROUP BY doc_id, w QUALIFY n <= 8)
SELECT doc_id, coalesce(v, '') AS value FROM documents LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS v FROM f GROUP BY doc_id) USING (doc_id)""", lambda: F.array_join(X.content_nouns(C("text")), " "))
LATEX = "replace(replace(text, 'th', '\\emph{x}'), 'on', '$y_1$')"
one("strip_latex", f"SELECT doc_id, regexp_replace(regexp_replace({LATEX}, '\\\\[a-zA-Z]+\\{{([^{{}}]*)\\}}', '\\1', 'g'), '\\$([^$]*)\\$', '\\1', 'g') AS value FROM documents", lambda: X.strip_latex(F.replace(F.replace("text", F.lit("th"), F.lit("\\emph{x}")), F.lit("on"), F.lit("$y_1$"))))
ANSWER = "'First [' || doc_id % 7 || '] and a[9] then [' || doc_id % 3 + 1 || ', ' || doc_id % 5 || '].[4][' || doc_id % 11 || '] y_[6] [8,' || chr(9) || '9]' || chr(10) || 'Sources:' || chr(10) || text"


def answers(t) -> DataFrame:
    d = lambda m, a=0: (C("doc_id") % m + a).cast("string")
    return t.documents.select("doc_id", F.concat(F.lit("First ["), d(7), F.lit("] and a[9] then ["), d(3, 1), F.lit(", "), d(5), F.lit("].[4]["), d(11), F.lit("] y_[6] [8,\t9]\nSources:\n"), "text").alias("answer"))


# a blank before each bracket that follows one: SQL's patterns can't look behind
CITED = f"""cited AS (SELECT doc_id, answer, list_filter(ns, lambda n, i: list_position(ns, n) = i) AS nums, ns FROM (SELECT doc_id, answer, list_transform(flatten(list_transform(
  regexp_extract_all(replace(answer, '][', '] ['), '(?:^|[^A-Za-z0-9_])\\[((?:[0-9]+\\s*,\\s*)*[0-9]+)\\]', 1), lambda g: string_split_regex(g, '\\s*,\\s*'))), lambda n: try_cast(n AS INT)) AS ns FROM (SELECT doc_id, {ANSWER} AS answer FROM documents)))"""
one("cited_indices", f"WITH {CITED} SELECT doc_id, array_to_string(nums, ',') AS value FROM cited", lambda: F.array_join(X.cited_indices(C("answer")).cast("array<string>"), ","), answers)


@query(f"""WITH {CITED}, e AS (SELECT doc_id, unnest(nums) AS marker FROM cited), r AS (SELECT query_id, rank, id FROM hits WHERE list_idx = 1)
SELECT doc_id, marker, id, id IS NOT NULL AS resolved FROM e LEFT JOIN r ON r.query_id = e.doc_id AND r.rank = e.marker""", "hits")
def citation_resolve(t) -> DataFrame:
    """Cited numbers against ranked rows; unresolved ones stay, with nulls."""
    cited = answers(t).select("doc_id", F.explode(X.cited_indices(C("answer"))).alias("marker"))
    rows = t.hits.filter("list_idx = 1").select(C("query_id").alias("doc_id"), C("rank").cast("int").alias("marker"), "id")
    return cited.join(rows, ["doc_id", "marker"], "left").select("doc_id", "marker", "id", C("id").isNotNull().alias("resolved"))


LEGACY = "'As [2] and [1, 3][2] say, y_[1]; see [src' || doc_id % 3 || '.pdf:' || doc_id % 4 || ', b.pdf:image] and [b.pdf:2] or [src' || doc_id % 3 || '.pdf:' || doc_id % 4 || '].' || chr(10) || 'Sources:' || chr(10) || '[4] ' || left(text, 20)"


def retrieved(t) -> DataFrame:
    """Ranked rows of a question with their file, page and modality."""
    file = F.concat(F.lit("src"), (C("id") % 3).cast("string"), F.lit(".pdf"))
    return t.hits.filter("list_idx = 1").select(C("query_id").alias("doc_id"), "rank", file.alias("source"), (C("id") % 4).cast("int").alias("page"), F.when(C("id") % 5 == 0, "image").otherwise("text").alias("modality"))


@query(f"""WITH a AS (SELECT doc_id, regexp_replace({LEGACY}, '(?s)^(.*)\\n(?:Sources|References):.*$', '\\1') AS body FROM documents),
s AS (SELECT query_id AS doc_id, rank, 'src' || id % 3 || '.pdf' AS source, (id % 4)::INT AS page, CASE WHEN id % 5 = 0 THEN 'image' ELSE 'text' END AS modality FROM hits WHERE list_idx = 1),
m AS (SELECT doc_id, source, arg_min(modality, rank) AS modality FROM s GROUP BY ALL),
n AS (SELECT doc_id, list_transform(flatten(list_transform(regexp_extract_all(replace(body, '][', '] ['), '(?:^|[^A-Za-z0-9_])\\[((?:[0-9]+\\s*,\\s*)*[0-9]+)\\]', 1), lambda g: string_split_regex(g, '\\s*,\\s*'))), lambda x: x::INT) AS ns FROM a),
p AS (SELECT doc_id, unnest(ns) AS rank, generate_subscripts(ns, 1) AS nth FROM n),
f AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(body, '\\[([^\\[\\]]+)\\]', 1), lambda b: regexp_extract_all(b, '[^\\s,\\[\\]]+:(?:image|[0-9]+)'))) AS ts FROM a),
g AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS nth FROM f),
c AS (SELECT doc_id, 1 AS pass, nth, source, page, modality FROM p JOIN s USING (doc_id, rank) UNION ALL
  SELECT g.doc_id, 2, nth, regexp_extract(t, '^(.*):', 1) AS source, coalesce(try_cast(regexp_extract(t, ':([0-9]+)$', 1) AS INT), 0), CASE WHEN ends_with(t, ':image') THEN 'image' ELSE coalesce(m.modality, 'text') END
  FROM g LEFT JOIN m ON m.doc_id = g.doc_id AND m.source = regexp_extract(t, '^(.*):', 1))
SELECT doc_id, source, page, modality, row_number() OVER (PARTITION BY doc_id ORDER BY min(pass * 1000 + nth)) AS pos FROM c GROUP BY doc_id, source, page, modality""", "hits")
def parse_citations(t) -> DataFrame:
    """Citations of an answer's body by number and, in the older form, by file and page; each file, page and modality once."""
    from ..operators.citations import structured_citations

    d = lambda m: (C("doc_id") % m).cast("string")
    ref = F.concat(F.lit("src"), d(3), F.lit(".pdf:"), d(4))
    text = F.concat(F.lit("As [2] and [1, 3][2] say, y_[1]; see ["), ref, F.lit(", b.pdf:image] and [b.pdf:2] or ["), ref, F.lit("].\nSources:\n[4] "), F.substring("text", 1, 20))
    return structured_citations(t.documents.select("doc_id", text.alias("answer")), retrieved(t), "doc_id", "answer")


one("strip_sources", f"SELECT doc_id, regexp_replace({ANSWER}, '(?s)^(.*)\\n(?:Sources|References):.*$', '\\1') AS value FROM documents", lambda: X.strip_sources(C("answer")), answers)


@query("SELECT query_id, string_agg('[' || rank || '] ' || id, chr(10) ORDER BY rank) AS block FROM hits WHERE list_idx = 2 AND rank <= 5 GROUP BY query_id", "hits")
def render_sources(t) -> DataFrame:
    line = F.concat(F.lit("["), C("rank").cast("string"), F.lit("] "), C("id").cast("string"))
    rows = t.hits.filter("list_idx = 2 and rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("block"))


NAMES = ["Jane Roe, Max Bauer", "We present the model", "Ann Lee", "JANE ROE", "Ada Byron and Carl Gauss", "Otto von Stein, Ada de la Cruz, Max Bauer", "Jane Roe1, Max Bauer2*"]
SEEN_LINES = [
    "José García, Anna Müller", "J. K. Rowling and Max Bauer", "Department of Physics, Jane Roe", "Jump to content now", "Prices of options: a new model", "Roe, J.: A Long Line Of A Book, Vol. 2",
    "12, 13 - 14/15", "Title of page - QuantSite", "a | B c", "Read all →", "→ Quant List", "Mergify", "mail Jane Roe at jane@roe.org", "Cookie Monster",
]


def names(t) -> DataFrame:
    return t.papers.select("corpusid", "year", F.element_at(F.array(*map(F.lit, NAMES)), (C("corpusid") % 7 + 1).cast("int")).alias("line"))


LINES = f"lines AS (SELECT corpusid, year, {NAMES!r}[(corpusid % 7 + 1)::INT] AS line FROM papers)"
SPLIT = "list_filter(list_transform(regexp_split_to_array(replace(regexp_replace(line, '[*0-9]+( |,|;|$)', '\\1', 'g'), ' and ', ','), '[,;]'), lambda x: trim(x)), lambda x: x <> '')"


def seen_lines(t) -> DataFrame:
    """Lines as parsers find them, every other one the begin of a document."""
    known = F.element_at(F.array(*map(F.lit, SEEN_LINES)), (C("doc_id") % len(SEEN_LINES) + 1).cast("int"))
    return t.documents.select("doc_id", F.when(C("doc_id") % 2 == 0, known).otherwise(F.split("text", r"[\n,.]")[0]).alias("line"))


#: word by word: a word of an affiliation anywhere, and so on
WORDS_OF = "' ' || regexp_replace(lower(line), '[^\\p{L}\\p{N}_]', ' ', 'g') || ' '"
AFFILIATED = " OR ".join(f"contains(w, ' {a.lower()} ')" for a in X.AFFILIATIONS)
NAVIGATED = " OR ".join(f"starts_with(w, ' {a} ')" for a in X.NAVIGATION)
one("author_line", f"""WITH l AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN {SEEN_LINES!r}[(doc_id % {len(SEEN_LINES)} + 1)::INT] ELSE regexp_split_to_array(text, '[\\n,.]')[1] END, '^\\s+|\\s+$', '', 'g') AS line FROM documents),
w AS (SELECT *, {WORDS_OF} AS w FROM l)
SELECT doc_id, length(line) BETWEEN 4 AND 400 AND contains(line, ' ') AND regexp_matches(line, '(?:^|[^\\p{{L}}\\p{{N}}_])[A-Z][a-zA-Z]') AND NOT ({AFFILIATED}) AND NOT ({NAVIGATED}) AND NOT contains(line, '|')
  AND NOT contains(line, '@') AND NOT regexp_full_match(line, '[0-9\\s,./-]+') AND NOT regexp_matches(line, ' [-—] [A-Z][a-zA-Z0-9][a-zA-Z0-9]+$') AND NOT regexp_matches(line, '[←-⇿➠-➿»]$') AND NOT regexp_matches(line, '^\\p{{S}}')
  AND NOT (length(line) >= 30 AND contains(line, ':') AND NOT contains(string_split(line, ':')[1], ',')) AS value FROM w""", lambda: X.author_line(C("line")), seen_lines)
one("split_authors", f"WITH {LINES} SELECT corpusid, array_to_string({SPLIT}, '|') AS value FROM lines", lambda: F.array_join(X.split_authors(C("line")), "|"), names, "corpusid", "papers")
one("lastname", f"""WITH {LINES}, w AS (SELECT corpusid, string_split(({SPLIT})[1], ' ') AS ws FROM lines)
SELECT corpusid, CASE WHEN lower(ws[-2]) IN ('van', 'von', 'de', 'der', 'den', 'la', 'di', 'da') THEN ws[-2] || ' ' || ws[-1] ELSE ws[-1] END AS value FROM w""", lambda: X.last_name(F.element_at(X.split_authors(C("line")), 1)), names, "corpusid", "papers")
one("short_cite", f"""WITH {LINES}, n AS (SELECT corpusid, year, list_transform({SPLIT}, lambda x: string_split(x, ' ')[-1]) AS ns FROM lines)
SELECT corpusid, CASE len(ns) WHEN 1 THEN ns[1] WHEN 2 THEN ns[1] || ' & ' || ns[2] ELSE ns[1] || ' et al.' END || ' ' || year AS value FROM n""", lambda: X.short_cite(F.transform(X.split_authors(C("line")), lambda a: F.element_at(F.split(a, " "), -1)), C("year")), names, "corpusid", "papers")


def dated(t) -> DataFrame:
    d = C("doc_id")
    n = lambda m, a: (d % m + a).cast("string")
    url = F.when(d % 4 == 0, F.concat(F.lit("https://arxiv.org/abs/"), F.lpad((d % 25).cast("string"), 2, "0"), F.lit("01.12345"))).otherwise("https://a.org")
    text = F.when(d % 4 == 1, F.concat(F.lit("In March "), n(30, 1990))).otherwise(F.concat(n(40, 1975), F.lit(" then "), n(50, 1985), F.lit(", "), n(40, 1975), F.lit(" and "), n(50, 1985), F.lit(" or 20245")))
    return t.documents.select("doc_id", url.alias("url"), text.alias("text"))


DATED = """dated AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 25 + 2000)::INT WHEN doc_id % 4 = 1 THEN (doc_id % 30 + 1990)::INT END AS sure, [(doc_id % 40 + 1975)::INT, (doc_id % 50 + 1985)::INT, (doc_id % 40 + 1975)::INT, (doc_id % 50 + 1985)::INT] AS ys FROM documents),
y AS (SELECT doc_id, unnest(ys) AS y, generate_subscripts(ys, 1) AS pos FROM dated),
best AS (SELECT doc_id, y FROM (SELECT doc_id, y, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS n FROM y WHERE y BETWEEN 1980 AND 2030 GROUP BY doc_id, y) WHERE n = 1)"""
one("extract_year", f"WITH {DATED} SELECT doc_id, coalesce(sure, y) AS value FROM dated LEFT JOIN best USING (doc_id)", lambda: X.extract_year(C("url"), C("text")), dated)
one("modal_year", f"WITH {DATED} SELECT doc_id, y AS value FROM dated LEFT JOIN best USING (doc_id) WHERE doc_id % 4 > 1", lambda: X.extract_year(F.lit(""), C("text")), lambda t: dated(t).filter("doc_id % 4 > 1"))
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '')"
SITES = ["github", " My Site ", "With the name of", "VERSION OF TEXT", "Cloudflare", "May News", "It ends here.", "one two three four five", "Papers With Code", ""]
TITLES = ["A page - mdpi", "Some page | The Site", "No tail here", "Tail - of the page and more", "x — Ideas/RePEc"]
URLS = ["https://en.wikipedia.org/wiki/X", "http://www.reddit.com/r/a", "https://math.stackexchange.com/q/1", "https://notreddit.com/", "https://news.ycombinator.com/item?id=1", "https://www.data-site2b.co.uk/x"]
picked = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.expr(by) % len(names) + 1).cast("int"))


def sites(t) -> DataFrame:
    url = F.when(C("page_id") % 2 == 0, picked(URLS, "page_id div 2")).otherwise(C("url"))
    return t.pages.select("page_id", F.when(C("page_id") % 3 == 0, picked(SITES, "page_id div 3")).alias("given"), F.when(C("page_id") % 5 < 3, picked(TITLES, "page_id")).alias("page_title"), F.when(C("page_id") % 7 < 2, picked(TITLES, "page_id div 7")).alias("title"), url.alias("url"))


SITED = f"""s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {SITES!r}[(page_id // 3 % {len(SITES)} + 1)::INT] END AS given, CASE WHEN page_id % 5 < 3 THEN {TITLES!r}[(page_id % {len(TITLES)} + 1)::INT] END AS page_title,
  CASE WHEN page_id % 7 < 2 THEN {TITLES!r}[(page_id // 7 % {len(TITLES)} + 1)::INT] END AS title, CASE WHEN page_id % 2 = 0 THEN {URLS!r}[(page_id // 2 % {len(URLS)} + 1)::INT] ELSE url END AS url FROM pages)"""
BRANDED = "coalesce(map {" + ", ".join(f"'{b.lower()}': '{b}'" for b in X.BRANDS) + "}[lower(v)], v)"
NEVER = ", ".join(map(quoted, (*X.MONTHS, *X.WEEKDAYS, *X.BLOCKERS)))
one("sitename", f"""WITH {SITED}, c AS (SELECT page_id, 1 AS n, trim(given) AS v FROM s UNION ALL SELECT page_id, 2, trim(regexp_extract(page_title, '\\s[-—|]\\s+([^-—|]{{2,40}})$', 1)) FROM s
  UNION ALL SELECT page_id, 3, trim(regexp_extract(title, '\\s[-—|]\\s+([^-—|]{{2,40}})$', 1)) FROM s),
w AS (SELECT *, regexp_extract_all(lower(v), '[a-z]+') AS ws FROM c WHERE v <> ''),
g AS (SELECT page_id, arg_min({BRANDED}, n) AS v FROM w WHERE NOT list_has_any(ws, [{NEVER}]) AND right(v, 1) NOT IN ('.', '!', '?') AND len(regexp_split_to_array(v, '\\s+')) <= 4
  AND NOT (upper(v) = v AND lower(v) <> v AND contains(v, ' ')) AND len(list_filter(ws, lambda x: x IN ({", ".join(map(quoted, X.FUNCTION_WORDS))}))) < 2 GROUP BY page_id),
h AS (SELECT page_id, regexp_extract_all(translate(regexp_replace({HOST}, '\\.[^.]*$', ''), '-.', '  '), '[a-z]+|[^a-z]+') AS ps FROM s),
d AS (SELECT page_id, nullif(array_to_string(list_transform(ps, lambda p: upper(p[1]) || p[2:]), ''), '') AS v FROM h)
SELECT page_id, coalesce(g.v, d.v) AS value FROM (SELECT page_id, {BRANDED} AS v FROM d) d LEFT JOIN g USING (page_id)""", lambda: X.site_name(C("given"), C("page_title"), C("title"), C("url")), sites, "page_id")
UNDER = lambda n: f"({HOST} = '{n}' OR ends_with({HOST}, '.{n}'))"
one("platform_match", f"""WITH {SITED} SELECT page_id, CASE {" ".join(f"WHEN {UNDER(n)} THEN '{a}|{b}'" for n, a, b in X.PLATFORMS)} END AS value FROM s""", lambda: F.concat(X.platform_match(C("url"))["attribution"], F.lit("|"), X.platform_match(C("url"))["brand"]), sites, "page_id")


@query("""WITH o AS (SELECT doc_id, doc_id % 4 AS old_rank, doc_id % 3 AS authors, doc_id % 5 AS new_rank FROM documents)
SELECT doc_id, CASE WHEN old_rank > new_rank AND authors > 0 THEN 'old' ELSE 'new' END AS kept FROM o""")
def merge_guard(t) -> DataFrame:
    """New metadata replaces old unless the old is surer and has authors."""
    d = C("doc_id")
    authors = F.array_repeat(F.lit("a"), (d % 3).cast("int"))
    return t.documents.select("doc_id", F.when((d % 4 > d % 5) & (F.size(authors) > 0), "old").otherwise("new").alias("kept"))


one("doc_prefix", f"""SELECT doc_id, CASE WHEN length(ti) > 60 THEN regexp_replace(left(ti, 60), ' [^ ]*$', '') || '…' ELSE ti END || CASE WHEN doc_id % 3 = 0 THEN ' (Roe 2020)' WHEN doc_id % 3 = 1 THEN ' (2019)' ELSE '' END AS value
FROM (SELECT doc_id, {TITLE} AS ti FROM documents)""", lambda: X.doc_prefix(title(), F.when(C("doc_id") % 3 == 0, "Roe 2020"), F.when(C("doc_id") % 3 == 1, 2019)))


@query("""SELECT query_id, CASE WHEN cost IS NULL THEN '—' WHEN cost = 0 THEN '$0' WHEN cost < 0.01 THEN printf('$%.4f', cost) ELSE printf('$%.2f', cost) END AS cost_badge,
  CASE WHEN ms < 1000 THEN printf('%d ms', ms::BIGINT) ELSE printf('%.1f s', ms / 1000.0) END AS ms_badge FROM (SELECT query_id, (query_id % 3000)::DOUBLE + 0.3 AS ms, CASE WHEN query_id % 5 > 0 THEN (query_id % 640)::DOUBLE / 100 + 0.001 END AS cost FROM qlog)""", "qlog")
def fmt_badges(t) -> DataFrame:
    """No number lies on a rounding boundary."""
    q = C("query_id")
    return t.qlog.select("query_id", X.badge_cost(F.when(q % 5 > 0, (q % 640) / 100 + 0.001)).alias("cost_badge"), X.badge_ms((q % 3000).cast("double") + 0.3).alias("ms_badge"))


one("cursor_token", "SELECT query_id, rtrim(replace(replace(base64(encode('[\"' || query_id || '\",\"' || outcome || '\"]')), '+', '-'), '/', '_'), '') AS value FROM qlog", lambda: X.cursor_token(C("query_id"), C("outcome")), lambda t: t.qlog, "query_id", "qlog")
one("clean_title", f"SELECT doc_id, left(trim(regexp_replace(regexp_replace(trim(t), '^[\"'']+|[\"'']+$', '', 'g'), '[.!?]+$', '')), 80) AS value FROM (SELECT doc_id, '\"' || {TITLE} || '!?\"' AS t FROM documents)", lambda: X.clean_title(F.concat(F.lit('"'), title(), F.lit('!?"'))))


LOG_LINES = [
    "[discover:q1] triggering 3", "→ parse_start: a.pdf", "Found 12 file(s) to process.", "3 parents, 40 children — embedding", "heartbeat", "[a.pdf]", "[progress] done=1 parse_pending=2", "[a pdf]", "Pipeline done: 4",
    "x parents, 4 children — embedding", "INFO Processing pages: 10%", "parse_start: a.pdf",
]


@query(f"""WITH s AS (SELECT k AS run_id, query_id AS pos, {LOG_LINES!r}[(query_id % {len(LOG_LINES)} + 1)::INT] AS line FROM qlog),
n AS (SELECT *, CASE WHEN regexp_matches(line, '^[0-9]+ parents, [0-9]+ children — embedding') THEN 'embedding' WHEN line LIKE 'Found %%' OR line = '[a.pdf]' THEN 'chunking'
  WHEN line LIKE '→ parse_start:%%' OR line LIKE '%%parse_pending=%%' OR line LIKE '%%Processing pages%%' THEN 'parsing' WHEN line LIKE '[discover:%%' OR line LIKE '%%Pipeline done:%%' THEN 'fetching' END AS stage FROM s)
SELECT run_id, coalesce(arg_max(stage, pos) FILTER (stage IS NOT NULL), 'unknown') AS stage FROM n GROUP BY run_id""".replace("%%", "%"), "qlog")
def log_stage(t) -> DataFrame:
    """The stage of a run's last line that names one."""
    rows = t.qlog.select(C("k").alias("run_id"), C("query_id").alias("pos"), X.line_stage(picked(LOG_LINES, "query_id")).alias("stage"))
    return rows.groupBy("run_id").agg(F.coalesce(F.max_by("stage", F.when(C("stage").isNotNull(), C("pos"))), F.lit("unknown")).alias("stage"))


one("derive_title", f"""SELECT page_id, coalesce(CASE WHEN page_id % 4 = 0 THEN 'Mine' END, translate(nullif(string_split(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '/')[-1], ''), '-_', '  '), {HOST}) AS value FROM pages""", lambda: X.derive_title(F.when(C("page_id") % 4 == 0, " Mine ").otherwise(""), C("url")), lambda t: t.pages, "page_id")


SECTIONED = "CASE WHEN doc_id % 5 = 0 THEN 'References' || chr(10) ELSE '' END || text || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'Works  Cited: ' || chr(10) || 'x' WHEN 1 THEN chr(10) || '## Appendix B' || chr(10) || text ELSE '' END"
REST = "greatest(floor(0.2::DOUBLE * length(t))::INT - 1, 0)"
RSTRIP = lambda x: f"regexp_replace({x}, '[\\s\\x0b]+$', '')"


@query(f"""WITH d AS (SELECT doc_id, {SECTIONED} AS t FROM documents), r AS (SELECT *, substr(t, {REST} + 1) AS rest FROM d)
SELECT doc_id, CASE WHEN regexp_matches(t, {quoted(X.HARD_SECTION)}) THEN {RSTRIP(f"regexp_extract(t, {quoted(X.HARD_SECTION)}, 1)")}
  WHEN regexp_matches(rest, {quoted(X.SOFT_SECTION)}) THEN {RSTRIP(f"left(t, {REST}) || regexp_extract(rest, {quoted(X.SOFT_SECTION)}, 1)")} ELSE t END AS value FROM r""")
def strip_tail(t) -> DataFrame:
    """Text before its references, acknowledgements, appendix or the like."""
    d = C("doc_id")
    behind = F.when(d % 3 == 0, F.lit("\nWorks  Cited: \nx")).when(d % 3 == 1, F.concat(F.lit("\n## Appendix B\n"), "text")).otherwise("")
    text = F.concat(F.when(d % 5 == 0, "References\n").otherwise(""), "text", behind)
    return t.documents.select("doc_id", text.alias("t")).select("doc_id", X.strip_sections(C("t")).alias("value"))


one("citation_numbers", f"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all({ANSWER}, '\\[([0-9]+(?:,\\s*[0-9]+)*)\\]', 1), lambda g: string_split_regex(g, ',\\s*'))), lambda n: try_cast(n AS INT)), lambda n: n > 0))), ','), '') AS value FROM documents", lambda: F.array_join(X.citation_numbers(C("answer")).cast("array<string>"), ","), answers)
one("title_url", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN regexp_extract('Page at ' || url || ' now', '(https?://\\S+)', 1) ELSE '' END AS value FROM pages", lambda: X.title_url(F.when(C("page_id") % 3 == 0, F.concat(F.lit(" "), "url")), F.when(C("page_id") % 3 == 1, "SourceType.UNKNOWN").otherwise("SourceType.PDF"), F.concat(F.lit("Page at "), "url", F.lit(" now"))), lambda t: t.pages, "page_id")


def documents_index(t):
    """The positional index of all documents, written once."""
    from ..operators.text_index import TextIndex

    def make():
        index = TextIndex(t.spark, "bigint")
        index.refresh(spread(t.documents.withColumn("updated", F.lit(1).cast("long"))), "doc_id", "text", "updated")
        return index

    return t.keep("documents-index", make)


PHRASED = "' ' || array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"


@query(f"""WITH q AS (SELECT item_id AS query_id, array_to_string(regexp_extract_all(text, '[^ ]+')[1:2], ' ') AS phrase FROM benchmark WHERE item_id % 20 = 0), p AS (SELECT query_id, phrase, {PHRASED.format('phrase')} AS w FROM q),
d AS (SELECT doc_id, {PHRASED.format('text')} AS w FROM documents) SELECT query_id, '"' || replace(phrase, '"', '""') || '"' AS quoted, doc_id FROM p JOIN d ON contains(d.w, p.w)""")
def phrase_search(t) -> DataFrame:
    """Documents that hold a phrase, the first two words of each asked item, as neighbouring words."""
    words = F.slice(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)), 1, 2)
    asked = t.benchmark.filter("item_id % 20 = 0").select(C("item_id").alias("query_id"), F.array_join(words, " ").alias("text"))
    hits = documents_index(t).phrases(asked).select("query_id", C("doc").alias("doc_id"))
    return hits.join(asked.select("query_id", X.phrase_quote(C("text")).alias("quoted")), "query_id").select("query_id", "quoted", "doc_id")


GENERAL = "g AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Jane Roe; Max Bauer ;' WHEN 1 THEN 'Roe, J.' || chr(10) || 'Bauer, M.' WHEN 2 THEN ' ' END AS author, CASE WHEN page_id % 3 > 0 THEN ' Title ' || page_id || ' ' END AS title FROM pages)"


@query(f"""WITH {GENERAL} SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Jane Roe|Max Bauer' WHEN 1 THEN 'Roe, J.|Bauer, M.' ELSE 'Cited, A.' END AS authors, coalesce(trim(title), 'Harvested') AS title, '10.1/' || page_id AS doi FROM g""")
def metadata_merge(t) -> DataFrame:
    """The general extractor's authors and title where it has any, else the harvested ones; the harvested DOI."""
    from ..functions.html import merged_metadata

    k = C("page_id") % 4
    author = F.when(k == 0, "Jane Roe; Max Bauer ;").when(k == 1, "Roe, J.\nBauer, M.").when(k == 2, " ")
    title_ = F.when(C("page_id") % 3 > 0, F.concat(F.lit(" Title "), C("page_id").cast("string"), F.lit(" ")))
    m = merged_metadata({"authors": F.array(F.lit("Cited, A.")), "title": F.lit("Harvested"), "doi": F.concat(F.lit("10.1/"), C("page_id").cast("string"))}, author, {"title": title_})
    return t.pages.select("page_id", F.array_join(m["authors"], "|").alias("authors"), m["title"].alias("title"), m["doi"].alias("doi"))


@query("""SELECT query_id, '| rank | id |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || rank || ' | ' || id || ' |', chr(10) ORDER BY rank) AS md, '|  |  |' || chr(10) || '|---|---|' || chr(10) || '| hits | ' || count(*) || ' |' AS facts
FROM hits WHERE list_idx = 0 GROUP BY query_id""", "hits")
def report_tables(t) -> DataFrame:
    """A query's hits as a table and its facts as one of keys and values."""
    cells = F.struct("rank", F.array(C("rank").cast("string"), C("id").cast("string")).alias("cells"))
    rows = t.hits.filter("list_idx = 0").groupBy("query_id").agg(F.array_sort(F.collect_list(cells)).alias("r"), F.count(F.lit(1)).alias("n"))
    return rows.select("query_id", X.markdown_table(["rank", "id"], F.transform("r", lambda r: r["cells"])).alias("md"), X.key_value_table(F.array(F.array(F.lit("hits"), C("n").cast("string")))).alias("facts"))
