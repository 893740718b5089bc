"""Sources, sinks and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import readers as R
from ..sources.document_tree import read_tree, write_tree
from .registry import query


@query("SELECT corpusid, title, year, citationcount FROM papers", "papers")
def scan_papers(t) -> DataFrame:
    """Papers as gzipped NDJSON shards, scanned with a stated schema."""
    path = shared_folder(t.spark, "papers")
    R.write_ndjson(t.papers, path)
    return R.read_ndjson(t.spark, path, R.PAPER).select("corpusid", "title", "year", "citationcount")


@query("SELECT corpusid, citationcount FROM papers", "papers")
def shard_ingest(t) -> DataFrame:
    """Two calls of the restartable ingest; the second finds nothing new."""
    top = shared_folder(t.spark, "shards")
    R.write_ndjson(t.papers, f"{top}/in")
    for _ in range(2):
        R.ingest_shards(t.spark, f"{top}/in", R.PAPER, f"{top}/out", f"{top}/state")
    return t.spark.read.parquet(f"{top}/out").select("corpusid", "citationcount")


@query("SELECT corpusid, title, year FROM papers WHERE year >= 1990 AND citationcount > 0", "papers")
def ctas_papers(t) -> DataFrame:
    path = shared_folder(t.spark, "ctas")
    t.papers.filter("year >= 1990 and citationcount > 0").select("corpusid", "title", "year").write.parquet(path)
    return t.spark.read.parquet(path)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_sidecar(t) -> DataFrame:
    """Every third sidecar is encoded twice."""
    twice = F.to_json(F.struct(F.col("props").alias("x")))
    twice = F.regexp_extract(twice, r'^\{"x":(.*)\}$', 1)
    raw = F.when(F.col("event_id") % 3 == 0, twice).otherwise(F.col("props"))
    return t.events.select("event_id", R.parse_sidecar(raw, "k long")["k"].alias("k"))


@query("""
SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'question' WHEN item_id % 5 = 0 THEN 'ground_truth' ELSE '' END AS missing FROM benchmark""")
def golden_validate(t) -> DataFrame:
    rows = t.benchmark.select(
        "item_id", F.when(F.col("item_id") % 7 != 0, F.col("text")).alias("question"), F.when((F.col("item_id") % 5 != 0) | (F.col("item_id") % 7 == 0), F.col("text")).alias("ground_truth")
    )
    return R.validated(rows, ["question", "ground_truth"]).select("item_id", "missing")


@query("""
SELECT chat_id, query_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts DESC, query_id DESC) AS n FROM qlog) WHERE n = 1""", "qlog")
def latest_per_query(t) -> DataFrame:
    return R.last_by_key(t.qlog, ["chat_id"], F.col("ts"), F.col("query_id")).select("chat_id", "query_id", "outcome")


@query("SELECT query_id, latency_ms, outcome FROM qlog", "qlog")
def query_index(t) -> DataFrame:
    """Audit records in a tree of folders, with malformed lines between them."""
    top = shared_folder(t.spark, "audit")
    t.qlog.select("query_id", "latency_ms", "outcome").withColumn("day", F.col("query_id") % 5).write.partitionBy("day").json(top)
    t.spark.createDataFrame([("{not json",), ('{"query_id": ',)], "value string").coalesce(1).write.text(f"{top}/day=9")
    return R.read_audit_tree(t.spark, top, "query_id long, latency_ms double, outcome string")


@query("SELECT source, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents WHERE source <> 'web' GROUP BY source")
def doc_scan(t) -> DataFrame:
    """A tree of one document a file, without its administrative folders; sources are chosen while files are planned."""
    top = shared_folder(t.spark, "tree")
    folder = F.coalesce(F.concat(F.lit("source="), F.url_encode("source")), F.lit("unknown"))
    write_tree(t.documents.select(folder.alias("folder"), "text"), top)
    write_tree(t.documents.select(F.lit("_admin").alias("folder"), "text").limit(5), top)
    files = read_tree(t.spark, top, pattern="part-*", max_bytes=1 << 30)
    wanted = files.filter(F.col("path").startswith("source=") & ~F.col("path").startswith("source=web/"))
    rows = wanted.withColumn("source", F.url_decode(F.regexp_extract("path", "^source=([^/]*)/", 1)))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("SELECT v.vec_id, d.source FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id")
def parent_lookup(t) -> DataFrame:
    """Lookup of a list of ids; ids without a row are skipped."""
    return t.embeddings.select("vec_id").join(t.documents.select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Page ' || page_id END AS title, url FROM pages WHERE page_id % 4 <> 1""")
def parse_url_file(t) -> DataFrame:
    line = F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("  # "), "url")).when(F.col("page_id") % 3 == 0, F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit(" ||  "), "url")).otherwise(F.concat("url", F.lit(" ")))
    rows = t.pages.select("page_id", R.url_lines(line).alias("x")).filter("x is not null")
    return rows.select("page_id", "x.title", "x.url")


@query("SELECT 'urn:' || corpusid AS id, title, year || '-01-01' AS published, venue AS author FROM papers", "papers")
def atom_parse(t) -> DataFrame:
    """Papers as files of Atom entries, read entry by entry."""
    c = F.col
    entry = t.papers.select(
        F.concat(F.lit("urn:"), c("corpusid").cast("string")).alias("id"), "title", F.concat(c("year").cast("string"), F.lit("-01-01")).alias("published"), F.array(F.struct(c("venue").alias("name"))).alias("author")
    )
    top = shared_folder(t.spark, "atom")
    R.write_atom(entry, top)
    return R.read_atom(t.spark, top).select("id", "title", "published", F.element_at("authors", 1).alias("author"))


# --- predicates ---


@query("SELECT corpusid FROM papers WHERE list_has_any([field, venue], ['Brand#1', 'Brand#3']) OR contains(field, 'BRASS')", "papers")
def field_of_study_filter(t) -> DataFrame:
    studies = F.array(F.struct(F.col("field").alias("category")), F.struct(F.col("venue").alias("category")))
    wanted = F.exists(studies, lambda s: s["category"].isin("Brand#1", "Brand#3") | s["category"].contains("BRASS"))
    return t.papers.filter(wanted).select("corpusid")


def in_partitions(column, spec: str):
    """An empty specification means all; a comma-separated one means any of its names."""
    names = [s.strip() for s in spec.split(",") if s.strip()]
    return F.lit(True) if not names else F.col(column).isin(names)


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src4')")
def partition_filter(t) -> DataFrame:
    return t.documents.filter(in_partitions("source", "src1, src4") & in_partitions("lang", "")).select("doc_id", "source")


@query("""
SELECT corpusid FROM papers WHERE nullif(citationcount, 1) >= 0 AND (nullif(year, 1980) IS NULL OR nullif(year, 1980) BETWEEN 1975 AND 2000)""", "papers")
def node_filter(t) -> DataFrame:
    """A null count fails even 'at least 0'; a null year passes any bounds."""
    count, year = F.nullif("citationcount", F.lit(1)), F.nullif("year", F.lit(1980))
    return t.papers.filter((count >= 0) & (year.isNull() | year.between(1975, 2000))).select("corpusid")


@query("""
SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND coalesce(nullif(1970 + doc_id % 50, 1970), 0) BETWEEN 1980 AND 2010
  AND date_diff('day', DATE '2024-01-01' - CAST(doc_id % 400 AS INT), DATE '2024-01-01') <= 365 AND doc_id % 3 = 0""")
def paper_facets(t) -> DataFrame:
    year = F.coalesce(F.nullif(1970 + F.col("doc_id") % 50, F.lit(1970)), F.lit(0))
    ingested = F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int"))
    age, has_arxiv = F.datediff(F.lit("2024-01-01").cast("date"), ingested), F.when(F.col("doc_id") % 3 == 0, F.lit("x")).isNotNull()
    return t.documents.filter(F.col("lang").isin("en", "de") & year.between(1980, 2010) & (age <= 365) & has_arxiv).select("doc_id")


@query("SELECT query_id FROM qlog WHERE outcome IN ('answered', 'failed') AND coalesce(cost, 0) >= 0.1 AND coalesce(latency_ms, 0) >= 5", "qlog")
def query_facets(t) -> DataFrame:
    return t.qlog.filter(F.col("outcome").isin("answered", "failed") & (F.coalesce("cost", F.lit(0.0)) >= 0.1) & (F.coalesce("latency_ms", F.lit(0.0)) >= 5)).select("query_id")


@query("SELECT corpusid FROM papers WHERE contains(lower(title), 'red') OR contains(lower(venue), '#4')", "papers")
def simple_search(t) -> DataFrame:
    return t.papers.filter(F.lower("title").contains("red") | F.lower("venue").contains("#4")).select("corpusid")


@query("""
WITH c AS (SELECT conv_id, list_filter(list(DISTINCT CASE WHEN role <> 'system' AND conv_id % 3 > 0 THEN role END), lambda x: x IS NOT NULL) AS cs FROM conversations GROUP BY conv_id)
SELECT conv_id FROM c WHERE len(cs) = 0 OR list_has_any(cs, ['assistant'])""")
def chat_collection_filter(t) -> DataFrame:
    named = F.when((F.col("role") != "system") & (F.col("conv_id") % 3 > 0), F.col("role"))
    chats = t.conversations.groupBy("conv_id").agg(F.collect_set(named).alias("cs"))
    return chats.filter((F.size("cs") == 0) | F.arrays_overlap("cs", F.array(F.lit("assistant")))).select("conv_id")


@query("SELECT query_id, list_idx, id FROM hits WHERE score >= 50000", "hits")
def rerank_threshold(t) -> DataFrame:
    return t.hits.filter("score >= 50000").select("query_id", "list_idx", "id")


@query("""
SELECT query_id, id, rank FROM (SELECT *, max((score >= 60000)::INT) OVER (PARTITION BY query_id) AS any_ok FROM hits WHERE list_idx = 1)
WHERE score >= 60000 OR (any_ok = 0 AND rank <= 5)""", "hits")
def rerank_floor(t) -> DataFrame:
    ok = (F.col("score") >= 60000).cast("int")
    rows = t.hits.filter("list_idx = 1").withColumn("any_ok", F.max(ok).over(Window.partitionBy("query_id")))
    return rows.filter((ok == 1) | ((F.col("any_ok") == 0) & (F.col("rank") <= 5))).select("query_id", "id", "rank")


@query("SELECT query_id, outcome FROM qlog", "qlog")
def outcome_case(t) -> DataFrame:
    return t.qlog.select("query_id", "outcome")


def _host_sql(url: str = "url") -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '')"


# Hosts of publishers, whose pages count like DOI pages
PAPER_HOSTS = ("sciencedirect.com", "springer.com", "wiley.com", "tandfonline.com", "nature.com", "ieee.org", "acm.org", "jstor.org", "oup.com", "cambridge.org", "worldscientific.com")


def tier_of(kind, url):
    """The tier of a source by its kind (pasted, pdf or web) and URL; the order of the rules counts."""
    from ..functions.text import host

    u = F.lower(F.coalesce(url, F.lit("")))
    h, path = host(u), F.regexp_extract(u, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    publisher = F.lit(False)
    for name in PAPER_HOSTS:
        publisher = publisher | h.contains(name)
    return (
        F.when(kind == "pasted", "T6_nlm_native").when(h.contains("arxiv.org"), "T0_arxiv").when(h.contains("researchgate.net"), "T4_researchgate").when(h.contains("ssrn.com"), "T2_ssrn")
        .when(h.contains("doi.org"), "T1_doi").when(path.endswith(".pdf"), "T3_generic_pdf").when((kind == "pdf") & (u != ""), "T3_generic_pdf").when(kind == "pdf", "T7_nlm_uploaded_pdf")
        .when(publisher, "T1_doi").otherwise("T5_web_blog")
    )


TIER_URLS = ("https://arxiv.org/abs/2401.00001", "https://www.researchgate.net/p/1", "https://papers.ssrn.com/a=1", "https://doi.org/10.1/x", "https://a.org/b.PDF?x=1", "https://link.springer.com/c", "", "https://www.nature.com/d")


@query(f"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pasted' WHEN 1 THEN 'pdf' ELSE 'web' END AS kind, lower(CASE WHEN page_id % 9 < 8 THEN {list(TIER_URLS)!r}[(page_id % 9 + 1)::INT] ELSE url END) AS url FROM pages),
x AS (SELECT page_id, kind, url, {_host_sql()} AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, CASE WHEN kind = 'pasted' THEN 'T6_nlm_native' WHEN contains(h, 'arxiv.org') THEN 'T0_arxiv' WHEN contains(h, 'researchgate.net') THEN 'T4_researchgate' WHEN contains(h, 'ssrn.com') THEN 'T2_ssrn'
  WHEN contains(h, 'doi.org') THEN 'T1_doi' WHEN ends_with(path, '.pdf') OR (kind = 'pdf' AND url <> '') THEN 'T3_generic_pdf' WHEN kind = 'pdf' THEN 'T7_nlm_uploaded_pdf'
  WHEN {' OR '.join(f"contains(h, '{n}')" for n in PAPER_HOSTS)} THEN 'T1_doi' ELSE 'T5_web_blog' END AS tier FROM x""")
def url_tier(t) -> DataFrame:
    p = F.col("page_id")
    kind = F.when(p % 5 == 0, "pasted").when(p % 5 == 1, "pdf").otherwise("web")
    url = F.when(p % 9 < 8, F.element_at(F.array(*map(F.lit, TIER_URLS)), F.least(p % 9 + 1, F.lit(8)).cast("int"))).otherwise(F.col("url"))
    return t.pages.select("page_id", tier_of(kind, url).alias("tier"))


SEEDS = (("arxiv", r"^(arxiv:)?[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$"), ("doi", r"^10\.[0-9]{4,9}/"), ("url", r"^https?://"), ("corpus_id", r"^[0-9]+$"))


@query("""
WITH s AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '2403.' || lpad((page_id % 100000)::VARCHAR, 5, '0') WHEN 2 THEN '10.1234/x' || page_id
  WHEN 3 THEN page_id::VARCHAR ELSE 'title ' || page_id END AS seed FROM pages)
SELECT page_id, CASE WHEN regexp_matches(seed, '^(arxiv:)?[0-9]{4}\\.[0-9]{4,5}(v[0-9]+)?$') THEN 'arxiv' WHEN regexp_matches(seed, '^10\\.[0-9]{4,9}/') THEN 'doi'
  WHEN regexp_matches(seed, '^https?://') THEN 'url' WHEN regexp_matches(seed, '^[0-9]+$') THEN 'corpus_id' ELSE 'title' END AS kind FROM s""".replace("\\\\", "\\"))
def seed_kind(t) -> DataFrame:
    p, n = F.col("page_id"), F.col("page_id").cast("string")
    seed = F.when(p % 5 == 0, F.col("url")).when(p % 5 == 1, F.concat(F.lit("2403."), F.lpad((p % 100000).cast("string"), 5, "0"))).when(p % 5 == 2, F.concat(F.lit("10.1234/x"), n)).when(p % 5 == 3, n).otherwise(F.concat(F.lit("title "), n))
    kind = F.lit("title")
    for name, pattern in reversed(SEEDS):
        kind = F.when(F.regexp_like(seed, F.lit(pattern)), name).otherwise(kind)
    return t.pages.select("page_id", kind.alias("kind"))


# Roles of sections by normalised heading, the first match counts
ROLES = (
    ("references", r"^(references?|bibliograph(y|ies))$"), ("acknowledg", r"^(acknowledg(e?ments?))$"), ("toc", r"^(table\s*of\s*contents?|contents?|toc|outline|index)$"), ("abstract", r"^abstract$"),
    ("intro", r"^(introduction|intro)$"), ("related", r"^(related\s*work|prior\s*work|background|literature\s*review)$"),
    ("method", r"^(methods?|methodology|approach|materials?\s*and\s*methods?|implementation|system\s*design|architecture|model|experimental?\s*setup|setup)$"),
    ("results", r"^(results?|findings?|analysis|experiments?|evaluation|validation|performance|empirical|empirics?)$"), ("discussion", r"^discussion$"), ("limitations", r"^limitations?$"),
    ("future", r"^future\s*work$"), ("conclusion", r"^(conclusions?|concluding\s*remarks?|summary)$"),
)
NUMBERING = r"^(\d+(\.\d+)*)\s*[.\)]?\s+"


def section_role_of(heading):
    """The role of a heading in lower case without its number and closing punctuation; body if no pattern matches."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), NUMBERING, ""), r"[:.,;!?]+$", "")
    role = F.lit("body")
    for name, pattern in reversed(ROLES):
        role = F.when(F.regexp_like(plain, F.lit(pattern)), name).otherwise(role)
    return role


HEADINGS = ["1 Introduction", "2.1) Background:", "Materials and Methods", "Results and more", "References", "A Story", "Outline", "Table of Contents", "4. Conclusions.", " Abstract "]


@query(f"""
WITH h AS (SELECT doc_id, {HEADINGS!r}[(doc_id % 10 + 1)::INT] AS heading FROM documents),
n AS (SELECT *, regexp_replace(regexp_replace(lower(trim(heading)), '{NUMBERING}', ''), '[:.,;!?]+$', '') AS plain FROM h)
SELECT doc_id, heading, CASE {' '.join(f"WHEN regexp_matches(plain, '{p}') THEN '{r}'" for r, p in ROLES)} ELSE 'body' END AS role FROM n""")
def section_role(t) -> DataFrame:
    heading = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("doc_id") % 10 + 1).cast("int"))
    return t.documents.select("doc_id", heading.alias("heading"), section_role_of(heading).alias("role"))


@query("SELECT chat_id FROM qlog GROUP BY chat_id HAVING NOT bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'signup')", "qlog")
def failed_only(t) -> DataFrame:
    """Keys for which neither of two stages ever went well."""
    return t.qlog.groupBy("chat_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("web"), F.bool_or(F.col("event_type") == "signup").alias("pdf")).filter(~F.coalesce("web", F.lit(False)) & ~F.coalesce("pdf", F.lit(False))).select("chat_id")


@query("SELECT doc_id FROM documents WHERE (doc_id % 4 = 0 OR source IN ('src0', 'src1')) AND NOT (doc_id % 6 = 0)")
def weak_attribution(t) -> DataFrame:
    """Candidates for new metadata: no authors or an untrusted source, and not settled by hand."""
    authors = F.when(F.col("doc_id") % 4 != 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    weak = (F.size(authors) == 0) | F.col("source").isin("src0", "src1")
    return t.documents.filter(weak & (F.col("doc_id") % 6 != 0)).select("doc_id")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def blob_decode(t) -> DataFrame:
    """Texts as Zstandard blobs and back."""
    path = shared_folder(t.spark, "blobs")
    R.encode_blobs(t.documents, "doc_id", "text").write.parquet(path)
    return R.decode_blobs(t.spark.read.parquet(path), "doc_id", "blob").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT outcome, count(*) AS records, max(query_id) AS latest FROM (SELECT * FROM qlog UNION ALL SELECT * FROM qlog WHERE outcome = 'failed') GROUP BY outcome", "qlog")
def log_append(t) -> DataFrame:
    """Two writers append to one log; readers see all records."""
    path = shared_folder(t.spark, "log")
    rows = t.qlog.select("query_id", "outcome")
    R.append_log(rows, path)
    R.append_log(rows.filter("outcome = 'failed'"), path)
    return t.spark.read.schema("query_id long, outcome string").json(path).groupBy("outcome").agg(F.count(F.lit(1)).alias("records"), F.max("query_id").alias("latest"))


@query("""SELECT CASE event_type WHEN 'click' THEN '04_rerank' WHEN 'view' THEN '06_synthesis' WHEN 'signup' THEN '20_fused_dispatch' ELSE '99_' || event_type END AS folder, count(*) AS records, sum(query_id)::BIGINT AS ids FROM qlog GROUP BY ALL""", "qlog")
def stage_sink(t) -> DataFrame:
    """Records in numbered folders by stage; an unknown one has number 99."""
    path = shared_folder(t.spark, "stages")
    e = F.col("event_type")
    stage = F.when(e == "click", "rerank").when(e == "view", "synthesis").when(e == "signup", "fused_dispatch").otherwise(e)
    R.write_stages(t.qlog.select("query_id", stage.alias("stage")), path)
    rows = t.spark.read.schema("query_id long, stage string, _folder string").json(path)
    return rows.groupBy(F.col("_folder").alias("folder")).agg(F.count(F.lit(1)).alias("records"), F.sum("query_id").alias("ids"))


@query("SELECT vec_id, len(embedding)::INT AS size FROM embeddings")
def store_scan(t) -> DataFrame:
    """A scan of two stated columns."""
    return t.embeddings.select("vec_id", F.size("embedding").alias("size"))
