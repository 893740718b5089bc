"""Joins, set operations and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import hygiene
from ..operators import relational as R
from ..operators.retrieval import ranked
from ..operators.text_index import TextIndex, words
from ..session import shared_folder, spread
from . import text as T
from .registry import query

C = F.col


@query("SELECT DISTINCT c_mktsegment AS chat, l_partkey AS paper FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount >= 0.09")
def cited_papers(t) -> DataFrame:
    return t.lineitem.filter("l_discount >= 0.09").join(t.orders, C("l_orderkey") == C("o_orderkey")).join(t.customer, C("o_custkey") == C("c_custkey")).select(C("c_mktsegment").alias("chat"), C("l_partkey").alias("paper")).distinct()


@query("SELECT DISTINCT l_partkey AS paper, o_custkey AS query FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def paper_queries(t) -> DataFrame:
    return t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).select(C("l_partkey").alias("paper"), C("o_custkey").alias("query")).distinct()


@query("""SELECT d.doc_id, m.content FROM documents d LEFT JOIN (
  SELECT conv_id, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1) m ON m.conv_id = d.doc_id""")
def enrich_left(t) -> DataFrame:
    """Left enrichment by the last row of each key."""
    last = R.first_by(t.conversations, ["conv_id"], C("turn").desc()).select(C("conv_id").alias("doc_id"), C("text").alias("content"))
    return t.documents.select("doc_id").join(last, "doc_id", "left")


@query("""SELECT d.doc_id, d.source, l.quality, coalesce(c.n, 0) AS chunks FROM documents d LEFT JOIN labels l USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(ceil(n_chars / 1000.0))::BIGINT AS n FROM documents WHERE lang <> 'es' GROUP BY doc_id) c USING (doc_id)""")
def corpus_read_view(t) -> DataFrame:
    counts = t.documents.filter("lang <> 'es'").groupBy("doc_id").agg(F.sum(F.ceil(C("n_chars") / 1000.0)).cast("long").alias("n"))
    return t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left").join(counts, "doc_id", "left").select("doc_id", "source", "quality", F.coalesce("n", F.lit(0)).alias("chunks"))


SCOPE = "s AS (SELECT corpusid FROM papers WHERE year >= 1995)"


@query(f"WITH {SCOPE} SELECT src, dst FROM cites WHERE src IN (SELECT corpusid FROM s) AND dst IN (SELECT corpusid FROM s)", "papers cites")
def edges_in_scope(t) -> DataFrame:
    return R.in_scope(t.cites.select("src", "dst"), t.papers.filter("year >= 1995"), "corpusid").select("src", "dst")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def unembedded_children(t) -> DataFrame:
    return t.documents.select("doc_id").join(t.embeddings.select(C("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents d WHERE source = 'src0' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_sidecar(t) -> DataFrame:
    return t.documents.filter("source = 'src0'").select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("SELECT query_id, rank, id, p_name AS parent FROM hits JOIN part ON p_partkey = id WHERE list_idx = 0 AND p_size > 10", "hits")
def child_parent_join(t) -> DataFrame:
    """Children whose parent is missing are skipped; rank stays."""
    parents = t.part.filter("p_size > 10").select(C("p_partkey").alias("id"), C("p_name").alias("parent"))
    return t.hits.filter("list_idx = 0").join(parents, "id").select("query_id", "rank", "id", "parent")


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN doc_id IN (SELECT vec_id FROM embeddings) END AS in_corpus FROM documents")
def in_corpus_tristate(t) -> DataFrame:
    rows = t.documents.select("doc_id", F.when(C("doc_id") % 5 > 0, C("doc_id")).alias("id"))
    return R.membership(rows, "id", t.embeddings, "vec_id").select("doc_id", "in_corpus")


KEYS = "k AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '24.' || doc_id % 300 END AS arxiv, '10.1/' || doc_id % 500 AS doi FROM documents), s AS (SELECT doc_id AS sid, CASE WHEN doc_id % 2 = 0 THEN '24.' || doc_id END AS arxiv, '10.1/' || doc_id * 2 AS doi FROM documents)"


def _keys(t):
    n = lambda c: c.cast("string")
    rows = t.documents.select("doc_id", F.when(C("doc_id") % 3 > 0, F.concat(F.lit("24."), n(C("doc_id") % 300))).alias("arxiv"), F.concat(F.lit("10.1/"), n(C("doc_id") % 500)).alias("doi"))
    known = t.documents.select(C("doc_id").alias("sid"), F.when(C("doc_id") % 2 == 0, F.concat(F.lit("24."), n(C("doc_id")))).alias("s_arxiv"), F.concat(F.lit("10.1/"), n(C("doc_id") * 2)).alias("s_doi"))
    return rows, known


@query(f"WITH {KEYS} SELECT doc_id, EXISTS (SELECT 1 FROM s WHERE s.arxiv = k.arxiv) OR EXISTS (SELECT 1 FROM s WHERE s.doi = k.doi) AS in_corpus FROM k")
def in_corpus_or(t) -> DataFrame:
    rows, known = _keys(t)
    return R.lookup_by_either(rows, [("arxiv", "s_arxiv"), ("doi", "s_doi")], known, "sid", "sid").select("doc_id", C("sid").isNotNull().alias("in_corpus"))


@query(f"WITH {KEYS} SELECT doc_id, coalesce((SELECT min(sid) FROM s WHERE s.arxiv = k.arxiv), (SELECT min(sid) FROM s WHERE s.doi = k.doi)) AS sid FROM k")
def or_key_lookup(t) -> DataFrame:
    rows, known = _keys(t)
    return R.lookup_by_either(rows, [("arxiv", "s_arxiv"), ("doi", "s_doi")], known, "sid", "sid").select("doc_id", "sid")


@query(f"""WITH {KEYS} SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.arxiv = k.arxiv) THEN 'arxiv' WHEN EXISTS (SELECT 1 FROM s WHERE s.doi = k.doi) THEN 'doi' WHEN doc_id % 7 = 0 THEN 'title' ELSE 'unresolved' END AS how FROM k""")
def resolve_priority(t) -> DataFrame:
    rows, known = _keys(t)
    rows = R.lookup_by_either(rows, [("arxiv", "s_arxiv")], known, "sid", "a")
    rows = R.lookup_by_either(rows, [("doi", "s_doi")], known, "sid", "d")
    return rows.select("doc_id", F.when(C("a").isNotNull(), "arxiv").when(C("d").isNotNull(), "doi").when(C("doc_id") % 7 == 0, "title").otherwise("unresolved").alias("how"))


WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@query(f"""WITH m AS (SELECT conv_id AS chat_id, turn, text, {WORDS.format("text")} AS ws FROM conversations),
c AS (SELECT chat_id, left(arg_min(text, turn), 30) AS title, (arg_min(ws, turn))[1:2] AS phrase FROM m GROUP BY chat_id),
q AS (SELECT chat_id AS query_id, phrase, len(phrase) AS n FROM c WHERE chat_id % 20 = 0 AND len(phrase) > 0),
w AS (SELECT chat_id, turn, len(ws) AS dl, ws, unnest(range(1, len(ws) + 1)) AS i FROM m),
h AS (SELECT query_id, chat_id, turn, dl, count(*) AS hits FROM w JOIN q ON ws[i] = phrase[1] AND (n = 1 OR ws[i + 1] = phrase[2]) GROUP BY ALL),
d AS (SELECT query_id, count(*) AS df FROM h GROUP BY query_id), t AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avg_dl FROM m),
r AS (SELECT query_id, chat_id, turn, round(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 0.000001) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * dl / avg_dl)), 6) AS score FROM h JOIN d USING (query_id), t),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chat_id, turn) AS place FROM r WHERE chat_id % 4 <> 1 QUALIFY place <= 200),
g AS (SELECT query_id, chat_id, max(score) AS score, min(place) AS place FROM f GROUP BY ALL)
SELECT query_id, chat_id, title, score, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM g JOIN c USING (chat_id) QUALIFY rank <= 50""")
def chat_search(t) -> DataFrame:
    """Chats whose messages hold a phrase, by BM25: 200 messages of chats that aren't archived, each chat once, 50 at most.

    The phrases are the first two words of every chat whose id is divisible by 20.
    """
    key = lambda chat, turn: F.struct(C(chat).alias("chat_id"), C(turn).alias("turn"))
    messages = t.conversations.select(key("conv_id", "turn").alias("doc"), "text", F.lit(1).cast("long").alias("updated"))

    def make():
        index = TextIndex(t.spark, "struct<chat_id:bigint,turn:bigint>")
        index.refresh(messages, "doc", "text", "updated")
        return index

    chats = t.conversations.groupBy(C("conv_id").alias("chat_id")).agg(F.min_by("text", "turn").alias("first"))
    asked = chats.filter("chat_id % 20 = 0").select(C("chat_id").alias("query_id"), F.array_join(F.slice(words(C("first")), 1, 2), " ").alias("text"))
    live = messages.filter("doc.chat_id % 4 <> 1").select("doc")
    found = t.keep("messages-index", make).ranked_phrases(asked, limit=200, keep=live)
    once = found.groupBy("query_id", C("doc.chat_id").alias("chat_id")).agg(F.max("score").alias("score"), F.min("rank").alias("place"))
    best = ranked(once, ["query_id"], C("place"), limit=50)
    return best.join(chats, "chat_id").select("query_id", "chat_id", F.substring("first", 1, 30).alias("title"), "score", C("rank").cast("long").alias("rank"))


@query("""SELECT b.item_id, q.query_id, q.outcome FROM benchmark b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY query_id DESC) AS n FROM qlog) q ON q.k = b.item_id AND q.n = 1""", "qlog")
def golden_join(t) -> DataFrame:
    latest = R.first_by(t.qlog, ["k"], C("query_id").desc()).select(C("k").alias("item_id"), "query_id", "outcome")
    return t.benchmark.select("item_id").join(latest, "item_id", "left")


@query("""SELECT corpusid, b.mean_cites, v.n AS venue_n FROM papers LEFT JOIN (SELECT field, year // 10 AS decade, round(avg(citationcount), 6) AS mean_cites FROM papers GROUP BY ALL) b ON b.field = papers.field AND b.decade = year // 10
LEFT JOIN (SELECT venue, count(*) AS n FROM papers GROUP BY venue HAVING count(*) > 10) v ON v.venue = papers.venue""", "papers")
def quality_lookup(t) -> DataFrame:
    p = t.papers.withColumn("decade", F.expr("year div 10"))
    baseline = p.groupBy("field", "decade").agg(F.round(F.avg("citationcount"), 6).alias("mean_cites"))
    venues = p.groupBy("venue").agg(F.count(F.lit(1)).alias("venue_n")).filter("venue_n > 10")
    return p.join(baseline, ["field", "decade"], "left").join(venues, "venue", "left").select("corpusid", "mean_cites", "venue_n")


@query("""SELECT query_id, string_agg(parent_id, ',' ORDER BY pos) AS parents FROM (SELECT query_id, parent_id, min(rank) AS pos FROM hits WHERE list_idx = 1 AND id % 10 <> 0 GROUP BY query_id, parent_id) GROUP BY query_id""", "hits")
def resolve_children(t) -> DataFrame:
    """Ranked children as ranked distinct parents; children without one are dropped."""
    first = t.hits.filter("list_idx = 1 and id % 10 <> 0").groupBy("query_id", "parent_id").agg(F.min("rank").alias("pos"))
    rows = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "parent_id"))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda r: r["parent_id"].cast("string")), ",").alias("parents"))


@query("SELECT d.doc_id, s.summary FROM documents d LEFT JOIN (SELECT sha256(text) AS h, left(min(text), 12) AS summary FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) s ON s.h = sha256(d.text)")
def summary_lookup(t) -> DataFrame:
    cache = t.documents.filter("doc_id % 2 = 0").groupBy(F.sha2("text", 256).alias("h")).agg(F.substring(F.min("text"), 1, 12).alias("summary"))
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h")).join(cache, "h", "left").select("doc_id", "summary")


# --- set operations and merges ---


@query("SELECT src AS id FROM cites WHERE infl = 1 INTERSECT SELECT dst FROM cites WHERE infl = 0", "cites")
def set_intersect(t) -> DataFrame:
    return t.cites.filter("infl = 1").select(C("src").alias("id")).intersect(t.cites.filter("infl = 0").select("dst"))


@query("SELECT query_id, id FROM hits WHERE list_idx = 0 EXCEPT SELECT query_id, id FROM hits WHERE rank <= 2", "hits")
def mmr_dropped(t) -> DataFrame:
    return t.hits.filter("list_idx = 0").select("query_id", "id").exceptAll(t.hits.filter("rank <= 2").select("query_id", "id").distinct()).distinct()


@query("""WITH n AS (SELECT doc_id + 100 AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' END AS source, CASE WHEN doc_id % 3 = 0 THEN 'xx' END AS lang FROM documents)
SELECT doc_id, coalesce(n.source, d.source) AS source, coalesce(n.lang, d.lang) AS lang FROM (SELECT doc_id, source, lang FROM documents) d FULL JOIN n USING (doc_id)""")
def upsert_merge(t) -> DataFrame:
    old = t.documents.select("doc_id", "source", "lang")
    new = t.documents.select((C("doc_id") + 100).alias("doc_id"), F.when(C("doc_id") % 2 == 0, "new").alias("source"), F.when(C("doc_id") % 3 == 0, "xx").alias("lang"))
    return R.upsert(old, new, "doc_id")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id + 100 FROM documents WHERE doc_id % 2 = 0) UNION ALL SELECT doc_id + 100, 'new' FROM documents WHERE doc_id % 2 = 0""")
def upsert_replace(t) -> DataFrame:
    new = t.documents.filter("doc_id % 2 = 0").select((C("doc_id") + 100).alias("doc_id"), F.lit("new").alias("source"))
    return R.replace_by_key(t.documents.select("doc_id", "source"), new, "doc_id")


STATUS = {"signup": 1, "click": 2, "view": 3, "purchase": 4}
RANK = "CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END"


@query(f"SELECT chat_id, arg_max(event_type, query_id) AS latest, max({RANK})::INT AS furthest FROM qlog GROUP BY chat_id", "qlog")
def status_latest(t) -> DataFrame:
    """The last status of each id, and the furthest one for those who want it never to fall back."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for p in STATUS.items() for x in p))[C("event_type")], F.lit(0))
    return t.qlog.groupBy("chat_id").agg(F.max_by("event_type", "query_id").alias("latest"), F.max(rank).alias("furthest"))


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND sha256(e.text) = sha256(d.text) AND e.source = d.source)")
def already_ingested(t) -> DataFrame:
    done = t.documents.filter("doc_id % 2 = 0").select(F.sha2("text", 256).alias("h"), "source")
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h"), "source").join(done, ["h", "source"], "left_semi").select("doc_id")


#: an event can expect 0 to 3, so at most four of a chat are accepted, each the first behind its predecessor
CAS = ", ".join(
    ["q AS (SELECT chat_id, query_id, k % 4 AS expected FROM qlog)", "a0 AS (SELECT chat_id, min(query_id) AS at_ FROM q WHERE expected = 0 GROUP BY chat_id)"]
    + [f"a{i} AS (SELECT q.chat_id, min(query_id) AS at_ FROM q JOIN a{i - 1} p ON p.chat_id = q.chat_id AND q.query_id > p.at_ WHERE expected = {i} GROUP BY q.chat_id)" for i in (1, 2, 3)]
)


@query(f"WITH {CAS} SELECT chat_id, query_id, expected, query_id IN ({' UNION ALL '.join(f'SELECT at_ FROM a{i}' for i in range(4))}) AS accepted FROM q", "qlog")
def cas_replay(t) -> DataFrame:
    """Which events of a chat an optimistic lock accepts."""
    events = t.qlog.select("chat_id", "query_id", (C("k") % 4).cast("long").alias("expected"))
    return R.replay_versions(events, "chat_id", "expected", "query_id")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def cascade_delete(t) -> DataFrame:
    return R.cascade_delete(t.conversations, t.conversations.select("conv_id", "turn"), "conv_id", "conv_id", C("role") == "system")


@query("""SELECT word, count(*) AS postings FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE doc_id <= (SELECT max(doc_id) FROM labels)) GROUP BY word HAVING count(*) >= 20""")
def fts_rebuild(t) -> DataFrame:
    """The index over all that the watermark covers, rebuilt."""
    mark = t.labels.agg(F.max("doc_id").alias("mark"))
    docs = t.documents.join(F.broadcast(mark), C("doc_id") <= C("mark"))  # one row
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("postings")).filter("postings >= 20")


@query(f"""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'changed ' || text ELSE text END AS text FROM conversations WHERE turn % 5 <> 4)
SELECT word, count(*) AS messages, sum(n)::BIGINT AS occurrences FROM (SELECT conv_id, turn, w AS word, count(*) AS n FROM (SELECT conv_id, turn, unnest({WORDS.format("text")}) AS w FROM m) GROUP BY ALL) GROUP BY word""")
def fts_refresh(t) -> DataFrame:
    """The index after three refreshes: all messages but the last turns, then the last ones with changed texts of others, then deletions."""
    messages = t.conversations.select(F.struct(C("conv_id").alias("chat_id"), "turn").alias("doc"), "turn", "text")
    index = TextIndex(t.spark, "struct<chat_id:bigint,turn:bigint>")
    index.refresh(messages.filter("turn < 6").withColumn("updated", F.lit(1).cast("long")), "doc", "text", "updated")
    changed = messages.filter("turn >= 6 or turn % 3 = 1").select("doc", F.when(C("turn") % 3 == 1, F.concat(F.lit("changed "), "text")).otherwise(C("text")).alias("text"), F.lit(2).cast("long").alias("updated"))
    index.refresh(changed.union(messages.filter("turn = 0").select("doc", F.lit("not read, it is old"), F.lit(1).cast("long"))), "doc", "text", "updated")
    index.refresh(changed.limit(0), "doc", "text", "updated", deleted=messages.filter("turn % 5 = 4").select("doc"))
    return index._counted(index._table("postings")).groupBy(C("term").alias("word")).agg(F.count(F.lit(1)).alias("messages"), F.sum("tf").alias("occurrences"))


# --- corpus hygiene ---

STRANGE = "quarterly_revenue_forecast_summary"
MANIFEST = f"""
f AS (SELECT doc_id, text, source || '/' || doc_id || '__' || CASE WHEN doc_id % 4 = 3 THEN '{STRANGE}' ELSE array_to_string(regexp_extract_all(text, '[^ ]+')[1:5], '_') END || '.txt' AS path FROM documents),
n AS (SELECT *, regexp_replace(regexp_replace(string_split(lower(path), '/')[-1], '\\.[a-z0-9]{{1,5}}$', ''), '^[0-9]+__', '') AS stem, substr(text, {T.REST.replace("(t)", "(text)")} + 1) AS rest FROM f),
b AS (SELECT *, CASE WHEN regexp_matches(text, {T.quoted(X.HARD_SECTION)}) THEN {T.RSTRIP(f"regexp_extract(text, {T.quoted(X.HARD_SECTION)}, 1)")}
  WHEN regexp_matches(rest, {T.quoted(X.SOFT_SECTION)}) THEN {T.RSTRIP(f"left(text, {T.REST.replace('(t)', '(text)')}) || regexp_extract(rest, {T.quoted(X.SOFT_SECTION)}, 1)")} ELSE text END AS body,
  CASE WHEN regexp_matches(stem, '^https?[_-]') THEN [] ELSE list_distinct(list_filter(regexp_extract_all(stem, '[a-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN ({", ".join(map(T.quoted, X.STOP_WORDS))}))) END AS ws FROM n),
h AS (SELECT doc_id, sha256(text) AS hash, {T.FAIL} AS sign, CASE WHEN len(ws) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(ws, lambda w: contains(lower(body), w)))::DOUBLE / len(ws) END AS overlap,
  len(ws) >= 4 AND len(list_filter(ws, lambda w: contains(lower(text), w)))::DOUBLE / len(ws) < 0.4 AS mismatch, octet_length(encode(text)) < 1024 OR {T.LONGEST.format(chr(10) * 2)} < 70 AS small FROM b),
g AS (SELECT *, count(*) OVER (PARTITION BY hash) > 1 AS grouped, max(overlap) OVER (PARTITION BY hash) AS best FROM h),
p AS (SELECT *, CASE WHEN sign IS NOT NULL THEN 'fail_page:' || sign WHEN grouped AND best < 0.4 THEN 'no_canonical' WHEN mismatch AND (grouped OR small) THEN 'name_mismatch' END AS poison FROM g),
k AS (SELECT hash, arg_min(doc_id, (-overlap, doc_id)) AS keeper FROM p WHERE grouped AND poison IS NULL GROUP BY hash),
m AS (SELECT doc_id, coalesce(poison, CASE WHEN grouped AND doc_id <> keeper THEN 'duplicate' END) AS reason, CASE WHEN poison IS NULL AND grouped AND doc_id <> keeper THEN keeper END AS canonical FROM p LEFT JOIN k USING (hash))"""


def named_files(t) -> DataFrame:
    """Documents under names of their first words; every fourth one under a strange name."""
    name = F.when(C("doc_id") % 4 == 3, STRANGE).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)), 1, 5), "_"))
    return spread(t.documents).select("doc_id", "text", "source", F.concat("source", F.lit("/"), C("doc_id").cast("string"), F.lit("__"), name, F.lit(".txt")).alias("path"))


@query(f"WITH {MANIFEST} SELECT doc_id, reason, canonical FROM m WHERE reason IS NOT NULL")
def cleanup_manifest(t) -> DataFrame:
    """What to remove and why: failed pages, groups without a well-named copy, mismatches with another sign, copies of a canonical file."""
    return hygiene.manifest(named_files(t), "doc_id", "path", "text")


def _quarantined(t) -> hygiene.Quarantine:
    """A store of all documents with the manifest applied, twice over as after a restart."""
    store = hygiene.Quarantine(t.spark, shared_folder(t.spark, "store"), "doc_id")
    store.create(t.documents.select("doc_id", "source", "n_chars"))
    moves = hygiene.statuses(hygiene.manifest(named_files(t), "doc_id", "path", "text"))
    for _ in range(2):
        store.apply(moves, "first")
    return store


@query(f"WITH {MANIFEST} SELECT doc_id, source, CASE reason WHEN 'duplicate' THEN 'duplicate' ELSE 'poisoned' END AS status FROM m JOIN documents USING (doc_id) WHERE reason IS NOT NULL")
def quarantine_list(t) -> DataFrame:
    """What the store holds out of use after the manifest."""
    return _quarantined(t).rows().filter("status <> 'active'").select("doc_id", "source", "status")


@query("SELECT doc_id, source, n_chars, 'active' AS status FROM documents")
def quarantine_restore(t) -> DataFrame:
    """The store after the manifest was applied and undone: what it was."""
    store = _quarantined(t)
    store.restore("first")
    return store.rows().select("doc_id", "source", "n_chars", "status")


@query(f"WITH {MANIFEST} SELECT doc_id, round(overlap_, 6) AS ratio FROM (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda w: contains(lower(text), w)))::DOUBLE / len(ws) AS overlap_ FROM b WHERE len(ws) > 0) WHERE n >= 4 AND overlap_ < 0.4")
def name_mismatch(t) -> DataFrame:
    """Files whose content has few of their name's four words or more."""
    rows = named_files(t).withColumn("ws", X.descriptive_tokens(C("path")))
    return rows.filter(hygiene.mismatched(C("ws"), C("text"))).select("doc_id", F.round(X.overlap_ratio(C("ws"), C("text")), 6).alias("ratio"))


@query("""SELECT k, event_type, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (latency_ms < 20), CASE WHEN latency_ms >= 20 THEN query_id END, latency_ms DESC, query_id) AS n FROM qlog) WHERE n = 1""", "qlog")
def best_attempt(t) -> DataFrame:
    """The first attempt that passes, else the best one."""
    bad = C("latency_ms") < 20
    return R.first_by(t.qlog, ["k"], bad.asc(), F.when(~bad, C("query_id")).asc_nulls_last(), C("latency_ms").desc(), C("query_id").asc()).select("k", "event_type", "latency_ms")


@query("""WITH s AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS slug, regexp_replace(url, '[?#].*$', '') AS canon FROM pages),
f AS (SELECT *, first_value(canon) OVER (PARTITION BY slug ORDER BY page_id) AS first_canon, row_number() OVER (PARTITION BY slug, canon ORDER BY page_id) AS n FROM s)
SELECT page_id, CASE WHEN canon = first_canon THEN slug ELSE slug || '_' || left(sha256(canon), 6) END AS target, n > 1 AS skipped FROM f""")
def slug_collision(t) -> DataFrame:
    """The first address of a slug has it, others get a suffix, the same address again is skipped."""
    rows = t.pages.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("slug"), F.regexp_replace("url", "[?#].*$", "").alias("canon"))
    rows = rows.withColumn("first_canon", F.first("canon").over(Window.partitionBy("slug").orderBy("page_id"))).withColumn("n", F.row_number().over(Window.partitionBy("slug", "canon").orderBy("page_id")))
    target = F.when(C("canon") == C("first_canon"), C("slug")).otherwise(F.concat("slug", F.lit("_"), F.substring(F.sha2("canon", 256), 1, 6)))
    return rows.select("page_id", target.alias("target"), (C("n") > 1).alias("skipped"))


@query("SELECT DISTINCT corpusid FROM papers", "papers")
def key_scope(t) -> DataFrame:
    return t.papers.select("corpusid").distinct()


@query("SELECT doc_id AS id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id * 3 FROM embeddings) UNION ALL SELECT DISTINCT vec_id * 3, 'right' FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)")
def symmetric_difference(t) -> DataFrame:
    """What only one of two sets of ids has."""
    return R.symmetric_difference(t.documents.select(C("doc_id").alias("id")), t.embeddings.select((C("vec_id") * 3).alias("id")))


@query("SELECT l_partkey AS child, arg_max(l_suppkey, l_orderkey * 100 + l_linenumber) AS parent FROM lineitem GROUP BY l_partkey")
def last_wins_map(t) -> DataFrame:
    """Child to parent, the last record of a child wins."""
    rows = t.lineitem.select(C("l_partkey").alias("child"), C("l_suppkey").alias("parent"), (C("l_orderkey") * 100 + C("l_linenumber")).alias("at"))
    return R.last_wins(rows, "child", "parent", "at")


@query("SELECT source, count(*) AS papers FROM documents GROUP BY source")
def cached_view(t) -> DataFrame:
    """The read view, asked for twice: the second read is of the first one's table."""
    view = R.CachedView(lambda: t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("papers")), lambda: t.documents.agg(F.max("doc_id")).first()[0] or 0, ttl=600)
    view.get()
    return view.get()
