"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.relational import first_by
from .registry import query

C = F.col


@query("SELECT *, (sum(n) OVER (PARTITION BY collection))::BIGINT AS total FROM (SELECT lang AS collection, source AS notebook, count(*) AS n FROM documents GROUP BY ALL)")
def notebook_counts(t) -> DataFrame:
    rows = t.documents.groupBy(C("lang").alias("collection"), C("source").alias("notebook")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy("collection")))


@query("SELECT source_file, count(*) AS chunks FROM docs JOIN lineitem ON l_partkey = doc_id GROUP BY source_file", "docs")
def chunk_tally(t) -> DataFrame:
    chunks = t.lineitem.groupBy(C("l_partkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunks"))
    return t.docs.join(chunks, "doc_id").select("source_file", "chunks")


@query("SELECT c.dst AS id, count(*) AS n, round(sum(1 / ln(2 + p.citationcount)), 6) AS damped FROM cites c JOIN papers p ON p.corpusid = c.src GROUP BY c.dst", "cites papers")
def damped_overlap(t) -> DataFrame:
    weight = t.papers.select(C("corpusid").alias("src"), (1 / F.log(2 + C("citationcount"))).alias("w"))
    return t.cites.join(weight, "src").groupBy(C("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 6).alias("damped"))


@query("SELECT dst AS id, count(DISTINCT src) AS reach FROM cites WHERE src % 20 = 0 GROUP BY dst", "cites")
def walk_reach(t) -> DataFrame:
    return t.cites.filter("src % 20 = 0").groupBy(C("dst").alias("id")).agg(F.countDistinct("src").alias("reach"))


@query("SELECT corpusid, coalesce(r.n, 0) AS refs, coalesce(c.n, 0) AS citers FROM papers LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM cites GROUP BY src) r ON r.src = corpusid LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM cites GROUP BY dst) c ON c.dst = corpusid", "cites papers")
def hop1_counts(t) -> DataFrame:
    refs = t.cites.groupBy(C("src").alias("corpusid")).agg(F.countDistinct("dst").alias("r"))
    citers = t.cites.groupBy(C("dst").alias("corpusid")).agg(F.countDistinct("src").alias("c"))
    return t.papers.select("corpusid").join(refs, "corpusid", "left").join(citers, "corpusid", "left").select("corpusid", F.coalesce("r", F.lit(0)).alias("refs"), F.coalesce("c", F.lit(0)).alias("citers"))


@query("SELECT outcome AS stage, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM qlog GROUP BY outcome UNION ALL SELECT 'total', round(quantile_cont(latency_ms, 0.5), 6), round(quantile_cont(latency_ms, 0.95), 6) FROM qlog", "qlog")
def latency_percentiles(t) -> DataFrame:
    """Exact, by linear interpolation. Values have few distinct numbers, which is what the aggregate's state grows with."""
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95)))
    stages = t.qlog.groupBy(C("outcome").alias("stage")).agg(p.alias("p")).unionByName(t.qlog.agg(p.alias("p")).withColumn("stage", F.lit("total")))
    return stages.select("stage", F.round(C("p")[0], 6).alias("p50"), F.round(C("p")[1], 6).alias("p95"))


@query("SELECT chat_id, round(avg(coalesce(CASE WHEN event_type <> 'view' THEN (event_type = 'click')::INT END, 0)), 6) AS rate FROM qlog GROUP BY chat_id", "qlog")
def activation_rate(t) -> DataFrame:
    """Rows without the flag count as inactive."""
    flag = F.when(C("event_type") != "view", C("event_type") == "click")
    return t.qlog.groupBy("chat_id").agg(F.round(F.avg(F.coalesce(flag, F.lit(False)).cast("int")), 6).alias("rate"))


@query("SELECT query_id, round(avg((r.id IS NOT NULL)::INT), 6) AS overlap FROM hits LEFT JOIN refs r USING (query_id, id) WHERE rank > 2 GROUP BY query_id", "hits refs")
def drop_overlap(t) -> DataFrame:
    """The share of dropped rows that were references."""
    rows = t.hits.filter("rank > 2").join(t.refs.withColumn("r", F.lit(1)), ["query_id", "id"], "left")
    return rows.groupBy("query_id").agg(F.round(F.avg(F.coalesce("r", F.lit(0))), 6).alias("overlap"))


@query("SELECT outcome, round(avg(CASE WHEN query_id % 7 > 0 AND query_id % 5 > 0 THEN latency_ms END), 6) AS mean FROM qlog GROUP BY outcome", "qlog")
def nan_mean(t) -> DataFrame:
    score = F.when(C("query_id") % 7 == 0, F.lit(float("nan"))).when(C("query_id") % 5 > 0, C("latency_ms"))
    return t.qlog.groupBy("outcome").agg(F.round(M.mean_without_nan(score), 6).alias("mean"))


@query("""WITH m AS (SELECT outcome, avg(latency_ms) AS v FROM qlog GROUP BY outcome), r AS (SELECT outcome, v > CASE outcome WHEN 'failed' THEN 10 WHEN 'answered' THEN 1000 ELSE 20 END AS ok FROM m)
SELECT outcome, ok, bool_and(ok) OVER () AS all_ok FROM r""", "qlog")
def threshold_pass(t) -> DataFrame:
    limit = F.when(C("outcome") == "failed", 10).when(C("outcome") == "answered", 1000).otherwise(20)
    rows = t.qlog.groupBy("outcome").agg(F.avg("latency_ms").alias("v")).select("outcome", (C("v") > limit).alias("ok"))
    return rows.withColumn("all_ok", F.bool_and("ok").over(Window.partitionBy()))  # one row an outcome


@query("SELECT chat_id, sum(k)::BIGINT AS tokens, round(sum(cost), 6) AS cost FROM qlog WHERE chat_id % 2 = 0 OR event_type = 'error' GROUP BY chat_id", "qlog")
def usage_totals(t) -> DataFrame:
    """A cost is null only if all its parts are."""
    return t.qlog.filter("chat_id % 2 = 0 or event_type = 'error'").groupBy("chat_id").agg(F.sum("k").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))


@query("""SELECT chat_id, event_type, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, first) AS r FROM (SELECT chat_id, event_type, count(*) AS n, min(query_id) AS first FROM qlog GROUP BY ALL)) WHERE r = 1""", "qlog")
def majority_vote(t) -> DataFrame:
    return M.majority(t.qlog, "chat_id", "event_type", "query_id")


@query("SELECT l_orderkey AS doc, count_if(l_returnflag = 'R') AS r, count_if(l_returnflag = 'A') AS a, count_if(l_returnflag = 'N') AS n, max(l_linenumber)::INT + 1 AS pages FROM lineitem GROUP BY 1")
def element_counts(t) -> DataFrame:
    n = lambda f: F.count_if(C("l_returnflag") == f)
    return t.lineitem.groupBy(C("l_orderkey").alias("doc")).agg(n("R").alias("r"), n("A").alias("a"), n("N").alias("n"), (F.max("l_linenumber") + 1).alias("pages"))


@query("SELECT sha256(text) AS hash, count(*) AS n, count(DISTINCT source) AS partitions, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_partition_dupes(t) -> DataFrame:
    """All groups, not the first fifty."""
    return t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("partitions"), F.min("doc_id").alias("first")).filter("partitions > 1")


@query("SELECT coalesce(max(query_id), 0) AS mark, coalesce(max(query_id) FILTER (chat_id < 0), 0) AS empty_mark FROM qlog", "qlog")
def max_watermark(t) -> DataFrame:
    return t.qlog.agg(F.coalesce(F.max("query_id"), F.lit(0)).alias("mark"), F.coalesce(F.max(F.when(C("chat_id") < 0, C("query_id"))), F.lit(0)).alias("empty_mark"))


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 20")
def host_top20(t) -> DataFrame:
    return t.pages.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(20)


@query("""WITH r AS (SELECT c_mktsegment AS map, c_custkey, o_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000) ON o_custkey = c_custkey)
SELECT map, total, inside, c_custkey AS missing FROM (SELECT map, count(*) AS total, count(o_custkey) AS inside FROM r GROUP BY map) LEFT JOIN (SELECT map, c_custkey FROM r WHERE o_custkey IS NULL) USING (map)""")
def coverage(t) -> DataFrame:
    """How much of each map is there, with a row for each id that is missing, however many."""
    known = t.orders.filter("o_totalprice > 200000").select("o_custkey").distinct()
    rows = t.customer.join(known, C("c_custkey") == C("o_custkey"), "left").select(C("c_mktsegment").alias("map"), "c_custkey", "o_custkey")
    totals = rows.groupBy("map").agg(F.count(F.lit(1)).alias("total"), F.count("o_custkey").alias("inside"))
    return totals.join(rows.filter("o_custkey is null").select("map", C("c_custkey").alias("missing")), "map", "left")


@query("SELECT k AS notebook, count_if(event_type = 'signup') AS fetched, count_if(event_type = 'purchase') AS done, count_if(event_type = 'purchase') >= count_if(event_type = 'signup') AS ready FROM qlog GROUP BY k", "qlog")
def stage_ready(t) -> DataFrame:
    f, d = F.count_if(C("event_type") == "signup"), F.count_if(C("event_type") == "purchase")
    return t.qlog.groupBy(C("k").alias("notebook")).agg(f.alias("fetched"), d.alias("done"), (d >= f).alias("ready"))


@query("SELECT k AS stage, count_if(event_type <> 'error') AS ok, count_if(event_type = 'error') AS failed FROM qlog GROUP BY k", "qlog")
def stage_tally(t) -> DataFrame:
    return t.qlog.groupBy(C("k").alias("stage")).agg(F.count_if(C("event_type") != "error").alias("ok"), F.count_if(C("event_type") == "error").alias("failed"))


@query("SELECT k AS slug, arg_max(event_type, query_id) AS status, max(query_id) AS pos FROM qlog GROUP BY k", "qlog")
def latest_status(t) -> DataFrame:
    return t.qlog.groupBy(C("k").alias("slug")).agg(F.max_by("event_type", "query_id").alias("status"), F.max("query_id").alias("pos"))


@query("SELECT chat_id AS suspect, count(*) AS deaths, string_agg(query_id, ',' ORDER BY query_id) AS logs FROM qlog WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2", "qlog")
def crasher_confirm(t) -> DataFrame:
    rows = t.qlog.filter("event_type = 'error'").groupBy(C("chat_id").alias("suspect")).agg(F.count(F.lit(1)).alias("deaths"), F.array_join(F.array_sort(F.collect_list("query_id")).cast("array<string>"), ",").alias("logs"))
    return rows.filter("deaths >= 2")


@query("SELECT chat_id, CASE WHEN count(*) > 3 THEN round(avg((event_type IN ('click', 'purchase'))::INT), 6) END AS ratio FROM qlog GROUP BY chat_id", "qlog")
def verdict_ratio(t) -> DataFrame:
    """The share of true verdicts; null for too few."""
    return t.qlog.groupBy("chat_id").agg(F.when(F.count(F.lit(1)) > 3, F.round(F.avg(C("event_type").isin("click", "purchase").cast("int")), 6)).alias("ratio"))


@query("SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
def rollup_segment(t) -> DataFrame:
    """Grouping sets, an extension."""
    rows = t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).rollup("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return rows.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "price")


# --- retrieval metrics ---

ATK = """
q AS (SELECT DISTINCT query_id FROM hits WHERE list_idx = 1),
n AS (SELECT query_id, count(*) AS n_ref FROM refs GROUP BY query_id),
x AS (SELECT h.query_id, h.id, h.rank, (r.id IS NOT NULL)::INT AS hit FROM hits h LEFT JOIN refs r USING (query_id, id) WHERE list_idx = 1 AND rank <= 3),
p AS (SELECT *, sum(hit) OVER w / count(*) OVER w AS p FROM x WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
f AS (SELECT query_id, count(DISTINCT CASE WHEN hit = 1 THEN id END) AS found, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(p * hit) AS ps, sum(hit) AS hits FROM p GROUP BY query_id),
m AS (SELECT q.query_id, CASE WHEN n_ref IS NOT NULL THEN coalesce(found::DOUBLE / n_ref, 0) END AS recall, CASE WHEN n_ref IS NOT NULL THEN coalesce(1.0::DOUBLE / first, 0) END AS mrr,
  CASE WHEN n_ref IS NOT NULL THEN first IS NOT NULL END AS hit, CASE WHEN n_ref IS NOT NULL THEN coalesce(ps / (hits + 1e-10), 0) END AS ap FROM q LEFT JOIN n USING (query_id) LEFT JOIN f USING (query_id))"""


def _at_k(t) -> DataFrame:
    return M.at_k(t.hits.filter("list_idx = 1").select("query_id", "rank", "id"), t.refs, 3)


def _metric(name: str, column: str) -> None:
    def f(t) -> DataFrame:
        return _at_k(t).select("query_id", (C(column) if column == "hit" else F.round(column, 6)).alias("value"))

    f.__name__ = name
    query(f"WITH {ATK} SELECT query_id, {'hit' if column == 'hit' else f'round({column}, 6)'} AS value FROM m", "hits refs")(f)


for _name, _column in (("recall_at_k", "recall"), ("mrr_at_k", "mrr"), ("hit_at_k", "hit"), ("average_precision", "ap")):
    _metric(_name, _column)


@query("""WITH h AS (SELECT query_id, rank, parent_id AS id FROM hits WHERE list_idx = 1 AND rank <= 4), r AS (SELECT DISTINCT h.query_id, parent_id AS id FROM hits h JOIN refs USING (query_id, id)),
n AS (SELECT query_id, count(*) AS n FROM r GROUP BY query_id)
SELECT n.query_id, round(count(DISTINCT CASE WHEN r.id IS NOT NULL THEN h.id END)::DOUBLE / any_value(n), 6) AS recall, round(coalesce(1.0::DOUBLE / min(CASE WHEN r.id IS NOT NULL THEN rank END), 0), 6) AS mrr
FROM n LEFT JOIN h ON h.query_id = n.query_id LEFT JOIN r ON r.query_id = h.query_id AND r.id = h.id GROUP BY n.query_id""", "hits refs")
def source_metrics(t) -> DataFrame:
    """The metrics over sources: the list is cut first, then its sources are merged."""
    refs = t.hits.join(t.refs, ["query_id", "id"], "left_semi").select("query_id", C("parent_id").alias("id")).distinct()
    ranked = t.hits.filter("list_idx = 1").select("query_id", "rank", C("parent_id").alias("id"))
    return M.at_k(ranked, refs, 4, refs).select("query_id", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {ATK} SELECT count(*) AS queries, count(recall) AS judged, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(hit::INT), 6) AS hit, round(avg(ap), 6) AS ap FROM m""", "hits refs")
def retrieval_report(t) -> DataFrame:
    avg = lambda c: F.round(F.avg(C(c).cast("double")), 6).alias(c)
    return _at_k(t).withColumn("hit", C("hit").cast("int")).agg(F.count(F.lit(1)).alias("queries"), F.count("recall").alias("judged"), avg("recall"), avg("mrr"), avg("hit"), avg("ap"))


@query("""WITH n AS (SELECT query_id, count(*) AS n FROM refs GROUP BY query_id), s AS (SELECT query_id, id, list_idx, rank FROM hits SEMI JOIN n USING (query_id)), j AS (SELECT s.*, r.id IS NOT NULL AS hit FROM s LEFT JOIN refs r USING (query_id, id))
SELECT n.query_id, round(count(DISTINCT CASE WHEN hit THEN id END)::DOUBLE / any_value(n), 6) AS retrieve, round(count(DISTINCT CASE WHEN hit AND rank <= 2 THEN id END)::DOUBLE / any_value(n), 6) AS rerank,
  round(count(DISTINCT CASE WHEN hit AND rank <= 1 THEN id END)::DOUBLE / any_value(n), 6) AS final FROM n LEFT JOIN j USING (query_id) GROUP BY n.query_id""", "hits refs")
def stage_recall(t) -> DataFrame:
    """Recall of the retrieved, reranked and final rows of each query that has references."""
    n = t.refs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    found = t.hits.join(t.refs, ["query_id", "id"], "left_semi").groupBy("query_id", "id").agg(F.min("rank").alias("rank"))  # an id counts once, at its best rank
    stages = {"retrieve": C("rank").isNotNull(), "rerank": C("rank") <= 2, "final": C("rank") <= 1}
    found = found.groupBy("query_id").agg(*(F.count_if(kept).alias(name) for name, kept in stages.items()))
    return n.join(found, "query_id", "left").select("query_id", *(F.round(F.coalesce(name, F.lit(0)) / C("n"), 6).alias(name) for name in stages))


@query("SELECT k, round(avg(latency_ms) FILTER (event_type <> 'error') - avg(latency_ms) FILTER (event_type = 'error'), 4) AS delta FROM qlog GROUP BY k", "qlog")
def noise_delta(t) -> DataFrame:
    mean = lambda c: F.avg(F.when(c, C("latency_ms")))
    return t.qlog.groupBy("k").agg(F.round(mean(C("event_type") != "error") - mean(C("event_type") == "error"), 4).alias("delta"))


@query(f"""WITH r(model, a, b, c, d) AS (VALUES {', '.join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for m, a, b, c, d in M.PRICES)}),
u AS (SELECT query_id, {[p[0] for p in M.PRICES] + ['unknown']!r}[(query_id % 8 + 1)::INT] AS model, k AS input, CASE WHEN query_id % 2 = 0 THEN k // 3 ELSE 0 END AS hit, CASE WHEN query_id % 2 = 0 THEN k - k // 3 ELSE 0 END AS miss FROM qlog)
SELECT query_id, round((CASE WHEN miss + hit > 0 THEN miss ELSE input END * a + CASE WHEN miss + hit > 0 THEN hit ELSE 0 END * b + 7 * c + 3 * d) / 1e6, 9) AS cost FROM u LEFT JOIN r USING (model)""", "qlog")
def llm_cost(t) -> DataFrame:
    q, hit = C("query_id"), F.expr("k div 3")
    model = F.element_at(F.array(*(F.lit(p[0]) for p in M.PRICES), F.lit("unknown")), (q % 8 + 1).cast("int"))
    split = q % 2 == 0
    usage = t.qlog.select("query_id", model.alias("model"), C("k").alias("input"), F.when(split, C("k") - hit).otherwise(0).alias("miss"), F.when(split, hit).otherwise(0).alias("hit"), F.lit(7).alias("output"), F.lit(3).alias("reasoning"))
    return M.usage_cost(usage).select("query_id", F.round("cost", 9).alias("cost"))


@query("SELECT query_id, CASE WHEN k < 70 AND latency_ms > k THEN 'retry' WHEN k < 70 THEN 'first' ELSE 'no retry' END AS choice FROM qlog", "qlog")
def crag_choice(t) -> DataFrame:
    """Retry below the score 0.7; the retry is kept only if it is strictly better."""
    score, again = C("k") / 100, C("latency_ms") / 100
    return t.qlog.select("query_id", F.when((score < 0.7) & (again > score), "retry").when(score < 0.7, "first").otherwise("no retry").alias("choice"))


@query("SELECT chat_id, event_type AS stage, min(ts) AS started, max(ts) AS ended, count(*) AS calls, round(sum(latency_ms), 4) AS ms FROM qlog GROUP BY ALL", "qlog")
def stage_timeline(t) -> DataFrame:
    return t.qlog.groupBy("chat_id", C("event_type").alias("stage")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("calls"), F.round(F.sum("latency_ms"), 4).alias("ms"))


# --- windows, sorting and paging ---


@query("SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, id) AS n FROM hits WHERE list_idx = 0) WHERE n <= 1", "hits")
def cap_per_group(t) -> DataFrame:
    w = Window.partitionBy("query_id", "parent_id").orderBy(F.desc("score"), "id")
    return t.hits.filter("list_idx = 0").withColumn("n", F.row_number().over(w)).filter("n <= 1").select("query_id", "id")


@query("SELECT query_id, string_agg(parent_id, ',' ORDER BY pos) AS parents FROM (SELECT query_id, parent_id, min(rank) AS pos FROM hits WHERE list_idx = 2 GROUP BY ALL) GROUP BY query_id", "hits")
def dedupe_ranked(t) -> DataFrame:
    lists = t.hits.filter("list_idx = 2").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "parent_id"))).alias("x"))
    return lists.select("query_id", F.array_join(F.array_distinct(F.transform("x", lambda r: r["parent_id"])).cast("array<string>"), ",").alias("parents"))


@query("SELECT conv_id, turn FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS cut FROM conversations) WHERE cut IS NULL OR turn < cut")
def truncate_last_user(t) -> DataFrame:
    """Without the last user turn and what follows it."""
    cut = F.max(F.when(C("role") == "user", C("turn"))).over(Window.partitionBy("conv_id"))
    return t.conversations.withColumn("cut", cut).filter("cut is null or turn < cut").select("conv_id", "turn")


@query("SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_assistant(t) -> DataFrame:
    return first_by(t.conversations.filter("role = 'assistant'"), ["conv_id"], C("turn").desc()).select("conv_id", "turn")


UUID = "md5(conv_id || ':' || turn)"


@query(f"""WITH m AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' AND turn % 7 <> 3 THEN md5(conv_id || ':' || (turn - 1)) || '.assistant' ELSE {UUID} END AS message_uuid FROM conversations)
SELECT u.conv_id, u.turn, a.turn AS answer_turn, length(u.text)::INT AS asked, length(a.text)::INT AS answered FROM m u JOIN m a ON a.conv_id = u.conv_id AND a.message_uuid = u.message_uuid || '.assistant' AND a.role = 'assistant' WHERE u.role = 'user'""")
def turn_pairs(t) -> DataFrame:
    """A user's message and its answer by the exact key; answers under another key pair with none."""
    made = lambda turn: F.md5(F.concat(C("conv_id").cast("string"), F.lit(":"), turn.cast("string")))
    key = F.when((C("role") == "assistant") & (C("turn") % 7 != 3), F.concat(made(C("turn") - 1), F.lit(".assistant"))).otherwise(made(C("turn")))
    m = t.conversations.select("conv_id", "turn", "role", F.length("text").alias("size"), key.alias("message_uuid"))
    user = m.filter("role = 'user'").select("conv_id", "turn", C("size").alias("asked"), F.concat("message_uuid", F.lit(".assistant")).alias("message_uuid"))
    reply = m.filter("role = 'assistant'").select("conv_id", C("turn").alias("answer_turn"), C("size").alias("answered"), "message_uuid")
    return user.join(reply, ["conv_id", "message_uuid"]).drop("message_uuid")


@query("SELECT query_id, row_number() OVER (ORDER BY coalesce(cost, 0) DESC, coalesce(outcome, ''), query_id) AS pos FROM qlog ORDER BY pos LIMIT 100", "qlog")
def sort_nulls(t) -> DataFrame:
    order = [F.coalesce("cost", F.lit(0.0)).desc(), F.coalesce("outcome", F.lit("")), C("query_id")]
    top = t.qlog.orderBy(*order).limit(100)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long")).select("query_id", "pos")  # a hundred rows


@query("SELECT corpusid, citationcount FROM papers ORDER BY citationcount DESC, corpusid LIMIT 25", "papers")
def top_cited(t) -> DataFrame:
    return t.papers.orderBy(F.desc("citationcount"), "corpusid").limit(25).select("corpusid", "citationcount")


@query("""WITH o AS (SELECT corpusid, nullif(citationcount, 0) AS n FROM papers), a AS (SELECT * FROM o ORDER BY n DESC NULLS LAST, corpusid LIMIT 40), l AS (SELECT * FROM a ORDER BY n, corpusid DESC LIMIT 1)
SELECT 1 AS page, corpusid FROM a UNION ALL SELECT 2, corpusid FROM (SELECT o.* FROM o, l WHERE o.n < l.n OR (o.n = l.n AND o.corpusid > l.corpusid) OR o.n IS NULL ORDER BY o.n DESC NULLS LAST, o.corpusid LIMIT 40)""", "papers")
def keyset_page(t) -> DataFrame:
    """Two pages; the second begins behind the first one's last row."""
    from ..operators.relational import keyset_page as page

    rows = t.papers.select("corpusid", F.nullif("citationcount", F.lit(0)).alias("n"))
    first = page(rows, "n", "corpusid", 40)
    last = first.orderBy(C("n").asc(), C("corpusid").desc()).first()
    second = page(rows, "n", "corpusid", 40, (last["n"], last["corpusid"]))
    return first.select(F.lit(1).alias("page"), "corpusid").unionByName(second.select(F.lit(2).alias("page"), "corpusid"))


@query("""SELECT query_id, CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d <= 7 THEN 'Previous 7 days' WHEN d <= 30 THEN 'Previous 30 days' ELSE 'Older' END AS bucket
FROM (SELECT query_id, date_diff('day', ts::DATE, DATE '2024-02-01') AS d FROM qlog)""", "qlog")
def date_buckets(t) -> DataFrame:
    d = F.datediff(F.lit("2024-02-01").cast("date"), C("ts").cast("date"))
    return t.qlog.select("query_id", F.when(d <= 0, "Today").when(d == 1, "Yesterday").when(d <= 7, "Previous 7 days").when(d <= 30, "Previous 30 days").otherwise("Older").alias("bucket"))
