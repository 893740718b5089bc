"""Search, fusion and reranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import vector_index
from ..session import spread, written
from .registry import query

C = F.col
K = 10

TOK = "regexp_extract_all(lower({}), '[a-zß-öø-ÿ0-9]+')"
BM25 = f"""dw AS (SELECT doc_id AS doc, {TOK.format('text')} AS ws FROM documents), dl AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avg_dl FROM dw),
po AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(ws) AS dl, unnest(ws) AS term FROM dw) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({TOK.format('text')}) AS term FROM benchmark WHERE item_id % 20 = 0),
sc AS (SELECT query_id, doc AS id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM qt JOIN po USING (term) JOIN df USING (term), dl GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= {{k}})"""
# every item and every vector whose id is divisible by 20 asks; a question's vector is the one of its id
DENSE = """dv AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dv QUALIFY rank <= {k})"""


def questions(t) -> DataFrame:
    return t.benchmark.filter("item_id % 20 = 0").select(C("item_id").alias("query_id"), "text")


def vectors(t) -> DataFrame:
    return t.embeddings.filter("vec_id % 20 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("vector"))


def bm25(t, k: int = K) -> DataFrame:
    return R.bm25(spread(t.documents.select("doc_id", "text")), questions(t), "doc_id", "text", k)


def dense(t, k: int = K) -> DataFrame:
    return R.dense(t.embeddings, vectors(t), "vec_id", "embedding", k)


@query(f"WITH {BM25.format(k=K)} SELECT query_id, id, score, rank FROM bm")
def bm25_topk(t) -> DataFrame:
    return bm25(t).withColumn("rank", C("rank").cast("long"))


@query(f"WITH {DENSE.format(k=K)} SELECT query_id, id, score, rank FROM dn")
def dense_topk(t) -> DataFrame:
    return dense(t).withColumn("rank", C("rank").cast("long"))


@query()
def ivf_topk(t) -> DataFrame:
    """The ten nearest vectors by an inverted file; of these nearly random vectors three quarters of the cells must be probed."""
    index = t.keep("vector-index", lambda: vector_index.build(spread(t.embeddings), "vec_id", "embedding"))
    found = vector_index.search(index, vectors(t), K, probes=-(-3 * len(index.centroids) // 4))
    return found.select("query_id", "id", "score", C("rank").cast("long").alias("rank"))


LEGS = f"{BM25.format(k=50)}, {DENSE.format(k=50)}, legs AS (SELECT query_id, 0 AS list_idx, id, rank FROM dn UNION ALL SELECT query_id, 1, id, rank FROM bm)"
FUSED = f"{LEGS}, fu AS (SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM legs GROUP BY ALL) QUALIFY rank <= {{k}})"


def legs(t) -> DataFrame:
    leg = lambda df, i: df.select("query_id", F.lit(i).alias("list_idx"), "id", "rank")
    return leg(dense(t, 50), 0).unionByName(leg(bm25(t, 50), 1))


@query(f"WITH {FUSED.format(k=K)} SELECT query_id, id, rrf, rank FROM fu")
def hybrid_rrf(t) -> DataFrame:
    return R.rrf(legs(t), ["query_id"], K).select("query_id", "id", "rrf", C("rank").cast("long").alias("rank"))


# Fixed values of the search: pool, score threshold and its floor, candidates per parent, candidates and picks of the diversity step, characters of context
POOL_SIZE, LEAST_SCORE, FLOOR, PER_PARENT, CANDIDATES, PICKS, BUDGET = 30, 0.02, 5, 4, 10, 5, 24_000


def _search_sql() -> str:
    """Legs, fusion, score, threshold with floor, cap, diversity step by step, parents, budget."""
    steps = []
    for i in range(2, PICKS + 1):
        picked = " UNION ALL ".join(f"SELECT g, id FROM s{j}" for j in range(1, i))
        steps.append(
            f"s{i} AS (SELECT g, arg_min(id, (-round(val, 12), -score, id)) AS id FROM (SELECT r.g, r.id, r.score, 0.6 * r.rel - 0.4 * max(list_cosine_similarity(r.v, p.v)) AS val FROM re r JOIN ({picked}) x ON x.g = r.g JOIN re p ON p.g = x.g AND p.id = x.id"
            f" WHERE NOT EXISTS (SELECT 1 FROM ({picked}) y WHERE y.g = r.g AND y.id = r.id) GROUP BY r.g, r.id, r.score, r.rel) GROUP BY g)"
        )
    picks = " UNION ALL ".join(f"SELECT g, id, {i} AS pick FROM s{i}" for i in range(1, PICKS + 1))
    return f"""WITH {FUSED.format(k=POOL_SIZE)},
qw AS (SELECT item_id AS query_id, list_distinct({TOK.format('text')}) AS x FROM benchmark WHERE item_id % 20 = 0), tw AS (SELECT doc_id AS id, source, text, list_distinct({TOK.format('text')}) AS y FROM documents WHERE doc_id IN (SELECT id FROM fu)),
sj AS (SELECT query_id, id, source, text, round(CASE WHEN len(x) + len(y) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS score FROM fu JOIN qw USING (query_id) JOIN tw USING (id)),
th AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos, bool_or(score >= {LEAST_SCORE}) OVER (PARTITION BY query_id) AS ok FROM sj),
ca AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS n FROM th WHERE score >= {LEAST_SCORE} OR (NOT ok AND pos <= {FLOOR})),
cd AS (SELECT query_id AS g, id, score, source, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM ca WHERE n <= {PER_PARENT} QUALIFY place <= {CANDIDATES}),
re AS MATERIALIZED (SELECT cd.*, embedding::DOUBLE[] AS v, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS rel, count(*) OVER w AS size
  FROM cd JOIN embeddings ON vec_id = id % 500 WINDOW w AS (PARTITION BY g)),
s1 AS (SELECT g, arg_min(id, (-rel, -score, id)) AS id FROM re GROUP BY g), {", ".join(steps)},
pk AS (SELECT g, id, pick FROM ({picks}) JOIN (SELECT DISTINCT g, size FROM re) USING (g) WHERE size > {PICKS} UNION ALL SELECT g, id, place FROM re WHERE size <= {PICKS}),
bu AS (SELECT pk.*, score, source, text, sum(length(text)) OVER (PARTITION BY g ORDER BY pick) AS used FROM pk JOIN re USING (g, id))
SELECT g AS query_id, pick AS rank, id, source, score, left(text, 40) AS head, used::BIGINT AS used FROM bu WHERE used <= {BUDGET}"""


@query(_search_sql())
def hybrid_search(t) -> DataFrame:
    """Question to context: two legs, fusion, a score of every candidate's whole text, threshold with floor, a cap for each source, diversity, parents and the budget."""
    texts = t.documents.select(C("doc_id").alias("id"), C("source").alias("parent_id"), "text")
    pool = written(R.rrf(legs(t), ["query_id"], POOL_SIZE).select("query_id", "id"), "pool")
    pool = pool.join(R.small(questions(t).withColumnRenamed("text", "asked")), "query_id")
    scored = texts.join(R.small(pool), "id").select("query_id", "id", "parent_id", F.round(R.overlap(C("asked"), C("text")), 6).alias("score"), F.length("text").alias("size"), F.substring("text", 1, 40).alias("head"))
    scored = written(scored, "candidates")  # a few for each question, without their texts
    best = R.rerank(scored, ["query_id"], CANDIDATES, threshold=LEAST_SCORE, per_parent=PER_PARENT, floor=FLOOR)
    near = t.embeddings.select(C("vec_id").alias("slot"), C("embedding").cast("array<double>").alias("vector"))
    picks = R.mmr(best.withColumn("slot", C("id") % 500).join(near, "slot").select("query_id", "id", "score", "vector"), "query_id", PICKS)
    rows = picks.select("query_id", "id", C("pick_order").alias("rank")).join(scored.withColumnRenamed("parent_id", "source"), ["query_id", "id"])
    used = F.sum("size").over(Window.partitionBy("query_id").orderBy("rank"))
    return R.within_budget(rows, ["query_id"], C("size"), BUDGET).select("query_id", C("rank").cast("long").alias("rank"), "id", "source", "score", "head", used.alias("used"))


@query("SELECT query_id, list_idx, id, n AS rank FROM (SELECT query_id, list_idx, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list_idx, id) AS n FROM hits) WHERE n <= 4", "hits")
def multi_collection(t) -> DataFrame:
    """Lists of several collections as one, by score; duplicates stay."""
    return R.ranked(t.hits.drop("rank"), ["query_id"], F.desc("score"), C("list_idx"), C("id"), limit=4).select("query_id", "list_idx", "id", C("rank").cast("long").alias("rank"))


@query("""SELECT query_id, id, rrf, lists, first_list, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, string_agg(list_idx, ',' ORDER BY list_idx) AS lists, min(list_idx) AS first_list FROM hits GROUP BY ALL)""", "hits")
def rrf_merge(t) -> DataFrame:
    rows = R.rrf(t.hits, ["query_id"])
    return rows.select("query_id", "id", "rrf", F.array_join(C("lists").cast("array<string>"), ",").alias("lists"), "first_list", C("rank").cast("long").alias("rank"))


@query(f"WITH {BM25.format(k=50)}, p AS (SELECT query_id, source AS parent, min(rank) AS first FROM bm JOIN documents ON doc_id = id GROUP BY ALL) SELECT query_id, parent, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM p QUALIFY rank <= 5")
def bm25_parents(t) -> DataFrame:
    parents = bm25(t, 50).join(t.documents.select(C("doc_id").alias("id"), C("source").alias("parent")), "id").groupBy("query_id", "parent").agg(F.min("rank").alias("first"))
    return R.ranked(parents, ["query_id"], C("first"), limit=5).select("query_id", "parent", C("rank").cast("long").alias("rank"))


BEST = "b AS (SELECT query_id, id, max(score) AS score, min(parent_id) AS parent_id FROM hits GROUP BY ALL)"


@query(f"""WITH {BEST}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, id) AS n FROM b)
SELECT query_id, id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c WHERE n <= 2 QUALIFY rank <= 3""", "hits")
def rerank_cap(t) -> DataFrame:
    return R.rerank(t.hits, ["query_id"], 3).select("query_id", "id", "parent_id", C("rank").cast("long").alias("rank"))


@query(f"""WITH {BEST}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM b QUALIFY pos <= 6), a AS (SELECT *, bool_or(score >= 60000) OVER (PARTITION BY query_id) AS ok FROM p),
f AS (SELECT * FROM a WHERE score >= 60000 OR (NOT ok AND pos <= 5)), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, id) AS n FROM f)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c WHERE n <= 2 QUALIFY rank <= 2""", "hits")
def batched_rerank(t) -> DataFrame:
    """A pool of three times k, the threshold with its floor, the cap, and k."""
    return R.rerank(t.hits, ["query_id"], 2, threshold=60000, pool=6).select("query_id", "id", C("rank").cast("long").alias("rank"))


POOL = "po AS (SELECT vec_id // 25 AS g, vec_id AS id, (vec_id * 37 % 101) / 100.0::DOUBLE AS score, embedding::DOUBLE[] AS v FROM embeddings)"
MMR = f"""WITH RECURSIVE {POOL}, re AS MATERIALIZED (SELECT g, id, score, v, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS rel, count(*) OVER w AS size FROM po WINDOW w AS (PARTITION BY g)),
s1 AS (SELECT g, arg_min(id, (-rel, -score, id)) AS id FROM re GROUP BY g),
{{steps}}
SELECT g, id, pick_order FROM (SELECT g, id, 1 AS pick_order FROM s1 {{union}})"""


def _mmr_sql(k: int = 4) -> str:
    steps = []
    for i in range(2, k + 1):
        picked = " UNION ALL ".join(f"SELECT g, id FROM s{j}" for j in range(1, i))
        steps.append(
            f"s{i} AS (SELECT g, arg_min(id, (-round(val, 12), -score, id)) AS id FROM (SELECT r.g, r.id, r.score, 0.6 * r.rel - 0.4 * max(list_cosine_similarity(r.v, p.v)) AS val FROM re r JOIN ({picked}) x ON x.g = r.g JOIN re p ON p.g = x.g AND p.id = x.id"
            f" WHERE NOT EXISTS (SELECT 1 FROM ({picked}) y WHERE y.g = r.g AND y.id = r.id) GROUP BY r.g, r.id, r.score, r.rel) GROUP BY g)"
        )
    return MMR.format(steps=",\n".join(steps), union=" ".join(f"UNION ALL SELECT g, id, {i} FROM s{i}" for i in range(2, k + 1)))


@query(_mmr_sql())
def mmr_select(t) -> DataFrame:
    pool = t.embeddings.select(F.floor(C("vec_id") / 25).alias("g"), C("vec_id").alias("id"), ((C("vec_id") * 37 % 101) / 100).alias("score"), C("embedding").cast("array<double>").alias("vector"))
    return R.mmr(pool, "g", 4).select("g", "id", "pick_order")


@query("""WITH p AS (SELECT query_id, list_idx AS priority, rank, id FROM hits), o AS (SELECT query_id, id, min((priority, rank)) AS f FROM p GROUP BY ALL)
SELECT query_id, id, f[1] AS priority, row_number() OVER (PARTITION BY query_id ORDER BY f, id) AS rank FROM o QUALIFY rank <= 3""".replace("min((priority, rank))", "min(priority * 1000000 + rank)").replace("f[1] AS priority", "(f // 1000000)::INT AS priority"), "hits")
def fused_pool(t) -> DataFrame:
    """Pools in a fixed order of retrievers, the first of each id."""
    return R.first_seen(t.hits.withColumnRenamed("list_idx", "priority"), ["query_id"], 3).select("query_id", "id", "priority", C("rank").cast("long").alias("rank"))


ENT = "e AS (SELECT item_id AS query_id, w AS entity FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS w FROM benchmark WHERE item_id % 20 = 0))"


@query(f"""WITH {ENT}, dt AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS ws, n_chars FROM documents), x AS (SELECT doc_id, n_chars, unnest(ws) AS entity FROM dt),
h AS (SELECT query_id, entity, doc_id, row_number() OVER (PARTITION BY query_id, entity ORDER BY n_chars, doc_id) AS n FROM e JOIN x USING (entity) QUALIFY n <= 10) SELECT DISTINCT query_id, doc_id FROM h""")
def entity_probe(t) -> DataFrame:
    """Ten documents for each entity of a question, once each; shorter ones count as nearer."""
    words = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("entity"))
    asked = words(questions(t), "query_id")
    rows = words(t.documents, "doc_id", "n_chars").join(R.small(asked), "entity")
    return R.ranked(rows, ["query_id", "entity"], C("n_chars"), C("doc_id"), limit=10).select("query_id", "doc_id").distinct()


@query(f"WITH {BM25.format(k=K)} SELECT query_id, id FROM bm")
def community_probe(t) -> DataFrame:
    """Anchors of a community search: the ten best for the concatenated text."""
    return bm25(t, K).select("query_id", "id")


@query("SELECT query_id, rank, id FROM (SELECT query_id, rank, id, sum(id % 50) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM hits WHERE list_idx = 1) WHERE used <= 60", "hits")
def budget_pack(t) -> DataFrame:
    return R.within_budget(t.hits.filter("list_idx = 1"), ["query_id"], C("id") % 50, 60).select("query_id", "rank", "id")


@query("SELECT event_id, round(CASE WHEN x > 60 THEN 1.0::DOUBLE WHEN x < -60 THEN 0.0::DOUBLE ELSE 1 / (1 + exp(-x)) END, 9) AS value FROM (SELECT event_id, (event_id % 200 - 100)::DOUBLE AS x FROM events)")
def sigmoid(t) -> DataFrame:
    return t.events.select("event_id", F.round(R.sigmoid((C("event_id") % 200 - 100).cast("double")), 9).alias("value"))


@query("SELECT query_id, coalesce(CASE WHEN event_type <> 'error' THEN latency_ms END, k::DOUBLE) AS score FROM qlog", "qlog")
def rerank_fallback(t) -> DataFrame:
    return t.qlog.select("query_id", F.coalesce(F.when(C("event_type") != "error", C("latency_ms")), C("k").cast("double")).alias("score"))


@query(f"""WITH p AS (SELECT d.doc_id, list_distinct({TOK.format('d.text')}) AS x, list_distinct({TOK.format('b.text')}) AS y FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)
SELECT doc_id, CASE WHEN len(x) + len(y) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) END AS score FROM p""")
def overlap_score(t) -> DataFrame:
    rows = t.documents.select("doc_id", "text", (C("doc_id") % 40).alias("item_id")).join(t.benchmark.withColumnRenamed("text", "asked"), "item_id")
    return rows.select("doc_id", F.round(R.overlap(C("text"), C("asked")), 6).alias("score"))


# The baseline's numbers and what each intent multiplies top_k_rerank by
BASELINE = {"top_k_rerank": 20, "mmr_pool_mult": 3, "use_mmr": True}
POLICIES = (
    ("factoid", 1.0), ("definitional", 1.0), ("computational", 1.0), ("unknown", 1.0), ("multi_hop", 2.0), ("comparative", 2.0), ("literature_synthesis", 3.0), ("sensemaking", 3.0),
)


@query(f"""WITH p(intent, m) AS (VALUES {', '.join(f"('{n}', {m}::DOUBLE)" for n, m in POLICIES)}),
q AS (SELECT query_id, {[n for n, _ in POLICIES] + ['other']!r}[(query_id % 9 + 1)::INT] AS intent, CASE WHEN query_id % 5 = 0 THEN 7 END AS override, CASE WHEN query_id % 7 = 0 THEN false END AS flag FROM qlog)
SELECT query_id, coalesce(override, ceil(20 * coalesce(m, 1)))::INT AS k, 3 * coalesce(override, ceil(20 * coalesce(m, 1)))::INT AS pool, coalesce(flag, true) AS use_mmr FROM q LEFT JOIN p USING (intent)""", "qlog")
def policy_resolve(t) -> DataFrame:
    """The baseline scaled by intent, then overrides, then the query's own flag."""
    table = t.spark.createDataFrame(POLICIES, "intent string, m double")
    q = C("query_id")
    intent = F.element_at(F.array(*(F.lit(n) for n, _ in POLICIES), F.lit("other")), (q % 9 + 1).cast("int"))
    rows = t.qlog.select("query_id", intent.alias("intent"), F.when(q % 5 == 0, 7).alias("override"), F.when(q % 7 == 0, False).alias("flag")).join(F.broadcast(table), "intent", "left")
    k = F.coalesce("override", F.ceil(BASELINE["top_k_rerank"] * F.coalesce("m", F.lit(1))).cast("int"))
    return rows.select("query_id", k.alias("k"), (BASELINE["mmr_pool_mult"] * k).alias("pool"), F.coalesce("flag", F.lit(BASELINE["use_mmr"])).alias("use_mmr"))


@query("""SELECT a.vec_id % 50 AS question, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) * (a.vec_id % 50 % 4 > 0)::INT, 6) AS relevancy
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id % 50 GROUP BY a.vec_id % 50""")
def answer_relevancy(t) -> DataFrame:
    """The mean cosine of generated questions to the asked one, 0 for an evasive answer."""
    made = t.embeddings.select((C("vec_id") % 50).alias("question"), C("embedding").alias("a"))
    rows = made.join(t.embeddings.select(C("vec_id").alias("question"), C("embedding").alias("b")), "question")
    return rows.groupBy("question").agg((F.avg(R.cosine(C("a"), C("b")))).alias("c")).select("question", F.round(C("c") * (C("question") % 4 > 0).cast("int"), 6).alias("relevancy"))


@query("""WITH p AS (SELECT query_id, list_idx * 100000 + rank AS idx, id, score FROM hits), m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM p)
SELECT query_id, idx, id, CASE WHEN id % 5 > 0 THEN round(score / top, 6) ELSE 0 END AS score FROM m""", "hits")
def scatter_scores(t) -> DataFrame:
    """Pairs scored by query, each query on its own scale; scores go back to the places of their pairs."""
    pairs = t.hits.select("query_id", (C("list_idx") * 100000 + C("rank")).alias("idx"), "id", C("score").alias("raw"))
    scored = pairs.withColumn("score", F.round(C("raw") / F.max("raw").over(Window.partitionBy("query_id")), 6)).filter("id % 5 > 0")
    return R.scattered(pairs.drop("raw"), scored, "query_id", "idx")


@query("SELECT query_id, list_idx, id, rank FROM hits WHERE rank <= 2 * 3", "hits")
def pool_truncate(t) -> DataFrame:
    """Pools of k times a multiplier."""
    return t.hits.filter(C("rank") <= 2 * BASELINE["mmr_pool_mult"]).select("query_id", "list_idx", "id", "rank")


@query("""WITH p AS (SELECT query_id, id, id * 37 % 101 AS s FROM hits WHERE list_idx = 0 AND rank <= 6), r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p)
SELECT query_id, id, rank, CASE WHEN rank <= 2 THEN 'read' ELSE 'rerank' END AS stage FROM r""", "hits")
def passage_stages(t) -> DataFrame:
    """The first candidates reranked, the best of them read."""
    rows = R.passage_stages(t.hits.filter("list_idx = 0").select("query_id", "id", "rank"), ["query_id"], C("id") * 37 % 101, 6, 2)
    return rows.select("query_id", "id", C("rank").cast("long").alias("rank"), "stage")
