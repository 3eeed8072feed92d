"""Queries for records, responses, prompts, search, dialog, streams, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgflow.functions import text as T
from kgflow.functions.intervals import parse_interval_query
from kgflow.operators import dialog as D
from kgflow.operators import records as R
from kgflow.operators import sets as X
from kgflow.plans import assoc as A
from kgflow.plans import search as V
from kgflow.queries import graph as G
from kgflow.queries.graph import SQL_INTERVALS, table
from kgflow.sources import files as S
from kgflow.sources.keyed import GraphStore, KeyedTable
from kgflow.sources.scratch import scratch_path
from kgflow.streaming import dialogs as DS
from kgflow.streaming import streams as ST

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def records(spark, d):
    """A JSON record per order: nested, with an array of its lines."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")))).alias("lines"))
    o = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("key")).alias("cust")).alias("head"), F.col("o_orderpriority").alias("priority"), F.lit("http://x.example").alias("link"), F.lit(" ").alias("blank"), "lines"))
    return o.select(F.col("o_orderkey").alias("chunk_id"), body.alias("json"), F.create_map(F.lit("file"), F.concat(F.lit("f"), F.col("o_orderkey") % 7)).alias("metadata"))


@query("SELECT o_orderkey AS chunk_id, o_orderstatus AS status, o_custkey::VARCHAR AS cust FROM orders")
def json_path_get(spark, d):
    return records(spark, d).select("chunk_id", T.json_path_get(F.col("json"), "head.status").alias("status"), T.json_path_get(F.col("json"), "head.cust.key").alias("cust"))


@query("""SELECT o_orderkey AS chunk_id, o_custkey::VARCHAR AS value, part, o_orderstatus AS deep, NULL::VARCHAR AS missing
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey)::VARCHAR AS part FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def json_find_key(spark, d):
    r = records(spark, d)
    deep = F.concat(F.lit('{"a":[1,[{"b":{"c":{"d":[{"e":'), "json", F.lit("}]}}}]]}"))
    found = r.select("chunk_id", T.json_find_keys(F.col("json"), ["key", "part"]).alias("own"), T.json_find_keys(deep, ["status", "none"]).alias("deep"))
    return found.select("chunk_id", F.get("own", F.lit(0)).alias("value"), F.get("own", F.lit(1)).alias("part"), F.get("deep", F.lit(0)).alias("deep"), F.get("deep", F.lit(1)).alias("missing"))


@query("SELECT o_orderkey AS chunk_id, 'priority:' || o_orderpriority AS rest FROM orders")
def json_collect_remaining(spark, d):
    return records(spark, d).select("chunk_id", T.json_collect_remaining(F.col("json"), ["id"]).alias("rest"))


@query("SELECT event_id, json_extract_string(props, '$.k') || '/' || event_type AS both, event_type AS kind FROM events")
def composite_field(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", T.composite_field([T.json_path_get(F.col("props"), "k"), F.col("event_type")], "/").alias("both"), T.metadata_field(F.col("event_type"), F.lit("none")).alias("kind"))


_MAP = [
    R.NodeMapping("order", {"status": "head.status"}, {"file": "file"}, {"full": (("id", "priority"), "|")}),
    R.NodeMapping("rest", {}, {}, {}, "text"),
    R.NodeMapping("line", {"part": "part", "supp": "supp"}, array="lines"),
]


@query("""SELECT o_orderkey AS chunk_id, 0 AS element, 'order' AS node_type, o_orderstatus AS status, 'f' || o_orderkey % 7 AS file, o_orderkey || '|' || o_orderpriority AS "full", NULL AS text, NULL AS part FROM orders
UNION ALL SELECT o_orderkey, 0, 'rest', NULL, NULL, NULL, 'id:' || o_orderkey || '；priority:' || o_orderpriority, NULL FROM orders
UNION ALL SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) - 1)::INT, 'line', NULL, NULL, NULL, NULL, l_partkey::VARCHAR FROM lineitem""")
def map_json_nodes(spark, d):
    n, a = R.map_json_nodes(records(spark, d), _MAP), F.col("attributes")
    return n.select("chunk_id", "element", "node_type", *[F.try_element_at(a, F.lit(k)).alias(k) for k in ("status", "file", "full", "text", "part")])


@query("SELECT 'f' || o_custkey AS source_file, count(*) AS n FROM orders GROUP BY 1")
def scan_json_records(spark, d):
    recs = records(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_custkey"), "chunk_id")
    arrays = recs.groupBy(F.concat(F.lit("f"), "o_custkey").alias("source_file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("json"), ","), F.lit("]")).alias("text"))
    return R.scan_json_records(arrays).groupBy("source_file").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'][c_nationkey % 10 + 1] || CASE WHEN c_custkey % 3 = 0 THEN '-' || c_mktsegment ELSE '' END AS grade,
CASE c_mktsegment WHEN 'BUILDING' THEN 'HIGH' WHEN 'MACHINERY' THEN 'LOW' ELSE c_mktsegment END AS level FROM customer""")
def normalize_grade(spark, d):
    c = table(spark, d, "customer")
    sign = F.get(F.split(F.lit("ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ"), ""), (F.col("c_nationkey") % 10).cast("int"))
    grade = F.concat(F.lit("　"), sign, F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("-"), "c_mktsegment")).otherwise(F.lit("级")), F.lit(" "))
    return c.select("c_custkey", T.normalize_grade(grade, {"none": "NONE"}).alias("grade"), T.normalize_grade(F.concat(F.lit(" "), "c_mktsegment", F.lit("级")), {"BUILDING": "HIGH", "MACHINERY": "LOW"}).alias("level"))


@query("""SELECT c_custkey, '{"name":"' || c_name || '","nation":' || c_nationkey || '}' AS who, '["' || c_mktsegment || '","x"]' AS tags, '{"k":"' || c_mktsegment || '"}' AS attrs FROM customer""")
def serialize_nested(spark, d):
    c = table(spark, d, "customer")
    return T.serialize_nested(c.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("who"), F.array("c_mktsegment", F.lit("x")).alias("tags"), F.create_map(F.lit("k"), "c_mktsegment").alias("attrs")))


@query("SELECT c_mktsegment AS node_type, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 999 END AS priority FROM customer GROUP BY 1")
def type_priority(spark, d):
    order = F.when(F.col("c_mktsegment") == "MACHINERY", 1).when(F.col("c_mktsegment") == "BUILDING", 2)
    return X.type_priority(table(spark, d, "customer").select(F.col("c_mktsegment").alias("node_type"), order.alias("priority")).distinct())


@query("SELECT c_custkey, 2::BIGINT AS n, c_name AS name, true AS declared, c_mktsegment AS last FROM customer")
def conform_schema(spark, d):
    c = table(spark, d, "customer")
    m = T.conform_schema(F.create_map(F.lit("name"), F.col("c_name")), ["name", "grade"])
    flat = T.flatten_array_of_objects(F.array(F.create_map(F.lit("a"), F.col("c_name")), F.create_map(F.lit("a"), F.col("c_mktsegment"))))
    return c.select("c_custkey", F.size(m).cast("long").alias("n"), m["name"].alias("name"), F.map_contains_key(m, "grade").alias("declared"), flat["a"].alias("last"))


def _responses(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    node = lambda t, k, v: F.struct(F.lit(t).alias("node_type"), F.create_map(F.lit(k), v).alias("attributes"))
    rel = F.array(F.struct(F.lit("customer").alias("head_type"), F.lit("nation").alias("tail_type"), F.lit("lives_in").alias("relation_type")))
    body = F.to_json(F.struct(F.array(node("customer", "name", F.col("c_name")), node("ghost", "x", F.col("c_name")), node("nation", "name", F.col("n_name"))).alias("nodes"), rel.alias("relations")))
    wrapped = F.when(F.col("c_custkey") % 5 == 0, "no JSON here {").otherwise(F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone.")))
    return c.select(F.col("c_custkey").alias("chunk_id"), wrapped.alias("response"))


@query("""SELECT c_custkey AS chunk_id, 0 AS pos, 'customer' AS node_type, c_name AS name, 0.85::DOUBLE AS confidence FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT c_custkey, 2, 'nation', n_name, 0.85 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0""")
def nodes_from_response(spark, d):
    n = R.nodes_from_response(_responses(spark, d), ["customer", "nation"])
    return n.select("chunk_id", "pos", "node_type", F.col("attributes")["name"].alias("name"), "confidence")


@query("SELECT c_custkey AS chunk_id, 'IN_NATION' AS relation_type, 0 AS head, 2 AS tail, 0.8::DOUBLE AS confidence FROM customer WHERE c_custkey % 5 <> 0")
def edges_from_response(spark, d):
    r = _responses(spark, d)
    return R.edges_from_response(r, R.nodes_from_response(r, ["customer", "nation"]), {"lives_in": "IN_NATION"})


@query("SELECT o_orderkey AS id, 'Order ' || o_orderkey || ' of ' || o_custkey || chr(10) || 'Status ' || o_orderstatus || ', note ' AS prompt FROM orders")
def render_prompt(spark, d):
    t = spark.createDataFrame([("s", 1, "Order {id} of {cust}"), ("s", 2, "Status {status}, note {note}")], "scenario string, ord int, content string")
    o = table(spark, d, "orders")
    ctx = o.select(F.col("o_orderkey").alias("id"), F.lit("s").alias("scenario"), F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("status"), "o_orderstatus").alias("variables"))
    return R.render_prompts(t, ctx)


@query("SELECT doc_id AS id, md5('Extract from: ' || coalesce(text, '') || chr(10) || '- name: who') AS prompt_md5 FROM documents")
def build_extraction_prompt(spark, d):
    t = spark.createDataFrame([("x", 1, "Extract from: {text}"), ("x", 2, "- name: who")], "scenario string, ord int, content string")
    ctx = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("x").alias("scenario"), F.create_map(F.lit("text"), "text").alias("variables"))
    return R.render_prompts(t, ctx).select("id", F.md5("prompt").alias("prompt_md5"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'plan-' || c_custkey END AS history_plan, n_name AS current_site FROM customer JOIN nation ON c_nationkey = n_nationkey")
def prefix_format(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    plans = F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat(F.lit("plan-"), "c_custkey"))).otherwise(F.array().cast("array<string>"))
    rows = c.select("c_custkey", *T.prefix_format({"history": {"plan": plans}, "current": {"site": F.array("n_name")}}))
    return rows.select("c_custkey", F.array_join("history_plan", "|").alias("history_plan"), F.array_join("current_site", "|").alias("current_site"))


# --- search ---------------------------------------------------------------------------------------------------------

_HIDDEN = ((1.0, -1.0, 0.1), (0.5, 0.5, 0.0), (-1.0, 1.0, 0.2))
_OUT = ((0.6, 0.3, -0.2, 0.1), (-0.4, 0.2, 0.7, 0.0))


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("node_id"), F.col("label").alias("category"), F.col("embedding").alias("v"), F.slice("embedding", 1, 16).alias("v_key"))


def _queries(spark, d):
    return _vectors(spark, d).where("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), "category", F.col("v").alias("q"), F.col("v_key").alias("q_key"))


_COS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, (embedding[1:16])::DOUBLE[] AS k FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS node_id, list_cosine_similarity(a.e, b.e) AS similarity, list_cosine_similarity(a.k, b.k) AS key_score FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 50 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, node_id) AS rank FROM s WHERE similarity > 0.1)"""


@query(f"WITH {_COS} SELECT query_id, node_id, round(similarity, 6) AS similarity, rank FROM c WHERE rank <= 10")
def cosine_topk(spark, d):
    got = V.cosine_topk(_queries(spark, d).select("query_id", "category", "q"), _vectors(spark, d).select("node_id", "category", "v"), "category", 0.1)
    return got.select("query_id", "node_id", F.round("similarity", 6).alias("similarity"), "rank")


_H = "greatest(0, key_score - similarity + 0.1) AS h1, greatest(0, 0.5 * key_score + 0.5 * similarity) AS h2, greatest(0, similarity - key_score + 0.2) AS h3"
_GATE = f"g AS (SELECT *, {_H} FROM c WHERE rank <= 10), w AS (SELECT *, 1 / (1 + exp((-0.4 * h1 + 0.2 * h2 + 0.7 * h3) - (0.6 * h1 + 0.3 * h2 - 0.2 * h3 + 0.1))) AS alpha FROM g)"


@query(f"WITH {_COS}, {_GATE} SELECT query_id, node_id, round(alpha, 6) AS alpha, round(1 - alpha, 6) AS beta FROM w")
def weight_gate(spark, d):
    q, v = _queries(spark, d), _vectors(spark, d)
    rows = V.cosine_topk(q.select("query_id", "category", "q"), v.select("node_id", "category", "v"), "category", 0.1).join(q.select("query_id", "q_key"), "query_id").join(v.select("node_id", "v_key"), "node_id")
    w = V.weight_gate(T.cosine(F.col("q_key"), F.col("v_key")), F.col("similarity"), _HIDDEN, _OUT)
    return rows.select("query_id", "node_id", F.round(w["alpha"], 6).alias("alpha"), F.round(w["beta"], 6).alias("beta"))


@query(f"WITH {_COS}, {_GATE}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY alpha * similarity + (1 - alpha) * key_score DESC, node_id) AS r FROM w)"
       " SELECT query_id, node_id, round(alpha * similarity + (1 - alpha) * key_score, 6) AS score, r AS rank FROM f WHERE r <= 4")  # fmt: skip
def hybrid_search(spark, d):
    got = V.hybrid_search(_queries(spark, d), _vectors(spark, d), "category", _HIDDEN, _OUT, 0.1)
    return got.select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


_SYNONYMS = {"and": "L1", "und ": "L2", "que": "L3"}
_SEARCH_LOOKUPS = [A.Association("risks", (A.Field("name", "name"),), (A.Step("RESPONDS_TO"),)), A.Association("nations", (A.Field("name", "name"),), (A.Step("USED_IN"),)), A.Association("regions", (A.Field("name", "name"),), (A.Step("USED_IN"), A.Step("IN_REGION")))]
_SEARCH_POSITIONS = [A.Association("sites", (A.Field("name", "name"),), kind="interval", node_type="orders")]


@query(f"""WITH {SQL_INTERVALS}, q AS (SELECT conv_id * 100 + turn AS query_id, CASE WHEN contains(text, 'und ') THEN 1 + 1 WHEN contains(text, 'and') THEN 1 WHEN contains(text, 'que') THEN 3 END AS category, conv_id * 1000 + turn * 100 AS place,
(conv_id * 31 + turn) % (SELECT count(*) FROM embeddings) AS vec_id FROM conversations WHERE role = 'user'),
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, (embedding[1:16])::DOUBLE[] AS k FROM embeddings),
s AS (SELECT query_id, b.vec_id AS node_id, list_cosine_similarity(a.e, b.e) AS similarity, list_cosine_similarity(a.k, b.k) AS key_score FROM q JOIN v a ON a.vec_id = q.vec_id JOIN v b ON q.category IS NULL OR q.category = b.label),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, 'v' || node_id) AS rank FROM s WHERE similarity > 0.1), {_GATE},
f AS (SELECT *, alpha * similarity + (1 - alpha) * key_score AS score, row_number() OVER (PARTITION BY query_id ORDER BY alpha * similarity + (1 - alpha) * key_score DESC, 'v' || node_id) AS r FROM w),
x AS (SELECT query_id, r, 'v' || node_id AS node, round(score, 6) AS score, 'L' || label AS risk, n_name AS nation, r_name AS region FROM f JOIN embeddings ON vec_id = node_id JOIN nation ON n_nationkey = node_id % 25 JOIN region ON r_regionkey = n_regionkey WHERE r <= 4),
p AS (SELECT query_id, count(*) AS n FROM q JOIN g_intervals ON s <= place + 50 AND place <= e GROUP BY 1)
SELECT query_id, count(x.r) AS n_results, string_agg(node, '|' ORDER BY r) AS found, max(score) FILTER (r = 1) AS best, string_agg(risk, '|' ORDER BY r) AS risks, string_agg(nation, '|' ORDER BY r) AS nations, string_agg(region, '|' ORDER BY r) AS regions, coalesce(any_value(p.n), 0) AS n_sites
FROM q LEFT JOIN x USING (query_id) LEFT JOIN p USING (query_id) GROUP BY 1""")
def search(spark, d):
    """Every question of the conversations: slots, sub-graph, vectors, fused scores, associations of results and position."""
    said = table(spark, d, "conversations").where("role = 'user'")
    text = F.concat("text", F.lit(" at DK"), "conv_id", F.lit("+"), F.col("turn") * 100, F.lit("~DK"), "conv_id", F.lit("+"), F.col("turn") * 100 + 50)
    slots = said.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), T.extract_slots(text, _SYNONYMS, ["left"], "main").alias("slots"), (F.col("conv_id") * 31 + F.col("turn")).alias("asked"))
    e = table(spark, d, "embeddings")
    n = e.count()
    vectors = e.select(F.concat(F.lit("v"), "vec_id").alias("node_id"), F.col("embedding").alias("v"), F.slice("embedding", 1, 16).alias("v_key"))
    requests = slots.join(e, F.col("asked") % n == F.col("vec_id")).select("query_id", "slots.category", parse_interval_query(F.col("slots.position")).alias("iv"), F.col("embedding").alias("q"), F.slice("embedding", 1, 16).alias("q_key"))
    name = lambda c: F.create_map(F.lit("name"), c.cast("string")).alias("attributes")
    of = lambda c: F.concat(F.lit("L"), c)
    nodes = e.select(F.concat(F.lit("v"), "vec_id").alias("node_id"), F.lit("plan").alias("node_type"), name(F.col("vec_id"))).union(e.select("label").distinct().select(of("label"), F.lit("risk"), name(of("label"))))
    orders = G.order_intervals(spark, d).select("node_id", F.lit("orders").alias("node_type"), name(F.col("status")), "iv")
    nodes = G.nodes(spark, d).where("node_type <> 'orders'").union(nodes).unionByName(orders, allowMissingColumns=True)
    link = lambda relation, to: e.select(F.lit(relation).alias("relation_type"), F.concat(F.lit("v"), "vec_id").alias("head"), to.alias("tail"), F.lit(1.0).alias("confidence"))
    edges = G.edges(spark, d).union(link("RESPONDS_TO", of("label"))).union(link("USED_IN", F.concat(F.lit("n"), F.col("vec_id") % 25)))
    got = V.search(requests, nodes, vectors, edges, "RESPONDS_TO", _SEARCH_LOOKUPS, _SEARCH_POSITIONS, _HIDDEN, _OUT, 0.1)
    told = lambda f: F.nullif(F.array_join(F.transform("results", f), "|"), F.lit(""))
    first = lambda q: told(lambda r: F.get(r[q], F.lit(0))["name"]).alias(q)
    return got.select("query_id", F.size("results").cast("long").alias("n_results"), told(lambda r: r["node_id"]).alias("found"), F.round(F.get("results", F.lit(0))["score"], 6).alias("best"), *map(first, ("risks", "nations", "regions")), F.size("sites").cast("long").alias("n_sites"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 3")
def topk_final(spark, d):
    return V.top_k(table(spark, d, "part"), "p_brand", "p_retailprice", 3, "p_partkey").select("p_partkey", "rank")


# --- dialog ---------------------------------------------------------------------------------------------------------

_KIND = "CASE event_type WHEN 'view' THEN 'query' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'accept' WHEN 'signup' THEN 'change' ELSE 'follow' END"


def _turns(spark, d):
    kind = F.expr(_KIND)
    return table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.struct("ts", "event_id").alias("turn"), kind.alias("kind"), (F.col("event_id") % 4).cast("int").alias("n_plans"), "event_id", "ts")


_FOLD = f"""WITH RECURSIVE t AS (SELECT user_id AS conv_id, {_KIND} AS kind, (event_id % 4)::INT AS n_plans, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT conv_id, 0::BIGINT AS rn, 'IDLE' AS state, 0 AS idx, 0 AS rejections, 0 AS plans FROM (SELECT DISTINCT conv_id FROM t) UNION ALL
SELECT s.conv_id, t.rn, CASE WHEN s.state = 'REFUSED' THEN 'PRESENTING' WHEN s.state IN ('IDLE', 'COMPLETED') OR kind = 'change' THEN CASE WHEN n_plans > 0 THEN 'PRESENTING' ELSE 'COMPLETED' END
 WHEN kind = 'accept' THEN 'COMPLETED' WHEN kind = 'reject' THEN CASE WHEN s.rejections + 1 >= 3 OR s.idx >= s.plans - 1 THEN 'COMPLETED' ELSE 'REFUSED' END ELSE s.state END,
CASE WHEN s.state = 'REFUSED' THEN s.idx WHEN s.state IN ('IDLE', 'COMPLETED') OR kind = 'change' THEN 0 WHEN kind = 'reject' AND NOT (s.rejections + 1 >= 3 OR s.idx >= s.plans - 1) THEN s.idx + 1 ELSE s.idx END,
CASE WHEN s.state = 'REFUSED' THEN s.rejections WHEN s.state IN ('IDLE', 'COMPLETED') OR kind = 'change' THEN 0 WHEN kind = 'reject' THEN s.rejections + 1 ELSE s.rejections END,
CASE WHEN s.state = 'REFUSED' THEN s.plans WHEN s.state IN ('IDLE', 'COMPLETED') OR kind = 'change' THEN n_plans ELSE s.plans END
FROM s JOIN t ON s.conv_id = t.conv_id AND t.rn = s.rn + 1)
SELECT conv_id, rn AS n_turns, state, idx, rejections, plans FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1"""


@query(_FOLD)
def dialog_state(spark, d):
    return D.dialog_state(_turns(spark, d))


@query("SELECT conv_id, turn, contains(text, 'no') OR contains(text, 'not') AS rejected FROM conversations")
def is_rejection(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", D.is_rejection(F.col("text"), ["no", "not"]).alias("rejected"))


_REASONS = [("cost", ["the", "er"]), ("time", ["on", "tion"]), ("safety", ["zz"])]


@query("""SELECT conv_id, turn, CASE WHEN a IS NOT NULL THEN 'cost' WHEN b IS NOT NULL THEN 'time' WHEN c IS NOT NULL THEN 'safety' ELSE 'other' END AS reason, coalesce(a, b, c) AS keyword,
CASE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT WHEN 0 THEN 0.0 WHEN 1 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence
FROM (SELECT *, CASE WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'er') THEN 'er' END AS a, CASE WHEN contains(text, 'on') THEN 'on' WHEN contains(text, 'tion') THEN 'tion' END AS b, CASE WHEN contains(text, 'zz') THEN 'zz' END AS c FROM conversations)""")
def classify_feedback(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", D.classify_feedback(F.col("text"), _REASONS).alias("f")).select("conv_id", "turn", "f.*")


@query("SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN '1. ask' || chr(10) || '2. cut' ELSE NULL END AS summary FROM conversations")
def feedback_suggestions(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", D.classify_feedback(F.col("text"), [("cost", ["the"])]).alias("f")).select("conv_id", "turn", "f.reason")
    return D.feedback_suggestions(rows, spark.createDataFrame([("cost", ["ask", "cut"])], "reason string, items array<string>")).select("conv_id", "turn", "summary")


@query("""WITH s AS (SELECT conv_id, turn, min(role) AS role, max(contains(text, 'the')) AS the, max(length(text)) > 200 AS long, list_sort(list_distinct(flatten(list(regexp_extract_all(text, '[A-Z][a-z]+'))))) AS names FROM conversations GROUP BY ALL)
SELECT conv_id, turn, row_number() OVER w > 1 AND (role IS DISTINCT FROM lag(role) OVER w OR the IS DISTINCT FROM lag(the) OVER w OR long IS DISTINCT FROM lag(long) OVER w OR names IS DISTINCT FROM lag(names) OVER w) AS changed
FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def detect_topic_change(spark, d):
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))))))
    turns = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.max(F.contains("text", F.lit("the"))).alias("the"), (F.max(F.length("text")) > 200).alias("long"), names.alias("names"))
    return D.detect_topic_change(turns, ["role", "the", "long", "names"]).select("conv_id", "turn", "changed")


# --- streams, sources, sinks ----------------------------------------------------------------------------------------


def _event_stream(spark, d):
    static = table(spark, d, "events")
    return spark.readStream.schema(static.schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT 'u' || user_id AS source_file, 'chunk' AS stage, 'done' AS status, count(*) AS n_chunks FROM events GROUP BY 1")
def stream_ingest(spark, d):
    root = scratch_path(spark, "ingest")
    chunks = _event_stream(spark, d).select(F.concat(F.lit("u"), "user_id").alias("source_file"), "event_id")
    ST.stream_ingest(chunks, f"{root}/chunks", f"{root}/ledger", f"{root}/checkpoint", "chunk", "source_file")
    return spark.read.parquet(f"{root}/ledger").groupBy("source_file", "stage", "status").agg(F.sum("n_chunks").alias("n_chunks"))


@query("SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def stream_dedup(spark, d):
    root = scratch_path(spark, "dedup")
    once = ST.stream_dedup(_event_stream(spark, d), "ts", ["user_id", "event_type"], "60 days")
    ST.run_available(once, lambda b, n: b.write.mode("overwrite").parquet(f"{root}/batch={n}"), f"{root}-checkpoint")
    return spark.read.parquet(root).agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    root = scratch_path(spark, "windows")
    w = ST.event_windows(_event_stream(spark, d), "ts", "event_type", "1 hour", "1 day")
    ST.run_available(w, lambda b, n: b.write.mode("overwrite").parquet(f"{root}/batch={n}"), f"{root}-checkpoint", "update")
    rows = ST.current_graph(spark.read.parquet(root).select("batch", "window", "event_type", F.struct("n", "total").alias("row")), ["window", "event_type"])
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS ord FROM events GROUP BY 1")
def stream_upsert_graph(spark, d):
    table = KeyedTable(spark, scratch_path(spark, "upsert"), "user_id long, event_type string, ord long", ["user_id"], 8)
    ST.stream_upsert_graph(_event_stream(spark, d).select("user_id", "event_type", F.col("event_id").alias("ord")), table, f"{table.root}/checkpoint")
    return table.read()


def _graph_parts(batch):
    """Users who signed up or bought something are nodes, and so are types of events; an event is an edge."""
    users = batch.where("event_type IN ('signup', 'purchase')").select(F.concat(F.lit("u"), "user_id").alias("node_id"), F.lit("user").alias("node_type"), F.col("event_id").alias("ord"))
    types = batch.select(F.concat(F.lit("t_"), "event_type").alias("node_id"), F.lit("type").alias("node_type"), F.col("event_id").alias("ord"))
    edges = batch.select(F.concat(F.lit("u"), "user_id").alias("head"), F.lit("DID").alias("relation_type"), F.concat(F.lit("t_"), "event_type").alias("tail"), "value", F.col("event_id").alias("ord"))
    return users.union(types), edges


@query("""WITH u AS (SELECT DISTINCT user_id FROM events WHERE event_type IN ('signup', 'purchase')), e AS (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)
SELECT 'u' || user_id AS head, 't_' || event_type AS tail, value, user_id IN (FROM u) AS kept FROM e""")
def stream_merge_graph(spark, d):
    """Nodes and edges of the event stream; an edge without its node is told."""
    store = GraphStore(spark, root := scratch_path(spark, "merge"), "node_id string, node_type string, ord long", "head string, relation_type string, tail string, value double, ord long", 8)
    ST.stream_merge_graph(_event_stream(spark, d), store, _graph_parts, f"{root}/checkpoint")
    edges = store.edges.read().withColumn("kept", F.lit(True)).union(store.rejects.read().withColumn("kept", F.lit(False)))
    return edges.select("head", "tail", "value", "kept")


@query("""WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), i AS (SELECT *, count(*) FILTER (gap IS NULL OR gap >= INTERVAL 4 HOUR) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, island
HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)""")
def event_sessions(spark, d):
    """The sessions of each user, which 4 hours without an event end, up to the watermark."""
    root = scratch_path(spark, "sessions")
    ST.run_available(ST.event_sessions(_event_stream(spark, d), "ts", "user_id", "4 hours", "1 day"), lambda b, n: b.write.mode("overwrite").parquet(f"{root}/batch={n}"), f"{root}-checkpoint")
    rows = spark.read.parquet(root)
    return rows.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start"), F.col("session.end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


_IDLE = 12 * 3600
_SESSION_FOLD = (
    _FOLD.replace("WITH RECURSIVE t AS (SELECT user_id AS conv_id,", f"""WITH RECURSIVE e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
i AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > INTERVAL {_IDLE} SECOND) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e),
t AS (SELECT (user_id, min(ts) OVER (PARTITION BY user_id, island)) AS conv_id,""")
    .replace("PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events", "PARTITION BY user_id, island ORDER BY ts, event_id) AS rn FROM i")
    .replace("SELECT conv_id, rn AS n_turns", "SELECT conv_id[1] AS conv_id, conv_id[2] AS started, rn AS n_turns")
)


@query(_SESSION_FOLD)
def stream_dialog_state(spark, d):
    """Every conversation, which 12 hours without an event end."""
    root = scratch_path(spark, "dialog")
    e = _event_stream(spark, d).select(F.col("user_id").alias("conv_id"), "ts", F.col("event_id").alias("turn"), F.expr(_KIND).alias("kind"), (F.col("event_id") % 4).alias("n_plans"))
    ST.run_available(DS.stream_dialog_state(e, _IDLE, "1 hour"), lambda b, n: b.write.mode("overwrite").parquet(f"{root}/batch={n}"), f"{root}-checkpoint", "update")
    told = DS.current_dialogs(spark.read.parquet(root))
    return told.select("conv_id", F.col("started").cast("timestamp_ntz").alias("started"), "n_turns", "state", "idx", "rejections", "plans")


@query("SELECT lang AS document_type, source AS file_type, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def sink_summary(spark, d):
    path = scratch_path(spark, "chunks")
    S.sink_chunks(table(spark, d, "documents").select("doc_id", F.col("lang").alias("document_type"), F.col("source").alias("file_type")), path)
    return S.sink_summary(spark.read.parquet(path))


@query("SELECT c_custkey AS node_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name FROM customer")
def sink_graph(spark, d):
    c = table(spark, d, "customer")
    graph = KeyedTable(spark, scratch_path(spark, "graph"), "node_id long, name string, ord int", ["node_id"], 8)
    S.sink_graph(graph, c.select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("name"), F.lit(0).alias("ord")))
    S.sink_graph(graph, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("node_id"), F.lit("new").alias("name"), F.lit(1).alias("ord")))
    return graph.read().select("node_id", "name")


@query("SELECT o_custkey AS source_file, min(t) AS tier, count(*) FILTER (t = m) AS n FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS t, min(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) OVER (PARTITION BY o_custkey) AS m FROM orders) GROUP BY 1")
def scan_extraction_results(spark, d):
    tier = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    rows = S.scan_extraction_results(table(spark, d, "orders").select(F.col("o_custkey").alias("source_file"), tier.alias("tier"), "o_orderkey"))
    return rows.groupBy("source_file").agg(F.min("tier").alias("tier"), F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def purge_results(spark, d):
    return S.purge_results(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "document_type"), "F").select("o_orderkey")


@query("SELECT lang AS folder, true AS filled FROM documents GROUP BY 1")
def scan_files(spark, d):
    path = scratch_path(spark, "files")
    table(spark, d, "documents").select("doc_id", "lang").write.partitionBy("lang").json(path)
    files = S.scan_files(spark, path, "*.json")
    return files.groupBy(F.regexp_extract("source_file", "/lang=([^/]*)/", 1).alias("folder")).agg((F.sum("length") > 0).alias("filled"))
