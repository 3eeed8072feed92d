"""Queries for merge policies and corpus tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgflow.operators import corpus as C
from kgflow.operators import merge as M
from kgflow.operators import sets as X
from kgflow.queries.graph import LINE_BLOCK, table
from kgflow.sources.files import sink_training_split as sink
from kgflow.sources.scratch import scratch_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def nodes(spark, d, by="source_file"):
    """Every line of an order is a node extracted from the order; forty orders make a file.

    The lines are dealt once, before they have strings and maps, by ``by``: the file, or the chunk, which is the order.
    An id names its order, so its copies lie together, and what groups by file or by chunk needs no further shuffle.
    Tasks grow with the table, so that each sorts its nodes in memory.
    """
    li = table(spark, d, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-li.count() // LINE_BLOCK))
    li = li.withColumns({"source_file": F.concat(F.lit("f"), F.floor(F.col("l_orderkey") / 40)), "chunk_id": F.col("l_orderkey")}).repartition(tasks, by)
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("long"), F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int"))
    rows = li.select("source_file", "chunk_id", key.alias("node_id"), F.col("l_returnflag").alias("node_type"), "l_linestatus", "l_quantity", "l_shipdate", F.col("l_discount").alias("confidence"), (F.col("l_linenumber") % 3).alias("section"))
    attrs = F.create_map(F.lit("status"), F.col("l_linestatus"), F.lit("qty"), F.when(F.col("l_quantity") >= 10, F.col("l_quantity").cast("int").cast("string")).otherwise(""), F.lit("day"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = rows.dropDuplicates([by, "node_id"]).select("source_file", "chunk_id", "node_id", "node_type", attrs.alias("attributes"), "confidence", F.col("node_id").alias("ord"), "section")
    return rows.withColumn("merge_key", M.merge_key(F.col("node_type"), F.create_map(F.lit("status"), F.col("attributes")["status"], F.lit("qty"), F.col("attributes")["qty"])))


_N = """n AS (SELECT DISTINCT ON (node_id) * FROM (SELECT 'f' || (l_orderkey // 40) AS source_file, l_orderkey AS chunk_id,
concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::INT, round(l_tax * 100)::INT) AS node_id,
l_returnflag AS node_type, l_linestatus AS status, CASE WHEN l_quantity >= 10 THEN l_quantity::INT::VARCHAR ELSE '' END AS qty, strftime(l_shipdate, '%Y-%m-%d') AS day,
l_discount AS confidence, l_linenumber % 3 AS section, l_returnflag || CASE WHEN l_quantity >= 10 THEN '|qty:' || l_quantity::INT ELSE '' END || '|status:' || l_linestatus AS merge_key FROM lineitem)
)"""


def _flat(df, *more):
    a = F.col("attributes")
    return df.select("source_file", "node_type", a["status"].alias("status"), a["qty"].alias("qty"), a["day"].alias("day"), *more)


@query(f"WITH {_N} SELECT node_id, merge_key FROM n")
def merge_key(spark, d):
    return nodes(spark, d).select("node_id", "merge_key")


@query(f"WITH {_N} SELECT chunk_id, merge_key, node_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, merge_key ORDER BY confidence DESC, node_id) AS rn FROM n) WHERE rn = 1")
def dedup_nodes(spark, d):
    return M.dedup_nodes(nodes(spark, d, "chunk_id")).select("chunk_id", "merge_key", "node_id")


@query("""SELECT chunk_id, head, relation_type, tail, confidence FROM (SELECT l_orderkey % 100 AS chunk_id, 'o' || l_orderkey AS head, 'SUPPLIED_BY' AS relation_type, 's' || l_suppkey AS tail, max(l_discount) AS confidence FROM lineitem GROUP BY ALL)""")
def dedup_edges(spark, d):
    e = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("chunk_id"), F.concat(F.lit("o"), "l_orderkey").alias("head"), F.lit("SUPPLIED_BY").alias("relation_type"), F.concat(F.lit("s"), "l_suppkey").alias("tail"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("ord"))
    return M.dedup_edges(e).drop("ord")


@query(f"WITH {_N} SELECT merge_key, min(node_id) AS node_id, arg_min(day, node_id) AS day, max(confidence) AS confidence, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_ids, arg_min(chunk_id, node_id) AS first_chunk FROM n GROUP BY 1")
def merge_global(spark, d):
    m = M.merge_global(nodes(spark, d, "chunk_id"))
    return m.select("merge_key", "node_id", F.col("attributes")["day"].alias("day"), "confidence", F.size("source_chunks").cast("long").alias("n_chunks"), F.size("all_node_ids").cast("long").alias("n_ids"), F.get("source_chunks", F.lit(0)).alias("first_chunk"))


@query(f"WITH {_N} SELECT node_type, day, min(node_id) AS kept_id, count(*) AS n, string_agg(node_id, '|' ORDER BY node_id) AS node_ids FROM n GROUP BY ALL HAVING count(*) > 1")
def dedup_by_property(spark, d):
    found = M.dedup_by_property(nodes(spark, d).withColumn("day", F.col("attributes")["day"]), "day")
    return found.withColumn("node_ids", F.array_join("node_ids", "|"))


@query(f"WITH {_N} SELECT merge_key, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1")
def dup_order(spark, d):
    return X.dup_order(nodes(spark, d).groupBy("merge_key").agg(F.count("*").alias("n")), "merge_key")


@query(f"WITH {_N} SELECT source_file, node_type, string_agg(DISTINCT status, '；' ORDER BY status) AS status, string_agg(DISTINCT qty, '；' ORDER BY qty) FILTER (qty <> '') AS qty, string_agg(DISTINCT day, '；' ORDER BY day) AS day FROM n GROUP BY ALL")
def agg_merge_descriptions(spark, d):
    return _flat(M.agg_merge_descriptions(nodes(spark, d)))


@query(f"WITH {_N} SELECT source_file, node_type, arg_min(status, node_id) AS status, arg_min(qty, node_id) AS qty, arg_min(day, node_id) AS day FROM n GROUP BY ALL")
def agg_merge_attributes(spark, d):
    return _flat(M.agg_merge_attributes(nodes(spark, d)))


@query(f"WITH {_N} SELECT source_file, node_type, arg_min(node_id, day || node_id) AS node_id, min(day) AS day FROM n GROUP BY ALL")
def agg_select_earliest(spark, d):
    return M.agg_select_earliest(nodes(spark, d), "day").select("source_file", "node_type", "node_id", F.col("attributes")["day"].alias("day"))


_MODE = "(SELECT source_file, node_type, arg_min({0}, ({1}, o)) AS {0} FROM (SELECT source_file, node_type, {0}, -count(*) AS c, min(node_id) AS o FROM n GROUP BY ALL) GROUP BY ALL)"


@query(f"""WITH {_N} SELECT source_file, node_type, status, qty, day, CASE WHEN c = 1 THEN m ELSE 0.9 END AS confidence FROM {_MODE.format("status", "c")} JOIN {_MODE.format("qty", "c")} USING (source_file, node_type)
JOIN {_MODE.format("day", "c")} USING (source_file, node_type) JOIN (SELECT source_file, node_type, count(*) AS c, max(confidence) AS m FROM n GROUP BY ALL) USING (source_file, node_type)""")
def agg_select_most_common(spark, d):
    return _flat(M.agg_select_most_common(nodes(spark, d)), "confidence")


@query(f"WITH {_N} SELECT source_file, node_type, arg_min(status, node_id) AS status, arg_min(qty, node_id) FILTER (qty <> '') AS qty, arg_min(day, node_id) AS day, 0.85::DOUBLE AS confidence FROM n GROUP BY ALL")
def agg_create_single(spark, d):
    return _flat(M.agg_create_single(nodes(spark, d)), "confidence")


@query(f"WITH {_N} SELECT source_file, node_type, status, qty, day, count(DISTINCT chunk_id) AS n_chunks FROM n GROUP BY ALL")
def agg_merge_unique(spark, d):
    return _flat(M.agg_merge_unique(nodes(spark, d)), F.size("source_chunks").cast("long").alias("n_chunks"))


@query(f"WITH {_N} SELECT node_id, node_type || '|day:' || day || CASE WHEN qty <> '' THEN '|qty:' || qty ELSE '' END || '|status:' || status AS merge_key FROM n")
def agg_merge_all(spark, d):
    return M.agg_merge_all(nodes(spark, d)).select("node_id", "merge_key")


@query(f"""WITH {_N} SELECT source_file, node_type, arg_min(status, node_id) AS status, arg_min(qty, node_id) FILTER (node_type <> 'A' OR qty <> '') AS qty, arg_min(day, node_id) AS day FROM n WHERE node_type <> 'R' GROUP BY ALL
UNION ALL SELECT source_file, node_type, status, qty, day FROM n WHERE node_type = 'R'""")
def aggregate_documents(spark, d):
    return _flat(M.aggregate_documents(nodes(spark, d), {"N": "merge_attributes", "A": "create_single"}, "day"))


@query(f"WITH {_N} SELECT source_file, node_type, arg_min(status, node_id) AS status, arg_min(qty, node_id) AS qty, arg_min(day, node_id) AS day, arg_min(node_id, (-confidence, node_id)) AS node_id FROM n GROUP BY ALL")
def merge_change_nodes(spark, d):
    return _flat(M.merge_change_nodes(nodes(spark, d)), "node_id")


@query(f"WITH {_N} SELECT source_file, node_type, string_agg(DISTINCT day, '；' ORDER BY day) AS text, array_to_string(list_sort(list_distinct(flatten([list(qty), list(status)]))), '|') AS keywords FROM n GROUP BY ALL")
def merge_response_nodes(spark, d):
    a = F.col("attributes")
    merged = M.merge_response_nodes(nodes(spark, d).select("source_file", "node_type", a["day"].alias("text"), F.array(a["qty"], a["status"]).alias("keywords")))
    return merged.withColumn("keywords", F.array_join("keywords", "|"))


@query(f"WITH {_N} SELECT source_file, node_type, arg_min(node_id, (-section, node_id)) AS node_id, max(section) AS section FROM n GROUP BY ALL")
def keep_last_section(spark, d):
    return M.keep_last_section(nodes(spark, d))


def _corpus(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("ord"), "text")
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


_C = "c AS (SELECT doc_id, text, quality AS label FROM documents JOIN labels USING (doc_id)), u AS (SELECT text, min(doc_id) AS doc_id, arg_min(label, doc_id) AS label, count(DISTINCT label) > 1 AS conflict FROM c GROUP BY 1)"


@query(f"WITH {_C} SELECT doc_id AS ord, label, conflict FROM u")
def corpus_dedup(spark, d):
    return C.corpus_dedup(_corpus(spark, d)).select("ord", "label", "conflict")


@query(f"WITH {_C} SELECT doc_id AS ord, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(text || 's1'), text) AS rn FROM u) WHERE rn <= 40")
def corpus_balance(spark, d):
    return C.corpus_balance(C.corpus_dedup(_corpus(spark, d)), 40, "s1").select("ord", "label")


_S = f"""{_C}, w AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(text || 's2'), text) AS rn, count(*) OVER (PARTITION BY label) AS n FROM u),
x AS (SELECT doc_id AS ord, label, text, CASE WHEN rn <= round_even(n * 0.6::DOUBLE, 0) THEN 'train' WHEN rn <= round_even(n * 0.6::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM w)"""


def _split(spark, d):
    return C.stratified_split(C.corpus_dedup(_corpus(spark, d)), "s2")


@query(f"WITH {_S} SELECT ord, label, split FROM x")
def stratified_split(spark, d):
    return _split(spark, d).select("ord", "label", "split")


@query(f"""WITH {_C}, y AS (SELECT text, CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM documents)
SELECT md5(text) AS text_md5, string_agg(DISTINCT split, '|' ORDER BY split) AS splits FROM y GROUP BY text HAVING count(DISTINCT split) > 1""")
def leakage_check(spark, d):
    r = F.col("doc_id") % 10
    docs = table(spark, d, "documents").select("text", F.when(r < 6, "train").when(r < 8, "val").otherwise("test").alias("split"))
    return C.leakage_check(docs).select(F.md5("text").alias("text_md5"), F.array_join("splits", "|").alias("splits"))


@query(f"WITH {_S} SELECT split, label, count(*) AS n FROM x GROUP BY ROLLUP (split, label)")
def split_report(spark, d):
    return C.split_report(_split(spark, d))


@query(rf"WITH {_S} SELECT split, label, count(*) AS n, sum(length(regexp_replace(text, '[\r\n]+', ' ', 'g')))::BIGINT AS n_chars FROM x GROUP BY ALL")
def sink_training_split(spark, d):
    path = scratch_path(spark, "split")
    sink(_split(spark, d), path)
    lines = spark.read.text(path)
    rows, _ = C.scan_labeled_lines(lines, ["split"])
    return rows.groupBy("split", "label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("""WITH t AS (SELECT quality = 1 AS y, length(text) > 600 AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (y AND p)::BIGINT AS tp, count(*) FILTER (NOT y AND p)::BIGINT AS fp, count(*) FILTER (y AND NOT p)::BIGINT AS fn, count(*) FILTER (NOT y AND NOT p)::BIGINT AS tn FROM t)
SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c""")
def confusion_metrics(spark, d):
    return C.confusion_metrics(_corpus(spark, d).select("label", (F.length("text") > 600).cast("int").alias("predicted")))


@query("SELECT count(*) AS n, sum(quality)::BIGINT AS total FROM labels")
def scan_labeled_corpus(spark, d):
    lines = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.concat_ws(" ", "text", "quality").alias("value"))
    rows, _ = C.scan_labeled_lines(lines)
    return rows.agg(F.count("*").alias("n"), F.sum("label").alias("total"))


@query("""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM documents) SELECT term, 'W' AS tag, count(*) AS n FROM w GROUP BY 1""")
def lexicon_from_labels(spark, d):
    """Letters are tagged as runs: a letter after a letter goes on, any other begins a term."""
    rows = table(spark, d, "documents").select("doc_id", F.split("text", "").alias("chars"))
    letter = lambda c: c.between("A", "Z") | c.between("a", "z")
    tags = F.transform("chars", lambda c, i: F.when(letter(c), F.when((i > 0) & letter(F.get(F.col("chars"), F.greatest(i - 1, F.lit(0)))), "I-W").otherwise("B-W")).otherwise("O"))
    return C.lexicon_from_labels(rows.withColumn("labels", tags))


@query("""WITH t AS (SELECT length(text) AS n, CASE WHEN doc_id % 11 = 0 THEN 'not json' WHEN coalesce(text, '') = '' THEN 'no text' WHEN doc_id % 7 = 0 THEN 'no labels' END AS reason FROM documents)
SELECT coalesce(reason, 'ok') AS part, count(*) AS n, (sum(least(n, 98)) FILTER (reason IS NULL))::BIGINT AS n_chars FROM t GROUP BY 1""")
def prepare_tag_corpus(spark, d):
    """Every document as a line; some have no labels, some are no JSON."""
    labels = F.when(F.col("doc_id") % 7 != 0, F.array_repeat(F.lit("X"), F.length("text")))
    line = F.when(F.col("doc_id") % 11 == 0, F.lit("{no json")).otherwise(F.to_json(F.struct("text", labels.alias("labels"))))
    ok, bad = C.prepare_tag_corpus(table(spark, d, "documents").select(line.alias("value")), ["B-W"], 100)
    return ok.agg(F.count("*").alias("n"), F.sum(F.size("chars")).alias("n_chars")).select(F.lit("ok").alias("part"), "n", "n_chars").where("n > 0").union(bad.select("reason", "n", F.lit(None).cast("long")))


@query("""WITH t AS (SELECT l_discount * 10 AS a, 1 - l_discount * 10 AS b, l_tax * 10 AS k, (l_quantity / 50) AS s FROM lineitem)
SELECT round(avg(1 - (a * k + b * s) - 0.05::DOUBLE * (a * ln(greatest(a, 1e-12)) + b * ln(greatest(b, 1e-12)))), 6) AS loss FROM t""")
def fusion_loss(spark, d):
    a = F.col("l_discount") * 10
    t = table(spark, d, "lineitem").select(a.alias("alpha"), (1 - a).alias("beta"), (F.col("l_tax") * 10).alias("key_score"), (F.col("l_quantity") / 50).alias("semantic"))
    return C.fusion_loss(t).select(F.round("loss", 6).alias("loss"))
