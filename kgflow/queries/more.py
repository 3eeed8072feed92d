"""Queries for slots, ids, embeddings, set operations and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgflow.functions import text as T
from kgflow.operators import embed as E
from kgflow.operators import extractors as N
from kgflow.operators import merge as M
from kgflow.operators import records as R
from kgflow.operators import segment as G
from kgflow.operators import sets as X
from kgflow.plans import search as V
from kgflow.queries import misc
from kgflow.queries.graph import position_text, table
from kgflow.sources.manifest import claim_numbers
from kgflow.sources.scratch import scratch_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'DK' || (o_orderkey // 1000) || '+' || (o_orderkey % 1000) || '~DK' || ((o_orderkey + o_custkey % 50) // 1000) || '+' || ((o_orderkey + o_custkey % 50) % 1000) END AS position,
CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'main' END AS line, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' END AS category FROM orders""")
def extract_slots(spark, d):
    where = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(position_text())
    side = F.when(F.col("o_orderkey") % 2 == 0, "left").otherwise("")
    word = F.when(F.col("o_orderstatus") == "F", "order is finished").when(F.col("o_orderstatus") == "O", "order").otherwise("nothing")
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", F.lit("at"), where, side, word).alias("text"))
    return o.select("o_orderkey", T.extract_slots(F.col("text"), {"order": "open", "order is finished": "closed"}, ["left", "right"], "main").alias("s")).select("o_orderkey", "s.*")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount >= 0.06 AS flag FROM lineitem")
def threshold_flag(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.threshold_flag(F.col("l_discount"), 0.06).alias("flag"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS level FROM customer")
def filter_assessment_by_type(spark, d):
    c = table(spark, d, "customer")
    items = F.to_json(F.array(F.struct(F.lit("x").alias("type"), F.lit("no").alias("level")), F.struct(F.lit("k0").alias("type"), F.col("c_name").alias("level"))))
    return c.select("c_custkey", T.filter_assessment_by_type(items, F.concat(F.lit("k"), F.col("c_nationkey") % 2), "type")["level"].alias("level"))


@query("""WITH n AS (SELECT doc_id, lang = 'en' AS first, sha256(doc_id || chr(31) || text) AS id FROM documents),
c AS (SELECT doc_id, 999000 + row_number() OVER (ORDER BY NOT first, id) AS number FROM n) SELECT doc_id, number, 'chunk_' || printf('%06d', number) AS label FROM c""")
def number_chunks(spark, d):
    """English texts in one run, the others in the next, after 999,000 numbers that earlier runs took."""
    ledger = scratch_path(spark, "numbers")
    claim_numbers(spark, ledger, 999_000)
    rows = table(spark, d, "documents").select("doc_id", "lang", E.content_id(F.col("doc_id").cast("string"), F.col("text")).alias("id"))
    english = F.col("lang").eqNullSafe("en")
    return E.number_rows(rows.where(english), "id", "chunk_", ledger).union(E.number_rows(rows.where(~english), "id", "chunk_", ledger)).drop("id", "lang")


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents), c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 6))::INT % 32 AS dim, count(*) AS n FROM w GROUP BY ALL)
SELECT d.doc_id AS node_id, coalesce(round(max(n) / sqrt(sum(n * n)), 6), 0) AS top, count(n) AS used, any_value(lang) IS DISTINCT FROM 'en' AS later FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1""")
def embed_table(spark, d):
    """English texts first; a second run over all, by the ledger of the first, embeds the rest."""
    rows, path = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text", "lang"), scratch_path(spark, "embedded")
    none = spark.createDataFrame([], "node_id long, stage string, status string")
    E.embed_table(rows.where("lang = 'en'"), none, "text").write.parquet(path)
    first = spark.read.parquet(path)
    rest = E.embed_table(rows, first.select("node_id", F.lit("embed").alias("stage"), F.lit("done").alias("status")), "text")
    both = first.withColumn("later", F.lit(False)).union(rest.withColumn("later", F.lit(True)))
    return both.select("node_id", F.round(F.array_max("embedding"), 6).alias("top"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("used"), "later")


def _counting_model():
    """A model that gives three counts of a text, cannot take '!!', and gives too little for licenses."""

    def model(texts):
        if any("!!" in t for t in texts):
            raise ValueError("noise")
        return [[len(t), t.count(" "), t.count("e")][: 2 if "License" in t else 3] for t in texts]

    return model


@query("""SELECT doc_id AS node_id, CASE WHEN coalesce(text, '') = '' THEN 'no text' WHEN contains(text, '!!') THEN 'ValueError: noise' WHEN contains(text, 'License') THEN '2 numbers instead of 3' END AS reason,
CASE WHEN coalesce(text, '') <> '' AND NOT contains(text, '!!') AND NOT contains(text, 'License') THEN 1000000.0 * length(text) + 1000 * (length(text) - length(replace(text, ' ', ''))) + length(text) - length(replace(text, 'e', '')) END::DOUBLE AS told FROM documents""")
def embed_batches(spark, d):
    """A model of Python over all documents, in batches; texts that it cannot take are told."""
    none = spark.createDataFrame([], "node_id long, stage string, status string")
    ok, bad = E.embed_batches(table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text"), none, "text", _counting_model, 3)
    told = F.get("embedding", F.lit(0)) * 1000000 + F.get("embedding", F.lit(1)) * 1000 + F.get("embedding", F.lit(2))
    return ok.select("node_id", F.lit(None).cast("string").alias("reason"), told.alias("told")).union(bad.select("node_id", "reason", F.lit(None).cast("double")))


def _mail_extractor():
    import re

    mail = re.compile(_MAIL)
    return lambda text, metadata: [("contact", {"mail": m, "lang": metadata.get("lang")}) for m in mail.findall(text)]


class _Terms:
    """Remembers the longest words of a source, which the texts of its documents brought first."""

    def __init__(self):
        self.seen, self.longest = 0, ""

    def __call__(self, text, metadata):
        self.seen += 1
        self.longest = max([self.longest, *text.split(" ")], key=lambda w: len(w.encode()))
        return ()

    def finish(self):
        yield "source", {"n": self.seen, "longest": len(self.longest.encode())}


@query(r"""SELECT doc_id AS chunk_id, 'contact' AS node_type, unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+')) AS mail, lang FROM documents""")
def user_extractor(spark, d):
    """A user's Python, which expands each text to rows, beside the other routes of extraction."""
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("text").alias("document_type"), F.lit("text").alias("file_type"), "text", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    nodes, _ = R.extract_chunks(chunks, {}, {}, extractors={"text": _mail_extractor})
    return nodes.select("chunk_id", "node_type", F.col("attributes")["mail"].alias("mail"), F.col("attributes")["lang"].alias("lang"))


@query("""WITH w AS (SELECT source, doc_id, max(strlen(w)) AS n FROM (SELECT source, doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1, 2)
SELECT source AS source_file, count(*) AS n, max(n) AS longest FROM w GROUP BY 1""")
def user_document_extractor(spark, d):
    """A user's Python that reads the documents of a source in order and tells of all at the end."""
    chunks = table(spark, d, "documents").select(F.col("source").alias("source_file"), "doc_id", "text", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    found = N.extract_by_document(chunks, _Terms, "doc_id")
    return found.select("source_file", F.col("attributes")["n"].cast("long").alias("n"), F.col("attributes")["longest"].cast("long").alias("longest"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END, ''), CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END, 'q') AS text FROM customer")
def lexicon_fallback(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", V.lexicon_fallback(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(""), F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")), F.lit("q")).alias("text"))


@query(f"WITH {misc._COS}, {misc._GATE}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY alpha * similarity + (1 - alpha) * key_score DESC, node_id) AS r FROM w)"
       " SELECT query_id, count(*) AS n, string_agg('v' || node_id, '|' ORDER BY r) AS names FROM f WHERE r <= 4 GROUP BY 1")  # fmt: skip
def recommend(spark, d):
    v = misc._vectors(spark, d)
    found = V.hybrid_search(misc._queries(spark, d), v, "category", misc._HIDDEN, misc._OUT, 0.1)
    r = V.recommend(found, v.select("node_id", F.concat(F.lit("v"), "node_id").alias("name")))
    return r.select("query_id", F.size("results").cast("long").alias("n"), F.array_join(F.transform("results", lambda x: x["name"]), "|").alias("names"))


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 63 ELSE 64 END AS n, vec_id % 5 <> 0 AND vec_id % 7 <> 0 AS ok FROM embeddings WHERE vec_id % 7 <> 0
UNION ALL SELECT vec_id, NULL, false FROM embeddings WHERE vec_id % 7 = 0""")
def check_vectors(spark, d):
    """Vectors of another length, and missing ones, are told apart."""
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))).alias("v"))
    ok, bad = V.check_vectors(e, "v", 64)
    return ok.select("vec_id", F.size("v").alias("n"), F.lit(True).alias("ok")).union(bad.select("vec_id", F.when(F.col("v").isNotNull(), F.size("v")), F.lit(False)))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders""")
def parse_date(spark, d):
    """Dates in texts, in both forms; a thirteenth month is none."""
    y, m, day = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    worded, dashed = F.concat(F.lit("recorded on "), y, F.lit("年"), m, F.lit("月"), day, F.lit("日")), F.concat(y, F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), day, F.lit(" 10:00"))
    text = F.when(F.col("o_orderkey") % 4 == 3, F.concat(y, F.lit("-13-"), day)).when(F.col("o_orderkey") % 2 == 0, worded).otherwise(dashed)
    return table(spark, d, "orders").select("o_orderkey", M.parse_date(text).alias("day"))


@query("""SELECT o_orderkey AS chunk_id, 'order' AS node_type, o_orderstatus AS value FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT o_orderkey, 'key', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 6 IN (1, 4)
UNION ALL SELECT o_orderkey, 'site', 'tunnel' FROM orders WHERE o_orderkey % 6 = 1 UNION ALL SELECT o_orderkey, 'answer', o_orderstatus FROM orders WHERE o_orderkey % 6 = 3 UNION ALL SELECT o_orderkey, 'rejected', 'no extractor' FROM orders WHERE o_orderkey % 6 IN (2, 5)""")
def extract_chunks(spark, d):
    """Records, texts with patterns and a lexicon, sections by pattern, responses, a section without a route, and a type without any."""
    kind = F.col("chunk_id") % 6
    recs = misc.records(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_orderstatus"), "chunk_id")
    text = F.when(kind == 0, F.col("json")).otherwise(F.concat(F.lit("number "), "chunk_id", F.when(kind == 1, " of a tunnel").otherwise("")))
    section = F.when(kind == 4, "1").when(kind == 5, "2")
    metadata = F.when(section.isNull(), F.col("metadata")).otherwise(F.create_map(F.lit("section_id"), section))
    doc_type = F.when(kind == 0, "rec").when(kind == 1, "txt").when(kind == 2, "odd").when(kind == 3, "model").otherwise("titled")
    chunks = recs.select("chunk_id", doc_type.alias("document_type"), F.when(kind == 0, "json").otherwise("text").alias("file_type"), text.alias("text"), metadata.alias("metadata"))
    responses = recs.select("chunk_id", F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("value")).alias("attributes"))).alias("response"))
    nodes, rejects = R.extract_chunks(
        chunks, {"rec": [R.NodeMapping("order", {"value": "head.status"})]}, {"txt": [("key", "value", r"\d+")], "titled": [("key", "value", r"\d+")]},
        {"txt": ("site", ["tunnel", "bridge"])}, responses, {"model": ["answer"]}, {("titled", "1"): "regex", ("titled", "2"): "none"},
    )
    value = F.coalesce(F.col("attributes")["value"], F.col("attributes")["term"])
    return nodes.select("chunk_id", "node_type", value.alias("value")).union(rejects.select("chunk_id", F.lit("rejected"), "reason"))


_MAIL = r"[a-z0-9.]+@[a-z0-9.]+"


@query(rf"""SELECT doc_id, 'contact' AS node_type, unnest(regexp_extract_all(text, '{_MAIL}')) AS value, NULL AS keyword FROM documents
UNION ALL SELECT doc_id, 'license', NULL, 'License' FROM documents WHERE contains(text, 'License')""")
def union_extractions(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    mails = G.regex_extract_nodes(t, [("contact", "mail", _MAIL)]).select("doc_id", "node_type", "value")
    return X.union_extractions(mails, G.keyword_nodes(t, spark.createDataFrame([("license", "License")], "node_type string, keyword string")))


@query("SELECT md5(text) AS h FROM (SELECT text FROM documents JOIN labels USING (doc_id) INTERSECT SELECT text FROM documents ANTI JOIN labels USING (doc_id))")
def intersect_texts(spark, d):
    t, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return X.intersect_texts(t.join(labels, "doc_id", "left_semi"), t.join(labels, "doc_id", "left_anti")).select(F.md5("text").alias("h"))


@query("SELECT 'f' || c_custkey AS source_file FROM customer EXCEPT SELECT 'f' || o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_processed(spark, d):
    items = table(spark, d, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("source_file"))
    done = F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed")
    ledger = table(spark, d, "orders").select(F.concat(F.lit("f"), "o_custkey").alias("source_file"), F.lit("extract").alias("stage"), done.alias("status"))
    return X.except_processed(items, ledger, "source_file", "extract")


@query("SELECT lang, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM documents GROUP BY 1")
def distinct_values(spark, d):
    return X.distinct_values(table(spark, d, "documents"), ["lang"], "source").select("lang", F.array_join("values", "|").alias("sources"))
