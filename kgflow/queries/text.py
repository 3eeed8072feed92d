"""Queries for segmentation, classification and lexicon tagging over the documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgflow.functions import text as T
from kgflow.operators import lexicon as L
from kgflow.operators import segment as S
from kgflow.queries.graph import table
from kgflow.sources.scratch import scratch_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _lines(spark, d):
    """Documents as pages: every line feed begins a page."""
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "text"))


@query(r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '([^。！？.!?]+|[。！？.!?]+)')) AS s FROM documents), t AS (SELECT doc_id, regexp_replace(s, '^[\s]+|[\s]+$', '', 'g') AS s FROM s)
SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS n_chars FROM t WHERE s <> '' GROUP BY 1""")
def split_sentences(spark, d):
    rows = docs(spark, d).select("doc_id", F.explode(T.split_sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("n_chars"))


def _chunk_sql(source: str, keys: str) -> str:
    """Tables that fold the sentences of source(keys, text) into chunks: c has (keys, i, text, a, b) of each."""
    by = " AND ".join(f"f.{k} = s.{k}" for k in keys.split(", "))
    return rf"""RECURSIVE u AS (SELECT {keys}, unnest(regexp_extract_all(text, '([^。！？.!?]+|[。！？.!?]+)')) AS s, generate_subscripts(regexp_extract_all(text, '([^。！？.!?]+|[。！？.!?]+)'), 1) AS j FROM {source}),
s AS (SELECT {keys}, s, length(s)::BIGINT AS n, row_number() OVER (PARTITION BY {keys} ORDER BY j) AS i, count(*) OVER (PARTITION BY {keys}) AS total FROM (SELECT {keys}, j, regexp_replace(s, '^[\s]+|[\s]+$', '', 'g') AS s FROM u) WHERE s <> ''),
f AS (SELECT {keys}, 1::BIGINT AS i, total, s AS cur, n + 1 AS len, 0::BIGINT AS start, NULL::VARCHAR AS text, NULL::BIGINT AS a, NULL::BIGINT AS b FROM s WHERE i = 1 UNION ALL
SELECT {", ".join("s." + k for k in keys.split(", "))}, s.i, s.total, CASE WHEN f.len + n > 2000 THEN right(cur, 200) || ' ' || s ELSE cur || ' ' || s END, CASE WHEN f.len + n > 2000 THEN least(length(cur), 200) + 1 + n ELSE f.len + n + 1 END,
CASE WHEN f.len + n > 2000 THEN start + CASE WHEN f.len > 200 THEN f.len - 200 ELSE start END ELSE start END,
CASE WHEN f.len + n > 2000 THEN regexp_replace(cur, '^[\s]+|[\s]+$', '', 'g') END, start, start + f.len FROM f JOIN s ON {by} AND s.i = f.i + 1),
c AS (SELECT {keys}, i, text, a, b FROM f WHERE text IS NOT NULL UNION ALL SELECT {keys}, i + 1, regexp_replace(cur, '^[\s]+|[\s]+$', '', 'g'), start, start + len FROM f WHERE i = total)"""


@query(f"WITH {_chunk_sql('documents', 'doc_id')} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, text, a AS char_start, b AS char_end FROM c")
def chunk_text(spark, d):
    return S.chunk_documents(docs(spark, d), 2000, 200)


_PAGES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page_no FROM documents)"


@query(f"""WITH {_chunk_sql(_PAGES, 'doc_id, page_no')} SELECT doc_id, page_no, (row_number() OVER w - 1)::INT AS chunk_index, text, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start,
sum(length(text)) OVER w::BIGINT AS char_end FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, i)""")
def chunk_pages(spark, d):
    return S.chunk_pages(_lines(spark, d), 2000, 200)


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS text_md5, count(*) AS n_pages FROM p WHERE length(trim(t)) > 0 GROUP BY 1""")
def scan_pages(spark, d):
    return S.scan_pages(_lines(spark, d)).select("doc_id", F.md5("text").alias("text_md5"), "n_pages")


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def scan_html_pages(spark, d):
    return table(spark, d, "pages").select("page_id", T.visible_text(F.col("html")).alias("text"))


_TITLES = {"1": "The ", "2": "And ", "3": "In "}
_CLEAN = r"trim(regexp_replace(regexp_replace(text, '[．、]', '.', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT doc_id, {_CLEAN} AS t FROM documents), m AS (SELECT doc_id, t, id, strpos(t, w) AS pos FROM c, (VALUES ('1', 'The '), ('2', 'And '), ('3', 'In ')) v(id, w) WHERE contains(t, w)),
f AS (SELECT doc_id, min(pos) AS first FROM m GROUP BY 1), a AS (SELECT doc_id, t, id, pos FROM m UNION ALL SELECT c.doc_id, t, CASE WHEN first IS NOT NULL THEN '0' END, 1 FROM c LEFT JOIN f ON c.doc_id = f.doc_id WHERE coalesce(first, 2) > 1)
SELECT doc_id, id AS section_id, md5(trim(substr(t, pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(t) + 1) - pos))) AS text_md5 FROM a""")
def segment_by_titles(spark, d):
    return S.segment_by_titles(docs(spark, d), _TITLES).select("doc_id", "section_id", F.md5("text").alias("text_md5"))


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, md5(string_agg('[' || i || '] ' || t, chr(10) ORDER BY i)) AS text_md5 FROM p GROUP BY 1""")
def merge_section_text(spark, d):
    return S.merge_section_text(_lines(spark, d).withColumnRenamed("page_no", "section_id")).select("doc_id", F.md5("text").alias("text_md5"))


_MAIL, _PHONE = r"[a-z0-9.]+@[a-z0-9.]+", r"\d{3}-\d{4}"


@query(rf"""SELECT doc_id, 'contact' AS node_type, 'mail' AS attribute, unnest(regexp_extract_all(text, '{_MAIL}')) AS value FROM documents
UNION ALL SELECT doc_id, 'contact', 'phone', unnest(regexp_extract_all(text, '{_PHONE}')) FROM documents""")
def regex_extract_nodes(spark, d):
    return S.regex_extract_nodes(docs(spark, d), [("contact", "mail", _MAIL), ("contact", "phone", _PHONE)]).select("doc_id", "node_type", "attribute", "value")


@query(rf"SELECT doc_id, nullif(regexp_extract(text, '{_MAIL}'), '') AS value FROM documents")
def extract_first(spark, d):
    return S.extract_first(docs(spark, d), _MAIL)


@query("SELECT doc_id, 'license' AS node_type, k AS keyword FROM documents, (SELECT unnest(['MIT License', 'Apache License', 'GNU']) AS k) WHERE contains(text, k)")
def keyword_nodes(spark, d):
    return S.keyword_nodes(docs(spark, d), spark.createDataFrame([("license", k) for k in ("MIT License", "Apache License", "GNU")], "node_type string, keyword string"))


@query("SELECT doc_id, CASE WHEN contains(text, 'License') OR contains(text, 'licensed') THEN 'licensed' WHEN contains(text, '!!') OR contains(text, '***') THEN 'junk' ELSE 'unknown' END AS class FROM documents")
def classify_by_content(spark, d):
    return docs(spark, d).select("doc_id", T.classify_by_content(F.col("text"), [("licensed", ["License", "licensed"]), ("junk", ["!!", "***"])]).alias("class"))


@query(r"""WITH p AS (SELECT page_id, '/' || regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), q AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT page_id, CASE WHEN list_contains(parts[:-2], 'fr') THEN 'fr_' || CASE WHEN list_position(parts, 'fr') + 1 < len(parts) AND parts[list_position(parts, 'fr') + 1] IN ('1', '2') THEN parts[list_position(parts, 'fr') + 1] ELSE 'any' END
WHEN list_contains(parts[:-2], 'en') THEN 'english' WHEN list_contains(parts[:-2], 'de') THEN 'german' ELSE 'unknown' END AS class,
nullif(regexp_extract(path, '(?:^|/)fr/([^/]+)/', 1), '') AS method FROM q""")
def classify_by_path(spark, d):
    path = F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, d, "pages").select("page_id", T.classify_by_path(path, {"en": "english", "de": "german"}, "fr", ["1", "2"], "any").alias("class"), T.method_from_path(path, "fr").alias("method"))


@query("SELECT doc_id, lang || ' ' || source || ' a b' AS text FROM documents")
def node_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.node_text([F.col("lang"), F.col("source")], [F.array(F.lit("a"), F.lit("b"))]).alias("text"))


ROOTS = ("tionthe", "anthe", "ofthe", "inthe", "erand", "thetion", "anthetion")
ATTRS = ("ofer", "onthe", "edthe", "ingthe", "isthe")
_ROOTS_SQL, _ATTRS_SQL = (f"(SELECT unnest({list(x)}) AS term)" for x in (ROOTS, ATTRS))
_TEXT = r"x AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents)"


def _match_sql(terms: str, lengths) -> str:
    return f"(SELECT DISTINCT doc_id, i AS s, i + length(term) AS e, term FROM (SELECT doc_id, i, substr(t, i + 1, n) AS w FROM (SELECT doc_id, t, unnest(range(length(t))) AS i FROM x), (SELECT unnest({lengths}) AS n)) JOIN {terms} ON w = term)"


def _walk_sql(name: str) -> str:
    return f"""{name}_l AS (SELECT doc_id, s, max(e) AS e, arg_max(term, e) AS term FROM {name}_m GROUP BY 1, 2), {name}_n AS (SELECT a.*, b.s AS nxt FROM {name}_l a ASOF LEFT JOIN {name}_l b ON a.doc_id = b.doc_id AND b.s >= a.e),
{name} AS (SELECT n.* FROM {name}_n n JOIN (SELECT doc_id, min(s) AS s FROM {name}_n GROUP BY 1) f USING (doc_id, s) UNION ALL SELECT n.* FROM {name} k JOIN {name}_n n ON n.doc_id = k.doc_id AND n.s = k.nxt)"""


def _lengths(terms):
    return sorted({len(t) for t in terms})


def _hits(spark, d, terms):
    lex = spark.createDataFrame([(t,) for t in terms], "term string")
    return L.lexicon_match(L.normalise(docs(spark, d)), lex)


@query(f"WITH {_TEXT} SELECT doc_id, s AS start, e AS \"end\", term FROM {_match_sql(_ROOTS_SQL, _lengths(ROOTS))}")
def lexicon_match(spark, d):
    return _hits(spark, d, ROOTS)


_WALK = f"WITH RECURSIVE {_TEXT}, r_m AS {_match_sql(_ROOTS_SQL, _lengths(ROOTS))}, {_walk_sql('r')}"
_BOTH = f"{_WALK}, a_m AS {_match_sql(_ATTRS_SQL, _lengths(ATTRS))}, {_walk_sql('a')}"


@query(f"{_WALK} SELECT doc_id, s AS start, e AS \"end\", term FROM r")
def resolve_overlaps(spark, d):
    return L.resolve_overlaps(_hits(spark, d, ROOTS))


def _stored(spans):
    """Spans as a table, since several steps read them."""
    path = scratch_path(spans.sparkSession, "spans")
    spans.write.parquet(path)
    return spans.sparkSession.read.schema(spans.schema).parquet(path)


def _assigned(spark, d):
    roots, attrs = (_stored(L.resolve_overlaps(_hits(spark, d, terms))) for terms in (ROOTS, ATTRS))
    return roots, L.assign_nearest(roots, attrs, L.normalise(docs(spark, d)))


_SID = "length(regexp_replace(substr(t, 1, floor({})::BIGINT), '[^。！？.!?]', '', 'g'))"
_NEAR = f"""{_BOTH}, p AS (SELECT a.doc_id, a.s, a.e, a.term, (a.s + a.e) / 2 AS c, {_SID.format("(a.s + a.e) / 2")} AS sid FROM a JOIN x USING (doc_id)),
q AS (SELECT r.doc_id, r.s, r.e, (r.s + r.e) / 2 AS c, {_SID.format("r.s")} AS sid FROM r JOIN x USING (doc_id)),
z AS (SELECT p.doc_id, p.s, p.e, p.term, q.s AS root_start, row_number() OVER (PARTITION BY p.doc_id, p.s ORDER BY abs(p.c - q.c), (p.sid <> q.sid)::INT, q.s) AS rn FROM p LEFT JOIN q ON p.doc_id = q.doc_id AND p.c >= q.s - 12 AND p.c <= q.e + 12)"""


@query(f"{_NEAR} SELECT doc_id, s AS start, e AS \"end\", term, root_start FROM z WHERE rn = 1")
def assign_nearest(spark, d):
    return _assigned(spark, d)[1]


@query(f"{_NEAR}, y AS (SELECT doc_id, root_start, s, term, CASE WHEN term = 'ofer' THEN ['joint', 'weathering'] WHEN term = 'onthe' THEN ['strength'] ELSE ['unknown'] END AS cs FROM z WHERE rn = 1 AND root_start IS NOT NULL),"
       " u AS (SELECT doc_id, root_start, unnest(cs) AS category, term, s FROM y), v AS (SELECT doc_id, root_start, category, term, min(s) AS pos FROM u GROUP BY ALL)"
       " SELECT doc_id, root_start, category, string_agg(term, '|' ORDER BY pos) AS terms FROM v GROUP BY ALL")  # fmt: skip
def aggregate_attrs(spark, d):
    cats = spark.createDataFrame([("ofer", ["joint", "weathering"]), ("onthe", ["strength"])], "term string, categories array<string>")
    bags = L.aggregate_attrs(_assigned(spark, d)[1], cats)
    return bags.select("doc_id", "root_start", F.explode("attributes").alias("category", "terms")).withColumn("terms", F.array_join("terms", "|"))


def _phrases(spark, d, roots):
    named = roots.withColumn("category", F.when(F.length("term") > 5, "layer").otherwise("rock"))
    return L.assemble_phrases(named, L.normalise(docs(spark, d)), ["and", "of"], "rock", "layer")


_PHRASES = f"""w_k AS (SELECT r.doc_id, r.s, r.e, r.term, t, {_SID.format("r.s")} AS sid FROM r JOIN x USING (doc_id)),
w_o AS (SELECT *, lead(s) OVER w AS bs, lead(term) OVER w AS bt FROM w_k WHERE length(term) <= 5 WINDOW w AS (PARTITION BY doc_id, sid ORDER BY s)),
w_c AS (SELECT *, substr(t, e + 1, bs - e) AS gap FROM w_o WHERE bs IS NOT NULL), w_d AS (SELECT *, CASE WHEN contains(gap, 'and') THEN 'and' WHEN contains(gap, 'of') THEN 'of' END AS conn FROM w_c),
w_p AS (SELECT DISTINCT ON (doc_id, sid) * FROM w_d WHERE conn IS NOT NULL ORDER BY doc_id, sid, s), w_y AS (SELECT DISTINCT ON (doc_id, sid) doc_id, sid, e AS le, term AS lt FROM w_k WHERE length(term) > 5 ORDER BY doc_id, sid, s),
phrases AS (SELECT p.doc_id, p.sid, CASE WHEN p.s - le BETWEEN 0 AND 6 THEN lt ELSE '' END || p.term || conn || bt AS phrase FROM w_p p LEFT JOIN w_y y ON p.doc_id = y.doc_id AND p.sid = y.sid)"""


@query(f"{_WALK}, {_PHRASES} SELECT * FROM phrases")
def assemble_phrases(spark, d):
    return _phrases(spark, d, _assigned(spark, d)[0])


@query(f"""{_NEAR}, {_PHRASES}, tags AS (SELECT doc_id, [0, sid, 0] AS k, phrase AS tag FROM phrases UNION ALL SELECT doc_id, [1, s, -1], term FROM r
UNION ALL SELECT doc_id, CASE WHEN root_start IS NULL THEN [2, s, 0] ELSE [1, root_start, s] END, term FROM z WHERE rn = 1), once AS (SELECT doc_id, tag, min(k) AS k FROM tags GROUP BY ALL)
SELECT doc_id, string_agg(tag, '|' ORDER BY k) AS tags FROM once GROUP BY 1""")
def render_tags(spark, d):
    roots, assigned = _assigned(spark, d)
    return L.render_tags(_phrases(spark, d, roots), roots, assigned).withColumn("tags", F.array_join("tags", "|"))


@query("SELECT source AS term, min(lang) AS canonical, string_agg(DISTINCT lang, '|' ORDER BY lang) AS categories FROM documents GROUP BY 1")
def scan_lexicon(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("﻿"), "source", F.lit(" ")).alias("term"), "lang", F.col("lang").alias("category"))
    many = L.scan_lexicon(rows.withColumnRenamed("lang", "canonical"), False)
    one = L.scan_lexicon(rows.withColumn("ord", F.struct(F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"), "ord")).withColumnRenamed("lang", "canonical"), True)
    return many.join(one, "term").select("term", "canonical", F.array_join("categories", "|").alias("categories"))


@query("SELECT lang AS term FROM documents JOIN labels USING (doc_id) INTERSECT SELECT lang FROM documents ANTI JOIN labels USING (doc_id)")
def assert_disjoint(spark, d):
    t, labels = table(spark, d, "documents").withColumnRenamed("lang", "term"), table(spark, d, "labels")
    return L.assert_disjoint(t.join(labels, "doc_id", "left_semi"), t.join(labels, "doc_id", "left_anti"))


@query(rf"SELECT doc_id, coalesce(array_to_string(regexp_extract_all(text, '{_MAIL}'), ' '), '') AS entities FROM documents")
def entities_to_text(spark, d):
    found = F.transform(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0)), lambda m: F.struct(m.alias("text"), F.lit("MAIL").alias("label")))
    return docs(spark, d).select("doc_id", T.entities_to_text(found).alias("entities"))
