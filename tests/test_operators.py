"""Operators of the graph toolkit: documented behaviour and small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kgflow.functions import intervals as V
from kgflow.functions import text as T
from kgflow.operators import corpus as C
from kgflow.operators import dialog as D
from kgflow.operators import embed as E
from kgflow.operators import extractors as N
from kgflow.operators import joins as J
from kgflow.operators import lexicon as L
from kgflow.operators import merge as M
from kgflow.operators import records as R
from kgflow.operators import segment as S
from kgflow.operators import sets as X
from kgflow.plans import assoc as A
from kgflow.plans import infer as I
from kgflow.plans import search as Q
from kgflow.streaming.dialogs import step


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("DyK1012+865.5～DyK1013+247", (1012865.5, 1013247.0, "DyK")), ("DK13+250.00~DK13+274.00", (13250.0, 13274.0, "DK")), ("DK13+18", (13018.0, 13018.0, "DK")),
        ("DK1+0—DK1+9", (1000.0, 1009.0, "DK")), ("DK1+0~DyK1+9", None), ("DK1+0-DK1+9", None), ("", None), (None, None), ("DK2+0~DK1+0", (2000.0, 1000.0, "DK")), ("1+5", (1005.0, 1005.0, "")),
    ],
)
def test_parse_interval(spark, text, want):
    got = one(spark, V.parse_interval(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("text", "want"), [("起:DK13+298止:DK13+335", (13298.0, 13335.0, "DK")), ("near DK13+298 here", (13298.0, 13298.0, "DK")), ("DK1+0至DK1+9", (1000.0, 1009.0, "DK")), ("none", None)])
def test_parse_interval_query(spark, text, want):
    got = one(spark, V.parse_interval_query(F.lit(text)))
    assert (tuple(got) if got else None) == want


def test_interval_predicates(spark):
    iv = lambda a, b, p="DK": F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end"), F.lit(p).alias("prefix"))
    cases = [
        (V.overlaps(iv(13000, 13500), iv(13200, 13800)), True), (V.overlaps(iv(13000, 13100), iv(13200, 13300)), False), (V.overlaps(iv(1, 2), iv(1, 2, "K")), False),
        (V.contains_point(iv(13000, 13500), F.lit(13250.0)), True), (V.contains_point(iv(13000, 13500), F.lit(13800.0)), False), (V.contains_point(iv(1, 2), F.lit(1.0), F.lit("K")), False),
        (V.contains_range(iv(13000, 14000), iv(13200, 13800)), True), (V.contains_range(iv(13000, 13500), iv(13200, 13800)), False), (V.contains_range(iv(13000, 13500), iv(12800, 13200)), False),
    ]
    got = spark.range(1).select(*[c.alias(str(i)) for i, (c, _) in enumerate(cases)]).collect()[0]
    assert list(got) == [w for _, w in cases]


@pytest.mark.parametrize("width", [1.0, 7.0, 100.0, None, 0.0])
def test_interval_joins_equal_nested_loops(spark, width):
    import random

    rng = random.Random(int(width or 5))
    rows = [(f"n{i}", "DK" if rng.random() < 0.7 else "K", float(a := rng.randrange(300)), float(a + rng.randrange(-3, 40))) for i in range(150)]
    if width == 0.0:  # a few intervals that are thousands of times as long as the others
        rows += [("x0", "DK", -1e6, 2e6), ("x1", "DK", 100.0, 30000.0), ("x2", "K", 0.0, 1e9), ("x3", "DK", 29000.0, 31000.0), ("x4", "DK", 5e5, 5e5)]
    df = spark.createDataFrame(rows, "node_id string, p string, s double, e double").select("node_id", F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.col("p").alias("prefix")).alias("iv"))
    ok = [r for r in rows if r[2] <= r[3]]
    pairs = lambda d: sorted((r.a.node_id, r.b.node_id) for r in d.collect())
    if width == 0.0:
        bins = F.struct(F.lit(2.0).alias("width"), F.lit(5).alias("top"))
        assert J._bins(df, "iv", bins, "left", "right").groupBy("node_id").count().agg(F.max("count")).collect()[0][0] < 150
    width = width or None
    assert pairs(J.interval_overlap_join(df, df, width)) == sorted((a[0], b[0]) for a in ok for b in ok if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert pairs(J.interval_contains_join(df, df, width)) == sorted((a[0], b[0]) for a in ok for b in ok if a[1] == b[1] and a[2] <= b[2] and b[3] <= a[3])


def test_split_sentences_keeps_separators(spark):
    assert one(spark, T.split_sentences(F.lit("第一句。 第二句！！abc. d"))) == ["第一句", "。", "第二句", "！！", "abc", ".", "d"]


def chunks_by_loop(sentences, size, overlap):
    out, cur, n, start = [], "", 0, 0
    for s in sentences:
        if n + len(s) > size and cur:
            out.append((cur.strip(), start, start + n))
            start += n - overlap if n > overlap else start
            cur = (cur[-overlap:] if len(cur) > overlap else cur) + " " + s
            n = len(cur)
        else:
            cur = cur + " " + s if cur else s
            n += len(s) + 1
    return out + ([(cur.strip(), start, start + n)] if cur.strip() else [])


@pytest.mark.parametrize(("size", "overlap"), [(20, 5), (8, 10), (100, 20), (5, 1)])
def test_chunk_text(spark, size, overlap):
    text = "One two three. Four five! Six seven eight nine ten eleven twelve. A. B? " * 3 + "end without stop"
    sentences = one(spark, T.split_sentences(F.lit(text)))
    assert [tuple(c) for c in one(spark, T.chunk_text(F.lit(text), size, overlap))] == chunks_by_loop(sentences, size, overlap)
    assert one(spark, T.chunk_text(F.lit(""), size, overlap)) == []


def test_chunk_pages_numbers_through(spark):
    df = spark.createDataFrame([("d", 1, "Aa bb. Cc dd."), ("d", 2, "Ee ff. Gg.")], "doc_id string, page_no int, text string")
    rows = S.chunk_pages(df, 8, 0).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(a.char_end == b.char_start for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize(
    ("path", "want"),
    [("/x/survey/TSP/a.json", "survey_TSP"), ("/x/survey/odd/a.json", "survey_default"), ("/x/survey/a.json", "survey_default"), ("/design/sub/a.pdf", "D"), ("/other/my-design.pdf", "D"), ("/other/a.pdf", "unknown")],
)
def test_classify_by_path(spark, path, want):
    got = one(spark, T.classify_by_path(F.lit(path), {"design": "D", "change": "C"}, "survey", ["TSP"], "default"))
    assert got == want


def test_segment_by_titles(spark):
    df = spark.createDataFrame([(1, "intro 1． First  part 2、 Second"), (2, "no titles"), (3, "1. only")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.section_id or "", r.text) for r in S.segment_by_titles(df, {"1": r"1\.", "2": r"2\.", "3": r"3\."}).collect())
    assert rows == [(1, "0", "intro"), (1, "1", "1. First part"), (1, "2", "2. Second"), (2, "", "no titles"), (3, "1", "1. only")]


def test_lexicon_tagging(spark):
    docs = L.normalise(spark.createDataFrame([(1, "red sand stone with clay。 soft sand")], "doc_id long, text string"))
    lex = spark.createDataFrame([("sand",), ("sandstone",), ("clay",)], "term string")
    roots = L.resolve_overlaps(L.lexicon_match(docs, lex))
    assert sorted((r.start, r.end, r.term) for r in roots.collect()) == [(3, 12, "sandstone"), (16, 20, "clay"), (25, 29, "sand")]
    attrs = L.lexicon_match(docs, spark.createDataFrame([("red",), ("soft",)], "term string"))
    placed = L.assign_nearest(roots, attrs, docs)
    assert sorted((r.term, r.root_start) for r in placed.collect()) == [("red", 3), ("soft", 25)]
    far = L.assign_nearest(roots.where("term = 'sandstone'"), attrs, docs, 2)
    assert {r.term: r.root_start for r in far.collect()} == {"red": 3, "soft": None}
    phrases = L.assemble_phrases(roots.withColumn("category", F.lit("rock")), docs, ["with"], "rock", "layer")
    assert [r.phrase for r in phrases.collect()] == ["sandstonewithclay"]
    assert L.render_tags(phrases, roots, placed).collect()[0].tags == ["sandstonewithclay", "sandstone", "red", "clay", "sand", "soft"]


def test_nearest_ties_prefer_the_sentence(spark):
    docs = spark.createDataFrame([(1, "aa。xxbb")], "doc_id long, text string")
    roots = spark.createDataFrame([(1, 0, 2, "aa"), (1, 5, 7, "bb")], "doc_id long, start int, end int, term string")
    attr = spark.createDataFrame([(1, 3, 4, "x")], "doc_id long, start int, end int, term string")
    assert L.assign_nearest(roots, attr, docs).collect()[0].root_start == 5


def test_json_mapping_counts(spark):
    """One record with an array of four elements: 1 + 4 * 4 nodes, and 4 * 4 edges between those of an element."""
    body = json.dumps({"上传日期": "2024-01-01", "结论": [{"里程范围": f"DK1+{i}", "探测结论": "c", "地质风险等级": "II级" if i else None, "其他": "x", "链接": "http://a"} for i in range(4)]}, ensure_ascii=False)
    rec = spark.createDataFrame([("c1", body, {})], "chunk_id string, json string, metadata map<string,string>")
    maps = [R.NodeMapping("method", {"date": "上传日期"}), R.NodeMapping("range", {"v": "里程范围"}, array="结论"), R.NodeMapping("conclusion", {"v": "探测结论"}, array="结论"), R.NodeMapping("grade", {"v": "地质风险等级"}, array="结论"), R.NodeMapping("rest", {}, remaining="text", array="结论")]
    rows = R.map_json_nodes(rec, maps)
    assert rows.groupBy("node_type").count().collect() and {r.node_type: r["count"] for r in rows.groupBy("node_type").count().collect()} == {"method": 1, "range": 4, "conclusion": 4, "grade": 3, "rest": 4}
    named = rows.withColumn("node_id", F.concat_ws("-", "node_type", "element"))
    assert J.relate_array_groups(named.where("node_type = 'range'"), named.where("node_type = 'grade'")).count() == 3
    assert "链接" not in rows.where("node_type = 'rest'").collect()[0].attributes["text"]


def test_json_helpers(spark):
    cases = {
        '{"x":{"z":{"k":"deep"}},"y":{"k":"later"}}': "deep", '{"x":{"k":"deep"},"k":"top"}': "top", '{"q":1}': None, '{"a":[1,[{"b":{"c":{"d":{"e":{"k":1.50}}}}}]]}': "1.50",
        '[{"k":{"n":[1,2.5,true,"é"]}}]': '{"n":[1,2.5,true,"é"]}', '{"k":12}': "12", '{"k":true}': "true", '{"k":null}': None, "no json": None, "": None, "[" * 100_000: None,
    }
    df = spark.createDataFrame([(x,) for x in [*cases, None]], "json string")
    assert {r.json: r.v for r in df.select("json", T.json_find_key(F.col("json"), "k").alias("v")).collect()} == cases | {None: None}
    assert one(spark, T.composite_field([F.lit("a"), F.lit(None).cast("string")], "~")) is None
    assert one(spark, T.extract_json(F.lit('say {"a": 1} ok'))) == '{"a": 1}' and one(spark, T.extract_json(F.lit("say {oops"))) is None


def test_templates_keep_what_values_hold(spark):
    values = F.create_map(F.lit("text"), F.lit("use {foo} and {id} {"), F.lit("id"), F.lit("7"), F.lit("none"), F.lit(None).cast("string"))
    assert one(spark, T.render(F.lit("{id}: {text}|{none}|{missing}| { {x y} }"), values)) == "7: use {foo} and {id} {||| { {x y} }"


def test_visible_text_decodes_all_references(spark):
    assert one(spark, T.visible_text(F.lit("<p>a&nbsp;&copy; &eacute;&#x41;</p><script>x</script> &amp;lt; &bogus;"))) == "a © éA &lt; &bogus;"


def test_visible_text_leaves_references_without_semicolon(spark):
    assert one(spark, T.visible_text(F.lit("<p>cut&amp</p>&ampamp; &copy 1 &notit; &#65 &am"))) == "cut&amp &ampamp; &copy 1 &notit; &#65 &am"


def test_nested_values_prefixes_and_entities(spark):
    df = spark.createDataFrame([(1, {"b": "é"}, ["x", None], "s")], "id int, m map<string,string>, a array<string>, s string")
    assert tuple(T.serialize_nested(df).collect()[0]) == (1, '{"b":"é"}', '["x",null]', "s")
    row = df.select(*T.prefix_format({"history": {"plan": F.col("a")}, "current": {"plan": F.slice("a", 1, 0)}})).collect()[0]
    assert (row.history_plan, row.current_plan) == (["x", None], None)
    entity = lambda *t: F.array(*[F.struct(F.lit(x).cast("string").alias("text")) for x in t])
    assert one(spark, T.entities_to_text(entity("a", "", None, "b"))) == "a b" and one(spark, T.entities_to_text(F.lit(None).cast("array<struct<text:string>>"))) == ""


def test_orders_and_sets(spark):
    types = spark.createDataFrame([("b", None), ("a", None), ("c", 5)], "node_type string, priority int")
    assert [tuple(r) for r in X.type_priority(types).collect()] == [("c", 5), ("a", 999), ("b", 999)]
    groups = spark.createDataFrame([("x", 2), ("y", 9), ("z", 1), ("w", 2)], "key string, n long")
    assert [r.key for r in X.dup_order(groups, "key").collect()] == ["y", "w", "x"]
    ledger = spark.createDataFrame([("f1", "s", "done"), ("f2", "s", "failed"), ("f3", "t", "done")], "key string, stage string, status string")
    items = spark.createDataFrame([("f1",), ("f2",), ("f2",), ("f3",)], "key string")
    assert sorted(r.key for r in X.except_processed(items, ledger, "key", "s").collect()) == ["f2", "f3"]
    one_, two = spark.createDataFrame([("a", 1)], "text string, x int"), spark.createDataFrame([("a",), ("b",)], "text string")
    assert sorted(map(tuple, X.union_extractions(one_, two).collect()), key=repr) == [("a", 1), ("a", None), ("b", None)]
    assert [r.text for r in X.intersect_texts(one_, two).collect()] == ["a"]


def test_embedding_with_a_model_of_ones_own(spark):
    import pandas as pd

    sizes = []

    def embed(rows, id_col, text_col):
        def run(batches):
            for pdf in batches:
                for at in range(0, len(pdf), 32):  # the model's batch
                    part = pdf.iloc[at : at + 32]
                    assert len(part) <= 32
                    yield pd.DataFrame({id_col: part[id_col], "embedding": [[float(len(t)), 1.0] for t in part[text_col]]})

        sizes.append(1)
        return rows.select(id_col, text_col).mapInPandas(run, f"{id_col} long, embedding array<double>")

    rows = spark.createDataFrame([(i, "x" * i) for i in range(100)], "node_id long, text string")
    done = spark.createDataFrame([(3, "embed", "done"), (4, "embed", "failed")], "node_id long, stage string, status string")
    got = {r.node_id: r.embedding for r in E.embed_table(rows, done, "text", embed).collect()}
    assert sizes == [1] and got == {i: [float(i), 1.0] for i in range(100) if i != 3}


def nodes(spark, rows):
    return spark.createDataFrame(rows, "source_file string, node_type string, node_id string, chunk_id string, attributes map<string,string>, confidence double, ord int")


def test_merge_policies(spark):
    n = nodes(spark, [("f", "t", "n1", "c1", {"a": "x", "d": "2024年3月1日"}, 0.5, 1), ("f", "t", "n2", "c2", {"a": "y", "d": "2024-01-05", "b": "z"}, 0.9, 2), ("f", "t", "n3", "c1", {"a": "x", "d": "bad", "b": ""}, 0.9, 3)])
    get = lambda df: df.collect()[0]
    assert get(M.agg_merge_attributes(n)).attributes == {"a": "x", "b": "z", "d": "2024年3月1日"}
    assert get(M.agg_select_earliest(n, "d")).node_id == "n2"
    assert get(M.agg_select_most_common(n)).attributes["a"] == "x"
    assert get(M.agg_merge_descriptions(n)).attributes == {"a": "x；y", "d": "2024-01-05；2024年3月1日；bad"}
    assert get(M.agg_create_single(n)).attributes["b"] == "z"
    assert get(M.merge_change_nodes(n)).node_id == "n2"
    assert one(spark, M.merge_key(F.lit("L"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"), F.lit("c"), F.lit("")))) == "L|a:1|b:2"
    keyed = n.withColumn("merge_key", F.col("attributes")["a"])
    merged = {r.merge_key: r for r in M.merge_global(keyed).collect()}
    assert merged["x"].source_chunks == ["c1"] and merged["x"].all_node_ids == ["n1", "n3"] and merged["x"].confidence == 0.9
    again = M.merge_global(M.merge_global(keyed).select("merge_key", "node_id", "attributes", "confidence", F.explode("source_chunks").alias("chunk_id"), F.lit(1).alias("ord")))
    assert again.count() == 2


def test_inference_paths_are_simple_and_bounded(spark):
    n = spark.createDataFrame([(x, x[0]) for x in ("a1", "b1", "b2", "c1", "c2", "c3", "a2")], "node_id string, node_type string")
    e = spark.createDataFrame([("R", "a1", "b1", 0.5), ("R", "a1", "b2", 0.5), ("S", "b1", "c1", 0.8), ("S", "b1", "c2", 0.8), ("S", "b2", "c3", 0.8), ("S", "b2", "c1", 0.8), ("S", "b1", "a1", 0.8)], "relation_type string, head string, tail string, confidence double")
    r, back = I.Step("edge", "a", "b", "R"), I.Step("edge", "b", "a", "S")
    got = I.infer_multi_hop(n, e, I.MultiHop("T", (r, I.Step("edge", "b", "c", "S")), "product", 3)).collect()
    assert [(r.head, r.tail, r.confidence) for r in sorted(got, key=lambda r: r.evidence)] == [("a1", "c1", 0.4), ("a1", "c2", 0.4), ("a1", "c1", 0.4)]
    assert I.infer_multi_hop(n, e, I.MultiHop("T", (r, back))).count() == 0
    with pytest.raises(ValueError):
        I.MultiHop("T", (r, r))


def _plain_paths(nodes, edges, rule):
    """All simple paths of a rule by depth-first search, the first of each source: {(path, confidence)}."""

    def next_nodes(x, step):
        for y in nodes.values():
            if nodes[x]["node_type"] != step.from_type or y["node_type"] != step.to_type:
                continue
            a, b = nodes[x]["iv"], y["iv"]
            if step.kind == "edge":
                ends = (x, y["node_id"]) if step.direction == "OUT" else (y["node_id"], x)
                if found := [c for r, h, t, c in edges if (r, h, t) == (step.relation, *ends)]:
                    yield y["node_id"], max(found)
                continue
            if step.kind == "attribute_match":
                met = nodes[x]["key"] is not None and nodes[x]["key"] == y["key"]
            else:
                met = a and b and {"overlap": a[1] <= b[2] and b[1] <= a[2], "contains": a[1] <= b[1] and b[2] <= a[2], "contained_by": b[1] <= a[1] and a[2] <= b[2]}[step.kind]
            if met:
                yield y["node_id"], step.confidence

    out = set()
    for x in nodes.values():
        paths = [((x["node_id"],), 1.0)] if x["node_type"] == rule.types[0] else []
        for step in rule.steps:
            paths = [((*p, y), (d if rule.confidence == "last" else c * d)) for p, c in paths for y, d in next_nodes(p[-1], step) if y not in p]
        out.update((" > ".join(p), round(c, 4)) for p, c in sorted(paths)[: rule.max_paths])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_mixed_chains_equal_a_search(spark, seed):
    rnd = random.Random(seed)
    nodes = {f"{t}{i}": {"node_id": f"{t}{i}", "node_type": t, "key": rnd.choice(["x", "y", "z", None]), "iv": rnd.choice([None, ("K", float(s := rnd.randint(0, 20)), float(s + rnd.randint(0, 9)))])} for t in "abc" for i in range(7)}
    edges = [(rnd.choice("RS"), rnd.choice([*nodes]), rnd.choice([*nodes]), rnd.choice([0.5, 0.75])) for _ in range(150)]
    n = spark.createDataFrame([(*(v[c] for c in ("node_id", "node_type", "key", "iv")), 1) for v in nodes.values()], "node_id string, node_type string, key string, iv struct<prefix: string, start: double, end: double>, at int")
    e = spark.createDataFrame(edges, "relation_type string, head string, tail string, confidence double")
    chain, at = [], rnd.choice("abc")
    for kind in rnd.sample(["edge", "edge", "overlap", "contains", "contained_by", "attribute_match"], rnd.randint(2, 4)):
        to = rnd.choice("abc")
        chain.append(I.Step(kind, at, to, rnd.choice("RS"), rnd.choice(["OUT", "IN"]), "key", "key", 0.5))
        at = to
    for k in (1, 3, 1000):
        rule = I.MultiHop("T", tuple(chain), rnd.choice(["last", "product"]), k)
        assert {(r.evidence, r.confidence) for r in I.infer_multi_hop(n, e, rule).collect()} == _plain_paths(nodes, edges, rule)


def test_a_rule_through_a_hub_is_linear(spark):
    """30,000 nodes around one: all pairs would be 900 million rows."""
    n = spark.range(30_000).select(F.concat(F.lit("a"), F.col("id")).alias("node_id"), F.lit("a").alias("node_type"))
    e = n.select(F.lit("R").alias("relation_type"), F.col("node_id").alias("head"), F.lit("hub").alias("tail"), F.lit(1.0).alias("confidence"))
    n = n.union(spark.createDataFrame([("hub", "h")], n.schema))
    rule = I.MultiHop("T", (I.Step("edge", "a", "h", "R"), I.Step("edge", "h", "a", "R", "IN")))
    got = I.infer_multi_hop(n, e, rule).groupBy("head").count().groupBy("count").count().collect()
    assert [tuple(r) for r in got] == [(3, 30_000)]


def test_association_anchor_comes_first(spark):
    n = spark.createDataFrame([("p", {"name": "P"}), ("q", {"name": "Q"})], "node_id string, attributes map<string,string>")
    e = spark.createDataFrame([("R", "q", "p")], "relation_type string, head string, tail string")
    req = spark.createDataFrame([(1, "p"), (2, "zz")], "request_id int, node_id string")
    opt = A.Association("o", (A.Field("name", "me", step=0), A.Field("name", "other", "none")), (A.Step("R", optional=True),))
    assert [tuple(r) for r in A.associate(req, n, e, opt).collect()] == [(1, "P", "none")]
    both = A.Association("b", (A.Field("name", "other"),), (A.Step("R", "BOTH"),))
    assert [tuple(r) for r in A.associate(req, n, e, both).collect()] == [(1, "Q")]
    direct = A.Association("d", (A.Field("name", "me", "?"),), kind="direct")
    assert sorted(tuple(r) for r in A.associate(req, n, e, direct).collect()) == [(1, "P"), (2, "?")]


def test_cardinality_and_remap(spark):
    h = spark.createDataFrame([("c", f"h{i}", i) for i in range(3)], "chunk_id string, node_id string, pos int")
    t = spark.createDataFrame([("c", f"t{i}", i) for i in range(2)], "chunk_id string, node_id string, pos int")
    assert sorted((r.head, r.tail) for r in J.relate_by_cardinality(h, t).collect()) == [("h0", "t0"), ("h1", "t1")]
    assert J.relate_by_cardinality(h, t.limit(1)).count() == 3


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, T.cosine(v(1, 0), v(1, 0))) == 1.0 and one(spark, T.cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(spark, T.parse_vector(F.lit("0.5,1,x"))) == [0.5, 1.0, None]
    assert one(spark, T.cosine(v(1, 0), v(1, 0, 0))) is None
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id long, v array<double>")
    ok, bad = Q.check_vectors(rows, "v", 2)
    assert [r.id for r in ok.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3]
    w = one(spark, Q.weight_gate(F.lit(None).cast("double"), F.lit(0.5), ((1.0, 1.0, 0.0),), ((1.0, 0.0), (0.0, 0.0))))
    assert (w.alpha, w.beta) == (0.5, 0.5)


def test_cosine_topk_equals_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(Q, "QUERY_BLOCK", 3)
    monkeypatch.setattr(Q, "VECTOR_BLOCK", 10)
    rng = np.random.default_rng(3)
    vs = [(i, "hot" if i % 4 else "cold", rng.normal(size=4).tolist()) for i in range(80)] + [(80, "hot", [0.0] * 4), (81, "hot", [1.0]), (82, "hot", None), (83, None, [1.0] * 4)]
    df = spark.createDataFrame(vs, "node_id long, c string, v array<double>")
    q = df.where("node_id % 10 = 0").select(F.col("node_id").alias("query_id"), "c", F.col("v").alias("q"))
    got = {}
    for r in Q.cosine_topk(q, df, "c", 0.2, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.node_id, round(r.similarity, 9))
    want = {}
    for i, c, x in vs[:80:10]:
        cos = [(-np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y), j) for j, k, y in vs[:80] if k == c]
        want[i] = {n + 1: (j, round(-s, 9)) for n, (s, j) in enumerate(sorted(x for x in cos if -x[0] > 0.2)[:5])}
    assert got == want


def records_sent(plan):
    """Rows that the exchanges of an executed plan have dealt."""
    name, children = plan.getClass().getSimpleName(), plan.children()
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
    return own + (records_sent(inner) if inner is not None else 0) + sum(records_sent(children.apply(i)) for i in range(children.size()))


def test_cosine_topk_sends_rows_in_proportion(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(Q, "PAIRS", 1000, raising=False)
    base, sent = np.random.default_rng(5).normal(size=(150, 8)), []
    for n in (6000, 12000):
        df = spark.createDataFrame([(f"v{i}", "hot" if i % 5 else "cold", base[i % 150].tolist()) for i in range(n)], "node_id string, c string, v array<float>")
        found = Q.cosine_topk(df.where("c = 'hot'").select(F.col("node_id").alias("query_id"), "c", F.col("v").alias("q")), df, "c", 0.5, 3)
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.node_id
        first = {b: sorted(f"v{i}" for i in range(b, n, 150))[:3] for b in range(150)}  # many equal vectors: the smallest ids, whatever block they are in
        assert got == {f"v{i}": dict(enumerate(first[i % 150], 1)) for i in range(n) if i % 5}
        sent.append(records_sent(found._jdf.queryExecution().executedPlan()))
    assert 0 < sent[1] < 2.5 * sent[0]


def test_splits_are_partitions(spark):
    rows = spark.createDataFrame([(f"t{i}", i % 3, i) for i in range(100)], "text string, label int, ord int")
    split = C.stratified_split(rows, "s")
    assert split.count() == 100 and C.leakage_check(split).count() == 0
    assert {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}[(0, "train")] == 20
    ok, bad = C.scan_labeled_lines(spark.createDataFrame([("a b 1",), ("broken",), ("x -2",)], "value string"))
    assert sorted(tuple(r) for r in ok.collect()) == [("a b", 1), ("x", -2)] and bad.count() == 1


@pytest.mark.parametrize(
    ("kinds", "want"),
    [
        (["query", "reject", "follow", "reject", "follow", "reject"], ("COMPLETED", 2, 3)), (["query", "accept"], ("COMPLETED", 0, 0)), (["query", "reject", "change"], ("PRESENTING", 1, 1)),
        (["query", "follow", "change"], ("PRESENTING", 0, 0)), (["query", "accept", "follow"], ("PRESENTING", 0, 0)), ([], None),
    ],
)
def test_dialog_fold_equals_step(spark, kinds, want):
    rows = [(1, i, k, 5) for i, k in enumerate(kinds)]
    got = D.dialog_state(spark.createDataFrame(rows, "conv_id long, turn long, kind string, n_plans int")).collect()
    state = ("IDLE", 0, 0, 0)
    for _, _, k, n in rows:
        state = step(state, k, n)
    assert [(r.state, r.idx, r.rejections) for r in got] == ([want] if want else [])
    if want:
        assert state[:3] == want


def test_feedback(spark):
    groups = [("cost", ["太贵", "成本"]), ("time", ["工期"])]
    f = lambda t: tuple(one(spark, D.classify_feedback(F.lit(t), groups)))
    assert f("成本太贵") == ("cost", "太贵", 0.8) and f("工期和成本") == ("cost", "成本", 0.6) and f("") == ("other", None, 0.0)


def test_normalisation(spark):
    assert one(spark, T.normalize_grade(F.lit(" Ⅲ级 "), {})) == "III"
    assert one(spark, T.render(F.lit("{a} and {b}"), F.create_map(F.lit("a"), F.lit("x")))) == "x and "


def _plain_chunks(sentences, size, overlap):
    """The chunks of ``chunk_text`` by its description, sentence by sentence."""
    chunks, now = [], []
    for k, s in enumerate(sentences):
        carried = chunks[-1][0] if chunks else ""
        carried = carried[-overlap:] if overlap else carried
        counted = (len(carried) if chunks else 0) + sum(len(x) + 1 for x in now)
        if now and counted + len(s) > size:
            chunks.append((" ".join([carried, *now] if chunks else now), counted))
            now = []
        now.append(s)
    if now:
        carried = (chunks[-1][0][-overlap:] if overlap else chunks[-1][0]) if chunks else ""
        chunks.append((" ".join([carried, *now] if chunks else now), (len(carried) if chunks else 0) + sum(len(x) + 1 for x in now)))
    out, start = [], 0
    for text, counted in chunks:
        out.append((text.strip(), start, start + counted))
        start += counted - overlap if counted > overlap else start
    return out


def test_chunks_follow_their_description():
    rnd = random.Random(7)
    for _ in range(3000):
        sentences = ["".join(rnd.choices("abc", k=rnd.randint(1, rnd.choice([3, 30])))) for _ in range(rnd.randint(0, 12))]
        size, overlap = rnd.randint(1, 60), rnd.choice([0, 1, 5, 20])
        assert T.pack_sentences(sentences, size, overlap) == _plain_chunks(sentences, size, overlap)


def test_automaton_equals_windows(spark, sf):
    """100,000 terms of 2 to 12 characters, some of them parts of others."""
    docs = L.normalise(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "日本語😀日本")], "doc_id long, text string"))
    rnd, texts = random.Random(2), [r.text for r in docs.collect() if r.text]
    terms = {"", "日本", "本語", "😀"}
    while len(terms) < 100_000:
        t = rnd.choice(texts)
        i, n = rnd.randrange(len(t)), rnd.randint(2, 12)
        terms.add(t[i : i + n] if rnd.random() < 0.2 else "".join(rnd.choices("abcdefghijklmnop", k=n)))
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    assert L.automaton(lexicon) and not L.automaton(lexicon, 1000)
    rows = [sorted((r.doc_id, r.start, r.end, r.term) for r in L.lexicon_match(docs.where(keep), lexicon, most).collect()) for keep, most in (("doc_id < 20", L.AUTOMATON_CHARS), ("doc_id < 20", 1000))]
    assert rows[0] == rows[1] and len(rows[0]) > 1000 and (-3, 0, 2, "日本") in rows[0] and (-3, 3, 4, "😀") in rows[0]
    assert L.lexicon_match(docs, lexicon.limit(0)).count() == 0


@pytest.mark.parametrize("most", [L.AUTOMATON_CHARS, 0])
def test_keywords_of_any_number(spark, monkeypatch, most):
    monkeypatch.setattr(S, "automaton", lambda terms: L.automaton(terms, most))
    monkeypatch.setattr(S, "lexicon_match", lambda rows, terms: L.lexicon_match(rows, terms, most))
    docs = spark.createDataFrame([(1, "a rock and rocks"), (1, "no"), (2, None), (3, "rock salt")], "doc_id long, text string")
    words = spark.createDataFrame([("stone", "rock"), ("music", "rock"), ("food", "salt"), ("none", "")], "node_type string, keyword string")
    assert sorted(tuple(r) for r in S.keyword_nodes(docs, words).collect()) == [(1, "music", "rock"), (1, "stone", "rock"), (3, "food", "salt"), (3, "music", "rock"), (3, "stone", "rock")]


def test_alias_chains_and_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(100)]
    cycle = [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("self", "self"), ("twice", "n0"), ("twice", "n50")]
    aliases = spark.createDataFrame(chain + cycle, "node_id string, kept_id string")
    edges = spark.createDataFrame([("n0", "R", "n99"), ("n5", "R", "q"), ("x", "R", "into"), ("self", "R", "twice"), (None, "R", "n1")], "head string, relation_type string, tail string")
    got, cycles = J.remap_edges(edges, aliases)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([("n100", "R", "n100"), ("n100", "R", "q"), ("x", "R", "into"), ("self", "R", "n100"), (None, "R", "n100")], key=str)
    assert sorted(tuple(r) for r in cycles.collect()) == [("into", "x"), ("x", "y"), ("y", "z"), ("z", "x")]
    got, cycles = J.remap_edges(edges, aliases.limit(0))
    assert got.count() == 5 and cycles.count() == 0


def test_pairs_by_cardinality(spark):
    rows = lambda side: spark.createDataFrame([(c, f"{side}{c}{i}", i) for c, n in enumerate(side_sizes[side]) for i in range(n)], "chunk_id long, node_id string, pos long")
    side_sizes = {"h": [1, 1, 3, 3, 2, 0], "t": [1, 3, 1, 2, 3, 2]}
    got = sorted((r.chunk_id, r.head, r.tail) for r in J.relate_by_cardinality(rows("h"), rows("t")).collect())
    want = []
    for c, (n, m) in enumerate(zip(*side_sizes.values(), strict=True)):
        want += [(c, f"h{c}{i}", f"t{c}{j}") for i in range(n) for j in range(m) if n == 1 or m == 1 or i == j]
    assert got == want


def test_a_tree_of_look_ups_equals_each_alone(spark):
    rnd = random.Random(4)
    nodes = [(f"{t}{i}", t, {"name": f"{t}-{i}"} if i else {}) for t in "abc" for i in range(5)]
    edges = list({(rnd.choice("RS"), f"{rnd.choice('abc')}{rnd.randint(0, 5)}", f"{rnd.choice('abc')}{rnd.randint(0, 5)}") for _ in range(60)})
    n = spark.createDataFrame(nodes, "node_id string, node_type string, attributes map<string,string>")
    e = spark.createDataFrame(edges, "relation_type string, head string, tail string")
    requests = spark.createDataFrame([(k, x) for k, x in enumerate([f"a{i}" for i in range(6)] + ["a1", "b2", "zz", None])], "request_id long, node_id string")
    queries = [A.Association("own", (A.Field("name", "name", "?"),), kind="direct")]
    for k in range(9):
        steps = tuple(A.Step(rnd.choice("RS"), rnd.choice(["OUT", "IN", "BOTH"]), rnd.random() < 0.3, rnd.choice([None, "b", "c"])) for _ in range(rnd.randint(1, 3)))
        queries.append(A.Association(f"q{k}", (A.Field("name", "last"), A.Field("name", "first", "none", rnd.randint(0, 1))), steps))
    queries += [A.Association(f"{q.name}_more", q.fields, (*q.steps, A.Step("R"))) for q in queries[1:4]]
    known = {i: a for i, _, a in nodes}

    def plain(anchor, q):
        if q.kind == "direct":
            return [(known.get(anchor, {}).get("name", "?"),)]
        paths = [[anchor]] if anchor in known else []
        for s in q.steps:
            longer = []
            for p in paths:
                out = [t for r, h, t in edges if s.direction != "IN" and (r, h) == (s.relation_type, p[-1])] + [h for r, h, t in edges if s.direction != "OUT" and (r, t) == (s.relation_type, p[-1])]
                out = [x for x in out if x in known and s.node_type in (None, x[0])]
                longer += [[*p, x] for x in out] or ([[*p, None]] if s.optional else [])
            paths = longer
        value = lambda p, f: known.get(p[f.step if f.step >= 0 else len(q.steps)], {}).get(f.attribute) or f.fallback
        return sorted([tuple(value(p, f) for f in q.fields) for p in paths], key=lambda r: tuple((x is not None, x or "") for x in r))

    for r in A.associate_all(requests, n, e, queries).collect():
        anchor = next(x.node_id for x in requests.collect() if x.request_id == r.request_id)
        if anchor is not None:
            assert {q.name: [tuple(x) for x in r[q.name]] for q in queries} == {q.name: plain(anchor, q) for q in queries}, anchor
    one = queries[4]
    got = sorted((r.request_id, r.last, r.first) for r in A.associate(requests, n, e, one).select("request_id", F.coalesce("last", F.lit("")).alias("last"), F.coalesce("first", F.lit("")).alias("first")).collect())
    assert got == sorted((r.request_id, a or "", b or "") for r in requests.collect() for a, b in plain(r.node_id, one))


def test_json_values_of_any_depth(spark):
    deep = '{"a":[' * 50_000 + '{"k":{"z":[1.50,"ü\\n"]}}' + "]}" * 50_000
    rows = spark.createDataFrame([(1, deep), (2, deep[:-1]), (3, '{"k":null}'), (4, "[" * 60_000 + '{"k":"t","k":-2e3}' + "]" * 60_000), (5, deep.replace('"k"', '"l"'))], "id long, json string")
    got = {r.id: r.v for r in rows.select("id", T.json_find_key(F.col("json"), "k").alias("v")).collect()}
    assert got == {1: '{"z":[1.5,"ü\\n"]}', 2: None, 3: None, 4: "-2000.0", 5: None}


class _Words:
    def __init__(self):
        self.n = 0

    def __call__(self, text, metadata):
        self.n += 1
        return [("word", {"w": w, "place": self.n, "from": metadata.get("file")}) for w in text.split()]

    def finish(self):
        yield "document", {"n": self.n}


def test_extractors_of_users(spark):
    chunks = spark.createDataFrame([(1, "f1", "b c", {"file": "x"}), (0, "f1", "a", None), (2, "f2", None, {}), (3, "f2", "", {})], "chunk_id long, source_file string, text string, metadata map<string,string>")
    got = [(r.chunk_id, r.node_type, r.attributes["w"], r.attributes["from"]) for r in N.extract_nodes(chunks, _Words).collect()]
    assert sorted(got, key=str) == [(0, "word", "a", None), (1, "word", "b", "x"), (1, "word", "c", "x")]
    by = sorted((r.source_file, r.node_type, r.attributes.get("w") or "", r.attributes.get("place") or r.attributes["n"]) for r in N.extract_by_document(chunks, _Words).collect())
    assert by == [("f1", "document", "", "2"), ("f1", "word", "a", "1"), ("f1", "word", "b", "2"), ("f1", "word", "c", "2"), ("f2", "document", "", "1")]
    assert N.extract_nodes(chunks.limit(0), _Words).count() == N.extract_by_document(chunks.limit(0), _Words).count() == 0
    spark.udtf.register("user_words", N.table_function(_Words))
    chunks.createOrReplaceTempView("user_chunks")
    assert spark.sql("SELECT chunk_id, attributes['w'] AS w FROM user_chunks, LATERAL user_words(text, metadata)").count() == 3


def test_blank_requests_share_members(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    edges = spark.createDataFrame([("R", "a", "x"), ("R", "a", "x"), ("R", "b", "y"), ("R", "gone", "x"), ("S", "c", "x"), ("R", "c", " ")], "relation_type string, head string, tail string")
    requests = lambda rows: spark.createDataFrame(rows, "query_id long, category string")
    asked, members = J.restrict_subgraph(nodes, edges, requests([(1, " x "), (2, None), (3, ""), (4, "nothing")]), "R")
    assert sorted(tuple(r) for r in asked.collect()) == [(1, "x"), (2, ""), (3, ""), (4, "nothing")]
    assert sorted(tuple(r) for r in members.collect()) == [("", "a"), ("", "b"), ("", "c"), ("x", "a")]
    assert J.restrict_subgraph(nodes, edges, requests([(1, "y")]), "R")[1].collect() == [("y", "b")]


def test_merge_of_one_key_with_many_nodes(spark):
    rnd = random.Random(6)
    rows = [("k", f"c{rnd.randint(0, 4)}", f"n{rnd.randint(0, 30)}", {"a": str(i)}, rnd.random(), i) for i in rnd.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "merge_key string, chunk_id string, node_id string, attributes map<string,string>, confidence double, ord long").repartition(4)
    got, rows = M.merge_global(df).collect(), sorted(rows, key=lambda r: r[5])
    assert len(got) == 1 and got[0].node_id == rows[0][2] and got[0].attributes == rows[0][3] and got[0].confidence == max(r[4] for r in rows)
    assert got[0].source_chunks == list(dict.fromkeys(r[1] for r in rows)) and got[0].all_node_ids == list(dict.fromkeys(r[2] for r in rows))


@pytest.mark.parametrize(("name", "n"), [("agg_select_most_common", 1), ("agg_merge_attributes", 1), ("agg_merge_descriptions", 2), ("agg_create_single", 1), ("agg_merge_unique", 1), ("agg_select_earliest", 1), ("dedup_nodes", 1), ("merge_global", 2)])
def test_nodes_of_lines_are_dealt_once(spark, sf, name, n):
    """The shuffles of a plan: lines are dealt by file or chunk, which everything but keys across files goes by."""
    from kgflow import catalog

    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning" in x]) <= n


def test_restrict_subgraph_gives_every_pair(spark, sf):
    from kgflow import catalog

    rows = catalog.QUERIES["restrict_subgraph"](spark, sf)
    n = sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("customer", "supplier"))
    assert rows.columns == ["request_id", "node_id"]
    assert rows.count() == rows.distinct().count() == 6 * n


def test_ends_are_those_of_the_lists(spark):
    from kgflow.plans import assoc as A

    node = "node_id string, node_type string, attributes map<string,string>"
    nodes = spark.createDataFrame([(f"a{i}", "a", {"name": f"A{i}"}) for i in range(4)] + [(f"b{i}", "b", {"name": f"B{i}"} if i else {}) for i in range(3)] + [("c0", "c", {"name": "C"}), ("d", "d", {"name": "D"}), ("d", "d", {"name": "E"})], node)
    edges = spark.createDataFrame([("R", "a0", "b0"), ("R", "a0", "b1"), ("R", "a1", "b1"), ("R", "a1", "b1"), ("R", "a2", "lost"), ("S", "b1", "c0"), ("S", "b0", "a3"), ("S", "b1", "d")], "relation_type string, head string, tail string")
    name, r, s = A.Field("name", "name"), A.Step("R"), A.Step("S")
    queries = [
        A.Association("own", (A.Field("name", "name", "none"),), kind="direct"),
        A.Association("one", (name,), (r,)),
        A.Association("two", (A.Field("name", "name"), A.Field("name", "mid", "?", 1), A.Field("name", "start", step=0)), (r, s)),
        A.Association("begun", (A.Field("name", "start", step=0),), (r, s)),
        A.Association("maybe", (A.Field("name", "name", "nobody"),), (A.Step("R", optional=True),)),
        A.Association("then", (A.Field("name", "name", "x"),), (r, A.Step("S", optional=True, node_type="c"))),
        A.Association("lost", (A.Field("name", "name", "x"),), (A.Step("R", optional=True), s)),
        A.Association("back", (name,), (r, A.Step("R", "IN"))),
        A.Association("both", (name,), (A.Step("R", "BOTH"),)),
    ]
    requests = spark.createDataFrame([(1, "a0"), (2, "a1"), (3, "a2"), (4, "b1"), (5, "gone"), (6, "a0"), (7, None), (8, "d")], "request_id int, node_id string")
    lists = {x.request_id: x for x in A.associate_all(requests, nodes, edges, queries).collect()}
    ends = {x.request_id: x for x in A.associate_ends(requests, nodes, edges, queries).collect()}
    assert len(ends) == len(lists) == 8
    for i, row in lists.items():
        for q in queries:
            rows, got = row[q.name], ends[i][q.name]
            assert (got.n, got.first, got.last) == ((len(rows), rows[0], rows[-1]) if rows else (0, None, None)), (i, q.name)


def test_lookups_of_plans_pair_no_customer_with_all_suppliers(spark, sf):
    from kgflow import catalog

    assert "collect_list" not in catalog.QUERIES["associate_plan_lookups"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_lexicon_from_labels_makes_no_row_of_a_character(spark):
    rows = [(1, list("abcd") + [None, "é"], ["B-W", "I-W", "O", "I-W", "B-V", "I-V"]), (2, ["x"], ["I-W"]), (3, [], []), (4, None, None), (5, list("ab"), ["B-W", "B-W"]), (6, list("zab"), [None, "B-W", "I-X"]), (7, list("ab"), ["X", "I-W"])]
    found = C.lexicon_from_labels(spark.createDataFrame(rows, "doc_id int, chars array<string>, labels array<string>"))
    assert sorted(map(tuple, found.collect())) == [("a", "W", 1), ("ab", "W", 2), ("b", "W", 1), ("é", "V", 1)]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert C.lexicon_from_labels(spark.createDataFrame(rows[1:4], "doc_id int, chars array<string>, labels array<string>")).collect() == []


def test_key_match_join_deals_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(J, "KEY_BLOCK", 10)
    left = spark.range(300).selectExpr("id", "CASE WHEN id < 200 THEN 'hot' WHEN id < 290 THEN 'k' || id END AS k", "map('a', id) AS m").drop("m")
    right = spark.createDataFrame([(i, "hot") for i in range(7)] + [(7, "k250"), (8, "none"), (9, None)], "rid int, k string")
    met = J.key_match_join(left, right, "k", "k")
    pairs = met.select("a.id", "b.rid")
    assert sorted(map(tuple, pairs.collect())) == sorted([(i, r) for i in range(200) for r in range(7)] + [(250, 7)])
    per_task = [r[0] for r in met.where("a.k = 'hot'").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(per_task) < 1400


@pytest.mark.parametrize("part", [10, 1000])
def test_key_match_join_in_rounds_repeats_few_values_at_a_time(spark, monkeypatch, tmp_path, part):
    monkeypatch.setattr(J, "KEY_PART", part, raising=False)
    left = spark.range(300).selectExpr("id", "CASE WHEN id < 200 THEN 'hot' WHEN id < 290 THEN 'k' || id END AS k")
    right = spark.createDataFrame([(i, "hot") for i in range(50)] + [(50, "k250"), (51, "none"), (52, None)], "rid int, k string")
    pairs = J.key_match_join(left, right, "k", "k", rounds=8).select("a.id", "b.rid")
    assert sorted(map(tuple, pairs.collect())) == sorted([(i, r) for i in range(200) for r in range(50)] + [(250, 50)])


def test_key_match_join_writes_pairs_in_little_space(spark, sf, tmp_path):
    from kgflow import catalog

    for name, key, n in (("customer", "c_custkey", 40), ("supplier", "s_suppkey", 12000)):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        rows = rows.limit(5).crossJoin(spark.range(n).withColumnRenamed("id", "r")).withColumn(key, F.col(key) + F.col("r") * 1000).withColumn(f"{name[0]}_nationkey", F.lit(3))
        rows.drop("r").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    catalog.QUERIES["key_match_join"](spark, str(tmp_path)).coalesce(1).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.distinct().count() == 200 * 60_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 200 * 60_000 / 2


def test_chains_are_dealt_into_tasks_that_grow_with_the_graph(spark, monkeypatch):
    n = spark.range(60).select(F.concat(F.lit("a"), "id").alias("node_id"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("node_type"))
    e = spark.range(0, 60, 2).select(F.lit("R").alias("relation_type"), F.concat(F.lit("a"), "id").alias("head"), F.concat(F.lit("a"), F.col("id") + 1).alias("tail"), F.lit(0.5).alias("confidence"))
    rule = I.MultiHop("T", (I.Step("edge", "x", "y", "R"), I.Step("edge", "y", "x", "R", "IN"), I.Step("edge", "x", "y", "R")))
    there = I.MultiHop("T", (I.Step("edge", "x", "y", "R"),))
    want = sorted(I.infer_multi_hop(n, e, there).collect())
    monkeypatch.setattr(I, "NODE_BLOCK", 1)
    monkeypatch.setattr(I, "SMALL_STEP", 0)
    got = I.infer_multi_hop(n, e, there)
    assert sorted(got.collect()) == want and len(want) == 30
    assert got.rdd.getNumPartitions() == 60
    assert I.infer_multi_hop(n, e, rule).count() == 0


def test_search_joins_no_positions_to_nodes(spark, monkeypatch, capsys):
    from kgflow.queries import misc

    class Seen(Exception):
        pass

    def search(requests, nodes, *rest):
        nodes.explain()
        raise Seen

    monkeypatch.setattr(misc.V, "search", search)
    with pytest.raises(Seen):
        misc.search(spark, "/root/testdata/sf0.001")
    assert "Join" not in capsys.readouterr().out


def test_records_become_nodes_in_one_pass(spark, sf):
    from kgflow import catalog

    plan = catalog.QUERIES["map_json_nodes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1
    rec = spark.createDataFrame([(1, '{"a":"x","b":{"c":[1]},"l":[{"p":1},2,{"q":" "}],"r":" "}', {"f": "g"}), (2, "no json", {"f": None}), (3, None, None), (4, '{"l":{},"r":"s"}', {})], "chunk_id long, json string, metadata map<string,string>")
    maps = [R.NodeMapping("whole", {"c": "b.c"}, {"f": "f"}, {"ac": (("a", "b.c[0]"), "/")}), R.NodeMapping("rest", {"a": "a"}, remaining="more"), R.NodeMapping("part", {"p": "p"}, remaining="q", array="l")]
    got = sorted(((r.chunk_id, r.element, r.node_type, r.attributes) for r in R.map_json_nodes(rec, maps).collect()), key=str)
    assert got == [(1, 0, "part", {"p": "1"}), (1, 0, "rest", {"a": "x"}), (1, 0, "whole", {"c": "[1]", "f": "g", "ac": "x/1"}), (4, 0, "rest", {"more": "r:s"})]


def test_texts_are_parsed_once_for_several_keys(monkeypatch):
    parsed = []
    decoder = T._DECODER

    class Counts:
        def decode(self, text):
            parsed.append(text)
            return decoder.decode(text)

    monkeypatch.setattr(T, "_DECODER", Counts())
    text = '{"a":{"k":1.50},"\\u006b\\u006b":["x"],"b":"a\\"b"}'
    assert T.find_keys(text, ["k", "kk", "none", "b", 'a"b']) == ["1.50", '["x"]', None, 'a"b', None] and len(parsed) == 1
    assert T.find_keys('{"a":1}', ["k", "none"]) == [None, None] and len(parsed) == 1  # neither stands in it
    assert [T.find_keys(x, ["k"]) for x in (None, "", '"k"', '{"k":1', '{"k":null}')] == [[None]] * 5
    wide = '{"k":' + "[" * 5000 + "1" + "]" * 5000 + ',"l":2}'
    assert T.find_keys(wide, ["l", "k"]) == ["2", "[" * 5000 + "1" + "]" * 5000]


@pytest.mark.parametrize("name", ["agg_merge_attributes", "agg_merge_descriptions", "agg_create_single"])
def test_tasks_of_nodes_grow_with_the_lines(spark, sf, monkeypatch, name):
    from kgflow.queries import merge as Q

    monkeypatch.setattr(Q, "LINE_BLOCK", 500, raising=False)
    plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    tasks = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    found = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(found) == 1 and f", {tasks})" in found[0]


def test_descriptions_are_of_the_attributes_of_the_first_node(spark):
    schema = "source_file string, chunk_id string, node_id string, node_type string, attributes map<string,string>, confidence double, ord long"
    rows = [("f", "c", str(i), t, a, 0.5, i) for i, (t, a) in enumerate([
        ("a", {"x": None, "y": "", "z": "2"}), ("a", {"x": "b", "y": "", "w": "late"}), ("a", {"x": "a", "z": "2"}), ("b", None), ("b", {"x": "1"}), ("c", {}), ("c", {"x": "1"}), ("d", {"x": ""}), ("e", {"x": "1"}), ("e", None),
    ])]
    got = {r.node_type: r.attributes for r in M.agg_merge_descriptions(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    assert got == {"a": {"x": "a；b", "z": "2"}, "e": {"x": "1"}}


def test_matches_of_a_batch_are_not_held_at_once(spark):
    """More texts than a slice of a batch has, with many matches each: in their order, null and empty ones among them."""
    rows = [(i, None if i % 7 == 0 else "" if i % 5 == 0 else "abab" * (i % 40)) for i in range(L.SLICE * 3 + 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    lexicon = spark.createDataFrame([("ab",), ("bab",)], "term string")
    want = sorted((i, s, s + len(w), w) for i, t in rows for w in ("ab", "bab") for s in range(len(t or "")) if t[s:].startswith(w))
    for most in (L.AUTOMATON_CHARS, 0):
        found = L.lexicon_match(docs, lexicon, most)
        assert sorted(map(tuple, found.collect())) == want
    left = L.resolve_overlaps(found)
    assert sorted((r.doc_id, r.start, r.end) for r in left.collect()) == [(i, s, s + 2) for i, t in rows for s in range(0, len(t or ""), 2)]
