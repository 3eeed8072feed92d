"""Lexicon tagging: matches, overlaps, nearest roots, attributes, phrases, tags.

Texts lose all white space first; positions count what is left.  A lexicon is a table of terms.  One of a bounded size
becomes an automaton that reads each text once; a larger one meets the windows of the texts in a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgflow.functions.text import SENTENCE_ENDS


def normalise(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.regexp_replace("text", r"(?U)\s+", "").alias("text"))


def scan_lexicon(rows: DataFrame, last_wins: bool) -> DataFrame:
    """rows(ord, term, canonical, category), trimmed: the last row of each term, or all its categories as an array."""
    clean = rows.select("ord", *[F.trim(F.regexp_replace(c, "﻿", "")).alias(c) for c in ("term", "canonical", "category")]).where("term <> ''")
    if last_wins:
        return clean.groupBy("term").agg(F.max_by("canonical", "ord").alias("canonical"), F.max_by("category", "ord").alias("category"))
    return clean.groupBy("term").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def assert_disjoint(root: DataFrame, attr: DataFrame) -> DataFrame:
    """The terms that both lexicons have; there should be none."""
    return root.select("term").intersect(attr.select("term"))


#: Characters of all terms together up to which a lexicon becomes an automaton: some 60 MB, which every worker holds.
AUTOMATON_CHARS = 1_000_000


#: Rows of an Arrow batch that are Python objects at once.
SLICE = 64


def _slices(batch: pa.Array) -> Iterator[list]:
    for at in range(0, len(batch), SLICE):
        yield batch.slice(at, SLICE).to_pylist()


def _spans(texts: Iterable[list[tuple[int, str]]]) -> pa.Array:
    """array<struct(start, term)> of a list of (start, term) for each text."""
    offsets, starts, terms = [0], [], []
    for found in texts:
        for start, term in found:
            starts.append(start)
            terms.append(term)
        offsets.append(len(starts))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(terms, pa.string())], ["start", "term"]))


class Automaton:
    """Terms as a trie with failure links: one pass over a text finds all of them, however many and however long."""

    def __init__(self, spark: SparkSession, terms: Iterable[str]):
        made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for term in filter(None, terms):
            made.add_word(term)
        made.make_automaton()
        self.shared = spark.sparkContext.broadcast(made) if len(made) else None

    def matches(self, text: Column) -> Column:
        """array<struct(start, term)> of every occurrence, by where it ends, longer terms first."""
        shared = self.shared

        @F.arrow_udf("array<struct<start:int,term:string>>")
        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            hits = shared.value.iter if shared else lambda t: ()
            for batch in batches:
                for texts in _slices(batch):
                    yield _spans([(end + 1 - n, t[end + 1 - n : end + 1]) for end, n in hits(t)] if t else [] for t in texts)

        return found(text)

    def terms_in(self, text: Column) -> Column:
        """The distinct terms that a text has."""
        return F.array_distinct(F.transform(self.matches(text), lambda m: m["term"]))


def automaton(lexicon: DataFrame, most: int = AUTOMATON_CHARS) -> Automaton | None:
    """The automaton of lexicon(term), if its terms have ``most`` characters or fewer together; they go to the driver then."""
    terms = lexicon.select("term").where("term <> ''").distinct()
    if (terms.agg(F.sum(F.length("term"))).first()[0] or 0) > most:
        return None
    return Automaton(lexicon.sparkSession, [r.term for r in terms.collect()])


def lexicon_match(docs: DataFrame, lexicon: DataFrame, most: int = AUTOMATON_CHARS) -> DataFrame:
    """docs(doc_id, text), lexicon(term): (doc_id, start, end, term) of every occurrence, overlapping ones too.

    A lexicon of ``most`` characters or fewer goes to every worker as an automaton, and each text is read once.  One
    beyond that stays a table: texts become windows of the lengths that terms have, which meet it by term.  Empty terms
    and null texts match nothing.
    """
    known = automaton(lexicon, most)
    rows = docs.select("doc_id", F.explode((known.matches if known else _windows(lexicon))(F.col("text"))).alias("w")).select("doc_id", "w.start", "w.term")
    if not known:
        rows = rows.join(lexicon.select("term").distinct(), "term")
    return rows.select("doc_id", "start", (F.col("start") + F.length("term")).alias("end"), "term")


def terms_in(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """docs(doc_id, text): (doc_id, term), once for each pair; the terms are a list of the driver's, of any size."""
    if sum(map(len, terms)) <= AUTOMATON_CHARS:
        known = Automaton(docs.sparkSession, terms)
        return docs.select("doc_id", F.explode(known.terms_in(F.col("text"))).alias("term")).distinct()
    return lexicon_match(docs, docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")).select("doc_id", "term").distinct()


def _windows(lexicon: DataFrame) -> Callable[[Column], Column]:
    """The windows of a text that are as long as some term; there are as many lengths as the longest term has characters at most."""
    lengths = [r[0] for r in lexicon.where("term <> ''").select(F.length("term")).distinct().collect()]

    @F.arrow_udf("array<struct<start:int,term:string>>")
    def windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in _slices(batch):
                yield _spans([(i, t[i : i + n]) for i in range(len(t)) for n in lengths if i + n <= len(t)] if t else [] for t in texts)

    return windows


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """Greedy from the left: the longest span at the earliest start stays, what overlaps it goes."""

    def stay(starts: list[int], ends: list[int]) -> list[int]:
        last, places = 0, []
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            if a >= last:
                places.append(i)
                last = b
        return places

    @F.arrow_udf("array<int>")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for starts, ends in batches:
            for s, e in zip(_slices(starts), _slices(ends), strict=True):
                yield pa.array([stay(*x) for x in zip(s, e, strict=True)], pa.list_(pa.int32()))

    first = spans.groupBy("doc_id", "start").agg(F.min(F.struct((F.col("start") - F.col("end")).alias("neg"), "term")).alias("s"))
    docs = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") - F.col("s.neg")).alias("end"), "s.term"))).alias("s"))
    places = F.explode(kept(F.transform("s", lambda x: x["start"].cast("int")), F.transform("s", lambda x: x["end"].cast("int"))))
    return docs.select("doc_id", "s", places.alias("i")).select("doc_id", F.get("s", F.col("i")).alias("x")).select("doc_id", F.col("x.start").cast("int").alias("start"), F.col("x.end").cast("int").alias("end"), "x.term")


def sentence_ids(rows: DataFrame, docs: DataFrame, at: Column) -> DataFrame:
    """Adds ``sid``: how many sentence ends stand before the position ``at`` of each row(doc_id, ...).

    The ends of a text are found once; rows and ends then pass in the order of their places, so long texts cost no more a row.
    """
    between = F.transform(F.split("text", f"[{SENTENCE_ENDS}]"), lambda x: F.length(x) + 1)
    pieces = docs.select("doc_id", F.posexplode(F.slice(between, F.lit(1), F.size(between) - 1)).alias("i", "n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = pieces.select("doc_id", (upto - 1).cast("double").alias("__at"), F.lit(1).alias("__end"))
    both = rows.select("*", F.floor(at).cast("double").alias("__at"), F.lit(0).alias("__end")).unionByName(ends, allowMissingColumns=True)
    before = Window.partitionBy("doc_id").orderBy("__at", "__end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("sid", F.sum("__end").over(before)).where("__end = 0").drop("__at", "__end")


#: Characters of a position bin in which attributes meet roots.
BIN = 64


def assign_nearest(roots: DataFrame, attrs: DataFrame, docs: DataFrame, window: int = 12) -> DataFrame:
    """attrs with the start of the root they belong to, NULL for those of the whole block.

    A root is near if its span, ``window`` characters wider on both sides, holds the attribute's centre.
    The nearest centre wins; of equals one of the same sentence, then the earliest.
    """
    centre = (F.col("start") + F.col("end")) / 2
    bin_of = lambda c: F.floor(c / BIN)
    placed = sentence_ids(attrs.select("doc_id", "start", "end", "term", centre.alias("c")), docs, F.col("c")).withColumn("bin", bin_of(F.col("c")))
    r = sentence_ids(roots.select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), centre.alias("rc")), docs, F.col("r_start")).withColumnRenamed("sid", "rsid")
    r = r.withColumn("bin", F.explode(F.sequence(bin_of(F.col("r_start") - window), bin_of(F.col("r_end") + window))))
    met = placed.join(r, ["doc_id", "bin"]).where((F.col("c") >= F.col("r_start") - window) & (F.col("c") <= F.col("r_end") + window))
    best = met.groupBy("doc_id", "start").agg(F.min(F.struct(F.abs(F.col("c") - F.col("rc")).alias("dist"), (F.col("sid") != F.col("rsid")).alias("other"), "r_start")).alias("b"))
    return attrs.join(best.select("doc_id", "start", F.col("b.r_start").alias("root_start")), ["doc_id", "start"], "left").select("doc_id", "start", "end", "term", "root_start")


def aggregate_attrs(assigned: DataFrame, categories: DataFrame) -> DataFrame:
    """categories(term, categories array): per root a map of category to its distinct terms in the order of the text."""
    rows = assigned.where("root_start IS NOT NULL").join(categories, "term", "left")
    rows = rows.select("doc_id", "root_start", "start", "term", F.explode(F.when(F.coalesce(F.size("categories"), F.lit(0)) > 0, F.col("categories")).otherwise(F.array(F.lit("unknown")))).alias("category"))
    first = rows.groupBy("doc_id", "root_start", "category", "term").agg(F.min("start").alias("at"))
    lists = first.groupBy("doc_id", "root_start", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("terms"))
    return lists.groupBy("doc_id", "root_start").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "terms")))).alias("attributes"))


def assemble_phrases(roots: DataFrame, docs: DataFrame, connectors: Sequence[str], rock: str, layer: str, gap: int = 6) -> DataFrame:
    """roots(doc_id, start, end, term, category): per sentence the first two neighbouring rocks with a connector
    between them, led by the sentence's first layer where that ends at most ``gap`` characters before."""
    placed = sentence_ids(roots, docs, F.col("start"))
    w = Window.partitionBy("doc_id", "sid").orderBy("start")
    rocks = placed.where(F.col("category") == rock).select("*", F.lead("start").over(w).alias("b_start"), F.lead("term").over(w).alias("b_term"))
    rocks = rocks.where("b_start IS NOT NULL").join(docs.select("doc_id", "text"), "doc_id")
    between = F.substring("text", F.col("end") + 1, F.col("b_start") - F.col("end"))
    conn = F.coalesce(*[F.when(F.contains(between, F.lit(c)), F.lit(c)) for c in connectors])
    pairs = rocks.withColumn("conn", conn).where("conn IS NOT NULL")
    first = pairs.groupBy("doc_id", "sid").agg(F.min_by(F.struct("start", "term", "conn", "b_term"), "start").alias("p"))
    layers = placed.where(F.col("category") == layer).groupBy("doc_id", "sid").agg(F.min_by(F.struct("end", "term"), "start").alias("l"))
    met = first.join(layers, ["doc_id", "sid"], "left")
    room = F.col("p.start") - F.col("l.end")
    prefix = F.when((room >= 0) & (room <= gap), F.col("l.term")).otherwise("")
    return met.select("doc_id", "sid", F.concat(prefix, "p.term", "p.conn", "p.b_term").alias("phrase"))


def render_tags(phrases: DataFrame, roots: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per document its distinct tags: phrases, then each root with its attributes, then those of the block."""
    rank = lambda k, a, b: F.struct(F.lit(k).alias("k"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    tags = phrases.select("doc_id", rank(0, F.col("sid"), F.lit(0)).alias("r"), F.col("phrase").alias("tag"))
    tags = tags.union(roots.select("doc_id", rank(1, F.col("start"), F.lit(-1)), "term"))
    tags = tags.union(assigned.where("root_start IS NOT NULL").select("doc_id", rank(1, F.col("root_start"), F.col("start")), "term"))
    tags = tags.union(assigned.where("root_start IS NULL").select("doc_id", rank(2, F.col("start"), F.lit(0)), "term"))
    first = tags.groupBy("doc_id", "tag").agg(F.min("r").alias("r"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]).alias("tags"))
