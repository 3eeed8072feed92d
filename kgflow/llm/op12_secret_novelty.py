"""Secret scans: patterns of known kinds, and strings that zstandard cannot explain from what surrounds them.

A document is scanned once.  Base patterns give their spans.  Candidates are runs of key characters
a few characters behind a sensitive word; each keeps the code around it.  The words of all these
surroundings, counted by documents over the whole corpus, fill an identifier dictionary.  A
candidate's novelty is its marginal compressed size: the bytes that zstandard, primed with the
dictionary, needs for the surroundings with the candidate beyond those without it, for each
character.  Names, paths and phrases repeat the dictionary or the code; keys do not compress.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.llm.common import Scratch, lean, table

# Base patterns and the least length of what they must match, by kind.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]{12,}")  # a run of 16 characters or more
_HEX = re.compile("[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
#: Words that the assign pattern begins with, any of which a text must have.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make what follows them sensitive.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "access-key", "accesskey", "private_key", "private-key", "client_key", "signing_key", "credential", "authorization", "bearer", "signature", "session_id", "webhook")

#: Characters between a sensitive word and a candidate.
GAP = 48
#: Characters of a candidate at least.
MIN_CHARS = 12
#: Characters of code kept on either side of a candidate.
AROUND = 128
#: Words of the identifier dictionary, of 24 letters at most each: 100 KB is its bound.
DICTIONARY_WORDS = 4096
#: Marginal compressed bytes for each character from which a candidate is a secret.
NOVELTY = 0.85
LEVEL = 12

_SENSITIVE = re.compile("|".join(SENSITIVE), re.I | re.A)
_VALUE = re.compile(r"(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_~-][A-Za-z0-9+/_.~-]{%d,}={0,2}" % (MIN_CHARS - 1))
_DIGIT, _SMALL, _CAPITAL = map(re.compile, ("[0-9]", "[a-z]", "[A-Z]"))


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the matches of the base patterns, in that order; low is the text in lower case."""
    found = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def looks_keyed(value: str) -> bool:
    """Whether a run has three letters and, besides, digits or capitals behind small letters."""
    small = _SMALL.search(value)
    mixed = _DIGIT.search(value) or small and _CAPITAL.search(value, small.end())
    return bool(mixed) and sum(map(str.isalpha, value)) >= 3


def candidates(text: str, low: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that begin up to GAP characters behind a sensitive word and touch no base span."""
    if not any(w in low for w in SENSITIVE):
        return []
    starts = set()
    for m in _SENSITIVE.finditer(text):
        starts.update(v.start() for v in _VALUE.finditer(text, m.end(), m.end() + GAP + MIN_CHARS))
    taken, upto = [], -1  # base spans, those that overlap as one
    for s, _, e in base:
        if s < upto:
            taken[-1][1] = upto = max(upto, e)
        else:
            taken.append([s, e])
            upto = e
    out, last = [], 0
    for s in sorted(starts):
        if s < last:
            continue
        value = _VALUE.match(text, s)[0].rstrip(".")
        at = bisect.bisect_left(taken, [s + len(value)]) - 1
        if len(value) >= MIN_CHARS and (at < 0 or taken[at][1] <= s) and looks_keyed(value):
            out.append((s, last := s + len(value)))
    return out


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("novelty", pa.float64())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string())])
_SPAN_DDL = "struct<kind: int, start: long, end: long, text: string, novelty: double>"
_SCAN_DDL = f"doc_id long, spans array<{_SPAN_DDL}>, candidates array<struct<start: long, end: long, value: string, before: string, after: string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, found = [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            low = text.lower()
            base = base_spans(text, low)
            spans.append([{"kind": k, "start": s, "end": e, "text": text[s:e], "novelty": None} for s, k, e in base])
            found.append([{"start": s, "end": e, "value": (v := text[s:e]), "before": text[max(0, s - AROUND) : s].replace(v, ""), "after": text[e : e + AROUND].replace(v, "")} for s, e in candidates(text, low, base)])
        yield pa.record_batch([batch.column(0), pa.array(spans, pa.list_(_SPAN)), pa.array(found, pa.list_(_CANDIDATE))], names=["doc_id", "spans", "candidates"])


class Novelty:
    """Marginal compressed bytes for each character, given a dictionary of words, the most frequent first."""

    def __init__(self, words: list[str], level: int = LEVEL):
        raw = "\n".join([*reversed(words), *SENSITIVE]).encode()  # what comes last is nearest
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode()))

    def of(self, value: str, before: str, after: str) -> float:
        return (self.size(before + value + after) - self.size(before + after)) / len(value.encode())


def _judge(words: list[str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for batch in batches:
            spans = batch.column(1).to_pylist()
            for own, found in zip(spans, batch.column(2).to_pylist(), strict=True):
                for c in found:
                    if (n := novelty.of(c["value"], c["before"], c["after"])) >= least:
                        own.append({"kind": 3, "start": c["start"], "end": c["end"], "text": c["value"], "novelty": n})
                if found:
                    own.sort(key=lambda s: (s["start"], s["kind"]))
            yield pa.record_batch([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return run


def identifier_dictionary(scanned: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The words around candidates, those of most documents first; ``words`` of them at most."""
    around = F.flatten(F.transform("candidates", lambda c: F.regexp_extract_all(F.lower(F.concat_ws(" ", c["before"], c["after"])), F.lit("([a-z]{3,24})"))))
    counted = scanned.where(F.size("candidates") > 0).select(F.explode(F.array_distinct(around)).alias("word")).groupBy("word").count()
    return [r.word for r in counted.orderBy(F.desc("count"), "word").limit(words).collect()]


def find_secrets(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY) -> DataFrame:
    """doc_id and spans for every row of docs: array of (kind, start, end, text, novelty), by start, then kind as in KINDS.

    Starts and ends are code points, ends exclusive.  Base kinds hold what their patterns match, leftmost and without
    overlap within a kind: ``assign`` a name and a value of 8 characters or more, ``access`` and ``hex`` long runs.
    ``novel`` spans are candidates of that novelty or more; they overlap no base span and have a novelty, others a null.

    A null or empty text has no spans.  Rows that repeat an id come out once each, a null id stays null, an empty
    table gives an empty one, and other columns do not matter.  Very long texts are scanned whole, in one task.
    The table that the result reads belongs to ``scratch``; the dictionary, whose size is bounded, goes to every task.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = scratch.write(source.mapInArrow(lean(_scan), _SCAN_DDL), "secrets")
    judged = scanned.mapInArrow(lean(_judge(identifier_dictionary(scanned), novelty)), f"doc_id long, spans array<{_SPAN_DDL}>")
    name = F.array(*map(F.lit, KINDS))
    return judged.select("doc_id", F.transform("spans", lambda s: s.withField("kind", F.get(name, s["kind"]))).alias("spans"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), Scratch(spark))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
