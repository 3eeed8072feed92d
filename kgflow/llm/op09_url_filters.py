"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed one after another into the bits of a few 64-bit words.
One Shift-And step per byte of the canonical URL moves the state of every rule at
once; a batch of URLs moves together as a matrix of words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.llm.common import sql_ascii_lower, table


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}\0{self.path}*"


#: The rules of the production filter.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Rules of either kind that a filter takes: they are sent to every task.
MOST_RULES = 100_000
#: Bytes of automaton states that move at once.
STATES = 1 << 25


class GlobAutomaton:
    """Glob patterns ('*' any characters, '?' one character) as multiword Shift-And masks over UTF-8.

    Bit 0 of a pattern's field stands for "nothing read yet"; bit k for "the first k
    units match".  A unit is a byte or '?'; a '*' after unit k lets bit k loop on
    any byte, a '?' loops on the further bytes of its character.  The last bit tells
    a match of the whole string.
    """

    def __init__(self, globs: Sequence[str]):
        bits: list[tuple[frozenset, str]] = []  # (bytes that lead into the bit, what it loops on)
        first_bytes = frozenset(range(0x80)) | frozenset(range(0xC0, 0x100))
        starts, self.ends = [], []
        for glob in globs:
            starts.append(len(bits))
            bits.append((frozenset(), ""))
            for byte in glob.encode():
                if byte == ord("*"):
                    bits[-1] = (bits[-1][0], "*")
                else:
                    bits.append((first_bytes, "?") if byte == ord("?") else (frozenset([byte]), ""))
            self.ends.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.into = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        for i, (chars, loops) in enumerate(bits):
            word, bit = divmod(i, 64)
            on = slice(None) if loops == "*" else slice(0x80, 0xC0) if loops == "?" else slice(0)
            self.loop[on, word] |= np.uint64(1 << bit)
            self.into[sorted(chars), word] |= np.uint64(1 << bit)
        for i in starts:
            self.first[i // 64] |= np.uint64(1 << i % 64)

    def match(self, strings: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: strings by patterns."""
        at_once = max(1, STATES // (8 * self.words))
        if len(strings) > at_once:
            return np.concatenate([self.match(strings[i : i + at_once]) for i in range(0, len(strings), at_once)])
        n = len(strings)
        lengths = np.fromiter(map(len, strings), np.int64, n)
        order = np.argsort(-lengths, kind="stable")  # those that still have bytes come first
        flat = np.frombuffer(b"".join(strings[i] for i in order), np.uint8)
        lens = lengths[order]
        at = np.concatenate([[0], np.cumsum(lens)[:-1]]) if n else np.zeros(0, np.int64)
        state = np.tile(self.first, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for step in range(int(lens[0]) if n else 0):
            live = int(np.searchsorted(-lens[:live], -step, side="left"))
            s = state[:live]
            moved = s << one
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> top  # the carry from word to word
            byte = flat[at[:live] + step]
            state[:live] = (moved & self.into[byte]) | (s & self.loop[byte])
        out = np.empty((n, len(self.ends)), bool)
        for k, end in enumerate(self.ends):
            out[order, k] = (state[:, end // 64] >> np.uint64(end % 64)) & one != 0
        return out


def rules_of(table: DataFrame) -> list[Rule]:
    """table(verdict, host, path) as rules; more than MOST_RULES are refused, as every task holds them."""
    rows = table.select("verdict", "host", "path").distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted((Rule(*r) for r in rows), key=lambda r: (r.name, r.verdict))


def globs_of(table: DataFrame) -> list[tuple[str, str]]:
    """table(verdict, glob) as pairs, likewise."""
    rows = table.select("verdict", "glob").distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} globs")
    return sorted(map(tuple, rows))


def url_filter(urls: DataFrame, url_col: str = "url", rules: DataFrame | Sequence[Rule] = RULES, globs: DataFrame | Sequence[tuple[str, str]] = (), default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    The longest rule that fits decides (equally long ones by name); else the globs
    (verdict, glob over ``.host NUL path``) that match, of which a block goes before
    others; else ``default``.  Rules and globs may be tables of a bounded number of rows.
    A null URL, or one without ``://``, has an empty host and path.  Very long URLs are
    read whole, rows that repeat come out once each, and an empty table gives an empty
    one.  Columns of the input that have the names of added ones are replaced.
    """
    rules = rules_of(rules) if isinstance(rules, DataFrame) else list(rules)
    loose = globs_of(globs) if isinstance(globs, DataFrame) else list(globs)
    loose.sort(key=lambda g: (g[0] != "block", g))
    names, verdicts = [r.name for r in rules], [r.verdict for r in rules]
    ranked = sorted(range(len(rules)), key=lambda i: (-len(names[i]), names[i]))
    patterns = [rules[i].glob for i in ranked] + [g for _, g in loose]
    by_rank = np.array([verdicts[i] for i in ranked] + [v for v, _ in loose] + [default], object)

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = GlobAutomaton(patterns)
        for host, path in parts:
            strings = [b"." + h.encode() + b"\0" + p.encode() for h, p in zip(host, path, strict=True)]
            at_once, best = max(1, STATES // (8 * automaton.words)), np.zeros(len(strings), np.int64)
            for i in range(0, len(strings), at_once):
                hit = automaton.match(strings[i : i + at_once])
                best[i : i + at_once] = np.where(hit.any(axis=1), hit.argmax(axis=1) if hit.shape[1] else 0, len(patterns))
            yield pd.DataFrame({"rule": [names[ranked[b]] if b < len(ranked) else None for b in best.tolist()], "verdict": by_rank[best]})

    added = ("host", "path", "rule", "verdict")
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^?#]*", 0)
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = urls.select(*[c for c in urls.columns if c not in added], host.alias("host"), F.regexp_extract(rest, r"(?s)/.*$", 0).alias("path"))
    return split.withColumn("__judged", judge("host", "path")).select(*split.columns, "__judged.rule", "__judged.verdict")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "url")


_FITS = "('.' || host) LIKE '%.{host}' AND starts_with(path, '{path}')"
_RANKED = sorted(RULES, key=lambda r: (-len(r.name), r.name))
_CASES = " ".join(f"WHEN {_FITS.format(host=r.host, path=r.path)} THEN '{r.name}'" for r in _RANKED)
_VERDICTS = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in RULES)
SQL = f"""
WITH a AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^?#]*') ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, {sql_ascii_lower("regexp_extract(rest, '^[^/]*')")} AS host, regexp_extract(rest, '/.*$', 0, 's') AS path FROM a),
c AS (SELECT *, CASE {_CASES} END AS rule FROM b)
SELECT page_id, url, host, path, rule, CASE {_VERDICTS} ELSE 'allow' END AS verdict FROM c
"""
