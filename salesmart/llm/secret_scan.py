"""Secret scans: fixed patterns, and guess costs of values in credential context.

Three kinds of spans are found by pattern alone (``assign``, ``access``,
``hex``).  The fourth, ``guess``, looks at values that follow a wider set of
credential words and are not covered whole by one of the others.  In quotes a value
may hold any sign, blanks and letters of any script among them, up to the closing
quote on its line; without quotes it ends at a blank.  A dynamic program finds the
cheapest way to guess such a value as a chain of known words, dates, repeats,
keyboard walks and brute-force characters; values that cost more than
``LEAST_COST`` are reported.  Placeholders such as ``changeme`` or ``qwerty123`` stay
below, and so does any word of the language.

Words are ranked: a short fixed list of what is guessed first, then the words that
most documents hold, at most ``WORDS_KEPT`` of them, counted in Spark over all whole
texts.  What stands in the place of a value is not counted, so a password that is
copied into many documents does not become a word.

Null texts count as empty and have no spans.  Spans are in code points of the
whole text, end exclusive; repeated rows give repeated results.  Columns kept must
not be called like results or ``__text``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import arrow_text, ship, slices

KINDS = ("assign", "access", "hex", "guess")

# fixed patterns of the base kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")   # the maximal runs of 24 or more
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

# credential words before a value, and the values' form: to the closing quote, or to a sign before another key
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key"""
                     r"""|private[_-]?key|client[_-]?secret|credentials?)["']?\x20*[:=]\x20*(["']?)""",
                     re.IGNORECASE | re.ASCII)
VALUES = {'"': re.compile(r'(?:\\[^\r\n]|[^"\\\r\n])*(?=")'), "'": re.compile(r"(?:\\[^\r\n]|[^'\\\r\n])*(?=')")}
BARE = {'"': re.compile(r'(?:\\[^\s\x00-\x1F\x7F]|[^"\s\x00-\x1F\x7F])*'),
        "'": re.compile(r"(?:\\[^\s\x00-\x1F\x7F]|[^'\s\x00-\x1F\x7F])*"),
        "": re.compile(r"""(?:[^\s\x00-\x1F\x7F,&;]|[,&;](?!["']?[A-Za-z_][A-Za-z0-9_.-]*["']?\x20*[:=]))*""")}
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential")
LEAST_COST = 10.0     # log10 of guesses
ORDER = 0.3           # for each segment: they could come in another order
WORDS_KEPT, LEAST_DOCS = 20_000, 3
HELD = 200_000        # words in a task's counter before it is handed on
WORD = re.compile(r"[^\W\d_]{4,24}")      # letters of any script
LONGEST_PART = 64     # keys in one walk, or characters in a block said again; longer ones are several parts

# words tried first by guessers, in order of rank
WORDS = ("password", "admin", "welcome", "letmein", "login", "master", "dragon", "monkey", "shadow", "sunshine",
         "princess", "football", "baseball", "superman", "batman", "iloveyou", "trustno", "hello", "freedom",
         "whatever", "secret", "default", "changeme", "change", "example", "test", "guest", "root", "user", "pass",
         "token", "key", "none", "null", "true", "false", "your", "here", "insert", "replace", "placeholder",
         "redacted", "hidden", "string", "value", "required", "optional", "undefined", "enter", "please", "my",
         "the", "is", "not", "set", "this", "new", "old", "temp", "demo", "sample", "summer", "winter", "spring",
         "autumn", "monday", "friday", "january", "june", "july", "love", "money", "star", "blue", "black", "red",
         "green", "white", "angel", "tiger", "ninja", "mustang", "access", "computer", "internet", "server")
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")

_steps = {a + b for row in KEY_ROWS for a, b in zip(row + row[::-1], row[1:] + row[::-1][1:])} | {
    a + b for up, low in zip(KEY_ROWS[1:], KEY_ROWS[2:]) for x, y in zip(up, low) for a, b in ((x, y), (y, x))}
_plain = str.maketrans("@4301$5!7", "aaeoissit")
_date = re.compile(r"(19|20)\d\d(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])|(0[1-9]|[12]\d|3[01])(0[1-9]|1[0-2])(19|20)\d\d"
                   r"|(19|20)\d\d[-/.](0?[1-9]|1[0-2])[-/.](0?[1-9]|[12]\d|3[01])|(19|20)\d\d")


@dataclass
class Ranked:
    """Words by the order in which they are guessed, from 1."""

    rank: dict[str, int]
    longest: int

    @classmethod
    def of(cls, further: Iterable[str] = ()) -> Ranked:
        words = dict.fromkeys([*WORDS, *further])
        return cls({w: i + 1 for i, w in enumerate(words)}, max(map(len, words)))


FIXED = Ranked.of()


def _brute(c: str) -> float:
    """log10 of the alphabet a character comes from; between words a blank is expected."""
    return math.log10(3 if c == " " else 10 if c.isdigit() else 26 if c.isalpha() else 33)


def _said_again(value: str) -> np.ndarray:
    """(size, end): whether the block of that size before the end says the one before it again."""
    codes = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    n = len(codes)
    out = np.zeros((min(n // 2, LONGEST_PART) + 1, n + 1), bool)
    for size in range(2, len(out)):
        same = np.concatenate([[0], np.cumsum(codes[size:] == codes[:-size])])
        out[size, 2 * size:] = same[size:] - same[:-size] == size
    return out


def guess_cost(value: str, words: Ranked = FIXED) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses for the cheapest segmentation, and that segmentation.

    Cost of a chain: the sum of its segments' logarithms, and ``ORDER`` for each
    segment, a run of brute-force characters being one.
    """
    n = len(value)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)      # one character for one
    plain = low.translate(_plain)
    run = [0] * n          # by character, where its run of equal characters starts,
    walk = [0] * n         # and its run of neighbouring keys
    for i in range(1, n):
        run[i] = run[i - 1] if value[i] == value[i - 1] else i
        walk[i] = walk[i - 1] if low[i - 1:i + 1] in _steps else i
    dates: dict[int, list[int]] = {}
    for i in range(n):
        m = _date.match(value, i)
        if m:
            dates.setdefault(m.end(), []).append(i)
    again = _said_again(value)
    never = (math.inf, 0, "", 0)
    # by end, the cheapest chains whose last segment is brute force, and is not: cost, start, kind, and which went before
    chains: list[tuple[tuple, tuple]] = [(never, (0.0, 0, "", 0))]
    for j in range(1, n + 1):
        parts: list[tuple[int, str, float]] = []
        for i in range(max(0, j - words.longest), j - 1):
            for text, extra in ((low, 0.0), (plain, 0.5)):
                rank = words.rank.get(text[i:j])
                if rank:
                    case = 0.0 if value[i:j] == low[i:j] else 0.3 if value[i:j].istitle() else 0.8
                    parts.append((i, "word", math.log10(rank + 1) + case + extra))
        if j == n or value[j] != value[j - 1]:
            parts += [(i, "repeat", _brute(value[i]) + math.log10(j - i)) for i in range(run[j - 1], j - 2)]
        for i in range(max(walk[j - 1], j - LONGEST_PART), j - 2):
            parts.append((i, "walk", math.log10(47) + (j - i - 1) * math.log10(1.7)))
        for i in dates.get(j, ()):
            parts.append((i, "date", math.log10(365 * 120 if j - i > 4 else 120)))
        parts += [(j - int(size), "repeat", math.log10(n)) for size in np.flatnonzero(again[:, j])]
        one = _brute(value[j - 1])
        brute = min((chains[j - 1][0][0] + one, j - 1, "brute", 0), (chains[j - 1][1][0] + one + ORDER, j - 1, "brute", 1))
        whole = min(((chains[i][k][0] + cost + ORDER, i, kind, k) for i, kind, cost in parts for k in (0, 1)),
                    default=never)
        chains.append((brute, whole))
    chain, j = [], n
    k = 0 if chains[n][0][0] < chains[n][1][0] else 1
    total = chains[n][k][0]
    while j:
        _, i, kind, before = chains[j][k]
        if kind == "brute" and chain and chain[-1][0] == "brute" and chain[-1][1] == j:
            chain[-1] = ("brute", i, chain[-1][2])
        else:
            chain.append((kind, i, j))
        j, k = i, before
    return total, chain[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three pattern kinds."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _taken(text: str, take: Callable[[int, int], str]) -> list[tuple[int, int]]:
    """The values after credential words that ``take`` calls found.

    What lies within a value that is found, or that ``take`` calls known, is not
    looked at again unless it goes beyond; what is cheap may hold further values.
    """
    out: list[tuple[int, int]] = []
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return out
    done = fence = 0      # ends of what is found already, and of the last quoted value
    for m in CONTEXT.finditer(text):      # only up to the value, which may hold further words
        quote, start = m.group(1), m.end()
        if start < done and not quote:
            continue      # the rest of a value that is found
        limit = fence if start < fence else len(text)
        closed = VALUES[quote].match(text, start, min(limit + 1, len(text))) if quote else None
        if closed:
            value, end = closed.group(), closed.end()
            fence = max(fence, end)
        else:
            value = BARE[quote].match(text, start, limit).group().rstrip("\"',;.)\u2019\u201d\u00bb\u3002")
            end = start + len(value)
        if len(value) >= 8 and end > done:
            verdict = take(start, end)
            out += [(start, end)] if verdict == "found" else []
            done = done if verdict == "cheap" else end
    return out


def guessed_spans(text: str, base: list[tuple[int, int, int]], least_cost: float,
                  words: Ranked = FIXED) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of costly values in credential context that no base span covers whole."""
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))     # the farthest end of the spans up to each

    def take(start: int, end: int) -> str:
        before = bisect_right(starts, start)
        if before and ends[before - 1] >= end:
            return "known"
        return "found" if guess_cost(text[start:end], words)[0] >= least_cost else "cheap"
    return [(start, 3, end) for start, end in _taken(text, take)]


# -- words of the language -------------------------------------------------------

def ranked_words(docs: DataFrame, text: str = "text", bound: int = WORDS_KEPT, least_docs: int = LEAST_DOCS) -> Ranked:
    """The fixed words, then at most ``bound`` words that at least ``least_docs`` documents hold, most documents first.

    Runs at once, over all texts; only the ranked words come to the driver.
    """
    ship(docs.sparkSession)

    def count(batches):
        held: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out
        for part in slices(batches, "__text"):
            for value in arrow_text(part.column("__text")).to_pylist():
                held.update(_words_of(value))
            if len(held) > HELD:
                yield rows()
        if held:
            yield rows()
    counted = docs.select(F.col(text).alias("__text")).mapInArrow(count, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n"))
    best = counted.where(F.col("n") >= least_docs).orderBy(F.desc("n"), "word").limit(bound)
    return Ranked.of(r.word for r in best.collect())


def _words_of(text: str) -> set[str]:
    """The words of a text, without those in the place of a value."""
    for start, end in reversed(_taken(text, lambda start, end: "found")):
        text = f"{text[:start]} {text[end:]}"
    return set(WORD.findall(text.lower()))


# -- tables ------------------------------------------------------------------------

def listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, keep: list[str], text: str = "text", least_cost: float = LEAST_COST,
                 words: Ranked | None = None) -> DataFrame:
    """Per document the columns ``keep``, counts per base kind, a digest of the base spans, and all spans.

    Words that are not given are counted in ``docs`` first.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words or ranked_words(docs, text))    # at most WORDS_KEPT

    def scan(batches):
        for part in slices(batches, "__text"):
            rows = []
            for value in arrow_text(part.column("__text")).to_pylist():
                base = base_spans(value)
                every = sorted(base + guessed_spans(value, base, least_cost, shared.value))
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)),
                             hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            n_assign, n_access, n_hex, digest, spans = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(n_assign, pa.int64()), pa.array(n_access, pa.int64()),
                 pa.array(n_hex, pa.int64()), pa.array(digest), pa.array(spans)],
                names=[*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = chosen.schema
    for name, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"),
                       ("spans", "string")):
        schema = schema.add(name, kind)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text")).mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, mask: str = "[secret]", least_cost: float = LEAST_COST,
                   words: Ranked | None = None) -> DataFrame:
    """Every document, its secrets in ``text`` replaced; overlapping spans are replaced as one.

    ``n_chars`` follows the text where there is such a column; null texts stay null.
    Words that are not given are counted in ``docs`` first.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words or ranked_words(docs))    # at most WORDS_KEPT
    names = docs.columns

    def redact(batches):
        for part in slices(batches):
            out = []
            for value in part.column("text").to_pylist():
                base = base_spans(value or "")
                spans = sorted(base + guessed_spans(value or "", base, least_cost, shared.value))
                if spans:
                    pieces, at, until = [], 0, -1
                    for start, _, end in spans:
                        if start >= until:
                            pieces += [value[at:start], mask]
                        at = until = max(until, end)
                    value = "".join(pieces) + value[at:]
                out.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()) if c == "text" else part.column(c) for c in names], names=names)

    result = docs.mapInArrow(redact, docs.schema)
    if "n_chars" in names:
        result = result.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType))
    return result
