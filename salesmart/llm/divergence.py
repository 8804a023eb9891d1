"""How a source's words differ from its language's and from other sources'.

Terms are runs of letters (ASCII letters, and everything beyond ASCII), A-Z
lower-cased.  A language keeps the terms that stand in at least ``LEAST_DOCS``
of its documents.  With N occurrences of V kept terms, a term's share is
``1 + floor(10**9 * (count + 2) / (N + 2 V))``, and two shares p and q differ by
``floor((p - q)**2 / (p + q))``.  All of it is integer arithmetic.

*Terms.*  The divergence of a term that a source over-uses grows with its count
there and falls with its count in the language, and ties go to the earlier
UTF-8.  So whatever has k terms that are no worse in all three (a higher or
equal count, a lower or equal count in the language, an earlier name) is not
among the k best.  Every partition keeps its k-skyband, the terms with fewer
than k such dominators; skybands are merged, twice, and only what is left is
scored.  No group is ever ranked whole.

*Pairs.*  Most terms are absent from most sources, so a pair's sum is taken
from what two absences give, corrected for the terms of either source (by the
histogram of its counts) and for the terms that both have (by matrices over
blocks of sources, in tasks that each hold a part of the terms).

Null texts, languages and sources count as empty; a row is a document, also when
ids repeat.  A language without kept terms gives pairs of value 0 and no terms.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from salesmart.llm.common import arrow_text, ship, slices
from salesmart.session import cut

LEAST_DOCS = 10
TOP = 10
#: entries of a task's dictionary before it is handed on
HELD = 200_000
#: sources in a block; a task holds one square of that side
SIDE = 256
#: points compared at once, and parts of a group in the first merge
BLOCK, PARTS = 512, 64
PIECE = 4 << 20

_byte = np.arange(256)
_letter = ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
#: letters lower-cased, all else a blank
LETTERS = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, np.where(_letter, _byte, 32)).astype(np.uint8).tobytes()


# -- counting --------------------------------------------------------------

def _term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a few megabytes at a time."""
    text = text.translate(LETTERS)
    start = 0
    while len(text) - start > PIECE:
        end = text.rfind(b" ", start, start + PIECE)
        end = text.find(b" ", start + PIECE) if end <= start else end
        if end < 0:
            break
        yield text[start:end].split()
        start = end
    yield (text[start:] if start else text).split()


def _count_terms(batches):
    """Occurrences and documents of every (language, source, term), summed within the task."""
    occurrences: dict[tuple, Counter] = {}
    documents: dict[tuple, Counter] = {}

    def rows():
        for (lang, source), counts in occurrences.items():
            terms = list(counts)
            within = documents[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in terms], pa.int64()),
                 pa.array([within[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "d"])
        occurrences.clear()
        documents.clear()

    for batch in batches:
        for part in slices([batch]):
            texts = arrow_text(part.column("text")).cast(pa.binary()).to_pylist()
            for text, *key in zip(texts, part.column("lang").to_pylist(), part.column("source").to_pylist()):
                counts = occurrences.setdefault(tuple(key), Counter())
                here = set()
                for terms in _term_lists(text):
                    counts.update(terms)
                    here.update(terms)
                documents.setdefault(tuple(key), Counter()).update(here)
            if sum(map(len, occurrences.values())) > HELD:
                yield from rows()
    yield from rows()


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Counts of each kept term per (lang, source) that has it, and ``total``, its count in the language.

    ``first`` marks one row per term of a language.  Counts are summed within
    tasks, then by (lang, term); all that a language needs lies together there.
    """
    ship(docs.sparkSession)
    found = docs.select("text", *_group(docs)).mapInArrow(
        _count_terms, "lang string, source string, term string, n long, d long")
    # partitioned by (lang, term), both groupings need no other exchange
    counts = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"))
    term = W.partitionBy("lang", "term")
    return cut(counts.withColumns({
        "total": F.sum("n").over(term), "_docs": F.sum("d").over(term),
        "first": F.row_number().over(term.orderBy("source")) == 1,
    }).where(F.col("_docs") >= least_docs).select("lang", "source", "term", "n", "total", "first"))


def _group(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) with its occurrences, the language's, the language's terms, and a number."""
    groups = docs.select(*_group(docs)).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.sum(F.col("first").cast("long")).alias("kinds"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1   # one row a source
    joined = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    return cut(joined.na.fill(0, ["size", "lang_size", "kinds"]).withColumn("number", number))


def share(count: Column, size: Column, kinds: Column) -> Column:
    """``1 + floor(10**9 (count + 2) / (size + 2 kinds))``, by long division in base 1000."""
    whole = size + 2 * kinds
    digits, rest = F.lit(0).cast("long"), count + 2
    for _ in range(3):
        digits = digits * 1000 + _div(rest * 1000, whole)
        rest = (rest * 1000) % whole
    return digits + 1


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


# -- the terms that a source over-uses --------------------------------------

def _band(high: np.ndarray, low: np.ndarray, seen: list[np.ndarray], k: int) -> np.ndarray:
    """Which points, in the order of their names, fewer than k earlier ones dominate.

    ``seen`` holds (high, low) of the skyband so far, which is all that has to be
    compared: whatever it has dropped has k dominators in it.
    """
    keep = np.zeros(len(high), bool)
    for start in range(0, len(high), BLOCK):
        h, l = high[start:start + BLOCK], low[start:start + BLOCK]
        above = ((seen[0] >= h[:, None]) & (seen[1] <= l[:, None])).sum(axis=1)
        live = np.flatnonzero(above < k)
        h, l = h[live], l[live]
        own = np.tril((h >= h[:, None]) & (l <= l[:, None]), -1).sum(axis=1)
        stay = above[live] + own < k
        keep[start + live[stay]] = True
        seen[0], seen[1] = np.append(seen[0], h[stay]), np.append(seen[1], l[stay])
    return keep


def _new_runs(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for key in keys:
        codes = np.asarray(batch.column(key).dictionary_encode().indices)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _bands(keys: list[str], high: str, low: str, k: int):
    def keep(batches):
        held, seen = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _new_runs(batch, keys)
            h, l = (np.asarray(batch.column(c)) for c in (high, low))
            mask = np.zeros(batch.num_rows, bool)
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(batch.column(c)[int(a)].as_py() for c in keys)
                if key != held:
                    held, seen = key, [np.zeros(0, np.int64), np.zeros(0, np.int64)]
                mask[a:b] = _band(h[a:b], l[a:b], seen, k)
            yield batch.filter(pa.array(mask))
    return keep


def skyband(points: DataFrame, keys: list[str], high: str, low: str, name: str, k: int) -> DataFrame:
    """The points of each group that fewer than ``k`` others dominate.

    One point dominates another if its ``high`` is no lower, its ``low`` no
    higher, and its ``name`` earlier; names are distinct within a group.  The
    k best under any order that agrees with all three are among the result.

    Partitions find their own skybands, so that a group's first exchange moves
    few rows; the first merge deals a group over ``PARTS`` tasks, so that the
    last one reads at most that many skybands of it.
    """
    ship(points.sparkSession)
    keep = _bands(keys, high, low, k)

    def narrowed(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions(*keys, name).mapInArrow(keep, df.schema)
    part = F.pmod(F.xxhash64(name), F.lit(PARTS))
    return narrowed(narrowed(narrowed(points).repartition(*keys, part)).repartition(*keys))


def divergent_terms(kept: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` terms of each (lang, source) that it uses more than its language does."""
    band = skyband(kept.select("lang", "source", "term", "n", "total"), ["lang", "source"], "n", "total", "term", top)
    scored = band.join(totals, ["lang", "source"]).withColumns({
        "p": share(F.col("n"), F.col("size"), F.col("kinds")),
        "q": share(F.col("total"), F.col("lang_size"), F.col("kinds"))}).where("p > q")
    return _ranked(scored.select("lang", "source", F.col("term").alias("item"),
                                 divergence(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= top)


def _ranked(df: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(order))


# -- pairs of sources ---------------------------------------------------------

def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _add_common(square: np.ndarray, starts: np.ndarray, number: np.ndarray, p: np.ndarray, none: np.ndarray,
                crossed: bool) -> None:
    """Add what terms that both sources have change, for runs of rows of one term each."""
    ends = np.repeat(np.append(starts[1:], len(number)), np.diff(np.append(starts, len(number))))
    partners = ends - np.arange(len(number)) - 1
    upto = np.cumsum(partners)
    a = 0
    while a < len(number):
        b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + (1 << 20))), a + 1)
        left = np.repeat(np.arange(a, b), partners[a:b])
        before = np.repeat(upto[a:b] - partners[a:b] - (upto[a - 1] if a else 0), partners[a:b])
        right = left + 1 + np.arange(len(left)) - before
        if crossed:
            apart = number[left] // SIDE != number[right] // SIDE
            left, right = left[apart], right[apart]
        change = (_differ(p[left], p[right]) - _differ(p[left], none[right]) - _differ(none[left], p[right])
                  + _differ(none[left], none[right]))
        np.add.at(square, (number[left] % SIDE, number[right] % SIDE), change)
        a = b


def _common_terms(batches):
    """Sums over the terms that two sources share, for rows sorted by (lang, a, b, term, number)."""
    held, square, carry = None, None, None

    def rows():
        i, j = np.nonzero(square)
        if len(i):
            lang, a, b = held
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(i), pa.string()), pa.array(a * SIDE + i, pa.int32()),
                 pa.array(b * SIDE + j, pa.int32()), pa.array(square[i, j])], names=["lang", "a", "b", "common"])

    def add(batch):
        if held is not None and batch.num_rows:
            _add_common(square, _new_runs(batch, ["term"]),
                        *(np.asarray(batch.column(c)).astype(np.int64) for c in ("number", "p", "none")),
                        held[1] != held[2])
    for batch in batches:
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        starts = _new_runs(batch, ["lang", "block_a", "block_b", "term"])
        # the last term may go on in the next batch; it has at most two rows a source of a block
        carry, batch = batch.slice(int(starts[-1])), batch.slice(0, int(starts[-1]))
        for piece in _by_square(batch):
            key = tuple(piece.column(c)[0].as_py() for c in ("lang", "block_a", "block_b"))
            if key != held:
                if held is not None:
                    yield from rows()
                held, square = key, np.zeros((SIDE, SIDE), np.int64)
            add(piece)
    if carry is not None:
        key = tuple(carry.column(c)[0].as_py() for c in ("lang", "block_a", "block_b"))
        if key != held:
            if held is not None:
                yield from rows()
            held, square = key, np.zeros((SIDE, SIDE), np.int64)
        add(carry)
    if held is not None:
        yield from rows()


def _by_square(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        starts = _new_runs(batch, ["lang", "block_a", "block_b"])
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def source_pairs(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """For every (lang, source) all other sources of the language, the most divergent first."""
    ship(kept.sparkSession)
    nothing = share(F.lit(0).cast("long"), F.col("size"), F.col("kinds"))
    sources = totals.withColumn("none", F.when(F.col("kinds") > 0, nothing)).select(
        "lang", "source", "number", "size", "kinds", "none")
    counted = kept.join(sources, ["lang", "source"]).withColumn(
        "p", share(F.col("n"), F.col("size"), F.col("kinds")))

    # terms that both have: a square of sources at a time, the terms dealt over tasks
    squares = sources.groupBy("lang").agg(F.max(F.expr(f"number div {SIDE}")).alias("last"))
    block = F.expr(f"number div {SIDE}")
    dealt = counted.join(squares, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    dealt = dealt.select("lang", F.least(block, "other").alias("block_a"), F.greatest(block, "other").alias("block_b"),
                         "term", "number", "p", "none")
    common = dealt.repartition("lang", "block_a", "block_b", "term").sortWithinPartitions(
        "lang", "block_a", "block_b", "term", "number").mapInArrow(
        _common_terms, "lang string, a int, b int, common long").groupBy("lang", "a", "b").agg(
        F.sum("common").alias("common"))
    common = common.unionByName(common.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "common"))

    # terms that one has, as if the other had none: by the histogram of its counts
    histogram = cut(counted.groupBy("lang", F.col("number").alias("a"), "p", F.col("none").alias("none_a")).agg(
        F.count(F.lit(1)).alias("terms")))
    others = sources.select("lang", F.col("number").alias("b"), F.col("none").alias("none_b"))
    change = F.col("terms") * (divergence(F.col("p"), F.col("none_b")) - divergence(F.col("none_a"), F.col("none_b")))
    alone = histogram.join(others, "lang").groupBy("lang", "a", "b").agg(F.sum(change).alias("alone"))
    both = alone.unionByName(alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "alone"))
    changes = common.withColumnRenamed("common", "change").unionByName(
        both.withColumnRenamed("alone", "change")).groupBy("lang", "a", "b").agg(F.sum("change").alias("change"))

    mine = sources.select("lang", "source", F.col("number").alias("a"), "kinds", F.col("none").alias("none_a"))
    theirs = sources.select("lang", F.col("source").alias("item"), F.col("number").alias("b"),
                            F.col("none").alias("none_b"))
    pairs = mine.join(theirs, "lang").where("a <> b").join(changes, ["lang", "a", "b"], "left")
    value = F.col("kinds") * divergence(F.col("none_a"), F.col("none_b")) + F.coalesce("change", F.lit(0))
    return _ranked(pairs.select("lang", "source", "item", F.coalesce(value, F.lit(0)).cast("long").alias("value")))


def audit_sources(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Both parts: ``pair`` (all other sources of the language) and ``term`` (the ``top`` over-used terms)."""
    kept = kept_terms(docs, least_docs)
    totals = group_totals(docs, kept)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_pairs(kept, totals).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(divergent_terms(kept, totals, top).withColumn("part", F.lit("term")).select(*columns))
