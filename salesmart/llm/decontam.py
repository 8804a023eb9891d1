"""Benchmark decontamination: a BM25 index of the test items, searched by every passage.

Each text is cut into overlapping passages, for each class of item lengths of
their own: twice the class's longest length, moved on by that length, so an item
copied into a text lies whole in some passage.  A passage is a query; all items
are retrieved whose BM25 score reaches ``share`` of the score that the item's
own text would get.  Gains, scores divided by that threshold, must sum to one.

Search is block-max WAND with a pivot per item instead of one per query, as each
item has a threshold of its own.  An item's terms are ordered by gain, the rarest
first; the pivot is where the terms that come after cannot give more than
``BEHIND`` of the threshold together.  Only terms before the pivot are indexed,
so the frequent words of a passage meet no postings at all.  Items are kept in
blocks: the best gains that a block's items draw from a passage's words are summed
first, and a block that stays below what its items need is skipped.  Items of the
other blocks get their own sums, and only those that still can reach the threshold
are scored, over all their terms.  Bounds are never below the true score, so
nothing above the threshold is missed.

A retrieved item counts when at least ``overlap`` of its five-word shingles, of
the question and of the answer each, stand in the passage.  Words are runs of
letters and digits, ASCII case ignored.

Document frequencies and lengths are counted once over all items; how many items
an index holds, and how many indexes are searched at a time, changes no result.
Items of fewer than ``least_words`` words (five) have no shingle and never match;
null texts count as empty; repeated items or rows are treated each for itself;
without items nothing is contaminated.  Other columns are not read, or kept as
they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from salesmart.llm.common import NO_LETTER, arrow_text, mix, ship, slices, words
from salesmart.session import cut

SHARE, OVERLAP, WIDTH = 0.6, 0.8, 5
K1, B = 1.2, 0.75
ITEMS_AT_ONCE = 20_000    # items of one index
INDEXES_AT_ONCE = 5       # indexes searched in one reading of the texts
BLOCK = 8                 # items in a block
BEHIND = 2 / 3            # of the threshold, what terms behind the pivot may give
LEAST_STRIDE = 8
PAIRS_AT_ONCE = 1 << 20   # (passage, block) sums made at a time
VERIFIED_AT_ONCE = 1 << 15
SIEVE = 1 << 20

# fixed marks between a question and its answer
ANSWER_MARK = re.compile(r"\n\s*(?:answer|a)\s*[:.]\s*", re.IGNORECASE)


def runs(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of ``width`` word hashes."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(3) + h[k:len(h) - width + 1 + k])
    return total


# -- index ---------------------------------------------------------------------

@dataclass
class Statistics:
    """Over all items, whatever index they are in."""

    items: int
    mean_length: float
    terms: np.ndarray             # sorted word hashes
    frequency: np.ndarray         # how many items hold each


@dataclass
class Postings:
    """By term: the places it leads to, and the gain there."""

    first: np.ndarray
    places: np.ndarray
    gains: np.ndarray

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All postings of the given terms, and which of the terms each is from."""
        return _spread(self.first[terms], self.first[terms + 1])


@dataclass
class Lists:
    """Lists of hashes one after another."""

    first: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Lists:
        flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        return cls(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), flat.astype(np.uint64))

    def at(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all hashes of the given lists, and which of these each is from."""
        return _spread(self.first[which], self.first[which + 1])


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [begin, end), and which range each is from."""
    size = np.maximum(end - begin, 0)
    source = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[source], source


def _among(values: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which values are among those; by sorting, which bounds time and memory whatever the hashes."""
    if not len(those):
        return np.zeros(len(values), bool)
    those = np.sort(those)
    return those[np.minimum(np.searchsorted(those, values), len(those) - 1)] == values


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.diff(values, prepend=values[:1] - 1) != 0]


@dataclass
class Band:
    """The items of one class of lengths, in blocks of ``BLOCK``."""

    stride: int
    items: np.ndarray             # by place, the item
    need: np.ndarray              # by place, what terms before the pivot must give
    block_need: np.ndarray
    to_blocks: Postings
    to_items: Postings


@dataclass
class Index:
    item_ids: list
    terms: np.ndarray             # sorted hashes of the terms before any item's pivot
    sieve: np.ndarray             # whether a term may have these lowest bits
    bands: list[Band]
    item_terms: Lists             # by item, the hashes of all its terms,
    impacts: np.ndarray           # what each adds to its score,
    thresholds: np.ndarray        # and the score it must reach
    sides: list[Lists]            # by item: shingles of the question, and of the answer,
    widths: list[np.ndarray]      # and how many words each has; 0 where there is no such side


def _kept_items(rows: list[tuple], least_words: int) -> list[tuple]:
    """(item_id, word hashes, shingles of question and answer) of the items that can match."""
    kept = []
    for item_id, text in sorted(rows, key=lambda r: (str(r[0]), r[1] or "")):
        sides = ANSWER_MARK.split(text or "", maxsplit=1)
        h, firsts = words(pa.array([text or "", *sides]), NO_LETTER)
        if firsts[1] >= max(least_words, 1):
            sides = [h[a:b] for a, b in zip(firsts[1:-1], firsts[2:])]
            # a side too short for shingles is verified by its words in a row
            parts = [(min(WIDTH, len(s)), np.unique(runs(s, min(WIDTH, len(s))))) for s in sides if len(s)]
            kept.append((item_id, h[:firsts[1]], parts))
    return kept


def local_statistics(items: list[np.ndarray]) -> Statistics:
    """Of items given by their word hashes."""
    terms, frequency = np.unique(np.concatenate([np.unique(h) for h in items]), return_counts=True)
    return Statistics(len(items), float(np.mean([len(h) for h in items])), terms, frequency)


def _stride(length: int) -> int:
    return max(LEAST_STRIDE, 1 << (int(length) - 1).bit_length())


def _postings(term: np.ndarray, place: np.ndarray, gain: np.ndarray, n_terms: int, n_places: int) -> Postings:
    """The best gain of every (term, place)."""
    keys, where = np.unique(term * n_places + place, return_inverse=True)
    best = np.zeros(len(keys))
    np.maximum.at(best, where, gain)
    return Postings(np.searchsorted(keys // n_places, np.arange(n_terms + 1)), keys % n_places, best)


def build_index(rows: list[tuple], share: float = SHARE, statistics: Statistics | None = None,
                least_words: int = WIDTH) -> Index | None:
    """An index of (item_id, text) rows; None if no item can match."""
    kept = _kept_items(rows, least_words)
    if not kept:
        return None
    statistics = statistics or local_statistics([h for _, h, _ in kept])
    lengths = np.array([len(h) for _, h, _ in kept])
    item = np.repeat(np.arange(len(kept)), lengths)
    terms, term = np.unique(np.concatenate([h for _, h, _ in kept]), return_inverse=True)
    keys, tf = np.unique(item * len(terms) + term, return_counts=True)
    item, term = keys // len(terms), keys % len(terms)
    df = statistics.frequency[np.searchsorted(statistics.terms, terms)]
    idf = np.log(1 + (statistics.items - df + 0.5) / (df + 0.5))
    impacts = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / statistics.mean_length))
    bounds = np.searchsorted(item, np.arange(len(kept) + 1))
    item_terms, item_impacts = Lists(bounds, terms[term]), impacts
    thresholds = share * np.bincount(item, weights=impacts, minlength=len(kept))

    # the pivot of each item: what its rarest terms leave to the others
    gain = impacts / thresholds[item]
    order = np.lexsort((term, -gain, item))
    item, term, gain = item[order], term[order], gain[order]
    before = np.cumsum(gain) - gain
    left = 1 / share - (before - before[bounds[:-1]][item])     # this term's gain and all after it
    ahead = left > BEHIND
    need = 1 - np.bincount(item[~ahead], weights=gain[~ahead], minlength=len(kept))
    item, term, gain = item[ahead], term[ahead], gain[ahead]
    used, term = np.unique(term, return_inverse=True)
    sieve = np.zeros(SIEVE, bool)
    sieve[(terms[used] & np.uint64(SIEVE - 1)).astype(np.int64)] = True

    bands = []
    strides = np.array([_stride(n) for n in lengths])
    for stride in np.unique(strides):
        items = np.flatnonzero(strides == stride)
        place = np.full(len(kept), -1)
        place[items] = np.arange(len(items))
        here = place[item] >= 0
        n_blocks = (len(items) - 1) // BLOCK + 1
        padded = np.append(need[items], np.full(n_blocks * BLOCK - len(items), np.inf))
        bands.append(Band(
            int(stride), items, need[items], padded.reshape(n_blocks, BLOCK).min(axis=1),
            _postings(term[here], place[item[here]] // BLOCK, gain[here], len(used), n_blocks),
            _postings(term[here], place[item[here]], gain[here], len(used), len(items))))
    sides = [[parts[k] if len(parts) > k else (0, np.zeros(0, np.uint64)) for _, _, parts in kept] for k in (0, 1)]
    return Index([k[0] for k in kept], terms[used], sieve, bands, item_terms, item_impacts, thresholds,
                 [Lists.of([x for _, x in side]) for side in sides], [np.array([w for w, _ in side]) for side in sides])


# -- search --------------------------------------------------------------------

def _summed(postings: Postings, window: np.ndarray, term: np.ndarray, n_places: int):
    """(window, place) pairs met by the windows' terms, and the gains they sum to."""
    where, source = postings.of(term)
    pairs, at = np.unique(window[source] * n_places + postings.places[where], return_inverse=True)
    return pairs, np.bincount(at, weights=postings.gains[where], minlength=len(pairs))


def _in_batches(window: np.ndarray, load: np.ndarray) -> Iterator[slice]:
    """Consecutive whole windows of at most ``PAIRS_AT_ONCE`` postings together, or one window alone."""
    starts = np.flatnonzero(np.diff(window, prepend=-1))
    upto = np.append(0, np.cumsum(load))[np.append(starts, len(window))]
    a = 0
    while a < len(starts):
        b = max(int(np.searchsorted(upto, upto[a] + PAIRS_AT_ONCE, side="right")) - 1, a + 1)
        yield slice(starts[a], starts[b] if b < len(starts) else len(window))
        a = b


def _candidates(band: Band, window: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and items that can still reach their thresholds."""
    n_blocks, n_items = len(band.block_need), len(band.items)
    load = band.to_blocks.first[term + 1] - band.to_blocks.first[term]
    for part in _in_batches(window, load):
        w, t = window[part], term[part]
        pairs, bound = _summed(band.to_blocks, w, t, n_blocks)
        pairs = pairs[bound >= band.block_need[pairs % n_blocks] - 1e-9]
        if not len(pairs):
            continue
        live = _among(w, pairs // n_blocks)
        pairs_of_items, bound = _summed(band.to_items, w[live], t[live], n_items)
        places = pairs_of_items % n_items
        found = (bound >= band.need[places] - 1e-9) & _among(
            pairs_of_items // n_items * n_blocks + places // BLOCK, pairs)
        w, item = pairs_of_items[found] // n_items, band.items[places[found]]
        for a in range(0, len(w), VERIFIED_AT_ONCE):
            yield w[a:a + VERIFIED_AT_ONCE], item[a:a + VERIFIED_AT_ONCE]


def _keyed(hashes: np.ndarray, window: np.ndarray) -> np.ndarray:
    """One hash for a hash within a window."""
    return mix(hashes + (window.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _held(lists: Lists, items: np.ndarray, windows: np.ndarray, within: np.ndarray):
    """Which hashes of the items' lists are among their windows' keys ``within``; with position and pair of each."""
    at, pair = lists.at(items)
    return _among(_keyed(lists.hashes[at], windows[pair]), within), at, pair


def _verified(index: Index, h: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, overlap: float):
    """Score and overlaps of items in the passages [begin, end), and which of the pairs hold."""
    passages, passage = np.unique(begin, return_inverse=True)      # one end for each beginning
    last = np.zeros(len(passages), np.int64)
    last[passage] = end
    word, source = _spread(passages, last)
    there, at, pair = _held(index.item_terms, item, passage, _keyed(h[word], source))
    score = np.bincount(pair, weights=index.impacts[at] * there, minlength=len(item))
    holds = score >= index.thresholds[item] - 1e-9
    shares = []
    for side, widths in zip(index.sides, index.widths):
        share = np.ones(len(item))
        for width in np.unique(widths[item[holds]]):
            mine = np.flatnonzero(holds & (widths[item] == width))
            if not width or not len(mine):
                continue
            used, local = np.unique(passage[mine], return_inverse=True)
            word, source = _spread(passages[used], last[used] - width + 1)
            run = np.full(len(word), 0, np.uint64)
            for k in range(width):
                run = mix(run * np.uint64(3) + h[word + k])
            there, _, pair = _held(side, item[mine], local, _keyed(run, source))
            size = side.first[item[mine] + 1] - side.first[item[mine]]
            share[mine] = np.bincount(pair, weights=there, minlength=len(mine)) / size
        holds = holds & (share >= overlap)
        shares.append(share)
    return holds, score, shares


def search(indexes: list[Index], texts: pa.Array, overlap: float = OVERLAP) -> list[tuple]:
    """(text, index, item, score, question overlap, answer overlap), the best passage for each text and item."""
    h, firsts = words(texts, NO_LETTER)
    out = []
    for number, index in enumerate(indexes):
        best = _search(index, h, firsts, overlap)
        out += [(d, number, item, *row) for (d, item), row in sorted(best.items())]
    return out


def _search(index: Index, h: np.ndarray, firsts: np.ndarray, overlap: float) -> dict[tuple[int, int], tuple]:
    hit = np.flatnonzero(index.sieve[(h & np.uint64(SIEVE - 1)).astype(np.int64)])
    term = np.minimum(np.searchsorted(index.terms, h[hit]), len(index.terms) - 1)
    same = index.terms[term] == h[hit]
    hit, term = hit[same], term[same]
    doc = np.searchsorted(firsts, hit, side="right") - 1
    n = np.diff(firsts)
    best: dict[tuple[int, int], tuple] = {}
    for band in index.bands:
        stride, n_terms = band.stride, len(index.terms)
        mine = band.to_blocks.first[term + 1] > band.to_blocks.first[term]
        if not mine.any():
            continue
        passages = np.concatenate([[0], np.cumsum((n + stride - 1) // stride)])
        step = (hit[mine] - firsts[doc[mine]]) // stride
        window = passages[doc[mine]] + step
        # a word stands in the passage that starts at its stride and in the one before
        keys = _distinct(np.concatenate([window * n_terms + term[mine],
                                          (window[step > 0] - 1) * n_terms + term[mine][step > 0]]))
        for w, item in _candidates(band, keys // n_terms, keys % n_terms):
            d = np.searchsorted(passages, w, side="right") - 1
            begin = firsts[d] + (w - passages[d]) * stride
            end = np.minimum(begin + 2 * stride, firsts[d + 1])
            holds, score, shares = _verified(index, h, begin, end, item, overlap)
            for k in np.flatnonzero(holds):
                key, row = (int(d[k]), int(item[k])), (float(score[k]), float(shares[0][k]), float(shares[1][k]))
                best[key] = max(best.get(key, row), row)
    return best


# -- tables ----------------------------------------------------------------------

def indexes(benchmark: DataFrame, share: float = SHARE, items_at_once: int = ITEMS_AT_ONCE,
            least_words: int = WIDTH, at_once: int = INDEXES_AT_ONCE) -> Iterator[list[Index]]:
    """Indexes of about ``items_at_once`` items each, ``at_once`` of them at a time on the driver.

    The statistics are counted in Spark over all items; an index gets those of
    its own terms.
    """
    ship(benchmark.sparkSession)
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    groups = max(1, -(-items.count() // items_at_once))
    items = cut(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).cast("int")))

    def terms(batches):
        for batch in slices(batches):
            h, firsts = words(arrow_text(batch.column("text")), NO_LETTER)
            for part, a, b in zip(batch.column("part").to_pylist(), firsts[:-1], firsts[1:]):
                if b - a >= max(least_words, 1):
                    found = np.unique(h[a:b]).astype(np.int64)
                    # the first row of an item has its length as well
                    length = np.zeros(len(found), np.int64)
                    length[0] = b - a
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), part, np.int32)), pa.array(found), pa.array(length)],
                        names=["part", "term", "length"])
    held = cut(items.select("part", "text").mapInArrow(terms, "part int, term long, length long")
               .groupBy("part", "term").agg(F.count(F.lit(1)).alias("items"), F.sum("length").alias("length"),
                                            F.count_if(F.col("length") > 0).alias("firsts")))
    n_items, length = held.agg(F.sum("firsts"), F.sum("length")).first()
    if not n_items:
        return
    frequency = held.groupBy("term").agg(F.sum("items").alias("frequency"))
    by_part = cut(held.select("part", "term").join(frequency, "term"))
    for first in range(0, groups, at_once):
        built = []
        for part in range(first, min(first + at_once, groups)):
            # bounded by the words of about ``items_at_once`` items
            known = by_part.where(F.col("part") == part).select("term", "frequency").toArrow()
            term = known.column("term").to_numpy().astype(np.uint64)
            order = np.argsort(term)
            statistics = Statistics(n_items, length / n_items, term[order], known.column("frequency").to_numpy()[order])
            rows = [tuple(r) for r in items.where(F.col("part") == part).select("item_id", "text").collect()]
            index = build_index(rows, share, statistics, least_words)
            if index is not None:
                built.append(index)
        if built:
            yield built


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP,
               items_at_once: int = ITEMS_AT_ONCE, least_words: int = WIDTH) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap for every item found in a text."""
    spark = docs.sparkSession
    ship(spark)
    item_type = benchmark.schema["item_id"].dataType
    item_arrow = to_arrow_type(item_type)
    chosen = docs.select("doc_id", "text")
    schema = chosen.select("doc_id").schema.add("item_id", item_type).add("score", "double").add(
        "question_overlap", "double").add("answer_overlap", "double")
    result = None
    for built in indexes(benchmark, share, items_at_once, least_words):
        shared = spark.sparkContext.broadcast(built)      # at most ITEMS_AT_ONCE * INDEXES_AT_ONCE items

        def find(batches, shared=shared):
            for part in slices(batches):
                rows = search(shared.value, arrow_text(part.column("text")), overlap)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                     pa.array([shared.value[r[1]].item_ids[r[2]] for r in rows], item_arrow),
                     *(pa.array([r[k] for r in rows], pa.float64()) for k in (3, 4, 5))],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = chosen.mapInArrow(find, schema)
        result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], schema) if result is None else result


def drop_leaked(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, overlap: float = OVERLAP,
                items_at_once: int = ITEMS_AT_ONCE, least_words: int = WIDTH) -> DataFrame:
    """The documents in which no item was found, all columns as they are."""
    ship(docs.sparkSession)
    for built in indexes(benchmark, share, items_at_once, least_words):
        shared = docs.sparkSession.sparkContext.broadcast(built)      # at most ITEMS_AT_ONCE * INDEXES_AT_ONCE items

        def keep(batches, shared=shared):
            for part in slices(batches):
                leaked = {r[0] for r in search(shared.value, arrow_text(part.column("text")), overlap)}
                yield part.filter(pa.array([i not in leaked for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
