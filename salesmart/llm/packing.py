"""Packing of tokenised documents by shortest-pack-first over the length histogram.

Documents longer than a sequence are cut into full pieces and a rest.  Only the
number of pieces of each length (at most ``size`` numbers) reaches the driver.
There, lengths are placed longest first, each into the packs with the most
room; packs alike in content are one *pattern* with a count, so the work
depends on the number of lengths, not of documents.  Patterns are joined back
to the pieces by their rank among those of equal length.

Ranks come from each task's own numbering plus the counts of earlier tasks, so
a length that a third of all pieces share is never one group.

A null text counts as empty and is one piece of a single end token.  Repeated
rows are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesmart.llm.common import arrow_text, ship, slices, span_hashes
from salesmart.session import cut

SIZE, END_ID, TOKENIZER = 2048, 1, "byte_bpe_50k.json"
CACHED_PIECES = 600_000

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 4


class PieceTokenizer:
    """Ids of whole texts from a byte-level BPE file.

    Byte-level BPE first splits a text by a fixed rule (words with the space
    before them, numbers, signs, white space) and encodes each part alone.  The
    split is done here on arrays for many texts at once, so that each distinct
    part is encoded by the tokenizer only once.
    """

    def __init__(self, path: str):
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold an added token (such as an end mark) are split around it first
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
            for m in regex.finditer(name, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1])
                self.kind[a:b + 1] = kind
        self.known: dict[int, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        # contractions and added tokens are split by rules of their own; such texts go the plain way
        fast = ["'" not in t and not any(a in t for a in self.added) for t in texts]
        plain = [i for i, f in enumerate(fast) if not f]
        for i, e in zip(plain, self.tokenizer.encode_batch_fast([texts[i] for i in plain], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        rest = [i for i, f in enumerate(fast) if f]
        joined = "".join(texts[i] for i in rest)
        offs = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rest])]).astype(np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = self._parts(codes, offs)
        end = np.append(begin[1:], len(codes))
        flat, sizes = self._encoded(joined, codes, begin, end)
        token_ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = token_ends[np.searchsorted(begin, offs)]
        for k, i in enumerate(rest):
            out[i] = flat[bounds[k]:bounds[k + 1]]
        return out

    def _parts(self, codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where each part starts; parts do not cross texts."""
        if not len(codes):
            return np.zeros(0, np.int64)
        kind = self.kind[codes]
        fresh = np.zeros(len(codes) + 1, bool)
        fresh[offs] = True
        fresh = fresh[:-1]
        start = fresh.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # white space before something else: its last character stands alone, or a space joins what follows
        after_blank = np.flatnonzero((kind[1:] != BLANK) & (kind[:-1] == BLANK) & ~fresh[1:]) + 1
        start[after_blank - 1] = True
        start[after_blank[codes[after_blank - 1] == 32]] = False
        return np.flatnonzero(start)

    def _encoded(self, joined: str, codes, begin, end) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each part."""
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        names, first, which = np.unique(span_hashes(codes, begin, end), return_index=True, return_inverse=True)
        names = names.tolist()
        new = [k for k, name in enumerate(names) if name not in self.known]
        if len(self.known) + len(new) > CACHED_PIECES:
            self.known = {}
            new = range(len(names))
        parts = [joined[begin[first[k]]:end[first[k]]] for k in new]
        for k, e in zip(new, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
            self.known[names[k]] = np.array(e.ids, np.uint32).tobytes()
        found = [self.known[name] for name in names]
        size = np.array([len(x) // 4 for x in found], np.int64)
        pool, pool_first = np.frombuffer(b"".join(found), np.uint32), np.cumsum(size) - size
        sizes = size[which]
        stop = np.cumsum(sizes)
        return pool[np.arange(stop[-1]) + np.repeat(pool_first[which] - stop + sizes, sizes)], sizes


_tokenizers: dict[str, PieceTokenizer] = {}


def tokenizer_for(name: str) -> PieceTokenizer:
    """The worker's tokenizer; a file of the installed public tokenizers, or a path."""
    if name not in _tokenizers:
        import public_tokenizers
        _tokenizers[name] = PieceTokenizer(name if "/" in name else public_tokenizers.path(name))
    return _tokenizers[name]


def pack_patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths in a pack, number of such packs), by shortest-pack-first."""
    open_packs: dict[int, list[tuple[list[int], int]]] = defaultdict(list)    # by room left
    rooms: list[int] = []                                                     # heap of -room
    done = []

    def put(lengths: list[int], count: int, room: int) -> None:
        if room == 0:
            done.append((lengths, count))
            return
        if not open_packs[room]:
            heapq.heappush(rooms, -room)
        open_packs[room].append((lengths, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not open_packs[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room < length:
                put([length], left, size - length)
                break
            lengths, count = open_packs[room].pop()
            if count > left:
                open_packs[room].append((lengths, count - left))
                count = left
            left -= count
            put([*lengths, length], count, room - length)
    return done + [pack for packs in open_packs.values() for pack in packs]


def placement(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Blocks of ranks: pieces of a length, from a rank on, fill the packs of one pattern."""
    taken: dict[int, int] = defaultdict(int)
    blocks, sequence = [], 0
    for lengths, count in patterns:
        at = 0
        for length in sorted(set(lengths), reverse=True):
            times = lengths.count(length)
            blocks.append((length, taken[length], times, sequence, at))
            taken[length] += times * count
            at += times * length
        sequence += count
    columns = np.array(sorted(blocks), np.int64).reshape(-1, 5).T
    return {"key": (columns[0] << 44) + columns[1], "first": columns[1], "times": columns[2],
            "sequence": columns[3], "offset": columns[4]}


def token_pieces(docs: DataFrame, keep: list[str], size: int = SIZE, end_id: int = END_ID,
                 tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` tokens: columns ``keep``, start, length, ids_crc32, doc_tokens (and ids).

    ``task`` and ``number`` count the pieces of each length in each task.
    """
    import zlib

    ship(docs.sparkSession)

    def cut_up(batches):
        task = TaskContext.get().partitionId()
        made: dict[int, int] = defaultdict(int)
        for part in slices(batches, "__text"):
            rows, source, blobs = [], [], []
            for i, ids in enumerate(tokenizer_for(tokenizer).ids(arrow_text(part.column("__text")).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start:start + size].tobytes()
                    length = len(piece) // 4
                    rows.append((start, length, zlib.crc32(piece), len(ids), task, made[length]))
                    made[length] += 1
                    source.append(i)
                    blobs.append(piece)
            columns = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(pa.array(source)) for c in keep), *map(pa.array, columns),
                 *([pa.array(blobs, pa.binary())] if with_ids else [])], names=[*keep, *names])

    names = ["start", "length", "ids_crc32", "doc_tokens", "task", "number", *(["ids"] if with_ids else [])]
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = chosen.schema
    for n in names:
        schema = schema.add(n, "binary" if n == "ids" else "long")
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text")).mapInArrow(cut_up, schema)


def pack_documents(docs: DataFrame, keep: list[str], size: int = SIZE, end_id: int = END_ID,
                   tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequence_id and the offset there.

    ``keep`` must not name a column of the result.  Tokenising and the
    histogram run at build time; the pieces are written once.
    """
    pieces = cut(token_pieces(docs, keep, size, end_id, tokenizer, with_ids))
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = docs.sparkSession.sparkContext.broadcast(placement(pack_patterns(histogram, size)))  # a row per pattern and length
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"])
    names = [*keep, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def place(batches):
        table = where.value
        for part in batches:
            length, rank = part.column("length").to_numpy(), part.column("rank").to_numpy()
            block = np.searchsorted(table["key"], (length << 44) + rank, side="right") - 1
            k = rank - table["first"][block]
            times = table["times"][block]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names), pa.array(table["sequence"][block] + k // times),
                 pa.array(table["offset"][block] + k % times * length)], names=[*names, "sequence_id", "offset"])

    chosen = ranked.select(*[F.col(f"`{c}`") for c in names], (F.col("before") + F.col("number")).alias("rank"))
    schema = chosen.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return chosen.mapInArrow(place, schema)
