"""Removal of repeated passages by a distributed merge of sorted suffixes.

A byte goes when it is covered by a string of ``LENGTH`` bytes that also starts
in a document with a smaller id; judged on the input, matches within documents.

Sorting every suffix would move the corpus many times over, so, as in merge
sorts of strings that exchange only distinguishing prefixes, suffixes that
cannot match are left out first, without loss:

1. Every string of ``LENGTH`` bytes has an *anchor*: the start of its 16 bytes
   with the least hash.  Equal strings have equal anchors, and only one position
   in about eighteen is an anchor.  Tasks exchange the hashes of their anchors'
   16 bytes, sorted and each once, and learn which occur elsewhere as well.
2. Suffixes at such anchors (with the bytes before them that a string may need)
   are sorted in each chunk of documents, equal ones merged to the least id, and
   exchanged as front-coded runs: what a suffix shares with the one before it is
   a number.  Runs are combined by a loser tree that keeps, for every loser, how
   much it shares with the winner, and so never compares known prefixes again.
   In the merged order, with its common prefixes, equal strings stand together;
   their least document id decides.
3. One bit for each string of each suffix goes back to the chunk, which marks
   the bytes.

Copies in a chunk are merged before the exchange, so a passage that a third of
all documents holds is sent once by each chunk.

Null texts count as empty.  A null id counts as the largest; rows with one id
are one document as far as removal goes, so repeated rows do not remove each
other.  Texts below ``LENGTH`` bytes stay whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import arrow_text, flat, grouped, mix, powers, ship, slices
from salesmart.session import cut

LENGTH, MER = 50, 16
STEPS = LENGTH - MER + 1            # anchors that a string may have
CHUNK_BYTES, RANGE_BYTES = 2 << 20, 8 << 20
HASH_BITS, HASH_BYTES = 48, 6
NULL_ID = (1 << 63) - 1
_LOW = np.uint64(0xFFFFFFFF)


class Chunk:
    """Some documents' bytes in a row, the strings in them and the strings' anchors."""

    def __init__(self, texts: pa.Array, ids: np.ndarray):
        self.buf, self.offs = flat(texts)
        self.ids = ids
        n = len(self.buf)
        count = np.maximum(np.diff(self.offs) - LENGTH + 1, 0)
        place = np.int32 if n < 1 << 31 else np.int64
        self.string_doc = np.repeat(np.arange(len(ids), dtype=place), count)
        #: where each string starts, and its anchor
        self.strings = np.arange(count.sum(), dtype=place)
        self.strings += np.repeat((self.offs[:-1] - np.cumsum(count) + count).astype(place), count)
        if not len(self.strings):
            self.anchor_of = self.strings
            self.anchors, self.names = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        h = mix((sums[MER:] - sums[:-MER]) * down[:n - MER + 1])
        del sums
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)     # ties go to the first
        reach = 1
        while 2 * reach <= STEPS:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if STEPS > reach:
            least = np.minimum(least[:-(STEPS - reach)], least[STEPS - reach:])
        self.anchor_of = (least[self.strings] & _LOW).astype(place)
        new = np.ones(len(self.strings), bool)
        new[1:] = self.anchor_of[1:] != self.anchor_of[:-1]
        self.first = np.flatnonzero(new)                 # first string of each anchor
        self.last = np.append(self.first[1:], len(new)) - 1
        self.anchors = self.anchor_of[self.first].astype(np.int64)
        # hashed once more: the least of many hashes are small, and ranges of names should be even
        self.names = (mix(h[self.anchors] + np.uint64(1)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct names in order, and for each whether several documents here have it."""
        if not len(self.names):
            return self.names, np.zeros(0, bool)
        doc = self.ids[self.string_doc[self.first]]
        order = np.lexsort((doc, self.names))
        name, doc = self.names[order], doc[order]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        starts = np.flatnonzero(new)
        return name[new], np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)

    def entries(self, shared: np.ndarray):
        """Suffixes at anchors named in ``shared`` (sorted), merged where all that matters is equal.

        Returns rows of bytes in order (suffix, what stands before it, least and
        most distance of a string's start), the least id of each, its name, and
        for every string of this chunk its row (-1: none).
        """
        at = np.searchsorted(shared, self.names)
        chosen = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == self.names) if len(shared) else at[:0]
        row_of = np.full(len(self.strings), -1, np.int32)
        if not len(chosen):
            return np.zeros((0, LENGTH + STEPS + 1), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), row_of
        anchor = self.anchors[chosen]
        most = anchor - self.strings[self.first[chosen]]
        fewest = anchor - self.strings[self.last[chosen]]
        span = np.arange(-(STEPS - 1), LENGTH)
        inside = (span >= -most[:, None]) & (span < LENGTH - fewest[:, None])
        bytes_ = np.where(inside, self.buf[np.clip(anchor[:, None] + span, 0, len(self.buf) - 1)], 0).astype(np.uint8)
        rows = np.empty((len(chosen), LENGTH + STEPS + 1), np.uint8)
        rows[:, :LENGTH] = bytes_[:, STEPS - 1:]
        rows[:, LENGTH:LENGTH + STEPS - 1] = bytes_[:, :STEPS - 1]
        rows[:, -2], rows[:, -1] = fewest + 1, most + 1      # never zero, so that rows compare as strings
        _, index, inverse = np.unique(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(),
                                      return_index=True, return_inverse=True)
        least = np.full(len(index), NULL_ID)
        np.minimum.at(least, inverse, self.ids[self.string_doc[self.first[chosen]]])
        size = self.last[chosen] - self.first[chosen] + 1
        row_of[np.repeat(self.first[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(
            inverse, size)
        return rows[index], least, self.names[chosen][index], row_of


def encode_run(rows: np.ndarray, ids: np.ndarray) -> bytes:
    """A front-coded run of rows in order."""
    suffix = rows[:, :LENGTH]
    common = np.zeros(len(rows), np.int64)
    common[1:] = np.logical_and.accumulate(suffix[1:] == suffix[:-1], axis=1).sum(1)
    length = LENGTH + 1 - rows[:, -2].astype(np.int64)
    rest = (np.arange(LENGTH) >= common[:, None]) & (np.arange(LENGTH) < length[:, None])
    before = np.arange(STEPS - 1) >= STEPS - rows[:, -1].astype(np.int64)[:, None]
    return b"".join([np.uint32(len(rows)).tobytes(), common.astype(np.uint8).tobytes(), rows[:, -2:].tobytes(),
                     ids.astype("<i8").tobytes(), suffix[rest].tobytes(), rows[:, LENGTH:-2][before].tobytes()])


def decode_run(blob: bytes):
    """Suffixes, common prefixes, ids, fewest and most distances, and the bytes before, of a run."""
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    common = np.frombuffer(blob, np.uint8, n, 4)
    limits = np.frombuffer(blob, np.uint8, 2 * n, 4 + n).reshape(n, 2).astype(np.int64) - 1
    ids = np.frombuffer(blob, "<i8", n, 4 + 3 * n)
    at = 4 + 11 * n
    size = np.maximum(LENGTH - limits[:, 0] - common, 0)
    ends = (at + np.cumsum(size)).tolist()
    suffixes, previous, start = [], b"", at
    for shared, end in zip(common.tolist(), ends):
        previous = (previous[:shared] + blob[start:end]).ljust(LENGTH, b"\0")
        suffixes.append(previous)
        start = end
    before = np.zeros((n, STEPS - 1), np.uint8)
    before[np.arange(STEPS - 1) >= STEPS - 1 - limits[:, 1:2]] = np.frombuffer(blob, np.uint8, -1, start)
    return suffixes, common.tolist(), ids, limits, before


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs of (strings, common prefix with the one before).

    Returns the run that each output comes from, and the prefix it shares with
    the output before.  Inner nodes hold the loser of their match and what it
    shares with the winner; two strings are compared only behind the shorter of
    the prefixes that both are known to share with the last output.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads = [run[0][0] if run[0] else None for run in runs] + [None] * (width - len(runs))
    place = [0] * width

    def match(i: int, share_i: int, j: int, share_j: int):
        """(winner, its share, loser, the loser's share with the winner)."""
        a, b = heads[i], heads[j]
        if b is None:
            return i, share_i, j, 0
        if a is None:
            return j, share_j, i, 0
        if share_i != share_j:      # the one that shares more with the last output is the smaller
            return (i, share_i, j, share_j) if share_i > share_j else (j, share_j, i, share_i)
        if a == b:
            return (i, share_i, j, LENGTH) if i < j else (j, share_j, i, LENGTH)
        k = share_i
        while a[k] == b[k]:
            k += 1
        return (i, share_i, j, k) if a[k] < b[k] else (j, share_j, i, k)

    losers: list[tuple[int, int]] = [(0, 0)] * width
    level = [(i, 0) for i in range(width)]
    base = width
    while len(level) > 1:
        base //= 2
        upper = []
        for k in range(0, len(level), 2):
            winner, share, loser, loser_share = match(*level[k], *level[k + 1])
            losers[base + k // 2] = (loser, loser_share)
            upper.append((winner, share))
        level = upper
    winner, share = level[0]
    order, shares = [], []
    while heads[winner] is not None:
        order.append(winner)
        shares.append(share)
        strings, commons = runs[winner]
        place[winner] += 1
        at = place[winner]
        if at < len(strings):
            heads[winner], share = strings[at], commons[at]
        else:
            heads[winner], share = None, 0
        node = (width + winner) // 2
        while node:
            loser, loser_share = losers[node]
            winner, share, loser, loser_share = match(winner, share, loser, loser_share)
            losers[node] = (loser, loser_share)
            node //= 2
    return order, shares


def repeated(blobs: list[bytes]) -> list[np.ndarray]:
    """For each run a row of bits per suffix: bit d is set if the string that starts d bytes before the
    suffix stands in a document with a smaller id than the suffix's least."""
    decoded = [decode_run(b) for b in blobs]
    order, shares = merge_runs([d[:2] for d in decoded])
    order = np.array(order)
    # rows of the runs, one run after the other, in merged order
    first = np.cumsum([0, *(len(d[0]) for d in decoded)])
    rank = np.empty(len(order), np.int64)
    rank[np.argsort(order, kind="stable")] = np.arange(len(order))
    ids = np.concatenate([d[2] for d in decoded])[rank]
    limits = np.concatenate([d[3] for d in decoded])[rank]
    before = np.concatenate([d[4] for d in decoded])[rank]
    shares = np.array(shares)
    bits = np.zeros(len(order), np.int64)
    up, _ = powers(LENGTH + 1)
    ahead = np.zeros(len(order), np.uint64)
    for d in range(STEPS):
        if d:
            ahead += (before[:, STEPS - 1 - d].astype(np.uint64) + np.uint64(1)) * up[d]
        chosen = np.flatnonzero((limits[:, 0] <= d) & (limits[:, 1] >= d))
        if not len(chosen):
            continue
        alike = np.cumsum(shares < LENGTH - d)           # suffixes that share the string's part behind
        key = mix(alike[chosen].astype(np.uint64) * up[1] + mix(ahead[chosen] + np.uint64(d)))
        at = np.argsort(key)
        key, who = key[at], chosen[at]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(ids[who], starts)
        bits[who] |= (ids[who] > least[np.cumsum(new) - 1]).astype(np.int64) << d
    back = np.empty(len(order), np.int64)
    back[rank] = bits
    return [back[a:b] for a, b in zip(first[:-1], first[1:])]


def _names(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // HASH_BYTES, 8), np.uint8)
    raw[:, :HASH_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, HASH_BYTES)
    return raw.view("<i8").ravel()


def _pack(keys: pa.Array, texts: pa.Array) -> bytes:
    """A chunk's ids and texts as one compressed Arrow stream: large rows are small for the JVM."""
    batch = pa.RecordBatch.from_arrays([keys, texts], names=["key", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _chunk(batch, i: int) -> tuple[Chunk, pa.Array]:
    """A chunk, and its documents' ids as they were."""
    rows = pa.ipc.open_stream(batch.column("body")[i].as_buffer()).read_all().combine_chunks()
    keys = rows.column("key").combine_chunks()
    return Chunk(arrow_text(rows.column("text")), pc.fill_null(keys, NULL_ID).to_numpy(zero_copy_only=False)), keys


def _shared(chunk: Chunk, flags: list[dict], width: int) -> np.ndarray:
    """The names of a chunk that occur in several documents, from the bits that came back."""
    names, here = chunk.distinct()
    bounds = np.searchsorted(names // width, [[f["range"], f["range"] + 1] for f in flags]).reshape(-1, 2)
    for (a, b), f in zip(bounds, flags):
        here[a:b] |= np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=b - a).astype(bool)
    return names[here]


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (and kept, the bytes) of every row of (doc_id, text).

    Everything up to the last pass runs at build time; the documents are written
    once, in chunks of about ``CHUNK_BYTES``.
    """
    ship(docs.sparkSession)

    def gather(batches):
        task, number = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def row():
            keys, texts = (pa.concat_arrays([h[k] for h in held]) for k in range(2))
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + number]), pa.array([size]), pa.array([_pack(keys, texts)], pa.binary())],
                names=["chunk", "bytes", "body"])

        for part in slices(batches, limit=CHUNK_BYTES // 4):
            text = arrow_text(part.column("text"))
            held.append((part.column("doc_id"), text))
            size += pc.sum(pc.binary_length(text)).as_py() or 0
            if size >= CHUNK_BYTES or sum(len(h[0]) for h in held) >= 100_000:
                yield row()
                number, held, size = number + 1, [], 0
        if held:
            yield row()

    chunks = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        gather, "chunk long, bytes long, body binary"))
    total = chunks.agg(F.sum("bytes")).first()[0]
    ranges = max(1, -(-(total or 0) // RANGE_BYTES))
    width = -(-(1 << HASH_BITS) // ranges)

    def names(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found, _ = _chunk(batch, i)[0].distinct()
                raw = found.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
                which, first = np.unique(found // width, return_index=True)
                bounds = [*first, len(found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(which), batch.column("chunk")[i].as_py(), np.int64)), pa.array(which),
                     pa.array([raw[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    names=["chunk", "range", "names"])

    def common(batches):
        for (r,), group in grouped(batches, ["range"]):
            blobs = [_names(b) for b in group.column("names").to_pylist()]
            every = np.concatenate(blobs)
            order = np.argsort(every, kind="stable")
            twin = every[order][1:] == every[order][:-1]
            several = np.zeros(len(every), bool)
            several[order[1:]] |= twin
            several[order[:-1]] |= twin
            bounds = np.cumsum([0, *map(len, blobs)])
            yield pa.RecordBatch.from_arrays(
                [group.column("chunk").combine_chunks(), pa.array(np.full(len(blobs), r, np.int64)),
                 pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                names=["chunk", "range", "bits"])

    flags = cut(chunks.select("chunk", "body").mapInArrow(names, "chunk long, range long, names binary")
                .repartition("range").sortWithinPartitions("range", "chunk")
                .mapInArrow(common, "chunk long, range long, bits binary"))
    flags = flags.groupBy("chunk").agg(F.collect_list(F.struct("range", "bits")).alias("flags"))   # one chunk's

    def runs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, keys = _chunk(batch, i)
                rows, ids, found, _ = chunk.entries(_shared(chunk, batch.column("flags")[i].as_py() or [], width))
                which = found % ranges
                used = np.unique(which)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), batch.column("chunk")[i].as_py(), np.int64)), pa.array(used),
                     pa.array([encode_run(rows[which == q], ids[which == q]) for q in used], pa.binary())],
                    names=["chunk", "range", "run"])

    def decide(batches):
        for (q,), group in grouped(batches, ["range"]):
            bits = repeated(group.column("run").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [group.column("chunk").combine_chunks(), pa.array(np.full(len(bits), q, np.int64)),
                 pa.array([b.astype("<i8").tobytes() for b in bits], pa.binary())], names=["chunk", "range", "bits"])

    flagged = chunks.join(flags, "chunk", "left")
    decided = cut(flagged.select("chunk", "body", "flags").mapInArrow(runs, "chunk long, range long, run binary")
                  .repartition("range").sortWithinPartitions("range", "chunk")
                  .mapInArrow(decide, "chunk long, range long, bits binary"))
    decided = decided.groupBy("chunk").agg(F.collect_list(F.struct("range", "bits")).alias("bits"))

    def remove(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, keys = _chunk(batch, i)
                rows, ids, found, row_of = chunk.entries(
                    _shared(chunk, batch.column("flags")[i].as_py() or [], width))
                bits = np.zeros(len(rows), np.int64)
                for b in batch.column("bits")[i].as_py() or []:
                    bits[found % ranges == b["range"]] = np.frombuffer(b["bits"], "<i8")
                hit = np.flatnonzero(row_of >= 0)
                row = row_of[hit]
                start = chunk.strings[hit]
                gone = ((bits[row] >> (chunk.anchor_of[hit] - start).astype(np.int64)) & 1).astype(bool)
                gone |= chunk.ids[chunk.string_doc[hit]] > ids[row]      # a smaller id in this chunk
                edge = np.bincount(start[gone], minlength=len(chunk.buf) + 1) - np.bincount(
                    start[gone] + LENGTH, minlength=len(chunk.buf) + 1)
                removed = np.cumsum(edge)[:-1] > 0
                out = []
                for a, b in zip(chunk.offs[:-1], chunk.offs[1:]):
                    mask, text = removed[a:b], chunk.buf[a:b]
                    n = int(mask.sum())
                    kept = (text[~mask] if n else text).tobytes()
                    spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0
                    out.append((int(b - a), n, spans, hashlib.sha256(kept).hexdigest(), kept))
                n_bytes, n_removed, n_spans, digest, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(n_bytes, pa.int64()),
                     pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest),
                     *([pa.array(kept, pa.binary())] if with_text else [])],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    return flagged.join(decided, "chunk", "left").mapInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + (", kept binary" if with_text else ""))
