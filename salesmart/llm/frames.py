"""Fill-in-middle over seekable compressed texts.

A text is stored as independent zstandard frames of some tens of kilobytes,
each with the number of code points before it.  Any span of code points can then
be read from the frames that hold it, and cutting a text opens at most the two
frames in which the cuts lie: all others move to their new place as they are.
Digests and checks read the frames in order, one at a time, so no step but the
first holds a whole text.

The store is written as a table in the shared folder, so lost executors read
it again and nothing is compressed twice.

Null texts count as empty; an empty text has no frames.  Ids may be null (they
count as the empty text in the draw) and may repeat; equal texts under one id
are cut alike.  Other columns stay; those named like a result give way to it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.common import arrow_text, parts, ship, slices
from salesmart.session import cut

FRAME_BYTES = 64 << 10
LEVEL = 3
# fixed values: the marks before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FRAMES = T.ArrayType(T.StructType([
    T.StructField("first", T.LongType()), T.StructField("units", T.LongType()), T.StructField("data", T.BinaryType())]))
RESULTS = ("n", "frames", "marked", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")

Frame = tuple[int, int, bytes]      # code points before it, in it, and its zstandard frame


# -- one text's frames --------------------------------------------------------

class Codec:
    """A compressor and a decompressor, kept for the life of a task."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.size = frame_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.opener = zstandard.ZstdDecompressor()

    def pack(self, text: bytes) -> Iterator[Frame]:
        """Frames of about ``size`` bytes that never split a code point."""
        start = first = 0
        while start < len(text):
            end = min(start + self.size, len(text))
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            part = text[start:end]
            units = len(part.decode())
            yield first, units, self.packer.compress(part)
            start, first = end, first + units

    def open(self, frame: Frame) -> str:
        return self.opener.decompress(frame[2]).decode()

    def read(self, frames: list[Frame], begin: int, end: int) -> Iterator[str]:
        """The code points [begin, end), from the frames that hold them."""
        at = max(bisect_right(frames, begin, key=lambda f: f[0]) - 1, 0)
        for frame in frames[at:]:
            if frame[0] >= end:
                return
            if frame[0] + frame[1] > begin:
                yield self.open(frame)[max(begin - frame[0], 0):end - frame[0]]

    def span(self, frames: list[Frame], begin: int, end: int) -> Iterator[Frame]:
        """Frames of the code points [begin, end): whole ones as they are, cut ones opened."""
        at = max(bisect_right(frames, begin, key=lambda f: f[0]) - 1, 0)
        for frame in frames[at:]:
            a, b = max(begin - frame[0], 0), min(end - frame[0], frame[1])
            if frame[0] >= end:
                return
            if a == 0 and b == frame[1]:
                yield frame
            elif a < b:
                yield 0, b - a, self.packer.compress(self.open(frame)[a:b].encode())

    def mark(self, text: str) -> Frame:
        return 0, len(text), self.packer.compress(text.encode())

    def digest(self, pieces: Iterable[str]) -> str:
        state = hashlib.sha256()
        for part in pieces:
            state.update(part.encode())
        return state.hexdigest()

    def marks(self, frames: list[Frame]) -> dict[str, int]:
        """Where each mark first stands, in code points, reading the frames in order."""
        found: dict[str, int] = {}
        tail = ""
        for frame in frames:
            text = tail + self.open(frame)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                if mark not in found and (at := text.find(mark)) >= 0:
                    found[mark] = frame[0] - len(tail) + at
            tail = text[-2:]
        return found

    def restored(self, frames: list[Frame], form: str) -> Iterator[str]:
        """The text that ``frames``, an output of the given form, were made from."""
        length = frames[-1][0] + frames[-1][1] if frames else 0
        if form == "plain":
            yield from self.read(frames, 0, length)
            return
        at = self.marks(frames)
        ends = {PREFIX: at[SUFFIX], SUFFIX: at[MIDDLE]} if form == "psm" else {SUFFIX: at[PREFIX], PREFIX: at[MIDDLE]}
        for mark in (PREFIX, MIDDLE, SUFFIX):
            yield from self.read(frames, at[mark] + len(mark), ends.get(mark, length))


def _placed(frames: Iterable[Frame]) -> list[Frame]:
    """Frames one after another, with the code points before each counted anew."""
    out, first = [], 0
    for _, units, data in frames:
        out.append((first, units, data))
        first += units
    return out


def rearranged(codec: Codec, frames: list[Frame], form: str, first: int, second: int) -> list[Frame]:
    """The output of a form, cut after ``first`` and ``second`` code points."""
    if form == "plain":
        return frames
    length = frames[-1][0] + frames[-1][1]
    spans = {PREFIX: (0, first), SUFFIX: (second, length), MIDDLE: (first, second)}
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    return _placed(f for mark in order for f in (codec.mark(mark), *codec.span(frames, *spans[mark])))


# -- tables -------------------------------------------------------------------

def _frames_array(rows: list[list[Frame]]) -> pa.Array:
    flat = [f for row in rows for f in row]
    offsets, total = [0], 0
    for row in rows:
        total += len(row)
        offsets.append(total)
    first, units, data = zip(*flat) if flat else ((), (), ())
    values = pa.StructArray.from_arrays(
        [pa.array(first, pa.int64()), pa.array(units, pa.int64()), pa.array(data, pa.binary())],
        names=["first", "units", "data"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _frames_of(column: pa.Array) -> Iterator[list[Frame]]:
    for row in column.to_pylist():
        yield [(f["first"], f["units"], f["data"]) for f in row]


def _with(batch: pa.RecordBatch, drop: tuple[str, ...], **new: pa.Array) -> pa.RecordBatch:
    kept = {n: batch.column(n) for n in batch.schema.names if n not in drop and n not in new}
    return pa.RecordBatch.from_pydict({**kept, **new})


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``docs`` with ``n`` (code points) and ``frames`` in place of ``text``, written to the shared folder.

    ``marked`` tells whether the text holds one of the marks.
    """
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c != "text" and c.lower() not in RESULTS]
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    rows = docs.select(*[F.col(f"`{c}`") for c in others], marked.alias("marked"), text.alias("text"))

    def pack(batches):
        codec = Codec(frame_bytes)
        for part in slices(batches):
            frames = [list(codec.pack(t)) for t in arrow_text(part.column("text")).cast(pa.binary()).to_pylist()]
            units = pa.array([f[-1][0] + f[-1][1] if f else 0 for f in frames], pa.int64())
            yield _with(part, ("text",), n=units, frames=_frames_array(frames))
    schema = T.StructType([*rows.drop("text").schema.fields, T.StructField("n", T.LongType()),
                           T.StructField("frames", FRAMES)])
    return cut(rows.mapInArrow(pack, schema))


def draw(stored: DataFrame, doc_id: str = "doc_id", seed: int = 1, plain_from: int = 90,
         spm_below: int = 20) -> DataFrame:
    """Add ``form`` and the two cuts, drawn from the hash of the seed and the id.

    The first four 8-digit groups of the hexadecimal sha256 of ``seed:id`` give
    the cuts (remainders by n + 1) and the form (remainders by 100).
    """
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)

    def group(i: int) -> Column:
        return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    one, two = (group(i) % (F.col("n") + 1) for i in (0, 1))
    plain = (F.col("n") == 0) | F.col("marked") | (group(2) % 100 >= plain_from)
    form = F.when(plain, "plain").when(group(3) % 100 < spm_below, "spm").otherwise("psm")
    return stored.withColumns({
        "form": form, "prefix_chars": F.when(~plain, F.least(one, two)),
        "middle_chars": F.when(~plain, F.abs(one - two))})


def fill_in_middle(stored: DataFrame) -> DataFrame:
    """Each text's output as frames in place of its own; ``stored`` has a form and the two lengths.

    ``n`` stays the text's own number of code points.
    """
    ship(stored.sparkSession)

    def rearrange(batches):
        codec = Codec()
        for part in batches:
            forms, firsts, middles = (part.column(c).to_pylist() for c in ("form", "prefix_chars", "middle_chars"))
            out = [rearranged(codec, frames, form, first or 0, (first or 0) + (middle or 0))
                   for frames, form, first, middle in zip(_frames_of(part.column("frames")), forms, firsts, middles)]
            yield _with(part, (), frames=_frames_array(out))
    return _mapped(stored, rearrange, stored.schema)


def digests(filled: DataFrame) -> DataFrame:
    """sha256 of each output, and of the text rebuilt from the output and its form alone."""
    ship(filled.sparkSession)

    def read(batches):
        codec = Codec()
        for part in batches:
            outputs, restored = [], []
            for frames, form in zip(_frames_of(part.column("frames")), part.column("form").to_pylist()):
                outputs.append(codec.digest(map(codec.open, frames)))
                restored.append(codec.digest(codec.restored(frames, form)))
            yield _with(part, ("frames",), output_sha256=pa.array(outputs, pa.string()),
                        restored_sha256=pa.array(restored, pa.string()))
    rest = [f for f in filled.schema.fields if f.name != "frames"]
    return _mapped(filled, read, T.StructType([*rest, T.StructField("output_sha256", T.StringType()),
                                               T.StructField("restored_sha256", T.StringType())]))


def texts(framed: DataFrame) -> DataFrame:
    """The whole text of each row's frames as ``text`` in their place."""
    ship(framed.sparkSession)

    def read(batches):
        codec = Codec()
        for part in batches:
            whole = ["".join(map(codec.open, frames)) for frames in _frames_of(part.column("frames"))]
            yield _with(part, ("frames",), text=pa.array(whole, pa.string()))
    rest = [f for f in framed.schema.fields if f.name != "frames"]
    return _mapped(framed, read, T.StructType([*rest, T.StructField("text", T.StringType())]))


def _mapped(framed: DataFrame, work, schema: T.StructType) -> DataFrame:
    """``work`` on batches of a few megabytes of frames."""
    ordered = [f.name for f in schema.fields]

    def run(batches):
        for part in work(piece for batch in batches if batch.num_rows for piece in parts(batch, _sizes(batch))):
            yield part.select(ordered)
    return framed.mapInArrow(run, schema)


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    """The bytes of each row's frames."""
    frames = batch.column("frames")
    lengths = np.asarray(pc.binary_length(frames.flatten().field("data"))).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return np.diff(ends[np.asarray(frames.offsets) - frames.offsets[0].as_py()])
