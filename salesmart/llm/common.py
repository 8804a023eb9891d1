"""Shared helpers: tables, code shipping, and numpy work on batches of text.

Texts are handled as the UTF-8 bytes of Arrow string columns; a batch is cut
into slices of a few megabytes, so that a task's memory does not depend on how
many rows Spark puts into one batch.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.session import shared_folder

SLICE_BYTES = 2 << 20
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    The archive goes to the shared folder through Hadoop's file system, so no
    executor needs the repository on its own disk.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted((root / "salesmart").rglob("*.py")):
            archive.write(path, str(path.relative_to(root)))
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/salesmart_code.zip")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(data.getvalue())
    out.close()
    sc.addPyFile(target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString())
    _shipped.add(sc.applicationId)


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but doc_id and text under names that no operator uses."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"__extra{i}" for i, c in enumerate(docs.columns)])


def fold(column: str, modulus: int):
    """crc32 of the id's text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def one_row_an_id(rows: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, text) rows with one text for each id: that of the least hash, combined before the shuffle."""
    return rows.groupBy("doc_id", *columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def arrow_text(column) -> pa.Array:
    """A text column without nulls (null becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts (and the end)."""
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(where, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(batches, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
            yield from parts(batch, sizes, limit)


def parts(batch: pa.RecordBatch, sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose sizes sum to at most ``limit``; a larger row comes alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


# -- words ---------------------------------------------------------------

_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
SPACE = np.isin(_byte, [9, 10, 11, 12, 13, 32])
#: everything but letters, digits and the bytes of non-ASCII letters
NO_LETTER = ~(((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122))
              | (_byte >= 128))
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n-1 modulo 2**64, and their inverses."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def span_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [begin, end), by sums of scaled codes."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def word_spans(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray):
    """Start and end of every word, and the number of words before each text (and in all)."""
    inside = ~separators[buf]
    fresh = np.zeros(len(buf) + 1, bool)
    fresh[offs] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    last[:-1] &= ~inside[1:] | fresh[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, offs)


def words(column: pa.Array, separators: np.ndarray = SPACE, lower: bool = True):
    """Hashes of all words in a row, and the number of words before each text (and in all)."""
    buf, offs = flat(column)
    buf = LOWER[buf] if lower else buf
    begin, end, firsts = word_spans(buf, offs, separators)
    return span_hashes(buf, begin, end), firsts


def shingles(column: pa.Array, width: int = 5):
    """Per text the hashes of its runs of ``width`` words, with repeats.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    h, firsts = words(column)
    counts = np.diff(firsts)
    n_out = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(n_out)])
    # position of every shingle's first word
    start = np.arange(out_first[-1]) - np.repeat(out_first[:-1] - firsts[:-1], n_out)
    length = np.repeat(np.minimum(counts, width), n_out)
    total = np.full(len(start), 0x51ED270B, np.uint64)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    for k in range(width):
        total = np.where(k < length, mix(total * np.uint64(_BASE) + padded[start + k]), total)
    return total, out_first


def grouped(batches, keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys, from batches sorted by the keys."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        columns = [rows.column(k).to_numpy() for k in keys]
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        bounds = [*np.flatnonzero(new), rows.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            key = tuple(c[a].item() if hasattr(c[a], "item") else c[a] for c in columns)
            if key != held_key and held:
                yield held_key, pa.concat_tables(held)
                held = []
            held_key = key
            held.append(rows.slice(a, b - a))
    if held:
        yield held_key, pa.concat_tables(held)
