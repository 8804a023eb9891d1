"""N-gram Jaccard join by MinHash banding.

A text's set is its five-word shingles (all its words where it has fewer; ASCII
case ignored).  Texts with equal sets form one entry, so copies cost nothing.

1. Signatures: ``HASHES`` least hash values of a set, 16 bits each.  The rows of
   a band are the most for which pairs at the threshold meet in some band with
   the wanted recall (20 bands of 4 rows for 0.8 and 0.9999).
2. Entries are shuffled on band hashes.  In a bucket, pairs whose signatures
   agree in at least half of all places are candidates (a pair at 0.8 falls
   short of that once in a thousand million); a bucket returns a spanning forest
   of its candidates, not its pairs.
3. The forests' components gather all candidates of a text.  Each component is
   verified on the full sets; it returns for each text the number of its links
   and a spanning forest of verified links, whose components are the classes.

Buckets and components of many texts are cut into blocks, and every pair of
blocks is one group of its own, so no task holds a large one.

Null and wordless texts have an empty set: no links, a class of their own.
Repeated rows are copies of each other.  A class is named by its least doc_id;
rows with a null doc_id are joined like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.common import apart, arrow_text, grouped, mix, shingles, ship, slices
from salesmart.llm.components import components
from salesmart.session import cut

THRESHOLD, RECALL, WIDTH, HASHES = 0.8, 0.9999, 5, 80
BUCKET_BLOCK, TEXT_BLOCK, COLUMNS_AT_ONCE = 512, 192, 4096

_seeds = np.random.default_rng(20240229).integers(1 << 62, size=(2, HASHES), dtype=np.uint64)


def bands_for(threshold: float, recall: float) -> tuple[int, int]:
    """(bands, rows): the most rows, a divisor of 4, that reach the recall at the threshold."""
    for rows in (4, 2, 1):
        if 1 - (1 - threshold ** rows) ** (HASHES // rows) >= recall:
            return HASHES // rows, rows
    raise ValueError("the recall cannot be reached at this threshold")


def sets_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts in a row, and where each text's start."""
    h, firsts = shingles(column, width)
    doc = np.repeat(np.arange(len(column)), np.diff(firsts))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(column) + 1))


def signature_rows(column: pa.Array, width: int):
    """Per text: size of its set, two hashes that name the set, and its signature as rows of 16-bit values."""
    h, firsts = sets_of(column, width)
    size = np.diff(firsts)
    full = size > 0
    starts = firsts[:-1][full]
    name = np.zeros((2, len(size)), np.uint64)
    values = np.zeros((len(size), HASHES), np.uint16)
    if len(starts):
        for k in range(2):
            name[k, full] = np.add.reduceat(mix(h + np.uint64(k + 1)), starts)
        for k in range(HASHES):
            least = np.minimum.reduceat(h * (_seeds[0, k] | np.uint64(1)) + _seeds[1, k], starts)
            values[full, k] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return size, name.view(np.int64), values


def _spanning(adjacent: np.ndarray) -> np.ndarray:
    """By node the least node of its component."""
    label = np.arange(len(adjacent))
    while True:
        new = np.minimum(np.where(adjacent, label, len(label)).min(1), label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tiles(df: DataFrame, count: Column, spread: Column, block: int) -> DataFrame:
    """Adds tile_a, tile_b and own (the row's block): a row for each pair of blocks that the row is in."""
    blocks = F.ceil(count / block).cast("int")
    return (df.withColumn("own", F.pmod(spread, blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumns({"tile_a": F.least("own", "other"), "tile_b": F.greatest("own", "other")}).drop("other"))


def _in_tile(own: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which pairs of a tile's rows are its business."""
    return np.ones((len(own), len(own)), bool) if a == b else own[:, None] != own[None, :]


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                    width: int = WIDTH) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, ...) with class_id, n_links and keeper.

    ``n_links`` counts the other rows at ``threshold`` or above; ``keeper`` is
    true for one row of each class.  A column of ``docs`` named like one of
    these three gives way to it.  The input is written once with its signatures,
    and the join runs up to the classes at build time.
    """
    ship(docs.sparkSession)
    given = docs.columns
    docs = apart(docs)
    n_bands, band_rows = bands_for(threshold, recall)
    names = docs.columns
    signature_columns = [f"__b{k}" for k in range(HASHES // 4)]

    def sign(batches):
        for part in slices(batches):
            size, name, values = signature_rows(arrow_text(part.column("text")), width)
            longs = np.ascontiguousarray(values).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(size), pa.array(name[0]), pa.array(name[1]),
                 *(pa.array(np.ascontiguousarray(longs[:, k])) for k in range(longs.shape[1]))],
                names=[*names, "__size", "__u0", "__u1", *signature_columns])

    schema = docs.schema
    for c in ("__size", "__u0", "__u1", *signature_columns):
        schema = type(schema)([*schema.fields, *_long(c)])
    signed = cut(docs.mapInArrow(sign, schema).withColumn("__row", F.monotonically_increasing_id()))
    entries = cut(signed.where("__size > 0").groupBy("__u0", "__u1").agg(
        F.min("__row").alias("row"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id"),
        *[F.first(c).alias(c) for c in signature_columns]))

    candidates = components(_candidate_edges(entries, signature_columns, n_bands, band_rows))
    sizes = candidates.groupBy("root").agg(F.count("*").alias("members"))
    placed = _tiles(candidates.join(sizes, "root"), F.col("members"), F.xxhash64("node"), TEXT_BLOCK)
    texts = (signed.select(F.col("__row").alias("row"), "text")
             .join(entries.select("row", "copies"), "row").join(placed.withColumnRenamed("node", "row"), "row"))
    verified = cut(texts.repartition("root", "tile_a", "tile_b").sortWithinPartitions("root", "tile_a", "tile_b")
                   .select("root", "tile_a", "tile_b", "own", "row", "copies", "text")
                   .mapInArrow(_verifier(threshold, width), "row long, near long, links long"))
    classes = components(verified.select(F.col("row").alias("a"), F.col("near").alias("b")))
    links = verified.groupBy("row").agg(F.sum("links").alias("links"))
    named = entries.select("__u0", "__u1", "row", "copies", "least_id").join(
        classes.withColumnRenamed("node", "row"), "row", "left").join(links, "row", "left").withColumns(
        {"root": F.coalesce("root", "row"), "links": F.coalesce("links", F.lit(0)) + F.col("copies") - 1})
    heads = named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.min_by("row", F.struct(
        F.col("least_id").isNull(), "least_id", "row")).alias("head"))
    by_set = cut(named.join(heads, "root").select("__u0", "__u1", "row", "head", "class_id", "links"))
    by_set = by_set.join(_first_rows(signed, by_set), ["__u0", "__u1"], "left")
    full = signed.where("__size > 0").join(by_set, ["__u0", "__u1"]).select(
        *[F.col(f"`{c}`") for c in names], "class_id", F.col("links").alias("n_links"),
        F.coalesce(F.col("__row") == F.col("keeper_row"), F.lit(False)).alias("keeper"))
    empty = signed.where("__size = 0").select(
        *[F.col(f"`{c}`") for c in names], F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(True).alias("keeper"))
    made = ["class_id", "n_links", "keeper"]
    return full.unionByName(empty).select(
        *[F.col(n).alias(g) for n, g in zip(names, given) if g.lower() not in made], *made)


def _first_rows(signed: DataFrame, by_set: DataFrame) -> DataFrame:
    """For the set that heads a class, its row with the least doc_id."""
    heads = by_set.where("row = head").select("__u0", "__u1")
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("__row").alias("r"))
    return (signed.where("__size > 0").select("__u0", "__u1", "doc_id", "__row")
            .groupBy("__u0", "__u1").agg(F.min(key).alias("k"))
            .join(heads, ["__u0", "__u1"], "left_semi").select("__u0", "__u1", F.col("k.r").alias("keeper_row")))


def _long(name: str):
    from pyspark.sql.types import LongType, StructField
    return [StructField(name, LongType())]


def _candidate_edges(entries: DataFrame, signature_columns: list[str], n_bands: int, band_rows: int) -> DataFrame:
    """(a, b): spanning forests of the candidate pairs in all buckets."""
    longs = F.array(*signature_columns)
    if band_rows == 4:
        keys = longs
    else:   # a long holds several bands
        parts, bits = 4 // band_rows, 16 * band_rows
        keys = F.flatten(F.transform(longs, lambda x: F.array(*[
            F.shiftrightunsigned(F.shiftleft(x, 64 - bits * (p + 1)), 64 - bits) for p in range(parts)])))
    exploded = entries.select("row", F.posexplode(keys).alias("band", "bucket"))
    counts = exploded.groupBy("band", "bucket").agg(F.count("*").alias("members")).where("members > 1")
    placed = _tiles(exploded.join(counts, ["band", "bucket"]), F.col("members"), F.xxhash64("row"), BUCKET_BLOCK)
    keys = ["band", "bucket", "tile_a", "tile_b"]
    rows = (placed.select("row", *keys, "own").join(entries.select("row", *signature_columns), "row")
            .repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys))

    def forest(batches):
        for (_, _, a, b), group in grouped(batches, keys):
            row = group.column("row").to_numpy()
            values = np.stack([group.column(c).to_numpy() for c in signature_columns], 1).view(np.uint16)
            agree = np.zeros((len(row), len(row)), np.uint8)
            for k in range(HASHES):
                agree += values[:, k, None] == values[None, :, k]
            order = np.argsort(row)      # the root of a tree is its least row
            near = (agree >= HASHES // 2) & _in_tile(group.column("own").to_numpy(), a, b)
            label = _spanning(near[np.ix_(order, order)])
            tied = label != np.arange(len(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[order][tied]), pa.array(row[order][label[tied]])], names=["a", "b"])

    return rows.mapInArrow(forest, "a long, b long")


def _verifier(threshold: float, width: int):
    """Tasks that compare the full sets of a component's texts."""
    def verify(batches):
        for (_, a, b), group in grouped(batches, ["root", "tile_a", "tile_b"]):
            group = group.sort_by("row")
            row, copies = group.column("row").to_numpy(), group.column("copies").to_numpy()
            h, firsts = sets_of(arrow_text(group.column("text")), width)
            size = np.diff(firsts)
            values, column, held = np.unique(h, return_inverse=True, return_counts=True)
            doc = np.repeat(np.arange(len(row)), size)
            shared = held[column] > 1
            place = np.cumsum(held > 1) - 1
            doc, column = doc[shared], place[column[shared]]
            common = np.zeros((len(row), len(row)), np.float64)
            order = np.argsort(column, kind="stable")
            doc, column = doc[order], column[order]
            for start in range(0, int((held > 1).sum()), COLUMNS_AT_ONCE):
                i, j = np.searchsorted(column, [start, start + COLUMNS_AT_ONCE])
                member = np.zeros((len(row), COLUMNS_AT_ONCE), np.float32)
                member[doc[i:j], column[i:j] - start] = 1
                common += member @ member.T
            near = common * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9
            near &= _in_tile(group.column("own").to_numpy(), a, b)
            np.fill_diagonal(near, False)
            label = _spanning(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(row[label]), pa.array((near * copies[None, :]).sum(1))],
                names=["row", "near", "links"])

    return verify
