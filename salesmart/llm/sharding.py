"""Shards of near equal bytes by histogram sort, with built-in functions only.

Rows are ordered by a long key.  Wanted are the keys (splitters) below which
1/n, 2/n, ... of all bytes lie.  Every round counts, exactly and in all
partitions, the bytes below evenly spaced candidate keys, then looks closer at
the one cell of each splitter that is still too coarse; when every splitter is
within tolerance, or its cell is a single row, rows are exchanged once.

A shard is made of parts of about ``part_bytes``, each with its own splitter,
so that no task sorts a whole shard.  What the driver holds grows with the
number of parts, not with the rows.

Rows with one key are told apart by a serial number, so a key with a third of
all rows is split as well.  Null keys sort first; null texts have no bytes; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesmart.session import cut

FIRST_BITS, STEP_BITS = 12, 6     # candidate keys: 4096 in the first round, 64 in each later cell
PART_BYTES = 1 << 30
SERIAL_BITS = 63


@dataclass(frozen=True)
class Level:
    """Cells of rows whose position and serial agree in their leading bits."""

    position_shift: int
    serial_shift: int = SERIAL_BITS

    def cell(self):
        return (F.shiftright("position", self.position_shift).alias("cp"),
                F.shiftright("serial", self.serial_shift).alias("cs") if self.serial_shift < SERIAL_BITS
                else F.lit(0).cast("long").alias("cs"))

    def start(self, cell: tuple[int, int]) -> tuple[int, int]:
        return cell[0] << self.position_shift, cell[1] << self.serial_shift

    def after(self, cell: tuple[int, int]) -> tuple[int, int]:
        if self.serial_shift == SERIAL_BITS:
            return (cell[0] + 1) << self.position_shift, 0
        return cell[0], (cell[1] + 1) << self.serial_shift

    def holding(self, start: tuple[int, int]) -> tuple[int, int]:
        return start[0] >> self.position_shift, start[1] >> self.serial_shift

    def finer(self) -> Level | None:
        if self.position_shift:
            return Level(max(0, self.position_shift - STEP_BITS))
        return Level(0, max(0, self.serial_shift - STEP_BITS)) if self.serial_shift else None


def small_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A local relation of whole numbers."""
    values = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def find_splitters(rows: DataFrame, bits: int, wanted: list[float],
                   tolerance: float) -> list[tuple[int, int, int]]:
    """For each wanted count of bytes (rising): position, serial, and the rows below.

    ``rows`` has position (of so many ``bits``), serial and size; one pass a round.
    """
    level, outer = Level(max(0, bits - FIRST_BITS)), None
    found: dict[int, tuple[int, int, int]] = {}
    below = {}                                   # open cell of the round before -> (bytes, rows) below it
    active = rows
    while len(found) < len(wanted):
        counts = active.groupBy(*level.cell()).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        edges, run, b0, n0 = [], None, 0, 0      # (bytes below, rows below, cell, its bytes, its rows)
        for cp, cs, b, n in sorted(tuple(r) for r in counts):
            if outer is not None and run != (inside := outer.holding(level.start((cp, cs)))):
                run, (b0, n0) = inside, below[inside]
            edges.append((b0, n0, (cp, cs), b, n))
            b0, n0 = b0 + b, n0 + n
        below, at = {}, 0
        for j, want in enumerate(wanted):
            if j in found:
                continue
            while at + 1 < len(edges) and edges[at + 1][0] <= want:
                at += 1
            b0, n0, cell, b, n = edges[at]
            if level.finer() is None or n == 1 or min(want - b0, b0 + b - want) <= tolerance:
                near_start = want - b0 <= b0 + b - want
                found[j] = (*level.start(cell), n0) if near_start else (*level.after(cell), n0 + n)
            else:
                below[cell] = (b0, n0)
        if below:
            cells = small_table(rows.sparkSession, list(below), "cp, cs")
            cp, cs = level.cell()
            active = (rows.withColumns({"cp": cp, "cs": cs})
                      .join(F.broadcast(cells), ["cp", "cs"], "left_semi")   # one row for each splitter at most
                      .select("position", "serial", "size"))
        level, outer = level.finer(), level
    return sorted(found.values())


def histogram_shards(df: DataFrame, key: str, size: str, n_shards: int, tolerance: float = 0.001,
                     part_bytes: int = PART_BYTES) -> DataFrame:
    """All columns of ``df`` plus ``shard`` (0 to n-1) and ``slot`` (0, 1, ... in key order).

    ``key`` and ``size`` name long columns.  Shards differ from equal bytes by
    ``tolerance`` of a shard, or by one row where a row is larger than that.
    The input is written once (keep its columns few); the rounds run at build
    time and return only counts.
    """
    spark = df.sparkSession
    held = cut(df.withColumns({"__key": F.col(key).cast("long"), "__serial": F.monotonically_increasing_id(),
                               "__size": F.col(size)}))
    total, low, high = held.agg(F.sum("__size"), F.min("__key"), F.max("__key")).first()
    low, high, total = low or 0, high or 0, total or 0
    # keys further apart than 2**61 are compared without their last two bits; the serial does the rest
    drop = 2 if high - low >= 1 << 61 else 0
    position = F.coalesce(F.shiftright("__key", drop) - F.lit(low >> drop).cast("long") + 1, F.lit(0).cast("long"))
    located = held.withColumn("__position", position)
    parts = max(1, -(-total // (n_shards * part_bytes)))
    pieces = n_shards * parts
    splitters = [] if total == 0 else find_splitters(
        located.select(F.col("__position").alias("position"), F.col("__serial").alias("serial"),
                       F.col("__size").alias("size")),
        ((high >> drop) - (low >> drop) + 2).bit_length(),
        [total * j / pieces for j in range(1, pieces)], tolerance * total / n_shards)
    starts = [(i, n) for i, n in enumerate([0, *(s[2] for s in splitters)])]
    slots = small_table(spark, [(i, n - starts[i - i % parts][1]) for i, n in starts], "__part, __first")
    window = Window.partitionBy("__part").orderBy("__position", "__key", "__serial")
    return (located.withColumn("__part", _part_of(splitters))
            .withColumn("__rank", F.row_number().over(window))
            .join(F.broadcast(slots), "__part")     # one row for each part
            .withColumns({"shard": F.expr(f"CAST(__part DIV {parts} AS INT)"),
                          "slot": F.col("__first") + F.col("__rank") - 1})
            .drop("__key", "__serial", "__size", "__position", "__part", "__rank", "__first"))


def _part_of(splitters: list[tuple[int, int, int]]):
    """The number of splitters at or below a row, by halving."""
    position, serial = F.col("__position"), F.col("__serial")

    def halve(low: int, high: int):
        if low == high:
            return F.lit(low).cast("long")
        middle = (low + high) // 2
        p, s, _ = splitters[middle]
        above = (position > F.lit(p)) | ((position == F.lit(p)) & (serial >= F.lit(s)))
        return F.when(above, halve(middle + 1, high)).otherwise(halve(low, middle))

    return halve(0, len(splitters))
