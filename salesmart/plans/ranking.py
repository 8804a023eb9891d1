"""Positions, quantiles and row windows in groups of any size.

A plain ``row_number`` or ``percentile`` per group gathers the whole group in
one task.  Here positions come from a range-partitioned, sorted and written
table: a row's place in its partition plus the counts of earlier partitions.
Quantiles sort nothing: a sketch brackets each edge, exact counts place the
brackets, and only the values inside them are looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from salesmart.session import cut

INDEX, SIZE = "_index", "_size"
_SPOT, _PART, _OFFSET, _TOTAL = "_spot", "_part", "_offset", "_total"
_VALUE, _ZONE, _COPIES, _EDGES = "_value", "_zone", "_copies", "_brackets"

#: share of a group on either side of an edge that a bracket holds
MARGIN = 1e-4
#: rows that one task may sort; a smaller group is bracketed by its ends
SMALL = 1_000_000
#: intervals into which a bracket with too many values is cut
PIECES = 128


def in_order(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` written in the order of (keys, order), each row with its spot.

    The rows are range-partitioned, sorted, and numbered as they are written:
    the partition in the upper bits, the row below (31 and 33 bits).  As the
    numbers are written with the rows, a retried task cannot move the borders.
    """
    by = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return cut(ranged.withColumn(_SPOT, F.monotonically_increasing_id()))


def positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add to rows written by ``in_order`` their 0-based position in the group and the group's size.

    A group's rows in a partition are consecutive, so a position is the distance
    from the first of them, plus the group's rows in earlier partitions.  The
    table of these pieces has a row per partition and per group; Spark chooses
    the join by its size, as written.
    """
    part = F.shiftright(_SPOT, 33)
    group = W.partitionBy(*keys)
    pieces = rows.groupBy(part.alias(_PART), *keys).agg(
        F.count(F.lit(1)).alias(_TOTAL), F.min(_SPOT).alias("_first"))
    pieces = cut(pieces.withColumn(SIZE, F.sum(_TOTAL).over(group)).withColumn(
        _OFFSET, F.sum(_TOTAL).over(group.orderBy(_PART)) - F.col(_TOTAL) - F.col("_first")).select(
        F.col(_PART).alias("_key_part"), *[F.col(k).alias(f"_key_{k}") for k in keys], SIZE, _OFFSET))
    same = part == F.col("_key_part")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    return rows.join(pieces, same).withColumn(INDEX, F.col(_SPOT) + F.col(_OFFSET)).drop(
        _SPOT, _OFFSET, "_key_part", *[f"_key_{k}" for k in keys])


def with_position(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add the 0-based position of every row in its group and the group's size.

    ``order`` must be total within a group.  One exchange, one written table.
    """
    return positions(in_order(df, keys, order), keys)


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, fractions: list[float], name: str,
                    margin: float = MARGIN, small: int = SMALL) -> DataFrame:
    """Linearly interpolated quantiles per group as an array column ``name``.

    ``df`` is read twice and should be a written table.  The first reading makes
    a sketch per group, and from it a bracket around each edge; the second counts
    the values inside brackets one by one and all others by the gap they lie in.
    Counts before a value are then exact, whatever the sketch was worth; were an
    edge outside its bracket, the reading is repeated with wider ones.  A bracket
    that still holds more than ``small`` values is cut into intervals, and only
    those around the edge are kept, until it is small.

    Equal values are counted before the shuffle, so a value that fills a third
    of the table costs one row.  Nulls do not take part.
    """
    values = df.select(*keys, value.cast("double").alias(_VALUE)).where(F.col(_VALUE).isNotNull())
    ascending = sorted(range(len(fractions)), key=lambda i: fractions[i])
    while True:
        counted = _bracketed(values, keys, [fractions[i] for i in ascending], margin)
        while counted.count() > small and _largest_group(counted, keys) > small:
            narrowed = _narrowed(counted, keys, fractions)
            if _largest_group(narrowed, keys) >= _largest_group(counted, keys):
                break
            counted = narrowed
        ends = cut(_ends(counted, keys, fractions))
        missed = F.lit(False)
        for i in range(len(fractions)):
            missed = missed | F.col(f"_low{i}").isNull() | F.col(f"_high{i}").isNull()
        if margin >= 1 or ends.where(missed).isEmpty():
            return ends.select(*keys, F.array(*_interpolated(fractions)).alias(name))
        margin = min(1.0, margin * 100)


def _bracketed(values: DataFrame, keys: list[str], fractions: list[float], margin: float) -> DataFrame:
    """Counts of the values inside brackets, and of the gaps between them.

    The zone of a value is the number of brackets wholly below it; a gap's row
    has no value and comes before the values of its zone.
    """
    probes = [min(max(f + side, 0.0), 1.0) for f in fractions for side in (-margin, margin)]
    # the error of the sketch is half the margin
    sketch = F.percentile_approx(_VALUE, probes, int(2 / margin) + 1)
    # where the margin is a few rows only, the group is small and all of it is kept
    whole = F.array(*[c for _ in fractions for c in (F.min(_VALUE), F.max(_VALUE))])
    few = F.count(F.lit(1)) * margin < 4
    brackets = values.groupBy(*keys).agg(F.when(few | F.lit(margin >= 1), whole).otherwise(sketch).alias(_EDGES))
    joined = _joined(values, brackets, keys)
    zone, inside = F.lit(0), F.lit(False)
    for i in range(len(fractions)):
        low, high = F.get(_EDGES, F.lit(2 * i)), F.get(_EDGES, F.lit(2 * i + 1))
        zone = zone + (F.col(_VALUE) > high).cast("int")
        inside = inside | ((F.col(_VALUE) >= low) & (F.col(_VALUE) <= high))
    return cut(joined.groupBy(*keys, zone.cast("long").alias(_ZONE), F.when(inside, F.col(_VALUE)).alias(_VALUE)).agg(
        F.count(F.lit(1)).alias(_COPIES)))


def _joined(rows: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's figures, null keys being equal."""
    if not keys:
        return rows.crossJoin(F.broadcast(figures))  # an ungrouped aggregate: one row
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    return rows.join(cut(figures.withColumnsRenamed({k: f"_key_{k}" for k in keys})), same).drop(
        *[f"_key_{k}" for k in keys])


def _largest_group(counted: DataFrame, keys: list[str]) -> int:
    return counted.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _places(size: Column, fractions: list[float]) -> list[tuple[Column, Column]]:
    """The places of the values below and above each edge."""
    spots = [(size - 1) * F.lit(float(f)) for f in fractions]
    return [(F.floor(x), F.ceil(x)) for x in spots]


def _counted_up(counted: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Add the group's size and the first and last place of each row's copies."""
    group = W.partitionBy(*keys)
    upto = F.sum(_COPIES).over(group.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return counted.withColumn(SIZE, F.sum(_COPIES).over(group)).withColumn("_last", upto - 1).withColumn(
        "_first", upto - F.col(_COPIES))


def _holds(place: Column) -> Column:
    return (F.col("_first") <= place) & (place <= F.col("_last"))


def _ends(counted: DataFrame, keys: list[str], fractions: list[float]) -> DataFrame:
    """Per group its size and the values below and above each edge; null where a gap holds the place."""
    picks = [F.max(F.when(_holds(place), F.col(_VALUE))).alias(f"_{end}{i}")
             for i, places in enumerate(_places(F.col(SIZE), fractions))
             for end, place in zip(("low", "high"), places)]
    # the rows of a group are few by now: at most ``small``; gaps come first, as nulls do
    placed = _counted_up(counted, keys, _ZONE, _VALUE)
    return placed.groupBy(*keys).agg(F.max(SIZE).alias(SIZE), *picks)


def _narrowed(counted: DataFrame, keys: list[str], fractions: list[float]) -> DataFrame:
    """The same counts, with the values of intervals that hold no edge summed up to gaps."""
    steps = [i / PIECES for i in range(1, PIECES)]
    bounds = counted.groupBy(*keys).agg(F.percentile_approx(_VALUE, steps, 20 * PIECES).alias("_bounds"))
    interval = F.when(F.col(_VALUE).isNull(), -1).otherwise(
        F.size(F.filter("_bounds", lambda bound: bound < F.col(_VALUE))))
    cells = cut(_joined(counted, bounds, keys).withColumn("_interval", interval).drop("_bounds"))
    totals = _counted_up(cells.groupBy(*keys, _ZONE, "_interval").agg(F.sum(_COPIES).alias(_COPIES)),
                         keys, _ZONE, "_interval")
    wanted = F.lit(False)
    for low, high in _places(F.col(SIZE), fractions):
        wanted = wanted | _holds(low) | _holds(high)
    # zones are numbered anew, in the order of (zone, interval)
    number = F.row_number().over(W.partitionBy(*keys).orderBy(_ZONE, "_interval"))
    totals = cut(totals.withColumn("_wanted", wanted).withColumn("_number", number.cast("long")).select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col(_ZONE).alias("_key_zone"),
        F.col("_interval").alias("_key_interval"), "_wanted", "_number"))
    same = (F.col(_ZONE) == F.col("_key_zone")) & (F.col("_interval") == F.col("_key_interval"))
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    return cut(cells.join(totals, same).groupBy(
        *keys, F.col("_number").alias(_ZONE), F.when(F.col("_wanted"), F.col(_VALUE)).alias(_VALUE)).agg(
        F.sum(_COPIES).alias(_COPIES)))


def _interpolated(fractions: list[float]) -> list[Column]:
    edges = []
    for i, fraction in enumerate(fractions):
        place = (F.col(SIZE) - 1) * F.lit(float(fraction))
        share = place - F.floor(place)
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        # measured from the nearer end, so that a place a hair below a value's gives that value
        edges.append(F.when(share < 0.5, low + (high - low) * share).otherwise(high - (high - low) * (1 - share)))
    return edges


def approx_quantiles(df: DataFrame, keys: list[str], value: Column,
                     fractions: list[float], name: str, accuracy: int = 100_000) -> DataFrame:
    """Sketch-based quantiles per group: one pass, no sort, bounded memory."""
    return df.groupBy(*keys).agg(
        F.percentile_approx(value.cast("double"), [float(x) for x in fractions], accuracy).alias(name)
    )


def quantiles(df: DataFrame, keys: list[str], value: Column, fractions: list[float],
              name: str, exact: bool = True) -> DataFrame:
    return (exact_quantiles if exact else approx_quantiles)(df, keys, value, fractions, name)


def over_rows(df: DataFrame, keys: list[str], order: list[Column], lookback: int,
              columns: Callable[[WindowSpec], dict[str, Column]],
              block_rows: int = 100_000) -> DataFrame:
    """Columns over a window of at most ``lookback`` preceding rows of the group.

    Every group is cut into blocks of ``block_rows`` consecutive rows, so no
    task holds a large group; a block also receives the last ``lookback`` rows
    of the block before it, and those guests are dropped afterwards.
    """
    size = max(block_rows, lookback, 1)
    placed = with_position(df, keys, order)
    home = F.floor(F.col(INDEX) / F.lit(size))
    lends = F.pmod(F.col(INDEX), F.lit(size)) >= size - lookback
    blocks = F.when(lends, F.array(home, home + 1)).otherwise(F.array(home))
    spread = placed.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    window = W.partitionBy(*keys, "_block").orderBy(F.col(INDEX))
    return (
        spread.withColumns(columns(window))
        .where(F.col("_block") == F.col("_home"))
        .drop(INDEX, SIZE, "_home", "_block")
    )


def interior(k: int) -> list[float]:
    """The k - 1 fractions that separate k quantile buckets."""
    return [i / k for i in range(1, k)]
