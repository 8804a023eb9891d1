"""Customer clusters and purchase scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from salesmart.operators import features, models
from salesmart.operators.models import Trained
from salesmart.plans.ranking import INDEX, SIZE, with_position
from salesmart.session import cut

RFM = ["recency", "frequency", "monetary"]


def customer_clusters(rfm: DataFrame, k: int = 5, starts: int = 10) -> tuple[Trained, DataFrame]:
    """k-means segments on recency, frequency and monetary value."""
    trained = models.train_clusters(rfm, RFM, k, starts)
    return trained, models.predict(trained.model, rfm, "cluster")


def _numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct keys with a dense number: ALS wants integers."""
    distinct = df.select(*keys).distinct()
    placed = with_position(distinct, [], [F.col(k) for k in keys])
    return placed.withColumn(name, F.col(INDEX).cast("int")).drop(INDEX, SIZE)


def train_recommender(facts: DataFrame, rank: int = 10, iterations: int = 10) -> tuple:
    """Factorise quantities bought per customer and product of a tenant.

    Returns the model and the two tables that number customers and products;
    the numbering is done by a distributed sort, not on the driver.
    """
    bought = cut(
        facts.where(F.col("customer_id").isNotNull() & F.col("product_code").isNotNull())
        .groupBy("companyfn", "customer_id", "product_code")
        .agg(F.sum("quantity").cast("float").alias("quantity")).where(F.col("quantity") > 0))
    customers = cut(_numbered(bought, ["companyfn", "customer_id"], "customer_number"))
    products = cut(_numbered(bought, ["companyfn", "product_code"], "product_number"))
    rated = bought.join(customers, ["companyfn", "customer_id"]).join(products, ["companyfn", "product_code"])
    als = ALS(userCol="customer_number", itemCol="product_number", ratingCol="quantity", implicitPrefs=True,
              rank=rank, maxIter=iterations, seed=models.SEED, coldStartStrategy="drop",
              checkpointInterval=2)   # a checkpoint lets go of what the iterations before it have shuffled
    return als.fit(cut(rated)), customers, products


def candidates(facts: DataFrame, per_category: int = 20) -> DataFrame:
    """Products a customer may want: the most bought of the favourite category among those not bought yet.

    ``popularity`` ranks a category's products by their number of buyers, ties
    by code.  A customer gets the first ``per_category`` they have not bought:
    the places up to that number plus what they have bought of the category are
    looked at, in slices of ``per_category`` places, so the work grows with the
    customers and their purchases and not with customers times products.
    """
    known = facts.where(F.col("customer_id").isNotNull() & F.col("product_code").isNotNull())
    liked = features.favorites(known).where(F.col("favorite_category").isNotNull()).select(
        "companyfn", "customer_id", F.col("favorite_category").alias("category_name"))
    bought = cut(known.select("companyfn", "customer_id", "category_name", "product_code").distinct())
    buyers = bought.groupBy("companyfn", "category_name", "product_code").agg(F.count(F.lit(1)).alias("buyers"))
    place = F.row_number().over(
        W.partitionBy("companyfn", "category_name").orderBy(F.desc("buyers"), F.col("product_code")))
    slice_of = F.expr(f"(popularity - 1) div {per_category}")
    popular = buyers.withColumn("popularity", place).withColumn("_slice", slice_of)

    own = bought.groupBy("companyfn", "customer_id", "category_name").agg(F.count(F.lit(1)).alias("_own"))
    reach = liked.join(own, ["companyfn", "customer_id", "category_name"], "left").withColumn(
        "_reach", F.coalesce("_own", F.lit(0)) + per_category)
    slices = F.sequence(F.lit(0).cast("long"), F.expr(f"(_reach - 1) div {per_category}"))
    new = reach.withColumn("_slice", F.explode(slices)).join(
        popular, ["companyfn", "category_name", "_slice"]).where("popularity <= _reach").join(
        bought.select("companyfn", "customer_id", "product_code"), ["companyfn", "customer_id", "product_code"],
        "left_anti")
    best = F.row_number().over(W.partitionBy("companyfn", "customer_id").orderBy("popularity"))
    return new.withColumn("_best", best).where(F.col("_best") <= per_category).select(
        "companyfn", "customer_id", "product_code", "category_name", "buyers", "popularity")


#: customers of a tenant that one scoring call looks at, about
CHUNK_ROWS = 32_768
#: customers whose blocks are chosen in one call, about
CHOICE_ROWS = 8_192
#: blocks that one task cuts out of a slab, about
SLAB_BLOCKS = 64
#: customers and products whose scores are held at a time
TILE = (256, 2048)


def _norm(factors: Column) -> Column:
    return F.sqrt(F.aggregate(factors, F.lit(0.0), lambda total, x: total + x * x))


def _unknown(factors: Column) -> Column:
    return F.exists(factors, lambda x: x.isNull() | F.isnan(x))


def best_unbought(customers: DataFrame, products: DataFrame, bought: DataFrame, n: int = 5,
                  block_rows: int = 4_096) -> DataFrame:
    """The ``n`` products of the largest inner product that a customer has not bought, of all the tenant's.

    ``customers`` and ``products`` hold one array ``factors`` per (companyfn,
    customer_id) and (companyfn, product_code), all of one length; ``bought``
    holds the pairs to leave out.  Ties go to the smaller code.  A customer gets
    ``min(n, unbought)`` rows.  Nothing is approximate and no category is cut.

    A tenant's products are dealt into blocks of near factors (``_in_blocks``), its
    customers into chunks of ``CHUNK_ROWS``.  What a block's products can score at
    most follows from their bounds in each factor and from their length
    (``_chooser``).  A customer meets the block that promises most, and from then on
    only blocks that promise more than their n-th score, or as much from a smaller
    code.  Those that have bought too much of a block to find ``n`` there meet 16, 256
    ... blocks, so the rounds grow with the logarithm of the blocks.  Chunks and blocks meet in a
    grouping: a customer's factors are dealt out once a block, a product's once a
    chunk, and only products that come among a customer's best leave the task.
    """
    key = ["companyfn", "customer_id"]
    mine = cut(customers.select(*key, F.col("factors").cast("array<double>").alias("_mine")))
    vague, scored = mine.where(_unknown(F.col("_mine"))), mine.where(~_unknown(F.col("_mine")))
    products = products.where(F.col("companyfn").isNotNull()).select(
        "companyfn", "product_code", F.col("factors").cast("array<double>"))
    placed = cut(_in_blocks(products, scored, block_rows))
    limits = cut(_limits(placed))

    chunks = cut(mine.groupBy("companyfn").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).alias("_chunks")))
    # a customer without an identifier has no known purchases and stays in the first chunk with some others
    chunk = F.pmod(F.xxhash64("customer_id"), F.col("_chunks"))
    skipped = cut(bought.select("companyfn", "customer_id", "product_code").distinct()
                  .join(placed.select("companyfn", "product_code", "_block"), ["companyfn", "product_code"])
                  .where(F.col("customer_id").isNotNull()).join(chunks, "companyfn")
                  .withColumn("_chunk", chunk).drop("_chunks"))
    waiting = cut(scored.join(chunks, "companyfn").withColumn("_chunk", chunk).drop("_chunks").withColumns({
        "_least": F.lit(None).cast("double"), "_code": F.lit(None).cast(placed.schema["product_code"].dataType)}))
    meeting, best, first, last = waiting, None, 0, 1
    while True:
        found = _best_of_blocks(meeting, (placed, limits), skipped, first, last, n)
        found = found if best is None else best.drop("rank").unionByName(found)
        order = W.partitionBy(*key).orderBy(F.desc("purchase_score"), "product_code")
        best = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n))
        # who had an n-th score before this round has met all that may reach it
        nth = F.when(F.col("rank") == n, F.col("product_code"))
        least = best.groupBy(*[F.col(k).alias(f"{k}_r") for k in key]).agg(
            F.when(F.count("purchase_score") == n, F.min("purchase_score")).alias("_least"), F.max(nth).alias("_code"))
        same = (F.col("companyfn") == F.col("companyfn_r")) & F.col("customer_id").eqNullSafe(F.col("customer_id_r"))
        waiting = cut(waiting.where(F.col("_least").isNull()).drop("_least", "_code").join(least, same, "left")
                      .drop("companyfn_r", "customer_id_r"))
        first, last = last, 16 * last
        meeting = cut(_needed(waiting, limits, first, last))
        if meeting.isEmpty():
            break
    return best if vague.isEmpty() else best.unionByName(_first_by_code(vague, products, bought, n))


def _in_blocks(products: DataFrame, customers: DataFrame, block_rows: int) -> DataFrame:
    """Products with the ``_block`` they belong to: at most ``block_rows`` of a tenant with near factors.

    Shells by the length of the factors come first, each twice as large as the one
    before, so that few products are as long as the longest.  A shell is sorted by the
    factor that moves scores most and dealt into slabs, and a task cuts a slab in two,
    by the factor that then moves scores most, until the pieces are blocks.  Equal
    products are told apart by their codes, so a block is never larger.
    """
    ranked = with_position(products.withColumn("_long", _norm(F.col("factors"))), ["companyfn"],
                           [F.desc("_long"), F.col("product_code")])
    ranked = ranked.withColumn("_shell", F.floor(F.log2(F.expr(f"{INDEX} div {block_rows} + 1")))).drop(INDEX, SIZE)
    size = ranked.select(F.size("factors")).first()
    places = range(size[0] if size else 0)
    weight = customers.groupBy("companyfn").agg(F.array(
        *[F.avg(F.get("_mine", F.lit(k)) * F.get("_mine", F.lit(k))) for k in places]).cast("array<double>").alias("_weights"))
    spread = ranked.where(~_unknown(F.col("factors"))).groupBy("companyfn").agg(F.array(
        *[F.var_pop(F.get("factors", F.lit(k))) for k in places]).cast("array<double>").alias("_spread"))
    moved = F.transform(F.arrays_zip("_weights", "_spread"), lambda x: x["_weights"] * x["_spread"])
    weighed = cut(weight.join(spread, "companyfn", "left").select(
        "companyfn", "_weights", F.coalesce(F.array_position(moved, F.array_max(moved)), F.lit(1)).alias("_widest")))
    ranked = ranked.join(weighed.select("companyfn", "_widest"), "companyfn").withColumn(
        "_along", F.get("factors", F.greatest(F.col("_widest"), F.lit(1)).cast("int") - 1)).drop("_widest", "_long")
    along = with_position(ranked, ["companyfn", "_shell"], [F.col("_along"), F.col("product_code")])
    slabs = F.ceil(F.col(SIZE) / (SLAB_BLOCKS * block_rows))
    slab = F.floor(F.col(INDEX) * slabs / F.col(SIZE))
    schema = T.StructType([*products.schema.fields, T.StructField("_block", T.LongType())])
    return along.withColumn("_slab", slab).drop(INDEX, SIZE, "_along").join(weighed.drop("_widest"), "companyfn").groupBy(
        "companyfn", "_shell", "_slab").applyInPandas(_cutter(block_rows), schema)


def _cutter(block_rows: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What cuts a slab into blocks; a closure, as ``_scorer``."""
    def in_blocks(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("product_code", na_position="first", ignore_index=True)
        scale = np.sqrt(np.nan_to_num(np.asarray(rows["_weights"].iloc[0], dtype=float), posinf=1.0))
        with np.errstate(all="ignore"):
            near = np.nan_to_num(np.stack(rows["factors"]).astype(float)) * scale
        block, pieces, number = np.empty(len(rows), dtype="int64"), [np.arange(len(rows))], 0
        while pieces:
            piece = pieces.pop()
            if len(piece) <= block_rows:
                block[piece] = number
                number += 1
                continue
            with np.errstate(all="ignore"):
                widest = np.argmax(np.nan_to_num(near[piece].std(axis=0))) if near.shape[1] else None
            values = near[piece, widest] if widest is not None else np.zeros(len(piece))
            order = np.lexsort((piece, values))
            piece, values, half = piece[order], values[order], len(piece) // 2
            # equal values stay together where that leaves a quarter on each side
            edges = np.searchsorted(values, values[half], "left"), np.searchsorted(values, values[half], "right")
            edge = min(edges, key=lambda x: abs(x - half))
            half = edge if len(piece) <= 4 * min(edge, len(piece) - edge) else half
            pieces += [piece[:half], piece[half:]]
        # shells are less than 64, blocks of a slab less than rows
        rows["_block"] = (rows["_slab"].to_numpy("int64") * 64 + rows["_shell"].to_numpy("int64")) * (1 << 32) + block
        return rows[["companyfn", "product_code", "factors", "_block"]]
    return in_blocks


def _limits(placed: DataFrame) -> DataFrame:
    """Per block the bounds of its products in each factor, the longest, and the smallest code; missing factors aside."""
    size = placed.select(F.size("factors")).first()
    known = placed.withColumn("_known", F.when(~_unknown(F.col("factors")), F.col("factors")))
    places = [F.get("_known", F.lit(k)) for k in range(size[0] if size else 0)]
    all_named = F.count("product_code") == F.count(F.lit(1))     # a product without a code comes before all others
    return known.groupBy("companyfn", "_block").agg(
        F.max(_norm(F.col("_known"))).alias("_longest"), F.when(all_named, F.min("product_code")).alias("_smallest"),
        F.array(*[F.min(x) for x in places]).cast("array<double>").alias("_low"),
        F.array(*[F.max(x) for x in places]).cast("array<double>").alias("_high"))


def _needed(waiting: DataFrame, limits: DataFrame, first: int, last: int) -> DataFrame:
    """Every waiting customer with the blocks they are to meet, a row each (``_chooser``)."""
    groups = cut(waiting.groupBy("companyfn").agg(F.ceil(F.count(F.lit(1)) / CHOICE_ROWS).alias("_groups")))
    group = F.pmod(F.xxhash64("customer_id", F.lit(1)), F.col("_groups"))
    told = limits.join(groups, "companyfn").withColumn(
        "_group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1))).drop("_groups")
    asking = waiting.join(groups, "companyfn").withColumn("_group", group).drop("_groups")
    # columns of their own, as both sides of the grouping know the groups
    told = told.select(*[F.col(c).alias(c) for c in told.columns])
    asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])
    parts = int(waiting.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told, asking = (side.repartition(parts, "companyfn", "_group") for side in (told, asking))
    schema = T.StructType([waiting.schema[c] for c in ("companyfn", "customer_id", "_chunk", "_mine", "_least")])
    return told.groupBy("companyfn", "_group").cogroup(asking.groupBy("companyfn", "_group")).applyInPandas(
        _chooser(first, last), schema.add("_block", T.LongType()))


def _chooser(first: int, last: int, tile: int = 256) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What tells customers the blocks they are to meet; a closure, as ``_scorer``."""
    def chosen(blocks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Blocks that may reach a customer's n-th score; without one, those from place ``first`` on and before ``last``.

        Blocks have places by what they promise; those before ``first`` have been met.
        A bound is summed up as a score is, factor by factor in double precision, where
        rounding keeps the order: no product of the block scores more, not by a bit.
        """
        columns = ["companyfn", "customer_id", "_chunk", "_mine", "_least", "_block"]
        if not len(blocks) or not len(rows):
            return pd.DataFrame({c: [] for c in columns}, dtype=object)
        coded, boxed = "_smallest" in blocks, "_low" in blocks
        blocks = blocks.sort_values(["_smallest", "_block"] if coded else "_block", na_position="first", ignore_index=True)
        mine, least = np.stack(rows["_mine"]).astype(float), rows["_least"].to_numpy(dtype=float, na_value=np.nan)
        longest = blocks["_longest"].to_numpy(dtype=float, na_value=np.nan)
        if boxed:
            low, high = (np.stack(blocks[c]).astype(float).T for c in ("_low", "_high"))
        upto = np.full(len(rows), len(blocks))      # blocks whose smallest code is not after the customer's n-th
        if coded and not np.isnan(least).all():
            named = blocks["_smallest"].dropna().to_numpy(dtype=object)
            unnamed = len(blocks) - len(named)
            upto = np.array([unnamed if code is None else unnamed + np.searchsorted(named, code, "right")
                             for code in rows["_code"].astype(object).where(rows["_code"].notna(), None)])
        who, which = [], []
        for start in range(0, len(rows), tile):
            q, floor = mine[start:start + tile], least[start:start + tile]
            with np.errstate(all="ignore"):
                bound = np.linalg.norm(q, axis=1)[:, None] * longest * (1 + 1e-9) + 1e-300
                if boxed:
                    total = np.zeros_like(bound)
                    for k in range(q.shape[1]):
                        total += np.maximum(q[:, k, None] * low[k], q[:, k, None] * high[k])
                    bound = np.fmin(bound, total)
            bound[np.isnan(bound)] = np.inf
            bound[:, np.isnan(longest)] = -np.inf       # only missing factors
            need, settled = np.zeros(bound.shape, dtype=bool), ~np.isnan(floor)
            place = np.arange(len(blocks)) < upto[start:start + tile, None]
            need[settled] = ((bound > floor[:, None]) | ((bound == floor[:, None]) & place))[settled]
            if last == 1 or (first == 1 and settled.all()):
                order = bound.argmax(axis=1)[:, None]   # the first of equals, as in the order of places
            else:
                order = np.argsort(-bound, axis=1, kind="stable")[:, :last]
            np.put_along_axis(need, order[:, :first], False, axis=1)
            i, j = np.flatnonzero(~settled)[:, None], order[~settled][:, first:]
            need[i, j] = True
            i, j = np.nonzero(need)
            who.append(start + i)
            which.append(j)
        who, which = np.concatenate(who), np.concatenate(which)

        def taken(name: str) -> pd.Series:
            column = rows[name]
            return pd.Series(column.astype(object).where(column.notna(), None).to_numpy()[who], dtype=object)
        return pd.DataFrame({c: taken(c) for c in columns[:-1]} | {"_block": blocks["_block"].to_numpy("int64")[which]})
    return chosen


def _first_by_code(vague: DataFrame, products: DataFrame, bought: DataFrame, n: int) -> DataFrame:
    """For customers with missing factors, whose scores are all missing: the first ``n`` unbought products by code.

    A customer looks at as many products of the tenant as they have bought, and ``n`` more.
    """
    key = ["companyfn", "customer_id"]
    owned = bought.select(*key, "product_code").distinct()
    own = vague.select(*key).join(owned, key).groupBy(*key).agg(F.count(F.lit(1)).alias("_own"))
    vague = cut(vague.select(*key).join(own, key, "left").withColumn("_deep", F.coalesce("_own", F.lit(0)) + n).drop("_own"))
    deepest = vague.groupBy("companyfn").agg(F.max("_deep").alias("_deepest"))
    codes = with_position(products.select("companyfn", "product_code"), ["companyfn"], [F.col("product_code")])
    codes = cut(codes.join(deepest, "companyfn").where(F.col(INDEX) < F.col("_deepest")).drop(SIZE, "_deepest"))
    left = vague.join(codes, "companyfn").where(F.col(INDEX) < F.col("_deep")).join(owned, [*key, "product_code"], "left_anti")
    return recommendations(left.select(*key, "product_code", F.lit(None).cast("double").alias("purchase_score")), n)


def _best_of_blocks(waiting: DataFrame, blocks: tuple[DataFrame, DataFrame], skipped: DataFrame, first: int, last: int,
                    n: int) -> DataFrame:
    """The best ``n`` of each block that a customer meets.

    ``blocks`` are the products with their block, and the limits of each block.
    ``waiting`` holds a customer once for every ``_block`` to meet; without that column
    they meet the blocks that promise most, from place ``first`` on and before ``last``.
    """
    products, limits = blocks
    meeting = ["companyfn", "_chunk", "_block"]
    needed = waiting if "_block" in waiting.columns else cut(_needed(waiting, limits, first, last))
    meetings = cut(needed.select(*meeting).distinct())
    # columns of their own, as both sides of the grouping come from the customers
    dealt = products.join(meetings, ["companyfn", "_block"]).select(
        *[F.col(c).alias(c) for c in (*meeting, "product_code", "factors")])
    rows = needed.select(*meeting, "customer_id", "_mine", "_least").unionByName(
        skipped.join(meetings, meeting, "left_semi").select(*meeting, "customer_id", "product_code"),
        allowMissingColumns=True)
    types = {f.name: f.dataType for f in [*waiting.schema, *products.schema]}
    schema = T.StructType([T.StructField(c, types[c]) for c in ("companyfn", "customer_id", "product_code")])
    # the work is in the pairs, not in the bytes: the partitions are named, so that they are not put together by size
    parts = int(waiting.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, rows = (side.repartition(parts, *meeting) for side in (dealt, rows))
    return dealt.groupBy(*meeting).cogroup(rows.groupBy(*meeting)).applyInPandas(
        _scorer(n), schema.add("purchase_score", T.DoubleType()))


def _scorer(n: int, tile: tuple[int, int] = TILE) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What is done where a chunk meets a block; a closure, so that workers need not import this module."""
    def best_of_meeting(products: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The best ``n`` unbought products of one block for each customer of one chunk.

        ``rows`` are customers, with factors, and their purchases, without.  Scores
        are looked through in single precision, with an allowance for its error; those
        that may count are taken again in double precision, factor by factor.
        """
        is_customer = rows["_mine"].notna()
        customers = rows[is_customer].reset_index(drop=True)
        products = products.sort_values("product_code", ignore_index=True)  # so that places are in the order of ties
        if not len(customers) or not len(products):
            return pd.DataFrame({"companyfn": [], "customer_id": [], "product_code": [], "purchase_score": []}, dtype=object)
        mine, theirs = np.stack(customers["_mine"]).astype(float), np.stack(products["factors"]).astype(float)
        # a missing factor makes a missing score, which comes after all others
        vague, unknown = np.isnan(mine).any(axis=1), np.isnan(theirs).any(axis=1)
        mine[vague], theirs[unknown] = 0.0, 0.0
        places, unscored = np.arange(len(theirs)), np.flatnonzero(unknown)
        known = rows.loc[~is_customer, ["customer_id", "product_code"]].merge(
            customers[["customer_id"]].reset_index(names="_who"), on="customer_id").merge(
            products[["product_code"]].reset_index(names="_what"), on="product_code")[["_who", "_what"]].to_numpy()
        known = known[np.argsort(known[:, 0], kind="stable")]

        # unit lengths, so that single precision neither overflows nor loses small factors
        reach, longest = np.linalg.norm(mine, axis=1), np.linalg.norm(theirs, axis=1).max()
        scale = np.where(reach > 0, reach, 1.0) * (longest if longest > 0 else 1.0)
        mine32 = (mine / np.where(reach > 0, reach, 1.0)[:, None]).astype("float32")
        theirs32 = np.ascontiguousarray((theirs / (longest if longest > 0 else 1.0)).astype("float32").T)
        error = (mine.shape[1] + 4) * 2.4e-7
        lowest = np.finfo("float32").min
        least = customers["_least"].to_numpy(dtype=float, na_value=-np.inf)

        who, what, score = [], [], []
        for start in range(0, len(mine), tile[0]):
            stop = min(start + tile[0], len(mine))
            held = (np.empty(0, int), np.empty(0, int), np.empty(0))    # the best so far: customer, product, score
            floor = least[start:stop].copy()
            mark, end = np.searchsorted(known[:, 0], (start, stop))
            own = known[mark:end]
            for left in range(0, len(theirs), tile[1]):
                near = mine32[start:stop] @ theirs32[:, left:left + tile[1]]
                here = own[(own[:, 1] >= left) & (own[:, 1] < left + near.shape[1])]
                near[here[:, 0] - start, here[:, 1] - left] = -np.inf
                near[vague[start:stop]], near[:, unknown[left:left + tile[1]]] = -np.inf, -np.inf
                bound = floor / scale[start:stop] - error
                open_ended = np.flatnonzero(np.isneginf(floor))
                if len(open_ended) and near.shape[1] > n:
                    nth = np.partition(near[open_ended], -n, axis=1)[:, -n]
                    bound[open_ended] = nth - 2.0 * error
                bound = np.maximum(bound, lowest).astype("float32")
                bound = np.nextafter(bound, np.float32(-np.inf)).clip(lowest)   # masked scores stay below
                i, j = np.divmod(np.flatnonzero(near >= bound[:, None]), near.shape[1])
                if not len(i):
                    continue
                exact = np.zeros(len(i))
                for k in range(mine.shape[1]):
                    exact += mine[start + i, k] * theirs[left + j, k]
                keep = exact >= floor[i]
                i, j, exact = (np.concatenate(pair) for pair in zip(held, (i[keep], left + j[keep], exact[keep])))
                order = np.lexsort((j, -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                held = tuple(x[rank < n] for x in (i, j, exact))
                full = rank == n - 1
                floor[i[full]] = np.maximum(floor[i[full]], exact[full])
            if len(unscored) or vague[start:stop].any():
                short = np.flatnonzero(np.isneginf(least[start:stop]) & (np.bincount(held[0], minlength=stop - start) < n))
                for i in short:
                    known_here = own[own[:, 0] == start + i, 1]
                    left_over = n - np.count_nonzero(held[0] == i)
                    pool = (places if vague[start + i] else unscored)[:left_over + len(known_here)]
                    more = np.setdiff1d(pool, known_here)[:left_over]
                    held = tuple(np.concatenate(x) for x in zip(held, (np.full(len(more), i), more, np.full(len(more), np.nan))))
            who.append(start + held[0])
            what.append(held[1])
            score.append(held[2])
        who, what = np.concatenate(who), np.concatenate(what)

        def taken(column: pd.Series, places: np.ndarray) -> pd.Series:
            return pd.Series(column.astype(object).where(column.notna(), None).to_numpy()[places], dtype=object)
        return pd.DataFrame({"companyfn": taken(customers["companyfn"], who),
                             "customer_id": taken(customers["customer_id"], who),
                             "product_code": taken(products["product_code"], what),
                             "purchase_score": np.concatenate(score)})   # NaN goes back as null
    return best_of_meeting


def learned_factors(fitted: tuple) -> tuple[DataFrame, DataFrame]:
    """The factors of a trained recommender by customer and by product."""
    model, customers, products = fitted
    mine = model.userFactors.withColumnsRenamed({"id": "customer_number", "features": "factors"})
    theirs = model.itemFactors.withColumnsRenamed({"id": "product_number", "features": "factors"})
    return (mine.join(customers, "customer_number").select("companyfn", "customer_id", "factors"),
            theirs.join(products, "product_number").select("companyfn", "product_code", "factors"))


def purchase_scores(fitted: tuple, pairs: DataFrame) -> DataFrame:
    """Score of each given (tenant, customer, product) pair.

    Work grows with the pairs passed in; ``best_unbought`` finds the best of all.
    """
    model, customers, products = fitted
    numbered = (
        pairs.select("companyfn", "customer_id", "product_code").distinct()
        .join(customers, ["companyfn", "customer_id"]).join(products, ["companyfn", "product_code"]))
    return model.transform(numbered).select(
        "companyfn", "customer_id", "product_code", F.col("prediction").cast("double").alias("purchase_score"))


def recommendations(scores: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best scored products of every customer."""
    rank = F.row_number().over(
        W.partitionBy("companyfn", "customer_id").orderBy(F.desc("purchase_score"), F.col("product_code")))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)
