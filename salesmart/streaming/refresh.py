"""Daily refresh: recompute the months that new documents touch, nothing else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from salesmart.operators import cleaning, extraction, reach
from salesmart.plans import jobs
from salesmart.plans.lookups import attach
from salesmart.session import cut
from salesmart.sources.readers import load_dataset
from salesmart.sources.sinks import save_dataset
from salesmart.sources.snapshots import Publication, current_name, read_published

MONTH = ["companyfn", "_year", "_month"]
DOCUMENT = ["companyfn", "uniquenum_pri"]
#: what a refresh keeps by month; the labelled revenue report is renewed with the revenue
DATED = ("sales_trend", "sales_data", "monthly_revenue", "monthly_reach")
ESCAPED = "\"#%'*/:=?\\\x7f{[]^"   # fixed values: written as %XX in folder names


def touched_months(changed: DataFrame) -> DataFrame:
    """Tenants and months in which the changed documents lie; those without a tenant or date lie in none."""
    return changed.where("companyfn IS NOT NULL AND date_trans IS NOT NULL").select(
        "companyfn", F.year("date_trans").alias("_year"), F.month("date_trans").alias("_month")).distinct()


def rows_of_months(df: DataFrame, months: DataFrame) -> DataFrame:
    """All rows, old and new, of the touched months.

    The span of the months goes to the scan as a literal range, where it skips
    files and row groups; the join then picks the exact months.
    """
    start = F.make_date("_year", "_month", F.lit(1))
    first, end = months.agg(F.min(start), F.add_months(F.max(start), 1)).first()
    if first is not None:
        df = df.where((F.col("date_trans") >= F.lit(first).cast("timestamp_ntz"))
                      & (F.col("date_trans") < F.lit(end).cast("timestamp_ntz")))
    dated = df.withColumns({"_year": F.year("date_trans"), "_month": F.month("date_trans")})
    return attach(dated, months, MONTH, "inner").drop("_year", "_month")


def refresh(headers: DataFrame, lines: DataFrame, changed_headers: DataFrame, out: str,
            changed_lines: DataFrame | None = None, previous_headers: DataFrame | None = None,
            create: bool = False, published: bool = False, names: Sequence[str] = DATED) -> None:
    """Replace the touched months of the dated datasets, or of those of them that ``names`` tells.

    ``previous_headers`` are the changed documents as they were; a document
    whose date has moved then leaves its old month as well.  Without the
    datasets of a full job there is nothing to refresh: that is an error, or
    with ``create`` every month of ``headers`` is built.

    A month is recomputed whole from all its documents, then its partition is
    replaced, so earlier months and the rest of the report stay.  Running it
    again for the same changes gives the same files.  Month labels of the
    revenue report depend on all months and are renewed from the report itself.

    With ``published`` the datasets in ``out`` are snapshots: they change all at
    once, when everything is written, and are read with ``read_dataset``.
    """
    spark = headers.sparkSession
    known = current_name(spark, out) is not None if published else _exists(spark, f"{out}/monthly_revenue.parquet")
    if not known:
        if not create:
            raise FileNotFoundError(f"no monthly_revenue in {out}: run the full job first")
        changed_headers, changed_lines = headers, lines
    touched = touched_months(changed_headers)
    if previous_headers is not None:
        touched = touched.unionByName(touched_months(previous_headers)).distinct()
    months = cut(touched)
    some = rows_of_months(headers, months)

    def sales_data() -> tuple[DataFrame, DataFrame]:
        due = months if changed_lines is None else cut(months.unionByName(touched_months(changed_lines)).distinct())
        return cleaning.clean_lines(extraction.sales_lines(rows_of_months(lines, due))), due
    builders = {
        "sales_trend": lambda: (cleaning.trend_calendar(extraction.sales_trend(some)), months),
        "sales_data": sales_data,
        "monthly_revenue": lambda: (extraction.monthly_revenue(some), months),
        "monthly_reach": lambda: (reach.monthly_reach(some), months),
    }
    dated = {name: build() for name, build in builders.items() if name in names or name == "monthly_revenue"}
    if published:
        _publish(spark, out, dated)
        return
    if "monthly_reach" in dated and not _exists(spark, f"{out}/monthly_reach.parquet"):
        # a build from before there were sketches
        dated["monthly_reach"] = (reach.monthly_reach(headers), touched_months(headers))
    for name, (df, due) in dated.items():
        _replace(df, f"{out}/{name}.parquet", due, jobs.SLICES.get(name, 1))
    report = load_dataset(headers.sparkSession, f"{out}/monthly_revenue.parquet")
    save_dataset(cleaning.revenue_levels(report), f"{out}/revenue_report_by_date.parquet", "parquet",
                 jobs.PARTITIONS["revenue_report_by_date"], whole=True)


def _publish(spark: SparkSession, out: str, dated: dict[str, tuple[DataFrame, DataFrame]]) -> None:
    """Write all datasets beside the published ones, then switch to them."""
    publication = Publication(spark, out)
    for name, (df, due) in dated.items():
        publication.write(name, df, jobs.PARTITIONS[name],
                          due.withColumnsRenamed({"_year": "year", "_month": "month"}))
    months = publication.read("monthly_revenue", jobs.PARTITIONS["monthly_revenue"])
    name = "revenue_report_by_date"
    publication.write(name, cleaning.revenue_levels(months), jobs.PARTITIONS[name])
    publication.commit()


def read_dataset(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A dataset of published refreshes, as of the last that was completed."""
    return read_published(spark, out, name, jobs.PARTITIONS[name])


def _replace(df: DataFrame, path: str, due: DataFrame, slices: int = 1) -> None:
    """Overwrite the partitions of ``df`` and drop due months that have no rows left.

    The rows are made and written once.  Spark names the files of every write anew, so
    a month that still has a file from before has got no rows.
    """
    spark = df.sparkSession
    before = cut(_files_of_months(load_dataset(spark, path))) if _exists(spark, path) else None
    save_dataset(df, path, "parquet", ["companyfn", "year", "month"], slices=slices)
    if before is None:
        return
    stale = _files_of_months(load_dataset(spark, path)).join(before.select("_file").distinct(), "_file", "left_semi").select(
        *MONTH).distinct()
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    # one folder name per emptied month, usually none
    for row in _missing(due, stale, "left_semi").toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path("/".join(
            [path, *(f"{name}={_folder_value(v)}" for name, v in zip(("companyfn", "year", "month"), row))]))
        folder.getFileSystem(conf).delete(folder, True)


def _files_of_months(dataset: DataFrame) -> DataFrame:
    """The names of the files that hold a month's rows; only partition columns are read."""
    return dataset.select("companyfn", F.col("year").alias("_year"), F.col("month").alias("_month"),
                          F.col("_metadata.file_path").alias("_file")).distinct()


def _missing(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on the month, nulls being equal."""
    right = right.withColumnsRenamed({c: f"{c}_r" for c in MONTH})
    on = F.lit(True)
    for c in MONTH:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_r"))
    return left.join(right, on, how)


def _folder_value(value) -> str:
    """A partition value as it stands in a folder's name."""
    if value is None:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in ESCAPED else c for c in str(value))


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def daily(headers: DataFrame, lines: DataFrame, as_of: str, out: str, model_dir: str, days: int = 30,
          previous_headers: DataFrame | None = None, retrain_above: dict[str, int] | None = None, **options) -> dict:
    """Refresh what the last ``days`` days touch and retrain.

    ``retrain_above`` names the rows needed to retrain (``main``: changed
    documents, ``churn``, ``forecast``); by default there is no such gate.  The
    result holds what was trained; what was not is absent.
    """
    start = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")
    end = F.lit(as_of).cast("timestamp_ntz")

    def recent(df: DataFrame) -> DataFrame:
        return df.where((F.col("date_trans") >= start) & (F.col("date_trans") <= end))
    changed = cut(recent(headers))
    latest_lines = recent(lines)
    save_dataset(cleaning.clean_main(extraction.sales_main(changed)), f"{out}/sales_main_latest.parquet", whole=True)
    save_dataset(cleaning.clean_lines(extraction.sales_lines(latest_lines)), f"{out}/sales_data_latest.parquet",
                 whole=True)
    refresh(headers, lines, changed, out, latest_lines, previous_headers)
    gates = retrain_above or {}
    if "main" in gates and changed.count() <= gates["main"]:
        return {}
    retention = extraction.customer_retention(headers)
    return jobs.train_models(retention, extraction.sales_trend(changed), model_dir, minimum=gates, **options)


def latest_versions(log: DataFrame, version: str | None = None, deleted: str | None = None) -> DataFrame:
    """The last version of every document in a log with a ``batch`` column.

    Later is what has the greater ``version``, or without one, what arrived in a
    later batch; ties are settled by the batch and then by the other columns, so
    the same log always gives the same documents.  With ``deleted``, a column
    that is true in the last version takes the document away.  One aggregate that
    combines before its shuffle; no window.
    """
    others = [c for c in log.columns if c not in (version, "batch", *DOCUMENT)]
    order = [F.col(c) for c in ((version, "batch") if version else ("batch",))]
    newest = F.max(F.struct(*order, *[F.col(c) for c in others])).alias("_newest")
    latest = log.groupBy(*DOCUMENT).agg(newest).select(*DOCUMENT, "_newest.*").select(*log.columns)
    return latest.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else latest


def _of_documents(log: DataFrame, documents: DataFrame) -> DataFrame:
    return log.join(documents, DOCUMENT, "left_semi")


def refresh_stream(arriving: DataFrame, headers_path: str, lines: DataFrame, out: str, checkpoint: str,
                   version: str | None = None, deleted: str | None = None, published: bool = False,
                   names: Sequence[str] = DATED) -> StreamingQuery:
    """Take arriving headers into the log of versions and refresh the months they touch.

    One pass over what has arrived, then the query stops: start it daily.
    A batch is written under its number, so a batch that is run again after a
    failure replaces its own files and nothing is counted twice.

    A document may arrive again, changed: only its last version counts
    (``latest_versions``), and the month it lay in before is refreshed as well.
    An older version that arrives late changes nothing.  Documents are told apart
    by tenant and order key; one without them is left out.  Of the log, a refresh
    reads the documents that have ever lain in a touched month.
    """
    columns = [c for c in arriving.columns if c not in (version, deleted)]

    def take_in(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{headers_path}/batch={batch_id}")
        schema = T.StructType([*arriving.schema.fields, T.StructField("batch", T.LongType())])
        log = spark.read.schema(schema).parquet(headers_path).where(F.col("batch") <= batch_id).dropna(
            subset=DOCUMENT)
        new = cut(log.where(F.col("batch") == batch_id).select(*DOCUMENT).distinct())
        before = cut(latest_versions(_of_documents(log.where(F.col("batch") < batch_id), new), version, deleted))
        after = cut(latest_versions(_of_documents(log, new), version, deleted))
        known = current_name(spark, out) is not None if published else _exists(spark, f"{out}/monthly_revenue.parquet")
        if known:
            months = cut(touched_months(before).unionByName(touched_months(after)).distinct())
            log = _of_documents(log, cut(rows_of_months(log, months).select(*DOCUMENT).distinct()))
        every = latest_versions(log, version, deleted).select(*columns)
        refresh(every, lines, after.select(*columns), out, previous_headers=before.select(*columns), create=True,
                published=published, names=names)

    return (arriving.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
