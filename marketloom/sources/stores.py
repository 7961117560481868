"""Tables kept between runs: assets, groups, features, results."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import MOST_BROADCAST, discard, exists, materialize, small
from .manifest import Manifest

FILE_PATTERN = r"output_prediction_[A-Za-z]+_(.+)_(\d{2}[A-Za-z]{3}\d{2})_(\d{4})(__completed)?\.parquet"


#: Rows of a bucket beyond which it is split, and the most bits of a bucket's name.
BUCKET_ROWS, MOST_BITS = 5_000_000, 24
#: Rows of a file of the store.
FILE_ROWS = 500_000


class AssetStore:
    """Tables in a folder, in buckets of tickers; one ticker reads one bucket.

    A bucket is named by the leading bits of the ticker's hash.  A save writes the touched
    buckets anew, all into one folder whose files are sorted by bucket, and then changes the
    table's list of buckets (``Manifest``), so that a table is always as it was before a
    save or after it: a bucket's rows are those of the folder that its entry names.  A
    bucket that grows beyond ``bucket_rows`` falls into smaller ones with longer names
    when it is written; the others stay.  A ticker's rows are never torn apart.  The number
    of files follows the rows, not the buckets.  A folder of which less than half is still
    in use is written anew by the next save.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path, bucket_rows

    def _manifest(self, table: str) -> Manifest:
        return Manifest(self.spark, f"{self.path}/{table}")

    @staticmethod
    def _bits(c: Column) -> Column:
        return F.lpad(F.substring(F.bin(F.xxhash64(c)), -64, 64), 64, "0").substr(1, MOST_BITS)

    def _few(self, rows: list[tuple], schema: str) -> DataFrame:
        """A table of a row a bucket, broadcast unless there are very many."""
        df = self.spark.createDataFrame(rows, schema)
        return F.broadcast(df) if len(rows) <= MOST_BROADCAST else df

    def _placed(self, df: DataFrame, buckets: dict) -> DataFrame:
        """Rows with the ``_bucket`` that their ticker is in: there is one for every ticker."""
        df = df.withColumn("_bits", self._bits(F.col("ticker")))
        depths = sorted({len(n) for n in buckets})
        if len(depths) == 1:
            return df.withColumn("_bucket", F.substring("_bits", 1, depths[0]))
        names = F.array(*[F.substring("_bits", 1, n) for n in depths])  # a candidate for each length that occurs
        return df.withColumn("_bucket", F.explode(names)).join(self._few([(n,) for n in buckets], "_bucket string"), "_bucket")

    def _stored(self, manifest: Manifest, content: dict, names: list[str]) -> DataFrame:
        """The rows of some buckets, with ``_save`` and ``_leaf`` (folder and bucket that they are stored in)."""
        buckets, rows = content["buckets"], content["folders"]
        folders = sorted({buckets[n]["path"] for n in names})
        df = self.spark.read.parquet(*[f"{manifest.path}/{p}" for p in folders])
        if sum(buckets[n]["rows"] for n in names) == sum(rows[p] for p in folders):
            return df  # all that is in these folders
        if len(names) == 1:
            df = df.where(F.col("_leaf") == f"b{names[0]}")  # files are sorted by it
        return df.join(self._few([(buckets[n]["path"].split("/")[1], f"b{n}") for n in names], "_save string, _leaf string"), ["_save", "_leaf"], "left_semi")

    def save(self, df: DataFrame, table: str, batch: tuple[str, int] | None = None) -> bool:
        """Replace the rows of the tickers in ``df``; those of other tickers stay.

        ``batch`` is (stream, number): a number that this stream has saved already, or a
        lower one, changes nothing (False).
        """
        manifest = self._manifest(table)
        version, content = manifest.read()
        buckets, batches, folders = content.get("buckets", {"": None}), content.get("batches", {}), content.get("folders", {})
        if batch and batches.get(batch[0], -1) >= batch[1]:
            return False
        placed = materialize(self._placed(df, buckets))
        used_up = [placed]
        touched = {r[0] for r in placed.select("_bucket").distinct().collect()}  # names of buckets
        if touched:
            used = Counter()
            for n, b in buckets.items():
                if b and n not in touched:
                    used[b["path"]] += b["rows"]
            touched |= {n for n, b in buckets.items() if b and 2 * used[b["path"]] < folders[b["path"]]}
        kept = [n for n in touched if buckets[n]]
        if kept:
            old = self._stored(manifest, content, kept).withColumns({"_bits": self._bits(F.col("ticker")), "_bucket": F.expr("substring(_leaf, 2)")})
            rest = old.select(*placed.columns).join(small(placed.select("ticker").distinct()), "ticker", "left_anti")
            used_up.append(materialize(rest))  # counted, then written
            placed = placed.unionByName(used_up[1])
        sizes = {r["_bucket"]: r["n"] for r in placed.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
        deeper = {n: min(MOST_BITS - len(n), max(0, (k - 1) // self.bucket_rows).bit_length()) for n, k in sizes.items()}
        commit = uuid.uuid4().hex
        new = {n: v for n, v in buckets.items() if n not in sizes}
        if deeper:
            at = f"data/{commit}/rows"
            if len(set(deeper.values())) > 1:
                placed = placed.join(self._few(list(deeper.items()), "_bucket string, _more int"), "_bucket")
            else:
                placed = placed.withColumn("_more", F.lit(next(iter(deeper.values()))))
            out = placed.withColumns({"_leaf": F.expr("concat('b', substring(_bits, 1, length(_bucket) + _more))"), "_save": F.lit(commit)}).drop("_bits", "_bucket", "_more")
            files = max(min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), sum(1 << d for d in deeper.values())), -(-sum(sizes.values()) // FILE_ROWS))
            out.repartition(files, "_leaf").sortWithinPartitions("_leaf", "ticker").write.parquet(f"{manifest.path}/{at}")
            found = self.spark.read.parquet(f"{manifest.path}/{at}").groupBy("_leaf").agg(F.count("*").alias("n")).collect()  # a row a bucket
            written = {r["_leaf"][1:]: r["n"] for r in found}
            for n, d in deeper.items():
                for k in range(1 << d):
                    name = n + (f"{k:0{d}b}" if d else "")
                    new[name] = {"path": at, "rows": written[name]} if name in written else None
            folders = folders | {at: sum(written.values())}
        named = {b["path"] for b in new.values() if b}
        manifest.commit(version, {"buckets": new, "batches": batches | ({batch[0]: batch[1]} if batch else {}), "folders": {p: n for p, n in folders.items() if p in named}})
        discard(*used_up)
        return True

    def load(self, table: str, ticker: str | None = None, tickers: DataFrame | None = None) -> DataFrame:
        """The table, of one ticker or of those in the column ``ticker`` of a table; only their buckets are read.

        Raises ``FileNotFoundError`` if there is no table."""
        manifest = self._manifest(table)
        _, content = manifest.read()
        buckets = content.get("buckets")
        if not buckets:
            raise FileNotFoundError(f"{self.path}: no table {table}")
        wanted = None
        if ticker is not None:
            wanted = self.spark.createDataFrame([(ticker,)], "ticker string")
        elif tickers is not None:
            wanted = small(tickers.select("ticker").distinct())
        names = list(buckets) if wanted is None else [r[0] for r in self._placed(wanted, buckets).select("_bucket").distinct().collect()]
        full = [n for n in names if buckets[n]]
        some = full or [n for n in buckets if buckets[n]][:1]
        df = self._stored(manifest, content, some).drop("_save", "_leaf")
        df = df if full else df.limit(0)
        return df.join(wanted, "ticker", "left_semi") if wanted is not None else df

    def exists(self, table: str, ticker: str | None = None) -> bool:
        if not any(self._manifest(table).read()[1].get("buckets", {}).values()):
            return False
        return ticker is None or not self.load(table, ticker).isEmpty()

    def vacuum(self, table: str) -> int:
        """Delete the folders that the last version doesn't name; nobody may be reading an older one."""
        manifest = self._manifest(table)
        _, content = manifest.read()
        named = {f"{manifest.path}/{b['path']}" for b in content.get("buckets", {}).values() if b}
        gone = manifest.unnamed(f"{manifest.path}/data", named)
        for path in gone:
            manifest.delete(path)
        return len(gone)


class GroupStore:
    """Membership, partitioned by group."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, membership: DataFrame) -> None:
        membership.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group").parquet(self.path)

    def load(self, group: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("group") == group).select("ticker")


class FeatureStore:
    """Features by kind, group and year."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, kind: str, group: str, year: int) -> str:
        return f"{self.path}/kind={kind}/group={group}/year={year}"

    def write(self, df: DataFrame, kind: str, group: str, year: int) -> None:
        df.write.mode("overwrite").parquet(self._at(kind, group, year))

    def write_years(self, df: DataFrame, kind: str, group: str, years: Sequence[int]) -> None:
        """All years of a group by one pass, each in place of what it had; years without rows get an empty table."""
        at, names = f"{self.path}/kind={kind}/group={group}", list(years)
        own = df.withColumn("year", F.year("Date")).where(F.col("year").isin(names))
        own.repartition("year", F.pmod(F.xxhash64("ticker"), F.lit(16))).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("year").parquet(at)
        written = {r[0] for r in own.select("year").distinct().collect()} if names else set()
        for y in (y for y in names if y not in written):
            df.limit(0).write.mode("overwrite").parquet(f"{at}/year={y}")

    def read(self, kind: str, group: str, years: Sequence[int]) -> DataFrame:
        """The years together; a missing one raises ``FileNotFoundError``."""
        missing = [y for y in years if not exists(self.spark, self._at(kind, group, y))]
        if missing:
            raise FileNotFoundError(f"{kind}, {group}: no features of {missing}")
        return self.spark.read.option("basePath", self.path).parquet(*[self._at(kind, group, y) for y in years])


def discover_outputs(spark: SparkSession, folder: str, pattern: str = FILE_PATTERN) -> DataFrame:
    """Path, group, date, time and whether it is completed, from the names of result folders; oldest first.

    Only names are listed, nothing is read.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    names = [(s.getPath().toString(),) for s in found]
    df = spark.createDataFrame(names, "path string")
    part = lambda k: F.regexp_extract("path", pattern, k)
    return df.where(F.col("path").rlike(pattern)).select(
        "path", part(1).alias("group"), F.to_date(part(2), "ddMMMyy").alias("date"), part(3).alias("time"), (part(4) != "").alias("completed")
    ).orderBy("date", "time", "group")


def unreadable(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str]]:
    """(path, error) of result files without a readable footer, in order.

    The footers of all files are read by one job; only if it fails, halves of the list are
    tried, so that few broken files among many cost few jobs.
    """
    def probe(some: list[str]) -> list[tuple[str, str]]:
        try:
            if some:
                spark.read.option("mergeSchema", True).parquet(*some).schema  # noqa: B018  reads the footers
            return []
        except Exception as e:
            if len(some) == 1:
                return [(some[0], str(e).strip().splitlines()[0][:300])]
            return probe(some[:len(some) // 2]) + probe(some[len(some) // 2:])
    return probe(list(paths))


def read_tolerant(spark: SparkSession, paths: Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the result files that can be read, and a table (path, error) of those that were skipped.

    A file is skipped as a whole or not at all: one that breaks off behind a good footer is an error.
    """
    skipped = unreadable(spark, paths)
    good = [p for p in paths if p not in {s[0] for s in skipped}]
    rows = spark.read.schema(schema).parquet(*good) if good else spark.createDataFrame([], schema)
    return rows, spark.createDataFrame(skipped, "path string, error string")


def in_order(df: DataFrame, order: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """K1: the order of written results, by those of the columns that there are (in any case)."""
    have = {c.lower(): c for c in df.columns}
    keys = [have[c.lower()] for c in order if c.lower() in have]
    return df.orderBy(*keys) if keys else df


def write_result(df: DataFrame, path: str, complete: str | None = None) -> bool:
    """Write in order unless it is there already, or (``complete``) any value of that column is NULL."""
    if exists(df.sparkSession, path) or (complete and df.where(F.col(complete).isNull()).limit(1).count()):
        return False
    in_order(df).write.parquet(path)
    return True


def pack(bars: DataFrame) -> DataFrame:
    """One row per ticker with its bars as an array in date order (a ticker's days are bounded)."""
    rows = F.array_sort(F.collect_list(F.struct("Date", *[c for c in bars.columns if c not in ("ticker", "Date")])))
    return bars.groupBy("ticker").agg(rows.alias("rows"))


def unpack(packed: DataFrame) -> DataFrame:
    """Back to one row per bar."""
    return packed.select("ticker", F.inline("rows"))


def complete_outputs(spark: SparkSession, folder: str, bars: DataFrame, ahead: int, group: str) -> list[str]:
    """Attach realised targets to raw results of a group, write those without a NULL, list the written."""
    from ..operators.windows import with_targets

    files = discover_outputs(spark, folder).where(F.col("group") == group).collect()  # names only
    done = {r.path.replace("__completed", "") for r in files if r.completed}
    todo = [r for r in files if not r.completed and r.path not in done]
    targets = with_targets(bars, ahead).select("ticker", F.col("Date").alias("date"), "target_ratio")
    targets = materialize(targets) if todo else targets  # every result looks them up
    out = []
    for r in todo:
        to = r.path.replace(".parquet", "__completed.parquet")
        if not exists(spark, to):
            got = materialize(spark.read.parquet(r.path).drop("target_ratio").join(targets, ["date", "ticker"], "left"))  # checked, sorted and written
            if write_result(got, to, "target_ratio"):
                out.append(to)
    return out
