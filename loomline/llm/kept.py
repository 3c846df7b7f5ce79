"""Tables that operators keep between batches, and union-find over kept representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomline.operators.components import components
from loomline.runtime import cut

#: Bytes of a table from which it is worth a job to find out which of its slots a batch touches.
PRUNED_FROM = 64_000_000


class Kept:
    """Append-only Parquet tables in one folder, which any later session can open again.

    Each batch adds one part to a table, laid out in ``slots`` folders by the
    hash of the table's key, and counts from the moment its number is
    committed; what a lost batch has left is overwritten by the next one.
    ``probe`` reads only the slots that its keys fall into.
    """

    def __init__(self, spark: SparkSession, folder: str, slots: int = 8):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        known = self._names("_slots")
        self.slots = int(known[0]) if known else slots
        if not known:
            self._fs.mkdirs(self._path(f"{self.folder}/_slots/{slots}"))
        self.done = sorted(map(int, self._names("_done")))
        self.now = self.done[-1] + 1 if self.done else 0
        self.schemas: dict[str, str] = {}

    def _names(self, part: str) -> list[str]:
        at = self._path(f"{self.folder}/{part}")
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _slot(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slots)).cast("int")

    def append(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """Write this batch's part of a table; returns it as read back."""
        at = f"{self.folder}/{name}/batch={self.now}"
        rows.withColumn("slot", self._slot(key)).repartition(self.slots, "slot").write.mode("overwrite").partitionBy("slot").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at).select(*rows.columns)

    def probe(self, name: str, keys: DataFrame, key: str) -> DataFrame | None:
        """The rows that earlier batches keep under ``keys`` (a column of the name ``key``); None if there are none at all."""
        parts = [f"{self.folder}/{name}/batch={b}" for b in self.done if self._fs.exists(self._path(f"{self.folder}/{name}/batch={b}"))]
        if not parts:
            return None
        table = self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*parts) if self._filled(parts) else None
        if table is None:
            return None
        keys = keys.select(key).where(F.col(key).isNotNull()).distinct()
        if sum(self._fs.getContentSummary(self._path(p)).getLength() for p in parts) > PRUNED_FROM:
            touched = [r[0] for r in keys.select(self._slot(key)).distinct().collect()]  # at most ``slots`` numbers
            if len(touched) < self.slots:
                table = table.where(F.col("slot").isin(touched)) if touched else table.where(F.lit(False))
        return table.drop("slot", "batch").join(keys, key, "left_semi")

    def _filled(self, parts: list[str]) -> bool:
        return any(x.getPath().getName().startswith("slot=") for p in parts for x in self._fs.listStatus(self._path(p)))

    def commit(self) -> None:
        """From here on this batch counts."""
        self._fs.mkdirs(self._path(f"{self.folder}/_done/{self.now}"))
        self.done.append(self.now)
        self.now += 1

    def compact(self, name: str, key: str) -> None:
        """Make one part of all committed parts of a table; run between batches, now and then."""
        parts = [b for b in self.done if self._fs.exists(self._path(f"{self.folder}/{name}/batch={b}"))]
        if len(parts) < 2 or not self._filled([f"{self.folder}/{name}/batch={b}" for b in parts]):
            return
        whole = self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/batch={b}" for b in parts]).drop("batch", "slot")
        at = f"{self.folder}/{name}/_compacted"
        whole.withColumn("slot", self._slot(key)).repartition(self.slots, "slot").write.mode("overwrite").partitionBy("slot").parquet(at)
        first, *others = parts
        for b in [first, *others]:
            self._fs.delete(self._path(f"{self.folder}/{name}/batch={b}"), True)
        self._fs.rename(self._path(at), self._path(f"{self.folder}/{name}/batch={first}"))


def with_kept(kept: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if kept is None else kept.select(*new.columns).unionByName(new)


def current(ids: DataFrame, column: str, *mappings: DataFrame | None) -> DataFrame:
    """``ids`` with the representative ``rep`` of ``column``: the smallest that any mapping (node, rep) has, or itself."""
    known = [m.select("node", "rep") for m in mappings if m is not None]
    if not known:
        return ids.withColumn("rep", F.col(column))
    every = known[0]
    for m in known[1:]:
        every = every.unionAll(m)
    least = every.groupBy(F.col("node").alias(column)).agg(F.min("rep").alias("rep"))
    return ids.join(least, column, "left").withColumn("rep", F.coalesce("rep", column))


def unite(links: DataFrame, kept: Kept | None, table: str, *since: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unite what ``links`` (a, b) join: the representatives that changed (old, rep), and new rows (node, rep) of the mapping.

    The representative of a set is its smallest node, so it only ever gets
    smaller and the least of a node's rows is the valid one.  Only the sets
    that a link touches are read and written.  ``since`` are rows of the
    mapping that this batch has added already.
    """
    links = cut(links.select("a", "b").where("a != b").distinct())
    ends = links.select(F.col("a").alias("node")).unionAll(links.select("b")).distinct()
    held = None if kept is None else kept.probe(table, ends, "node")
    if held is not None or since:
        reps = cut(current(ends, "node", held, *since))
        links = links.join(reps.select(F.col("node").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("node").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    changed = cut(components(links).where("node != rep").select(F.col("node").alias("old"), "rep"))
    moved = changed.select(F.col("old").alias("node"), "rep")
    olds = changed.select(F.col("old").alias("rep"), F.col("rep").alias("now"))
    members = None if kept is None else kept.probe(f"{table}_of", olds, "rep")
    for m in (members, *since):
        if m is not None:
            moved = moved.unionAll(m.join(olds, "rep").select("node", F.col("now").alias("rep")))
    return changed, cut(moved.distinct())
