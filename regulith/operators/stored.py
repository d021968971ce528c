"""Upserts into stored tables: counted, safe to run again, children replaced with their parents.

A store is a folder. Rows lie in buckets by a hash of their key; a merge reads
and writes only the buckets that the new rows fall into. Each merge writes a
version of its buckets, then a manifest that says which version of each bucket
holds; the manifest is complete or absent, so readers see a merge whole or not
at all, and what a failed merge left is never read. Rows that don't differ are
skipped; a merge in which nothing differs leaves the store as it is.

Defined cases: null keys are keys like any other; of several new rows with one
key the last by ``order`` counts (all columns break ties); an empty store reads
as no rows; merging no rows changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


@dataclass
class Store:
    """``schema`` is of the rows as users see them: the key's and the value's columns; ``version`` comes with each row."""

    spark: SparkSession
    folder: str
    schema: str
    keys: Sequence[str]
    buckets: int = BUCKETS

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))] if fs.exists(path) else []

    def version(self) -> int:
        """Number of the last whole merge, 0 if there is none."""
        return max((int(n) for n in self._files()), default=0)

    def manifest(self) -> dict[int, int]:
        """Version that holds of each bucket: at most ``buckets`` rows."""
        n = self.version()
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version int").parquet(f"{self.folder}/manifest/{n}").collect()} if n else {}

    def _bucket(self) -> Column:
        return F.pmod(F.hash(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in self.keys]), F.lit(self.buckets)).alias("_bucket")

    def _read(self, held: dict[int, int]) -> DataFrame:
        kind = f"{self.schema}, version long, _kind string"
        paths = [f"{self.folder}/data/{v}/_bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self) -> DataFrame:
        """The rows as the last whole merge left them."""
        return self._read(self.manifest()).filter("_kind <> 'removed'").drop("_kind")

    def _publish(self, number: int, held: dict[int, int]) -> None:
        rows = self.spark.createDataFrame(sorted(held.items()), "bucket int, version int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{number}")

    def _write(self, rows: DataFrame, touched: list[int], held: dict[int, int]) -> dict[str, int]:
        """Write merged rows (with ``_bucket, _kind``) as a version and publish the buckets in which something changed; rows by kind."""
        number = self.version() + 1
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/{number}")
        found = self.spark.read.schema(f"{self.schema}, version long, _kind string, _bucket int").parquet(f"{self.folder}/data/{number}").groupBy("_bucket", "_kind").count().collect()  # at most five kinds a bucket
        changed = {r["_bucket"] for r in found if r["_kind"] in ("inserted", "updated", "removed")}
        if changed:
            self._publish(number, held | {b: number for b in touched if b in changed})
        out = dict.fromkeys(("inserted", "updated", "skipped", "removed"), 0)
        for r in found:
            if r["_kind"] in out:
                out[r["_kind"]] += r["count"]
        return out

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most ``buckets`` rows

    def merge(self, new: DataFrame, order: Sequence[Column] = ()) -> dict[str, int]:
        """Upsert: ``inserted, updated, skipped`` counts; an updated row's ``version`` goes up by one, a new one's is 1."""
        values = [c for c in new.columns if c not in self.keys]
        ranked = F.max_by(F.struct(*[F.col(f"`{c}`") for c in new.columns]), F.struct(*order, F.xxhash64(*[F.col(f"`{c}`") for c in new.columns])))
        last = new.groupBy(*[F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(self.keys)]).agg(ranked.alias("r")).select("r.*")
        touched, held = self._touched(new), self.manifest()
        if not touched:
            return dict.fromkeys(("inserted", "updated", "skipped", "removed"), 0)
        old = self._read({b: v for b, v in held.items() if b in touched}).filter("_kind <> 'removed'").drop("_kind")
        o, n = old.withColumn("_o", F.lit(True)).alias("o"), last.withColumn("_n", F.lit(True)).alias("n")
        on = F.lit(True)
        for k in self.keys:
            on = on & F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`"))
        same = F.lit(True)
        for v in values:
            same = same & F.col(f"o.`{v}`").eqNullSafe(F.col(f"n.`{v}`"))
        kind = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "kept").when(same, "skipped").otherwise("updated")
        joined = o.join(n, on, "full").withColumn("_kind", kind)
        pick = lambda c: F.when(F.col("_n").isNull(), F.col(f"o.`{c}`")).otherwise(F.col(f"n.`{c}`")).alias(c)
        version = F.coalesce(F.col("o.version"), F.lit(0).cast("long")) + F.when(F.col("_kind").isin("inserted", "updated"), 1).otherwise(0)
        rows = joined.select(*[pick(c) for c in [*self.keys, *values]], version.alias("version"), "_kind")
        return self._write(rows.select("*", self._bucket()), touched, held)

    def replace_children(self, parents: DataFrame, children: DataFrame) -> dict[str, int]:
        """For a store keyed by the parent alone (several rows a key): the children of ``parents`` go and the new ones stand in their place."""
        touched, held = self._touched(parents.select(*self.keys).unionByName(children.select(*self.keys))), self.manifest()
        if not touched:
            return dict.fromkeys(("inserted", "updated", "skipped", "removed"), 0)
        old = self._read({b: v for b, v in held.items() if b in touched}).filter("_kind <> 'removed'").drop("_kind")
        columns = [c for c in old.columns if c != "version"]
        gone = parents.select(*self.keys).distinct().alias("p")
        on = F.lit(True)
        for k in self.keys:
            on = on & F.col(f"o.`{k}`").eqNullSafe(F.col(f"p.`{k}`"))
        # how often each child stands there before and after: what is on both sides is skipped
        before = old.alias("o").join(gone, on, "left_semi").select(*columns).withColumn("_side", F.lit(1))
        after = children.select(*columns).withColumn("_side", F.lit(0))
        both = before.unionByName(after).groupBy(*columns).agg(F.sum("_side").alias("was"), F.sum(1 - F.col("_side")).alias("now"))
        parts = F.concat(F.array_repeat(F.lit("skipped"), F.least("was", "now").cast("int")), F.array_repeat(F.lit("inserted"), F.greatest(F.col("now") - F.col("was"), F.lit(0)).cast("int")), F.array_repeat(F.lit("removed"), F.greatest(F.col("was") - F.col("now"), F.lit(0)).cast("int")))
        fresh = both.select(*columns, F.lit(1).cast("long").alias("version"), F.explode(parts).alias("_kind"))
        kept = old.alias("o").join(gone, on, "left_anti").select(*columns, "version", F.lit("kept").alias("_kind"))
        return self._write(kept.unionByName(fresh).select("*", self._bucket()), touched, held)
