"""A cache by key: a log of Parquet parts in buckets of the key's hash, of which the last record of a key counts.

An append writes a part and then a manifest that names it; a reader takes the
manifest with the highest number, so it sees a part whole or not at all.  A
manifest is put in place by a rename that fails if its number is taken; then the
append tries the next number.  Compaction writes one part that holds the last
record of each key and a manifest that names it in place of the parts it has
read, so a crash before that changes nothing, and parts that came meanwhile
stay.  A read touches only the buckets that its keys fall in.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedCache:
    """schema: DDL of the records without what the cache adds; key: the column they are found by."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema)
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests

    def _manifests(self) -> list[int]:
        folder = self._paths(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def parts(self) -> tuple[int, list[dict]]:
        """The number of the newest manifest, and its parts: name and the place they have in the order of appends."""
        numbers = self._manifests()
        if not numbers:
            return 0, []
        rows = self.spark.read.text(f"{self.path}/manifests/{numbers[-1]}.json", wholetext=True).collect()
        return numbers[-1], json.loads(rows[0][0])["parts"]

    def _publish(self, change) -> None:
        """Puts the next manifest in place; change: from the parts that are to those that shall be."""
        while True:
            number, parts = self.parts()
            temp = self._paths(f"{self.path}/manifests/_{uuid.uuid4().hex}")
            out = self._fs.create(temp)
            out.write(bytearray(json.dumps({"parts": change(parts), "buckets": self.buckets}).encode()))
            out.close()
            target = self._paths(f"{self.path}/manifests/{number + 1}.json")
            if not self._fs.exists(target) and self._fs.rename(temp, target):
                return
            self._fs.delete(temp, False)

    # ---- records

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/parts/part={name}")
        return name

    def append(self, df: DataFrame) -> None:
        """Adds records; of several with one key in one append the greatest counts. Null keys are left out."""
        rows = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).where(F.col(self.key).isNotNull())
        name = self._write(self._last(rows.withColumn("__order", F.lit(0).cast("long"))).drop("__order"))
        self._publish(lambda parts: [*parts, {"name": name, "order": max((p["order"] for p in parts), default=0) + 1}])

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [f.name for f in self.schema if f.name != self.key]
        best = rows.groupBy(self.key).agg(F.max(F.struct("__order", *rest)).alias("__x"))
        return best.select(*(F.col(self.key) if f.name == self.key else F.col("__x")[f.name].alias(f.name) for f in self.schema), F.col("__x")["__order"].alias("__order"))

    def _rows(self, parts: list[dict], buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType([*self.schema, T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*self.schema, T.StructField("bucket", T.IntegerType()), T.StructField("__order", T.LongType())]))
        # One scan over all parts.
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/parts").parquet(*(f"{self.path}/parts/part={p['name']}" for p in parts))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        order = F.create_map(*(x for p in parts for x in (F.lit(p["name"]), F.lit(p["order"]).cast("long"))))
        return rows.select(*self.schema.names, "bucket", order[F.col("part")].alias("__order"))

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The last record of each key, or of the keys in a column of that name; only their buckets are read."""
        _, parts = self.parts()
        if keys is None:
            return self._last(self._rows(parts).drop("bucket")).drop("__order")
        asked = keys.select(F.col(self.key).alias("__asked")).distinct()
        wanted = sorted(r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self._bucket().alias("b")).distinct().collect())  # at most `buckets`
        rows = self._rows(parts, wanted).drop("bucket").join(asked, F.col(self.key) == F.col("__asked"), "left_semi")
        return self._last(rows).drop("__order")

    def compact(self) -> None:
        """One part in place of those there are; the parts themselves stay until `clean`, for readers that have begun."""
        _, parts = self.parts()
        if len(parts) < 2:
            return
        name, taken = self._write(self._last(self._rows(parts).drop("bucket")).drop("__order")), {p["name"] for p in parts}
        newest = max(p["order"] for p in parts)
        self._publish(lambda now: [{"name": name, "order": newest}, *(p for p in now if p["name"] not in taken)])

    def clean(self) -> int:
        """Deletes parts that the newest manifest does not name, and all older manifests; returns how many parts. No append may be under way."""
        number, parts = self.parts()
        named, n = {p["name"] for p in parts}, 0
        folder = self._paths(f"{self.path}/parts")
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if status.getPath().getName().removeprefix("part=") not in named:
                n += bool(self._fs.delete(status.getPath(), True))
        for k in self._manifests():
            if k < number:
                self._fs.delete(self._paths(f"{self.path}/manifests/{k}.json"), False)
        return n
