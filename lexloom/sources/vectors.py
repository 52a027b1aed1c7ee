"""A table of chunks on its own, without documents: rows by id, the last one written counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.filters import parsed
from lexloom.operators.ranks import kept
from lexloom.operators.vector import cosine, literal

#: The parameters of the index over such a table.
CELLS, SUB_VECTORS = 256, 16
SCHEMA = "id string, document_id string, content string, embedding array<float>, metadata map<string,string>"


class Chunks:
    """Held in a plan, which is written to the shared folder after every few changes, so that it doesn't grow with them."""

    EVERY = 8

    def __init__(self, spark: SparkSession):
        self.spark, self.changes = spark, 0
        self.rows = spark.createDataFrame([], SCHEMA)

    def _keep(self, rows: DataFrame) -> None:
        self.changes += 1
        self.rows = rows if self.changes % self.EVERY else kept(rows)

    @staticmethod
    def _given(chunks: DataFrame) -> DataFrame:
        return chunks.select("id", "document_id", "content", F.col("embedding").cast("array<float>").alias("embedding"), "metadata").dropDuplicates(["id"])

    def add(self, chunks: DataFrame) -> None:
        """Rows of SCHEMA; of rows with the same id in chunks one is taken, and it takes the place of a stored one."""
        new = self._given(chunks)
        self._keep(self.rows.join(new.select("id"), "id", "left_anti").unionByName(new))

    def remove_document(self, document_id: str) -> None:
        self._keep(self.rows.filter(~F.col("document_id").eqNullSafe(F.lit(document_id))))

    def get(self, chunk_id: str) -> DataFrame:
        return self.rows.filter(F.col("id") == F.lit(chunk_id)).limit(1)

    def search(self, vector, limit: int = 10, filter: str | None = None) -> DataFrame:
        """By plain cosine, then id; filter: conditions key = 'value' on metadata first, then on columns."""
        names = ("id", "document_id", "content")
        meta = self.rows.select("*", *(F.coalesce(F.col("metadata")[c], F.col(c)).alias(f"m_{c}") for c in names))
        keep = parsed(filter or "", [], "metadata") if not any(c in (filter or "") for c in names) else self._either(filter)
        rows = meta.filter(keep).drop(*(f"m_{c}" for c in names))
        return rows.withColumn("score", cosine(F.col("embedding"), literal(vector))).drop("embedding").orderBy(F.desc("score"), "id").limit(limit)

    def _either(self, filter: str):
        import re

        names = {"id", "document_id", "content"}
        text = re.sub(r"(\w+)(\s*=)", lambda m: f"m_{m[1]}{m[2]}" if m[1] in names else m[0], filter)
        return parsed(text, [f"m_{c}" for c in names], "metadata")


class StoredChunks(Chunks):
    """Held in a folder that is made with the first chunk. Each change is a sub-folder of its own: the rows that were added, or the document that went.

    Reading takes the newest row of each id, less those whose document went after they were written; compact() makes one folder of all."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark)
        self.path = path.rstrip("/")
        self.place = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._read()

    def _names(self) -> list[str]:
        """Sub-folders that are written whole, which Spark marks, in their order."""
        if not self.fs.exists(self.place(self.path)):
            return []
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self.place(self.path)))
        return [n for n in names if self.fs.exists(self.place(f"{self.path}/{n}/_SUCCESS"))]

    def _write(self, rows: DataFrame, kind: str) -> None:
        number = max((int(n.split("-")[0]) for n in self._names()), default=0) + 1
        rows.write.parquet(f"{self.path}/{number:012d}-{kind}-{uuid.uuid4().hex}")
        self._read()

    def _read(self) -> None:
        names = self._names()
        paths = lambda gone: [f"{self.path}/{n}" for n in names if ("-gone-" in n) == gone]
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{12})-[^/]+/[^/]+$", 1).cast("long")
        if not paths(False):
            self.rows = self.spark.createDataFrame([], SCHEMA)
            return
        rows = self.spark.read.schema(SCHEMA).parquet(*paths(False))
        if len(names) > 1:
            held = rows.select(F.struct(*rows.columns).alias("r"), at.alias("at")).groupBy("r.id").agg(F.max_by("r", "at").alias("r"), F.max("at").alias("at"))
            if paths(True):
                gone = self.spark.read.schema("gone string").parquet(*paths(True)).select("gone", at.alias("later")).groupBy("gone").agg(F.max("later").alias("later"))
                held = held.join(gone, F.col("r.document_id").eqNullSafe(F.col("gone")) & (F.col("at") < F.col("later")), "left_anti")
            rows = held.select("r.*")
        self.rows = rows

    def add(self, chunks: DataFrame) -> None:
        """Writes these rows alone."""
        self._write(self._given(chunks), "rows")

    def remove_document(self, document_id: str) -> None:
        """Writes the document's id."""
        self._write(self.spark.createDataFrame([(document_id,)], "gone string"), "gone")

    def compact(self) -> None:
        """All changes as one folder; what it replaces is deleted. No reader may be on the older ones."""
        old = self._names()
        self._write(self.rows, "rows")
        for n in old:
            self.fs.delete(self.place(f"{self.path}/{n}"), True)
        self._read()


def legacy_score(distance):
    """1 less the distance."""
    return 1 - distance
