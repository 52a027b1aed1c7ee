"""What the training-data operators share: tables, written intermediate results, Arrow passes."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run on this machine a temporary one is set in its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="lexloom-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. It cuts the lineage, and a lost executor loses none of it; forget() deletes it, else the JVM on exit."""
    spark = ship(df.sparkSession)
    path = f"{shared_dir(spark)}/lexloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, fs = _place(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


#: Rows of whole texts, or of their shingles, that a task reads from a file and hands to Python at a time. Spark's defaults, 4,096 and 10,000, suit narrow rows.
READ_ROWS, ARROW_ROWS = 512, 1000


def small_batches(spark: SparkSession) -> None:
    """From now on the session reads and hands on so many rows at most at a time; smaller settings stay. Plans are lazy, so it is not taken back.

    A batch of texts is a few arrays, doubled as they fill: of 4,096 rows tens of MB each, for which the executor's heap grows and outside of it Arrow's."""
    for key, most in (("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS), ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)):
        if not 0 < int(spark.conf.get(key)) <= most:
            spark.conf.set(key, most)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that no plan reads any more."""
    for df in tables:
        place, fs = _place(df.sparkSession, df.written_at)
        fs.delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod == rest


SPAN = 1 << 40


def bounded_sample(rows: DataFrame, kind: str, each: int, chars: str | None = None, most_chars: int = 0) -> tuple[DataFrame, dict]:
    """At most `each` of the rows of each kind, those first by the number in column place (under SPAN); and how many there are of each.

    A kind's numbers are cut into strips that hold about a 64th of `each` rows; strips are counted where the rows are, and the first
    that come to `each` rows together are taken whole, so no kind's rows meet in one task. With chars, strips are taken up to and with the one that
    makes most_chars. Where the rows of one place alone are more than `each`, none of them are taken, nor any after."""
    rows = written(rows)
    of_kind = rows.groupBy(kind).agg(F.count("*").alias("of_kind"))
    there = {r[0]: r[1] for r in of_kind.collect()}  # a row for each label value or language
    names = rows.columns
    grain = max(1, each // 64)
    strip = F.floor(F.col("place") * (F.col("of_kind") / F.lit(float(SPAN * grain))))
    # a row for each kind: Spark broadcasts it by its size
    kinds = of_kind.withColumnRenamed(kind, "_kind")
    near = rows.join(kinds, F.col(kind).eqNullSafe(F.col("_kind"))).withColumn("strip", strip).filter(F.col("strip") <= 2 * each // grain)
    counts = near.groupBy("_kind", "strip").agg(F.count("*").alias("n"), (F.sum(chars) if chars else F.lit(0)).alias("chars"))
    upto = Window.partitionBy("_kind").orderBy("strip")  # 128 strips at most
    counts = counts.withColumn("n", F.sum("n").over(upto)).withColumn("before", F.sum("chars").over(upto) - F.col("chars"))
    taken = counts.filter((F.col("n") <= each) & ((F.col("before") < most_chars) if chars else F.lit(True)))
    cuts = written(taken.groupBy(F.col("_kind").alias("_cut_kind")).agg(F.max("strip").alias("cut")))
    near = near.join(cuts, F.col("_kind").eqNullSafe(F.col("_cut_kind"))).filter(F.col("strip") <= F.col("cut"))
    return near.select(*names), there


def place(*parts: str) -> Column:
    """A number under SPAN from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(SPAN))


def crc_rest(doc_id: object, mod: int) -> int:
    """held_out's remainder, in Python."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def released(run):
    """run over batches, which gives back the memory that Arrow holds for the next ones when a task ends; workers live on."""

    def own(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return own


def per_row(df: DataFrame, inputs: list[str], keep: list[str], schema: str, make) -> DataFrame:
    """One pass over df's rows as Arrow batches. make(): called once a task, gives a function of the input values of one row that returns a tuple of the new values.

    keep: columns that pass unchanged and come first; schema: the new columns. Only inputs and keep are read."""
    ship(df.sparkSession)
    cols = list(dict.fromkeys([*keep, *inputs]))
    held = df.schema
    df = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)))  # mapInArrow can't take names with a dot
    inputs, own = [f"c{cols.index(c)}" for c in inputs], [f"c{cols.index(c)}" for c in keep]
    from pyspark.sql.types import StructField, StructType

    new = StructType.fromDDL(schema)
    out = StructType([*[StructField(a, held[c].dataType) for a, c in zip(own, keep, strict=True)], *new.fields])
    names = new.names

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        f, kinds = make(), [to_arrow_type(x.dataType) for x in new.fields]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = [f(*x) for x in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                made = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=[*own, *names])

    return df.mapInArrow(released(run), out).toDF(*keep, *names)


PIECE = 1 << 15  # shingles hashed at a time


def shingle_hashes(text: str | None, width: int, seed: int = 42):
    """XXH64 of each shingle of the text's words, joined by one space, in arrays; A-Z are lower-cased. Fewer words are one shingle, none are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both only touch ASCII
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        yield np.array([h(line[s:e], seed) for s, e in zip(starts[at : at + PIECE], ends[at : at + PIECE], strict=True)], np.uint64)
