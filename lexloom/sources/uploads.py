"""The folder of uploads: what lies in it, and its texts."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.pdf import read as read_pdf

#: Extensions that are read, and how deep folders are followed.
SUPPORTED = ["txt", "md", "pdf"]
DEPTH = 10
COLUMNS = "path string, modificationTime timestamp, length long, content binary"


def local(path: str) -> str | None:
    """The path on this machine's disk, if it is one."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return "/" + rest.lstrip("/") if scheme == "file" else None


def real(path: str) -> str:
    """Links and dots resolved where the driver can see them, dots alone elsewhere."""
    import posixpath

    own = local(path)
    return os.path.realpath(own) if own else posixpath.normpath(path)


def inside(path: str, folder: str) -> bool:
    """Whether a path lies in the folder, links and dots resolved."""
    a, b = real(path), real(folder)
    return a == b or a.startswith(b.rstrip("/") + "/")


def paths(spark: SparkSession, folder: str, depth: int = DEPTH) -> list[str]:
    """The folder's files down to a depth. Links are followed; a folder that was seen under another name is not read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo, seen, out = deque([(place(folder), 0)]), set(), []
    while todo:
        at, level = todo.popleft()
        if level > depth or (own := real(at.toUri().getPath() if local(at.toString()) else at.toString())) in seen:
            continue
        seen.add(own)
        for s in sorted(fs.listStatus(at), key=lambda s: s.getPath().getName()):
            if s.isDirectory():
                todo.append((s.getPath(), level + 1))
            else:
                out.append(s.getPath().toString())
    return out


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One file, with the folders above it, in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def files(spark: SparkSession, found: list[str]) -> DataFrame:
    """Rows of binaryFile with title and extension; no file's bytes are read unless content is asked for."""
    rows = spark.read.format("binaryFile").load(found) if found else spark.createDataFrame([], COLUMNS)
    title = F.element_at(F.split("path", "/"), -1)
    extension = F.when(title.contains("."), F.lower(F.element_at(F.split(title, "\\."), -1))).otherwise("")
    return rows.withColumns({"title": title, "extension": extension})


def listed(spark: SparkSession, folder: str, depth: int = DEPTH) -> DataFrame:
    """name, path, size, modified, extension, supported; by name."""
    rows = files(spark, paths(spark, folder, depth))
    return rows.select(F.col("title").alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "extension", F.col("extension").isin(SUPPORTED).alias("supported")).orderBy("name", "path")


def texts(rows: DataFrame, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """title, extension, path, content, error of files. pdf: reads a PDF's pages to text, by default functions/pdf.py."""
    pdf = pdf or read_pdf

    @F.pandas_udf("content string, error string")
    def read_all(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for d, k in zip(data, kind, strict=True):
            try:
                if k not in SUPPORTED:
                    raise ValueError(f"no reader for .{k}")
                t = pdf(bytes(d)) if k == "pdf" else bytes(d).decode("utf-8", "replace")
                if not t.strip():
                    raise ValueError("no text")
                out.append((t, None))
            except Exception as e:  # one bad file must not stop the others
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["content", "error"])

    return rows.withColumn("t", read_all("content", "extension")).select("title", "extension", "path", "t.content", "t.error")


def read(spark: SparkSession, folder: str, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """The supported files of the folder."""
    return texts(files(spark, paths(spark, folder)).filter(F.col("extension").isin(SUPPORTED)), pdf)


def read_one(spark: SparkSession, folder: str, path: str, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """One file, by a path within the folder or from its top; a path that leads out of the folder is an error."""
    at = path if path.startswith("/") or ":" in path.split("/")[0] else f"{folder.rstrip('/')}/{path}"
    if not inside(at, folder):
        raise ValueError(f"not in the folder of uploads: {path}")
    return texts(files(spark, [at]), pdf)
