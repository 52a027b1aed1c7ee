"""A vector index as a stored table that grows: cells by k-means, each with product codes or a navigable graph, read with partition pruning.

`fit` learns centroids (and, for product codes, codebooks) on a bounded sample and writes every row under its cell; `append` assigns new rows by the
stored centroids and writes these alone, as a segment of its own; a search names the cells it probes, so that Spark reads their folders
only. Codes decide which rows are scored exactly. `drift` compares how far appended rows lie from their centroids with the rows of the fit, and asks for a
new fit. Versions, lock and publication are the store's.

A cell with more than `cell_rows` rows has several parts, each a graph (or block of codes) of its own that a probe of the cell searches too, so a task
holds a bounded part whatever the skew. Rows with the same vector are one node of a graph, with all their ids.

Defined results: rows without a vector, or of another length than the fit's, are in no index; a query of another length, or none, finds nothing; ties
end in the id; an empty table makes an index that finds nothing, and takes the first appended rows in by a new fit.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.operators import ann, vector
from lexloom.session import ship
from lexloom.sources.store import Store, retried

MODEL = "kind string, no int, values array<float>"
MOST_BROADCAST = 1 << 20  # rows of a query's and a row's id


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, id_col: str = "id", embedding: str = "embedding"):
        self.spark, self.store, self.id_col, self.embedding = ship(spark), Store(spark, path), id_col, embedding
        self._model: tuple[int, dict] | None = None

    # --- versions ---
    def exists(self) -> bool:
        return self.store.version > 0

    def _segment(self, name: str, df: DataFrame) -> str:
        """df in a new folder, a folder in it for each cell."""
        folder = f"data/{name}/segment=s{uuid.uuid4().hex}"
        df.write.partitionBy("cell").parquet(f"{self.store.path}/{folder}")
        return folder

    def vacuum(self) -> int:
        """Deletes older versions and the segments that only they name; how many went. No reader may be on an older version."""
        with self.store.held():
            *old, last = self.store.versions()
            named = {f for folders in self.store.manifest(last).values() for f in folders}
            gone = {f for v in old for folders in self.store.manifest(v).values() for f in folders} - named
            for v in old:
                self.store.fs.delete(self.store._p("manifests", f"{v}.json"), False)
            for f in gone:
                self.store.fs.delete(self.store._p(f), True)
            return len(gone)

    def model(self) -> dict:
        """kind, centroids, probes, cell_rows, and codebooks of an index with product codes."""
        version = self.store.version
        if self._model is None or self._model[0] != version:
            rows = self.spark.read.schema(MODEL).parquet(*self.store._paths("model", version)).collect()  # centroids and codebooks: bounded by parameters
            own = {"codebooks": None}
            numbers = {r["kind"]: r["values"] for r in rows if r["no"] < 0}
            kind, cell_rows, probes, dimension, off, *more = numbers["settings"]
            keep, fitted = more or (0.0, 1.0)
            own |= {"recall": 0.975, "keep": int(keep), "fitted": int(fitted), "kind": "graph" if kind else "codes", "cell_rows": int(cell_rows), "probes": int(probes), "off": off}
            stacked = lambda k: np.array([r["values"] for r in sorted((r for r in rows if r["kind"] == k and r["no"] >= 0), key=lambda r: r["no"])], float)
            own["centroids"] = stacked("centroid").reshape(-1, int(dimension) or 1)
            if "cuts" in numbers:
                cuts = np.array(numbers["cuts"]).astype(int)
                own["codebooks"] = ann.Codebooks([stacked(f"part {i}").reshape(-1, cuts[i + 1] - cuts[i]) for i in range(len(cuts) - 1)], cuts)
            self._model = version, own
        return self._model[1]

    # --- writing ---
    def fit(self, chunks: DataFrame, kind: str = "graph", cells: int | None = None, parts: int | None = None, cell_rows: int = 1 << 14, sample: int = 50_000, recall: float = 0.95, degree: int = 8) -> int:
        """A new version over all rows of chunks (id, vector). kind: graph or codes. cells: by default one for each cell_rows rows of a graph, and the square root of the rows for codes;
        parts: bytes of a row's product code, by default one for four numbers. probes and, for codes, how many rows are scored exactly are measured on the sample, each for half of what that share of the true neighbours may miss; a graph's beam is measured in each part."""
        rows = chunks.filter(F.size(self.embedding) > 0)
        n = rows.count()
        x = vector.ivf_sample(rows, self.embedding, sample)
        d = x.shape[1] if len(x) else 0
        cells = cells or (max(1, math.ceil(n / cell_rows)) if kind == "graph" else vector.ivf_parameters(n, d)[0])
        centroids = vector.ivf_centroids(x, cells)
        each = (1 + recall) / 2
        probes = vector.ivf_needed(x, centroids, 10, each)
        books = ann.codebooks(x, parts or max(1, d // 4)) if kind == "codes" and len(x) else None
        keep = math.ceil(books.needed(x, 10, each) * max(1.0, n / len(x))) if books else 0
        off = float((1 - (x @ centroids.T).max(axis=1)).mean()) if len(x) else 0.0
        own = {"kind": kind, "centroids": centroids, "codebooks": books, "cell_rows": cell_rows, "probes": probes, "off": off, "degree": degree, "recall": each}
        model = [("settings", -1, [float(kind == "graph"), float(cell_rows), float(probes), float(d), off, float(keep), float(n)])] + [("centroid", i, c.tolist()) for i, c in enumerate(centroids)]
        if books:
            model += [("cuts", -1, books.cuts.astype(float).tolist())] + [(f"part {i}", j, c.tolist()) for i, p in enumerate(books.centres) for j, c in enumerate(p)]

        def once():
            with self.store.held():
                before = self.store.version
                folder = f"data/model-{uuid.uuid4().hex}"
                self.spark.createDataFrame(model, MODEL).coalesce(1).write.parquet(f"{self.store.path}/{folder}")
                return self.store._publish({"model": [folder], "rows": [self._segment("rows", self._made(rows, own))] if n else []}, before + 1)

        return retried(once)

    def append(self, chunks: DataFrame) -> int:
        """New rows under the stored centroids, in a folder of their own; what is there isn't read or written. An index fitted on nothing is fitted on them."""
        own = self.model()
        if not len(own["centroids"]):
            return self.fit(chunks, own["kind"], cell_rows=own["cell_rows"])

        def once():
            with self.store.held():
                before = self.store.version
                folders = self.store.manifest(before)
                made = self._segment("rows", self._made(chunks.filter(F.size(self.embedding) > 0), own))
                return self.store._publish(folders | {"rows": [*folders["rows"], made]}, before + 1)

        return retried(once)

    def _made(self, rows: DataFrame, own: dict) -> DataFrame:
        """The rows of a segment: cell, part, pos, ids, off (1 - cosine to the centroid), codes, links and beam (of a graph: the beams that its part needs for ten neighbours of a query that is in it, and of another), vector."""
        cell = vector.ivf_assign(rows.select(F.col(self.id_col).alias("id"), F.col(self.embedding).cast("array<float>").alias("v")), own["centroids"], "v")
        sizes = cell.groupBy("cell").agg(F.ceil(F.count("*") / own["cell_rows"]).alias("of"))  # a row a cell: Spark broadcasts it by its size
        cell = cell.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("of")).cast("int")).drop("of")
        kind = rows.schema[self.id_col].dataType.simpleString()
        schema = f"cell int, part int, pos int, ids array<{kind}>, off float, codes binary, links array<int>, beam array<int>, v array<float>"
        return cell.groupBy("cell", "part").applyInArrow(_node_maker(own), schema)

    # --- reading ---
    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """All segments' rows with their segment; of these cells only, which Spark finds by the folders' names."""
        paths = self.store._paths("rows")
        if not paths:
            return self.spark.createDataFrame([], "part int, pos int, ids array<string>, off float, codes binary, links array<int>, beam array<int>, v array<float>, cell int, segment string")
        out = self.spark.read.option("basePath", f"{self.store.path}/data/rows").parquet(*paths)
        return out if cells is None else out.filter(F.col("cell").isin([int(c) for c in cells]))

    def drift(self) -> float:
        """How far rows lie from their centroids now, over how far they lay in the fit: 1 where nothing changed."""
        was = self.model()["off"]
        now = self.rows().select(F.size("ids").alias("n"), "off").agg(F.sum(F.col("off") * F.col("n")) / F.sum("n")).first()[0]
        return 1.0 if now is None or was < 1e-9 else now / was

    def needs_fit(self, most: float = 1.1) -> bool:
        return self.drift() > most

    def bytes_a_row(self) -> float:
        """Of codes and links, without the vector."""
        got = self.rows().agg(F.sum(F.octet_length("codes") + 4 * F.coalesce(F.size("links"), F.lit(0))) / F.sum(F.size("ids"))).first()[0]
        return float(got or 0)

    def probed(self, vectors: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The nearest cells of each unit row."""
        own = self.model()
        return np.argsort(-(vectors @ own["centroids"].T), axis=1, kind="stable")[:, : probes or own["probes"]]

    def topk(self, query, k: int, probes: int | None = None, beam: int | None = None) -> DataFrame:
        """id, score, nth of one query."""
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "query int, v array<float>")
        return self.search(asked, k, probes, beam, "query", "v").drop("query")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, beam: int | None = None, query_id: str = "id", embedding: str = "embedding", block: int = 1 << 12) -> DataFrame:
        """query, id, score ((1 + cosine) / 2, exact), nth, scored: the k best ids of each query among the rows that the index came upon, and how many rows' codes it scored for that.

        beam: rows that a query keeps while it goes through a part; by default what the part's graph needs, or for codes what the fit measured, in step with the rows since. Of a graph's the 3 * k best by their codes are scored exactly."""
        own = self.model()
        centroids, graph = own["centroids"], own["kind"] == "graph"
        kind = queries.schema[query_id].dataType.simpleString()
        empty = self.spark.createDataFrame([], f"query {kind}, id string, score double, nth int, scored long")
        if not len(centroids) or not self.store.manifest()["rows"]:
            return empty
        few_rows = max(3 * k, 20) if graph else max(8 * k, 50)
        if not graph and not beam:
            now = self.rows().agg(F.sum(F.size("ids"))).first()[0] or 0
            few_rows = max(few_rows, math.ceil(own["keep"] * max(1.0, k / 10) * max(1.0, now / max(1, own["fitted"]))))
        taken = max(beam or 0, few_rows) if graph else beam or few_rows
        asked = queries.filter(F.size(embedding) == centroids.shape[1]).select(F.col(query_id).alias("query"), F.col(embedding).cast("array<float>").alias("q"))
        few = probes or own["probes"]

        @F.pandas_udf("array<int>")
        def cells_of(v):
            return vector.nearest_cells(v, centroids, few)

        asked = asked.withColumn("cell", F.explode(cells_of("q")))
        wanted = sorted(r[0] for r in asked.select("cell").distinct().collect())  # at most as many as there are cells
        parts = self.rows(wanted).select("cell", "segment", "part").distinct()
        own_block = F.pmod(F.xxhash64("query"), F.col("blocks"))
        blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
        asked = asked.join(blocks, "cell").withColumn("block", own_block).drop("blocks").join(parts, "cell")
        nodes = self.rows(wanted).select("cell", "segment", "part", "pos", F.slice("ids", 1, k).alias("ids"), "codes", *(["links", "beam"] if graph else []))
        nodes = nodes.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
        keys = ["cell", "segment", "part", "block"]
        asked, nodes = (df.toDF(*df.columns) for df in (asked, nodes))
        found = asked.groupBy(*keys).cogroup(nodes.groupBy(*keys)).applyInArrow(_finder(own, k, beam, taken), f"query {kind}, cell int, segment string, part int, pos int, rough float, scored long")
        order = Window.partitionBy("query")
        best = found.withColumn("place", F.row_number().over(order.orderBy(F.desc("rough"), "cell", "segment", "part", "pos")))
        best = best.withColumn("scored", F.sum(F.when(F.col("pos") < 0, F.col("scored")).otherwise(0)).over(order)).filter((F.col("place") <= taken) & (F.col("pos") >= 0))
        vectors = self.rows(wanted).select("cell", "segment", "part", "pos", F.slice("ids", 1, k).alias("ids"), "v")
        exact = best.join(vectors, ["cell", "segment", "part", "pos"]).join(queries.select(F.col(query_id).alias("query"), F.col(embedding).cast("array<float>").alias("q")), "query")
        exact = exact.withColumn("score", _cosines("v", "q")).select("query", F.explode("ids").alias("id"), "score", "scored")
        return exact.withColumn("nth", F.row_number().over(order.orderBy(F.desc("score"), "id"))).filter(F.col("nth") <= k)

    def stored(self, ids: DataFrame) -> DataFrame:
        """The ids (id) that are in the index."""
        return self.rows().select(F.explode("ids").alias("id")).join(ids.select("id"), "id", "left_semi").distinct()


def _cosines(a: str, b: str):
    """(1 + cosine) / 2 of two columns of vectors, rounded so that equal vectors tie."""

    @F.pandas_udf("double")
    def run(v, q):
        import pandas as pd

        if not len(v):
            return pd.Series([], dtype=float)
        x, y = (vector.unit(np.stack(c.to_numpy()).astype(float)) for c in (v, q))
        return pd.Series(np.round((1 + (x * y).sum(axis=1)) / 2, 12))

    return run(F.col(a), F.col(b))


def _node_maker(own: dict):
    centroids, books, graph, degree = own["centroids"], own["codebooks"], own["kind"] == "graph", own.get("degree", 8)

    def run(key, table):
        m = vector.unit(vector.matrix(table.column("v"))).astype(np.float32)
        ids = table.column("id").combine_chunks()
        order = ids.argsort() if hasattr(ids, "argsort") else pa.compute.sort_indices(ids)
        m, ids = m[order.to_numpy()], ids.take(order)
        codes = ann.coded(m)
        _, first, which = np.unique(np.ascontiguousarray(m).view(np.dtype((np.void, m.dtype.itemsize * m.shape[1]))).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(which.ravel(), kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(which.ravel(), minlength=len(first)))]).astype(np.int32)
        m, codes, n = m[first], codes[first], len(first)
        data = codes if graph else books.encode(m)
        width = data.shape[1]
        binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
        if graph:
            to = ann.links(ann.decoded(codes), degree)
            kept = [x[x >= 0].astype(np.int32) for x in to]
            near = ann.decoded(codes)
            beam = pa.array([[ann.beam_needed(near, to, recall=own["recall"], held=h) for h in (True, False)]] * n, pa.list_(pa.int32()))
            link = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)), pa.array(np.concatenate([*kept, np.zeros(0, np.int32)])))
        else:
            link, beam = pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int32()))
        off = (1 - (m @ centroids[key[0].as_py()].astype(np.float32))).astype(np.float32)
        same = lambda x: pa.array(np.full(n, x.as_py(), np.int32))
        v = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * m.shape[1]).astype(np.int32)), pa.array(m.ravel()))
        return pa.table({"cell": same(key[0]), "part": same(key[1]), "pos": pa.array(np.arange(n, dtype=np.int32)), "ids": pa.ListArray.from_arrays(pa.array(offsets), ids.take(pa.array(by))), "off": pa.array(off), "codes": binary, "links": link, "beam": beam, "v": v})

    return run


def _finder(own: dict, k: int, beam: int | None, taken: int, step: int = 128):
    """The best rows of a part for each query of a block, `taken` at most, and a row with pos -1 that says how many were scored."""
    books, graph = own["codebooks"], own["kind"] == "graph"

    def run(key, asked, nodes):
        cell, segment, part, _ = (x.as_py() for x in key)
        n = nodes.num_rows
        found = [], [], [], []
        if n and asked.num_rows:
            nodes = nodes.sort_by("pos")
            q = vector.unit(vector.matrix(asked.column("q"))).astype(np.float32)
            data = np.frombuffer(b"".join(nodes.column("codes").to_pylist()), np.int8 if graph else np.uint8).reshape(n, -1)
            if graph:
                m = ann.decoded(data)
                to = nodes.column("links").combine_chunks()
                wanted = [beam, beam] if beam else [max(taken, math.ceil(b * max(1.0, k / 10))) for b in nodes.column("beam")[0].as_py()]
                sizes = np.diff(to.offsets.to_numpy())
                links = np.full((n, max(1, int(sizes.max(initial=1)))), -1, np.int64)
                links[np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = to.flatten().to_numpy()
            for at in range(0, len(q), step):
                part_q = q[at : at + step]
                if graph:
                    of, row, score, scored = ann.searched(m, links, part_q, *wanted)
                    best = np.arange(len(of)) - np.searchsorted(of, of, "left") < taken
                    of, row, score = of[best], row[best], score[best]
                else:
                    s = books.scores(books.tables(part_q), data)
                    few = min(taken, n)
                    row = np.argpartition(-s, few - 1, axis=1)[:, :few]
                    of, score, row = np.repeat(np.arange(len(s)), few), np.take_along_axis(s, row, axis=1).ravel(), row.ravel()
                    scored = np.full(len(s), n)
                every = np.arange(len(part_q))
                for held, x in zip(found, (np.concatenate([of, every]) + at, np.concatenate([row, np.full(len(every), -1)]), np.concatenate([score, np.full(len(every), -9, np.float32)]), np.concatenate([np.zeros(len(of), np.int64), scored])), strict=True):
                    held.append(x)
        none = np.zeros(0, np.int64)
        of, row, score, scored = (np.concatenate([none.astype(x[0].dtype) if x else none, *x]) for x in found)
        size = len(of)
        return pa.table({"query": asked.column("query").take(pa.array(of)), "cell": pa.array(np.full(size, cell, np.int32)), "segment": pa.array([segment] * size, pa.string()), "part": pa.array(np.full(size, part, np.int32)), "pos": pa.array(row.astype(np.int32)), "rough": pa.array(score.astype(np.float32)), "scored": pa.array(scored.astype(np.int64))})

    return run
