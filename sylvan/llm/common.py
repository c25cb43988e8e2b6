"""Shared pieces: durable lineage cuts, bounded batches and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task may hold at once (16 MB); up to that many are joined up in one step, more by star steps.
HELD = 1_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: On a file: path, Hadoop's checksummed local file system starts a chmod process for a task's folder, its file and its .crc file.
#: The raw one writes no .crc files; uncached, so that it serves the tables written here only. Other file systems are not touched.
RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, a temporary one if Spark runs in one process;
    on a cluster a machine's own folder would lose rows, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sylvan-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_kept: dict = {}


def released() -> None:
    """Give free memory back to the system; the allocators of a reused Python worker would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def resident(key, make):
    """make(), kept for the tasks that this Python worker runs next. A worker keeps one such table: that of another key goes
    first and its memory back to the system, so that stages which follow each other don't add up."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        released()
        _kept[key] = make()
    return _kept[key]


def lean(run, keeps: bool = False):
    """run as a function for mapInArrow whose tasks leave small workers behind: resident tables go first unless it keeps one, and
    free memory goes back at the end."""

    def task(batches):
        if not keeps and _kept:
            _kept.clear()
            released()
        try:
            yield from run(batches)
        finally:
            released()

    task.__name__ = getattr(run, "func", run).__name__
    return task


def collected(jvm) -> None:
    """Collect the driver's garbage if its heap has grown beyond half its limit. Plans and small broadcasts of queries that have
    ended are most of it; the collector would rather grow the heap, of which a small driver has none to spare."""
    heap = jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        heap.gc()


def collected_by_executors(spark: SparkSession) -> None:
    """Collect the executors' garbage, by one small task for each of them, and so give back heap that a step before has grown.
    G1 returns memory after a whole collection only. Tasks are dealt out in turn, so a busy executor may be left out."""
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is counted too
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def written(df: DataFrame, tag: str, large: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: a lineage cut that survives lost executors. After steps that are
    `large` the executors collect their garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    # What the write shuffled is not read again, so its files may go as soon as it has ended.
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **RAW).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    collected(spark._jvm)
    if large:
        collected_by_executors(spark)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col):
    """Lower-case A-Z only. Pure ASCII text takes the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def parts(lengths, most: int):
    """Yield (start, end) runs of rows whose lengths sum to about `most`; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges a-b with the smallest node it reaches through them (local union-find by pointer jumping)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _forest_rows(frames):
    """Per task: replace a batch of edges by the edges to each local root. Memory is bounded by the Arrow batch."""
    for pdf in frames:
        if len(pdf):
            nodes, roots = forest(pdf["a"].to_numpy(), pdf["b"].to_numpy())
            keep = nodes != roots
            yield pdf.iloc[:0].reindex(range(int(keep.sum()))).assign(a=nodes[keep], b=roots[keep])[["a", "b"]].astype("int64")


def _forest_whole(frames):
    """The edges of a task, HELD at most, replaced by the edges to their roots."""
    held = [pdf for pdf in frames if len(pdf)]
    if held:
        nodes, roots = forest(np.concatenate([x["a"].to_numpy() for x in held]), np.concatenate([x["b"].to_numpy() for x in held]))
        keep = nodes != roots
        yield held[0].iloc[:0].reindex(range(int(keep.sum()))).assign(a=nodes[keep], b=roots[keep])[["a", "b"]].astype("int64")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node reachable.

    Up to HELD edges are joined up by one task, more by alternating large-star and small-star steps (Kiveris et al. 2014):
    each step is one aggregation and one join, each round is written to the shared folder. Nothing is gathered on the
    driver but one count a round. Isolated nodes have no edges and so no row. Hot centres: minima are pre-aggregated on
    the map side, and the joins may be split by AQE.
    """
    e = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInPandas(_forest_rows, "a long, b long").distinct(), "edges")
    state = None
    if e.count() <= HELD:
        e = written(e.coalesce(1).mapInPandas(_forest_whole, "a long, b long"), "star")
        return _with_roots(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low2.select("a", F.col("m").alias("b"))).distinct()
        e = written(small, "star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return _with_roots(e)
        state = now


def _with_roots(e: DataFrame) -> DataFrame:
    """(node, component) of stars, their centres included."""
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def with_component(ids: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """ids plus component_id: that of `edges`, or the key itself."""
    c = components(edges).withColumnRenamed("node", key)
    return ids.join(c, key, "left").withColumn("component_id", F.coalesce("component", key)).drop("component")


def split_hot(df: DataFrame, key: list[str], row: str, block: int) -> DataFrame:
    """Rows with columns cell_i, cell_j, side, so that any two rows of a key meet in exactly one cell.

    A key of up to `block` rows is the one cell (0, 0). A longer key is dealt into n blocks by a hash of `row`; cell (i, j)
    with i < j compares block i with block j (side 0 and 1), cell (i, i) compares a block with itself, so no task holds
    more than two blocks of a key however hot it is. Only keys beyond `block` are joined back; their number is at most
    rows / block.
    """
    hot = df.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("n_blocks"))
    d = df.join(hot, key, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    d = d.withColumn("own", F.pmod(F.xxhash64(row), F.col("n_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return d.select(*df.columns, F.least("own", "other").alias("cell_i"), F.greatest("own", "other").alias("cell_j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
