"""Near-duplicate vectors through iterative quantisation and multi-index Hamming tables, reranked exactly.

A rotation is learnt on a bounded sample (PCA, then alternating sign codes and a Procrustes rotation; Gong and Lazebnik
2011); several random starts give several codes. The bits are cut into substrings, each the key of a hash table. The tables
hold packed codes only: pairs that share a key are retrieved by the Hamming distance of their whole codes. Vectors then travel
to the buckets in which they have a partner, where the retrieved pairs are compared by cosine in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import components, forest, split_hot, written

#: Sample rows for the rotations, rotations, refinement steps, least and most bits of a key, rows of a block.
SAMPLE, ROTATIONS, STEPS, LEAST_BITS, MOST_BITS, BLOCK = 20_000, 5, 30, 6, 16, 4096
#: Cosines this close to the threshold are computed again by the plain formula.
NEAR = 1e-9
#: Sample vectors turned to the threshold's angle to find the Hamming radius, and the share of them that it must hold.
TURNED, HOLDS = 2000, 0.9995


def quantiser(sample: np.ndarray, rotations: int = ROTATIONS, steps: int = STEPS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projections): bits of x are (x - mean) @ projection > 0 for each projection, balanced about the mean."""
    mean = sample.mean(0)
    x = sample - mean
    _, vectors = np.linalg.eigh(x.T @ x)
    base, rng, out = vectors[:, ::-1], np.random.default_rng(seed), []
    v = x @ base
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((v.shape[1],) * 2))[0]
        for _ in range(steps):
            b = np.where(v @ r > 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        out.append(base @ r)
    return mean, np.stack(out)


def signs(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bits of unit vectors: rows x rotations x dimensions."""
    mean, projections = model
    return np.stack([(x - mean) @ p > 0 for p in projections], 1)


def packed_codes(bits: np.ndarray) -> np.ndarray:
    """Rows of bytes, zeros behind the last bit up to whole 64-bit words."""
    flat = np.packbits(bits.reshape(len(bits), -1), axis=1)
    return np.pad(flat, ((0, 0), (0, -flat.shape[1] % 8)))


def keys(bits: np.ndarray, n_bits: int) -> np.ndarray:
    """Table keys: one column per substring of each rotation's code."""
    n, rotations, dim = bits.shape
    tables = max(1, dim // n_bits)
    cut = bits[:, :, : tables * n_bits].reshape(n, rotations * tables, -1)
    return (cut @ (1 << np.arange(cut.shape[2]))).astype(np.int32)


def radius(unit: np.ndarray, model: tuple[np.ndarray, np.ndarray], threshold: float, seed: int = 0) -> int:
    """The Hamming distance of whole codes within which HOLDS of pairs at the threshold's angle lie: sample vectors turned by
    that angle in random directions, and towards other sample vectors, whichever needs more. The number of bits (nothing is
    told apart) for samples too small or thresholds outside of (0, 1)."""
    all_bits = model[1].shape[0] * unit.shape[1]
    if len(unit) < 16 or not 0 < threshold < 1:
        return all_bits
    rng, most = np.random.default_rng(seed), 0
    u = unit[rng.integers(0, len(unit), TURNED)]
    for w in (rng.standard_normal(u.shape), unit[rng.integers(0, len(unit), TURNED)]):
        w = w - (w * u).sum(1)[:, None] * u
        norm = np.sqrt((w * w).sum(1))
        ok = norm > 1e-6
        v = threshold * u[ok] + math.sqrt(1 - threshold**2) * w[ok] / norm[ok, None]
        far = (signs(u[ok], model) != signs(v, model)).sum((1, 2))
        if len(far):
            most = max(most, math.ceil(np.quantile(far, HOLDS)))
    return most or all_bits


def retrieved(words: np.ndarray, key: np.ndarray, table: int, side: np.ndarray, within: int):
    """Pairs (i, j) of one cell whose codes differ in at most `within` bits and that share no key of an earlier table."""
    cross = side.any()
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if cross else left
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        far = np.zeros((len(rows), len(right)), np.uint16)
        for w in range(words.shape[1]):
            far += np.bitwise_count(words[rows, w][:, None] ^ words[right, w][None, :])
        i, j = np.nonzero(far <= within)
        i, j = rows[i], right[j]
        if not cross:
            i, j = i[i < j], j[i < j]
        for t in range(table):
            new = key[i, t] != key[j, t]
            i, j = i[new], j[new]
        yield i, j


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def close_pairs(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) have cosine >= threshold."""
    norm = np.sqrt((x * x).sum(1))
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 65_536):
        a, b = i[at : at + 65_536], j[at : at + 65_536]
        c = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b])
        out[at : at + 65_536] = c >= threshold
        for k in np.flatnonzero(np.abs(c - threshold) <= NEAR):
            out[at + k] = (x[a[k]] @ x[b[k]]) / (norm[a[k]] * norm[b[k]]) >= threshold
    return out


def complete_groups(frames, key: list[str]):
    """Whole groups of consecutive equal keys out of batches sorted by key."""
    held = None
    for pdf in frames:
        if not len(pdf):
            continue
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        k = held[key].to_numpy()
        at = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if len(at):
            for s, e in zip(np.append(0, at[:-1]), at, strict=True):
                yield held.iloc[s:e]
            held = held.iloc[at[-1] :]
    if held is not None:
        yield held


def near_vectors(vectors: DataFrame, threshold: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id long, embedding array<float>, label int).

    Vectors are compared only with equal, non-null labels and equal lengths. Null, empty and zero vectors and those with
    null or non-finite components link with nothing: n_links 0, their own component. Equal vectors of a label are one
    class; its copies link with each other and share its links. Rows that repeat a vec_id are all returned; with different
    vectors of a label they have the links of all of these where they stand first in their class. Other columns are ignored. The rotations are learnt on about `sample` classes,
    chosen by a hash; every class is indexed. Recall against brute force is measured in the tests (at least 0.9), and no pair
    below the threshold is linked. A null vec_id keeps a null component. An empty table
    gives an empty result. Buckets beyond BLOCK vectors are split into block pairs, none dropped.
    """
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    # + 0.0 makes one zero of the two.
    rows = vectors.select("vec_id", "label", F.when(F.coalesce(good, F.lit(False)), F.transform(x, lambda v: v.cast("double") + F.lit(0.0))).alias("x"))
    rows = rows.withColumn("h", F.when(F.col("x").isNotNull(), F.md5(F.concat_ws(",", F.col("x").cast("array<string>")))))
    ids = written(rows.select("vec_id", "label", "h"), "vectors")
    kinds = ids.where("h IS NOT NULL").groupBy("label", "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    # Of rows that repeat a vec_id and its vector one stands for the class.
    classes = written(rows.where("h IS NOT NULL").withColumnRenamed("vec_id", "rep").dropDuplicates(["rep", "label", "h"]).join(kinds, ["label", "h", "rep"]).select("rep", "label", F.unhex("h").alias("h"), "mult", "x", F.size("x").alias("dim")), "classes")
    stats = {r["dim"]: (r["n"], r["most"]) for r in classes.groupBy("dim", "label").count().groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()}
    models = {}
    for dim, (n, most) in stats.items():
        share = min(1.0, sample / n)
        part = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) <= int(share * (1 << 30)))).select("x").toArrow().column(0)
        s = np.array(part.combine_chunks().flatten()).reshape(-1, dim)
        s = np.unique(s, axis=0)
        s = s / np.sqrt((s * s).sum(1))[:, None]
        model = quantiser(s if len(s) else np.zeros((1, dim)))
        models[dim] = model, min(dim, max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(most + 1))))), radius(s, model, threshold)
    sent = vectors.sparkSession.sparkContext.broadcast(models)

    def encode(frames):
        for pdf in frames:
            for dim, own in pdf.groupby("dim"):
                v = matrix(own["x"])
                bits = signs(v / np.sqrt((v * v).sum(1))[:, None], sent.value[dim][0])
                yield own.assign(code=[c.tobytes() for c in packed_codes(bits)], keys=list(keys(bits, sent.value[dim][1])))

    coded = written(classes.withColumn("label", F.col("label").cast("int")).mapInPandas(encode, "rep long, label int, h binary, mult long, x array<double>, dim int, code binary, keys array<int>"), "codes")
    table = coded.select("label", "dim", F.posexplode("keys").alias("tab", "val"), "rep", "h", "code")
    group = ["label", "dim", "tab", "val"]
    cell = [*group, "cell_i", "cell_j"]

    def pairs(g):
        """The retrieved pairs of a cell, in blocks."""
        dim, tab = int(g["dim"].iloc[0]), int(g["tab"].iloc[0])
        model, n_bits, within = sent.value[dim]
        raw = np.frombuffer(b"".join(g["code"]), np.uint8).reshape(len(g), -1)
        bits = np.unpackbits(raw, axis=1)[:, : len(model[1]) * dim].reshape(len(g), -1, dim)
        yield from retrieved(raw.view(np.uint64), keys(bits, n_bits), tab, g["side"].to_numpy(), within)

    def retrieve(frames):
        for g in complete_groups(frames, cell):
            if len(g) > 1:
                met = np.zeros(len(g), bool)
                for i, j in pairs(g):
                    met[i] = met[j] = True
                if met.any():
                    yield g.loc[met, [*cell, "side", "h"]]

    def compare(frames):
        for g in complete_groups(frames, cell):
            rep, mult, x = g["rep"].to_numpy(), g["mult"].to_numpy(), matrix(g["x"])
            n, a, b = np.zeros(len(g), np.int64), [], []
            for i, j in pairs(g):
                near = close_pairs(x, i, j, threshold)
                i, j = i[near], j[near]
                if len(i):
                    np.add.at(n, i, mult[j])
                    np.add.at(n, j, mult[i])
                    nodes, roots = forest(rep[i], rep[j])
                    a.append(nodes[nodes != roots])
                    b.append(roots[nodes != roots])
            hit = np.flatnonzero(n)
            yield pd.DataFrame({"a": rep[hit], "b": pd.array([None] * len(hit), "Int64"), "n": n[hit]})
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pd.DataFrame({"a": a, "b": pd.array(b, "Int64"), "n": np.int64(0)})

    n_parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = split_hot(table, group, "rep", BLOCK).repartition(n_parts, *cell).sortWithinPartitions(*cell)
    met = written(cells.mapInPandas(retrieve, "label int, dim int, tab int, val int, cell_i int, cell_j int, side int, h binary"), "retrieved")
    entries = met.join(coded.select("label", "h", "rep", "mult", "x", "code"), ["label", "h"]).repartition(n_parts, *cell).sortWithinPartitions(*cell)
    found = written(entries.mapInPandas(compare, "a long, b long, n long"), "links")
    count = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    per_class = kinds.join(count, "rep", "left").join(comp, "rep", "left").select("label", "h", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    return ids.join(per_class, ["label", "h"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
