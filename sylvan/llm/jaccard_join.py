"""Set-similarity join of documents on word 5-shingles (Jaccard >= 0.8) with set-relation skipping.

Index: sets are ordered by (how common a shingle is, its hash) and only prefixes are indexed, as any linked pair shares a
prefix shingle. A shingle's list is sorted by set size and cut into blocks; blocks and entries are skipped by size and by
position, which bound the overlap, and pairs by narrow sketches that bound the difference. A pair that meets in many lists
is given in one of them, which both sets' marks name. Answers: neighbours in a list that prove to be linked form a group whose answer is
known, so a set's further partners are only sought outside its group (Wang et al. 2017, "Leveraging set relations in exact
set similarity join"). What is left is verified with whole sets; no link is lost and no list is capped.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import components, lean, parts, written

#: Words of a shingle; hashes kept per worker; text handled at a time; entries of a block; common shingles told apart
#: (they only set the order of indexing, so this bound loses nothing); count in an Arrow batch from which a
#: shingle is counted; rounds that seek one partner a set before all are sought.
WORDS, KEPT, BATCH, BLOCK, COMMON, OFTEN, ROUNDS = 5, 250_000, 4 << 20, 4096, 200_000, 4, 2
NARROW, MARKS = ["k0", "k1", "k2", "k3"], ["m0", "m1", "m2", "m3"]
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def overlap(nx, ny):
    """Least intersection of linked sets of these sizes: 100 i >= 80 (nx + ny - i)."""
    return (4 * (nx + ny) + 8) // 9


class Shingler:
    """Sorted distinct 64-bit shingle hashes of whole texts, A-Z lower-cased, words split at ASCII white space."""

    def __init__(self):
        self.table: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.table) > KEPT:
            self.table.clear()
        try:
            h = np.fromiter(map(self.table.__getitem__, words), np.uint64, len(words))
        except KeyError:
            self.table.update((w, xxhash.xxh64_intdigest(w)) for w in set(words).difference(self.table))
            h = np.fromiter(map(self.table.__getitem__, words), np.uint64, len(words))
        n = min(WORDS, len(h))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s = (s ^ h[k : len(h) - n + 1 + k]) * A
            s ^= s >> np.uint64(31)
        s *= B
        s ^= s >> np.uint64(33)
        s.sort()
        return s[np.append(True, s[1:] != s[:-1])]


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of hashes in each of 2^k cells, 2^k about the set's size, 256 at least."""
    cells = 1 << max(8, (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def narrow(sketches: list[bytes]) -> np.ndarray:
    """The sketches folded to 256 cells, as four words each: small enough to go with every entry of a list."""
    return np.array([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, 4)) for x in sketches], np.uint64).reshape(-1, 4)


def sketch_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference; the larger sketch is folded to the smaller one's cells."""
    x, y = (np.frombuffer(v, np.uint64) for v in (x, y))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _texts(batch, column: int):
    """(row, text) runs of about BATCH bytes, null text as empty."""
    texts = batch.column(column)
    for i, j in parts(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH):
        yield i, [x or "" for x in texts[i:j].to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    return np.array([(s * A).sum() for s in sets], np.uint64), np.array([((s ^ (s >> np.uint64(32))) * B).sum() for s in sets], np.uint64)


def summaries(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, set size n, 128-bit digest (s1, s2) of the set, its sketch, also narrow (k0 to k3). kind 1: a shingle (as doc_id) and how
    often it came in a batch of texts, where that is at least OFTEN."""

    def run(batches):
        shingle = Shingler()
        for b in batches:
            size, s1, s2, wide, every = [], [], [], [], []
            for _, texts in _texts(b, 1):
                sets = [shingle(x) for x in texts]
                size += map(len, sets)
                for to, x in zip((s1, s2), digests(sets), strict=True):
                    to.append(x)
                wide += [sketch(s) for s in sets]
                every.append(np.concatenate(sets))
            s1, s2, every = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (s1, s2, every))
            fold = narrow(wide)
            every.sort()
            # A key that stands OFTEN times is at the place OFTEN - 1 behind its first one.
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)] & np.append(every[OFTEN - 1 :] == every[: len(every) - OFTEN + 1], np.zeros(OFTEN - 1, bool))[: len(every)])
            key = every[first]
            n = np.searchsorted(every, key, side="right") - first
            del every
            none = np.zeros(len(key), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([0, 1], [len(size), len(key)]).astype(np.int32)),
                    pa.concat_arrays([b.column(0), pa.array(signed(key))]),
                    pa.array(np.append(size, n).astype(np.int64)),
                    pa.array(np.append(signed(s1), none)),
                    pa.array(np.append(signed(s2), none)),
                    pa.array([x if s else None for x, s in zip(wide, size, strict=True)] + [None] * len(key), pa.binary()),
                    *(pa.array(np.append(signed(np.ascontiguousarray(fold[:, k])), none)) for k in range(4)),
                ],
                ["kind", "doc_id", "n", "s1", "s2", "sketch", *NARROW],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "kind int, doc_id long, n long, s1 long, s2 long, sketch binary, k0 long, k1 long, k2 long, k3 long")


def prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, n, s1, s2 and the set's prefix in the order (how common, hash). common: shingles from rare to common."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        shingle, by_hash = Shingler(), np.sort(sent.value)
        rank = np.argsort(sent.value, kind="stable")
        mask, maybe = np.uint64((1 << 23) - 1), np.zeros(1 << 23, bool)
        maybe[(by_hash & mask).astype(np.int64)] = True
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, texts in _texts(b, 1):
                sets = [shingle(x) for x in texts]
                s1, s2 = digests(sets)
                n, out = np.array([len(s) for s in sets], np.int64), []
                for s in sets:
                    most = len(s) - (4 * len(s) + 4) // 5 + 1 if len(s) else 0
                    often = np.flatnonzero(maybe[(s & mask).astype(np.int64)])
                    if len(often):
                        at = np.minimum(np.searchsorted(by_hash, s[often]), len(by_hash) - 1)
                        hit = by_hash[at] == s[often]
                        often, at = often[hit], at[hit]
                        rare = np.delete(s, often)
                        s = rare if len(rare) >= most else np.append(rare, s[often][np.argsort(rank[at], kind="stable")])
                    out.append(s[:most])
                at = pa.array(np.append(0, np.cumsum([len(x) for x in out])).astype(np.int32))
                cols = [pa.array(ids[i : i + len(n)], pa.int64()), pa.array(n), pa.array(signed(s1)), pa.array(signed(s2)), pa.ListArray.from_arrays(at, pa.array(signed(np.concatenate(out))))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "s1", "s2", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, s1 long, s2 long, prefix array<long>")


def may_link(nx, px, ny, py):
    """Size and position filters for entries x and y of a list with nx <= ny: linked sets pass in every list that both are in."""
    return (4 * ny <= 5 * nx) & (np.minimum(px, py) + 1 + np.minimum(nx - px, ny - py) - 1 >= overlap(nx, ny))


def indexed(nx, px):
    """Whether the place is in the smaller set's index prefix: linked sets meet in at least one list where it is."""
    return px < nx - (8 * nx + 8) // 9 + 1


def _lists(batches):
    """Out of entries sorted by (key, n, doc_id): those of lists of two or more, with a block number and the linkable entry
    before. A list that may go on in the partition before or behind, or that has several blocks, is marked open."""
    part, number, held, continued, first = TaskContext.get().partitionId() << 34, 0, None, False, True

    def emit(rows, starts, ends, is_open):
        nonlocal number
        rows = [c[np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)])] for c in rows]
        size = ends - starts
        key, n, doc, pos = rows
        new = np.zeros(len(key), bool)
        new[np.cumsum(size)[:-1]] = new[0] = True
        prev = np.append(doc[:1], doc[:-1])
        ok = ~new
        ok[1:] &= may_link(n[:-1], pos[:-1], n[1:], pos[1:]) & indexed(n[:-1], pos[:-1]) & (doc[1:] != doc[:-1])
        block = part + number + np.repeat(np.arange(len(size)), size)
        number += len(size)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(block), pa.array(n), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(prev, mask=~ok), pa.array(np.repeat(is_open, size))], ["key", "block", "n", "doc_id", "pos", "prev", "open"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        rows = rows if held is None else [np.append(x, y) for x, y in zip(held, rows, strict=True)]
        key = rows[0]
        at = np.append(np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1), len(key))
        starts, ends = at[:-2], at[1:-1]
        is_open = np.zeros(len(starts), bool)
        if len(starts) and (first or continued):
            is_open[0] = True
        keep = (ends - starts >= 2) | is_open
        if keep.any():
            yield emit(rows, starts[keep], ends[keep], is_open[keep])
        if len(starts):
            first = continued = False
        rest = [c[at[-2] :] for c in rows]
        while len(rest[0]) >= 2 * BLOCK:
            yield emit(rest, np.array([0]), np.array([BLOCK]), np.array([True]))
            rest, continued = [c[BLOCK:] for c in rest], True
        held = rest
    if held is not None and len(held[0]):
        yield emit(held, np.array([0]), np.array([len(held[0])]), np.array([True]))


def outside(c1, c2, side, n, pos, doc, group, key, fold, marks, nearest=False):
    """Pairs of entries of a cell that pass the filters and are of different groups; entries sorted by (c1, c2, n, doc).
    `fold` has the words of the narrow sketches, `marks` some keys of each set.

    All cells are compared at once: each entry with the one `step` behind it, as long as sizes may still link. A pair with a
    mark in common is given in the list of the first such mark only, where both sets are, other pairs in all lists.
    With `nearest`, only the first pair of each entry. Rows are (low, high, bits in which the narrow sketches differ).
    """
    new = np.append(True, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))
    begins = np.flatnonzero(new)
    size = np.diff(np.append(begins, len(c1)))
    mixed = np.minimum.reduceat(group, begins) != np.maximum.reduceat(group, begins)
    crossing = np.repeat(np.maximum.reduceat(side, begins) > 0, size)
    end = np.repeat(begins + size, size)
    i, step, a, b = np.flatnonzero(np.repeat(mixed, size)), 0, [], []
    apart = []
    while True:
        step += 1
        i = i[i + step < end[i]]
        i = i[4 * n[i + step] <= 5 * n[i]]
        if not len(i):
            break
        j = i + step
        ok = (group[i] != group[j]) & (~crossing[i] | (side[i] != side[j])) & may_link(n[i], pos[i], n[j], pos[j])
        at = np.flatnonzero(ok)
        here = indexed(n[i[at]], pos[i[at]])
        for m in marks[::-1]:
            here = np.where(m[i[at]] == m[j[at]], m[i[at]] == key[i[at]], here)
        ok[at] = here
        at = at[here]
        differ = sum(np.bitwise_count(w[i[at]] ^ w[j[at]]).astype(np.int64) for w in fold)
        ok[at] = close = differ <= n[i[at]] + n[j[at]] - 2 * overlap(n[i[at]], n[j[at]])
        apart.append(differ[close])
        a.append(doc[i[ok]])
        b.append(doc[j[ok]])
        if nearest:
            i = i[~ok]
    if not a:
        return np.zeros((0, 3), np.int64)
    a, b, apart = np.concatenate(a), np.concatenate(b), np.concatenate(apart)
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high, apart = low[order], high[order], apart[order]
    return np.stack([low, high, apart], 1)[np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(low)]]


def _outside(nearest, batches):
    """outside() over batches sorted by cell; the last cell, of 2 * BLOCK entries at most, is held over."""
    held = None

    def found(cols):
        got = outside(*cols[:8], [c.view(np.uint64) for c in cols[8 : 8 + len(NARROW)]], cols[8 + len(NARROW) :], nearest=nearest)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, k])) for k in range(3)], ["a", "b", "apart"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
        held = cols if held is None else [np.append(x, y) for x, y in zip(held, cols, strict=True)]
        at = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
        if len(at):
            yield found([c[: at[-1] + 1] for c in held])
            held = [c[at[-1] + 1 :] for c in held]
    if held is not None:
        yield found(held)


def verified(pairs: DataFrame, docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The linked pairs among (a, b): first by sketches, which rule out most others, then by the whole sets."""

    def near(frames):
        for pdf in frames:
            keep = [sketch_distance(x, y) <= nx + ny - 2 * overlap(nx, ny) for x, y, nx, ny in zip(pdf["sa"], pdf["sb"], pdf["na"], pdf["nb"], strict=True)]
            yield pdf.loc[keep, ["a", "b"]] if len(pdf) else pdf[["a", "b"]]

    sa = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    sb = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    left = written(pairs.join(sa, "a").join(sb, "b").mapInPandas(near, "a long, b long").distinct(), "pairs")

    def whole(batches):
        shingle = Shingler()
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, texts in _texts(b, 1):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + len(texts)], pa.int64()), pa.array([shingle(x).tobytes() for x in texts], pa.binary())], ["doc_id", "set"])

    ids = left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(lean(whole), "doc_id long, set binary")
    sets = written(sets.hint("rebalance"), "sets", large=True)  # few sets of many documents would make a small file for each task

    def same(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                i = int((both[1:] == both[:-1]).sum())
                keep.append(100 * i >= 80 * (len(x) + len(y) - i) and i > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    return left.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(same), "a long, b long")


def near_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    A document's set is its distinct 5-word shingles; with fewer words, all of them as one; without words or with null
    text it is empty and linked with nothing. Documents of equal sets are one class, so copies are not compared. Rows that
    repeat a doc_id are one node. A null doc_id is linked with nothing and has a null component. An empty table gives an
    empty result. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    both = written(summaries(docs), "summaries", large=True)
    rows = both.where("kind = 0")
    top = written(both.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "doc_id").limit(COMMON), "common").toArrow()
    key, n = (top.column(k).to_numpy().astype(np.int64) for k in range(2))
    common = key[np.lexsort((-key, n))].view(np.uint64)  # rare to common
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    reps = classes.select(F.col("rep").alias("doc_id"), "s1", "s2")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = prefixes(docs, common.copy()).join(reps, ["doc_id", "s1", "s2"]).select("doc_id", "n", F.posexplode("prefix").alias("pos", "key")).select("key", "n", "doc_id", F.col("pos").cast("long").alias("pos"))
    entries = entries.repartitionByRange(n_parts, "key", "n", "doc_id").sortWithinPartitions("key", "n", "doc_id")
    lists = written(entries.mapInArrow(lean(_lists), "key long, block long, n long, doc_id long, pos int, prev long, open boolean"), "lists", large=True)
    # Four keys of each set by the smallest of four hashes; none that would be of use where rows of a doc_id differ.
    marks = lists.groupBy("doc_id", "n").agg(*(F.min_by("key", F.xxhash64("key", F.lit(t))).alias(m) for t, m in enumerate(MARKS)))
    marks = marks.join(reps.groupBy("doc_id").count().where("count > 1"), "doc_id", "left_anti")
    own = rows.where("n > 0").join(reps, ["doc_id", "s1", "s2"], "left_semi").select("doc_id", "n", "sketch", *NARROW).distinct().join(marks, ["doc_id", "n"], "left")
    sketches = written(own.withColumns({m: F.coalesce(m, F.xxhash64("doc_id", F.lit(t))) for t, m in enumerate(MARKS)}), "sketches", large=True)

    # Each set and the neighbour it shares most lists with.
    best = lists.where("prev IS NOT NULL").groupBy("doc_id", "prev").count().groupBy("doc_id").agg(F.max_by("prev", F.struct("count", "prev")).alias("prev"))
    tried = written(best.select(F.least("doc_id", "prev").alias("a"), F.greatest("doc_id", "prev").alias("b")).distinct(), "tried")
    links = written(verified(tried, docs, sketches), "links")

    blocks = lists.where("open").groupBy("key", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = blocks.alias("x"), blocks.alias("y")
    crossing = x.join(y, F.col("x.key") == F.col("y.key")).where("x.block < y.block AND 4 * y.low <= 5 * x.high AND 4 * x.low <= 5 * y.high").select(F.col("x.block").alias("c1"), F.col("y.block").alias("c2"))
    ends = written(crossing.select(F.col("c1").alias("block"), "c1", "c2", F.lit(0).alias("side")).unionByName(crossing.select(F.col("c2").alias("block"), "c1", "c2", F.lit(1).alias("side"))), "ends")
    cols = ["c1", "c2", "side", "n", "pos", "doc_id", "grp", "key", *NARROW, *MARKS]
    new, k, nearest = links, 0, True
    while nearest:
        # Partners outside the group: one a set while that finds links, so that groups grow together, in the end all.
        nearest, k = k < ROUNDS and not new.isEmpty(), k + 1
        groups = sketches.join(components(links).withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("grp"), *NARROW, *MARKS)
        e = lists.select("block", "n", "pos", "doc_id", "key", "open").join(groups, ["doc_id", "n"])
        cells = e.select(F.col("block").alias("c1"), F.col("block").alias("c2"), F.lit(0).alias("side"), *cols[3:]).unionByName(e.where("open").join(ends, "block").select(*cols))
        more = cells.select(*cols).repartition(n_parts, "c1", "c2").sortWithinPartitions("c1", "c2", "n", "doc_id").mapInArrow(lean(partial(_outside, nearest)), "a long, b long, apart long")
        more = more.groupBy("a", "b").agg(F.min("apart").alias("apart")).join(tried, ["a", "b"], "left_anti")
        if nearest:
            more = more.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a"))
        more = written(more.select("a", "b"), "more", large=True)
        tried = tried.unionByName(more)
        new = written(verified(more, docs, sketches), "links")
        links = links.unionByName(new)
    comp = components(links).withColumnRenamed("node", "rep")
    per_class = classes.join(comp, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("comp"))
    joined = rows.join(per_class, ["s1", "s2"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("comp")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the row whose doc_id is the component's smallest. All columns kept.

    Rows without words, with null text or with a null doc_id are linked with nothing and stay, as do all rows that repeat the
    smallest doc_id. An empty table stays empty.
    """
    own = docs.columns
    gone = near_documents(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").select(*own)
