"""Removal of long repeated byte strings through sharded suffix arrays.

Every 50-byte window belongs to the smallest hash of its 16-byte substrings (its anchor), so equal windows have equal
anchors, wherever they are. A maximal run of windows with the same anchor is a snippet; snippets are dealt out by anchor.
Equal snippets are settled by their owner, the smallest document that has them: all other documents' are covered whole. Of
snippets that share an anchor but differ, the owners' bytes are suffix-sorted to a depth of 50, anchors batch by batch, and
each class of equal windows is settled by its smallest document.

A run-length Burrows-Wheeler index is not used: its matching statistics give the longest match in all indexed documents,
the text itself among them, while here only matches in documents with a smaller doc_id count. See the README.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import lean, parts, written

#: Bytes of a window and of an anchor; bytes of text at a time; contested snippets of an anchor that are held in a task.
LENGTH, ANCHOR = 50, 16
WINDOWS = LENGTH - ANCHOR + 1
BATCH, HOT = 4 << 20, 4096
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
R = 0x5851F42D4C957F2D
CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.append(out, out * np.uint64(pow(base, len(out), 1 << 64)))
    return out[:n]


def snippets(text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document number, start in it, windows, anchor, digest) of all snippets. begins: of the documents in text, and its end."""
    n, sizes = len(text), np.diff(begins)
    if not (sizes >= LENGTH).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    padded = np.append(text, np.zeros(16, np.uint8))
    eight = np.ndarray(n, "<u8", padded.data, 0, (1,)).astype(np.uint64)
    low = eight * A
    low ^= low >> np.uint64(29)
    high = np.append(eight[8:], np.zeros(8, np.uint64)) * B
    high ^= high >> np.uint64(31)
    h = (low + high) * A
    h ^= h >> np.uint64(32)
    del low, high, eight
    # Smallest of each window's hashes; of equal hashes the first. The low bits give way to the place.
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    v = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    least, span = v, 1
    while span * 2 <= WINDOWS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < WINDOWS:
        least = np.minimum(least[: len(least) - (WINDOWS - span)], least[WINDOWS - span :])
    count = np.maximum(sizes - LENGTH + 1, 0)
    has = count > 0
    starts = np.repeat(begins[:-1][has] - np.append(0, np.cumsum(count[has])[:-1]), count[has]) + np.arange(count.sum())
    doc = np.repeat(np.flatnonzero(has), count[has])
    place = (least[starts] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
    size = np.diff(np.append(new, len(place)))
    start, doc, place = starts[new], doc[new], place[new]
    inverse = powers(pow(R, -1, 1 << 64), n)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(CODE[text] * powers(R, n), dtype=np.uint64))
    digest = (sums[start + size + LENGTH - 1] - sums[start]) * inverse[start]
    digest ^= digest >> np.uint64(32)
    # The place of the anchor in the snippet belongs to the digest's key, as does the length.
    digest = (digest + size.astype(np.uint64)) * B
    return doc, start - begins[:-1][doc], size, h[place], digest ^ (digest >> np.uint64(29))


def _all_snippets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = b.column(1).cast(pa.binary())
            for i, j in parts(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH):
                own = [x or b"" for x in texts[i:j].to_pylist()]
                begins = np.cumsum([0] + [len(x) for x in own])
                doc, start, size, anchor, digest = snippets(np.frombuffer(b"".join(own), np.uint8), begins)
                cols = [anchor.view(np.int64), digest.view(np.int64), ids[i:j][doc], start.astype(np.int32), size.astype(np.int32)]
                for s in range(0, len(doc), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 100_000]) for c in cols], ["anchor", "digest", "doc", "start", "size"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(lean(run), "anchor long, digest long, doc long, start int, size int")


def _settle(batches):
    """Out of snippets sorted by (anchor, digest, doc): covered ones (contested false), and the owners' of anchors with
    several digests (contested true). Only owners' snippets of the last anchor are held over, HOT of them at most."""
    names = ["anchor", "doc", "start", "size", "contested"]
    last, held, several = None, [], False

    def rows(cols, contested):
        anchor, _, doc, start, size = cols
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc), pa.array(start), pa.array(size), pa.array(np.full(len(doc), contested))], names)

    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        anchor, digest, doc = cols[:3]
        new_anchor = np.append(last is None or anchor[0] != last[0], anchor[1:] != anchor[:-1])
        new = new_anchor | np.append(last is not None and digest[0] != last[1], digest[1:] != digest[:-1])
        first = np.where(new, doc, np.iinfo(np.int64).min)
        at = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
        owner = np.where(at >= 0, doc[at], last[2] if last else 0)
        covered = doc > owner
        if covered.any():
            yield rows([c[covered] for c in cols], False)
        # Does the anchor have more than one digest? Looked at per stretch of one anchor in this batch.
        begins = np.flatnonzero(new_anchor)
        if not len(begins) or begins[0] != 0:
            begins = np.append(0, begins)
        ends = np.append(begins[1:], len(doc))
        more = np.add.reduceat((new & ~new_anchor).astype(np.int64), begins) > 0
        if new_anchor[0]:
            if several and held:
                for h in held:
                    yield rows(h, True)
            held, several = [], False
        else:
            more[0] |= several
            if more[0] and held:
                for h in held:
                    yield rows(h, True)
                held = []
        own = ~covered
        settled = np.repeat(more, ends - begins)
        tail = np.arange(len(doc)) >= begins[-1]
        out = own & settled
        if out.any():
            yield rows([c[out] for c in cols], True)
        if len(begins) > 1:
            held = []
        several = bool(more[-1])
        if not several:
            keep = own & tail
            # One owner's snippets of one digest: the first is enough to know, but each place of it counts.
            held.append([c[keep] for c in cols])
        last = anchor[-1], digest[-1], owner[-1]
    return


def window_classes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each start, equal for starts of equal LENGTH-byte strings: ranks by depth 8, 16, 32, LENGTH."""
    padded = np.append(text, np.zeros(8, np.uint8))
    _, rank = np.unique(np.ndarray(len(text), ">u8", padded.data, 0, (1,)).astype(np.uint64), return_inverse=True)
    rank, depth = rank.astype(np.int64), 8
    while depth < 32:
        pair = rank[:-depth] * (len(text) + 1) + rank[depth:]
        _, rank = np.unique(pair, return_inverse=True)
        depth *= 2
    pair = rank[starts] * (len(text) + 1) + rank[starts + LENGTH - depth]
    return np.unique(pair, return_inverse=True)[1]


def _contested(batches):
    """Out of snippets' bytes sorted by anchor: the windows that a smaller document has too, as runs (doc, start, size)."""

    def run(doc, start, raw):
        size = np.array([len(x) for x in raw]) - LENGTH + 1
        begins = np.cumsum([0] + [len(x) for x in raw])[:-1]
        owner = np.repeat(np.arange(len(raw)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        cls = window_classes(np.frombuffer(b"".join(raw), np.uint8), begins[owner] + inside)
        least = np.full(cls.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, cls, doc[owner])
        hit = np.flatnonzero(least[cls] < doc[owner])
        if len(hit):
            new = np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]))
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(hit)))
            yield pa.RecordBatch.from_arrays([pa.array(doc[owner[hit[at]]]), pa.array((start[owner[hit[at]]] + inside[hit[at]]).astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "start", "size"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        got = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] + [np.array(b.column(3).to_pylist() + [None], object)[:-1]]
        held = got if held is None else [np.append(x, y) for x, y in zip(held, got, strict=True)]
        key = held[0]
        at = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        if len(key) - 0 > 20_000 and at[-1]:
            # Whole anchors, about 20,000 snippets (1.5 MB) at a time.
            s = 0
            while s < at[-1]:
                e = at[min(np.searchsorted(at, s + 20_000), len(at) - 1)]
                yield from run(held[1][s:e], held[2][s:e], held[3][s:e])
                s = e
            held = [c[at[-1] :] for c in held]
    if held is not None:
        yield from run(*held[1:])


def repeated(docs: DataFrame) -> DataFrame:
    """doc, start, size: runs of 50-byte windows of a document that also start in a document with a smaller doc_id."""
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["anchor", "digest", "doc", "start"]
    settled = written(_all_snippets(docs).repartition(n_parts, "anchor").sortWithinPartitions(*order).mapInArrow(lean(_settle), "anchor long, doc long, start int, size int, contested boolean"), "snippets")
    open_ = settled.where("contested")
    hot = open_.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    places = open_.join(hot, "anchor", "left").groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "size", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("at"))

    def cut(batches):
        for b in batches:
            for doc, text, at in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2), strict=True):
                raw, at = text.as_py() or b"", at.values
                anchor, start, size, is_hot = (at.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                own = [raw[s : s + n + LENGTH - 1] for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.full(len(own), doc)), pa.array(start), pa.array(own, pa.binary()), pa.array(is_hot)], ["anchor", "doc", "start", "raw", "hot"])

    got = docs.select(F.col("doc_id").alias("doc"), "text").join(places, "doc").mapInArrow(lean(cut), "anchor long, doc long, start int, raw binary, hot boolean").where(F.octet_length("raw") >= LENGTH)
    got = written(got.dropDuplicates(["anchor", "doc", "start", "hot"]), "contested")
    plain = got.where("NOT hot").select("anchor", "doc", "start", "raw").repartition(n_parts, "anchor").sortWithinPartitions("anchor").mapInArrow(lean(_contested), "doc long, start int, size int")
    # Anchors with very many different snippets are dealt out window by window.
    each = got.where("hot").select("doc", F.col("start").alias("from"), "raw", F.explode(F.sequence(F.lit(0), F.octet_length("raw") - LENGTH)).alias("k")).select("doc", (F.col("from") + F.col("k")).alias("start"), F.expr(f"substring(raw, k + 1, {LENGTH})").alias("w"))
    least = each.groupBy("w").agg(F.min("doc").alias("least"))
    windows = each.join(least, "w").where("doc > least").select("doc", "start", F.lit(1).alias("size"))
    return settled.where("NOT contested").select("doc", "start", "size").unionByName(plain).unionByName(windows)


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if with_text) of every row of docs.

    Each byte covered by a 50-byte string that also starts in a document with a smaller doc_id is removed; strings are
    judged on the input. Null text is empty. A null doc_id is compared with nothing and keeps all its bytes. Rows that
    repeat a doc_id are taken to repeat its text and don't affect each other. An empty table gives an empty result.
    """
    spans = repeated(docs).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("at"))

    def run(batches):
        for b in batches:
            size, gone, n, sha, kept = [], [], [], [], []
            for text, at in zip(b.column(1).cast(pa.binary()), b.column(2), strict=True):
                raw, left, begin = text.as_py() or b"", [], 0
                total = runs = 0
                if at.is_valid:
                    s = at.values.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    e = np.maximum.accumulate(np.minimum(s + at.values.field(1).to_numpy(zero_copy_only=False) + LENGTH - 1, len(raw)))
                    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                    for i, j in zip(s[new].tolist(), e[np.append(new[1:], len(s)) - 1].tolist(), strict=True):
                        left.append(raw[begin:i])
                        begin, total, runs = j, total + j - i, runs + 1
                left = b"".join([*left, raw[begin:]])
                size.append(len(raw))
                gone.append(total)
                n.append(runs)
                sha.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left)
            cols = [b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())] + [pa.array(kept, pa.binary())] * with_text
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    rows = docs.select("doc_id", "text").join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "at")
    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
