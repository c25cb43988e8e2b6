"""Toxicity: a linear model over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm import nbsvm
from sylvan.llm.common import lean, parts, released, resident

#: n-gram lengths in characters, hashed cells, words kept per worker, training bounds (rows, characters), threshold.
LENGTHS, BITS, KEPT = (3, 4, 5), 18, 150_000
CELLS = 1 << BITS
MOST_ROWS, MOST_CHARS, THRESHOLD = 8_000, 20_000_000, 0.7
BATCH = 1 << 20


class Features:
    """Distinct cells of the character n-grams of a text's words. Words' cells are kept in a bounded table."""

    def __init__(self):
        self.table: dict[str, np.ndarray] = {}
        self.mark = np.zeros(CELLS, np.int32)

    def learn(self, words: list[str]) -> None:
        code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(w) + 2 for w in words])
        word = np.repeat(np.arange(len(words)), size)
        cells, owner = [], []
        with np.errstate(over="ignore"):
            for n in LENGTHS:
                if len(code) < n:
                    continue
                h = np.full(len(code) - n + 1, n, np.uint64)
                for k in range(n):
                    h = (h ^ code[k : len(code) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                same = word[: len(h)] == word[n - 1 :]
                cells.append((h[same] >> np.uint64(64 - BITS)).astype(np.int32))
                owner.append(word[: len(h)][same])
        cells, owner = np.concatenate(cells), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        at = np.cumsum(np.bincount(owner, minlength=len(words)))[:-1]
        self.table.update(zip(words, (x.copy() for x in np.split(cells[order], at)), strict=True))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [dict.fromkeys(x.lower().split()) for x in texts]
        need = dict.fromkeys(w for c in cut for w in c)
        new = [w for w in need if w not in self.table]
        if len(self.table) + len(new) > KEPT:
            self.table.clear()
            new = list(need)
        for i, j in parts([len(w) for w in new], 1 << 19):
            self.learn(new[i:j])
        out = []
        for words in cut:
            if not words:
                out.append(np.zeros(0, np.int32))
                continue
            cells = np.concatenate([*map(self.table.__getitem__, words)])
            # Distinct cells without a sort: of equal cells the one written last stays.
            place = np.arange(len(cells), dtype=np.int32)
            self.mark[cells] = place
            out.append(cells[self.mark[cells] == place])
        return out


def rows_of(features, texts: list[str]) -> list[np.ndarray]:
    return [x for i, j in parts([len(t) for t in texts], BATCH) for x in features.batch(texts[i:j])]


def scored(docs: DataFrame, model: nbsvm.LinearModel, features, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Null text is empty; a null doc_id is not held out."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        f, m = resident(features, features), sent.value
        for b in batches:
            texts, score = b.column(2), []
            for i, j in parts(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH):
                score += [m.margin(x) for x in f.batch([x or "" for x in texts[i:j].to_pylist()])]
            score = m.score(score)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(lean(run, keeps=True), "doc_id long, held_out boolean, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> nbsvm.LinearModel:
    """Model from a bounded sample of labelled rows (see nbsvm.training_rows). The driver keeps none of it but the model."""
    text, y = nbsvm.training_rows(docs, labels, "toxic", most_rows, most_chars)
    rows = rows_of(Features(), text)
    del text
    model = nbsvm.fit(rows, y, CELLS)
    del rows
    released()
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= THRESHOLD), one row per row of docs.

    Only text is read for a score, as a whole. Empty and null texts get the score of the bias alone. Without labels of
    both kinds every text gets the smoothed frequency of label 1. Repeated rows are scored each.
    """
    return scored(docs, train(docs, labels), Features, THRESHOLD)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score reaches THRESHOLD, all columns kept; the score is computed beside the row.

    Null and empty texts have the score of the bias alone. Repeated rows and null doc_ids are judged like others, by text
    only. A score at the threshold goes. An empty table stays empty; without labels of both kinds all rows have one score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        f, m = resident(Features, Features), sent.value
        for b in batches:
            texts, keep = b.column(b.schema.get_field_index("text")), []
            for i, j in parts(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH):
                keep += [m.score(m.margin(x)) < THRESHOLD for x in f.batch([x or "" for x in texts[i:j].to_pylist()])]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run, keeps=True), docs.schema)
