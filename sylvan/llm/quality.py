"""Quality: naive Bayes support vectors over indicators of word n-grams and of word-shape n-grams."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from sylvan.llm import nbsvm
from sylvan.llm.toxicity import rows_of, scored

#: Hashed cells for words and word pairs; words kept per worker; training bounds (rows, characters); threshold.
BITS, KEPT = 18, 400_000
MOST_ROWS, MOST_CHARS, THRESHOLD = 8_000, 24_000_000, 0.5
#: Shapes: plain, capitalised, ends a sentence, other punctuation behind, only punctuation, with digits, other, same word again.
SHAPES, LONGEST, LEVELS = 8, 4, 12
GRAMS = sum(SHAPES**n for n in range(1, LONGEST + 1))
CELLS = (1 << BITS) + GRAMS + SHAPES * LEVELS


def shape(word: str) -> int:
    core = word.strip(".,;:!?\"'()[]")
    if not any(c.isalnum() for c in word):
        return 4
    if any(c.isdigit() for c in word):
        return 5
    if not core.isalpha():
        return 6
    if word[-1] in ".!?":
        return 2
    if core != word:
        return 3
    return 1 if word[0].isupper() else 0


class Features:
    """Distinct cells of a text: its words, word pairs, shape n-grams, and how often each shape occurs on a log scale."""

    def __init__(self):
        self.table: dict[str, int] = {}
        self.mark = np.zeros(CELLS, np.int32)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [x.split() for x in texts]
        need = set().union(*cut)
        new = need.difference(self.table)
        if len(self.table) + len(new) > KEPT:
            self.table.clear()
            new = need
        for w in new:
            self.table[w] = xxhash.xxh64_intdigest(w.lower().encode("utf-8", "surrogatepass")) & ~7 | shape(w)
        return [self.cells(np.fromiter(map(self.table.__getitem__, c), np.uint64, len(c))) for c in cut]

    def cells(self, code: np.ndarray) -> np.ndarray:
        if not len(code):
            return np.zeros(0, np.int32)
        h, s = code >> np.uint64(3), (code & np.uint64(7)).astype(np.int32)
        s[1:][h[1:] == h[:-1]] = 7
        with np.errstate(over="ignore"):
            pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out = [(h & np.uint64((1 << BITS) - 1)).astype(np.int32), (pair >> np.uint64(64 - BITS)).astype(np.int32)]
        begin, gram = 1 << BITS, s
        for n in range(1, LONGEST + 1):
            out.append(gram + begin)
            begin += SHAPES**n
            gram = gram[:-1] * SHAPES + s[n:] if len(gram) > 1 else gram[:0]
        share = np.bincount(s, minlength=SHAPES) / len(s)
        level = np.clip(np.floor(np.log2(np.maximum(share, 2.0**-LEVELS))).astype(np.int32) + LEVELS, 0, LEVELS - 1)
        out.append(begin + np.arange(SHAPES, dtype=np.int32) * LEVELS + level)
        cells = np.concatenate(out)
        place = np.arange(len(cells), dtype=np.int32)
        self.mark[cells] = place
        return cells[self.mark[cells] == place]


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> nbsvm.LinearModel:
    """Model from a bounded sample of labelled rows (see nbsvm.training_rows)."""
    text, y = nbsvm.training_rows(docs, labels, "quality", most_rows, most_chars)
    return nbsvm.fit(rows_of(Features(), text), y, CELLS)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= THRESHOLD), one row per row of docs.

    Only text is read for a score, as a whole. Empty and null texts get the score of the bias alone. Without labels of
    both kinds every text gets the smoothed frequency of label 1. Repeated rows are scored each.
    """
    return scored(docs, train(docs, labels), Features, THRESHOLD)
