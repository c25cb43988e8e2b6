"""Order-preserving packing of documents into token windows by dynamic programming.

Cuts may fall at document ends (free), sentence ends (a small penalty) and, in long stretches without either, at regular
places (a larger penalty). With p the position of a cut and f its best cost,

    f(i) = penalty(i) + window - p(i) + min { f(j) + p(j) : p(i) - window <= p(j) < p(i) },

so a monotone queue over f(j) + p(j) gives each transition in amortised constant time.
"""

from __future__ import annotations

import gc
import operator
import os
import re
import zlib
from collections import deque
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sylvan.llm.common import lean, parts, resident

END_ID = 2
#: Tokens of padding that a cut is worth: at a sentence's end, elsewhere in a document.
SENTENCE, HARD = 8, 32
#: Least tokens between two sentence cuts; stretches of over 2 * STEP tokens without a cut get one every STEP.
GAP, STEP = 32, 64
#: Tokens that a task holds before it settles windows, and chunks kept per worker.
HELD, KEPT = 1 << 20, 1_000_000
BATCH = 2 << 20
#: str.split() also splits at these, which the tokenizer treats as text.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A line that is a word, which is one token's end and no more, with plain punctuation behind it.
SIMPLE = re.compile(f"^([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(PUNCTUATION)}]*)$", re.MULTILINE)
MARK = "\0"
NOT_SPACE = "\x1c\x1d\x1e\x1f"


class WordCodec:
    """Ids of the tokenizers library, with the ids of white-space separated chunks kept in a bounded table.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its chunks in turn.
    """

    def __init__(self, spec: str, kept: int = KEPT):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends_sentence, self.ends_word, self.is_mark = np.zeros((3, max(vocab.values()) + 1), bool)
        for token, i in vocab.items():
            self.ends_word[i] = token.endswith("</w>")
            self.ends_sentence[i] = token.removesuffix("</w>")[-1:] in {".", "!", "?"}
        self.table: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        (mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.is_mark[mark] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn_units(self, units: list[str], between: str, marks: np.ndarray, own: int) -> None:
        """Encode units as few texts, which costs far less than one by one. marks: ids that stand once behind each unit (own 0)
        or are its last ones (own 1)."""
        for i, j in parts([len(x) for x in units], 1 << 20):
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(units[i:j])], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(marks[ids])
            begin, end = np.append(0, at + 1), np.append(at + own, len(ids))
            if own:
                begin, end = begin[:-1], end[:-1]
            raw = ids.tobytes()
            self.units.update(zip(units[i:j], (raw[a:b] for a, b in zip((4 * begin).tolist(), (4 * end).tolist(), strict=True)), strict=True))

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks and keep them. A word with plain punctuation behind it is the word's ids and the punctuation's."""
        found = SIMPLE.findall("\n".join(chunks))
        words, behind = (list(x) for x in zip(*found, strict=True)) if found else ([], [])
        simple = list(map(operator.add, words, behind))
        whole = chunks.difference(simple) if len(simple) < len(chunks) else set()
        words = "\n".join(words).lower().split("\n") if words else []
        if len(self.units) + len(need := set(words).union(behind, whole) - {""}) > self.kept:
            self.units.clear()
        self.units[""] = b""
        new = need.difference(self.units)
        plain = list(new.intersection(words))
        new.difference_update(plain)
        odd = [x for x in new if MARK in x]
        self.units.update(zip(odd, self._ids(odd), strict=True))
        self._learn_units(plain, " ", self.ends_word, 1)
        # With a chunk in between that none of them holds.
        self._learn_units([x for x in new if MARK not in x], f" {MARK} ", self.is_mark, 0)
        get = self.units.__getitem__
        self.table.update(zip(simple, map(operator.add, map(get, words), map(get, behind)), strict=True))
        self.table.update(zip(whole, map(get, whole), strict=True))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        # Many small objects and no cycles: the collector would only walk through them, again and again.
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode_batch(texts)
        finally:
            if on:
                gc.enable()

    def _encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [None if any(map(x.__contains__, NOT_SPACE)) else x.split() for x in texts]
        got = [None if c is None else list(map(self.table.get, c)) for c in cut]
        # No chunk is without ids, so what is missing is what is false.
        gone = [[] if g is None else list(compress(count(), map(operator.not_, g))) for g in got]
        new = set().union(*(map(c.__getitem__, at) for c, at in zip(cut, gone, strict=True) if at))
        if len(self.table) + len(new) > self.kept:
            self.table.clear()
        self.learn(new)
        out = []
        for x, c, g, at in zip(texts, cut, got, gone, strict=True):
            for i in at:
                g[i] = self.table[c[i]]
            raw = self._ids([x])[0] if c is None else b"".join(g)
            out.append(np.frombuffer(raw, "<u4"))
        return out


def cut_windows(position: list[int], penalty: list[int], window: int) -> list[int]:
    """Best cuts, as indexes of `position` from the first to the last; neighbours must be at most `window` apart."""
    g, back, queue = [position[0]], [0], deque([0])
    for i in range(1, len(position)):
        p = position[i]
        while position[queue[0]] < p - window:
            queue.popleft()
        j = queue[0]
        back.append(j)
        cost = g[j] + window + penalty[i]  # f(i) + p(i)
        g.append(cost)
        while queue and g[queue[-1]] >= cost:
            queue.pop()
        queue.append(i)
    cuts, i = [len(position) - 1], len(position) - 1
    while i:
        i = back[i]
        cuts.append(i)
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may fall and their penalties. ends: the documents' ends in ids, the last one len(ids)."""
    at = np.flatnonzero(sentence[ids]) + 1
    at = at[np.append(True, np.diff(at // GAP) > 0)] if len(at) else at
    cost = np.full(len(ids) + 1, -1, np.int16)
    cost[at] = SENTENCE
    cost[ends] = 0
    cost[0] = 0
    place = np.flatnonzero(cost >= 0)
    if window < 2 * STEP:
        cost[cost < 0] = HARD
    for k in np.flatnonzero(np.diff(place) > 2 * STEP).tolist():
        more = cost[place[k] + STEP : place[k + 1] - STEP // 2 : STEP]
        more[more < 0] = HARD
    place = np.flatnonzero(cost >= 0)
    return place, cost[place]


class Packer:
    """Windows over a stream of documents. add() and finish() return settled windows: lists of (doc, start, stop, ids)."""

    def __init__(self, sentence: np.ndarray, window: int):
        self.sentence, self.window = sentence, window
        self.docs: list[tuple[int, int, np.ndarray]] = []  # document, its ids before these, ids
        self.held = 0

    def add(self, doc: int, ids: np.ndarray) -> list:
        self.docs.append((doc, 0, ids))
        self.held += len(ids)
        return self._settle(False) if self.held >= HELD else []

    def finish(self) -> list:
        return self._settle(True) if self.held else []

    def _settle(self, last: bool) -> list:
        ids = np.concatenate([x[2] for x in self.docs])
        ends = np.cumsum([len(x[2]) for x in self.docs])
        place, cost = candidates(ids, ends, self.sentence, self.window)
        cuts = place[cut_windows(place.tolist(), cost.tolist(), self.window)].tolist()
        if not last:
            cuts = cuts[:-1] if len(cuts) > 2 else cuts
        else:
            # A last window far from full is dealt into lengths that need no padding, if that costs less.
            size, at = cuts[-1] - cuts[-2], cuts.pop()
            bits = [1 << b for b in range(size.bit_length()) if size >> b & 1]
            if len(bits) > 1 and HARD * (len(bits) - 1) < self.window - size:
                for b in sorted(bits, reverse=True)[:-1]:
                    cuts.append(cuts[-1] + b)
            cuts.append(at)
        out, k, begins = [], 0, 0  # begins: where document k begins in ids
        for s, e in zip(cuts, cuts[1:], strict=False):
            window = []
            while k < len(self.docs) and begins < e:
                doc, before, own = self.docs[k]
                i, j = max(s, begins) - begins, min(e, begins + len(own)) - begins
                if j > i:
                    window.append((doc, before + i, before + j, own[i:j]))
                if begins + len(own) > e:
                    break
                begins += len(own)
                k += 1
            out.append(window)
        rest = []
        if k < len(self.docs):
            doc, before, own = self.docs[k]
            i = cuts[-1] - begins
            rest = [(doc, before + i, own[i:])] * (i < len(own)) + self.docs[k + 1 :]
        self.docs, self.held = rest, sum(len(x[2]) for x in rest)
        return out


def packed(docs: DataFrame, vocabulary: str, window: int = 4096, with_ids: bool = False, kept: int = KEPT, batch: int = BATCH) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids array<int> if with_ids.

    A document is its ids and then END_ID, so null and empty texts are one id. Documents are packed in the order of their
    rows within each partition, so nothing is shuffled; sequence_id holds the partition and a running number. Repeated
    rows and null doc_ids are packed like others; an empty table gives no piece. vocabulary is a tokenizer file's path on
    the driver. A task holds about HELD tokens, or one document if that is longer. kept (chunks in a worker's table) and
    batch (bytes encoded at a time) trade memory for time and change no row.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        c = resident(("packing", kept, spec.value), lambda: WordCodec(spec.value, kept))
        packer = Packer(c.ends_sentence, window)
        number = TaskContext.get().partitionId() << 33
        known: dict[int, tuple] = {}  # open documents: doc_id, tokens
        n = 0

        def rows(windows):
            nonlocal number
            out = []
            for w in windows:
                offset = 0
                for doc, i, j, ids in w:
                    doc_id, size = known[doc]
                    out.append((doc_id, i, j - i, zlib.crc32(ids.tobytes()), size, number, offset, ids if with_ids else None))
                    offset += j - i
                    if j == size:
                        del known[doc]
                number += 1
            if out:
                cols = [*zip(*out, strict=True)]
                arrays = [pa.array(x, pa.int64()) for x in cols[:7]]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1)
            for i, j in parts(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), batch):
                for doc_id, ids in zip(doc_ids[i:j], c.encode_batch([x or "" for x in texts[i:j].to_pylist()]), strict=True):
                    ids = np.append(ids, np.uint32(END_ID))
                    known[n] = doc_id, len(ids)
                    yield from rows(packer.add(n, ids))
                    n += 1
        yield from rows(packer.finish())

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{x} long" for x in names[:7]) + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(lean(run, keeps=True), schema)
