"""Byte-level BPE by batched numpy merge rounds.

Texts are cut at white space into chunks that no merge can cross. New chunks of a batch are split by the tokenizer's
pattern, their bytes become symbols of one flat array, and every round finds all adjacent pairs by binary search over the
sorted pair keys, takes the lowest rank of each word (`minimum.reduceat`) and merges its occurrences, for all words at
once. Encoded chunks are kept in a bounded table per worker.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from sylvan.llm.common import lean, parts, resident

#: Unicode white space, and the pattern of the byte-level vocabulary written with it.
WS = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: A chunk of letters with these behind it is the word and then the punctuation; FIRST may begin such a chunk.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
FIRST = frozenset(" abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Chunks kept per worker; the table is emptied beyond that.
KEPT = 600_000
#: Bytes of text encoded at a time.
BATCH = 4 << 20
NONE = np.iinfo(np.int64).max


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(same)]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder for a tokenizer file with a byte-level BPE model and optional added tokens."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        chars, vocab = byte_chars(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in token)
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.added = added
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.of_byte = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.of_byte[b] = vocab[c]
        self.size = len(self.bytes)
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.table: dict[str, bytes] = {}
        self.said: dict[str, str] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (non-empty byte strings)."""
        if not words:
            return []
        flat = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_flat, done_word = [], []
        while len(flat):
            key = np.append(flat[:-1] * self.size + flat[1:], -1)
            key[np.append(word[:-1] != word[1:], True)] = -1
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            low = np.minimum.reduceat(rank, first)
            ended = np.repeat(low == NONE, size)
            done_flat.append(flat[ended])
            done_word.append(word[ended])
            hit = (rank == np.repeat(low, size)) & ~ended
            # Of overlapping hits (a a a) every second one counts, from the left.
            where = np.flatnonzero(hit)
            begins = np.append(True, np.diff(where) != 1)[: len(where)]
            run = np.arange(len(where)) - np.maximum.accumulate(np.where(begins, np.arange(len(where)), 0))
            where = where[run % 2 == 0]
            flat[where] = self.merged[rank[where]]
            gone = ended
            gone[where + 1] = True
            flat, word = flat[~gone], word[~gone]
        flat, word = np.concatenate(done_flat or [flat]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return np.split(flat[order], np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks and keep them in the table."""
        if len(self.table) + len(chunks) > KEPT:
            self.table.clear()
            self.said.clear()
        if len(self.words) > KEPT:
            self.words.clear()
        simple, split = [], {}
        for c in chunks:
            w = c.rstrip(PUNCTUATION)
            if w[1:].isalpha() and w[0] in FIRST:
                simple.append((c, w, c[len(w) :]))
            else:
                split[c] = WORD.findall(c)
        need = {w for _, w, _ in simple}.union((p for _, _, p in simple), *split.values()) - {""}
        self.words[""] = b""
        new = list(need.difference(self.words))
        for i, j in parts([len(w) for w in new], 1 << 19):
            ids = self.merge([w.encode("utf-8", "surrogatepass") for w in new[i:j]])
            self.words.update(zip(new[i:j], (x.astype("<u4").tobytes() for x in ids), strict=True))
        word = self.words
        self.table.update((c, word[w] + word[p]) for c, w, p in simple)
        self.table.update((c, b"".join(map(word.__getitem__, ws))) for c, ws in split.items())
        self.said.update((c, ",".join(map(str, np.frombuffer(self.table[c], "<u4").tolist()))) for c in chunks)

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """For each whole text its ids, and the same ids in decimal joined by commas."""
        cut = [self.at_added.split(x) if self.at_added else [x] for x in texts]
        cut = [[p if k % 2 else CHUNK.findall(p) for k, p in enumerate(pieces)] for pieces in cut]
        need = set().union(*(p for pieces in cut for p in pieces[::2]))
        if new := need.difference(self.table):
            self.learn(new)
            if need.difference(self.table):
                self.learn(need)
        out = []
        for pieces in cut:
            raw, said = [], []
            for k, p in enumerate(pieces):
                if k % 2:
                    raw.append(np.uint32(self.added[p]).tobytes())
                    said.append(str(self.added[p]))
                elif p:
                    raw.append(b"".join(map(self.table.__getitem__, p)))
                    said.append(",".join(map(self.said.__getitem__, p)))
            out.append((np.frombuffer(b"".join(raw), "<u4"), ",".join(said)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encoded(docs: DataFrame, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids array<int> of every row of docs.

    vocabulary is the path of a tokenizer file on the driver, which sends the contents (fixed size) to the workers. Null
    text encodes as empty: no ids, digests of the empty string. Repeated rows and null doc_ids are encoded like others.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        t = resident(("bpe", spec.value), lambda: ByteBPE(spec.value))
        for b in batches:
            ids_col, texts = b.column(0), b.column(1)
            size, sha, back, all_ids = [], [], [], []
            for i, j in parts(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH):
                for ids, said in t.encode_batch([x or "" for x in texts[i:j].to_pylist()]):
                    size.append(len(ids))
                    sha.append(hashlib.sha256(said.encode()).hexdigest())
                    back.append(hashlib.sha256(t.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        all_ids.append(pa.array(ids.astype(np.int32)))
            cols = {"doc_id": ids_col, "n_tokens": pa.array(size, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if with_ids:
                at = pa.array(np.cumsum([0, *size]).astype(np.int32))
                cols["ids"] = pa.ListArray.from_arrays(at, pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(lean(run, keeps=True), schema)
