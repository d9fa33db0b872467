"""Byte-level BPE encoding and decoding by replaying merges over a batch of distinct words.

`Codec.encode_pieces` keeps all words of a batch as one linked list of symbols and an inverted index from a merge's rank to
the positions whose pair it joins. Ranks leave a heap in order; each is applied at once to all of its positions, after which
only the pairs to the left and right of a merged symbol are looked up and indexed anew. Within a word this is the order in
which the pair of lowest rank, leftmost first, is merged, so the ids are those of the reference library.

Each distinct word is encoded once per worker until its cache, bounded in entries, is emptied; the bound affects time alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, columns, release, tidy

_LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
#: Texts of these characters alone may be split by the standard library's quicker engine, with the classes spelt out.
_PLAIN = re.compile(f"[\\t\\n\\r -~{_LETTER}«»¿¡–—‘’“”…€£§©®°]*")
_PLAIN_SPLIT = re.compile(f" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+")
_KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder for one vocabulary and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = _KNOWN_PATTERN):
        import regex

        self.ranks, self.cache = ranks, {}
        self._regex, self._plain = regex.compile(pattern), pattern == _KNOWN_PATTERN
        top = max(ranks.values(), default=-1) + 1
        words = [b""] * top
        for token, rank in ranks.items():
            words[rank] = token
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64) if top else np.zeros(0, np.int64)
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.byte = np.full(256, -1, np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte[token[0]] = rank
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        # An open-addressed table: a lookup costs one or two gathers rather than a binary search.
        self._bits = max(4, int(len(keys) * 4).bit_length())
        self._slots = np.full(1 << self._bits, -1, np.int64)
        self._values = np.full(1 << self._bits, -1, np.int64)
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        left = order
        slot = self._hash(keys)
        everyone = np.arange(256)
        mask = (1 << self._bits) - 1
        self._probes = 0
        while len(left):
            free = left[self._slots[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self._slots[slot[put]], self._values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & mask
            self._probes += 1
        self._first = self.pair_ranks(np.repeat(self.byte[everyone], 256), np.tile(self.byte[everyone], 256))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 where there is none."""
        keys = left << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        slot, out = self._hash(keys), np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self._probes):
            seen = self._slots[slot]
            hit = seen == keys[todo]
            out[todo[hit]] = self._values[slot[hit]]
            more = ~hit & (seen >= 0)
            if not more.any():
                break
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self._bits) - 1)
        return out

    def split(self, text: str) -> list[str]:
        if self._plain and _PLAIN.fullmatch(text):
            return _PLAIN_SPLIT.findall(text)
        return [m.group() for m in self._regex.finditer(text)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, packed as little-endian 32-bit integers, of distinct non-empty pieces."""
        done = [self.ranks.get(p) for p in pieces]
        todo = [i for i, r in enumerate(done) if r is None]
        out = [b"" if r is None else r.to_bytes(4, "little") for r in done]
        if not todo:
            return out
        data = np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)
        sizes = np.array([len(pieces[i]) for i in todo], np.int64)
        ends = np.cumsum(sizes)
        ids = self._replay(data, ends - sizes, ends)
        packed, bounds = ids[0].astype("<u4").tobytes(), (4 * ids[1]).tolist()
        for i, a, b in zip(todo, bounds, bounds[1:]):
            out[i] = packed[a:b]
        return out

    def _replay(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, symbol = len(data), self.byte[data]
        if (symbol < 0).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        symbol = np.append(symbol, -1)  # position n ends every word
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[begins] = n, n
        rank = np.full(n + 1, -1)
        rank[: n - 1] = self._first[data[:-1].astype(np.int64) << 8 | data[1:]]
        rank[ends - 1] = -1
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[rank[at] >= 0]
            if not len(at):
                return
            own = rank[at]
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            cuts = np.flatnonzero(np.diff(own)) + 1
            for r, part in zip(own[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(part)

        add(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                if (after[at[:-1]] == at[1:]).any():  # pairs that overlap, as in aaa: from the left, each symbol once
                    chosen, taken = [], -1
                    for p, q in zip(at.tolist(), after[at].tolist()):
                        if p != taken:
                            chosen.append(p)
                            taken = q
                    at = np.array(chosen)
            gone = after[at]
            beyond = after[gone]
            symbol[at], rank[gone], symbol[gone] = r, -1, -2
            after[at], before[beyond] = beyond, at
            left = before[at]
            left = left[left < n]
            touched = np.concatenate([left, at])
            rank[touched] = self.pair_ranks(symbol[touched], symbol[after[touched]])
            add(touched)
        alive = symbol[:n] >= 0
        return symbol[:n][alive], np.concatenate([[0], np.cumsum(alive)[ends - 1]])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.split(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        new = list(set().union(*split).difference(cache))
        if new:
            cache.update(zip(new, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])))
        return [b"".join(map(cache.__getitem__, pieces)) for pieces in split]

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str = _KNOWN_PATTERN) -> Codec:
    """This worker's codec for a vocabulary file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
        release()
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str = _KNOWN_PATTERN, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row of docs.

    A null or empty text has no tokens. Rows are independent of each other, so repeated rows give repeated results, an empty
    table gives none, and nothing is shuffled. Other columns of docs are ignored.
    """

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for i, j, _, _ in blocks(batch.column(1)):  # no more is held as words at once
                packed = own.encode_batch([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                arrays = [
                    batch.column(0).slice(i, j - i),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(own.decode(p)).hexdigest() for p in packed]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
                    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return columns(docs, "doc_id", "text").mapInArrow(tidy(run), schema)
