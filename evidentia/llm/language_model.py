"""Language-model scores of a hierarchical Pitman-Yor model.

Each word follows its predecessor: a context's restaurant serves the words seen after it, and all contexts share one parent,
the restaurant of all words, whose base is uniform over the vocabulary and one class of unknown words. A restaurant's tables
send one customer each to the parent. The seating is sampled by Gibbs: in every sweep the number of tables that serve a dish
is drawn from its full conditional given the state after the sweep before, with the seatings of that number summed out, first
in the context restaurants and then, for the customers that they send, in the parent. Sweeps follow one another, from one
table a dish on; the states after the first BURN_IN are kept, and their predictive probabilities averaged.

The number of seatings of c customers at t tables is a generalised Stirling number. For a discount of 1/2 it has a closed
form, so that the conditional of t, which has one mode, is drawn from exactly however many customers a dish has.

A corpus has nearly as many (context, word) pairs as words, so pairs never become rows. Texts are read in blocks; a block
sends the sorted hashes of its distinct pairs, cut by hash range into buckets, as one binary value a bucket, and
gets back, in the same order and without the hashes, the corpus's counts. The same is done for words. Every exchange is even
whatever words are frequent: a block names a pair once, and a hot pair is named by each block at most once.

    pass 1       pairs of a block -> pair buckets: counts c(u, w); one block of those that name a pair owns it
    pass 2       a block's words and its own pairs are kept, those of one token, which always has one table, as sums
    from these   owners: one table a pair -> word buckets: c(w), customers of the parent, tables of each context
    and these    owners: a sweep over the pairs' tables -> word buckets: the same, and a sweep over the parent's tables
    pass 3       every text is scored with the states' averaged predictive probabilities

A draw depends on the pair's hash, the sweep and the state alone, so that later sweeps, the scoring and repeated tasks go
through the same states without their being stored. Words are told apart by 62-bit hashes, pairs by 64-bit ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, columns, keep, mix, shared_dir, span_hashes, tidy, tokens

#: Discount of all restaurants (other values have no closed form), and strengths of context restaurants and of the parent.
DISCOUNT, STRENGTH, PARENT_STRENGTH = 0.5, 1.0, 10.0
#: Sweeps, and those of them from the start on whose states still tell of it and aren't averaged.
SWEEPS, BURN_IN = 4, 2
#: Share of a conditional's sum below which its terms are left out.
TAIL = 1e-9
#: Dishes drawn at once: their figures stay in the processor's cache.
STRETCH = 1 << 14
BLOCK_TEXT = 3 << 20
#: Bytes of text to a bucket; a bucket is gathered by one task.
BUCKET_TEXT = 16 << 20
END, START = np.uint64(1), np.uint64(2)


def pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0 as byte planes, as many as the largest needs, after a head of their number and that of the planes."""
    a = np.ascontiguousarray(a, np.uint64)
    planes = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return len(a).to_bytes(8, "little") + bytes([planes]) + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), 8)[:, :planes].T).tobytes()


def unpack(raw: bytes, figures: int) -> list[np.ndarray]:
    """That many packed arrays, one after the other."""
    out, at = [], 0
    for _ in range(figures):
        n, planes = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8]
        a = np.zeros((n, 8), np.uint8)
        a[:, :planes] = np.frombuffer(raw, np.uint8, n * planes, at + 9).reshape(planes, n).T
        out.append(a.view(np.uint64).reshape(-1))
        at += 9 + n * planes
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, 1)[0], dtype=np.uint64)


def sample_tables(c: np.ndarray, p: np.ndarray, others: np.ndarray, draw: np.ndarray, strength: float) -> np.ndarray:
    """Numbers of tables from their full conditionals: c customers of a dish of parent probability p, `others` tables of other dishes; draw: uniform.

    The weight of t tables is p^t * prod_{k < t} (strength + d * (others + k)) * S(c, t) with d = 1/2 and
    S(c, t + 1) / S(c, t) = 4 (c - t) / (t (2c - t - 1)). The ratio of neighbouring weights falls with t, so that terms are
    added up from the mode to both sides until they are below TAIL of the sum.
    """
    out = (c > 0).astype(np.int64)
    several = np.flatnonzero(c > 1)
    n, q, a, u = c[several].astype(float), 4 * DISCOUNT * p[several], strength / DISCOUNT + others[several], draw[several]
    mode, reach = _modes(n, q, a)
    order = np.argsort(reach, kind="stable")
    for i in range(0, len(several), STRETCH):
        at = order[i : i + STRETCH]
        out[several[at]] = _draw(n[at], q[at], a[at], u[at], mode[at])
    return out


def _ratio(t, n, q, a):
    return q * (a + t) * (n - t) / (t * (2 * n - 1 - t))


def _modes(n: np.ndarray, q: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first t whose ratio is below 1, from the root of a quadratic, and about how many terms its dish has, to draw dishes with like numbers of them together."""
    first = _ratio(1.0, n, q, a)
    mode, reach = np.ones(len(n)), 30 / (1 - np.log2(np.clip(first, 1e-9, 1)))
    high = np.flatnonzero(first >= 1)
    m, b, g = n[high], q[high], a[high]
    half = b * (m - g) - 2 * m + 1
    t = np.clip(np.floor(2 * b * g * m / (np.sqrt(half * half - 4 * (1 - b) * b * g * m) - half)), 1, m)
    off = np.arange(len(high))  # the root is rounded: steps to the first such t
    while len(off):
        off = off[(_ratio(t[off], m[off], b[off], g[off]) >= 1) & (t[off] < m[off])]
        t[off] += 1
    off = np.flatnonzero(t > 1)
    while len(off):
        off = off[_ratio(t[off] - 1, m[off], b[off], g[off]) < 1]
        t[off] -= 1
        off = off[t[off] > 1]
    mode[high], reach[high] = t, 30 + 14 * np.sqrt(t)
    return mode, np.minimum(np.minimum(reach, n), 65535).astype(np.uint16)


def _draw(n: np.ndarray, q: np.ndarray, a: np.ndarray, u: np.ndarray, mode: np.ndarray) -> np.ndarray:
    total, found = np.ones(len(n)), mode.copy()
    ends = [_walk(n, q, a, mode, side, total) for side in (1, -1)]
    left = u * total - 1
    for side, end in zip((1, -1), ends):
        _seek(n, q, a, mode, side, end, left, found)
    return found.astype(np.int64)


def _next(side: int, t, term, n, q, a):
    """The t after t on a side of the mode, and its term."""
    if side > 0:
        return t + 1, term * _ratio(t, n, q, a)
    return t - 1, term / _ratio(t - 1, n, q, a)


def _walk(n, q, a, mode: np.ndarray, side: int, total: np.ndarray) -> np.ndarray:
    """Add to total the terms, relative to the mode's, of all t above (side 1) or below (-1) it, until they are below TAIL of the sum; where each ends."""
    end = mode.copy()
    k = np.flatnonzero(mode < n if side > 0 else mode > 1)
    t, term, n, q, a, own = mode[k], np.ones(len(k)), n[k], q[k], a[k], total[k]
    while len(k):
        t, term = _next(side, t, term, n, q, a)
        own += term
        go = (term > TAIL * own) & (t < n if side > 0 else t > 1)
        if not go.all():
            stop, go = np.flatnonzero(~go), np.flatnonzero(go)
            end[k[stop]], total[k[stop]] = t[stop], own[stop]
            k, t, term, n, q, a, own = (x.take(go) for x in (k, t, term, n, q, a, own))
    return end


def _seek(n, q, a, mode: np.ndarray, side: int, end: np.ndarray, left: np.ndarray, found: np.ndarray) -> None:
    """Take the same terms off what is left of the draws, whose last t at which something was left is found."""
    k = np.flatnonzero((left >= 0) & (end != mode))
    t, term, n, q, a, end, own = mode[k], np.ones(len(k)), n[k], q[k], a[k], end[k], left[k]
    while len(k):
        t, term = _next(side, t, term, n, q, a)
        own -= term
        go = (own >= 0) & (t != end)
        if not go.all():
            stop, go = np.flatnonzero(~go), np.flatnonzero(go)
            found[k[stop]], left[k[stop]] = t[stop], own[stop]
            k, t, term, n, q, a, end, own = (x.take(go) for x in (k, t, term, n, q, a, end, own))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their first places and, for each key, its number among them: np.unique by one sort of packed integers."""
    bits = np.uint64(max(1, int(len(keys)).bit_length()))
    at = np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))
    at = at.astype(np.int64)
    ordered = keys[at]
    if (ordered[1:] < ordered[:-1]).any():  # keys that differ in the packed bits alone
        return np.unique(keys, return_index=True, return_inverse=True)
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
    number = np.empty(len(keys), np.int64)
    number[at] = np.cumsum(new) - 1
    return ordered[new], at[new], number


def uniform(keys: np.ndarray, sample: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x9E37 + sample)) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def pair_hashes(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(contexts * np.uint64(0xD6E8FEB86659FD93) + words)


class Block:
    """Words of some whole texts, as numbers of the block's sorted distinct words and pairs."""

    def __init__(self, number: int, ids: list, train: np.ndarray, words: np.ndarray, begins: np.ndarray):
        self.number, self.ids, self.train, self.begins = number, ids, train, begins
        sizes = np.diff(np.append(begins, len(words)))
        self.sizes, self.learn = sizes, np.repeat(train, sizes)
        before = np.concatenate([[START], words[:-1]]).astype(np.uint64)
        before[begins] = START
        self.words, _, number_of = distinct(np.append(words, START))
        self.word_of, self.start = number_of[:-1], int(number_of[-1])
        self.pairs, first, self.pair_of = distinct(pair_hashes(before, words))
        self.pair_word = self.word_of[first]
        context = np.concatenate([[self.start], self.word_of[:-1]])
        context[begins] = self.start
        self.pair_context = context[first]

    def counts(self, of: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of[self.learn], minlength=n)

    def word_counts(self) -> np.ndarray:
        """Learnt tokens of each word; of START, learnt texts."""
        out = self.counts(self.word_of, len(self.words))
        out[self.start] = int(self.train.sum())
        return out

    def digest(self) -> int:
        return int(mix(np.array([len(self.pairs), len(self.words)], np.uint64) + self.pairs[:1]).sum() & np.uint64((1 << 63) - 1))


def _read(batches):
    """Yield the blocks of a task's texts."""
    number, size, ids, train, parts, begins, n = 0, 0, [], [], [], [], 0
    for batch in batches:
        keys, flags = batch.column(0).to_pylist(), np.array([bool(x) for x in batch.column(1).to_pylist()])
        for i, j, data, offsets in blocks(batch.column(2)):
            data = LOWER[data]
            s, e, row = tokens(data, offsets)
            at = np.searchsorted(row, np.arange(j - i + 1))
            words = np.full(len(s) + j - i, END, np.uint64)
            words[np.arange(len(s)) + row] = span_hashes(data, s, e) | np.uint64(4)  # never END or START
            ids += keys[i:j]
            train.append(flags[i:j])
            parts.append(words)
            begins.append(at[:-1] + np.arange(j - i) + n)
            n += len(words)
            size += len(data)
            if size >= BLOCK_TEXT:
                yield Block(number, ids, np.concatenate(train), np.concatenate(parts), np.concatenate(begins))
                number, size, ids, train, parts, begins, n = number + 1, 0, [], [], [], [], 0
    if ids:
        yield Block(number, ids, np.concatenate(train), np.concatenate(parts), np.concatenate(begins))


_OWNED = "pid int, block int, digest bigint, words binary, figures binary"
_REQUEST = "pid int, block int, bucket int, digest bigint, keys binary, figures binary"
_REPLY = "pid int, block int, bucket int, digest bigint, figures binary"


def _requests(pid: int, number: int, digest: int, keys: np.ndarray, figures: list[np.ndarray], bits: int):
    cut = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
    bounds = [0, *cut.tolist(), len(keys)]
    out = {k: [] for k in ("bucket", "keys", "figures")}
    for b, (i, j) in enumerate(zip(bounds, bounds[1:])):
        if j > i:
            out["bucket"].append(b)
            out["keys"].append(pack_keys(keys[i:j]))
            out["figures"].append(b"".join(pack(f[i:j]) for f in figures))
    n = len(out["bucket"])
    return pa.RecordBatch.from_arrays(
        [pa.array([pid] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(out["bucket"], pa.int32()), pa.array([digest] * n, pa.int64()), pa.array(out["keys"], pa.binary()), pa.array(out["figures"], pa.binary())],
        names=["pid", "block", "bucket", "digest", "keys", "figures"],
    )


def _gathered(table: pa.Table, n: int, how: str = "sum"):
    """Sorted distinct keys, sums or maxima of n figures, and for each request the places of its keys; requests in order of block."""
    table = table.sort_by([("pid", "ascending"), ("block", "ascending")])
    keys = [unpack_keys(x) for x in table["keys"].to_pylist()]
    figures = [[f.view(np.int64) for f in unpack(raw, n)] for raw in table["figures"].to_pylist()]
    joined = np.concatenate(keys)
    known, _, place = distinct(joined)
    totals = []
    for i, kind in enumerate(how.split()):
        values = np.concatenate([f[i] for f in figures])
        if kind == "sum":
            totals.append(np.bincount(place, weights=values, minlength=len(known)).astype(np.int64))
        else:
            totals.append(np.zeros(len(known), np.int64))
            np.maximum.at(totals[-1], place, values)
    bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    return table, known, totals, [place[a:b] for a, b in zip(bounds, bounds[1:])], [f[0] for f in figures]


def _replies(table: pa.Table, figures: list[bytes]) -> pa.Table:
    return pa.table([*(table[c] for c in ("pid", "block", "bucket", "digest")), pa.array(figures, pa.binary())], names=["pid", "block", "bucket", "digest", "figures"])


def _pair_bucket(table: pa.Table) -> pa.Table:
    table, known, (total,), places, own = _gathered(table, 1)
    owned, out = np.zeros(len(known), bool), []
    for at, n in zip(places, own):
        mine = (n > 0) & ~owned[at]
        owned[at[mine]] = True
        out.append(pack(total[at] * 2 + mine))
    return _replies(table, out)


def _totals(bucket: int, values: list[int]) -> pa.Table:
    """A row with a bucket's own sums, of block -1."""
    return pa.table([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([bucket], pa.int32()), pa.array([0], pa.int64()), pa.array([np.array(values, np.int64).tobytes()], pa.binary())], names=["pid", "block", "bucket", "digest", "figures"])


def _word_bucket(vocabulary: int, tables_before: int, sweep: int):
    """A bucket's figures after a sweep: customers and tables of the parent for each word, and tables of its own context; in sweep 0, where tables are one each, also its number of tokens."""

    def run(table: pa.Table) -> pa.Table:
        table, words, figures, places, _ = _gathered(table, 3 if sweep else 4, "sum sum max" if sweep else "sum sum max sum")
        customers, tables, before = figures[:3]
        if sweep:
            base = np.full(len(words), 1 / (vocabulary + 1))
            parent = sample_tables(customers, base, np.maximum(tables_before - before, 0), uniform(words, 100 + sweep), PARENT_STRENGTH)
        else:
            parent = (customers > 0).astype(np.int64)
        real = words != START
        kept = [customers, tables, parent] + figures[3:]
        sums = [int(customers[real].sum()), int(parent[real].sum()), *([int(figures[3][real].sum()), int((figures[3][real] > 0).sum())] if not sweep else [])]
        out = [b"".join(pack(x[at]) for x in kept) for at in places]
        return pa.concat_tables([_replies(table, out), _totals(table["bucket"][0].as_py(), sums)])

    return run


def _fetch(root: str, pid: int, number: int, digest: int, n: int) -> list[np.ndarray]:
    """A block's replies, in the order of its keys."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
    table = ds.dataset(f"{place}/pid={pid}", filesystem=system, format="parquet").to_table(filter=ds.field("block") == number, columns=["bucket", "digest", "figures"], use_threads=False).sort_by("bucket")
    if any(d != digest for d in table["digest"].to_pylist()):
        raise ValueError("the texts of a task differ between passes: docs must be read alike each time")
    parts: list[list[np.ndarray]] = [[] for _ in range(n)]
    for raw in table["figures"].to_pylist():
        for part, figure in zip(parts, unpack(raw, n)):
            part.append(figure.view(np.int64))
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def _exchange(requests: DataFrame, bucket, name: str) -> tuple[str, list[int]]:
    """Run the buckets; the folder of their replies by task, and the sum of the buckets' own totals (none: an empty list)."""
    spark = requests.sparkSession
    root = shared_dir(spark, name)
    replies = requests.groupBy("bucket").applyInArrow(bucket, _REPLY)
    replies.repartition("pid").sortWithinPartitions("pid", "block", "bucket").write.partitionBy("pid").parquet(root)
    totals = spark.read.schema(_REPLY).parquet(root).where("pid = -1").select("figures").collect()  # one short row a bucket
    return root, sum(np.frombuffer(r["figures"], np.int64) for r in totals).tolist() if totals else []


def scores(docs: DataFrame, learn: Column, stable: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    The model learns from the rows for which `learn`, over doc_id, is true. A text's tokens are its words, A-Z lower-cased,
    and one end. score is the model's log10 probability of the text, an unknown word having the probability of the class of
    unknown words; base_score is that of words by smoothed frequency. A null or empty text has its end alone. Repeated rows
    are learnt from and scored each; a long text is never split. Without rows to learn from every word is unknown. Other
    columns are ignored; an empty table gives no rows.

    stable: docs is read from files and filtered or projected at most, so that every pass sees the same tasks; otherwise the
    texts are written to shared storage first. A pass that sees others fails.
    """
    spark = docs.sparkSession
    source = columns(docs, "doc_id", "text").select("doc_id", F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce("text", F.lit("")).alias("text"))
    if not stable:
        source = keep(source, "texts")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, math.ceil(math.log2(max(1, size / BUCKET_TEXT))))

    def name_pairs(batches):
        pid = TaskContext.get().partitionId()
        for b in _read(batches):
            yield _requests(pid, b.number, b.digest(), b.pairs, [b.counts(b.pair_of, len(b.pairs))], bits)

    pair_root, _ = _exchange(source.mapInArrow(tidy(name_pairs), _REQUEST), _pair_bucket, "pairs")

    def own_pairs(batches):
        pid = TaskContext.get().partitionId()
        for b in _read(batches):
            (reply,) = _fetch(pair_root, pid, b.number, b.digest(), 1)
            c, n = np.where(reply & 1, reply >> 1, 0), len(b.words)
            once, at = c == 1, np.flatnonzero(c > 1)
            figures = [b.word_counts(), np.bincount(b.pair_word[once], minlength=n), np.bincount(b.pair_context[once], minlength=n), c[at], b.pair_word[at], b.pair_context[at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid], pa.int32()), pa.array([b.number], pa.int32()), pa.array([b.digest()], pa.int64()), pa.array([pack_keys(b.words)], pa.binary()), pa.array([b"".join(map(pack, figures))], pa.binary())],
                names=["pid", "block", "digest", "words", "figures"],
            )

    owned = keep(source.mapInArrow(tidy(own_pairs), _OWNED), "owned")
    #: Of each sweep so far: the folder of its replies, customers and tables of the parent.
    rounds: list[tuple[str, int, int]] = []
    train_tokens = vocabulary = 0

    def served(state, k: int) -> np.ndarray:
        """The parent's predictive probability of each word of a block after sweep k."""
        customers, _, parent = state[k][:3]
        return (customers - DISCOUNT * parent + (PARENT_STRENGTH + DISCOUNT * rounds[k][2]) / (vocabulary + 1)) / (PARENT_STRENGTH + rounds[k][1])

    def states(pid: int, number: int, digest: int, c: np.ndarray, pairs: np.ndarray, word: np.ndarray, context: np.ndarray, sweeps: int):
        """([tables of pairs after each sweep], [figures of a block's words after each sweep but the last asked for])."""
        words = [_fetch(root, pid, number, digest, 3 if k else 4) for k, (root, _, _) in enumerate(rounds)]
        tables = [(c > 0).astype(np.int64)]
        for k in range(1, sweeps + 1):
            others = np.maximum(words[k - 1][1][context] - tables[-1], 0)
            tables.append(sample_tables(c, served(words, k - 1)[word], others, uniform(pairs, k), STRENGTH))
        return tables, words

    def name_words(sweep: int):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    pid, number, digest, keys = row["pid"], row["block"], row["digest"], unpack_keys(row["words"])
                    count, once, once_of, c, word, context = (x.view(np.int64) for x in unpack(row["figures"], 6))
                    tables, words = states(pid, number, digest, c, pair_hashes(keys[context], keys[word]), word, context, sweep)
                    n = len(keys)
                    before = words[-1][2] if sweep else np.zeros(n, np.int64)
                    figures = [once + np.bincount(word, tables[-1], n).astype(np.int64), once_of + np.bincount(context, tables[-1], n).astype(np.int64), before]
                    yield _requests(pid, number, digest, keys, figures if sweep else [*figures, count], bits)

        return run

    for sweep in range(SWEEPS + 1):
        bucket = _word_bucket(vocabulary, rounds[-1][2] if rounds else 0, sweep)
        root, totals = _exchange(owned.mapInArrow(tidy(name_words(sweep)), _REQUEST), bucket, f"words-{sweep}")
        if not sweep:
            train_tokens, vocabulary = totals[2:] or (0, 0)
        rounds = [*rounds, (root, *(totals[:2] or (0, 0)))]

    def score(batches):
        pid = TaskContext.get().partitionId()
        for b in _read(batches):
            (reply,) = _fetch(pair_root, pid, b.number, b.digest(), 1)
            c = reply >> 1
            tables, words = states(pid, b.number, b.digest(), c, b.pairs, b.pair_word, b.pair_context, SWEEPS)
            n = words[0][3]
            seen, mean = n[b.pair_context], np.zeros(len(b.pairs))
            for k in range(BURN_IN + 1, SWEEPS + 1):
                p = served(words, k)[b.pair_word]
                own = (c - DISCOUNT * tables[k] + (STRENGTH + DISCOUNT * words[k][1][b.pair_context]) * p) / (STRENGTH + seen)
                mean += np.where(seen > 0, own, p) / (SWEEPS - BURN_IN)
            known = n > 0
            base = np.log10((n + 1) / (train_tokens + vocabulary + 1))
            add = lambda x: np.add.reduceat(x, b.begins)  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b.ids, key_type),
                    pa.array(b.sizes.astype(np.int64)),
                    pa.array(add(known[b.word_of].astype(np.int64))),
                    pa.array(np.full(len(b.ids), train_tokens)),
                    pa.array(add(base[b.word_of])),
                    pa.array(add(np.log10(mean)[b.pair_of])),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    key_type, key = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(score), f"doc_id {key}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
