"""Toxicity scores from a lexicon matched with misspellings and weighed by context.

A lexicon of words and of word beginnings (stems) is learnt from labelled documents. Its tries are intersected with
Levenshtein automata of each term's error budget, and the product is made deterministic once, so that all words of a batch
step through one transition table together. A hit counts with the weight learnt for its term, how it was hit (exactly,
misspelt, by its stem, by its misspelt stem) and its context: within a window around the hit, quotation marks, words of reporting or
of mention mark a quotation, whose weight is learnt apart from that of abuse.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, columns, tidy

#: Labelled rows that the lexicon and its weights are fitted on, at most, of either class, chosen by a hash of the id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Toxic texts of the sample, no near copies, that a term of the lexicon is found in, at least.
LEAST_TEXTS = 8
#: Characters of text to each of two or more words that begin with a stem, at most, where they are dense.
DENSE = 1000
WINDOW = 48
#: Jaccard similarity of the sets of words from which on labelled texts are near copies.
NEAR_COPY = 0.6
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\w+")
#: Quotation marks and words of reporting or mention; an apostrophe between letters is no mark.
_REPORT = re.compile(r"[\"“”«»„]|(?<![^\W\d_])[‘’]|[‘’](?![^\W\d_])|\b(?:quote[ds]?|said|says|called|wrote|word|term|so-called|cited?|dijo|palabra|dit|mot|sagte|wort)\b")
EXACT, STEM, FUZZY, FUZZY_STEM = 0, 1, 2, 3
_UNSEEN_FUZZY = 3.4

_kind = np.zeros(0x110000, np.uint8)
_blank = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    """1 for code points that belong to words."""
    if not _kind[97]:
        _kind[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = 1
    return _kind


def _blanks() -> np.ndarray:
    """True for code points that part words: separators and control characters."""
    if not _blank[32]:
        _blank[[c for c in range(0x110000) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cc")]] = True
    return _blank


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """The deterministic product of the lexicon's tries with Levenshtein automata."""

    def __init__(self, words: list[str], stems: list[str]):
        self.terms = [*words, *stems]
        self.n_words = len(words)
        alphabet = sorted({c for t in self.terms for c in t})
        self.classes = {c: k + 2 for k, c in enumerate(alphabet)}  # 0: no letter, 1: any other letter
        tries = []  # (children, term at node, errors, is stem)
        for budget in (0, 1, 2):
            own = [(t, k) for k, t in enumerate(words) if errors_allowed(t) == budget]
            if own:
                tries.append((*self._trie(own), budget, False))
            own = [(t, self.n_words + k) for k, t in enumerate(stems) if errors_allowed(t) == budget]
            if own:
                tries.append((*self._trie(own), budget, True))
        self._tries = tries
        begin = self._close({(i, 0, 0) for i in range(len(tries))})
        states, todo = {frozenset(): 0, begin: 1}, [begin]
        table: list[list[int]] = [[0] * (len(alphabet) + 2)]
        letters = [None, *alphabet]
        while todo:
            state, row = todo.pop(0), [0]
            for c in letters:
                after = self._step(state, c)
                if after not in states:
                    states[after] = len(states)
                    todo.append(after)
                row.append(states[after])
            table.append(row)
        self.table = np.array(table, np.int32)
        ends = [self._verdict(s) for s in states]
        self.term = np.array([e[0] for e in ends], np.int32)
        self.how = np.array([e[1] for e in ends], np.int32)

    @staticmethod
    def _trie(terms):
        children, ends = [{}], [-1]
        for term, k in terms:
            node = 0
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = k
        return children, ends

    def _close(self, items: set) -> frozenset:
        """With the term's letters that the word may lack, and without items that others subsume."""
        best: dict[tuple, int] = {}
        todo = list(items)
        while todo:
            i, node, e = todo.pop()
            if e >= best.get((i, node), 9):
                continue
            best[i, node] = e
            if i < 0:
                continue
            children, ends, budget, stem = self._tries[i]
            if stem and ends[node] >= 0:
                todo.append((-1, ends[node], e))
            if e < budget:
                todo += [(i, child, e + 1) for child in children[node].values()]
        # A stem that is hit stays so: what can't become a better hit goes, so that states stay few.
        stems = [(2 * e + 1, node) for (i, node), e in best.items() if i < 0]
        found = min(stems) if stems else (99, 0)
        return frozenset((i, node, e) for (i, node), e in best.items() if ((2 * e + 1, node) == found if i < 0 else 2 * e + self._tries[i][3] <= found[0]))

    def _step(self, state: frozenset, c: str | None) -> frozenset:
        out = set()
        for i, node, e in state:
            if i < 0:
                out.add((i, node, e))
                continue
            children, _, budget, _ = self._tries[i]
            if c in children[node]:
                out.add((i, children[node][c], e))
            if e < budget:
                out.add((i, node, e + 1))
                out.update((i, child, e + 1) for child in children[node].values())
        return self._close(out)

    def _verdict(self, state: frozenset) -> tuple[int, int]:
        found = []
        for i, node, e in state:
            if i < 0:
                found.append((2 * e + 1, FUZZY_STEM if e else STEM, node))
            elif self._tries[i][1][node] >= 0 and not self._tries[i][3]:
                found.append((2 * e, FUZZY if e else EXACT, self._tries[i][1][node]))
        return (min(found)[2], min(found)[1]) if found else (-1, 0)

    def _run(self, own: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words that are hit, and their last states."""
        state, at, live = np.ones(len(begin), np.int32), begin.copy(), np.arange(len(begin))
        hit_word, hit_state = [live[:0]], [state[:0]]
        while len(live):
            state = self.table[state, own[at]]
            at += 1
            over = at == end[live]
            accepted = over & (self.term[state] >= 0)
            hit_word.append(live[accepted])
            hit_state.append(state[accepted])
            go = ~over & (state > 0)
            state, at, live = state[go], at[go], live[go]
        return np.concatenate(hit_word), np.concatenate(hit_state)

    def hits(self, texts: list[str]) -> list[tuple[int, int, int, int, bool]]:
        """(text, character, term, how, quoted) of every word that is hit; the characters are those of the lower-cased text."""
        if not self.terms:
            return []
        texts = [t.lower() for t in texts]
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lut = _letters().copy()
        for c, k in self.classes.items():
            lut[ord(c)] = k
        own = lut[codes]
        word = own > 0
        begin = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        end = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1 if len(word) else begin
        words, states = self._run(own, begin, end)
        # Up to three runs of letters with at most two other characters in all between them, none of them blank, are one word too: what stands inside costs an error.
        hit = np.zeros(len(begin) + 2, bool)
        hit[words] = True
        blank = np.concatenate([[0], np.cumsum(_blanks()[codes])])
        gap = np.full(len(begin) + 2, 9)
        if len(begin) > 1:
            gap[: len(begin) - 1] = np.where(blank[begin[1:]] == blank[end[:-1]], begin[1:] - end[:-1], 9)
        inside = np.where(own == 0, 1, own)
        for more in (1, 2):
            first = np.flatnonzero((sum(gap[k : k + len(begin)] for k in range(more)) <= 2) & ~np.any([hit[k : k + len(begin)] for k in range(more + 1)], axis=0)) if len(begin) else begin
            found, after = self._run(inside, begin[first], end[first + more])
            taken = set()
            for x, s in sorted(zip(first[found].tolist(), after.tolist())):
                if not taken & set(range(x, x + more + 1)):
                    taken |= set(range(x, x + more + 1))
                    end[x] = end[x + more]
                    hit[x : x + more + 1] = True
                    words, states = np.append(words, x), np.append(states, s)
        if not len(words):
            return []
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        out = []
        for w, s in sorted(zip(words.tolist(), states.tolist())):
            a, b = int(begin[w]), int(end[w])
            d = int(np.searchsorted(offsets, a, "right")) - 1
            text, a, b = texts[d], a - int(offsets[d]), b - int(offsets[d])
            quoted = bool(_REPORT.search(text[max(0, a - WINDOW) : a])) and bool(_REPORT.search(text[b : b + WINDOW]) or re.search(r"[\"“«„‘]\W*$", text[max(0, a - WINDOW) : a]))
            out.append((d, a, int(self.term[s]), int(self.how[s]), quoted))
        return out


def dense(n: int, size: int) -> bool:
    """Whether n words of a text of so many characters that begin with a stem mark it: what begins like a term also begins an innocent word now and then, and in long texts several."""
    return n > 1 and n * DENSE >= size


def kinds(hits: list[tuple], sizes: Sequence[int]) -> list[tuple[int, tuple[int, int, bool]]]:
    """(text, (term, how, quoted)) of each distinct kind of hit in texts of so many characters; a stem's hits are told apart: a single one, several thinly spread (+ 10) and dense ones (+ 20)."""
    number = Counter((d, term, how, quoted) for d, _, term, how, quoted in hits)
    return [(d, (term, how + (20 if dense(n, sizes[d]) else 10 if n > 1 else 0) if how == STEM else how, quoted)) for (d, term, how, quoted), n in sorted(number.items())]


@dataclass
class Model:
    """Lexicon, weights and prior log-odds; its size is bounded by the sample it is fitted on."""

    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weight: dict[tuple[int, int, bool], float] = field(default_factory=dict)
    bias: float = -2.0

    def matcher(self) -> Matcher:
        if "_matcher" not in self.__dict__:
            self._matcher = Matcher(self.words, self.stems)
        return self._matcher

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of each text's label: log-odds of the prior and of its distinct kinds of hits, added up."""
        total = np.full(len(texts), self.bias)
        for d, kind in kinds(self.matcher().hits(texts), [len(t) for t in texts]):
            total[d] += self.weight.get(kind, 0.0)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_matcher"}


def distinct(texts: Iterable[str], least: float = NEAR_COPY) -> list[int]:
    """The places of the texts that are no near copies of one before, so that a passage copied often gives evidence once.

    A near copy's set of words has a Jaccard similarity of `least` or more with that of a text that stays. Exact: two such
    sets share a word among the rarest of either, as many as the smallest overlap leaves room for, and all that do are compared.
    """
    sets = [np.unique(np.fromiter(map(hash_, set(_TOKEN.findall(t.lower()))), np.uint64)) for t in texts]
    if not sets:
        return []
    size = np.array([len(s) for s in sets])
    known, place, number = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sets = np.split(place.astype(np.int32), np.cumsum(size)[:-1])
    holders: dict[int, list[int]] = defaultdict(list)
    own_words = np.zeros(len(known), bool)
    chosen, blank = [], False
    for k, own in enumerate(sets):
        n = len(own)
        if not n:
            if not blank:
                chosen.append(k)
            blank = True
            continue
        rarest = own[np.lexsort((own, number[own]))][: n - math.ceil(least * n - 1e-9) + 1].tolist()
        near = np.unique(np.fromiter((x for w in rarest for x in holders.get(w, ())), np.int64))
        near = near[(size[near] >= least * n - 1e-9) & (size[near] * least <= n + 1e-9)]
        if len(near):
            own_words[own] = True
            both = np.add.reduceat(own_words[np.concatenate([sets[x] for x in near])].astype(np.int64), np.cumsum(size[near]) - size[near])
            own_words[own] = False
            if (both >= least * (n + size[near] - both) - 1e-9).any():
                continue
        chosen.append(k)
        for w in rarest:
            holders[w].append(k)
    return chosen


def hash_(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


class Decoded:
    """The texts of an Arrow array, each decoded when it is asked for, so that the sample is held once and as UTF-8."""

    def __init__(self, column: pa.ChunkedArray):
        self.column = column

    def __len__(self):
        return len(self.column)

    def __getitem__(self, k: int) -> str:
        return self.column[k].as_py()


def fit(texts: Sequence[str], toxic: list[int], rate: float) -> Model:
    """Learn lexicon and weights from labelled texts; rate is the share of toxic ones among all labelled rows.

    Without toxic or clean texts there is no lexicon and every score is the prior.
    """
    rate = min(max(rate, 0.001), 0.999)
    model = Model(bias=math.log(rate / (1 - rate)))
    counted = lambda t: Counter(_WORD.findall(t.lower()))
    words_of = lambda t: counted(t).keys()
    places = [[k for k, y in enumerate(toxic) if y == label] for label in (0, 1)]
    chosen = sorted(own[k] for own in places for k in distinct(texts[k] for k in own))
    positive = sum(toxic[k] for k in chosen)
    negative = len(chosen) - positive
    if not positive or not negative:
        return model
    least = LEAST_TEXTS
    seen = (Counter(), Counter())
    below: dict[tuple[str, bool], set[str]] = defaultdict(set)
    where: dict[tuple[str, bool], list[int]] = defaultdict(list)
    stems_of = lambda words: {w[:n] for w in words for n in range(4, min(len(w), 8))}

    def repeated(words: Counter, among: set[str], size: int) -> set[str]:
        """Stems that densely many words of a text of so many characters begin with."""
        n = Counter()
        for w, k in words.items():
            for stem in stems_of([w]) & among:
                n[stem] += k
        return {stem for stem, k in n.items() if dense(k, size)}

    positives = [k for k in chosen if toxic[k]]
    number = Counter(w for k in positives for w in words_of(texts[k]))
    most = Counter()  # of a stem's toxic texts: the sum over its words
    for w, n in number.items():
        for stem in stems_of([w]):
            most[stem] += n
    often = {stem for stem, n in most.items() if n >= least}
    del most
    for k in positives:
        seen[1].update((stem, True) for stem in repeated(counted(texts[k]), often, len(texts[k])))
    seen[1].update({(w, False): n for w, n in number.items() if len(w) > 2 and n >= least})
    del number
    frequent = {f for f, n in seen[1].items() if n >= least}
    whole, begun = ({t for t, stem in frequent if stem == kind} for kind in (False, True))
    for k in chosen:
        if not toxic[k]:  # only what toxic texts hold often enough is counted, so that memory follows the lexicon's candidates
            words = counted(texts[k])
            seen[0].update([*((w, False) for w in words.keys() & whole), *((stem, True) for stem in repeated(words, begun, len(texts[k])))])
    odds = lambda f: math.log((seen[1][f] + 0.5) / (positive + 1) / ((seen[0][f] + 0.5) / (negative + 1)))
    good = {f for f in frequent if odds(f) > 2 and 2 * seen[0][f] <= seen[1][f]}
    good_stems = {t for t, stem in good if stem}
    for k in positives:
        words = counted(texts[k])
        own = repeated(words, good_stems, len(texts[k]))
        for stem in own:
            where[stem, True].append(k)
        for w in words:
            if (w, False) in good:
                where[w, False].append(k)
            for stem in stems_of([w]) & own:
                below[stem, True].add(w)
    # A greedy cover: the term that explains most of the toxic texts left, less the clean ones that it hits; among equals a whole word, then the longest.
    left = {k for k in chosen if toxic[k]}
    candidates = {f: own for f, ks in where.items() if len(own := set(ks)) >= least and (not f[1] or len(below[f]) >= 3)}
    terms: list[tuple[str, bool]] = []
    while candidates:
        best = max(candidates, key=lambda f: (len(candidates[f]) - seen[0][f], not f[1], len(f[0]), f[0]))
        if len(candidates[best]) - seen[0][best] < max(2, least // 3):
            break
        terms.append(best)
        left -= candidates.pop(best)
        candidates = {f: ks for f, own in candidates.items() if len(ks := own & left) >= max(2, least // 3)}
    # Then what is as telling but seldom stands alone: not the stem of a term or a word that a stem covers.
    for f in sorted(good, key=lambda f: (-len(set(where[f])), f[1], -len(f[0]), f[0])):
        if len(set(where[f])) < 2 * least:
            break
        if f not in terms and seen[0][f] <= 0.02 * seen[1][f] and (not f[1] or len(below[f]) >= 3) and not any(stem and f[0].startswith(t) or f[1] and t.startswith(f[0]) for t, stem in terms):
            terms.append(f)
    model.words = [t for t, stem in terms if not stem]
    model.stems = [t for t, stem in terms if stem]
    count: dict[tuple[int, int, bool], list[int]] = defaultdict(lambda: [0, 0])
    for i in range(0, len(chosen), 500):
        part = chosen[i : i + 500]
        own = [texts[k] for k in part]
        for d, kind in kinds(model.matcher().hits(own), [len(t) for t in own]):
            count[kind][toxic[part[d]]] += 1
    for term in range(len(terms)):
        for how in (EXACT, STEM, STEM + 10, STEM + 20, FUZZY, FUZZY_STEM):
            for quoted in (False, True):
                clean, bad = count.get((term, how, quoted), (0, 0))
                if how in (FUZZY, FUZZY_STEM) and not bad:
                    w = 0.0 if clean or quoted else _UNSEEN_FUZZY if how == FUZZY else min(_UNSEEN_FUZZY, max(0.0, model.weight[term, STEM, False]))
                elif not bad and not clean:
                    w = 0.35 * model.weight.get((term, how, False), 0.0)  # a quotation never seen: a third of the weight of abuse
                else:
                    w = math.log((bad + 0.5) / (positive + 1) / ((clean + 0.5) / (negative + 1)))
                    if how in (FUZZY, FUZZY_STEM) and clean >= bad:
                        w = 0.0
                model.weight[term, how, quoted] = w
    return model


def train(docs: DataFrame, labels: DataFrame, usable) -> Model:
    """Fit on rows of labels (doc_id, toxic) for which the column usable, over doc_id, is true.

    At most SAMPLE_TOXIC and SAMPLE_CLEAN rows are gathered, those of least hash; the classes' rates come from all usable
    rows. Labels that are null or without a document are passed over, as are those of an id whose labels contradict each
    other; an id labelled alike several times counts once.
    """
    rows = columns(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & usable)
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    pick = lambda y, n: rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, SAMPLE_TOXIC).unionByName(pick(0, SAMPLE_CLEAN))  # 12,000 pairs of numbers: small enough to broadcast
    text = columns(docs, "doc_id", "text").where("text is not null and doc_id is not null")
    sample = text.join(F.broadcast(ids), "doc_id").toArrow() if total else None
    if sample is None or not sample.num_rows:
        return Model(bias=-2.0)
    order = np.lexsort((np.fromiter((hash_(t.as_py()) for t in sample["text"]), np.uint64), np.array(sample["doc_id"].to_pylist())))
    sample = sample.take(pa.array(order))
    return fit(Decoded(sample["text"].combine_chunks()), [int(y) for y in sample["toxic"].to_pylist()], counts.get(1, 0) / max(total, 1))


def _parts(batch: pa.RecordBatch, place: int):
    """Yield (rows, texts) of stretches of a batch with about BLOCK_BYTES bytes of text: no more is held as strings at once."""
    for i, j, _, _ in blocks(batch.column(place)):
        rows = batch.slice(i, j - i)
        yield rows, [t or "" for t in rows.column(place).to_pylist()]


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs: one narrow pass.

    A null or empty text has no hits and gets the prior. Repeated rows get equal scores; an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            for rows, texts in _parts(batch, 1):
                found = model.scores(texts)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return columns(docs, "doc_id", "text").mapInArrow(tidy(run), f"doc_id {key}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with their own columns, whose score is below the threshold; no shuffle.

    Rows are scored and handed on in stretches of BLOCK_BYTES, so that a task's memory doesn't follow the size of its batches.
    """
    place = docs.schema.names.index("text")

    def run(batches):
        for batch in batches:
            for rows, texts in _parts(batch, place):
                yield rows.filter(pa.array(model.scores(texts) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
