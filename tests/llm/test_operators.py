"""Each operator on small fixtures against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import byte_bpe, chat, decontaminate, fingerprints, language_model, near_duplicates, queries, substrings, token_counts, toxicity, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, label string, part int"


def odd(spark):
    """Rows with nulls, empties, a long text, ties, repeats, and columns named as operators name their own."""
    word = lambda k: " ".join(f"w{(i * 7919 + k) % 5003}" for i in range(60))
    rows = [(1, word(1)), (2, word(1)), (3, word(1) + " more"), (4, None), (5, ""), (6, "  \t"), (7, "one"), (8, "one"), (9, "two three"), (9, "two three"), (None, word(1)), (None, None), (10, word(9) * 200), (11, "é日本😀 naïve ½ 'll")]
    return spark.createDataFrame([(i, t, None, "s", None, 1, "x", 2) for i, t in rows], SCHEMA)


def empty(spark):
    return odd(spark).limit(0)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def brute_components(rows, similarity=80):
    sets = {i: (set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()) for i, t in rows for w in [words(t)]}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= similarity * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(documents(spark)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_odd_rows(spark):
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(odd(spark)).collect())
    assert got == sorted([(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 7, False), (9, 9, True), (9, 9, True), (0, None, True), (0, None, True), (10, 10, True), (11, 11, True)], key=lambda r: (r[0], str(r[1])))
    assert near_duplicates.near_duplicates(empty(spark)).count() == 0
    kept = near_duplicates.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 7, 9, 10, 11]


def test_near_duplicates_in_crowded_buckets(spark):
    """Templates whose texts share most words but are unlike, chains of links, groups of copies, and sets of very different size."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    template = [word() for _ in range(70)]
    rows = []
    for k in range(150):  # about 0.55 similar to each other
        own = list(template)
        for at in rng.sample(range(70), 11):
            own[at] = word()
        rows.append((k, " ".join(own)))
    chain = [word() for _ in range(60)]
    for k in range(12):
        rows.append((1000 - k, " ".join(chain)))
        chain[5 * k] = word()
    rows += [(2000 + k, " ".join(template[:20])) for k in range(30)] + [(3000 + k, " ".join(word() for _ in range(40))) for k in range(40)]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert got == want and len({c for _, c in want.values()}) > 150 and want[1000][1] == 989


def test_near_duplicates_shared_buckets(spark):
    """Buckets of several ids, of ids with several sets too, from one shuffle of all bands."""
    rng = random.Random(4)
    rows = [(k // 2, [rng.randrange(60) + 60 * b for b in range(4)]) for k in range(80)] + [(90, [7, 1000]), (91, [1001, 1000]), (92, [2000]), (92, [2000])]
    df = near_duplicates._shared_buckets(spark.createDataFrame(rows, "id long, bands array<long>"))
    ids = {}
    for i, own in rows:
        for b in own:
            ids.setdefault(b, set()).add(i)
    assert sorted(map(tuple, df.collect())) == sorted((b, i) for b, found in ids.items() if len(found) > 1 for i in found)
    ran = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert ran.count("ShuffleQueryStage") == 2 and ran.count("ReusedExchange") == 1


def test_signature_estimates():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        a = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
        x, y = near_duplicates.signatures([a[:3600], a[400:]])
        errors.append(near_duplicates.estimate(x, y) - (len(a) - 800) / len(a))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.2 * (0.16 / 128) ** 0.5 * 1.2


def test_language_model_base_and_mass(spark):
    got = queries.op2_language_model(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    seen = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words(t), None])
    total, distinct = sum(seen.values()), len(seen)
    assert len(got) == len(texts)
    for r in got:
        own = [*words(texts[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(seen[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in own), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.95


def test_language_model_against_brute_force(spark):
    """The whole model in dictionaries, from the same draws: scores are equal, and every context's probabilities add up to one."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("aaaabbbccddefgh") for _ in range(rng.randint(0, 30)))) for i in range(160)] + [(500, "a a a b zzz a"), (501, None), (502, "zzz yyy")]
    learn = [words(t) for i, t in rows if i < 120]
    number = lambda w: language_model.START if w == "start" else language_model.END if w is None else np.uint64(language_model.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] | np.uint64(4))
    pair = lambda u, w: language_model.mix(np.array([number(u)]) * np.uint64(0xD6E8FEB86659FD93) + np.array([number(w)]))
    count = Counter((u, w) for own in learn for u, w in zip(["start", *own], [*own, None]))
    context = Counter()
    for (u, _), c in count.items():
        context[u] += c
    vocabulary = sorted({w for _, w in count}, key=str)
    one = lambda x: np.array([x])
    d, size = language_model.DISCOUNT, len(vocabulary)
    tables = dict.fromkeys(count, 1)
    customers = Counter(w for _, w in count)
    parent = dict.fromkeys(customers, 1)
    seen = {}
    for sweep in range(1, language_model.SWEEPS + 1):
        served = lambda w: (customers[w] - d * parent.get(w, 0) + (language_model.PARENT_STRENGTH + d * sum(parent.values())) / (size + 1)) / (language_model.PARENT_STRENGTH + sum(customers.values()))  # noqa: E731,B023
        of = Counter()
        for (u, _), t in tables.items():
            of[u] += t
        tables = {(u, w): int(language_model.sample_tables(one(c), one(served(w)), one(of[u] - tables[u, w]), language_model.uniform(pair(u, w), sweep), language_model.STRENGTH)[0]) for (u, w), c in count.items()}
        customers = Counter()
        for (_, w), t in tables.items():
            customers[w] += t
        all_parent = sum(parent.values())
        parent = {w: int(language_model.sample_tables(one(customers[w]), one(1 / (size + 1)), one(all_parent - parent[w]), language_model.uniform(one(number(w)), 100 + sweep), language_model.PARENT_STRENGTH)[0]) for w in vocabulary}
        of = Counter()
        for (u, _), t in tables.items():
            of[u] += t
        probability = lambda u, w: served(w) if not context[u] else (count[u, w] - d * tables.get((u, w), 0) + (language_model.STRENGTH + d * of[u]) * served(w)) / (language_model.STRENGTH + context[u])  # noqa: E731,B023
        for u in [*context, b"zzz"]:
            assert math.isclose(sum(probability(u, w) for w in [*vocabulary, b"zzz"]), 1, rel_tol=1e-9)
        if sweep > language_model.BURN_IN:
            for _, t in rows:
                for u, w in zip(["start", *words(t)], [*words(t), None]):
                    seen[u, w, sweep] = probability(u, w)
    kept = range(language_model.BURN_IN + 1, language_model.SWEEPS + 1)
    got = {r["doc_id"]: r["score"] for r in language_model.scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 120).collect()}
    for i, t in rows:
        want = sum(math.log10(sum(seen[u, w, k] for k in kept) / len(kept)) for u, w in zip(["start", *words(t)], [*words(t), None]))
        assert math.isclose(got[i], want, rel_tol=1e-9), i


def test_language_model_is_past_its_start(spark, monkeypatch):
    """Held-out texts' mean log10 probability of a token is that of a chain three times as long: two sweeps without a burn-in are 0.001 off."""
    mean = lambda: next(r["s"] / r["n"] for r in queries.op2_language_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).collect())
    own = mean()
    monkeypatch.setattr(language_model, "SWEEPS", 12)
    monkeypatch.setattr(language_model, "BURN_IN", 6)
    assert abs(own - mean()) < 5e-4


def test_language_model_reads_texts_in_three_passes(spark, monkeypatch):
    """Pairs, owned pairs and scores; sweeps, however many, go over what the second pass kept."""
    docs, read, run = odd(spark), [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, *x, **y: (read.append("text" in df.columns), run(df, *x, **y))[1])
    assert language_model.scores(docs, F.lit(True)).count() == 14
    assert sum(read) == 3 and len(read) == 3 + language_model.SWEEPS + 1


def test_language_model_odd_rows(spark):
    got = language_model.scores(odd(spark), F.col("doc_id").isNotNull()).collect()
    assert len(got) == 14 and all(math.isfinite(r["score"]) for r in got)
    assert language_model.scores(empty(spark), F.lit(True)).count() == 0
    assert all(r["n_known"] == 0 for r in language_model.scores(odd(spark), F.lit(False)).collect())


def seatings(c, d):
    """Weights S(c, t) of all seatings of c customers at t tables, by seating them one after the other in every way."""
    found = Counter({(1,): 1.0})
    for _ in range(c - 1):
        more = Counter()
        for sizes, w in found.items():
            for k, n in enumerate(sizes):
                more[sizes[:k] + (n + 1,) + sizes[k + 1 :]] += w * (n - d)
            more[(*sizes, 1)] += w
        found = more
    out = Counter()
    for sizes, w in found.items():
        out[len(sizes)] += w
    return out


@pytest.mark.parametrize(("c", "p", "others", "strength"), [(2, 0.1, 10, 1.0), (3, 0.6, 0, 1.0), (6, 0.3, 2, 5.0), (7, 1e-4, 1000, 1.0), (40, 0.2, 3, 1.0), (5000, 0.01, 20000, 10.0)])
def test_sampler_draws_from_the_exact_conditional(c, p, others, strength):
    d, log_s = 0.5, [0.0] * (c + 1)
    for t in range(2, c + 1):
        log_s[t] = log_s[t - 1] + math.log(4 * (c - t + 1) / ((t - 1) * (2 * c - t)))
    if c < 8:
        brute = seatings(c, d)
        assert all(math.isclose(math.exp(log_s[t]), brute[t] / brute[1], rel_tol=1e-9) for t in brute)
    logs = [log_s[t] + t * math.log(p) + sum(math.log(strength + d * (others + k)) for k in range(t)) if t < 4000 else -math.inf for t in range(1, c + 1)]
    weights = np.exp(np.array(logs) - max(logs))
    weights /= weights.sum()
    n = 40000
    draw = (np.arange(n) + 0.5) / n  # evenly spread: frequencies follow the distribution closely
    got = np.bincount(language_model.sample_tables(np.full(n, c), np.full(n, p), np.full(n, float(others)), draw, strength), minlength=c + 1)[1:] / n
    assert np.abs(got - weights).sum() < 0.01 * (1 + (weights > 1e-6).sum() / 20)


def test_sampler_draws_frequent_dishes_together(monkeypatch):
    """A few frequent dishes among many rare ones don't make every stretch as long as theirs, and each dish is drawn as if alone."""
    rng, calls, ratio = np.random.default_rng(4), [], language_model._ratio
    c = rng.integers(2, 6, 200_000)
    c[::5000] = 10**6
    p, others, draw = np.where(c > 5, 0.2, 1e-4), rng.integers(0, 500, len(c)), rng.random(len(c))
    alone = lambda at: language_model.sample_tables(c[at], p[at], others[at], draw[at], 1.0)
    some = np.append(np.arange(0, len(c), 5000), np.arange(1, 60))
    want = [alone(np.array([at]))[0] for at in some]
    monkeypatch.setattr(language_model, "_ratio", lambda *x: (calls.append(len(np.atleast_1d(x[0]))), ratio(*x))[1])
    alone(np.arange(0, len(c), 5000))
    frequent = len(calls)
    assert (alone(np.arange(len(c)))[some] == want).all()
    assert len(calls) - frequent < 2 * frequent


def test_sampler_starts_at_the_mode():
    rng = np.random.default_rng(6)
    n, q, a = np.exp(rng.uniform(0.7, 7, 3000)).astype(int).astype(float), 2 * np.append(10 ** rng.uniform(-6, 0, 2990), np.full(10, 0.5)), 2 + np.floor(np.exp(rng.uniform(0, 12, 3000)))
    modes, _ = language_model._modes(n, q, a)
    for mode, *own in zip(modes, n, q, a):
        t = np.arange(1, own[0] + 1)
        assert mode == t[language_model._ratio(t, *own) < 1][0]


def test_byte_bpe_equals_library(spark):
    import tiktoken

    path, pattern = queries.tokenizer()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    rows = documents(spark).select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text")).unionByName(spark.createDataFrame([(500, "aaaaaaa" * 40), (501, " " * 99), (502, "x\x1c²Ⅷ\x85 \n\n")], "doc_id long, text string"))
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.encode_documents(rows, path, pattern).collect())
    want = []
    for r in rows.collect():
        ids = own.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"] or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.encode_documents(empty(spark), path, pattern).count() == 0


def test_byte_bpe_of_a_vocabulary_whose_parts_come_late():
    ranks = {bytes([c]): c for c in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"aa": 259, b"abcd": 260, b"cd": 261}
    import tiktoken

    lib, own = tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}), byte_bpe.Codec(ranks, r"\S+|\s+")
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabcd ") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts)] == [lib.encode_ordinary(t) for t in texts]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_toxicity(spark, sf).collect()
    assert len(rows) == len(docs)
    got = [(labels[r["doc_id"]], r["predicted"], docs[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    hit = sum(a and b for a, b, _ in got)
    assert hit / sum(b for _, b, _ in got) > 0.95 and hit / sum(a for a, _, _ in got) > 0.9
    for lang in ("en", "de", "fr", "es"):  # labels of texts without any telling word included
        assert sum(a and b for a, b, x in got if x == lang) / sum(a for a, _, x in got if x == lang) > 0.9, lang


def test_toxicity_labels_that_contradict_each_other(spark):
    docs = spark.createDataFrame([(i, f"w{i} {'moron' if i < 40 else 'fine'}") for i in range(200)], "doc_id long, text string")
    labels = [(i, int(i < 40)) for i in range(200)] + [(i, 1) for i in range(100, 150)] + [(0, 1), (None, 1), (7, None)]
    want = toxicity.train(docs, spark.createDataFrame([r for r in labels if r[0] is not None and not 100 <= r[0] < 150], "doc_id long, toxic int"), F.lit(True))
    got = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert got.words == want.words == ["moron"] and got.bias == want.bias and got.weight == want.weight


def test_toxicity_apostrophes_are_no_quotation_marks():
    m = toxicity.Matcher(["moron"], [])
    assert [h[4] for h in m.hits(["don’t be a moron, it’s l’idée", "‘a moron’ said he", "a “moron” was the word"])] == [False, True, True]


def test_toxicity_only_near_copies_collapse():
    rng = random.Random(7)
    texts = [f"the {' '.join(f'w{rng.randrange(60)}' for _ in range(rng.randint(0, 12)))}" for _ in range(300)] + ["", "", "!"]
    texts += [t + " tail" for t in texts[:40]]
    sets, want = [set(t.split()) - {"!"} for t in texts], []
    for k, own in enumerate(sets):
        if not any(own == sets[x] or 10 * len(own & sets[x]) >= 6 * len(own | sets[x]) for x in want):
            want.append(k)
    assert toxicity.distinct(texts) == want and len(want) > 100
    # Texts that share their short words, and little else, are evidence of their own.
    model = toxicity.fit([f"x{i}a y{i}b z{i}c u{i}d moron v{i}e w{i}f" for i in range(30)] + [f"x{i}g y{i}h clean z{i}i" for i in range(300)], [1] * 30 + [0] * 300, 0.1)
    assert "moron" in model.words and model.scores(["that moron"])[0] >= 0.7


def test_toxicity_learns_rare_terms_of_large_tables(spark):
    rng = random.Random(11)
    own = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(8))
    rows = [(i, f"{own()} {'vermin' if i % 230 == 0 else 'moron'}", 1) for i in range(3800)] + [(i, own(), 0) for i in range(3800, 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert {"moron", "vermin"} <= set(toxicity.train(docs, docs, F.lit(True)).words)


def test_toxicity_matcher_against_edit_distance():
    m = toxicity.Matcher(["pathetic", "moron"], ["vequ"])
    rng = random.Random(5)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(b):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for _ in range(400):
        w = list(rng.choice(["pathetic", "moron", "vequabc", "hello"]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "o"])
        w = "".join(w)
        want = [k for k, t in enumerate(["pathetic", "moron"]) if distance(w, t) <= toxicity.errors_allowed(t)] + [2] * w.startswith("vequ")
        got = [h[2] for h in m.hits([w])]
        assert bool(got) == bool(want) and set(got) <= set(want), w


def test_toxicity_misspelt_stems_and_symbols_in_words():
    def prefix_distance(a, b):
        """The least edit distance of a and a beginning of b."""
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, d in enumerate(b):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    m, rng = toxicity.Matcher(["pathetic"], ["morond", "vequ"]), random.Random(8)
    for _ in range(600):
        w = list(rng.choice(["morondly", "vequabc", "morondisch", "hello"]))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "o"])
        w = "".join(w)
        want = [k for k, t in ((1, "morond"), (2, "vequ")) if prefix_distance(t, w) <= toxicity.errors_allowed(t)]
        got = [h[2] for h in m.hits([w])]
        assert bool(got) == bool(want) and set(got) <= set(want), w
    m = toxicity.Matcher(["idiot", "moron", "disgusting"], [])
    at = lambda t: [(h[1], m.terms[h[2]]) for h in m.hits([t])]
    assert at("an id1ot, m*ron") == [(3, "idiot"), (10, "moron")] and at("d!sgust*ng my-mor0n") == [(0, "disgusting"), (14, "moron")]
    assert at("moron-like,idiot") == [(0, "moron"), (11, "idiot")] and at("id ot m\nron id\u00a0ot m0r0n") == []


def test_toxicity_odd_rows_and_quotes(spark):
    own = lambda k, n: " ".join("".join(chr(97 + int(c)) for c in str(1000 * k + 7 * m)) for m in range(n))
    model = toxicity.fit([own(k, 5) + " moron " + own(500 + k, 5) for k in range(1, 31)] + [own(2000 + k, 9) for k in range(300)], [1] * 30 + [0] * 300, 0.1)
    assert [s >= 0.7 for s in model.scores(["that moron", "", "he said \"moron\" was the word", "moronn"])] == [True, False, False, True]
    assert toxicity.score(odd(spark), model).count() == 14 and toxicity.score(empty(spark), model).count() == 0
    assert toxicity.without_toxic(odd(spark), model).columns == odd(spark).columns
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(odd(spark), labels, F.lit(True)).words == []


def test_passages(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(i, text(80) + (" " + passage + " " if i % 4 == 0 else " ") + text(80)) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.passages(d).collect()
    assert {r["doc_id"] for r in got} == {i for i in range(40) if i % 4 == 0}
    assert 0 in {r["doc_id"] for r in got if not r["removable"]}
    raw = dict(rows)
    for r in got:
        assert raw[r["doc_id"]].encode()[r["at"] : r["at"] + r["size"]].decode() in raw[r["first_doc_id"]]
    cleaned = {r["doc_id"]: r["text"] for r in substrings.without_repeats(d).collect()}
    assert cleaned[0] == raw[0] and cleaned[1] == raw[1] and all(passage not in cleaned[i] for i in range(4, 40, 4))


def brute_shared(texts, size):
    """For each text, which bytes lie in a stretch of `size` bytes that another text holds too."""
    holders = {}
    for k, raw in enumerate(texts):
        for i in range(len(raw) - size + 1):
            own = holders.setdefault(raw[i : i + size], k)
            if own != k:
                holders[raw[i : i + size]] = -1
    out = []
    for raw in texts:
        mask, last = np.zeros(len(raw), bool), -1
        for i in range(len(raw) - size + 1):
            if holders[raw[i : i + size]] == -1:
                mask[max(i, last) : i + size] = True
                last = i + size
        out.append(mask)
    return out


def test_op1_recall_and_precision_against_brute_force(spark):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in documents(spark).collect()]
    ids, texts = [i for i, _ in rows], [t for _, t in rows]
    covered = {i: np.zeros(len(t), bool) for i, t in rows}
    for r in queries.op1_substring_dedup(spark, SF).collect():
        assert not covered[r["doc_id"]][r["at"] : r["at"] + r["size"]].any()
        covered[r["doc_id"]][r["at"] : r["at"] + r["size"]] = True
    for size, least, bytes_least in ((100, 0.9, 0.9), (200, 0.98, 0.9), (300, 1.0, 0.9)):
        want = brute_shared(texts, size)
        found = total = 0
        for i, mask in zip(ids, want):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2]):
                total += 1
                found += covered[i][a:b].mean() >= 0.5
        assert found / total >= least, (size, found, total)
        assert sum((covered[i] & m).sum() for i, m in zip(ids, want)) / sum(m.sum() for m in want) >= bytes_least
    loose = brute_shared(texts, 50)
    assert sum((covered[i] & ~m).sum() for i, m in zip(ids, loose)) <= 0.001 * sum(c.sum() for c in covered.values())


def test_passages_in_text_without_spaces_and_of_repeated_words(spark):
    rng = random.Random(4)
    cjk = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    code = lambda n: "".join(rng.choice("abcdefghij0123456789+/") for _ in range(n))
    shared, packed = cjk(400), code(1500)
    rows = [(1, cjk(900) + shared + cjk(300)), (2, cjk(77) + shared + cjk(2000)), (3, cjk(500)), (4, code(333) + packed), (5, packed + code(80)), (6, code(3000)), (7, cjk(10) + shared[:200] + "新" + shared[200:])]
    rows += [(8, "alpha beta gamma " + "the " * 3000), (9, "alpha beta gamma " + "the " * 2500 + "end")]
    got = {}
    for r in substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["at"], r["size"]))
        raw = dict(rows)[r["doc_id"]].encode()
        raw[r["at"] : r["at"] + r["size"]].decode()
    assert set(got) == {1, 2, 4, 5, 7, 8, 9}
    for i, size in ((1, 1200), (2, 1200), (4, 1500), (5, 1500), (7, 1200), (9, 10000)):
        assert sum(n for _, n in got[i]) > 0.8 * size, i


def test_repeats_are_cut_in_their_own_text_alone(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage, other = text(70), "é" + text(170)
    rows = [(1, text(40) + " " + passage), (2, passage + " " + text(40)), (2, other), (2, other)]
    kept = sorted(r["text"] for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept.count(other) == 2 and rows[0][1] in kept and rows[1][1] not in kept and len(kept) == 4


def test_cutting_needs_one_python_worker_a_task(spark):
    """The filter of rows and the cuts are in different stages, however few cuts there are."""
    cut = substrings.without_repeats(documents(spark))
    assert cut.count() > 0 and cut.collect()
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_passages_odd_rows(spark):
    assert {r["doc_id"] for r in substrings.passages(odd(spark)).collect()} == {1, 2, 3}
    kept = substrings.without_repeats(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11]
    assert substrings.passages(empty(spark)).count() == 0


def test_gear_hash_rolls():
    data = np.frombuffer(b"the quick brown fox jumps over", np.uint8)
    h = 0
    for k, c in enumerate(data.tolist()):
        h = (h << 1) + int(substrings.GEAR[c]) & 0xFFFF
        assert h == int(substrings.gear_hashes(data)[k])


def test_decontamination(spark):
    item = "Thtieding. Onhe in haedea it ha with orbleat thesstea heerthly erensh oron"
    edited = item.replace("haedea", "haedexa").replace("oron", "orom")
    rows = [(1, "x " + item.upper() + " y"), (2, "z " + edited.replace(" ", "\n") + " tail"), (3, "Thtieding Onhe in something else heerthly"), (4, None), (5, ""), (6, item), (6, item)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(10, item), (11, None), (12, ""), (None, "x"), (13, "tail")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.matches(d, b).collect())
    assert got == [(1, 10, 0), (2, 10, 2), (2, 13, 0), (6, 10, 0), (6, 10, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.without_matches(d, b).collect()) == [3, 4, 5]
    assert decontaminate.matches(d, b.limit(0)).count() == 0 and decontaminate.matches(empty(spark), b).count() == 0


def brute_matches(docs, items):
    """Every item that a document holds within its budget, by dynamic programming over the whole document."""

    def least(pattern, text):
        row = np.zeros(len(text) + 1, np.int64)
        codes, steps = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.arange(len(text) + 1)
        for i, c in enumerate(pattern, 1):
            new = np.concatenate([[i], np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)])
            row = np.minimum.accumulate(new - steps) + steps
        return int(row.min())

    out = set()
    for i, t in docs:
        text = decontaminate.normal(t or "")
        for n, item in items:
            item = decontaminate.normal(item)
            k = decontaminate.budget(item)
            if len(item) >= decontaminate.SHORT and text and (d := least(item, text)) <= k:
                out.add((i, n, d))
    return out


def test_op6_against_brute_force(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    got = {tuple(r) for r in queries.op6_decontamination(spark, SF).collect()}
    held = {i for i, _, _ in got}
    some = [d for d in docs if d[0] in held or d[0] % 5 == 0 and len(d[1] or "") < 4000]
    want = brute_matches(some, items)
    assert {(i, n) for i, n, _ in got if i in {i for i, _ in some}} == {(i, n) for i, n, _ in want}
    assert all(d >= dict(((i, n), d) for i, n, d in want)[i, n] for i, n, d in got)


def test_decontamination_of_odd_ids_and_long_texts(spark):
    item = " ".join(f"piece{k}" for k in range(30))
    rows = [("a", "x " * 60000 + item + " y" * 60000), (None, item), ("b", item[: len(item) // 2])]
    d = spark.createDataFrame(rows, "doc_id string, text string").withColumn("item_id", F.lit(1)).withColumn("distance", F.lit(2))
    for kind in ("string", "int", "long"):
        b = spark.createDataFrame([("7", item), ("7", item + " more"), ("8", item)], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
        got = sorted(((r["doc_id"] or ""), int(r["item_id"]), r["distance"]) for r in decontaminate.matches(d, b).collect())
        assert got == [("", 7, 0), ("", 8, 0), ("a", 7, 0), ("a", 8, 0)] and dict(decontaminate.matches(d, b).dtypes)["item_id"] == {"long": "bigint"}.get(kind, kind)
    assert [r["doc_id"] for r in decontaminate.without_matches(d, b).collect()] == ["b"]


def test_myers_distance_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        p, t = ("".join(rng.choice("ab c") for _ in range(rng.randint(1, n))) for n in (12, 30))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontaminate.distance(p, t) == min(row)


def test_url_rules(spark):
    urls = [None, "", "nothing", "HTTP://WWW.Example.COM/en/1?x#y", "https://a.example.com/en/", "https://example.com/EN/", "http://com", "http://com/", "http://x.net/es/9", "http://net/fr/", "http://xnet/fr/", "http://a.org/en/1", "://h/p", "http://h?/en/"]
    d = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.verdicts(d).collect()}

    def brute(u):
        if not u or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [h + p for h, p, _ in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit, key=len) if fit else None

    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert url_filter.verdicts(d.limit(0)).count() == 0
    whole = queries.op7_url_filter(spark, SF).collect()
    assert len(whole) == spark.read.parquet(f"{SF}/pages.parquet").count() and {r["verdict"] for r in whole} <= {"allow", "block"}


def brute_markov(texts, order=5):
    """Log-likelihood by a character model in dictionaries."""
    counts = {}
    for t in texts:
        t += b"\n"
        for i, c in enumerate(t):
            for n in range(min(i, order) + 1):
                counts.setdefault(t[i - n : i], Counter())[c] += 1

    def logprob(t):
        t, total = t + b"\n", 0.0
        for i, c in enumerate(t):
            p = 1 / 256
            for n in range(min(i, order) + 1):
                own = counts.get(t[i - n : i])
                if not own:
                    break
                p = (own[c] + len(own) * p) / (own.total() + len(own))
            total += math.log(p)
        return total

    return logprob


def test_op7_verdicts_against_brute_force(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    got = {r["page_id"]: r for r in queries.op7_url_filter(spark, SF).collect()}
    assert set(got) == set(urls)
    verdict_of = {h + p: v for h, p, v in url_filter.RULES}
    labelled = {v: {urls[i] for i, r in got.items() if r["rule"] and verdict_of[r["rule"]] == v} for v in ("allow", "block")}
    order = lambda v: [r["url"] for r in spark.createDataFrame([(u,) for u in labelled[v]], "url string").orderBy(F.xxhash64("url"), "url").collect()]
    accepted, rejected = order("allow"), order("block")
    good, bad = (brute_markov([u.encode() for k, u in enumerate(own) if k % 5]) for own in (accepted, rejected))
    value = lambda u: (good(u.encode()) - bad(u.encode())) / (len(u.encode()) + 1)
    threshold = url_filter.Ratio(accepted, rejected).threshold
    held = [(value(u), y) for own, y in ((accepted, 1), (rejected, 0)) for k, u in enumerate(own) if not k % 5]
    balanced = lambda t: np.mean([v >= t for v, y in held if y]) + np.mean([v < t for v, y in held if not y])
    assert balanced(threshold) >= max(balanced(v + e) for v, _ in held for e in (-1e-9, 1e-9)) - 1e-9
    for i, r in got.items():
        if r["rule"]:
            assert r["verdict"] == verdict_of[r["rule"]] and r["ratio"] is None
        else:
            assert math.isclose(r["ratio"], value(urls[i] or "") - threshold, rel_tol=1e-9, abs_tol=1e-9) and r["verdict"] == ("allow" if r["ratio"] >= 0 else "block")


def test_op7_models_are_fitted_on_all_labelled_urls(spark):
    """Ratios equal those of models of every labelled URL, of more than any sample and of long ones, and of a threshold from all that are left out."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 6)))
    good, bad = ([f"https://www.{word()}{host}{word()}/{k}" for k in range(n)] for host, n in ((".com/", 9000), (".net/es/", 9000)))
    good.append("https://a.com/" + "zq" * 3000)
    other = [f"https://{word()}.org/{word()}" for _ in range(300)] + ["", "https://a.org/" + "zq" * 40]
    d = spark.createDataFrame(list(enumerate([*good, *bad, *good[:100], *other, None])), "page_id long, url string").repartition(5)
    order = lambda urls: [r["url"] for r in spark.createDataFrame([(u,) for u in set(urls)], "url string").orderBy(F.xxhash64("url"), "url").collect()]
    model = url_filter.Ratio(order(good), order(bad))
    got = {r["page_id"]: r for r in url_filter.verdicts(d).collect()}
    assert len(got) == len(good) + len(bad) + 100 + len(other) + 1
    want = model.values([u.encode() for u in other]) - model.threshold
    first = len(good) + len(bad) + 100
    assert np.allclose([got[first + k]["ratio"] for k in range(len(other))], want, rtol=1e-9, atol=1e-9)
    assert got[first + len(other)]["ratio"] == got[first + 300]["ratio"] and all(got[k]["ratio"] is None and got[k]["verdict"] == "allow" for k in range(len(good)))
    alone = url_filter.verdicts(d.where(f"page_id < {len(good)} or page_id >= {first}")).where("rule is null").collect()
    assert len(alone) == len(other) + 1 and all(r["verdict"] == "allow" and r["ratio"] is None for r in alone)


def test_url_models_tell_unseen_labelled_urls_apart(spark):
    """Held out: models of half of the labelled URLs judge the other half."""
    rows = [r for r in queries.op7_url_filter(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url"), "page_id").where("rule is not null").collect()]
    half = [[sorted({r["url"] for r in rows if r["verdict"] == v and zlib.crc32(r["url"].encode()) % 2 == part}) for v in ("allow", "block")] for part in (0, 1)]
    model = url_filter.Ratio(*half[0])
    good, bad = (model.values([u.encode() for u in own]) - model.threshold for own in half[1])
    assert (np.mean(good >= 0) + np.mean(bad < 0)) / 2 > 0.9, (np.mean(good >= 0), np.mean(bad < 0))


def test_url_long_and_odd(spark):
    r = url_filter.Ratio([f"https://good.example/{i}" for i in range(60)], [f"http://bad-bets.example/{i}" for i in range(60)])
    good, bad, empty_ = r.values([b"https://good.example/777", b"http://bad-bets.example/777", b""])
    assert good > r.threshold > bad and math.isfinite(empty_)
    model, brute = url_filter.Markov([b"abcabc", b"", b"aab"]), brute_markov([b"abcabc", b"", b"aab"])
    texts = [b"", b"a", b"abc" * 5000, bytes(range(256)), "日本".encode()]
    assert np.allclose(model.logprobs(texts), [brute(t) for t in texts]) and len(model.logprobs([])) == 0
    d = spark.createDataFrame([(1, "http://a.com/" + "x" * 300000), (2, "http://a.net/es/" + "y" * 300000), (3, "http://q.org/" + "z" * 300000)], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.verdicts(d).orderBy("page_id").collect()] == ["allow", "block", "allow"]


def chat_brute(roles):
    best = {0: 0}
    for role in roles:
        new = {}
        for s, c in best.items():
            for cost, _, to, _ in chat._MOVES.get(role, chat._MOVES[None])[s]:
                new[to] = min(new.get(to, 1 << 40), c + cost)
        best = new
    return min(c + chat.ENDING[s] for s, c in best.items())


@pytest.mark.parametrize("partitions", [1, 4])
def test_chat_repair(spark, partitions):
    rng = random.Random(partitions)
    rows = [(c, k, rng.choice(["system", "user", "assistant", "User ", None, "tool"]), f"t{c}.{k}") for c in range(6) for k in range(rng.randint(1, 9))]
    rows += [(99, k, ["user", "assistant", "system"][k % 3 if k % 5 else 0], f"hot{k}") for k in range(400)] + [(98, 1, "user", "the same")] * 300 + [(None, None, None, None)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("part", F.lit(1)).withColumn("place", F.lit("x"))
    d = d.repartition(partitions)
    got = chat.repaired(d).collect()
    assert len(got) == len(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["nth"])
        want = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x) for x in r))
        assert [r["nth"] for r in own] == list(range(len(want))) and [(r["turn"], r["role"]) for r in own] == [(r[1], r[2]) for r in want]
        check_conversation(own)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    assert sorted(map(tuple, chat.repaired(d).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert chat.repaired(d.limit(0)).count() == 0


def check_conversation(own):
    """The rendered text is legal, and its repair costs no more than the least."""
    text = "".join(r["rendered"] for r in own)
    shown = re.findall(r"<\|(system|user|assistant)\|>", text)
    rest = shown[1:] if shown[0] == "system" else shown
    assert rest and rest == ["user", "assistant"] * (len(rest) // 2) and text.count("<|end|>") == len(shown)
    roles = [None if r["role"] is None else r["role"].strip().lower() for r in own]
    cost = sum((r["action"] != "merge") * (r["new_role"] != x) * chat.RELABEL + (r["action"] == "merge") * (chat.MERGE + chat.RELABEL * (r["new_role"] != x)) + (r["inserted"] is not None) * chat.INSERT for r, x in zip(own, roles))
    assert cost + chat.ENDING[chat.ROLES.index(own[-1]["new_role"])] == chat_brute(roles)


def test_op8_on_all_conversations(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by = {}
    for r in queries.op8_chat_format(spark, SF).collect():
        by.setdefault(r["conv_id"], []).append(r)
    assert sum(map(len, by.values())) == len(rows) and set(by) == {r["conv_id"] for r in rows}
    for conv, own in by.items():
        own.sort(key=lambda r: r["nth"])
        check_conversation(own)
        said = [r["text"] or "" for r in sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: ((r["turn"] is not None, r["turn"]), (r["role"] is not None, r["role"]), (r["text"] is not None, r["text"])))]
        text, at = "".join(r["rendered"] for r in own), 0
        for t in said:  # every turn's text is there, in order
            at = text.index(t, at) + len(t)


def test_fingerprints_contract(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in documents(spark).collect())
    got = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint([t])[0][0] and r["edited_fingerprint"] == fingerprints.fingerprint([edited])[0][0]
        assert r["near_edited"] == fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == fingerprints.likeness(r["fingerprint"], fingerprints.fingerprint([after])[0][0])
    long_ = [r for r in got.values() if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] > r["near_next"] + 0.3 for r in long_]) > 0.97


def test_fingerprints_walk_and_odd_rows(spark):
    text = "abcaé😀 zz" * 9
    own = fingerprints._classes(fingerprints._codes(text))
    at, end = fingerprints.walk(own, np.array([0]), np.array([len(text)]), np.array([0], np.int32))
    step = 0
    for k, c in enumerate(own.tolist()):
        assert at[k] == step
        while True:
            step += 1
            if fingerprints._BITS[c, (step - 1) % fingerprints.PERIOD]:
                break
    assert end[0] == step
    many = fingerprints.fingerprint([text] * 30 + ["x"])
    assert len({m[0] for m in many[:30]}) == 1 and many[0][0] == fingerprints.fingerprint([text])[0][0]
    got = fingerprints.fingerprints(odd(spark)).collect()
    assert len(got) == 14 and fingerprints.fingerprints(empty(spark)).count() == 0
    classes = {r["fingerprint"]: r["label"] for r in fingerprints.classes(fingerprints.fingerprints(odd(spark))).collect()}
    first, third = (next(r["fingerprint"] for r in got if r["doc_id"] == k) for k in (1, 3))
    assert classes[first] == classes[third]
    assert fingerprints.linked_fingerprints(odd(spark)).count() == 14 and fingerprints.linked_fingerprints(empty(spark)).count() == 0


def test_op9_classes_against_brute_force(spark):
    got = queries.op9_fingerprints(spark, SF).collect()
    prints = sorted({r["fingerprint"] for r in got})
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if fingerprints.likeness(a, b) >= 0.8]
    for a, b in links:
        up[root(b)] = root(a)
    by = {}
    for r in got:
        by.setdefault(root(r["fingerprint"]), []).append(r)
    label = {r["fingerprint"]: r["class_id"] for r in got}
    assert sum(label[a] == label[b] for a, b in links) / max(1, len(links)) >= 0.97
    assert all(root(a) == root(b) for a in prints for b in prints if label[a] == label[b])
    exact = sum(len({r["class_id"] for r in own}) == 1 and own[0]["class_id"] == min(r["doc_id"] for r in own) and own[0]["class_size"] == len(own) for own in by.values())
    assert exact / len(by) >= 0.97


def test_op9_bands_lose_no_link_and_pass_over_shared_beginnings(spark):
    """A pair that differs in as many samples as a link allows shares a bucket wherever these are; texts with a common beginning alone share none."""
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for pair in range(400):
        reach, other = int(rng.integers(1, 65)), int(rng.integers(0, 2))
        one = np.zeros((2, 64), np.uint8)
        one[0, :reach] = rng.integers(1, 256, reach)
        one[1, : reach // 2] = rng.integers(1, 256, reach // 2)
        two = np.zeros((2, 64), np.uint8)
        two[other] = one[0]  # the shorter text: at its next scale where other is 1
        two[1 - other, : 64 if other else reach // 2] = rng.integers(1, 256, 64 if other else reach // 2)
        unlike = rng.choice(reach, fingerprints.most_unlike(reach, 0.8), replace=False)
        two[other, unlike] = two[other, unlike] % 255 + 1
        ends = unlike[np.argsort(-unlike)]
        for k in range(int(rng.integers(0, len(ends) + 1))):  # some of them past the shorter text's end
            if ends[k] == reach - 1 - k:
                two[other, ends[k]] = 0
        a, b = f"{20:02x}" + one.tobytes().hex(), f"{20 - other:02x}" + two.tobytes().hex()
        if a != b:
            assert fingerprints.likeness(a, b) >= 0.8 and fingerprints.likenesses([a], [b])[0] == fingerprints.likeness(a, b)
            rows += [(2 * pair, a), (2 * pair + 1, b)]
            want.add(pair)
    members = fingerprints.buckets(spark.createDataFrame(rows, "print_id long, fingerprint string")).collect()
    filed = {}
    for r in members:
        filed.setdefault(r["bucket"], {})[r["id"]] = r["longer"]
    assert {i // 2 for own in filed.values() for i in own if i ^ 1 in own and (own[i] or own[i ^ 1])} == want
    text = "This text is made available under the terms of the licence below, without any warranty. " * 3
    letters = random.Random(5)
    texts = [text + "".join(letters.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900)) for _ in range(300)]
    prints = spark.createDataFrame([(k, p[0]) for k, p in enumerate(fingerprints.fingerprint(texts))], "print_id long, fingerprint string")
    assert fingerprints.buckets(prints).count() < 30


def test_fingerprints_of_hot_ids(spark):
    """A third of the rows without an id and a third of one id: each is followed by the next in order of (id, hash), and no part holds them all."""
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 60)))
    rows = [(None, text()) for _ in range(100)] + [(7, text()) for _ in range(100)] + [(k, text()) for k in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = sorted((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["h"], r["text"]) for r in d.withColumn("h", F.xxhash64("text")).collect())
    want = Counter()
    for k, (i, _, t) in enumerate(keyed):
        q, after = len(t) // 4, keyed[(k + 1) % len(keyed)][2]
        want[None if i == -(1 << 63) else i, hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.fingerprints(d).collect()) == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.fingerprints(d).collect()) == want
    assert max(r["n"] for r in fingerprints.with_next(d).groupBy("part").agg(F.count("*").alias("n")).collect()) < 2 * 300 / 16 + 10
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("number", [1, 3, 4, 10])
def test_registered_queries_run_over_whole_tables(spark, number):
    import tiktoken

    rows = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    got = next(f for name, f in queries.queries().items() if name.startswith(f"op{number}_"))(spark, SF).collect()
    if number == 1:
        assert got and {r["doc_id"] for r in got} <= set(rows) and len({r["doc_id"] for r in got}) > 1
        return
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    if number == 4:
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(list(rows.items())) and all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)
        return
    path, pattern = queries.tokenizer(*(["byte_bpe_50k.tiktoken"] if number == 10 else []))
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    ids = {i: lib.encode_ordinary(t) for i, t in rows.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(x) for i, x in ids.items()}
    if number == 3:
        assert all(r["ids_sha256"] == hashlib.sha256(np.array(ids[r["doc_id"]], "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest() for r in got)


def test_token_counts(spark):
    import tiktoken

    path, pattern = queries.tokenizer("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    rows = odd(spark).unionByName(documents(spark), allowMissingColumns=True)
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.document_token_counts(rows, path, pattern).collect())
    assert got == sorted((r["doc_id"] or -1, len(lib.encode_ordinary(r["text"] or ""))) for r in rows.collect())
    assert token_counts.document_token_counts(empty(spark), path, pattern).count() == 0


def test_token_counts_of_a_text_longer_than_a_block(spark, monkeypatch):
    path, pattern = queries.tokenizer("byte_bpe_50k.tiktoken")
    rows = [(1, "word " * 50000), (None, "x"), (1, "word " * 50000), (2, None)]
    monkeypatch.setattr(token_counts.count_tokens, "__defaults__", (token_counts.END, 2, 1 << 10))
    got = token_counts.document_token_counts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("f")).withColumn("ordinal", F.lit(3)), path, pattern)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got.collect()) == [(0, 1), (1, 50001), (1, 50001), (2, 0)]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_token_counts_blocks(spark, tmp_path, block):
    ids = [5, 6, 9, 9, 1, 2, 3, 4, 5, 6, 7, 9, 1]
    np.array(ids, "<u2").tofile(tmp_path / "a.bin")
    np.array([9], "<u2").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").touch()
    files = spark.createDataFrame([(str(tmp_path / f"{x}.bin"), 1) for x in "abca"] + [(None, 2)], "file string, block long")
    got = sorted((r["file"][-5], r["ordinal"], r["n_tokens"]) for r in token_counts.count_tokens(files, 9, 2, block).collect())
    assert got == [("a", 0, 2), ("a", 1, 0), ("a", 2, 7), ("a", 3, 1), ("b", 0, 0)]


def slow_cuts(raw):
    """Chunks by the module's rule, character by character."""
    white = b" \t\n\x0b\x0c\r"
    gear = [sum(int(substrings.GEAR[raw[i - j]]) << j for j in range(min(16, i + 1))) & 0xFFFF for i in range(len(raw))]

    def minima(places, values, radius):
        return [places[k] for k in range(radius, len(places) - radius) if all(values[k - j] > values[k] <= values[k + j] for j in range(1, radius + 1))]

    ends = [i for i, c in enumerate(raw) if c in white and (i + 1 == len(raw) or raw[i + 1] not in white)]
    bounds = {0, len(raw), *(i + 1 for i in minima(ends, [gear[i] for i in ends], substrings.RADIUS))}
    for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", raw):
        a, b = m.span()
        if b - a > substrings.LONG_WORD:
            starts = [i for i in range(max(a + 1, 16), b) if raw[i] & 0xC0 != 0x80]
            bounds |= set(minima(starts, [gear[i - 1] for i in starts], substrings.REACH))
    bounds, extra = sorted(bounds), set()
    for a, b in zip(bounds, bounds[1:]):
        for p in range(a + substrings.MAX_CHUNK, b, substrings.MAX_CHUNK):
            while raw[p] & 0xC0 == 0x80:
                p -= 1
            extra.add(p)
    bounds = sorted({*bounds, *extra})
    return list(zip(bounds, bounds[1:]))


def test_cuts_against_brute_force(spark):
    rng = random.Random(12)
    texts = [(r["text"] or "").encode() for r in documents(spark).collect()][:60] + [("日本語の文" * 400).encode(), b"the " * 900, ("".join(chr(rng.randrange(0x3040, 0x9000)) for _ in range(3000)) + " tail").encode(), bytes(rng.choice(b"abcdef0123/") for _ in range(5000)), b"x", b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    begins, ends = substrings.cuts(data, offsets)
    want = [(int(o) + a, int(o) + b) for t, o in zip(texts, offsets) if t for a, b in slow_cuts(t)]
    assert list(zip(begins.tolist(), ends.tolist())) == want


def slow_repeats(rows):
    """Texts without later copies of passages, from chunks in dictionaries."""
    chunks = {i: [(a, b, t.encode()[a:b]) for a, b in slow_cuts(t.encode())] for i, t in rows}
    holders = {}
    for i, own in chunks.items():
        for *_, c in own:
            holders.setdefault(c, set()).add(i)
    out = {}
    for i, t in rows:
        own, gone, k = chunks[i], set(), 0
        while k < len(own):
            j = k
            while j < len(own) and len(holders[own[j][2]]) > 1:
                j += 1
            if j > k and own[j - 1][1] - own[k][0] >= substrings.LEAST_BYTES:
                gone |= {n for n in range(k, j) if min(holders[own[n][2]]) != i}
            k = max(j, k + 1)
        text = b"".join(c for n, (*_, c) in enumerate(own) if n not in gone).decode()
        if not gone or text.strip():
            out[i] = text
    return out


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    import tiktoken

    model = queries.toxicity_model(spark, documents(spark), SF)
    left = [(r["doc_id"], r["text"]) for r in documents(spark).collect() if model.scores([r["text"] or ""])[0] < 0.7]
    found = brute_components(left)
    left = [(i, t) for i, t in left if found[i][1] == i]
    texts = slow_repeats(left)
    assert sum(texts.get(i) != t for i, t in left) > 3  # the stage has work
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, _, _ in brute_matches(list(texts.items()), items)}
    short = [n for n in (decontaminate.normal(t) for _, t in items) if n and len(n) < decontaminate.SHORT]
    assert held and not short
    path, pattern = queries.tokenizer()
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = {i: (len(ids := lib.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items() if i not in held}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "byte_bpe"]


def test_pipeline_stages_on_odd_rows_and_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"w{i * i % 997}q" for i in range(90))
    own = lambda k: " ".join(f"u{i}x{k}" for i in range(60))
    more = spark.createDataFrame([(20, own(1) + " " + passage, None, "s", 3, 1, "x", 2), (21, passage + " " + own(2), "en", "s", None, 1, "x", 2), (21, "another text of the same id", "en", None, None, 1, "x", 2)], SCHEMA)
    for number, rows in enumerate((odd(spark).unionByName(more), empty(spark))):
        sf = tmp_path / str(number)
        rows.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (3, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "two three")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(sf)).write.parquet(f"{sf}/{k}")
            after = spark.read.parquet(f"{sf}/{k}")
            assert k == 4 or after.dtypes == docs.dtypes
            docs = after
        ids = sorted(r["doc_id"] or 0 for r in docs.collect())
        assert ids == ([] if number else [0, 0, 1, 4, 5, 6, 7, 9, 10, 11, 20, 21, 21])
