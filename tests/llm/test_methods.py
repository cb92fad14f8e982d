"""The operators beside brute force, exact round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import cover_tree, langid, mixing, order_minhash, piece_sampling, pitman_yor, quality, shingle_join
from ledgerleaf.llm.common import components, fold, table
from ledgerleaf.llm.queries import ORACLE, QUERIES


def words_of(text):
    return (text or "").encode().lower().split()


def grouped(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def documents(spark, data):
    return table(spark, data, "documents").cache()


@pytest.fixture(scope="module")
def rows(documents):
    return {r.doc_id: r for r in documents.collect()}


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)]
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")
    expected = {n: c for n, c in grouped(edges, {x for e in edges for x in e}).items() if n != c}
    assert {r.node: r.component for r in components(df.where("a is not null")).collect()} == expected
    assert components(df.limit(0)).collect() == []


def test_components_of_hubs(spark):
    """Two stars of many leaves, one with its smallest node at the centre and one with its largest, and a chain between them."""
    edges = [(5, i) for i in range(10, 2010)] + [(90_000, i) for i in range(3000, 4500)] + [(10, 20_000), (20_000, 20_001), (20_001, 3000)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in components(df).collect()}
    assert found == {n: c for n, c in grouped(edges, {x for e in edges for x in e}).items() if n != c} and set(found.values()) == {5}


def test_quality_held_out(spark, data):
    found = {r.doc_id: r for r in QUERIES["op1_quality_scores"](spark, "/root/testdata/sf0.01").collect()}
    labels = table(spark, "/root/testdata/sf0.01", "labels").collect()
    held = [(found[r.doc_id].predicted, r.quality) for r in labels if found[r.doc_id].held_out]
    assert len(held) > 40 and sum(p == q for p, q in held) / len(held) > 0.95


def test_discriminant_is_the_density():
    random_ = np.random.default_rng(0)
    x = [random_.normal(size=(300, len(quality.NAMES))), 1 + 2 * random_.normal(size=(200, len(quality.NAMES)))]
    model = quality.Discriminant(np.array([300.0, 200.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]))
    at = random_.normal(size=(5, len(quality.NAMES)))
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x) / 500
    logs = []
    for k, v in enumerate(x):
        c = (1 - quality.POOLED) * np.cov(v.T, bias=True) + quality.POOLED * pooled
        p = len(c)
        c = (1 - quality.IDENTITY) * c + (quality.IDENTITY * np.trace(c) / p + quality.LEAST) * np.eye(p)
        d = at - v.mean(0)
        logs.append(math.log((len(v) + 1) / 502) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.log_odds(at), logs[1] - logs[0])


def test_language_held_out(spark):
    found = QUERIES["op6_languages"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r.lang_pred == r.lang for r in found if r.held_out]
    assert sum(held) / len(held) > 0.97 and not any(r.rejected for r in found)


def test_nearest_centroid_by_brute_force(spark, documents, rows):
    """Document frequencies, vectors and cosines counted anew, with dictionaries of n-grams for the hash buckets."""
    learn = [r for r in rows.values() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None]
    model = langid.fit(documents.where(fold(F.col("doc_id"), 4) != 2))
    seen = sum((langid.counts(r.text) > 0).astype(int) for r in learn)
    assert np.allclose(model.idf, np.log((1 + len(learn)) / (1 + seen)) + 1, rtol=1e-6)
    text = "Ab, c"
    assert langid.counts(text).sum() == len(" ab c ") + len(" ab c ") - 1 + len(" ab c ") - 2
    found = {r.doc_id: r for r in QUERIES["op6_languages"](spark, "/root/testdata/sf0.001").collect()}
    for r in list(rows.values())[:60]:
        if not r.text or not any(map(str.isalpha, r.text)):
            continue
        x = np.sqrt(langid.counts(r.text)) * model.idf
        cosines = model.rows @ x / np.linalg.norm(x)
        assert found[r.doc_id].lang_pred == model.names[int(np.argmax(cosines))] and abs(found[r.doc_id].score - cosines.max()) < 1e-4
    for name in set(model.names):
        assert np.allclose(np.linalg.norm(model.rows[[n == name for n in model.names]], axis=1), 1, atol=1e-5)


def test_far_text_is_rejected(documents):
    model = langid.fit(documents.where(fold(F.col("doc_id"), 4) != 2))
    names, cosines = model.nearest(["Ωμέγα και άλφα είναι γράμματα", "漢字仮名交じり文"])
    assert (cosines < langid.REJECT).all()


@pytest.mark.parametrize("count", [1, 63, 64, 65, 4096, 5000])
def test_search_in_steps(spark, count):
    random.seed(count)
    cuts = sorted(random.choice([random.randrange(10**6), 5]) for _ in range(count))
    values = [-1, 5, 10**6, *cuts[:20], *[c + 1 for c in cuts[:20]], *random.sample(range(10**6), 20)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    found = df.select("v", order_minhash._below(F.col("v"), cuts, False).alias("low"), order_minhash._below(F.col("v"), cuts, True).alias("high")).collect()
    assert all((r.low, r.high) == (sum(c < r.v for c in cuts), sum(c <= r.v for c in cuts)) for r in found)


def test_runs_are_even(spark, monkeypatch):
    """Ids far apart, one id on a third of the rows and rows without an id: runs of even size, in the order of the ids."""
    monkeypatch.setattr(order_minhash, "RUN", 50)
    rows = [(i * i * 1000, f"a{i}") for i in range(1000)] + [(77, f"b{i}") for i in range(800)] + [(None, f"c{i}") for i in range(600)] + [(1 << 62, "z")]
    dealt, _ = order_minhash.with_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    found = dealt.collect()
    sizes = Counter(r._run for r in found)
    assert max(sizes.values()) <= 120 and len(sizes) > 30
    ordered = sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r._tie))
    assert [r._run for r in ordered] == sorted(r._run for r in found)


def order_min_hash(spark, text):
    """The signature by its definition, each hash asked of Spark."""
    words = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % order_minhash.MOST, text)
    k, low = order_minhash.K, order_minhash.LOW
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    if not words:
        return []
    grams = [tuple((words + [None] * k)[i : i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1)))]
    rows = spark.createDataFrame([(n, *g) for n, g in enumerate(grams)], "n long, a string, b string, c string")
    head = {r.n: signed(r.h & ~low) for r in rows.select("n", F.xxhash64("a", "b", "c").alias("h")).collect()}
    seen, numbered = Counter(), []
    for n in range(len(grams)):
        numbered.append((n, head[n], seen[head[n]]))
        seen[head[n]] += 1
    rows = spark.createDataFrame(numbered, "n long, head long, turn int")
    items = sorted(signed((r.h & ~low) | r.n) for r in rows.select("n", F.xxhash64("head", "turn").alias("h")).collect())
    bins = defaultdict(list)
    for x in items:
        bins[(x % (1 << 64)) >> (64 - (order_minhash.BINS - 1).bit_length())].append(x)
    out = []
    for b, own in bins.items():
        own = sorted(own)[: order_minhash.ELL]
        by_place = sorted(own, key=lambda x: (x & low, x % (1 << 64) >> (order_minhash.POSITION + 1)))
        values = [(x % (1 << 64)) >> (order_minhash.POSITION + 1) for x in by_place]
        h = spark.createDataFrame([(values,)], "v array<long>").select(F.xxhash64("v")).first()[0]
        out.append((b << 32) | (h & 0xFFFFFFFF))
    return sorted(out)


def test_signature_by_definition(spark):
    random.seed(12)
    for text in ("a b c a b c a b c a b c", "", "one", "two words", " ".join(random.choice("abcdefgh") * random.choice([1, 20]) for _ in range(150))):
        found = spark.createDataFrame([(text,)], "t string").select(order_minhash.signature(F.col("t"))).first()[0]
        assert sorted(found) == order_min_hash(spark, text)


def test_edited_texts_and_likeness(spark, data, rows):
    found = {r.doc_id: r for r in QUERIES["op3_order_fingerprints"](spark, data).collect()}
    ids = sorted(rows)
    for i, n in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, after = rows[i].text or "", rows[n].text or ""
        half = len(text) // 2
        assert found[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert found[i].n_chars == len(text)
    assert np.mean([r.near_edited for r in found.values()]) > 5 * np.mean([r.near_next for r in found.values()]) + 0.05


def test_signature_feels_order(spark):
    a = [f"w{i}" for i in range(300)]
    moved, changed = a[150:] + a[:150], [*a[:290], *[f"v{i}" for i in range(10)]]
    df = spark.createDataFrame([(" ".join(a), " ".join(moved), " ".join(changed), " ".join(a))], "a string, m string, c string, s string")
    near = lambda x: order_minhash.likeness(order_minhash.signature(F.col("a")), order_minhash.signature(F.col(x)))
    m, c, s = df.select(near("m"), near("c"), near("s")).first()
    assert s == 1.0 and c > 0.75 and 0.2 < m < c  # moving a half changes the order of about half of all pairs


def test_signature_by_hand(spark):
    """Occurrence numbers make repeated k-mers distinct, so the number of repeats matters."""
    df = spark.createDataFrame([("a b c " * 50, "a b c " * 80)], "x string, y string")
    x, y = df.select(F.size(order_minhash.signature(F.col("x"))), F.size(order_minhash.signature(F.col("y")))).first()
    assert x > 25 and y >= x


def test_mix_targets(spark, data, rows):
    found = QUERIES["op4_source_mix"](spark, data).collect()
    sizes = Counter()
    for r in rows.values():
        sizes[r.source] += len([w for w in words_of(r.text)])
    names = sorted(sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = left / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and share * weight[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    goal = {s: 3 * sizes[s] if s in full else share * weight[s] for s in names}
    taken = Counter()
    for r in found:
        assert r["size"] == len(words_of(rows[r.doc_id].text)) and r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source]) and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 5 for s in names)


def test_schedule_spreads(spark):
    goals = spark.createDataFrame([(1, 1000, 100.0), (2, 1000, 200.0), (3, 1000, 700.0)], "no int, source_size long, target double")
    slots = {r.slot: r.no for r in mixing.schedule(goals, 1000, 1).collect()}
    for n in (50, 200, 1000):
        seen = Counter(slots[i] for i in range(n))
        assert all(abs(seen[k] - n * w) <= 4 for k, w in ((1, 0.1), (2, 0.2), (3, 0.7)))


@pytest.fixture(scope="module")
def modelled(spark, data):
    return {r.doc_id: r for r in QUERIES["op5_language_model"](spark, data).collect()}


def test_model_counts_and_base(modelled, rows):
    trained = [i for i in rows if zlib.crc32(str(i).encode()) % 10 != 0]
    counts = Counter(w for i in trained for w in [*words_of(rows[i].text), b"\n"])
    n, v = sum(counts.values()), len(counts)
    for i, r in modelled.items():
        tokens = [*words_of(rows[i].text), b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(w in counts for w in tokens), n, i not in set(trained))
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9)
    for held in (False, True):
        some = [r for r in modelled.values() if r.held_out == held]
        assert sum(r.score for r in some) > sum(r.base_score for r in some)


def test_tables_have_their_distribution():
    """Tables of one dish against the weights of all set partitions of its customers."""
    def partitions(n):
        if n == 0:
            yield []
            return
        for p in partitions(n - 1):
            yield [*p, 1]
            for i in range(len(p)):
                yield [*p[:i], p[i] + 1, *p[i + 1 :]]

    discount, others, parent, n = 0.6, 3, 0.2, 6
    weights = np.zeros(n + 1)
    for p in partitions(n):
        opened = math.prod((pitman_yor.STRENGTH + discount * (others + k)) * parent for k in range(len(p)))
        weights[len(p)] += opened * math.prod(math.prod(j - discount for j in range(1, size)) for size in p)
    drawn = pitman_yor.tables_of(np.full(40_000, n), np.full(40_000, others), np.full(40_000, parent), discount, np.random.default_rng(3))
    assert np.abs(np.bincount(drawn, minlength=n + 1) / 40_000 - weights / weights.sum()).max() < 0.01
    many = pitman_yor.tables_of(np.full(500, 5000), np.zeros(500, int), np.full(500, 1.0), 0.5, np.random.default_rng(4))
    t = 1.0
    for k in range(1, 5000):
        t += (1.0 + 0.5 * t) / (1.0 + k)
    assert abs(many.mean() / t - 1) < 0.1 and many.min() >= 1


def tokens_of(texts):
    hasher = pitman_yor.WordHasher()
    ids, first = pitman_yor.stream([t.encode() for t in texts], hasher)
    to = pitman_yor.places_of(ids, first)
    kinds, at = np.unique(ids, return_inverse=True)
    return kinds, at[to - 2], at[to - 1], at[to], np.repeat(np.arange(len(texts)), np.diff(first) - 2)


def test_contexts_sum_to_one():
    """A partition that holds every word after some contexts, seen and unseen ones: each context's probabilities sum to one."""
    random.seed(2)
    names = [f"w{i}" for i in range(12)]
    train = [" ".join(random.choice(names) for _ in range(60)) for _ in range(40)]
    contexts = [("w1", "w2"), ("w3", "w3"), ("new", "w4"), ("x", "never")]
    asked = [f"{u} {v} {w}".strip() for u, v in contexts for w in [*names, ""]]
    kinds, far, near, word, row = tokens_of([*train, *asked])
    r = pitman_yor.Restaurants(kinds, [far, near, word, row], np.arange(len(train) + len(asked)) < len(train))
    at, count = r.words()
    assert count.sum() == 40 * 61 and (count > 0).sum() == 13
    root = np.zeros(len(kinds))
    root[at[count > 0]] = 1 / 13
    place = {(f, n, w): t for t, (n, f, w) in enumerate(sorted(set(zip(near.tolist(), far.tolist(), word.tolist(), strict=True))))}
    for shares, tables in r.sweeps(root, [1], 3):
        p = shares()
        assert (np.bincount(r.pair_word, tables)[at[count > 0]] >= 1).all()
        last = {}
        for i in range(len(train) * 61, len(word)):
            last.setdefault((far[i], near[i]), {})[word[i]] = p[place[far[i], near[i], word[i]]]
        whole = [sum(x.values()) for x in last.values() if len(x) == 13]
        assert len(whole) == 4 and np.allclose(whole, 1)


@pytest.mark.parametrize("limit", [20, 1 << 20])
def test_model_feels_word_order(spark, monkeypatch, limit):
    """Fluent texts score above their shuffled words, with frequent contexts split and whole."""
    monkeypatch.setattr(pitman_yor, "LIMIT", limit)
    random.seed(4)
    after = {i: [random.randrange(60) for _ in range(3)] for i in range(60)}
    texts = []
    for _ in range(150):
        at, words = random.randrange(60), []
        for _ in range(40):
            words.append(f"w{at}")
            at = random.choice(after[at])
        texts.append(words)
    held = [(i, " ".join(w)) for i, w in enumerate(texts)]
    mixed = [(200 + i, " ".join(random.sample(w, len(w)))) for i, w in enumerate(texts[120:])]
    docs = spark.createDataFrame(held + mixed, "doc_id long, text string")
    found = {r.doc_id: r for r in pitman_yor.evaluate(docs, F.col("doc_id") < 120).collect()}
    assert found[0].train_tokens == 120 * 41
    assert all(found[120 + i].score > found[200 + i].score + 10 for i in range(30))
    assert docs.where("doc_id >= 120").count() == 60
    perplexity = pitman_yor.evaluate(docs, F.col("doc_id") < 120).where("doc_id between 120 and 149").agg(pitman_yor.perplexity()).first()[0]
    assert 2 < perplexity < 8  # three words follow each


def test_frequent_contexts_are_split():
    """Tokens of a frequent pair go to restaurants by classes of rows, those of a frequent nearer word to restaurants by classes of farther words."""
    far, near, row = np.array([5, 5, 5, 5, 6, 7], np.uint64), np.array([9, 9, 9, 9, 9, 8], np.uint64), np.arange(6)
    pair = pitman_yor.pair_ids(far, near)
    often = np.sort(np.array([9, pair[0]], np.uint64))
    new_far, new_near = pitman_yor.split_contexts(far, near, np.repeat(np.arange(3), 2), often, np.array([2, 2], np.uint64))
    assert new_far[4] == 6 and (new_far[5], new_near[5]) == (7, 8) and 9 not in new_near[:5].tolist() and 5 not in new_far[:4].tolist()
    assert new_far[0] == new_far[1] and new_near[0] == new_near[1]
    new_far, new_near = pitman_yor.split_contexts(np.full(1000, 5, np.uint64), np.full(1000, 9, np.uint64), np.arange(1000), often, np.array([2, 4], np.uint64) if often[0] == 9 else np.array([4, 2], np.uint64))
    assert len(set(new_far.tolist())) == 4 and len(set(new_near.tolist())) <= 2


def test_traversal_equals_brute_force():
    random_ = np.random.default_rng(1)
    x = random_.normal(size=(40, 8)).repeat(6, 0) + 0.15 * random_.normal(size=(240, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.build(x)
    for threshold in (0.5, 0.9, 0.99, 1.0):
        a, b = cover_tree.linked(x, x, tree, tree, threshold)
        assert {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j} == {tuple(p) for p in np.argwhere(np.triu(x @ x.T >= threshold, 1)).tolist()}


@pytest.mark.parametrize("block", [8, 2048])
def test_links_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    random_ = np.random.default_rng(2)
    x = random_.normal(size=(20, 6)).repeat(5, 0) + 0.2 * random_.normal(size=(100, 6))
    df = spark.createDataFrame([(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, j) for i, j in itertools.combinations(range(100), 2) if i % 2 == j % 2 and unit[i] @ unit[j] >= 0.93]
    reach, n = grouped(pairs, range(100)), Counter(itertools.chain(*pairs))
    assert pairs and {(r.vec_id, r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(df).collect()} == {(i, n[i], reach[i], reach[i] == i) for i in range(100)}


def near_copies(seed):
    random.seed(seed)
    base = [[f"{c}{random.randrange(10**6)}" for _ in range(random.choice([3, 8, 40, 120, 1500]))] for c in "abcdefghij"]
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for b in base:
        for n in range(8):
            t = list(b)
            for _ in range(n * max(1, len(t) // 60)):
                t[random.randrange(len(t))] = f"z{random.randrange(10**6)}"
            texts.append(" ".join([*shared, *t] if n % 3 == 0 else t))
    return [*texts, texts[0], texts[9].upper()]


@pytest.mark.parametrize("block", [4, 1024])
def test_shingle_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    texts = near_copies(7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, words_of(t)) for i, t in enumerate(texts))}
    pairs = [(i, j) for i, j in itertools.combinations(sets, 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    reach = grouped(pairs, sets)
    assert pairs and {(r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(df).collect()} == {(i, len(sets[i]), reach[i]) for i in sets}


def test_large_groups_meet_their_root(spark, monkeypatch):
    """A group of many near copies around one text, a few that only some of them are near, and one that shares words but is near none."""
    monkeypatch.setattr(shingle_join, "BLOCK", 16)
    random.seed(3)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(random.choice([1, 2, 4, 6, 9])):
            t[random.randrange(300)] = f"z{random.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(base[k:] + [f"n{i}" for i in range(k)]) for k in range(5, 150, 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(words_of, texts)]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    reach = grouped(pairs, range(len(sets)))
    assert {(r.doc_id, r.component_id) for r in shingle_join.near_duplicates(df).collect()} == set(reach.items()) and len(set(reach.values())) > 2


def test_links_without_ids(spark):
    """Texts 1 - x - 2, where only x is near both: they meet whether x has an id, shares one or has none."""
    words = [f"w{i}" for i in range(200)]
    one, x, two = words[:200], words[12:] + [f"n{i}" for i in range(12)], words[24:] + [f"n{i}" for i in range(24)]
    for key in (9, 1, None):
        df = spark.createDataFrame([(1, " ".join(one)), (key, " ".join(x)), (2, " ".join(two)), (None, "alone here"), (None, None)], "doc_id long, text string")
        found = shingle_join.near_duplicates(df).collect()
        assert sorted((r.doc_id or 0, r.component_id or 0) for r in found if r.n_shingles > 5) == sorted([(1, 1), (key or 0, 1), (2, 1)])
        assert {(r.n_shingles, r.component_id) for r in found if r.n_shingles < 5} == {(1, None), (0, None)}


def test_bounds_lose_nothing():
    shingler = shingle_join.Shingler()
    sets = [shingler(t.encode()) for t in near_copies(11)]
    a, b = shingle_join._candidates(np.zeros(len(sets)), [shingle_join.point_of(s) for s in sets])
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    true = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if shingle_join.similar(sets[i], sets[j])}
    assert true <= found and len(found) < len(sets) * (len(sets) - 1) / 4


def test_sampled_paths_have_their_shares():
    pieces = piece_sampling.pieces_of(piece_sampling.MODEL, 1.0)
    word = "banana"
    paths, weights = [], []

    def walk(at, path, weight):
        if at == len(word):
            paths.append(tuple(path))
            weights.append(weight)
            return
        node = pieces.tree
        for to in range(at, len(word)):
            node = node.get(word[to])
            if node is None:
                break
            if (p := node.get(None)) is not None:
                walk(to + 1, [*path, p], weight * pieces.weights[p])

    walk(0, [], 1.0)
    seen = Counter(tuple(x.tolist()) for x in piece_sampling.sample([word] * 20_000, list(range(20_000)), pieces))
    for path, weight in zip(paths, np.array(weights) / sum(weights), strict=True):
        assert abs(seen[path] / 20_000 - weight) < 0.015
    alone = piece_sampling.Pieces.lattice(pieces, word)
    many = pieces.lattices([word, "other"])
    shares = lambda x: np.sort(np.diff(np.concatenate([[1.0], x])) % 1)
    assert alone[0] == many[0][0] and np.allclose(shares(alone[1]), shares(many[1][: len(alone[1])]))


def test_decoding_replaces_a_text(spark):
    encoded = piece_sampling.encode(spark.createDataFrame([(1, "as it was"), (2, None)], "doc_id long, text string"), keep=("doc_id", "text"))
    assert sorted(map(tuple, piece_sampling.decode(encoded).collect())) == [(1, "as it was"), (2, None)]


def test_pieces_round_trip(spark, data, rows):
    encoded = piece_sampling.encode(table(spark, data, "documents"))
    back = {r.doc_id: r.text for r in piece_sampling.decode(encoded).collect()}
    assert back == {i: r.text for i, r in rows.items()}


def test_pipeline(spark, data, rows):
    import corpus_pipeline as pipeline

    docs, seen = table(spark, data, "documents"), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, data)
        seen[name] = out.collect()
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(seen[name], docs.schema)
    counts = [len(v) for v in seen.values()]
    assert counts[0] < len(rows) and counts[1] == counts[0] and counts[2] < counts[1] and counts[4] == counts[3]
    kept = defaultdict(set)
    for r in seen["n-gram Jaccard join"]:
        kept[r.text].add(r.doc_id)
    assert all(len(v) == 1 for v in kept.values())
    assert sorted(r.doc_id for r in pipeline.run(spark, data).collect()) == sorted(r.doc_id for r in seen["SentencePiece encoding"])


def test_stages_by_brute_force(spark, data):
    """What each stage of the pipeline keeps, worked out row by row from what it was given."""
    import corpus_pipeline as pipeline

    docs, given = table(spark, data, "documents"), None
    for name, stage in pipeline.STAGES:
        given = {r.doc_id: r for r in docs.collect()} if name != pipeline.STAGES[-1][0] else [r for r in docs.collect()]
        rows = stage(spark, docs, data).collect()
        kept = Counter(r.doc_id for r in rows)
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in table(spark, data, "labels").collect() if r.quality in (0, 1)}
            x = {i: np.array(quality.statistics(r.text)) for i, r in given.items()}
            learn = {k: [x[i] for i in given if labels.get(i) == k and zlib.crc32(str(i).encode()) % 5] for k in (0, 1)}
            model = quality.Discriminant(np.array([float(len(learn[k])) for k in (0, 1)]), np.stack([sum(learn[k]) for k in (0, 1)]), np.stack([sum(np.outer(v, v) for v in learn[k]) for k in (0, 1)]))
            expected = Counter(i for i in given if model.score(x[i][None])[0] >= 0.3)
        elif name == "language ID":
            model = langid.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
            expected = Counter()
            for i, r in given.items():
                if r.text and any(map(str.isalpha, r.text)):
                    v = np.sqrt(langid.counts(r.text)) * model.idf
                    cosines = model.rows @ v / np.linalg.norm(v)
                    letters = sum(map(str.isalpha, r.text.lower()))
                    best = int(np.argmax(cosines))
                    if cosines[best] >= langid.REJECT and cosines[best] * (letters + langid.SHORT) / letters >= model.limits[model.names[best]]:
                        expected[i] = 1
        elif name == "n-gram Jaccard join":
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, words_of(r.text)) for i, r in given.items()) if w}
            pairs = [(i, j) for i, j in itertools.combinations(sets, 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            expected = Counter(i for i, root in grouped(pairs, given).items() if i == root)
        elif name == "mixing sources":
            taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
            expected = Counter({i: math.floor(t.taken / max(1, t["size"]) + 0.5) for i, t in taken.items()})
            expected = +expected
        else:
            pieces = piece_sampling.pieces_of(piece_sampling.MODEL, piece_sampling.SHARPNESS)
            texts = Counter((r.doc_id, r.lang, r.source, r.text) for r in given)
            assert Counter((r.doc_id, r.lang, r.source, piece_sampling.decoded(np.array(r.ids), pieces)) for r in rows) == texts
            expected = Counter(r.doc_id for r in given)
        assert kept == expected and kept
        if name != pipeline.STAGES[-1][0]:
            assert sorted(map(str, rows)) == sorted(str(given[r.doc_id]) for r in rows)
            docs = spark.createDataFrame(rows, docs.schema)


def test_near_duplicate_stage_goes_by_texts(spark):
    import corpus_pipeline as pipeline

    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, long), (1, "another text of its own that is near nothing"), (1, "another text of its own that is near nothing"), (2, long + " more"), (2, "clean words under the second id, near nothing at all"), (None, long), (None, "no id and alone"), (None, "no id and alone"), (3, None), (4, ""), (5, ""), (6, long)]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("class", F.lit(1)).withColumn("component", F.lit(2))
    out = pipeline.near_duplicate_stage(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert kept == sorted([(1, long), rows[1], rows[4], rows[6], (3, None), (4, ""), (5, "")], key=str)


def test_stages_on_odd_tables(spark, data):
    """Empty tables, null and empty texts, repeated ids and clashing columns pass all stages."""
    import corpus_pipeline as pipeline

    docs = table(spark, data, "documents").limit(60)
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    odd = spark.createDataFrame(odd.collect(), odd.schema).withColumn("stats", F.lit("x")).withColumn("row", F.lit(1)).withColumn("taken", F.lit(1)).withColumn("ids", F.lit(0))
    for start in (odd, odd.limit(0)):
        docs = start
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, data)
            rows = out.collect()
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = spark.createDataFrame(rows, docs.schema)
        assert bool(rows) == (start is odd)


def test_mix_by_brute_force(spark):
    """Golden-ratio points, ranks and blocks of each source walked one by one, against what each document gives."""
    random.seed(6)
    rows = [(i, " ".join(["w"] * random.randrange(0, 90)), random.choice("aab") if i % 3 else "c") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block = 16
    found = mixing.mix(df, block=block).collect()
    keyed = {r.doc_id: r for r in df.select("doc_id", F.xxhash64("text").alias("t")).select("doc_id", "t", F.xxhash64(F.lit("mix"), "doc_id", "t").alias("m")).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    names = sorted({s for *_, s in rows})
    total = sum(size.values())
    taken = Counter()
    goal = {r.source: (r.source_size, r.target) for r in found}
    whole = sum(goal[s][1] for s in names)
    upto = np.cumsum([goal[s][1] / whole for s in names])
    slots = -(-total // block)
    points = [math.fmod((t + 1) * mixing.GOLDEN, 1.0) for t in range(slots)]
    hits = Counter(min(int(np.searchsorted(upto, x, side="right")), len(names) - 1) for x in points)
    for n, s in enumerate(names):
        own = [i for i, _, x in rows if x == s and size[i]]
        chunks = max(1, -(-len(own) // mixing.CHUNK))
        own.sort(key=lambda i: ((keyed[i].m >> 20) % chunks, keyed[i].m, size[i], keyed[i].t))
        words = [i for i in own for _ in range(size[i])]
        count = max(-(-len(words) // block), min(len(words), mixing.LEAST))
        step = -(-len(words) // count)
        blocks = -(-len(words) // step)
        each = max(1, round(block / step))
        ranks = min(round(goal[s][1] * blocks / goal[s][0]), 3 * blocks)
        assert abs(hits[n] * each - ranks) <= max(each + 1, 0.02 * ranks)  # the points alone come near the target
        for r in range(ranks):
            taken.update(words[(r % blocks) * step : (r % blocks + 1) * step])
    assert {r.doc_id: r.taken for r in found} == {i: taken[i] for i in size}


def test_all_are_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLE) <= set(QUERIES)


def test_tree_holds_nearly_equal_directions():
    """Vectors of one direction, told apart by rounding or one last bit: every one stays a leaf, and all link."""
    random_ = np.random.default_rng(6)

    def leaves(node):
        return [node.centre] if not node.below else [x for b in node.below for x in leaves(b)]

    for _ in range(100):
        v = random_.normal(size=64).astype(np.float32)
        bit = v.copy()
        bit[0] = np.nextafter(v[0], np.float32(9), dtype=np.float32)
        for group in ([v, 2 * v], [v, 3 * v], [v, 2 * v, 3 * v, bit], [v, bit]):
            x = np.array(group, float)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            tree = cover_tree.build(x)
            assert sorted(leaves(tree)) == list(range(len(x)))
            a, b = cover_tree.linked(x, x, tree, tree, 0.93)
            assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(x) ** 2


@pytest.mark.parametrize("block", [7, 1024])
def test_small_sources_meet_their_targets(spark, monkeypatch, block):
    """A source of few words beside large ones is taken as often as its target says, whatever the size of the table's blocks."""
    monkeypatch.setattr(mixing, "CHUNK", 7)
    monkeypatch.setattr(mixing, "FEW", 5)
    sizes = {"a": 100_000, "b": 100, "c": 20_000, "d": 1, "e": 200_000, "f": 60}
    rows, i = [], 0
    for source, n in sizes.items():
        while n > 0:
            rows.append((i, "w " * min(n, 25), source))
            n, i = n - 25, i + 1
    taken, goal = Counter(), {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=block).collect():
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - goal[s]) <= 0.005 * goal[s] + 1 for s in sizes)


def test_left_out_language_and_noise_are_rejected(spark):
    """Full-length texts of a language that was left out of learning, and of random letters, are rejected; those learned are not."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("length(text) > 300")
    learn = fold(F.col("doc_id"), 4) != 2
    left_out = docs.groupBy("lang").count().orderBy("count").first().lang
    random.seed(8)
    noise = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") if random.random() < 0.85 else " " for _ in range(n)) for n in (100, 1000, 3000)]
    noise += ["".join(chr(random.randrange(0x4E00, 0x9FA5)) for _ in range(3000))]
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa " * 5
    model = langid.fit(docs.where(learn & (F.col("lang") != left_out)))
    texts = spark.createDataFrame([(t,) for t in [*noise, polish]], "text string")
    assert texts.where(langid.accepter(model)("text")).count() == 0
    foreign, own = docs.where(~learn & (F.col("lang") == left_out)), docs.where(~learn & (F.col("lang") != left_out))
    assert foreign.where(langid.accepter(model)("text")).count() <= 0.02 * foreign.count()
    assert own.where(langid.accepter(model)("text")).count() >= 0.98 * own.count()
