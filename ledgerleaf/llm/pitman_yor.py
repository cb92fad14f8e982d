"""Hierarchical Pitman-Yor language model over words.

A restaurant for each context of two preceding words holds the words seen there. A table of it is a customer of the restaurant of
the nearer word alone, a table of that one a customer of the root. The root's base is diffuse: every word seen has one table there,
and what the root leaves to new tables is the probability of the one type that stands for all words never seen.

Seatings are sampled by Gibbs: the tables of one dish are drawn anew from their distribution given its customers, the restaurant's
tables with other dishes and the parent's share, for all dishes of a level, level after level. A score is the sum of its tokens'
log10 probabilities, each averaged over the kept seatings.

The tokens of all texts are dealt once by their nearer word, so a token's two restaurants stand in one partition, and shuffled as
compressed arrays; every round reads the same shuffle again. A round starts from the root that the round before has left, sweeps
its own restaurants and hands the root its new customers, a sum over all partitions for each word. The last round prices every
token. Nothing is collected but sums over all words and the few frequent contexts. Those with more than LIMIT tokens (or a part
2 ** -17 of all) have several restaurants, so that none outgrows a task: a nearer word one for each class of farther words, a pair
of words one for each class of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import ROWS, WordHasher, mixed, release, saved

#: Rounds that only bring the root up to date, sweeps of a round before its first kept seating, and kept seatings.
ROUNDS, BURN, KEPT = 2, 2, 2
STRENGTH, SEED = 1.0, 20260101
#: Customers of a dish up to which its tables are drawn from their exact distribution; beyond, seated in groups that grow by this part.
EXACT, GROUP = 256, 0.06
#: Ids of the token after the last word and of the places before the first one.
END, START = np.uint64(1), np.uint64(2)
#: Tokens of a partition, tokens of a restaurant of one word, tokens that a task holds before it hands them on, buckets of the first count.
PART, LIMIT, HELD, BUCKETS = 1_800_000, 1 << 20, 2_200_000, 1 << 16
#: Words that are written as numbers of a list that all tasks have, and how many each task proposes. Which ones are on it changes no result.
COMMON, PROPOSED = 1 << 15, 1 << 13


def packed(*arrays: np.ndarray) -> tuple:
    """Arrays as compressed bytes. Of hashes (uint64) only the upper two bytes are, as others look random; of numbers the bytes of one weight stand together, upper ones that are all zero are left out."""
    out = []
    for a in arrays:
        plain = a.view(np.uint8).reshape(len(a), 8)[:, :6].tobytes() if a.dtype == np.uint64 else b""
        raw = (a >> np.uint64(48)).astype(np.uint16) if plain else a.view(f"u{a.itemsize}")
        size = max(1, (int(raw.max(initial=0)).bit_length() + 7) // 8)
        planes = [(raw >> raw.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(size)]
        out.append((a.dtype.str, len(a), size, plain, pa.compress(b"".join(planes), codec="zstd", asbytes=True)))
    return tuple(out)


def unpacked(told: tuple) -> list[np.ndarray]:
    out = []
    for kind, n, size, plain, rest in told:
        planes = np.frombuffer(pa.decompress(rest, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
        x = np.zeros(n, np.uint16 if plain else f"u{np.dtype(kind).itemsize}")
        for i, plane in enumerate(planes):
            x |= plane.astype(x.dtype) << x.dtype.type(8 * i)
        if plain:
            whole = np.empty((n, 8), np.uint8)
            whole[:, :6] = np.frombuffer(plain, np.uint8).reshape(n, 6)
            whole[:, 6:] = x.view(np.uint8).reshape(n, 2)
            x = whole.reshape(-1)
        out.append(x.view(kind))
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def stream(texts: list[bytes | None], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Ids of START, START, words, END of each text, one text after another, and where the texts begin."""
    ids, at = hasher(b"\n".join(t or b"" for t in texts))
    begin = np.cumsum([0, *[len(t or b"") + 1 for t in texts]])
    which = np.searchsorted(begin, at, side="right") - 1
    words = np.bincount(which, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(words + 3)])
    out = np.full(int(first[-1]), START, np.uint64)
    out[np.arange(len(ids)) + 3 * which + 2] = ids
    out[first[1:] - 1] = END
    return out, first


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), ROWS):
            yield b.slice(at, ROWS)
    release()


def pair_ids(far: np.ndarray, near: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(far * np.uint64(0xD1B54A32D192ED03) + near)


def class_ids(ids: np.ndarray, turn: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(ids + (turn + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def places_of(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the tokens, END included, in a stream."""
    inside = np.ones(len(ids), bool)
    inside[first[:-1]] = inside[first[:-1] + 1] = False
    return np.flatnonzero(inside)


def frequent(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of tokens of ``rows`` (text: binary); contexts of one and two words with more tokens than the limit, sorted, and how many restaurants each has; common words, sorted."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        hasher = WordHasher()
        for b in _batches(batches):
            ids, first = stream(b.column("text").to_pylist(), hasher)
            to = places_of(ids, first)
            yield np.concatenate([ids[to - 1], pair_ids(ids[to - 2], ids[to - 1])])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words, times = np.zeros(BUCKETS, np.int64), np.zeros(0, np.uint64), np.zeros(0)
        for ids in contexts(batches):
            n += np.bincount((ids % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            own, seen = np.unique(ids[: len(ids) // 2], return_counts=True)
            words, at = np.unique(np.concatenate([words, own]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, seen]))
            if len(words) > 8 * PROPOSED:
                most = np.argpartition(-times, 4 * PROPOSED)[: 4 * PROPOSED]
                words, times = words[most], times[most]
        most, at = np.argsort(-times, kind="stable")[:PROPOSED], np.flatnonzero(n)
        columns = [False] * len(at) + [True] * len(most), np.concatenate([at, words[most].view(np.int64)]), np.concatenate([n[at], times[most].astype(np.int64)])
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["word", "at", "n"])

    told = saved(rows.select("text").mapInArrow(buckets, "word boolean, at long, n long").groupBy("word", "at").agg(F.sum("n").alias("n")))
    counts = told.where("not word").toPandas()
    common = np.sort(told.where("word").orderBy(F.desc("n"), "at").limit(COMMON).toPandas()["at"].to_numpy(np.int64).view(np.uint64))
    total = int(counts["n"].sum()) // 2
    limit = max(LIMIT, total >> 17)
    heavy = counts.loc[counts["n"] > limit, "at"].to_numpy(np.uint64)
    if not len(heavy):
        return total, np.zeros(0, np.uint64), np.zeros(0, np.uint64), common

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighty = np.zeros(BUCKETS, bool)
        weighty[heavy.astype(np.int64)] = True
        for ids in contexts(batches):
            kinds, n = np.unique(ids[weighty[(ids % np.uint64(BUCKETS)).astype(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], ["at", "n"])

    # at most 2 ** 18 contexts can have more than the limit
    words = rows.select("text").mapInArrow(exact, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") > limit).toPandas()
    ids, n = words["at"].to_numpy(np.int64).view(np.uint64), words["n"].to_numpy()
    order = np.argsort(ids)
    return total, ids[order], -(-n[order] // limit).astype(np.uint64), common


def split_contexts(far: np.ndarray, near: np.ndarray, row: np.ndarray, often: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``far`` and ``near`` (ids) of tokens with those of frequent contexts in the place of their own: of a frequent pair one for each class of
    rows, of a frequent nearer word one for each class of farther ones."""
    far, near, pair = far.copy(), near.copy(), pair_ids(far, near)
    at = np.minimum(np.searchsorted(often, pair), len(often) - 1)
    hot = np.flatnonzero(often[at] == pair)
    far[hot] = pair[hot] = class_ids(pair[hot], mixed(row[hot].astype(np.uint64)) % classes[at[hot]])
    at = np.minimum(np.searchsorted(often, near), len(often) - 1)
    hot = np.flatnonzero(often[at] == near)
    near[hot] = class_ids(near[hot], pair[hot] % classes[at[hot]])
    return far, near


def dealt(batches: Iterator[pa.RecordBatch], parts: int, often: np.ndarray, classes: np.ndarray, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (part, blob) of the tokens of ``batches`` (row, doc_id, learn, text): farther word, nearer word or its class, word, row."""
    hasher, held, size = WordHasher(), [], 0

    def out() -> Iterator[pa.RecordBatch]:
        rows, learn, flow, lengths = (np.concatenate([h[i] for h in held]) for i in range(4))
        named = [x for h in held for x in h[4]]
        held.clear()
        kinds, at = np.unique(flow, return_inverse=True)
        at = at.astype(np.int32)
        to = places_of(flow, np.cumsum([0, *lengths]))
        far, near, word, key = at[to - 2], at[to - 1], at[to], kinds
        owner = np.repeat(np.arange(len(rows)), lengths)[to]
        if len(often):
            changed = split_contexts(flow[to - 2], flow[to - 1], rows[owner], often, classes)
            hot = [np.flatnonzero(c != flow[to - n]) for c, n in zip(changed, (2, 1), strict=True)]
            extra, turn = np.unique(np.concatenate([c[h] for c, h in zip(changed, hot, strict=True)]), return_inverse=True)
            far[hot[0]], near[hot[1]] = len(kinds) + turn[: len(hot[0])], len(kinds) + turn[len(hot[0]) :]
            key = np.concatenate([kinds, extra])
        spot = np.minimum(np.searchsorted(common, key), max(0, len(common) - 1))
        known = common[spot] == key if len(common) else np.zeros(len(key), bool)
        part = (key % np.uint64(parts)).astype(np.int64)[near]
        ends = np.cumsum(lengths - 2) - 1
        order = np.argsort(part.astype(np.uint16) if parts <= 65536 else part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        is_end = np.zeros(len(to), bool)
        is_end[ends] = True
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = order[a:b]
            n = len(mine)
            own, local = used_of(np.concatenate([far[mine], near[mine], word[mine]]), known)
            listed = own[known[own]]
            texts, row = np.unique(owner[mine], return_inverse=True)
            names = [named[i] for i in owner[mine[is_end[mine]]]]
            blob = packed(spot[listed].astype(np.uint32), key[own[len(listed) :]], local[:n], local[n : 2 * n], local[2 * n :], np.diff(row, prepend=0).astype(np.uint32), np.diff(rows[texts], prepend=0), learn[texts].astype(np.uint8)), names
            yield pa.RecordBatch.from_arrays([pa.array([int(part[mine[0]])], pa.int32()), pa.array([pickle.dumps(blob)], pa.binary())], ["part", "blob"])

    for b in _batches(batches):
        if not len(b):
            continue
        ids, first = stream(b.column("text").to_pylist(), hasher)
        rows = b.column("row").to_numpy()
        held.append((rows, np.asarray(b.column("learn").to_pylist(), bool), ids, np.diff(first), b.column("doc_id").to_pylist()))
        size += len(ids)
        if size > HELD:
            yield from out()
            size = 0
    if held:
        yield from out()
    release()


def used_of(at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that ``at`` holds, those that are ``first`` before others and else frequent ones, and ``at`` as places among them."""
    n = np.bincount(at, minlength=len(first))
    kinds = np.flatnonzero(n)
    kinds = kinds[np.lexsort((-n[kinds], ~first[kinds]))]
    turn = np.zeros(len(first), np.uint32)
    turn[kinds] = np.arange(len(kinds), dtype=np.uint32)
    return kinds, turn[at]


def log_partitions(discount: float, most: int) -> np.ndarray:
    """[c, t]: log of the weight of all seatings of c customers at t tables (generalised Stirling numbers)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], out[c, 1 : c + 2] + np.log(np.maximum(c - discount * t, 0)))
    return out


def tables_of(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of each dish drawn given its ``customers``, ``others``, the restaurant's tables with other dishes, and ``parent``, its share there."""
    tables = np.minimum(customers, 1).astype(np.int64)
    some = np.flatnonzero((customers > 1) & (customers <= EXACT))
    some = some[np.argsort(customers[some], kind="stable")]
    stirling = log_partitions(discount, int(customers[some[-1]])) if len(some) else None
    cuts = np.flatnonzero(np.diff(customers[some], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        c = int(customers[some[a]])
        for at in range(a, b, max(1, 2_000_000 // c)):
            mine = some[at : min(b, at + max(1, 2_000_000 // c))]
            opened = np.cumsum(np.log(STRENGTH + discount * (others[mine, None] + np.arange(c))), axis=1)
            weight = stirling[c, 1 : c + 1] + opened + np.arange(1, c + 1) * np.log(parent[mine, None])
            weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            upto = np.cumsum(weight, axis=1)
            tables[mine] = 1 + (upto < random.random(len(mine))[:, None] * upto[:, -1:]).sum(axis=1)
    active, seated = np.flatnonzero(customers > EXACT), 1.0
    while len(active):
        group = np.minimum(customers[active] - seated, np.ceil(seated * GROUP))
        t = tables[active]
        new = (STRENGTH + discount * (others[active] + t)) * parent[active]
        p = new / (new + np.maximum(seated - discount * t, 1e-9))
        tables[active] = t + random.binomial(group.astype(np.int64), np.clip(p, 0, 1))
        seated += float(np.ceil(seated * GROUP))
        active = active[customers[active] > seated]
    return np.minimum(tables, np.maximum(customers, 0).astype(np.int64))


def discount_of(customers: np.ndarray) -> float:
    once, twice = int((customers == 1).sum()), int((customers == 2).sum())
    return float(np.clip((once + 1) / (once + 2 * twice + 2), 0.05, 0.95))


class Restaurants:
    """The restaurants of a partition, from ``tokens`` (far, near, word: places in ``ids``; row) and whether each row is learned from.

    Types are distinct (near, far, word), pairs distinct (near, word). A type that isn't learned from has no customers.
    """

    def __init__(self, ids: np.ndarray, tokens: list[np.ndarray], learn: np.ndarray):
        self.ids, self.learn = ids, learn
        far, near, word, row = tokens
        tokens.clear()
        bits = max(1, int(len(ids) - 1).bit_length())
        key = near.astype(np.int64)
        key <<= bits
        key |= far
        kinds = None
        if 3 * bits > 63:
            kinds, key = np.unique(key, return_inverse=True)
        key <<= bits
        key |= word
        del far, near, word
        order = np.argsort(key)
        self.row = row[order].astype(np.int32)
        del row
        key = key[order]
        del order
        head = np.flatnonzero(np.diff(key, prepend=-1))
        self.type = np.repeat(np.arange(len(head), dtype=np.int32), np.diff(head, append=len(key)))
        self.count = np.add.reduceat(learn[self.row].astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
        key, mask = key[head], (1 << bits) - 1
        self.word = (key & mask).astype(np.int32)
        key >>= bits
        self.context = (np.cumsum(np.diff(key, prepend=-1) != 0) - 1).astype(np.int32)
        key = (kinds[key] if kinds is not None else key) >> bits << bits | self.word
        order = np.argsort(key)
        key = key[order]
        head = np.flatnonzero(np.diff(key, prepend=-1))
        self.pair = np.empty(len(key), np.int32)
        self.pair[order] = np.repeat(np.arange(len(head), dtype=np.int32), np.diff(head, append=len(key)))
        key = key[head]
        self.pair_word = (key & mask).astype(np.int32)
        self.pair_near = (np.cumsum(np.diff(key >> bits, prepend=-1) != 0) - 1).astype(np.int32)
        self.size = np.bincount(self.context, self.count, minlength=int(self.context[-1]) + 1) if len(self.context) else np.zeros(0)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` of all that occurs as a word, and how often training has it."""
        used = np.zeros(len(self.ids), bool)
        used[self.pair_word] = True
        at = np.flatnonzero(used)
        return at, np.bincount(self.word, self.count, minlength=len(self.ids))[at].astype(np.int64)

    def sweeps(self, root: np.ndarray, seed: list[int], most: int) -> Iterator[tuple[Callable[[], np.ndarray], np.ndarray]]:
        """After each of ``most`` sweeps a function that gives the probability of each type's word in its context, and the tables of each pair.

        ``root`` is the root's probability of each of ``ids``."""
        random = np.random.default_rng(seed)
        near = int(self.pair_near[-1]) + 1 if len(self.pair_near) else 0
        above = root[self.pair_word]
        again = np.flatnonzero(self.count > 1)
        own, pair, context = self.count[again], self.pair[again], self.context[again]
        t2, d2 = np.minimum(self.count, 1), discount_of(self.count)
        customers, t1 = self._customers(t2)
        p1 = self._shares(customers, t1, self.pair_near, np.bincount(self.pair_near, customers, minlength=near), d2, above)
        for _ in range(most):
            opened = np.bincount(self.context, t2, minlength=len(self.size))[context]
            t2[again] = tables_of(own, opened - t2[again], p1[pair], d2, random)
            opened = np.bincount(self.pair_near, t1, minlength=near)[self.pair_near] - t1
            customers, t1 = self._customers(t2)
            d1, more = discount_of(customers), np.flatnonzero(customers > 1)
            t1[more] = tables_of(customers[more], opened[more], above[more], d1, random)
            p1 = self._shares(customers, t1, self.pair_near, np.bincount(self.pair_near, customers, minlength=near), d1, above)
            yield partial(self._shares, self.count, t2, self.context, self.size, d2, p1[self.pair]), t1

    def _customers(self, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers of each pair, the ``tables`` of its types, and one table for each that has any."""
        customers = np.bincount(self.pair, tables, minlength=len(self.pair_word)).astype(np.int64)
        return customers, np.minimum(customers, 1)

    @staticmethod
    def _shares(customers: np.ndarray, tables: np.ndarray, place: np.ndarray, size: np.ndarray, discount: float, above: np.ndarray) -> np.ndarray:
        """Probability of each dish in its restaurant (``place``, of ``size`` customers): its tables' share, and the parent's (``above``)."""
        whole = STRENGTH + size
        left = (STRENGTH + discount * np.bincount(place, tables, minlength=len(size))) / whole
        return np.maximum(customers - discount * tables, 0) / whole[place] + left[place] * above


def _gathered(part: Iterator[tuple], common: np.ndarray) -> tuple[Restaurants, np.ndarray, list, dict[int, np.ndarray]]:
    """The restaurants of a partition, its rows' numbers, (row, doc_id) of the texts that end here, and what the root has sent."""
    own, sent = [], {}
    for _, told in part:
        if isinstance(told, bytes):
            arrays, names = pickle.loads(told)  # noqa: S301  made by dealt()
            listed, others, *rest = unpacked(arrays)
            own.append((np.concatenate([common[listed], others]), *rest, names))
        else:
            sent[told[0]] = told[1]
    ids = distinct(np.concatenate([o[0] for o in own])) if own else np.zeros(0, np.uint64)
    columns, rows, learn, ended, base = [[], [], [], []], [], [], [], 0
    for kinds, far, near, word, row, texts, mark, names in own:
        to = np.searchsorted(ids, kinds).astype(np.int32)
        for column, x in zip(columns, (far, near, word), strict=False):
            column.append(to[x])
        row, texts = np.cumsum(row.astype(np.int64)), np.cumsum(texts)
        columns[3].append((row + base).astype(np.int32))
        if names:
            # ends stand in the order of their rows, one for each
            ended.append((texts[row[kinds[word] == END]], names))
        rows.append(texts)
        learn.append(mark.astype(bool))
        base += len(texts)
    own.clear()
    for i, c in enumerate(columns):
        columns[i] = np.concatenate(c) if c else np.zeros(0, np.int32)
        c.clear()
    every = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return Restaurants(ids, columns, np.concatenate(learn) if learn else np.zeros(0, bool)), every, ended, sent


def _root(r: Restaurants, at: np.ndarray, sent: dict[int, np.ndarray], owner: np.ndarray, known: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """The root's probability of each of ``ids`` (of those at ``at``), and their counts in training; from this partition's counts where the root has sent none."""
    root, count = np.ones(len(r.ids)), np.zeros(len(r.ids))
    if known is None:
        _, own = r.words()
        root[at] = (own + 0.5) / (own.sum() + 0.5 * len(own) + 1)
        return root, count
    customers = np.zeros(len(at))
    for q, told in sent.items():
        mine = np.flatnonzero(owner == q)
        count[at[mine]], customers[mine] = unpacked(told)
    left = (STRENGTH + known["discount"] * known["kinds"]) / (STRENGTH + known["customers"])
    root[at] = np.where(customers > 0, (customers - known["discount"]) / (STRENGTH + known["customers"]), left)
    return root, count


def swept(number: int, part: Iterator[tuple], parts: int, common: np.ndarray, known: dict | None, round_: int) -> Iterator[tuple]:
    """(q, (number, ids, counts, customers)): the words of partition ``number`` for the root's shares q after a round."""
    r, _, _, sent = _gathered(part, common)
    if len(r.ids):
        at, count = r.words()
        owner = (mixed(r.ids[at].copy()) % np.uint64(parts)).astype(np.int64)
        root, _ = _root(r, at, sent, owner, known)
        *_, (_, tables) = r.sweeps(root, [SEED, round_, number], BURN)
        customers = np.bincount(r.pair_word, tables, minlength=len(r.ids))[at].astype(np.int64)
        for q in np.unique(owner):
            mine = owner == q
            yield int(q), (number, packed(r.ids[at[mine]], count[mine], customers[mine]))
    release()


def totalled(part: Iterator[tuple]) -> Iterator[tuple]:
    """(number, words, counts, customers) of a share of the root: for each partition what it has asked for, in its order; last, (None, all)."""
    asked = [(number, *unpacked(told)) for _, (number, told) in part]
    if asked:
        ids, at = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
        count, customers = (np.bincount(at, np.concatenate([a[i] for a in asked]), len(ids)).astype(np.int64) for i in (2, 3))
        ends = np.cumsum([0, *[len(a[1]) for a in asked]])
        for (number, *_), a, b in zip(asked, ends[:-1], ends[1:], strict=True):
            yield number, packed(count[at[a:b]], customers[at[a:b]])
        seen = customers > 0
        yield None, np.array([count.sum(), (count > 0).sum(), customers.sum(), seen.sum(), (customers == 1).sum(), (customers == 2).sum()])
    release()


def answered(q: int, part: Iterator[tuple]) -> Iterator[tuple]:
    return ((number, (q, told)) for number, told in totalled(part) if number is not None)


def priced(number: int, part: Iterator[tuple], parts: int, common: np.ndarray, known: dict) -> Iterator[tuple]:
    """(share of the rows, sums by row) of the tokens of a partition under the kept seatings."""
    r, rows, ended, sent = _gathered(part, common)
    if len(r.ids):
        at, _ = r.words()
        owner = (mixed(r.ids[at].copy()) % np.uint64(parts)).astype(np.int64)
        root, count = _root(r, at, sent, owner, known)
        p = sum(p() for i, (p, _) in enumerate(r.sweeps(root, [SEED, ROUNDS, number], BURN + KEPT)) if i >= BURN) / KEPT
        base = np.log10((count + 0.1) / known["whole"])
        word, own, p = r.word[r.type], r.row, np.log10(p)
        sums = [np.bincount(own, minlength=len(rows)), *[np.bincount(own, w[at], len(rows)) for w, at in ((count > 0, word), (base, word), (p, r.type))]]
        # a row may stand in several of the partition's blobs
        kinds, place = np.unique(rows, return_inverse=True)
        sums = [np.bincount(place, s, len(kinds)) for s in sums]
        share = (mixed(kinds.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        names: dict[int, list] = {}
        for some, ids in ended:
            to = (mixed(some.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            for q, row, name in zip(to.tolist(), some.tolist(), ids, strict=True):
                names.setdefault(q, []).append((row, name))
        for q in np.unique(share):
            mine = share == q
            yield int(q), (packed(kinds[mine], sums[0][mine].astype(np.int32), sums[1][mine].astype(np.int32), sums[2][mine], sums[3][mine]), names.get(int(q), []))
    release()


def summed(part: Iterator[tuple]) -> Iterator[tuple]:
    """(doc_id, n_tokens, n_known, base_score, score) of each row."""
    got = list(part)
    if got:
        arrays = [np.concatenate(x) for x in zip(*[unpacked(told) for _, (told, _) in got], strict=True)]
        names = dict(x for _, (_, some) in got for x in some)
        kinds, at = np.unique(arrays[0], return_inverse=True)
        sums = [np.bincount(at, a, len(kinds)) for a in arrays[1:]]
        for row, n, k, b, s in zip(kinds.tolist(), *[x.tolist() for x in sums], strict=True):
            name = names[row]
            yield None if name is None else int(name), int(n), int(k), b, s
    release()


def _met(tokens: RDD, told: RDD | None) -> RDD:
    """Partition by partition the tokens and what the root has sent: both are dealt alike, so nothing moves."""
    if told is None:
        return tokens
    both = tokens.union(told)
    if both.getNumPartitions() != tokens.getNumPartitions():
        raise RuntimeError("the two aren't dealt alike")
    return both


def evaluate(docs: DataFrame, learn: Column) -> DataFrame:
    """``docs`` (doc_id, text, ...) → doc_id, n_tokens, n_known, train_tokens, base_score, score; learned from the rows where ``learn`` holds.

    A null or empty text is the end token alone; texts of any length are read in stretches. Repeated rows are scored one by one,
    and each counts in training. If nothing is learned, no token is known and every token's probability is that of the unseen
    type, 1. Other columns don't matter, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col("text").cast("binary").alias("text"))
    total, often, classes, common = frequent(rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    tokens = rows.mapInArrow(partial(dealt, parts=parts, often=often, classes=classes, common=common), "part int, blob binary").rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(parts, int)
    told, known = None, None
    for round_ in range(ROUNDS):
        asked = _met(tokens, told).mapPartitionsWithIndex(_numbered(swept, parts=parts, common=common, known=known, round_=round_)).partitionBy(parts, int)
        sums = asked.mapPartitions(totalled).filter(lambda x: x[0] is None).map(lambda x: x[1]).collect()
        count, types, customers, kinds, once, twice = reduce(np.add, sums, np.zeros(6, np.int64)).tolist()
        known = {"discount": float(np.clip((once + 1) / (once + 2 * twice + 2), 0.05, 0.95)) if kinds else 0.0, "customers": customers, "kinds": kinds, "whole": count + 0.1 * (types + 1)}
        told = asked.mapPartitionsWithIndex(answered).partitionBy(parts, int)
    found = _met(tokens, told).mapPartitionsWithIndex(_numbered(priced, parts=parts, common=common, known=known)).partitionBy(parts, int).mapPartitions(summed)
    out = spark.createDataFrame(found, "doc_id long, n_tokens long, n_known long, base_score double, score double", verifySchema=False)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(count).cast("long").alias("train_tokens"), "base_score", "score")


def _numbered(each: Callable, **fixed: object) -> Callable:
    return lambda number, part: each(number, part, **fixed)


def perplexity() -> Column:
    """Aggregate over scored rows: 10 to the mean negative score of a token."""
    return F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens"))

