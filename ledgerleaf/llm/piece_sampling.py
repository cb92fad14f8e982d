"""Sampled segmentation into the pieces of a SentencePiece model, and lossless decoding.

A text is cut at spaces and line ends into chunks; the lattice of a chunk has an edge for every piece that fits. Forward filtering
gives each place the total weight of the paths that reach it, backward sampling walks from the end, taking an edge with its share
of that weight. The random numbers are a hash of the row's key, the chunk's number and the step, so a row is segmented alike in
every run and partition. Chunks of many rows are walked together, one array step for each piece taken.

Characters without a piece become byte pieces, a literal piece-space mark too, so decoding returns every text exactly.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from ledgerleaf.llm.common import attached

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Exponent of the pieces' probabilities: below 1 flatter, above 1 nearer to the best path.
SHARPNESS = 1.0
#: Weight for each unit that a piece covers; it is the same for all paths of a chunk, and keeps long products in range.
UNIT = 64.0
#: Characters of the texts walked together; most characters of a chunk whose lattice is built with those of others.
TOGETHER, SHORT = 500_000, 40
CHUNK = re.compile(r" ?[^ \n]+|\n+| +")
_LIMIT = 1e100


class Pieces:
    """The vocabulary as a tree of characters; pieces are ranked, the probability of rank r falls as 1 / (r + 10).

    The tree is kept twice: as nested dicts for single chunks, and as arrays for many: ``kind`` numbers the characters, and a hash
    table by node and character gives the next node.
    """

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        self.text: list[bytes] = [b""] * model.vocab_size()
        self.tree: dict = {}
        self.weights = np.full(model.vocab_size(), UNIT)
        for i in plain:
            piece = model.id_to_piece(i).replace(SPACE, " ")
            self.text[i] = piece.encode()
            self.weights[i] = (10.0 + rank[i]) ** -sharpness * UNIT ** len(piece)
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node.setdefault(None, i)
        self.byte = np.zeros(256, np.int32)
        for i in range(model.vocab_size()):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte[value], self.text[i] = i, bytes([value])
        self._arrays()

    def _arrays(self) -> None:
        self.kind = np.zeros(0x110000, np.int32)
        for n, c in enumerate(sorted(c for c, node in self.tree.items() if None in node), 1):
            self.kind[ord(c)] = n
        self.kinds = int(self.kind.max()) + 1
        ends, steps, todo = [-1], [], [(0, self.tree)]
        while todo:
            at, node = todo.pop()
            for c, below in node.items():
                if c is not None and self.kind[ord(c)]:
                    steps.append((at * self.kinds + int(self.kind[ord(c)]), len(ends)))
                    todo.append((len(ends), below))
                    ends.append(below.get(None, -1))
        self.ends = np.array(ends, np.int32)
        self.slots = 1 << (len(steps) * 4).bit_length()
        self.keys, self.next = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32)
        for key, to in steps:
            slot = self._slot(key)
            while self.keys[slot] >= 0:
                slot = (slot + 1) % self.slots
            self.keys[slot], self.next[slot] = key, to

    def _slot(self, key: int | np.ndarray) -> int | np.ndarray:
        return (key * 40503 ^ key >> 7) & (self.slots - 1)

    def _step(self, key: np.ndarray) -> np.ndarray:
        """The node that each key of node and character leads to; 0 where there is none."""
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.next[slot], 0)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (self.slots - 1)
            found = self.keys[slot[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.next[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def lattices(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For chunks of at most SHORT characters: units of each, and edges in the order of their ends: end plus cumulated share,
        origin, piece. Ends and origins are places; a chunk of n units has n + 1 of them."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        unit = self.kind[points]
        unknown = unit == 0
        if unknown.any():
            odd = points[unknown]
            wide = np.ones(len(points), np.int64)
            wide[unknown] = 1 + (odd >= 0x80) + (odd >= 0x800) + (odd >= 0x10000)
            raw = np.frombuffer(odd.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            unit = np.repeat(unit, wide)
            unit[unit == 0] = -1 - raw.astype(np.int32)
            total = np.concatenate([[0], np.cumsum(wide)])
            ends = np.cumsum(lengths)
            lengths = total[ends] - total[ends - lengths]
        owner = np.repeat(np.arange(len(chunks)), lengths)
        stop = np.cumsum(lengths)[owner]
        origins, sizes, pieces = [], [], []
        raw_at = np.flatnonzero(unit < 0)
        if len(raw_at):
            origins, sizes, pieces = [raw_at], [np.ones(len(raw_at), np.int64)], [self.byte[-1 - unit[raw_at]]]
        at, node, size = np.flatnonzero(unit > 0), 0, 0
        while len(at):
            node = self._step(node * np.int64(self.kinds) + unit[at + size])
            size += 1
            at, node = at[node > 0], node[node > 0]
            got = self.ends[node]
            good = got >= 0
            origins.append(at[good])
            sizes.append(np.full(int(good.sum()), size))
            pieces.append(got[good])
            more = at + size < stop[at]
            more[more] = unit[at[more] + size] > 0
            at, node = at[more], node[more].astype(np.int64)
        origin, size, piece = map(np.concatenate, (origins, sizes, pieces))
        start = origin + owner[origin]
        end = start + size
        order = np.argsort(end, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        first = np.cumsum(lengths + 1) - lengths - 1
        level = (end - first[owner[origin[order]]]).astype(np.int16)
        by_level = np.argsort(level, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(level))])
        weight, reach = self.weights[piece], np.zeros(len(unit) + len(chunks))
        reach[first] = 1.0
        share = np.empty(len(end))
        for a, b in zip(cuts[1:-1], cuts[2:], strict=True):
            now = by_level[a:b]
            share[now] = reach[start[now]] * weight[now]
            np.add.at(reach, end[now], share[now])
        share /= reach[end]
        run = np.cumsum(share)
        heads = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        last = np.concatenate([heads[1:], [len(end)]]) - 1
        cumulated = run - np.repeat(run[heads] - share[heads], last - heads + 1)
        cumulated[last] = 1.0
        return lengths, end + np.minimum(cumulated, 1.0), start, piece

    def lattice(self, chunk: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """The same for one chunk of any length."""
        tree, weights = self.tree, self.weights
        units: list = []
        for c in chunk:
            units.extend([c] if None in tree.get(c, ()) else c.encode("utf-8", "surrogatepass"))
        n = len(units)
        reach, into = [0.0] * (n + 1), [[] for _ in range(n + 1)]
        reach[0] = 1.0
        for at in range(n):
            here = reach[at]
            if here > _LIMIT or here < 1 / _LIMIT:  # what lies ahead is scaled; shares are taken before that
                for ahead in range(at + 1, min(n, at + 64) + 1):
                    reach[ahead] /= here
                    into[ahead] = [(w / here, j, i) for w, j, i in into[ahead]]
                here = reach[at] = 1.0
            if isinstance(units[at], int):
                w = here * UNIT
                reach[at + 1] += w
                into[at + 1].append((w, at, int(self.byte[units[at]])))
                continue
            node, to = tree, at
            while to < n:
                node = node.get(units[to])
                if node is None:
                    break
                to += 1
                piece = node.get(None)
                if piece is not None:
                    w = here * float(weights[piece])
                    reach[to] += w
                    into[to].append((w, at, piece))
        share, origin, piece = array("d"), array("l"), array("i")
        for place, edges in enumerate(into[1:], 1):
            whole, so_far = sum(e[0] for e in edges), 0.0
            for w, j, i in edges:
                so_far += w / whole
                share.append(place + min(so_far, 1.0))
                origin.append(j)
                piece.append(i)
            share[-1] = place + 1.0
        return n, np.frombuffer(share), np.frombuffer(origin, np.int64), np.frombuffer(piece, np.int32)


@lru_cache(4)
def pieces_of(path: str, sharpness: float) -> Pieces:
    return Pieces(path, sharpness)


def _uniform(seed: np.ndarray, number: np.ndarray, step: int) -> np.ndarray:
    """In [0, 1): a mixing hash of the row's seed, the chunk's number in the row and the step."""
    with np.errstate(over="ignore"):
        z = seed + number * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def sample(texts: list[str], keys: list, vocabulary: Pieces, salt: int = 0) -> list[np.ndarray]:
    """Piece ids (int32) of each text."""
    index: dict[str, int] = {}
    which, chunks_of = array("i"), []
    for text in texts:
        parts = CHUNK.findall(text)
        which.extend([index.setdefault(p, len(index)) for p in parts])
        chunks_of.append(len(parts))
    if not which:
        return [np.zeros(0, np.int32) for _ in texts]
    short = [len(c) <= SHORT for c in index]
    lengths, base = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
    places, parts = 0, []
    if any(short):
        at = np.flatnonzero(short)
        lengths[at], *edges = vocabulary.lattices([c for c, s in zip(index, short, strict=True) if s])
        base[at] = np.cumsum(lengths[at] + 1) - lengths[at] - 1
        parts, places = [edges], int((lengths[at] + 1).sum())
    for i, chunk in enumerate(index):
        if not short[i]:
            lengths[i], cumulated, origin, piece = vocabulary.lattice(chunk)
            base[i] = places
            parts.append([cumulated + places, origin + places, piece])
            places += int(lengths[i]) + 1
    cumulated, before, ids = map(np.concatenate, zip(*parts, strict=True))
    #: First edge of each place; a place's edges stand together, their values lie above the place and reach the next whole number.
    entry = np.searchsorted(cumulated, np.arange(places), side="right")
    which_, chunks = np.frombuffer(which, np.int32), np.array(chunks_of)
    first = np.concatenate([[0], np.cumsum(chunks)])
    number = (np.arange(len(which_)) - np.repeat(first[:-1], chunks)).astype(np.uint64)
    seed = np.repeat(np.array([xxhash.xxh64_intdigest(f"{salt}\x00{k}") for k in keys], np.uint64), chunks)
    at, active, taken = base[which_] + lengths[which_], np.arange(len(which_)), []
    steps = np.zeros(len(which_), np.int64)
    step = 0
    while len(active):
        here = at[active]
        edge, least = entry[here], here + np.minimum(_uniform(seed[active], number[active], step), 1 - 1e-9)
        late = np.flatnonzero(cumulated[edge] <= least)
        while len(late):
            edge[late] += 1
            late = late[cumulated[edge[late]] <= least[late]]
        taken.append((active, ids[edge]))
        at[active] = before[edge]
        steps[active] += 1
        active = active[before[edge] > base[which_[active]]]
        step += 1
    after = np.cumsum(steps)
    out = np.empty(int(after[-1]), np.int32)
    for i, (where, got) in enumerate(taken):
        out[after[where] - 1 - i] = got
    ends = np.concatenate([[0], after])[first]
    return [out[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decoded(ids: np.ndarray, vocabulary: Pieces) -> str:
    text = vocabulary.text
    return b"".join([text[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")


def _ranges(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of the rows, in order, of some TOGETHER characters, or one row if its text is longer."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= TOGETHER:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sampled(keys: list, texts: list, vocabulary: Pieces, salt: int) -> Iterator[tuple[int, int, list]]:
    for start, end in _ranges(texts):
        ids: list = [None] * (end - start)
        known = [i for i in range(start, end) if texts[i] is not None]
        for i, got in zip(known, sample([texts[i] for i in known], [keys[i] for i in known], vocabulary, salt), strict=True):
            ids[i - start] = got
        yield start, end, ids


def encode(docs: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL, sharpness: float = SHARPNESS, salt: int = 0) -> DataFrame:
    """``docs`` (``key``, text, ...) → ``keep`` and ids, array<int>.

    Equal keys and texts get equal ids, in repeated rows too. A null text has null ids, an empty one none. A null key is a key like
    any other. Texts of any length are cut into chunks, so only the ids of one text are held whole. Other columns don't matter,
    whatever their names. An empty table gives no rows.
    """

    def each(keys: list, texts: list) -> Iterator[tuple[int, int, list]]:
        for start, end, ids in _sampled(keys, texts, pieces_of(model, sharpness), salt):
            yield start, end, [ids]

    return attached(docs, keep, (key, "text"), "ids array<int>", each)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` with ids → the same rows with text in its place; null ids give a null text. A column text that is there already is replaced."""
    keep = [c for c in rows.columns if c not in ("ids", "text")]

    def each(ids: list) -> Iterator[tuple[int, int, list]]:
        vocabulary = pieces_of(model, SHARPNESS)
        yield 0, len(ids), [[None if x is None else decoded(np.asarray(x, np.int32), vocabulary) for x in ids]]

    return attached(rows, tuple(keep), ("ids",), "text string", each)


def round_trip(docs: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL, sharpness: float = SHARPNESS, salt: int = 0) -> DataFrame:
    """``keep`` with n_pieces, ids_sha256 (of little-endian int32), decoded_sha256 (UTF-8) and lossless, whether decoding gives the text.

    Encodes and decodes in one pass, whole texts of any length. A null text has 0 pieces, null digests and is lossless. Repeated
    rows are answered one by one; other columns don't matter; an empty table gives no rows.
    """

    def each(keys: list, texts: list) -> Iterator[tuple[int, int, list]]:
        vocabulary = pieces_of(model, sharpness)
        for start, end, ids in _sampled(keys, texts, vocabulary, salt):
            back = [None if x is None else decoded(x, vocabulary) for x in ids]
            yield start, end, [
                [0 if x is None else len(x) for x in ids], [None if x is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids],
                [None if x is None else hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back], [x == t for x, t in zip(back, texts[start:end], strict=True)],
            ]

    return attached(docs, keep, (key, "text"), "n_pieces int, ids_sha256 string, decoded_sha256 string, lossless boolean", each)
