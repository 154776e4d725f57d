"""Sampled SentencePiece segmentations without replacement, and decoding."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from math import exp, inf, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, ship, slices

KEPT_STATES = 400_000
BLOCK_STATES = 1 << 16
_CACHE: dict = {}
_NONE = np.zeros(0, np.int64)


class Lookup:
    """Values (from 0) of a fixed set of integer keys (from 0), -1 for others: open addressing, whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.key[slot] < 0
            self.key[slot[free]] = keys[free]
            mine = self.key[slot] == keys
            self.value[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) % len(self.key)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held, out = self.key[slot], self.value[slot]
        on = np.flatnonzero(held != keys)
        out[on] = -1
        on = on[held[on] >= 0]
        while len(on):
            slot[on] = (slot[on] + 1) % len(self.key)
            held = self.key[slot[on]]
            hit = held == keys[on]
            out[on[hit]] = self.value[slot[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out


class Words(dict):
    """First states by word (UTF-32); a word not seen before gets the next free ones and waits in `new`."""

    def __init__(self):
        self.new: list[bytes] = []
        self.states = 0

    def __missing__(self, word: bytes) -> int:
        start = self[word] = self.states
        self.states += len(word) // 4
        self.new.append(word)
        return start


class Lattice:
    """Lattices of the words seen so far, as flat tables of states and outgoing pieces.

    Texts are cut between characters that no piece holds side by side, so a text's lattice is the
    chain of its words' ones. A piece of rank r weighs
    1 / (r + 2) ** sharpness (Zipf's law over the vocabulary's own order); a character outside the
    vocabulary is one step of its UTF-8 byte pieces. States hold the distribution of the next piece
    given that the word is finished: beta(end) x weight / beta(start).
    """

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp = sp
        size = sp.get_piece_size()
        self.bytes = {i: int(sp.id_to_piece(i)[3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.of_byte = {b: i for i, b in self.bytes.items()}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in self.text.items()}
        self.weight = (-sharpness * np.log(np.arange(size) + 2.0)).tolist()
        # characters by number (0: in no piece), and the pieces as a tree: nodes are the beginnings of pieces
        chars = sorted(set("".join(self.ids)))
        number = {c: i for i, c in enumerate(chars, 1)}
        self.base = len(chars) + 1
        self.char = np.zeros(0x110000, np.int64)
        self.char[[ord(c) for c in chars]] = np.arange(1, self.base)
        node = {b: i for i, b in enumerate(sorted({p[:j] for p in self.ids for j in range(1, len(p) + 1)}, key=len))}
        self.piece_at = np.array([self.ids.get(b, -1) for b in node], np.int64)
        self.root = np.full(self.base, -1, np.int64)
        self.root[[number[b] for b in node if len(b) == 1]] = [i for b, i in node.items() if len(b) == 1]
        deep = [(node[b[:-1]] * self.base + number[b[-1]], i) for b, i in node.items() if len(b) > 1]
        self.tree = Lookup(*np.array(deep, np.int64).reshape(-1, 2).T)
        pairs = {(p[j], p[j + 1]) for p in self.ids for j in range(len(p) - 1)}
        pairs = np.array([number[a] * self.base + number[b] for a, b in pairs], np.int64)
        self.pairs = Lookup(pairs, np.zeros_like(pairs))
        self.clear()

    def clear(self) -> None:
        self.words = Words()
        self.states = self.rows = 0
        # of each row: the last row of the next state (-1 at the word's end), piece (or -1 - code point of a
        # character spelt in bytes), log probability and the state's probability from this row on; of each
        # state: its first row
        self.next, self.piece = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.lp, self.cum = np.zeros(1024), np.zeros(1024)
        self.at = np.zeros(1024, np.int64)

    def make_room(self) -> None:
        if self.states > KEPT_STATES:
            self.clear()

    def starts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The last row of each word's first state, per text, after its normalisation."""
        texts = [self.sp.normalize(t) if t else "" for t in texts]
        raw, ends = "".join(texts).encode("utf-32-le", "surrogatepass"), np.cumsum([0, *map(len, texts)])
        codes = np.frombuffer(raw, "<u4")
        char, mark = self.char[codes], codes == ord("▁")
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = (self.pairs.find(char[:-1] * self.base + char[1:]) < 0) | (mark[1:] & ~mark[:-1])
        cut[ends] = True
        cuts = np.flatnonzero(cut)
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(4 * cuts), pa.py_buffer(raw)])
        parts = parts.dictionary_encode()
        first = np.fromiter(map(self.words.__getitem__, parts.dictionary.to_pylist()), np.int64, len(parts.dictionary))
        self.freeze()
        return np.split((self.at[first + 1] - 1)[parts.indices.to_numpy()], np.searchsorted(cuts, ends[1:-1]))

    def freeze(self) -> None:
        """Append the states of the words that are new since the last call, a block of words at a time."""
        new, self.words.new = self.words.new, []
        size = np.fromiter(map(len, new), np.int64, len(new)) // 4
        block = np.cumsum(size) // BLOCK_STATES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(new)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a < z:
                self.append(b"".join(new[a:z]), size[a:z])

    def append(self, words: bytes, size: np.ndarray) -> None:
        """Append the states of words of the given sizes, all at once."""
        codes = np.frombuffer(words, "<u4").astype(np.int64)
        char, n = self.char[codes], len(codes)
        stop = np.repeat(np.cumsum(size), size)

        # (state, its end, piece, place among the state's rows), by length; bytes come last
        found, count, spelt = [], np.zeros(n, np.int64), np.ones(n, bool)
        state, node, j = np.arange(n), self.root[char], 1
        while len(state):
            on = node >= 0
            state, node = state[on], node[on]
            piece = self.piece_at[node]
            on = piece >= 0
            some = state[on]
            found.append((some, some + j, piece[on], count[some]))
            count[some] += 1
            if j == 1:
                spelt[some] = False
            on = state + j < stop[state]
            state, node = state[on], node[on]
            node = self.tree.find(node * self.base + char[state + j])
            j += 1
        some = np.flatnonzero(spelt)
        found.append((some, some + 1, -1 - codes[some], count[some]))
        count[some] += 1
        state, end, piece, place = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        at = np.concatenate([[0], np.cumsum(count)])
        row = at[state] + place
        a, z = self.rows, self.rows + len(row)
        for name, least in (("next", z), ("piece", z), ("lp", z), ("cum", z), ("at", self.states + n + 1)):
            old = getattr(self, name)
            if least > len(old):
                new = np.zeros(2 * least, old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        to = np.where(end == stop[state], n, end)
        self.next[a:z][row] = np.append(a + at[1:] - 1, -1)[to]
        self.piece[a:z][row] = piece
        weight = np.array(self.weight)[np.maximum(piece, 0)]
        if len(some):
            seen, which = np.unique(codes[some], return_inverse=True)
            weight[-len(some) :] = np.array([sum(self.weight[p] for p in self.spelling(c)) for c in seen.tolist()])[which]

        # beta of all words together, from their last characters back
        left = stop - np.arange(n)
        levels = np.cumsum(np.bincount(left))
        order = np.argsort(left.astype(np.uint16) if levels.size <= 1 << 16 else left, kind="stable")
        many = count[order]
        ends = np.concatenate([[0], np.cumsum(many)])
        begin = np.empty(n, np.int64)
        begin[order] = ends[:-1]
        by_level = begin[state] + place
        value, after, beta = np.empty(len(row)), np.empty(len(row), np.int64), np.zeros(n + 1)
        value[by_level], after[by_level] = weight, to
        for s, t in zip(levels.tolist(), levels[1:].tolist(), strict=False):
            v = value[ends[s] : ends[t]]
            v += beta[after[ends[s] : ends[t]]]
            cuts = ends[s:t] - ends[s]
            top = np.maximum.reduceat(v, cuts)
            beta[order[s:t]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many[s:t])), cuts))
        self.lp[a:z][row] = value[by_level] - beta[state]

        cum = np.exp(self.lp[a:z])
        on, j = np.flatnonzero(count > 1), 1
        while len(on):
            some = at[on + 1] - 1 - j
            cum[some] += cum[some + 1]
            j += 1
            on = on[count[on] > j]
        cum[at[:-1]] = 2.0
        self.cum[a:z] = cum
        self.at[self.states : self.states + n + 1] = a + at
        self.rows, self.states = z, self.states + n

    def spelling(self, code: int) -> list[int]:
        """Byte pieces of a character."""
        return [self.of_byte[b] for b in chr(code).encode("utf-8", "replace")]

    def spelled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of rows, with bytes in place of characters outside the vocabulary; where each row's begin, and the end)."""
        step = self.piece[rows]
        bare = np.flatnonzero(step < 0)
        many = np.ones(len(step), np.int64)
        seen, which = np.unique(-1 - step[bare], return_inverse=True)
        spelt = [self.spelling(c) for c in seen.tolist()]
        many[bare] = np.array([len(x) for x in spelt], np.int64)[which]
        at = np.concatenate([[0], np.cumsum(many)])
        out = np.repeat(step, many)
        for j in range(max(map(len, spelt), default=0)):
            on = many[bare] > j
            out[at[bare[on]] + j] = np.array([x[j] if j < len(x) else 0 for x in spelt], np.int32)[which[on]]
        return out, at

    def walk(self, starts: np.ndarray, ends: np.ndarray, rngs: list[np.random.Generator]) -> tuple[np.ndarray, np.ndarray]:
        """Sampled steps from each start (a state's last row) to its word's end: (place in `starts`, row), in text order.

        Text i has the starts from ends[i] to ends[i + 1] and draws from rngs[i].
        """
        steps, taken, alive, row = np.zeros(len(starts), np.int64), [], np.arange(len(starts)), starts.copy()
        while len(alive):
            u, cuts = np.empty(len(alive)), np.searchsorted(alive, ends)
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                rngs[i].random(out=u[cuts[i] : cuts[i + 1]])
            on = np.flatnonzero(u > self.cum[row])  # the longest piece first: mostly it is the likeliest
            while len(on):
                row[on] -= 1
                on = on[u[on] > self.cum[row[on]]]
            taken.append((alive, row))
            steps[alive] += 1
            row = self.next[row]
            on = row >= 0
            alive, row = alive[on], row[on]
        first = np.cumsum(steps) - steps
        out = np.empty(int(steps.sum()), np.int64)
        for j, (alive, row) in enumerate(taken):
            out[first[alive] + j] = row
        return np.repeat(np.arange(len(starts)), steps), out


def _below(phi: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at `phi`, each conditioned to lie under `limit`, of uniform `u`."""
    with np.errstate(divide="ignore"):
        return phi - np.logaddexp(phi - limit, np.log(-np.log(u)))


def runs_of(text: str) -> list[str]:
    """The text cut before every run of the space mark (U+2581)."""
    parts = text.split("▁")
    out, marks = ([parts[0]] if parts[0] else []), 0
    for p in parts[1:]:
        marks += 1
        if p:
            out.append("▁" * marks + p)
            marks = 0
    if marks:
        out.append("▁" * marks)
    return out


def segmentations(lattice: Lattice, text: str | None, k: int, seed: int) -> list[tuple[np.ndarray, float, float]]:
    """At most k distinct segmentations, best perturbed score first: (ids, log probability, log inclusion).

    Every segmentation has its log probability plus Gumbel noise; the k largest are drawn without
    replacement. The search is best first over groups of segmentations: all that share a prefix and
    then take none of some steps. A group's bound, a Gumbel variable at its log mass under the bound
    of the group it came from, is the score of its best member: popping the best group, drawing that
    member and dividing what is left at each of its later steps needs no other expansion. The
    inclusion score is 1 - exp(-exp(log probability - threshold)), the threshold being the next
    score, or 1 where nothing is left; long texts need its logarithm.
    """
    lattice.make_room()
    return [(lattice.spelled(rows)[0], lp, inc) for rows, lp, inc in drawn(lattice, lattice.starts([text]), k, [seed])[0]]


class Search:
    """The best-first search in one text: its queue of groups and what it has found."""

    def __init__(self, starts: np.ndarray, seed: int):
        self.starts, self.rng = starts, np.random.default_rng(seed)
        # -bound, tie, (member before, step where it turns off, steps barred there)
        self.queue: list[tuple] = [(-float(self.rng.gumbel()), 0, None, 0, ())]
        self.found: list[tuple[np.ndarray, float]] = []
        self.count = 0

    def push(self, bound: float, member: tuple, at: int, barred: tuple) -> None:
        self.count += 1
        heapq.heappush(self.queue, (-bound, self.count, member, at, barred))

    def turn(self, lattice: Lattice) -> None:
        """Take the best group: the steps its best member begins with, and where the walk goes on."""
        bound, _, parent, at, barred = heapq.heappop(self.queue)
        self.bound, self.before, self.who, self.rows, self.word, self.tail = -bound, 0.0, _NONE, _NONE, 0, self.starts
        if parent is None:
            return
        who, rows = parent
        self.word = int(who[at])
        state = int(np.searchsorted(lattice.at[: lattice.states], rows[at], side="right")) - 1
        a, z = lattice.at[state : state + 2].tolist()
        free = [r for r in range(a, z) if r not in barred]
        row = free[int(np.argmax(lattice.lp[free] + self.rng.gumbel(size=len(free))))]
        left = [r for r in free if r != row]
        before = float(lattice.lp[rows[:at]].sum())
        if left:
            phi = np.array([before + float(np.logaddexp.reduce(lattice.lp[left]))])
            self.push(float(_below(phi, self.bound, self.rng.random(1))[0]), parent, at, (*barred, row))
        self.who, self.rows = who[: at + 1], np.concatenate([rows[:at], [row]])
        self.before = before + float(lattice.lp[row])
        on = int(lattice.next[row])
        if on >= 0:
            self.tail = np.concatenate([[on], self.starts[self.word + 1 :]])
        else:
            self.word += 1
            self.tail = self.starts[self.word :]


def drawn(lattice: Lattice, starts: list[np.ndarray], k: int, seeds: list[int]) -> list[list[tuple[np.ndarray, float, float]]]:
    """`segmentations` of texts given by `Lattice.starts`, with rows for ids. Texts take their turns
    together; each draws from its own generator, so its draws do not depend on the others."""
    searches = [Search(s, seed) if len(s) else None for s, seed in zip(starts, seeds, strict=True)]
    for turn in range(1, k + 1):
        on = [s for s in searches if s is not None and s.queue]
        if not on:
            break
        for s in on:
            s.turn(lattice)
        ends = np.cumsum([0, *[len(s.tail) for s in on]])
        who, rows = lattice.walk(np.concatenate([s.tail for s in on]), ends, [s.rng for s in on])
        cuts = np.searchsorted(who, ends).tolist()
        lp = lattice.lp[rows]
        other = -np.expm1(np.minimum(lp, 0.0))
        later = np.flatnonzero(other > 1e-14)  # else no other step is possible
        total, u = np.empty(len(rows)), np.empty(len(later))
        halves = np.searchsorted(later, cuts).tolist()
        for s, a, z, b, y, end in zip(on, cuts, cuts[1:], halves, halves[1:], ends.tolist(), strict=False):
            total[a:z] = s.before + np.cumsum(lp[a:z])
            s.found.append((np.concatenate([s.rows, rows[a:z]]), float(total[z - 1]) if z > a else s.before))
            s.who = np.concatenate([s.who, who[a:z] - end + s.word])
            s.rng.random(out=u[b:y])
        phi = total[later] - lp[later] + np.log(other[later])
        bounds = _below(phi, np.repeat([s.bound for s in on], np.diff(halves)), u)
        need = k - turn + 1  # no more groups of a member can be reached
        for s, a, b, y in zip(on, cuts, halves, halves[1:], strict=False):
            some = bounds[b:y]
            best = np.argpartition(-some, need)[:need] if need < len(some) else np.arange(len(some))
            fixed, row = len(s.rows) - a, s.found[-1][0]
            for i in best[np.argsort(-some[best], kind="stable")].tolist():
                at = fixed + int(later[b + i])
                s.push(float(some[i]), (s.who, row), at, (int(row[at]),))
    out = []
    for s in searches:
        if s is None:
            out.append([(_NONE, 0.0, 0.0)])
            continue
        threshold = -s.queue[0][0] if s.queue else -inf
        members = []
        for rows, logp in s.found:
            x = min(logp - threshold, 700.0)
            # of small arguments 1 - exp(-y) is y
            members.append((rows, logp, 0.0 if threshold == -inf else x if x < -40 else log(-float(np.expm1(-exp(x))))))
        out.append(members)
    return out


def lattice_of(path: str, sharpness: float) -> Lattice:
    if (path, sharpness) not in _CACHE:
        _CACHE[path, sharpness] = Lattice(path, sharpness)
    return _CACHE[path, sharpness]


def spell(lattice: Lattice, ids: list[int]) -> str:
    """The normalised text of pieces: byte pieces are gathered into characters."""
    text = lattice.text
    try:
        return "".join([text[i] for i in ids])
    except KeyError:
        raw = b"".join([bytes([lattice.bytes[i]]) if i in lattice.bytes else text.get(i, "").encode() for i in ids])
        return raw.decode("utf-8", "replace")


def sample_segmentations(
    docs: DataFrame, path: str, k: int = 2, sharpness: float = 1.0, seed: int = 11, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, rank, ids, log_prob, log_inclusion, inclusion): at most k distinct segmentations of every row's text.

    Whole texts, normalised by the SentencePiece file at `path`. The noise is seeded by `seed` and
    the key's text, so a recomputed task draws the same. NULL and empty texts have one segmentation
    without pieces (log_prob 0, inclusion 1); a long text's inclusion may be too small for a double,
    which log_inclusion never is; texts with fewer than k have all of them, with
    inclusion 1. Rows that repeat are drawn alike and come back as often; a NULL key draws like the
    text 'null'; other columns are left out. No shuffle.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("name"), F.col(text).cast("string").alias("text"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path, sharpness)
        for b in slices(batches, "text", 1 << 19):
            lattice.make_room()
            starts = lattice.starts(b.column("text").to_pylist())
            seeds = [xxhash.xxh64_intdigest(name, seed) for name in b.column("name").to_pylist()]
            found = [(i, r, *x) for i, some in enumerate(drawn(lattice, starts, k, seeds)) for r, x in enumerate(some, 1)]
            at, rank, rows, logp, inclusion = zip(*found, strict=True)
            ids, places = lattice.spelled(np.concatenate(rows))
            ends = pa.array(places[np.cumsum([0, *map(len, rows)])], pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(rank, pa.int32()), lists, pa.array(logp), pa.array(inclusion)], ["id", "rank", "ids", "log_prob", "log_inclusion"])
        lattice.clear()  # the worker may be given other work next

    out = source.mapInArrow(draw, f"id {id_type}, rank int, ids array<int>, log_prob double, log_inclusion double")
    return out.withColumnRenamed("id", key).withColumn("inclusion", F.exp("log_inclusion"))


def decoded(ids: Column, path: str, sharpness: float = 1.0) -> Column:
    """Text of a column of piece ids, as the library decodes it. NULL gives NULL."""

    @F.pandas_udf("string")
    def decode(parts: pd.Series) -> pd.Series:
        sp = lattice_of(path, sharpness).sp
        return pd.Series([None if x is None else sp.decode([int(i) for i in x]) for x in parts], dtype=object)

    return decode(ids)


def digests(docs: DataFrame, path: str, k: int = 2, sharpness: float = 1.0, seed: int = 11) -> DataFrame:
    """(doc_id, rank, n_pieces, ids_crc32, log_prob, log_inclusion, inclusion) of the
    segmentations."""
    rows = sample_segmentations(docs, path, k, sharpness, seed)
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in ids], dtype="int64")

    return rows.select("doc_id", "rank", F.size("ids").cast("long").alias("n_pieces"), crc("ids").alias("ids_crc32"), "log_prob", "log_inclusion", "inclusion")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
