"""Distinct sampled segmentations into SentencePiece units, and back.

A text is cut at blanks; each stretch between them ("unit", its blank in front)
has a lattice of the vocabulary's pieces. A segmentation of the text is a path
through its units' lattices. Samples without replacement are the paths with the
largest perturbed log-probabilities (Gumbel top-k), found best first: a region
is all paths that leave a given path at a given node by other pieces. Its mass
is known exactly from the lattice's backward sums, so its best perturbed value
can be drawn (a Gumbel below its parent's) before any path of it is built; the
region with the largest value is opened next, and its best path is drawn down
to the end of the text, leaving new regions beside it.
"""

from __future__ import annotations

import math
from bisect import bisect
from collections.abc import Iterator
from itertools import accumulate, chain, compress, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.base import query, table
from trailframe.llm.rows import pick
from trailframe.llm.shingles import mix
from trailframe.llm.store import give_back
from trailframe.llm.tokens import vocabulary

U = np.uint64
BLANK = "▁"  # how the vocabulary writes a blank
# Lattice edges that a task keeps for units it has seen.
KEPT = 2_000_000
# Units up to this long are summed without logarithms, each character weighing 2**SCALE; sums beyond LEAST and its inverse are left to logarithms.
SHORT, SCALE, LEAST = 60, 10, 1e-200


class Numbers(dict):
    """Numbers of words in the order they are first asked for; ``fresh`` are the new ones."""

    def __init__(self, *given):
        super().__init__(*given)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class Lattices:
    """Nodes and edges of units' lattices, in flat arrays.

    Pieces weigh as their rank by Zipf's law: a byte-pair vocabulary gives ranks,
    not probabilities. A character that the vocabulary lacks is written by its
    UTF-8 bytes. Edge: piece (below 0: a character to spell in bytes), next
    node (-1 at the unit's end), probability of its piece given the node.
    """

    # Characters that most pieces use get a column each in the table of steps; the others are searched for.
    COLUMNS = 64

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.width = 2 if size <= 0x10000 else 4
        self.bytes: list[int] = [0] * 256
        total = sum(1 / (3.0 + i) for i in range(size))
        self.byte_weight = 1 / (3.0 + size) / total / 8
        # The vocabulary as a tree: steps (state, character) -> state, and each state's piece.
        steps: dict[tuple[int, int], int] = {}
        pieces, weights = [-1], [0.0]
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or BLANK in piece[1:]):
                state = 0
                for c in piece.replace(BLANK, " "):
                    at = steps.get((state, ord(c)))
                    if at is None:
                        at = steps[(state, ord(c))] = len(pieces)
                        pieces.append(-1)
                        weights.append(0.0)
                    state = at
                pieces[state] = i
                weights[state] = 1 / (3.0 + min(-model.get_score(i), float(size))) / total
        self.piece_of, self.weight_of = np.array(pieces, np.int64), np.array(weights)
        keys = np.array([(s << 21) | c for s, c in steps], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.array(list(steps.values()), np.int32)[order]
        chars, counts = np.unique(self.keys & 0x1FFFFF, return_counts=True)
        self.column = np.full(0x110000, self.COLUMNS, np.uint8)
        self.column[chars[np.argsort(-counts, kind="stable")[: self.COLUMNS]]] = np.arange(min(self.COLUMNS, len(chars)))
        self.table = np.full((len(pieces), self.COLUMNS), -1, np.int32)
        direct = self.column[self.keys & 0x1FFFFF]
        inside = direct < self.COLUMNS
        self.table[self.keys[inside] >> 21, direct[inside]] = self.targets[inside]
        self.clear()

    def clear(self) -> None:
        # Words by number; by number also their first nodes, how many nodes, and how many batches of texts had them.
        self.roots = Numbers()
        self.start = self.size = self.hits = np.zeros(0, np.int64)
        self.nodes = self.held = 0
        # Room for what is kept and a batch more; pages that aren't used take no memory.
        room = KEPT + (1 << 19)
        self.first = np.zeros(room, np.int64)
        self.piece, self.next, self.share = np.empty(room, np.int32), np.empty(room, np.int32), np.empty(room)

    def prune(self) -> None:
        """Keep the words that most batches had, in half of the room at most; words of one batch go."""
        n, m = self.nodes, self.held
        by = np.argsort(self.start, kind="stable")
        start, size, hits = self.start[by], self.size[by], self.hits[by]
        degree, edges = np.diff(self.first[: n + 1]), self.first[start + size] - self.first[start]
        order = np.argsort(-hits, kind="stable")
        keep = np.zeros(len(order), bool)
        keep[order[(np.cumsum(edges[order]) <= KEPT // 2) & (hits[order] > 1)]] = True
        node, edge = np.repeat(keep, size), np.flatnonzero(np.repeat(keep, edges))
        moved = np.append(np.cumsum(node) - 1, -1)  # -1, a unit's end, stays
        self.nodes, self.held = int(node.sum()), len(edge)
        self.first[1 : self.nodes + 1] = np.cumsum(degree[node])
        self.piece[: self.held], self.share[: self.held] = self.piece[:m][edge], self.share[:m][edge]
        self.next[: self.held] = moved[self.next[:m][edge]]
        self.size, self.hits = size[keep], hits[keep]
        self.start = np.cumsum(self.size) - self.size
        words = list(self.roots)
        self.roots = Numbers(zip(map(words.__getitem__, by[keep].tolist()), range(len(self.size))))

    def find(self, words: list[str]) -> np.ndarray:
        """First nodes of words' lattices; those of new words are added."""
        if self.held > KEPT:
            self.prune()
        number = np.fromiter(map(self.roots.__getitem__, words), np.int64, len(words))
        if self.roots.fresh:
            self.add(self.roots.fresh)
            self.roots.fresh = []
        self.hits[number] += 1  # once, however often it is there
        return self.start.take(number)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states, -1 where no piece goes on so."""
        column = self.column.take(char)
        out = self.table.take(state * np.int64(self.COLUMNS) + np.minimum(column, self.COLUMNS - 1))
        rare = np.flatnonzero(column == self.COLUMNS)
        if len(rare):
            key = (state[rare].astype(np.int64) << 21) | char[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == key, self.targets[at], -1)
        return out

    def edges(self, chars: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(position, next position, piece, weight) of every edge over units laid end to end, by position.

        ``end`` is the end of each position's unit. Longer pieces come first.
        """
        at = np.arange(len(chars))
        state, live, length = np.zeros(len(chars), np.int32), at, 0
        # Edges of one length after another; ``count`` of a position's edges are shorter than the one in hand.
        found, count = [], np.zeros(len(chars), np.int64)
        while len(live):
            state = self.step(state, chars.take(live + length))
            length += 1
            on = np.flatnonzero(state >= 0)
            state, live = state.take(on), live.take(on)
            own = self.piece_of.take(state)
            has = np.flatnonzero(own >= 0)
            where = live.take(has)
            if length == 1:
                single = np.zeros(len(chars), bool)
                single[where] = True
                bare = np.flatnonzero(~single)
                if len(bare):
                    code = chars[bare]
                    size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
                    spelled = np.where(code < 0x80, np.array(self.bytes)[np.minimum(code, 0x7F)], -1 - code)
                    found.append((bare, 1, 0, spelled, self.byte_weight**size))
                    count[bare] = 1
            shorter = count.take(where)
            found.append((where, length, shorter, own.take(has), self.weight_of.take(state.take(has))))
            count[where] = shorter + 1
            on = np.flatnonzero(live + length < end.take(live))
            state, live = state.take(on), live.take(on)
        bound = np.cumsum(count)
        total = int(bound[-1]) if len(bound) else 0
        to, piece, weight = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
        for where, length, shorter, own, value in found:
            slot = bound.take(where) - 1 - shorter
            to[slot], piece[slot], weight[slot] = where + length, own, value
        return np.repeat(at, count), to, piece, weight

    def add(self, words: list[str]) -> None:
        """Lattices of new units, a blank and a word each, all of them at once."""
        grown = (np.concatenate([x, np.zeros(len(words), np.int64)]) for x in (self.start, self.size, self.hits))
        number = np.arange(len(self.start), len(self.start) + len(words))
        self.start, self.size, self.hits = grown
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if sizes.max() > SHORT:
            long = sizes > SHORT
            self._add(list(compress(words, long.tolist())), number[long], True)
            words, number = list(compress(words, (~long).tolist())), number[~long]
        self._add(words, number, False)

    def _add(self, words: list[str], number: np.ndarray, by_logs: bool) -> None:
        """Words of these numbers; without logarithms, those whose sums leave the range are added anew with them."""
        if not words:
            return
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        chars = np.frombuffer((" " + " ".join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        end = np.repeat(ends, sizes)
        pos, to, piece, weight = self.edges(chars, end)
        n = len(chars)
        degree = np.bincount(pos, minlength=n)
        first = np.append(0, np.cumsum(degree))
        # From the units' ends backwards: positions, their numbers of edges, and those edges.
        left = end - np.arange(n)
        by_left = np.argsort(left.astype(np.uint16 if sizes.max() < 1 << 16 else np.int64), kind="stable")
        steps = np.append(0, np.cumsum(np.bincount(left)[1:]))
        last = to == end.take(pos)
        if by_logs:
            share = self._by_logs(pos, to, weight, last, by_left, steps, first)
        else:
            share, sums = self._by_products(pos, to, weight, last, by_left, steps, first)
            bad = ~((sums > LEAST) & (sums < 1 / LEAST))
            if bad.any():
                out = np.logical_or.reduceat(bad, ends - sizes)
                self._add(list(compress(words, (~out).tolist())), number[~out], False)
                self._add(list(compress(words, out.tolist())), number[out], True)
                return
        base, held, m = self.nodes, self.held, len(pos)
        self.first = self._room(self.first, base + n + 1)
        for name, values in (("piece", piece), ("next", np.where(last, -1, to + base)), ("share", share)):
            grown = self._room(getattr(self, name), held + m)
            grown[held : held + m] = values
            setattr(self, name, grown)
        self.first[base : base + n + 1] = first + held
        self.nodes, self.held = base + n, held + m
        self.start[number], self.size[number] = ends - sizes + base, sizes

    @staticmethod
    def _by_products(pos, to, weight, last, by_left, steps, first) -> tuple[np.ndarray, np.ndarray]:
        """Edges' shares, and sums of all paths from each position to its unit's end times 2**SCALE for each character left."""
        n = len(first) - 1
        sums = np.ones(n + 1)
        cuts, edge = _ranges(first.take(by_left), np.diff(first).take(by_left))
        # Powers of two: they change no digit.
        value = np.ldexp(weight, SCALE * (to - pos)).take(edge)
        to = np.where(last, n, to).take(edge)
        for i, j, a, b in zip(steps.tolist(), steps[1:].tolist(), cuts[steps].tolist(), cuts[steps[1:]].tolist()):
            value[a:b] *= sums.take(to[a:b])
            sums[by_left[i:j]] = np.add.reduceat(value[a:b], cuts[i:j] - a)
        share = np.empty(len(pos))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            share[edge] = value / np.repeat(sums.take(by_left), np.diff(cuts))
        return share, sums[:n]

    @staticmethod
    def _by_logs(pos, to, weight, last, by_left, steps, first) -> np.ndarray:
        """The same shares for units of any length, from the logs of the sums."""
        logs, logw = np.zeros(len(first)), np.log(weight)
        cuts, edge = _ranges(first.take(by_left), np.diff(first).take(by_left))
        for i, j, a, b in zip(steps.tolist(), steps[1:].tolist(), cuts[steps].tolist(), cuts[steps[1:]].tolist()):
            e, cut = edge[a:b], cuts[i:j] - a
            value = logw[e] + np.where(last[e], 0.0, logs[to[e]])
            top = np.maximum.reduceat(value, cut)
            total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(cut, append=len(e)))), cut)
            logs[by_left[i:j]] = top + np.log(total)
        return np.exp(logw + np.where(last, 0.0, logs[to]) - logs[pos])

    @staticmethod
    def _room(values: np.ndarray, n: int) -> np.ndarray:
        return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])

    def arrays(self) -> tuple[np.ndarray, ...]:
        n, m = self.nodes, self.held
        return self.first[: n + 1], self.piece[:m], self.next[:m], self.share[:m]


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each range begins (and the last one ends) when they lie end to end, and the numbers in them."""
    cuts = np.append(0, np.cumsum(size))
    return cuts, np.arange(int(cuts[-1])) + np.repeat(start - cuts[:-1], size)


def uniform(seed: np.ndarray, counter: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on these values alone."""
    x = mix(seed + mix(counter.astype(U) * U(64) + U(stream)))
    return ((x >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _log_inclusion(over: float) -> float:
    """Log of the chance that a perturbed value lies above the limit, ``over`` being log-probability less limit."""
    if over > 700:
        return 0.0
    return over if over < -30 else math.log(-math.expm1(-math.exp(over)))


def below(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The largest perturbed value of a region of that log mass, given that it is below ``bound``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-bound, np.log(-np.log(u)) - mass)


def draw(views: tuple, start: np.ndarray, seed: np.ndarray, counter: np.ndarray, stream: int) -> tuple[np.ndarray, ...]:
    """Draw a path down from every start node: (index of the start, node, edge, its share), in path order."""
    first, _, nxt, share = views
    live = np.flatnonzero(start >= 0)
    node, depth = start[live], 0
    steps, count = [], np.zeros(len(start), np.int64)
    while len(live):
        over = uniform(seed.take(live), counter.take(live) + depth, stream)
        edge, end = first.take(node), first.take(node + 1) - 1
        part = share.take(edge)
        # Past an edge by taking its share off what is left of the number; the node's last edge takes all.
        more = np.flatnonzero((over > part) & (edge < end))
        while len(more):
            over[more] -= part[more]
            edge[more] += 1
            part[more] = share[edge[more]]
            more = more[(over[more] > part[more]) & (edge[more] < end[more])]
        steps.append((live, node, edge, part))
        count[live] += 1
        node = nxt.take(edge)
        inside = np.flatnonzero(node >= 0)
        live, node = live.take(inside), node.take(inside).astype(np.int64)
        depth += 1
    bound = np.cumsum(count)
    total = int(bound[-1]) if len(bound) else 0
    nodes, edges, parts = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
    at = bound - count
    for depth, (live, node, edge, part) in enumerate(steps):
        slot = at.take(live) + depth
        nodes[slot], edges[slot], parts[slot] = node, edge, part
    return np.repeat(np.arange(len(start)), count), nodes, edges, parts


def _best(region: np.ndarray, bound: float, opened: dict[int, float]) -> tuple[int, float]:
    """Which of a path's regions has the largest value, and that value; the opened ones have theirs already."""
    if not len(region):
        return -1, -math.inf
    j = int(region.argmax())
    found = float(region[j])
    # As in ``below``, of one number.
    value = -float(np.logaddexp(-bound, -found)) if found > -math.inf else found
    return max([(j, value), *opened.items()], key=lambda x: x[1])


class Sampler:
    """Top ``k`` perturbed segmentations of texts, some texts at a time."""

    def __init__(self, path: str, k: int, seed: int):
        self.lattices, self.k, self.seed = Lattices(path), k, seed

    def sample(self, texts: list[str | None], seeds: np.ndarray) -> list[list[tuple[bytes, int, float, float, float]]]:
        """Per text up to ``k`` of (ids, pieces, log-probability, perturbed value, log of inclusion probability)."""
        words = [t.split(" ") if t else [] for t in texts]
        roots = self.lattices.find(list(chain.from_iterable(words)))
        bounds = np.cumsum([0, *map(len, words)])
        return self._sample(self.lattices.arrays(), roots, bounds, mix(seeds + U(self.seed)))

    def _sample(self, views: tuple, roots: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> list[list[tuple]]:
        piece = views[1]
        n = len(seeds)
        tops = -np.log(-np.log(uniform(seeds, np.zeros(n, np.int64), 0)))
        paths: list[list[dict]] = [[] for _ in range(n)]
        # Where to go on: text, unit, start node, kept edges and the log mass after them, value.
        none = np.zeros(0, np.int64)
        todo = [(d, 0, None, none, 0.0, value) for d, value in enumerate(tops.tolist())]
        ends = bounds[1:].tolist()
        bounds = bounds.tolist()
        for r in range(self.k):
            if not todo:
                break
            at = np.array([bounds[t[0]] + t[1] for t in todo], np.int64)
            sizes = np.array([ends[t[0]] for t in todo], np.int64) - at
            ahead = np.cumsum(sizes) - sizes
            slot = np.arange(int(sizes.sum())) + np.repeat(at - ahead, sizes)
            docs = np.array([t[0] for t in todo], np.int64)
            start, doc = roots[slot], np.repeat(docs, sizes)
            unit = slot - np.repeat(np.array(bounds)[docs], sizes)
            inner = [i for i, t in enumerate(todo) if t[2] is not None and sizes[i]]
            start[ahead[inner]] = [todo[i][2] for i in inner]
            seed = seeds[doc]
            who, nodes, edges, shares = draw(views, start, seed, unit << 32, 2 * r + 1)
            with np.errstate(divide="ignore"):
                logs, rest = np.log(shares), np.log1p(-np.minimum(shares, 1.0))
            unit = unit[who]
            steps = np.bincount(who, minlength=len(start))
            depth = np.arange(len(who)) - np.repeat(np.cumsum(steps) - steps, steps)
            chance = uniform(seed[who], (unit << 32) + depth, 2 * r + 2)
            cuts = np.append(0, np.cumsum(steps))[np.append(ahead, len(start))]
            prior, masses = np.empty(len(who)), []
            for a, b, t in zip(cuts.tolist(), cuts[1:].tolist(), todo):
                # Each text by itself, so that its sums don't depend on the others.
                run = t[4] + np.cumsum(logs[a:b])
                prior[a : a + 1] = t[4]
                prior[a + 1 : b] = run[:-1]
                masses.append(float(run[-1]) if b > a else t[4])
            # Before the bound, which leaves the order of a path's regions as it is.
            with np.errstate(divide="ignore"):
                region = prior + rest - np.log(-np.log(chance))
            for a, b, t, mass in zip(cuts.tolist(), cuts[1:].tolist(), todo, masses):
                # All edges; of those not kept from another path: unit, node, log mass before, the region beside.
                paths[t[0]].append(
                    {
                        "edges": np.concatenate([t[3], edges[a:b]]) if len(t[3]) else edges[a:b], "skip": len(t[3]), "unit": unit[a:b],
                        "node": nodes[a:b], "prior": prior[a:b], "region": region[a:b], "mass": mass, "value": t[5],
                        "taken": {}, "opened": {}, "best": _best(region[a:b], t[5], {}),
                    }
                )
            todo = self._open(views, [(t[0], paths[t[0]]) for t in todo], seeds, r) if r + 1 < self.k else []
        taken = [p["edges"] for own in paths for p in own]
        ids = self._ids(piece[np.concatenate(taken)] if taken else none, [len(x) for x in taken])
        out = []
        for own in paths:
            # The best value that was not taken decides how likely each sample was to be among the k.
            limit = max((p["best"][1] for p in own), default=-math.inf)
            out.append([(*next(ids), p["mass"], p["value"], _log_inclusion(p["mass"] - limit)) for p in own])
        return out

    @staticmethod
    def _open(views: tuple, texts: list[tuple[int, list[dict]]], seeds: np.ndarray, r: int) -> list[tuple]:
        """Open each text's best region: keep the path up to it, take another edge there."""
        first, _, nxt, share = views
        found = [(d, max(own, key=lambda p: p["best"][1])) for d, own in texts]
        found = [(d, path, *path["best"]) for d, path in found if path["best"][1] > -math.inf]
        if not found:
            return []
        seed = seeds[[d for d, *_ in found]]
        counter = np.array([(int(path["unit"][j]) << 32) + path["skip"] + j for _, path, j, _ in found], np.int64)
        node = np.array([path["node"][j] for _, path, j, _ in found], np.int64)
        lows, highs = first[node].tolist(), first[node + 1].tolist()
        draws = uniform(seed, counter, 40 + 2 * (r % 8)).tolist()
        picks, left = [], []
        for (_, path, j, _), low, high, u in zip(found, lows, highs, draws):
            taken = path["taken"].setdefault(j, [int(path["edges"][path["skip"] + j])])
            shares = share[low:high].tolist()
            free = [e for e in range(low, high) if e not in taken]
            upto = list(accumulate(shares[e - low] for e in free))
            pick_ = free[min(len(free) - 1, bisect(upto, u * upto[-1]))]
            taken.append(pick_)
            picks.append(pick_)
            left.append(sum(shares[e - low] for e in free if e != pick_))
        prior = np.array([path["prior"][j] for _, path, j, _ in found])
        with np.errstate(divide="ignore"):
            mass = prior + np.log(left)
            values = below(mass, np.array([value for *_, value in found]), uniform(seed, counter, 41 + 2 * (r % 8)))
        masses = (prior + np.log(share[picks])).tolist()
        todo = []
        for (d, path, j, value), pick_, rest, mass, node in zip(found, picks, np.where(np.array(left) > 0, values, -np.inf).tolist(), masses, nxt[picks].tolist()):
            path["region"][j], path["opened"][j] = -math.inf, rest
            path["best"] = _best(path["region"], path["value"], path["opened"])
            kept = np.append(path["edges"][: path["skip"] + j], pick_)
            unit = int(path["unit"][j])
            # A unit that ends here goes on with the next one.
            todo.append((d, unit + 1, None, kept, mass, value) if node < 0 else (d, unit, node, kept, mass, value))
        return todo

    def _ids(self, found: np.ndarray, sizes: list[int]) -> Iterator[tuple[bytes, int]]:
        """The ids of paths that lie end to end, as bytes, and how many."""
        width = self.lattices.width
        kind = f"<u{width}"
        spelled, at = bool(len(found)) and found.min() < 0, 0
        flat = b"" if spelled else found.astype(kind).tobytes()
        for size in sizes:
            own = found[at : at + size]
            if spelled and size and own.min() < 0:
                ids = []
                for p in own.tolist():
                    ids += [p] if p >= 0 else [self.lattices.bytes[b] for b in chr(-1 - p).encode("utf-8", "surrogatepass")]
                yield np.array(ids).astype(kind).tobytes(), len(ids)
            else:
                yield own.astype(kind).tobytes() if spelled else flat[width * at : width * (at + size)], size
            at += size


SAMPLES = "array<struct<ids:binary,n_pieces:bigint,log_prob:double,perturbed:double,log_inclusion:double>>"
SAMPLES_TYPE = pa.list_(pa.struct([("ids", pa.binary()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]))


def sample_segmentations(
    df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", k: int = 2, seed: int = 1
) -> DataFrame:
    """``id, samples`` for every row: up to ``k`` distinct segmentations, best perturbed value first.

    A sample is its piece ids (``ids``, little-endian, 2 bytes each where the
    vocabulary allows), how many, its log-probability among the text's
    segmentations, its perturbed value and the log of the probability of being
    among the ``k`` given the best value left out (its inclusion score). Texts
    with fewer segmentations return all, each with log inclusion 0; null counts as empty, whose one segmentation has
    no pieces. Chance comes from the id and ``seed``: rows that repeat an id and
    text repeat their samples; null ids share one seed. Texts are used whole;
    an empty table gives an empty result; extra columns are ignored.
    """
    rows = pick(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    seeded = rows.select("id", F.xxhash64("id").alias("seed"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(model, k, seed)
        for batch in batches:
            at = 0
            sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            while at < len(sizes):
                # Some texts at a time, by length.
                to, held = at, 0
                while to < len(sizes) and (to == at or held + sizes[to] < 200_000):
                    held += sizes[to]
                    to += 1
                part = batch.slice(at, to - at)
                seeds = part.column("seed").to_numpy(zero_copy_only=False).astype(np.int64).view(U)
                found = sampler.sample(part.column("text").to_pylist(), seeds)
                rows_ = [[dict(zip(("ids", "n_pieces", "log_prob", "perturbed", "log_inclusion"), s)) for s in own] for own in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows_, SAMPLES_TYPE)], ["id", "samples"])
                at = to
        del sampler
        give_back()

    return seeded.mapInArrow(run, f"id {kind}, samples {SAMPLES}").withColumnRenamed("id", id_col)


def decoder(model: str):
    """A vectorised function of arrays of ids to arrays of texts: any number of samples in one worker."""
    @F.pandas_udf("array<string>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        vocabulary_ = sentencepiece.SentencePieceProcessor(model_file=model)
        size = vocabulary_.get_piece_size()
        raw = [
            bytes([int(vocabulary_.id_to_piece(i)[3:5], 16)]) if vocabulary_.is_byte(i) else vocabulary_.id_to_piece(i).replace(BLANK, " ").encode()
            for i in range(size)
        ]
        kind, width = ("<u2", 2) if size <= 0x10000 else ("<u4", 4)
        spelled = pa.array(raw, pa.large_binary())

        def texts(found: list[bytes]) -> list[str]:
            """The texts of several samples, put together from pieces at once."""
            sizes = [len(x) // width for x in found]
            made = spelled.take(pa.array(np.frombuffer(b"".join(found), kind)))
            if not len(made):
                return [""] * len(found)
            bounds = np.frombuffer(made.buffers()[1], np.int64).take(np.cumsum([0, *sizes])).tolist()
            whole = memoryview(made.buffers()[2])
            # Without the first unit's blank, which the text lacks.
            return [str(whole[a + 1 : z], "utf-8", "surrogatepass") for a, z in zip(bounds, bounds[1:])]

        for batch in batches:
            flat = [x for own in batch if own is not None for x in own]
            out, at = [], 0
            while at < len(flat):
                # Some samples at a time, by length.
                to, held = at, 0
                while to < len(flat) and (to == at or held < 1_000_000):
                    held += len(flat[to] or b"")
                    to += 1
                part = texts([x or b"" for x in flat[at:to]])
                out += [None if x is None else text for x, text in zip(flat[at:to], part)]
                at = to
            rest = iter(out)
            yield pd.Series([None if own is None else list(islice(rest, len(own))) for own in batch], dtype="object")

    return decode


def decode_ids(ids: Column, model: str) -> Column:
    """The text that ids spell: exactly the one that was segmented. Null gives null, no ids the empty text."""
    return F.get(decoder(model)(F.array(ids)), F.lit(0))


def decode_samples(samples: Column, model: str) -> Column:
    """The texts of all samples, in their order."""
    return decoder(model)(samples["ids"])


@query("op4_sample_pieces")
def op4_sample_pieces(spark, sf_dir):
    """The samples, and digests of what each decodes to: its document's text."""
    model = vocabulary("piece_bpe_32k.model")
    found = sample_segmentations(table(spark, sf_dir, "documents"), model)
    return found.withColumn("decoded_sha256", F.transform(decode_samples(F.col("samples"), model), lambda text: F.sha2(text, 256)))
