"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's lattice has a node before each character and an edge for each piece that matches
there; a character without a piece of its own has an edge of its bytes. Backward sums over
the lattice turn edge weights into conditional probabilities, so a segmentation's
probability is the product along its path. Gumbel top-k draws k different segmentations:
each segmentation's log-probability gets Gumbel noise, and the k largest are the sample.
They are found by an A-star search over sets of segmentations that share a path: a set's
priority, the largest perturbed value in it, is drawn directly from the set's total
probability below the priority of the set it was split from, so the bound is exact and
every set that is popped gives the next sample. Popping a set draws its best path, and the
ways that leave the path become new sets, one for each node. The inclusion score of a
segmentation is the probability that its perturbed value lies above that of the first one
not drawn.

Where two characters stand side by side in no piece, every path has a node between them, so a
text is cut there into chunks (at the latest before a blank and around a line break), whose
lattices are worked out once per worker and remembered. The model is a merge list
without probabilities; a piece of rank r is given weight 1 / (r + 3). Random numbers
depend on the seed, the row's key and the place in the text alone.

Results by case: a NULL text counts as empty, an empty text has one segmentation, without
ids; a text with fewer than k segmentations gives them all; rows with equal keys and texts
are sampled alike; ties between perturbed values are settled by the earlier place; an empty
table gives an empty one; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import exp, inf, log
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from receivables.llm.common import map_rows, per_worker, share, type_of

SAMPLES = 2
SEED = 1
MARK = "▁"
#: Chunks, and the steps of a walk, that go on when so few others do are done one by one.
FEW = 12
AT_ONCE = 1 << 20  # characters sampled side by side
MOST_CHUNKS = 150_000  # about 150 MB


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def normalised(text: str) -> str:
    """As the model wants it: a blank put in front, blanks as marks."""
    return MARK + text.replace(" ", MARK) if text else ""


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        plain = [i for i in range(n) if not special[i] and not model.is_byte(i)]
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        total = sum(1 / (rank + 3) for rank in range(len(ranked)))
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.weights = np.zeros(n)
        #: Beginnings of pieces, numbered from the empty one, and the piece that ends there.
        states, ends = {"": 0}, [-1]
        steps: dict[int, int] = {}
        for rank, i in enumerate(ranked):
            piece = self.pieces[i]
            self.weights[i] = -log((rank + 3) * total)
            for end in range(1, len(piece) + 1):
                if piece[:end] not in states:
                    states[piece[:end]] = len(ends)
                    steps[states[piece[: end - 1]] << 21 | ord(piece[end - 1])] = len(ends)
                    ends.append(-1)
            ends[states[piece]] = i
        self._hash_steps(np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64))
        held = {pair for i in ranked for pair in zip(self.pieces[i], self.pieces[i][1:])}
        letters = sorted({c for pair in held for c in pair})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no pair
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        place = {c: i for i, c in enumerate(letters, 1)}
        self.held = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for one, other in held:
            self.held[place[one], place[other]] = True
        self.ends = np.array(ends, np.int64)
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_weight = -log((len(ranked) + 3) * total)
        self.spelt = [piece.encode() for piece in self.pieces]
        for byte, i in self.bytes.items():
            self.spelt[i] = bytes([byte])
        self.letters = np.frombuffer(b"".join(self.spelt), np.uint8)
        self.spelt_sizes = np.array([len(piece) for piece in self.spelt], np.int64)
        self.spelt_from = np.cumsum(self.spelt_sizes) - self.spelt_sizes

    def _hash_steps(self, keys: np.ndarray, to: np.ndarray) -> None:
        """A table of the steps by a hash of (state, character); a key lies at its hash's place
        or one of the next ``reach``."""
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.mask, self.reach = size - 1, 0
        self.step_keys, self.step_to = np.full(2 * size, -1), np.zeros(2 * size, np.int64)
        place, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.step_keys[place[left]] < 0]
            _, first = np.unique(place[free], return_index=True)
            put = free[first]
            self.step_keys[place[put]], self.step_to[place[put]] = keys[put], to[put]
            left = np.setdiff1d(left, put)
            place[left] += 1
            self.reach += 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _MIX[2]) >> np.uint64(40)).astype(np.int64) & self.mask

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The states that the steps lead to, -1 where there is none."""
        place = self._place(keys)
        found = np.where(self.step_keys[place] == keys, self.step_to[place], -1)
        open_ = np.flatnonzero((found < 0) & (self.step_keys[place] >= 0))
        for i in range(1, self.reach):
            if not len(open_):
                break
            at = place[open_] + i
            here = self.step_keys[at]
            on = here == keys[open_]
            found[open_[on]] = self.step_to[at[on]]
            open_ = open_[~on & (here >= 0)]
        return found

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a chunk begins at each character: no piece holds it and the one before."""
        letter = self.letter[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = ~self.held[letter[:-1], letter[1:]]
        return begins

    def matches(self, codes: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every piece that lies in the characters: first place, length and id. ``behind``
        gives for each place the end of its chunk."""
        at, state, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        length = 0
        while len(at):
            state = self._step(state << 21 | codes[at + length])
            known = state >= 0
            at, state, length = at[known], state[known], length + 1
            piece = self.ends[state]
            ending = piece >= 0
            found.append((at[ending], np.full(ending.sum(), length), piece[ending]))
            inside = at + length < behind[at]
            at, state = at[inside], state[inside]
        return tuple(np.concatenate(x) for x in zip(*found))

    def spells(self, ids: np.ndarray, text: bytes) -> bool:
        """Whether the ids spell the text."""
        sizes = self.spelt_sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or ends[-1] != len(text):
            return len(ids) == len(text) == 0
        places = np.repeat(self.spelt_from[ids] - (ends - sizes), sizes) + np.arange(len(text))
        return self.letters[places].tobytes() == text

    def spell(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.spelt.__getitem__, ids))

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        return self.spell(ids).decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


class Lattices(dict):
    """Chunk to its first node; a chunk's further nodes follow. Edges of all nodes in one
    table, the probabilities of a node's edges summed up."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self._room: dict[str, np.ndarray] = {}
        self.start_over()

    def start_over(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.n_nodes = 0
        self.first = np.zeros(1, np.int32)  # a node's first edge; one more at the end
        self.up_to = np.zeros(0)  # summed probability
        self.logs = np.zeros(0)  # of an edge's probability
        self.others = np.zeros(0)  # log of the probability of the node's other edges
        self.next = np.zeros(0, np.int32)  # node, or -1 behind the chunk
        self.id_from = np.zeros(1, np.int32)  # an edge's first id; one more at the end
        self.ids = np.zeros(0, np.int32)

    def _extend(self, name: str, new: np.ndarray) -> None:
        """Puts ``new`` behind a table, in room kept for it."""
        known = getattr(self, name)
        room, n = self._room.get(name), len(known) + len(new)
        if room is None or len(room) < n:
            room = self._room[name] = np.empty(n + n // 8, known.dtype)
            room[: len(known)] = known
        elif known.base is not room:
            room[: len(known)] = known
        room[len(known) : n] = new
        setattr(self, name, room[:n])

    def __missing__(self, chunk: str) -> int:
        self[chunk] = node = self.n_nodes
        self.n_nodes += len(chunk)
        self.new.append(chunk)
        return node

    def nodes(self, chunks: Sequence[str]) -> np.ndarray:
        if len(self) > MOST_CHUNKS or self.n_nodes > 20 * MOST_CHUNKS:
            self.start_over()
        found = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        if self.new:
            self._work_out()
        return found

    def _work_out(self) -> None:
        """Edges of the new chunks, side by side; nodes are the characters' places."""
        v = self.vocabulary
        text = "".join(self.new)
        n, base = len(text), self.n_nodes - len(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, self.new), np.int64, len(self.new))
        behind = np.repeat(np.cumsum(sizes), sizes)
        start, length, piece = v.matches(codes, behind)
        bare = np.ones(n, bool)
        bare[start[length == 1]] = False
        spelt = np.flatnonzero(bare)  # characters without a piece
        letters = [[v.bytes[b] for b in text[i].encode("utf-8", "replace")] for i in spelt.tolist()]
        n_letters = np.array([len(x) for x in letters], np.int64)
        weight = np.concatenate([v.weights[piece], n_letters * v.byte_weight])
        start = np.concatenate([start, spelt])
        length = np.concatenate([length, np.ones(len(spelt), np.int64)])
        # Long pieces first: they are the likelier ones.
        order = np.lexsort((-length, start))
        start, length, weight = start[order], length[order], weight[order]
        to = start + length
        last = to == behind[start]
        counts = np.bincount(start, minlength=n)
        # Backward sums, all nodes equally far from their chunks' ends at once, and what is left
        # of a few long chunks one by one.
        below_, total = np.zeros(n + 1), weight.copy()
        far = behind[start] - start
        by_far = np.argsort(far, kind="stable")
        bounds = np.searchsorted(far[by_far], np.arange(far.max() + 2))
        sizes_by_far = np.diff(bounds[1:])
        crowded = np.flatnonzero(sizes_by_far > 4 * FEW)
        together = int(crowded[-1]) + 2 if len(crowded) else 1
        for d in range(1, together):
            edges = by_far[bounds[d] : bounds[d + 1]]
            if not len(edges):
                continue
            x = weight[edges] + np.where(last[edges], 0.0, below_[to[edges]])
            total[edges] = x
            cuts = np.flatnonzero(np.diff(start[edges], prepend=-1))
            top = np.maximum.reduceat(x, cuts)
            of = np.repeat(np.arange(len(cuts)), np.diff(cuts, append=len(edges)))
            below_[start[edges[cuts]]] = top + np.log(np.add.reduceat(np.exp(x - top[of]), cuts))
        self._one_by_one(by_far[bounds[together] :], start, to, last, weight, below_, total)
        logs = total - below_[start]
        chance = np.exp(logs)
        ends = np.cumsum(counts)
        summed = np.cumsum(chance)
        up_to = summed - np.concatenate([[0.0], summed])[(ends - counts)[start]]
        up_to[ends - 1] = inf
        # The ids of the edges: one for a piece, several for a spelt character.
        n_ids = np.concatenate([np.ones(len(piece), np.int64), n_letters])
        own = (np.cumsum(n_ids) - n_ids)[order]
        n_ids = n_ids[order]
        from_ = np.concatenate([[0], np.cumsum(n_ids)])
        flat = np.concatenate([piece, np.array(sum(letters, []), np.int64)]).astype(np.int32)
        ids = flat[np.repeat(own - from_[:-1], n_ids) + np.arange(from_[-1])]
        self._extend("first", self.first[-1] + ends)
        self._extend("up_to", up_to)
        self._extend("logs", logs)
        with np.errstate(divide="ignore"):
            others = np.log(np.maximum(-np.expm1(logs), 0.0))
        others[counts[start] == 1] = -inf
        self._extend("others", others)
        self._extend("next", np.where(last, -1, base + to))
        self._extend("id_from", self.id_from[-1] + from_[1:])
        self._extend("ids", ids)
        self.new = []

    @staticmethod
    def _one_by_one(edges, start, to, last, weight, below_, total) -> None:
        """Backward sums over ``edges``, those nearest to their chunks' ends first."""
        sums: dict[int, float] = {}
        rows = zip(*(x[edges].tolist() for x in (start, to, last, weight)), below_[to[edges]].tolist())
        node, own, numbers = -1, [], edges.tolist()
        found = []

        def close() -> None:
            top = max(own)
            sums[node] = top + log(sum(exp(x - top) for x in own))

        for begin, end, is_last, w, known in rows:
            if begin != node:
                if own:
                    close()
                node, own = begin, []
            x = w if is_last else w + sums.get(end, known)
            own.append(x)
            found.append(x)
        if own:
            close()
        total[numbers] = found
        below_[list(sums)] = list(sums.values())

    def ids_of(self, edges: np.ndarray) -> np.ndarray:
        first, n = self.id_from[edges], self.id_from[edges + 1] - self.id_from[edges]
        if (n == 1).all():
            return self.ids[first]
        ends = np.cumsum(n)
        return self.ids[np.repeat(first - (ends - n), n) + np.arange(ends[-1])]


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of ``x`` (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def stirred(key: np.ndarray, *places: np.ndarray | int) -> np.ndarray:
    """The key with the places worked in, one after another."""
    with np.errstate(over="ignore"):
        for place in places:
            key = _mixed(key + (np.asarray(place).astype(np.uint64) + np.uint64(1)) * _MIX[2])
    return key


def uniform(key: np.ndarray, *places: np.ndarray | int) -> np.ndarray:
    """Numbers between 0 and 1, both excluded, fixed by the key and the places."""
    return ((stirred(key, *places) >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def below(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers around ``location``, given that they are below ``top``."""
    with np.errstate(over="ignore"):
        return location - np.log(np.exp(location - top) - np.log(u))


class Sample(NamedTuple):
    ids: np.ndarray
    log_prob: float
    perturbed: float
    log_inclusion: float


class _Path:
    """One drawn segmentation of one text."""

    def __init__(self, edges, nodes, parts, perturbed: float, before: np.ndarray):
        self.edges, self.nodes, self.parts = edges, nodes, parts
        self.perturbed, self.before = perturbed, before
        self.log_prob = float(before[-1])  # before[t]: log probability of the first t edges


class Sampler:
    def __init__(self, path: str, seed: int = SEED):
        self.vocabulary = Vocabulary(path)
        self.lattices = Lattices(self.vocabulary)
        self.seed = seed

    def _walk(self, keys, parts, nodes) -> tuple[np.ndarray, ...]:
        """``keys`` have the number of the draw in them. From each node to the end of its chunk: part's place in the arguments, node and
        edge of every step, by part."""
        lattices = self.lattices
        at, steps, step = np.arange(len(nodes)), [], 0
        node = nodes
        keys = stirred(keys, parts)
        while len(at) > FEW:
            u = uniform(keys[at], step)
            edge = lattices.first[node]
            later = np.flatnonzero(u >= lattices.up_to[edge])
            while len(later):
                edge[later] += 1
                later = later[u[later] >= lattices.up_to[edge[later]]]
            steps.append((at, node, edge))
            node = lattices.next[edge].astype(np.int64)
            going = node >= 0
            at, node, step = at[going], node[going], step + 1
        # A part has an entry in each step up to its last one.
        counts = np.zeros(len(nodes), np.int64)
        for some, _, _ in steps:
            counts[some] += 1
        ends = [self._walk_on(keys[i : i + 1], n, step) for i, n in zip(at.tolist(), node.tolist())]
        counts[at] += np.array([len(edges) for _, edges in ends], np.int64)
        before = np.cumsum(counts) - counts
        all_nodes, all_edges = np.empty((2, counts.sum()), np.int64)
        for i, (some, node, edge) in enumerate(steps):
            places = before[some] + i
            all_nodes[places], all_edges[places] = node, edge
        for i, (own_nodes, own_edges) in zip(at.tolist(), ends):
            place = slice(before[i] + step, before[i] + step + len(own_edges))
            all_nodes[place], all_edges[place] = own_nodes, own_edges
        return np.repeat(np.arange(len(nodes)), counts), all_nodes, all_edges

    def _walk_on(self, key, node: int, step: int) -> tuple[list[int], list[int]]:
        """The rest of one part's walk: nodes and edges, with the same numbers as ``_walk``."""
        first, up_to, next_ = self.lattices.first, self.lattices.up_to, self.lattices.next
        nodes, edges, ahead = [], [], 8
        while node >= 0:
            for u in uniform(key, np.arange(step, step + ahead)).tolist():
                edge = int(first[node])
                while u >= up_to[edge]:
                    edge += 1
                nodes.append(node)
                edges.append(edge)
                node = int(next_[edge])
                if node < 0:
                    break
            step, ahead = step + ahead, min(2 * ahead, 4096)
        return nodes, edges

    def sample(self, texts: Sequence[str], keys: Sequence[int], k: int) -> list[list[Sample]]:
        """For each text its k samples, best first."""
        texts = [normalised(text) for text in texts]
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begins = self.vocabulary.cuts(codes)
        ends = np.cumsum([len(text) for text in texts])
        begins[ends[ends < len(codes)]] = True
        at = np.flatnonzero(begins)
        starts = np.searchsorted(at, np.concatenate([[0], ends[:-1]]))
        sizes = np.diff(starts, append=len(at))
        bounds = [*at.tolist(), len(joined)]
        first = self.lattices.nodes([joined[a:b] for a, b in zip(bounds, bounds[1:])])
        key = np.array([(self.seed * 0x9E3779B97F4A7C15 + x) % 2**64 for x in keys], np.uint64)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        part = np.arange(len(first)) - starts[text_of]
        top = -np.log(-np.log(uniform(key, 0)))  # all segmentations together have weight 1

        drawn: list[list[_Path]] = [[] for _ in texts]
        waiting: list[list[tuple]] = [[] for _ in texts]  # (-priority, path, step, edges left out)
        places, nodes, edges = self._walk(stirred(key, 1)[text_of], part, first)
        owner = text_of[places]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        found = []
        for i in range(len(texts)):
            own = slice(cuts[i], cuts[i + 1])
            found.append((i, float(top[i]), None, 0, edges[own], nodes[own], part[places[own]], ()))
        self._add(drawn, waiting, key, k, 0, found)
        for draw in range(1, k):
            ways = [(i, *waiting[i].pop(0)) for i in range(len(texts)) if waiting[i]]
            if not ways:
                break
            tails = []
            for i, minus, number, step, out in ways:
                path = drawn[i][number]
                tails.append(self._leave(path, key[i], step, out, draw, starts[i], sizes[i], first))
            n = np.array([len(tail[2]) for tail in tails])
            keys_of = stirred(key, draw + 1)[np.repeat([way[0] for way in ways], n)]
            parts = np.concatenate([tail[2] for tail in tails]).astype(np.int64)
            begin = np.concatenate([tail[3] for tail in tails]).astype(np.int64)
            places, nodes, edges = self._walk(keys_of, parts, begin)
            cuts = np.searchsorted(places, np.concatenate([[0], np.cumsum(n)])).tolist()
            found = []
            for w, ((i, minus, number, step, out), tail) in enumerate(zip(ways, tails)):
                path, own = drawn[i][number], slice(cuts[w], cuts[w + 1])
                found.append(
                    (
                        i,
                        -minus,
                        path,
                        step,
                        np.concatenate([[tail[0]], edges[own]]).astype(np.int64),
                        np.concatenate([[path.nodes[step]], nodes[own]]).astype(np.int64),
                        np.concatenate([[path.parts[step]], parts[places[own]]]).astype(np.int64),
                        (*out, tail[0]),
                    )
                )
            self._add(drawn, waiting, key, k, draw, found)
        return [
            [
                Sample(
                    self.lattices.ids_of(path.edges),
                    path.log_prob,
                    path.perturbed,
                    self._inclusion(path.log_prob, -waiting[i][0][0] if waiting[i] else -inf),
                )
                for path in paths
            ]
            for i, paths in enumerate(drawn)
        ]

    @staticmethod
    def _inclusion(log_prob: float, threshold: float) -> float:
        """Log of 1 - exp(-exp(x)); of long texts the score itself would be too small."""
        x = log_prob - threshold
        return float(x if x < -40 else log(-np.expm1(-np.exp(min(x, 700.0)))))

    def _leave(self, path: _Path, key, step: int, out: tuple, draw: int, start, size, first):
        """Another edge at a node of a path, and the parts still to walk from there on."""
        lattices, node, part = self.lattices, path.nodes[step], int(path.parts[step])
        ways = [e for e in range(lattices.first[node], lattices.first[node + 1]) if e not in out]
        chances = np.cumsum(np.exp(lattices.logs[ways]))
        u = float(uniform(key, -draw - 1, part, step))
        edge = ways[min(int(np.searchsorted(chances, u * chances[-1], side="right")), len(ways) - 1)]
        parts, begin = np.arange(part + 1, size), first[start + part + 1 : start + size]
        if lattices.next[edge] >= 0:
            parts = np.concatenate([[part], parts])
            begin = np.concatenate([[lattices.next[edge]], begin])
        return edge, step, parts, begin

    def _add(self, drawn, waiting, key, k: int, number: int, found: list[tuple]) -> None:
        """Keeps a drawn path for each text in ``found`` and the sets that leave it, as many as can
        still be wanted. All texts have ``number`` paths already."""
        lattices, wanted = self.lattices, k - number
        sizes = np.array([len(new[4]) for new in found], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        edges = np.concatenate([new[4] for new in found])
        logs, left = lattices.logs[edges], lattices.others[edges]
        before = np.empty(len(edges))  # of each edge, the log probability of what comes before it
        whole = []
        for new, start, end in zip(found, starts.tolist(), ends.tolist()):
            _, _, path, step, _, nodes, _, out = new
            sums = np.concatenate([[0.0], np.cumsum(logs[start:end])])
            if path:
                sums += path.before[step]
            before[start:end] = sums[:-1]
            whole.append(sums)
            if out:  # at the node where it left another path, more than one edge is out
                node = nodes[0]
                ways = [e for e in range(lattices.first[node], lattices.first[node + 1]) if e not in out]
                left[start] = log(np.exp(lattices.logs[ways]).sum()) if ways else -inf
        open_ = np.flatnonzero(left > -inf)
        of = np.repeat(np.arange(len(found)), sizes)[open_]
        steps = open_ - starts[of] + np.array([new[3] for new in found], np.int64)[of]
        keys = stirred(key[np.array([new[0] for new in found], np.int64)], number + 1, -1)
        u = uniform(keys[of], steps)
        top = np.array([new[1] for new in found])[of]
        priority = below(before[open_] + left[open_], top, u)
        cuts = np.searchsorted(of, np.arange(len(found) + 1)).tolist()
        for j, (i, perturbed, path, step, own_edges, own_nodes, own_parts, out) in enumerate(found):
            own, sums = priority[cuts[j] : cuts[j + 1]], whole[j]
            if len(own) > wanted:
                keep = np.argpartition(-own, wanted)[:wanted]
            else:
                keep = np.arange(len(own))
            if path:
                own_edges, own_nodes, own_parts = (
                    np.concatenate([a[:step], b])
                    for a, b in ((path.edges, own_edges), (path.nodes, own_nodes), (path.parts, own_parts))
                )
                sums = np.concatenate([path.before[:step], sums])
            drawn[i].append(_Path(own_edges, own_nodes, own_parts, perturbed, sums))
            for place in keep.tolist():
                at = int(steps[cuts[j] + place])
                left_out = out if out and at == step else (int(own_edges[at]),)
                waiting[i].append((-float(own[place]), number, at, left_out))
            waiting[i].sort(key=lambda way: way[:3])
            del waiting[i][wanted:]


def sample_segmentations(
    docs: DataFrame,
    k: int = SAMPLES,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Up to k rows for each row: ``sample`` (from 1, largest perturbed value first),
    ``ids``, ``log_prob``, ``perturbed``, ``log_inclusion``, the log of the inclusion score,
    and ``round_trip``, whether the ids decode to the text."""
    shared = share(docs.sparkSession, (path or model_file(), seed))

    def work(batches: Iterator[dict[str, list]]) -> Iterator[list]:
        sampler = per_worker(shared, lambda given: Sampler(*given))
        for batch in batches:
            doc_ids, texts = batch[id_col], [text or "" for text in batch[text_col]]
            sizes = np.cumsum([len(text) for text in texts]) // AT_ONCE
            for group in np.unique(sizes):
                rows = np.flatnonzero(sizes == group).tolist()
                keys = [xxhash.xxh64_intdigest(str(doc_ids[i])) for i in rows]
                found = sampler.sample([texts[i] for i in rows], keys, k)
                out = []
                for i, samples in zip(rows, found):
                    # What spells the text as the model wants it decodes to the text, unless
                    # that has marks of its own.
                    spelt = normalised(texts[i]).encode("utf-8", "replace")
                    marked = MARK in texts[i]
                    out += [
                        (
                            doc_ids[i],
                            place,
                            one.ids,
                            one.log_prob,
                            one.perturbed,
                            one.log_inclusion,
                            not marked and sampler.vocabulary.spells(one.ids, spelt),
                        )
                        for place, one in enumerate(samples, 1)
                    ]
                yield list(zip(*out)) if out else [[]] * 7

    return map_rows(
        docs.select(id_col, text_col),
        f"`{id_col}` {type_of(docs, id_col)}, sample int, ids array<int>, log_prob double, "
        "perturbed double, log_inclusion double, round_trip boolean",
        work,
    )


def decode(
    encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None
) -> DataFrame:
    """``id_col`` and ``text`` for each row; NULL ids give a NULL text."""
    shared = share(encoded.sparkSession, path or model_file())

    def work(batches: Iterator[dict[str, list]]) -> Iterator[list]:
        vocabulary = per_worker(shared, Vocabulary)
        for batch in batches:
            yield [
                batch[id_col],
                [None if ids is None else vocabulary.decode(ids) for ids in batch[ids_col]],
            ]

    return map_rows(
        encoded.select(id_col, ids_col), f"`{id_col}` {type_of(encoded, id_col)}, text string", work
    )
