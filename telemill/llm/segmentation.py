"""Sampled SentencePiece segmentations: Gumbel top-k without replacement by perturbed A* over the lattice."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SHARPNESS = 1.0
UNIT = 1 << 31  # no text has as many characters: a stretch between two spaces is one unit, however long
SHORT = 95  # characters of a unit whose lattice is built on slices, together with all others
WIDE = 16  # characters of a model's longest piece up to which that is done
BATCH_CHARS = 1_000_000
NODES = 2_000_000
BUILD_CHARS = 1_000_000
WINDOW = 32  # pieces behind a branch that are looked at first
NEAR = 8  # edges of a node that are read at once
_SPACE = "▁"
_LEVEL = 2.2  # a constant factor per character, which keeps products of weights within a double's range
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(44)  # the first 20 bits of a hash say whether any piece can have it
# Of a byte's bits, from the lowest on: how many are set before the first that is not.
_RUN = np.array([NEAR if b == 255 else (~b & -~b).bit_length() - 1 for b in range(256)], np.int64)
_REACH = 37.0  # -log(-log(u)) is below it for every number that _noise draws


def _noise(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from a counter: the same wherever and whenever they are drawn."""
    return _mixed(seed + counter.astype(np.uint64) * _MULT)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(12)
    out = x.astype(np.float64)
    out += 0.5
    out /= float(1 << 52)
    return out


# Multipliers of a unit's characters, by their place in it; they come again in longer units, times another number.
_POWERS = (_noise(np.zeros(1, np.uint64), np.arange(1, 2 * SHORT + 2)) * float(1 << 53)).astype(np.uint64)
_POWERS = (_POWERS[:SHORT] << np.uint64(32)) ^ _POWERS[SHORT + 1 :] | np.uint64(1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Pieces:
    """The vocabulary as tables: ids by hash of their characters, weights, and bytes for decoding."""

    def __init__(self, model: bytes, sharpness: float = SHARPNESS):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        by_length: dict[int, list[int]] = {}
        data: list[bytes] = []
        rank = 0
        self.weights = np.full(size, -np.inf)
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                data.append(bytes([int(piece[3:5], 16)]))
                continue
            plain = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
            data.append(piece.replace(_SPACE, " ").encode() if plain else b"")
            if plain:
                rank += 1
                # Merges are ranked by frequency, so a piece's probability falls off with its rank.
                self.weights[i] = -sharpness * np.log(rank + 1)
                by_length.setdefault(len(piece), []).append(i)
        self.longest = max(by_length, default=1)
        # Of an id, of "a character's bytes" (-2) and of "no piece" (-1).
        self.factors = np.concatenate([np.exp(self.weights), [float(size) ** -sharpness, 0.0]])
        self.logs = np.concatenate([self.weights, [-sharpness * np.log(size), -np.inf]])
        hashes = [np.zeros(0, np.uint64)]
        # By the first bits of a hash: whether there may be pieces (1), and starts of longer ones (2).
        self.met = np.zeros(1 << 20, np.uint8)
        for length, found in by_length.items():
            text = "".join(sp.id_to_piece(i).replace(_SPACE, " ") for i in found)
            hashes.append(np.zeros(len(found), np.uint64))
            for k, column in enumerate(_points(text).reshape(-1, length).T):
                if k:
                    self.met[hashes[-1] >> _SLOT] |= 2
                hashes[-1] += column.astype(np.uint64) + np.uint64(1)
                hashes[-1] *= _MULT
        self.hashes = np.concatenate(hashes)
        order = np.argsort(self.hashes)
        self.hashes, self.ids = self.hashes[order], np.array([i for found in by_length.values() for i in found], np.int32)[order]
        # Where a slot's pieces start, and how many share a slot at most.
        slots = (self.hashes >> _SLOT).astype(np.int64)
        self.met[slots] |= 1
        self.first = np.zeros(1 << 20, np.int32)
        self.first[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.shared = int(np.bincount(slots).max()) if len(slots) else 0
        self.sizes = np.array([len(d) for d in data], np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int32)
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes are of pieces, the pieces' ids, and which may be of starts of longer pieces."""
        slots = (hashed >> _SLOT).view(np.int64)
        met = self.met.take(slots)
        at = np.flatnonzero(met & 1)
        place, asked = self.first.take(slots.take(at)), hashed.take(at)
        hits, ids = [], []
        for _ in range(self.shared):
            hit = self.hashes.take(place, mode="clip") == asked
            hits.append(at[hit])
            ids.append(self.ids.take(place[hit]))
            on = np.flatnonzero(~hit)
            if not len(on):
                break
            at, place, asked = at.take(on), place.take(on) + 1, asked.take(on)
        return np.concatenate([at[:0], *hits]), np.concatenate([self.ids[:0], *ids]), np.flatnonzero(met & 2)

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of the ids: bytes of the pieces, without the space that encoding put in front."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int32)
        places = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        places += np.arange(len(places), dtype=np.int32)
        out = self.data[places].tobytes()
        return out[1:] if out[:1] == b" " else out


def _rows(most: int, longest: int) -> np.ndarray:
    """Edges of the nodes with fewer characters up to the unit's end, by that number: a node has one for each length there is."""
    return np.concatenate([[0], np.cumsum(np.minimum(np.arange(1, most + 1), longest))])


def _lattices(
    points: np.ndarray, size: np.ndarray, pieces: Pieces, first: np.ndarray, ids: np.ndarray, cum: np.ndarray, rows: np.ndarray
) -> None:
    """Writes the lattices of units, given their characters one after another, into ``ids`` and ``cum``, from ``first`` on.

    A unit's nodes are told apart by the number of characters up to its end, and nodes with the same number are
    worked on together, from the last characters back: with longer units first, each step is on slices.
    """
    order = np.argsort(-size, kind="stable")
    first, end, size = first[order], np.cumsum(size)[order], size[order]
    long = int(np.searchsorted(-size, -SHORT)) if pieces.longest <= WIDE else len(size)
    if long:
        _long_lattices(points, size[:long], end[:long], pieces, first[:long], ids, cum, rows)
        first, end, size = first[long:], end[long:], size[long:]
        if not len(size):
            return
    level = np.exp(_LEVEL * np.arange(1, pieces.longest + 1))
    codes, ways = [], [np.ones(len(size))]  # by distance: hashed characters, and sums over all ways to the end
    for r in range(1, int(size[0]) + 1):
        n = int(np.searchsorted(-size, -r, side="right"))
        point = points.take(end[:n] - r)
        codes.append(point.astype(np.uint64) + np.uint64(1))
        width = min(r, pieces.longest)
        found, weight = np.full((width, n), -1, np.int32), np.zeros((width, n))
        on, rolling = np.arange(n), np.zeros(n, np.uint64)
        for length in range(1, width + 1):
            rolling += codes[r - length].take(on)
            rolling *= _MULT
            hit, piece, longer = pieces.find(rolling)
            hit = on.take(hit)
            found[length - 1, hit] = piece
            if length == 1:
                # A character that is no piece is written as bytes: the edge with id -2.
                hit = on
                found[0, found[0] == -1] = -2
                piece = found[0]
            weight[length - 1, hit] = pieces.factors[piece] * level[length - 1] * ways[r - length].take(hit)
            on, rolling = on.take(longer), rolling.take(longer)
            if not len(on):
                break
        # What takes one byte has its id here.
        alone = np.flatnonzero((found[0] == -2) & (point < 128))
        found[0, alone] = pieces.byte_ids[point[alone]]
        # One by one, so that the width of the table has no part in it.
        np.cumsum(weight, axis=0, out=weight)
        ways.append(weight[-1].copy())
        weight /= ways[r]
        places = (first[:n] + rows[r - 1])[:, None] + np.arange(width)
        ids[places] = found.T
        cum[places] = weight.T


def _long_lattices(
    points: np.ndarray, size: np.ndarray, end: np.ndarray, pieces: Pieces, first: np.ndarray, ids: np.ndarray, cum: np.ndarray, rows: np.ndarray
) -> None:
    """The same for units of any length, longest first: pieces are found at all places at once, and only sums over the
    ways to the end go back node by node, as logarithms, which no length takes out of a double's range."""
    ends = np.cumsum(size)
    point = points.take(np.repeat(end - ends, size) + np.arange(ends[-1]))
    left = np.repeat(ends, size) - np.arange(ends[-1])
    edge = np.repeat(first, size) + rows.take(left - 1)
    for a, b in zip(first.tolist(), (first + rows.take(size)).tolist()):
        ids[a:b], cum[a:b] = -1, -np.inf
    code = point.astype(np.uint64) + np.uint64(1)
    on, rolling = np.arange(len(point)), np.zeros(len(point), np.uint64)
    for length in range(1, pieces.longest + 1):
        rolling += code.take(on + (length - 1))
        rolling *= _MULT
        hit, piece, longer = pieces.find(rolling)
        places = edge.take(on.take(hit)) + (length - 1)
        ids[places], cum[places] = piece, pieces.logs.take(piece)
        if length == 1:
            none = np.flatnonzero(ids.take(edge) == -1)
            ids[edge[none]], cum[edge[none]] = -2, pieces.logs[-2]
            alone = none[point[none] < 128]
            ids[edge[alone]] = pieces.byte_ids[point[alone]]
        on, rolling = on.take(longer), rolling.take(longer)
        inside = np.flatnonzero(left.take(on) > length)
        on, rolling = on.take(inside), rolling.take(inside)
        if not len(on):
            break
    ways = np.zeros((pieces.longest, len(size)))  # by distance, the last ones, one after another in a ring
    for r in range(1, int(size[0]) + 1):
        n = int(np.searchsorted(-size, -r, side="right"))
        lengths = np.arange(min(r, pieces.longest))
        places = (first[:n] + rows[r - 1])[:, None] + lengths
        weight = cum.take(places) + ways[(r - 1 - lengths) % pieces.longest, :n].T
        top = weight.max(axis=1)
        weight = np.exp(np.ascontiguousarray(weight - top[:, None]))
        np.cumsum(weight, axis=1, out=weight)
        whole = weight[:, -1].copy()
        ways[r % pieces.longest, :n] = top + np.log(whole)
        cum[places] = weight / whole[:, None]


class Units:
    """Units met, and their lattices one after another; started anew when ``NODES`` is exceeded.

    The node with ``r`` characters up to the end of unit ``k`` has its edges from ``first[k] + rows[r - 1]`` on, by length.
    ``ids`` has their pieces: -1 is none, -2 a character that is no piece and takes several bytes. ``cum`` has the running
    sums of their probabilities, given the node.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        # Beyond the last edge is room for more, so that units to come move nothing.
        self.ids = np.empty(0, np.int32)
        self.cum = np.empty(0)
        self.rows = _rows(SHORT, pieces.longest)
        self.reset()

    def reset(self) -> None:
        self.edges = 0
        self.points = np.zeros(0, np.uint32)  # characters of all units
        self.first, self.size, self.begin = np.zeros((3, 0), np.int64)
        self.hashes, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted, and whose they are

    def numbers(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the units that start at these places; those not met before get their lattices."""
        offset = np.arange(len(points)) - np.repeat(start, size)
        parts = points.astype(np.uint64)
        parts += np.uint64(1)
        parts *= _POWERS.take(offset, mode="wrap")
        far = np.flatnonzero(offset >= len(_POWERS))
        parts[far] *= (offset[far] // len(_POWERS)).astype(np.uint64) * _MULT | np.uint64(1)
        hashes, one, same = np.unique(np.add.reduceat(parts, start), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, hashes)
        number = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(place < len(self.hashes))
        at = at[self.hashes[place[at]] == hashes[at]]
        number[at] = self.known[place[at]]
        new = np.flatnonzero(number < 0)
        number[new] = self._add(points, start[one[new]], size[one[new]])
        self.hashes = np.insert(self.hashes, place[new], hashes[new])
        self.known = np.insert(self.known, place[new], number[new])
        number = number[same]
        # A unit whose hash is another's gets a lattice of its own each time.
        differ = self.size[number] != size
        there = np.minimum(np.repeat(self.begin[number], size) + offset, len(self.points) - 1)
        differ |= np.logical_or.reduceat(self.points.take(there) != points, start)
        differ = np.flatnonzero(differ)
        number[differ] = self._add(points, start[differ], size[differ])
        return number

    def _add(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of new units."""
        count = len(self.size)
        if not len(start):
            return np.zeros(0, np.int64)
        if size.max() >= len(self.rows):
            self.rows = _rows(2 * int(size.max()), self.pieces.longest)
        edges, ends = np.cumsum(self.rows[size]) + self.edges, np.cumsum(size)
        first = edges - self.rows[size]
        points = points[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
        self.edges, old = int(edges[-1]), self.edges
        if self.edges + NEAR > len(self.cum):
            room = max(self.edges + NEAR, 2 * len(self.cum), 8 * NODES)
            ids, cum = self.ids, self.cum
            self.ids, self.cum = np.empty(room, np.int32), np.empty(room)
            self.ids[:old], self.cum[:old] = ids[:old], cum[:old]
        a = 0
        while a < len(size):
            # Some at a time, which bounds what a step holds.
            c = int(ends[a] - size[a])
            b = max(a + 1, int(np.searchsorted(ends, c + BUILD_CHARS)))
            _lattices(points[c : ends[b - 1]], size[a:b], self.pieces, first[a:b], self.ids, self.cum, self.rows)
            a = b
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])
        self.begin = np.concatenate([self.begin, ends - size + len(self.points)])
        self.points = np.concatenate([self.points, points])
        return np.arange(count, count + len(size))

    def share(self, edge: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probabilities of edges of these lengths, given the node."""
        return self.cum.take(edge) - np.where(length > 1, self.cum.take(np.maximum(edge - 1, 0)), 0.0)


class Paths:
    """Pieces by the place of their first character in a batch: length, id, and probability given the node."""

    def __init__(self, total: int):
        self.step, self.ids, self.p = np.zeros(total, np.int16), np.empty(total, np.int32), np.empty(total)

    def put(self, lat: Units, place: np.ndarray, edge: np.ndarray, length: np.ndarray) -> None:
        self.step[place] = length
        self.ids[place] = lat.ids.take(edge)
        self.p[place] = lat.share(edge, length)


def _descend(
    lat: Units, first: np.ndarray, left: np.ndarray, place: np.ndarray, count: np.ndarray, paths: Paths
) -> None:
    """Sample from each node on to its unit's end.

    ``first`` is where a unit's edges start, ``left`` the number of characters up to its end, and ``count`` the seed plus the
    noise counter of ``place``, which is counted from the place at which the document starts.
    """
    near = np.ndarray((len(lat.cum) - NEAR + 1,), f"V{8 * NEAR}", lat.cum, 0, (8,))  # edges that follow one another
    longest = lat.pieces.longest
    while len(first):
        u = _mixed(count)
        node = first + lat.rows.take(left - 1)
        sums = near[node].view(np.float64).reshape(-1, NEAR)
        # What a node's last edge is followed by is another's: its sum is 1, so no number goes beyond it.
        length = _RUN.take(np.packbits(sums <= u[:, None], bitorder="little"))
        far = np.flatnonzero((length == NEAR) & (left > NEAR))
        for at in range(NEAR, longest):
            if not len(far):
                break
            far = far[lat.cum[node[far] + at - 1] <= u[far]]
            length[far] = at
        np.minimum(length, np.minimum(left, longest) - 1, out=length)
        node += length
        length += 1
        paths.put(lat, place, node, length)
        left = left - length
        on = np.flatnonzero(left)
        length = length.take(on)
        first, left, place = first.take(on), left.take(on), place.take(on) + length
        count = count.take(on) + length.astype(np.uint64) * _MULT


def _truncated(phi: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbels with location ``phi``, given that they are below ``top``."""
    return phi - np.log(np.exp(np.minimum(phi - top, 700)) - np.log(u))


class Path:
    """A segmentation: places of its pieces, their ids, and running sums of their log probabilities, 0 first."""

    __slots__ = ("spots", "ids", "run")

    def __init__(self, spots: np.ndarray, ids: np.ndarray, run: np.ndarray):
        self.spots, self.ids, self.run = spots, ids, run


class Branch:
    """Pieces other than ``shut`` after the first ``kept`` of ``path``: their total, and the largest perturbed value below."""

    __slots__ = ("value", "total", "kept", "shut", "path")

    def __init__(self, value: float, total: float, kept: int, shut: frozenset, path: Path):
        self.value, self.total, self.kept, self.shut, self.path = value, total, kept, shut, path


class Document:
    """Open branches of one document's search, best first, and the segmentations found."""

    __slots__ = ("open", "found")

    def __init__(self) -> None:
        self.open: list[Branch] = []
        self.found: list[tuple[np.ndarray, float, float]] = []


def _branches(
    path: Path, kept: int, p: np.ndarray, top: float, salt: np.uint64, start: int, want: int, shut: frozenset, rest0: float
) -> list[tuple[float, float, int]]:
    """Up to ``want`` best ``(perturbed value, total, place on the path)`` beside its pieces from ``kept`` on.

    A value exceeds the log probability of the path before it by less than ``_REACH``, which falls with
    each piece. So pieces further behind are looked at only as far as the first ones leave room for them, and values
    are drawn only where bounds of theirs, which take no logarithms, leave room too.
    """
    run, spots = path.run[kept:-1], path.spots[kept:]
    rest = 1 - p
    if shut:
        rest[0] = rest0
    rest[rest < 1e-12] = 0
    salt = salt + np.uint64(3)

    def best_of(at: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        phi = run[at] + np.log(rest[at])
        g = _truncated(phi, top, u)
        g[rest[at] == 0] = -np.inf
        best = np.argpartition(-g, want - 1)[:want] if len(g) > want else np.arange(len(g))
        return g[best], phi[best], at[best]

    g, phi, at = best_of(np.arange(min(WINDOW, len(p))), _noise(salt, spots[:WINDOW] - start))
    if len(p) > WINDOW:
        least = g.min()
        end = int(np.searchsorted(-run, _REACH - least, side="right"))
        if end > WINDOW:
            u = _noise(salt, spots[WINDOW:end] - start)
            # -log(u) is at least 1 - u.
            may = np.flatnonzero(rest[WINDOW:end] >= (1 - u) * np.exp(least - 1e-6 - run[WINDOW:end]))
            if len(may):
                at = np.concatenate([at, may + WINDOW])
                g, phi, at = best_of(at, _noise(salt, spots[at] - start))
    return [(float(g[k]), float(phi[k]), int(at[k])) for k in range(len(g)) if g[k] > -np.inf]


def _cut(points: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where units start: at the first of some spaces, with all that follows up to the next ones. Each document starts with a space."""
    blank = points == 32
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[doc_start] = True
    return np.flatnonzero(start)


def sample_segmentations(
    texts: list[str], seeds: list[int], lat: Units, samples: int
) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per text up to ``samples`` different segmentations ``(ids, log probability, inclusion score)``.

    The search keeps, per text, branches of the tree of all segmentations: a place on a found
    path where other pieces are still open, with their total probability and the largest of
    the perturbed log probabilities below. The best branch is always followed next: its best segmentation has the same
    perturbed value, so one descent finds it, and what is left over beside the descent makes new
    branches, whose values are drawn given that bound. That yields the top of all perturbed log
    probabilities in order. Each score is the chance to exceed the first value that was not taken.
    """
    if len(lat.points) > NODES:
        lat.reset()
    docs = [Document() for _ in texts]
    lengths = np.array([len(text) + 1 if text else 0 for text in texts], np.int64)
    total = int(lengths.sum())
    if not total:
        return [[(np.zeros(0, np.int32), 0.0, 1.0)] for _ in texts]
    doc_end = np.cumsum(lengths)
    doc_start = doc_end - lengths
    points = _points("".join(" " + text for text in texts if text))
    place0 = _cut(points, doc_start[lengths > 0])
    size = np.diff(place0, append=total)
    end = place0 + size
    number = lat.numbers(points, place0, size)
    first = lat.first[number]
    owner = np.searchsorted(doc_end, place0, side="right")
    counter0 = (place0 - doc_start[owner]).astype(np.uint64) * _MULT
    seed = np.array(seeds, np.uint64)

    for turn in range(samples):
        salt = seed + np.uint64(0x632BE59BD9B4E019 * (turn + 1) & ((1 << 64) - 1))
        paths = Paths(total)
        value = np.zeros(len(texts))
        chosen: list[Branch | None] = [None] * len(texts)
        if turn == 0:
            ready = np.flatnonzero(lengths)
            begin = doc_start
            value = -np.log(-np.log(_noise(salt + np.uint64(1), np.zeros(len(texts)))))
            _descend(lat, first, size, place0, salt[owner] + counter0, paths)
            for i in np.flatnonzero(lengths == 0):
                docs[i].found = [(np.zeros(0, np.int32), 0.0, 0.0)]
        else:
            chosen = [d.open.pop(0) if d.open else None for d in docs]
            ready = np.flatnonzero([b is not None for b in chosen])
            if not len(ready):
                break
            begin = doc_end.copy()  # where each document's new path leaves the old one
            for i in ready:
                value[i], begin[i] = chosen[i].value, chosen[i].path.spots[chosen[i].kept]
            at = begin[ready]
            unit = np.searchsorted(end, at, side="right")
            left = end[unit] - at
            node = first[unit] + lat.rows[left - 1]
            u = _noise(salt[ready] + np.uint64(2), at - doc_start[ready])
            length = np.empty(len(ready), np.int64)
            for j, i in enumerate(ready):
                p = np.diff(lat.cum[node[j] : node[j] + min(left[j], lat.pieces.longest)], prepend=0.0)
                p[[x - 1 for x in chosen[i].shut]] = 0
                p = np.cumsum(p)
                length[j] = np.searchsorted(p, u[j] * p[-1], side="right") + 1
            paths.put(lat, at, node + length - 1, length)
            # On to the end of that unit, and through all units behind it.
            on, later = np.flatnonzero(left > length), np.flatnonzero(place0 > begin[owner])
            own, behind = ready[on], (at + length)[on]
            count = salt[own] + (behind - doc_start[own]).astype(np.uint64) * _MULT
            _descend(
                lat,
                np.concatenate([first[unit[on]], first[later]]),
                np.concatenate([(left - length)[on], size[later]]),
                np.concatenate([behind, place0[later]]),
                np.concatenate([count, salt[owner[later]] + counter0[later]]),
                paths,
            )
        spots = np.flatnonzero(paths.step)
        ids, p = paths.ids.take(spots), paths.p.take(spots)
        log_p = np.log(np.maximum(p, 1e-300))
        wide = len(ids) and ids.min() < 0
        cut = np.searchsorted(spots, np.concatenate([doc_start, [total]])).tolist()
        want = samples - turn  # branches that may still be needed, one of them for the scores
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            for i in ready.tolist():
                a, b = cut[i], cut[i + 1]
                doc, branch, kept, shut, rest0 = docs[i], chosen[i], 0, frozenset(), 1.0
                if branch is None:
                    path = Path(spots[a:b], ids[a:b], np.concatenate([[0.0], np.cumsum(log_p[a:b])]))
                else:
                    old, kept = branch.path, branch.kept
                    run = np.cumsum(np.concatenate([old.run[kept : kept + 1], log_p[a:b]]))
                    path = Path(
                        np.concatenate([old.spots[:kept], spots[a:b]]),
                        np.concatenate([old.ids[:kept], ids[a:b]]),
                        np.concatenate([old.run[:kept], run]),
                    )
                    shut = branch.shut | {int(paths.step[begin[i]])}
                    j = int(np.searchsorted(ready, i))
                    cum = np.diff(lat.cum[node[j] : node[j] + min(left[j], lat.pieces.longest)], prepend=0.0)
                    rest0 = 1 - sum(cum[x - 1] for x in shut)
                top = float(value[i])
                out = path.ids
                if wide or branch is not None:
                    out = _with_bytes(path, texts[i], int(doc_start[i]), lat.pieces)
                doc.found.append((out, float(path.run[-1]), top))
                for g, phi, k in _branches(path, kept, p[a:b], top, salt[i], int(doc_start[i]), want, shut, rest0):
                    closed = shut if k == 0 else frozenset()
                    doc.open.append(Branch(g, phi, kept + k, closed | {int(paths.step[path.spots[kept + k]])}, path))
                doc.open = sorted(doc.open, key=lambda x: -x.value)[:want]

    out = []
    for doc in docs:
        bound = doc.open[0].value if doc.open else -np.inf
        out.append([(ids, lp, float(-np.expm1(-np.exp(min(lp - bound, 700.0))))) for ids, lp, _ in doc.found])
    return out


def _with_bytes(path: Path, text: str, start: int, pieces: Pieces) -> np.ndarray:
    """Ids with characters that are no piece written as the ids of their bytes."""
    ids = path.ids
    at = np.flatnonzero(ids < 0)
    if not len(at):
        return ids
    parts, last = [], 0
    for k, spot in zip(at.tolist(), (path.spots[at] - start).tolist()):
        char = text[spot - 1] if spot else " "
        parts += [ids[last:k], pieces.byte_ids[list(char.encode("utf-8", "surrogatepass"))]]
        last = k + 1
    return np.concatenate([*parts, ids[last:]]).astype(np.int32)


def _batches(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BATCH_CHARS:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def encode_samples(
    docs: DataFrame, model: str = MODEL, samples: int = SAMPLES, sharpness: float = SHARPNESS, seed: int = 0
) -> DataFrame:
    """``(doc_id, rank, ids, log_prob, inclusion, round_trip)``: sampled segmentations of each row, best perturbed first.

    Segmentations of a text differ from one another; a text with fewer than ``samples`` has all of them. They are
    made of the pieces of the model at path ``model``, a piece's probability falling off with its rank to the power
    ``sharpness``; characters that are no piece become byte ids. As in the model itself pieces don't reach across the
    start of a word, and nowhere else is a text cut. ``inclusion`` is the probability of being
    among the samples, given the first perturbed value left out (1 if nothing was). ``round_trip`` says whether ``ids`` decode
    to the text. Numbers depend on ``seed`` and ``doc_id`` (the text, where that is null) alone, so repeated rows give equal rows. A null
    or empty text has one segmentation without ids. Other columns are ignored.
    """
    with open(model, "rb") as f:
        proto = f.read()  # half a megabyte, sent along with the code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Units(Pieces(proto, sharpness))
        for batch in batches:
            whole = text_bytes(batch.column(1))
            whole = [t or b"" for t in whole]
            keys = batch.column(0).to_pylist()
            for a, b in _batches(batch, whole):
                texts = [t.decode("utf-8") for t in whole[a:b]]
                seeds = [
                    xxhash.xxh64_intdigest(t if key is None else str(key), seed) for key, t in zip(keys[a:b], whole[a:b])
                ]
                found = sample_segmentations(texts, seeds, lattices, samples)
                rows = [(i, r, *x) for i, all_of in enumerate(found) for r, x in enumerate(all_of)]
                take = pa.array([a + r[0] for r in rows], pa.int64())
                ends = np.cumsum([0, *(len(r[2]) for r in rows)])
                flat = np.concatenate([r[2] for r in rows]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                        pa.array([r[3] for r in rows], pa.float64()),
                        pa.array([r[4] for r in rows], pa.float64()),
                        pa.array([lattices.pieces.decode(r[2]) == whole[a + r[0]] for r in rows], pa.bool_()),
                    ],
                    ["doc_id", "rank", "ids", "log_prob", "inclusion", "round_trip"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {key}, rank int, ids array<int>, log_prob double, inclusion double, round_trip boolean"
    )


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, rank, text)`` of rows with ``ids``; null ids give a null text. Unknown ids fail."""
    with open(model, "rb") as f:
        proto = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(proto)
        for batch in batches:
            texts = [
                pieces.decode(np.asarray(x.values, dtype=np.int32)).decode("utf-8", "replace") if x.is_valid else None
                for x in batch.column(2)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "rank", "text"]
            )

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "rank", "ids").mapInArrow(run, f"doc_id {key}, rank int, text string")
