"""SentencePiece encoding and decoding with the N best segmentations.

The lattice of a text has an edge for each piece that matches somewhere, and a byte edge for characters without a piece.
A forward Viterbi pass gives the best score up to each place. These scores are exact heuristics for a backward A-star
search: a partial path from the end costs what it loses against the best one, and its best completion loses nothing more,
so each partial path that is taken from the queue is completed along edges without loss at once, and the edges beside it
enter the queue. Only the N best waiting paths are kept, which is all that can still be among the N best.

Pieces never run over a place where a new run of spaces or line ends begins, so a text's lattice falls apart into units.
The forward pass over a unit gives its best path and the least loss beside it (short units met before are remembered in
a bounded table). The N - 1 least losses bound what the N best segmentations of a text lose, so only units with a loss
within the bound are searched for their N best, and these merge to the text's: N whole lists of ids, each of which is
decoded and compared with the text.

The scores are those stored in the model. Normalisation is the model's: spaces become U+2581, and one is put in front.

Defined cases: a null or empty text has no pieces and score 0; U+2581 in a text decodes as a space, as it does in
SentencePiece, so that such a text does not come back; very long texts, and units without any space, are read whole, in
memory linear in their length; of segmentations with equal scores those with the smaller ids from the end come first
(scores that are whole numbers, as the model's, are summed exactly); repeated rows give equal results; an empty table
gives an empty result; other columns are kept.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise
from math import inf
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gleanery.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
N_BEST = 4
#: Units remembered by a worker after the forward pass and after the search, and the longest that is.
REMEMBERED, SEARCHED, LONGEST = 500_000, 40_000, 64
#: What stands before a remembered unit's ids: its best score and its least loss.
HEAD = struct.Struct("dd")
#: Characters of the texts that a worker segments before it hands their rows over.
CHUNK = 1_000_000

#: An edge of the lattice by where it ends: (length, score, ids as 32-bit numbers, ids from the end).
Edge = tuple[int, float, bytes, tuple[int, ...]]


class Recent:
    """A table of at most `room` results by unit: a full half becomes the older half, from which units in use come back."""

    def __init__(self, make: Callable[[str], object], room: int) -> None:
        self.make, self.half = make, room // 2
        self.newer: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def __call__(self, unit: str) -> object:
        found = self.newer.get(unit)
        if found is None:
            found = self.older.get(unit) or self.make(unit)
            if len(unit) <= LONGEST:
                if len(self.newer) >= self.half:
                    self.older, self.newer = self.newer, {}
                self.newer[unit] = found
        return found


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their scores, and the id of the first of 256 byte pieces."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    first_byte: int
    special: frozenset[int]


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read on the driver; the vocabulary goes to the tasks with the function."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = frozenset(i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    return Vocabulary(tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids), model.piece_to_id("<0x00>"), special)


class Lattice:
    """N-best search over the pieces of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary, n_best: int = N_BEST) -> None:
        self.vocabulary, self.n_best = vocabulary, n_best
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces) if i not in vocabulary.special and p}
        usual = [s for i, s in enumerate(vocabulary.scores) if i not in vocabulary.special and s > -1e8]
        self.byte_score = min(usual, default=0.0) - 10.0
        self.single = {p for p in self.ids if len(p) == 1}
        self.matcher = self._matcher()
        self.cutter = self._cutter()
        self.spelled = self._spelled()
        self.numbers = pa.array([str(i) for i in range(len(vocabulary.pieces))])
        self.known, self.ranked = Recent(self.packed, REMEMBERED), Recent(self.search, SEARCHED)

    def _matcher(self) -> ahocorasick.Automaton:
        """Gives the edge of each piece that ends at a place, places in order."""
        found = ahocorasick.Automaton()
        for piece, k in self.ids.items():
            found.add_word(piece, (len(piece), self.vocabulary.scores[k], array("i", (k,)).tobytes(), (k,)))
        found.make_automaton()
        return found

    def _cutter(self) -> re.Pattern:
        """Units start where a run of the characters begins that no piece holds after another character."""
        starts = {chr(c) for c in range(128) if not chr(c).isalnum()} | {SPACE}
        while bad := {b for p in self.ids for a, b in pairwise(p) if b in starts and a not in starts}:
            starts -= bad
        inside = "".join(map(re.escape, sorted(starts)))
        return re.compile(f"[{inside}]+[^{inside}]*|[^{inside}]+", re.DOTALL)

    def _spelled(self) -> pa.Array:
        """The UTF-8 bytes that each id stands for, U+2581 as a space."""
        first = self.vocabulary.first_byte
        spell = lambda i, p: bytes([i - first]) if first <= i < first + 256 else p.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        return pa.array([spell(i, p) for i, p in enumerate(self.vocabulary.pieces)], pa.binary())

    def edges(self, unit: str) -> Iterator[tuple[int, Edge]]:
        """The edges of a unit's lattice, each after the place of its last character; places in order."""
        found = self.matcher.iter(unit) if self.ids else ()
        if self.single.issuperset(unit):
            return found
        spelled = []
        for i, c in enumerate(unit):
            if c not in self.single:
                ids = array("i", [self.vocabulary.first_byte + b for b in c.encode("utf-8", "surrogatepass")])
                spelled.append((i, (1, self.byte_score, ids.tobytes(), tuple(ids[::-1]))))
        return sorted([*found, *spelled], key=itemgetter(0))

    def best(self, unit: str) -> tuple[float, bytes, float]:
        """(best score, its ids, the least loss of any other path) of a unit by the forward pass."""
        size = len(unit)
        best, second, lead = [-inf] * size + [0.0], [-inf] * size, [None] * size  # by last character; the start, before the first, is at -1
        for end, edge in self.edges(unit):
            score, top = best[end - edge[0]] + edge[1], best[end]
            if score > top:
                best[end], second[end], lead[end] = score, top, edge
            elif score == top:
                second[end] = top
                if edge[3] < lead[end][3]:
                    lead[end] = edge
            elif score > second[end]:
                second[end] = score
        at, path, least = size - 1, [], inf
        while at >= 0:
            edge = lead[at]
            path.append(edge[2])
            lost = best[at] - second[at]
            if lost < least:
                least = lost
            at -= edge[0]
        path.reverse()
        return best[size - 1], b"".join(path), least

    def packed(self, unit: str) -> bytes:
        """What best() gives as one object, HEAD and ids: half the memory of a tuple with its parts."""
        score, ids, least = self.best(unit)
        return HEAD.pack(score, least) + ids

    def search(self, unit: str) -> list[tuple[float, list[int], bytes]]:
        """Up to n_best (loss, ids from the end, ids) of a unit, best first."""
        best, lead = [0.0] + [-inf] * len(unit), [None] * (len(unit) + 1)  # the best score up to each place and the edge that reaches it
        into: list[list[tuple[float, Edge]]] = [[] for _ in best]
        for end, edge in self.edges(unit):
            end += 1
            score = best[end - edge[0]] + edge[1]
            into[end].append((score, edge))
            if score > best[end] or score == best[end] and edge[3] < lead[end][3]:  # of several the smallest ids
                best[end], lead[end] = score, edge
        paths: list[list[Edge]] = []  # whole paths from the end
        losses: list[float] = []
        queue: list[tuple] = [(0.0, None, 0, None, len(unit))]  # (loss, path it leaves, number of its edges kept, edge taken then, where that starts), best first
        while queue and len(paths) < self.n_best:
            loss, base, kept, edge, at = queue.pop(0)
            path, number, room = paths[base][:kept] + [edge] if edge else [], len(paths), self.n_best - len(paths) - 1
            paths.append(path)
            losses.append(loss)
            del queue[room:]
            while at:
                taken = lead[at]
                for score, way in into[at] if room else ():
                    if way is not taken:
                        enter(queue, (loss + (best[at] - score), number, len(path), way, at - way[0]), paths, room)
                path.append(taken)
                at -= taken[0]
        return [(loss, [i for e in path for i in e[3]], b"".join([e[2] for e in reversed(path)])) for loss, path in zip(losses, paths)]

    def segment(self, text: str | None) -> tuple[list[bytes], list[float]]:
        """(ids of the N best segmentations as 32-bit numbers, their scores)."""
        if not text:
            return [b""], [0.0]
        known, units = self.known, self.cutter.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(known.newer.get, units))
        if None in found:
            found = [x or known(u) for x, u in zip(found, units)]
        each, least = np.frombuffer(b"".join([x[: HEAD.size] for x in found])).reshape(-1, 2).T.tolist()
        first = [x[HEAD.size :] for x in found]
        best, lists, scores = sum(each), [], []
        for loss, chosen in self.choices(units, least):
            parts = first.copy() if chosen else first
            while chosen:
                at, ids, chosen = chosen
                parts[at] = ids
            lists.append(b"".join(parts))
            scores.append(best - loss)
        return lists, scores

    def choices(self, units: list[str], least: list[float]) -> list[tuple[float, tuple | None]]:
        """The N best texts of units: (loss, choice); a choice is (unit, its ids, choice before it), or None for the best.

        Units with a loss within the bound are gone through from the front, with the N best choices kept; ties go by the
        smaller ids from the end, so first by those of the unit that comes later.
        """
        n, every = self.n_best, np.array(least)
        bound = np.partition(every, n - 2)[n - 2] if 2 <= n <= len(least) + 1 else inf  # the (N - 1)-th least loss
        bound += 1e-9 * max(1.0, bound)
        kept: list[tuple[float, tuple | None]] = [(0.0, None)]
        for at in np.flatnonzero(every <= bound).tolist() if n > 1 else ():
            worst = kept[-1][0] if len(kept) == n else inf
            if least[at] > worst:
                continue
            ends = self.ranked(units[at])
            if len(kept) == n and (len(ends) == 1 or ends[1][:2] > (worst, ends[0][1])):  # none of its other paths comes before a kept choice
                continue
            ways = [(before + loss, back, r, k) for r, (before, _) in enumerate(kept) for k, (loss, back, _) in enumerate(ends) if loss <= bound]
            kept = [(loss, (at, ends[k][2], kept[r][1]) if k else kept[r][1]) for loss, _, r, k in heapq.nsmallest(n, ways)]
        return kept

    def spell(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids, with the space in front that the model puts there."""
        return joined(lists, self.spelled, b"")

    def digest(self, lists: pa.ListArray) -> list[str]:
        """SHA-256 of the ids of each list, joined by commas."""
        return [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined(lists, self.numbers, ",")]

    def decode(self, ids: tuple[int, ...] | list[int]) -> str:
        return self.spell(pa.array([list(ids)], pa.list_(pa.int32())))[0].as_py().decode("utf-8", "surrogatepass")[1:]

    def segment_all(self, texts: list[str | None]) -> pa.StructArray:
        """(scores, whole, ranked) of each text; whole says whether all of its segmentations decode to it."""
        rows = uncollected(lambda: [self.segment(t) for t in texts])
        every = [x for lists, _ in rows for x in lists]
        starts = lambda sizes: np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
        ids = pa.ListArray.from_arrays(starts([len(x) // 4 for x in every]), pa.array(np.frombuffer(b"".join(every), np.int32)))
        of_text = starts([len(lists) for lists, _ in rows])
        wanted = pa.array([f" {t}".encode("utf-8", "surrogatepass") if t else b"" for t in texts], pa.binary())
        same = pc.equal(self.spell(ids), wanted.take(pa.array(np.repeat(np.arange(len(rows)), np.diff(of_text))))).to_numpy(zero_copy_only=False)
        whole = pa.array(np.logical_and.reduceat(same, of_text[:-1]) if len(rows) else np.zeros(0, bool))
        scores = pa.ListArray.from_arrays(of_text, pa.array(np.array([x for _, each in rows for x in each], np.float64)))
        return pa.StructArray.from_arrays([scores, whole, pa.ListArray.from_arrays(of_text, ids)], ["scores", "whole", "ranked"])


def joined(lists: pa.ListArray, names: pa.Array, separator: str | bytes) -> pa.Array:
    """The names of the ids of each list, joined."""
    at = lists.offsets
    named = names.take(lists.values[at[0].as_py() : at[-1].as_py()])
    return pc.binary_join(pa.ListArray.from_arrays(pc.subtract(at, at[0]), named), separator)


def uncollected(make: Callable[[], list]) -> list:
    """What make gives, made without the collector of cycles, as a search leaves none: it would walk over the whole table again and again."""
    usual = gc.isenabled()
    gc.disable()
    try:
        return make()
    finally:
        if usual:
            gc.enable()


def enter(queue: list[tuple], new: tuple, paths: list[list[Edge]], room: int) -> None:
    """Put a waiting path at its place in the queue, of which the first `room` stay."""
    at = len(queue)
    if at >= room and new[0] > queue[-1][0]:
        return
    while at and (new[0] < queue[at - 1][0] or new[0] == queue[at - 1][0] and ahead(new, queue[at - 1], paths)):
        at -= 1
    if at < room:
        queue.insert(at, new)
        del queue[room:]


def ahead(a: tuple, b: tuple, paths: list[list[Edge]]) -> bool:
    """Whether, of two waiting paths with equal losses, a has the smaller ids from the end.

    Each follows a whole path for some edges and then leaves it, so they are compared where they first differ.
    """
    (_, p, i, left, _), (_, q, j, right, _) = a, b
    at = min(i, j)
    if p != q:
        at = min(at, next((k for k, (x, y) in enumerate(zip(paths[p], paths[q])) if x is not y), at))
    return (left if at == i else paths[p][at])[3] < (right if at == j else paths[q][at])[3]


_lattices: dict[tuple, Lattice] = {}


def lattice(vocabulary: Vocabulary, n_best: int) -> Lattice:
    """One lattice for each vocabulary in a worker, so that its table serves all its tasks."""
    key = (hashlib.sha1("\0".join(vocabulary.pieces).encode()).hexdigest(), n_best)
    if key not in _lattices:
        _lattices[key] = Lattice(vocabulary, n_best)
    return _lattices[key]


def encoded(text: Column | str, vocabulary: Vocabulary, n_best: int = N_BEST) -> Column:
    """A struct (scores, whole, ranked): the scores of the N best segmentations, whether each of these decodes to the text, and
    their ids, the best first."""

    @arrow_udf("scores array<double>, whole boolean, ranked array<array<int>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = lattice(vocabulary, n_best)
        for part in parts(batches):
            yield found.segment_all(part)

    return encode(text)


def digested(text: Column | str, vocabulary: Vocabulary, n_best: int = N_BEST) -> Column:
    """As encoded, with the number and the digest of the ids of each list in place of the ids, which stay in the task:
    a struct (scores, whole, sizes, sha256)."""

    @arrow_udf("scores array<double>, whole boolean, sizes array<int>, sha256 array<string>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = lattice(vocabulary, n_best)
        for part in parts(batches):
            scores, whole, ranked = found.segment_all(part).flatten()
            lists, of_text = ranked.values, ranked.offsets
            digests = pa.ListArray.from_arrays(of_text, pa.array(found.digest(lists), pa.string()))
            yield pa.StructArray.from_arrays([scores, whole, pa.ListArray.from_arrays(of_text, pc.list_value_length(lists)), digests], ["scores", "whole", "sizes", "sha256"])

    return encode(text)


def parts(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """The texts of batches, part by part, so that a worker holds the lists of about CHUNK characters only."""
    for texts in batches:
        lengths = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(texts)]
        for a, b in pairwise(cuts):
            yield texts[a:b].to_pylist()


def decoded(ids: Column | str, vocabulary: Vocabulary) -> Column:
    """The text of an array of ids; null gives null. Bytes that are no UTF-8 become U+FFFD."""

    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = lattice(vocabulary, N_BEST)
        for lists in batches:
            texts = [x.decode("utf-8", "replace")[1:] for x in found.spell(lists.fill_null([])).to_pylist()]
            yield pc.if_else(lists.is_valid(), pa.array(texts, pa.string()), None)

    return decode(ids)


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", digested("text", load_vocabulary(model)).alias("e"))
    return found.select(
        "doc_id", F.get("e.sizes", F.lit(0)).cast("long").alias("n_pieces"), F.get("e.scores", F.lit(0)).alias("best_score"), F.get("e.scores", F.lit(1)).alias("second_score"),
        F.size("e.scores").alias("n_best"), F.get("e.sha256", F.lit(0)).alias("ids_sha256"), F.col("e.whole").alias("round_trip"), F.col("e.sha256").alias("ranked_sha256"),
    )
