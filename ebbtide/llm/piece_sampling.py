"""Sampled SentencePiece segmentations: forward filtering, backward sampling; and lossless decoding.

The lattice of a text has an arc for every piece of the vocabulary that its characters spell, and the
byte pieces of a character that is no piece. The model file holds ranks of merges and no probabilities,
so a piece weighs ``1 / (rank + OFFSET) ** theta``. The forward pass sums the weights of all paths to
each position; the backward pass draws arcs by their share of it, so a segmentation comes with the
probability that its weights give it. Random numbers are seeded by the row's key: the same key, text
and seed give the same pieces anywhere.

No piece reaches across the place before a run of spaces, or across a line feed, so the lattice falls
apart there. The forward pass runs over the distinct parts of a batch of texts at once, position by
position, and the backward pass over all their occurrences, arc by arc. Parts longer than ``LONG`` are
sampled one by one, with sums kept within range. Each arc has a random number of its own, which follows
from the row's seed, the part's and the arc's number; what else is in the batch does not matter.

As in the library, a text gets a space in front and spaces are the piece character; a literal piece
character is written in bytes, so that decoding gives back every text. Null or empty text has no
pieces. A null key is seeded by its text alone; rows repeat their pieces where key and text repeat.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ebbtide.llm.shared import kept, over_batches, whole_text

SPACE, OFFSET, LONG = "▁", 10.0, 64
PARTS = re.compile(r" *[^ \n]+| +|\n")


def numbered(seeds: np.ndarray, number: int) -> np.ndarray:
    """The random number of that number, from 0 to 1, of each of the 64-bit seeds (splitmix64)."""
    x = seeds * np.uint64(0xD1342543DE82EF95) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


class PieceSampler:
    def __init__(self, path: str, theta: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[float, bytes]] = {}
        self.starts: set[str] = set()
        self.bytes_of: dict[int, bytes] = {}
        self.byte_ids = [b""] * 256
        first = 0
        for i in range(model.get_piece_size()):
            pack = np.uint32(i).astype("<u4").tobytes()
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = pack
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                first = first or i
                text = piece.replace(SPACE, " ")
                self.pieces[text] = ((i - first + OFFSET) ** -theta, pack)
                self.starts.update(text[:k] for k in range(1, len(text) + 1))
                self.bytes_of[i] = text.encode()
        self.fallback = (model.get_piece_size() + OFFSET) ** -theta
        self.size = model.get_piece_size()
        # the pieces as a trie: (node, character) to node, sorted; the piece that ends at a node
        node = {"": 0} | {text: i for i, text in enumerate(sorted(self.starts), 1)}
        edges = sorted((node[t[:-1]] << 21 | ord(t[-1]), i) for t, i in node.items() if t)
        self.edge, self.child = (np.array(c, np.int64) for c in zip(*edges))
        self.piece_at = np.full(len(node), -1, np.int64)
        self.weight_at = np.zeros(len(node))
        # a factor per character, which cancels out in every share, keeps the sums near one
        for text, (weight, pack) in self.pieces.items():
            self.piece_at[node[text]] = int.from_bytes(pack, "little")
            self.weight_at[node[text]] = weight * 30.0 ** len(text)

    def forward(self, part: str) -> list:
        """For each position: cumulative shares, origins and ids of the arcs that end there."""
        size, pieces, starts = len(part), self.pieces, self.starts
        sums, ends = [0.0] * (size + 1), [[] for _ in range(size + 1)]
        sums[0] = 1.0
        result = [None] * (size + 1)
        for at in range(size):
            if at:
                arcs = ends[at]
                total = sum(a[0] for a in arcs)
                share, cumulative = 0.0, []
                for weight, _, _ in arcs:
                    share += weight / total
                    cumulative.append(share)
                result[at] = (cumulative, [a[1] for a in arcs], [a[2] for a in arcs])
                # only ratios count: a factor per position keeps long parts within range
                sums[at] = total if 1e-100 < total < 1e100 else None
                if sums[at] is None:
                    scale = 1.0 / total
                    sums[at] = 1.0
                    for later in range(at + 1, min(size, at + 16) + 1):
                        ends[later] = [(w * scale, o, i) for w, o, i in ends[later]]
            here, single = sums[at], part[at]
            found = pieces.get(single)
            if found is None:
                ids = b"".join(self.byte_ids[b] for b in single.encode())
                ends[at + 1].append((here * self.fallback, at, ids))
            else:
                ends[at + 1].append((here * found[0], at, found[1]))
            stop = at + 2
            while stop <= size and (text := part[at:stop]) in starts:
                found = pieces.get(text)
                if found:
                    ends[stop].append((here * found[0], at, found[1]))
                stop += 1
        arcs = ends[size]
        total = sum(a[0] for a in arcs)
        share, cumulative = 0.0, []
        for weight, _, _ in arcs:
            share += weight / total
            cumulative.append(share)
        result[size] = (cumulative, [a[1] for a in arcs], [a[2] for a in arcs])
        return result

    def draw_long(self, part: str, u: float) -> np.ndarray:
        """One sampled segmentation of a part of any length."""
        arcs, more = self.forward(part), Random(u).random
        at, out = len(arcs) - 1, []
        while at:
            cumulative, origins, ids = arcs[at]
            k = min(bisect(cumulative, more()), len(origins) - 1)
            out.append(ids[k])
            at = origins[k]
        return np.frombuffer(b"".join(reversed(out)), "<u4").astype(np.int64)

    def arcs_of(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """Origin, end, weight and id of every arc of the parts' lattices, ids from ``size`` on for
        characters that are no piece; and for every place its position within its part.

        A part of n characters has n + 1 places.
        """
        lengths = np.array([len(p) for p in parts], np.int64)
        letters = np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
        firsts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        position = np.arange(len(letters)) - np.repeat(firsts, lengths + 1)
        left = np.repeat(lengths, lengths + 1) - position  # characters to the end of the part
        at = np.flatnonzero(left > 0)
        origins, ends, weights, ids = [], [], [], []
        node, start, step = np.zeros(len(at), np.int64), at, 0
        while len(start):
            key = node << 21 | letters[start + step]
            place = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            there = self.edge[place] == key
            step += 1
            if step == 1:
                piece = np.where(there, self.piece_at[self.child[place]], -1)
                none = start[piece < 0]
                origins.append(none)
                ends.append(none + 1)
                weights.append(np.full(len(none), self.fallback * 30.0))
                ids.append(self.size + letters[none])
            node, start = self.child[place[there]], start[there]
            found = self.piece_at[node] >= 0
            origins.append(start[found])
            ends.append(start[found] + step)
            weights.append(self.weight_at[node[found]])
            ids.append(self.piece_at[node[found]])
            on = left[start] > step
            node, start = node[on], start[on]
        return (*(np.concatenate(x) for x in (origins, ends, weights, ids)), position, firsts)

    def draw(self, parts: list[str], of: np.ndarray, uniforms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one segmentation per occurrence ``of`` a part, put together, and how many each has."""
        if not len(of):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        origin, end, weight, ids, position, firsts = self.arcs_of(parts)
        lengths = np.array([len(p) for p in parts], np.int64)
        # forward: the sum of all paths to a place, for all places at the same position at once
        order = np.lexsort((end, position[end]))
        origin, end, weight, ids = origin[order], end[order], weight[order], ids[order]
        new = np.flatnonzero(np.diff(end, prepend=-1))
        total, path = np.zeros(len(position)), np.empty(len(end))
        total[firsts] = 1.0
        bounds = np.searchsorted(position[end], np.arange(1, int(lengths.max(initial=0)) + 2))
        for low, high in zip(bounds, bounds[1:]):
            path[low:high] = total[origin[low:high]] * weight[low:high]
            groups = new[np.searchsorted(new, low):np.searchsorted(new, high)]
            total[end[groups]] = np.add.reduceat(path[low:high], groups - low)
        # shares of the arcs into a place, cumulated within the place alone: other parts have no influence
        within = path / total[end]
        last = np.append(new[1:], len(end)) - 1
        for step in range(1, int((last - new).max(initial=0)) + 1):
            arc = new[new + step <= last] + step
            within[arc] += within[arc - 1]
        group_of = np.zeros(len(position), np.int64)
        group_of[end[new]] = np.arange(len(new))
        # backward: all occurrences take an arc at a time
        here, seeds = firsts[of] + lengths[of], (uniforms * 2.0**53).astype(np.uint64)
        active, taken, who = np.flatnonzero(lengths[of] > 0), [], []
        while len(active):
            g = group_of[here[active]]
            u, arc, end_of = numbered(seeds[active], len(taken)), new[g], last[g]
            on = np.flatnonzero((arc < end_of) & (within[arc] <= u))
            while len(on):
                arc[on] += 1
                on = on[(arc[on] < end_of[on]) & (within[arc[on]] <= u[on])]
            taken.append(ids[arc])
            who.append(active)
            here[active] = origin[arc]
            active = active[position[origin[arc]] > 0]
        taken, who = np.concatenate(taken[::-1]), np.concatenate(who[::-1])
        return taken[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(of))

    def spelled(self, ids: np.ndarray) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, characters that are no piece in byte pieces."""
        if not (ids >= self.size).any():
            return ids.astype("<u4").tobytes()
        out, at = [], 0
        for i in np.flatnonzero(ids >= self.size).tolist():
            out.append(ids[at:i].astype("<u4").tobytes())
            out += [self.byte_ids[b] for b in chr(int(ids[i]) - self.size).encode()]
            at = i + 1
        return b"".join([*out, ids[at:].astype("<u4").tobytes()])

    def encode(self, texts: list[str], seeds: list[int]) -> list[bytes]:
        """The ids of one sampled segmentation of each text."""
        split = [PARTS.findall(" " + t) if t else [] for t in texts]
        number: dict[str, int] = {}
        of = np.array([number.setdefault(p, len(number)) for parts in split for p in parts], np.int64)
        uniforms = np.concatenate([np.empty(0), *(np.random.Generator(np.random.Philox(s)).random(len(p)) for s, p in zip(seeds, split))])
        parts = list(number)
        size = np.array([len(p) for p in parts], np.int64)
        short = np.flatnonzero(size <= LONG)
        renumber = np.full(len(parts), -1)
        renumber[short] = np.arange(len(short))
        brief = size[of] <= LONG if len(of) else np.zeros(0, bool)
        ids, counts = self.draw([parts[i] for i in short], renumber[of[brief]], uniforms[brief])
        if not brief.all():
            pieces, at, each = [], np.concatenate([[0], np.cumsum(counts)]), np.cumsum(brief) - 1
            for i, is_short in enumerate(brief.tolist()):
                pieces.append(ids[at[each[i]]:at[each[i] + 1]] if is_short else self.draw_long(parts[of[i]], float(uniforms[i])))
            ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)[np.cumsum([0, *map(len, split)])]
        return [self.spelled(ids[a:b]) for a, b in zip(ends, ends[1:])]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()[1:]


def sampler(path: str, theta: float) -> PieceSampler:
    """One per worker, kept between tasks."""
    return kept((path, theta), lambda: PieceSampler(path, theta))


def row_seed(key: int | str | None, text: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(text if key is None else str(key), seed=seed)


def encoded(docs: DataFrame, model: str, key: str = "doc_id", theta: float = 1.0, seed: int = 0) -> DataFrame:
    """The key, the text and ids (binary) of a sampled segmentation of every text."""
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        use = sampler(model, theta)
        texts = batch.column(1).to_pylist()
        ids = use.encode(texts, [row_seed(k, t, seed) for k, t in zip(batch.column(0).to_pylist(), texts)])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=["key", "text", "ids"])
    narrow = docs.select(F.col(key).cast("long").alias("key"), whole_text().alias("text"))
    return over_batches(narrow, encode, "key long, text string, ids binary")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """All columns and ``decoded``: the text that the ids spell."""
    names = rows.columns

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        use = sampler(model, 1.0)
        texts = [use.decode(x.as_py()) if len(x.as_py()) else "" for x in batch.column(names.index("ids"))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])
    return over_batches(rows, decode, StructType([*rows.schema.fields, StructField("decoded", StringType())]))
