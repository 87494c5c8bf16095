"""Packing documents into training sequences, order kept (operator 3) or best fit decreasing (operator 4).

Both encode each text once, in the task that packs it.  Defined results: a null or empty text is one end id; documents
of the same id are packed as separate documents, in the order of their texts where order is kept; a null doc_id stays
null in its pieces, and such documents come first; a document longer than a sequence is cut, and each id lies in exactly
one piece; an empty table gives no rows.  Sequence numbers depend on how the table is dealt to tasks.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.bpe import chunks, default_path, encoder
from quillstone.llm.memory import in_frames, release, small_batches

WINDOW = 2048
END_ID = 1
#: penalties in ids of padding: a cut between sentences, and one inside a sentence, possible at every 16th id
SENTENCE_CUT, FORCED_CUT, FORCED_EVERY = 2, 24, 16
BLOCK_TOKENS = 1 << 20


@lru_cache(2)
def sentence_ends(path: str) -> np.ndarray:
    """Whether a sentence may end after each id."""
    coder = encoder(path)
    raw = coder.piece_bytes.tobytes()
    pieces = [raw[a : a + n] for a, n in zip(coder.piece_at, coder.piece_len)]
    return np.array([p.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n") if p else False for p in pieces])


def window_cuts(candidates: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """Cut positions that minimise padding plus penalties, from candidates[0] to candidates[-1].

    With g(j) = cost(j) + position(j), each transition adds the same padding term, so the best predecessor within a
    window's reach is the minimum of a sliding window: a monotone queue gives it in constant time.
    Neighbouring candidates must be at most a window apart.
    """
    at, pen = candidates.tolist(), penalties.tolist()
    best, back = [0] * len(at), [0] * len(at)
    queue = deque([0])
    for j in range(1, len(at)):
        reach = at[j] - window
        while at[queue[0]] < reach:
            queue.popleft()
        i = queue[0]
        back[j] = i
        g = best[j] = best[i] + window + pen[j]
        while queue and best[queue[-1]] >= g:
            queue.pop()
        queue.append(j)
    cuts, j = [at[-1]], len(at) - 1
    while j:
        j = back[j]
        cuts.append(at[j])
    return cuts[::-1]


def candidates_of(ids: np.ndarray, doc_ends: np.ndarray, can_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, and what each cut costs."""
    kind = np.full(len(ids) + 1, -1)
    kind[::FORCED_EVERY] = FORCED_CUT
    kind[1:][can_end[ids]] = SENTENCE_CUT
    kind[doc_ends] = 0
    kind[0] = kind[-1] = 0
    at = np.flatnonzero(kind >= 0)
    return at, kind[at]


def power_cuts(length: int, window: int = WINDOW) -> list[int]:
    """Lengths for the last window of a stream: powers of two, which are not padded, the largest first."""
    return [length] if length == window else [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def numbers(ids: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Ids, 0 in place of nulls, and which are not null."""
    return ids.fillna(0).to_numpy(np.int64), ids.notna().to_numpy(bool)


class Stream:
    """Packs one partition's documents in order; what the last window of a block holds moves on to the next block."""

    def __init__(self, path: str):
        self.coder, self.can_end = encoder(path), sentence_ends(path)
        self.ids = np.empty(0, np.uint32)
        # of each document that has ids here: its id, where it starts (maybe before), its number of ids, whether it has an id
        self.docs = np.empty((0, 4), np.int64)
        self.sequence = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0

    def add(self, doc_ids: np.ndarray, named: np.ndarray, texts: list[str]) -> Iterator[pd.DataFrame]:
        ids, ends = self.coder.encode(texts)
        n = np.diff(ends)
        full = np.full(len(ids) + len(texts), END_ID, np.uint32)
        full[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), n)] = ids
        starts = np.concatenate([[0], np.cumsum(n + 1)[:-1]]) + len(self.ids)
        self.ids = np.concatenate([self.ids, full])
        self.docs = np.concatenate([self.docs, np.stack([doc_ids, starts, n + 1, named], 1)])
        if len(self.ids) >= BLOCK_TOKENS:
            yield self.close(False)

    def close(self, last: bool = True) -> pd.DataFrame:
        ids, docs = self.ids, self.docs
        if not len(ids):
            return pd.DataFrame([], columns=PIECE)
        ends = docs[:, 1] + docs[:, 2]
        at, cost = candidates_of(ids, ends, self.can_end)
        cuts = window_cuts(at, cost)
        if last:
            tail = power_cuts(cuts[-1] - cuts[-2])
            cuts = [*cuts[:-1], *(cuts[-2] + np.cumsum(tail)).tolist()]
        elif len(cuts) > 2:
            cuts = cuts[:-1]
        stop = cuts[-1]
        edges = np.unique(np.concatenate([cuts, docs[:, 1], ends]))
        edges = edges[(edges >= 0) & (edges <= stop)]
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(docs[:, 1], a, "right") - 1
        window = np.searchsorted(cuts, a, "right") - 1
        out = pd.DataFrame(
            {
                "doc_id": pd.arrays.IntegerArray(docs[doc, 0], docs[doc, 3] == 0),
                "start": a - docs[doc, 1],
                "length": b - a,
                "ids_crc32": [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(a, b)],
                "doc_tokens": docs[doc, 2],
                "sequence_id": self.sequence + window,
                "offset": a - np.array(cuts)[window],
            }
        )
        self.sequence += len(cuts) - 1
        self.ids = ids[stop:]
        docs = docs[ends > stop].copy()
        docs[:, 1] -= stop
        self.docs = docs
        return out


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECE_SCHEMA = ", ".join(f"{c} long" for c in PIECE)


def pack_in_order(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids, documents in the order of doc_id.

    Documents are dealt by ranges of doc_id and the text's hash (so the rows of one id, or of none, are not one range), and
    each range is a stream of its own: no task sees more than its range, and within it a block of about a million ids is held at a time.  The last window of a stream is cut into powers of
    two, which take no padding.
    """
    small_batches(docs.sparkSession)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = Stream(path or default_path())
        for frame in frames:
            for part in chunks(frame):
                yield from stream.add(*numbers(part["doc_id"]), [t or "" for t in part["text"]])
        yield stream.close()
        release()

    return in_frames(docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text"), work, PIECE_SCHEMA)


class CapacityTree:
    """Segment tree over the free capacities 0..size: finds the smallest that is at least a length and has a bin."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, capacity: int, which: int) -> None:
        self.bins[capacity].append(which)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A bin with the least capacity of at least ``least``, removed from the tree."""
        count, node = self.count, least + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        which = self.bins[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, which


def best_fit_decreasing(lengths: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces are taken from the longest to the shortest, ties in their order."""
    tree = CapacityTree(size)
    where, offset, bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        capacity, which = tree.take(n) or (size, -1)
        if which < 0:
            which, bins = bins, bins + 1
        where[k], offset[k] = which, size - capacity
        if capacity > n:
            tree.put(capacity - n, which)
    return where, offset


MATRIX_SCHEMA = "sequence_id long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


def pack_best_fit(docs: DataFrame, path: str | None = None, block_tokens: int = 4 * BLOCK_TOKENS) -> DataFrame:
    """One row per packed sequence of 2048 ids.

    ids and position_ids are rows of matrices: 2048 little-endian unsigned 16-bit numbers (ids are padded with the end
    id; a position starts anew at each segment and is 0 in padding).  cu_seqlens are the cumulative segment lengths
    from 0; doc_ids and starts name each segment's document and its place there.  Documents of over 2048 ids are split
    into full segments and a rest, so nothing is lost.  Texts are packed where they are read, in blocks: no shuffle.
    """
    small_batches(docs.sparkSession)

    def block(doc: np.ndarray, named: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray, at: np.ndarray, first: int) -> pd.DataFrame:
        where, offset = best_fit_decreasing(length)
        order = np.lexsort((offset, where))
        bins = int(where.max()) + 1
        matrix, positions = np.full((bins, WINDOW), END_ID, "<u2"), np.zeros((bins, WINDOW), "<u2")
        rows = {"sequence_id": first + np.arange(bins), "n_tokens": np.bincount(where, length, bins).astype(int)}
        edges, names, starts = [], [], []
        for group in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
            row = where[group[0]]
            for k in group.tolist():
                n = length[k]
                matrix[row, offset[k] : offset[k] + n] = ids[at[k] : at[k] + n]
                positions[row, offset[k] : offset[k] + n] = np.arange(n)
            edges.append(np.concatenate([[0], np.cumsum(length[group])]).astype(np.int32))
            names.append(doc[group] if named[group].all() else [d if there else None for d, there in zip(doc[group].tolist(), named[group].tolist())])
            starts.append(start[group])
        return pd.DataFrame(rows | {"ids": [r.tobytes() for r in matrix], "position_ids": [r.tobytes() for r in positions], "cu_seqlens": edges, "doc_ids": names, "starts": starts})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path or default_path())
        first = TaskContext.get().partitionId() << 40
        held: list = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal first, held, size
            columns = [np.concatenate(x) for x in zip(*held)]
            out = block(*columns, first)
            first, held, size = first + len(out), [], 0
            return out

        for frame in frames:
            for part in chunks(frame):
                ids, ends = coder.encode([t or "" for t in part["text"]])
                n = np.diff(ends) + 1
                full = np.full(len(ids) + len(n), END_ID, np.uint16)
                full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
                pieces = -(-n // WINDOW)
                which = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WINDOW
                length = np.minimum(n[which] - start, WINDOW)
                at = (np.cumsum(n) - n)[which] + start + size
                doc, named = numbers(part["doc_id"])
                held.append((doc[which], named[which], start, length, full, at))
                size += len(full)
                if size >= block_tokens:
                    yield flush()
        if held:
            yield flush()
        release()

    return in_frames(docs.select("doc_id", "text"), work, MATRIX_SCHEMA)
