"""Substring dedup by bucket-pointer refinement (operator 7).

Each byte covered by a 50-byte string that also starts in a document with a smaller id is removed.  As in suffix sorting
by bucket-pointer refinement, positions are put in buckets by their q-gram (17 bytes), buckets are refined by sorting on
the bucket identifiers of later offsets, the refined identifiers are written back and are keys of the next sort, and only
buckets that are still undecided go on.

1. A 50-byte string is sorted by its anchor, the leftmost of its 34 q-grams with the least hash: equal strings have it at
   the same offset.  Neighbouring strings with one anchor are a cell: some 17 strings, one entry.  Cells with one q-gram at
   their anchors are an initial bucket.
2. A bucket is sorted on the q-grams at offsets q after the anchor and, apart, q before it; ranks in these orders are the
   refined identifiers.  Each string holds one of the two q-grams whole.  The refined identifiers and the q-grams of the
   cell's first and last 17 bytes, with their offsets from the anchor, are the keys of one more sort; together they hold
   every byte of a cell.  A cell that a smaller document has too is decided.  Of the others, only cells of several
   documents in one refined bucket stay undecided, on that side, and get its identifier back.
3. A string of an undecided cell is sorted on that identifier, which stands for 34 of its bytes, on where in the string
   they lie, and on the q-grams at its own offsets 0 and 33, which hold the other 16.

Entries move as arrays: a block of documents sends one array to each part of the buckets, holding each of its cells once
with its smallest document, and gets back one state for each entry, in the order sent.  So a passage that a third of all
documents share costs one entry a block.  Blocks and parts are so many that each covers a stated number of bytes of text;
long texts are cut into overlapping pieces inside their block, of which no more than the bytes and the cells are held.

Equality rests on hashes of q-grams, not on bytes.  Two cells of one bucket are told apart by 64 bits of the names of all
their q-grams, besides 16 for each q-gram beside the anchor; strings by 120 bits.  So n different surroundings of one
q-gram have a chance of some n^2 / 2^65 to hold a false match: 10^-7 for a million, 0.03 for a billion, one such in a
corpus.

Defined results: a null text is empty and a text of under 50 bytes is kept; rows with the same doc_id don't remove each
other's bytes; a row whose doc_id is null is kept as it is; columns to carry go through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.memory import release, small_batches

LENGTH, Q = 50, 17
SPAN = LENGTH - Q + 1
#: bytes of text that are analysed at a time, in a block, for each part of the buckets, and for each task
SEGMENT, BLOCK_BYTES, PART_BYTES, TASK_BYTES = 1 << 20, 4 << 20, 24 << 20, 128 << 20
R = 0x9E3779B97F4A7C15 | 1
POSITION = np.uint64((1 << 24) - 1)
#: bytes of a bucket's name that are sent (its part holds more of it), and names of q-grams beside anchors
BUCKET_BYTES, BESIDE = 5, 65535
#: states of entries
COVERED, LEFT, RIGHT = 1, 2, 4


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One hash of two."""
    return mixed(mixed(x) * np.uint64(R) + y)


class Cells:
    """Cells of some pieces of texts: first and last string, anchor, bucket, q-grams beside it, identifier, piece."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = raw = b"".join(pieces)
        n = len(raw)
        if not (self.sizes >= LENGTH).any():
            self.first = self.last = self.anchor = self.piece = np.empty(0, np.int64)
            self.bucket = self.outer = np.empty(0, np.uint64)
            self.left = self.right = np.empty(0, np.uint16)
            return
        eight = np.ndarray((n - 7,), "<u8", raw, strides=(1,)).astype(np.uint64)
        m = n - Q + 1
        grams = joined(joined(eight[:m], eight[8 : 8 + m]), np.frombuffer(raw, np.uint8)[Q - 1 :].astype(np.uint64))
        # a hash above its position: the least is the leftmost of the least
        least = (grams & ~POSITION) | np.arange(m, dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, SPAN - 32):
            least = np.minimum(least[:-step], least[step:])
        least = (least & POSITION).astype(np.int64)
        mark = np.zeros(len(least) + 2, np.int8)
        ok = self.sizes >= LENGTH
        np.add.at(mark, self.starts[ok], 1)
        np.add.at(mark, self.starts[ok] + self.sizes[ok] - LENGTH + 1, -1)
        valid = np.cumsum(mark)[: len(least)].astype(bool)
        change = np.ones(len(least) + 1, bool)
        change[1:-1] = (least[1:] != least[:-1]) | ~(valid[1:] & valid[:-1])
        self.first = first = np.flatnonzero(valid & change[:-1])
        self.last = last = np.flatnonzero(valid & change[1:])
        self.anchor = anchor = least[first]
        self.bucket = mixed(grams[anchor])
        # strings from Q bytes before the anchor on hold the q-gram before it, the others the one after it; 0 is none
        beside = lambda there, at: np.where(there, grams[np.clip(at, 0, m - 1)], 0)
        left, right = beside(first <= anchor - Q, anchor - Q), beside(last > anchor - Q, anchor + Q)
        brief = lambda x: np.where(x > 0, x % np.uint64(BESIDE) + np.uint64(1), 0).astype(np.uint16)
        self.left, self.right = brief(left), brief(right)
        # the q-grams that hold all bytes of a cell, with the places of the outer ones
        places = ((anchor - first) * 64 + (anchor - last)).astype(np.uint64)
        self.outer = joined(joined(joined(grams[first], grams[last + SPAN - 1]), joined(left, right)), joined(self.bucket, places))
        self.piece = np.searchsorted(self.starts, first, "right") - 1

    def grams(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the q-grams at some places."""
        eight = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))
        return joined(joined(eight[at].astype(np.uint64), eight[at + 8].astype(np.uint64)), np.frombuffer(self.raw, np.uint8)[at + Q - 1].astype(np.uint64))


def portions(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, places and pieces of texts, some ``SEGMENT`` bytes at a time; pieces of a long text share 49 bytes."""
    rows, places, pieces, size = [], [], [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
            piece = text[a : a + SEGMENT + LENGTH - 1]
            rows.append(k)
            places.append(a)
            pieces.append(piece)
            size += len(piece)
            if size >= SEGMENT:
                yield rows, places, pieces
                rows, places, pieces, size = [], [], [], 0
    if rows:
        yield rows, places, pieces


class Sorted:
    """Distinct entries of two keys with the smallest document of each, in the order in which they are sent."""

    def __init__(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, parts: int):
        order = np.lexsort([ids, two, one])
        new = np.ones(len(order), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        self.head = order[new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.least = ids[self.head]
        self.part = ((one[self.head] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        # by part, then by document, whose numbers then pack well; content alone decides the order
        self.sent = np.lexsort([two[self.head], one[self.head], self.least, self.part])
        self.edges = np.searchsorted(self.part[self.sent], np.arange(parts + 1))

    def messages(self, block: int, columns: dict[str, np.ndarray]) -> pd.DataFrame:
        """One row for each part that has entries; columns have a row of bytes for each item (not entry)."""
        rows = []
        for p in np.flatnonzero(np.diff(self.edges)).tolist():
            at = self.sent[self.edges[p] : self.edges[p + 1]]
            table, doc = np.unique(self.least[at], return_inverse=True)
            wide = "<u2" if len(table) <= 1 << 16 else "<u4"
            rows.append((p, block, table.astype("<i8").tobytes(), doc.astype(wide).tobytes(), *(np.ascontiguousarray(c[self.head[at]]).tobytes() for c in columns.values())))
        return pd.DataFrame(rows, columns=["part", "block", "ids", "doc", *columns])

    def states(self, answers: pd.DataFrame) -> np.ndarray:
        """The state of each entry: answers have one row a part, in the order sent."""
        out = np.zeros(len(self.head), np.uint8)
        if len(answers):
            out[self.sent] = np.frombuffer(b"".join(answers["state"]), np.uint8)
        return out

    def pointers(self, state: np.ndarray, side: int, answers: pd.DataFrame) -> np.ndarray:
        """Identifiers of refined buckets that came back for entries undecided on a side: part, side and rank."""
        out = np.zeros(len(self.head), np.uint64)
        at = self.sent[state[self.sent] & side > 0]
        if len(at):
            rank = np.frombuffer(b"".join(answers["left" if side == LEFT else "right"]), "<u4").astype(np.uint64)
            out[at] = (self.part[at].astype(np.uint64) << np.uint64(33)) | (np.uint64(side == RIGHT) << np.uint64(32)) | rank
        return out


def low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    """The n lower bytes of each number, as rows."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n]


def numbers(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel().astype(np.uint64)


CELLS = "part int, block long, ids binary, doc binary, bucket binary, beside binary, outer binary"
STRINGS = "part int, block long, ids binary, doc binary, one binary, two binary"
REPLY = "block long, part int, level int, state binary, left binary, right binary"


class Block:
    """The cells of a block's texts, and what other blocks have said of them."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], parts: int):
        self.parts = parts
        self.portions = [(np.array(rows), places, Cells(pieces)) for rows, places, pieces in portions(texts)]
        every = lambda name: np.concatenate([getattr(c, name) for _, _, c in self.portions])
        self.first, self.last, self.anchor, self.left, self.right = map(every, ("first", "last", "anchor", "left", "right"))
        self.bucket, self.outer = every("bucket"), every("outer")
        self.ids = np.concatenate([ids[rows[c.piece]] for rows, _, c in self.portions])
        self.ends = np.cumsum([len(c.first) for _, _, c in self.portions])
        self.cells = Sorted(self.bucket, self.outer, self.ids, parts)

    def send_cells(self, block: int) -> pd.DataFrame:
        beside = np.stack([self.left, self.right], 1).astype("<u2")
        return self.cells.messages(block, {"bucket": low_bytes(self.bucket, BUCKET_BYTES), "beside": beside, "outer": low_bytes(self.outer, 8)})

    def hear(self, answers: pd.DataFrame) -> Block:
        """Sorts the strings of undecided cells; of a cell only those of its smallest document here."""
        answers = answers[answers["level"] == 1].sort_values("part")
        state = self.cells.states(answers)
        pointer = {side: self.cells.pointers(state, side, answers) for side in (LEFT, RIGHT)}
        own = self.ids == self.cells.least[self.cells.of]
        state = np.where(own, state[self.cells.of], COVERED)
        self.gone = state & COVERED > 0
        cell, at, name = [], [], []
        for side, low, high in ((LEFT, self.first, np.minimum(self.last, self.anchor - Q)), (RIGHT, np.maximum(self.first, self.anchor - Q + 1), self.last)):
            some = np.flatnonzero(~self.gone & (state & side > 0))
            count = np.maximum(0, high[some] - low[some] + 1)
            ends = np.cumsum(count)
            at.append(np.repeat(low[some] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0))
            cell.append(np.repeat(some, count))
            name.append(np.repeat(pointer[side][self.cells.of[some]], count))
        self.at, self.cell, name = map(np.concatenate, (at, cell, name))
        place = self.anchor[self.cell] - self.at
        beside = self.anchor[self.cell] + np.where(place >= Q, -Q, Q)
        head, tail, middle = (np.empty(len(self.at), np.uint64) for _ in range(3))
        portion = np.searchsorted(self.ends, self.cell, "right")
        for k in np.unique(portion):
            here, grams = portion == k, self.portions[k][2].grams
            head[here], tail[here], middle[here] = grams(self.at[here]), grams(self.at[here] + SPAN - 1), grams(beside[here])
        # where the 34 bytes lie is a key too: else the same parts in another order would be equal
        middle, place = joined(joined(middle, self.bucket[self.cell]), place.astype(np.uint64)), place.astype(np.uint64)
        self.one, self.two = joined(joined(name, joined(head, tail)), middle), joined(joined(tail ^ np.uint64(R), head), joined(middle ^ np.uint64(R), place))
        self.strings = Sorted(self.one, self.two, self.ids[self.cell], self.parts)
        return self

    def send_strings(self, block: int) -> pd.DataFrame:
        return self.strings.messages(block, {"one": low_bytes(self.one, 8), "two": low_bytes(self.two, 7)})

    def removed(self, answers: pd.DataFrame, texts: list[bytes]) -> list[np.ndarray]:
        """Which bytes of each text go."""
        state = self.strings.states(answers[answers["level"] == 2].sort_values("part"))
        hit = (state[self.strings.of] == COVERED) | (self.strings.least[self.strings.of] < self.ids[self.cell])
        first = np.concatenate([self.first[self.gone], self.at[hit]])
        stop = np.concatenate([self.last[self.gone], self.at[hit]]) + LENGTH
        portion = np.searchsorted(self.ends, np.concatenate([np.flatnonzero(self.gone), self.cell[hit]]), "right")
        out = [np.zeros(len(t), bool) for t in texts]
        for k, (rows, places, cells) in enumerate(self.portions):
            here = portion == k
            if here.any():
                mark = np.zeros(int(cells.sizes.sum()) + 1, np.int32)
                np.add.at(mark, first[here], 1)
                np.add.at(mark, stop[here], -1)
                gone = np.cumsum(mark) > 0
                for row, place, a, n in zip(rows.tolist(), places, cells.starts.tolist(), cells.sizes.tolist()):
                    out[row][place : place + n] |= gone[a : a + n]
        return out


def received(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Message number and document of each entry of a part's messages."""
    number, ids = [], []
    for k, (table, doc) in enumerate(zip(frame["ids"], frame["doc"])):
        table = np.frombuffer(table, "<i8")
        doc = np.frombuffer(doc, "<u2" if len(table) <= 1 << 16 else "<u4")
        number.append(np.full(len(doc), k))
        ids.append(table[doc])
    return np.concatenate(number), np.concatenate(ids)


def several(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each key (a rank) has several ids."""
    n = int(keys.max()) + 1 if len(keys) else 0
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, keys, ids)
    np.maximum.at(high, keys, ids)
    return (low < high)[keys]


def replies(frame: pd.DataFrame, level: int, number: np.ndarray, state: np.ndarray, ranks: dict[int, np.ndarray]) -> pd.DataFrame:
    """For each message, the states of its entries in its order, and the ranks of those that are undecided on a side."""
    edges = np.searchsorted(number, np.arange(len(frame) + 1))
    rows = []
    for k, block in enumerate(frame["block"].tolist()):
        here = slice(edges[k], edges[k + 1])
        back = [r[here][state[here] & side > 0].astype("<u4").tobytes() for side, r in ranks.items()] or [b"", b""]
        rows.append((block, int(frame["part"].iloc[0]), level, state[here].tobytes(), *back))
    return pd.DataFrame(rows, columns=["block", "part", "level", "state", "left", "right"])


def decide_cells(frame: pd.DataFrame) -> pd.DataFrame:
    """Refines the buckets of a part once on either side of the anchor, and then by the q-grams at the cells' ends."""
    number, ids = received(frame)
    beside = np.frombuffer(b"".join(frame["beside"]), "<u2").reshape(-1, 2).astype(np.int64)
    _, bucket = np.unique(numbers(b"".join(frame["bucket"]), BUCKET_BYTES), return_inverse=True)
    ranks = {side: np.unique(bucket << 16 | beside[:, k], return_inverse=True)[1] for k, side in enumerate((LEFT, RIGHT))}
    whole, outer = ranks[LEFT] << 32 | ranks[RIGHT], numbers(b"".join(frame["outer"]), 8)
    order = np.lexsort([ids, outer, whole])
    new = np.ones(len(order), bool)
    new[1:] = (whole[order[1:]] != whole[order[:-1]]) | (outer[order[1:]] != outer[order[:-1]])
    head = order[new]
    state = np.zeros(len(order), np.uint8)
    state[order[ids[head][np.cumsum(new) - 1] < ids[order]]] = COVERED
    for k, side in enumerate((LEFT, RIGHT)):
        some = head[beside[head, k] > 0]
        state[some[several(ranks[side][some], ids[some])]] |= side
    out = replies(frame, 1, number, state, ranks)
    release()
    return out


def decide_strings(frame: pd.DataFrame) -> pd.DataFrame:
    number, ids = received(frame)
    one, two = numbers(b"".join(frame["one"]), 8), numbers(b"".join(frame["two"]), 7)
    order = np.lexsort([ids, two, one])
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    state = np.zeros(len(order), np.uint8)
    state[order[ids[order[new]][np.cumsum(new) - 1] < ids[order]]] = COVERED
    out = replies(frame, 2, number, state, {})
    release()
    return out


RESULT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}


def dedup_substrings(docs: DataFrame, parts: int | None = None, carry: tuple[str, ...] = ("doc_id",), prefix: str = "", as_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: the columns to carry, n_bytes, n_removed, n_spans and the kept bytes, these under a prefix.

    With ``as_text`` the kept bytes are a string, without what is left of characters that are cut.

    The texts are shuffled once, by blocks, and read three times; entries are a fraction of the texts' size, and their
    messages are at most blocks times parts rows, and never more than entries.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = list(carry)
    carried = [f"c{k}" for k in range(len(names))]
    # own names, so that no column of docs can clash
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *(F.col(f"`{c}`").alias(k) for c, k in zip(names, carried)))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(least, -(-total // PART_BYTES))
    blocks, tasks = max(2 * least, -(-total // block_bytes)), max(least, -(-total // TASK_BYTES))
    whole = F.coalesce(F.col("text"), F.lit(""))
    zero = F.lit(0).cast("long")
    unnamed = rows.where(F.col("doc_id").isNull()).select(*carried, F.octet_length(whole).cast("long"), zero, zero, whole if as_text else whole.cast("binary"))
    texts = rows.where(F.col("doc_id").isNotNull()).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).repartition(tasks, "block")
    schema = rows.select(*carried).schema
    for c, kind in RESULT.items():
        schema = schema.add(c, "string" if as_text and c == "kept" else kind)

    def encoded(texts: pd.Series) -> list[bytes]:
        return [(t or "").encode() for t in texts]

    # a block is given up before its memory is released
    def send_cells(frame: pd.DataFrame) -> pd.DataFrame:
        out = Block(frame["doc_id"].to_numpy(np.int64), encoded(frame["text"]), parts).send_cells(int(frame["block"].iloc[0]))
        release()
        return out

    def send_strings(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(answers) or not any(map(len, [*answers["left"], *answers["right"]])):
            return pd.DataFrame([], columns=["part", "block", "ids", "doc", "one", "two"])
        out = Block(frame["doc_id"].to_numpy(np.int64), encoded(frame["text"]), parts).hear(answers).send_strings(int(frame["block"].iloc[0]))
        release()
        return out

    def kept_of(raw: list[bytes], removed: list[np.ndarray]) -> list[tuple]:
        done = []
        for text, gone in zip(raw, removed):
            n = int(gone.sum())
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if n else 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if n else text
            done.append((len(text), n, spans, kept.decode("utf-8", "ignore") if as_text else kept))
        return done

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        raw, heard = [(t.as_py() or "").encode() for t in table.column("text")], answers.to_pandas()
        done = kept_of(raw, Block(table.column("doc_id").to_numpy(), raw, parts).hear(heard).removed(heard, raw)) if raw else []
        columns = [pa.array(c, k) for c, k in zip(zip(*done) if done else ((),) * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()))]
        release()
        return pa.table([*(table.column(c) for c in carried), *columns], names=[*carried, *RESULT])

    cells = texts.groupBy("block").applyInPandas(send_cells, CELLS)
    first = cells.repartition(tasks, "part").groupBy("part").applyInPandas(decide_cells, REPLY)
    strings = texts.groupBy("block").cogroup(first.groupBy("block")).applyInPandas(send_strings, STRINGS)
    second = strings.repartition(tasks, "part").groupBy("part").applyInPandas(decide_strings, REPLY)
    answers = first.unionByName(second)
    out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, schema)
    return out.union(unnamed).toDF(*names, *(prefix + c for c in RESULT))
