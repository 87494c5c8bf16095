"""Byte-level BPE encoding and decoding (operator 5).

Pre-tokenisation works on whole batches of texts as code-point arrays, each distinct word is encoded once by the
contiguous rank array: a row holds the parts of a short word and the ranks of adjacent parts; the minimum rank is
found by a scan, its boundary is deleted, and the two neighbouring ranks are refreshed.  Many words share the scans as
rows of one matrix.  Words of over ``LONG`` bytes take the same steps with a heap in place of the scan.

Defined results: a null or empty text has no ids; ``<|endoftext|>`` inside a text is its special id; very long texts
are cut only where a token must start, so the ids are those of the whole text; a null doc_id stays null, and repeated
rows give a row each.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from quillstone.llm.memory import in_frames

LETTER, NUMBER, OTHER, SPACE, END = 1, 2, 3, 4, 5
NO_RANK = np.int64(2**62)
LONG = 256
CHUNK = 1 << 20
MEMO = 200_000
CUT = "\ud800"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, chars):
            a, b = ord(m[0][0]), ord(m[0][-1])
            kinds[a : b + 1] = kind
    kinds[0xD800] = END
    return kinds


def word_starts(points: np.ndarray) -> np.ndarray:
    """Where the words of the usual byte-level pattern start; texts are separated by 0xD800, a word of its own."""
    kind = char_classes()[points]
    run = np.empty(len(kind), bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    blank = points == 32
    start = run.copy()
    end = kind == END
    start |= end
    # a blank before a run of letters, numbers or others belongs to that run
    joins = run[1:] & (kind[1:] <= OTHER) & blank[:-1]
    start[1:][joins] = False
    # the last white space before other characters stands alone or leads them
    last = run[1:] & (kind[1:] <= OTHER) & (kind[:-1] == SPACE)
    start[:-1][last] = True
    # contractions: an apostrophe that is a run by itself, not led by a blank, before certain letters
    quote = np.flatnonzero((points == 39) & run & start)
    quote = quote[quote + 1 < len(points)]
    quote = quote[run[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = points[quote + 1]
        two = points[np.minimum(quote + 2, len(points) - 1)]
        length = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)
        pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        length = np.where(pair, 3, length)
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        after = quote + length
        start[after[after < len(points)]] = True
    return start


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Encoder:
    """Ids of whole texts under one vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        shown = self._shown_bytes()
        self.byte_id = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        hidden = {c: b for b, c in shown.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(hidden[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.size = size
        # open addressing: a pair's rank and the id that it makes
        self.bits = 18
        slots = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NO_RANK, np.int64)
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[slots[at[rest]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            slots[at[put]] = keys[put]
            self.slot_rank[at[put]] = (put.astype(np.int64) << 32) | made[put]
            rest = np.setdiff1d(rest, put)
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
        self.slots = slots
        self.ranks = {(int(k) // size, int(k) % size): (r, int(m)) for r, (k, m) in enumerate(zip(keys, made))}
        self.forget()

    def forget(self) -> None:
        """Empties the memo of encoded words."""
        self.memo: dict[str, int] = {CUT: 0}
        self.pool = np.empty(1 << 16, np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.used = 0
        self.word_at = np.zeros(MEMO + 1, np.int64)
        self.word_len = np.zeros(MEMO + 1, np.int64)

    @staticmethod
    def _shown_bytes() -> dict[int, str]:
        """The printable character that stands for each byte in byte-level vocabularies."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = (b for b in range(256) if b not in plain)
        return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = self._slot(keys)
        there = self.slots[at]
        rank = np.where(there == keys, self.slot_rank[at], NO_RANK)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there = self.slots[at[todo]]
            hit = there == keys[todo]
            rank[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return rank

    def _encode_matrix(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each of words, all at most width bytes long."""
        n = len(words)
        count = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        parts = self.byte_id[flat]
        # a pair's rank and, below it, the id that it makes: one number to scan
        rank = np.full((n, width), NO_RANK, np.int64)
        row, col = np.nonzero(np.arange(width)[None, :] < (count - 1)[:, None])
        rank[row, col] = self._rank(parts[row, col], parts[row, col + 1])
        out, out_count, live = np.empty_like(parts), count.copy(), np.arange(n)
        columns = np.arange(width - 1)[None, :]
        while True:
            best = rank.argmin(1)
            low = rank[np.arange(len(live)), best]
            done = low == NO_RANK
            if done.any():
                out[live[done]], out_count[live[done]] = parts[done], count[done]
                go = ~done
                live, parts, rank, count, best, low = live[go], parts[go], rank[go], count[go], best[go], low[go]
                if not len(live):
                    return out, out_count
            rows = np.arange(len(live))
            # delete the boundary after the new part: what is right of it moves left by one
            right = columns > best[:, None]
            parts[:, :-1] = np.where(right, parts[:, 1:], parts[:, :-1])
            rank[:, :-1] = np.where(right | (columns == best[:, None]), rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NO_RANK
            parts[rows, best] = low & 0xFFFFFFFF
            count -= 1
            ok = np.flatnonzero(best < count - 1)
            rank[ok, best[ok]] = self._rank(parts[ok, best[ok]], parts[ok, best[ok] + 1])
            ok = np.flatnonzero(best > 0)
            rank[ok, best[ok] - 1] = self._rank(parts[ok, best[ok] - 1], parts[ok, best[ok]])

    def _encode_long(self, word: bytes) -> list[int]:
        parts = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*self.ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heap = [(r, i, m, a, b) for r, m, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = m, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := self.ranks.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (found[0], x, found[1], parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def _learn(self, words: list[str]) -> None:
        """Encodes words that the memo lacks."""
        coded = [w.encode() for w in words]
        width_of = np.array([4, 8, 12, 16, 24, 32, 64, 128, LONG])
        kind = np.searchsorted(width_of, np.fromiter(map(len, coded), np.int64, len(coded)))
        for k_width in np.unique(kind):
            width, rows = int(width_of[k_width]) if k_width < len(width_of) else 0, np.flatnonzero(kind == k_width).tolist()
            for k in range(0, len(rows), 4000):
                some = rows[k : k + 4000]
                if width:
                    parts, count = self._encode_matrix([coded[i] for i in some], width)
                    ids = parts[np.arange(width)[None, :] < count[:, None]]
                else:
                    found = [self._encode_long(coded[i]) for i in some]
                    ids, count = np.concatenate(found), np.array([len(x) for x in found])
                while self.used + len(ids) > len(self.pool):
                    self.pool = np.resize(self.pool, 2 * len(self.pool))
                self.pool[self.used : self.used + len(ids)] = ids
                first = len(self.memo)
                need = first + len(some)
                self.memo.update(zip((words[i] for i in some), range(first, need)))
                if need > len(self.word_at):
                    self.word_at, self.word_len = np.resize(self.word_at, 2 * need), np.resize(self.word_len, 2 * need)
                self.word_at[first:need] = self.used + np.cumsum(count) - count
                self.word_len[first:need] = count
                self.used += len(ids)

    def _segments(self, texts: list[str]) -> Iterator[tuple[int, str | int]]:
        """Pieces of texts that may be encoded apart, and special ids between them, with their text's position."""
        for i, text in enumerate(texts):
            for special, code in self.special.items():
                if text and special in text:
                    parts = text.split(special)
                    for n, part in enumerate(parts):
                        if n:
                            yield i, code
                        yield from self._cut(i, part)
                    break
            else:
                yield from self._cut(i, text or "")

    @staticmethod
    def _cut(i: int, text: str) -> Iterator[tuple[int, str]]:
        while len(text) > CHUNK:
            at = text.find(" ", CHUNK // 2)
            while at > 0 and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace() or at + 1 == len(text)):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield i, text[:at]
            text = text[at:]
        if text:
            yield i, text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids end (with a leading 0)."""
        ids, owner, held, size = [], [], [], 0
        for i, piece in self._segments(texts):
            if isinstance(piece, int):
                self._flush(held, ids, owner)
                held, size = [], 0
                ids.append(np.array([piece], np.uint16 if self.size <= 1 << 16 else np.uint32))
                owner.append((np.array([i]), np.array([1])))
                continue
            held.append((i, piece))
            size += len(piece)
            if size >= CHUNK:
                self._flush(held, ids, owner)
                held, size = [], 0
        self._flush(held, ids, owner)
        counts = np.zeros(len(texts), np.int64)
        for who, n in owner:
            np.add.at(counts, who, n)
        return np.concatenate(ids) if ids else np.empty(0, self.pool.dtype), np.concatenate([[0], np.cumsum(counts)])

    def _flush(self, held: list, ids: list, owner: list) -> None:
        if not held:
            return
        joined = CUT.join(p for _, p in held) + CUT
        points = np.array([joined]).view(np.uint32)
        start = word_starts(points)
        # a cut before each word, then one split gives the words
        at = np.flatnonzero(start)
        spread = np.insert(points, at[1:], 0xD800)
        words = spread.view(f"<U{len(spread)}")[0].split(CUT)
        # a text's end gives two empty words
        if len(self.memo) > MEMO:
            self.forget()
        get = self.memo.get
        codes = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        if (codes < 0).any():
            new = list(dict.fromkeys(words[k] for k in np.flatnonzero(codes < 0)))
            new = [w for w in new if w]
            self._learn(new)
            self.memo[""] = 0
            lost = np.flatnonzero(codes < 0)
            codes[lost] = [self.memo[words[k]] for k in lost]
        lengths = self.word_len[codes]
        ids.append(self.pool[ragged(self.word_at[codes], lengths)])
        # words up to each end of a text
        ends = np.flatnonzero(points[at] == 0xD800)
        # each END word at position k of at gives two empty strings in place of one
        word_ends = ends + np.arange(len(ends)) + 1
        total = np.concatenate([[0], np.cumsum(lengths)])
        upto = total[np.minimum(word_ends, len(words))]
        owner.append((np.array([i for i, _ in held]), np.diff(np.concatenate([[0], upto]))))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; a text that ids don't spell whole has U+FFFD where bytes are not UTF-8, as lossy decoding gives."""
        lengths = self.piece_len[ids]
        return self.piece_bytes[ragged(self.piece_at[ids], lengths)].tobytes().decode("utf-8", "replace").encode()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process; its memo stays from task to task."""
    return Encoder(path)


def chunks(frame: pd.DataFrame, column: str = "text", most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Parts of frame with about ``most`` characters each."""
    sizes = frame[column].str.len().fillna(0).to_numpy(np.int64)
    part = np.cumsum(sizes) // most
    for k in np.unique(part):
        yield frame[part == k]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit, binary) and decoded text (binary)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path or default_path())
        for frame in frames:
            for part in chunks(frame):
                ids, ends = coder.encode([t or "" for t in part["text"]])
                ids = ids.astype("<u4")
                each = [ids[a:b] for a, b in zip(ends, ends[1:])]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_tokens": np.diff(ends), "ids": [x.tobytes() for x in each], "decoded": [coder.decode(x) for x in each]})

    return in_frames(docs.select("doc_id", "text"), work, "doc_id long, n_tokens long, ids binary, decoded binary")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of :func:`encode_documents`, taken where the ids are made so that they need not leave the worker."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path or default_path())
        for frame in frames:
            for part in chunks(frame):
                ids, ends = coder.encode([t or "" for t in part["text"]])
                wide = ids.astype("<u4")
                spans = list(zip(ends, ends[1:]))
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].array,
                        "n_tokens": np.diff(ends),
                        "ids_sha256": [hashlib.sha256(wide[a:b].tobytes()).hexdigest() for a, b in spans],
                        "decoded_sha256": [hashlib.sha256(coder.decode(ids[a:b])).hexdigest() for a, b in spans],
                    }
                )

    return in_frames(docs.select("doc_id", "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
