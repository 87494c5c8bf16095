"""Token counts (operator 12).

Texts go to Arrow functions that return lengths only.  A batch is dealt into calls of about equal bytes, and a text longer
than a piece is split at safe boundaries, where every tokenisation of the whole text has a boundary too, so the counts of
its pieces add up.  Calls of one size bound a worker's memory whatever the texts' lengths.

Vocabularies with the usual byte-level pattern are encoded by :mod:`quillstone.llm.bpe` in batches of words; other
``.json`` files by the library tokenizers and ``.model`` files by sentencepiece.  Special strings inside texts are handled
as the library does by default.

Safe boundaries: a blank between two letters or digits (byte-level words begin with it; sentencepiece and vocabularies that
drop white space lose it), and for byte-level words the place between a letter and one of ``,.;:!?`` or a line end.  A
vocabulary for which they are not known to hold, and a text without any, is encoded whole.

Defined results: a null text is empty and has no tokens; a null doc_id stays null; repeated rows give a row each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.bpe import CUT, MEMO, Encoder, default_path, word_starts
from quillstone.llm.memory import small_batches

#: characters of a piece, and bytes of a call
PIECE, CALL_BYTES = 1 << 18, 1 << 20
LIMIT = 1024
BLANK = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])")
BYTE_LEVEL = regex.compile(r"(?<=[\p{L}\p{N}])(?= [\p{L}\p{N}])|(?<=\p{L})(?=[,.;:!?\n])")


class Lengths(Encoder):
    """Lengths of texts in ids, without the ids."""

    def count(self, texts: list[str]) -> np.ndarray:
        out, held = np.zeros(len(texts), np.int64), []
        for i, piece in self._segments(texts):
            if isinstance(piece, int):
                out[i] += 1
            else:
                held.append((i, piece))
        if not held:
            return out
        joined = CUT.join(p for _, p in held) + CUT
        points = np.array([joined]).view(np.uint32)
        at = np.flatnonzero(word_starts(points))
        spread = np.insert(points, at[1:], 0xD800)
        words = spread.view(f"<U{len(spread)}")[0].split(CUT)
        if len(self.memo) > MEMO:
            self.forget()
        codes = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(codes < 0)
        if len(lost):
            self._learn([w for w in dict.fromkeys(words[k] for k in lost) if w])
            self.memo[""] = 0
            codes[lost] = [self.memo[words[k]] for k in lost]
        total = np.concatenate([[0], np.cumsum(self.word_len[codes])])
        # the end of a piece, a word of its own, gives two empty words
        ends = np.flatnonzero(points[at] == 0xD800)
        upto = total[np.minimum(ends + np.arange(len(ends)) + 1, len(words))]
        np.add.at(out, [i for i, _ in held], np.diff(np.concatenate([[0], upto])))
        return out


@lru_cache(2)
def counter(path: str) -> tuple[Callable[[list[str]], np.ndarray], regex.Pattern | None]:
    """The function that counts the tokens of texts, and where texts may be split; one of each for a worker process."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        inside = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        apart = model.encode("a b") == model.encode("a") + model.encode("b")
        return lambda texts: np.fromiter(map(len, model.encode(texts, num_threads=1)), np.int64, len(texts)), BLANK if apart and not inside else None
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    first, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(BYTE_LEVEL.search(f"a{t['content']}a") for t in added)
    usual = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not spec.get("normalizer") and plain and len(added) <= 1
    model = spec["model"]
    if usual and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return Lengths(path).count, BYTE_LEVEL
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work over the cores
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    dropped = any(p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert") for p in first.get("pretokenizers", [first]))
    return lambda texts: np.fromiter(map(len, library.encode_batch_fast(texts, add_special_tokens=False)), np.int64, len(texts)), BLANK if dropped and plain else None


def pieces(text: str, boundary: regex.Pattern | None, most: int = PIECE) -> Iterator[str]:
    """Parts of a text that are about ``most`` characters long and are tokenised apart as in the whole."""
    start = 0
    while boundary and len(text) - start > most and (found := boundary.search(text, start + most // 2)):
        yield text[start : found.start()]
        # a blank that the vocabulary drops goes with the cut
        start = found.end()
    yield text[start:]


def count_texts(texts: list[str], path: str, most: int = PIECE, call_bytes: int = CALL_BYTES) -> np.ndarray:
    """Number of tokens of each text, in calls of about ``call_bytes``."""
    count, boundary = counter(path)
    out = np.zeros(len(texts), np.int64)
    rows, held, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text, boundary, most):
            if held and size + len(piece) > call_bytes:
                np.add.at(out, rows, count(held))
                rows, held, size = [], [], 0
            rows.append(i)
            held.append(piece)
            size += len(piece)
    if held:
        np.add.at(out, rows, count(held))
    return out


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and whether n_tokens is over the limit."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or default_path()
        for batch in batches:
            counts = count_texts(pc.fill_null(batch.column("text"), "").to_pylist(), file)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
