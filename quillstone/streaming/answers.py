"""Answers that arrive in pieces: an incremental parser as keyed state of a stream.

However a text is cut into pieces, and the pieces into batches, what comes out is what
:func:`quillstone.operators.answers.fold_streams` makes of the whole text.  Text is given out as soon as it is certain: the
first line is held until it can be read, a tail that may become the mark before the actions (or a thought's tag) until it
is resolved.  Pieces that arrive early wait for those before them; pieces that arrive again are dropped.  The state of a
stream is its held text and its place, so a restart from the checkpoint goes on where it was.  A stream whose last piece
never comes ends when the watermark has passed its newest piece by an hour.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.operators.answers import HEAD, HEAD_LIMIT, MARK, THOUGHT_TAGS

BLANKS = " \t\n\x0b\f\r"
HEAD_RE, MARK_RE = (regex.compile(p.replace(r"\s", f"[{BLANKS}]"), regex.ASCII) for p in (HEAD, MARK))
OPEN, CLOSE = THOUGHT_TAGS
#: milliseconds of event time after which a stream without new pieces has ended, and an ended one is forgotten
PATIENCE = 3_600_000


def held_tail(text: str, tag: str) -> int:
    """Length of the longest end of a text that a tag starts with."""
    return next((n for n in range(min(len(text), len(tag) - 1), 0, -1) if tag.startswith(text[-n:])), 0)


class Parser:
    """Sections of one answer, piece by piece; its state is plain text and flags."""

    def __init__(self, **state):
        self.phase, self.held, self.answerable, self.thought, self.tag = "head", "", None, False, ""
        self.__dict__.update(state)

    def state(self) -> dict:
        return dict(self.__dict__)

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """(section, text) that is certain now."""
        return self._consume(self._spoken(piece))

    def finish(self) -> list[tuple[str, str]]:
        """The rest, at the end of the text; an open thought goes to the end."""
        out = self._consume("" if self.thought else self.tag)
        self.tag = ""
        if self.phase == "head":
            out += self._head(True)
        if self.phase == "answer" and self.held:
            # a held tail that was no mark after all
            out.append(("answer", self.held))
            self.held = ""
        return out

    def _spoken(self, piece: str) -> str:
        """What is outside thoughts, less a tail that may be a tag."""
        text, out = self.tag + piece, []
        while True:
            tag = CLOSE if self.thought else OPEN
            before, found, after = text.partition(tag)
            if not found:
                break
            if not self.thought:
                out.append(before)
            self.thought, text = not self.thought, after
        keep = held_tail(text, tag)
        self.tag = text[len(text) - keep :]
        if not self.thought:
            out.append(text[: len(text) - keep])
        return "".join(out)

    def _consume(self, text: str) -> list[tuple[str, str]]:
        if not text:
            return []
        if self.phase == "head":
            self.held += text
            return self._head(False)
        if self.phase == "lead":
            text = text.lstrip(BLANKS)
            if text:
                self.phase = "answer"
        if self.phase == "answer" and text:
            return self._answer(text)
        if self.phase == "blanks":
            text = text.lstrip(BLANKS)
            if text:
                self.phase = "stars"
        if self.phase == "stars":
            text = text.lstrip("*")
            if text:
                self.phase = "actions"
        return [("actions", text)] if self.phase == "actions" and text else []

    def _head(self, end: bool) -> list[tuple[str, str]]:
        text = self.held
        found = HEAD_RE.match(text)
        if found and (end or found.end() < len(text)):
            self.answerable, self.held = found[1].upper() == "YES", ""
            self.phase = "lead" if self.answerable else "none"
            return self._consume(text[found.end() :])
        if not end and (found or HEAD_RE.match(text, partial=True)):
            return []
        bare = text.strip(BLANKS)
        led = len(text) > HEAD_LIMIT or "\n" in bare
        # blanks at the start stay if the text is a short single line, which only its end can tell
        if not end and text[0] in BLANKS and not led:
            return []
        self.answerable, self.held, self.phase = bare != "", "", "answer" if bare else "none"
        return self._answer(text.lstrip(BLANKS) if led else text) if bare else []

    def _answer(self, text: str) -> list[tuple[str, str]]:
        text, self.held = self.held + text, ""
        if found := MARK_RE.search(text):
            self.phase = "stars" if "*" in found[0].rpartition(":")[2] else "blanks"
            before = [("answer", text[: found.start()])] if found.start() else []
            return before + self._consume(text[found.end() :])
        tail = MARK_RE.search(text, partial=True)
        stop = tail.start() if tail else len(text)
        self.held = text[stop:]
        return [("answer", text[:stop])] if stop else []


EVENTS = "id long, part long, section string, text string, answerable boolean"


def parsed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One step of a stream's state: its new pieces, in order as far as there is no gap."""
    kept = json.loads(state.get[0]) if state.exists else {"next": 0, "part": 0, "waiting": {}, "closed": False, "parser": {}, "newest": 0}
    parser, rows = Parser(**kept["parser"]), []

    def give(events: list[tuple[str | None, str | None]]) -> None:
        for section, text in events:
            rows.append((key[0], kept["part"], section, text, parser.answerable if section == "end" else None))
            kept["part"] += 1

    if state.hasTimedOut:
        if not kept["closed"]:
            give(parser.finish() + [("end", None)])
        state.remove()
    else:
        for frame in frames:
            kept["newest"] = max([kept["newest"], *(frame["at"].astype("int64") // 10 ** (3 if frame["at"].dtype == "datetime64[us]" else 6)).tolist()])
            for seq, piece, last in zip(frame["seq"].tolist(), frame["piece"].tolist(), frame["last"].tolist()):
                if not kept["closed"] and seq >= kept["next"]:
                    kept["waiting"].setdefault(str(seq), [piece or "", bool(last)])
        while not kept["closed"] and (found := kept["waiting"].pop(str(kept["next"]), None)):
            kept["next"] += 1
            give(parser.feed(found[0]))
            if found[1]:
                give(parser.finish() + [("end", None)])
                kept |= {"closed": True, "waiting": {}}
        kept["parser"] = {} if kept["closed"] else parser.state()
        state.update((json.dumps(kept),))
        state.setTimeoutTimestamp(max(kept["newest"], state.getCurrentWatermarkMs()) + PATIENCE)
    yield pd.DataFrame(rows, columns=["id", "part", "section", "text", "answerable"])


def answer_events(pieces: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of a stream of (id, seq, piece, last, at): text of the sections answer and actions, and an end that says whether
    there is an answer.  seq counts from 0; the piece that is last ends its answer; at is its time."""
    return pieces.withWatermark("at", late).groupBy("id").applyInPandasWithState(parsed, EVENTS, "state string", "append", GroupStateTimeout.EventTimeTimeout)
