"""Conversation structure repair by a retained-subsequence dynamic programme (operator 11).

A conversation is repaired by edits: Keep a turn (0), Rerole it to user or assistant (1), Delete it (2; required for blank
and repeated turns), Insert an empty user or assistant turn anywhere (5); a truncated turn that stays adds 5.  What
results has role initials ``(s?(ua)+)?``.  Of the cheapest edits those with the ASCII-least audit (their initials in
order) are taken.

The programme chooses the retained turns.  Between two of them lie deletions, whose price is a difference of prefix
sums, and insertions, whose number follows from the pair of roles.  From the last turn backwards, one running minimum for
each role of the next retained turn prices every gap, so the time is linear.  A walk forwards then takes, of the edits
that keep to the least cost, the least initial; the audit settles the roles, as parity tells whether the system turn stays.

At scale: rows as (turn, role, digest of the text) are grouped first, so equal rows are one with a count, and "seen
earlier" is the least turn of a digest.  They are sorted by ranges of (conversation, turn, role, digest), so a
conversation of any size is cut over tasks, and each stretch becomes one byte a turn.  Only these bytes of a conversation
meet in one task (its audit is as long), 65,536 turns of them under work at a time.  Texts are then streamed in order
beside the audits; no task holds more than a batch of them.  One digest over a whole conversation is made turn after
turn, hence by one task.

Defined results: a null turn sorts first, a null role or text is one blank, rows with a null conv_id are one conversation;
turns of one number are ordered by role and then by the SHA-256 of the text; a role is taken by its first letter, one
without a letter or with another than s, u and a can't be kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.memory import small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: states: nothing yet, and the role of the last retained turn; they are the classes of roles too (0: another role)
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: the role that an insertion or a new role has after each state
NEXT = (USER, USER, ASSISTANT, USER)
#: insertions between a state and the next retained role, and at the end
BETWEEN = {(START, SYSTEM): 0, (START, USER): 0, (START, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
LAST = (0, 2, 1, 0)
#: bits of a turn's byte, above its class
BLANK, REPEATED, CUT_OFF, NEW_TURN = 4, 8, 16, 32
#: turns of a segment, and turns that the programme works on at a time
SEGMENT, BLOCK = 1 << 20, 1 << 16
WHITE = r"\x20\x09-\x0D"


def choices(code: int) -> list[tuple[int, int, str]]:
    """(role, cost, initial of the edit) of the ways to retain a turn."""
    if code & (BLANK | REPEATED):
        return []
    base, own = TRUNCATED * bool(code & CUT_OFF), code & 3
    kept = [(own, base + KEEP, "K")] if own else []
    return kept + [(r, base + REROLE, "R") for r in (USER, ASSISTANT) if r != own]


CHOICES = [choices(code) for code in range(64)]


def cheapest(state: int, least: tuple[int, int, int], end: int) -> int:
    """Cost, with all deletions before, of going on after a state; least: by the next retained role, end: with none."""
    s, u, a = least
    if state == USER:
        return min(end + INSERT, a, u + INSERT)
    if state == ASSISTANT:
        return min(end, u, a + INSERT)
    if state == SYSTEM:
        return min(end + 2 * INSERT, u, a + INSERT)
    return min(end, s, u, a + INSERT)


NEVER = 1 << 60


def minima(codes: bytes, after: tuple[int, int, int], end: int) -> list[tuple[int, int, int]]:
    """For each place of codes, the running minima over what is retained from there on; after: those behind codes."""
    out = [after]
    for code in reversed(codes):
        now = list(after)
        for role, cost, _ in CHOICES[code]:
            # retained in place of deleted
            if (cost := cost - DELETE + cheapest(role, after, end)) < now[role - 1]:
                now[role - 1] = cost
        out.append(after := tuple(now))
    return out[::-1]


def plan(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Least cost and the audit of a conversation, given a byte for each turn."""
    n = len(codes)
    end = DELETE * n
    starts = range(0, n, block)
    behind = {n: (NEVER, NEVER, NEVER)}
    for a in reversed(starts):
        behind[a] = minima(codes[a : a + block], behind[min(n, a + block)], end)[0]
    cost = cheapest(START, behind[0] if n else behind[n], end)
    state, audit = START, []
    for a in starts:
        part = codes[a : a + block]
        least = minima(part, behind[min(n, a + block)], end)
        for k, code in enumerate(part):
            now, after = cheapest(state, least[k], end), least[k + 1]
            if cheapest(state, after, end) == now:
                audit.append("D")
                continue
            ways = (("I" * gap + letter, role) for role, own, letter in CHOICES[code] if (gap := BETWEEN.get((state, role))) is not None and INSERT * gap + own - DELETE + cheapest(role, after, end) == now)
            edit, state = min(ways)
            audit.append(edit)
    audit.append("I" * LAST[state])
    return cost, "".join(audit)


def faults(conversations: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, digest) with their number (copies), class, blank, cut_off, and whether they come first.

    conversations has conv_id, turn, role, text and copies (how often a row counts; with 0 it only names its conversation).
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    initial = F.substring(role, 1, 1)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0).cast("int").alias("class"),
        (~text.rlike(f"[^{WHITE}]")).alias("blank"),
        (~text.rlike(rf"[.!?][{WHITE}]*\z")).alias("cut_off"),
        F.col("copies").cast("long").alias("copies"),
    )
    key = ("conv_id", "turn", "role", "digest")
    kinds = ("class", "blank", "cut_off")
    rows = rows.groupBy(*key, *kinds).agg(F.sum("copies").alias("copies"))
    # nulls are least in a struct
    first = rows.where("copies > 0").groupBy("conv_id", "role", "digest", *kinds).agg(F.min(F.struct("turn")).getField("turn").alias("turn"))
    both = rows.withColumn("first", F.lit(False)).unionByName(first.select(*key, *kinds, F.lit(0).cast("long").alias("copies"), F.lit(True).alias("first")))
    return both.groupBy(*key, *kinds).agg(F.sum("copies").alias("copies"), F.max("first").alias("first"))


SEGMENTS = "conv_id long, part int, number long, codes binary, low long, high long"


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of conversations, in order, as one byte a turn; low and high are their first and last numbered turn."""
    kinds, part, number = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("codes", pa.binary()), ("low", pa.int64()), ("high", pa.int64())]), TaskContext.get().partitionId(), 0
    conv, codes, low, high, size, some = None, [], None, None, 0, False

    def segment() -> dict:
        return {"conv_id": conv, "part": part, "number": number, "codes": b"".join(codes), "low": low, "high": high}

    for batch in batches:
        ids, turns = batch.column("conv_id"), batch.column("turn")
        n = len(ids)
        if not n:
            continue
        plain = lambda c, v=0: c.fill_null(v).to_numpy(zero_copy_only=False)
        id_of, no_id, turn, no_turn = plain(ids), ids.is_null().to_numpy(zero_copy_only=False), plain(turns), turns.is_null().to_numpy(zero_copy_only=False)
        copies, blank, first, cut_off = plain(batch.column("copies")), plain(batch.column("blank"), False), plain(batch.column("first"), False), plain(batch.column("cut_off"), False)
        repeated = ~blank & ~first
        rest = plain(batch.column("class")).astype(np.uint8) | np.where(blank, BLANK, 0).astype(np.uint8) | np.where(blank, 0, REPEATED).astype(np.uint8)
        lead = (rest & 3) | np.where(blank, BLANK, 0) | np.where(repeated, REPEATED, 0) | np.where(~blank & ~repeated & cut_off, CUT_OFF, 0)
        change = np.ones(n, bool)
        change[1:] = (id_of[1:] != id_of[:-1]) | (no_id[1:] != no_id[:-1])
        edges, ends = [*np.flatnonzero(change).tolist(), n], np.concatenate([[0], np.cumsum(copies)])
        raw = np.repeat(rest, copies)
        there = copies > 0
        raw[ends[:-1][there]] = lead[there]
        found = []
        for a, b in zip(edges, edges[1:]):
            own = None if no_id[a] else int(id_of[a])
            if some and (own != conv or size >= SEGMENT):
                found.append(segment())
                number += 1
                codes, low, high, size = [], None, None, 0
            conv, some = own, True
            mine = raw[ends[a] : ends[b]]
            at = np.flatnonzero(there[a:b] & ~no_turn[a:b]) + a
            if len(at):
                numbers = turn[at]
                new = np.ones(len(at), bool)
                new[1:] = numbers[1:] != numbers[:-1]
                new[0] = high is None or numbers[0] != high
                mine[ends[at[new]] - ends[a]] |= NEW_TURN
                low, high = int(numbers[0]) if low is None else low, int(numbers[-1])
            codes.append(mine.tobytes())
            size += len(mine)
        if found:
            yield pa.RecordBatch.from_pylist(found, kinds)
    if some:
        yield pa.RecordBatch.from_pylist([segment()], kinds)


AUDITS = {"conv_id": "long", "gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string"}
KINDS = {"long": pa.int64(), "string": pa.string()}
AUDIT_KINDS = pa.schema([(c, KINDS[k]) for c, k in AUDITS.items()])


def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of faults, cost and audit of conversations whose segments come one after the other, in order."""

    def row(parts: list[tuple]) -> dict:
        codes = b"".join(p[1] for p in parts)
        numbered = [p for p in parts if p[2] is not None]
        bits = np.frombuffer(codes, np.uint8)
        own = bits & 3
        legal = ((own[1:] == USER) & (own[:-1] != USER) & (own[:-1] != 0)) | ((own[1:] == ASSISTANT) & (own[:-1] == USER))
        # a turn that goes on in the next segment counts once
        turns = np.count_nonzero(bits & NEW_TURN) - sum(a[3] == b[2] for a, b in zip(numbered, numbered[1:]))
        cost, audit = plan(codes)
        return {
            "conv_id": parts[0][0],
            "gaps": numbered[-1][3] - numbered[0][2] + 1 - turns if numbered else 0,
            "blank": np.count_nonzero(bits & BLANK),
            "duplicate": np.count_nonzero(bits & REPEATED),
            "truncated": np.count_nonzero(bits & CUT_OFF),
            "illegal": max(0, len(bits) - 1) - np.count_nonzero(legal),
            "cost": cost,
            "audit": audit,
        }

    held: list[tuple] = []
    for batch in batches:
        found = []
        for part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "codes", "low", "high"))):
            if held and held[0][0] != part[0]:
                found.append(row(held))
                held = []
            held.append(part)
        if found:
            yield pa.RecordBatch.from_pylist(found, AUDIT_KINDS)
    if held:
        yield pa.RecordBatch.from_pylist([row(held)], AUDIT_KINDS)


def audits(conversations: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit."""
    spark = conversations.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = faults(conversations).repartitionByRange(parts, "conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    stretches = rows.select("conv_id", "turn", "class", "blank", "cut_off", "first", "copies").mapInArrow(segments, SEGMENTS)
    return stretches.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(audited, ", ".join(f"{c} {k}" for c, k in AUDITS.items()))


def with_turns(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans and turns of each conversation in one task, the plan first and then the turns in their order."""
    none = lambda c, k: F.lit(None).cast(k).alias(c)
    heads = plans.select(*AUDITS, none("turn", "long"), none("role", "string"), none("text", "string"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast("binary").alias("digest"), F.lit(True).alias("head"))
    text = F.coalesce("text", F.lit(" "))
    turns = conversations.where("copies > 0").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        *(none(c, k) for c, k in list(AUDITS.items())[1:]),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"),
        F.col("copies").cast("long").alias("copies"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.lit(False).alias("head"),
    )
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return heads.unionByName(turns).repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.desc("head"), "turn", "role", "digest").drop("digest")


class Walk:
    """Follows an audit beside the turns, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, None, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield "I", None, NAMES[self.state], ""

    def retained(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, int | None, str, str]]:
        """The (edit, turn, role, text) that a turn gives, with what is inserted before it."""
        yield from self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield "K", turn, role, text
        elif letter == "R":
            self.state = NEXT[self.state]
            yield "R", turn, NAMES[self.state], text


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, list[tuple]]]:
    """For each plan (plan, []), then (None, the repaired turns) of each of its turns; at its end, of what is inserted there."""
    walk = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["head"]:
                if walk:
                    yield None, list(walk.inserted())
                walk = Walk(r["audit"])
                yield r, []
            else:
                for _ in range(r["copies"]):
                    yield None, list(walk.retained(r["turn"], r["role"], r["text"]))
    if walk:
        yield None, list(walk.inserted())


def repaired_turns(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position from 0, edit (K, R or I), turn (null if inserted), role, text."""
    kinds = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, rows = None, 0, []
        for head, turns in walked(batches):
            if head:
                conv, position = head["conv_id"], 0
            for edit, turn, role, text in turns:
                rows.append({"conv_id": conv, "position": position, "edit": edit, "turn": turn, "role": role, "text": text})
                position += 1
            if len(rows) >= 500:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, kinds)

    return with_turns(conversations, plans).mapInArrow(work, "conv_id long, position long, edit string, turn long, role string, text string")


def repair_digests(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """plans with the SHA-256 of the repaired ``role:text`` of each conversation, joined by newlines."""
    kinds = AUDIT_KINDS.append(pa.field("repaired_sha256", pa.string()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_of, digest, lead, rows = None, None, "", []
        for head, turns in walked(batches):
            if head:
                if plan_of:
                    rows.append({**plan_of, "repaired_sha256": digest.hexdigest()})
                plan_of, digest, lead = head, hashlib.sha256(), ""
            for _, _, role, text in turns:
                digest.update(f"{lead}{role}:{text}".encode())
                lead = "\n"
            if len(rows) >= 500:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows = []
        if plan_of:
            rows.append({**plan_of, "repaired_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, kinds)

    return with_turns(conversations, plans).mapInArrow(work, ", ".join(f"{c} {k}" for c, k in {**AUDITS, "repaired_sha256": "string"}.items()))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies after the stated damage by crc32 of ``conv_id:turn``, modulo 20."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repair(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """Per conversation: counts of faults, cost, audit and the digest of what it becomes.

    copies names a column that says how often a row counts; without it each row counts once, whatever columns there are.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", (F.col(copies) if copies else F.lit(1)).alias("copies"))
    return repair_digests(rows, audits(rows))
