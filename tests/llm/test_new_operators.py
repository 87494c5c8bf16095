"""Operators 11 to 13 against brute force on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

LEGAL = re.compile("(s?(ua)+)?")


def legal(initials):
    return LEGAL.fullmatch(initials) is not None


def every_repair(rows):
    """(cost, audit, text) of the cheapest edits, by trying all; rows: (role, text, deletable, truncated)."""
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    ways = []
    for role, text, gone, cut in rows:
        own = [(2, "D", None)]
        if not gone:
            own += [(5 * cut, "K", (role, text))] + [(5 * cut + 1, "R", (r, text)) for r in ("user", "assistant")]
        ways.append(own)
    best = None
    for edits in itertools.product(*ways):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            out, audit, cost = [], "", 0
            for k, new in enumerate(inserts):
                out += [(r, "") for r in new]
                audit, cost = audit + "I" * len(new), cost + 5 * len(new)
                if k < len(rows):
                    cost, audit = cost + edits[k][0], audit + edits[k][1]
                    out += [edits[k][2]] if edits[k][2] else []
            if (best is None or (cost, audit) < best[:2]) and legal("".join(r[:1] or "-" for r, _ in out)):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    return best


def by_hand(rows, repair=None):
    """What the query returns for a conversation's rows (turn, role, text) after damage, in any order."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), hashlib.sha256(v[2].encode()).digest()))
    seen, marked = set(), []
    for _, role, text in rows:
        kind = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, kind))
    numbers = [t for t, _, _ in rows if t is not None]
    cost, audit, text = (repair or every_repair)([(r, x, k in ("blank", "duplicate"), k == "truncated") for r, x, k in marked])
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        **{k: sum(m[2] == k for m in marked) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def damage(rows):
    """(conv_id, turn, role, text) rows after the damage."""
    show = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, "user" if kind == 4 else role, text


def forward(rows):
    """The cheapest repair by a plain forward programme that keeps whole audits; no gap needs over two insertions."""
    after = {None: "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    states = {None: (0, "", ())}

    def better(into, state, cost, audit, out):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = cost, audit, out

    def inserted(states):
        for _ in range(2):
            for state, (cost, audit, out) in list(states.items()):
                new = after[state][-1]
                better(states, new, cost + 5, audit + "I", (*out, f"{full[new]}:"))
        return states

    for role, text, gone, cut in rows:
        now = {}
        for state, (cost, audit, out) in inserted(dict(states)).items():
            better(now, state, cost + 2, audit + "D", out)
            if not gone:
                if role[:1] and role[:1] in after[state]:
                    better(now, role[:1], cost + 5 * cut, audit + "K", (*out, f"{role}:{text}"))
                new = after[state][-1]
                better(now, new, cost + 5 * cut + 1, audit + "R", (*out, f"{full[new]}:{text}"))
        states = now
    ends = [v for k, v in inserted(states).items() if k in (None, "a")]
    cost, audit, out = min(ends)
    return cost, audit, "\n".join(out)


def repaired(frame):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in frame.collect()}


CONVERSATIONS = "conv_id long, turn long, role string, text string, digest string, class int, copies_of int"


def conversation_rows(rng, convs, most):
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Yes.  \t", "ünï.", "x"]
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, most)):
            rows.append((conv, None if rng.random() < 0.1 else turn + rng.randint(0, 1), rng.choice(["system", "user", "assistant", "user", "assistant", "admin", "tool", "", None]), rng.choice(texts)))
    return rows


def test_forward_programme_is_every_repair():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), f"t{k}", rng.random() < 0.2, rng.random() < 0.3) for k in range(rng.randint(0, 3))]
        assert forward(rows) == every_repair(rows), rows


def test_plans_are_the_forward_programme():
    from quillstone.llm.conversations import ASSISTANT, BLANK, CUT_OFF, SYSTEM, USER, plan

    rng, code = random.Random(6), {"system": SYSTEM, "user": USER, "assistant": ASSISTANT, "tool": 0}
    for n in [*range(9)] * 40 + [40, 100] * 10:
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), f"t{k}", rng.random() < 0.2, rng.random() < 0.3) for k in range(n)]
        codes = bytes(code[r] | BLANK * gone | CUT_OFF * cut for r, _, gone, cut in rows)
        for block in (1, 3, 1 << 16):
            assert plan(codes, block) == forward(rows)[:2], rows


@pytest.mark.parametrize("segment", [3, 1 << 20])
def test_conversations_by_hand(spark, segment):
    from quillstone.llm import conversations as C

    rng = random.Random(8)
    rows = conversation_rows(rng, [None, 0, -3, 2**62 + 1, *range(5, 60)], 6) + conversation_rows(rng, [99], 300)
    rows += rows[:40]  # repeated rows
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CONVERSATIONS).repartition(5)
    want = {r[0]: [] for r in rows}
    for conv, *row in damage(rows):
        want[conv].append(row)
    before, C.SEGMENT = C.SEGMENT, segment
    try:
        got = repaired(C.repair(C.damaged(table), "copies"))
    finally:
        C.SEGMENT = before
    assert set(got) == set(want)
    for conv, mine in want.items():
        assert got[conv] == by_hand(mine, forward), conv


def test_repaired_turns(spark):
    from quillstone.llm import conversations as C

    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why?"), (2, 0, "user", ""), (3, 5, "tool", "A."), (3, 6, "assistant", "B!")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int")
    plans = C.audits(table)
    out = C.repaired_turns(table, plans).orderBy("conv_id", "position").collect()
    for conv in (1, 2, 3):
        mine = [r for r in out if r.conv_id == conv]
        cost, audit, text = every_repair([(r[2], r[3], not r[3], False) for r in rows if r[0] == conv])
        assert [r.position for r in mine] == list(range(len(mine))) and "\n".join(f"{r.role}:{r.text}" for r in mine) == text
        assert plans.where(f"conv_id = {conv}").first().audit == audit and "".join(r.edit for r in mine) == audit.replace("D", "")


def test_conversations_of_no_rows(spark):
    from quillstone.llm import conversations as C

    assert C.repair(C.damaged(spark.createDataFrame([], CONVERSATIONS)), "copies").count() == 0
    dropped = next((c, t) for c in range(500) for t in range(2) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    r = C.repair(C.damaged(spark.createDataFrame([(*dropped, "user", "x", "", 1, 2)], CONVERSATIONS)), "copies").first()
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (0, 0, 0, 0, 0, 0, "") and r.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_columns_of_other_names_are_ignored(spark):
    from quillstone.llm import conversations as C

    rows = [(1, 0, "user", "Hi.", "none"), (1, 1, "assistant", "Yes.", "2"), (1, 1, "assistant", "Yes.", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies string").withColumn("audit", F.lit(3)).withColumn("digest", F.lit("x"))
    assert repaired(C.repair(table))[1] == by_hand([r[1:4] for r in rows])


def test_a_hot_conversation_is_cut(spark):
    from quillstone.llm import conversations as C

    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"{t}." if t % 5 else "same.") for t in range(3000)] + [(7, 10, "user", "x")] * 500
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sizes = [r["count"] for r in C.faults(table.selectExpr("*", "1 copies")).repartitionByRange(4, "conv_id", "turn", "role", "digest").groupBy(C.F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1500
    assert repaired(C.repair(table))[7] == by_hand([r[1:] for r in rows], forward)


LIBRARY = ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")


def library_counts(name, texts):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def odd_texts():
    rng = random.Random(4)
    letters = "aaeeiou  nstrl\n\n\t.,;:!?'\"-ÜéßДя日本語٣७½́ ​\x1c\x85 <|endoftext|>"
    mixed = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    words = [" ".join("".join(rng.choice("abcdefgh'sTé") for _ in range(rng.randint(1, 8))) for _ in range(300)) for _ in range(5)]
    return ["", " ", "a b", "a  b", "x <|endoftext|> y<|endoftext|>", "<|startoftext|>hi", "don't we'll, I'm. it's", "日本語テキスト。" * 40, "a" * 900, *mixed, *words]


@pytest.mark.parametrize("name", LIBRARY)
@pytest.mark.parametrize("most", [8, 64, 1 << 18])
def test_counts_are_the_library(name, most):
    import public_tokenizers

    from quillstone.llm.counts import count_texts

    texts = odd_texts()
    assert count_texts(texts, public_tokenizers.path(name), most, 500).tolist() == library_counts(name, texts)


def test_count_query(spark):
    from quillstone.llm.bpe import default_path
    from quillstone.llm.counts import count_tokens, counter, pieces

    texts = [*odd_texts(), None, "word " * 200_000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b", "x", 1), (0, "a b", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, n_tokens int")
    want = library_counts("byte_bpe_50k.json", [r[1] or "" for r in rows])
    want = [(d, len((t or "").encode()), n, n > 1024) for (d, t, _, _), n in zip(rows, want)]
    assert sorted(map(tuple, count_tokens(docs).collect()), key=str) == sorted(want, key=str)
    assert max(map(len, pieces("word " * 200_000, counter(default_path())[1], 1000))) < 1010
    assert count_tokens(docs.limit(0)).count() == 0


def resampled(docs, targets, buckets=10000):
    """Rows of the query for (doc_id, text) documents."""

    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(f.encode()) % buckets for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in docs:
        np.add.at(s, found(text)[1], 1)
    for text in targets:
        np.add.at(t, found(text)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + buckets) / ((a + 1) * (int(t.sum()) + buckets)))) for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for doc, text in docs:
        n, own = found(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([n, doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    for k, r in enumerate(drawn[: 25 * len(drawn) // 100]):
        r[5] = k + 1
    return sorted((tuple(r[1:]) for r in rows), key=str)


def test_resampling(spark, monkeypatch):
    from quillstone.llm import resampling as R

    rng = random.Random(2)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x9", "été-x", "don't", "日本", "_", "gamma"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(200)]
    docs += [(None, docs[3][1]), (None, None), (500, None), (501, ""), (502, " - "), (-1, "a" * 5000)] + [docs[7]] * 9 + [(7, "other " * 30)] * 2 + [(900, "word, " * 3000)]
    targets = ["alpha beta gamma", None, "", "été x9 " * 5]
    table = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, rank string, score int, m int").repartition(6)
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, item_id int")
    for piece in (R.PIECE, 40):
        monkeypatch.setattr(R, "PIECE", piece)
        assert sorted(map(tuple, R.resample(table, target).collect()), key=str) == resampled(docs, targets)
    assert R.resample(table.limit(0), target).count() == 0
    nothing = R.resample(table, target.limit(0))
    assert sorted(map(tuple, nothing.collect()), key=str) == resampled(docs, [])


def test_pieces_of_a_text_have_its_features(monkeypatch):
    from quillstone.llm import resampling as R

    text = " ".join(f"w{k} É{k % 7}" for k in range(500)) + "z" * 300 + "  end."
    want = sorted(x for _, part in R.crcs(text) for x in part)
    monkeypatch.setattr(R, "PIECE", 64)
    parts = list(R.crcs(text))
    assert len(parts) > 20 and sorted(x for _, part in parts for x in part) == want and sum(n for n, _ in parts) == 1001
