"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, part int, score double, found string"


def rows_of(texts, first=0):
    return [(first + i, t, "en", None if i % 3 else "src", None if t is None else len(t), "b", i, 0.5, "x") for i, t in enumerate(texts)]


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ",", "!\n"]) for _ in range(n))
    passage = text(80)
    base = text(200)
    near = base.split(" ")
    near[50] = "changed"
    out = [None, "", " \n\t ", "one", "one two three", "Ünïcödé 日本語 \x00 <|endoftext|> x", base, base, " ".join(near), base.upper()]
    out += [text(30) + " " + passage + " " + text(20) for _ in range(5)] + [passage[:120], passage[3:90]]
    out += [text(rng.randint(1, 120)) for _ in range(20)] + ["a" * 3000, "ab " * 6000, text(9000), base, None, ""]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(corpus()), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_bpe_is_the_tokenizer(docs, empty, tokenizer):
    from quillstone.llm.bpe import digest_documents, encode_documents

    texts = dict(enumerate(corpus()))
    got = encode_documents(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = ids_of(tokenizer, texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded).decode() == tokenizer.decode(want, skip_special_tokens=False)
    r = digest_documents(docs).where("doc_id = 5").first()
    assert r.decoded_sha256 == hashlib.sha256(texts[5].encode()).hexdigest()
    assert digest_documents(empty).count() == 0


def test_bpe_odd_words(tokenizer):
    from quillstone.llm.bpe import default_path, encoder

    odd = ["'s 'start it's I'll we're 'x don't ' 's  's", "a  b   c\n\n d \n", "  ", "x<|endoftext|>y  <|endoftext|>", "１２ ½ ﬁ", "\t\ttab\r\n end ", "a" * 700 + " " + "ab" * 900, "!!'s ''s 'sx 'll'll", " 're", "\x00a\x00", "x'", "́é"]
    ids, ends = encoder(default_path()).encode(odd)
    for text, a, b in zip(odd, ends, ends[1:]):
        assert ids[a:b].tolist() == ids_of(tokenizer, text), text


def test_packing_in_order(docs, empty, tokenizer):
    from quillstone.llm.packing import pack_in_order

    pieces = pack_in_order(docs).toPandas()
    texts = dict(enumerate(corpus()))
    ids = {d: np.array([*ids_of(tokenizer, t), 1], "<u4") for d, t in texts.items()}
    assert set(pieces.doc_id) == set(ids)
    for doc, mine in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for p in mine.itertuples():
            assert p.start == at and zlib.crc32(ids[doc][at : at + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[doc])
            at += p.length
        assert at == len(ids[doc])
    order = []
    for sequence, mine in pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert mine.offset.tolist() == (mine.length.cumsum() - mine.length).tolist() and mine.length.sum() <= 2048
        order += mine.doc_id.tolist()
    assert order == sorted(order)
    assert pack_in_order(empty).count() == 0


def test_window_cuts_are_best():
    from quillstone.llm.packing import window_cuts

    rng = np.random.default_rng(1)
    for _ in range(30):
        gaps = rng.integers(1, 9, 12)
        at, cost = np.concatenate([[0], np.cumsum(gaps)]), rng.integers(0, 5, 13)
        best = {0: 0}
        for j in range(1, 13):
            best[j] = min(best[i] + 10 - (at[j] - at[i]) + cost[j] for i in range(j) if at[j] - at[i] <= 10)
        cuts = window_cuts(at, cost, 10)
        place = {p: i for i, p in enumerate(at.tolist())}
        total = sum(10 - (b - a) + cost[place[b]] for a, b in zip(cuts, cuts[1:]))
        assert cuts[0] == 0 and cuts[-1] == at[-1] and total == best[12]


def test_best_fit_packing(docs, empty, tokenizer):
    from quillstone.llm.packing import best_fit_decreasing, pack_best_fit

    texts = dict(enumerate(corpus()))
    parts = {d: {} for d in texts}
    for r in pack_best_fit(docs).collect():
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 2048 and r.cu_seqlens[-1] == r.n_tokens
        for a, b, d, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts):
            parts[d][s] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    for d, t in texts.items():
        assert [x for s in sorted(parts[d]) for x in parts[d][s]] == [*ids_of(tokenizer, t), 1]
    assert pack_best_fit(empty).count() == 0
    lengths = np.random.default_rng(2).integers(1, 100, 200)
    where, _ = best_fit_decreasing(lengths, 100)
    free: list[int] = []
    want = {}
    for k in np.argsort(-lengths, kind="stable"):
        fits = [c for c in free if c >= lengths[k]]
        want[k] = min(fits) if fits else None
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 100) - lengths[k])
    assert len(set(where)) == sum(v is None for v in want.values())


def test_near_duplicates(docs, empty):
    from quillstone.llm.neardup import near_duplicates

    sets = {}
    for i, t in enumerate(corpus()):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for block in (512, 3):
        got = near_duplicates(docs, block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("more", [{}, {"wide": 8}])
def test_near_duplicates_of_frequent_passages(spark, more):
    from quillstone.llm.neardup import near_duplicates

    # each of 300 places has one of two frequent passages; a text's copy has passages of its own at 38 places
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2, (800, 300))
    y = x.copy()
    for k, row in enumerate(y):
        row[rng.choice(300, 38, replace=False)] = k + 2
    slots = np.stack([x, y], 1).reshape(1600, 300)
    texts = [" ".join(f"s{s} a b c w{w}" for s, w in enumerate(row)) for row in slots.tolist()]
    # every shingle holds one place's choice: five for a place, one for the last
    weight = np.r_[np.full(299, 5.0), 1]
    both = sum(((slots == c) * weight) @ (slots == c).T for c in (0, 1))
    i, j = np.nonzero(np.triu(both / (2 * weight.sum() - both) >= 0.75, 1))
    assert i.tolist() == list(range(0, 1600, 2)) and (j == i + 1).all()
    got = near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4), **more).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k - k % 2 for k in range(1600)}


def test_near_duplicate_joins_in_open_buckets():
    from quillstone.llm.neardup import REGISTERS, joining

    rng = np.random.default_rng(9)
    pivot, x, z = (rng.integers(0, 2**16, REGISTERS).astype(np.uint16) for _ in range(3))
    y = np.where(np.arange(REGISTERS) < 100, x, z)
    assert joining(np.arange(4), np.array([0, 1, 2, 3]), np.stack([pivot, x, z, y])) == [(1, 3)]
    assert joining(np.arange(4), np.array([0, 1, 2, 1]), np.stack([pivot, x, z, y])) == []


def test_near_duplicate_estimate():
    from quillstone.llm.neardup import estimate, registers

    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a = np.unique(np.concatenate([common, rng.integers(0, 2**63, 500).astype(np.uint64)]) * np.uint64(2))
    b = np.unique(np.concatenate([common, rng.integers(0, 2**63, 500).astype(np.uint64)]) * np.uint64(2))
    assert abs(estimate(registers(a), registers(b)) - 0.75) < 0.16 and estimate(registers(a), registers(a)) > 0.999


def test_components(spark):
    from quillstone.llm.components import components

    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (9, 7), (5, 5)] + [(1000, 1000 + i) for i in range(1, 60)]
    for part_links in (500_000, 20, 3):
        got = dict(components(spark.createDataFrame(chain, "a long, b long").repartition(9), part_links).collect())
        assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 7: 3, 9: 3, **{1000 + i: 1000 for i in range(60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_substrings(texts):
    seen, out = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        grams = [b[p : p + 50] for p in range(len(b) - 49)]
        for p, g in enumerate(grams):
            if g in seen:
                cover[p : p + 50] = True
        seen.update(grams)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum()) if len(b) else 0
        out[i] = (len(b), int(cover.sum()), spans, kept)
    return out


def test_substrings(docs, empty, spark):
    from quillstone.llm.substrings import dedup_substrings

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_substrings(docs).collect()}
    assert got == brute_substrings(enumerate(corpus()))
    assert dedup_substrings(empty).count() == 0
    unnamed = spark.createDataFrame([(None, "x" * 80), (1, "x" * 80), (2, "y" + "x" * 80)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in dedup_substrings(unnamed).collect()}
    assert got == {None: 0, 1: 0, 2: 80}


def substrings_kept(texts, parts=3, blocks=4):
    """Kept bytes of texts, by the operator's steps in one process."""
    import pandas as pd

    from quillstone.llm import substrings

    raw = [t.encode() for t in texts]
    dealt = {b: [i for i in range(len(raw)) if i % blocks == b] for b in range(blocks)}

    def held():
        return {b: substrings.Block(np.array(i), [raw[k] for k in i], parts) for b, i in dealt.items()}

    def decided(sent, decide):
        sent = pd.concat(sent)
        return pd.concat([decide(group) for _, group in sent.groupby("part")])

    first = decided([x.send_cells(b) for b, x in held().items()], substrings.decide_cells)
    second = []
    for b, x in held().items():
        x.hear(first[first["block"] == b])
        second.append(x.send_strings(b))
    answers, out = pd.concat([first, decided(second, substrings.decide_strings)]), {}
    for b, x in held().items():
        mine = answers[answers["block"] == b]
        x.hear(mine)
        for i, gone in zip(dealt[b], x.removed(mine, [raw[k] for k in dealt[b]])):
            out[i] = np.frombuffer(raw[i], np.uint8)[~gone].tobytes()
    return out


#: sizes of segments; with names of few values, buckets and q-grams beside anchors that differ are named alike
@pytest.mark.parametrize("segment, names", [(1 << 20, (5, 65535)), (150, (5, 65535)), (1 << 20, (1, 2))])
def test_substrings_of_hard_texts(monkeypatch, segment, names):
    from quillstone.llm import substrings

    monkeypatch.setattr(substrings, "SEGMENT", segment)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", names[0])
    monkeypatch.setattr(substrings, "BESIDE", names[1])
    rng = random.Random(segment)
    some = lambda n, letters="ab": "".join(rng.choice(letters) for _ in range(n))
    shared = [some(rng.randint(50, 400), "abcdefgh ") for _ in range(6)] + ["a" * 300, "ab" * 200, "abc" * 90, some(37) * 9, some(17) * 20]
    texts = ["", "x" * 49, "x" * 50, "x" * 120]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            t = rng.choice(shared)
            i = rng.randrange(len(t))
            parts += [some(rng.randint(0, 60), "abcdefgh "), t[i : i + rng.randint(40, 300)]]
        texts.append("".join(parts))
    # small alphabets give strings that agree in part only
    base = some(90)
    for _ in range(40):
        k = rng.randrange(90)
        texts.append(base[:k] + rng.choice("cd") + base[k + 1 :])
    want, got = brute_substrings(enumerate(texts)), substrings_kept(texts)
    for i in range(len(texts)):
        assert got[i] == want[i][3], i


def test_substrings_of_runs_with_odd_bytes():
    """Runs of one letter with one other in them, here and there: strings of equal parts in another order."""
    rng = random.Random(7)
    texts = []
    for n, letter in enumerate("abcdefgh-=. #"):
        for k in range(8):
            for place in (3 * k + 2, 49 - 3 * k, rng.randrange(50)):
                own = f"<{len(texts)}"
                texts.append(own + "#" * (8 - len(own)) + letter * place + "j" + letter * (49 - place) + f"{len(texts)}>")
    # periods, and periods with one fault
    for period in ("ab", "abc", "- ", "+---", "0123456789", "lorem ipsum dolo"):
        run = (period * 60)[:130]
        texts += [run, "x" + run, run[1:]] + [run[:k] + "?" + run[k + 1 :] for k in rng.sample(range(130), 12)]
    rng.shuffle(texts)
    want, got = brute_substrings(enumerate(texts)), substrings_kept(texts)
    for i in range(len(texts)):
        assert got[i] == want[i][3], texts[i]


def test_substrings_carry_columns(docs):
    from quillstone.llm.substrings import dedup_substrings

    out = dedup_substrings(docs, carry=tuple(docs.columns), prefix="__", as_text=True)
    texts = dict(enumerate(corpus()))
    for r in out.collect():
        assert r.text == texts[r.doc_id] and r.source == (None if r.doc_id % 3 else "src") and r.part == r.doc_id


def test_fingerprints(docs, empty, spark):
    from quillstone.llm.fingerprint import Fingerprint, fingerprint_edits, paragraphs

    texts = dict(enumerate(corpus()))
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprint_edits(docs).collect()}
    assert set(got) == set(texts)
    for d, after in zip(order, order[1:] + order[:1]):
        t, other = texts[d] or "", texts[after] or ""
        n = len(t)
        edited = t[: n - n // 3] + other[: n // 3]
        assert got[d].n_chars == n and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].fingerprint == Fingerprint(paragraphs(t)).text()
    assert got[6].fingerprint == got[7].fingerprint and got[6].near_edited > 0.4
    assert fingerprint_edits(empty).count() == 0
    assert fingerprint_edits(spark.createDataFrame([(3, "only one")], "doc_id long, text string")).count() == 1
    whole = Fingerprint(["a", "b", "c", "b"])
    parts = Fingerprint(["b", "c"])
    parts.add(["b", "a", "z"])
    parts.remove(["z"])
    assert whole == parts and whole.text() == parts.text() and whole != Fingerprint(["a", "b", "c"])


def test_fingerprint_of_a_much_repeated_word(spark):
    from quillstone.llm.fingerprint import Fingerprint, fingerprint_edits, paragraphs

    word = Fingerprint(paragraphs("word " * 1_000_000))
    n, m = 125_000, 83_333
    assert abs(word.likeness(Fingerprint(paragraphs("word " * 666_664))) - 2 * n * m / (n * n + m * m)) < 1e-9
    rows = fingerprint_edits(spark.createDataFrame([(2, "word " * 1_000_000), (1, "other text")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.near_edited for r in rows}[2] > 0.9


def test_sharding(docs, empty, spark):
    from quillstone.llm.sharding import assign_shards, descend, shard_tree

    texts = dict(enumerate(corpus()))
    got = assign_shards(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "key" and r.grown_shard in (r.shard, 24)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert assign_shards(empty).count() == 0
    many = spark.range(30_000).withColumn("k", F.col("id").cast("string"))
    counts = Counter(r.s for r in descend(many, F.col("k"), *shard_tree(24), "s").collect())
    assert len(counts) == 24 and max(counts.values()) < 1.15 * 1250 and min(counts.values()) > 0.85 * 1250
    moved = descend(descend(many, F.col("k"), *shard_tree(25), "a"), F.col("k"), *shard_tree(26), "b").where("a <> b")
    assert {r.b for r in moved.select("b").distinct().collect()} == {25}


def luhn(number):
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0


def test_pseudonyms(spark, empty):
    from quillstone.llm.pii import pseudonymise

    texts = [
        "pay 4785380592391139 now", "again 4785380592391139.", "not valid 4785380592391138", "call +1 (523) 555-1055 or (212) 555-0199", "from 152.143.123.131 and 300.1.1.1",
        "mail a.b@mail5.example.com, A.B@mail5.example.com", "born 1990-02-28, not 1990-02-31, also 17/03/1985 and 01.12.2001", "ssn 123-45-6789 not 666-45-6789", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "plain text 12 345", "", None,
    ]
    source = spark.createDataFrame([(i, t, "keep", "keep2") for i, t in enumerate(texts)], "doc_id long, text string, __found0 string, __new0 string")
    got = {r.doc_id: r for r in pseudonymise(source, "k", counts="n").collect()}
    out = [got[i].text for i in range(len(texts))]
    assert out[0].split()[1] == out[1].split()[1].rstrip(".") != "4785380592391139" and luhn(out[0].split()[1]) and len(out[0]) == len(texts[0])
    assert out[2] == texts[2] and out[9] == texts[9] and out[10] == "" and out[11] is None
    assert "555-1055" not in out[3] and out[3].startswith("call +1 (") and len(out[3]) == len(texts[3])
    assert "152.143" not in out[4] and out[4].endswith("300.1.1.1")
    assert "mail5" not in out[5] and len(set(out[5][5:].split(", "))) == 1
    assert "1990-02-28" not in out[6] and "1990-02-31" in out[6] and "17/03/1985" not in out[6] and "01.12.2001" not in out[6]
    assert "123-45-6789" not in out[7] and "666-45-6789" in out[7] and "24be" not in out[8] and len(out[8]) == len(texts[8])
    assert got[3].n == 2 and got[6].n == 3 and got[9].n == 0 and got[0]["__found0"] == "keep"
    other = pseudonymise(source, "another").where("doc_id = 0").first().text
    assert other != out[0] and pseudonymise(empty, "k").count() == 0


def test_feistel_is_a_permutation(spark):
    from quillstone.llm.pii import feistel, permuted_date, permuted_digits, permuted_social

    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert numbers.select(permuted_digits(F.col("d"), "k", F.lit("t")).alias("p")).distinct().count() == 1000
    pairs = spark.range(27 * 50).select(*feistel(F.expr("id div 50"), F.col("id") % 50, F.lit(27), F.lit(50), "k", F.lit("t")))
    assert pairs.distinct().count() == 27 * 50
    days = spark.range(5000).select(F.date_add(F.lit("1890-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("d")).select(permuted_date(F.col("d"), "k").alias("p"))
    assert days.distinct().count() == 5000 and days.where("try_to_date(p) is null").count() == 0
    social = spark.range(900).select(F.concat(F.lpad((F.col("id") % 898 + 1).cast("string"), 3, "0"), F.lit("450001")).alias("d")).where("d not like '666%'").distinct()
    got = social.select(permuted_social(F.col("d"), "k").alias("p"))
    assert got.distinct().count() == social.count() and got.where("p rlike '^(000|666|9)' or p rlike '^...00' or p rlike '0000$'").count() == 0


def test_quality(spark, data, empty):
    from quillstone.llm.quality import Machine, features, fit, quality_scores

    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    more = docs.unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string"), allowMissingColumns=True)
    got = quality_scores(more, labels).toPandas().set_index("doc_id")
    assert len(got) == more.count() and got.score.between(0, 1).all() and got.score[10**6] == got.score[10**6 + 1]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())
    known = labels.toPandas().set_index("doc_id").quality
    assert ((got.score[known.index] >= 0.5).astype(int) == known).mean() > 0.9
    assert fit(docs, labels.where("doc_id < 0")).score("x") == 0.5
    assert quality_scores(empty, labels).count() == 0
    some = [features(f"w{i} t. " * (1 + i % 5)) for i in range(40)]
    machine = Machine(np.stack([x[0] for x in some]), [x[1] for x in some], np.arange(40) % 2.0)
    index, value = machine.row(*features("some words here"))
    slow = machine.bias + machine.w[index] @ value + sum(machine.v[index[i]] @ machine.v[index[j]] * value[i] * value[j] for i in range(len(index)) for j in range(i))
    assert abs(1 / (1 + np.exp(-slow)) - machine.score("some words here")) < 1e-9


def test_embeddings(spark):
    from quillstone.llm.embeddings import near_embeddings

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 16))
    x = np.concatenate([rng.normal(size=(200, 16)), centres.repeat(25, 0) + 0.07 * rng.normal(size=(200, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(1000, x[5].tolist(), 1), (1001, None, 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] * 16, 1), (1004, [None] * 16, 1), (1005, [1.0], 1)]
    source = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    valid = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v, _ in rows if i <= 1000}
    links = {i: [j for j in valid if j != i and valid[i] @ valid[j] >= 0.95] for i in valid}
    found = {r.vec_id: r for r in near_embeddings(source).collect()}
    assert len(found) == len(rows) and all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in range(1001, 1006))
    assert all(found[i].n_links <= len(links[i]) for i in valid)
    assert sum(found[i].n_links for i in valid) >= 0.95 * sum(map(len, links.values()))
    assert found[1000].n_links >= 1 and found[1000].component_id == found[5].component_id and found[1000].kept == (found[1000].component_id == 1000)
    assert near_embeddings(source.where("vec_id > 1000")).count() == 5 and near_embeddings(source.where("vec_id < 0")).count() == 0


def test_embeddings_with_few_links(spark):
    import pandas as pd

    from quillstone.llm.embeddings import WIDEST, Index, calibrated, near_embeddings, unit

    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # 1 % of the vectors have a link, at a cosine of 0.95 to 0.97
    for k in range(20):
        side = rng.normal(size=64)
        side -= side @ x[2 * k] * x[2 * k]
        cosine = rng.uniform(0.951, 0.97)
        x[2 * k + 1] = cosine * x[2 * k] + (1 - cosine**2) ** 0.5 * side / np.linalg.norm(side)
    source = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4).cache()
    found = {r.vec_id: r.n_links for r in near_embeddings(source).collect()}
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    assert sum(found.values()) >= 0.9 * 2 * len(i) and all(found[k] == 0 for k in set(range(4000)) - {*i, *j})
    # probes whose few links all lie in their own cells say nothing of the others
    reps = source.withColumnRenamed("vec_id", "rep")
    probes = pd.DataFrame({"rep": range(40, 52), "embedding": list(x[40:52])})
    twins = reps.unionByName(spark.createDataFrame([(10_000 + i, x[i].tolist()) for i in range(40, 45)], "rep long, embedding array<double>"))
    assert calibrated(Index(unit(pd.Series(list(x))), 6), twins, probes) >= WIDEST / 8


def test_pipeline(spark, data, docs):
    import corpus_pipeline
    from quillstone.llm.neardup import near_duplicates
    from quillstone.llm.quality import THRESHOLD, fit, score

    start = spark.read.parquet(f"{data}/documents.parquet").limit(120).cache()
    now, kept = start, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, data)
        assert out.columns == start.columns and out.dtypes == start.dtypes, name
        now = out.cache()
        kept.append({r.doc_id: r for r in now.collect()})
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = {r.doc_id for r in score(start, fit(start, labels)).where(F.col("score") >= THRESHOLD).collect()}
    assert set(kept[0]) == good
    assert set(kept[1]) == {r.doc_id for r in near_duplicates(start.where(F.col("doc_id").isin(sorted(good)))).where("kept").collect()}
    want = brute_substrings(sorted((i, r.text) for i, r in kept[1].items()))
    assert {i: r.text for i, r in kept[2].items()} == {i: b.decode("utf-8", "ignore") for i, (_, _, _, b) in want.items()}
    assert set(kept[3]) == set(kept[2])
    packed = corpus_pipeline.packing(spark, now, data).toPandas()
    assert set(packed.doc_id) == set(kept[3])


ODD = "doc_id long, text string, lang string, source string, n_chars long, __score double, __kept string, __n_removed int"
BIG = 2**53 + 1


def odd_texts():
    rng = random.Random(21)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    same, twice, long = text(60), text(40), text(3000)
    return [
        (BIG, text(30)), (BIG + 1, text(31) + " pay 4785380592391139"), (None, text(50)), (None, same), (BIG + 2, same), (3, same), (7, twice), (7, twice), (8, "one text " + text(20)), (8, "another " + text(25)),
        (None, None), (None, ""), (9, None), (10, ""), (-4, text(12)), (BIG + 9, long), (BIG + 11, long + " end"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", BIG + k if k % 2 else None, 0.5, "x", k) for k, (i, t) in enumerate(odd_texts())]
    return spark.createDataFrame(rows, ODD).coalesce(1).cache()


def counted(rows):
    return Counter(r.doc_id for r in rows)


def test_odd_ids_keep_their_digits(odd, tokenizer):
    from quillstone.llm.bpe import digest_documents
    from quillstone.llm.packing import pack_best_fit, pack_in_order
    from quillstone.llm.pii import pseudonymise
    from quillstone.llm.quality import Machine, score
    from quillstone.llm.sharding import assign_shards

    want = Counter(i for i, _ in odd_texts())
    tokens = Counter()
    for i, t in odd_texts():
        tokens[i] += len(ids_of(tokenizer, t)) + 1
    got = digest_documents(odd).collect()
    digest = lambda t: hashlib.sha256(np.array(ids_of(tokenizer, t), "<u4").tobytes()).hexdigest()
    assert Counter((r.doc_id, r.ids_sha256) for r in got) == Counter((i, digest(t)) for i, t in odd_texts())
    packed, best = Counter(), Counter()
    for r in pack_in_order(odd).collect():
        packed[r.doc_id] += r.length
    for r in pack_best_fit(odd).collect():
        for i, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:]):
            best[i] += b - a
    assert packed == tokens and best == tokens
    assert counted(pseudonymise(odd, "k").collect()) == want and counted(assign_shards(odd).collect()) == want
    stats = np.random.default_rng(1).normal(size=(4, 14))
    scored = score(odd, Machine(stats, [np.arange(3)] * 4, np.array([0.0, 1, 0, 1])), name="s").collect()
    assert counted(scored) == want and {r.n_chars for r in scored} == {None, *(BIG + k for k in range(1, 17, 2))} and scored[0]["__kept"] == "x"


def test_odd_ids_in_quality(spark, odd):
    from quillstone.llm.quality import quality_scores

    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(odd_texts())] + [(7, 1), (7, None)], "doc_id long, quality int")
    got = quality_scores(odd, labels).collect()
    assert counted(got) == Counter(i for i, _ in odd_texts())
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    again = quality_scores(odd.repartition(5), labels.repartition(3)).collect()
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == Counter((r.doc_id, round(r.score, 9)) for r in again)


def test_odd_ids_in_comparisons(odd):
    from quillstone.llm.fingerprint import Fingerprint, fingerprint_edits, paragraphs
    from quillstone.llm.neardup import near_duplicates
    from quillstone.llm.substrings import dedup_substrings

    want = Counter(i for i, _ in odd_texts())
    near = near_duplicates(odd).collect()
    assert counted(near) == want and all(r.component_id is None and r.kept for r in near if r.doc_id is None)
    component = {r.doc_id: r.component_id for r in near}
    assert component[BIG + 2] == 3 and component[BIG + 11] == component[BIG + 9] == BIG + 9 and component[BIG + 1] == BIG + 1 and component[7] == 7
    removed = dedup_substrings(odd, carry=("doc_id", "n_chars", "__kept")).collect()
    assert counted(removed) == want and {r.n_chars for r in removed} == {None, *(BIG + k for k in range(1, 17, 2))}
    gone = {r.doc_id: r.n_removed for r in removed if r.doc_id is not None}
    assert gone[BIG + 2] == len(odd_texts()[4][1]) and gone[3] == gone[7] == gone[BIG] == 0 and all(r.n_removed == 0 for r in removed if r.doc_id is None)
    prints = fingerprint_edits(odd).collect()
    assert counted(prints) == want
    alone = [r for r in prints if r.doc_id is None]
    assert all(r.edited_sha256 is None and r.near_next is None for r in alone)
    assert Counter(r.fingerprint for r in alone) == Counter(Fingerprint(paragraphs(t or "")).text() for i, t in odd_texts() if i is None)


def test_pipeline_of_odd_rows(spark, odd, tmp_path, data):
    import corpus_pipeline

    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{data}/labels.parquet").where("doc_id < 0").write.parquet(str(tmp_path / "labels.parquet"))
    # no labels: every score is one half, so that every document stays in the first stage
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got, want = {r.doc_id for r in out}, {i for i, _ in odd_texts()}
    assert got == want - {BIG + 2, BIG + 11}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == odd.columns and now.dtypes == odd.dtypes
        now = now.cache()
        assert Counter(r.doc_id for r in now.collect())[None] == 4
    none = odd.where("doc_id = 12345")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_embeddings_of_every_length(spark):
    from quillstone.llm.embeddings import near_embeddings

    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=3).tolist()) for k in range(40)] + [(BIG, [1.0, 2.0]), (BIG + 1, [2.0, 4.01]), (BIG + 2, [-1.0, 2.0]), (None, [1.0, 2.0]), (70, [5.0]), (71, [0.5]), (72, [-3.0]), (80, [1.0, 2.0]), (80, [1.0, 2.001]), (90, []), (91, None)]
    got = near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(r.vec_id for r in got) == Counter(i for i, _ in rows)
    found = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert found[BIG] == (3, 80) and found[BIG + 1] == (3, 80) and found[BIG + 2][0] == 0 and found[None][0] == 0
    assert found[70] == found[71] == (1, 70) and found[72] == (0, 72) and found[90] == (0, 90)
    x = {k: np.array(v) / np.linalg.norm(v) for k, v in rows[:40]}
    assert all(found[k][0] == sum(j != k and x[j] @ x[k] >= 0.95 for j in x) for k in x)


def test_shards_by_hand(docs):
    import math

    import xxhash

    from quillstone.llm.sharding import SEED, assign_shards, shard_tree

    def place(doc, tree, leaves):
        at = ""
        for _ in range(3):
            draws = []
            for name, weight in tree[at]:
                h = 42
                for part in (str(doc), SEED, name):
                    h = xxhash.xxh64_intdigest(part.encode(), h)
                draws.append((-math.log(((h >> 12) + 0.5) / 2**52) / weight, name))
            at = min(draws)[1]
        return leaves[at]

    base, grown = shard_tree(24), shard_tree(25)
    for r in assign_shards(docs).collect():
        assert r.shard == place(r.doc_id, *base) and r.grown_shard == place(r.doc_id, *grown)


def test_likeness_by_hand(docs):
    from quillstone.llm.fingerprint import fingerprint_edits

    def parts(text):
        return Counter(" ".join(w[k : k + 8]) for line in text.split("\n") for w in [line.split()] for k in range(0, len(w), 8))

    def signs(text):
        digest = lambda p: np.frombuffer(hashlib.blake2b(p.encode(), digest_size=64).digest()[:32], np.uint8)
        return sum((n * (2.0 * np.unpackbits(digest(p)) - 1) for p, n in parts(text).items()), np.zeros(256))

    def near(a, b):
        if parts(a) == parts(b):
            return 1.0
        return float(np.clip(2 * signs(a) @ signs(b) / max(1.0, signs(a) @ signs(a) + signs(b) @ signs(b)), 0, 1))

    texts = dict(enumerate(t or "" for t in corpus()))
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    for r in fingerprint_edits(docs).collect():
        own, other = texts[r.doc_id], texts[after[r.doc_id]]
        edited = own[: len(own) - len(own) // 3] + other[: len(own) // 3]
        assert abs(r.near_next - near(own, other)) < 1e-9 and abs(r.near_edited - near(own, edited)) < 1e-9, r.doc_id


def test_pseudonyms_by_hand(spark):
    from quillstone.llm.pii import FIRST_DAY, ROUNDS, pseudonymise

    def feistel(left, right, a, b, tweak):
        for i in range(1, ROUNDS + 1):
            f = int(hashlib.sha256("|".join(map(str, ("k", tweak, a, b, i, right))).encode()).hexdigest()[:15], 16)
            left, right, a, b = right, (left + f % a) % a, b, a
        return left, right

    def card(number):
        body = number[:-1]
        n = len(body)
        x, y = feistel(int(body[: n // 2]), int(body[n // 2 :]), 10 ** (n // 2), 10 ** (n - n // 2), f"card|{n}")
        out = str(x).zfill(n // 2) + str(y).zfill(n - n // 2)
        return next(out + c for c in "0123456789" if luhn(out + c))

    def date(iso):
        import datetime

        first = datetime.date.fromisoformat(FIRST_DAY)
        k = (datetime.date.fromisoformat(iso) - first).days
        x, y = feistel(k // 5411, k % 5411, 27, 5411, "date")
        return (first + datetime.timedelta(x * 5411 + y)).isoformat()

    cards, dates = ["4785380592391139", "6011000990139424", "378282246310005"], ["1990-02-28", "2031-12-31", "1700-01-01"]
    x, y = feistel(152 * 256 + 143, 123 * 256 + 131, 65536, 65536, "address")
    text = " ; ".join([*cards, *dates, "152.143.123.131"])
    got = pseudonymise(spark.createDataFrame([(text,)], "text string"), "k").first().text.split(" ; ")
    assert got == [*map(card, cards), *map(date, dates), f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"]


def test_pseudonyms_of_any_length(spark):
    from quillstone.llm.pii import pseudonymise

    texts = ['token = "' + "a1" * 150 + '"', "password: 'pw'", "mail " + "x" * 400 + "@" + "y" * 70 + ".example.org now", "nothing to see, it's fine", 'api_key="']
    out = [r.text for r in pseudonymise(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1), "k").orderBy("doc_id").collect()]
    assert "a1a1a1" not in out[0] and len(out[0]) == len(texts[0]) and "'pw'" not in out[1] and len(out[1]) == len(texts[1])
    assert "xxx" not in out[2] and "yyy" not in out[2] and out[2].endswith(" now") and out[3:] == texts[3:]


def test_slash_dates_stay_apart(spark):
    from quillstone.llm.pii import permuted_date

    days = [f"{d:02}/{m:02}/{y}" for y in (1996, 2004) for m in range(1, 13) for d in range(1, 29)] + [f"{m:02}/{d:02}/{y}" for y in (1996, 2004) for m in range(1, 13) for d in range(13, 29)]
    days = sorted(set(days))
    rows = spark.createDataFrame([(d,) for d in days], "d string").select("d", permuted_date(F.col("d"), "k").alias("p")).collect()
    assert len({r.p for r in rows}) == len(days)
    day_first = lambda x: int(x[3:5]) <= 12
    assert all(day_first(r.d) == day_first(r.p) for r in rows)


def test_secrets_with_any_blanks(spark):
    from quillstone.llm.pii import pseudonymise

    texts = [f'{name}{" " * a}{sign}{gap * b}"hidden{a}x{b}"' for name, sign, gap in (("token", "=", " "), ("API_key", ":", "\t"), ("password", "=", "\n")) for a in (0, 1, 4, 50) for b in (0, 3, 4, 2000)]
    texts += ["write to jürgen@bücher.example or info@müller.de today", "password: hunter2x", "on 03/05/1690", "IBAN DE02 1203"]
    rows = pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k", counts="n").orderBy("doc_id").collect()
    for r, t in zip(rows[:-4], texts):
        assert "hidden" not in r.text and r.n == 1 and len(r.text) == len(t) and r.text.split('"')[0] == t.split('"')[0]
    assert rows[-4].n == 2 and "ü" not in rows[-4].text
    # as the docstring says, these stay
    assert [r.text for r in rows[-3:]] == texts[-3:]


def test_the_public_key_is_for_local_sessions():
    from types import SimpleNamespace

    from quillstone.llm.pii import PUBLIC_KEY, session_key

    session = lambda master, key: SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: key or default), sparkContext=SimpleNamespace(master=master))
    assert session_key(session("local[4]", None)) == PUBLIC_KEY and session_key(session("yarn", "own")) == "own"
    with pytest.raises(ValueError):
        session_key(session("spark://host:7077", None))
