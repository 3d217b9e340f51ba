"""Operators 11 to 13 against brute force: every repair, every window and every period is tried."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftcloud.llm import conversation_repair as repair, periodic_runs, substring_sketch
from driftcloud.llm.words import BatchWords, RangeHashes, sliding

sha = lambda t: hashlib.sha256(t.encode() if isinstance(t, str) else t).hexdigest()
SCHEMA = "doc_id long, text string, kept string, rid long, n_words int, starts string"


def documents(spark, rows):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "k", 7, 1, "s") for i, t in rows], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def test_batch_words_and_hashes():
    texts = [b"", b" a\x0bb\tc ", "é x é x".encode(), b"\n", b"a"]
    w = BatchWords(texts)
    assert w.bounds.tolist() == [0, 0, 3, 5, 5, 6] and w.codes[3] == w.codes[4] and w.codes[0] == w.codes[5]
    assert BatchWords([]).bounds.tolist() == [0] and len(BatchWords([b""]).hashes()) == 0
    h = np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64)
    r = RangeHashes(np.concatenate([h, h]), 0x9E3779B97F4A7C15)
    assert r.of(np.array([3]), np.array([40])) == r.of(np.array([53]), np.array([90])) and (r.of_length(7)[:44] == r.of_length(7)[50:94]).all()
    for width in range(1, 12):
        assert sliding(np.minimum, h, width).tolist() == [min(h[i : i + width]) for i in range(len(h) - width + 1)]


# ---- 11


def brute_runs(c):
    n, out = len(c), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and c[j] == c[j + q]:
                j += 1
            s = c[i : j + q]
            if j > i and len(s) >= max(24, 3 * q) and all(s[p:] != s[:-p] for p in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_text(rng, most):
    out = []
    for _ in range(rng.randint(0, most)):
        if rng.random() < 0.4:
            out += [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randint(0, 60))]
        else:
            p = [rng.randrange(rng.choice([1, 2, 40])) for _ in range(rng.randint(1, 40))]
            out += (p * 12)[: rng.randint(1, min(200, 12 * len(p)))]
    return out


def test_cover_meets_every_difference():
    assert {(a - b) % periodic_runs.MODULUS for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(periodic_runs.MODULUS))


def test_runs_equal_brute_force(monkeypatch):
    for seed in range(120):
        rng = random.Random(seed)
        texts = [periodic_text(rng, 5) for _ in range(rng.randint(1, 8))]
        monkeypatch.setattr(periodic_runs, "PAIRS", rng.choice([50, 1 << 22]))
        got = periodic_runs.periodic_runs(np.array([x for t in texts for x in t], np.int32), np.array([len(t) for t in texts]))
        for k, t in enumerate(texts):
            assert [tuple(r) for r in got[got[:, 0] == k][:, 1:].tolist()] == brute_runs(t)


def test_extensions_equal_brute_force():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 2, 300), np.tile(rng.integers(0, 3, 13), 40), np.zeros(200, int)]
    symbols, text = [], []
    for k, t in enumerate(texts):
        symbols += [*t, 100 + k]
        text += [k] * (len(t) + 1)
    e = periodic_runs.Extensions(np.array(symbols, np.int32), np.array(text))
    first = 0
    for t in texts:
        i = first + rng.integers(0, len(t) - 1, 400)
        j = i + 1 + rng.integers(0, first + len(t) - 1 - i)
        for a, b, n in zip(i, j, e.of(i, j)):
            want = 0
            while symbols[a + want] == symbols[b + want]:
                want += 1
            assert n == want
        first += len(t) + 1


def brute_periodic_row(doc_id, text):
    w = words_of(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query(spark):
    rng = random.Random(5)
    rows = [(i, " \t".join(f"w{x}é" for x in periodic_text(rng, 4))) for i in range(150)]
    rows += [(None, "a b " * 30), (1000, None), (1001, ""), (1002, " \n\x0b"), (1003, "x " * 9000), (3, rows[3][1]), (3, rows[3][1]), (1005, "  a " * 20), (-7, "n o " * 40)]
    out = periodic_runs.find_runs(documents(spark, rows).repartition(4)).collect()
    small = [r for r in rows if r[0] != 1003]
    assert Counter(tuple(r) for r in out if r.doc_id != 1003) == Counter(brute_periodic_row(*r) for r in small)
    (long,) = [r for r in out if r.doc_id == 1003]
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli, long.collapsed_sha256) == (1, 0, 9000, 1, 9_000_000, sha("x"))
    assert sum(r.n_runs > 0 for r in out) > 20
    assert periodic_runs.find_runs(documents(spark, [])).count() == 0


# ---- 12


def every_repair(rows):
    """The least (cost, edits, turns) of all repairs that insert at most three turns at a place."""
    found = []

    def go(i, state, cost, edits, turns, inserted):
        if cost > 3 * len(rows):
            return
        if i == len(rows) and (not turns or state == "a"):
            found.append((cost, edits, turns))
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        full = {"u": "user", "a": "assistant"}
        if inserted < 3:
            for f in fits.strip("s"):
                go(i, f, cost + 2, edits + "I", (*turns, f"{full[f]}:"), inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, state, cost + 3, edits + "D", turns, 0)
            if fault in (0, 3):
                more = int(fault == 3)
                if role and role[0] in fits:
                    go(i + 1, role[0], cost + more, edits + "K", (*turns, f"{role}:{text}"), 0)
                for f in fits.strip("s"):
                    go(i + 1, f, cost + 2 + more, edits + "R", (*turns, f"{full[f]}:{text}"), 0)

    go(0, "", 0, "", (), 0)
    cost, edits, turns = min(found)
    return cost, edits, sha("\n".join(turns))


ROLES = ["system", "user", "assistant", "user", "assistant", " ", "tool", ""]


def searched(rows):
    r = repair.Repair()
    for row in rows:
        r.row(*row)
    return r.finish()


def test_repair_equals_every_repair():
    rng = random.Random(1)
    for _ in range(700):
        rows = [(rng.choice(ROLES), str(i), rng.choice([0, 0, 0, 1, 2, 3])) for i in range(rng.randint(0, 5))]
        assert searched(rows) == every_repair(rows), rows


def test_repair_commits_early_and_counts_its_nodes():
    rng, r = random.Random(2), repair.Repair()
    for i in range(30_000):
        r.row(rng.choice(ROLES), str(i), rng.choice([0, 0, 0, 1, 2, 3]))
        if i % 1000 == 0:  # the tree as it hangs together from the survivors
            seen = set()
            for _, node in r.survivors.values():
                while node is not r.root and node not in seen:
                    seen.add(node)
                    node = node.parent
            assert len(seen) == r.unresolved
    assert len(r.edits) > 29_000 and r.most_unresolved < 200
    same = repair.Repair()
    for i in range(3000):  # nothing but turns to delete
        same.row("user", "", repair.BLANK)
    assert same.most_unresolved < 20 and same.finish()[:2] == (9000, "D" * 3000)


def brute_conversation(conv_id, rows):
    shown = lambda x: " " if x is None else str(x)
    after = []
    for turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv_id)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        after += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in after:
        last = text.encode().rstrip(b" \t\n\x0b\x0c\r")[-1:]
        faults.append(1 if not last else 2 if (role, text) in seen else 0 if last in b".!?" else 3)
        seen.add((role, text))
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
    cost, audit, digest = every_repair([(r, t, f) for (_, r, t), f in zip(after, faults)]) if len(after) <= 6 else searched([(r, t, f) for (_, r, t), f in zip(after, faults)])
    return (conv_id, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest)


def test_conversation_query(spark):
    rng = random.Random(4)
    conversations = {c: [(t + rng.randint(0, 1) * 3, rng.choice(["system", "user", "assistant", None, "tool"]), rng.choice(["Yes.", "No? ", "and\n", None, "", "Hm!\t", f"line {t}"])) for t in range(rng.randint(1, 5))] for c in range(120)}
    conversations[None] = [(0, "user", "Hi."), (None, "user", "first.")]
    conversations[500] = [(None, None, None)]
    conversations[501] = [(2, "user", "Twice."), (2, "user", "Twice."), (2, "assistant", "x")]
    conversations[502] = [(i, "user", "w" * 20000 + ".") for i in range(300)]
    rows = [(c, t, r, x, "clash", 5) for c, all_rows in conversations.items() for t, r, x in all_rows]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string, copy int").repartition(5)
    out = {r.conv_id: tuple(r) for r in repair.repair_conversations(df).collect()}
    assert len(out) == len(conversations)
    for c, all_rows in conversations.items():
        assert out[c] == brute_conversation(c, all_rows), c
    dropped = [(c, 0) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    gone = repair.repair_conversations(spark.createDataFrame([(c, t, "user", "x.") for c, t in dropped], "conv_id long, turn long, role string, text string")).collect()
    assert sorted(tuple(r) for r in gone) == sorted((c, 0, 0, 0, 0, 0, 0, "", sha("")) for c, _ in dropped)
    assert repair.repair_conversations(df.limit(0)).count() == 0


# ---- 13


def brute_repeats(rows, window):
    texts = [words_of(t) for _, t in rows]
    n = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        gone = {k for i in range(len(w) - window + 1) if n[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((doc_id, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return Counter(out)


@pytest.mark.parametrize("window, width, cells", [(5, None, 1 << 16), (12, 1 << 16, 1 << 16), (35, None, 1 << 16), (35, 512, 256)])
def test_repeats_equal_brute_force(spark, monkeypatch, window, width, cells):
    """Also with a sketch so small that nearly all windows are overestimated."""
    monkeypatch.setattr(substring_sketch, "CHUNK", cells)
    rng = random.Random(window)
    some = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    passages = [some(60, 1000) for _ in range(5)]
    texts = [None, "", " \n", "a b"] + [some(rng.randint(0, 300), rng.choice([3, 30, 3000])) for _ in range(60)]
    texts += [f"{some(50, 900)}\n\t{rng.choice(passages)} {some(50, 900)}" for _ in range(40)] + ["x " * 500, "y  z  " * 100] + [texts[20]] * 3
    for _ in range(40):  # near copies
        t = rng.choice(texts[4:]).split()
        if t:
            t[rng.randrange(len(t))] = "other"
        texts.append(" ".join(t))
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[6]), (None, "é " * 80)]
    out = substring_sketch.remove_repeated_passages(documents(spark, rows).repartition(6), window, width)
    assert Counter(tuple(r) for r in out.collect()) == brute_repeats(rows, window)
    assert substring_sketch.remove_repeated_passages(documents(spark, []), window).count() == 0


def test_sketch_overestimates(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(200)) for _ in range(30)] * 2
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    width = 1 << 18
    hot = substring_sketch.hot_cells(df, 10, width)
    w = substring_sketch._Windows(BatchWords([t.encode() for t in texts]), 10)
    _, least = w.anchors()
    assert substring_sketch._estimated_twice(least[w.valid], hot, width).all()  # each text is there twice
    alone = substring_sketch._Windows(BatchWords([" ".join(f"other{i}" for i in range(5000)).encode()]), 10)
    assert substring_sketch._estimated_twice(alone.anchors()[1], hot, width).mean() < 0.05
    parts = substring_sketch.partition_sketches(df, 10, width)
    assert parts.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").count() > 0
    assert pa.array(hot).nbytes == 2 * width // 8


# ---- the statements


def in_duckdb(sql, **tables):
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return Counter(tuple(sorted(zip(names, row))) for row in out.fetchall())


def in_spark(df):
    return Counter(tuple(sorted(r.asDict().items())) for r in df.collect())


def test_statements(spark):
    rng = random.Random(11)
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(ROLES + [None]), rng.choice(["Yes.", "No? ", "", None, "Hm!\t", "é", "x."])) for c in [*range(60), None] for _ in range(rng.randint(1, 9))]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert in_spark(repair.repair_conversations(talks)) == in_duckdb(repair.ORACLE, conversations=talks)
    texts = [" ".join(f"w{rng.randrange(v)}" for _ in range(rng.randint(0, 150))) for v in [2, 3, 400] * 8]
    docs = documents(spark, list(enumerate(texts + texts[:4] + [texts[5] + "\n" + texts[2], None, " "])))
    assert in_spark(substring_sketch.remove_repeated_passages(docs)) == in_duckdb(substring_sketch.ORACLE, documents=docs)
