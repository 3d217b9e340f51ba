"""The pipeline's stages and its whole run against a plain Python version, and the parts of operators 5 and 6 that it rests on."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from driftcloud.llm import common, packing, target_quality

WORD = re.compile("[^\x20\x09-\x0d]+")
BLANKS = " \t\n\x0b\x0c\r"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The documents' own columns, and some whose names the stages use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, _row string, _gone int, _doc string, row int, kept string, _kept int, h1 long, _w int, _group string, sequence_id string"
CLASH = ("en", None, 3, 777, "r", 5, "d", 9, "k", 1, 2, 3, "g", "s")


def table(spark, rows):
    """rows: doc_id, text, source."""
    return spark.createDataFrame([(i, t, CLASH[0], s, *CLASH[2:]) for i, t, s in rows], SCHEMA)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}{'é' * (k % 3 == 0)}" for k in range(24)]
    some = lambda n, v=vocabulary: " ".join(rng.choice(v) for _ in range(n))
    common, passage = [some(6) for _ in range(4)], some(60)
    rows = []
    for i in range(90):
        lines = [some(rng.randint(8, 30)) for _ in range(rng.randint(2, 6))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(common))
        if i % 9 == 0:
            lines.append(passage)
        rows.append((i, "\n".join(lines), f"site{rng.randint(0, 6)}"))
    for i in range(40):  # near copies
        w = rng.choice(rows[:90])[1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w), f"site{i % 5}"))
    rows += [(i, " ".join(["junk", "$$$", "|"] * 40), "site1") for i in (200, 201)]
    rows += [(3, some(80), "site3"), (3, rows[3][1], "site2"), (5, rows[5][1], rows[5][2]), (None, some(90), None), (None, rows[7][1], "site1"), (None, None, None), (300, None, "site2"), (301, "", None), (302, " \n\t", "site1")]
    rows += [((1 << 60) + k, some(60), "site9") for k in range(3)] + [(400, some(9000), "site8")]
    return rows


def labels_of(spark, rows):
    ids = sorted({i for i, _, _ in rows if i is not None})
    made = [(i, int(i % 7 != 3), int(i % 20 == 5)) for i in ids if not 200 <= i < 300]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int"), {i for i, q, t in made if q and not t}


# ---- plain versions


def cells_of(text, buckets):
    w = [x.encode() for x in WORD.findall(text or "")]
    one = [xxhash.xxh64_intdigest(x, 42) for x in w]
    return [h % buckets for h in one] + [xxhash.xxh64_intdigest(b, a) % buckets for a, b in zip(one, w[1:])]


def plain_quality(rows, good, buckets=target_quality.BUCKETS):
    """(n_words, n_repeat_words, base_failed, llr, kept) of each row."""
    raw, target = Counter(), Counter()
    for i, t, _ in rows:
        raw.update(cells_of(t, buckets))
        if i in good:
            target.update(cells_of(t, buckets))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = lambda c: round(math.log((target[c] + 1) / (n_target + buckets)) - math.log((raw[c] + 1) / (n_raw + buckets)), 5) if n_target else 0.0
    out = []
    for _, t, _ in rows:
        w, cells = WORD.findall(t or ""), cells_of(t, buckets)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = Counter(windows)
        repeated = len({k + j for k, x in enumerate(windows) if times[x] > 1 for j in range(3)})
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        llr = sum(map(ratio, cells)) / len(cells) if cells else 0.0
        out.append((len(w), repeated, failed, llr, not failed and llr >= target_quality.THRESHOLD))
    return out


def plain_line_dedup(rows):
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            if line := line.strip(BLANKS):
                sites[line] |= {s} - {None}
                first[line] = min([x for x in (first.get(line), i) if x is not None], default=None)
    spread = {x for x, s in sites.items() if len(s) >= (2 if len(x.split()) > 50 else 3)}
    out = []
    for i, t, s in rows:
        lines = t.split("\n") if t is not None else []
        left = [x for x in lines if not ((b := x.strip(BLANKS)) in spread and i != first[b])]
        n, m = sum(bool(x.strip(BLANKS)) for x in lines), sum(bool(x.strip(BLANKS)) for x in left)
        if n == m or m:
            out.append((i, "\n".join(left) if t is not None else None, s))
    return out


def plain_near_dedup(rows, words=5):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    group = list(range(len(rows)))
    find = lambda k: k if group[k] == k else find(group[k])
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                group[find(a)] = find(b)
    best = {}
    for k, (i, _, _) in enumerate(rows):
        key = (i is None, i or 0)
        if find(k) not in best or key < best[find(k)][0]:
            best[find(k)] = (key, [k])
        elif key == best[find(k)][0]:
            best[find(k)][1].append(k)
    return [{rows[k] for k in ks} for _, ks in best.values()]  # of equal ids either may stay


def plain_pieces(rows, capacity=4096):
    library, out = Tokenizer.from_file(TOKENIZER), []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((i, piece, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    return Counter(out)


def check_packed(out, pieces, capacity=4096, slack=2):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= capacity
    assert len(bins) <= -(-sum(r.length for r in out) // capacity) + slack


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


# ---- tests


def test_quality_ratio_equals_brute_force(spark):
    rows = [r for seed in (1, 2) for r in corpus(seed)]
    labels, good = labels_of(spark, rows)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, doc_id long, text string, source string").repartition(5)
    for buckets in (64, target_quality.BUCKETS):
        out = sorted(target_quality.score_quality(df, labels, buckets=buckets).collect(), key=lambda r: r.k)
        want = plain_quality(rows, good, buckets)
        assert len(out) == len(want) >= 290
        for r, (n, repeated, failed, llr, kept) in zip(out, want):
            assert (r.n_words, r.n_repeat_words, r.base_failed) == (n, repeated, failed) and r.llr == pytest.approx(llr, abs=2e-9)
            assert r.kept == kept or abs(llr - target_quality.THRESHOLD) < 2e-9
    assert target_quality.score_quality(df.limit(0), labels).count() == 0


def test_packing_keeps_ids_as_they_are(spark):
    """Nulls beside ids that no float can hold, all in one group."""
    rows = [((1 << 60) + 1, "one"), (None, "two three"), (2, None), ((1 << 60) + 1, "one"), ((1 << 60) + 2, "x " * 5000), (None, ""), (-((1 << 62) + 1), "y")]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_group": F.lit("g"), "length": F.lit(1), "offset": F.lit("o")}), TOKENIZER).collect()
    check_packed(out, plain_pieces(rows))
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def run_stages(spark, docs, folder):
    found = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, found[-1], folder)
        out.write.parquet(f"{folder}/stage{k}")
        found.append(spark.read.parquet(f"{folder}/stage{k}"))
        if k < 3:
            assert found[-1].schema.simpleString() == docs.schema.simpleString(), name
    return found[1:]


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus(3)
    labels, good = labels_of(spark, rows)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, rows).repartition(4)
    quality, lines, near, packed = run_stages(spark, docs, str(tmp_path))
    assert rows_of(quality) == Counter(r for r, q in zip(rows, plain_quality(rows, good)) if q[-1])
    assert 100 < quality.count() < len(rows)
    after = list(rows_of(quality).elements())
    assert rows_of(lines) == Counter(plain_line_dedup(after)) != rows_of(quality)
    kept, groups = rows_of(near), plain_near_dedup(list(rows_of(lines).elements()))
    assert sum(kept.values()) == len(groups) < lines.count()
    for g in groups:
        assert sum(kept[r] for r in g) >= 1
    check_packed(packed.collect(), plain_pieces([(i, t) for i, t, _ in kept.elements()]))
    for r in near.drop("doc_id", "text", "source").distinct().collect():  # the other columns, whatever they are called
        assert tuple(r) == tuple(x for k, x in enumerate(CLASH) if k != 1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    same = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert same(whole) == same(packed)


def test_stages_of_nothing(spark, tmp_path):
    labels_of(spark, [])[0].write.parquet(f"{tmp_path}/labels.parquet")
    for out in run_stages(spark, table(spark, []), str(tmp_path)):
        assert out.count() == 0


@pytest.mark.parametrize("early", [False, True])
def test_workers_give_arrow_memory_back(monkeypatch, early):
    """After a task's last batch, also where its rows are not all asked for: workers are kept from stage to stage."""
    released = []

    class Frame:
        def mapInArrow(self, fn, schema):
            return fn

    class Pool:
        def release_unused(self):
            released.append(len(seen))

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["a"]) for n in (5, 0, 2)]
    seen = []
    run = common.map_batches(Frame(), lambda parts: (p for p in parts), "a long", rows=2)(iter(batches))
    for part in run:
        seen.append(part.num_rows)
        if early:
            break
    run.close()
    assert (seen, released) == (([2], [1]) if early else ([2, 2, 1, 2], [4]))
