"""Each operator against a brute-force version, a round trip or a hand-made case, with nulls, empty and long texts, ties and clashing columns."""

import base64
import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftcloud.llm import ctw, html_density, line_spread, minhash, ogg, packing, target_quality, token_cache, viterbi, warc, wavelet

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [
    None, "", "  \n", "one", "The cat sat on the mat and the cat sat on the mat again", "ÉCOLE  école\tfin\r\n\nÀ <|endoftext|> z",
    " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i}" for i in range(59)) + " other", "x" * 5000 + " y", " ".join(f"w{i % 977}" for i in range(12000)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{i % 4}", 0) for i, t in enumerate(TEXTS)] + [(3, "one", "en", "src1", 0), (None, "null id", None, None, None)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({"kept": F.lit(1), "n_words": F.lit("x"), "n": F.lit(2), "rep": F.lit(0), "line": F.lit("l"), "h1": F.lit(1)})
    clash.cache()
    return clash


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokens_equal_the_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        texts = [t or "" for t in TEXTS] + ["a  b\n c", "\n\nx", "don't it's", "Σας İx", "é té", "tail \n", "m² km² x³ CO₂ H₂O", "½cup Ⅳa ①② ªº", "漢字 한국 ꟋA", "a" * 90 + "² " + "b" * 90]
        ids, bounds = token_cache.BatchEncoder(public_tokenizers.path(name)).encode(pa.array(texts))
        for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids


def test_ogg(spark, docs):
    out = by_id(ogg.read_media(ogg.write_media(docs)))
    assert len(out) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (out[i].n_bytes, out[i].payload_bytes) == (len(raw), len(payload))
        assert out[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and out[i].tail_crc32 == zlib.crc32(payload[-64:])
    assert out[6].media_sha256 == out[7].media_sha256
    assert ogg.read_media(ogg.write_media(empty(spark))).count() == 0


def test_ogg_damage_and_checksum():
    file = bytearray(ogg.encode_payload(bytes(range(256)) * 700, 5))
    streams, damaged = ogg.read_ogg(bytes(file))
    assert len(streams) == 2 and not damaged and ogg.decode_media(bytes(file)).payload == bytes(range(256)) * 700
    crc = 0
    for b in b"123456789":  # bit by bit
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
    assert ogg.page_checksum(b"123456789") == crc
    file[len(file) // 2] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.read_ogg(bytes(file))
    assert ogg.read_ogg(bytes(file), strict=False)[1] == 1


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    ids = sorted(sets)
    comp = {i: i for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * (n := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - n)]
    while any(comp[a] != comp[b] for a, b in links):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return sets, comp


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(3)
    base = [f"t{x}" for x in rng.integers(0, 500, 120)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for k in range(40):
        w = list(base)
        for at in rng.integers(0, 120, k // 4):
            w[at] = f"n{rng.integers(0, 9)}"
        rows.append((100 + k, " ".join(w)))
    out = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)), 4, 80))
    sets, comp = brute_components(rows, 4, 80)
    for i in sets:
        assert (out[i].n_shingles, out[i].component_id, out[i].kept) == (len(sets[i]), comp[i], comp[i] == i)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert by_id(minhash.near_duplicates(docs))[None].component_id is None


@pytest.mark.parametrize("shares, group_rows", [(minhash.SHARES, minhash.GROUP_ROWS), (7, 16)])
def test_near_duplicates_in_a_hot_bucket(spark, monkeypatch, shares, group_rows):
    """500 texts of which any two are at a similarity around the threshold, and copies of one and of blank texts; hubs and shingles whole and split."""
    monkeypatch.setattr(minhash, "SHARES", shares)
    monkeypatch.setattr(minhash, "GROUP_ROWS", group_rows)
    rng = np.random.default_rng(5)
    base = [f"t{x}" for x in range(120)]
    rows = []
    for k, choice in enumerate(rng.permutation(6**4)[:500]):
        w = list(base)
        for at in range(4):
            w[20 + 25 * at] = f"n{at}_{choice // 6**at % 6}" + (f"x{k}" if k % 3 == 0 and at < 2 else "")
        if k % 7 == 0:
            w[5] = w[110] = f"own{k}"
        rows.append((int(3 * k + 1), " ".join(w)))
    rows += [(5000 + k, rows[9][1]) for k in range(60)] + [(6000 + k, " \t") for k in range(30)]
    sets, comp = brute_components(rows, 4, 80)
    assert 1 < len({comp[i] for i, _ in rows[:500]}) < 400
    out = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 80))
    assert {i: out[i].component_id for i in comp} == comp and {i: out[i].n_shingles for i in sets} == {i: len(x) for i, x in sets.items()}


def test_near_duplicates_of_repeated_ids(spark):
    """Rows with an equal id and other texts are other documents; of equal texts the row with the smallest id stays, an id before none."""
    a, b, c = (" ".join(f"{t}{i}" for i in range(40)) for t in "abc")
    rows = [(1, a), (1, b), (2, c), (None, b), (7, a), (7, a), (None, c + " more"), (None, None), (9, ""), (None, "lone words of no other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("r"), "_doc": F.lit(1), "n": F.lit(0)})
    out = minhash.near_duplicates(docs, 4, 80).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == sorted([(1, 1, True), (1, 1, True), (2, 2, True), (0, 1, False), (7, 1, False), (7, 1, False), (0, 2, False), (0, 0, True), (9, 9, True), (0, 0, True)])
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, a), (1, b), (2, c), (0, ""), (9, ""), (0, "lone words of no other")])
    assert minhash.keep_one_of_each(docs.limit(0)).count() == 0


def test_viterbi(spark, docs):
    model = viterbi.Viterbi(public_tokenizers.path("piece_bpe_32k.model"))

    def brute(t):
        best = {0: (0.0, -1, ())}
        for s in range(len(t)):
            for e in range(s + 1, min(len(t), s + model.longest) + 1):
                f = model.pieces.get(t[s:e])
                if f and (e not in best or best[s][0] + f[1] > best[e][0]):
                    best[e] = (best[s][0] + f[1], s, (f[0],))
            if t[s] not in model.pieces and (s + 1 not in best or best[s][0] + model.uncovered > best[s + 1][0]):
                best[s + 1] = (best[s][0] + model.uncovered, s, tuple(model.bytes[b] for b in t[s].encode()))
        out, e = [], len(t)
        while e > 0:
            out.append(best[e][2])
            e = best[e][1]
        return [i for x in reversed(out) for i in x]

    for t in ["hello world", "  two  blanks ", "漢字 😀 thé", TEXTS[4], "x" * 300, "line\nend"]:
        normal = viterbi.SPACE + t.replace(" ", viterbi.SPACE)
        ids = np.frombuffer(model.encode(t), "<u4")
        assert ids.tolist() == brute(normal) == [i for some in model.stream(iter(normal)) for i in some] and model.decode(ids) == t
    out = by_id(viterbi.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))
    assert all(r.round_trip for r in out.values()) and out[0].n_ids == 0
    for i, t in enumerate(TEXTS):
        ids = np.array(brute(viterbi.SPACE + t.replace(" ", viterbi.SPACE)) if t else [], "<u4")
        assert (out[i].n_ids, out[i].ids_crc32, out[i].n_bytes) == (len(ids), zlib.crc32(ids.tobytes()), len((t or "").encode()))
    assert viterbi.encode_and_decode(docs.where("doc_id = 3").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).count() == 2
    assert viterbi.encode_and_decode(empty(spark), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_viterbi_parts_equal_the_whole_search():
    model, rng = viterbi.Viterbi(public_tokenizers.path("piece_bpe_32k.model")), np.random.default_rng(4)
    for size in (5, 60, 900):
        for _ in range(300):
            text = "".join(rng.choice(list("abthe.,;\r\n² ▁Zé”'1_(x漢")) for _ in range(size))
            whole = [i for some in model.stream(viterbi.SPACE + text.replace(" ", viterbi.SPACE)) for i in some]
            ids = np.frombuffer(model.encode(text), "<u4")
            assert ids.tolist() == whole and model.decode(ids) == text.replace(viterbi.SPACE, " ")


def test_viterbi_window_stays_small():
    """Characters come from a generator without any blank; what is held doesn't follow their number."""
    model, rng = viterbi.Viterbi(public_tokenizers.path("piece_bpe_32k.model")), np.random.default_rng(1)

    def chars(n):
        for k in rng.integers(0, 30, n).tolist():
            yield "abcdefghijklmnopqrstuvwxyz漢😀é1"[k]

    most = {}
    for n in (2_000, 60_000):
        tracemalloc.start()
        assert sum(1 for _ in model.stream(chars(n))) > n // 100
        most[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert most[60_000] < 2 * most[2_000] + 1_500_000  # the generator's own numbers are 8 bytes each


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use</div>
<article><h1>Head &amp; line</h1><p>First  para\nof <b>text</b>.<p>Second &copy; one<br>more</p><script>var t="</p>";</script></article>
<div class="comments"><p>Reader says</p></div><aside>Side</aside><form><label>Mail</label></form><footer>Foot</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>Only a body of some text here"), (1, "u", PAGE)], "page_id long, url string, html string")
    out = html_density.extract_main_text(pages).collect()
    want = "Head & line First para of text. Second © one more"
    assert [(r.page_id, r.text) for r in out] == [(1, want), (2, ""), (3, ""), (4, "Only a body of some text here"), (1, want)]
    assert out[0].n_chars == len(want)
    assert np.allclose(html_density.smoothed(np.ones(5)), 1)


LONG = "A long paragraph of the text itself with many words and no markup between them. " * 4
TEASER = "<article class=card><h3>Next</h3><p>Another story that is told elsewhere on this site.</p></article>"


@pytest.mark.parametrize(
    "html, want, never",
    [
        (f"<body><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>{TEASER}</body>", ["Title", LONG.strip()], ["Another"]),
        (f"<body><div><h1>Title</h1><p>By me</p><p>Now</p><p>{LONG}</p><p>{LONG}</p><ul><li>a</li><li>b</li><li>last</li></ul></div></body>", ["Title", "By me", "last"], []),
        (f'<body><div class="page has-sidebar"><h1>Title</h1><p>{LONG}</p><div class="sidebar"><p>Side</p></div></div></body>', ["Title", LONG.strip()], ["Side"]),
        (f'<body><div class="with-sidebar"><article class="post no-comments"><p>{LONG}</p><div class="ad">Buy</div></article></div></body>', [LONG.strip()], ["Buy"]),
        (f'<body><article><p>{LONG}</p></article><div id="comments"><article class="comment"><p>Reader {LONG}{LONG}</p></article></div></body>', [LONG.strip()], ["Reader"]),
        ('<body><nav>Menu</nav><div class="wrap sidebar-left"><p>' + LONG + "</p><p>End</p></div></body>", [LONG.strip(), "End"], ["Menu"]),
    ],
)
def test_main_text_of_other_layouts(html, want, never):
    text = html_density.main_text(html)
    assert all(w in text for w in want) and not any(n in text for n in never)


def test_packing(spark, docs):
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue  # two rows
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = out[out.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length[:-1] == 4096).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and (g.offset == g.length.cumsum() - g.length).all()
    bins, _ = packing.best_two_fit([6, 5, 4, 3, 2], 10)
    assert len(set(bins)) == 2
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 4097, 3000).tolist()
    bins, offsets = packing.best_two_fit(lengths, 4096)
    assert len(set(bins)) <= 1.02 * max(sum(lengths) / 4096, sum(n > 2048 for n in lengths)) + 1
    assert packing.pack_documents(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    out = by_id(target_quality.score_quality(docs, labels))
    assert set(docs.columns) - {"kept", "n_words"} < set(out[4].asDict())
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            covered |= {k, k + 1, k + 2} if times[x] > 1 else set()
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(out[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert out[i].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert out[6].kept and not out[0].kept
    assert target_quality.score_quality(docs, labels.limit(0)).where("llr <> 0").count() == 0


def test_quality_ratio_by_hand(spark):
    import xxhash

    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    table = target_quality.ratio_table(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), buckets=64)
    h = lambda x: (lambda v: v - (1 << 64) if v >> 63 else v)(xxhash.xxh64(x.encode(), seed=42).intdigest())
    raw, target = Counter(h(x) % 64 for x in "abc"), Counter(h(x) % 64 for x in "ab")
    for cell in {h("c") % 64} - {h("a") % 64, h("b") % 64}:
        extra = table[cell] - math.log((target[cell] + 1) / (2 + 1 + 64)) + math.log((raw[cell] + 1) / (3 + 1 + 64))
        assert abs(extra) < 0.7  # the word pair's cell may be the same


def test_warc(spark):
    big = "<p>" + "é" * 50_000
    pages = spark.createDataFrame([(5, "u\n1", "same"), (2, "u", "same"), (9, None, None), (7, "u", ""), (8, "u", big), (None, "u", "same")], "page_id long, url string, html string")
    out = by_id(warc.read_archives(warc.write_archives(pages)), "page_id")
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert {k: (r.record_type, r.refers_to) for k, r in out.items()} == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 7), 7: ("response", None), 8: ("response", None), None: ("revisit", 2)}
    assert out[8].payload_digest == digest(big) and out[8].payload_bytes == len(big.encode()) and out[5].payload_digest == digest("same")
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    clash = pages.withColumns({"sha1": F.lit("s"), "record": F.lit(1), "first_id": F.lit(1), "payload": F.lit("p")}).unionByName(pages.where("page_id = 2").withColumns({"sha1": F.lit("s"), "record": F.lit(1), "first_id": F.lit(1), "payload": F.lit("p")}))
    rows = warc.read_archives(warc.write_archives(clash)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == sorted([(5, "revisit", 2), (2, "response", 0), (2, "response", 0), (9, "revisit", 7), (7, "response", 0), (8, "response", 0), (0, "revisit", 2)])
    # payloads of at least so many bytes only
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, least_bytes=5)).collect()} == {"response"}
    only = spark.createDataFrame([(None, "u", "x"), (None, "v", "x")], "page_id long, url string, html string")
    assert [r.record_type for r in warc.read_archives(warc.write_archives(only)).collect()] == ["response"] * 2


def test_warc_reads_chunks_in_any_order(spark):
    texts = ["", "x", "é" * 3000, "long " * 1_000_000, "tail"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("url", F.lit("u"))
    written = warc.write_archives(pages, chunk_bytes=1000)
    want = [(i, len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), "response", None) for i, t in enumerate(texts)]
    for chunks in (written, written.repartition(5, "chunk_no"), written.coalesce(1).orderBy("chunk_no", "record"), written.coalesce(1).orderBy("record", F.desc("chunk_no"))):
        assert sorted(map(tuple, warc.read_archives(chunks).collect())) == want
    last = written.agg(F.max("record")).first()[0]
    lost = written.where(~((F.col("record") == last) & (F.col("chunk_no") == 1)))
    with pytest.raises(Exception, match="cut short|out of order"):
        warc.read_archives(lost).collect()


def test_warc_running_digests(spark):
    text = "abc" * 50_000
    rows = sorted(warc.write_archives(spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string"), chunk_bytes=1000).collect(), key=lambda r: r.chunk_no)
    payload = b"".join(bytes(r.data) for r in rows[1:-1])
    assert payload == text.encode() and max(len(r.data) for r in rows[1:-1]) == 1000
    for k, r in enumerate(rows[1:-1], 1):
        assert bytes(r.digest) == hashlib.sha1(payload[: 1000 * k]).digest()
    for broken in (rows[:5] + rows[6:], [*rows[:5], rows[6], rows[5], *rows[7:]]):
        reader = warc.RecordReader()
        with pytest.raises(ValueError):
            for r in broken:
                reader.feed(bytes(r.data), bytes(r.digest))


def normal(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def brute_ctw(train, texts, depth=ctw.DEPTH):
    """log10 probabilities of the texts by the recursion of context-tree weighting, node by node; every context of train and texts is a node."""
    counts = {}
    for t, weight in [(t, 1) for t in train] + [(t, 0) for t in texts]:
        padded = b"\n" * depth + t
        for i in range(depth, len(padded)):
            for k in range(8):
                for d in range(depth + 1):
                    node = counts.setdefault((padded[i - d : i], (256 | padded[i]) >> (k + 1)), [0, 0])
                    node[padded[i] >> k & 1] += weight
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, inner = {}, Counter()
    for context, node in sorted(counts, key=lambda c: -len(c[0])):
        own = kt(*counts[context, node])
        weighted[context, node] = own if len(context) == depth else math.log(0.5) + np.logaddexp(own, inner[context, node])
        if context:
            inner[context[1:], node] += weighted[context, node]

    def mixed(context, node, bit):  # context: all depth bytes
        p = 0.0
        for d in range(depth, -1, -1):
            c = context[depth - d :]
            n = counts[c, node]
            weight = 1.0 if d == depth else math.exp(math.log(0.5) + kt(*n) - weighted[c, node])
            p = weight * (n[bit] + 0.5) / (sum(n) + 1) + (1 - weight) * p
        return p

    out = []
    for t in texts:
        padded = b"\n" * depth + t
        out.append(sum(math.log10(mixed(padded[i - depth : i], (256 | padded[i]) >> (k + 1), padded[i] >> k & 1)) for i in range(depth, len(padded)) for k in range(8)))
    return out


@pytest.fixture(scope="module")
def scored_rows(spark, docs):
    more = [(i, f"rare{i} qz{i * i} vwx {'the cat' * (i % 3)}") for i in range(20, 60)] + [(70, "The cat sat"), (71, "the CAT sat"), (72, "the cat sat"), (73, "the cat sat")]
    rows = docs.where("doc_id is null or doc_id <> 3").select("doc_id", "text", "kept").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("kept", F.lit(1)))
    rows = rows.unionByName(rows.where("doc_id = 4"))
    return rows, [(r.doc_id, r.text or "") for r in rows.collect()]


def test_ctw(spark, scored_rows):
    df, rows = scored_rows
    out = ctw.score_documents(df.repartition(3)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    train = [t for i, t in rows if not held(i)]
    counts = Counter(w for t in train for w in [*t.encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    want = dict(zip(texts, brute_ctw([normal(t) for t in train], [normal(t) for t in texts.values()])))
    assert len(out) == len(rows) and sorted(map(str, (r.doc_id for r in out))) == sorted(str(i) for i, _ in rows)
    assert sum(r.held_out for r in out) > 1
    for r in out:
        tokens = [*texts[r.doc_id].encode().lower().split(), b""]
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel=1e-12)
        assert (r.n_tokens, r.train_tokens, r.n_known, r.held_out) == (len(tokens), n, sum(counts[w] > 0 for w in tokens), held(r.doc_id))
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-8)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / len(normal(texts[r.doc_id])), rel=1e-12)
    for same in ({70, 71, 72, 73}, {6, 7}):
        assert len({(r.score, r.base_score) for r in out if r.doc_id in same}) == 1


def test_ctw_of_slices_blocks_and_salts(spark, scored_rows, monkeypatch):
    """Small slices, blocks, salts and portions give the same scores."""
    df, rows = scored_rows
    whole = {(r.doc_id, r.n_tokens): r for r in ctw.score_documents(df).collect()}
    for name, value in (("SLICE_BYTES", 600), ("BLOCK_BYTES", 900), ("BLOCKS_A_SALT", 3), ("MIXED_AT_ONCE", 5)):
        monkeypatch.setattr(ctw, name, value)
    out = ctw.score_documents(df).collect()
    assert len(out) == len(rows)
    for r in out:
        w = whole[r.doc_id, r.n_tokens]
        assert (r.n_known, r.train_tokens, r.held_out) == (w.n_known, w.train_tokens, w.held_out)
        assert r.score == pytest.approx(w.score, rel=1e-11) and r.base_score == pytest.approx(w.base_score, rel=1e-12)


def test_ctw_reads_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(ctw, "SLICE_BYTES", 50)
    for text in [*(t or "" for t in TEXTS), " a " * 40 + "x" * 300, "y" * 200 + " " * 200]:
        reader, words = ctw.Reader(), []
        for some in ctw._read(reader, 0, text):
            words += some
        assert words == text.encode().lower().split()
        grams, of, first = reader.grams()
        whole = b"\n" * ctw.DEPTH + normal(text)
        assert bytes((grams & 255).astype(np.uint8)) == normal(text) and len(first) == len(of)
        assert all(g == sum(whole[i + ctw.DEPTH - k] << 8 * (ctw.DEPTH + 1 - k) for k in range(1, ctw.DEPTH + 1)) | whole[i + ctw.DEPTH] for i, g in enumerate(grams.tolist()))


def test_ctw_without_rows_or_training(spark):
    assert ctw.score_documents(empty(spark)).count() == 0
    out = ctw.score_documents(spark.createDataFrame([(2, "Some words"), (2, None)], "doc_id long, text string").where("crc32(cast(doc_id as string)) % 5 = 1")).collect()
    assert zlib.crc32(b"2") % 5 != 1 or len(out) == 2
    lone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = ctw.score_documents(spark.createDataFrame([(lone, "Some words")], "doc_id long, text string")).collect()
    assert r.held_out and (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == pytest.approx(-len("some words\n") * 8 * math.log10(2)) and r.base_score == 0


def test_wavelet(spark, docs):
    out = wavelet.read_shards(wavelet.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=3000)).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = out.sort_values("start", ignore_index=True)
    assert (out.start == out.n_tokens.cumsum() - out.n_tokens).all()
    assert out.doc_id.isna()[0] and out.doc_id[1:].is_monotonic_increasing
    for i, t in enumerate(TEXTS):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (out[out.doc_id == i].ids_crc32 == zlib.crc32(ids.tobytes())).all()
    assert wavelet.read_shards(wavelet.write_shards(empty(spark), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("top", [1, 2, 300, 70_000])
def test_wavelet_queries(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 1500).astype(np.uint32)
    ids[-1] = ids[699] = 0
    doc_ids, last, wm = wavelet.open_shard(wavelet.shard_bytes([None, 7], np.array([700, 800]), ids))
    assert doc_ids == [None, 7] and last.tolist() == [699, 1499]
    for matrix in (wm, wavelet.WaveletMatrix.build(ids)):
        assert (matrix.decode() == ids).all() and (matrix.access(np.arange(1500)) == ids).all()
        for i in (0, 700, 1499):
            c = int(ids[i])
            assert matrix.access(i) == c and matrix.count(c) == (ids == c).sum() and matrix.rank(c, i) == (ids[:i] == c).sum() and matrix.select(c, matrix.rank(c, i)) == i
            assert (matrix.select(c, np.arange(-1, matrix.count(c) + 1)) == [-1, *np.flatnonzero(ids == c), -1]).all()
        assert matrix.select(top + 5, 0) == -1 and matrix.rank(top + 70_000, 9) == 0


def test_wavelet_file_inflates_what_it_needs(monkeypatch):
    ids = np.random.default_rng(0).integers(0, 60_000, 1_500_000).astype(np.uint32)
    ids[-1] = 0
    _, _, wm = wavelet.open_shard(wavelet.shard_bytes([1], np.array([len(ids)]), ids))
    for plane in wm.planes:
        plane.open.clear()
    assert wm.access(1_000_000) == ids[1_000_000]
    assert [len(p.open) for p in wm.planes] == [1] * len(wm.planes) and len(wm.planes[0].frames) == 3


@pytest.mark.parametrize("hot", [1000, 3])
def test_line_spread(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(line_spread, "HOT", hot)  # all lines are split, or the commonest alone
    rows = [(i, f"own {i}\nshared line\n\n{'rare' if i < 2 else 'all of it'}", "en", f"s{i % 5}", 0) for i in range(12)] + [(20, None, None, None, None), (21, "shared line", None, "s9", 0), (None, "shared line\nx", None, "s8", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = line_spread.remove_spread_lines(df).select("doc_id", "text", "n_lines", "n_removed").toPandas()
    db = duckdb.connect()
    db.register("documents", df.toPandas())
    want = db.sql(line_spread.ORACLE).df()
    key = ["doc_id", "text"]
    pd.testing.assert_frame_equal(*(x.sort_values(key, ignore_index=True)[["doc_id", "text", "n_lines", "n_removed"]].astype({"text": object}).fillna("") for x in (want, got)), check_dtype=False)
    assert 21 not in by_id(line_spread.clean_documents(df)) and 20 in by_id(line_spread.clean_documents(df))
    assert line_spread.remove_spread_lines(empty(spark)).count() == 0


def test_pipeline_removes_long_lines_of_two_sites(spark):
    import corpus_pipeline

    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    two, one, short, three = words("a", 51), words("b", 51), words("c", 50), words("d", 5)
    rows = [(i, f"own {i}\n" + "\n".join(x), "en", s, 0) for i, (s, x) in enumerate([("s0", [two, one, short, three]), ("s1", [f"  {two}\t", short, three]), ("s0", [one, two]), ("s2", [three])])]
    out = by_id(corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), ""))
    assert {i: r.text.split("\n") for i, r in out.items()} == {0: ["own 0", two, one, short, three], 1: ["own 1", short], 2: ["own 2", one], 3: ["own 3"]}


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline
    from driftcloud.llm.common import stored

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:2]:
        before = docs.count()
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < docs.count() <= before
