"""Operator 2: near duplicates by one-permutation MinHash with optimal densification.

A document's word shingles are hashed once; the hash's place in its range names a bin and each bin keeps its smallest hash.
Empty bins copy a full bin that a shared sequence of random probes finds (optimal densification).  Signatures are cut into
bands; a band's value is a bucket.  Documents with the same shingle set form a class first, and only one of each class
goes on.  A bucket's candidate edges form a star around its smallest member, so their number is linear in its size; every
edge is confirmed on full sets.  With 64 bands of 6 bins, a pair at similarity 0.8 shares no bucket with a chance of 4e-9.

A star alone can lose a link between two members that are both far from the hub.  So the stars whose members did not all
become one component are looked at again, in two steps.  Members that have too few shingles in common with all the rest to be
similar to any are settled.  Then each such star gets a second hub, the member that shares most of its shingles.  What is
still apart is joined exactly on rare shingles (prefixes of the sets in order of frequency, with positions): of two similar
sets each has one of the other's rarest shingles among its own rarest.  Components are carried from step to step.

Shingles are identified by 64-bit hashes and whole sets by 128 bits.  Rows are told apart by a number of their own, not by
doc_id.  Defined results: a null or blank text has an empty set and is linked with nothing; a text shorter than a shingle is
one shingle; equal texts are linked; rows with an equal doc_id but different texts are different nodes, and each row
carries the smallest doc_id of its component; a null doc_id takes part, and its component_id is null where no member has an
id; an empty table gives no rows; extra columns are ignored by ``near_duplicates`` and returned by ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, map_batches, stored, text_or_empty

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
BINS, ROWS = 384, 6
#: Words of 64 bits in the bitmap of rows whose texts are needed (8 million bits): what is broadcast has so many rows at most.
BITMAP_WORDS = 1 << 17
#: A hub's pairs beyond one of so many shares of all pairs are dealt to further tasks; a shingle's rows beyond GROUP_ROWS likewise.
SHARES, GROUP_ROWS = 1000, 512
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTOR = _U(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of the texts, and the bounds of each text's words."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    space = _IS_SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = starts[order], sizes[order]
    hashes = np.zeros(len(order), _U)
    longer = len(order) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), side="right")
    for k, n in enumerate(longer.tolist()):  # words of more than k bytes stand first
        hashes[:n] = hashes[:n] * _FACTOR + _BYTE[data[begin[:n] + k]]
    out = np.empty_like(hashes)
    out[order] = _mix(hashes + sizes.astype(_U))
    return out, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    hashes, bounds = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(max(0, n - words + 1), _U)
    for k in range(words):
        rolled = _mix(rolled + hashes[k : k + len(rolled)] * _U(2 * k + 3) + _U(k))
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            s = np.sort(rolled[a : b - words + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = np.zeros(1, _U)
            for k in range(b - a):
                h = _mix(h * _FACTOR + hashes[a + k] + _U(1000 + b - a))
            sets.append(h)
        else:
            sets.append(np.zeros(0, _U))
    return sets


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` minima per set (sets not empty)."""
    out, full = np.zeros((len(sets), bins), _U), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = ((s >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
        first = np.concatenate([[True], at[1:] != at[:-1]])  # sorted by hash, so by bin, smallest first
        out[i, at[first]], full[i, at[first]] = s[first], True
    doc, empty = np.nonzero(~full)
    probe = 0
    while len(doc):
        probe += 1
        target = (_mix(empty.astype(_U) * _U(0xD1342543DE82EF95) + _U(probe)) % _U(bins)).astype(np.int64)
        hit = full[doc, target]
        out[doc[hit], empty[hit]] = out[doc[hit], target[hit]]
        doc, empty = doc[~hit], empty[~hit]
    return out


def buckets(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One value per band; the band's number is part of it."""
    bands = signature.reshape(len(signature), -1, rows)
    value = np.broadcast_to(np.arange(bands.shape[1], dtype=_U) * _FACTOR, bands.shape[:2]).copy()
    for k in range(rows):
        value = _mix(value * _FACTOR + bands[:, :, k])
    return value


def _numbered(docs: DataFrame, **extra: Column) -> DataFrame:
    """The documents stored with a number for each row, so that every later step means the same row by it."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), *[c.alias(n) for n, c in extra.items()]))


def sketch(texts: DataFrame, words: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """row, doc_id, n (set size), k1 and k2 (128 bits for the whole set), buckets (none for sets that can only be linked to equal ones)."""
    least = next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch["text"], words)
            wide = [i for i, s in enumerate(sets) if len(s) >= least]
            lists: list[np.ndarray | list] = [[]] * len(sets)
            if wide:
                for i, row in zip(wide, buckets(signatures([sets[i] for i in wide], bins), rows).astype(np.int64)):
                    lists[i] = row
            k1 = np.array([s.sum(dtype=_U) if len(s) else 0 for s in sets], _U).astype(np.int64)
            k2 = np.array([_mix(s + _U(7)).sum(dtype=_U) if len(s) else 0 for s in sets], _U).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["doc_id"], pa.array([len(s) for s in sets], pa.int32()), pa.array(k1), pa.array(k2), pa.array(lists, pa.list_(pa.int64()))], ["row", "doc_id", "n", "k1", "k2", "buckets"]
            )

    return map_batches(texts.select("row", "doc_id", "text"), run, "row long, doc_id long, n int, k1 long, k2 long, buckets array<long>", rows=1024)


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted rows.  A bitmap of hashed row numbers, whose size is fixed, drops most others before the join deals texts out."""
    place = F.pmod(F.xxhash64("row"), F.lit(64 * BITMAP_WORDS))
    marked = lambda df: df.withColumns({"_word": F.shiftright(place, 6), "_bit": F.expr("shiftleft(1L, cast(pmod(xxhash64(row), 64) as int))")})
    bitmap = marked(wanted.select("row")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    likely = marked(texts.select("row", "text")).join(F.broadcast(bitmap), "_word").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0)
    return likely.select("row", "text").join(wanted, "row", "left_semi")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The (stored) pairs (a, b) of rows whose full sets are similar enough.

    The pairs of a hub ``a`` that has more than a share of all pairs are split into parts, and its text goes to each.  Fewer than
    ``SHARES`` hubs have more than a share, so their list is broadcast, and fewer than twice ``SHARES`` texts are copied.
    """
    share = max(1, -(-pairs.count() // SHARES))
    large = F.broadcast(pairs.groupBy("a").agg(F.ceil(F.count("*") / share).cast("int").alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    hubs = texts.select(F.col("row").alias("a"), F.col("text").alias("ta")).join(large, "a", "left").select("a", "ta", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    both = dealt.join(texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b").join(hubs, ["a", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs, which = np.unique(batch["a"].to_numpy(), return_index=True)  # a hub's pairs stand together
            of_hub = dict(zip(hubs.tolist(), shingle_sets(batch["ta"].take(pa.array(which)), words)))
            keep = []
            for a, q in zip(batch["a"].to_pylist(), shingle_sets(batch["tb"], words)):
                p = of_hub[a]
                merged = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                keep.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both.select("a", "b", "ta", "tb"), run, "a long, b long", rows=1024)


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of the edges (a, b): least neighbours, then a jump along labels."""
    links = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = links.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        of = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = stored(lower.join(of, "component").select("node", "old", F.least("component", "further").alias("component")))
        discard(labels)
        if step.where("old <> component").isEmpty():
            discard(links)
            return step.select("node", "component")
        labels = step


def merge(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components after more edges: only those that the edges touch are worked on."""
    if labels is None:
        return components(edges)
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    joined = components(between)
    moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return stored(moved.unionByName(joined.join(labels, "node", "left_anti").select("node", "component")))


def _component_of(df: DataFrame, labels: DataFrame | None, row: str, name: str) -> DataFrame:
    """``df`` with the component of its column ``row`` as ``name``."""
    if labels is None:
        return df.withColumn(name, F.col(row))
    return df.join(labels.select(F.col("node").alias(row), F.col("component").alias(name)), row, "left").withColumn(name, F.coalesce(name, row))


def _unsettled(stars: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (star, row, component) of the stars that have more than one component."""
    known = _component_of(stars, labels, "row", "component")
    apart = known.groupBy("star").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("star")
    return known.join(apart, "star", "left_semi")


def _shingle_rows(texts: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """row, n and each shingle g of the texts of these rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch["text"], words)
            for at in range(0, len(sets), 256):
                part = sets[at : at + 256]
                sizes = np.array([len(s) for s in part])
                ids = np.repeat(batch["row"].to_numpy()[at : at + 256], sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(sizes, sizes), pa.int32()), pa.array(np.concatenate(part).astype(np.int64))], ["row", "n", "g"])

    return map_batches(texts.join(rows, "row", "left_semi").select("row", "text"), run, "row long, n int, g long")


def _can_be_linked(texts: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """row, n, shared: rows that have enough shingles in common with all the others together to be similar to one of them.

    ``percent`` of the union needs common >= p / (1 + p) * (size + other size), the other size being p * size at least, and
    what a text has in common with any other is at most the number of its shingles that some other of these rows has.
    """
    p = percent / 100
    shingles = _shingle_rows(texts, rows, words)
    common = shingles.groupBy("g").agg(F.count("*").alias("rows")).where("rows > 1").select("g")
    shared = shingles.join(common, "g").groupBy("row").agg(F.first("n").alias("n"), F.count("*").alias("shared"))
    return stored(shared.where(F.col("shared") + 1e-6 >= p * F.col("n")))


def _second_hubs(members: DataFrame, linkable: DataFrame, percent: int) -> DataFrame:
    """Pairs of each star's member that shares most of its shingles with the members of other components."""
    scored = members.join(linkable, "row").withColumn("part", F.col("shared") / F.col("n"))
    hubs = scored.groupBy("star").agg(F.max_by("row", "part").alias("hub"), F.max_by("n", "part").alias("hub_n"), F.max_by("component", "part").alias("hub_component"))
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    return scored.join(hubs, "star").where((F.col("component") != F.col("hub_component")) & fits).select(F.least("hub", "row").alias("a"), F.greatest("hub", "row").alias("b")).distinct()


def _rare_shingle_pairs(texts: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """All pairs of rows of different components that can be similar, by prefixes in order of frequency and positions in them.

    The rows of a frequent shingle are dealt to several tasks, each of which meets all of them.
    """
    p = percent / 100
    rows = members.groupBy("row").agg(F.first("component").alias("component"))
    shingles = _shingle_rows(texts, rows.select("row"), words)
    counts = shingles.groupBy("g").agg(F.count("*").alias("rows"))
    ordered = shingles.join(counts, "g").groupBy("row").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("rows", "g"))).alias("all"))  # one text's own shingles
    prefix = F.slice("all", 1, F.col("n") - F.ceil(p * F.col("n") - 1e-9).cast("int") + 1)
    tokens = ordered.select("row", "n", F.posexplode(prefix).alias("at", "s")).where("s.rows > 1").select("row", "n", (F.col("n") - F.col("at")).alias("rest"), F.col("s.g").alias("g"), F.ceil(F.col("s.rows") / GROUP_ROWS).cast("int").alias("parts"))
    tokens = stored(tokens.join(rows, "row"))
    one_part, every_part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x, y = (tokens.select("g", part.alias("part"), *[F.col(c).alias(c + k) for c in ("row", "n", "rest", "component")]) for k, part in (("x", one_part), ("y", every_part)))
    possible = F.least("restx", "resty") + 1e-6 >= p / (1 + p) * (F.col("nx") + F.col("ny"))
    return x.join(y, ["g", "part"]).where((F.col("rowx") < F.col("rowy")) & (F.col("componentx") != F.col("componenty")) & possible).select(F.col("rowx").alias("a"), F.col("rowy").alias("b")).distinct()


def linked_rows(texts: DataFrame, words: int, percent: int, bins: int, rows: int) -> DataFrame:
    """Every row of the numbered texts: row, doc_id, n, component_id (smallest doc_id of its component) and first (whether it is
    its component's row with the smallest doc_id, of equal ones the first)."""
    sketched = stored(sketch(texts, words, percent, bins, rows))
    classes = stored(sketched.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("row").alias("rep")))
    members = sketched.where("size(buckets) > 0").join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select(F.explode("buckets").alias("bucket"), "row", "n")
    hubs = members.groupBy("bucket").agg(F.min("row").alias("star"), F.min_by("n", "row").alias("star_n"), F.count("*").alias("size")).where("size > 1")
    fits = 100 * F.least("n", "star_n") >= percent * F.greatest("n", "star_n")
    stars = stored(members.join(hubs.drop("size"), "bucket").where("row <> star").select("star", "row", fits.alias("fits")).distinct())
    labels = None
    if not stars.isEmpty():
        wanted = stars.select("row").unionByName(stars.select(F.col("star").alias("row"))).distinct()
        texts = stored(_only(texts, stored(wanted)))

        def add(pairs: DataFrame) -> None:
            nonlocal labels
            found = stored(confirm(stored(pairs), texts, words, percent))
            if not found.isEmpty():
                labels = merge(labels, found)

        add(stars.where("fits").select(F.col("star").alias("a"), F.col("row").alias("b")))
        # the hub has met all its star; left are members of different components that have not met each other
        members = stored(_unsettled(stars.select("star", "row"), labels))
        if not members.isEmpty():
            linkable = _can_be_linked(texts, members.select("row").distinct(), words, percent)
            members = stored(_unsettled(members.select("star", "row").join(linkable.select("row"), "row", "left_semi"), labels))
            if not members.isEmpty():
                add(_second_hubs(members, linkable, percent))
                members = stored(_unsettled(members.select("star", "row"), labels))
                if not members.isEmpty():
                    add(_rare_shingle_pairs(texts, members, words, percent))
        discard(texts)
    named = _component_of(classes, labels, "rep", "component").select("k1", "k2", "n", "component")
    rows = stored(sketched.where("n > 0").select("row", "doc_id", "n", "k1", "k2").join(named, ["k1", "k2", "n"]).select("row", "doc_id", "n", "component"))
    firsts = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"))
    out = rows.join(firsts, "component").select("row", "doc_id", "n", "component_id", (F.col("row") == F.col("least.row")).alias("first"))
    alone = sketched.where("n = 0").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    out = linked_rows(_numbered(docs), words, percent, bins, rows)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """The documents, with their own columns, of which none similar has a smaller doc_id (of equal doc_ids, the first row)."""
    texts = _numbered(docs, _doc=F.struct(*docs.columns))
    kept = linked_rows(texts, words, percent, bins, rows).where("first").select("row")
    return texts.select("row", "_doc").join(kept, "row", "left_semi").select("_doc.*")
