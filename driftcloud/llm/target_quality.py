"""Operator 6 [native]: quality rules with a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into ``buckets`` cells.  Two multinomials over the cells are counted: the raw corpus, from
every document, and the trusted target, from documents labelled good and not toxic (at most ``trusted_docs`` of them, those
with the smallest hashes of their ids: a documented bound of the labelled sample).  A document's score is the mean over
its n-grams of log p_target - log p_raw; it is kept if it passes the base rules and its score reaches ``threshold``.
Only the table of ``buckets`` numbers passes the driver.

Defined results: a null text has no words and fails the base rules; without trusted documents every score is 0; repeated
rows and null ids are scored each on their own; an empty table gives no rows; other columns pass through, but for those
named like a result or a working column, which the result replaces (``keep_good`` keeps all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_or_empty

BUCKETS, TRUSTED_DOCS, SMOOTHING, THRESHOLD = 16_384, 20_000, 1.0, -0.05
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Up to so many repeated windows, membership is tested one by one; beyond, windows are sorted.
FEW_REPEATED = 32


def _with_words(df: DataFrame) -> DataFrame:
    blanked = text_or_empty("text")
    for c in "\t\n\x0b\x0c\r":
        blanked = F.replace(blanked, F.lit(c), F.lit(" "))
    return df.withColumn("_w", F.array_remove(F.split(blanked, " "), "")).withColumn("n_words", F.size("_w").cast("long"))


def _n_grams(buckets: int) -> Column:
    """Cells of a document's words and word pairs, from the column _w."""
    ones = f"transform(_w, x -> cast(pmod(xxhash64(x), {buckets}) as int))"
    twos = f"transform(sequence(0, size(_w) - 2), i -> cast(pmod(xxhash64(_w[i], _w[i + 1]), {buckets}) as int))"
    return F.expr(f"case when size(_w) > 1 then concat({ones}, {twos}) else {ones} end")


def ratio_table(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS, smoothing: float = SMOOTHING) -> list[float]:
    """log p_target - log p_raw of each cell."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_docs).withColumn("_trusted", F.lit(1))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(trusted), "doc_id", "left")
    cells = _with_words(marked).select(F.explode(_n_grams(buckets)).alias("cell"), "_trusted")
    counts = cells.groupBy("cell").agg(F.count("*").alias("raw"), F.count("_trusted").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for row in counts:  # at most ``buckets`` rows
        raw[row.cell], target[row.cell] = row.raw, row.target
    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return [0.0] * buckets
    from math import log

    base = log(n_raw + smoothing * buckets) - log(n_target + smoothing * buckets)
    return [round(log(t + smoothing) - log(r + smoothing) + base, 5) for r, t in zip(raw, target)]


def _repeated_words() -> dict[str, Column]:
    """Steps to the number of words in 3-word windows that a text has twice or more."""
    sorted_pairs = "array_sort(transform(_h, (x, i) -> struct(x as h, i as i)))"
    return {
        "_h": F.expr("case when size(_w) > 3 then transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) else array() end"),
        "_s": F.expr("sort_array(_h)"),
        "_d": F.expr("array_distinct(filter(_s, (x, i) -> i > 0 and x = get(_s, i - 1)))"),
        "_z": F.expr(f"case when size(_d) > {FEW_REPEATED} then {sorted_pairs} end"),
        "_p": F.expr(
            f"""case when size(_d) = 0 then array()
                when size(_d) <= {FEW_REPEATED} then filter(sequence(0, size(_h) - 1), i -> array_contains(_d, _h[i]))
                else array_sort(transform(filter(_z, (s, k) -> s.h = get(_z, k - 1).h or s.h = get(_z, k + 1).h), s -> s.i)) end"""
        ),
        "n_repeat_words": F.expr("aggregate(transform(_p, (x, k) -> least(3, coalesce(get(_p, k + 1) - x, 3))), 0L, (a, x) -> a + x)"),
    }


def score_quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept."""
    table = F.split(F.lit(",".join(map(str, ratio_table(docs, labels, buckets, trusted_docs)))), ",").cast("array<double>")
    clash = [c for c in docs.columns if c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept", "_w", "_h", "_s", "_d", "_z", "_p", "_l")]
    out = _with_words(docs.drop(*clash))
    for name, column in _repeated_words().items():
        out = out.withColumn(name, column)
    out = out.withColumn("_l", F.expr(r"filter(split(coalesce(text, ''), '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    grams = F.aggregate(_n_grams(buckets), F.lit(0.0), lambda sum_, cell: sum_ + F.get(table, cell))
    out = out.select(
        *[c for c in docs.columns if c not in clash],
        "n_words",
        F.expr("aggregate(_w, 0L, (a, x) -> a + length(x))").alias("word_chars"),
        F.regexp_count(text_or_empty("text"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        F.when(F.col("n_words") > 0, F.round(grams / (2 * F.col("n_words") - 1), 9)).otherwise(0.0).alias("llr"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The documents that pass, with their own columns."""
    own = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")
    scored = score_quality(own, labels, **params)
    # a filter on a generated column stays above the steps of the score; pushed below, it would repeat them many times over
    return scored.select("_doc", F.explode(F.array("kept")).alias("_kept")).where("_kept").select("_doc.*")
