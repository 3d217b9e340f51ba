"""Operator 10 [native]: removal of lines that spread over many sites.

A line is hashed (128 bits, of the line without white space at its ends).  HyperLogLog sketches of the sites that have a
line merge by aggregation; where the estimate is within ``margin`` of the threshold the sites are counted exactly.  A line
of at least ``least_sites`` sites is boilerplate: it stays in the document with the smallest doc_id that has it and goes
from all others.  Blank lines are no lines and stay.

With ``long_sites``, lines of over ``LONG_WORDS`` words (runs outside the blanks) are spread from that many sites on.  Only
whole lines are compared: repeats within one site and passages inside longer lines stay.

A very common line's rows are spread over ``SPLIT`` tasks when they meet it: lines with a thousandth or more of all spread
lines' rows are at most ``HOT`` of them, whatever the input, so these few hashes are broadcast.

Defined results: a null text stays null; a null source is no site; a row with a null doc_id is never a line's first
document; repeated rows are treated alike; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

LEAST_SITES, LG_CONFIG_K, LONG_WORDS = 3, 12, 50
HOT, SPLIT = 1000, 64
_BLANKS = " \t\n\x0b\x0c\r"


def _hashed_lines(keyed: DataFrame) -> DataFrame:
    lines = keyed.select("_row", "_row2", "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(_BLANKS))).where("line <> ''")
    return lines.select("_row", "_row2", "doc_id", "source", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), _is_long("line").alias("long"))


def _is_long(name: str) -> Column:
    """Whether a line without blanks at its ends has over LONG_WORDS words; the words of a short one are not counted."""
    return F.when(F.length(name) > 2 * LONG_WORDS, F.size(F.split(name, r"[\x20\x09-\x0D]+")) > LONG_WORDS).otherwise(False)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_row": F.xxhash64("doc_id", "text"), "_row2": F.xxhash64(F.lit(1), F.col("doc_id"), F.col("text"))})


def margin(least_sites: int, lg_config_k: int = LG_CONFIG_K) -> int:
    """Three standard errors of a sketch's estimate at the threshold, 1 at least."""
    return max(1, ceil(3 * 1.04 / sqrt(1 << lg_config_k) * least_sites))


def spread_lines(docs: DataFrame, least_sites: int = LEAST_SITES, lg_config_k: int = LG_CONFIG_K, long_sites: int | None = None) -> DataFrame:
    """Lines of at least ``least_sites`` sites, long ones of at least ``long_sites``: h1, h2, first_doc, n (rows)."""
    lines = _hashed_lines(_keyed(docs.select("doc_id", "source", "text")))
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("source"), lg_config_k)).alias("about"), F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), *([] if long_sites is None else [F.first("long").alias("long")]))
    near = margin(max(least_sites, long_sites or 0), lg_config_k)
    least = F.lit(least_sites) if long_sites is None else F.when(F.col("long"), long_sites).otherwise(least_sites)
    sketched = sketched.withColumn("least", least).drop("long")
    candidates = sketched.where((F.col("n") >= F.col("least")) & (F.col("about") >= F.col("least") - near))
    # a line's sites are made distinct before they meet its candidate, so that a very common line brings no more rows than it has sites
    pairs = lines.where("source is not null").select("h1", "h2", F.xxhash64("source").alias("s1"), F.xxhash64(F.lit(1), F.col("source")).alias("s2")).distinct()
    exact = pairs.join(candidates.where(F.col("about") <= F.col("least") + near).select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    certain = candidates.where(F.col("about") > F.col("least") + near).select("h1", "h2", "first_doc", "n")
    checked = candidates.where(F.col("about") <= F.col("least") + near).join(exact, ["h1", "h2"]).where(F.col("sites") >= F.col("least")).select("h1", "h2", "first_doc", "n")
    return certain.unionByName(checked)


def remove_spread_lines(docs: DataFrame, least_sites: int = LEAST_SITES, lg_config_k: int = LG_CONFIG_K, long_sites: int | None = None) -> DataFrame:
    """The documents with cleaned texts, n_lines (not blank) and n_removed; columns of these names, or of the working ones, are replaced."""
    docs = docs.drop("n_lines", "n_removed", "_row", "_row2", "_gone")
    keyed, spread = _keyed(docs), stored(spread_lines(docs, least_sites, lg_config_k, long_sites))
    lines = _hashed_lines(keyed.select("_row", "_row2", "doc_id", "source", "text"))
    hot = F.col("n") * HOT >= (spread.agg(F.sum("n")).first()[0] or 0)
    part = F.pmod(F.xxhash64("_row", "pos"), F.lit(SPLIT)).cast("int")
    lines = lines.join(F.broadcast(spread.where(hot).select("h1", "h2", F.lit(True).alias("hot"))), ["h1", "h2"], "left").withColumn("part", F.when(F.col("hot"), part).otherwise(0))
    spread = spread.withColumn("part", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SPLIT - 1))).otherwise(F.array(F.lit(0)))))
    hits = lines.join(spread, ["h1", "h2", "part"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    gone = hits.groupBy("_row", "_row2").agg(F.collect_set("pos").alias("_gone"))
    joined = keyed.join(gone, ["_row", "_row2"], "left")
    left = F.expr("case when _gone is null then text else array_join(filter(split(text, '\\n'), (x, i) -> not array_contains(_gone, i)), '\\n') end")
    n_lines = F.expr(r"size(filter(split(coalesce(text, ''), '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]'))").cast("long")
    columns = [left.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def clean_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents without spread lines, with all their columns whatever these are called; documents with nothing else go."""
    own = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", "text")
    out = remove_spread_lines(own, **params).where("n_removed = 0 or n_removed < n_lines")
    return out.select(*[F.col("text") if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns])


ORACLE = f"""
with doc as (select doc_id, source, text, row_number() over () as r from documents),
l as (select r, doc_id, source, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as pos from doc where text is not null),
t as (select *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line from l),
spread as (select line, min(doc_id) as first_doc from t where line <> '' group by line having count(distinct source) >= {LEAST_SITES}),
m as (select t.r, t.pos, t.raw, t.line <> '' as is_line, s.line is not null and t.doc_id is distinct from s.first_doc as gone from t left join spread s on t.line = s.line and t.line <> ''),
g as (select r, coalesce(string_agg(raw, chr(10) order by pos) filter (not gone), '') as text, count(*) filter (is_line) as n_lines, count(*) filter (gone) as n_removed from m group by r)
select d.doc_id, case when d.text is null then null else g.text end as text, coalesce(g.n_lines, 0)::bigint as n_lines, coalesce(g.n_removed, 0)::bigint as n_removed
from doc d left join g on d.r = g.r
"""
