"""Repeated runs of lines, found by winnowing over line hashes; DataFrame functions only.

Lines with a word are units. Windows are the shortest runs of units that hold
``min_words`` words: from each unit on, up to each unit, and over each gap
between two units. Every unit and every gap of a longer run lies in a window
inside that run, whichever earlier place the run stands at. The smallest line
hash of a window is its fingerprint: equal runs share it, and only windows whose
fingerprint stands at two places go on. Their whole content is matched, matches
grow both ways through the overlapping windows to the ends of the repeated run,
and every run but the first is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.stage import stage
from panelspark.llm import textbytes as tb

WORD = r"[^\x20\x09-\x0D]+"


def _row_key():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text"))


def line_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per window: its lines from..to, the hashes of its content, its fingerprint and where that stands."""
    lines = docs.select(_row_key().alias("rid"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    units = lines.withColumn("w", F.regexp_count("line", F.lit(WORD))).where("w > 0")
    units = units.select("rid", "doc_id", "pos", "w", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))
    # equal rows of one doc_id are one document
    units = units.repartition("rid").groupBy("rid", "pos").agg(*(F.first(c).alias(c) for c in ("doc_id", "w", "h", "h2")))
    doc = W.partitionBy("rid")
    units = units.withColumn("s", F.sum("w").over(doc.orderBy("pos")) - F.col("w"))
    units = units.withColumn("e", F.col("s") + F.col("w"))

    def over(frame):
        return (F.min("pos").over(frame).alias("from"), F.max("pos").over(frame).alias("to"), F.sum("w").over(frame).alias("words"),
                F.min(F.struct("h", F.negate("pos").alias("p"))).over(frame).alias("print"),
                F.collect_list(F.struct("h", "h2")).over(frame).alias("content"))

    # from a unit on; over the gap behind a unit that is long enough alone; up to a unit, where that is no window of the first kind
    kinds = [(over(doc.orderBy("s").rangeBetween(0, min_words - 1)), f"words >= {min_words}"),
             (over(doc.orderBy("s").rowsBetween(0, 1)), f"w >= {min_words} AND to > from"),
             (over(doc.orderBy("e").rangeBetween(1 - min_words, 0)), f"words - w >= {min_words}")]
    windows = units.select("rid", "doc_id", "w", F.array(*(F.struct(*columns) for columns, _ in kinds)).alias("found"))
    windows = windows.select("rid", "doc_id", "w", F.posexplode("found").alias("kind", "found")).select("rid", "doc_id", "w", "kind", "found.*")
    which = " OR ".join(f"kind = {i} AND {condition}" for i, (_, condition) in enumerate(kinds))
    return windows.where(which).select(
        "rid", "doc_id", F.col("from").alias("pos"), "to", F.col("print.h").alias("print"), F.negate("print.p").alias("at"),
        F.xxhash64("content.h").alias("g1"), F.xxhash64("content.h2").alias("g2"))


def repeated_lines(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """(rid, from, to): the maximal runs of lines to delete; rid is the hash of (doc_id, text)."""
    windows = stage(line_windows(docs, min_words))
    place = F.struct("rid", "at")
    prints = windows.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("print")
    near = windows.join(prints, "print", "left_semi")
    order = F.struct(F.coalesce("doc_id", F.lit(2 ** 63 - 1)).alias("d"), "rid", "pos")
    first = near.groupBy("g1", "g2").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = near.join(first, ["g1", "g2"]).where(order != F.col("first")).select("rid", "pos", "to")
    by = W.partitionBy("rid").orderBy("pos", "to")
    reach = F.max("to").over(by.rowsBetween(W.unboundedPreceding, -1))
    runs = later.distinct().withColumn("new", F.when(F.col("pos") <= reach, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("rid", "run").agg(F.min("pos").alias("from"), F.max("to").alias("to")).drop("run")


def drop_repeated_lines(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and n_lines, n_removed, n_runs.

    A line goes if a run of consecutive lines through it, with ``min_words``
    words or more, also stands earlier in the order of doc_id and line; runs of
    lines without a word never match, but go where they lie inside a run. The
    rest is joined by newlines again. Null text stays null with 0 lines; a null
    doc_id comes last; rows equal in doc_id and text are one document and get
    the same answer. Columns named n_lines, n_removed or n_runs are replaced.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rid, found = tb.spare(docs.columns, "_rid"), tb.spare(docs.columns, "_runs")
    runs = repeated_lines(own, min_words).groupBy(F.col("rid").alias(rid)).agg(F.collect_list(F.struct("from", "to")).alias(found))
    out = docs.withColumn(rid, F.xxhash64(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.col("text").cast("string")))
    out = out.join(runs, rid, "left")
    removed = F.expr(f"coalesce(aggregate({found}, 0L, (a, r) -> a + r.to - r.from + 1), 0L)")
    text = F.col("text").cast("string")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists(found, lambda r: (i >= r["from"]) & (i <= r["to"])))
    answer = {"n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": removed,
              "n_runs": F.when(F.col(found).isNull(), 0).otherwise(F.size(found)).cast("long")}
    cleaned = F.when(F.col(found).isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text")
    rest = [c for c in docs.columns if c.lower() not in answer]
    return out.select(*(cleaned if c == "text" else F.col(q) for c, q in zip(rest, tb.quoted(rest))), *(c.alias(n) for n, c in answer.items()))
