"""Quality rules from tokeniser fertility, beside plain counts of words, symbols, repeated lines and repeated windows.

Public vocabularies are made for ordinary text, so what they need for a text tells
how ordinary that is: characters per token of each vocabulary, the share of
tokens that fall back to single bytes, and the entropy of the tokens. All depend on the language
and on the length, so each document is held against the quartiles of the
documents of its language (its script, where the language is unknown) and of its
power of two of words. The quartiles are exact and over all documents. A group
with few documents takes the band of the neighbouring sizes, else of its whole
language, widened where that has few too; a language of one or two documents
takes the band around those of the languages of its script, else of all.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.stage import stage
from panelspark.llm import textbytes as tb

#: First code point of some scripts' blocks; what lies between belongs to the block before.
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"),
           (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
           (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "other")]


@dataclass(frozen=True)
class FertilityParams:
    """Distances are in widths: a group's interquartile range, or ``floor`` of the median if that is more.

    ``low`` bounds the sum of the distances of characters per token and entropy
    below the median, ``alone`` each of them by itself, ``high`` how far they
    lie above it, and ``bytes`` the byte-fallback share above its upper
    quartile. ``model`` is a sentencepiece file; ``second`` may name a vocabulary
    of ranks, whose characters per token have a band of their own. Groups of fewer than
    ``support`` documents are judged by a wider band, see ``wider_bands``.
    """
    model: str = ""
    second: str = ""
    low: float = 2.75
    alone: float = 6.0
    high: float = 8.0
    bytes: float = 8.0
    floor: float = 0.01
    byte_floor: float = 0.01
    support: int = 30
    min_words: int = 10
    max_repeat_percent: int = 20


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: words, code points in words, symbols, repeated lines, words in repeated 5-word windows."""
    def per_text(mask):
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]], total

    n = len(off) - 1
    starts, ends, first = tb.word_bounds(data, off)
    in_word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    chars, _ = per_text(in_word & ((data & 0xC0) != 0x80))
    symbols, _ = per_text(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)))
    _, words_to = per_text(in_word)
    prefix = tb.prefix_hash(data)
    begin = np.unique(np.concatenate([off[:-1], np.flatnonzero(data == 10) + 1]))
    begin = begin[begin < len(data)]
    nxt = np.append(begin[1:], len(data))
    end = nxt - (data[nxt - 1] == 10) if len(begin) else nxt[:0]
    begin = begin[:len(end)]
    worded = words_to[end] > words_to[begin]
    begin, end = begin[worded], end[worded]
    owner = np.searchsorted(off, begin, side="right") - 1
    key = tb.mix(tb.span_hash(prefix, begin, end) + owner.astype(np.uint64) * tb.MUL)
    _, seen = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[seen] = False
    word = tb.span_hash(prefix, starts, ends)
    text = np.repeat(np.arange(n), np.diff(first))
    windows = np.flatnonzero(text[4:] == text[:-4]) if len(word) > 4 else np.zeros(0, np.int64)
    rolled = text[windows].astype(np.uint64) * tb.MUL
    for k in range(5):
        rolled += word[windows + k] * np.uint64(pow(0xE7037ED1A0B428DB, k + 1, 1 << 64))
    _, at, times = np.unique(tb.mix(rolled), return_inverse=True, return_counts=True)
    hit = windows[times[at] > 1] if len(windows) else windows
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 5, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return {"n_words": np.diff(first).astype(np.int64), "word_chars": chars, "n_symbols": symbols,
            "n_dup_lines": np.bincount(owner[again], minlength=n).astype(np.int64),
            "n_repeat_words": np.bincount(text[covered], minlength=n).astype(np.int64)}


def script_of(text: str) -> str:
    """The script of most letters above the ASCII signs; ``none`` without any."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[(points >= 0x41) & ~((points > 0x5A) & (points < 0x61)) & ~((points > 0x7A) & (points < 0xC0))]
    if not len(points):
        return "none"
    at = np.bincount(np.searchsorted([a for a, _ in SCRIPTS], points, side="right") - 1, minlength=len(SCRIPTS))
    total: dict[str, int] = {}
    for (_, name), c in zip(SCRIPTS, at.tolist()):
        total[name] = total.get(name, 0) + c
    return max(sorted(total), key=total.get)


def measures(docs: DataFrame, p: FertilityParams) -> DataFrame:
    """The counts of every whole text, its script, and its tokens: number, characters each, byte share, entropy."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        import sentencepiece

        cache = tb.worker_cache()
        if ("sentencepiece", p.model) not in cache:
            held = sentencepiece.SentencePieceProcessor(model_file=p.model)
            cache["sentencepiece", p.model] = held, np.array([held.is_byte(i) for i in range(held.vocab_size())])
        model, is_byte = cache["sentencepiece", p.model]
        if p.second and ("ranks", p.second) not in cache:
            import public_tokenizers
            import tiktoken

            with open(p.second, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            cache["ranks", p.second] = tiktoken.Encoding(os.path.basename(p.second), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        other = cache["ranks", p.second] if p.second else None
        for part in tb.parts(batches, "text"):
            counts = base_counts(*tb.flat(part.column("text")))
            texts = [t or "" for t in part.column("text").to_pylist()]
            rows = []
            for ids in model.encode(texts, num_threads=1):
                ids = np.array(ids, np.int64)
                share = np.bincount(ids) / max(1, len(ids)) if len(ids) else np.zeros(1)
                share = share[share > 0]
                rows.append((len(ids), float(is_byte[ids].mean()) if len(ids) else 0.0, float(-(share * np.log2(share)).sum()) + 0.0))
            tokens = np.array([r[0] for r in rows], np.int64)
            more = pa.array([w / max(1, len(other.encode_to_numpy(t, disallowed_special=()))) for w, t in zip(counts["word_chars"].tolist(), texts)], pa.float64()) \
                if other else pa.nulls(len(texts), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), *(pa.array(counts[c]) for c in names),
                 pa.array([script_of(t) for t in texts], pa.string()), pa.array(tokens),
                 pa.array(counts["word_chars"] / np.maximum(1, tokens)), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.float64()), more],
                names=["doc_id", "lang", *names, "script", "n_tokens", "chars_per_token", "byte_share", "entropy", "second_chars"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in names)
        + ", script string, n_tokens long, chars_per_token double, byte_share double, entropy double, second_chars double")


#: Measures that have bands, and the digits they are rounded to there.
METRICS = {"chars_per_token": 3, "entropy": 2, "byte_share": 4, "of_most": 3, "second_chars": 3}


def wider_bands(found: DataFrame, p: FertilityParams) -> DataFrame:
    """(_group, script, _size, _level, _scale, b_ of each measure): the narrowest band with enough documents for each kind of document.

    Levels: 0 the group's size, 1 with its neighbours, 2 all sizes of the
    group, 3 around the groups of the script, 4 around all groups. They need
    ``support`` documents, but 2 needs three, the fewest whose median one odd
    document can't be, and 4 any. Quartiles of n documents are uncertain by
    1 / sqrt(n), so with fewer than ``support`` the widths are multiplied by
    _scale. A band has its quartiles low and high, and the least and most of
    the medians in it.
    """
    # few distinct values by rounding, so the quartiles come from counts of values
    values = found.select("_group", "script", "_size", F.posexplode(F.array(*(F.round(c, d) for c, d in METRICS.items()))).alias("metric", "value"))
    values = stage(values.groupBy("_group", "script", "_size", "metric", "value").agg(F.count("*").alias("n")))

    def key(level, group="", script="", size=-1):
        cast = [F.lit(x) if isinstance(x, str) else x for x in (group, script)]
        return F.struct(F.lit(level).alias("level"), cast[0].alias("group"), cast[1].alias("of"), (F.lit(size) if isinstance(size, int) else size).alias("size"))

    group, script, size = F.col("_group"), F.col("script"), F.col("_size")
    part = values.select(F.explode(F.array(
        key(0, group, size=size), *(key(1, group, size=size + d) for d in (-1, 0, 1)), key(2, group), key(3, group, script), key(4))).alias("key"),
        "metric", "value", "n").select("key.*", "metric", "value", "n")
    part = part.groupBy("level", "group", "of", "size", "metric", "value").agg(F.sum("n").alias("n"))
    part = part.groupBy("level", "group", "of", "size").agg(
        *(F.expr(f"percentile(CASE WHEN metric = {i} THEN value END, array(0.25, 0.5, 0.75), CASE WHEN metric = {i} THEN n ELSE 0 END)").alias(f"q_{c}")
          for i, c in enumerate(METRICS)),
        F.sum(F.when(F.col("metric") == 0, F.col("n"))).alias("_n"))
    part = part.withColumn("_scale", F.sqrt(F.greatest(F.lit(1.0), p.support / F.col("_n"))))
    part = stage(part.where((F.col("_n") >= p.support) | (F.col("level") == 2) & (F.col("_n") >= 3) | (F.col("level") == 4)))

    def around(rows, *by):
        return rows.groupBy(*by).agg(F.max("_scale").alias("_scale"), *(F.struct(
            F.min(F.col(f"q_{c}")[0]).alias("low"), F.min(F.col(f"q_{c}")[1]).alias("least"),
            F.max(F.col(f"q_{c}")[1]).alias("most"), F.max(F.col(f"q_{c}")[2]).alias("high")).alias(f"b_{c}") for c in METRICS))

    names = ["level", "group", "of", "size"]
    bands = around(part.where("level < 3"), *names)
    bands = bands.unionByName(around(part.where("level = 3").withColumn("group", F.lit("")), *names))
    bands = bands.unionByName(around(part.where("level >= 3").select(
        F.lit(4).alias("level"), F.lit("").alias("group"), F.lit("").alias("of"), F.lit(-1).alias("size"), "_scale", *(f"q_{c}" for c in METRICS)), *names))
    kinds = values.select("_group", "script", "_size").distinct().withColumn("key", F.explode(F.array(
        key(0, group, size=size), key(1, group, size=size), key(2, group), key(3, script=script), key(4))))
    joined = kinds.select("_group", "script", "_size", "key.*").join(bands, names)
    taken = joined.groupBy("_group", "script", "_size").agg(
        F.min("level").alias("_level"), F.min_by(F.struct("_scale", *(f"b_{c}" for c in METRICS)), "level").alias("band"))
    return stage(taken.select("_group", "script", "_size", "_level", "band.*"))


def rate(docs: DataFrame, params: FertilityParams = FertilityParams()) -> DataFrame:
    """Per row of (doc_id, text, lang if there): the counts, the measures, base_failed and kept.

    base_failed: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` of them in 5-word windows that the text has twice.
    kept: not base_failed and inside the bands. Null counts as the empty text,
    which fails by its number of words. A null or missing lang is judged with
    its script; a null doc_id stays null; repeated rows count as often as they
    come. Other columns are not looked at.
    """
    p = params
    found = stage(measures(docs, p).withColumn("_group", F.coalesce(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("script "), "script")))
                  .withColumn("_size", F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))).cast("int")))
    found = found.withColumn("of_most", F.col("entropy") / F.log2(F.greatest(F.col("n_tokens"), F.lit(2)).cast("double")))
    bands = wider_bands(found, p)

    def width(c, least):
        return F.col("_scale") * F.greatest(F.col(f"b_{c}.high") - F.col(f"b_{c}.low"), least)

    def distance(c, side):
        middle = F.col(f"b_{c}.{side}")
        return (F.col(c) - middle) / F.greatest(width(c, p.floor * middle), F.lit(1e-9))

    # longer texts have more entropy and less of the most they could have; over several sizes only what is low in both counts
    low = F.least(F.greatest(distance("entropy", "least"), distance("of_most", "least")), F.lit(0.0))
    entropy = F.when(F.col("_level") == 0, distance("entropy", "least")).otherwise(low)
    base = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))
    # each measure has a band of its own beside the sum, in which one can make up for the other
    odd = (distance("chars_per_token", "least") + entropy < -p.low) | (F.least(distance("chars_per_token", "least"), entropy) < -p.alone)
    odd = odd | (distance("chars_per_token", "most") > p.high) | (F.least(distance("entropy", "most"), distance("of_most", "most")) > p.high)
    odd = odd | F.coalesce((distance("second_chars", "least") < -p.alone) | (distance("second_chars", "most") > p.high), F.lit(False)) | (
        F.col("byte_share") > F.col("b_byte_share.high") + p.bytes * width("byte_share", F.lit(p.byte_floor)))
    out = found.join(bands, ["_group", "script", "_size"]).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & ~odd).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "script", "n_tokens", "chars_per_token", "byte_share", "entropy", "second_chars")
