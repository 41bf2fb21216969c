"""Token counts by a compiled finite-state tokenizer.

Two machines, compiled from the vocabulary file and the library's own splitter:

* The splitter needs the classes of a character and its neighbours only, so its
  state after a character does not depend on anything further back. Chunks of a
  text are read on their own; the state map of a chunk is what it does to the
  state it is entered with: finish the pretoken that is open there (its head),
  add a fixed number of tokens, and leave another pretoken open (its tail).
  Maps compose, so a text's chunks meet in a prefix scan.
* Inside a pretoken a deterministic transducer reads bytes. Its state holds, for
  every place where a vocabulary entry may still be under way, the node of the
  vocabulary trie, the token that ends there, and how many tokens the encoding
  up to there has beside the encoding up to now. A transition's output is the
  change of the number of tokens. States and transitions are compiled when
  first met.

An encoding is right exactly if each of its adjacent pairs is encoded as that
pair; the pair table is compiled with the merge rules.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.stage import stage
from panelspark.llm import textbytes as tb

LETTER, NUMBER, OTHER, SPACE, WHITE, UNKNOWN = 0, 1, 2, 3, 4, 255


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of a byte-level BPE vocabulary in tokenizers' .json format."""

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer

        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or splitter["type"] != "ByteLevel" or splitter["add_prefix_space"] or not splitter.get("use_regex", True):
            raise ValueError("this compiler takes byte-level BPE without a normalizer or prefix space")
        alphabet = byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        tokens = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = sorted(special, key=len, reverse=True)
        self.rank = {(bytes(alphabet[c] for c in a), bytes(alphabet[c] for c in b)): i for i, (a, b) in enumerate(merges)}
        self.splitter = Tokenizer.from_file(json_path).pre_tokenizer
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in tokens:
            node = 0
            for b in t:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = self.children[node][b]
            self.token[node] = t
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.states: dict[tuple, int] = {((0, None, 0),): 0}
        self.content: list[tuple] = [((0, None, 0),)]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.known: dict[bytes, int] = {}
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    @classmethod
    def held(cls, json_path: str) -> "Transducer":
        """One per Python worker and file."""
        cache = tb.worker_cache()
        if ("transducer", json_path) not in cache:
            cache["transducer", json_path] = cls(json_path)
        return cache["transducer", json_path]

    def merged(self, text: bytes) -> list[bytes]:
        """The merge rules applied to a short text, lowest rank first."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, last: bytes | None, token: bytes) -> bool:
        if last is None:
            return True
        pair = (last, token)
        if pair not in self.pairs:
            self.pairs[pair] = self.merged(last + token) == [last, token]
        return self.pairs[pair]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: the next state and the change of the number of tokens."""
        under_way, change, last = [], None, None
        for node, before, count in self.content[state]:  # longest first
            node = self.children[node].get(byte)
            if node is None:
                continue
            under_way.append((node, before, count))
            if change is None and self.token[node] is not None and self.fits(before, self.token[node]):
                change, last = count + 1, self.token[node]
        if change is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        content = (*((n, before, count - change) for n, before, count in under_way if self.children[n]), (0, last, 0))
        if content not in self.states:
            self.states[content] = len(self.content)
            self.content.append(content)
            self.moves.append({})
        move = self.moves[state][byte] = self.states[content], change
        return move

    def count(self, pretoken: bytes) -> int:
        state, total, moves = 0, 0, self.moves
        for byte in pretoken:
            move = moves[state].get(byte) or self.compile(state, byte)
            state = move[0]
            total += move[1]
        return total

    def class_of(self, points: np.ndarray) -> np.ndarray:
        """Character classes, learned from the library's splitter: what joins a letter, a number or a sign."""
        found = self.classes[points]
        if (found == UNKNOWN).any():
            for p in np.unique(points[found == UNKNOWN]).tolist():
                c = chr(p)
                joins = [len(self.splitter.pre_tokenize_str(x + c)) == 1 for x in ("a", "1", "!")]
                self.classes[p] = SPACE if c == " " else LETTER if joins[0] else NUMBER if joins[1] else OTHER if joins[2] else WHITE
            found = self.classes[points]
        return found

    def starts(self, points: np.ndarray) -> np.ndarray:
        """Where pretokens begin in a text of code points."""
        n = len(points)
        c = self.class_of(points)
        white = c >= SPACE
        prev = np.concatenate([[UNKNOWN], c[:-1]])
        start = np.where(white, ~np.concatenate([[False], white[:-1]]), (prev != c) & (prev != SPACE))
        # the last of several white characters stands alone, or before the next word if it is a space
        start |= white & ~np.concatenate([white[1:], [True]])
        # an apostrophe that does not continue a run of signs begins one of 's 't 'm 'd 're 've 'll
        at = np.flatnonzero((points == 39) & (prev != OTHER) & (prev != SPACE))
        padded = np.concatenate([points, [0, 0, 0]])
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        ends = np.concatenate([at[short] + 2, at[long] + 3])
        start[at[short | long]] = True
        inside = np.concatenate([at[short | long] + 1, at[long] + 2])
        start[inside] = False
        start[ends[ends < n]] |= c[ends[ends < n]] < SPACE
        return np.flatnonzero(start)

    def total(self, text: str) -> int:
        """Tokens of a text that is entered and left between pretokens."""
        if not text:
            return 0
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])[np.append(self.starts(points), len(points))].tolist()
        raw = text.encode()
        known, n = self.known, 0
        for a, b in zip(at, at[1:]):
            pretoken = raw[a:b]
            count = known.get(pretoken)
            if count is None:
                count = self.count(pretoken)
                if len(pretoken) <= 64:
                    if len(known) >= 300_000:
                        known.clear()
                    known[pretoken] = count
            n += count
        if len(self.pairs) > 300_000:  # pairs and states are compiled again when they are met again
            self.pairs = {}
        if len(self.content) > 150_000:
            self.states, self.content, self.moves = {((0, None, 0),): 0}, [((0, None, 0),)], [{}]
        return n

    def cuts(self, text: str) -> list[str]:
        """The text between special tokens, each of which is one token."""
        parts = [text]
        for s in self.special:
            if s in text:
                parts = [x for part in parts for x in part.split(s)]
        return parts

    def text_tokens(self, text: str) -> int:
        parts = self.cuts(text)
        return len(parts) - 1 + sum(map(self.total, parts))

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, tokens, tail) of a chunk; tokens is null if the chunk has no sure place to cut.

        Two kinds of places always begin a pretoken, whatever stands further left
        or right: a white character after one that is not white, and a letter,
        number or sign after one of another of these classes, unless an
        apostrophe shortly before may take it in.
        """
        points = np.frombuffer(chunk.encode("utf-32-le"), np.uint32)
        c = self.class_of(points)
        white, quote = c >= SPACE, points == 39
        sure = np.zeros(len(points), bool)
        sure[1:] = (white[1:] & ~white[:-1]) | (~white[1:] & ~white[:-1] & (c[1:] != c[:-1]))
        for back in (1, 2, 3):
            sure[back:] &= ~quote[:-back] | white[back:]
        sure[:3] &= white[:3]
        found = np.flatnonzero(sure)
        if not len(found):
            return chunk, None, ""
        return chunk[:found[0]], self.total(chunk[found[0]:found[-1]]), chunk[found[-1]:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None, ""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.total(a[2] + b[0]) + b[1], b[2]

    def compose_all(self, maps: list[tuple]) -> tuple:
        """The map of neighbouring chunks, composed in pairs."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def closed(self, whole: tuple) -> int:
        """Tokens of a whole text from its map."""
        head, tokens, tail = whole
        return self.total(head) + (tokens or 0) + self.total(tail)


FAN = 16  # maps that one step of the scan composes

MAPS = "row long, part int, nth int, head string, tokens long, tail string"


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = 1 << 16) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of (doc_id, text).

    Texts beyond ``chunk`` characters are cut at the strings of special tokens,
    one token each, and read in chunks by any tasks. The maps of a part's chunks
    are composed ``FAN`` at a time, step by step, so no task takes all chunks of
    a text; what is open at the ends of a chunk is a pretoken or less, and all
    of it only where a part is one run of letters, numbers or signs. Null counts
    as the empty text with 0 tokens. A null doc_id stays null; repeated rows are
    counted one by one. Other columns are not looked at.
    """
    size = F.coalesce(F.length("text"), F.lit(0))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = own.select("doc_id", "text", size.alias("size"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))

    def whole(batches):
        machine = Transducer.held(tokenizer)
        for part in tb.parts(batches, "text"):
            counts = [machine.text_tokens(t) if t else 0 for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    long = F.col("size") > chunk
    short = one.where(~long).select("doc_id", "n_bytes", "text").mapInArrow(whole, "doc_id long, n_bytes long, n_tokens long")

    def batch_of(rows):
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in MAPS.split(", ")])

    def mapped(batches):
        machine = Transducer.held(tokenizer)
        for piece in tb.parts(batches, "text"):
            keys = zip(*(piece.column(c).to_pylist() for c in ("row", "part", "nth")))
            yield batch_of([(*k, *machine.chunk_map(t)) for k, t in zip(keys, piece.column("text").to_pylist())])

    rows = stage(one.where(long).withColumn("row", F.monotonically_increasing_id()))
    special = _special(tokenizer)
    parts = F.split("text", "|".join("\\Q" + s + "\\E" for s in special), -1) if special else F.array("text")
    pieces = rows.select("row", F.posexplode(parts).alias("part", "text")).withColumn("size", F.length("text"))
    pieces = pieces.withColumn("nth", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("size") - 1) / chunk), F.lit(0)).cast("int"))))
    pieces = pieces.select("row", "part", "nth", F.expr(f"substring(text, nth * {chunk} + 1, {chunk})").alias("text"))
    maps = stage(pieces.mapInArrow(mapped, MAPS))

    def composed(key, t):
        machine = Transducer.held(tokenizer)
        t = t.sort_by("nth")
        made = machine.compose_all(list(zip(*(t.column(c).to_pylist() for c in ("head", "tokens", "tail")))))
        return pa.Table.from_batches([batch_of([(*(k.as_py() for k in key), *made)])])

    last = maps.agg(F.max("nth")).first()[0] or 0
    while last:
        # a step of the scan: neighbours become one, whatever their text
        maps = stage(maps.groupBy("row", "part", F.floor(F.col("nth") / FAN).cast("int").alias("group")).applyInArrow(composed, MAPS))
        last //= FAN

    def closed(batches):
        machine = Transducer.held(tokenizer)
        for batch in batches:
            made = zip(*(batch.column(c).to_pylist() for c in ("head", "tokens", "tail")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([machine.closed(m) for m in made], pa.int64())], names=["row", "n"])

    sums = maps.select("row", "head", "tokens", "tail").mapInArrow(closed, "row long, n long").groupBy("row").agg((F.sum("n") + F.count("*") - 1).alias("n_tokens"))
    large = rows.select("row", "doc_id", "n_bytes").join(sums, "row").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(large).withColumn("over_limit", F.col("n_tokens") > limit)


def _special(tokenizer: str) -> list[str]:
    """Strings of special tokens, longest first."""
    with open(tokenizer, encoding="utf-8") as f:
        return sorted((t["content"] for t in json.load(f)["added_tokens"]), key=len, reverse=True)
