"""Repair of conversations: faults, the cheapest edits to a legal order of roles, and the repaired rows.

The rows of a conversation become a string of nine symbols (role and fault).
Re-Pair rules are learned from the strings of all conversations: frequent
neighbours become one symbol, round by round. Every symbol and rule has one
min-plus matrix over the four states of the role order, each entry a cost and
the edits as a rope, made bottom-up from the two matrices of its rule. A
conversation is then a short product of matrices that all conversations share.
"""

from __future__ import annotations

import collections
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.stage import stage

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # what the last row kept was; nothing and an assistant's row may end
SYMBOLS = "suaxSUAXD"  # role, capital where truncated, or a row that must go
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5


@dataclass(frozen=True)
class RepairParams:
    """``rounds`` of Re-Pair; a round makes rules of pairs that share no symbol and occur ``support`` times."""
    rounds: int = 4
    support: int = 3
    memo: int = 20_000


# ---- rules and matrices

def step(state: int) -> int:
    """The state behind the user or assistant row that may come next."""
    return ASSISTANT if state == USER else USER


def kept(state: int, role: str) -> int | None:
    """The state behind a row that keeps its role, if it may stand there."""
    if role == "s":
        return SYSTEM if state == START else None
    return step(state) if role == "ua"[step(state) == ASSISTANT] else None


def flat(rope) -> str:
    """The letters of a rope: text, or a pair of ropes."""
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += (x[1], x[0])
    return "".join(out)


def symbol_matrix(symbol: str) -> dict:
    """{(state before, state behind): (cost, rope)} of one row: insertions before it, then its own edit."""
    role, extra = symbol.lower(), TRUNCATED * (symbol in "SUAX")
    best: dict = {}

    def offer(a, b, cost, letters):
        if (a, b) not in best or (cost, letters) < best[a, b]:
            best[a, b] = (cost, letters)

    for before in range(4):
        state = before
        for inserted in range(3):
            paid, letters = INSERT * inserted, "I" * inserted
            offer(before, state, paid + DELETE, letters + "D")
            if symbol != "D":
                if kept(state, role) is not None:
                    offer(before, kept(state, role), paid + extra, letters + "K")
                offer(before, step(state), paid + extra + REROLE, letters + "R")
            state = step(state)
    return best


def product(first: dict, second: dict) -> dict:
    """The min-plus product; of equal costs the edits that come first in ASCII."""
    out: dict = {}
    for (a, m), (c1, r1) in first.items():
        for (n, b), (c2, r2) in second.items():
            if n == m:
                new = (c1 + c2, (r1, r2))
                old = out.get((a, b))
                if old is None or new[0] < old[0] or (new[0] == old[0] and flat(new[1]) < flat(old[1])):
                    out[a, b] = new
    return out


class Grammar:
    """Rules (symbol, left, right) in the order they were made, and the matrix of each, made once."""

    def __init__(self, rules: list[tuple[str, str, str]], memo: int):
        self.rules, self.memo, self.solved = rules, memo, {}
        self.matrix = {s: symbol_matrix(s) for s in SYMBOLS}
        for name, left, right in rules:
            self.matrix[name] = product(self.matrix[left], self.matrix[right])
        self.table = {}
        for name, m in self.matrix.items():  # by state behind, with the letters at hand for ties
            self.table[name] = [[(a, cost, flat(rope)) for (a, b), (cost, rope) in sorted(m.items(), key=lambda x: x[0]) if b == to] for to in range(4)]

    def compressed(self, symbols: str) -> str:
        for name, left, right in self.rules:
            symbols = symbols.replace(left + right, name)
        return symbols

    def repair(self, pieces: list[str]) -> tuple[int, str]:
        """Cost and edits of the rows whose symbols are the pieces, in order.

        Edits of the same rows end with an edit of the last row, so none is the
        beginning of another and their order is settled by ranks.
        """
        key = pieces[0] if len(pieces) == 1 else None
        if key in self.solved:
            return self.solved[key]
        now = [(0, 0)] + [None] * 3  # cost and rank of the edits that lead to a state
        back = []
        for piece in pieces:
            for symbol in self.compressed(piece):
                found, choice = [None] * 4, [None] * 4
                for to in range(4):
                    for a, cost, letters in self.table[symbol][to]:
                        if now[a] is not None:
                            new = (now[a][0] + cost, now[a][1], letters)
                            if found[to] is None or new < found[to]:
                                found[to], choice[to] = new, (a, letters)
                ranks = {x: i for i, x in enumerate(sorted({x[1:] for x in found if x}))}
                now = [x and (x[0], ranks[x[1:]]) for x in found]
                back.append(choice)
        closing = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        cost, _, end, state = min((x[0] + INSERT * len(closing[s]), x[1], closing[s], s) for s, x in enumerate(now) if x)
        letters = [end]
        for choice in reversed(back):
            state, some = choice[state]
            letters.append(some)
        answer = (cost, "".join(reversed(letters)))
        if key is not None:
            if len(self.solved) >= self.memo:
                self.solved.clear()
            self.solved[key] = answer
        return answer


def learn(chunks: DataFrame, p: RepairParams) -> list[tuple[str, str, str]]:
    """Re-Pair rules from the counts of all neighbours of all strings; a few counts per round come to the driver."""
    rules: list[tuple[str, str, str]] = []
    for _ in range(p.rounds):
        grammar = Grammar(rules, p.memo)

        def pairs(batches, grammar=grammar):
            for batch in batches:
                counted: collections.Counter = collections.Counter()
                for text, n in collections.Counter(batch.column("symbols").to_pylist()).items():
                    text = grammar.compressed(text)
                    for pair in zip(text, text[1:]):
                        counted[pair] += n
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in counted], pa.string()), pa.array([b for _, b in counted], pa.string()),
                                                  pa.array(list(counted.values()), pa.int64())], names=["a", "b", "n"])

        counts = chunks.select("symbols").mapInArrow(pairs, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        used: set[str] = set()
        made = len(rules)
        for r in sorted(counts.where(F.col("n") >= p.support).collect(), key=lambda r: (-r["n"], r["a"], r["b"])):  # at most the square of the symbols
            if r["a"] not in used and r["b"] not in used:
                used |= {r["a"], r["b"]}
                rules.append((chr(0x100 + len(rules)), r["a"], r["b"]))
        if len(rules) == made:
            break
    return rules


# ---- rows

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, h) after the damage of the contract; nulls of role and text are one space."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    name = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select(
        conv.alias("conv"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("draw"))
    rows = rows.where("draw <> 0").select(
        "conv", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "draw")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("h"))


def _ordered() -> list:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h").asc()]


def marked(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, h, first, fault) per row: first letter of the role, and 0 or the first fault: 1 blank, 2 duplicate, 3 truncated."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    light = rows.select("conv", "turn", "role", "h", F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x").alias("first"),
                        (F.length(end) == 0).alias("blank"), F.substring(end, -1, 1).isin(".", "!", "?").alias("ended"))
    # one group holds equal rows of one conversation only; the rows pass through, they are not gathered
    nth = F.row_number().over(W.partitionBy("conv", "role", "h").orderBy("turn"))
    light = light.withColumn("nth", nth)
    fault = F.when(F.col("blank"), 1).when(F.col("nth") > 1, 2).when(~F.col("ended"), 3).otherwise(0)
    return light.select("conv", "turn", "role", "h", "first", fault.cast("int").alias("fault"))


CHUNK = ("conv long, part long, symbols string, first string, last string, illegal long, blank long, duplicate long, truncated long, "
         "turns long, first_turn long, last_turn long")


def chunked(rows: DataFrame) -> DataFrame:
    """Strings of symbols in the order of the rows: a conversation is one or, where it is long or cut by a task, several.

    The rows are dealt by ranges of (conv, turn, role, h), so a conversation of any length is shared by many tasks.
    """
    order = [F.col("conv").asc_nulls_first(), *_ordered()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "first", "fault")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv, turn = (batch.column(c).fill_null(-1).to_numpy() for c in ("conv", "turn"))
            no_conv, no_turn = (batch.column(c).is_null().to_numpy(zero_copy_only=False) for c in ("conv", "turn"))
            fault = batch.column("fault").to_numpy()
            first = np.frombuffer("".join(batch.column("first").to_pylist()).encode(), np.uint8)
            symbols = np.where((fault == 1) | (fault == 2), ord("D"), np.where(fault == 3, first - 32, first)).astype(np.uint8)
            text, firsts = symbols.tobytes().decode(), first.tobytes().decode()
            new = np.ones(n, bool)
            new[1:] = (conv[1:] != conv[:-1]) | (no_conv[1:] != no_conv[:-1])
            bad = np.zeros(n, np.int64)
            pair = first[:-1].astype(np.int64) * 256 + first[1:]
            bad[1:] = ~np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("su", "ua", "au")]) & ~new[1:]
            fresh = ~no_turn
            fresh[1:] &= new[1:] | no_turn[:-1] | (turn[1:] != turn[:-1])
            at = np.flatnonzero(new)
            to = np.append(at[1:], n)
            sums = [np.add.reduceat(x.astype(np.int64), at) for x in (bad, fault == 1, fault == 2, fault == 3, fresh, no_turn)]
            turns = [None if k == b - a else int(turn[a + k]) for a, b, k in zip(at, to, sums[5])]
            last = [None if k == b - a else int(turn[b - 1]) for a, b, k in zip(at, to, sums[5])]
            columns = [pa.array(conv[at], pa.int64(), mask=no_conv[at]), pa.array(part + np.arange(len(at))), pa.array([text[a:b] for a, b in zip(at, to)]),
                       pa.array([firsts[a] for a in at]), pa.array([firsts[b - 1] for b in to]), *(pa.array(x) for x in sums[:5]),
                       pa.array(turns, pa.int64()), pa.array(last, pa.int64())]
            part += len(at)
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CHUNK.split(", ")])

    return rows.mapInArrow(run, CHUNK)


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def solved(chunks: DataFrame, ids: DataFrame, rules: list, p: RepairParams) -> DataFrame:
    """(conv, stats, audit) for every conversation of ``ids``; its strings come together in order, a byte a row."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema.fields[1:]]
    both = chunks.unionByName(ids.select("conv", *empty))
    order = [F.col("conv").asc_nulls_first(), F.col("part").asc_nulls_first()]
    names = [f.name for f in chunks.schema.fields]

    def answer(conv, found, grammar):
        total = dict.fromkeys(STATS, 0)
        turns, low, before = 0, None, None
        for i, c in enumerate(found):
            for k in ("blank", "duplicate", "truncated", "illegal"):
                total[k] += c[k]
            if i and found[i - 1]["last"] + c["first"] not in ("su", "ua", "au"):
                total["illegal"] += 1
            turns += c["turns"] - (c["first_turn"] is not None and c["first_turn"] == before)
            low = c["first_turn"] if low is None else low
            before = c["last_turn"] if c["last_turn"] is not None else before
        total["gaps"] = 0 if low is None else before - low + 1 - turns
        total["cost"], audit = grammar.repair([c["symbols"] for c in found]) if found else (0, "")
        return conv, [total[k] for k in STATS], audit

    def emit(rows):
        conv, stats, audit = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(stats, pa.list_(pa.int64())), pa.array(audit, pa.string())],
                                          names=["conv", "stats", "audit"])

    def run(batches):
        grammar, now, found, out = Grammar(rules, p.memo), None, None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                row = dict(zip(names, row))
                if found is None or row["conv"] != now:
                    if found is not None:
                        out.append(answer(now, found, grammar))
                    now, found = row["conv"], []
                if row["part"] is not None:
                    found.append(row)
            if out:
                yield emit(out)
                out = []
        if found is not None:
            yield emit([answer(now, found, grammar)])

    return both.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, "conv long, stats array<long>, audit string")


class Replay:
    """Plays edits over rows that come one by one: yields (role, text, letter) of the rows that the repaired conversation has."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = step(self.state)
            yield "assistant" if self.state == ASSISTANT else "user", "", "I"

    def row(self, role: str, text: str):
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = SYSTEM if role[:1] == "s" else step(self.state)
            yield role, text, "K"
        elif letter == "R":
            self.state = step(self.state)
            yield "assistant" if self.state == ASSISTANT else "user", text, "R"


def _played(conversations: DataFrame, p: RepairParams):
    """Edits and rows of a conversation one after another: (conv, kind, turn, role, text, stats), edits first."""
    rows = damaged(conversations)
    chunks = stage(chunked(marked(rows)))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    answers = solved(chunks, ids, learn(chunks, p), p)
    none = F.lit(None)
    both = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "h", none.cast("array<bigint>").alias("stats")).unionByName(
        answers.select("conv", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"),
                       none.cast("string").alias("h"), "stats"))
    order = [F.col("conv").asc_nulls_first(), F.col("kind").asc(), *_ordered()]
    return both.repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "turn", "role", "text", "stats")


def _events(batches):
    """(kind, conv, turn, role, text, stats) row by row."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(part.column(c).to_pylist() for c in ("kind", "conv", "turn", "role", "text", "stats")))


REPAIRED = "conv_id long, place long, turn long, role string, text string, edit string"


def repair(conversations: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the rows of the repaired conversations, from place 0 on.

    Rows are damaged as in ``repair_digests``, whose rules hold. edit is K (kept),
    R (another role) or I (inserted, without turn); rows that were deleted are
    missing, and so are conversations of which nothing is left.
    """
    def run(batches):
        replay, out, conv, place = None, [], None, 0
        for kind, c, turn, role, text, _ in _events(batches):
            if kind == 0:
                if replay is not None:
                    out += [(conv, place + i, None, *r) for i, r in enumerate(replay.inserted())]
                replay, conv, place = Replay(text), c, 0
            else:
                for r in replay.row(role, text):
                    out.append((conv, place, None if r[2] == "I" else turn, *r))
                    place += 1
            if len(out) > 1000:
                yield emit(out)
                out = []
        if replay is not None:
            out += [(conv, place + i, None, *r) for i, r in enumerate(replay.inserted())]
        if out:
            yield emit(out)

    def emit(rows):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in REPAIRED.split(", ")])

    return _played(conversations, params).mapInArrow(run, REPAIRED)


def repair_digests(conversations: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conv_id of (conv_id, turn, role, text).

    The rows are damaged first (see ``damaged``); a null role or text is one
    space, so such a text is blank, and a null conv_id is a conversation of its
    own. Rows stand by turn, null first, then by role and a hash of the text;
    rows equal in all of them are duplicates of the first. audit holds the
    letters of the cheapest edits, ASCII-least among equals. A conversation
    without rows has zeros, no edits and the hash of nothing. Other columns are
    not looked at. No rows, no rows.
    """
    def run(batches):
        replay = stats = None
        digest, begun, out = None, False, []

        def feed(rows):
            nonlocal begun
            for role, text, _ in rows:
                digest.update((("\n" if begun else "") + role + ":" + text).encode())
                begun = True

        def finish():
            feed(replay.inserted())
            out.append((conv, *stats, replay.audit, digest.hexdigest()))

        conv = None
        for kind, c, _, role, text, s in _events(batches):
            if kind == 0:
                if replay is not None:
                    finish()
                replay, stats, conv, digest, begun = Replay(text), s, c, hashlib.sha256(), False
            else:
                feed(replay.row(role, text))
            if len(out) > 1000:
                yield emit(out)
                out.clear()
        if replay is not None:
            finish()
        if out:
            yield emit(out)

    names = ["conv_id", *STATS, "audit", "repaired_sha256"]

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 7 else pa.string()) for i, c in enumerate(zip(*rows))], names=names)

    return _played(conversations, params).mapInArrow(run, ", ".join(f"{n} {'long' if i < 7 else 'string'}" for i, n in enumerate(names)))
