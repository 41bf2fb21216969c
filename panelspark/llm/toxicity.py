"""Toxicity from a learned lexicon, matched with spelling mistakes, and weighed by context.

Word beginnings that mark toxic documents among the labelled ones make a trie.
The Levenshtein automata of all its terms run together over a word: a state is
the set of trie nodes reached and the mistakes made so far, and the transitions
that words ask for are kept, so a word is read once, letter by letter. Matches
are weighed by their surroundings: what stands around the matches of toxic and
of clean labelled documents tells, in whatever language, which words speak for
a quotation or report and which for abuse, and what quotation marks are worth.
A logistic model of a few sums over the matches gives the score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.stage import stage
from panelspark.llm import textbytes as tb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = " .,;:!?\"'`()[]{}<>|«»“”„‘’*#$%&_~-…¡¿"
#: What is believed of some surroundings before any are seen: log odds of abuse.
PRIOR = {"\0quoted": -1.2, **dict.fromkeys("said says say wrote writes quoted quote quotes called calls word words term terms reported report".split(), -0.5),
         **dict.fromkeys("you your yours you're ur u".split(), 0.26)}
OPEN, CLOSE = "\"“„«", "\"”“»"
FEATURES = 7


@dataclass(frozen=True)
class ToxicityParams:
    """``sample`` bounds the labelled rows that the lexicon and the model are learned from.

    A beginning of ``shortest`` to ``longest`` letters becomes a term with
    ``support`` distinct toxic documents and a log odds of ``odds``. One mistake
    is allowed from ``one`` letters on, two from ``two`` on. The context is
    ``window`` words to either side; its weights, ``around`` at most, count as
    if PRIOR had been seen in ``belief`` documents.
    """
    sample: int = 20_000
    shortest: int = 3
    longest: int = 32
    support: int = 6
    odds: float = 2.5
    one: int = 5
    two: int = 8
    window: int = 6
    around: int = 2000
    belief: float = 20.0


def word_of(raw: str) -> str:
    return raw.strip(EDGE).lower()


@dataclass
class Automaton:
    """Terms as (letters, whole word or beginning, weight), compiled step by step into one deterministic machine."""
    terms: list
    one: int
    two: int
    held: int = 8_000  # states that are kept; beyond it they are worked out anew
    states: dict = field(default_factory=dict)
    moves: list = field(default_factory=list)
    found: list = field(default_factory=list)
    words: dict = field(default_factory=dict)

    def __post_init__(self):
        self.children, self.term, self.depth, self.room = [{}], [None], [0], [0]
        for letters, whole, weight in self.terms:
            node = 0
            allowed = 0 if len(letters) < self.one else 1 if len(letters) < self.two else 2
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.depth.append(self.depth[node] + 1)
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], allowed)
            self.term[node] = (letters, whole, weight, allowed)
        self.room[0] = max(self.room)
        self._begin()

    def _begin(self) -> None:
        """Drop the states that words have asked for; only the first one is left."""
        self.states.clear()
        self.moves.clear()
        self.found.clear()
        self.start = self._state({(0, 0, ""): None})

    def _state(self, members: dict) -> int:
        """The state of (node, mistakes, letter owed by an exchange of neighbours), with skipped letters of terms added."""
        best: dict = {}
        todo = [(e, node, owed) for node, e, owed in members]
        while todo:
            e, node, owed = todo.pop()
            if e > self.room[node] or best.get((node, owed), 9) <= e:
                continue
            best[node, owed] = e
            if not owed:
                todo += [(e + 1, child, "") for child in self.children[node].values()]
        key = frozenset((node, e, owed) for (node, owed), e in best.items())
        if key not in self.states:
            self.states[key] = len(self.moves)
            self.moves.append({})
            ends = [(e, -len(self.term[n][0]), n) for n, e, owed in key if not owed and self.term[n] and e <= self.term[n][3]]
            self.found.append((key, sorted(ends)))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        members: dict = {}
        for node, e, owed in self.found[state][0]:
            if owed:
                if c == owed:
                    members[node, e, ""] = None
                continue
            members[node, e + 1, ""] = None  # a letter too many
            for letter, child in self.children[node].items():
                members[child, e + (letter != c), ""] = None
                if letter != c and c in self.children[child]:
                    members[self.children[child][c], e + 1, letter] = None  # neighbours exchanged
        nxt = self.moves[state][c] = self._state(members) if members else -1
        return nxt

    def match(self, raw: str) -> tuple[float, int] | None:
        """(weight, mistakes) of the best term in a word; a beginning may be followed by anything."""
        if raw in self.words:
            return self.words[raw]
        if len(self.moves) > self.held:
            self._begin()
        word, state, best = word_of(raw), self.start, None
        for i, c in enumerate(word):
            nxt = self.moves[state].get(c)
            state = self._move(state, c) if nxt is None else nxt
            key, ends = self.found[state]
            if not key:
                break
            for e, _, node in ends:
                if (i == len(word) - 1 or not self.term[node][1]) and (best is None or (e, -self.term[node][2]) < best[:2]):
                    best = (e, -self.term[node][2])
        out = None if best is None else (-best[1], best[0])
        if len(self.words) >= 50_000:
            self.words.clear()
        self.words[raw] = out
        return out


def surroundings(raw: list[str], at: int, window: int) -> set[str]:
    """The words around a match, and whether it stands between quotation marks."""
    a, b = max(0, at - window), min(len(raw), at + window + 1)
    near = {word_of(w) for w in [*raw[a:at], *raw[at + 1:b]]} - {""}
    opened = any(w[:1] in OPEN for w in raw[a:at + 1] if w)
    closed = any(w.rstrip(".,;:!?")[-1:] in CLOSE for w in raw[at:b] if w)
    return near | {"\0quoted"} if opened and closed else near


def context(raw: list[str], at: int, window: int, weights: dict[str, float] = PRIOR) -> float:
    """How far a match at a word is meant: 1 alone, less among what surrounds quotations, more among what surrounds abuse."""
    total = sum(weights.get(w, 0.0) for w in surroundings(raw, at, window))
    return math.exp(max(-2.0, min(1.0, total)))


def features(text: str | None, machine: Automaton, window: int, weights: dict[str, float] = PRIOR) -> list[float]:
    """Sums over the matches of a whole text; all zero for a text without any."""
    raw = WORD.findall(text or "")
    exact = fuzzy = top = hits = meant = 0.0
    known = machine.words
    for i in [i for i, w in enumerate(raw) if (known[w] if w in known else machine.match(w))]:
        weight, mistakes = machine.match(raw[i])
        c = context(raw, i, window, weights)
        value = weight * c
        hits += 1
        meant += c
        if mistakes:
            fuzzy += value / (1 + mistakes)
        else:
            exact += value
            top = max(top, value)
    n = max(1, len(raw))
    return [math.log1p(exact), math.log1p(fuzzy), top, math.log1p(hits), 100.0 * exact / (n + 20), 100.0 * fuzzy / (n + 20), meant / max(1.0, hits)]


def learn_context(stats: list[tuple[str, int, int]], toxic: int, clean: int, p: ToxicityParams) -> dict[str, float]:
    """Log odds of abuse of what stands around matches, from (what, toxic documents, clean documents) among documents with a match.

    The odds of few documents give way to PRIOR, and to 0 where that says
    nothing; without clean documents that have a match nothing is learned.
    """
    out = dict(PRIOR)
    for what, a, b in stats if clean and toxic else []:
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        out[what] = (odds * (a + b) + PRIOR.get(what, 0.0) * p.belief) / (a + b + p.belief)
    kept = sorted(((w, x) for w, x in out.items() if abs(x) >= 0.2), key=lambda wx: (-abs(wx[1]), wx[0]))[:p.around]
    return dict(kept)


def learn_terms(stats: list[tuple[str, int, int]], toxic: int, clean: int, p: ToxicityParams) -> list[tuple[str, bool, float]]:
    """Terms from (beginning, toxic documents, clean documents); a beginning that ends with NUL is a whole word.

    A beginning is taken where it passes and its shorter ones do not; it is then
    prolonged as long as nearly all of its toxic documents go along.
    """
    count = {s: (a, b) for s, a, b in stats}

    def odds(s):
        a, b = count[s]
        return math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))

    longer: dict[str, list[str]] = {}
    for s in count:
        longer.setdefault(s[:-1], []).append(s)
    good = {s for s, (a, b) in count.items() if a >= p.support and not s.endswith("\0") and odds(s) >= p.odds}
    terms = {}
    for s in good:
        if any(s[:k] in good for k in range(p.shortest, len(s))):
            continue
        whole, a = False, count[s][0]
        while True:
            nxt = max(longer.get(s, []), key=lambda x: (count[x][0], x), default=None)
            if nxt is None or count[nxt][0] < 0.9 * a:
                break
            if nxt.endswith("\0"):
                whole = True
                break
            s = nxt
        terms[s] = (s, whole, odds(s))
    return sorted(terms.values())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        m = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (m * (1 - m))[:, None]).T @ x + penalty, x.T @ (y - m) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    terms: list
    weights: list
    params: ToxicityParams
    context: dict = field(default_factory=lambda: dict(PRIOR))

    def machine(self) -> Automaton:
        return Automaton(self.terms, self.params.one, self.params.two)

    def scores(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))

    def score(self, docs: DataFrame) -> DataFrame:
        """All columns of ``docs`` with a column ``score``; a column of that name is replaced. Null text is the empty text."""
        model = self
        rest = [c for c in docs.columns if c != "score"]

        def run(batches):
            machine = model.machine()
            for part in tb.parts(batches, f"_{rest.index('text')}"):
                x = np.array([features(t.as_py(), machine, model.params.window, model.context) for t in part.column(f"_{rest.index('text')}")]).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([*(part.column(f"_{i}") for i in range(len(rest))), pa.array(model.scores(x), pa.float64())],
                                                 names=[*(f"_{i}" for i in range(len(rest))), "score"])

        own = docs.withColumn("text", F.col("text").cast("string"))
        own = own.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)))
        out = own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())]))
        return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(rest)), "score")


def held_out():
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn from at most ``sample`` labelled rows that are not held out, chosen by a hash of doc_id.

    Of texts with one smallest shingle hash, so of copies and most near copies,
    one counts. Rows without a label, text or doc_id teach nothing,
    and of two labels for a doc_id the higher counts. Without both classes the
    model scores everything by the share of toxic rows.
    """
    p = params
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = stage(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample))  # so its size is bounded
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def sketched(batches):
        for part in tb.parts(batches, "text"):
            low = [int(s[0]) - (1 << 63) if len(s) else 0 for s in tb.shingles(*tb.flat(part.column("text")))]
            yield part.append_column("key", pa.array(low, pa.int64()))

    rows = rows.where("text IS NOT NULL").select("text", "toxic").mapInArrow(sketched, "text string, toxic int, key long")
    rows = stage(rows.groupBy("key").agg(F.max(F.struct("toxic", "text")).alias("r")).select("r.*"))
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    clean, toxic = totals.get(0, 0), sum(n for t, n in totals.items() if t)
    if not clean or not toxic:
        share = (toxic + 0.5) / (toxic + clean + 1)
        return ToxicityModel([], [0.0] * FEATURES + [math.log(share / (1 - share))], p)

    def begins(batches):
        held: dict[str, list[int]] = {}
        for part in tb.parts(batches, "text"):
            for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                seen = set()
                for w in {word_of(w) for w in WORD.findall(text)}:
                    seen.update(w[:k] for k in range(p.shortest, min(len(w), p.longest) + 1))
                    if p.shortest <= len(w) <= p.longest:
                        seen.add(w + "\0")
                for s in seen:
                    held.setdefault(s, [0, 0])[0 if label else 1] += 1
            if len(held) > 200_000:
                yield _counts(held)
                held = {}
        yield _counts(held)

    stats = rows.select("text", "toxic").mapInArrow(begins, "s string, a long, b long").groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ratio = math.exp(p.odds) * toxic / clean
    stats = stats.where((F.col("a") >= 0.9 * p.support) & (F.col("a") >= F.col("b") * ratio * 0.5))
    terms = learn_terms([(r["s"], r["a"], r["b"]) for r in stats.collect()], toxic, clean, p)  # bounded by the sample
    model = ToxicityModel(terms, [0.0] * (FEATURES + 1), p)

    def around(batches):
        machine, held = model.machine(), {}
        for part in tb.parts(batches, "text"):
            for text, label in zip(part.column("text"), part.column("toxic").to_pylist()):
                raw = WORD.findall(text.as_py() or "")
                hits = [i for i, w in enumerate(raw) if machine.match(w)]
                seen = set().union(*(surroundings(raw, i, p.window) for i in hits)) - {word_of(raw[i]) for i in hits}
                for s in seen | {""} if hits else ():  # the empty word counts documents with a match
                    held.setdefault(s, [0, 0])[0 if label else 1] += 1
            if len(held) > 200_000:
                yield _counts(held)
                held = {}
        yield _counts(held)

    near = rows.select("text", "toxic").mapInArrow(around, "s string, a long, b long").groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    near = {r["s"]: (r["a"], r["b"]) for r in near.where("a + b >= 5").collect()}  # bounded by the sample
    matched = near.pop("", (0, 0))
    model.context = learn_context([(s, a, b) for s, (a, b) in sorted(near.items())], *matched, p)

    def measure(batches):
        machine = model.machine()
        for part in tb.parts(batches, "text"):
            x = [features(t.as_py(), machine, p.window, model.context) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column("toxic")], names=["x", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int").orderBy("toxic", "x").collect()  # bounded by the sample
    x, y = np.array([r["x"] for r in seen]), np.array([float(r["toxic"] > 0) for r in seen])
    model.weights = fit_logistic(x, y).tolist()
    return model


def _counts(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()),
                                       pa.array([v[1] for v in held.values()], pa.int64())], names=["s", "a", "b"])
