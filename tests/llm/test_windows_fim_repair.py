import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import conversations as conv
from panelspark.llm import fill_middle as fim
from panelspark.llm import window_dedup as wd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- op 11

def windows_by_hand(rows, width):
    """{(doc_id, text): (n_words, spans, kept)} by looking at every window's words."""
    texts = sorted({(i is None, i, t or "") for i, t in rows}, key=lambda r: (r[0], r[1] or 0))
    first, out = {}, {}
    for _, i, t in texts:
        words = WORD.findall(t)
        for s in range(len(words) - width + 1):
            first.setdefault(tuple(words[s:s + width]), (i, t, s))
    for _, i, t in texts:
        words = WORD.findall(t)
        gone = set()
        for s in range(len(words) - width + 1):
            if first[tuple(words[s:s + width])] != (i, t, s):
                gone |= set(range(s, s + width))
        out[i, t] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


@pytest.mark.parametrize("slice_, bucket", [(1 << 21, 1 << 25), (300, 400)])
def test_windows_equal_brute_force(make, slice_, bucket):
    r = random.Random(7)
    vocab = ["a", "bb", "Bb", "é", "中", "x,", "the", "q"]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(60):
        words = [r.choice(vocab) for _ in range(r.choice([0, 3, 7, 30, 80]))]
        for _ in range(r.randint(0, 2)):
            at, a = r.randint(0, len(words)), r.randint(0, 30)
            words[at:at] = passage[a:a + r.randint(5, 30)]
        rows.append((i * 3 - 20, r.choice([" ", "\n", " \t"]).join(words)))
    rows += [(500, rows[5][1]), (501, "tick tock " * 50), (502, "one " * 45), (2, None), (503, "tock tick " * 20)]
    p = wd.WindowParams(words=8, gram=3, slice=slice_, bucket=bucket)
    got = {(x.doc_id, x.text): x for x in _with_text(wd.drop_repeated_windows(make(rows), p), rows)}
    want = windows_by_hand(rows, 8)
    assert len(got) == len(rows)
    for (i, t), (n, removed, kept) in want.items():
        x = got[i, t]
        assert (x.n_words, x.n_removed, x.kept, x.kept_sha256) == (n, removed, kept, sha(kept))
        assert sum(s["to"] - s["from"] for s in x.spans) == removed
        assert all(a["to"] < b["from"] for a, b in zip(x.spans, x.spans[1:]))


class _Row:
    def __init__(self, row, text):
        self.__dict__.update(row.asDict(), text=text)


def _with_text(df, rows):
    texts = {i: t or "" for i, t in rows}
    return [_Row(r, texts[r["doc_id"]]) for r in df.collect()]


def test_windows_odd_rows(odd, make, spark):
    got = {r["doc_id"]: r for r in wd.drop_repeated_windows(odd).collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0 and got[1]["kept_sha256"] == sha("")
    assert (got[4]["n_removed"], got[4]["n_words"]) == (0, 3) and got[None]["kept"] == "alone here"
    # "long word" 30,000 times: the first window of either beginning stays
    assert (got[5]["n_words"], got[5]["n_removed"], got[5]["kept"]) == (60_000, 59_998, "long word")
    assert wd.drop_repeated_windows(odd).count() == odd.count()
    assert wd.drop_repeated_windows(odd.limit(0)).count() == 0
    # texts of one doc_id are documents of their own; rows equal in both are one
    long, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = make([(1, long), (5, long), (5, other), (5, other)])
    assert sorted((r["doc_id"], r["n_removed"]) for r in wd.drop_repeated_windows(rows).collect()) == [(1, 0), (5, 0), (5, 0), (5, 30)]


def test_whole_numbers_pack_and_unpack():
    r = np.random.default_rng(3)
    for x in (np.array([], np.int64), np.array([7]), np.array([-(1 << 63), (1 << 63) - 1]), r.integers(0, 70_000, 999), r.integers(-5, 5, 10)):
        assert wd.unpacked(wd.packed(x.astype(np.int64))).tolist() == x.tolist()


# ---- op 12

def fim_by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    x = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("block", [1, 3, 512])
def test_fill_in_middle_equals_brute_force(make, block):
    r = random.Random(block)
    parts = ["word", "é", "中", "😀", " ", "\n", "<", ">", "<P", "S>", "M", "Zz", "\x00", "1", "aéb", "ﬀ"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.choice([0, 1, 2, 5, 40, 600])))) for i in range(300)]
    rows += [(1000, "has <M> in it"), (1001, "<P>"), (1002, None), (None, "no id at all"), (1003, "letters" * 500)]
    got = {r["doc_id"]: r for r in fim.fill_in_middle(make(rows), fim.FimParams(block=block)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert (got[i]["n"], got[i]["form"], got[i]["prefix_chars"], got[i]["middle_chars"], got[i]["output"]) == fim_by_hand(i, t), i
    digests = {r["doc_id"]: r for r in fim.digests(make(rows), fim.FimParams(block=block)).collect()}
    assert all(digests[i]["restored_sha256"] == sha(t or "") and digests[i]["output_sha256"] == sha(got[i]["output"]) for i, t in rows)
    assert len({g["form"] for g in got.values()}) == 3


def test_fill_in_middle_odd_rows(odd):
    got = fim.digests(odd).collect()
    assert len(got) == odd.count() and fim.digests(odd.limit(0)).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[1]["form"] == by[2]["form"] == "plain" and by[1]["n"] == 0 and by[1]["prefix_chars"] is None
    assert by[5]["restored_sha256"] == sha("long word " * 30_000) and by[5]["n"] == 120_000


# ---- op 13

def damage(rows):
    """Rows (conv_id, turn, role, text) after the damage, by conversation and in order."""
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        out[c] += [(turn, role, text)] * (2 if draw == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        chars = WORD.findall(text)
        out.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    return out


LEGAL = re.compile(r"(s?(ua)+)?")
LEGAL_START = re.compile(r"(s|s?(ua)*u?)")


def edits_by_hand(rows, found):
    """(cost, audit, repaired rows) over all edits whose roles so far can still become legal, row by row."""
    best = {"": (0, "", ())}  # by the initials kept so far, their last two letters being all that matters

    def short(initials):
        return initials if len(initials) < 3 else initials[-1] + "+"

    def legal(initials):
        return LEGAL_START.fullmatch(initials)

    def put(new, initials, option):
        if initials not in new or option[:2] < new[initials][:2]:
            new[initials] = option

    def extend(table):
        for _ in range(3):  # up to three insertions in a row
            for initials, (cost, audit, kept) in list(table.items()):
                for r in ("user", "assistant"):
                    full = "".join(k[0][:1] for k in kept) + r[0]
                    if legal(full):
                        put(table, _state(full), (cost + 5, audit + "I", (*kept, (r, ""))))
        return table

    def _state(full):
        return "" if not full else full[-1]

    for (_, role, text), fault in zip(rows, found):
        new = {}
        for initials, (cost, audit, kept) in extend(dict(best)).items():
            full = "".join(k[0][:1] for k in kept)
            put(new, initials, (cost + 2, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            for r, paid, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                if legal(full + (r[:1] or "?")):
                    put(new, _state(full + r[:1]), (cost + paid + more, audit + letter, (*kept, (r, text))))
        best = new
    ends = [o for o in extend(dict(best)).values() if LEGAL.fullmatch("".join(k[0][:1] for k in o[2]))]
    return min(ends, key=lambda o: o[:2])


def all_edits(rows, found):
    """(cost, audit) by trying every edit sequence with up to two insertions at a place."""
    inserted = ["", *("u", "a"), *map("".join, itertools.product("ua", repeat=2))]
    options = []
    for (_, role, _), fault in zip(rows, found):
        own = [("D", 2, "")]
        if fault not in ("blank", "duplicate"):
            extra = 5 * (fault == "truncated")
            own += [("K", extra, role[:1] or "?"), ("R", 1 + extra, "u"), ("R", 1 + extra, "a")]
        options.append([("I" * len(i) + l, 5 * len(i) + c, i + k) for i in inserted for l, c, k in own])
    options.append([("I" * len(i), 5 * len(i), i) for i in inserted])
    return min((sum(c for _, c, _ in way), "".join(l for l, _, _ in way)) for way in itertools.product(*options)
               if LEGAL.fullmatch("".join(k for _, _, k in way)))


def summary(rows):
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, kept = edits_by_hand(rows, found)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept)))


def dialogues(n, longest, seed):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "u", ""]
    texts = ["Hi.", "Yes!", "no end", " ", "", "Fine. \t", "what?", "long " * 9]
    rows = []
    for c in range(n):
        alternate = r.random() < 0.5
        for t in range(r.randint(1, longest)):
            role = ["user", "assistant"][t % 2] if alternate and r.random() < 0.8 else r.choice(roles)
            rows.append((c, t if r.random() < 0.95 else t + 3, role, r.choice(texts) + (str(t) + "." if r.random() < 0.7 else "")))
    return rows


CONV = "conv_id long, turn long, role string, text string"


def test_repair_equals_brute_force(spark):
    rows = dialogues(300, 12, 5)
    rows += [(1000, t, ["user", "assistant", "tool"][t % 7 % 3], f"said {t}.") for t in range(700)]  # a long one
    rows += [(1001, None, "user", "a."), (1001, None, None, "b."), (1001, 4, "assistant", None), (None, 1, "user", "null id"), (None, 2, "assistant", "x.")]
    rows += [(2000 + k, 0, "user", "dropped?") for k in range(60)]
    want = {c: summary(x) for c, x in damage(rows).items()}
    df = spark.createDataFrame(rows, CONV).withColumn("cost", F.lit("x")).withColumn("kind", F.lit(1))
    got = {r["conv_id"]: tuple(r)[1:] for r in conv.repair_digests(df.repartition(5)).collect()}
    assert got == want
    assert any(not x for x in damage(rows).values()) and all(any(x in w[6] for w in want.values()) for x in "KRD")
    again = {r["conv_id"]: tuple(r)[1:] for r in conv.repair_digests(df, conv.RepairParams(rounds=0)).collect()}
    assert again == want
    # the repaired rows themselves
    repaired = {}
    for r in conv.repair(df).orderBy("conv_id", "place").collect():
        repaired.setdefault(r["conv_id"], []).append(r)
    for c, w in want.items():
        lines = repaired.get(c, [])
        assert [r["place"] for r in lines] == list(range(len(lines)))
        assert sha("\n".join(f"{r['role']}:{r['text']}" for r in lines)) == w[-1]
        assert "".join(r["edit"] for r in lines) == w[6].replace("D", "")


def test_edits_equal_every_edit_sequence():
    r = random.Random(11)
    grammar = conv.Grammar([(chr(0x100), "u", "a"), (chr(0x101), "D", "D"), (chr(0x102), chr(0x100), chr(0x100)), (chr(0x103), "x", "U")], 10)
    for _ in range(60):
        symbols = "".join(r.choice(conv.SYMBOLS) for _ in range(r.randint(0, 3)))
        rows = [(0, {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}[s.lower()], "") for s in symbols]
        found = ["blank" if s == "D" else "truncated" if s.isupper() else "" for s in symbols]
        assert grammar.repair([symbols]) == all_edits(rows, found), symbols
        assert grammar.repair([symbols]) == edits_by_hand(rows, found)[:2]
    for _ in range(200):
        symbols = "".join(r.choice("uauauasxUAD") for _ in range(r.randint(0, 40)))
        plain = conv.Grammar([], 10)
        cut = r.randint(0, len(symbols))
        assert grammar.repair([symbols]) == plain.repair([symbols]) == grammar.repair([symbols[:cut], symbols[cut:]])


def test_rules_are_shared_and_learned_from_all(spark):
    chunks = spark.createDataFrame([("uaua",)] * 5 + [("suaua",)] * 3 + [("xx",)], "symbols string")
    rules = conv.learn(chunks, conv.RepairParams(rounds=3))
    assert rules[0][1:] == ("u", "a") and any(r[1:] == (rules[0][0], rules[0][0]) for r in rules)
    grammar = conv.Grammar(rules, 10)
    name = next(r[0] for r in rules if r[1:] == (rules[0][0], rules[0][0]))
    assert grammar.compressed("uaua") == name and grammar.matrix[name][conv.START, conv.ASSISTANT][0] == 0
    assert conv.flat(grammar.matrix[name][conv.START, conv.ASSISTANT][1]) == "KKKK"


def test_repair_odd_tables(spark):
    assert conv.repair_digests(spark.createDataFrame([], CONV)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, None, None, None), (1, None, None, None)], CONV)
    got = {r["conv_id"]: r for r in conv.repair_digests(odd).collect()}
    want = {c: summary(x) for c, x in damage([tuple(r) for r in odd.collect()]).items()}
    assert {c: tuple(r)[1:] for c, r in got.items()} == want
