import collections
import hashlib
import random
import re

import numpy as np
import pytest

from panelspark.llm import hash_index, line_dedup, repeats, superminhash
from panelspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_copies(seed=0):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 30, 120, 300]))]
        for k in range(r.choice([1, 3, 25])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((n * 7 % 1009, (" " if k % 2 else "\n").join(w.upper() if k % 3 == 0 else w for w in words)))
            n += 1
    return rows


def brute_components(rows, percent):
    def shingles(t):
        w = WORD.findall((t or "").translate(LOW))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [2_000_000, 900])
def test_near_duplicates_equal_brute_force(make, block):
    rows = near_copies() + [(2000, None), (2001, ""), (2002, "only four words here"), (2003, "Only FOUR words\there")]
    got = superminhash.near_duplicates(make(rows), superminhash.NearDupParams(block=block)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_signature_stops_early_and_estimates():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 1 << 63, 100).astype(np.uint64)])
    x = superminhash.signatures([np.unique(a), np.unique(b), a[:1], a[:0]], 168)
    assert abs((x[0] == x[1]).mean() - 0.8) < 0.1
    assert len(set((x[2] >> np.uint64(32)).tolist())) == 168  # one element fills each slot at another level
    assert (x[3] == np.iinfo(np.uint64).max).all()


def test_near_duplicates_odd_rows(odd, make):
    got = superminhash.near_duplicates(odd).collect()
    assert len(got) == 7 and all(r["kept"] for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {1: 0, 2: 0, 3: 0, None: 1, 4: 1, 5: 2}
    assert superminhash.near_duplicates(make([])).collect() == []


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(5, 5), (None, 3)] + [(1000, i) for i in range(1001, 1100)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and b is not None:
            for n in (a, b):
                root.setdefault(n, n)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and b is not None and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root


@pytest.mark.parametrize("params", [hash_index.IndexParams(), hash_index.IndexParams(bucket_bytes=40, max_depth=6, key_bits=3)])
def test_exact_duplicates(make, params):
    rows = [(i, f"Text {i % 7}" if i % 3 else f"TEXT {i % 7}") for i in range(60)] + [(70, None), (71, ""), (72, "É"), (73, "é")]
    got = {r["doc_id"]: r for r in hash_index.exact_duplicates(make(rows), params).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOW)].append(i)
    for t, ids in groups.items():
        for i in ids:
            assert tuple(got[i])[:4] == (i, max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(rows)


def test_exact_duplicates_odd_rows(odd, make):
    got = hash_index.exact_duplicates(odd).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got) == [
        (0, 0, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True)]
    assert hash_index.exact_duplicates(make([])).collect() == []


def test_directory_splits_what_is_too_full():
    found = hash_index.split_directory({0: 10, 1: 10, 2: 1, 7: 1}, hash_index.IndexParams(bucket_bytes=10, max_depth=3))
    assert found == [(0, 3), (1, 3), (2, 2), (4, 1)]


def test_maximal_repeats_equal_brute_force():
    r = random.Random(5)
    for _ in range(30):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 30))) for _ in range(3)]
        texts.append(texts[0][3:] + texts[1])
        want = set()
        places = collections.defaultdict(set)
        for t, x in enumerate(texts):
            for a in range(len(x)):
                for b in range(a + 4, len(x) + 1):
                    places[x[a:b]].add((t, a))
        for s, at in places.items():
            left = {texts[t][a - 1] if a else (t, "start") for t, a in at}
            right = {texts[t][a + len(s)] if a + len(s) < len(texts[t]) else (t, "end") for t, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(s), frozenset(at)))
        assert {(n, frozenset(m)) for n, m in repeats.maximal_repeats(texts, 4)} == want


@pytest.mark.parametrize("block", [16_000, 2])
def test_repeated_bytes_equal_brute_force(make, block):
    r = random.Random(2)
    shared = ["".join(r.choice("abcé \n") for _ in range(n)) for n in (60, 90, 45)]
    rows = [(i, "".join(r.choice("abcdefghij ") for _ in range(r.randrange(0, 80))) + r.choice([*shared, ""]) + r.choice([shared[0][7:], "ab" * 40, ""]))
            for i in range(60)] + [(90, None), (91, ""), (92, shared[1]), (93, shared[1])]
    got = {x["doc_id"]: x for x in repeats.remove_repeats(make(rows), repeats.RepeatParams(length=40, gram=20, block=block)).collect()}
    count = collections.Counter((t or "").encode()[a:a + 40] for _, t in rows for a in range(len((t or "").encode()) - 39))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 39):
            if count[b[a:a + 40]] > 1:
                gone[a:a + 40] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        assert tuple(got[i])[1:5] == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_repeat_groups_equal_brute_force(make):
    r = random.Random(4)
    shared = ["".join(r.choice("abcé \n") for _ in range(n)) for n in (60, 400, 45)]
    rows = [(i, "".join(r.choice("abcdefghij ") for _ in range(r.randrange(0, 80))) + r.choice([*shared, ""]) + r.choice([shared[0][7:], shared[1][9:300], "ab" * 40, ""]))
            for i in range(40)] + [(90, None), (91, ""), (92, shared[1]), (93, shared[1]), (94, shared[1]), (95, "x" + shared[1])]
    got = collections.defaultdict(set)
    for x in repeats.repeat_groups(make(rows), repeats.RepeatParams(length=40, gram=20)).collect():
        assert (x["doc_id"], x["place"]) not in got[x["group"], x["length"]]
        got[x["group"], x["length"]].add((x["doc_id"], x["place"]))
    want = [(n, frozenset((rows[t][0], a) for t, a in at)) for n, at in repeats.maximal_repeats([(t or "").encode() for _, t in rows], 40)]
    assert sorted(((n, sorted(at)) for (_, n), at in got.items())) == sorted((n, sorted(at)) for n, at in want)
    assert max(n for n, _ in want) >= 400
    assert repeats.repeat_groups(make([])).collect() == []


def test_repeats_odd_rows(odd, make):
    got = repeats.remove_repeats(odd).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in got} == {1: (0, 0), 2: (0, 0), 3: (4, 0), None: (10, 0), 4: (14, 0), 5: (300_000, 300_000)}
    assert repeats.remove_repeats(make([])).collect() == []


def test_line_dedup(make):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, f"{long}\nalpha"), (2, f"beta\n{long}\n\ngamma"), (3, "a b c d\n\ne f g h\ni j k l"), (4, "x\na b c d\ne f g h\ni j k l\nend"),
            (5, "a b c d\ne f g h"), (6, f"{long}\n{long}"), (7, None), (8, "")]
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(make(rows)).collect()}
    want = {1: (2, 0, 0, rows[0][1]), 2: (4, 1, 1, "beta\n\ngamma"), 3: (4, 0, 0, rows[2][1]), 4: (5, 3, 1, "x\nend"), 5: (2, 0, 0, rows[4][1]),
            6: (2, 2, 2, ""), 7: (0, 0, 0, None), 8: (1, 0, 0, "")}
    assert {i: (r["n_lines"], r["n_removed"], r["n_runs"], r["text"]) for i, r in got.items()} == want
    assert set(got[1].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_removed", "n_runs"}


def test_line_dedup_odd_rows(odd, make):
    got = line_dedup.drop_repeated_lines(odd)
    assert got.count() == 7 and set(odd.columns) <= set(got.columns)
    assert [r["n_removed"] for r in got.collect()] == [0] * 7
    assert line_dedup.drop_repeated_lines(make([])).collect() == []


def brute_lines(rows, least=10):
    """Every run of lines with words, compared with every earlier place; rows in the order of doc_id."""
    units = [(i, [(pos, line, len(WORD.findall(line))) for pos, line in enumerate(text.split("\n")) if WORD.search(line)]) for i, text in rows]
    seen, gone = set(), collections.defaultdict(set)
    for i, found in units:
        for a in range(len(found)):
            for b in range(a + 1, len(found) + 1):
                run = tuple(line for _, line, _ in found[a:b])
                if sum(w for *_, w in found[a:b]) >= least:
                    if run in seen:
                        gone[i].add((found[a][0], found[b - 1][0]))
                    seen.add(run)
    out = {}
    for i, text in rows:
        runs = []
        for a, b in sorted(gone[i]):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        lines = text.split("\n")
        kept = [line for pos, line in enumerate(lines) if not any(a <= pos <= b for a, b in runs)]
        out[i] = (len(lines), len(lines) - len(kept), len(runs), "\n".join(kept))
    return out


def test_line_dedup_takes_runs_to_their_ends(make):
    long = "one two three four five six seven eight nine ten"
    r = random.Random(11)
    lines = [long, "a b", "c", "d e f g", "h i j k l m", "", " ", "n o p q r s t u v w x"]
    # a run that ends in a short line, at the end of a text, before other text, and longer at the second place than at the first
    rows = [(1, f"{long}\nalpha beta"), (2, f"{long}\nalpha beta"), (3, f"{long}\nalpha beta\nother words"), (4, f"x\n{long}\nother words"),
            (5, f"{long}\n\n{long} eleven\nlast"), (6, f"{long}\n\n{long} eleven\nlast")]
    rows += [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 9)))) for i in range(10, 60)]
    got = {x["doc_id"]: (x["n_lines"], x["n_removed"], x["n_runs"], x["text"]) for x in line_dedup.drop_repeated_lines(make(rows)).collect()}
    want = brute_lines(rows)
    assert got == want
    assert want[2] == (2, 2, 1, "") and want[3][3] == "other words" and want[6] == (4, 4, 1, "")
