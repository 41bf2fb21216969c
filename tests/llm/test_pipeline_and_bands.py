import collections
import math
import random
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import fertility, mixing, packing, toxicity
from panelspark.llm.encoding import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


# ---- op 8: bands

def rounded(x, digits):
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def kept_by_hand(rows, p):
    """doc_id -> kept, from the measures of each document, with numpy quartiles."""
    kinds = {}
    cells = collections.defaultdict(list)
    for r in rows:
        group = f"lang {r['lang']}" if r["lang"] is not None else f"script {r['script']}"
        kinds[r["doc_id"]] = group, r["script"], int(math.floor(math.log2(max(1, r["n_words"]))))
        r["of_most"] = r["entropy"] / math.log2(max(2, r["n_tokens"]))
        cells[kinds[r["doc_id"]]].append({c: rounded(r[c], d) for c, d in fertility.METRICS.items()})

    def quartiles(found):
        return {c: np.quantile([f[c] for f in found], [0.25, 0.5, 0.75]) for c in fertility.METRICS}, max(1.0, math.sqrt(p.support / len(found)))

    def around(parts):
        return {c: (min(q[c][0] for q, _ in parts), min(q[c][1] for q, _ in parts), max(q[c][1] for q, _ in parts), max(q[c][2] for q, _ in parts)) for c in fertility.METRICS}, max(s for _, s in parts)

    def gather(test):
        return [f for kind, found in cells.items() if test(*kind) for f in found]

    everything = gather(lambda g, s, z: True)
    by_group = {(g, s): gather(lambda a, b, z: (a, b) == (g, s)) for g, s, _ in cells}
    bands = {}
    for group, script, size in cells:
        tries = [(0, gather(lambda g, s, z: (g, z) == (group, size)), p.support), (1, gather(lambda g, s, z: g == group and abs(z - size) <= 1), p.support),
                 (2, gather(lambda g, s, z: g == group), 3)]
        got = next(((level, around([quartiles(found)])) for level, found, least in tries if len(found) >= least), None)
        if got is None:
            same = [quartiles(f) for (g, s), f in by_group.items() if s == script and len(f) >= p.support]
            every = [quartiles(f) for f in by_group.values() if len(f) >= p.support] + [quartiles(everything)]
            got = (3, around(same)) if same else (4, around(every))
        bands[group, script, size] = got
    out = {}
    for r in rows:
        level, (band, scale) = bands[kinds[r["doc_id"]]]

        def distance(c, side):
            low, least, most, high = band[c]
            middle = least if side == "least" else most
            return (r[c] - middle) / max(scale * max(high - low, p.floor * middle), 1e-9)

        entropy = distance("entropy", "least") if level == 0 else min(max(distance("entropy", "least"), distance("of_most", "least")), 0.0)
        chars = distance("chars_per_token", "least")
        low, _, _, high = band["byte_share"]
        odd = (chars + entropy < -p.low or min(chars, entropy) < -p.alone or distance("chars_per_token", "most") > p.high
               or min(distance("entropy", "most"), distance("of_most", "most")) > p.high
               or distance("second_chars", "least") < -p.alone or distance("second_chars", "most") > p.high
               or r["byte_share"] > high + p.bytes * scale * max(high - low, p.byte_floor))
        out[r["doc_id"]] = not r["base_failed"] and not odd
    return out


def test_kept_equals_numpy_bands(spark):
    """All documents of a table, against quartiles and measures worked out in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = fertility.FertilityParams(model=public_tokenizers.path("piece_bpe_32k.model"), second=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = {r["doc_id"]: r for r in docs.collect()}
    got = [r.asDict() for r in fertility.rate(docs, p).collect()]
    assert len(got) == len(texts)
    pieces = sentencepiece.SentencePieceProcessor(model_file=p.model)
    ranks = Encoder(public_tokenizers.path("byte_bpe_50k.json"))  # checks that both libraries load beside each other
    assert len(ranks.ids(["some text"])[0]) > 0
    with open(p.second, "rb") as f:
        import base64
        other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    for r in got:
        text = texts[r["doc_id"]]["text"] or ""
        chars = sum(map(len, WORD.findall(text)))
        ids = pieces.encode(text)
        counts = np.array(list(collections.Counter(ids).values())) / max(1, len(ids))
        assert r["n_tokens"] == len(ids) and abs(r["chars_per_token"] - chars / max(1, len(ids))) < 1e-12
        assert abs(r["entropy"] + float((counts * np.log2(counts)).sum() if len(ids) else 0.0)) < 1e-9
        assert abs(r["second_chars"] - chars / max(1, len(other.encode_ordinary(text)))) < 1e-12
        r["lang"] = texts[r["doc_id"]]["lang"]
    want = kept_by_hand(got, p)
    assert {r["doc_id"]: r["kept"] for r in got} == want
    assert 0 < sum(want.values()) < len(want)


# ---- the pipeline

ABUSE = ["scoundrel", "blackguard", "nitwit", "poltroon"]


def planted(seed=3):
    """Documents with insults, repeated passages, near copies and odd rows; labels for a part of them."""
    r = random.Random(seed)
    vocab = [a + b + c for a in "bdfklm" for b in "aeiou" for c in ("n", "rt", "sh", "l")]

    def words(n):
        return [r.choice(vocab) for _ in range(n)]

    def lines(w):
        out = []
        while w:
            k = r.randint(3, 14)
            out.append(" ".join(w[:k]))
            w = w[k:]
        return "\n".join(out)

    passage = lines(words(60))
    rows = []
    for i in range(160):
        w = words(r.randint(15, 70))
        if i % 4 == 0:
            for _ in range(6):
                w.insert(r.randint(0, len(w)), r.choice(ABUSE))
        text = lines(w)
        if i % 9 == 2:
            text += "\n" + passage + "\n" + lines(words(12))
        rows.append((i, text, "en", f"s{i % 3}"))
    base = words(200)
    for k in range(6):  # near copies: one word in fifty changed, all on one line
        w = list(base)
        w[30 * k + 7] = "changed"
        rows.append((300 + k, " ".join(w), "en", "s1"))
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, " \n\t", "de", "s2"), (403, "short", "en", None), (3, "another text of the same number", "en", "s0"),
             (None, "no number at all", "en", "s1"), (404, "twice the same row", "en", "s2"), (404, "twice the same row", "en", "s2")]
    return rows, [(i, int(i % 4 == 0)) for i in range(160)]


def lines_by_hand(rows, least=10):
    """{(doc_id, text): cleaned text}: a line goes if a run of lines with ``least`` words through it stands earlier."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0))
    runs = {}
    units = {}
    for d, (i, t) in enumerate(docs):
        parts = t.split("\n")
        units[d] = [(k, x, len(WORD.findall(x))) for k, x in enumerate(parts) if WORD.search(x)]
        for a in range(len(units[d])):
            total, content = 0, []
            for b in range(a, len(units[d])):
                total += units[d][b][2]
                content.append(units[d][b][1])
                if total >= least:
                    runs.setdefault(tuple(content), []).append((d, a, b))
    gone = collections.defaultdict(set)
    for found in runs.values():
        for d, a, b in sorted(found)[1:]:
            gone[d] |= set(range(units[d][a][0], units[d][b][0] + 1))
    return {doc: "\n".join(x for k, x in enumerate(doc[1].split("\n")) if k not in gone[d]) for d, doc in enumerate(docs)}


def near_by_hand(rows, percent=80):
    """Rows that are no copy of a row with a smaller number."""
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), 1 << 62), i)
    return [row for k, row in enumerate(rows) if not sets[k] or row[0] is None or row[0] == least[find(k)]]


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    rows, labels = planted()
    names = ["doc_id", "text", "lang", "source", "n_chars", "_rid", "_runs", "a.b", "base", "target", "part", "last", "_size", "source_size", "h", "d"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names[5:])
    folder = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1] or ""), *names[5:]) for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    machine = model.machine()

    def table(df):
        assert df.columns == names
        found = [tuple(r) for r in df.collect()]
        assert all(r[5:] == tuple(names[5:]) for r in found)
        return sorted((r[:4] for r in found), key=repr)

    staged = {}
    for name, fn in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(fn(spark, docs, folder))
        staged[name] = table(docs)

    clean = [r for r in rows if model.scores(np.array([toxicity.features(r[1], machine, model.params.window, model.context)]))[0] < 0.5]
    assert staged["toxicity"] == sorted(clean, key=repr)
    held = [i for i in range(0, 160, 4)]
    assert not {r[0] for r in clean} & set(held) and len(clean) == len(rows) - len(held)
    cleaned = lines_by_hand([(i, t) for i, t, *_ in clean])
    lined = [(i, cleaned.get((i, t)), lang, s) for i, t, lang, s in clean]
    assert staged["line dedup"] == sorted(lined, key=repr) and sum(a != b for a, b in zip(lined, clean)) > 5
    apart = near_by_hand(lined)
    assert staged["near duplicates"] == sorted(apart, key=repr) and [r[0] for r in apart if r[0] in range(300, 306)] == [300]
    assert [r[1] for r in apart if r[0] == 3].count("another text of the same number") == 1

    # the mix: every document of a source equally often, those first in the seeded order once more
    import hashlib
    size = {k: len(WORD.findall(r[1] or "")) for k, r in enumerate(apart)}
    sources = sorted({r[3] for r in apart}, key=lambda s: (s is None, s or ""))
    sums = {s: sum(size[k] for k, r in enumerate(apart) if r[3] == s) for s in sources}
    goal = dict(zip(sources, mixing.targets([sums[s] for s in sources], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))], 1.5 * sum(sums.values()), 2)))
    mixed = []
    for s in sources:
        mine = sorted((hashlib.md5(f"mix-1|{'null' if r[0] is None else r[0]}".encode()).hexdigest(), k) for k, r in enumerate(apart) if r[3] == s)
        base = min(2, int(goal[s] // sums[s])) if sums[s] else 0
        extra, reach = (goal[s] - base * sums[s] if base < 2 else 0.0), 0
        groups = collections.defaultdict(list)
        for h, k in mine:
            groups[h].append(k)
        more = set()
        last = None
        for h in sorted(groups):
            total = sum(size[k] for k in groups[h])
            reach += total
            if reach - total / 2 <= extra:
                last = h
        if extra > 0 and last is not None:
            more = {k for h, k in mine if h <= last}
        for _, k in mine:
            mixed += [apart[k]] * (base + (k in more))
    assert staged["mixing"] == sorted(mixed, key=repr) and len(mixed) > 20

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t, *_ in mixed:
        n = len(encoder.ids([t])[0]) + 1
        want.update((i, k, a, b) for k, (a, b) in enumerate(packing.cut(n, 2048)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in pieces) == want
    held = collections.defaultdict(list)
    for r in pieces:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in held.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert [tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length").orderBy("doc_id", "piece", "length").collect()] == sorted(
        ((r["doc_id"], r["piece"], r["length"]) for r in pieces), key=lambda x: (x[0] is not None, x))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_learned_context_tells_reports_from_abuse(make, spark):
    """The same insult in toxic documents and, beside other words, in clean ones: what stands around it decides, in any language."""
    r = random.Random(4)
    vocab = [a + b + c for a in "bdfklm" for b in "aeiou" for c in ("n", "rt", "sh", "l")]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(vocab) for _ in range(30)]
        toxic = int(i % 3 == 0)
        if toxic:
            for _ in range(3):
                at = r.randint(0, len(w))
                w[at:at] = ["nitwitted", r.choice(["tu", "du"])]
        elif i % 20 == 1:
            at = r.randint(0, len(w))
            w[at:at] = ["zitierte", "er", "nitwitted", "wortlich"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    model = toxicity.fit(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.context["zitierte"] < -0.5 and model.context["wortlich"] < -0.5 and model.context["tu"] > 0.5
    abuse, report = "x tu nitwitted du x".split(), "x zitierte er nitwitted wortlich".split()
    assert toxicity.context(abuse, 2, 6, model.context) > 3 * toxicity.context(report, 3, 6, model.context)
    got = {x["doc_id"]: x["score"] for x in model.score(make(rows)).collect()}
    wrong = sum((got[i] >= 0.5) != bool(t) for i, _, t in labels)
    assert wrong <= 0.03 * len(labels)
