"""Operators in free style against brute force or library."""

import base64
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, chat, html, jaccard, passages, ppm, tiling
from quillon.llm._text import SPACE, Words, pieces

LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 140))) for _ in range(60)]
    out = list(base)
    for t in base[:25]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out += [" ".join(w), t.upper(), t]
    shared = " ".join(rng.choices(vocabulary, k=70))
    out += [f"{base[i]} {shared} {base[i + 1]}" for i in range(30, 36)]
    return [(i, t) for i, t in enumerate(out)] + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "One  two"), (9006, "b " * 3000), (None, base[0]), (3, base[3])]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id bigint, text string").withColumn("component_id", F.lit("clash")).repartition(3)


def test_words_and_pieces():
    texts = ["a b\x0bC", None, "", "é  日本\t\n", "x" * 70000]
    b = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    w = Words(b.column(0), SPACE)
    assert np.diff(w.at).tolist() == [3, 0, 0, 2, 1]
    assert sum(p.num_rows for p in pieces([b], most=10)) == 5
    assert Words(pa.array(["ABC x"])).hash[0] == Words(pa.array(["q abc"])).hash[1]


@pytest.mark.parametrize(("large", "block"), [(64, 512), (2, 512), (2, 3)])
def test_jaccard(docs, corpus, large, block):
    sets = {}
    for i, t in corpus:
        w = words(t)
        s = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(root)
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[x] for b in sets[y]):
                p, q = top(x), top(y)
                root[max(p, q)] = min(p, q)
    got = jaccard.jaccard_components(docs, large=large, block=block).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == top(r["doc_id"]) and r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    if large == 64:
        assert jaccard.jaccard_components(docs.where("false")).count() == 0


def similar_sets(texts):
    """Sets of shingles by text, and the least index of each text's group of near duplicates."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                p, q = top(x), top(y)
                root[max(p, q)] = min(p, q)
    return sets, [top(x) for x in range(len(sets))]


@pytest.mark.parametrize("large", [64, 2])
def test_one_of_each(spark, corpus, large):
    """By rows: repeated ids with other texts stay, null ids too; one row of each group, that of the least id."""
    rows = [*corpus, (3, "another text under the id of three that is like no other one"), (None, corpus[1][1]), (None, "only here is this text without an id found"), (4, corpus[4][1])]
    got = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("k1", F.lit("clash")).repartition(3), large=large).collect()]
    sets, group = similar_sets([t for _, t in rows])
    want = defaultdict(list)
    for (i, t), s, g in zip(rows, sets, group, strict=True):
        want[g if s else (i, t)].append((i, t))
    assert len(got) == len(want)
    for members in want.values():
        ids = [i for i, _ in members if i is not None]
        kept = [x for x in got if x in members]
        assert len(kept) == 1 and (kept[0][0] == min(ids) if ids else kept[0][0] is None)
    assert jaccard.one_of_each(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_hot_clusters_across_components(spark):
    """A chain of texts that share a common part: clusters that large buckets connect hold several components."""
    r = random.Random(9)
    base = [f"c{i}" for i in range(60)]
    rows, n = [], 0
    for g in range(6):
        mine = list(base)
        for p in r.sample(range(60), 8):
            mine[p] = f"g{g}x{p}"
        for _ in range(12):
            w = list(mine)
            w[r.randrange(60)] = f"v{n}"
            rows.append((n, " ".join(w)))
            n += 1
    _, group = similar_sets([t for _, t in rows])
    for large, block in ((2, 5), (4, 512)):
        got = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), large=large, block=block).collect()}
        assert [got[i] for i in range(n)] == group


def test_bitmap_bounds_the_difference():
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 3000))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 1 << 62, n // 8).astype(np.uint64)]))
        assert jaccard.differing(jaccard.bitmap(a), jaccard.bitmap(b)) <= len(np.setxor1d(a, b))


def gst(a, b, k):
    ua, ub, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ua[i + n] and not ub[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return total
        ua[i : i + n] = ub[j : j + n] = [True] * n
        total += n


def test_tiling(spark, docs, corpus):
    texts = dict(c for c in corpus if c[1])
    w = [texts[i].split() for i in range(40, 44)]
    items = [(0, " ".join(w[0])), (1, " ".join(w[1][len(w[1]) // 2 :] + w[1][: len(w[1]) // 2])), (2, " ".join(w[2][:8] + ["zz"] * 20)), (3, None), (4, ""), (5, "one two"), (None, texts[41])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = Counter()
    for i, t in corpus:
        for j, u in items:
            a, b = tok(t), tok(u)
            if a and b and len(a) < 500:
                n = gst(a, b, min(5, len(b)))
                if n >= 0.6 * len(b):
                    want[(i, j, n)] += 1
    for block in (1 << 20, 40):
        got = Counter((r["doc_id"], r["item_id"], r["covered"]) for r in tiling.leaks(docs, bench, block_words=block).collect())
        assert got == want and any(j == 1 for _, j, _ in got)
    bad = {c for c in corpus if any(n >= 0.6 * len(tok(u)) for u in (u for _, u in items if tok(u)) if len(tok(c[1])) < 500 and tok(c[1]) for n in [gst(tok(c[1]), tok(u), min(5, len(tok(u))))])}
    assert Counter((r["doc_id"], r["text"]) for r in tiling.clean(docs, bench).collect()) == Counter(c for c in corpus if c not in bad)
    assert tiling.leaks(docs, bench.where("false")).count() == 0


def test_passages(docs, corpus):
    got = passages.passages(docs).collect()
    seen = defaultdict(set)
    for i, t in corpus:
        w = words(t)
        for k in range(len(w) - 51):
            seen[tuple(w[k : k + 52])].add(i)
    truth = {i for v in seen.values() if len(v - {None}) > 1 for i in v} - {None}
    found = {r["doc_id"] for r in got}
    assert len(truth - found) <= 0.02 * len(truth)
    sets = {i: words(t) for i, t in corpus}
    for r in got:
        a, b = sets[r["doc_id"]][r["start"] : r["end"]], sets[r["other_doc_id"]][r["other_start"] : r["other_end"]]
        x, y = (set(zip(*(v[k:] for k in range(5)), strict=False)) for v in (a, b))
        assert len(x & y) / len(x | y) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8
    assert passages.passages(docs.where("doc_id > 9000")).count() == 0


def test_passages_behind_a_common_text(spark):
    """Exact passages of 60 words, 45 of them common to many documents and too short to be a passage."""
    r = random.Random(5)

    def new(n):
        return [f"u{r.randrange(10**9)}" for _ in range(n)]

    common = new(45)
    rows = [(i, " ".join(new(80) + common + new(80))) for i in range(20)]
    for i in range(40):
        shared = new(8) + common + new(7)
        rows += [(100 + 2 * i + j, " ".join(new(70) + shared + new(70))) for j in (0, 1)]
    got = {(x["doc_id"], x["other_doc_id"], x["start"], x["end"]) for x in passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(100 + 2 * i + j, 101 + 2 * i - j, 70, 130) for i in range(40) for j in (0, 1)}


def test_passages_of_an_id_with_two_texts(spark):
    r = random.Random(6)
    new = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n))
    shared = [new(70), new(70)]
    rows = [(1, f"{new(20)} {shared[0]}"), (1, f"{new(30)} {shared[1]}"), (2, f"{shared[0]} {new(9)}"), (3, f"{shared[1]} {new(9)}"), (3, None), (2, f"{shared[0]} {new(9)}"), (4, shared[0].upper())]
    got = {(x["doc_id"], x["start"], x["end"], x["other_doc_id"]) for x in passages.passages(spark.createDataFrame(rows, "doc_id int, text string").withColumn("name", F.lit(0))).collect()}
    assert {(1, 20, 90, 2), (1, 20, 90, 4), (1, 30, 100, 3), (2, 0, 70, 4), (3, 0, 70, 1)} <= got and not any(a == d for a, *_, d in got)


def test_dealt_rows():
    ids = np.repeat(np.arange(40), 2)
    key = np.where(ids < 38, 7, 9)
    rows, keys = passages.dealt(key, ids, 8)
    assert set(rows) == set(range(80)) and np.bincount(keys == 7)[1] == 9 and (keys == 9).sum() == 4
    assert {0, 1, 2, 3} & set(rows[(keys != 7) & (keys != 9)].tolist()) == {0, 2}


def test_passages_recall_and_precision_under_crowding(spark):
    """300 documents hold one common passage; of them 60 pairs share another one, exactly or with a few words changed."""
    r = random.Random(8)
    new = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    common = new(60)
    rows = [(i, " ".join(new(40) + common + new(40))) for i in range(180)]
    for i in range(60):
        own = new(90)
        other = list(own)
        for p in r.sample(range(90), i % 3):
            other[p] = "changed"
        rows += [(200 + 2 * i, " ".join(new(30) + own + common)), (201 + 2 * i, " ".join(common + other + new(30)))]
    rows += [(900 + i, " ".join(new(120))) for i in range(100)]
    got = {(x["doc_id"], x["other_doc_id"]) for x in passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {a for a, _ in got} == {i for i, _ in rows if i < 900}
    met = sum((200 + 2 * i, 201 + 2 * i) in got for i in range(60))
    assert met >= 57, met


def test_near_copies_in_crowded_buckets_all_meet(spark):
    """40 documents hold a text; 40 pairs hold it with their own changes, too many to be like it, and differ by a word from each other."""
    r = random.Random(9)
    new = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    common = new(60)
    rows = [(i, " ".join(new(40) + common + new(40))) for i in range(40)]
    for i in range(40):
        own = list(common)
        for p in (12, 30, 48):
            own[p + i % 5] = f"own{i}"
        other = list(own)
        other[22 + i % 7] = "changed"
        rows += [(100 + 2 * i, " ".join(new(30) + own + new(30))), (101 + 2 * i, " ".join(new(50) + other + new(10)))]
    got = {(x["doc_id"], x["other_doc_id"]) for x in passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [i for i in range(40) if (100 + 2 * i, 101 + 2 * i) not in got] == []


def test_compact_windows_are_maximal():
    rng = random.Random(5)
    h = np.array([rng.randrange(1, 1 << 40) for _ in range(200)], dtype=np.uint64)
    ends = np.full(200, 200)
    c = passages.centres(h, ends, 10)
    left, right = passages.extents(h[c], np.zeros(len(c), dtype=np.int64), np.full(len(c), 200), c)
    want = set()
    for i in range(200):
        a, b = i, i + 1
        while a > 0 and h[a - 1] > h[i]:
            a -= 1
        while b < 200 and h[b] > h[i]:
            b += 1
        if b - a >= 10:
            want.add((a, i, b))
    assert set(zip(left.tolist(), c.tolist(), right.tolist(), strict=True)) == want


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.public_tokenizer()


def test_bpe(spark, tokenizer):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    bits = ["a", "e", "  ", "\n", "\t", "é", "ß", "中", "1", "22", "'s", "'ll", "!!", "　", "\x1c", "\x85", "the", " The", "<|endoftext|>", "\U0001d4b3"]
    texts = ["", None, " " * 9000, "ab" * 4000, *("".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(400))]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "n int, text string, IDS int")
    got = {r["n"]: r for r in bpe.encoded(d, tokenizer).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == own.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode() and got[i]["n_tokens"] == len(got[i]["ids"])
    assert set(got[0].asDict()) == {"n", "text", "n_tokens", "ids", "decoded"}


def test_perfect_hash(tokenizer):
    keys = [f"key{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(3000)) and h.get(b"other") is None and sorted(h.keys) == sorted(keys)
    assert bpe.PerfectHash([]).get(b"x") is None


def test_ppm(spark, corpus):
    corpus = corpus[:80] + corpus[-8:]
    docs = spark.createDataFrame([*corpus, (9010, "zzz ☃ qqq")], "doc_id bigint, text string").repartition(3)
    rows = [*corpus, (9010, "zzz ☃ qqq")]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c, follow = Counter(), [defaultdict(Counter) for _ in range(4)]
    for i, t in rows:
        if not out(i):
            c.update([*words(t), 0])
            b = b"\0" * 3 + (t or "").encode() + b"\xff"
            for p in range(3, len(b)):
                for k in range(4):
                    follow[k][b[p - k : p]][b[p]] += 1
    n, v = sum(c.values()), len(c)

    def code(t):
        b, total = b"\0" * 3 + t.encode() + b"\xff", 0.0
        for p in range(3, len(b)):
            gone = set()
            for k in range(3, -1, -1):
                m = {s: x for s, x in follow[k].get(b[p - k : p], {}).items() if s not in gone}
                if b[p] in m:
                    total += math.log10(m[b[p]] / (sum(m.values()) + len(m)))
                    break
                if m:
                    total += math.log10(len(m) / (sum(m.values()) + len(m)))
                gone |= set(m)
            else:
                total -= math.log10(256 - len(gone))
        return total

    want = sorted((str(i), out(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), 0]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), 0]), 6), round(code(t or ""), 6)) for i, t in rows)
    for hot in (1 << 20, 300, 0):
        assert sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in ppm.score(docs, order=3, hot=hot).collect()) == want
    untrained = ppm.score(docs.where("doc_id = 9010 or crc32(cast(doc_id as string)) % 5 = 1").where("crc32(cast(doc_id as string)) % 5 = 1"), order=3).collect()
    assert untrained and all(r["held_out"] and r["train_tokens"] == r["n_known"] == 0 for r in untrained)
    assert all(r["score"] == pytest.approx(-math.log10(256) * (len((t or "").encode()) + 1)) for r in untrained for i, t in rows if i == r["doc_id"] and i != 3)
    assert ppm.score(docs.where("false"), order=3).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "é𝒳"), (1, 2, None, None), (1, 300, "user", "late"), (2, 0, "user", ""), (2, 0, "user", ""), (None, 0, "a", "x"), (1, None, "bot", "?"), (1, -1, "bot", "first")]
    d = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit("clash"))
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.rotated(d, part_turns=4).collect()}
    assert {k[1] for k in got if k[0] == 1} == {"user", "bot", "unknown"} and {k[2] for k in got if k[0] == 1} == {0, 1}
    r = got[(1, "bot", 0)]
    assert r["text"] == "<|start|>assistant\nfirst<|end|>\n<|start|>user name=user\nhi<|end|>\n<|start|>assistant\né𝒳<|end|>\n<|start|>user name=unknown\n<|end|>\n"
    assert [r["text"][m["start"] : m["end"]] for m in r["mask"]] == ["first<|end|>", "é𝒳<|end|>"] and r["n_chars"] == len(r["text"])
    assert got[(1, "bot", 1)]["text"] == "<|start|>user name=user\nlate<|end|>\n<|start|>assistant\n?<|end|>\n" and got[(1, "bot", 1)]["first_turn"] == 4
    assert got[(2, "user", 0)]["n_turns"] == 2 and len(got[(2, "user", 0)]["mask"]) == 2 and got[(1, "unknown", 1)]["mask"] == [] and (None, "a", 0) in got
    assert chat.rotated(d.where("false")).count() == 0


def test_chat_bounds_parts_by_rows(spark):
    """Null and repeated turn numbers: no part has more than part_turns of them, and all put together are the whole."""
    rows = [(None, None if i % 2 else 7, "a" if i % 3 else "b", f"t{i:04}") for i in range(1000)]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = [r for r in chat.rotated(d, part_turns=64).collect() if r["speaker"] == "a"]
    assert max(r["n_turns"] for r in got) == 64 and len(got) == 16
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
    assert re.findall(r"t[0-9]{4}", "".join(r["text"] for r in sorted(got, key=lambda r: r["part"]))) == [r[3] for r in want]


def test_html(spark):
    model = html.trained()
    pages = html.labelled_pages(120, seed=77)
    right = total = 0
    for page, want in pages:
        found = html.blocks(page)
        assert len(found) == len(want)
        got = model.viterbi(model.emissions(html.features(found)))
        right, total = right + sum(a == b for a, b in zip(got, want, strict=True)), total + len(want)
    assert right / total > 0.99
    article = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More</a></li></ul></nav><article><h1>Tom &amp; Co&#33;</h1><p><b>First  line<br>goes\ton.<p>Second one is here.</p><script>var x='</p>'</script></article><div class=comments><p>Nice post, thanks.</p></div><footer>&copy; x.example</footer></body></html>"
    d = spark.createDataFrame([(1, "u", article), (2, None, None), (3, "u", ""), (None, "u", "<p"), (5, "u", "<div>" * 3000 + "deep")], "page_id bigint, url string, html string").withColumn("text", F.lit(0))
    got = {r["page_id"]: r for r in html.extracted(d, model).collect()}
    assert got[1]["text"] == "Tom & Co!\nFirst line goes on.\nSecond one is here." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == got[None]["text"] == ""


def test_html_of_any_depth(spark):
    """Deep nesting and unclosed raw elements: ancestors stay right, and time is linear."""
    import time

    deep = "<article>" + "<div><b>" * 3000 + "<p>deep</p>" + "</b></div>" * 3000 + "</article><div class=sidebar>beside</div>"
    found = html.blocks(deep)
    assert [b[0] for b in found] == ["deep", "beside"] and "in:article" in found[0][1].features and "in:article" not in found[1][1].features and "hint:sidebar" in found[1][1].features
    began = time.time()
    assert len(html.blocks("<iframe src=x>text " * 40_000)) == 40_000 and time.time() - began < 5
    began = time.time()
    assert html.blocks("<b>" * 40_000 + "x" + "</i>" * 40_000)[0][0] == "x" and time.time() - began < 5


def test_viterbi_and_gradient_by_enumeration():
    from itertools import product

    m = html.CRF()
    m.t = [[0.3, -0.2], [0.1, 0.4]]
    e = [0.5, -1.0, 0.2, 0.9]
    score = lambda y: sum(x for x, v in zip(e, y, strict=True) if v) + sum(m.t[a][b] for a, b in zip(y, y[1:], strict=False))
    every = list(product((0, 1), repeat=4))
    z = sum(math.exp(score(y)) for y in every)
    assert m.viterbi(e) == list(max(every, key=score))
    p, pairs = m.expectations(e)
    assert p == pytest.approx([sum(math.exp(score(y)) for y in every if y[i]) / z for i in range(4)])
    assert pairs[1][0] == pytest.approx(sum(math.exp(score(y)) / z * sum(a == 1 and b == 0 for a, b in zip(y, y[1:], strict=False)) for y in every))
