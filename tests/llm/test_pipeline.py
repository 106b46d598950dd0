"""run() against a brute-force version of all stages, over odd inputs too, and its stages' contracts."""

import base64
import hashlib
import math
import random
import re
import struct
from collections import Counter

import corpus_pipeline as P
from quillon.llm import bpe, quality

from .test_text import gst, similar_sets, words


def xx(data, seed=42):
    import xxhash

    h = xxhash.xxh64_intdigest(data, seed)
    return h - (h >> 63 << 64)


def bins(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = [xx(x.encode()) for x in w]
    pairs = [xx(struct.pack("<q", b), xx(struct.pack("<q", a)) % 2**64) for a, b in zip(h, h[1:], strict=False)]
    return w, [x % quality.BUCKETS for x in h + pairs]


def brute(rows, labels, benchmark):
    """(doc_id, ids, extra) of what the stages leave of rows (doc_id, text, extra)."""
    import public_tokenizers
    import tiktoken

    good = {i for i, q, t in labels if q == 1 and t == 0}
    raw, target = Counter(), Counter()
    for i, t, _ in rows:
        b = bins(t)[1]
        raw.update(b)
        if i in good:
            target.update(b)
    extra = 8.0 * quality.BUCKETS
    n_raw, n_target = sum(raw.values()), sum(target.values())
    weight = {b: math.log((target[b] + extra * r / n_raw) / (n_target + extra)) - math.log(r / n_raw) for b, r in raw.items()}
    kept = []
    for row in rows:
        w, b = bins(row[1])
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        if len(w) >= 50 and 100 * len(twice) <= 50 * len(w) and sum(weight[x] for x in b) / len(b) >= quality.THRESHOLD:
            kept.append(row)
    _, group = similar_sets([t for _, t, _ in kept])
    best = {}
    for row, g in zip(kept, group, strict=True):
        key = (row[0] is None, row[0], xx(row[1].encode()))
        if g not in best or key < best[g][0]:
            best[g] = (key, row)
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for _, (i, t, x) in best.values():
        if not any(tok(u) and gst(tok(t), tok(u), min(5, len(tok(u)))) >= 0.6 * len(tok(u)) for _, u in benchmark):
            out[i, tuple(own.encode_ordinary(re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t))), x] += 1
    return out


def test_run_is_the_brute_force_version(spark, tmp_path):
    r = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("lor", "ip", "do", "sit", "am", "con", "te", "ad") for b in ("em", "sum", "lor", "us", "et", "sec", "tur", "pis")]
    new = lambda n: [r.choice(vocabulary) + r.choice(vocabulary) for _ in range(n)]
    texts = [new(r.randint(60, 110)) for _ in range(24)]
    rows = [(i, " ".join(t), "a") for i, t in enumerate(texts)]
    for i in range(8):
        w = list(texts[i])
        w[r.randrange(len(w))] = "changed"
        rows += [(100 + i, " ".join(w), "b"), (200 + i, rows[i][1], "c")]
    leaked = new(30)
    rows += [(300, " ".join(new(40) + leaked[15:] + leaked[:15] + new(20)), "d"), (301, " ".join(new(70)) + " write to ann.lee@mail.example.org or b@c.de", "d")]
    rows += [(302, None, "e"), (303, "", "e"), (304, "too short", "e"), (305, "again and again " * 60, "e"), (None, " ".join(new(80)), "f"), (None, rows[3][1], "f"), (5, " ".join(new(90)), "g"), (300, " ".join(new(75)), "h"), rows[20], (306, " ".join(f"#{i}$" for i in range(90)), "junk")]
    labels = [(i, 1, 0) for i in range(24)] + [(306, 0, 1), (302, 1, 0)]
    benchmark = [(0, " ".join(leaked)), (1, None), (2, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string, th string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((x["doc_id"], tuple(x["ids"]), x["th"]) for x in P.run(spark, str(tmp_path)).collect())
    want = brute(rows, labels, benchmark)
    assert got == want and 20 < len(want) < len(rows)


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages(spark, tmp_path):
    import pyarrow.parquet as pq

    src = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    for t in ("benchmark", "labels"):
        pq.write_table(pq.read_table(f"/root/testdata/sf0.001/{t}.parquet"), tmp_path / f"{t}.parquet")
    pq.write_table(src, tmp_path / "documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    n, seen = [], None
    for i, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        n.append(docs.count())
        if i < len(P.STAGES) - 1:
            assert docs.columns == src.column_names
            seen = docs
    assert n[0] >= n[1] >= n[2] == n[3] == n[4] > 0
    tok = bpe.public_tokenizer()
    texts = {r["doc_id"]: r["text"] for r in seen.collect()}
    for r in docs.collect():
        assert r["ids"] == tok.encode(texts[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    run = {(r["doc_id"], tuple(r["ids"])) for r in P.run(spark, str(tmp_path)).collect()}
    assert run == {(r["doc_id"], tuple(r["ids"])) for r in docs.collect()}
