"""quality, licenses and pii against brute force, over texts with nulls, empties, repeats and clashing columns."""

import hashlib
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import licenses, pii, quality
from quillon.llm._native import scan

LOWER = {i: i + 32 for i in range(65, 91)}
WORDS = [
    None, "", " \n\t ", "one", "a b c a b c a b c d", ("the same line again\n" * 30) + "end", " ".join(f"w{i}" for i in range(80)),
    "a@b.com_x@y.com a.b@c.d.e. x@y 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1111-1 5 +1 (2) 345-6789) +123 +12345678(((",
    "é𝒳 a@b.co é +44 20 7946 0958 token = 0123456789abcdef0123456789abcdef01234567", "MIT LICENSE mit-license! xmit license, mit licenses; cc-by CC BY cc\nby é",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "GNU  General/Public License, version 3 and the Apache License, Version 2.0",
    "| a | b | $$$ ### %%% & <x>\n|\n|\n", "1" * 20000 + " " + "a." * 9000 + "@b.c", "x " * 30000, "Dr. Maria Lopez, ssn 123-45-6789, hash 0123456789abcdef0123456789abcdef",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "kept", 7) for i, t in enumerate(WORDS)] + [(5, WORDS[5], "kept", 7), (None, WORDS[6], "kept", 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, extra string, N_WORDS int").repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality(docs):
    ids = docs.where("doc_id = 6").select("doc_id").distinct()
    got = quality.quality(docs, quality.fit(docs, ids, buckets=64)).collect()
    assert len(got) == len(WORDS) + 2 and got[0].asDict().keys() == {"doc_id", "text", "extra", *quality.OUT}
    for r in got:
        t, w = r["text"] or "", words(r["text"])
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(twice) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_quality_without_labels_or_rows(spark, docs):
    none = docs.where("false")
    w = quality.fit(docs, none.select("doc_id"), buckets=16)
    assert w == [0.0] * 16 and quality.quality(none, w).count() == 0


def test_quality_separates_held_out_labels(spark):
    """The target is fitted on labels of even hash; those of odd hash, which it hasn't seen, are told apart."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    got = quality.quality(d, quality.fit(d, quality.trusted_ids(labels.where("part = 0")))).select("doc_id", "kept", "base_failed")
    for part in (0, 1):
        c = {(r["quality"], r["kept"]): r["count"] for r in got.join(labels.where(F.col("part") == part), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()}
        assert c.get((1, False), 0) <= 0.01 * c[(1, True)] and c.get((0, True), 0) <= 0.1 * c[(0, False)], (part, c)


def test_licenses(docs):
    for r in licenses.licenses(docs).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER))
        at = [(i, k) for k, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({k for _, k in at})))
        assert {*r["base_labels"].split(",")} - {""} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1
        # brute force over all rules, without keywords or anchors
        low, found = (r["text"] or "").translate(LOWER), []
        for label, priority, _, p in licenses.rules():
            found += [(m.start(), m.end(), label, priority) for m in re.finditer(p, low, re.ASCII)]
        kept = [d for d in found if not any(o[0] <= d[0] and o[1] >= d[1] and (o[3], o[1] - o[0], d[2]) > (d[3], d[1] - d[0], o[2]) for o in found)]
        assert Counter((x["start"], x["end"], x["label"], x["priority"]) for x in r["detections"]) == Counter(set(kept))


def test_licenses_many_detections(spark):
    """A megabyte of detections: each in turn, in time that is linear in them; A-Z alone count as a-z."""
    n = 87_000
    rows = [(0, "MIT License " * n), (1, "MIT License, Apache License 2.0 " * 3000 + "GNU General Public License v3.0"), (2, "CC\u212a BY")]
    began = time.time()
    got = {r["doc_id"]: r for r in licenses.licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert time.time() - began < 60
    assert got[0]["n_base"] == len(got[0]["detections"]) == n and [d["start"] for d in got[0]["detections"]] == [12 * i for i in range(n)]
    assert {(d["end"] - d["start"], d["label"]) for d in got[0]["detections"]} == {(11, "mit")} and got[0]["last_word"] == 2 * (n - 1)
    assert Counter(d["label"] for d in got[1]["detections"]) == {"mit": 3000, "apache-2.0": 3000, "gpl-3.0": 1} and got[2]["n_base"] == 0


def test_scan(spark):
    d = spark.createDataFrame([([i * 37 % 101 for i in range(n)],) for n in (0, 1, 511, 512, 513, 5000)], "a array<int>")
    for r in d.select("a", scan(F.col("a"), F.lit(0), lambda s, x: F.greatest(s, x), lambda s, x: s, "int").alias("b"), scan(F.col("a"), F.lit(0), lambda s, x: F.greatest(s, x), lambda s, x: s, "int", 7).alias("c")).collect():
        assert r["b"] == r["c"] == [max(r["a"][:i], default=0) for i in range(len(r["a"]))]


def test_license_rules_are_many_and_have_keywords():
    rules = licenses.rules()
    assert len(rules) >= 250 and sum(not k for _, _, k, _ in rules) < 30 and all(re.compile(p) for *_, p in rules)


def example(parsed, most):
    """A text that a parsed pattern matches: optional parts left out, or taken once, by the last alternatives, if `most`."""
    out = ""
    for op, v in parsed:
        match str(op):
            case "LITERAL":
                out += chr(v)
            case "ANY" | "NOT_LITERAL":
                out += "x"
            case "IN":
                first, what = v[0]
                out += {"LITERAL": lambda: chr(what), "RANGE": lambda: chr(what[0]), "NEGATE": lambda: "x", "CATEGORY": lambda: " " if str(what) == "CATEGORY_SPACE" else "x"}[str(first)]()
            case "BRANCH":
                out += example(v[1][-1 if most else 0], most)
            case "SUBPATTERN":
                out += example(v[3], most)
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += example(v[2], most) * max(v[0], int(most))
            case _:
                assert str(op) == "AT"
    return out


def test_each_license_rule_fires_on_a_text_of_its_own(spark):
    rules = licenses.rules()
    texts = [(i, example(re._parser.parse(p), most)) for i, (*_, p) in enumerate(rules) for most in (False, True)]
    for r in licenses.licenses(spark.createDataFrame(texts, "doc_id int, text string")).collect():
        label, priority, keyword, p = rules[r["doc_id"]]
        m = re.search(p, r["text"], re.ASCII)
        assert m and keyword in m.group() and any(x in m.group() for x in licenses.needles()), (label, p, r["text"])
        # what is left of it is itself or what suppresses it
        assert any((d["start"], d["end"], d["label"], d["priority"]) == (m.start(), m.end(), label, priority) or (d["start"] <= m.start() and d["end"] >= m.end() and d["priority"] >= priority) for d in r["detections"]), (label, p, r["text"])


def test_license_rules_with_optional_spaces(spark):
    usual = {
        "MPL-2.0": ("mpl-2.0", 0.9), "MPL 1.1": ("mpl-1.1", 0.9), "Apache License 2.0": ("apache-2.0", 0.7), "Apache License v2.0": ("apache-2.0", 0.7), "Apache License, Version 1.1": ("apache-1.1", 0.7),
        "GNU General Public License v3.0": ("gpl-3.0", 0.7), "GNU General Public License, version 2": ("gpl-2.0", 0.7), "General Public License v1": ("gpl-1.0", 0.7),
        "GNU Affero General Public License v3": ("agpl-3.0", 0.7), "GNU Lesser General Public License v2.1": ("lgpl-2.1", 0.7), "Lesser General Public License v3.0": ("lgpl-3.0", 0.7), "Library General Public License v2": ("lgpl-2.0", 0.7),
        "Mozilla Public License 2.0": ("mpl-2.0", 0.7), "Mozilla Public License v1.1": ("mpl-1.1", 0.7), "Eclipse Public License 2.0": ("epl-2.0", 0.7), "Eclipse Public License - v 1.0": ("epl-1.0", 0.7),
        "Attribution-ShareAlike 2.0": ("cc-by-sa-2.0", 0.7), "Attribution-ShareAlike 3.0": ("cc-by-sa-3.0", 0.7), "Attribution-ShareAlike 4.0": ("cc-by-sa-4.0", 0.7), "Attribution-Share Alike 4.0": ("cc-by-sa-4.0", 0.7),
        "Academic Free License v3.0": ("afl-3.0", 0.7), "European Union Public License v1.2": ("eupl-1.2", 0.7), "Open Software License v3.0": ("osl-3.0", 0.7), "Beerware License": ("beerware", 0.7), "Beer-ware license": ("beerware", 0.7),
        "Common Development and Distribution License 1.1": ("cddl-1.1", 0.7), "Common Development and Distribution License (CDDL) 1.0": ("cddl-1.0", 0.7),
        "Copyright 2020": ("copyright", 0.3), "Copyright (c) 1999": ("copyright", 0.3), "Copyright (c)2001": ("copyright", 0.3), "©2020": ("copyright", 0.3), "© 2020": ("copyright", 0.3), "provided as is without": ("warranty-disclaimer", 0.35), 'provided "as is" without': ("warranty-disclaimer", 0.35),
    }
    for r in licenses.licenses(spark.createDataFrame([(t,) for t in usual], "text string")).collect():
        label, score = usual[r["text"]]
        # the detection spans the whole text, the version included
        assert label in r["labels"].split(",") and r["score"] >= score and any(d["label"] == label and d["end"] == len(r["text"]) for d in r["detections"]), r


def luhn(z):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(z[::-1])) % 10 == 0


def base_spans(t):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    return {
        "email": [m.span() for m in re.finditer(r"(?:(?<=[A-Za-z0-9-])(?=_)|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15],
    }


def test_pii(docs):
    codes = pii.accepted(pii.pattern_counts(docs))
    for r in pii.find(docs, codes).collect():
        spans = base_spans(r["text"] or "")
        told = ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [len(v) for v in spans.values()] and r["spans"].startswith(told)
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs.withColumn("n_chars", F.lit(0)), codes).collect()}
    assert clean[0] is None and clean[1] == "" and clean[9].startswith("é𝒳 [EMAIL] é [PHONE] token = ")


def test_pii_many_spans(spark):
    """A megabyte of base spans and candidates: those that overlap a base span go, in time that is linear in them."""
    unit = "api token = 0123456789abcdef0123456789abcdef a@b.co Dr. Anna Lopez "
    rows = [(0, unit * 15_000), (1, "x@" + "0123456789abcdef" * 4 + ".com 123-45-6789"), (2, "0123456789abcdef0123456789abcdef@x.org " * 50)]
    d = spark.createDataFrame(rows, "doc_id int, text string")
    codes = [c for c in range(len(pii.KINDS) * 3 ** (pii.N_VOTES + pii.N_FEATURES))]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find(d, codes).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(d, codes).collect()}
    assert time.time() - began < 100
    assert Counter(x.split(":")[0] for x in got[0]["spans"].split(",")) == {"email": 15_000, "secret": 15_000, "person": 15_000}
    assert clean[0] == "api token = [SECRET] [EMAIL] [PERSON] " * 15_000 and clean[1] == "[EMAIL] [NATIONAL_ID]" and clean[2] == "[EMAIL] " * 50


def test_pii_classifier():
    def code(kind, votes, features):
        return int("".join(map(str, [*votes, *features])), 3) + list(pii.KINDS).index(kind) * 3 ** (pii.N_VOTES + pii.N_FEATURES)

    assert pii.decoded(code("mac", (2, 1, 0, 1, 2), (0, 1, 2))) == (1, [2, 1, 0, 1, 2], [0, 1, 2])
    secret, slug = (2, 1, 0), (2, 0, 0)
    counts = {code("secret", (2, 1, 2, 1, 2), secret): 200, code("secret", (2, 2, 2, 1, 2), secret): 40, code("secret", (0, 1, 1, 0, 0), slug): 300, code("secret", (0, 1, 1, 1, 0), slug): 100}
    # the same undecided votes: the span's features decide
    undecided = (2, 1, 1, 1, 1)
    counts |= {code("secret", undecided, secret): 2, code("secret", undecided, slug): 2}
    got = pii.accepted(counts)
    assert code("secret", (2, 1, 2, 1, 2), secret) in got and code("secret", (0, 1, 1, 0, 0), slug) not in got and pii.accepted({}) == []
    assert code("secret", undecided, secret) in got
