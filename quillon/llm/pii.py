"""Personal data by weak supervision.

Base spans (email, ip, card, phone) are found by patterns and checks and always stay. The method
adds spans of further kinds: patterns propose candidates; labelers (form, gazetteer, context,
counter-context, variety of characters) each vote yes, no or nothing. A candidate is described
wholly by its kind, its votes and its span's own features (classes of length, share of digits and case), so one
aggregation over the corpus counts each such pattern, of which there are at most len(KINDS) * 3 ** (N_VOTES +
N_FEATURES). On these counts the driver runs expectation-maximisation over the votes for the labelers' reliabilities
(naive-Bayes, two classes) and then trains the final classifier, a logistic regression from span features of each
kind, kinds and votes to what EM believes, weighted by the counts. Candidates whose pattern it accepts become spans,
unless they overlap a base span.

Everything on a document happens within its row, in the JVM. Places count code points from 0, ends
excluded. Defined results: a null text is an empty one; without candidates nothing is added; rows
are treated one by one, so repeated rows and null ids don't matter; an input column named like an
output is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._native import blocks, fixed, let, matches, part, scan, without

BASE = ["email", "ip", "card", "phone"]
#: The given patterns, written so that Java's matcher neither recurses nor rescans a long run: a run
#: is entered at its start or where the last match ended, and repeated groups never give back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Further kinds: candidates' patterns, in order of preference.
KINDS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z]\p{Ll}+(?: [A-Z]\p{Ll}+)?",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{20,}+",
}
#: By kind: a strict form; known beginnings or names; words that speak for it and against it just before.
FORM = {
    "iban": r"^[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,}.*$",
    "mac": r"^(?!(?:00:){5}).*$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "person": r"^\S+ \S+ \S+$",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[A-Za-z0-9_/+-]{24,128})$",
}
# Codes of countries that issue such account numbers, and given names that are common in several languages.
COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VA XK"
NAMES = "Adam Ahmed Alain Alan Albert Alejandro Alexander Alice Amelie Amy Ana Andre Andrea Andrew Angela Anita Anna Anne Anthony Antonio Barbara Beatriz Benjamin Bernard Bernd Brian Carla Carlos Carmen Caroline Catherine Charles Charlotte Christian Christine Claire Clara Claude Claudia Cristina Daniel David Denise Diana Diego Dieter Dominique Elena Elisabeth Elizabeth Emily Emma Eric Erika Eva Felix Fernando Francisco Frank Frederic Gabriel Gabriela George Gerard Hannah Hans Heike Heinz Helen Helena Henri Hugo Ines Ingrid Isabel Jack Jacques James Jan Jane Javier Jean Jennifer Jessica Joao John Jorge Jose Joseph Juan Julia Julien Juan Karen Karin Karl Katharina Kevin Klaus Lars Laura Laurent Lea Lena Leon Linda Lisa Louis Louise Lucas Lucia Lucie Luis Luisa Manuel Marc Marcel Maria Marie Marina Mario Mark Markus Marta Martin Mary Matthew Max Michael Michel Miguel Monika Nancy Nicolas Nicole Nina Oliver Olivia Oscar Pablo Patricia Patrick Paul Paula Pedro Peter Petra Philippe Pierre Rachel Rafael Raul Rebecca Richard Robert Rosa Ruth Samuel Sandra Sara Sarah Sebastian Sofia Sophie Stefan Stephen Susan Teresa Thomas Tobias Ursula Victor Vincent Werner William Wolfgang Yves"
GAZETTEER = {
    "iban": rf"^(?:{'|'.join(COUNTRIES.split())})",
    "mac": r"^(?i:00:1A|00:50|3C:5A|B8:27|DC:A6|F0:18)",
    "national_id": r"^[0-6]",
    "person": rf"\b(?:{'|'.join(NAMES.split())})\b",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|glpat-|sk-|sk_live_|xox[bp]-|eyJ)",
}
CONTEXT = {
    "iban": r"iban|account|konto|cuenta|compte|bank",
    "mac": r"mac|device|hardware|ethernet",
    "national_id": r"ssn|social|security|tax|id",
    "person": r"name|contact|from|by|dear|signed|patient|client",
    "secret": r"token|secret|passw|api.?key|bearer|credential|auth",
}
AGAINST = r"commit|sha-?[0-9]|md5|checksum|digest|hash|version|isbn|order|invoice|http|www\.|/$"
N_VOTES, N_FEATURES = 5, 3
#: Characters before a candidate that context labelers see.
AHEAD = 24
OUT = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
_T, _C = "__pii_text", "__pii_candidates"
_SPAN = "array<struct<start:bigint,end:bigint,found:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(_SPAN)

    def of(gate: Column, pattern: str) -> Column:
        return F.when(gate, matches(text, pattern)).otherwise(none)

    return {
        "email": of(F.contains(text, F.lit("@")), EMAIL),
        "ip": F.filter(of(text.rlike(r"[0-9]\.[0-9]"), IP), lambda m: m["found"].rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")),
        "card": F.filter(of(text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), CARD), lambda m: F.length(_digits(m["found"])).between(16, 19) & F.call_function("luhn_check", _digits(m["found"]))),
        "phone": F.filter(of(F.contains(text, F.lit("+")), PHONE), lambda m: F.length(_digits(m["found"])).between(8, 15)),
    }


def _says(kind: Column, value: Column, table: dict[str, str]) -> Column:
    """Whether value has the pattern that the table gives for its kind."""
    out = F.lit(False)
    for k, pattern in table.items():
        out = F.when(kind == k, value.rlike(pattern)).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, code): kinds and votes as one number, votes 0 no, 1 none, 2 yes."""
    any_of = "|".join(f"(?:{p})" for p in KINDS.values())

    def votes(m: Column) -> Column:
        found = m["found"]
        kind = F.lit("secret")
        for k in list(KINDS)[:-1][::-1]:
            kind = F.when(found.rlike(f"^(?:{KINDS[k]})$"), F.lit(k)).otherwise(kind)  # what stands around it was looked at when it was found
        return F.transform(F.array(kind), lambda k: _coded(k, m, found, F.lower(m["before"])))[0]

    def _coded(k, m, found, before):
        number = F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int") - 1
        variety = F.size(F.array_distinct(F.split(F.lower(found), "")))
        v = [
            F.when(_says(k, found, FORM), 2).otherwise(0),
            F.when(_says(k, found, GAZETTEER), 2).otherwise(1),
            F.when(_says(k, before, CONTEXT), 2).otherwise(1),
            F.when(before.rlike(AGAINST), 0).otherwise(1),
            F.when(variety >= 10, 2).when(variety >= 6, 1).otherwise(0),
        ]
        size = F.length(found)
        features = [
            F.when(size < 16, 0).when(size < 36, 1).otherwise(2),
            F.least(F.floor(3 * F.length(_digits(found)) / size), F.lit(2)),
            F.when(found.rlike("[a-z]") & found.rlike("[A-Z]"), 2).when(found.rlike("[A-Z]"), 1).otherwise(0),
        ]
        code = number
        for x in [*v, *features]:
            code = code * 3 + x
        return F.struct(k.alias("kind"), m["start"].alias("start"), m["end"].alias("end"), code.cast("int").alias("code"))

    gate = text.rlike(r"[A-Za-z0-9_/+-]{20}|[0-9]-[0-9]{2}-[0-9]|:[0-9A-Fa-f]{2}:|(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z]|[A-Z]{2}[0-9]{2}")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,code:int>>")
    return F.when(gate, F.transform(matches(text, any_of, AHEAD), votes)).otherwise(none)


def pattern_counts(docs: DataFrame) -> dict[int, int]:
    """Number of candidates by code, over all rows."""
    d = docs.select(F.coalesce(docs["text"], F.lit("")).alias(_T)).select(F.explode_outer(F.transform(candidates(F.col(_T)), lambda c: c["code"])).alias("code"))
    return {r["code"]: r["count"] for r in d.where("code is not null").groupBy("code").count().collect()}  # bounded: see above


def decoded(code: int) -> tuple[int, list[int], list[int]]:
    """Kind, votes and features."""
    v = []
    for _ in range(N_VOTES + N_FEATURES):
        code, x = divmod(code, 3)
        v.append(x)
    v = v[::-1]
    return code, v[:N_VOTES], v[N_VOTES:]


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[list[list[list[float]]], dict[int, float]]:
    """P(vote | class) of each labeler and P(yes) of each pattern, by expectation-maximisation from the votes' majority."""
    patterns = {c: decoded(c) for c in counts}
    yes = {c: min(0.9, max(0.1, 0.5 + 0.2 * sum(x - 1 for x in v))) for c, (_, v, _) in patterns.items()}
    table: list[list[list[float]]] = []
    for _ in range(rounds):
        table = [[[1.0] * 3 for _ in range(2)] for _ in range(N_VOTES)]
        prior = {k: [1.0, 1.0] for k in range(len(KINDS))}
        for c, (k, v, _) in patterns.items():
            for y, p in ((0, 1 - yes[c]), (1, yes[c])):
                prior[k][y] += counts[c] * p
                for j, x in enumerate(v):
                    table[j][y][x] += counts[c] * p
        table = [[[n / sum(row) for n in row] for row in t] for t in table]
        for c, (k, v, _) in patterns.items():
            log = [math.log(prior[k][y] / sum(prior[k])) + sum(math.log(table[j][y][x]) for j, x in enumerate(v)) for y in (0, 1)]
            yes[c] = 1 / (1 + math.exp(max(-500.0, min(500.0, log[0] - log[1]))))
    return table, yes


def accepted(counts: dict[int, int], steps: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> list[int]:
    """Codes that the final classifier takes for personal data."""
    if not counts:
        return []
    _, yes = reliabilities(counts)
    total = sum(counts.values())
    n_kinds = len(KINDS)
    first = 1 + n_kinds + 3 * N_VOTES

    def inputs(code: int) -> list[int]:
        k, v, f = decoded(code)
        return [0, 1 + k, *(1 + n_kinds + 3 * j + x for j, x in enumerate(v)), *(first + (k * N_FEATURES + j) * 3 + x for j, x in enumerate(f))]

    at = {c: inputs(c) for c in counts}
    w = [0.0] * (first + n_kinds * N_FEATURES * 3)

    def p(c: int) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(w[i] for i in at[c])))))

    for _ in range(steps):
        g = [ridge * x for x in w]
        for c, n in counts.items():
            d = n / total * (p(c) - yes[c])
            for i in at[c]:
                g[i] += d
        w = [x - rate * y for x, y in zip(w, g, strict=True)]
    return sorted(c for c in counts if p(c) >= 0.5)


def _apart(found: Column, base: Column) -> Column:
    """Those of found, which don't overlap each other, that overlap none of base.

    All are put in order of start; a running maximum of the ends of base spans from the front, and a running minimum of
    their starts from the back, tell of each whether one reaches into it."""

    def place(a: Column, own: bool) -> Column:
        return F.transform(a, lambda x, i: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), F.when(F.lit(own), i).otherwise(-1).alias("i")))

    far = F.lit(1 << 62).cast("long")
    reached = lambda s, x: F.when(x["own"], s).otherwise(F.greatest(s, x["end"]))
    next_one = lambda s, x: F.when(x["own"], s).otherwise(F.least(s, x["start"]))

    def free(a: Column) -> Column:
        ahead = scan(a, F.lit(0).cast("long"), reached, lambda s, x: F.when(x["own"] & (s <= x["start"]), x["i"]).otherwise(-1), "int")
        behind = scan(F.reverse(a), far, next_one, lambda s, x: F.when(x["own"] & (s >= x["end"]), x["i"]).otherwise(-1), "int")
        return F.array_remove(F.array_intersect(ahead, behind), -1)

    def kept(f: Column) -> Column:
        # in order of start, base spans (own = false) first
        places = F.array_sort(F.concat(place(base, False), place(f, True)))
        return let(free(places), lambda ok: F.transform(F.array_sort(ok), lambda i: F.get(f, i)))

    return let(found, lambda f: F.when((F.size(f) > 0) & (F.size(base) > 0), kept(f)).otherwise(f))


def find(docs: DataFrame, codes: list[int], arrays: bool = False) -> DataFrame:
    """docs with OUT; with `arrays` also __pii_all, an array of (kind, start, end) in order of place."""
    text = F.col(_T)
    d = docs.select(*without(docs, *OUT), F.coalesce(docs["text"], F.lit("")).alias(_T))
    columns = {f"__pii_{k}": v for k, v in base_spans(text).items()}
    d = d.select("*", *(fixed(v).alias(k) for k, v in columns.items()), fixed(candidates(text)).alias(_C))
    accepted_ = set(codes)
    told = ",".join("1" if c in accepted_ else "0" for c in range(len(KINDS) * 3 ** (N_VOTES + N_FEATURES)))
    good = F.expr(f"cast(split('{told}', ',') as array<boolean>)")  # folded to one literal
    added = _apart(F.filter(_C, lambda c: F.get(good, c["code"])), F.concat(*(F.col(k) for k in columns)))
    d = d.withColumn(_C, fixed(added))

    def told(kind: str, a: Column | str) -> Column:
        return F.transform(a, lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["end"]))

    def placed(kind: str) -> Column:
        return F.transform(f"__pii_{kind}", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    def only(kind: str) -> Column:
        return F.filter(_C, lambda c: c["kind"] == kind)

    base = F.concat(*(told(k, F.col(f"__pii_{k}")) for k in BASE))
    extra = F.concat(*(told(k, only(k)) for k in sorted(KINDS)))
    out = {f"n_{k}": F.size(f"__pii_{k}").cast("long") for k in BASE}
    out |= {"base_sha256": F.sha2(F.array_join(base, ","), 256), "spans": F.array_join(F.concat(base, extra), ",")}
    if arrays:
        parts = [placed(k) for k in BASE]
        parts.append(F.transform(_C, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))
        out["__pii_all"] = fixed(F.array_sort(F.concat(*parts)))
    keep = [c for c in docs.columns if c.lower() not in OUT]
    return d.select(*(F.col(f"`{c}`") for c in keep), *(v.alias(k) for k, v in out.items()))


def redacted(docs: DataFrame, codes: list[int]) -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets; n_chars, where docs has it, follows."""
    d = find(docs, codes, arrays=True)
    text, spans = F.coalesce(d["text"], F.lit("")), F.col("__pii_all")
    # what lies before each span, after all earlier ones (a span may lie within or cross an earlier one)
    reached = scan(spans, F.lit(0).cast("long"), lambda s, x: F.greatest(s, x["end"]), lambda s, x: s, "bigint")
    d = d.withColumn("__pii_reached", fixed(reached)).withColumn("__pii_blocks", fixed(F.when(F.size(spans) > 0, blocks(text))))
    cut, ends = F.col("__pii_blocks"), F.col("__pii_reached")
    mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    pieces = F.transform(spans, lambda s, i: F.concat(part(cut, F.get(ends, i), s["start"]), F.when(s["start"] >= F.get(ends, i), mark(s)).otherwise("")))
    last = F.array_max(F.transform(spans, lambda p: p["end"]))
    new = F.when(F.size(spans) == 0, d["text"]).otherwise(F.concat(F.array_join(pieces, ""), part(cut, last, F.length(text).cast("long"))))
    d = d.withColumn("__pii_new", new)
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("__pii_new").alias("text"))
        elif c == "n_chars":
            out.append(F.length("__pii_new").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return d.select(*out)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, accepted(pattern_counts(docs))).select("doc_id", *OUT)
