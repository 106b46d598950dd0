"""Column expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of the contracts, for trimming and as a pattern.
SPACES = "\t\n\x0b\x0c\r "
SPACE_RUN = r"[\x20\x09-\x0D]+"


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df but those that an operator replaces (compared without case, as Spark does)."""
    taken = {n.lower() for n in names}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in taken]


def fixed(value: Column) -> Column:
    """value, computed once in this projection. Catalyst would put a column that is used once, or in a pushed filter, in
    place of its name, also inside a lambda, and so compute it for each element; it leaves what isn't deterministic
    where it is, and the (always true) condition on a row number counts as such."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column, characters: str, to: str = "") -> Column:
    """text with each of the characters replaced: byte searches, far cheaper than translate() or a pattern."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(to))
    return text


def words(text: Column) -> Column:
    """Words between runs of white space; none of a null or blank text. A one-character separator needs no pattern."""
    return F.array_remove(F.split(strip(F.coalesce(text, F.lit("")), SPACES[:-1], " "), " ", -1), "")


def scan(items: Column, zero: Column, step, emit, kind: str, block: int = 512) -> Column:
    """emit(state, x) of each item x, with the state that step(state, x) has made of the items before it, from zero.
    kind: the type of what is emitted. In blocks, so that long arrays aren't copied once an item."""

    def within(state: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.array_append(acc["out"], emit(acc["state"], x)).alias("out")),
        )

    def run(a: Column) -> Column:
        last = F.greatest(F.ceil(F.size(a) / block).cast("int") - 1, F.lit(0))
        return F.aggregate(
            F.sequence(F.lit(0), last),
            F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")),
            lambda acc, b: let(within(acc["state"], F.slice(a, b * block + 1, F.lit(block))), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out"))),
            lambda acc: F.flatten(acc["out"]),
        )

    return let(items, run)


def starts(lengths: Column) -> Column:
    """Exclusive prefix sums of an array of longs."""
    return scan(lengths, F.lit(0).cast("long"), lambda s, x: s + x, lambda s, x: s, "bigint")


def matches(text: Column, pattern: Column | str, before: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, found) in code points; with `before`, also as `before`
    up to so many characters that stand before it, no further back than to the end of the second match before it.

    What lies between the matches comes from split() and the matches from regexp_extract_all();
    both search in the same way, and their lengths give the places. The pattern must not match
    an empty string."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind = "array<struct<start:bigint,end:bigint,found:string>>"
    if before:
        kind = "array<struct<start:bigint,end:bigint,found:string,before:string>>"

    def place(found: Column) -> Column:
        # split once: in a lambda, what names none of its arguments is still computed for each element
        return let(F.split(text, p, F.lit(-1)), lambda between: placed(found, between))

    def placed(found: Column, between: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(F.get(between, i)) + F.length(m)).cast("long"))
        return let(
            starts(steps),
            lambda at: F.transform(found, lambda m, i: let(F.get(at, i) + F.length(F.get(between, i)), lambda a: F.struct(a.cast("long").alias("start"), (a + F.length(m)).cast("long").alias("end"), m.alias("found"), *ahead(between, found, i)))),
        )

    def ahead(between: Column, found: Column, i: Column) -> list[Column]:
        if not before:
            return []
        own = F.right(F.get(between, i), F.lit(before))
        full = F.when((F.length(own) >= before) | (i == 0), own)
        return [full.otherwise(F.right(F.concat(F.right(F.get(between, i - 1), F.lit(before)), F.get(found, i - 1), own), F.lit(before))).alias("before")]

    none = F.array().cast(kind)
    return let(F.regexp_extract_all(text, p, F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))


#: Characters of a block of blocks().
BLOCK = 1024


def blocks(text: Column) -> Column:
    """The text in parts of BLOCK code points, so that what lies far back needn't be counted off from the front each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(of: Column, start: Column, end: Column) -> Column:
    """What stands from start to end (excluded) in the text that blocks() has cut up."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    at = (start - first * BLOCK + 1).cast("int")
    own = F.coalesce(F.get(of, first), F.lit(""))
    between = F.array_join(F.slice(of, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    rest = F.substring(F.coalesce(F.get(of, last), F.lit("")), F.lit(1), (end - last * BLOCK).cast("int"))
    return F.when(end <= start, F.lit("")).when(first == last, F.substring(own, at, (end - start).cast("int"))).otherwise(F.concat(F.substring(own, at, F.lit(BLOCK)), between, rest))
