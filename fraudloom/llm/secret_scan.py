"""Secret scans with a battery of randomness tests (operator 3), DataFrame functions only.

Fixed patterns find assignments, access keys and hexadecimal strings. The battery
looks at every other long token with letters and digits: the alphabet is inferred
from its characters, and three tests ask whether it could be uniformly random
over that alphabet: chi-squared of the symbol counts, Wald-Wolfowitz runs around
the alphabet's middle, and lag-one serial correlation of the symbols' values.
Fisher's method joins their p-values.

Random tokens have uniform p-values, ordinary names and paths have tiny ones, but
the shorter a token the weaker the tests. So tokens are classed by alphabet and
length, and each class has its own cut. Copies say nothing new, so a token counts
once however often it occurs. If all tokens above a cut are random, half of them
lie above the middle between the cut and 1; a cut is refused if so few do that a
share of ordinary tokens within ``false_share`` has probability under ``level``.
The least cut that is not refused holds. Once a lower one is refused the class is
known to hold ordinary tokens, and a cut with no token above its middle is refused
however few tokens there are. A class whose cuts are all refused reports nothing.
The counts cover all documents; they are a table of at most classes x cuts numbers.

Positions count code points, ends are exclusive. Defined results: null and empty
texts have no spans; repeated rows are scanned one by one; an empty table has no
cuts. Cost grows with the text, and with the square of the spans of one text when
they are cut out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.llm.common import fresh

#: The patterns of the base kinds, in the order they are listed.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

CANDIDATE, PART = r"[A-Za-z0-9+/_-]{16,}", r"[A-Za-z0-9]+"
DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Alphabets by rising size; a token belongs to the first that spells it.
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "lower36": DIGITS + LOWER,
    "UPPER36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "url64": UPPER + LOWER + DIGITS + "-_",
}
CUTS = (0.001, 0.01, 0.05, 0.1, 0.2, 0.5)


@dataclass(frozen=True)
class Battery:
    least_bits: float = 64.0
    false_share: float = 0.1
    level: float = 0.05


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _prefix_sums(lengths: Column) -> Column:
    """Running totals of an array of numbers, by blocks of about the root of its size."""
    block = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(lengths) / block).cast("int")),
        lambda b: _total(F.slice(lengths, b * block + 1, block)),
    )
    running = lambda v: F.transform(lengths, lambda x, i: (
        _total(F.slice(v["blocks"], F.lit(1), F.floor(i / v["block"]).cast("int")))
        + _total(F.slice(lengths, F.floor(i / v["block"]).cast("int") * v["block"] + 1, i % v["block"] + 1))
    ))
    return _bound(F.struct(block.alias("block"), blocks.alias("blocks")), running)


SPANS = "array<struct<start:int,rank:int,end:int,value:string>>"


def _located(text: Column, pattern: str, matches: Column, rank: int) -> Column:
    """Spans (start, rank, end, value) of a pattern's matches, from the lengths of what lies between them."""
    steps = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m)
    )
    spans = F.zip_with(_bound(steps, _prefix_sums), matches, lambda e, m: F.struct(
        (e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), m.alias("value")
    ))
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(SPANS))


def _tail(z: Column) -> Column:
    """Two-sided normal p-value of |z| (rational approximation of erfc, error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = F.lit(1.0) / (F.lit(1.0) + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(F.least(poly * F.exp(-x * x), F.lit(1.0)), F.lit(1e-300))


def _upper_tail(z: Column) -> Column:
    half = _tail(z) / 2
    return F.greatest(F.when(z >= 0, half).otherwise(F.lit(1.0) - half), F.lit(1e-300))


def encoding_of(token: Column) -> Column:
    """(name, letters) of the first alphabet that spells a token; null if none does."""
    out = F.lit(None).cast("struct<name:string,letters:string>")
    for name, letters in reversed(ALPHABETS.items()):
        inside = letters.replace("-", "") + ("-" if "-" in letters else "")
        out = F.when(
            token.rlike(f"^[{inside}]+$"), F.struct(F.lit(name).alias("name"), F.lit(letters).alias("letters"))
        ).otherwise(out)
    return out


def p_value(token: Column, letters: Column) -> Column:
    """Joint p-value of the battery for a token over its alphabet."""
    size, n = F.length(letters).cast("double"), F.length(token).cast("double")
    squares = F.aggregate(
        F.split(letters, ""), F.lit(0.0),
        lambda s, c: s + F.pow((F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0)),
    )
    df = size - 1
    cube = F.pow(F.greatest(squares * size / n - n, F.lit(0.0)) / df, F.lit(1 / 3))
    p_chi = _upper_tail((cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))

    half = F.floor(size / 2).cast("int")
    sides = _sides(token, letters, half)
    ones = F.length(F.replace(sides, F.lit("0"), F.lit(""))).cast("double")
    runs = F.size(F.regexp_extract_all(sides, F.lit("0+|1+"), F.lit(0)))
    # the halves' shares are known, so each step changes sides with a known probability
    change = 2 * (half / size) * (1 - half / size)
    p_runs = F.when((ones == 0) | (ones == n), F.lit(1e-300)).otherwise(
        _tail((runs - 1 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change)))
    )

    middle, variance = (size + 1) / 2, (size * size - 1) / 12
    values = F.transform(F.split(token, ""), lambda c: F.instr(letters, c).cast("double"))
    products = _bound(values, lambda v: F.aggregate(
        F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: (a - middle) * (b - middle)),
        F.lit(0.0), lambda s, x: s + x,
    ))
    p_serial = _tail(products / (variance * F.sqrt(n - 1)))

    joint = F.greatest(-(F.log(p_chi) + F.log(p_runs) + F.log(p_serial)), F.lit(0.0))
    return _bound(joint, lambda y: F.exp(-y) * (1 + y + y * y / 2))


def _sides(token: Column, letters: Column, half: Column) -> Column:
    """The token with 0 for symbols of the alphabet's first half and 1 for the others."""
    return F.array_join(F.transform(
        F.split(token, ""), lambda c: F.when(F.instr(letters, c) <= half, F.lit("0")).otherwise(F.lit("1"))
    ), "")


TESTED = "array<struct<start:int,rank:int,end:int,kind:string,token:string,p:double>>"


def _tested(spans: Column, battery: Battery) -> Column:
    """Spans of candidates with class and p-value; tokens without enough bits or with one kind of character go."""

    def tested(s: Column, e: Column) -> Column:
        token = s["value"]
        length_class = F.least(F.floor(2 * F.log2(F.length(token).cast("double"))).cast("int"), F.lit(40))
        enough = F.length(token) * F.log2(F.length(e["letters"]).cast("double")) >= battery.least_bits
        return F.when(enough, F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"),
            F.concat_ws("/", e["name"], length_class.cast("string")).alias("kind"),
            token.alias("token"),
            p_value(token, e["letters"]).alias("p"),
        ))

    # no alphabet spells a run with both kinds of signs, such as a token behind a path: its parts are tested
    unspelled = lambda s: s["value"].rlike("[+/]") & s["value"].rlike("[_-]")
    parts = lambda s: F.transform(
        _located(s["value"], PART, F.regexp_extract_all(s["value"], F.lit(PART), F.lit(0)), KINDS.index("random")),
        lambda x: F.struct((s["start"] + x["start"]).alias("start"), x["rank"].alias("rank"), (s["start"] + x["end"]).alias("end"), x["value"].alias("value")),
    )
    spans = F.flatten(F.transform(spans, lambda s: F.when(unspelled(s), parts(s)).otherwise(F.array(s))))
    mixed = F.filter(spans, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    known = F.transform(mixed, lambda s: F.struct(s.alias("s"), encoding_of(s["value"]).alias("e")))
    return F.filter(F.transform(known, lambda k: tested(k["s"], k["e"])), lambda t: t.isNotNull())


def candidates(docs: DataFrame, text: str, out: str, battery: Battery) -> DataFrame:
    """``docs`` with an array of tested candidate tokens."""
    body, found = F.coalesce(F.col(text), F.lit("")), fresh(docs, "tokens")
    taken = docs.withColumn(found, F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)))
    spans = _located(body, CANDIDATE, F.col(found), KINDS.index("random"))
    worth = F.exists(found, lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]"))
    return taken.withColumn(out, F.when(worth, _tested(spans, battery)).otherwise(F.array().cast(TESTED))).drop(found)


def _at_most(k: int, n: int, share: float) -> float:
    """Probability of at most ``k`` successes in ``n`` trials."""
    log = lambda i: (
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share)
    )
    top = log(k)
    total, i = 0.0, k
    while i >= 0 and (term := math.exp(log(i) - top)) > 1e-12:
        total, i = total + term, i - 1
    return min(math.exp(top) * total, 1.0)


def chosen_cut(counts: list[tuple[int, int]], battery: Battery) -> float | None:
    """The least cut not refused, from each cut's tokens above it and above its middle; None if all are refused."""
    for i, (c, (n, upper)) in enumerate(zip(CUTS, counts)):
        expected = n * (1 - battery.false_share) / 2
        likely = upper >= expected or _at_most(upper, n, (1 - battery.false_share) / 2) >= battery.level
        if n and likely and (i == 0 or upper):
            return c
    return None


def class_cuts(docs: DataFrame, text: str = "text", battery: Battery = Battery()) -> dict[str, float]:
    """The least accepted p-value of every class of tokens, from the counts of distinct tokens of all documents."""
    out = fresh(docs, "tested")
    tested = candidates(docs.select(text), text, out, battery).select(F.explode(out).alias("t")).select("t.*")
    # long tokens go by their digest; those under the least cut are in no count
    single = tested.filter(F.col("p") >= CUTS[0]).select("kind", F.sha2("token", 256).alias("token"), "p").distinct()
    above = lambda c, name: F.count(F.when(F.col("p") >= c, 1)).alias(name)
    counts = [x for i, c in enumerate(CUTS) for x in (above(c, f"n{i}"), above((1 + c) / 2, f"upper{i}"))]
    cuts = {r["kind"]: chosen_cut([(r[f"n{i}"], r[f"upper{i}"]) for i in range(len(CUTS))], battery) for r in single.groupBy("kind").agg(*counts).collect()}
    return {kind: cut for kind, cut in cuts.items() if cut is not None}


def find_secrets(docs: DataFrame, text: str = "text", battery: Battery = Battery()) -> tuple[DataFrame, str]:
    """``docs`` with an array of spans (start, rank, end), sorted, whose name is returned too.

    ``rank`` numbers the kinds as in ``KINDS``; the battery's own kind is the last.
    """
    cuts = class_cuts(docs, text, battery)
    body = F.coalesce(F.col(text), F.lit(""))
    name, tested = fresh(docs, "spans"), fresh(docs, "tested")
    found = {k: fresh(docs, f"found_{k}") for k in ("assign", "values", "access", "hex")}
    out = candidates(docs, text, tested, battery).withColumns({
        found["assign"]: F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(0)),
        found["values"]: F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(1)),
        found["access"]: F.regexp_extract_all(body, F.lit(ACCESS), F.lit(0)),
        found["hex"]: F.regexp_extract_all(body, F.lit(HEX), F.lit(0)),
    })
    plain = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    assigned = F.zip_with(
        _located(body, ASSIGN, F.col(found["assign"]), 0), F.col(found["values"]),
        lambda s, v: F.when(F.length(v) >= LEAST_VALUE, plain(s)),
    )
    parts = [
        F.filter(assigned, lambda s: s.isNotNull()),
        F.transform(_located(body, ACCESS, F.col(found["access"]), 1), plain),
        F.transform(_located(body, HEX, F.col(found["hex"]), 2), plain),
    ]
    if cuts:
        limit = F.create_map(*(F.lit(x) for kv in sorted(cuts.items()) for x in kv))
        parts.append(F.transform(F.filter(F.col(tested), lambda s: s["p"] >= limit[s["kind"]]), plain))
    return out.withColumn(name, F.array_sort(F.concat(*parts))).drop(tested, *found.values()), name


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mark: str = "[SECRET]", **settings) -> DataFrame:
    """All documents, with each run of overlapping spans replaced by ``mark``; lengths are renewed where they change."""
    found, name = find_secrets(docs, text, **settings)
    spans = F.col(name)
    runs = F.aggregate(
        spans, F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"),
                F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
            ))),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    merged = fresh(found, "runs")
    out = found.withColumn(merged, F.when(F.size(spans) > 0, runs))
    r, body = F.col(merged), F.col(text)
    before = F.transform(r, lambda s, i: F.concat(
        body.substr(F.when(i > 0, F.get(r, i - 1)["end"]).otherwise(F.lit(0)) + 1,
                    s["start"] - F.when(i > 0, F.get(r, i - 1)["end"]).otherwise(F.lit(0))),
        F.lit(mark),
    ))
    clean = F.concat(F.array_join(before, ""), body.substr(F.element_at(r, -1)["end"] + 1, F.length(body)))
    out = out.withColumn(text, F.when(r.isNotNull(), clean).otherwise(body))
    if n_chars and n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(n_chars, F.when(F.col(merged).isNotNull(), F.length(text).cast(kind)).otherwise(F.col(n_chars)))
    return out.select(*docs.columns)
