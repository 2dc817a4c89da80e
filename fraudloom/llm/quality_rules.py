"""Host-level quality rules (operator 9).

Every document is measured against rules on its whole text. The failures are
added up per host; the hosts' failure rates are shrunk towards a beta prior that
is fitted to all hosts, and a host's verdict decides how many failures its
documents may have.

Defined results: a null or empty text has no words and fails; a null host is a
host of its own; documents with the same id are separate rows; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.llm.common import annotate, fresh
from fraudloom.plans.sizing import sized
from fraudloom.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
_INNER = bytes(range(0x80, 0xC0))

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


@dataclass(frozen=True)
class Limits:
    """Rules: a document fails ``base`` outright; the soft rules are only counted."""

    least_words: int = 50
    repeat_percent: int = 50
    symbol_percent: int = 30
    dup_line_percent: int = 30
    least_word_chars: int = 2
    most_word_chars: int = 20
    #: A host whose shrunk failure rate reaches this is a poor one.
    host_rate: float = 0.5
    #: Failed soft rules that a document of a poor or any other host may have.
    poor_allowance: int = 0
    allowance: int = 1


def measure(data: bytes) -> tuple[int, int, int, int, int, int]:
    """The counts of one text. Words are runs without ASCII white space."""
    words = data.split()
    inside = b"".join(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    covered = 0
    if len(set(windows)) < len(windows):
        often, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return (
        len(words),
        len(inside.translate(None, _INNER)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        covered,
        len(lines),
    )


def _measured(texts: list[bytes]) -> Iterable[tuple]:
    return map(measure, texts)


def base_failed(c: str, limits: Limits = Limits()) -> Column:
    n = F.col(f"{c}.n_words")
    return (n < limits.least_words) | (100 * F.col(f"{c}.n_repeat_words") > limits.repeat_percent * n)


def soft_failures(c: str, limits: Limits = Limits()) -> Column:
    """How many of the soft rules a document fails."""
    n, chars = F.col(f"{c}.n_words"), F.col(f"{c}.word_chars")
    rules = [
        100 * F.col(f"{c}.n_symbols") > limits.symbol_percent * n,
        100 * F.col(f"{c}.n_dup_lines") > limits.dup_line_percent * F.col(f"{c}.n_lines"),
        (chars < limits.least_word_chars * n) | (chars > limits.most_word_chars * n),
    ]
    return sum((r.cast("int") for r in rules), F.lit(0))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta parameters by moments of the hosts' rates, weighted by documents.

    ``hosts`` has n and failed. Without spread beyond what sampling explains, or
    without rows, the prior is centred on the overall rate with the weight of an
    average host.
    """
    s = hosts.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum("failed").alias("failed"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("square"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    if not s["n"]:
        return 1.0, 1.0
    n, k = float(s["n"]), float(s["k"])
    mean = min(max(s["failed"] / n, 1 / (n + 2)), 1 - 1 / (n + 2))
    within, between = mean * (1 - mean), s["square"] - n * (s["failed"] / n) ** 2
    spread = (between - (k - 1) * within) / max(n - s["nn"] / n - (k - 1), 1e-9)
    share = spread / within if k > 1 else 0.0
    weight = 1 / share - 1 if 0 < share < 1 else n / k
    weight = max(weight, 1e-3)
    return mean * weight, (1 - mean) * weight


def judge(
    docs: DataFrame, host: str = "source", limits: Limits = Limits(), text: str = "text", keep_text: bool = True
) -> tuple[DataFrame, str]:
    """``docs`` with one struct column of counts and verdicts, whose name is returned too.

    Fields: the counts, base_failed, failures, host_rate (shrunk) and kept.
    The counts are written once, so that the texts are measured once for the two
    uses: adding up by host and joining the verdicts back.
    """
    name, key = fresh(docs, "rules"), fresh(docs, "host_key")
    counted = annotate(docs, name, COUNTS, _measured, text)
    if not keep_text:
        counted = counted.drop(text)
    counted = cut_lineage(counted.withColumn(
        name, F.col(name).withField("base_failed", base_failed(name, limits)).withField("failures", soft_failures(name, limits))
    ))
    failed = (F.col(f"{name}.base_failed") | (F.col(f"{name}.failures") > 0)).cast("long")
    hosts = cut_lineage(counted.groupBy(F.col(host).alias(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(failed).alias("failed")))
    a, b = beta_prior(hosts)
    poor = hosts.select(
        F.col(key), ((F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias("host_rate")
    ).filter(F.col("host_rate") >= limits.host_rate)
    width = poor.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length(key)), F.lit(0))).first()
    joined = counted.join(sized(poor.withColumnRenamed("host_rate", f"{key}_rate"), width[0], 4 * width[1] + 16), F.col(host).eqNullSafe(F.col(key)), "left")
    is_poor = F.col(f"{key}_rate").isNotNull()
    allowed = F.when(is_poor, F.lit(limits.poor_allowance)).otherwise(F.lit(limits.allowance))
    kept = ~F.col(f"{name}.base_failed") & (F.col(f"{name}.failures") <= allowed)
    return joined.withColumn(
        name, F.col(name).withField("host_rate", F.col(f"{key}_rate")).withField("kept", kept)
    ).drop(key, f"{key}_rate"), name


def keep_good(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    judged, name = judge(docs, host, limits)
    return judged.filter(F.col(f"{name}.kept")).select(*docs.columns)
