"""Benchmark decontamination (operator 4).

The benchmark's normalised windows of consecutive words become a hash set that
is broadcast; every document's word windows are looked up in it, hits are
verified on the words themselves, and hit spans or whole documents are removed.

The broadcast is bounded: the benchmark is dealt into blocks of at most
``block_windows`` windows (a longer item into overlapping ranges), each block is sent
in its own pass over the documents, whose word marks are written before the next and
joined. Nothing is left out of a large benchmark.

A first look-up takes only every ``step``-th word of a document, with runs of
words so short that every window holds one that starts there; only around those
that are known are whole windows looked up.

Defined results: null and empty texts have no words and are clean; items without
words match nothing; equal items are all reported; a null item_id still marks
words but is not listed; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.llm.common import FOLD, annotate, fresh, plain_words, share
from fraudloom.session import cut_lineage

#: Windows of one broadcast block. A window of the default size is about 100
#: bytes of words, so a block takes some tens of MB in a worker.
BLOCK_WINDOWS = 100_000
WINDOW = 13
FOUND = "n_words long, hit array<int>, items array<string>"

_WORD = re.compile(rb"[^ ]+")


@dataclass(frozen=True)
class WindowSet:
    """Windows of one block of the benchmark, by length.

    ``windows`` maps a window's words to the items that hold it. ``runs`` are all
    runs of ``length - step + 1`` words inside windows of that length: any window
    in a document covers one that starts at a multiple of ``step``.
    """

    windows: dict[int, dict[bytes, list[str]]]
    runs: dict[int, tuple[int, int, frozenset]]

    @staticmethod
    def of(items: Iterable[tuple[str, list[bytes]]], window: int) -> "WindowSet":
        windows: dict[int, dict[bytes, list[str]]] = {}
        for item, words in items:
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                windows.setdefault(size, {}).setdefault(b" ".join(words[i : i + size]), []).append(item)
        runs = {}
        for size, own in windows.items():
            step = max(size // 3, 1)
            width = size - step + 1
            split = (w.split() for w in own)
            runs[size] = (step, width, frozenset(b" ".join(w[i : i + width]) for w in split for i in range(step)))
        return WindowSet(windows, runs)

    def search(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Positions of hit words, and the items whose windows occur."""
        hit, items = set(), set()
        for size, (step, width, runs) in self.runs.items():
            known, last = self.windows[size], -1
            for at in range(0, len(words) - width + 1, step):
                if b" ".join(words[at : at + width]) not in runs:
                    continue
                for start in range(max(at - step + 1, last + 1, 0), min(at, len(words) - size) + 1):
                    last = start
                    found = known.get(b" ".join(words[start : start + size]))
                    if found is not None:
                        hit.update(range(start, start + size))
                        items.update(x for x in found if x is not None)
        return sorted(hit), items


def window_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_windows: int) -> Iterable[WindowSet]:
    """The benchmark's windows, block by block; the driver holds one block at a time."""
    rows, held = [], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        words = plain_words((row[1] or "").encode())
        if not words:
            continue
        windows = max(len(words) - window + 1, 1)
        for at in range(0, windows, block_windows):  # a long item is split into overlapping ranges
            size = min(block_windows, windows - at)
            if rows and held + size > block_windows:
                yield WindowSet.of(rows, window)
                rows, held = [], 0
            rows.append((row[0], words[at : at + size + window - 1]))
            held += size
    if rows:
        yield WindowSet.of(rows, window)


def _searcher(shared):
    def rows(texts: list[bytes]) -> Iterable[tuple]:
        known = shared()
        for t in texts:
            words = plain_words(t)
            hit, items = known.search(words)
            yield len(words), hit, sorted(items)

    return rows


def find_windows(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
    item: str = "item_id", text: str = "text",
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (n_words, hit, items), whose name is returned too.

    ``hit`` lists the positions of hit words, ``items`` the sorted item ids.
    """
    name, spark = fresh(docs, "found"), docs.sparkSession
    found = None
    for block in window_blocks(benchmark, item, text, window, block_windows):
        shared = share(spark, block)
        if found is None:
            found = annotate(docs, name, FOUND, _searcher(shared))
            continue
        found = cut_lineage(found)  # one block at a time in a worker
        more = fresh(found, "more")
        found = annotate(found, more, FOUND, _searcher(shared))
        found = found.withColumn(name, F.struct(
            F.col(f"{name}.n_words").alias("n_words"),
            F.array_sort(F.array_union(f"{name}.hit", f"{more}.hit")).alias("hit"),
            F.array_sort(F.array_union(f"{name}.items", f"{more}.items")).alias("items"),
        )).drop(more)
    if found is None:
        found = annotate(docs, name, FOUND, lambda texts: ((len(plain_words(t)), [], []) for t in texts))
    return found, name


def contaminated(found: str, percent: int = 5) -> Column:
    """A document is contaminated when at least ``percent`` of its words are hit."""
    hit = F.size(f"{found}.hit")
    return (hit > 0) & (100 * hit >= percent * F.col(f"{found}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 5, **settings) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    found, name = find_windows(docs, benchmark, **settings)
    return found.filter(~contaminated(name, percent)).select(*docs.columns)


def _cut(text: bytes, hit: list[int]) -> str:
    """A text without its runs of hit words and what lies between the words of a run."""
    out, at, last, gone = [], 0, -2, set(hit)
    for i, m in enumerate(_WORD.finditer(text.translate(FOLD))):
        if i in gone:
            if last != i - 1:
                out.append(text[at : m.start()])
            at, last = m.end(), i
    return b"".join([*out, text[at:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **settings) -> DataFrame:
    """All documents, their hit words cut out of the text. Null texts stay null."""
    found, name = find_windows(docs, benchmark, **settings)

    @F.pandas_udf("string")
    def cut(t, hit):
        return t.combine(hit, lambda a, b: a if a is None or b is None or not len(b) else _cut(a.encode(), list(b)))

    return found.withColumn(text, cut(F.col(text), F.col(f"{name}.hit"))).select(*docs.columns)


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


