"""License scans by an exact set-similarity join (operator 5).

Text blocks are joined with license templates wherever a block holds at least
``share`` of a template's distinct words:

* tokens are ordered by how many documents of the whole corpus hold them, rarest
  first;
* prefix filter: a block that holds ``need`` of a template's ``size`` tokens holds
  one of its ``size - need + 1`` rarest, so only blocks around those are looked at;
* length filter: a block with fewer than ``need`` template tokens is passed over;
* positional filter: a first common token at places i and j of the two sorted sets
  leaves at most 1 + min(size - i - 1, block - j - 1) common tokens;
* what is left is counted exactly.

Blocks are windows of words, twice as long as a template needs and half
overlapping, so every run of words as long as a template lies in one.

Templates are sent to the workers in parts of at most ``part_tokens`` tokens, one
pass over the documents each; the driver holds one part at a time. Fixed phrases
are found beside them, at all their places.

Defined results: null and empty texts have no words and no labels; templates
without words match nothing; equal templates all match; an empty template table
leaves the fixed phrases only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.llm.common import annotate, bytes_of, fresh, plain_words
from fraudloom.llm.common import share as by_value
from fraudloom.session import cut_lineage

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices that licenses ask to be shown, with labels.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the software without restriction"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
)

SHARE = 0.9
PART_TOKENS = 50_000
MATCHES = "array<struct<template:int,label:string,first:long,last:long,shared:int,size:int>>"


def notices(spark: SparkSession) -> DataFrame:
    """The built-in templates as a table (label, text)."""
    return spark.createDataFrame(list(NOTICES), "label string, text string")


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    tokens: tuple[bytes, ...]  # rarest first
    need: int
    span: int  # words of a block

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.tokens[: len(self.tokens) - self.need + 1]


def block_words(words: int) -> int:
    """Words of a block for templates of this many words: a power of two, at least twice as long."""
    return max(16, 1 << max(2 * words - 1, 1).bit_length())


class Index:
    """Templates by their prefix tokens, under a global order of tokens."""

    def __init__(self, rows: list[tuple[int, str, list[bytes]]], frequency: dict[bytes, int], share: float):
        self.order = {t: i for i, t in enumerate(sorted({t for _, _, ws in rows for t in ws}, key=lambda t: (frequency.get(t, 0), t)))}
        self.by_token: dict[bytes, list[tuple[Template, int]]] = {}
        for number, label, words in rows:
            tokens = tuple(sorted(set(words), key=self.order.__getitem__))
            made = Template(number, label, tokens, max(ceil(share * len(tokens) - 1e-9), 1), block_words(len(words)))
            for i, t in enumerate(made.prefix):
                self.by_token.setdefault(t, []).append((made, i))

    def matches(self, words: list[bytes]) -> list[tuple[int, str, int, int, int, int]]:
        """(template, label, first word, end word, shared, size) of every block that meets a template."""
        if self.by_token.keys().isdisjoint(words):
            return []
        asked: dict[tuple[int, int], dict[Template, int]] = {}
        for at, w in enumerate(words):
            for template, i in self.by_token.get(w, ()):
                half = template.span // 2
                for start in {max(at // half - 1, 0) * half, at // half * half}:
                    known = asked.setdefault((start, template.span), {})
                    known[template] = min(known.get(template, i), i)
        found = []
        for (start, span), templates in sorted(asked.items()):
            held = {w for w in words[start : start + span] if w in self.order}
            ranked = sorted(held, key=self.order.__getitem__)
            place = {t: j for j, t in enumerate(ranked)}
            for template, i in templates.items():
                size = len(template.tokens)
                if len(ranked) < template.need:  # length filter
                    continue
                j = place[template.tokens[i]]
                if 1 + min(size - i - 1, len(ranked) - j - 1) < template.need:  # positional filter
                    continue
                shared = sum(t in held for t in template.tokens)
                if shared >= template.need:
                    found.append((template.number, template.label, start, min(start + span, len(words)), shared, size))
        return sorted(found)


def template_parts(templates: DataFrame, label: str, text: str, part_tokens: int) -> Iterator[list[tuple[int, str, list[bytes]]]]:
    """(number, label, words) of the templates, in parts of bounded size."""
    part, held = [], 0
    for number, row in enumerate(templates.select(label, text).toLocalIterator()):
        words = plain_words((row[1] or "").encode())
        if not words or row[0] is None:
            continue
        if part and held + len(words) > part_tokens:
            yield part
            part, held = [], 0
        part.append((number, row[0], words))
        held += len(words)
    if part:
        yield part


def token_frequency(docs: DataFrame, tokens: Iterable[bytes], text: str = "text") -> dict[bytes, int]:
    """How many documents hold each of some tokens; at most one row per token comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value, Counter()
        for batch in batches:
            for t in bytes_of(batch.column(0)):
                counts.update(known.intersection(plain_words(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    rows = docs.select(text).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


def template_matches(
    docs: DataFrame, templates: DataFrame, share: float = SHARE, part_tokens: int = PART_TOKENS, text: str = "text",
    label: str = "label", template_text: str = "text",
) -> tuple[DataFrame, str]:
    """``docs`` with an array of matching blocks in a struct column ``.matches``, whose name is returned too."""
    name, spark, found = fresh(docs, "blocks"), docs.sparkSession, None
    for part in template_parts(templates, label, template_text, part_tokens):
        frequency = token_frequency(docs, {w for _, _, ws in part for w in ws}, text)
        shared = by_value(spark, Index(part, frequency, share))
        if found is None:
            found = annotate(docs, name, f"matches {MATCHES}", _matcher(shared), text)
            continue
        found = cut_lineage(found)  # one part at a time in a worker
        more = fresh(found, "more")
        found = annotate(found, more, f"matches {MATCHES}", _matcher(shared), text)
        found = found.withColumn(name, F.struct(F.concat(f"{name}.matches", f"{more}.matches").alias("matches"))).drop(more)
    if found is None:
        found = docs.withColumn(name, F.struct(F.array().cast(MATCHES).alias("matches")))
    return found, name


_FIELDS = ("template", "label", "first", "last", "shared", "size")


def _matcher(shared):
    def rows(texts: list[bytes]) -> Iterable[tuple]:
        index = shared()
        return (([dict(zip(_FIELDS, m)) for m in index.matches(plain_words(t))],) for t in texts)

    return rows


def phrase_places(docs: DataFrame, phrases: dict[str, str] = PHRASES, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column: n_words, n_base, first_word, last_word, base_labels (sorted)."""
    name = fresh(docs, "phrases")
    known: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in phrases.items():
        words = plain_words(phrase.encode())
        known.setdefault(words[0], []).append((words, label))

    def rows(texts: list[bytes]) -> Iterable[tuple]:
        for t in texts:
            words = plain_words(t)
            places, labels = [], set()
            if not known.keys().isdisjoint(words):
                for at, w in enumerate(words):
                    for asked, label in known.get(w, ()):
                        if words[at : at + len(asked)] == asked:
                            places.append(at)
                            labels.add(label)
            yield len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>"
    return annotate(docs, name, fields, rows, text), name


def scan(docs: DataFrame, templates: DataFrame | None = None, share: float = SHARE, text: str = "text") -> tuple[DataFrame, str, str]:
    """Phrases and template matches together; the names of both struct columns are returned too."""
    based, phrases = phrase_places(docs, text=text)
    found, blocks = template_matches(based, notices(docs.sparkSession) if templates is None else templates, share, text=text)
    return found, phrases, blocks
