"""Small helpers shared by the operators: table reading, Arrow batches, word splitting."""

from __future__ import annotations

import hashlib
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Rows and bytes of one Arrow batch sent to Python: texts are long, so Spark's
#: defaults of 10,000 rows and 64 MB would fill a worker with one batch.
BATCH_ROWS, BATCH_BYTES = "1000", str(4 << 20)

WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Lower-cases A-Z and turns every byte outside a word into a space. Words are
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over code points; all bytes of a code point
#: beyond ASCII are 0x80 or more, so the rule can be applied byte by byte.
FOLD = bytes(ord(chr(b).lower()) if 0x41 <= b <= 0x5A else b if b in WORD_BYTES else 0x20 for b in range(256))


def bound_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches of this session hold few rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_words(data: bytes) -> list[bytes]:
    """Folded words of a text: letters, digits and everything beyond ASCII."""
    return data.translate(FOLD).split()


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def bytes_of(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def parts_by_bytes(texts: list[bytes], most: int = 1 << 18) -> Iterator[list[bytes]]:
    """Consecutive texts in lists of at most ``most`` bytes; a longer text is a list of its own."""
    part: list[bytes] = []
    held = 0
    for t in texts:
        if part and held + len(t) > most:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def annotate(
    docs: DataFrame, name: str, fields: str, rows: Callable[[list[bytes]], Iterable[tuple]], text: str = "text"
) -> DataFrame:
    """``docs`` with one struct column ``name``, computed from each whole text.

    All columns are handed through unread. ``rows`` gets the texts of an Arrow
    batch as UTF-8 bytes (null is empty) and yields the struct's values for each.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    added = StructType.fromDDL(fields)
    schema = StructType([*docs.schema.fields, StructField(name, added)])
    types, at = list(to_arrow_schema(added)), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(rows(bytes_of(batch.column(at))))
            values = zip(*made) if made else [[] for _ in types]
            column = pa.StructArray.from_arrays(
                [pa.array(list(v), f.type) for v, f in zip(values, types)], fields=types
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def once_per_worker(key, make: Callable[[], object], most: int = 4) -> object:
    """``make()``, kept over the tasks of a Python worker; the ``most`` last keys are kept.

    The values lie in a module of their own, as this package's modules are not those
    of the next task where its functions travel by value.
    """
    module = sys.modules.setdefault("_fraudloom_worker", types.ModuleType("_fraudloom_worker"))
    kept = module.__dict__.setdefault("kept", {})
    if key not in kept:
        while len(kept) >= most:
            kept.pop(next(iter(kept)))
        kept[key] = make()
    return kept[key]


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of an object of this package; what is returned gives it to a worker that has no copy of the package."""
    sent, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: once_per_worker(key, lambda: cloudpickle.loads(sent.value))


def tokenizer_file(name: str) -> str:
    """Default place of a public tokenizer's file; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id"):
    """True for documents whose labels are kept from training: crc32 of the id's text is 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
