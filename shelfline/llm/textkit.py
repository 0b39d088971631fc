"""Vectorised text helpers that run inside Spark tasks, and the bounded labelled sample of the classifiers."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import suppress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

CHUNK_BYTES = 1_500_000
_remembered: dict = {}      # what this Python worker keeps from task to task, as tokenizers and the words they have cut
_BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTERLIKE = np.zeros(256, bool)
LETTERLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words(NamedTuple):
    """The words of some texts: start and length in ``buf``, the text each is from, and a 64-bit hash."""
    buf: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    doc_start: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def chunks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES, so that working arrays stay small; one long text is a range."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK_BYTES:
            yield lo, i
            lo, held = i, 0
        held += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def run_hash(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run; runs must not be empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    at = np.cumsum(length) - length
    offset = np.arange(int(length.sum())) - np.repeat(at, length)
    value = (buf[offset + np.repeat(start, length)].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[offset]
    return mix(np.add.reduceat(value, at))


def words(texts: Sequence[bytes], member: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``member`` is true."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    doc_start = np.cumsum(sizes) - sizes
    inside = np.concatenate(([False], member[buf], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2]
    doc = np.searchsorted(doc_start, start, "right") - 1
    return Words(buf, start, length, doc, run_hash(buf, start, length), doc_start)


def release() -> None:
    """Gives freed memory back to the system at the end of a task. Python workers live on for the tasks and stages
    that follow, and what their allocators keep counts against the executor."""
    import ctypes
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):         # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def remembered(key, make):
    """What ``make`` gave in this Python worker. It is kept until a task runs that does not use it (``releasing``)."""
    if key not in _remembered:
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    _remembered.clear()


def releasing(make, remembers: bool = False):
    """A function from batches to batches that releases memory when its task ends. Unless it ``remembers``, it also
    gives back at its start what tasks of other stages left in the worker, so stages do not add up."""
    def run(batches):
        if not remembers:
            forget()
        yield from make(batches)
        release()
    return run


def raw(text: str | None) -> bytes:
    return text.encode("utf-8") if isinstance(text, str) else b""


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def fold_of(doc_id: str | Column, modulo: int) -> Column:
    """crc32 of the id's text, modulo ``modulo``."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % modulo


def hash_share(*cols: str) -> Column:
    """A value in [0, 1) that depends on the named columns only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled_sample(labels: DataFrame, target: str, modulo: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, target) of at most about ``per_class`` rows of each class outside the held-out fold.

    Rows with a null id or label, or a label other than 0 and 1, are no labels. An id with several labels
    takes the more frequent one, 1 in a tie. The sample is chosen by a hash of the id, so it is the same on
    every run; its expected size per class is min(per_class, rows of that class).
    """
    known = (labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of("doc_id", modulo) != held_out))
             .groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("int").alias("target")))
    sizes = {r["target"]: r["n"] for r in known.groupBy("target").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for y, n in sizes.items():
        rate = F.when(F.col("target") == y, F.lit(per_class / n)).otherwise(rate)
    return known.where(hash_share("doc_id") < rate)


def sampled_texts(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """Texts of the sampled ids. The sample is bounded by its parameter, so it is broadcast."""
    return documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def with_columns_from_text(df: DataFrame, fields: Sequence[T.StructField], make, rows: int = 512) -> DataFrame:
    """Adds columns that ``make`` derives from a list of texts (str or None). Every other column stays as it is.

    Columns that already have one of the new names, in any case, are replaced.
    """
    taken = {f.name.lower() for f in fields}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])

    def apply(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                made = make(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(made[f.name]) for f in fields]],
                                                 [*part.schema.names, *[f.name for f in fields]])
    return base.mapInArrow(releasing(apply), T.StructType([*base.schema.fields, *fields]))
