"""Helpers shared by the operators: stored tables, Arrow text batches, vectorised hashing."""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.session import shared_scratch

#: Rows sent to Python at once. Texts may be very long, so batches are kept small.
ROWS_PER_BATCH = 512
#: Bytes of text handled at once by the vectorised code; one longer text is handled alone.
BYTES_AT_ONCE = 1 << 20

_scratch: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and go on from the files.

    This cuts lineage: a lost executor repeats only what follows. The files are removed when the
    driver process ends.
    """
    spark = df.sparkSession
    path = shared_scratch(spark)
    df.write.parquet(path)
    if not _scratch:
        atexit.register(_remove_scratch)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove_scratch() -> None:
    for spark, path in _scratch:
        context = spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            continue
        with contextlib.suppress(Py4JError, OSError):  # the session may be going down
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key's text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string")) % folds


def replace_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns; input columns of the same names (in any case) give way."""
    names = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *(value.alias(name) for name, value in columns.items()))


# -- texts of an Arrow array ---------------------------------------------------------------------


def texts_of(array: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [value or "" for value in array.to_pylist()]


def text_slices(array: pa.Array, limit: int = BYTES_AT_ONCE) -> Iterator[pa.Array]:
    """Runs of consecutive texts of at most ``limit`` bytes, or one longer text."""
    if len(array) == 0:
        return
    ends = np.cumsum(np.diff(byte_view(array)[1]))
    start = 0
    while start < len(array):
        done = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, done + limit, side="right")), start + 1)
        yield array.slice(start, stop - start)
        start = stop


def byte_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts together and the offsets of the texts; null is empty."""
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


# -- hashing -------------------------------------------------------------------------------------

#: Two primes below 2^31: products of residues fit 64 bits, and so do sums of 2^32 of them.
#: Powers of two as modulus would give long alternating words one hash.
_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = (1_220_703_125, 1_162_261_467)
_BYTES = [np.random.default_rng(seed).integers(1, p, 256, np.int64) for seed, p in enumerate(_PRIMES)]
_powers: dict[tuple[int, int], np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _power(base: int, prime: int, length: int) -> np.ndarray:
    """The first ``length`` powers of ``base`` modulo ``prime``, remembered."""
    found = _powers.get((base, prime), np.ones(1, np.int64))
    while len(found) < length:
        found = np.concatenate((found, found * pow(base, len(found), prime) % prime))
    _powers[base, prime] = found
    return found[:length]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from running polynomial sums over all bytes.

    Two independent prime fields, 62 bits together, and the length.
    """
    found = np.zeros(len(starts), np.uint64)
    for values, base, prime in zip(_BYTES, _BASES, _PRIMES, strict=True):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(values[data] * _power(base, prime, len(data)) % prime, out=sums[1:])
        back = _power(pow(base, -1, prime), prime, len(data) + 1)
        own = (sums[ends] - sums[starts]) % prime * back[starts] % prime
        found = (found << np.uint64(31)) | own.astype(np.uint64)
    return mix(found + mix((ends - starts).astype(np.uint64)))


def word_spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``member`` bytes; a run ends where its text ends."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(member), bool)
    first[offsets[:-1][offsets[:-1] < len(member)]] = True
    before = np.concatenate(([False], member[:-1]))
    starts = np.flatnonzero(member & (first | ~before))
    last = np.concatenate((first[1:], [True]))
    after = np.concatenate((member[1:], [False]))
    return starts, np.flatnonzero(member & (last | ~after)) + 1


def texts_at(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of the text that each byte position belongs to."""
    return np.searchsorted(offsets, positions, side="right") - 1


#: White space of the word-based operators: blank, tab, line feed, vertical tab, form feed, return.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every white-space-separated word, A-Z lower-cased."""
    starts, ends = word_spans(~_BLANK[data], offsets)
    return hash_spans(_LOWER[data], starts, ends), texts_at(starts, offsets)

