"""Shared plumbing of the corpus operators: tables, scratch space, byte kernels."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch, the same for all operators: a plan is run long after it is built.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a local one on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lintlake-"))
        found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may have ended before the interpreter
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and survives lost executors.

    The shuffle files of the write are of no more use after it, so Spark is told to delete them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lintlake/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what `stored` wrote for these tables, which nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._stored_at)


#: What operators remember in a worker from task to task; all of it can be made anew.
REMEMBERED: list[dict] = []


def release(own: dict | None = None) -> None:
    """Forget what other operators than that of `own` remember and give memory that is free back to the system. Workers live on
    and run tasks of other operators, and what is remembered and what the allocators keep adds up over them."""
    for x in REMEMBERED:
        if x is not own:
            x.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def crc_mod(doc_id: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


# ------------------------------------------------------------------ byte kernels

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTE = ~SPACES

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (finaliser with two multiplications)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
#: The values of bytes with A-Z read as a-z.
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_P, _PI)):
            steps = np.full(n + 1, base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of `buf`, equal for equal bytes wherever they stand."""
    up, down = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((_BYTE_FOLDED if folded else _BYTE)[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(_P))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data and len(column) else np.zeros(0, np.uint8)
    return buf, off - off[0] if len(off) else np.zeros(1, np.int64)


def pieces(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about `limit` bytes, one row at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def stretches(buf: np.ndarray, off: np.ndarray, limit: int = 1 << 17, long: int = 1 << 22) -> Iterator[tuple[int, int, int, int, bool]]:
    """Rows x .. y - 1, their bytes a .. z, and whether the last of them ends there.

    Short rows come together, up to about `limit` bytes; a row of over `long` bytes comes alone, cut before white space.
    """
    for x, y in pieces(off, limit):
        a, z = int(off[x]), int(off[y])
        while y - x == 1 and z - a > long:
            b = a + long
            while b < z and not SPACES[buf[b]]:
                more = np.flatnonzero(SPACES[buf[b : b + long]])
                b = b + int(more[0]) if len(more) else min(b + long, z)
            if b >= z:
                break
            yield x, y, a, b, False
            a = b
        yield x, y, a, z, True


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers of up to 64 bits as compressed byte planes."""
    x = np.ascontiguousarray(x).astype(U64)
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    raw = planes.tobytes()
    return np.array([len(x), width], np.int64).tobytes() + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data[:16], np.int64).tolist()
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(pa.decompress(data[16:], n * width, "zstd"), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(U64)


def pack_sorted(x: np.ndarray) -> bytes:
    """Like `pack`, for values in ascending order: their steps are smaller than they are."""
    x = x.astype(U64)
    return pack(np.concatenate([x[:1], x[1:] - x[:-1]]))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=U64)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, from batches sorted by them."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in range(keys)]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        cut = [0, *edge.tolist(), b.num_rows]
        if rest and any(rest[-1].column(k)[-1] != b.column(k)[0] for k in range(keys)):
            yield pa.Table.from_batches(rest)
            rest = []
        for a, z in zip(cut[:-2], cut[1:-1], strict=True):
            yield pa.Table.from_batches([*rest, b.slice(a, z - a)])
            rest = []
        rest.append(b.slice(cut[-2]))
    if rest:
        yield pa.Table.from_batches(rest)


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each row: starts, ends and the number of words before each row (n+1)."""
    word = WORD_BYTE[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def ragged(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and n+1 cuts."""
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values, type=kind))


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
