"""What the training-data operators share: scratch tables, Arrow maps, word rules."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder that driver and executors share; a cluster names it, tests may not.
SHARED_DIR = "spark.checkpoint.dir"
#: Bounds of what one Arrow batch may hold, so that long texts don't fill a Python worker.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20

_own_dir: str | None = None


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh local one where it is unset and all is local."""
    global _own_dir
    named = spark.conf.get(SHARED_DIR, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError(f"set {SHARED_DIR} to a folder that all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="gridloom-")
    return f"file://{_own_dir}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now, not when memory happens to run short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(t._gridloom_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, unless they are bounded tighter already."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in str(now or "") if c.isdigit())
        if not digits or int(digits) > bound or int(digits) <= 0:
            spark.conf.set(key, str(bound))


def arrow_map(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """df through f, batch by batch: f gets and returns columns as lists (or numpy arrays)."""
    small_batches(df.sparkSession)
    out_schema = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = f({n: b.column(i) for i, n in enumerate(b.schema.names)})
                yield record_batch(cols, out_schema)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def with_fields(df: DataFrame, ddl: str):
    """df's schema with the fields of ddl behind it."""
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def record_batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        c = cols[field.name]
        arrays.append(c.cast(field.type) if isinstance(c, pa.Array) else pa.array(c, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def as_bytes(c: Column | str) -> Column:
    """A string's UTF-8 bytes, so that Python neither decodes nor encodes them."""
    return (F.col(c) if isinstance(c, str) else c).cast("binary")


def sha256_hex(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# --- words -------------------------------------------------------------------------------------

#: Lower-cases A-Z and turns every ASCII byte that is neither a letter nor a digit into a space.
ALNUM = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
#: Lower-cases A-Z, nothing else.
LOWER = bytes((c + 32 if 65 <= c <= 90 else c) for c in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all non-ASCII characters, A-Z in lower case."""
    return text.translate(ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but the ASCII white space 09-0D and 20; bytes.split() splits at just those."""
    return text.split() if text else []


# --- hashes ------------------------------------------------------------------------------------

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word of space_words(text), without making the words."""
    b = np.frombuffer(text, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.uint64)
    space = _SPACE[b]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(_P, len(b)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_P_INV, len(b))[start])


def gram_hashes(h: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of all runs of k consecutive entries of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    p = powers(base, k)
    out = h[:n] * p[0]
    for j in range(1, k):
        out = out + h[j : j + n] * p[j]
    return mix(out)


def run_hashes(h: np.ndarray, starts: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hashes of the runs of k entries of h that begin at starts, by prefix sums."""
    inv = pow(base, -1, 1 << 64)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(base, len(h)), out=sums[1:])
    return mix((sums[starts + k] - sums[starts]) * powers(inv, len(h))[starts])


def hex_unsigned(c: Column) -> Column:
    """A long's 64 bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
