"""Helpers shared by the text operators: table access, the shared folder, word hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, and of text whose words are hashed together.
BATCH_BYTES, HASHED_BYTES = 1 << 21, 1 << 17


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a temporary one, but only if executors are
    threads of this machine; a cluster has to name its folder."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("meshloom.scratch", None)
    if not own:
        own = tempfile.mkdtemp(prefix="meshloom-")
        spark.conf.set("meshloom.scratch", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches between Spark and its Python workers have BATCH_BYTES at most, from now on in this session; a smaller bound
    that is set stays. A batch is held by the executor and by its worker, several times each while it is built and turned into
    Python values, and what they took for it stays theirs. Spark's own bound is 10,000 rows of together 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is finished: it does so when the driver's JVM has collected their owners."""
    gc.collect()
    spark._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Delete the files behind a stashed DataFrame that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, id and UTF-8 bytes, a null text as an empty one. All else is pruned from the scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b"")).alias("body"))


def _table(separators: bytes) -> np.ndarray:
    is_separator = np.zeros(256, bool)
    is_separator[list(separators)] = True
    return is_separator


WHITE_SPACE = _table(b" \t\n\x0b\x0c\r")
WHITE_SPACE_AND_PUNCTUATION = WHITE_SPACE | _table(bytes(c for c in range(128) if not chr(c).isalnum()))
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse, by doubling; kept for later calls."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _powers.clear()
        for base in (_STEP, _BACK):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            _powers.append(p)
    return _powers[0], _powers[1]


def hashed_words(bodies: list[bytes], separators: np.ndarray = WHITE_SPACE, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): 64-bit hashes of all words of all bodies, a row each; the words of each body.

    Columns after the first are for the first `stems` bytes of a word, zero for a word without so many. A word's hash is a
    difference of prefix sums, so the cost is a few array operations a byte; the bytes are worked off in segments of
    HASHED_BYTES that end between words."""
    buffer = np.frombuffer(b"\n".join([*bodies, b""]), np.uint8)
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    out, begins, at = [], [], 0
    gaps = None
    while at < len(buffer):
        end = min(len(buffer), at + HASHED_BYTES)
        if end < len(buffer):
            gaps = np.nonzero(separators[buffer])[0] if gaps is None else gaps
            end = int(gaps[min(np.searchsorted(gaps, end), len(gaps) - 1)]) + 1
        some = buffer[at:end]
        up, down = _powers_to(len(some) + 1)
        inside = ~separators[some]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[some] * up[: len(some)], dtype=np.uint64)))
        columns = [mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))]
        for n in stems:
            stop = np.minimum(starts + n, ends)
            columns.append(np.where(ends - starts >= n, mixed((sums[stop] - sums[starts]) * down[starts] + np.uint64(n << 32)), np.uint64(0)))
        out.append(np.stack(columns, axis=1) if stems else columns[0])
        begins.append(starts + at)
        at = end
    if not out:
        return np.zeros((0, 1 + len(stems)) if stems else 0, np.uint64), np.zeros(len(bodies), np.int64)
    limits = np.searchsorted(np.concatenate(begins), np.cumsum(lengths + 1))
    return np.concatenate(out), np.diff(np.concatenate(([0], limits)))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of every window of `length` values; by doubling, so O(log length) passes."""
    n = len(h) - length + 1
    if n <= 0:
        return h[:0]
    done, acc, block, size = 0, np.zeros(n, np.uint64), h, 1
    mask = (1 << 64) - 1
    while True:
        if length & size:
            acc = acc * np.uint64(pow(base, size, 1 << 64) & mask) + block[done : done + n]
            done += size
        if done == length:
            return acc
        block = block[:-size] * np.uint64(pow(base, size, 1 << 64) & mask) + block[size:]
        size *= 2


#: Odd bases of two independent polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
