"""What the operators share: session settings, scratch tables and word hashing in numpy."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from twinsieve.session import reachable

#: Fixed value: the white space that separates words, as bytes.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text hashed at a time; bounds the working arrays of a task.
SLICE_BYTES = 2 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that go to Python workers by rows and bytes, and let workers find the package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return reachable(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def trim(spark: SparkSession) -> bool:
    """Give back to the system what the driver's JVM has freed beside its heap; whether the JVM can.

    Each plan leaves the memory of the compiler threads free but with the C library, which
    keeps it for each thread: hundreds of MB once some plans have run. Only memory that is
    in no use is given back. JVMs without this command, and other C libraries, are left as they are.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # by the public interface, as the class of the server is closed to reflection
        kinds = [jvm.java.lang.Class.forName(k) for k in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        call = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", _array(gateway, jvm.java.lang.Class, kinds))
        call.invoke(beans, _array(gateway, jvm.java.lang.Object, [command, "systemTrimNativeHeap", None, None]))
    except Py4JJavaError:
        return False
    return True


def _array(gateway, kind, values: list):
    out = gateway.new_array(kind, len(values))
    for k, v in enumerate(values):
        out[k] = v
    return out


class Scratch:
    """Parquet tables in the folder that all executors share, to cut lineage.

    The folder is spark.checkpoint.dir; where that is unset, as in tests on one
    machine, a folder of the warehouse is used.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.root = f"{root.rstrip('/')}/twinsieve-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        trim(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()
        trim(self.spark)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


# ---------------------------------------------------------------- hashing

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, size=4096, dtype=np.uint64) | np.uint64(1)
_NTH = _RNG.integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without copying, and the offsets of its rows; null is empty."""
    if pa.types.is_large_string(col.type):
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    else:
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    if col.null_count:
        lengths = np.where(np.asarray(col.is_valid()), np.diff(offsets), 0)
        if (np.diff(offsets) != lengths).any():
            return text_bytes(col.fill_null(""))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte and byte length of every word of a batch, in order.

    A word ends at white space or where its row ends. The bytes are taken in
    slices, cut at row ends or white space, so that memory does not follow the
    length of a row.
    """
    hashes, starts, lengths = [], [], []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE_BYTES)
        if end < n:
            row = offsets[np.searchsorted(offsets, end, side="right") - 1]
            if row > at:
                end = int(row)
            else:
                back = np.flatnonzero(_SPACE[data[at:end]])
                while not len(back) and end < n:
                    end = min(n, end + SLICE_BYTES)
                    back = np.flatnonzero(_SPACE[data[at:end]])
                end = at + int(back[-1]) + 1 if len(back) and end < n else end
        part = data[at:end]
        inner = offsets[(offsets > at) & (offsets < end)] - at
        solid = ~_SPACE[part]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        if len(inner):
            first[inner] = solid[inner]
            last[inner - 1] = solid[inner - 1]
        s = np.flatnonzero(first)
        if len(s):
            length = np.flatnonzero(last) + 1 - s
            place = np.arange(len(part), dtype=np.int64)
            place[s[0] :] -= np.repeat(s, np.diff(np.append(s, len(part))))
            value = _BYTE[_LOWER[part] if lower else part] * _PLACE[place & 4095]
            if length.max() > 4096:
                value *= mix((place >> 12).astype(np.uint64)) | np.uint64(1)  # 1 up to place 4095
            value *= solid
            value[: s[0]] = 0
            hashes.append(mix(np.add.reduceat(value, s) + length.astype(np.uint64)))
            starts.append(s + at)
            lengths.append(length)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(lengths)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words that follow one another (len - n + 1 of them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:m] * _NTH[0]
    for k in range(1, n):
        total = total + hashes[k : k + m] * _NTH[k]
    return mix(total + np.uint64(n))


def ends_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first word of each row, and the number of words at the end."""
    return np.searchsorted(starts, offsets, side="left")
