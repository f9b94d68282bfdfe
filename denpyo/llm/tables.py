"""Reading inputs and cutting lineage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session (one process, as in tests) that names none gets a temporary one,
    remembered in the session; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("denpyo.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="denpyo-")
        spark.conf.set("denpyo.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows that travel to Python at a time: texts may be long, and a batch is held whole on either side.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lets no more than BATCH_ROWS rows travel to Python at a time, in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_left: list[tuple] = []


@atexit.register
def _clear() -> None:
    """Delete what this process's operators left in the shared folder; results are lazy, so no earlier moment is safe."""
    for jvm, conf, root in _left:
        with contextlib.suppress(Exception):  # the JVM may be gone
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)


class Workspace:
    """Tables of one operator run, below the shared folder; they go when the process ends.

    `keep` writes a frame and reads it back, so that what follows neither
    recomputes it nor depends on shuffle files of executors that may be lost.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/denpyo/{name}-{uuid.uuid4().hex}"
        _left.append((spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), self.root))
        self._n = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def release(self) -> None:
        """Let Spark delete shuffle files that no frame needs any more; it does when the driver collects garbage.

        What the first round frees in Python still holds on to the JVM's frames until the JVM has heard of it, so a second one follows.
        """
        for pause in (0.5, 0):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(pause)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that `keep` returned and nothing reads any more."""
        _, path = self._paths.pop(id(df))
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken, name: str) -> str:
    """`name`, with underscores added until no name in `taken` is like it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str, kind: str):
    """The named column cast to `kind`; null where the frame lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def bitmap(df: DataFrame, name: str, most_bits: int = 26, hashed: bool = False, per: int = 8):
    """Which hashes of the long column `name` occur: a numpy bit map of some `per` bits a row, at most 2**most_bits.

    The hash is Spark's xxhash64, or the value itself where `hashed` says that it is one.

    A filter with false positives only; its size is bounded however many rows there are,
    so it may be sent to every task.
    """
    import numpy as np

    n = df.count()
    bits = min(most_bits, max(10, int(per * n + 1).bit_length()))
    value = f"`{name}`" if hashed else f"xxhash64(`{name}`)"
    word = F.expr(f"shiftrightunsigned({value}, {64 - bits + 6})")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({value}, {64 - bits}) & 63 AS INT))")
    words = df.where(F.col(name).isNotNull()).select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    if table.num_rows:
        out[table.column("w").to_numpy()] = table.column("b").to_numpy().view(np.uint64)
    return bits, out


def maybe_in(column_hash, bits: int, words):
    """Which of the 64-bit hashes a bitmap holds."""
    import numpy as np

    h = column_hash.view(np.uint64) >> np.uint64(64 - bits)
    return (words[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1
