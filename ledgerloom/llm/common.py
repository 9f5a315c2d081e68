"""Shared plumbing: tables, the shared scratch folder, distributed running sums and vectorised word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ship

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

pa.set_memory_pool(pa.system_memory_pool())  # the default pools keep what they once held

_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Only where that is unset and all of Spark is one local process, as in tests, a new local one."""
    ship(spark)
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, at = df.sparkSession, scratch(df.sparkSession, tag)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stashed_at = at
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete the files of stashed tables that no later result reads."""
    for df in stashed:
        spark, at = df.sparkSession, df.stashed_at
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *taken: list[str]) -> str:
    """`name`, or with underscores appended until no column of `taken` has it (Spark ignores case)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def pieces(it, rows: int = 500):
    """Arrow batches cut to `rows` rows: Spark bounds a batch's bytes, this bounds what is made of it. Pieces are copied, as some Arrow kernels misread slices."""
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b if b.num_rows <= rows else pa.concat_batches([b.slice(at, rows)])


def lean(f, rows: int = 500):
    """A batch function that sees batches of at most `rows` rows and gives freed memory back to the system when its task ends: workers are reused, and would keep it."""

    def run(it):
        try:
            yield from f(pieces(it, rows))
        finally:
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except OSError:  # another C library
                pass

    return run


def sample(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """At most `size` rows, those with the least hashes of `keys`: the same in every run if rows of equal keys are alike. All rows if there are no more than `size`.

    Only about twice as many rows pass the first filter, so that little is sorted.
    """
    n = df.count()
    if n <= size:
        return df
    h = F.pmod(F.xxhash64(*keys), F.lit(n))
    return df.where(h < 2 * size).orderBy(h, *keys).limit(size)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Add `before` (the sum of `value` over the rows of the same `group` that sort earlier) and `uid` (a unique row number).

    A range sort by (group, *order) deals any group, however hot, over many tasks; each task sums its own rows and one small table of
    (partition, group) totals carries the sums across tasks. `group` must not be null. Rows that tie on the whole order may be numbered
    either way. Two jobs; the sorted rows are written to the shared folder between them.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("uid", T.LongType()), T.StructField("before_here", T.LongType())])
    at_group, at_value = df.columns.index(group), df.columns.index(value)

    def sums(it):
        pid = TaskContext.get().partitionId()
        row, last, carried = 0, None, 0
        for b in it:
            n = b.num_rows
            if not n:
                continue
            v = b.column(at_value).to_numpy(zero_copy_only=False).astype(np.int64)
            g = b.column(at_group).dictionary_encode()
            code, names = g.indices.to_numpy(), g.dictionary.to_pylist()
            total = np.cumsum(v)
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            base = np.r_[0, total][first]
            base[0] -= carried if names[code[0]] == last else 0
            out = total - v - np.repeat(base, np.diff(np.r_[first, n]))
            last, carried = names[code[-1]], int(out[-1] + v[-1])
            uid = (np.int64(pid) << np.int64(40)) + np.arange(row, row + n)
            row += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, pid, np.int32)), pa.array(uid), pa.array(out)], names=[f.name for f in schema.fields])

    ranged = df.repartitionByRange(partitions(spark), group, *order).sortWithinPartitions(group, *order)
    local = stash(ranged.mapInArrow(lean(sums), schema), "running")
    totals = local.groupBy(group, "pid").agg(F.sum(value).alias("t"))
    earlier = Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "pid", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("o"))
    return local.join(offsets, [group, "pid"]).withColumn("before", F.col("before_here") + F.col("o")).drop("before_here", "o", "pid")


# ---------------------------------------------------------------- words and their hashes


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets (one more than texts), the flat dictionary codes of all words, and the dictionary. Null texts have no words."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    off = parts.offsets.to_numpy().astype(np.int64)
    enc = parts.flatten().dictionary_encode()
    off -= off[0]
    code, names = enc.indices.to_numpy(zero_copy_only=False), enc.dictionary
    empty = pc.index(names, pa.scalar("", names.type)).as_py()
    if empty >= 0:
        keep = code != empty
        off = np.r_[0, np.cumsum(keep)][off]
        code = code[keep]
    return off, code, names


#: Keys of two independent hashes of words.
WORD_KEYS = ("0123456789123456", "ledgerloom-words")


def word_hashes(names: pa.Array, key: str = WORD_KEYS[0]) -> np.ndarray:
    return pd.util.hash_array(np.array(names.to_pylist(), dtype=object), hash_key=key, categorize=False) if len(names) else np.empty(0, np.uint64)


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that the order of hashes says nothing about the words."""
    a = a ^ (a >> np.uint64(30))
    a = a * np.uint64(0xBF58476D1CE4E5B9)
    a = a ^ (a >> np.uint64(27))
    a = a * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def shingle_hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of `n` consecutive entries of `flat`, also of runs that cross texts; the caller drops those."""
    size = len(flat) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    a = np.zeros(size, np.uint64)
    for j in range(n):
        a *= _ODD
        a += flat[j : j + size]
    return mix(a)


def shingle_sets(texts: pa.Array, n: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its n-word shingles; with fewer words, of the whole sequence; none without words."""
    off, code, names = split_words(texts, lower)
    flat = word_hashes(names)[code]
    rolled = shingle_hashes(flat, n)
    out = []
    for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
        if j - i >= n:
            out.append(np.unique(rolled[i : j - n + 1]))
        elif j > i:
            out.append(shingle_hashes(np.r_[np.uint64(j - i), flat[i:j]], j - i + 1))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def larger(it, most: int = 8 << 20):
    """Join consecutive Arrow batches until they hold about `most` bytes."""
    held, size = [], 0
    for b in it:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def list_array(rows: list[np.ndarray], kind=np.int64) -> pa.Array:
    """A list column; 64-bit hashes keep their bits as signed longs."""
    off = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(kind) if flat.dtype.itemsize == np.dtype(kind).itemsize else flat.astype(kind)))
