"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..shipping import ship

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_BYTES = 1 << 20          # texts are hashed in pieces of about this many bytes


def prepared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)`` with the id as long and a null text as the empty string;
    all other columns are dropped, whatever their names."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def told_apart(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``texts(doc_id, text)`` with an id of its own for every different text where some id
    carries several, and the names of those ids ``(key, doc_id)``; without such an id the
    rows as they are and None. The new ids keep the order of the old ones, texts of one id
    stand in the order of their digests; null ids stay null."""
    code = F.xxhash64("text")
    if texts.groupBy("doc_id").agg(F.min(code).alias("a"), F.max(code).alias("b")).filter("doc_id IS NOT NULL AND a <> b").isEmpty():
        return texts, None
    spark = texts.sparkSession
    digested = texts.withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256))
    places = digested.filter("doc_id IS NOT NULL").select("doc_id", "digest").distinct().orderBy("doc_id", "digest").rdd.zipWithIndex()
    names = stored(spark.createDataFrame(places.map(lambda p: (p[0][0], p[0][1], p[1])), "doc_id long, digest string, key long"), "row-names")
    rows = digested.join(names, ["doc_id", "digest"], "left").select(F.col("key").alias("doc_id"), "text")
    return stored(rows, "named-texts"), names.select("key", "doc_id")


def with_names(out: DataFrame, names: DataFrame | None) -> DataFrame:
    """A result for rows of :func:`told_apart` under the ids that the rows came with."""
    if names is None:
        return out
    return out.withColumnRenamed("doc_id", "key").join(names, "key", "left").select(*out.columns)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/qaspark-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the
    lineage, and the files outlive any executor. The shuffles of that write are of no
    further use and are dropped at its end."""
    path = shared_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dropped(table: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` once all that was read from it
    has been written elsewhere."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, the first ones by a hash of ``key``. Rows are thinned by that
    hash before they are ordered, so about ``4 n`` rows are, whatever the table holds."""
    total = df.count()
    if total > 4 * n:
        df = df.filter(F.xxhash64(key) < F.lit(int(-2 ** 63 + 2 ** 64 * (4 * n / total))))
    return df.orderBy(F.xxhash64(key), key).limit(n)


# ---------------------------------------------------------------- byte and word hashing

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply and xor-shift rounds)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15 | 5          # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_POW_CHUNK = _powers(_BASE, SLICE_BYTES * 2 + 1)
_INV_CHUNK = _powers(_INVERSE, SLICE_BYTES * 2 + 1)


def code_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``n - 1`` of the base of prefix-sum hashes, and of its inverse."""
    if n <= len(_POW_CHUNK):
        return _POW_CHUNK[:n], _INV_CHUNK[:n]
    return _powers(_BASE, n), _powers(_INVERSE, n)


#: Letters, digits and every byte of a non-ASCII character: words without punctuation.
PLAIN_GAP = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def word_spans(data: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of one text: runs without ASCII white space,
    or without the bytes that ``gap`` marks."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~gap[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    if inside[-1]:
        edge = np.concatenate((edge, [len(data)]))
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word. The byte-level work goes in slices, so a very long
    text needs memory for its words only."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + SLICE_BYTES))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo > 2 * SLICE_BYTES:                      # ends in a word of megabytes
            j = max(i, j - 1)
            hi = int(ends[j - 1]) if j > i else lo
        if j == i:
            out[i] = _long_hash(data[starts[i]:ends[i]])
            i += 1
            continue
        s = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data[lo:hi]] * _POW_CHUNK[:hi - lo], out=s[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((s[b] - s[a]) * _INV_CHUNK[a] + (b - a).astype(np.uint64))
        i = j
    return out


def _long_hash(data: np.ndarray) -> np.uint64:
    """The same hash for one word longer than a slice, piece by piece."""
    total, scale = 0, 1
    step = pow(_BASE, SLICE_BYTES, 1 << 64)
    for k in range(0, len(data), SLICE_BYTES):
        piece = data[k:k + SLICE_BYTES]
        total += int(np.sum(_BYTE_CODE[piece] * _POW_CHUNK[:len(piece)], dtype=np.uint64)) * scale
        scale = scale * step % (1 << 64)
    return mix(np.array([(total + len(data)) % (1 << 64)], dtype=np.uint64))[0]


def rolling(codes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """64-bit hash of every run of ``k`` consecutive codes (uint64); empty if shorter."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = (int(mix(np.array([seed], np.uint64))[0]) | 1) & ((1 << 64) - 1)
    total = np.zeros(n, np.uint64)
    scale = _powers(base, k)
    if k <= 8:
        for t in range(k):
            total += codes[t:t + n] * scale[t]
        return mix(total)
    # doubling: the hash of 2m codes is that of m codes plus the next m, shifted
    have, size, done = codes, 1, 0
    rest = k
    while rest:
        if rest & 1:
            total += have[done:done + n] * np.uint64(pow(base, done, 1 << 64))
            done += size
        rest >>= 1
        if rest:
            have = have[:-size] + have[size:] * np.uint64(pow(base, size, 1 << 64))
            size *= 2
    return mix(total)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` values the index of its smallest (the last of equals)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(len(h), dtype=np.int64)
    value, size = h, 1
    while size < w:
        step = min(size, w - size)
        a, b = value[:-step], value[step:]
        right = b <= a
        best = np.where(right, best[step:], best[:-step])
        value = np.where(right, b, a)
        size += step
    return best


def struct_lists(col: pa.ListArray) -> Iterator[dict[str, np.ndarray]]:
    """For each row of a list-of-structs column its fields as arrays (null: empty ones)."""
    flat = col.flatten()
    fields = {flat.type.field(i).name: flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)}
    length = np.array([0 if n is None else n for n in pc.list_value_length(col).to_pylist()], np.int64)
    ends = np.cumsum(length)
    for a, b in zip((ends - length).tolist(), ends.tolist()):
        yield {k: v[a:b] for k, v in fields.items()}


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of a batch, without copying them (null: empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not (large or pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col, large = col.cast(pa.large_string()), True
    _, off, buf = col.buffers()
    off = np.frombuffer(off, dtype=np.int64 if large else np.int32)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.empty(0, np.uint8)
    for i in range(len(col)):
        yield raw[off[i]:off[i + 1]]
