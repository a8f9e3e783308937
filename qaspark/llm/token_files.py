"""Token ids of a corpus in entropy-coded files, and their reader.

Documents are dealt to parts by ascending id and encoded in that order. One pass over the
ids counts them; the counts give one table of slots for the whole corpus. Every part is
then coded in blocks that can be read by themselves (see :mod:`.ans`): the words of the
coder, its checkpoints, the documents of the block, and checksums of the words and the ids.

A folder of files holds three Parquet tables:

- ``model``: ``id, slots`` for every id that occurs;
- ``parts``: ``part, first, n_docs`` with the place of each part in the whole sequence;
- ``blocks/part=…``: the blocks of each part, each with its place in the part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ans import Coded, Model, decode, encode, quantised
from .common import dropped, prepared, shared_path, stored
from .tokens import vocabulary_path
from .word_tokens import word_encoder

END = 2                        # id that closes every document
PART_BYTES = 16 << 20          # text that one part takes
BLOCK_IDS = 1 << 20
ENCODED = "part int, ord long, doc_id long, start long, n_tokens long, ids binary"
BLOCK = ("start long, n_ids int, lanes int, words binary, places binary, states binary, words_crc32 long, ids_crc32 long, "
         "docs array<struct<ord: long, doc_id: long, start: long, n_tokens: long, at: long, length: long>>")
PIECE = "part int, ord long, doc_id long, start long, n_tokens long, crc long"


# ---------------------------------------------------------------- checksums of joined pieces

_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two bit-reflected polynomials modulo that of crc32."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def crc32_before(crc: int, n_bytes: int) -> int:
    """What ``crc`` adds to the checksum of a text when ``n_bytes`` bytes follow it: the
    checksum of joined pieces is the exclusive or of these."""
    power, square, n = 1 << 31, 1 << 30, 8 * n_bytes          # 1 and x
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(crc, power)


# ---------------------------------------------------------------- writing

def _encoded(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(vocabulary_path(vocabulary))
        kind = "<u2" if max(enc.last_id, end) < 1 << 16 else "<u4"
        part, number, at = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            ids = [np.append(enc.encode(t.as_py()), end).astype(kind) for t in b.column(1)]
            n = np.array([len(x) for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(number, number + len(ids))), b.column(0),
                 pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["part", "ord", "doc_id", "start", "n_tokens", "ids"])
            number, at = number + len(ids), at + int(n.sum())
    return run


def _ids(row: pa.Scalar, n: int) -> np.ndarray:
    """The ids of a stored row; their width follows from the number of bytes."""
    raw = row.as_buffer()
    return np.frombuffer(raw, "<u2" if raw.size == 2 * n else "<u4")


def encoded_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     vocabulary: str = "word_bpe_49k.json", end: int = END, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(part, ord, doc_id, start, n_tokens, ids)``: parts by ascending id (null ids first;
    rows with one id by a hash of the text), places within the part. Rows that repeat an
    id are told apart by their text and their place in the input, so that one id cannot
    fill a part."""
    rows = prepared(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // part_bytes), 2 * docs.sparkSession.sparkContext.defaultParallelism)
    order = ["doc_id", "tie", "place"]
    return (rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
            .repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
            .mapInArrow(_encoded(vocabulary, end), ENCODED))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        if b.num_rows:
            part = np.bincount(np.concatenate([_ids(x, n) for x, n in zip(b.column(1), b.column(0).to_pylist())]))
            if len(part) > len(total):
                part[:len(total)] += total
                total = part
            else:
                total[:len(part)] += part
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def _block(rows: list[tuple], ids: np.ndarray, model: Model, index: np.ndarray) -> tuple:
    """One block from pieces ``(part, start, ord, doc_id, doc_start, n_tokens, at, length)``."""
    coded = encode(index[ids], model)
    words = coded.words.astype("<u4").tobytes()
    docs = [dict(zip(("ord", "doc_id", "start", "n_tokens", "at", "length"), r[2:])) for r in rows]
    return (rows[0][1], len(ids), coded.lanes, words, coded.places.astype("<u4").tobytes(), coded.states.astype("<u8").tobytes(),
            zlib.crc32(words), zlib.crc32(ids.astype("<u4")), docs, rows[0][0])


def _write_blocks(ids: np.ndarray, slots: np.ndarray, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(slots)
        index = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
        index[ids] = np.arange(len(ids))
        schema = pa.schema([*_arrow_fields(), pa.field("part", pa.int32())])
        rows: list[tuple] = []
        held: list[np.ndarray] = []
        size, following = 0, None

        def closed() -> pa.RecordBatch:
            nonlocal rows, held, size
            row = _block(rows, np.concatenate(held), model, index)
            rows, held, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for b in batches:
            for part, number, doc, start, n, raw in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5)):
                own = _ids(raw, n)
                if size and (following != (part, start) or size + n > block_ids):
                    yield closed()
                following = (part, start + n)
                for at in range(0, n, block_ids):             # one turn unless the document fills blocks
                    piece = own[at:at + block_ids]
                    rows.append((part, start + at, number, doc, start, n, at, len(piece)))
                    held.append(piece)
                    size += len(piece)
                    if size >= block_ids:
                        yield closed()
        if size:
            yield closed()
    return run


def _arrow_fields() -> list[pa.Field]:
    doc = pa.struct([(k, pa.int64()) for k in ("ord", "doc_id", "start", "n_tokens", "at", "length")])
    kinds = {"start": pa.int64(), "n_ids": pa.int32(), "lanes": pa.int32(), "words": pa.binary(), "places": pa.binary(),
             "states": pa.binary(), "words_crc32": pa.int64(), "ids_crc32": pa.int64(), "docs": pa.list_(doc)}
    return [pa.field(k, t) for k, t in kinds.items()]


def write_token_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str = "word_bpe_49k.json", end: int = END, part_bytes: int = PART_BYTES,
                      block_ids: int = BLOCK_IDS) -> "TokenFiles":
    """Write the ids of all documents, each closed by ``end``, to a new folder (a fresh
    shared one by default) and open it. A null text has the end id only."""
    spark = docs.sparkSession
    path = (path or shared_path(spark, "token-files")).rstrip("/")
    rows = stored(encoded_in_order(docs, id_col, text_col, vocabulary, end, part_bytes), "token-ids")
    counts = (rows.select("n_tokens", "ids").mapInArrow(_counts, "id long, n long")
              .groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect())       # at most the vocabulary
    ids = np.array([r["id"] for r in counts], np.int64)
    slots = quantised(np.array([r["n"] for r in counts], np.float64))
    spark.createDataFrame(zip(ids.tolist(), slots.tolist()), "id long, slots long").coalesce(1).write.parquet(f"{path}/model")
    total = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("n_docs"))
    (total.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"), "n_docs")
     .write.parquet(f"{path}/parts"))
    (rows.mapInArrow(_write_blocks(ids, slots, block_ids), f"{BLOCK}, part int")
     .write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/blocks"))
    dropped(rows)
    return TokenFiles(spark, path)


# ---------------------------------------------------------------- reading

def _open(b: pa.RecordBatch, i: int) -> tuple[Coded, int]:
    """The coded block of a row; raises if its words are damaged."""
    row = {k: b.column(b.schema.get_field_index(k))[i].as_py() for k in ("n_ids", "lanes", "words", "places", "states", "words_crc32")}
    if zlib.crc32(row["words"]) != row["words_crc32"]:
        raise ValueError("damaged block: its words do not match their checksum")
    places = np.frombuffer(row["places"], "<u4")
    return Coded(row["lanes"], np.frombuffer(row["words"], "<u4"), places,
                 np.frombuffer(row["states"], "<u8").reshape(len(places), row["lanes"])), row["n_ids"]


def _whole_blocks(ids: np.ndarray, slots: np.ndarray):
    """Opens and decodes the blocks of a batch, all their ids checked."""
    model = Model(slots)

    def run(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[dict]]]:
        for i in range(b.num_rows):
            coded, n = _open(b, i)
            got = ids[decode(coded, n, model)].astype("<u4")
            if zlib.crc32(got) != b.column(b.schema.get_field_index("ids_crc32"))[i].as_py():
                raise ValueError("damaged block: its ids do not match their checksum")
            yield b.column(b.schema.get_field_index("part"))[i].as_py(), got, b.column(b.schema.get_field_index("docs"))[i].as_py()
    return run


def _pieces(ids: np.ndarray, slots: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _whole_blocks(ids, slots)
        for b in batches:
            for part, got, docs in blocks(b):
                ends = np.cumsum([d["length"] for d in docs]).tolist()
                parts = [got[e - d["length"]:e] for d, e in zip(docs, ends)]
                cols = [pa.array([part] * len(docs), pa.int32())]
                cols += [pa.array([d[k] for d in docs], pa.int64()) for k in ("ord", "doc_id", "start", "n_tokens")]
                names = ["part", "ord", "doc_id", "start", "n_tokens"]
                if with_ids:
                    cols += [pa.array([d["at"] for d in docs], pa.int64()), pa.array(parts, pa.list_(pa.int64()))]
                    names += ["at", "ids"]
                else:
                    after = [4 * (d["n_tokens"] - d["at"] - d["length"]) for d in docs]
                    crc = [crc32_before(zlib.crc32(p), n) if n else zlib.crc32(p) for p, n in zip(parts, after)]
                    cols, names = [*cols, pa.array(crc, pa.int64())], [*names, "crc"]
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


def _some_ids(ids: np.ndarray, slots: np.ndarray):
    """Ids ``lo .. hi`` of each block, from the nearest checkpoint on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(slots)
        for b in batches:
            for i in range(b.num_rows):
                coded, n = _open(b, i)
                at, lo, hi = (b.column(b.schema.get_field_index(k))[i].as_py() for k in ("place", "lo", "hi"))
                got = ids[decode(coded, n, model, lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array([at + lo]), pa.array([got], pa.list_(pa.int64()))], ["start", "ids"])
    return run


class TokenFiles:
    """Reader of a folder written by :func:`write_token_files`. Blocks are decoded in
    parallel, each by itself; a damaged one raises."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        model = spark.read.schema("id long, slots long").parquet(f"{self.path}/model").orderBy("id").collect()
        self.ids = np.array([r["id"] for r in model], np.int64)
        self.slots = np.array([r["slots"] for r in model], np.int64)

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(f"{BLOCK}, part int").parquet(f"{self.path}/blocks")

    def parts(self) -> DataFrame:
        return self.spark.read.schema("part int, first long, n_docs long").parquet(f"{self.path}/parts")

    def documents(self) -> DataFrame:
        """One row per document: ``doc_id, start, n_tokens, ids_crc32``."""
        if not len(self.ids):
            return self.spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
        pieces = self.blocks().mapInArrow(_pieces(self.ids, self.slots, False), PIECE)
        # a document of several blocks has several rows; their checksums combine
        whole = pieces.groupBy("part", "ord", "doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"))
        return (whole.join(self.parts().select("part", "first"), "part")
                .select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"))

    def tokens(self) -> DataFrame:
        """The ids themselves: ``doc_id, start, at, ids``, a row per document and block
        that holds some of it; ``at`` counts the document's ids before the row."""
        if not len(self.ids):
            return self.spark.createDataFrame([], "doc_id long, start long, at long, ids array<long>")
        schema = "part int, ord long, doc_id long, start long, n_tokens long, at long, ids array<long>"
        return (self.blocks().mapInArrow(_pieces(self.ids, self.slots, True), schema)
                .join(self.parts().select("part", "first"), "part")
                .select("doc_id", (F.col("first") + F.col("start")).alias("start"), "at", "ids"))

    def read(self, start: int, n: int) -> DataFrame:
        """Ids ``start .. start + n`` of the whole sequence as rows ``(start, ids)``; only
        the blocks that hold some are opened, at the checkpoint before the first one."""
        if not len(self.ids):
            return self.spark.createDataFrame([], "start long, ids array<long>")
        place = F.col("first") + F.col("start")
        return (self.blocks().join(self.parts().select("part", "first"), "part")
                .withColumn("place", place).filter((F.col("place") < start + n) & (F.col("place") + F.col("n_ids") > start))
                .withColumn("lo", F.greatest(F.lit(0), F.lit(start) - F.col("place")).cast("int"))
                .withColumn("hi", F.least(F.col("n_ids"), F.lit(start + n) - F.col("place")).cast("int"))
                .select("n_ids", "lanes", "words", "places", "states", "words_crc32", "place", "lo", "hi")
                .mapInArrow(_some_ids(self.ids, self.slots), "start long, ids array<long>"))


def token_file_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents and read them back: ``doc_id, start, n_tokens, ids_crc32`` per
    row of the input, from the files alone.

    Documents stand in ascending order of their ids, null ids first, rows with one id in
    the order of a hash of their texts; repeated rows are written each. A null or empty
    text has the end id only; a text of any length is cut over blocks. An empty table
    gives no rows. Other columns are not read, whatever their names.
    """
    return write_token_files(docs, id_col=id_col, text_col=text_col).documents()
