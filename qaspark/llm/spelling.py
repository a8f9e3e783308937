"""Spelling variants: words that differ by one code point, and the usual form of each.

Words are counted by Spark after a count within every task. Single edits are found by
dense tiles: the words of a block stand in a padded matrix of code points, once aligned to
the left and once to the right, and two rows are near if their common prefix and suffix
together reach the longer length less one. Blocks hold all pairs that can be near: of the
three thirds of a word one holds the edit, and the text before and after that third is
equal, so words meet in the block of (length, third, text before, text after). A block with
too many words is replaced by two with halves of its open third, and so on until one
position is left, which bounds every block by the alphabet and not by the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, prepared, stored

MIN_LENGTH, MIN_COUNT = 7, 2
USUAL = 10                     # a form occurs at least so many times as often
DELETE_EVERY = 31
HELD_WORDS = 300_000           # distinct words a task counts before it passes them on
BLOCK_WORDS = 2048             # larger blocks are split while they can be
SMALL = 24                     # blocks up to this size are compared by diagonals
TILE = 128
CELLS = 1 << 24                # code points of the words in memory at a time
KEYS = "base int, lo int, hi int, word string, n long, key long"
LINKS = "word string, near string, near_n long"


# ---------------------------------------------------------------- words

def _counter(min_length: int, every: int):
    plain = re.compile("[a-z]{%d,}" % min_length)
    wide = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for b in batches:
            for doc, value in zip(b.column(0).to_pylist(), b.column(1)):
                text = value.as_py()
                # bytes.lower() folds A-Z only
                runs = plain.findall(text.lower()) if text.isascii() else wide.findall(text.encode().lower().decode())
                base = zlib.crc32(b"%d:" % doc if doc is not None else b":")
                for run, n in Counter(runs).items():
                    h = zlib.crc32(run.encode(), base)
                    if h % every == 0:
                        i = h % len(run)
                        run = run[:i] + run[i + 1:]
                        if len(run) < min_length:
                            continue
                    total[run] += n
                if len(total) > HELD_WORDS:
                    yield out()
        yield out()
    return count


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, every: int = DELETE_EVERY) -> DataFrame:
    """``(word, n)``: the letter runs of all texts, A-Z lower-cased; a run whose checksum
    with its document's id divides by ``every`` loses one code point. A null id counts as
    the empty string in that checksum."""
    return (prepared(docs, id_col, text_col).mapInArrow(_counter(min_length, every), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


# ---------------------------------------------------------------- blocks

def _keyed(rows: DataFrame) -> DataFrame:
    """With the block key: the text before the open part and the text after it."""
    before = F.expr("substring(word, 1, lo)")
    after = F.expr("substring(word, char_length(word) - (base - hi) + 1, base - hi)")
    return rows.select("base", "lo", "hi", "word", "n", F.xxhash64("base", "lo", "hi", before, after).alias("key"))


def _thirds(base: Column) -> Column:
    def cut(j: int) -> Column:
        return F.floor(base * j / 3).cast("int")
    return F.array(*[F.struct(base.alias("base"), cut(j).alias("lo"), cut(j + 1).alias("hi")) for j in range(3)])


def first_blocks(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Every word in the blocks of its own length and, as the longer word of a pair, in
    those of one less."""
    size = F.char_length("word")
    longer = F.when(size > min_length, _thirds(size - 1)).otherwise(F.array().cast("array<struct<base:int,lo:int,hi:int>>"))
    return _keyed(words.select("word", "n", F.explode(F.concat(_thirds(size), longer)).alias("p")).select("p.*", "word", "n"))


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    return _keyed(rows.select("base", "word", "n", F.explode(halves).alias("p")).select("base", "p.*", "word", "n"))


def blocks(words: DataFrame, min_length: int = MIN_LENGTH, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """All blocks as rows ``(base, lo, hi, word, n, key)``, none above ``block_words`` that
    could be split; and the stored tables they read."""
    level, out, tables = first_blocks(words, min_length), None, []
    while True:
        hot = stored(level.filter("hi - lo > 1").groupBy("key").count().filter(F.col("count") > block_words).select("key"), "hot-blocks")
        tables.append(hot)
        if hot.isEmpty():
            return (level if out is None else out.unionByName(level)), tables
        open_part = F.col("hi") - F.col("lo") > 1
        marked = level.join(hot.withColumn("hot", F.lit(True)), "key", "left").withColumn("hot", F.col("hot").isNotNull() & open_part)
        cool = marked.filter("NOT hot").select("base", "lo", "hi", "word", "n", "key")
        out = cool if out is None else out.unionByName(cool)
        level = stored(_halved(marked.filter("hot")), "half-blocks")
        tables.append(level)


# ---------------------------------------------------------------- tiles

class _Matrix:
    """Words of length ``base`` or one more, as code points aligned to either side."""

    def __init__(self, words: np.ndarray, base: int, lo: np.ndarray, hi: np.ndarray):
        n, width = len(words), base + 1
        points = np.ascontiguousarray(words.astype(f"U{width}")).view(np.uint32).reshape(n, width)
        self.left = points.astype(np.uint16) if points.max(initial=0) < 1 << 16 else points
        self.short = self.left[:, -1] == 0
        self.right = np.where(self.short[:, None], np.roll(self.left, 1, axis=1), self.left)[:, ::-1]
        self.base, self.lo, self.hi = base, lo, hi

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of rows are one edit apart; index arrays of equal or broadcast
        shapes. A pair that several blocks hold is reported by the first of them only."""
        prefix = (self.left[i] == self.left[j]).argmin(axis=-1)            # different words differ somewhere
        suffix = (self.right[i] == self.right[j]).argmin(axis=-1)
        longer = self.base + ~(self.short[i] & self.short[j])
        lo, before = self.lo[i], self.base - suffix
        return ((prefix + suffix >= longer - 1) & (self.short[i] | self.short[j])
                & (prefix >= lo) & (before <= self.hi[i]) & ((lo == 0) | (before > lo)))


def _pairs(m: _Matrix, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of rows; ``first`` and ``last`` bound the block of each row."""
    rows = np.arange(len(first))
    small = last - first <= SMALL
    for d in range(1, int((last - first)[small].max(initial=1))):
        i = rows[small & (rows + d < last)]
        hit = m.near(i, i + d)
        yield i[hit], i[hit] + d
    for a, b in sorted({(int(x), int(y)) for x, y in zip(first[~small], last[~small])}):
        for p in range(a, b, TILE):
            for q in range(p, b, TILE):
                i, j = rows[p:min(p + TILE, b)][:, None], rows[q:min(q + TILE, b)][None, :]
                hit = m.near(i, j) & (i < j)
                u, v = np.nonzero(hit)
                yield u + p, v + q


def _chunks(base: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of one length each that end with a block and hold about ``CELLS``."""
    a = 0
    while a < len(base):
        b = int(np.searchsorted(base, base[a], side="right"))
        most = a + max(1, CELLS // (int(base[a]) + 1))
        if most < b:
            b = int(first[most]) if first[most] > a else int(np.searchsorted(first, first[a], side="right"))
        yield a, b
        a = b


def _compare(t: pa.Table) -> pa.RecordBatch:
    base, lo, hi, key, n = (t.column(c).to_numpy() for c in ("base", "lo", "hi", "key", "n"))
    words = np.array(t.column("word").to_pylist(), dtype=object)
    edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (base[1:] != base[:-1]))))
    sizes = np.diff(np.append(edge, len(key)))
    first, last = np.repeat(edge, sizes), np.repeat(edge + sizes, sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in _chunks(base, first):
        many = np.flatnonzero(last[a:b] - first[a:b] > 1) + a               # words alone in their block go no further
        if len(many):
            new = np.cumsum(np.bincount(many - a, minlength=b - a)) - 1     # row -> place among the kept ones
            m = _Matrix(words[many], int(base[a]), lo[many], hi[many])
            for i, j in _pairs(m, new[first[many] - a], new[last[many] - 1 - a] + 1):
                if len(i):
                    found.append((many[i], many[j]))
    i = np.concatenate([np.concatenate(p) for p in found]) if found else np.empty(0, np.int64)
    j = np.concatenate([np.concatenate(p[::-1]) for p in found]) if found else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(words[i], pa.string()), pa.array(words[j], pa.string()), pa.array(n[j], pa.int64())],
                                      ["word", "near", "near_n"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares whole blocks of rows sorted by (base, lo, hi, key)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("base", "lo", "hi", "key")]
        same = np.logical_and.reduce([c == c[-1] for c in columns])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last block may go on in the next batch
        if held and [held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() for c in ("base", "lo", "hi", "key")] != [c[0] for c in columns]:
            yield _compare(pa.Table.from_batches(held))
            held = []
        if cut:
            yield _compare(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = []
        held.append(b.slice(cut))
    if held:
        yield _compare(pa.Table.from_batches(held))


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """``(word, near, near_n)``: every ordered pair of words one edit apart, once; and the
    stored tables it reads. ``words`` holds distinct words with their counts ``n``."""
    rows, tables = blocks(words, min_length, block_words)
    return (rows.repartition("key").sortWithinPartitions("base", "lo", "hi", "key").mapInArrow(_tiles, LINKS)), tables


# ---------------------------------------------------------------- forms

def _roots(forms: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(word, root)`` from ``(word, form)``: the paths double in length each round. A
    form occurs ten times as often as its word, so no path is longer than the number of
    digits of the largest count."""
    tables = [stored(forms.select("word", F.col("form").alias("root")), "forms")]
    while True:
        now = tables[-1]
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                       "roots")
        tables.append(moved)
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root"), tables


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, usual: int = USUAL, every: int = DELETE_EVERY) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    A word's form is the most frequent word one edit away (of equally frequent ones the
    first in code-point order) if that occurs at least ``usual`` times as often; its root
    is the end of the path of forms. Null and empty texts have no words, repeated rows
    count each, a null id counts as the empty string in the checksum that chooses
    deletions, words and texts of any length are compared whole; without words there are
    no rows. Other columns are not read, whatever their names.
    """
    words = stored(word_counts(docs, id_col, text_col, min_length, min_count, every), "words")
    links, read = near_words(words, min_length)
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = stored(best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")), "near-words")
    for t in read:
        dropped(t)
    is_form = F.col("near_n") >= usual * F.col("n")
    rows = stored(words.join(near, "word", "left")
                  .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                          F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "word-forms")
    for t in (near, words):
        dropped(t)
    roots, _ = _roots(rows.filter("form IS NOT NULL"))
    return (rows.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
