"""Near-duplicate documents by SuperMinHash.

A document is the set of its distinct word shingles. SuperMinHash (Ertl, 2017) ranks
each element by a random permutation of the signature's places, so that its values for
one element are correlated and the signature has less variance than with independent
hashes; an element stops as soon as its next rank cannot lower any place. Bands of the
signature bring candidates together, each candidate pair is verified on the full sets,
and components of the verified links are the groups.

Documents with equal sets are one class from the start. A bucket never lists its pairs:
its members are first compared with its smallest member only; once the components of
those links are known, only members of *different* components that share a bucket are
compared, so no link that could join two components is left out. A small bucket does so
pair by pair; a large one is cut into tiles of bounded size, and each pair of tiles
counts its common shingles by a matrix product and reports one link for each pair of
components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, prepared, rolling, stored, texts_of, told_apart, with_names, word_hashes, word_spans
from .components import connected_components

PERCENT = 80                   # least Jaccard similarity of a link, in percent
ROWS, BANDS = 6, 40            # a link at 80 % is missed by all bands with probability 0.738 ** 40 < 6e-6
PLACES = ROWS * BANDS          # at most 256, places are bytes
SMALL_BUCKET = 32              # members up to which the pairs of a bucket are compared one by one
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 18   # about as much of a larger bucket is one tile
COLUMNS = 4096                 # shingles whose product is taken at once
GROUP = 60_000                 # shingles whose signatures are made side by side
SIGNATURES = "doc_id long, n_shingles long, digest binary, bands array<long>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words, A-Z lower-cased; a
    shorter text is one shingle, a text without words has none."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    h = word_hashes(_LOWER[data], starts, ends)
    k = min(size, len(h))
    return np.unique(rolling(h, k, k))


def super_minhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures (one row each) of non-empty sets of 64-bit elements, all at once."""
    n = len(sets)
    sig = np.full(n * places, np.inf)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    perm = None
    for j in range(places):
        r = mix(element + np.uint64((2 * j + 1) * int(_GOLDEN) % (1 << 64)))
        k = j + ((mix(r ^ _GOLDEN) >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        value = j + (r >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        if perm is None:
            place = k
        else:
            rows = np.arange(len(element))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(sig, owner * places + place, value)
        # a document goes on while some place could still fall to rank j + 1
        open_ = (sig.reshape(n, places).max(axis=1) >= j + 1)[owner]
        if not open_.any():
            break
        if perm is None:
            element, owner, k = element[open_], owner[open_], k[open_]
            perm = np.tile(np.arange(places, dtype=np.uint8), (len(element), 1))
            rows = np.arange(len(element))
            perm[rows, k] = 0
            perm[:, 0] = k
        elif not open_.all():
            element, owner, perm = element[open_], owner[open_], perm[open_]
    return sig.reshape(n, places)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of each signature; bands never share a hash space."""
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN + np.zeros((len(sig), 1), np.uint64)
    for r in range(ROWS):
        h = mix(h ^ bits[:, :, r])
    return h.view(np.int64)


def _signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            digest: list = [None] * len(sets)
            if full:
                for i, row in zip(full, band_hashes(super_minhash([sets[i] for i in full]))):
                    bands[i] = row
                    s = sets[i]
                    digest[i] = b"".join(int(np.sum(mix(s ^ np.uint64(x)), dtype=np.uint64)).to_bytes(8, "little")
                                         for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F)) + len(s).to_bytes(4, "little")
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])
        for b in batches:
            ids, sets, held = [], [], 0
            for doc, data in zip(b.column(0).to_pylist(), texts_of(b)):
                s = shingles(data, size)
                if held and held + len(s) > GROUP:
                    yield flush(ids, sets)
                    ids, sets, held = [], [], 0
                ids.append(doc)
                sets.append(s)
                held += len(s)
            yield flush(ids, sets)
    return sign


def _set_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array([shingles(t, size).tobytes() for t in texts_of(s)], pa.binary())], ["doc_id", "elements"])
    return rows


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield b.select(["u", "v"]).take(pa.array(keep, pa.int64()))
    return verify


def _tile_links(percent: int):
    """Links between members of different components in a pair of tiles, one for each pair
    of components."""
    def links(table: pa.Table) -> pa.Table:
        rep, comp = table.column("rep").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("elements")]
        n = np.array([len(s) for s in sets], np.float64)
        u = v = np.empty(0, np.int64)
        if len(np.unique(comp)) > 1:
            _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(sets)), n.astype(np.int64))
            common = times[code] > 1
            owner, code = owner[common], (np.cumsum(times > 1) - 1)[code[common]]
            order = np.argsort(code, kind="stable")
            owner, code = owner[order], code[order]
            both = np.zeros((len(sets), len(sets)), np.float32)
            for a in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
                lo, hi = np.searchsorted(code, [a, a + COLUMNS])
                x = np.zeros((len(sets), COLUMNS), np.float32)
                x[owner[lo:hi], code[lo:hi] - a] = 1.0
                both += x @ x.T
            linked = (100.0 * both >= percent * (n[:, None] + n[None, :] - both)) & (comp[:, None] < comp[None, :])
            u, v = np.nonzero(linked)
            _, first = np.unique(np.stack([comp[u], comp[v]]), axis=1, return_index=True)
            u, v = rep[u[first]], rep[v[first]]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = 5, percent: int = PERCENT, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of
    ``size``-word shingles; the component is the smallest id reachable, and the document
    with that id is kept. Texts without words (null, empty) are linked with nothing and
    kept; a row without id is linked with nothing, kept, and has no component; repeated
    rows count as one document and get the same answer; different texts under one id are
    different documents, the one with the smaller digest counting as the smaller id, so
    that a component still keeps one of them; an empty table gives no rows.
    """
    texts, names = told_apart(prepared(docs, id_col, text_col))
    signed = stored(texts.mapInArrow(_signer(size), SIGNATURES), "signatures")
    classes = (signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
               .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")))
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    postings = reps.select(F.explode("bands").alias("band"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    first = (postings.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last"))
             .filter("first < last").select("band", "first"))
    shared = stored(postings.join(first, "band"), "buckets")               # buckets with two members at least

    def like_sizes(a: str, b: str) -> Column:
        return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))
    sizes = classes.select(F.col("rep").alias("first"), F.col("n").alias("first_n"))
    stars = (shared.filter("rep > first").select(F.col("first"), F.col("rep"), "n").distinct().join(sizes, "first")
             .filter(like_sizes("n", "first_n")).select(F.col("first").alias("u"), F.col("rep").alias("v")))
    members = shared.select(F.col("rep").alias("doc_id")).distinct()
    elements = stored(texts.join(members.hint("shuffle_hash"), "doc_id", "left_semi")
                      .mapInArrow(_set_rows(size), "doc_id long, elements binary"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        x = elements.select(F.col("doc_id").alias("u"), F.col("elements").alias("x"))
        y = elements.select(F.col("doc_id").alias("v"), F.col("elements").alias("y"))
        pairs = stored(pairs, "pairs")          # both joins shuffle both sides: a hot member can be split
        return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_verifier(percent), "u long, v long")

    links = stored(verified(stars), "links")
    groups = stored(connected_components(links), "groups")
    # members of one bucket that are still in different components
    labelled = (shared.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
                .select("band", "rep", "n", "first", F.coalesce("component", "rep").alias("component")))
    mixed = (labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                          F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
             .filter("lo < hi").select("band", "members", "shingles"))
    rest = stored(labelled.filter("rep <> first").join(mixed, "band"), "mixed")
    # large buckets, tile against tile
    tiles = F.greatest(F.ceil(F.col("members") / TILE_ROWS), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    dealt = (rest.filter(F.col("members") > small_bucket).withColumn("tiles", tiles)
             .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "component"))
    from_tiles = (dealt.join(elements.withColumnRenamed("doc_id", "rep"), "rep").groupBy("band", "i", "j")
                  .applyInArrow(_tile_links(percent), "u long, v long"))
    # small buckets, pair by pair
    rest = rest.filter(F.col("members") <= small_bucket)
    a = rest.select("band", F.col("rep").alias("u"), F.col("n").alias("un"), F.col("component").alias("uc"))
    b = rest.select("band", F.col("rep").alias("v"), F.col("n").alias("vn"), F.col("component").alias("vc"))
    others = (a.join(b, "band").filter((F.col("uc") < F.col("vc")) & like_sizes("un", "vn"))
              .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    more = stored(verified(others).unionByName(from_tiles), "links")
    # the components so far, as stars, plus the links between them
    final = groups if more.isEmpty() else connected_components(
        groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more.select("u", "v")))
    label = (classes.join(final.withColumnRenamed("node", "rep"), "rep", "left")
             .select("digest", F.coalesce("component", "rep").alias("component")))
    out = signed.select("doc_id", "n_shingles", "digest").join(label, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"),
                     F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    if names is not None:
        heads = names.select(F.col("key").alias("component_id"), F.col("doc_id").alias("head"))
        out = out.join(heads, "component_id", "left").select("doc_id", "n_shingles", F.col("head").alias("component_id"), "kept")
    return with_names(out, names)
