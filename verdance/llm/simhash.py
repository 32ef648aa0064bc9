"""SimHash near-duplicates by tiled exact comparison.

Every document gets a 64-bit fingerprint.  Distinct fingerprints are dealt into
buckets that share the bits of a pigeonhole band: two fingerprints that differ
in at most ``radius`` bits agree exactly on at least ``k`` of ``radius + k``
bands, so comparing inside buckets loses no link.  A bucket is a grid of tiles
sorted by population count; numpy exclusive-or and bit counts compare tile
pairs, and a pair is skipped when its population counts differ beyond the
radius.  Buckets of any size are split into tiles dealt to different tasks.

Defined results: a null or blank text has fingerprint zero and links like any
other; repeated rows are returned once each; null ids stay null and never name
a component unless no other id is in it; an empty table gives an empty result;
only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hot_join, link_labels, map_arrow, utf8
from .components import roots

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Rows of a bucket's tile; a task compares two tiles at most.
TILE_ROWS = 16384
#: A fingerprint of more than one in HOT_SHARE of all rows is joined by broadcast: HOT_SHARE of them at most.
HOT_SHARE = 1000
#: Rows compared by one numpy operation (squared).
BLOCK_ROWS = 1024

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer."""
    found = utf8(text).lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)
    seen = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
    ones = (seen.reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > hashes.size, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text_col: str, keep: list[str], words: int, seed: int) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""
    source = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(fps)], [*keep, "fp"])

    schema = T.StructType([*source.schema.fields[: len(keep)], T.StructField("fp", T.LongType(), False)])
    return map_arrow(source, run, schema)


def band_masks(count: int, radius: int, bucket_rows: int) -> list[int]:
    """Masks such that any two words within ``radius`` bits agree under one of them.

    ``radius + k`` bands, ``k`` of which are kept together: the least k whose
    buckets would hold ``bucket_rows`` evenly spread fingerprints or fewer.
    """
    for k in range(1, 5):
        bands = radius + k
        if count / 2 ** (64 * k // bands) <= bucket_rows:
            break
    edges = [64 * i // bands for i in range(bands + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(bands)]
    return [sum(chosen) for chosen in combinations(parts, k)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _near(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, radius: int, same: bool, block: int):
    """Index pairs of two tiles, each sorted by population count, that differ in at most ``radius`` bits."""
    for i in range(0, a.size, block):
        ai, low, high = a[i : i + block], pa_[i], pa_[min(i + block, a.size) - 1]
        for j in range(i if same else 0, b.size, block):
            if pb[j] - high > radius:
                break
            if low - pb[min(j + block, b.size) - 1] > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(ai[:, None] ^ b[None, j : j + block]) <= radius)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if x.size:
                yield x + i, y + j


def _compare(fps: np.ndarray, pops: np.ndarray, tile: np.ndarray, same: bool, radius: int, block: int):
    """A spanning set of the links in one tile pair: ``(fp, least linked fp)``."""
    labels = np.arange(fps.size)
    if same:
        for x, y in _near(fps, pops, fps, pops, radius, True, block):
            link_labels(labels, x, y)
    else:
        one, two = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile != tile.min())
        for x, y in _near(fps[one], pops[one], fps[two], pops[two], radius, False, block):
            link_labels(labels, one[x], two[y])
    linked = np.flatnonzero(labels != np.arange(fps.size))
    return fps[linked], fps[labels[linked]]


def deal_tiles(rows: DataFrame, by: str, radius: int, tile_rows: int) -> DataFrame:
    """Rows with ``a, b, t``: each in every tile pair of its bucket that may hold a link of it, ``t`` being its own tile.

    ``rows`` has ``band, key`` (the bucket), ``pop`` and ``by``, which deals a population count's rows to its tiles.
    """
    # A histogram over population counts has few entries, whatever the bucket holds.
    tiles = (
        rows.groupBy("band", "key", "pop").count()
        .groupBy("band", "key").agg(F.sum("count").alias("n"), F.array_sort(F.collect_list(F.struct("pop", "count"))).alias("h"))
        .where(F.col("n") > tile_rows)
        .withColumn("h", F.transform("h", lambda x: F.struct(x["pop"].alias("pop"), F.ceil(x["count"] / tile_rows).cast("int").alias("nt"))))
    )
    before = lambda p: F.aggregate(F.filter("h", lambda y: y["pop"] < p), F.lit(0), lambda s, y: s + y["nt"])
    tiles = tiles.select(
        "band", "key",
        F.explode(F.transform("h", lambda x: F.struct(
            x["pop"].alias("pop"), x["nt"].alias("nt"), before(x["pop"]).alias("first"),
            before(x["pop"] - radius).alias("lo"), (before(x["pop"] + radius + 1) - 1).alias("hi"),
        ))).alias("x"),
    ).select("band", "key", "x.*")
    tiles = cut(tiles, "simhash-tiles")
    if tiles.isEmpty():
        return rows.select("*", *(F.lit(0).alias(n) for n in ("a", "b", "t")))
    joined = rows.join(tiles, ["band", "key", "pop"], "left").withColumn(
        "t", F.coalesce(F.col("first") + F.pmod(F.xxhash64(by), F.col("nt")), F.lit(0)).cast("int")
    )
    spread = joined.withColumn("o", F.explode(F.sequence(F.coalesce("lo", F.lit(0)), F.coalesce("hi", F.lit(0)))))
    return spread.select(*rows.columns, F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "t")


def _dealt(nodes: DataFrame, masks: list[int], radius: int, tile_rows: int) -> DataFrame:
    """``(band, key, a, b, t, pop, fp)``: each fingerprint in the tile pairs of all its buckets."""
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = nodes.select("fp", F.bit_count("fp").cast("int").alias("pop"), F.explode(bands).alias("x")).select("x.band", "x.key", "pop", "fp")
    return deal_tiles(rows, "fp", radius, tile_rows)


def near_links(nodes: DataFrame, count: int, radius: int = RADIUS, tile_rows: int = TILE_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp`` that connect all within ``radius`` bits."""
    dealt = _dealt(nodes, band_masks(count, radius, 4 * tile_rows), radius, tile_rows)
    keys = ["band", "key", "a", "b"]
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, "pop", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = [*keys, "t", "pop", "fp"]

        def flush(rows: list[np.ndarray]) -> pa.RecordBatch | None:
            band, key, a, b, t, pop, fp = rows
            new = (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.concatenate(([0], np.flatnonzero(new) + 1, [fp.size])).tolist()
            us, vs = [], []
            for i, j in zip(at[:-1], at[1:]):
                if j - i > 1:
                    u, v = _compare(fp[i:j].view(np.uint64), pop[i:j], t[i:j], a[i] == b[i], radius, block)
                    if u.size:
                        us.append(u)
                        vs.append(v)
            if not us:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = [np.array(batch.column(batch.schema.get_field_index(n)), np.int64) for n in names]
            rows = [np.concatenate((h, p)) for h, p in zip(held, part)] if held else part
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]) | (rows[3] != rows[3][-1]))
            split = int(last[-1]) + 1 if last.size else 0
            if split and (out := flush([r[:split] for r in rows])):
                yield out
            held = [r[split:] for r in rows]
        if held and (out := flush(held)):
            yield out

    return map_arrow(ordered, run, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
    words: int = SHINGLE_WORDS, seed: int = SEED, radius: int = RADIUS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """One row per input row: ``id_col``, ``keep``, ``fingerprint`` (16 hex digits) and ``component_id``."""
    ids = [id_col, *(c for c in keep if c != id_col)]
    fps = cut(with_fingerprints(docs, text_col, ids, words, seed), "simhash-fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min(id_col).alias("__least"), F.count("*").alias("__n")), "simhash-nodes")
    distinct, rows = nodes.agg(F.count("*"), F.coalesce(F.sum("__n"), F.lit(0))).first()
    links = near_links(nodes.select("fp"), distinct, radius, tile_rows)
    label = roots(links, "simhash-links").withColumnRenamed("node", "fp")
    linked = nodes.join(label, "fp")
    least = linked.groupBy("root").agg(F.min("__least").alias("__comp"))
    named = nodes.join(linked.select("fp", "root").join(least, "root").select("fp", "__comp"), "fp", "left")
    named = named.select("fp", F.coalesce("__comp", "__least").alias("component_id"), "__n")
    # Fingerprints that hold a thousandth of all rows, a thousand at most, are broadcast; no task gets all rows of one.
    out = hot_join(fps, named, "fp", F.col("__n") * HOT_SHARE > rows)
    return out.select(*ids, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
