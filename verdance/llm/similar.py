"""SimHash near-duplicates at a given similarity of word shingles, verified on the texts.

For links as loose as a similarity of 0.8 a 64-bit fingerprint is too narrow and
its radius too wide for pigeonhole bands, so this variant uses ``BITS`` bits over
distinct five-word shingles, and deals fingerprints into buckets by banded minima
of the same shingle hashes (a pair of similarity 0.8 shares a bucket with
probability 0.9998 and lies within the radius with 0.998).  Majority bits of very
few shingles differ more often, so texts of fewer than ``FEW`` shingles share
buckets of their own with those of about their size, where no radius applies and
the similarity alone decides.  Inside a bucket the comparison is the tiled exact one:
exclusive-or and bit counts over tile pairs sorted by population count, skipping
pairs whose population counts differ beyond the radius, and here also those whose
shingle counts exclude the similarity.  Of the links in a tile pair a spanning
tree of least distances is kept, so a group of copies gives as many links as
members; each link's similarity is then computed from both texts.  A tree whose
links all hold connects its members.  Where one is rejected, it may have displaced
a link that holds, so the tree's members are compared again: every pair within the
radius that verified links don't connect yet, on both shingle sets.  The groups are
thus the components of all pairs that share a bucket, lie within the radius and have
the similarity (with no radius among texts of few shingles), whatever the tile sizes.

Defined results: null and blank texts have no shingles and are copies of each
other; a text of fewer words than a shingle is one shingle; repeated rows are
members each; null ids name no group unless it has no other; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hot_join, map_arrow, utf8
from .components import roots
from .simhash import HOT_SHARE, SEED, deal_tiles

WORDS = 5
SIMILARITY = 0.8
BITS = 256
#: Standard deviations that the radius lies beyond the expected distance at the similarity.
MARGIN = 3.0
BANDS, BAND_ROWS = 12, 3
#: Shingles from which the radius holds.
FEW = 32
TILE_ROWS = 8192
BLOCK_ROWS = 512
#: Members of a tree with a rejected link that are compared at once with as many others, on their shingle sets.
OPEN_ROWS = 512

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_MIX = np.random.default_rng(20240229).integers(1, 2**63, 64 + BITS // 64, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, A-Z lower-cased."""
    found = utf8(text).lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64))


def _mixed(h: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * by
    return x ^ (x >> np.uint64(29))


def signature(h: np.ndarray) -> tuple[bytes, list[int]]:
    """The fingerprint of distinct shingle hashes and their bucket keys."""
    if not h.size:
        return bytes(BITS // 8), [0] * BANDS
    words = np.column_stack([_mixed(h, m) for m in _MIX[: BITS // 64]])
    raw = words.astype("<u8").view(np.uint8).reshape(len(h), -1)
    seen = np.bincount((raw + (np.arange(raw.shape[1]) * 256)).ravel(), minlength=256 * raw.shape[1])
    ones = (seen.reshape(-1, 256) @ _BITS).ravel()
    fp = np.packbits(2 * ones > len(h), bitorder="little").tobytes()
    least = np.array([_mixed(h, m).min() for m in _MIX[BITS // 64 : BITS // 64 + BANDS * BAND_ROWS]], np.uint64)
    keys = least.reshape(BANDS, BAND_ROWS)
    with np.errstate(over="ignore"):
        mixed = (keys * _MIX[:BAND_ROWS]).sum(1)
    return fp, mixed.view(np.int64).tolist()


def radius_of(similarity: float, margin: float = MARGIN, bits: int = BITS) -> int:
    """Distance that equal-sized sets of a similarity stay within, but for ``margin`` deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + margin * math.sqrt(bits * p * (1 - p)))


def near_enough(distance: np.ndarray, larger: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Pairs within the radius, and all whose larger set is so small that the other one may be of few shingles."""
    return (distance <= radius) | (larger * similarity < FEW)


def spanning_links(fps: np.ndarray, pops: np.ndarray, sizes: np.ndarray, sides: np.ndarray | None, radius: int, similarity: float, block: int = BLOCK_ROWS) -> list[tuple[int, int]]:
    """Index pairs that span the links of a tile pair, near ones first.

    ``fps`` has one row of 64-bit words each, sorted by ``pops`` within a side;
    ``sides`` tells two tiles apart, None compares one tile with itself.
    """
    n = len(fps)
    labels = np.arange(n)
    out: list[tuple[int, int]] = []
    one, two = (np.arange(n),) * 2 if sides is None else (np.flatnonzero(sides == sides.min()), np.flatnonzero(sides != sides.min()))
    many = len(one) > block or len(two) > block
    for limit in ([radius // 4, radius // 2, 3 * radius // 4, radius] if many else [radius]):
        for i in range(0, len(one), block):
            a = one[i : i + block]
            for j in range(i if sides is None else 0, len(two), block):
                b = two[j : j + block]
                if pops[b[0]] - pops[a[-1]] > limit:
                    break
                if pops[a[0]] - pops[b[-1]] > limit:
                    continue
                far = np.zeros((len(a), len(b)), np.uint16)
                for w in range(fps.shape[1]):
                    far += np.bitwise_count(fps[a, w][:, None] ^ fps[b, w][None])
                ok = far <= limit
                ok &= np.minimum(sizes[a][:, None], sizes[b][None]) >= similarity * np.maximum(sizes[a][:, None], sizes[b][None])
                ok &= labels[a][:, None] != labels[b][None]
                x, y = np.nonzero(ok)
                if not x.size:
                    continue
                order = np.argsort(far[x, y], kind="stable")
                u, v = a[x[order]], b[y[order]]
                # The nearest pair of each two classes is enough to decide which to join.
                first = np.sort(np.unique(np.minimum(labels[u], labels[v]) * n + np.maximum(labels[u], labels[v]), return_index=True)[1])
                for p, q in zip(u[first].tolist(), v[first].tolist()):
                    s, t = labels[p], labels[q]
                    if s != t:
                        labels[labels == max(s, t)] = min(s, t)
                        out.append((p, q))
    return out


def tree_names(links: list[tuple[int, int]], nodes: list[bytes]) -> list[bytes]:
    """For each link the digest of its tree's members, so that equal trees of several buckets have one name."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for p, q in links:
        up[top(p)] = top(q)
    members: dict[int, list[bytes]] = {}
    for x in list(up):
        members.setdefault(top(x), []).append(nodes[x])
    names = {t: hashlib.md5(b"".join(sorted(m))).digest() for t, m in members.items()}
    return [names[top(p)] for p, _ in links]


def true_links(fps: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray | None, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Index pairs within the radius whose shingle sets have the similarity and that join classes of ``labels`` (changed in place).

    ``sides`` tells two chunks apart, whose pairs across are compared; None compares all pairs.
    """
    sizes = np.array([x.size for x in sets], np.int64)
    ends = np.cumsum(sizes)
    seen, flat = np.unique(np.concatenate(sets), return_inverse=True)
    terms = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    marked = np.zeros(seen.size, bool)
    out: list[tuple[int, int]] = []
    one, two = (np.arange(len(sets)),) * 2 if sides is None else (np.flatnonzero(sides == sides.min()), np.flatnonzero(sides != sides.min()))
    for p in one.tolist():
        v = two[two > p] if sides is None else two
        v = v[labels[v] != labels[p]]
        v = v[near_enough(np.bitwise_count(fps[v] ^ fps[p]).sum(1), np.maximum(sizes[v], sizes[p]), radius, similarity)]
        v = v[np.minimum(sizes[v], sizes[p]) >= similarity * np.maximum(sizes[v], sizes[p]) - 1e-9]
        if not v.size:
            continue
        marked[terms[p]] = True
        for q in v.tolist():
            if labels[q] != labels[p]:
                shared = int(np.count_nonzero(marked[terms[q]]))
                total = int(sizes[p] + sizes[q]) - shared
                if total == 0 or shared >= similarity * total - 1e-9:
                    labels[labels == max(labels[p], labels[q])] = min(labels[p], labels[q])
                    out.append((p, q))
        marked[terms[p]] = False
    return out


def text_digest(text_col: str) -> Column:
    """Sixteen bytes that name a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _signed_docs(docs: DataFrame, text_col: str, ids: list[str], words: int) -> DataFrame:
    """``ids``, ``node`` (digest of the text), ``fp``, ``pop`` (its bits set), ``size`` and ``keys`` of each row."""
    source = docs.select(*ids, text_digest(text_col).alias("node"), F.col(text_col).alias("__text"))
    kept = len(ids) + 1
    names = [*ids, "node", "fp", "pop", "size", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, keys = [], [], []
            for text in batch.column(kept):
                h = shingles(text.as_py(), words)
                fp, key = signature(h)
                fps.append(fp)
                sizes.append(h.size)
                keys.append(key)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), pa.array(fps, pa.binary()), pa.array([int.from_bytes(f).bit_count() for f in fps], pa.int32()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names)

    added = [T.StructField("fp", T.BinaryType()), T.StructField("pop", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return map_arrow(source, run, T.StructType([*source.schema.fields[:kept], *added]))


def _candidates(nodes: DataFrame, similarity: float, tile_rows: int, block: int) -> DataFrame:
    """Links ``(u, v)`` between nodes that span those within the radius, with the ``tree`` that each is part of."""
    radius = radius_of(similarity)
    words = BITS // 64
    banded = nodes.select("node", "fp", "size", "pop", F.posexplode("keys").alias("band", "key"))
    # Texts of few shingles meet in further bands, where population counts tell nothing.
    few = banded.where(F.col("size") * similarity < FEW).withColumns({"pop": F.lit(0), "band": F.col("band") + BANDS})
    rows = banded.where(F.col("size") >= FEW).unionByName(few)
    dealt = deal_tiles(rows, "node", radius, tile_rows)
    keys = ["band", "key", "a", "b"]
    ordered = dealt.select(*keys, "t", "pop", "size", "node", "fp").repartition(*keys).sortWithinPartitions(*keys, "pop", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(table: pa.Table, at: list[int], group: dict[str, np.ndarray]) -> pa.RecordBatch | None:
            fps = np.frombuffer(b"".join(table.column("fp").to_pylist()), "<u8").reshape(-1, words)
            node = table.column("node").combine_chunks()
            us, vs, trees = [], [], []
            for i, j in zip(at[:-1], at[1:]):
                if j - i > 1:
                    same = group["a"][i] == group["b"][i]
                    reach = radius if group["band"][i] < BANDS else BITS
                    found = spanning_links(fps[i:j], group["pop"][i:j], group["size"][i:j], None if same else group["t"][i:j], reach, similarity, block)
                    us += [i + p for p, _ in found]
                    vs += [i + q for _, q in found]
                    if found:
                        trees += tree_names(found, node.slice(i, j - i).to_pylist())
            if not us:
                return None
            return pa.RecordBatch.from_arrays([node.take(pa.array(us)), node.take(pa.array(vs)), pa.array(trees, pa.binary())], ["u", "v", "tree"])

        def cuts(table: pa.Table) -> tuple[list[int], dict[str, np.ndarray]]:
            group = {n: table.column(n).to_numpy().astype(np.int64) for n in (*keys, "t", "pop", "size")}
            new = np.zeros(table.num_rows - 1, bool)
            for k in keys:
                new |= group[k][1:] != group[k][:-1]
            return [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows], group

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            at, group = cuts(table)
            if len(at) > 2 and (out := flush(table.slice(0, at[-2]), at[:-1], group)):
                yield out
            held = table.slice(at[-2])
        if held is not None and (out := flush(held, *cuts(held))):
            yield out

    return map_arrow(ordered, run, "u binary, v binary, tree binary").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "tree").distinct()


def _texts(links: DataFrame, docs: DataFrame, hot: DataFrame, text_col: str) -> DataFrame:
    """``node`` and ``text`` of the links' ends; ``hot`` names the few texts with very many copies."""
    ends = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    every = docs.select(text_digest(text_col).alias("node"), F.col(text_col).alias("text"))
    copied = every.join(F.broadcast(hot), "node", "left_semi").dropDuplicates(["node"])  # one of each, before the shuffle
    others = every.join(F.broadcast(hot), "node", "left_anti").join(ends, "node", "left_semi").dropDuplicates(["node"])
    return cut(copied.unionByName(others), "similar-texts")


def _verified(links: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links whose texts have the similarity."""
    both = links.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = shingles(a.as_py(), words), shingles(b.as_py(), words)
                shared = np.intersect1d(x, y, assume_unique=True).size
                total = x.size + y.size - shared
                keep.append(total == 0 or shared >= similarity * total - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both.select("u", "v", "tu", "tv"), run, "u binary, v binary")


def _displaced(links: DataFrame, verified: DataFrame, label: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float, rows: int) -> DataFrame:
    """Links ``(u, v)`` that have the similarity and join what ``verified`` leaves apart in trees with a rejected link.

    Members of a tree are dealt to chunks of about ``rows``, and a task holds two chunks of shingle sets at most.
    """
    radius = radius_of(similarity)
    held = links.join(verified.withColumn("ok", F.lit(1)), ["u", "v"], "left").groupBy("tree").agg(F.count("*").alias("n"), F.count("ok").alias("ok"))
    bad = cut(held.where("ok < n").select("tree", "n"), "similar-bad")
    rest = hot_join(links, bad, "tree", F.col("n") * HOT_SHARE > links.count())
    members = rest.select("tree", F.col("u").alias("node")).union(rest.select("tree", "v")).distinct()
    members = cut(members.join(label, "node", "left").select("tree", "node", F.coalesce("group", "node").alias("label")), "similar-members")
    trees = members.groupBy("tree").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    trees = cut(trees.where("lo <> hi").select("tree", "n", F.ceil(F.col("n") / rows).cast("int").alias("nt")), "similar-trees")
    still = cut(hot_join(members, trees, "tree", F.col("n") * HOT_SHARE > members.count()).drop("n"), "similar-open")
    if still.isEmpty():
        return verified.limit(0)
    source = texts.join(still.select("node").distinct(), "node", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())], ["node", "set"])

    held = cut(map_arrow(source.select("node", "text"), sets, "node binary, set binary").join(nodes.select("node", "fp"), "node"), "similar-sets")
    chunk = still.withColumn("t", F.pmod(F.xxhash64("node"), F.col("nt")).cast("int"))
    dealt = chunk.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)))
    dealt = dealt.select("tree", "node", "label", "t", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"))
    keys = ["tree", "a", "b"]
    ordered = dealt.join(held, "node").select(*keys, "t", "node", "label", "fp", "set").repartition(*keys).sortWithinPartitions(*keys, "node")

    def compare(group: list[dict]) -> list[tuple[bytes, bytes]]:
        fps = np.frombuffer(b"".join(r["fp"] for r in group), "<u8").reshape(len(group), -1)
        labels = np.unique(np.array([r["label"].hex() for r in group]), return_inverse=True)[1]
        sides = None if group[0]["a"] == group[0]["b"] else np.array([r["t"] for r in group])
        if sides is not None and sides.min() == sides.max():
            return []
        found = true_links(fps, [np.frombuffer(r["set"], np.uint64) for r in group], labels, sides, radius, similarity)
        return [(group[p]["node"], group[q]["node"]) for p, q in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found = compare(group) if len(group) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate((*keys, "t", "node", "label", "fp", "set"))}
                if group and any(row[n] != group[0][n] for n in keys):
                    yield from flush()
                    group.clear()
                group.append(row)
        yield from flush()

    found = map_arrow(ordered, run, "u binary, v binary").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return cut(found.distinct(), "similar-displaced")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
    words: int = WORDS, similarity: float = SIMILARITY, tile_rows: int = TILE_ROWS, block: int = BLOCK_ROWS,
    open_rows: int = OPEN_ROWS,
) -> DataFrame:
    """One row per input row: ``id_col``, ``keep``, ``node`` (text digest) and ``group`` (the least node of its component)."""
    ids = [id_col, *(c for c in keep if c != id_col)]
    signed = cut(_signed_docs(docs, text_col, ids, words), "similar-signed")
    one = lambda c: F.any_value(c).alias(c)  # noqa: E731  equal for equal texts
    nodes = cut(signed.groupBy("node").agg(one("fp"), one("pop"), one("size"), one("keys"), F.count("*").alias("n")), "similar-nodes")
    rows = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    links = cut(_candidates(nodes, similarity, tile_rows, block), "similar-links")
    hot = F.col("n") * HOT_SHARE > rows  # HOT_SHARE nodes at most
    pairs = links.select("u", "v").distinct()
    texts = _texts(pairs, docs, nodes.where(hot).select("node"), text_col)
    verified = cut(_verified(pairs, texts, words, similarity), "similar-verified")
    label = roots(verified, "similar-components").withColumnRenamed("root", "group")
    more = _displaced(links, verified, label, nodes, texts, words, similarity, open_rows)
    if not more.isEmpty():
        label = roots(verified.union(more), "similar-components").withColumnRenamed("root", "group")
    named = nodes.select("node", "n").join(label, "node", "left").select("node", F.coalesce("group", "node").alias("group"), "n")
    return hot_join(signed.select(*ids, "node"), named, "node", hot).select(*ids, "node", "group")
