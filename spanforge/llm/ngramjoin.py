"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its shingles of five words (runs of ASCII letters and
digits and of characters beyond ASCII, lower-cased). Documents with equal sets are
one class. Classes of which the Jaccard similarity is at least ``threshold`` are linked.

1. Sketch: HASHES MinHash values, and a key for each of BANDS bands of them. Two
   classes at the threshold 0.8 share no band with probability 5e-8.
2. Buckets: classes by band key; buckets with equal members are one.
3. Pruning, in a bucket: MinHash values of pairs are compared in steps; a pair is
   dropped as soon as the posterior probability (uniform prior) that its similarity
   reaches the threshold is below TOLERANCE. Pairs that are known to be connected
   need no comparison. Survivors link classes into candidate clusters.
4. Verification, in a cluster: exact intersections of all pairs of shingle sets, as
   products of 0/1 matrices over shared shingles, in blocks. Every class gets its
   number of links and an edge to a linked class.
5. Groups: connected components of the verified links.

Large buckets and clusters are dealt out as pairs of tiles, so that no task holds
more than two, and tasks return a row per class, never one per pair. Texts are
shuffled only for classes in clusters.

Cases: a null text or one without words has no shingles, and is a group of its own;
one of fewer than five words has one shingle; copies count as one class; rows equal
in id and text are one document; null ids come last when the least id is taken, and
a group of null ids only has a null class_id; an empty table gives no rows; other
columns are ignored, or pass through ``one_of_each``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import hash_filter, may_hold, partitions, save, table
from .graph import connected_components

WORDS, THRESHOLD = 5, 0.8
BANDS, PER_BAND = 32, 4
HASHES = BANDS * PER_BAND
STEP, TOLERANCE = 16, 1e-6
#: Classes of a bucket in a tile; characters of a cluster's texts in a tile.
TILE, TILE_CHARS = 4096, 2_000_000
COLUMNS = 4096
SKETCH = "doc long, doc_id long, k long, sig binary, bands array<long>"


def word_bytes() -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
    found[128:] = True
    return found


IN_WORD = word_bytes()
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]).astype(np.uint64))


class Powers:
    """base ** i modulo 2 ** 64 for as many i as were asked for."""

    held: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, base: int, n: int) -> np.ndarray:
        found = cls.held.get(base)
        if found is None or len(found) <= n:
            found = cls.held[base] = powers(base, max(n, 1 << 16))
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.concatenate([[False], IN_WORD[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * Powers.of(PRIME, len(raw))[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * Powers.of(INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    h = word_hashes(text)
    n = min(words, len(h))
    if not n:
        return h
    found = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        found = mixed(found * np.uint64(PRIME) + h[i : len(h) - n + 1 + i])
    return np.unique(found)


def set_key(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return (rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


FACTORS, SHIFTS = permutations()


def minhash(own: np.ndarray, chunk: int = 1024) -> np.ndarray:
    low = (own >> np.uint64(32)).astype(np.uint32)
    found = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), chunk):
        values = FACTORS[:, None] * low[None, i : i + chunk] + SHIFTS[:, None]
        np.minimum(found, values.min(axis=1), out=found)
    return found


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in sig.reshape(BANDS, PER_BAND).T:
        h = mixed(h * np.uint64(PRIME) + column.astype(np.uint64))
    return h.view(np.int64)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, doc_id, text -> SKETCH. Two bytes of a MinHash value are kept for comparisons, all go into the band keys."""
    for batch in batches:
        keys, sigs, bands = [], [], []
        for text in batch.column(2).to_pylist():
            own = shingles(text)
            if len(own):
                sig = minhash(own)
                keys.append(set_key(own))
                sigs.append((sig & np.uint32(0xFFFF)).astype("<u2").tobytes())
                bands.append(band_keys(sig))
            else:
                keys.append(None)
                sigs.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc", "doc_id", "k", "sig", "bands"],
        )


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n = STEP, 2 STEP, ...: the least number of matches among n with which the threshold is still believable.

    With m of n matches and a uniform prior the similarity is Beta(m + 1, n - m + 1); that it is at least t has the
    probability that at most m of n + 1 trials of chance t succeed.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return np.array(out)


def believable(one: np.ndarray, many: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of ``many`` may reach the threshold with ``one``."""
    alive = np.arange(len(many))
    matches = np.zeros(len(many), dtype=np.int64)
    for i, low in enumerate(least):
        cut = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (many[alive, cut] == one[cut]).sum(axis=1)
        on = matches >= low
        alive, matches = alive[on], matches[on]
        if not len(alive):
            break
    return alive


class Forest:
    """Union of positions, with the least as root."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[i]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]


def two_tiles(run: pa.Table) -> bool:
    """Whether a run is of two tiles. A tile can be empty, so that the sides don't tell."""
    return run.column("one")[0] != run.column("two")[0]


def prune_run(keys: np.ndarray, sigs: np.ndarray, side: np.ndarray, across: bool, least: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the believable pairs of a bucket; with two tiles (sides 0 and 1) only those across."""
    if across and (side.all() or not side.any()):
        return []
    forest = Forest(len(keys))
    for i in range(len(keys)):
        rest = np.flatnonzero(forest.root != forest.root[i])
        rest = rest[(rest > i) & (side[rest] != side[i])] if across else rest[rest > i]
        if len(rest):
            hit = rest[believable(sigs[i], sigs[rest], least)]
            if len(hit):
                forest.join(i, hit)
    return [(int(keys[i]), int(keys[r])) for i, r in enumerate(forest.root) if i != r]


def runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """The rows of sorted batches with equal values in the first ``by`` columns, run by run."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(by)], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, [len(marks)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mark = tuple(marks[a])
            if mark != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = mark
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def pruner(least: np.ndarray):
    """bucket, one, two, k, side, sig, sorted -> edges."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for run in runs(batches, 3):
            sigs = np.frombuffer(b"".join(run.column("sig").to_pylist()), "<u2").reshape(run.num_rows, -1)
            out += prune_run(run.column("k").to_numpy(), sigs, run.column("side").to_numpy(), two_tiles(run), least)
            if len(out) > 10_000:
                yield edge_batch(out)
                out = []
        yield edge_batch(out)

    return prune


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other, over the values that more than one has."""
    values = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    number = np.cumsum(first) - 1
    shared = np.bincount(number)[number] > 1
    owner, number = owner[shared], np.cumsum(first[shared]) - 1
    found = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        a, b = np.searchsorted(number, [at, at + COLUMNS])
        block = np.zeros((len(left) + len(right), COLUMNS), dtype=np.float32)
        block[owner[a:b], number[a:b] - at] = 1
        found += block[: len(left)] @ block[len(left) :].T
    return found


def verify_run(keys: np.ndarray, texts: list[str], side: np.ndarray, across: bool, threshold: float) -> list[tuple[int, int, int]]:
    """k, its links, a linked class (the least of its group here); with two tiles (sides 0 and 1) only links across."""
    if across and (side.all() or not side.any()):
        return []
    sets = [shingles(t) for t in texts]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(len(keys)),) * 2
    both = intersections([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
    near = both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-9
    if not across:
        np.fill_diagonal(near, False)
    links = np.zeros(len(keys), dtype=np.int64)
    links[left] += near.sum(axis=1)
    if across:
        links[right] += near.sum(axis=0)
    forest = Forest(len(keys))
    for i, row in zip(left, near, strict=True):
        hit = right[row]
        if len(hit):
            forest.join(int(i), hit)
    return [(int(k), int(n), int(keys[r])) for k, n, r in zip(keys, links, forest.root, strict=True)]


def verifier(threshold: float):
    """cluster, one, two, k, side, text, sorted -> k, links, other."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 3):
            keys, texts, side = run.column("k").to_numpy(), run.column("text").to_pylist(), run.column("side").to_numpy()
            # Rows of equal id may bring a text of another class along.
            own = np.array([len(s := shingles(t)) > 0 and set_key(s) == k for k, t in zip(keys, texts, strict=True)])
            _, first = np.unique(np.where(own, keys, -1), return_index=True)
            at = np.array([i for i in first if own[i]], dtype=np.int64)
            out = verify_run(keys[at], [texts[i] for i in at], side[at], two_tiles(run), threshold) if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["k", "links", "other"])

    return verify


def tiled(rows: DataFrame, by: str, tiles: str) -> DataFrame:
    """Every row once for each pair of tiles that has its own: columns one, two (tiles), side (1: the second of two)."""
    own = rows.withColumn("tile", F.pmod(F.xxhash64("k"), F.col(tiles)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col(tiles).cast("int") - 1))
    own = own.withColumn("other", other)
    own = own.withColumns({"one": F.least("tile", "other"), "two": F.greatest("tile", "other"), "side": (F.col("tile") > F.col("other")).cast("int")})
    n = partitions(rows.sparkSession)
    return own.drop("tile", "other", tiles).repartition(n, by, "one", "two").sortWithinPartitions(by, "one", "two", "k")


def clusters(classes: DataFrame, threshold: float) -> DataFrame:
    """k, root: classes that may be linked."""
    keyed = classes.select(F.explode("bands").alias("bucket"), "k")
    own = Window.partitionBy("bucket")
    keyed = keyed.withColumns({"n": F.count("*").over(own), "x": F.bit_xor(F.xxhash64("k")).over(own), "least": F.min("k").over(own)})
    members = keyed.where("n > 1").select(F.xxhash64("x", "n", "least").alias("bucket"), "k", "n").distinct()
    members = save(members, "join-members").join(classes.select("k", "sig"), "k")
    rows = tiled(members.withColumn("tiles", F.ceil(F.col("n") / TILE)).drop("n"), "bucket", "tiles")
    rows = rows.select("bucket", "one", "two", "k", "side", "sig")
    edges = rows.mapInArrow(pruner(least_matches(threshold)), "a long, b long")
    return save(connected_components(edges).withColumnRenamed("id", "k"), "join-clusters")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc (hash of id and text), doc_id, class_id (least id of the group of linked classes), text_id (least id of the class), n_links, n_copies, first (is it the one to keep)."""
    ship_package(docs.sparkSession)
    own = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = save(own.mapInArrow(sketch, SKETCH), "join-sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc")
    classes = sketches.where("k IS NOT NULL").groupBy("k").agg(
        F.min(order).alias("first"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = save(classes, "join-classes")
    found = clusters(classes, threshold)
    wanted = save(found.join(classes.select("k", F.col("first.doc").alias("doc")), "k"), "join-wanted")
    texts = may_hold(own.select("doc", "text"), "doc", hash_filter(wanted, "doc")).join(wanted, "doc").dropDuplicates(["k"])
    texts = save(texts.select(F.col("root").alias("cluster"), "k", "text"), "join-texts")
    chars = texts.groupBy(F.col("cluster").alias("c")).agg(F.ceil(F.sum(F.length("text")) / TILE_CHARS).alias("tiles"))
    rows = tiled(texts.join(chars, F.col("cluster") == F.col("c")).drop("c"), "cluster", "tiles")
    verified = rows.select("cluster", "one", "two", "k", "side", "text").mapInArrow(verifier(threshold), "k long, links long, other long")
    verified = save(verified, "join-verified")
    links = verified.groupBy("k").agg(F.sum("links").alias("n_links"))
    roots = connected_components(verified.where("k <> other").select(F.col("k").alias("a"), F.col("other").alias("b")))
    own = classes.select("k", "first", "n_copies").join(roots.withColumnRenamed("id", "k"), "k", "left").join(links, "k", "left")
    own = save(own.withColumn("root", F.coalesce("root", "k")), "join-roots")
    heads = own.groupBy("root").agg(F.min("first").alias("head"))
    own = own.join(heads, "root").select("k", "head", F.col("first.doc_id").alias("text_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = sketches.select("doc", "doc_id", "k").join(save(own, "join-groups"), "k", "left")
    alone = F.col("k").isNull()
    return out.select(
        "doc",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        (alone | (F.col("doc") == F.col("head.doc"))).alias("first"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that are linked, directly or through others, to one of a lesser id."""
    gone = save(join(docs, threshold).where("NOT first").select("doc").distinct(), "join-gone")
    bits = save(hash_filter(gone, "doc"), "join-filter")
    own = docs.withColumn("_join_doc", F.xxhash64("doc_id", "text"))
    gone = gone.withColumnRenamed("doc", "_join_doc")
    safe = may_hold(own, "_join_doc", bits, inverse=True)
    return safe.unionByName(may_hold(own, "_join_doc", bits).join(gone, "_join_doc", "left_anti")).select(*docs.columns)


def op8_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group, class and number of links of all documents."""
    return join(table(spark, sf_dir, "documents")).drop("doc", "first")
