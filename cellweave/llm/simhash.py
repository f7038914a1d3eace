"""SimHash near-duplicates with pivot distance tables.

Fingerprints: XXH64 (seed 42) of each word shingle, one bit per position by majority. Equal fingerprints
are collapsed first. Fingerprints within `bits` of each other agree on at least m of the bits + m segments
that the 64 bits are cut into (pigeonhole), so pairs are searched only among fingerprints that share m
segments; m grows with their number so that a bucket stays small in expectation, and no pair is lost.

Inside a bucket the Hamming distances to fixed reference fingerprints (pivots) are tabulated. A pair whose
coordinates differ by more than `bits` anywhere cannot link (triangle inequality) and is discarded by its
maximum coordinate difference; the survivors are verified. Pairs already connected are skipped and each bucket
emits a forest, never all its pairs. Buckets beyond `BUCKET` are dealt in pairs of chunks to separate tasks, so
a hot bucket is split without losing a pair. Components are closed over the forests.

`near_duplicates` groups texts of similarity >= 0.8 on five-word shingles. All links are counted exactly on
shingle sets, in three steps: each text with the nearest one by fingerprint, found by pivots inside buckets of
least shingle hashes (three of them a key, eight keys a text); all pairs between different trees of those buckets;
and, for texts that share no key, all pairs between trees that share a shingle of their prefixes, which no pair at
the similarity can avoid, unless their parity cells differ in more places than the sets could. So fingerprints and keys only set the order of work: no link depends on them.

Nulls: a null text has no words and fingerprint zero, linked like any other; a null doc_id never is a
component's id unless it is alone. Repeated rows share a component and each get a row. An empty table
gives an empty result. Further columns of the input are not read.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import checkpoint, slices, write_table
from cellweave.llm.components import components

BITS, WIDTH = 4, 64
SEED = 42
#: Rows of a bucket that one task compares; larger buckets are dealt in pairs of chunks of this size.
BUCKET = 4096
#: Fingerprints expected in a bucket at most.
EXPECTED = 1000
PIVOTS = 12
#: The near-duplicate search: words a shingle, similarity, keys, hashes a key, bits between likely partners.
NGRAM, SIMILARITY, KEYS, KEY_HASHES, LIKELY = 5, 0.8, 8, 3, 13
#: Two hashes that stand for a row.
ROW_KEYS = {"k1": "xxhash64(cast(doc_id as long), text)", "k2": "xxhash64(text, cast(doc_id as long), 7)"}
#: Rows of one key from which on it is joined by broadcast, while such keys are not too many; else they are salted.
HOT_COPIES, BROADCAST_KEYS, SALTS = 50, 100_000, 8
#: Rows that one task of a dealt table gets at most, in expectation.
TASK_ROWS = 500_000
#: Distinct words whose hash a worker keeps.
WORDS_KEPT = 500_000
#: Documents whose shingles are counted for the order in prefixes, and how many frequent shingles are kept.
SAMPLE, OFTEN = 4000, 200_000
_U64 = np.uint64


def shingle_hashes(text: str, ngram: int) -> np.ndarray:
    """XXH64 of the space-joined shingles of a text, A-Z lower-cased, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, _U64)
    joined = b" ".join(words)
    if len(words) <= ngram:
        return np.asarray([xxhash.xxh64_intdigest(joined, SEED)], _U64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (stops - [len(w) + 1 for w in words])[: len(words) - ngram + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (stops[ngram - 1 :] - 1).tolist(), strict=True)), _U64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is set if it is in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(_U64)[0])


def mix(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of 64-bit hashes (a xor-multiply finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ _U64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(29))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(32))


def fingerprints(docs: DataFrame, ngram: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                fps = np.asarray([majority(shingle_hashes(t or "", ngram)) for t in part.column(1).to_pylist()], _U64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def survivors(fps: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """i, the rows j that follow it in the pivot table and are within `limit` bits of it, and how many bits apart.

    The table is sorted by the distance to the first pivot, so a row's partners lie in a window of it; of the window
    all rows with a larger coordinate difference anywhere are discarded, and the rest is verified.
    """
    pivots = mix(np.arange(PIVOTS, dtype=_U64), 77)
    far = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(far[:, 0], kind="stable")
    fps, far = fps[order], far[order]
    stop = np.searchsorted(far[:, 0], far[:, 0] + limit, "right")
    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.abs(far[i + 1 : stop[i]] - far[i]).max(1, initial=0) <= limit) + i + 1
        apart = np.bitwise_count(fps[near] ^ fps[i])
        held = apart <= limit
        if held.any():
            yield int(order[i]), order[near[held]], apart[held]


def forest(fps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges (i, j) that connect all of the fingerprints within `limit` bits, n - 1 at most."""
    label = np.arange(len(fps))
    edges = []
    for i, near, _ in survivors(fps, limit):
        for j in near.tolist():
            if label[j] != label[i]:
                edges.append((i, j))
                label[label == label[j]] = label[i]
    return edges


def nearest(fps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges (i, j) of each row to the fingerprint nearest to it within `limit` bits, n at most."""
    least = np.full(len(fps), limit + 1)
    partner = np.full(len(fps), -1)
    for i, near, apart in survivors(fps, limit):
        k = int(np.argmin(apart))
        if apart[k] < least[i]:
            least[i], partner[i] = apart[k], near[k]
        better = apart < least[near]
        least[near[better]], partner[near[better]] = apart[better], i
    return sorted({(min(i, j), max(i, j)) for i, j in enumerate(partner.tolist()) if j >= 0})


def exact_forest(shingles: np.ndarray, stops: np.ndarray, tree: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges (i, j) that connect all sets of that Jaccard similarity, counted exactly, where trees already hold together.

    Set i is shingles[stops[i] : stops[i + 1]]. Every pair between two trees is compared, except by size if it alone
    tells them apart.
    """
    n, size = len(tree), np.diff(stops)
    label = np.unique(tree, return_inverse=True)[1]
    if n < 2 or label.max() == 0:
        return []
    names, flat = np.unique(shingles, return_inverse=True)
    ids = np.split(flat, stops[1:-1])
    held = np.zeros(len(names), bool)
    edges = []
    for i in range(n - 1):
        at = np.arange(i + 1, n)
        at = at[(label[at] != label[i]) & (np.minimum(size[at], size[i]) >= similarity * np.maximum(size[at], size[i])) & (size[at] > 0)]
        if not len(at):
            continue
        held[ids[i]] = True
        for part in np.array_split(at, -(-len(at) // 256)):
            common = np.add.reduceat(held[np.concatenate([ids[j] for j in part])], np.append(0, np.cumsum(size[part])[:-1]), dtype=np.int64)
            for j in part[common >= similarity * (size[part] + size[i] - common)].tolist():
                if label[j] != label[i]:
                    edges.append((i, j))
                    label[label == label[j]] = label[i]
        held[ids[i]] = False
    return edges


def prefix(hashes: np.ndarray, similarity: float, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles (sorted, distinct) of which two sets of that Jaccard similarity share one.

    They are the first n - ceil(similarity n) + 1 by count among `often` (0 for others), then hash. Any order that all
    sets keep loses no pair; this one leaves out what is in many documents.
    """
    count = np.zeros(len(hashes), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        count = np.where(often[at] == hashes, counts[at], 0)
    kept = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    return hashes[np.argsort(count, kind="stable")[:kept]]


def parity(hashes: np.ndarray) -> bytes:
    """Whether an odd number of the hashes falls into each of so many cells, two or more for each hash.

    Two sets differ in at least as many hashes as their cells differ. The cells of a smaller table are those of a
    larger one folded.
    """
    bits = 64 << max(0, math.ceil(math.log2(max(1, len(hashes)) / 32)))
    counts = np.bincount((hashes & _U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def partners(size: np.ndarray, tree: np.ndarray, keys: np.ndarray, cells: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) between trees that may have the similarity: but for those that share a key, so were compared already,
    and those whose sizes or cells differ too much for it."""
    width = np.asarray([len(c) // 8 for c in cells])
    tables: dict[int, np.ndarray] = {}
    place = {}
    for w in np.unique(width).tolist():
        for level in {w, max(1, w // 2)}:
            own = np.flatnonzero(width == w)
            rows = np.frombuffer(b"".join(cells[k] for k in own.tolist()), _U64).reshape(len(own), w)
            rows = rows if level == w else rows[:, :level] ^ rows[:, level:]
            at = place.setdefault(level, np.full(len(size), -1))
            before = tables.get(level, np.zeros((0, level), _U64))
            at[own] = len(before) + np.arange(len(own))
            tables[level] = np.concatenate([before, rows])
    out = []
    for i in range(len(size) - 1):
        at = np.arange(i + 1, len(size))
        at = at[(tree[at] != tree[i]) & (np.minimum(size[at], size[i]) >= similarity * np.maximum(size[at], size[i]))]
        at = at[~(keys[at] == keys[i]).any(1)]
        for level in {int(width[i]), max(1, int(width[i]) // 2)} if len(at) else ():
            near = at[np.minimum(width[at], width[i]) == level]
            table, where = tables[level], place[level]
            apart = np.bitwise_count(table[where[near]] ^ table[where[i]]).sum(1, dtype=np.int64)
            out += [(i, j) for j in near[apart <= (1 - similarity) / (1 + similarity) * (size[near] + size[i]) + 1e-6].tolist()]
    return out


def parts_of(spark: SparkSession, rows: int) -> int:
    """Tasks that a table of so many rows is dealt to: those of the session, more if a task would get too many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _in_buckets(keyed: DataFrame, find: Callable[[pa.Array], list[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) that `find` sees among the rows (bucket, node, bits) of a bucket; hot buckets are dealt in chunk pairs.

    find takes the bits of the rows that meet and gives pairs of their positions.
    """
    spark, rows = keyed.sparkSession, keyed.count()
    hot = checkpoint(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > BUCKET))
    if not hot.isEmpty():
        chunks = F.ceil(F.col("size") / F.lit(BUCKET // 2)).cast("int")
        own = F.pmod(F.xxhash64("node", F.lit(9)), F.coalesce(chunks, F.lit(1))).cast("int")
        joined = keyed.join(hot, "bucket", "left").withColumn("own", own).withColumn("chunks", F.coalesce(chunks, F.lit(1)))
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
        keyed = joined.select("bucket", "node", "bits", "own", "chunks", other).where((F.col("chunks") == 1) | (F.col("own") != F.col("other")))
        # Two chunks meet in each task, which so also compares the rows of one chunk among themselves.
        keyed = keyed.select("bucket", "node", "bits", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    else:
        keyed = keyed.select("bucket", "node", "bits", F.lit(0).alias("x"), F.lit(0).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def link(rows: pa.Table) -> pa.RecordBatch:
            group = [rows.column(k).to_numpy() for k in (0, 3, 4)]
            node = rows.column(1).to_numpy()
            bits = pa.concat_arrays(rows.column(2).chunks)
            first = np.flatnonzero(np.append(True, np.any([g[1:] != g[:-1] for g in group], axis=0)))
            a, b = [], []
            for start, end in zip(first.tolist(), np.append(first[1:], len(node)).tolist(), strict=True):
                for i, j in find(bits.slice(start, end - start)):
                    a.append(node[start + i])
                    b.append(node[start + j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def last_start(batch: pa.RecordBatch) -> int:
            """Where the last bucket of a batch begins."""
            same = np.logical_and.reduce([batch.column(k).to_numpy() == batch.column(k)[batch.num_rows - 1].as_py() for k in (0, 3, 4)])
            return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0

        for batch in batches:
            if not batch.num_rows:
                continue
            cut = last_start(batch)
            begins = bool(held) and any(held[-1].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in (0, 3, 4))
            if cut or begins:
                yield link(pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield link(pa.Table.from_batches(held))

    dealt = keyed.repartition(parts_of(spark, rows), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "node")
    return dealt.mapInArrow(run, "a long, b long")


def segment_masks(n: int, limit: int = BITS) -> list[int]:
    """Masks of the segments of which two fingerprints within `limit` bits share one, for n fingerprints."""
    for m in range(1, 5):
        cuts = [round(k * WIDTH / (limit + m)) for k in range(limit + m + 1)]
        segments = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
        if n / 2 ** (m * min(b - a for a, b in zip(cuts, cuts[1:], strict=False))) <= EXPECTED or m == 4:
            return [sum(c) for c in combinations(segments, m)]
    raise AssertionError


def link(fps: DataFrame, limit: int = BITS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints fps (fp) within `limit` bits."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in segment_masks(fps.count(), limit)]
    buckets = F.explode(F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(signed))))
    return _in_buckets(fps.select(buckets.alias("bucket"), F.col("fp").alias("node"), F.col("fp").alias("bits")), lambda bits: forest(bits.to_numpy(zero_copy_only=False).view(_U64), limit))


def classes(docs: DataFrame, ngram: int = 4, limit: int = BITS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable) of each row of docs (doc_id, text)."""
    rows = write_table(fingerprints(docs, ngram), "fingerprints")
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    return _closed(rows, "fp", distinct, link(distinct.select("fp"), limit))


def _closed(rows: DataFrame, key: str, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with root (the least key of the component) and component_id (its least doc_id).

    distinct has each key once, with its least doc_id `rep` and number of rows `copies`; edges joins keys.
    Only linked keys are grouped.
    """
    roots = components(edges)
    member = distinct.join(roots.withColumnRenamed("node", key), key)
    least = member.groupBy("root").agg(F.min("rep").alias("least"))
    linked = member.join(least, "root").select(key, "root", "least")
    every = distinct.join(linked, key, "left")
    every = every.select(key, F.coalesce("root", key).alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"), "copies")
    # Keys of many copies join without a shuffle; the rest have few rows a key.
    every = checkpoint(every)
    hot = every.where(F.col("copies") > HOT_COPIES).drop("copies")
    n_hot = hot.count()
    if not n_hot:
        return rows.join(every.drop("copies"), key)
    if n_hot <= BROADCAST_KEYS:
        often = rows.join(F.broadcast(hot), key)
        rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(every.where(F.col("copies") <= HOT_COPIES).drop("copies"), key)
        return often.unionByName(rest)
    # Too many to broadcast: every key is joined in as many pieces as there are salts.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    spread = every.drop("copies").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(spread, [key, "salt"]).drop("salt")


class WordHashes(dict):
    """Word -> its hash, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: str, ngram: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit codes of the word shingles of a text, A-Z lower-cased: hashes of the words, folded in order."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, _U64)
    h = np.fromiter(map(known.__getitem__, words), _U64, len(words))
    n = min(ngram, len(words))
    code = np.zeros(len(h) - n + 1, _U64)
    for k in range(n):
        code = code * _U64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
    return np.unique(mix(code, n))


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The fingerprint and the bucket keys of a sorted set of shingle hashes.

    A key joins least hashes: the range of hashes is cut into equal parts, the least of a part (or of the next that has
    one) stands for it, and three parts make a key.
    """
    if not len(hashes):
        return 0, np.zeros(0, np.int64)
    parts = KEYS * KEY_HASHES
    starts = np.asarray([(k << 64) // parts for k in range(parts)], _U64)
    least = hashes[np.searchsorted(hashes, starts) % len(hashes)].reshape(KEYS, KEY_HASHES)
    key = mix(np.arange(KEYS, dtype=_U64), 5)
    for k in range(KEY_HASHES):
        key = mix(key ^ least[:, k], k)
    return majority(hashes), key.view(np.int64)


def _small(df: DataFrame, n: int | None = None) -> DataFrame:
    """df (checkpointed) for a broadcast if its rows are few, else as it is."""
    return F.broadcast(df) if (df.count() if n is None else n) <= BROADCAST_KEYS else df


def _sets(docs: DataFrame, chosen: DataFrame, ngram: int) -> DataFrame:
    """node, s: the shingle set of each of the chosen (node, k1, k2): the document that stands for it is shingled again."""
    chosen = checkpoint(chosen)
    texts = docs.selectExpr("text", *(f"{e} as {k}" for k, e in ROW_KEYS.items())).join(_small(chosen), ["k1", "k2"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingle_set(t or "", ngram, known).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    # A row that is repeated with its doc_id stands there several times.
    return checkpoint(texts.mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"]))


def _verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) between nodes whose shingle sets have that Jaccard similarity, counted exactly."""
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _often(docs: DataFrame, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several documents of a bounded sample, sorted, and their counts there. They only steer the order."""
    n = docs.count()
    some = docs.where(F.pmod(F.expr(ROW_KEYS["k1"]), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(n, 1)))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, 0):
                found = [shingle_set(t or "", ngram, known) for t in part.column(0).to_pylist()]
                h, k = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k)], names=["h", "k"])

    top = some.mapInArrow(run, "h long, k long").groupBy("h").agg(F.sum("k").alias("k")).where("k > 2").orderBy(F.desc("k"), "h").limit(OFTEN).toArrow()
    h, k = top.column(0).to_numpy().view(_U64), top.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], k[order]


def _release(df: DataFrame) -> None:
    """Have the shuffle files and checkpoints of finished steps removed: they go when the JVM collects what made them."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _between_trees(keyed: DataFrame, edges: DataFrame, explode: str | None = None) -> DataFrame:
    """keyed (bucket, node, ...) with tree (the component of node over edges), of the buckets that hold two trees.

    `explode` names a column of many buckets that becomes bucket after the trees are joined.
    """
    trees = checkpoint(components(edges))
    treed = keyed.join(_small(trees.select("node", F.col("root").alias("tree"))), "node", "left").withColumn("tree", F.coalesce("tree", "node"))
    if explode:
        treed = treed.select(F.explode(explode).alias("bucket"), "node", "tree")
    else:
        # Counted before the shuffle, so a hot bucket of one tree is a few rows.
        treed = checkpoint(treed)
        several = checkpoint(treed.groupBy("bucket").agg(F.min("tree").alias("x"), F.max("tree").alias("y")).where("x < y").select("bucket"))
        return treed.join(_small(several), "bucket")
    whole = Window.partitionBy("bucket")
    return checkpoint(treed.withColumn("x", F.min("tree").over(whole)).withColumn("y", F.max("tree").over(whole)).where("x < y").drop("x", "y"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, ngram: int = NGRAM) -> DataFrame:
    """doc_id, k1, k2 (hashes of doc_id and text), root and component_id of each row of docs (doc_id, text).

    Texts of `similarity` or more on `ngram`-word shingles are linked; component_id is the least
    doc_id of the group. Texts without words form a group of their own.
    """
    often, counts = _often(docs, ngram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingle_set(t or "", ngram, known) for t in part.column(1).to_pylist()]
                found = [sketch(s) for s in sets]
                node = np.asarray([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], _U64).view(np.int64)
                fp = np.asarray([f[0] for f in found], _U64).view(np.int64)
                keys, size = pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int32())
                cells = pa.array([parity(s) for s in sets], pa.binary())
                first = pa.array([prefix(s, similarity, often, counts).view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(node), pa.array(fp), keys, size, cells, first], names=["doc_id", "k1", "k2", "node", "fp", "keys", "size", "cells", "prefix"])

    keyed_docs = docs.selectExpr("cast(doc_id as long) doc_id", "text", *(f"{e} as {k}" for k, e in ROW_KEYS.items()))
    # The prefixes, a fifth of the shingles, are the one large column: it is written once and read once.
    rows = write_table(keyed_docs.mapInArrow(run, "doc_id long, k1 long, k2 long, node long, fp long, keys array<long>, size int, cells binary, prefix array<long>"), "sketches")
    # node stands for the set of shingles: copies are collapsed, one of them standing for all, before any bucket is made.
    stands = F.min(F.struct("k1", "k2")).alias("stands")
    distinct = checkpoint(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), stands, *(F.first(c).alias(c) for c in ("fp", "keys", "size", "cells"))))
    chosen = distinct.select("node", "stands.k1", "stands.k2")
    keyed = distinct.select(F.explode("keys").alias("bucket"), "node", "fp")
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    keyed = checkpoint(keyed.join(shared, "bucket"))
    sets = _sets(docs, chosen.join(keyed.select("node").distinct(), "node"), ngram)
    _release(docs)

    def likely(fps: pa.Array) -> list[tuple[int, int]]:
        return nearest(fps.to_numpy(zero_copy_only=False).view(_U64), LIKELY)

    # The fingerprints propose each node's partner; the shingles decide, first on those, then on all pairs between trees.
    found = _in_buckets(keyed.withColumnRenamed("fp", "bits"), likely).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = checkpoint(_verified(found.distinct(), sets, similarity))
    apart = _between_trees(keyed.select("bucket", "node"), edges)

    def compare(held: pa.Array) -> list[tuple[int, int]]:
        tree, own = (pc.struct_field(held, k) for k in (0, 1))
        stops = np.append(0, np.cumsum(pc.list_value_length(own).to_numpy()))
        return exact_forest(own.flatten().to_numpy(), stops, tree.to_numpy(), similarity)

    edges = checkpoint(edges.union(_in_buckets(apart.join(sets, "node").select("bucket", "node", F.struct("tree", "s").alias("bits")), compare)))
    del sets, apart, found
    _release(docs)
    # Pairs that share no key: what shares a shingle of both prefixes and is still apart.
    copied = distinct.where("copies > 1").select("node")
    n_copied = copied.count()
    if n_copied <= BROADCAST_KEYS:
        firsts = rows.select("node", "prefix").join(F.broadcast(copied), "node", "left_anti")
        firsts = firsts.unionByName(rows.select("node", "prefix").join(F.broadcast(copied), "node", "left_semi").groupBy("node").agg(F.first("prefix").alias("prefix")))
    else:
        firsts = rows.groupBy("node").agg(F.first("prefix").alias("prefix"))
    apart = _between_trees(firsts, edges, "prefix")
    _release(docs)
    apart = apart.join(distinct.select("node", "size", "keys", "cells"), "node").select("bucket", "node", F.struct("tree", "size", "keys", "cells").alias("bits"))

    def pair(held: pa.Array) -> list[tuple[int, int]]:
        tree, size, keys, cells = (pc.struct_field(held, k) for k in range(4))
        return partners(size.to_numpy(), tree.to_numpy(), keys.flatten().to_numpy().reshape(-1, KEYS), cells.to_pylist(), similarity)

    # Beyond both prefixes two sets share no more than the longer rest, so with what they share inside most are too few.
    found = _in_buckets(apart, pair).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("common"))
    rest = F.ceil(similarity * F.col("size") - 1e-9) - 1
    for k in ("a", "b"):
        found = found.join(distinct.select(F.col("node").alias(k), F.col("size").alias(f"n{k}"), rest.alias(f"rest_{k}")), k)
    enough = F.col("common") + F.greatest("rest_a", "rest_b") >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6
    found = checkpoint(found.where(enough).select("a", "b"))
    sets = _sets(docs, chosen.join(found.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), ngram)
    edges = checkpoint(edges.union(_verified(found, sets, similarity)))
    return _closed(rows.select("doc_id", "k1", "k2", "node"), "node", distinct.select("node", "rep", "copies"), edges)


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, ngram: int = NGRAM) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least doc_id."""
    found = checkpoint(near_duplicates(docs, similarity, ngram).select("root", "doc_id", "k1", "k2"))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("w")).select(F.col("w.k1").alias("k1"), F.col("w.k2").alias("k2"))
    # The rows that go are fewer than those that stay: only they are looked for.
    gone = checkpoint(found.select("k1", "k2").distinct().join(first, ["k1", "k2"], "left_anti").select(F.col("k1").alias("__gone_k1"), F.col("k2").alias("__gone_k2")))
    hashed = docs.select("*", *(F.expr(e).alias(f"__cellweave_{k}") for k, e in ROW_KEYS.items()))
    k1, k2 = F.col("__cellweave_k1"), F.col("__cellweave_k2")
    kept = hashed.join(_small(gone), (k1 == F.col("__gone_k1")) & (k2 == F.col("__gone_k2")), "left_anti")
    if not found.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # Rows repeated with the same doc_id and text: one of them stays.
        kept = kept.dropDuplicates(["__cellweave_k1", "__cellweave_k2"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
