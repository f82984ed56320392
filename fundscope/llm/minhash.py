"""Near-duplicates by b-bit MinHash.

1. One pass over the texts gives every row its number of distinct shingles, a 128-bit digest of the
   shingle set, 128 minima (of which the low 4 bits are kept, packed into 64 bytes) and 32 band
   keys of 4 whole minima each. Rows with equal sets are one class from here on, so copies never
   meet as pairs.
2. Bands: only keys that two classes share go on. Pairs in a bucket are estimated from the packed
   signatures: the share of equal 4-bit groups, counted by bits, corrected for chance collisions (1
   in 16). Pairs within ``margin`` standard errors of the threshold put their classes into one
   family.
3. Families are then compared exactly: each class sends its full shingle set to its family, where
   intersections are counted as bits of the shared shingles.
4. Components of the links.

Both comparisons (``_settle``) deal a group into blocks and compare inside them; a large group is dealt several
times (each of its bands is a dealing of its own, a family has three), so that its near copies are one component
when the links found are put together. Groups within one component are done. In the others, the classes outside
of the largest component are compared with everything, block by block. A task skips pairs of one component and
returns at most one link for each component it joins to another: links grow with classes, and rows sent too,
but for groups whose members are mostly not alike. Every pair that shares a bucket is compared or already connected.

With 32 bands of 4 rows a pair of similarity 0.85 shares no band with probability 6e-11, one of 0.8
with 5e-8; the estimate's margin of 6 standard errors loses less than that.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundscope.llm.common import WORD, row_name, store
from fundscope.llm.graph import components, thin
from fundscope.session import parallelism

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
BANDS, ROWS, BITS = 32, 4, 4
PERMS = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMS, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64
CACHE = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Distinct shingle hashes (64 bits, sorted) of texts; word hashes are kept in a bounded cache."""

    def __init__(self, k: int):
        self.k, self.seen = k, {}

    def hashes(self, text: bytes | None) -> np.ndarray:
        words = WORDS.findall(text.lower()) if text else []
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        if len(self.seen) > CACHE:
            self.seen = {}
        seen, digest = self.seen, xxhash.xxh64_intdigest
        for w in set(words).difference(seen):
            seen[w] = digest(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, n)
        k = min(self.k, n)
        x = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            x = mix(x * _ODD[0]) + h[j:n - k + 1 + j]
        return np.unique(mix(x))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima, one row of PERMS for each (not empty) set."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), PERMS), np.uint64)
    a = 0
    while a < len(sets):  # pieces that stay in the cache of a core
        b = max(a + 1, int(np.searchsorted(np.cumsum(sizes[a:]), 1 << 14)) + a)
        x = np.concatenate(sets[a:b])
        start = np.concatenate([[0], np.cumsum(sizes[a:b])[:-1]])
        for j in range(PERMS):
            out[a:b, j] = np.minimum.reduceat(x * _A[j] + _B[j], start)
        a = b
    return out


def pack(minima: np.ndarray) -> np.ndarray:
    """The low BITS bits of the (mixed) minima, packed: rows of PERMS * BITS / 64 words."""
    low = mix(minima) & _U((1 << BITS) - 1)
    per = 64 // BITS
    shift = (np.arange(per, dtype=np.uint64) * _U(BITS))
    return np.bitwise_or.reduce(low.reshape(len(minima), -1, per) << shift, axis=2)


_LANES = _U(sum(1 << i for i in range(0, 64, BITS)))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (broadcast over leading axes): equal groups by bit counts,
    corrected for the chance of 2^-BITS that different minima agree."""
    x = a ^ b
    y = x
    for i in range(1, BITS):
        y = y | (x >> _U(i))
    equal = PERMS - np.bitwise_count(y & _LANES).sum(-1, dtype=np.int64)
    chance = 0.5**BITS
    return (equal / PERMS - chance) / (1 - chance)


def floor_of(threshold: float, margin: float) -> float:
    """What the estimate of a pair at the threshold exceeds but for ``margin`` standard errors."""
    chance = 0.5**BITS
    p = chance + (1 - chance) * threshold
    return threshold - margin * float(np.sqrt(p * (1 - p) / PERMS)) / (1 - chance)


def _fixed(rows: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    out = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * 8), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())
    return out if valid is None else pa.array([x if ok else None for x, ok in zip(out.to_pylist(), valid)], pa.binary())


def _words(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def _describe(k: int):
    """Batches (rid, id, text) to (rid, id, n, node, sig, bands); no node without words."""
    def run(batches):
        shingler = Shingler(k)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                sets = [shingler.hashes(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
                n = np.array([len(s) for s in sets], np.int64)
                some = n > 0
                full = [s for s in sets if len(s)]
                node, sig = np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), PERMS * BITS // 64), np.uint64)
                bands = np.zeros((len(sets), BANDS), np.uint64)
                if full:
                    minima = signatures(full)
                    node[some, 0] = [s.sum() for s in full]
                    node[some, 1] = [mix(s * _ODD[1]).sum() ^ _U(len(s)) for s in full]
                    sig[some] = pack(minima)
                    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS))
                    for r in range(ROWS):
                        key = mix(key * _ODD[2 + r] + minima.reshape(len(full), BANDS, ROWS)[:, :, r])
                    bands[some] = key
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32), pa.array(bands[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), _fixed(node, some), _fixed(sig, some), lists],
                                                 names=["rid", "id", "n", "node", "sig", "bands"])
    return run


def _shingle_sets(k: int):
    def run(batches):
        shingler = Shingler(k)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                sets = [shingler.hashes(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                                                 names=["node", "n", "set"])
    return run


def _join(labels: np.ndarray, x: int, near: np.ndarray) -> list[int]:
    """Put the rows ``near`` into x's group; one of each group that was another before."""
    _, first = np.unique(labels[near], return_index=True)
    new = near[first]
    new = new[labels[new] != labels[x]]
    if len(new):
        labels[np.isin(labels, labels[new])] = labels[x]
    return new.tolist()


def _estimated(least: float, ratio: float):
    """Pairs of a block (left and right rows) whose estimated similarity is high enough."""
    def found(t, rows, left, right, labels):
        n, sig = t["n"][rows], t["sig"][rows]
        out = []
        if len(left) * len(right) <= 1 << 14:
            low, high = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
            near = (labels[left][:, None] != labels[right]) & (low >= ratio * high)
            near &= estimate(sig[left][:, None], sig[right][None]) >= least
            for i in np.flatnonzero(near.any(1)):
                out += [(left[i], z) for z in _join(labels, left[i], right[near[i]])]
            return out
        for x in left:
            y = right[labels[right] != labels[x]]
            y = y[np.minimum(n[x], n[y]) >= ratio * np.maximum(n[x], n[y])]
            if len(y):
                out += [(x, z) for z in _join(labels, x, y[estimate(sig[x], sig[y]) >= least])]
        return out
    return found


SLAB = 1 << 16


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: bit counts over the values that several sets hold."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(many > 1)
    number = np.full(len(values), -1, np.int64)
    number[shared] = np.arange(len(shared))
    place = number[place]
    out = np.zeros((len(sets), len(sets)), np.int32)
    for a in range(0, len(shared), SLAB):
        own = (place >= a) & (place < a + SLAB)
        width = (min(SLAB, len(shared) - a) + 63) // 64
        bits = np.zeros(len(sets) * width, np.uint64)
        at = place[own] - a
        np.bitwise_or.at(bits, rows[own] * width + (at >> 6), _U(1) << (at & 63).astype(np.uint64))
        bits = bits.reshape(len(sets), width)
        for x in range(len(sets)):
            out[x] += np.bitwise_count(bits[x] & bits).sum(1, dtype=np.int32)
    return out


def _similar(percent: int):
    """Pairs of a block that are similar by their full sets."""
    def found(t, rows, left, right, labels):
        sets = [t["set"][r] for r in rows]
        n, both = np.array([len(s) for s in sets]), intersections(sets)
        linked = 100 * both.astype(np.int64) >= percent * (n[:, None] + n[None, :] - both)
        out = []
        for x in left:
            y = right[linked[x, right] & (labels[right] != labels[x])]
            if len(y):
                out += [(x, z) for z in _join(labels, x, y)]
        return out
    return found


def _in_blocks(compare):
    """A bin of whole blocks (or pairs of blocks): a forest of the links found in each."""
    def run(_, t):
        t = t.sort_by([("at", "ascending"), ("i", "ascending"), ("j", "ascending")])
        cols = {"n": t.column("n").to_numpy()}
        if "sig" in t.column_names:
            cols["sig"] = _words(t.column("sig").combine_chunks(), PERMS * BITS // 64)
        else:
            cols["set"] = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
        at, i, j, part = (t.column(c).to_numpy() for c in ("at", "i", "j", "part"))
        known: dict[bytes, int] = {}
        label = np.array([known.setdefault(x, len(known)) for x in t.column("label").to_pylist()], np.int64)
        cut = np.flatnonzero((at[1:] != at[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        found = []
        for a, b in zip([0, *cut], [*cut, len(at)]):
            own = part[a:b]
            left, right, labels = np.flatnonzero(own == i[a]), np.flatnonzero(own == j[a]), label[a:b].copy()
            found += [(a + x, a + y) for x, y in compare(cols, slice(a, b) if "sig" in cols else range(a, b), left, right, labels)]
        node = t.column("node")
        return pa.table([node.take([x for x, _ in found]), node.take([y for _, y in found])], names=["a", "b"]) if found else _NO_LINKS
    return run


_NO_LINKS = pa.table([pa.array([], pa.binary())] * 2, names=["a", "b"])
_LINK = "a binary, b binary"


def _compared(rows: DataFrame, compare, weight: int, name: str) -> DataFrame:
    """``rows``: grp, i, j, part, node, n, label and what ``compare`` reads. Blocks are put into bins of
    about equal work, dealt over a number of tasks that is not changed by their bytes."""
    rows = rows.withColumn("at", F.xxhash64("grp", "i", "j"))
    bins = max(1, math.ceil(weight))
    tasks = min(bins, 32 * max(8, parallelism(rows.sparkSession)))
    binned = rows.withColumn("bin", F.pmod("at", F.lit(bins)).cast("int")).drop("grp").repartition(tasks, "bin")
    return store(thin(binned.groupBy("bin").applyInArrow(_in_blocks(compare), _LINK), name), name)


def _settle(members: DataFrame, dealings: int, fetch, compare, weigh, block: int, name: str) -> DataFrame:
    """Components (node, comp) of the alike members (grp, node, parts: blocks of the group) of each group.
    Members are compared inside blocks, which are dealt ``dealings`` times where a group has several;
    then those of groups that are not one component, across blocks. ``fetch`` adds what ``compare``
    reads, ``weigh`` gives the bins for members."""
    times = F.when(F.col("parts") > 1, dealings).otherwise(1)
    dealt = members.withColumn("__r", F.explode(F.sequence(F.lit(1), times)))
    place = F.pmod(F.xxhash64("node", "grp", "__r"), F.col("parts")).cast("int") + F.col("__r") * F.col("parts")
    ready = fetch(dealt.select("grp", "node", F.col("node").alias("label"), place.alias("i"), place.alias("j"), place.alias("part")))
    links = _compared(ready, compare, weigh(members) * dealings, f"{name}-links")
    labels = components(links, name)
    told = members.where("parts > 1").join(labels.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").withColumn(
        "label", F.coalesce("comp", "node")).drop("comp", "__node")
    mixed = told.groupBy(F.col("grp").alias("__grp")).agg(F.min("label").alias("__low"), F.max("label").alias("__high")).where("__low <> __high")
    rest = store(told.join(mixed.select("__grp"), F.col("grp") == F.col("__grp"), "left_semi"), f"{name}-rest")
    if not rest.limit(1).count():
        return labels
    # the largest component of a group needs no comparison with itself
    of_label = rest.groupBy("grp", "label").agg(F.count("node").alias("m"))
    per = of_label.groupBy("grp").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all")).select(
        F.col("grp").alias("__grp"), F.col("top.label").alias("__top"), F.ceil(F.col("top.m") / F.lit(block)).cast("int").alias("__main"),
        F.ceil((F.col("all") - F.col("top.m")) / F.lit(block)).cast("int").alias("__side"))
    blocks = rest.join(per, F.col("grp") == F.col("__grp")).withColumn("__main", F.greatest("__main", F.least("parts", F.col("__main") + F.col("__side")) - F.col("__side")))
    main = F.col("label") == F.col("__top")
    h = F.xxhash64("node", "grp")
    blocks = blocks.withColumn("part", F.when(main, F.pmod(h, F.col("__main"))).otherwise(F.col("__main") + F.pmod(h, F.col("__side"))).cast("int"))
    others = F.when(main, F.sequence(F.col("__main"), F.col("__main") + F.col("__side") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("__main") + F.col("__side") - 1))
    pairs = blocks.withColumn("__other", F.explode(others)).select(
        "grp", "node", "label", F.least("part", "__other").alias("i"), F.greatest("part", "__other").alias("j"), "part", "parts")
    new = _compared(fetch(pairs.drop("parts")), compare, weigh(pairs), f"{name}-cross")
    return components(links.unionAll(new), name) if new.limit(1).count() else labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80, margin: float = 6.0, block: int = 1024, block_shingles: int = 3_000_000) -> DataFrame:
    """One row per row of ``docs``: ``rid`` (16-byte name of id and text), ``id_col``, ``n_shingles``,
    ``component_id`` and ``kept``.

    Words are runs of non-blank characters with A-Z lower-cased, shingles ``shingle`` consecutive
    words (all words, if fewer). Rows are linked where 100 * intersection >= ``percent`` * union of
    their shingle sets. ``component_id`` is the smallest id of the linked rows (null if none has one),
    ``kept`` marks the row or rows with that id and, among equal ids, the smallest ``rid``; rows that
    repeat id and text share one decision. Null texts and texts without words have 0 shingles, are
    linked with nothing and kept. An empty table gives no rows. Other columns are ignored. A task
    compares at most two blocks of ``block`` classes, of about ``block_shingles`` shingles each.
    """
    least = floor_of(percent / 100, margin)
    rid = row_name(id_col, text_col)
    rows = store(docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
                 .mapInArrow(_describe(shingle), "rid binary, id long, n long, node binary, sig binary, bands array<long>"), "minhash-rows")
    named = rows.where("node is not null")
    classes = store(named.groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("rid").alias("rid"),
                                              F.first("bands").alias("bands")), "minhash-classes")
    lines = classes.select("node", F.explode("bands").alias("grp"))
    shared = lines.groupBy("grp").agg(F.count("node").alias("many")).where("many > 1")
    buckets = store(lines.join(shared, "grp").select("grp", "node", F.ceil(F.col("many") / F.lit(block)).cast("int").alias("parts")),
                    "minhash-buckets")
    sketches = classes.select("node", "n", "sig")
    # bands deal the blocks of copies anew by themselves
    families = _settle(buckets, 1, lambda w: w.join(sketches, "node"),
                       _estimated(least, percent / 100), lambda w: w.count() / 4096, block, "minhash-families")

    # one text of each class that has a family, found by its row name (the list grows with the corpus:
    # a merge join at every size)
    own = store(classes.select("node", "rid", "n").join(families, "node"), "minhash-own")
    sizes = own.groupBy("comp").agg(F.greatest(F.ceil(F.count("node") / F.lit(block)), F.ceil(F.sum("n") / F.lit(block_shingles))).cast("int").alias("parts"))
    texts = docs.select(rid.alias("rid"), F.col(text_col).alias("t")).join(
        own.select(F.col("rid").alias("own_rid"), "node").hint("merge"), F.col("rid") == F.col("own_rid"))
    sets = store(texts.dropDuplicates(["rid"]).select("node", "t").mapInArrow(_shingle_sets(shingle), "node binary, n long, set binary"), "minhash-sets")
    members = store(own.select("node", F.col("comp").alias("grp")).join(sizes.withColumnRenamed("comp", "grp"), "grp"), "minhash-members")
    shingles = own.select(F.col("node").alias("__n"), F.col("n").alias("__s"))
    weigh = lambda w: (w.join(shingles, F.col("node") == F.col("__n")).agg(F.sum("__s")).first()[0] or 0) / 500_000
    labels = _settle(members, 3, lambda w: w.join(sets, "node"), _similar(percent), weigh, block, "minhash-links")

    of_node = named.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "rid")).alias("best")).join(
        labels, "node", "left").select("node", "best", F.coalesce("comp", "node").alias("comp"))
    best = of_node.groupBy("comp").agg(F.min("best").alias("best"))
    decided = store(of_node.select("node", "comp").join(best, "comp").select("node", "best"), "minhash-decided")
    out = rows.select("rid", "id", "n", "node").join(decided, "node", "left")
    alone = F.col("node").isNull()
    return out.select("rid", F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
                      (alone | (F.col("rid") == F.col("best.rid"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near-duplicates, with its own columns; of rows that repeat id and
    text one counts. Every row without words is kept, whatever its id."""
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col("rid").alias("__kept")).distinct()
    wordy = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    own = docs.where(wordy).withColumn("__rid", row_name(id_col, text_col))
    own = own.join(kept.hint("merge"), F.col("__rid") == F.col("__kept")).dropDuplicates(["__rid"]).select(*docs.columns)
    return own.unionAll(docs.where(~wordy))
