"""Repeated passages, exact to the byte, with a run-length BWT index of the repetitive parts.

A byte is removed if a string of ``length`` bytes that covers it starts at any other place of the
corpus too. All start places of equal strings must meet in one index, and no index may hold the
corpus, so:

1. Anchors. Each ``length``-byte window is owned by the smallest-hashed ``GRAM``-byte gram inside it
   (the leftmost, if equal). Equal windows have equal grams, so equal owners; consecutive windows
   share an owner, one owner per 89 bytes or so. A row of the anchor table is a stretch of
   consecutive windows of one owner: gram hash, hash of the stretch's bytes, place.
2. Only grams that occur twice can own a repeated window. Stretches with equal bytes (by 128 bits of
   digests) become one with a count, so a passage that thousands of documents share is indexed once;
   its windows are repeated by its count. A gram with one such stretch has nothing to be compared with.
3. The stretches are put into buckets by gram hash, by total size, a few MB each. A task builds the
   suffix order of its bucket and the BWT's runs, and keeps at the two ends of each run the text
   place and the length of the match with the neighbour in suffix order. Inside a run the match
   shrinks by one with every step through the text, so the samples at run ends are enough to stream
   the longest match of every text place (its matching statistics against all other places).
   Windows with matches of ``length`` or more are marked. In repetitive text runs are few.
4. Marks go back to all places of their stretch, are merged per document, and cut from the texts.

A gram with more than ``CROWD`` different stretches (the edge of a passage in very many documents)
would fill a bucket alone. Its stretches are dealt again by a longer gram inside them (half of what
is left to ``length``, and so on up to whole windows), which parts the windows that reach into each
document's own text from those inside the passage, and these become one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundscope.llm.common import store

GRAM, CROWD = 24, 20_000
_U = np.uint64
_RNG = np.random.default_rng(424242)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P1, _P2 = (int(x) * 2 + 1 for x in _RNG.integers(2**61, 2**62, 2))
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _gram_hashes(v: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each place (places with fewer left out)."""
    total, out, done, power, level = len(v) - size + 1, None, 0, 1, v
    # level: hashes of runs of ``power`` values; size is put together from its binary digits
    while True:
        if size & power:
            out = level[:total] if out is None else out * _U(pow(_P1, power, 1 << 64)) + level[done:done + total]
            done += power
        if power * 2 > size:
            return out
        level = level[:len(level) - power] * _U(pow(_P1, power, 1 << 64)) + level[power:]
        power *= 2


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    power, total = 1, len(x) - size + 1
    while power * 2 <= size:
        x = np.minimum(x[:len(x) - power], x[power:])
        power *= 2
    return np.minimum(x[:total], x[size - power:size - power + total])


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def stretches(texts: list[bytes], length: int, powers=None, gram: int = GRAM):
    """Columns (text number, first window, windows, gram hash, stretch hash) of all texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return [np.empty(0, np.int64)] * 5
    v = _BYTE[data]
    hashes = _mix(_gram_hashes(v, gram))
    # the upper half decides, then the place: leftmost of equal ones
    key = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    owner = (_sliding_min(key, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), np.maximum(sizes, 0))[:len(owner)]
    valid = np.arange(len(owner)) + length <= ends[text]
    new = valid.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    stop = np.concatenate([first[1:], [len(owner)]])
    # windows of a stretch: up to the next stretch or the last valid window of its text
    last = np.minimum(stop, ends[text[first]] - length + 1)
    count = last - first
    up = powers if powers is not None and len(powers[0]) > len(data) else (_powers(len(data), _P2), _powers(len(data), pow(_P2, -1, 1 << 64)))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * up[0][:len(data)])])
    own = _mix((prefix[last - 1 + length] - prefix[first]) * up[1][first] + count.astype(np.uint64))
    return [text[first], first - (ends - sizes)[text[first]], count, hashes[owner[first]], own]


def _anchor_rows(length: int):
    def run(batches):
        size = 1 << 17
        powers = (_powers(size, _P2), _powers(size, pow(_P2, -1, 1 << 64)))
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            rid, a = b.column(0).to_numpy(), 0
            while a < len(texts):
                z, load = a, 0
                while z < len(texts) and (z == a or load + len(texts[z]) < size):
                    load += len(texts[z])
                    z += 1
                text, first, count, gram, own = stretches(texts[a:z], length, powers)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(gram).astype(np.uint64).view(np.int64)), pa.array(np.asarray(own).astype(np.uint64).view(np.int64)),
                     pa.array(rid[a:z][text]), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["gram", "own", "rid", "first", "windows"])
                a = z
    return run


# -- the index of one bucket -----------------------------------------------------------------------


class RunLengthIndex:
    """Suffix order of a text of small integers, its BWT's runs, and samples at the run ends."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        wide = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])  # 0 is behind the end
        key = np.zeros(n, np.int64)
        for j in range(7):
            key = (key << 9) | wide[j:j + n]
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        rank = np.empty(n, np.int32)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the place of a group's first suffix
        self.levels, size = [(7, rank.copy())], 7
        while True:
            starts = np.flatnonzero(new)
            group = np.diff(np.append(starts, n))
            open_ = np.repeat(group > 1, group)
            if not open_.any():
                break
            at = np.flatnonzero(open_)
            suffix = order[at]
            after = suffix + size
            second = np.where(after < n, rank[np.minimum(after, n - 1)], -1).astype(np.int64)
            both = rank[suffix].astype(np.int64) * (n + 1) + second + 1
            by = np.argsort(both)
            order[at] = suffix[by]
            both = both[by]
            change = np.concatenate([[True], both[1:] != both[:-1]])
            new[at] = change
            rank[order[at]] = at[np.maximum.accumulate(np.where(change, np.arange(len(at)), 0))]
            size *= 2
            self.levels.append((size, rank.copy()))
        self.text = text
        bwt = np.where(order > 0, text[order - 1], -1)  # before the whole text stands a symbol of its own
        head = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        self.run_symbols = bwt[head]
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], n) - 1
        self.run_lengths = ends - starts + 1
        # samples: text place and match length with the neighbour outside the run, at both ends of a run
        self.head_at, self.tail_at = order[starts], order[ends]
        self.head_match = np.concatenate([[0], self._match(order[starts[1:]], order[starts[1:] - 1])])
        self.tail_match = np.concatenate([self._match(order[ends[:-1]], order[ends[:-1] + 1]), [0]])

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix: the ranks by the first 7, 14, 28, ... symbols, then symbols."""
        n, out = len(self.text), np.zeros(len(a), np.int64)
        for size, rank in self.levels[::-1]:
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += np.where((a + out < n) & (b + out < n) & (rank[x] == rank[y]), size, 0)
        live = np.ones(len(a), bool)
        for _ in range(6):
            x, y = a + out, b + out
            live &= (x < n) & (y < n)
            live &= self.text[np.minimum(x, n - 1)] == self.text[np.minimum(y, n - 1)]
            out += live
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each place of the text, the longest match with any other place, streamed from the run
        ends: from one sampled place to the next it is one less with every step."""
        n, out = len(self.text), np.zeros(len(self.text), np.int64)
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            until = np.zeros(n, np.int64)
            until[at] = at + match
            np.maximum(out, np.maximum.accumulate(until) - np.arange(n), out=out)
        return out


def _marks(length: int):
    """A bucket's stretches to (gram, own, lo, hi): runs of repeated windows, hi exclusive."""
    def run(t):
        out = [[], [], [], []]
        data, several = t.column("bytes").to_pylist(), t.column("many").to_numpy() > 1
        if not data:
            return _mark_table(out)
        parts, starts, at = [], [], 0
        for x in data:
            parts.append(np.append(np.frombuffer(x, np.uint8).astype(np.int16) + 1, np.int16(0)))
            starts.append(at)
            at += len(parts[-1])
        text = np.concatenate(parts)
        match = RunLengthIndex(text).matching_statistics()
        left = np.flatnonzero(text == 0)
        left = left[np.searchsorted(left, np.arange(len(text)))] - np.arange(len(text))  # to the stretch's end
        repeated = np.minimum(match, left) >= length
        grams, owns, windows = t.column("gram").to_numpy(), t.column("own").to_numpy(), t.column("windows").to_numpy()
        for i, s in enumerate(starts):
            flags = repeated[s:s + windows[i]] | several[i]
            if flags.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                for lo, hi in zip(edge[::2], edge[1::2]):
                    for column, value in zip(out, (grams[i], owns[i], lo, hi)):
                        column.append(int(value))
        return _mark_table(out)
    return run


def _mark_table(out) -> pa.Table:
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())],
                    names=["gram", "own", "lo", "hi"])


def _cut_out(length: int):
    """Rows (text, stretches) to (gram, own, windows, many, crowd, bytes)."""
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 512):
                rows = []
                for text, own in zip(b.column(0).slice(a, 512).cast(pa.binary()).to_pylist(), b.column(1).slice(a, 512).to_pylist()):
                    rows += [(s["gram"], s["own"], s["windows"], s["many"], s["crowd"], text[s["first"]:s["first"] + s["windows"] - 1 + length]) for s in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), (
                        pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()))],
                        names=["gram", "own", "windows", "many", "crowd", "bytes"])
    return run


def _deal_again(length: int, gram: int):
    """Stretches of crowded grams to the stretches of their longer grams, with their place inside."""
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                p = b.slice(a, 256)
                data = p.column(4).to_pylist()
                row, first, windows, grams, own = stretches(data, length, None, gram)
                parts = [data[r][f:f + w - 1 + length] for r, f, w in zip(row, first, windows)]
                yield pa.RecordBatch.from_arrays(
                    [p.column(0).take(pa.array(row)), p.column(1).take(pa.array(row)), pa.array(first.astype(np.int32)),
                     pa.array(grams.view(np.int64)), pa.array(own.view(np.int64)), pa.array(windows.astype(np.int32)),
                     p.column(3).take(pa.array(row)), pa.array(parts, pa.binary())],
                    names=["root_gram", "root_own", "at", "gram", "own", "windows", "many", "bytes"])
    return run


def _alone(kinds: DataFrame) -> DataFrame:
    """Marks of the only stretches of their grams: all windows, if the stretch is there several times."""
    return kinds.where("n = 1 AND many > 1").select("gram", "own", F.lit(0).alias("lo"), F.col("windows").alias("hi"))


def _marked(cut: DataFrame, length: int, gram: int, bucket_bytes: int) -> DataFrame:
    """(gram, own, lo, hi): the repeated windows of all stretches in ``cut`` (gram, own, windows, many,
    crowd, bytes)."""
    total, crowded = cut.agg(F.sum(F.col("windows") + length), F.max("crowd")).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    marks = (cut.where("not crowd").drop("crowd").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
             .groupBy("bucket").applyInArrow(_marks(length), "gram long, own long, lo int, hi int"))
    if not crowded:
        return marks
    longer = (gram + length + 1) // 2
    dealt = store(cut.where("crowd").select("gram", "own", "windows", "many", "bytes").mapInArrow(
        _deal_again(length, longer), "root_gram long, root_own long, at int, gram long, own long, windows int, many long, bytes binary"), "repeats-dealt")
    kinds = dealt.groupBy("gram", "own").agg(F.sum("many").alias("many"), F.first("windows").alias("windows"), F.first("bytes").alias("bytes"))
    size = dealt.groupBy("gram").agg(F.count_distinct("own").alias("n"), F.sum("many").alias("places")).where("places > 1")
    kinds = store(kinds.join(size, "gram").select("gram", "own", "windows", "many", "n", "bytes"), "repeats-cut")
    crowd = (F.col("n") > CROWD) if longer < length else F.lit(False)
    inner = _marked(kinds.where("n > 1").withColumn("crowd", crowd).drop("n"), length, longer, bucket_bytes).unionAll(_alone(kinds))
    back = dealt.drop("bytes").join(inner, ["gram", "own"]).select(
        F.col("root_gram").alias("gram"), F.col("root_own").alias("own"), (F.col("at") + F.col("lo")).cast("int").alias("lo"),
        (F.col("at") + F.col("hi")).cast("int").alias("hi"))
    return marks.unionAll(back)


# -- the operator ----------------------------------------------------------------------------------

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                   bucket_bytes: int = 2 << 20) -> DataFrame:
    """All rows and columns of ``docs`` with ``repeat_spans`` (array<struct<start:int,end:int>>, byte
    ranges, end exclusive, maximal) and ``kept_bytes`` (binary, the bytes outside them); input columns
    of these names are replaced.

    Every byte covered by a ``length``-byte string that starts at another place too is in a span; both
    places may be in one text and may overlap; matches don't cross rows; rows that repeat others are
    places of their own. Null and empty texts, and texts below ``length``, have no spans (null texts
    keep null bytes). An empty table gives no rows.
    """
    base = docs.select(*[c for c in docs.columns if c not in ("repeat_spans", "kept_bytes")])
    rid = F.xxhash64(F.col(id_col), F.col(text_col))
    long_ = base.where(F.octet_length(text_col) >= length)
    rows = store(long_.select(rid.alias("rid"), F.col(text_col).alias("t"))
                 .mapInArrow(_anchor_rows(length), "gram long, own long, rid long, first int, windows int"), "repeats-anchors")
    grams = rows.groupBy("gram").agg(F.count("gram").alias("n")).where("n > 1").select("gram")
    places = store(rows.join(grams, "gram", "left_semi"), "repeats-places")
    kinds = places.groupBy("gram", "own").agg(F.count("rid").alias("many"), F.min(F.struct("rid", "first", "windows")).alias("at"))
    crowds = kinds.groupBy("gram").agg(F.count("own").alias("n"))
    kinds = store(kinds.join(crowds, "gram").select("gram", "own", "many", "at.*", "n"), "repeats-kinds")
    per_text = kinds.where("n > 1").groupBy("rid").agg(F.collect_list(F.struct(
        "gram", "own", "first", "windows", "many", (F.col("n") > CROWD).alias("crowd"))).alias("s"))
    cut = store(long_.select(rid.alias("rid"), F.col(text_col).alias("t")).dropDuplicates(["rid"]).join(per_text, "rid").select("t", "s")
                .mapInArrow(_cut_out(length), "gram long, own long, windows int, many long, crowd boolean, bytes binary"), "repeats-cut")

    marks = store(_marked(cut, length, GRAM, bucket_bytes).unionAll(_alone(kinds)), "repeats-marks")

    spans = (places.join(marks, ["gram", "own"]).select("rid", (F.col("first") + F.col("lo")).alias("start"),
                                                        (F.col("first") + F.col("hi") - 1 + length).alias("end"))
             .groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("repeat_spans")))
    spans = store(spans.select(F.col("rid").alias("__rid"), _merged(F.col("repeat_spans")).alias("repeat_spans")), "repeats-spans")
    out = base.withColumn("__own", rid).join(spans, F.col("__own") == F.col("__rid"), "left")
    schema = T.StructType([*base.schema.fields, T.StructField("repeat_spans", _SPAN), T.StructField("kept_bytes", T.BinaryType())])
    return out.select(*base.columns, F.coalesce("repeat_spans", F.array().cast(_SPAN)).alias("repeat_spans")).mapInArrow(_cut(text_col), schema)


def _merged(spans):
    """Sorted spans, those that touch or overlap put together."""
    zero = F.array().cast(_SPAN)

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.array_append(acc, x))
    return F.aggregate(spans, zero, add)


def _cut(text_col: str):
    def run(batches):
        for b in batches:
            spans = b.column(b.num_columns - 1)
            kept = []
            for t, own in zip(b.column(b.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist(), spans.to_pylist()):
                if own and t is not None:
                    stops = [0, *(x for s in own for x in (s["start"], s["end"])), len(t)]
                    t = b"".join(t[a:z] for a, z in zip(stops[::2], stops[1::2]))
                kept.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, pa.binary())], names=[*b.schema.names, "kept_bytes"])
    return run
