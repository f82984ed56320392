"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows of ``window`` consecutive words (a shorter item is one
window). Words are numbered by the benchmark's vocabulary, words outside it are 0, so comparing
numbers is comparing words. For each window length m there is one search:

* a shift table over blocks of two words says how far the window may move when a block is at its
  end: ``m - 1`` words where the block occurs in no pattern (the usual case: such positions are
  never looked at), less where it ends nearer to a pattern's end, 0 where it ends one;
* positions with shift 0 look up the patterns with that last block (the suffix bucket);
* the patterns of the bucket are compared word by word.

The scan moves many cursors over the text at once (one per stretch of 512 words), each jumping by
its own shift.

Rows are searched where they are read, without a shuffle. The pattern tables are sent to the tasks
in slices of at most ``slice_bytes`` of benchmark text each (beyond that, one more pass over the
rows per slice), so what is broadcast has a bound at any benchmark size.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundscope.llm.common import set_aside, store

#: After lower-casing A-Z, words are runs of digits, a-z and all characters beyond ASCII. On UTF-8
#: bytes the class is the same, as every byte of such a character is above 0x7F.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STRETCH, PAIRS = 512, 1 << 20


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return WORDS.findall((text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower())


class WuManber:
    """Search for ``patterns`` (distinct rows of word numbers above 0, all of one length)."""

    def __init__(self, patterns: np.ndarray, n_words: int):
        self.m, self.base = patterns.shape[1], n_words + 1
        self.block = min(2, self.m)
        code = lambda j: patterns[:, j].astype(np.int64) + (patterns[:, j - 1].astype(np.int64) * self.base if self.block == 2 else 0)
        order = np.argsort(code(self.m - 1), kind="stable")
        self.patterns, self.number = patterns[order], order
        self.suffix = code(self.m - 1)[order]
        self.bits = max(12, int(4 * len(patterns) * self.m).bit_length())
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.uint8 if self.m < 256 else np.int32)
        for j in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self._slot(code(j)), self.m - 1 - j)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each occurrence's last word, pattern number)."""
        n = len(words)
        at = np.arange(self.m - 1, n, STRETCH)
        end = np.minimum(at + STRETCH, n)
        found = []
        while len(at):
            code = words[at].astype(np.int64)
            if self.block == 2:
                code += words[at - 1].astype(np.int64) * self.base
            step = self.shift[self._slot(code)].astype(np.int64)
            if len(zero := np.flatnonzero(step == 0)):
                found.append((at[zero], code[zero]))
                step[zero] = 1
            at = at + step
            if not (live := at < end).all():
                at, end = at[live], end[live]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return self._confirm(words, *(np.concatenate(x) for x in zip(*found)))

    def _confirm(self, words, at, code) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(self.suffix, code, "left"), np.searchsorted(self.suffix, code, "right")
        some = high > low
        at, low, many = at[some], low[some], (high - low)[some]
        hits = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        total = np.concatenate([[0], np.cumsum(many)])
        for a in range(0, int(total[-1]), PAIRS):  # pairs of position and pattern, a bounded number at a time
            pair = np.arange(a, min(a + PAIRS, int(total[-1])))
            i = np.searchsorted(total, pair, "right") - 1
            p, q = at[i], low[i] + pair - total[i]
            for j in range(self.m):
                same = words[p - (self.m - 1) + j] == self.patterns[q, j]
                p, q = p[same], q[same]
            hits.append((p, self.number[q]))
        return tuple(np.concatenate(x) for x in zip(*hits))


class Windows:
    """The windows of some benchmark items, ready to search; small enough to send to every task."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        vocabulary: dict[bytes, int] = {}
        groups: dict[int, dict[bytes, set[int]]] = {}
        self.ids = sorted({i for i, _ in items})
        place = {x: n for n, x in enumerate(self.ids)}
        for item, text in items:
            w = np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in words_of(text)], np.int32)
            m = min(window, len(w))
            for a in range(len(w) - m + 1 if m else 0):
                groups.setdefault(m, {}).setdefault(w[a:a + m].tobytes(), set()).add(place[item])
        self.vocabulary = vocabulary
        self.groups = []
        for m, own in sorted(groups.items()):
            patterns = np.frombuffer(b"".join(own), np.int32).reshape(-1, m)
            owners = [np.array(sorted(x), np.int64) for x in own.values()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in owners])])
            self.groups.append((WuManber(patterns, len(vocabulary)), np.concatenate(owners), first))

    def search(self, texts: list[bytes | None]):
        """For each text: its number of words, its hit spans (word indexes, end exclusive) and its items."""
        get, lists = self.vocabulary.get, [words_of(t) for t in texts]
        counts = np.array([len(x) for x in lists], np.int64)
        # a 0 before each text: no window crosses from one text to the next
        start = np.cumsum(counts + 1) - counts
        words = np.zeros(int((counts + 1).sum()), np.int32)
        for a, x in zip(start, lists):
            words[a:a + len(x)] = np.fromiter(map(get, x, itertools.repeat(0)), np.int32, len(x))
        edge = np.zeros(len(words) + 1, np.int32)
        pairs = []
        for search, owners, first in self.groups:
            at, pattern = search.find(words)
            np.add.at(edge, at - search.m + 1, 1)
            np.add.at(edge, at + 1, -1)
            text = np.searchsorted(start, at, "right") - 1
            both = np.unique(np.stack([text, pattern], 1), axis=0) if len(at) else np.empty((0, 2), np.int64)
            many = first[both[:, 1] + 1] - first[both[:, 1]]
            row = np.repeat(both[:, 0], many)
            k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[both[:, 1]], many)
            pairs.append(np.stack([row, owners[k]], 1))
        hit = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
        change = np.flatnonzero(np.diff(hit))
        spans: list[list] = [[] for _ in texts]
        for a, b in zip(change[::2], change[1::2]):
            t = int(np.searchsorted(start, a, "right") - 1)
            spans[t].append((int(a - start[t]), int(b - start[t])))
        items: list[list] = [[] for _ in texts]
        for t, i in np.unique(np.concatenate(pairs), axis=0) if pairs else ():
            items[t].append(self.ids[i])
        return counts.tolist(), spans, items


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merge(a: list, b: list) -> list:
    out: list = []
    for s, e in sorted(itertools.chain(a, b)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_windows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", window: int = 10, slice_bytes: int = 4 << 20) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_words`` (long), ``hit_spans`` (word ranges covered by
    occurrences, merged, end exclusive) and ``hit_items`` (ids as strings, sorted, distinct); input
    columns of these names are replaced.

    Null and empty texts have no words and no hits; a benchmark item without words has no window; an
    item without id is reported as ``null``; repeated items count once; empty tables give no hits.
    Long texts are searched whole.
    """
    own = ("n_words", "hit_spans", "hit_items")
    base = docs.select(*[c for c in docs.columns if c not in own])
    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPAN),
                           T.StructField("hit_items", T.ArrayType(T.StringType()))])
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"),
                             F.col(item_text_col).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = max(1, math.ceil(total / slice_bytes))
    piece = F.pmod(F.xxhash64("i", "t"), F.lit(slices))
    sc, out = docs.sparkSession.sparkContext, base
    for n in range(slices):
        sent = sc.broadcast(Windows([(r.i, r.t) for r in items.where(piece == n).collect()], window))
        out = out.mapInArrow(_search(sent, text_col, n > 0), schema)
        if n + 1 < slices:
            out = store(out, "decontaminate")
    return out


def _search(sent, text_col: str, again: bool):
    def run(batches):
        for b in batches:
            names = b.schema.names
            texts = b.column(names.index(text_col)).cast(pa.binary()).to_pylist()
            counts, spans, items = sent.value.search(texts)
            keep = b.columns
            if again:
                for x in (0, 1):
                    old = b.column(len(keep) - 2 + x).to_pylist()
                    for i, more in enumerate(old):
                        if x:
                            items[i] = sorted({*items[i], *more})
                        else:
                            spans[i] = _merge(spans[i], [(s["start"], s["end"]) for s in more])
                keep, names = keep[:-3], names[:-3]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(counts, pa.int64()),
                 pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _ARROW_SPAN),
                 pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "hit_spans", "hit_items"])
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their own columns."""
    rows, own = set_aside(docs, ("n_words", "hit_spans", "hit_items"))
    return own(find_windows(rows, benchmark, **options).where(F.size("hit_items") == 0))
