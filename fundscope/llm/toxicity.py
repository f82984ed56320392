"""Toxicity by a subsequence string kernel and a support vector machine over Nyström landmarks.

Kernel: two words are alike by the character triples they share as subsequences, up to two other
characters in between, each costing a factor ``DECAY``; the word's start and end count as characters.
Inserted characters, gaps and endings leave most triples of an insult in place. Written out, the
kernel is a sparse product over triples, divided by both words' sizes.

Training, on the driver, on a bounded sample of labelled rows (``max_toxic`` and ``max_clean``):
words that stand in many toxic and in hardly any clean texts are the positive examples (where there
are none, all words more frequent in toxic texts, weighted), words of clean texts the negative ones,
the hardest of them found in two rounds. Landmarks are positives and
negatives; the Nyström map of the kernel on them feeds a linear SVM (squared hinge, Newton steps).
Its decision is a sum over landmarks of kernels, so it folds into one weight per triple: scoring a
word costs the same for any number of landmarks. This is done on three parts of the sample, leaving
out a third each time; the decisions are averaged. A logistic model on a text's two highest word
scores and its number of clearly positive words, fitted on scores by the decision that had left the
text out and weighted to the true class sizes, gives the probability.

Scoring reads every whole text once where it lies, without a shuffle; the model is some MB.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundscope.llm.linear import logistic, sigmoid

DECAY, SLOTS, WIDTH = 0.5, 1 << 20, 24
_SPELLED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
_JUNK = re.compile(r"[\W\d_]+")
CACHE = 400_000
NOTHING = -2.0  # the score of a text without words
CLEAR = 0.5  # word scores from here on count as positive
FOLDS = 3
NOISY = 1.0  # cost of a row where most positive words mark nothing, else 10


def tokens(text: str | None) -> set[str]:
    """Distinct lower-cased tokens of a text; spelled-out words (``i d i o t``) add one token each."""
    text = (text or "").lower()
    out = set(text.split())
    if out:
        out.update(x.replace(" ", "") for x in _SPELLED.findall(text))
    return out


def triples(words: list[str]):
    """Triple slots and weights, one line per word (weight 0 behind its end), and each word's size."""
    longest = max(map(len, words), default=0) + 2
    text = np.zeros((len(words), longest + 4), np.uint64)
    text[:, 0] = 1
    size = np.array([len(w) + 2 for w in words])
    text[:, 1:][np.arange(longest + 3)[None, :] < size[:, None] - 2] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    text[np.arange(len(words)), size - 1] = 2
    first = text[:, :longest] * np.uint64(0x9E3779B97F4A7C15)
    slots, weights = [], []
    for j in range(1, 4):
        two = first + text[:, j:longest + j]
        two = (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        for k in range(j + 1, 5):
            h = two + text[:, k:longest + k]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            slots.append((h >> np.uint64(44)).astype(np.int32))
            weights.append(np.where(np.arange(longest)[None, :] + k < size[:, None], np.float32(DECAY ** (k - 2)), np.float32(0)))
    slots, weights = np.concatenate(slots, 1), np.concatenate(weights, 1)
    return slots, weights, np.sqrt(np.maximum((weights * weights).sum(1, dtype=np.float64), 1e-9))


def pieces(token: str) -> list[str]:
    """A cleaned token, in overlapping pieces if it is very long."""
    w = token if token.isalpha() else _JUNK.sub("", token)
    return [w] if len(w) <= WIDTH else [w[a:a + WIDTH] for a in range(0, len(w) - WIDTH // 2, WIDTH // 2)]


class Words:
    """The SVM's decision for words: one weight per triple."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.astype(np.float32), bias

    def score(self, found: list[str]) -> np.ndarray:
        parts = [pieces(t) for t in found]
        flat = [p for x in parts for p in x]
        out = np.empty(len(flat))
        order = np.argsort([len(p) for p in flat], kind="stable")  # words of one length together
        for a in range(0, len(flat), 2048):
            at = order[a:a + 2048]
            slots, weights, size = triples([flat[i] for i in at])
            out[at] = np.einsum("ij,ij->i", self.table[slots], weights) / size + self.bias
        return np.maximum.reduceat(out, np.cumsum([0, *map(len, parts)])[:-1]) if flat else out


class Model:
    def __init__(self, words: Words | None, weights: np.ndarray, prior: float):
        self.words, self.weights, self.prior, self.seen = words, weights, prior, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Highest and second highest word score, log of the number of clearly positive words."""
        return self.features_of([tokens(t) for t in texts])

    def features_of(self, sets: list[set[str]]) -> np.ndarray:
        if len(self.seen) > CACHE:
            self.seen = {}
        new = list(set().union(*sets).difference(self.seen)) if sets else []
        for a in range(0, len(new), 1 << 14):
            self.seen.update(zip(new[a:a + (1 << 14)], self.words.score(new[a:a + (1 << 14)]).tolist()))
        get, out = self.seen.__getitem__, np.empty((len(sets), 3))
        for i, s in enumerate(sets):
            v = list(map(get, s))
            best = heapq.nlargest(2, v) + [NOTHING, NOTHING]
            top = [min(max(x, NOTHING), 1.0) for x in best[:2]]
            out[i] = *top, math.log1p(sum(x > CLEAR for x in v) if best[0] > CLEAR else 0)
        return out

    def probability(self, texts: list[str | None]) -> np.ndarray:
        if self.words is None:
            return np.full(len(texts), self.prior)
        return sigmoid(self.features(texts) @ self.weights[:-1] + self.weights[-1])


# -- training --------------------------------------------------------------------------------------


class Sample:
    """Distinct tokens of texts as numbers of one list: 4 bytes for a token of a text."""

    def __init__(self, rows: Iterable[tuple[list[str], int]]):
        known: dict[str, int] = {}
        self.sets, labels = [], []
        for found, y in rows:
            self.sets.append(np.array([known.setdefault(t, len(known)) for t in found], np.int32))
            labels.append(y)
        self.labels, self.tokens = np.array(labels, np.int64), list(known)

    def __len__(self) -> int:
        return len(self.sets)


def _families(sample: Sample) -> list[int]:
    """Texts that copy each other, by their four smallest token hashes (two equal: one family)."""
    parent = list(range(len(sample)))
    hashes = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in sample.tokens], np.uint64)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict = {}
    for i, s in enumerate(sample.sets):
        if not len(s):
            continue
        low = [int(((hashes[s] * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min()) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
        for a in range(4):
            for b in range(a + 1, 4):
                j = first.setdefault((a, b, low[a], low[b]), i)
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sample))]


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    slots, weights, size = triples(landmarks)
    used, at = np.unique(slots[weights > 0], return_inverse=True)
    line = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    np.add.at(line, (at + 1, np.nonzero(weights > 0)[0]), (weights / size[:, None].astype(np.float32))[weights > 0])
    place = np.zeros(SLOTS, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    out = np.empty((len(words), len(landmarks)), np.float32)
    for a in range(0, len(words), 512):
        s, w, n = triples(words[a:a + 512])
        row = np.zeros((len(s), len(landmarks)), np.float32)
        at = place[s]
        for t in np.flatnonzero((at > 0).any(0) & (w > 0).any(0)):
            row += line[at[:, t]] * w[:, t, None]
        out[a:a + 512] = row / n[:, None]
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Linear SVM with squared hinge: Newton steps on the rows inside the margin."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        inside = y * (x @ w) < 1
        xi = x[inside]
        fresh = np.linalg.solve(penalty + (xi * cost[inside, None]).T @ xi, xi.T @ (cost[inside] * y[inside]))
        if np.allclose(fresh, w, atol=1e-6):
            break
        w = fresh
    return w


def _sure(counts: list[Counter], size: list[int], false: float = 0.1, lift: float = 12.0) -> dict[str, int]:
    """Words that mark toxic texts, with their number of toxic texts, most frequent first: at least
    ``lift`` times as frequent as in clean texts, and, among the words of as many texts, so often in
    toxic ones that at most the share ``false`` of those chosen would be there by chance."""
    n0, n1 = max(1, size[0]), max(1, size[1])
    q = n1 / (n0 + n1)
    by: dict[int, Counter] = {}
    for w in itertools.chain(counts[0], (w for w in counts[1] if w not in counts[0])):
        by.setdefault(counts[0][w] + counts[1][w], Counter())[counts[1][w]] += 1
    least: dict[int, int] = {}
    for d, seen in by.items():
        tail, above, least[d] = 0.0, 0, d + 1
        total = sum(seen.values())
        for a in range(d, 0, -1):
            tail += math.exp(math.lgamma(d + 1) - math.lgamma(a + 1) - math.lgamma(d - a + 1) + a * math.log(q) + (d - a) * math.log(max(1 - q, 1e-9)))
            above += seen[a]
            if total * tail > false * max(above, 1):
                break
            least[d] = a
    out = {w: a for w, a in counts[1].items()
           if a >= max(2, least[a + counts[0][w]]) and (a / n1) >= lift * counts[0][w] / n0}
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


def _likely(counts: list[Counter], size: list[int]) -> dict[str, float]:
    """Where no word is sure: all words more frequent in toxic than in clean texts, weighted by the
    number of toxic texts beyond the clean share, the heaviest first, equal ones by a hash."""
    out = {w: a - counts[0][w] * size[1] / max(1, size[0]) for w, a in counts[1].items()}
    return dict(sorted(((w, a) for w, a in out.items() if a > 0), key=lambda x: (-x[1], zlib.crc32(x[0].encode("utf-8", "surrogatepass")), x[0])))


def _variants(word: str, rng) -> list[str]:
    """A word with one letter put in, or one doubled, at a few places."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    at = rng.choice(np.arange(1, len(word)), min(4, len(word) - 1), replace=False) if len(word) > 3 else []
    return [word[:i] + (word[i] if n % 2 else letters[rng.integers(26)]) + word[i:] for n, i in enumerate(at)]


def _train_words(sure: dict[str, float], negative: list[str], clean: Counter, rng, noisy: bool = False) -> Words:
    """Nyström landmarks, whitened kernel features, SVM; two rounds of hard negatives. Words count
    by the texts they are in, the positive ones together as much as all negative ones. ``noisy``:
    most positive words mark nothing, so they count as they are, undisguised, with more landmarks."""
    positive = list(sure)[:4000 if noisy else 1000]
    weight = {w: float(sure[w]) for w in positive}
    known = set(negative)
    for w in [] if noisy else positive[:200]:  # disguised with an inserted letter
        near = [v for v in _variants(w, rng) if v not in known and v not in weight]
        weight |= {v: weight[w] / 4 for v in near}
    positive = list(weight)
    texts = np.array(list(weight.values()))
    some = [negative[i] for i in rng.permutation(len(negative))]
    chosen, words = some[:4000], None
    for _ in range(3):
        if words is not None:
            scores = np.concatenate([words.score(negative[a:a + 20_000]) for a in range(0, len(negative), 20_000)])
            hard = np.argsort(-scores)[:2000]
            chosen = list(dict.fromkeys([*chosen, *(negative[i] for i in hard)]))
            some = [negative[i] for i in hard[:64]] + some
        landmarks = list(dict.fromkeys([*positive[:512 if noisy else 128], *some[:128]]))
        value, vector = np.linalg.eigh(_kernel(landmarks, landmarks).astype(np.float64))
        use = value > 1e-4 * value.max()
        nystroem = vector[:, use] / np.sqrt(value[use])
        x = _kernel([*positive, *chosen], landmarks) @ nystroem
        y = np.array([1.0] * len(positive) + [-1.0] * len(chosen))
        against = np.array([min(clean[w], 20) for w in chosen], float)
        cost = (NOISY if noisy else 10.0) * np.concatenate([texts if noisy else against.sum() * texts / texts.sum(), against])
        w = _svm(x, y, cost)
        alpha = nystroem @ w[:-1]
        slots, weights, size = triples(landmarks)
        table = np.zeros(SLOTS)
        np.add.at(table, slots, weights * (alpha / size)[:, None])
        words = Words(table, float(w[-1]))
    return words


def train(rows: Iterable[tuple[list[str], int]], toxic_total: int, clean_total: int, seed: int = 7) -> Model:
    """``rows``: distinct tokens and labels of sampled texts; the totals are the labelled ids they stand for."""
    prior = toxic_total / max(1, toxic_total + clean_total)
    sample = Sample(rows)
    labels = sample.labels
    if not len(labels) or labels.min() == labels.max():
        return Model(None, np.zeros(4), prior)
    rng = np.random.default_rng(seed)
    family = np.array(_families(sample))
    fold = rng.permutation(len(labels))[family] % FOLDS  # a family is on one side
    x, done, tables = np.zeros((len(labels), 3)), np.zeros(len(labels), bool), []
    for k in range(FOLDS):
        words = _learn(sample, family, np.flatnonzero(fold != k), rng)
        if words is not None:
            own = np.flatnonzero(fold == k)
            x[own] = _scores(words, sample, own)
            done[own] = True
            tables.append(words)
    if not done.any() or labels[done].min() == labels[done].max():  # one kind is in one family: nothing to judge words by
        return Model(None, np.zeros(4), prior)
    weight = np.where(labels == 1, toxic_total / max(1, (labels == 1).sum()), clean_total / max(1, (labels == 0).sum()))[done]
    mean = Words(np.mean([w.table for w in tables], 0), float(np.mean([w.bias for w in tables])))
    return Model(mean, logistic(x[done], labels[done], weight / weight.mean(), ridge=0.2), prior)


def _scores(words: Words, sample: Sample, own: np.ndarray) -> np.ndarray:
    """Features of some texts of the sample."""
    out = np.empty((len(own), 3))
    for a in range(0, len(own), 256):
        model = Model(words, np.zeros(4), 0.0)
        out[a:a + 256] = model.features_of([{sample.tokens[t] for t in sample.sets[i]} for i in own[a:a + 256]])
    return out


def _learn(sample: Sample, family: np.ndarray, rows: np.ndarray, rng) -> Words | None:
    """Words from some of the rows; copies of a text count once."""
    counts, size, met = [Counter(), Counter()], [0, 0], set()
    for i in rows:
        y = int(sample.labels[i])
        if (family[i], y) in met:
            continue
        met.add((family[i], y))
        size[y] += 1
        counts[y].update({p for t in sample.sets[i] for p in pieces(sample.tokens[t]) if len(p) > 1})
    sure = _sure(counts, size)
    found = sure or _likely(counts, size)
    negative = sorted(w for w in counts[0] if w not in found)
    return _train_words(found, negative, counts[0], rng, noisy=not sure) if found and negative else None


# -- Spark -----------------------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_toxic: int = 2000, max_clean: int = 4000,
        max_bytes: int = 64 << 20) -> Model:
    """Train on at most ``max_toxic`` and ``max_clean`` labelled ids, the first by a hash of the id.

    ``rows``: which ids may be used. Rows without a label or id are left out; an id with several
    labels counts as toxic if one says so, an id with several texts by the smallest of them. Only
    distinct tokens come to the driver: at most ``max_bytes``, texts that do not fit are left out."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    own = (own if rows is None else own.where(rows)).groupBy(F.col(id_col).alias("l_id")).agg(F.max(F.col(label_col)).cast("int").alias("l"))
    totals = {r.l: r.n for r in own.groupBy("l").agg(F.count("l_id").alias("n")).collect()}
    first = [own.where(F.col("l") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    picked = F.broadcast(first[0].unionAll(first[1]))  # max_toxic + max_clean ids
    # one text an id: a repeated id is put together on the map side, before anything is shuffled
    texts = (docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("t")).join(picked, F.col("d_id") == F.col("l_id"))
             .groupBy("l_id").agg(F.min("t").alias("t"), F.max("l").alias("l")))
    return train(_bounded(_distinct_tokens(texts), max_bytes), totals.get(1, 0), totals.get(0, 0))


def _distinct_tokens(texts: DataFrame) -> DataFrame:
    """l, the distinct tokens (one a line) and their bytes, in the order of a hash of the id: texts
    are read whole, in tasks."""

    def run(batches):
        for b in batches:
            for a in range(b.num_rows):
                p = b.slice(a, 1)
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(2), pa.array(["\n".join(sorted(tokens(p.column(1)[0].as_py())))], pa.string())],
                                                 names=["l_id", "l", "words"])

    id_type = texts.schema["l_id"].dataType
    found = texts.select("l_id", "t", "l").mapInArrow(run, T.StructType([T.StructField("l_id", id_type), T.StructField("l", T.IntegerType()),
                                                                         T.StructField("words", T.StringType())]))
    return found.withColumn("size", F.octet_length("words")).orderBy(F.xxhash64("l_id"), "l_id").select("l", "words", "size")


def _bounded(sample: DataFrame, max_bytes: int):
    """Token sets and labels, one partition after the other, those that fit into ``max_bytes``."""
    left = max_bytes
    for r in sample.where(F.col("size") <= max_bytes).toLocalIterator():
        if r["size"] <= left:
            left -= r["size"]
            yield r["words"].split("\n") if r["words"] else [], r["l"]


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """All rows and columns of ``docs`` with ``score_col`` (double, 0 to 1; a column of that name is
    replaced). Null and empty texts get the score of a text without words; long texts are read whole;
    equal texts get equal scores; every row gets the prior without labels of both kinds,
    or if no word is more frequent in toxic than in clean texts, or no other word is in clean ones."""
    base = docs.select(*[c for c in docs.columns if c != score_col])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                p = b.slice(a, 256)
                found = sent.value.probability(p.column(p.schema.get_field_index(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array(found, pa.float64())], names=[*p.schema.names, score_col])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(score_col, T.DoubleType())]))
