"""Language identification of mixed texts.

A language is a distribution over the trigrams around letters (a letter with its neighbours, marks
that are no letter count as blanks), hashed to a fixed number of buckets. Training counts the buckets of all
labelled texts per language inside tasks and adds the counts up; the table of probabilities is bounded by
languages x buckets and broadcast. A text is a mixture: expectation-maximisation over its trigram
counts estimates the share of each language, and backward elimination keeps the set of languages
with the best penalised likelihood. Scoring is a map over the rows, many texts at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


CHUNK = 1 << 20  # characters that are looked at together
GROUP = 32  # texts whose mixtures are estimated together: they fit a core's cache
_U = np.uint64
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to its lower-cased letter, 0 for everything that is no letter."""
    if not _LETTERS:
        out = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _LETTERS.append(out)
    return _LETTERS[0]


def _trigrams(text: str, before: str, after: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (characters) of the letters of ``text`` and the buckets of their trigrams."""
    codes = np.frombuffer((before + text + after).encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _letters()[codes].astype(np.uint64)
    at = np.flatnonzero(x[1:-1])
    key = x[at] * _ODD[0] + x[at + 1] * _ODD[1] + x[at + 2] * _ODD[2]
    key = (key ^ (key >> _U(29))) * _ODD[0]
    return at, ((key >> _U(32)) % _U(buckets)).astype(np.int64)


def count_trigrams(texts: list[str | None], buckets: int):
    """Sparse counts: (text number, bucket, count) arrays, ordered. Long texts are read in chunks."""
    out = []
    a = 0
    while a < len(texts):
        size, b = 0, a
        while b < len(texts) and (b == a or size + len(texts[b] or "") <= CHUNK):
            size += len(texts[b] or "") + 1
            b += 1
        if size <= CHUNK + 1:
            group = [t or "" for t in texts[a:b]]
            at, bucket = _trigrams("\n".join(group), "\n", "\n", buckets)
            ends = np.cumsum([len(t) + 1 for t in group])
            key, n = np.unique(np.searchsorted(ends, at, side="right") * buckets + bucket, return_counts=True)
            out.append((key // buckets + a, key % buckets, n))
        else:  # one long text
            t, full = texts[a], np.zeros(buckets, np.int64)
            for s in range(0, len(t), CHUNK):
                _, bucket = _trigrams(t[s:s + CHUNK], t[s - 1] if s else "\n", t[s + CHUNK:s + CHUNK + 1] or "\n", buckets)
                full += np.bincount(bucket, minlength=buckets)
            used = np.flatnonzero(full)
            out.append((np.full(len(used), a), used, full[used]))
        a = b
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*out) if out else ([], [], []))]


@dataclass
class Model:
    languages: list[str]
    chances: np.ndarray  # languages x buckets: probability of a trigram's bucket
    penalty: float = 10.0
    steps: int = 30

    @property
    def buckets(self) -> int:
        return self.chances.shape[1]

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text and the shares of the languages in it (rows of zeros without letters)."""
        doc, bucket, n = count_trigrams(texts, self.buckets)
        letters = np.bincount(doc, n, minlength=len(texts)).astype(np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(letters)
        if len(some) and self.languages:
            number = np.cumsum(letters > 0) - 1
            out[some] = self._select(number[doc], self.chances[:, bucket], n.astype(float), letters[some].astype(float)).T
        return letters, out

    def _em(self, doc, p, n, total, pi):
        """EM steps on the shares (languages x texts); languages of share 0 stay out. Returns the shares
        and their log-likelihoods."""
        start = np.searchsorted(doc, np.arange(len(total)))
        for _ in range(self.steps):
            r = pi[:, doc]
            r *= p
            r *= n / r.sum(0)
            old, pi = pi, np.add.reduceat(r, start, axis=1) / total
            if np.abs(pi - old).max() < 1e-4:
                break
        return pi, np.add.reduceat(n * np.log((pi[:, doc] * p).sum(0)), start)

    def _select(self, doc, p, n, total):
        """Backward elimination: from the mixture of all languages, the one with the smallest share
        leaves while twice the loss of log-likelihood is below the penalty times log(letters)."""
        k = len(p)
        pi, fit = self._em(doc, p, n, total, np.full((k, len(total)), 1 / k))
        pi = np.where((pi * total < 1) & (pi < pi.max(0)), 0, pi)  # less than one letter's worth
        pi /= pi.sum(0)
        cost = self.penalty * np.log(total + 1)
        active = np.flatnonzero((pi > 0).sum(0) > 1)
        while len(active):
            place = np.full(len(total), -1)
            place[active] = np.arange(len(active))
            own = place[doc] >= 0
            least = np.where(pi[:, active] > 0, pi[:, active], np.inf)
            out = k - 1 - least[::-1].argmin(0)  # ties: the language that is later in order leaves
            trial = pi[:, active]
            trial[out, np.arange(len(active))] = 0
            trial, new = self._em(place[doc[own]], p[:, own], n[own], total[active], trial / trial.sum(0))
            ok = 2 * (fit[active] - new) < cost[active]
            pi[:, active[ok]], fit[active[ok]] = trial[:, ok], new[ok]
            active = active[ok]
            active = active[(pi[:, active] > 0).sum(0) > 1]
        return pi


def fit(docs: DataFrame, rows: Column | None = None, text_col: str = "text", lang_col: str = "lang",
        buckets: int = 1 << 16, smoothing: float = 0.1, **options) -> Model:
    """Count all rows with a language (and ``rows`` true) and make the table of probabilities.

    Texts without letters and null texts add nothing; a language counts as learned if one of its rows has a
    letter. No such row gives a model without languages. The table holds ``buckets`` doubles per language and is
    what the driver and each task hold: 0.5 MB a language (languages are a closed set of codes, 4 in the
    test tables). A task flushes its counts at 64 languages.
    """
    given = docs.where(F.coalesce(rows, F.lit(False))) if rows is not None else docs
    given = given.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")).where("lang is not null and t is not null")

    def flush(counts):
        for lang, c in counts.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(c[used])],
                                             names=["lang", "bucket", "n"])

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for a in range(0, b.num_rows, 256):
                langs = np.array(b.column(0).slice(a, 256).to_pylist(), object)
                doc, bucket, n = count_trigrams(b.column(1).slice(a, 256).to_pylist(), buckets)
                for lang in set(langs):
                    own = langs[doc] == lang if len(doc) else np.zeros(0, bool)
                    if own.any():
                        c = counts.setdefault(lang, np.zeros(buckets, np.int64))
                        c += np.bincount(bucket[own], n[own], minlength=buckets).astype(np.int64)
                if len(counts) > 64:
                    yield from flush(counts)
                    counts = {}
        yield from flush(counts)

    t = given.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(t.column("lang").to_pylist()))
    number = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), buckets))
    counts[np.array([number[x] for x in t.column("lang").to_pylist()], int), t.column("bucket").to_numpy()] = t.column("n").to_numpy()
    counts += smoothing
    return Model(languages, counts / counts.sum(1, keepdims=True), **options)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred``, ``score`` and ``languages`` (replacing columns of these
    names). ``languages`` lists the selected set as (lang, share), largest share first (ties by
    name); ``lang_pred`` is its first and ``score`` that one's share, 0 to 1. Null texts, texts
    without a letter and models without languages give ``und``, 0.0 and an empty list.
    """
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                          T.StructField("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])))])
    kept = [f for f in docs.schema.fields if f.name not in added.names or f.name == text_col]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                texts = b.column(len(names)).to_pylist()
                shares = np.concatenate([m.shares(texts[i:i + GROUP])[1] for i in range(0, len(texts), GROUP)])
                order = np.argsort(-shares, axis=1, kind="stable")
                sets = [[{"lang": m.languages[j], "share": float(s[j])} for j in o if s[j] > 0] for o, s in zip(order, shares)]
                best = pa.array([x[0]["lang"] if x else "und" for x in sets], pa.string())
                score = pa.array([min(1.0, x[0]["share"]) if x else 0.0 for x in sets], pa.float64())
                lists = pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
                yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], best, score, lists], names=[*names, *added.names])

    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("__text"))
    out = given.mapInArrow(run, T.StructType([*kept, *added.fields]))
    return out if text_col not in added.names else out.drop(text_col)
