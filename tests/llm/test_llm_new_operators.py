"""Whitening, language mixtures and the prefix trie against plain versions, and their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundscope.llm import eigen, langid, prefixes, whitening
from fundscope.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 40])
def test_eigenpairs(n):
    r = np.random.default_rng(n)
    q, _ = np.linalg.qr(r.standard_normal((n, n)))
    for values in (np.arange(n, 0, -1.0), np.ones(n), np.repeat([7.0, 7, 3, 0], n)[:n], 1e25 * np.arange(n, 0, -1.0) ** 3):
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        k = min(8, n)
        found, axes = eigen.leading(a, k)
        top = np.sort(values)[::-1][:k]
        assert np.abs(found - top).max() < 1e-13 * top[0]
        assert np.abs(axes @ axes.T - np.eye(k)).max() < 1e-14
        assert np.abs(a @ axes.T - axes.T * found).max() < 1e-13 * top[0]
    assert eigen.leading(np.zeros((3, 3)), 2)[0].tolist() == [0, 0]


def test_whitening_equals_plain_version(spark):
    got = Q.queries()["op11_whitening"](spark, SMALL).toPandas()
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in r.embedding] for r in rows], object)
    n, s = len(x), x.sum(0)
    deviation = {r.vec_id: int(((n * v - s) ** 2).sum()) for r, v in zip(rows, x)}
    y = np.array(x - s / n, float)
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 8 * n and set(got.n) == {n}
    assert all(deviation[i] == d for i, d in zip(got.vec_id, got.deviation))
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r.vec_id for r in rows]].to_numpy()
    want = y @ u[:, :8] / np.sqrt(e[:8])
    assert np.abs(np.abs((w * want).sum(0)) / n - 1).max() < 1e-10  # either sign
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-8
    explained = got.groupby("component").explained.first().to_numpy()
    assert np.abs(explained / (e[:8] / e.sum()) - 1).max() < 1e-10
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_whitening_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [3.0, 1.0], 0), (None, [0.5, 0.25], None), (3, None, 0), (4, [1.0, None], 0),
            (5, [nan, 1.0], 0), (6, [1.0, -inf], 0), (7, [3.0], 1), (8, [], 1), (9, [3e30, 0.0], 1)]
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "'x' component", "1 n", "'y' whitened", "1 deviation")
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(2 * ["1", "1", "2", "None", "7", "8"])
    x = np.floor(1024 * np.array([[1, 2], [1, 2], [3, 1], [0.5, 0.25], [3, 0], [0, 0]])) + 100_000
    d = ((6 * x - x.sum(0)) ** 2).sum(1).astype(int)
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(i, v) for i, v in zip([1, 1, 2, None, 7, 8], d)}
    assert abs(sum(r.explained for r in got) / 6 - 1) < 1e-12 and all(r.n == 6 and r.identity_error < 1e-12 for r in got)
    # equal vectors: one direction has no variance
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(5)], VEC)).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: r.component)] == [False] * 5 + [True] * 5
    assert {r.explained for r in flat} == {1.0, 0.0} and all(r.identity_error < 1e-12 for r in flat)
    alone = whitening.whiten(spark.createDataFrame([(1, [1.0, 1.0], 0)], VEC)).collect()
    assert [(r.whitened, r.deviation, r.identity_error) for r in alone] == [(None, 0, None)] * 2
    for none in ([], [(1, None, 0)], [(1, [], 0)]):
        assert whitening.whiten(spark.createDataFrame(none, VEC)).collect() == []
    # sums beyond a long stay exact; beyond 38 digits they are null
    big = spark.createDataFrame([("a", [1e9, 5.0]), ("b", [-1e9, 7.0]), ("c", [2.0**50, 0.0])], "vec_id string, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(big).collect()}
    x = [[1024 * 10**9 + 100_000, 105_120], [-1024 * 10**9 + 100_000, 107_168], [2**60 + 100_000, 100_000]]
    s = [sum(c) for c in zip(*x)]
    assert got == {i: Decimal(sum((3 * v - t) ** 2 for v, t in zip(row, s))) for i, row in zip("abc", x)}
    assert max(got.values()) > 2**63


def plain_mixture(counts, chances, steps=30):
    k, total = chances.shape[0], sum(counts.values())
    pi = np.full(k, 1 / k)
    for _ in range(steps):
        r = np.zeros(k)
        for b, n in counts.items():
            q = pi * chances[:, b]
            r += n * q / q.sum()
        pi = r / total
    return pi


def test_language_mixtures_equal_plain_em(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "es", "fr"] and np.allclose(model.chances.sum(1), 1)
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    doc, bucket, n = langid.count_trigrams(texts, model.buckets)
    text = texts[3].lower()
    letters = [c if c.isalpha() else " " for c in f" {text} "]
    seen = defaultdict(int)
    for i in range(1, len(letters) - 1):
        if letters[i] != " ":
            seen["".join(letters[i - 1:i + 2])] += 1
    assert sorted(n[doc == 3]) == sorted(seen.values())  # trigrams as written (no two share a bucket here)
    model.steps, start = 30, np.full((4, len(texts)), 0.25)
    total = np.bincount(doc, n)
    pi, _ = model._em(doc, model.chances[:, bucket], n.astype(float), total, start)
    for i in range(len(texts)):
        want = plain_mixture(dict(zip(bucket[doc == i], n[doc == i])), model.chances)
        assert np.abs(pi[:, i] - want).max() < 5e-3  # the library stops once shares stand still


def test_language_sets_of_mixed_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    one = {r.lang: r.text[:3000] for r in docs.where("length(text) > 3000").collect()}
    mixed = one["de"][:1500] + "\n" + one["fr"][:1500]
    three = one["en"][:1000] + "\n" + one["es"][:1000] + "\n" + one["fr"][:1000]
    _, shares = model.shares([mixed, three, one["es"], one["es"] * 500])
    found = [{x for x, s in zip(model.languages, row) if s > 0} for row in shares]
    assert found == [{"de", "fr"}, {"en", "es", "fr"}, {"es"}, {"es"}]
    assert abs(shares[0][0] - 0.5) < 0.05 and np.abs(shares[1][1:] - 1 / 3).max() < 0.05


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.queries()["op12_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert ((got.doc_id.astype(str).map(lambda s: zlib.crc32(s.encode()) % 5) == 0) == got.held_out).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "xx"), (5, "12 % -", "yy"), (6, "the " * 400_000, None),
            (None, "und der hund", "de"), (7, "I", "en"), (7, "I", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'old' lang_pred", "7 score", "1 languages", "2 bucket", "3 n")
    model = langid.fit(df)
    assert model.languages == ["de", "en"]
    out = langid.identify(df, model)
    assert sorted(out.columns) == sorted(df.columns)
    by = {(r.doc_id, r.text): r for r in out.collect()}
    assert [by[k].lang_pred for k in [(1, rows[0][1]), (2, rows[1][1]), (3, None), (4, ""), (5, "12 % -"), (6, rows[5][1]), (None, "und der hund"), (7, "I")]] == [
        "en", "de", "und", "und", "und", "en", "de", "en"]
    assert [by[k].score for k in [(3, None), (4, ""), (5, "12 % -")]] == [0, 0, 0] and out.count() == len(rows)
    none = df.limit(0)
    empty = langid.fit(none)
    assert empty.languages == [] and langid.identify(none, model).collect() == []
    assert {(r.lang_pred, r.score) for r in langid.identify(df, empty).collect()} == {("und", 0.0)}
    # a long text in chunks counts as the whole
    text = "".join(random.Random(1).choice("abc déf.\n") for _ in range(3000))
    whole = langid.count_trigrams([text, "x"], 1 << 12)
    old, langid.CHUNK = langid.CHUNK, 701
    try:
        parts = langid.count_trigrams([text, "x"], 1 << 12)
    finally:
        langid.CHUNK = old
    assert all((a == b).all() for a, b in zip(whole, parts))


def plain_trie(convs, every=None, heads=None):
    """convs: id to list of (role, text). Rows as the operator returns them."""
    if every:
        convs = {c: convs.get(c - c % every, [])[:heads(c)] + t[heads(c):] for c, t in convs.items()}
    members = defaultdict(list)
    for c, t in sorted(convs.items()):
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        words = len(p[-1][1].split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, df.collect()))


def test_prefix_trie_equals_plain_version(spark):
    """Small shards and bands: long conversations, common first turns, copies, a third of all rows in one."""
    r = random.Random(4)
    convs = {}
    for c in range(150):
        base = convs[r.randrange(c)] if c and r.random() < 0.6 else []
        convs[c * 3 + 1] = base = list(base[:r.randrange(len(base) + 1)])
        base += [(r.choice("ua"), " ".join(r.choice("xyz") for _ in range(r.randrange(4)))) for _ in range(r.choice([0, 1, 2, 5, 9]))]
        convs[c] = base
    convs[500] = [("u", str(i % 7)) for i in range(900)]
    convs[501] = convs[500][:400] + [("a", "z w")] * 300
    convs = {c: t for c, t in convs.items() if t}
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert found(prefixes.prefix_trie(df, shard_rows=40, band=4)) == plain_trie(convs)
    heads = lambda c: zlib.crc32(str(c).encode()) % 4
    column = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    want = plain_trie(convs, 20, heads)
    assert found(prefixes.prefix_trie(df, share_every=20, heads=column, shard_rows=40, band=4)) == want
    assert found(prefixes.prefix_trie(df, share_every=20, heads=column)) == want
    assert any(w[1] == 0 and w[7] != hashlib.sha256(b"").hexdigest() for w in want)  # some end at the root


def test_conversation_over_several_partitions(spark):
    """One conversation larger than a range partition is numbered across tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).selectExpr("if(id < 3000, 5, id) conv_id", "id turn", "'u' role", "cast(id as string) text").repartition(6)
        got = prefixes.prefix_trie(df, shard_rows=100, band=64)
        assert got.where("conv_id = 5").agg(F.max("depth")).first()[0] == 3000
        assert got.count() == 4001 and got.where("depth = 0").select("n_convs", "n_children", "n_leaves").first() == (1001, 1001, 1001)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_trie_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 2, "a", "b c"), (1, None, "u", None), (1, 2, "a", "b c"), (2, 0, None, None), (2, 1, "", ""), (None, 0, "u", "lost"),
            (3, 0, "u", ""), (3, 1, "a", "b c"), (-4, 0, "ua", ""), (-4, 1, "u", "a" * 100_000)]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 conv", "2 pos", "3 n", "4 depth", "'x' shard")
    want = plain_trie({1: [("u", ""), ("a", "b c"), ("a", "b c")], 2: [("", ""), ("", "")], 3: [("u", ""), ("a", "b c")], -4: [("ua", ""), ("u", "a" * 100_000)]})
    assert found(prefixes.prefix_trie(df)) == want
    assert prefixes.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 0, "u", "x")], schema)).collect() == []
