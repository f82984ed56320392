"""Every opN query against its SQL, or against a plain Python version where SQL can't say it."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from fundscope.llm import queries as Q
from fundscope.llm import toxicity

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    return sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    df = Q.queries()[name](spark, SMALL)
    cur = duck.execute(Q.SQL[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want and want


def test_all_are_registered():
    names = Q.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_entry_adds_them():
    import __spark_entry__ as entry

    assert set(Q.queries()) | {"pipeline"} <= set(entry.queries())
    assert set(Q.SQL) <= set(entry.oracle_sql())


def brute_repeats(texts: list[bytes], length: int):
    starts = defaultdict(int)
    for t in texts:
        for p in range(len(t) - length + 1):
            starts[t[p:p + length]] += 1
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if starts[t[p:p + length]] > 1:
                hit[p:p + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(hit))]
        out.append((spans, bytes(c for c, h in zip(t, hit) if not h)))
    return out


def test_repeats_equal_brute_force(spark, duck):
    docs = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    texts = [t.encode() for _, t in docs]
    want = {i: (len(t), sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest())
            for (i, _), t, (s, k) in zip(docs, texts, brute_repeats(texts, 200))}
    got = {r[0]: tuple(r[1:]) for r in Q.queries()["op10_repeats"](spark, SMALL).collect()}
    assert got == want and any(v[1] for v in want.values())


def brute_personal(text: str):
    def luhn(s):
        d = [int(c) for c in s][::-1]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda s: max(map(int, s.split("."))) <= 255),
             ("card", r"[0-9](?:[ -]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
             ("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m.group())]


def test_personal_data_base_equals_brute_force(spark, duck):
    got = {r.doc_id: r for r in Q.queries()["op9_personal_data"](spark, SMALL).collect()}
    seen = Counter()
    for i, text in duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        spans = brute_personal(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        n = Counter(k for k, _, _ in spans)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k in ("email", "ip", "card", "phone"))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))
        seen += n
    assert all(seen[k] for k in ("email", "ip", "card", "phone"))


def test_toxicity_on_held_out_rows(spark):
    """Trained on four fifths of the labelled rows, judged on the rest, at a size with enough labels."""
    sf = "/root/testdata/sf0.1"
    got = Q.queries()["op6_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert ((got.doc_id.astype(str).map(lambda s: zlib.crc32(s.encode()) % 5) == 0) == got.held_out).all()
    test = got[got.held_out]
    assert (test.predicted == test.toxic).mean() > 0.97
    rank = test.score.rank()
    n1, n0 = (test.toxic == 1).sum(), (test.toxic == 0).sum()
    assert (rank[test.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.9
    assert (test[test.toxic == 0].predicted == 1).mean() < 0.01
    assert got.score.between(0, 1).all()


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(sets, percent):
    """Smallest position linked to each position, by comparing all pairs."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(sets))]


def windows(words, n=10):
    m = min(n, len(words))
    return {tuple(words[i:i + m]) for i in range(len(words) - m + 1)} if m else set()


def test_pipeline_equals_plain_version(spark, duck):
    rows = duck.execute("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id").fetchall()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = [r for r, p in zip(rows, model.probability([r[1] for r in rows])) if p < 0.5]
    sets = [shingles(r[1], 5) for r in rows]
    rows = [r for i, (r, g) in enumerate(zip(rows, groups(sets, 80))) if g == i]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    marks = set().union(*(windows(words(t)) for _, t in duck.execute("SELECT * FROM benchmark").fetchall()))
    sizes = {len(m) for m in marks}
    rows = [r for r in rows if not any(tuple(w[i:i + n]) in marks for w in [words(r[1])] for n in sizes for i in range(len(w) - n + 1))]

    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    names = sorted({r[3] for r in rows})
    own = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, left, open_ = {}, sum(own.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * own[s]}
        target |= {s: 3.0 * own[s] for s in full} if full else share
        left, open_ = left - sum(3 * own[s] for s in full), open_ - full if full else set()

    got = corpus_pipeline.run(spark, SMALL).collect()
    kept = {r[0]: r for r in rows}
    times = Counter(r.doc_id for r in got)
    assert all(tuple(r[:5]) == kept[r.doc_id] for r in got)
    for s in names:  # whole repetitions, then rows in seeded order that fit into the rest, then the row that fits best
        digest = lambda i: hashlib.md5(f"mix\x01={i}\x01={hashlib.md5(kept[i][1].encode()).hexdigest()}".encode()).hexdigest()
        mine = sorted((digest(i), i) for i, r in kept.items() if r[3] == s)
        whole = min(3, int(target[s] // own[s])) if own[s] else 0
        rest, want = target[s] - whole * own[s], {}
        for h, i in mine:
            fits = 0 < size[i] <= rest
            rest -= size[i] if fits else 0
            want[i] = whole + fits
        out = [(h, i) for h, i in mine if want[i] == whole and size[i]]
        took = [(h, i) for h, i in mine if want[i] > whole]
        ways = [(abs(size[i] - rest), 0, size[i], 0, h, "", i, None) for h, i in out]
        ways += [(abs(size[i] - size[j] - rest), 1, size[i], size[j], h, g, i, j) for h, i in out for g, j in took if size[j] < size[i]]
        if ways and min(ways)[0] < rest:
            *_, i, j = min(ways)
            want[i] += 1
            if j is not None:
                want[j] -= 1
        assert {i: times[i] for _, i in mine} == want
    for r in got:
        u = lambda n: (int(hashlib.md5(f"rendezvous:{n}:={r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert r.shard == max(range(40), key=u)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert np.mean([r.shard for r in got]) > 0
