"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from fundscope.llm import chat, decontaminate, graph, minhash, mixing, pii, repeats, sharding, topk, toxicity, warc
from test_llm_queries import brute_repeats, groups, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["size", "target", "taken", "shard", "slot", "n", "node", "rid", "id", "t", "kept", "cut", "cell", "repeat_spans",
         "kept_bytes", "hit_spans", "hit_items", "n_words", "toxicity", "pii_spans", "repeats", "source_size", "l", "g", "b", "whole"]


def words(n, seed, size=40):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(120, 1)
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail", None, None, None),
            (4, None, "en", "a", 0), (5, "", "en", "b", 0), (6, " \t\n", "en", "b", 3), (7, "one", "en", None, 3), (8, "ONE", "en", "b", 3),
            (None, base + " tail", None, "b", None), (None, None, None, None, None), (9, words(60_000, 2), "en", "c", 1), (10, "é ü 😀 " * 80, "fr", "c", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_near_duplicates(docs, none):
    got = sorted(minhash.near_duplicates(docs, shingle=3, percent=85).collect(), key=str)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 13
    assert {i: by[i][0].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9}
    assert [r.n_shingles for i in (4, 5, 6, 7) for r in by[i]] == [0, 0, 0, 1]
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in by[None])[-1] == (119, 1, False)
    assert minhash.near_duplicates(none).collect() == []
    kept = minhash.drop_near_duplicates(docs, shingle=3, percent=85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9, 10]


def test_near_duplicates_keep_every_row_without_words(spark):
    rows = [(1, None, "a"), (1, None, "b"), (1, "", "a"), (1, "", "a"), (None, None, "a"), (None, None, "c"), (None, " \t", "a"), (None, " \t", "b"),
            (2, "one two", "a"), (2, "one two", "a"), (3, "one two", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = minhash.drop_near_duplicates(df, shingle=3, percent=85).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, rows[:9]))


def test_near_duplicates_equal_all_pairs(spark):
    """Groups of copies with growing edits: links at the threshold, several components per bucket."""
    r = random.Random(5)
    texts = []
    for g in range(12):
        base = words(r.choice([6, 30, 90]), g).split()
        for _ in range(25):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                t[r.randrange(len(t))] = "".join(r.choice("klmnop") for _ in range(3))
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    for k, percent in ((3, 85), (5, 80)):
        want = groups([shingles(t, k) for t in texts], percent)
        got = {x.doc_id: x.component_id for x in minhash.near_duplicates(df, shingle=k, percent=percent, block=16).collect()}
        assert [got[i] for i in range(len(texts))] == want
        assert len(set(want)) < len(want) - 50


def test_signature_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(3)
    whole = r.integers(0, 2**63, 3000, dtype=np.uint64)
    for shared in (500, 1000, 1800):
        a, b = whole[:2000], np.concatenate([whole[:shared], whole[2000:]])
        true = shared / len(set(a.tolist()) | set(b.tolist()))
        sig = minhash.pack(minhash.signatures([a, b]))
        assert abs(minhash.estimate(sig[0], sig[1]) - true) < 0.2


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 200), (200, 200)]
    r.shuffle(edges)
    got = {x.node: x.comp for x in graph.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "test").collect() == []


def test_components_of_long_paths_take_few_steps(spark, monkeypatch):
    """The links of one task are rooted there, so a path is not walked by rounds of stored tables; links
    of many tasks and nodes that are linked only with themselves give the same components."""
    stored = []
    monkeypatch.setattr(graph, "store", lambda df, name, put=graph.store: (stored.append(name), put(df, name))[1])
    r = random.Random(2)
    order = r.sample(range(600), 600)
    edges = [(order[i], order[i + 1]) for i in range(599) if i % 300 != 299] + [(2000, 2000)]
    want = {x: min(order[i:i + 300]) for i in range(0, 600, 300) for x in order[i:i + 300]} | {2000: 2000}
    r.shuffle(edges)
    links = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {x.node: x.comp for x in graph.components(links, "test").collect()} == want
    assert len(stored) <= 2
    thinned = graph.thin(links, "test").collect()
    assert sorted((x.a, x.b) for x in thinned) == sorted((x, y) for x, y in want.items() if x != y)
    stored.clear()
    assert {x.node: x.comp for x in graph.components(links, "test", at_once=150).collect()} == want
    assert len(stored) <= 24
    copies = spark.createDataFrame(edges * 8, "a long, b long")
    assert {x.node: x.comp for x in graph.components(copies, "test", at_once=700).collect()} == want
    named = links.select(*[F.unhex(F.md5(F.col(c).cast("string"))).alias(c) for c in ("a", "b")])
    got = {}
    for x in graph.components(named, "test").collect():
        got.setdefault(bytes(x.comp), set()).add(bytes(x.node))
    assert sorted(map(len, got.values())) == [1] + [300] * 2 and all(k == min(v) for k, v in got.items())


def test_sharding(spark, docs, none):
    out = sharding.assign_shards(docs, ["doc_id"], 5)
    assert set(out.columns) == set(docs.columns)
    rows = out.collect()
    assert len({r.shard for r in rows if r.doc_id == 2}) == 1 and len({r.shard for r in rows if r.doc_id is None}) == 1
    grown = {r.doc_id: r.shard for r in sharding.assign_shards(docs, ["doc_id"], 6).collect()}
    assert all(grown[r.doc_id] in (r.shard, 5) for r in rows)
    slots = sharding.number_slots(out, ["doc_id"]).collect()
    for s in {r.shard for r in slots}:
        assert sorted(r.slot for r in slots if r.shard == s) == list(range(sum(r.shard == s for r in slots)))
    assert sharding.number_slots(sharding.assign_shards(none, ["doc_id"], 5), ["doc_id"]).collect() == []
    many = spark.range(20_000)
    share = {r.shard: r["count"] / 20_000 for r in sharding.assign_shards(many, ["id"], {1: 1.0, 2: 3.0, 3: 0.0}).groupBy("shard").count().collect()}
    assert set(share) == {1, 2} and abs(share[2] - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.assign_shards(many, ["id"], {})


def test_write_shards(spark, docs, scratch):
    sharding.write_shards(sharding.assign_shards(docs.select("doc_id", "text"), ["doc_id"], 3), f"{scratch}/s")
    assert spark.read.parquet(f"{scratch}/s").count() == docs.count()


def test_mixing(spark, docs, none):
    out = mixing.mix(docs, ["doc_id"]).collect()
    assert len(out) == 13 and all(0 <= r.repeats <= 3 for r in out)
    assert {r.source: r.target for r in out if r.source == "a"} and all(r.size == 0 for r in out if not (r.text or "").strip())
    assert mixing.mix(none, ["doc_id"]).collect() == []
    only_null = spark.createDataFrame([(1, None, "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.repeats) for r in mixing.mix(only_null, ["doc_id"]).collect()] == [(0, 0.0, 0)] * 2
    mixed = mixing.mix(docs, ["doc_id"])
    copies = mixing.mixed_rows(docs, ["doc_id"])
    assert copies.columns == docs.columns and copies.count() == sum(r.repeats for r in mixed.collect())
    assert {r.size for r in copies.collect()} == {"x"}


def test_water_filling_clamps_and_reshares(spark):
    s = spark.createDataFrame([("a", 10, 3), ("b", 100, 1), ("c", 1000, 1), ("d", 0, 2)], "source string, size long, weight long")
    got = {r.source: r.target for r in mixing.water_fill(s, 3).collect()}
    assert got["a"] == 30.0 and got["b"] == 300.0 and got["d"] == 0.0 and abs(got["c"] - 780.0) < 1e-9


def test_mixing_meets_targets(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice([1, 5, 40, 300])), r.choice("aaab")) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"])
    for x in out.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("repeats")).alias("taken")).collect():
        assert abs(x.taken - x.target) <= 1 + 0.001 * x.target


def test_decontamination(spark, docs, none):
    item = words(12, 77)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "Zebra ZEBRA"), (4, "zz")], "item_id long, text string")
    more = spark.createDataFrame([(20, f"x {item.upper()}, y"), (21, "zebra, zebra! zebra"), (22, item.rsplit(" ", 3)[0]), (23, "zz zz"), (24, None)], "doc_id long, text string")
    for size in (4 << 20, 20):  # one slice, and one for almost every item
        got = {r.doc_id: r for r in decontaminate.find_windows(more, bench, slice_bytes=size).collect()}
        assert [(s.start, s.end) for s in got[20].hit_spans] == [(1, 13)] and got[20].hit_items == ["1"] and got[20].n_words == 14
        assert [(s.start, s.end) for s in got[21].hit_spans] == [(0, 3)] and got[21].hit_items == ["null"]
        assert got[22].hit_items == [] and got[24].n_words == 0
        assert [(s.start, s.end) for s in got[23].hit_spans] == [(0, 2)] and got[23].hit_items == ["4"]
    assert decontaminate.find_windows(docs, bench.limit(0)).count() == 13
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.n_words for r in clean.collect()} == {"x"}
    assert decontaminate.find_windows(none, bench).collect() == []


def test_warc(spark, scratch):
    html = "<p>é \r\n\r\n WARC/1.1</p>"
    rows = [(1, "http://a\r\nX: 1", html), (2, None, html), (3, "u", None), (4, "u", ""), (None, "u", html), (5, "v", "x" * 300_000), (2, None, html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2))
    warc.write_pages(pages.repartition(3), f"file://{scratch}/w")
    got = warc.read_warc(spark, f"file://{scratch}/w").collect()
    assert len(got) == 7
    by = {(warc_id(r.record_id), r.record_type): r for r in got}
    assert bytes(by["2", "response"].payload) == html.encode() and by["2", "response"].target_uri is None
    assert warc_id(by["1", "revisit"].refers_to) == "2" and by["1", "revisit"].payload_length == len(html.encode())
    assert by["", "revisit"].refers_to == "<urn:page:2>" and by["3", "revisit"].refers_to == "<urn:page:4>"
    assert bytes(by["4", "response"].payload) == b"" and len(by["5", "response"].payload) == 300_000
    assert by["1", "revisit"].target_uri == "http://a%0D%0AX: 1"
    narrow = warc.read_warc(spark, f"file://{scratch}/w", payload="response").where("record_type = 'revisit' and target_uri like 'http%'")
    assert [r.payload for r in narrow.collect()] == [None]
    assert "PushedFilters: []" not in narrow._jdf.queryExecution().toString()
    warc.write_pages(pages.limit(0), f"file://{scratch}/none")
    assert warc.read_warc(spark, f"file://{scratch}/none").collect() == []


def warc_id(urn):
    return urn.removeprefix("<urn:page:").removesuffix(">")


def test_warc_of_other_writers(spark, scratch):
    import gzip
    import os

    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <x:%d>\r\nContent-Type: text/plain\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    bodies = [b"", b"one\r\n\r\ntwo", b"z" * 70_000]
    os.makedirs(f"{scratch}/f")
    with open(f"{scratch}/f/a.warc", "wb") as f, open(f"{scratch}/f/b.warc.gz", "wb") as g:
        for i, b in enumerate(bodies):
            f.write(record % (i, len(b), b))
            g.write(gzip.compress(record % (10 + i, len(b), b)))
    for payload in ("all", "none"):
        got = {r.record_id: r for r in warc.read_warc(spark, f"file://{scratch}/f", payload).collect()}
        assert len(got) == 6 and all(got[f"<x:{i + j}>"].content_length == len(b) for i, b in enumerate(bodies) for j in (0, 10))
        if payload == "all":
            assert all(bytes(got[f"<x:{i + j}>"].payload) == b for i, b in enumerate(bodies) for j in (0, 10))


def test_toxicity(spark, docs, none):
    r = random.Random(8)
    clean = [words(30, 100 + i) for i in range(150)]
    rude = [f"{words(12, 900 + i)} {r.choice(['klmnop', 'qrstuv'])} {words(12, 2000 + i)}" for i in range(90)]
    texts = spark.createDataFrame(list(enumerate([*clean, *rude, None, ""])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(150)] + [(150 + i, 1) for i in range(90)] + [(240, 0), (241, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(texts, labels)
    new = ["klmnop abc", "klmmnop abc", "abc k-l-m-n-o-p", "q r s t u v abc", "abcde fghij", "", None, "QRSTUV!", "z" * 5000, "klmnop " + words(20_000, 4)]
    p = model.probability(new)
    assert (p[[0, 1, 2, 3, 7, 9]] >= 0.5).all() and (p[[4, 5, 6, 8]] < 0.5).all()
    out = toxicity.score(docs, model)
    assert out.count() == 13 and set(out.columns) == set(docs.columns)
    assert all(0 <= x.toxicity <= 1 for x in out.select("toxicity").collect())
    assert toxicity.score(none, model).collect() == []
    unlabelled = toxicity.fit(texts, labels.limit(0))
    assert unlabelled.probability(["a", None]).tolist() == [0.0, 0.0]


def test_toxicity_repeated_ids_are_one_row_of_the_sample(spark, monkeypatch):
    """A labelled id in a third of all rows: one text of it comes to the driver, within the bytes."""
    rows = [(i, words(30, i)) for i in range(40)] + [(7, words(30, 1000 + i)) for i in range(20)] + [(8, None)] * 5
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, *totals: seen.append((list(rows), totals)))
    toxicity.fit(texts, labels)
    toxicity.fit(texts, labels, max_bytes=1000)
    (whole, totals), (some, _) = seen
    assert len(whole) == 40 and totals == (10, 30) and sum(y for _, y in whole) == 10
    own = min(t for i, t in rows if i == 7)
    assert sorted(set(own.split())) in [x for x, _ in whole]
    assert 0 < sum(len("\n".join(x)) for x, _ in some) <= 1000


def test_toxicity_sample_is_held_as_numbers():
    """The sample of 2000 toxic and 4000 clean texts: four bytes for a token of a text."""
    import inspect

    bounds = inspect.signature(toxicity.fit).parameters
    assert (bounds["max_toxic"].default, bounds["max_clean"].default) == (2000, 4000)
    sample = toxicity.Sample((words(50, i % 7).split(), i % 2) for i in range(100))
    assert len(sample) == 100 and sample.labels.sum() == 50
    assert all(s.nbytes == 4 * 50 and [sample.tokens[t] for t in s] == words(50, i % 7).split() for i, s in enumerate(sample.sets))


def test_toxicity_with_ten_toxic_labels(spark, scratch):
    """Every insult stands in one training text: no word is sure, and the planted text still goes."""
    rude = ["klmnopq", "kllmnopq", "klmnnopq", "klmnopqs", "klmnoppq", "xklmnopq", "klmnopqq", "klmmnopq", "klmnopqer", "klmnoopq"]
    rows = [(i, words(30, i)) for i in range(80)] + [(500 + i, f"{words(12, 500 + i)} {w} {words(12, 800 + i)}") for i, w in enumerate(rude)]
    planted = [(900 + i, f"{words(12, 3000 + i)} klmnopq {words(12, 4000 + i)}") for i in range(5)]
    texts = spark.createDataFrame(rows + planted, "doc_id long, text string")
    spark.createDataFrame([(i, int(i >= 500)) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{scratch}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, texts, scratch).collect()}
    assert not kept & {i for i, _ in planted} and kept >= set(range(80))


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "\\[\\INST]\\", "[TURN][\\TURN]", "<", "[", "", None, "é😀", "[ROLE]x[/ROLE]", "<<SYS>> </s", "a\nb"]
    roles = ["user", "assistant", "assistant", "system", "tool", "[ROLE]", None, "user", "assistant", "assistant", "user"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, said))] + [(2, 1, "user", "b"), (2, 1, "assistant", "a"), (2, None, "user", "n"), (2, 1, "user", "b"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("t", F.lit(2))
    out = chat.format_chats(df)
    assert out.columns == ["conv_id", "formatted", "loss_spans"]
    got = {r.conv_id: r for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l"), "formatted").collect()}
    assert [(x.role, x.text) for x in got[1].t] == [(r or "", t or "") for r, t in zip(roles, said)]
    assert got[1].l == "".join(t or "" for r, t in zip(roles, said) if r == "assistant")
    assert [(x.role, x.text) for x in got[2].t] == [("user", "n"), ("assistant", "a"), ("user", "b"), ("user", "b")]
    assert [x.text for x in got[None].t] == ["x"]
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chat_many_turns(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
                                  F.concat(F.lit("t"), F.col("id")).alias("text"))
    r = chat.format_chats(df).select(F.size(chat.read_back(F.col("formatted"))).alias("n"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert r.n == 3000 and r.l == "".join(f"t{i}" for i in range(3000) if i % 3)


def test_chat_spans_across_chunks(spark):
    """Long runs of one role, and of single turns, around the borders of the chunks that lists are handled in."""
    c = chat.CHUNK
    for n, role in ((c - 1, "x"), (c, "x"), (c + 1, "x"), (2 * c + 3, "x"), (2 * c + 3, "xy"), (4 * c, "xxy")):
        names = {"x": "assistant", "y": "user"}
        turns = [(1, i, names[role[i % len(role)]], "é" * (i % 5) + f"{i}</s>") for i in range(n)]
        df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
        r = chat.format_chats(df).select("formatted", "loss_spans", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
        said = [x[3] for x in turns if x[2] == "assistant"]
        assert r.l == "".join(said)
        assert [r.formatted[s.start:s.start + s.length] for s in r.loss_spans] == [x.replace("</s>", "<\\/s>") for x in said]


def test_toxicity_kernel_equals_enumerated_subsequences():
    """The sparse product over triple slots against the sum over all pairs of equal subsequences."""

    def brute(word):
        w, out = f"\1{word}\2", Counter()
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i <= 4:  # at most two other characters in between
                out[(w[i], w[j], w[k])] += toxicity.DECAY ** (k - i - 2)
        return out

    def occurrences(word):
        w = f"\1{word}\2"
        return sum(toxicity.DECAY ** (2 * (k - i - 2)) for i, j, k in itertools.combinations(range(len(w)), 3) if k - i <= 4)

    words = ["a", "id", "idiot", "idxiot", "idiots", "banana", "moron", "äöü", "x" * 24, "stupid"]
    got = toxicity._kernel(words, words)
    for a, x in enumerate(words):
        for b, y in enumerate(words):
            fx, fy = brute(x), brute(y)
            want = sum(v * fy.get(s, 0) for s, v in fx.items()) / math.sqrt(occurrences(x) * occurrences(y))
            assert abs(float(got[a, b]) - want) < 1e-4 * max(1, want), (x, y)
    assert got[2, 3] > 0.4 > got[2, 6]  # an inserted letter leaves most of the insult, another word little


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (9, []), (10, [0.1]), (None, [9.0, 9.0]), (200, [nan, 0.0]), (11, [-0.0001, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 1048576), (0, 2, 100, 1048576), (0, 3, 3, 524288), (100, 1, 0, 1048576), (100, 2, 5, 1048576), (100, 3, 3, 524288)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert topk.top_k(df, F.col("vec_id") == -1).collect() == []
    assert len(topk.top_k(df, F.col("vec_id") == 0, k=50).collect()) == 6


def test_topk_equals_brute_force_in_small_blocks(spark):
    import numpy as np

    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8)) * 3
    x = (centres[r.integers(0, 6, 900)] + r.normal(size=(900, 8)) * 0.2).astype(np.float32)
    x[300:600] = x[300]  # a third of the rows share a vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=4, pivots=7, query_block=8, data_block=50).collect()
    want = []
    for i in range(0, 900, 10):
        s = q @ q[i]
        best = sorted((j for j in range(900) if j != i), key=lambda j: (-s[j], j))[:4]
        want += [(i, n + 1, j, int(s[j])) for n, j in enumerate(best)]
    assert sorted(tuple(r) for r in got) == want


def test_personal_data(spark, docs, none):
    text = "😀 Mail a.b@c.example.com, card 4111 1111 1111 1111; ip 300.1.1.1 and 10.0.0.1. Call +1 (555) 123-4567."
    at = lambda kind, part: (kind, text.index(part), text.index(part) + len(part))
    assert pii.base_spans(text) == [at("email", "a.b@c.example.com"), at("ip", "10.0.0.1"), at("card", "4111 1111 1111 1111"), at("phone", "+1 (555) 123-4567")]
    assert pii.base_spans(None) == [] and pii.base_spans("4111 1111 1111 1112") == []
    out = pii.find_personal_data(docs)
    assert out.count() == 13 and set(out.columns) == set(docs.columns)
    assert pii.find_personal_data(none).collect() == []
    many = [(i, f"{words(5, i)} call +1 ({200 + i}) 555-{1000 + i} {words(3, i)} 10.{i % 200}.7.9") for i in range(200)]
    many += [(1000, "call +1 (222) 555-1234 4111111111111111 x")]  # run together: no base phone, no base card
    df = spark.createDataFrame(many, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.pii_spans] for r in pii.find_personal_data(df).collect()}
    assert all(any(k == "phone" and b for k, _, _, b in got[i]) for i in range(200))
    assert ("phone", 5, 22, False) in got[1000]
    masked = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert "555-" not in masked[0] and "[phone]" in masked[0] and "[ip]" in masked[0]


def test_repeats(spark, docs, none):
    r = random.Random(6)
    passage, far = words(70, 50), words(60, 51)
    texts = [words(20, 60) + passage + words(30, 61), passage, "a" * 450, "ab" * 150, far + " x " + far, None, "", "short", words(50, 62),
             words(50, 62), words(40, 63) + passage[:199], passage[5:] + "é" * 120, "é" * 100, words(60_000, 64), words(60_000, 64)[1000:9000]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[8])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).select("*", *[F.lit("x").alias(c) for c in CLASH])
    want = brute_repeats([(t or "").encode() for _, t in rows], 200)
    want = sorted(repr((i, s, k if t is not None else None)) for (i, t), (s, k) in zip(rows, want))
    out = repeats.remove_repeats(df, bucket_bytes=2000)
    got = sorted(repr((x.doc_id, [(s.start, s.end) for s in x.repeat_spans], None if x.kept_bytes is None else bytes(x.kept_bytes))) for x in out.collect())
    assert got == want and set(out.columns) == set(df.columns)
    assert repeats.remove_repeats(none).collect() == []
    assert repeats.remove_repeats(docs).count() == 13


def test_repeats_in_crowds(spark, monkeypatch):
    """A passage in many texts: the stretches at its edges are too many for one bucket."""
    monkeypatch.setattr(repeats, "CROWD", 4)
    passage = words(60, 70)
    texts = [words(25, 300 + i) + " " + passage + " " + words(25, 600 + i) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_repeats([t.encode() for t in texts], 200)
    got = {x.doc_id: [(s.start, s.end) for s in x.repeat_spans] for x in repeats.remove_repeats(df).collect()}
    assert [got[i] for i in range(40)] == [s for s, _ in want] and all(got.values())


def test_run_length_index():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(60):
        n = int(r.integers(4, 90))
        t = r.integers(1, 4, n).astype(np.int16)
        t[r.integers(0, n, 3)] = 0
        t[-1] = 0

        def common(i, j):
            k = 0
            while max(i, j) + k < n and t[i + k] == t[j + k]:
                k += 1
            return k

        index = repeats.RunLengthIndex(t)
        assert index.matching_statistics().tolist() == [max(common(i, j) for j in range(n) if j != i) for i in range(n)]
        assert index.run_lengths.sum() == n




@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages(spark, docs, none, name):
    """Every stage on the awkward rows, on no rows, and without labels or benchmark rows in its way."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert set(docs.columns) <= set(out.columns)
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None} and rows
    if name in ("toxicity", "near_duplicates", "decontamination"):
        assert {4, 5, 9} <= {r.doc_id for r in rows}
    if name != "sharding":
        assert out.columns == docs.columns and {r.size for r in rows} == {"x"}
    assert stage(spark, none, "/root/testdata/sf0.001").collect() == []


def test_links_grow_with_classes(spark, monkeypatch):
    """Twice the near copies of one text give twice the links that enter the components, not four times."""
    seen = []
    monkeypatch.setattr(minhash, "components", lambda links, name: (seen.append(links.count()), graph.components(links, name))[1])
    counts = []
    for m in (300, 600):
        r = random.Random(1)
        base = words(60, 3).split()
        rows = []
        for i in range(m):
            t = list(base)
            t[r.randrange(60)] = f"w{i}"
            rows.append((i, " ".join(t)))
        seen.clear()
        out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85, block=64)
        assert out.where("kept").count() < m / 4
        counts.append(max(seen))
    assert counts[1] <= 2.2 * counts[0] and counts[1] <= 2 * 600


def test_mixing_meets_targets_beside_long_rows_and_null_ids(spark):
    """One document larger than the target, and rows without ids: neither blocks the others."""
    rows = [(1, words(20_000, 1), "a")] + [(i, words(20, i), "a") for i in range(2, 900)] + [(None, words(15, i), "b") for i in range(4000)]
    rows += [(None, None, "b"), (None, "", "c"), (5000, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, ["doc_id"], weights=(1, 10, 1), max_epochs=3)
    by = {r.source: r for r in got.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("taken"), F.first("target").alias("target"),
                                                         F.max("repeats").alias("top")).collect()}
    assert all(abs(by[s].taken - by[s].target) <= 20 for s in "ab") and 5000 < by["a"].target < 17_000
    assert by["c"].target == 0 and by["c"].taken == 0 and max(r.top for r in by.values()) <= 3
    assert 0 < got.where("doc_id is null and source = 'b' and repeats = 2").count() < 4000


def test_topk_scores_beyond_31_and_63_bits(spark):
    schema = "vec_id long, embedding array<double>"
    top = lambda rows, k=3: [(r.query_id, r.rank, r.vec_id, int(r.score)) for r in topk.top_k(
        spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0, k=k).orderBy("query_id", "rank").collect()]
    assert top([(100, [1.0]), (1, [3e6]), (2, [4e6])]) == [(100, 1, 2, 4096000000 * 1024), (100, 2, 1, 3072000000 * 1024)]
    big = top([(100, [2e6] * 3), (1, [2e6] * 3), (2, [1.0] * 3), (3, [-2e6] * 3)])
    assert [r[2] for r in big] == [1, 2, 3] and big[0][3] == 3 * 2048000000**2 == -big[2][3]
    r = random.Random(3)
    rows = [(i, [r.choice([1.0, 1e3, 1e8]) * r.uniform(-1, 1) for _ in range(8)]) for i in range(300)] + [(7, [2.0**55] * 8), (8, [1e30] * 8)]
    x = [(i, [int(1024 * v // 1) for v in e]) for i, e in rows if max(map(abs, e)) < 2.0**52 or i != 8]
    want = []
    for q, v in x:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in x if i != q and max(map(abs, w)) < 2**62)[:10]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(top([p for p in rows if p != rows[-1]], 10)) == sorted(want) and top(rows, 10) == sorted(want)


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
         ("card", r"[0-9](?:[ -]?[0-9])+"), ("phone", r"\+[0-9][ ().0-9-]+[0-9]")]


def test_personal_data_scans_equal_the_plain_patterns():
    import re

    r = random.Random(8)
    for alphabet in ("a1@.", "1.2 -+", "ab.@-1 %+()0", "0123456789. +-", "a@.b-\n"):
        for _ in range(3000):
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 40)))
            for kind, plain in PLAIN:
                assert pii._matches(kind, text) == [m.span() for m in re.finditer(plain, text)], (kind, text)


def test_personal_data_takes_linear_time():
    import time

    for unit in ("a", "7", "a.", "1.", "x@", "7 ", "a@b", "+1 ", "1.1.1 ", " at x"):
        text = unit * (1_000_000 // len(unit)) + " me@example.org 10.0.0.1"
        start = time.perf_counter()
        found = pii.base_spans(text)
        pii.candidates(text[:200_000])
        assert time.perf_counter() - start < 20, unit
        assert any(k == "email" for k, _, _ in found)


def test_personal_data_recall_and_precision_of_added_spans(spark):
    """Loose forms planted beside base forms and beside numbers that are none."""
    r = random.Random(11)
    name = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    num = lambda n: "".join(r.choice("123456789") for _ in range(n))

    def card(sep):
        while True:
            d = "4" + num(15)
            if pii.luhn(d):
                return sep.join(d[i:i + 4] for i in range(0, 16, 4))

    ip = lambda sep: sep.join(str(r.randrange(20, 255)) for _ in range(4))
    made, rows = {}, []
    for i in range(600):
        loose = {"email": f"{name()} (at) {name()} (dot) com", "ip": ip("[.]"), "card": card("."), "phone": f"({num(3)}) {num(3)}-{num(4)}"}
        base = {"email": f"{name()}@{name()}.org", "ip": ip("."), "card": card(" "), "phone": f"+1 ({num(3)}) {num(3)}-{num(4)}"}
        k = r.choice(list(loose))
        lead = {"email": "mail", "ip": "server", "card": "card", "phone": "call"}[k]
        given = (loose if i % 2 else base)[k]
        text = f"{words(8, i)} {lead} {given} {words(5, i + 9000)} version {num(2)}.{num(1)} order {num(7)}"
        made[i] = (k, text.index(given), text.index(given) + len(given), bool(i % 2))
        rows.append((i, text))
    got = {x.doc_id: x.pii_spans for x in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = [(i, s.kind, s.start, s.end) for i, spans in got.items() for s in spans if not s.base]
    planted = {(i, k, s, e) for i, (k, s, e, loose) in made.items() if loose}
    print("recall", len(planted & set(added)) / len(planted), "precision", len(planted & set(added)) / max(1, len(added)))
    assert len(planted & set(added)) >= 0.9 * len(planted) and len(planted & set(added)) >= 0.9 * len(added)
