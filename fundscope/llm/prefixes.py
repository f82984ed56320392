"""Prefix trie of conversations by vertical bitmaps.

1. Turns become narrow rows: conversation, 16-byte digest of (role, text), words. One range sort by
   conversation and turn numbers them; a conversation that spans several partitions continues where
   the one before ended (one line per partition is exchanged), so no conversation needs one task.
   The same pass cuts the order into shards of about ``shard_rows`` rows: ranges of conversations.
2. Inside a shard and a band of ``band`` positions, every (position, turn) has a bitset of the shard's
   conversations, and every position one of those that end there. A walk, depth first, intersects
   the bitset of a node with the posting of the turn that its lowest member says next: each
   intersection is a child, its population count the members, its intersection with the ends the
   members that stop there. A node is named by the exclusive or of 128-bit hashes of its
   (position, turn) pairs, which starts a band without the bands before it.
3. Nodes of different shards with one name are added up. The lists of ends stay in pieces per shard, in
   rising order of conversations, and are digested as a stream.
4. Each node belongs to its smallest member, so the trie is a set of chains, one per conversation.
   Sums over subtrees are suffix sums along chains plus what the chains hanging off them send; a round
   passes totals up by one chain, so rounds are as many as branchings above one another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundscope.llm.common import WORD, store


def _digest() -> Column:
    """16 bytes that stand for (role, text); the length keeps the two apart."""
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def _numbered(turns: DataFrame, shard_rows: int, name: str) -> DataFrame:
    """(conv, pos, shard, tok, words): positions from 0 by turn (null first), ties by digest."""
    def run(batches):
        last, place, shard, rows = None, 0, 0, 0
        for b in batches:
            conv = b.column(0).to_numpy()
            pos, shards = np.empty(len(conv), np.int64), np.empty(len(conv), np.int64)
            heads = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if len(conv) else []
            for start, end in zip(heads, [*heads[1:], len(conv)]):
                if last is None or conv[start] != last:
                    last, place = conv[start], 0
                    if rows >= shard_rows:  # a shard ends where a conversation does
                        shard, rows = shard + 1, 0
                pos[start:end] = np.arange(place, place + end - start)
                shards[start:end] = shard
                place, rows = place + end - start, rows + end - start
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pos), b.column(1), pa.array(shards), b.column(2), b.column(3)],
                                             names=["conv", "pos", "part", "shard", "tok", "words"])

    ordered = turns.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "tok").sortWithinPartitions(
        "conv", F.col("turn").asc_nulls_first(), "tok")
    local = store(ordered.select("conv", F.spark_partition_id().alias("part"), "tok", "words")
                  .mapInArrow(run, "conv long, pos long, part int, shard long, tok binary, words long"), f"{name}-turns")
    # conversations that go on in the next partition: at most one starts and one ends in each
    sizes = local.groupBy("conv", "part").agg(F.count("pos").alias("n"))
    split = sizes.join(sizes.groupBy("conv").agg(F.count("part").alias("parts")).where("parts > 1"), "conv")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = split.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("ahead"))
    out = local.join(ahead, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    return out.select("conv", (F.col("pos") + F.coalesce("ahead", F.lit(0))).alias("pos"),
                      (F.col("part").cast("long") * F.lit(1 << 32) + F.col("shard")).alias("shard"), "tok", "words")


def _walk(band: int):
    """Nodes of one shard and band. Rows: conv, len, pos, tok, words, h1, h2, s1, s2 (name so far)."""
    def run(key, t):
        start = key[1].as_py() * band
        t = t.sort_by([("conv", "ascending"), ("pos", "ascending")])
        conv, length = t.column("conv").to_numpy(), t.column("len").to_numpy()
        pos, words = t.column("pos").to_numpy() - start, t.column("words").to_numpy()
        names = np.stack([t.column("h1").to_numpy(), t.column("h2").to_numpy()]).view(np.uint64).T
        starts = np.stack([t.column("s1").to_numpy(), t.column("s2").to_numpy()]).view(np.uint64).T
        tok = t.column("tok").to_pylist()
        heads = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        ids, lens = conv[heads].tolist(), (length[heads] - start).tolist()
        posting: dict[tuple, int] = {}
        line: list[list[int]] = [[] for _ in ids]  # rows of each conversation in this band
        member = np.cumsum(np.isin(np.arange(len(conv)), heads)) - 1
        for r, (m, p, w) in enumerate(zip(member.tolist(), pos.tolist(), tok)):
            posting[p, w] = posting.get((p, w), 0) | 1 << m
            line[m].append(r)
        ends: dict[int, int] = {}
        for m, n in enumerate(lens):
            ends[n] = ends.get(n, 0) | 1 << m
        groups: dict[tuple, int] = {}
        for m, r in enumerate(heads.tolist()):
            at = (int(starts[r, 0]), int(starts[r, 1]))
            groups[at] = groups.get(at, 0) | 1 << m
        out: list[list] = [[] for _ in range(8)]
        pieces: list[list] = [[] for _ in range(4)]
        stack = [(bits, 0, at) for at, bits in groups.items()]
        while stack:
            bits, p, at = stack.pop()
            rest = bits & ~ends.get(p, 0) if p else bits
            while rest and p < band:
                m = (rest & -rest).bit_length() - 1
                r = line[m][p]
                child = rest & posting[p, tok[r]]
                rest &= ~child
                name = (at[0] ^ int(names[r, 0]), at[1] ^ int(names[r, 1]))
                for column, v in zip(out, (*name, *at, start + p + 1, ids[m], child.bit_count(), int(words[r]))):
                    column.append(v)
                stop = child & ends.get(p + 1, 0)
                if stop:
                    _pieces(pieces, name, key[0].as_py(), ids, stop)
                if child != stop:
                    stack.append((child, p + 1, name))
        return _node_table(out, pieces)
    return run


def _pieces(pieces: list[list], name: tuple, shard: int, ids: list, bits: int) -> None:
    members = np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")).tolist()
    for column, v in zip(pieces, (*name, shard, ",".join(str(ids[m]) for m in members))):
        column.append(v)


NODE = "h1 long, h2 long, p1 long, p2 long, depth long, conv long, n long, words long, shard long, ends string"


def _node_table(out: list[list], pieces: list[list]) -> pa.Table:
    """Node lines, and lines that hold a piece of a node's list of ends."""
    n, m = len(out[0]), len(pieces[0])
    signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
    whole = lambda v: pa.array(np.array(v, np.int64))
    none = lambda k: pa.nulls(k, pa.int64())
    columns = [signed(out[i] + pieces[i]) for i in (0, 1)]
    columns += [pa.concat_arrays([signed(out[i]), none(m)]) for i in (2, 3)]
    columns += [pa.concat_arrays([whole(out[i]), none(m)]) for i in (4, 5, 6, 7)]
    columns += [pa.concat_arrays([none(n), whole(pieces[2])]), pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(pieces[3], pa.string())])]
    return pa.table(columns, names=[c.split()[0] for c in NODE.split(", ")])


def _hashed(batches):
    """SHA-256 of the pieces of each name in their order, joined by commas: rows stream through."""
    own, sha = None, None
    for b in batches:
        out: list[tuple] = []
        for h1, h2, text in zip(*(c.to_pylist() for c in b.columns)):
            if (h1, h2) != own:
                if own is not None:
                    out.append((*own, sha.hexdigest()))
                own, sha = (h1, h2), hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["h1", "h2", "sha"])
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*own, sha.hexdigest())], names=["h1", "h2", "sha"])


def _rebuilt(rows: DataFrame, convs: DataFrame, heads: Column) -> tuple[DataFrame, DataFrame]:
    """Rows after the exchange of heads, and the new lengths: the first h turns come from the base.
    ``convs``: conv, shard, n, base, n_base (turns of the base, null: none)."""
    given = F.least(heads, F.coalesce("n_base", F.lit(0)))
    plan = convs.select("conv", "shard", heads.alias("h"), given.alias("given"), "base",
                        (given + F.greatest(F.col("n") - heads, F.lit(0))).alias("len"))
    own = rows.select(F.col("conv").alias("c"), "pos", "tok", "words").join(plan, F.col("c") == F.col("conv")).where("pos >= h").select(
        "conv", "shard", "len", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "tok", "words")
    lent = rows.where(F.col("pos") < 3).select(F.col("conv").alias("b"), "pos", "tok", "words").join(
        plan, F.col("b") == F.col("base")).where("pos < given").select("conv", "shard", "len", "pos", "tok", "words")
    return own.unionAll(lent), plan.select("conv", "shard", "len")


def _suffix_sums(nodes: DataFrame, values: list[str], block: int = 4096) -> DataFrame:
    """Sums of ``values`` over the nodes of the same chain at this depth or deeper; long chains in blocks."""
    rows = nodes.withColumn("__b", F.floor(F.col("depth") / F.lit(block)))
    later = Window.partitionBy("conv").orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "__b").agg(*[F.sum(v).alias(v) for v in values])
    blocks = blocks.select(F.col("conv").alias("__c"), F.col("__b").alias("__k"), *[F.coalesce(F.sum(v).over(later), F.lit(0)).alias(f"__{v}") for v in values])
    within = Window.partitionBy("conv", "__b").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(blocks, (F.col("conv") == F.col("__c")) & (F.col("__b") == F.col("__k"))).withColumns(
        {v: F.sum(v).over(within) + F.col(f"__{v}") for v in values}).drop("__b", "__c", "__k", *[f"__{v}" for v in values])


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", share_every: int | None = None, heads: Column | None = None,
                shard_rows: int = 8192, band: int = 64) -> DataFrame:
    """One row per distinct prefix (node) of the conversations, all long but the hash: ``conv_id``
    (smallest member), ``depth`` (root: 0), ``parent_conv_id`` (root: null), ``n_convs``, ``n_children``,
    ``n_leaves`` (nodes without children in the subtree), ``saved_tokens`` (over the subtree: members but one,
    times words of the last turn) and ``ends_sha256`` (of the ids, rising, comma-joined, of conversations that
    end here; none: the empty string's).

    Ids must be whole numbers; rows without one take no part. Turns are ordered by ``turn_col`` (null
    first; equal ones by the digest of role and text, so repeated rows are repeated turns); null role or text is empty. With
    ``share_every`` and ``heads`` (a column over ``conv``, 0 to 3) each conversation takes that many first turns from
    the conversation ``conv - conv % share_every`` (as many as it has) before its own turns after them; one
    without turns left ends at the root. An empty table gives no rows. Other columns are ignored.
    A task holds the turns of about ``shard_rows`` rows within ``band`` positions.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role, text).where("conv is not null")
    turns = turns.select("conv", "turn", _digest().alias("tok"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    rows = store(_numbered(turns, shard_rows, "trie"), "trie-rows")
    convs = rows.groupBy("conv").agg(F.min("shard").alias("shard"), F.count("pos").alias("n"))
    if share_every:
        convs = store(convs, "trie-convs")
        base = convs.select(F.col("conv").alias("__base"), F.col("n").alias("n_base"))
        convs = convs.withColumn("base", F.col("conv") - F.col("conv") % F.lit(share_every)).join(base, F.col("base") == F.col("__base"), "left")
        rows, lengths = _rebuilt(rows, convs, heads)
    else:
        lengths = convs.select("conv", "shard", F.col("n").alias("len"))
        rows = rows.drop("shard").join(lengths, "conv")
    rows = store(rows.select("conv", "shard", "len", "pos", "tok", "words", F.floor(F.col("pos") / F.lit(band)).alias("band"),
                             F.xxhash64(F.lit(1), "pos", "tok").alias("h1"), F.xxhash64(F.lit(2), "tok", "pos").alias("h2")), "trie-rebuilt")
    lengths = store(lengths, "trie-lengths")

    # what names the nodes at the start of each band: only conversations longer than one band have any
    bands = rows.where(F.col("len") > band).groupBy("conv", "band").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    upto = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = bands.select(F.col("conv").alias("c"), F.col("band").alias("b"), F.bit_xor("h1").over(upto).alias("s1"), F.bit_xor("h2").over(upto).alias("s2"))
    zero = F.lit(0).cast("long")
    short = rows.where(F.col("band") == 0).withColumns({"s1": zero, "s2": zero})
    long = rows.where(F.col("band") > 0).join(starts, (F.col("conv") == F.col("c")) & (F.col("band") == F.col("b"))).drop("c", "b")
    found = store(short.unionByName(long).groupBy("shard", "band").applyInArrow(_walk(band), NODE), "trie-nodes")

    # the root: all conversations; those without turns end there
    top = lengths.agg(F.min("conv").alias("conv"), F.count("conv").alias("n")).where("n > 0").select(
        zero.alias("h1"), zero.alias("h2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("depth"), "conv", "n", zero.alias("words"))
    nodes = found.where("depth is not null").groupBy("h1", "h2").agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), F.min("conv").alias("conv"),
        F.sum("n").alias("n"), F.first("words").alias("words")).unionByName(top)
    nodes = store(nodes, "trie-merged")
    empty = lengths.where("len = 0").select(zero.alias("h1"), zero.alias("h2"), F.lit(0).cast("long").alias("shard"), "conv", F.col("conv").cast("string").alias("ends"))
    ends = found.where("ends is not null").select("h1", "h2", "shard", zero.alias("conv"), "ends").unionByName(empty)
    ends = (ends.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "shard", "conv").select("h1", "h2", "ends")
            .mapInArrow(_hashed, "h1 long, h2 long, sha string"))

    kids = nodes.where("p1 is not null").groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("conv").alias("n_children"))
    nodes = nodes.join(kids, ["h1", "h2"], "left").join(ends, ["h1", "h2"], "left")
    # tops of chains: nodes whose parent belongs to a smaller conversation
    nodes = store(nodes.select("*", F.coalesce("n_children", zero).alias("kids"), (F.col("n") - 1).alias("spare")), "trie-counted")
    tops = nodes.groupBy("conv").agg(F.min(F.struct("depth", "p1", "p2")).alias("t")).select(
        F.col("conv").alias("chain"), F.col("t.depth").alias("top"), F.col("t.p1").alias("p1"), F.col("t.p2").alias("p2"))
    owner = nodes.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("conv").alias("to"))
    tops = store(tops.join(owner, (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")), "left").select(
        "chain", "top", "to", (F.col("top") - 1).alias("at")), "trie-chains")

    own = nodes.select("conv", "depth", F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves"), (F.col("spare") * F.col("words")).alias("saved"))
    totals = own.groupBy("conv").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sent = None
    while True:  # each round: totals go to the chain above, and are passed on from there
        wave = store(totals.join(tops, F.col("conv") == F.col("chain")).where("to is not null").groupBy("to", "at").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-wave")
        if not wave.limit(1).count():
            break
        got = wave.select(F.col("to").alias("conv"), F.col("at").alias("depth"), "leaves", "saved")
        sent = got if sent is None else sent.unionAll(got)
        totals = got.groupBy("conv").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    everything = own if sent is None else own.unionAll(sent).groupBy("conv", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sums = _suffix_sums(everything, ["leaves", "saved"]).select(F.col("conv").alias("c"), F.col("depth").alias("d"), "leaves", "saved")
    above = tops.select("chain", "top", "to")
    out = nodes.join(sums, (F.col("conv") == F.col("c")) & (F.col("depth") == F.col("d"))).join(above, F.col("conv") == F.col("chain"))
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("top"), F.col("to")).otherwise(F.col("conv"))
    return out.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"),
                      F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("sha", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
