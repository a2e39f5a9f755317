"""Prefix trie of rebuilt conversations by composable fingerprints.

A turn is a map x -> a x + b modulo a prime, twice, with (a, b) from hashes of its role
and text.  Maps compose associatively and have inverses, so the fingerprint of a rebuilt
prefix is put together symbolically, base head · (skipped own head)^-1 · own prefix, from
products that are computed once over the stored turns; no rebuilt text is ever written.
Running products come from ``scan.running``, so a conversation with most of all turns is
spread over tasks like any other rows.

Rows with equal (depth, fingerprint) are a node.  Equality is verified by induction over
the stored turns: all members of a node have one parent fingerprint and one turn hash,
and all turns with one hash have the role and text of the first of them, which are
compared as text.  If any comparison fails, everything starts again with other hashes.

Sums over subtrees need no walk by depth.  The nodes whose smallest member is c form one
chain downwards, and every descendant of a node lies on the chain of one of the node's members.
So a subtree's sum is the sum of its members' chain totals, less what the node's own chain
has above the node.

Defined results: rows without conv_id take no part; turns are ordered by turn (null
first), then by the SHA-256 of role, a zero byte and text; null role and text are empty;
repeated rows are turns of their own; a conversation whose base is absent keeps what it
has after its head, perhaps no turn; an empty table gives no nodes; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .scan import Monoid, running, sums

PRIME = (1 << 31) - 1
HALF = 31
#: The map x -> x.
SAME = 1 << HALF
#: Ids that one row of the digest's input holds.
IDS = 4096
#: Most turns that a conversation takes from its base.
MAX_HEAD = 3
#: (seed, bits) of the turn hashes, tried in this order.
HASHES = ((1, 64), (2, 64), (3, 64))


# -- maps a x + b modulo PRIME, packed as a * 2**31 + b; x then y is x(y) ------------------

def compose_ints(x: int, y: int) -> int:
    a, b = x >> HALF, x & PRIME
    return (a * (y >> HALF) % PRIME) << HALF | (a * (y & PRIME) + b) % PRIME


def compose(x: Column, y: Column) -> Column:
    a, b = F.shiftright(x, HALF), x.bitwiseAND(F.lit(PRIME).cast("long"))
    c, d = F.shiftright(y, HALF), y.bitwiseAND(F.lit(PRIME).cast("long"))
    return F.shiftleft((a * c) % PRIME, HALF) + (a * d + b) % PRIME


def inverse(x: np.ndarray) -> np.ndarray:
    """The inverse maps (a has an inverse, a ** (PRIME - 2))."""
    a, b = x >> HALF, x & PRIME
    r = np.ones_like(a)
    for bit in bin(PRIME - 2)[2:]:
        r = r * r % PRIME
        if bit == "1":
            r = r * a % PRIME
    return r << HALF | (PRIME - r * b % PRIME) % PRIME


def compose_arrays(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = x >> HALF, x & PRIME
    return (a * (y >> HALF) % PRIME) << HALF | (a * (y & PRIME) + b) % PRIME


def _as_map(h: Column) -> Column:
    low = h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) % F.lit(PRIME - 1) + 1
    return F.shiftleft(low, HALF) + F.shiftrightunsigned(h, 32) % F.lit(PRIME)


#: (turns, map, map) of a run of turns.
PREFIX = Monoid((0, SAME, SAME),
                lambda x, y: (x[0] + y[0], compose_ints(x[1], y[1]), compose_ints(x[2], y[2])),
                lambda x, y: [x[0] + y[0], compose(x[1], y[1]), compose(x[2], y[2])])


def stored_turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(ref, conv, turn, tie, role, text, words)``, written once; ``ref`` names a turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        text(role_col).alias("role"), text(text_col).alias("text"))
    return stage(rows.select(
        F.monotonically_increasing_id().alias("ref"), "conv", "turn",
        F.sha2(F.concat("role", F.lit("\0"), "text"), 256).alias("tie"), "role", "text",
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")), "trie-turns")


def hashed(turns: DataFrame, seed: int, bits: int) -> DataFrame:
    drop = 64 - bits
    cut = lambda h: F.shiftrightunsigned(h, drop) if drop else h
    return turns.withColumns({"t1": cut(F.xxhash64(F.lit(seed), "role", "text")),
                              "t2": cut(F.xxhash64(F.lit(-seed), "text", "role"))})


def equal_turns(turns: DataFrame) -> bool:
    """Whether turns with equal hashes have equal role and text, compared with the
    first turn of the hash."""
    again = turns.groupBy("t1", "t2").agg(F.min("ref").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    some = stage(turns.join(again, ["t1", "t2"]).select("t1", "t2", "ref", "first", "role", "text"), "trie-again")
    first = some.where("ref = first").select("t1", "t2", F.col("role").alias("r"), F.col("text").alias("t"))
    return some.where("ref <> first").join(first, ["t1", "t2"]).where("role <> r OR text <> t").isEmpty()


def _heads(placed: DataFrame) -> DataFrame:
    """Per conversation the number of turns and, of its first three, hashes, words and prefix products."""
    cols = ("m1", "m2", "t1", "t2", "words")
    return placed.groupBy("conv").agg(
        (F.max("pos") + 1).alias("n"),
        *[F.max(F.when(F.col("pos") == j, F.col(c))).alias(f"{c}_{j}") for j in range(MAX_HEAD) for c in cols])


def _left_factor(names: list[str]):
    """Per conversation: base head · (own head)^-1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = {c: b.column(b.schema.get_field_index(c)).to_numpy() for c in ("head1", "head2", "skip1", "skip2")}
            made = [compose_arrays(x[f"head{i}"], inverse(x[f"skip{i}"])) for i in (1, 2)]
            yield pa.record_batch([*b.columns, *[pa.array(m, pa.int64()) for m in made]], names=[*names, "left1", "left2"])
    return run


def plans(placed: DataFrame, head: Column, base: Column) -> DataFrame:
    """One row per conversation: head lengths, rebuilt length, the factor that turns its
    own prefix products into rebuilt ones, and the turns of its base's head."""
    own = stage(_heads(placed), "trie-heads")
    there = own.withColumnsRenamed({c: f"b_{c}" for c in own.columns})
    v = own.withColumns({"h": head.cast("long"), "base": base}).join(there, F.col("base") == F.col("b_conv"), "left")
    v = v.withColumn("hb", F.least("h", F.coalesce("b_n", F.lit(0))))
    pick = lambda p, m, size: F.coalesce(*[F.when(F.col(size) == j + 1, F.col(f"{p}{m}_{j}")) for j in range(MAX_HEAD)],
                                         F.lit(SAME).cast("long"))
    cols = ["conv", "n", "h", "hb", *[f"b_{c}_{j}" for j in range(MAX_HEAD) for c in ("m1", "m2", "t1", "t2", "words")]]
    v = v.select(*cols, (F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"),
                 pick("b_", "m1", "hb").alias("head1"), pick("b_", "m2", "hb").alias("head2"),
                 pick("", "m1", "h").alias("skip1"), pick("", "m2", "h").alias("skip2"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.schema.fields)
    return stage(v.mapInArrow(_left_factor(v.columns), schema + ", left1 long, left2 long"), "trie-plans")


def memberships(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """``(conv, depth, f1, f2, p1, p2, t1, t2, words, ends)``: every rebuilt prefix by its
    fingerprint f, with that of the prefix before it and its last turn."""
    same, none = F.lit(SAME).cast("long"), F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    step = lambda d, f, p, t, w: F.struct(
        F.lit(d).cast("long").alias("depth"), f[0].alias("f1"), f[1].alias("f2"), p[0].alias("p1"), p[1].alias("p2"),
        t[0].alias("t1"), t[1].alias("t2"), w.alias("words"))
    at = lambda j: (F.col(f"b_m1_{j}"), F.col(f"b_m2_{j}")) if j >= 0 else (same, same)
    tops = F.array(step(0, at(-1), (none, none), (none, none), zero),
                   *[step(j + 1, at(j), at(j - 1), (F.col(f"b_t1_{j}"), F.col(f"b_t2_{j}")), F.col(f"b_words_{j}"))
                     for j in range(MAX_HEAD)])
    head = plan.select("conv", "len", F.inline(F.slice(tops, F.lit(1), (F.col("hb") + 1).cast("int"))))
    rows = placed.join(plan.select("conv", "h", "hb", "len", "left1", "left2"), "conv").where("pos >= h")
    own = rows.select(
        "conv", "len", (F.col("hb") + F.col("pos") - F.col("h") + 1).alias("depth"),
        compose(F.col("left1"), F.col("m1")).alias("f1"), compose(F.col("left2"), F.col("m2")).alias("f2"),
        compose(F.col("left1"), F.col("before_e1")).alias("p1"), compose(F.col("left2"), F.col("before_e2")).alias("p2"),
        "t1", "t2", "words")
    every = head.unionByName(own).withColumn("ends", F.col("depth") == F.col("len")).drop("len")
    return stage(every, "trie-members")


KEY = ["depth", "f1", "f2"]


def _nodes(members: DataFrame) -> DataFrame:
    same = None
    for c in ("p1", "p2", "t1", "t2"):
        term = F.min(c).eqNullSafe(F.max(c))
        same = term if same is None else same & term
    return stage(members.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), same.alias("same")), "trie-nodes")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted rows (key, conv) as (key, first conv, ids joined by commas)."""
    key, ids, out = None, [], []

    def flush():
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    names = [*KEY, "conv", "ids"]
    for b in batches:
        for *k, conv in zip(*[b.column(i).to_pylist() for i in range(4)]):
            if k != key or len(ids) == IDS:
                flush()
                key = k
            ids.append(conv)
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names=names)
            out.clear()
    flush()
    if out:
        yield pa.record_batch([pa.array(c) for c in zip(*out)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's joined ids, read one row at a time."""
    key, h = None, None
    names = [*KEY, "ends_sha256"]
    row = lambda: pa.record_batch([*[pa.array([x], pa.int64()) for x in key], pa.array([h.hexdigest()])], names=names)
    for b in batches:
        for *k, text in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4)]):
            if k != key:
                if key is not None:
                    yield row()
                key, h = k, hashlib.sha256()
            else:
                h.update(b",")
            h.update(text.encode())
    if key is not None:
        yield row()


def end_digests(members: DataFrame) -> DataFrame:
    """Per node with ends the digest of their ids.  A node's ids are joined in parts by
    many tasks; the digest itself reads the parts in order, one at a time."""
    at = [*KEY, "conv"]
    ends = members.where("ends").select(*at).repartitionByRange(*at).sortWithinPartitions(*at)
    parts = stage(ends.mapInArrow(_joined_ids, "depth long, f1 long, f2 long, conv long, ids string"), "trie-ends")
    return parts.repartition(*KEY).sortWithinPartitions(*at).mapInArrow(
        _digests, "depth long, f1 long, f2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, head: Column | None = None, base: Column | None = None,
                id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                hashes: Sequence[tuple[int, int]] = HASHES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, fingerprint.

    ``head`` (0 to 3 turns) and ``base`` say, in terms of the column ``conv``, what a
    conversation takes from which other; without them each is its own base."""
    base = F.col("conv") if base is None else base
    head = F.lit(0) if head is None else F.least(F.greatest(head, F.lit(0)), F.lit(MAX_HEAD))
    turns = stored_turns(conversations, id_col, turn_col, role_col, text_col)
    for seed, bits in hashes:
        known = hashed(turns, seed, bits)
        if not equal_turns(known):
            continue
        rows = known.select("conv", "turn", "tie", "t1", "t2", "words", F.lit(1).cast("long").alias("one"),
                            _as_map(F.col("t1")).alias("e1"), _as_map(F.col("t2")).alias("e2"))
        # ``turn`` sorts nulls first
        placed = running(rows, "conv", ["turn", "tie"], ["one", "e1", "e2"], PREFIX, "trie-prefixes")
        placed = placed.withColumnRenamed("before_one", "pos").withColumns({
            "m1": compose(F.col("before_e1"), F.col("e1")), "m2": compose(F.col("before_e2"), F.col("e2"))})
        members = memberships(placed, plans(placed, head, base))
        nodes = _nodes(members)
        if nodes.where("NOT same").isEmpty():
            return _measured(nodes, members)
    raise RuntimeError("no hash told all turns apart")


def _measured(nodes: DataFrame, members: DataFrame) -> DataFrame:
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")]
    kids = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    own = nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = stage(own.select(*KEY, "p1", "p2", "conv", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"),
                           ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "trie-counts")
    chains = running(own, "conv", ["depth"], ["leaf", "saved"], sums(2), "trie-chains")
    total = own.groupBy("conv").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saves"))
    below = members.select(*KEY, "conv").join(total, "conv").groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saves").alias("saves"))
    parent = nodes.select(F.col("depth").alias("pd"), F.col("f1").alias("pf1"), F.col("f2").alias("pf2"), F.col("conv").alias("parent_conv_id"))
    full = (chains.join(below, KEY).join(end_digests(members), KEY, "left")
            .join(parent, (F.col("depth") - 1 == F.col("pd")) & (F.col("p1") == F.col("pf1")) & (F.col("p2") == F.col("pf2")), "left"))
    return full.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") - F.col("before_leaf")).alias("n_leaves"), (F.col("saves") - F.col("before_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.concat_ws(":", F.hex("f1"), F.hex("f2")).alias("fingerprint"))
