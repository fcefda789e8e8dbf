"""Prefix trie of conversations from vertical bitmaps.

Turns are put in order of (conversation, position) and cut into units of
bounded size.  A unit indexes each (position, turn) to a bitset of its
conversations; depth-first, the bitset of a node is intersected with the
postings of the next position, which gives its children, their members
(popcounts) and the conversations that end there.  A node is known by the
128-bit digest of its path, so units are joined by adding up what they say of a
node.

Sums over subtrees need no walk over the whole trie.  Each node is owned by
the unit of its smallest member, and the subtree of a node is the union of its
parts in all units, so each unit sums what it owns below its nodes (a range in
depth-first order) and those sums are added up.

A conversation may be longer than a unit, and one conversation or one turn may
hold a large share of all rows: units cut conversations, a unit that goes on
with one starts from the digest of what came before, and sums of the later
units of a conversation are handed to the node where the earlier ones stop.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, staged

UNIT_MEMBERS = 4096
UNIT_ROWS = 65_536
#: Conversation ids in one piece of an end list.
PIECE = 256
WRAP = (1 << 64) - 1
END = (1 << 63) - 1


def _signed(x: int) -> int:
    x &= WRAP
    return x - (1 << 64) if x >> 63 else x


def _edges(rows: DataFrame, last: list[str]) -> list:
    """Per written partition its first and last conversation and, of the last
    one, the columns ``last`` at its largest position: one row a partition."""
    return rows.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "pos", *last)).alias("last")).orderBy("part").collect()


# ---- order ------------------------------------------------------------------------------------

def positions(conversations: DataFrame) -> DataFrame:
    """(conv, pos, k1, k2, n_bytes): every turn's position from 1 in its
    conversation, its content as two hashes and the bytes of its text.

    Order: turn (null first), then role and text by code point; null role and
    text are empty.  Rows without a conversation id take no part.  Positions are
    counted per range partition and moved on by what earlier partitions hold of
    the conversation that goes on, so no conversation is sorted in one task."""
    spark = conversations.sparkSession
    ship(spark)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                                             role.alias("role"), text.alias("text"))
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    size = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal rows are alike, so where a hash of their place puts them does not matter
    ordered = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(size, *keys, F.col("salt")).sortWithinPartitions(*keys)
    plain = ordered.select("conv", F.xxhash64(F.length("role"), "role", "text", F.lit(1)).alias("k1"),
                           F.xxhash64(F.length("role"), "role", "text", F.lit(2)).alias("k2"), F.octet_length("text").cast("long").alias("n_bytes"),
                           F.spark_partition_id().alias("part"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            place = np.arange(1, len(ids) + 1) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            if conv is not None and ids[0] == conv:
                upto = starts[1] if len(starts) > 1 else len(ids)
                place[:upto] += held
            conv, held = ids[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "pos"])

    made = staged(plain.mapInArrow(number, "conv long, k1 long, k2 long, n_bytes long, part int, pos long"), "trie-turns")
    moved, conv, held = [], None, 0
    for e in _edges(made, []):
        if e["first"] == conv:
            moved.append((e["part"], conv, held))
        conv, held = e["last"]["conv"], e["last"]["pos"] + (held if e["last"]["conv"] == conv else 0)
    if not moved:
        return made.select("conv", "pos", "k1", "k2", "n_bytes")
    shift = F.broadcast(spark.createDataFrame(moved, "part int, conv long, held long"))  # a row a partition at most
    return made.join(shift, ["part", "conv"], "left").select("conv", (F.col("pos") + F.coalesce("held", F.lit(0))).alias("pos"), "k1", "k2", "n_bytes")


def shared_starts(turns: DataFrame, group: int = 5, cycle: int = 9) -> DataFrame:
    """Conversations that begin as others do: of (conv, pos, ...) rows, each
    conversation c gets the first h turns of c - c % group (h = crc32 of c in
    decimal, modulo ``cycle``) and then its own turns after its first h.  Every
    conversation also gets a last row with position END and null content, so
    those without turns are there too."""
    cut = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(cycle)).cast("int")
    base = turns.where((F.col("pos") < cycle) & (F.col("conv") % group == 0)) \
        .groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "k1", "k2", "n_bytes"))).alias("start"))  # cycle - 1 turns at most
    heads = turns.where("pos = 1").select("conv", cut.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base")) \
        .join(base, "base", "left").withColumn("start", F.expr("coalesce(slice(start, 1, h), array())"))
    heads = staged(heads.select("conv", F.size("start").cast("long").alias("kept"), "start"), "trie-heads")
    first = heads.select("conv", F.inline("start"))
    own = turns.withColumn("h", cut).where(F.col("pos") > F.col("h")).join(heads.select("conv", "kept"), "conv") \
        .select("conv", (F.col("pos") - F.col("h") + F.col("kept")).alias("pos"), "k1", "k2", "n_bytes")
    none = F.lit(None).cast("long")
    return first.unionByName(own).unionByName(heads.select("conv", F.lit(END).alias("pos"), none.alias("k1"), none.alias("k2"), none.alias("n_bytes")))


# ---- units ------------------------------------------------------------------------------------

UNITS = "conv long, pos long, x1 long, x2 long, n_bytes long, part int, unit long, s1 long, s2 long, depth long"


def units(turns: DataFrame, unit_members: int, unit_rows: int) -> DataFrame:
    """The rows in order of (conv, pos), dealt to units.  s1, s2 and depth are
    the running digest and the last turn's position within the partition."""
    spark = turns.sparkSession
    size = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select("conv", "pos", F.when(F.col("pos") == END, 0).otherwise(F.xxhash64("pos", "k1", "k2", F.lit(3))).alias("x1"),
                        F.when(F.col("pos") == END, 0).otherwise(F.xxhash64("pos", "k2", "k1", F.lit(4))).alias("x2"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes")) \
        .repartitionByRange(size, "conv", "pos").sortWithinPartitions("conv", "pos").withColumn("part", F.spark_partition_id())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, made, members, held = None, 0, 0, 0
        s1 = s2 = depth = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            part = batch.column(5)[0].as_py()
            unit, sums1, sums2, depths = [], [], [], []
            for c, p, a, b in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if c != conv:
                    if members >= unit_members or held >= unit_rows:
                        made, members, held = made + 1, 0, 0
                    conv, members, s1, s2, depth = c, members + 1, 0, 0, 0
                elif held >= 2 * unit_rows:  # a long conversation is cut
                    made, members, held = made + 1, 1, 0
                held += 1
                s1, s2 = s1 + a, s2 + b
                if p != END:
                    depth = p
                unit.append((part << 32) + made)
                sums1.append(_signed(s1))
                sums2.append(_signed(s2))
                depths.append(depth)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unit, pa.int64()), pa.array(sums1, pa.int64()), pa.array(sums2, pa.int64()),
                                              pa.array(depths, pa.int64())], names=UNIT_NAMES)

    made = staged(rows.mapInArrow(deal, UNITS), "trie-units")
    carried, conv, total = [], None, (0, 0, 0)
    for e in _edges(made, ["s1", "s2", "depth"]):
        if e["first"] == conv:
            carried.append((e["part"], conv, *total))
        last = e["last"]
        before = total if last["conv"] == conv else (0, 0, 0)
        conv, total = last["conv"], (_signed(before[0] + last["s1"]), _signed(before[1] + last["s2"]), max(before[2], last["depth"]))
    shift = F.broadcast(spark.createDataFrame(carried, "part int, conv long, c1 long, c2 long, c_depth long"))  # a row a partition at most
    return made.join(shift, ["part", "conv"], "left").na.fill(0, ["c1", "c2", "c_depth"])


UNIT_NAMES = [c.split()[0] for c in UNITS.split(", ")]


# ---- one unit ---------------------------------------------------------------------------------

FOUND = "unit long, pre int, last int, depth long, d1 long, d2 long, p1 long, p2 long, n long, first long, n_bytes long, goes_on long, stops long, ends string"


def descend(pdf: pd.DataFrame) -> pd.DataFrame:
    """The part of the trie that a unit's conversations span.

    Node rows in depth-first order: path digest (d1, d2), parent's digest,
    members, smallest member, and the last row of the subtree.  ``goes_on`` is
    the conversation whose start lies in an earlier unit, on nodes reached by
    it; ``stops`` the one that goes on in a later unit, on its last node here.
    Rows with ``pre`` = -1 hold end lists: pieces of conversation ids."""
    pdf = pdf.sort_values(["conv", "pos"], kind="stable")
    unit = int(pdf["unit"].iloc[0])
    convs = pdf["conv"].to_numpy()
    members, turns, ended, postings, ends_at = [], [], [], {}, {}
    start = None
    rows = zip(convs.tolist(), *[pdf[c].tolist() for c in ("pos", "x1", "x2", "n_bytes", "s1", "s2", "depth", "c1", "c2", "c_depth")])
    base = 0
    for conv, pos, x1, x2, n_bytes, s1, s2, depth, c1, c2, c_depth in rows:
        if not members or members[-1] != conv:
            if not members:  # only the first one may have started elsewhere
                base = max(depth, c_depth) if pos == END else pos - 1
                start = (_signed(s1 + c1 - x1), _signed(s2 + c2 - x2))
            members.append(conv)
            turns.append([])
            ended.append(False)
        i = len(members) - 1
        if pos == END:
            ended[i] = True
            at = (base if i == 0 else 0) + len(turns[i])
            ends_at[at] = ends_at.get(at, 0) | 1 << i
        else:
            turns[i].append((x1, x2, n_bytes))
            postings[(pos, x1, x2)] = postings.get((pos, x1, x2), 0) | 1 << i

    nodes, lists = [], []
    everyone = (1 << len(members)) - 1
    stack = []
    if base == 0:
        stack.append((everyone, 0, 0, 0, 0, 0, 0, None))
    else:
        if everyone > 1:
            stack.append((everyone & ~1, 0, 0, 0, 0, 0, 0, None))
        stack.append((1, base, *start, 0, 0, 0, members[0]))
    while stack:
        bits, depth, d1, d2, p1, p2, n_bytes, goes_on = stack.pop()
        low = (bits & -bits).bit_length() - 1
        entered = goes_on is not None and depth == base  # told of by the unit before
        skip = base if goes_on is not None else 0
        here = bits & ends_at.get(depth, 0)
        rest, stops = bits & ~here, None
        children = []
        while rest:
            i = (rest & -rest).bit_length() - 1
            if depth - skip >= len(turns[i]):
                stops = members[i]
                rest &= ~(1 << i)
                continue
            x1, x2, size = turns[i][depth - skip]
            child = bits & postings[(depth + 1, x1, x2)]
            rest &= ~child
            children.append((child, depth + 1, _signed(d1 + x1), _signed(d2 + x2), d1, d2, size, goes_on))
        if not entered:
            nodes.append((depth, d1, d2, p1, p2, bits.bit_count(), members[low], n_bytes, goes_on, stops))
        if here:
            found = []
            while here:
                found.append(members[(here & -here).bit_length() - 1])
                here &= here - 1
            for k in range(0, len(found), PIECE):
                lists.append((depth, d1, d2, found[k], ",".join(map(str, found[k:k + PIECE]))))
        stack.extend(reversed(children))

    depths = [x[0] for x in nodes]
    last, open_ = [0] * len(nodes), []
    for i, d in enumerate(depths):
        while open_ and depths[open_[-1]] >= d:
            last[open_.pop()] = i - 1
        open_.append(i)
    for i in open_:
        last[i] = len(nodes) - 1
    out = [(unit, i, last[i], *x, None) for i, x in enumerate(nodes)]
    out += [(unit, -1, -1, depth, d1, d2, 0, 0, 0, first, 0, None, None, ids) for depth, d1, d2, first, ids in lists]
    made = pd.DataFrame(out, columns=FOUND_NAMES)
    return made.astype({"goes_on": "Int64", "stops": "Int64"})


FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


# ---- the whole trie ---------------------------------------------------------------------------

NODE = ["depth", "d1", "d2"]


def _subtree_sums(found: DataFrame, owned: DataFrame) -> DataFrame:
    """(node, saved, n_leaves) over subtrees, from the unit rows and what each
    node adds itself: (unit, pre, saved, leaf) at its owner."""
    parts = found.where("pre >= 0").select("unit", "pre", "last", *NODE)
    extra = found.where("stops IS NOT NULL AND pre >= 0").select(F.col("stops").alias("conv"), "unit", "pre")
    if not extra.isEmpty():
        # what a cut conversation owns in later units counts below its last node here
        later = found.where("goes_on IS NOT NULL AND pre >= 0").select(F.col("goes_on").alias("conv"), "unit", "pre") \
            .join(owned, ["unit", "pre"]).groupBy("conv", "unit").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
        both = extra.join(later, ["conv", "unit"], "full")
        after = Window.partitionBy("conv").orderBy(F.col("unit").desc()).rowsBetween(Window.unboundedPreceding, -1)
        both = both.select("unit", "pre", F.coalesce(F.sum("saved").over(after), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaf").over(after), F.lit(0)).alias("leaf"))
        owned = owned.unionByName(both.where("pre IS NOT NULL"))

    def add(nodes: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pre")
        low, high = nodes["pre"].to_numpy(), nodes["last"].to_numpy() + 1
        sums = {}
        for c in ("saved", "leaf"):
            at = np.zeros(len(nodes), np.int64)
            np.add.at(at, own["own_pre"].to_numpy(), own[c].to_numpy())
            upto = np.append(0, np.cumsum(at))
            sums[c] = upto[high] - upto[low]
        return pd.DataFrame({**{c: nodes[c] for c in NODE}, **sums})

    mine = owned.select(F.col("unit").alias("own_unit"), F.col("pre").alias("own_pre"), "saved", "leaf")
    return parts.groupBy("unit").cogroup(mine.groupBy("own_unit")).applyInPandas(add, "depth long, d1 long, d2 long, saved long, leaf long") \
        .groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))


def _end_digests(lists: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end.  The pieces of
    a node's list come in order and are hashed as they come: the memory of a
    task does not depend on a list's length."""
    names = [*NODE, "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if key != node:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
                out = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(*node, digest.hexdigest())])], names=names)

    pieces = lists.select(*NODE, "first", "ends").repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return pieces.mapInArrow(run, "depth long, d1 long, d2 long, ends_sha256 string")


def trie(turns: DataFrame, unit_members: int = UNIT_MEMBERS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """The nodes of the prefix trie of (conv, pos, k1, k2, n_bytes) rows, with
    one row of position END a conversation, as ``shared_starts`` gives them.

    Per node: conv_id (smallest member), depth, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Without
    conversations there are no nodes.  Turns of equal role and text are one;
    nodes are told apart by 128 bits of hash."""
    found = staged(units(turns, unit_members, unit_rows).groupBy("unit").applyInPandas(descend, FOUND), "trie-parts")
    nodes = found.where("pre >= 0").groupBy(*NODE).agg(
        F.sum("n").alias("n_convs"), F.min(F.struct("first", "unit", "pre")).alias("own"), F.max("n_bytes").alias("n_bytes"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children, NODE, "left").na.fill(0, ["n_children"]), "trie-nodes")
    owned = nodes.select("own.unit", "own.pre", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    parents = nodes.where("n_children > 0 AND depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("own.first").alias("up"))
    top = nodes.where("depth = 0").select(F.col("own.first").alias("top"))  # one row
    out = nodes.join(_subtree_sums(found, owned), NODE).join(_end_digests(found.where("pre = -1")), NODE, "left")
    # children of the root look for no parent here and are spread by their own digest
    deep = F.col("depth") > 1
    out = out.withColumn("p1", F.when(deep, F.col("p1")).otherwise(F.col("d1"))).withColumn("p2", F.when(deep, F.col("p2")).otherwise(F.col("d2"))) \
        .join(parents, ["depth", "p1", "p2"], "left").crossJoin(F.broadcast(top))
    parent = F.when(F.col("depth") == 1, F.col("top")).otherwise(F.col("up"))
    return out.select(F.col("own.first").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
