"""Trie of conversation prefixes from vertical bitmaps.

A node is a distinct sequence of first turns. Conversations are dealt into shards of neighbouring ids and bands of positions. A shard
indexes (position, turn) to a bitset of its conversations; a depth-first search intersects the bitset of a node with the
postings of the next position, which yields its children, their popcounts, and the list of conversations that end there. Nodes of several
shards are one by the key of their path.

The key of a path is the sum over its turns of a 128-bit hash of position and turn, so it can be summed along a conversation
and a band needs no turn before it. What concerns whole subtrees needs no walk over the tree: among the members of a node, exactly
one owns each node below it, the smallest member of that node. So sums over a subtree are sums over the node's members of what
each of them owns from that depth on, and the work stays linear in the number of turns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import col, stored

#: Conversations of one shard (a range of ids) and positions of one band: a group of rows is at most their product.
SHARD_IDS = 1024
BAND = 64

PATH = ["p0", "p1", "p2", "p3"]
LOW = 0xFFFFFFFF


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv long, pos, turn, chars): the turns of every conversation, numbered from 1; ``turn`` is the digest of role and text.

    Null turn numbers come first, rows of one number in the order of role and digest; a null role or text counts as empty.
    Rows without a conversation id belong to no conversation and are left out.
    """
    role, text = F.coalesce(col(role_col), F.lit("")), F.coalesce(col(text_col), F.lit(""))
    rows = conversations.filter(col(conv_col).isNotNull()).select(
        col(conv_col).cast("long").alias("conv"), col(turn_col).alias("no"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("turn"), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv").orderBy(F.col("no").asc_nulls_first(), "role", "turn")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("pos"), "turn", "chars")


def _paths(turns: DataFrame) -> DataFrame:
    """The turns with the key of the path up to them, and of the path before."""
    parts = []
    for k in (0, 1):
        h = F.xxhash64(F.lit(k), "pos", "turn")
        parts += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(LOW))]
    along = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = turns.select("conv", "pos", "turn", "chars", *[p.alias(f"h{i}") for i, p in enumerate(parts)])
    return hashed.select("conv", "pos", "turn", "chars", *[F.sum(f"h{i}").over(along).alias(p) for i, p in enumerate(PATH)],
                         (F.lead("pos").over(Window.partitionBy("conv").orderBy("pos")).isNull()).alias("last"))


SHARD_NODE = "p0 long, p1 long, p2 long, p3 long, depth long, conv long, n long, chars long, shard long, ends binary"


def search(shard: int, conv: np.ndarray, pos: np.ndarray, turn: list[bytes], last: np.ndarray, width: int):
    """Nodes of a shard in one band, depth first: (row of a member, bitset of members, bitset of those that end there).

    ``conv`` are ids, ``pos`` positions; the roots are the positions before the band, one for each path.
    """
    slot = (conv - shard * width).tolist()
    places, ended = pos.tolist(), last.tolist()
    postings: dict[tuple[int, bytes], int] = {}
    at: dict[tuple[int, int], int] = {}
    ends: dict[tuple[int, bytes], int] = {}
    for i, (s, p, t) in enumerate(zip(slot, places, turn)):
        bit = 1 << s
        postings[p, t] = postings.get((p, t), 0) | bit
        at[s, p] = i
        if ended[i]:
            ends[p, t] = ends.get((p, t), 0) | bit

    def search_from(members: int, position: int):
        stack = [(members, position)]
        while stack:
            rest, p = stack.pop()
            while rest:
                smallest = (rest & -rest).bit_length() - 1
                i = at.get((smallest, p))
                if i is None:  # ended before, or the end of the band
                    rest &= rest - 1
                    continue
                child = rest & postings[p, turn[i]]
                rest &= ~child
                over = child & ends.get((p, turn[i]), 0)
                yield i, child, over
                if child & ~over:
                    stack.append((child & ~over, p + 1))

    return search_from


def _bits(x: int) -> list[int]:
    out = []
    while x:
        out.append((x & -x).bit_length() - 1)
        x &= x - 1
    return out


def shard_nodes(paths: DataFrame, width: int = SHARD_IDS, band: int = BAND) -> DataFrame:
    """The nodes of every shard: path, depth, smallest member, popcount, code points of the last text, members that end there."""
    dealt = paths.select(F.floor(F.col("conv") / width).cast("long").alias("shard"), F.floor((F.col("pos") - 1) / band).cast("long").alias("band"),
                         "conv", "pos", "turn", "chars", *PATH, "last")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("conv", "ascending"), ("pos", "ascending")])
        shard, start = group["shard"][0].as_py(), group["band"][0].as_py() * band + 1
        conv, pos, last = (group[c].to_numpy() for c in ("conv", "pos", "last"))
        keys = np.stack([group[p].to_numpy() for p in PATH], 1)
        turn, chars = group["turn"].to_pylist(), group["chars"].to_numpy()
        find = search(shard, conv, pos, turn, last, width)
        # conversations enter the band from one or more paths: those that share their first turn here and its path share the path before
        roots: dict[tuple, int] = {}
        for i in np.flatnonzero(pos == start):
            before = (tuple(keys[i]), turn[i])
            roots[before] = roots.get(before, 0) | (1 << int(conv[i] - shard * width))
        rows, convs, counts, ends = [], [], [], []
        for members in roots.values():
            for i, child, over in find(members, start):
                rows.append(i)
                convs.append(shard * width + (child & -child).bit_length() - 1)
                counts.append(child.bit_count())
                ends.append(np.array(_bits(over), "<u2").tobytes() if over else None)
        at = np.array(rows, np.int64)
        return pa.table([*[pa.array(keys[at, k]) for k in range(4)], pa.array(pos[at]), pa.array(convs, pa.int64()), pa.array(counts, pa.int64()),
                         pa.array(chars[at]), pa.array(np.full(len(at), shard)), pa.array(ends, pa.binary())],
                        names=[*PATH, "depth", "conv", "n", "chars", "shard", "ends"])

    return dealt.groupBy("shard", "band").applyInArrow(run, SHARD_NODE)


def _digests(lists: DataFrame, width: int) -> DataFrame:
    """SHA-256 of the comma-joined ids of every path's end lists, streamed shard by shard in the order of ids."""

    def run(batches):
        now, h, first = None, None, True
        for b in batches:
            out = []
            keys = list(zip(*[b.column(k).to_pylist() for k in range(4)]))
            for key, shard, ends in zip(keys, b.column(4).to_pylist(), b.column(5).to_pylist()):
                if key != now:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h, first = key, hashlib.sha256(), True
                text = ",".join(map(str, (np.frombuffer(ends, "<u2").astype(np.int64) + shard * width).tolist()))
                h.update((text if first else "," + text).encode())
                first = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*PATH, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, h.hexdigest())], [*PATH, "ends_sha256"])

    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_lists = lists.select(*PATH, "shard", "ends").repartition(n, *PATH).sortWithinPartitions(*PATH, "shard")
    return sorted_lists.mapInArrow(run, "p0 long, p1 long, p2 long, p3 long, ends_sha256 string")


NOTHING = hashlib.sha256(b"").hexdigest()


def trie(members: DataFrame, turns: DataFrame, width: int = SHARD_IDS, band: int = BAND) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``members`` has one row for each conversation (``conv``), with or without turns; ``turns`` are rows of ``turns_of`` with
    positions from 1 without gaps. No member at all gives no node, not even a root.
    """
    members = members.select("conv")
    paths = stored(_paths(turns), "paths")
    found = stored(shard_nodes(paths, width, band), "shard-nodes")
    node = found.groupBy(*PATH).agg(F.min("conv").alias("owner"), F.sum("n").alias("n_convs"), F.max("chars").alias("node_chars"),
                                    F.sum(F.coalesce(F.length("ends"), F.lit(0)) / 2).cast("long").alias("n_ends"))
    # every turn with its node: the owner of the node, and what the conversation owns from here on
    rows = paths.select("conv", "pos", *PATH, "last").join(node, PATH)
    by = Window.partitionBy("conv").orderBy("pos")
    own = F.col("owner") == F.col("conv")
    # a childless node counts once, for its owner
    leaf = own & F.col("last") & (F.col("n_ends") == F.col("n_convs"))
    rows = rows.withColumn("own", own).withColumn("leaf", leaf)
    below = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.when(F.col("own"), (F.col("n_convs") - 1) * F.col("node_chars")).otherwise(0)
    rows = rows.select("conv", "pos", *PATH, "owner", "n_convs", "own", F.sum(weight).over(below).alias("saved"), F.max("leaf").over(below).alias("leafy"),
                       F.lead("own").over(by).alias("child"), F.lag("owner").over(by).alias("above"))
    rows = stored(rows, "rows")
    number = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    # the root: its members are all conversations, its children the nodes at depth 1; one row each reaches the driver
    whole = members.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).first()
    top = rows.filter("pos = 1").agg(number("own").alias("children"), number("leafy").alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")).first()
    long = lambda x: F.lit(x).cast("long")
    root_path = [long(0).alias(p) for p in PATH]
    root = members.sparkSession.range(1 if whole.n else 0).select(
        *root_path, long(whole.conv).alias("conv_id"), long(0).alias("depth"), long(None).alias("parent_conv_id"), long(whole.n).alias("n_convs"),
        # without any turn the root itself is the only leaf
        long(top.children).alias("n_children"), long(max(top.leaves, 1)).alias("n_leaves"), long(top.saved).alias("saved_tokens"))
    silent = members.join(paths.filter("pos = 1").select("conv"), "conv", "left_anti")
    silent_lists = _end_lists(silent, width).select(*root_path, "shard", "ends")
    digests = _digests(found.filter("ends IS NOT NULL").select(*PATH, "shard", "ends").unionByName(silent_lists), width)
    nodes = rows.groupBy(*PATH).agg(F.min("owner").alias("conv_id"), F.min("pos").alias("depth"), F.coalesce(F.min("above"), long(whole.conv)).alias("parent_conv_id"),
                                    F.min("n_convs").alias("n_convs"), number("child").alias("n_children"), number("leafy").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return nodes.unionByName(root).join(digests, PATH, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def _end_lists(members: DataFrame, width: int) -> DataFrame:
    """Ids as one list for each shard."""

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        ids = np.unique(group["conv"].to_numpy() - shard * width)
        return pa.table([pa.array([shard]), pa.array([ids.astype("<u2").tobytes()], pa.binary())], names=["shard", "ends"])

    return members.select(F.floor(F.col("conv") / width).cast("long").alias("shard"), "conv").groupBy("shard").applyInArrow(run, "shard long, ends binary")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that start like the first of their block of ids: (members, turns).

    Conversation c begins with the first h turns of c - c % block and goes on with its own turns after its first h, where h is the CRC-32 of
    its decimal id modulo ``most``.
    """
    base = F.col("conv") - F.col("conv") % block
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    turns = stored(turns, "turns")
    members = turns.filter("pos = 1").select("conv")
    heads = turns.filter((base == F.col("conv")) & (F.col("pos") < most))
    sizes = heads.groupBy(F.col("conv").alias("base")).agg(F.max("pos").alias("size"))
    own = turns.withColumn("h", h).filter("pos > h").withColumn("base", base).join(sizes, "base", "left")
    rest = own.select("conv", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("size", F.lit(0)))).alias("pos"), "turn", "chars")
    lent = heads.select(F.col("conv").alias("base"), "pos", "turn", "chars")
    begin = members.withColumn("h", h).withColumn("base", base).join(lent, "base").filter("pos <= h").select("conv", "pos", "turn", "chars")
    return members, begin.unionByName(rest)


SQL = """
WITH RECURSIVE own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 100 AS base, list_transform(range(length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, (i + 1)::INT, 1))::BIGINT) AS bytes
  FROM (SELECT DISTINCT c FROM own)),
members AS (
  SELECT c, base, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda a, x:
    list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 6 AS h
  FROM ids),
all_turns AS (
  SELECT m.c, o.pos, 0 AS part, o.role, o.text FROM members m JOIN own o ON o.c = m.base AND o.pos <= m.h
  UNION ALL
  SELECT o.c, o.pos, 1 AS part, o.role, o.text FROM own o JOIN members m ON m.c = o.c WHERE o.pos > m.h),
turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, length(text) AS chars, sha256(length(role) || ':' || role || text) AS turn FROM all_turns),
paths AS (
  SELECT c, d, chars, sha256(array_to_string(list(turn) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING), '')) AS path FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM members),
placed AS (SELECT *, lag(path) OVER (PARTITION BY c ORDER BY d) AS above, d = max(d) OVER (PARTITION BY c) AS last FROM paths),
nodes AS (
  SELECT path, min(c) AS conv_id, min(d) AS depth, min(above) AS above, count(*) AS n_convs, min(chars) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
  FROM placed GROUP BY path),
kids AS (SELECT above, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
below AS (
  SELECT path AS top, path FROM nodes
  UNION ALL SELECT b.top, n.path FROM below b JOIN nodes n ON n.above = b.path),
summed AS (
  SELECT b.top, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM below b JOIN nodes n ON n.path = b.path LEFT JOIN kids k ON k.above = b.path GROUP BY b.top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN summed s ON s.top = n.path LEFT JOIN kids k ON k.above = n.path LEFT JOIN nodes p ON p.path = n.above
"""
