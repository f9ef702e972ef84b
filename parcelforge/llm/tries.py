"""Conversation prefix trie: which conversations share their first turns, and what sharing saves.

1. ``rebuilt_turns``: conversations are put together from the first turns of their base and
   their own rest; a turn becomes a digest of role and text, and its text is not carried on.
2. A stream over each conversation's turns, sorted, folds the digests: a node is the digest of
   all turns so far, so equal prefixes are equal nodes.
3. Weights: the turns at and below each node, summed with map-side combine.  Nodes of more
   than ``limit`` turns form the top of the trie; a conversation's first node below the top
   is its subtrie.  Without a top the subtrie is the first turn; an oversized first-turn
   subtrie is thus dealt out by its next turn, and so on, for all levels in one pass.
4. Subtries are hashed into buckets of about ``limit / 2`` turns.  Each bucket is built in
   ``applyInPandas`` as tries of pointers with a dictionary of children a node, and summed in an iterative postorder.
5. The top's own figures are aggregates; its sums over subtrees are found by pointer
   doubling, in as many rounds as the logarithm of the top's depth.

Scale: no group has more than about two times ``limit`` turns, whatever a turn's or a
prefix's share of the rows; a single conversation is folded as a stream, in bounded memory.  The
digest of a top node's ends reads its sorted members as a stream in one task, as SHA-256 of a list must.

Cases: null role or text is empty; turns go by number (null first), then role, then text, so
repeated rows are turns of their own; a null id is one conversation with an empty decimal, of no base, after
all others; a conversation without turns is a member of the root only; long texts and
conversations are read whole; an empty table has no node; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, stored

#: Turns in one subtrie, at most.
LIMIT = 50_000
ROOT = b""

_TRIE = "node binary, parent binary, frontier boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _decimal(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def rebuilt_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """``c, d, t, turn, chars`` for each turn ``d`` of the ``t`` of the rebuilt conversation ``c``, and ``c, t`` for all of them.

    Conversation ``c`` starts with the first ``crc32(c) % most`` turns of ``c - c % group``, or all of them, and
    goes on with its own turns after as many.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("o"), role.alias("r"), text.alias("x"))
    order = Window.partitionBy("c").orderBy(F.col("o").asc_nulls_first(), "r", "x")
    rows = rows.withColumn("i", F.row_number().over(order) - 1)
    turns = stored(rows.select("c", "i", F.unhex(F.md5(F.concat(F.length("r"), F.lit(":"), "r", "x"))).alias("turn"), F.length("x").cast("long").alias("chars")), "turns")
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.select("c", "n", (F.crc32(_decimal(F.col("c"))) % most).cast("int").alias("h"), (F.col("c") - F.col("c") % group).alias("base"))
    heads = turns.filter((F.col("c") % group == 0) & (F.col("i") < most - 1)).groupBy(F.col("c").alias("base_c"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("i", "turn", "chars"))).alias("head"))  # at most five turns
    head = F.filter(F.coalesce("head", F.array().cast("array<struct<i:int,turn:binary,chars:bigint>>")), lambda e: e["i"] < F.col("h"))
    plan = convs.join(heads, F.col("base") == F.col("base_c"), "left").select("c", "n", "h", head.alias("head"))
    plan = stored(plan.select("c", "h", "head", F.size("head").alias("m"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int").alias("t")), "conversations")
    first = plan.select("c", "t", F.explode("head").alias("e")).select("c", (F.col("e.i") + 1).alias("d"), "t", F.col("e.turn").alias("turn"), F.col("e.chars").alias("chars"))
    how = plan.select(F.col("c").alias("p_c"), "h", "m", "t")
    own = turns.join(how, F.col("c").eqNullSafe(F.col("p_c"))).filter("i >= h").select("c", (F.col("m") + F.col("i") - F.col("h") + 1).alias("d"), "t", "turn", "chars")
    return first.unionByName(own), plan.select("c", "t")


def _folded(batches):
    """``c, d, t, chars, parent, node, first`` of turns sorted by conversation and place."""
    names = ["c", "d", "t", "chars", "parent", "node", "first"]
    now, node, first = None, ROOT, ROOT
    for b in batches:
        parents, nodes, firsts = [], [], []
        for c, d, turn in zip(b.column("c").to_pylist(), b.column("d").to_pylist(), b.column("turn").to_pylist(), strict=True):
            if d == 1 or c != now:
                now, node = c, ROOT
            parents.append(node)
            node = hashlib.md5(node + turn).digest()
            first = node if d == 1 else first
            nodes.append(node)
            firsts.append(first)
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names[:4]), *(pa.array(x, pa.binary()) for x in (parents, nodes, firsts))], names)


def _ends(ids: list) -> str:
    """SHA-256 of the decimals, joined by commas."""
    return hashlib.sha256(",".join("" if x is None else str(x) for x in ids).encode()).hexdigest()


def _last_if_null(x):
    return (x is None, x or 0)


class _Trie:
    """Tries of pointers: node ``k`` is the ``k``-th entry of each list, ``children[k]`` a dictionary of pointers."""

    def __init__(self):
        self.node, self.up, self.depth, self.chars, self.n, self.least, self.ends, self.children = [], [], [], [], [], [], [], []

    def child(self, of: dict, up: int, digest: bytes, depth: int, chars: int) -> int:
        at = of.get(digest)
        if at is None:
            at = of[digest] = len(self.node)
            for x, value in zip((self.node, self.up, self.depth, self.chars, self.n, self.least, self.ends, self.children), (digest, up, depth, chars, 0, None, [], {}), strict=True):
                x.append(value)
        return at

    def visit(self, at: int, conv) -> None:
        self.n[at] += 1
        if self.n[at] == 1 or _last_if_null(conv) < _last_if_null(self.least[at]):
            self.least[at] = conv

    def sums(self, roots) -> tuple[list, list]:
        """Leaves and saved characters of every node's subtree, children before their parents."""
        leaves, saved = [0] * len(self.node), [0] * len(self.node)
        stack = [(r, False) for r in roots]
        while stack:
            at, over = stack.pop()
            if not over:
                stack.append((at, True))
                stack.extend((x, False) for x in self.children[at].values())
            else:
                leaves[at] = sum(leaves[x] for x in self.children[at].values()) or 1
                saved[at] = (self.n[at] - 1) * self.chars[at] + sum(saved[x] for x in self.children[at].values())
        return leaves, saved


def _subtries(pdf: pd.DataFrame) -> pd.DataFrame:
    """All subtries of one bucket; ``frontier`` marks their tops, whose parents are not in the bucket."""
    pdf = pdf.sort_values(["c", "d"], na_position="last", kind="stable")
    trie, roots, outside = _Trie(), {}, {}
    now, at = None, -1
    convs = [None if pd.isna(x) else int(x) for x in pdf["c"]]
    for c, d, t, chars, parent, node in zip(convs, pdf["d"], pdf["t"], pdf["chars"], pdf["parent"], pdf["node"], strict=True):
        if at < 0 or c != now:
            now, at = c, trie.child(roots, -1, node, d, chars)
            outside[at] = parent
        else:
            at = trie.child(trie.children[at], at, node, d, chars)
        trie.visit(at, c)
        if d == t:
            trie.ends[at].append(c)
    leaves, saved = trie.sums(roots.values())
    out = {
        "node": trie.node,
        "parent": [outside[k] if up < 0 else trie.node[up] for k, up in enumerate(trie.up)],
        "frontier": [up < 0 for up in trie.up],
        "conv_id": pd.array(trie.least, "Int64"),
        "depth": trie.depth,
        "parent_conv_id": pd.array([None if up < 0 else trie.least[up] for up in trie.up], "Int64"),
        "n_convs": trie.n,
        "n_children": [len(x) for x in trie.children],
        "n_leaves": leaves,
        "saved_tokens": saved,
        "ends_sha256": [_ends(sorted(x, key=_last_if_null)) for x in trie.ends],
    }
    return pd.DataFrame(out)


def _streamed_ends(batches):
    """``node, ends_sha256`` of ``node, c`` rows that are sorted: one running hash a node."""
    now, hashed = None, None
    for b in batches:
        done = []
        for node, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = "" if c is None else str(c)
            if node != now:
                if now is not None:
                    done.append((now, hashed.hexdigest()))
                now, hashed = node, hashlib.sha256(text.encode())
            else:
                hashed.update(f",{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([hashed.hexdigest()])], ["node", "ends_sha256"])


def _summed(tops: DataFrame) -> DataFrame:
    """``node, leaves, saved`` over subtrees of ``node, parent, leaves, saved``: each round doubles the distance."""
    state = stored(tops.select("node", F.col("parent").alias("jump"), "leaves", "saved"), "tops")
    while not state.filter("jump is not null").isEmpty():
        below = state.filter("jump is not null").groupBy(F.col("jump").alias("b_node")).agg(F.sum("leaves").alias("b_leaves"), F.sum("saved").alias("b_saved"))
        above = state.filter("jump is not null").select(F.col("node").alias("a_node"), F.col("jump").alias("next"))
        new = state.join(below, F.col("node") == F.col("b_node"), "left").join(above, F.col("jump") == F.col("a_node"), "left")
        new = new.select("node", F.col("next").alias("jump"), (F.col("leaves") + F.coalesce("b_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("b_saved", F.lit(0))).alias("saved"))
        past, state = state, stored(new, "tops")
        drop(past)
    return state.select("node", "leaves", "saved")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, **columns) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for every node."""
    turns, convs = rebuilt_turns(conversations, **columns)
    rows = turns.repartition("c").sortWithinPartitions("c", "d").mapInArrow(_folded, "c long, d int, t int, chars long, parent binary, node binary, first binary")
    rows = stored(rows, "trie-rows")
    top = rows.groupBy("node").agg(F.sum(F.col("t") - F.col("d") + 1).alias("weight")).filter(F.col("weight") > limit)
    top = stored(top.select(F.col("node").alias("t_node")), "trie-top")
    none = top.isEmpty()
    if none:
        below = rows.withColumn("key", F.col("first"))
    else:
        rest = rows.join(top, F.col("node") == F.col("t_node"), "left_anti")
        cut = rest.groupBy(F.col("c").alias("k_c")).agg(F.min_by("node", "d").alias("key"))
        below = rest.join(cut, F.col("c").eqNullSafe(F.col("k_c")))
    buckets = max(64, 2 * rows.count() // limit)
    dealt = below.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "c", "d", "t", "chars", "parent", "node")
    tries = stored(dealt.groupBy("bucket").applyInPandas(lambda pdf: _subtries(pdf), _TRIE), "subtries")

    root = F.lit(bytearray(ROOT))
    held = rows.join(top, F.col("node") == F.col("t_node")).drop("t_node")
    tops = held.groupBy("node").agg(F.min("parent").alias("parent"), F.min("c").alias("conv_id"), F.max("d").cast("long").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    whole = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    tops = stored(whole.select(root.alias("node"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("chars")).unionByName(tops), "trie-tops")
    under = tries.filter("frontier").select("parent", "n_leaves", "saved_tokens").unionByName(tops.filter("depth > 0").select("parent", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
    under = under.groupBy(F.col("parent").alias("u_node")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("u_leaves"), F.sum("saved_tokens").alias("u_saved"))
    enders = convs.filter("t = 0").select(root.alias("node"), "c").unionByName(held.filter("d = t").select("node", "c"))
    ends = enders.repartition("node").sortWithinPartitions("node", F.col("c").asc_nulls_last()).mapInArrow(_streamed_ends, "node binary, ends_sha256 string")
    tops = tops.join(under, F.col("node") == F.col("u_node"), "left").join(ends.withColumnRenamed("node", "e_node"), F.col("node") == F.col("e_node"), "left")
    tops = tops.select("node", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(F.col("u_leaves")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("u_saved", F.lit(0))).alias("saved"), F.coalesce("ends_sha256", F.lit(_ends([]))).alias("ends_sha256"))
    tops = stored(tops, "trie-tops")
    sums = _summed(tops).select(F.col("node").alias("s_node"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    columns_ = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    least = tops.filter("depth = 0").first()
    least = F.lit(least.conv_id if least else None).cast("long")
    above = tops.filter("depth > 0").select(F.col("node").alias("p_node"), F.col("conv_id").alias("p_conv"))

    def with_parent(df: DataFrame) -> DataFrame:
        """The root holds most frontier nodes, so its id is a constant and no key of the join."""
        at_root, other = df.filter(F.col("parent") == root), df.filter(F.col("parent") != root)
        out = at_root.withColumn("parent_conv_id", least)
        return out if none else out.unionByName(other.join(above, F.col("parent") == F.col("p_node")).withColumn("parent_conv_id", F.col("p_conv")).drop("p_node", "p_conv"))

    tops = tops.select("node", "parent", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "ends_sha256").join(sums, F.col("node") == F.col("s_node"))
    top_rows = tops.filter("depth = 0").select(columns_).unionByName(with_parent(tops.filter("depth > 0")).select(columns_))
    return tries.filter("not frontier").select(columns_).unionByName(with_parent(tries.filter("frontier")).select(columns_)).unionByName(top_rows)
