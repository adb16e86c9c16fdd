"""Trie of conversation prefixes, held as a z-fast trie in tables.

A node is known by its depth and a 128-bit hash of the turns that lead to it. Only compacted nodes are
held: where conversations end or part. Each is entered under the hash of its handle, the prefix whose
depth is the number with most trailing zero bits on the node's edge, so a conversation finds the node
where it leaves the trie by a binary search over depths, one join a step, whatever the trie's height.

Conversations are inserted in batches. All that leave at the same place with the same next turn form a
group; a bounded number of each group enters at once, the others look again in the next round, when
the group has fallen apart into as many places. At last the edges are expanded to all prefixes.

Prefix hashes are the exclusive or of a hash of each turn with its depth. Long conversations are cut at
depths that are multiples of ``slab``; these depths are the last that any search would pass over, and
their nodes are always explicit, so that each slab is searched on its own and arrays stay bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Store, slices, whole_text

ROOT = "named_struct('d', 0L, 'x', 0L, 'y', 0L)"
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ["at", "top", "rep", "fat", "first"]
#: Steps of searches inside a slab, which is no longer than this.
STEPS = f"array({', '.join(f'{1 << k}L' for k in reversed(range(24)))})"


def prefix(depth: str, of: str = "") -> str:
    """The node at ``depth`` on a row's path, of which the arrays ``xs`` and ``ys`` hold the hashes from depth ``lo`` on."""
    at = f"CAST({depth} - {of}lo AS INT)"
    return f"named_struct('d', {depth}, 'x', {of}xs[{at}], 'y', {of}ys[{at}])"


def fattest(low: str, high: str) -> str:
    """The number in (low, high] that is a multiple of the largest power of two."""
    bits = f"(length(bin({low} ^ {high})) - 1)"
    return f"shiftleft(shiftright({high}, {bits}), {bits})"


def node(up: str, depth: str) -> list[str]:
    """A compacted node on a row's path: itself, its parent, and the two prefixes by which it is looked up."""
    return [f"{prefix(depth)} AS at", f"{prefix(up)} AS top", f"{prefix(fattest(up, depth))} AS fat", f"{prefix(f'({up} + 1)')} AS first"]


def fat_number(low: int, high: int) -> int:
    """``fattest`` for Python's numbers."""
    bits = (low ^ high).bit_length() - 1
    return high >> bits << bits


def compact(paths: list[tuple[list[int], list[int]]], lo: int, top: int) -> list[tuple[int, int, int]]:
    """(depth, parent's depth, path) of the compacted nodes below ``top`` of a few paths that share its first turn below."""
    order = sorted(range(len(paths)), key=lambda i: paths[i])
    stack, out = [(top, -1)], []
    before: tuple[list[int], list[int]] | None = None
    for i in order:
        xs, ys = paths[i]
        if before is not None:
            common, end = top, lo + min(len(xs), len(before[0])) - 1
            while common < end and xs[common + 1 - lo] == before[0][common + 1 - lo] and ys[common + 1 - lo] == before[1][common + 1 - lo]:
                common += 1
            while stack[-1][0] > common:
                depth, of = stack.pop()
                out.append((depth, max(stack[-1][0], common), of))
            if stack[-1][0] < common:
                stack.append((common, i))
        if stack[-1][0] < lo + len(xs) - 1:
            stack.append((lo + len(xs) - 1, i))
        before = paths[i]
    while len(stack) > 1:
        depth, of = stack.pop()
        out.append((depth, stack[-1][0], of))
    return out


def numbered(store: Store, turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest, chars for rows (conv_id, turn, role, text).

    Rows are sorted in ranges that cut any conversation, by turn, null first; rows of one turn number by role, then
    by a hash of the text. Null roles and texts are empty. Rows without a conv_id belong to no conversation.
    """
    role, text = whole_text("role"), whole_text("text")
    digest = F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = store.write(rows.select("conv_id", "digest", "chars", F.monotonically_increasing_id().alias("number")), "turns").withColumn("part", F.expr("shiftright(number, 33)"))
    runs = rows.groupBy("conv_id", "part").agg(F.min("number").alias("least"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = rows.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("number") - F.col("least") + F.col("before")).alias("place"), "digest", "chars")
    return store.write(placed, "numbered")


def forked(store: Store, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as forks of the first of their hundred, and the ids of all: the input of op11's contract.

    (conv_id, depth, digest, chars) and (conv_id, length). Conversation c has the first h turns of conversation c - c % 100,
    as far as there are any, then its own behind its first h; h is the CRC32 of its id modulo 6.
    """
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = counts.withColumn("base", F.expr("conv_id - conv_id % 100")).withColumn("h", F.expr("crc32(encode(CAST(conv_id AS STRING), 'UTF-8')) % 6"))
    plan = plan.join(heads, "base", "left").withColumn("kept", F.expr("least(h, coalesce(base_n, 0L))"))
    plan = store.write(plan.select("conv_id", "base", "h", "kept", F.expr("kept + greatest(n - h, 0L)").alias("length")), "forks")
    own = turns.join(plan.select("conv_id", "h", "kept"), "conv_id").filter("place >= h").select("conv_id", F.expr("kept + place - h + 1").alias("depth"), "digest", "chars")
    first = turns.filter("place < 5").select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    taken = plan.filter("kept > 0").join(first, "base").filter("place < kept").select("conv_id", F.expr("place + 1").alias("depth"), "digest", "chars")
    return own.unionByName(taken), plan.select("conv_id", "length")


@dataclass(frozen=True)
class ConversationTrie:
    """``slab``: turns of a path searched at a time, a power of two. ``entering``: conversations of a group that enter
    the trie in a round. ``first``: the first batch is one path in so many; the second batch is the rest."""

    slab: int = 1024
    entering: int = 512
    first: int = 16

    def paths(self, store: Store, turns: DataFrame, lengths: DataFrame) -> DataFrame:
        """conv_id, lo, at, xs, ys, ls for each slab of each conversation that has turns: hashes and summed code points at all depths from ``lo``."""
        rows = turns.select("conv_id", "depth", F.expr(f"(depth - 1) div {self.slab} * {self.slab}").alias("lo"), F.xxhash64("digest", "depth").alias("x"), F.xxhash64("depth", "digest", F.lit(1)).alias("y"), "chars")
        so_far = Window.partitionBy("conv_id", "lo").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.select("conv_id", "lo", "depth", F.bit_xor("x").over(so_far).alias("x"), F.bit_xor("y").over(so_far).alias("y"), F.sum("chars").over(so_far).alias("l"))
        slabs = rows.groupBy("conv_id", "lo").agg(F.sort_array(F.collect_list(F.struct("depth", "x", "y", "l"))).alias("steps"))
        slabs = store.write(slabs, "slabs")
        long = lengths.filter(F.col("length") > self.slab).select("conv_id")
        ends = slabs.select("conv_id", "lo", F.expr("element_at(steps, -1)").alias("end")).join(long, "conv_id", "left_semi")
        before = Window.partitionBy("conv_id").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("conv_id", "lo", F.bit_xor("end.x").over(before).alias("x"), F.bit_xor("end.y").over(before).alias("y"), F.sum("end.l").over(before).alias("l"))
        slabs = slabs.join(ends, ["conv_id", "lo"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("x", "y", "l")})
        slabs = slabs.select(
            "conv_id", "lo", F.expr("concat(array(x), transform(steps, s -> s.x ^ x))").alias("xs"), F.expr("concat(array(y), transform(steps, s -> s.y ^ y))").alias("ys"),
            F.expr("concat(array(l), transform(steps, s -> s.l + l))").alias("ls"))
        return store.write(slabs.withColumn("at", F.expr(prefix("(lo + size(xs) - 1)"))), "paths")

    def locate(self, pending: DataFrame, nodes: DataFrame, strings: DataFrame, steps: int) -> DataFrame:
        """Adds low, the depth to which a path agrees with the trie, and exit, the node on whose edge it leaves; none if it leaves at a node."""
        rows = pending.withColumns({"low": F.col("lo"), "high": F.expr("lo + size(xs) - 1"), "exit": F.lit(None).cast(nodes.schema["at"].dataType)})
        handles = nodes.select(F.col("fat").alias("asked"), F.col("at").alias("found"))
        for _ in range(steps):
            rows = rows.withColumn("f", F.expr(f"IF(exit IS NULL AND low < high, {fattest('low', 'high')}, NULL)"))
            rows = rows.withColumn("asked", F.expr(f"IF(f IS NULL, named_struct('d', -1L, 'x', at.x, 'y', at.y), {prefix('f')})")).join(handles, "asked", "left")
            # The handle agrees; the whole node may not, then it is the one on whose edge the path leaves.
            agrees = "found.d <= lo + size(xs) - 1 AND get(xs, CAST(found.d - lo AS INT)) = found.x AND get(ys, CAST(found.d - lo AS INT)) = found.y"
            rows = rows.withColumn("agrees", F.expr(f"coalesce({agrees}, false)"))
            rows = rows.withColumns({
                "low": F.expr("IF(found IS NOT NULL AND agrees, found.d, low)"), "exit": F.expr("IF(found IS NOT NULL AND NOT agrees, found, exit)"),
                "high": F.expr("IF(found IS NULL AND f IS NOT NULL, f - 1, high)")}).drop("asked", "found", "f", "agrees")
        # No handle of a child of the last node agrees, but the child may share turns above its handle.
        firsts = nodes.select(F.col("first").alias("asked"), F.col("at").alias("found"))
        rows = rows.withColumn("asked", F.expr(f"IF(exit IS NULL AND low < lo + size(xs) - 1, {prefix('(low + 1)')}, named_struct('d', -1L, 'x', at.x, 'y', at.y))"))
        rows = rows.join(firsts, "asked", "left").withColumn("exit", F.coalesce("exit", "found")).select(*pending.columns, "low", "exit")
        reps = nodes.select(F.col("at").alias("exit"), "rep").join(strings.select(F.col("at").alias("rep"), F.col("xs").alias("their_xs"), F.col("ys").alias("their_ys")), "rep").drop("rep")
        open_ = rows.filter("exit IS NOT NULL").join(reps, "exit")
        same = " AND ".join(f"get({c}, CAST(l + step - lo AS INT)) = get(their_{c}, CAST(l + step - lo AS INT))" for c in ("xs", "ys"))
        open_ = open_.withColumn("low", F.expr(f"aggregate({STEPS}, low, (l, step) -> IF({same}, l + step, l))"))
        return open_.select(*pending.columns, F.expr("least(low, exit.d)").alias("low"), "exit").unionByName(rows.filter("exit IS NULL"))

    def enter(self, located: DataFrame) -> DataFrame:
        """New nodes of the paths that leave at the same place with the same next turn; few enough of them for one task."""

        def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, members = None, []
            for part in slices(batches):
                for row in part.to_pylist():
                    key = (row["low"], row["next"]["x"], row["next"]["y"])
                    if key != group:
                        if members:
                            yield told(members)
                        group, members = key, []
                    members.append(row)
            if members:
                yield told(members)

        def told(members: list[dict]) -> pa.RecordBatch:
            lo, out = members[0]["lo"], []
            for depth, up, i in compact([(m["xs"], m["ys"]) for m in members], lo, members[0]["low"]):
                xs, ys = members[i]["xs"], members[i]["ys"]
                at, top, fat, first = ({"d": d, "x": xs[d - lo], "y": ys[d - lo]} for d in (depth, up, fat_number(up, depth), up + 1))
                out.append({"at": at, "top": top, "rep": members[i]["at"], "fat": fat, "first": first})
            place = pa.struct([(c, pa.int64()) for c in "dxy"])
            return pa.RecordBatch.from_pylist(out, pa.schema([(c, place) for c in NODE]))

        place = "struct<d:bigint,x:bigint,y:bigint>"
        rows = located.select("low", "next", "lo", "xs", "ys", "at").repartition("next").sortWithinPartitions("next")
        return rows.mapInArrow(built, ", ".join(f"{c} {place}" for c in NODE))

    def grow(self, store: Store, strings: DataFrame) -> DataFrame | None:
        """The compacted nodes below the root for paths that differ in ``at``; None if there are none."""
        longest = strings.agg(F.max(F.size("xs") - 1)).first()[0]
        if longest is None:
            return None
        nodes = None
        share = F.pmod(F.xxhash64("at"), F.lit(self.first)) == 0
        for batch in (strings.filter(share), strings.filter(~share)):
            pending = batch.select("at", "lo", "xs", "ys")
            while not pending.isEmpty():
                if nodes is None:
                    located = pending.withColumns({"low": F.col("lo"), "exit": F.lit(None).cast(pending.schema["at"].dataType)})
                else:
                    located = self.locate(pending, nodes, strings, int(longest).bit_length())
                located = store.write(located, "located")
                rest = located.filter("low < lo + size(xs) - 1").withColumn("next", F.expr(prefix("(low + 1)")))
                turn = Window.partitionBy("next").orderBy(F.xxhash64("at"), "at")
                # A path that agrees with all of the node on whose edge it should leave looks again.
                rest = rest.filter("exit IS NULL OR low < exit.d")
                entering = rest.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= self.entering)
                entering = store.write(entering.select("at", "lo", "xs", "ys", "low", "next"), "entering")
                new = self.enter(entering)
                if nodes is not None:
                    cuts = located.filter("exit IS NOT NULL AND low < exit.d").groupBy(F.col("exit").alias("at")).agg(F.sort_array(F.collect_set("low")).alias("cuts"))
                    cuts = store.write(cuts, "cuts")  # at most as many depths as a slab has
                    chain = nodes.join(cuts, "at").withColumn("borders", F.expr("concat(array(top.d), cuts, array(at.d))"))
                    chain = chain.select("rep", F.expr("inline(transform(sequence(1, size(borders) - 1), i -> struct(borders[i - 1] AS up, borders[i] AS depth)))"))
                    chain = chain.join(strings.select(F.col("at").alias("rep"), "lo", "xs", "ys"), "rep").selectExpr("rep", *node("up", "depth"))
                    new = nodes.join(cuts, "at", "left_anti").select(*NODE).unionByName(chain.select(*NODE)).unionByName(new)
                nodes = store.write(new, "nodes")
                waiting = located.filter("low < lo + size(xs) - 1").join(entering.select("at"), "at", "left_anti")
                pending = store.write(waiting.select("at", "lo", "xs", "ys"), "pending")
        return nodes

    def ends(self, store: Store, placed: DataFrame) -> DataFrame:
        """at, n, least, ends_sha256 for the nodes (at) at which conversations (conv_id) end.

        Ids are sorted in ranges that cut any node; stretches of them are printed where they lie, and the stretches
        of a node are hashed one after the other.
        """

        def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ids = None, []
            for part in slices(batches, 4096):
                for here, conv_id in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if here != at or len(ids) == 4096:
                        if ids:
                            yield stretch(at, ids)
                        at, ids = here, []
                    ids.append(conv_id)
            if ids:
                yield stretch(at, ids)

        def stretch(at: dict, ids: list[int]) -> pa.RecordBatch:
            place = pa.struct([(c, pa.int64()) for c in "dxy"])
            columns = [pa.array([at], place), pa.array([ids[0]]), pa.array([len(ids)]), pa.array([",".join(map(str, ids))])]
            return pa.RecordBatch.from_arrays(columns, ["at", "least", "n", "ids"])

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, state = None, None
            for part in slices(batches, 64):
                for row in part.to_pylist():
                    if row["at"] != at:
                        if state:
                            yield told(at, state)
                        at, state = row["at"], [0, row["least"], hashlib.sha256()]
                    state[2].update((b"," if state[0] else b"") + row["ids"].encode())
                    state[0] += row["n"]
            if state:
                yield told(at, state)

        def told(at: dict, state: list) -> pa.RecordBatch:
            place = pa.struct([(c, pa.int64()) for c in "dxy"])
            return pa.RecordBatch.from_arrays([pa.array([at], place), pa.array([state[0]]), pa.array([state[1]]), pa.array([state[2].hexdigest()])], ["at", "n", "least", "ends_sha256"])

        place = "at struct<d:bigint,x:bigint,y:bigint>"
        rows = placed.repartitionByRange("at", "conv_id").sortWithinPartitions("at", "conv_id").select("at", "conv_id").mapInArrow(printed, f"{place}, least long, n long, ids string")
        rows = rows.repartition("at").sortWithinPartitions("at", "least").mapInArrow(hashed, f"{place}, n long, least long, ends_sha256 string")
        return store.write(rows, "ends")

    def summed(self, store: Store, tree: DataFrame) -> DataFrame:
        """at, n, least, nl, w, leaves of whole subtrees, by following parents 1, 2, 4 ... at a time."""
        sums = {"n": F.sum, "nl": F.sum, "w": F.sum, "leaves": F.sum, "least": F.min}
        nowhere = F.expr("named_struct('d', -1L, 'x', at.x, 'y', at.y)")
        rows = store.write(tree.select("at", F.coalesce("top", nowhere).alias("top"), *sums), "sums")
        while not rows.filter("top.d >= 0").isEmpty():
            below = rows.filter("top.d >= 0").groupBy(F.col("top").alias("at")).agg(*[f(c).alias(f"more_{c}") for c, f in sums.items()])
            above = rows.select(F.col("at").alias("top"), F.col("top").alias("above"))
            added = {c: (F.least(c, f"more_{c}") if c == "least" else F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums}
            rows = rows.join(below, "at", "left").select("at", "top", *added.values())
            rows = store.write(rows.join(above, "top", "left").select("at", F.coalesce("above", nowhere).alias("top"), *sums), "sums")
        return rows.drop("top")

    def build(self, turns: DataFrame, lengths: DataFrame, store: Store) -> DataFrame:
        """One row for each different prefix of the conversations (conv_id, depth from 1, digest, chars), the empty one included.

        ``lengths``: (conv_id, length) of all conversations, those without turns too; without any the result is empty.
        conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
        """
        lengths = store.write(lengths, "lengths")
        paths = self.paths(store, turns, lengths)
        last = paths.select("conv_id", "at").join(lengths, "conv_id").filter("at.d = length").select("conv_id", "at")
        ends = self.ends(store, last.unionByName(lengths.filter("length = 0").select("conv_id", F.expr(ROOT).alias("at"))))
        strings = store.write(paths.groupBy("at").agg(*[F.first(c).alias(c) for c in ("lo", "xs", "ys", "ls")]), "strings")
        nodes = self.grow(store, strings)
        root = lengths.limit(1).select(F.expr(ROOT).alias("at"), F.lit(None).cast("struct<d:bigint,x:bigint,y:bigint>").alias("top"), F.expr("array(0L)").alias("summed"))
        tree = root
        if nodes is not None:
            edges = nodes.select("at", "top", "rep").join(strings.select(F.col("at").alias("rep"), "lo", "ls"), "rep")
            tree = root.unionByName(edges.select("at", "top", F.expr("slice(ls, CAST(top.d - lo + 1 AS INT), CAST(at.d - top.d + 1 AS INT))").alias("summed")))
        tree = store.write(tree, "tree")
        children = tree.filter("top IS NOT NULL").groupBy(F.col("top").alias("at")).agg(F.count("*").alias("children"))
        tree = tree.join(children, "at", "left").join(ends, "at", "left").withColumns({"children": F.expr("coalesce(children, 0L)"), "n": F.expr("coalesce(n, 0L)")})
        tree = tree.withColumns({"nl": F.expr("n * element_at(summed, -1)"), "w": F.expr("element_at(summed, -1) - summed[0]"), "leaves": F.expr("CAST(children = 0 AS BIGINT)")})
        tree = store.write(tree, "nodes")
        sums = self.summed(store, tree)
        whole = tree.select("at", "top", "summed", "children", "ends_sha256").join(sums, "at")
        whole = whole.join(sums.select(F.col("at").alias("top"), F.col("least").alias("parent")), "top", "left")
        return self.expanded(whole)

    def expanded(self, whole: DataFrame) -> DataFrame:
        """A row for every depth on a node's edge. Conversations end and part at the node alone; the code points above a depth are not saved below it."""
        rows = whole.select("*", F.explode(F.expr("IF(top IS NULL, array(0L), sequence(top.d + 1, at.d))")).alias("depth"))
        above: Column = F.expr("IF(top IS NULL, 0L, summed[CAST(depth - 1 - top.d AS INT)])")
        rows = rows.withColumn("above", above)
        return rows.select(
            F.col("least").alias("conv_id"), "depth", F.expr("CASE WHEN top IS NULL THEN NULL WHEN depth = top.d + 1 THEN parent ELSE least END").alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.expr("IF(depth = at.d, children, 1L)").alias("n_children"), F.col("leaves").alias("n_leaves"),
            F.expr("(nl - n * above) - (w - (above - summed[0]))").alias("saved_tokens"), F.expr(f"IF(depth = at.d, coalesce(ends_sha256, '{NOTHING}'), '{NOTHING}')").alias("ends_sha256"))
