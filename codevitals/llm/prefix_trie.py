"""The trie of conversations, built from sorted shards and a skeleton of their borders.

A conversation is a path: for each turn, 128 bits that stand for its role and text. Paths are range-partitioned into shards. Only prefixes that the last path
of a shard shares with the first of the next can have members in several shards: these nodes (the root always) are the skeleton, a trie that is
broadcast. Every task streams its sorted shards once, with the open nodes of the current path on a stack; nodes outside the skeleton are finished there. Skeleton nodes leave partial
aggregates, which are summed, and are then finished from the deepest up.

A hot first turn, or a conversation copied many times, is spread over shards, because conversations of one path are sorted by conv_id. The skeleton is
bounded: beyond ``SKELETON`` nodes, shards are merged at the borders that share the longest prefixes (a task streams, so a larger
shard needs no more memory but for the nodes whose parent is still open). A conversation's path is one row of 24 bytes a turn; texts are not shuffled.

Turns are ordered by turn (null first), equal turns by their digests; a null role or text is empty. Rows without a conv_id belong to no conversation. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codevitals.session import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Every conversation begins as the one whose number is the next multiple of this below (or equal).
FAMILY = 20
#: Turns that a conversation may take over from it: below this.
HEADS = 4
#: Turns of a shard, about.
SHARD_TURNS = 200_000
#: Skeleton nodes that are broadcast at most.
SKELETON = 1 << 20
#: Ids of one row of a skeleton node's members that end there.
END_IDS = 100_000
ROWS = 2000  # of a batch

_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
         "skeleton int, parent_skeleton int, shard int, ends string")
_COLUMNS = [x.strip().split()[0] for x in _NODE.split(",")]


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path (array of turns' digests), words (array of their texts' words) of the turns (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), digest.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.col("t.key").alias("path"), F.col("t.words").alias("words"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """The conversations with their first turns replaced by those of their family's first conversation."""
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("first"), F.slice("path", 1, HEADS - 1).alias("head_path"), F.slice("words", 1, HEADS - 1).alias("head_words"))
    convs = (convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"))
             .withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "first", "left"))

    def joined(name: str) -> F.Column:
        head = F.when(F.col("h") > 0, F.slice(f"head_{name}", F.lit(1), F.col("h")))
        own = F.slice(name, F.col("h") + 1, F.greatest(F.size(name) - F.col("h"), F.lit(0)))
        return F.concat(F.coalesce(head, F.slice(name, 1, 0)), own).alias(name)

    return convs.select("conv_id", joined("path"), joined("words"))


def shared(a: list[bytes], b: list[bytes]) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class Skeleton:
    """The trie of the borders' common prefixes: node 0 is the root."""

    def __init__(self) -> None:
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.depth = [-1], [0]

    def add(self, path: list[bytes]) -> None:
        at = 0
        for key in path:
            if key not in self.children[at]:
                self.children[at][key] = len(self.parent)
                self.parent.append(at)
                self.depth.append(self.depth[at] + 1)
                self.children.append({})
            at = self.children[at][key]


def kept_borders(lengths: list[int], limit: int) -> list[bool]:
    """Which borders stay, so that their prefixes have at most ``limit`` turns in sum: the shortest first."""
    keep, total = [False] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        total += lengths[i]
        keep[i] = total <= limit
    return keep


def sharded(convs: DataFrame, shard_turns: int, limit: int) -> tuple[DataFrame, Skeleton]:
    """The conversations with a ``shard`` each (ranges of (path, conv_id)), and the skeleton of the borders."""
    turns = convs.agg(F.sum(F.size("path"))).first()[0] or 0
    n = max(int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns // shard_turns + 1)
    ranged = stored(convs.repartitionByRange(n, "path", "conv_id").withColumn("range", F.spark_partition_id()), "ranges")
    place = F.struct("path", "conv_id")
    ends = ranged.groupBy("range").agg(F.min(place).alias("a"), F.max(place).alias("z")).select("range", "a.path", F.col("z.path").alias("last"))
    skeleton, numbers, borders = Skeleton(), [], []
    last: list[bytes] | None = None
    for row in ends.orderBy("range").toLocalIterator():  # two paths a range, one at a time
        if last is not None:
            borders.append(row.path[:shared(last, row.path)])
        numbers.append(row.range)
        last = row.last
    keep = kept_borders([len(x) for x in borders], limit)
    shards, shard = [], 0
    for i, number in enumerate(numbers):
        if i and keep[i - 1]:
            skeleton.add(borders[i - 1])
            shard += 1
        shards.append((number, shard))
    of = F.broadcast(convs.sparkSession.createDataFrame(shards, "range int, shard int"))  # a row for each range
    return ranged.join(of, "range").drop("range"), skeleton


class Open:
    """A node whose members are being met."""

    __slots__ = ("children", "conv_id", "count", "digest", "ends", "first_child", "leaves", "saved", "skeleton", "words")

    def __init__(self, words: int, skeleton: int, first_child: int):
        self.words, self.skeleton, self.first_child = words, skeleton, first_child
        self.conv_id, self.count, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.digest, self.ends = None, []

    def end(self, conv_id: int) -> None:
        if self.skeleton >= 0:
            self.ends.append(str(conv_id))
        elif self.digest is None:
            self.digest = hashlib.sha256(str(conv_id).encode())
        else:
            self.digest.update(b",%d" % conv_id)


_NO_ENDS = hashlib.sha256(b"").hexdigest()


def scanned(rows: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Finished nodes of sorted shards, and what the shards know of skeleton nodes (``skeleton`` is its number)."""
    known = rows.sparkSession.sparkContext.broadcast(skeleton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = known.value
        stack: list[Open] = []
        waiting: list[list] = []  # finished nodes whose parent is open
        out: list[list] = []
        path: list[bytes] = []
        shard = -1

        def partial(node: Open, depth: int, ends: list[str]) -> list:
            return [node.conv_id, depth, None, node.count, node.children, node.leaves, node.saved, None, node.skeleton, None, shard, ",".join(ends) or None]

        def close() -> None:
            node, depth = stack.pop(), len(stack)
            mine = waiting[node.first_child:]
            del waiting[node.first_child:]
            parent = stack[-1] if stack else None
            if parent:
                parent.count += node.count
                if parent.conv_id is None or node.conv_id < parent.conv_id:
                    parent.conv_id = node.conv_id
            if node.skeleton >= 0:
                for row in mine:
                    row[9] = node.skeleton
                out.extend(mine)
                out.append(partial(node, depth, node.ends))
                return
            for row in mine:
                row[2] = node.conv_id
            out.extend(mine)
            leaves, saved = node.leaves or 1, node.saved + (node.count - 1) * node.words
            waiting.append([node.conv_id, depth, None, node.count, node.children, leaves, saved,
                            node.digest.hexdigest() if node.digest else _NO_ENDS, None, None, None, None])
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], _COLUMNS)
            out.clear()
            return made

        for rows in batches:
            for where, conv_id, keys, words in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if where != shard:
                    while stack:
                        close()
                    shard, path = where, []
                    stack.append(Open(0, 0, 0))
                same = shared(path, keys)
                while len(stack) > same + 1:
                    close()
                for i in range(same, len(keys)):
                    above = stack[-1].skeleton
                    stack.append(Open(words[i], trie.children[above].get(keys[i], -1) if above >= 0 else -1, len(waiting)))
                path, top = keys, stack[-1]
                top.count += 1
                if top.conv_id is None or conv_id < top.conv_id:
                    top.conv_id = conv_id
                top.end(conv_id)
                if len(top.ends) >= END_IDS:  # more than a row should hold: leave them now
                    row = partial(top, len(stack) - 1, top.ends)
                    row[3:7] = [0, 0, 0, 0]
                    out.append(row)
                    top.ends = []
                if len(out) >= ROWS:
                    yield batch()
        while stack:
            close()
        if out:
            yield batch()

    sorted_rows = rows.repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    return sorted_rows.select("shard", "conv_id", "path", "words").mapInArrow(run, _NODE)


def end_digests(partials: DataFrame) -> DataFrame:
    """skeleton, ends_sha256: ids in the shards' order are in ascending order, so a task streams them into one digest a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, str]] = []
        at, digest = None, None
        for batch in batches:
            for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != at:
                    if digest:
                        done.append((at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
        if digest:
            done.append((at, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.string())], ["skeleton", "ends_sha256"])

    first = F.substring_index("ends", ",", 1).cast("long")  # a shard may leave several rows
    rows = partials.where("ends is not null").select("skeleton", "shard", first.alias("first"), "ends")
    return rows.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "first").select("skeleton", "ends").mapInArrow(
        run, "skeleton int, ends_sha256 string")


def finished(skeleton: Skeleton, sums: dict[int, tuple[int, int, int, int, int]], ends: dict[int, str], words: dict[int, int]) -> list[tuple]:
    """The skeleton's nodes, children before parents; ``sums``: conv_id, n_convs, n_children, n_leaves, saved_tokens of shards."""
    children, leaves, saved = ({k: v[i] for k, v in sums.items()} for i in (2, 3, 4))
    out = []
    for node in range(len(skeleton.parent) - 1, -1, -1):  # numbered from the root down
        conv_id, n = sums[node][:2]
        if not children[node] and not leaves[node]:
            leaves[node] = 1
        saved[node] += (n - 1) * words.get(node, 0)
        parent = skeleton.parent[node]
        if parent >= 0:
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
        out.append((node, conv_id, skeleton.depth[node], sums[parent][0] if parent >= 0 else None, n, children[node], leaves[node],
                    saved[node], ends.get(node, _NO_ENDS)))
    return out


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS, limit: int = SKELETON) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node of the trie of ``convs`` (conv_id, path, words)."""
    rows, skeleton = sharded(convs, shard_turns, limit)
    nodes = stored(scanned(rows, skeleton), "nodes")
    partials = nodes.where("skeleton is not null")
    sums = partials.groupBy("skeleton").agg(*(f(c) for f, c in zip((F.min, F.sum, F.sum, F.sum, F.sum), (
        "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), strict=True)))
    spark = convs.sparkSession
    columns = _COLUMNS[:8]
    local = nodes.where("skeleton is null")
    got = {r[0]: tuple(r[1:]) for r in sums.collect()}  # at most ``limit`` rows, as the skeleton is
    if not got:
        return local.select(columns)
    ends = {r[0]: r[1] for r in end_digests(partials).collect()}
    # Words of a skeleton node's turn: any member has them.
    at = F.broadcast(spark.createDataFrame([(node, v[0], skeleton.depth[node]) for node, v in got.items() if node] or [(-1, -1, 1)],
                                           "skeleton int, conv_id long, depth int"))
    words = {r[0]: r[1] for r in rows.join(at, "conv_id").select("skeleton", F.element_at("words", F.col("depth"))).collect()}
    top = spark.createDataFrame(finished(skeleton, got, ends, words), "skeleton int, " + ", ".join(_NODE.split(", ")[:8]))
    above = F.broadcast(top.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("above")))
    local = local.join(above, "parent_skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return local.select(columns).unionAll(top.select(columns))
