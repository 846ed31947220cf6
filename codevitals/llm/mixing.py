"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs to). Each pattern can send its words once
at no cost, and again at a cost that grows with each repetition; sources take what their quotas ask. The flow that meets
the quotas at the least cost says how many words each pattern gives to each source; then whole documents of every pattern are chosen by a
seeded hash, the same share of each size class, until their words come nearest to the flow.

Only totals by pattern and by (pattern, size class, hash bucket) leave the executors. A null text has size 0 and is taken
0 words; a null source is a source of its own, last in order; rows with equal doc_id and size have the same hash and share their fate
as far as the quota allows. Other columns are not looked at. An empty table has no quotas and gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codevitals.llm.common import WORD

BUCKETS = 256
EPOCHS = 2
SEED = 7


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sizes: dict[str | None, int], share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2),
           at_most: float = 2.0) -> dict[str | None, float]:
    """Targets of the sources, by code point with null last: ``share`` of all sizes by weight, none above
    ``at_most`` times its source's size; the excess is shared by the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), dict.fromkeys(order, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > at_most * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = at_most * sizes[s]
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    return out


@dataclass
class _Edge:
    to: int
    room: float
    cost: float
    back: int


class Network:
    """Min-cost flow by successive cheapest paths (Dijkstra with potentials)."""

    def __init__(self, n: int):
        self.edges: list[list[_Edge]] = [[] for _ in range(n)]

    def connect(self, a: int, b: int, room: float, cost: float) -> tuple[int, int]:
        self.edges[a].append(_Edge(b, room, cost, len(self.edges[b])))
        self.edges[b].append(_Edge(a, 0.0, -cost, len(self.edges[a]) - 1))
        return a, len(self.edges[a]) - 1

    def run(self, source: int, sink: int, least: float) -> None:
        n = len(self.edges)
        height = [0.0] * n
        while True:
            far, via = [np.inf] * n, [None] * n
            far[source], queue = 0.0, [(0.0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > far[a]:
                    continue
                for i, e in enumerate(self.edges[a]):
                    step = d + max(0.0, e.cost + height[a] - height[e.to])
                    if e.room > least and step < far[e.to] - 1e-12:
                        far[e.to], via[e.to] = step, (a, i)
                        heapq.heappush(queue, (step, e.to))
            if far[sink] == np.inf:
                return
            height = [h + (d if d < np.inf else 0.0) for h, d in zip(height, far, strict=True)]
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = via[at][0]
            amount = min(self.edges[a][i].room for a, i in path)
            for a, i in path:
                e = self.edges[a][i]
                e.room -= amount
                self.edges[e.to][e.back].room += amount


def route(patterns: list[tuple[tuple, int]], targets: dict[str | None, float], epochs: int = EPOCHS) -> list[float]:
    """Words that each (members, size) pattern gives, its words being used up to ``epochs`` times in all.

    The k-th repetition costs k, so first uses are spent before second ones wherever sources overlap.
    """
    names = list(targets)
    at = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    net, given = Network(2 + len(patterns) + len(names)), []
    for i, (members, size) in enumerate(patterns):
        given.append([net.connect(0, 2 + i, float(size), float(k)) for k in range(epochs)])
        for s in members:
            if s in at:
                net.connect(2 + i, at[s], float(size * epochs), 0.0)
    for s, t in targets.items():
        net.connect(at[s], 1, t, 0.0)
    net.run(0, 1, least=1e-6)
    return [sum(size - net.edges[a][i].room for a, i in edges) for (_, size), edges in zip(patterns, given, strict=True)]


@dataclass
class Choice:
    """How often the documents of each pattern are used; ``times`` applies it to any frame of theirs."""

    cuts: list[tuple]  # pattern, size class, uses of all its documents, first bucket that isn't used once more
    seed: int = SEED

    def times(self, docs: DataFrame) -> DataFrame:
        """``docs`` (with doc_id, size, pattern) with ``times``."""
        # A row for each pattern and size class.
        cuts = docs.sparkSession.createDataFrame(self.cuts, "pattern string, _class int, _times int, _edge int")
        docs = docs.withColumns(_placed(self.seed)).join(F.broadcast(cuts), ["pattern", "_class"])
        more = F.when((F.col("_bucket") < F.col("_edge")) & (F.col("size") > 0), 1).otherwise(0)
        return docs.withColumn("times", F.col("_times") + more).drop("_class", "_bucket", "_times", "_edge")


def _placed(seed: int) -> dict[str, Column]:
    """The size class (binary digits of the size) and the hash bucket of a document."""
    return {"_class": F.length(F.bin("size")).cast("int"),
            "_bucket": F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(BUCKETS)).cast("int")}


def choose(docs: DataFrame, flows: dict[str, tuple[int, float]], seed: int = SEED) -> Choice:
    """Documents of ``docs`` (doc_id, size, pattern) whose words come near the flows.

    ``flows``: for each pattern its size and the words it gives. All documents are used ``flow // size`` times, and the same
    share of every size class once more: hash buckets in order, as many as come nearest. What a class misses or exceeds is
    made up for by the next smaller one, so the last error is a part of the smallest documents.
    """
    sums = docs.withColumns(_placed(seed)).groupBy("pattern", "_class", "_bucket").agg(F.sum("size").alias("n"))
    cuts = []
    # At most BUCKETS rows for each pattern and size class.
    for pattern, rows in sums.toPandas().groupby("pattern", sort=True):
        size, flow = flows[pattern]
        times, more = divmod(round(flow), size) if size else (0, 0)
        carried = 0.0
        for kind in sorted(rows["_class"].unique(), reverse=True):
            part = rows[rows["_class"] == kind].sort_values("_bucket")
            wanted = carried + (part["n"].sum() * more / size if size else 0)
            reached = np.concatenate([[0], part["n"].cumsum().to_numpy()])
            k = int(np.abs(reached - wanted).argmin())
            carried = wanted - reached[k]
            cuts.append((pattern, int(kind), times, int(part["_bucket"].iloc[k]) if k < len(part) else BUCKETS))
    return Choice(cuts, seed)


def with_pattern(docs: DataFrame, members: Column) -> DataFrame:
    """``pattern``: the sources of a document, in order, as text."""
    sources = F.array_sort(F.array_distinct(F.coalesce(members, F.array(F.lit(None).cast("string")))))
    return docs.withColumns({"members": sources, "pattern": F.to_json(F.struct(sources.alias("m")))})


def mix(docs: DataFrame, **options: float) -> tuple[Choice, dict[str | None, int], dict[str | None, float]]:
    """The choice for ``docs`` (doc_id, size, members, pattern), and each source's size and target.

    ``docs`` should be stored, as it is read several times; ``options`` go to ``quotas``.
    """
    totals = docs.groupBy("pattern").agg(F.first("members").alias("m"), F.sum("size").alias("n")).orderBy("pattern").collect()
    sizes = source_sizes([(r.m, r.n) for r in totals])
    targets = quotas(sizes, **options)
    flows = route([(tuple(r.m), r.n) for r in totals], targets)
    return choose(docs, {r.pattern: (r.n, f) for r, f in zip(totals, flows, strict=True)}), sizes, targets


def source_sizes(totals: list[tuple[list, int]]) -> dict[str | None, int]:
    """Words of each source, from (members, size) of the patterns."""
    out: dict[str | None, int] = {}
    for members, size in totals:
        for s in dict.fromkeys(members):
            out[s] = out.get(s, 0) + size
    return out
