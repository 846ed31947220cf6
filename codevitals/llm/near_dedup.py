"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set are the hashes of its distinct five-word shingles; its sketch are the ``K`` smallest. Equal sets form one
class. Inverted lists of retained values give the classes that can be similar: a pair of the wanted similarity shares at
least ``needed`` retained values (missed with a probability under 1e-8 where the sketch is not the whole set), so it
shares one among the rarest of either's values, and only those make lists. The sketches' union estimates the similarity and drops what cannot reach the
limit; intersections of the full sets decide.

Lists are not expanded into pairs. First, every member is compared with one pivot of its list, the class whose
values are the most common, which links the copies of one text. Pairs whose classes are in different components after that are
then compared in blocks of a list.

A text without words (null included) has an empty set, links with nothing and is its own component. Rows of one doc_id are one
document with several texts. Rows without a doc_id link with nothing; they have no component and are kept. Other
columns are passed on by ``keep_first``. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codevitals.llm.common import find_words, lower_ascii, slices
from codevitals.llm.components import components
from codevitals.session import stored

SHINGLE = 5
K = 64
#: Shared values of 64 that a pair of similarity 0.85 has but for a chance under 1e-8.
SURE = 34
LIMIT = 85  # percent
#: 64-bit words of the bit map of documents.
_MAP_WORDS = 1 << 20
#: Classes of a list that are compared with each other in one task.
BLOCK = 256
_MULTIPLIER, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def needed(n: int, k: int = K) -> int:
    """Retained values that a set of ``n`` shares with any set of similarity ``LIMIT``.

    A union of at most ``k`` values is retained whole; of a larger one, at most ``n * (100 - LIMIT) / LIMIT`` aren't shared.
    """
    whole, part = math.ceil(n * LIMIT / 100), k - n * (100 - LIMIT) // LIMIT
    return max(1, min(whole, part)) if n <= k else max(SURE, part)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct 63-bit hashes of the shingles of each text."""
    texts = [t or "" for t in texts]
    out: list[np.ndarray] = []
    for begin, end in slices(texts):
        docs = [find_words(lower_ascii(t)) for t in texts[begin:end]]
        index: dict[str, int] = {}
        codes = [[index.setdefault(w, len(index)) for w in words] for words in docs]
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in index), np.uint64, len(index))
        for code in codes:
            w = hashes[np.array(code, dtype=np.int64)]
            width = min(SHINGLE, len(w))
            h = np.full(max(0, len(w) - width + 1) if width else 0, width, dtype=np.uint64)
            for i in range(width):
                h = h * _MULTIPLIER + w[i: i + len(h)]
                h ^= h >> np.uint64(29)
            h = (h ^ (h >> np.uint64(30))) * _MIX1
            h = (h ^ (h >> np.uint64(27))) * _MIX2
            out.append(np.unique((h ^ (h >> np.uint64(31))) >> np.uint64(1)))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (128 bits that stand for the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist())
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                 pa.array([s[:K].astype(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, f1 long, f2 long, sketch array<long>")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """value, doc, n, weight: for each class (doc_id, n_shingles, sketch) its rarest retained values.

    ``weight`` grows with the other classes that hold its values.
    """
    values = classes.select("doc_id", "n_shingles", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = (values.join(common, "value").groupBy("doc_id", "n_shingles")
            .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"), F.sum("df").alias("weight")))  # K values at most
    # needed() as a column
    whole = F.ceil(F.col("n_shingles") * LIMIT / 100)
    part = K - F.floor(F.col("n_shingles") * (100 - LIMIT) / LIMIT)
    need = F.when(F.col("n_shingles") <= K, F.greatest(F.lit(1), F.least(whole, part))).otherwise(F.greatest(F.lit(SURE), part)).cast("int")
    held = held.withColumn("spare", F.size("v") - need).where("spare >= 0")
    rare = held.withColumn("v", F.slice("v", F.lit(1), F.col("spare") + 1))
    return rare.select(F.explode("v.value").alias("value"), F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "weight")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, set (63-bit hashes, little-endian) for the documents of ``wanted`` (doc).

    Texts aren't shuffled: a bit map of a fixed size, made from ``wanted``, drops nearly all other documents where
    they are read; a few that it lets through do no harm.
    """
    bits = F.xxhash64("doc")
    words = (wanted.select(F.pmod(F.shiftright(bits, 6), F.lit(_MAP_WORDS)).alias("w"), F.pmod(bits, F.lit(64)).cast("int").alias("b"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toPandas())  # 8 MB at most
    bitmap = np.zeros(_MAP_WORDS, dtype=np.int64)
    bitmap[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            batch = batch.filter(pa.array((shared.value[w] >> b) & 1 == 1))
            sets = shingle_sets(batch.column(1).to_pylist())
            keep = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["doc", "set"])

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    docs = docs.select("doc", "text", F.pmod(F.shiftright(bits, 6), F.lit(_MAP_WORDS)).alias("w"), F.pmod(bits, F.lit(64)).alias("b"))
    return docs.mapInArrow(run, "doc long, set binary").join(wanted, "doc", "left_semi")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar: the sketches' union estimates first, the full sets decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                union = np.union1d(x[:K], y[:K])[:K]
                shared = int((np.isin(union, x[:K], assume_unique=True) & np.isin(union, y[:K], assume_unique=True)).sum())
                common = 0
                if shared >= min(needed(len(x)), needed(len(y))):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= LIMIT * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("doc").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("set").alias("y"))
    return (pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
            .mapInArrow(run, "a long, b long"))


def blocks(members: DataFrame) -> DataFrame:
    """Deal the groups' members (pivot, doc, component, inside) to pairs of blocks: key, doc, component.

    ``inside``: in the pivot's component. Two such members needn't be compared, so blocks of others meet all blocks,
    and blocks of inside members only those of others.
    """
    sizes = members.groupBy("pivot").agg(
        F.ceil(F.count(F.when(~F.col("inside"), 1)) / BLOCK).alias("n_out"),
        F.ceil(F.count(F.when(F.col("inside"), 1)) / BLOCK).alias("n_in"),
        F.min("component").alias("least"), F.max("component").alias("most")).where("n_out > 0 and least <> most")
    # Blocks of others are numbered from 0, blocks of inside members go on from there.
    placed = members.join(sizes, "pivot").withColumn("h", F.xxhash64("doc"))
    block = F.when(F.col("inside"), F.col("n_out") + F.pmod("h", F.col("n_in"))).otherwise(F.pmod("h", F.col("n_out")))
    last = F.when(F.col("inside"), F.col("n_out")).otherwise(F.col("n_out") + F.col("n_in")) - 1
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return placed.select(
        "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc", "component")


def linked_in_blocks(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): components of which some documents in a pair of blocks are similar."""

    def run(rows: pa.Table) -> pa.Table:
        group = np.array(rows.column("component").to_pylist())
        docs = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
        size = np.array([len(x) for x in docs])
        values, column = np.unique(np.concatenate(docs), return_inverse=True)
        row = np.repeat(np.arange(len(docs)), size)
        shared = np.bincount(column, minlength=len(values)) > 1
        number = np.cumsum(shared) - 1
        kept = shared[column]
        row, column = row[kept], number[column[kept]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(docs), len(docs)), dtype=np.float32)
        for begin in range(0, int(shared.sum()), 8192):  # exact: counts stay far below 2^24
            low, high = np.searchsorted(column, [begin, begin + 8192])
            part = np.zeros((len(docs), 8192), dtype=np.float32)
            part[row[low:high], column[low:high] - begin] = 1
            common += part @ part.T
        common = common.astype(np.int64)
        linked = 100 * common >= LIMIT * (size[:, None] + size[None, :] - common)
        a, b = np.nonzero(linked & (group[:, None] > group[None, :]))
        pairs = np.unique(np.stack([group[a], group[b]], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return dealt.join(sets, "doc").groupBy("pivot", "i", "j").applyInArrow(run, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    seen = stored(sketches(docs), "sketches")
    named = seen.where("n_shingles > 0 and doc_id is not null")
    classes = stored(named.groupBy("f1", "f2").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    lists = stored(inverted_lists(classes), "lists")
    pivots = lists.groupBy("value").agg(F.max(F.struct("weight", "doc", "n")).alias("p"), F.count("*").alias("m")).where("m > 1")
    members = stored(lists.join(pivots, "value").where("doc <> p.doc")
                     .select(F.col("p.doc").alias("pivot"), F.col("p.n").alias("pivot_n"), "doc", "n").distinct(), "members")
    wanted = members.select("doc").unionAll(members.select("pivot")).distinct()
    sets = stored(full_sets(docs, wanted), "sets")
    near = members.where(f"100 * least(n, pivot_n) >= {LIMIT} * greatest(n, pivot_n)")
    links = stored(compared(near.select(F.col("doc").alias("a"), F.col("pivot").alias("b")), sets), "links")
    # Rows of one doc_id with several texts: the doc_id joins their classes.
    placed = named.select("doc_id", "n_shingles", "f1", "f2").join(
        classes.select("f1", "f2", F.col("doc_id").alias("class")), ["f1", "f2"])
    several = placed.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z").select("doc_id")
    same = placed.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    links = links.unionAll(same)
    first = stored(components(links), "components")
    of = first.select(F.col("node").alias("doc"), "component")
    rest = members.select("pivot", "doc").join(of, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    rest = rest.join(first.select(F.col("node").alias("pivot"), F.col("component").alias("own")), "pivot", "left")
    rest = rest.select("pivot", "doc", "component", (F.col("component") == F.coalesce("own", "pivot")).alias("inside"))
    more = linked_in_blocks(blocks(stored(rest, "rest")), sets)
    last = stored(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)), "components")
    placed = placed.join(last.select(F.col("node").alias("class"), "component"), "class", "left")
    known = placed.select("doc_id", "f1", "f2", F.coalesce("component", "class").alias("component"))
    # A class's component is that of all its documents; rows without a class stand alone.
    by_class = known.groupBy("f1", "f2").agg(F.min("component").alias("component"))
    out = seen.select("doc_id", "n_shingles", "f1", "f2").join(by_class, ["f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return (out.withColumn("component_id", component)
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents, all columns, but for those whose group has a smaller doc_id."""
    dropped = groups(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
