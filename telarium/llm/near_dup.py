"""Near duplicates: MinHash signatures and a multi-index Hamming join.

A document is the set of its distinct 5-word shingles. Its signature has 48
symbols of 16 bits, each the low bits of a minimum under one permutation; two
documents of similarity s differ in a symbol with probability 1 - s. The
signature is split into 12 chunks of 4 symbols. Two signatures that differ in
at most 23 symbols have, by pigeonhole, a chunk with at most one differing
symbol, so a key for each chunk and each symbol left out of it (48 keys) finds
*every* pair under the distance; at similarity 0.75 a pair that shares no key
at all has probability 1e-7. Candidates are confirmed on full sets.

Shape of the job, none of whose steps grows with the square of a group:

1. Texts with equal sets become one class (an aggregate; copies cost nothing).
   Classes are numbered in the order of their least ``doc_id``.
2. Each class is tested with the one bucket leader it meets most often; the
   leader is the class with most company, near the middle of its group.
3. What is linked becomes one component; only pairs of *different* components
   in a bucket remain, in blocks of bounded size.
   Two bounds rule out pairs before the sets are compared, and both are exact:
   shingles that no other remaining class has can't be shared, and two sets
   differ in at least as many shingles as their parity maps differ in bits.

Defined cases: null or empty text has an empty set and no link. A null
``doc_id`` is never linked (``component_id`` null, kept). Rows are what is
linked: a ``doc_id`` with several texts has each text in its own component.
Repeated rows are linked with each other and each is returned. A text of any
length is one set. Other columns are ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telarium.llm.common import blocks, cut, text_hash
from telarium.llm.words import mix, shingle_sets

SHINGLE = 5
CHUNKS, CHUNK = 12, 4
SYMBOLS = CHUNKS * CHUNK
DISTANCE = 2 * CHUNKS - 1
#: Bits of a parity map.
PARITY_BITS = 1 << 10
#: Classes of a bucket that one task compares with the bucket.
BUCKET_BLOCK = 2000
#: At most so many nodes count as hubs of the links; they are sent to tasks.
HUBS = 10_000

#: Up to so many ids or pairs (16 bytes each) are sent to the tasks; more are joined by a shuffle.
SENT = 1_000_000

_rng = np.random.default_rng(75)
_FLIP = _rng.integers(0, 2**64, SYMBOLS, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SYMBOLS 16-bit symbols for each set; an empty set has zeros."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        values = np.concatenate([sets[i] for i in full])
        heads = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for j in range(SYMBOLS):
            least = np.minimum.reduceat((values ^ _FLIP[j]) * _TIMES[j], heads)
            out[full, j] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    """A row of a matrix of 64-bit numbers as a list."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def _sums(members: np.ndarray) -> tuple[int, int]:
    """Two sums that tell sets apart, beside their size."""
    return int(members.sum(dtype=np.uint64).astype(np.int64)), int(mix(members ^ _FLIP[0]).sum(dtype=np.uint64).astype(np.int64))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, raw, offsets in blocks(batches):
        sets = shingle_sets(raw, offsets, SHINGLE)
        sigs = signatures(sets)
        sums = [_sums(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("part"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[i] for x in sums], pa.int64()) for i in (0, 1)), _lists(sigs.view(np.int64))],
            names=["doc_id", "part", "n_shingles", "set_a", "set_b", "sig"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """48 keys for each class: a chunk with one of its symbols left out."""
    for batch in batches:
        if not len(batch):
            continue
        sig = batch.column("sig").flatten().to_numpy().view(np.uint16).reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
        n = len(sig)
        keys = np.empty((n, SYMBOLS), np.uint64)
        slots = np.tile(np.arange(SYMBOLS, dtype=np.int32), n)
        for chunk in range(CHUNKS):
            for out in range(CHUNK):
                packed = np.zeros(n, np.uint64)
                for j in range(CHUNK):
                    packed = packed * np.uint64(65536) + (sig[:, chunk, j] if j != out else np.uint64(0))
                keys[:, chunk * CHUNK + out] = mix(packed ^ _KEY[chunk * CHUNK + out])
        ids, size = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), SYMBOLS) for c in ("id", "n"))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids), pa.array(size), pa.array(slots)], names=["key", "id", "n", "slot"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text that has the sums of its class; another text of the same doc_id has not."""
    for rows, raw, offsets in blocks(batches):
        sets = shingle_sets(raw, offsets, SHINGLE)
        wanted = zip(rows.column("set_a").to_pylist(), rows.column("set_b").to_pylist(), strict=True)
        own = [i for i, sums in enumerate(wanted) if _sums(sets[i]) == sums]
        yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(own, pa.int64())), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["id", "members"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            each = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("members")]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("id").to_numpy(), [len(x) for x in each])), pa.array(np.concatenate(each))], names=["id", "shingle"])


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PARITY_BITS bits for each set: whether an odd number of its shingles falls on a bit.

    A shingle of only one of two sets flips one bit, so the sets differ in at
    least as many shingles as their maps differ in bits.
    """
    for batch in batches:
        for at in range(0, len(batch), 128):
            part = batch.slice(at, 128)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("members")]
            place = (np.concatenate(sets) % np.uint64(PARITY_BITS)).astype(np.int64) + np.repeat(np.arange(len(sets)) * PARITY_BITS, [len(s) for s in sets])
            odd = (np.bincount(place, minlength=len(sets) * PARITY_BITS) & 1).astype(np.uint8).reshape(len(sets), PARITY_BITS)
            packed = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(packed.shape[1]))], names=["id", *(f"w{i}" for i in range(packed.shape[1]))])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets have 100 * |intersection| >= 75 * |union|."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= 75 * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _distance(p: str, q: str) -> Column:
    """Number of bits in which two parity maps differ."""
    out = None
    for i in range(PARITY_BITS // 64):
        bits = F.bit_count(F.col(f"{p}.w{i}").bitwiseXOR(F.col(f"{q}.w{i}")))
        out = bits if out is None else out + bits
    return out


def _first_slot(p: str, q: str) -> Column:
    """The first key that two signatures share: a pair of many shared keys counts once."""
    lane = lambda x, j: F.when(F.shiftrightunsigned(x, 16 * j).bitwiseAND(0xFFFF) != 0, 1).otherwise(0)

    def slot(x: Column, i: Column) -> Column:
        wrong = lane(x, 0) + lane(x, 1) + lane(x, 2) + lane(x, 3)
        return F.when(wrong == 0, i * CHUNK).when(wrong == 1, i * CHUNK + lane(x, 1) + 2 * lane(x, 2) + 3 * lane(x, 3))

    return F.array_min(F.transform(F.zip_with(p, q, lambda x, y: x.bitwiseXOR(y)), slot))


def _sent(rows: DataFrame) -> DataFrame:
    """``rows`` (written by ``cut``), marked for broadcast if their count is within SENT."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _stars(edges: DataFrame) -> bool:
    """Whether every node has either one edge to a lesser node or only edges from greater ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return seen.where("ups > 1 OR ups = 1 AND least = 0").isEmpty()


def _with_least(rows: DataFrame, many: int) -> DataFrame:
    """``rows`` (u, v) with ``m``, the least of u and its v; a hub's rows stay where they are."""
    least = cut(rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("links")))
    hubs = F.broadcast(least.where(F.col("links") > many).select("u", "m"))
    others = rows.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("links") <= many).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(others)


def components(links: DataFrame) -> DataFrame:
    """(id, component): least id reachable over links (a, b), by alternating stars.

    A node with more than ``many`` links is a hub; there are at most ``HUBS``.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    many = max(1000, 4 * edges.count() // HUBS)
    while not _stars(edges):
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        large = cut(_with_least(both, many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        # (v, m) for each edge and (u, m) for its upper end; repeats go with the rest
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        edges = cut(_with_least(large, many).select(F.explode(pair).alias("e")).select("e.*").where("u <> v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, part, n_shingles, component_id, kept and group (the component's own number) for each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(texts.withColumn("part", text_hash(F.col("text"))).mapInArrow(_features, "doc_id long, part long, n_shingles long, set_a long, set_b long, sig array<long>"))
    each = found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    # numbers grow with the least doc_id, so the least number of a component has its least doc_id
    classes = cut(each.orderBy("rep", "set_a", "set_b").withColumn("id", F.monotonically_increasing_id()))
    postings = classes.select("id", "n", "sig").mapInArrow(_keys, "key long, id long, n long, slot int")
    sizes = postings.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = cut(postings.join(sizes, "key"))  # only buckets with company
    weights = shared.groupBy("id").agg(F.sum("members").alias("weight"))
    # the class that meets most others is near the middle of its group
    leaders = shared.join(weights, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"), "n")).alias("l")).select("key", (-F.col("l.minus")).alias("leader"), F.col("l.n").alias("leader_n"))
    alike = lambda p, q: 4 * F.least(p, q) >= 3 * F.greatest(p, q)  # noqa: E731  a similarity of 0.75 needs it
    top = cut(
        shared.join(leaders, "key").where(F.col("id") != F.col("leader")).where(alike(F.col("n"), F.col("leader_n")))
        .groupBy("id", "leader").agg(F.count("*").alias("met"))
        .groupBy("id").agg(F.max_by("leader", F.struct("met", -F.col("leader"))).alias("b"))
        .select(F.col("id").alias("a"), "b")
    )
    company = _sent(cut(shared.select("id").distinct()))
    wanted = _sent(cut(classes.join(company, "id").select("id", F.col("rep").alias("doc_id"), "set_a", "set_b")))
    sets = cut(texts.join(wanted, "doc_id").mapInArrow(_sets, "id long, members binary").groupBy("id").agg(F.max("members").alias("members")))

    def confirm(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("id").alias("a"), F.col("members").alias("x")).join(_sent(pairs), "a")
        y = sets.select(F.col("id").alias("b"), F.col("members").alias("y")).join(_sent(cut(pairs.select("b").distinct())), "b", "left_semi")
        return x.join(y, "b").mapInArrow(_linked, "a long, b long")

    comps = components(confirm(top))
    labelled = shared.select("key", "id", "n", "slot").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / BUCKET_BLOCK).cast("int").alias("blocks")).where("lo <> hi").select("key", "blocks")
    left = cut(labelled.join(mixed, "key"))
    # shingles that no other of these classes has can't be in an intersection
    alone = sets.join(_sent(cut(left.select("id").distinct())), "id", "left_semi").mapInArrow(_shingles, "id long, shingle long").groupBy("shingle").agg(F.count("*").alias("have"), F.min("id").alias("id")).where("have = 1").groupBy("id").agg(F.count("*").alias("alone"))
    left = cut(left.join(alone, "id", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0))).where("4 * common >= 3 * n").drop("alone"))
    reps = _sent(cut(left.select("id").distinct()))
    parity = sets.join(reps, "id", "left_semi").mapInArrow(_parities, "id long, " + ", ".join(f"w{i} long" for i in range(PARITY_BITS // 64)))
    left = cut(left.join(classes.join(reps, "id", "left_semi").select("id", "sig").join(parity, "id"), "id"))
    # each block of a bucket meets the whole bucket, so a large bucket is many tasks
    p = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("p")
    q = left.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).alias("q")
    enough = 7 * F.least("p.common", "q.common") >= 3 * (F.col("p.n") + F.col("q.n"))  # 0.75 of the union
    pair = (F.col("p.key") == F.col("q.key")) & (F.col("p.block") == F.col("q.block")) & (F.col("p.component") > F.col("q.component")) & enough
    near = (7 * _distance("p", "q") <= F.col("p.n") + F.col("q.n")) & (_first_slot("p.sig", "q.sig") == F.col("p.slot"))
    far = cut(p.join(q, pair & near).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")))
    if not far.isEmpty():
        # what is linked so far is as good as its stars
        comps = components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(confirm(far)))
    heads = comps.join(classes.select(F.col("id").alias("component"), F.col("rep").alias("least")), "component")
    ids = classes.select("set_a", "set_b", F.col("n").alias("n_shingles"), "rep", "id").join(heads, "id", "left")
    ids = ids.select("set_a", "set_b", "n_shingles", F.coalesce("least", "rep").alias("component_id"), F.coalesce("component", "id").alias("group"))
    out = found.drop("sig").join(ids, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    group = F.when(F.col("doc_id").isNotNull(), F.col("group"))
    return out.select("doc_id", "part", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"), group.alias("group"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    return _grouped(docs).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with the one document of each group that has its least doc_id.

    Where several rows of a group have that doc_id, one of them stays: the one
    whose text has the least hash. Rows without words stay, however often
    they are repeated, and so do rows without a doc_id.
    """
    found = cut(_grouped(docs))
    kept = found.where("kept AND group IS NOT NULL")
    several = _sent(cut(kept.groupBy("group").agg(F.count("*").alias("rows"), F.min("part").alias("first")).where("rows > 1").select("group", "first")))
    spare = kept.join(several, "group").where("part <> first").select("doc_id", "part")
    gone = _sent(cut(found.where("NOT kept").select("doc_id", "part").unionAll(spare).distinct()))
    key = lambda rows: (F.col("doc_id").cast("long") == rows["doc_id_"]) & (text_hash(F.col("text").cast("string")) == rows["part_"])
    mark = lambda rows: rows.select(F.col("doc_id").alias("doc_id_"), F.col("part").alias("part_"))
    gone = mark(gone)
    out = docs.join(gone, key(gone), "left_anti")
    repeated = cut(kept.join(several, "group").where("part = first").groupBy("doc_id", "part").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "part"))
    if repeated.isEmpty():
        return out
    repeated = mark(_sent(repeated))
    return out.join(repeated, key(repeated), "left_anti").unionByName(out.join(repeated, key(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
