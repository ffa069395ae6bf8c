"""Near-duplicate documents by HyperMinHash.

1. A document's set of five-word shingles is hashed into REGISTERS buckets; each keeps the least hash
   of its bucket as a count of leading zeros and MANTISSA further bits. Documents with equal sets
   (two 64-bit sums) become one class, so that copies take no further part.
2. Bands of compressed registers (empty ones filled along a fixed chain) bring classes together in
   buckets. Classes of at most SMALL shingles also meet on the least shingles of their sets, of which
   any similar pair shares one. Buckets of the same members count once.
3. All members of a bucket are compared by the collision-corrected Jaccard estimate of their
   registers, in tasks of at most two chunks of BUCKET members. A bucket larger than that is first
   compared with its least member: one close enough to it that any text it may be linked with joins
   the same family needs no further comparison there. Pairs estimated GATE below the wanted
   similarity or higher draw the families, as components.
4. Families are verified on the full sets. Every member is compared with the family's least one; pairs
   of which neither is linked with that one are left, and pairs of one that is and one that isn't.
   These are compared by products of 0/1 matrices, in groups of two chunks of at most CHUNK classes;
   a group reports a spanning forest of its links. Components of all links are the result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .components import components
from .store import discard, materialize

SHINGLE = 5
REGISTERS, MANTISSA, BAND = 96, 10, 4
PERCENT = 85
SMALL = 48
#: How far below the wanted similarity an estimate may lie, some five of its standard deviations;
#: and for pairs of sets of at most SMALL shingles, most of which have a register of their own.
GATE, SMALL_GATE = 0.2, 0.45
#: Members of a bucket that are compared with each other in one task; from which estimate on one of a
#: larger bucket belongs to the family of its least member.
BUCKET, STAR = 2048, 0.4
CHUNK, CHUNK_SHINGLES = 128, 2_000_000
_SEEDS = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_CHAIN = np.stack([np.random.default_rng(7).permutation(REGISTERS) for _ in range(12)] + [(np.arange(REGISTERS) + s) % REGISTERS for s in range(1, REGISTERS)])


def shingles(raw: np.ndarray | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: A-Z lower-cased, words between white space."""
    if raw is None or not len(raw):
        return np.empty(0, np.uint64)
    h = W.words(raw, W.SPACED, True)[2]
    return np.unique(W.windows(h, min(SHINGLE, len(h)))) if len(h) else np.empty(0, np.uint64)


def registers(s: np.ndarray) -> np.ndarray:
    """Compressed registers of a set: 0 if empty, else 1 + leading zeros and mantissa of the least
    32-bit hash of the bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(s):
        return out
    x = W.mix(s ^ _SEEDS[0])
    bucket = (x & np.uint64(0xFFFFFFFF)) % np.uint64(REGISTERS)
    key = np.sort(bucket << np.uint64(32) | x >> np.uint64(32))
    first = np.concatenate(([True], key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32)))
    key = key[first]
    v = key & np.uint64(0xFFFFFFFF)
    zeros = (32 - np.frexp(v.astype(np.float64))[1]).astype(np.uint64)
    rest = (v << (zeros + np.uint64(1)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    out[(key >> np.uint64(32)).astype(np.int64)] = 1 + (zeros << np.uint64(MANTISSA) | rest).astype(np.int64)
    return out


def meeting_keys(s: np.ndarray, r: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Band keys of a set with these registers, and those of its least shingles if it is small."""
    full = r.copy()
    for step in _CHAIN:
        empty = np.flatnonzero(full == 0)
        if not len(empty):
            break
        full[empty] = r[step[empty]]
    bands = full.reshape(-1, BAND).view(np.uint64).ravel()
    keys = W.mix(W.mix(bands) ^ W.mix(np.arange(len(bands), dtype=np.uint64) + _SEEDS[1]))
    if len(s) <= SMALL:
        prefix = len(s) - (percent * len(s) + 99) // 100 + 1
        keys = np.concatenate((keys, W.mix(s[:prefix] ^ _SEEDS[2])))
    return keys


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for registers that agree by chance."""
    used = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    return _corrected(same, used, na, nb)


_SETS = pa.struct([("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("registers", pa.binary()), ("keys", pa.list_(pa.int64()))])
_SETS_SPARK = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
    T.StructField("registers", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())),
])


def _sets(percent: int):
    @F.arrow_udf(_SETS_SPARK)
    def sets(texts: pa.Array) -> pa.Array:
        rows = []
        for raw in W.slices(texts):
            s = shingles(raw)
            if not len(s):
                rows.append({"n": 0, "a": None, "b": None, "registers": None, "keys": None})
                continue
            r = registers(s)
            a, b = (int(W.mix(s ^ seed).sum(dtype=np.uint64).view(np.int64)) for seed in (_SEEDS[3], _SEEDS[1]))
            rows.append({"n": len(s), "a": a, "b": b, "registers": r.tobytes(), "keys": W.signed(meeting_keys(s, r, percent))})
        return pa.array(rows, _SETS)

    return sets


@F.arrow_udf(T.DoubleType())
def _estimate(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
    rows = [np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (a, b)]
    sizes = [x.to_numpy(zero_copy_only=False).astype(float) for x in (na, nb)]
    return pa.array(estimate(*rows, *sizes), pa.float64())


def alike(r: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int, rows: int = 64) -> np.ndarray:
    """For rows of registers and set sizes, which pairs may be linked by their estimate and sizes; of
    different sides, or all if there is one side."""
    k = len(r)
    n = n.astype(float)
    used = (r != 0).astype(np.float32)
    other = np.ascontiguousarray(r.T)
    own = np.where(r == 0, np.uint16(0xFFFF), r)  # an empty register agrees with nothing
    near = np.zeros((k, k), bool)
    for at in range(0, k, rows):
        same = np.zeros((min(rows, k - at), k), np.uint8)
        for mine, theirs in zip(own[at : at + rows].T, other):
            same += mine[:, None] == theirs[None, :]
        either = used[at : at + rows].sum(1)[:, None] + used.sum(1)[None, :] - used[at : at + rows] @ used.T
        near[at : at + rows] = _passes(same, either, n[at : at + rows, None], n[None, :], percent)
    if side.min() != side.max():
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, True)
    return near


def _passes(same: np.ndarray, used: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether registers that agree and the sizes of two sets allow of a link."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    gate = percent / 100 - np.where(large <= SMALL, SMALL_GATE, GATE)
    return (_corrected(same, used, na, nb) >= gate) & (100 * small >= percent * large)


def _corrected(same: np.ndarray, used: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    chance = 0.7213 / (1 << MANTISSA) * na * nb / np.maximum(1.0, (na + nb) ** 2)
    return np.clip((same / np.maximum(1, used) - chance) / (1 - chance), 0, 1)


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of pairs, the least row it is connected with."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each set the least index it is connected with by links. Sets of different sides are
    compared, or all of them if there is one side."""
    k, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(k), sizes)
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    place = np.cumsum(counts > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((k, k))
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, 8192):
        lo, hi = np.searchsorted(column, (at, at + 8192))
        part = np.zeros((k, 8192), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    near = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if side.min() != side.max():
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, True)
    return forest(near)


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _connected(percent: int):
    """Sorted groups of members with their registers, as a spanning forest of the pairs that may be
    linked. A group has at most two chunks, so one is held at a time."""

    def pairs(groups: pa.Table, last: bool) -> tuple[list, list, pa.Table]:
        place = np.stack([groups.column(c).to_numpy() for c in ("key", "lo", "hi")])
        edge = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1
        edge = [0, *edge.tolist(), *([groups.num_rows] if last else [])]
        us, vs = [], []
        for a, b in zip(edge, edge[1:]):
            part = groups.slice(a, b - a)
            r = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            label = forest(alike(r, part.column("n").to_numpy(), part.column("chunk").to_numpy(), percent))
            ids, other = part.column("rep").to_numpy(), np.flatnonzero(label != np.arange(b - a))
            us.append(ids[other])
            vs.append(ids[label[other]])
        return us, vs, groups.slice(edge[-1])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                more = pa.Table.from_batches([batch])
                rest = more if rest is None else pa.concat_tables([rest, more])
            if rest is not None and rest.num_rows:
                us, vs, rest = pairs(rest, batch is None)
                if us:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (us, vs)], schema=_LINKS)

    return task


def families(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component): classes that may hold links, by chains of similar estimates."""
    bands = classes.select("rep", F.explode("keys").alias("key"))
    one = classes.select("rep", "registers", "n")
    other = one.toDF("leader", "r2", "n2")
    members = F.count(F.lit(1)).alias("members")
    shared = bands.groupBy("key").agg(members, F.bit_xor(F.xxhash64("rep")).alias("sign"), F.min("rep").alias("leader"), F.max("rep").alias("rep")).where("members > 1")
    # buckets of the same members are one
    buckets = materialize(shared.groupBy("members", "sign", "leader", "rep").agg(F.min("key").alias("key")), "buckets")
    two = buckets.where("members = 2").select("rep", "leader").distinct()
    two = two.join(one, "rep").join(other, "leader").where(_pair_passes(percent)("registers", "r2", "n", "n2")).select(F.col("rep").alias("u"), F.col("leader").alias("v"))
    placed = materialize(bands.join(buckets.where("members > 2").select("key", "members", "leader"), "key"), "placed")
    few, zero = placed.where(F.col("members") <= BUCKET), F.lit(0)
    few = few.select("key", zero.alias("lo"), zero.alias("hi"), "rep", zero.alias("chunk"))
    # larger buckets: who is not surely of the least member's family stays
    led = placed.where((F.col("members") > BUCKET) & (F.col("rep") != F.col("leader"))).join(one, "rep").join(other, "leader")
    led = materialize(led.select("key", "rep", "leader", _estimate("registers", "r2", "n", "n2").alias("j")), "led")
    star = led.where(F.col("j") >= STAR).select(F.col("rep").alias("u"), F.col("leader").alias("v")).distinct()
    stay = led.where(F.col("j") < STAR + (1 - percent / 100) + 0.15).select("key", "rep")
    chunks = stay.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("chunks"))
    stay = stay.join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    stay = stay.withColumn("with", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    stay = stay.select("key", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"), "rep", "chunk")
    met = few.union(stay).join(one, "rep").select("key", "lo", "hi", "rep", "chunk", "registers", "n")
    met = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = components(two.union(star).union(met.mapInArrow(_connected(percent), "u long, v long")))
    discard(buckets, placed, led)
    return found


def _pair_passes(percent: int):
    @F.arrow_udf(T.BooleanType())
    def passes(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (a, b))
        n, m = (c.to_numpy(zero_copy_only=False).astype(float) for c in (na, nb))
        return pa.array(_passes(((x == y) & (x != 0)).sum(1), ((x != 0) | (y != 0)).sum(1), n, m, percent), pa.bool_())

    return passes


def _linked_with(percent: int):
    @F.arrow_udf(T.BooleanType())
    def linked_with(texts: pa.Array, leaders: pa.Array) -> pa.Array:
        out, known, last = [], None, None
        for x, y, leader in zip(W.slices(texts), W.slices(leaders), leaders):
            if known is None or leader != last:
                known, last = shingles(y), leader
            s = shingles(x)
            both = len(np.intersect1d(s, known, assume_unique=True))
            out.append(100 * both >= percent * (len(s) + len(known) - both))
        return pa.array(out, pa.bool_())

    return linked_with


def _verify(percent: int):
    def verify(group: pa.Table) -> pa.Table:
        ids = group.column("rep").to_numpy()
        sets = [shingles(raw) for part in group.column("text").chunks for raw in W.slices(part)]
        label = linked(sets, group.column("side").to_numpy(), percent)
        other = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table([pa.array(ids[other], pa.int64()), pa.array(ids[label[other]], pa.int64())], schema=_LINKS)

    return verify


def links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between classes that connect whatever the exact links connect."""
    found = families(classes, percent).withColumnsRenamed({"node": "rep", "component": "family"})
    texts = docs.select(F.col("doc_id").alias("rep"), "text", F.hash("text").alias("copy"))
    members = found.join(classes.select("rep", "n", "copy"), "rep").join(texts, ["rep", "copy"]).dropDuplicates(["rep"])
    members = materialize(members.select("rep", "family", "n", "text"), "members")
    leaders = members.where("rep = family").select("family", F.col("text").alias("leader"))
    compared = members.where("rep != family").join(leaders, "family").select("rep", "family", "n", _linked_with(percent)("text", "leader").alias("linked"))
    compared = materialize(compared, "compared")
    # chunks of those that are linked with the family's least member, and of those that aren't
    count = lambda x: F.greatest(F.ceil(F.count(F.when(x, 1)) / CHUNK), F.ceil(F.sum(F.when(x, F.col("n"))) / CHUNK_SHINGLES), F.lit(0)).cast("int")
    sizes = compared.groupBy("family").agg(count(F.col("linked")).alias("near"), count(~F.col("linked")).alias("far")).where("far > 0")
    placed = compared.join(materialize(sizes, "families"), "family").withColumn(
        "chunk", F.pmod(F.xxhash64("rep"), F.when(F.col("linked"), F.col("near")).otherwise(F.col("far"))).cast("int")
    )
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda lo, hi, side: F.struct(lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    chunk, none = F.col("chunk"), F.lit(-1)
    # a chunk of linked ones has the place (its number below zero, the other chunk's number)
    near = F.transform(upto("far"), lambda c: place(-1 - chunk, c, none))
    far = F.concat(F.transform(upto("far"), lambda c: place(F.least(chunk, c), F.greatest(chunk, c), chunk)), F.transform(upto("near"), lambda c: place(-1 - c, chunk, chunk)))
    met = placed.select("rep", "family", F.explode(F.when(F.col("linked"), near).otherwise(far)).alias("at")).select("rep", "family", "at.*")
    met = met.join(members.select("rep", "text"), "rep")
    rest = met.groupBy("family", "lo", "hi").applyInArrow(_verify(percent), "u long, v long")
    return compared.where("linked").select(F.col("rep").alias("u"), F.col("family").alias("v")).union(rest)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Two documents are linked when their shingle sets agree by percent or more; component_id is the
    least doc_id reachable over links, the own one included. A text of fewer than SHINGLE words has
    its whole word sequence as its one shingle. Null, empty and blank texts have none and are linked
    with nothing. Of rows with one doc_id and different sets, one stands for the document; its component
    is theirs. A null doc_id takes part in no link and has no component.
    Copies meet as one class; other columns are left out; an empty table gives no rows. The jobs up to
    the last join run when this is called."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sets = docs.select("doc_id", F.hash("text").alias("copy"), _sets(percent)("text").alias("s")).select("doc_id", "copy", "s.*")
    sets = materialize(sets, "sets")
    # of a document's different sets, the one of the least sums stands for it
    chosen = sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("least"), F.max(F.struct("a", "b")).alias("most"))
    chosen = materialize(chosen.where("least != most").select("doc_id", "least"), "repeated")
    sets = sets.join(chosen, "doc_id", "left")
    classes = (
        sets.where("n > 0 and doc_id is not null and (least is null or least = struct(a, b))").groupBy("a", "b")
        .agg(F.min(F.struct("doc_id", "copy", "n", "registers", "keys")).alias("least"))
        .select("a", "b", F.col("least.doc_id").alias("rep"), "least.copy", "least.n", "least.registers", "least.keys")
    )
    classes = materialize(classes, "classes")
    found = materialize(components(links(docs, classes, percent)), "components")
    named = classes.select("a", "b", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.select("a", "b", F.coalesce("component", "rep").alias("component")), "named")
    discard(classes, found)
    # an own key for rows without a set, so that they don't meet in one task
    keys = [F.coalesce(F.col("least")[c], c, other).alias(c) for c, other in (("a", F.xxhash64("doc_id")), ("b", F.lit(0)))]
    keyed = sets.select("doc_id", "n", *keys, (F.col("n") > 0).alias("any"))
    component = F.when(F.col("any") & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return keyed.join(named, ["a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
