"""Exact Jaccard join of documents' word shingles, by prefix filters under several token orders.

Documents with one set of shingles are one class, named by a hash of the set. The first token order
puts shingles that only one class holds before those that are shared; a linked pair must meet in the
prefixes of that order, at places that leave room for the overlap it needs. A pair that meets must also
share prefix tokens under two further orders before its sets are held against each other.

Which shingles are shared is counted exactly over one document of each class: tasks send sorted,
packed hashes to ranges of the hash space, each range is sorted and its repeated hashes are marked in a
bitmap, sized from the number of shingles up to 2^MOST_BITS bits and addressed by the hashes' upper bits.
Any order gives right results, so a full bitmap costs time alone.

Pairs are not listed within groups of near copies: in each prefix list the member with the most room
leads, all others are held against it, and the linked ones become a component. Then only pairs of
different components that meet in a list are held against each other, the members outside of a list's
largest component against all. So no link between components is lost. Before sets are looked at, a pair
must pass by size, by place, and by a signature of the shingles that its sets share with others.

Cases at the edge: a null text, or one without words, has no shingles and is linked with nothing; fewer
words than a shingle are one shingle; repeated rows are in one class; a null doc_id is never the
smallest, unless a component has no other; an empty table gives an empty result; other columns are not
looked at. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words
from .components import components

N = 3
PERCENT = 90
ORDERS = 3
#: Bits of the bitmap: about SLOTS for each shingle, within these powers of two.
SLOTS, LEAST_BITS, MOST_BITS = 16, 16, 28
#: Shingles that one range of the hash space has about.
RANGE_SHINGLES = 2_000_000


def shingle_sets(texts: list[str], n: int = N) -> list[np.ndarray]:
    """Sorted hashes of the different shingles of each text."""
    out = []
    for (h,) in words.by_text(texts, lower=True):
        g = words.ngrams(h, n) if len(h) >= n else words.mix(words.ngrams(h, len(h)) + np.uint64(len(h))) if len(h) else h
        out.append(np.unique(g))
    return out


def set_key(s: np.ndarray) -> int | None:
    """A class's name; none for an empty set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def least_overlap(size: int, percent: int) -> int:
    """Shared shingles that any partner of a set of that size has at least."""
    return -(-percent * size // 100)


def prefix_length(size: int, percent: int) -> int:
    return size - least_overlap(size, percent) + 1


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def classes(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, key, size): each row's class and the number of its shingles."""
    common.small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(common.texts(batch, "t"), n)
        return {"doc_id": batch.column("id"), "key": [set_key(s) for s in sets], "size": [len(s) for s in sets]}

    return common.mapped(docs.selectExpr("doc_id as id", "text as t"), run, "doc_id bigint, key bigint, size bigint")


def _pack(h: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as the compressed byte planes of their differences."""
    return zlib.compress(np.diff(h, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def shared_bitmap(docs: DataFrame, members: DataFrame, n: int = N) -> np.ndarray:
    """Bitmap of the shingles that more than one class holds; 2^MOST_BITS bits at most."""
    common.small_batches(docs.sparkSession)
    first = members.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = common.written(members.join(first, "key").where("doc_id > first").select("doc_id").distinct(), "again")
    single = docs.join(common.checked(again), "doc_id", "left_anti")
    total = members.agg(F.sum("size")).first()[0] or 0
    all_bits = min(MOST_BITS, max(LEAST_BITS, (SLOTS * total).bit_length()))
    bits = min(all_bits - 6, max(6, int(total / RANGE_SHINGLES).bit_length()))  # of the number of ranges
    arrow = common.arrow_schema("r int, h binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            of = (h >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(of, np.arange((1 << bits) + 1))
            low = ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            rows = [(r, _pack(low[a:b])) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], type=t) for k, t in enumerate(arrow.types)], schema=arrow)

        for batch in common.by_bytes(batches, common.TEXT_BYTES):
            held += shingle_sets(common.texts(batch, "t"), n)
            if sum(map(len, held)) > RANGE_SHINGLES:
                yield flush()
                held.clear()
        if sum(map(len, held)):
            yield flush()
        held.clear()
        common.give_back()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            twice = h[1:][h[1:] == h[:-1]]
            slots = np.zeros(1 << (all_bits - bits), dtype=bool)
            slots[twice >> np.uint32(32 - (all_bits - bits))] = True
            return pa.RecordBatch.from_arrays([pa.array([last], type=arrow.types[0]), pa.array([np.packbits(slots, bitorder="little").tobytes()], type=arrow.types[1])], schema=arrow)

        for batch in batches:
            for r, data in zip(batch.column("r").to_pylist(), batch.column("h").to_pylist(), strict=True):
                if r != last and held:
                    yield flush()
                    held = []
                last = r
                held.append(_unpack(data))
        if held:
            yield flush()
        held = []
        common.give_back()

    packed = single.selectExpr("text as t").mapInArrow(pack, "r int, h binary")
    marked = packed.repartition("r").sortWithinPartitions("r").mapInArrow(mark, "r int, h binary").toArrow()
    out = np.zeros((1 << bits, 1 << (all_bits - bits - 3)), dtype=np.uint8)
    for r, data in zip(marked["r"].to_pylist(), marked["h"], strict=True):
        out[r] = np.frombuffer(data.as_buffer(), dtype=np.uint8)
    del marked
    common.give_back()
    return out.ravel()


def is_shared(tokens: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = (tokens >> np.uint64(64 - (len(bitmap).bit_length() + 2))).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def first_prefix(s: np.ndarray, seen: np.ndarray, percent: int) -> tuple[np.ndarray, int, np.ndarray]:
    """The shared shingles in the set's prefix under the first order, the place of the first of them, and a signature.

    The order puts shingles that no other class holds before shared ones, each by hash; the former meet nothing.
    The signature has two bits for each of 64 parts of the shared shingles: a sum of their hashes in that part.
    """
    shared = is_shared(s, seen)
    own = s[shared]
    alone = len(s) - len(own)
    part, bits = (own & np.uint64(63)).astype(np.int64), (own >> np.uint64(6)) & np.uint64(3)
    sums = np.zeros(64, dtype=np.uint64)
    np.bitwise_xor.at(sums, part, bits)
    signature = np.bitwise_or.reduce(sums.reshape(2, 32) << (np.uint64(2) * np.arange(32, dtype=np.uint64)), axis=1)
    return own[: max(0, prefix_length(len(s), percent) - alone)], alone, signature


def further_prefix(s: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The set's prefix under a further order: by another hash."""
    k = prefix_length(len(s), percent)
    h = words.mix(s + np.uint64(order))
    return s[np.argpartition(h, k - 1)[:k]] if k < len(s) else s


def postings(docs: DataFrame, seen: np.ndarray, percent: int = PERCENT, n: int = N) -> DataFrame:
    """(token, key, size, place, alone, s1, s2): the shared shingles in the first-order prefix of every set that can have a partner; written."""
    common.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(seen)  # 2^MOST_BITS bits at most
    del seen
    nothing = np.zeros(0, dtype=np.int64)

    def run(batch: pa.RecordBatch) -> dict:
        cols: dict[str, list[np.ndarray]] = {c: [nothing] for c in ("token", "key", "size", "place", "alone", "s1", "s2")}
        for s in shingle_sets(common.texts(batch, "t"), n):
            if not len(s) or least_overlap(len(s) + 1, percent) > len(s):
                continue
            front, alone, signature = first_prefix(s, held.value, percent)
            if len(front):
                s1, s2 = _signed(signature)
                for c, v in (("key", set_key(s)), ("size", len(s)), ("alone", alone), ("s1", s1), ("s2", s2)):
                    cols[c].append(np.full(len(front), v, dtype=np.int64))
                cols["token"].append(_signed(front))
                cols["place"].append(alone + np.arange(len(front)))
        return {c: np.concatenate(v) for c, v in cols.items()}

    found = common.mapped(docs.selectExpr("text as t"), run, "token bigint, key bigint, size bigint, place bigint, alone bigint, s1 bigint, s2 bigint")
    out = common.written(found, "postings")
    held.destroy()
    common.give_back()
    return out


def can_link(a: str, b: str, percent: int = PERCENT) -> Column:
    """Whether two members of a prefix list may be linked, by size, place and signature.

    A link needs so much overlap; what either holds alone is not in it, so the shared shingles of the two
    differ in at most D places, and so do their signatures' parts.
    """
    c = lambda side, x: F.col(f"{side}_{x}")
    sizes = c(a, "size") + c(b, "size")
    need = F.ceil(F.lit(percent) * sizes / (100 + percent) - 1e-9)
    room = F.least(c(a, "size") - c(a, "place"), c(b, "size") - c(b, "place"))
    may_differ = sizes - c(a, "alone") - c(b, "alone") - 2 * need

    def differing(x: str) -> Column:
        both = c(a, x).bitwiseXOR(c(b, x))
        return F.bit_count(both.bitwiseOR(F.shiftrightunsigned(both, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return (100 * F.least(c(a, "size"), c(b, "size")) >= percent * F.greatest(c(a, "size"), c(b, "size"))) & (room >= need) & (differing("s1") + differing("s2") <= may_differ)


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select("token", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "token"])


def candidate_sets(docs: DataFrame, ids: DataFrame, keys: DataFrame, percent: int, n: int) -> DataFrame:
    """(key, size, tokens, p2, p3, ...) of the wanted classes, each from the one row that stands for it."""
    common.small_batches(docs.sparkSession)
    wanted = docs.select("doc_id", F.col("text").alias("t")).join(common.checked(ids), "doc_id", "left_semi")
    further = [f"p{o}" for o in range(2, ORDERS + 1)]

    def run(batch: pa.RecordBatch) -> dict:
        sets = [s for s in shingle_sets(common.texts(batch, "t"), n) if len(s)]
        fronts = {f"p{o}": common.list_array([_signed(further_prefix(s, o, percent)) for s in sets], pa.int64()) for o in range(2, ORDERS + 1)}
        return {"key": [set_key(s) for s in sets], "size": [len(s) for s in sets], "tokens": common.list_array([_signed(s) for s in sets], pa.int64())} | fronts

    sets = common.mapped(wanted, run, "key bigint, size bigint, tokens array<bigint>, " + ", ".join(f"{p} array<bigint>" for p in further))
    return common.written(sets.join(common.checked(keys), "key", "left_semi").dropDuplicates(["key"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that meet under the further orders too and are linked."""
    fronts = [f"p{o}" for o in range(2, ORDERS + 1)]
    side = lambda name, columns: sets.select(F.col("key").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    meet = pairs.join(side("a", fronts), "a").join(side("b", fronts), "b")
    for p in fronts:
        meet = meet.where(F.arrays_overlap(f"a_{p}", f"b_{p}"))
    both = common.written(meet.select("a", "b"), "meeting").join(side("a", ["size", "tokens"]), "a").join(side("b", ["size", "tokens"]), "b")
    common_tokens = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(100 * common_tokens >= percent * (F.col("a_size") + F.col("b_size") - common_tokens)).select("a", "b")


def linked_classes(docs: DataFrame, members: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """(key, component): for every class that is linked with another, the name of its component.

    members: (doc_id, key, size) as `classes` gives it.
    """
    lists = postings(docs, shared_bitmap(docs, members, n), percent, n)
    about = ["key", "size", "place", "alone", "s1", "s2"]
    leaders = (
        lists.groupBy("token")
        .agg(F.min(F.struct("place", "key", "size", "alone", "s1", "s2")).alias("lead"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        .where("lo <> hi")
        .select("token", *[F.col(f"lead.{c}").alias(f"l_{c}") for c in about])
    )
    # leaders are written first, so that Spark can split a token's list in the join
    shared = common.written(lists.distinct().join(common.written(leaders, "leaders"), "token"), "shared")
    named = shared.withColumnsRenamed({c: f"m_{c}" for c in about})
    star = common.written(named.where("l_key <> m_key").where(can_link("l", "m", percent)).select(F.least("l_key", "m_key").alias("a"), F.greatest("l_key", "m_key").alias("b")).distinct(), "star")
    keys = common.written(shared.select("key").distinct(), "keys")
    stand = common.written(members.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(common.checked(keys), "key", "left_semi").select("doc_id").distinct(), "stand")
    sets = candidate_sets(docs, stand, keys, percent, n)
    links = common.written(verified(star, sets, percent), "links")
    known = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # members of one list that are in different components so far
    placed = shared.select("token", *about).join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    placed = common.written(placed, "placed")
    largest = (
        placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("token").agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1").select("token", F.col("most.component").alias("major"))
    )
    open_lists = common.written(placed.join(common.written(largest, "largest"), "token"), "open")
    # a list is split by size: linked sizes are within a factor of percent / 100, so in the same or the next bucket of this width
    bucket = F.floor(F.log(F.col("size")) / max(1e-3, 1.0001 * math.log(100 / percent)))
    left = _side(open_lists.where("component <> major").withColumn("bucket", bucket), "m")
    right = _side(open_lists.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))), "o")
    differ = (F.col("m_component") != F.col("o_component")) & ((F.col("o_component") == F.col("o_major")) | (F.col("m_key") < F.col("o_key")))
    met = left.join(right, (left["token"] == right["token"]) & (F.col("m_bucket") == F.col("o_bucket")) & differ & can_link("m", "o", percent)).select(F.least("m_key", "o_key").alias("a"), F.greatest("m_key", "o_key").alias("b")).distinct()
    across = common.written(verified(common.written(met.join(star, ["a", "b"], "left_anti"), "across"), sets, percent), "links")
    every = links.unionByName(across)
    return components(every.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "key")


def clustered(docs: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id that links reach."""
    docs = docs.select("doc_id", "text")
    members = common.written(classes(docs, n), "classes")
    linked = linked_classes(docs, members, percent, n)
    own = members.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = own.join(linked, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "component").select("key", "component_id")
    return members.join(of_class, "key", "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(common.table(spark, sf_dir, "documents"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest doc_id stays; documents without shingles stay.

    Rows that share that doc_id stay together, and so do rows without a doc_id.
    """
    stays = F.bool_or(F.col("doc_id") == F.col("component_id"))
    gone = clustered(docs).where("doc_id is not null").groupBy("doc_id").agg(stays.alias("stays")).where("not stays").select("doc_id")
    return docs.join(common.checked(common.written(gone, "gone")), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
