"""Removal of repeated 100-byte strings by suffix arrays that a difference-cover algorithm builds.

Suffixes are dealt out by content, so that equal strings always meet. In each 100-byte window the least
of its hashed K-grams is its anchor; equal windows have equal anchors at equal places. Windows whose
anchor gram stands only once in the corpus cannot repeat. The windows of one anchor form a context of at
most 150 bytes; equal contexts are one class, of which the first occurrence (least document, then least
start) stays for further comparison and all others are repeats whole. The first occurrences are cut into
PARTS parts by the windows' places around the anchor; windows of one part share a core of bytes, and
parts are dealt out by the hash of that core. Each task then sorts the suffixes of its parts with the
difference cover of 3 (sampled triples are named, the names are sorted by recursion, the other suffixes
are merged in) and compares the first 100 bytes of neighbours in the order. The contexts of a gram that has
more than HOT_CONTEXTS of them are cut into single windows, which are gathered by the window's hash and the
first of each kept, so that no core fills a task.

Cases at the edge: a null text is empty; texts of less than 100 bytes lose nothing; rows that share a
doc_id but not a text go by the text's digest; equal rows count as one and give equal results; a null
doc_id comes before all others; an empty table gives an empty result; other columns are not looked at.
Contexts are told apart by two hashes (of the gram and of the whole), the windows of hot grams by 128 bits,
grams and cores by 64-bit hashes; all other windows are compared by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, common, words

LENGTH = 100
K = 50
PARTS = 4
#: Bytes of parts whose suffixes one array holds, unless a single core has more.
ARRAY_BYTES = 1 << 20
#: Different contexts of one gram that are still sorted in one array.
HOT_CONTEXTS = 20_000
NO_ID = -(1 << 63)
#: What tells rows apart, in their order.
ROW = ["id", "digest"]

_R = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE_BITS = 24
#: Bytes of a text that are looked at together; stretches overlap by what a context needs.
STRETCH = 1 << 20


# ---- suffix array by the difference cover {1, 2} mod 3


def packed(*columns: np.ndarray) -> np.ndarray:
    """One integer for each row, in the lexicographic order of the columns."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        width = max(1, int(c.max()).bit_length()) if len(c) else 1
        if len(key) and int(key.max()).bit_length() + width > 63:
            key = np.unique(key, return_inverse=True)[1]
        key = (key << width) | c
    return key


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (integers from 1 up), in order."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), dtype=np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, dtype=np.int64)])
    top = n + (n % 3 == 1)  # where n is 1 mod 3, the empty suffix stands in the sample, so that its halves stay apart
    one, two = np.arange(1, top, 3), np.arange(2, top, 3)
    sample = np.concatenate([one, two])
    names, place = np.unique(packed(t[sample], t[sample + 1], t[sample + 2]), return_inverse=True)
    if len(names) < len(sample):
        order = suffix_array(place + 1)
    else:
        order = np.empty(len(sample), dtype=np.int64)
        order[place] = np.arange(len(sample))
    sampled = sample[order]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(packed(t[rest], rank[rest + 1]), kind="stable")]
    # merge: how many sampled suffixes of either kind stand before each of the rest
    before = np.zeros(len(rest), dtype=np.int64)
    for kind in (1, 2):
        own = sampled[sampled % 3 == kind]
        both = np.concatenate([own, rest])
        key = packed(t[both], rank[both + 1]) if kind == 1 else packed(t[both], t[both + 1], rank[both + 2])
        before += np.searchsorted(key[: len(own)], key[len(own) :])
    out = np.empty(n, dtype=np.int64)
    taken = np.arange(len(rest)) + before
    out[taken] = rest
    free = np.ones(n, dtype=bool)
    free[taken] = False
    out[free] = sampled
    return out


# ---- anchors and contexts


def grams(b: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each k bytes in a row."""
    n = len(b)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    power = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n - 1, _R)]))
    back = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n - k, _INVERSE)]))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power)])
    return words.mix((total[k:] - total[:-k]) * back)


def _anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, place, first and last start) of the anchors of a stretch, with the windows that each is the least gram of."""
    width = LENGTH - K + 1
    h = grams(b)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    m, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    place = (m & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    return h[place[first]], place[first], first, last


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`_anchors` of a whole text; each window start belongs to one stretch."""
    none = np.zeros(0, dtype=np.int64)
    if len(b) < LENGTH:
        return none.astype(np.uint64), none, none, none
    found = []
    for at in range(0, len(b) - LENGTH + 1, STRETCH):
        h, place, first, last = _anchors(b[at : at + STRETCH + LENGTH - 1])
        found.append((h, place + at, first + at, last + at))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _raw(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8) for t in common.texts(batch, "t")]


def _signed(h) -> np.ndarray:
    return np.asarray(h, dtype=np.uint64).view(np.int64)


def occurrences(docs: DataFrame, repeated: np.ndarray | None) -> DataFrame:
    """Without a filter: (gram) of every anchor. With the filter of repeated grams: (gram, class, id, digest, place, first, last) of theirs.

    A class is the hash of gram, the windows' places around it, and the context's bytes. A text that a stretch
    parts gives contexts that are parted there, which changes classes but no window.
    """
    common.small_batches(docs.sparkSession)
    held = None if repeated is None else docs.sparkSession.sparkContext.broadcast(repeated)

    def all_grams(batch: pa.RecordBatch) -> dict:
        found = [anchors(b)[0] for b in _raw(batch)]
        return {"gram": _signed(np.concatenate(found)) if found else []}

    def those_repeated(batch: pa.RecordBatch) -> dict:
        cols: dict[str, list] = {c: [] for c in ("gram", "class", "id", "digest", "place", "first", "last")}
        for b, i, d in zip(_raw(batch), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ROW), strict=True):
            h, place, first, last = anchors(b)
            own = np.flatnonzero(bloom.holds(held.value, h)) if len(h) else []
            if len(own):
                h, place, first, last = h[own], place[own], first[own], last[own]
                cols["gram"].append(h)
                cols["class"].append(_class_hashes(b, h, place, first, last))
                cols["id"].append(np.full(len(own), i))
                cols["digest"].append(np.full(len(own), d))
                for c, v in (("place", place), ("first", first), ("last", last)):
                    cols[c].append(v)
        out = {c: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for c, v in cols.items()}
        return out | {"gram": _signed(out["gram"]), "class": _signed(out["class"])}

    if held is None:
        return common.mapped(docs.select("t"), all_grams, "gram bigint")
    return common.mapped(docs, those_repeated, "gram bigint, class bigint, id bigint, digest bigint, place int, first int, last int")


def _class_hashes(b: np.ndarray, h: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    raw = b.tobytes()
    own = np.fromiter((xxhash.xxh3_64_intdigest(raw[f : e + LENGTH]) for f, e in zip(first.tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=len(h))
    return words.mix(own + words.mix(h) + (place - first).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def core_parts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(core, id, digest, start, windows, data): the parts of the wanted occurrences' contexts.

    wanted: (id, digest, first, last, place). start is where the part's first window starts, windows how many it has.
    """
    spots = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("place", "first", "last")).alias("spots"))
    ids = common.checked(common.written(wanted.select(*ROW).distinct(), "ids"))
    joined = docs.join(ids, ROW, "left_semi").dropDuplicates(ROW).join(spots, ROW)
    step = -(-(LENGTH - K + 1) // PARTS)

    def run(batch: pa.RecordBatch) -> dict:
        cols: dict[str, list] = {c: [] for c in ("core", "id", "digest", "start", "windows", "data")}
        for b, i, d, own in zip(_raw(batch), *(batch.column(c).to_pylist() for c in (*ROW, "spots")), strict=True):
            raw = b.tobytes()
            for s in own:
                x, first, last = s["place"], s["first"], s["last"]
                for part in range(PARTS):  # windows that start part * step to part * step + step - 1 before the anchor
                    a, z = max(first, x - part * step - step + 1), min(last, x - part * step)
                    if a <= z:
                        core = raw[x - part * step : x - part * step - step + 1 + LENGTH]
                        cols["core"].append(xxhash.xxh3_64_intdigest(core, part) - (1 << 63))
                        cols["id"].append(i)
                        cols["digest"].append(d)
                        cols["start"].append(a)
                        cols["windows"].append(z - a + 1)
                        cols["data"].append(raw[a : z + LENGTH])
        return cols

    return common.mapped(joined.select(*ROW, "t", "spots"), run, "core bigint, id bigint, digest bigint, start int, windows int, data binary")


def hot_windows(parts: DataFrame) -> DataFrame:
    """(id, digest, first, last): windows of the parts that an earlier window equals, by the hashes of single windows."""

    def run(batch: pa.RecordBatch) -> dict:
        cols: dict[str, list] = {c: [] for c in ("w1", "w2", "id", "digest", "start")}
        for i, d, start, windows, data in zip(*(batch.column(c).to_pylist() for c in (*ROW, "start", "windows", "data")), strict=True):
            for k in range(windows):
                h = xxhash.xxh3_128_intdigest(data[k : k + LENGTH])
                for c, v in zip(cols, ((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), i, d, start + k), strict=True):
                    cols[c].append(v)
        return cols

    own = common.written(common.mapped(parts.drop("core"), run, "w1 bigint, w2 bigint, id bigint, digest bigint, start int"), "hot-windows")
    heads = common.written(own.groupBy("w1", "w2").agg(F.min(F.struct(*ROW, "start")).alias("head")), "hot-heads")
    return own.join(heads, ["w1", "w2"]).where(F.struct(*ROW, "start") > F.col("head")).select(*ROW, F.col("start").alias("first"), F.col("start").alias("last"))


def repeats_in(ids: np.ndarray, digests: np.ndarray, starts: np.ndarray, windows: np.ndarray, data: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(id, digest, first, last): runs of window starts that an earlier window in the parts equals, by a suffix array over all parts."""
    text = np.frombuffer(b"".join(data), dtype=np.uint8)
    lens = np.array([len(d) for d in data])
    base = np.cumsum(lens) - lens
    of = np.repeat(np.arange(len(data)), windows)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = np.zeros(len(text), dtype=bool)
    begin[base[of] + inner] = True
    part = np.zeros(len(text), dtype=np.int64)
    part[base[of] + inner] = of
    order = suffix_array(text.astype(np.int64) + 1)
    order = order[begin[order]]
    view = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    same = np.zeros(len(order), dtype=bool)
    for at in range(1, len(order), 1 << 16):
        to = min(len(order), at + (1 << 16))
        same[at:to] = (view[order[at - 1 : to - 1]] == view[order[at:to]]).all(axis=1)
    group = np.cumsum(~same)
    which = part[order]
    doc, text_of, start = ids[which], digests[which], starts[which] + (order - base[which])
    by = np.lexsort((start, text_of, doc, group))
    later = np.concatenate([[False], group[by][1:] == group[by][:-1]])
    start, which = start[by][later], which[by][later]
    by = np.lexsort((start, which))
    start, which = start[by], which[by]
    if not len(by):
        return []
    new = np.concatenate([[True], (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)])
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(start)]]) - 1
    return list(zip(ids[which[heads]].tolist(), digests[which[heads]].tolist(), start[heads].tolist(), start[tails].tolist(), strict=True))


def compared(parts: DataFrame) -> DataFrame:
    """(id, digest, first, last): repeated windows of the parts. Parts of one core meet in one task, sorted by core; arrays hold whole cores."""
    dealt = parts.repartition("core").sortWithinPartitions("core", *ROW, "start")
    schema = common.arrow_schema("id bigint, digest bigint, first int, last int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, digests, starts, windows, data = zip(*held, strict=True)
            found = repeats_in(np.array(ids), np.array(digests), np.array(starts), np.array(windows), list(data))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], type=t) for k, t in enumerate(schema.types)], schema=schema)

        last = None
        for batch in batches:
            for core, *row in zip(*(batch.column(c).to_pylist() for c in ("core", *ROW, "start", "windows", "data")), strict=True):
                if core != last:
                    if len(group) > 1:  # a core that stands alone repeats nothing
                        held += group
                        size += sum(len(r[-1]) for r in group)
                        if size >= ARRAY_BYTES:
                            yield flush()
                            held, size = [], 0
                    group, last = [], core
                group.append(tuple(row))
        if len(group) > 1:
            held += group
        if held:
            yield flush()
        common.give_back()

    return dealt.mapInArrow(run, "id bigint, digest bigint, first int, last int")


def removed_windows(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(id, digest, first, last): runs of starts of windows that also start earlier. docs: (id, digest, t)."""
    every = occurrences(docs, None)
    again = common.written(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    found = common.written(occurrences(docs, bloom.build(again, "gram")), "occurrences")
    here = F.struct(*ROW, "place")
    classes = common.written(found.groupBy("gram", "class").agg(F.min(F.struct(*ROW, "place", "first", "last")).alias("head")), "classes")
    heads = classes.select("gram", "class", F.struct(*[F.col(f"head.{c}").alias(c) for c in (*ROW, "place")]).alias("at"))
    whole = found.join(heads, ["gram", "class"]).where(here > F.col("at")).select(*ROW, "first", "last")
    several = common.written(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")

    def parts(which: DataFrame) -> DataFrame:
        return core_parts(docs, common.written(classes.join(which, "gram", "left_semi").select("head.*"), "heads"))

    out = whole.unionByName(compared(parts(several.where(F.col("n") <= hot_contexts))))
    hot = several.where(F.col("n") > hot_contexts)
    return out if hot.isEmpty() else out.unionByName(hot_windows(parts(hot)))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: n_bytes, n_removed, n_spans, the removed byte spans, and the bytes that are left with their digest."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    row = [F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest")]
    found = common.written(removed_windows(docs.select(*row, F.col(text_col).alias("t"))), "ranges")
    ids = common.checked(common.written(found.select(*ROW).distinct(), "ids"))
    ranges = found.groupBy(*ROW).agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def run(batch: pa.RecordBatch) -> dict:
        cols: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "removed", "kept", "kept_sha256")}
        for b, runs in zip(_raw(batch), batch.column("runs").to_pylist(), strict=True):
            edge = np.zeros(len(b) + 1, dtype=np.int64)
            if runs:
                np.add.at(edge, [r["first"] for r in runs], 1)
                np.add.at(edge, np.minimum([r["last"] + LENGTH for r in runs], len(b)), -1)
            gone = np.cumsum(edge)[:-1] > 0
            turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            left = b[~gone].tobytes()
            for c, v in zip(cols, (len(b), int(gone.sum()), len(turns) // 2, [{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()], left, hashlib.sha256(left).hexdigest()), strict=True):
                cols[c].append(v)
        return {"doc_id": batch.column("doc_id")} | cols

    rows = docs.select(F.col(id_col).alias("doc_id"), *row, F.col(text_col).alias("t"))
    # only texts that lose something travel to their runs
    losing = rows.join(ids, ROW, "left_semi").join(ranges, ROW).select("doc_id", "t", "runs")
    whole = rows.join(ids, ROW, "left_anti").select("doc_id", "t", F.lit(None).cast(ranges.schema["runs"].dataType).alias("runs"))
    return common.mapped(losing.unionByName(whole), run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<start:int,end:int>>, kept binary, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
