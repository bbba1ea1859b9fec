"""Encoding with the pieces of a SentencePiece model, and decoding: best and N-best segmentations.

The lattice of a text has an edge for each piece at each place; an edge's score is the piece's score in
the model file. Forward Viterbi scores are the exact cost of what is left in a backward A* search, so
segmentations leave the search best first. A piece holds the blank mark only at its front, and a
character without a piece is spelt in byte pieces, so lattices fall apart into chunks at those places:
each chunk is searched alone and remembered, and a text's N best are the N best sums over its chunks.

Blanks become the mark U+2581, and one is put before the text, as the model's own encoder does. A
mark that the text itself holds is spelt in bytes, so decoding gives every text back exactly.
Ties: Viterbi's best comes first, in which earlier starts of a piece win; among the others the path that
is nearer to the front, then the one that the search proposed first.

Cases at the edge: a null text has null ids and a null score; an empty text has no pieces and score 0;
repeated rows are encoded alike; an empty table gives an empty result; surrogates that are alone
cannot be in a Spark string; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import itertools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
N_BEST = 3
#: Stands for a blank mark that a text itself holds; no chunk is so long and unknown.
OWN_MARK = "\0" + MARK
#: Chunks remembered by a task; beyond that only those that came again stay.
REMEMBERED = 300_000
#: Bytes of text whose chunks are numbered and searched together.
TEXT_BYTES = 1 << 20

#: Chunks of up to so many characters are searched together, up to GROUP of them.
TOGETHER = 40
GROUP = 16_384
_P = np.uint64(0x9E3779B97F4A7C15)


def _hash(piece: str) -> int:
    h = 0
    for ch in piece:
        h = (h + ord(ch) + 1) * int(_P) & (2**64 - 1)
    return h


class Found(NamedTuple):
    ids: tuple[int, ...]
    score: float
    gap: float  # how far the second-best segmentation is behind; infinite if there is none


class Encoded(NamedTuple):
    ids: list[int]  # of the best segmentation
    scores: list[float]  # of the n best
    every: list[list[int]]  # ids of each of the n best

    def sizes(self) -> list[int]:
        """Number of pieces of each of the n best."""
        return [len(s) for s in self.every]

    def segmentations(self) -> list[list[int]]:
        return self.every


class Segmented(NamedTuple):
    """The n best segmentations of several texts; those of text k are first[k] to first[k + 1], a null text has none."""

    first: np.ndarray
    scores: np.ndarray
    starts: np.ndarray  # where the ids of each segmentation begin, and where the last ones end
    ids: np.ndarray

    def of(self, k: int) -> Encoded | None:
        every = [self.ids[self.starts[s] : self.starts[s + 1]].tolist() for s in range(self.first[k], self.first[k + 1])]
        return Encoded(every[0], self.scores[self.first[k] : self.first[k + 1]].tolist(), every) if every else None


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1024, dtype=kind), 0

    def extend(self, values) -> None:
        to = self.n + len(values)
        if to > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(to, 2 * self.n) - self.n, dtype=self.held.dtype)])
        self.held[self.n : to] = values
        self.n = to

    def __getitem__(self, at):
        return self.held[at]


class Vocabulary(NamedTuple):
    pieces: list[str]  # text of each id; empty for byte and control pieces
    scores: list[float]
    byte_ids: list[int]  # the id of each byte
    unknown: float  # score of a byte piece: under every other

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        odd = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        pieces = ["" if odd(i) else model.id_to_piece(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a blank mark behind another character: chunks would not be independent")
        scores = [model.get_score(i) for i in range(n)]
        return cls(pieces, scores, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], min(scores) - 10.0)


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.root: dict = {}
        for i, piece in enumerate(vocabulary.pieces):
            if piece:
                node = self.root
                for ch in piece:
                    node = node.setdefault(ch, {})
                node[""] = (i, vocabulary.scores[i])
        single = {p for p in vocabulary.pieces if len(p) == 1}
        self.known_char = single
        known = "".join(re.escape(ch) for ch in sorted(single - {MARK}))
        self.cut = re.compile(f"{MARK}+[{known}]*|[{known}]+|[\\s\\S]").findall
        self.is_known = re.compile(f"[{known}]*").fullmatch
        self.said = [p.replace(MARK, " ").encode("utf-8") for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            self.said[i] = bytes([b])
        own = [(_hash(p), i) for i, p in enumerate(vocabulary.pieces) if p]
        if len({h for h, _ in own}) < len(own):
            raise ValueError("two pieces have one hash")
        own.sort()
        self.hashes = np.array([h for h, _ in own], dtype=np.uint64)
        self.sorted_ids = np.array([i for _, i in own], dtype=np.int32)
        self.sorted_scores = np.array([vocabulary.scores[i] for _, i in own])
        self.bucket = np.searchsorted(self.hashes, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
        self.deepest = int(np.diff(self.bucket, append=len(self.hashes)).max(initial=0))
        self.begins = np.zeros(1 << 21, dtype=np.uint8)  # bit 1: what may begin a piece, bit 2: what may be one
        for piece in vocabulary.pieces:
            h = 0
            for ch in piece:
                h = (h + ord(ch) + 1) * int(_P) & (2**64 - 1)
                self.begins[h >> 43] |= 1
        self.begins[(self.hashes >> np.uint64(43)).astype(np.int64)] |= 2
        self.longest = max(map(len, vocabulary.pieces))
        self.forget()

    def forget(self) -> None:
        """Names are numbered; a number tells where the ids of a segmentation stand, how many they are, its score and its gap.

        A name without a blank is a word, for the blank mark and the word; one behind a blank is a chunk as it stands.
        """
        self.number: dict[str, int] = {}
        self.names: list[str] = []  # of each number; empty for alternatives
        self.others: dict[tuple[int, int], list[tuple[float, int]]] = {}
        self.flat, self.first, self.size, self.score, self.gap, self.uses = (Grown(k) for k in (np.int32, np.int64, np.int64, np.float64, np.float64, np.int64))

    def prune(self) -> None:
        """Forget the chunks that came once since the last time."""
        kept = [(c, k) for c, k in self.number.items() if self.uses[k] > 1]
        at = np.array([k for _, k in kept], dtype=np.int64)
        size, score, gap = self.size[at], self.score[at], self.gap[at]
        flat = self.flat[np.arange(int(size.sum())) + np.repeat(self.first[at] - (np.cumsum(size) - size), size)]
        self.forget()
        self._remember(flat, size, score, gap, [c for c, _ in kept])

    # ---- one chunk of characters that all have pieces

    def edges(self, chunk: str) -> list[list[tuple[int, int, float]]]:
        """For each start the (end, id, score) of the pieces there."""
        out, n = [], len(chunk)
        for i in range(n):
            node, here = self.root, []
            for j in range(i, n):
                node = node.get(chunk[j])
                if node is None:
                    break
                if "" in node:
                    here.append((j + 1, *node[""]))
            out.append(here)
        return out

    def viterbi(self, edges: list[list[tuple[int, int, float]]]) -> tuple[list[float], list[tuple[int, int]]]:
        """Best score of each prefix, and the (start, id) of its last piece."""
        n = len(edges)
        best, last = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
        for i in range(n):
            for end, piece, score in edges[i]:
                if best[i] + score > best[end]:
                    best[end], last[end] = best[i] + score, (i, piece)
        return best, last

    def best(self, chunk: str) -> Found:
        """The best segmentation and the gap to the second."""
        edges = self.edges(chunk)
        forward, last = self.viterbi(edges)
        n = len(chunk)
        ids, used, at = [], set(), n
        while at:
            start, piece = last[at]
            ids.append(piece)
            used.add((start, at))
            at = start
        backward, second = [-np.inf] * n + [0.0], -np.inf
        for i in range(n - 1, -1, -1):
            here = -np.inf
            for end, _, score in edges[i]:
                rest = score + backward[end]
                if rest > here:
                    here = rest
                if (i, end) not in used and forward[i] + rest > second:
                    second = forward[i] + rest
            backward[i] = here
        return Found(tuple(reversed(ids)), forward[n], forward[n] - second)

    def n_best(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Backward A* from the chunk's end; what a path may still gain is exactly the forward score of its start."""
        edges = self.edges(chunk)
        forward, _ = self.viterbi(edges)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(chunk) + 1)]
        for i, here in enumerate(edges):
            for end, piece, score in here:
                into[end].append((i, piece, score))
        heap = [(-forward[-1], len(chunk), 0, 0.0, None)]  # a path is its first piece and the path behind that
        out: list[tuple[float, tuple[int, ...]]] = []
        proposed = itertools.count(1)
        while heap and len(out) < n:
            neg, at, _, behind, path = heapq.heappop(heap)
            if not at:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((-neg, tuple(ids)))
                continue
            for i, piece, score in into[at]:
                if forward[i] > -np.inf:
                    heapq.heappush(heap, (-(forward[i] + score + behind), i, next(proposed), score + behind, (piece, path)))
        return out

    # ---- many chunks at once

    def _remember(self, flat, sizes, scores, gaps, names: list[str] | None = None) -> int:
        """Number further segmentations, whose ids stand one behind the other; gives the first number."""
        base, sizes = self.size.n, np.asarray(sizes, dtype=np.int64)
        self.first.extend(self.flat.n + np.cumsum(sizes) - sizes)
        for grown, values in ((self.flat, flat), (self.size, sizes), (self.score, scores), (self.gap, gaps), (self.uses, np.zeros(len(sizes), dtype=np.int64))):
            grown.extend(values)
        self.names += names or [""] * len(sizes)
        if names:
            self.number.update(zip(names, range(base, base + len(names)), strict=True))
        return base

    def learn(self, names) -> None:
        """Find and remember the best segmentations of names that are not remembered yet."""
        mixed = [c for c in names if c[:1] != " " and not self.is_known(c)]
        parts = [self._parts(c) for c in mixed]
        alone = set(names).difference(mixed)
        alone.update(itertools.filterfalse(self.number.__contains__, itertools.chain.from_iterable(parts)))
        self.best_many(alone)
        for name, own in zip(mixed, parts, strict=True):
            k = [self.number[p] for p in own]
            ids = np.concatenate([self._ids(x) for x in k])
            self._remember(ids, [len(ids)], [self.score[k].sum()], [self.gap[k].min()], [name])

    def _parts(self, word: str) -> list[str]:
        """The names of the chunks of a word that holds characters without a piece."""
        return [c[1:] if c[0] == MARK else " " + c for c in self.cut(MARK + word)]

    def _ids(self, number: int) -> np.ndarray:
        return self.flat[self.first[number] : self.first[number] + self.size[number]]

    def best_many(self, names) -> None:
        """`learn` of names that are one chunk each."""
        chunks = {c: c[1:] if c[:1] == " " else MARK + c for c in names}
        short = sorted([c for c, t in chunks.items() if len(t) <= TOGETHER and t[0] in self.known_char], key=lambda c: len(chunks[c]), reverse=True)
        for k in range(0, len(short), GROUP):
            group = short[k : k + GROUP]
            self._best_group(group, [chunks[c] for c in group])
        rest = {c: self.best(t) if t[0] in self.known_char else self._spelt(MARK if t == OWN_MARK else t) for c, t in chunks.items() if len(t) > TOGETHER or t[0] not in self.known_char}
        if rest:
            flat = list(itertools.chain.from_iterable(f.ids for f in rest.values()))
            self._remember(flat, [len(f.ids) for f in rest.values()], [f.score for f in rest.values()], [f.gap for f in rest.values()], list(rest))

    def remembered(self, name: str) -> Found:
        k = self.number[name]
        return Found(tuple(self._ids(k).tolist()), float(self.score[k]), float(self.gap[k]))

    def _lookup(self, h: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes, of those at the places `maybe`, are pieces', and the places of those pieces in the sorted table."""
        wanted = h[maybe]
        at = self.bucket[(wanted >> np.uint64(46)).astype(np.int64)]
        sure, place = np.zeros(len(maybe), dtype=bool), at.copy()
        for k in range(self.deepest):
            here = np.minimum(at + k, len(self.hashes) - 1)
            hit = self.hashes[here] == wanted
            sure |= hit
            place[hit] = here[hit]
        return maybe[sure], place[sure]

    def _best_group(self, names: list[str], group: list[str]) -> None:
        """`best` of many chunks, the longest first: those that reach a place are the first of them."""
        m, lens = len(group), np.array([len(c) for c in group])
        n, every = int(lens[0]), np.arange(m)
        inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        codes = np.zeros((n, m), dtype=np.uint64)
        codes[inner, np.repeat(every, lens)] = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        reach = [int(k) for k in np.searchsorted(-lens, -np.arange(n + 1), side="right")]  # how many chunks have so many characters
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0.0
        start, piece = np.zeros((n + 1, m), dtype=np.int16), np.zeros((n + 1, m), dtype=np.int32)
        found: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        for i in range(n):
            live, h = np.flatnonzero(best[i, : reach[i + 1]] > -np.inf), np.zeros(1, dtype=np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if j > i + 1:
                    cut = int(np.searchsorted(live, reach[j]))
                    live, h = live[:cut], h[:cut]
                h = (h + codes[j - 1, live]) * _P
                kind = self.begins[(h >> np.uint64(43)).astype(np.int64)]
                begins = kind & 1 > 0
                live, h = live[begins], h[begins]  # only what begins a piece can become one
                if not len(live):
                    break
                own, at = self._lookup(h, np.flatnonzero(kind[begins] & 2))
                if len(own):
                    rows = live[own]
                    score = self.sorted_scores[at]
                    total = best[i, rows] + score
                    better = total > best[j, rows]
                    up = rows[better]
                    best[j, up], start[j, up], piece[j, up] = total[better], i, self.sorted_ids[at[better]]
                    found[i].append((j, rows, score))
        follows = np.zeros((n + 1, m), dtype=np.int16)  # where the best path goes from a place; 0: it does not come there
        rows, place, steps = every, lens.copy(), []
        while len(rows):
            before = start[place, rows].astype(np.int64)
            follows[before, rows] = place
            steps.append((rows, piece[place, rows]))
            rows, place = rows[before > 0], before[before > 0]
        sizes = np.bincount(np.concatenate([r for r, _ in steps]), minlength=m)
        last = np.cumsum(sizes) - 1
        flat = np.zeros(int(sizes.sum()), dtype=np.int32)
        for back, (r, ids) in enumerate(steps):
            flat[last[r] - back] = ids
        rest = np.full((n + 1, m), -np.inf)
        rest[lens, every] = 0.0
        second = np.full(m, -np.inf)
        for i in range(n - 1, -1, -1):
            for j, r, score in found[i]:
                after = score + rest[j, r]
                rest[i, r] = np.maximum(rest[i, r], after)
                other = np.where(follows[i, r] == j, -np.inf, best[i, r] + after)
                second[r] = np.maximum(second[r], other)
        top = best[lens, every]
        self._remember(flat, sizes, top, top - second, names)

    # ---- texts

    def split(self, text: str) -> list[str]:
        """Chunks of a text: stretches of known characters that begin at blanks, and other characters alone."""
        return self.cut(MARK + text.replace(" ", MARK))

    def _spelt(self, chars: str) -> Found:
        ids = tuple(self.v.byte_ids[b] for b in chars.encode("utf-8", "surrogatepass"))
        return Found(ids, self.v.unknown * len(ids), np.inf)

    def encode_all(self, texts: list[str | None], n: int = 1) -> Segmented:
        """The n best segmentations of each text; chunks that are new are searched together."""
        parts = [None if t is None else self.split_names(t) if t else [] for t in texts]
        chunks = list(itertools.chain.from_iterable(filter(None, parts)))
        if len(self.number) > REMEMBERED:
            self.prune()
        num = np.fromiter(map(self.number.get, chunks, itertools.repeat(-1)), dtype=np.int64, count=len(chunks))
        missing = np.flatnonzero(num < 0)
        new = [chunks[k] for k in missing.tolist()]
        self.learn(set(new))
        num[missing] = np.fromiter(map(self.number.__getitem__, new), dtype=np.int64, count=len(new))
        self.uses.held[: self.size.n] += np.bincount(num, minlength=self.size.n)
        lens = np.array([len(p) if p else 0 for p in parts], dtype=np.int64)
        begin = np.cumsum(lens) - lens
        score, gap = self.score[num], self.gap[num]
        options = [[] if p is None else self._options(num, gap, a, a + size, n) for p, a, size in zip(parts, begin.tolist(), lens.tolist(), strict=True)]
        best = [float(score[a : a + size].sum()) for a, size in zip(begin.tolist(), lens.tolist(), strict=True)]
        counts = np.array([len(o) for o in options], dtype=np.int64)
        size = np.repeat(lens, counts)  # chunks of each segmentation, and where they begin
        at = np.cumsum(size) - size
        which = num[np.arange(int(size.sum())) + np.repeat(np.repeat(begin, counts) - at, size)]
        every = [(lost, picks, a, top) for o, a, top in zip(options, begin.tolist(), best, strict=True) for lost, picks in o]
        for (_, picks, a, _), to in zip(every, at.tolist(), strict=True):
            for k, rank in picks:
                which[to + k - a] = self._alternatives(int(num[k]), n)[rank][1]
        pieces = self.size[which]
        ends = np.concatenate([[0], np.cumsum(pieces)])
        ids = self.flat[np.arange(int(ends[-1])) + np.repeat(self.first[which] - ends[:-1], pieces)]
        return Segmented(np.concatenate([[0], np.cumsum(counts)]), np.array([top - lost for lost, _, _, top in every]), ends[np.append(at, len(which))], ids)

    def encode(self, text: str, n: int = 1) -> Encoded:
        return self.encode_all([text], n).of(0)

    def _alternatives(self, number: int, n: int) -> list[tuple[float, int]]:
        """What each of a chunk's n best segmentations loses against the best, and its number."""
        known = self.others.get((number, n))
        if known is None:
            top, ids = float(self.score[number]), tuple(self._ids(number).tolist())
            if self.is_known(self.names[number].lstrip(" " + MARK)):
                found = [(top, ids)]  # Viterbi's own stands first among equals
                found = (found + [f for f in self.n_best(self._text_of(ids), n) if f[1] != ids])[:n]
            else:
                found = self._combined(self._parts(self.names[number]), n)
            base = self._remember(list(itertools.chain.from_iterable(alt for _, alt in found)), [len(alt) for _, alt in found], [s for s, _ in found], [np.inf] * len(found))
            known = self.others[number, n] = [(top - s, base + k) for k, (s, _) in enumerate(found)]
        return known

    def _combined(self, parts: list[str], n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Scores and ids of the n best of a word of several chunks."""
        self.learn({p for p in parts if p not in self.number})
        num = np.array([self.number[p] for p in parts], dtype=np.int64)
        out = []
        for lost, picks in self._options(num, self.gap[num], 0, len(num), n):
            own = num.copy()
            for k, rank in picks:
                own[k] = self._alternatives(int(num[k]), n)[rank][1]
            out.append((float(self.score[num].sum()) - lost, tuple(np.concatenate([self._ids(k) for k in own]).tolist())))
        return out

    def _options(self, num: np.ndarray, gaps: np.ndarray, a: int, b: int, n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """Of a text's n best: what each loses, and (place, rank) of the chunks that are not as in the best.

        Of the n best sums only the n - 1 chunks with the smallest gaps leave their best.
        """
        sums: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        if n == 1 or a == b:
            return sums
        own, most = gaps[a:b], min(n - 1, b - a)
        worst = min(float(np.partition(own, most - 1)[most - 1]), 1e300)
        near = np.flatnonzero(own <= worst)
        near = np.sort(near[np.argsort(own[near], kind="stable")][:most])
        for k in near.tolist():
            choices = self._alternatives(int(num[a + k]), n)
            sums = heapq.nsmallest(n, [(lost + more, (*picks, (a + k, rank)) if rank else picks) for lost, picks in sums for rank, (more, _) in enumerate(choices)])
        return sums

    def split_names(self, text: str) -> list[str]:
        """The names of what a text falls into: words, where single blanks part them, or else chunks."""
        if MARK not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        out: list[str] = []
        for k, part in enumerate(text.split(MARK)):  # the marks that the text itself holds are chunks of their own
            here = self.split(part) if k == 0 else self.cut(part.replace(" ", MARK))
            out += [" " + c for c in ([OWN_MARK, *here] if k else here)]
        return out

    def _text_of(self, ids) -> str:
        return "".join([self.v.pieces[i] for i in ids])

    def spoken(self, ids: list[int]) -> bytes:
        """The UTF-8 bytes that the ids stand for, behind the blank that encoding put before the text."""
        return b"".join(map(self.said.__getitem__, ids))[1:]

    def decode(self, ids: list[int]) -> str:
        """The text whose segmentation the ids are."""
        return self.spoken(ids).decode("utf-8", "replace")


def encoded(docs: DataFrame, model: str = MODEL, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, piece count and score of the best segmentation, scores and ids of the n best (the best first), and whether decoding the best gives the text back."""
    common.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))  # as large as the model
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        codec = Codec(held.value)  # lives as long as the task, so that a worker that is used again starts empty

        def run(batch: pa.RecordBatch) -> dict:
            ts = batch.column("t").to_pylist()
            out = codec.encode_all(ts, n)
            null = np.array([t is None for t in ts])
            firsts = pa.array(out.first.astype(np.int32), mask=np.append(null, False))
            every = pa.ListArray.from_arrays(pa.array(out.starts.astype(np.int32)), pa.array(out.ids))
            best = pa.array(np.minimum(out.first[:-1], max(0, len(every) - 1)), mask=null)
            sizes = pa.array(np.diff(out.starts).astype(np.int32))
            same = [None if t is None else codec.spoken(out.ids[out.starts[k] : out.starts[k + 1]].tolist()) == t.encode("utf-8", "surrogatepass") for t, k in zip(ts, out.first.tolist(), strict=False)]
            return {
                "doc_id": batch.column("id"),
                "n_pieces": sizes.take(best),
                "score": pa.array(out.scores, type=pa.float64()).take(best),
                "nbest_scores": pa.ListArray.from_arrays(firsts, pa.array(out.scores, type=pa.float64())),
                "round_trip": same,
                "nbest_ids": pa.ListArray.from_arrays(firsts, every),
            }

        return run

    return common.mapped(
        docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as t"),
        start,
        f"doc_id {kind}, n_pieces bigint, score double, nbest_scores array<double>, round_trip boolean, nbest_ids array<array<int>>",
        TEXT_BYTES,
        per_task=True,
    )


def decoded(df: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "nbest_ids[0]") -> DataFrame:
    """For each row its id and the text of its ids (ids_col: an expression)."""
    common.small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    kind = df.schema[id_col].dataType.simpleString()

    def start():
        codec = Codec(held.value)
        return lambda batch: {"doc_id": batch.column("id"), "text": [None if ids is None else codec.decode(ids) for ids in batch.column("ids").to_pylist()]}

    return common.mapped(df.selectExpr(f"`{id_col}` as id", f"{ids_col} as ids"), start, f"doc_id {kind}, text string", per_task=True)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(common.table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the scores and piece ids of each document's n best segmentations."""
    return encoded(docs)
