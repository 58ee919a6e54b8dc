"""SimHash near-duplicates, linked by a generalised pigeonhole over correlated bit groups.

1. Every text gets a 64-bit fingerprint from the XXH64 of its word shingles.
2. From 64 x 64 bit co-occurrence counts over all distinct fingerprints, correlated bits are put into the same
   group; each group keeps value counts of its sub-blocks (a fixed number of cells, whatever the input).
3. For each fingerprint, dynamic programming chooses thresholds t_1..t_m, each at least -1, with
   sum(t) = distance - m + 1, at the least estimated number of probes and candidates. By the pigeonhole any
   fingerprint within the distance agrees with it in some group up to t_i differing bits.
4. Fingerprints and probes meet by (group, value); candidates are verified, and each meeting emits only a
   spanning forest of its verified links, so a dense group of n fingerprints gives n - 1 rows.

With a similarity asked for, the same is done on the fingerprints of the sets of shingles, and goes on over LANES of them
by other hashes, since 64 bits alone cannot reach so far: texts that agree on 16 bits in a row of any lane meet, those
near in 128 bits are candidates, and a link needs the exact similarity of the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeframe.llm.common import Words, cut, mix64, text_blocks, utf8
from lodeframe.llm.graph import components

SEED = 42
SUB_BITS = 11
#: Members of one (group, value) that meet in one cell; larger ones are dealt into a grid of cells.
CELL = 20_000


def fingerprint_words(words: list[bytes], width: int) -> list[int]:
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)))


def _shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and each text's number of them."""
    each = [fingerprint_words(t.lower().split(), width) for t in texts]
    counts = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
    return np.fromiter((h for x in each for h in x), dtype=np.uint64, count=int(counts.sum())), counts


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the bits set in over half of its hashes; 0 for a text without any."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[some]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little")
        out[some] = packed.view(np.uint64).ravel()
    return out


def fingerprint_block(texts: list[bytes], width: int = 3) -> np.ndarray:
    """Fingerprints (uint64) of UTF-8 texts; a text without words has 0."""
    return _majority(*_shingle_hashes(texts, width))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long): one row for each row of docs. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            parts = [fingerprint_block(texts[a:b], width) for a, b in text_blocks(texts)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long")


def bit_pairs(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits that are set together, over all fingerprints."""

    def run(batches):
        total = np.zeros((64, 64), dtype=np.int64)
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for i in range(0, len(fp), 65_536):
                bits = np.unpackbits(fp[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "n"])

    out = np.zeros((64, 64), dtype=np.int64)
    for i, j, n in fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[i, j] = n
    return out


def correlated_groups(pairs: np.ndarray, rows: int, groups: int) -> list[list[int]]:
    """Greedy partition of the 64 bits: each group grows by the bit most correlated with it."""
    p = np.diag(pairs) / max(rows, 1)
    cov = pairs / max(rows, 1) - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = list(range(64)), []
    for g in range(groups):
        size = 64 // groups + (g < 64 % groups)
        first = max(free, key=lambda b: (corr[b, free].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(group)
    return out


def pick_bits(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def sub_blocks(group: list[int]) -> list[list[int]]:
    n = -(-len(group) // SUB_BITS)
    return [x.tolist() for x in np.array_split(np.array(group), n)]


def value_counts(fps: DataFrame, groups: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """Counts of the values of each group's sub-blocks: at most 2**SUB_BITS cells each."""

    def run(batches):
        held = {(g, s): np.zeros(1 << len(b), np.int64) for g, x in enumerate(groups) for s, b in enumerate(sub_blocks(x))}
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for (g, s), n in held.items():
                n += np.bincount(pick_bits(fp, sub_blocks(groups[g])[s]).astype(np.int64), minlength=len(n))
        for (g, s), n in held.items():
            at = np.flatnonzero(n)
            full = lambda x: pa.array(np.full(len(at), x, np.int32))
            yield pa.RecordBatch.from_arrays([full(g), full(s), pa.array(at.astype(np.int32)), pa.array(n[at])], ["g", "s", "v", "n"])

    out = {(g, s): np.zeros(1 << len(b), np.int64) for g, x in enumerate(groups) for s, b in enumerate(sub_blocks(x))}
    counted = fps.select("fp").mapInArrow(run, "g int, s int, v int, n long").groupBy("g", "s", "v").agg(F.sum("n").alias("n"))
    for g, s, v, n in counted.collect():
        out[g, s][v] = n
    return out


def spheres(counts: np.ndarray, most: int) -> np.ndarray:
    """[e, v]: how many have exactly e bits differing from v."""
    bits = len(counts).bit_length() - 1
    out = np.zeros((most + 1, len(counts)))
    out[0] = counts
    at = np.arange(len(counts))
    for b in range(bits):
        flipped = out[:, at ^ (1 << b)]
        out[1:] += flipped[:-1]
    return out


class Allocation:
    """Per-fingerprint thresholds of the groups, by dynamic programming on estimated candidate counts."""

    PROBE, CANDIDATE = 1.0, 0.25

    def __init__(self, groups: list[list[int]], counts: dict[tuple[int, int], np.ndarray], rows: int, distance: int):
        self.groups, self.distance, self.rows = groups, distance, max(rows, 1)
        self.spheres = {k: spheres(v / self.rows, distance) for k, v in counts.items()}

    def candidates(self, fp: np.ndarray, g: int) -> np.ndarray:
        """[row, e]: estimated number of fingerprints within e bits of the row's value in group g."""
        exact = np.zeros((len(fp), self.distance + 1))
        exact[:, 0] = 1
        for s, bits in enumerate(sub_blocks(self.groups[g])):
            share = self.spheres[g, s][:, pick_bits(fp, bits).astype(np.int64)].T
            exact = np.stack([(exact[:, : e + 1] * share[:, e::-1]).sum(axis=1) for e in range(self.distance + 1)], axis=1)
        return np.cumsum(exact, axis=1) * self.rows

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """[row, group] thresholds >= -1 whose sum is distance - groups + 1."""
        m, most = len(self.groups), self.distance
        steps = most + 1  # to deal out in units: t + 1 >= 0, sum(t + 1) = distance + 1
        best = np.full((len(fp), steps + 1), np.inf)
        best[:, 0] = 0
        chosen = np.zeros((m, len(fp), steps + 1), dtype=np.int8)
        for g in range(m):
            near = self.candidates(fp, g)
            cost = np.zeros((len(fp), steps + 1))
            for t in range(most + 1):
                probes = sum(comb(len(self.groups[g]), e) for e in range(t + 1))
                cost[:, t + 1] = self.PROBE * probes + self.CANDIDATE * near[:, t]
            following = np.full_like(best, np.inf)
            for total in range(steps + 1):
                options = np.stack([best[:, total - u] + cost[:, u] for u in range(total + 1)], axis=1)
                chosen[g, :, total] = options.argmin(axis=1)
                following[:, total] = options.min(axis=1)
            best = following
        out, left, rows = np.zeros((len(fp), m), dtype=np.int64), np.full(len(fp), steps), np.arange(len(fp))
        for g in reversed(range(m)):
            out[:, g] = chosen[g, rows, left]
            left = left - out[:, g]
        return out - 1


def ball(width: int, radius: int) -> np.ndarray:
    masks = [sum(1 << b for b in bits) for e in range(radius + 1) for bits in combinations(range(width), e)]
    return np.array(masks, dtype=np.uint64)


def meetings(fps: DataFrame, plan: Allocation) -> DataFrame:
    """(key, kind, fp): kind 0, a fingerprint under its own value in each group; kind 1, the values it probes."""

    def run(batches):
        balls = {}
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for low in range(0, len(every), 8192):
                fp = every[low : low + 8192]
                limits = plan.thresholds(fp)
                for g, bits in enumerate(plan.groups):
                    value, top = pick_bits(fp, bits), np.uint64(g << 56)
                    parts = [(value | top, fp, 0)]
                    for t in range(plan.distance + 1):
                        rows = np.flatnonzero(limits[:, g] == t)
                        if len(rows):
                            if (g, t) not in balls:
                                balls[g, t] = ball(len(bits), t)
                            masks = balls[g, t]
                            parts.append((((value[rows, None] ^ masks) | top).ravel(), np.repeat(fp[rows], len(masks)), 1))
                    for key, who, kind in parts:
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), kind, np.int8)), pa.array(who.view(np.int64))], ["key", "kind", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, kind byte, fp long")


def forest(nodes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between some distinct fingerprints, by breadth-first search in blocks."""
    left, us, vs = nodes, [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, min(len(front), (1 << 21) // len(left)))
            near = np.bitwise_count(front[:step, None] ^ left[None, :]) <= distance
            hit = near.any(axis=0)
            parent = front[:step][near.argmax(axis=0)[hit]]
            us.append(left[hit])
            vs.append(parent)
            front, left = np.concatenate([front[step:], left[hit]]), left[~hit]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def links_in_cells(met: DataFrame, distance: int) -> DataFrame:
    """(u, v) links within each (key, cell) of rows sorted by key, cell, kind."""

    def cells(group, kind, fp):
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(edge, len(group)))
        members = np.add.reduceat((kind == 0).astype(np.int64), edge)
        visitors = size - members
        pairs = members * visitors
        for i in np.flatnonzero((pairs > 64) & (size > 1)):
            yield forest(np.unique(fp[edge[i] : edge[i] + size[i]]), distance)
        few = np.flatnonzero((pairs > 0) & (pairs <= 64) & (size > 1))
        for low in range(0, len(few), 65_536):
            g = few[low : low + 65_536]
            n = pairs[g]
            of = np.repeat(np.arange(len(g)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = fp[edge[g][of] + k % members[g][of]]
            b = fp[edge[g][of] + members[g][of] + k // members[g][of]]
            ok = (a != b) & (np.bitwise_count(a ^ b) <= distance)
            yield a[ok], b[ok]

    def run(batches):
        kept = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(now[0]):
                continue
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            done = last[-1] + 1 if len(last) else 0
            kept = [x[done:] for x in now]
            if done:
                yield from told([x[:done] for x in now])
        if kept is not None:
            yield from told(kept)

    def told(now):
        key, cell, kind, fp = now
        group = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
        for u, v in cells(group, kind, fp.view(np.uint64)):
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return met.mapInArrow(run, "u long, v long")


def near_links(fps: DataFrame, rows: int, *, distance: int = 3, groups: int | None = None, cell: int = CELL) -> DataFrame:
    """(u, v) links that join exactly the distinct fingerprints (fp) within distance bits of each other: every
    pair within the distance is linked directly or over others that are."""
    m = groups or (3 if rows <= 1 << 26 else 2)
    plan_groups = correlated_groups(bit_pairs(fps), rows, m)
    plan = Allocation(plan_groups, value_counts(fps, plan_groups), rows, distance)
    met = meetings(fps, plan)
    hot = cut(met.where("kind = 0").groupBy("key").count().where(F.col("count") > cell).select(F.col("key").alias("hot_key"), F.ceil(F.col("count") / cell).cast("int").alias("k")), "hot")
    n_hot = hot.count()
    if n_hot:
        side = F.broadcast(hot) if n_hot <= 1_000_000 else hot
        k, own = F.coalesce("k", F.lit(1)), F.pmod(F.xxhash64("fp"), F.coalesce("k", F.lit(1))).cast("int")
        grid = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(F.col("kind") == 0, own * k + j).otherwise(j * k + own))
        met = met.join(side, F.col("key") == F.col("hot_key"), "left").select("key", F.explode(grid).alias("cell"), "kind", "fp")
    else:
        met = met.select("key", F.lit(0).alias("cell"), "kind", "fp")
    met = met.repartition("key", "cell").sortWithinPartitions("key", "cell", "kind")
    return links_in_cells(met, distance)


#: Words of a segment on average, and the fewest that make one.
SEGMENT, LEAST_SEGMENT = 16, 5
#: Longs of a wide fingerprint.
WIDE = 4
#: Fingerprints of each set of shingles, and the bits of a group in which texts meet: of two sets of similarity 0.8 a bit
#: differs with probability 0.15, so none of the 124 groups past the first lane agrees with probability 1e-4.
LANES, GROUP_BITS = 32, 16
#: Nodes of one component whose sets of shingles meet in one cell.
SET_CELL = 1_000


def segments(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the segments of each text: its words, lower-cased, cut after words whose own hash says so. An edit
    changes one or two segments; all others stay."""
    words = Words([t.lower() for t in texts])
    n = len(words.hashes)
    if not n:
        return [np.zeros(0, np.uint64)] * len(texts)
    ends = words.hashes % np.uint64(SEGMENT) == 0
    start = np.append(True, ends[:-1] | (words.text[1:] != words.text[:-1]))
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, n))
    place = (np.arange(n) - np.repeat(at, size)).astype(np.uint64)
    summed = mix64(np.add.reduceat(mix64(words.hashes + place * np.uint64(0x9E3779B97F4A7C15)), at))
    kept = size >= LEAST_SEGMENT
    of, summed = words.text[at][kept], summed[kept]
    edge = np.searchsorted(of, np.arange(len(texts) + 1))
    return [np.unique(summed[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def wide_limit(similarity: float) -> int:
    """Differing bits of wide fingerprints up to which texts of that shingle similarity (Jaccard) are expected, with
    a margin of two deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * WIDE
    return round(bits * share + 2 * math.sqrt(bits * share * (1 - share)))


def _sets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, in order, and their numbers."""
    if not len(hashes):
        return hashes, counts
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    once = np.append(True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1]))
    return hashes[once], np.bincount(of[once], minlength=len(counts))


def _set_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each text's set of shingles (as _sets() has them); 0 for a text without any."""
    out, some = np.zeros(len(counts), dtype=np.uint64), np.flatnonzero(counts)
    if len(some):
        out[some] = mix64(np.add.reduceat(mix64(hashes ^ np.uint64(0xA0761D6478BD642F)), (np.cumsum(counts) - counts)[some]))
    return out


_MASKS, _FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, LANES), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def lanes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[text, lane]: SimHash fingerprints of each text's hashes, the first lane's by the hashes themselves, as _majority()
    has them, the others' by further hashes of them. 0 for a text without any."""
    out, some = np.zeros((len(counts), LANES), dtype=np.uint64), np.flatnonzero(counts)
    if not len(some):
        return out
    n, starts = counts[some], (np.cumsum(counts) - counts)[some]
    runs = -(-n // 255)  # counters of a byte hold as many
    first = np.cumsum(runs) - runs
    cuts = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    for lane in range(LANES):
        h = hashes
        if lane:
            h = (hashes ^ _MASKS[lane]) * _FACTORS[lane]
            h ^= h >> np.uint64(32)
        bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits.view(np.uint64), cuts, axis=0).view(np.uint8)  # eight counters at a time
        ones = np.add.reduceat(sums, first, axis=0, dtype=np.int32)
        out[some, lane] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _wide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for two lanes."""
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + mix64(b ^ np.uint64(0xD6E8FEB86659FD93)))


def sketches(docs: DataFrame, similarity: float, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, fp, node, a, b, wide, keys, rest): as fingerprints(), with a hash of the set of shingles, the fingerprints
    of its first two lanes, a key of both, its values in the groups of the other lanes, and the text of rows without an id.
    Sets too small to have a like one that is not equal have no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, parts = utf8(batch.column(1)), []
            for low, high in text_blocks(texts):
                hashes, counts = _shingle_hashes(texts[low:high], width)
                fp = _majority(hashes, counts)
                hashes, counts = _sets(hashes, counts)
                wide = lanes(hashes, counts)
                keys = wide[:, 1:].copy().view(np.uint16).astype(np.int32)
                keys += np.arange(keys.shape[1], dtype=np.int32) << GROUP_BITS
                some = counts * (1 - similarity) >= similarity - 1e-9
                a, b = wide[:, 0].copy(), wide[:, 1].copy()
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some * keys.shape[1])).astype(np.int32)), pa.array(keys[some].ravel()))
                parts.append([*(pa.array(x.view(np.int64)) for x in (fp, _set_keys(hashes, counts), a, b, _wide(a, b))), listed])
            rest = pa.array([t if i is None else None for t, i in zip(texts, batch.column(0).to_pylist(), strict=True)], pa.binary()).cast(pa.string())
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.concat_arrays(x) for x in zip(*parts, strict=True)), rest], ["doc_id", "fp", "node", "a", "b", "wide", "keys", "rest"])

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long, node long, a long, b long, wide long, keys array<int>, rest string")


def lane_limit(similarity: float) -> int:
    """Differing bits of two lanes up to which sets of that similarity are candidates: those expected and four and a half
    deviations."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(128 * share + 4.5 * math.sqrt(128 * share * (1 - share)))


def near_in_groups(group: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of rows of one group (rows are sorted by it) whose two lanes differ in at most limit bits: all such pairs
    of small groups, a spanning forest of those of larger ones."""
    few = 12
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(edge, len(group)))
    small = np.repeat(size <= few, size)
    for d in range(1, few):
        i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
        near = np.bitwise_count(a[i] ^ a[i + d]) + np.bitwise_count(b[i] ^ b[i + d]) <= limit
        yield i[near], i[near] + d
    for at in np.flatnonzero(size > few):
        left = np.arange(edge[at], edge[at] + size[at])
        while len(left):
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                now = front[: max(1, (1 << 21) // len(left))]
                near = np.bitwise_count(a[now, None] ^ a[None, left]) + np.bitwise_count(b[now, None] ^ b[None, left]) <= limit
                hit = near.any(axis=0)
                yield left[hit], now[near.argmax(axis=0)[hit]]
                front, left = np.concatenate([front[len(now) :], left[hit]]), left[~hit]


def stars(u: list[int], v: list[int]) -> tuple[list[int], list[int]]:
    """(node, root) for every node of these links but the roots, the least nodes of their components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b in zip(u, v, strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    return nodes, [find(x) for x in nodes]


def lane_links(distinct: DataFrame, rows: int, similarity: float, *, cell: int = CELL) -> DataFrame:
    """(u, v) links between wide keys of rows (keys, a, b) that share one of the keys and are near in a and b, as stars
    around the least of all that a task has linked: the tasks that see a large group so tell the same few links. Keys of
    more than `cell` rows are dealt into a grid of cells for each two parts of them."""
    limit = lane_limit(similarity)
    each = distinct.select(F.explode("keys").alias("key"), "a", "b")
    # keys of more rows than a cell lie in ranges of keys with more: ranges, as many as rows allow, are counted first
    bits = min(GROUP_BITS, max(0, math.ceil(math.log2(max(1.0, 4 * rows / cell)))))
    coarse = F.shiftright("key", GROUP_BITS - bits)
    full = cut(each.groupBy(coarse.alias("range")).count().where(F.col("count") > cell).select("range"), "hot")
    hot, n_hot = None, 0
    if full.count():
        hot = each.join(full, coarse == F.col("range"), "left_semi").groupBy("key").count().where(F.col("count") > cell)
        hot = cut(hot.select(F.col("key").alias("hot_key"), F.ceil(F.col("count") / cell).cast("int").alias("k")), "hot")
        n_hot = hot.count()
    if n_hot:
        side = F.broadcast(hot) if n_hot <= 1_000_000 else hot
        k, own = F.coalesce("k", F.lit(1)), F.pmod(F.xxhash64("a", "b"), F.coalesce("k", F.lit(1))).cast("int")
        cells = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.least(own, j) * k + F.greatest(own, j))
        each = each.join(side, F.col("key") == F.col("hot_key"), "left").select("key", F.explode(cells).alias("cell"), "a", "b")
    else:
        each = each.select("key", F.lit(0).alias("cell"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, us, vs = [], 0, [], []
        for batch in batches:
            kept.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            held += batch.num_rows
            if held >= 1 << 16:
                now = [np.concatenate(x) for x in zip(*kept, strict=True)]
                done = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
                done = done[-1] + 1 if len(done) else 0
                told([x[:done] for x in now], us, vs)
                kept = [[x[done:] for x in now]]
                held = 0  # a cell of many rows is looked at again after as many more
            if len(us) >= 1 << 18:
                us, vs = stars(us, vs)
                if len(us) >= 1 << 17:  # not many links of a few nodes, but links of many nodes
                    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                    us, vs = [], []
        if kept:
            told([np.concatenate(x) for x in zip(*kept, strict=True)], us, vs)
        us, vs = stars(us, vs)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    def told(now: list[np.ndarray], us: list[int], vs: list[int]) -> None:
        key, part, a, b = now
        if len(key) > 1:
            a, b = a.view(np.uint64), b.view(np.uint64)
            name = _wide(a, b).view(np.int64)
            group = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
            for i, j in near_in_groups(group, a, b, limit):
                us += name[i].tolist()
                vs += name[j].tolist()

    return each.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, "u long, v long")


def candidate_links(distinct: DataFrame, similarity: float, *, distance: int = 3, groups: int | None = None, cell: int = CELL) -> DataFrame:
    """(u, v) links over wide keys and first fingerprints of the rows (a, b, wide, keys) that are candidates: within distance
    bits of each other in the first lane, by near_links(), or near in two lanes and met in a group of another."""
    able = cut(distinct.where(F.size("keys") > 0).select("a", "b", "wide", "keys").distinct(), "able")
    fps = cut(able.groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("n")), "fps")
    close = cut(near_links(fps, fps.count(), distance=distance, groups=groups, cell=cell).distinct(), "close")
    # wide keys come to a fingerprint that others have or are close to
    met = close.select(F.col("u").alias("fp")).unionAll(close.select(F.col("v").alias("fp"))).unionAll(fps.where("n > 1").select("fp")).distinct()
    joined = able.join(met, F.col("a") == F.col("fp")).select(F.col("wide").alias("u"), F.col("fp").alias("v"))
    return close.unionAll(joined).unionAll(lane_links(able, able.count(), similarity, cell=cell))


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning forest, as indexes, of the pairs of sets whose Jaccard similarity is at least the asked one: breadth-first
    search that counts the common elements of one set and all that are left."""
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    edge = np.append(0, np.cumsum(size))
    values, every = np.unique(np.concatenate(sets), return_inverse=True)
    ids = [every[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    mark, left, out = np.zeros(len(values), dtype=bool), np.arange(len(sets)), []
    while len(left):
        front, left, flat = [left[0]], left[1:], None
        while front and len(left):
            if flat is None:
                flat, starts = np.concatenate([ids[i] for i in left]), np.cumsum(size[left]) - size[left]
            one = front.pop()
            mark[ids[one]] = True
            common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[ids[one]] = False
            hit = common >= similarity * (size[one] + size[left] - common) - 1e-9
            if hit.any():
                front += left[hit].tolist()
                out += [(int(one), int(i)) for i in left[hit]]
                left, flat = left[~hit], None
    return out


def verified_links(docs: DataFrame, distinct: DataFrame, links: DataFrame, similarity: float, *, width: int, cell: int = CELL) -> DataFrame:
    """(u, v) links between nodes (node, least, wide, rest) whose sets of shingles, taken from docs (doc_id, text) once
    more, have at least the Jaccard similarity: every such pair that some chain of candidate links between wide keys
    joins is linked, directly or over others that are.

    The sets of one component of the candidate links come together; where it has more than `cell` nodes, in a grid of
    cells for each two parts of it. Each cell emits a spanning forest of its verified links.
    """
    roots = components(links).select(F.col("node").alias("wide_node"), "root")
    placed = cut(distinct.join(roots, F.col("wide") == F.col("wide_node")).select("node", "root"), "meetings")
    hot = cut(placed.groupBy("root").count().where(F.col("count") > cell).select(F.col("root").alias("hot_root"), F.ceil(F.col("count") / cell).cast("int").alias("k")), "hot")
    n_hot = hot.count()
    if n_hot:
        side = F.broadcast(hot) if n_hot <= 1_000_000 else hot
        k, own = F.coalesce("k", F.lit(1)), F.pmod(F.xxhash64("node"), F.coalesce("k", F.lit(1))).cast("int")
        # cell (i, j), i <= j, holds parts i and j
        cells = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.least(own, j) * k + F.greatest(own, j))
        placed = placed.join(side, F.col("root") == F.col("hot_root"), "left").select("node", "root", cells.alias("cells"))
    else:
        placed = placed.select("node", "root", F.array(F.lit(0)).alias("cells"))
    asked = cut(distinct.select(F.col("node").alias("own_node"), "least", "rest").join(placed, F.col("own_node") == F.col("node")).select("node", "root", "cells", "least", "rest"), "asked")
    by_id = docs.join(asked.drop("rest").where("least is not null"), F.col("doc_id") == F.col("least")).select("root", "cells", "node", "text")
    others = asked.where("least is null").select("root", "cells", "node", F.col("rest").alias("text"))
    rows = by_id.unionAll(others).select("root", F.explode("cells").alias("cell"), "node", "text").repartition("root", "cell").sortWithinPartitions("root", "cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []
        for batch in batches:
            roots, cells, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            texts, out = utf8(batch.column(3)), []
            for low, high in text_blocks(texts):
                hashes, counts = _shingle_hashes(texts[low:high], width)
                hashes, counts = _sets(hashes, counts)
                found, end = _set_keys(hashes, counts).view(np.int64), np.cumsum(counts)
                for i in range(low, high):
                    if at != (roots[i], cells[i]):
                        out += told(nodes, sets)
                        at, nodes, sets = (roots[i], cells[i]), [], []
                    # rows that repeat an id may have the text of another node
                    if found[i - low] == ids[i] and (not nodes or nodes[-1] != ids[i]):
                        nodes.append(int(ids[i]))
                        sets.append(hashes[end[i - low] - counts[i - low] : end[i - low]])
            yield rows_of(out)
        yield rows_of(told(nodes, sets))

    def told(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        return [(nodes[a], nodes[b]) for a, b in jaccard_forest(sets, similarity)] if len(sets) > 1 else []

    def rows_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, similarity: float | None = None, groups: int | None = None, cell: int = CELL) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the least doc_id that fingerprints within distance bits reach. With a similarity it is the least
    doc_id that links between texts of that Jaccard similarity of their shingles reach: fingerprints of the sets within
    distance bits, and, as a similarity of 0.8 moves 64 bits by ten, those near in more lanes (candidate_links()), each
    verified on the shingles themselves, since fingerprints alone do not tell 0.8 from 0.7.
    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows and equal texts share a
    fingerprint and so a component. A null doc_id keeps its row; it does not lead a component unless no other is
    there. An empty table gives an empty result. Other columns of docs are not looked at.
    """
    if similarity is None:
        of = cut(fingerprints(docs, id_col=id_col, text_col=text_col, width=width).withColumn("node", F.col("fp")), "fingerprints")
        distinct = cut(of.groupBy("node").agg(F.min("doc_id").alias("least")).withColumn("fp", F.col("node")), "distinct")
        links = near_links(distinct, distinct.count(), distance=distance, groups=groups, cell=cell)
    else:
        of = cut(sketches(docs, similarity, id_col=id_col, text_col=text_col, width=width), "fingerprints")
        one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "a", "b", "wide", "keys", "rest"))
        distinct = cut(of.groupBy("node").agg(one.alias("_one")).select("node", F.col("_one.doc_id").alias("least"), "_one.a", "_one.b", "_one.wide", "_one.keys", "_one.rest"), "distinct")
        chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
        near = candidate_links(distinct, similarity, distance=distance, groups=groups, cell=cell)
        links = verified_links(chosen, distinct, near, similarity, width=width, cell=min(cell, SET_CELL))
    roots = components(links).withColumnRenamed("node", "root_node")
    placed = distinct.join(roots, F.col("node") == F.col("root_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    leaders = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(leaders, "root").select(F.col("node").alias("class_node"), "component_id")
    joined = of.join(classes, F.col("node") == F.col("class_node"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, classes: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that lead their component (doc_id, component_id) of classes, all columns: one document of
    each group stays, and one row of each id. Rows without an id belong to no group that could be named; they stay."""
    leaders = classes.where("component_id is not null").select(F.col("component_id").alias("_lodeframe_leader")).distinct()
    kept = docs.join(leaders, docs[id_col].cast("long") == F.col("_lodeframe_leader"), "left_semi")
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(*docs.columns))
    one = kept.withColumn("_lodeframe_row", F.row_number().over(first)).where("_lodeframe_row = 1").select(*docs.columns)
    return one.unionAll(docs.where(docs[id_col].isNull()))
