"""The pipeline's near-duplicates come through SimHash fingerprints."""

import random

import numpy as np
import pytest

from lodeframe.llm import simhash


def shingles(words):
    return simhash._sets(*simhash._shingle_hashes([" ".join(w).encode() for w in words], 5))


def test_lanes_are_fingerprints():
    r = random.Random(3)
    words = [[f"w{r.randrange(10**6)}" for _ in range(n)] for n in (0, 1, 5, 259, 260, 264, 3000)]
    hashes, counts = shingles(words)
    wide = simhash.lanes(hashes, counts)
    assert np.array_equal(wide[:, 0], simhash._majority(hashes, counts)) and not wide[0].any()
    for lane in (1, simhash.LANES - 1):
        h = (hashes ^ simhash._MASKS[lane]) * simhash._FACTORS[lane]
        assert np.array_equal(wide[:, lane], simhash._majority(h ^ (h >> np.uint64(32)), counts))
    between = np.bitwise_count(wide[3:, :, None] ^ wide[3:, None, :])[:, ~np.eye(simhash.LANES, dtype=bool)]
    assert 31 < between.mean() < 33  # lanes know nothing of each other


def test_pairs_of_the_similarity_meet_and_are_near():
    """2,000 pairs of sets of Jaccard similarity 0.8: all but a few in 10,000 are candidates."""
    r = np.random.default_rng(4)
    sizes = r.choice([36, 180, 900], 2000)
    sets = [x for n in sizes for base in [r.integers(0, 1 << 64, n * 10 // 9, dtype=np.uint64)] for x in (base[:n], base[len(base) - n :])]
    wide = simhash.lanes(np.concatenate(sets), np.array([len(x) for x in sets]))
    one, two = wide[::2], wide[1::2]
    meet = (one[:, 1:].copy().view(np.uint16) == two[:, 1:].copy().view(np.uint16)).any(axis=1)
    near = np.bitwise_count(one[:, :2] ^ two[:, :2]).sum(axis=1) <= simhash.lane_limit(0.8)
    assert (meet & near).sum() >= 1997


@pytest.mark.parametrize("few", [3, 40])
def test_near_in_groups_links_what_all_pairs_do(few):
    r = np.random.default_rng(few)
    group = np.sort(r.integers(0, 200 // few, 200))
    a, b = (r.integers(0, 1 << 64, 200, dtype=np.uint64) & np.uint64(0xFF) for _ in range(2))
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def classes(pairs):
        parent[:] = range(200)
        for i, j in pairs:
            assert group[i] == group[j] and int(a[i] ^ a[j]).bit_count() + int(b[i] ^ b[j]).bit_count() <= 4
            parent[find(i)] = find(j)
        found = [find(i) for i in range(200)]
        return [[found[i] == found[j] for i in range(200)] for j in range(200)]

    told = classes([p for i, j in simhash.near_in_groups(group, a, b, 4) for p in zip(i.tolist(), j.tolist(), strict=True)])
    every = classes([(i, j) for i in range(200) for j in range(i) if group[i] == group[j] and int(a[i] ^ a[j]).bit_count() + int(b[i] ^ b[j]).bit_count() <= 4])
    assert told == every


def test_the_pigeonhole_links_without_the_other_lanes(spark, monkeypatch):
    text = " ".join(f"w{i * i % 1009}" for i in range(900))
    rows = spark.createDataFrame([(1, text), (2, text + " more"), (3, text.replace("w", "v"))], "doc_id long, text string")
    monkeypatch.setattr(simhash, "lane_links", lambda distinct, rows, similarity, *, cell: distinct.limit(0).selectExpr("a u", "b v"))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows, width=5, similarity=0.8).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    monkeypatch.setattr(simhash, "near_links", lambda fps, *_, **__: fps.limit(0).selectExpr("fp u", "fp v"))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows, width=5, similarity=0.8).collect()}
    assert found == {1: 1, 2: 2, 3: 3}
