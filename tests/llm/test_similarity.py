"""Near duplicates, repeated passages and neighbours against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from lodeframe.llm import ann, graph, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_fingerprint(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance):
    parent = {k: k for k in fps}
    for a in fps:
        for b in fps:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {k: find(parent, k) for k in fps}


def texts(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ÜBER", "日本"]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 120))) for _ in range(n)]
    out = list(base)
    for t in base[: n // 2]:
        words = t.split()
        words[r.randrange(len(words))] = "edited"
        out += [" ".join(words), t.upper(), t]
    return [*out, None, "", " \t\n", "one", "one two", "\x1c a"]


@pytest.mark.parametrize(("groups", "cell"), [(None, 20_000), (2, 3), (4, 2)])
def test_components_are_those_of_all_pairs(spark, groups, cell):
    rows = list(enumerate(texts(60, 1), 5))
    out = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, rows), groups=groups, cell=cell).collect()}
    fps = {i: brute_fingerprint(t, 3) for i, t in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in out.items()} == fps
    assert {i: r["component_id"] for i, r in out.items()} == brute_components(fps, 3)


def test_thresholds_find_every_pair_within_the_distance():
    r = np.random.default_rng(0)
    fps = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    groups = simhash.correlated_groups(np.zeros((64, 64), dtype=np.int64), 1, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    counts = {(g, s): np.bincount(simhash.pick_bits(fps, b).astype(int), minlength=1 << len(b)) for g, x in enumerate(groups) for s, b in enumerate(simhash.sub_blocks(x))}
    plan = simhash.Allocation(groups, counts, len(fps), 3)
    limits = plan.thresholds(fps)
    assert (limits.sum(axis=1) == 3 - 3 + 1).all() and limits.min() >= -1
    for i, f in enumerate(fps[:100]):
        flips = r.choice(64, 3, replace=False)
        near = f ^ np.uint64(sum(1 << int(b) for b in flips))
        ok = [np.bitwise_count(simhash.pick_bits(np.array([f ^ near]), g)[0]) <= limits[i, k] for k, g in enumerate(groups)]
        assert any(ok)


def test_dense_clusters_give_forests():
    base = np.uint64(0x0123456789ABCDEF)
    nodes = np.unique(np.array([base ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(40) for b in range(40)], dtype=np.uint64))
    u, v = simhash.forest(nodes, 3)
    assert len(u) == len(nodes) - 1 and (np.bitwise_count(u ^ v) <= 3).all()


def test_simhash_edge_tables(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    rows = frame(spark, [(None, "a b c", 1), (3, "a b c", 2), (3, "a b c", 2), (9, None, 3)], "doc_id long, text string, fp int")
    out = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(rows).collect())
    assert out == [(0, 3), (3, 3), (3, 3), (9, 9)]
    kept = simhash.one_of_each(rows, simhash.near_duplicates(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["fp"]) for r in kept) == [(0, 1), (3, 2), (9, 3)]


def test_graph_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    out = {r["node"]: r["root"] for r in graph.components(frame(spark, links, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert graph.components(frame(spark, [], "u long, v long")).count() == 0


def passage_rows(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    shared = [[word() for _ in range(n)] for n in (51, 70, 120)]
    rows = []
    for i in range(40):
        words = [word() for _ in range(r.randint(0, 150))]
        if i % 4 == 1:
            p = list(r.choice(shared))
            if i % 8 == 1 and len(p) > 60:
                p[30] = "changed"
                del p[45]
            at = r.randint(0, len(words))
            words[at:at] = p
        rows.append((i, " ".join(words)))
    return rows


def test_every_repeated_passage_is_found(spark):
    rows = passage_rows()
    found = substring.repeated_passages(frame(spark, rows)).collect()
    texts_ = {i: t.split() for i, t in rows}
    first, repeated = {}, set()
    for i, _ in rows:
        for s in range(len(texts_[i]) - 50):
            if first.setdefault(tuple(texts_[i][s : s + 51]), i) != i:
                repeated.add(i)
    assert repeated <= {r["doc_id"] for r in found}
    for r in found:
        a, b = texts_[r["doc_id"]][r["start"] : r["end"]], texts_[r["other_id"]][r["other_start"] : r["other_end"]]
        assert r["other_id"] < r["doc_id"] and len(a) >= 50 and r["similarity"] >= 0.8
        assert len(set(a) & set(b)) >= 0.7 * len(set(a))
    left = substring.without_passages(frame(spark, rows), substring.repeated_passages(frame(spark, rows))).collect()
    first = {}
    for r in sorted(left, key=lambda r: r["doc_id"]):
        words = r["text"].split()
        assert all(first.setdefault(tuple(words[s : s + 51]), r["doc_id"]) == r["doc_id"] for s in range(len(words) - 50))
    untouched = {i for i, _ in rows} - {r["doc_id"] for r in found}
    assert {(r["doc_id"], r["text"]) for r in left} >= {(i, t) for i, t in rows if i in untouched}


def test_chains_are_best():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 14)
        pairs = sorted({(r.randint(0, 40), r.randint(0, 40)) for _ in range(n)})
        y, x = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        best = [0.0] * len(pairs)
        for j, (b, a) in enumerate(pairs):
            best[j] = substring.K + max([0.0, *(best[i] - substring.GAP_COST * ((b - pairs[i][0]) + (a - pairs[i][1])) for i in range(j) if pairs[i][0] < b and pairs[i][1] < a)])
        chains = substring.best_chains(y, x, gap=1000)
        assert sorted(i for c in chains for i in c) == list(range(len(pairs)))
        score = lambda c: substring.K * len(c) - substring.GAP_COST * ((y[c[-1]] - y[c[0]]) + (x[c[-1]] - x[c[0]]))
        assert max(score(c) for c in chains) == pytest.approx(max(best))
        assert all((np.diff(y[c]) > 0).all() and (np.diff(x[c]) > 0).all() for c in chains)


def test_substring_edge_tables(spark):
    assert substring.repeated_passages(frame(spark, [])).count() == 0
    long = " ".join(f"u{i}" for i in range(4000))
    rows = frame(spark, [(1, long, 1), (2, None, 2), (None, long, 3), (4, "", 4), (5, long, 5), (5, long, 5)], "doc_id long, text string, _spans int")
    found = substring.repeated_passages(rows).collect()
    assert {(r["doc_id"], r["other_id"], r["end"] - r["start"]) for r in found} == {(5, 1, 4000)}
    left = substring.without_passages(rows, substring.repeated_passages(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["_spans"]) for r in left) == [(0, 3), (1, 1), (2, 2), (4, 4)]


@pytest.mark.parametrize(("rows", "queries"), [(8192, 4096), (60, 7)])
def test_neighbours(spark, rows, queries):
    r = np.random.default_rng(1)
    x = np.round(r.standard_normal((400, 24)), 3)
    x[50:60] = x[49]
    data = [(i, [float(v) for v in x[i]]) for i in range(400)]
    data += [(400, None), (420, [0.0] * 24), (440, [float("nan")] * 24), (460, [None] * 24), (480, [1.0, 2.0]), (500, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    out = ann.nearest(df, df.where("vec_id % 20 = 0"), rows=rows, query_rows=queries).collect()
    got = {}
    for row in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    assert sorted(got) == list(range(0, 400, 20))
    hit = 0
    for q, ids in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(400), -score))[:20]) & set(ids))
        assert len(ids) == 20
    assert hit / (20 * len(got)) >= 0.9
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_error_bounds_hold():
    r = np.random.default_rng(2)
    x, q = r.standard_normal((500, 64)), r.standard_normal((40, 64))
    turn = ann.rotation(64)
    estimate, error = ann.bounds(*ann.encode(x, turn), q, turn)
    assert (np.abs(estimate - q @ x.T) <= error).mean() > 0.99


def edited_rows(seed=8):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    rows, groups = [], {}
    for g in range(12):
        base = [word() for _ in range(r.randint(90, 400))]
        for copy in range(5):
            words = list(base)
            if copy:
                for _ in range(max(1, len(words) // 70)):
                    words[r.randrange(len(words))] = word()
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    return rows, groups


@pytest.mark.parametrize("cell", [20_000, 2])
def test_similar_texts_are_linked_and_others_left(spark, cell):
    rows, groups = edited_rows()
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, rows), width=5, similarity=0.8, cell=cell).collect()}
    assert len(set(out.values())) <= 14  # of 12 groups
    assert all(groups[i] == groups[c] for i, c in out.items())


def test_segments_and_wide_fingerprints():
    text = " ".join(f"w{i}" for i in range(600)).encode()
    changed = text.replace(b"w300 ", b"other ")
    a, b = simhash.segments([text, changed])
    assert len(a) > 15 and len(np.setdiff1d(a, b)) <= 2 and len(simhash.segments([b"", b"one"])[0]) == 0
    assert simhash.wide_limit(1.0) == 0 and simhash.wide_limit(0.9) < simhash.wide_limit(0.8) < 60


def test_similarity_edge_tables(spark):
    rows = frame(spark, [(None, None), (1, ""), (2, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f")])
    out = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(rows, width=5, similarity=0.8).collect())
    assert out == [(0, 1), (1, 1), (2, 2), (2, 2), (3, 2)]
    assert simhash.near_duplicates(frame(spark, []), width=5, similarity=0.8).count() == 0


def jaccard(a, b, width=5):
    x, y = ({tuple(t[i : i + width]) for i in range(max(1, len(t) - width + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def pairs_near(r, low, high, lengths, n):
    """n pairs of texts (word lists) of a length of lengths whose similarity lies from low to below high."""
    out = []
    while len(out) < n:
        a = [f"p{r.randrange(10**9)}" for _ in range(r.choice(lengths))]
        b = list(a)
        for _ in range(r.randint(0, max(1, len(a) // 25))):
            b[r.randrange(len(b))] = f"q{r.randrange(10**9)}"
        b += [f"q{r.randrange(10**9)}" for _ in range(r.choice([0, 0, 1, 2]))]
        if low <= jaccard(a, b) < high:
            out.append((a, b))
    return out


@pytest.mark.parametrize("cell", [20_000, 1])
def test_no_pair_below_the_similarity_is_linked(spark, cell):
    pairs = pairs_near(random.Random(5), 0.6, 0.8, [100, 200], 60)
    rows = [(2 * i + k, " ".join(p[k])) for i, p in enumerate(pairs) for k in range(2)]
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, rows), width=5, similarity=0.8, cell=cell).collect()}
    assert out == {i: i for i, _ in rows}


def test_near_pairs_are_linked_at_every_length(spark):
    r = random.Random(6)
    lengths = [[12], [20], [30], [50], [400]]
    pairs = [p for n in lengths for p in pairs_near(r, 0.8, 0.9, n, 40)]
    rows = [(2 * i + k, " ".join(p[k])) for i, p in enumerate(pairs) for k in range(2)]
    out = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(frame(spark, rows), width=5, similarity=0.8).collect()}
    linked = [out[2 * i] == out[2 * i + 1] for i in range(len(pairs))]
    assert [sum(linked[40 * i : 40 * i + 40]) for i in range(len(lengths))] == [40] * len(lengths)


def test_a_far_passage_does_not_hide_a_near_predecessor():
    first, second = np.arange(0, 200, 4), np.arange(300, 380, 4)
    y, x = np.append(np.concatenate([first, second]), 390), np.append(np.concatenate([first, second]), 7)  # the last is a stray match
    chains = substring.best_chains(y, x)
    assert sorted(map(len, chains)) == [1, 20, 50]


def test_edits_are_the_edit_distance():
    a = np.arange(20)
    b = np.append(np.delete(a, 3)[:12], [99, *np.delete(a, 3)[12:]])
    assert len(a) == len(b) and substring.edits(a, b) == 2
    r = random.Random(4)
    for _ in range(300):
        x, y = ([r.randrange(3) for _ in range(r.randint(0, 9))] for _ in range(2))
        row = list(range(len(y) + 1))
        for i, w in enumerate(x, 1):
            row, old = [i], row
            for j, v in enumerate(y, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (v != w)))
        assert substring.edits(np.array(x), np.array(y)) == row[-1]


def own_words(r, n, mark):
    return [f"{mark}{r.randrange(10**9)}" for _ in range(n)]


def test_torn_passages_are_found_however_the_rows_are_dealt(spark):
    r = random.Random(12)
    passage = own_words(r, 60, "p")
    lines = [own_words(r, 15, "l") for _ in range(6)]
    rows = [
        (0, own_words(r, 30, "a") + passage), (1, passage[:30] + own_words(r, 40, "b")), (2, own_words(r, 40, "c") + passage[30:]),
        (3, own_words(r, 20, "d") + passage + own_words(r, 20, "d")), (4, own_words(r, 40, "e") + passage[15:45]),
        *((10 + i, own_words(r, 45, "f") + line) for i, line in enumerate(lines)),  # each line is met on its own first
        (20, own_words(r, 10, "g") + sum(lines, []) + own_words(r, 10, "g")), (21, own_words(r, 33, "h") + sum(lines, [])),
    ]
    df = frame(spark, [(i, " ".join(w)) for i, w in rows])
    seen = []
    for n, batch in ((1, 10_000), (4, 20), (16, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        seen.append(sorted(map(tuple, substring.repeated_passages(df.repartition(n)).collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0] == seen[1] == seen[2]
    assert {(d, o, e - s) for d, s, e, o, *_ in seen[0]} == {(3, 0, 60), (21, 20, 90)}


def test_hot_seeds_change_nothing(spark, monkeypatch):
    r = random.Random(13)
    common = own_words(r, 70, "c")
    rows = [(i, " ".join(own_words(r, 20, "o") + common[: r.choice([12, 30, 55, 70])] + own_words(r, 40, "o"))) for i in range(60)]
    plain = sorted(map(tuple, substring.repeated_passages(frame(spark, rows)).collect()))
    monkeypatch.setattr(substring, "SAMPLE", 1)
    monkeypatch.setattr(substring, "HOT_LEAST", 5)
    assert sorted(map(tuple, substring.repeated_passages(frame(spark, rows)).collect())) == plain and plain


def test_edited_passages_are_found(spark):
    """Passages of 60 words with scattered edits: the shares found are what the README states."""
    r = random.Random(14)
    shares = []
    for edits in (0, 3, 5, 8):
        rows = []
        for i in range(60):
            p = own_words(r, 60, "p")
            q = list(p)
            for _ in range(edits):
                at = r.randrange(len(q))
                kind = r.randrange(3)
                q[at : at + (kind != 1)] = [] if kind == 2 else own_words(r, 1, "n")
            rows += [(2 * i, " ".join(own_words(r, 30, "a") + p)), (2 * i + 1, " ".join(q + own_words(r, 30, "b")))]
        found = {x["doc_id"] for x in substring.repeated_passages(frame(spark, rows)).collect()}
        shares.append(len(found) / 60)
    print("found", shares)
    assert shares[0] == 1 and shares[1] >= 0.9 and shares[2] >= 0.7 and shares[3] >= 0.4
