"""Sharding, chat, scoring, mixing, packing, media and the classifier against brute force and round trips."""

import json
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import chat, lm_scoring, media, mixing, packing, quality, sharding, webp
from lodeframe.llm.common import with_prefix

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, source string, lang string"


def docs(spark, n=90, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(r.choice(["alpha", "beta", "gamma", "delta,", "Épsilon", "zeta.", "日本"]) for _ in range(r.randint(0, 60)))
        rows.append((i, text, r.choice(["a", "a", "a", "b", "c", "é", None]), r.choice(["en", "fr", None])))
    rows += [(1000, None, "a", None), (1001, "", None, "en"), (1002, " \n ", "b", "en"), (1003, "x" * 5000, "c", "en"), (1004, rows[3][1], "a", "en")]
    return rows, spark.createDataFrame(rows, DOCS)


def test_prefix_sums(spark):
    rows = [(random.Random(i).choice("ab"), random.Random(i).getrandbits(63) * (-1) ** i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, h long, v long")
    out = with_prefix(df, ["k"], ["h"], "v", 300, per_bucket=7).collect()
    past = defaultdict(int)
    expected = {}
    for k, h, v in sorted(rows):
        expected[h] = past[k]
        past[k] += v
    assert {r["h"]: r["before"] for r in out} == expected


def test_hilbert_curve_is_one_step_a_time(spark):
    grid = [(x, y, z) for x in range(8) for y in range(8) for z in range(8)]
    df = spark.createDataFrame(grid, "x int, y int, z int").withColumn("h", sharding.hilbert_index([F.col(c) for c in "xyz"], 3))
    at = {r["h"]: np.array((r["x"], r["y"], r["z"])) for r in df.collect()}
    assert sorted(at) == list(range(512))
    assert all(np.abs(at[i + 1] - at[i]).sum() == 1 for i in range(511))


def test_shards(spark, tmp_path):
    rows, df = docs(spark)
    out = sharding.hilbert_shards(df.withColumn("curve", F.lit("x")), rows_per_part=20).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["grown_shard"] is None for r in out)
    few = sharding.hilbert_shards(df.limit(3)).collect()
    assert sorted(r["shard"] for r in few) == [0, 1, 2]
    assert sharding.hilbert_shards(df.limit(0)).count() == 0
    sharding.write_shards(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)
    line = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    along = [(r["curve"], r["text_crc32"], r["size"], r["doc_id"]) for r in line]
    assert along == sorted(along)


def test_written_shards_prune_and_keep_repeated_ids(spark, tmp_path):
    r = random.Random(4)
    sizes = r.sample(range(2000), 2000)
    df = spark.createDataFrame([(i, "x" * n, n) for i, n in enumerate(sizes)], "doc_id long, text string, shard long")
    sharding.write_shards(df, str(tmp_path / "s"), rows_per_part=300)
    spread = spark.read.parquet(str(tmp_path / "s")).groupBy("shard").agg(F.count("*").alias("n"), *[(F.max(x) - F.min(x)).alias(k) for k, x in (("ids", F.col("doc_id")), ("sizes", F.length("text")))]).collect()
    # an eighth of the points; a box may reach a little over the edge of a neighbour's
    boxes = [s["ids"] * s["sizes"] / 2000**2 for s in spread]
    assert len(spread) == 8 and all(s["n"] == 250 for s in spread) and max(boxes) < 0.5 and sum(boxes) < 2, boxes
    same = spark.createDataFrame([(7 if i % 2 else None, "t") for i in range(80)], "doc_id long, text string")
    sharding.write_shards(same, str(tmp_path / "t"))
    assert [x["count"] for x in spark.read.parquet(str(tmp_path / "t")).groupBy("shard").count().collect()] == [10] * 8


def test_tool_calls(spark):
    schemas = {"get": {"required": ["city"], "properties": {"city": {"type": "string", "enum": ["A", "B"], "maxLength": 1}, "n": {"type": "integer", "minimum": 1}}}}
    calls = spark.createDataFrame(
        [
            (1, "a", "get", '{"n": 3, "city" : "A"}', None, 0), (1, "b", "get", '{"n":0.5,"city":"CC"}', "a", 1), (1, "c", "get", "{bad", "d", 2), (1, "d", "get", "[1]", "c", 3),
            (1, "e", "zip", "{}", "b", 0), (1, "a", "get", "{}", None, 9), (None, None, None, None, None, None), (2, "a", "get", '{"city":"B"}', "gone", 5),
        ],
        "conv_id long, call_id string, name string, arguments string, parent_id string, turn long",
    )
    results = spark.createDataFrame([(1, "a", "ok", 1), (1, "a", "again", 2), (1, "x", "?", 2), (1, None, "n", None)], "conv_id long, call_id string, content string, turn long")
    out = chat.link_tool_calls(calls, results, schemas).collect()
    by = {(r["conv_id"], r["call_id"], json.loads(r["json"])["result"]): r for r in out}
    assert len(out) == 10
    assert by[1, "a", "ok"]["json"] == '{"arguments":{"city":"A","n":3},"call_id":"a","name":"get","result":"ok"}'
    assert [by[k]["status"] for k in ((1, "a", "again"), (1, "b", None), (1, "x", "?"))] == ["linked", "no_result", "no_call"]
    assert by[1, "b", None]["errors"] == ["city: not in enum", "city: maxLength 1", "n: not of type integer", "n: minimum 1"]
    assert by[1, "c", None]["errors"] == ["arguments: not JSON", "parent: cycle"] and by[1, "c", None]["level"] is None
    assert json.loads(by[1, "c", None]["json"])["arguments"] == "{bad" and json.loads(by[1, "x", "?"]["json"])["arguments"] is None
    assert by[1, "e", None]["level"] == 2 and by[1, "e", None]["errors"] == ["name: unknown tool"]
    assert by[2, "a", None]["valid"] and by[2, "a", None]["level"] == 0
    first = sorted((r["position"], r["call_id"]) for r in out if r["conv_id"] == 1)
    assert [p for p, _ in first] == list(range(8)) and [c for _, c in first[:4]] == ["a", "a", "b", "e"]
    assert chat.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_long_chains_and_plain_conversations(spark):
    chain = spark.createDataFrame([(1, str(i), [str(i - 1) if i else None]) for i in range(70)], "conv_id long, call_id string, parents array<string>")
    assert {r["call_id"]: r["level"] for r in chat.levels(chain).collect()} == {str(i): i for i in range(70)}
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", ""), (2, 0, "system", "be"), (2, 1, "robot", "x"), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    out = chat.link_tool_calls(*chat.chat_calls(talk), chat.CHAT_SCHEMAS).collect()
    assert sorted((r["call_id"] or "", r["status"], r["valid"]) for r in out) == [("", "no_result", False), ("1:0", "linked", True), ("1:2", "no_result", False), ("2:0", "no_result", True), ("2:1", "no_result", False)]


def longest_ways(parents):
    """Brute force: {id: level} of {id: parents}, None on or behind a cycle."""
    out = {}
    for _ in parents:
        for i, up in parents.items():
            known = [p for p in set(up or ()) if p in parents]
            if i not in out and all(p in out for p in known):
                out[i] = max((out[p] + 1 for p in known), default=0)
    return {i: out.get(i) for i in parents}


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_of_calls_with_several_parents(spark, seed):
    rng = random.Random(seed)
    talks = {}
    for c in range(12):  # sparse graphs: chains, joints, and in some a cycle
        size = 14
        talks[c if c else None] = {str(i): [str(rng.randrange(size if c % 4 == 3 else max(i, 1))) for _ in range(rng.choice((0, 1, 1, 1, 2, 3)))] for i in range(size)}
    talks[99] = {"a": None, "b": ["a", "a", None, "gone"], "c": ["b", "a"], "d": ["d", "a"], "e": ["d", "c"], "f": ["c"], "g": ["f", "b"]}
    rows = [(c, i, up) for c, calls in talks.items() for i, up in calls.items()]
    found = chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, parents array<string>")).collect()
    expected = {(c, i): level for c, calls in talks.items() for i, level in longest_ways(calls).items()}
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in found} == expected and len(found) == len(expected)


def test_calls_come_after_every_call_they_follow(spark):
    calls = spark.createDataFrame([(1, "z", "t", "{}", [], 0), (1, "a", "t", "{}", ["m", "z"], 1), (1, "m", "t", "{}", ["z"], 2)], "conv_id long, call_id string, name string, arguments string, parent_ids array<string>, turn long")
    results = spark.createDataFrame([(1, "a", "ok", 3)], "conv_id long, call_id string, content string, turn long")
    out = chat.link_tool_calls(calls, results, {"t": {}}).orderBy("position").collect()
    assert [(r["call_id"], r["level"], r["status"], r["valid"]) for r in out] == [("z", 0, "no_result", True), ("m", 1, "no_result", True), ("a", 2, "linked", True)]


@pytest.mark.parametrize(("hot", "block_words"), [(1000, 800_000), (4, 40), (1, 800_000)])
def test_stupid_backoff(spark, hot, block_words):
    rows = [(i, t) for i, t, *_ in docs(spark)[0]] + [(None, "a b a b"), (2000, "a b a b"), (2001, "zz"), (2001, "zz")]
    r = random.Random(11)
    rows += [(3000 + i, " ".join(f"rare{r.randrange(60)}" for _ in range(r.randint(1, 40)))) for i in range(40)] + [(3500, "long " * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"to": F.lit("x"), "block": F.lit(1)})
    out = lm_scoring.stupid_backoff(frame, bucket_words=200, block_words=block_words, hot=hot).collect()
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    one, two, before = Counter(), Counter(), Counter()
    for _, w in words:
        one.update(w)
        two.update(zip([None, *w], w, strict=False))
        before.update([None, *w][: len(w)])
    expected = []
    for i, w in words:
        own = Counter(zip([None, *w], w, strict=False))
        score = sum(k * (math.log((two[p] - k) / before[p[0]]) if two[p] > k else math.log(0.4 * one[p[1]] / one.total())) for p, k in own.items())
        expected.append((-1 if i is None else i, len(w), score))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["log_score"]) for r in out)
    assert [g[:2] for g in got] == [e[:2] for e in sorted(expected)]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in sorted(expected)], rel=1e-9, abs=1e-9)
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in out)
    assert lm_scoring.stupid_backoff(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mixing(spark):
    rows, df = docs(spark)
    out = mixing.curriculum(df, per_bucket=9).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    total, by = sum(size.values()), defaultdict(int)
    for i, _, s, _ in rows:
        by[s] += size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate([*sorted((s for s in by if s is not None), key=lambda s: s.encode()), *([None] if None in by else [])])}
    target, open_ = {}, set(by)
    while True:  # share, cap, share again
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * by[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * by[s]
        open_ -= over
    taken = defaultdict(int)
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in by)
    assert sorted(map(tuple, mixing.curriculum(df, per_bucket=9).select("doc_id", "taken").collect())) == sorted((r["doc_id"], r["taken"]) for r in out)
    order = mixing.training_order(df, mixing.curriculum(df)).collect()
    assert len(order) == sum(len(r["positions"]) for r in out) and mixing.curriculum(df.limit(0)).count() == 0


def test_positions_invert_the_schedule(spark):
    df = spark.createDataFrame([(t / 2, k / 20) for t in (-1, 0, 1) for k in range(21)], "tilt double, t double")
    share = F.col("t") + F.col("tilt") * F.col("t") * (1 - F.col("t"))
    assert all(r[0] == pytest.approx(r[1], abs=1e-9) for r in df.select(mixing.position(share, F.col("tilt")), "t").collect())


def test_best_fit_plan():
    r = random.Random(4)
    for _ in range(10):
        capacity = r.choice([10, 64, 2048])
        histogram = {r.randint(1, capacity): r.randint(1, 30) for _ in range(40)}
        plan = packing.best_fit_plan(histogram, capacity)
        open_ = []
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                fits = [(room, i) for i, room in enumerate(open_) if room >= length]
                if fits:
                    open_[min(fits)[1]] -= length
                else:
                    open_.append(capacity - length)
        assert plan.bins == len(open_)
        length = np.concatenate([np.full(n, k) for k, n in histogram.items()])
        rank = np.concatenate([np.arange(n) for n in histogram.values()])
        where, offset = plan.place(length, rank)
        for b in np.unique(where):
            at = np.argsort(offset[where == b])
            ends = np.cumsum(length[where == b][at])
            assert (offset[where == b][at] == ends - length[where == b][at]).all() and ends[-1] <= capacity


def vocabulary():
    try:
        from lodeframe.llm.registry import tokenizer_path

        return tokenizer_path()
    except ImportError:
        return ""


@pytest.mark.skipif(not os.path.exists(vocabulary()), reason="no vocabulary files")
def test_packing_and_tokens(spark):
    from lodeframe.llm.bpe import word_bpe

    bpe, r = word_bpe(vocabulary()), random.Random(1)
    parts = ["a", "B", "é", "É", "ß", "×", "Ÿ", "  ", "\n", "\x0b", "\x1c", "\xa0", "́", "'s", "12", "!!", ".", "<|startoftext|>", "<|", "日本", "İ", "Σ", "the", "tion", "x" * 300, "½", "ª"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    expected = [e.ids for e in bpe.library.encode_batch(texts, add_special_tokens=False)]
    assert [list(map(int, x)) for x in bpe.encode([t.encode() for t in texts])] == expected
    rows, df = docs(spark)
    out = packing.pack(df, vocabulary(), capacity=64, per_bucket=11).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for p in out:
        pieces[p["doc_id"]].append(p)
        bins[p["sequence_id"]].append(p)
    for i, t, *_ in rows:
        ids = [*bpe.library.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda p: p["piece"])
        assert [(p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in own] == [(k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4"))) for k, s in enumerate(range(0, len(ids), 64))]
    for b in bins.values():
        at = 0
        for p in sorted(b, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64
    assert packing.pack(df.limit(0), vocabulary()).count() == 0


def images():
    r = np.random.default_rng(0)
    for shape in ((1, 1), (5, 7), (20, 33)):
        yield r.integers(0, 256, (*shape, 4), dtype=np.uint8)
        yield (r.integers(0, 3, (*shape, 4)) * 60).astype(np.uint8)
        yield np.tile(r.integers(0, 256, (1, 1, 4), dtype=np.uint8), (*shape, 1))


@pytest.mark.parametrize("options", [{}, {"cache_bits": 5}, {"subtract_green": True}, {"cross": (3, -50, 100)}, {"cross": (-128, 127, 7), "subtract_green": True, "cache_bits": 11}, {"palette": True}, {"palette": True, "predictor": 5, "cache_bits": 2}, *({"predictor": m} for m in range(14))])
def test_webp_round_trips(options):
    for image in images():
        if options.get("palette") and len(np.unique(image.reshape(-1, 4), axis=0)) > 256:
            continue
        assert np.array_equal(webp.decode(webp.encode(image, **options)), image)


def test_webp_grey_and_broken():
    r = np.random.default_rng(3)
    for k in (1, 2, 3, 16, 17, 100, 256):
        grey = r.choice(np.sort(r.choice(256, k, replace=False)), (9, 64)).astype(np.uint8)
        data = webp.encode_grey(grey)
        image = webp.decode(data)
        assert all(np.array_equal(image[..., c], grey) for c in (1, 2, 3)) and (image[..., 0] == 255).all()
        for cut_at in (5, 20, len(data) // 2, len(data) - 3):
            try:
                webp.decode(data[:cut_at])
            except (ValueError, IndexError):
                pass
    with pytest.raises(ValueError):
        webp.decode(b"RIFFxxxxWEBP")


def test_media(spark):
    rows, df = docs(spark)
    long = "é long text " * 120_000
    df = df.unionAll(spark.createDataFrame([(5000, long, "a", "en")], DOCS))
    out = {r["doc_id"]: r for r in media.media_column(df, keep_media=True).collect()}
    import hashlib

    for i, t, *_ in [*rows, (5000, long, "", "")]:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] == len(r["media"]) and media.from_media(bytes(r["media"])).tobytes() == payload
    assert out[3]["feature"] == out[1004]["feature"] and out[3]["media_sha256"] == out[1004]["media_sha256"]
    assert media.media_column(df.limit(0)).count() == 0


def test_kneser_ney_sums_to_one(spark):
    r = random.Random(7)
    texts = [" ".join(r.choice(["the", "of", "sand", "tide", "lode"]) for _ in range(40)) for _ in range(30)]
    trusted = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    classes = quality.byte_classes(trusted)
    assert sorted(classes[classes > 0]) == list(range(1, int((classes > 0).sum()) + 1))
    costs = quality.model(trusted, classes, 2)
    share = (2.0 ** (-costs.astype(float).reshape(quality.CLASSES, -1) / quality.STEPS)).sum(axis=1)
    assert (np.abs(share[np.unique(classes)[1:6]] - 1) < 0.3).all()
    counted = quality.gram_counts(trusted, classes, 2).collect()
    raw = [classes[np.frombuffer(b"\n" + t.encode(), np.uint8)] for t in texts]
    expected = Counter((int(a) << 6) | int(b) for x in raw for a, b in zip(x[:-1], x[1:], strict=True))
    assert {g["gram"]: g["c"] for g in counted} == expected


def direct_kneser_ney(texts, order):
    """P(symbol | context) of interpolated modified Kneser-Ney over tuples of classes, by the textbook."""
    counts = {order: Counter(x[i : i + order] for x in texts for i in range(len(x) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cost, total, left = {}, {}, {}
    for k in counts:
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        cost[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i) if n[i] else 0 for i in (1, 2, 3)]
        total[k], left[k] = Counter(), Counter()
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            left[k][g[:-1]] += cost[k][min(c, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / quality.CLASSES
        if not total[k][g[:-1]]:
            return p(g[1:])
        c = counts[k][g]
        return (c - cost[k][min(c, 3)] + left[k][g[:-1]] * p(g[1:])) / total[k][g[:-1]]

    return p


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney_against_a_direct_model(spark, order):
    r = random.Random(11)
    texts = [" ".join(r.choice(["the", "of", "sand", "tide", "lode", "été"]) for _ in range(r.randint(1, 30))) for _ in range(40)]
    trusted = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    classes = quality.byte_classes(trusted)
    costs = quality.model(trusted, classes, order).astype(float)
    raw = [tuple(int(c) for c in classes[np.frombuffer(b"\n" * (order - 1) + t.encode(), np.uint8)]) for t in texts]
    p = direct_kneser_ney(raw, order)
    symbols = range(int(classes.max()) + 2)
    asked = {x[i : i + order] for x in raw for i in range(len(x) - order + 1)} | {tuple(r.choice(symbols) for _ in range(order)) for _ in range(500)}
    for g in asked:
        at = sum(c << quality.BITS * (order - 1 - i) for i, c in enumerate(g))
        assert abs(costs[at] + quality.STEPS * np.log2(max(p(g), 1e-9))) < 0.51, g  # costs are whole steps, 1e-9 the least probability


def test_classifier(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["the", "an", "er", "on", "ti", "sh"]) for _ in range(r.randint(1, 3)))
    good = [" ".join(word() for _ in range(r.randint(20, 80))) for _ in range(240)]
    bad = [" ".join(word().upper() + "!!" for _ in range(40)) for _ in range(40)]
    rows = [(i, t, "a", "en") for i, t in enumerate(good + bad)] + [(900, None, "a", "en"), (901, "", "a", "en"), (902, good[0], "a", None), (903, good[0] * 200, "a", "xx"), (904, good[0], "b", "en"), (904, good[0], "b", "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(160)] + [(250, 0, 0), (3, 0, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, DOCS)
    out = {x["doc_id"]: x for x in quality.classify(df, labels).collect()}
    assert sum(out[i]["keep"] for i in range(240)) >= 236 and not any(out[i]["keep"] for i in range(240, 280))
    assert [out[i]["keep"] for i in (900, 901, 902, 903)] == [False, False, True, True] and out[900]["perplexity"] is None
    kept = quality.keep_good(df.withColumn("bits", F.lit(1)), labels)
    assert kept.columns == [*df.columns, "bits"] and sorted(x["doc_id"] for x in kept.collect()) == sorted(x["doc_id"] for x in quality.classify(df, labels).where("keep").collect())
    assert quality.classify(df.limit(0), labels).count() == 0
    assert quality.classify(df.where("doc_id < 5"), labels.limit(0)).where("keep").count() == 5


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_every_trusted_row_is_counted(spark, monkeypatch, bits):
    monkeypatch.setattr(quality, "MAP_BITS", bits)
    n = 20_400
    df = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("stone "), (F.col("id") % 7).cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    trusted = quality.trusted_rows(df, labels).cache()
    assert trusted.count() == n and trusted.where("held").count() == pytest.approx(n / 2, rel=0.05)
    classes = quality.byte_classes(trusted)
    assert quality.gram_counts(trusted, classes, 1).agg(F.sum("c")).first()[0] == 7 * n


@pytest.mark.parametrize("odd", [0, 1])
def test_thresholds_are_of_both_halves(spark, odd):
    """Words that trusted rows of one half alone have raise the threshold, whichever half it is."""
    r = random.Random(21)
    rows = [(i, " ".join(r.choice(["the", "an", "er", "on", "sh"]) for _ in range(40)), "en") for i in range(160)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = frame.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    half = [x["doc_id"] for x in frame.where(F.pmod(quality.spread(F.col("doc_id")), F.lit(2)) == odd).collect()][:8]
    strange = spark.createDataFrame([(i, "ZQ9 XK7 " * 20 if i in half else t, g) for i, t, g in rows], frame.schema)
    plain, raised = (quality.classify(x, labels).first()["threshold"] for x in (frame, strange))
    assert raised > 1.2 * plain


def test_thresholds_are_exact_quantiles(spark):
    r = np.random.default_rng(8)
    scores = {"en": r.normal(3, 1e-4, 2000).round(5), "fr": r.normal(4, 0.5, 41), "xx": r.normal(2, 1, 39), "de": np.full(60, 2.5)}
    held = spark.createDataFrame([(g, float(x)) for g, v in scores.items() for x in v] + [(None, 1.0), ("en", None)], "lang string, bits double").repartition(3)
    every = np.append(np.concatenate(list(scores.values())), 1.0)
    for q in (0.0, 0.5, 0.995, 1.0):
        found = {x["lang"]: x["limit"] for x in quality.thresholds(held, q, 1.5).collect()}
        assert found == pytest.approx({**{g: 1.5 * np.quantile(v, q) for g, v in scores.items() if len(v) >= 40}, None: 1.5 * np.quantile(every, q)})


def test_grey_images_take_every_coding():
    """Texts, runs, ramps and noise through Huffman codes, back-references, predictors and palettes, both decoders alike."""
    r = np.random.default_rng(5)
    words = " ".join("word%d" % (i * i % 37) for i in range(3000)).encode()
    ramp = (np.arange(64)[None, :] + 3 * np.arange(40)[:, None]).astype(np.uint8)
    noise = r.integers(0, 256, (50, 64), dtype=np.uint8)
    smooth = (np.cumsum(r.integers(-2, 3, (40, 64)), axis=1) + 128).astype(np.uint8)
    down = (np.cumsum(r.integers(-2, 3, (40, 64)), axis=0) + r.integers(0, 256, 64)).astype(np.uint8)
    runs = np.repeat(r.integers(0, 256, 40, dtype=np.uint8), 64).reshape(40, 64)
    text = np.frombuffer(words[: len(words) // 64 * 64], np.uint8).reshape(-1, 64)
    for samples in (text, ramp, noise, smooth, down, runs, np.zeros((1, 64), np.uint8), np.full((300, 64), 7, np.uint8), (noise & 1) + 65, np.vstack([text, noise, text])):
        data = webp.encode_grey(samples)
        image = webp.decode(data)
        assert np.array_equal(image[..., 2], samples) and np.array_equal(image[..., 1], samples)
    assert len(webp.encode_grey(text)) < 0.2 * text.size and len(webp.encode_grey(ramp)) < 400
    assert {len(webp.encode_grey(x)) < x.size for x in (smooth, down, runs)} == {True}


def test_stretches_give_the_same_pixels(monkeypatch):
    text = np.frombuffer((" ".join(str(i * 7919 % 10007) for i in range(4000))).encode()[: 64 * 250], np.uint8).reshape(-1, 64)
    data = webp.encode_grey(text)
    for stretch in (16, 57, 1000):
        monkeypatch.setattr(webp, "STRETCH", stretch)
        assert np.array_equal(webp.decode(data)[..., 2], text)
    slow = monkeypatch.setattr(webp, "_grey_pixels", lambda bits, codes, width, total: webp._coded_pixels(bits, [codes], None, 0, 0, width, total // width))
    assert slow is None and np.array_equal(webp.decode(data)[..., 2], text)


def test_a_stream_written_by_hand():
    """A file put together from the format's description, bit by bit, not by the encoder: normal codes, a cache, a
    reference to the pixel above, and the subtract-green transform."""
    bits = []
    put = lambda value, n: bits.extend(value >> i & 1 for i in range(n))
    for value, n in ((0x2F, 8), (3, 14), (1, 14), (1, 1), (0, 3), (1, 1), (2, 2), (0, 1)):  # 4 x 2 pixels, subtract-green
        put(value, n)
    put(1, 1), put(1, 4), put(0, 1)  # a cache of two colours, one group
    # green: symbols 10 and 257 (length 2), 280 and 281 (cache): lengths 1, 2, 3, 3 by a normal code
    put(0, 1), put(15 - 4 + 0, 4)
    order = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    lengths = {18: 1, 1: 2, 2: 3, 3: 3}
    for s in order[:15]:
        put(lengths.get(s, 0), 3)
    put(0, 1)
    code = {18: "0", 1: "10", 2: "110", 3: "111"}
    say = lambda s: bits.extend(int(c) for c in code[s])

    def zeros(n):
        while n:
            k = min(n, 138)
            assert k >= 11
            say(18), put(k - 11, 7)
            n -= k

    # 282 lengths: 10 zeros would need code 17, so symbol 11 is used: 11 zeros, 1 for symbol 11, 245 zeros, ...
    zeros(11), say(1), zeros(245), say(2), zeros(22), say(3), say(3)
    for value in (5, 6, 255):  # red, blue, alpha: simple codes of one symbol
        put(1, 1), put(0, 1), put(1, 1), put(value, 8)
    put(1, 1), put(0, 1), put(0, 1), put(0, 1)  # distances: symbol 0 alone, the pixel above
    pixel = "0"  # green 11
    slot = (0x1E35A7BD * (255 << 24 | 5 << 16 | 11 << 8 | 6) & 0xFFFFFFFF) >> 31
    for c in pixel + ("110", "111")[slot] * 2 + pixel:
        bits.append(int(c))
    bits += [1, 0] + [1, 0]  # twice two pixels from above
    data = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    image = webp.decode_stream(data)
    assert image.shape == (2, 4, 4) and (image == np.array([255, 16, 11, 17], np.uint8)).all()
