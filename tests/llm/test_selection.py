"""Best-fit packing by configurations, resampling towards a target, and the prefix trie of conversations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgrain.llm import config_packing, packing, prefix_trie, queries, resample

# ---- best-fit packing ----------------------------------------------------------------------------

SHAPES = {
    "uniform": lambda rng: Counter(rng.integers(1, 2048, 20000).tolist()),
    "halves": lambda rng: Counter(rng.integers(500, 1100, 20000).tolist()),
    "short": lambda rng: Counter(rng.integers(1, 40, 3000).tolist()),
    "one length": lambda rng: Counter({700: 100001}),
    "rare": lambda rng: Counter({5: 1, 2047: 3, 1024: 2, 1: 1}),
    "none": lambda rng: Counter(),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_configurations_hold_each_head_once(shape):
    histogram = SHAPES[shape](np.random.default_rng(3))
    chosen, bound = config_packing.solve(histogram, 2048)
    held = Counter()
    for config, times in chosen.items():
        assert sum(n * a for n, a in config) <= 2048 and times > 0
        for n, a in config:
            held[n] += a * times
    assert held == histogram
    plain = sum(config_packing.fullest_first(histogram, 2048).values())
    assert math.ceil(bound - 1e-6) <= sum(chosen.values()) <= plain + max(1, plain // 500)
    if shape == "halves":  # where longest first into the fullest is far from the best
        assert sum(chosen.values()) < 0.98 * plain


@pytest.mark.parametrize("seed", range(5))
def test_knapsack_is_the_best_multiset(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 12, 4))
    prices = rng.random(len(lengths))

    def best(room):
        return max([0.0, *(p + best(room - n) for n, p in zip(lengths, prices) if n <= room)])

    assert np.allclose(config_packing.knapsack(lengths, prices, 16), [best(r) for r in range(17)])


def test_places_are_ranks_in_order():
    chosen = Counter({((5, 1), (3, 2)): 3, ((3, 1),): 2})
    plan = config_packing.places(chosen)
    assert plan.sequences == 5 and [plan.of(5, r) for r in range(3)] == [(0, 0), (1, 0), (2, 0)]
    assert sorted(plan.of(3, r) for r in range(8)) == [(0, 5), (0, 8), (1, 5), (1, 8), (2, 5), (2, 8), (3, 0), (4, 0)]


def check_packed(rows, texts, size, end):
    """All ids once, in order of pieces; only longer documents cut; sequences without gaps."""
    encode = packing.encoder(packing.default_tokenizer())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = [*encode(text or ""), end]
        own = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // size)))
        assert [r.length for r in own[1:]] == [size] * (len(own) - 1)
        at = 0
        for r in own:
            part = np.array(ids[at : at + r.length], "<u4")
            assert (r.start, r.length) == (at, len(part))
            assert zlib.crc32(part.tobytes()) == (r.ids_crc32 if "ids_crc32" in r else zlib.crc32(np.array(r.ids, "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_best_fit_round_trip(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op11_bestfit"](spark, sf).collect()
    n = check_packed(rows, texts, 2048, 0)
    assert n <= math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_best_fit_of_edge_rows(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["a", "bc", "def", "ghij"]) for _ in range(rng.randrange(60))) for i in range(200)} | {200: None, 201: "", 202: "x y " * 3000}
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in texts.items()], "doc_id long, text string, piece int, ids string").repartition(3)
    check_packed(config_packing.best_fit_pack(docs, size=16, end=7).collect(), texts, 16, 7)
    twice = config_packing.best_fit_pack(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string"), size=4, end=7).collect()
    assert sum(r.length for r in twice) == 7 and sum(r.doc_id is None for r in twice) == 2
    assert config_packing.best_fit_pack(docs.where("false")).collect() == []


# ---- resampling ----------------------------------------------------------------------------------


def plain_resample(rows, target, *, width=1, buckets=10_000, key=2024, percent=10, least=20):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, width + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for id_, text in rows:
        n, f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{key}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        out.append([id_, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): i for i, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("width, percent", [(1, 10), (2, 37), (1, 100), (1, 0)])
def test_resampling_is_the_rule(spark, width, percent):
    rng = random.Random(width)
    words = ["alpha", "Beta", "gamma", "déjà", "пять", "7", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "- ! -"), (None, "beta " * 30), (303, "gamma " * 50_000)] + [(304, "alpha x " * 15)] * 20
    target = ["beta gamma " * 9, None, "x"]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, score int, place string").repartition(5)
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), width=width, percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_resample(rows, target, width=width, percent=percent), key=repr)


def test_cutoff_is_each_key_in_turn(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    keys = resample.placed(spark.createDataFrame(rows, "score long, doc_id long").repartition(4), "keys", F.desc("score"), F.asc_nulls_first("doc_id"))
    order = [r.place for r in keys.orderBy(*resample.in_order()).collect()]
    for draw in (1, 2, 17, 30, 59, 60):
        last, rounds = resample.cutoff(keys, draw)
        assert last["place"] == order[draw - 1] and rounds <= 1 + math.log(60, 4 / 3)


def test_resampling_of_empty_tables_and_other_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert resample.resample(none, none).collect() == []
    docs = spark.createDataFrame([(chr(97 + i), "word " * 25) for i in range(20)], "doc_id string, text string")
    got = resample.resample(docs, none, percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 11)) and len({r.weight for r in got}) == 1


# ---- prefix trie ---------------------------------------------------------------------------------


def plain_trie(convs):
    """convs: id -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = Counter(), Counter()
    for k, own in members.items():
        worth = (len(own) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += worth
    return sorted(
        ((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()),
        key=repr,
    )


def plain_rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(own)] for c, own in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def trie_rows(spark, rows, width):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, block int, x1 string").repartition(3)
    return sorted(map(tuple, prefix_trie.trie(*prefix_trie.grafted(prefix_trie.turns_of(table)), width=width).collect()), key=repr)


@pytest.mark.parametrize("width", [1, 3, 8])
def test_trie_is_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_CHUNK", 2)
    rng = random.Random(width)
    rows = [(c, t, "user" if t % 2 == 0 else None, rng.choice(["", "a", "bé", None]) if t < 4 else rng.choice("ab")) for c in range(60) for t in range(rng.choice([1, 2, 3, 9, 14]))]
    rows += [(c, t, "u", f"same {t}") for c in range(70, 90) for t in range(12)]  # copies
    rows += [(100, t, "u", "long" + "x" * (t % 3)) for t in range(60)] + [(101, None, "u", "a null turn"), (101, 0, "u", "z"), (None, 0, "u", "nobody's")]
    rows = [r for r in rows if r[0] not in (15, 25)]  # conversations whose base is absent, some left without turns
    assert trie_rows(spark, rows, width) == plain_trie(plain_rebuilt(rows))


def test_trie_of_repeated_rows_and_empty_tables(spark):
    rows = [(5, 0, "u", "a"), (5, 0, "u", "a"), (10, 0, "u", "a"), (10, 1, "u", "a")]
    plain = {5: [("u", "a")] * 2, 10: [("u", "a")] * 2}
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.trie(*prefix_trie.every_turn(prefix_trie.turns_of(table)))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(plain)
    assert prefix_trie.trie(*prefix_trie.grafted(prefix_trie.turns_of(table.where("false")))).collect() == []


def test_ends_are_hashed_in_order_over_pieces(spark):
    ends = spark.range(0, 3000).select(F.lit(7).cast("long").alias("conv_id"), F.lit(2).cast("long").alias("depth"), F.col("id").alias("conv")).repartition(5)
    got = prefix_trie.ends_digest(ends, piece=500).collect()
    assert [tuple(r) for r in got] == [(7, 2, hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest())]
