"""SimHash components, suffix deduplication and phrase fingerprints against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crossgrain.llm import induced, lzprint, neardup, simhash, suffix_dedup

ROWS = "doc_id long, text string"


# ---- suffix sorting ------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_is_sorted_and_prefixes_exact(seed):
    rng = np.random.default_rng(seed)
    symbols = int(rng.integers(2, 6))
    text = np.append(rng.integers(1, symbols, int(rng.integers(1, 80))), 0).astype(np.uint16)
    order, words = induced.suffix_array(text, symbols, 200, memory=int(rng.integers(1, 60)))
    plain = text.tolist()
    assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
    for a, b, n in zip(order[:-1], order[1:], induced.common_prefix(words, order[:-1], order[1:], 200)):
        x, y = plain[a:], plain[b:]
        assert n == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def covered(docs, length):
    """By the definition: rows (id, bytes) -> removed flags."""
    first = {}
    for doc, data in sorted(docs):
        for i in range(len(data) - length + 1):
            first.setdefault(data[i : i + length], (doc, i))
    out = {}
    for doc, data in docs:
        hit = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < (doc, i):
                hit[i : i + length] = True
        out[doc] = hit
    return out


def random_texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 60)))
            parts.append(p[: rng.randint(1, len(p))] if rng.random() < 0.3 else p)
        out.append((i * 7 % n, " ".join(parts)))
    out += [(n + 1, None), (n + 2, ""), (n + 3, "x" * 700), (n + 4, "ab" * 300), (n + 5, "x" * 300), (n + 6, out[0][1])]
    return out


@pytest.mark.parametrize("shard", [200, 1 << 20])
def test_suffix_dedup_is_the_definition(spark, shard):
    rows = random_texts(5)
    want = covered([(i, (t or "").encode()) for i, t in rows], 100)
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, ROWS).repartition(5), shard=shard).collect()
    assert len(got) == len(rows)
    for r in got:
        hit = np.zeros(len(r.data), bool)
        for s in r.spans:
            hit[s.start : s.end] = True
        assert (hit == want[r.doc_id]).all()
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_suffix_dedup_query_matches_given_table(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = covered(sorted(docs.items()), 100)
    for r in suffix_dedup.op7_suffix_dedup(spark, sf).collect():
        hit, data = want[r.doc_id], np.frombuffer(docs[r.doc_id], np.uint8)
        runs = int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum()) if len(hit) else 0
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), hit.sum(), runs)
        assert r.kept_sha256 == hashlib.sha256(data[~hit].tobytes()).hexdigest()


def test_suffix_dedup_ids_that_repeat(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(1, long), (1, long), (1, long[100:350] + "z"), (None, long[50:300]), (None, None)]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 5
    order = sorted({(i or 0, (t or "").encode()) for i, t in rows}, key=lambda r: (r[0], hashlib.sha256(r[1]).hexdigest()))
    want = covered([(k, data) for k, (_, data) in enumerate(order)], 100)
    for r in got:
        k = order.index((r.doc_id or 0, bytes(r.data)))
        assert sum(s.end - s.start for s in r.spans) == want[k].sum()
    assert suffix_dedup.repeated_passages(spark.createDataFrame([], ROWS)).count() == 0


def test_suffix_dedup_ids_of_any_kind(spark):
    rows = random_texts(6, 30)
    want = covered([(f"id {i:05d}", (t or "").encode()) for i, t in rows], 100)
    docs = spark.createDataFrame([(f"id {i:05d}", t, 1) for i, t in rows], "`the.id` string, text string, data int").repartition(3)
    for r in suffix_dedup.repeated_passages(docs, id_col="the.id").collect():
        assert sum(s.end - s.start for s in r.spans) == want[r.doc_id].sum()


# ---- SimHash -------------------------------------------------------------------------------------


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=4):
    """rows (id, fingerprint) -> id: smallest id of its component."""
    parent = {i: i for i, _ in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, f) in enumerate(prints):
        for j, g in prints[:k]:
            if (f ^ g).bit_count() <= radius:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: top(i) for i, _ in prints}


def test_simhash_query_matches_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [(r.doc_id, plain_simhash(r.text)) for r in docs]
    want, fp = classes(prints), dict(prints)
    got = simhash.op8_simhash(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


@pytest.mark.parametrize("levels", [1, 2])
def test_links_of_dense_and_chained_fingerprints(spark, levels):
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):  # chains whose ends are far apart, and dense balls
            at ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
            values.add(at)
    values |= {v ^ (1 << b) for v in list(values)[:4] for b in range(64)}
    prints = list(enumerate(sorted(values)))
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in prints], "doc_id long, fp long")
    want = classes(prints)
    got = simhash.components(rows, small_shard=4_000 if levels == 1 else 0)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


@pytest.mark.parametrize("kind", ["none", "chain", "hub", "star", "random"])
def test_connected_is_the_smallest_node_reachable(spark, kind):
    rng = random.Random(kind)
    pairs = {
        "none": [],
        "chain": [(i, i + 1) for i in range(70)],
        "hub": [(i, 50) for i in range(100)],
        "star": [(i, 0) for i in range(1, 40)] + [(5, 0), (7, 7)],
        "random": [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(110)],
    }[kind]
    top = {}
    for _ in range(len(pairs) + 1):
        for a, b in pairs:
            top[a] = top[b] = min(top.get(a, a), top.get(b, b))
    found = simhash.connected(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert sorted((r.node, r.root) for r in found) == sorted((x, t) for x, t in top.items() if x != t)


def test_forests_agree():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)]))
    assert len(values) > simhash.VECTOR_FROM
    want = classes(list(enumerate(values.tolist())))
    assert simhash.forest(values, 4).tolist() == [want[i] for i in range(len(values))]


def test_simhash_edge_rows(spark):
    rows = [(5, None, "a"), (4, "", "b"), (3, " \t\n", "c"), (7, "one two", "d"), (7, "one two", "e"), (9, "ONE two", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(3, 3), (4, 3), (5, 3), (7, 7), (7, 7), (9, 7)]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


# ---- Lempel-Ziv fingerprints ---------------------------------------------------------------------


def plain_phrases(data):
    known, phrase = set(), b""
    for i in range(len(data)):
        phrase += data[i : i + 1]
        if phrase not in known:
            known.add(phrase)
            phrase = b""
    return known


@pytest.mark.parametrize("seed", range(10))
def test_phrases_are_the_dictionary(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 600)))
    cut = rng.randint(0, len(data))
    parse = lzprint.Parse().add(data[:cut]).add(data[cut:])
    assert parse.phrases == plain_phrases(data)
    assert (lzprint.Parse().add(data).hashes(64) == parse.hashes(64)).all()


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_edited_pairs(spark, ranges):
    rows = [(i * 7, t) for i, (_, t) in enumerate(random_texts(2, 30))]
    got = {r.doc_id: r for r in lzprint.edited_pairs(spark.createDataFrame(rows, ROWS).repartition(4), ranges=ranges).collect()}
    assert len(got) == len(rows)
    prints = [lzprint.Parse().add((t or "").encode()).hashes(lzprint.SIZE) for _, t in rows]
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        tail = len(text) // 4
        edited = text[: len(text) - tail] + after[:tail]
        r = got[i]
        assert (r.n_chars, r.edited) == (len(text), edited)
        assert r.fingerprint == lzprint.digest_of(prints[k])
        e = lzprint.Parse().add(edited.encode()).hashes(lzprint.SIZE)
        assert r.edited_fingerprint == lzprint.digest_of(e)
        assert r.near_edited == lzprint.likeness(prints[k], e) and r.near_next == lzprint.likeness(prints[k], prints[(k + 1) % len(rows)])


def plain_print(text):
    """The 256 smallest hashes of the dictionary's phrases."""
    return sorted({xxhash.xxh64_intdigest(p, 0) for p in plain_phrases((text or "").encode())})[:256]


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    union = sorted({*a, *b})[:256]
    return len({*a} & {*b} & {*union}) / len(union)


def test_fingerprint_query_matches_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in lzprint.op9_lzprint(spark, sf).collect()}
    assert len(got) == len(docs)
    prints = [plain_print(t) for _, t in docs]
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        changed, r = plain_print(edited), got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{h:016x}" for h in prints[k]) and r.edited_fingerprint == "".join(f"{h:016x}" for h in changed)
        assert (r.near_edited, r.near_next) == (plain_likeness(prints[k], changed), plain_likeness(prints[k], prints[(k + 1) % len(docs)]))


def test_edited_pairs_with_ids_of_any_kind_and_a_long_text(spark):
    rows = [(f"k{i:03d}", f"text {i} " * (i + 3)) for i in range(40)] + [("k1", "long words " * 60_000), (None, "no id"), ("k005", "again")]
    got = lzprint.edited_pairs(spark.createDataFrame([(*r, "x") for r in rows], "doc_id string, text string, at string").repartition(4), ranges=5).collect()
    order = sorted(rows, key=lambda r: r[0] or "")
    where = {(i, lzprint.digest_of(np.array(plain_print(t), np.uint64))): k for k, (i, t) in enumerate(order)}
    assert len(got) == len(rows)
    for r in got:
        k = where[r.doc_id, r.fingerprint]
        if r.doc_id != "k004" and r.doc_id != "k005":  # those beside the shared id
            text, after = order[k][1], order[(k + 1) % len(order)][1]
            assert r.edited == text[: len(text) - len(text) // 4] + after[: len(text) // 4]


def test_edited_text_is_nearer_than_next(spark, sf):
    got = lzprint.op9_lzprint(spark, sf).where("n_chars > 200")
    near, other = got.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert near > other + 0.2


def test_fingerprint_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 1)], "doc_id long, text string, fingerprint int")
    assert [r.fingerprint for r in lzprint.fingerprints(docs).collect()] == ["", ""]
    assert [r.near_next for r in lzprint.edited_pairs(docs).collect()] == [1.0, 1.0]
    assert lzprint.edited_pairs(docs.where("false")).count() == 0


# ---- near-duplicates of the pipeline -------------------------------------------------------------


def plain_groups(rows):
    """rows (id, text) -> id: smallest id over links of 0.8 between sets of five-word shingles."""
    sets, group = [], {i: i for i, _ in rows}
    for k, (i, text) in enumerate(rows):
        words = (text or "").encode().lower().split()
        own = {tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))} if words else set()
        for (j, _), other in zip(rows[:k], sets):
            if own == other or 5 * len(own & other) >= 4 * len(own | other):
                a, b = sorted((group[i], group[j]))
                group = {x: a if g == b else g for x, g in group.items()}
        sets.append(own)
    return group


@pytest.mark.parametrize("block_texts", [2_000, 3])
def test_near_duplicates_match_brute_force(spark, block_texts):
    rng, rows = random.Random(8), [(900, None), (901, " "), (902, "one two"), (903, "ONE two"), (904, "one two three")]
    for _ in range(12):  # edits that leave likenesses on both sides of 0.8, and chains
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 200))]
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            base = words if rng.random() < 0.3 else list(words)
            for _ in range(rng.randint(0, 5)):
                base[rng.randrange(len(base))] = f"x{rng.randrange(5000)}"
            words = base
    for k in range(1, 8):  # exactly 0.8: of 100 shingles each, ten and a little more are changed
        words = [f"e{k}_{i}" for i in range(94)]
        rows += [(2000 + k, " ".join(words)), (3000 + k, " ".join([*words[:-10], *(f"y{i}" for i in range(10))]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = neardup.near_duplicates(docs, block_texts=block_texts).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_groups(rows)
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_pipeline_stage_drops_near_copies(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_links_of_one_bundle_of_many_groups(spark):
    """Leaders of several turns, groups that no leader joins, and chains whose ends are unlike: no link between groups is lost or made."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    texts = []
    for size in [30, 12, 9, 7, 5, 3, 2, 2, *[1] * 12]:
        own = [word() for _ in range(60)]
        for _ in range(size):
            texts.append(" ".join(own))
            at = rng.randrange(60)  # a chain: each text is like the one before, less like the earlier ones
            own = own[:at] + [word()] + own[at + 1 :]
    sets = [set(neardup.shingles(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    rows = [(k * 7 % 101, k, t) for k, t in enumerate(texts)]
    given = spark.createDataFrame([(k, p, 5, len(t), [p % 4, 100 + p % 9]) for k, p, t in rows], "key long, place long, bundle long, bytes int, bands array<long>")
    docs = spark.createDataFrame([(p, t) for _, p, t in rows], "place long, text string")
    key = {p: k for k, p, _ in rows}
    for block_texts in (3, 20):
        found = simhash.connected(neardup.links(docs, given, share=0.8, width=5, block_texts=block_texts), "key", "other").collect()
        got = {r.node: r.root for r in found}
        for p, r in enumerate(root):
            group = [key[q] for q, s in enumerate(root) if s == r]
            assert got.get(key[p], key[p]) == min(group)
