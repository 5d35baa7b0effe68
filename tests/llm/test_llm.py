"""Brute force, exact round trips and held-out accuracy for the training-data operators, and their edge cases."""

import hashlib
import heapq
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aerolith.llm import fingerprints as fp
from aerolith.llm import html_extract, pii, quality, tokens
from aerolith.llm.components import connected_components
from aerolith.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from aerolith.llm.kd_shards import kd_shards
from aerolith.llm.mixing import mix_sources, sainte_lague, source_targets
from aerolith.llm import ngram_join
from aerolith.llm.ngram_join import CountTree, _packed, _unpacked, jaccard_components
from aerolith.llm.packing import optimal_boundaries, pack
from aerolith.llm.queries import ORACLES, QUERIES
from aerolith.llm.textkernel import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, cls string, n string, size string, length string, comp string"


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "x", "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    out = []
    for k, t in enumerate(base):
        out.append((len(out), t, f"s{k % 3}"))
        w = t.split(" ")
        for e in range(k % 4):  # chains of edits
            w = list(w)
            w[rng.randrange(len(w))] = "edit%d" % e
            out.append((len(out), " ".join(w), "s0"))
    out += [(len(out) + k, t, s) for k, (t, s) in enumerate([
        (None, "s0"), ("", "s1"), (" \n\t", None), ("one", None), ("One", "s1"), ("ONE two", "s0"), (base[3].replace(" ", "\n "), "s2"), (base[3], "s2"),
        ("héllo wörld ünï cödé", "é"), (words(rng, 30000), "s0"),
    ])]
    return out + [(5, out[5][1], "s0"), (None, base[7], None), (None, None, None)]


def sets_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(low))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_shingle_sets_match_words(rows):
    got = list(shingle_sets(pa.array([t for _, t, _ in rows])))
    want = sets_of(rows)
    assert [len(x) for x in got] == [len(x) for x in want]
    for a, b in itertools.combinations(range(60), 2):
        assert len(np.intersect1d(got[a], got[b])) == len(want[a] & want[b])


def near_groups(rows):
    s = sets_of(rows)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
            up[find(b)] = find(a)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((-1 if i is None else i), len(s[k]), (-1 if i is None and not s[k] else low.get(find(k), -1) if s[k] else i)) for k, (i, _, _) in enumerate(rows))


def test_jaccard_components_match_brute_force(spark, rows):
    got = jaccard_components(table(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == near_groups(rows)


def near_groups_by_index(rows):
    """:func:`near_groups` over pairs that share a shingle only."""
    s = sets_of(rows)
    at, shared = {}, {}
    for k, x in enumerate(s):
        for y in x:
            at.setdefault(y, []).append(k)
    for v in at.values():
        for pair in itertools.combinations(v, 2):
            shared[pair] = shared.get(pair, 0) + 1
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(s[a]) + len(s[b]) - n):
            up[find(b)] = find(a)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(s[k]), low[find(k)] if s[k] else i) for k, (i, _, _) in enumerate(rows))


def test_jaccard_components_of_the_whole_table_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op2_ngram_join"](spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_groups_by_index([(r.doc_id, r.text, None) for r in docs.collect()])


def test_sets_of_one_first_hash_are_told_apart(spark):
    rng = random.Random(4)
    base = [words(rng, 40) for _ in range(6)]
    rows = [(k, t, "s") for k, t in enumerate(base + [t + " more" for t in base] + base[:2])]
    got = jaccard_components(table(spark, rows), first_bits=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_groups(rows)


def test_jaccard_of_a_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = words(rng, 80).split(" ")
    rows = []
    for k in range(260):
        w = list(base)
        for e in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(w), "s"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(table(spark, rows)).collect())
    assert got == near_groups(rows)


def near_copies(many, words_each=80, edits=4, seed=1):
    rng = random.Random(seed)
    base = words(rng, words_each).split(" ")
    rows = []
    for k in range(many):
        w = list(base)
        for e in range(rng.randint(0, edits)):
            w[rng.randrange(words_each)] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(w), "s"))
    return rows


def test_a_tile_of_near_copies_returns_no_more_rows_than_members():
    rows = near_copies(300)
    sets = list(shingle_sets(pa.array([t for _, t, _ in rows])))
    many, zero = len(sets), np.zeros(len(sets), dtype=np.int64)
    ids = np.arange(many)
    table = pa.table({
        "block": zero, "ti": zero.astype(np.int32), "tj": zero.astype(np.int32), "side": zero.astype(np.int32), "stray": np.ones(many, dtype=bool), "cls": ids, "comp": ids,
        "n": np.array([len(s) for s in sets], dtype=np.int32), "pos": zero.astype(np.int32), "point": pa.array([ngram_join._point(s) for s in sets]),
        "fine": pa.array([_packed(s) for s in sets]), "set": pa.array([s.tobytes() for s in sets]),
    })
    run = lambda on: [b for b in ngram_join._tiles(iter(table.to_batches(max_chunksize=70)), 75, on)]
    assert sum(b.num_rows for b in run("set")) < many
    label = ids.copy()
    for b in run("set"):
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            assert label[x] != label[y]  # a forest
            label[label == label[y]] = label[x]
    low = [int(np.flatnonzero(label == label[k])[0]) for k in range(many)]
    assert low == [c for _, _, c in near_groups(rows)]
    linked = {x for x in range(many) if (np.array(low) == low[x]).sum() > 1}
    for on in ("point", "fine"):
        kept = [x for b in run(on) for x in b.column("cls").to_pylist()]
        assert len(kept) == len(set(kept)) and linked <= set(kept)


def test_jaccard_of_blocks_larger_than_a_tile(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 24)
    rows = near_copies(150, 60, 5, 2) + [(200 + k, t, s) for k, t, s in near_copies(60, 40, 9, 3)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(table(spark, rows)).collect())
    assert got == near_groups(rows)


def test_count_tree_bound_loses_no_pair():
    rng = np.random.default_rng(2)
    points = rng.poisson(1.0, (300, 32)).astype(np.uint8)
    points[150:] = np.maximum(points[:150], 1) - (rng.random((150, 32)) < 0.1)
    n = points.sum(axis=1).astype(np.int64)
    tree = CountTree(points, n)
    i, j = tree.matches(tree, 75)
    want = {(a, b) for a in range(300) for b in range(300) if 175 * np.minimum(points[a], points[b]).sum(dtype=int) >= 75 * (n[a] + n[b]) and 100 * n[a] >= 75 * n[b] and 100 * n[b] >= 75 * n[a]}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_fine_count_vectors_bound_the_overlap():
    rng = np.random.default_rng(11)
    for n in (1, 3, 200, 50_000):
        pool = rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64)
        pool[: n // 2] = (pool[: n // 2] >> np.uint64(60)) << np.uint64(60) | np.arange(n // 2, dtype=np.uint64)  # many in one group
        a, b = np.unique(pool[: n + n // 2]), np.unique(pool[n // 2 :])
        x, y = (_unpacked(np.frombuffer(_packed(s), dtype=np.uint8)) for s in (a, b))
        assert (x >> 32 == (a >> np.uint64(44)).astype(np.int64)).all() and len(np.unique(x)) == len(a)
        assert len(np.intersect1d(x, y)) >= len(np.intersect1d(a, b))


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (20, 10), (20, 11), (20, 12), (2, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 10: 10, 11: 10, 12: 10, 20: 10}


def test_exact_duplicates_match_brute_force(spark, rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    want = sorted((-1 if i is None else i, -1 if min(g)[1] else min(g)[2], len(g)) for i, t, _ in rows for g in [groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]])
    got = exact_duplicates(table(spark, rows), prefix_chars=8).collect()
    none = lambda x: -1 if x is None else x
    assert sorted((none(r.doc_id), none(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    left = drop_exact_duplicates(table(spark, rows)).collect()
    assert len(left) == len(groups) and set(left[0].asDict()) == set(SCHEMA.replace(" long", "").replace(" string", "").split(", "))


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards_are_even_and_slots_gapless(spark, shards):
    rng = random.Random(3)
    data = [(k % 50 if k < 300 else k, words(rng, 20), "hot" if k % 3 else f"s{k % 7}") for k in range(900)] + [(None, None, None)] * 3
    got = kd_shards(table(spark, data), ["doc_id", "n_chars", "source", "lang"], shards=shards).collect()
    assert len(got) == len(data) and sum(r["size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t, _ in data)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(shards))
    sums = [sum(r["size"] for r in v) for v in by.values()]
    assert max(sums) - min(sums) <= 4 * 160
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())


def naive_shards(rows, leaves, ranges=None, first=0):
    """The K-d tree by sorting: ``rows`` of (key, size, tie, values); the cut is the nearer end of the row that the goal falls into."""
    if leaves == 1 or not rows:
        return {r[0]: first for r in rows}
    dims = range(len(rows[0][3]))
    span = [max(r[3][d] for r in rows) - min(r[3][d] for r in rows) for d in dims]
    ranges = ranges or [max(x, 1e-300) for x in span]
    d = max(dims, key=lambda k: (span[k] / ranges[k], -k))
    half = leaves // 2
    goal, held, left, right = sum(r[1] for r in rows) * half / leaves, 0, [], []
    for r in sorted(rows, key=lambda r: (r[3][d], r[2])):
        if not right and held + r[1] < goal or (not right and goal - held > r[1] / 2 and held < goal):
            left.append(r)
        else:
            right.append(r)
        held += r[1]
    return naive_shards(left, half, ranges, first) | naive_shards(right, leaves - half, ranges, first + half)


@pytest.mark.parametrize("shards", [2, 7])
def test_shards_match_a_naive_tree(spark, shards):
    rng = random.Random(9)
    data = [(k * 7, words(rng, rng.randint(1, 60)), "s") for k in range(120)]
    got = {r.doc_id: r.shard for r in kd_shards(table(spark, data), ["doc_id", "n_chars"], shards=shards).collect()}
    ties = {r.doc_id: r.t for r in table(spark, data).select("doc_id", (F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 40)) / float(1 << 40)).alias("t")).collect()}
    assert got == naive_shards([(i, len(t.encode()) + 1, ties[i], (float(i), float(len(t)))) for i, t, _ in data], shards)


def test_shards_of_target_bytes(spark, rows):
    got = kd_shards(table(spark, rows[:60]), ["doc_id"], target_bytes=4000).collect()
    assert len({r.shard for r in got}) == -(-sum(r["size"] for r in got) // 4000)


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def test_mix_meets_targets(spark, rows):
    got = mix_sources(table(spark, rows), shard_words=2000).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    for s, target in want.items():
        mine = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target) and r.source_size == sizes[s] for r in mine)
        assert sum(r.taken for r in mine) == pytest.approx(target, rel=0.03, abs=8)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got) and len(got) == len(rows)
    again = mix_sources(table(spark, rows[::-1]).repartition(7), shard_words=2000).collect()
    key = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.taken) for r in rs)
    assert key(got) == key(again)


def test_mix_reruns_agree_for_repeated_and_null_ids(spark):
    """Unlike texts of one size under one id, under none, and repeated rows: what each takes does not depend on partitioning."""
    rng = random.Random(3)
    some = [(7 if k % 2 else None, words(rng, 20), "a" if k % 3 else None) for k in range(300)] + [(9, "one two three", "a")] * 200
    df = table(spark, some)
    found = []
    for t in (df.coalesce(1), df.repartition(9), df.repartition(4, "text")):
        mixed = mix_sources(t, shard_words=500, carry={"th": F.xxhash64("text")}).collect()
        assert len(mixed) == len(some)
        found.append(sorted((r.doc_id is None, r.doc_id or 0, r.th, r.taken) for r in mixed))
    assert found[0] == found[1] == found[2] and all(t <= 2 * 20 for *_, t in found[0])


def test_apportionment_by_highest_quotients(spark):
    rng = random.Random(5)
    for n, seats in ((1, 7), (4, 10), (9, 137), (30, 3)):
        votes = [rng.randint(0, 1000) for _ in range(n)]
        votes[0] += 1
        won = [0] * n
        heap = [(-v / 1, k) for k, v in enumerate(votes)]
        heapq.heapify(heap)
        for _ in range(seats):
            _, k = heapq.heappop(heap)
            won[k] += 1
            heapq.heappush(heap, (-votes[k] / (2 * won[k] + 1), k))
        df = spark.createDataFrame(list(enumerate(votes)), "k int, v long").withColumn("g", F.lit(1))
        got = sainte_lague(df, "v", F.lit(seats), ["g"], [F.col("k")], "won").orderBy("k").collect()
        assert [r.won for r in got] == won


def test_packing_boundaries_are_optimal():
    rng = np.random.default_rng(8)
    for _ in range(20):
        m, k = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        bounds, counts = np.sort(rng.choice(60, m, replace=False)).astype(float), rng.integers(1, 9, m)

        def cost(ends):
            return sum(c * min(e for e in ends if e >= b) for b, c in zip(bounds, counts))

        want = min(cost((*c, bounds[-1])) for r in range(min(k, m)) for c in itertools.combinations(bounds[:-1], r))
        ends = optimal_boundaries(bounds, counts, k)
        assert len(ends) <= k and cost(ends) == want


def test_packed_batches(spark, rows):
    got = pack(table(spark, rows), buckets=4, token_budget=400).collect()
    assert sorted(r.length for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    batches = {}
    for r in got:
        assert r.length <= r.bucket_len
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (b, k), v in batches.items():
        assert sorted(r.slot for r in v) == list(range(len(v))) and (len(v) == 1 or len(v) * v[0].bucket_len <= 400)
        assert k == 0 or (b, k - 1) in batches


def test_long_lengths_pack_by_lengths_of_rows(spark):
    lengths = [3, 3, 17_000, 17_001, 17_001, 40_000, 40_003, 90_000]
    docs = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, words long")
    got = pack(docs, length=F.col("words"), buckets=4, token_budget=100_000).collect()
    ends = {r.bucket_len for r in got}
    assert ends <= set(lengths) and len(ends) == 4
    best = min(sum(min(e for e in (*c, 90_000) if e >= n) - n for n in lengths) for c in itertools.combinations(sorted(set(lengths))[:-1], 3))
    assert sum(r.bucket_len - r.length for r in got) <= best + sum(n for n in lengths if n > 1 << 14) // (1 << 12)


def test_packing_of_the_whole_table_is_optimal(spark):
    got = QUERIES["op10_length_packing"](spark, "/root/testdata/sf0.001").collect()
    lengths = sorted({r.length for r in got})
    count = {n: sum(r.length == n for r in got) for n in lengths}
    best = {0: 0}  # cost by number of lengths covered, for one more bucket each turn
    for _ in range(8):
        nxt = dict(best)
        for j in range(1, len(lengths) + 1):
            cost, n = 0, 0
            for i in range(j - 1, -1, -1):
                n += count[lengths[i]]
                cost = lengths[j - 1] * n
                if i in best:
                    nxt[j] = min(nxt.get(j, np.inf), best[i] + cost)
        best = nxt
    assert sum(r.bucket_len for r in got) == best[len(lengths)] and len({r.bucket_len for r in got}) <= 8


def test_quality_scores_are_the_mean_of_leans():
    rng = np.random.default_rng(3)
    lean = rng.normal(size=quality.KINDS << quality.BITS).astype(np.float32)
    texts = ["", "a", "some words, some words again", "ünï cödé " * 40, "x" * 70_000, " \n"]
    got = quality.score_texts(pa.array(texts, pa.large_string()), lean, 0.25, True)
    for t, p in zip(texts, got):
        raw, total, n = t.encode(), 0.0, 0
        for size in (3, 4):  # byte n-grams, one by one
            for k in range(len(raw) - size + 1):
                code = int.from_bytes(raw[k : k + size], "little") * 0x9E3779B1 % (1 << 32) >> (32 - quality.BITS)
                total, n = total + float(lean[code + ((size - 2) << quality.BITS)]), n + 1
        whole = [int(h[0]) for h in (word_hashes(*words_of(w)) for w in WORD.findall(t))]
        buckets = [h >> (64 - quality.BITS) for h in whole] + [((a ^ b) >> (64 - quality.BITS)) + (3 << quality.BITS) for a, b in zip(whole, whole[1:])]
        total, n = total + sum(float(lean[b]) for b in buckets), n + len(buckets)
        z = (total / n if n else 0.0) + 0.25
        assert p == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def words_of(word):
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return raw, np.array([0]), np.array([len(raw)])


def test_quality_learns_from_long_texts_and_of_repeated_ids_from_one(spark):
    rng = random.Random(8)
    bad = lambda n: " ".join("zz" + rng.choice("xq") * 3 for _ in range(n))
    docs = [(k, words(rng, 60) if k % 2 else bad(60), "s") for k in range(60)] + [(100, bad(120_000), "s"), (101, words(rng, 100_000), "s"), (3, bad(9), "s"), (3, words(rng, 9), "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in (*range(40), 100, 101)], "doc_id long, quality int")
    one = quality.quality_scores(table(spark, docs), labels)
    got = {(r.doc_id, round(r.score, 9)) for r in one.collect()}
    again = {(r.doc_id, round(r.score, 9)) for r in quality.quality_scores(table(spark, docs[::-1]).repartition(5), labels).collect()}
    assert got == again and all((p >= 0.5) == (i % 2 == 1) for i, p in got if i in (100, 101) or 40 <= i < 60)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = quality.quality_scores(docs, labels, learn=~fold, rows_per_label=300).where(fold).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and 0.6 * docs.count() < kept.count() < docs.count()


def test_the_fit_is_bounded_in_bytes(spark):
    """Of too many or too large bags those of the first texts by hash are kept, the same for any partitions; keeping columns of any names."""
    bags = spark.createDataFrame([(str(i), i % 2, bytes(4 * (i + 1)), bytes(4 * (i + 1))) for i in range(100)], "doc_id string, quality int, ids binary, share binary")
    some = [sorted((r.doc_id, len(r.ids) + len(r.share)) for r in quality.within_bytes(b, 8000).collect()) for b in (bags.coalesce(1), bags.repartition(7))]
    assert some[0] == some[1] and 0 < len(some[0]) < 100
    for q in (0, 1):
        assert sum(n for d, n in some[0] if int(d) % 2 == q) <= 4000
    assert quality.within_bytes(bags, 1 << 30).count() == 100
    docs = spark.createDataFrame([(1, "some words", 2.0), (2, None, 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    out = quality.quality_scores(docs, labels, keep=["text"])
    assert out.columns == ["doc_id", "text", "score", "predicted"] and {r.text for r in out.collect()} == {"some words", None}


def test_quality_without_labels(spark, rows):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(table(spark, rows), labels).collect()} == {0.5}


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[::4], rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)]))
    x, y = fp.sketch(a), fp.sketch(b)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(fp.likeness(x, y) - true) < 0.06 and abs(fp.containment(y, x) - len(np.intersect1d(a, b)) / len(b)) < 0.12
    m, whole = fp.merge(x, y), fp.sketch(np.union1d(a, b))
    assert np.array_equal(m[0], whole[0])
    for s in (x, fp.sketch(a[:3]), fp.sketch(a[:0]), fp.sketch(a[:100])):
        k, limit = fp.from_text(fp.to_text(*s))
        assert np.array_equal(k, s[0]) and limit == s[1]


@pytest.mark.parametrize("n, most", [(20, 0.0), (64, 0.0), (70, 0.06), (230, 0.035), (2000, 0.012)])
def test_error_of_likeness_by_length(n, most):
    """Mean error of the estimate for texts of ``n`` shingles of which half are shared; none where sets stay whole, else the sampling error of the fraction."""
    rng, errors = np.random.default_rng(n), []
    for _ in range(200):
        every = rng.integers(0, 1 << 63, n + n // 2, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(every[:n]), np.unique(every[n // 2 :])
        errors.append(abs(fp.likeness(fp.sketch(a), fp.sketch(b)) - len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
    assert np.mean(errors) <= most


def test_kept_columns_may_have_the_operators_names(spark):
    pages = spark.createDataFrame([(1, "<p>Some text of the page.</p>", "x", 5)], "page_id int, html string, text string, n_chars int")
    out = html_extract.extract_main_text(pages, keep=("html", "page_id"))
    assert out.columns == ["html", "page_id", "text", "n_chars"] and out.first().html == pages.first().html


def test_fingerprints_follow_the_contract(spark, rows):
    ids = [(i, t, s) for k, (i, t, s) in enumerate(rows) if i is not None and k < len(rows) - 3]
    got = {r.doc_id: r for r in fp.fingerprint_pairs(table(spark, ids)).collect()}
    order = sorted(ids, reverse=True, key=lambda r: r[0])
    sets = dict(zip([i for i, _, _ in ids], sets_of(ids)))
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = sets[i], sets[order[(k + 1) % len(order)][0]]
        if len(a) <= 64 and len(b) <= 64 and a | b:
            assert r.near_next == pytest.approx(len(a & b) / len(a | b))
    same = {}
    for i, t, _ in ids:
        same.setdefault(t or "", set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert fp.fingerprint_pairs(table(spark, rows)).count() == len(rows)
    assert fp.fingerprint_pairs(table(spark, rows[:1])).first().near_next == 1.0


def test_fingerprints_over_many_ranges(spark):
    rng = random.Random(2)
    data = [(k, words(rng, 12), "s") for k in range(3000)]
    got = {r.doc_id: r.edited_sha256 for r in fp.fingerprint_pairs(table(spark, data)).collect()}
    for k, t, _ in data:
        nxt = data[(k - 1) % len(data)][1]
        n = len(t) // 3
        assert got[k] == hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()


def test_ranges_of_documents_cut_anywhere(monkeypatch, spark):
    rng = random.Random(12)
    monkeypatch.setattr(fp, "RANGE_ROWS", 3)  # read on the driver only
    big = 1 << 62
    data = [(rng.choice([7, 7, 7, -5, big + 1, big + 2, None, k]), words(rng, 8), "s") for k in range(400)]
    got = sorted(r.edited_sha256 for r in fp.fingerprint_pairs(table(spark, data)).collect())
    th = {r.text: r.h for r in table(spark, data).select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), th[r[1]]))
    want = []
    for k, (_, t, _) in enumerate(order):
        n = len(t) // 3
        want.append(hashlib.sha256((t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]).encode()).hexdigest())
    assert got == sorted(want)


def test_token_counts_are_the_library_s(spark, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    odd = ["".join(rng.choice(["a", "b ", "  ", "\n", "\t ", "1", "'s", "é", "<|endoftext|>", " ", "!", "don't", "\x1c", "\x85", " "]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    data = rows + [(9000 + k, t, "s") for k, t in enumerate(odd)]
    got = tokens.token_counts(table(spark, data), P.path("byte_bpe_50k.json")).collect()
    want = [(len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for _, t, _ in data]
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted(want) and all(r.over_limit == (r.n_tokens > 512) for r in got)
    some = tokens.token_counts(table(spark, rows[:9]), P.path("piece_bpe_32k.model")).collect()
    assert all(r.n_tokens > 0 for r in some)


def test_texts_without_spaces_are_cut():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    piece = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    (encode, cut), (encode_p, cut_p) = tokens.load(P.path("byte_bpe_50k.json")), tokens.load(P.path("piece_bpe_32k.model"))
    for t in ("中文字。" * 7000, "\n".join(["a line"] * 3000), "abc_def-" * 900):
        assert max(map(len, cut(t))) < 20 and "".join(cut(t)) == t and sum(encode(cut(t))) == len(whole.encode(t, add_special_tokens=False).ids)
    rng = random.Random(2)
    alphabet = ["a", "b ", "  ", "\n", "\t ", "1", "'s", "'", "é", "<|endoftext|>", " ", "!", "don't", "\x1c", "\x85", "\u3000", "字", "。", "_", "कि", "²", "\u2581", "😀"]
    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16)))
        long = "字" * 1100 + t  # so that the further cuts are made
        assert sum(encode(cut(long))) == len(whole.encode(long, add_special_tokens=False).ids)
        assert sum(encode_p(cut_p(t))) == len(piece.encode(t))


def test_base_spans_are_the_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(6)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "b", "1", "2", "25", "4111111111111111", ".", "@", "+", "-", " ", "%", "(", ")", "555 0100"]) for _ in range(rng.randint(0, 24)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)] + [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        want += [(m.start(), 2, m.end()) for m in card.finditer(t) for d in [re.sub(r"[ -]", "", m.group())] if 12 <= len(d) <= 19 and pii.luhn(d)]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
        assert pii.base_spans(t) == sorted(want)
    assert pii.base_spans("1" * 200_000 + "@" * 1000) == []


def test_random_field(spark, rows):
    model = pii.train_crf(pii.labelled_table())
    table_ = pii.labelled_table(seed=77, rows=200)
    got = pii.viterbi(model, [w for w, _ in table_])
    right = [pii.LABELS[a] == b for y, (_, labels) in zip(got, table_) for a, b in zip(y, labels)]
    assert np.mean(right) > 0.97
    for words_, _ in [x for x in table_ if len(x[0]) <= 4][:10]:  # Viterbi is the best of all sequences
        e, n = model.scores(words_), len(pii.LABELS)
        best = max(itertools.product(range(n), repeat=len(words_)), key=lambda y: model.step[n, y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(model.step[a, b] for a, b in zip(y, y[1:])))
        assert tuple(pii.viterbi(model, [words_])[0]) == best
    text = "call (555) 201-3344 now, mail jo@x.org. 4111111111111111 5500000000000004 version 3.0.1 ok"
    base, every = pii.found_spans([text], model)[0]
    assert [text[a:b] for a, k, b in base] == ["jo@x.org"] and {text[a:b] for a, k, b in every} >= {"jo@x.org", "(555) 201-3344", "4111111111111111", "5500000000000004"}
    out = pii.find_personal_data(table(spark, [*rows, (7000, text, "s")])).collect()
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in out if r.doc_id is not None and r.doc_id < 40)
    assert next(r for r in out if r.doc_id == 7000).n_email == 1


def test_an_entity_in_a_long_run_is_not_cut():
    model = pii.train_crf(pii.labelled_table())
    for before in range(250, 260):  # a number of two words at each place about word 256
        text = "v3 " * before + "call (212) 555-0100 now" + " v3" * 300
        found = {text[a:b] for a, k, b in pii.found_spans([text], model)[0][1]}
        assert found == {"(212) 555-0100"}, before
    long = ["v3", "call", "(212)", "555-0100"] * 2500  # scores in parts are those of the whole
    want = np.array([model.emit[[model.index[x] for x in f if x in model.index]].sum(axis=0) for f in pii.features(long)])
    assert np.array_equal(model.scores(long), want)
    assert pii.shape("a" * 64 + "@9") == "a@91;" and pii.shape("-a" * 30) == "-a" * 30


def test_the_field_finds_planted_kinds():
    """Recall by kind on documents of the tables, where the checked patterns say what is there; the field's own spans, before base ones take their place."""
    import pyarrow.parquet as pq

    model = pii.train_crf(pii.labelled_table())
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    base = [pii.base_spans(t) for t in texts]
    seen, found = [0] * 4, [0] * 4
    own = pii.model_spans(texts, model)
    for b, m in zip(base, own):
        for start, kind, stop in b:
            seen[kind] += 1
            found[kind] += any(k == kind and a < stop and start < e for a, k, e in m)
    for kind, name in enumerate(pii.KINDS):
        assert seen[kind] == 0 or found[kind] >= 0.9 * seen[kind], (name, seen, found)
    assert sum(seen) >= 50


@pytest.mark.parametrize("inner,kept", [
    ("<svg class=x/>", True), ("<svg><svg/><text>hid</text></svg>", True), ("<svg><svg>hid</svg>hid</svg>", True), ("<object data=x>", True), ("<noscript>", True), ("<template>", True),
    ("<object>hid<object>hid</object>hid</object>", True), ("<script>", False), ("<style>", False),
])
def test_elements_without_an_end_tag_keep_the_page(inner, kept):
    _, runs = html_extract.parse(f"<body><p>One before.</p>{inner}<p>Two after.</p></body>")
    said = " ".join(t for _, t in runs)
    assert "One before" in said and ("Two after" in said) == kept and "hid" not in said


def test_pages_may_use_the_label_attribute_and_nest_deeply():
    import time

    _, runs = html_extract.parse('<p data-y="12px">a<p data-y="1.5">b<p data-y="">c')
    assert [t for _, t in runs] == ["a", "b", "c"]
    n, began = 20_000, time.process_time()
    nodes, _ = html_extract.parse("<div>" * n + "x" + "</div>" * n)
    assert len(nodes) == n + 1
    html_extract.parse("<div>" * n + "<li>x</b></ul></p>" * n)
    html_extract.parse("<div>" * n + "<p>a<ul>" * n)
    assert time.process_time() - began < 10
    nodes, runs = html_extract.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table><p>h<div>i<button><p>j</button><p>k")
    assert [t for _, t in runs] == list("abcdefghijk")
    of = {t: nodes[k] for k, t in runs}
    assert nodes[of["a"].parent].tag == nodes[of["d"].parent].tag == "ul" and of["a"].parent == of["d"].parent != of["b"].parent == of["c"].parent
    assert of["e"].parent == of["f"].parent != of["g"].parent and nodes[of["i"].parent].tag == "html" and nodes[of["j"].parent].tag == "button"


def test_main_text_of_real_pages(spark):
    """Pages of the tables against what their markup says: the text of the marked article survives, that of menus, notices and comments doesn't."""
    rows_ = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(60).collect()
    model = html_extract.train_tree(html_extract.labelled_pages())
    for r in rows_:
        got = html_extract.main_text(r.html or "", model)
        assert "<" not in got or "&lt;" in r.html
        for tag in ("nav", "footer", "form"):
            for inner in re.findall(rf"<{tag}[^>]*>(.*?)</{tag}>", r.html or "", re.S):
                lines = [html_extract.html.unescape(x).strip() for x in re.split(r"<[^>]*>", inner)]
                assert not any(len(x) > 12 and x in got for x in lines), (r.page_id, tag)


def test_messages_are_exact_marginals():
    model = html_extract.train_tree(html_extract.labelled_pages(40))
    nodes, _ = html_extract.parse("<body><nav><a href=x>y</a></nav><article><p>Some text here.<ul><li>a<li>b</ul></article></body>")
    n = len(nodes)
    held = html_extract.around(nodes)
    u = [sum(model.one.get(f, 0.0) for f in html_extract.unary(x, model.known, held[k], held[x.parent] if k else 0)) for k, x in enumerate(nodes)]
    t = [np.sum([model.two.get(f, [0.0] * 4) for f in html_extract.pairwise(x)], axis=0) for x in nodes]
    total, mass = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(u[k] * y[k] for k in range(n)) + sum(t[k][2 * y[nodes[k].parent] + y[k]] for k in range(1, n)))
        total += w
        mass += w * np.array(y)
    assert np.allclose(model.marginals(nodes), mass / total)


@pytest.mark.parametrize("size", [1, 2, 4, 8, 20])
@pytest.mark.parametrize("form", [
    "<html><body>{a}</body></html>", "<html><body>{raw}</body></html>", '<body>{nav}<div class="blog-single">{a}</div>{foot}</body>', '<body>{nav}<div class="xyz-42">{a}</div>{foot}</body>',
    "<body>{nav}<div>{a}</div>{foot}</body>", "<body>{nav}{a}{ad}{foot}</body>", '<body>{nav}<div id="q7"><div class="ww zz">{a}</div>{cm}</div>{foot}</body>', "{a}", "<body><h1>Title</h1>{a}{cm}</body>",
    "<body><table><tr><td>{a}</td></tr></table></body>", "<body>{br}{foot}</body>", '<body>{nav}<div id="w7"><div class="col-md-8">{a}</div><div class="sidebar"><p>Other things.</p></div></div>{foot}</body>',
])
def test_articles_of_plain_and_unknown_layouts_stay(form, size):
    """Long and short paragraphs in the body itself, as its bare text, and in wrappers of names never seen; menus, adverts and the like go."""
    global _model
    _model = globals().get("_model") or html_extract.train_tree(html_extract.labelled_pages())
    parts = [" ".join([f"Some words of a paragraph number {k} that goes on"] * size) + "." for k in range(5)]
    page = form.format(
        a="".join(f"<p>{x}</p>" for x in parts), raw="\n".join(parts), br="<br><br>".join(parts), nav='<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">News</a></li></ul></nav><header><h2>Site name</h2></header>',
        foot="<footer><p>&copy; 2020 Company. All rights reserved.</p></footer>", ad='<div class="ad-box"><p>Buy now the best things.</p></div>',
        cm='<div id="comments"><div class="comment"><p>Nice words here by a reader.</p></div></div>')
    got = html_extract.main_text(page, _model)
    assert all(x in got for x in parts)
    assert not any(x in got for x in ("Home page", "Site name", "Company", "Buy now", "Nice words", "Other things"))


def test_html_extraction(spark):
    model = html_extract.train_tree(html_extract.labelled_pages())
    right = []
    for page in html_extract.labelled_pages(60, seed=501):
        nodes, runs = html_extract.parse(page, labelled=True)
        y = []
        for k in nodes:
            y.append(k.label if k.label is not None else y[k.parent] if k.parent >= 0 else 0)
        p = model.marginals(nodes)
        right += [(p[k] >= 0.5) == y[k] for k, _ in runs]
    assert np.mean(right) > 0.98
    page = """<!DOCTYPE html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></ul></nav>
      <div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Head &amp; line</h1><p><b>First&nbsp; one<br>goes on.<p>Second &lt;b&gt;.</p><aside>Buy now</aside>
      <section class="comments"><p>I agree.</p></section></article><footer>&copy; me</footer>"""
    assert html_extract.main_text(page, model) == "Head & line\n\nFirst one goes on.\n\nSecond <b>."
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<"), (5, "u", "<p" * 50000), (1, "u", page)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {(r.page_id, r.text) for r in got}
    assert len(got) == 6 and {(2, ""), (3, ""), (5, "")} <= texts and sum(r.page_id == 1 for r in got) == 2
    assert all(r.n_chars == len(r.text) for r in got)


def test_empty_tables(spark):
    import public_tokenizers as P

    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        kd_shards(none, ["doc_id"], shards=16), jaccard_components(none), quality.quality_scores(none, labels), fp.fingerprint_pairs(none), mix_sources(none),
        tokens.token_counts(none, P.path("byte_bpe_50k.json")), pii.find_personal_data(none), exact_duplicates(none), drop_exact_duplicates(none), pack(none),
        html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")), source_targets(spark.createDataFrame([], "source string, size long")),
    ]
    assert [d.count() for d in made] == [0] * len(made)


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, an empty table, and columns with the stages' own names."""
    import corpus_pipeline as c

    sf, rng = "/root/testdata/sf0.001", random.Random(5)
    names = "_id _times _turn _dropped _hash _their_hash _key_id _key_hash _tkey _kid comp kept id text_hash taken size th cls component_class length _c_th best"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names.split())
    a, b = words(rng, 60), words(rng, 60)
    near = " ".join("edit" if k == 3 else w for k, w in enumerate(a.split(" ")))
    texts = [(3, a), (5, near), (5, b), (5, b), (None, near + " q"), (None, words(rng, 40)), (None, words(rng, 40)), (7, None), (8, ""), (9, " \n"), (10, words(rng, 20_000)), (11, "one two"), (12, "one two"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *[1] * len(names.split())) for i, t in texts], schema)
    run = lambda stage, df: stage(spark, df, sf)
    found, whole, none = [], {tuple(r) for r in docs.collect()}, docs.limit(0)
    for _, stage in c.STAGES[:-1]:
        out = run(stage, docs)
        got = out.collect()
        assert out.columns == docs.columns and {tuple(r) for r in got} <= whole
        found.append(sorted((-1 if r.doc_id is None else r.doc_id, "" if r.text is None else r.text) for r in got))
        assert run(stage, none).count() == 0
    assert run(c.STAGES[-1][1], docs).count() == len(texts) and run(c.STAGES[-1][1], none).count() == 0
    _, exact, joined, mixed = found
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert len(exact) == len({plain(t) for _, t in texts}) and (9, " \n") in exact and (11, "one two") in exact
    # the near copies of 3 go, of one id and without one; the unlike text under that id stays, once
    assert joined == sorted([(3, a), (5, b), (-1, texts[5][1]), (-1, texts[6][1]), (7, ""), (8, ""), (9, " \n"), (10, texts[10][1]), (11, "one two"), (-1, "")])
    assert all(t.strip() for _, t in mixed) and {t for _, t in mixed} <= {t for _, t in texts if t}


def test_pipeline_on_the_smallest_table(spark):
    """``run`` is its stages in turn: each document is there 0, 1 or 2 times, in batches within the budget."""
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    got = c.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    times = {}
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.length == len(WORD.findall(docs[r.doc_id])) <= r.bucket_len
    assert set(times.values()) <= {1, 2} and len({re.sub(r"\s", "", docs[i]) for i in times}) == len(times)
    near = near_groups_by_index([(i, docs[i], None) for i in times])
    assert all(c_ == i for i, _, c_ in near)  # no two of them link


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_return_their_columns(spark, name):
    sf = "/root/testdata/sf0.001"
    want = {
        "op1": "doc_id size text_crc32 law shard slot grown_shard", "op2": "doc_id n_shingles component_id", "op3": "doc_id held_out score predicted",
        "op4": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op5": "doc_id size source_size target taken",
        "op6": "doc_id n_bytes n_tokens over_limit", "op7": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op8": "doc_id keep_id group_size kept text_sha256",
        "op9": "page_id url text n_chars", "op11": "vec_id component n deviation whitened explained identity_error", "op12": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op13": "doc_id leaf subroot root proof_sha256 folded_root verified", "op10": "doc_id length bucket bucket_len batch slot", "pipeline": "doc_id length bucket bucket_len batch slot",
    }[name.split("_")[0]].split()
    out = QUERIES[name](spark, sf)
    assert set(want) <= set(out.columns)
    if name not in ("pipeline", "op11_whitening"):
        assert out.count() == spark.read.parquet(f"{sf}/{'pages' if name.startswith('op9') else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_registered_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()[list(want.columns)]
    assert sorted(map(repr, want.astype(object).itertuples(index=False, name=None))) == sorted(map(repr, got.astype(object).itertuples(index=False, name=None)))


def test_pipeline_stages_on_their_own_inputs(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf)
        rows_ = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns
        seen.append((docs, rows_))
        docs = spark.createDataFrame(rows_, docs.schema)
    exact_in, exact_out = seen[1][0].collect(), seen[1][1]
    assert len(exact_out) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in exact_in})
    near_in, near_out = [(r.doc_id, r.text, r.source) for r in seen[2][0].collect()], seen[2][1]
    assert {r[0] for r in near_out} == {c_ for _, _, c_ in near_groups(near_in)}
    mixed = seen[3][1]
    assert max(mixed.count(r) for r in set(mixed)) <= 2 and {r[0] for r in mixed} <= {r[0] for r in near_out}
    assert c.STAGES[-1][1](spark, docs, sf).count() == len(mixed)


def test_quads_of_very_long_zeros(spark):
    """Parts are compared without leading zeros, however many there are."""
    quad = "0" * 5000 + ".0.0.1"
    assert pii.base_spans(quad) == [(0, 1, 5006)] and pii.base_spans("9" * 5000 + ".0.0.1") == [] and pii.base_spans("000.00.0.0256") == []
    assert pii.find_personal_data(table(spark, [(1, quad + " 1.2.3.4", "a")])).first().n_ip == 2


def test_equal_rows_are_numbered_in_many_tasks(spark, monkeypatch):
    """Rows without an id and of one length, or all alike, are no single bin; numbers stay gapless in every group."""
    from aerolith.llm import common

    monkeypatch.setattr(common, "BIN_ROWS", 64)
    df = common.materialize(spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), F.lit(7).alias("length"), (F.col("id") % 2).alias("g")).repartition(6))
    out = common.dense_index(df, 9000, "g", ["k", "length"])
    for g in (0, 1):
        assert sorted(r.slot for r in out.where(f"g = {g}").select("slot").collect()) == list(range(4500))
    assert sorted(out.columns) == ["g", "k", "length", "slot"]
