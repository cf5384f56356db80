"""The prefix trie, hard negatives and the Jaccard join against brute force, with
nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from quarrylight.llm import jaccard, negatives, trie

TURNS = "conv_id long, turn long, role string, text string, pos long, depth string, path int"


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    tie = lambda t: (t[0], t[1], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest())
    convs = {c: [t[2:] for t in sorted(own, key=tie)] for c, own in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    nodes = {}
    for c, own in rebuilt.items():
        for d in range(len(own) + 1):
            nodes.setdefault(own[:d], []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if rebuilt[c] == prefix)
        out.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(1, 90), 10**12 + 5, 10**12 + 7, -7, -5, 0]:
        for t in range(rng.randrange(0, 14)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "ö", "hello there", None, "x" * 50])))
    for c in range(200, 240):  # copies, and the same first turns
        rows += [(c, t, "user", f"turn {t}") for t in range(9 + c % 3)]
    rows += [(300, t // 2, "user", "odd" * (t % 4)) for t in range(60)] + [(300, None, "user", "first"), (300, 1, "user", "odd")]
    rows += [(None, 1, "user", "nobody"), (301, None, None, None), (5, 0, "user", "again"), (5, 0, "user", "again")]
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_prefix_trie(spark, monkeypatch, chunk):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "d", 2) for r in rows], TURNS).repartition(5)
    got = sorted((tuple(r) for r in trie.prefix_trie(df, chunk=chunk).collect()), key=str)
    assert got == brute_trie(rows)


def test_prefix_trie_of_one_long_conversation(spark):
    """A conversation in many tasks: running sums are carried, paths are long."""
    rows = [(10, t, "user", f"t{t % 7}") for t in range(3000)] + [(15, t, "user", f"t{t % 7}") for t in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(df, chunk=100).collect()}
    assert len(got) == 3001 and got[10, 0].n_leaves == 1 and got[10, 2000].n_convs == 2 and got[10, 2001].n_convs == 1
    assert got[10, 0].saved_tokens == 2 * 2000 and got[10, 1999].saved_tokens == 2 * 2
    assert got[10, 2000].ends_sha256 == hashlib.sha256(b"15").hexdigest()


def test_prefix_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(empty).count() == 0


def test_long_lists_of_ids(spark, monkeypatch):
    ends = spark.range(400_000).selectExpr("CAST(id % 3 = 0 AS BIGINT) AS k1", "CAST(0 AS BIGINT) AS k2", "id AS conv_id")
    got = {r.k1: r.sha for r in trie.joined_ids(ends).collect()}
    for k in (0, 1):
        want = ",".join(str(i) for i in range(400_000) if (i % 3 == 0) == k)
        assert bytes(got[k]) == hashlib.sha256(want.encode()).digest()


VECTORS = "vec_id long, embedding array<float>, label int, tag long, score string, block int"


def brute_negatives(rows):
    own = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in own:
        if i % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in own]
        positives = sorted((s, j) for s, j, z in scores if z == y and j != i)[:5]
        for p, j in positives:
            good = sorted((s, k) for s, k, z in scores if z != y and 30 * -p <= 100 * -s <= 90 * -p)[:10]
            clip = lambda x: max(-(2**63 - 1), min(2**63 - 1, -x))
            out += [(i, j, r, k, clip(p), clip(s)) for r, (s, k) in enumerate(good, 1)]
    return sorted(out)


def vectors(big=False):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(4, 8))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 4] * 0.4 + rng.normal(size=8) * 0.3], int(rng.integers(0, 4))) for i in range(0, 900)]
    rows += [(1000, rows[0][1], 1), (1001, rows[0][1], 1), (1002, rows[0][1], 2), (5, rows[7][1], 1), (200, rows[3][1], 2)]
    rows += [(1100, None, 1), (1200, [1.0] * 8, None), (1300, [1.0, None] + [1.0] * 6, 1), (1400, [float("nan")] + [1.0] * 7, 1), (1500, [float("inf")] * 8, 2), (None, [1.0] * 8, 1), (1600, [], 1), (1700, [0.5], 3)]
    if big:
        rows += [(1800, [3e5] * 8, 1), (1801, [2e5] * 8, 1), (1802, [1e5] * 8, 2)]
    return rows


@pytest.mark.parametrize("big", [False, True])
def test_hard_negatives(spark, monkeypatch, big):
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 3)
    monkeypatch.setattr(negatives, "TILE_ROWS", 64)
    rows = vectors(big)
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], VECTORS).repartition(3)
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, anchor_bytes=256).collect())
    assert got == brute_negatives(rows) and got


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 2, 1, "s", 2)], VECTORS)).count() == 0


def shingles(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    groups = {}
    for x, (i, _) in enumerate(rows):
        groups.setdefault(find(x), []).append(i)
    least = {g: min((i for i in own if i is not None), default=None) for g, own in groups.items()}
    return sorted(((i, len(sets[x]), least[find(x)]) for x, (i, _) in enumerate(rows)), key=str)


def texts():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    out = []
    for base in (9, 10, 11, 12, 20, 40, 60, 100, 300, 900):
        words = [rng.choice(vocabulary) for _ in range(base + 2)]
        for k in range(14):
            own = list(words)
            for _ in range(rng.randrange(0, 2 + base // 40)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            own += [rng.choice(vocabulary) for _ in range(rng.randrange(0, 2 + base // 15))]
            out.append(" ".join(own))
    for k in range(60):  # every text is one edit from a text that is not there
        own = list(words[:120])
        own[2 * k] = f"x{k}"
        out.append(" ".join(own))
    rows = [(i + 1, t) for i, t in enumerate(out)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "a b"), (906, "A  B"), (907, "a b c"), (3, out[40]), (None, out[41]), (None, "alone here now"), (908, out[5].upper()), (909, "same " * 500)]
    return rows


@pytest.mark.parametrize("tile", [1024, 16])
def test_jaccard_components(spark, tile):
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, "n", 2) for i, t in rows], "doc_id long, text string, n long, point string, uid int").repartition(4)
    got = sorted((tuple(r) for r in jaccard.jaccard_components(df, tile=tile).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_pairs_are_all_that_the_bound_allows():
    rng = np.random.default_rng(1)
    centre = rng.poisson(3, size=(5, 32))
    points = np.maximum(0, centre[rng.integers(0, 5, 400)] + rng.integers(-1, 2, size=(400, 32)) * (rng.random((400, 32)) < 0.1))
    sizes = points.sum(axis=1)
    order = np.argsort(sizes, kind="stable")
    points, sizes = points[order], sizes[order]
    got = {(int(q), int(p)) for qs, ps in jaccard.tree_pairs(points, sizes, points, sizes, 9, 10) for q, p in zip(qs, ps)}
    overlap = np.minimum(points[:, None], points[None]).sum(axis=2)
    a, b = np.nonzero((overlap * 19 >= 9 * (sizes[:, None] + sizes)) & (sizes[:, None] * 10 >= 9 * sizes) & (sizes * 10 >= 9 * sizes[:, None]))
    assert got == set(zip(a.tolist(), b.tolist())) and 400 < len(got) < 160_000


def test_similar_sets_share_a_band():
    rng = np.random.default_rng(2)
    for n in (9, 10, 19, 50, 333, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for _ in range(20):
            extra = rng.integers(0, 1 << 63, rng.integers(0, n // 9 + 1)).astype(np.uint64)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - rng.integers(0, n // 18 + 1)]], extra]))
            if not jaccard.similar_sets(a, b, 9, 10):
                continue
            keys = []
            for x in (a, b):
                k, top, beyond = jaccard.size_class(len(x), 9, 10)
                keys.append([set(jaccard.band_keys(x, k + i, jaccard.differing(m, 9, 10) + 1).tolist()) for i, m in enumerate((top, beyond))])
            assert keys[0][0] & keys[1][0] or keys[0][1] & keys[1][0] or keys[0][0] & keys[1][1]
