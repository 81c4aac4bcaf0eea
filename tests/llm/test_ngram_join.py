"""The n-gram join and its signature trees against all pairs on small fixtures."""

import itertools
import re

import numpy as np
import pytest

from lumenar.llm import hot_keys, ngram_join, signature_trees
from lumenar.storage import Scratch
from tests.llm.test_operators import LONG, UPPER, chain_rows, documents, near_rows


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute_groups(sets, percent):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(seed, sizes, copies, most):
    """Texts with few words changed, so that similarities lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for size in sizes:
        base = [f"t{size}x{i}" for i in range(size)]
        for _ in range(copies):
            w = list(base)
            for k in rng.integers(0, size, rng.integers(0, most + 1)):
                w[k] = f"e{rng.integers(10**6)}"
            cut = rng.integers(0, max(1, size // 12) + 1)
            rows.append(" ".join(w[cut:]))
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("percent", "rows"), [(90, near_rows()), (80, near_rows()), (90, chain_rows(100, 120, 4)), (90, edited(1, (11, 13, 20, 29, 30, 64, 150), 14, 3)), (84, edited(2, (12, 19, 28, 44, 300), 14, 9))])
def test_groups_equal_all_pairs(spark, monkeypatch, percent, rows):
    monkeypatch.setattr(ngram_join, "MEMBERS_A_COPY", 4)
    monkeypatch.setattr(signature_trees, "FAN_OUT", 2)
    monkeypatch.setattr(signature_trees, "LEAF_ROWS", 4)
    monkeypatch.setattr(signature_trees, "SMALL_TREE", 6)
    monkeypatch.setattr(hot_keys, "LEAST_HOT", 20)
    monkeypatch.setattr(hot_keys, "HOT_KEYS", 100)
    got = ngram_join.jaccard_groups(documents(spark, rows), percent=percent).toPandas()
    want = brute_groups({i: shingle_set(t, 3) for i, t in rows}, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_groups_of_nulls_repeats_and_nothing(spark):
    a = " ".join(f"w{i}" for i in range(30))
    rows = [(None, a), (4, a), (4, a.upper()), (None, None), (None, ""), (9, " \t"), (8, "one"), (7, "ONE"), (6, LONG), (5, LONG + " more"), (3, None)]
    got = ngram_join.jaccard_groups(documents(spark, rows)).toPandas()
    assert len(got) == len(rows)
    known = got[got.doc_id.notna()]
    assert {int(r.doc_id): int(r.component_id) for r in known.itertuples()} == {4: 4, 9: 9, 8: 7, 7: 7, 6: 5, 5: 5, 3: 3}
    assert sorted(got[got.doc_id.isna()].component_id.fillna(-1)) == [-1, -1, 4]
    assert ngram_join.jaccard_groups(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        ngram_join.jaccard_groups(documents(spark, []), percent=70)


def test_similar_sets_share_a_key():
    """Whatever differs, and wherever sizes fall, two similar sets have a part in common."""
    rng = np.random.default_rng(11)
    for percent in (80, 90, 97):
        for n in [*range(5, 60), 100, 148, 150, 222, 1000, 1500]:
            common = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            most = n * (100 - percent) // percent  # as many further tokens as a similarity of the threshold allows
            for left in {0, most // 2, most}:
                extra = rng.integers(0, 1 << 64, most, dtype=np.uint64)
                a, b = (np.sort(np.concatenate([common, e])) for e in (extra[:left], extra[left:]))
                bounds, keys = ngram_join.part_keys(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), percent)
                same = set(keys[: bounds[1]].tolist()) & set(keys[bounds[1] :].tolist())
                assert same or (len(a) == len(b) == n), (percent, n, left)


def test_sizes_share_a_range_when_they_may_link():
    n = np.arange(0, 3000)
    for percent in (80, 90):
        row, which, _ = ngram_join.ranges_of(n, percent)
        ranges = {}
        for r, w in zip(n[row].tolist(), which.tolist(), strict=True):
            ranges.setdefault(r, set()).add(w)
        for a in range(1, 2400):
            b = 100 * a // percent
            if b > a:
                assert ranges[a] & ranges[b] and ranges[a] & ranges[a + 1], (percent, a)


@pytest.mark.parametrize(("labels", "fan_out", "leaf_rows"), [(2, 8, 64), (40, 2, 4), (200, 8, 3)])
def test_dual_traversal_finds_what_pairs_find(spark, monkeypatch, labels, fan_out, leaf_rows):
    monkeypatch.setattr(signature_trees, "FAN_OUT", fan_out)
    monkeypatch.setattr(signature_trees, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(signature_trees, "SMALL_TREE", 100)
    rng = np.random.default_rng(labels)
    sets, label = {}, {}
    for i in range(260):
        base = np.arange(1000 * (i % 25), 1000 * (i % 25) + 40 + 10 * (i % 3))
        keep = rng.random(len(base)) > 0.06
        sets[i], label[i] = {int(x) * 0x9E3779B97F4A7C15 % (1 << 63) for x in base[keep]}, int(rng.integers(labels))
    members = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in sets.items()], "rep long, n long, shingles array<long>")
    listed = spark.createDataFrame([(i % 2, i, len(sets[i]), label[i]) for i in sets] + [(5, i, len(sets[i]), label[i]) for i in range(100)], "tree long, rep long, n long, label long")
    scratch = Scratch(spark)
    got = [tuple(r) for r in signature_trees.tree_links(listed, members, signature_trees.marks(members), 80, scratch).collect()]
    want = set()
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if label[a] != label[b] and (a % 2 == b % 2 or b < 100) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            want.add((a, b))
    assert want and {tuple(sorted(x)) for x in got} <= want

    def reach(edges):
        up = {i: i for i in sets}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            up[y] = x
        return {i: find(i) for i in sets}

    assert reach(got) == reach(want)
    scratch.clear()


def test_bounds_never_leave_a_link(spark):
    """The bound of a pair of nodes is at least the overlap of any two of their members."""
    rng = np.random.default_rng(4)
    rows = [(i, sorted({int(x) for x in rng.integers(0, 1 << 62, 3000)})) for i in range(6)]
    got = {r["rep"]: (r["bits"], r["excess"]) for r in signature_trees.bitmaps(spark.createDataFrame(rows, "rep long, shingles array<long>")).collect()}
    for i, s in rows:
        bits = {x & (signature_trees.BITS - 1) for x in s}
        assert got[i][1] == len(s) - len(bits) and len(got[i][0]) == 4096
        assert sum(bin(x).count("1") for x in got[i][0]) == len(bits)
    rows = rows[:2] + [(9, rows[0][1][:2000])]
    (a, b), n = (set(rows[0][1]), set(rows[2][1])), signature_trees.BITS - 1
    common = len({x & n for x in a} & {x & n for x in b})
    assert common + min(len(x) - len({y & n for y in x}) for x in (a, b)) >= len(a & b)


def test_marks_never_leave_a_link(spark):
    """What differs in the marks of two sets differs in the sets, at any size."""
    rng = np.random.default_rng(6)
    for n in (3, 200, 511, 513, 900, 5000):
        token = rng.integers(-(1 << 63), 1 << 63, n + n // 10, dtype=np.int64)
        rows = [(1, n, sorted(token[:n].tolist())), (2, n, sorted(token[n // 10 :].tolist()))]
        a, b = signature_trees.marks(spark.createDataFrame(rows, "rep long, n long, shingles array<long>")).orderBy("rep").collect()
        x, y = (np.frombuffer(r["mark"], np.uint64) for r in (a, b))
        differ = int(np.bitwise_count(x ^ y).sum())
        assert differ <= len(set(rows[0][2]) ^ set(rows[1][2])) and (n < 200 or differ > 0)
        assert int(np.bitwise_count(x).sum()) <= n
