"""Centroid clustering and fill-in-the-middle against plain Python on small fixtures."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenar.llm import centroids, fill_in_middle, hot_keys

VECTORS = "vec_id long, embedding array<float>, label int, q string, digest string, weight string, cluster string, distance string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x", "x") for i, v in rows], VECTORS)


def brute_clusters(rows, k, rounds, scale, dim, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    cents = [q for _, q in named[:k]]
    if not cents:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cents)) for _, q in kept]

    for _ in range(rounds):
        homes = assign()
        for j in range(len(cents)):
            mine = [q for (_, q), (_, h) in zip(kept, homes, strict=True) if h == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    homes = assign()
    out = []
    for (i, _), (d, j) in zip(kept, homes, strict=True):
        inertia = sum(e for e, h in homes if h == j)
        out.append((i, j, d, inertia, sum(e for e, _ in homes), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()))
    return sorted(out, key=str)


def got_clusters(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


NAN, INF = float("nan"), float("inf")
ODD = [(1, None), (2, []), (3, [0.5, NAN, 0.1]), (4, [0.5, INF, 0.1]), (5, [0.5, -INF, 0.1]), (6, [0.5, None, 0.1]), (7, [0.5, 0.1]), (8, [0.1, 0.2, 0.3, 0.4])]


@pytest.mark.parametrize("k", [1, 3, 40])
def test_clusters_equal_plain_lloyd(spark, k):
    rng = np.random.default_rng(5)
    points = [(100 + i, [float(np.float32(x)) for x in rng.normal(size=3)]) for i in range(30)]
    # repeated vectors, repeated rows, a null id, ties between equal starts
    rows = ODD + points + [(200 + i, points[i % 3][1]) for i in range(20)] + [points[0], points[0], (None, points[1][1])]
    got = centroids.clustered(vectors(spark, rows), k=k, rounds=3, scale=64, dim=3)
    assert got_clusters(got) == brute_clusters(rows, k, 3, 64, 3, 1)


def test_clusters_of_nothing_and_of_one_vector(spark):
    assert got_clusters(centroids.clustered(vectors(spark, []), dim=3)) == []
    assert got_clusters(centroids.clustered(vectors(spark, ODD), dim=3)) == []
    same = [(i, [0.5, -0.25, 3.0]) for i in range(5)]
    assert got_clusters(centroids.clustered(vectors(spark, same), dim=3)) == brute_clusters(same, 16, 3, 64, 3, 1)


def test_hot_vectors_are_told_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "LEAST_HOT", 5)
    monkeypatch.setattr(hot_keys, "HOT_KEYS", 10)
    rows = [(i, [0.1, 0.2, 0.3]) for i in range(60)] + [(100 + i, [i / 7, -i / 3, 1.0]) for i in range(30)]
    assert got_clusters(centroids.clustered(vectors(spark, rows), k=4, dim=3)) == brute_clusters(rows, 4, 3, 64, 3, 1)


def test_large_components_stay_exact_and_too_large_ones_are_named(spark):
    big = [(i, [float(2**18 + 1024 * i), -float(2**18), float(i)]) for i in range(12)]
    assert got_clusters(centroids.clustered(vectors(spark, big), k=3, dim=3)) == brute_clusters(big, 3, 3, 64, 3, 1)
    with pytest.raises(Exception, match="quantised component"):
        centroids.clustered(vectors(spark, [(1, [1e30, 0.0, 0.0])]), dim=3).collect()


def test_weighted_sums_are_exact():
    q = np.array([[2**24, -(2**24)], [2**24 - 1, 3]], np.int64)
    weight = np.array([2**38, 2**38 + 7], np.int64)
    want = [sum(int(w) * int(x) for w, x in zip(weight, col, strict=True)) for col in q.T]
    assert centroids._weighted_sums(q, weight) == want


# --- fill in the middle ----------------------------------------------------------------

CUTS = "doc_id long, text string, id string, marks string, form string, n string, h1 string, a string, output string"
TEXTS = [
    None, "", "a", "ab", "plain words here", "  \t\n", "\x1e", "\x1d", "\x1dD\x1eE\x1d\x1d\x1e", "x\x1ey\x1dz", "é𝒳 ñandú 日本語 👩‍👩‍👧", "line\r\nline next\u0085",
    "a <P> b", "<S>", "end <M>", "<", "<P", "S>", "<<SS>>", "$1 \\1 ${x}", "\x00nul\x00", "é combined", "word " * 30000, "𝒳" * 5000,
]


def brute_cut(i, text):
    text = text or ""
    n = len(text)
    if i is None:
        return text, "plain", None, None
    h = [int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return text, "plain", None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return f"<S>{suf}<P>{pre}<M>{mid}", "spm", a, b - a
    return f"<P>{pre}<S>{suf}<M>{mid}", "psm", a, b - a


def test_cuts_equal_plain_slices(spark):
    rows = [(k * 100 + j, t) for j, t in enumerate(TEXTS) for k in range(25)] + [(None, "no id"), (7, "again"), (7, "again")]
    frame = spark.createDataFrame([(i, t, *"xxxxxxx") for i, t in rows], CUTS)
    cut = fill_in_middle.fill_in_middle(frame)
    got = cut.withColumn("back", fill_in_middle.restored(F.col("form"), F.col("output"))).collect()
    assert len(got) == len(rows)
    want = sorted(((i, t or "", *brute_cut(i, t)) for i, t in rows), key=str)
    assert sorted(((r["id"], r["text"], r["output"], r["form"], r["prefix_units"], r["middle_units"]) for r in got), key=str) == want
    assert all(r["back"] == r["text"] and r["n"] == len(r["text"]) for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("unit", "pattern"), [("word", r"\S+\s*|\s+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_other_units(spark, unit, pattern):
    import re

    texts = ["one two  three\n four", "\nlead\n\nx", "a\x1eb \x1dc\nd", "only"]
    frame = spark.createDataFrame([(i, t, *"xxxxxxx") for i, t in enumerate(texts * 10)], CUTS)
    for r in fill_in_middle.fill_in_middle(frame, unit=unit, percent=100).collect():
        units = re.findall(pattern, r["text"], re.ASCII)
        assert "".join(units) == r["text"] and r["n"] == len(units)
        pre, mid = "".join(units[: r["prefix_units"]]), "".join(units[r["prefix_units"] : r["prefix_units"] + r["middle_units"]])
        suf = r["text"][len(pre) + len(mid) :]
        assert r["output"] == (f"<P>{pre}<S>{suf}<M>{mid}" if r["form"] == "psm" else f"<S>{suf}<P>{pre}<M>{mid}")


def test_cuts_of_nothing_without_shuffle(spark):
    frame = spark.createDataFrame([], CUTS)
    assert fill_in_middle.fill_in_middle(frame).count() == 0
    assert "Exchange" not in fill_in_middle.fill_in_middle(frame)._jdf.queryExecution().toString()
