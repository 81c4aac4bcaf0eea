"""Small fixtures for every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import gzip
import hashlib
import io
import itertools
import json
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenar.llm import exact_dedup, hot_keys, knn_join, language_id, minhash, nbest, packing, sharding, shingles, tool_calls, toxicity, warc
from lumenar.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i * 7919 % 4001}" for i in range(9000))


def documents(spark, rows):
    """Columns of documents, and ones whose names the operators use inside."""
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    for name in ("digest", "run", "row_no", "keep_id", "bucket", "bit", "rep", "cluster", "part", "shard", "slot", "piece", "bin", "score", "label"):
        frame = frame.selectExpr("*", f"'x' AS {name}")
    return frame


ROWS = [(5, "Same Text here now ok"), (9, "same text HERE now ok"), (9, "same text HERE now ok"), (2, None), (3, ""), (None, "lonely"), (7, "ÄB"), (8, "äB"), (11, LONG), (12, LONG + " end"), (13, "  \t\n"), (14, "one two")]


# --- exact dedup -----------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup_matches_brute_force(spark, keep):
    got = exact_dedup.dedup_report(documents(spark, ROWS), keep=keep, fan_in=2).toPandas()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    for r in got.itertuples():
        (text,) = [t for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        ids = [i for i in groups[text] if i is not None]
        assert r.group_size == len(groups[text])
        if ids:
            assert r.keep_id == (max if keep == "largest" else min)(ids)
    assert got.groupby("text_sha256").kept.sum().eq(1).all()


def test_exact_dedup_regroups_colliding_digests(spark):
    docs = documents(spark, [(1, "a"), (2, "b"), (3, "a")])
    digests = exact_dedup._digests(docs, "doc_id", "text")
    index = exact_dedup.build_index(digests)
    rows = digests.select("doc_id", "row_no", "digest").join(index.selectExpr("digest", "last AS keeper", "copies"), "digest")
    got = exact_dedup._regrouped(docs, rows, digests.select("digest").distinct(), "doc_id", "text", True).toPandas()
    assert dict(zip(got.doc_id, got.keep_id, strict=True)) == {1: 3, 2: 2, 3: 3}


def test_exact_dedup_when_every_digest_collides(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: exact_dedup.F.lit("ab" * 32))
    got = exact_dedup.dedup_report(documents(spark, [(1, "a"), (2, "b"), (3, "A"), (4, None)]), keep="largest").toPandas()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got.itertuples()} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_large_groups_are_verified_in_salts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_A_SALT", 3)
    got = exact_dedup.dedup_report(documents(spark, [(i, "Copy") for i in range(40)] + [(99, "other")])).toPandas()
    assert got.kept.sum() == 2 and set(got.group_size) == {40, 1}


def test_exact_dedup_lookup_and_drop(spark):
    docs = documents(spark, ROWS)
    index = exact_dedup.build_index(exact_dedup._digests(docs, "doc_id", "text"))
    digest = hashlib.sha256(b"same text here now ok").digest()
    assert exact_dedup.lookup(index, digest).first()["copies"] == 3
    kept = exact_dedup.drop_copies(docs, keep="largest")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 7, 8, 9, 11, 12, 13, 14]


def test_drop_copies_carries_columns_named_like_its_own(spark):
    docs = documents(spark, [*ROWS, (None, "lonely"), (21, "far")]).selectExpr("*", "'a' AS _id", "'b' AS _sha_of", "'c' AS _key", "'d' AS _row", "doc_id AS _rows", "'e' AS _kept", "'f' AS _maybe", "'g' AS _slot", "'h' AS _bucket")
    kept = exact_dedup.drop_copies(docs, keep="largest")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 3, 7, 8, 9, 11, 12, 13, 14, 21]
    assert all(r["_id"] == "a" and r["_sha_of"] == "b" and r["_key"] == "c" and r["_rows"] == r["doc_id"] for r in rows)


def test_hot_digests_without_broadcast_joins(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "LEAST_HOT", 10)
    monkeypatch.setattr(hot_keys, "HOT_KEYS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, "Copy") for i in range(100)] + [(200 + i, f"other {i}") for i in range(198)] + [(None, "Copy"), (7, "copy")]
        got = exact_dedup.dedup_report(documents(spark, rows)).toPandas()
        assert len(got) == 300 and got.kept.sum() == 199 and (got.group_size == 102).sum() == 102
        kept = exact_dedup.drop_copies(documents(spark, rows))
        assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(200, 398)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.dedup_report(documents(spark, [])).count() == 0


# --- near dedup ------------------------------------------------------------------------


def brute_components(rows, words):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    base = [list(rng.choice(words, n)) for n in (30, 80, 200, 6, 3)]
    passage, rows = list(rng.choice(words, 40)), []
    for b in base:
        for _ in range(40):
            w = list(b)
            for k in rng.integers(0, len(w), rng.integers(0, 3)):
                w[k] = str(rng.choice(words))
            rows.append(" ".join(w))
    rows += [" ".join([*rng.choice(words, 25), *passage, *rng.choice(words, 10)]) for _ in range(60)]
    rows += ["", None, " \t", "one", "ONE", LONG, LONG + " more"]
    return [(1000 - i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_match_brute_force(spark, words, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)  # many blocks
    monkeypatch.setattr(minhash, "MEMBERS_A_COPY", 4)
    monkeypatch.setattr(hot_keys, "LEAST_HOT", 20)
    monkeypatch.setattr(hot_keys, "HOT_KEYS", 100)
    rows = near_rows()
    got = minhash.near_duplicates(documents(spark, rows), words=words).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == brute_components(rows, words)
    assert (got.kept == (got.doc_id == got.component_id)).all()


def chain_rows(n=150, length=120, step=6):
    """Each text is like its neighbours and unlike those farther off: one long chain, few links a document."""
    rng = np.random.default_rng(8)
    words = [f"c{i}" for i in rng.integers(0, 10**6, length + step * n)]
    return [(int(i), " ".join(words[step * j : step * j + length])) for j, i in enumerate(rng.permutation(n))]


def test_near_duplicates_of_a_chain(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    monkeypatch.setattr(minhash, "MEMBERS_A_COPY", 2)
    weak = [(1000 + i, t + " tail" * 90 + f" end{i}") for i, t in chain_rows(60, 120, 30)]  # share values, similar to none
    rows = chain_rows() + weak + [(2000 + i, t.replace("1", "x", 1)) for i, t in chain_rows()[:40]]
    got = minhash.near_duplicates(documents(spark, rows), words=5).toPandas()
    want = brute_components(rows, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert max(Counter(c for _, c in want.values()).values()) >= 150


def test_near_duplicates_of_nulls_and_nothing(spark):
    got = minhash.near_duplicates(documents(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)])).toPandas()
    assert sorted(got.component_id.fillna(-1)) == [-1, 4, 4, 4]
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    docs = documents(spark, [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (None, "x")])
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3]
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, percent=70)


def test_shingle_slices_agree_with_whole(spark):
    texts = ["Ab c d e", "", "ab C d e f", "x", "é é é é é"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    row, value = shingles.shingle_sets(np.frombuffer(data, np.uint8), offsets, 4)
    assert np.bincount(row, minlength=5).tolist() == [1, 0, 2, 1, 1]
    assert value[row == 0][0] in value[row == 2]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 150)] + [(7, 7), (1, 0)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 150), 100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_keys_join_like_any_other(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "LEAST_HOT", 10)
    edges = [(500, i) for i in range(501, 600)] + [(i, 700) for i in range(601, 660)] + [(599, 601)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys([*range(500, 600), *range(601, 660), 700], 500)
    rows = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 1), ("c", 2), (None, 3)], "k string, x long")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("top")).where("k is null or k <> 'c'")
    got = hot_keys.join_facts(rows, facts, "k", "n", 43)
    assert got.columns == ["k", "x", "n", "top"]
    assert sorted(map(tuple, got.collect())) == sorted([("a", i, 40, 39) for i in range(40)] + [("b", 1, 1, 1)])
    known = [("a", i, 39) for i in range(40)] + [("b", 1, 1)]
    assert sorted(map(tuple, hot_keys.look_up(rows, facts.drop("n"), "k", 43).collect())) == sorted(known)
    left = hot_keys.look_up(rows, facts.drop("n"), "k", 43, "left")
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [*known, ("c", 2, None), (None, 3, None)]))


def test_likely_first_holds_the_smallest_hashes(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    some = ids.where(hot_keys.likely_first(F.col("doc_id"), 400, F.lit(20000)))
    best = {r[0] for r in ids.orderBy(F.xxhash64("doc_id")).limit(400).collect()}
    assert best <= {r[0] for r in some.collect()} and 600 < some.count() < 1000
    assert ids.limit(700).where(hot_keys.likely_first(F.col("doc_id"), 400, F.lit(700))).count() == 700


# --- packing ---------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = [(1, "a b"), (6, "<|endoftext|>"), (7, "a <|endoftext|> b<|endoftext|><|endoftext|>\n\n c  <|endoftext|>"), (8, "<|endoftext <|endoftext|>|>"), (2, None), (3, LONG), (4, ""), (5, "<|endoftext|> ünï 漢字  x  y"), *[(10 + i, f"text {i} " * (i % 90)) for i in range(300)]]
    got = packing.pack_documents(documents(spark, rows)).toPandas()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.start.tolist() == np.cumsum([0, *mine.length])[:-1].tolist() and mine.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
        assert (mine.length.iloc[1:] == 2048).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() <= 2048
    assert got.sequence_id.nunique() == packing.lower_bound(got.length.to_numpy(), 2048)
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_rounds_end_with_partitions_of_bounded_size(spark):
    rng = np.random.default_rng(2)
    pieces = pd.DataFrame({"doc_id": range(640), "row": range(640), "piece": 0, "length": rng.integers(300, 1500, 640)})
    got = packing.pack(spark.createDataFrame(pieces, "doc_id long, row long, piece int, length long"), 2048, pieces_a_partition=20).toPandas()
    assert len(got) == 640 and got.groupby("sequence_id").length.sum().max() <= 2048
    part = got.sequence_id.to_numpy() >> 28
    assert np.unique(part, return_counts=True)[1].max() <= 60 and len(np.unique(part)) > 10
    _, _, whole = packing.best_fit(np.sort(pieces.length.to_numpy())[::-1], 2048)
    assert got.sequence_id.nunique() <= 1.1 * len(whole)


def test_repeated_and_null_ids_are_packed_each(spark):
    rows = [(1, "same words"), (1, "same words"), (1, "other"), (None, "x"), (None, None)]
    got = packing.pack_documents(documents(spark, rows), capacity=3).toPandas()
    assert "row" not in got.columns and (got.start == 0).sum() == 5 and got.doc_id.isna().sum() == 2
    assert got.groupby("sequence_id").length.sum().max() <= 3 and got.groupby("sequence_id").offset.nunique().eq(got.groupby("sequence_id").size()).all()


@pytest.mark.parametrize("blank", [" ", "\n", " \u3000"])
def test_texts_with_long_blank_runs_are_encoded_whole(spark, blank):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    text = "some words" + blank * 1_200_000 + "x <|endoftext|>"
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
    got = packing.token_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), packing.vocabulary_path()).toPandas()
    assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(got.start, got.length, strict=True)] == got.ids_crc32.tolist()
    assert got.length.sum() == len(ids)


def test_partitions_exchange_until_certified(spark):
    rng = np.random.default_rng(1)
    pieces = pd.DataFrame({"doc_id": range(600), "row": range(600), "piece": 0, "length": rng.integers(300, 1500, 600)})
    got = packing.pack(spark.createDataFrame(pieces, "doc_id long, row long, piece int, length long"), 2048, pieces_a_partition=100).toPandas()
    assert len(got) == 600 and got.doc_id.is_unique
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    _, _, whole = packing.best_fit(np.sort(pieces.length.to_numpy())[::-1], 2048)
    assert got.sequence_id.nunique() <= 1.03 * len(whole)


def test_bounds_are_bounds():
    assert packing.lower_bound(np.array([1100] * 7), 2048) == 7
    assert packing.lower_bound(np.array([700] * 6), 2048) == 3
    assert packing.lower_bound(np.array([], int), 2048) == 0
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = np.sort(rng.integers(1, 2049, 40))[::-1]
        at, offset, fill = packing.best_fit(lengths, 2048)
        assert fill.max() <= 2048 and packing.lower_bound(lengths, 2048) <= len(fill)


# --- warc ------------------------------------------------------------------------------


def test_pages_to_warc_and_back(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello\nhttp://x 0.0.0.0 20200101000000 text/html 3\n"
    rows = [(3, "http://a b/ü", "same"), (1, None, "same"), (2, "u", None), (7, "u", ""), (9, "u", tricky), (None, "u", "same"), (8, "u", "é" * 70000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.convert_pages(pages).toPandas()
    by = {r.page_id: r for r in got.dropna(subset=["page_id"]).itertuples()}
    for i, _, html in rows:
        if i is not None:
            body = (html or "").encode()
            assert by[i].payload_bytes == len(body) and by[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert by[1].record_type == "response" and by[3].record_type == "revisit" and by[3].refers_to == 1
    assert by[2].record_type == "response" and by[7].refers_to == 2 and len(got) == len(rows)
    assert warc.convert_pages(pages, least_bytes=1).where("record_type = 'revisit'").count() == 2
    assert warc.convert_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = warc.arc_version_block(version, "f.arc") + b"\n" + warc.arc_record(version, "f.arc", "http://x/", 4, b"body\nhttp://y") + b"\n"
    ((offset, fields, message),) = list(warc.parse_arc(warc._open(gzip.compress(data))))
    assert fields["URL"] == "http://x/" and len(fields) == (5 if version == 1 else 10) and data[offset:].startswith(b"http://x/")
    assert warc._payload(message)[1] == b"body\nhttp://y"
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(data[:-8])))
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(data.replace(f"\n{version} 0 ".encode(), b"\n9 0 "))))


def test_records_that_are_no_http_messages(spark, tmp_path):
    """A version block, a DNS record twice, a bare-LF head and an HTTP message without a body."""
    dns = b"20240101000000\nexample.org. 3600 IN A 192.0.2.1\n"
    bare = b"HTTP/1.0 200 OK\nContent-Length: 4\nX-Page-Id: 7\n\nbody"
    none = b"HTTP/1.1 204 No Content\r\nX-Page-Id: 8"
    parts = [("dns:example.org", "192.0.2.1", "text/dns", dns), ("dns:example.org", "192.0.2.1", "text/dns", dns), ("http://x/", "192.0.2.9", "text/html", bare), ("http://y/", "0.0.0.0", "no-type", none)]
    data = warc.arc_version_block(1, "f.arc") + b"\n" + b"".join(f"{u} {ip} 20240101000000 {t} {len(m)}\n".encode() + m + b"\n" for u, ip, t, m in parts)
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "f.arc").write_bytes(data)
    warc.write_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = warc.read_warc(spark, str(tmp_path / "warc")).toPandas().sort_values(["record_type", "page_id"]).reset_index()
    assert got.record_type.tolist() == ["resource", "response", "response", "revisit"]
    assert got.payload_bytes.fillna(-1).tolist() == [len(dns), 4, 0, -1] and got.refers_to_id[3] == got.record_id[0]
    assert got.payload_digest[0] == base64.b32encode(hashlib.sha1(dns).digest()).decode()
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("*.gz"))
    assert text.count(b"WARC-Type: warcinfo") == 1 and text.count(b"WARC-IP-Address: 192.0.2.1\r\n") == 2 and b"Content-Type: text/dns" in text


def test_a_hot_payload_does_not_meet_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "LEAST_HOT", 10)
    monkeypatch.setattr(hot_keys, "HOT_KEYS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, "u", "same" if i % 3 == 0 else f"page {i}") for i in range(300)] + [(5, "u", "page 5")]
        got = warc.convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS path", "'y' AS digest")).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 301 and (got.record_type == "revisit").sum() == 100 and set(got.refers_to.dropna()) == {0, 5}


# --- tool calls ------------------------------------------------------------------------


def test_tool_calls_are_linked_ordered_and_checked(spark):
    schemas = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "number"}, "b": {"type": ["string", "null"]}, "c": {"type": "array", "items": {"type": "integer"}}}, "additionalProperties": False}}
    calls = [
        (1, 0, "p", "add", '{"b": null, "a": {"$ref": "q"}}'), (1, 2, "q", "add", '{"a": {"$ref": "r"}}'), (1, 4, "r", "add", '{"a": 1.5, "c": [1, "x"]}'), (1, 5, "u", "add", '{"a": {"$ref": "v"}}'),
        (1, 6, "v", "add", '{"a": {"$ref": "u"}}'), (1, 7, None, "add", "no json"), (1, 8, "w", "none", "{}"), (1, 9, "x", "add", '{"z": 1}'), (2, 0, "p", "add", None),
    ]
    results = [(1, 3, "p", "done é\n"), (1, 5, "p", None), (1, 9, "gone", "x"), (None, 1, "p", "x")]
    got = tool_calls.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string"), spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), schemas).toPandas()
    c = {(r.conv_id, r.call_id): r for r in got[got.kind == "call"].itertuples()}
    assert [c[1, k].level for k in "rqp"] == [0, 1, 2] and np.isnan(c[1, "u"].level) and np.isnan(c[1, "v"].level)
    assert c[1, "p"].linked and c[1, "p"].other_turn == 3 and not c[1, "q"].linked and not c[2, "p"].linked
    assert c[1, "p"].valid and list(c[1, "r"].errors) == ["$.c[1]: not integer"] and list(c[1, "x"].errors) == ["$.a: missing", "$.z: not known"]
    assert list(c[2, "p"].errors) == ["not an object"] and list(c[1, "w"].errors) == ["no schema for none"]
    assert c[1, "p"].canonical == '{"arguments":{"a":{"$ref":"q"},"b":null},"id":"p","name":"add","type":"call"}'
    r = got[got.kind == "result"]
    assert len(got) == len(calls) + len(results) and r.linked.sum() == 2 and '{"content":"done é\\n","id":"p","type":"result"}' in set(r.canonical)


CALLS, RESULTS = "conv_id long, turn long, call_id string, name string, arguments string", "conv_id long, turn long, call_id string, content string"


def brute_levels(edges, nodes):
    refs = {n: {b for a, b in edges if a == n and b in nodes} for n in nodes}
    level = {}
    while fresh := {n: max((level[r] + 1 for r in refs[n]), default=0) for n in nodes if n not in level and all(r in level for r in refs[n])}:
        level.update(fresh)
    return level


def test_levels_of_chains_branches_and_cycles(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "LEAST_HOT", 5)
    monkeypatch.setattr(hot_keys, "HOT_KEYS", 20)
    edges = [(i, i - 1) for i in range(1, 41)] + [(50, 40), (50, 7), (51, 50), (52, 51), (52, 50), (53, 52)]  # a chain, calls with two references behind it
    edges += [(60, 61), (61, 62), (62, 60), (63, 60), (64, 63), (64, 1), (65, 64)]  # a cycle and what lies behind it
    edges += [(100 + i, 40) for i in range(50)] + [(200, 100 + i) for i in range(50)] + [(300, 999)] + [(400, 400)]  # a hot target, a call of many references
    nodes = {a for a, _ in edges} | {b for _, b in edges} - {999}
    calls = [(1, a, str(a), "f", json.dumps({"x": [{"$ref": str(b)} for x, b in edges if x == a]})) for a in sorted(nodes)]
    got = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), {"f": {}}).toPandas()
    want = brute_levels(edges, nodes)
    assert {int(i): int(v) for i, v in zip(got.call_id, got.level, strict=True) if v == v} == want and len(want) < len(nodes)


def test_odd_arguments_are_kept_and_named(spark):
    deep = '{"a": ' + "[" * 100_000 + "]" * 100_000 + "}"
    rather = '{"a": ' + "[" * 500 + "]" * 500 + "}"
    calls = [(1, 0, "d", "f", deep), (1, 1, "s", "f", '{"a": "\\ud800", "\\ud801": 1, "r": {"$ref": "\\ud802"}}'), (1, 2, "n", "f", '{"a": NaN}'), (1, 3, "e", "f", '{"a": 1e999}'), (1, 4, "r", "f", rather), (1, 5, "t", "f", '"text"'), (None, 6, "d", "f", "{}"), (1, 7, "l", "f", json.dumps({"a": LONG}))]
    got = tool_calls.link(spark.createDataFrame(calls, CALLS).selectExpr("*", "'x' AS key", "1 AS level"), spark.createDataFrame([(1, 9, "l", LONG), (1, 9, "l", LONG)], RESULTS).selectExpr("*", "'x' AS key"), {"f": {"additionalProperties": True}}).toPandas()
    by = {r.turn: r for r in got[got.kind == "call"].itertuples()}
    assert len(got) == len(calls) + 2
    assert list(by[0].errors) == ["nested too deeply"] == list(by[4].errors) and json.loads(by[0].canonical)["arguments"] == deep
    assert by[1].valid and json.loads(by[1].canonical)["arguments"]["a"] == "\ud800"
    assert [list(by[i].errors) for i in (2, 3, 5)] == [["not an object"]] * 3 and json.loads(by[2].canonical)["arguments"] == '{"a": NaN}'
    assert not by[6].linked and by[6].level == 0 and json.loads(by[7].canonical)["arguments"]["a"] == LONG and by[7].other_turn == 9


def test_hot_identifiers_are_linked(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "LEAST_HOT", 10)
    monkeypatch.setattr(hot_keys, "HOT_KEYS", 5)
    calls = [(1, i, "hot" if i < 60 else f"c{i}", "f", "{}") for i in range(120)] + [(2, i, None, "f", "{}") for i in range(60)]
    results = [(1, 500 + i, "hot", "x") for i in range(60)] + [(1, 700 + i, None, "x") for i in range(60)] + [(1, 900, "c70", "y")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), {"f": {}}).toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 180 + 121 and got.linked.sum() == 60 + 60 + 2 and set(got[(got.kind == "call") & (got.call_id == "hot")].other_turn) == {500}


def test_turns_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tool_calls.link(*tool_calls.calls_of_turns(empty), tool_calls.TURN_SCHEMAS).count() == 0


# --- sharding --------------------------------------------------------------------------


def test_shards_are_contiguous_and_even(spark):
    rows = [(i % 400, "x" * (i * 37 % 90)) for i in range(1000)] + [(7, "hot")] * 500 + [(None, None), (3, LONG)]
    got = sharding.byte_shards(documents(spark, rows).repartition(5), 8).toPandas()
    assert len(got) == len(rows)
    assert Counter((r.size, r.text_crc32) for r in got.itertuples()) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    ordered = got.assign(k=got.doc_id.fillna(-1)).sort_values(["shard", "slot"])
    assert ordered.k.is_monotonic_increasing
    assert all(g.slot.tolist() == list(range(len(g))) for _, g in ordered.groupby("shard"))
    size = got.groupby("shard")["size"].sum()
    assert (abs(size - got["size"].sum() / 8) <= got["size"].max()).all()
    assert sharding.byte_shards(documents(spark, [])).count() == 0


# --- knn -------------------------------------------------------------------------------


def test_knn_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "BLOCK_ROWS", 20)
    monkeypatch.setattr(knn_join, "CHUNK_QUERIES", 3)
    monkeypatch.setattr(knn_join, "TILE", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 3)], 0) for i in range(300)]
    rows += [(300, None, 0), (350, [None, 1.0], 0), (301, [float("nan")] * 6, 0), (400, [1.0], 0), (401, [], 0), (None, [1.0] * 6, 0), (5, rows[5][1], 0), (50, rows[50][1], 0), (100, [1.0, 2.0], 0), *[(500 + i, [0.5] * 6, 0) for i in range(40)]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").selectExpr("*", "'x' AS cell", "'y' AS row", "'z' AS g", "'w' AS block")
    got = knn_join.knn_join(frame, "vec_id % 50 = 0", pivots=8).toPandas()
    fine = [(i, tuple(np.floor(256 * x) for x in v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (i, v) in enumerate(fine):
        if i % 50 == 0:
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=False)), j) for m, (j, w) in enumerate(fine) if m != n)[:5]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(want)
    assert knn_join.knn_join(frame.limit(0), "vec_id % 50 = 0").count() == 0
    assert knn_join.knn_join(frame.where("vec_id % 50 <> 0"), "vec_id % 50 = 0").count() == 0
    one = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0])], "vec_id long, embedding array<double>")
    assert knn_join.knn_join(one, "vec_id % 50 = 0").first()["score"] == 2**63 - 1
    huge = spark.createDataFrame([(0, [1e308, 0.0]), (1, [1e308, 0.0]), (2, [-1.7e308, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in knn_join.knn_join(huge, "vec_id % 50 = 0").orderBy("rank").collect()] == [(1, 2**63 - 1), (3, 0), (2, 1 - 2**63)]


def test_vectors_go_where_bounds_reach_only(spark):
    rng = np.random.default_rng(6)
    centres = np.eye(4) * 100
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(size=4)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    keep = knn_join.written
    knn_join.written = lambda df, name, **o: seen.append((name, out := keep(df, name, **o))) or out
    try:
        got = knn_join.knn_join(frame, "vec_id % 50 = 0", pivots=16).toPandas()
    finally:
        knn_join.written = keep
    copies = dict(seen)["reaching"].selectExpr("sum(size(reached)) AS n").first()["n"]
    groups = dict(seen)["cells"].where("vec_id % 50 = 0").select("cell").distinct().count()
    assert (got.vec_id % 4 == got.query_id % 4).all() and len(got) == 40 and copies < 0.6 * 400 * groups


# --- n-best ----------------------------------------------------------------------------


def copied_paths(lattice, word, n):
    """The same search with whole paths in its heap: their order is that of equal scores."""
    import heapq

    into = lattice._edges(word)
    forward = lattice._forward(into)
    heap, found = [(-forward[-1], (), len(word), 0.0)], []
    while heap and len(found) < n:
        _, path, at, behind = heapq.heappop(heap)
        if at == 0:
            found.append((behind, tuple(x for ids in reversed(path) for x in ids)))
            continue
        for start, ident, s in into[at]:
            heapq.heappush(heap, (-(forward[start] + s + behind), (*path, lattice._spelled(word, start, ident)), start, behind + s))
    return found


def test_nbest_search_without_copied_paths():
    lattice, _ = nbest._loaded(nbest.model_path())
    rng = np.random.default_rng(17)
    for letters in ("a", "ab", "aé日x", "etaoinshr", "abcdefghijklmnopqrstuvwxyz"):
        for _ in range(120):
            word = "".join(rng.choice(list(letters), rng.integers(1, 40)))
            n = int(rng.integers(1, 8))
            assert lattice.search(word, n) == copied_paths(lattice, word, n)


@pytest.mark.parametrize("letters", ["a", "abcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_nbest_of_a_word_without_end(letters):
    """A blob of 60,000 letters in a text: no copied paths, and the paths of its halves where they part."""
    lattice, decoding = nbest._loaded(nbest.model_path())
    rng = np.random.default_rng(18)
    text = "some words " + "".join(rng.choice(list(letters), 60_000)) + " and more"
    got = nbest.encode_nbest(lattice, text)
    assert len(got) == 4 and [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)
    assert len({tuple(i) for _, i in got}) == 4 and all(nbest.decode(decoding, i) == text for _, i in got)
    into = lattice._edges(nbest.MARK + text.split(" ")[2])
    words = [nbest.MARK + w for w in text.split(" ")]
    plain = sum(lattice._forward(lattice._edges(w))[-1] for w in words)
    assert got[0][0] == plain and len(into) == 60_002


def test_nbest_matches_enumeration():
    lattice, decoding = nbest._loaded(nbest.model_path())

    def every(word):
        into, out = lattice._edges(word), []

        def go(at, ids, score):
            if at == 0:
                out.append((score, ids))
            for start, ident, s in into[at]:
                go(start, lattice._spelled(word, start, ident) + ids, score + s)

        go(len(word), (), 0.0)
        return out

    for text in ("", "a", "of the x", "two  blanks", "ab\ncd ☃ é", " lead"):
        words = nbest._WORDS.findall(nbest.MARK + text.replace(" ", nbest.MARK)) if text else []
        totals = sorted((sum(s for s, _ in p) for p in itertools.product(*map(every, words))), reverse=True)[:4]
        got = nbest.encode_nbest(lattice, text)
        assert [s for s, _ in got] == totals
        assert len({tuple(i) for _, i in got}) == len(got) and all(nbest.decode(decoding, i) == text for _, i in got)


def test_new_words_go_through_one_pass(monkeypatch):
    """Words alone or together have the same paths; texts of new words search none of them alone."""
    lattice, _ = nbest._loaded(nbest.model_path())
    rng = np.random.default_rng(19)
    words = {""}
    for letters in ("a", "ab", "aé日x", "etaoinshr▁", "abcdefghijklmnopqrstuvwxyz", "\ud800☃é\n𝄞aэ日"):
        words |= {"".join(rng.choice(list(letters), rng.integers(1, nbest.CACHED_LETTERS + 1))) for _ in range(400)}
    alone = {word: lattice._best(word) for word in words}
    assert dict(lattice._best_at_once(list(words))) == alone

    fresh = nbest.Lattice(lattice.pieces, lattice.byte_ids)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    texts = [" ".join("".join(rng.choice(letters, 9)) for _ in range(400)) for _ in range(5)] + ["", "x" * 300]
    want, calls = [nbest.Lattice(lattice.pieces, lattice.byte_ids).segment(text, 4) for text in texts], []
    monkeypatch.setattr(fresh, "_best", lambda word: calls.append(word) or lattice._best(word))
    assert list(fresh.segment_all(texts, 4)) == want
    assert calls == [nbest.MARK + "x" * 300]


def test_cache_that_turns_over_gives_the_same_paths(monkeypatch):
    monkeypatch.setattr(nbest, "CACHED_WORDS", 700)
    lattice, _ = nbest._loaded(nbest.model_path())
    small = nbest.Lattice(lattice.pieces, lattice.byte_ids)
    rng = np.random.default_rng(20)
    texts = [" ".join("".join(rng.choice(list("abcde"), rng.integers(1, 7))) for _ in range(300)) for _ in range(20)]
    want = [nbest.encode_nbest(lattice, text) for text in texts]
    got = [out for first in (0, 10) for out in small.segment_all(texts[first : first + 10], 4)]
    assert [(scores, [np.frombuffer(ids, np.uint32).tolist() for ids in paths]) for scores, paths in got] == [([s for s, _ in w], [i for _, i in w]) for w in want]


def test_segmentations_of_rows(spark):
    got = {r["doc_id"]: r for r in nbest.segmentations(documents(spark, [(1, None), (2, ""), (3, "plain words"), (4, "▁"), (5, LONG)])).collect()}
    assert got[1]["scores"] == [0.0] == got[2]["scores"] and got[1]["n_pieces"] == 0 and got[3]["round_trip"] and not got[4]["round_trip"] and got[5]["round_trip"]
    assert len(got[3]["scores"]) == 4 and got[3]["scores"] == sorted(got[3]["scores"], reverse=True)
    assert nbest.segmentations(documents(spark, [])).count() == 0


def test_ids_of_every_path_leave_the_operator(spark):
    lattice, decoding = nbest._loaded(nbest.model_path())
    rows = [(1, None), (2, ""), (3, "plain words"), (4, "ab\ncd ☃ é"), (5, LONG), (5, "a"), (None, "two  blanks")]
    want = sorted((i or 0, rank, s, ids, nbest.decode(decoding, ids)) for i, t in rows for rank, (s, ids) in enumerate(nbest.encode_nbest(lattice, t or ""), 1))
    got = sorted((r["doc_id"] or 0, r["rank"], r["score"], r["ids"], r["decoded"]) for r in nbest.encoded(documents(spark, rows)).collect())
    assert got == want and {r[1] for r in got} == {1, 2, 3, 4}
    wide = [r for r in nbest.segmentations(documents(spark, rows)).collect()]
    assert sorted((r["doc_id"] or 0, k, s, ids) for r in wide for k, (s, ids) in enumerate(zip(r["scores"], r["ids"], strict=True), 1)) == [r[:4] for r in want]
    assert all(zlib.crc32(np.array(r["ids"][0], "<u4").tobytes()) == r["ids_crc32"] for r in wide)
    assert nbest.encoded(documents(spark, [])).count() == 0


# --- classifiers -----------------------------------------------------------------------


def plain_toxicity(model, text):
    """The score of a text word by word in plain Python, from the model's weights."""
    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    none = 1.0
    for sentence in re.split(rb"[.!?\n]", (text or "").encode()):
        words = set()
        for w in re.findall(rb"[A-Za-z\x80-\xff]+", sentence):
            data, offsets = np.frombuffer(w, np.uint8), np.array([0, len(w)])
            words |= set(shingles.hashed_words(data, offsets, toxicity._OUTSIDE, toxicity.PREFIXES)[2].tolist())
        if words:
            none *= 1 - 1 / (1 + np.exp(-(model.bias + sum(weights.get(x, 0.0) for x in words))))
    return 1 - none


def test_toxicity_scores_equal_a_plain_version(spark):
    rng = np.random.default_rng(9)
    rows = [(i, sample_text(rng, 5).replace("tree", "vile" if i % 3 == 0 else "tree")) for i in range(120)] + [(500, None), (501, ""), (502, "!?. 12"), (503, "Über vile. Tree!\nvile vile"), (503, LONG), (None, "vile")]
    docs = documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int"))
    got = sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.scores(docs, model).collect())
    want = sorted((i or -1, plain_toxicity(model, t)) for i, t in rows)
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-9) and [i for i, _ in got] == [i for i, _ in want]


def plain_language(model, text):
    """(language, family margins, pair votes) of a text gram by gram in plain Python."""
    data = (text or "").encode()
    if not any(c.isalpha() for c in text or ""):
        return "und"
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            gram = int.from_bytes(low[i : i + n], "big")
            counts[((gram + n) * 2654435761 & 0xFFFFFFFF) >> (32 - 12)] += 1
    norm = np.sqrt(sum(counts.values()))
    score = lambda w: sum(np.sqrt(c) * w[s] for s, c in counts.items()) / norm + w[-1]
    family = 0 if model.family_w is None else int(np.argmax([score(model.family_w[:, f]) for f in range(len(model.families))]))
    votes = dict.fromkeys(model.families[family], 0.0)
    for k, (a, b) in enumerate(model.pairs):
        if a in votes and b in votes:
            m = score(model.pair_w[:, k])
            votes[a if m >= 0 else b] += 1
            votes[a] += 1e-3 * np.tanh(m)
            votes[b] -= 1e-3 * np.tanh(m)
    return model.languages[max(votes, key=lambda i: (votes[i], -i))]


def test_languages_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "12 !", "en"), (-4, "x", None), (-4, "der und", None), (None, "le et", None)], docs.schema)
    model = language_id.train(docs)
    both = docs.where("doc_id < 60").unionByName(odd)
    want = sorted((str(r["doc_id"]), plain_language(model, r["text"])) for r in both.collect())
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in language_id.predict(both, model).collect()) == want


def test_short_texts_are_taken_few_at_a_time(monkeypatch):
    seen, keep = [], language_id.features
    monkeypatch.setattr(language_id, "features", lambda data, offsets, *a: seen.append(len(offsets) - 1) or keep(data, offsets, *a))
    model = language_id.fit(np.eye(4096, dtype=np.float32)[:8], np.array(["en", "de"] * 4))
    names, _ = language_id._languages(model, pa.array(["ab"] * 2000))
    assert len(names) == 2000 and max(seen) <= language_id.SLICE_ROWS


def test_an_id_is_learned_from_once(spark):
    from lumenar.llm.training import one_row_an_id

    rows = spark.createDataFrame([(1, "a")] * 50 + [(1, "b"), (2, "c"), (2, "c")], "doc_id long, text string")
    got = one_row_an_id(rows, "text").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2] == sorted({r["doc_id"] for r in got}) and one_row_an_id(rows.limit(0), "text").count() == 0


def sample_text(rng, n=12):
    return ". ".join(" ".join(rng.choice(["red", "blue", "green", "tree", "house", "water", "stone"], 6)) for _ in range(n)) + "."


def test_toxicity_learns_and_locates(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        text = sample_text(rng)
        if i % 4 == 0:
            text = text.replace(".", f". you Vilest{'abc'[i % 3]} thing.", 1)
        rows.append((i, text))
        labels.append((i, 1, int(i % 4 == 0)))
    labels += [(1, 1, None), (None, 1, 1)]
    docs = documents(spark, [*rows, (900, None), (901, ""), (902, "you vilestz thing. " + LONG)])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.scores(docs, model).collect()}
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in range(400)) and got[902]["predicted"] == 1
    assert got[900]["score"] == 0 == got[901]["score"] and got[900]["worst_sentence"] is None
    assert all(0 <= r["score"] <= 1 for r in got.values())
    spans = toxicity.offending_sentences(docs.where("doc_id < 400"), model).toPandas()
    assert set(spans.doc_id) == set(range(0, 400, 4)) and spans.text.str.lower().str.contains("vilest").all()
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and 900 in {r["doc_id"] for r in kept.collect()}


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a b c"), (2, None)])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r["score"] < 0.01 for r in toxicity.scores(docs, model).collect())
    assert toxicity.scores(documents(spark, []), model).count() == 0


def test_language_families_and_pairs(spark):
    words = {"en": ["the", "of", "and", "house"], "de": ["der", "und", "ist", "haus"], "fr": ["le", "et", "est", "maison"], "es": ["el", "y", "es", "casa"], "xx": ["qqz", "zzq", "kqk", "qkq"]}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(w, 30)), lang, "s", 0) for k, (lang, w) in enumerate(words.items()) for i in range(k * 100, k * 100 + 60)]
    rows += [(900, None, "en", "s", 0), (901, "123 !?", "en", "s", 0), (902, "", None, "s", 0), (903, "der und ist " * 5000, None, "s", 0), (904, "Ж", None, "s", 0), (None, "the of and", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.train(docs)
    assert sorted(map(len, model.families)) == [1, 2, 2] and len(model.pairs) == 2
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _, _ in rows[:300])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and got[904]["lang_pred"] != "und"
    assert got[900]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in language_id.keep_known(docs, model).collect()}
    assert not kept & {900, 901, 902} and 903 in kept


def test_predictions_decide_what_is_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(3)
    junk = [" ".join(f"{b:02x}" for b in rng.integers(0, 256, 300)), "8841 2231 x 9917 3345 " * 20, "<div class='x'><a href='#'></a></div>" * 20, "это предложение на русском языке которого модель не знает " * 5]
    planted = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], docs.schema)
    model = language_id.train(docs)
    kept = {r["doc_id"] for r in language_id.keep_known(docs.unionByName(planted), model).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}
    assert language_id.keep_known(docs, model, least_score=1.1).count() == 0


def test_all_lettered_rows_stay_where_nothing_was_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", 3), (2, "12", None, "s", 2), (3, None, None, "s", 0), (4, "Ж", None, "s", 1)], DOCS)
    assert {r["doc_id"] for r in language_id.keep_known(docs, language_id.train(docs)).collect()} == {1, 4}


def test_language_without_examples(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", 3)], DOCS)
    model = language_id.train(docs)
    assert language_id.predict(docs, model).first()["lang_pred"] == "und"
    assert language_id.predict(docs.limit(0), model).count() == 0
