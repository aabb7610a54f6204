"""Hashes, features and joins: what must not depend on form, neighbours or hot keys."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pixelloom.llm import line_dedup, media_columns, suffix_dedup, textbuf, token_counts, toxicity
from pixelloom.llm.shared import hot_keys, split_join


def thue_morse(n):
    """Two strings of n bytes that collide under any polynomial modulo a power of two."""
    bits = np.array([bin(k).count("1") & 1 for k in range(n)], np.uint8)
    return bytes(bits + 97), bytes(98 - bits)


def test_structured_strings_do_not_collide():
    for n in (8, 16, 64, 256, 1024, 2048):
        a, b = thue_morse(n)
        data = np.frombuffer(a + b" " + b, np.uint8)
        one, two = textbuf.Hasher().many(data, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
        assert bin(int(one) ^ int(two)).count("1") > 10
        if n == 64:
            h = textbuf.rolling(data, 64)
            assert h[0] != h[n + 1]


def test_rolling_hash_is_of_the_bytes_alone():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 400).astype(np.uint8)
    for width in (8, 20, 64, 100):
        whole = textbuf.rolling(data, width)
        assert len(whole) == 400 - width + 1
        assert all(whole[k] == textbuf.rolling(data[k : k + width], width)[0] for k in range(0, 300, 7))


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 3000):
        keys = rng.integers(0, 3, (n, 4)).astype(np.uint64)
        order, group = suffix_dedup.shallow(keys, n)
        rows = [tuple(r) for r in keys[order].tolist()]
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))
        assert [a == b for a, b in zip(rows, rows[1:])] == [a == b for a, b in zip(group.tolist(), group.tolist()[1:])]


def test_features_do_not_depend_on_neighbours():
    texts = ["!a b", "x!!", "", "!!", "aaa you idiot", "b!!!!", "!"]
    hasher, none = textbuf.Hasher(), (np.zeros(0, np.uint64), np.zeros(0))
    together = toxicity.features(pa.array(texts), hasher, none)
    for k, t in enumerate(texts):
        assert (toxicity.features(pa.array([t]), hasher, none)[0] == together[k]).all()
    assert (toxicity.features(pa.array(texts[::-1]), hasher, none)[::-1] == together).all()


def test_hot_grams_lose_what_others_lose(spark, monkeypatch):
    rng = np.random.default_rng(5)
    shared = bytes(rng.integers(97, 123, 230).astype(np.uint8)).decode()
    own = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    rows = [(k, own(int(rng.integers(1, 300))) + shared[: 230 - k % 7] + own(150)) for k in range(30)] + [(40, own(500)), (41, None), (42, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(str, suffix_dedup.dedup_passages(docs).select("id", "spans", "kept_sha256").collect()))
    monkeypatch.setattr(suffix_dedup, "HOT_GRAM", 1)
    assert sorted(map(str, suffix_dedup.dedup_passages(docs).select("id", "spans", "kept_sha256").collect())) == want
    assert sum(": " in w or "start" in w for w in want) == 30


def test_hot_keys_are_split_and_bounded(spark):
    left = spark.range(4000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.select("k").distinct().withColumn("v", F.col("k") * 2)
    hot = hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], 4000)
    assert [r["k"] for r in hot.collect()] == [0]
    for how in ("inner", "left"):
        got = split_join(left, right.where("k <> 3000"), ["k"], hot, how)
        want = left.join(right.where("k <> 3000"), "k", how)
        assert sorted(map(str, got.select("k", "id", "v").collect())) == sorted(map(str, want.select("k", "id", "v").collect()))


def test_merges_with_runs_need_no_exchange(spark):
    with line_dedup.sorted_scans(spark):
        runs = line_dedup.LineRuns(spark)
        keys = spark.range(1000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit("second"), "id").alias("h2"), F.lit(1).cast("long").alias("n_docs"), F.col("id").alias("top"))
        runs.add(keys)
        name = runs._write(keys.where("top < 10"))
        plan = runs.fresh(spark.table(name))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        runs._drop(name)
        runs.close()


def test_malformed_captions():
    ref = f"{media_columns.PREFIX}{'0' * 64}"
    cases = {
        f"<figure><img src='{ref}'><figcaption>one</figure><p>two</p>": [("media", "one"), ("text", "two")],
        f"<figure><img src='{ref}'><figcaption>one<p>two</p></figure>three": [("media", "one"), ("text", "two"), ("text", "three")],
        f"<figure><img src='{ref}'><figcaption>one": [("media", "one")],
        f"<p>zero<noscript>one<p>two</p>": [("text", "zero"), ("text", "one two")],
        f"<figure><img src='{ref}'></figure><figcaption>one</figcaption>": [("media", None), ("text", "one")],
        f"<p>a<img src='{ref}'>b</p><script>x</script>": [("text", "a"), ("media", None), ("text", "b")],
    }
    for html, want in cases.items():
        got = [(x["kind"], x["caption"] if x["kind"] == "media" else x["text"]) for x in media_columns.sequence_of(html)]
        if "noscript" in html:
            assert " ".join(t for _, t in got).split() == ["zero", "one", "two"] or " ".join(t for _, t in got).split() == ["zero", "two", "one"]
        else:
            assert got == want, html


def test_media_query_of_planted_texts(spark, tmp_path):
    import hashlib
    import zlib

    texts = [None, "", "a <b> & c\nsecond line\n\nfourth", "x" * 64, "é" * 100, "x" * 64]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in media_columns.op5_media_columns(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(6))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = media_columns.to_media(payload)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert r["caption"] == f"document {k}"
    assert got[2]["position"] == 2 and got[2]["n_items"] == 4 and got[3]["feature"] == got[5]["feature"]


def test_separator_is_no_id_of_the_vocabulary(spark, tmp_path):
    import pytest

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        token_counts.write_tokens(docs, str(tmp_path), separator=7)
    with pytest.raises(ValueError):
        token_counts.write_tokens(docs, str(tmp_path), separator=1 << 16)
