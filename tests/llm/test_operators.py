"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import decontaminate, language_id, license_scan, line_dedup, media_columns, minhash_join, sentencepiece_chunks, suffix_dedup, textbuf, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(60, 300))) for _ in range(25)]
    shared = "A passage that many of the documents share, word for word, and that is longer than the line limit. " * 3
    out = [None, "", " ", "\n\n", "one", "Two words", "\x00nul \x00", "ünïcödé ▁ mark  double  space ", "a" * 5000, "ab " * 3000, "é" * 300]
    out += base + base[:3] + [base[4].upper()]
    for k in range(12):
        w = base[5].split(" ")
        w[(k * 17) % len(w)] = f"edit{k}"
        out.append(" ".join(w))
    out += [b[:100] + "\n" + shared.strip() + "\n" + b[100:] for b in base[10:18]]
    out += [(" " + word()).join(["x", "y"]) for _ in range(3)]
    out.append(" ".join(word() for _ in range(20000)))
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    out = [(k, x, ["en", "fr", None][k % 3], "s", len(x or "")) for k, x in enumerate(t)]
    return [*out, (7, "repeated id, other text " * 30, "en", "s", 1), (9, t[9], "en", "s", 1), (None, t[12], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    return docs.withColumns({"ids": F.lit(1), "key": F.lit("k"), "h1": F.lit(2), "id": F.lit(3), "drops": F.lit(4), "_drops": F.lit(5), "v": F.lit(6), "node": F.lit(7)})


def bag(df):
    return sorted(map(str, df.collect()))


# --- 1 near duplicates --------------------------------------------------------------------------------------------

def shingles(t):
    w = WORDS.findall((t or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, parent = {}, {}
    for d, t, *_ in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(t))
            parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(s and t and 100 * len(s & t) >= 85 * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def test_near_duplicates(docs, rows):
    root = brute_components(rows)
    got = minhash_join.near_duplicates(clashing(docs)).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == (root[r["id"]] if r["id"] is not None else None) for r in got)
    want = sorted((d if d is not None else -1, len(shingles(t))) for d, t, *_ in rows)
    assert sorted((r["id"] if r["id"] is not None else -1, r["n_shingles"]) for r in got) == want


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(w)) for k in range(400) if (w := list(base)) and [w.__setitem__(rng.randrange(150), f"e{k}_{j}") for j in range(rng.randint(0, 5))] is not None]
    got = {r["id"]: r["component_id"] for r in minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_near_duplicate_stage_keeps_one(spark, docs, empty):
    kept = minhash_join.stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    root = brute_components([tuple(r) for r in docs.collect()])
    assert sorted(set(i for i in ids if i is not None)) == sorted(d for d, c in root.items() if d == c) and ids.count(None) == 2
    assert minhash_join.stage(spark, empty, "").count() == 0


def test_trees_reach_recall():
    p = minhash_join.survival(0.85)
    assert 0.9 < p < 1 and 1 - (1 - p) ** minhash_join.trees_for() > minhash_join.RECALL


def test_block_comparison_matches_sets():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    rows = []
    for k in range(60):
        s = base.copy()
        n = int(rng.integers(0, 20))
        s[rng.choice(100, n, False)] = rng.integers(0, 2**63, n).astype(np.uint64)
        rows.append((k % 2, k, k, np.unique(s)))
    for key, pairs in (((0, 0, 0), [(a, b) for a in range(60) for b in range(a)]), ((0, 0, 1), [(a, b) for a in range(60) for b in range(60) if a % 2 == 0 and b % 2 == 1])):
        want = {frozenset((a, b)) for a, b in pairs if 100 * len(np.intersect1d(rows[a][3], rows[b][3])) >= 85 * len(np.union1d(rows[a][3], rows[b][3]))}
        assert {frozenset(p) for p in minhash_join.compare(rows, key)} == want


# --- 2 lines ------------------------------------------------------------------------------------------------------

def brute_lines(rows, min_docs=5):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for n, (d, t, *_) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(d)
    low = lambda d: -(2**63) if d is None else d
    out = []
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(held.get(key(x), ())) >= min_docs and low(d) != max(map(low, held[key(x)])))]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines(docs, rows, batches):
    got = line_dedup.dedup_lines(docs, batches=batches, fanout=3).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_lines(rows)))


def test_line_batches_are_even_however_rows_lie(spark):
    line = "a line that is long enough to be counted, of document"
    table = spark.createDataFrame([(k, f"{line} {k}") for k in range(48)], "id long, text string")
    for docs in (table.coalesce(1), table.where("id < 24").coalesce(1).union(table.where("id >= 24").coalesce(1))):
        for batches, count, rows in ((8, 8, 100), (4, 1, 12), (6, 2, 8)):
            got = [[r["id"] for r in b.collect()] for b in line_dedup.batches_of(docs, 40, count, rows)]
            assert [len(b) for b in got] == [48 // batches] * batches and sorted(sum(got, [])) == list(range(48))


@pytest.mark.parametrize("batches", [2, 3, 4, 5])
def test_line_counts_add_up_over_batches(spark, batches):
    line = "a line that five documents hold, and that is long enough"
    data = [(k, f"{line}\nand another line that only document {k} holds") for k in range(5)]
    got = line_dedup.dedup_lines(spark.createDataFrame(spark.sparkContext.parallelize(data, 5), "doc_id long, text string"), batches=batches)
    assert {r["doc_id"]: r["n_dropped"] for r in got.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_lines_are_merged_in_levels_by_default(docs, rows, monkeypatch):
    seen, close = [], line_dedup.LineRuns.close
    monkeypatch.setattr(line_dedup.LineRuns, "close", lambda self: (seen.append([len(x) for x in self.levels]), close(self)))
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert seen == [[1, 1]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_lines(rows)))


def test_lines_with_clashing_columns_and_without_rows(docs, empty, rows):
    got = line_dedup.dedup_lines(clashing(docs))
    assert set(docs.columns) < set(got.columns) and got.count() == len(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_first_seen_keeps_new_lines_only(spark):
    line = "this line is long enough to be counted as one of the lines"
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        new = line_dedup.first_seen(spark.createDataFrame([(10 * k, f"{line}\nand a line of its own for every batch, number {k}"), (10 * k + 1, line)], "doc_id long, text string"), runs)
        assert sorted((r["id"], r["pos"]) for r in new.collect()) == ([(0, 0), (0, 1)] if k == 0 else [(10 * k, 1)])
    assert len(runs.levels) > 1 and runs.frequent(10).count() == 1 and runs.frequent(11).count() == 0
    assert runs.read().count() == runs.read().select("h1", "h2").distinct().count() == 6


# --- 3 toxicity ---------------------------------------------------------------------------------------------------

def test_toxicity_learns_and_scores_all(spark, docs, empty):
    rng = random.Random(1)
    data = [(k, " ".join(rng.choice(["good", "day", "tree", "you", "sea"]) for _ in range(40)) + (" you stupid idiot scum" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(900)]
    table = spark.createDataFrame([(a, b) for a, b, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(a, 1, c) for a, _, c in data] + [(None, 1, 1), (5, 0, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(table, labels, language_id.remainder(5) != 0)
    got = toxicity.score(table.unionByName(docs.select("doc_id", "text")), model).collect()
    assert len(got) == 900 + docs.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got[:900] if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in held]) > 0.95
    assert toxicity.score(empty, model).count() == 0
    bare = toxicity.train(table, labels.limit(0))
    assert {r["score"] for r in toxicity.score(table, bare).collect()} == {0.5}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    xs, ys = toxicity.isotonic(raw, (rng.random(500) < 1 / (1 + np.exp(-raw))).astype(float))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and 0 < ys[0] and ys[-1] < 1


# --- 4 licences ---------------------------------------------------------------------------------------------------

def test_licenses(spark, docs, rows, empty):
    mit = dict((k, t) for k, t in license_scan.KNOWN if len(t) > 200)["MIT"]
    shown = "Copyright (c) 2020 Someone\n\n" + mit.replace("Software", "SOFTWARE").replace(",", " ,").replace("license", "licence")
    extra = spark.createDataFrame([(100, shown), (101, mit + " and more"), (102, "Hello.\nReleased under the MIT Licence.\nBye."), (103, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(extra).collect()}
    assert got[100]["license_id"] == "MIT" and got[101]["license_id"] is None and got[102]["notice_ids"] == ["MIT"] and got[103]["license_id"] is None
    assert license_scan.scan(clashing(docs)).count() == len(rows) and license_scan.scan(empty).count() == 0


# --- 5 media ------------------------------------------------------------------------------------------------------

def test_sequences_keep_order_and_captions():
    html = "<body><p>one <b>two</b></p><figure><img src='media:sha256:aa' alt='A'><img src=b.png><figcaption>cap &amp; tion</figcaption></figure>three<script>no</script><video src='c'></video><p></p>four"
    items = media_columns.sequence_of(html)
    assert [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [
        (0, "text", "one two", None), (1, "media", "media:sha256:aa", "cap & tion"), (2, "media", "b.png", "cap & tion"), (3, "text", "three", None), (4, "media", "c", None), (5, "text", "four", None)]
    assert media_columns.sequence_of(None) == [] and media_columns.sequence_of("<<<") is not None


def test_media_round_trip(spark, docs, rows, empty):
    store = media_columns.store_texts(clashing(docs))
    pages = store.select("doc_id", F.format_string('<p>t</p><img src="media:sha256:%s"><img src="media:sha256:none">', "digest").alias("html"))
    got = media_columns.resolve(media_columns.parse(pages, "html", "doc_id"), media_columns.measure(store)).collect()
    assert len(got) == 3 * len(rows)
    want = sorted(hashlib.sha256(b + b"\0" * (max(64, -len(b) % 64 + len(b)) - len(b))).hexdigest() for b in ((r[1] or "").encode() for r in rows))
    assert sorted(r["payload_sha256"] for r in got if r["position"] == 1) == want
    assert all(r["payload_sha256"] is None for r in got if r["position"] != 1)
    assert media_columns.store_texts(empty).count() == 0


# --- 6 language ---------------------------------------------------------------------------------------------------

def test_language_mixture(spark, empty, docs):
    en, fr = "the house and the water of this river with them", "les maisons et une rivière avec des eaux dans le pays"
    table = spark.createDataFrame([(k, (en if k % 2 else fr) + f" {k}", "en" if k % 2 else "fr") for k in range(60)] + [(99, None, "en"), (98, "the", None)], "doc_id long, text string, lang string")
    model = language_id.train(table)
    ask = spark.createDataFrame([(1, en), (2, fr), (3, f"{en} {en} {fr}"), (4, None), (5, "12 34 !!"), (6, ""), (7, "—")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(ask, model).collect()}
    assert got[1]["lang_pred"] == "en" and got[2]["lang_pred"] == "fr" and {x["lang"] for x in got[3]["languages"]} == {"en", "fr"} and 0.5 < got[3]["score"] < 0.9
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (4, 5, 6, 7))
    assert language_id.identify(clashing(docs), model).count() == docs.count() and language_id.identify(empty, model).count() == 0
    none = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.identify(ask, none).collect()} == {"und"}


# --- 7 SentencePiece ----------------------------------------------------------------------------------------------

def test_sentencepiece_equals_library(docs, rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_chunks.default_model())
    got = sentencepiece_chunks.encode_documents(clashing(docs).drop("id"), decode=True)
    want = sorted((str(d), sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for d, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got.collect()) == want
    back = sentencepiece_chunks.decode_ids(got.select("doc_id", "ids"))
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in back.collect()) == sorted((a, c) for a, _, c in want)
    assert sentencepiece_chunks.encode_documents(empty, decode=True).count() == 0


def test_chunk_table_survives_clearing():
    table = sentencepiece_chunks.ChunkTable(sentencepiece_chunks.default_model(), entries=5)
    for t in texts()[:30]:
        ids, at = table.encode([t or "", "x y"])
        assert ids[at[0] : at[1]].tolist() == table.sp.encode(t or "") and ids[at[1] :].tolist() == table.sp.encode("x y")


# --- 8 decontamination --------------------------------------------------------------------------------------------

def brute_hits(rows, items, window=10):
    owners = {}
    for i, t in items:
        w = decontaminate.words_of(t)
        for a in range(max(1, len(w) - window + 1)) if w and i is not None else ():
            owners.setdefault(tuple(w[a : a + window]), set()).add(str(i))
    out = []
    for d, t, *_ in rows:
        w, hit, found = decontaminate.words_of(t), set(), set()
        for size in {len(k) for k in owners}:
            for a in range(len(w) - size + 1):
                if who := owners.get(tuple(w[a : a + size])):
                    hit.update(range(a, a + size))
                    found |= who
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def test_passages(spark, docs, rows, empty):
    t = texts()
    items = [(1, " ".join(t[12].split(" ")[5:40])), (2, t[13][:80]), (3, "Two words"), (4, None), (5, ""), (6, "one"), (None, t[14]), (7, t[12].upper()), (8, "ab " * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_passages(clashing(docs), bench, keep_text=True)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got.collect()) == sorted(map(str, brute_hits(rows, items)))
    for r in got.join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").where("doc_id < 7").collect():
        left = decontaminate.words_of(r["cleaned"])
        assert len(left) >= r["n_words"] - r["n_hit"] - 1
    assert decontaminate.find_passages(empty, bench).count() == 0
    clean = decontaminate.find_passages(docs, bench.limit(0), keep_text=True)
    assert clean.where("n_hit > 0").count() == 0
    assert bag(clean.select("doc_id", F.coalesce("cleaned", F.lit("")).alias("t"))) == bag(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")))


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 500)
    index = decontaminate.FMIndex(text)
    for size in (1, 2, 5):
        for _ in range(20):
            at = int(rng.integers(0, 500 - size))
            p = text[at : at + size]
            lo, hi = index.search(np.array([[-1] * (6 - size) + p.tolist()]))
            found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
            assert found == [k for k in range(500 - size + 1) if (text[k : k + size] == p).all()]


# --- 9 token counts -----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [2, 64, 4 << 20])
def test_token_counts(spark, docs, rows, empty, block):
    if block == 2:
        docs, rows = docs.where("doc_id < 8"), [r for r in rows if r[0] is not None and r[0] < 8]
    enc = token_counts.encoder(token_counts.default_ranks())
    folder = token_counts.new_path(spark, "tokens")
    names = token_counts.stored(token_counts.write_tokens(clashing(docs), folder, file_bytes=9000), "names")
    files = names.groupBy("file").agg(F.max("file_bytes").alias("bytes"))
    got = names.join(token_counts.count_tokens(files, folder, block_bytes=block), ["file", "ordinal"]).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(r[0]), len(enc.encode_ordinary(r[1] or ""))) for r in rows)


def test_open_last_document(spark, tmp_path):
    np.array([5, 6, 50256, 50256, 7, 8, 9], "<u2").tofile(tmp_path / "a.bin")
    files = spark.createDataFrame([(str(tmp_path / "a.bin"), 14)], "file string, bytes long")
    for block in (2, 4, 100):
        got = token_counts.count_tokens(files, f"file://{tmp_path}", block_bytes=block)
        assert [(r["ordinal"], r["n_tokens"]) for r in got.orderBy("ordinal").collect()] == [(0, 2), (1, 0), (2, 3)]


# --- 10 passages --------------------------------------------------------------------------------------------------

def brute_passages(rows, length=200):
    count = {}
    raws = [(r[1] or "").encode() for r in rows]
    for b in raws:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for r, b in zip(rows, raws):
        mark = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                mark[p] += 1
                mark[p + length] -= 1
        gone = np.cumsum(mark[:-1]) > 0
        out.append((r[0], len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_passage_dedup(docs, rows, empty):
    got = suffix_dedup.dedup_passages(clashing(docs).drop("id"), keep_text=True).collect()
    mine = [(r["id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in got]
    assert sorted(map(str, mine)) == sorted(map(str, brute_passages(rows)))
    assert suffix_dedup.dedup_passages(empty).count() == 0


def test_passages_that_overlap_in_part(spark):
    rng = random.Random(9)
    pool = "".join(rng.choice("abcdef ") for _ in range(3000))
    rows = []
    for k in range(60):
        a, n = rng.randrange(2500), rng.randrange(150, 500)
        fill = lambda: "".join(rng.choice("uvwxyz") for _ in range(rng.randrange(0, 150)))
        rows.append((k, fill() + pool[a : a + n] + fill() + pool[a // 2 : a // 2 + 210]))
    got = suffix_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    mine = [(r["id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in got]
    assert sorted(map(str, mine)) == sorted(map(str, brute_passages(rows)))


def test_suffix_order_is_sorted_with_lcps():
    rng = random.Random(4)
    strings = [b"".join(rng.choice([b"a", b"b", b"\0"]) for _ in range(rng.randrange(0, 120))) for _ in range(300)] + [b"a" * 90] * 5 + [b"a" * 100, b""]
    order, lcp = suffix_dedup.suffix_order(strings)
    got = [strings[k] for k in order]
    assert sorted(map(len, got)) == sorted(map(len, strings))
    for x, y, n in zip(got, got[1:], lcp[1:]):
        assert x <= y or x.rstrip(b"\0") == y.rstrip(b"\0")
        assert n == suffix_dedup.common(x, y)


# --- shared text handling -----------------------------------------------------------------------------------------

def test_words_and_hashes():
    import pyarrow as pa

    t = ["Hello  wörld\tfoo", None, "", " x ", "HELLO", "a"]
    data, offsets = textbuf.buffer(pa.array(t))
    h, s, e, first = textbuf.word_hashes(data, offsets, textbuf.Hasher())
    assert [bytes(data[a:b]) for a, b in zip(s, e)] == ["Hello".encode(), "wörld".encode(), b"foo", b"x", b"HELLO", b"a"]
    assert first.tolist() == [0, 3, 3, 3, 4, 5, 6] and h[0] == h[4] and len(set(h.tolist())) == 5


def test_blocks_change_nothing():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    data[rng.integers(0, 5000, 600)] = 32
    offsets = np.array([0, 1200, 1200, 1300, 5000])
    whole = suffix_dedup.anchors(data, offsets)
    for block in (1, 37, 400, 4999):
        for a, b in zip(whole, suffix_dedup.anchors(data, offsets, block=block)):
            assert a.tolist() == b.tolist()
    starts, ends, _ = textbuf.word_spans(data, offsets)
    h = textbuf.Hasher()
    assert (h.many(data, starts, ends) == h.many(data, starts, ends, block=50)).all()


def test_slices_hold_whole_rows():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["aaaa", "b" * 50, None, "cc", "dd"])], ["text"])
    parts = list(textbuf.slices([b], max_bytes=8))
    assert [p.num_rows for p in parts] == [1, 1, 3] and sum(p.num_rows for p in parts) == 5
