"""Cases at the edge of each job, where a shorter version of it would still look right."""

import hashlib
import random
import re
import textwrap
import zlib
from pathlib import Path

import sentencepiece

import corpus_pipeline
from pixelloom.llm import language_id, license_scan, license_texts, minhash_join, sentencepiece_chunks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


# --- brute force --------------------------------------------------------------------------------------------------

def shingles(t):
    w = WORDS.findall((t or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    """Smallest id of each row's component; rows (id, text) of distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                p, q = root[a], root[b]
                root = {d: min(p, q) if r in (p, q) else r for d, r in root.items()}
    return root


# --- near duplicates ----------------------------------------------------------------------------------------------

def scattered(words, edits, tag):
    w = list(words)
    for k in range(edits):
        w[(2 * k + 1) * len(w) // (2 * edits)] = f"{tag}{k}"
    return " ".join(w)


def test_near_duplicate_threshold_of_query_and_stage(spark):
    a, b, c = [[f"{x}{k}" for k in range(200)] for x in "uvw"]
    rows = [(1, " ".join(a)), (2, scattered(a, 4, "a")), (3, scattered(b, 4, "b")), (4, " ".join(b)), (5, scattered(c, 5, "c")), (6, " ".join(c))]
    one, two = shingles(rows[0][1]), shingles(rows[1][1])
    assert (len(one & two), len(one | two)) == (176, 216)
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA)
    assert {r["id"]: r["component_id"] for r in minhash_join.near_duplicates(docs).collect()} == {k: k for k in range(1, 7)}
    assert sorted(r["doc_id"] for r in minhash_join.stage(spark, docs, "").collect()) == [1, 3, 5, 6]


def test_large_group_at_the_threshold_of_the_stage(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        w = [f"w{i}" for i in range(150)]
        for j in range(rng.randint(2, 5)):
            w[rng.randrange(150)] = f"e{k}_{j}"
        rows.append((k, " ".join(w)))
    got = {r["id"]: r["component_id"] for r in minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=minhash_join.STAGE).collect()}
    assert got == brute_components(rows, 80)
    assert got != brute_components(rows, 85)


def test_trees_reach_recall_of_the_stage():
    num, den = minhash_join.STAGE
    assert 1 - (1 - minhash_join.survival(num / den)) ** minhash_join.trees_for(similarity=num / den) > minhash_join.RECALL


# --- licences -----------------------------------------------------------------------------------------------------

def test_whole_licenses_and_notices(spark):
    whole = {f.stem: f.read_text() for f in (Path(license_texts.__file__).with_name("licenses")).glob("*.txt")}
    assert {"Apache-2.0", "MPL-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only"} <= set(whole)
    mit = dict((k, t) for k, t in license_scan.KNOWN if len(t) > 200)["MIT"]
    bsd = "Copyright (c) 2021, Someone\nAll rights reserved.\n\n" + "\n\n".join(textwrap.fill(p.replace("#", "* "), 79) for p in [*license_texts.BSD, license_texts.HOLDERS])
    cases = [*whole.items(), ("MIT", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit), ("MIT", "The MIT License (MIT)\nCopyright (c) 2020 Someone\n\n" + "\n\n".join(textwrap.fill(p, 78) for p in mit.split("\n\n"))),
             ("BSD-2-Clause", bsd), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + bsd.replace("\n\nTHIS", "\n\n* Neither the name of the copyright holder nor the names of its\n  contributors may be used to endorse or promote products derived from\n  this software without specific prior written permission.\n\nTHIS")),
             ("Apache-2.0", whole["Apache-2.0"][: whole["Apache-2.0"].index("APPENDIX")]), ("GPL-2.0-only", re.sub(r"51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA", whole["GPL-2.0-only"])), (None, mit + "\nand more"), (None, whole["GPL-3.0-only"][:-2000])]
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [(want, got[k]) for k, (want, _) in enumerate(cases) if got[k] != want] == []
    lines = [("Apache-2.0", '# Licensed under the Apache License, Version 2.0 (the "License");'), ("MIT", "This project is licensed under the MIT License."), ("GPL-3.0-only", "// SPDX-License-Identifier: GPL-3.0-only"), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("LGPL-2.1-only", "Released under the GNU Lesser General Public License, version 2.1.")]
    got = {r["doc_id"]: r["notice_ids"] for r in license_scan.scan(spark.createDataFrame([(k, f"Hello.\n{t}\nBye.") for k, (_, t) in enumerate(lines)], "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(lines))] == [[want] for want, _ in lines]


# --- languages ----------------------------------------------------------------------------------------------------

LANGS = ("en", "fr", "de", "es", "fi")


def languages(seed=8):
    """Words of five made languages with letters of their own for the most part."""
    rng = random.Random(seed)
    letters = {k: x for k, x in zip(LANGS, ("abcdefa", "ghijkla", "mnopqre", "stuvwxe", "yzäöüia"))}
    return {k: ["".join(rng.choice(x) for _ in range(rng.randint(4, 8))) for _ in range(80)] for k, x in letters.items()}, rng


def test_languages_of_a_text_have_no_cap(spark):
    words, rng = languages()
    text = lambda *ks: " ".join(rng.choice(words[k]) for k in ks for _ in range(100))
    known = [(k, text(x), x, "s", 1) for k, x in enumerate(LANGS * 6)]
    model = language_id.train(spark.createDataFrame(known, SCHEMA))
    mixed = [LANGS[:1], LANGS[:2], LANGS[:3], LANGS[:4], LANGS]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame([(k, text(*x)) for k, x in enumerate(mixed)], "doc_id long, text string"), model).collect()}
    for k, x in enumerate(mixed):
        assert {y["lang"] for y in got[k]["languages"]} == set(x)
        assert abs(got[k]["score"] - 1 / len(x)) < 0.03 and abs(sum(y["share"] for y in got[k]["languages"]) - 1) < 0.001


def test_language_stage_without_labels_drops_only_texts_without_a_letter(spark):
    texts = ["the house by the river", "вода и дом", "12 34 !!", "", None, "—", "x1"]
    rows = [(k, t, None, "s", 1) for k, t in enumerate(texts)]
    kept = language_id.stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[1], rows[6]]


def test_language_stage_learns_from_all_labelled_rows(spark, monkeypatch):
    seen, train = [], language_id.train
    monkeypatch.setattr(language_id, "train", lambda *a, **k: seen.append(train(*a, **k)) or seen[-1])
    fold = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 == 2]
    rows = [(k, "the house by the river", "en", "s", 1) for k in fold] + [(200, "12", None, "s", 1)]
    kept = language_id.stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert seen[0][0] == ["en"] and sorted(r["doc_id"] for r in kept.collect()) == fold


# --- the pipeline against brute force -----------------------------------------------------------------------------

def brute_pipeline(rows, items, min_docs=5, percent=80, window=10):
    """(doc_id, text) that is left of rows (id, text) of distinct ids and of ASCII words."""
    rows = [(d, t) for d, t in rows if any(c.isalpha() for c in t or "")]
    owners = {}
    for d, t in rows:
        for line in {x.strip().lower() for x in t.split("\n")}:
            owners.setdefault(line, []).append(d)
    lost = lambda d, x: len(x) >= 40 and len(owners[x]) >= min_docs and d != max(owners[x])
    rows = [(d, "\n".join(x for x in t.split("\n") if not lost(d, x.strip().lower()))) for d, t in rows]
    root = brute_components(rows, percent)
    rows = [(d, t) for d, t in rows if root[d] == d]
    known = set()
    for i in items:
        w = i.lower().split()
        known |= {tuple(w[a : a + window]) for a in range(max(1, len(w) - window + 1))}
    out = []
    for d, t in rows:
        at = [m.span() for m in re.finditer(r"\S+", t)]
        w, hit = [t[a:b].lower() for a, b in at], set()
        for size in {len(k) for k in known}:
            hit.update(x for a in range(len(w) - size + 1) if tuple(w[a : a + size]) in known for x in range(a, a + size))
        for k in sorted(hit, reverse=True):
            end = at[k][1] if k + 1 not in hit else at[k + 1][0]
            t = t[: at[k][0]] + t[end:]
        out.append((d, t))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    words, rng = languages(9)
    prose = lambda k, n: [rng.choice(words[k]) for _ in range(n)]
    a, b, c, d = prose("en", 200), prose("fr", 200), prose("de", 200), prose("en", 200)
    shared, passage = "This very line stands in six of the documents as it is", prose("de", 25)
    texts = [" ".join(a), scattered(a, 4, "xa"), " ".join(b), scattered(b, 2, "xb"), " ".join(c), scattered(c, 8, "xc"), " ".join(d), " ".join(d).upper(),
             *[f"{shared}\n" + " ".join(prose("fr", 60)) for _ in range(6)], *[f"Another line that is in four documents only, word for word\n{' '.join(prose('en', 50))}" for _ in range(4)],
             " ".join([*prose("en", 40), *passage, *prose("en", 40)]), " ".join([*passage[:9], *prose("de", 30)]), " ".join(passage), "12 34 !!", "", None, "one"]
    rows = [(k, t, "en" if k % 2 else "fr", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = brute_pipeline([r[:2] for r in rows], [" ".join(passage)])
    # Every stage has something to do.
    ids = {k for k, _ in left}
    assert texts[21:24] == ["12 34 !!", "", None] and ids == set(range(25)) - {1, 3, 7, 21, 22, 23}
    assert [k for k, t in left if t != texts[k]] == [8, 9, 10, 11, 12, 18, 20]
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_chunks.default_model())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(k, len(e), sha(",".join(map(str, e))), sha(sp.decode(e))) for k, t in left for e in [sp.encode(t)]]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)
