"""Licence scan by canonical digest (DataFrame functions only).

A text is normalised - lower case, typographic quotes and dashes, copyright lines out,
punctuation to spaces, equivalent spellings to one, white space to one space - and the
SHA-256 of the whole normalised text is looked up among the digests of known licences.
The known texts are a table ``licenses(license_id, text)``; the bundled ones are the common
licences and notices in their usual forms (``license_texts``).  The same lookup runs over each single line that speaks of
a licence, so that notices inside longer documents are found as whole lines.

The digest table is bounded: it holds ``MAX_KNOWN`` rows at most and is broadcast; a larger
one is refused and belongs in several calls.

Cases: null and empty texts, and texts that normalise to nothing, have an empty canonical
form and no licence; several known texts with one digest give the smallest id; repeated
rows and null ids are answered row by row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .license_texts import texts
from .shared import load

MAX_KNOWN = 5_000

# Known licence texts and notices, those that the SQL has; license_texts has more.
KNOWN = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

# Spellings that count as one, as whole words.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "organisation": "organization", "favour": "favor", "honour": "honor", "merchantibility": "merchantability",
    "noninfringement": "non infringement", "judgement": "judgment", "acknowledgement": "acknowledgment", "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
}
MENTION = r"(?i)licen[cs]|permission|public domain|copyleft"


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?m)^[ \t*#/;-]*(?:copyright\b|\(c\)|©).*$", " ")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    spelt = out
    for was, now in SPELLINGS.items():
        spelt = F.replace(spelt, F.lit(f" {was} "), F.lit(f" {now} "))
    return F.trim(F.when(out.rlike(" (?:" + "|".join(SPELLINGS) + ") "), spelt).otherwise(out))


def known_digests(licenses: DataFrame) -> DataFrame:
    """(digest, license_id) of the known texts; each digest once."""
    texts = licenses.select("license_id", canonical(F.col("text")).alias("c")).where("c <> ''")
    return texts.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def bundled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN + texts(), "license_id string, text string")


def scan(docs: DataFrame, licenses: DataFrame | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: doc_id, canonical_sha256, license_id (of the whole text, else null), notice_ids (sorted
    array of licences whose known text is a whole line)."""
    spark = docs.sparkSession
    known = known_digests(bundled(spark) if licenses is None else licenses)
    rows = known.limit(MAX_KNOWN + 1).collect()
    if len(rows) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known texts: scan in blocks of the licence table")
    known = spark.createDataFrame(rows, known.schema)
    by_line = F.create_map(*[F.lit(x) for r in rows for x in r]) if rows else F.create_map().cast("map<string,string>")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    said = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(MENTION))
    hits = F.filter(F.transform(said, lambda x: F.element_at(by_line, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    whole = texts.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"),
                         F.when(F.col("text").rlike(MENTION), F.array_sort(F.array_distinct(hits))).otherwise(F.array().cast("array<string>")).alias("notice_ids"))
    found = whole.join(F.broadcast(known), whole.canonical_sha256 == known.digest, "left")
    return found.select("doc_id", "canonical_sha256", "license_id", F.coalesce("notice_ids", F.array().cast("array<string>")).alias("notice_ids"))


def op4_license_scan(spark, sf_dir):
    return scan(load(spark, sf_dir, "documents")).select("doc_id", "canonical_sha256", "license_id", F.array_join("notice_ids", ",").alias("notices"))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '(?m)^[ \\t*#/;-]*(?:copyright\\b|\\(c\\)|©).*$', ' ', 'g')"
    out = f"(' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"
    for was, now in SPELLINGS.items():
        out = f"replace({out}, ' {was} ', ' {now} ')"
    return f"trim({out})"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256({_sql_canonical('t')}) AS digest FROM (VALUES {values}) v(license_id, t)) GROUP BY digest
), said AS (
  SELECT rid, {_sql_canonical('line')} AS c FROM (
    SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM (SELECT *, row_number() OVER () AS rid FROM documents))
  WHERE regexp_matches(line, '{MENTION}')
), notices AS (
  SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM said JOIN known ON sha256(c) = digest GROUP BY rid
), whole AS (
  SELECT doc_id, rid, sha256({_sql_canonical('text')}) AS canonical_sha256 FROM (SELECT *, row_number() OVER () AS rid FROM documents)
)
SELECT doc_id, canonical_sha256, license_id, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON canonical_sha256 = digest LEFT JOIN notices USING (rid)
"""
