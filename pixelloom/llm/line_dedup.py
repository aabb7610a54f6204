"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

``LineRuns`` is a log-structured store in the shared folder.  A run is a bucketed and sorted
table of (h1, h2, n_docs, top, known), one row for each line key; every key is fresh in one run only.
All runs have the same buckets, so a merge with a run needs no exchange of it.  A new batch
is reduced to its own keys, merge-joined with each run and written once, as a run of level 0: its
fresh keys, and as updates, marked known, the counts and largest ids of keys that an older run holds.
When a level holds ``fanout`` runs they are compacted into one run of the next level, where updates
join their keys, and the runs that went into it are deleted.

Two ways of use: ``first_seen`` is the incremental form (a line stays only where its key is
new).  ``dedup_lines`` is the corpus form: the line keys of all rows are taken in one pass,
dealt into even batches, ``BATCHES`` at least and of about ``BATCH_ROWS`` documents at most, that are
added one by one, so that runs of all levels are merged with and compacted whatever the size, and then the
lines are joined with the keys whose counts, updates included, reach the limit.  A key is two 64-bit
hashes with different seeds, so that false matches stay negligible at 10**13 lines.

Scale: lines are reduced within rows and by partial aggregates before they are dealt, so a
line of a third of all documents reaches its partition as one row for each task; the join
with frequent keys has one row for each key on one side and can be split where one key is hot.

Cases: null or empty text is one empty line, returned as the empty string; null ids stand
below all others and their lines stay only where no other holder is; rows that repeat an id
count as documents of their own and all rows with the largest id keep the line; ties
therefore keep; empty tables give empty results; columns besides id and text pass through.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import discard, load, new_path, partitions, passing, stored

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS, BATCH_ROWS, FANOUT = 40, 5, 100_000_000, 4
#: A compaction of level 0, and a batch that is merged with the compacted run.
BATCHES = FANOUT + 1
KEY = ("h1", "h2")


@contextlib.contextmanager
def sorted_scans(spark: SparkSession):
    """Scans of bucketed tables keep their buckets and tell that their files are sorted, while jobs run in here."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def folded(bare: Column) -> Column:
    """A-Z in lower case; lower() is the same where all characters are ASCII, and cheaper.  Lengths stay."""
    return F.when(F.char_length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return folded(stripped(line))


def hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, pos, h1, h2) of each line whose key is long enough."""
    each = docs.select("id", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    bare = each.where(F.octet_length("line") >= min_chars).select("id", "pos", stripped(F.col("line")).alias("bare")).where(F.char_length("bare") >= min_chars)
    keys = bare.select("id", "pos", folded(F.col("bare")).alias("key"))
    return keys.select("id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """Levels of sorted runs of keys: each key fresh once in all runs, and known where later batches held it again."""

    SCHEMA = "h1 long, h2 long, n_docs long, top long, known boolean"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.paths, self.buckets = spark, fanout, [[]], {}, partitions(spark)

    def _write(self, keys: DataFrame) -> str:
        """A new run of ``keys``: one sorted file for each bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = passing(self.spark, new_path(self.spark, "line-run"))
        keys.repartition(self.buckets, *KEY).write.option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, name: str) -> None:
        table = self.spark.table(name)
        discard(table)
        self.spark.sql(f"DROP TABLE {name}")
        del self.paths[name]

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _fresh_in(self, name: str) -> DataFrame:
        return self.spark.table(name).where(~F.col("known")).select(*KEY).hint("merge")

    def _rows(self, names) -> DataFrame:
        """The rows of these runs, read as plain files: a union of bucketed tables counts as dealt by key,
        but its vectorised scans are strung together, and sums by key over it come out in parts."""
        paths = [self.paths[name] for name in names]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def _totals(self, names) -> DataFrame:
        """One row for each key of these runs: fresh if it is so in one of them."""
        return self._rows(names).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top"), F.bool_and("known").alias("known"))

    def read(self) -> DataFrame:
        """Each key once, as the batch that had it first held it or, once compacted, with the updates beside it."""
        return self._rows(self._names()).where(~F.col("known")).drop("known")

    @staticmethod
    def keys_of(hashed: DataFrame) -> DataFrame:
        """A batch's keys: documents that hold each, and the largest id."""
        return hashed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("top"))

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds, by merge anti-joins with the runs."""
        for name in self._names():
            keys = keys.join(self._fresh_in(name), list(KEY), "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """One batch becomes a run: fresh keys, and known ones, that is keys that stand in an older run."""
        marks = []
        for name in self._names():
            marks.append(f"in{len(marks)}")
            keys = keys.join(self._fresh_in(name).withColumn(marks[-1], F.lit(True)), list(KEY), "left")
        self.levels[0].append(self._write(keys.select(*KEY, "n_docs", "top", F.coalesce(*marks, F.lit(False)).alias("known"))))
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(self._totals(runs)))
                self.levels[level] = []
                for name in runs:
                    self._drop(name)

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, top) of keys in at least so many documents."""
        return self._totals(self._names()).where(F.col("n_docs") >= min_docs).select(*KEY, "top")

    def close(self) -> None:
        """Deletes all runs."""
        for name in self._names():
            self._drop(name)
        self.levels = [[]]


def row_keys(docs: DataFrame, min_chars: int, *carried: str) -> DataFrame:
    """(id, carried.., h1, h2), each distinct key of a row once: distinct within the row, before any exchange."""
    texts = F.filter(lines(F.col("text")), lambda x: F.octet_length(x) >= min_chars)
    keys = F.transform(F.filter(F.transform(texts, stripped), lambda k: F.char_length(k) >= min_chars), folded)
    each = docs.select("id", *carried, F.explode(F.array_distinct(keys)).alias("key"))
    return each.select("id", *carried, F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def batches_of(docs: DataFrame, min_chars: int, count: int, rows: int = BATCH_ROWS) -> list[DataFrame]:
    """(id, h1, h2) of all rows, from one pass, in ``count`` batches or more where one would hold over ``rows`` documents.
    A batch is a folder; each task deals its rows to all of them in turn, so they are even however the rows lie."""
    spark = docs.sparkSession
    count = max(count, -(-docs.count() // rows))
    path = passing(spark, new_path(spark, "line-keys"))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    dealt = docs.withColumn("batch", F.pmod(F.spark_partition_id() + row, F.lit(count)).cast("int"))
    row_keys(dealt, min_chars, "batch").write.option("compression", "zstd").partitionBy("batch").parquet(path)
    got = spark.read.schema("id long, h1 long, h2 long, batch int").parquet(path)
    held = sorted(r["batch"] for r in got.select("batch").distinct().collect())
    return [got.where(F.col("batch") == k).select("id", *KEY) for k in held]


def first_seen(docs: DataFrame, runs: LineRuns, id_col="doc_id", text_col="text", min_chars=MIN_CHARS) -> DataFrame:
    """One batch of the incremental form: (id, pos, h1, h2) of lines whose key no earlier batch had; adds the batch's keys.
    Within the batch the smallest (id, pos) counts as first."""
    batch = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = hashes(batch, min_chars)
    fresh = runs.fresh(hashed).groupBy(*KEY).agg(F.min(F.struct("id", "pos")).alias("first"))
    fresh = stored(fresh.select("first.id", "first.pos", *KEY), "line-fresh")
    runs.add(LineRuns.keys_of(row_keys(batch, min_chars)))
    return fresh


def keep_runs(all_lines: Column, drops: Column) -> Column:
    """The lines outside the sorted positions ``drops``: slices between neighbours, linear in the lines."""
    bounds = F.concat(F.array(F.lit(-1)), drops, F.array(F.size(all_lines)))
    pieces = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda k: F.slice(
        all_lines, F.element_at(bounds, k) + 2, F.element_at(bounds, k + 1) - F.element_at(bounds, k) - 1))
    return F.flatten(pieces)


def dedup_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, min_docs=MIN_DOCS, batches=BATCHES, fanout=FANOUT) -> DataFrame:
    """All columns of ``docs``, with the text of the kept lines, and n_lines, n_dropped (long; a clash is renamed by the caller)."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    runs = LineRuns(docs.sparkSession, fanout)
    with sorted_scans(docs.sparkSession):
        keys = batches_of(base, min_chars, batches)
        for batch in keys:
            runs.add(LineRuns.keys_of(batch))
        frequent = stored(runs.frequent(min_docs), "line-frequent")
        runs.close()
        discard(*keys)
    lost = hashes(base.select("id", "text"), min_chars).join(frequent, list(KEY)).where(~F.col("id").eqNullSafe(F.col("top")))
    # Rows that share an id are told apart by what they hold: one text, one set of positions.
    drops = lost.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("pos", "h1", "h2"))).alias("drops"))
    taken = set(docs.columns)
    key, found = _free("_id", taken), _free("_drops", taken)
    joined = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))).join(
        drops.select(F.coalesce("id", F.lit(-(2**63))).alias(key), F.col("drops").alias(found)), key, "left")
    text, lost_here = F.coalesce(F.col(text_col), F.lit("")), F.col(found).isNotNull()

    # One-element arrays bind a value to a lambda variable: the text is split once for each row.
    def cut(ls: Column) -> Column:
        own = F.array_distinct(F.transform(F.filter(F.col(found), lambda d: _same(ls, d)), lambda d: d["pos"]))
        return F.get(F.transform(F.array(own), lambda o: F.struct(
            F.size(o).cast("long").alias("n"), F.array_join(keep_runs(ls, o), "\n").alias("kept"))), F.lit(0))

    done = joined.withColumn(found, F.when(lost_here, F.get(F.transform(F.array(lines(text)), cut), F.lit(0))))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return done.select(
        *[F.coalesce(F.col(found)["kept"], text).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        n_lines.cast("long").alias("n_lines"), F.coalesce(F.col(found)["n"], F.lit(0)).cast("long").alias("n_dropped"))


def _same(held: Column, d: Column) -> Column:
    key = line_key(F.get(held, d["pos"]))
    return (F.xxhash64(key) == d["h1"]) & (F.xxhash64(F.lit("second"), key) == d["h2"])


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name


def op2_line_dedup(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def stage(spark, docs, sf_dir):
    """Documents with the kept lines; n_chars follows the text, other columns stay."""
    out = dedup_lines(docs)
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, rid, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5
), marked AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.top AS lost FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id, rid
"""
