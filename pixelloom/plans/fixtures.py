"""Rasters derived from the relational tables, and the same definitions in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..raster import Raster, from_table

W = 100


class Tables:
    """Lazy rasters over one scale's folder; heights come from row counts, as the keys are dense."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def height(self) -> int:
        return -(-self.table("events").count() // W)

    def _events(self, bands, fmt="uchar", interpretation="multiband") -> Raster:
        x, y = F.col("event_id") % W, F.expr(f"event_id div {W}")
        return from_table(self.table("events"), x, y, bands, W, self.height, fmt, interpretation)

    @cached_property
    def ev(self) -> Raster:
        return self._events([F.floor("value") % 256])

    @cached_property
    def ev3(self) -> Raster:
        return self._events([F.floor("value") % 256, (F.col("user_id") * 7) % 256, (F.col("event_id") * 31) % 256], interpretation="srgb")

    @cached_property
    def ev4(self) -> Raster:
        return self._events([F.floor("value") % 256, (F.col("user_id") * 7) % 256, (F.col("event_id") * 31) % 256, (F.col("event_id") * 13) % 256], interpretation="srgb")

    @cached_property
    def over(self) -> Raster:
        return self._events([(F.col("event_id") * 17) % 256, F.floor("value") % 256, (F.col("user_id") * 11) % 256, (F.col("event_id") * 29) % 256], interpretation="srgb")

    @cached_property
    def val(self) -> Raster:
        return self._events([F.col("value")], "double")

    @cached_property
    def idx(self) -> Raster:
        code = F.array_position(F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")]), F.col("event_type")) - 1
        return self._events([code])

    @cached_property
    def bin(self) -> Raster:
        return self._events([F.when(F.floor("value") % 256 >= 64, 255).otherwise(0)])

    @cached_property
    def lab(self) -> Raster:
        return self._events([(F.floor("value") % 256) * 100 / 255.0, (F.col("user_id") * 7) % 256 - 128, (F.col("event_id") * 31) % 256 - 128], "double", "lab")

    @cached_property
    def lab2(self) -> Raster:
        return self._events([(F.col("event_id") * 17) % 101, (F.col("user_id") * 5) % 200 - 100, F.floor("value") % 200 - 100], "double", "lab")

    @cached_property
    def orders(self) -> Raster:
        t = self.table("orders")
        return from_table(t, F.col("o_orderkey") % 150, F.expr("o_orderkey div 150"), [F.floor("o_totalprice")], 150, -(-t.count() // 150), "uint")

    @cached_property
    def part(self) -> Raster:
        t = self.table("part")
        return from_table(t, F.col("p_partkey") % 50, F.expr("p_partkey div 50"), [F.col("p_size")], 50, -(-t.count() // 50))

    @cached_property
    def cplx(self) -> Raster:
        t = self.table("embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"), "embedding")
        z = F.struct(F.get("embedding", 2 * F.col("i")).alias("re"), F.get("embedding", 2 * F.col("i") + 1).alias("im"))
        return from_table(t, F.col("i"), F.col("vec_id"), [z], 32, self.table("embeddings").count(), "complex")

    @cached_property
    def cplx2(self) -> Raster:
        t = self.table("embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"), "embedding")
        z = F.struct(F.get("embedding", 63 - 2 * F.col("i")).alias("re"), F.get("embedding", 2 * F.col("i")).alias("im"))
        return from_table(t, F.col("i"), F.col("vec_id"), [z], 32, self.table("embeddings").count(), "complex")


CTES = {
    "ev": "SELECT CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y, CAST(floor(value) AS BIGINT) % 256 AS v FROM events",
    "val": "SELECT CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y, value AS v FROM events",
    "ev4": "SELECT CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y, CAST(floor(value) AS BIGINT) % 256 AS b0, (user_id * 7) % 256 AS b1, (event_id * 31) % 256 AS b2, (event_id * 13) % 256 AS b3 FROM events",
    "ov": "SELECT CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y, (event_id * 17) % 256 AS o0, CAST(floor(value) AS BIGINT) % 256 AS o1, (user_id * 11) % 256 AS o2, (event_id * 29) % 256 AS o3 FROM events",
    "idx": "SELECT CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS v FROM events",
    "bn": "SELECT CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y, CASE WHEN CAST(floor(value) AS BIGINT) % 256 >= 64 THEN 255 ELSE 0 END AS v FROM events",
    "lab": "SELECT CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y, CAST((CAST(floor(value) AS BIGINT) % 256) * 100 / 255.0 AS DOUBLE) AS l, CAST((user_id * 7) % 256 - 128 AS DOUBLE) AS a, CAST((event_id * 31) % 256 - 128 AS DOUBLE) AS b FROM events",
    "lab2": "SELECT CAST(event_id % 100 AS INT) AS x, CAST(event_id // 100 AS INT) AS y, CAST((event_id * 17) % 101 AS DOUBLE) AS l, CAST((user_id * 5) % 200 - 100 AS DOUBLE) AS a, CAST(CAST(floor(value) AS BIGINT) % 200 - 100 AS DOUBLE) AS b FROM events",
    "od": "SELECT CAST(o_orderkey % 150 AS INT) AS x, CAST(o_orderkey // 150 AS INT) AS y, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders",
    "pt": "SELECT CAST(p_partkey % 50 AS INT) AS x, CAST(p_partkey // 50 AS INT) AS y, CAST(p_size AS BIGINT) AS v FROM part",
    "z": "SELECT coalesce(e.x, o.x) AS x, coalesce(e.y, o.y) AS y, coalesce(e.v, 0) AS a, coalesce(o.v, 0) AS b FROM ev e FULL JOIN od o ON e.x = o.x AND e.y = o.y",
    "cx": "SELECT CAST(i AS INT) AS x, CAST(vec_id AS INT) AS y, CAST(embedding[2 * i + 1] AS DOUBLE) AS re, CAST(embedding[2 * i + 2] AS DOUBLE) AS im, CAST(embedding[64 - 2 * i] AS DOUBLE) AS re2, CAST(embedding[2 * i + 1] AS DOUBLE) AS im2 FROM embeddings, range(32) t(i)",
    "dim": "SELECT max(y) AS my FROM ev",
}
NEEDS = {"z": ["ev", "od"], "dim": ["ev"]}


def with_ctes(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    order: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}"


def fixed(c, digits=4):
    """A double cut to so many digits by the same arithmetic in both engines."""
    v = c.cast("double") * float(10**digits) + 0.5
    # F.floor gives longs: NaN would become 0 and what is too large the largest long.  Doubles of that size are whole.
    return F.when(F.abs(v) < float(1 << 62), F.floor(v).cast("double")).otherwise(v) / float(10**digits)


def sql_fixed(e: str, digits=4, real=True) -> str:
    v = f"CAST(CAST({e} AS REAL) AS DOUBLE)" if real else f"CAST({e} AS DOUBLE)"
    return f"floor({v} * {float(10**digits)} + 0.5) / {float(10**digits)}"


def shown(r: Raster, digits=4) -> DataFrame:
    """A raster as a result: coordinates, longs for integer bands, cut doubles for others."""
    from ..raster import is_complex, is_int

    cols = []
    for n in r.names:
        c = F.col(n)
        if is_int(r.format):
            cols.append(c.cast("long").alias(n))
        elif is_complex(r.format):
            cols += [fixed(c["re"], digits).alias(f"{n}_re"), fixed(c["im"], digits).alias(f"{n}_im")]
        else:
            cols.append(fixed(c, digits).alias(n))
    return r.df.select("x", "y", *cols)
