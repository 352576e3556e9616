"""Names for SQL: scalar functions, table functions and views."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from skyloom.functions.calendar import EPOCH_JD, FRAME_DAYS
from skyloom.functions.cells import STRIDE, cover, side_deg
from skyloom.sources.mesh import icosphere_points

#: SQL expressions, planned like any other.
SCALARS = {
    "frame_to_jd": ("frame BIGINT", "DOUBLE", f"{EPOCH_JD}D + frame * {FRAME_DAYS!r}D"),
    "jd_to_frame": ("jd DOUBLE", "BIGINT", f"CAST(rint((jd - {EPOCH_JD}D) / {FRAME_DAYS!r}D) AS BIGINT)"),
    "leaf_of": ("macro INT, micro INT", "INT", "macro * 64 + micro"),
    "wrap180": ("x DOUBLE", "DOUBLE", "pmod(x + 180D, 360D) - 180D"),
    "separation_deg": ("a DOUBLE, b DOUBLE", "DOUBLE", "least(pmod(abs(a - b), 360D), 360D - pmod(abs(a - b), 360D))"),
    "sign_of": ("lon DOUBLE", "INT", "CAST(floor(pmod(lon, 360D) / 30D) AS INT)"),
    "cell_of": ("lat DOUBLE, lng DOUBLE", "BIGINT", f"CAST(floor((lat + 90D) / {side_deg(4)}D) * {STRIDE} + floor((lng + 180D) / {side_deg(4)}D) AS BIGINT)"),
    "token_rarity": ("n BIGINT, total BIGINT", "DOUBLE", "least(greatest(-ln(CASE WHEN n > 0 THEN n / total ELSE 1D / (total + 4096) END) / ln(CAST(greatest(total, 4096) AS DOUBLE)), 0D), 1D)"),
}


@udtf(returnType="node: int, x: double, y: double, z: double")
class GenMesh:
    """An icosphere of so many halvings."""

    def eval(self, levels: int):
        for i, (x, y, z) in enumerate(icosphere_points(levels)):
            yield i, x, y, z


@udtf(returnType="frame: bigint, jd: double")
class GenFrames:
    """Frames in [start, stop). For long spans ``sources.frames`` is spread over tasks; this is for a row's own few."""

    def eval(self, start: int, stop: int):
        for f in range(start, stop):
            yield f, EPOCH_JD + f * FRAME_DAYS


@udtf(returnType="cell: bigint")
class BoxCells:
    """All cells that a box touches."""

    def eval(self, min_lat: float, min_lng: float, max_lat: float, max_lng: float):
        for c in cover(min_lat, min_lng, max_lat, max_lng):
            yield (c,)


def register(spark: SparkSession) -> None:
    """All names, for this session."""
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, table in (("gen_mesh", GenMesh), ("gen_frames", GenFrames), ("bbox_cells", BoxCells)):
        spark.udtf.register(name, table)


def register_tables(spark: SparkSession, root: str, names: list[str]) -> None:
    """A view for each Parquet table under a root."""
    for name in names:
        spark.read.parquet(f"{root}/{name}.parquet").createOrReplaceTempView(name)
