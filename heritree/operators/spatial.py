"""Boxes, rectangle and point queries, viewport arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCALE, MAX_SCALE, PAD = 0.05, 2.0, 50.0


def boxes(nodes: DataFrame, width: float = 180.0, height: float = 70.0, cell: float | None = None) -> DataFrame:
    """nodes (x, y) with min_x..max_y; cell: also the column cell_x for tables that are written partitioned by it."""
    out = nodes.withColumns({"min_x": F.col("x"), "min_y": F.col("y"), "max_x": F.col("x") + width, "max_y": F.col("y") + height})
    return out.withColumn("cell_x", F.floor(F.col("min_x") / cell)) if cell else out


def rect_query(boxed: DataFrame, x1: float, y1: float, x2: float, y2: float, cell: float | None = None, width: float = 180.0) -> DataFrame:
    """Boxes that touch the rectangle. With cells, only those that can hold such a box are read."""
    hit = (F.col("min_x") <= x2) & (F.col("max_x") >= x1) & (F.col("min_y") <= y2) & (F.col("max_y") >= y1)
    if cell:
        hit &= F.col("cell_x").between(F.floor(F.lit((x1 - width) / cell)), F.floor(F.lit(x2 / cell)))
    return boxed.where(hit)


def point_query(boxed: DataFrame, x: float, y: float, key: str = "wiki_id") -> DataFrame:
    return rect_query(boxed, x, y, x, y).orderBy(key).limit(1)


def visible_edges(edges: DataFrame, shown: DataFrame, key: str = "wiki_id") -> DataFrame:
    """Edges with either end among the shown nodes: two semi-joins, one row an edge."""
    ids = shown.select(F.col(key).alias("__k"))
    ends = [edges.join(ids, F.col(c) == F.col("__k"), "left_semi") for c in ("source", "target")]
    return ends[0].unionByName(ends[1]).dropDuplicates(["id"])


def flagged(shown: DataFrame, selected: str | None, highlighted: list[str], key: str = "wiki_id") -> DataFrame:
    return shown.withColumns({"is_selected": F.col(key) == F.lit(selected) if selected else F.lit(False), "is_highlighted": F.col(key).isin(highlighted) if highlighted else F.lit(False)})


# a viewport: x, y (the world's point in the screen's upper left corner) and scale


def visible_bounds(x: Column, y: Column, scale: Column, width: float, height: float) -> dict[str, Column]:
    return {"min_x": x, "min_y": y, "max_x": x + width / scale, "max_y": y + height / scale}


def to_world(sx: Column, sy: Column, x: Column, y: Column, scale: Column) -> dict[str, Column]:
    return {"world_x": x + sx / scale, "world_y": y + sy / scale}


def to_screen(wx: Column, wy: Column, x: Column, y: Column, scale: Column) -> dict[str, Column]:
    return {"screen_x": (wx - x) * scale, "screen_y": (wy - y) * scale}


def _clamped(scale: Column) -> Column:
    return F.greatest(F.lit(MIN_SCALE), F.least(F.lit(MAX_SCALE), scale))


def zoom_at(x: Column, y: Column, scale: Column, px: Column, py: Column, closer: bool) -> dict[str, Column]:
    """The world's point under the pointer stays where it is."""
    new = _clamped(scale * (1.1 if closer else 0.9))
    return {"x": x + px / scale - px / new, "y": y + py / scale - py / new, "scale": new}


def pan(x: Column, y: Column, scale: Column, dx: Column, dy: Column) -> dict[str, Column]:
    return {"x": x - dx / scale, "y": y - dy / scale}


def centre_on(wx: Column, wy: Column, scale: Column, width: float, height: float) -> dict[str, Column]:
    return {"x": wx - width / scale / 2, "y": wy - height / scale / 2}


def fit(bounds: DataFrame, width: float, height: float, pad: float = PAD) -> DataFrame:
    """x, y, scale that show all of min_x..max_y with padding."""
    w, h = F.col("max_x") - F.col("min_x") + 2 * pad, F.col("max_y") - F.col("min_y") + 2 * pad
    b = bounds.where((w != 0) & (h != 0)).withColumn("scale", _clamped(F.least(width / w, height / h)))
    middle = lambda lo, hi: F.col(lo) + (F.col(hi) - F.col(lo)) / 2
    return b.select((middle("min_x", "max_x") - width / F.col("scale") / 2).alias("x"), (middle("min_y", "max_y") - height / F.col("scale") / 2).alias("y"), "scale")


def dashes(edges: DataFrame, dash: float = 6.0, gap: float = 4.0) -> DataFrame:
    """id, segment, nth, x1, y1, x2, y2: the dashes of each straight piece of the edges' points (array of x, y); pieces without length have none."""
    ends = F.transform(F.slice("points", 2, F.size("points")), lambda p, k: F.struct(F.get("points", k).alias("a"), p.alias("b")))
    piece = edges.select("id", F.posexplode(F.when(F.size("points") > 1, ends)).alias("segment", "e")).select("id", "segment", *[F.col(f"e.{end}.{c}").alias(f"{c}{n}") for end, n in (("a", 0), ("b", 9)) for c in "xy"])
    length = F.sqrt(F.pow(F.col("x9") - F.col("x0"), 2) + F.pow(F.col("y9") - F.col("y0"), 2))
    # whole periods, and one more where something is left
    each = piece.withColumn("len", length).where("len > 0").withColumn("nth", F.explode(F.sequence(F.lit(0), F.floor(F.col("len") / (dash + gap)).cast("int")))).withColumn("from", F.col("nth") * (dash + gap)).where("from < len")
    at = lambda d, c: F.col(f"{c}0") + (F.col(f"{c}9") - F.col(f"{c}0")) * (d / F.col("len"))
    to = F.least("len", F.col("from") + dash)
    return each.select("id", "segment", "nth", at(F.col("from"), "x").alias("x1"), at(F.col("from"), "y").alias("y1"), at(to, "x").alias("x2"), at(to, "y").alias("y2"))


def curves(edges: DataFrame) -> DataFrame:
    """id, nth, kind, points: what draws an edge's points: a line through two, a cubic curve through four, else quadratic curves and a line to the last."""
    n, p = F.size("points"), lambda k: F.get("points", k)
    step = lambda kind, *points: F.struct(F.lit(kind).alias("kind"), F.array(*points).alias("points"))
    middle = lambda a, b: F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    rest = F.transform(F.sequence(F.lit(1), n - 2), lambda k: step("quadratic", p(k), middle(p(k), p(k + 1))))
    drawn = F.when(n == 2, F.array(step("line", p(F.lit(1))))).when(n == 4, F.array(step("cubic", *[p(F.lit(k)) for k in (1, 2, 3)]))).when(n > 2, F.array_append(rest, step("line", p(n - 1))))
    return edges.select("id", F.posexplode(drawn).alias("nth", "d")).select("id", "nth", "d.kind", "d.points")
