"""Parent graph: traversals, relatives, generations.

"Parent is father or mother" is a disjunctive condition that Spark could only run as a nested-loop join. All joins here
go over an edge table (child, parent, role), one row for each filled parent column, and so are equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored, stored_rows
from . import edge_index

ROW = ["id", "wiki_id", "wiki_numeric_id", "name", "first_name", "middle_name", "last_name_birth", "last_name_current", "suffix", "gender", "birth_date", "death_date", "birth_location", "death_location", "is_living", "father_wiki_id", "mother_wiki_id"]
MAX_DEPTH, MAX_LIMIT = 10, 500


class NotFound(LookupError):
    """No person has that id."""

    code = "NOT_FOUND"

    def __init__(self, identifier: str, resource: str = "Person") -> None:
        super().__init__(f"{resource} '{identifier}' not found")


class BadRequest(ValueError):
    """An argument out of its bounds."""

    code = "BAD_REQUEST"


class DatabaseError(RuntimeError):
    """A failed operation, named without its cause; the cause is chained."""

    code = "INTERNAL_SERVER_ERROR"

    def __init__(self, operation: str) -> None:
        super().__init__(f"Database operation failed: {operation}")


def edges(persons: DataFrame) -> DataFrame:
    """child, parent, role (0 father, 1 mother). A person whose father and mother are the same has one edge for the traversals' OR."""
    both = F.array(F.struct(F.col("father_wiki_id").alias("parent"), F.lit(0).alias("role")), F.struct(F.col("mother_wiki_id").alias("parent"), F.lit(1).alias("role")))
    return persons.select(F.col("wiki_id").alias("child"), F.explode(both).alias("e")).select("child", "e.parent", "e.role").where("parent is not null")


def _check(depth: int, limit: int = 1, offset: int = 0, seed: str = "-") -> None:
    if not seed:
        raise BadRequest("an id must not be empty")
    if not 1 <= depth <= MAX_DEPTH or not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise BadRequest(f"depth must be 1 to {MAX_DEPTH}, limit 1 to {MAX_LIMIT}, offset 0 or more")


def walk(persons: DataFrame, seed: str, depth: int, up: bool = False, index: edge_index.EdgeIndex | None = None) -> DataFrame:
    """wiki_id, tree_depth, paths: the recursion's bag, as the number of rows that each person has at each depth.

    Counting paths keeps a level as small as the number of its persons, where the bag doubles with every pedigree collapse.
    With an index of the persons' edges nothing but levels is read or written; without one the edges are written first.
    """
    _check(depth, seed=seed)
    if index:
        return edge_index.walk(index, seed, depth, up)
    # one narrow row for each person; a step joins the level with all edges once, and levels are small beside them
    narrow = persons.select("wiki_id", "father_wiki_id", "mother_wiki_id")
    e = edges(narrow).select("child", "parent").distinct()
    step, to = ("child", "parent") if up else ("parent", "child")
    if up:  # parents that aren't persons of the table lead nowhere
        e = e.join(narrow.select(F.col("wiki_id").alias("parent")), "parent", "left_semi")
    e = stored(e.select(F.col(step).alias("from_id"), F.col(to).alias("to_id")), "walk-edges")
    level = narrow.where(F.col("wiki_id") == seed).select("wiki_id", F.lit(1).cast("long").alias("paths"), F.lit(0).alias("tree_depth"))
    # father and mother in the frontier give a child two rows only where they are different persons' rows: a sum over edges
    levels = [level := stored(level, "walk-level")]
    for d in range(1, depth + 1):
        step = level.join(e, F.col("wiki_id") == F.col("from_id")).groupBy(F.col("to_id").alias("wiki_id")).agg(F.sum("paths").alias("paths"))
        level, n = stored_rows(step.withColumn("tree_depth", F.lit(d)), "walk-level")
        if not n:
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def recursive_walk(persons: DataFrame, seed: str, depth: int, up: bool = False) -> DataFrame:
    """The bag itself, by one recursive query over narrow rows; Spark bounds it at 100 levels and a million rows."""
    _check(depth, seed=seed)
    e = edges(persons).select("child", "parent").distinct()
    step, to = ("child", "parent") if up else ("parent", "child")
    return persons.sparkSession.sql(
        f"""WITH RECURSIVE walk(wiki_id, tree_depth) AS (
              SELECT wiki_id, 0 FROM {{persons}} WHERE wiki_id = :seed
              UNION ALL
              SELECT e.{to}, w.tree_depth + 1 FROM walk w JOIN {{edges}} e ON e.{step} = w.wiki_id WHERE w.tree_depth < :depth)
            SELECT * FROM walk""",
        args={"seed": seed, "depth": depth}, persons=persons.select("wiki_id"), edges=e,
    )


def lineage(persons: DataFrame, seed: str, depth: int = 3, up: bool = False, distinct: bool = False, recursive: bool = False, index: edge_index.EdgeIndex | None = None) -> DataFrame:
    """Person columns and tree_depth, a row for each path; distinct: one for each person, at its smallest depth.

    Level by level with path counts, by the index of the persons' edges where there is one; recursive: by Spark's own
    recursion, which stops at a million rows.
    """
    if recursive and not distinct:
        w = recursive_walk(persons, seed, depth, up)
    else:
        w = walk(persons, seed, depth, up, index)
        if distinct:
            w = w.groupBy("wiki_id").agg(F.min("tree_depth").alias("tree_depth"))
        else:
            w = w.select("wiki_id", "tree_depth", F.explode(F.sequence(F.lit(1), F.col("paths")))).drop("col")
    return persons.select(*ROW).join(w, "wiki_id").select(*ROW, F.col("tree_depth").cast("int").alias("tree_depth"))


def descendants(persons: DataFrame, seed: str, depth: int = 3, **how) -> DataFrame:
    return lineage(persons, seed, depth, **how)


def ancestors(persons: DataFrame, seed: str, depth: int = 3, **how) -> DataFrame:
    return lineage(persons, seed, depth, up=True, **how)


def page(rows: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """The page by depth and name (nulls last, then wiki_id as a tiebreak), with the total on every row; one traversal gives both."""
    _check(1, limit, offset)
    order = [F.col("tree_depth"), F.col("name").asc_nulls_last(), F.col("wiki_id")]
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def lineage_count(persons: DataFrame, seed: str, depth: int = 3, up: bool = False, index: edge_index.EdgeIndex | None = None) -> DataFrame:
    return walk(persons, seed, depth, up, index).agg(F.coalesce(F.sum("paths"), F.lit(0)).cast("long").alias("total"))


def parents_of(persons: DataFrame, wiki_id: str) -> DataFrame:
    """One row: the person with its father's and mother's columns (null where missing); both by left joins on a unique key."""
    side = lambda p: persons.select(F.col("wiki_id").alias(f"{p}_key"), F.struct(*ROW).alias(p))
    me = persons.where(F.col("wiki_id") == wiki_id)
    return me.join(side("father"), F.col("father_wiki_id") == F.col("father_key"), "left").join(side("mother"), F.col("mother_wiki_id") == F.col("mother_key"), "left")


def children_of(persons: DataFrame, wiki_id: str) -> DataFrame:
    return persons.where((F.col("father_wiki_id") == wiki_id) | (F.col("mother_wiki_id") == wiki_id))


def spouses_of(persons: DataFrame, relationships: DataFrame, wiki_id: str) -> DataFrame:
    me = persons.where(F.col("wiki_id") == wiki_id).select(F.col("id").alias("person_id"))
    ids = relationships.where(F.col("relationship_type") == "spouse").join(me, "person_id", "left_semi").select(F.col("related_person_id").alias("id"))
    return persons.join(ids, "id", "left_semi")


def get_person(persons: DataFrame, relationships: DataFrame, wiki_id: str) -> DataFrame:
    """One nested row: person, father, mother, children, spouses; NotFound without one."""
    me = parents_of(persons, wiki_id)
    if me.isEmpty():
        raise NotFound(wiki_id)
    listed = lambda df: df.agg(F.array_sort(F.collect_list(F.struct("wiki_id", "name", "birth_date"))).alias("x"))
    return (
        me.select(F.struct(*ROW).alias("person"), "father", "mother")
        .crossJoin(F.broadcast(listed(children_of(persons, wiki_id)).withColumnRenamed("x", "children")))
        .crossJoin(F.broadcast(listed(spouses_of(persons, relationships, wiki_id)).withColumnRenamed("x", "spouses")))
    )


def resolve_parents(persons: DataFrame) -> DataFrame:
    """Parents that are numbers as text become the wiki_id of the person with that number, where there is one."""
    out = persons
    for c in ("father_wiki_id", "mother_wiki_id"):
        by_number = persons.where("wiki_numeric_id is not null").select(F.col("wiki_numeric_id").cast("string").alias("__n"), F.col("wiki_id").alias("__w"))
        out = out.join(by_number, F.col(c) == F.col("__n"), "left").withColumn(c, F.coalesce("__w", c)).drop("__n", "__w")
    return out


def nodes(raw: DataFrame, position: str = "pos") -> DataFrame:
    """One row for each wiki_id: the last row's values at the first row's position."""
    w = Window.partitionBy("wiki_id")
    return raw.withColumn("__last", F.max(position).over(w)).withColumn("__first", F.min(position).over(w)).where(F.col(position) == F.col("__last")).withColumn(position, F.col("__first")).drop("__last", "__first")


def present_edges(persons: DataFrame) -> DataFrame:
    """Edges whose parent is a person of the table."""
    return edges(persons).join(persons.select(F.col("wiki_id").alias("parent")), "parent", "left_semi").select("child", "parent", "role")


def adjacency(persons: DataFrame, position: str = "id") -> DataFrame:
    """wiki_id, parents (father first), children (distinct, by position), spouses: arrays of ids of persons of the table."""
    e = present_edges(persons)
    at = persons.select(F.col("wiki_id").alias("child"), F.col(position).alias("at"))
    ids = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["id"])
    up = e.groupBy(F.col("child").alias("wiki_id")).agg(ids(F.struct("role", F.col("parent").alias("id"))).alias("parents"))
    down = e.join(at, "child").groupBy(F.col("parent").alias("wiki_id")).agg(F.array_distinct(ids(F.struct("at", F.col("child").alias("id")))).alias("children"))
    s = spouses(persons).groupBy(F.col("a").alias("wiki_id")).agg(F.array_sort(F.collect_list("b")).alias("spouses"))
    none = F.array().cast("array<string>")
    out = persons.select("wiki_id").join(up, "wiki_id", "left").join(down, "wiki_id", "left").join(s, "wiki_id", "left")
    return out.select("wiki_id", *[F.coalesce(c, none).alias(c) for c in ("parents", "children", "spouses")])


def spouses(persons: DataFrame) -> DataFrame:
    """a, b: both parents of some child, both of the table; symmetric, distinct, inferred from children."""
    ids = persons.select(F.col("wiki_id").alias("p"))
    both = persons.where(F.col("father_wiki_id") != F.col("mother_wiki_id")).select("father_wiki_id", "mother_wiki_id").distinct()
    both = both.join(ids, F.col("p") == F.col("father_wiki_id"), "left_semi").join(ids, F.col("p") == F.col("mother_wiki_id"), "left_semi")
    pair = F.explode(F.array(F.struct(F.col("father_wiki_id").alias("a"), F.col("mother_wiki_id").alias("b")), F.struct(F.col("mother_wiki_id").alias("a"), F.col("father_wiki_id").alias("b"))))
    return both.select(pair.alias("p")).select("p.a", "p.b").distinct()


def child_counts(persons: DataFrame) -> DataFrame:
    return present_edges(persons).groupBy(F.col("parent").alias("wiki_id")).agg(F.countDistinct("child").alias("n_children"))


def generations(persons: DataFrame, seed: str, position: str = "id") -> DataFrame:
    """wiki_id, gen: breadth-first from the seed over spouses (same), children (+1), parents (-1); the first visit wins.

    Level by level: the queue's order is (rank of the visiting person, kind of link, place), so each newly seen person
    takes the least of these. Persons never reached have their own generation, or 0. Then the least becomes 0.
    The driver sees one number a level.
    """
    persons = stored(persons.select("wiki_id", "father_wiki_id", "mother_wiki_id", "generation", F.col(position).cast("long").alias("at")), "graph")
    e = present_edges(persons)
    at = persons.select(F.col("wiki_id").alias("b"), "at")
    mates = spouses(persons).select("a", "b", F.lit(0).alias("kind"), F.lit(0).alias("step"))
    down = e.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.lit(1).alias("kind"), F.lit(1).alias("step")).distinct()
    up = e.select(F.col("child").alias("a"), F.col("parent").alias("b"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), F.col("role").cast("long").alias("at"))
    links = stored(mates.unionByName(down).join(at, "b").unionByName(up), "links")
    level = stored(persons.where(F.col("wiki_id") == seed).select("wiki_id", F.lit(0).alias("gen"), F.lit(0).cast("long").alias("rank")), "level")
    seen = level  # the union of the levels' tables; each is written once
    while True:
        best = F.min(F.struct("rank", "kind", "at", (F.col("gen") + F.col("step")).alias("gen")))
        found = level.join(links, level["wiki_id"] == links["a"]).join(seen.select(F.col("wiki_id").alias("b")), "b", "left_anti").groupBy("b").agg(best.alias("o"))
        # the queue's order within the level, for the ties of the next one: numbers that ascend over ranges, with gaps
        order = ["o.rank", "o.kind", "o.at", "b"]
        ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
        level, n = stored_rows(ranged.select(F.col("b").alias("wiki_id"), F.col("o.gen").alias("gen"), F.monotonically_increasing_id().alias("rank")), "level")
        if not n:
            break
        seen = seen.unionByName(level)
    out = persons.select("wiki_id", "generation").join(seen.select("wiki_id", "gen"), "wiki_id", "left").select("wiki_id", F.coalesce("gen", "generation", F.lit(0)).cast("int").alias("gen"))
    least = out.agg(F.min("gen").alias("least"))
    return out.crossJoin(F.broadcast(least)).select("wiki_id", (F.col("gen") - F.col("least")).alias("gen"))
