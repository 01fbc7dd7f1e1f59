"""Cases of single operators on small frames."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from heritree.functions import ids, text
from heritree.operators import geo, graph, ingest, layout, queue, search, spatial
from heritree.sources import config, profiles, schemas, snapshots

RAW = "id int, wiki_id string, name string, generation int, father_wiki_id string, mother_wiki_id string"


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


def test_years(spark):
    assert column(spark, text.parse_year, ["1850", "about 1850", "12345", "1850-1860", "", None, "N/A", "12"]) == [1850, 1850, 1234, 1850, None, None, None, None]
    assert column(spark, text.year_start, ["1850-01-02", "about 1850", None]) == ["1850", None, None]


def test_location_keys(spark):
    given = ["  Berks County ,Pennsylvania ", "BERKS  COUNTY,\tPENNSYLVANIA.", "Berks\xa0County, Pennsylvania;.", "", None, ",,", ".", "Paris"]
    assert column(spark, text.location_key, given) == ["berks county, pennsylvania"] * 3 + [None, None, ", ", None, "paris"]


def test_names(spark):
    people = [("Ann", "B.", "Cole", "Dane", "Jr", "Cole-1"), ("", None, "", "Dane", None, "Dane-1"), (None, None, None, None, None, "X-1"), (None,) * 6]
    df = spark.createDataFrame(people, "a string, b string, c string, d string, e string, f string")
    assert [r[0] for r in df.select(text.full_name(*map(F.col, "abcdef"))).collect()] == ["Ann B. Cole Jr", "Dane", "X-1", "Unknown"]
    assert column(spark, text.gender_code, ["Male", "Female", "x", None]) == ["M", "F", "U", "U"]
    assert column(spark, text.profile_date, ["0000-00-00", "", None, "1850-00-00"]) == [None, None, None, "1850-00-00"]
    assert column(spark, lambda c: text.truncate_text(c, 67, 12), ["short", "exactly te", "a longer one"]) == ["short", "exactly te", "a longe..."]


def test_small_functions(spark):
    assert column(spark, text.valid_id, ["5", "0", "", None, "A-1"]) == [True, False, False, False, True]
    assert column(spark, text.start_id_format, ["Abc-12", "Abc12", "Ab c-1"]) == [True, False, False]
    assert column(spark, text.number_text, [40.0, -75.5, 0.0, -0.0], "float") == ["40", "-75.5", "0", "0"]
    assert column(spark, text.half_up, [0.5, 1.5, -0.5], "double") == [1, 2, 0]
    assert column(spark, text.detail_level, [0.7, 0.6, 0.25], "double") == ["full", "medium", "minimal"]
    assert column(spark, text.marker_radius, [1, 16, 100], "long") == [4.0, 12.0, 20.0]
    assert column(spark, lambda c: text.marker_colour(F.lit(1900), c), [1901, 1890, 1860, 1800, None], "int") == ["gray", "green", "blue", "purple", "gray"]
    assert column(spark, lambda c: text.parse_backup_stamp(c), ["2026-01-07T12-00-00"]) == ["2026:01:07 12:00:00"]
    assert column(spark, text.megabytes, [1572864], "long") == [1.5]


def test_ids_of_polymorphic_lists(spark):
    given = ['[{"Name":"A-1"},{"Name":"B-2"}]', '{"20":{},"x":1,"3":{}}', '[{"Name":"A-1"},null,"text",7,{}]', "[]", "{}", None, "5", "broken"]
    assert column(spark, ids.extract_ids, given) == [["A-1", "B-2"], ["3", "20", "x"], ["A-1"], [], [], [], [], []]
    assert column(spark, lambda c: ids.parent_id(c, "$.Father"), ['{"Father":12}', '{"Father":"12"}', '{"Father":0}', '{"Father":null}', "{}"]) == ["12", "12", None, None, None]


@pytest.fixture(scope="module")
def family(spark):
    rows = [(1, "F", "Father", None, None, None), (2, "M", "Mother", None, None, None), (3, "C1", "Child a", None, "F", "M"), (4, "C2", "Child b", None, "F", "M"), (5, "G", "Grandchild", None, "C1", "gone"), (6, "Z", "Alone", 7, None, None)]
    return spark.createDataFrame(rows, RAW).withColumns({c: F.lit(None).cast("string") for c in ("first_name", "middle_name", "last_name_birth", "last_name_current", "suffix", "gender", "birth_date", "death_date", "birth_location", "death_location")} | {"wiki_numeric_id": F.col("id") + 100, "is_living": F.lit(False)})


def test_graph(spark, family):
    a = {r.wiki_id: (r.parents, r.children, r.spouses) for r in graph.adjacency(family).collect()}
    assert a["F"] == ([], ["C1", "C2"], ["M"]) and a["C1"] == (["F", "M"], ["G"], []) and a["G"] == (["C1"], [], []) and a["Z"] == ([], [], [])
    assert {r.wiki_id: r.gen for r in graph.generations(family, "F").collect()} == {"F": 0, "M": 0, "C1": 1, "C2": 1, "G": 2, "Z": 7}
    assert {r.wiki_id: r.gen for r in graph.generations(family, "G").collect()} == {"F": 0, "M": 0, "C1": 1, "C2": 1, "G": 2, "Z": 9}
    for how in ({}, {"recursive": True}):
        assert sorted((r.wiki_id, r.tree_depth) for r in graph.descendants(family, "F", 3, **how).collect()) == [("C1", 1), ("C2", 1), ("F", 0), ("G", 2)]
        assert sorted((r.wiki_id, r.tree_depth) for r in graph.ancestors(family, "G", 3, **how).collect()) == [("C1", 1), ("F", 2), ("G", 0), ("M", 2)]
    relationships = spark.createDataFrame([(1, 2, "spouse"), (2, 1, "spouse"), (1, 3, "child")], "person_id int, related_person_id int, relationship_type string")
    person = graph.get_person(family, relationships, "F").first()
    assert person.person.name == "Father" and person.father is None and [c.wiki_id for c in person.children] == ["C1", "C2"] and [s.wiki_id for s in person.spouses] == ["M"]
    with pytest.raises(graph.NotFound):
        graph.get_person(family, relationships, "nobody")
    numbered = family.withColumn("father_wiki_id", F.when(F.col("wiki_id") == "C2", "101").otherwise(F.col("father_wiki_id")))
    assert {r.wiki_id: r.father_wiki_id for r in graph.resolve_parents(numbered).collect()}["C2"] == "F"


def test_a_bag_counts_paths(spark, family):
    both = family.unionByName(family.where("wiki_id = 'G'").withColumns({"wiki_id": F.lit("H"), "father_wiki_id": F.lit("C1"), "mother_wiki_id": F.lit("C2")}))
    for how in ({}, {"recursive": True}):
        assert sorted(r.wiki_id for r in graph.descendants(both, "F", 3, **how).where("tree_depth = 2").collect()) == ["G", "H", "H"]
    assert graph.lineage_count(both, "F", 3).first().total == 6
    loop = spark.createDataFrame([("A", "B", None), ("B", "A", None)], "wiki_id string, father_wiki_id string, mother_wiki_id string")
    assert graph.walk(loop, "A", 10).agg(F.sum("paths")).first()[0] == 11


@pytest.mark.parametrize("bad", [{"depth": 0}, {"depth": 11}])
def test_bounds_of_arguments(family, bad):
    with pytest.raises(ValueError):
        graph.descendants(family, "F", **bad)
    with pytest.raises(ValueError):
        search.search_persons(family, limit=101)


def test_empty_ids_are_rejected(family):
    for f in (graph.walk, graph.recursive_walk):
        with pytest.raises(graph.BadRequest):
            f(family, "", 3)
    assert graph.NotFound("X-1").args == ("Person 'X-1' not found",) and graph.DatabaseError("getStats").code == "INTERNAL_SERVER_ERROR"


def test_views_of_all_tables(spark):
    schemas.register(spark, {"persons": spark.createDataFrame([(1, "A")], "id int, wiki_id string")})
    assert spark.sql("select wiki_id, name from persons").first() == ("A", None) and spark.sql("select * from crawl_queue").count() == 0
    for name in schemas.TABLES:
        spark.catalog.dropTempView(name)


def test_a_layout_that_takes_too_long_is_cancelled(spark, family):
    assert layout.timed_layout(family, "F", 120).count() == 6
    with pytest.raises(TimeoutError):
        layout.timed_layout(family.repartition(3), "G", 0.01)


def brute_generations(people, seed):
    """people: (id, wiki_id, generation, father, mother) in order. Breadth first, first in, first out."""
    ids = {p[1]: p for p in people}
    parents = {w: [x for x in dict.fromkeys(p[3:5]) if x in ids] for w, p in ids.items()}
    children, mates = {w: [] for w in ids}, {w: set() for w in ids}
    for p in people:
        for x in parents[p[1]]:
            children[x].append(p[1])
        if len(parents[p[1]]) == 2:
            a, b = parents[p[1]]
            mates[a].add(b), mates[b].add(a)
    gen, line = {seed: 0}, [seed]
    for w in line:
        for other, step in [*((x, 0) for x in sorted(mates[w], key=lambda x: ids[x][0])), *((x, 1) for x in children[w]), *((x, -1) for x in parents[w])]:
            if other not in gen:
                gen[other] = gen[w] + step
                line.append(other)
    for p in people:
        gen.setdefault(p[1], p[2] or 0)
    least = min(gen.values())
    return {w: g - least for w, g in gen.items()}, parents, children, mates


def brute_layout(people, seed):
    """people with a name as the last. The recurrences, one node after another."""
    gen, parents, children, mates = brute_generations(people, seed)
    names = {p[1]: p[5] for p in people}
    rows, unit = {}, {}
    for g in sorted(set(gen.values())):
        line, done = [], set()
        for w in sorted((w for w in gen if gen[w] == g), key=lambda w: (-len(children[w]), names[w].lower(), w)):
            if w not in done:
                for m in [w, *sorted(x for x in mates[w] if gen[x] == g and x not in done)]:
                    line.append(m), done.add(m)
                    unit[m] = w
        rows[g] = line
    step = lambda a, b: 180.0 + (20 if b in mates[a] else 40)
    x = {}
    for line in rows.values():
        at = 0.0
        for w, after in zip(line, [*line[1:], None]):
            x[w] = at
            at += step(w, after) if after else 0
    for g in sorted(rows, reverse=True)[1:]:
        for head in dict.fromkeys(unit[w] for w in rows[g]):
            members = [w for w in rows[g] if unit[w] == head]
            centres = [x[c] + 90 for w in members for c in children[w]]
            if centres:
                shift = sum(centres) / len(centres) - (min(x[w] for w in members) + max(x[w] for w in members) + 180) / 2
                for w in members:
                    x[w] += shift
        line = sorted(rows[g], key=lambda w: (x[w], rows[g].index(w)))
        for a, b in zip(line, line[1:]):
            x[b] = max(x[b], x[a] + step(a, b))
    return gen, x, unit


def test_generations_and_layout_are_brute_force(spark, sf_dir):
    from heritree.sources import fixtures as fx

    persons = fx.persons(spark, sf_dir)
    people = [tuple(r) for r in persons.orderBy("id").select("id", "wiki_id", "generation", "father_wiki_id", "mother_wiki_id", "name").collect()]
    assert {r.wiki_id: r.gen for r in graph.generations(persons, fx.ROOT).collect()} == brute_generations(people, fx.ROOT)[0]
    gen, x, unit = brute_layout(people, fx.ROOT)
    placed = {r.wiki_id: r for r in layout.layout(persons, fx.ROOT).collect()}
    assert {w: (r.gen, r.unit) for w, r in placed.items()} == {w: (gen[w], unit[w]) for w in gen}
    assert {w: round(r.x, 6) for w, r in placed.items()} == {w: round(v, 6) for w, v in x.items()}


def test_last_row_of_a_node_counts(spark):
    rows = spark.createDataFrame([("A", "old", 1), ("B", "b", 2), ("A", "new", 3)], "wiki_id string, name string, pos int")
    assert sorted(tuple(r) for r in graph.nodes(rows).collect()) == [("A", "new", 1), ("B", "b", 2)]


def test_the_layout_broadcasts_no_table_of_persons(spark, sf_dir, monkeypatch):
    from heritree.sources import fixtures as fx

    plans, kept = [], layout.stored

    def stored(df, name):
        if name == "layout":  # a generation moved over its children
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(layout, "stored", stored)
    layout.layout(fx.persons(spark, sf_dir), fx.ROOT)
    assert plans
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert all("piece#" in line for line in joins)  # a generation's pieces, as many as it has tasks


def test_layout(spark, family):
    placed = layout.layout(family.where("wiki_id <> 'Z'"), "F")
    at = {r.wiki_id: (r.gen, r.x, r.y) for r in placed.collect()}
    assert {w: v[2] for w, v in at.items()} == {"F": 0.0, "M": 0.0, "C1": 170.0, "C2": 170.0, "G": 340.0}
    assert at["M"][1] - at["F"][1] == 200.0 and at["C1"][1] == at["G"][1] == 0.0 and at["C2"][1] == 220.0
    assert (at["F"][1] + at["M"][1] + 180) / 2 == (at["C1"][1] + at["C2"][1] + 180) / 2
    assert layout.layout(family.where("false"), "F").count() == 0
    box = layout.bounds(placed).first()
    assert (box.min_y, box.max_y) == (0.0, 410.0)
    edges = {r.id: r.points for r in layout.parent_child_edges(placed, graph.present_edges(family)).collect()}
    assert set(edges) == {"F->C1", "F->C2", "M->C1", "M->C2", "C1->G"} and [p.y for p in edges["C1->G"]] == [240.0, 290.0, 290.0, 340.0]
    assert [r.id for r in layout.spouse_edges(placed, graph.spouses(family)).collect()] == ["F<=>M"]


def test_overlaps_follow_the_recurrence(spark):
    xs = [0, 10, 500, 510, 520, 3000]
    rows = spark.createDataFrame([(0, f"n{k}", k, float(x)) for k, x in enumerate(xs)], "gen int, wiki_id string, pos int, x double")
    pairs = spark.createDataFrame([("n2", "n3"), ("n3", "n2")], "a string, b string")
    expected = []
    for k, x in enumerate(xs):
        gap = 20 if k == 3 else 40
        expected.append(float(x) if not k else max(float(x), expected[-1] + 180 + gap))
    assert [r.x for r in layout.resolve_overlaps(rows, pairs).orderBy("pos").collect()] == expected


def test_boxes(spark):
    nodes = spark.createDataFrame([(f"n{i:04}", float(i % 50 * 120), float(i // 50 * 80)) for i in range(1000)], "wiki_id string, x double, y double")
    for cell in (None, 500.0):
        b = spatial.boxes(nodes, 100, 60, cell)
        hits = {r.wiki_id for r in spatial.rect_query(b, 100, 60, 700, 220, cell, 100).collect()}
        assert hits == {f"n{i:04}" for i in range(1000) if i % 50 * 120 <= 700 and i % 50 * 120 + 100 >= 100 and i // 50 * 80 <= 220 and i // 50 * 80 + 60 >= 60}
    assert spatial.point_query(spatial.boxes(nodes, 100, 60), 125, 5).first().wiki_id == "n0001"
    assert spatial.point_query(spatial.boxes(nodes, 100, 60), -5, -5).count() == 0
    lines = spark.createDataFrame([("e", [(0.0, 0.0), (23.0, 0.0), (23.0, 10.0), (23.0, 10.0)]), ("one", [(1.0, 1.0)])], "id string, points array<struct<x:double,y:double>>")
    dashes = [(r.segment, r.x1, r.x2, r.y1, r.y2) for r in spatial.dashes(lines).orderBy("segment", "nth").collect()]
    assert dashes == [(0, 0.0, 6.0, 0.0, 0.0), (0, 10.0, 16.0, 0.0, 0.0), (0, 20.0, 23.0, 0.0, 0.0), (1, 23.0, 23.0, 0.0, 6.0)]
    more = spark.createDataFrame([("2", [(0.0, 0.0), (2.0, 0.0)]), ("4", [(0.0, 0.0)] * 4), ("5", [(float(k), 0.0) for k in range(5)]), ("1", [(0.0, 0.0)])], "id string, points array<struct<x:double,y:double>>")
    drawn = [(r.id, r.kind, [p.x for p in r.points]) for r in spatial.curves(more).orderBy("id", "nth").collect()]
    assert drawn == [("2", "line", [2.0]), ("4", "cubic", [0.0, 0.0, 0.0]), ("5", "quadratic", [1.0, 1.5]), ("5", "quadratic", [2.0, 2.5]), ("5", "quadratic", [3.0, 3.5]), ("5", "line", [4.0])]


def test_clusters(spark):
    rows = [(1, "A", "Ann", None, None, 1850, "Male", 40.0, -75.0, None, "PA", ""), (2, "B", None, "Bob", "Lee", None, None, 40.0, -75.0, "x", "PA", "y"), (3, "C", "", "", "", None, "Female", 1.5, 2.0, None, None, None)]
    df = spark.createDataFrame(rows, "person_id int, wiki_id string, name string, first_name string, last_name string, birth_year int, gender string, latitude float, longitude float, location_name string, state string, city string")
    out = {r.id: r for r in geo.clusters(df).collect()}
    assert out["40,-75"].person_count == 2 and out["40,-75"].location_name == "PA" and [p.name for p in out["40,-75"].persons] == ["Ann", "Bob Lee"]
    assert (out["1.5,2"].min_year, out["1.5,2"].max_year, out["1.5,2"].location_name, out["1.5,2"].persons[0].name) == (9999, 0, "Unknown", None)
    assert tuple(geo.year_range(df.where("person_id = 3")).first()) == (1700, 1900)
    assert geo.in_years(df, 1900).count() == 2


def test_queue(spark):
    q = spark.createDataFrame([(1, "A", "pending", 0, 5), (2, "B", "pending", None, 9), (3, "C", "processing", 9, 1), (4, "D", "pending", None, 2)], "id int, wiki_id string, status string, priority int, created_at int")
    assert [r.wiki_id for r in queue.dequeue(q, 3).collect()] == ["D", "B", "A"]
    batch = spark.createDataFrame([("A", 1, 1), ("E", 2, 2), ("E", 9, 3), ("F", 1, 4)], "wiki_id string, priority int, seq long")
    assert [(r.wiki_id, r.priority) for r in queue.enqueue(q, batch, spark.createDataFrame([("F",)], "wiki_id string")).collect()] == [("E", 2)]
    again, n = queue.reset_processing(q)
    assert n.first()[0] == 1 and again.where("status = 'processing'").count() == 0 and not queue.is_empty(q)
    events = [("A", 1, "processing", None), ("A", 2, "error", "first"), ("A", 3, "processing", None), ("A", 4, "completed", None)]
    df = spark.createDataFrame(events, "wiki_id string, seq long, event string, message string").withColumn("at", F.col("seq"))
    assert tuple(queue.fold_events(df).first()) == ("A", "completed", 1, "first", 4)


def test_ingest(spark):
    raw = [('{"Id":7,"Name":"Cole-1","FirstName":"Ann","LastNameAtBirth":"Cole","BirthLocation":"Berks ,PA","IsLiving":1,"Father":12,"Mother":"0","Spouses":{"9":{}},"Children":[{"Name":"X-1"}]}', 1), ('{"FirstName":"no name"}', 2), ("broken", 3)]
    p = ingest.profiles(spark.createDataFrame(raw, "json string, seq long")).collect()
    assert [(r.wiki_id, r.wiki_numeric_id, r.name, r.birth_location_key, r.is_living, r.father_wiki_id, r.mother_wiki_id, r.spouse_ids, r.child_ids) for r in p] == [("Cole-1", 7, "Ann Cole", "berks, pa", True, "12", None, ["9"], ["X-1"])]
    target = spark.createDataFrame([(1, "A", "old", "s"), (2, "B", "b", None)], "id int, wiki_id string, name string, suffix string")
    source = spark.createDataFrame([("A", 1, "mid", "x"), ("A", 2, "new", None), ("C", 3, "c", None)], "wiki_id string, seq long, name string, suffix string")
    once = ingest.upsert(target, source)
    assert sorted(tuple(r) for r in once.where("id is not null").collect()) == [(1, "A", "new", None), (2, "B", "b", None)] and once.count() == 3
    assert sorted(map(tuple, ingest.upsert(once, source).select("wiki_id", "name").collect())) == sorted(map(tuple, once.select("wiki_id", "name").collect()))
    assert ingest.upsert(target, source, merge="coalesce").where("wiki_id = 'A'").first().suffix == "x"
    there = spark.createDataFrame([("Raw A", "a")], "raw_location string, location_key string")
    batch = spark.createDataFrame([("Raw A", "a", 1), ("RAW a", "a", 2), ("B", "b", 3), ("b ", "b", 4), (".", None, 5), (",", None, 6)], "raw_location string, location_key string, seq long")
    assert sorted(r.raw_location for r in ingest.insert_ignore_locations(there, batch).collect()) == [",", ".", "B"]
    gazetteer = spark.createDataFrame([("B", 40.0, -75.0, [("country.1", "US"), ("region.1", "PA"), ("region.2", "NJ"), ("place.3", "Town")])], "raw_location string, latitude double, longitude double, context array<struct<id:string,text:string>>").withColumn("place_name", F.lit("B, USA"))
    got = ingest.geocode(spark.createDataFrame([("B", "b")], "raw_location string, location_key string"), gazetteer).first()
    assert (got.country, got.state, got.city, got.normalized_name) == ("US", "NJ", "Town", "B, USA")
    raw = spark.createDataFrame([("B",), ("  ",), (None,), ("Raw A",), ("unknown",)], "raw_location string")
    assert [r.raw_location for r in ingest.geocode_if_needed(there, raw, gazetteer).collect()] == ["B"] and ingest.geocode_if_needed(there, raw, None).count() == 0
    odd = [('{"Name":""}',), ('{"Name":"A-1","IsLiving":"1"}',), ('{"Name":"B-1","IsLiving":true}',), ('{"Name":"C-1","IsLiving":1,"Suffix":""}',), ('{"Name":"D-1","IsLiving":0}',)]
    assert [(r.wiki_id, r.is_living, r.suffix) for r in ingest.profiles(spark.createDataFrame(odd, "json string")).orderBy("wiki_id").collect()] == [("A-1", False, None), ("B-1", False, None), ("C-1", True, ""), ("D-1", False, None)]
    old = [("A-1", '{"id":5,"name":"","generation":3,"father_id":"0","mother_id":0,"is_living":1,"birth_location":"X ,Y"}'), ("B-1", '{"father_id":12,"mother_id":""}')]
    got = {r.wiki_id: r for r in ingest.legacy_persons(spark.createDataFrame(old, "wiki_id string, json string")).collect()}
    assert (got["A-1"].wiki_numeric_id, got["A-1"].name, got["A-1"].generation, got["A-1"].father_wiki_id, got["A-1"].mother_wiki_id, got["A-1"].is_living, got["A-1"].birth_location_key) == (5, "", 3, "0", None, True, "x, y")
    assert (got["B-1"].father_wiki_id, got["B-1"].mother_wiki_id, got["B-1"].name) == ("12", None, None)
    keyed = ingest.backfill_location_keys(spark.createDataFrame([(1, "A,b", None), (2, "a, B", None)], "id int, raw_location string, location_key string"))
    assert {r.id: r.location_key for r in keyed.collect()} == {1: "a, b", 2: None}


def test_constraints(spark):
    df = spark.createDataFrame([(1, "A", "pending"), (1, "B", "odd"), (2, None, "error")], "id int, wiki_id string, status string")
    assert {r.constraint: r.rows for r in schemas.violations(df, "crawl_queue").collect()} == {"unique id": 1, "not null wiki_id": 1, "values status": 1}


def test_responses(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"profile":{"Name":"A-1","Id":1,"Secret":2}}]')
    (tmp_path / "b.json").write_text("[{}]")
    (tmp_path / "c.json").write_text('[{"descendants":[{"Name":"B-1"},{"Name":"C-1"}]}]')
    raw = profiles.responses(spark, str(tmp_path))
    one = profiles.unpack(raw, "profile")
    assert one.count() == 1 and set(profiles.projected(one, "profile").first().fields) == {"Name", "Id"}
    assert profiles.unpack(raw, "descendants").count() == 2 and profiles.unpack(raw, "ancestors").count() == 0
    bad = spark.createDataFrame([("{broken",)], "json string")
    assert profiles.decode(bad, "Name string").first().doc._corrupt == "{broken"
    with pytest.raises(Exception):
        profiles.decode(bad, "Name string", strict=True).collect()
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "p.json").write_text('{"visited":["A"],"queue":["B","C","B"],"persons":{"A":{"Name":"A"}}}')
    visited, todo, persons = profiles.legacy_import(spark, str(tmp_path / "old"))
    assert sorted((r.wiki_id, r.status) for r in queue.import_queue(todo, visited).collect()) == [("A", "completed"), ("B", "pending"), ("C", "pending")] and persons.first().json == '{"Name":"A"}'


def test_request_policy():
    slept, now = [], [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    p = profiles.Policy(delay=1.0, max_retries=2, sleep=sleep, clock=lambda: now[0])
    answers = iter([profiles.TooManyRequests(5), OSError("net"), "[]"])

    def get(_):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert list(profiles.fetch_all(["x"], get, p)) == [("x", "[]", None)] and slept[0] == 5
    failed = list(profiles.fetch_all(["y"], lambda _: (_ for _ in ()).throw(OSError("down")), p))
    assert failed[0][2] == "down" and slept[-1] == 2.0


def test_config():
    c = config.from_env({"CRAWLER_START_ID": "Abc-1", "CRAWLER_CRAWL_PARENTS": "true", "CRAWLER_SAVE_INTERVAL": "7"})
    assert c.crawl_parents and (c.save_interval, c.export_interval, c.request_delay_ms, c.max_retries, c.geocode_after_crawl, c.geocoder_token) == (7, 500, 1000, 3, True, None)
    assert config.Config("A-1").save_interval == 25 and not config.from_env({"CRAWLER_GEOCODE_AFTER_CRAWL": "false"}).geocode_after_crawl
    for bad in ({"START_ID": "nonsense"}, {"START_ID": "A-1\n"}, {"BACKUP_DIR": ""}, {"SAVE_INTERVAL": "0"}, {"MAX_RETRIES": "-1"}, {"REQUEST_DELAY_MS": "nan"}):
        with pytest.raises(ValueError):
            config.from_env({f"CRAWLER_{k}": v for k, v in bad.items()})


def test_snapshots(spark, tmp_path):
    tables = {"persons": spark.range(5).withColumnRenamed("id", "x"), "locations": spark.range(2)}
    folder = f"file://{tmp_path}/backups"
    for day in (1, 2):
        snapshots.backup(tables, folder, datetime(2026, 1, day, 12))
    found = snapshots.backups(spark, folder)
    assert [t for t, _ in found] == ["2026-01-02T12-00-00", "2026-01-01T12-00-00"]
    target = f"file://{tmp_path}/live"
    for _ in range(2):
        assert snapshots.restore(spark, found[0][1], target) == {"persons": 5, "locations": 2}
    with pytest.raises(FileNotFoundError):
        snapshots.restore(spark, f"file://{tmp_path}/none", target)
    assert spark.read.parquet(f"{target}/persons").count() == 5
    cache = snapshots.SnapshotCache(spark)
    cache.load(found[0][1])
    assert cache.states == ["checking", "fetching", "loading", "ready"]
    cache.load(found[0][1])
    assert cache.states == ["checking", "ready"]
    cache.clear()
    assert snapshots.export_due(100, 95, 10, 100) and not snapshots.export_due(101, 95, 10, 100) and not snapshots.export_due(110, 105, 10, 100)
    assert snapshots.pre_crawl_backup(tables, "nosuch://place")[1].startswith("backup failed")


def test_queue_stream(spark, tmp_path):
    from heritree.streaming import queue_stream

    schema = "wiki_id string, seq long, event string, priority int, message string"
    batches = [[("A", 1, "enqueue", 2, None), ("B", 2, "enqueue", 1, None)], [("A", 3, "enqueue", 9, None), ("A", 4, "error", None, "oops"), ("C", 5, "enqueue", None, None)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = queue_stream.queue_state(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.wiki_id: (r.status, r.priority, r.retry_count, r.error_message) for r in queue_stream.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"A": ("error", 2, 1, "oops"), "B": ("pending", 1, 0, None), "C": ("pending", 0, 0, None)}
    seen = []
    items = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    queue_stream.run_crawl(items, lambda df: df.withColumn("error", F.when(F.col("event") == "error", F.col("message"))), str(tmp_path / "res"), str(tmp_path / "cp2"), lambda n, c: seen.append(c)).awaitTermination()
    assert sum(seen) == 5 and spark.read.parquet(str(tmp_path / "res")).where("error is not null").count() == 1
