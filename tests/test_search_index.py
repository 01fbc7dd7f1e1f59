"""The ordered table and the trigram index against full searches, and how many rows they read."""

import random

import pytest
from pyspark.sql import functions as F

from heritree.operators import ordered_table, search, substring_index
from heritree.operators.graph import BadRequest

NAMES = ["Anna", "anne", "Bo", "Zoë", "İlse", "O'Hara", "Le%n", "under_score", "back\\slash", "", "日本語文字", None]
PLACES = ["Berks, Pennsylvania", "berks", "Bern", None, "", "Ulm, Germany", "%"]
COLUMNS = ["wiki_id", *search.NAME_COLUMNS, *search.LOCATION_COLUMNS]


@pytest.fixture(scope="module")
def people(spark):
    draw = random.Random(2)
    rows = []
    for k in range(3000):
        first, last = draw.choice(NAMES), draw.choice([f"House{draw.randrange(60)}", "Meyer", None])
        name = None if k % 50 == 0 else f"{first or ''} {last or ''} {draw.randrange(40)}"
        rows.append((f"P-{k}", name, first, None if k % 3 else "Q", last, last, draw.choice(PLACES), draw.choice(PLACES)))
    rows.append(("P-rare", "the only quixotic one", "Quixote", "", "x", "y", "nowhere special", None))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS)).cache()


@pytest.fixture(scope="module")
def index(people, tmp_path_factory):
    return substring_index.build(people, f"file://{tmp_path_factory.mktemp('search')}/index", rows=400, buckets=4)


def rows(df):
    return [tuple(r[c] for c in [*COLUMNS, "total"]) for r in df.collect()]


@pytest.mark.parametrize("few", [0, 5_000])
@pytest.mark.parametrize(
    "asked",
    [{"query": "house1"}, {"query": "HOUSE"}, {"query": "quixot"}, {"query": "an"}, {"query": "h_use%5"}, {"query": "l_ne%1"}, {"query": "n%n"}, {"query": "zoë"}, {"query": "İlse"}, {"query": "本語文"}, {"query": "no such name"}, {"query": "%"}, {"query": "\\%n"},
     {"location": "berks"}, {"location": "pennsyl", "query": "anna"}, {"location": "special", "query": "meyer"}, {"query": "house", "limit": 7, "offset": 31}, {"query": "ouse2", "offset": 5000}, {}, {"offset": 2995, "limit": 20}],
)
def test_same_pages_as_the_full_search(people, index, monkeypatch, asked, few):
    monkeypatch.setattr(substring_index, "_FEW", few)
    assert rows(substring_index.search_persons(index, **asked)) == rows(search.search_persons(people, **asked))


def scanned(spark, path, action):
    """Rows that scans of files under path gave in an action's executions."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total = 0
    for k in range(before, store.executionsCount()):
        one = store.executionsList(k, 1)
        e = one.head()
        values = store.executionMetrics(e.executionId())
        nodes = store.planGraph(e.executionId()).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            if "Scan parquet" in node.name() and path in node.desc():
                for m in range(node.metrics().size()):
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_a_rare_term_reads_few_rows(spark, people, index):
    read = scanned(spark, f"{index.path.removeprefix('file://')}/table/rows", lambda: substring_index.search_persons(index, query="quixotic").collect())
    everything = scanned(spark, f"{index.path.removeprefix('file://')}/table/rows", lambda: substring_index.search_persons(index, query="an").collect())
    assert 0 < read <= 3 * 400 < 3001 <= everything  # one part, for the match and for its page


def test_a_deep_page_reads_its_range(spark, people, index):
    table = index.table
    assert table.parts().count() >= 5
    read = scanned(spark, f"{index.path.removeprefix('file://')}/table/rows", lambda: ordered_table.page(table, 20, 2500).collect())
    assert 0 < read <= 1000
    assert rows(ordered_table.page(table, 20, 2500)) == rows(search_page(people, 20, 2500))
    assert len(ordered_table.page(table, 20, 2500).inputFiles()) <= 2


def search_page(people, limit, offset):
    total = people.count()
    return people.orderBy(F.col("name").asc_nulls_last(), "wiki_id").offset(offset).limit(limit).withColumn("total", F.lit(total))


def test_pages_follow_tokens(people, index):
    want = rows(people.orderBy(F.col("name").asc_nulls_last(), "wiki_id").withColumn("total", F.lit(people.count())))
    got, token = [], None
    while True:
        part = ordered_table.page_after(index.table, 617, token).collect()
        if not part:
            break
        got += [tuple(r[c] for c in [*COLUMNS, "total"]) for r in part]
        token = ordered_table.token(part[-1], index.table.keys)
    assert got == want
    # a row that isn't there has a place too
    gone = ordered_table.token({"name": want[1000][1], "wiki_id": want[1000][0] + "0"}, index.table.keys)
    assert ordered_table.page_after(index.table, 1, gone).first()["wiki_id"] in {w[0] for w in want[1000:1030]}
    for bad in ("!", "e30=", ordered_table.token({"name": "x"}, ("name",))):
        with pytest.raises(BadRequest):
            ordered_table.page_after(index.table, 5, bad)


def test_trigrams():
    assert substring_index.grams_of("house") == ["hou", "ous", "use"] and substring_index.grams_of("l_ne%abcd") == ["abc", "bcd"] and substring_index.grams_of("a\\%bcd") == [] and substring_index.grams_of("ab") == []


def test_opened_again_and_empty(spark, people, index, tmp_path):
    again = substring_index.open_index(spark, index.path)
    assert rows(substring_index.search_persons(again, query="house7")) == rows(search.search_persons(people, query="house7"))
    none = substring_index.build(people.where("false"), f"file://{tmp_path}/none")
    assert not substring_index.search_persons(none, query="house").count() and not ordered_table.page(none.table, 10).count() and not ordered_table.page_after(none.table, 10, ordered_table.token({"name": "a", "wiki_id": "b"}, none.table.keys)).count()
    with pytest.raises(FileNotFoundError):
        substring_index.open_index(spark, f"file://{tmp_path}/nothing")
    with pytest.raises(BadRequest):
        substring_index.search_persons(index, limit=0)


def test_postings_of_a_large_part_are_listed_by_several_tasks(spark, tmp_path):
    n = 3 * substring_index._CHUNKS << substring_index.CHUNK_BITS
    df = spark.range(n).select(F.format_string("P-%06d", "id").alias("wiki_id"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"))
    table = ordered_table.build(df, f"file://{tmp_path}/table", ("wiki_id",))
    assert table.parts().count() == 1
    lists = substring_index.chunk_lists(table, {"name": ["wiki_id"]})
    assert lists.rdd.getNumPartitions() == 3
    assert lists.agg(F.countDistinct("chunk"), F.sum(F.size("rids"))).first()[:] == (n >> substring_index.CHUNK_BITS, 6 * n - lists_twice(n))


def lists_twice(n):
    """Trigrams that P-000000 .. hold more than once, less one of each."""
    return sum(6 - len({t[k : k + 3] for k in range(6)}) for t in (f"P-{k:06d}" for k in range(n)))
