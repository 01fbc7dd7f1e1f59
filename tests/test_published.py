"""Every published query against its SQL, on the smallest tables."""

import duckdb
import pytest

from heritree.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, sql, name):
    found = QUERIES[name](spark, sf_dir)
    answer = sql.execute(ORACLE[name])
    columns = [c[0] for c in answer.description]
    assert sorted(found.columns) == sorted(columns)
    expected = sorted(([plain(v) for v in r] for r in answer.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in columns] for r in found.collect()), key=repr) == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators(sf_dir):
    """The rest imports and lists its queries where that subpackage is missing."""
    import subprocess
    import sys

    from .conftest import ROOT

    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('heritree.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 60 and not any(n.startswith('op') for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
