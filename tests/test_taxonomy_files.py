"""Which taxonomy file a database gets, and idempotent seeding."""

import json

import pytest

from lodeweave.sources import tables


def test_search_order(spark, tmp_path):
    def put(path, data):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(data))

    put("b/dash/my-db/_schema/_dbs/_taxonomies.json", {"Type": ["own"]})
    put("a/dash/x/_schema/_dbs/_taxonomies.json", {"Type": ["first"]})
    put("c/other/_schema/_dbs/_taxonomies.json", {"Type": ["told"]})
    put("c/other/_schema/_dbs/told-db.json", {"Type": ["no"]})
    option = lambda db: [(r.how, r.relation, r.option) for r in tables.load_taxonomy(spark, str(tmp_path), db).collect()]
    assert option("My_DB") == [("own", "Type", "own")] and option("told-db") == [("manifest", "Type", "told")] and option("unknown") == [("other", "Type", "first")]
    empty = tmp_path / "c/other/_schema/_dbs/none"
    empty.mkdir()
    put("c/other/_schema/_dbs/none/x.json", {})
    with pytest.raises(FileNotFoundError):
        tables.find_taxonomy(spark, str(empty), "db")


def test_seeding_twice_changes_nothing(spark):
    table = spark.createDataFrame([(1, "a")], "id int, slug string")
    once = tables.seed(spark, table, [(9, "a"), (2, "b")], "id int, slug string", ["slug"])
    twice = tables.seed(spark, once, [(9, "a"), (2, "b")], "id int, slug string", ["slug"])
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == {(1, "a"), (2, "b")}
