"""Contact records as state of a stream: any order of pages, restarts, and the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import catalogue
from lodeweave.streaming import contacts, jobs

SCHEMA = "job string, seq long, email string, icon string"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_gives_the_batch_result(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abc"), i, rnd.choice([None, "", "  ", f"m{i}@x.example "]), rnd.choice([None, "svc/fallback?x", f"https://x.example/{i}.png", ""])) for i in range(60)]
    rows += [("z", 100, None, "svc/fallback?z"), ("y", 101, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in catalogue.first_non_empty(df, "job", "seq", ["email", "icon"], {"icon": F.col("icon").contains("fallback")}).collect() if r.email or r.icon}
    rnd.shuffle(rows)
    before = spark.conf.get(contacts._PROVIDER, None)
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    out = None
    for part in range(3):  # each run is a restart from the checkpoint
        spark.createDataFrame(rows[part::3], SCHEMA).repartition(2).write.mode("append").parquet(folder)
        stream = jobs.events(spark, folder, df.schema, "*.parquet", 1)
        out = jobs.run_once(contacts.contact_records(stream, "job", "seq", ["email", "icon"], "icon", "fallback"), state, "update")
    contacts.restore_provider(spark, before)
    assert {tuple(r) for r in contacts.newest_records(out, "job").collect()} == want
