"""Keys counted by hashes against plain counts, nulls included; tables that are folders of files."""

import os
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import audit, walkforward

PREDICTIONS = [(m, f, r) for m in ("raw", "x") for f in ("a", None) for r in ("1", "2", "3")] + [("raw", "a", "1"), (None, "a", "2"), ("raw", None, None), ("raw", None, None), ("a", "raw", "9"), ("x", "a", "4")]
EDGE = [(m, r, t, s) for m in ("raw", "x") for r in ("1", "2") for t in ("low", "high") for s in ("YES", None)] + [("raw", "1", "low", "YES"), ("raw", "8", "low", "YES"), (None, "2", "low", "YES"), ("x", None, "low", None), ("1", "raw", None, "YES"), ("1", "raw", "YES", None), ("raw", "1", None, None), ("raw", "1", None, None)]


def test_keys_by_their_hashes(spark):
    p = spark.createDataFrame(PREDICTIONS, "model_name string, fold_id string, row_id string").repartition(3)
    e = spark.createDataFrame(EDGE, "model_name string, row_id string, friction_tier string, trade_side string").repartition(3)
    repeats = lambda rows: sum(n - 1 for n in Counter(rows).values())
    known = {(m, r) for m, _, r in PREDICTIONS if m and r}
    got = {(r["phase"], r["name"]): r["n"] for r in audit._edge_ids(e, p).unionByName(audit._prediction_ids(p)).collect()}
    plain = walkforward.identical_rows(p).agg(F.sum("bad_rows")).first()[0]
    assert got == {
        ("edge", "key_is_unique"): repeats(EDGE), ("edge", "rows_are_predicted"): sum((m, r) not in known for m, r, *_ in EDGE),
        ("predictions", "key_is_unique"): repeats(PREDICTIONS), ("walkforward", "identical_rows"): plain, ("walkforward", "models_agree"): 0,
    }
    none = {(r["phase"], r["name"]): r["n"] for r in audit._edge_ids(e.limit(0), p.limit(0)).unionByName(audit._prediction_ids(p.limit(0))).collect()}
    assert set(none) == set(got) and none["walkforward", "models_agree"] == -1 and none["edge", "key_is_unique"] == 0
    # Only hashes are shuffled.
    plan = audit._edge_ids(e, p)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(model_name" not in plan


def test_tables_of_several_files(spark, tmp_path):
    nation = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    nation.repartition(3).write.parquet(str(tmp_path / "nation.parquet"))
    os.symlink("/root/testdata/sf0.001/region.parquet", tmp_path / "region.parquet")
    rows = pq.read_metadata(tmp_path / "region.parquet").num_rows
    found = {r["name"]: tuple(r)[1:] for r in catalog.queries()["s7_inspect_files"](spark, str(tmp_path)).collect()}
    assert found == {"nation.parquet": (nation.count(), True, True, True), "region.parquet": (rows, True, True, True)}
