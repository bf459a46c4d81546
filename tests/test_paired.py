"""Paired differences: by sums where rows pair one to one, by a join for the rest."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference, metrics

SCHEMA = "model_name string, row_id string, event_family_id string, h string, d string, brier double, log_loss double"
GROUPINGS = {"overall": [], "h": ["h"], "h_d": ["h", "d"]}


def rows_of(damaged):
    out = []
    for k in range(240):
        for j, m in enumerate(("raw", "same", "x")):
            b = (k * 37 % 101) / 101.0 + (0.1 * (k % 7) if m == "x" else 0.0)
            row = [m, f"r{k}", f"f{k % 11}", "ab"[k % 2], "uvw"[k % 3] if k % 5 else None, b, b / 3]
            if damaged:
                if k == 7 and j == 1 or k == 8 and j == 0:
                    continue  # a model lacks the row; the baseline lacks it
                if k == 9:
                    row[5] = None if j == 2 else row[5]
                if k == 12:
                    row[3] = "z" if j == 1 else row[3]
                if k == 13:
                    row[2] = "moved" if j == 2 else row[2]
                if k == 14:
                    row[1] = None
                if k == 15:
                    row[2] = None
                if k == 16 and j == 0:
                    out.append(tuple([*row[:3], "b", "u", 0.9, 0.8]))
                if k == 17 and j == 2:
                    out.append(tuple(row))
            out.append(tuple(row))
    return out


def plain(rows):
    """All pairs of rows with one id and one group, added up."""
    key = lambda r, cols: "|".join("<missing>" if r[SCHEMA_AT[c]] is None else r[SCHEMA_AT[c]] for c in cols) or "all"
    found = {}
    for a in rows:
        for b in rows:
            if a[0] == "raw" or b[0] != "raw" or a[1] is None or a[1] != b[1]:
                continue
            for name, cols in GROUPINGS.items():
                if key(a, cols) == key(b, cols):
                    cell = found.setdefault((a[0], name, key(a, cols), a[2]), [0, [], []])
                    cell[0] += 1
                    for k in (5, 6):
                        if a[k] is not None and b[k] is not None:
                            cell[k - 4].append(a[k] - b[k])
    return {k: (n, sum(b) if b else None, sum(x) if x else None) for k, (n, b, x) in found.items()}


SCHEMA_AT = {c.split()[0]: k for k, c in enumerate(SCHEMA.split(", "))}


@pytest.mark.parametrize("damaged", [False, True])
@pytest.mark.parametrize("exploded", [False, True])
def test_paired_sums(spark, damaged, exploded):
    data = rows_of(damaged)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    given = (metrics.by_groupings(df, GROUPINGS), None) if exploded else (df, GROUPINGS)
    stats = inference.paired_stats(given[0], one_to_one=False, groupings=given[1])
    got = {(r.model_name, r.grouping_name, r.group_key, r.cluster): (r.n, r.brier, r.log_loss) for r in stats.collect()}
    want = plain(data)
    assert set(got) == set(want)
    for k, (n, b, x) in want.items():
        assert got[k][0] == n and got[k][1] == (b if b is None else pytest.approx(b, abs=1e-12)) and got[k][2] == (x if x is None else pytest.approx(x, abs=1e-12))
    if not damaged:
        assert all(v[1] == 0 and v[2] == 0 for k, v in got.items() if k[0] == "same")
        # Rows that pair one to one don't meet: nothing is joined.
        assert "Join" not in stats._jdf.queryExecution().toString()


def test_an_id_shared_by_all_rows(spark):
    rows = spark.range(60).select(F.element_at(F.array(F.lit("raw"), F.lit("x")), (F.col("id") % 2 + 1).cast("int")).alias("model_name"), F.lit("r").alias("row_id"), F.lit("f").alias("event_family_id"), F.lit("a").alias("h"), F.lit("u").alias("d"), F.col("id").cast("double").alias("brier"), F.lit(0.0).alias("log_loss"))
    found = inference.paired_stats(rows, one_to_one=False, groupings={"overall": []}).collect()
    assert [(r.n, r.brier) for r in found] == [(900, 900.0)]
