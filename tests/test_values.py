"""What works on single values and small lists: durations, fee schedules, groupings; and files inspected in tasks."""

import hashlib
import json

import pytest

from tidemark.functions import expr
from tidemark.operators import edge, metrics
from tidemark.sources import readers, sinks


@pytest.mark.parametrize(("text", "size", "again"), [("7d", 604800, "7d"), ("6h", 21600, "6h"), ("90m", 5400, "90m"), ("close", 60, "1m"), ("48h", 172800, "2d")])
def test_durations(text, size, again):
    assert expr.parse_duration(text) == size and expr.format_duration(size) == again


def test_month_windows():
    assert (expr.parse_months("1month"), expr.parse_months("3 months")) == (1, 3)
    for parse, text in ((expr.parse_duration, "0d"), (expr.parse_duration, "1y"), (expr.parse_months, "0month"), (expr.parse_months, "month")):
        with pytest.raises(ValueError):
            parse(text)


SOUND = (edge.Fee("first", 0.07, None, "1994-01-01"), edge.Fee("wide", 0.05, "1993-01-01", "1996-06-01"), edge.Fee("end", 0.01, "1997-01-01", None))


def test_fee_schedules():
    assert edge.validate_schedule(SOUND) == SOUND
    bad = [(), (edge.Fee("a", 0.1), edge.Fee("a", 0.2)), (edge.Fee("a", -0.1),), (edge.Fee("a", 1.0),), (edge.Fee("a", 0.1, "2024-02-01", "2024-01-01"),), (edge.Fee("a", 0.1, "2024-02-01", "2024-02-01"),), (edge.Fee("a", 0.1, "1 May"),)]
    for schedule in bad:
        with pytest.raises(edge.FeeError):
            edge.validate_schedule(schedule)


def test_skipped_groupings(spark):
    rows = spark.createDataFrame([("1d", "x")], "horizon_name string, domain string")
    found = {(r.grouping_name, r.missing) for r in metrics.skipped_groupings(rows, {"horizon": ["horizon_name"], "liquidity": ["horizon_name", "liquidity_bucket"]}).collect()}
    assert found == {("liquidity", "liquidity_bucket")}


def test_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    folder = tmp_path / "files with spaces"
    folder.mkdir()
    monkeypatch.setattr(readers, "PIECE_BYTES", 1000)
    spark.range(50).selectExpr("id", "id * 2 AS price").coalesce(1).toPandas().to_parquet(folder / "a.parquet")
    (folder / "big.bin").write_bytes(b"x" * 1_000_003)  # many pieces, the last one short
    (folder / "b.csv").write_text('id,"the price"\n1,2\n')
    (folder / "c.tsv").write_text("id\tprice\n")
    (folder / "d.jsonl").write_text('\n{"id": 1, "price": 2}\n{"other": 3}\n')
    (folder / "e.json").write_text(json.dumps([{"id": 1}, {"price": 2}]))
    (folder / "broken.parquet").write_bytes(b"PAR1 nothing")
    found = {r.name: r for r in readers.inspect_files(spark, str(folder), fields=(readers.Field("id"), readers.Field("price"))).collect()}
    assert set(found) == {p.name for p in folder.iterdir()}
    for p in folder.iterdir():
        assert (found[p.name].bytes, found[p.name].sha256) == (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest())
    assert (found["a.parquet"].rows, found["a.parquet"].columns, found["a.parquet"].missing) == (50, ["id", "price"], [])
    assert found["b.csv"].columns == ["id", "the price"] and found["b.csv"].missing == ["price"]
    assert all(found[n].columns == ["id", "price"] and found[n].missing == [] for n in ("c.tsv", "d.jsonl", "e.json"))
    assert found["broken.parquet"].columns is None and found["big.bin"].columns is None and found["big.bin"].rows is None


def test_batches_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "table")
    ids = lambda: sorted(r.id for r in sinks.read_batches(spark, path).collect())
    with pytest.raises(ValueError):
        sinks.read_batches(spark, path)
    assert sinks.append_batch(spark.range(3), path, "a") and sinks.append_batch(spark.range(3, 5), path, "b")
    assert not sinks.append_batch(spark.range(100, 200), path, "a")  # sent again: no effect, whatever it holds
    assert ids() == [0, 1, 2, 3, 4]
    spark.range(50, 60).write.parquet(f"{path}/data/c-lost")  # a job that was lost before its commit
    assert ids() == [0, 1, 2, 3, 4]
    assert sinks.append_batch(spark.range(5, 6), path, "c") and ids() == [0, 1, 2, 3, 4, 5]
    assert sinks.sweep_batches(spark, path) == 1 and sinks.sweep_batches(spark, path) == 0 and ids() == [0, 1, 2, 3, 4, 5]
    for bad in ("", "../x", "a/b", ".hidden"):
        with pytest.raises(ValueError):
            sinks.append_batch(spark.range(1), path, bad)


def test_only_one_of_two_writers_commits(spark, tmp_path, monkeypatch):
    """A second writer of the same batch that finds no manifest at first, and one as it commits."""
    path, real, seen = str(tmp_path / "race"), sinks._files, []

    def files(session, where):
        found = real(session, where)
        if where.endswith("/a") and not seen:
            seen.append(1)
            sinks_path = f"{path}/data/a-first"
            session.range(2).write.parquet(sinks_path)
            class Late:
                def __getattr__(self, name):
                    return getattr(found[1], name)

                def exists(self, which, first=[True]):  # noqa: B006
                    if first and first.pop():
                        out = found[1].create(found[0], False)
                        out.write(bytearray(b"a-first"))
                        out.close()
                        return False
                    return found[1].exists(which)

            return found[0], Late()
        return found

    monkeypatch.setattr(sinks, "_files", files)
    assert not sinks.append_batch(spark.range(10), path, "a")
    assert sorted(r.id for r in sinks.read_batches(spark, path).collect()) == [0, 1] and sinks.sweep_batches(spark, path) == 0
