"""Decontamination, mixing, line dedup and sharding against brute force, with their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import linededup, mixing, sharding
from tidemark.llm.decontaminate import contamination, remove_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UP))


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(item)
    out = []
    for doc, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), names, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def bench_rows():
    long = " ".join(f"w{k}" for k in range(20))
    items = [(1, long), (2, "Short one"), (3, None), (4, ""), (10, long), (None, "nameless words here"), (5, "x " * 30)]
    docs = [
        (1, long.upper() + "!"), (2, " ".join(f"w{k}" for k in range(3, 16))), (3, " ".join(f"w{k}" for k in range(3, 15))), (4, None), (5, ""), (6, "---"),
        (7, "a short, ONE b"), (7, "a short, ONE b"), (8, "nameless words here"), (None, long), (9, "y " * 500 + long), (11, "x " * 13), (12, "x " * 12), (13, "é short-one ß"),
    ]
    return docs, items


def as_bench(spark, items):
    return spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, gram string")


@pytest.mark.parametrize("limit", [1 << 18, 0])
def test_contamination(spark, make, limit):
    docs, items = bench_rows()
    found = contamination(make(docs), as_bench(spark, items), max_broadcast_windows=limit)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in found.collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(got, key=key) == sorted(brute_contamination(docs, items), key=key)


def test_large_benchmark_shuffles_only_candidates(spark, make, monkeypatch):
    """Above 2^18 windows: the same results, and what goes to the join is about the hits, not all windows."""
    from tidemark.llm import decontaminate

    random.seed(5)
    item = [f"b{random.randrange(10**6)}" for _ in range(300_000)]
    items = [(1, " ".join(item)), (2, " ".join(item[50:80]) + " and its own words")]
    docs = [(k, " ".join(f"d{random.randrange(10**6)}" for _ in range(400)) + (" " + " ".join(item[1000 * k : 1000 * k + 40]) if k % 5 == 0 else "")) for k in range(1, 40)] + [(77, " ".join(item[40:90]))]
    kept, seen = decontaminate.materialize, {}

    def spy(df, tag, *more):
        seen[tag] = kept(df, tag, *more)
        return seen[tag]

    monkeypatch.setattr(decontaminate, "materialize", spy)
    monkeypatch.setattr(decontaminate, "discard", lambda df: None)
    found = contamination(make(docs), as_bench(spark, items))
    assert seen["windows"].count() > 1 << 18
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in found.collect())
    assert got == sorted(brute_contamination(docs, items))
    candidates = seen["scanned"].selectExpr("sum(size(found))").first()[0]
    hits, windows = 7 * 28 + 38, 39 * 388
    assert hits <= candidates < hits + windows // 10
    assert "BroadcastHashJoin" not in seen["scanned"]._jdf.queryExecution().executedPlan().toString()


def test_contamination_empty_tables(spark, make):
    assert contamination(make([]), as_bench(spark, [(1, "a b")])).count() == 0
    assert [r.contaminated for r in contamination(make([(1, "a b")]), as_bench(spark, [])).collect()] == [False]


def test_removal(spark, make):
    docs, items = bench_rows()
    kept = remove_contaminated(make(docs), as_bench(spark, items))
    assert kept.columns == make(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, *_, bad in brute_contamination(docs, items) if not bad)
    cut = {r.doc_id: r.text for r in remove_contaminated(make(docs), as_bench(spark, items), mode="spans").collect()}
    assert cut[7] == "a b" and cut[13] == "é ß" and cut[1] == "!" and cut[4] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=12), st.sampled_from([16, 97, 256]))
def test_pfair_lag_is_under_one_block(weights, slots):
    quanta = mixing.quantize({f"s{k}": w for k, w in enumerate(weights)}, slots)
    cycle = mixing.pfair_cycle(quanta)
    total, run = sum(quanta.values()), Counter()
    assert len(cycle) == total
    for t, (s, k) in enumerate(cycle, 1):
        assert k == run[s]
        run[s] += 1
        q = quanta[s]
        assert k * total // q <= t - 1 < -(-(k + 1) * total // q)
        assert all(abs(run[x] - Fraction(quanta[x] * t, total)) < 1 for x in quanta)


def test_schedule(make):
    random.seed(2)
    rows = [(k, "t", None, "hot" if k % 3 else f"s{k % 7}") for k in range(1500)] + [(None, None, None, None), (5, "t", None, "hot"), (5, "t", None, "hot")]
    weights = {"hot": 4, "": 1, **{f"s{k}": 1 for k in range(7)}}
    got = mixing.schedule(make(rows), weights, block_rows=4, range_rows=64).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3] or "") for r in rows)
    quanta = mixing.quantize(weights)
    cycle = mixing.pfair_cycle(quanta)
    at = {x: t for t, x in enumerate(cycle)}
    counts = Counter(r[3] or "" for r in rows)
    end = min((-(-n // 4) // quanta[s]) * len(cycle) + at[s, -(-n // 4) % quanta[s]] for s, n in counts.items())
    for s, n in counts.items():
        mine = sorted((r.block, r.place) for r in got if r.source == s)
        assert mine == [(k // 4, k % 4) for k in range(n)]
    for r in got:
        q = quanta[r.source]
        assert r.slot == r.block // q * len(cycle) + at[r.source, r.block % q]
        assert (r.release, r.deadline) == (r.block * len(cycle) // q, -(-(r.block + 1) * len(cycle) // q))
        assert r.release <= r.slot < r.deadline and r.in_mix == (r.slot < end)


def test_mix(spark, make):
    rows = [(k, None if k == 3 else f"text {k}", None, f"s{k % 3}") for k in range(60)] + [(1, "text 1", None, "s1")] * 2 + [(None, "n", None, "s0")]
    docs = make(rows)
    kept = mixing.mix(docs, block_rows=2)
    chosen = mixing.schedule(docs, block_rows=2).where("in_mix")
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in chosen.collect())
    assert mixing.mix(make([])).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"s0": 1})


def brute_lines(docs, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    holders = defaultdict(set)
    for doc, text, *_ in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text, *_ in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or doc == max(d for d in holders[key(x)] if d is not None)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 18, 0])
@pytest.mark.parametrize("batches", [1, 3, 5])
def test_line_dedup(make, limit, batches):
    line, accents = "A repeated line that has over forty letters.", "é" * 39 + "Ç"
    docs = [(k, f"own {k}\n  {line}\t\n{line.lower()}\n{accents}") for k in range(6)]
    docs += [(10, line.upper()), (11, None), (12, ""), (None, line), (None, line), (13, "\n\n"), (10, line.upper()), (14, "x" * 39 + "\n" + ("y" * 50 + "\n") * 3000), (15, "x" * 39)]
    got = linededup.dedup_lines(make(docs), n_batches=batches, max_broadcast_keys=limit).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=str) == brute_lines(docs)
    assert linededup.dedup_lines(make([]), n_batches=2).count() == 0


def test_line_runs(spark):
    runs = linededup.LineRuns(spark, fanout=2, buckets=2)
    batches = [[(1, 1, 1), (1, 2, 2)], [(2, 1, 1)], [(3, 3, 3)], [(4, 1, 1), (4, 3, 3)], [(5, 5, 5)]]
    for k, batch in enumerate(batches, 1):
        rows = spark.createDataFrame(batch, "doc long, h1 long, h2 long")
        new = {(r.h1, r.h2) for r in runs.anti_join(rows).collect()}
        assert new == {x[1:] for x in batch} - {x[1:] for b in batches[: k - 1] for x in b}
        runs.add(rows)
        assert [len(x) for x in runs.levels] == [int(b) for b in reversed(f"{k:b}")]
    assert sorted(tuple(r) for r in runs.compacted().collect()) == [(1, 1, 3, 4), (2, 2, 1, 1), (3, 3, 2, 4), (5, 5, 1, 5)]


def test_line_dedup_tables(make, spark, monkeypatch):
    """The keys have no file for each batch and task, and batches are written once: what a run with many partitions costs."""
    files, tables, made, write = [], [], linededup.materialize, linededup.LineRuns._write

    def counted(df, tag, *more):
        files.append((tag, len((out := made(df, tag, *more)).inputFiles())))
        return out

    monkeypatch.setattr(linededup, "materialize", counted)
    monkeypatch.setattr(linededup.LineRuns, "_write", lambda self, rows: tables.append(1) or write(self, rows))
    docs = [(k, "\n".join(f"{'A line that is long enough to be a key.'} {k % 7} {i}" for i in range(20))) for k in range(60)]
    got = linededup.dedup_lines(make(docs).repartition(8), n_batches=4).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=str) == brute_lines(docs)
    assert max(n for tag, n in files if tag == "line-keys") <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(tables) <= 5


def brute_shards(rows, limit):
    """rows: (id, bytes) with different ids; depth and prefix by splitting."""
    todo, out = [(0, 0, [(k, int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), n) for k, n in rows])], {}
    while todo:
        d, p, mine = todo.pop()
        if sum(n for *_, n in mine) <= limit or len(mine) == 1:
            out |= {k: f"{d}:{p}" for k, *_ in mine}
        else:
            for bit in (0, 1):
                part = [x for x in mine if x[1] >> (59 - d) & 1 == bit]
                if part:
                    todo.append((d + 1, 2 * p + bit, part))
    return out


@pytest.mark.parametrize("cells", [1 << 20, 0])
def test_sharding(make, cells):
    random.seed(1)
    docs = [(k, "é" * random.randint(0, 40)) for k in range(400)] + [(1000, "x" * 5000), (1001, None)]
    for limit in (100, 700, 10**6):
        got = {r.doc_id: r.shard_id for r in sharding.shard_ids(make(docs), limit, max_broadcast_cells=cells).collect()}
        assert got == brute_shards([(k, len((t or "").encode())) for k, t in docs], limit)


def test_sharding_repeated_rows_use_pages(make):
    docs = [(1, "x" * 10)] * 500 + [(None, "y" * 10)] * 30 + [(2, "z")]
    out = sharding.shard_ids(make(docs), 100).collect()
    held = Counter()
    for r in out:
        held[r.shard_id] += r.n_bytes
    assert len(out) == 531 and max(held.values()) <= 100
    placed = sharding.assign_shards(make(docs), 100)
    assert placed.count() == 531 and placed.columns == [c for c in make(docs).columns if c != "shard_id"] + ["shard_id"]
    assert sharding.shard_ids(make([]), 100).count() == 0


def test_overflow_pages_stay_in_their_partitions(spark):
    """A repeated id beyond a shard's limit, with shuffled joins on the directory: its rows are paged where they were read."""
    rows = spark.range(4000).selectExpr("CAST(7 AS LONG) AS doc_id", "repeat('x', 100) AS text").repartition(4)
    got = sharding.shard_ids(rows, 5000, max_broadcast_cells=0)
    found = got.collect()
    pages = {}
    for r in found:
        pages.setdefault(r.shard_id, []).append(r.n_bytes)
    assert len(found) == 4000 and all(sum(x) <= 5000 for x in pages.values())
    assert len({p.split(":")[2].split(".")[0] for p in pages}) > 1
