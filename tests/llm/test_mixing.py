"""The whole stream: every row, and the lag against the unrounded targets."""

import random
from collections import Counter
from fractions import Fraction

import corpus_pipeline as cp
import pytest
from tidemark.llm import mixing


def lines(blocks, weights, slots):
    """Each source's target after 0, 1, ... slots, from the definition: shares of the sources that last, in exact time."""
    at, done, out, t = Fraction(0), dict.fromkeys(blocks, Fraction(0)), [], 0
    while t <= slots:
        left = [s for s in blocks if done[s] < blocks[s]]
        total = sum((Fraction(weights[s]) for s in left), Fraction(0))
        step = min(((blocks[s] - done[s]) * total / Fraction(weights[s]) for s in left), default=Fraction(slots + 1))
        while t <= slots and t <= at + step:
            out.append({s: done[s] + (Fraction(weights[s]) / total * (t - at) if s in left else 0) for s in blocks})
            t += 1
        done = {s: done[s] + (Fraction(weights[s]) / total * step if s in left else 0) for s in blocks}
        at += step
    return out


def lag_is_under_one_block(stream, blocks, weights):
    run = Counter()
    targets = lines(blocks, weights, len(stream))
    for t, (s, k) in enumerate(stream, 1):
        assert k == run[s]
        run[s] += 1
        assert all(abs(run[x] - targets[t][x]) < 1 for x in blocks)
    assert run == Counter(blocks)


@pytest.mark.parametrize("seed", range(6))
def test_whole_stream(seed):
    rng = random.Random(seed)
    blocks = {f"s{k}": rng.choice([1, 1, 2, 30, 100]) for k in range(rng.randint(1, 9))}
    weights = {s: (n * 16) ** 0.7 if seed % 2 else rng.uniform(0.01, 9) for s, n in blocks.items()}
    found = list(mixing.whole_stream(blocks, weights))
    assert [x[4] for x in found] == list(range(sum(blocks.values())))
    assert all(release <= slot < deadline for _, _, release, deadline, slot in found)
    lag_is_under_one_block([x[:2] for x in found], blocks, weights)


def test_lag_over_many_cycles():
    blocks = {f"s{k}": 2000 for k in range(20)}
    weights = {s: (n * 16) ** 0.7 for s, n in blocks.items()}
    run, n = Counter(), 0
    for n, (s, *_) in enumerate(mixing.whole_stream(blocks, weights), 1):
        run[s] += 1
        if n % 97 == 0:
            assert all(abs(run[x] - Fraction(n, 20)) < 1 for x in blocks)
    assert n == 40000 > 4 * mixing.CYCLE


@pytest.mark.parametrize("weights", [{f"s{k}": 1 for k in range(20)}, {"big": 1000.0, **{f"s{k}": 0.001 * (k + 1) for k in range(50)}}])
def test_cycle_follows_the_stream(make, weights):
    blocks, total = 100_000, sum(Fraction(w) for w in weights.values())
    quanta = mixing.quantize(weights, mixing.cycle_slots(weights, blocks))
    cycle = sum(quanta.values())
    assert all(abs(Fraction(quanta[s], cycle) - Fraction(w) / total) * blocks < 1 for s, w in weights.items())


def test_given_weights_over_many_blocks(make):
    weights = {"a": 1, "b": 1, "c": 1}
    docs = make([(k, None, None, "abc"[k % 3]) for k in range(60000)])
    last = mixing.schedule(docs, weights, block_rows=1).where("in_mix").groupBy("source").agg({"block": "max"}).collect()
    assert sorted(r[0] for r in last) == ["a", "b", "c"] and all(abs(r[1] + 1 - 20000) <= 2 for r in last)


def test_weights_must_be_positive():
    with pytest.raises(ValueError):
        list(mixing.whole_stream({"a": 1, "b": 1}, {"a": 1, "b": 0}))


def test_small_source_keeps_all_rows(spark, make):
    sizes = {"a": 900, "b": 800, "c": 700, "": 1}
    rows = [(10000 * k + i, f"{s} {i}", None, s or None) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(None, "x", None, "a"), (None, "y", None, "b"), (5, "again", None, "a")]
    docs = make(rows)
    # A one-row source with the largest weight ends at once; blocks of one row make the order exact.
    weights = {"a": 1, "b": 2, "c": 3, "": 9}
    for given, block_rows in ((None, 16), (weights, 1)):
        out = [(r.doc_id, r.text, r.source) for r in mixing.mix(docs, given, block_rows=block_rows).collect()]
        assert Counter(out) == Counter((r[0], r[1], r[3]) for r in rows)
    counts, run, stream = Counter(r[3] or "" for r in rows), Counter(), []
    for _, _, s in out:
        stream.append((s or "", run[s or ""]))
        run[s or ""] += 1
    lag_is_under_one_block(stream, counts, weights)
    assert Counter(r.doc_id for r in cp.mix_sources(spark, docs, "").collect()) == Counter(r[0] for r in rows)
    slots = mixing.schedule(docs).collect()
    assert all(r.in_mix and r.release <= r.slot < r.deadline for r in slots)
    assert {r.slot for r in slots} == set(range(sum(-(-n // 16) for n in counts.values())))


def test_lag_of_uneven_sources_over_a_million_rows():
    """Forty sources of 10 to 10^6 rows, blocks of one row: under one block off the exact targets at all checked slots, to the end of every source."""
    rng = random.Random(11)
    rows = {f"s{k}": int(10 ** rng.uniform(1, 4.6)) for k in range(38)} | {"big": 600_000, "one": 1}
    assert sum(rows.values()) > 10**6 * 0.7
    weights = {s: n**0.7 for s, n in rows.items()}
    exact = {s: Fraction(w) for s, w in weights.items()}
    ends = sorted(rows, key=lambda s: rows[s] / exact[s])
    starts, at, done, total = [], Fraction(0), Fraction(0), sum(exact.values())
    for s in ends:  # time and progress per unit of weight at which each source runs out
        at += (rows[s] / exact[s] - done) * total
        done = rows[s] / exact[s]
        total -= exact[s]
        starts.append((at, done, total))
    run, stage, t0, d0, w0 = Counter(), 0, Fraction(0), Fraction(0), sum(exact.values())
    checked = 0
    for t, (s, *_) in enumerate(mixing.whole_stream(rows, weights), 1):
        run[s] += 1
        while stage < len(ends) - 1 and t > starts[stage][0]:
            t0, d0, w0 = starts[stage]
            stage += 1
        if t % 1999 == 0 or t < 300:
            each, left = d0 + (t - t0) / w0, set(ends[stage:])
            assert all(abs(run[x] - (exact[x] * each if x in left else rows[x])) < 1 for x in rows)
            checked += 1
    assert run == Counter(rows) and checked > 600


def test_hot_ids_are_split_and_numbered_once(make):
    rows = [(None, f"t{k}", None, "a") for k in range(600)] + [(7, "same", None, "a")] * 500 + [(k, "x", None, "b") for k in range(100)]
    got = mixing.schedule(make(rows), block_rows=4, range_rows=16).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3]) for r in rows)
    for s, n in (("a", 1100), ("b", 100)):
        assert sorted((r.block, r.place) for r in got if r.source == s) == [(k // 4, k % 4) for k in range(n)]


def test_order_reaches_the_shards(spark, make):
    """The rows of each shard stand in the order of the mixed stream, through writing and reading."""
    from tidemark.llm.common import materialize
    from tidemark.llm.sharding import assign_shards

    rows = [(k, f"text {k} " * 30, None, f"s{k % 3}" if k % 7 else "rare") for k in range(3000)]
    mixed = materialize(mixing.mix(make(rows).drop("shard_id").repartition(5), block_rows=2), "mixing")
    slot = {r.doc_id: (r.slot, r.place) for r in mixing.schedule(make(rows), block_rows=2).collect()}
    files = sorted((r.f, r.i, slot[r.doc_id]) for r in mixed.selectExpr("_metadata.file_name AS f", "_metadata.row_index AS i", "doc_id").collect())
    assert [x for *_, x in files] == sorted(slot.values())
    out = materialize(assign_shards(mixed, 20_000, order=mixing.stream_order(mixed)), "sharded")
    seen = {}
    for r in sorted(out.selectExpr("_metadata.file_name AS f", "_metadata.row_index AS i", "doc_id", "shard_id").collect()):
        seen.setdefault(r.shard_id, []).append((r.f, slot[r.doc_id]))
    assert len(seen) > 20
    for places in seen.values():
        assert len({f for f, _ in places}) == 1 and [x for _, x in places] == sorted(x for _, x in places)
