"""Rows with null and repeated ids are kept and dropped by their own texts."""

from collections import Counter

from tidemark.llm import simhash
from tidemark.llm.decontaminate import remove_contaminated

LONG = " ".join(f"w{k}" for k in range(20))
TEXTS = ["the river bends twice before the mill", "copper kettles hang over a cold stove", LONG, "nine grey ships lay at anchor", "orchards flower late along this coast"]


def test_near_duplicates_keep_distinct_texts(make):
    rows = [(None, t) for t in TEXTS] + [(7, t + " seven more") for t in TEXTS] + [(None, TEXTS[0]), (7, TEXTS[1] + " seven more"), (9, TEXTS[3])]
    fps = [simhash.fingerprint(t) for _, t in rows]
    assert all((fps[a] ^ fps[b]).bit_count() > 2 or rows[a][1] == rows[b][1] for a in range(len(rows)) for b in range(a))
    kept = simhash.keep_one_per_group(make(rows))
    want = [(None, t) for t in TEXTS if t != TEXTS[3]] + [(9, TEXTS[3])] + [(7, t + " seven more") for t in TEXTS]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
    assert kept.columns == make(rows).columns


def test_decontamination_judges_each_text(spark, make):
    rows = [(None, t) for t in TEXTS] + [(7, t) for t in TEXTS] + [(7, TEXTS[0])]
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    kept = remove_contaminated(make(rows), items)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r for r in rows if r[1] != LONG)
    assert kept.columns == make(rows).columns
    cut = remove_contaminated(make(rows), items, mode="spans")
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == Counter((d, "" if t == LONG else t) for d, t in rows)
