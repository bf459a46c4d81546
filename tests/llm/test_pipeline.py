"""The pipeline's stages against plain versions on the same inputs, and the guard of the driver entry."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline as cp
from tidemark.llm import langid, mixing, simhash
from tidemark.llm.common import materialize, table
from tidemark.llm.decontaminate import contamination
from tidemark.llm.sharding import shard_ids

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        if name == "language_id":
            want = {r.doc_id for r in langid.predict_language(docs).collect() if r.lang_pred != "und" and r.score >= cp.MIN_LANGUAGE_SCORE}
            assert len(want) > 0.95 * docs.count()
        elif name == "near_duplicates":
            fps = {r.doc_id: simhash.fingerprint(r.text) for r in docs.collect()}
            comp = {d: d for d in fps}
            for a in sorted(fps):
                for b in sorted(fps):
                    if b < a and (fps[a] ^ fps[b]).bit_count() <= 2:
                        low, high = sorted((comp[a], comp[b]))
                        comp = {k: low if v == high else v for k, v in comp.items()}
            want = set(comp.values())
        elif name == "decontamination":
            want = {r.doc_id for r in contamination(docs, table(spark, SF, "benchmark")).collect() if not r.contaminated}
        elif name == "mixing":
            want = {r.doc_id for r in mixing.schedule(docs).where("in_mix").collect()}
        else:
            want = {r.doc_id for r in docs.collect()}
            shards = {r.doc_id: r.shard_id for r in shard_ids(docs).collect()}
            assert {r.doc_id: r.shard_id for r in out.collect()} == shards
        assert ids(out) == sorted(want), name
        assert out.columns == (columns if name != "sharding" else [*columns, "shard_id"])
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert all(texts[r.doc_id] == r.text for r in out.collect())
        docs = out
    whole = cp.run(spark, SF)
    assert Counter(r.doc_id for r in whole.collect()) == Counter(ids(docs))


def test_stages_on_odd_rows(spark, make):
    rows = [(k, f"a text of some words number {k} and more of them {k * 7}", "en", f"s{k % 2}") for k in range(30)] + [(40, None, None, None), (41, "", "en", "s1"), (None, "no id but words here", "en", "s0"), (3, "a text of some words number 3 and more of them 21", "en", "s1")]
    docs = make(rows).drop("shard_id")
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
    assert docs.columns[-1] == "shard_id" and docs.count() <= 31
    empty = make([]).drop("shard_id")
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_entry_without_the_subpackage(tmp_path):
    root = Path(cp.__file__).parent
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"
    for p in ("__spark_entry__.py", "tidemark"):
        target = tmp_path / p
        if (root / p).is_dir():
            __import__("shutil").copytree(root / p, target, ignore=lambda d, names: ["llm"] if d.endswith("tidemark") else [])
        else:
            target.write_bytes((root / p).read_bytes())
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 50 and out[1:] == ["False", "False"]
