import sys

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from cvframe.llm import mixing, quality, simhash, toxicity


def test_registered():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "encoding"]


@pytest.fixture(scope="module")
def inputs(make_docs, label_dir):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(240):
        words = [f"w{rng.integers(500)}" for _ in range(int(rng.integers(20, 60)))]
        bad, rude = i % 5 == 0, i % 7 == 0
        if bad:
            words = [f"{w}%%%" for w in words]
        if rude:
            words += ["you grumbleface"] * 4
        rows.append((i, " ".join(words), f"s{i % 3}"))
        labels.append((i, int(not bad), int(rude)))
    rows += [(500 + k, rows[1][1], "s0") for k in range(5)] + [(600, None, None), (601, "", "s1"), (None, "w1 w2 w3", "s0"), rows[2]]
    return rows, make_docs(rows, extra=("score", "copies")), label_dir(labels)


def test_each_stage_on_what_the_one_before_kept(spark, inputs, tmp_path):
    rows, docs, sf = inputs
    key = lambda r: tuple(map(str, r))
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = at.collect()
        out = stage(spark, at, sf)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        got = out.collect()
        if name in ("toxicity", "quality"):
            module = toxicity if name == "toxicity" else quality
            scored = module.score(at, module.fit(at, sf))
            keep = [r for r in scored.collect() if (r[-1] < 0.7 if module is toxicity else r[-1] >= 0.7)]
            assert sorted(key(r[:-1]) for r in keep) == sorted(map(key, got)) and 0 < len(got) < len(before)
        elif name == "near_dedup":
            comp = {}
            for r in simhash.near_duplicates(at).collect():
                comp.setdefault(r["component_id"], []).append(r["doc_id"])
            ids = [r["doc_id"] for r in got]
            assert len(ids) == len(set(ids)) and {i for i in ids if i is not None} == {i for i in comp if i is not None}
            assert set(map(key, got)) <= set(map(key, before))
        elif name == "mixing":
            copies = {r["doc_id"]: r[-1] for r in mixing.mix(at).collect()}
            want = sorted(key(r) for r in before for _ in range(copies[r["doc_id"]]))
            assert sorted(map(key, got)) == want
        else:
            assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in before)
            assert all(r["n_tokens"] == len(r["ids"]) for r in got)
        if name != "encoding":
            assert out.columns == docs.columns
        at = out


def test_run_and_empty_documents(spark, inputs, tmp_path, label_dir):
    rows, docs, sf = inputs
    docs.drop("score", "copies").write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() > 100
    none = label_dir([])
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    assert corpus_pipeline.run(spark, none).collect() == []


def test_rest_imports_without_the_subpackage(tmp_path):
    """The entry point works when the subpackage and the pipeline are gone."""
    import os
    import shutil
    import subprocess

    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(f"{root}/cvframe", tmp_path / "cvframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'pipeline' not in q and len(q) > 60"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
