"""Sources and sinks: CSV corpus, study-layout run records, LaTeX."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from cvframe.operators import runs as R
from cvframe.sources import corpus_io as C
from cvframe.sources import runs_io as RIO
from cvframe.schema import DIMS, LABEL_COLS, corpus_schema


def test_csv_round_trip_keeps_quotes_and_newlines(spark):
    d = tempfile.mkdtemp(prefix="cvframe-csv-")
    rows = [(1, "issue", 'he said "no",\nthen left', *([0] * 14)), (2, None, "x\\y", *([1] * 14))]
    df = spark.createDataFrame(rows, corpus_schema())
    C.write_corpus_csv(df, d)
    back = C.read_corpus(spark, d).orderBy("post_id").collect()
    assert back[0]["post_text"] == 'he said "no",\nthen left'
    assert back[1]["post_text"] == "x\\y" and back[1]["issue"] is None


def test_read_study_csv_by_name(spark):
    d = tempfile.mkdtemp(prefix="cvframe-csv-")
    old = [{"Intelligibility": "Clarity", "Intelligible Position": "Clear Position",
            "Intelligible Relevance": "Clear Relevance", "Intelligible Organization": "Clear Organization"}.get(x, x)
           for x in DIMS]
    header = ",".join(["", "post_id", "issue", "post_text", *old])
    line = ",".join(["0", "17", "abortion", '"multi\nline, ""quoted"""', *(["1"] + ["0"] * 13)])
    with open(os.path.join(d, "c.csv"), "w") as f:
        f.write(header + "\n" + line + "\n")
    df = C.read_corpus(spark, os.path.join(d, "c.csv"), by_name=True)
    r = df.first()
    assert "intelligibility" in df.columns and "clarity" not in df.columns
    assert r["post_id"] == 17 and r["appropriateness"] == 1 and r["post_text"] == 'multi\nline, "quoted"'
    assert C.with_arg_issue(df).first()["arg_issue"].startswith("abortion multi")


def test_read_study_layout_runs(spark):
    root = tempfile.mkdtemp(prefix="cvframe-runs-")
    for approach in ["model-a", "model_b"]:
        for r in range(2):
            for f in range(3):
                p = os.path.join(root, approach, f"fold{f}", f"fold{r}.{f}")
                os.makedirs(p)
                with open(os.path.join(p, "test_results.json"), "w") as fh:
                    json.dump({"eval_mean_F1": r + f / 10, "eval_Emotional Intensity_macroF1": 0.5,
                               "epoch": 3.0}, fh, indent=2)
    long = RIO.read_runs(spark, root, layout="study")
    rows = long.filter(F.col("metric") == "mean_F1").collect()
    assert len(rows) == 12
    for x in rows:
        assert x["value"] == x["repeat"] + x["fold"] / 10
    assert {r["metric"] for r in long.collect()} == {"mean_F1", "emotional_intensity_macroF1"}


def test_partitioned_run_round_trip(spark):
    root = tempfile.mkdtemp(prefix="cvframe-runs-") + "/out"
    wide = spark.createDataFrame([("a", 0, 1, 0.25), ("b", 1, 0, 0.5)],
                                 "approach string, repeat int, fold int, eval_mean_F1 double")
    RIO.write_runs(wide, root)
    back = sorted(tuple(r) for r in RIO.read_runs(spark, root).collect())
    assert back == [("a", 0, 1, "mean_F1", 0.25), ("b", 1, 0, "mean_F1", 0.5)]


def test_latex_lines_escape_and_two_places(spark):
    board = spark.createDataFrame([(1, "multi_label", 0.125, 1.005)], "rank int, approach string, x double, y double")
    line = R.latex_lines(board, ["x", "y"]).first()["line"]
    assert line == r"multi\_label & 0.13 & 1.01 \\"
    path = tempfile.mkdtemp(prefix="cvframe-tex-") + "/t"
    RIO.write_latex(R.latex_table(R.latex_lines(board, ["x", "y"]), ["approach", "x", "y"]), path)
    text = [r["line"] for r in RIO.read_lines(spark, path).collect()]
    assert text[0].startswith(r"\begin{tabular}") and text[-1] == r"\end{tabular}" and line in text


def test_compare_flow_from_study_layout(spark):
    """Study-format records -> report -> leaderboard -> LaTeX -> Wilcoxon."""
    import random

    from cvframe.operators import stats as J
    from cvframe.operators.runs import study_metric_names, study_report

    rnd = random.Random(1)
    root = tempfile.mkdtemp(prefix="cvframe-study-")
    keys = study_metric_names()
    for approach, shift in [("multilabel-a", 0.05), ("multilabel-b", 0.0)]:
        for r in range(5):
            for f in range(5):
                p = os.path.join(root, approach, f"fold{f}", f"fold{r}.{f}")
                os.makedirs(p)
                rec = {f"eval_{k}": 0.6 + shift + rnd.random() / 100 for k in keys}
                rec["eval_loss"] = 0.3
                with open(os.path.join(p, "test_results.json"), "w") as fh:
                    json.dump(rec, fh)
    runs = RIO.read_runs(spark, root, layout="study").cache()
    rep = study_report(runs)
    assert rep.columns[:3] == ["approach", "mean_F1", "appropriateness_macroF1"]
    board = R.leaderboard(rep, "mean_F1").collect()
    assert [r["approach"] for r in board] == ["multilabel-a", "multilabel-b"]
    tests = J.wilcoxon(J.approach_pairs(R.f1_metrics(runs))).collect()
    assert len(tests) == len(keys)
    assert all(t["n"] == 25 and t["p_value"] < 0.001 for t in tests)


def test_csv_keeps_every_text(spark):
    d = tempfile.mkdtemp(prefix="cvframe-csv-") + "/c"
    texts = ["  lead and trail  ", "", None, "a\\b", "c\\", 'say "hi", ok\r\n', '""', '\\"', "null", " ", ",", "\n", "\t x \n"]
    rows = [(i, t, texts[-1 - i], *([0] * 14)) for i, t in enumerate(texts)]
    C.write_corpus_csv(spark.createDataFrame(rows, corpus_schema()), d)
    back = sorted(tuple(r) for r in C.read_corpus(spark, d).collect())
    assert back == rows


def test_other_json_files_are_not_records(spark):
    """25 runs stay 25 with the files a trainer leaves beside the record."""
    from cvframe.operators import stats as J

    root = tempfile.mkdtemp(prefix="cvframe-runs-")
    for a, shift in (("007", 0.0), ("b c+d", 0.1)):
        for r in range(5):
            for f in range(5):
                p = os.path.join(root, a, f"fold{f}", f"fold{r}.{f}")
                os.makedirs(p)
                for name, extra in (("test_results.json", 0.0), ("all_results.json", 0.0), ("eval_results.json", 0.4)):
                    with open(os.path.join(p, name), "w") as fh:
                        json.dump({"eval_mean_F1": 0.5 + shift + extra + (5 * r + f) / 1000, "epoch": 2}, fh)
    runs = RIO.read_runs(spark, root, layout="study")
    assert runs.count() == 50 and {r["approach"] for r in runs.select("approach").collect()} == {"007", "b c+d"}
    t = J.wilcoxon(J.approach_pairs(runs)).first()
    assert t["n_pairs"] == t["n"] == 25


def test_study_layout_round_trip_and_repeated_runs(spark):
    import pytest

    root = tempfile.mkdtemp(prefix="cvframe-runs-")
    wide = spark.createDataFrame(
        [(a, r, f, 0.1 * r + 0.01 * f, 0.5) for a in ("007", "x") for r in range(2) for f in range(2)],
        "approach string, repeat int, fold int, eval_mean_F1 double, eval_emotional_intensity_macroF1 double")
    assert RIO.write_study_runs(wide, f"{root}/study").count() == 8
    with open(f"{root}/study/007/fold1/fold0.1/test_results.json") as fh:
        assert set(json.load(fh)) == {"eval_mean_F1", "eval_Emotional Intensity_macroF1"}
    RIO.write_runs(wide, f"{root}/parts")
    want = sorted(tuple(r) for r in RIO.runs_long(wide).collect())
    for layout, folder in (("study", "study"), ("partitioned", "parts")):
        back = RIO.read_runs(spark, f"{root}/{folder}", layout=layout)
        assert sorted(tuple(r) for r in back.collect()) == want
        assert dict(back.dtypes)["approach"] == "string"
    RIO.write_runs(wide.filter("approach = 'x'"), f"{root}/parts", mode="append")
    with pytest.raises(ValueError, match="2 records"):
        RIO.read_runs(spark, f"{root}/parts")


def test_null_cell_keeps_its_column_and_long_bodies_their_footer(spark):
    board = spark.createDataFrame([(1, "a", 0.1, None, 0.3)], "rank int, approach string, x double, y double, z double")
    assert R.latex_lines(board, ["x", "y", "z"]).first()["line"] == r"a & 0.10 & -- & 0.30 \\"
    late = spark.createDataFrame([(2_000_000, "b", 0.1)], "rank int, approach string, x double")
    path = tempfile.mkdtemp(prefix="cvframe-tex-") + "/t"
    RIO.write_latex(R.latex_table(R.latex_lines(late, ["x"]), ["approach", "x"]), path)
    lines = [r["line"] for r in RIO.read_lines(spark, path).orderBy("line_no").collect()]
    assert lines[-1] == r"\end{tabular}" and lines[-3].startswith("b &")


def _same_rows(a, b):
    return a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("split_bytes", ["64", "1000", "128m"])
def test_split_scan_equals_the_reader(spark, tmp_path, split_bytes):
    """Many splits of one file: records, quotes and line feeds across their borders."""
    r = random.Random(8)
    bits = ["word", " ", ",", '"', "\n", "\n\n", "é", '""', "a b", ";", "'", "\t"]
    rows = [(i, r.choice(["issue", 'is"sue', "two\nlines", "", None]), "".join(r.choice(bits) for _ in range(r.randint(0, 40))) or None,
             *[r.randint(0, 1) for _ in LABEL_COLS]) for i in range(150)]
    rows.append((900, "x", 'long "' + "line\n" * 200 + '"', *[1] * len(LABEL_COLS)))
    one = str(tmp_path / "one")
    C.write_corpus_csv(spark.createDataFrame(rows, corpus_schema()).coalesce(1), one)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        want = C.read_corpus(spark, one)
        got = C.read_corpus(spark, one, split=True)
        assert _same_rows(got, want) and got.count() == len(rows)
        assert _same_rows(C.read_corpus(spark, one, by_name=True, split=True), C.read_corpus(spark, one, by_name=True))
        if split_bytes == "64":
            assert spark.read.option("lineSep", "\n").text(one).rdd.getNumPartitions() > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_split_scan_of_several_files_and_odd_ends(spark, tmp_path):
    head = "post_id,issue,post_text," + ",".join(LABEL_COLS)
    zeros = ",0" * len(LABEL_COLS)
    (tmp_path / "a.csv").write_bytes(f'{head}\r\n1,x,"a ""quoted"" text"{zeros}\r\n\r\n2,y,plain{zeros}\r\n'.encode())
    (tmp_path / "b.csv").write_bytes(f'{head}\n3,z,"no line feed\nat the end"{zeros}'.encode())
    (tmp_path / "c.csv").write_bytes(f"{head}\n".encode())
    got = C.read_corpus(spark, str(tmp_path), split=True)
    assert _same_rows(got, C.read_corpus(spark, str(tmp_path))) and got.count() == 3
