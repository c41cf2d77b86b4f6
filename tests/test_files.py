"""Files as broken runs leave them, and audits of folds."""

import pytest

from walkloom.operators import splits
from walkloom.sources import tables


def test_metrics_of_broken_files(spark, tmp_path):
    good = '{"config": {"m": 2}, "summary": {"mean_test_mae": 0.5}, "note": "a \\" and a { brace"}'
    bodies = {"a_m2/gap/split0": good, "a_m2/gap/split1": good + "\n" + good.replace("0.5", "9"), "a_m2/gap/split2": good[:-20], "a_m2/gap/split3": "", "a_m2/gap/split4": "none", "m4/gap/seed5": good, "a_m2/gap/split6": '{"other": 1}', "a_m2/gap/split7": good + '\n{"summary": '}
    for folder, body in bodies.items():
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "metrics.json").write_text(body)
    got = {(r["model"], r["m"], r["seed"]): r["summary"]["mean_test_mae"] for r in tables.read_run_metrics(spark, str(tmp_path)).collect()}
    assert got == {("a", 2, 0): 0.5, ("a", 2, 1): 0.5, ("a", 2, 7): 0.5, (None, 4, 5): 0.5}


def test_target_tables_after_a_broken_run(spark, tmp_path):
    path, names = f"file://{tmp_path}/targets", ["p", "q"]
    rows = spark.createDataFrame([(g, [float(g), -float(g)]) for g in range(50)], "g long, y array<double>")
    assert tables.written_targets(spark, path).count() == 0
    tables.write_target_tables(rows.limit(20), path, names)
    for _ in range(2):
        tables.write_target_tables(rows, path, names)
        assert {r["target"]: r["n"] for r in tables.written_targets(spark, path).collect()} == {"p": 50, "q": 50}
    before = sorted(f.name for f in (tmp_path / "targets").rglob("*.parquet"))
    tables.write_target_tables(rows, path, names)
    assert sorted(f.name for f in (tmp_path / "targets").rglob("*.parquet")) == before


def test_audits(spark):
    keys = spark.createDataFrame([(i,) for i in range(10)], "id long")
    folds = spark.createDataFrame([(0, i, "train" if i < 6 else "test") for i in range(10)], "split_no int, id long, fold string")
    assert splits.fold_audit(folds, keys, {"train": 6, "test": 4}).collect() == [(0, 10, 0, 0, 0)]
    odd = folds.where("id <> 3").unionByName(spark.createDataFrame([(0, 8, "train"), (0, 77, "test")], folds.schema))
    assert splits.fold_audit(odd, keys).collect() == [(0, 11, 1, 1, 1)]
    with pytest.raises(Exception, match="test has 5, not 4"):
        splits.fold_audit(odd, keys, {"train": 6, "test": 4}).collect()
    with pytest.raises(Exception, match="valid has 0, not 1"):
        splits.fold_audit(folds, keys, {"train": 6, "test": 4, "valid": 1}).collect()
    assert [tuple(r) for r in splits.key_audit(keys, keys.where("id < 3"), "id").collect()] == [("only_a", 7, [3, 4, 5, 6, 7]), ("only_b", 0, [])]


def test_fixed_split_asserts_sizes(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "idx long")
    published = spark.createDataFrame([(i + 1, "train" if i < 4 else "test") for i in range(9)], "id long, fold string")
    assert sorted(map(tuple, splits.fixed_split(rows, published, "idx", sizes={"train": 4, "test": 2}).collect())) == [(i, "train" if i < 4 else "test") for i in range(6)]
    with pytest.raises(ValueError, match="test has 2, not 5"):
        splits.fixed_split(rows, published, "idx", sizes={"train": 4, "test": 5})
