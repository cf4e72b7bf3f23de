"""Stages run from a configuration."""

import json

import pytest

from skysieve.plans import runner
from skysieve.sources import synthetic


def test_stages_from_files(spark, tmp_path):
    burnt = synthetic.fires(spark, "2023-10-01", 8, n=60)
    burnt.write.parquet(f"{tmp_path}/fires")
    config = tmp_path / "inventory.json"
    config.write_text(json.dumps({"inputs": {"fires": f"{tmp_path}/fires"}, "output": f"{tmp_path}/out", "options": {"step": 1.0}}))
    got = runner.run(spark, "inventory", runner.read_config(str(config)))
    assert set(got) == {"grid", "ensemble"} and got["grid"].count() > 0
    assert spark.read.parquet(f"{tmp_path}/out/ensemble").count() == got["ensemble"].count()
    with pytest.raises(ValueError):
        runner.run(spark, "inventory", {})
    with pytest.raises(ValueError):
        runner.run(spark, "nothing", {})


def test_train_then_predict(spark, tmp_path):
    cube = synthetic.grid(spark, "2023-10-01", 6, step=4.0)
    reg, labels = synthetic.stations(spark, cube, n=12, step=4.0)
    for name, df in (("cube", cube), ("stations", reg), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}")
    paths = {n: f"{tmp_path}/{n}" for n in ("cube", "stations", "labels", "matrix/matrix")}
    runner.run(spark, "build_features", {"inputs": paths, "output": f"{tmp_path}/matrix", "options": {"lags": []}})
    how = {"pollutants": ["pm25"], "models_path": f"{tmp_path}/models"}
    scores = runner.run(spark, "train", {"inputs": {"matrix": f"{tmp_path}/matrix/matrix"}, "options": how | {"kind": "linear"}})["scores"]
    assert scores.count() == 1 and scores.first().r > 0.3
    index = runner.run(spark, "predict", {"inputs": paths, "options": how})["index"]
    assert index.count() == cube.count() and index.filter("pm25_pred IS NULL").count() == 0


def test_fused_field_has_no_gap(spark, tmp_path):
    rows = [(i, j, 10.0 + i, 70.0 + j, 0, s, None if (i + j) % 3 == k else 0.1 * (k + 1)) for i in range(4) for j in range(4) for k, s in enumerate(("maiac", "insat"))]
    spark.createDataFrame(rows, "i int, j int, lat double, lon double, t int, source string, v double").write.parquet(f"{tmp_path}/stack")
    out = runner.run(spark, "fuse", {"inputs": {"stack": f"{tmp_path}/stack"}})
    assert out["fused"].filter("filled IS NULL").count() == 0 and out["fused"].count() == 16 and out["gaps"].first().n == 16


def test_info_names_all_stages(capsys):
    runner.main(["info"])
    told = capsys.readouterr().out
    assert all(f"{n}:" in told for n in runner.STAGES)
