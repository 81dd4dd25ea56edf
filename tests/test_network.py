"""Networks with several outputs: slopes, missing labels, stops."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import history as hist
from sievework.plans import network as net


@pytest.mark.parametrize("loss", ["bce", "mse", "focal"])
@pytest.mark.parametrize("activation", ["relu", "tanh", "selu"])
@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_gradient_against_differences(loss, activation, dropout):
    rng = np.random.default_rng(0)
    sizes, n = (5, 6, 4, 3), 20
    settings = net.Settings(hidden=sizes[1:-1], loss=loss, activation=activation, dropout=dropout)
    w = net.start_weights(sizes, 1) + 0.1 * rng.normal(size=len(net.start_weights(sizes, 1)))
    x, y = rng.normal(size=(n, 5)), rng.integers(0, 2, (n, 3)).astype(float)
    y[rng.random((n, 3)) < 0.4] = np.nan
    weight, rows = rng.random(n), rng.integers(0, 1 << 60, n)
    g, cost, total = net.gradient(w, sizes, x, y, weight, settings, rows, 7)
    assert total == pytest.approx((~np.isnan(y) * weight[:, None]).sum())
    for k in range(0, len(w), 3):
        step = np.zeros_like(w)
        step[k] = 1e-6
        up, down = (net.gradient(w + s * step, sizes, x, y, weight, settings, rows, 7)[1] for s in (1, -1))
        assert g[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_missing_labels_add_nothing():
    rng = np.random.default_rng(0)
    sizes, settings = (4, 3, 2), net.Settings(hidden=(3,))
    w, x, y = net.start_weights(sizes, 0), rng.normal(size=(6, 4)), np.full((6, 2), np.nan)
    assert net.gradient(w, sizes, x, y, np.ones(6), settings)[1:] == (0, 0)
    y[:3, 0], y[2:, 1] = 1, 0
    whole = net.gradient(w, sizes, x, y, np.ones(6), settings)
    parts = [net.gradient(w, sizes, x[k : k + 1], y[k : k + 1], np.ones(1), settings) for k in range(6)]
    assert np.allclose(whole[0], sum(p[0] for p in parts)) and whole[2] == 7


def rows_of(spark, n=300, parts=4):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 6))
    y = np.stack([(x[:, 0] * x[:, 1] > 0), (x[:, 2] > 0.3)], axis=1).astype(float)
    rows = [
        (k, x[k].tolist(), None if k % 3 == 0 else int(y[k, 0]), None if k % 4 == 0 else int(y[k, 1]), "test" if k % 5 == 0 else "val" if k % 5 == 1 else "train", 1.0 if k % 2 else None)
        for k in range(n)
    ]
    rows += [(n, None, 1, 1, "train", 1.0), (n + 1, [0.0] * 6, None, None, "train", 1.0)]
    return spark.createDataFrame(rows, "id long, x array<double>, a int, b int, part string, w double").repartition(parts)


def test_fit_restores_the_best_round(spark, tmp_path):
    df = rows_of(spark).withColumn("again", F.col("part")).withColumn("none", F.lit("other"))
    runs = {
        "part": net.Settings(hidden=(16,), rounds=25, patience=3, min_delta=0.002, rate=0.1),
        "again": net.Settings(hidden=(8, 4), rounds=12, dropout=0.3, l2=0.001, decay=0.05, activation="selu"),
        "none": net.Settings(rounds=5),
    }
    fitted = net.fit(df, "id", "x", ["a", "b"], runs, weight="w")
    history = {}
    for r in fitted.history.orderBy("run", "epoch").collect():
        history.setdefault(r.run, []).append(r.val_loss)
    assert {len(history["part"]) <= 25, len(history["again"]) <= 12} == {True} and len(history["none"]) == 1
    assert history["part"][-1] < history["part"][0]
    stops = {r["run"]: r for r in fitted.stops.collect()}
    # The weights that were kept give the loss of the round that early_stop names.
    pdf = df.filter("x is not null and part = 'val'").toPandas()
    x, y = np.array(pdf["x"].tolist()), pdf[["a", "b"]].to_numpy(dtype=float)
    for name in ("part", "again"):
        settings, sizes, weights = fitted.runs[name]
        there = ~np.isnan(y)
        cost, _ = net.LOSSES["bce"](net.forward(weights, sizes, x, settings), np.where(there, y, 0))
        loss = (cost * there).sum() / there.sum()
        assert loss == pytest.approx(history[name][stops[name]["best_epoch"]], rel=1e-9)
        assert stops[name]["best"] == pytest.approx(loss)
    # SQL reads the stop and the restored round off the stored history.
    fitted.history.write.parquet(f"{tmp_path}/history")
    sql = f"""with recursive h as (select * from read_parquet('{tmp_path}/history/*.parquet') where run = 'part'),
      s as (select epoch, val_loss as best, epoch as kept, 0 as wait from h where epoch = 0
        union all select h.epoch, case when h.val_loss < s.best - 0.002 then h.val_loss else s.best end,
          case when h.val_loss < s.best - 0.002 then h.epoch else s.kept end,
          case when h.val_loss < s.best - 0.002 then 0 else s.wait + 1 end
        from s join h on h.epoch = s.epoch + 1 where s.wait < 3)
      select last(kept order by epoch), min(epoch) filter (wait >= 3) from s"""
    best, stop = duckdb.sql(sql).fetchall()[0]
    assert (best, stop) == (stops["part"]["best_epoch"], stops["part"]["stop_epoch"])
    assert stop is None or stop == len(history["part"]) - 1
    # The other history operators take the same table.
    smooth = hist.smooth(fitted.history, "run", "epoch", "val_loss").filter("run = 'part'").count()
    assert smooth == len(history["part"]) and hist.best_epoch(fitted.history, "run", "epoch", "val_loss").count() == 3
    assert hist.history_long(fitted.history, "run", "epoch", ["loss", "val_loss"]).count() == 2 * fitted.history.count()
    scored = net.score(df, "id", "x", fitted).filter("run = 'part' and target = 'b' and y_true is not null").toPandas()
    assert len(scored) == sum(1 for k in range(0, 300, 5) if k % 4) and ((scored.score >= 0.5) == scored.y_true).mean() > 0.8


def test_layout_does_not_matter(spark):
    runs = {"part": net.Settings(hidden=(5,), rounds=6, dropout=0.5)}
    one, many = (net.fit(rows_of(spark, parts=p), "id", "x", ["a", "b"], runs).runs["part"][2] for p in (1, 7))
    assert np.allclose(one, many, rtol=1e-9, atol=1e-12)


def test_no_rows(spark):
    fitted = net.fit(rows_of(spark).limit(0), "id", "x", ["a", "b"], {"part": net.Settings()})
    assert fitted.history.count() == 0 and fitted.stops.count() == 0
    assert net.halving(2048) == (1024, 512, 256, 128) and math.isinf(net._Run("r", net.Settings(), (1, 1), *[np.zeros(2)] * 4).best_loss)


def test_halving_ranks_by_sql(spark, tmp_path):
    df = rows_of(spark).filter("x is not null").withColumn("fold", (F.col("id") % 2 + 1).cast("int"))
    settings = {f"s{k}": net.Settings(hidden=(4,), rate=r) for k, r in enumerate((0.0001, 0.01, 0.05, 0.2, 0.001))}
    scores = net.successive_halving(df, "id", "x", ["a", "b"], settings, "fold", 2, (2, 3, 4))
    scores.write.parquet(f"{tmp_path}/scores")
    assert {r.rung: r.n for r in scores.groupBy("rung").agg(F.count_distinct("setting").alias("n")).collect()} == {0: 5, 1: 3, 2: 2}
    sql = f"""with m as (select setting, rung, avg(score) as mean from read_parquet('{tmp_path}/scores/*.parquet') group by all),
      l as (select setting, max(rung) as rung, max_by(mean, rung) as mean from m group by setting)
      select setting, rung, round(mean, 9), row_number() over (order by rung desc, mean, setting) as rank from l"""
    got = [(r.setting, r.rung, round(r["mean"], 9), r["rank"]) for r in net.halving_ranks(scores).collect()]
    assert sorted(got) == sorted(duckdb.sql(sql).fetchall())
    # Who goes on is who was better.
    kept = {k: {r.setting for r in scores.filter(f"rung = {k}").collect()} for k in range(3)}
    first = {r[0]: r[1] for r in scores.filter("rung = 0").groupBy("setting").avg("score").collect()}
    assert kept[1] == set(sorted(first, key=lambda n: (first[n], n))[:3]) and kept[2] < kept[1] < kept[0]
