"""The scale of a band is fitted without a task that holds the band."""

from __future__ import annotations

from fieldmosaic.operators import calibration


def test_fit_holds_no_band_in_one_task(rows):
    long = rows(
        "split string, band string, lfmc_pct double, vegf double, canopy_height double, vod_obs double",
        [("train" if i % 3 else "test", ("C", "X")[i % 2], 80.0 + i, 0.1 + i / 100, 5.0 + i, 0.2 + i / 50) for i in range(60)],
    )
    sliced = calibration.fit_and_score(long)
    assert "percentile" not in sliced._jdf.queryExecution().optimizedPlan().toString()
    eta = calibration.band_scale(calibration.scale_targets(long.where("split = 'train'")))
    whole = calibration.metrics.regression_metrics(calibration.predict_depth(long, eta), ["split", "band"], "vod_obs", "vod_hat")
    assert {tuple(r) for r in sliced.select("split", "band", "n").collect()} == {tuple(r) for r in whole.select("split", "band", "n").collect()}
    errors = [{(r.split, r.band): r.MAE for r in df.collect()} for df in (sliced, whole)]
    assert all(abs(errors[0][k] - errors[1][k]) < 1e-9 for k in errors[1])
