from __future__ import annotations

from datetime import timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import day, frame
from panelyard.operators import sample_weights as sw
from panelyard.operators import splits


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        d = int(rng.integers(0, 23))
        s = d + int(rng.integers(0, 2))
        rows.append((f"s{i:02d}", day(d), day(s), day(s + int(rng.integers(0, 5))), float(rng.normal()) if i % 9 else None))
    return spark.createDataFrame(rows, "sample_id string, date date, event_start date, event_end date, r double")


def purged(pdf, combos, groups, embargo):
    dates = sorted(pdf["date"].unique())
    blocks = np.array_split(np.array(dates, dtype=object), groups)
    out = {}
    for f, combo in enumerate(combos):
        test_dates = {d for g in combo for d in blocks[g]}
        test = pdf[pdf["date"].isin(test_dates)]
        last = dates.index(max(test_dates))
        after = set(dates[last + 1 : last + 1 + embargo])
        for r in pdf.itertuples():
            if r.date in test_dates:
                role = "test"
            elif ((test.event_start <= r.event_end) & (r.event_start <= test.event_end)).any():
                role = "purged"
            else:
                role = "embargoed" if r.date in after else "train"
            out[(f, r.sample_id)] = role
    return out


@pytest.mark.parametrize("embargo", [0, 2])
def test_purged_kfold(events, embargo):
    got = {(r["fold_id"], r["sample_id"]): r["role"] for r in splits.purged_kfold_split(events, n_splits=4, embargo_periods=embargo).collect()}
    assert got == purged(frame(events), [(g,) for g in range(4)], 4, embargo)


def test_combinatorial_purged(events):
    got = {(r["fold_id"], r["sample_id"]): r["role"] for r in splits.combinatorial_purged_split(events, n_groups=5, n_test_groups=2, embargo_periods=1).collect()}
    assert got == purged(frame(events), list(combinations(range(5), 2)), 5, 1)


def test_fold_summary_adds_up(events):
    s = frame(splits.purged_validation_summary(events, n_splits=3, embargo_periods=1), "fold_id")
    assert (s[["n_train", "n_test", "n_purged", "n_embargoed"]].sum(axis=1) == 60).all()


def test_overlap_and_merge(events):
    pdf = frame(events)
    test = events.where(F.col("date") < F.lit(day(5)))
    got = {r["sample_id"] for r in splits.overlapping(events, test).collect()}
    t = pdf[pdf["date"] < day(5)]
    want = {r.sample_id for r in pdf.itertuples() if ((t.event_start <= r.event_end) & (r.event_start <= t.event_end)).any()}
    assert got == want
    assert splits.overlapping(events, test.limit(0)).count() == 0
    merged = frame(splits.merge_intervals(events.select("event_start", "event_end")), "event_start")
    covered = {d for r in merged.itertuples() for d in pd.date_range(r.event_start, r.event_end)}
    assert covered == {d for r in pdf.itertuples() for d in pd.date_range(r.event_start, r.event_end)}
    assert (merged["event_start"].iloc[1:].to_numpy() > merged["event_end"].iloc[:-1].to_numpy()).all()


@pytest.mark.parametrize("sizes", [(6, 3, 3, 0), (5, 2, 4, 2), (4, 4, 1, 1), (30, 3, 1, 0)])
def test_walk_forward(spark, sizes):
    train, test, step, val = sizes
    dates = spark.createDataFrame([(day(i),) for i in range(20)] * 2, "date date")
    got = {(r["fold_id"], r["date"]): r["role"] for r in splits.walk_forward_split(dates, train_size=train, test_size=test, step=step, val_size=val).collect()}
    want, start, fold = {}, 0, 0
    while start + train + test <= 20:
        for i in range(train + test):
            want[(fold, day(start + i))] = "test" if i >= train else "val" if i >= train - val else "train"
        start, fold = start + step, fold + 1
    assert got == want


def test_time_split_gap(spark):
    df = splits.time_split(spark.createDataFrame([(day(i),) for i in range(6)], "date date"), train_end="2024-01-02", test_start="2024-01-05")
    assert [r["split"] for r in df.orderBy("date").collect()] == ["train", "train", None, None, "test", "test"]
    with pytest.raises(ValueError):
        splits.time_split(df, train_end="2024-01-05", test_start="2024-01-05")


def weekdays(pdf):
    return pd.bdate_range(min(pdf.event_start), max(pdf.event_end))


def test_concurrency_and_uniqueness(events):
    pdf = frame(events, "sample_id")
    cal = weekdays(pdf)
    active = np.array([[(pd.Timestamp(r.event_start) <= c <= pd.Timestamp(r.event_end)) for c in cal] for r in pdf.itertuples()])
    conc = active.sum(axis=0)
    got = frame(sw.concurrency_by_date(events), "date")
    assert got["concurrency"].tolist() == conc.tolist()
    u = np.array([np.mean(1 / conc[a]) if a.any() else 0.0 for a in active])
    w = frame(sw.uniqueness_weights(events), "sample_id")["weight_uniqueness"]
    np.testing.assert_allclose(w, u / u.sum())


def test_custom_calendar(spark, events):
    cal = spark.createDataFrame([(day(i),) for i in (-3, 2, 4, 9, 40)], "date date")
    got = frame(sw.concurrency_by_date(events, calendar=cal), "date")
    pdf = frame(events)
    want = [sum(r.event_start <= day(i) <= r.event_end for r in pdf.itertuples()) for i in (-3, 2, 4, 9, 40)]
    assert got["concurrency"].tolist() == want


def test_weight_table_is_normalized(events):
    out = frame(sw.build_sample_weights(events, return_col="r", confidence_col="r", half_life_periods=4), "sample_id")
    for c in ("weight_uniqueness", "weight_return_magnitude", "weight_confidence", "weight_time_decay", "sample_weight"):
        assert out[c].sum() == pytest.approx(1.0) and (out[c] >= 0).all()
    pdf = frame(events, "sample_id")
    assert (out["weight_return_magnitude"][pdf["r"].isna()] == 0).all()
    parts = out[["weight_uniqueness", "weight_return_magnitude", "weight_confidence", "weight_time_decay"]].prod(axis=1)
    np.testing.assert_allclose(out["sample_weight"], parts / parts.sum())


def test_weights_fall_back_to_uniform(spark):
    df = spark.createDataFrame([("a", day(0), None), ("b", day(1), None)], "sample_id string, date date, r double")
    assert frame(sw.return_magnitude_weights(df, return_col="r"), "sample_id")["weight_return_magnitude"].tolist() == [0.5, 0.5]
    c = frame(sw.confidence_weights(df, confidence_col="r"), "sample_id")["weight_confidence"].tolist()
    assert c == [0.5, 0.5]
    t = frame(sw.time_decay_weights(df, half_life_periods=1, reference_date="2024-01-01"), "sample_id")["weight_time_decay"].tolist()
    assert t == [0.5, 0.5]


@pytest.mark.parametrize("groups, tests", [(6, 3), (12, 6), (70, 1)])
def test_counts_from_bit_sets_equal_counted_rows(spark, groups, tests):
    """Also for more blocks than a word has bits, and for 924 folds."""
    rng = np.random.default_rng(groups)
    rows = [(i, day(int(rng.integers(0, 90))), int(rng.integers(0, 6)), int(rng.integers(0, 9))) for i in range(250)] + [(1000 + i, day(i), 0, 1) for i in range(90)]
    samples = spark.createDataFrame([(i, d, d + timedelta(days=a), d + timedelta(days=a + b)) for i, d, a, b in rows], "sample_id int, date date, event_start date, event_end date")
    counted = splits.combinatorial_validation_summary(samples, n_groups=groups, n_test_groups=tests, embargo_periods=2).orderBy("fold_id").collect()
    combos = list(combinations(range(groups), tests))
    assert len(counted) == len(combos)
    some = combos if groups < 12 else [combos[i] for i in range(0, len(combos), 83)]
    want = purged(frame(samples), some, groups, 2)
    by_fold = {c.fold_id: c for c in counted}
    for n, combo in enumerate(some):
        roles = [r for (f, _), r in want.items() if f == n]
        c = by_fold[combos.index(combo)]
        assert (c.n_train, c.n_test, c.n_purged, c.n_embargoed) == tuple(roles.count(r) for r in ("train", "test", "purged", "embargoed"))
    if groups == 6:
        long = splits.purged_fold_summary(splits.combinatorial_purged_split(samples, n_groups=groups, n_test_groups=tests, embargo_periods=2)).orderBy("fold_id").collect()
        assert [tuple(r) for r in long] == [tuple(r) for r in counted]


def test_summary_repeats_no_samples(spark, events):
    """Samples are counted by date and bits before any fold is looked at."""
    plan = splits.combinatorial_validation_summary(events, n_groups=6, n_test_groups=3)._jdf.queryExecution().optimizedPlan().toString()
    cross = plan.index("Join Cross") if "Join Cross" in plan else plan.index("Join Inner")
    assert plan.index("Aggregate [decision_date", cross) > cross and "Generate" not in plan
