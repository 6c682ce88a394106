from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import frame, random_prices
from panelyard.functions import groups
from panelyard.functions.storage import materialize
from panelyard.operators import composite as cp
from panelyard.operators import evaluation as ev
from panelyard.operators import gram
from panelyard.operators import screening as sc
from panelyard.operators.factors import momentum, reversal
from panelyard.operators.labels import forward_return
from panelyard.operators.transforms import apply_universe_mask
from panelyard.sources.contracts import require_unique_tables


@pytest.fixture
def tables(spark):
    prices = random_prices(spark, 20, 15)
    factors = momentum(prices, window=1).unionByName(reversal(prices, window=3)).unionByName(momentum(prices, window=4))
    return materialize(factors), materialize(forward_return(prices, horizon=1))


def test_written_tables_are_dealt_by_their_rows(spark, tables, monkeypatch):
    factors, labels = tables
    want = {
        "panel": frame(cp.alpha_return_panel(factors.select("*"), labels.select("*"), max_group=20), "date", "factor"),
        "stats": frame(sc.univariate_factor_stats(factors.select("*"), labels.select("*"), max_group=20), "factor"),
        "corr": frame(sc.pairwise_correlation(factors.select("*")), "a", "b"),
    }
    monkeypatch.setattr(groups, "TASK_ROWS", 20)  # 900 rows: 45 tasks, of which adaptive execution left one before
    pairs = ev.aligned(factors, labels)
    ranks = ev.rank_ic_of_pairs(pairs, ["date", "factor", "label"], max_group=20)
    assert ranks.rdd.getNumPartitions() == 45
    assert gram.key_arrays(factors, ["date", "asset"], "factor", ["momentum_1d", "momentum_4d", "reversal_3d"]).rdd.getNumPartitions() == 45
    got = {
        "panel": frame(cp.alpha_return_panel(factors, labels, max_group=20), "date", "factor"),
        "stats": frame(sc.univariate_factor_stats(factors, labels, max_group=20), "factor"),
        "corr": frame(sc.pairwise_correlation(factors), "a", "b"),
    }
    for name, table in want.items():
        assert got[name].round(9).equals(table.round(9)), name


def test_repeated_keys_of_written_tables_raise(spark, tables):
    factors, labels = tables
    require_unique_tables({"factors": factors, "labels": labels}, ("date", "asset", "factor"))
    with pytest.raises(ValueError, match="factors breaks its contract: duplicate_key=900"):
        require_unique_tables({"factors": materialize(factors.union(factors)), "labels": labels}, ("date", "asset", "factor"))


def test_the_alpha_panel_is_computed_once(spark, tables, monkeypatch):
    """Correlations read it several times; prices and pairs behind it are taken once."""
    panel = cp.alpha_return_panel(*tables, max_group=20)
    assert panel._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0


def test_report_tables_read_written_pairs(spark):
    prices = materialize(random_prices(spark, 4, 12))
    report = ev.build_factor_report(prices, materialize(momentum(prices, window=2)), horizon=1, max_group=4)
    for name in ("ic", "rank_ic", "quantile_returns"):  # each joined factors with labels of its own before
        assert "Join" not in report[name]._jdf.queryExecution().optimizedPlan().toString(), name


def test_execution_flags_read_the_lines_twice(spark, monkeypatch):
    """Once for prices and once for market states; target, execution and skipped orders took both anew before."""
    from panelyard.catalog import panels, registry

    read, table = [], panels.table
    monkeypatch.setattr(panels, "table", lambda session, sf_dir, name: (read.append(name), table(session, sf_dir, name))[1])
    assert registry.queries()["execution_impact_flags"](spark, "/root/testdata/sf0.001").count() == 6
    assert read.count("lineitem") == 2


def test_the_composite_workflow_reads_and_pairs_once(spark, monkeypatch):
    """Lines were read six times and pairs taken three times before, each with exchanges of its own."""
    from panelyard.catalog import panels, registry

    read, paired, table, align = [], [], panels.table, ev.align
    monkeypatch.setattr(panels, "table", lambda session, sf_dir, name: (read.append(name), table(session, sf_dir, name))[1])
    monkeypatch.setattr(ev, "align", lambda *given, **options: (paired.append(1), align(*given, **options))[1])
    assert registry.queries()["composite_workflow"](spark, "/root/testdata/sf0.001").count() == 1
    assert read.count("lineitem") == 2 and len(paired) == 1


def test_one_table_of_masks_equals_two(spark, tables):
    factors, _ = tables
    keys = factors.select("date", "asset").distinct()
    masks = keys.where("asset <> 'a03'").select("*", (F.col("asset") < "a15").alias("in_universe"), F.when(F.col("asset") != "a07", F.dayofmonth("date") > 4).alias("is_tradable"))
    apart = apply_universe_mask(factors, masks.select("date", "asset", "in_universe"), masks.select("date", "asset", "is_tradable"))
    once = apply_universe_mask(factors, masks, masks)
    assert frame(once, "date", "asset", "factor").equals(frame(apart, "date", "asset", "factor"))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # two before


def test_a_given_history_gives_the_same_weights(spark, tables):
    factors, labels = tables
    history = cp.ic_history(factors, labels, max_group=20)
    some = factors.where("factor <> 'momentum_4d'")
    want = cp.composite_weights(some, method="icir", labels=labels, lookback=6, min_history=3, max_group=20)
    got = cp.composite_weights(some, method="icir", lookback=6, min_history=3, max_group=20, history=history)
    assert frame(got, "date", "factor").round(9).equals(frame(want, "date", "factor").round(9))
