"""Single-factor and composite research workflows, from prices to a promotion verdict."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.columns import clean
from panelyard.functions.groups import dealt, fits
from panelyard.functions.storage import materialize, path_of, written_rows
from panelyard.operators import composite as cp
from panelyard.operators import evaluation as ev
from panelyard.operators import frictions as fr
from panelyard.operators import portfolio as pf
from panelyard.operators import screening as sc
from panelyard.operators.factors import FactorFn
from panelyard.operators.labels import build_labels, interval_samples, labels_to_canonical
from panelyard.operators.neutralization import neutralize_signal
from panelyard.operators.splits import purged_validation_summary
from panelyard.operators.transforms import apply_preprocess, apply_universe_mask
from panelyard.operators.universe import UniverseRules, construct_research_universe
from panelyard.operators.verdicts import CompositeThresholds, SingleFactorThresholds, composite_verdict, single_factor_verdict
from panelyard.plans.experiment import run_factor_experiment, summarise_parts
from panelyard.plans.walk_forward import run_walk_forward_experiment


VALIDATION_MODES = ("single_split", "purged_kfold", "walk_forward")


def _positive(spec: object, *names: str) -> None:
    for n in names:
        if getattr(spec, n) <= 0:
            raise ValueError(f"{n} must be > 0")


@dataclass(frozen=True)
class Preprocess:
    """Cross-sectional preprocessing, in this order: winsorize, z-score, rank, coverage gate."""

    winsorize: bool = True
    lower: float = 0.01
    upper: float = 0.99
    zscore: bool = True
    rank: bool = False
    min_group_size: int = 3
    min_coverage: float | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.lower < self.upper <= 1:
            raise ValueError("winsorize bounds must be in [0, 1], the lower one below the upper one")
        _positive(self, "min_group_size")
        if self.min_coverage is not None and not 0 < self.min_coverage <= 1:
            raise ValueError("min_coverage must be in (0, 1]")


@dataclass(frozen=True)
class Neutralization:
    """Regression on the exposures that are named; at least one of them."""

    size_col: str | None = None
    industry_col: str | None = None
    beta_col: str | None = None
    min_obs: int = 20
    ridge: float = 1e-8

    def __post_init__(self) -> None:
        if not (self.size_col or self.industry_col or self.beta_col):
            raise ValueError("at least one of size_col, industry_col and beta_col must be given")
        _positive(self, "min_obs")
        if self.ridge < 0:
            raise ValueError("ridge must be >= 0")


def _check_common(spec: SingleFactorSpec | CompositeSpec) -> None:
    if not spec.experiment_name.strip():
        raise ValueError("experiment_name must not be empty")
    _positive(spec, "horizon")
    if spec.n_quantiles < 2:
        raise ValueError("n_quantiles must be >= 2")


@dataclass(frozen=True)
class SingleFactorSpec:
    factor_fn: FactorFn
    experiment_name: str = "single_factor"
    horizon: int = 5
    n_quantiles: int = 5
    label_method: str = "forward_return"
    label_kwargs: dict = field(default_factory=dict)
    validation_mode: str = "purged_kfold"
    n_splits: int = 5
    embargo_periods: int = 0
    train_end: str | None = None
    test_start: str | None = None
    train_size: int = 252
    test_size: int = 63
    step: int = 63
    val_size: int = 0
    universe_rules: UniverseRules = UniverseRules()
    preprocess: Preprocess = Preprocess()
    neutralization: Neutralization | None = None
    trial_count: int = 1
    screening_min_abs_monotonicity: float = 0.1
    screening_max_pairwise_corr: float = 0.95
    screening_max_vif: float = 20.0
    thresholds: SingleFactorThresholds = SingleFactorThresholds()

    def __post_init__(self) -> None:
        _check_common(self)
        if self.validation_mode not in VALIDATION_MODES:
            raise ValueError(f"validation_mode must be one of {VALIDATION_MODES}")
        if self.validation_mode == "single_split" and (self.train_end is None) != (self.test_start is None):
            raise ValueError("single_split needs train_end and test_start together")
        if self.validation_mode == "purged_kfold" and self.n_splits < 2:
            raise ValueError("n_splits must be >= 2")
        if self.validation_mode == "walk_forward":
            _positive(self, "train_size", "test_size", "step")

    def shared(self) -> tuple:
        """What specs must have in common to be evaluated in one plan."""
        return (
            self.horizon, self.n_quantiles, self.label_method, repr(sorted(self.label_kwargs.items())), self.validation_mode, self.n_splits, self.embargo_periods,
            self.train_end, self.test_start, self.train_size, self.test_size, self.step, self.val_size, self.universe_rules, self.preprocess, self.neutralization,
        )

    def gates(self) -> dict[str, float]:
        return dict(
            min_coverage=self.thresholds.min_coverage, min_abs_monotonicity=self.screening_min_abs_monotonicity,
            max_pairwise_corr=self.screening_max_pairwise_corr, max_vif=self.screening_max_vif,
        )


@dataclass(frozen=True)
class CompositeSpec:
    experiment_name: str = "composite"
    horizon: int = 5
    n_quantiles: int = 5
    label_method: str = "forward_return"
    label_kwargs: dict = field(default_factory=dict)
    universe_rules: UniverseRules = UniverseRules()
    preprocess: Preprocess = Preprocess()
    neutralization: Neutralization | None = None
    screening: dict = field(default_factory=dict)
    composite_method: str = "icir"
    composite_lookback: int = 63
    composite_min_history: int = 10
    composite_factor_name: str = "composite_signal"
    portfolio: pf.Strategy = pf.Strategy(long_top_k=20, short_bottom_k=20, weighting_method="equal")
    portfolio_value: float = 1e7
    adv_window: int = 20
    max_adv_participation: float = 0.05
    concentration_weight_threshold: float = 0.05
    costs: dict = field(default_factory=lambda: dict(flat_fee_bps=1.0, spread_bps=5.0, impact_eta=0.1))
    thresholds: CompositeThresholds = CompositeThresholds()

    def __post_init__(self) -> None:
        _check_common(self)
        if self.portfolio.long_top_k is None or self.portfolio.short_bottom_k is None:
            raise ValueError("the portfolio needs long_top_k and short_bottom_k")
        _positive(self, "portfolio_value")
        if self.adv_window <= 1:
            raise ValueError("adv_window must be > 1")
        if self.thresholds.min_selected_factors < 2:
            raise ValueError("min_selected_factors must be >= 2")


def prepare_signals(
    factors: DataFrame, universe: Mapping[str, DataFrame], *, preprocess: Preprocess = Preprocess(), neutralization: Neutralization | None = None,
    exposures: DataFrame | None = None, by: Sequence[str] = ("date", "factor"), max_group: int | None = None,
) -> DataFrame:
    """Mask, preprocess and neutralize every factor of a table in one job.

    ``by=("date",)`` preprocesses all factors of a date as one pooled cross-section; the
    regression is always per factor.
    """
    out = apply_universe_mask(factors, universe["universe"], universe["tradability"])
    out = apply_preprocess(out, by=by, max_group=max_group, **asdict(preprocess))
    if neutralization is None:
        return out
    n = neutralization
    wanted = [c for c in (n.size_col, n.beta_col, n.industry_col) if c]
    if exposures is not None:
        out = out.join(exposures.select("date", "asset", *wanted), ["date", "asset"], "left")
    fitted = neutralize_signal(
        materialize(out), by=("date", "factor"), size_col=n.size_col, industry_col=n.industry_col, beta_col=n.beta_col, min_obs=n.min_obs, ridge=n.ridge
    )
    return fitted["data"].select("date", "asset", "factor", F.col("value_neutralized").alias("value"))


def generate_candidate_signals(prices: DataFrame, factor_fns: Mapping[str, FactorFn]) -> DataFrame:
    """Union of several factors, each under its given name."""
    parts = [fn(prices).select("date", "asset", F.lit(name).alias("factor"), "value") for name, fn in factor_fns.items()]
    if not parts:
        raise ValueError("factor_fns must not be empty")
    return reduce(lambda a, b: a.unionByName(b), parts)


_SEP = "\u0001"


def _under(factors: DataFrame, name: str) -> DataFrame:
    """Factors of an experiment, told apart from those of others by its name before theirs."""
    return factors.select("date", "asset", F.concat(F.lit(name + _SEP), F.col("factor")).alias("factor"), "value")


def _apart(table: DataFrame) -> DataFrame:
    """The experiment and its factor as two columns."""
    both = F.split("factor", _SEP, 2)
    return table.select(both[0].alias("experiment"), both[1].alias("factor"), *[c for c in table.columns if c != "factor"])


def _mean_coverage(factors: DataFrame, labels: DataFrame) -> DataFrame:
    """Per factor the mean over dates of the share of its assets that have a label; a date with labels alone has none."""
    y = labels.where(clean("value").isNotNull()).select("date", "asset").distinct().withColumn("y", F.lit(1))
    f = factors.where(clean("value").isNotNull()).select("date", "asset", "factor").distinct()
    per_date = f.join(y, ["date", "asset"], "left").groupBy("factor", "date").agg(F.avg(F.col("y").isNotNull().cast("double")).alias("share"))
    return per_date.groupBy("factor").agg(F.avg("share").alias("mean_coverage"))


def _screened(factors: DataFrame, labels: DataFrame, rank_ic: DataFrame, specs: Mapping[str, SingleFactorSpec], names: Sequence[str], n_quantiles: int, max_group: int | None) -> DataFrame:
    """Screening decisions of every experiment, each by its own gates and against its own factors only."""
    stats = materialize(sc.univariate_factor_stats(factors, labels, n_quantiles=n_quantiles, max_group=max_group, rank_ic=rank_ic))
    sizes = Counter(n.split(_SEP)[0] for n in names)
    own = F.split("factor", _SEP, 2)[0]
    parts = []
    alone = stats.withColumns({"max_abs_corr": F.lit(None).cast("double"), "vif": F.lit(1.0)})
    by_gates: dict[tuple, list[str]] = {}
    for e, spec in specs.items():
        if sizes[e] > 1:  # several factors under one name are screened against each other
            mine = factors.where(own == e)
            merged = stats.where(own == e).join(sc.pairwise_redundancy(mine)["max_abs_corr"], "factor", "left").join(sc.vif_diagnostics(mine), "factor", "left")
            parts.append(sc.decide(merged, **spec.gates()))
        else:
            by_gates.setdefault(tuple(spec.gates().items()), []).append(e)
    parts += [sc.decide(alone.where(own.isin(es)), **dict(gates)) for gates, es in by_gates.items()]
    return reduce(DataFrame.unionByName, parts)


def _run_group(
    prices: DataFrame, specs: Mapping[str, SingleFactorSpec], universe: Mapping[str, DataFrame], unified: DataFrame, exposures: DataFrame | None, max_group: int | None
) -> dict[str, DataFrame]:
    """Experiments that share everything but factor, gates and thresholds: one plan, keyed by experiment and factor."""
    spec = next(iter(specs.values()))
    raw = reduce(DataFrame.unionByName, [_under(s.factor_fn(prices), e) for e, s in specs.items()])
    prepared = materialize(prepare_signals(raw, universe, preprocess=spec.preprocess, neutralization=spec.neutralization, exposures=exposures, max_group=max_group))
    names = [r[0] for r in prepared.select("factor").distinct().collect()]  # a name for each factor of a spec
    labels = labels_to_canonical(unified)
    single = spec.validation_mode == "single_split"
    experiment = run_factor_experiment(
        prices, lambda _: prepared, horizon=spec.horizon, n_quantiles=spec.n_quantiles, train_end=spec.train_end if single else None,
        test_start=spec.test_start if single else None, max_group=max_group,
    )
    rank_ic = materialize(experiment["rank_ic"])
    summary = materialize(summarise_parts({**experiment, "rank_ic": rank_ic}, ("factor",)))
    same = spec.label_method == "forward_return" and not spec.label_kwargs  # the labels of the screening are those of the experiment
    decisions = materialize(_screened(experiment["factors"], labels, rank_ic if same else None, specs, names, spec.n_quantiles, max_group))
    out = {"prepared": prepared, "decisions": decisions, "experiment_summary": summary}
    least = None
    if spec.validation_mode == "purged_kfold":
        samples = interval_samples(unified, fallback_horizon=spec.horizon)
        out["validation"] = materialize(purged_validation_summary(samples, n_splits=spec.n_splits, embargo_periods=spec.embargo_periods))
        least = out["validation"].agg(F.min("n_train").alias("min_fold_train"), F.min("n_test").alias("min_fold_test"))
    elif spec.validation_mode == "walk_forward":
        folds = [
            run_walk_forward_experiment(
                prices, lambda _, n=name: prepared.where(F.split("factor", _SEP, 2)[0] == n), train_size=spec.train_size, test_size=spec.test_size, step=spec.step,
                val_size=spec.val_size, horizon=spec.horizon, n_quantiles=spec.n_quantiles, max_group=max_group,
            )["fold_summary"].select(F.lit(name).alias("experiment"), "*")
            for name in specs
        ]
        out["validation"] = reduce(DataFrame.unionByName, folds)
    ic = ev.compute_ic_summary(rank_ic, value_col="rank_ic", by=("factor",))
    trials = prices.sparkSession.createDataFrame([(e, float(s.trial_count)) for e, s in specs.items()], "experiment string, trials double")
    pvalues = _apart(sc.ic_pvalues(ic)).join(F.broadcast(trials), "experiment")  # a row for each spec
    pvalues = pvalues.select("experiment", "factor", F.least(F.col("p_value") * F.col("trials"), F.lit(1.0)).alias("adjusted_pvalue"))
    metrics = (
        summary.select("factor", "mean_rank_ic", "ic_ir").join(_mean_coverage(experiment["factors"], experiment["labels"]), "factor", "left")
        .join(decisions.select("factor", F.col("decision").alias("screening_decision")), "factor", "left")
    )
    metrics = _apart(metrics).join(pvalues, ["experiment", "factor"], "left")
    metrics = metrics.crossJoin(F.broadcast(universe["diagnostics"].agg(F.avg("tradable_ratio").alias("mean_tradable_ratio"))))  # one row
    none = F.lit(None).cast("long")
    metrics = metrics.crossJoin(F.broadcast(least)) if least is not None else metrics.withColumns({"min_fold_train": none, "min_fold_test": none})
    metrics = materialize(metrics)
    by_limits: dict[SingleFactorThresholds, list[str]] = {}
    for e, s in specs.items():
        by_limits.setdefault(s.thresholds, []).append(e)
    out["verdict"] = reduce(DataFrame.unionByName, [single_factor_verdict(metrics.where(F.col("experiment").isin(es)), t) for t, es in by_limits.items()])
    return out


def run_single_factor_workflows(
    prices: DataFrame, specs: Sequence[SingleFactorSpec], *, asset_metadata: DataFrame | None = None, market_state: DataFrame | None = None,
    exposures: DataFrame | None = None, max_group: int | None = None,
) -> dict[str, DataFrame]:
    """Many experiments, told apart by their names in a column ``experiment``: verdict, decisions, experiment_summary.

    Prices, universes (by rules) and labels (by method) are written once. Specs that differ in factor, trial count, gates
    and thresholds only are one table of factors, ranked, split and summarized in one plan.
    """
    names = [s.experiment_name for s in specs]
    if not names or len(set(names)) < len(names):
        raise ValueError("specs need names that differ")
    prices = materialize(prices)
    universes: dict[UniverseRules, dict[str, DataFrame]] = {}
    labels: dict[tuple, DataFrame] = {}
    groups: dict[tuple, dict[str, SingleFactorSpec]] = {}
    for s in specs:
        groups.setdefault(s.shared(), {})[s.experiment_name] = s
    parts = []
    for own in groups.values():
        s = next(iter(own.values()))
        if s.universe_rules not in universes:
            universes[s.universe_rules] = _written(construct_research_universe(prices, asset_metadata=asset_metadata, market_state=market_state, rules=s.universe_rules))
        kind = (s.label_method, s.horizon, repr(sorted(s.label_kwargs.items())))
        if kind not in labels:
            labels[kind] = materialize(build_labels(prices, s.label_method, horizon=s.horizon, label_kwargs=s.label_kwargs, max_group=max_group))
        parts.append(_run_group(prices, own, universes[s.universe_rules], labels[kind], exposures, max_group))
    tables = {k: [_apart(p[k]) if k != "verdict" else p[k] for p in parts] for k in ("verdict", "decisions", "experiment_summary", "prepared")}
    return {k: reduce(DataFrame.unionByName, v) for k, v in tables.items()}


def _written(universe: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The two masks and the diagnostics, which several steps read, written once."""
    return {k: v if k in ("exclusion_reasons", "masks") else materialize(v) for k, v in universe.items()}


def run_single_factor_workflow(
    prices: DataFrame, spec: SingleFactorSpec, *, asset_metadata: DataFrame | None = None, market_state: DataFrame | None = None,
    exposures: DataFrame | None = None, max_group: int | None = None,
) -> dict[str, DataFrame]:
    """Universe, prepared factor, labels, experiment, screening, validation and verdict of one spec.

    The prepared factor and the labels are written once; every later step reads those tables.
    """
    prices = materialize(prices)
    universe = _written(construct_research_universe(prices, asset_metadata=asset_metadata, market_state=market_state, rules=spec.universe_rules))
    unified = materialize(build_labels(prices, spec.label_method, horizon=spec.horizon, label_kwargs=spec.label_kwargs, max_group=max_group))
    found = _run_group(prices, {spec.experiment_name: spec}, universe, unified, exposures, max_group)
    out = {k: _apart(v).drop("experiment") if k in ("prepared", "decisions", "experiment_summary") else v.drop("experiment") for k, v in found.items()}
    return {**out, "labels": unified, **{f"universe_{k}": v for k, v in universe.items()}}


def run_composite_workflow(
    prices: DataFrame, spec: CompositeSpec, *, factor_fns: Mapping[str, FactorFn] | None = None, candidates: DataFrame | None = None,
    asset_metadata: DataFrame | None = None, market_state: DataFrame | None = None, exposures: DataFrame | None = None,
    exposure_data: DataFrame | None = None, max_group: int | None = None,
) -> dict[str, DataFrame]:
    """Candidates to prepared signals, screening, composite, experiment, pool, portfolio, frictions and verdict."""
    if (factor_fns is None) == (candidates is None):
        raise ValueError("provide exactly one of factor_fns or candidates")
    prices = prices if path_of(prices) else materialize(prices)
    masks = materialize(construct_research_universe(prices, asset_metadata=asset_metadata, market_state=market_state, rules=spec.universe_rules)["masks"])
    universe = {"universe": masks, "tradability": masks}
    raw = generate_candidate_signals(prices, factor_fns) if factor_fns is not None else candidates
    prepared = materialize(prepare_signals(
        raw, universe, preprocess=spec.preprocess, neutralization=spec.neutralization, exposures=exposures, max_group=max_group
    ))
    labels = materialize(labels_to_canonical(
        build_labels(prices, spec.label_method, horizon=spec.horizon, label_kwargs=spec.label_kwargs, max_group=max_group)
    ))
    # Pairs and rank ICs of all factors are those of the selected ones too.
    pairs = ev.aligned(prepared, labels)
    rank_ic = materialize(ev.rank_ic_of_pairs(pairs, ["date", "factor", "label"], max_group=max_group))
    screening = sc.screen_factors(prepared, labels, n_quantiles=spec.n_quantiles, max_group=max_group, rank_ic=rank_ic, pairs=pairs, **spec.screening)
    decisions = materialize(screening["decisions"])
    selected = materialize(sc.select_signals(prepared, decisions))
    composed = cp.compose_signals(
        selected, method=spec.composite_method, labels=labels if spec.composite_method != "equal" else None, lookback=spec.composite_lookback,
        min_history=spec.composite_min_history, output_factor=spec.composite_factor_name, max_group=max_group, history=rank_ic,
    )
    composite = materialize(composed["composite"])
    experiment = run_factor_experiment(prices, lambda _: composite, horizon=spec.horizon, n_quantiles=spec.n_quantiles, max_group=max_group)
    chosen = sc.select_signals(pairs, decisions)
    chosen = dealt(chosen, ["date", "factor"], written_rows(pairs)) if fits(max_group) else chosen
    pool = cp.alpha_pool_diagnostics(materialize(cp.alpha_returns_of_pairs(chosen, n_quantiles=spec.n_quantiles, max_group=max_group)))
    weights = materialize(pf.portfolio_weights_from_strategy(composite, spec.portfolio, max_group=max_group))
    plan = materialize(pf.trade_plan(weights, prices, portfolio_value=spec.portfolio_value, adv_window=spec.adv_window))
    usable = plan.where("adv_dollar is not null and daily_volatility is not null")
    capacity = fr.run_capacity_diagnostics(
        usable, portfolio_value=spec.portfolio_value, max_adv_participation=spec.max_adv_participation,
        concentration_weight_threshold=spec.concentration_weight_threshold, max_group=max_group,
    )
    cost = fr.layered_research_costs(usable, max_group=max_group, **spec.costs)
    audit = fr.run_exposure_audit(weights, exposure_data) if exposure_data is not None else None
    none = F.lit(None).cast("double")
    some = usable.agg(F.count(F.lit(1)) > 0).scalar()
    breadth = pool["breadth_summary"].select(F.struct("effective_breadth", "avg_abs_corr")).scalar()
    exposure = audit["summary"].select(F.struct("max_abs_industry_exposure", "max_abs_style_exposure")).scalar() if audit else None
    metrics = experiment["summary"].select("factor", "mean_rank_ic", "ic_ir").withColumns(
        {
            "n_selected_factors": decisions.agg(F.count_if(F.col("decision") == "candidate_factor")).scalar(),
            "effective_breadth": breadth["effective_breadth"],
            "avg_abs_corr": breadth["avg_abs_corr"],
            "adv_flag_ratio": capacity["warnings"].select("adv_limit_flag_ratio").scalar(),
            "mean_cost_bps": cost["summary"].select("mean_cost_bps").scalar(),
            "max_abs_industry_exposure": exposure["max_abs_industry_exposure"] if audit else none,
            "max_abs_style_exposure": exposure["max_abs_style_exposure"] if audit else none,
            "has_capacity": some,
            "has_cost": some,
            "has_exposure": F.lit(audit is not None),
        }
    )
    out = {
        "prepared": prepared, "decisions": decisions, "selected": selected, "composite": composite, "weights": weights, "trade_plan": plan,
        "experiment_summary": experiment["summary"], "breadth_summary": pool["breadth_summary"], "clusters": pool["clusters"],
        "capacity_warnings": capacity["warnings"], "cost_summary": cost["summary"], "verdict": composite_verdict(metrics, spec.thresholds),
    }
    if audit:
        out["exposure_summary"] = audit["summary"]
    return out


# Registry stage of each verdict.
STAGE_OF_VERDICT = {
    "candidate_for_external_backtest": "approved_for_external_backtest",
    "candidate_for_registry": "candidate",
    "needs_review": "discovery",
    "reject": "discovery",
}
