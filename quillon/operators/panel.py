"""Labels, rewards and cross-sectional statistics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.ordered import average_ranks
from quillon.functions.stats import EPS, average_rank, clip, corr, is_finite
from quillon.plans.lower import factors
from quillon.sources.bars import finite_rows

FAIL = -1.0
#: Bars of warm-up by the largest bar size in minutes they hold for, beyond these, and from a day on.
_WARMUP, _LONG_WARMUP, _DAY_WARMUP = ((5, 240), (60, 96), (240, 64)), 32, 240
#: Days of warm-up of a panel, its bars by bar size in minutes and for all other sizes; days loaded beyond any warm-up.
PANEL_DAYS, PANEL_BARS, PANEL_OTHER, BUFFER_DAYS = 10, {5: 240}, 96, 2


def forward_return(horizon: int, close: str = "close", keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> Column:
    """close[t + h] / close[t] - 1 over the rows at hand; NULL at the end and for a zero close."""
    return F.try_divide(F.lead(close, horizon).over(Window.partitionBy(*keys).orderBy(order)), F.col(close)) - 1


def valid_scores(df: DataFrame, factor: str = "factor", close: str = "close") -> DataFrame:
    """Rows with a finite factor and a finite, positive close."""
    return df.where(is_finite(factor) & is_finite(close) & (F.col(close) > 0))


def skip_warmup(df: DataFrame, bars: int, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """Rows from the bars-th of each symbol on."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") >= bars).drop("_n")


def warmup_bars(minutes: int | Column) -> int | Column:
    """Bars before a factor of single-asset jobs counts, by bar size."""
    if isinstance(minutes, int):
        return _DAY_WARMUP if minutes >= 1440 else next((n for top, n in _WARMUP if minutes <= top), _LONG_WARMUP)
    out = F.when(minutes >= 1440, _DAY_WARMUP)
    for top, n in _WARMUP:
        out = out.when(minutes <= top, n)
    return out.otherwise(_LONG_WARMUP)


def warmup_days(minutes: int | Column, bars: int | Column) -> int | Column:
    """Days that hold so many bars, with a reserve."""
    if isinstance(minutes, int) and isinstance(bars, int):
        return max(180, 2 * bars + 30) if minutes >= 1440 else max(10, -(-minutes * bars // 1440) + 5)
    minutes, bars = (F.lit(x) if isinstance(x, int) else x for x in (minutes, bars))
    return F.when(minutes >= 1440, F.greatest(F.lit(180), 2 * bars + 30)).otherwise(F.greatest(F.lit(10), F.ceil(minutes * bars / 1440).cast("int") + 5))


def backtest_warmup(minutes: int | Column, days: int | Column) -> int | Column:
    """Bars of a symbol that a backtest counts before its first row: a day ladder, none for bars of about a day."""
    if isinstance(minutes, int) and isinstance(days, int):
        return 1 if minutes >= 1440 else days * (1440 // minutes)
    minutes, days = (F.lit(x) if isinstance(x, int) else x for x in (minutes, days))
    return F.when(minutes >= 1440, 1).otherwise(days * F.floor(F.lit(1440) / minutes).cast("int"))


def after_start(df: DataFrame, start: str, order: str = "ts") -> DataFrame:
    """Evaluation rows; apply it after windows are computed."""
    return df.where(F.col(order) >= F.lit(start).cast("timestamp_ntz"))


def series_labels(df: DataFrame, horizon: int, **options) -> DataFrame:
    """Single-asset labels: invalid rows go first, then returns run over what is left."""
    return valid_scores(df).withColumn("fwd", forward_return(horizon, **options))


def panel_labels(bars: DataFrame, horizon: int) -> DataFrame:
    """Panel labels: returns run over all bars."""
    return bars.withColumn("fwd", forward_return(horizon))


def aligned(df: DataFrame, factor: str = "factor", fwd: str = "fwd") -> DataFrame:
    return df.where(is_finite(factor) & is_finite(fwd))


def align(factor: DataFrame, returns: DataFrame, on: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Finite pairs of two separate tables."""
    return aligned(factor.join(returns, list(on)))


# -- rewards: each is a set of aggregates over the rows where factor and return are finite, and what follows from them


@dataclass(frozen=True)
class Reward:
    """columns, then prepare: added before the aggregation; sums: aggregates by name; then value, passed, reason and metrics of these."""

    columns: dict[str, Column]
    sums: dict[str, Column]
    value: Column
    reason: Column
    metrics: dict[str, Column]
    prepare: Callable[[DataFrame], DataFrame] | None = None


def _direction(tag: str, fwd: str, keys: tuple[str, ...], min_samples: int = 50) -> Reward:
    """(acc - 0.5) * 200 over rows with a signal; a zero return counts as wrong."""
    c, ok = (lambda n: F.col(tag + n)), is_finite("factor") & is_finite(fwd)
    signal = ok & (F.signum("factor") != 0)
    right = F.when(signal, (F.signum("factor") == F.signum(fwd)).cast("double"))
    sums = {"n": F.count(F.when(ok, 1)), "k": F.count(F.when(signal, 1)), "acc": F.avg(right)}
    few, none = c("n") < min_samples, c("k") == 0
    metrics = {
        "samples": F.when(few, c("n")).when(~none, c("k")), "coverage": F.when(~few & none, 0.0).when(~few, c("k") / c("n")), "direction_acc": F.when(~few & ~none, c("acc")),
    }
    return Reward({}, sums, F.when(few | none, -100.0).otherwise((c("acc") - 0.5) * 200), F.when(few, "too_few_samples").when(none, "zero_signal"), metrics)


def _correlation(name: str, ranked: bool):
    def make(tag: str, fwd: str, keys: tuple[str, ...], min_samples: int = 50) -> Reward:
        c, ok = (lambda n: F.col(tag + n)), is_finite("factor") & is_finite(fwd)
        pair, columns, prepare = (F.when(ok, F.col("factor")), F.when(ok, F.col(fwd))), {}, None
        if ranked:
            columns, pair = {f"{tag}ok": ok}, (F.when(ok, c("f")), F.when(ok, c("r")))
            if keys:
                columns |= {f"{tag}f": average_rank("factor", *keys, f"{tag}ok"), f"{tag}r": average_rank(fwd, *keys, f"{tag}ok")}
            else:  # all rows are ranked together, by ranges
                prepare = lambda rows: average_ranks(rows, {f"{tag}f": "factor", f"{tag}r": fwd}, c("ok"))
        few, none = c("n") < min_samples, c("v").isNull()
        sums = {"n": F.count(F.when(ok, 1)), "v": corr(*pair)}
        metrics = {"samples": c("n").cast("double"), name: F.when(~few, c("v"))}
        return Reward(columns, sums, F.when(few | none, FAIL).otherwise(c("v")), F.when(few, "too_few_samples").when(none, "undefined"), metrics, prepare)

    return make


def _signal_return(tag: str, fwd: str, keys: tuple[str, ...], min_samples: int = 50, periods: float = 365 * 24 * 12) -> Reward:
    """Annualised mean over deviation of sign(factor) * fwd."""
    c, ok = (lambda n: F.col(tag + n)), is_finite("factor") & is_finite(fwd)
    pnl = F.when(ok, F.signum("factor") * F.col(fwd))
    few, std = c("n") < min_samples, c("std") + 1e-12
    ratio = c("mean") / std * float(periods) ** 0.5
    metrics = {"samples": F.when(few, c("n")), **{k: F.when(~few, v) for k, v in {"mean_pnl": c("mean"), "pnl_std": std, "sharpe_like": ratio}.items()}}
    return Reward({}, {"n": F.count(pnl), "mean": F.avg(pnl), "std": F.stddev_pop(pnl)}, F.when(few, FAIL).otherwise(ratio), F.when(few, "too_few_samples"), metrics)


REWARDS: dict[str, Callable[..., Reward]] = {"direction_accuracy": _direction, "ic": _correlation("ic", False), "rank_ic": _correlation("rank_ic", True), "signal_return": _signal_return}


def register(name: str, make: Callable[..., Reward]) -> None:
    """Adds a reward: a function of (tag, fwd, keys, min_samples, ...) to a Reward whose sums carry the tag."""
    if name in REWARDS:
        raise ValueError(f"there is a reward {name!r} already")
    REWARDS[name] = make


def reward(name: str) -> Callable[..., DataFrame]:
    """A reward by name, as a function of (rows, keys, options) to (keys, reward, value, passed, reason, metrics)."""
    if name not in REWARDS:
        raise KeyError(f"unknown reward {name!r}; known: {sorted(REWARDS)}")

    def run(df: DataFrame, keys: tuple[str, ...] = (), **options) -> DataFrame:
        out = composite(df, {name: {"weight": 1.0, **options}}, keys)
        reason = F.regexp_replace("reason", f"^{name}:", "")
        metrics = F.transform_keys(F.map_filter("metrics", lambda k, _: k != f"{name}/value"), lambda k, _: F.substring_index(k, "/", -1))
        return out.select(*keys, F.lit(name).alias("reward"), "value", "passed", reason.alias("reason"), metrics.alias("metrics"))

    return run


def direction_accuracy(df: DataFrame, keys: tuple[str, ...] = (), **options) -> DataFrame:
    return reward("direction_accuracy")(df, keys, **options)


def ic(df: DataFrame, keys: tuple[str, ...] = (), **options) -> DataFrame:
    return reward("ic")(df, keys, **options)


def rank_ic(df: DataFrame, keys: tuple[str, ...] = (), **options) -> DataFrame:
    return reward("rank_ic")(df, keys, **options)


def signal_return(df: DataFrame, keys: tuple[str, ...] = (), **options) -> DataFrame:
    return reward("signal_return")(df, keys, **options)


def single_asset_reward(kind: str, horizon: int = 1) -> tuple[str, int, int]:
    """(reward name, least samples, horizon of at least 1) of a reward kind; unknown kinds mean direction."""
    name = {"direction": "direction_accuracy"}.get(kind, kind)
    name = name if name in REWARDS else "direction_accuracy"
    return name, 30 if name in ("ic", "rank_ic") else 50, max(1, horizon)


def composite(df: DataFrame, components: dict[str, float | dict], keys: tuple[str, ...] = (), primary: str = "direction_accuracy") -> DataFrame:
    """(keys, value, passed, reason, metrics): a weighted sum of rewards, in one aggregation.

    components: a weight for each reward, or its options: weight (1 for the primary, else 0), horizon (then its returns are
    computed from close over the rows at hand, else ``fwd`` is taken), min_samples and so on.  Passed if all pass; reasons
    and metrics carry the reward's name, in the order of the components.  Without keys a table without rows gives one row.
    """
    parts: list[tuple[str, float, str, Reward]] = []
    rows = df
    for i, (name, given) in enumerate((components or {primary: {"weight": 1.0}}).items()):
        if name not in REWARDS:
            raise KeyError(f"unknown reward {name!r}; known: {sorted(REWARDS)}")
        options = dict(given) if isinstance(given, dict) else {"weight": given}
        weight, horizon, tag, fwd = float(options.pop("weight", 1.0 if name == primary else 0.0)), options.pop("horizon", None), f"_{i}_", "fwd"
        if horizon is not None:
            fwd = f"_fwd{horizon}"
            rows = rows if fwd in rows.columns else rows.withColumn(fwd, forward_return(int(horizon)))
        part = REWARDS[name](tag, fwd, keys, **options)
        for k, v in part.columns.items():
            rows = rows.withColumn(k, v)
        rows = part.prepare(rows) if part.prepare else rows
        parts.append((name, weight, tag, part))
    out = rows.groupBy(*keys).agg(*[v.alias(tag + k) for _, _, tag, p in parts for k, v in p.sums.items()])
    total, passed = F.lit(0.0), F.lit(True)
    reasons, metrics = [], []
    for name, weight, _, p in parts:
        total, passed = total + F.lit(weight) * p.value, passed & p.reason.isNull()
        reasons.append(F.when(p.reason.isNotNull(), F.concat(F.lit(f"{name}:"), p.reason)))
        metrics += [F.struct(F.lit(f"{name}/{k}").alias("key"), v.cast("double").alias("value")) for k, v in {**p.metrics, "value": p.value}.items()]
    kept = F.map_from_entries(F.filter(F.array(*metrics), lambda x: x["value"].isNotNull()))
    return out.select(*keys, total.alias("value"), passed.alias("passed"), F.concat_ws(";", *reasons).alias("reason"), kept.alias("metrics"))


def raw_reward(kind: str, value: Column, passed: Column) -> Column:
    value = value / 100 + 0.1 if kind.startswith("direction") else value
    return F.when(~passed | value.isNull(), FAIL).otherwise(value)


def direction_signs(rows: DataFrame, *keep: str) -> DataFrame:
    """(…, symbol, ts, pred, label, mask, correct) of aligned rows."""
    pred, label = F.signum("factor").cast("tinyint"), F.signum("fwd").cast("tinyint")
    return rows.select(*keep, "symbol", "ts", pred.alias("pred"), label.alias("label"), (pred != 0).alias("mask"), ((pred != 0) & (pred == label)).alias("correct"))


def direction_profile(df: DataFrame, horizon: int = 1) -> DataFrame:
    """(symbol, ts, pred, label, mask, correct) of every labelled row; the horizon is 1 unless asked."""
    return direction_signs(aligned(df.withColumn("fwd", forward_return(horizon))))


# -- cross-section


def cross_section(df: DataFrame, keys: tuple[str, ...] = ("ts",), min_symbols: int = 8, tie: str = "symbol", share: float = 0.2) -> DataFrame:
    """Per timestamp: rank_ic, ls_return, n_symbols, of rows with finite factor and return."""
    rows = aligned(df)
    n = F.count("*").over(Window.partitionBy(*keys))
    q = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    rows = rows.withColumn("n", n).where(F.col("n") >= min_symbols)
    low = F.row_number().over(Window.partitionBy(*keys).orderBy("factor", tie))
    rows = rows.withColumns({"rf": average_rank("factor", *keys), "rr": average_rank("fwd", *keys), "low": low})
    return rows.groupBy(*keys).agg(
        corr("rf", "rr").alias("rank_ic"),
        (F.avg(F.when(F.col("low") > F.col("n") - q, F.col("fwd"))) - F.avg(F.when(F.col("low") <= q, F.col("fwd")))).alias("ls_return"),
        F.max("n").alias("n_symbols"),
    )


def percentile_ranks(df: DataFrame, keys: tuple[str, ...] = ("ts",), min_symbols: int = 8) -> DataFrame:
    """symbol and average rank / n per timestamp whose RankIC is defined."""
    per = Window.partitionBy(*keys)
    rows = aligned(df).withColumn("n", F.count("*").over(per)).where(F.col("n") >= min_symbols)
    rows = rows.withColumns({"rf": average_rank("factor", *keys), "rr": average_rank("fwd", *keys)})
    rows = rows.withColumn("r", corr("rf", "rr", per)).where("r is not null")
    return rows.select(*keys, "symbol", (F.col("rf") / F.col("n")).alias("rank_pct"))


def summarise(cross: DataFrame, total_symbols: int | Column, keys: tuple[str, ...] = (), min_times: int = 20, min_symbols: int = 0) -> DataFrame:
    """One row: mean and deviation of RankIC, ICIR, long-short statistics, coverage and the score.

    Timestamps whose RankIC is undefined take no part.  The score is -1 with fewer than min_times of the others, or fewer
    than min_symbols symbols in all.
    """
    t = F.count("rank_ic")
    mean, std = F.avg("rank_ic"), F.stddev_pop("rank_ic")
    total = F.lit(total_symbols) if isinstance(total_symbols, int) else total_symbols
    out = cross.where("rank_ic is not null").groupBy(*keys).agg(
        t.alias("times"), mean.alias("mean_rank_ic"), std.alias("std_rank_ic"), (mean / (std + EPS) * F.sqrt(t)).alias("icir"),
        F.avg("ls_return").alias("mean_ls"), (F.avg("ls_return") / (F.stddev_pop("ls_return") + EPS) * F.sqrt(F.count("ls_return"))).alias("ls_sharpe"),
        F.avg("n_symbols").alias("mean_symbols"), F.avg(F.col("n_symbols") / total).alias("coverage"), F.max(total).alias("_total"),
    )
    score = clip(5 * F.col("mean_rank_ic") + 0.02 * F.tanh("icir"), -1, 1)
    few = (F.col("times") < min_times) | (F.coalesce("_total", F.lit(0)) < min_symbols)
    return out.withColumns({"predictive": 100 * F.col("mean_rank_ic"), "score": F.when(few | score.isNull(), FAIL).otherwise(score)}).drop("_total")


def evaluate_panel(bars: DataFrame, expr: str, horizon: int = 6, warmup: int = 1, start: str | None = None) -> DataFrame:
    """(symbol, ts, factor, fwd): returns over all bars, factors over finite ones, in one shuffle and sort."""
    rows = skip_warmup(factors(finite_rows(panel_labels(bars, horizon)), {"factor": expr}), warmup).select("symbol", "ts", "factor", "fwd")
    return after_start(rows, start) if start else rows


def panel_score(rows: DataFrame, min_symbols: int = 8, min_times: int = 20) -> DataFrame:
    """The summary of panel rows; symbols without a row count neither for the gate on symbols nor for the coverage."""
    symbols = rows.agg(F.count_distinct("symbol").alias("symbols"))
    cross = cross_section(rows, min_symbols=min_symbols).join(F.broadcast(symbols))  # one row
    return summarise(cross, F.col("symbols"), (), min_times, min_symbols)


def quality_gate(df: DataFrame, kind: Column, m: Callable[[str], Column]) -> DataFrame:
    """Factors worth keeping, by reward kind; other kinds have no gate."""
    fair = (
        F.when(kind.startswith("direction"), (m("predictive") >= 2.0) & (m("direction_acc") >= 0.51) & (m("coverage") >= 0.6))
        .when(kind.isin("ic", "rank_ic"), (m("value") >= 0.01) & (m("samples") >= 50))
        .when(kind.startswith("cross_sectional"), (m("mean_rank_ic") >= 0.01) & (m("coverage") >= 0.6))
        .otherwise(True)
    )
    return df.where(F.coalesce(fair, F.lit(False)))


def user_factor(bars: DataFrame, fn: Callable, schema: str = "symbol string, ts timestamp_ntz, factor double") -> DataFrame:
    """Factors from a trusted callable: a symbol's bars in time order, as a pandas frame, to rows of schema.

    For what the factor language cannot say.  A symbol's bars are one group in one task, so its history must fit there.  Text is never executed.
    """
    return bars.groupBy("symbol").applyInPandas(lambda rows: fn(rows.sort_values("ts", kind="stable").reset_index(drop=True)), schema)
