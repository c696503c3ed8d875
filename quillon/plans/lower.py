"""Lowering of factor expressions to Spark columns.

An ARRAY is a *frame*: a per-row column, a window length w and the count d of leading rows of a symbol where the
column is undefined (NULL).  Reducers of frames are native window aggregates over ROWS BETWEEN w-1 PRECEDING.
What cannot be kept as a frame (normalize, ema_arr, rank, infix with a row-varying scalar) is an
array column from collect_list over the frame, reduced by higher-order functions.  All windows share one
partitioning and order, so any number of expressions costs one shuffle and one sort.

Equal sub-expressions are computed once; columns are added in levels, so no window is nested in another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.stats import EPS, finite, guarded
from quillon.plans.expr import ARRAY, FIELDS, Node, parse


REDUCERS = ("ts_mean", "ts_std", "ts_max", "ts_min", "ts_sum", "ts_skew", "ts_kurt", "first", "last")


@dataclass(frozen=True)
class Frame:
    col: str
    w: int
    d: int
    level: int


@dataclass(frozen=True)
class Arr:
    col: str
    level: int


@dataclass(frozen=True)
class Num:
    col: str
    level: int


class Lowering:
    """Collects named columns by level; ``apply`` adds them to a bar table."""

    def __init__(self, force_arrays: bool = False, keys: tuple[str, ...] = ("symbol",), order: str = "ts"):
        self.levels: list[dict[str, Column]] = []
        self.seen: dict[str, Frame | Arr | Num] = {}
        self.made: dict[str, str] = {}
        self.by = Window.partitionBy(*keys).orderBy(order)
        self.force_arrays = force_arrays

    def window(self, w: int):
        return self.by.rowsBetween(-(w - 1), 0)

    def put(self, key: str, level: int, col: Column) -> str:
        name = self.made.get(key)
        if name is None:
            name = self.made[key] = f"_x{len(self.made)}"
            while len(self.levels) < level:
                self.levels.append({})
            self.levels[level - 1][name] = col
        return name

    def apply(self, bars: DataFrame) -> DataFrame:
        for cols in self.levels:
            if cols:
                bars = bars.withColumns(cols)
        return bars

    # -- nodes

    def node(self, n: Node) -> Frame | Arr | Num:
        key = n.key()
        if key not in self.seen:
            self.seen[key] = self._node(n, key)
        return self.seen[key]

    def _num(self, key: str, level: int, col: Column) -> Num:
        return Num(self.put(key, level, col), level)

    def _node(self, n: Node, key: str):
        op = n.op
        if op == "const":
            return self._num(key, 1, F.lit(float(n.value)))
        if op in FIELDS:
            return self._frame(op, n.args[0].value, 0, 0)
        if op == "returns":
            before = F.lag("close").over(self.by)
            return self._frame(self.put("(returns)", 1, F.try_divide(F.col("close") - before, before + EPS)), n.args[0].value, 1, 1)
        if op == "vwap":
            over = self.window(n.args[0].value)
            return self._num(key, 1, F.try_divide(F.sum(F.col("close") * F.col("volume")).over(over), F.sum("volume").over(over) + EPS))
        args = [self.node(a) for a in n.args if not (a.op == "const" and op in ("ema_arr", "slice_arr"))]
        if op == "neg" and not isinstance(args[0], Num):
            args = [self._last(args[0])]
        if op in REDUCERS:
            return self._reduce(op, key, args[0])
        if op.startswith("infix_"):
            return self._infix(op[6:], key, *args)
        if hasattr(self, f"_{op}"):
            return getattr(self, f"_{op}")(key, n, *args)
        if op.endswith("_arr"):
            return self._aligned(op[:-4], key, *args)
        return self._scalar(op, key, args)

    def _frame(self, col: str, w: int, d: int, level: int) -> Frame | Arr:
        out = Frame(col, w, d, level)
        return self._arr(out) if self.force_arrays else out

    def _arr(self, x: Frame | Arr) -> Arr:
        if isinstance(x, Arr):
            return x
        level = x.level + 1
        return Arr(self.put(f"[{x.col} {x.w}]", level, F.collect_list(x.col).over(self.window(x.w))), level)

    @staticmethod
    def _apply(op: str, a: Column, b: Column) -> Column:
        return {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: F.try_divide(a, F.abs(b) + EPS)}[op]()

    def _scalar(self, op: str, key: str, args: list[Num]) -> Num:
        level = max(a.level for a in args) + 1
        a = F.col(args[0].col)
        if len(args) == 2:
            return self._num(key, level, self._apply(op, a, F.col(args[1].col)))
        one = {"neg": lambda: -a, "abs_s": lambda: F.abs(a), "log_s": lambda: F.log(F.abs(a) + EPS), "tanh_s": lambda: F.tanh(a), "sign_s": lambda: F.signum(a)}
        return self._num(key, level, one[op]())

    def _infix(self, op: str, key: str, a, b):
        if isinstance(a, Num) and isinstance(b, Num):
            return self._scalar(op, key, [a, b])
        level = max(a.level, b.level) + 1
        if isinstance(a, Frame) and isinstance(b, Frame) and (a.w, a.d) == (b.w, b.d):
            return Frame(self.put(key, level, self._apply(op, F.col(a.col), F.col(b.col))), a.w, a.d, level)
        if isinstance(a, Num) or isinstance(b, Num):
            arr, num = (b, a) if isinstance(a, Num) else (a, b)
            x = self._arr(arr)
            s = F.col(num.col)
            f = (lambda v: self._apply(op, s, v)) if isinstance(a, Num) else (lambda v: self._apply(op, v, s))
            level = max(x.level, num.level) + 1
            return Arr(self.put(key, level, F.transform(x.col, f)), level)
        x, y = self._arr(a), self._arr(b)
        level = max(x.level, y.level) + 1
        p, q = F.col(x.col), F.col(y.col)
        # no alignment: lengths must agree, or one be 1; else the value is undefined
        n, m = F.size(p), F.size(q)
        same = F.zip_with(p, q, lambda u, v: self._apply(op, u, v))
        left = F.transform(p, lambda u: self._apply(op, u, F.get(q, F.lit(0))))
        right = F.transform(q, lambda v: self._apply(op, F.get(p, F.lit(0)), v))
        return Arr(self.put(key, level, F.when(n == m, same).when(m == 1, left).when(n == 1, right)), level)

    def _aligned(self, op: str, key: str, a, b):
        if isinstance(a, Frame) and isinstance(b, Frame):
            level = max(a.level, b.level) + 1
            return Frame(self.put(key, level, self._apply(op, F.col(a.col), F.col(b.col))), min(a.w, b.w), max(a.d, b.d), level)
        x, y = self._tails(a, b)
        level = max(x.level, y.level) + 1
        return Arr(self.put(key, level, F.zip_with(x.col, y.col, lambda u, v: self._apply(op, u, v))), level)

    def _tails(self, a, b) -> tuple[Arr, Arr]:
        """Both arrays' last min(length) elements."""
        x, y = self._arr(a), self._arr(b)
        level = max(x.level, y.level) + 1
        n = F.least(F.size(x.col), F.size(y.col))
        cut = lambda v: F.slice(F.col(v.col), F.size(v.col) - n + 1, n)
        return Arr(self.put(f"<{x.col} {y.col}", level, cut(x)), level), Arr(self.put(f">{x.col} {y.col}", level, cut(y)), level)

    def _diff(self, key, n, x):
        if isinstance(x, Frame):
            level = x.level + 1
            # one element less; a window of one has none
            col = F.col(x.col) - F.lag(x.col).over(self.by) if x.w > 1 else F.lit(None).cast("double")
            return Frame(self.put(f"(diff {x.col} {x.w > 1})", level, col), max(1, x.w - 1), x.d + 1, level)
        level = x.level + 1
        a = F.col(x.col)
        tail = F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
        return Arr(self.put(key, level, F.zip_with(tail, F.slice(a, 1, F.size(tail)), lambda u, v: u - v)), level)

    def _log_arr(self, key, n, x):
        level = x.level + 1
        f = lambda v: F.log(F.abs(v) + EPS)
        if isinstance(x, Frame):
            return Frame(self.put(f"(log {x.col})", level, f(F.col(x.col))), x.w, x.d, level)
        return Arr(self.put(key, level, F.transform(x.col, f)), level)

    def _slice_arr(self, key, n, x):
        k = n.args[1].value
        if isinstance(x, Frame):
            return Frame(x.col, min(x.w, k), x.d, x.level)
        level = x.level + 1
        return Arr(self.put(key, level, F.slice(F.col(x.col), F.greatest(F.size(x.col) - k + 1, F.lit(1)), k)), level)

    def _moments(self, x: Arr) -> dict[str, Num]:
        """count, mean and population deviation of an array, each a column."""
        a, level = F.col(x.col), x.level + 1
        n = self._num(f"#n {x.col}", level, F.size(a).cast("double"))
        total = self._num(f"#sum {x.col}", level, F.aggregate(a, F.lit(0.0), lambda s, v: s + v))
        mean = self._num(f"#mean {x.col}", level + 1, F.try_divide(F.col(total.col), F.col(n.col)))
        out = {"n": n, "sum": total, "mean": mean}

        def central(p: float) -> Column:
            return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + F.pow(v - F.col(mean.col), F.lit(p))), F.col(n.col))

        for p in (2, 3, 4):
            out[f"m{p}"] = self._num(f"#m{p} {x.col}", level + 2, central(float(p)))
        return out

    def _normalize(self, key, n, x):
        x = self._arr(x)
        m = self._moments(x)
        level = m["m2"].level + 1
        return Arr(self.put(key, level, F.transform(x.col, lambda v: F.try_divide(v - F.col(m["mean"].col), F.sqrt(F.col(m["m2"].col)) + EPS))), level)

    def _ema_arr(self, key, n, x):
        x = self._arr(x)
        keep = 1 - 2 / (n.args[1].value + 1)
        a, level = F.col(x.col), x.level + 1
        weights = F.transform(a, lambda v, k: F.pow(F.lit(keep), (F.size(a) - 1 - k).cast("double")))
        weights = self.put(f"#w {x.col} {keep}", level, weights)
        dot = F.aggregate(F.zip_with(a, F.col(weights), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
        return self._num(key, level + 1, F.when(F.size(a) > 0, F.try_divide(dot, F.aggregate(weights, F.lit(0.0), lambda s, v: s + v) + EPS)))

    def _last(self, x) -> Num:
        if isinstance(x, Num):
            return x
        if isinstance(x, Frame):
            return self._num(f"(last {x.col})", x.level + 1, F.col(x.col))
        return self._num(f"(last {x.col})", x.level + 1, F.try_element_at(F.col(x.col), F.lit(-1)))

    def _reduce(self, op: str, key: str, x) -> Num:
        """An empty window gives 0; a moment that is not defined gives NULL."""
        level = x.level + 1
        if isinstance(x, Frame):
            v, over = F.col(x.col), self.window(x.w)
            agg = {
                "ts_mean": lambda: F.avg(v).over(over), "ts_std": lambda: F.stddev_pop(v).over(over) + EPS, "ts_max": lambda: F.max(v).over(over),
                "ts_min": lambda: F.min(v).over(over), "ts_sum": lambda: F.sum(v).over(over), "ts_skew": lambda: F.skewness(v).over(over),
                "ts_kurt": lambda: F.kurtosis(v).over(over), "last": lambda: v, "first": lambda: F.first(v, ignorenulls=True).over(over),
            }[op]()
            # window aggregates have columns of their own: what is written twice is computed twice
            n, raw = self.put(f"#count {x.col} {x.w}", level, F.count(v).over(over)), self.put(f"~{key}", level, agg)
            return self._num(key, level + 1, F.when(F.col(n) == 0, F.lit(0.0)).otherwise(finite(raw)))
        a, m = F.col(x.col), {k: F.col(v.col) for k, v in self._moments(x).items()}
        # a spread within the rounding error of the mean is none
        spread = m["m2"] > F.pow(1e-14 * m["mean"], F.lit(2.0)) + 1e-150
        agg = {
            "ts_mean": lambda: m["mean"], "ts_std": lambda: F.sqrt(m["m2"]) + EPS, "ts_max": lambda: F.array_max(a), "ts_min": lambda: F.array_min(a), "ts_sum": lambda: m["sum"],
            "ts_skew": lambda: F.when(spread, F.try_divide(m["m3"], F.pow(m["m2"], F.lit(1.5)))), "ts_kurt": lambda: F.when(spread, F.try_divide(m["m4"], m["m2"] * m["m2"]) - 3),
            "last": lambda: F.try_element_at(a, F.lit(-1)), "first": lambda: F.get(a, F.lit(0)),
        }[op]()
        return self._num(key, level + 3, F.when(F.size(a) == 0, F.lit(0.0)).otherwise(finite(agg)))

    def _pair(self, op: str, key: str, a, b) -> Num:
        if isinstance(a, Frame) and isinstance(b, Frame):
            over, level = self.window(min(a.w, b.w)), max(a.level, b.level) + 1
            both = F.col(a.col).isNotNull() & F.col(b.col).isNotNull()
            u, v = F.when(both, F.col(a.col)), F.when(both, F.col(b.col))
            tag = f"{a.col} {b.col} {min(a.w, b.w)}"
            part = lambda name, agg: F.col(self.put(f"#{name} {tag}", level, agg.over(over)))
            if op == "corr":
                col = guarded(part("cov", F.covar_pop(u, v)), part("left", F.stddev_pop(u)), part("right", F.stddev_pop(v)))
            else:
                col = F.when(part("both", F.count(F.when(both, 1))) > 1, part("samp", F.covar_samp(u, v)))
            return self._num(key, level + 2, F.coalesce(finite(self.put(f"~{key}", level + 1, col)), F.lit(0.0)))
        x, y = self._tails(a, b)
        m, k = self._moments(x), self._moments(y)
        level = m["m2"].level + 1
        n, mx, my = F.col(m["n"].col), F.col(m["mean"].col), F.col(k["mean"].col)
        total = F.aggregate(F.zip_with(x.col, y.col, lambda u, v: (u - mx) * (v - my)), F.lit(0.0), lambda s, v: s + v)
        if op == "cov":
            col = F.when(n > 1, F.try_divide(total, n - 1))
        else:
            sx, sy = F.sqrt(F.col(m["m2"].col)), F.sqrt(F.col(k["m2"].col))
            col = F.when((n > 1) & (sx > 1e-12) & (sy > 1e-12), F.try_divide(total / n, sx * sy))
        return self._num(key, level, F.coalesce(finite(col), F.lit(0.0)))

    def _corr(self, key, n, a, b):
        return self._pair("corr", key, a, b)

    def _cov(self, key, n, a, b):
        return self._pair("cov", key, a, b)

    def _zscore(self, key, n, s, x):
        if isinstance(x, Frame):
            over, level = self.window(x.w), max(s.level, x.level) + 1
            return self._num(key, level, F.try_divide(F.col(s.col) - F.avg(x.col).over(over), F.stddev_pop(x.col).over(over) + EPS))
        m = self._moments(x)
        level = max(s.level, m["m2"].level) + 1
        return self._num(key, level, F.try_divide(F.col(s.col) - F.col(m["mean"].col), F.sqrt(F.col(m["m2"].col)) + EPS))

    def _rank(self, key, n, s, x):
        x = self._arr(x)
        level = max(s.level, x.level) + 1
        return self._num(key, level, F.size(F.filter(x.col, lambda v: v <= F.col(s.col))) / (F.size(x.col) + 1))




def factors(bars: DataFrame, exprs: dict[str, str], nonfinite: str = "zero", force_arrays: bool = False, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars with a column for each named expression; all share one shuffle and one sort.

    nonfinite: ``zero`` turns undefined values into 0.0, ``drop`` leaves them NULL.  A symbol (or what keys name) is one
    group of a task; ``halo.factors_in_blocks`` cuts longer histories.
    """
    low = Lowering(force_arrays, keys)
    out: dict[str, Column] = {}
    for name, text in exprs.items():
        node = parse(text)
        got = low.node(node)
        col = finite(low._last(got).col if node.kind == ARRAY or not isinstance(got, Num) else got.col)
        out[name] = F.coalesce(col, F.lit(0.0)) if nonfinite == "zero" else col
    keep = [F.col(c) for c in bars.columns]
    return low.apply(bars).select(*keep, *[v.alias(k) for k, v in out.items()])
