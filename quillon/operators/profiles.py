"""Profiles of expressions over any interval, kept by month and made once.

The store has a row for each bar of a symbol and month of an expression, bar size and horizon: the signs of the factor and of the return that
follows, and when that return ends.  A request names jobs; the months of their intervals that no one has stored are
computed, from their own bars and as many before them as the windows look back, and are added.  What a job's
warm-up, start and end leave of the rows is decided on reading, so intervals share their months.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.stats import is_finite
from quillon.operators.scoring import job_window
from quillon.plans.expr import lookback, parse, profile_hash, validate
from quillon.plans.lower import factors
from quillon.sources import bars as B
from quillon.sources.ledger import Ledger
from quillon.sources.scratch import stash

_KEY = "expr_hash string, bar_minutes int, horizon int, month date"
CELLS = f"{_KEY}, symbol string, ts timestamp_ntz, valid boolean, pred tinyint, label tinyint, until timestamp_ntz"
DONE = f"{_KEY}, part string"


@dataclass(frozen=True)
class Job:
    """What ``scoring`` calls a job of direction profiles."""

    expr: str
    start: str
    end: str
    bar_minutes: int
    horizon: int = 1

    @property
    def hash(self) -> str:
        return profile_hash(self.expr)


def _month(d: date) -> date:
    return d.replace(day=1)


def _next(d: date) -> date:
    return date(d.year + d.month // 12, d.month % 12 + 1, 1)


def _months(first: date, last: date) -> list[date]:
    out, at = [], _month(first)
    while at <= last:
        out.append(at)
        at = _next(at)
    return out


class ProfileStore:
    """A store under a shared path, for bars of one kind (closed, origin, tie as in ``bars.resample``)."""

    def __init__(self, spark: SparkSession, path: str, **grid):
        self.spark, self.grid = spark, grid
        self.cells, self.done = Ledger(spark, f"{path}/cells", CELLS), Ledger(spark, f"{path}/done", DONE)

    def request(self, rows: DataFrame, jobs: list[Job], warmup: int | None = None) -> DataFrame:
        """(expr_hash, start_date, end_date, bar_minutes, horizon, symbol, ts, pred, label, mask, correct) of jobs over rows, bars or
        trades (symbol, ts, ohlcv).  Expressions that do not validate have no rows.

        A month is stored if each of its valid bars has its return already, so the last months of the data are computed again by the
        next request.  Jobs and months, some thousands of names, pass through the driver.
        """
        jobs = sorted({j for j in jobs if validate(j.expr).valid}, key=lambda j: (j.expr, j.start, j.end, j.bar_minutes, j.horizon))
        if not jobs:
            return self._cut(self.spark.createDataFrame([], CELLS), [], warmup)
        span = rows.agg(F.min("ts"), F.max("ts")).first()
        loads = self._loads(jobs, warmup)
        needed = {}
        for j, load in zip(jobs, loads, strict=True):
            lo, hi = max(load.date(), span[0].date()) if span[0] else load.date(), min(date.fromisoformat(j.end), span[1].date()) if span[1] else load.date()
            for m in _months(lo, hi):
                needed[j.hash, j.bar_minutes, j.horizon, m] = j.expr
        stored = self.done.read()
        wanted = self.spark.createDataFrame(sorted(needed), _KEY)
        have = {tuple(r) for r in wanted.join(stored, [c.split()[0] for c in _KEY.split(", ")], "left_semi").collect()}
        missing = {k: e for k, e in needed.items() if k not in have}
        fresh = self._compute(rows, missing, span) if missing else self.spark.createDataFrame([], CELLS)
        # of a month that two writers stored, the first part counts
        first = stored.groupBy("expr_hash", "bar_minutes", "horizon", "month").agg(F.min("part").alias("_part"))
        old = self.cells.read("_part").join(first.join(F.broadcast(wanted), ["expr_hash", "bar_minutes", "horizon", "month"]), ["expr_hash", "bar_minutes", "horizon", "month", "_part"]).drop("_part")
        return self._cut(old.unionByName(fresh), jobs, warmup)

    def _loads(self, jobs: list[Job], warmup: int | None) -> list[datetime]:
        load, _ = job_window("direction", F.col("m"), F.col("s"), warmup)
        given = self.spark.createDataFrame([(i, j.bar_minutes, j.start) for i, j in enumerate(jobs)], "i int, m int, s string")
        return [r.load for r in given.select("i", load.alias("load")).orderBy("i").collect()]

    def _compute(self, rows: DataFrame, missing: dict, span) -> DataFrame:
        """Cells of the missing months; those of closed months are added to the store."""
        out = None
        seen = stash(rows.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last")), "seen")
        for minutes in sorted({k[1] for k in missing}):
            own = {k: e for k, e in missing.items() if k[1] == minutes}
            lo, hi = min(k[3] for k in own), _next(max(k[3] for k in own))
            exprs = {e: f"f{i}" for i, e in enumerate(sorted(set(own.values())))}
            horizons = sorted({k[2] for k in own})
            begin = self._reach(rows, seen, datetime(lo.year, lo.month, lo.day), minutes, max(lookback(parse(e)) for e in exprs) + 1, -1)
            end = self._reach(rows, seen, datetime(hi.year, hi.month, hi.day), minutes, max(horizons) + 1, 1)
            some = rows.where((F.col("ts") >= F.lit(begin).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))
            bars = B.finite_rows(B.bars(some, minutes, **self.grid))
            wide = factors(bars, {n: e for e, n in exprs.items()})
            long = wide.select("symbol", "ts", "close", F.posexplode(F.array(*exprs.values())).alias("at", "factor"))
            valid = is_finite("factor") & is_finite("close") & (F.col("close") > 0)
            over = Window.partitionBy("at", "symbol", "valid").orderBy("ts")
            long = long.withColumn("valid", valid)
            long = long.withColumns({f"{n}{h}": F.lead(c, h).over(over) for h in horizons for n, c in (("_a", "close"), ("_u", "ts"))})
            per = [F.struct(F.lit(h).alias("horizon"), F.col(f"_a{h}").alias("after"), F.col(f"_u{h}").alias("until")) for h in horizons]
            cells = long.withColumn("h", F.explode(F.array(*per))).select(
                "at", "h.horizon", F.trunc("ts", "month").alias("month"), "symbol", "ts", "valid", F.signum("factor").cast("tinyint").alias("pred"),
                F.when(F.col("valid"), F.signum(F.try_divide("h.after", "close") - 1).cast("tinyint")).alias("label"), F.when(F.col("valid"), F.col("h.until")).alias("until"),
            )
            names = self.spark.createDataFrame([(i, h, m, profile_hash(e)) for (_, _, h, m), e in own.items() for i in [int(exprs[e][1:])]], "at int, horizon int, month date, expr_hash string")
            cells = stash(cells.join(F.broadcast(names), ["at", "horizon", "month"]).withColumn("bar_minutes", F.lit(minutes)).select(*[c.split()[0] for c in CELLS.split(", ")]), "profiles")
            # closed: no valid bar lacks its return, and the data go on after the month
            closed = cells.groupBy("expr_hash", "bar_minutes", "horizon", "month").agg(F.count_if(F.col("valid") & F.col("until").isNull()).alias("open")).where("open = 0").where(F.add_months("month", 1) <= F.lit(span[1]).cast("date")).drop("open")
            part = self.cells.add(cells.join(closed, ["expr_hash", "bar_minutes", "horizon", "month"], "left_semi"))
            self.done.add(closed.withColumn("part", F.lit(part)))
            out = cells if out is None else out.unionByName(cells)
        return out

    def _reach(self, rows: DataFrame, seen: DataFrame, edge: datetime, minutes: int, n: int, way: int) -> datetime:
        """A time so far before (way -1) or after (1) an edge that every symbol has n bars on the way, or all that it has."""
        step = timedelta(minutes=minutes * n)
        while True:
            try:
                far = edge + way * step
            except OverflowError:
                return datetime(1, 1, 1) if way < 0 else datetime(9999, 1, 1)
            at = lambda x: F.lit(x).cast("timestamp_ntz")
            lo, hi = (far, edge) if way < 0 else (edge, far)
            label = F.col("ts") if minutes >= B.DAY_MINUTES else B.label(F.col("ts"), minutes, self.grid.get("closed", "right"), self.grid.get("origin"))
            found = rows.where((F.col("ts") >= at(lo)) & (F.col("ts") <= at(hi))).groupBy("symbol").agg(F.count_distinct(label).alias("n"))
            more = seen.where(F.col("first") < at(far)) if way < 0 else seen.where(F.col("last") > at(far))
            if more.join(found, "symbol", "left").where(F.coalesce("n", F.lit(0)) <= n).isEmpty():
                # one bar more, as the edge may cut one
                return far + way * timedelta(minutes=minutes)
            step *= 4

    def _cut(self, cells: DataFrame, jobs: list[Job], warmup: int | None) -> DataFrame:
        given = self.spark.createDataFrame([(i, j.hash, j.bar_minutes, j.horizon, j.start, j.end) for i, j in enumerate(jobs)], "job int, expr_hash string, bar_minutes int, horizon int, start_date string, end_date string")
        load, first = job_window("direction", F.col("bar_minutes"), F.col("start_date"), warmup)
        given = given.withColumns({"load": load, "first": first})
        rows = cells.join(F.broadcast(given), ["expr_hash", "bar_minutes", "horizon"])
        day = lambda c: F.col(c).cast("timestamp_ntz")
        rows = rows.where((F.col("ts") >= F.col("load")) & (F.col("ts") <= day("end_date")))
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("job", "symbol").orderBy("ts")))
        kept: Column = (F.col("n") >= F.col("first")) & (F.col("ts") >= day("start_date")) & F.col("valid") & (F.col("until") <= day("end_date")) & F.col("label").isNotNull()
        mask = F.col("pred") != 0
        return rows.where(kept).select("expr_hash", "start_date", "end_date", "bar_minutes", "horizon", "symbol", "ts", "pred", "label", mask.alias("mask"), (mask & (F.col("pred") == F.col("label"))).alias("correct"))
