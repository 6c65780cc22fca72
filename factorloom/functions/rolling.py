"""Rolling statistics over several window lengths, built from short windows.

A sliding frame of ``w`` rows costs ``w`` updates per row and aggregate. Sums, extremes and
second moments of a long window follow from two shorter ones that adjoin: 10 rows are 5 rows
and the 5 before them. So only the shortest windows slide; each longer one takes a lag and a
merge. Merging adds like to like and never subtracts running totals, so no precision is lost.

All steps use one window specification: the table is shuffled and sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from factorloom.functions.frames import so_far, trailing
from factorloom.functions.numeric import CONSTANT_TOLERANCE, div

# Window length: (recent part, part before it).
PARTS = {10: (5, 5), 20: (10, 10), 30: (20, 10), 60: (30, 30)}


class Rolling:
    """Collects the statistics that factor formulas ask for, and adds them to a table step by step.

    Statistics over a full window are null unless all its rows have a value.
    """

    def __init__(self, spec: WindowSpec, longest: int = 60) -> None:
        self.spec = spec
        self.longest = longest
        self.windowed: dict[str, Column] = {}
        self.gated: dict[str, Column] = {}
        self.merges: dict[int, tuple[dict[str, Column], dict[str, Column]]] = {}
        self.derived: dict[str, Column] = {}

    def _window(self, name: str, column: Column) -> Column:
        self.windowed.setdefault(name, column)
        return F.col(name)

    # --- full windows -----------------------------------------------------------------

    def _statistic(self, kind: str, of: tuple[str, ...], w: int) -> Column:
        name = "_".join(["", kind, *of, str(w)])
        if w in PARTS:
            lags, merged = self.merges.setdefault(w, ({}, {}))
            if name not in merged:
                merged[name] = self._merge(kind, of, w, lags)
        elif name not in self.gated:
            frame = trailing(self.spec, w)
            raw = {
                "sum": lambda: F.sum(of[0]),
                "max": lambda: F.max(of[0]),
                "min": lambda: F.min(of[0]),
                "m2": lambda: F.var_samp(of[0]),
                "co": lambda: F.covar_samp(*of),
            }[kind]().over(frame)
            value = self._window(f"{name}_raw", raw)
            if kind in ("m2", "co"):
                value = value * (w - 1)
            complete = F.lit(True)
            for column in of:
                complete &= self._window(f"_n_{column}_{w}", F.count(column).over(frame)) >= w
            self.gated[name] = F.when(complete, value)
        return F.col(name)

    def _merge(self, kind: str, of: tuple[str, ...], w: int, lags: dict[str, Column]) -> Column:
        near, far = PARTS[w]

        def parts(kind: str, of: tuple[str, ...]) -> tuple[Column, Column]:
            self._statistic(kind, of, near)
            self._statistic(kind, of, far)
            stem = "_".join(["", kind, *of])
            lagged = f"{stem}_{far}_lag{near}"
            lags.setdefault(lagged, F.lag(f"{stem}_{far}", near).over(self.spec))
            return F.col(f"{stem}_{near}"), F.col(lagged)

        a, b = parts(kind, of)
        if kind == "sum":
            return a + b
        if kind in ("max", "min"):
            pick = F.greatest if kind == "max" else F.least
            return F.when(a.isNotNull() & b.isNotNull(), pick(a, b))
        # Second moments about the mean of the union: the parts', plus the distance of their means.
        between = F.lit(near * far / w)
        for column in (of[0], of[-1]):
            sum_a, sum_b = parts("sum", (column,))
            between = between * (sum_b / far - sum_a / near)
        return a + b + between

    def sum(self, column: str, w: int) -> Column:
        return self._statistic("sum", (column,), w)

    def mean(self, column: str, w: int) -> Column:
        return self.sum(column, w) / w

    def max(self, column: str, w: int) -> Column:
        return self._statistic("max", (column,), w)

    def min(self, column: str, w: int) -> Column:
        return self._statistic("min", (column,), w)

    def std(self, column: str, w: int) -> Column:
        return F.sqrt(self._statistic("m2", (column,), w) / (w - 1))

    def covariance(self, x: str, y: str, w: int) -> Column:
        return self._statistic("co", (x, y), w) / (w - 1)

    def varies(self, column: str, w: int) -> Column:
        return self.std(column, w) > F.abs(self.mean(column, w)) * CONSTANT_TOLERANCE

    def correlation(self, x: str, y: str, w: int) -> Column:
        """Null unless all rows have both values and neither is constant."""
        rho = div(self.covariance(x, y, w), self.std(x, w) * self.std(y, w))
        return F.when(self.varies(x, w) & self.varies(y, w), rho)

    # --- windows that may be shorter at the start of a history ----------------------------

    def lag(self, column: str, rows: int) -> Column:
        return self._window(f"_lag_{column}_{rows}", F.lag(column, rows).over(self.spec))

    def observed(self, column: str, w: int) -> Column:
        """Number of non-null values among the last ``w`` rows, as a difference of running counts."""
        name = f"_seen_{column}"
        if f"{name}_{w}" not in self.merges.setdefault(w, ({}, {}))[1]:
            self._window(name, F.count(column).over(so_far(self.spec)))
            lags, merged = self.merges[w]
            lags[f"{name}_lag{w}"] = F.lag(name, w, 0).over(self.spec)
            merged[f"{name}_{w}"] = F.col(name) - F.col(f"{name}_lag{w}")
        return F.col(f"{name}_{w}")

    def recent(self, column: str, w: int) -> Column:
        """The values of the last ``w`` rows, oldest first, cut from one list of the longest window.

        Nulls are not collected: the column must have a stand-in for them. The lists join in the last step, so that the
        others do not copy them.
        """
        name = f"_list_{column}"
        lags, _ = self.merges.setdefault(self.longest, ({}, {}))
        lags.setdefault(name, F.collect_list(column).over(trailing(self.spec, self.longest)))
        whole = F.col(name)
        return whole if w == self.longest else F.slice(whole, F.greatest(F.size(whole) - (w - 1), F.lit(1)), w)

    def descending(self, column: str, w: int) -> Column:
        name = f"_desc_{column}_{w}"
        # Ascending numbers sort as primitives, descending ones as objects.
        self.derived.setdefault(name, F.reverse(F.sort_array(self.recent(column, w))))
        return F.col(name)

    def slope(self, y: str, x: str, w: int) -> Column:
        spread = self._statistic("m2", (x,), w)
        return div(self._statistic("co", (x, y), w), spread)

    # --- the table --------------------------------------------------------------------

    def add_to(self, df: DataFrame) -> DataFrame:
        """Add all statistics asked for so far."""
        df = df.withColumns(self.windowed).withColumns(self.gated)
        for w in sorted(self.merges):
            lags, merged = self.merges[w]
            df = df.withColumns(lags).withColumns(merged)
        return df.withColumns(self.derived) if self.derived else df
