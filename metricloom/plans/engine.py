"""Planning and running reports.

A report becomes one lazy DataFrame: scan, fold of undeclared dimensions, transforms, formula, comparison.
All inputs of a derived metric come in one frame with the metric as a hidden key, so one scan and one
shuffle serve them all.  Nothing is collected but finished charts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from ..frame import AT, VALUE, PointFrame
from ..functions.aggregators import Aggregator
from ..functions.charts import MOST_MARKS, THEME, Theme, compose, project
from ..operators import combine
from ..operators.base import Transform, run
from ..operators.groups import GroupBy
from ..operators.resample import LEAVE, Resample
from ..sources.points import METRIC, Source
from ..timeaxis import Calendar, Context
from .cache import ChartCache, SliceCache
from .catalog import SEMI_ADDITIVE, Catalog, Linear, Metric, Ratio
from .spec import BASELINE, PERCENT, Chart, Dashboard, DashboardContext, Report


@dataclass(frozen=True)
class Plan:
    """One load: stored metrics that share a scan, and the transforms that run on each of them."""

    metrics: tuple[str, ...]
    report: Report
    before: tuple[Transform, ...]
    after: tuple[Transform, ...]


@dataclass(frozen=True)
class Load:
    """One read of a source.  Reads with equal keys differ in their metrics only, so one scan can serve them."""

    metrics: tuple[str, ...]
    source: Source
    report: Report
    dims: tuple[str, ...] | None
    levels: bool
    head: Resample | None
    #: Keys that the head buckets by where a grouping after it keeps no others.
    by: tuple[str, ...] | None = None

    @property
    def key(self) -> tuple:
        r = self.report
        return id(self.source), r.tenant, r.entities, r.timeframe, self.dims, repr(self.head), self.by


def folded_by(transforms: Sequence[Transform]) -> tuple[str, ...] | None:
    """The keys of a grouping that follows a bucketing with the same sum, least or greatest: both are then one grouping.

    Sums of sums are sums, so bucketing can leave out the other keys at once instead of shuffling a row for
    each of them.
    """
    if len(transforms) < 2 or type(transforms[0]) is not Resample or type(transforms[1]) is not GroupBy:
        return None
    head, group = transforms[:2]
    same = head.agg == group.agg and type(head.agg) is Aggregator and head.agg.name in ("sum", "min", "max")
    return group.by if same and head.gap == LEAVE else None


class Engine:
    """``sources`` is one source, or one for each stored metric; ``labels`` names the values of dimensions in charts, ``theme`` colours
    them, and a chart of more than ``most_marks`` points is refused."""

    def __init__(
        self, catalog: Catalog, sources: Source | dict[str, Source], calendar: Calendar = Calendar(),
        slices: SliceCache | None = None, charts: ChartCache | None = None, labels: Callable[[str, str], str] | None = None,
        theme: Theme = THEME, most_marks: int = MOST_MARKS,
    ):
        self.catalog, self.calendar = catalog, calendar
        self.sources = sources
        self.slices, self.charts, self.labels, self.theme, self.most_marks = slices, charts, labels, theme, most_marks
        self._shared: dict[tuple, PointFrame] = {}

    # Analysis

    def source(self, metric: str) -> Source:
        return self.sources[metric] if isinstance(self.sources, dict) else self.sources

    def plan(self, report: Report) -> Plan:
        metric = self.catalog[report.metric]
        stored = metric.formula.inputs if metric.formula else (metric.id,)
        entity = self.source(stored[0]).entity
        for d in report.dimensions:
            if d == entity or d not in metric.dimensions:
                raise ValueError(f"metric '{metric.id}' has no dimension '{d}' to keep; it has {', '.join(metric.dimensions) or 'none'}")
        for t in report.transforms:
            for d in t.dimensions:
                if d != entity and d not in report.dimensions:
                    raise ValueError(f"a transform groups or filters by '{d}', which the report doesn't keep")
        if report.minimum_denominator is not None and not isinstance(metric.formula, Ratio):
            raise ValueError(f"a minimum denominator qualifies ratios; '{metric.id}' isn't one")
        if metric.formula is None:
            return Plan(stored, report, report.transforms, ())
        if isinstance(metric.formula, Ratio) and any(t.shares for t in report.transforms):
            raise ValueError("a ratio has no shares: ratios don't add up to a whole")
        last = max((i for i, t in enumerate(report.transforms) if t.aggregates), default=-1)
        before = report.transforms[: last + 1]
        if any(t.value_filter for t in before):
            raise ValueError("a derived metric's values exist only after its last aggregation; filter and rank them after it")
        swapped = tuple(t.with_aggregator(metric.formula.agg) if t.aggregates else t for t in before)
        return Plan(stored, report, swapped, report.transforms[last + 1 :])

    def check_comparison(self, report: Report) -> None:
        grain = None
        for t in report.transforms:
            grain = t.period if isinstance(t, Resample) else None if t.collapses_time else grain
        shift = report.comparison.baseline.resolve(report.timeframe, self.calendar)
        if problem := shift.problem(grain):
            raise ValueError(problem)

    # Execution

    def frame(self, report: Report) -> PointFrame:
        """The report's points as a lazy frame."""
        if report.comparison is None:
            return self._frame(report)
        if report.timeframe is None:
            raise ValueError("a comparison needs a timeframe")
        self.check_comparison(report)
        shift = report.comparison.baseline.resolve(report.timeframe, self.calendar)
        plain = replace(report, comparison=None)
        earlier = self._frame(replace(plain, timeframe=shift.back(report.timeframe, self.calendar)))
        earlier = combine.shifted(earlier, shift, self.calendar)
        if report.comparison.output == BASELINE:
            return earlier
        return combine.change(self._frame(plain), earlier, report.comparison.output == PERCENT)

    def _frame(self, report: Report) -> PointFrame:
        plan, metric = self.plan(report), self.catalog[report.metric]
        context = Context(self.calendar, report.timeframe)
        made = self._inputs(plan, context)
        if metric.formula is None:
            out = made.having(made.df, hidden=())
        elif isinstance(metric.formula, Ratio):
            f = metric.formula
            out = combine.ratio(made, METRIC, f.numerator, f.denominator, f.scale, report.minimum_denominator, metric.unit)
        else:
            assert isinstance(metric.formula, Linear)
            out = combine.linear(made, METRIC, dict(metric.formula.terms), metric.formula.need_all, metric.unit)
        out = replace(out, unit=out.unit or metric.unit)
        return run(out, plan.after, context)

    def _inputs(self, plan: Plan, context: Context) -> PointFrame:
        """All inputs in one frame where they share a source, else one frame for each source put together."""
        groups: dict[int, list[str]] = {}
        for m in plan.metrics:
            groups.setdefault(id(self.source(m)), []).append(m)
        parts = [self._load(tuple(ms), plan, context) for ms in groups.values()]
        if len({p.axis.kind for p in parts}) > 1:
            raise ValueError("a formula's inputs must have the same kind of time")
        ranked = all(p.sequenced for p in parts)
        out, *others = [p if ranked else p.having(p.df, sequenced=False) for p in parts]
        for p in others:
            out = out.having(out.df.select(*out.columns).unionByName(p.df.select(*out.columns)), unique=out.unique and p.unique)
        return out

    def _scope(self, metrics: tuple[str, ...], plan: Plan) -> Load:
        report, source = plan.report, self.source(metrics[0])
        definitions = [self.catalog[m] for m in metrics]
        self._check_kind(definitions, source)
        levels = any(m.additivity == SEMI_ADDITIVE and set(m.dimensions) - set(report.dimensions) for m in definitions)
        rolls = bool(plan.before) and type(plan.before[0]) is Resample and not levels
        head = plan.before[0] if rolls else None
        return Load(metrics, source, report, None if levels else report.dimensions, levels, head, folded_by(plan.before) if rolls else None)

    def _load(self, metrics: tuple[str, ...], plan: Plan, context: Context) -> PointFrame:
        load = self._scope(metrics, plan)
        if (held := self._shared.get(load.key)) is not None:
            frame = held.having(held.df.where(F.col(METRIC).isin(list(metrics))))
        else:
            frame = self._read(load, metrics, context)
        if load.levels:
            frame = self._folded(frame, load.report.dimensions)
        done = 0 if load.head is None else 1 if load.by is None else 2
        return run(frame, plan.before[done:], context)

    def _read(self, load: Load, metrics: tuple[str, ...], context: Context) -> PointFrame:
        report = load.report
        if self.slices is not None and load.by is None:
            return self.slices.points(report.tenant, metrics, report, load.source, load.dims, load.head, context)
        if load.head is not None:
            return load.source.rolled(metrics, report.entities, report.timeframe, load.dims, load.head, context, load.by)
        return load.source.points(metrics, report.entities, report.timeframe, load.dims)

    def _loads(self, report: Report) -> list[Load]:
        """What a report reads: for each of its timeframes, the metrics of each source."""
        frames = [report.timeframe]
        if report.comparison is not None and report.timeframe is not None:
            earlier = report.comparison.baseline.resolve(report.timeframe, self.calendar).back(report.timeframe, self.calendar)
            frames = [earlier] if report.comparison.output == BASELINE else [report.timeframe, earlier]
        out = []
        for frame in frames:
            plan = self.plan(replace(report, comparison=None, timeframe=frame))
            groups: dict[int, list[str]] = {}
            for m in plan.metrics:
                groups.setdefault(id(self.source(m)), []).append(m)
            out += [self._scope(tuple(ms), plan) for ms in groups.values()]
        return out

    @staticmethod
    def _folded(frame: PointFrame, keep: Sequence[str]) -> PointFrame:
        """A level measured in parts: the parts of a time are summed, missing only if all are."""
        dims = (frame.entity, *keep)
        if set(frame.dims) == set(dims):
            return frame
        df = frame.df.groupBy(*frame.hidden, *dims, AT).agg(F.sum(VALUE).alias(VALUE))
        return frame.having(df, dims=dims, unique=True)

    def _check_kind(self, metrics: list[Metric], source: Source) -> None:
        for m in metrics:
            if m.time_kind != source.axis.kind:
                raise ValueError(f"metric '{m.id}' is declared as {m.time_kind} time, but its source holds {source.axis.kind} times")

    # Results

    def unit(self, report: Report) -> str | None:
        if report.view.unit is not None:
            return report.view.unit
        percent = report.comparison is not None and report.comparison.output == PERCENT
        return "%" if percent or any(t.shares for t in report.transforms) else self.catalog[report.metric].unit

    def run(self, report: Report) -> dict:
        key = None if self.charts is None else self.charts.key(report, self.calendar, self.theme)
        if key is not None and (found := self.charts.get(key)) is not None:
            return found
        view = replace(report.view, unit=self.unit(report))
        chart = project(self.frame(report), view, self.calendar, self.catalog[report.metric].title, self.labels, self.theme, self.most_marks)
        if key is not None:
            self.charts.put(key, chart, (report.tenant, self._inputs_of(report), report.entities))
        return chart

    def _inputs_of(self, report: Report) -> tuple[str, ...]:
        metric = self.catalog[report.metric]
        return (metric.id, *(metric.formula.inputs if metric.formula else ()))

    def run_many(self, reports: Sequence[Report]) -> list[dict]:
        """As ``run`` one by one; reads that differ in their metrics only are one scan, bucketed once if all bucket alike."""
        wanted: dict[tuple, list[Load]] = {}
        for r in reports if len(reports) > 1 and self.slices is None else ():
            for load in self._loads(r):
                wanted.setdefault(load.key, []).append(load)
        sharing = Engine(self.catalog, self.sources, self.calendar, self.slices, self.charts, self.labels, self.theme, self.most_marks)
        try:
            for key, loads in wanted.items():
                if len(loads) > 1:
                    metrics = tuple(dict.fromkeys(m for x in loads for m in x.metrics))
                    made = sharing._read(loads[0], metrics, Context(self.calendar, loads[0].report.timeframe))
                    sharing._shared[key] = made.having(made.df.persist())
            return [sharing.run(r) for r in reports]
        finally:
            for frame in sharing._shared.values():
                frame.df.unpersist()

    def run_chart(self, chart: Chart) -> dict:
        return self.run_charts([chart])[0]

    def run_charts(self, charts: Sequence[Chart]) -> list[dict]:
        views = iter(self.run_many([s.report for c in charts for s in c.series]))
        out = []
        for c in charts:
            parts = [(s, next(views), self.catalog[s.report.metric].title) for s in c.series]
            out.append(compose(parts, c.title, self.theme))
        return out

    def run_dashboard(self, dashboard: Dashboard, context: DashboardContext) -> dict:
        return {"title": dashboard.title, "charts": self.run_charts(dashboard.build(context))}

    def invalidate(self, tenant: str = "default", metric: str | None = None, entity: int | None = None) -> None:
        """Forgets what a write to a metric (None: all) and entity (None: all) of a tenant may have changed."""
        for cache in (self.slices, self.charts):
            if cache is not None:
                cache.invalidate(tenant, metric, entity)


