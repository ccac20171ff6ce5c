"""Metric views: dimensions and measures declared once, aggregated at any grain.

A view names its source, left lookups, a filter, dimensions and measures.  Declarations are functions of a recording
proxy, ``lambda c: F.sum(c["kills"])``, which yields the Column and remembers the names; so a lookup is joined only if
something that is asked for names it.  Measures are aggregates over sums of their own, so rates stay right at any grain.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Expression = Callable[["Names"], Column]


class Names:
    """Gives Columns by name and remembers the names."""

    def __init__(self):
        self.used: set[str] = set()
        #: measures that count a value once for each key: the value and the key's columns
        self.once: dict[str, tuple[Column, tuple[str, ...]]] = {}

    def __getitem__(self, name: str) -> Column:
        self.used.add(name)
        return F.col(name)


@dataclass(frozen=True)
class Dimension:
    expression: Expression
    synonyms: tuple[str, ...] = ()
    resolve: Callable[[object], object] | None = None

    def where(self, column: Column, wanted) -> Column:
        """Equality for one value, membership for several (none of them: no rows), a Column as it is."""
        if isinstance(wanted, Column):
            return wanted
        if isinstance(wanted, (list, tuple, set, frozenset)):
            values = [self.resolve(v) if self.resolve else v for v in wanted]
            return column.isin(*values) if values else F.lit(False)
        return column == (self.resolve(wanted) if self.resolve else wanted)


@dataclass(frozen=True)
class Series:
    """Snapshots: of each ``partition`` only the first or last row by ``order`` counts."""

    partition: tuple[str, ...]
    order: str
    take: str = "last"

    def __post_init__(self):
        if self.take not in ("first", "last"):
            raise ValueError(f"a series takes its first or last row, not {self.take!r}")
        if not self.partition or not isinstance(self.order, str):
            raise ValueError("a series needs the columns that tell it from others, and one column that it runs along")


@dataclass(frozen=True)
class Measure:
    """``expression`` aggregates source columns; ``composed`` combines other measures by name.

    With ``once_per``, ``expression`` is a value of a row and the measure its sum, where each key of these columns counts
    once in a group, with its largest value: the lengths of games, over rows of several sources in a game.  ``series``
    says that the measure reads one sample of each series.
    """

    expression: Expression | None = None
    composed: Callable[[dict[str, Column]], Column] | None = None
    missing: str = "null"  # or "zero": what an absent group counts as in a comparison
    higher_is_better: bool = True
    synonyms: tuple[str, ...] = ()
    cumulative_over: tuple[str, ...] = ()  # grains along which the measure is a running total
    once_per: tuple[str, ...] = ()
    series: Series | None = None


@dataclass(frozen=True)
class Lookup:
    """A left lookup whose columns appear as a struct named ``alias``; at most one row may match.

    Of cardinality ``1:1`` no two rows of the source may have the same key either.
    """

    alias: str
    table: str | Callable[[SparkSession], DataFrame]
    on: dict[str, str]  # source column -> lookup column
    cardinality: str = "m:1"

    def __post_init__(self):
        if self.cardinality not in ("m:1", "1:1"):
            raise ValueError(f"lookup {self.alias}: cardinality is m:1 or 1:1, not {self.cardinality!r}")
        if not self.on:
            raise ValueError(f"lookup {self.alias} needs a key")


@dataclass(frozen=True)
class MetricView:
    name: str
    source: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame] | str | MetricView
    dimensions: dict[str, Dimension]
    measures: dict[str, Measure]
    lookups: tuple[Lookup, ...] = ()
    filter: Expression | None = None
    series: Series | None = None
    grain: tuple[str, ...] = ()

    def __post_init__(self):
        seen: set[str] = set()
        for kind in (self.dimensions, self.measures):
            for name, item in kind.items():
                for said in (name, *item.synonyms):
                    if said in seen:
                        raise ValueError(f"{self.name}: the name {said!r} is used twice")
                    seen.add(said)
        aliases = [k.alias for k in self.lookups]
        if len(set(aliases)) < len(aliases):
            raise ValueError(f"{self.name}: two lookups have one alias")
        self._check_series()

    def _check_series(self) -> None:
        """Collapsing a series holds for the whole query, so all measures over rows must ask for the same one, or none."""
        said = {n: m.series for n, m in self.measures.items() if m.series}
        if not said:
            return
        first = self.series or next(iter(said.values()))
        if different := sorted(n for n, x in said.items() if x != first):
            raise ValueError(f"{self.name}: {different} read another sample than other measures do")
        over_rows = [n for n, m in self.measures.items() if m.composed is None]
        if not self.series and (plain := sorted(n for n in over_rows if n not in said)):
            raise ValueError(f"{self.name}: {plain} read all rows, other measures one sample of each series")
        if running := sorted(n for n, m in self.measures.items() if m.cumulative_over):
            raise ValueError(f"{self.name}: {running} run along time, other measures take one sample")

    @property
    def sampled(self) -> Series | None:
        """The series that the view's measures read, declared by the view or by its measures."""
        return self.series or next((m.series for m in self.measures.values() if m.series), None)

    def field(self, kind: str, said: str) -> str:
        """The declared name behind a name or synonym."""
        items = getattr(self, kind)
        for name, item in items.items():
            if said == name or said in item.synonyms:
                return name
        raise KeyError(f"{self.name} has no {kind[:-1]} {said!r}; it has {', '.join(items)}")

    def measure(self, name: str, names: Names | None = None, path: tuple[str, ...] = ()) -> Column:
        """A measure's Column with composed ones put together."""
        names = names or Names()
        if name in path:
            raise ValueError(f"{self.name}: measures {' -> '.join((*path, name))} form a circle")
        item = self.measures.get(name)
        if item is None:
            raise KeyError(f"{self.name} has no measure {name!r}")
        if (item.expression is None) == (item.composed is None):
            raise TypeError(f"{self.name}: measure {name!r} needs an expression or a composition")
        if item.expression and item.once_per:
            names.once[name] = (item.expression(names), item.once_per)
            names.used.update(item.once_per)
            return F.coalesce(F.sum(f"_once_{name}"), F.lit(0))
        if item.expression:
            return item.expression(names)

        view = self

        class Others(dict):
            def __missing__(self, other: str) -> Column:
                return view.measure(other, names, (*path, name))

        return item.composed(Others())


@dataclass
class Context:
    """Where tables come from, and lookups whose keys are checked."""

    spark: SparkSession
    table: Callable[[str], DataFrame]
    check_keys: bool = False
    views: dict[str, MetricView] = field(default_factory=dict)
    #: which state a table is in; a table's keys are looked at once in each state
    version: Callable[[str], object] = lambda name: None
    checked: dict[tuple, bool] = field(default_factory=dict)

    def unique(self, df: DataFrame, keys: Sequence[str], table: str | None = None) -> bool:
        """Whether no two rows of ``df`` (the table's, if it is one) have the same key; rows with a null in it don't count."""
        said = (table, tuple(keys), self.version(table)) if table else None
        if said not in self.checked or said is None:
            known = df
            for k in keys:
                known = known.where(F.col(k).isNotNull())
            once = known.groupBy(*keys).count().where("count > 1").isEmpty()
            if said is None:
                return once
            self.checked[said] = once
        return self.checked[said]


def view_frame(context: Context, view: MetricView, needed: set[str] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """The view's rows with its dimensions as columns; ``needed`` names the dimensions and columns that are asked for."""
    names = Names()
    wanted = [d for d in view.dimensions if needed is None or d in needed]
    columns = {d: view.dimensions[d].expression(names) for d in wanted}
    keep = view.filter(names) if view.filter else None
    names.used |= needed or set()
    if view.sampled:
        names.used |= {*view.sampled.partition, view.sampled.order}
    joined = [k for k in view.lookups if needed is None or any(n == k.alias or n.startswith(f"{k.alias}.") for n in names.used)]
    names.used |= {left for k in joined for left in k.on}
    if rows is not None:
        df = rows
    elif isinstance(view.source, MetricView):
        df = view_frame(context, view.source, {n.split(".")[0] for n in names.used})
    elif isinstance(view.source, str):
        df = context.table(view.source)
    else:
        df = view.source(context.spark, context.table)
    for lookup in joined:
        right = context.table(lookup.table) if isinstance(lookup.table, str) else lookup.table(context.spark)
        if context.check_keys:
            if not context.unique(right, list(lookup.on.values()), lookup.table if isinstance(lookup.table, str) else None):
                raise ValueError(f"{view.name}: lookup {lookup.alias} has a key twice")
            source = view.source if isinstance(view.source, str) and rows is None else None
            if lookup.cardinality == "1:1" and not context.unique(df, list(lookup.on), source):
                raise ValueError(f"{view.name}: two rows have one key of lookup {lookup.alias}, which is 1:1")
        keys = [F.col(r).alias(f"_{lookup.alias}_{k}") for k, r in enumerate(lookup.on.values())]
        right = right.select(*keys, F.struct(*right.columns).alias(lookup.alias))
        on = [df[left] == right[f"_{lookup.alias}_{k}"] for k, left in enumerate(lookup.on)]
        df = df.join(right, on, "left").drop(*(f"_{lookup.alias}_{k}" for k in range(len(lookup.on))))
    if keep is not None:
        df = df.where(keep)
    return df.withColumns(columns) if columns else df


def _collapsed(df: DataFrame, series: Series) -> DataFrame:
    best = F.max_by if series.take == "last" else F.min_by
    # of rows at one time always the same one
    tie = F.xxhash64(*(f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()))
    return df.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(series.partition))).agg(best(F.struct("*"), F.struct(F.col(series.order), tie)).alias("_row")).select("_row.*")


def _with_once(df: DataFrame, names: Names, by: Sequence[str]) -> DataFrame:
    """Adds what measures of ``once_per`` sum: a key's largest value in one of its rows of the group, null in the others."""
    for name, (value, keys) in names.once.items():
        df = df.withColumn("_value", value)
        first = F.row_number().over(Window.partitionBy(*by, *keys).orderBy(F.desc_nulls_last("_value")))
        df = df.withColumn(f"_once_{name}", F.when(first == 1, F.col("_value"))).drop("_value")
    return df


def summarize(
    context: Context,
    view: MetricView,
    by: str | Sequence[str] = (),
    measures: str | Sequence[str] = (),
    filters: dict | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Measures of the view by dimensions: filter, collapse snapshots, group, aggregate, run up cumulative measures."""
    by = [view.field("dimensions", b) for b in ([by] if isinstance(by, str) else by)]
    wanted = [view.field("measures", m) for m in ([measures] if isinstance(measures, str) else measures)]
    if not wanted:
        raise ValueError("at least one measure is needed")
    filters = {view.field("dimensions", k): v for k, v in (filters or {}).items()}
    names = Names()
    aggregates = [view.measure(m, names).alias(m) for m in wanted]
    df = view_frame(context, view, {*names.used, *by, *filters}, rows)
    if view.sampled:
        df = _collapsed(df, view.sampled)
    for name, value in filters.items():
        df = df.where(view.dimensions[name].where(F.col(name), value))
    df = _with_once(df, names, by)
    out = df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
    for m in wanted:
        grains = view.measures[m].cumulative_over
        if grains:
            along = [b for b in by if b in grains]
            if len(along) != 1:
                raise ValueError(f"{m} runs along one of {', '.join(grains)}")
            window = Window.partitionBy(*(b for b in by if b != along[0])).orderBy(along[0]).rowsBetween(Window.unboundedPreceding, 0)
            out = out.withColumn(m, F.sum(m).over(window))
    return out


@dataclass(frozen=True)
class Scope:
    name: str
    filters: dict = field(default_factory=dict)
    context: Context | None = None


def compare(context: Context, view: MetricView, scopes: tuple[Scope, Scope], by: str | Sequence[str] = (), measures: str | Sequence[str] = (), filters: dict | None = None) -> DataFrame:
    """Two summaries side by side: ``<scope>_<measure>`` for both and ``gap_<measure>``, first less second."""
    first, second = scopes
    if first.name == second.name or "gap" in (first.name, second.name):
        raise ValueError("two different scope names are needed, and none may be 'gap'")
    by = [view.field("dimensions", b) for b in ([by] if isinstance(by, str) else by)]
    wanted = [view.field("measures", m) for m in ([measures] if isinstance(measures, str) else measures)]
    sides = []
    for scope in scopes:
        both = dict(filters or {})
        for k, v in scope.filters.items():
            if k in both:  # both conditions hold
                dimension = view.dimensions[view.field("dimensions", k)]
                column = F.col(view.field("dimensions", k))
                both[k] = dimension.where(column, both[k]) & dimension.where(column, v)
            else:
                both[k] = v
        side = summarize(scope.context or context, view, by, wanted, both)
        sides.append(side.withColumnsRenamed({m: f"{scope.name}_{m}" for m in wanted}))
    out = sides[0].join(sides[1], by, "full") if by else sides[0].crossJoin(sides[1])  # one row each
    columns = {}
    for m in wanted:
        a, b = (F.col(f"{s.name}_{m}") for s in scopes)
        if view.measures[m].missing == "zero":
            a, b = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
        columns |= {f"{first.name}_{m}": a, f"{second.name}_{m}": b}
    out = out.withColumns(columns)
    return out.withColumns({f"gap_{m}": F.col(f"{first.name}_{m}") - F.col(f"{second.name}_{m}") for m in wanted})


def reading(view: MetricView, measure: str, gap: Column) -> Column:
    """``better``, ``worse`` or ``even`` of a gap, by the measure's direction."""
    sign = F.signum(gap) * (1 if view.measures[measure].higher_is_better else -1)
    return F.when(sign > 0, "better").when(sign < 0, "worse").when(sign == 0, "even")


def validate_view(context: Context, view: MetricView) -> None:
    """Raises unless every declared expression resolves; no job runs."""
    df, names = view_frame(context, view), Names()
    if view.sampled and (lacking := sorted({*view.sampled.partition, view.sampled.order} - set(df.columns))):
        raise ValueError(f"{view.name}: the series' columns {lacking} are not in the source")
    measures = [view.measure(m, names).alias(m) for m in view.measures]
    _with_once(df, names, ()).agg(*measures).schema  # noqa: B018


def repeated_keys(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their count."""
    return df.groupBy(*grain).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate_grain(df: DataFrame, grain: Sequence[str]) -> None:
    missing = [g for g in grain if g not in df.columns]
    if missing or not repeated_keys(df, grain).isEmpty():
        raise ValueError(f"columns missing: {missing}" if missing else f"rows are not unique by {', '.join(grain)}")


def view_fields(spark: SparkSession, view: MetricView) -> DataFrame:
    rows = [("dimension", n, ",".join(d.synonyms), None) for n, d in view.dimensions.items()]
    rows += [("measure", n, ",".join(m.synonyms), m.missing) for n, m in view.measures.items()]
    return spark.createDataFrame(rows, "kind string, name string, synonyms string, missing string")
