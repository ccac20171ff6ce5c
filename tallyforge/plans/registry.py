"""A registry of metric views: by name, with parameters read from the builder's signature; and a check of their windows."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from tallyforge.plans.metrics import MetricView

VIEWS: dict[str, Callable[..., MetricView]] = {}


def view(f: Callable[..., MetricView]) -> Callable[..., MetricView]:
    """Registers a builder under its own name."""
    if f.__name__ in VIEWS:
        raise ValueError(f"view {f.__name__} is registered twice")
    VIEWS[f.__name__] = f
    return f


def parameters(name: str) -> dict[str, object]:
    """Parameters of a view with their defaults; one without a default has ``inspect.Parameter.empty``."""
    return {k: p.default for k, p in inspect.signature(VIEWS[name]).parameters.items()}


def build(name: str, **given) -> MetricView:
    """The view of that name; an unknown name or parameter, or a missing one, raises."""
    if name not in VIEWS:
        raise KeyError(f"no view {name}; there are {sorted(VIEWS)}")
    known = parameters(name)
    if extra := sorted(set(given) - set(known)):
        raise TypeError(f"{name} has no parameter {extra}; it has {sorted(known)}")
    if missing := sorted(k for k, v in known.items() if v is inspect.Parameter.empty and k not in given):
        raise TypeError(f"{name} needs {missing}")
    out = VIEWS[name](**given)
    check_windows(out)
    return out


def check_windows(made: MetricView) -> None:
    """A view over samples collapses all its measures alike, and its series' columns are those of its grain, if it has one."""
    if made.sampled is None:
        return
    over = [n for n, m in made.measures.items() if m.cumulative_over]
    if over:
        raise ValueError(f"{made.name}: {over} run along time, the view's other measures take one sample")
    if made.grain and not set(made.sampled.partition) <= set(made.grain):
        raise ValueError(f"{made.name}: the series is kept by {made.sampled.partition}, the rows by {made.grain}")
