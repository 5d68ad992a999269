"""Operators by name, and pipelines of them.

An operator is a function (df, **options) -> df registered with `@op("name")`. A pipeline is an ordered list of
(name, options). Names and options are validated when the pipeline is built, so a misspelt step fails instead
of being skipped, and nothing runs before an action: a pipeline only composes one logical plan.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame

Op = Callable[..., DataFrame]
_OPS: dict[str, Op] = {}


def op(name: str) -> Callable[[Op], Op]:
    def add(f: Op) -> Op:
        if name in _OPS:
            raise ValueError(f"operator {name} is registered twice")
        _OPS[name] = f
        return f

    return add


def get(name: str) -> Op:
    from weftline import operators

    operators.load()
    if name not in _OPS:
        raise KeyError(f"no operator {name!r}; there are {', '.join(sorted(_OPS))}")
    return _OPS[name]


def names() -> list[str]:
    from weftline import operators

    operators.load()
    return sorted(_OPS)


class Pipeline:
    """Steps applied in order; later pipelines can override a step's options by its name."""

    def __init__(self, steps: Iterable[tuple[str, dict] | str]):
        self.steps: list[tuple[str, dict]] = []
        for step in steps:
            name, options = (step, {}) if isinstance(step, str) else step
            f = get(name)
            known = inspect.signature(f).parameters
            free = any(p.kind is p.VAR_KEYWORD for p in known.values())
            unknown = [] if free else sorted(set(options) - set(list(known)[1:]))
            if unknown:
                raise TypeError(f"{name} takes no {', '.join(unknown)}")
            missing = [n for n, p in list(known.items())[1:] if p.default is p.empty and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY) and n not in options]
            if missing:
                raise TypeError(f"{name} needs {', '.join(missing)}")
            self.steps.append((name, dict(options)))

    def override(self, **options: dict) -> Pipeline:
        unknown = set(options) - {n for n, _ in self.steps}
        if unknown:
            raise KeyError(f"no step {', '.join(sorted(unknown))}")
        return Pipeline([(n, o | options.get(n, {})) for n, o in self.steps])

    def run(self, source) -> DataFrame:
        """Apply to a DataFrame, or to a callable that loads one."""
        df = source if isinstance(source, DataFrame) else source()
        return reduce(lambda d, s: d.transform(get(s[0]), **s[1]), self.steps, df)
