"""Composing steps. A step is a function DataFrame -> DataFrame; Catalyst fuses what it can."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame

Step = Callable[[DataFrame], DataFrame]


def sequence(*steps: Step) -> Step:
    """Apply at least two steps one after another; nested sequences are flattened."""
    flat = [s for step in steps for s in getattr(step, "steps", [step])]
    if len(flat) < 2:
        raise ValueError("a sequence needs at least two steps")

    def run(df: DataFrame) -> DataFrame:
        return functools.reduce(DataFrame.transform, flat, df)

    run.steps = flat
    return run


def parallel(**branches: Column) -> Step:
    """Several expressions over the same input, computed in one pass."""
    return lambda df: df.select(*[c.alias(name) for name, c in branches.items()])


def parallel_frames(key: str, **branches: Step) -> Step:
    """Branches that aggregate or join: each result keeps ``key`` and is joined on it."""

    def run(df: DataFrame) -> DataFrame:
        parts = [df.transform(step) for step in branches.values()]
        return functools.reduce(lambda a, b: a.join(b, key), parts)

    return run


def pick(*columns: str) -> Step:
    return lambda df: df.select(*columns)


def assign(**columns: Column) -> Step:
    return lambda df: df.withColumns(columns)


def alternatives(default: str, **steps: Step) -> Callable[[str | None], Step]:
    """Choose a step by name, the default one without a name."""
    if default not in steps:
        raise ValueError(f"unknown default {default!r}")

    def choose(name: str | None = None) -> Step:
        if (name or default) not in steps:
            raise ValueError(f"unknown alternative {name!r}; known: {sorted(steps)}")
        return steps[name or default]

    return choose


def with_fallbacks(step: Step, *others: Step, errors: tuple = (Exception,)) -> Step:
    """Use the next step if one cannot be built (missing column, missing table ...)."""

    def run(df: DataFrame) -> DataFrame:
        for candidate in (step, *others[:-1]) if others else ():
            try:
                return candidate(df)
            except errors:
                continue
        return (others[-1] if others else step)(df)

    return run


def with_listeners(step: Step, on_start=None, on_end=None) -> Step:
    def run(df: DataFrame) -> DataFrame:
        if on_start:
            on_start(df)
        result = step(df)
        if on_end:
            on_end(result)
        return result

    return run


def bind(step: Callable[..., DataFrame], **options) -> Step:
    return functools.partial(step, **options)


def with_retry(call: Callable, attempts: int = 3, pause: float = 1.0) -> Callable:
    """Repeat a failing call inside a task with doubled pauses; the last error is raised."""

    @functools.wraps(call)
    def run(*args, **kwargs):
        for attempt in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception:
                if attempt == attempts - 1:
                    raise
                time.sleep(pause * 2**attempt)

    return run


def options_of(steps: Mapping[str, Step]) -> list[str]:
    return sorted(steps)
