"""Session settings that hold while a query is built and run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any, Self

from pyspark.sql import DataFrame

from ..plans.catalog import TemporalTable


class WithOptions:
    """The options of a query over ``table``; ``run`` applies an action while they hold."""

    table: TemporalTable

    def __init__(self) -> None:
        self._options: dict[str, str] = {}

    def option(self, key: str, value: str) -> Self:
        """A session setting that holds while ``df`` builds the query, and through ``run``."""
        self._options[key] = value
        return self

    @property
    def run_options(self) -> dict[str, str]:
        return dict(self._options)

    def run(self, action: Callable[[DataFrame], Any] = DataFrame.collect) -> Any:
        """Build the query, apply an action (by default: collect, for an aggregate or a few rows; or one that writes) and return what it returns, all under the options."""
        with self._settings():
            return action(self._build())

    def df(self) -> DataFrame:
        """The lazy result, planned under the options; Spark reads settings of the run when an action starts, so ``run`` is what they hold for."""
        with self._settings():
            return self._build()

    def _build(self) -> DataFrame:
        raise NotImplementedError

    @contextmanager
    def _settings(self) -> Iterator[None]:
        conf = self.table.df().sparkSession.conf
        before = {k: conf.get(k, None) for k in self._options}
        for key, value in self._options.items():
            conf.set(key, value)
        try:
            yield
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)
