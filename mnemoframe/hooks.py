"""Where models come in: registries of named callables, typed batch factories, retries, and a trace of every call.

A hook is a plain function; nothing here needs a network. Registries fall back from a profile to the default, factories give DataFrames with a
declared schema, and a failing call is tried again or handed on as an error row, never dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: How often a refused and how often a failing call is tried again, and the states of the latter.
REFUSED_TRIES, FAILED_TRIES, RETRIED = 10, 3, frozenset({408, 409, 429, 500, 502, 503, 504})


@dataclass
class Manifest:
    """A task of a model: the callable, the parameters that it needs, and the columns that it gives."""

    name: str
    call: Callable[..., Any]
    required: tuple[str, ...] = ()
    schema: str = "value string"
    template: str = ""

    def rendered(self, **given: Any) -> str:
        """The template with its parameters; a missing or an unknown one is an error."""
        missing = [p for p in self.required if p not in given]
        if missing:
            raise KeyError(f"{self.name} needs {missing}")
        return self.template.format_map(given)


class Registry:
    """Manifests by (task, profile); an unknown profile, or one without the task, gets the default's."""

    def __init__(self) -> None:
        self._held: dict[tuple[str, str], Manifest] = {}

    def add(self, manifest: Manifest, profile: str = "default") -> None:
        self._held[manifest.name, profile] = manifest

    def get(self, task: str, profile: str | None = None) -> Manifest:
        found = self._held.get((task, profile or "default")) or self._held.get((task, "default"))
        if found is None:
            raise KeyError(f"no task {task!r}")
        return found

    def tasks(self) -> list[str]:
        return sorted({t for t, _ in self._held})


def _state(error: BaseException | None) -> int | None:
    """The status code of an error or of what caused it."""
    seen = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        for holder in (error, getattr(error, "response", None)):
            if isinstance(code := getattr(holder, "status_code", None), int):
                return code
        error = error.__cause__ or error.__context__
    return None


def retried(call: Callable[..., Any], wait: Callable[[float], None] = time.sleep, first_wait: float = 1.0) -> Callable[..., Any]:
    """call, tried again: refusals of content up to REFUSED_TRIES times at once, states of RETRIED and timeouts up to FAILED_TRIES times with doubling waits, or as long as the error's retry_after says. Other errors, and the last one, are raised."""

    def run(*args: Any, **more: Any) -> Any:
        refused = failed = 0
        while True:
            try:
                return call(*args, **more)
            except Exception as e:
                if "content_filter" in str(e) and refused < REFUSED_TRIES:
                    refused += 1
                    continue
                if (isinstance(e, TimeoutError | ConnectionError) or _state(e) in RETRIED) and failed < FAILED_TRIES:
                    failed += 1
                    wait(float(getattr(e, "retry_after", 0) or first_wait * 2 ** (failed - 1)))
                    continue
                raise

    return run


@dataclass
class Trace:
    """Calls as they happen: (n, task, status, cost, seconds, error), failed ones too. listener gets a snapshot after every change."""

    listener: Callable[[list[dict]], None] | None = None
    calls: list[dict] = field(default_factory=list)

    def record(self, task: str, call: Callable[..., Any], *args: Any, cost: Callable[[Any], float] = lambda out: 0.0, **more: Any) -> Any:
        row: dict = {"n": len(self.calls), "task": task, "status": "running", "cost": 0.0, "seconds": 0.0, "error": None}
        self.calls.append(row)
        self._tell()
        began = time.monotonic()
        try:
            out = call(*args, **more)
            row.update(status="done", cost=float(cost(out)))
            return out
        except Exception as e:
            row.update(status="failed", error=f"{type(e).__name__}: {e}")
            raise
        finally:
            row["seconds"] = time.monotonic() - began
            self._tell()

    def _tell(self) -> None:
        if self.listener:
            self.listener([dict(r) for r in self.calls])

    def rows(self, spark) -> DataFrame:
        schema = "n int, task string, status string, cost double, seconds double, error string"
        return spark.createDataFrame([tuple(r[c] for c in ("n", "task", "status", "cost", "seconds", "error")) for r in self.calls], schema)


_MADE: dict[tuple[int, str, str], Callable[[DataFrame], DataFrame]] = {}


def factory(registry: Registry, task: str, profile: str | None = None, tries: int = 3) -> Callable[[DataFrame], DataFrame]:
    """A function from rows with the task's parameters to those rows with its columns and error; made once for each task and profile.

    The callable gets the parameters of one row and gives a dict of the declared columns. A call that fails, or an output without those columns, is tried again, up to tries times; after
    that the row has nulls and says why in error.
    """
    manifest = registry.get(task, profile)
    key = (id(registry), task, profile or "default")
    if key in _MADE:
        return _MADE[key]
    names = [part.split()[0] for part in manifest.schema.split(",")]

    def one(given: dict) -> tuple:
        error = None
        for _ in range(tries):
            try:
                out = retried(manifest.call)(**given)
                return (*(out[c] for c in names), None)
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        return (*(None for _ in names), error)

    def apply(rows: DataFrame) -> DataFrame:
        missing = [p for p in manifest.required if p not in rows.columns]
        if missing:
            raise KeyError(f"{task} needs {missing}")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [one(dict(zip(manifest.required, given))) for given in zip(*(batch[p] for p in manifest.required))]
                yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=[*names, "error"])], axis=1)

        held = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        return rows.mapInPandas(run, f"{held}, {manifest.schema}, error string")

    _MADE[key] = apply
    return apply


@dataclass
class EvaluationProfile:
    """How the answers of a kind of data set are judged: by letters, by votes or by a score."""

    name: str = "base"
    judge: str = "votes"
    votes: int = 3


#: Profiles of evaluation by kind of data set; unknown kinds get the base.
EVALUATION = {"choices": EvaluationProfile("choices", "letter", 1), "rubric": EvaluationProfile("rubric", "score", 1)}


def evaluation_profile(kind: str | None) -> EvaluationProfile:
    return EVALUATION.get((kind or "").lower(), EvaluationProfile())
