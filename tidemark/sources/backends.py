"""Backends that answer calls, by name.

A backend is made from settings and answers a call: ``backend(request, call, attempt) -> text``, ``call`` being
the fields that identify it. ``mock`` answers from hashes of the call, or from an oracle that knows the
planted graph; ``function`` wraps any function, which is where a client of a service goes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame

from tidemark.session import ship

Backend = Callable[[str, dict, int], str]
BACKENDS: dict[str, Callable[..., Backend]] = {}


class Oracle(Protocol):
    """What the mock asks of a planted graph; ``simulation.Answers`` is one."""

    def baseline(self, replicate: int): ...
    def ablated(self, i: int, replicate: int): ...
    def pairs(self, replicate: int): ...
    def generic(self, replicate: int): ...
    def chunk(self, t: int, replicate: int): ...
    def brief(self): ...


def register(name: str):
    """Adds a backend under ``name``."""

    def add(make):
        BACKENDS[name] = make
        return make

    return add


def backend(name: str, **settings) -> Backend:
    if name not in BACKENDS:
        raise KeyError(f"no backend {name}; there are {sorted(BACKENDS)}")
    return BACKENDS[name](**settings)


@register("function")
def function(call: Callable[[str, int], str]) -> Backend:
    return lambda request, fields, attempt: call(request, attempt)


def _unit(*parts) -> float:
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967295.0


@register("mock")
def mock(names: Sequence[str], oracle: Oracle | None = None, seed: int = 7) -> Backend:
    """Whole numbers for every kind of call; without an oracle they are hashes of the call."""
    names = list(names)
    at = {n: i for i, n in enumerate(names)}

    def answer(request: str, call: dict, attempt: int) -> str:
        task, trait, r = call.get("task"), call.get("trait"), int(call.get("replicate") or 0)
        if task in ("e1_baseline", "e1_ablate_elicit", "e3_chunk"):
            if oracle is None:
                values = [round(100 * _unit(seed, task, trait, n, r)) for n in names]
            elif task == "e1_baseline":
                values = oracle.baseline(r)
            elif task == "e1_ablate_elicit":
                values = oracle.ablated(at[trait], r)
            else:
                values = oracle.chunk(int(str(trait).rpartition(":")[2]), r)
            return json.dumps({n: int(v) for n, v in zip(names, values)})
        if task in ("e2_pair", "e2_generic"):
            a, _, b = str(trait).partition("->")
            value = 100 * _unit(seed, task, a, b, r) if oracle is None else (oracle.pairs if task == "e2_pair" else oracle.generic)(r)[at[a], at[b]]
            return json.dumps({"rating": int(round(float(value)))})
        if task == "evidence_brief":
            counts = oracle.brief() if oracle else [(0, "for")] * len(names)
            return json.dumps({n: [{"quote": f"line {q} on {n}", "chunk": q, "direction": way} for q in range(k)] for n, (k, way) in zip(names, counts)})
        if task == "evidence_chunk":
            return json.dumps({n: [] for n in names})
        if task == "e1_ablate_rewrite":
            return f"The brief without {trait}."
        raise ValueError(f"no such task: {task}")

    return answer


def answered(calls: DataFrame, answer: Backend, retries: int = 1) -> DataFrame:
    """``calls`` (task, trait, replicate, request, ...) with ``response``; asked again while it is no object.

    Requests of rewrites need no object. A call without a valid answer gets a null response.
    """
    ship(calls.sparkSession)
    names = calls.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema.fields) + ", response string"

    def valid(task, text):
        if task == "e1_ablate_rewrite":
            return bool(text)
        try:
            return isinstance(json.loads(text), dict)
        except (TypeError, ValueError):
            return False

    def run(batches):
        for pdf in batches:
            out = []
            for call in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                texts = (answer(call.get("request") or "", call, attempt) for attempt in range(retries + 1))
                out.append(next((t for t in texts if valid(call.get("task"), t)), None))
            yield pdf[names].assign(response=out)

    return calls.mapInPandas(run, schema)
