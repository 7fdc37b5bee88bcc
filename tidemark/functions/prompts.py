"""Requests as column expressions: templates by version and task, filled from columns.

A template is plain text with ``{name}`` fields. ``render`` turns it into one concatenation, so requests are
made inside the plan, and a null field counts as empty. Versions say the same in other words; they are
registered by name and may be added to.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

TASKS = ("evidence_brief", "e1_elicit", "e1_ablate", "e2_pair", "e2_generic", "e3_chunk")
VERSIONS: dict[str, dict[str, str]] = {}


def register(version: str, templates: dict[str, str]) -> None:
    """Adds a version; it must know every task."""
    missing = set(TASKS) - set(templates)
    if missing:
        raise ValueError(f"{version} lacks {sorted(missing)}")
    VERSIONS[version] = dict(templates)


def template(version: str, task: str) -> str:
    if version not in VERSIONS:
        raise KeyError(f"no version {version}; there are {sorted(VERSIONS)}")
    return VERSIONS[version][task]


register(
    "p1",
    {
        "evidence_brief": "Read the pieces below, all by one member.\n\n{corpus}\n\nFor each word, quote lines that speak for or against it.\n{menu}",
        "e1_elicit": "Read the brief and rate the person it describes.\n\n{brief}\n\n{scale}",
        "e1_ablate": "Rewrite the brief so that nothing in it supports {name} and it reads as {antonym} instead ({strength}). Keep all else.\n\n{brief}",
        "e2_pair": "{persona}\n\nTake away {src}. From 0 to 100, how far would {dep} change? Answer with one object that has the key rating.",
        "e2_generic": "Think of people in general. Take away {src}. From 0 to 100, how far would {dep} change? Answer with one object that has the key rating.",
        "e3_chunk": "Judge only this excerpt.\n\n{text}\n\n{scale}",
    },
)
register(
    "p1b",
    {
        "evidence_brief": "These pieces come from one member.\n\n{corpus}\n\nCollect, word by word, lines for or against each of these.\n{menu}",
        "e1_elicit": "Here is a brief about somebody. Rate that person.\n\n{brief}\n\n{scale}",
        "e1_ablate": "Remove from the brief whatever shows {name}, let it show {antonym} ({strength}), and leave the rest.\n\n{brief}",
        "e2_pair": "{persona}\n\nWere {src} gone, how different would {dep} be, on a scale of 0 to 100? One object with the key rating, please.",
        "e2_generic": "For people at large: were {src} gone, how different would {dep} be, on a scale of 0 to 100? One object with the key rating, please.",
        "e3_chunk": "Here is one excerpt; judge nothing else.\n\n{text}\n\n{scale}",
    },
)


def scale(names: list[str], low: int = 0, high: int = 100) -> str:
    """What an answer must look like: every name a key, a whole number each."""
    return f"Answer with one object that has each of these {len(names)} words as a key and a whole number from {low} to {high} as value, and nothing else: " + ", ".join(names)


def menu(pairs: list[tuple[str, str]]) -> str:
    """The names with their opposites, a line each."""
    return "\n".join(f"- {name} (opposite: {antonym})" for name, antonym in pairs)


def render(pattern: str, /, **fields: Column | str) -> Column:
    """The template with its fields filled; a field that is not given is an error."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", pattern)):
        if i % 2:
            value = fields[piece]
            parts.append(F.coalesce(value, F.lit("")) if isinstance(value, Column) else F.lit(value))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)
