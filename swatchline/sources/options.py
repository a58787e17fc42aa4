"""Options of the reports: a JSON file found upwards from a directory, and explicit values over it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

#: Names of the configuration file, in order.
NAMES = [".swatchlinerc.json", ".swatchlinerc"]


@dataclass(frozen=True)
class Options:
    include: str | None = None
    exclude: list[str] = field(default_factory=list)
    vars: str | None = None
    threshold: float = 10
    named: bool = True
    min_count: int = 2
    min_classes: int = 2
    tailwind_version: str | int = "auto"
    format: str = "text"


def load(start: str, names: list[str] = NAMES) -> dict:
    """The nearest file's object; one that can't be read as JSON gives none."""
    here = Path(start).resolve()
    for folder in [here, *here.parents]:
        for name in names:
            if (folder / name).is_file():
                try:
                    found = json.loads((folder / name).read_text(encoding="utf-8"))
                except ValueError:
                    return {}
                return found if isinstance(found, dict) else {}
    return {}


def merge(explicit: Options, config: dict) -> Options:
    """The configuration's values where the explicit ones are at their defaults; its Tailwind version wins always.

    Excludes of the configuration count only if none is explicit. `json: true` sets the format, `format` does not.
    Empty and zero values of the configuration set nothing, but for a threshold of 0.
    """
    plain = Options()
    more = config.get("exclude") or []
    given = {
        "exclude": [more] if isinstance(more, str) else list(more),
        "include": config.get("include"),
        "vars": config.get("vars"),
        "threshold": config.get("threshold"),
        "named": False if config.get("named") is False else None,
        "min_count": config.get("minCount"),
        "min_classes": config.get("minClasses"),
        "format": "json" if config.get("json") is True else None,
    }
    unset = (None, []) + ("",)
    taken = {k: v for k, v in given.items() if v not in unset and (v or k in ("threshold", "named")) and getattr(explicit, k) == getattr(plain, k)}
    return replace(explicit, **taken, **({"tailwind_version": config["tailwindVersion"]} if config.get("tailwindVersion") else {}))
