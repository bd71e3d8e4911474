"""Settings: command line before configuration before defaults, and the routing manifest."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from pathlib import Path

from ..operators.routing import Routing


def load(given: str | None, *, variable: str, default: str, environ: Mapping[str, str] | None = None) -> dict:
    """The TOML of a given path, else of a variable's, else of the default; only a missing default is no error."""
    environ = os.environ if environ is None else environ
    path = given or environ.get(variable)
    if path is None and not Path(default).is_file():
        return {}
    return tomllib.loads(Path(path or default).read_text())


def merged(given: Mapping, config: Mapping, defaults: Mapping) -> dict:
    """For each default: the given value, else the configured one, else the default; None counts as not given."""
    return {k: next((x for x in (given.get(k), config.get(k)) if x is not None), v) for k, v in defaults.items()}


def routing(path: str | None) -> Routing:
    """The manifest at a path; without one, or if it is not TOML, the shipped one."""
    if path is None:
        return Routing()
    try:
        return Routing.of(tomllib.loads(Path(path).read_text()))
    except (OSError, tomllib.TOMLDecodeError):
        return Routing()
