"""Settings of the corpus plans from a JSON or YAML file; one file may extend another."""

from __future__ import annotations

import json
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path


class SettingsError(ValueError):
    """What is wrong with a settings file, every fault named."""


def number(low: float, high: float = float("inf")):
    return lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and low <= v <= high


def whole(low: int):
    return lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= low


def setting(default, fits):
    return field(default=default, metadata={"fits": fits})


@dataclass(frozen=True)
class Settings:
    """What ``plans.corpus`` can be told."""

    exact_mode: str = setting("exact", lambda v: v in ("exact", "prefix"))
    prefix_len: int = setting(100, whole(1))
    simhash_threshold: int = setting(3, whole(0))
    skip_exact_dedup: bool = setting(False, lambda v: isinstance(v, bool))
    skip_clean: bool = setting(False, lambda v: isinstance(v, bool))
    skip_simhash: bool = setting(False, lambda v: isinstance(v, bool))
    cross_dedup: bool = setting(False, lambda v: isinstance(v, bool))
    variant: str = setting("nano", lambda v: v in ("nano", "lite", "pro"))
    max_chars: float | None = setting(None, lambda v: v is None or number(1)(v))
    zh_table: str | None = setting(None, lambda v: v is None or isinstance(v, str) and v != "")
    sources: list[str] | None = setting(None, lambda v: v is None or isinstance(v, list) and all(isinstance(x, str) and x for x in v))


def read(path: str | Path, seen: tuple[Path, ...] = ()) -> dict:
    """The fields of a file, over those of the file that its ``extends`` names (relative to it)."""
    here = Path(path).resolve()
    if here in seen:
        raise SettingsError(f"{here} extends itself")
    text = here.read_text(encoding="utf-8")
    if here.suffix == ".json":
        own = json.loads(text)
    else:
        import yaml

        own = yaml.safe_load(text) or {}
    if not isinstance(own, dict):
        raise SettingsError(f"{here} holds no fields")
    base = own.pop("extends", None)
    return (read(here.parent / base, (*seen, here)) if base else {}) | own


def load(path: str | Path) -> Settings:
    """The settings of a file, checked: no unknown field, every value fit for its field."""
    given = read(path)
    known = {f.name: f for f in fields(Settings)}
    wrong = [f"unknown: {k}" for k in given if k not in known]
    wrong += [f"{k} can't be {v!r}" for k, v in given.items() if k in known and not known[k].metadata["fits"](v)]
    if wrong:
        raise SettingsError("; ".join(sorted(wrong)))
    assert all(f.default is not MISSING for f in known.values())
    return Settings(**given)
