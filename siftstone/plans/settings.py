"""Settings: what is read, kept and shown, as a file says it, with presets and limits by the size of the machine."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

MIB, GIB = 1 << 20, 1 << 30
#: A machine with less memory keeps indexes small
LOW_MEMORY = 6 * GIB


@dataclass(frozen=True)
class Defaults:
    content: bool = True
    metadata: bool = False
    names_only: bool = False
    content_index_mode: str = "auto"
    extract_max_mb: int = 0
    text_max_mb: int = 0
    office_max_mb: int = 0
    pdf_max_mb: int = 0
    pdf_timeout_secs: int = 5
    content_cooldown_secs: int = 900
    follow_symlinks: bool = False
    symlink_policy: str = "personal-local"


@dataclass(frozen=True)
class Origin:
    enabled: bool = True
    browser_history: bool = False


@dataclass(frozen=True)
class History:
    enabled: bool = True
    keep_versions: int = 10
    keep_days: int = 30
    max_total_gib: int = 0
    skip_git_repositories: bool = True
    respect_gitignore: bool = True


@dataclass(frozen=True)
class Settings:
    defaults: Defaults = field(default_factory=Defaults)
    origin: Origin = field(default_factory=Origin)
    history: History = field(default_factory=History)
    sources: tuple[dict[str, Any], ...] = ()


#: What each preset sets (fixed values)
PRESETS: dict[str, dict[str, Any]] = {
    "names-only": {"names_only": True, "content": False, "metadata": False, "content_index_mode": "basic", "extract_max_mb": 0},
    "low-memory": {"names_only": False, "content": True, "metadata": True, "content_index_mode": "basic", "extract_max_mb": 4, "text_max_mb": 0, "office_max_mb": 64, "pdf_max_mb": 0, "pdf_timeout_secs": 5},
    "balanced": {"names_only": False, "content": True, "metadata": True, "content_index_mode": "auto", "extract_max_mb": 0, "text_max_mb": 0, "office_max_mb": 0, "pdf_max_mb": 0, "pdf_timeout_secs": 5},
    "complete": {"names_only": False, "content": True, "metadata": True, "content_index_mode": "freqs", "extract_max_mb": 32, "text_max_mb": 0, "office_max_mb": 512, "pdf_max_mb": 0, "pdf_timeout_secs": 10},
}
#: Other names of presets (fixed values)
ALIASES = {"name-only": "names-only", "lowmem": "low-memory", "auto": "balanced", "full": "complete"}
#: The keys by which presets differ from each other
TELLING = ("names_only", "content", "content_index_mode", "extract_max_mb")


def with_preset(settings: Settings, name: str) -> Settings:
    """KeyError for a preset that isn't there."""
    return replace(settings, defaults=replace(settings.defaults, **PRESETS[ALIASES.get(name, name)]))


def preset_of(settings: Settings) -> str | None:
    """The preset that the settings are by the keys that tell presets apart; null for a mixture of one's own."""
    own = {k: getattr(settings.defaults, k) for k in TELLING}
    return next((name for name, values in PRESETS.items() if all(values[k] == v for k, v in own.items())), None)


def _table(kind: type, said: Any) -> Any:
    """ValueError for a value of another type; keys that mean nothing here are passed over."""
    if not isinstance(said, dict):
        raise ValueError(f"{kind.__name__.lower()} is no table")
    blank = kind()
    known = {f.name: type(getattr(blank, f.name)) for f in fields(kind)}
    for k, v in said.items():
        if k in known and type(v) is not known[k]:
            raise ValueError(f"{k} should be of type {known[k].__name__}")
    return kind(**{k: v for k, v in said.items() if k in known})


def _source(said: Any) -> dict[str, Any]:
    if not isinstance(said, dict) or not isinstance(said.get("path"), str):
        raise ValueError("a source needs a path")
    return said


def parse(text: str) -> Settings:
    """ValueError, with what is wrong, for a text that isn't as it should be."""
    said = tomllib.loads(text)
    rows = said.get("source", [])
    if not isinstance(rows, list):
        raise ValueError("source is no list of tables")
    return Settings(_table(Defaults, said.get("defaults", {})), _table(Origin, said.get("origin", {})), _table(History, said.get("history", {})), tuple(_source(x) for x in rows))


def read(text: str | None) -> Settings:
    """Settings of a file's text; null if there is none, which is the defaults.

    Of a malformed text each table that is right by itself counts. What it would say about the rest is not known, so
    nothing that records something of the person is on.
    """
    if text is None:
        return Settings()
    try:
        return parse(text)
    except ValueError:
        pass
    out = Settings(origin=Origin(enabled=False), history=History(enabled=False))
    try:
        said = tomllib.loads(text)
    except ValueError:
        return out
    for name, kind in (("defaults", Defaults), ("origin", Origin), ("history", History)):
        try:
            if name in said:
                out = replace(out, **{name: _table(kind, said[name])})
        except ValueError:
            continue
    rows = said.get("source", [])
    good = []
    for row in rows if isinstance(rows, list) else []:
        try:
            good.append(_source(row))
        except ValueError:
            continue
    return replace(out, sources=tuple(good))


def _literal(v: Any) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    return str(v)


def write(settings: Settings) -> str:
    """The text that read() understands as these settings."""
    out = []
    for name in ("defaults", "origin", "history"):
        out.append(f"[{name}]")
        out += [f"{k} = {_literal(v)}" for k, v in asdict(getattr(settings, name)).items()]
    for row in settings.sources:
        out.append("[[source]]")
        out += [f"{k} = {_literal(v)}" for k, v in row.items()]
    return "\n".join(out) + "\n"


@dataclass(frozen=True)
class Caps:
    """Bytes: of text kept of a file, and of files of each sort that are read at all (0: any size)."""

    extract: int
    text: int
    office: int
    pdf: int
    pdf_seconds: int
    pdf_memory: int


def caps(defaults: Defaults, memory: int | None) -> Caps:
    """memory: bytes of the machine, null if that isn't known."""
    low = memory is None or memory < LOW_MEMORY
    steps = ((3 * GIB, 4), (6 * GIB, 8), (12 * GIB, 16))
    by_memory = 8 if memory is None else next((mb for below, mb in steps if memory < below), 32)
    extract = min(max(defaults.extract_max_mb or by_memory, 1), 128)
    office = defaults.office_max_mb or (64 if low else 256)
    return Caps(extract * MIB, defaults.text_max_mb * MIB, office * MIB, defaults.pdf_max_mb * MIB, max(defaults.pdf_timeout_secs, 1), (384 if low else 768) * MIB)


def counts_occurrences(defaults: Defaults, memory: int | None) -> bool:
    """Whether the content index counts occurrences (tf); auto does on machines with the memory for it."""
    mode = defaults.content_index_mode
    return mode == "freqs" or (mode == "auto" and memory is not None and memory >= LOW_MEMORY)
