"""Project files that steer import resolution: pyproject, tsconfig and go.mod; and the engine's own configuration."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field


@dataclass
class Config:
    """What a configuration file may set; unknown keys are errors."""

    roots: list[str] = field(default_factory=lambda: ["."])
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    docs: list[str] = field(default_factory=list)
    data_dir: str = ".sparkloom"
    embedding: str = "hash"
    dimensions: int = 64
    history: bool = True
    most_commits: int = 1000
    python_backend: str = "auto"
    import_aliases: dict[str, str] = field(default_factory=dict)
    include_self: bool = False
    importer_excludes: tuple[str, ...] = (".md", ".txt", ".rst")
    poll_ms: int = 750
    debounce_ms: int = 250

    def __post_init__(self):
        if self.dimensions < 1 or self.most_commits < 1:
            raise ValueError("dimensions and most_commits must be positive")
        if self.python_backend not in {"auto", "static", "off"}:
            raise ValueError("python_backend is auto, static or off")
        self.poll_ms, self.debounce_ms = max(50, self.poll_ms), max(25, self.debounce_ms)


NAMES = ("sparkloom.json", ".sparkloom.json")


def load_config(folder: str) -> Config:
    """The first configuration file in a folder, over the defaults; relative roots are taken from the folder."""
    for name in NAMES:
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path) as f:
                given = json.load(f)
            break
    else:
        given = {}
    unknown = given.keys() - Config.__dataclass_fields__.keys()
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    config = Config(**given)
    config.roots = [os.path.normpath(os.path.join(folder, r)) for r in config.roots]
    config.data_dir = os.path.normpath(os.path.join(folder, config.data_dir))
    return config


def read_pyproject(text: str) -> dict:
    """name, dependencies (bare names), package includes and import aliases of a pyproject file; empty for one that can't be read."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {"name": "", "dependencies": [], "include": [], "aliases": {}}
    project, tool = data.get("project", {}), data.get("tool", {})
    own = tool.get("sparkloom", {})
    aliases = own.get("import-aliases") or own.get("import_aliases") or own.get("importAliases") or {}
    names = [m[0] for d in project.get("dependencies", []) if (m := re.match(r"[A-Za-z0-9._-]+", d))]
    return {"name": project.get("name", ""), "dependencies": names, "include": tool.get("setuptools", {}).get("packages", {}).get("find", {}).get("include", []), "aliases": dict(aliases)}


def read_jsonc(text: str) -> dict:
    """JSON with comments and trailing commas."""
    out, i = [], 0
    while i < len(text):
        if text[i] == '"':
            m = re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match(text, i)
            stop = m.end() if m else len(text)
            out.append(text[i:stop])
            i = stop
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif text.startswith("/*", i):
            i = text.find("*/", i) + 2 if "*/" in text[i:] else len(text)
        else:
            out.append(text[i])
            i += 1
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", "".join(out)) or "{}")
