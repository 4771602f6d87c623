"""Settings from a ``.env`` file and the environment."""

from __future__ import annotations

import os
import shlex
from collections.abc import Mapping
from pathlib import Path


def read_env(path: str) -> dict[str, str]:
    """``KEY=value`` lines; comments, ``export`` and quotes are understood. A missing file gives nothing."""
    found: dict[str, str] = {}
    file = Path(path)
    for line in file.read_text(encoding="utf-8").splitlines() if file.exists() else []:
        words = shlex.split(line, comments=True)
        for word in words[1:] if words[:1] == ["export"] else words[:1]:
            name, eq, value = word.partition("=")
            if eq and name.isidentifier():
                found[name] = value
    return found


def settings(path: str = ".env", environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """The file's settings under those of the environment."""
    return read_env(path) | dict(os.environ if environ is None else environ)


def linkage_settings(values: Mapping[str, str]) -> dict:
    """What a linkage job needs: both parties, the shared folder, and whether data come encrypted."""
    missing = [k for k in ("PARTY_1", "PARTY_2") if not values.get(k)]
    if missing:
        raise ValueError(f"settings are missing: {missing}")
    return {"parties": (values["PARTY_1"], values["PARTY_2"]), "folder": values.get("DATA_DIR", "."), "production": values.get("PRODUCTION", "0") not in ("", "0", "false", "False"), "private_key": values.get("PRIVATE_KEY_FILE")}
