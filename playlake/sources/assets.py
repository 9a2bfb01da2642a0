"""Files that aren't part of the repository: found below a folder that a variable names, or a default one."""

from __future__ import annotations

import os
from pathlib import Path


def asset_folder(variable: str, default: str | Path) -> Path:
    """The folder that an environment variable names, if it is set and not blank, else the default."""
    named = os.environ.get(variable, "").strip()
    return Path(named) if named else Path(default)


def find_asset(name: str, variable: str, default: str | Path) -> Path | None:
    """The file, or None where it is missing. Names don't lead out of the folder."""
    folder = asset_folder(variable, default).resolve()
    path = (folder / name).resolve()
    return path if path.is_file() and path.is_relative_to(folder) else None


def need_asset(name: str, variable: str, default: str | Path) -> Path:
    """The file; raises where it is missing, and says where it was sought."""
    path = find_asset(name, variable, default)
    if path is None:
        raise FileNotFoundError(skip_reason(name, variable, default))
    return path


def skip_reason(name: str, variable: str, default: str | Path) -> str | None:
    """Why something that needs the file can't run; None if it can."""
    if find_asset(name, variable, default) is not None:
        return None
    return f"{name} is missing below {asset_folder(variable, default)}, which {variable} can replace"
