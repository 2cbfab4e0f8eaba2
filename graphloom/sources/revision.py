"""The revision that a folder of code stands at, read from its git files on the driver (SRC23)."""

from __future__ import annotations

import re
from pathlib import Path


def without_login(url: str) -> str:
    """An address without user name and password."""
    return re.sub(r"^([a-z][a-z0-9+.-]*://)[^/@]*@", r"\1", url, flags=re.I)


def _commit(git: Path, ref: str) -> str | None:
    loose = git / ref
    if loose.is_file():
        return loose.read_text().strip()
    packed = git / "packed-refs"
    lines = packed.read_text().splitlines() if packed.is_file() else []
    return next((x.split(" ", 1)[0] for x in lines if x.endswith(f" {ref}")), None)


def revision(root: str) -> dict[str, str | None] | None:
    """branch, commit and remote of the folder, or null where it is no checkout."""
    git = Path(root) / ".git"
    if git.is_file():  # a worktree names its folder
        git = (git.parent / git.read_text().removeprefix("gitdir:").strip()).resolve()
    head = git / "HEAD"
    if not head.is_file():
        return None
    said = head.read_text().strip()
    ref = said.removeprefix("ref:").strip() if said.startswith("ref:") else None
    config = git / "config"
    remote = re.search(r'\[remote "origin"\][^\[]*?\n\s*url\s*=\s*(\S+)', config.read_text()) if config.is_file() else None
    return {"branch": ref.removeprefix("refs/heads/") if ref else None, "commit": _commit(git, ref) if ref else said, "remote": without_login(remote[1]) if remote else None}
