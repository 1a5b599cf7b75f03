"""Unpacking of a release archive with reference files."""

from __future__ import annotations

import tarfile
import urllib.request
from pathlib import Path, PurePosixPath


def unpack(archive: str, folder: str, version: str, force: bool = False) -> bool:
    """Unpack without the top folder and without `._*` files; False if that version is there already."""
    marker = Path(folder, ".version")
    if not force and marker.exists() and marker.read_text().strip() == version:
        return False
    root = Path(folder).resolve()
    root.mkdir(parents=True, exist_ok=True)
    with tarfile.open(archive) as tar:
        for member in tar:
            parts = PurePosixPath(member.name).parts[1:]
            if not parts or parts[-1].startswith("._") or not (member.isfile() or member.isdir()):
                continue
            target = root.joinpath(*parts).resolve()
            if root not in target.parents:
                raise ValueError(f"outside the folder: {member.name}")
            if member.isdir():
                target.mkdir(parents=True, exist_ok=True)
                continue
            target.parent.mkdir(parents=True, exist_ok=True)
            with tar.extractfile(member) as source:
                target.write_bytes(source.read())
    marker.write_text(version + "\n")
    return True


def fetch(url: str, folder: str, version: str, force: bool = False) -> bool:
    """Download an archive and unpack it."""
    name, _ = urllib.request.urlretrieve(url)  # noqa: S310
    return unpack(name, folder, version, force)
