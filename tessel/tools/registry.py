"""The project registry (driver-side JSON) and the routing of files to projects."""

from __future__ import annotations

import json
import os
import time


class Registry:
    """Named projects with their roots; the file is replaced atomically."""

    def __init__(self, path: str):
        self.path = path

    def _load(self) -> dict:
        if not os.path.exists(self.path):
            return {"projects": {}, "active": None}
        with open(self.path) as f:
            return json.load(f)

    def _save(self, data: dict) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(f"{self.path}.new", "w") as f:
            json.dump(data, f, indent=1)
        os.replace(f"{self.path}.new", self.path)

    def add(self, name: str, roots: list[str], folder: str) -> dict:
        data = self._load()
        old = data["projects"].get(name, {})
        data["projects"][name] = {"roots": [os.path.abspath(r) for r in roots], "folder": folder, "created_at": old.get("created_at", time.time()), "last_indexed": old.get("last_indexed")}
        self._save(data)
        return data["projects"][name]

    def remove(self, name: str) -> bool:
        data = self._load()
        found = data["projects"].pop(name, None) is not None
        if data["active"] == name:
            data["active"] = None
        self._save(data)
        return found

    def get(self, name: str) -> dict | None:
        return self._load()["projects"].get(name)

    def list(self) -> dict:
        return self._load()["projects"]

    def set_active(self, name: str) -> None:
        data = self._load()
        if name not in data["projects"]:
            raise KeyError(name)
        data["active"] = name
        self._save(data)

    def active(self) -> str | None:
        return self._load()["active"]

    def indexed(self, name: str) -> None:
        data = self._load()
        data["projects"][name]["last_indexed"] = time.time()
        self._save(data)

    def find_by_path(self, path: str) -> str | None:
        """The project with the longest root above the path."""
        path = os.path.abspath(path)
        hits = [(len(r), n) for n, p in self.list().items() for r in p["roots"] if path == r or path.startswith(r.rstrip("/") + "/")]
        return max(hits)[1] if hits else None

    def route(self, name: str | None = None, file_hint: str | None = None) -> str:
        """Explicit name, else the hint's project, else the only one."""
        if name:
            if self.get(name) is None:
                raise KeyError(name)
            return name
        if file_hint and (found := self.find_by_path(file_hint)):
            return found
        if len(names := list(self.list())) == 1:
            return names[0]
        raise ValueError("several projects: name one")
