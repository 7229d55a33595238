"""Settings of a user and of a session, small JSON on the driver."""

from __future__ import annotations

from dataclasses import dataclass, replace

from darkslide.operators.evaluation import valid_thresholds
from darkslide.sources.stores import load_parameters, save_parameters


class Settings:
    """Values by key in a JSON file; an unreadable file counts as empty. Each change is written at once, whole."""

    def __init__(self, path: str):
        self.path, self.values = path, load_parameters(path)

    def get(self, key: str, default=None):
        return self.values.get(key, default)

    def set(self, key: str, value) -> bool:
        """Whether the value is another than before."""
        if key in self.values and self.values[key] == value:
            return False
        self.values[key] = value
        save_parameters(self.values, self.path)
        return True

    def set_thresholds(self, keep: float, trash: float) -> bool:
        """Store both, rounded; ValueError and no change if they do not hold."""
        keep, trash = valid_thresholds(keep, trash)
        a, b = self.set("keep_threshold", keep), self.set("trash_threshold", trash)
        return a or b

    def folder(self, asked: str | None, exists) -> str | None:
        """The folder asked for, else the last one that ``exists`` still finds; it is remembered."""
        chosen = next((f for f in (asked, self.get("last_folder")) if f and exists(f)), None)
        if chosen:
            self.set("last_folder", chosen)
        return chosen


@dataclass(frozen=True)
class Criteria:
    """The filters of a view."""

    rating: int | None = None
    tag: str | None = None
    date: str | None = None
    hide_manual: bool = False

    def changed(self, **values) -> tuple[Criteria, bool]:
        """Criteria with all of ``values`` set at once, and whether any is another than before."""
        new = replace(self, **values)
        return new, new != self
