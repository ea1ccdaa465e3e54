"""Things that a caller may name: one catalogue for detectors, one for corruptions."""

from __future__ import annotations

import pkgutil
from collections.abc import Callable


class Catalogue:
    """Things by name, whatever its case; `fits` tells what may be kept here.

    A thing may be given as module:attribute, which is imported when it is first wanted.
    """

    def __init__(self, noun: str, fits: Callable[[object], bool]):
        self.noun, self.fits = noun, fits
        self.rows: dict[str, tuple[object, str]] = {}
        self.other_names: dict[str, str] = {}

    def add(self, names: str, thing: object, note: str = "") -> None:
        """names: the name, and others for it behind blanks. A name can't come to mean another thing."""
        name, *others = names.lower().split()
        held, said = self.rows.get(name, (thing, ""))
        if held != thing:
            raise ValueError(f"{name} is a {self.noun} already")
        self.rows[name] = thing, note or said
        self.other_names = dict.fromkeys(others, name) | self.other_names

    def notes(self) -> dict[str, str]:
        return {name: self.rows[name][1] for name in sorted(self.rows)}

    def find(self, name: str) -> object:
        asked = str(name).strip()
        short = self.other_names.get(asked.lower(), asked.lower())
        thing = self.rows[short][0] if short in self.rows else asked
        if isinstance(thing, str):
            if ":" not in thing:
                raise KeyError(f"{thing!r} is no {self.noun}: known are {', '.join(sorted(self.rows))}")
            thing = pkgutil.resolve_name(thing)
        if not self.fits(thing):
            raise TypeError(f"{thing!r} can't be used as a {self.noun}")
        return thing
