"""Label text: ``Keyword: value`` lines, with ``;`` and ``#`` starting comments."""

from __future__ import annotations

import re
from pathlib import Path

TRUE, FALSE = frozenset("Y YES ON TRUE".split()), frozenset("N NO OFF FALSE".split())
ANGLE = re.compile(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*([NSEWnsew]?)")


def find_file(name: str, search: str = "") -> Path:
    """The file of that name, or of its last part in a folder of ``search`` (folders parted by colons or spaces)."""
    if (p := Path(name)).exists():
        return p
    for folder in re.split(r"[:\s]+", search):
        if folder and (p := Path(folder) / Path(name).name).exists():
            return p
    raise FileNotFoundError(name)


class Label:
    """Values of a label by keyword. Keywords are matched in any case and must stand before a colon at once."""

    def __init__(self, text: str):
        self.lines = [re.split(r"[;#]", x, maxsplit=1)[0] for x in text.splitlines()]

    def string(self, keyword: str, default: str | None = None) -> str | None:
        key = keyword.lower() + ":"
        for line in self.lines:
            at = line.lower().find(key)
            if at >= 0 and (at == 0 or not line[at - 1].isalnum()):
                return line[at + len(key) :].strip()
        return default

    def number(self, keyword: str, default: float | None = None) -> float | None:
        value = self.string(keyword)
        m = re.match(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", value) if value else None
        return float(m[0]) if m else default

    def whole(self, keyword: str, default: int | None = None) -> int | None:
        value = self.number(keyword)
        return default if value is None else int(value)

    def angle(self, keyword: str, default: float | None = None) -> float | None:
        """A latitude or longitude, with an N, S, E or W after it or a sign before it."""
        value = self.string(keyword)
        m = ANGLE.match(value) if value else None
        if not m:
            return default
        return -abs(float(m[1])) if m[2].upper() in ("S", "W") and m[2] else float(m[1])

    def boolean(self, keyword: str, default: bool = False) -> bool:
        value = (self.string(keyword) or "").split(" ")[0].upper()
        return True if value in TRUE else False if value in FALSE else default

    def positional(self) -> list[str]:
        """Lines of the legacy format: those with anything but a comment. Blank lines are passed over."""
        return [x.strip() for x in self.lines if x.strip()]


def numbers(line: str) -> list[float]:
    """The numbers at the start of a legacy line."""
    out = []
    for word in line.split():
        try:
            out.append(float(word))
        except ValueError:
            break
    return out
