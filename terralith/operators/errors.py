"""Typed failures: raised on the driver after a cheap aggregate."""

from __future__ import annotations


class GeoError(ValueError):
    def __init__(self, code: str, **details) -> None:
        super().__init__(f"{code} {details}" if details else code)
        self.code, self.details = code, details
