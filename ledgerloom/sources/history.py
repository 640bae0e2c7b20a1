"""Strict parser of history states. Spark's JSON reader accepts what a strict reader must reject."""

from __future__ import annotations

import json

U32 = 2**32 - 1


class Malformed(ValueError):
    pass


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Malformed("a field comes twice")
    return out


def _int(d: dict, key: str, low: int = 0, high: int = U32) -> int:
    x = d.get(key)
    if type(x) is not int or not low <= x <= high:
        raise Malformed(f"{key} is no number in its range")
    return x


def _text(d: dict, key: str, needed: bool = False) -> str | None:
    x = d.get(key)
    if x is None and not needed:
        return None
    if not isinstance(x, str):
        raise Malformed(f"{key} is no string")
    return x


def _levels(x: object, name: str) -> list[dict]:
    if not isinstance(x, list) or len(x) != 11:
        raise Malformed(f"{name} has not 11 levels")
    out = []
    for level in x:
        if not isinstance(level, dict) or not isinstance(level.get("next"), dict):
            raise Malformed(f"{name}: a level is no object")
        nxt, shadow = level["next"], level["next"].get("shadow")
        if shadow is not None and not (isinstance(shadow, list) and all(isinstance(s, str) for s in shadow)):
            raise Malformed(f"{name}: shadow is no list of strings")
        out.append({
            "curr": _text(level, "curr", True), "snap": _text(level, "snap", True),
            "next": {"state": _int(nxt, "state"), "output": _text(nxt, "output"), "curr": _text(nxt, "curr"), "snap": _text(nxt, "snap"), "shadow": shadow},
        })
    return out


def parse(data: bytes | str) -> dict:
    """A state's fields; unknown ones are ignored. Raises ``Malformed``."""

    def no_constant(name: str) -> None:
        raise Malformed(f"{name} is no JSON")

    try:
        d = json.loads(data, object_pairs_hook=_unique, parse_constant=no_constant)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
        raise Malformed(f"no JSON: {e}") from e
    if not isinstance(d, dict):
        raise Malformed("no JSON object")
    hot = d.get("hotArchiveBuckets")
    return {
        "version": _int(d, "version", -(2**31), 2**31 - 1),
        "server": _text(d, "server"),
        "currentLedger": _int(d, "currentLedger"),
        "networkPassphrase": _text(d, "networkPassphrase"),
        "currentBuckets": _levels(d.get("currentBuckets"), "currentBuckets"),
        "hotArchiveBuckets": None if hot is None else _levels(hot, "hotArchiveBuckets"),
    }
