"""Sort orders, keyset cursors and the argument parsers of the listing calls."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sort name -> (key column, key descending, tie on id descending); null keys come last.
SORTS = {
    "updated_desc": ("sort_ts", True, True),
    "updated_asc": ("sort_ts", False, False),
    "chunks_desc": ("chunk_count", True, True),
    "chunks_asc": ("chunk_count", False, True),
    "id_asc": (None, False, False),
    "id_desc": (None, True, True),
    "boost_desc": ("boost", True, True),
}
MAX_OFFSET = 50_000


def parse_sort(name: str) -> str:
    """A sort's name, also as ``field`` or ``field:dir``."""
    field, _, way = name.partition(":")
    alias = {"updated": "updated", "recency": "updated", "chunks": "chunks", "id": "id", "url": "id", "boost": "boost"}
    known = name if name in SORTS else f"{alias.get(field, field)}_{way or ('asc' if field in ('id', 'url') else 'desc')}"
    if known not in SORTS:
        raise ValueError(f"unknown sort {name!r}; one of {', '.join(SORTS)}")
    return known


def ordering(sort: str) -> list[Column]:
    key, down, tie_down = SORTS[parse_sort(sort)]
    tie = F.col("id").desc() if tie_down else F.col("id").asc()
    if key is None:
        return [tie]
    return [F.col(key).desc_nulls_last() if down else F.col(key).asc_nulls_last(), tie]


@dataclass(frozen=True)
class Cursor:
    """The last row of a page: its sort, key (None: null) and id."""

    sort: str
    key: str | int | None
    id: str

    def encode(self) -> str:
        raw = json.dumps({"s": self.sort, "k": self.key, "n": self.key is None, "i": self.id}).encode()
        return base64.urlsafe_b64encode(raw).decode().rstrip("=")

    @classmethod
    def decode(cls, text: str, sort: str) -> Cursor:
        try:
            raw = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
            found = cls(raw["s"], None if raw["n"] else raw["k"], raw["i"])
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("not a cursor") from e
        if found.sort != sort:
            raise ValueError(f"the cursor is of sort {found.sort}, not {sort}")
        if not found.id or (SORTS[sort][0] and not raw["n"] and found.key is None):
            raise ValueError("the cursor lacks a key")
        return found


def after(cursor: Cursor) -> Column:
    """Rows that follow the cursor; the rows with a null key are a region of their own at the end."""
    key, down, tie_down = SORTS[cursor.sort]
    past_id = F.col("id") < cursor.id if tie_down else F.col("id") > cursor.id
    if key is None:
        return past_id
    if cursor.key is None:
        return F.col(key).isNull() & past_id
    value = F.lit(cursor.key).cast("timestamp") if key == "sort_ts" else F.lit(cursor.key)
    past_key = F.col(key) < value if down else F.col(key) > value
    return past_key | ((F.col(key) == value) & past_id) | F.col(key).isNull()


def offset_of(page: int, size: int) -> int:
    """Rows before a page; deep offsets are refused, cursors go further."""
    at = (max(page, 1) - 1) * max(size, 1)
    if at + size > MAX_OFFSET:
        raise ValueError(f"offset beyond {MAX_OFFSET}; use a cursor")
    return at


def clamp(limit: int | None, default: int, most: int) -> int:
    return max(1, min(limit or default, most))


def parse_when(text: str, now: datetime) -> datetime:
    """``3d``, ``12h ago``, a date or an ISO time."""
    if m := re.fullmatch(r"(\d+)\s*([smhdw])(\s+ago)?", text.strip()):
        unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2]]
        return now - timedelta(**{unit: int(m[1])})
    return datetime.fromisoformat(text.strip())


def parse_chunk_range(text: str) -> tuple[int | None, int | None]:
    """``MIN..MAX`` with either end open; a number alone is exact."""
    if ".." not in text:
        return int(text), int(text)
    low, _, high = text.partition("..")
    found = (int(low) if low else None, int(high) if high else None)
    if None not in found and found[0] > found[1]:
        raise ValueError(f"inverted range {text}")
    return found


def parse_states(text: str, open_states: tuple[str, ...], known: tuple[str, ...]) -> tuple[str, ...]:
    """``open``, ``all`` or a comma-separated list of states."""
    if text in ("", "open"):
        return open_states
    if text == "all":
        return known
    found = tuple(x.strip() for x in text.split(",") if x.strip())
    if bad := [x for x in found if x not in known]:
        raise ValueError(f"unknown states {bad}")
    return found
