"""Generated ids: 36 upper-case hex digits that sort by time of creation."""

from __future__ import annotations

import secrets
import threading
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: seconds from 1900 to 1970, from which universal time counts.
UNIVERSAL_TIME = 2_208_988_800

_lock = threading.Lock()
_last = [0, 0]


def make_key_id() -> str:
    """12 digits of the second, 8 of the place within it, 16 of chance. Increasing within a process."""
    with _lock:
        second = max(int(time.time()) + UNIVERSAL_TIME, _last[0])
        _last[:] = [second, _last[1] + 1 if second == _last[0] else 0]
        return f"{second:012X}{_last[1]:08X}{secrets.randbits(64):016X}"


def generated_id(ordinal: Column | None = None) -> Column:
    """An id per row: the second of the query, the low digits of the row's ordinal, chance. Not repeatable: write the rows before using them twice."""
    place = F.monotonically_increasing_id() if ordinal is None else ordinal
    second = F.unix_timestamp() + UNIVERSAL_TIME
    return F.concat(F.lpad(F.hex(second), 12, "0"), F.lpad(F.hex(F.pmod(place, F.lit(1 << 32))), 8, "0"), F.upper(F.substring(F.replace(F.uuid(), F.lit("-")), 1, 16)))
