"""What the operators that run Python share: batch bounds, memos, pre-tokenisation."""

from __future__ import annotations

import gc
import re

import regex

#: Fixed value: the splitting pattern of the public byte-level BPE vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Bounded(dict):
    """A memo of a pure function that is emptied when it holds ``limit`` keys."""

    def __init__(self, function, limit: int):
        super().__init__()
        self._function, self._limit = function, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        value = self[key] = self._function(key)
        return value


_resident: dict = {}


def resident(key, build):
    """What a Python worker keeps between batches: the state of the last operator only.

    Workers outlive stages; without this the tables of one operator would stay in memory
    under the next one's.
    """
    if key not in _resident:
        _resident.clear()
        gc.collect()
        _resident[key] = build()
    return _resident[key]


#: What the classes of the pattern mean in a text of Latin-1 characters alone.
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", " \\t-\\r\u0085\u00a0"
_LATIN = (("[^\\s\\p{L}\\p{N}]", f"[^{_SPACES}{_LETTERS}{_NUMBERS}]"), ("\\p{L}", f"[{_LETTERS}]"), ("\\p{N}", f"[{_NUMBERS}]"), ("\\s", f"[{_SPACES}]"), ("\\S", f"[^{_SPACES}]"))


def splitter(pattern: str):
    """``text -> list of pieces``; every piece is encoded on its own.

    Texts of Latin-1 characters take narrower classes, which match the same there.
    """
    narrow = pattern
    for wide, latin in _LATIN:
        narrow = narrow.replace(wide, latin)
    everywhere, plain = regex.compile(pattern).findall, None if "\\" in narrow.replace("\\t-\\r", "") else re.compile(narrow).findall

    def split(text: str) -> list[str]:
        if plain:
            try:
                text.isascii() or text.encode("latin-1")
                return plain(text)
            except UnicodeEncodeError:
                pass
        return everywhere(text)

    return split


def bound_batches(spark, rows: int = 1000, size: int = 8 << 20) -> None:
    """Hold the session's Arrow batches to sizes that a Python worker can take apart.

    The settings are read when a plan is run, long after an operator has returned, so they
    stay with the session. They are only ever lowered: an unlimited one gets the bound, a
    smaller one of the caller's stays.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        set_to = spark.conf.get(name)
        held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(set_to)
        if not 0 < held <= most:
            spark.conf.set(name, str(most))
