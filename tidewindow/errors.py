"""Result codes, warnings and exceptions of the engine."""

from __future__ import annotations

from enum import IntEnum


class Code(IntEnum):
    OK = 0
    RANGE_TRUNCATED = 1
    PARTIAL_RESULT = 2
    INVALID_ARG = -1
    NOT_FOUND = -2
    DIM_MISMATCH = -3
    IO = -4
    OOM = -5
    UNSUPPORTED = -6
    CLOSED = -7
    CAPACITY = -8
    CORRUPTION = -9
    INTERNAL = -99


#: Fixed texts of the codes.
TEXTS = {c: c.name.lower().replace("_", " ") for c in Code}


def error_string(code: int) -> str:
    return TEXTS.get(code, "unknown")


def is_error(code: int) -> bool:
    return code < 0


def is_warning(code: int) -> bool:
    return code > 0


class EngineError(Exception):
    def __init__(self, code: Code, message: str = ""):
        super().__init__(f"{error_string(code)}: {message}" if message else error_string(code))
        self.code = code
