"""Structured errors: one class a category, each with a stable number. No operator returns part of a result."""

from __future__ import annotations


class FieldError(Exception):
    code = 0

    def __init__(self, message: str, **where: object):
        self.where = where
        super().__init__(f"[{self.code}] {message}" + "".join(f"; {k}={v}" for k, v in where.items()))


class InputError(FieldError):
    code = 1001


class CapabilityError(FieldError):
    code = 2001


class RankError(FieldError):
    code = 3001


class GaugeError(FieldError):
    code = 4001


class ContrastError(FieldError):
    code = 5001


class InfeasibleError(FieldError):
    code = 6001


class ConditioningError(FieldError):
    code = 7001


class MemoryLimitError(FieldError):
    code = 8001


class CancelledError(FieldError):
    code = 9001


class VersionError(FieldError):
    code = 10001
