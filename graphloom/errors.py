"""Errors of the engine, each with the status and code that an outer service would answer with."""

from __future__ import annotations


class EngineError(Exception):
    status, code = 500, "internal_error"

    def body(self) -> dict:
        return {"error": self.code, "message": str(self)}


class NotFound(EngineError):
    status, code = 404, "not_found"


class InvalidRequest(EngineError, ValueError):
    status, code = 400, "invalid_request"


class Conflict(EngineError):
    status, code = 409, "conflict"


class TooLarge(EngineError):
    status, code = 413, "payload_too_large"


class StoreFailed(EngineError):
    status, code = 500, "database_error"


class ProviderFailed(EngineError):
    status, code = 502, "provider_error"


class Unavailable(EngineError):
    status, code = 503, "unavailable"
