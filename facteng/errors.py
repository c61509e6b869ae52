"""Problems of programs and inputs, each with a stable code."""

from __future__ import annotations

import json


class ProgramError(Exception):
    """A program that cannot be evaluated. code names the kind of problem."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message

    def to_json(self) -> str:
        return json.dumps({"code": self.code, "severity": "error", "message": self.message}, sort_keys=True)


class Warning_(ProgramError):
    """Something legal that is probably not meant."""

    def to_json(self) -> str:
        return json.dumps({"code": self.code, "severity": "warning", "message": self.message}, sort_keys=True)
