"""What can go wrong: each kind has a code, and says whether trying again unchanged can help and what to do."""

from __future__ import annotations


class EngineError(Exception):
    code, transient, advice = "LL000", False, ""

    @classmethod
    def registry(cls) -> dict[str, type[EngineError]]:
        """All kinds by code."""
        found, rest = {}, [cls]
        while rest:
            kind = rest.pop()
            found[kind.code] = kind
            rest += kind.__subclasses__()
        return dict(sorted(found.items()))


class Conflict(EngineError, RuntimeError):
    """Another writer committed first."""

    code, transient, advice = "LL001", True, "read the new version and try again"


class LeaseLost(EngineError, RuntimeError):
    """The lease isn't held by this token any more."""

    code, advice = "LL002", "drop the work: another worker does it"


class InstanceLost(EngineError, RuntimeError):
    """The worker's instance expired or was released."""

    code, advice = "LL003", "claim a new instance"


class NotFound(EngineError, KeyError):
    """There is no such topic, group, job or worker."""

    code, advice = "LL004", "register it first"


class BadRecords(EngineError, ValueError):
    """Records that can't be appended; ``seq`` is that of the first."""

    code, advice = "LL005", "mend them, or leave them out with on_bad='evict'"

    def __init__(self, seq: int | None, reason: str):
        super().__init__(f"seq {seq}: {reason}")
        self.seq, self.reason = seq, reason


class NotEmpty(EngineError, ValueError):
    """The topic still holds messages."""

    code, advice = "LL006", "force its destruction if they may go"


class NameTaken(EngineError, ValueError):
    """Another topic has this name."""

    code, advice = "LL007", "choose another name"


class Mismatch(EngineError, ValueError):
    """A registration differs from the known one in what can't change."""

    code, advice = "LL008", "register with the known values, or under a new name"
