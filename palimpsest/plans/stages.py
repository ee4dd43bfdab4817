"""A pipeline's stages one after the other: what happened in each, how long it took, and how it ended."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

#: The stages of a whole run in order.
STAGES = ("update", "run", "apply", "build")


@dataclass
class Outcome:
    """Events (stage, kind, detail), milliseconds by stage, and results of the stages that ended."""

    events: list[tuple[str, str, str]] = field(default_factory=list)
    profile: dict[str, int] = field(default_factory=dict)
    results: dict[str, object] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return bool(self.status) and all(s == "ok" for s in self.status.values())


def run(stages: list[tuple[str, Callable[[dict[str, object]], object]]], partial: Callable[[str, object], str | None] = lambda stage, result: None, listen: Callable[[tuple[str, str, str]], None] = lambda event: None, stopped: Callable[[], bool] = lambda: False) -> Outcome:
    """Run the stages in order; each gets the results so far.

    A stage that raises fails, and those after it are skipped. ``partial`` may say why a result isn't a
    whole one; later stages run all the same. When ``stopped`` turns true no further stage begins. Times
    are kept of failed stages too.
    """
    out = Outcome()

    def tell(stage: str, kind: str, detail: str = "") -> None:
        out.events.append((stage, kind, detail))
        listen(out.events[-1])

    for name, work in stages:
        if stopped() or any(s == "failed" for s in out.status.values()):
            out.status[name] = "skipped"
            tell(name, "skipped")
            continue
        tell(name, "started")
        began = time.monotonic()
        try:
            out.results[name] = work(out.results)
        except Exception as problem:  # noqa: BLE001 - a stage's failure is its outcome
            out.status[name] = "failed"
            tell(name, "failed", str(problem))
        else:
            why = partial(name, out.results[name])
            out.status[name] = "partial" if why else "ok"
            tell(name, out.status[name], why or "")
        finally:
            out.profile[name] = round((time.monotonic() - began) * 1000)
    return out
