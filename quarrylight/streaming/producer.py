"""Where change events come from: a repository that is looked at again and again.

Changes are held until the tree has been quiet for a while; then one file of
events is written, which the watcher's stream takes as one flush.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import uuid
from collections.abc import Callable

from quarrylight.sources import files as sources
from quarrylight.sources.extract import language_of

DEBOUNCE_SECONDS = 0.5


def snapshot(root: str) -> dict[str, tuple[int, int]]:
    """path -> (time of change, size) of the files of known languages."""
    out = {}
    for path in sources.tracked_paths(root):
        if language_of(path):
            try:
                state = os.stat(os.path.join(root, path))
            except OSError:
                continue
            out[path] = (state.st_mtime_ns, state.st_size)
    return out


class Producer:
    """Compares snapshots and writes events once there is quiet."""

    def __init__(self, root: str, folder: str, debounce: float = DEBOUNCE_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.root, self.folder, self.debounce, self.clock = root, folder, debounce, clock
        os.makedirs(folder, exist_ok=True)
        self.known = snapshot(root)
        self.pending: dict[str, str] = {}
        self.last = 0.0

    def look(self) -> int:
        """One look; returns how many events it has written. Any change starts
        the quiet time again, for all that is pending."""
        now = snapshot(self.root)
        seen = {p: "created" if p not in self.known else "modified" for p, s in now.items() if self.known.get(p) != s}
        seen |= dict.fromkeys(self.known.keys() - now.keys(), "deleted")
        self.known = now
        if seen:
            self.pending |= seen
            self.last = self.clock()
        if not self.pending or self.clock() - self.last < self.debounce:
            return 0
        stamp = dt.datetime.now(dt.timezone.utc).isoformat()
        rows = [json.dumps({"ts": stamp, "path": p, "kind": k, "is_directory": False}) for p, k in sorted(self.pending.items())]
        name = uuid.uuid4().hex
        hidden, shown = (os.path.join(self.folder, f) for f in (f".{name}", f"{name}.json"))
        with open(hidden, "w", encoding="utf-8") as f:
            f.write("\n".join(rows) + "\n")
        os.replace(hidden, shown)
        self.pending = {}
        return len(rows)

    def run(self, stopped: Callable[[], bool], pause: float = 0.2) -> None:
        while not stopped():
            self.look()
            time.sleep(pause)
