"""The watcher as a process: its number, its state and how to end it."""

from __future__ import annotations

import json
import logging
import os
import signal
import time
from logging.handlers import RotatingFileHandler

PID, STATE, LOG = "watch.pid", "watch-state.json", "watch.log"
LOG_BYTES, LOG_KEPT = 5 << 20, 3


def read_pid(folder: str) -> int | None:
    """The watcher's process number; None without a readable one."""
    try:
        with open(os.path.join(folder, PID), encoding="utf-8") as f:
            return int(f.read().strip())
    except (OSError, ValueError):
        return None


def alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
        return True
    except PermissionError:
        return True
    except OSError:
        return False


def write(folder: str, name: str, text: str) -> None:
    os.makedirs(folder, exist_ok=True)
    temporary = os.path.join(folder, f".{name}.{os.getpid()}")
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temporary, os.path.join(folder, name))


def begin(folder: str) -> None:
    """Notes this process as the watcher; another live one is an error."""
    other = read_pid(folder)
    if other and other != os.getpid() and alive(other):
        raise RuntimeError(f"a watcher is running already (process {other})")
    write(folder, PID, str(os.getpid()))


def end(folder: str) -> None:
    try:
        os.remove(os.path.join(folder, PID))
    except FileNotFoundError:
        pass


def save(folder: str, state: dict) -> None:
    write(folder, STATE, json.dumps(state, default=str))


def load(folder: str) -> dict:
    try:
        with open(os.path.join(folder, STATE), encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def log_to(folder: str) -> logging.Handler:
    """Messages of the package go to a file of the folder from now on; a file of
    LOG_BYTES is moved aside, and LOG_KEPT of these stay."""
    os.makedirs(folder, exist_ok=True)
    handler = RotatingFileHandler(os.path.join(folder, LOG), maxBytes=LOG_BYTES, backupCount=LOG_KEPT, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    root = logging.getLogger("quarrylight")
    root.addHandler(handler)
    root.setLevel(logging.INFO)
    return handler


def stop(folder: str, patience: float = 10.0) -> str:
    """Asks the watcher to end and waits for it; one that hangs is killed."""
    pid = read_pid(folder)
    if pid is None:
        return "The watcher is not running."
    if not alive(pid):
        end(folder)
        return "The watcher had ended already; its file is removed."
    said = "The watcher has ended."
    for number in (signal.SIGTERM, signal.SIGKILL):
        os.kill(pid, number)
        until = time.monotonic() + patience
        while alive(pid) and time.monotonic() < until:
            time.sleep(0.05)
        if not alive(pid):
            end(folder)
            return said
        said = "The watcher did not end and was killed."
    raise RuntimeError(f"the watcher (process {pid}) does not end")


def status(folder: str) -> dict:
    """Whether it runs, and what it has counted."""
    pid = read_pid(folder)
    running = bool(pid and alive(pid))
    if pid and not running:
        end(folder)
    return {"running": running, "pid": pid if running else None, **load(folder)}
