"""The operator's console of an engine, its saved states, periodic checkpoints and archived reports."""

from __future__ import annotations

import io
import json
import pickle
import platform
import zipfile

import numpy as np

from pelorus.operators.simulate import COMMANDS, Action, Engine, SimConfig
from pelorus.sources import files

#: What a saved state may be made of.
ALLOWED = ("pelorus.", "numpy", "collections", "builtins")
BUILTINS = {"set", "frozenset", "dict", "list", "tuple", "int", "float", "bool", "str", "bytes", "complex", "slice", "range", "object", "getattr"}


class Console:
    """Questions are answered at once; commands run before the engine's next bar."""

    def __init__(self, engine: Engine):
        self.engine, self.history = engine, []

    def positions(self) -> list[dict]:
        return [{"id": p.id, "side": p.side, "size": p.size, "entry": p.entry, "unrealized": p.unrealized, "bars": p.bars} for p in self.engine.broker.open.values()]

    def portfolio(self) -> dict:
        b = self.engine.broker
        return {"n_open": len(b.open), "net_signed": b.net_signed(), "realized": b.realized, "equity": b.equity, "drawdown": b.equity - b.high_water}

    def risk_list(self) -> list[str]:
        return list(self.engine.risk.policies)

    def _queue(self, name: str, command=None, *args) -> None:
        self.history.append(name)
        self.engine.commands.append(command or (lambda e: COMMANDS[name](e, *args)))

    def flatten(self) -> None:
        self._queue("flatten")

    def set_stop(self, position_id: int, tp: float | None = None, sl: float | None = None) -> None:
        Action("MODIFY_STOP", position_id, tp=tp, sl=sl)  # wrong ones fail at once
        self._queue("set_stop", None, position_id, tp, sl)

    def kill(self) -> None:
        self._queue("kill")

    def unkill(self) -> None:
        self._queue("unkill")

    def pause(self) -> None:
        self._queue("pause")

    def resume(self) -> None:
        self._queue("resume")

    def risk_add(self, name: str, *args) -> None:
        self._queue("risk_add", None, name, *args)

    def risk_remove(self, name: str) -> None:
        self._queue("risk_remove", None, name)

    def save(self, path: str) -> None:
        self._queue("save", lambda e: save_state(e, path))


def _versions() -> dict[str, str]:
    return {"python": platform.python_version(), "numpy": np.__version__}


def save_state(engine: Engine, path: str, digest: str | None = None) -> None:
    """The whole engine (positions, controller, forest) and a manifest, as one zip file."""
    commands, engine.commands = engine.commands, []
    try:
        blob = pickle.dumps(engine, 4)
    finally:
        engine.commands = commands
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps({"versions": _versions(), "digest": digest, "n_seen": engine.n}))
        z.writestr("engine.pickle", blob)
    files.write(path, made.getvalue())


class _Unpickler(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if not module.startswith(ALLOWED) or module == "builtins" and name not in BUILTINS:
            raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a saved state")
        return super().find_class(module, name)


def load_state(path: str, digest: str | None = None) -> Engine:
    """A saved engine; other versions or another configuration than it was saved with are an error."""
    with zipfile.ZipFile(io.BytesIO(files.read(path))) as z:
        manifest = json.loads(z.read("manifest.json"))
        if manifest["versions"] != _versions():
            raise ValueError(f"saved under {manifest['versions']}")
        if digest is not None and manifest["digest"] != digest:
            raise ValueError("saved under another configuration")
        return _Unpickler(io.BytesIO(z.read("engine.pickle"))).load()


class Checkpoints:
    """A state every `every` bars, of which the newest `keep` stay (all with keep=0)."""

    def __init__(self, folder: str, every: int = 1000, keep: int = 0, digest: str | None = None):
        self.folder, self.every, self.keep, self.digest = folder.rstrip("/"), every, keep, digest

    def after(self, engine: Engine, final: bool = False) -> str | None:
        if not final and engine.n % self.every:
            return None
        path = f"{self.folder}/checkpoint_{engine.n:08d}.zip"
        save_state(engine, path, self.digest)
        if self.keep:
            for old in [n for n in files.names(self.folder, ".zip") if n.startswith("checkpoint_")][: -self.keep]:
                files.delete(f"{self.folder}/{old}")
        return path


def resume(path: str, bars: list[dict], cfg: SimConfig | None = None) -> tuple[Engine, list[dict]]:
    """Go on with a saved engine over further bars."""
    engine = load_state(path)
    return engine, [row for b in bars for row in engine.step(b)]


def archive(report: str, archives: str, stamp: str, keep: int = 10) -> str | None:
    """Move a report's folder into the archives and leave it empty; the newest `keep` archives by name stay.

    The move is the file system's own, so tables of any size pass through no machine. None if there is no
    report; a stamp that is there already is an error. Archives that are zip files count as well.
    """
    if not files.names(report) and not files.folders(report):
        return None
    made = f"{archives}/{stamp}"
    if stamp in archived(archives):
        raise FileExistsError(made)
    files.move(report, made)
    files.make(report)
    found = archived(archives)
    for old in found[: max(0, len(found) - keep)]:
        files.delete(f"{archives}/{old}")
        files.delete(f"{archives}/{old}.zip")
    return made


def archived(archives: str) -> list[str]:
    return sorted({*files.folders(archives), *(n.removesuffix(".zip") for n in files.names(archives, ".zip"))})
