"""The path-dependent part of a backtest: labels that mature, strategy, risk, broker, one bar at a time.

`Engine.step(bar)` is plain Python over one instrument's bars in order; batch and streaming hosts call
the same code. All that doesn't depend on the path is a column before.
"""

from __future__ import annotations

import collections
import dataclasses
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pelorus.operators.broker import Costs
from pelorus.operators.controller import ControllerConfig, State
from pelorus.operators.online import AdaptiveForest

INF = math.inf
#: Columns of the one table of outputs; kind tells which of them a row fills.
OUT = {
    "instrument": "string", "kind": "string", "ts": "long", "position_id": "long", "side": "int", "size": "double", "entry_ts": "long", "exit_ts": "long", "entry_price": "double",
    "exit_price": "double", "pnl_gross": "double", "pnl_net": "double", "reason": "string", "p": "double", "p_offline": "double", "y": "int", "regime": "int", "tau": "double", "r_hat": "double",
    "r_star": "double", "paused": "boolean", "sigma_ve": "double", "n_open": "int", "n_actions": "int", "equity": "double", "drawdown": "double", "mae": "double", "mfe": "double",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in OUT.items())


@dataclasses.dataclass(frozen=True)
class Action:
    """HOLD, OPEN, SCALE_IN, SCALE_OUT, CLOSE, MODIFY_STOP or CANCEL."""

    kind: str
    position_id: int | None = None
    side: int = 1
    size: float = 1.0
    tp: float | None = None
    sl: float | None = None

    def __post_init__(self):
        if self.kind == "MODIFY_STOP" and self.tp is None and self.sl is None:
            raise ValueError("MODIFY_STOP needs a target or a stop")
        if self.kind in ("OPEN", "SCALE_IN", "SCALE_OUT") and not 0 <= self.size <= 1:
            raise ValueError("a size is between 0 and 1")


@dataclasses.dataclass
class Position:
    id: int
    side: int
    open_size: float
    size: float
    entry: float
    open_ts: int
    tp: float
    sl: float
    bars: int = 0
    mark: float = 0.0
    unrealized: float = 0.0
    mae: float = 0.0
    mfe: float = 0.0

    def marked(self, price: float) -> None:
        self.mark = price
        self.unrealized = self.side * math.log(price / self.entry) * self.size
        self.mae, self.mfe = min(self.mae, self.unrealized), max(self.mfe, self.unrealized)

    def add(self, size: float, price: float) -> None:
        self.entry = (self.entry * self.size + price * size) / (self.size + size)
        self.size += size


@dataclasses.dataclass(frozen=True)
class SimConfig:
    m_minutes: int = 20
    warmup: int = 0
    alpha_label: float = 0.0041113
    tp: float = 0.0041
    sl: float = INF
    latency: int = 1
    inventory_cap: int = 1
    tie: str = "pessimistic"
    costs: Costs = Costs()
    safety_bars: int = 10_000
    sweep_margin: float = 0.1
    strategy: str = "threshold_gate"
    params: tuple[tuple[str, object], ...] = ()
    policies: tuple[tuple[str, tuple], ...] = (("max_positions", (5,)), ("max_drawdown", (-0.2,)), ("max_loss", (0.05,)))
    features: tuple[str, ...] = ()
    learn: bool = False
    seed: int = 42
    p_column: str = "p"


class ThresholdGate:
    """Open size 1 when nothing is open and p reaches tau."""

    def __init__(self, tau: float = 0.5):
        self.tau = tau

    def decide(self, bar: dict, broker: SimBroker) -> list[Action]:
        return [Action("OPEN")] if not broker.open and bar["p"] is not None and bar["p"] >= self.tau else []


class EvCalibratedSize(ThresholdGate):
    """Size by the margin over tau."""

    def __init__(self, tau: float = 0.5, k: float = 5.0):
        super().__init__(tau)
        self.k = k

    def decide(self, bar, broker):
        margin = (bar["p"] or 0.0) - self.tau
        return [Action("OPEN", size=min(1.0, self.k * margin))] if not broker.open and margin > 0 else []


class RegimeGated:
    """Opens and scale-ins of another strategy only in allowed regimes."""

    def __init__(self, base: str = "threshold_gate", allowed: tuple[int, ...] = (), **params):
        self.base, self.allowed = STRATEGIES[base](**params), set(allowed)

    def decide(self, bar, broker):
        actions = self.base.decide(bar, broker)
        return actions if bar.get("regime") in self.allowed else [a for a in actions if a.kind not in ("OPEN", "SCALE_IN")]


class CompositeAdaptive:
    """Entries by an adaptive threshold; positions close after t_max bars."""

    def __init__(self, t_max: int = 4, signal: str = "p", **controller):
        self.cfg, self.t_max, self.signal = ControllerConfig(**controller), t_max, signal
        self.state = State(self.cfg.tau0, self.cfg.r0, self.cfg.r0)
        self.entered, self.label = False, None

    tau = property(lambda self: self.state.tau)
    r_hat = property(lambda self: self.state.r_hat)
    r_star = property(lambda self: self.state.r_star)
    paused = property(lambda self: self.state.paused)

    def observe(self, entered: bool, label: int | None) -> None:
        self.state.step(self.cfg, float(entered), label)

    def decide(self, bar, broker):
        self.observe(self.entered, self.label)
        self.label = None
        out = [Action("CLOSE", p.id) for p in broker.open.values() if p.bars >= self.t_max]
        p, sigma = bar.get(self.signal), bar.get("sigma_ve")
        self.entered = p is not None and not self.paused and (sigma is None or self.cfg.sigma_max is None or sigma <= self.cfg.sigma_max) and p >= self.tau
        return out + [Action("OPEN")] * self.entered


STRATEGIES: dict[str, Callable] = {"threshold_gate": ThresholdGate, "pure_conformal": ThresholdGate, "ev_calibrated_size": EvCalibratedSize, "regime_gated": RegimeGated, "composite_adaptive": CompositeAdaptive}


def register_strategy(name: str, make: Callable) -> None:
    STRATEGIES[name] = make


# Risk policies: check(action, broker, ts) -> (approved, reason, action to take instead or None)


class MaxPositions:
    def __init__(self, most: int = 5):
        self.most = most

    def check(self, a, broker, ts):
        return not (a.kind == "OPEN" and len(broker.open) >= self.most), "max_positions", None


class MaxDrawdown:
    def __init__(self, limit: float = -0.2):
        self.limit = limit

    def check(self, a, broker, ts):
        return not (a.kind in ("OPEN", "SCALE_IN") and broker.equity - broker.high_water < self.limit), "max_drawdown", None


class MaxLoss:
    """A wider stop is rejected with a suggestion: the same order with the widest stop allowed."""

    def __init__(self, most: float = 0.05):
        self.most = most

    def check(self, a, broker, ts):
        stop = broker.cfg.sl if a.sl is None else a.sl
        if a.kind == "OPEN" and abs(stop) > self.most:
            return False, "max_loss", dataclasses.replace(a, sl=self.most)
        return True, "", None


class MaxOrderRate:
    def __init__(self, per_minute: int = 10):
        self.most, self.recent = per_minute, collections.deque()

    def check(self, a, broker, ts):
        if a.kind not in ("OPEN", "SCALE_IN"):
            return True, "", None
        while self.recent and ts - self.recent[0] > 60 * 10**9:
            self.recent.popleft()
        if len(self.recent) >= self.most:
            return False, "max_order_rate", None
        self.recent.append(ts)
        return True, "", None


class KillSwitch:
    def __init__(self, engaged: bool = False):
        self.engaged = engaged

    def check(self, a, broker, ts):
        return not (self.engaged and a.kind in ("OPEN", "SCALE_IN")), "kill_switch", None


POLICIES: dict[str, Callable] = {"max_positions": MaxPositions, "max_drawdown": MaxDrawdown, "max_loss": MaxLoss, "max_order_rate": MaxOrderRate, "kill_switch": KillSwitch}


class Risk:
    """Policies by name, asked in order; the first rejection holds, a suggestion is asked about anew."""

    def __init__(self, policies: Iterator[tuple[str, tuple]]):
        self.policies = {n: POLICIES[n](*args) for n, args in policies}
        self.log: list[tuple[str, str]] = []

    def add(self, name: str, *args) -> None:
        self.policies[name] = POLICIES[name](*args)
        self.log.append(("add", name))

    def remove(self, name: str) -> None:
        self.policies.pop(name, None)
        self.log.append(("remove", name))

    def check(self, a: Action, broker: SimBroker, ts: int) -> tuple[Action | None, str]:
        for _ in range(3):
            for policy in self.policies.values():
                ok, why, other = policy.check(a, broker, ts)
                if not ok:
                    break
            else:
                return a, ""
            if other is None:
                return None, why
            a = other
        return None, why


class SimBroker:
    """Orders fill in the next bar; positions end at their first barrier, by a sweep, at the age cap or by hand."""

    def __init__(self, cfg: SimConfig):
        self.cfg = cfg
        self.open: dict[int, Position] = {}
        self.pending: list[tuple[int, Action]] = []
        self.next_id, self.realized, self.high_water = 1, 0.0, 0.0
        self.rows: list[dict] = []

    @property
    def equity(self) -> float:
        return self.realized + sum(p.unrealized for p in self.open.values())

    def net_signed(self) -> float:
        return sum(p.side * p.size for p in self.open.values())

    def _end(self, p: Position, kind: str, reason: str, price: float, ts: int) -> None:
        gross = p.side * math.log(price / p.entry) * p.size
        net = gross - 2 * self.cfg.costs.per_side(p.open_size) * p.size
        self.realized += net
        self.open.pop(p.id)
        self.rows.append({"kind": kind, "ts": ts, "position_id": p.id, "side": p.side, "size": p.open_size, "entry_ts": p.open_ts, "exit_ts": ts, "entry_price": p.entry, "exit_price": price, "pnl_gross": gross, "pnl_net": net, "reason": reason, "y": int(reason == "TP"), "mae": p.mae, "mfe": p.mfe})

    def dispatch(self, a: Action, ts: int) -> bool:
        p = self.open.get(a.position_id)
        if a.kind == "OPEN":
            if len(self.open) + sum(x.kind == "OPEN" for _, x in self.pending) >= self.cfg.inventory_cap:
                return False
            self.pending.append((self.next_id, a))
            self.next_id += 1
        elif a.kind == "CANCEL":
            before = len(self.pending)
            self.pending = [(i, x) for i, x in self.pending if i != a.position_id or x.kind != "OPEN"]
            return len(self.pending) < before
        elif a.kind == "HOLD":
            return True
        elif p is None:
            return False
        elif a.kind == "SCALE_IN":
            self.pending.append((p.id, a))
        elif a.kind == "CLOSE" or a.kind == "SCALE_OUT" and p.size * (1 - a.size) <= 1e-12:
            self._end(p, "close", "MANUAL", p.mark or p.entry, ts)
        elif a.kind == "SCALE_OUT":
            cut = p.size * a.size
            self.realized += p.side * math.log((p.mark or p.entry) / p.entry) * cut - 2 * self.cfg.costs.per_side(p.open_size) * cut
            p.size -= cut
        elif a.kind == "MODIFY_STOP":
            p.tp, p.sl = (p.tp if a.tp is None else a.tp), (p.sl if a.sl is None else a.sl)
        return True

    def on_bar(self, bar: dict) -> None:
        """bar["underlying"]: minutes (ts ns, high, low, close) in order; a bar with fewer than m_minutes is passed over."""
        minutes, cfg = bar["underlying"], self.cfg
        if len(minutes) < cfg.m_minutes:
            return
        fill_ts, _, _, fill = minutes[max(0, cfg.latency - 1)]
        fresh = set()
        for i, a in self.pending:
            if a.kind == "OPEN":
                self.open[i] = Position(i, a.side, a.size, a.size, fill, fill_ts, cfg.tp if a.tp is None else a.tp, cfg.sl if a.sl is None else a.sl, mark=fill)
                fresh.add(i)
            elif i in self.open:
                self.open[i].add(a.size * self.open[i].open_size, fill)
        self.pending = []
        for p in list(self.open.values()):
            if p.id in self.open:
                self._scan(p, minutes[cfg.latency if p.id in fresh else 0 :], minutes[-1])
        for p in list(self.open.values()):
            p.bars += p.id not in fresh
            if p.bars > cfg.safety_bars:
                self._end(p, "fill", "SAFETY_CAP", minutes[-1][3], minutes[-1][0])
            else:
                p.marked(bar["close"])
        self.high_water = max(self.high_water, self.equity)

    def _scan(self, p: Position, minutes: list, last: tuple) -> None:
        up, tp, sl = p.side > 0, p.entry * math.exp(p.side * p.tp), p.entry * math.exp(-p.side * p.sl)
        for ts, high, low, _ in minutes:
            hit_t, hit_s = (high >= tp, low <= sl) if up else (low <= tp, high >= sl)
            if hit_t or hit_s:
                first = "SL" if hit_s and (not hit_t or self.cfg.tie == "pessimistic" or self.cfg.tie == "bernoulli" and (ts * 2654435761 >> 13) & 1) else "TP"
                price = tp if first == "TP" else sl
                self._end(p, "fill", first, price, ts)
                if first == "TP":
                    self._sweep(price, ts)
                return

    def _sweep(self, price: float, ts: int) -> None:
        """After a target, every other position that would win more than the margin ends at that price."""
        for q in list(self.open.values()):
            cost = self.cfg.costs.per_side(q.open_size)
            if q.side * math.log(price / q.entry) * q.size - 2 * cost * q.size > self.cfg.sweep_margin * cost * q.size:
                self._end(q, "fill", "BATCHED_WINNER", price, ts)


class Engine:
    """One instrument's run. Order of a bar: commands, maturing label (and learning), barriers, prediction, strategy, risk, dispatch."""

    def __init__(self, cfg: SimConfig):
        self.cfg = cfg
        self.broker, self.risk = SimBroker(cfg), Risk(cfg.policies)
        self.strategy = STRATEGIES[cfg.strategy](**dict(cfg.params))
        self.model = AdaptiveForest(list(cfg.features), seed=cfg.seed) if cfg.learn else None
        self.before: dict | None = None
        self.n = 0
        self.paused = False
        self.commands: list[Callable[[Engine], None]] = []

    def _mature(self, bar: dict) -> list[dict]:
        old, self.before = self.before, None
        if old is None or old["segment_id"] != bar["segment_id"] or not bar["high"] > 0 or not old["close"] > 0:
            return []
        y = int(math.log(bar["high"] / old["close"]) >= self.cfg.alpha_label)
        found: list[dict] = []
        if self.model is not None:
            before = self.model.warnings, self.model.drifts
            self.model.learn(old, y)
            for why, n, now in zip(("warning", "drift"), before, (self.model.warnings, self.model.drifts)):
                if now > n:  # of the forest's trees
                    found.append({"kind": "drift", "ts": bar["ts"], "reason": why, "n_actions": now - n})
        if hasattr(self.strategy, "label"):
            self.strategy.label = y
        if old["p"] is None:
            return found
        return [{"kind": "trace", "ts": old["ts"], "p": old["p"], "p_offline": old.get("p_offline"), "y": y, "regime": old.get("regime"), "sigma_ve": old.get("sigma_ve")}, *found]

    def step(self, bar: dict) -> list[dict]:
        self.n += 1
        for command in self.commands:
            command(self)
        self.commands = []
        out = self._mature(bar)
        self.broker.on_bar(bar)
        bar = dict(bar)
        if self.model is not None:
            bar["p"] = self.model.predict(bar)
        if not self.paused:
            taken = rejected = 0
            open_before = len(self.broker.open)
            for a in self.strategy.decide(bar, self.broker):
                if self.n <= self.cfg.warmup:
                    continue
                ok, why = self.risk.check(a, self.broker, bar["ts"])
                if ok is not None and self.broker.dispatch(ok, bar["ts"]):
                    taken += 1
                else:
                    rejected += 1
                    out.append({"kind": "rejected", "ts": bar["ts"], "reason": why or "broker"})
            self.before = bar
            if self.n > self.cfg.warmup:
                out.append({"kind": "audit", "ts": bar["ts"], "p": bar["p"], "p_offline": bar.get("p_offline"), "regime": bar.get("regime"), "n_actions": taken, "n_open": open_before})
        s = self.strategy
        out.append({
            "kind": "state", "ts": bar["ts"], "tau": getattr(s, "tau", None), "r_hat": getattr(s, "r_hat", None), "r_star": getattr(s, "r_star", None), "paused": bool(getattr(s, "paused", False)) or self.paused, "sigma_ve": bar.get("sigma_ve"),
            "size": sum(p.size for p in self.broker.open.values()), "n_open": len(self.broker.open), "equity": self.broker.equity, "drawdown": self.broker.equity - self.broker.high_water,
        })
        out += self.broker.rows
        self.broker.rows = []
        return out


#: What an operator can do to a run, by name; each takes the engine and the command's arguments.
COMMANDS: dict[str, Callable] = {
    "flatten": lambda e: [e.broker.dispatch(Action("CLOSE", i), p.open_ts) for i, p in list(e.broker.open.items())],
    "set_stop": lambda e, position_id, tp=None, sl=None: e.broker.dispatch(Action("MODIFY_STOP", position_id, tp=tp, sl=sl), 0),
    "kill": lambda e: e.risk.add("kill_switch", True),
    "unkill": lambda e: e.risk.remove("kill_switch"),
    "pause": lambda e: setattr(e, "paused", True),
    "resume": lambda e: setattr(e, "paused", False),
    "risk_add": lambda e, name, *args: e.risk.add(name, *args),
    "risk_remove": lambda e, name: e.risk.remove(name),
}


def bar_of(row, cfg: SimConfig) -> dict:
    """A step's input from a row of bars with underlying (open_time ms)."""
    value = lambda k: None if row.get(k) is None or row.get(k) != row.get(k) else row[k]
    minutes = [(int(m["open_time"]) * 1_000_000, float(m["high"]), float(m["low"]), float(m["close"])) for m in row["underlying"]]
    out = {k: value(k) for k in (*cfg.features, "p_offline", "sigma_ve", "regime")}
    return out | {"ts": int(row["open_time"]) * 1_000_000, "high": float(row["high"]), "close": float(row["close"]), "segment_id": int(row["segment_id"]), "underlying": minutes, "p": value(cfg.p_column)}


def frame(rows: list[dict], instrument: str) -> pd.DataFrame:
    kinds = {"long": "Int64", "int": "Int32", "double": "float64", "boolean": "boolean", "string": "object"}
    return pd.DataFrame({k: pd.array([instrument if k == "instrument" else r.get(k) for r in rows], dtype=kinds[v]) for k, v in OUT.items()})


def replay(bars: DataFrame, cfg: SimConfig = SimConfig(), keys: tuple[str, ...] = ("instrument",), own: tuple[str, ...] = ()) -> DataFrame:
    """All outputs of a run over the bars of each value of the keys (instrument last), in order of time, and the other keys.

    Bars come to a task sorted, batch by batch, so neither a run's bars nor its outputs are ever held as
    a whole; runs go side by side. Columns `own` hold a run's own values of the strategy's parameters of
    those names (the same in all of its rows; null: those of cfg).
    """
    more = keys[:-1]
    kinds = dict(bars.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, engine = None, None
        for part in batches:
            out: list[dict] = []
            for row in part.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if engine is None or key != now:
                    if out:
                        yield frame(out, now[-1]).assign(**dict(zip(more, now)))
                    values = {k: row[k] for k in own}
                    params = {**dict(cfg.params), **{k: float(v) for k, v in values.items() if v is not None and math.isfinite(v)}}
                    now, engine, out = key, Engine(dataclasses.replace(cfg, params=tuple(sorted(params.items())))), []
                out += engine.step(bar_of(row, cfg))
            if out:
                yield frame(out, now[-1]).assign(**dict(zip(more, now)))

    names = dict.fromkeys([*keys, *own, "open_time", "high", "close", "segment_id", "underlying", *cfg.features, cfg.p_column, *(c for c in ("p_offline", "sigma_ve", "regime") if c in bars.columns)])
    ordered = bars.select(*names).repartition(*keys).sortWithinPartitions(*keys, "open_time")
    return ordered.mapInPandas(run, SCHEMA + "".join(f", {k} {kinds[k]}" for k in more))


def simulate(bars: DataFrame, cfg: SimConfig = SimConfig(), own: tuple[str, ...] = ()) -> DataFrame:
    """All outputs of a run over each instrument's bars (see replay). Kinds: fill, close, trace, state, audit, rejected, drift."""
    return replay(bars, cfg, own=own)


def fills(outputs: DataFrame) -> DataFrame:
    return outputs.where("kind = 'fill'").selectExpr("instrument", "position_id AS idx", "entry_ts", "exit_ts", "reason", "side", "pnl_net AS pnl", "pnl_gross", "y")


def trace(outputs: DataFrame) -> DataFrame:
    return outputs.where("kind = 'trace'").selectExpr("instrument", "ts AS idx", "p", "y", "regime", "sigma_ve")
