"""Recurrences over ordered series: smoothing, thermal state, drift, dispatch.

``segment_map`` runs a function over sorted runs of rows that share the partition columns.
Runs are chunks of bounded size (see ``gridloom.operators.series``) or series resampled to
a calendar grid, so what one call holds in memory is bounded.

``carry_scan`` makes a recurrence parallel *within* one series: every chunk is reduced to
a small summary of how it maps an entry state to an exit state, the summaries (one row per
chunk) are folded in order, and a second pass replays the chunks from their true entry
states.  The result does not depend on the number of partitions or chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.operators.series import TARGET_ROWS, chunk_rows


def _starts(table: pa.Table, cols: Sequence[str]) -> np.ndarray:
    """Positions where a new run of equal ``cols`` begins, including 0."""
    n = table.num_rows
    change = np.zeros(max(n - 1, 0), dtype=bool)
    for c in cols:
        col = table.column(c).combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
        differs = pc.not_equal(col.slice(1), col.slice(0, n - 1)) if n > 1 else pa.array([], pa.bool_())
        change |= np.asarray(pc.fill_null(differs, False))
    return np.concatenate([[0], np.flatnonzero(change) + 1]) if n else np.array([], dtype=int)


def in_runs(df: DataFrame, parts: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with equal ``parts`` side by side and in order.

    A ranking window states both needs to Spark, which then plans the shuffle and the sort
    only where the input does not have them already, and keeps runs whole when it adapts
    the plan.
    """
    w = Window.partitionBy(*parts).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w))


def segment_map(
    df: DataFrame,
    parts: Sequence[str],
    order: Sequence[str],
    fn: Callable[[pa.Table], pa.Table],
    schema: str | StructType,
) -> DataFrame:
    """Apply ``fn`` to each run of equal ``parts``, rows sorted by ``order``."""
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out_schema = to_arrow_schema(struct)
    parts = list(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: pa.Table | None = None

        def finish(tables):
            done = [fn(t).select(out_schema.names).cast(out_schema) for t in tables]
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            if open_run is not None:
                table = pa.concat_tables([open_run, table])
            cuts = _starts(table, parts)
            yield from finish(table.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:]))
            open_run = table.slice(cuts[-1])
        if open_run is not None:
            yield from finish([open_run])

    return in_runs(df, parts, order).mapInArrow(run, struct)


def running_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    start: Callable[[dict], object],
    step: Callable[[object, dict], object],
    emit: Callable[[object], dict],
    schema: StructType,
) -> DataFrame:
    """For each row the state before it; rows stream by, so a run may have any length.

    ``start`` makes a key's first state from its first row, ``step`` advances it.
    """
    keys = list(keys)
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                mine = tuple(row[k] for k in keys)
                if mine != key:
                    key, state = mine, start(row)
                out.append({k: row[k] for k in [*keys, order]} | emit(state))
                state = step(state, row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    return in_runs(df, keys, [order]).mapInArrow(run, schema)


def _schema_with(df: DataFrame, extra: str, drop: Sequence[str] = ()) -> StructType:
    base = [f for f in df.schema.fields if f.name not in drop]
    return StructType(base + StructType.fromDDL(extra).fields)


def doubles(table: pa.Table, col: str) -> np.ndarray:
    return table.column(col).to_numpy(zero_copy_only=False).astype(float)


def _one(table: pa.Table, keys: Sequence[str], values: dict) -> pa.Table:
    """A one-row table: the run's key columns plus ``values``."""
    head = {k: table.column(k).slice(0, 1) for k in keys}
    return pa.table(head | {k: pa.array([v]) for k, v in values.items()})


@dataclass(frozen=True)
class Scan:
    """A recurrence in parts that can be worked on apart from each other.

    ``summarise`` reads a chunk; ``start``, ``step`` and ``emit`` run over a series' ordered
    summaries and give each chunk its entry state, ``load`` is the inverse of ``emit``;
    ``replay`` reads a chunk whose rows carry that state and returns the new columns.
    """

    summary_schema: str
    carry_schema: str
    output_schema: str
    summarise: Callable[[pa.Table], dict]
    start: Callable[[dict], object]
    step: Callable[[object, dict], object]
    emit: Callable[[object], dict]
    load: Callable[[dict], object]
    replay: Callable[[pa.Table], dict]

    def replayed(self, table: pa.Table, names: Sequence[str]) -> pa.Table:
        new = self.replay(table)
        kept = table.select(names)
        for name, values in new.items():
            kept = kept.append_column(name, pa.array(values))
        return kept


def carry_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], scan: Scan, target: int = TARGET_ROWS) -> DataFrame:
    """Two-pass scan; see the module text.  Both passes read the same shuffle."""
    keys, names = list(keys), list(df.columns)
    parts = [*keys, "_chunk"]
    head = StructType([df.schema[k] for k in keys] + StructType.fromDDL("_chunk bigint").fields)
    carry = StructType.fromDDL(scan.carry_schema)
    chunks = chunk_rows(df, keys, order, 0, target).select(*names, "_chunk").repartition(*parts)

    summaries = segment_map(
        chunks, parts, order, lambda t: _one(t, parts, scan.summarise(t)),
        StructType(head.fields + StructType.fromDDL(scan.summary_schema).fields),
    )
    entries = running_fold(summaries, keys, "_chunk", scan.start, scan.step, scan.emit, StructType(head.fields + carry.fields))
    return segment_map(
        chunks.join(entries, parts), parts, order, lambda t: scan.replayed(t, names), _schema_with(df, scan.output_schema)
    )


# --- exponential smoothing ------------------------------------------------------------

def ewma_scan(col: str, alpha=0.2, name="ewma", seed: str | None = None) -> Scan:
    """The map of a chunk is affine, so its summary is (rows, exit value from entry 0)."""
    import pandas as pd

    decay = 1.0 - alpha

    def local(x):  # smoothing from entry state 0
        s = pd.Series(np.concatenate([[0.0], x])).ewm(alpha=alpha, adjust=False).mean()
        return s.to_numpy()[1:]

    def summarise(t):
        x = doubles(t, col)
        start = t.column(seed)[0].as_py() if seed else None
        # a seed is the state before the first row; without one the first value is kept as is
        return {"m": float(len(x)), "exit0": float(local(x)[-1]), "first": float(x[0] if start is None else start)}

    def replay(t):
        x = doubles(t, col)
        s0 = t.column("_in")[0].as_py()
        return {name: local(x) + s0 * np.power(decay, np.arange(1, len(x) + 1))}

    return Scan(
        "m double, exit0 double, first double", "_in double", f"{name} double", summarise,
        lambda c: c["first"], lambda s, c: c["exit0"] + decay ** c["m"] * s, lambda s: {"_in": s}, lambda c: c["_in"], replay,
    )


def ewma(df: DataFrame, keys, order, col: str, alpha=0.2, name="ewma", seed: str | None = None, **kw) -> DataFrame:
    """s = (1-alpha) s + alpha x, starting at the first value (or the ``seed`` column)."""
    return carry_scan(df, keys, order, ewma_scan(col, alpha, name, seed), **kw)


# --- thermal state --------------------------------------------------------------------
HEATING, COOLING, INITIAL_C = 0.05, 0.002, 150.0


def thermal_state(df: DataFrame, keys, order, power="usage_kwh", ambient="temp", name="thermal_state_c", **kw):
    """h' = max(amb, h + 0.05 P - 0.002 (h - amb)) with P and amb of the row before.

    One step is h -> max(A, B h + C); such maps compose to the same form, so a chunk's
    summary is its (A, B, C).
    """
    keep = 1.0 - COOLING

    def step_constants(t):
        amb = doubles(t, ambient)
        return amb, HEATING * doubles(t, power) + COOLING * amb

    def summarise(t):
        lo, c = step_constants(t)
        a, b, k = -np.inf, 1.0, 0.0
        for lo_i, c_i in zip(lo.tolist(), c.tolist()):
            a, b, k = max(lo_i, keep * a + c_i), b * keep, keep * k + c_i
        return {"a": float(a), "b": float(b), "c": float(k)}

    def replay(t):
        lo, c = step_constants(t)
        h = t.column("_in")[0].as_py()
        states = np.empty(len(lo))
        for i, (lo_i, c_i) in enumerate(zip(lo.tolist(), c.tolist())):
            states[i] = h
            h = max(lo_i, keep * h + c_i)
        return {name: states}

    scan = Scan(
        "a double, b double, c double", "_in double", f"{name} double", summarise,
        lambda c: INITIAL_C, lambda h, c: max(c["a"], c["b"] * h + c["c"]), lambda h: {"_in": h}, lambda c: c["_in"], replay,
    )
    return carry_scan(df, keys, order, scan, **kw)


# --- cumulative-sum drift ---------------------------------------------------------------

def _walk(d: np.ndarray, k: float, h: float, p: float, n: float, start: int = 0, block: int = 4096):
    """First alarm at or after ``start`` from state (p, n), with the states up to it.

    Returns (alarm index or -1, up-sums, down-sums); the state resets to 0 after an alarm.
    """
    ups, downs = [], []
    i = start
    while i < len(d):
        part = d[i : i + block]
        u, v = np.cumsum(part - k), np.cumsum(-part - k)
        up = np.maximum(p + u, u - np.minimum(np.minimum.accumulate(u), 0.0))
        dn = np.maximum(n + v, v - np.minimum(np.minimum.accumulate(v), 0.0))
        over = (up > h) | (dn > h)
        if over.any():
            j = int(np.argmax(over))
            ups.append(up[: j + 1])
            downs.append(dn[: j + 1])
            return i + j, np.concatenate(ups), np.concatenate(downs)
        ups.append(up)
        downs.append(dn)
        p, n = float(up[-1]), float(dn[-1])
        i += block
    return -1, np.concatenate(ups) if ups else np.array([p]), np.concatenate(downs) if downs else np.array([n])


def _exits_after(d, k, h, starts):
    """Exit state of the chunk for a walk that begins at (0, 0) right at each start.

    Walks that alarm at the same place share the rest of their way, so ends are memorised.
    """
    known: dict[int, tuple[float, float]] = {}
    for s in starts:
        path, at = [], int(s)
        while at not in known:
            if at >= len(d):
                known[at] = (0.0, 0.0)
                break
            path.append(at)
            alarm, up, dn = _walk(d, k, h, 0.0, 0.0, at)
            if alarm < 0:
                known[at] = (float(up[-1]), float(dn[-1]))
                break
            at = alarm + 1
        for back in path:
            known[back] = known[at]
    return [known[int(s)] for s in starts]


def _first_passages(walk: np.ndarray, h: float, before: int):
    """(levels, places): the walk first exceeds level-to-be at its record highs in (0, h]."""
    w = walk[:before]
    if not len(w):
        return np.array([]), np.array([], dtype=int)
    top = np.maximum.accumulate(w)
    fresh = np.concatenate([[True], top[1:] > top[:-1]]) & (w > 0)
    places = np.flatnonzero(fresh)
    return w[places], places


def cusum_scan(col="usage_kwh", allowance=0.5, threshold=5.0) -> Scan:
    """Drift sums over rows that carry their key's ``_mu`` and ``_sd``.

    Sums are kept in units of the deviation and reset to 0 after an alarm.  From entry state
    (p, n) a chunk first alarms where the free walk passes ``h - p`` (or ``h - n``) or where
    the walk from (0, 0) alarms anyway; behind the alarm the way no longer depends on the
    entry.  A chunk's summary therefore lists the free walks' record highs with the exit
    state that follows an alarm there.
    """

    def scaled(t):
        d = doubles(t, col) - t.column("_mu")[0].as_py()
        sd = t.column("_sd")[0].as_py()
        return d, allowance * sd, threshold * sd

    def summarise(t):
        d, k, h = scaled(t)
        alarm, up, dn = _walk(d, k, h, 0.0, 0.0)
        own = alarm if alarm >= 0 else len(d)
        u, v = np.cumsum(d - k), np.cumsum(-d - k)
        u_lev, u_at = _first_passages(u, h, own)
        v_lev, v_at = _first_passages(v, h, own)
        places = sorted({*u_at.tolist(), *v_at.tolist(), *([own] if alarm >= 0 else [])})
        ends = _exits_after(d, k, h, [p + 1 for p in places])
        return {
            "h": float(h), "own": int(own) if alarm >= 0 else -1,
            "u_lev": u_lev.tolist(), "u_at": u_at.tolist(), "v_lev": v_lev.tolist(), "v_at": v_at.tolist(),
            "at": places, "end_p": [e[0] for e in ends], "end_n": [e[1] for e in ends],
            "u_sum": float(u[-1]), "v_sum": float(v[-1]), "p0": float(up[-1]), "n0": float(dn[-1]),
        }

    def step(state, c):
        p, n = state
        hits = [c["own"]] if c["own"] >= 0 else []
        for levels, places, entry in (("u_lev", "u_at", p), ("v_lev", "v_at", n)):
            i = int(np.searchsorted(c[levels], c["h"] - entry, side="right"))
            hits += c[places][i : i + 1]
        if hits:
            e = c["at"].index(min(hits))
            return c["end_p"][e], c["end_n"][e]
        return max(p + c["u_sum"], c["p0"]), max(n + c["v_sum"], c["n0"])

    def replay(t):
        d, k, h = scaled(t)
        p, n = t.column("_p")[0].as_py(), t.column("_q")[0].as_py()
        ups, dns, at = [], [], 0
        kind = np.full(len(d), None, dtype=object)
        level = np.full(len(d), None, dtype=object)
        while at < len(d):
            alarm, up, dn = _walk(d, k, h, p, n, at)
            ups.append(up)
            dns.append(dn)
            if alarm < 0:
                break
            kind[alarm] = "Upper" if up[-1] > h else "Lower"
            level[alarm] = "Critical" if max(up[-1], dn[-1]) > 1.5 * h else "Warning"
            p = n = 0.0
            at = alarm + 1
        return {
            "cusum_pos": np.concatenate(ups), "cusum_neg": np.concatenate(dns),
            "drift": kind.tolist() if any(x is not None for x in kind) else pa.nulls(len(d), pa.string()),
            "drift_severity": level.tolist() if any(x is not None for x in level) else pa.nulls(len(d), pa.string()),
        }

    return Scan(
        "h double, own bigint, u_lev array<double>, u_at array<bigint>, v_lev array<double>, v_at array<bigint>, "
        "at array<bigint>, end_p array<double>, end_n array<double>, u_sum double, v_sum double, p0 double, n0 double",
        "_p double, _q double",
        "cusum_pos double, cusum_neg double, drift string, drift_severity string",
        summarise, lambda c: (0.0, 0.0), step, lambda s: {"_p": s[0], "_q": s[1]}, lambda c: (c["_p"], c["_q"]), replay,
    )


def cusum(
    df: DataFrame, keys, order, col="usage_kwh", allowance=0.5, threshold=5.0, target_mean: str | None = None, **kw
) -> DataFrame:
    """Adds ``cusum_pos, cusum_neg, drift`` ('Upper'/'Lower'/null) and ``drift_severity``; see ``cusum_scan``."""
    stats = df.groupBy(*keys).agg(
        (F.avg(col) if target_mean is None else F.first(target_mean)).alias("_mu"),
        F.stddev_pop(col).alias("_sd0"),
    ).withColumn("_sd", F.when(F.col("_sd0") == 0, 1.0).otherwise(F.col("_sd0"))).drop("_sd0")
    rows = df.join(stats, list(keys))
    return carry_scan(rows, keys, order, cusum_scan(col, allowance, threshold), **kw).drop("_mu", "_sd")


def drift_summary(scanned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: number of change points, of critical ones, and whether any occurred."""
    return scanned.groupBy(*keys).agg(
        F.count("drift").alias("change_points"),
        F.count_if(F.col("drift_severity") == "Critical").alias("critical_points"),
        (F.count("drift") > 0).alias("drift_detected"),
    )


# --- storage on a fixed time step -------------------------------------------------------
STEP_HOURS = 0.25


def _efficiency(rate: float) -> float:
    return min(0.98, max(0.70, 0.98 - 0.05 * rate * rate))


def fifteen_minutes(df: DataFrame, keys: Sequence[str], ts="ts", cols: Sequence[str] = ("usage_kwh", "solar_kwh")):
    """Energy per quarter hour: one row per key and step, whatever the reading rate."""
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 900) * 900)
    return df.groupBy(*keys, slot.alias(ts)).agg(*[F.sum(c).alias(c) for c in cols])


def battery_dispatch(steps: DataFrame, keys: Sequence[str], scenario_cols=("solar_kw", "battery_kwh"), ts="ts"):
    """Charge on surplus, discharge on deficit; adds grid_draw, solar_used and soc_kwh.

    ``steps`` has one row per key, scenario and quarter hour (``fifteen_minutes``), so a
    run is bounded by the calendar; parallelism comes from keys x scenarios.
    """
    parts = [*keys, *scenario_cols]
    solar_kw, battery = scenario_cols

    def run(t: pa.Table) -> pa.Table:
        load, scale = doubles(t, "usage_kwh"), t.column(solar_kw)[0].as_py() / 100.0
        sun = doubles(t, "solar_kwh") * scale
        cap = t.column(battery)[0].as_py()
        limit, soc = 0.5 * cap * STEP_HOURS, 0.5 * cap
        grid, used, level = np.zeros(len(load)), np.zeros(len(load)), np.zeros(len(load))
        for i, need in enumerate((load - sun).tolist()):
            room = min(abs(need), limit, cap - soc if need <= 0 else limit) if cap > 0 else 0.0
            eta = _efficiency(room / STEP_HOURS / cap) if room > 0 else 1.0
            if need <= 0:
                soc += room * eta
                used[i] = sun[i] + need + room
            else:
                given = min(room, soc * eta)
                soc -= given / eta
                grid[i], used[i] = need - given, sun[i]
            level[i] = soc
        return (
            t.append_column("solar_generated", pa.array(sun)).append_column("grid_draw", pa.array(grid))
            .append_column("solar_used", pa.array(used)).append_column("soc_kwh", pa.array(level))
        )

    schema = _schema_with(steps, "solar_generated double, grid_draw double, solar_used double, soc_kwh double")
    return segment_map(steps, parts, [ts], run, schema)


def soc_soh_scan(steps: DataFrame, keys, order, charge="charge_kwh", discharge="discharge_kwh", capacity="battery_kwh"):
    """State of charge, depth of discharge and health from charge/discharge columns.

    Expects a calendar grid (at most one row per key and step).
    """
    def run(t: pa.Table) -> pa.Table:
        cap = float(t.column(capacity)[0].as_py())
        soc, soh = 0.5 * cap, 100.0
        out = np.zeros((3, t.num_rows))
        for i, (c, d) in enumerate(zip(doubles(t, charge).tolist(), doubles(t, discharge).tolist())):
            if cap > 0:
                gain = c * _efficiency(c / cap) - d / _efficiency(d / cap)
                soc = min(max(soc + gain, 0.0), cap)
                dod = 1.0 - soc / cap
                soh = max(0.0, soh - d / (2.0 * cap) * 5e-5 * (1.0 + 1.5 * dod) * 100.0)
            else:
                dod = 0.0
            out[:, i] = soc, dod, soh
        for name, col in zip(("soc_kwh", "dod", "soh_pct"), out):
            t = t.append_column(name, pa.array(col))
        return t

    return segment_map(steps, keys, order, run, _schema_with(steps, "soc_kwh double, dod double, soh_pct double"))


