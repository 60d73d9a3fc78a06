"""Build graphs of bounded size, all graphs of an Arrow batch in the same numpy steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: stands for an unknown finish, below every other
_NONE = np.iinfo(np.int64).min
_KINDS = {"owner": pa.bool_(), "solved": pa.bool_(), "finish": pa.int64(), "pred": pa.int32(), "looped": pa.bool_(), "edge_count": pa.int32(), "missing": pa.list_(pa.int32()), "back": pa.int32()}
_KEPT = ["trace_id", "span_id", "unit", "duration_ns", "faults"]


def solved(batches: Iterator[pa.RecordBatch], most: int, lenient: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by trace, unit and turn, with what their unit has in its graph.

    Traces are held back until their last row is there; one of more than `most` rows is
    passed on as it comes, unsolved.
    """
    held, large = None, None  # rows of the last trace so far; the name of a trace too large to hold
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        held = None
        if not rows.num_rows:
            continue
        starts = _starts(rows["trace_id"].combine_chunks())
        if large is not None and rows["trace_id"][0].as_py() == large:
            end = int(starts[1]) if len(starts) > 1 else rows.num_rows
            yield from _unsolved(rows.slice(0, end))
            rows, starts = rows.slice(end), starts[1:] - end
        if not rows.num_rows:
            continue
        last = int(starts[-1])
        large = None
        if last:
            yield from _solve(rows.slice(0, last), starts[:-1], most, lenient)
        if rows.num_rows - last > most:
            large = rows["trace_id"][last].as_py()
            yield from _unsolved(rows.slice(last))
        else:
            held = rows.slice(last)
    if held is not None:
        yield from _solve(held, np.zeros(1, np.int64), most, lenient)


def _starts(names: pa.Array) -> np.ndarray:
    """Where traces begin; every row without a name is one."""
    new = pc.fill_null(pc.not_equal(names[1:], names[:-1]), True).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def _unsolved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    n = rows.num_rows
    own = {"solved": pa.array(np.zeros(n, bool))}
    yield from pa.table({c: rows[c] for c in _KEPT} | {c: own.get(c, pa.nulls(n, kind)) for c, kind in _KINDS.items()}).to_batches()


def _solve(rows: pa.Table, starts: np.ndarray, most: int, lenient: bool) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    n, sizes = rows.num_rows, np.diff(np.append(starts, rows.num_rows))
    column = lambda c: rows[c].combine_chunks()
    numbers = lambda c, blank: pc.fill_null(column(c), blank).to_numpy(zero_copy_only=False).astype(np.int64)
    trace, duration = np.repeat(np.arange(len(starts)), sizes), numbers("duration_ns", _NONE)
    # sums that might not fit, and rows without a trace, are left to plain joins
    work = np.add.reduceat(np.where(duration == _NONE, 0.0, np.abs(duration.astype(float))), starts)
    fine = ((work < 2.0**62) & (sizes <= most) & column("trace_id").is_valid().to_numpy(zero_copy_only=False)[starts])[trace]
    unit, valid = numbers("unit", 0), column("unit").is_valid().to_numpy(zero_copy_only=False)
    key = (trace << 32) + (unit + (1 << 31))
    first = np.append(True, (key[1:] != key[:-1]) | ~valid[:-1])
    owner = valid & first & fine
    at = np.flatnonzero(owner)  # row of every node; nodes are in the order of their keys
    node_key, node_trace = key[at], trace[at]
    targets = column("targets")
    lengths = pc.fill_null(pc.list_value_length(targets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    from_row, to = np.repeat(np.arange(n), lengths), targets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    mine = owner[from_row]
    from_row, to = from_row[mine], to[mine]
    node = np.cumsum(owner) - 1
    to_key = (trace[from_row] << 32) + (to + (1 << 31))
    dst = np.searchsorted(node_key, to_key)
    there = np.append(node_key, -1)[dst] == to_key
    missing = _lists(from_row[~there], to[~there], n)
    src, dst = node[from_row[there]], dst[there]
    edge_count = np.bincount(src, minlength=len(at))
    looped = np.zeros(len(at), bool)
    looped[src[src == dst]] = True
    src, dst = src[src != dst], dst[src != dst]
    finish, done = _finish(duration[at], src, dst)
    if lenient:
        done[:] = True  # what is on or behind a cycle has the time of what comes before
    else:
        looped |= _on_cycles(len(at), *(x[~done[src] & ~done[dst]] for x in (src, dst)))
    pred = _preds(finish, src, dst, done)
    back = _walked(finish, pred, done, node_trace) if not lenient else np.full(len(at), -1)

    def spread(values: np.ndarray, known: np.ndarray, kind: pa.DataType) -> pa.Array:
        out, blank = np.zeros(n, values.dtype), np.ones(n, bool)
        out[at], blank[at] = values, ~known
        return pa.array(out, kind, mask=blank)

    every = np.ones(len(at), bool)
    flags = np.zeros(n, bool)
    flags[at] = looped
    own = {
        "owner": pa.array(owner), "solved": pa.array(fine), "finish": spread(finish, done & (finish != _NONE), pa.int64()), "pred": spread(unit[at][pred], pred >= 0, pa.int32()), "looped": pa.array(flags),
        "edge_count": spread(edge_count, every, pa.int32()), "missing": missing, "back": spread(back, back >= 0, pa.int32()),
    }
    yield from pa.table({c: rows[c] for c in _KEPT} | {c: own[c].cast(kind) for c, kind in _KINDS.items()}).to_batches()


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """A list for each of n rows; `rows` ascend."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


class _Out:
    """Edges by source."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.dst, self.begin = dst[order], np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n))))

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sources and targets of the edges that leave `nodes`."""
        count = self.begin[nodes + 1] - self.begin[nodes]
        skip = np.repeat(self.begin[nodes] - np.cumsum(count) + count, count)
        return np.repeat(nodes, count), self.dst[skip + np.arange(len(skip))]


def _finish(duration: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest way into and through every node, level by level, and which nodes are on or behind no cycle."""
    out, n = _Out(len(duration), src, dst), len(duration)
    waits, best, done = np.bincount(dst, minlength=n), np.zeros(n, np.int64), np.zeros(n, bool)
    finish = np.where(duration == _NONE, _NONE, duration)
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        done[ready] = True
        finish[ready] = np.where(duration[ready] == _NONE, _NONE, best[ready] + np.where(duration[ready] == _NONE, 0, duration[ready]))
        a, b = out.of(ready)
        np.maximum.at(best, b, finish[a])
        np.subtract.at(waits, b, 1)
        near = np.unique(b)
        ready = near[waits[near] == 0]
    rest = ~done & (duration != _NONE)
    finish[rest] = best[rest] + duration[rest]
    return finish, done


def _preds(finish: np.ndarray, src: np.ndarray, dst: np.ndarray, done: np.ndarray) -> np.ndarray:
    """The predecessor of greatest finish, of equal ones the first; -1 for none."""
    use = done[src] & done[dst]
    order = np.lexsort((-src[use], finish[src[use]]))
    pred = np.full(len(finish), -1)
    pred[dst[use][order]] = src[use][order]  # the last one written stays
    return pred


def _walked(finish: np.ndarray, pred: np.ndarray, done: np.ndarray, trace: np.ndarray) -> np.ndarray:
    """Steps back from the end of every trace's longest path; -1 off the path."""
    back = np.full(len(finish), -1)
    nodes = np.flatnonzero(done)
    order = nodes[np.lexsort((-nodes, finish[nodes], trace[nodes]))]
    here, step = order[np.append(trace[order][1:] != trace[order][:-1], True)] if len(order) else order, 0
    while len(here):
        back[here], step = step, step + 1
        here = pred[here]
        here = here[here >= 0]
    return back


def _on_cycles(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Nodes in strongly connected components of two or more, by colouring forward and collecting backward."""
    found = np.zeros(n, bool)
    while len(src):
        nodes = np.union1d(src, dst)
        colour, out, fresh = np.arange(n), _Out(n, src, dst), nodes
        while len(fresh):
            a, b = out.of(fresh)
            before = colour[b]
            np.maximum.at(colour, b, colour[a])
            fresh = np.unique(b[colour[b] > before])
        same = colour[src] == colour[dst]
        src, dst = src[same], dst[same]
        into, back = _Out(n, dst, src), np.zeros(n, bool)
        fresh = nodes[colour[nodes] == nodes]
        while len(fresh):
            back[fresh] = True
            fresh = np.unique(into.of(fresh)[1])
            fresh = fresh[~back[fresh]]
        members = np.bincount(colour[nodes[back[nodes]]], minlength=n)
        found |= back & (members[colour] > 1)
        keep = ~back[src] & ~back[dst]
        src, dst = src[keep], dst[keep]
    return found
