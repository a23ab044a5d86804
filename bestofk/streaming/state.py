"""Keyed state of the streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: Prompts are kept in so many buckets, each a state of its own: a call of the state function costs far more than a prompt in it.
PROMPT_BUCKETS = 512
BUCKET_STATE = "prompts binary"
DELTA = "d_circ double, d_bar double, d_prompts bigint, n_samples bigint"
DELTA_COLUMNS = ("d_circ", "d_bar", "d_prompts", "n_samples")
#: 128 bits that stand for a prompt of a cell, and its bucket.
PROMPT_ID = ("__id_a", "__id_b")
BUCKET = "__bucket"

_PROMPT = np.dtype([("a", "<i8"), ("b", "<i8"), ("high", "<f8"), ("total", "<f8"), ("n", "<i8")])


def prompt_identity(keys: Sequence[str]) -> dict[str, Column]:
    """The columns by which ``prompt_delta`` knows a prompt. A null is a value of its own."""
    parts = [part for k in keys for part in (F.col(k).isNull(), F.col(k))]
    a, b = (F.xxhash64(F.lit(salt), *parts) for salt in (1, 2))
    return {PROMPT_ID[0]: a, PROMPT_ID[1]: b, BUCKET: F.pmod(a, F.lit(PROMPT_BUCKETS)).cast("int")}


def _merged(prompts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the same prompt made one, in order of the prompts; and the places of each prompt's first and last row."""
    order = np.lexsort((prompts["b"], prompts["a"]))
    rows = prompts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
    starts = np.flatnonzero(new)
    out = rows[starts]
    out["high"] = np.maximum.reduceat(rows["high"], starts)
    out["total"] = np.add.reduceat(rows["total"], starts)
    out["n"] = np.add.reduceat(rows["n"], starts)
    return out, order[starts], order[np.append(starts[1:], len(rows)) - 1]


def prompt_delta(cell: Sequence[str], utility: str) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Keeps the maximum, sum and count of the utilities of a bucket's prompts; gives out by how much the part of each prompt that has new ones in the
    cell's sums has changed."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames = [f for f in (frame[frame[utility].notna()] for frame in frames) if len(f)]
        if not frames:
            return
        rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        samples = np.empty(len(rows), _PROMPT)
        samples["a"], samples["b"] = (rows[c].to_numpy() for c in PROMPT_ID)
        samples["high"] = samples["total"] = rows[utility].to_numpy()
        samples["n"] = 1
        arrived, row, _ = _merged(samples)
        before = np.frombuffer(state.get[0], _PROMPT) if state.exists else np.empty(0, _PROMPT)
        after, first, last = _merged(np.concatenate([before, arrived]))
        state.update((after.tobytes(),))
        touched, known = last >= len(before), first < len(before)
        old = np.zeros(len(after), _PROMPT)
        old[known] = before[first[known]]
        bar = after["total"] / after["n"] - old["total"] / np.maximum(old["n"], 1)
        moved = pd.DataFrame(dict(zip(DELTA_COLUMNS, (after["high"] - old["high"], bar, (~known).astype(np.int64), after["n"]))))[touched]
        of_cell = rows[list(cell)].iloc[row[last[touched] - len(before)]]
        yield pd.concat([of_cell.reset_index(drop=True), moved.reset_index(drop=True)], axis=1)

    return update
