"""Draws that several cells share are hashed once; gaps of votes without a row per draw."""

from __future__ import annotations

import pandas as pd
import pytest

from bestofk.operators import metrics as M
from bestofk.operators import resample as R


def test_cells_of_one_size_share_the_hashes(monkeypatch):
    calls = []
    monkeypatch.setattr(R, "md5", lambda data, plain=R.md5: calls.append(data) or plain(data))

    def strokes(cells, n=40, m=100):
        calls.clear()
        frame = pd.DataFrame([
            {"cell": c, "prompt_id": i, "m": m, "cell_hash": c, "name": str(i), "v": float(c + i % 3)} for i in range(m) for c in range(cells)])
        out = pd.concat(R._strokes(["cell"], n, 0)(iter([frame.iloc[:150], frame.iloc[150:]])))
        return out, len(calls)

    one, hashed = strokes(1)
    three, hashed_for_three = strokes(3)
    assert hashed_for_three <= hashed * 1.02  # a prompt may be cut by the end of a batch
    assert (three["w"].groupby([three["cell"], three["b"]]).sum().unstack("cell").eq(one.groupby("b")["w"].sum(), axis=0)).all().all()
    assert len(three[three["at"] < 0]) == 3 * 40


def test_gaps_of_votes(rows):
    """Null utilities, keys that are all null, and pools of several sizes."""
    data = [(p, k, None if p == 3 else (p * k) % 3, None if p == 5 else float((p + k) % 4 == 0)) for p in range(150) for k in range(1 + p % 6)]
    df = rows(data, "prompt_id int, k int, vote_key int, u double")
    got = {(r.prompt_id, r.sc_n): r for r in R.sc_gaps(df, [2, 7], n_draws=9, k_max=6).collect()}
    want = M.prompt_gap(R.sc_votes(df, [2, 7], n_draws=9, k_max=6), ["sc_n"]).collect()
    assert len(got) == len(want) == 300
    for r in want:
        for c in ("u_circ", "u_bar", "n_samples", "r_hat"):
            assert got[r.prompt_id, r.sc_n][c] == (r[c] if r[c] is None else pytest.approx(r[c])), (r, c)
