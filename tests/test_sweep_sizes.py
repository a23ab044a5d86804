"""The procedure sweep does the whole study."""

from __future__ import annotations

import __spark_entry__ as entry
from bestofk.functions.registry import VOTE_SIZES
from bestofk.plans import metric_queries as Q

SF_DIR = "/root/testdata/sf0.001"


def test_sweep_has_every_size_and_draw(spark):
    full = {r.sc_n: r for r in entry.queries()["procedure_sweep"](spark, SF_DIR).where("procedure = 'sc'").collect()}
    few = {r.sc_n: r for r in Q.procedure_sweep(spark, SF_DIR, (2, 4), 2).where("procedure = 'sc'").collect()}
    assert set(full) == set(VOTE_SIZES)
    assert all(full[n].u_circ >= few[n].u_circ for n in few) and any(full[n].u_circ > few[n].u_circ for n in few)
