"""Edits tried one after another, and fits that end by the operator's own stop rule."""

from pathlib import Path

import numpy as np
import pytest

from tests.test_generation import DOMAIN, table
from veiltab.operators import measure as ms
from veiltab.operators.edits import Edits, expand_operators, from_state, to_state
from veiltab.operators.marginals import Marginals, column_sets
from veiltab.operators.modules import Chain
from veiltab.operators.rounds import ArrayRounds
from veiltab.plans import queries_synth as q
from veiltab.plans.generator import DEFAULT_OPERATORS, Generator
from veiltab.session import Workspace, shuffles_dropped


@pytest.mark.parametrize("singly", [10, 1 << 15])
def test_edits_one_after_another(spark, singly):
    m, n = Marginals(DOMAIN, column_sets(DOMAIN, 2), 3), 3000
    df = table(spark, n)
    g = Generator(m, n, "s", run="singly")
    work = Workspace(spark, "singly")
    targets = work.write(ms.measure_all(Chain([m]), df, n, 1e4, "s", "r"), "targets")
    edits = Edits(g.targets, n, expand_operators(DEFAULT_OPERATORS, DOMAIN), "s", "singly", 4)
    state = work.write(to_state(g.start_table(spark), DOMAIN, 3), "state")
    res = g.residuals(targets, from_state(state, DOMAIN))
    plain = ArrayRounds(edits, state, res, Workspace(spark, "plain"))
    one = ArrayRounds(edits, state, res, work, singly)
    weights = [1.0 / len(edits.operators)] * len(edits.operators)
    plain.step(state, 1, weights)
    for k in (1, 2, 3):
        before = one.distance
        state, pick, tally = one.step(state, k, weights)
        if k == 1:
            assert one.distance <= plain.distance  # that of the best nested set
        assert pick is not None and one.distance < before and sum(kept for _, kept in tally) > 0
        rows = from_state(state, DOMAIN)
        left = g.residuals(targets, rows).toPandas()["r"]
        assert float(np.sum(left**2)) == pytest.approx(one.distance, rel=1e-9)  # as a recount has it
        assert rows.count() == rows.select("row_id").distinct().count() == n
        assert one.counts == edits.bin_counts(state)


class Seen(Exception):
    pass


def test_registered_fits_end_by_the_stop_rule_itself(spark, sf, monkeypatch):
    """Neither threshold, window nor least rounds are looser than the operator's own."""
    seen = []

    def fit(self, *_):
        seen.append((self.stop_threshold, self.stop_window, self.min_rounds, self.rounds))
        raise Seen

    monkeypatch.setattr(Generator, "fit", fit)
    for name in (q.h12, q.h14, q.i4):
        with pytest.raises(Seen):
            name(spark, sf)
    assert seen == [(1e-4, 5, 10, 1000)] * 3


def test_a_search_keeps_only_the_tables_it_reads(spark):
    """Before: two states and two scored tables stayed for as long as the session."""
    m, n = Marginals(DOMAIN, column_sets(DOMAIN, 2), 3), 2000
    targets = Workspace(spark, "given").write(ms.measure_all(Chain([m]), table(spark, n), n, 1e4, "s", "r"), "targets")
    g = Generator(m, n, "s", run="kept", rounds=3)
    held = lambda fitted: sorted(p.name.split("-")[0] for p in Path(fitted.work.path).glob("*"))
    first = g.fit(targets)
    assert held(first).count("scored") == 1 and "state" not in held(first) and first.table.count() == n
    more = g.fit(targets, first.table, on_start=first.work.close)
    assert held(more).count("scored") == 1 and "state" not in held(more) and not Path(first.work.path).exists()
    assert more.log[0][1] == pytest.approx(first.log[-1][1], rel=1e-9) and more.table.count() == n


def test_shuffle_files_go_with_their_action(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with shuffles_dropped(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before
