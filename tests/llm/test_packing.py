import pickle
from fractions import Fraction

import numpy as np
import pytest

from tracklathe.llm import packing


def one_by_one(totals, weights, window):
    """Token counts by window and queue, one token after another: next is the queue whose allotment is half a token ahead first."""
    given, out = [0] * len(totals), []
    while any(g < n for g, n in zip(given, totals)):
        row = [0] * len(totals)
        while sum(row) < window and any(g < n for g, n in zip(given, totals)):
            k = min((k for k in range(len(totals)) if given[k] < totals[k]), key=lambda k: (Fraction(2 * given[k] + 1, 2) / Fraction(weights[k]), k))
            given[k] += 1
            row[k] += 1
        out.append(row)
    return out


@pytest.mark.parametrize(("totals", "weights", "window"), [([1000, 500, 70], [1, 2, 1], 32), ([5], [1], 8), ([900, 900], [1, 1], 7), ([4000, 3, 500], [5, 1, 0.0625], 16), ([64, 64, 64], [1, 1, 1], 64), ([300, 200, 100, 400], [0.5, 1.5, 0.125, 3], 10)])
def test_plan_equals_token_by_token(totals, weights, window):
    plan = packing.Plan(np.array(totals), np.array(weights, float), window)
    wanted = one_by_one(totals, weights, window)
    for k in range(len(totals)):
        lo, hi, off = plan.begin(k, np.arange(len(wanted)))
        assert (hi - lo).tolist() == [t[k] for t in wanted]
        assert off.tolist() == [sum(t[:k]) for t in wanted]
        assert plan.window_of(k, np.arange(totals[k])).tolist() == [w for w, t in enumerate(wanted) for _ in range(t[k])]
    assert all(sum(t) == window for t in wanted[:-1])


def test_deficits_carry_past_a_queue_that_runs_dry():
    totals, weights, window = [10_000, 37, 10_000, 411], [3.0, 1.0, 1.7, 0.9], 50
    plan = packing.Plan(np.array(totals), np.array(weights), window)
    given = plan.before(np.arange(100, 200))
    assert (given[:, 1] == 37).all()
    assert np.abs(given[:, 0] / 3.0 - given[:, 2] / 1.7).max() <= 0.5 / 3.0 + 0.5 / 1.7 + 1e-9


def test_many_queues_take_little_memory():
    rng = np.random.default_rng(0)
    totals, weights = rng.integers(1, 10**9, 2000), rng.uniform(0.1, 9, 2000)
    plan = packing.Plan(totals, weights)
    assert len(pickle.dumps(plan)) < 2000 * 40
    w = np.arange(10**8, 10**8 + 50)
    given = plan.before(w)
    assert (given.sum(1) == np.minimum(w * packing.WINDOW, totals.sum())).all() and (np.diff(given, axis=0) >= 0).all()


def test_weights_must_be_positive():
    with pytest.raises(ValueError):
        packing.Plan(np.array([1]), np.array([0.0]))


def test_shares_hold_to_a_token():
    plan = packing.Plan(np.array([10**6, 10**6, 10**6]), np.array([3.0, 2.0, 1.0]), 100)
    for k, share in enumerate((1 / 2, 1 / 3, 1 / 6)):
        given = plan.begin(k, np.arange(5000))[1]
        assert np.abs(given - share * 100 * np.arange(1, 5001)).max() <= 2


def windows(rows):
    found = {}
    for r in rows:
        found.setdefault(r["window_id"], []).append((r["window_offset"], r["n_tokens"]))
    return found


def test_every_token_once(spark, make):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "en", f"s{i % 3}", 0) for i in range(200)]
    out = packing.pack(make(rows), window=50, weights={"s0": 3.0}, buckets=4).collect()
    have = {}
    for r in out:
        have.setdefault(r["doc_id"], []).extend(range(r["doc_start"], r["doc_start"] + r["n_tokens"]))
    assert {d: sorted(t) for d, t in have.items()} == {r[0]: list(range(len(r[1].split()))) for r in rows}
    full = windows(out)
    last = max(full)
    for w, parts in full.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == 50 or w == last


def test_odd_rows(odd):
    out = packing.pack(odd, window=1000).collect()
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == {1: 8, None: 4, 5: 60_000, 6: 1, 7: 3}
    assert {r["source"] for r in out} == {"a", "b", "", None}


def test_no_rows(none):
    assert packing.pack(none).count() == 0
