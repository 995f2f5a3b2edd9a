"""Untidy random tables against a row-by-row computation in plain Python."""

import datetime as dt
import random
from collections import defaultdict
from itertools import product

import pytest

from ledgerpulse.operators import cohorts, revenue
from ledgerpulse.operators.merge import merge_datasets


def month(text):
    return dt.date.fromisoformat(text).replace(day=1)


@pytest.fixture(scope="module", params=[1, 2, 3])
def rows(request):
    chance = random.Random(request.param)
    ids = [None, "", "C1", "C2", "C3", "C4", "C5"]

    def day(start, span):
        return (dt.date(2023, start, 1) + dt.timedelta(days=chance.randrange(span))).isoformat()

    subs = [
        (chance.choice(ids), None if chance.random() < 0.1 else day(6, 250),
         None if chance.random() < 0.2 else float(chance.randrange(500)), chance.randrange(2))
        for _ in range(150)
    ]
    # some customers are listed twice, some never, one id is missing, some have no signup date
    listed = [(chance.choice(ids), None if chance.random() < 0.2 else day(1, 120)) for _ in range(8)]
    return subs, listed


def test_series(rows, periods):
    subs, _ = rows
    active, everyone, churned = defaultdict(list), defaultdict(set), defaultdict(set)
    for customer, start, money, flag in subs:
        if start is None:
            continue
        if not flag:
            active[month(start)].append((customer, money))
        everyone[month(start)].update([customer] if customer is not None else [])
        if flag and customer is not None:
            churned[month(start)].add(customer)
    mrr = {m: sum(v or 0.0 for _, v in entries) for m, entries in active.items()}
    df = periods(subs)
    assert {r.date: r.MRR for r in revenue.mrr_series(df).collect()} == mrr
    assert {r.date: (r.customers_start, r.churned) for r in revenue.churn_series(df).collect()} == {
        m: (len(c), len(churned[m])) for m, c in everyone.items()
    }
    users = {m: len({c for c, _ in entries if c is not None}) for m, entries in active.items()}
    arpu = {m: mrr[m] / n if n else None for m, n in users.items()}
    found = {r.date: r.ARPU for r in revenue.arpu_series(df).collect()}
    assert found.keys() == arpu.keys() and all(found[m] == pytest.approx(v) for m, v in arpu.items())
    kpis = revenue.dashboard_kpis(df).first()
    # a month whose rows all lack a customer stays in the series with a rate of 0
    last, rate = max(mrr), len(churned[max(everyone)]) / max(len(everyone[max(everyone)]), 1) * 100
    assert kpis.current_mrr == mrr[last] and kpis.arpu == pytest.approx(arpu[last] or 0.0)
    assert kpis.churn_rate == pytest.approx(rate)
    assert kpis.active_customers == len({c for c, _, _, flag in subs if not flag and c is not None})
    totals = defaultdict(float)
    for customer, _, money, _ in subs:
        if customer is not None:
            totals[customer] += money or 0.0
    assert revenue.lifetime_value(df, "cohort").first().clv == pytest.approx(sum(totals.values()) / len(totals))
    series = [mrr[m] for m in sorted(mrr)]
    growth = revenue.growth_metrics(df).first()
    assert growth.mrr_growth_mom == pytest.approx((series[-1] / series[-2] - 1) * 100, abs=0.006)
    recent, earlier = series[-3:], series[-6:-3]
    assert growth.mrr_growth_qoq == pytest.approx((sum(recent) / 3 / (sum(earlier) / len(earlier)) - 1) * 100, abs=0.006)


def test_cohorts(rows, periods, people):
    subs, listed = rows
    cells, members = defaultdict(list), defaultdict(set)
    for (customer, start, _, flag), (other, signup) in product(subs, listed):
        if customer != other or start is None or signup is None:
            continue
        a, b = month(start), month(signup)
        cells[b, (a.year - b.year) * 12 + a.month - b.month].append((customer, not flag))
        if customer is not None:
            members[b].add(customer)
    expected = {
        key: (len({c for c, _ in entries if c is not None}), sum(on for _, on in entries), len(members[key[0]]))
        for key, entries in cells.items()
    }
    grid = cohorts.cohort_grid(periods(subs), people([(c, s, "pro", "SMB", 1.0) for c, s in listed])).collect()
    assert {(r.cohort, r.months_since_signup): (r.customer_id, r.active, r.cohort_size) for r in grid} == expected


def test_merge(rows, periods, people):
    subs, listed = rows
    expected = sorted(
        (f"S{i:03d}", signup or "")
        for i, (customer, *_) in enumerate(subs)
        for signup in ([s for c, s in listed if c == customer] or [None])
    )
    merged = merge_datasets(periods(subs), people([(c, s, "pro", "SMB", 1.0) for c, s in listed])).collect()
    assert sorted((r.subscription_id, str(r.signup_date.date()) if r.signup_date else "") for r in merged) == expected
