"""Sequence programs against plain loops: evaluation, recognition of all families, tiers, and cases drawn until they are fair."""

import json
from itertools import product
from math import comb

import pytest

from quorate.functions import programs
from quorate.operators import cases
from quorate.plans import generated

DATA = "/root/testdata/sf0.001"


def value(c, x):
    return sum(a * comb(x, j) for j, a in enumerate(c))


def terms(p, n):
    family, shape, seeds, rows = p
    if family == "POLY":
        return [value(rows[0], i) for i in range(n)]
    if family == "GROWBLOCK":
        out, block = [], 0
        while len(out) < n:
            out += [value(rows[0], block) + t * value(rows[1], block) for t in range(shape[0] + block)]
            block += 1
        return out[:n]
    if family == "INTERLEAVE":
        k = shape[0]
        each = []
        for kind, seed, row in zip(shape[1:], seeds, rows, strict=True):
            v = [seed]
            while len(v) < n:
                v.append(row[0] * v[-1] + row[1])
            each.append([value(row, i) for i in range(n)] if kind else v)
        return [each[i % k][i // k] for i in range(n)]
    out = list(seeds)
    while len(out) < n:
        i = len(out)
        if family == "PDELTA":
            out.append(out[-1] + value(rows[(i - 1) % shape[0]], (i - 1) // shape[0]))
        elif family == "AFFINE":
            r = (i - 1) % shape[0]
            out.append(rows[0][r] * out[-1] + rows[1][r])
        elif family == "LIN2":
            out.append(rows[0][0] * out[-1] + rows[0][1] * out[-2] + rows[1][(i - 2) % shape[0]])
        elif family == "LAGPOLY":
            out.append(out[i - shape[0]] + value(rows[i % shape[0]], i // shape[0] - 1))
        else:
            r = (i - 1) % shape[0]
            out.append((rows[0][r] * out[-1] + rows[1][r]) % shape[1])
    return out[:n]


def fitted(v, degree):
    row, c = list(v), []
    if len(v) <= degree:
        return None
    for _ in range(degree + 1):
        c.append(row[0])
        row = [b - a for a, b in zip(row, row[1:], strict=False)]
    return tuple(c) if all(value(c, i) == x for i, x in enumerate(v)) else None


def within(c, most=9):
    return all(abs(x) <= most for x in c)


def as_poly(c):
    return c is not None and abs(c[0]) <= 30 and within(c[1:])


def candidates(x):
    """Every program of every family, tried one by one: it is kept if its terms are the prefix."""
    tries = []
    tries += [("POLY", (d,), (), (c,)) for d in range(2, 6) for c in [fitted(x, d)] if as_poly(c) and c[-1]]
    delta = [b - a for a, b in zip(x, x[1:], strict=False)]
    for p, d in programs.PDELTA_SHAPES:
        rows = tuple(fitted(delta[r::p], d) for r in range(p))
        if None not in rows and len(set(rows)) > 1 and all(map(within, rows)) and abs(x[0]) <= 30:
            tries.append(("PDELTA", (p, d), (x[0],), rows))
    for p in (1, 2, 3):
        for m in product(programs.MULTIPLIERS, repeat=p):
            b = tuple(x[r + 1] - m[r] * x[r] for r in range(p))
            if within(b) and abs(x[0]) <= 30:
                tries.append(("AFFINE", (p,), (x[0],), (m, b)))
        for w in product(programs.WEIGHTS, repeat=2):
            b = tuple(x[r + 2] - w[0] * x[r + 1] - w[1] * x[r] for r in range(p))
            if within(b) and within(x[:2], 30):
                tries.append(("LIN2", (p,), tuple(x[:2]), (w, b)))
    for lag, d in programs.LAGPOLY_SHAPES:
        rows = tuple(fitted([b - a for a, b in zip(x[r::lag], x[r + lag :: lag], strict=False)], d) for r in range(lag))
        if None not in rows and len(set(rows)) > 1 and all(map(within, rows)) and within(x[:lag], 30):
            tries.append(("LAGPOLY", (lag, d), tuple(x[:lag]), rows))
    for k in (2, 3):
        options = []
        for r in range(k):
            v = x[r::k]
            own = [(d, 0, c) for d in (1, 2, 3) for c in [fitted(v, d)] if as_poly(c) and c[-1]]
            own += [(0, v[0], (m, v[1] - m * v[0])) for m in programs.STRAND_MULTIPLIERS if abs(v[0]) <= 30 and abs(v[1] - m * v[0]) <= 9]
            options.append(own)
        for o in product(*options):
            if len({tuple(terms(("INTERLEAVE", (1, a[0]), (a[1],), (a[2],)), 9)) for a in o}) == k:
                tries.append(("INTERLEAVE", (k, *[a[0] for a in o]), tuple(a[1] for a in o), tuple(a[2] for a in o)))
    for l0 in (1, 2):
        starts, seen, at, block = [], [], 0, 0
        while at < len(x):
            starts.append(x[at])
            if l0 + block > 1 and at + 1 < len(x):
                seen.append((block, x[at + 1] - x[at]))
            at, block = at + l0 + block, block + 1
        slopes = {0: (seen[0][1],), 1: (seen[0][1] - (seen[1][1] - seen[0][1]) * seen[0][0], seen[1][1] - seen[0][1]) if len(seen) > 1 else None}
        for dv, dd in product((1, 2, 3), (0, 1)):
            v, d = fitted(starts, dv), slopes[dd]
            if as_poly(v) and d and within(d) and any(d):
                tries.append(("GROWBLOCK", (l0, dv, dd), (), (v, d)))
    for mod in programs.PRIMES:
        if 0 <= min(x) and max(x) < mod:
            for p in (1, 2):
                for m in product(range(2, 10), repeat=p):
                    b = tuple((x[r + 1] - m[r] * x[r]) % mod for r in range(p))
                    tries.append(("MODAFFINE", (p, mod), (x[0],), (m, b)))
    return {p for p in tries if terms(p, len(x)) == list(x)}


def plain(p):
    p = json.loads(p) if isinstance(p, str) else p.asDict()
    return p["family"], tuple(p["shape"]), tuple(p["seeds"]), tuple(map(tuple, p["rows"]))


@pytest.fixture(scope="module")
def drawn(spark):
    return {(r.r_name, r.family, r.tier): (plain(r.program), json.loads(r.terms)) for r in generated.seq02_families(spark, DATA).collect()}


def test_programs_are_evaluated(drawn):
    assert len(drawn) == 5 * 24 and {p[0] for p, _ in drawn.values()} == set(cases.FAMILIES)
    for p, got in drawn.values():
        assert got == terms(p, 12), p


def test_all_programs_of_a_prefix_are_found(spark, drawn):
    got = {k: set() for k in drawn}
    for r in generated.seq03_families(spark, DATA).collect():
        got[r.r_name, r.family, r.tier].add(plain(r.program))
    for k, (_, x) in drawn.items():
        assert got[k] == candidates(x), (k, x)


def test_audit_of_ambiguity(spark, drawn):
    got = generated.seq04_families(spark, DATA).collect()
    tier = lambda p: least_tier(p)
    want = {}
    for (region, family, level), (p, _) in drawn.items():
        n = cases.VISIBLE[level]
        v = terms(p, 25)
        for probe in {n, n - 2, n - 4}:
            found = candidates(v[:probe])
            if found:
                want[region, family, level, probe] = (len(found), ",".join(sorted({q[0] for q in found})), len({tuple(terms(q, 25)) for q in found}), len({tuple(terms(q, n + 5)[n:]) for q in found}), sum(tier(q) < tier(p) for q in found), tuple(v) in {tuple(terms(q, 25)) for q in found})
    assert {(r.r_name, r.family, r.tier, r.probe): (r.candidates, r.families, r.sequences, r.continuations, r.lower_tier, r.itself) for r in got} == want


def least_tier(p):
    family, shape = p[0], p[1]
    if family == "POLY":
        return max(1, shape[0] - 2)
    if family in ("AFFINE", "LIN2"):
        return shape[0]
    if family in ("PDELTA", "LAGPOLY"):
        return 1 if shape == (2, 0) else 2 if shape in ((2, 1), (3, 1)) else 3
    if family == "INTERLEAVE":
        return 3 if max(shape[1:]) > 2 else 1 if shape[0] == 2 else 2
    if family == "GROWBLOCK":
        return shape[1]
    return 1 if shape[0] == 1 and shape[1] <= 43 else 2 if shape[0] == 1 or shape[1] < 53 else 3


def test_cases_are_fair_and_not_ambiguous(spark):
    got = generated.seq06_families(spark, DATA).collect()
    assert len(got) == 5 * 24
    for r in got:
        p, n = plain(r.program), cases.VISIBLE[r.tier]
        v = terms(p, n + 5)
        assert json.loads(r.terms)[: n + 5] == v and r.visible == n
        found = candidates(v[:n])
        assert p in found and len(found) == r.candidates and {tuple(terms(q, n + 5)) for q in found} == {tuple(v)}
        assert r.tier == 3 or all(least_tier(q) >= least_tier(p) for q in found)
        assert len(set(v[:n])) >= 6 and max(map(abs, v[:n])) <= 10**9 and 1 <= r.attempt <= 20_000


def test_cases_are_verified(spark):
    got = generated.seq08_families(spark, DATA).collect()
    wrong = [(r.r_name, r.family, r.tier) for r in got if not (r.same_program and r.same_terms and r.fair and r.same_audit)]
    assert len(got) == 5 * 24 and wrong == [("ASIA", "POLY", 1)]
