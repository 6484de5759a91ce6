"""Follow-ups against a plain walk over the same answers."""

import random

from attestor.operators import pivots

KINDS = ["DOMAIN", "SUBDOMAIN", "IP", "URL", "EMAIL"]


def walk(target, found, answers, depth, budget):
    """Depth first: every level looks at all that is known by now."""
    known, order, log, visited = {}, [], [], {target}
    left = budget

    def add(rows):
        new = 0
        for _, kind, value, sure in sorted(rows):
            if value is not None and (kind, value) not in known:
                known[kind, value] = sure
                order.append((kind, value))
                new += 1
        return new

    def go(levels, path):
        nonlocal left
        if levels <= 0 or left <= 0:
            return
        most = min({1: 5, 2: 3}.get(levels, 2), left)
        fit = [e for e in order if e[0] in KINDS[:3] and e[1] not in visited and known[e] in ("CONFIRMED", "HIGH") and not (e[0] == "IP" and e[1].startswith("10.")) and e in answers]
        taken = 0
        for e in fit:
            if taken >= most or left <= 0:
                break
            visited.add(e[1])
            new = add(answers[e])
            taken, left = taken + 1, left - 1
            here = f"{path}.{budget - left}" if path else str(budget - left)
            log.append((budget - left, levels, here, e[0], e[1], new, left))
            go(levels - 1, here)

    add(found)
    go(depth, "")
    return log, order


def graph(seed):
    rng = random.Random(seed)
    nodes = [(KINDS[k % 5], f"{'10.0' if k % 3 == 0 else '8.8'}.0.{k}" if k % 5 == 2 else f"n{k}.example") for k in range(30)]
    few = lambda: [(rng.randrange(3), *rng.choice(nodes), rng.choice(["CONFIRMED", "HIGH", "HIGH", "LOW"])) for _ in range(rng.randrange(6))]
    answers = {n: few() for n in nodes if rng.random() < 0.8}
    return nodes, answers, {c: (rng.choice(nodes)[1], few()) for c in range(25)}


def once(rows):
    """Of equal (ord, kind, value) only the lowest confidence counts, so that order is total."""
    out = {}
    for r in sorted(rows):
        out.setdefault(r[1:3], r)
    return list(out.values())


def test_equal_to_a_walk(spark):
    spent = set()
    for seed, depth, budget in ((1, 3, 5), (2, 2, 30), (4, 4, 7)):
        nodes, answers, cases = graph(seed)
        answers = {n: once(rows) for n, rows in answers.items()}
        landed = [(*n, *r) for n, rows in answers.items() for r in rows or [(0, None, None, None)]]
        a = spark.createDataFrame(landed, "on_kind string, on string, ord long, kind string, value string, confidence string").repartition(3)
        f = spark.createDataFrame([(c, *r) for c, (_, rows) in cases.items() for r in rows], "case long, ord long, kind string, value string, confidence string").repartition(3)
        c = spark.createDataFrame([(c, t) for c, (t, _) in cases.items()], "case long, target string")
        log, entities = pivots.auto_pivots(c, f, a, depth, budget)
        got = {(r["case"], r["step"]): (r["step"], r["depth"], r["path"], r["kind"], r["target"], r["new"], r["left"]) for r in log.collect()}
        have = {(r["case"], r["kind"], r["value"]) for r in entities.collect()}
        want, all_known = {}, set()
        for k, (target, found) in cases.items():
            steps, order = walk(target, once(found), answers, depth, budget)
            want |= {(k, s[0]): s for s in steps}
            all_known |= {(k, *e) for e in order}
        assert got == want and have == all_known
        spent |= {budget - s for _, s in got}
    assert 0 in spent  # a budget is used up


def test_no_cases(spark):
    c = spark.createDataFrame([], "case long, target string")
    f = spark.createDataFrame([], "case long, ord long, kind string, value string, confidence string")
    a = spark.createDataFrame([], "on_kind string, on string, ord long, kind string, value string, confidence string")
    log, entities = pivots.auto_pivots(c, f, a)
    assert log.collect() == entities.collect() == []


def test_accepted_pivots_are_searched_for_and_not_proposed_again(spark):
    i = spark.createDataFrame([(1, "username", "@Bob", "bio_handle", "s", 1), (1, "domain", "a.example", "website", "s", 2), (1, "username", "op", "bio_handle", "s", 3), (2, "email", "x@y.zz", "seen", "s", 4)], "case long, kind string, value string, rule string, source string, ord long")
    leads = spark.createDataFrame([(1, "username", "op")], "case long, kind string, norm string")
    urls = spark.createDataFrame([], "case long, url string")
    landed = spark.createDataFrame([("username", "bob", "email", "b@c.dd", "r", "s", 9), ("username", "bob", "username", "BOB", "r", "s", 8), ("email", "b@c.dd", "domain", "never.example", "r", "s", 7)], "on_kind string, on string, kind string, value string, rule string, source string, ord long")
    got = {(r["case"], r["depth"], r["kind"], r["norm"]): r["reason"] for r in pivots.search_loop(i, leads, urls, landed, budget=3).collect()}
    assert got == {
        (1, 1, "domain", "a.example"): None, (1, 1, "username", "bob"): None, (1, 1, "username", "op"): "not_novel", (2, 1, "email", "x@y.zz"): None,
        (1, 2, "domain", "a.example"): "duplicate", (1, 2, "username", "bob"): "duplicate", (1, 2, "username", "op"): "not_novel", (2, 2, "email", "x@y.zz"): "duplicate", (1, 2, "email", "b@c.dd"): None,
    }
