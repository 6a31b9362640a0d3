"""Filter audit, source mix and conversation repair: SQL on odd rows, brute force, long and hot groups."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations, product

import duckdb
import numpy as np
import pytest

from rttscope.llm import checks, filter_audit, mixing, queries, repair


def as_sql(name, **tables):
    """Rows of an operator's SQL check over the given DataFrames."""
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(table, df.toArrow())
    found = con.execute(checks.ORACLE[name])
    return [d[0] for d in found.description], found.fetchall()


def same_rows(df, name, **tables):
    cols, want = as_sql(name, **tables)
    assert sorted(cols) == sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, want))
    return got


@pytest.fixture(scope="module")
def mixed(spark, odd):
    """Odd rows with further sources, parts, repeated ids, a hot group of copies and clashing column names."""
    more = [(100 + i, f"word{i} " * (1 + i * 7 % 90), ["en", "", None, "de"][i % 4], [None, "", "Z", "a", "é", "\U0001f600"][i % 6], "k", i, "r") for i in range(60)]
    more += [(500 + i, "the same hot text again " * 60, "en", "hot", "k", 1, "r") for i in range(40)] + [(501, "the same hot text again " * 60, "en", "hot", "k", 1, "r")]
    more += [(i, "ABC DEF # " * 40, "de", "nothing", "k", 1, "r") for i in (7, 7, 8)] + [(900, " \n", "en", "empty", "k", 1, "r")]
    rows = odd.unionByName(spark.createDataFrame(more, odd.schema))
    return rows.selectExpr("*", "'x' part", "1 id", "2 n", "3 mask", "'d' digest", "4 rank", "5 size", "6 target", "7 chance", "8 goal", "9 source_size", "10 own")


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(i, i % 2, i % 3 % 2) for i in range(0, 600, 3)] + [(7, 1, None), (7, 0, 1), (None, 1, 1), (8, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "1 good", "'y' part")


def test_audit_of_odd_rows(mixed, marks, none):
    got = same_rows(filter_audit.audit(mixed, marks), "op11_filter_audit", documents=mixed, labels=marks)
    assert len(got) == 600 * len({r.lang or "" for r in mixed.select("lang").collect()})
    assert filter_audit.audit(none, marks).count() == 0
    same_rows(filter_audit.audit(mixed, marks.where("false")), "op11_filter_audit", documents=mixed, labels=marks.where("false"))


def test_audit_counts_by_walking_every_document(mixed, marks):
    docs = [(r.doc_id, r.text or "", r.lang or "") for r in mixed.collect()]
    good = {r.doc_id for r in marks.collect() if r.quality == 1} - {None}
    toxic = {r.doc_id for r in marks.collect() if r.toxic == 1} - {None}
    ids = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            ids[t].append(i)
    fails = []
    for i, t, part in docs:
        w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if x]
        mine = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
                "E": i is not None and min(ids[t]) < i}
        fails.append((i, part, {f for f, x in mine.items() if x}))
    want = Counter()
    for order in map("".join, permutations("ABCDE")):
        for i, part, bad in fails:
            there = True
            for step, f in enumerate(order, 1):
                now = there and f not in bad
                for name, x in (("kept", now), ("removed", there and f in bad), ("redundant", not there and f in bad), ("unique_fails", bad == {f}),
                                ("good_lost", there and f in bad and i in good), ("toxic_lost", there and f in bad and i in toxic)):
                    want[part, order, step, name] += x
                want[part, f] += there and f in bad
                there = now
    for r in filter_audit.audit(mixed, marks).collect():
        assert all(r[name] == want[r.part, r.filter_order, r.step, name] for name in filter_audit.FIELDS)
        assert r.shapley == want[r.part, r.filter_order[r.step - 1]]


def test_mix_of_odd_rows(mixed, none):
    planned = mixing.plan(mixed)
    table = planned.selectExpr("doc_id", "size", "source_size", "target", "copies * size taken")
    same_rows(table, "op12_mixing", documents=mixed)
    assert sorted(map(repr, table.collect())) == sorted(map(repr, mixing.plan(mixed.repartition(5)).selectExpr("doc_id", "size", "source_size", "target", "copies * size taken").collect()))
    emitted = Counter(map(repr, mixing.mix(mixed).collect()))
    rows = Counter(map(repr, mixed.collect()))
    assert mixing.mix(mixed).columns == mixed.columns and set(emitted) <= set(rows)
    assert sum(emitted.values()) == sum(r.copies for r in planned.collect())
    assert all(n <= 2 * rows[r] for r, n in emitted.items())
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def brute_targets(sizes):
    """Excess above twice a source's size goes to the others by weight, round by round, in fractions."""
    from fractions import Fraction

    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, free, out = Fraction(3 * sum(sizes.values()), 2), set(names), {}
    while free:
        each = left / sum(weight[s] for s in free)
        over = [s for s in free if each * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: each * weight[s] for s in free}
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_rounds_in_fractions(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{k}" if k else None: int(x) for k, x in enumerate(rng.integers(0, 10 ** rng.integers(1, 14, 23)))} | {"": 0, "é": 5}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(float(want[s]), rel=1e-12) for s in want)
    assert sum(want.values()) * 2 == 3 * sum(sizes.values())


def test_mix_meets_its_targets(spark, sf):
    taken, goal, spread = Counter(), {}, Counter()
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op12_mixing(spark, sf).collect():
        s = docs[r.doc_id]
        taken[s] += r.taken
        goal[s] = r.target
        spread[s] += r.size**2 / 4
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - goal[s]) <= 4 * spread[s] ** 0.5 for s in goal)


# repair

def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        yield from [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)


def mend(rows):
    """Cheapest edits by Dijkstra-free dynamic programming over whole strings: small and plain."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).digest()))
    space, faults, seen = " \t\n\v\f\r", [], set()
    for _, role, text in rows:
        body = text.rstrip(space)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {(len(rows), s): (x * 3, "I" * x, made) for s, x, made in ((0, 0, []), (1, 2, ["user:", "assistant:"]), (2, 1, ["assistant:"]), (3, 0, []))}
    step = lambda state, initial: {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(initial, {}).get(state)
    for i in range(len(rows) - 1, -1, -1):
        _, role, text = rows[i]
        own = {}
        for state in range(4):
            need = "assistant" if state == 2 else "user"
            add = lambda cost, edit, to, made: (best[i + 1, to][0] + cost, edit + best[i + 1, to][1], made + best[i + 1, to][2])
            options = [add(4, "D", state, [])]
            if faults[i] not in ("blank", "duplicate"):
                cut = 3 * (faults[i] == "truncated")
                options.append(add(3 + cut, "R", step(state, need[0]), [f"{need}:{text}"]))
                if step(state, role[:1]) is not None:
                    options.append(add(cut, "K", step(state, role[:1]), [f"{role}:{text}"]))
            own[state] = min(options)
        for _ in range(4):
            for state in range(4):
                need = "assistant" if state == 2 else "user"
                cost, audit, made = own[step(state, need[0])]
                own[state] = min(own[state], (cost + 3, "I" + audit, [f"{need}:"] + made))
        best |= {(i, s): x for s, x in own.items()}
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, made = best[0, 0]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha256("\n".join(made).encode()).hexdigest())


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check_repair(spark, rows, **options):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 copies", "'x' segment", "'y' rid", "'z' token", "2 low", "3 digest")
    by = {r[0]: [] for r in rows}
    for conv, *row in damaged(rows):
        by[conv].append(tuple(row))
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in repair.summary(table, **options).collect()}
    want = {conv: mend(x) for conv, x in by.items()}
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv
    return table


ROLES = ["user", "assistant", "system", "tool", "", None, "sys", "u", "Assistant"]
WORDS = ["Yes.", "No", "Go on!", " ", "", None, "ok?\n", "Naïve é.", "end. x"]


def random_rows(rng, convs, most, like=ROLES):
    rows = []
    for conv in range(convs):
        for k in range(int(rng.integers(0, most)) + 1):
            turn = None if rng.random() < 0.05 else int(k if rng.random() < 0.8 else rng.integers(0, most))
            rows.append((None if conv == 3 else conv, turn, like[rng.integers(len(like))], f"{k}: {WORDS[rng.integers(2)]}" if rng.random() < 0.5 else WORDS[rng.integers(len(WORDS))]))
    return rows


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_repair_matches_brute_force(spark, bits):
    rng = np.random.default_rng(bits)
    rows = random_rows(rng, 60, 12) + random_rows(rng, 3, 90, ROLES[:3])
    table = check_repair(spark, rows + rows[:40], segment_bits=bits)
    same_rows(repair.summary(table, segment_bits=bits), "op13_repair", conversations=table)


def test_repair_of_every_short_role_sequence(spark):
    rows = []
    for conv, roles in enumerate(product("sua", repeat=4)):
        rows += [(conv, 7 * conv + k, {"s": "system", "u": "user", "a": "assistant"}[r], f"{conv} {k}.") for k, r in enumerate(roles)]
    check_repair(spark, rows, segment_bits=2)


def test_repair_of_long_and_repeated_rows(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k}" + "." * (k % 5 > 0)) for k in range(9000)]
    rows += [(2, 5, "user", "the same.")] * 4000 + [(3, None, None, None)] * 50 + [(4, 1, "user", "x" * 200_000 + ".")]
    check_repair(spark, rows)
    assert repair.summary(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_ranks_choose_the_least_audit():
    # 0 -K-> 1 -R-> 3; 0 -I-> 2 -K-> 4 -D-> 3; node 3 ends
    target = np.full((5, 5), -1, np.int64)
    target[0, repair.K], target[0, repair.I], target[1, repair.R], target[2, repair.K], target[4, repair.D] = 1, 2, 3, 4, 3
    path, edits = repair.least_paths(target, np.array([0, 1]))
    assert [e for e in edits[0].tolist() if e] == [repair.I, repair.K, repair.D] and path[0].tolist()[:4] == [0, 2, 4, 3]
    assert [e for e in edits[1].tolist() if e] == [repair.R]
