"""Largest assignments and the anchor choice that rests on them."""

import random

import pytest
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.functions.geo import coordinates
from rttscope.operators import selection
from rttscope.operators.assignment import HELD, assign


def largest(options, slots, taken=()):
    """Size of a largest matching, by augmenting paths one owner at a time."""
    nodes = {}
    for owner, place in options:
        nodes.setdefault(owner, []).extend((place, s) for s in range(1, slots + 1) if (place, s) not in taken)
    held = {}

    def serve(owner, seen):
        for node in nodes[owner]:
            if node not in seen:
                seen.add(node)
                if node not in held or serve(held[node], seen):
                    held[node] = owner
                    return True
        return False

    return sum(serve(o, set()) for o in nodes)


@pytest.mark.parametrize("seed", range(4))
def test_assignment_is_largest(spark, seed):
    rng = random.Random(seed)
    owners, places, slots = 14, (5, 9, 14, 6)[seed], (1, 1, 1, 2)[seed]
    pairs = sorted({(f"c{rng.randrange(owners)}", rng.randrange(places)) for _ in range(30)})
    table = spark.createDataFrame([(o, p, 100 * p + i, i) for i, (o, p) in enumerate(pairs)], "owner string, place long, item long, pref int")
    fixed = spark.createDataFrame([("home", 0, 1, 999)], HELD)
    got = assign(table, slots, fixed).collect()
    served = [r for r in got if r.owner != "home"]
    assert len(served) == largest(pairs, slots, {(0, 1)}) and len(got) == len(served) + 1
    assert len({r.owner for r in got}) == len(got) and len({(r.place, r.slot) for r in got}) == len(got)
    assert {(r.owner, r.place) for r in served} <= set(pairs) and all(1 <= r.slot <= slots for r in got)


def test_a_chain_of_exchanges_serves_everyone(spark):
    # c0 only likes place 0, c1 places 0 and 1, ...: serving c0 last moves all others along
    rows = [(f"c{k}", p, 10 * k + p, 0 if p == max(k - 1, 0) else 1) for k in range(8) for p in {max(k - 1, 0), k}]
    got = assign(spark.createDataFrame(rows, "owner string, place long, item long, pref int"), 1).collect()
    assert {r.owner for r in got} == {f"c{k}" for k in range(8)}
    empty = spark.createDataFrame([], "owner string, place long, item long, pref int")
    assert assign(empty, 1).count() == 0


def anchors(spark, rows):
    df = spark.createDataFrame(rows, "anchor_id long, country string, continent string, asn_v4 long, lon double, lat double")
    return df.withColumn("coords", coordinates(F.col("lon"), F.col("lat")))


def test_countries_that_share_networks_all_get_a_place(spark):
    # country k has the networks k and k + 1; the home anchor takes network 1
    rows = [(1, "BR", "América do Sul", 1, -50.0, -10.0)]
    names = list(K.CONTINENT_QUOTAS)[:6]
    for k in range(1, 29):
        rows += [(10 * k + j, f"X{k:02d}", names[k % 6] if names[k % 6] != K.EUROPE or k < 25 else "Ásia", k + j, float(6 * k - 90), float(k)) for j in (0, 1)]
    chosen = selection.pick_anchors(anchors(spark, rows)).collect()
    assert len(chosen) == 29 and len({r.country for r in chosen}) == 29 and len({r.asn_v4 for r in chosen}) == 29
    assert {r.faixa_distancia for r in chosen} == set(K.BANDS)


def test_europe_is_cut_and_its_networks_serve_others(spark):
    rows = [(1, "BR", "América do Sul", 999, -50.0, -10.0)]
    rows += [(100 + k, f"E{k:02d}", K.EUROPE, k, float(k), 45.0) for k in range(20)]
    rows += [(200 + k, f"A{k:02d}", "África", k, float(k), 5.0) for k in range(20)]  # the same networks
    rows += [(300, "Q0", "Antártida", 50, 0.0, -80.0)]
    chosen = selection.pick_anchors(anchors(spark, rows)).collect()
    by = {}
    for r in chosen:
        by.setdefault(r.continent, []).append(r.asn_v4)
    assert len(by[K.EUROPE]) == K.MAX_EUROPE and len(by["Antártida"]) == 1 and len(by["África"]) == 20
    counts = [r.asn_v4 for r in chosen]
    assert max(counts.count(a) for a in counts) <= K.MAX_PER_ASN_FALLBACK


def test_free_places_go_to_the_emptiest_band(spark):
    # 10 far countries and 40 near ones of one continent: the far band fills up first
    rows = [(1, "BR", "América do Sul", 999, 0.0, 0.0)]
    rows += [(100 + k, f"N{k:02d}", "África", k, 1.0 + k / 10, 5.0) for k in range(40)]
    rows += [(200 + k, f"F{k:02d}", "África", 100 + k, 170.0, 1.0 + k) for k in range(10)]
    rows += [(300 + k, f"M{k:02d}", "África", 200 + k, 70.0, 1.0 + k) for k in range(10)]
    bands = [r.faixa_distancia for r in selection.pick_anchors(anchors(spark, rows)).collect()]
    assert len(bands) == 30 and sorted(bands.count(b) for b in K.BANDS) == [10, 10, 10]
