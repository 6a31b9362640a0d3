"""Random forests whose trees are grown beside each other.

Rows are binned once.  Every draw (a row's copies in a tree's bootstrap, the features a node may cut by) is a hash of the row or
of the node's place, so a tree does not depend on partitions, on its depth limit or on the number of trees: the
forests of a grid that differ in these alone are cuts of one forest.

Of at most ``WHOLE`` rows, each task holds all and grows a set of whole trees, those of forests that differ in the least rows
of a leaf beside each other.  Of more rows, nodes of more than ``LOCAL`` rows are cut by histograms that all partitions
add up, and the rows of a smaller node are shuffled to one task, which grows the rest of that tree level by level.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, factorial

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rttscope import contract as K
from rttscope.session import materialise

CLASSES = len(K.CLASSES)
#: Bins per feature; rows that one task holds to grow whole trees (30 bytes each, and four times that while a tree grows);
#: rows of a bootstrap that one task grows a subtree from; rows coded or scored at a time.
BINS = 64
WHOLE = 2_500_000
LOCAL = 400_000
BLOCK = 50_000
#: Nodes of the trees that one task scores with, and rows that walk a tree together.
HELD_NODES = 1_000_000
SCORED = 16_384
NODE = np.dtype([("indice", "i1"), ("bin", "u1"), ("esquerda", "<i4"), ("direita", "<i4"), ("pesos", "<f4", CLASSES)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_seed(tree: int, salt: int) -> np.uint64:
    return mixed(np.array([(K.SEED << 40) + (salt << 32) + tree + 1], np.uint64))[0]


#: Copies of a row in a bootstrap (Poisson of mean 1), by 16 random bits.
POISSON = np.searchsorted(np.cumsum([exp(-1) / factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


def copies(hashes: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in the bootstrap of a tree."""
    return POISSON[(mixed(hashes ^ tree_seed(tree, 1)) >> np.uint64(48)).astype(np.int64)]


def drawn_features(tree: int, places: np.ndarray, features: int, tries: int) -> np.ndarray:
    """The features that the nodes at ``places`` (root 1, children 2p and 2p + 1) may cut by, one row per node."""
    keys = mixed(mixed(places.astype(np.uint64) ^ tree_seed(tree, 2))[:, None] + np.arange(1, features + 1, dtype=np.uint64)[None])
    return np.sort(np.argsort(keys, axis=1, kind="stable")[:, :tries], axis=1)


def tries(features: int) -> int:
    return int(np.ceil(np.sqrt(features)))


def best_cuts(parts: np.ndarray, nodes: np.ndarray, starts: np.ndarray, weights: np.ndarray, leasts: list[int]) -> list[tuple]:
    """(gain, cell, left counts) of the best cut behind a cell, per node, for each least number of rows of a side.

    ``parts`` has one row per class over the cells; cells come by node (``nodes``, each from ``starts`` on) and bin.
    The gain is 0 where no cut leaves enough rows.
    """
    sums = np.cumsum(parts, axis=1)
    base = sums[:, starts] - parts[:, starts]
    whole = np.append(base[:, 1:], sums[:, -1:], axis=1) - base
    below = sums.sum(0) - base.sum(0)[nodes]
    side = np.minimum(below, whole.sum(0)[nodes] - below)
    # an empty cell repeats the cut before it
    able = np.flatnonzero((side >= min(leasts)) & (parts.sum(0) > 0))

    def purity(counts):
        heavy = [p * w for p, w in zip(counts, weights)]
        return sum(h * h for h in heavy) / np.maximum(sum(heavy), 1e-300), sum(heavy)

    lefts = sums[:, able] - base[:, nodes[able]]
    value = purity(lefts)[0] + purity(whole[:, nodes[able]] - lefts)[0]
    before, weight = purity(whole)
    out = []
    for least in leasts:
        gain, cell, left = np.zeros(len(starts)), np.zeros(len(starts), np.int64), np.zeros((len(starts), CLASSES))
        out.append((gain, cell, left))
        mine = np.flatnonzero(side[able] >= least)
        if len(mine):
            of, worth = nodes[able[mine]], value[mine]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            found = of[first]
            best = np.maximum.reduceat(worth, first)
            at = np.flatnonzero(worth == np.repeat(best, np.diff(np.append(first, len(of)))))[::-1]
            cell[of[at]] = at  # the first of equal cuts
            chosen = mine[cell[found]]
            gain[found], cell[found], left[found] = (best - before[found]) / np.maximum(weight[found], 1e-300), able[chosen], lefts[:, chosen].T
    return out


def open_nodes(counts: np.ndarray, depth: int, limit: int, least: int) -> np.ndarray:
    """Which nodes may be cut further: not pure, below the depth limit, rows for two leaves."""
    return (depth < limit) & ((counts > 0).sum(1) > 1) & (counts.sum(1) >= 2 * least)


def shares(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    heavy = counts * weights
    return heavy / np.maximum(heavy.sum(1, keepdims=True), 1e-300)


def grow(codes: np.ndarray, label: np.ndarray, times: np.ndarray, tree: int, place: int, limit: int, least: int, weights: np.ndarray) -> np.ndarray:
    """The subtree at ``place`` as an array of nodes, from its rows; children stand behind their parents."""
    return grow_beside(codes, label, times, tree, place, limit, [least], weights)[0]


def grow_beside(codes: np.ndarray, label: np.ndarray, times: np.ndarray, tree: int, place: int, limit: int, leasts: list[int], weights: np.ndarray) -> list[np.ndarray]:
    """The subtrees at ``place``, one for each least number of rows of a leaf.

    A node that several of them cut alike is looked at once, and so are its children; where they differ, its rows go to both.
    Rows are kept in the order of their nodes with their bins, so that what belongs to a node is repeated and bins are read one after the other.
    """
    n, features = codes.shape
    bins, kinds = codes.max(0, initial=0).astype(np.int64) + 1, range(len(leasts))
    held_codes = np.ascontiguousarray(codes * np.uint8(CLASSES))  # room for the class beside the bin
    label, times = label.astype(np.int64), times.astype(np.float64)
    counts = np.bincount(label, times, CLASSES)[None]
    root = np.zeros(1, NODE)
    root["indice"], root["pesos"] = -1, shares(counts, weights)
    out, size = [[root.copy()] for _ in kinds], [1 for _ in kinds]
    depth = int(place).bit_length() - 1
    # of the nodes in work: place, rows held, and per subtree the position in its last part (-1: none of its open nodes)
    places, held = np.array([place], np.int64), np.array([n])
    numbers = [np.where(open_nodes(counts, depth, limit, least), 0, -1) for least in leasts]
    while any((x >= 0).any() for x in numbers):
        m, row = len(places), np.arange(0, held_codes.size, features)
        allowed = drawn_features(tree, places, features, tries(features))
        gain, feature, cut, left = np.zeros((len(leasts), m)), np.full((len(leasts), m), -1), np.zeros((len(leasts), m), np.int64), np.zeros((len(leasts), m, CLASSES))
        for k in range(allowed.shape[1]):
            wide = bins[allowed[:, k]]
            first = np.cumsum(wide) - wide
            at = np.repeat(allowed[:, k], held)
            at += row
            key = np.repeat(CLASSES * first, held)
            key += label
            key += held_codes.reshape(-1).take(at)
            parts = np.ascontiguousarray(np.bincount(key, times, CLASSES * wide.sum()).reshape(-1, CLASSES).T)
            for v, (g, c, lft) in enumerate(best_cuts(parts, np.repeat(np.arange(m), wide), first, weights, leasts)):
                more = (numbers[v] >= 0) & (g > np.maximum(gain[v], 1e-12))
                gain[v, more], feature[v, more], cut[v, more], left[v, more] = g[more], allowed[more, k], c[more] - first[more], lft[more]
        depth += 1
        new_places, new_counts, new_numbers, moved, new_held = [], [], [[] for _ in kinds], [], []
        position = []
        for v in kinds:
            split = np.flatnonzero(feature[v] >= 0)
            last, mine = out[v][-1], numbers[v][split]
            last["indice"][mine], last["bin"][mine] = feature[v, split], cut[v, split]
            # children come in the order of their parents' positions
            order = np.argsort(mine)
            place_of = np.empty(len(split), np.int64)
            place_of[order] = 2 * np.arange(len(split))
            last["esquerda"][mine] = size[v] + place_of
            last["direita"][mine] = size[v] + place_of + 1
            both = np.stack([left[v, split], counts[split] - left[v, split]], 1)
            part = np.zeros(2 * len(split), NODE)
            part["indice"] = -1
            for s in range(2):
                part["pesos"][place_of + s] = shares(both[:, s], weights)
            out[v].append(part)
            size[v] += len(part)
            position.append(np.full(m, -1))
            position[v][split] = place_of
        waiting = feature >= 0
        for u in kinds:
            split = np.flatnonzero(waiting[u])
            if not len(split):
                continue
            both = np.stack([left[u, split], counts[split] - left[u, split]], 1).reshape(-1, CLASSES)
            open_of = []
            for v in kinds:
                alike = waiting[v, split] & (feature[v, split] == feature[u, split]) & (cut[v, split] == cut[u, split])
                waiting[v, split[alike]] = False
                at = np.where(alike, position[v][split], -1)
                at = np.stack([at, np.where(at < 0, -1, at + 1)], 1).reshape(-1)
                open_of.append(np.where(open_nodes(both, depth, limit, leasts[v]), at, -1))
            going = np.max(open_of, axis=0) >= 0
            child = np.full((m, 2), -1, np.int16 if len(both) < 1 << 15 else np.int64)  # a stable sort of short numbers is fast
            child[split] = np.where(going, np.cumsum(going) - 1, -1).reshape(-1, 2)
            at = np.repeat(np.maximum(feature[u], 0), held)
            at += row
            right = held_codes.reshape(-1).take(at) > np.repeat(CLASSES * cut[u], held)
            here = child.reshape(-1).take(np.repeat(2 * np.arange(m), held) + right)
            sizes = np.bincount(here.astype(np.int64) + 1, minlength=going.sum() + 1)
            moved.append(np.argsort(here, kind="stable")[sizes[0] :])
            new_held.append(sizes[1:])
            new_places.append((2 * np.repeat(places[split], 2) + np.tile([0, 1], len(split)))[going])
            new_counts.append(both[going])
            for v in kinds:
                new_numbers[v].append(open_of[v][going])
        if not moved:
            break
        moved = np.concatenate(moved)
        held_codes, label, times = held_codes.take(moved, axis=0), label.take(moved), times.take(moved)
        places, held, counts, numbers = np.concatenate(new_places), np.concatenate(new_held), np.concatenate(new_counts), [np.concatenate(x) for x in new_numbers]
    return [np.concatenate(x) for x in out]


def assembled(pieces: dict[int, np.ndarray]) -> np.ndarray:
    """One node array of a tree from its pieces by place; a piece of one node that cuts continues at its children's places."""
    order = sorted(pieces)
    base = dict(zip(order, np.cumsum([0, *[len(pieces[p]) for p in order]]).tolist()))
    out = np.concatenate([pieces[p] for p in order])
    for p in order:
        part = out[base[p] : base[p] + len(pieces[p])]
        if len(part) == 1 and part["indice"][0] >= 0:
            part["esquerda"], part["direita"] = base[2 * p], base[2 * p + 1]
        else:
            part["esquerda"] += base[p]
            part["direita"] += base[p]
    return out


def walkable(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, class shares) of a tree, level by level with both children beside each other.

    A step is the left child, the bin and the feature in one number; a leaf leads to itself.
    """
    level, order, steps, size = np.zeros(1, np.int64), [], [], 0
    while len(level):
        order.append(level)
        inner = nodes["indice"][level] >= 0
        to = np.where(inner, size + len(level) + 2 * (np.cumsum(inner) - 1), size + np.arange(len(level)))
        steps.append(to << 16 | np.where(inner, nodes["bin"][level], 255).astype(np.int64) << 8 | np.maximum(nodes["indice"][level], 0))
        size += len(level)
        level = np.stack([nodes["esquerda"][level[inner]], nodes["direita"][level[inner]]], 1).reshape(-1).astype(np.int64)
    return np.concatenate(steps), np.ascontiguousarray(nodes["pesos"][np.concatenate(order)])


def reached(tree: tuple[np.ndarray, np.ndarray], codes: np.ndarray, depths: list[int]):
    """(depth, class shares) of the rows where a :func:`walkable` tree is cut at each of the depths."""
    steps, weights = tree
    features = codes.shape[1]
    flat, row = codes.reshape(-1), np.arange(len(codes)) * features
    at, going = np.zeros(len(codes), np.int64), None
    mine = at
    for depth in range(max(depths) + 1):
        if depth in depths:
            if going is not None:
                at[going] = mine
            yield depth, weights.take(at, axis=0)
        if depth % 4 == 3:  # rows in a leaf stay
            if going is None:
                going, mine = np.arange(len(codes)), at
            else:
                at[going] = mine
            moving = np.flatnonzero(steps.take(mine) >> 16 != mine)
            going, mine, row = going.take(moving), mine.take(moving), row.take(moving)
            if not len(going):
                yield from ((d, weights.take(at, axis=0)) for d in depths if d > depth)
                return
        step = steps.take(mine)
        code = flat.take(row + (step & 255))
        mine = (step >> 16) + (code > (step >> 8 & 255))
        if going is None:
            at = mine


# ---------------------------------------------------------------- rows
def thresholds(rows: DataFrame, names=K.FEATURES) -> list[list[float]]:
    """Cuts per feature, at most ``BINS`` - 1: every value of a feature of few, quantiles of the others."""
    few = rows.agg(*[F.approx_count_distinct(F.col(n).cast("double")).alias(n) for n in names]).first()
    most = BINS - 1
    probs = [i / most for i in range(most)]
    value = lambda n: F.collect_set(F.col(n).cast("double")) if few[n] <= 2 * BINS else F.approx_percentile(F.col(n).cast("double"), probs)
    found = rows.agg(*[value(n).alias(n) for n in names]).first()
    out = []
    for n in names:
        values = sorted(set(found[n] or ()))
        if few[n] <= 2 * BINS:
            values = values[:-1] if len(values) <= BINS else [values[i * len(values) // most] for i in range(most)]
        out.append(values)
    return out


def coded(rows: DataFrame, cuts: list[list[float]], *keep: str) -> DataFrame:
    """``keep`` and the bins of the vectors ``features``, a byte each, as ``_codes``."""
    edges = [np.array(c) for c in cuts]
    given = rows.select(*keep, vector_to_array("features").alias("_x"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(len(keep)).flatten().to_numpy().reshape(-1, len(edges))
            codes = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1).astype(np.uint8)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], packed], [*keep, "_codes"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return given.mapInArrow(run, f"{kinds}, _codes binary")


def blocks(batches, features: int):
    """(first columns as arrays, bins) of about ``BLOCK`` rows at a time; the bins are the last column."""
    held, n = [], 0

    def joined():
        columns = list(zip(*held))
        return [np.concatenate(c) for c in columns[:-1]], np.concatenate(columns[-1])

    for batch in batches:
        packed = batch.column(batch.num_columns - 1)
        codes = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(-1, features)
        held.append((*[batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns - 1)], codes))
        n += len(codes)
        if n >= BLOCK:
            yield joined()
            held, n = [], 0
    if n:
        yield joined()


def keyed(batches, keys: int):
    """(key, rows of the remaining columns) of sorted batches, key by key."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)]):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def record(names: list[str], rows: list[tuple], kinds: list[str]):
    import pyarrow as pa

    types = {"i": pa.int32(), "l": pa.int64(), "b": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)], names)


# ---------------------------------------------------------------- growth
@dataclass
class Growth:
    """One kind of forest: trees, depth limit, least rows of a leaf and class weights (class order)."""

    trees: int
    depth: int
    least: int
    weights: tuple


def top_trees(rows: DataFrame, n: int, kind: Growth, features: int, local: int) -> tuple[dict, list]:
    """Nodes of more than ``local`` rows, cut by added histograms: pieces per tree, and the (tree, place) left to grow."""
    pieces: dict = {t: {} for t in range(kind.trees)}
    weights = np.array(kind.weights)
    large, ready = ([(t, 1) for t in range(kind.trees)], []) if n > local else ([], [(t, 1) for t in range(kind.trees)])
    spark = rows.sparkSession
    while large:
        state = spark.sparkContext.broadcast((pieces, large))

        def histograms(batches):
            above, wanted = state.value
            by_tree: dict = {}
            for t, p in wanted:
                by_tree.setdefault(t, []).append(p)
            added = {}
            for (label, hashes), codes in blocks(batches, features):
                hashes = hashes.view(np.uint64)
                for t, places in by_tree.items():
                    times = copies(hashes, t)
                    at = places_of(above[t], codes)
                    for p in places:
                        mine = np.flatnonzero((at == p) & (times > 0))
                        found = np.zeros((tries(features), BINS, CLASSES))
                        for k, f in enumerate(drawn_features(t, np.array([p]), features, tries(features))[0]):
                            found[k] = np.bincount(codes[mine, f].astype(np.int64) * CLASSES + label[mine], times[mine], BINS * CLASSES).reshape(BINS, CLASSES)
                        added[t, p] = added.get((t, p), 0) + found
            if added:
                yield record(["arvore", "lugar", "partes"], [(t, p, x.tobytes()) for (t, p), x in added.items()], ["i", "l", "b"])

        def cuts(batches):
            for (t, p), parts in keyed(batches, 2):
                whole = sum(np.frombuffer(x, np.float64) for (x,) in parts).reshape(-1, BINS, CLASSES)
                best, found = 1e-12, (-1, 0, whole[0].sum(0), np.zeros(CLASSES))
                for k, f in enumerate(drawn_features(t, np.array([p]), features, tries(features))[0]):
                    seen = np.flatnonzero(whole[k].sum(1))
                    if len(seen):
                        ((gain, cell, left),) = best_cuts(whole[k][seen].T, np.zeros(len(seen), np.int64), np.zeros(1, np.int64), weights, [kind.least])
                        if gain[0] > best:
                            best, found = gain[0], (int(f), int(seen[cell[0]]), left[0], whole[k].sum(0) - left[0])
                yield record(["arvore", "lugar", "indice", "bin", "lados"], [(t, p, *found[:2], np.stack(found[2:]).tobytes())], ["i", "l", "i", "i", "b"])

        added = rows.mapInArrow(histograms, "arvore int, lugar long, partes binary").repartition("arvore", "lugar").sortWithinPartitions("arvore", "lugar")
        # a few numbers per large node
        done = added.mapInArrow(cuts, "arvore int, lugar long, indice int, bin int, lados binary").collect()
        large = []
        for t, p, f, b, sides in done:
            both = np.frombuffer(sides, np.float64).reshape(2, CLASSES)
            node = np.zeros(1, NODE)
            node["indice"], node["bin"], node["pesos"] = f, b, shares(both.sum(0)[None], weights)
            pieces[t][p] = node
            if f < 0:
                continue
            for child, counts in ((2 * p, both[0]), (2 * p + 1, both[1])):
                if not open_nodes(counts[None], int(child).bit_length() - 1, kind.depth, kind.least)[0]:
                    leaf = np.zeros(1, NODE)
                    leaf["indice"], leaf["pesos"] = -1, shares(counts[None], weights)
                    pieces[t][child] = leaf
                else:
                    (large if counts.sum() > local else ready).append((t, child))
        state.unpersist()
    return pieces, ready


def places_of(pieces: dict[int, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The place each row reaches among the nodes cut so far."""
    at = np.ones(len(codes), np.int64)
    for p in sorted(pieces):
        node = pieces[p][0]
        if node["indice"] >= 0:
            mine = at == p
            at[mine] = 2 * p + (codes[mine, node["indice"]] > node["bin"])
    return at


def grown(rows: DataFrame, kind: Growth, features: int = len(K.FEATURES), local: int = LOCAL) -> DataFrame:
    """(arvore, lugar, nos): the written node arrays of a forest from training rows (label int, h long, _codes)."""
    return grown_beside(rows, [kind], features, local)[0]


def grown_beside(rows: DataFrame, kinds: list[Growth], features: int = len(K.FEATURES), local: int = LOCAL, run=map) -> list[DataFrame]:
    """:func:`grown` for several kinds of forests on the same rows; ``run`` maps over kinds that are grown by themselves.

    Rows sent once per set of trees are far fewer than a bootstrap per tree; a smaller ``local`` bounds whole trees too.
    """
    n = rows.count()
    if n > (local if local < LOCAL else max(local, WHOLE)):
        return list(run(lambda kind: grown_alone(rows, n, kind, features, local), kinds))
    nodes = materialise(whole_trees(rows, kinds, features), "forest-nodes")
    return [nodes.where(F.col("tipo") == k).drop("tipo") for k in range(len(kinds))]


def whole_trees(rows: DataFrame, kinds: list[Growth], features: int) -> DataFrame:
    """(tipo, arvore, lugar, nos) of trees that one task can grow: each task holds all the rows and grows a set of trees of all kinds."""
    trees = max(kind.trees for kind in kinds)
    sets = min(trees, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    alike: dict = {}
    for k, kind in enumerate(kinds):
        alike.setdefault((kind.trees, kind.depth, tuple(kind.weights)), []).append(k)

    def packed(batches):
        for (label, hashes), codes in blocks(batches, features):
            data = codes.tobytes(), label.astype(np.uint8).tobytes(), hashes.tobytes()
            yield record(["conjunto", "linhas", "classes", "sorteios"], [(s, *data) for s in range(sets)], ["i", "b", "b", "b"])

    def run(batches):
        held: dict = {}
        for batch in batches:
            for s, *data in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)]):
                held.setdefault(s, []).append(data)
        for s, parts in held.items():
            whole = [b"".join(x) for x in zip(*parts)]
            codes, label, hashes = np.frombuffer(whole[0], np.uint8).reshape(-1, features), np.frombuffer(whole[1], np.uint8), np.frombuffer(whole[2], np.uint64)
            for t in range(s, trees, sets):
                times = copies(hashes, t)
                bag = np.flatnonzero(times)
                for (most, depth, weights), mine in alike.items():
                    if t < most and len(bag):
                        found = grow_beside(codes[bag], label[bag], times[bag], t, 1, depth, [kinds[k].least for k in mine], np.array(weights))
                        yield record(["tipo", "arvore", "lugar", "nos"], [(k, t, 1, nodes.tobytes()) for k, nodes in zip(mine, found)], ["i", "i", "l", "b"])

    dealt = rows.mapInArrow(packed, "conjunto int, linhas binary, classes binary, sorteios binary").repartitionById(sets, "conjunto")
    return dealt.mapInArrow(run, "tipo int, arvore int, lugar long, nos binary")


def grown_alone(rows: DataFrame, n: int, kind: Growth, features: int, local: int) -> DataFrame:
    """:func:`grown` from ``n`` rows, more than one task may hold."""
    spark = rows.sparkSession
    pieces, ready = top_trees(rows, n, kind, features, local)
    top = spark.sparkContext.broadcast(pieces)
    by_tree: dict = {}
    for t, p in ready:
        by_tree.setdefault(t, []).append(p)

    def dealt(batches):
        for (label, hashes), codes in blocks(batches, features):
            hashes = hashes.view(np.uint64)
            for t, places in by_tree.items():
                times = copies(hashes, t)
                in_bag = np.flatnonzero(times)
                at = places_of(top.value[t], codes[in_bag]) if top.value[t] else None
                out = []
                for p in places:
                    mine = in_bag if at is None else in_bag[at == p]
                    if len(mine):
                        packed = np.concatenate([codes[mine], label[mine, None].astype(np.uint8), times[mine, None]], 1)
                        out.append((t, p, packed.tobytes()))
                if out:
                    yield record(["arvore", "lugar", "linhas"], out, ["i", "l", "b"])

    weights = np.array(kind.weights)

    def subtrees(batches):
        for (t, p), parts in keyed(batches, 2):
            packed = np.frombuffer(b"".join(x for (x,) in parts), np.uint8).reshape(-1, features + 2)
            nodes = grow(np.ascontiguousarray(packed[:, :features]), packed[:, features], packed[:, features + 1], t, p, kind.depth, kind.least, weights)
            yield record(["arvore", "lugar", "nos"], [(t, p, nodes.tobytes())], ["i", "l", "b"])

    parts = rows.mapInArrow(dealt, "arvore int, lugar long, linhas binary").repartition(max(1, len(ready)), "arvore", "lugar").sortWithinPartitions("arvore", "lugar")
    found = parts.mapInArrow(subtrees, "arvore int, lugar long, nos binary")
    above = [(t, p, bytearray(x.tobytes())) for t, made in pieces.items() for p, x in made.items()]
    if above:
        found = found.unionByName(spark.createDataFrame(above, found.schema))
    return materialise(found, "forest-nodes")


# ---------------------------------------------------------------- scores
def sums(nodes: DataFrame, rows: DataFrame, cuts: list[tuple[int, int]], features: int = len(K.FEATURES)) -> DataFrame:
    """(linha, corte, p0, p1, ...): summed class shares of the rows (linha long, _codes) by the first trees to a depth, per (trees, depth) of ``cuts``."""
    each = [F.struct(F.lit(c).alias("corte"), *[F.col(f"c{c}_p{k}").alias(f"p{k}") for k in range(CLASSES)]) for c in range(len(cuts))]
    return wide_sums(nodes, rows, cuts, features).select("linha", F.inline(F.array(*each)))


def wide_sums(nodes: DataFrame, rows: DataFrame, cuts: list[tuple[int, int]], features: int = len(K.FEATURES)) -> DataFrame:
    """(linha, c0_p0, c0_p1, ..., c1_p0, ...): :func:`sums` with one row per ``linha``.

    Trees are dealt into sets and rows into slices; a cell holds a set of trees, and the rows of a slice stream past it.
    """
    size = nodes.agg(F.sum(F.length("nos"))).first()[0] or 0
    sets = -(-int(size) // (HELD_NODES * NODE.itemsize)) or 1
    slices = max(1, -(-3 * rows.sparkSession.sparkContext.defaultParallelism // sets))
    depths = sorted({d for _, d in cuts})
    names = [f"c{c}_p{k}" for c in range(len(cuts)) for k in range(CLASSES)]

    def packed(batches):
        for (line,), codes in blocks(batches, features):
            slice_of = mixed(line.astype(np.uint64)) % np.uint64(slices)
            for s in range(slices):
                mine = np.flatnonzero(slice_of == s)
                if len(mine):
                    yield record(["fatia", "nos", "linhas"], [(s, codes[mine].tobytes(), line[mine].astype(np.int64).tobytes())], ["i", "b", "b"])

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    empty = F.lit(None).cast("binary").alias("linhas")
    trees = nodes.select(F.pmod("arvore", F.lit(sets)).alias("grupo"), every(slices).alias("fatia"), "arvore", "lugar", "nos", empty)
    asked = rows.select("linha", "_codes").mapInArrow(packed, "fatia int, nos binary, linhas binary").select(
        every(sets).alias("grupo"), "fatia", F.lit(None).cast("int").alias("arvore"), F.lit(0).cast("long").alias("lugar"), "nos", "linhas")
    cell_of = (F.col("grupo") * slices + F.col("fatia")).cast("int")
    dealt = trees.unionByName(asked).repartitionById(sets * slices, cell_of).sortWithinPartitions(F.asc_nulls_last("arvore"))

    def run(batches):
        import pyarrow as pa

        pieces, made, held, n = {}, None, [], 0

        def scored():
            codes = np.concatenate([np.frombuffer(data, np.uint8) for data, _ in held]).reshape(-1, features)
            line = np.concatenate([np.frombuffer(lines, np.int64) for _, lines in held])
            so_far = {d: np.zeros((len(line), CLASSES)) for d in depths}
            done = {}

            def passed(k):
                done.update({c: so_far[d].copy() for c, (most, d) in enumerate(cuts) if most <= k and c not in done})

            for k, tree in made.items():
                passed(k)
                for depth, share in reached(tree, codes, depths):
                    so_far[depth] += share
            passed(max(most for most, _ in cuts))
            out = [done[c][:, k] for c in range(len(cuts)) for k in range(CLASSES)]
            return pa.RecordBatch.from_arrays([pa.array(line), *[pa.array(x) for x in out]], ["linha", *names])

        for batch in batches:
            for t, p, data, lines in zip(*[batch.column(k).to_pylist() for k in range(2, 6)]):
                if lines is None:
                    pieces.setdefault(t, {})[p] = np.frombuffer(data, NODE)
                    continue
                if made is None:
                    made, pieces = {k: walkable(assembled(v)) for k, v in sorted(pieces.items())}, {}
                held.append((data, lines))
                n += len(lines) // 8
                if n >= SCORED:
                    yield scored()
                    held, n = [], 0
        if n:
            yield scored()

    out = dealt.mapInArrow(run, "linha long, " + ", ".join(f"{x} double" for x in names))
    # float sums in any order: ties are decided on rounded sums
    return out.groupBy("linha").agg(*[F.round(F.sum(x), 9).alias(x) for x in names])


def prediction(cut: str = ""):
    each = F.array(*[F.col(f"{cut}p{k}") for k in range(CLASSES)])
    return F.array_position(each, F.array_max(each)).cast("double") - 1


class ForestModel:
    """A grown forest: written nodes and the cuts of its bins."""

    def __init__(self, nodes: DataFrame, cuts: list[list[float]], trees: int, depth: int):
        self.nodes, self.cuts, self.trees, self.depth = nodes, cuts, trees, depth

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``features``) with ``prediction`` and ``probability``."""
        rows = materialise(df.withColumn("linha", F.monotonically_increasing_id()), "forest-rows")
        found = sums(self.nodes, coded(rows, self.cuts, "linha"), [(self.trees, self.depth)])
        share = F.array(*[F.col(f"p{k}") / sum(F.col(f"p{j}") for j in range(CLASSES)) for k in range(CLASSES)])
        scored = found.select("linha", prediction().alias("prediction"), array_to_vector(share).alias("probability"))
        return rows.join(scored, "linha").drop("linha")


def training_rows(rows: DataFrame, cuts: list[list[float]], names=K.FEATURES) -> DataFrame:
    """Written label, hash and bins of training vectors; the hash stands for the row in every draw."""
    given = rows.select("features", F.coalesce(F.col("label"), F.raise_error(F.lit("a training row has no known class")).cast("double")).cast("int").alias("label"),
                        F.xxhash64("id_fluxo", "timestamp", "alvo", *names).alias("h"))
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return materialise(coded(given, cuts, "label", "h").repartition(parts, "h"), "forest-training")
