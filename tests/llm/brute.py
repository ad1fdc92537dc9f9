"""Plain versions of the operators, by comparing everything with everything, for small tables."""

import collections
import itertools

import numpy as np

from marlstone.llm import lines as _lines
from marlstone.llm import simhash


def components(rows):
    """Component by fingerprint: every pair is compared."""
    fps = sorted({simhash.fingerprint(t) for _, t in rows})
    x = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)
    root = dict(zip(fps, simhash._union(np.arange(len(fps)), a, b).tolist(), strict=True))
    least = {}
    for i, t in rows:
        if i is not None:
            r = root[simhash.fingerprint(t)]
            least[r] = min(i, least.get(r, i))
    return [(i, f"{simhash.fingerprint(t):016x}", least.get(root[simhash.fingerprint(t)])) for i, t in rows]


def lines(rows, tree=_lines.Tree()):
    """Lines dropped, by comparing every line with every other: id -> kept lines. No variable words, no short lines."""
    every = [(i, p, tuple(x.split())) for i, t in rows for p, x in enumerate(t.split("\n"))]
    kinds = sorted({w for _, _, w in every})
    parent = {w: w for w in kinds}

    def root(w):
        while parent[w] != w:
            w = parent[w]
        return w

    def places(w):
        return [w[i * len(w) // 9 : (i + 1) * len(w) // 9] for i in range(9)]

    differ = {}
    for a, b in itertools.combinations(kinds, 2):
        if len(a) == len(b) and a[0] == b[0]:
            apart = {i for i, (x, y) in enumerate(zip(places(a), places(b), strict=True)) if x != y}
            if len(apart) <= min(len(a) // tree.alike, tree.fields):
                parent[root(a)] = root(b)
                differ[a, b] = apart
    fields = collections.defaultdict(set)
    for (a, _), d in differ.items():
        fields[root(a)] |= d
    groups = collections.defaultdict(set)
    for i, _, w in every:
        groups[root(w)].add(i)
    gone = set()
    for r, ids in groups.items():
        fixed = len(r) - len(fields[r]) * -(-len(r) // 9)
        if fixed >= tree.long_words and len(ids) >= tree.long_docs or len(ids) >= tree.short_docs:
            gone |= {(i, p) for i, p, w in every if root(w) == r and i != min(ids)}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def seats(votes, n):
    got = [0] * len(votes)
    for _ in range(n if any(votes) else 0):
        got[max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


def targets(sizes, weights, total=1.5, epochs=2):
    out, open_ = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n}
    left = total * sum(sizes)
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > epochs * sizes[i]}
        for i in over or open_:
            out[i] = epochs * sizes[i] if i in over else share[i]
        if not over:
            break
        left -= sum(epochs * sizes[i] for i in over)
        open_ -= over
    return out


def mix(spark, rows, shard_rows=2000, shard_blocks=200):
    """(doc_id, text) -> words taken by each row of (doc_id, text, source), by a loop over each shard's blocks, with
    the operator's hashes."""
    table = spark.createDataFrame([(n, i, t) for n, (i, t, _) in enumerate(rows)], "n int, doc_id bigint, text string")
    draw = {r["n"]: (r["d"], r["h"]) for r in table.selectExpr("n", "xxhash64(7, doc_id, text) as d", "hash(xxhash64(7, doc_id, text)) as h").collect()}
    size = [len((t or "").split()) for _, t, _ in rows]
    source = [(s is None, s or "") for _, _, s in rows]
    places = sorted(set(source))
    totals = [sum(n for n, s in zip(size, source, strict=True) if s == p) for p in places]
    count = [source.count(p) for p in places]
    goal = targets(totals, [[5, 2, 1][i % 3] for i in range(len(places))])
    shards = [-(-n // shard_rows) for n in count]
    block = max(1, int(min(sum(goal) / sum(shards), min((g for g in goal if g), default=0)) / shard_blocks))
    held = collections.defaultdict(list)
    for n, (i, _, _) in enumerate(rows):
        place = places.index(source[n])
        held[place, draw[n][1] % shards[place]].append((draw[n][0], (i is not None, i or 0), size[n], n))
    given, taken = seats(goal, round(sum(goal) / block)), {}
    for place in range(len(places)):
        own = sorted(k for k in held if k[0] == place)
        for k, q in zip(own, seats([sum(x[2] for x in held[k]) for k in own], given[place]), strict=True):
            start, blocks = 0, collections.defaultdict(list)
            for x in sorted(held[k]):
                blocks[start // block].append(x)
                start += x[2]
            marks = {r["b"]: r["x"] for r in spark.createDataFrame([(b,) for b in blocks], "b bigint").selectExpr("b", f"xxhash64(7, {place}L, {k[1]}L, b) as x").collect()} if blocks else {}
            left = q * block
            for _ in range(2):
                for b in sorted(blocks, key=lambda b: (marks[b], b)):
                    for x in blocks[b]:
                        part = min(x[2], left)
                        taken[x[3]] = taken.get(x[3], 0) + part
                        left -= part
    out = collections.defaultdict(list)
    for n, (i, t, _) in enumerate(rows):
        out[i, t].append(taken.get(n, 0))
    return out
