"""The rules once more in a few lines of plain Python, for small random graphs."""

import random
from collections import deque


def random_graph(seed, people=12, units=5, links=30):
    rng = random.Random(seed)
    persons = [{"id": f"p{seed}.{i}", "basis": rng.random() < 0.5} for i in range(people)]
    orgs = [f"o{seed}.{i}" for i in range(units)]
    ids = [p["id"] for p in persons] + orgs
    pairs = list(dict.fromkeys((rng.choice(ids), rng.choice(ids)) for _ in range(links)))
    return persons, orgs, [(s, t) for s, t in pairs if s != t]


def many_graphs(seeds):
    """Separate random graphs side by side, to ask about all of them at once."""
    persons, orgs, links = [], [], []
    for seed in seeds:
        p, o, e = random_graph(seed, links=20 + seed % 3 * 15)
        persons, orgs, links = persons + p, orgs + o, links + e
    return persons, orgs, links


def is_org(node):
    return node.startswith("o")


def successors(links, node, mode, org_start):
    found = []
    for s, t in links:
        if mode in ("down", "both"):
            if s == node and not (not is_org(s) and is_org(t)):
                found.append(t)
            if t == node and is_org(t) and not is_org(s) and org_start:
                found.append(s)
        if mode in ("up", "both"):
            if t == node and (not is_org(t) or is_org(s)):
                found.append(s)
            if s == node and not is_org(s) and is_org(t):
                found.append(t)
    return found


def walk(links, root, depth, mode):
    level, queue = {root: 0}, deque([root])
    while queue:
        node = queue.popleft()
        if level[node] < depth:
            for other in successors(links, node, mode, is_org(root)):
                if other not in level:
                    level[other] = level[node] + 1
                    queue.append(other)
    return level


def with_managers(links, persons, reached, mode):
    basis = {p["id"] for p in persons if p["basis"]}
    kept = {n for n in reached if n not in basis}
    for s, t in links:
        if not is_org(s) and not is_org(t) and t in kept and s not in kept:
            if mode != "down" or s in reached:
                kept.add(s)
    return kept


def parents(links):
    return {t: s for s, t in links if is_org(s) and is_org(t)}


def depth_of(org, parent):
    seen = set()
    while org in parent and org not in seen:
        seen.add(org)
        org = parent[org]
    return len(seen)


def lowest_orgs(links, reached):
    parent, nearest = parents(links), {}
    for person, level in reached.items():
        mine = {t for s, t in links if s == person and is_org(t)} if not is_org(person) else set()
        for org in mine:
            if not any(parent.get(o) == org for o in mine if o != org):
                nearest[org] = min(level, nearest.get(org, level))
    return nearest


def rows(df, *columns):
    """Rows as a sorted list of tuples, or of values for a single column."""
    picked = df.select(*columns) if columns else df
    got = [tuple(r) if len(r) > 1 else r[0] for r in picked.collect()]
    return sorted(got, key=lambda r: tuple((x is None, x) for x in (r if isinstance(r, tuple) else (r,))))
