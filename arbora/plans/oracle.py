"""The same questions in plain SQL, for an engine that shares no code with this package."""

from __future__ import annotations

from ..functions.scalars import GRAY_LIGHTNESS, PALETTE_SLOTS, PALETTES
from .catalog import EARLIER_TYPES, SECOND_LOAD, SUB_ROOTS, TEXTS
from .warehouse import HIDDEN_ROOTS, LINES, ORGS, PERSONS, POSITIONS, RAW_LINKS, ROOT, SHOWN_ROOTS, TABLES


def _duck(sql: str) -> str:
    """Spelling differences between the two dialects."""
    sql = sql.format(**{name: name for name in TABLES})
    return sql.replace(" div ", " // ").replace("get_json_object", "json_extract_string")


def _ids(ids) -> str:
    return ", ".join(f"('{i}', {n})" for n, i in enumerate(ids))


GRAPH = f"""
persons AS ({_duck(PERSONS)}),
orgs AS ({_duck(ORGS)}),
raw_links AS ({_duck(RAW_LINKS)}),
nodes AS (
  SELECT id, label, email, is_basis, ord, 'person' AS type FROM persons WHERE id <> ''
  UNION ALL SELECT id, label, NULL, NULL, ord + 4611686018427387904, 'org' FROM orgs WHERE id <> ''),
idx AS (
  SELECT id, arg_max(label, ord) AS label, arg_max(email, ord) AS email, arg_max(is_basis, ord) AS is_basis,
         arg_max(type, ord) AS type, min(ord) AS ord, bool_or(type = 'person') AS as_person,
         bool_or(type = 'org') AS as_org FROM nodes GROUP BY id),
links AS (
  SELECT l.source, l.target, min(l.ord) AS ord, any_value(s.type[1] || t.type[1]) AS kind
  FROM raw_links l JOIN idx s ON s.id = l.source JOIN idx t ON t.id = l.target
  WHERE l.source <> l.target GROUP BY ALL),
emails AS (SELECT lower(email) AS email, arg_max(id, ord) AS person_id FROM nodes
           WHERE type = 'person' AND email <> '' GROUP BY 1),
org_parent AS (SELECT target AS child, arg_max(source, ord) AS parent FROM links WHERE kind = 'oo' GROUP BY 1),
org_child AS (SELECT source AS parent, target AS child FROM links WHERE kind = 'oo'),
person_org AS (SELECT source AS person_id, target AS org_id, ord FROM links WHERE kind = 'po'),
reports AS (SELECT source, target, ord FROM links WHERE kind = 'pp'),
managers AS (SELECT target AS person_id, arg_max(source, ord) AS manager_id FROM reports GROUP BY 1),
org_up AS (
  SELECT id AS org_id, id AS ancestor_id, CAST(0 AS BIGINT) AS step FROM idx WHERE as_org
  UNION ALL SELECT org_id, parent, step + 1 FROM org_up JOIN org_parent ON child = ancestor_id),
depth AS (SELECT org_id AS id, max(step) AS depth FROM org_up GROUP BY 1),
org_below AS (
  SELECT id AS root_id, id FROM idx WHERE as_org
  UNION SELECT root_id, child FROM org_below JOIN org_child ON parent = id),
levels AS (
  SELECT id, CAST(0 AS BIGINT) AS level FROM idx WHERE type = 'person' AND id NOT IN (SELECT person_id FROM managers)
  UNION ALL SELECT person_id, level + 1 FROM levels JOIN managers ON manager_id = id),
forward AS (SELECT source AS v, target AS w, kind FROM links),
backward AS (SELECT target AS v, source AS w, kind FROM links),
down AS (SELECT v, w, false AS from_org FROM forward WHERE kind <> 'po'
         UNION ALL SELECT v, w, true FROM backward WHERE kind = 'po'),
up AS (SELECT v, w, false AS from_org FROM backward WHERE kind NOT IN ('po')
       UNION ALL SELECT v, w, false FROM forward WHERE kind = 'po'),
both_ways AS (SELECT * FROM down UNION ALL SELECT * FROM up),
hidden AS (
  WITH RECURSIVE below AS (
    SELECT r AS root_id, r AS id FROM (VALUES {_ids(HIDDEN_ROOTS)}) AS h(r, n)
    UNION SELECT root_id, target FROM below JOIN reports ON source = id)
  SELECT root_id, id AS node_id FROM below WHERE id <> root_id),
hidden_ids AS (
  SELECT node_id AS id FROM hidden GROUP BY 1
  HAVING NOT bool_or(root_id IN ({", ".join(repr(r) for r in SHOWN_ROOTS)}))),
lowest AS (
  SELECT person_id, org_id FROM person_org m WHERE NOT EXISTS (
    SELECT 1 FROM person_org o JOIN org_parent ON child = o.org_id
    WHERE o.person_id = m.person_id AND parent = m.org_id AND o.org_id <> m.org_id)),
pos AS ({_duck(POSITIONS)})
"""

ATTRIBUTES = f"""
lines AS (SELECT regexp_extract(url, '([^/]+)[.][^.]+$', 1) AS category, url, batch, ord, line
          FROM ({_duck(LINES)})),
parts AS (
  SELECT category, ord, list_transform(string_split(line, CASE WHEN contains(line, chr(9)) THEN chr(9) ELSE ',' END),
                                       lambda x: trim(x)) AS f
  FROM lines WHERE trim(line) <> ''),
fields AS (SELECT category, f[1] AS identifier, f[2] AS attr, CASE WHEN len(f) > 2 THEN f[3] ELSE '1' END AS value, ord
           FROM parts WHERE len(f) > 1),
entries AS (SELECT category, identifier, attr, arg_max(value, ord) AS value, min(ord) AS ord FROM fields GROUP BY 1, 2, 3),
owners AS (
  SELECT DISTINCT identifier, person_id FROM entries JOIN emails ON email = lower(identifier)
  UNION SELECT identifier, id FROM entries JOIN idx ON id = lower(identifier) WHERE type = 'person'),
firsts AS (SELECT category, identifier, min(ord) AS first_ord FROM entries GROUP BY 1, 2),
person_attr AS (
  SELECT person_id, category, attr, arg_max(value, first_ord) AS value, min(first_ord) AS first_ord,
         arg_min(ord, first_ord) AS ord
  FROM entries JOIN firsts USING (category, identifier) JOIN owners USING (identifier) GROUP BY 1, 2, 3),
names AS (SELECT category, attr, min(ord) AS ord FROM entries GROUP BY 1, 2),
types AS (SELECT category, attr, row_number() OVER (PARTITION BY category ORDER BY ord, attr) - 1 AS ordinal FROM names),
some_types AS (SELECT category, attr, NOT (category = 'activity' AND attr = 'error') AS active FROM types),
shown AS (SELECT * FROM person_attr JOIN some_types USING (category, attr) WHERE active)
"""

HULLS = """
members AS (
  SELECT b.root_id, m.person_id, m.org_id, m.ord, x, y
  FROM person_org m JOIN pos ON pos.id = m.person_id JOIN org_below b ON b.id = m.org_id),
counts AS (SELECT root_id, count(*) AS n FROM members GROUP BY 1),
-- a corner is the lowest or highest point of its column
ends AS (
  SELECT DISTINCT root_id, x, unnest([lo, hi]) AS y
  FROM (SELECT root_id, x, min(y) AS lo, max(y) AS hi FROM members GROUP BY 1, 2)),
sides AS (
  SELECT a.root_id, a.x AS from_x, a.y AS from_y, b.x AS to_x, b.y AS to_y
  FROM ends a JOIN ends b ON a.root_id = b.root_id AND (a.x <> b.x OR a.y <> b.y)
  JOIN counts k ON k.root_id = a.root_id AND k.n > 2
  WHERE NOT EXISTS (
    SELECT 1 FROM ends c WHERE c.root_id = a.root_id
      AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
           OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0
               AND ((c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0))))
  -- a set of points on one line has no area
  AND EXISTS (SELECT 1 FROM ends c WHERE c.root_id = a.root_id
      AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0)),
corners AS (SELECT DISTINCT root_id, from_x AS x, from_y AS y FROM sides),
centres AS (SELECT root_id, avg(x) AS cx, avg(y) AS cy FROM corners GROUP BY 1),
pairs AS (SELECT root_id, arg_min(x, ord) AS ax, arg_min(y, ord) AS ay, arg_max(x, ord) AS bx, arg_max(y, ord) AS by_
          FROM members JOIN counts USING (root_id) WHERE n = 2 GROUP BY 1),
boxes AS (
  SELECT root_id, ax, ay, bx, by_, -(by_ - ay) / d * 20 AS nx, (bx - ax) / d * 20 AS ny
  FROM (SELECT *, CASE WHEN e = 0 THEN 1 ELSE e END AS d
        FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS e FROM pairs))),
-- what is drawn: a circle for one member, a box for two, the hull moved outwards for more
outlines AS (
  SELECT root_id, cx + (from_x - cx) * (f + 12) / f AS from_x, cy + (from_y - cy) * (f + 12) / f AS from_y,
         cx + (to_x - cx) * (t + 12) / t AS to_x, cy + (to_y - cy) * (t + 12) / t AS to_y
  FROM (SELECT *, sqrt((from_x - cx) * (from_x - cx) + (from_y - cy) * (from_y - cy)) AS f,
               sqrt((to_x - cx) * (to_x - cx) + (to_y - cy) * (to_y - cy)) AS t FROM sides JOIN centres USING (root_id))
  UNION ALL
  SELECT root_id, x + cos(pi() * i / 6) * 20, y + sin(pi() * i / 6) * 20,
         x + cos(pi() * ((i + 1) % 12) / 6) * 20, y + sin(pi() * ((i + 1) % 12) / 6) * 20
  FROM members JOIN counts USING (root_id), range(12) AS c(i) WHERE n = 1
  UNION ALL
  SELECT root_id, v.* FROM boxes, LATERAL (VALUES
    (ax + nx, ay + ny, bx + nx, by_ + ny), (bx + nx, by_ + ny, bx - nx, by_ - ny),
    (bx - nx, by_ - ny, ax - nx, ay - ny), (ax - nx, ay - ny, ax + nx, ay + ny)) AS v(a, b, c, d)),
at_point AS (
  SELECT pos.id, s.root_id AS org_id
  FROM pos JOIN outlines s ON (from_y > y) <> (to_y > y)
  WHERE x < (to_x - from_x) * (y - from_y) / (to_y - from_y) + from_x
  GROUP BY ALL HAVING count(*) % 2 = 1)
"""

ALL_ORGS = """
found_orgs AS (
  SELECT person_id, label, arg_min(ancestor_id, o) AS org_id FROM (
    SELECT m.person_id, u.ancestor_id, i.label, row_number() OVER (PARTITION BY m.person_id ORDER BY m.ord, u.step) AS o
    FROM person_org m JOIN org_up u USING (org_id) JOIN idx i ON i.id = u.ancestor_id)
  GROUP BY 1, 2),
all_orgs AS (SELECT person_id, org_id, depth, label FROM found_orgs JOIN depth ON depth.id = org_id)
"""

DICTIONARY = """
dict_names AS (SELECT row_number() OVER (ORDER BY min(p_partkey), p_name) - 1 AS idx, p_name AS name FROM part GROUP BY p_name),
dict_orgs AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY min(p_partkey), p_brand) - 1 AS idx, p_brand AS name FROM part GROUP BY p_brand
  UNION ALL
  SELECT 1, row_number() OVER (ORDER BY min(p_partkey), p_type) - 1, p_type FROM part GROUP BY p_type),
alias_names AS (
  SELECT label, name AS pseudonym
  FROM (SELECT label, row_number() OVER (ORDER BY min(ord)) - 1 AS k FROM idx WHERE type = 'person' GROUP BY label)
  JOIN dict_names ON idx = k % (SELECT count(*) FROM dict_names)),
alias_orgs AS (
  SELECT label, name AS pseudonym
  FROM (SELECT label, CASE WHEN d < 2 THEN d ELSE 0 END AS list, row_number() OVER (PARTITION BY d ORDER BY o) - 1 AS k
        FROM (SELECT label, arg_min(depth, ord) AS d, min(ord) AS o FROM idx JOIN depth USING (id) GROUP BY label)) q
  JOIN dict_orgs ON level = list AND idx = k % (SELECT count(*) FROM dict_orgs s WHERE s.level = list)),
display AS (
  SELECT id, pseudonym AS display FROM idx JOIN alias_names USING (label) WHERE type = 'person'
  UNION ALL SELECT id, pseudonym FROM idx JOIN alias_orgs USING (label) WHERE type = 'org')
"""


def _ask(body: str, *parts: str) -> str:
    """A recursive WITH of the shared parts, a last part of its own, and a SELECT."""
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in (GRAPH, *parts)) + "\n" + body.strip()


def _walk(name: str, roots, depth: int, edges: str) -> str:
    return f"""
{name} AS (
  WITH RECURSIVE steps AS (
    SELECT r AS root_id, r AS id, idx.type = 'org' AS org_start, CAST(0 AS BIGINT) AS level
    FROM (VALUES {_ids(roots)}) AS q(r, n) JOIN idx ON idx.id = r
    UNION SELECT s.root_id, e.w, s.org_start, s.level + 1
    FROM steps s JOIN {edges} e ON e.v = s.id WHERE s.level < {depth} AND (NOT e.from_org OR s.org_start))
  SELECT root_id, id, min(level) AS level FROM steps GROUP BY 1, 2)
"""


REACH = _walk("reach", SUB_ROOTS, 2, "both_ways")
REACH_DOWN = _walk("reach", SUB_ROOTS, 2, "down")
ROOT_ORDER = f"root_order AS (SELECT * FROM (VALUES {_ids(SUB_ROOTS)}) AS q(root_id, root_ord))"


def _sub(management: bool = False, down: bool = False, hidden: bool = False) -> str:
    """``sub`` nodes of the sample roots, ``seen`` being what the hidden filter leaves."""
    keep = "WHERE id NOT IN (SELECT id FROM hidden_ids)" if hidden else ""
    seen = f"seen AS (SELECT reach.*, is_basis FROM reach JOIN idx USING (id) {keep})"
    if not management:
        return f"{seen}, sub AS (SELECT root_id, id, level FROM seen)"
    allowed = "AND e.source NOT IN (SELECT id FROM hidden_ids)" if hidden else ""
    reached = "AND EXISTS (SELECT 1 FROM reach r WHERE r.root_id = g.root_id AND r.id = e.source)" if down else ""
    return f"""{seen},
kept AS (SELECT root_id, id, level FROM seen WHERE NOT coalesce(is_basis, false)),
grown AS (
  WITH RECURSIVE g AS (
    SELECT root_id, id, CAST(-1 AS BIGINT) AS at FROM kept
    UNION SELECT g.root_id, e.source, e.ord FROM g JOIN reports e ON e.target = g.id AND e.ord > g.at
    WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.root_id = g.root_id AND k.id = e.source) {allowed} {reached})
  SELECT DISTINCT root_id, id FROM g),
sub AS (SELECT root_id, id, coalesce(level, 0) AS level FROM grown LEFT JOIN reach USING (root_id, id))"""


SUB_NODES = "SELECT root_id, id, type, label, level FROM sub JOIN idx USING (id)"
SUB_LINKS = """SELECT a.root_id, source, target FROM links JOIN sub a ON a.id = source
JOIN sub b ON b.id = target AND b.root_id = a.root_id"""
LEGEND = """legend AS (
  SELECT root_id, org_id, min(level) AS level FROM reach JOIN lowest ON person_id = id GROUP BY 1, 2)"""
MERGED = """merged AS (SELECT id, arg_max(level, root_ord) AS level FROM sub JOIN root_order USING (root_id) GROUP BY 1),
merged_links AS (SELECT DISTINCT source, target FROM links JOIN sub a ON a.id = source
                 JOIN sub b ON b.id = target AND b.root_id = a.root_id),
allowed AS (SELECT DISTINCT ancestor_id AS org_id FROM legend JOIN org_up USING (org_id))"""


def _distance(name: str, nodes: str, links: str, roots) -> str:
    listed = ", ".join(f"'{r}'" for r in roots)
    return f"""
{name} AS (
  WITH RECURSIVE pairs AS (
    SELECT source AS v, target AS w FROM {links} UNION SELECT target, source FROM {links}),
  walk AS (
    SELECT id, CAST(0 AS BIGINT) AS level FROM {nodes} WHERE id IN ({listed})
    UNION SELECT n.id, walk.level + 1 FROM walk JOIN pairs ON v = walk.id JOIN {nodes} n ON n.id = w
    WHERE walk.level < 12)
  SELECT n.id, coalesce(min(walk.level), 999) AS level FROM {nodes} n LEFT JOIN walk ON walk.id = n.id GROUP BY 1)
"""


DIFF = ",\n".join(
    p.strip()
    for p in (
        _walk("old_nodes", (ROOT,), 2, "both_ways"),
        _walk("new_nodes", ("c20",), 3, "both_ways"),
        "old_links AS (SELECT source, target FROM links WHERE source IN (SELECT id FROM old_nodes) AND target IN (SELECT id FROM old_nodes))",
        "new_links AS (SELECT source, target FROM links WHERE source IN (SELECT id FROM new_nodes) AND target IN (SELECT id FROM new_nodes))",
        _distance("old_levels", "old_nodes", "old_links", (ROOT, "c20")),
        _distance("new_levels", "new_nodes", "new_links", (ROOT, "c20")),
        """changes AS (
  SELECT id, 'removed' AS change, level FROM old_levels WHERE id NOT IN (SELECT id FROM new_nodes)
  UNION ALL SELECT id, 'added', level FROM new_levels WHERE id NOT IN (SELECT id FROM old_nodes)),
steps AS (
  SELECT *, dense_rank() OVER (ORDER BY change = 'added', CASE WHEN change = 'added' THEN level ELSE -level END) AS step
  FROM changes),
spans AS (
  SELECT id, change, level, CASE WHEN change = 'added' THEN step ELSE 0 END AS from_step,
         CASE WHEN change = 'removed' THEN step - 1 END AS to_step FROM steps
  UNION ALL SELECT id, 'kept', NULL, 0, NULL FROM old_nodes WHERE id IN (SELECT id FROM new_nodes))""",
    )
)

DETAIL_LIVE = """
SELECT id AS person_id, 'name' AS section, CAST(0 AS BIGINT) AS rank, label AS text FROM idx WHERE type = 'person'
UNION ALL SELECT person_id, 'attribute', 0, category || ': ' || attr || CASE WHEN value <> '1' THEN ': ' || value ELSE '' END FROM shown
UNION ALL SELECT a.id, 'org_at_point', -depth, label FROM at_point a JOIN depth d ON d.id = org_id JOIN idx i ON i.id = org_id
UNION ALL SELECT person_id, 'org', -depth, label FROM all_orgs
"""
DETAIL_OLD = """
SELECT id AS person_id, 'name' AS section, CAST(0 AS BIGINT) AS rank, label AS text FROM idx WHERE type = 'person'
UNION ALL SELECT id, 'email', 0, email FROM idx WHERE type = 'person' AND email <> ''
UNION ALL SELECT id, 'id', 0, id FROM idx WHERE type = 'person'
UNION ALL SELECT person_id, 'attribute', 0, attr || CASE WHEN value <> '1' THEN ': ' || value ELSE '' END FROM shown
UNION ALL SELECT a.id, 'org', -depth, label FROM at_point a JOIN depth d ON d.id = org_id JOIN idx i ON i.id = org_id
"""

MERGED_ATTR = f"""
second AS (
  SELECT category, 'c' || split_part(substr(line, 2), ',', 1) AS identifier, split_part(line, ',', 2) AS attr,
         arg_max(split_part(line, ',', 3), ord) AS value FROM ({_duck(SECOND_LOAD)}) GROUP BY 1, 2, 3),
newer AS (SELECT identifier AS person_id, category, attr, value FROM second JOIN idx ON id = identifier),
merged_attr AS (
  SELECT * FROM newer
  UNION ALL SELECT person_id, category, attr, value FROM person_attr p WHERE NOT EXISTS (
    SELECT 1 FROM newer n WHERE n.person_id = p.person_id AND n.category = p.category AND n.attr = p.attr))
"""

TREE = """
tree AS (
  SELECT id AS org_id, CAST(0 AS BIGINT) AS depth, id AS path FROM idx WHERE as_org AND id NOT IN (SELECT child FROM org_parent)
  UNION ALL SELECT child, depth + 1, path || '>' || child FROM tree JOIN org_child ON parent = org_id
  WHERE NOT list_contains(string_split(path, '>'), child))
"""

PER_PERSON = """
SELECT id AS person_id, coalesce(n, 0) AS active_count, coalesce(n, 0) > 0 AS has_attributes,
       greatest(0, coalesce(n, 0) - 1) AS extra_rings, CAST(9.5 + greatest(0, coalesce(n, 0) - 1) * 7 AS DOUBLE) AS outer_radius
FROM idx LEFT JOIN (SELECT person_id, count(*) AS n FROM shown {where} GROUP BY 1) ON person_id = id WHERE type = 'person'
"""


def _reloaded(links: str, person_attr: str, types: str, registry: str) -> str:
    """Rows of each table after a reload."""
    tables = {
        "nodes": "nodes", "index": "idx", "links": links, "org_parent": "org_parent", "email_index": "emails",
        "person_attr": person_attr, "types": types, "registry": registry,
        "hidden_by_root": "(SELECT 1 WHERE false)", "shown_roots": "(SELECT 1)", "allowed": "(SELECT 1 WHERE false)",
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM {table} x" for name, table in tables.items())


def _hash(text: str) -> str:
    units = f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))"
    return f"list_reduce(list_prepend(CAST(0 AS BIGINT), {units}), lambda h, c: (h * 31 + c) & 4294967295)"


def _palettes() -> str:
    rows = []
    for name, (start, width) in PALETTES.items():
        for slot, (share, s, v) in enumerate(PALETTE_SLOTS):
            rows.append(f"('{name}', {slot}, CAST({(start + share * width) % 360} AS DOUBLE), {s}, {v})")
    rows += [f"('gray', {slot}, CAST(0 AS DOUBLE), 0, {v})" for slot, v in enumerate(GRAY_LIGHTNESS)]
    return f"palettes AS (SELECT * FROM (VALUES {', '.join(rows)}) AS p(palette, slot, hue, saturation, lightness))"


HUE = f"(CAST(floor(({_hash('t')} % 360 + 20) / 40) AS BIGINT) * 40) % 360"


def oracle_sql() -> dict[str, str]:
    sub = (REACH, _sub())
    merged = (REACH, _sub(), ROOT_ORDER, LEGEND, MERGED)
    return {
        "read_graph": _ask("SELECT source, target, ord, kind FROM links"),
        "normalize_nodes": _ask("SELECT * FROM nodes"),
        "node_index": _ask("SELECT * FROM idx"),
        "normalize_links": _ask("SELECT source, target, ord, kind FROM links"),
        "email_index": _ask("SELECT * FROM emails"),
        "org_parent": _ask("SELECT * FROM org_parent"),
        "org_children": _ask("SELECT * FROM org_child"),
        "org_roots": _ask("SELECT id FROM idx WHERE as_org AND id NOT IN (SELECT child FROM org_child)"),
        "person_orgs": _ask("SELECT * FROM person_org"),
        "attributes_still_valid": _ask("SELECT category, count(*) AS n FROM person_attr GROUP BY 1", ATTRIBUTES),
        "person_projection": _ask("SELECT source, target FROM reports"),
        "adjacency_out": _ask("SELECT DISTINCT source AS v, target AS w FROM links"),
        "adjacency_in_degree": _ask("SELECT target AS id, count(DISTINCT source) AS n FROM links GROUP BY 1"),
        "manager_of": _ask("SELECT * FROM managers"),
        "undirected_degree": _ask(
            "SELECT v AS id, count(DISTINCT w) AS n FROM (SELECT source AS v, target AS w FROM raw_links "
            "UNION ALL SELECT target, source FROM raw_links) GROUP BY 1"
        ),
        "org_depth": _ask("SELECT * FROM depth"),
        "report_subtree": _ask(
            "SELECT * FROM tree",
            "tree AS (SELECT DISTINCT source AS root_id, source AS id FROM reports "
            "UNION SELECT root_id, target FROM tree JOIN reports ON source = id)",
        ),
        "org_descendants": _ask("SELECT * FROM org_below"),
        "org_descendants_below": _ask("SELECT * FROM org_below WHERE root_id <> id"),
        "org_ancestors": _ask("SELECT * FROM org_up"),
        "person_all_orgs": _ask("SELECT * FROM all_orgs", ALL_ORGS),
        "typed_bfs_down": _ask("SELECT * FROM r", _walk("r", (ROOT, "c0"), 3, "down")),
        "typed_bfs_up": _ask("SELECT * FROM r", _walk("r", (ROOT, "c100"), 3, "up")),
        "typed_bfs_both": _ask("SELECT * FROM r", _walk("r", (ROOT, "c100"), 3, "both_ways")),
        "typed_bfs_org_start": _ask("SELECT * FROM r", _walk("r", ("r1", "n3", "nobody"), 3, "both_ways")),
        "legend_orgs": _ask("SELECT * FROM legend", REACH, LEGEND),
        "subgraph_nodes": _ask(SUB_NODES, *sub),
        "subgraph_links": _ask(SUB_LINKS, *sub),
        "subgraph_management": _ask(SUB_NODES, REACH, _sub(management=True)),
        "subgraph_management_down": _ask(SUB_NODES, REACH_DOWN, _sub(management=True, down=True)),
        "subgraph_hidden": _ask(SUB_NODES, REACH, _sub(management=True, hidden=True)),
        "hidden_count": _ask(
            "SELECT root_id, count(h.id) AS hidden_count FROM reach LEFT JOIN hidden_ids h USING (id) GROUP BY 1", REACH
        ),
        "multi_root_merge": _ask("SELECT id, type, label, level FROM merged JOIN idx USING (id)", *merged),
        "allowed_orgs": _ask("SELECT * FROM allowed", *merged),
        "levels_from_roots": _ask("SELECT * FROM d", _distance("d", "idx", "links", (ROOT, "w"))),
        "hierarchy_levels": _ask("SELECT * FROM levels UNION ALL SELECT id, -1 FROM idx WHERE type = 'org'"),
        "subgraph_diff": _ask("SELECT * FROM spans", DIFF),
        "subgraph_diff_links": _ask(
            "SELECT source, target, greatest(a.from_step, b.from_step) AS from_step, "
            "CASE WHEN a.to_step IS NULL THEN b.to_step WHEN b.to_step IS NULL THEN a.to_step "
            "ELSE least(a.to_step, b.to_step) END AS to_step "
            "FROM (SELECT * FROM old_links UNION SELECT * FROM new_links) JOIN spans a ON a.id = source "
            "JOIN spans b ON b.id = target "
            "WHERE greatest(a.from_step, b.from_step) <= least(coalesce(a.to_step, 99), coalesce(b.to_step, 99))",
            DIFF,
        ),
        "primary_org": _ask(
            "SELECT person_id, org_id, depth FROM (SELECT *, row_number() OVER "
            "(PARTITION BY person_id ORDER BY depth DESC, ord) AS r FROM person_org JOIN depth ON id = org_id) WHERE r = 1"
        ),
        "hide_subtree": _ask("SELECT * FROM hidden"),
        "unhide_subtree": _ask(f"SELECT * FROM hidden WHERE root_id <> '{ROOT}'"),
        "toggle_temp_visible": "SELECT 'c1' AS root_id",
        "is_hidden": _ask("SELECT id, id IN (SELECT id FROM hidden_ids) AS hidden FROM idx"),
        "cluster_memberships": _ask("SELECT root_id, person_id, org_id, x, y FROM members", HULLS),
        "cluster_order": _ask("SELECT root_id AS org_id, depth FROM counts JOIN depth ON id = root_id", HULLS),
        "group_hull": _ask(
            "SELECT DISTINCT root_id, n, from_x AS x, from_y AS y FROM sides JOIN counts USING (root_id) "
            "UNION ALL SELECT root_id, n, x, y FROM members JOIN counts USING (root_id) WHERE n < 3",
            HULLS,
        ),
        "group_hull_padded": _ask(
            "SELECT root_id, round(cx + (x - cx) * (d + 12.0) / d, 6) AS x, round(cy + (y - cy) * (d + 12.0) / d, 6) AS y "
            "FROM (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM corners "
            "JOIN (SELECT root_id, avg(x) AS cx, avg(y) AS cy FROM corners GROUP BY 1) USING (root_id)) "
            "UNION ALL SELECT root_id, round(x + cos(pi() * i / 6) * 20, 6) + 0.0, round(y + sin(pi() * i / 6) * 20, 6) + 0.0 "
            "FROM members JOIN counts USING (root_id), range(12) AS t(i) WHERE n = 1 "
            "UNION ALL SELECT root_id, round(px + f * nx * 20, 6) + 0.0, round(py + f * ny * 20, 6) + 0.0 FROM ("
            "  SELECT root_id, f, px, py, -(by_ - ay) / d AS nx, (bx - ax) / d AS ny FROM ("
            "    SELECT *, CASE WHEN e = 0 THEN 1 ELSE e END AS d FROM ("
            "      SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS e FROM pairs)), "
            "  LATERAL (VALUES (1, ax, ay), (1, bx, by_), (-1, bx, by_), (-1, ax, ay)) AS v(f, px, py))",
            HULLS,
        ),
        "hulls_at_point": _ask(
            "SELECT a.id, org_id, depth, label FROM at_point a JOIN depth d ON d.id = org_id JOIN idx i ON i.id = org_id",
            HULLS,
        ),
        "parse_attributes": _ask("SELECT * FROM entries", ATTRIBUTES),
        "parse_attributes_strict": _ask(
            "SELECT category, identifier, attr, arg_max(CASE WHEN value = '' THEN '1' ELSE value END, ord) AS value, "
            "min(ord) AS ord FROM fields WHERE identifier <> '' AND attr <> '' GROUP BY 1, 2, 3",
            ATTRIBUTES,
        ),
        "line_counts": _ask(
            "SELECT l.category, count(f.ord) AS total, bool_and(trim(line) = '') AS is_empty FROM lines l "
            "LEFT JOIN fields f USING (category, ord) GROUP BY 1",
            ATTRIBUTES,
        ),
        "read_attribute_files": _ask("SELECT category, identifier, attr, value FROM entries", ATTRIBUTES),
        "category_from_path": """
WITH bare AS (SELECT page_id, url, split_part(split_part(url, '?', 1), '#', 1) AS b FROM pages),
named AS (SELECT *, coalesce(nullif(split_part(b, '/', -1), ''), b) AS f, coalesce(nullif(split_part(url, '/', -1), ''), url) AS u FROM bare)
SELECT page_id,
       trim(CASE WHEN strpos(f[2:], '.') > 0 THEN f[1:len(f) - len(split_part(f, '.', -1)) - 1] ELSE f END) AS category,
       CASE WHEN strpos(u, '.') > 0 AND split_part(u, '.', -1) <> '' AND strpos(split_part(u, '.', -1), '/') = 0
            THEN u[1:len(u) - len(split_part(u, '.', -1)) - 1] ELSE u END AS upload_category
FROM named""",
        "category_registry": _ask(
            "SELECT category, split_part(split_part(url, '/', -1), '?', 1) AS filename, url, "
            "CASE WHEN bool_or(contains(line, chr(9))) THEN 'tab' ELSE 'comma' END AS format, "
            "bool_and(trim(line) = '') AS is_empty, false AS modified FROM lines GROUP BY category, url",
            ATTRIBUTES,
        ),
        "empty_categories": _ask(
            "SELECT category FROM lines GROUP BY 1 HAVING bool_and(trim(line) = '')", ATTRIBUTES
        ),
        "resolve_identifiers": _ask("SELECT * FROM owners", ATTRIBUTES),
        "match_attributes": _ask("SELECT * FROM person_attr", ATTRIBUTES),
        "unmatched_identifiers": _ask(
            "SELECT category, identifier, attr, value FROM entries WHERE identifier NOT IN (SELECT identifier FROM owners)",
            ATTRIBUTES,
        ),
        "match_counts": _ask(
            "SELECT category, count(*) FILTER (o) AS matched, count(*) FILTER (NOT o) AS unmatched "
            "FROM (SELECT category, identifier IN (SELECT identifier FROM owners) AS o FROM firsts) GROUP BY 1",
            ATTRIBUTES,
        ),
        "merge_attributes": _ask("SELECT * FROM merged_attr", ATTRIBUTES, MERGED_ATTR),
        "attribute_types": _ask(
            "SELECT category, attr, k AS ordinal, true AS active FROM early "
            "UNION ALL SELECT category, attr, ordinal + coalesce(n, 0), true FROM types "
            "LEFT JOIN (SELECT category, count(*) AS n FROM early GROUP BY 1) USING (category) "
            "WHERE (category, attr) NOT IN (SELECT (category, attr) FROM early)",
            ATTRIBUTES,
            f"early AS (SELECT category, attr, row_number() OVER (PARTITION BY category ORDER BY ord, attr) - 1 AS k "
            f"FROM ({_duck(EARLIER_TYPES)}))",
        ),
        "add_attribute": _ask(
            "SELECT person_id, category, attr, value FROM person_attr UNION ALL SELECT id, 'review', 'pending', '1' "
            "FROM idx WHERE type = 'person' AND id NOT IN (SELECT person_id FROM person_attr WHERE category = 'activity')",
            ATTRIBUTES,
        ),
        "add_attribute_registry": _ask(
            "SELECT category, split_part(split_part(url, '/', -1), '?', 1) AS filename, "
            "CASE WHEN bool_or(contains(line, chr(9))) THEN 'tab' ELSE 'comma' END AS format, "
            "bool_and(trim(line) = '') AS is_empty, category = 'orders' AS modified FROM lines GROUP BY category, url "
            "UNION ALL SELECT 'review', 'review.txt', 'comma', false, true",
            ATTRIBUTES,
        ),
        "toggle_category": _ask("SELECT category, attr, category <> 'orders' AS active FROM types", ATTRIBUTES),
        "active_attributes_per_person": _ask(PER_PERSON.format(where="WHERE category <> 'orders'"), ATTRIBUTES),
        "active_attributes_all_categories": _ask(PER_PERSON.format(where=""), ATTRIBUTES),
        "active_attribute_list": _ask(
            "SELECT person_id, category || '::' || attr AS key, value FROM shown WHERE category <> 'orders'", ATTRIBUTES
        ),
        "attribute_legend": _ask(
            "SELECT category, attr, active, bool_and(active) OVER (PARTITION BY category) AS all_active FROM some_types "
            "UNION ALL SELECT category, NULL, NULL, NULL FROM lines GROUP BY 1 HAVING bool_and(trim(line) = '')",
            ATTRIBUTES,
        ),
        "person_category_flag": _ask(
            "SELECT person_id, category, attr AS first_attr FROM (SELECT *, row_number() OVER "
            "(PARTITION BY person_id, category ORDER BY first_ord, ord) AS r FROM person_attr) WHERE r = 1",
            ATTRIBUTES,
        ),
        "person_detail": _ask(DETAIL_LIVE, ATTRIBUTES, HULLS, ALL_ORGS),
        "person_detail_old": _ask(DETAIL_OLD, ATTRIBUTES, HULLS),
        "similarity": "SELECT p_partkey, levenshtein(p_name, lower(p_type)) AS distance, "
        "1 - levenshtein(p_name, lower(p_type)) / greatest(len(p_name), len(p_type)) AS similarity FROM part",
        "label_visible": _ask(
            "SELECT id, type = 'person' AND id IN (SELECT person_id FROM shown WHERE category <> 'orders') AS label_visible "
            "FROM idx",
            ATTRIBUTES,
        ),
        "search_nodes": _ask(
            "SELECT id, label, count(*) OVER () >= 100 AS truncated FROM (SELECT * FROM idx "
            "WHERE contains(lower(label), 'er#000') OR contains(lower(id), 'er#000') ORDER BY ord LIMIT 100)"
        ),
        "search_nodes_pseudonyms": _ask(
            "SELECT id, label, count(*) OVER () >= 100 AS truncated FROM (SELECT id, display AS label FROM idx "
            "JOIN display USING (id) WHERE contains(lower(display), 'brand#1') ORDER BY ord LIMIT 100)",
            DICTIONARY,
        ),
        "resolve_node": _ask(
            "SELECT text, coalesce(e.person_id, i.id, (SELECT arg_min(n.id, n.ord) FROM idx n WHERE lower(n.label) = term)) AS id "
            "FROM asked LEFT JOIN emails e ON e.email = term LEFT JOIN idx i ON i.id = term",
            f"asked AS (SELECT DISTINCT text, trim(lower(text)) AS term FROM ({_duck(TEXTS)}))",
        ),
        "org_legend": _ask(
            "SELECT org_id, label, tree.depth, path, org_id IN (SELECT parent FROM org_child) AS has_children, "
            "org_id IN (SELECT 'r' || r_regionkey FROM region) AS visible FROM tree JOIN idx ON id = org_id",
            TREE,
        ),
        "org_legend_filter": _ask(
            "SELECT org_id, tree.depth, path FROM tree WHERE EXISTS (SELECT 1 FROM tree t JOIN idx ON id = t.org_id "
            "WHERE contains(lower(label), 'nation_1') AND (t.path = tree.path OR starts_with(t.path, tree.path || '>')))",
            TREE,
        ),
        "hull_toggle_all": _ask("SELECT id AS org_id FROM idx WHERE as_org"),
        "hull_show_subtree": _ask(
            "SELECT id AS org_id FROM org_below WHERE root_id = 'r1' UNION SELECT 'r' || r_regionkey FROM region"
        ),
        "hull_hide_subtree": _ask(
            "SELECT id AS org_id FROM idx WHERE as_org AND id NOT IN (SELECT id FROM org_below WHERE root_id = 'r1')"
        ),
        "hull_direct_children": _ask(
            "SELECT id AS org_id FROM idx WHERE as_org AND (id = 'r1' OR id IN (SELECT child FROM org_child WHERE parent = 'r1') "
            "OR id NOT IN (SELECT id FROM org_below WHERE root_id = 'r1'))"
        ),
        "hidden_legend": _ask(
            "SELECT root_id, label, count(*) AS size, root_id = 'c2' AS visible FROM hidden JOIN idx ON id = root_id GROUP BY ALL"
        ),
        "hidden_totals": _ask(
            "SELECT (SELECT count(*) FROM reach WHERE id IN (SELECT id FROM hidden_ids)) AS current, "
            "(SELECT count(*) FROM hidden) AS total",
            REACH,
        ),
        "graph_stats": _ask(
            "SELECT (SELECT count(*) FROM nodes) AS nodes_total, (SELECT count(*) FROM links) AS links_total, "
            "(SELECT count(*) FROM merged) AS nodes_visible, "
            "(SELECT count(*) FROM merged JOIN idx USING (id) WHERE type = 'person') AS persons_drawn, "
            "(SELECT count(*) FROM merged_links) AS links_visible, "
            "(SELECT count(*) FROM merged_links JOIN reports USING (source, target)) AS links_drawn, "
            "(SELECT count(*) FROM some_types WHERE active) AS attributes_active, "
            "(SELECT count(*) FROM types) AS attributes_total, (SELECT count(*) FROM allowed) AS allowed_orgs",
            ATTRIBUTES,
            *merged,
        ),
        "export_category": _ask(
            "SELECT coalesce(nullif(email, ''), person_id) || chr(9) || attr AS line FROM person_attr "
            "JOIN idx ON id = person_id WHERE category = 'segment'",
            ATTRIBUTES,
        ),
        "export_lines": _ask(
            "SELECT category, coalesce(nullif(email, ''), person_id) || CASE WHEN category = 'orders' THEN ',' ELSE chr(9) END "
            "|| attr AS line FROM person_attr JOIN idx ON id = person_id",
            ATTRIBUTES,
        ),
        "export_category_tsv": _ask(
            "SELECT coalesce(nullif(email, ''), person_id) || chr(9) || attr AS line FROM person_attr "
            "JOIN idx ON id = person_id WHERE category = 'orders'",
            ATTRIBUTES,
        ),
        "pseudonym_names": _ask("SELECT * FROM alias_names", DICTIONARY),
        "pseudonym_names_folded": _ask("SELECT * FROM alias_names", DICTIONARY),
        "pseudonym_orgs": _ask("SELECT * FROM alias_orgs", DICTIONARY),
        "pseudonym_orgs_folded": _ask(
            "SELECT label, depth, pseudonym FROM alias_orgs JOIN idx USING (label) JOIN depth USING (id)", DICTIONARY
        ),
        "display_label": _ask("SELECT * FROM display", DICTIONARY),
        "display_label_own_depth": _ask("SELECT * FROM display", DICTIONARY),
        "hash32": f"SELECT page_id, {_hash('url')} AS url_hash, {_hash('html')} AS html_hash FROM pages",
        "category_hue": _ask(
            f"SELECT id, {HUE} AS category_hue, {_hash('t')} % 360 AS attribute_hue FROM (SELECT id, label AS t FROM idx)"
        ),
        "org_colour_numbers": _ask(
            f"SELECT id, {_hash('id')} % 360 AS hue, 60 + 5 * depth AS saturation, 45 + 3 * depth AS lightness, "
            f"{_hash('id')} % 12 * 30 AS cluster_hue FROM depth"
        ),
        "palette_slot": _ask(
            "SELECT category, attr, palette, hue, CAST(saturation AS BIGINT) AS saturation, lightness FROM types JOIN palettes ON slot = ordinal % 5 "
            f"UNION ALL SELECT category, attr, 'none', CAST(({HUE} + ordinal % 6 * 10) % 360 AS DOUBLE), 65, 50 + ordinal % 2 * 5 "
            "FROM (SELECT *, category AS t FROM types)",
            ATTRIBUTES,
            _palettes(),
        ),
        "level_band": _ask(
            "SELECT id, CASE WHEN level = 0 THEN 'top' WHEN level <= 2 THEN 'mid' ELSE 'low' END AS band "
            "FROM (SELECT * FROM levels UNION ALL SELECT id, -1 FROM idx WHERE type = 'org')"
        ),
        "attribute_stream": _ask("SELECT * FROM merged_attr", ATTRIBUTES, MERGED_ATTR),
        "reload_kept": _ask(_reloaded("links", "person_attr", "types", "(SELECT DISTINCT category FROM lines)"), ATTRIBUTES),
        "reload_cleared": _ask(_reloaded("(SELECT * FROM links WHERE kind = 'oo')", *["(SELECT 1 WHERE false)"] * 3), ATTRIBUTES),
        "toggle_all_attributes": _ask("SELECT category, attr, category = 'activity' AND attr = 'error' AS active FROM types", ATTRIBUTES),
        "attribute_stream_types": _ask("SELECT category, attr, ordinal, true AS active FROM types", ATTRIBUTES),
        "attribute_stream_registry": _ask(
            "SELECT category, CASE category WHEN 'activity' THEN 'activity.tsv' WHEN 'orders' THEN 'orders.csv' "
            "ELSE category || '.txt' END AS filename, "
            "CASE WHEN bool_or(contains(line, chr(9))) THEN 'tab' ELSE 'comma' END AS format, "
            "bool_and(trim(line) = '') AS is_empty, false AS modified FROM lines GROUP BY category "
            "UNION ALL SELECT 'void', 'void.txt', 'comma', true, false",
            ATTRIBUTES,
        ),
        "load_attributes": _ask(
            "SELECT * FROM merged_attr UNION ALL "
            "SELECT DISTINCT person_id, 'mark', 'by hand', '1' FROM merged_attr WHERE category = 'segment'",
            ATTRIBUTES,
            MERGED_ATTR,
        ),
    }
