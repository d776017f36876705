"""Column contracts of the tables that pass between operators.

persons     id, label, email, is_basis, ord (+ any further columns)
orgs        id, label, ord (+ any further columns)
raw links   source, target, ord
nodes       id, type, label, email, is_basis, ord        one row per input record
index       nodes columns + as_person, as_org             one row per id
links       source, target, ord, kind, s_type, t_type, s_person, s_org, t_person, t_org
org_parent  child, parent                                 one parent per org
org_child   parent, child                                 every parent-child link
person_org  person_id, org_id, ord
lines       file, ord, line
entries     category, identifier, attr, value, ord
person_attr person_id, category, attr, value, batch, ord
attr_type   category, attr, ordinal, active
registry    category, filename, url, format, is_empty, modified
hidden      root_id, node_id

``ord`` is the position in the source. Rules such as "last one wins" and
"first hundred" depend on it, so it travels with every table.
"""

PERSON_FIELDS = "id STRING, label STRING, email STRING, is_basis BOOLEAN, ord BIGINT"
ORG_FIELDS = "id STRING, label STRING, ord BIGINT"
# Position of a line: part file, start of the split, row of the task.
PLACE = "STRUCT<part: STRING, block: BIGINT, row: BIGINT>"
ATTR_FIELDS = (
    "person_id STRING, category STRING, attr STRING, value STRING, batch BIGINT, "
    f"first_ord {PLACE}, ord {PLACE}"
)
LINK_FIELDS = "source STRING, target STRING, ord BIGINT"

# Org records come after all person records.
ORG_ORD_BASE = 1 << 62

# Fixed values the results depend on.
SEARCH_LIMIT = 100
SEARCH_MIN_CHARS = 2
MAX_ROOTS = 5
UNREACHABLE_LEVEL = 999
NODE_RADIUS = 8.0
NODE_STROKE_WIDTH = 3.0
ATTRIBUTE_RING_GAP = 4.0
CLUSTER_PAD = 12.0
