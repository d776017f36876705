"""An organisation graph derived from the sales tables.

Customers are persons in a management tree, nations, regions and suppliers
(as teams) are orgs.  The raw collections contain what the cleaning rules are
about: repeated records, empty ids, repeated links, loops and dangling ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph, build_graph
from ..operators.attributes import match_attributes, merge_attributes, register_attribute_types
from ..operators.numbering import dense_index
from ..operators.traverse import org_depth
from ..operators.visibility import Hidden, hide_subtree
from ..session import configure, empty_like, materialize, rows_of, scratch_path
from ..sources.attributes import attribute_names, category_registry, parse_attribute_lines
from ..sources.slots import Slots

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "events", "pages")

PERSONS = """
SELECT concat('c', c_custkey) AS id, c_name AS label, concat(lower(c_name), '@example.com') AS email,
       c_acctbal < 5000 AS is_basis, CAST(c_custkey AS BIGINT) AS ord FROM {customer}
UNION ALL
SELECT concat('c', c_custkey), concat(c_name, ' (2)'), concat(lower(c_name), '@example.com'),
       c_acctbal < -500, 1000000000 + c_custkey FROM {customer} WHERE c_acctbal < 0
UNION ALL
SELECT '', s_name, NULL, false, 2000000000 + s_suppkey FROM {supplier}
"""

ORGS = """
SELECT concat('n', n_nationkey) AS id, n_name AS label, CAST(n_nationkey AS BIGINT) AS ord FROM {nation}
UNION ALL SELECT concat('r', r_regionkey), r_name, 1000 + r_regionkey FROM {region}
UNION ALL SELECT min('w'), min('WORLD'), min(2000) FROM {region}
UNION ALL SELECT concat('s', s_suppkey), s_name, 3000 + s_suppkey FROM {supplier}
"""

# Tree of eight reports each, dotted lines to a second manager, memberships in
# nations, some regions and some teams, and two parents for some nations.
CLEAN_LINKS = """
SELECT concat('c', (c_custkey - 1) div 8) AS source, concat('c', c_custkey) AS target,
       CAST(c_custkey AS BIGINT) AS ord FROM {customer} WHERE c_custkey > 0
UNION ALL
SELECT concat('c', c_custkey div 9), concat('c', c_custkey), 1000000000 - c_custkey
FROM {customer} WHERE c_mktsegment = 'MACHINERY'
UNION ALL
SELECT concat('c', c_custkey), concat('n', c_nationkey), 2000000000 + c_custkey FROM {customer}
UNION ALL
SELECT concat('c', c_custkey), concat('r', n_regionkey), 3000000000 + c_custkey
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'
UNION ALL
SELECT concat('c', c_custkey), concat('s', team), 4000000000 + c_custkey
FROM {customer} JOIN (SELECT s_nationkey, min(s_suppkey) AS team FROM {supplier} GROUP BY s_nationkey)
  ON c_nationkey = s_nationkey WHERE c_mktsegment = 'FURNITURE'
UNION ALL
SELECT concat('w'), concat('r', r_regionkey), 5000000000 + r_regionkey FROM {region}
UNION ALL
SELECT concat('r', n_regionkey), concat('n', n_nationkey), 5000001000 + n_nationkey FROM {nation}
UNION ALL
SELECT concat('r', 4 - n_regionkey), concat('n', n_nationkey), 5000002000 + n_nationkey
FROM {nation} WHERE n_nationkey > 19
UNION ALL
SELECT concat('n', s_nationkey), concat('s', s_suppkey), 5000003000 + s_suppkey FROM {supplier}
"""

RAW_LINKS = f"""
WITH base AS ({CLEAN_LINKS})
SELECT source, target, ord FROM base
UNION ALL SELECT source, target, ord + 9000000000 FROM base
UNION ALL SELECT concat('r', r_regionkey), concat('r', r_regionkey), 6000000000 + r_regionkey FROM {{region}}
UNION ALL SELECT concat('n', n_nationkey), concat('zz', n_nationkey), 6000001000 + n_nationkey FROM {{nation}}
"""

# Three attribute files and a file of blank lines.  Solvent customers appear by
# e-mail in capitals, the others by id and then again by e-mail.
LINES = """
SELECT 'attrs/segment.txt' AS url, CAST(1 AS BIGINT) AS batch, CAST(c_custkey AS BIGINT) AS ord,
       concat(CASE WHEN c_acctbal >= 0 THEN upper(concat(c_name, '@example.com')) ELSE concat('c', c_custkey) END,
              '\t', c_mktsegment) AS line FROM {customer}
UNION ALL
SELECT 'attrs/segment.txt', 1, 1000000000 + c_custkey, concat(c_name, '@EXAMPLE.com\t', c_mktsegment, '\tMAIL')
FROM {customer} WHERE c_acctbal < 0
UNION ALL
SELECT 'attrs/segment.txt', 1, 2000000000 + s_suppkey, concat('s', s_suppkey, '\tSUPPLIER') FROM {supplier}
UNION ALL
SELECT 'attrs/segment.txt', 1, 3000000000 + r_regionkey, r_name FROM {region}
UNION ALL
SELECT 'attrs/activity.tsv?v=2', 2, event_id,
       concat('c', user_id, '\t', event_type, '\t', get_json_object(props, '$.k')) FROM {events}
UNION ALL
SELECT 'attrs/orders.csv', 3, o_orderkey,
       concat(' c', o_custkey, ' , ', o_orderpriority,
              CASE WHEN o_orderstatus = 'F' THEN ' , done' WHEN o_orderstatus = 'P' THEN ',' ELSE '' END) FROM {orders}
UNION ALL
SELECT 'attrs/planned.txt', 4, CAST(r_regionkey AS BIGINT), '  ' FROM {region}
"""

POSITIONS = """
SELECT concat('c', c_custkey) AS id, CAST(c_custkey % 97 AS DOUBLE) AS x,
       CAST((c_custkey * 31) % 89 AS DOUBLE) AS y FROM {customer}
"""

# Roots of the sample questions.
ROOT, HIDDEN_ROOTS, SHOWN_ROOTS = "c9", ("c1", "c2", "c9"), ("c2",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ask(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in sql})


class Warehouse:
    """The derived graph and its attribute tables, each written once per session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = configure(spark), sf_dir
        self._made: dict[str, object] = {}

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def ask(self, sql: str) -> DataFrame:
        return ask(self.spark, self.dir, sql)

    def stored(self, name: str, make) -> DataFrame:
        return self._once(name, lambda: materialize(make(), name).df)

    @property
    def raw(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.ask(PERSONS), self.ask(ORGS), self.ask(RAW_LINKS)

    @property
    def graph(self) -> Graph:
        return self._once("graph", lambda: build_graph(*self.raw))

    @property
    def depth(self) -> DataFrame:
        return self.stored("depth", lambda: org_depth(self.graph))

    @property
    def lines(self) -> DataFrame:
        return self.ask(LINES).selectExpr(
            "regexp_extract(url, '([^/]+)[.][^.]+$', 1) AS category", "url", "batch", "ord", "line"
        )

    @property
    def files(self) -> DataFrame:
        return self.lines.select("category", "url", "batch").distinct()

    @property
    def entries(self) -> DataFrame:
        return self.stored("entries", lambda: parse_attribute_lines(self.lines))

    @property
    def person_attr(self) -> DataFrame:
        def make() -> DataFrame:
            matched = match_attributes(self.graph, self.entries).person_attr
            return merge_attributes(empty_like(matched), matched)

        return self.stored("person_attr", make)

    @property
    def attr_slots(self) -> Slots:
        """``person_attr`` by slots of its categories, as loads grow it."""

        def make() -> Slots:
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.person_attr.schema.fields)
            return Slots(self.spark, schema, {}).append(self.person_attr, scratch_path(self.spark, "attr_slots"))

        return self._once("attr_slots", make)

    @property
    def types(self) -> DataFrame:
        none = rows_of(self.spark, [], "category STRING, attr STRING, ordinal BIGINT, active BOOLEAN")
        return self.stored("types", lambda: register_attribute_types(none, attribute_names(self.entries)))

    @property
    def registry(self) -> DataFrame:
        return self.stored("registry", lambda: category_registry(self.lines, self.files))

    @property
    def positions(self) -> DataFrame:
        return self.ask(POSITIONS)

    @property
    def dictionary(self) -> tuple[DataFrame, DataFrame]:
        """Part names for persons, brands for level 0, types for level 1, none below."""
        names = self.ask("SELECT p_name AS name, min(p_partkey) AS at FROM {part} GROUP BY p_name")
        orgs = self.ask(
            "SELECT CAST(0 AS BIGINT) AS level, p_brand AS name, min(p_partkey) AS at FROM {part} GROUP BY p_brand "
            "UNION ALL SELECT 1, p_type, min(p_partkey) FROM {part} GROUP BY p_type"
        )
        return (
            self.stored("names", lambda: dense_index(names, ["at", "name"]).select("idx", "name")),
            self.stored("units", lambda: dense_index(orgs, ["at", "name"], ("level",)).select("level", "idx", "name")),
        )

    def roots(self, *ids: str) -> DataFrame:
        return rows_of(self.spark, [(i, n) for n, i in enumerate(ids)], "root_id STRING, root_ord BIGINT")

    def orgs(self, *ids: str) -> DataFrame:
        return rows_of(self.spark, [(i,) for i in ids], "org_id STRING")

    @property
    def all_orgs(self) -> DataFrame:
        return self.graph.index.filter("as_org").selectExpr("id AS org_id")

    @property
    def hidden(self) -> Hidden:
        none = rows_of(self.spark, [], "root_id STRING, node_id STRING")
        by_root = self.stored("hidden", lambda: hide_subtree(self.graph, none, self.roots(*HIDDEN_ROOTS)))
        return Hidden(by_root, self.roots(*SHOWN_ROOTS).select("root_id"))


_open: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Warehouse(spark, sf_dir)
    return _open[key]
