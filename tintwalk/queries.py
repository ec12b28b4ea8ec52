"""A query for each operator, over the systems of ``sources.tables``, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwalk import formula as f
from tintwalk import formula_text
from tintwalk.functions.colours import Arrays, Encoding, Masks, decoded, encoded
from tintwalk.operators import components, partitioning, relations, sets, temporal
from tintwalk.plans.checker import Checker
from tintwalk.plans.set_checker import SetChecker, encoding_of
from tintwalk.sources import tables, text
from tintwalk.sources.cube import Cube
from tintwalk.system import TransitionSystem

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# ---- SQL of the systems: states, colours, space and e(src, dst, facet, colour)

KINDS = "CASE event_type " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(tables.EVENT_TYPES)) + " END"
FIVE = "colours AS (SELECT CAST(c AS INTEGER) AS colour FROM range(5) t(c)), space AS (SELECT state, colour FROM states, colours)"
SYSTEMS = {
    "journey": f"""
ev AS (SELECT user_id, ts, event_id, CAST(user_id * 5 + {KINDS} AS BIGINT) AS s, value FROM events),
nx AS (SELECT s AS src, lead(s) OVER w AS dst, coalesce(lead(value) OVER w - value, 0) AS change, CAST(day(ts) % 5 AS INTEGER) AS colour FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
raw AS (SELECT DISTINCT src, dst, CASE WHEN change > 0 THEN '+' WHEN change < 0 THEN '-' ELSE 'TRUE' END AS facet, colour FROM nx WHERE dst IS NOT NULL),
states AS (SELECT DISTINCT CAST(user_id * 5 + k AS BIGINT) AS state FROM events, range(5) t(k)), {FIVE}""",
    "handoff": f"""
raw AS (SELECT DISTINCT src, dst, 'TRUE' AS facet, colour FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, CAST({KINDS} AS INTEGER) AS colour FROM events) WHERE dst IS NOT NULL),
states AS (SELECT DISTINCT user_id AS state FROM events), {FIVE}""",
    "hierarchy": f"""
states AS (SELECT o_orderkey + {tables.ORDERS_AT} AS state, 'order' AS level FROM orders UNION SELECT c_custkey + {tables.CUSTOMERS_AT}, 'customer' FROM customer
  UNION SELECT n_nationkey + {tables.NATIONS_AT}, 'nation' FROM nation UNION SELECT r_regionkey, 'region' FROM region), {FIVE},
raw AS (SELECT o_orderkey + {tables.ORDERS_AT} AS src, o_custkey + {tables.CUSTOMERS_AT} AS dst, 'TRUE' AS facet, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS colour FROM orders
  UNION SELECT c_custkey + {tables.CUSTOMERS_AT}, c_nationkey + {tables.NATIONS_AT}, 'TRUE', colour FROM customer, colours
  UNION SELECT n_nationkey + {tables.NATIONS_AT}, n_regionkey, 'TRUE', colour FROM nation, colours)""",
}
BUILDERS = {"journey": tables.journey, "handoff": tables.handoff, "hierarchy": tables.hierarchy}


def sql(system: str, body: str, total: bool = False, past: bool = False, ctes: str = "") -> str:
    edges = "SELECT src, dst, facet, colour FROM raw"
    if total:
        edges += " UNION ALL SELECT state, state, 'LOOP', colour FROM space WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.src = space.state AND r.colour = space.colour)"
    if past:
        edges = f"SELECT dst AS src, src AS dst, CASE facet WHEN '+' THEN '-' WHEN '-' THEN '+' ELSE facet END AS facet, colour FROM ({edges})"
    more = f", {ctes}" if ctes else ""
    return f"WITH RECURSIVE {SYSTEMS[system]}, e AS ({edges}){more} {body}"


def holds(condition: str) -> str:
    return f"SELECT state, colour FROM space WHERE {condition}"


def next_sql(every: bool, goal: str, along: str = "true") -> str:
    """A condition on (state, colour) of ``space``; ``goal`` and ``along`` are conditions on an edge ``x``."""
    edge = "SELECT 1 FROM e x WHERE x.src = space.state AND x.colour = space.colour"
    some = f"EXISTS ({edge} AND ({along}) AND ({goal}))"
    return f"{some} AND NOT EXISTS ({edge} AND NOT (({along}) AND ({goal})))" if every else some


def until_ctes(every: bool, path: str, goal: str, along: str = "true", weak: bool = False) -> str:
    """``r(state, colour)``: the until; ``path`` and ``goal`` are conditions on ``state``, ``along`` on the facet of an edge ``x``."""
    out = "SELECT 1 FROM e x WHERE x.src = space.state AND x.colour = space.colour"
    if not every:
        seed = f"({goal})" + (f" OR EXISTS ({out} AND NOT ({along}))" if weak else "")
        return f"""p AS (SELECT state FROM states WHERE {path}),
r AS (SELECT state, colour FROM space WHERE {seed} UNION SELECT x.src, x.colour FROM r JOIN e x ON x.dst = r.state AND x.colour = r.colour JOIN p ON p.state = x.src WHERE {along})"""
    seed = f"({goal})" + (f" OR NOT EXISTS ({out} AND ({along}))" if weak else "")
    return f"""g AS (SELECT state, colour FROM space WHERE {seed}),
h AS (SELECT state, colour FROM space EXCEPT SELECT state, colour FROM g),
n AS (SELECT DISTINCT x.src, x.dst, x.colour FROM e x JOIN h a ON a.state = x.src AND a.colour = x.colour JOIN h b ON b.state = x.dst AND b.colour = x.colour),
tc AS (SELECT src, dst, colour FROM n UNION SELECT tc.src, n.dst, tc.colour FROM tc JOIN n ON n.src = tc.dst AND n.colour = tc.colour),
worst AS (SELECT state, colour FROM h WHERE NOT ({path})
  UNION SELECT state, colour FROM h AS space WHERE NOT EXISTS ({out}) OR EXISTS ({out} AND NOT ({along}))
  UNION SELECT src, colour FROM tc WHERE src = dst),
lost AS (SELECT state, colour FROM worst UNION SELECT tc.src, tc.colour FROM tc JOIN worst w ON w.state = tc.dst AND w.colour = tc.colour),
r AS (SELECT state, colour FROM space EXCEPT SELECT state, colour FROM lost)"""


R, NOT_R = "SELECT state, colour FROM r", "SELECT state, colour FROM space EXCEPT SELECT state, colour FROM r"


def system_of(name: str, total: bool = False) -> Callable[[SparkSession, str], TransitionSystem]:
    def build(spark: SparkSession, sf_dir: str) -> TransitionSystem:
        made = BUILDERS[name](spark, sf_dir)
        return made.totalised() if total else made

    return build


def asks(name: str, system: str, query: f.Formula, body: str, total: bool = False, past: bool = False, ctes: str = "") -> None:
    build = system_of(system, total)
    QUERIES[name] = lambda spark, sf_dir: Checker(build(spark, sf_dir)).verify(query)
    ORACLES[name] = sql(system, body, total, past, ctes)


def does(name: str, system: str, run: Callable[[TransitionSystem], DataFrame], body: str, total: bool = False, ctes: str = "") -> None:
    build = system_of(system, total)
    QUERIES[name] = lambda spark, sf_dir: run(build(spark, sf_dir))
    ORACLES[name] = sql(system, body, total, False, ctes)


# ---- propositions

kind = lambda v: f.where(f"event_type = '{v}'")
is_kind = lambda v, of="state": f"{of} % 5 = {tables.EVENT_TYPES.index(v)}"
level = lambda v: f.where(f"level = '{v}'")
AT_LEVEL = {"region": (0, tables.NATIONS_AT), "nation": (tables.NATIONS_AT, tables.CUSTOMERS_AT), "customer": (tables.CUSTOMERS_AT, tables.ORDERS_AT), "order": (tables.ORDERS_AT, 2 * tables.ORDERS_AT)}
is_level = lambda v, of="state": f"{of} >= {AT_LEVEL[v][0]} AND {of} < {AT_LEVEL[v][1]}"
RISES, FALLS = f.up("value"), f.down("value")

asks("atom_true", "journey", f.TRUE, holds("true"))
asks("atom_false", "journey", f.FALSE, holds("false"))
asks(
    "atom_float",
    "journey",
    f.where("2 * user_id + 1 > 40 AND event_type = 'purchase'"),
    holds("2 * (state // 5) + 1 > 40 AND " + is_kind("purchase")),
)
asks(
    "atom_transition",
    "journey",
    f.steps_in(RISES),
    holds("EXISTS (SELECT 1 FROM e x WHERE x.dst = state AND x.colour = space.colour AND facet = '+')"),
)
asks(
    "atom_transition_out",
    "journey",
    f.steps_out(FALLS),
    holds("EXISTS (SELECT 1 FROM e x WHERE x.src = state AND x.colour = space.colour AND facet = '-')"),
)
asks("state_ref", "journey", f.var(12), holds("state = 12"))


def _with_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of propositions: users' kinds of event that occurred on a day of the colour."""
    made = tables.journey(spark, sf_dir)
    seen = made.edges.select(F.lit("seen == 1").alias("atom"), F.col("src").alias("state"), "colour")
    return Checker(TransitionSystem(made.states, made.colours, made.edges, seen)).verify(f.atom("seen==1") & ~f.atom("undeclared"))


QUERIES["atom_table"] = _with_atoms
ORACLES["atom_table"] = sql("journey", "SELECT DISTINCT src AS state, colour FROM e")

asks("bool_not", "journey", ~kind("purchase"), holds(f"NOT ({is_kind('purchase')})"))
asks(
    "bool_and",
    "journey",
    f.EX(kind("view")) & f.EX(kind("click")),
    holds(f"{next_sql(False, is_kind('view', 'x.dst'))} AND {next_sql(False, is_kind('click', 'x.dst'))}"),
)
asks("bool_or", "journey", f.EX(kind("view")) | kind("click"), holds(f"{next_sql(False, is_kind('view', 'x.dst'))} OR {is_kind('click')}"))
asks(
    "bool_implies",
    "journey",
    f.EX(kind("view")).implies(kind("click")),
    holds(f"NOT {next_sql(False, is_kind('view', 'x.dst'))} OR {is_kind('click')}"),
)
asks(
    "bool_iff",
    "journey",
    f.EX(kind("view")).iff(f.EX(kind("click"))),
    holds(f"({next_sql(False, is_kind('view', 'x.dst'))}) = ({next_sql(False, is_kind('click', 'x.dst'))})"),
)

NEXT = {
    "ex": (f.EX, lambda goal, along="true": next_sql(False, goal, along)),
    "ax": (f.AX, lambda goal, along="true": next_sql(True, goal, along)),
    "ewx": (f.EwX, lambda goal, along="true": f"NOT ({next_sql(True, f'NOT ({goal})', along)})"),
    "awx": (f.AwX, lambda goal, along="true": f"NOT ({next_sql(False, f'NOT ({goal})', along)})"),
}
for op, (build, cond) in NEXT.items():
    asks(
        op,
        "hierarchy",
        build(level("nation") | level("region")),
        holds(cond(f"{is_level('nation', 'x.dst')} OR {is_level('region', 'x.dst')}")),
    )
    asks(
        f"{op}_dir",
        "journey",
        build(kind("purchase") | kind("view"), RISES),
        holds(cond(f"{is_kind('purchase', 'x.dst')} OR {is_kind('view', 'x.dst')}", "x.facet = '+'")),
    )
for op, build in {"ex": f.pEX, "ax": f.pAX, "ewx": f.pEwX, "awx": f.pAwX}.items():
    asks(
        f"p_{op}",
        "hierarchy",
        build(level("order") | level("customer")),
        holds(NEXT[op][1](f"{is_level('order', 'x.dst')} OR {is_level('customer', 'x.dst')}")),
        past=True,
    )
asks("p_ex_dir", "journey", f.pEX(kind("view"), RISES), holds(next_sql(False, is_kind("view", "x.dst"), "x.facet = '+'")), past=True)
asks(
    "dir_and_or_not",
    "journey",
    f.EX(kind("view"), ~RISES & (FALLS | ~FALLS)),
    holds(next_sql(False, is_kind("view", "x.dst"), "x.facet <> '+'")),
)
asks(
    "dir_implies_iff",
    "journey",
    f.EX(kind("view"), RISES.implies(FALLS) | RISES.iff(FALLS)),
    holds(next_sql(False, is_kind("view", "x.dst"), "x.facet <> '+'")),
)
asks("dir_loop", "journey", f.EX(f.TRUE, f.LOOPING), holds("false"), total=True)

asks("ef", "journey", f.EF(kind("purchase")), R, ctes=until_ctes(False, "true", is_kind("purchase")))
asks(
    "eu",
    "journey",
    f.EU(kind("view") | kind("click"), kind("purchase")),
    R,
    ctes=until_ctes(False, f"{is_kind('view')} OR {is_kind('click')}", is_kind("purchase")),
)
asks("eu_false", "journey", f.EU(f.FALSE, kind("purchase")), R, ctes=until_ctes(False, "false", is_kind("purchase")))
asks("p_ef", "journey", f.pEF(kind("signup")), R, past=True, ctes=until_ctes(False, "true", is_kind("signup")))
asks(
    "p_eu",
    "journey",
    f.pEU(kind("view") | kind("click"), kind("signup")),
    R,
    past=True,
    ctes=until_ctes(False, f"{is_kind('view')} OR {is_kind('click')}", is_kind("signup")),
)
asks("ef_dir", "journey", f.EF(kind("purchase"), RISES), R, ctes=until_ctes(False, "true", is_kind("purchase"), "x.facet = '+'"))
asks(
    "eu_dir",
    "journey",
    f.EU(kind("view"), kind("purchase"), ~FALLS),
    R,
    ctes=until_ctes(False, is_kind("view"), is_kind("purchase"), "x.facet <> '-'"),
)
asks("ewf", "journey", f.EwF(kind("purchase")), R, ctes=until_ctes(False, "true", is_kind("purchase"), weak=True))
asks(
    "ewf_dir",
    "journey",
    f.EwF(kind("purchase"), RISES),
    R,
    ctes=until_ctes(False, "true", is_kind("purchase"), "x.facet = '+'", weak=True),
)
asks("af", "journey", f.AF(kind("purchase")), R, total=True, ctes=until_ctes(True, "true", is_kind("purchase")))
asks("af_deadlocks", "hierarchy", f.AF(level("region")), R, ctes=until_ctes(True, "true", is_level("region")))
asks(
    "au",
    "journey",
    f.AU(kind("view") | kind("click"), kind("purchase")),
    R,
    total=True,
    ctes=until_ctes(True, f"{is_kind('view')} OR {is_kind('click')}", is_kind("purchase")),
)
asks("p_af", "journey", f.pAF(kind("signup")), R, total=True, past=True, ctes=until_ctes(True, "true", is_kind("signup")))
asks(
    "p_au",
    "journey",
    f.pAU(kind("view") | kind("click"), kind("signup")),
    R,
    total=True,
    past=True,
    ctes=until_ctes(True, f"{is_kind('view')} OR {is_kind('click')}", is_kind("signup")),
)
asks(
    "au_dir",
    "journey",
    f.AU(kind("view") | kind("click"), kind("purchase"), RISES),
    R,
    total=True,
    ctes=until_ctes(True, f"{is_kind('view')} OR {is_kind('click')}", is_kind("purchase"), "x.facet = '+'"),
)
asks("awf", "journey", f.AwF(kind("purchase")), R, ctes=until_ctes(True, "true", is_kind("purchase"), weak=True))
asks(
    "awf_dir",
    "journey",
    f.AwF(kind("purchase"), RISES),
    R,
    total=True,
    ctes=until_ctes(True, "true", is_kind("purchase"), "x.facet = '+'", weak=True),
)
asks("eg", "journey", f.EG(~kind("purchase")), NOT_R, total=True, ctes=until_ctes(True, "true", is_kind("purchase")))
asks("ag", "journey", f.AG(~kind("error")), NOT_R, total=True, ctes=until_ctes(False, "true", is_kind("error")))
asks("p_eg", "journey", f.pEG(~kind("signup")), NOT_R, total=True, past=True, ctes=until_ctes(True, "true", is_kind("signup")))
asks("p_ag", "journey", f.pAG(~kind("error")), NOT_R, total=True, past=True, ctes=until_ctes(False, "true", is_kind("error")))
asks(
    "eg_dir",
    "journey",
    f.EG(~kind("purchase"), RISES),
    NOT_R,
    total=True,
    ctes=until_ctes(True, "true", is_kind("purchase"), "x.facet = '+'", weak=True),
)
asks(
    "ag_dir",
    "journey",
    f.AG(~kind("error"), RISES),
    NOT_R,
    total=True,
    ctes=until_ctes(False, "true", is_kind("error"), "x.facet = '+'", weak=True),
)
AG_EF = "space EXCEPT SELECT state, colour FROM s"
AG_EF_CTES = until_ctes(False, "true", is_kind("purchase")) + ", s AS (SELECT state, colour FROM (SELECT state, colour FROM space EXCEPT SELECT state, colour FROM r) UNION SELECT x.src, x.colour FROM s JOIN e x ON x.dst = s.state AND x.colour = s.colour)"
asks("ag_ef_purchase", "journey", f.AG(f.EF(kind("purchase"))), f"SELECT state, colour FROM {AG_EF}", total=True, ctes=AG_EF_CTES)

# ---- hybrid and first-order

REACH = "tc AS (SELECT src, dst, colour FROM e UNION SELECT tc.src, x.dst, tc.colour FROM tc JOIN e x ON x.src = tc.dst AND x.colour = tc.colour)"
small = lambda n: f.where(f"state % {n} = 0")
TWO_STEPS = "EXISTS (SELECT 1 FROM e x JOIN e y ON y.src = x.dst AND y.colour = x.colour WHERE x.src = state AND x.colour = space.colour AND {})"
asks(
    "exists_in",
    "journey",
    f.exists("x", f.EX(f.var("x") & f.EX(kind("view"))), bound=kind("purchase")),
    holds(TWO_STEPS.format(f"{is_kind('purchase', 'x.dst')} AND {is_kind('view', 'y.dst')}")),
)
asks(
    "exists_coloured_bound",
    "journey",
    f.exists("x", f.EX(f.var("x")), bound=f.EX(kind("error"))),
    holds(TWO_STEPS.format(is_kind("error", "y.dst"))),
)
asks(
    "exists_unused",
    "journey",
    f.exists("x", kind("view"), bound=f.EX(kind("error"))),
    holds(f"{is_kind('view')} AND EXISTS (SELECT 1 FROM e y WHERE y.colour = space.colour AND {is_kind('error', 'y.dst')})"),
)
asks(
    "forall_in",
    "handoff",
    f.forall("x", f.EX(f.var("x")), bound=f.var(5) | f.var(7)),
    holds("NOT EXISTS (SELECT 1 FROM states b WHERE b.state IN (5, 7) AND NOT EXISTS (SELECT 1 FROM e x WHERE x.src = space.state AND x.dst = b.state AND x.colour = space.colour))"),
)
asks(
    "forall_not_in",
    "hierarchy",
    f.forall("x", ~f.EX(f.var("x")), bound=level("region")),
    holds(f"NOT EXISTS (SELECT 1 FROM e x WHERE x.src = state AND x.colour = space.colour AND {is_level('region', 'x.dst')})"),
)
asks(
    "exists_free",
    "handoff",
    f.exists("x", f.var("x") & f.EX(f.var("x"))),
    holds("EXISTS (SELECT 1 FROM e x WHERE x.src = state AND x.dst = state AND x.colour = space.colour)"),
)
asks(
    "forall_free",
    "handoff",
    f.forall("x", f.var("x").implies(f.EX(f.var("x")))),
    holds("EXISTS (SELECT 1 FROM e x WHERE x.src = state AND x.dst = state AND x.colour = space.colour)"),
)
asks("bind_cycle", "journey", f.bind("x", f.EX(f.EF(f.var("x")))), "SELECT src AS state, colour FROM tc WHERE src = dst", ctes=REACH)
asks(
    "bind_two_steps",
    "handoff",
    f.bind("x", f.EX(f.EX(f.var("x")))),
    holds("EXISTS (SELECT 1 FROM e x JOIN e y ON y.src = x.dst AND y.colour = x.colour WHERE x.src = state AND y.dst = state AND x.colour = space.colour)"),
)
asks(
    "at_state",
    "handoff",
    f.at(5, f.EX(small(7))),
    holds("EXISTS (SELECT 1 FROM e x WHERE x.src = 5 AND x.colour = space.colour AND x.dst % 7 = 0)"),
)
asks(
    "at_bound_state",
    "handoff",
    f.bind("x", f.EX(f.at("x", f.EX(small(7))))),
    holds(f"{next_sql(False, 'true')} AND {next_sql(False, 'x.dst % 7 = 0')}"),
)
asks(
    "bind_stable",
    "handoff",
    f.bind("x", f.AG(f.EF(f.var("x")))),
    holds("NOT EXISTS (SELECT 1 FROM tc t WHERE t.src = state AND t.colour = space.colour AND t.dst <> t.src AND NOT EXISTS (SELECT 1 FROM tc b WHERE b.src = t.dst AND b.dst = t.src AND b.colour = t.colour))"),
    ctes=REACH,
)
asks(
    "shadowed_name",
    "handoff",
    f.bind("x", f.EX(f.bind("x", f.EX(f.var("x"))))),
    holds("EXISTS (SELECT 1 FROM e x JOIN e y ON y.src = x.dst AND y.dst = x.dst AND y.colour = x.colour WHERE x.src = state AND x.colour = space.colour)"),
)


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several formulas that share what they have in common."""
    reachable = f.EF(kind("purchase"))
    found = Checker(tables.journey(spark, sf_dir)).verify({"reachable": reachable, "next": f.EX(reachable), "never": ~reachable})
    rows = [df.withColumn("formula", F.lit(name)) for name, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES["multi_formula_batch"] = _batch
ORACLES["multi_formula_batch"] = sql("journey", f"""SELECT state, colour, 'reachable' AS formula FROM r
UNION ALL SELECT DISTINCT x.src, x.colour, 'next' FROM e x JOIN r ON r.state = x.dst AND r.colour = x.colour UNION ALL SELECT state, colour, 'never' FROM ({NOT_R})""", ctes=until_ctes(False, "true", is_kind("purchase")))  # fmt: skip

def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each kind of fixpoint has added in all its rounds."""
    checker = Checker(tables.journey(spark, sf_dir))
    checker.verify(f.EF(kind("purchase")))
    return checker.statistics().groupBy("fixpoint").agg(F.sum("rows").alias("rows"))


QUERIES["statistics"] = _statistics
ORACLES["statistics"] = sql("journey", "SELECT 'exists-until' AS fixpoint, count(*) AS rows FROM r", ctes=until_ctes(False, "true", is_kind("purchase")))

# ---- sets of colours

OUT, IN = "SELECT DISTINCT src AS state, colour FROM e", "SELECT DISTINCT dst AS state, colour FROM e"


def _coloured(how: Encoding, combine) -> Callable[[TransitionSystem], DataFrame]:
    """Combine each state's colours of outgoing edges (``a``) with those of incoming ones (``b``), in the encoding ``how``."""

    def run(system: TransitionSystem) -> DataFrame:
        a, b = (encoded(df, how, name) for df, name in ((temporal.sources(system.edges), "a"), (temporal.targets(system.edges), "b")))
        both = system.states.select("state").join(a, "state", "left").join(b, "state", "left")
        a, b = (F.coalesce(F.col(x), how.none()) for x in "ab")
        return combine(how, both, a, b)

    return run


def _set(pick):
    return lambda how, df, a, b: decoded(df.select("state", pick(how, a, b).alias("colours")), how)


def _test(pick):
    return lambda how, df, a, b: df.select("state", pick(how, a, b).alias("holds"))


SET_TESTS = {
    "colour_and": (_set(lambda how, a, b: how.both(a, b)), f"{OUT} INTERSECT {IN}"),
    "colour_or": (_set(lambda how, a, b: how.either(a, b)), f"{OUT} UNION {IN}"),
    "colour_not": (_set(lambda how, a, b: how.other(a)), f"SELECT state, colour FROM space EXCEPT {OUT}"),
    "colour_andnot": (_test(lambda how, a, b: how.has_more(a, b)), f"SELECT state, EXISTS (SELECT 1 FROM ({OUT} EXCEPT {IN}) d WHERE d.state = states.state) AS holds FROM states"),
    "colour_equals": (_test(lambda how, a, b: how.same(a, b)), f"SELECT state, NOT EXISTS (SELECT 1 FROM (({OUT} EXCEPT {IN}) UNION ({IN} EXCEPT {OUT})) d WHERE d.state = states.state) AS holds FROM states"),
    "colour_sat": (_test(lambda how, a, b: how.is_some(a)), f"SELECT state, EXISTS (SELECT 1 FROM ({OUT}) d WHERE d.state = states.state) AS holds FROM states"),
    "colour_minus": (_set(lambda how, a, b: how.both(a, how.other(b))), f"{OUT} EXCEPT {IN}"),
}
for name, (combine, body) in SET_TESTS.items():
    does(f"{name}_mask", "journey", _coloured(Masks(5), combine), body)
    does(f"{name}_array", "journey", _coloured(Arrays(tuple(range(5))), combine), body)
does(
    "colour_union_rows",
    "journey",
    lambda s: relations.disjunction(temporal.sources(s.edges), temporal.targets(s.edges), s.states),
    f"{OUT} UNION {IN}",
)
does(
    "pretty",
    "journey",
    lambda s: relations.pretty(temporal.sources(s.edges)).select("state", F.array_join("colours", ",").alias("colours")),
    f"SELECT state, string_agg(colour, ',' ORDER BY colour) AS colours FROM ({OUT}) GROUP BY state",
)
does(
    "different",
    "journey",
    lambda s: relations.different(temporal.sources(s.edges), temporal.targets(s.edges)),
    f"SELECT *, 'left' AS side FROM ({OUT} EXCEPT {IN}) UNION ALL SELECT *, 'right' FROM ({IN} EXCEPT {OUT})",
)

# ---- one chain as long as the table of events

SUCCESSION = """WITH places AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS state, event_type, value FROM events),
tops AS (SELECT state FROM places WHERE value = (SELECT max(value) FROM events))"""


def along_events(name: str, query: f.Formula, body: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: Checker(tables.succession(spark, sf_dir)).verify(query)
    ORACLES[name] = f"{SUCCESSION} {body}"


TOP = f.where("top")
along_events("ef_succession", f.EF(TOP), "SELECT state, CAST(0 AS INTEGER) AS colour FROM places WHERE state <= (SELECT max(state) FROM tops)")
along_events("af_succession", f.AF(TOP), "SELECT state, CAST(0 AS INTEGER) AS colour FROM places WHERE state <= (SELECT max(state) FROM tops)")
along_events("p_ef_succession", f.pEF(TOP), "SELECT state, CAST(0 AS INTEGER) AS colour FROM places WHERE state >= (SELECT min(state) FROM tops)")
QUERIES["terminal_components_succession"] = lambda spark, sf_dir: components.terminal_components(tables.succession(spark, sf_dir))
ORACLES["terminal_components_succession"] = f"{SUCCESSION} SELECT state AS component, state, CAST(0 AS INTEGER) AS colour FROM places WHERE state = (SELECT max(state) FROM places)"

# ---- reachability and components

CLICKS = lambda s: Checker(s).verify(kind("click"))
NOT_ERRORS = lambda s: Checker(s).verify(~kind("error"))


def reach_cte(forward: bool, guarded: bool) -> str:
    out, into = ("src", "dst") if forward else ("dst", "src")
    guard = f" WHERE NOT ({is_kind('error', f'x.{into}')})" if guarded else ""
    return f"r AS (SELECT state, colour FROM space WHERE {is_kind('click')} UNION SELECT x.{into}, x.colour FROM r JOIN e x ON x.{out} = r.state AND x.colour = r.colour{guard})"


for forward in (True, False):
    word = "forward" if forward else "backward"
    does(
        f"reach_{word}",
        "journey",
        lambda s, forward=forward: temporal.reach(CLICKS(s), s.edges, forward),
        R,
        ctes=reach_cte(forward, False),
    )
    does(
        f"reach_{word}_guarded",
        "journey",
        lambda s, forward=forward: temporal.reach(CLICKS(s), s.edges, forward, NOT_ERRORS(s)),
        R,
        ctes=reach_cte(forward, True),
    )
does("subtract", "journey", lambda s: relations.difference(temporal.sources(s.edges), temporal.targets(s.edges)), f"{OUT} EXCEPT {IN}")
does(
    "invert",
    "journey",
    lambda s: relations.complement(temporal.sources(s.edges), s.space(), s.states),
    f"SELECT state, colour FROM space EXCEPT {OUT}",
)
does(
    "restrict",
    "journey",
    lambda s: relations.restricted(temporal.sources(s.edges), s.colours.where("colour < 2")),
    f"SELECT state, colour FROM ({OUT}) WHERE colour < 2",
)
does("all_colours", "journey", lambda s: relations.all_colours(temporal.sources(s.edges)), "SELECT DISTINCT colour FROM e")
does("pivots", "journey", lambda s: relations.pivots(temporal.sources(s.edges)), "SELECT min(src) AS state, colour FROM e GROUP BY colour")
does(
    "sinks",
    "hierarchy",
    components.sinks,
    holds("NOT EXISTS (SELECT 1 FROM e x WHERE x.src = state AND x.colour = space.colour AND x.dst <> x.src)"),
)
does("deadlocks", "journey", lambda s: s.deadlocks(), f"SELECT state, colour FROM space EXCEPT {OUT}")
does(
    "totalise",
    "journey",
    lambda s: s.edges.select("src", "dst", F.col("dir_facet").alias("facet"), "colour"),
    "SELECT src, dst, facet, colour FROM e",
    total=True,
)
TERMINAL = """full_tc AS (SELECT src, dst, colour FROM tc UNION SELECT state, state, colour FROM space),
open_ended AS (SELECT DISTINCT a.src, a.colour FROM tc a WHERE NOT EXISTS (SELECT 1 FROM full_tc b WHERE b.src = a.dst AND b.dst = a.src AND b.colour = a.colour))"""
FOUND = """SELECT (SELECT min(dst) FROM full_tc t WHERE t.src = space.state AND t.colour = space.colour) AS component, state, colour FROM space
WHERE NOT EXISTS (SELECT 1 FROM open_ended o WHERE o.src = state AND o.colour = space.colour)"""
does("terminal_components", "journey", components.terminal_components, FOUND, ctes=f"{REACH}, {TERMINAL}")
does("terminal_components_deadlocks", "hierarchy", components.terminal_components, FOUND, ctes=f"{REACH}, {TERMINAL}")

# ---- parts of the state space; the results of all queries are the same however rows lie, which Spark decides

N = "(SELECT max(state) + 1 FROM states)"
PARTS = {
    "single": (lambda state, n: partitioning.single(state), "0"),
    "hash": (lambda state, n: partitioning.hashed(state, 4), "state % 4"),
    "uniform": (lambda state, n: partitioning.uniform(state, 4, n), f"state // (({N} + 3) // 4)"),
    "interval": (lambda state, n: partitioning.intervals(state, [(0, n // 3), (n // 3 + 1, n // 2)]), f"CASE WHEN state <= {N} // 3 THEN 0 WHEN state <= {N} // 2 THEN 1 ELSE -1 END"),
    "block": (lambda state, n: partitioning.blocks(state, 4, n, 16), f"state // ({N} // 16) % 4"),
}


def _parted(how) -> Callable[[TransitionSystem], DataFrame]:
    def run(system: TransitionSystem) -> DataFrame:
        count = system.states.agg(F.max("state")).first()[0] + 1
        return system.states.select("state", how(F.col("state"), count).alias("part"))

    return run


for name, (how, rule) in PARTS.items():
    does(f"partition_{name}", "journey", _parted(how), f"SELECT state, CAST({rule} AS INTEGER) AS part FROM states")
LISTED = lambda s: partitioning.listed(s, s.states.where("state % 2 = 0").select("state", F.lit(3).alias("part")))
does("partition_listed", "journey", LISTED, "SELECT state, CAST(CASE WHEN state % 2 = 0 THEN 3 ELSE 0 END AS INTEGER) AS part FROM states")

# ---- relations made by hand, and their comparison

FIVE_COLOURS = "range(5) c(colour)"
does(
    "states_as_relation",
    "hierarchy",
    lambda s: relations.of_states(s.states.where("level = 'nation'"), s.colours),
    holds(is_level("nation")),
)
NATION, CUSTOMER = f"n_nationkey + {tables.NATIONS_AT}", f"c_custkey + {tables.CUSTOMERS_AT}"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states from the first nation to the last, in all colours."""
    system = tables.hierarchy(spark, sf_dir)
    first, last = system.states.where("level = 'nation'").agg(F.min("state"), F.max("state")).first()
    return relations.of_range(spark, first, last, system.colours)


def _busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer with the most orders, in all colours."""
    system = tables.hierarchy(spark, sf_dir)
    orders = system.edges.where(f"src >= {tables.ORDERS_AT}").groupBy("dst").agg(F.count_distinct("src").alias("n"))
    return relations.of_state(spark, orders.orderBy(F.desc("n"), "dst").first().dst, system.colours)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions in the colours of their nations, as a map; there are 25 nations at any scale."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.collect_list(F.col("n_nationkey") % 5).alias("colours")).collect()
    return relations.of_map(spark, {r.n_regionkey: r.colours for r in rows})


QUERIES |= {"range_as_relation": _nations, "state_as_relation": _busiest, "map_as_relation": _listed}
ORACLES |= {
    "range_as_relation": f"SELECT CAST(s AS BIGINT) AS state, CAST(colour AS INTEGER) AS colour FROM range((SELECT min({NATION}) FROM nation), (SELECT max({NATION}) + 1 FROM nation)) t(s), {FIVE_COLOURS}",
    "state_as_relation": f"""SELECT CAST(o_custkey + {tables.CUSTOMERS_AT} AS BIGINT) AS state, CAST(colour AS INTEGER) AS colour
FROM (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(DISTINCT o_orderkey) DESC, o_custkey LIMIT 1), {FIVE_COLOURS}""",
    "map_as_relation": "SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS state, CAST(n_nationkey % 5 AS INTEGER) AS colour FROM nation",
}


def _compared(system: TransitionSystem) -> DataFrame:
    """Whether an assertion of equality passes: of a relation with itself in another order, and with another one."""
    out, into = temporal.sources(system.edges), temporal.targets(system.edges)
    rows = []
    for name, a, b in (("same", out, out.unionByName(out).orderBy("colour")), ("other", out, into)):
        try:
            relations.assert_equal(a, b, name)
            rows.append((name, True))
        except AssertionError:
            rows.append((name, False))
    return system.states.sparkSession.createDataFrame(rows, "pair string, passes boolean")


does(
    "assert_equal",
    "journey",
    _compared,
    f"SELECT 'same' AS pair, true AS passes UNION ALL SELECT 'other', NOT EXISTS (({OUT} EXCEPT {IN}) UNION ALL ({IN} EXCEPT {OUT}))",
)

# ---- text: formulas, and whole descriptions

ASKED = "EX{value+} (2 * user_id + 1 > 40) && !(value:in-) || pEX (user_id / 3 < 2 && value:out+)"
QUERIES["formula_text"] = lambda spark, sf_dir: Checker(tables.journey(spark, sf_dir)).verify(formula_text.parse(ASKED, f.where, formula_text.step))
ORACLES["formula_text"] = sql(
    "journey",
    holds(f"""{next_sql(False, "2 * (x.dst // 5) + 1 > 40", "x.facet = '+'")} AND NOT EXISTS (SELECT 1 FROM e x WHERE x.dst = state AND x.colour = space.colour AND facet = '-')
OR EXISTS (SELECT 1 FROM e x WHERE x.dst = state AND x.colour = space.colour AND (x.src // 5) / 3.0 < 2 AND EXISTS (SELECT 1 FROM e y WHERE y.src = x.src AND y.colour = x.colour AND y.facet = '+'))"""),
)


def described(spark: SparkSession, sf_dir: str) -> text.Description:
    """Nations and regions as a text: a nation leads to its region in the colour of its number's remainder by two."""
    nations, regions = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("nation", "region"))
    nation, region = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")
    edge = F.concat(F.lit(":edges "), nation, F.lit(" -("), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd"), F.lit(')> "up +" '), region)
    n, r = F.col("n_nationkey").cast("long").alias("at"), F.col("r_regionkey").cast("long").alias("at")
    lines = [
        nations.select(n, F.concat(F.lit(":states "), nation).alias("line")),
        regions.select(r, F.concat(F.lit(":states(1) r"), "r_regionkey").alias("line")),
        nations.select(n, edge.alias("line")),
        regions.select(r, F.concat(F.lit(":edges r"), "r_regionkey", F.lit(" -> r"), "r_regionkey").alias("line")),
        regions.agg(F.lit(0).cast("long").alias("at"), F.concat(F.lit(':atom "level == 1" = ['), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("r"), "r_regionkey"))), ", "), F.lit("]")).alias("line")),
        spark.createDataFrame(list(enumerate((":params even, odd", ':verify "EF level==1" /* every state', "that */", *ASSERTS))), "at long, line string"),
    ]
    rows = reduce(DataFrame.unionByName, (df.withColumn("part", F.lit(i)) for i, df in enumerate(lines)))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "line"))), lambda x: x.line)
    return text.described(rows.agg(F.array_join(in_order, "\n").alias("value")))


ASSERTS = (
    ':assert "level == 1 && EX level==1" == [r0, r1, r2, r3, r4]',
    ':assert "exists s in level == 1: EX s && !level == 1" == []  # wrong: nations are there',
    ':assert "false" == []',
    ':assert "AG level == 1" == [r0, r1, r2, r3, r4]; :assert "pEX{up-} !level == 1" == []',
)
NAMED = "(SELECT 'n' || n_nationkey AS state, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS colour FROM nation UNION ALL SELECT 'r' || r_regionkey, c FROM region, (VALUES ('even'), ('odd')) t(c))"
QUERIES["text_model"] = lambda spark, sf_dir: described(spark, sf_dir).verify()["EF level==1"]
ORACLES["text_model"] = f"SELECT * FROM {NAMED}"
QUERIES["text_states"] = lambda spark, sf_dir: (d := described(spark, sf_dir)).state_names.join(d.parts, "state").select("name", "part")
ORACLES["text_states"] = "SELECT 'n' || n_nationkey AS name, CAST(0 AS INTEGER) AS part FROM nation UNION ALL SELECT 'r' || r_regionkey, 1 FROM region"
QUERIES["text_assert"] = lambda spark, sf_dir: described(spark, sf_dir).outcomes()
ORACLES["text_assert"] = """SELECT * FROM (VALUES ('level == 1 && EX level==1', (SELECT count(*) = 5 FROM region)), ('exists s in level == 1: EX s && !level == 1', (SELECT count(*) = 0 FROM nation)),
('false', true), ('AG level == 1', (SELECT count(*) = 5 FROM region)), ('pEX{up-} !level == 1', (SELECT count(*) = 0 FROM nation))) t(formula, holds)"""


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated system: where the upper corner is reached, of a cube with a cell for every supplier."""
    suppliers, size = spark.read.parquet(f"{sf_dir}/supplier.parquet").count(), 1
    while size**3 < suppliers:
        size += 1
    cube = Cube(3, size)
    return Checker(cube.system(spark)).verify(f.AF(f.where(cube.upper_corner)))


QUERIES["cube_af_upper"] = _cube
ORACLES["cube_af_upper"] = """WITH n AS (SELECT min(k) AS n FROM range(1, 10000) t(k) WHERE k * k * k >= (SELECT count(*) FROM supplier)),
s AS (SELECT CAST(i AS BIGINT) AS state, [i % n, i // n % n, i // (n * n)] AS x, n FROM n, range((SELECT n * n * n FROM n)) t(i)),
c AS (SELECT CAST(k AS INTEGER) AS colour FROM range((SELECT (n - 1) * 3 + 2 FROM n)) t(k))
SELECT state, colour FROM s, c WHERE state = n * n * n - 1 OR colour = 0 OR (colour <= (n - 1) * 3 AND (colour - 1) % greatest(n - 1, 1) + 1 <= x[(colour - 1) // greatest(n - 1, 1) + 1])"""

# ---- sets of colours in fixpoints: the same answers


def _set_asks(name: str, system: str, query: f.Formula, same_as: str, total: bool = False) -> None:
    build = system_of(system, total)
    QUERIES[name] = lambda spark, sf_dir: SetChecker(build(spark, sf_dir)).verify(query)
    ORACLES[name] = ORACLES[same_as]


_set_asks("ef_sets", "journey", f.EF(kind("purchase")), "ef")
_set_asks("au_sets", "journey", f.AU(kind("view") | kind("click"), kind("purchase")), "au", total=True)
_set_asks("ax_sets", "hierarchy", f.AX(level("nation") | level("region")), "ax")


def _set_reach(system: TransitionSystem) -> DataFrame:
    how = encoding_of(system)
    coded = lambda rel: encoded(rel, how)
    return decoded(sets.reach(coded(CLICKS(system)), sets.edges_of(system.edges, how), how, guard=coded(NOT_ERRORS(system))), how)


QUERIES["reach_sets"] = lambda spark, sf_dir: _set_reach(system_of("journey")(spark, sf_dir))
ORACLES["reach_sets"] = ORACLES["reach_forward_guarded"]

# ---- negations and quantifiers that build no pairs

HAND = "EXISTS (SELECT 1 FROM e x WHERE x.src = space.state AND x.colour = space.colour AND x.dst = {})"
asks(
    "not_pairs",
    "handoff",
    f.exists("x", f.exists("y", ~(f.EX(f.var("x")) & f.EX(f.var("y"))), bound=small(5)), bound=small(7)),
    holds(f"EXISTS (SELECT 1 FROM states a, states b WHERE a.state % 7 = 0 AND b.state % 5 = 0 AND NOT ({HAND.format('a.state')} AND {HAND.format('b.state')}))"),
)
asks(
    "forall_counted",
    "handoff",
    f.forall("x", f.EX(f.EX(f.var("x"))), bound=f.EX(small(97))),
    f"""SELECT state, colour FROM space WHERE (SELECT count(*) FROM b WHERE b.colour = space.colour) =
(SELECT count(*) FROM two JOIN b ON b.state = two.dst AND b.colour = two.colour WHERE two.src = space.state AND two.colour = space.colour)""",
    ctes="""b AS (SELECT DISTINCT src AS state, colour FROM e WHERE dst % 97 = 0),
two AS (SELECT DISTINCT x.src, y.dst, x.colour FROM e x JOIN e y ON y.src = x.dst AND y.colour = x.colour)""",
)
asks(
    "at_some",
    "handoff",
    f.exists("x", f.at("x", f.EX(small(7)) & ~f.EX(small(11))) & f.EX(f.var("x"))) & ~f.at(5, f.EX(small(7)) & small(11)),
    holds("""EXISTS (SELECT 1 FROM e x WHERE x.src = space.state AND x.colour = space.colour
  AND EXISTS (SELECT 1 FROM e y WHERE y.src = x.dst AND y.colour = x.colour AND y.dst % 7 = 0)
  AND NOT EXISTS (SELECT 1 FROM e y WHERE y.src = x.dst AND y.colour = x.colour AND y.dst % 11 = 0))"""),
)

# ---- systems without a table of edges: the stock of parts

STOCKED = f"""SELECT p_partkey AS key, p_size * 2 AS room, CAST(least AS INTEGER) AS ord, CAST(c AS INTEGER) AS colour
FROM part JOIN (SELECT l_partkey, min(l_quantity) AS least FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey, range({tables.DAYS}) t(c)"""
SMALL = "p_size <= 6"
ITEMS = f"state % {tables.LEVELS}"


def _empty(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """No items in stock, of all parts (or those that ``which`` holds for) in all colours."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").where(which)
    return parts.select((F.col("p_partkey") * tables.LEVELS).alias("state"), F.explode(F.sequence(F.lit(0), F.lit(tables.DAYS - 1))).alias("colour"))


def _stock_sql(parts: str, moved: str, possible: str) -> str:
    return f"""WITH RECURSIVE f AS ({parts}),
r AS (SELECT key * {tables.LEVELS} AS state, colour FROM f
  UNION SELECT {moved} AS state, r.colour FROM r JOIN f ON f.key = state // {tables.LEVELS} AND f.colour = r.colour, (VALUES (0), (1)) m(m) WHERE {possible})
SELECT state, colour FROM r"""


QUERIES["implicit_reach"] = lambda spark, sf_dir: (s := tables.stock(spark, sf_dir)).reach(s.existing(_empty(spark, sf_dir)))
ORACLES["implicit_reach"] = _stock_sql(STOCKED, "CASE m WHEN 0 THEN state + r.colour + 1 ELSE state - ord END", f"CASE m WHEN 0 THEN {ITEMS} + r.colour + 1 <= room ELSE {ITEMS} >= ord END")
QUERIES["implicit_ef"] = lambda spark, sf_dir: (s := tables.stock(spark, sf_dir)).exists_until(None, s.existing(_empty(spark, sf_dir, SMALL)))
ORACLES["implicit_ef"] = _stock_sql(f"{STOCKED} WHERE {SMALL}", "CASE m WHEN 0 THEN state - r.colour - 1 ELSE state + ord END", f"CASE m WHEN 0 THEN {ITEMS} >= r.colour + 1 ELSE {ITEMS} + ord <= room END")

# ---- sets of a real parameter


def _spread(sets_of: DataFrame) -> DataFrame:
    """``(state, low, high)``: a row for an interval."""
    return sets_of.select("state", F.explode(sets.SET).alias("x")).select("state", "x.low", "x.high")


def _supply_ef(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From where, and for which parameters, a part of size 50 is reached."""
    states, edges = tables.supply(spark, sf_dir)
    goal = sets.full(states.where("size = 50"), tables.BOUND)
    return _spread(sets.exists_until(None, goal, edges, tables.BOUND))


def _supply_ag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From where, and for which parameters, only suppliers that owe nothing are ever met."""
    states, edges = tables.supply(spark, sf_dir)
    owing = sets.exists_until(None, sets.full(states.where("balance < 0"), tables.BOUND), edges, tables.BOUND)
    return _spread(sets.less(sets.full(states, tables.BOUND), owing, tables.BOUND))


def _supply_sql(goal: str, holds_where: str) -> str:
    """All ends are whole numbers, so that each stretch from one to the next is of one kind; stretches that touch are one interval."""
    return f"""WITH RECURSIVE lines AS (
  SELECT l_partkey AS part, l_suppkey + {tables.SUPPLIERS_AT} AS supplier, min(l_quantity) AS q0, max(l_quantity) AS q1, 8 * min(l_linenumber) AS n0, 8 * max(l_linenumber) AS n1 FROM lineitem GROUP BY ALL),
k AS (SELECT k FROM range(64) t(k)),
e AS (SELECT part AS src, supplier AS dst, k FROM lines, k WHERE k >= q0 AND k < q1 UNION ALL SELECT supplier, part, k FROM lines, k WHERE k >= n0 AND k < n1),
states AS (SELECT p_partkey AS state FROM part UNION ALL SELECT s_suppkey + {tables.SUPPLIERS_AT} FROM supplier),
r AS (SELECT state, k FROM ({goal}), k UNION SELECT e.src, e.k FROM r JOIN e ON e.dst = r.state AND e.k = r.k),
held AS (SELECT state, k FROM states, k WHERE {holds_where} (SELECT 1 FROM r WHERE r.state = states.state AND r.k = k.k)),
runs AS (SELECT state, k, k - row_number() OVER (PARTITION BY state ORDER BY k) AS run FROM held)
SELECT state, CAST(min(k) AS DOUBLE) AS low, CAST(max(k) + 1 AS DOUBLE) AS high FROM runs GROUP BY state, run"""


QUERIES |= {"interval_ef": _supply_ef, "interval_ag": _supply_ag}
ORACLES |= {
    "interval_ef": _supply_sql("SELECT p_partkey AS state FROM part WHERE p_size = 50", "EXISTS"),
    "interval_ag": _supply_sql(f"SELECT s_suppkey + {tables.SUPPLIERS_AT} AS state FROM supplier WHERE s_acctbal < 0", "NOT EXISTS"),
}
