"""Transition systems over the supplied star schema and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintwalk.functions.intervals import Intervals
from tintwalk.sources.implicit import ImplicitSystem, Move
from tintwalk.system import ANY, NEGATIVE, POSITIVE, TransitionSystem
from tintwalk.written import cut, ranked

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
DAYS = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(value: Column, values: tuple[str, ...]) -> Column:
    return (F.array_position(F.array(*[F.lit(v) for v in values]), value) - 1).cast("int")


def _colours(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("colour"))


def _facet(change: Column) -> Column:
    return F.when(change > 0, POSITIVE).when(change < 0, NEGATIVE).otherwise(ANY)


def journey(spark: SparkSession, sf_dir: str) -> TransitionSystem:
    """A user's kinds of event: state user * 5 + kind; edges join consecutive events of a user, in the direction in which the value goes.

    Colours are the days of the earlier event, modulo 5. An event type is an attribute, ``event_type``.
    """
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    state = (F.col("user_id") * len(EVENT_TYPES) + _place(F.col("event_type"), EVENT_TYPES)).cast("long")
    after = Window.partitionBy("user_id").orderBy("ts", "event_id")
    here = events.select("*", state.alias("src"), F.lead(state).over(after).alias("dst"), (F.lead("value").over(after) - F.col("value")).alias("change"))
    edges = here.where("dst is not null").select(
        "user_id", "src", "dst", F.when(F.coalesce(F.col("change"), F.lit(0.0)) != 0, "value").alias("dir_name"), _facet(F.coalesce(F.col("change"), F.lit(0.0))).alias("dir_facet"), (F.dayofmonth("ts") % DAYS).cast("int").alias("colour"),
    ).distinct().drop("user_id")  # where the users lie already
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(v).alias("event_type")) for i, v in enumerate(EVENT_TYPES)]))
    states = events.select("user_id").distinct().select("user_id", kinds.alias("k"))
    states = states.select((F.col("user_id") * len(EVENT_TYPES) + F.col("k.kind")).cast("long").alias("state"), "user_id", "k.event_type")
    return TransitionSystem(states, _colours(spark, DAYS), edges)


def handoff(spark: SparkSession, sf_dir: str) -> TransitionSystem:
    """Users, one handing on to the user of the next event of the whole log; colours are the kinds of event.

    The log is ordered as a whole: within a day by a window, and from each day's last event to the first event of the next day that has one.
    """
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", _place(F.col("event_type"), EVENT_TYPES).alias("colour"), F.to_date("ts").alias("day"))
    within = Window.partitionBy("day").orderBy("ts", "event_id")
    here = events.withColumn("next", F.lead("user_id").over(within))
    at = F.struct("ts", "event_id")
    ends = events.groupBy("day").agg(F.min_by("user_id", at).alias("opens"))  # a row for each day
    ends = ends.select("day", F.lead("opens").over(Window.orderBy("day")).alias("opens"))
    edges = here.join(ends, "day").select(F.col("user_id").alias("src"), F.coalesce("next", "opens").alias("dst"), F.lit(None).cast("string").alias("dir_name"), F.lit(ANY).alias("dir_facet"), "colour")
    states = events.select(F.col("user_id").alias("state")).distinct()
    return TransitionSystem(states, _colours(spark, len(EVENT_TYPES)), edges.where("dst is not null").distinct())


def succession(spark: SparkSession, sf_dir: str) -> TransitionSystem:
    """All events in the order of time, each leading to the next one: one chain as long as the table. One colour; ``top`` marks the events of the greatest value.

    States are the gapless places of a range-partitioned sort, so no task sees the whole table.
    """
    events = _table(spark, sf_dir, "events").select("ts", "event_id", "event_type", "value")
    most = events.agg(F.max("value").alias("most"))  # one row
    states = ranked(events, F.col("ts"), F.col("event_id"), name="succession").withColumnRenamed("rank", "state")
    states = states.crossJoin(most).select("state", "event_type", "value", F.coalesce(F.col("value") == F.col("most"), F.lit(False)).alias("top"))
    colour = F.lit(0).alias("colour")
    edges = states.where("state > 0").select((F.col("state") - 1).alias("src"), F.col("state").alias("dst"), F.lit(None).cast("string").alias("dir_name"), F.lit(ANY).alias("dir_facet"), colour)
    return TransitionSystem(states, spark.range(1).select(F.col("id").cast("int").alias("colour")), edges)


#: Regions and nations come first in the state numbers of ``hierarchy``, then as many customers as there may be, then orders.
NATIONS_AT, CUSTOMERS_AT, ORDERS_AT = 1_000, 1_000_000, 1_000_000_000_000
PRIORITIES = 5


def hierarchy(spark: SparkSession, sf_dir: str) -> TransitionSystem:
    """Orders to customers to nations to regions, along their keys; colours are the order priorities by the digit they begin with.

    An order has its edge in its own priority's colour, all others in every colour; regions are deadlocks. ``level`` is an attribute.
    """
    orders, customers, nations, regions = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    order, customer, nation = F.col("o_orderkey") + ORDERS_AT, F.col("c_custkey") + CUSTOMERS_AT, F.col("n_nationkey").cast("long") + NATIONS_AT
    all_colours = F.explode(F.array(*[F.lit(i) for i in range(PRIORITIES)])).alias("colour")
    edges = [
        orders.select(order.alias("src"), (F.col("o_custkey") + CUSTOMERS_AT).alias("dst"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("colour")),
        customers.select(customer.alias("src"), (F.col("c_nationkey").cast("long") + NATIONS_AT).alias("dst"), all_colours),
        nations.select(nation.alias("src"), F.col("n_regionkey").cast("long").alias("dst"), all_colours),
    ]
    states = [(orders, order, "order"), (customers, customer, "customer"), (nations, nation, "nation"), (regions, F.col("r_regionkey").cast("long"), "region")]
    states = [df.select(key.alias("state"), F.lit(level).alias("level")).distinct() for df, key, level in states]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    edges = union(edges).select("src", "dst", F.lit(None).cast("string").alias("dir_name"), F.lit(ANY).alias("dir_facet"), "colour").distinct()
    return TransitionSystem(union(states), _colours(spark, PRIORITIES), edges)


#: Numbers of items in stock that a part's states leave room for.
LEVELS = 1 << 10


def stock(spark: SparkSession, sf_dir: str) -> ImplicitSystem:
    """The stock of each part, as moves without a table: state part * LEVELS + items in stock, 0 to twice the part's size.

    In the colour c, c + 1 items come in at a time. The part's smallest ordered quantity goes out at a time; parts that nobody has ordered have no states.
    """
    size = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") * 2).alias("room"))
    order = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.min("l_quantity").cast("int").alias("order"))
    state, items = F.col("state"), F.pmod(F.col("state"), F.lit(LEVELS))

    def moves(n: int) -> list[Move]:
        """Each ``n`` times in a row: what is between has fewer items than the most and more than the least of both ends, so it exists."""
        comes, goes = (F.col("colour") + 1) * n, F.col("order") * n
        return [
            Move(state + comes, F.array(state - comes), items + comes <= F.col("room"), "items", POSITIVE),
            Move(state - goes, F.array(state + goes), items >= goes, "items", NEGATIVE),
        ]

    facts = cut(size.join(order, "key"), "facts")  # each round reads them, and must not group all lines anew
    return ImplicitSystem(moves(1), items <= F.col("room"), facts, F.floor(state / LEVELS).cast("long"), [*moves(4), *moves(16)])


#: Suppliers come after as many parts as there may be in the state numbers of ``supply``; its parameter goes from 0 to below 64.
SUPPLIERS_AT, BOUND = 1_000_000_000_000, Intervals(0, 64)


def supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``states(state, level, size, balance)`` and ``edges(src, dst, colours, going)`` of parts and suppliers, for a real parameter from 0 to below 64.

    A part leads to a supplier for parameters from the smallest to the largest quantity ordered of it there, a supplier to a part for those from 8 times the smallest line
    number of such orders to 8 times the largest.
    """
    part, supplier = F.col("l_partkey"), F.col("l_suppkey") + SUPPLIERS_AT
    lines = _table(spark, sf_dir, "lineitem").groupBy(part.alias("part"), supplier.alias("supplier"))
    lines = lines.agg(*[f(c).alias(f"{name}_{c}") for c in ("l_quantity", "l_linenumber") for name, f in (("least", F.min), ("most", F.max))])
    out = lines.select(F.col("part").alias("src"), F.col("supplier").alias("dst"), BOUND.between(F.col("least_l_quantity"), F.col("most_l_quantity")).alias("colours"))
    back = lines.select(F.col("supplier").alias("src"), F.col("part").alias("dst"), BOUND.between(8 * F.col("least_l_linenumber"), 8 * F.col("most_l_linenumber")).alias("colours"))
    edges = out.unionByName(back).where(BOUND.is_some(F.col("colours"))).withColumn("going", F.col("colours"))
    none = F.lit(None).cast("double")
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("state"), F.lit("part").alias("level"), F.col("p_size").alias("size"), none.alias("balance"))
    suppliers = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIERS_AT).alias("state"), F.lit("supplier").alias("level"), F.lit(None).cast("int").alias("size"), F.col("s_acctbal").alias("balance"))
    return parts.unionByName(suppliers), edges
