"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The prompt is the longest common prefix of turns (same role and text) of both; it is rendered once. Each completion renders the turns
after it, with a mask of the spans on which a model is trained: the contents and end marks of the assistant's turns.

The first turn in which two sides differ is found by joining them on pair and place and taking the least place that differs, and the result is a row
per rendered turn with its place in the rendering, so that no conversation is gathered, however long. :func:`whole` gathers pairs that fit a row.

Defined cases: null roles and texts are empty; turns are ordered by number, then role and text, so repeated numbers have an order; a null
id is a conversation's id like any other; equal conversations are all prompt; a side may be a prefix of the other or empty; a pair that is on one side only is left out.
Marks inside roles and texts are escaped by a backslash (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|``), so that no turn can forge another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwalk.llm.common import cut, ranked, running_total, table

OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
TRAINED = "assistant"
PARTS = ("prompt", "chosen", "rejected")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def render(role: Column, text: Column) -> Column:
    before, after = OPEN.split("{role}")
    return F.concat(F.lit(before), escaped(role), F.lit(after), escaped(text), F.lit(CLOSE))


def placed(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(pair, place, role, text)`` of ``turns(id_col, turn, role, text)``: turns numbered from 0 in each conversation; ``pair`` is a struct of the id.

    Turns are ranked as a whole, and a conversation's places begin at its least rank, so that a long one is shared by many tasks.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = turns.select(F.struct(F.col(id_col).alias("id")).alias("pair"), "turn", role, text)
    rows = ranked(rows, F.col("pair"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), name="turns")
    first = rows.groupBy("pair").agg(F.min("rank").alias("first"))
    return rows.join(first, "pair").select("pair", (F.col("rank") - F.col("first")).alias("place"), "role", "text")


def common_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(pair, n_common)`` for pairs that have turns on both sides: how many leading turns are the same."""
    told = lambda df, side: df.select("pair", "place", F.xxhash64("role", "text").alias(f"{side}_1"), F.xxhash64("text", "role", F.lit(1)).alias(f"{side}_2"))
    both = told(chosen, "a").join(told(rejected, "b"), ["pair", "place"], "full")
    same = F.coalesce((F.col("a_1") == F.col("b_1")) & (F.col("a_2") == F.col("b_2")), F.lit(False))
    found = both.groupBy("pair").agg(F.min(F.when(~same, F.col("place"))).alias("differs"), F.max("place").alias("last"), F.count("a_1").alias("a"), F.count("b_1").alias("b"))
    return found.where("a > 0 and b > 0").select("pair", F.coalesce("differs", F.col("last") + 1).alias("n_common"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair, part, place, n_common, start, text, mask_start, mask_end`` from ``(pair, place, role, text)`` of each side; places from 0, without gaps.

    A row is a turn as rendered in its ``part`` (prompt, chosen or rejected), which is the concatenation of its rows by place. ``start`` is where it
    begins there, in code points; the mask is what is trained on, empty (both ends null) but for the assistant's turns.
    """
    chosen, rejected = cut(chosen, "chosen"), cut(rejected, "rejected")
    common = cut(common_turns(chosen, rejected), "common")

    def rendered(side: DataFrame, name: str) -> DataFrame:
        rows = side.join(common, "pair")
        part = F.when(F.col("place") < F.col("n_common"), "prompt").otherwise(name).alias("part")
        rows = rows.select("pair", part, "place", "n_common", "role", F.length(escaped(F.col("text"))).alias("own"), render(F.col("role"), F.col("text")).alias("text"))
        return rows if name == "chosen" else rows.where("part = 'rejected'")

    rows = rendered(chosen, "chosen").unionByName(rendered(rejected, "rejected"))
    rows = running_total(rows, F.length("text"), F.col("pair"), F.col("part"), F.col("place"), name="rendered")
    base = rows.groupBy("pair", "part").agg(F.min("before").alias("base"))
    rows = rows.join(base, ["pair", "part"]).withColumn("start", F.col("before") - F.col("base"))
    trained, end = F.col("role") == TRAINED, F.col("start") + F.length("text")
    mask = F.when(trained, end - F.col("own") - len(CLOSE)).alias("mask_start"), F.when(trained, end).alias("mask_end")
    return rows.select("pair", "part", "place", "n_common", "start", "text", *mask)


def whole(rows: DataFrame) -> DataFrame:
    """``pair, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask`` from the rows of :func:`format_pairs`, for pairs that fit a row."""
    turn = lambda part, *more: F.collect_list(F.when(F.col("part") == part, F.struct("place", *more)))
    texts = [F.array_join(F.transform(F.sort_array(turn(part, "text")), lambda t: t.text), "").alias(part) for part in PARTS]
    span = lambda t: F.struct(t.mask_start.alias("start"), t.mask_end.alias("end"))
    spans = lambda part: F.transform(F.filter(F.sort_array(turn(part, "mask_start", "mask_end")), lambda t: t.mask_start.isNotNull()), span)
    return rows.groupBy("pair").agg(F.max("n_common").alias("n_common"), *texts, *[spans(part).alias(f"{part}_mask") for part in PARTS[1:]])


def swapped_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of pairs made from a table of conversations ``(conv_id, turn, role, text)``, which has no preferences of its own.

    A conversation is chosen as it is; rejected is the same with one of its assistant's turns replaced by one from the next conversation (ascending
    conv_id, the first after the last) that has any. Of n such turns that of number i mod n is taken, where i numbers the conversations that have any, so
    sides may part at any turn; a conversation without such turns is equal to itself.
    """
    rows = cut(placed(turns), "conversations")
    answers = ranked(rows.where(F.col("role") == TRAINED).select("pair", "place", "text"), F.col("pair"), F.col("place"), name="answers")
    counts = answers.groupBy("pair").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    counts = cut(ranked(counts, F.col("pair"), name="order").withColumnRenamed("rank", "number"), "order")
    taken = answers.join(counts, "pair").where(F.col("rank") == F.col("first") + F.pmod("number", "n")).select("pair", "place", "text", "number")
    taken = cut(taken, "taken")
    given = taken.select(F.pmod(F.col("number") - 1, F.lit(max(counts.count(), 1))).alias("number"), F.col("text").alias("answer"))
    swap = taken.select("pair", "place", "number").join(given, "number").select("pair", "place", "answer")
    other = rows.join(swap, ["pair", "place"], "left").select("pair", "place", "role", F.coalesce("answer", "text").alias("text"))
    return rows, other


ORACLE = r"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
a AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) - 1 AS number FROM (SELECT DISTINCT conv_id FROM a)),
p AS (SELECT number, a.conv_id, place, text FROM a JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id WHERE k = number % n),
s AS (SELECT p.conv_id, p.place, q.text AS answer FROM p JOIN p q ON q.number = (p.number + 1) % (SELECT count(*) FROM c)),
b AS (SELECT t.conv_id, t.place, t.role, coalesce(answer, t.text) AS text FROM t LEFT JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.place = s.place),
m AS (SELECT t.conv_id, coalesce(min(CASE WHEN t.text <> b.text THEN t.place END), max(t.place) + 1) AS n_common
  FROM t JOIN b ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.place = b.place GROUP BY t.conv_id),
o AS (SELECT t.*, n_common, CASE WHEN place < n_common THEN 'prompt' ELSE 'chosen' END AS part FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id
  UNION ALL SELECT b.*, n_common, 'rejected' FROM b JOIN m ON b.conv_id IS NOT DISTINCT FROM m.conv_id WHERE place >= n_common),
e AS (SELECT conv_id, part, place, n_common, role, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS who, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS own FROM o),
r AS (SELECT *, '<|' || who || '|>' || chr(10) || own || '<|end|>' || chr(10) AS text FROM e),
f AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY conv_id, part ORDER BY place) AS BIGINT) AS mask_end FROM r)
SELECT conv_id, part, place, n_common, mask_end - length(text) AS start, text, CASE WHEN role = 'assistant' THEN mask_end - length(own) - 8 END AS mask_start,
  CASE WHEN role = 'assistant' THEN mask_end END AS mask_end FROM f"""


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = format_pairs(*swapped_answers(table(spark, sf_dir, "conversations")))
    return rows.select(F.col("pair.id").alias("conv_id"), "part", "place", "n_common", "start", "text", "mask_start", "mask_end")
