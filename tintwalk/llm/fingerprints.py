"""Document fingerprints from closed syncmers over words.

A k-mer of ``K`` consecutive words is an anchor if, of the hashes of its inner runs of ``S`` words, the smallest stands at its first
or last place. That depends on the k-mer alone, so an edit changes only the anchors that it touches, and of any ``K - S + 1``
consecutive k-mers one is an anchor. Scripts written without spaces give one word per character.

Likeness is positional: an anchor matches together with the anchor that follows it and with the number of words between them, wherever
in the other text the two stand. Words that were moved or spread apart don't match, shifted passages do.

Defined cases: null texts are empty; an empty text has no anchors and the fingerprint ""; a text of too few words for an anchor has
one anchor, the hash of all its words, at place 0; equal texts have equal fingerprints. Only built-in functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwalk.llm.common import SPACE, cut, let, ranked, table

K, S = 5, 2
#: Scripts that are written without spaces; each of their characters counts as a word: Thai and Lao, Tibetan, Myanmar, Khmer, kana, Han.
UNSPACED = "([\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f])"


def word_hashes(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, UNSPACED, " $1 ")).otherwise(text)
    return F.transform(F.filter(F.split(spaced, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def _inner(h: Column) -> Column:
    """Hashes of the runs of two words; those of a k-mer at i are at i to i + K - S."""
    return F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1), lambda a, b: F.xxhash64(a, b))


def _selected(g: Column, made) -> Column:
    """An array with made(i, hash) for each anchor at word i, from the inner hashes ``g``."""

    def at(i: Column) -> Column:
        a, b, c, d = (F.get(g, i + j) for j in range(K - S + 1))
        return F.when(F.least(a, d) <= F.least(b, c), made(i, F.xxhash64(a, b, c, d)))

    places = F.when(F.size(g) > K - S, F.sequence(F.lit(0), F.size(g) - (K - S) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(places, at), lambda x: x.isNotNull())


def _of_words(h: Column, made) -> Column:
    whole = F.array(made(F.lit(0), F.aggregate(h, F.lit(42).cast("long"), lambda s, x: F.xxhash64(s, x))))
    found = let(_inner(h), lambda g: _selected(g, made))
    chosen = let(found, lambda a: F.when(F.size(a) > 0, a).otherwise(whole))
    return F.when(F.size(h) == 0, F.slice(whole, F.lit(1), F.lit(0))).when(F.size(h) < K, whole).otherwise(chosen)


def anchors(text: Column) -> Column:
    """array<struct<place int, hash long>>: the anchors of ``text`` by word place, for positional matching over a corpus."""
    made = lambda i, x: F.struct(i.cast("int").alias("place"), x.alias("hash"))
    return let(word_hashes(text), lambda h: _of_words(h, made))


def packed(text: Column) -> Column:
    """array<long>: the anchors of ``text`` by word place, with the place in the upper half of a long and the upper half of the hash in the lower."""
    made = lambda i, x: F.shiftleft(i.cast("long"), 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return let(word_hashes(text), lambda h: _of_words(h, made))


def positions(values: Column) -> Column:
    """Distinct hashes (64 bits) of each packed anchor with the one that follows it and the words between them; of a single anchor, its own hash."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    n = F.size(values)
    pairs = F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), lambda a, b: F.xxhash64(low(a), low(b), F.shiftright(b, 32) - F.shiftright(a, 32)))
    return F.when(n > 1, F.array_distinct(pairs)).otherwise(F.transform(values, lambda x: F.xxhash64(low(x))))


def as_string(values: Column) -> Column:
    """Sixteen hex digits per packed anchor: its place, then its hash."""
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes, 0 to 1; of two empty ones 1."""
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both)


def matches(left: DataFrame, right: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Positional matches: ``(left_id, right_id, left_place, right_place)`` for anchors that occur once in each of two documents.

    Anchors that repeat within a document are left out, as they don't fix a place. Joined on the anchor; a sort-merge join, which
    Spark splits where many documents share an anchor.
    """

    def placed(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(F.col(id_col).alias(f"{side}_id"), F.explode(anchors(F.col(text_col))).alias("a"))
        rows = rows.groupBy(f"{side}_id", F.col("a.hash").alias("hash")).agg(F.min("a.place").alias(f"{side}_place"), F.count("*").alias("n"))
        return rows.where("n = 1").drop("n")

    return placed(left, "left").join(placed(right, "right"), "hash").drop("hash")


def successors(ids: DataFrame) -> DataFrame:
    """``(id, next_id, next_rank)`` over the distinct values of ``id``, nulls first; after the last comes the first."""
    order = ranked(ids.select("id").distinct(), F.col("id").asc_nulls_first(), name="ids")
    n = order.count()
    after = order.select(F.col("id").alias("prev_id"), F.pmod(F.col("rank") + 1, F.lit(max(n, 1))).alias("rank"))
    return order.join(after, "rank").select("id", "prev_id")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents (doc_id, text) and of each with its last quarter replaced from the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors``. Rows that share a doc_id all have
    the same next document: the row of the next id whose text hash is smallest. A null doc_id counts as an id before all others.
    Fingerprints hold all anchors of a text with their places, and likeness is that of the whole sets of their positions.
    The texts are shuffled once, by id; the following document's part and positions come in a second, smaller shuffle.
    """
    docs = docs.select(F.struct("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n_chars = F.length("text")
    ids = cut(docs.groupBy("id").agg(F.max(n_chars).alias("longest")), "lengths")
    wanted = successors(ids).join(ids.select(F.col("id").alias("prev_id"), F.floor(F.col("longest") / 4).cast("int").alias("part")), "prev_id")
    wanted = cut(wanted, "follows")
    own = docs.repartition("id")  # both joins below read this one exchange
    part = F.substring(F.col("text"), F.lit(1), F.col("part")).alias("part")
    sent = F.struct(F.xxhash64("text").alias("h"), part, positions(packed(F.col("text"))).alias("next_positions")).alias("sent")
    sent = own.join(wanted.hint("merge"), "id").select(F.col("prev_id").alias("id"), sent)
    sent = sent.groupBy("id").agg(F.min("sent").alias("sent")).select("id", "sent.part", "sent.next_positions")
    quarter = F.floor(n_chars / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - quarter), F.substring(F.col("part"), F.lit(1), quarter))
    both = own.join(sent.hint("merge"), "id").withColumn("edited", edited)
    both = both.withColumn("anchors", packed(F.col("text"))).withColumn("edited_anchors", packed(F.col("edited")))
    both = both.withColumn("at", positions(F.col("anchors"))).withColumn("edited_at", positions(F.col("edited_anchors")))
    return both.select(
        "id.doc_id",
        n_chars.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("anchors")).alias("fingerprint"),
        as_string(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("at"), F.col("edited_at")).alias("near_edited"),
        likeness(F.col("at"), F.col("next_positions")).alias("near_next"),
        F.size("anchors").alias("n_anchors"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
