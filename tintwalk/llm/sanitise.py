"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers (the base), and secrets such as keys and tokens. Over the whole
corpus, documents are counted that hold an entity, a term, and both, wherever in the document they stand. Their pointwise mutual information
over the entity's information content is the disclosure: how much of the entity the term gives away, 1 if wherever the term stands the entity does.
In the documents that hold the entity, terms above ``GENERALISE`` are replaced by a general term and those above ``REMOVE`` are removed.

Disclosure needs evidence. What a term gives away in one document is told from the documents of other text only, as a reader would learn it there; and
the share of a term's documents that hold the entity is taken at the lower end of its confidence interval (Wilson's, one-sided, 95 %). So an
entity of one document is given away by no word, and one document more that has both counts for less than many do.

Equal texts are one text with so many copies. Entities that stand in the same texts are one, as nothing tells them apart; words are read where an entity has another
text only, and terms that are too frequent to reach the threshold with any entity are left out before they are paired. All of this is exact. A text of m groups of
entities has m rows for each of its rare terms.

Defined cases: null texts are empty; texts are read whole; repeated rows get equal results but count as documents; terms are words of two
letters or digits or more that begin with a letter, that meet no entity's place, whatever their case; an entity that all documents hold has nothing to
give away; other columns are ignored. Only built-in functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintwalk.llm.common import cut, cut_out, let, pieces, running_in_row, table

KINDS = ("email", "ip", "card", "phone")
#: What the method adds to the base; ranks in lists of spans follow this order.
ADDED = ("secret", "term")
GENERALISE, REMOVE = 0.8, 0.95
#: Standard deviations of the one-sided confidence bound.
SURE = 1.645
TERM = r"\p{L}[\p{L}\p{M}\p{N}]++"
#: Same matches as the base patterns, written so that a match starts at the first place of a run only and never goes back: linear in the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Keys with well-known beginnings, values that are assigned to the name of a secret, and long hexadecimal strings.
SECRET = (
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}+|sk-[A-Za-z0-9_-]{20,255}+|[0-9a-f]{32,}+(?![A-Za-z0-9])"
    r"|(?i:api[_-]?key|token|secret|password|passwd)\x20?[=:]\x20?[\"']?[^\s\"']{8,}+)"
)
#: Doubled digits of a Luhn sum.
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
REPLACED = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]"}

SPAN = "array<struct<start: int, rank: int, end: int, kind: string, value: string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  i-th from the right
    doubled = F.array(*[F.lit(x) for x in DOUBLED])
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, F.get(doubled, at(i))).otherwise(at(i)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind in ("email", "secret"):
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    low, high = (12, 19) if kind == "card" else (9, 15)
    return let(_digits(value), lambda d: F.when(F.length(d).between(low, high), _luhn(d) if kind == "card" else F.lit(True)).otherwise(False))


def _found(text: Column, pattern: str, kind: str, valid) -> Column:
    """Spans of the matches of ``pattern``: what lies between them and they themselves give the places."""

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        ends = running_in_row(F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.length(g) + F.length(x)))
        rank, start = F.lit((*KINDS, *ADDED).index(kind)).alias("rank"), lambda x, end: (end - F.length(x)).alias("start")
        made = lambda x, end: F.struct(start(x, end), rank, end.alias("end"), F.lit(kind).alias("kind"), x.alias("value"))
        span = lambda x, end: F.when(valid(x), made(x, end))
        return F.filter(F.zip_with(m, ends, span), lambda x: x.isNotNull())

    none = F.array().cast(SPAN)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m).cast(SPAN)).otherwise(none))


def entity_spans(text: Column, kinds: tuple[str, ...] = (*KINDS, "secret")) -> Column:
    """array<struct<start, rank, end, kind, value>>, sorted by start and kind, in code points, ends exclusive. A cheap test per kind spares most texts its pattern."""
    hints = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9]"),
        "phone": F.contains(text, F.lit("+")),
        "secret": text.rlike(SECRET),
    }
    patterns = dict(zip((*KINDS, "secret"), (EMAIL, IP, CARD, PHONE, SECRET), strict=True))
    none = F.array().cast(SPAN)
    found = [F.when(hints[kind], _found(text, patterns[kind], kind, lambda x, kind=kind: _valid(kind, x))).otherwise(none) for kind in kinds]
    return F.sort_array(F.flatten(F.array(*found)))


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s.kind.isin(*KINDS))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def terms(text: Column) -> Column:
    """Distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda x: F.lower(x)))


def words_outside(held: DataFrame) -> DataFrame:
    """``(name, start, end, word)`` of the terms of ``held(name, text, spans)`` that no span meets."""
    found = let(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda m: F.zip_with(m, F.slice(F.split("text", TERM, -1), F.lit(1), F.size(m)), lambda w, g: F.struct(w.alias("word"), g.alias("gap"))))
    rows = held.select("name", F.posexplode(found).alias("at", "f")).select("name", "at", F.col("f.word").alias("word"), F.length("f.gap").alias("gap"))
    so_far = F.sum(F.col("gap") + F.length("word")).over(Window.partitionBy("name").orderBy("at")).cast("int")
    rows = rows.select("name", (so_far - F.length("word")).alias("start"), so_far.alias("end"), "word")
    spans = held.select("name", F.explode("spans").alias("s")).select("name", "s.start", "s.end", F.lit(None).cast("string").alias("word"))
    # one merge of words and spans by place: a word is met by the span that ends last of those that start before it, or by the next that starts
    order = Window.partitionBy("name").orderBy("start", F.col("word").isNotNull())
    before = F.max(F.when(F.col("word").isNull(), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("word").isNull(), F.col("start"))).over(Window.partitionBy("name").orderBy(F.desc("start"), F.col("word").isNull()).rowsBetween(Window.unboundedPreceding, -1))
    merged = rows.unionByName(spans).withColumn("before", before).withColumn("after", after).where("word is not null")
    return merged.where((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))).select("name", "start", "end", "word")


def lower_bound(k: Column, n: Column, z: float = SURE) -> Column:
    """The lower end of Wilson's interval for a share of k in n."""
    p, zz = k / n, F.lit(z * z) / n
    return (p + zz / 2 - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + zz / (4 * n))) / (1 + zz)


GROUP = ["n_entity", "most_copies", "a", "b"]


def entity_groups(docs: float, held: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """``(name, copies, n_entity, most_copies, a, b, room)`` (written): the groups of entities of each text of ``held(name, spans, copies)`` that other texts hold
    too, with the documents that hold them and the documents that a term may stand in to give them away."""
    entity = F.explode(F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s.kind, F.lower(s.value))))).alias("entity")
    entities = held.select("name", "copies", entity)
    place = [F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"), F.bit_xor(F.xxhash64("name")).alias("a"), F.bit_xor(F.xxhash64("name", F.lit(1))).alias("b")]
    groups = entities.groupBy("entity").agg(*place).where((F.col("n_entity") < docs) & (F.col("texts") > 1)).drop("texts")
    room = F.lit(docs ** (1 - generalise)) * F.pow("n_entity", F.lit(generalise)) * (1 + 1e-9) + F.col("most_copies")
    return cut(entities.join(groups, "entity").select("name", "copies", *GROUP, room.alias("room")).distinct(), "entities")


def disclosing(docs: float, frequency: DataFrame, grouped: DataFrame, words: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``(name, term, removed)``: what gives away an entity of the same text. There are ``docs`` documents, ``frequency(term, n_term)`` of them with a term; entities
    are those of ``grouped``, of texts with ``words(name, word)``.

    For a text of c copies, a term in n + c documents that stands with an entity of m + c documents in k + c of them discloses log(N p / m) / log(N / m), where p
    is the lower bound of k / n and N + c are all documents. As k is m at most, n must be N ^ (1 - generalise) m ^ generalise at most, which few
    terms of a text are.
    """
    top = grouped.agg(F.max("room")).first()[0] or 0.0
    terms = words.select("name", F.lower("word").alias("term")).distinct()
    rare = terms.join(frequency.where(F.col("n_term") <= top), "term")
    pairs = cut(rare.join(grouped, "name").where(F.col("n_term") <= F.col("room")).drop("room"), "pairs")
    both = pairs.groupBy(*GROUP, "term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("texts")).where("texts > 1").drop("texts")
    rest = lambda c: F.col(c) - F.col("copies")
    others, held_by = docs - F.col("copies"), rest("n_entity")
    told = pairs.join(both, [*GROUP, "term"]).where(others > held_by)
    disclosure = F.log(others * lower_bound(rest("n_both"), rest("n_term")) / held_by) / F.log(others / held_by)
    told = told.groupBy("name", "term").agg(F.max(disclosure).alias("disclosure")).where(F.col("disclosure") >= generalise - 1e-9)
    return cut(told.select("name", "term", (F.col("disclosure") >= remove - 1e-9).alias("removed")), "disclosing")


def general(word: Column) -> Column:
    """What kind of word stood there."""
    return F.when(word.rlike(r"\p{N}"), "[CODE]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")


def term_spans(words: DataFrame, told: DataFrame) -> DataFrame:
    """``(name, term_spans)``: the places of ``words`` that are terms of ``told(name, term, removed)`` in their own texts."""
    found = words.withColumn("term", F.lower("word")).join(told, ["name", "term"])
    put = F.when(F.col("removed"), "").otherwise(general(F.col("word"))).alias("value")
    rank = F.lit((*KINDS, *ADDED).index("term")).alias("rank")
    span = F.struct("start", rank, "end", F.lit("term").alias("kind"), put)
    return found.groupBy("name").agg(F.sort_array(F.collect_list(span)).alias("term_spans"))


def annotate(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns in ``keep``, ``spans`` (entities) and ``term_spans`` for each row; rows meet their terms by a digest of the text."""
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(*[c for c in keep if c != "text"], text, F.unhex(F.md5(text)).alias("name")).withColumn("spans", entity_spans(F.col("text")))
    held = rows.where(F.size("spans") > 0).select("name", "text", "spans").groupBy("name")
    held = cut(held.agg(F.any_value("text").alias("text"), F.any_value("spans").alias("spans"), F.count(F.lit(1)).alias("copies")), "held")
    n_docs = float(max(docs.count(), 1))
    grouped = entity_groups(n_docs, held)
    words = cut(words_outside(held.join(grouped.select("name").distinct(), "name", "left_semi")), "words")
    frequency = rows.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    found = term_spans(words, disclosing(n_docs, frequency, grouped, words))
    light = rows if with_text else rows.drop("text")
    return light.join(found, "name", "left").withColumn("term_spans", F.coalesce("term_spans", F.array().cast(SPAN))).drop("name")


def redact(text: Column, spans: Column, term_spans: Column) -> Column:
    """``text`` with entities replaced by their kind and telling terms by a general one or nothing; overlapping spans go as one."""
    kinds = F.create_map(*[F.lit(x) for pair in REPLACED.items() for x in pair])

    def cleaned(found: Column) -> Column:
        ends = running_in_row(F.transform(found, lambda x: x.end), F.greatest)  # up to where the text is taken after each span
        return let(ends, lambda e: let(pieces(text), lambda p: put(found, e, p)))

    def put(found: Column, ends: Column, cut_text: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), ends)

        def part(x: Column, begin: Column) -> Column:
            new = F.when(x.kind == "term", x["value"]).otherwise(kinds[x.kind])
            return F.when(x.start < begin, "").otherwise(F.concat(cut_out(cut_text, begin, x.start - begin), new))

        last = F.get(ends, F.size(ends) - 1)
        return F.concat(F.array_join(F.zip_with(found, F.slice(begins, F.lit(1), F.size(found)), part), ""), cut_out(cut_text, last, F.length(text) - last))

    return F.when(F.size(spans) + F.size(term_spans) == 0, text).otherwise(let(F.sort_array(F.concat(spans, term_spans)), cleaned))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotate(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(listed(base_of(F.col("spans"))).cast("binary"), 256).alias("base_sha256")
    return rows.select("doc_id", *[count(kind) for kind in KINDS], digest, listed(F.sort_array(F.concat("spans", "term_spans"))).alias("spans"))
