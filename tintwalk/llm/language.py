"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Every character n-gram of 1 to 4 code points, inside lower-cased words with edge marks, is hashed to one of ``BUCKETS`` rows of an embedding table;
a text is the average of its rows, and a linear layer with softmax gives the probability of each language. After training, table and
layer are multiplied, so that a text of any length is scored by adding one small row per n-gram.

Rejection is calibrated. One more class, of no language, is trained on noise made from the sampled texts: shuffled letters, letters exchanged
within the alphabet, letters of other scripts. Languages are then held back in turn: the level of confidence that best tells their texts from
those of the other languages is taken, unless it would reject more than ``REJECTED`` of the texts kept back of all languages.

Training takes a bounded sample: up to ``PER_LANGUAGE`` labelled rows of each of the ``LANGUAGES`` most frequent languages, the first in the
order of a hash of id and text, and up to ``ENTRIES`` n-gram counts in all.

Defined cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0 and rejected; languages are those of the sample;
texts are scored whole; an empty or unlabelled table leaves no languages: all is ``und``, and nothing is rejected.
"""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintwalk.llm.common import lists, table

#: Buckets are sent as 16-bit integers with a sign, so there are 2^15 at most.
BUCKETS, LONGEST, DIM = 1 << 15, 4, 16
PER_LANGUAGE, LANGUAGES, ENTRIES = 1000, 256, 12_000_000
EPOCHS, RATE, SEED = 4, 0.5, 5
#: Of the texts kept back, the share that the level of confidence may reject; rows of a language and groups of languages to find the level with.
REJECTED, PER_HELD_BACK, HELD_BACK = 0.002, 250, 4
#: The class of no language among the labels of the sample, and the code points of a text that its noise is made from.
OTHER, NOISE = "", 2000
#: First letters of other scripts for noise: Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul.
SCRIPTS = (0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0xE01, 0x3042, 0x4E00, 0xAC00)
#: Code points hashed at a time, which bounds memory on very long texts.
CHUNK = 1 << 20
#: What isn't a letter; and numerals such as fractions, which count as word characters to Python, to be taken out afterwards.
NOT_LETTERS = re.compile(r"[\W\d_]+")
NUMERALS = {ord(c): " " for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()}


def grams(text: str) -> np.ndarray:
    """The bucket of every n-gram of the words of ``text``."""
    words = NOT_LETTERS.sub(" ", text).lower()
    if not words.isascii() and any(ord(c) in NUMERALS for c in set(words)):
        words = " ".join(words.translate(NUMERALS).split())
    if not words.strip():
        return np.zeros(0, dtype=np.int64)
    codes = np.frombuffer(f" {words.strip()} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    edge = codes == 32
    found, held = [], np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        held = held[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        keep = ~edge[: len(held)]
        if n > 1:
            keep = np.ones(len(held), dtype=bool)
            for k in range(1, n - 1):  # the mark of an edge stands at the ends only
                keep &= ~edge[k : k + len(held)]
        h = held[keep]
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((h >> np.uint64(32)) % np.uint64(BUCKETS))
    return np.concatenate(found).astype(np.int64)


def noise(text: str) -> str:
    """The beginning of a text as no language has it; which way is drawn from the text itself."""
    text = text[:NOISE].lower()
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    letters = [c for c in text if c.isalpha()]
    way = rng.randrange(3)
    if way == 0:
        rng.shuffle(letters)
        drawn = iter(letters)
        return "".join(next(drawn) if c.isalpha() else c for c in text)
    own = sorted(set(letters))
    first = rng.choice(SCRIPTS)
    others = own[:] if way == 1 else [chr(first + i % 24) for i in range(len(own))]
    rng.shuffle(others)
    return text.translate(dict(zip(map(ord, own), others, strict=True)))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x (languages and OTHER): embedding table times layer
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0  # confidence below this is rejected

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.bias)), 0
        for at in range(0, len(text), CHUNK):
            g = grams(text[at : at + CHUNK])
            counts = np.bincount(g, minlength=0)
            total += counts @ self.scores[: len(counts)]
            n += len(g)
        return total / n + self.bias if n and len(self.languages) else None

    def sure(self, z: np.ndarray) -> np.ndarray:
        """Of rows of logits, the probability of the likeliest language."""
        return softmax(z / self.temperature)[:, : len(self.languages)].max(axis=1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        z = self.logits(text or "")
        if z is None:
            return "und", 0.0, not self.languages
        sure = float(self.sure(z[None])[0])
        return self.languages[int(z[: len(self.languages)].argmax())], sure, sure >= self.least


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Row = tuple[str, np.ndarray, np.ndarray]


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, entries: int = ENTRIES) -> list[Row]:
    """Up to ``per_language`` rows of each language of ``docs(doc_id, text, lang)``: language, buckets and how often each occurs; and rows of noise.

    The first rows of each language in the order of a draw are kept by each partition, then among these; a chance twice as high as needed
    spares the others. Buckets are counted on the executors; a language's rows end where their counts exceed its part of ``entries``.
    """
    docs = docs.where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chance = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * per_language / n))])
    drawn = docs.select("lang", "text", draw.alias("draw")).where(F.col("draw") < chance[F.col("lang")])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = drawn.withColumn("place", first).where(F.col("place") <= per_language)

    noisy = 2 * -(-2 * per_language // len(counts))  # of these places every other gives noise, ``2 * per_language`` rows or a few more

    def counted(text: str) -> tuple[list[int], list[int]]:
        found = Counter()
        for at in range(0, len(text), CHUNK):
            keys, n = np.unique(grams(text[at : at + CHUNK]), return_counts=True)
            found.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        return list(found), list(found.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for lang, text, draw, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made.append((lang, draw, *counted(text)))
                if place % 2 and place <= noisy:
                    made.append((OTHER, draw, *counted(noise(text))))
            lang, at, keys, n = zip(*made, strict=True) if made else ((), (), (), ())
            columns = [pa.array(lang, pa.string()), pa.array(at, pa.float64()), pa.array(keys, pa.list_(pa.int16())), pa.array(n, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "draw", "keys", "n"])

    rows = drawn.mapInArrow(run, "lang string, draw double, keys array<short>, n array<int>").where(F.size("keys") > 0)
    each = Window.partitionBy("lang").orderBy("draw", F.size("keys"))
    rows = rows.withColumn("held", F.sum(F.size("keys")).over(each)).withColumn("place", F.row_number().over(each))
    rows = rows.where((F.col("held") <= entries // (len(counts) + 1)) & ((F.col("lang") != OTHER) | (F.col("place") <= 2 * per_language)))
    found = rows.select("lang", "draw", "keys", "n").toArrow().sort_by([("draw", "ascending"), ("lang", "ascending")])
    return list(zip(found.column("lang").to_pylist(), lists(found, "keys"), lists(found, "n"), strict=True))


def _fit(rows: list[Row], epochs: int, rate: float, seed: int) -> tuple[Model, list[Row], np.ndarray]:
    """SGD, one text a step, with a rate that falls to nothing; the model, a fifth of the rows that is kept back, and their logits."""
    languages = sorted({r[0] for r in rows} - {OTHER})
    classes = {lang: i for i, lang in enumerate([*languages, OTHER])}
    rng = np.random.default_rng(seed)
    table, layer, bias = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(classes))), np.zeros(len(classes))
    layer += rng.normal(0, 0.1, layer.shape)
    order = rng.permutation(len(rows))
    kept, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    steps, done = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            lang, keys, n = rows[i]
            share = n / n.sum()
            x = share @ table[keys]
            error = softmax((x @ layer + bias)[None])[0]
            error[classes[lang]] -= 1
            step = rate * (1 - done / steps)
            back = layer @ error
            layer -= step * np.outer(x, error)
            bias -= step * error
            table[keys] -= step * np.sqrt(share)[:, None] * back  # as in adaptive steps, rare n-grams move more than their share
            done += 1
    model, held = Model(languages, table @ layer, bias), [rows[i] for i in kept]
    z = _logits(model, held)
    if len(held):
        truth = np.array([classes[r[0]] for r in held])
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    return model, held, z


def _logits(model: Model, rows: list[Row]) -> np.ndarray:
    return np.array([(n / n.sum()) @ model.scores[keys] + model.bias for _, keys, n in rows]).reshape(len(rows), len(model.bias))


def _level(rows: list[Row], epochs: int, rate: float, seed: int) -> float:
    """The confidence that best tells texts of known languages from those of languages that were held back, or from noise if there is one language."""
    few, seen = [], Counter()
    for row in rows:
        seen[row[0]] += 1
        if seen[row[0]] <= PER_HELD_BACK:
            few.append(row)
    languages = sorted(set(seen) - {OTHER})
    known, foreign = [], []
    for group in range(min(HELD_BACK, len(languages))):
        out = set(languages[group::HELD_BACK]) if len(languages) > 1 else set()
        model, held, z = _fit([r for r in few if r[0] not in out], epochs, rate, seed)
        known += model.sure(z[[r[0] != OTHER for r in held]]).tolist()
        foreign += model.sure(z[[r[0] == OTHER for r in held]]).tolist() if not out else model.sure(_logits(model, [r for r in few if r[0] in out])).tolist()
    known, foreign = np.sort(known), np.sort(foreign)
    levels = np.concatenate([[0.0], foreign])
    gain = np.searchsorted(foreign, levels, side="right") / max(len(foreign), 1) - np.searchsorted(known, levels, side="right") / max(len(known), 1)
    return float(np.nextafter(levels[int(gain.argmax())], 1))


def train(rows: list[Row], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    if not {r[0] for r in rows} - {OTHER}:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    model, held, z = _fit(rows, epochs, rate, seed)
    own = z[[r[0] != OTHER for r in held]]
    if len(own):
        model.least = min(_level(rows, epochs, rate, seed), float(np.quantile(model.sure(own), REJECTED)))
    return model


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, ``lang_pred``, ``score`` (calibrated probability) and ``accepted`` for each row."""
    kept = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    schema = kept.drop("text").schema if "text" not in keep else kept.schema
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(place)]
            lang, score, accepted = zip(*found, strict=True) if found else ((), (), ())
            columns = [c for i, c in enumerate(batch.columns) if i != place or "text" in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=[*keep, "lang_pred", "score", "accepted"])

    made = schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return kept.mapInArrow(run, made)


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2) & F.col("doc_id").isNotNull()


def fitted(docs: DataFrame) -> Model:
    """The model of a table. The sample is let go afterwards: Arrow's pool would keep its memory for as long as the driver runs."""
    rows = sample(docs.where(~held_out()))
    model = train(rows)
    del rows
    pa.default_memory_pool().release_unused()
    return model


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fitted(docs)).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "accepted")
