"""Small tables with the awkward cases: nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank long, row string, key string, size long, h string, spans string, fp long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("river stone walks under seven bright lanterns while quiet gardens keep their winter songs and morning trains carry letters home".split()) + rng.choice(["", "s", "ed"]) for _ in range(n))


def documents(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    texts[3] = texts[4] = None
    texts[5] = ""
    texts[6] = " \n\t "
    texts[7] = prose(rng, 20_000)
    texts[8] = texts[9] = texts[10]
    texts[11] = "12 34 !!"
    texts[12] = "один два три четыре пять \U0001f600 шесть семь восемь девять"
    texts[13] = "一二三四五六七八九十百千"
    texts[14] = texts[15] + " end"
    texts[16] = "mail a.b+c@x-y.example.org or 192.168.1.254, 999.1.1.1; card 4111 1111 1111 1111, call +44 (20) 7946-0958. é @ b@c"
    rows = [(i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["web", "web", "web", "books", None]), len(t or ""), i, "x", None, 7, "h", "s", 1) for i, t in enumerate(texts)]
    rows.append(rows[20])  # a repeated row
    rows.append((rows[21][0], "another text of the same id", *rows[21][2:]))
    rows.append((None, "no id " + prose(rng, 8), "en", "web", 5, 0, None, None, None, None, None, None))
    return rows
