"""Small documents with the awkward cases: null and empty texts, no words, copies, repeated rows, very long ones, clashing columns."""

import random

SYLLABLES = ["the", "er", "on", "in", "tion", "ing", "ou", "é", "ß", "and", "re", "ble", "st"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(n=60, seed=3):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    out = []
    for i in range(n):
        text = prose(rng, rng.choice([5, 30, 80, 200]))
        if i % 5 == 1:
            text = out[i // 2][1] or ""  # an exact copy
        elif i % 5 == 2 and out[i // 2][1]:
            words = out[i // 2][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)  # a near copy
        elif i % 5 == 3:
            text = text + "\n" + passage + " " + text
        out.append([i * 3, text, "en" if i % 4 else "fr", f"src{i % 3}", len(text)])
    out[7][1], out[8][1], out[9][1], out[10][1] = None, "", "  \t\n", "a\0b  <|endoftext|> ▁x  "
    out[11][1] = prose(rng, 4000)
    out[12][1] = "Thor " * 900
    out[13][2] = out[14][3] = None
    return [tuple(r) for r in out] + [tuple(out[20]), (None, "an id is missing " + passage, None, None, None)]


def frame(spark, made=None):
    return spark.createDataFrame(made if made is not None else rows(), SCHEMA)


def labels(spark, n=60):
    return spark.createDataFrame([(i * 3, i % 4 != 0, int(i % 7 == 0)) for i in range(n)] + [(None, True, 1), (3, None, None)], "doc_id long, q boolean, toxic int").selectExpr("doc_id", "cast(q as int) quality", "toxic")
