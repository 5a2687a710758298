import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, doc int, _id int, score string, kept string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    made = ["".join(r.choice("aeioubdklmnrst") for _ in range(r.randint(2, 8))) for _ in range(n)]
    lines, k = [], 0
    while k < n:
        step = r.randint(5, 25)
        lines.append(" ".join(made[k : k + step]) + ".")
        k += step
    return "\n".join(lines)


def document_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, shared lines and blocks."""
    block = prose(900, 80)
    base = prose(901, 120).split()
    rows = [(k, prose(k, 30 + 7 * (k % 40)), "en", f"s{k % 3}", 0) for k in range(60)]
    rows += [(100 + k, "Common footer line here\n" + prose(200 + k, 60), "en", "s0", 0) for k in range(14)]
    rows += [(200 + k, prose(300 + k, 40) + "\n" + block + "\n" + prose(400 + k, 40), "fr", "s1", 0) for k in range(5)]
    for k in range(6):
        changed = list(base)
        changed[10 + k] = "changed"
        rows.append((300 + k, " ".join(changed), "de", "s2", 0))
    rows += [(400 + k, rows[3][1], "en", "s1", 0) for k in range(4)]
    rows += [
        (500, None, "en", "s0", 0),
        (501, "", "en", "s0", 0),
        (502, " \t\n\x0b\x0c\r ", "en", "s1", 0),
        (503, "one", "en", None, 0),
        (504, "two words", None, None, None),
        (505, "Ünïcode ▁ mark 😀 \x01 tab\there  two  spaces\n\n\nblank", "en", "s2", 0),
        (506, "say " * 9000, "en", "s2", 0),
        (507, prose(77, 30000), "en", "s1", 0),
        (508, "x" * 200_000, "en", "s1", 0),
        (509, "a <|endoftext|> b<|endoftext|>", "en", "s1", 0),
        (None, "no id " + prose(5, 40), "en", "s1", 0),
        (None, None, None, None, None),
        (7, rows[7][1], "en", "s1", 0),
    ]
    return [(*r, "z", 1, 2, "s", "k") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    out = [(r[0], k % 2, int("ab" in (r[1] or "")[:200]), "extra") for k, r in enumerate(rows) if r[0] is not None]
    return spark.createDataFrame([*out, (None, 1, 1, "x"), (1, None, None, "x"), (99999, 0, 0, "x")], "doc_id long, quality int, toxic int, score string")
