"""Small awkward tables shared by the tests: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

EXTRA = "score double, predicted int, fp long, component_id long, held_out boolean, lang_pred string, part int, extra boolean, key long, rid long, h long, c long, length long, row string, name string, tokens long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
_EMPTY = (None,) * len(EXTRA.split(","))


def prose(seed: int, n: int, letters: str = "abcdefgh") -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    return " ".join(rng.choice(words) for _ in range(n))


def documents(spark):
    a, b = prose(1, 80), prose(2, 90, "nopqrst")
    texts = [
        (1, a, "xx", "s1"), (2, a, "xx", "s1"), (3, a + " extra", "xx", None), (4, b, "yy", "s2"), (5, b.upper(), "yy", "s2"),
        (6, None, None, None), (7, "", "xx", ""), (8, " \t\n ", None, "s1"), (9, "12 34 !!", "yy", "s1"), (10, prose(3, 30000), "xx", "s1"),
        (None, a, "xx", "s2"), (None, None, None, None), (4, b, "yy", "s2"), (11, "héé ñandú ß", "yy", "s3"), (12, "x" * 50000, "xx", "s1"), (13, "日本語 テスト", None, "s1"),
    ]
    texts += [(20 + k, prose(50 + k, 40, "abcdefgh" if k % 2 else "nopqrst"), "xx" if k % 2 else "yy", f"s{k % 3}") for k in range(40)]
    return spark.createDataFrame([(*t, None if t[1] is None else len(t[1]), *_EMPTY) for t in texts], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
