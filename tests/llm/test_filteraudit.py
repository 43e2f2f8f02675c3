import itertools
import re

import pytest

from rarefold.llm import filteraudit as fa

LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (4, None, 1), (10, 1, 0), (None, 1, 1), (99, 1, 1)]


def labels(spark):
    return spark.createDataFrame([(*x, "clash") for x in LABELS], "doc_id long, quality int, toxic int, text string")


def plain(docs):
    good = {d for d, q, _ in LABELS if d is not None and q == 1}
    toxic = {d for d, _, t in LABELS if d is not None and t == 1}
    rows = []
    for d, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in docs),
        }
        rows.append((part or "", f, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [r for r in left if r[1][x]]
                redundant = sum(r[1][x] for r in mine) - len(gone)
                left = [r for r in left if not r[1][x]]
                shapley[x] += len(gone)
                alone = sum(r[1][x] and sum(r[1].values()) == 1 for r in mine)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_awkward_rows_equal_brute_force(spark, docs):
    texts = [(60, "Aa " * 300 + "#", "xx"), (61, "Aa " * 300 + "#", "yy"), (62, "Aa " * 300 + "#", None), (62, "Aa " * 300 + "#", None), (63, "A|B " + " ".join(f"w{k}" for k in range(250)), "zz")]
    added = spark.createDataFrame([(d, t, p) for d, t, p in texts], "doc_id long, text string, lang string")
    table = docs.unionByName(added, allowMissingColumns=True)
    got = fa.audit(fa.mask_counts(table, labels(spark))).collect()
    want = plain([(r.doc_id, r.text, r.lang) for r in table.select("doc_id", "text", "lang").collect()])
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want
    assert len(got) == len(want) == 600 * len({p for p, *_ in want})


def test_empty_tables(spark, docs, no_docs):
    assert fa.audit(fa.mask_counts(no_docs, labels(spark))).count() == 0
    assert fa.audit(fa.mask_counts(docs, labels(spark).limit(0))).where("good_lost > 0 or toxic_lost > 0").count() == 0


@pytest.mark.parametrize("n", [1, 2**31, 10**15])
def test_full_counters_do_not_touch_their_neighbours(n):
    rows = fa.audit_part("p", [(31, 1, 1, n), (0, 0, 0, 1)])
    first = [k for k, s in enumerate(rows["step"]) if s == 1]
    assert all(rows["removed"][k] == n and rows["kept"][k] == 1 and rows["good_lost"][k] == n for k in first)
    assert rows["shapley"] == [24 * n] * 600 and rows["unique_fails"] == [0] * 600
    assert sum(rows["redundant"]) == 120 * 4 * n


def test_removed_and_redundant_are_the_filter_s_failures():
    for mask in range(32):
        for k, (kept, removed, redundant) in enumerate(fa.outcomes(mask)):
            order, step = fa.ORDERS[k // 5], k % 5
            assert removed + redundant == mask >> fa.FILTERS.index(order[step]) & 1 and kept + removed <= 1
