import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rarefold.llm import convrepair as cr

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost long, extra boolean"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain_answer(rows):
    """One conversation's rows after damage by trying every edit at every place."""
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r[3])))
    seen, marks = set(), []
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        marks.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}  # legal prefix shape -> cost, audit, lines
    shapes = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def offer(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def inserted(table):
        for _ in range(3):
            for key, (c, a, lines) in list(table.items()):
                for r, to in shapes[key].items():
                    if r in "ua":
                        offer(table, to, (c + 5, a + "I", (*lines, {"u": "user:", "a": "assistant:"}[r])))
        return table

    for (_, _, role, text), mark in zip(rows, marks, strict=True):
        new = {}
        for key, (c, a, lines) in inserted(best).items():
            offer(new, key, (c + 2, a + "D", lines))
            if mark not in ("blank", "duplicate"):
                extra = 5 * (mark == "truncated")
                for r, to in shapes[key].items():
                    if role[:1] == r:
                        offer(new, to, (c + extra, a + "K", (*lines, f"{role}:{text}")))
                    if r in "ua":
                        offer(new, to, (c + extra + 1, a + "R", (*lines, {"u": "user:", "a": "assistant:"}[r] + text)))
        best = new
    cost, audit, lines = min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])
    turns = {r[1] for r in rows} - {None}
    initials = [r[2][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{m: marks.count(m) for m in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def made(seed, convs, most=12):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool"])
            rows.append((c, t + (3 if rng.random() < 0.1 else 0), role, rng.choice(["Yes.", "No!", "why", "", " \t", "so  ", "é?", f"n{rng.randint(0, 9)}."])))
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    got = {r.conv_id: r.asDict() for r in cr.repair(df).collect()}
    after = plain_damage(rows)
    want = {c: plain_answer([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}
    assert got.keys() == want.keys()
    for c, w in want.items():
        assert {k: got[c][k] for k in w} == w, c


def test_every_conversation_equals_brute_force(spark):
    rows = made(1, 60)
    rows += [(None, None, None, None), (None, 2, "user", "x."), (None, 2, "user", "x."), (500, None, "user", "a."), (500, None, None, "b."), (501, 1, "", None)]
    check(spark, rows)


@pytest.mark.parametrize("turns", [1, 7])
def test_conversations_cut_into_segments(spark, monkeypatch, turns):
    """Blocks of few turns and range bounds inside conversations: matrices of segments make the same answers."""
    monkeypatch.setattr(cr, "BLOCK_TURNS", turns)
    check(spark, made(2, 3, 60) + [(9, k // 5, "user" if k % 2 else "assistant", f"t{k // 3}.") for k in range(300)])


def test_long_conversation_costs(spark):
    check(spark, [(7, k, ["user", "assistant"][k % 2], f"text {k}.") for k in range(3000)])


def test_empty_table(spark):
    assert cr.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_rows_hash_to_the_digest(spark):
    df = spark.createDataFrame([(*r, None, None, None) for r in made(4, 20)], SCHEMA)
    rows = cr.damaged(df)
    answers = cr.solve(rows)
    lines = {}
    for r in sorted(cr.repaired(rows, answers).collect(), key=lambda r: (r.conv_id, r.nr)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    hashes = {r.conv_id: r.repaired_sha256 for r in cr.hashes(rows, answers).collect()}
    assert {c: hashlib.sha256("\n".join(f"{a}:{b}" for a, b in x).encode()).hexdigest() for c, x in lines.items()} == hashes
    assert all(LEGAL.fullmatch("".join(a[0] for a, _ in x)) for x in lines.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), max_size=6))
def test_grammar_expands_to_its_sequences(sequences):
    lines, rules = cr.re_pair([bytes(s) for s in sequences], 4)

    def expand(x):
        return [x] if x < 4 else expand(rules[x - 4][0]) + expand(rules[x - 4][1])

    assert [[y for x in line for y in expand(x)] for line in lines] == sequences
    pairs = [p for line in lines for p in zip(line, line[1:], strict=False)]
    assert all(pairs.count(p) < 2 or p[0] == p[1] for p in pairs)  # of overlapping twins one can be left


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("DIKR", max_size=90), min_size=2, max_size=6))
def test_ropes_compare_as_strings(parts):
    a, b = cr.leaf(""), cr.leaf("")
    for p in parts:
        a = a + cr.leaf(p)
    for p in parts[:-1]:
        b = b + cr.leaf(p)
    b = b + cr.leaf(parts[-1][::-1])
    assert (a < b) == (str(a) < str(b)) and (b < a) == (str(b) < str(a)) and not a < a
