"""Conversation structure repair: cheapest edits to a legal sequence of turns, by grammar-compressed dynamic programming.

A turn is a symbol: the initial of its role and its fault. An edit (keep, rerole, delete, insert) moves a small automaton of
the legal role sequences ``(s?(ua)+)?``, so a symbol is a min-plus transfer matrix: from each state to each state the least cost
and, among the edits of that cost, the least audit string. Re-Pair replaces the pair of symbols that is most frequent in the
conversations of a block by a new one, again and again; a rule's matrix is the product of its two parts', computed
once bottom-up and shared by all conversations that hold it. Audits are ropes that share their parts in the same way.

Conversations are dealt by range of (conversation, turn), so a very long one is spread over tasks: matrices of its segments are
multiplied in order afterwards. Only the hash of the repaired text has to read a conversation in one sequence; it streams.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rarefold.llm.common import checkpointed, map_stream, ship, table

#: Turns of one block: grammar and matrices of a block are held in a task's memory.
BLOCK_TURNS = 1 << 17

#: The costs of the edits and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Legal ends: 0 and 3.
STATES, LEGAL_ENDS = range(4), (0, 3)
_USER_FROM, _ASSISTANT_FROM = (0, 1, 3), (2,)
_LEAF = 48


class Rope:
    """A string as a tree of shared parts."""

    __slots__ = ("parts", "size")

    def __init__(self, parts, size: int):
        self.parts, self.size = parts, size

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if not other.size else other
        if self.size + other.size <= _LEAF:
            return Rope(self.parts + other.parts, self.size + other.size)
        return Rope((self, other), self.size + other.size)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            x = stack.pop()
            if isinstance(x.parts, str):
                yield x.parts
            else:
                stack += x.parts[::-1]

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        """ASCII order; parts that both share at the same place are passed over whole."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y:
                continue
            if not isinstance(x.parts, str) and (x.size >= y.size or isinstance(y.parts, str)):
                a += x.parts[::-1]
                b.append(y)
            elif not isinstance(y.parts, str):
                a.append(x)
                b += y.parts[::-1]
            else:
                n = min(x.size, y.size)
                if x.parts[:n] != y.parts[:n]:
                    return x.parts < y.parts
                if x.size > n:
                    a.append(Rope(x.parts[n:], x.size - n))
                if y.size > n:
                    b.append(Rope(y.parts[n:], y.size - n))
        return bool(b)


def leaf(text: str) -> Rope:
    return Rope(text, len(text))


#: state -> state -> (cost, audit); states that can't be reached are left out.
Matrix = dict[int, dict[int, tuple[int, Rope]]]


def _offer(row: dict, state: int, cost: int, audit: Rope) -> None:
    old = row.get(state)
    if old is None or cost < old[0] or (cost == old[0] and audit < old[1]):
        row[state] = (cost, audit)


def advance(row: dict[int, tuple[int, Rope]], m: Matrix) -> dict[int, tuple[int, Rope]]:
    """One row of a product. Equal-cost audits between the same states over the same turns are never prefixes of each
    other (the longer would insert for nothing), so the least whole is made of least parts."""
    out: dict[int, tuple[int, Rope]] = {}
    for mid, (c1, a1) in row.items():
        for to, (c2, a2) in m[mid].items():
            old = out.get(to)
            if old is None or c1 + c2 <= old[0]:
                _offer(out, to, c1 + c2, a1 + a2)
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return {p: advance(row, b) for p, row in a.items()}


def _inserts() -> Matrix:
    """Any number of inserted turns; more than two in a row only come back to a state."""
    one: Matrix = {p: {p: (0, leaf(""))} for p in STATES}
    for p in _USER_FROM:
        _offer(one[p], 2, INSERT, leaf("I"))
    for p in _ASSISTANT_FROM:
        _offer(one[p], 3, INSERT, leaf("I"))
    return times(times(one, one), one)


INSERTS = _inserts()
UNIT: Matrix = {p: {p: (0, leaf(""))} for p in STATES}

#: Symbols: the initial (anything else as "x") with its fault "." (none) or "t" (truncated), and "-" for turns that must go.
SYMBOLS = ["-", *(i + f for i in "suax" for f in ".t")]


def terminal(symbol: str) -> Matrix:
    """Inserts before the turn, then one edit of it."""
    edits: Matrix = {p: {p: (DELETE, leaf("D"))} for p in STATES}
    if symbol != "-":
        extra = TRUNCATED if symbol[1] == "t" else 0
        steps = [(p, 2, "u") for p in _USER_FROM] + [(p, 3, "a") for p in _ASSISTANT_FROM]
        for p, q, initial in steps:
            _offer(edits[p], q, REROLE + extra, leaf("R"))
            if symbol[0] == initial:
                _offer(edits[p], q, extra, leaf("K"))
        if symbol[0] == "s":
            _offer(edits[0], 1, extra, leaf("K"))
    return times(INSERTS, edits)


TERMINALS = [terminal(x) for x in SYMBOLS]


def re_pair(sequences: list[bytes], first: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """The sequences over a grammar of all of them: rule k is symbol ``first + k`` and stands for its pair.

    The most frequent pair is replaced first, ties to the smaller one; the occurrences of every pair are kept as places in linked lists,
    so that the whole takes near-linear time.
    """
    sym: list[int] = []
    for s in sequences:
        sym += s
        sym.append(-1)
    n = len(sym)
    after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in range(n - 1):
        if sym[i] >= 0 and sym[i + 1] >= 0:
            places[sym[i], sym[i + 1]].add(i)
    heap = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        found = places.get(pair, ())
        if len(found) != -count:
            if len(found) > 1:
                heapq.heappush(heap, (-len(found), pair))
            continue
        new, fresh = first + len(rules), set()
        used = False
        for i in sorted(found):
            j = after[i]
            if sym[i] != pair[0] or j >= n or sym[j] != pair[1]:
                continue  # eaten by an overlapping occurrence
            used = True
            h, k = ahead[i], after[j]
            if h >= 0 and sym[h] >= 0:
                places[sym[h], pair[0]].discard(h)
                places[sym[h], new].add(h)
                fresh.add((sym[h], new))
            if k < n and sym[k] >= 0:
                places[pair[1], sym[k]].discard(j)
                places[new, sym[k]].add(i)
                fresh.add((new, sym[k]))
            sym[i], sym[j] = new, -2
            after[i] = k
            if k < n:
                ahead[k] = i
        places.pop(pair, None)
        if used:
            rules.append(pair)
        for p in fresh:
            if len(places[p]) > 1:
                heapq.heappush(heap, (-len(places[p]), p))
    out, line, i = [], [], 0
    while i < n:
        if sym[i] == -1:
            out.append(line)
            line = []
        else:
            line.append(sym[i])
        i = after[i]
    return out, rules


def best_end(row: dict[int, tuple[int, Rope]]) -> tuple[int, str]:
    """The cheapest way to a legal end and its audit."""
    ends: dict[int, tuple[int, Rope]] = {}
    for q, (cost, audit) in advance(row, INSERTS).items():
        if q in LEGAL_ENDS:
            _offer(ends, 0, cost, audit)
    cost, audit = ends[0]
    return cost, str(audit)


def transfer(sequences: list[bytes], whole: list[bool]) -> list[list[tuple[int, int, int, str]]]:
    """For every sequence of symbols its (from, to, cost, audit): of a whole one the answer only, as (0, 0, cost, audit)."""
    wanted = {(s, w) for s, w in zip(sequences, whole, strict=True)}
    distinct = sorted({s for s, _ in wanted})
    lines, rules = re_pair(distinct, len(TERMINALS))
    matrices = list(TERMINALS)
    for a, b in rules:
        matrices.append(times(matrices[a], matrices[b]))
    answers: dict[tuple[bytes, bool], list] = {}
    for s, line in zip(distinct, lines, strict=True):
        if (s, True) in wanted:
            row = UNIT[0]
            for x in line:
                row = advance(row, matrices[x])
            answers[s, True] = [(0, 0, *best_end(row))]
        if (s, False) in wanted:
            m = UNIT
            for x in line:
                m = times(m, matrices[x])
            answers[s, False] = [(p, q, cost, str(audit)) for p, row in m.items() for q, (cost, audit) in row.items()]
    return [answers[k] for k in zip(sequences, whole, strict=True)]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that crc32 of ``conv_id:turn`` orders; nulls of the text columns and of the key read as one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind, role, text = F.crc32(key) % 20, F.coalesce(F.col("role").cast("string"), blank), F.coalesce(F.col("text").cast("string"), blank)
    out = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return out.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.encode(F.col(text), "UTF-8"), 256))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, blank, truncated, first, copies): equal rows of a turn as one.

    ``first``: its first copy is the first of the conversation with this role and text; all further ones are duplicates.
    """
    shown = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    ended = F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    thin = rows.select("conv_id", "turn", "role", _digest("text").alias("digest"), F.substring("role", 1, 1).alias("initial"), (~shown).alias("blank"), (shown & ~ended).alias("truncated"), "copies")
    turns = thin.groupBy("conv_id", "turn", "role", "digest", "initial", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    least = thin.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("least"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return turns.join(least, same).select(*turns.columns, F.col("turn").eqNullSafe(F.col("least.turn")).alias("first"))


class _Segment:
    """A run of a conversation's turns within a block: its symbols and what is counted along them."""

    def __init__(self, conv, opens: bool):
        self.conv, self.opens, self.goes_on = conv, opens, False
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = self.least = self.most = None

    def add(self, turn, initial: str, blank: bool, truncated: bool, first: bool, copies: int) -> None:
        legal = 0 if self.tail is None else int(self.tail + initial not in ("su", "ua", "au"))
        self.illegal += legal + (copies - 1)  # a copy has its own initial before it
        self.head = initial if self.head is None else self.head
        self.tail = initial
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        if blank:
            self.blank += copies
            self.symbols += bytes([0]) * copies
            return
        stays = int(first)
        if stays:
            self.truncated += truncated
            known = initial if initial in ("s", "u", "a") else "x"
            self.symbols.append(SYMBOLS.index(known + ("t" if truncated else ".")))
        self.duplicate += copies - stays
        self.symbols += bytes([0]) * (copies - stays)


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "least", "most")
_PATHS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SEGMENT_DDL = "part int, nr long, whole boolean, head string, tail string, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, paths array<struct<p:int,q:int,cost:long,audit:string>>"


def segments(rows: DataFrame) -> DataFrame:
    """Every segment with its transfer matrix (of whole conversations the answer); ``rows`` lie in order of range partitions."""
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL(_SEGMENT_DDL)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nr, held, size, conv_type = TaskContext.get().partitionId(), 0, [], 0, None

        def flush(cut: bool) -> pa.RecordBatch:
            nonlocal nr, held, size
            held[-1].goes_on = cut
            whole = [not (s.opens or s.goes_on) for s in held]
            paths = transfer([bytes(s.symbols) for s in held], whole)
            columns = [
                pa.array([s.conv for s in held], type=conv_type),
                pa.array([part] * len(held), pa.int32()),
                pa.array(range(nr, nr + len(held)), pa.int64()),
                pa.array(whole),
                *[pa.array([getattr(s, c) for s in held], pa.string()) for c in ("head", "tail")],
                *[pa.array([getattr(s, c) for s in held], pa.int64()) for c in _COUNTS],
                pa.array([[dict(zip("pq", x[:2], strict=True), cost=x[2], audit=x[3]) for x in path] for path in paths], _PATHS),
            ]
            nr += len(held)
            held, size = [], 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        begun, last = False, None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "blank", "truncated", "first", "copies")), strict=True):
                if size >= BLOCK_TURNS:
                    yield flush(begun and conv == last)
                    held = [_Segment(conv, True)] if conv == last else []
                if not held or conv != held[-1].conv or not begun:
                    held.append(_Segment(conv, not begun))
                begun, last = True, conv
                held[-1].add(*turn)
                size += turn[-1]
        if held:
            yield flush(True)

    return map_stream(rows, run, schema)


def joined(open_segments: DataFrame) -> DataFrame:
    """Answers of conversations in several segments: their matrices in order, at most one segment a block of turns."""
    ship(open_segments.sparkSession)
    schema = StructType([StructField("conv_id", open_segments.schema["conv_id"].dataType), *StructType.fromDDL(_ANSWER_DDL)])
    names = schema.names

    def step(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["nr"]))
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        state, least, most, tail = UNIT[0], None, None, None
        for r in rows:
            for c in total:
                total[c] += r[c]
            total["illegal"] += int(tail is not None and tail + r["head"] not in ("su", "ua", "au"))
            total["turns"] -= int(most is not None and r["least"] == most)  # a turn cut by the segments' bound
            tail = r["tail"]
            least = r["least"] if least is None else least
            most = most if r["most"] is None else r["most"]
            matrix: Matrix = {p: {} for p in STATES}
            for x in r["paths"]:
                matrix[x["p"]][x["q"]] = (x["cost"], leaf(x["audit"]))
            state = advance(state, matrix)
        cost, audit = best_end(state)
        values = {**total, "least": least, "most": most, "cost": cost, "audit": audit}
        arrays = [pa.array([rows[0]["conv_id"]], group.schema.field("conv_id").type)]
        arrays += [pa.array([values[c]], pa.string() if c == "audit" else pa.int64()) for c in names[1:]]
        return pa.table(arrays, names=names)

    return open_segments.groupBy("conv_id").applyInArrow(step, schema)


_ANSWER_DDL = "blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, cost long, audit string"


def solve(rows: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, turns, least, most, cost, audit) of every conversation that has rows."""
    order = ["conv_id", "turn", "role", "digest"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(faults(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("role", "digest"))
    found = checkpointed(segments(dealt))
    names = StructType.fromDDL(_ANSWER_DDL).names
    done = found.where("whole").select("conv_id", *names[:-2], F.col("paths")[0]["cost"].alias("cost"), F.col("paths")[0]["audit"].alias("audit"))
    return done.unionByName(joined(found.where("not whole")))


def repaired(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """The repaired turns of every conversation in order: (conv_id, nr, role, text), edits applied as the audit says.

    A conversation streams through one task, turn by turn; nothing but its audit is held.
    """
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL("nr long, role string, text string")])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_type, turns in _edited(batches):
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in turns], conv_type), pa.array([t[1] for t in turns], pa.int64()), pa.array([t[2] for t in turns], pa.string()), pa.array([t[3] for t in turns], pa.string())], names=names)

    return map_stream(_with_audits(rows, answers), run, schema)


def hashes(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired ``role:text`` lines, newline-joined, for conversations that keep any."""
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL("repaired_sha256 string")])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h, done, conv_type = None, None, [], None
        for conv_type, turns in _edited(batches):
            for c, nr, role, text in turns:
                if nr == 0:
                    if h is not None:
                        done.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                h.update(f"{chr(10) if nr else ''}{role}:{text}".encode())
            if len(done) > 10_000:
                yield _pairs(done, conv_type, names)
                done = []
        if h is not None:
            yield _pairs([*done, (conv, h.hexdigest())], conv_type, names)

    return map_stream(_with_audits(rows, answers), run, schema)


def _pairs(done: list, conv_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], conv_type), pa.array([x for _, x in done], pa.string())], names=names)


def _with_audits(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order, in one partition."""
    nothing = F.lit(None)
    turns = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest("text").alias("digest"), "text", "copies")
    audits = answers.select("conv_id", F.lit(0).alias("kind"), nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("binary").alias("digest"), F.col("audit").alias("text"), F.lit(0).alias("copies"))
    return turns.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "kind", "role", "text", "copies")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list[tuple]]]:
    """(conv_id, nr, role, text) of the turns that come out, batch by batch."""
    conv, audit, at, state, nr, conv_type = None, "", 0, 0, 0, None
    out: list[tuple] = []

    def put(role: str, text: str, to: int) -> None:
        nonlocal state, nr
        out.append((conv, nr, role, text))
        state, nr = to, nr + 1

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(*(("assistant", "", 3) if state == 2 else ("user", "", 2)))
            at += 1

    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        for c, kind, role, text, copies in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "kind", "role", "text", "copies")), strict=True):
            if kind == 0:
                inserts()
                conv, audit, at, state, nr = c, text, 0, 0, 0
                continue
            for _ in range(copies):
                inserts()
                edit = audit[at]
                at += 1
                if edit == "K":
                    put(role, text, {"s": 1, "u": 2, "a": 3}[role[0]])
                elif edit == "R":
                    put(*(("assistant", text, 3) if state == 2 else ("user", text, 2)))
        yield conv_type, out
        out = []
    inserts()
    if out:
        yield conv_type, out


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest repair and its hash for every conversation, those without rows after the damage too.

    Null conv_id is a conversation of its own; null turns come first and count neither as turns nor as gaps; equal turns go by role and
    then by SHA-256 of the text; roles other than the three (nulls: one space) can be reroled or deleted; extra columns are ignored; an empty table gives no rows.
    """
    rows = damaged(conversations)
    answers = checkpointed(solve(rows))
    every = conversations.select("conv_id").distinct()
    full = answers.join(hashes(rows, answers).withColumnRenamed("conv_id", "h"), F.col("conv_id").eqNullSafe(F.col("h")), "left").drop("h")
    full = every.join(full.withColumnRenamed("conv_id", "a"), F.col("conv_id").eqNullSafe(F.col("a")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return full.select("conv_id", gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
