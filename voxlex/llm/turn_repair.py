"""Repair of conversation structure by alignment to a grammar string.

The roles of a conversation shall read ``(s?(ua)+)?`` (system, user, assistant by
initials).  For every feasible length there is one such string.  The turns are
aligned to it by Wagner-Fischer: Keep costs 0, Rerole to user or assistant 1,
Delete 2 (required for blank and duplicate turns), Insert an empty user or
assistant turn 5; a truncated turn that stays costs 5 more.  Lengths are
tried by rising lower bound and only within Ukkonen's band, the cells through
which a path as cheap as the incumbent can lead.  The cheapest audits (initials
of the edits in order) are traced back and compared; the ASCII-least wins.

Long conversations.  Turns are dealt out by range of (conversation, turn, role,
text hash), so one conversation may lie in many tasks.  A task aligns stretches
of at most ``STRETCH`` turns to every piece of the grammar string that can stand
there (by where it starts and ends), and the pieces are joined by cost and
audit.  Within a stretch no edit after the last turn is an Insert; so of two
audits of a stretch neither begins with the other, and the least whole audit
consists of least pieces.  The joined result is that of one alignment.

What meets in one task for one conversation: eight audits per stretch, and then
its turns as a stream, since one hash runs over the whole repaired
conversation; a task holds one batch and the audit.

Defined results.  Null roles and texts are one space; a null conv_id is a
conversation of its own; turns are ordered by turn (nulls first), then role,
then text hash, so repeated rows are adjacent and later ones duplicates.  An
empty role has no legal initial.  Conversations all of whose rows are dropped
(``copies`` 0) stay, with zeros; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from itertools import count, groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxlex.llm.common import bound_arrow, join_counted, stage, workspace

DELETE, INSERT, REROLE, CUT_SHORT = 2, 5, 1, 5
#: Turns of one alignment; longer conversations are joined from pieces.
STRETCH = 64
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
NEVER = 1 << 60


# -- damage ------------------------------------------------------------------

def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): each row damaged by the remainder r of
    crc32("conv_id:turn") by 20.  0 drops it (no copies), 1 empties the text, 2
    removes its ``[.!?]``, 3 repeats it (two copies), 4 sets the role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = F.crc32(F.concat(part(conv), F.lit(":"), part(turn))) % 20
    return rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.when(r == 4, "user").otherwise(part(role)).alias("role"),
        F.when(r == 1, "").when(r == 2, F.translate(part(text), ".!?", "")).otherwise(part(text)).alias("text"),
        F.when(r == 0, 0).when(r == 3, 2).otherwise(1).alias("copies"))


# -- alignment of one stretch, inside tasks ------------------------------------

def target(kind: str, size: int) -> str:
    """The first ``size`` roles from a place in the grammar: "ua" where a user
    turn is due, "au" an assistant turn, "sua" at the system turn."""
    return ("s" + "ua" * size)[:size] if kind == "sua" else (kind * size)[:size]


def suffix_costs(turns, goal: str, most: int):
    """Wagner-Fischer table of what remains to be paid from (turns done, roles
    done), within the band of paths of cost <= ``most``; NEVER elsewhere.
    ``turns``: (initial, must go, cut short)."""
    m, n = len(turns), len(goal)
    table = [{} for _ in range(m + 1)]
    table[m] = {n: 0}

    def at_least(d):
        return INSERT * d if d > 0 else -DELETE * d

    for i in range(m - 1, -1, -1):
        initial, must, short = turns[i]
        stay = CUT_SHORT if short else 0
        row, below = table[i], table[i + 1]
        for j in range(n, -1, -1):
            if at_least(j - i) + at_least((n - j) - (m - i)) > most:
                continue
            best = below.get(j, NEVER) + DELETE
            if j < n:
                due = goal[j]
                if due != "s":
                    best = min(best, row.get(j + 1, NEVER) + INSERT)
                if not must:
                    if initial == due:
                        best = min(best, below.get(j + 1, NEVER) + stay)
                    elif due != "s":
                        best = min(best, below.get(j + 1, NEVER) + stay + REROLE)
            if best < NEVER:
                row[j] = best
    return table


def trace(turns, goal: str, table) -> str:
    """The ASCII-least audit of the cheapest paths: at every cell the least
    letter that keeps the cost (D, I, K, R)."""
    i = j = 0
    out = []
    while i < len(turns):
        cost, (initial, must, short) = table[i][j], turns[i]
        due, stay = goal[j:j + 1], CUT_SHORT if short else 0
        if table[i + 1].get(j, NEVER) + DELETE == cost:
            out.append("D")
            i += 1
        elif due not in ("", "s") and table[i].get(j + 1, NEVER) + INSERT == cost:
            out.append("I")
            j += 1
        else:
            out.append("K" if initial == due else "R")
            i, j = i + 1, j + 1
    return "".join(out)


def best_of(turns, kind: str) -> dict[str, tuple[int, str]]:
    """{class: (cost, audit)} of the lengths above 0 of one grammar piece, by
    class of length: "odd", "even", and "one" for a lone system turn."""
    m = len(turns)
    loose = sum(not must for _, must, _ in turns)
    shorts = sorted(CUT_SHORT for _, must, short in turns if short and not must)

    def floor(n):
        # turns that stay are at most min(n, loose); cut short ones stay only if the rest does not suffice
        stays = min(n, loose)
        return DELETE * (m - stays) + INSERT * (n - stays) + sum(shorts[:max(0, stays - (loose - len(shorts)))])

    best: dict[str, tuple[int, str]] = {}
    # beyond this length each further pair of roles only adds Inserts
    for n in sorted(range(1, loose + 4), key=lambda n: (floor(n), -n)):
        group = "one" if kind == "sua" and n == 1 else "odd" if n % 2 else "even"
        cost, audit = best.get(group, (NEVER, ""))
        if floor(n) > cost:
            continue
        goal = target(kind, n)
        table = suffix_costs(turns, goal, cost)
        new = table[0].get(0, NEVER)
        if new < NEVER and new <= cost:
            best[group] = min((cost, audit), (new, trace(turns, goal, table)))
    return best


#: Places in the grammar: before anything, after the system turn, user due after a
#: whole pair, assistant due.  (place, grammar piece, class of length) -> place.
STEPS = {
    ("start", "ua", "odd"): "a", ("start", "ua", "even"): "u",
    ("start", "sua", "one"): "s", ("start", "sua", "even"): "a", ("start", "sua", "odd"): "u",
    ("s", "ua", "odd"): "a", ("s", "ua", "even"): "u",
    ("u", "ua", "odd"): "a", ("u", "ua", "even"): "u",
    ("a", "au", "odd"): "u", ("a", "au", "even"): "a",
}
#: What completes the grammar from a place.
ENDS = {"start": "", "u": "", "a": "I", "s": "II"}


def pieces(turns, later: bool) -> dict[str, tuple[int, str]]:
    """{"piece class": (cost, audit)} of a stretch; an assistant turn can be due
    first only in a later stretch of its conversation."""
    out = {"none": (DELETE * len(turns), "D" * len(turns))}
    for kind in ["ua", "sua"] + ["au"] * later:
        for group, found in best_of(turns, kind).items():
            out[f"{kind} {group}"] = found
    return out


def join_piece(paths: dict, found: dict) -> dict:
    """Paths (place -> (cost, audit)) carried over one more stretch."""
    new: dict[str, tuple[int, str]] = {}
    for place, (cost, audit) in paths.items():
        moves = [(place, found["none"])] + [(to, found[f"{kind} {group}"]) for (at, kind, group), to in STEPS.items()
                                            if at == place and f"{kind} {group}" in found]
        for to, (c, a) in moves:
            new[to] = min(new.get(to, (NEVER, "")), (cost + c, audit + a))
    return new


def finish(paths: dict) -> tuple[int, str]:
    return min((cost + INSERT * len(ENDS[p]), audit + ENDS[p]) for p, (cost, audit) in paths.items())


# -- Spark jobs ----------------------------------------------------------------

def arrow_schema(spec: str) -> pa.Schema:
    """The Arrow schema of a DDL string (on the driver; tasks get the result)."""
    return to_arrow_schema(StructType.fromDDL(spec))


def faults(rows: DataFrame, folder: str) -> DataFrame:
    """Distinct rows (conv_id, turn, role, digest, n copies, blank, short, again)
    without texts, stored.  ``again``: role and text were seen at an earlier turn."""
    last = F.right(F.expr(f"trim(TRAILING '{WHITE}' FROM text)"), F.lit(1))
    narrow = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "copies",
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("short"))
    # copies of one row are one row here, however many there are
    same = narrow.groupBy("conv_id", "turn", "role", "digest", "blank", "short").agg(F.sum("copies").alias("n"))
    same = same.withColumn("key", F.sha2(F.to_json(F.struct("conv_id", "role", F.hex("digest").alias("d"))), 256))
    same = stage(same, folder, "distinct")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    live = same.where("n > 0")
    earliest = live.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    earliest = stage(earliest, folder, "earliest")
    flagged = join_counted(live.withColumnRenamed("n", "copies"), earliest, "key", live.count())
    flagged = flagged.select("conv_id", "turn", "role", "digest", F.col("copies").alias("n"), "blank", "short",
                             (order > F.col("first")).alias("again"))
    gone = same.where("n = 0").select("conv_id", "turn", "role", "digest", "n", "blank", "short", F.lit(False).alias("again"))
    return stage(flagged.unionByName(gone), folder, "faults")


_STRETCH = ("turn bigint, role string, digest binary, seq bigint, found map<string,struct<cost:bigint,audit:string>>, "
            "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, "
            "low bigint, high bigint, head string, tail string")


def stretches(flagged: DataFrame) -> DataFrame:
    """Aligned stretches of at most ``STRETCH`` turns, with the first row's order."""
    kind = flagged.schema["conv_id"].dataType.simpleString()
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]

    def summary(conv, part, seq, later):
        """``part``: (turn, role, digest, initial, fault or None)."""
        shown = [(c, f in ("blank", "duplicate"), f == "truncated") for *_, c, f in part]
        many = lambda f: sum(x[4] == f for x in part)
        turns = [x[0] for x in part if x[0] is not None]
        initials = [x[3] for x in part]
        found = pieces(shown, later) if part else {}
        return {"conv_id": conv, "seq": seq, "turn": part[0][0] if part else None, "role": part[0][1] if part else None,
                "digest": part[0][2] if part else None, "found": [(k, {"cost": c, "audit": a}) for k, (c, a) in found.items()],
                "blank": many("blank"), "duplicate": many("duplicate"), "truncated": many("truncated"),
                "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
                "head": initials[0] if part else None, "tail": initials[-1] if part else None}

    def rows(batches):
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "n", "blank", "short", "again")))

    def expanded(group):
        for _, turn, role, digest, n, blank, short, again in group:
            initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
            for k in range(n):
                fault = "blank" if blank else "duplicate" if again or k else "truncated" if short else None
                yield turn, role, digest, initial, fault

    spec = f"conv_id {kind}, {_STRETCH}"
    schema = arrow_schema(spec)

    def run(batches):
        held, opening = [], True
        for conv, group in groupby(rows(batches), key=lambda r: r[0]):
            it = expanded(group)
            for seq in count():
                part = list(islice(it, STRETCH))
                if not part and seq:
                    break
                # the first conversation of a task may have begun in the task before
                held.append(summary(conv, part, seq, seq > 0 or opening))
                if len(held) >= 1024:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
            opening = False
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return (flagged.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, spec))


_VERDICT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def verdicts(parts: DataFrame) -> DataFrame:
    """One row per conversation from its stretches, joined in order."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "found", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "head", "tail"]
    spec = f"conv_id {kind}, {_VERDICT}"
    schema = arrow_schema(spec)

    def verdict(conv, group):
        paths, counts, turns = {"start": (0, "")}, [0, 0, 0, 0], 0
        low = high = tail = None
        for _, found, *four, n, lo, hi, head, end in group:
            if head is None:
                continue
            paths = join_piece(paths, {k: (v["cost"], v["audit"]) for k, v in found})
            counts = [a + b for a, b in zip(counts, four)]
            counts[3] += tail is not None and tail + head not in ("su", "ua", "au")
            # a turn on both sides of a border is one turn
            turns += n - (high is not None and lo == high)
            low, high = (lo if low is None else low), (hi if hi is not None else high)
            tail = end
        cost, audit = finish(paths)
        return (conv, high - low + 1 - turns if low is not None else 0, *counts, cost, audit)

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names)))
        out = []
        columns = ["conv_id"] + [c.split()[0] for c in _VERDICT.split(", ")]
        for conv, group in groupby(rows, key=lambda r: r[0]):
            out.append(dict(zip(columns, verdict(conv, group))))
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return (parts.repartition("conv_id")
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(),
                                  F.col("digest").asc_nulls_first(), "seq")
            .select(*names).mapInArrow(run, spec))


def _edits(batches):
    """(conversation's verdict, its turns (role, text, copies) as a stream) from rows
    in which each conversation's verdict precedes its turns."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "verdict", "role", "text", "copies"))))
    for _, group in groupby(rows, key=lambda r: r[0]):
        conv, verdict, *_ = next(group)
        yield conv, verdict, ((r[2], r[3]) for r in group for _ in range(r[4]))


def repaired_turns(audit: str, turns):
    """(role, text) of the repaired conversation, turn by turn."""
    odd = (len(audit) - audit.count("D")) % 2
    j = -odd
    for letter in audit:
        role, text = next(turns) if letter != "I" else (None, "")
        if letter != "D":
            yield (role if letter == "K" else "assistant" if j % 2 else "user"), text
            j += 1


def with_verdicts(rows: DataFrame, verdict: DataFrame) -> DataFrame:
    """Verdict rows and turns together: all of a conversation in one task, its
    verdict first, its turns in order, as a stream."""
    fields = [c.split()[0] for c in _VERDICT.split(", ")]
    head = verdict.select("conv_id", F.lit(0).alias("kind"), F.struct(*fields).alias("verdict"))
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies",
                                           F.unhex(F.sha2("text", 256)).alias("digest"))
    return (head.unionByName(body, allowMissingColumns=True).repartition("conv_id")
            .sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
            .select("conv_id", "verdict", "role", "text", "copies"))


def judge(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of rows
    (conv_id, turn, role, text, copies)."""
    bound_arrow(rows.sparkSession)
    folder = workspace(rows.sparkSession, "turn-repair")
    parts = stage(stretches(faults(rows, folder)), folder, "stretches")
    return stage(verdicts(parts), folder, "verdicts")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, turn by turn."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    spec = f"conv_id {kind}, place bigint, role string, text string"
    schema = arrow_schema(spec)

    def run(batches):
        out, size = [], 0
        for conv, verdict, turns in _edits(batches):
            for k, (role, text) in enumerate(repaired_turns(verdict["audit"], turns)):
                out.append({"conv_id": conv, "place": k, "role": role, "text": text})
                size += len(text)
                if len(out) >= 1024 or size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return with_verdicts(rows, judge(rows)).mapInArrow(run, spec)


def repair(rows: DataFrame) -> DataFrame:
    """``judge`` and ``repaired_sha256``, the hash of the repaired ``role:text``
    lines joined by newlines."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    spec = f"conv_id {kind}, {_VERDICT}, repaired_sha256 string"
    schema = arrow_schema(spec)

    def run(batches):
        out = []
        for conv, verdict, turns in _edits(batches):
            digest = hashlib.sha256()
            for k, (role, text) in enumerate(repaired_turns(verdict["audit"], turns)):
                digest.update(f"{chr(10) * (k > 0)}{role}:{text}".encode())
            out.append({"conv_id": conv, **verdict, "repaired_sha256": digest.hexdigest()})
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return with_verdicts(rows, judge(rows)).mapInArrow(run, spec)
