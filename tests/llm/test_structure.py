"""Repair of conversations: every edit sequence tried, long streams in small blocks, edges."""

import hashlib
import itertools
import random

import pytest

from merchloom.llm import queries, structure
from merchloom.llm.structure import damage, digests, repair

INITIALS = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}


def legal(roles):
    body = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (body != "" and body == "ua" * (len(body) // 2))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Every edit of every row, with up to two inserted rows in every gap."""
    found = faults(rows)
    fillers = ["", "u", "a", "ua", "au"]
    best = None
    per_row = []
    for (role, text), fault in zip(rows, found, strict=True):
        late = 5 if fault == "truncated" else 0
        ways = [(2, "D", "", None)]
        if fault not in ("blank", "duplicate"):
            ways += [(late, "K", role[:1], f"{role}:{text}")]
            ways += [(late + 1, "R", r, f"{INITIALS[r]}:{text}") for r in "ua"]
        per_row.append(ways)
    for ways in itertools.product(*per_row):
        for gaps in itertools.product(fillers, repeat=len(rows) + 1):
            cost = sum(w[0] for w in ways) + 5 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            roles, audit, lines = "", "", []
            for gap, way in itertools.zip_longest(gaps, ways):
                roles += gap
                audit += "I" * len(gap)
                lines += [f"{INITIALS[r]}:" for r in gap]
                if way:
                    roles, audit = roles + way[2], audit + way[1]
                    lines += [way[3]] if way[3] is not None else []
            if legal(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def test_every_edit_sequence(spark):
    draw = random.Random(7)
    convs = {0: []}
    for conv in range(1, 160):
        convs[conv] = [(INITIALS[draw.choice("ssuuuaaat")], draw.choice(["One.", "Two!", "cut", " ", f"Own {k}.", f"open {k}"])) for k in range(draw.choice([1, 2, 3, 3]))]
    rows = [(c, k, *row) for c, found in convs.items() for k, row in enumerate(found)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in digests(repair(frame)).collect()}
    assert got == {c: brute(found) for c, found in convs.items() if found}


def plain(rows):
    """The same by a table of whole strings, for longer conversations."""
    found = faults(rows)
    nxt, give = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "user", 1: "user", 2: "assistant", 3: "user"}
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    after = {0: (0, "", ()), 3: (0, "", ()), 2: (5, "I", ("assistant:",)), 1: (10, "II", ("user:", "assistant:"))}
    for (role, text), fault in reversed(list(zip(rows, found, strict=True))):
        late, base = 5 if fault == "truncated" else 0, {}
        for s in range(4):
            ways = [(after[s][0] + 2, "D" + after[s][1], after[s][2])]
            if fault not in ("blank", "duplicate"):
                for cost, letter, to, line in [(0, "K", moves.get((s, role[:1])), f"{role}:{text}"), (1, "R", nxt[s], f"{give[s]}:{text}")]:
                    if to is not None:
                        ways.append((after[to][0] + cost + late, letter + after[to][1], (line, *after[to][2])))
            base[s] = min(ways)
        after = {}
        for s in range(4):
            a, b = nxt[s], nxt[nxt[s]]
            after[s] = min(base[s], (base[a][0] + 5, "I" + base[a][1], (f"{give[s]}:", *base[a][2])),
                           (base[b][0] + 10, "II" + base[b][1], (f"{give[s]}:", f"{give[a]}:", *base[b][2])))
    return after[0][0], after[0][1], hashlib.sha256("\n".join(after[0][2]).encode()).hexdigest()


def test_long_conversations_in_small_blocks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(structure, "BLOCK", 7)
    draw = random.Random(3)
    convs = {c: [(INITIALS[draw.choice("suuaat")], draw.choice(["One.", "cut", "", f"Own {k}.", f"open {k}"])) for k in range(n)]
             for c, n in ((1, 900), (2, 1), (3, 340))}
    rows = [(c, k, *row) for c, found in convs.items() for k, row in enumerate(found)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in digests(repair(frame)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == {c: plain(found) for c, found in convs.items()}


def test_one_repeated_row_and_edges(spark):
    rows = [(None, None, None, None), (1, 5, "user", "Same."), *[(2, 1, "user", "Same.")] * 500, (2, 2, "assistant", "Yes."),
            (3, None, "user", "First."), (3, 9, "assistant", "Last."), (3, 4, "assistant", "x" * 200_000 + "."), (4, 1, "system", "Alone."),
            (5, 1, "", "No role."), (5, 2, "User", "Upper."), (6, 1, "user", " "), (6, 2, "user", "")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, edit string, fault int")
    edited = repair(frame)
    assert edited.columns == ["conv_id", "turn", "old_role", "role", "text", "fault", "edit"]
    got = {r.conv_id: r for r in digests(edited).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[None].blank, got[None].audit, got[None].gaps, got[None].repaired_sha256) == (1, "D", 0, empty)
    assert (got[1].cost, got[1].audit) == (2, "D")
    assert (got[2].duplicate, got[2].cost, got[2].illegal) == (499, 998, 499)
    assert got[2].audit == "K" + "D" * 499 + "K"
    assert (got[3].gaps, got[3].audit, got[3].cost, got[3].illegal) == (4, "KDK", 2, 1)
    assert (got[4].audit, got[4].repaired_sha256) == ("D", empty)
    assert (got[5].audit, got[5].cost, got[5].illegal) == ("RR", 2, 1)
    assert (got[6].blank, got[6].audit, got[6].illegal) == (2, "DD", 1)
    assert digests(repair(frame.limit(0))).count() == 0


def test_repair_gives_rows(spark):
    frame = spark.createDataFrame([(1, 0, "system", "Be."), (1, 1, "user", "Hi."), (1, 2, "user", "More?"), (1, 3, "assistant", "So.")],
                                  "conv_id long, turn long, role string, text string")
    got = [tuple(r)[1:] for r in repair(frame).collect()]
    assert got == [(0, "system", "system", "Be.", "", "K"), (1, "user", None, "Hi.", "", "D"),
                   (2, "user", "user", "More?", "", "K"), (3, "assistant", "assistant", "So.", "", "K")]


@pytest.mark.parametrize("name", ["op11_structure"])
def test_query_keeps_every_conversation(spark, name):
    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {r.conv_id: r for r in queries.queries()[name](spark, sf).collect()}
    by_conv = {}
    for r in sorted((r for r in damage(turns).collect()), key=lambda r: (r.conv_id, r.turn)):
        by_conv.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == {r.conv_id for r in turns.select("conv_id").distinct().collect()}
    for conv, rows in by_conv.items():
        assert (got[conv].cost, got[conv].audit, got[conv].repaired_sha256) == plain(rows)
