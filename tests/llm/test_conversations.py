"""Repair of conversations against all edits tried, and the ways that long ones take."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyman.llm import conversations, edit_paths
from tallyman.llm.conversations import repair_conversations
from tallyman.llm.edit_paths import Node, Piece, before, cheapest, common

FORM = re.compile(r"(s?(ua)+)?")


def every_repair(rows):
    """The least (cost, letters, roles) over all edits with up to three rows inserted."""
    best = {}

    def extend(i, cost, letters, initials, roles, inserted):
        if best and cost > min(best)[0]:
            return
        if i == len(rows) and FORM.fullmatch(initials):
            best[cost, letters] = roles
        if inserted < 3:
            for r in ("user", "assistant"):
                extend(i, cost + 5, letters + "I", initials + r[0], [*roles, (r, None)], inserted + 1)
        if i == len(rows):
            return
        role, must_go, late = rows[i]
        extend(i + 1, cost + 2, letters + "D", initials, roles, inserted)
        if not must_go:
            late = 5 if late else 0
            extend(i + 1, cost + late, letters + "K", initials + role[:1], [*roles, (role, i)], inserted)
            for r in ("user", "assistant"):
                extend(i + 1, cost + 1 + late, letters + "R", initials + r[0], [*roles, (r, i)], inserted)

    extend(0, 0, "", "", [], 0)
    least = min(best)
    return *least, best[least]


def some_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", ""]
    return [(rng.choices(roles, (5, 5, 2, 1, 1))[0], rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


def test_paths_are_the_cheapest_and_the_first_of_them():
    rng = random.Random(1)
    for trial in range(150):
        rows = some_rows(rng, rng.randrange(6))
        piece = Piece.of([(None, r[:1], gone, False, late and not gone) for r, gone, late in rows], (edit_paths.START,))
        cost, letters, _ = every_repair([(r, gone, late and not gone) for r, gone, late in rows])
        assert piece.repair() == (cost, letters), rows


def test_pieces_join_to_the_whole():
    rng = random.Random(2)
    for trial in range(60):
        rows = [(rng.choice([None, 0, 1, 2, 5]), r[:1], g, False, t and not g) for r, g, t in some_rows(rng, rng.randrange(14))]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        whole = Piece.of(rows)
        joined = Piece.of([])
        while rows:
            k = rng.randrange(1, 5)
            joined, rows = joined.joined(Piece.of(rows[:k])), rows[k:]
        assert joined == whole and joined.repair() == whole.repair()


def random_path(rng, n, root):
    node = root
    for _ in range(n):
        node = Node(node, rng.choice("DK"))
    return node


def test_order_of_paths_by_their_common_beginning(monkeypatch):
    rng = random.Random(3)
    for modulus in (edit_paths._MODULUS, 3):
        # With few hash values nearly all comparisons collide, and the letters decide.
        monkeypatch.setattr(edit_paths, "_MODULUS", modulus)
        root = Node()
        for trial in range(300):
            shared = random_path(rng, rng.randrange(40), root)
            a, b = (random_path(rng, rng.randrange(6), shared) for _ in range(2))
            x, y = a.path(), b.path()
            n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert common(a, b) == n
            assert before(a, b) == (x < y)


def plainly(rows):
    space = " \t\n\x0b\x0c\r"
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(name.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        held = convs.setdefault(conv, [])
        held += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for conv, held in convs.items():
        tie = lambda r: hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r)))
        seen, judged, counts = set(), [], [0, 0, 0]
        for _, role, text in held:
            bare = text.strip(space)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            judged.append((role, fault in (0, 1), fault == 2))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, letters = min(v for k, v in cheapest([(r[:1], g, t) for r, g, t in judged]).items() if k in (0, 3))
        lines, at, prior = [], 0, ""
        for c in letters:
            own = {"": "user", "s": "user", "u": "assistant", "a": "user"}[prior]
            if c == "I":
                role, text = own, ""
            else:
                role, text = (own if c == "R" else held[at][1]), held[at][2]
                at += 1
            if c != "D":
                lines.append(f"{role}:{text}")
                prior = role[:1] or prior
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, letters, digest))
    return sorted(out, key=repr)


def made_up(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None, -5]:
        for turn in range(rng.choice([1, 2, 6, 9])):
            turn = rng.choice([turn, turn, turn, None, turn + 30])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", "", " \n", None, "Ä! ", f"{conv} is it? {turn}", "Ok."])
            rows.append((conv, turn, role, text))
    long = [(1000, rng.choice([i // 2, None]), rng.choice(["user", "assistant"]), rng.choice(["Ok.", f"line {i}.", "no"])) for i in range(400)]
    long += [(1001, None, "user", "Same.")] * 90 + [(1002, 0, "system", "x " * 20_000)]
    # All rows of this one are dropped.
    dropped = next(c for c in range(2000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + long + [(dropped, 0, "user", "Hi.")] * 2


@pytest.mark.parametrize("most_rows,most_bytes", [(4096, 1 << 25), (16, 1 << 25), (7, 4000)])
def test_against_a_plain_version(spark, rows, monkeypatch, most_rows, most_bytes):
    monkeypatch.setattr(conversations, "MOST_ROWS", most_rows)
    monkeypatch.setattr(conversations, "MOST_BYTES", most_bytes)
    monkeypatch.setattr(conversations, "FAN", 4)
    data = made_up(4)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    for name in ("conv", "part", "at", "block", "rank", "audit", "fault", "dropped", "tie"):
        df = df.withColumn(name, F.lit("clash"))
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert rows(repair_conversations(df), *columns) == plainly(data)


def test_empty_and_undamaged(spark):
    df = spark.createDataFrame([(1, 0, "user", "A?"), (1, 1, "assistant", "B.")], "conv_id long, turn int, role string, text string")
    assert repair_conversations(df.limit(0)).count() == 0
    got = repair_conversations(df, damage=False).collect()
    assert [(r.cost, r.audit, r.repaired_sha256) for r in got] == [(0, "KK", hashlib.sha256(b"user:A?\nassistant:B.").hexdigest())]
