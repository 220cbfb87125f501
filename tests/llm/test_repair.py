"""Repair of conversations against SQL and a walk over states, turn by turn."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from util import assert_same

from barloom.llm import repair
from barloom.llm.queries import OP11_SQL, QUERIES

KIND = "conv_id LONG, turn LONG, role STRING, text STRING"


def best(rows):
    """Cheapest audit and repaired lines of rows (role, text, fault): shortest paths, state by state."""
    step, choose = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}

    def grown(at):
        for _ in range(3):
            for st, (cost, audit, lines) in list(at.items()):
                new = (cost + 5, audit + "I", (*lines, f"{name[choose[st]]}:"))
                at[choose[st]] = min(at.get(choose[st], new), new)
        return at

    at = grown({0: (0, "", ())})
    for role, text, fault in rows:
        to = defaultdict(list)
        for st, (cost, audit, lines) in at.items():
            to[st].append((cost + 2, audit + "D", lines))
            if fault not in ("b", "d"):
                more = 5 * (fault == "t")
                to[choose[st]].append((cost + 1 + more, audit + "R", (*lines, f"{name[choose[st]]}:{text}")))
                if (st, role[:1]) in step:
                    to[step[st, role[:1]]].append((cost + more, audit + "K", (*lines, f"{role}:{text}")))
        at = grown({st: min(v) for st, v in to.items()})
    return min(at[st] for st in (0, 3) if st in at)


def brute(rows):
    said = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, role = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text), "user" if kind == 4 else role
        said[c] += [(t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for c, own in said.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64], r[2][:64], hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, *x in own:
            end = re.findall(r"[^\x20\x09-\x0D]", x[1])[-1:]
            faults.append("b" if not end else "d" if tuple(x) in seen else "-" if end[0] in ".!?" else "t")
            seen.add(tuple(x))
        turns = {t for t, *_ in own} - {None}
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = best([(r, x, f) for (_, r, x), f in zip(own, faults)])
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_products_do_not_depend_on_grouping():
    dice = random.Random(3)
    for _ in range(200):
        kinds = "".join(dice.choices("suaoSUAOx", k=dice.randint(0, 40)))
        cut = dice.randint(0, len(kinds))
        whole = repair.reduced(kinds)
        assert repair.times(repair.reduced(kinds[:cut]), repair.reduced(kinds[cut:])) == whole
        roles = {"s": "system", "u": "user", "a": "assistant", "o": "other", "x": "user"}
        rows = [(roles[k.lower()], "b" if k == "x" else "x", "b" if k == "x" else "t" if k.isupper() else "-") for k in kinds]
        assert repair.cheapest(whole) == best(rows)[:2]


def test_query_equals_sql(spark):
    assert assert_same(QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.001"), OP11_SQL, "/root/testdata/sf0.001") > 0


@pytest.mark.parametrize(("turns", "chars", "fan"), [(1024, 1 << 20, 16), (3, 1 << 20, 2), (1, 1 << 20, 3), (50, 60, 2)])
def test_against_brute_force(spark, turns, chars, fan, monkeypatch):
    """Segments of all sizes; nulls, ties, repeated rows, odd roles, conversations that lose all turns, one of 700 turns and one that a copied row fills."""
    for name, n in (("SEGMENT_TURNS", turns), ("SEGMENT_CHARS", chars), ("FAN", fan)):
        monkeypatch.setattr(repair, name, n)
    dice = random.Random(turns)
    words = ["Yes.", "no", "", " \n", "Why?\t", "é!", None, "Long text " * 9 + "end", "Long text " * 9 + "fin.", "a. b! c?"]
    rows = [(c, dice.choice([None, *range(9)]), dice.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]), dice.choice(words)) for c in [*range(60), None] for _ in range(dice.choice([1, 2, 5, 9]))]
    rows += [(900, k, ("user", "assistant")[k % 2], f"{dice.choice(words)} {dice.randint(0, 200)}.") for k in range(700)] + [(901, 1, "user", "again and again.")] * 90 + rows[:15]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("own") for c in ("part", "no", "gone", "initial", "fault", "none", "conv", "_copy")}).repartition(4)
    assert got(repair.repair(repair.damaged(df))) == brute(rows)


def test_one_and_none(spark):
    for row in [(7, None, None, None), (None, None, "system", "Only."), *((c, 0, "user", "Gone?") for c in range(25))]:
        if row[0] in (None, 7, 0, 1) or zlib.crc32(f"{row[0]}:{row[1]}".encode()) % 20 == 0:
            assert got(repair.repair(repair.damaged(spark.createDataFrame([row], KIND)))) == brute([row]) | ({row[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())} if not brute([row]).get(row[0]) else {})
    assert repair.repair(repair.damaged(spark.createDataFrame([(7, None, None, None)], KIND).where("false"))).count() == 0
