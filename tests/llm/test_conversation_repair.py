"""Repairs against a shortest path over whole audits."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from sievework.llm import catalog, conversation_repair as repair

SF = "/root/testdata/sf0.1"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
BLANKS = " \t\n\x0b\x0c\r"


def shortest(rows):
    """(cost, audit) of rows (initial, fault), by the least pair for each place and state."""
    best = {"": (0, "")}

    def insert(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                to = NEXT[state]
                best[to] = min(best.get(to, (cost + 3, audit + "I")), (cost + 3, audit + "I"))
        return best

    for initial, fault in rows:
        after = {}

        def put(state, cost, audit):
            after[state] = min(after.get(state, (cost, audit)), (cost, audit))

        for state, (cost, audit) in insert(best).items():
            put(state, cost + 4, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if initial == NEXT[state] or (initial == "s" and state == ""):
                put(initial, cost + more, audit + "K")
            put(NEXT[state], cost + more + 3, audit + "R")
        best = after
    best = insert(best)
    return min(best[s] for s in ("", "a") if s in best)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(key.encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def whole(rows, damaging=True):
    """The contract's row of every conversation."""
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in damage(rows) if damaging else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        convs[r[0]].append(r)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, found = set(), []
        for _, _, role, text in turns:
            end = text.rstrip(BLANKS)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            found.append((role[:1], fault))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit = shortest(found)
        lines, state, rest = [], "", iter(turns)
        for edit in audit:
            _, _, role, text = (None, None, "", "") if edit == "I" else next(rest)
            if edit == "D":
                continue
            state = role[0] if edit == "K" else NEXT[state]
            if edit != "K":
                role = {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{text}")
        count = [sum(f == k for _, f in found) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


@pytest.mark.parametrize("block", [1, 2, 4])
def test_tables_against_shortest_path(block):
    tables = repair.Tables(block)
    names = {0: ("s", None), 1: ("s", "truncated"), 2: ("u", None), 3: ("u", "truncated"), 4: ("a", None), 5: ("a", "truncated"), 6: ("x", None), 7: ("x", "truncated"), 8: ("x", "blank")}
    short = [list(k) for n in range(5) for k in itertools.product(range(9), repeat=n)] if block == 4 else []
    rng = random.Random(block)
    long = [rng.choices(range(9), weights=[1, 1, 4, 2, 4, 2, 1, 1, 2], k=rng.randint(5, 60)) for _ in range(400)]
    for kinds in short + long:
        assert tables.repair(np.array(kinds, dtype=np.int64)) == shortest([names[k] for k in kinds]), kinds


def test_query_on_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = whole(rows)
    out = catalog.op13(spark, SF).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out}
    assert len(out) == len(got) and got == {c: w[:-1] for c, w in want.items()}
    assert sum(w[1] for w in want.values()) > 100 and {k for w in want.values() for k in w[6]} == set("DIKR")


def awkward():
    rng = random.Random(3)
    texts = [None, "", " \n", "One.", "Two!", "three", "One. ", "Four?\x0b", "…", "x" * 5000 + ".", "é."]
    roles = ["user", "assistant", "system", "tool", "", None, "usr", "User", "agent"]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    rows += [(100, None, "user", "One."), (100, None, "assistant", "One."), (101, -5, "system", "Two!"), (101, 7, "system", "Two!")]
    rows += [(102, 3, "user", "a.")] * 7 + [(103, k, "user" if k % 2 else "assistant", f"{k}.") for k in range(400)]
    rows += [(104, -(2**63), "user", "a."), (104, 2**63 - 1, "assistant", "b.")]
    return rows


def test_awkward_conversations(spark):
    rows = awkward()
    full = [(c, t, r, x, 1, "y", "z") for c, t, r, x in rows]
    df = spark.createDataFrame(full, "conv_id long, turn long, role string, text string, audit int, digest string, `a.b` string").repartition(5)
    want = whole(rows, damaging=False)
    found = repair.audits(df).cache()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in found.collect()}
    expected = {c: w[:7] for c, w in want.items()}
    # 2 ** 64 numbers between two turns are beyond a long.
    expected[104] = (None, *expected[104][1:])
    assert got == expected
    assert {r.conv_id: r.repaired_sha256 for r in repair.digests(df, found).collect()} == {c: w[7] for c, w in want.items()}
    lines = {}
    for r in sorted(repair.repaired(df, found).collect(), key=lambda r: r.position):
        assert r.position == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {c: w[8] for c, w in want.items() if w[8]}
    found.unpersist()


def test_query_with_dropped_and_missing(spark, tmp_path):
    gone = [k for k in range(400) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:3]
    rows = awkward() + [(1000 + k, 0, "user", "a.") for k in range(30)] + [(k, 0, "user", "Hello.") for k in gone if k > 110]
    rows = [r for r in rows if r[0] != 104]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in catalog.op13(spark, str(tmp_path)).collect()}
    want = {c: w[:-1] for c, w in whole(rows).items()}
    assert got == want and any(w[6] == "" and w[5] == 0 for w in want.values())


def test_hot_conversation_and_empty_table(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k % 50}{'.' if k % 7 else ''}") for k in range(3000)] + [(2, k, "user", "b.") for k in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    found = repair.audits(df)
    got = {r.conv_id: (r.cost, r.audit) for r in found.collect()}
    want = whole(rows, damaging=False)
    assert got == {c: w[5:7] for c, w in want.items()}
    assert {r.conv_id: r.repaired_sha256 for r in repair.digests(df, found).collect()} == {c: w[7] for c, w in want.items()}
    none = df.limit(0)
    assert repair.audits(none).count() == 0 and repair.repaired(none, repair.audits(none)).count() == 0
