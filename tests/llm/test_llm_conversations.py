"""Conversation repair against the plain rules, with long conversations cut into segments of few rows."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from graphloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, letters string, k1 string, pid int"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def hurt(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if part:
            out += [(conv, turn, "user" if part == 4 else role, "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text)] * (2 if part == 3 else 1)
    return out


def plain(rows):
    """The report of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        faults.append("blank" if BLANK.fullmatch(text) else "duplicate" if (role, text) in seen else "truncated" if text.strip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(at, after, inserted):
        """Least cost, audit and roles of the rest, after a role ('' at the start)."""
        ways = [(0, "", ())] if at == len(rows) and after in ("", "a") else []
        fits = lambda r: r == "s" and after == "" or r == "u" and after in ("", "s", "a") or r == "a" and after == "u"
        if inserted < 4:
            for new in ("user", "assistant"):
                if fits(new[0]):
                    c, a, r = best(at, new[0], inserted + 1)
                    ways.append((c + 3, "I" + a, ((new, ""), *r)))
        if at < len(rows):
            _, role, text = rows[at]
            c, a, r = best(at + 1, after, 0)
            ways.append((c + 4, "D" + a, r))
            more = 3 * (faults[at] == "truncated")
            if faults[at] in ("", "truncated"):
                for cost, letter, new in ((0, "K", role), (3, "R", "user"), (3, "R", "assistant")):
                    if fits(new[:1]):
                        c, a, r = best(at + 1, new[0], 0)
                        ways.append((c + cost + more, letter + a, ((new, text), *r)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, repaired = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    count = Counter(faults)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()


def wanted(rows, ids=()):
    of = {i: [] for i in ids}
    for conv, turn, role, text, *_ in rows:
        of.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return sorted(((k, *plain(v)) for k, v in of.items()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    said = ["Well.", "What?", "No", "So be it!\n ", "", " \t", "É fini", "Done.\x1c", "a" * 300 + ".", None]
    out = []
    for conv in [*range(30), None]:
        for turn in range(rng.randrange(1, 9)):
            out.append((conv, rng.choice([turn, turn + 1, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "ärger"]), rng.choice(said), "x", "y", 1))
    out += [(40, t, ("user", "assistant")[t % 2], f"Turn {t % 17}{'.' * (t % 5 > 0)}", None, None, None) for t in range(150)]  # a long one
    out += [(41, 3, "user", "Same.", None, None, None)] * 60 + [(42, None, None, None, None, None, None)]
    return out + out[:3]


@pytest.mark.parametrize("most", [1, 4, 128])
def test_report(spark, rows, most):
    df = spark.createDataFrame(rows, SCHEMA)
    got = C.report(df, segment_rows=most)
    assert got.columns == ["conv_id", *C.REPORT]
    assert sorted(map(tuple, got.collect()), key=repr) == wanted(rows)


def test_damaged(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = C.damaged(df)
    assert Counter(map(tuple, found.collect())) == Counter(hurt(rows))
    got = C.report(found, conversations=df)
    assert sorted(map(tuple, got.collect()), key=repr) == wanted(hurt(rows), {r[0] for r in rows})


def test_repaired_rows_alternate(spark, rows):
    found = C.repaired_rows(spark.createDataFrame(rows, SCHEMA), segment_rows=4).collect()
    texts = {}
    for r in sorted(found, key=lambda r: (r.part, r.at)):
        texts.setdefault(r.conv_id, []).append(r.role)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in roles)) for roles in texts.values())
    assert len(texts) > 15


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.report(none).count() == 0 and C.repaired_rows(none).count() == 0
    ids = spark.createDataFrame([(1, 2, "user", "x", "", "", 1)], SCHEMA)
    assert [tuple(r) for r in C.report(none, conversations=ids).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_composition_equals_the_whole():
    rng = random.Random(7)
    for _ in range(300):
        letters = "".join(rng.choice(C.LETTERS) for _ in range(rng.randrange(1, 14)))
        cuts = sorted(rng.randrange(len(letters) + 1) for _ in range(3))
        parts = [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)], strict=True)]
        tables = [([x[0] if x else C.NEVER for way in C.solve(p) for x in way], [x[1] if x else None for way in C.solve(p) for x in way]) for p in parts]
        way = C.states([(cost, C.ranked(a)) for cost, a in tables], C.START, [(3 * len(x), len(x)) for x in C.ENDING])
        assert "".join(t[1][4 * a + b] for t, (a, b) in zip(tables, way, strict=True)) + C.ENDING[way[-1][1]] == C.ended(C.solve(letters))
        whole = functools.reduce(C.compose, [(cost, C.ranked(a)) for cost, a in tables])
        assert whole[0] == [x[0] if x else C.NEVER for row in C.solve(letters) for x in row]
