import functools
import hashlib
import random
import zlib

import pytest

from tideline.llm import turns

WHITE = " \t\n\x0b\x0c\r"


def hurt(rows):
    """Damage row by row, in plain Python."""
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else x
        role, text = blank(role), blank(text)
        k = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        for _ in range(2 if k == 3 else 1):
            yield conv, turn, "user" if k == 4 else role, text


def brute(rows, damage=True):
    out = {}
    for r in rows:
        out.setdefault(r[0], [])
    for conv, turn, role, text in hurt(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        out[conv].append((turn is not None, turn or 0, role[:64], text[:64], role, text))
    found = []
    for conv, held in out.items():
        held.sort()
        dated, seen, faults = [r[1] for r in held if r[0]], set(), []
        for *_, role, text in held:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[4][:1] + b[4][:1] for a, b in zip(held, held[1:])]

        @functools.cache
        def best(i, s, inserted=0):
            """The least (cost, letters, roles) from row i on, when s has been written: nothing, system, user or assistant."""
            options = [(0, "", ())] if i == len(held) and s in ("", "a") else []  # noqa: B023
            want = "a" if s == "u" else "u"

            def more(cost, letter, role, i, s, k=0):
                c, letters, roles = best(i, s, k)
                options.append((c + cost, letter + letters, role + roles))  # noqa: B023

            if inserted < 2:
                more(5, "I", ((NAME[want], None),), i, want, inserted + 1)
            if i < len(held):  # noqa: B023
                more(2, "D", (), i + 1, s)
                if faults[i] not in ("blank", "duplicate"):  # noqa: B023
                    cut, initial = 5 * (faults[i] == "truncated"), held[i][4][:1]  # noqa: B023
                    if initial == want or initial == "s" and s == "":
                        more(cut, "K", ((held[i][4], i),), i + 1, initial)  # noqa: B023
                    more(cut + 1, "R", ((NAME[want], i),), i + 1, want)
            return min(options, default=(10**9, "", ()))

        # from the end, so that no call goes deep
        for i in range(len(held), -1, -1):
            for s in ("", "s", "u", "a"):
                best(i, s)
        cost, letters, roles = best(0, "")
        text = "\n".join(f"{role}:{'' if i is None else held[i][5]}" for role, i in roles)
        gaps = max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0
        found.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found, key=repr)


NAME = {"u": "user", "a": "assistant"}


def conversations(n=150, seed=1):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 13))):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"])
            text = rng.choice(["Yes.", "No", "é!", " ", "\t\n", None, "", "long " * 30 + rng.choice("abc"), f"t{rng.randint(0, 5)}.", "Done? \n"])
            rows.append((c if c else None, rng.choice([None, *range(12)]), role, text))
    rows += [(500, None, "user", "a."), (500, None, "user", "a."), (501, 2**62, "user", "x."), (501, -(2**62), "user", "y.")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "k") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, copies int, kind string")


def got(df, **how):
    return sorted(map(tuple, turns.report(df, **how).collect()), key=repr)


@pytest.mark.parametrize("damage", [True, False])
def test_repair_equals_brute_force(spark, damage):
    rows = conversations()
    assert got(table(spark, rows).repartition(5), hurt=damage) == brute(rows, damage)


def test_a_conversation_over_many_ranges(spark):
    """One conversation holds most rows; its segments are solved apart."""
    rng = random.Random(7)
    rows = [(9, i // 2, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["Same.", f"cut {i}", f"Whole {i}.", ""])) for i in range(1200)] + conversations(20, 3)
    settings = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = turns.solved(turns.damage(turns.standard(table(spark, rows))))
        assert found.filter("conv = 9 AND kind = 'audit'").count() > 4
        assert got(table(spark, rows)) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_runs_advance_by_powers():
    for symbol in ("u-", "at", "s-", "x-", "d"):
        m = turns.IDENTITY
        for n in range(1, 40):
            m = turns._times(m, turns.power(symbol, 0))
            assert turns.advance(turns.IDENTITY, symbol, n) == m


def test_many_copies_and_long_texts(spark):
    rows = [(1, 5, "user", "again.")] * 3000 + [(1, 6, "assistant", "z" * 3_000_000 + ".")] + [(2, 1, "user", "x" * 1_000_000)]
    assert got(table(spark, rows), hurt=False) == brute_light(rows)


def brute_light(rows):
    one = "user:again.\nassistant:" + "z" * 3_000_000 + "."
    return [(1, 0, 0, 2999, 0, 2999, 5998, "K" + "D" * 2999 + "K", hashlib.sha256(one.encode()).hexdigest()), (2, 0, 0, 0, 1, 0, 2, "D", hashlib.sha256().hexdigest())]


def test_repaired_rows_alternate(spark):
    rows = turns.damage(turns.standard(table(spark, conversations(40, 5))))
    by = {}
    for r in turns.repaired(rows, turns.solved(rows)).orderBy("conv", "at").collect():
        by.setdefault(r.conv, []).append(r.role[:1])
        assert r.letter != "I" or r.text == ""
    for initials in by.values():
        assert "".join(initials).removeprefix("s").replace("ua", "") == ""


def test_empty_table(spark):
    assert got(table(spark, [(1, 1, "user", "a.")]).limit(0)) == []
