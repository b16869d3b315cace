import hashlib
import itertools
import random
import re
import zlib

import pytest

from tessera.llm import conversation_repair as C
from tessera.llm.util import table

SCHEMA = "conv_id long, turn long, role string, text string, _g string, audit int"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def blank(text):
    return not re.search(r"[^\x20\x09-\x0D]", text)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if blank(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif text.strip(C.WHITE)[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("fine")
        seen.add((role, text))
    return out


def cheapest(initials, kinds):
    """(cost, audit) by dynamic programming over (row, state), strings and all; inserts relaxed until nothing changes."""
    def better(at, state, cost, audit):
        if state not in at or (cost, audit) < at[state]:
            at[state] = (cost, audit)

    def inserts(at):
        for _ in range(4):
            for state, (cost, audit) in list(at.items()):
                better(at, "a" if state == "u" else "u", cost + 5, audit + "I")

    at = {"": (0, "")}
    for initial, kind in zip(initials, kinds):
        inserts(at)
        after = {}
        for state, (cost, audit) in at.items():
            better(after, state, cost + 2, audit + "D")
            if kind in ("blank", "duplicate"):
                continue
            more = 5 if kind == "truncated" else 0
            wanted = "a" if state == "u" else "u"
            if initial == wanted or (initial == "s" and state == ""):
                better(after, initial, cost + more, audit + "K")
            better(after, wanted, cost + 1 + more, audit + "R")
        at = after
    inserts(at)
    return min(at[s] for s in ("", "a") if s in at)


def apply(rows, audit):
    out, state, left = [], "", list(rows)
    for edit in audit:
        wanted = "assistant" if state == "u" else "user"
        if edit == "I":
            out.append((wanted, ""))
        else:
            _, role, text = left.pop(0)
            if edit == "D":
                continue
            out.append((role if edit == "K" else wanted, text))
        state = out[-1][0][:1]
    assert not left
    return out


def damaged(rows):
    """[(conv, turn, role, text)] of [(conv, turn, role, text)]."""
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        elif hit == 2:
            text = re.sub("[.!?]", "", text)
        elif hit == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)


def judged(rows):
    """The contract's row for one conversation's rows [(turn, role, text)] in order."""
    kinds, initials = faults(rows), [r[1][:1] for r in rows]
    cost, audit = cheapest(initials, kinds)
    fixed = apply(rows, audit)
    assert LEGAL.match("".join(r[:1] for r, _ in fixed))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest


def brute(rows):
    by = {c: [] for c, *_ in rows}
    for conv, turn, role, text in damaged(rows):
        by[conv].append((turn, role, text))
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        yield conv, *(judged(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))


def agree(turns):
    got = [tuple(r) for r in C.repair(C.damage(turns), ids=turns).collect()]
    want = list(brute([(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]))
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    assert len({r[7] for r in agree(table(spark, f"/root/testdata/{sf}", "conversations"))}) > 5


def test_auction_against_dynamic_programming_for_every_short_sequence():
    letters = [(r, f) for r in range(4) for f in range(3)]
    for n in range(4):
        for seq in itertools.product(letters, repeat=n):
            codes = bytes(97 + 4 * r + f for r, f in seq)
            (edits, end), = C.traces(codes, C.ENDS, True, (0,))
            out = C.lattice(codes, C.ENDS, True)
            cost = C.auction(out, C.first_prices(codes, len(out)), 0)
            assert (cost, edits) == cheapest([C.ROLES[r] for r, _ in seq], [C.FAULTS[f] for _, f in seq]), seq
            assert end in (0, 3)


def test_dynamic_programming_against_every_edit_sequence():
    def every(initials, kinds):
        best = None
        for way in itertools.product(("D", "K", "Ru", "Ra"), repeat=len(initials)):
            for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(initials) + 1):
                roles, audit, cost = gaps[0], "I" * len(gaps[0]), 0
                for edit, initial, kind, gap in zip(way, initials, kinds, gaps[1:]):
                    if edit != "D" and kind in ("blank", "duplicate"):
                        break
                    roles += "" if edit == "D" else initial if edit == "K" else edit[1]
                    cost += 2 if edit == "D" else (edit != "K") + 5 * (kind == "truncated")
                    roles, audit = roles + gap, audit + edit[0] + "I" * len(gap)
                else:
                    if LEGAL.match(roles):
                        best = min(best or (999, ""), (cost + 5 * audit.count("I"), audit))
        return best

    rnd = random.Random(3)
    for _ in range(60):
        n = rnd.randrange(4)
        initials, kinds = [rnd.choice("suax") for _ in range(n)], [rnd.choice(("fine", "truncated", "blank")) for _ in range(n)]
        assert every(initials, kinds) == cheapest(initials, kinds)


def test_prices_start_below_every_arc_and_end_tight():
    rnd = random.Random(5)
    for _ in range(50):
        codes = bytes(97 + rnd.randrange(16) for _ in range(rnd.randrange(40)))
        out = C.lattice(codes, C.ENDS, True)
        price = C.first_prices(codes, len(out))
        assert all(price[i] <= cost + price[to] for i, arcs in enumerate(out) for _, cost, to in arcs)
        C.auction(out, price, 0)
        assert all(price[i] <= cost + price[to] for i, arcs in enumerate(out) for _, cost, to in arcs)


def test_long_conversations_over_many_blocks(spark):
    rnd = random.Random(11)
    rows = []
    for conv, n in enumerate((63, 64, 65, 128, 129, 700, 2000)):
        for turn in range(n):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool"]) if rnd.random() < .4 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn + rnd.randrange(2) * 3 * (turn == n - 1), role, rnd.choice([f"Text {turn}.", f"cut {turn}", "again.", " "] if rnd.random() < .5 else [f"Fine {turn}!"]), "x", 1))
    agree(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_nulls_empties_long_texts_clashing_names_and_lost_conversations(spark):
    gone = next(c for c in range(1000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes?"), (1, None, None, None), (1, 5, "system", "S."), (1, 9, "user", "Ünï." * 50_000),
            (2, 0, "", "x."), (2, 1, "Assistant", "x."), (2, 2, "user", "\x0b \t"), (gone, 0, "user", "x."), (3, 1, "user", "a.\n"), (3, 4, "user", "b")]
    agree(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))


def test_rows_of_one_turn_have_a_fixed_order(spark):
    rows = [(1, 0, "user", f"t{i % 30}.", "x", 1) for i in range(300)] + [(1, 0, "assistant", "t.", "x", 1)] * 200
    got = [[tuple(r) for r in C.repair(spark.createDataFrame(random.Random(s).sample(rows, len(rows)), SCHEMA).repartition(s + 1)).collect()] for s in range(2)]
    assert got[0] == got[1] and got[0][0][3] == 469


def test_repaired_turns_are_the_digest(spark):
    turns = table(spark, "/root/testdata/sf0.001", "conversations")
    spoiled = C.damage(turns)
    by = {}
    for r in sorted(C.repaired_turns(spoiled, ids=turns).collect()):
        assert r.place == len(by.setdefault(r.conv_id, []))
        by[r.conv_id].append(f"{r.role}:{r.text}")
    for r in C.repair(spoiled, ids=turns).collect():
        assert hashlib.sha256("\n".join(by.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damage(empty), ids=empty).count() == 0 and C.repaired_turns(empty).count() == 0
