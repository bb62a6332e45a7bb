"""Conversation repair: matrices and rules by themselves, whole conversations against all edits and against a plain search."""

import hashlib
import itertools
import random
import zlib

import pytest

from claimspark.llm import conversations as c

SPACE = " \t\n\x0b\x0c\r"
MADE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.strip(SPACE)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def moves(state, role, fault):
    """(initial, state after, cost, row) of each edit of a row."""
    yield "D", state, 3, None
    if fault not in ("blank", "duplicate"):
        if (state, role[:1]) in AFTER:
            yield "K", AFTER[state, role[:1]], int(fault == "truncated"), "kept"
        yield "R", MADE[state][1], 2 + int(fault == "truncated"), MADE[state][0]


def cheapest(rows):
    """(cost, audit, repaired rows): all states after each row, with whole audits."""
    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for s, (cost, audit, made) in list(out.items()):
                to = MADE[s][1]
                new = (cost + 2, audit + "I", [*made, (MADE[s][0], "")])
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    states = {0: (0, "", [])}
    for (role, text), fault in zip(rows, faults(rows)):
        after = {}
        for s, (cost, audit, made) in inserted(states).items():
            for edit, to, more, what in moves(s, role, fault):
                new = (cost + more, audit + edit, made + ([] if what is None else [(role if what == "kept" else what, text)]))
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        states = after
    return min((v for s, v in inserted(states).items() if s in (0, 3)), key=lambda v: v[:2])


def all_edits(rows):
    """(cost, audit) over every sequence of edits with up to two insertions in one place."""
    found = []

    def go(i, state, cost, audit):
        for k in range(3):
            s, add = state, 0
            for _ in range(k):
                s, add = MADE[s][1], add + 2
            if i == len(rows):
                if s in (0, 3):
                    found.append((cost + add, audit + "I" * k))
            else:
                for edit, to, more, _ in moves(s, rows[i][0], marks[i]):
                    go(i + 1, to, cost + add + more, audit + "I" * k + edit)

    marks = faults(rows)
    go(0, 0, 0, "")
    return min(found)


ROLES, TEXTS = ["system", "user", "assistant", "user", "assistant", "tool", ""], ["Yes.", "No!", "and so", " ", "", "Why?\n", "Oh. ", "é漢😀", "ok\x85"]


def random_rows(r, n):
    return [(r.choice(ROLES), r.choice(TEXTS) + (str(r.randrange(40)) + "." if r.random() < 0.6 else "")) for _ in range(n)]


@pytest.mark.parametrize("seed", range(12))
def test_search_is_the_least_of_all_edits(seed):
    """The plain search that the rest is held against."""
    rows = random_rows(random.Random(seed), 4)
    assert cheapest(rows)[:2] == all_edits(rows)


def symbols(rows):
    return "".join(chr(97 + 4 * "sua-".index(role[:1] if role[:1] in ("s", "u", "a") else "-") + c.FAULTS.index(f)) for (role, _), f in zip(rows, faults(rows)))


@pytest.mark.parametrize("seed", range(6))
def test_rules_change_no_result(seed):
    r = random.Random(seed)
    rows = random_rows(r, 300)
    text = symbols(rows)
    rules = []
    for i in range(40):  # any rules will do
        now = c.Grammar(rules).rewritten(text)
        at = r.randrange(len(now) - 1)
        rules.append((now[at : at + 2], chr(0x100 + i)))
    want = cheapest(rows)
    for grammar in (c.Grammar([]), c.Grammar(rules)):
        fold = c.Fold(grammar)
        for at in range(0, 300, 70):
            fold.add(text[at : at + 70])
        assert fold.end() == want[:2]
    assert len(c.Grammar(rules).rewritten(text)) < len(text)


def expected(rows):
    """The contract's row of a conversation by (turn, role, text), undamaged."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    pairs, marks = [(role, text) for _, role, text in rows], faults([(role, text) for _, role, text in rows])
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, made = cheapest(pairs)
    illegal = sum((a[:1], b[:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for (a, _), (b, _) in itertools.pairwise(pairs))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[marks.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest())


@pytest.mark.parametrize("piece,span", [(1024, 500_000), (3, 40)])
def test_against_plain_search(spark, monkeypatch, piece, span):
    """Null and repeated conversations and turns, repeated rows, one conversation of a third of all rows, small pieces and ranges."""
    monkeypatch.setattr(c, "PIECE", piece)
    monkeypatch.setattr(c, "RANGE", span)
    r = random.Random(7)
    rows = []
    for conv in range(60):
        rows += [(conv, r.choice([i, i, i, i + 3, None]), role, text, 1) for i, (role, text) in enumerate(random_rows(r, r.randint(1, 9)))]
    rows += [(None, i, *x, 1) for i, x in enumerate(random_rows(r, 5))]
    rows += [(1000, i, *x, 1) for i, x in enumerate(random_rows(r, 400))]
    rows += [(1001, 3, "user", "Again.", 9), (1001, 3, "user", "Again.", 2), (1001, 4, "assistant", "x" * 200_000 + ".", 1), (1002, 1, "user", "gone", 0)]
    made = c.repair(spark.createDataFrame(rows, "conv long, turn long, role string, text string, times long").repartition(4))
    by_conv = {}
    for conv, turn, role, text, times in rows:
        by_conv.setdefault(conv, []).extend([(turn, role, text)] * times)
    assert made.columns == ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {row[0]: tuple(row)[1:] for row in made.collect()}
    assert found == {conv: expected(own) for conv, own in by_conv.items()}
    assert found[1002] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    def harmed(conv, turn, role, text):
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        return (conv, turn, "user" if n == 4 else role, "" if n == 1 else text.translate({ord(x): None for x in ".!?"}) if n == 2 else text, 0 if n == 0 else 2 if n == 3 else 1)

    rows = [(i % 20 or None, i // 20 or None, ["user", None, ""][i % 3], [None, "a.b!c?", ""][i % 7 % 3]) for i in range(400)]
    made = c.damaged(spark.createDataFrame(rows, "conv long, turn long, role string, text string"))
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(str(harmed(*r)) for r in rows)


def test_empty_table(spark):
    assert c.repair(spark.createDataFrame([], "conv string, turn long, role string, text string, times long")).count() == 0


def test_rules_are_learned_from_all_conversations(spark):
    pieces = spark.createDataFrame([("eieiei",)] * 50 + [("abab",)] * 3, "symbols string")
    rules = c.repair_pairs(pieces)
    assert rules[0] == ("ei", "Ā") and len(c.Grammar(rules).rewritten("eieiei")) == 1
