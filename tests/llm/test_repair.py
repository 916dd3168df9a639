"""Conversation repair: audits against a search over whole strings, the query against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duskboard.llm import queries, repair

SMALL = "/root/testdata/sf0.001"


def cheapest(rows):
    """(cost, audit, initials): rows are (initial, must go, unfinished). Keeps whole strings and tries all edits."""
    best = {"": (0, "", "")}  # by the last initial that stands: nothing, s, u, a

    def offer(some, cost, audit, made):
        if not re.fullmatch(r"(s|s?(ua)*u?)?", made):
            return
        state = made[-1:]
        if state not in some or (cost, audit) < some[state][:2]:
            some[state] = (cost, audit, made)

    def inserted(some):
        for _ in range(4):
            for cost, audit, made in list(some.values()):
                for x in "ua":
                    offer(some, cost + 2, audit + "I", made + x)
        return some

    best = inserted(best)
    for initial, gone, unfinished in rows:
        new = {}
        for cost, audit, made in best.values():
            offer(new, cost + 3, audit + "D", made)
            if not gone:
                offer(new, cost + unfinished, audit + "K", made + initial if initial in ("s", "u", "a") else "x")
                for x in "ua":
                    offer(new, cost + 2 + unfinished, audit + "R", made + x)
        best = inserted(new)
    return min(v for v in best.values() if re.fullmatch(r"(s?(ua)+)?", v[2]))


ROWS = st.lists(st.tuples(st.sampled_from("suax "), st.booleans(), st.booleans()), max_size=14)


@given(ROWS, st.sampled_from([1, 8, 1 << 14]))
@settings(max_examples=400, deadline=None)
def test_audits_are_cheapest_and_least(rows, nodes):
    auditor = repair.Auditor(nodes)
    for row in rows:
        auditor.row(*row)
    assert auditor.result() == cheapest(rows)[:2]


def test_long_conversations_stay_small():
    rng = random.Random(3)
    rows = [(rng.choice("uaas"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(5000)]
    small, large = repair.Auditor(64), repair.Auditor(1 << 20)
    for row in rows:
        small.row(*row)
        large.row(*row)
    assert small.result() == large.result() and len(small.prefixes) < 300 and sum(map(len, small.decided)) > 4000


@given(st.text("DIKR", max_size=40), st.text("DIKR", max_size=40))
def test_prefixes_compare_like_strings(a, b):
    shared = repair.Prefixes()
    ends = []
    for text in (a, b):
        node = 0
        for symbol in text:
            node = shared.extend(node, symbol)
        ends.append(node)
    assert shared.less(*ends) == (a < b) and shared.text(ends[0]) == a
    common = len(next((p for n in range(len(a), -1, -1) if b.startswith(p := a[:n])), ""))
    assert shared.depth[shared.shared(*ends)] == common


def wanted(turns):
    """The query's rows by plain Python; turns are (conv_id, turn, role, text)."""
    out = []
    shown = lambda v: " " if v is None else str(v)
    for conv, own in groupby(sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)), key=lambda r: r[0]):
        rows = []
        for _, turn, role, text in own:
            role, text = shown(role), shown(text)
            kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        faults = []
        for i, (_, role, text) in enumerate(rows):
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            again = (role, text) in [(r, t) for _, r, t in rows[:i]]
            faults.append("blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in ".!?" else "")
        cost, audit, made = cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)])
        names, left, repaired = {"u": "user", "a": "assistant"}, iter(rows), []
        for edit in audit:
            row = None if edit == "I" else next(left)
            if edit != "D":
                role = row[1] if edit == "K" else names[made[len(repaired)]]
                repaired.append(f"{role}:{row[2] if row else ''}")
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(spark, folder):
    return sorted((tuple(r) for r in queries.op12_audit_repair(spark, folder).select(COLUMNS).collect()), key=str)


def test_all_conversations(spark, con):
    turns = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    assert found(spark, SMALL) == sorted(wanted(turns), key=str)


def test_hard_conversations(spark, tmp_path):
    rng = random.Random(8)
    texts = ["Yes.", "No", "", None, " \n", "Why? ", "Long " * 20_000 + ".", "é\x0b", "a:b\nuser:c."]
    turns = [(conv, turn, rng.choice(["user", "assistant", "system", None, "", "tool", "ukulele"]), rng.choice(texts)) for conv in [*range(40), None, -5] for turn in rng.sample([None, *range(-3, 12)], rng.randint(1, 9))]
    turns += [(99, None, None, None), (100, 7, "user", "Twice."), (100, 7, "user", "Twice."), (100, 8, "assistant", "x.")]
    df = spark.createDataFrame([(*t, "other", 1) for t in turns], "conv_id long, turn long, role string, text string, audit string, dropped int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(spark, str(tmp_path)) == sorted(wanted(turns), key=str)
    empty = spark.createDataFrame([], df.schema)
    empty.write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert found(spark, f"{tmp_path}/none") == []


@pytest.mark.parametrize(("rows", "audit"), [
    ([], ""), ([(1, "assistant", "Hi.")], "D"), ([(1, "user", "Hi."), (2, "assistant", "Ho.")], "KK"),
    ([(1, "system", "Be."), (2, "user", "Hi.")], "KKI"), ([(1, "user", "Hi."), (2, "user", "Ho.")], "KR"),
])
def test_repaired_rows(spark, rows, audit):
    turns = spark.createDataFrame([(5, *r) for r in rows], "conv_id long, turn long, role string, text string")
    audits = repair.audit_chats(turns)
    got = audits.collect()
    if not rows:
        assert not got
        return
    if audit == "D":  # inserting a user is cheaper than deleting
        audit = "IK"
    assert got[0]["audit"] == audit
    made = repair.apply_audits(turns, audits).orderBy("position").collect()
    assert [r["position"] for r in made] == list(range(len(made)))
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r["role"][:1] for r in made))
