"""Conversation repair: the interval parse against full CYK and enumeration, the query against SQL on hostile tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import brute
import duckdb
import pytest

from logmix.llm import conversation_repair as cr
from logmix.llm.oracles import ORACLES
from logmix.llm.queries import QUERIES

NAME = "op13_conversation_repair"
KINDS = [(i, f) for i in ("s", "u", "a", "n", "") for f in (cr.FINE, cr.BLANK, cr.DUPLICATE, cr.CUT)]


def parsed(turns):
    parse = cr.Parse()
    for initial, fault in turns:
        parse.add(initial, fault)
    return parse.best()


def full_cyk(turns):
    """All intervals, bottom-up by length, over all splits."""
    n = len(turns)
    cells = {(i, 1): cr.leaf(*t) for i, t in enumerate(turns)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell = {}
            for cut in range(1, length):
                for symbol, made in cr.combine(cells[i, cut], cells[i + cut, length - cut]).items():
                    cell[symbol] = min(made, cell.get(symbol, made))
            cells[i, length] = cell
    whole = cells[0, n]
    return min(whole[cr.START, end] for end in cr.ENDS if (cr.START, end) in whole)


def enumerated(turns):
    """All ways to edit a few turns, with up to two insertions in each gap."""
    gaps = [("", 0, "")] + [(r, 5 * len(r), "I" * len(r)) for r in ("u", "a", "ua", "au")]
    best = None
    ways = []
    for initial, fault in turns:
        own = [("", 2, "D")]
        if fault not in (cr.BLANK, cr.DUPLICATE):
            more = 5 if fault == cr.CUT else 0
            own += [(initial or "?", more, "K"), ("u", 1 + more, "R"), ("a", 1 + more, "R")]
        ways.append(own)
    for inner in itertools.product(*ways):
        for between in itertools.product(gaps, repeat=len(turns) + 1):
            steps = [between[0]]
            for step, gap in zip(inner, between[1:]):
                steps += [step, gap]
            if re.fullmatch("(s?(ua)+)?", "".join(s[0] for s in steps)):
                made = (sum(s[1] for s in steps), "".join(s[2] for s in steps))
                best = made if best is None else min(best, made)
    return best


def test_equals_enumeration():
    draw = random.Random(3)
    for turns in [[], *[[k] for k in KINDS], *[[draw.choice(KINDS) for _ in range(2)] for _ in range(60)]]:
        assert parsed(turns) == enumerated(turns), turns
    for _ in range(3):
        turns = [draw.choice(KINDS) for _ in range(3)]
        assert parsed(turns) == enumerated(turns), turns


def test_equals_full_cyk():
    draw = random.Random(4)
    for n in (1, 2, 3, 5, 8, 13, 21):
        for _ in range(15):
            turns = [draw.choice(KINDS) for _ in range(n)]
            assert parsed(turns) == full_cyk(turns)


def test_long_conversations_take_few_cells():
    parse = cr.Parse()
    for i in range(20_000):
        parse.add("ua"[i % 2], cr.FINE)
        assert len(parse.spans) <= 15
    assert parse.best() == (0, "K" * 20_000)


def queried(spark, folder):
    frame = QUERIES[NAME](spark, folder)
    columns = sorted(frame.columns)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    result = base.execute(ORACLES[NAME])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    theirs = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    mine = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)
    return frame


@pytest.mark.parametrize("rows", ["hostile", "empty"])
def test_query_on_hostile_tables(spark, tmp_path, rows):
    assert (queried(spark, brute.write_tables(tmp_path, rows == "empty")).count() == 0) == (rows == "empty")


def test_query_on_given_tables(spark):
    queried(spark, "/root/testdata/sf0.001")


def test_many_rows_in_one_conversation(spark, tmp_path):
    """A third of all rows, with copies, ties and nulls, and a conversation that loses all its rows."""
    draw = random.Random(5)
    said = ["Yes.", "No", " ", "", "Why?\n", "x" * 20_000 + ".", None]
    roles = ["system", "user", "assistant", "", "tool", None]
    rows = [(7, draw.choice([None, *range(60)]), draw.choice(roles), draw.choice(said)) for _ in range(120)]
    rows += [(c, t, draw.choice(roles), draw.choice(said)) for c in range(8, 60) for t in range(draw.randrange(1, 5))]
    brute._write(tmp_path, "conversations", brute.conversations(rows))
    queried(spark, str(tmp_path))


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, "assistant", "only.")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int")
    turns = cr.with_faults(turns)
    reports = cr.parse(turns)
    left = [tuple(r) for r in cr.repaired(turns, reports).orderBy("conv_id", "place").collect()]
    assert left == [(1, 0, "K", "user", "b."), (1, 1, "K", "assistant", "c.")]
    digest = {r.conv_id: r.repaired_sha256 for r in cr.digests(turns, reports).collect()}
    assert digest == {1: hashlib.sha256(b"user:b.\nassistant:c.").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
