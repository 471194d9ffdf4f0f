import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm import lines
from ledgerlens.llm.lines import LineLedger, repeated_lines, without_lines


def form(line):
    x = re.sub("[ \t\r ]+", " ", re.sub("[0-9]", "", line)).strip(" ").lower()
    return x if any(c.isalpha() for c in x) else None


def brute(rows, least=5, share=0.2):
    one = {}
    for i, t, f, _ in rows:
        if i is not None and f is not None:
            one.setdefault(i, (t or "", f))
    totals, counts = Counter(f for _, f in one.values()), Counter()
    for t, f in one.values():
        for x in {form(y) for y in t.split("\n")} - {None}:
            counts[f, x] += 1
    return {(i, k + 1) for i, (t, f) in one.items() for k, y in enumerate(t.split("\n")) if (x := form(y)) and counts[f, x] >= least and counts[f, x] >= share * totals[f]}


def corpus(n=80, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        f = f"file{i % 3}"
        lines = [f"own line {chr(97 + i % 26)}{rng.random()}"]
        lines += rng.sample([f"Page {i}", "  Legal   NOTICE\t2024 ", "seldom seen" if i % 9 == 0 else "x", "", "12 34", "copied", "copied"], 5)
        rows.append((f"c{i}", "\r\n".join(lines) if i % 2 else "\n".join(lines), f, None))
    return rows + [("n1", None, "file0", None), ("n2", None, "file0", None), ("c1", rows[1][1], "file1", None), (None, "Page 1", "file0", None), ("q", "Page 1", None, None)]


def test_like_brute_force(chunks_of, monkeypatch):
    rows = corpus()
    got = {tuple(r) for r in repeated_lines(chunks_of(rows)).collect()}
    assert got and got == brute(rows)
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert {tuple(r) for r in repeated_lines(chunks_of(rows)).collect()} == got


def test_deltas_end_where_one_load_does(spark, chunks_of):
    rows = corpus(120)
    ledger, seen = LineLedger(spark), {}
    for part in (rows[:10], rows[10:60], rows[60:], rows[:5]):
        found = {}
        for r in ledger.update(chunks_of(part)).collect():
            found.setdefault(r.chunk_id, set()).add(r.line_no)
        stale = {r.chunk_id for r in ledger.stale.collect()} if hasattr(ledger, "stale") else set()
        new = {i for i, _, f, _ in part if i is not None and f is not None} - seen.keys()
        assert found.keys() <= new | stale  # nothing else is rebuilt
        for i in new | stale:
            seen[i] = found.get(i, set())
    got = {(i, n) for i, x in seen.items() for n in x}
    assert got == brute(rows) == {(r.chunk_id, r.line_no) for r in ledger.located().collect()}


def test_only_touched_buckets_are_rewritten(spark, chunks_of, monkeypatch):
    monkeypatch.setattr(lines, "MOST_LOADS", 2)
    rows = corpus(120)
    ledger = LineLedger(spark)
    ledger.update(chunks_of(rows))
    before = {name: dict(t) for name, t in ledger.tables.items()}
    more = [(f"n{i}", f"Page {i}\nown {i}", "file0", None) for i in range(6)]
    ledger.update(chunks_of(more))
    moved = {b for b, p in ledger.tables["counts"].items() if before["counts"].get(b) != p}
    assert len(moved) == 1 and len(ledger.tables["counts"]) > 1
    ledger.update(chunks_of([("last", "Page 1", "file1", None)]))  # and the loads become one
    assert len(ledger.loads) == 1
    assert {(r.chunk_id, r.line_no) for r in ledger.located().collect()} == brute([*rows, *more, ("last", "Page 1", "file1", None)])
    ledger.update(chunks_of(rows))  # all seen
    assert ledger.stale.count() == 0 and len(ledger.loads) == 1


def test_any_number_of_loads_ends_alike(spark, chunks_of):
    rows = corpus(90)
    df = chunks_of(rows)
    df = df.withColumn("metadata", F.col("metadata").withField("ingestion_timestamp", F.concat(F.lit("2024-0"), 1 + F.col("chunk_index") % 5)))
    parts = lines.by_month(df, 3)
    assert len(parts) == 3 and sum(p.count() for p in parts) == df.count() and all(p.count() for p in parts)
    for n in (1, 2, 3):
        assert {tuple(r) for r in repeated_lines(df, loads=n).collect()} == brute(rows)


def test_text_without_them(chunks_of):
    rows = [(f"c{i}", f"Notice {i}\nkept {chr(97 + i)}\n\nNOTICE", "f", None) for i in range(6)] + [("z", None, "f", None), ("y", "", "f", None)]
    df = chunks_of(rows)
    got = {r.chunk_id: (r.content, r.n_removed) for r in without_lines(df, repeated_lines(df)).collect()}
    assert got["c0"] == ("kept a\n", 2) and got["z"] == (None, 0) and got["y"] == ("", 0)


def test_nothing(chunks_of):
    assert repeated_lines(chunks_of([("a", "x", "f", None)]).limit(0)).count() == 0
