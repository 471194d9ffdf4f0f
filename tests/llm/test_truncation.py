import random

import numpy as np

from ledgerlens.llm import truncation as T

SAYS = ["The finance committee asked {n} to {v} before Q{q} FY2{y}.", "{m} at {n} fell to {x} EUR in Q{q} FY2{y}, against {x} kt in the budget.", "We will {v}, and the {w} will review {m} again in H{h} 202{y}.", "If {n} does not {v}, {m} could miss the target by {x}%."]
CHOICES = {"n": ["Orrivik", "Velgadal", "Sassenor", "Zortara", "Pelmora", "Drabrivik"], "v": ["cut contractor hours", "freeze new hiring", "close the open audit points", "raise the list price"], "m": ["net debt", "rent", "working capital", "gross margin"], "w": ["treasurer", "controller", "plant manager"]}


def sentence(rng):
    pick = {k: rng.choice(v) for k, v in CHOICES.items()}
    s = rng.choice(SAYS).format(**pick, q=rng.randrange(1, 5), y=rng.randrange(10), h=rng.randrange(1, 3), x=rng.choice(["12.5", "1,204", "77", "930 112"]))
    return s[0].upper() + s[1:]


def corpus(n=1500, seed=8):
    rng, rows, cut = random.Random(seed), [], set()
    for i in range(n):
        style = rng.random()
        if style < 0.6:
            text = " ".join(sentence(rng) for _ in range(rng.randrange(4, 12)))
            if rng.random() < 0.2:
                text += f"\n\nRef {rng.randrange(9999)}-{rng.choice(CHOICES['n'])}"
        elif style < 0.8:
            text = "\n".join(sentence(rng).lower().rstrip(".") for _ in range(rng.randrange(4, 10)))
        else:
            text = "\n".join(f"| {rng.choice(CHOICES['m'])} {rng.choice(CHOICES['n'])} | {rng.randrange(999)} | {rng.randrange(999)} |" for _ in range(rng.randrange(4, 10)))
        source = rng.choice(["free", "limited"])
        if source == "limited" and len(text) > 400:
            text = text[:400]
            if text[-1] not in ".|":
                cut.add(i)
        elif rng.random() < 0.05:
            k = rng.randrange(len(text) // 2, len(text) - 5)
            if text[k - 1].isalpha() and text[k].isalpha():
                text = text[:k] + rng.choice(["", "…", " [...]", "�", "  "])
                cut.add(i)
        rows.append((i, text, rng.choice(["en", "EN", None, "xx1"]), source))
    return rows, cut


SCHEMA = "doc_id long, text string, lang string, source string"


def test_precision_and_recall(spark):
    rows, cut = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", odds string")
    found = T.truncated(df)
    got = {r.doc_id for r in found.filter("is_cut").collect()}
    assert len(cut) > 100 and len(got & cut) >= 0.95 * len(cut) and len(got & cut) >= 0.95 * len(got)
    per = {r.source: (r.documents, r.cut) for r in T.truncation_by_source(df, found).collect()}
    assert sum(n for n, _ in per.values()) == len(rows) and sum(c for _, c in per.values()) == len(got)


def test_odd_rows(spark):
    rows = [(1, None, "en", "a"), (2, " \n", "en", "a"), (3, "Word.", None, None), (None, "No key.", "en", "a"), (4, "…", "en", "a"), (5, "A sentence that ends. " * 3000, "en", "b"), (6, "Word.", "de", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id for r in T.truncated(df).collect()}
    assert got == {3, 5, 6}
    n = {r.source: r.documents for r in T.truncation_by_source(df, T.truncated(df)).collect()}
    assert n == {"a": 4, "b": 1, None: 2}
    assert T.truncated(df.limit(0)).count() == 0


def test_marks():
    ends = {"we will…": ("we will", T.ELLIPSIS), "we will [truncated]": ("we will", T.BRACKET), "so b&am": ("so b", T.BRACKET), "no�": ("no", T.BROKEN), "end. ": ("end.", T.SPACE), "end.\n\n": ("end.", T.LINES), "end.": ("end.", T.NONE), "wait [...]": ("wait", T.BRACKET)}
    assert {t: T.bare_end(t) for t in ends} == ends


def test_last_rows():
    table = "| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |"
    assert T.last_row(table) == T.CLOSED_ROW and T.last_row(table[:-4]) == T.SHORT_ROW
    assert T.last_row("a;1;2\nb;3;4\nc;5;6") == T.EVEN_ROW and T.last_row("a;1;2\nb;3;4\nc;5") == T.SHORT_ROW
    assert T.last_row("one\ntwo") == T.NO_TABLE and T.last_row("- a;\n- b;\n- c;") == T.NO_TABLE


def test_lines_broken_by_width_are_joined():
    wrapped = "a sentence that is broken where the line is\nfull and goes on for a while until it then\nends."
    assert T.unwrapped(wrapped) == wrapped.replace("\n", " ") and T.unwrapped("short\nlines\nstay") == "short\nlines\nstay"


def test_contexts_do_not_depend_on_what_stands_before():
    a, b = "Together Orrivik and Zortara account for rent.", "Other text before it, quite another one.\n\nTogether Orrivik and Zortara account for rent."
    one, other = T.contexts(T._BREAK + a), T.contexts(T._BREAK + b)
    last = [np.array([len(c[0]) - 1]) for c in (one, other)]
    x, y = ([int(c[1](k, at)[0]) for k in range(T.LEVELS)] for c, at in zip((one, other), last))
    assert x == y and len(set(x)) == T.LEVELS


def test_rounds_go_on_until_no_text_changes_sides(spark, monkeypatch):
    """The first four weighings put every text on alternate sides; the result is that of the undisturbed ones after them."""
    rows, _ = corpus(200)
    df = spark.createDataFrame(rows, SCHEMA)
    expected = {r.doc_id for r in T.truncated(df).filter("is_cut").collect()}
    weights, calls = T._weights, []

    def disturbed(cells):
        base, tables = weights(cells)
        calls.append(1)
        if len(calls) <= 4:
            base = {lang: 90.0 if len(calls) % 2 else -90.0 for lang in base}
        return base, tables

    monkeypatch.setattr(T, "_weights", disturbed)
    got = {r.doc_id for r in T.truncated(df).filter("is_cut").collect()}
    assert len(calls) >= 6 and got == expected


def test_bounds_forced_low_change_nothing(spark, monkeypatch):
    rows, _ = corpus(300)
    df = spark.createDataFrame(rows, SCHEMA)
    found = lambda: {r.doc_id: (round(r.odds, 9), r.is_cut) for r in T.truncated(df).collect()}
    whole = found()
    monkeypatch.setattr(T, "LEAST_BITS", 17)
    monkeypatch.setattr(T, "MOST_BITS", 17)  # most bits are set: others are counted too
    monkeypatch.setattr(T, "HOT", 3)
    assert found() == whole


def test_map_has_the_bits_of_all_contexts(spark):
    h = np.random.default_rng(3).integers(1 << 20, 1 << 62, 5000)
    bits = np.unpackbits(T.context_map(spark.createDataFrame([(int(x),) for x in h], "h long"), 20), bitorder="little")
    assert set(np.flatnonzero(bits)) == set((h >> 43).tolist())


def test_ends_of_texts():
    words = " ".join(f"w{i}" for i in range(100))
    assert T.text_end("short text") == "short text"
    assert T.text_end(words).split() == words.split()[-T.TAIL_WORDS :]
    lines = "\n".join(" ".join(f"word{i}{k}" for k in range(8)) for i in range(700))  # a last block longer than any window
    for text in (lines, words + "\n\n" + lines, lines + "\n \n" + words, "x" * 9000 + "\n\nend of it"):
        whole = T.unwrapped(text)
        assert whole.endswith(T.text_end(text).strip()) and len(T.text_end(text).split()) == min(len(text.split()), T.TAIL_WORDS)
