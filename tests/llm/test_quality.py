import numpy as np

from ledgerlens.llm import quality as Q

PROSE = "The {3} committee asked the plant at {4} to {0} before Q{1} FY24. We will review the {3} again, and the year before it was {2} EUR. If the team of {4} does not {0}, cost could miss the target by {1}%."
NAMES = [a + b for a in ("Or", "Vel", "Sas", "Zor", "Pel", "Dra", "Gry") for b in ("rivik", "gadal", "senor", "tara", "mora", "bar")]
WORDS = {"en": ["the", "to", "of", "and", "it", "was", "will", "not", "by", "before", "in", "for", "that", "is"]}


def corpus():
    rng = np.random.default_rng(2)
    rows, kinds = [], {}

    def add(kind, text):
        i = f"{kind}{len(rows):04d}"
        rows.append((i, text, f"file{len(rows)}", None))
        kinds[i] = kind

    for k in range(60):
        say = [PROSE.format(rng.choice(["cut hours", "freeze hiring", "close the mill"]), rng.integers(1, 5), rng.integers(10, 999), rng.choice(["audit", "fuel", "wage", "port"]), rng.choice(NAMES)) for _ in range(rng.integers(2, 5))]
        add("prose", [" ".join(say), "\n".join(say), " ".join(say).upper(), "## Title\n\n" + "\n\n".join(say)][k % 4])
        items = [f"{rng.choice(['Rent', 'Net debt', 'Overtime'])} – {rng.choice(['North', 'South'])}" for _ in range(rng.integers(8, 16))]
        add("list", "\n".join(f"{['-', '*', f'{i}.'][k % 3]} {x}" for i, x in enumerate(items)))
        cell = lambda: f"{rng.integers(10, 9999)}.{rng.integers(10)}"
        sep = [" | ", ";", "\t"][k % 3]
        add("table", "\n".join((("| " if k % 3 == 0 else "") + sep.join([f"rent {j}", cell(), cell(), cell()])) for j in range(rng.integers(6, 12))))
        if k % 3 == 0:
            add("junk", " ".join("".join(rng.choice(list("]+*&'^`~{}<>%#|"), 4)) for _ in range(60)))
    return rows, kinds


def test_kinds(spark, chunks_of):
    rows, kinds = corpus()
    rows += [("short", "- a\n- b", "file1", None), ("null", None, "file1", None), ("blank", " \n", "file1", None), (None, "x " * 30, "file1", None), rows[0]]
    common = spark.createDataFrame([(k, w, i) for k, v in WORDS.items() for i, w in enumerate(v)] + [(None, None, 1)], "lang string, word string, word_rank int")
    got = {r.chunk_id: r for r in Q.text_quality(chunks_of(rows), common).collect()}
    assert set(got) == set(kinds) | {"short", "blank"} and got["short"].kind is None and got["blank"].n_words == 0
    prose = [i for i, k in kinds.items() if k == "prose"]
    rest = [i for i, k in kinds.items() if k != "prose"]
    assert np.mean([got[i].kind == "prose" for i in prose]) >= 0.95 and np.mean([got[i].kind != "prose" for i in rest]) >= 0.95
    assert all(abs(got[i].prose + got[i].list + got[i].table + got[i].junk - 1) < 1e-6 for i in kinds)


def test_classes_stay_when_files_are_left_out(spark, chunks_of):
    rows, kinds = corpus()
    common = spark.createDataFrame([(k, w, i) for k, v in WORDS.items() for i, w in enumerate(v)], "lang string, word string, word_rank int")
    classes = lambda part: {r.chunk_id: r.kind == "prose" for r in Q.text_quality(chunks_of(part), common).collect()}
    whole = classes(rows)
    for k in (0, 1):
        part = classes([r for i, r in enumerate(rows) if i % 10 != k])
        assert np.mean([whole[i] == x for i, x in part.items()]) >= 0.99


def test_statistics_by_hand(spark, chunks_of):
    common = spark.createDataFrame([("en", "the", 1), ("en", "of", 2), ("fr", "the", 1)], "lang string, word string, word_rank int")
    rows = [("a", "The end of it.\nNo (end)\n\n", "f", None), ("b", " ", None, None), ("c", None, "f", None), ("a", "The end of it.\nNo (end)\n\n", "f", None)]
    got = {r.chunk_id: tuple(r)[1:] for r in Q.text_statistics(chunks_of(rows), common).collect()}
    assert set(got) == {"a", "b"} and got["b"] == (0, 0.0, 0.0, 0.0, 0.0)
    assert np.allclose(got["a"], (6, 18 / 6, 3 / 18, 0.5, 2 / 6))


def lines_of(text):
    keys, flat = Q.line_facts(text, Q.WordFacts({"en": frozenset({"the"})}))
    return keys, np.array(flat, np.int32).reshape(len(keys), -1)


def test_wrapped_lines_are_one_unit():
    def units(lines):
        m = lines_of("\n".join(lines))[1]
        return Q.units(m[:, Q.FACTS.index("length")], m[:, Q.FACTS.index("first")], np.array([0])).tolist()

    wrapped = ["some words that fill the line up to here", "and then go on with yet other words that", "end at last."]
    assert units(wrapped) == [1] and units(["- a", "- b", "- c"]) == [3] and units(["alone"]) == [1]


def test_lines_and_segments():
    keys, m = lines_of("Page 12 of 30\n\npage 7 of 9\n12 34\n| a | b | c |\na  b  c  d e\n")
    assert keys[0] == keys[1] and keys[2] is None and len(keys) == 5
    shape, again = m[:, Q.FACTS.index("shape")], m[:, Q.FACTS.index("again")]
    assert shape[3] == Q.CELLS and shape[4] != Q.CELLS and again.sum() == 0
    shapes = np.array([Q.ITEM, Q.ITEM, Q.TEXT, Q.ITEM, Q.ITEM, Q.ITEM, Q.MARKED, Q.MARKED])
    assert Q.segments(shapes, np.zeros(8, int)).tolist() == [0, 3, 6] and Q.segments(shapes, np.array([0] * 7 + [1])).tolist() == [0, 3, 6, 7]
    assert Q.segments(shapes[:0], shapes[:0]).tolist() == []


def test_mixture_finds_two_clouds(spark):
    rng = np.random.default_rng(0)
    d = len(Q.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (200, d)), rng.normal(6, 1, (200, d))])
    x = np.concatenate([x, np.zeros((400, 1))], axis=1)
    m = Q.Mixture(components=2).fit(spark.createDataFrame([(r.tolist(),) for r in x.reshape(40, -1)], "xs array<float>"), x)
    _, r, ll = m.frozen()(x)
    side = r.argmax(axis=1)
    assert len(set(side[:200])) == len(set(side[200:])) == 1 and side[0] != side[-1] and abs(m.weights[0] - 0.5) < 0.05
    z = (m.standard(x[:5]) - m.means[side[0]]) @ np.linalg.inv(m.chols[side[0]]).T  # the density by its definition
    log = np.log(m.weights[side[0]]) - 0.5 * (z * z).sum(axis=1) - np.log(np.diag(m.chols[side[0]])).sum() - 0.5 * d * np.log(2 * np.pi)
    assert np.allclose(ll[:5], log, atol=1e-6)


def test_mixed_components_are_split():
    rng = np.random.default_rng(1)
    d = len(Q.FEATURES)
    m = Q.Mixture()
    m.mean, m.scale, m.usual, m.usual_scale = np.zeros(d), np.ones(d), np.zeros(1), np.ones(1)
    m.weights, m.means, m.chols = np.ones(1), np.zeros((1, d)), np.eye(d)[None] * 3
    x = np.concatenate([rng.normal(-2, 0.5, (50, d)), rng.normal(2, 0.5, (50, d))])
    assert m._split(x, np.repeat([0, 2], 50)) and len(m.means) == 2 and abs(m.weights - 0.5).max() < 0.01
    assert not m._split(x, np.repeat([0, 2], 50))


def test_nothing(spark, chunks_of):
    common = spark.createDataFrame([], "lang string, word string, word_rank int")
    assert Q.text_quality(chunks_of([("a", "x", "f", None)]).limit(0), common).count() == 0
