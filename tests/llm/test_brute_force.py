"""Operators and pipeline stages against plain versions written another way, and stages on awkward rows."""

import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fairlead.llm import fuzzylines, mixing, quotes

DOC = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, "one two three four five six seven", "en", "a", 33), (None, "a row without an id stays here now", None, None, None), (2, None, None, "a", None),
    (3, "", "en", None, 0), (4, "\n \n", "en", "b", 3), (1, "one two three four five six seven", "en", "a", 33), (5, "word " * 60_000, "en", "b", 300_000),
    (6, "one two three four five six seven", "de", "b", 33), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


def plain(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip() or line.strip()


def find(up, x):
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def test_fuzzy_lines_against_all_pairs(docs):
    """Of the lines that exact edit similarity over all pairs removes, 0.9 at least go, and no others."""
    occurrences = [(r.doc_id, n, plain(x)) for r in sorted(docs.collect(), key=lambda r: r.doc_id) for n, x in enumerate((r.text or "").split("\n")) if plain(x)]
    texts = sorted({t for _, _, t in occurrences})
    letters = sorted(set("".join(texts)))
    assert len(letters) < 127  # one byte for each, as the plain version's edit distance counts bytes
    code = {ord(c): i for i, c in enumerate(letters, 1)}
    lines = pd.DataFrame({"t": [t.translate(code) for t in texts]}).reset_index()
    pairs = duckdb.sql(f"""select a.index a, b.index b from lines a join lines b on a.index < b.index and least(length(a.t), length(b.t)) >= {fuzzylines.SIMILAR} * greatest(length(a.t), length(b.t))
        where least(length(a.t), length(b.t)) < 600 and levenshtein(a.t, b.t) <= {1 - fuzzylines.SIMILAR} * greatest(length(a.t), length(b.t)) + 1e-9""").fetchall()
    up, place = list(range(len(lines))), {t: i for i, t in enumerate(texts)}
    for a, b in pairs:
        up[max(find(up, a), find(up, b))] = min(find(up, a), find(up, b))
    seen, expected, equal, same = set(), set(), set(), set()
    for doc, n, t in occurrences:
        root = find(up, place[t])
        (expected.add((doc, n)) if root in seen else seen.add(root))
        (equal.add((doc, n)) if t in same else same.add(t))
    got = {(r.doc_id, n) for r in fuzzylines.duplicate_lines(docs, min_chars=1).collect() for n in r.lines}
    assert equal <= got
    fuzzy = expected - equal
    assert len(fuzzy & got) >= 0.9 * len(fuzzy) and len(fuzzy) > 10
    long = {(doc, n) for doc, n, t in occurrences if len(t) >= 600}
    assert got - expected <= long  # the plain version leaves out pairs of long lines


def test_quotes_against_a_plain_search(spark):
    """Conversations of random bodies that quote earlier messages, nested up to three levels, with known parents."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows, parents, bodies = [], {}, {}
    for conv in range(30):
        shown = []  # the text of each message as others quote it
        for turn in range(int(rng.integers(1, 12))):
            own = "\n".join(" ".join(word() for _ in range(6)) for _ in range(int(rng.integers(1, 4))))
            up = int(rng.integers(0, turn)) if turn and rng.random() < 0.8 else None
            quoted = [("> " if rng.random() < 0.5 else ">") + x for x in shown[up].split("\n")] if up is not None else []
            quoted = [x.upper() if rng.random() < 0.3 else x for x in quoted if not re.match(r"^(\s*>){4}", x)]
            text = "\n".join([*quoted, own])
            shown.append(text)
            rows.append((conv, turn, "u", text))
            parents[conv, turn], bodies[conv, turn] = up, own
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r.conv_id, r.turn): r for r in quotes.link_conversations(table).collect()}
    assert {k: r.reply_to for k, r in got.items()} == parents and {k: r.text for k, r in got.items()} == bodies

    def root(k):
        depth = 0
        while parents[k] is not None:
            k, depth = (k[0], parents[k]), depth + 1
        return k[1], depth

    assert {k: (r.thread_root, r.reply_depth) for k, r in got.items()} == {k: root(k) for k in parents}


def test_quotes_of_no_and_of_awkward_messages(spark):
    schema = "conv_id long, turn long, role string, text string, hash string, level int"
    assert quotes.link_conversations(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, 0, "u", long, "h", 1), (1, 1, "a", "> " + long, None, None), (1, 1, "a", "> " + long, None, None), (1, 2, "u", ">", "x", 1), (1, None, None, None, None, None)]
    got = Counter((r.turn, r.reply_to, r.text is None) for r in quotes.link_conversations(spark.createDataFrame(rows, schema)).collect())
    assert got == {(0, None, False): 1, (1, 0, False): 2, (2, None, False): 1, (None, None, True): 1}


@pytest.mark.parametrize("seed", range(6))
def test_routes_cost_no_more_than_any_other(seed):
    """The flow fills the targets as far as any assignment can, at the least cost of repetitions, by enumeration."""
    rng = np.random.default_rng(seed)
    names, cap = ["a", "b"], 2
    patterns = {k: (s, int(rng.integers(1, 4))) for k, s in (("a", ["a"]), ("b", ["b"]), ("ab", ["a", "b"]))}
    target = {s: float(rng.integers(0, 8)) for s in names}

    def cost(used):  # words of a pattern cost nothing the first time, one each the second
        return sum(sum(min(max(used[k] - r * size, 0), size) * r * r for r in range(cap)) for k, (_, size) in patterns.items())

    best = None
    for a, b, both_a, both_b in itertools.product(*[range(cap * patterns[k][1] + 1) for k in ("a", "b", "ab", "ab")]):
        if both_a + both_b <= cap * patterns["ab"][1] and a + both_a <= target["a"] and b + both_b <= target["b"]:
            key = (-(a + both_a + b + both_b), cost({"a": a, "b": b, "ab": both_a + both_b}))
            best = key if best is None else min(best, key)
    flow = mixing.route(patterns, target, cap)
    used = {k: sum(n for _, n in found) for k, found in flow.items()}
    assert (-sum(used.values()), cost(used)) == best
    assert all(s in patterns[k][0] for k, found in flow.items() for s, n in found if n)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(AWKWARD, DOC)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    wider = odd.withColumns({"key": F.lit("x"), "_row": F.lit(1), "root": F.lit(2), "repeats": F.lit(9)})
    out = stage(spark, wider, "/root/testdata/sf0.001")
    assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
    kept = Counter((r.doc_id, r.text) for r in out.collect()) if name != "packing" else None
    given = Counter((r[0], r[1]) for r in AWKWARD)
    if name == "toxicity":
        assert kept == given  # none of them is toxic
    elif name == "line_dedup":
        assert sum(kept.values()) == len(AWKWARD) and Counter(t for (_, t), n in kept.items() for _ in range(n))[AWKWARD[0][1]] == 2
    elif name == "near_dedup":
        assert kept == {(None, AWKWARD[1][1]): 1, (2, None): 1, (3, ""): 1, (4, "\n \n"): 1, (1, AWKWARD[0][1]): 1, (5, AWKWARD[6][1]): 1, (None, None): 1}
    elif name == "mixing":
        assert all(n <= 3 * given[k] for k, n in kept.items()) and not any(t is None or not t.split() for _, t in kept)
    else:
        places = defaultdict(list)
        for r in out.collect():
            places[r.sequence_id].append((r.offset, r.length))
        for spans in places.values():
            ends = [0, *itertools.accumulate(n for _, n in sorted(spans))]
            assert [at for at, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 2048
        assert out.where("piece = 0").count() == len(AWKWARD)
    assert stage(spark, wider.limit(0), "/root/testdata/sf0.001").count() == 0
