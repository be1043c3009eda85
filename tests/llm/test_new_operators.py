"""Token files, Merkle manifests and spelling variants against brute force, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairlead.llm import entry, merkle, tokenfiles, variants
from fairlead.llm.numbering import numbered
from fairlead.llm.stage import new_path, stage
from fairlead.llm.wavelet import TokenFile, encode

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, root long, word string, leaf string, path string"
LONG = " ".join(f"word{i % 977}x" for i in range(12000)) + "y" * 3000
TEXTS = [
    "Hello  world\n\n  it's\ttime now ", "naïve ÉCOLE Ünïcode × straße", "", " ", "<|endoftext|> a<|endoftext|>", "a 　 b ᠎ c \x1d d",
    LONG, "colour color Colour colours colr color\n" * 3, "😀 mixed 漢字 \r\n x"]
ODD = [
    *[(i, t, "en" if i % 3 else None, "a", len(t), "k", i, "w", "l", "p") for i, t in enumerate(TEXTS)], (3, " ", None, "a", 1, "k", 3, "w", "l", "p"),
    (None, "no id here", None, None, None, None, None, None, None, None), (2**62 + 5, None, "", "b", None, "k", 1, None, None, None),
    (2**63 - 1, "last", "zh", None, 4, None, 1, None, None, None), (-(2**63), "first", "ž", "b", 5, None, 1, None, None, None),
    (7, "another text of one id", "en", "b", 1, None, 1, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def byte_bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def open_file(tmp_path, data):
    tmp_path.joinpath("x").write_bytes(data)
    return TokenFile(tokenfiles.filesystem(str(tmp_path / "x"))[0].open_input_file(str(tmp_path / "x")))


@pytest.mark.parametrize("n, most", [(0, 1), (1, 1), (9, 2), (200_000, 50257), (65536, 3), (131072, 2**31)])
def test_wavelet_matrix(tmp_path, n, most):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, most, n) * (rng.random(n) < 0.7)).astype(np.uint32)
    file = open_file(tmp_path, encode(ids, [5, None], [n // 2, n - n // 2]))
    assert file.documents()[0] == [5, None] and file.documents()[1].tolist() == [n // 2, n - n // 2]
    assert (file.decode() == ids).all() and file.n == n
    if n:
        at = rng.integers(0, n, 50)
        assert (file.access(at) == ids[at]).all()
        for token in [*set(ids[at[:5]].tolist()), 0, most + 7]:
            assert file.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
            low, high = sorted(rng.integers(0, n + 1, 2).tolist())
            assert file.count(token, low, high) == int((ids[low:high] == token).sum())


def test_wavelet_file_is_smaller_than_ids(tmp_path):
    ids = np.random.default_rng(1).zipf(1.3, 300_000).clip(0, 50256).astype(np.uint32)
    assert len(encode(ids, [1], [len(ids)])) < 2 * len(ids)
    with pytest.raises(ValueError):
        open_file(tmp_path, b"\0" * 64)


@given(st.text(alphabet=" \n\t\u00a0\u180e\u200b\x1c\x85abÉ'st1.漢-²×", max_size=60))
@settings(max_examples=2000, deadline=None)
def test_byte_encoder_is_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = getattr(test_byte_encoder_is_the_tokenizers, "tok", None) or Tokenizer.from_file(path)
    test_byte_encoder_is_the_tokenizers.tok = whole
    assert np.frombuffer(tokenfiles.byte_encoder(path)([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_where_units_begin(byte_bpe, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfiles, "LONG", 30)
    tok = Tokenizer.from_file(byte_bpe)
    for text in [*TEXTS, "a\n\n b  c d's \t e " * 40, "漢字 かな 1.5 x" * 20]:
        assert np.frombuffer(tokenfiles.byte_encoder(byte_bpe)([text, "short"])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(list(tokenfiles._pieces("word " * 100))) > 10


def expected_tokens(rows, path):
    from tokenizers import Tokenizer

    tok, at, out, ids = Tokenizer.from_file(path), 0, [], []
    for doc, text in rows:
        e = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, at, len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
        at += len(e)
        ids.append((doc, e))
    return out, ids


def test_token_files(spark, data, docs, byte_bpe, monkeypatch):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want, ids = expected_tokens(rows, byte_bpe)
    assert sorted(map(tuple, entry.op11_wavelet_tokens(spark, data).collect())) == want
    monkeypatch.setattr(tokenfiles, "SHARD_BYTES", 60_000)
    manifest = tokenfiles.write_tokens(docs, byte_bpe, new_path(spark, "test"))
    assert manifest.count() > 5 and manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    assert sorted(map(tuple, tokenfiles.read_documents(manifest).collect())) == want
    some = [0, 262, ids[0][1][0], 50256]
    places = sorted((t, d, k) for d, e in ids for k, t in enumerate(e) if t in some)
    assert sorted(map(tuple, tokenfiles.find_tokens(manifest, sorted(set(some))).collect())) == places
    counts = Counter(t for t, _, _ in places)
    assert dict(map(tuple, tokenfiles.count_tokens(manifest, sorted(set(some))).collect())) == {t: counts[t] for t in set(some)}


def test_token_files_of_awkward_rows(odd, byte_bpe, monkeypatch):
    got = tokenfiles.token_documents(odd, byte_bpe).collect()
    rows = sorted(((r[0], r[1]) for r in ODD), key=lambda r: (r[0] is not None, r[0] or 0))
    want, _ = expected_tokens(rows, byte_bpe)
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((w[0], w[2], w[3]) for w in want)
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert tokenfiles.token_documents(odd.limit(0), byte_bpe).collect() == []


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r):
    v = [None if x is None else str(x) for x in (r[0], r[3], r[2], r[4], r[1])]
    return H("-" if x is None else f"{len(x.encode())}:{x}" for x in v)


def plain_tree(leaves):
    """Root, and for each leaf its steps: place and siblings."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 8 * 8 : k // 8 * 8 + 8]
            steps[i].append((k % 8, run[: k % 8] + run[k % 8 + 1 :]))
            at[i] = k // 8
        level = [H(level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], steps


def plain_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars) -> the contract's rows."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs, found = [], {}
    for lang in langs:
        trees[lang].sort(key=lambda x: x[:3])
        found[lang] = plain_tree([x[2] for x in trees[lang]])
        subs.append(found[lang][0])
    root, top = plain_tree(subs)
    out = []
    for lang, above in zip(langs, top, strict=True):
        for (_, _, leaf, r), own in zip(trees[lang], found[lang][1], strict=True):
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = plain_leaf((r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:]))
            steps = own + above
            for place, others in steps:
                now = H([*others[:place], now, *others[place:]])
            out.append((r[0], leaf, found[lang][0], root, H(x for _, others in steps for x in others), now, now == root))
    return out


def test_merkle_manifest(spark, data, docs):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    got = Counter(map(tuple, entry.op12_merkle_manifest(spark, data).collect()))
    assert got == Counter(plain_manifest(rows))
    verified = Counter(r[-1] for r in got)
    assert verified[True] and verified[False]


def test_merkle_of_awkward_rows(spark, odd):
    got = merkle.merkle_documents(odd, with_steps=True)
    assert Counter(tuple(r)[:7] for r in got.collect()) == Counter(plain_manifest([r[:5] for r in ODD]))
    assert merkle.merkle_documents(odd.limit(0)).collect() == []
    one = odd.where("doc_id = 2")
    row = merkle.merkle_documents(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == H([])
    now = odd.where("doc_id <> 7").withColumn("text", F.when(F.col("doc_id") == 0, "other").otherwise(F.col("text")))
    now = now.unionByName(one.withColumn("doc_id", F.lit(999).cast("long")))
    found = {r.doc_id: (r.found, r.verified) for r in merkle.verify_rows(got, now).collect()}
    assert found.pop(0) == (True, False) and found.pop(999) == (False, False) and set(found.values()) == {(True, True)}


def test_merkle_with_many_groups_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART", 7)
    monkeypatch.setattr("fairlead.llm.numbering.RANGE_ROWS", 50)
    rows = [(i, f"T{i}", f"l{i % 90 if i % 3 else 0}", "s", i) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, merkle.merkle_documents(docs).collect())) == Counter(plain_manifest(rows))


def test_numbered(spark, monkeypatch):
    monkeypatch.setattr("fairlead.llm.numbering.RANGE_ROWS", 10)
    rows = [(None if i % 50 == 0 else i * 7 % 100, "x") for i in range(200)]
    df = stage(spark.createDataFrame(rows, "a long, b string"), "rows")
    got = sorted(numbered(df, ["a"]).collect(), key=lambda r: r.number)
    assert [r.number for r in got] == list(range(200)) and [r.a for r in got] == sorted((r[0] for r in rows), key=lambda a: (a is not None, a or 0))


def plain_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if doc is not None and (h := zlib.crc32(f"{doc}:{run}".encode())) % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    held = defaultdict(set)
    for w in n:
        held[w].add((w, -1))
        for i in range(len(w)):
            held[w[:i] + w[i + 1 :]].add((w, i))
    near = defaultdict(set)
    for some in held.values():
        for a, i in some:
            near[a] |= {b for b, j in some if a != b and (i == j or -1 in (i, j))}
    form = {w: b for w in n if near[w] and n[b := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def test_spelling_variants(spark, data, docs):
    got = [tuple(r) for r in entry.op13_spelling_variants(spark, data).collect()]
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[1] is not None for r in want) > 10


def test_variants_by_every_edit_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 64)
    base = ["colours", "colors", "colour", "kolours", "colourss", "ccolours", "aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaab", "école÷s", "École÷s", "école×s"]
    base += ["z" * 3000, "z" * 2999, "y" + "z" * 2999]
    words = [w for i, w in enumerate(base) for _ in range(3 + i * i % 11)]
    rows = [(k, " ".join(words[k::5])) for k in range(5)] + [(None, "Colours cOLORS"), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in variants.spelling_variants(docs).collect()} == plain_variants(rows)


def test_variants_of_awkward_rows(odd):
    assert {tuple(r) for r in variants.spelling_variants(odd).collect()} == plain_variants([r[:2] for r in ODD])
    assert variants.spelling_variants(odd.limit(0)).collect() == []


def test_equal_hashes_link_nothing(spark, monkeypatch):
    """Keys that collide for different strings make no near words, as the strings are compared."""
    words = ["planet", "street", "garden", "plane", "streets", "gardon"]
    rows = [(k, " ".join(words)) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    full = variants.shared_keys
    monkeypatch.setattr(variants, "shared_keys", lambda keys: full(keys.withColumn("key", F.col("key") % 2)))
    assert {tuple(r) for r in variants.spelling_variants(docs).collect()} == plain_variants(rows)


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_spelling_variants"])
def test_matches_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    mine = entry.queries()[name](spark, data)
    other = con.sql(entry.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(other.columns)
    assert Counter(map(tuple, mine.select(sorted(mine.columns)).collect())) == Counter(other.project(", ".join(sorted(mine.columns))).fetchall())


def test_ids_of_the_whole_range_beside_rows_without_one(spark):
    """Media, near duplicates and paragraphs keep ids of 2 ** 62 and more, and the least and largest, with and without null ids."""
    from fairlead.llm import media, minhash, paragraphs

    text = " ".join(f"word{i}" for i in range(60))
    ids = [2**62 + 5, 2**63 - 1, -(2**63), 3]
    for more in ([], [(None, text), (None, "other words")]):
        docs = spark.createDataFrame([(i, text) for i in ids] + more, "doc_id long, text string")
        near = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
        assert near == Counter([(i, -(2**63), i == -(2**63)) for i in ids] + [(None, -(2**63), False), (None, None, True)][: len(more)])
        assert Counter(r.doc_id for r in media.media_documents(docs).collect()) == Counter([*ids, *[None] * len(more)])
        found = [r for r in paragraphs.repeated_paragraphs(docs).collect() if r.whole]
        assert {r.doc_id for r in found} == {*ids, *([None] if more else [])} and {r.component_id for r in found} == {-(2**63)}
        assert [r.doc_id for r in found if r.kept] == [-(2**63)]


def test_surplus_of_counts_is_no_more_than_edits(spark):
    import random

    from fairlead.llm import fuzzylines

    draw = random.Random(5)
    texts = ["".join(draw.choice("abcdez 1é") for _ in range(draw.randrange(0, 300))) for _ in range(30)] + ["a" * 500, "b" * 126, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "norm string").withColumns(fuzzylines.counted(F.col("norm")))
    pairs = rows.alias("one").crossJoin(rows.alias("two")).select("one.norm", F.col("two.norm").alias("other"), F.expr(fuzzylines.surplus("one", "two")).alias("s"),
                                                                F.levenshtein("one.norm", "two.norm").alias("d"))
    for r in pairs.collect():
        assert r.s == sum(max(0, min(r.norm.count(c), 127) - min(r.other.count(c), 127)) for c in fuzzylines.COUNTS) <= r.d


def test_fuzzy_lines_of_a_large_bucket_that_share_nothing_else(spark, monkeypatch):
    """Each pair meets in one key only, which forty lines have: it was dropped before."""
    from fairlead.llm import fuzzylines, linking

    shared = [(1, i, 100) for i in range(40)]
    members = spark.createDataFrame(shared, "key long, id long, chars int")
    wanted = {(a, a + 1) for a in range(0, 40, 2)}
    verify = lambda pairs: pairs.where("b = a + 1 and a % 2 = 0")
    none = spark.createDataFrame([], "a long, b long")
    for block in (4096, 7):
        monkeypatch.setattr(linking, "BLOCK", block)
        roots = linking.link_components(linking.stage(members, "members"), verify, close=F.col("one.near") == F.col("two.near"), links=none,
                                        roots=linking.stage(spark.createDataFrame([], "id long, root long"), "roots"),
                                        sign=lambda rows: rows.withColumn("near", F.floor(F.col("id") / 2)))
        assert {(r.root, r.id) for r in roots.collect() if r.root != r.id} == wanted
    assert fuzzylines.SMALL < 40


def test_least_of_neighbours_and_minima_in_one_call():
    """Places as a plain search finds them, ties to the first; minima of short texts in one call as those of long ones."""
    from fairlead.llm import paragraphs, words

    rng = np.random.default_rng(3)
    for n, width in [(1, 3), (2, 26), (25, 26), (26, 26), (27, 26), (300, 26), (300, 3), (40, 1)]:
        for top in (3, 2**63):
            key = rng.integers(0, top, n, dtype=np.uint64)
            w = min(n, width)
            assert paragraphs.least_of_neighbours(key, width).tolist() == sorted({i + int(np.argmin(key[i : i + w])) for i in range(n - w + 1)})
    h = rng.integers(0, 2**63, 2 * words._NARROW, dtype=np.uint64)
    cuts = np.array([0, 7, 7, 300, 310, 311, 500, 700])
    assert np.array_equal(words.minhash_ranges(h[:700], cuts, 20), words.minhash_ranges(h, cuts, 20))


def test_fuzzy_lines_of_the_same_frequent_words_meet_seldom(spark, monkeypatch):
    """Lines of some frequent words in any order shared thousands of keys: keys now say which words follow one another."""
    import random

    from fairlead.llm import fuzzylines

    draw, staged = random.Random(2), {}
    words = "the of and to in that was with from this have they which their there about would other these first".split()
    rows = [(i, " ".join(draw.choices(words, k=40))) for i in range(400)]
    rows += [(1000 + i, rows[i][1].replace(rows[i][1][50:53], "zq ", 1)) for i in range(20)]
    kept = fuzzylines.stage
    monkeypatch.setattr(fuzzylines, "stage", lambda df, name: staged.setdefault(name, kept(df, name)) if name == "members" else kept(df, name))
    monkeypatch.setattr(fuzzylines, "drop", lambda table: None)
    gone = {r.doc_id for r in fuzzylines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert gone == {1000 + i for i in range(20)}
    assert staged["members"].count() < 12 * 2 * 20 + 100


def test_fuzzy_lines_with_all_edits_in_one_place(spark):
    """A seventh of a long line is another text, at its start, its end or within: the cheap tests of its ends lose none, nor does a run moved by an insertion."""
    import random

    from fairlead.llm import fuzzylines

    draw = random.Random(4)
    text = lambda n: " ".join("".join(draw.choice("abcdefghijklmnopqrst") for _ in range(draw.randint(3, 8))) for _ in range(n))[:n * 6].strip()
    rows, pairs = [], []
    for n in (20, 60, 200):
        for at in (0, 0.3, 0.5, 0.86):
            a = text(n)
            cut, long = int(at * len(a)), int(0.14 * len(a))
            for b in (a[:cut] + text(n)[:long] + a[cut + long :], a[:cut] + a[cut + long :], a[:cut] + text(n)[:long] + a[cut:]):
                rows += [(len(rows), a + str(len(rows))), (len(rows) + 1, b + str(len(rows)))]
                pairs.append(len(rows) - 1)
    gone = {r.doc_id for r in fuzzylines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert set(pairs) <= gone
