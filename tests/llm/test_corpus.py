"""Corpus operators beside their plain versions, and on odd rows."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute  # noqa: E402
from oracle_check import compare, connect  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from trialspark.llm import (  # noqa: E402
    common, graph, op1_sentencepiece, op2_minhash, op3_toxicity, op4_substring, op5_suffix_array, op6_warc, op7_packing, op8_token_counts, op9_exact,
    op10_neighbours, op11_quality, op12_trie, op13_merkle, queries, ranks, repeats, sketches,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Result columns of all operators, as columns of the input.
CLASH = ["kept", "group_size", "keep_id", "text_sha256", "n_removed", "n_words", "kept_text", "score", "passages", "predicted", "ids", "n_tokens", "component_id", "n_shingles", "n_bytes", "n_spans", "place", "key"]


def made_texts(n=120, seed=5):
    """Invented documents with exact and near copies, shared passages and self-repeats."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows, passage = [], " ".join(rng.choice(words) for _ in range(60))
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        kind = i % 8
        if kind == 1 and rows:
            own = rng.choice(rows)[1].split()
        elif kind == 2 and rows:
            own = rng.choice(rows)[1].split()
            for _ in range(max(1, len(own) // 40)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
        elif kind == 3:
            own[len(own) // 2 : len(own) // 2] = passage.split()
        elif kind == 4:
            own = own + own
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(own)))
    return rows


ROWS = made_texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns named as results are."""
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, long), (5, long), (6, "One two"), (7, "one two"), (None, "one two"), (None, None), (8, "aaaa" * 200)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *columns).collect()}


# --- 1

def test_pieces_like_the_library():
    import sentencepiece

    path = op1_sentencepiece.default_model()
    model, library = op1_sentencepiece.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    signs = "aething  ▁▁.é中文字\n\t0192ﬁ\U0001F600　‍\x00{}();=''s²½"
    some = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    some += [" " * k for k in range(40)] + ["a" + " " * k + "b" for k in range(40)] + [x * n for x in ("ab", "the", "  a", "=") for n in (2, 50)]
    for text in some:
        ids = library.encode(text)
        assert model.encode(text) == ids, text
        assert model.decode(ids) == library.decode(ids), text
        spans = model.offsets(text)
        assert len(spans) == len(ids) and all(0 <= a <= b <= len(text) for a, b in spans)


def test_small_memo(monkeypatch):
    monkeypatch.setattr(op1_sentencepiece, "MEMO_WORDS", 3)
    model = op1_sentencepiece.PieceModel(op1_sentencepiece.default_model())
    big = op1_sentencepiece.piece_model(op1_sentencepiece.default_model())
    for _, text in ROWS[:20]:
        assert model.encode(text) == big.encode(text)


def test_op1_query(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=op1_sentencepiece.default_model())
    got = by_id(op1_sentencepiece.query(spark, SF), "n_tokens", "ids_sha256", "decoded_sha256")
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode(text or "")
        assert got[i] == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids)))


def test_op1_odd(odd, none):
    rows = op1_sentencepiece.encode_decode(odd).collect()
    assert len(rows) == odd.count() and all((r["decoded"] == (r["text"] or "")) for r in rows)
    assert {r["n_tokens"] for r in rows if not r["text"]} == {0}
    assert op1_sentencepiece.encode_decode(none).count() == 0


# --- 2

@pytest.mark.parametrize("words", [2, 5])
def test_near_groups(docs, words):
    got = by_id(op2_minhash.near_groups(docs, words), "n_shingles", "component_id", "kept")
    want = brute.near(ROWS, words)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_links_between_members_of_a_star(spark, monkeypatch):
    """A chain in which neighbours are linked and the centre is not linked with the far end, in tiny blocks."""
    monkeypatch.setattr(op2_minhash, "BLOCK", 3)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(40):  # each differs from the one before by 5 words of 100
        for k in range(5):
            base[(5 * i + k) % 100] = f"v{i}_{k}"
        rows.append(((i * 7) % 40, " ".join(base)))
    rows += [(100 + i, f"x{i} y z") for i in range(5)]
    got = by_id(op2_minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 1), "component_id")
    assert {i: c for i, (c,) in got.items()} == {i: c for i, (_, c) in brute.near(rows, 1).items()}


@pytest.mark.parametrize("most", [1 << 22, 3000])
def test_star_without_links_is_cut_on_both_sides(spark, monkeypatch, most):
    """A template family, similar by 0.7, and some links in it: no task gets more than two fills of a block a side."""
    monkeypatch.setattr(op2_minhash, "BLOCK", 3)
    monkeypatch.setattr(op2_minhash, "BLOCK_BYTES", most, raising=False)
    frame = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(frame + [f"x{i}y{k}" for k in range(20 + i % 3)])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " z" * (i + 1)) for i in (40, 50)]
    groups, tested = [], op2_minhash._tested

    def watched(left, right, bodies, words, least, only_links):
        if only_links:
            size = bodies.groupBy("doc").agg(F.sum(F.octet_length("text")).alias("size"))
            groups.extend(r for t in (left, right) for r in t.join(size, "doc").groupBy("place", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect())
        return tested(left, right, bodies, words, least, only_links)

    monkeypatch.setattr(op2_minhash, "_tested", watched)
    got = by_id(op2_minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 1), "component_id")
    assert {i: c for i, (c,) in got.items()} == {i: c for i, (_, c) in brute.near(rows, 1).items()}
    assert groups and max(r["n"] for r in groups) <= 24
    assert most > 3000 or max(r["bytes"] for r in groups) <= 12_000  # hash dealing fills unevenly


def thue_morse(letters, a="a", b="b"):
    """Two different words, each the other's complement: sums of signs times powers cannot tell them apart."""
    one = "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(letters))
    return one, one.translate(str.maketrans(a + b, b + a))


@pytest.mark.parametrize("letters", [1024, 4096])
def test_long_words_that_sums_cannot_tell_apart(spark, letters):
    a, b = thue_morse(letters)
    rest = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} x {a}"), (4, f"{b} x {b}"), (5, f"{a} y"), (6, f"{a} y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(op4_substring.drop_repeats(df, 20, 8), "n_removed", "kept_text")
    assert {i: (r, k) for i, (_, r, k) in brute.substring(rows, 20).items()} == got and got[2][0] == 0
    got = by_id(op2_minhash.near_groups(df, 2), "component_id")
    assert {i: c for i, (c,) in got.items()} == {i: c for i, (_, c) in brute.near(rows, 2).items()}
    assert got[4] == (4,) and got[6] == (5,)
    got = by_id(op5_suffix_array.drop_repeats(df), "n_bytes", "n_removed", "n_spans", "kept")
    assert {i: (x, r, k, bytes(t)) for i, (x, r, k, t) in got.items()} == brute.suffixes(rows, 100)


def test_hashes_of_runs():
    rng = np.random.default_rng(4)
    symbols = np.r_[rng.integers(0, 2, 400), rng.integers(0, 2, 400)].astype(np.uint64)
    runs = common.Runs(symbols)
    begin = rng.integers(0, 780, 4000)
    end = np.minimum(begin + rng.integers(0, 20, 4000), 800)
    seen = {}
    for h, i, j in zip(runs.hash(begin, end).tolist(), begin, end):
        assert seen.setdefault(h, tuple(symbols[i:j])) == tuple(symbols[i:j])
    assert len(set(seen.values())) == len(seen)
    for k in (1, 5, 8, 40):
        at = np.arange(801 - k)
        assert (runs.grams(k) == runs.hash(at, at + k)).all()
    a, b = (np.frombuffer(w.encode(), np.uint8).astype(np.uint64) for w in thue_morse(1 << 12))
    size = np.array([1 << 12])
    assert common.Runs(a).hash(size * 0, size) != common.Runs(b).hash(size * 0, size)


def test_exact_sets_are_sets_of_words():
    import pyarrow as pa

    some = ["a b a b a", "", None, "b a", "one", "A B a", "a b c d e f", "a b c d e f g", "  a\tb c d "]
    for k in (1, 2, 5):
        value, at = sketches.exact_sets(pa.array(some), k)
        sets = [set(value[a:b].tolist()) for a, b in zip(at, at[1:])]
        plain = [brute.shingles(t, k) for t in some]
        for x, p in zip(sets, plain):
            assert len(x) == len(p)
            for y, q in zip(sets, plain):
                assert len(x & y) == len(p & q)


def test_near_odd(odd, none):
    rows = op2_minhash.near_groups(odd).collect()
    assert len(rows) == odd.count()
    got = {(r["doc_id"], r["text"]): (r["component_id"], r["kept"]) for r in rows}
    assert all(v[1] == (k[0] is None or v[0] == k[0]) for k, v in got.items())
    assert got[(7, "one two")] == (6, False) and got[(1, None)] == (1, True) and got[(2, "")] == (2, True) and got[(None, "one two")] == (None, True)
    assert op2_minhash.near_groups(none).count() == 0


def test_sketches_agree_with_similarity():
    rng = np.random.default_rng(3)
    agree = []
    for n in (3, 30, 3000):
        for _ in range(20):
            pool = np.sort(rng.integers(0, 2**63, 3 * n, dtype=np.uint64))
            a, b = pool[: 2 * n], pool[n:]
            s = sketches.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 1 / 3) < 0.04


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 160)] + [(500, 500)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: root(x) for x in {y for l in links for y in l if l[0] != l[1]}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 3

def test_segments_take_linear_time():
    """Sparse weighted words on a falling sum: each opens a segment that begins lower than all before."""
    import time

    began = time.perf_counter()
    assert len(op3_toxicity.segments(np.arange(200_000) * 50, np.full(200_000, 1.0), -0.1)) == 200_000
    assert len(op3_toxicity.segments(np.arange(200_000) * 2, np.full(200_000, 1.0), -0.1)) == 1
    assert time.perf_counter() - began < 2


def test_segments():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 40)
        places = sorted(rng.sample(range(n), rng.randint(0, min(n, 12))))
        weights = [rng.uniform(0.5, 3) for _ in places]
        scores = [-0.4] * n
        for p, w in zip(places, weights):
            scores[p] = w
        got = op3_toxicity.segments(np.array(places, np.int64), np.array(weights), -0.4)
        want = brute.best_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op3_toxicity.query(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    toxic = got["toxic"] == 1
    assert ((got["predicted"] == 1) == toxic).mean() > 0.95
    assert (got["predicted"][toxic] == 1).mean() > 0.7 and (got["predicted"][~toxic] == 1).mean() < 0.01
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, 0), (6, 0, 1), (6, 0, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = op3_toxicity.fit(odd, labels)
    rows = op3_toxicity.judge(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    model = op3_toxicity.fit(none, labels.limit(0))
    assert op3_toxicity.judge(none, model).count() == 0 and {r["predicted"] for r in op3_toxicity.judge(odd, model).collect()} == {0}


# --- 4 and 5

@pytest.mark.parametrize("crowd", [256, 2])
def test_substrings(docs, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    got = by_id(op4_substring.drop_repeats(docs, 20, 8), "n_words", "n_removed", "kept_text")
    assert got == brute.substring(ROWS, 20)


@pytest.mark.parametrize("crowd", [256, 2])
def test_suffixes(docs, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    got = by_id(op5_suffix_array.drop_repeats(docs, 50, 20), "n_bytes", "n_removed", "n_spans", "kept")
    assert {i: (*v[:3], bytes(v[3])) for i, v in got.items()} == brute.suffixes(ROWS, 50)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 31, 100, 301):
        for _ in range(10):
            s = rng.integers(1, 3, n)
            s[-1] = 9
            assert op5_suffix_array.suffix_array(s.astype(np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_automaton():
    rng = random.Random(8)
    for _ in range(50):
        automaton, texts = op4_substring.SuffixAutomaton(), []
        for _ in range(4):
            words = [rng.choice("ab") for _ in range(rng.randint(0, 12))]
            got = automaton.matches(words)
            for e in range(len(words)):
                best = max((l for l in range(e + 2) if any("".join(words[e + 1 - l : e + 1]) in t for t in texts)), default=0) if texts else 0
                assert got[e] == best
            automaton.add(words)
            texts.append("".join(words))


def test_repeated_lines_and_low_variety(spark):
    rows = [(i, "x " * (30 + i)) for i in range(6)] + [(10 + i, " ".join(["the same line again and again"] * 8) + f" end{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(op4_substring.drop_repeats(df), "n_words", "n_removed", "kept_text") == brute.substring(rows, 20)
    got = by_id(op5_suffix_array.drop_repeats(df), "n_bytes", "n_removed", "n_spans", "kept")
    assert {i: (*v[:3], bytes(v[3])) for i, v in got.items()} == brute.suffixes(rows, 100)


def test_repeats_odd(odd, none):
    rows = op4_substring.drop_repeats(odd).collect()
    assert len(rows) == odd.count() and {"lang", "score", "group_size"} <= set(rows[0].asDict())
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in rows}
    long = next(t for i, t in got if i == 4)
    # 977 * 13 different neighbours come round again within the document
    assert got[(4, long)] == brute.substring([(4, long)], 20)[4][1] and got[(5, long)] == 20_000 and got[(None, "one two")] == 0 and got[(1, None)] == 0
    rows = op5_suffix_array.drop_repeats(odd).collect()
    got = {(r["doc_id"], r["text"]): (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows}
    assert got[(5, long)] == (len(long), len(long), 1) and got[(8, "aaaa" * 200)] == (800, 799, 1) and got[(None, None)] == (0, 0, 0)
    assert op4_substring.drop_repeats(none).count() == 0 and op5_suffix_array.drop_repeats(none).count() == 0


@pytest.mark.parametrize("crowd", [256, 1])
def test_rows_and_texts_of_one_id(spark, crowd, monkeypatch):
    """A repeated row that holds the first occurrence of a passage keeps it; so do texts of one id that share a place."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    p, q, head = words(30), words(30), words(25)
    rows = [(1, f"{words(25)} {p} {words(25)}"), (2, f"{words(25)} {p} {words(25)}")]
    rows += [(3, f"{head} {q} {words(25)}"), (3, f"{head} {q} {words(25)}"), (4, f"{words(25)} {q} {words(25)}")]
    df = spark.createDataFrame(rows + rows[:1] * 2, "doc_id long, text string").repartition(4)
    # the passage is gone from the later document alone, and every row of an id tells the same
    got = df.sparkSession.createDataFrame(op4_substring.drop_repeats(df).collect()).groupBy("doc_id").agg(F.collect_set("n_removed"), F.count("*")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {1: ([0], 3), 2: ([30], 1), 3: ([0], 2), 4: ([30], 1)}
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in op5_suffix_array.drop_repeats(df).collect()}
    assert all((v == 0) == (i in (1, 3)) for (i, _), v in got.items())
    once = [rows[0], rows[1], (4, rows[4][1])]
    want = brute.suffixes(once + [(3, rows[2][1])], 100)
    assert {i: v for (i, _), v in got.items()} == {i: v[1] for i, v in want.items()}


# --- 6

def test_archives(spark, tmp_path):
    rows = [(1, "http://a.example/x", "<p>é</p>"), (2, "http://b.example/", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (None, "n", "<p>é</p>"), (-7, "u", "z" * 100_000), (9, "u\r\nEvil: x", "q")]
    path = str(tmp_path / "archive")
    op6_warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)), path)
    got = op6_warc.captures(op6_warc.read_archive(spark, path)).collect()
    assert len(got) == len(rows) and all(r["request"] and r["response"] and r["metadata"] for r in got)
    by = {r["request"]["head"].split(" ")[1] + str(r["response"]["payload_bytes"]): r for r in got}
    assert bytes(by["u100000"]["response"]["payload"]) == b"z" * 100_000 and by["u100000"]["response"]["record_id"].startswith("<urn:uuid:ffffffff-ffff-8")
    assert {r["response"]["type"] for r in got if r["response"]["payload"] is None} == {"revisit"}
    assert sum(r["response"]["type"] == "revisit" for r in got) == 2  # page 1 revisits 2, page 3 revisits 4
    import base64
    import hashlib

    for r in got:
        if r["response"]["type"] == "response":
            assert r["response"]["payload_digest"] == base64.b32encode(hashlib.sha1(bytes(r["response"]["payload"])).digest()).decode()
    op6_warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert op6_warc.captures(op6_warc.read_archive(spark, str(tmp_path / "none"))).count() == 0


def test_archives_are_members_of_bounded_files(spark, tmp_path, monkeypatch):
    """One gzip member a record, files of bounded bytes, records of more than a run alone in theirs."""
    import glob
    import zlib

    monkeypatch.setattr(op6_warc, "FILE_RUNS", 4)
    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(33, 127)) for _ in range(1 << 20))
    rows = [(i, f"http://h/{i}", noise[: 200_000 + i] if i < 40 else noise * (1 + i % 3) + f"é{i}") for i in range(48)]
    path = str(tmp_path / "archive")
    op6_warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    files, records = glob.glob(f"{path}/part-*"), 0
    for name in files:
        left = open(name, "rb").read()
        assert len(left) < (4 << 20) + (5 << 20)
        while left:
            member = zlib.decompressobj(31)
            content = member.decompress(left)
            left = member.unused_data
            assert member.eof and (not content or (content.startswith(b"WARC/1.1\r\n") and content.endswith(b"\r\n\r\n") and content.count(b"WARC-Record-ID: ") == 1))
            records += bool(content)
    assert records == 3 * len(rows) and len(files) > 4
    got = op6_warc.captures(op6_warc.read_archive(spark, path)).collect()
    assert sorted(bytes(r["response"]["payload"]) for r in got) == sorted(h.encode() for _, _, h in rows)


@pytest.mark.parametrize("html", ["", "x"])
def test_op6_copies(spark, tmp_path, html):
    sf = str(tmp_path / "sf")
    spark.createDataFrame([(i, "u", html if i % 3 else f"{i}") for i in range(20)], "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in op6_warc.query(spark, sf).collect()}
    assert got == {i: ("response", None) if i % 3 == 0 or i == 19 else ("revisit", 19) for i in range(20)}


# --- 7 and 8

def test_bucket_lengths_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(6)
    for _ in range(20):
        top = np.sort(rng.choice(np.arange(1, 60), 8, replace=False))
        count = rng.integers(1, 9, 8)

        def cost(chosen):
            return sum(c * min(b for b in chosen if b >= t) for t, c in zip(top, count))

        best = min(cost([*c, top[-1]]) for c in combinations(top[:-1], 2))
        got = op7_packing.best_lengths(top, count, 3)
        assert len(got) == 3 and cost(got) == best
    assert op7_packing.best_lengths(np.array([5]), np.array([2]), 4) == [5]


def test_many_lengths_are_cut_best():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n, buckets = int(rng.integers(1, 14)), int(rng.integers(1, 6))
        lengths = rng.choice(np.r_[np.arange(1, 40), 1000, 1001, 5000], n).tolist()
        top, count = np.unique(lengths, return_counts=True)
        chosen = op7_packing.best_lengths(top, count, buckets)
        assert sum(min(b for b in chosen if b >= x) for x in lengths) == brute.least_padding(lengths, buckets)
    top = np.arange(1, 20_001)
    chosen = op7_packing.best_lengths(top, np.ones(20_000, np.int64), 4)
    assert chosen == [5000, 10_000, 15_000, 20_000]


def test_padding_of_the_query_is_the_least(spark, docs):
    rows = op7_packing.pack(op7_packing.token_lengths(docs.where("doc_id < 25")), 3, 512).where("n_tokens > 0").collect()
    assert sum(r["bucket_length"] for r in rows) == brute.least_padding([r["n_tokens"] for r in rows], 3)


def test_packing(spark, docs, odd, none):
    lengths = op7_packing.token_lengths(docs)
    rows = op7_packing.pack(lengths, 4, 512).collect()
    want = dict(map(tuple, lengths.collect()))
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want and len(rows) == len(want)
    batches = {}
    for r in rows:
        if r["n_tokens"]:
            batches.setdefault((r["bucket_length"], r["batch"]), []).append(r)
    full = {}
    for (length, batch), members in batches.items():
        room = max(1, 512 // length)
        assert len(members) <= room and sorted(m["place"] for m in members) == list(range(len(members))) and all(m["n_tokens"] <= length for m in members)
        full.setdefault(length, []).append(room - len(members))
    assert len(full) == 4 and all(sum(x > 0 for x in v) <= 1 for v in full.values())  # one unfilled batch a bucket at most
    odd_rows = op7_packing.pack(op7_packing.token_lengths(odd), 4, 512).collect()
    assert len(odd_rows) == odd.count() and all((r["batch"] is None) == (r["n_tokens"] == 0) for r in odd_rows)
    assert op7_packing.pack(op7_packing.token_lengths(none)).count() == 0


@pytest.mark.parametrize("rule", op8_token_counts.RULES)
def test_section_counts(rule):
    import re

    model = op1_sentencepiece.piece_model(op1_sentencepiece.default_model())
    rng = random.Random(7)
    for _ in range(150):
        text = "".join(rng.choice("the ing  .\n=é中") for _ in range(rng.randint(0, 50)))
        edge = np.array(op8_token_counts.borders(text, re.compile(rng.choice([r"\n", "i", "=+", " "]))))
        want = np.zeros(len(edge) - 1)
        for a, b in model.offsets(text):
            b = max(b, 1)
            inside = [max(0, min(b, y) - max(a, x)) for x, y in zip(edge, edge[1:])]
            hit = [k for k, n in enumerate(inside) if n]
            if rule == "share":
                want += np.array(inside) / (b - a)
            else:
                want[{"start": hit[0], "end": hit[-1], "most": int(np.argmax(inside))}[rule]] += 1
        got, _ = op8_token_counts.section_counts(model, text, edge, rule)
        assert np.allclose(got, want), (text, edge)


def test_op8_query(spark, odd, none):
    got = op8_token_counts.query(spark, SF).groupBy("doc_id").agg(F.sum("n_tokens"), F.min("begin"), F.max("end"))
    rows = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    model = op1_sentencepiece.piece_model(op1_sentencepiece.default_model())
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {i: (model.count(t), 0, len(t)) for i, t in rows.items()}
    found = op8_token_counts.count_sections(odd).collect()
    assert sum(r["doc_id"] == 1 for r in found) == 1 and sum(r["doc_id"] == 5 for r in found) == 2
    assert op8_token_counts.count_sections(none).count() == 0


# --- 9

@pytest.mark.parametrize("block", [4096, 3])
def test_exact(docs, block):
    got = by_id(op9_exact.exact_groups(docs, block=block), "keep_id", "group_size", "text_sha256", "kept")
    assert got == {i: (*v, v[0] == i) for i, v in brute.exact(ROWS).items()}


def test_exact_is_native(docs):
    plan = op9_exact.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_exact_odd(odd, none):
    rows = op9_exact.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    five = [r for r in rows if r["doc_id"] in (4, 5)]
    assert {(r["keep_id"], r["group_size"]) for r in five} == {(4, 3)} and sum(r["kept"] for r in five) == 1
    empty = [r for r in rows if not r["text"]]
    assert {(r["keep_id"], r["group_size"]) for r in empty} == {(1, 3)} and sum(r["kept"] for r in empty) == 1
    assert op9_exact.exact_groups(none).count() == 0


# --- 10

def test_neighbours_by_scan():
    rng = np.random.default_rng(9)
    x = np.round(rng.standard_normal((400, 33)), 1)
    x[50:60] = x[3]
    ids = np.arange(400)
    q, v, s = op10_neighbours.scan(x[::100], ids[::100], x, ids, 10)
    want = brute.nearest(list(zip(ids, x)), 10, 100)
    for k in want:
        mine = sorted(zip(s[q == k], v[q == k]))
        assert len({b for _, b in mine} & {i for i, _ in want[k]}) >= 9


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute.nearest([(r[0], r[1]) for r in rows], 10, 100)
    got = {}
    for r in op10_neighbours.query(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for k, best in want.items():
        assert sorted(got[k]) == list(range(1, 11))
        scores = [got[k][n][1] for n in range(1, 11)]
        assert scores == sorted(scores)
        true = dict(best)
        hits += sum(v in true for v, _ in got[k].values())
        assert all(abs(true[v] - s) < 1e-12 for v, s in got[k].values() if v in true)
    assert hits / (10 * len(want)) >= 0.9


def test_neighbours_odd(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(1, 60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(200, rows[0][1])]  # ties go to smaller ids
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [1.0, None] * 4), (305, [1.0]), (None, [1.0] * 8), (100, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1)).withColumn("rank", F.lit(1))
    got = {}
    for r in op10_neighbours.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {100, 200} and [v for _, v, _ in sorted(got[200])] == [1, *range(100, 109)] and {s for _, _, s in got[200]} == {0.0}
    assert [v for _, v, _ in sorted(got[100])] == [1, *range(101, 110)]
    assert op10_neighbours.nearest(df.limit(0)).count() == 0
    assert op10_neighbours.nearest(df.where("vec_id in (1, 2, 100)")).count() == 2


@pytest.mark.parametrize("block", [4096, 7])
def test_neighbours_in_double_precision(spark, monkeypatch, block):
    """Distances of 1e-9 between doubles; lists and their queries in blocks; all lists probed."""
    monkeypatch.setattr(op10_neighbours, "BLOCK", block)
    monkeypatch.setattr(op10_neighbours, "ASKED", 3)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((4, 24))
    rows = [(i, (base[i % 4] + rng.standard_normal(24) * 1e-9).tolist()) for i in range(200)]
    want = brute.nearest(rows, 10, 10)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in op10_neighbours.nearest(df, 10, 10, probed=1.0, spread=float("inf")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: [(v, s) for _, v, s in sorted(g)] for q, g in got.items()} == want


# --- 11

@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_quality_on_held_out_labels(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    got = op11_quality.query(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    good = got["quality"] > 0
    rank = got["score"].rank()
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97 and ((got["predicted"] > 0) == good).mean() > 0.96 and (got["predicted"][good] > 0).mean() > 0.97
    assert ((got["score"] >= 0.7) == (got["predicted"] > 0)).all() and got["score"].between(0, 1).all()


def test_quality_does_not_see_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(op11_quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (by_id(op11_quality.judge(docs, op11_quality.fit(docs, x)), "score") for x in (labels, other))
    assert one == two


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (5, 1), (5, 0), (6, 1), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    for rows in (labels, labels.where("quality = 1"), labels.limit(0)):
        out = op11_quality.judge(odd, op11_quality.fit(odd, rows)).collect()
        assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
        empty = {r["score"] for r in out if not r["text"]}
        assert len(empty) == 1
    assert {r["predicted"] for r in out} == {0}
    assert op11_quality.judge(none, op11_quality.fit(none, labels.limit(0))).count() == 0


def test_dual_descent_finds_the_hinge_minimum():
    """Against the primal: no small step lowers the loss."""
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((60, 5)), np.where(rng.standard_normal(60) > 0, 1.0, -1.0)
    x[:, 0] += y
    rows, c = [np.arange(5)] * 60, np.full(60, 0.7)
    op11 = op11_quality
    passes, enough = op11.PASSES, op11.ENOUGH
    op11.PASSES, op11.ENOUGH = 4000, 1e-10
    try:
        w = op11.dual_descent(rows, list(x), y, 5, c)
    finally:
        op11.PASSES, op11.ENOUGH = passes, enough

    def loss(v):
        return 0.5 * v @ v + (c * np.maximum(0, 1 - y * (x @ v))).sum()

    assert all(loss(w) <= loss(w + d) + 1e-9 for d in rng.standard_normal((500, 5)) * 0.01)


def test_units_are_indicators_of_ngrams():
    import pyarrow as pa

    def units(text):
        rows, bucket = op11_quality.units(pa.array([text]))
        return set(bucket.tolist())

    assert len(units("a b c")) == 3 + 2 + len({1, 2, 3}) + 2  # words, pairs, runs of one form, reached lengths
    assert units("") == set() and units(None) == set()
    assert units("x x x") != units("x y z")


# --- 12

def conversations(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, 7)):
            rows.append((c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é", "", None, "hello there"])))
    rows += [(c, t, "user", "same") for c in range(200, 240) for t in range(3)] + [(300, t, "user", f"t{t}") for t in range(40)] + [(301, t, "user", f"t{t}") for t in range(45)]
    rows += [(None, 0, "user", "nobody"), rows[0], rows[0], (-7, 1, "user", "below"), (-7, 1, "user", "below")]
    return rows


@pytest.mark.parametrize("limit, block, queue, chunk", [(4096, 256, 65_536, 4096), (3, 4, 2, 2), (2, 1, 1, 1)])
def test_trie(spark, limit, block, queue, chunk):
    """Small shards, blocks, queues and chunks give the same nodes."""
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).repartition(5)
    made = op12_trie.turns(df)
    got = op12_trie.prefix_trie(*op12_trie.regrafted(made), limit=limit, block=block, queue=queue, chunk=chunk)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(brute.trie(brute.rebuilt(rows)), key=str)


def test_trie_of_plain_and_empty_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "bye")]
    df = spark.createDataFrame(rows, "c long, turn long, role string, text string")
    got = sorted(tuple(r)[:7] for r in op12_trie.trie(df, conv_id="c").collect())
    assert got == [(1, 0, None, 3, 2, 2, 2), (1, 1, 1, 2, 1, 1, 2), (1, 2, 1, 1, 0, 1, 0), (3, 1, 1, 1, 0, 1, 0)]
    none = spark.createDataFrame([(None, 0, "user", "x")], "c long, turn long, role string, text string")
    assert op12_trie.trie(none, conv_id="c").count() == 0 and op12_trie.trie(none.limit(0), conv_id="c").count() == 0


def test_spilling_queue():
    rng = random.Random(4)
    sent = [(-rng.randint(0, 5), rng.randint(0, 3), 0, rng.randint(0, 9), 1) for _ in range(300)]
    queue = op12_trie.SpillingQueue(7)
    for m in sent:
        queue.push(m)
    for place in sorted({m[:3] for m in sent}):
        assert sorted(queue.taken(place)) == sorted(m[3:] for m in sent if m[:3] == place)


# --- 13

def test_merkle_manifest(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, f"Text {i} É" if i % 7 else None, rng.choice(["en", None]), rng.choice(["a", "b", "é", None, ""] + ["hot"] * 5), i % 11 or None) for i in range(700)]
    rows += [(5000, "alone", "en", "single", 5), (None, "No Id", "en", "a", 1), (None, None, None, None, None), rows[3], rows[3], rows[4]] + [(6000 + i, "X", "en", f"s{i}", 1) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("x")).repartition(6)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    for levels in (2, 1):
        monkeypatch.setattr(op13_merkle, "LEVELS", levels)
        out = op13_merkle.manifest(df, tampered, op13_merkle.lower_ascii_letters("text"))
        got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in out.collect()]
        assert sorted(got, key=str) == brute.merkle(rows)


def test_merkle_of_little(spark, none):
    assert op13_merkle.manifest(none).count() == 0
    one = spark.createDataFrame([(1, "a", "en", None, 1)], DOCS)
    r = op13_merkle.manifest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == brute.sha("") and r["source"] is None


def test_places_in_groups_of_any_size(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 10).cast("string")).alias("g"), (F.col("id") * 7 % 5).alias("k"), "id").repartition(7)
    out = ranks.numbered(df, ["g"], ["k"], "place", "total", "test").toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part["place"]) == list(range(len(part))) and set(part["total"]) == {len(part)}
        assert part.sort_values("place")["k"].is_monotonic_increasing


# --- queries and pipeline

@pytest.mark.parametrize("name", sorted(queries.CORPUS_ORACLES))
def test_equal_to_sql(spark, name):
    assert compare(queries.CORPUS_QUERIES[name](spark, SF), connect(SF), queries.CORPUS_ORACLES[name]) == ""


def test_contracts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, g, brute.sha(k)) for i, (n, g, k) in brute.substring(rows, 20).items()}
    assert by_id(op4_substring.query(spark, SF), "n_words", "n_removed", "kept_sha256") == want
    want = {i: (n, g, r, brute.sha(k)) for i, (n, g, r, k) in brute.suffixes(rows, 100).items()}
    assert by_id(op5_suffix_array.query(spark, SF), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    want = {i: (n, c, c == i) for i, (n, c) in brute.near(rows, 2).items()}
    assert by_id(op2_minhash.query(spark, SF), "n_shingles", "component_id", "kept") == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == columns and clean.join(docs, columns, "left_anti").count() == 0
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    single = stages["exact_dedup"](spark, clean, SF)
    kept = {r["doc_id"] for r in single.collect()}
    assert single.columns == columns and kept == {i for i, v in brute.exact(rows).items() if v[0] == i}
    rows = [r for r in rows if r[0] in kept]
    apart = stages["near_dedup"](spark, single, SF)
    kept = {r["doc_id"] for r in apart.collect()}
    assert apart.columns == columns and kept == {i for i, (_, c) in brute.near(rows, 5).items() if c == i}
    rows = [r for r in rows if r[0] in kept]
    cut = stages["substring_dedup"](spark, apart, SF)
    before = dict(rows)
    want = {i: (k if g else before[i]) for i, (_, g, k) in brute.substring(rows, 20).items()}
    assert cut.columns == columns and cut.schema == docs.schema and {r["doc_id"]: r["text"] for r in cut.collect()} == want
    packed = stages["packing"](spark, cut, SF).collect()
    assert {r["doc_id"] for r in packed} == set(want)
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in packed}


def test_pipeline_odd(spark, tmp_path, none):
    sf = str(tmp_path / "sf")
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "a b", "en", "s", 3), (None, "a b", None, None, None), (3, "a b", "en", "s", 3)]
    spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(1)).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == {1, 3}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
