"""Filter audit, conversation trie and distinct-word BPE next to brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from forewarn.llm import filter_audit, turn_trie, word_bpe
from forewarn.llm.queries import QUERIES

# filter audit ---------------------------------------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    least, marked, out = {}, [], {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    for i, t, p in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        marked.append((p or "", {f for f, bad in fails.items() if bad}, i is not None and i in good, i is not None and i in toxic))
    for part in {m[0] for m in marked}:
        rows, shapley = [m for m in marked if m[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                reached = [m for m in rows if not m[1] & set(order[:s])]
                gone = [m for m in reached if f in m[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), s + 1] = [
                    len(reached) - len(gone), len(gone), sum(f in m[1] for m in rows) - len(gone), sum(m[1] == {f} for m in rows),
                    sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                out[part, "".join(order), s + 1].append(shapley[f])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("sent_bytes", [filter_audit.SENT_BYTES, 0])
def test_filter_audit(spark, sent_bytes):
    rng = random.Random(3)
    long = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", "a", "a", long, long, long + " #", "same " * 80, "ONE TWO " + long, "LOUD", "x\x1cy\xa0z ", " \t\n", "long " * 30_000,
             "ünï " + long, long.upper()] + [" ".join(rng.choices(["p", "q", "r", "S", "|"], k=rng.randint(1, 90))) for _ in range(40)]
    docs = [(i, t, rng.choice(["s1", "s2", None, ""])) for i, t in enumerate(texts)]
    docs += [(None, long, "s1"), (None, "a", None), (5, long, "s1"), (6, "other", "s1"), (-3, long, "s2")] + docs[:6]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 50, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit("clash")).withColumn("h", F.lit(1))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = filter_audit.audit(filter_audit.flags(df, told, sent_bytes=sent_bytes)).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == audit_by_hand(docs, labels) and len(got) == 600 * 3
    assert filter_audit.audit(filter_audit.flags(df.limit(0), told, sent_bytes=sent_bytes)).count() == 0
    assert {r["toxic_lost"] for r in filter_audit.audit(filter_audit.flags(df, told.limit(0), sent_bytes=sent_bytes)).collect()} == {0}


def test_sketch_clears_only_unique_texts(spark):
    """Nothing that repeats is cleared, and nearly all that does not is."""
    rows = spark.range(40_000).select(F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(F.col("id"))).alias("h"))
    rows = rows.withColumn("n", F.count("*").over(__import__("pyspark").sql.Window.partitionBy("h")))
    for sent in (filter_audit.SENT_BYTES, 0):
        got = {(r["again"], r["maybe"]): r["count"] for r in filter_audit.possible_repeats(rows, sent).withColumn("again", F.col("n") > 1)
               .groupBy("again", "maybe").count().collect()}
        assert (True, False) not in got and got[False, True] < 0.02 * got[False, False]


# conversation trie ----------------------------------------------------------------------------------------------------

def trie_by_hand(turns):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (*t[:2], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()[:32])
    own = {c: [t[2:] for t in sorted(x, key=key)] for c, x in own.items()}
    made = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(np.fmod(c, 100)), [])
        made[c] = tuple(base[:h] + x[h:])
    nodes = {}
    for c, x in made.items():
        for d in range(len(x) + 1):
            nodes.setdefault(x[:d], []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] += kids[p] == 0
        if p:
            saved[p] += (len(nodes[p]) - 1) * len(p[-1][1])
            kids[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items())


def trie_of(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("key", F.lit("x"))
    got = turn_trie.trie(turn_trie.rebuilt(turn_trie.sequences(df))).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


@pytest.mark.parametrize("shard_turns", [1 << 20, 25])
def test_conversation_trie(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(turn_trie, "SHARD_TURNS", shard_turns)
    rng = random.Random(5)
    turns = []
    for c in [*range(60), *range(97, 130), 200, 207, 350, -7, 10_000_000_007]:
        turns += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "no", "", None, "ünï"])) for t in range(rng.randint(1, 7))]
    turns += [(400, t, "user", f"{t // 40}") for t in range(90)] + [(c, t, "user", f"{t // 40}") for c in (401, 402) for t in range(70 + c % 2)]
    turns += [(500, None, "user", "first"), (500, 1, "a", "x"), (500, 1, "b", "x"), (500, 1, "b", "x"), (501, 0, "user", "w" * 200_000)]
    turns += [(None, 0, "user", "nobody"), *turns[:5]]
    assert trie_of(spark, turns) == trie_by_hand(turns)


def test_conversation_trie_small(spark):
    assert trie_of(spark, [(3, 0, "user", "x")]) == trie_by_hand([(3, 0, "user", "x")])
    assert trie_of(spark, [(None, 0, "user", "x")]) == []
    same = [(c, 0, "user", "all the same") for c in range(100, 5000) if c % 100]
    assert trie_of(spark, same) == trie_by_hand(same)


def test_sorted_rows():
    rng = random.Random(1)
    rows = sorted({tuple(rng.choices([1, 2], k=rng.choice([0, 1, 3, 31, 32, 33, 64, 100]))) + tuple(rng.choices([1, 2], k=rng.randint(0, 3))) for _ in range(300)}
                  | {(1,) * k for k in range(0, 140)})
    given = rows[:]
    rng.shuffle(given)
    sizes = np.array([len(r) for r in given])
    order, common = turn_trie.sorted_rows(np.array([c for r in given for c in r]), np.cumsum(sizes) - sizes, sizes)
    assert [given[i] for i in order] == rows
    for a, b, k in zip(rows, rows[1:], common[1:]):
        assert a[:k] == b[:k] and a[:k + 1] != b[:k + 1]


# distinct-word BPE ------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    return tok


def awkward():
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x20, 0x2500)] + list("\x00\x1c\x85\xa0 \n\t\r\v\f日本語가각🌍")
    fixed = [None, "", " \n", "don't WE'LL 'Tis 2024!", "<|startoftext|>a<|endoftext|>b <|ENDOFTEXT|>", "x<|endoftext|≯ ≯ é", "ΑΣ Σίσυφος İ ß",
             "</w> x</w>y", "a" * 300_000, "ab" * 1000 + " " + "日本" * 5000, "w " * 20_000]
    return fixed + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(300)]


def test_word_bpe(spark, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "AT_ONCE", 50_000)
    texts = awkward()
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("batch", F.lit("b")).withColumn("ids", F.lit(1)).withColumn("row", F.lit(2.5))
    vocabulary = word_bpe.public_vocabulary()
    out = word_bpe.encode(df, vocabulary, decoded_col="decoded")
    assert out.columns == ["doc_id", "batch", "row", "ids", "decoded"]
    got = out.collect()
    want = sorted((-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == want
    for r in got:
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) and r["batch"] == "b" and r["row"] == 2.5
    packed = word_bpe.encode(df.select("doc_id", "text"), vocabulary, packed=True)
    again = {r["doc_id"]: r["decoded"] for r in word_bpe.decode(packed, vocabulary).collect()}
    assert all(again[r["doc_id"]] == r["decoded"] for r in got)
    assert word_bpe.encode(df.limit(0), vocabulary).count() == 0


def test_decode_of_any_ids(spark):
    df = spark.createDataFrame([(1, [320, 999_999, 321, -4]), (2, []), (3, None), (4, [49407])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in word_bpe.decode(df, word_bpe.public_vocabulary()).collect()}
    assert got == {1: "a</w> b</w>", 2: "", 3: "", 4: "<|endoftext|>"}


def test_packed_numbers():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2_097_151, 2_097_152, 300_000_000])
    out, size = word_bpe.packed_numbers(x)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 5] and (word_bpe.unpacked_numbers(out.tobytes()) == x).all()
    assert len(word_bpe.unpacked_numbers(b"")) == 0


def test_word_is_encoded_once(spark, monkeypatch):
    """The table of distinct words has each word of all batches once, and the numbers' table is not shuffled."""
    monkeypatch.setattr(word_bpe, "AT_ONCE", 200)
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the same words"), F.col("id") % 7).alias("text"))
    out = word_bpe.encode(df, word_bpe.public_vocabulary())
    text = out._jdf.queryExecution().executedPlan().toString()
    left = text[text.index("FlatMapCoGroupsInArrow"):text.index("Exchange")]
    assert "Bucketed: true" in left and len({tuple(r["ids"]) for r in out.collect()}) == 7


def test_registered_word_bpe(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# pages that break parsers ------------------------------------------------------------------------------------------------

def main_texts(spark, pages):
    from forewarn.llm import wrappers
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in wrappers.main_text(df).orderBy("page_id").collect()]


def test_deep_and_unclosed_pages(spark):
    from forewarn.llm import wrappers
    told = "Told one after the other."
    pages = [f"<html><body><article>{'<b>' * 100_000}{told} End.", f"<body><article>{'<div>' * 100_000}{told}{'</div>' * 50_000} End.</article>",
             f"<article><p>{told}</p>{'</i>' * 100_000}{'<p>' * 20_000} End.", f"<article>{'<div>' * 400}A <nav>menu <ul><li>item</ul></nav>B <i>C</i> D</article>"]
    got = main_texts(spark, [("http://a/1", p) for p in pages] + [(f"http://{i}/1", p) for i, p in enumerate(pages)])
    want = [f"{told} End."] * 3 + ["A B C D"]
    assert got == want + want
    deepest, todo = 0, [(wrappers.tree(pages[0]), 0)]
    while todo:
        node, depth = todo.pop()
        deepest = max(deepest, depth)
        todo += [(k, depth + 1) for k in node[1] if isinstance(k, list)]
    assert deepest <= wrappers.DEPTH + 1


def test_cut_off_tags_take_linear_time(spark):
    import time
    attrs = " ".join(f"a{i}=\"v{i}\" b{i}='w{i}'" for i in range(10_000))
    odd = [f"<article>Text one. <a {attrs}", f"<article>Text one.<a {attrs} c=\"", "<article>Text one." + "<a \">\" " * 40_000, "<article>Text one." + "<a '" * 40_000,
           "<article>Text one.<p title=\"a>b\"></p> it's <b class=x'>so</b>"]
    start = time.time()
    got = main_texts(spark, [(f"http://{i}/", p) for i, p in enumerate(odd)])
    assert time.time() - start < 60 and all(t.startswith("Text one.") for t in got) and got[4] == "Text one. it's so"


def test_many_classes_and_headers(spark):
    import time
    pages = ["<article>" + "".join(f"<div class='{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{x}'>t{i} </div>" for i in range(2500)) + "</article>" for x in "xyz"]
    start = time.time()
    got = main_texts(spark, [("http://h/", p) for p in pages])
    assert got[0] == " ".join(f"t{i}" for i in range(2500)) and time.time() - start < 60
    pages = [f"<body><header>Site title</header><p>Told {w} in a long enough sentence for a page.</p><section class=kommentare>Nie wieder!</section>"
             f"<div class=werbung>Kaufen</div></body>" for w in ("one", "two")] + ["<article><header><h1>Title</h1></header><p>Body</p></article>"]
    assert main_texts(spark, [(f"http://{'k' if i < 2 else 'l'}/", p) for i, p in enumerate(pages)]) == [
        "Told one in a long enough sentence for a page.", "Told two in a long enough sentence for a page.", "Title Body"]


# losses that must not come back ------------------------------------------------------------------------------------------

def test_conversations_without_an_id_stay(spark):
    from forewarn.llm import chat
    rows = [(1, 0, "user", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash")).withColumn("rank", F.lit(0))
    out = chat.format_trees(chat.threads(df)).withColumn("said", chat.read_turns(F.col("formatted"))).collect()
    assert {r["tree"]: [tuple(t) for t in r["said"]] for r in out} == {1: [("user", "a"), ("assistant", "")], None: [("user", "x"), ("assistant", "y")]}


def test_large_scores(spark):
    """Scores below -2**62 stay, and those that would wrap are an error."""
    from forewarn.llm import topk
    big = 976_562.5
    rows = [(1, [big] * 100), (2, [-big] * 100), (3, [-big * 0.9] * 100), (4, [0.0] * 100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = [(r["vec_id"], r["score"]) for r in topk.search(df, df.where("vec_id = 1"), 3).orderBy("rank").collect()]
    x = [[int(256 * c) for c in v] for _, v in rows]
    want = sorted(((-sum(a * b for a, b in zip(x[0], x[i])), i + 1) for i in (1, 2, 3)))
    assert got == [(i, -s) for s, i in want]
    small = spark.createDataFrame([(1, [1.7e7] * 64), (2, [-1.7e7] * 64)], "vec_id long, embedding array<double>")
    assert [r["score"] for r in topk.search(small, small.where("vec_id = 1"), 5, scale=16).collect()] == [-64 * (17_000_000 * 16) ** 2]
    huge = spark.createDataFrame([(1, [1e12] * 6), (2, [1e12] * 6), (3, [0.0] * 6)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="leave 64 bits"):
        topk.search(huge, huge.where("vec_id = 1"), 2).collect()


def test_few_pairs_are_scored_whole(monkeypatch):
    """The cutoff saves whole scores, and the answer is that of all pairs."""
    from forewarn.llm import topk
    rng = np.random.default_rng(3)
    q, c = rng.integers(-100, 100, (40, 32)), rng.integers(-100, 100, (2000, 32))
    whole, limit = q @ c.T, np.sort(q @ c.T, axis=1)[:, -5:-4]
    passed = np.zeros(whole.shape, bool)
    for s in topk.cuts(32):
        passed |= topk.product(q[:, s], c[:, s]) >= -((-(limit + 1)) // topk.SLICES) - 1
    assert passed.mean() < 0.5 and (passed | (whole < limit)).all()
    assert (topk.scores_of(q, c, passed)[passed] == whole[passed]).all()
