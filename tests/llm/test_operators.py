"""Each operator on small fixtures: brute force, nulls, empty tables, ties, repeated rows, clashing names."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forewarn.llm import bpe, chat, common, decontam, forest_join, langid, line_dedup, suffix_dedup, topk, warc, wrappers
from forewarn.session import work_path

TEXTS = "doc_id long, text string"


def texts(spark, rows, extra=""):
    return spark.createDataFrame(rows, TEXTS + extra)


# line dedup ---------------------------------------------------------------------------------------------------------

def lines_by_hand(rows, min_chars=20, min_docs=3):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    at = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            at.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(at[key(x)]) >= min_docs and d != max(at[key(x)]))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    long, other = "A line that many documents share ", "Zwölf Boxkämpfer jagen Viktor"
    rows = [(1, f"{long}\nfirst\n\n"), (2, f"x\n  {long.lower()}\t\n{long}"), (3, long), (4, other), (5, other), (6, None), (7, ""),
            (8, "\n".join([long] * 70 + ["end"])), (9, f"{other}\r\n{other.upper()}"), (3, long)]
    df = texts(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in line_dedup.dedup_lines(df).collect())
    assert got == lines_by_hand(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    # a document without an id is smaller than all others
    rows = [(None, long), (1, long), (2, long)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(texts(spark, rows)).collect()}
    assert got == {None: 1, 1: 1, 2: 0}


# decontamination ----------------------------------------------------------------------------------------------------

def test_masks_meet_substitutions():
    from itertools import combinations
    for length, wrong in ((13, 2), (11, 2), (8, 1)):
        for bad in combinations(range(length), wrong):
            assert any(all(s + o not in bad for o in m) for m in decontam.MASKS for s in range(length - m[-1]))


def test_decontamination(spark):
    word = [f"w{i}" for i in range(40)]
    item = " ".join(word[:20])
    changed = " ".join("zz" if i in (4, 9) else w for i, w in enumerate(word[:13]))
    rows = [(1, f"some start, {item.upper()}! and an end"), (2, changed), (3, " ".join(word[:9])), (4, None), (5, ""),
            (6, " ".join(reversed(word[:20]))), (7, f"{item} x {item}"), (1, f"some start, {item.upper()}! and an end"),
            (8, " ".join("zz" if i % 4 == 0 else w for i, w in enumerate(word[:20]))), (None, item)]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short an item"), (1, item)], "item_id long, text string")
    found = decontam.overlaps(texts(spark, rows), bench).collect()
    assert Counter((r["id"], r["item"]) for r in found) == {(1, 1): 1, (2, 1): 1, (7, 1): 2, (None, 1): 1}
    assert {r["n_equal"] for r in found if r["id"] == 2} == {11}
    kept = decontam.decontaminate(texts(spark, rows).withColumn("item", F.lit(0)).withColumn("id", F.lit(0)), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert decontam.overlaps(texts(spark, rows), bench.limit(0)).count() == 0
    assert decontam.overlaps(texts(spark, []), bench).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    test_decontamination(spark)


def test_decontamination_by_short_items(spark):
    word = [f"w{i}" for i in range(40)]
    items = {n: [f"{n}{w}" for w in word[:n]] for n in range(7, 14)}

    def held(n, *bad):
        return "at the start " + " ".join("zz" if i in bad else w for i, w in enumerate(items[n])) + " and on"

    rows = [(100 * n + k, held(n, *range(1, 2 * k, 2))) for n in items for k in range(4)]
    rows += [(100 * n + 9, " ".join(items[n][:-1])) for n in items if n < 13]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = sorted((r["id"], r["item"], r["n_equal"]) for r in decontam.overlaps(texts(spark, rows), bench).collect())
    allowed = {8: 1, 9: 1, 10: 1, 11: 2, 12: 2, 13: 2}
    assert found == [(100 * n + k, n, n - k) for n, most in allowed.items() for k in range(most + 1)]


# top-k --------------------------------------------------------------------------------------------------------------

def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)]
    rows += [(i, [0.5] * 6) for i in range(40, 60)] + [(60, None), (61, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (62, [float("nan")] * 6),
                                                        (63, [float("inf")] * 6), (64, [1.0, 2.0]), (65, []), (66, [1e12] * 6), (0, rows[0][1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(v, v.where("vec_id % 3 = 0"), 5).collect())
    fine = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in fine:
        if q % 3 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(fine[q], e)), i) for i, e in fine.items() if i != q and len(e) == len(fine[q])))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert got == sorted(want)
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


def test_top_k_blocks_meet_without_the_driver(spark):
    v = spark.range(40).select(F.col("id"), F.array(F.col("id"), F.lit(1).cast("long")).alias("v"))
    pairs = topk.met(topk.blocked(v.where("id % 4 = 0"), "q"), topk.blocked(v, "c"), 1, 1)
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and "SortMergeJoin" in text and pairs.count() == 1


def test_top_k_of_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 1.0, 1.0, 1.0])] + [(1, [9.0 + i] * 4) for i in range(6)] + [(i, [float(i)] * 4) for i in range(2, 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(v, v.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(0, r + 1, i, 4 * 256 * 256 * x) for r, (i, x) in enumerate([(1, 14), (7, 7), (6, 6), (5, 5), (4, 4)])]


# bytes --------------------------------------------------------------------------------------------------------------

def bytes_by_hand(rows, length=suffix_dedup.LENGTH):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                gone[i:i + length] = True
            seen.add(s)
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()),
                  bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("together", [suffix_dedup.TOGETHER, 2])
def test_byte_dedup(spark, monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    rng = np.random.default_rng(3)
    prose = lambda n: "".join(rng.choice(list("abcdefgh ä"), n))
    a, b = prose(400), prose(230)
    rows = [(1, a), (2, "x" + a[50:300] + "y"), (3, b + a[:99] + b), (4, None), (5, ""), (6, "aaaa" * 100), (7, "ab" * 120),
            (8, a[:150] + b[:120] + a[150:]), (9, prose(99)), (10, "z" * 100), (None, a[100:260])]
    rows += [(20 + i, prose(40) + b[40:180] + prose(40)) for i in range(8)]
    df = texts(spark, rows).withColumn("spans", F.lit(1)).withColumn("n_spans", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup_bytes(df).collect()}
    assert got == bytes_by_hand(rows)
    assert suffix_dedup.dedup_bytes(df.limit(0)).count() == 0
    twice = suffix_dedup.dedup_bytes(texts(spark, [(1, a), (1, a), (2, a)])).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, twice)) == [(1, 0), (1, 0), (2, len(a.encode()))]


# BPE ----------------------------------------------------------------------------------------------------------------

def test_bpe_keeps_a_bounded_number_of_bytes(monkeypatch):
    """Text without spaces is a new stretch and new words in every text; nothing of it stays."""
    monkeypatch.setattr(bpe, "KEPT_WORDS", 500)
    monkeypatch.setattr(bpe, "KEPT_STRETCHES", 300)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 1000)
    v = bpe.public_vocabulary().load()
    rng = np.random.default_rng(1)
    for k in range(12):
        chinese = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 3000))) for _ in range(20)]
        lines = ["\n".join(f"line{i}x{k}" for i in range(400)), base64.b64encode(rng.bytes(20_000)).decode()]
        spaced = [" ".join(f"w{rng.integers(10**9)}" for _ in range(2000))]
        texts = chinese + lines + spaced
        for t, ids in zip(texts, v.encode(texts)):
            assert v.decode(np.frombuffer(ids, "<i4").tolist()) == t.encode()
        for cache, most in ((v.words, 500), (v.stretches, 300)):
            assert len(cache) <= most and sum(len(a.encode()) + len(b) for a, b in cache.items()) <= most * bpe.KEPT_CHARS * 8
    assert len(v.pairs) <= 1000 + 70_000


def test_bpe_round_trip(spark):
    import public_tokenizers
    import tiktoken
    v = bpe.public_vocabulary()
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(1)
    rows = [None, "", " ", "\n\n  x", "<|endoftext|> don't", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "ñandú 東京 🎉 é", "\x00�", "a" * 5000, "  x", " a  b\n c \x1c d\u00a0e \u2003 f\t", "a \x85 b\x1fc", "it's  don't' s",
            "Ab1 " * 3000] + ["".join(chr(int(c)) for c in rng.choice([*range(9, 127), *[32] * 40, 0xA0, 0x85, 233, 0x4E2D, 0x1F600, 10], 200)) for _ in range(60)]
    df = texts(spark, list(enumerate(rows)) + [(1, "")]).withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, v), v)
    for r in out.collect():
        t = rows[r["doc_id"]] or ""
        assert r["ids"] == enc.encode_ordinary(t) and bytes(r["decoded"]).decode() == t
    one = {r["doc_id"]: r for r in bpe.digests(bpe.decode(bpe.encode(df, v, packed=True), v)).collect()}[4]
    at_once = bpe.encode(df, v, packed=True, decoded_col="decoded")
    assert "text" not in at_once.columns
    assert {r["doc_id"]: r for r in bpe.digests(at_once).collect()}[4] == one
    ids = enc.encode_ordinary(rows[4])
    assert one["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(df.limit(0), v).count() == 0


def test_replay_goes_back_to_lower_ranks():
    # "abc" was learned from a + bc before "ab": a merge opens a pair of a lower rank
    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([*(bytes([b]) for b in range(256)), b"xab", b"ab"]))
    v = bpe.Vocabulary(lines, ".+").load()
    ids = [np.frombuffer(x, "<u4").tolist() for x in v.replay([b"xabab", b"ab", b"", b"abxab"])]
    assert ids == [[256, 257], [257], [], [257, 256]]


# language -----------------------------------------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba"]
    index = {p: i for i, p in enumerate(pieces)}
    probs = np.array([[0.4], [0.3], [0.2], [0.1], [1e-7], [0]])
    p = dict(zip(pieces, probs[:, 0]))

    def total(s):
        return 1.0 if not s else sum(p[x] * total(s[len(x):]) for x in pieces if s.startswith(x))

    parts = ["a", "ab", "abab", "bba", "baab"]
    lattice = langid.Lattice(index, parts)
    assert np.allclose(lattice.total(lattice.forward(probs))[:, 0], [total(s) for s in parts])
    uses = lattice.expected(probs, np.ones((len(parts), 1)))
    assert np.isclose(sum(uses[i, 0] * len(x) for x, i in index.items()), sum(map(len, parts)))


def test_language_id(spark):
    import public_tokenizers
    words = {"xx": ["the", "and", "house", "with"], "yy": ["der", "und", "haus", "mit"]}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "12 ½ ---", "xx"), (903, "house " * 5000, None), (None, "haus und", "zz"), (904, "q" * 500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, langid.public_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    assert model.languages == ["xx", "yy"]
    out = {r["doc_id"]: r for r in langid.identify(df.withColumn("score", F.lit("clash")), model).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert [out[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit(df.limit(0), ["a"])).collect()} == {"und"}


# near-duplicates ----------------------------------------------------------------------------------------------------

def links_by_hand(rows):
    sets = {}
    for d, t in rows:
        w = forest_join.WORD.findall((t or "").lower())
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group, links = {d: d for d in sets}, Counter()

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    return {d: (top(d), links[d]) for d in sets}


@pytest.mark.parametrize("blocks", [None, 3])
def test_jaccard_join(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(forest_join, "BUCKET_BLOCK", blocks)
        monkeypatch.setattr(forest_join, "GROUP_BLOCK", blocks)
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for base in range(6):
        w = [f"b{base}w{rng.integers(60)}" for _ in range(120)]
        for _ in range(9):
            c = list(w)
            for _ in range(int(rng.integers(0, 3))):
                c[int(rng.integers(len(c)))] = f"new{rng.integers(1000)}"
            rows.append((n, " ".join(c)))
            n += 1
    rows += [(100, None), (101, ""), (102, "..."), (103, "two words"), (104, "Two, words"), (105, "other words"), (106, rows[0][1].upper())]
    df = texts(spark, rows).withColumn("id", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in forest_join.similar(df).collect()}
    assert got == links_by_hand(rows)
    kept = {r["doc_id"] for r in forest_join.dedup(df).collect()}
    assert kept == {c for c, _ in got.values()}
    again = forest_join.similar(texts(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]))
    assert sorted(map(tuple, again.select("id", "class_id", "n_links").collect()), key=str) == [(1, 1, 1), (2, 1, 1), (None, None, 0)]
    assert forest_join.similar(df.limit(0)).count() == 0


def test_depth_reaches_recall():
    k = forest_join.depth_for(0.999, 0.8, 16, 8)
    assert 1 - (1 - 0.8 ** k) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (k + 1)) ** 16


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 103), (103, 101), (7, 7), (200, 100)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in (100, 101, 103, 200)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# chat ---------------------------------------------------------------------------------------------------------------

def test_reply_trees(spark):
    m = spark.createDataFrame(
        [("t", 1, None, 1.0, "user", "hi"), ("t", 2, 1, 5.0, "assistant", "good </turn>\n### user: x"), ("t", 3, 1, 1.0, "assistant", None),
         ("t", 4, 2, 0.0, "user", "\\h # <"), ("t", 5, 4, None, "assistant", "done\\"), ("t", 6, 99, 2.0, None, "orphan"),
         ("u", 1, 2, 1.0, "user", "loop"), ("u", 2, 1, 1.0, "user", "loop"), ("v", 1, None, None, "a: b", "")],
        "tree string, node long, parent long, score double, role string, text string")
    paths = sorted((r["tree"], r["rank"], r["depth"], r["node"]) for r in chat.reply_paths(m).collect())
    assert paths == [("t", 1, 0, 6), ("t", 2, 0, 1), ("t", 2, 1, 2), ("t", 2, 2, 4), ("t", 2, 3, 5), ("t", 3, 0, 1), ("t", 3, 1, 3), ("v", 1, 0, 1)]
    out = chat.format_trees(m).withColumn("said", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.masked_text(F.col("formatted"), F.col("mask")))
    rows = {(r["tree"], r["rank"]): r for r in out.collect()}
    assert [tuple(x) for x in rows["t", 2]["said"]] == [("user", "hi"), ("assistant", "good </turn>\n### user: x"), ("user", "\\h # <"), ("assistant", "done\\")]
    assert rows["t", 2]["loss"] == "good </turn>\n### user: xdone\\" and rows["t", 3]["loss"] == ""
    assert [tuple(x) for x in rows["v", 1]["said"]] == [("a: b", "")] and [tuple(x) for x in rows["t", 1]["said"]] == [("", "orphan")]
    assert {r["rank"] for r in chat.reply_paths(m, best=1).collect()} == {1}
    assert chat.format_trees(m.limit(0)).count() == 0


def test_long_threads(spark):
    rows = [(1, i, "user", f"m{i}") for i in range(300)] + [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "user", "b"), (3, 1, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["tree"]: r["formatted"] for r in chat.format_trees(chat.threads(turns)).collect()}
    assert got[1] == "".join(f"### user: m{i}</turn>\n" for i in range(300))
    assert got[2] == "### user: b</turn>\n### user: a</turn>\n### user: a</turn>\n" and got[3] == "### : </turn>\n"


# pages --------------------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    rows = [(1, "http://a/1", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, "http://a/2\nX: y", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (3, None, None), (4, "u", ""),
            (5, "u", "other"), (5, "u", "other"), (None, "n", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = work_path(spark, "archives")
    warc.write(pages, path)
    found = warc.read(spark, path)
    got = sorted((str(r["record_id"]), r["record_type"], r["payload_bytes"], r["refers_to"], r["payload_digest"]) for r in found.collect())
    size = len(rows[0][2].encode())
    code = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert got == sorted([("1", "response", size, None, code(rows[0][2])), ("2", "revisit", size, 1, code(rows[0][2])), ("3", "response", 0, None, code("")),
                          ("4", "revisit", 0, 3, code("")), ("5", "response", 5, None, code("other")), ("5", "response", 5, None, code("other")),
                          ("None", "response", 5, None, code("other"))])
    whole = {str(r["record_id"]): bytes(r["payload"]).decode() for r in warc.resolve(found).collect()}
    assert whole == {str(i): h or "" for i, _, h in rows}
    warc.write(pages, short := work_path(spark, "archives"), min_bytes=6)
    assert warc.read(spark, short).where("record_type = 'revisit'").count() == 1
    warc.write(pages.limit(0), none := work_path(spark, "archives"))
    assert warc.read(spark, none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a>Home</a><li><a>More</a></ul></nav><div class="cookie-notice">We use</div>
%s<aside>side</aside><div id="comments"><p>a reader</p></div><form><p>send</p></form><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    article = "<article><h1>A &amp; B</h1><p><b>Lead</b>ing\n text<br>on<p>Next<div class='ad-box'>buy</div></p><!-- c --><ul><li>one<li>two</ul></article>"
    rows = [(1, "http://h.org/1", PAGE % article), (2, "http://h.org/2", PAGE % "<article><p>Only</p></article>"), (3, "http://h.org/3", None),
            (4, None, ""), (5, "http://h.org/5", (PAGE % article)[:(PAGE % article).index("Next") + 3]),
            (6, "http://plain.org/1", PAGE % "<div class=wrap><div class=body><p>Long text of a page</p><p>and more of it</p></div></div>"),
            (7, "x", "just words &lt;here"), (8, "http://h.org/8", "<article>cut <p"), (1, "http://h.org/1", PAGE % article)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit(1))
    out = {r["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert out == {1: "A & B Leading text on Next one two", 2: "Only", 3: "", 4: "", 5: "A & B Leading text on Nex",
                   6: "Long text of a page and more of it", 7: "just words <here", 8: "cut"}
    assert wrappers.main_text(pages.limit(0)).count() == 0


def test_wrapper_finds_optional_and_repeated_places():
    a = wrappers.wrapper_of(wrappers.tree("<div><h1>x</h1><p>1</p><p>2</p></div>"))
    b = wrappers.wrapper_of(wrappers.tree("<div><p>1</p><hr></div>"))
    both = wrappers.align(a, b)
    h1, p, hr = both.kids[0].kids
    assert (h1.key, h1.optional) == ("h1", True) and (p.key, p.repeated, p.optional) == ("p", True, False) and (hr.key, hr.optional) == ("hr", True)


def test_page_wrapper_with_an_aside_word_keeps_its_article(spark):
    head, nav, end = "<html><head><title>T</title></head><body>", "<nav>Home</nav>", "<footer>x</footer></body></html>"
    told, talk = "<p>Told %d at some length</p>", '<div class="comments"><p>a reader</p></div><form><p>send</p></form>'
    bodies = {"article": f"<div id=page class='site right-sidebar'>{nav}<article>{told}{talk}</article>{talk}</div>",
              "class": f"{nav}<div class='content no-comments'>{told}<div class=sidebar>side</div></div>",
              "section": f"{nav}<section class='search-rescue'><div>{told}</div></section>",
              "inside": f"{nav}<article><h1></h1><div class='content no-comments'>{told}</div></article>",
              "form": f"<form id=main-form>{nav}<div>{told}</div><input><select><option>no</select></form>",
              "main": f"<form>{nav}<div class=main>{told}</div></form>",
              "teaser": f"<div>{told}<p>{'more of the text ' * 9}</p></div><div class=sidebar><article>teaser</article></div>"}
    rows = [(f"{host}{i}", f"http://{host}.org/{i}", head + body % i + end) for host, body in bodies.items() for i in (1, 2)]
    rows += [(f"head{i}", f"http://head.org/{i}", f"<html><head><meta charset=u><title>T</title>{body}{nav}<article>{told % i}</article>{end}")
             for i, body in ((1, "<body>"), (2, ""))]
    out = {r["id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "id string, url string, html string")).collect()}
    more = " " + ("more of the text " * 9).strip()
    assert out == {f"{host}{i}": f"Told {i} at some length" + (more if host == "teaser" else "") for host in [*bodies, "head"] for i in (1, 2)}


def test_long_comments_do_not_take_the_articles_place(spark):
    talk = f"<div class=comments><p>{'a reader says ' * 200}</p></div>"
    rows = [(i, f"http://h{i}.org/", f"<html><body>{body}{talk}</body></html>") for i, body in
            enumerate(("<article><p>Told</p></article>", "<main><p>Told</p></main>"))]
    out = {r["id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "id long, url string, html string")).collect()}
    assert out == {0: "Told", 1: "Told"}


def test_pages_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST_HOSTS", 0)
    test_main_text(spark)
