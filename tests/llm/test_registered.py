"""The registered queries: next to their SQL, and the others by brute force over the small tables."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest

from forewarn.llm.queries import QUERIES, SQL
from tests.oracle import rows_of

from .test_operators import bytes_by_hand, links_by_hand


def rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    cur = duck.execute(SQL[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_jaccard_join(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in rows(spark, sf, "documents")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in QUERIES["op10_ngram_jaccard_join"](spark, sf).collect()}
    assert got == links_by_hand(docs)


def test_byte_dedup(spark, sf):
    want = bytes_by_hand([(r["doc_id"], r["text"]) for r in rows(spark, sf, "documents")])
    for r in QUERIES["op7_suffix_array_dedup"](spark, sf).collect():
        n, removed, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_bpe(spark, sf):
    import public_tokenizers
    import tiktoken
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in rows(spark, sf, "documents")}
    for r in QUERIES["op9_byte_bpe"](spark, sf).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_language_id_on_held_out(spark, sf):
    langs = {r["doc_id"]: r["lang"] for r in rows(spark, sf, "documents")}
    out = [r for r in QUERIES["op6_language_id"](spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in out) >= 0.97 * len(out)


def test_main_text(spark, sf):
    import html
    import re
    pages = {r["page_id"]: r["html"] for r in rows(spark, sf, "pages")}
    for r in QUERIES["op5_html_extraction"](spark, sf).collect():
        inner = re.search(r"(?s)<article>(.*?)(</article>|$)", pages[r["page_id"]])[1]
        inner = re.sub(r"<[^>]*$", "", inner)
        inner = re.sub(r"<[^>]+>", lambda m: "" if re.fullmatch(r"</?b>", m[0]) else " ", inner)
        assert r["text"] == " ".join(html.unescape(inner).split()) and r["n_chars"] == len(r["text"])


def test_decontamination(spark, sf):
    """Every item that stands in a document word for word is found; what is found has a run of mostly equal words."""
    import regex
    word = regex.compile(r"[\p{L}\p{N}]+")
    docs = {r["doc_id"]: word.findall((r["text"] or "").lower()) for r in rows(spark, sf, "documents")}
    items = {r["item_id"]: word.findall(r["text"].lower()) for r in rows(spark, sf, "benchmark")}
    want = set()
    for i, x in items.items():
        at = {t: [k for k, y in enumerate(x) if y == t] for t in x}
        for d, w in docs.items():
            shifts = Counter(j - k for j, t in enumerate(w) for k in at.get(t, ()))
            for shift in (s for s, n in shifts.items() if n >= 11):
                same = [w[k + shift] == x[k] for k in range(len(x)) if 0 <= k + shift < len(w)]
                if len(same) >= 13 and max(sum(same[k:k + 13]) for k in range(len(same) - 12)) >= 11:
                    want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_benchmark_decontamination"](spark, sf).collect()}
    assert got == want and got


def test_pipeline(spark, sf):
    import corpus_pipeline as p
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in p.STAGES:
        steps.append(stage(spark, steps[-1], sf).cache())
    assert all(set(s.columns) == set(docs.columns) for s in steps[1:4])
    sizes = [s.count() for s in steps]
    assert sizes[0] >= sizes[1] >= sizes[3] > sizes[4] == sizes[5] > 0 and sizes[1] == sizes[2]
    classes = {c for c, _ in links_by_hand([(r["doc_id"], r["text"]) for r in steps[2].collect()]).values()}
    assert {r["doc_id"] for r in steps[3].collect()} == classes
    text = {r["doc_id"]: r["text"] or "" for r in steps[4].collect()}
    for r in p.run(spark, sf).collect():
        assert r["decoded_sha256"] == hashlib.sha256(text.pop(r["doc_id"]).encode()).hexdigest()
    assert not text
    none = docs.limit(0)
    for _, stage in p.STAGES:
        none = stage(spark, none, sf)
    assert none.count() == 0


def test_pipeline_keeps_clashing_columns(spark, sf):
    import corpus_pipeline as p
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    own = {c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in ("score", "lang_pred", "n_lines", "n_dropped", "batch", "key")}
    now = docs.withColumns(own).cache()
    for name, stage in p.STAGES[:4]:
        now = stage(spark, now, sf).cache()
        assert now.columns == docs.columns + list(own), name
        for r in now.collect():
            assert all(r[c] == f"{c} of {r['doc_id']}" for c in own), name
    assert now.count() > 0


def test_all_operators_are_registered():
    """The entry point leaves them out only where they cannot be imported, which must not happen here."""
    import __spark_entry__ as e
    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert {n for n in e.oracle_sql() if n.startswith("op")} == set(SQL)
