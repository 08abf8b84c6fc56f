"""The corpus pipeline on the smallest documents, stage by stage against plain versions that call none of its operators."""

import hashlib
from collections import Counter

import numpy as np
import plain
import public_tokenizers
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from talweg.llm import secrets
from talweg.llm.common import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = written(stage(spark, docs, sf), name)
        after = [r.asDict() for r in docs.collect()]
        got = Counter((r["doc_id"], r.get("text")) for r in after)
        if name == "quality":
            score = plain.quality_scores({r["doc_id"]: r["text"] for r in before}, labels)
            sure = [r for r in before if abs(score[r["doc_id"]] - 0.3) > 0.01]
            assert len(sure) > 0.95 * len(before) and {r["doc_id"] for r in sure if score[r["doc_id"]] >= 0.3} == {r["doc_id"] for r in sure} & {i for i, _ in got}
        if name == "near_duplicates":
            before.sort(key=lambda r: r["doc_id"])
            root = plain.groups([plain.simhash(r["text"]) for r in before])
            assert got == Counter((r["doc_id"], r["text"]) for i, r in enumerate(before) if root[i] == i)
        if name == "secrets":
            words = Counter(w for r in before for w in {w for w in plain.WORD.findall(r["text"].lower()) if w.isascii() and w.isalpha() and 4 <= len(w) <= 14})
            forest = secrets.fit(secrets.example_findings(spark), tuple(w for w, n in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:1000] if n > 1))
            p = plain.Secrets(secrets, forest)
            assert got == Counter((r["doc_id"], p.redacted(r["text"])) for r in before)
        if name == "mixing":
            sizes = [(r["doc_id"], r["source"], plain.size(r["text"])) for r in before]
            taken, _ = plain.mixed(sizes, None)
            want = Counter()
            for r, s, k in zip(before, sizes, taken):
                want[r["doc_id"], r["text"]] += k // s[2] if s[2] else 0
            assert got == +want
        if name == "tokens":
            plainly = Counter((r["doc_id"], hashlib.sha256(np.array(encoding.encode_ordinary(r["text"] or ""), "<u4").tobytes()).hexdigest()) for r in before)
            assert Counter((r["doc_id"], r["ids_sha256"]) for r in after) == plainly


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, repeated rows, clashing columns and no rows at all."""
    odd = [(1, "one two three " * 30, None, None, None), (1, "one two three " * 30, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "a " * 5000, "en", "s", 10_000), (None, "x y z", "en", "t", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (odd, []):
        docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema + ", size int, score int, ids int")
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf), name)
            assert name == "tokens" or docs.columns == corpus_pipeline.COLUMNS
        assert docs.count() <= 2 * len(rows)
