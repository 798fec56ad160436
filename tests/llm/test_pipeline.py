import math
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm import test_decontaminate, test_ngram_join, test_quality_rules
from veilscan.llm import quality_rules as Q
from veilscan.llm import token_output


def brute_kept(rows, labels, alpha=0.02, delta=0.05):
    """Ids that stay, and those that a cutoff alone rejects, with the cutoffs worked out in Python."""
    counts, top = {}, {}
    for r in rows:
        n, _, symbols, dup, rep = test_quality_rules.brute(r.text)
        lines = sum(1 for x in (r.text or "").split("\n") if test_quality_rules.SPACE.sub("", x))
        counts[r.doc_id] = n, rep
        top[r.doc_id] = max(symbols / max(n, 1), (r.text or "").count("!") / max(n, 1), dup / max(lines, 1), rep / max(n, 1))
    held = [(r.lang, labels[r.doc_id], top[r.doc_id]) for r in rows if r.doc_id in labels]
    strata = {h[0] for h in held}
    cuts = {}
    for s in strata:
        n, safe = sum(h[0] == s and h[1] for h in held), []
        for c in sorted(Q.GRID, reverse=True):
            fp = sum(h[0] == s and h[1] and h[2] >= c for h in held)
            tp = sum(h[0] == s and not h[1] and h[2] >= c for h in held)
            tail = sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(fp + 1))
            if fp >= n * alpha or tail > delta / len(strata):
                break
            safe.append((tp - 10 * fp, c))
        if safe and max(safe)[0] > 0:
            cuts[s] = max(safe)[1]
    stay, cut = set(), set()
    for r in rows:
        n, rep = counts[r.doc_id]
        if n >= 20 and 100 * rep <= 30 * n:
            (cut if top[r.doc_id] >= cuts.get(r.lang, math.inf) else stay).add(r.doc_id)
    return stay, cut


def test_each_stage_against_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs.collect()
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs.collect()
        assert name == "tokens" or docs.columns == columns
    before, after = seen["quality"]
    labels = {}
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        labels[r.doc_id] = labels.get(r.doc_id, False) or r.quality >= 1
    stay, cut = brute_kept(before, labels)
    assert {r.doc_id for r in after} == stay and cut and len(after) < len(before)
    assert set(map(tuple, after)) <= set(map(tuple, before))

    before, after = seen["near_duplicates"]
    want = {key for key, _, component in test_ngram_join.brute([(r.doc_id, r.text) for r in before]) if key == component}
    assert {r.doc_id for r in after} == want and len(after) == len(want) < len(before)

    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    bad = {k for k, _ in test_decontaminate.brute([(r.doc_id, r.text) for r in before], items)}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad and bad

    before, after = seen["mixing"]
    size = {r.doc_id: len(r.text.split()) for r in before}
    taken, words = {}, {r.doc_id: set(r.text.split()) for r in before}
    for r in after:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
        assert set(r.text.split()) <= words[r.doc_id] and r.n_chars == len(r.text)
    assert all(v <= 2 * size[k] for k, v in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 20

    before, after = seen["tokens"]
    tok = Tokenizer.from_file(token_output.default_tokenizer())
    at = 0
    for r, got in zip(sorted(before, key=lambda r: (r.doc_id, r.text)), sorted(after, key=lambda r: r.start), strict=True):
        ids = tok.encode(r.text, add_special_tokens=False).ids + [1]
        assert tuple(got) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_odd_and_empty_documents_go_through(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "a " * 30_000, None, "s", 1), (3, " ".join(f"w{i}" for i in range(50)), None, None, None), (3, " ".join(f"w{i}" for i in range(50)), None, None, None)]
    for n, rows in enumerate((odd, [])):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in P.STAGES:
            stage(spark, docs, d).write.parquet(f"{tmp_path}/{n}{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}{name}")
            if name == "mixing" and rows:
                before = {id_: len(text.split()) for id_, text, *_ in odd if id_ == 3}
                assert sum(len(r.text.split()) for r in docs.collect()) <= 2 * sum(before.values())
        assert {r.doc_id for r in docs.collect()} == ({3} if rows else set())
