"""The pipeline's stages, each on what its predecessor kept."""

import re

import corpus_pipeline
import numpy as np
from test_pairs import Sets
from test_text import brute_score, brute_spans, brute_stats, brute_terms
from tokenizers import Tokenizer

from cellweave.llm import quality_rules, toxicity
from cellweave.llm.queries import vocabulary

SF = "/root/testdata/sf0.01"
LOWER = {ord("A") + k: ord("a") + k for k in range(26)}


def brute_toxicity(rows, labels):
    model = toxicity.fit(*labels)
    return {i for i, r in rows.items() if brute_score(r["text"] or "", model.weights, model.bias) < 0.7}


def brute_quality(rows, labels):
    rules = quality_rules.fit(*labels)
    kept = set()
    for i, r in rows.items():
        text = r["text"] or ""
        words, chars, symbols, dup, repeat = brute_stats(text)
        w, c, lines = max(words, 1), max(chars, 1), text.count("\n") + 1
        x = {"mean_word_chars": chars / w, "symbols_per_word": symbols / w, "dup_line_share": dup / lines, "repeat_share": repeat / w, "upper_share": len(re.findall("[A-Z]", text)) / c, "punct_per_word": len(re.findall(r"[!-/:-@\[-`{-~]", text)) / w, "digit_share": len(re.findall("[0-9]", text)) / c, "words_per_line": words / lines, "n_words": words}
        rejected = any(all((x[p.feature] >= p.threshold) == p.above for p in rule) for rule in rules)
        if words >= 10 and 100 * repeat <= 20 * words and not rejected:
            kept.add(i)
    return kept


def brute_near_duplicates(rows):
    """The least id of each component of all pairs at 0.8 or more, counted on every pair of texts."""
    sets = {}
    for i, r in rows.items():
        words = [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")]
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    order, found = sorted(sets), Sets()
    links = 0
    for k, i in enumerate(order):
        found.find(i)
        for j in order[:k]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (a == b or len(a & b) >= 0.8 * len(a | b)):
                found.join(i, j)
                links += 1
    assert links > 20
    return {i for i in order if found.find(i) == i}


def brute_sanitised(text):
    out, at = [], 0
    for start, kind, end in brute_spans(text):
        if start >= at:
            out += [text[at:start], f"[{['EMAIL', 'IP', 'CARD', 'PHONE'][kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality_rules", "near_duplicates", "pii", "packing"]
    at = docs
    before = {r["doc_id"]: r for r in at.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from cellweave.llm.common import write_table

        given, at = at, write_table(stage(spark, at, SF), f"test_{name}")
        assert at.dtypes == docs.dtypes
        after = {r["doc_id"]: r for r in at.collect()}
        if name == "pii":
            assert not brute_terms([(i, r["text"]) for i, r in before.items()])  # no term of these texts reveals a value
            assert {i: r["text"] for i, r in after.items()} == {i: brute_sanitised(r["text"] or "") for i, r in before.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        else:
            brute = {"toxicity": lambda: brute_toxicity(before, (given, labels)), "quality_rules": lambda: brute_quality(before, (given, labels)), "near_duplicates": lambda: brute_near_duplicates(before)}[name]  # noqa: B023
            assert set(after) == brute() and 0 < len(after) < len(before)
            assert all(after[i] == before[i] for i in after)
        before = after
    pieces = stages["packing"](spark, at, SF).collect()
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    sizes = {}
    for p in pieces:
        sizes[p["doc_id"]] = sizes.get(p["doc_id"], 0) + p["length"]
    assert sizes == {i: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in before.items()}
    assert np.ptp([p["sequence_id"] for p in pieces]) + 1 == len({p["sequence_id"] for p in pieces})


def test_run_gives_the_pieces_of_all_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(rows[0].asDict())


def test_edge_rows_pass_every_stage(spark, edge, empty, labels):
    model = toxicity.Model({})
    assert toxicity.drop_toxic(edge, model).count() == edge.count()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, edge, SF)
        assert got.count() > 0
        if name != "packing":
            assert got.columns == edge.columns and got.where("score <> 'score!' OR node <> 'node!' OR part <> 'part!' OR ids <> 'ids!'").isEmpty()
        assert stage(spark, empty, SF).count() == 0
    plain = stage(spark, edge.select("doc_id", "text"), SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
