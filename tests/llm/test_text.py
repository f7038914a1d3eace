"""Text operators against brute force and held-out rows."""

import hashlib
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cellweave.llm import language_id, pii, quality_rules, queries, toxicity

SF = "/root/testdata/sf0.01"


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_statistics(docs, edge):
    for df in (docs, edge):
        got = quality_rules.text_stats(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert sorted(map(tuple, got), key=str) == sorted(((i, *brute_stats(t)) for i, t in pairs(df)), key=str)


def test_repeat_words_with_many_distinct_words():
    words = [b"%d" % (k % 9000) for k in range(20_000)]
    assert quality_rules.repeat_words(words) == 20_000
    assert quality_rules.repeat_words(words[:9000]) == 0


def test_decision_list_separates_and_emits_case():
    rng = np.random.default_rng(1)
    x = {k: rng.random(3000) for k in quality_rules.features()}
    bad = (x["upper_share"] > 0.8) & (x["punct_per_word"] > 0.5) | (x["dup_line_share"] > 0.9)
    rules = quality_rules.learn(x, bad, np.arange(3000) % 3 == 1)
    rejected = np.zeros(3000, bool)
    for r in rules:
        rejected |= quality_rules._covers(r, x)
    assert (rejected & ~bad).sum() <= 30 and (rejected & bad).sum() >= 0.9 * bad.sum()
    assert "CASE WHEN" in str(quality_rules.keeps(rules))
    assert quality_rules.learn(x, np.zeros(3000, bool), np.arange(3000) % 3 == 1) == []


def test_quality_verdicts(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels)
    judged = quality_rules.judge(docs, rules).join(labels, "doc_id").where("quality is not null").toPandas()
    assert judged[(judged.quality == 0)].kept.mean() < 0.05
    assert judged[(judged.quality == 1) & ~judged.base_failed].kept.mean() > 0.98
    assert quality_rules.judge(edge, rules).count() == edge.count()
    assert quality_rules.fit(edge, labels.limit(0)) == []
    assert quality_rules.judge(empty, rules).count() == 0
    kept = quality_rules.drop_rejected(edge, [])
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} >= {5, 9}


# The base patterns as the contract words them.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    checks = [(EMAIL, lambda m: True), (IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))), (CARD, lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), (PHONE, lambda m: 10 <= len(digits(m)) <= 15)]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(checks) for m in p.finditer(text) if ok(m))


TRICKY = ["a@b.com_x@y.zz q.w@e.r.t..u@v", "1.2.3.4.5.6.7.8 999.1.1.1.1 0255.01.1.1", "x@y @z.com a@@b.c", "+1+12345678901 +1 (22) 333-4444 5", "4111-1111 1111 1111 4111111111111112", "é+49 30 1234567 ünï@ex.de 😀 a.b@c.d", "12.34.56.78a@b.c", "5500 0000 0000 0004" * 3, "." * 50 + "@a.b", "+1 1)))" * 40]


def test_base_spans(spark, docs, edge):
    tricky = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for df in (tricky, edge, docs):
        got = pii.with_spans(df.select("doc_id", "text")).select("doc_id", "text", pii.written(F.col("base")).alias("w")).collect()
        for r in got:
            assert r["w"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(r["text"])), r["text"][:200]


def test_many_spans_and_long_runs(spark):
    text = "m1@x.org " * 3000 + "7" * 20_000 + "." * 5000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.with_spans(df).select(F.size("base").alias("n")).first()
    assert row["n"] == 3000


def test_terms_that_reveal_an_entity_go(spark):
    rng = random.Random(1)
    other = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12))
    rows = [(k, f"{other()} about Zorblax agent {other()} mail kim@corp.example today {other()}") for k in range(6)]
    rows += [(100 + k, f"nothing about today and agent number{k} mail") for k in range(300)]
    rows += [(900 + k, "copy of one text with Quuxfoo and lee@corp.example") for k in range(20)]
    near = other() + " Quuxbar and " + other()
    rows += [(950 + k, f"{'abcdefgh'[k] * 5} {near} {'abcdefgh'[k] * 9} max@corp.example {'abcdefgh'[k] * 7}") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(df).select("doc_id", "text", "extra", pii.sanitised().alias("clean"), pii.written(pii.all_spans()).alias("spans")).collect()}
    for k in range(6):
        assert "zorblax" in {found[k]["text"][e["start"] : e["end"]].lower() for e in found[k]["extra"]}
        assert "Zorblax" not in found[k]["clean"] and "[EMAIL]" in found[k]["clean"] and "today" in found[k]["clean"]
    # No evidence from copies, and no change without an entity.
    assert not found[950]["extra"] and not found[951]["extra"]
    assert not found[900]["extra"] and found[900]["clean"].endswith("[EMAIL]")
    assert all(found[100 + k]["clean"] == found[100 + k]["text"] for k in range(300))


def test_terms_far_from_a_rare_entity_go(spark):
    rng = random.Random(1)
    far = "plain words of no account " * 40
    other = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    rows = [(k, f"Zorblax{k} Zorblax opens {other()} {far} and mail kim@corp.example in week {'abc'[k]}{'xyz'[k]}") for k in range(2)]
    rows += [(10 + k, f"single Quuxfoo{k} {far} mail once{k}@corp.example") for k in range(1)]
    rows += [(100 + k, f"{far} opens single number{k} and mail in week {k}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(df).select("doc_id", "text", "extra", pii.sanitised().alias("clean")).collect()}
    for k in range(2):
        assert {found[k]["text"][e["start"] : e["end"]] for e in found[k]["extra"]} == {"Zorblax"} and len(found[k]["extra"]) == 2
        assert "Zorblax" not in found[k]["clean"]
    assert not found[10]["extra"] and all(not found[100 + k]["extra"] for k in range(400))


def brute_terms(rows, generalise_at=0.8, remove_at=0.95):
    """The term spans of each distinct text, by the definitions in the module's docstring."""
    texts = sorted({t for _, t in rows if t is not None})
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    checks = [(EMAIL, lambda m: True), (IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))), (CARD, lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), (PHONE, lambda m: 10 <= len(digits(m)) <= 15)]
    holders, around = {}, {}
    for t in texts:
        for k, (p, ok) in enumerate(checks):
            every = list(p.finditer(t))
            for i, m in enumerate(every):
                if ok(m):
                    left = t[every[i - 1].end() if i else 0 : m.start()][-pii.REACH :]
                    right = t[m.end() : every[i + 1].start() if i + 1 < len(every) else None][: pii.REACH]
                    e = (k, m[0].lower())
                    holders.setdefault(e, set()).add(t)
                    key = (e, left, right)
                    witness = (hashlib.md5(t.encode()).digest(), t)
                    around[key] = min(around.get(key, witness), witness)
    terms = {t: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", t)} for t in texts}
    hashed = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    number = lambda w, k: hashed(struct.pack("<i", k), hashed(struct.pack("<Q", hashed(w.encode(), 42)), 42))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    n_t = Counter(w for t in texts for w in terms[t])
    wanted = {}
    for e, own in holders.items():
        witnesses = {w for (x, _, _), w in around.items() if x == e}
        for n in range(pii.WITNESS):
            least = {}
            for w in sorted(witnesses, reverse=True):
                least[min((signed(number(x, n)) for x in terms[w[1]] if n_t[x] ** 2 <= len(texts)), default=None)] = w
            witnesses = set(least.values())
        stands = {t for _, t in witnesses}
        base = len(stands) / len(texts)
        if len(stands) < 2 or base == 1:
            continue
        for w in set().union(*(terms[t] for t in own)):
            k, both = sum(w in terms[t] for t in stands), sum(w in terms[t] for t in own)
            if k > 1:
                ratio = np.log2((k - 1 + base) / (n_t[w] - both + k) / base) / -np.log2(base)
                if ratio >= generalise_at:
                    for t in own:
                        if w in terms[t]:
                            wanted.setdefault(t, {})
                            wanted[t][w] = wanted[t].get(w, False) or bool(ratio >= remove_at)
    out = {}
    for t, own in wanted.items():
        spans = brute_spans(t)
        places = [(m.start(), m.end(), own[m[0].lower()]) for m in re.finditer(r"[^\W\d_]{4,}", t) if m[0].lower() in own]
        places = [p for p in places if not any(a < p[1] and b > p[0] for a, _, b in spans)]
        if places:
            out[t] = places
    return out


def found_terms(df):
    got = {r["text"]: [(e["start"], e["end"], e["removed"]) for e in r["extra"]] for r in pii.find(df.select("doc_id", "text")).select("text", "extra").collect()}
    return {t: v for t, v in got.items() if v}


def test_terms_equal_brute_force(spark, docs):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in ("alpha", "Beta", "gamma", "delta", "omega") for b in "abcdefghijklmnopqrst" for c in "uvwxyz"]
    entities = [f"u{k}@host{k}.org" for k in range(12)] + ["+1 212 555 0100", "10.2.3.4", "4111 1111 1111 1111"]
    rows = []
    for k in range(260):
        words = rng.choices(vocabulary, k=rng.randint(5, 30))
        for e in rng.sample(range(len(entities)), rng.choice([0, 0, 1, 1, 2])):
            words.insert(rng.randint(0, len(words)), entities[e])
            words += [vocabulary[7 * e % 100]] * rng.randint(0, 1) + [f"name{'abcdefghijklmno'[e]}"] * (e < 4 or rng.randint(0, 1))
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, t) for k, (_, t) in enumerate(rows[:40])] + [(2000 + k, f"{k} ".join(["tail", rows[k][1]])) for k in range(40)] + [(3000, None), (3001, "")]
    expected = brute_terms(rows)
    assert len(expected) > 20 and {r for v in expected.values() for _, _, r in v} == {True, False}
    assert found_terms(spark.createDataFrame(rows, "doc_id long, text string")) == expected
    # In the drawn prose personal data stand anywhere: no term reveals any.
    assert found_terms(docs) == brute_terms([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_many_matches_in_one_text_take_linear_time(spark):
    took = []
    for m in (2500, 10_000):
        rows = [(k, f"Zorblax {k} " + " ".join(f"m{i}@x{i}.org word{'abcdefghij'[i % 10]}" for i in range(m))) for k in range(2)]
        start = time.perf_counter()
        got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select(F.size("base").alias("n"), F.length(pii.sanitised()).alias("left"), F.size("extra").alias("terms")).collect()
        took.append(time.perf_counter() - start)
        assert [r["n"] for r in got] == [m, m] and all(0 < r["left"] < 30 * m for r in got)
    assert took[1] < 8 * took[0] + 5


def test_pii_edges(edge, empty):
    found = pii.sanitise(edge)
    assert found.columns == edge.columns and found.count() == edge.count()
    row = found.where("doc_id = 5").first()
    assert row["text"] == "Mail [EMAIL] or [PHONE], [IP], [CARD] end" and row["base"] == "base!"
    assert pii.sanitise(empty).count() == 0


def test_language_on_held_out_rows(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op5_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    profiles = language_id.fit(docs)
    out = {r["doc_id"]: r for r in language_id.predict(edge, profiles).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[3]["lang_pred"] == out[11]["lang_pred"] == "und"
    assert language_id.predict(empty, profiles).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(edge, {}).collect()} == {"und"}


def test_out_of_place_distance():
    a = language_id.top(*language_id.grams("abc abc abd"), 300)
    table = language_id.Profiles({"x": a, "y": a[::-1]}, 300)
    assert table.judge("abc abc abd") == ("x", 1.0)
    brute = sum(abs(i - list(a[::-1]).index(c)) for i, c in enumerate(a))
    assert abs(language_id.Profiles({"y": a[::-1]}, 300).judge("abc abc abd")[1] - (1 - brute / (300 * len(a)))) < 1e-12


def test_toxicity_on_held_out_rows(spark, edge, empty):
    scored = queries.op10_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null"), "doc_id").where("held_out").toPandas()
    assert (scored.predicted[scored.toxic == 1]).mean() > 0.9
    assert (scored.predicted[scored.toxic == 0]).mean() < 0.01
    texts = [f"you idiot number {k}. fine." for k in range(10)] + [f"fine day {k}. good." for k in range(40)]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k < 10)) for k in range(50)], "doc_id long, toxic int")
    model = toxicity.fit(own, marks)
    score, held = toxicity.Scorer(model).score("A fine day. You idiot number! Good.")
    assert score > 0.5 and [(a, b) for a, b, _ in held] == [(11, 28)]
    out = toxicity.score(edge, model)
    assert out.count() == edge.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, model).count() == 0 and toxicity.drop_toxic(edge, model).columns == edge.columns
    assert toxicity.fit(own, marks.where("toxic = 1")).weights == {} and toxicity.fit(empty, marks).weights == {}


def brute_score(text, weights, bias):
    """Noisy-or of the sentences over the floor, and the bias once."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    clean = 1 - sigmoid(bias)
    for sentence in re.split(r"[.!?\n]", text):
        total = 0.0
        for w in set(re.findall(r"[^\W\d_]+", sentence.lower())):
            total += weights.get(w, 0.0) + sum(weights.get(w[:n] + "*", 0.0) for n in (4, 5) if len(w) > n)
        if total and sigmoid(bias + total) >= toxicity.FLOOR:
            clean *= 1 - sigmoid(bias + total)
    return 1 - clean


def test_toxicity_scores_are_noisy_or():
    rng = random.Random(6)
    words = [f"w{a}rd{b}" for a in "aeiou" for b in "xyz"] + ["bad", "worse", "awful", "awfully"]
    weights = {"bad": 6.0, "worse": 9.5, "awfu*": 7.0, "awful*": 3.0, "waxx": -2.0, "ward*": -1.0}
    model = toxicity.Model(weights)
    scorer = toxicity.Scorer(model)
    for _ in range(300):
        text = "".join(f"{rng.choice(words)}{rng.choice([' ', ' ', ' ', '. ', '! ', chr(10)])}" for _ in range(rng.randint(1, 60)))
        assert abs(scorer.score(text)[0] - brute_score(text, weights, model.bias)) < 1e-9


def test_toxicity_does_not_grow_with_clean_text():
    scorer = toxicity.Scorer(toxicity.Model({"idiot": 14.0, "rather": 3.0}))
    clean = "It was a rather fine day. All is well!  ... ? " * 50_000
    assert scorer.score(clean)[0] < 1e-3
    score, held = scorer.score(clean + "You idiot.")
    assert score > 0.9 and len(held) == 1 and (clean + "You idiot.")[held[0][0] : held[0][1]].strip() == "You idiot"


def test_toxicity_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    bags = [[rng.integers(0, 12, rng.integers(1, 5)).tolist() for _ in range(rng.integers(0, 6))] for _ in range(60)]
    own = toxicity.Bags((rng.random(60) < 0.3).astype(float), bags, 12)
    w = rng.normal(5, 3, 12)
    grad = own.loss(w, 1e-3)[1]
    for k in range(12):
        step = np.eye(12)[k] * 1e-5
        assert abs((own.loss(w + step, 1e-3)[0] - own.loss(w - step, 1e-3)[0]) / 2e-5 - grad[k]) < 1e-5


def test_languages_of_few_rows_are_learned(spark):
    rows = [(k, f"the words of this english text number {k}", "en") for k in range(600)] + [(9000 + k, "żółta łódź płynie świtem", "pl") for k in range(3)]
    profiles = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=50)
    assert set(profiles) == {"en", "pl"}


def test_repeated_doc_ids_teach_the_same_rules(spark):
    rows = [(k, "# * % " * 9 if k % 3 == 0 else "plain words of a text that is fine and long enough") for k in range(300)] + [(k, f"{k} other words of a longer text " * 9) for k in range(300)]
    marks = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)], "doc_id long, quality int")
    fits = [quality_rules.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(n), marks) for x, n in ((rows, 2), (rows[::-1], 5))]
    assert fits[0] == fits[1] and fits[0]


