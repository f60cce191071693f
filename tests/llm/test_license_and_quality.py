import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kvtable.llm import license_scan, quality_classifier, quality_rules, queries
from kvtable.llm.labels import held_out, training_labels
from tests.sqlcheck import assert_same


def dice_scan(text, templates, threshold):
    """Every unit against every template, without pruning."""
    if text is None:
        return []
    units = dict.fromkeys(text.split("\n") + re.split(r"\n[ \t\r]*\n", text))
    out = []
    for unit in units:
        own = set(license_scan.bigrams_of(unit))
        for name, template in templates:
            other = set(license_scan.bigrams_of(template))
            dice = 2 * len(own & other) / (len(own) + len(other)) if own and other else 0
            if dice >= threshold:
                out.append((unit, name, round(dice, 9)))
    return sorted(out)


def test_license_scan(spark, edge, edge_rows, empty, clashing):
    mit = [t for n, t in license_scan.TEMPLATES if n == "MIT"][1]
    more = [(500, "intro\n\n" + mit + "\n\nend"), (501, mit[:400]), (502, "This work is licensed under the GNU General Public License, version 2."),
            (503, "licensed UNDER the apache-license version 2.0"), (504, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.")]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    for threshold in (0.8, 0.5):
        for r in license_scan.scan(docs, threshold=threshold).join(docs.dropDuplicates(["doc_id"]), "doc_id").collect():
            got = sorted((m["unit"], m["license"], round(m["dice"], 9)) for m in r["matches"])
            assert got == dice_scan(r["text"], license_scan.TEMPLATES, threshold), r["doc_id"]
    found = {r["doc_id"]: r["licenses"] for r in license_scan.summary(license_scan.scan(docs)).collect()}
    assert found[500] == "MIT" and found[503] == "Apache-2.0" and found[504] == "CC-BY-NC-4.0" and found[10] == "MIT" and found[5] == ""
    assert license_scan.scan(clashing).count() == len(edge_rows) and license_scan.scan(empty).count() == 0
    assert license_scan.scan(edge, templates=[]).where(F.size("matches") > 0).count() == 0
    with pytest.raises(ValueError, match="too many"):
        license_scan.scan(edge, templates=[("x", "a b")] * 501)


def test_each_licence_line_of_the_tables_is_found(spark):
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    docs = spark.createDataFrame([(i, f"some prose\n{x}\nmore") for i, x in enumerate(lines)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["licenses"] for r in license_scan.summary(license_scan.scan(docs)).collect()}
    assert all(want in found[i].split(",") for i, want in enumerate(lines.values()))


def test_notices_in_paragraphs_and_within_lines_are_found(spark):
    notices = {n: t for n, t in license_scan.TEMPLATES if len(t) > 200}

    def laid_out(text, *openings):  # a blank line before each of these words
        flat = " ".join(text.split())
        for words in openings:
            assert words in flat
            flat = flat.replace(words, "\n\n" + words)
        return "Copyright 2020 Somebody\n\n" + flat + "\n\nThe end of it."

    texts = {
        "MIT": laid_out(notices["MIT"], "The above copyright", "THE SOFTWARE IS"),
        "BSD-2-Clause": laid_out(notices["BSD-2-Clause"], "Redistributions of", "Redistributions in"),
        "GPL-3.0": laid_out(notices["GPL-3.0"], "This program is distributed"),
        "Apache-2.0": "Some words of prose here. Licensed under the Apache License, Version 2.0. And more words follow.",
        "": "The rights of all were reserved. Permission was granted to use the software under a license.",
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())) + [(9, None), (10, "license")], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in license_scan.summary(license_scan.scan(docs, embedded=True)).collect()}
    assert [found[i]["licenses"] for i in range(len(texts))] == list(texts) and found[9]["n_matches"] == found[10]["n_matches"] == 0
    assert found[3]["best_dice"] == 1.0 and found[0]["best_dice"] == 1.0


def brute_embedded(text, templates, threshold, found):
    """For each template of a licence that is not in ``found``: the best of all runs of words, if it reaches the threshold."""
    words = re.sub("[^A-Za-z0-9]+", " ", text or "").lower().split()
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    out = []
    for name, template in templates:
        other = set(license_scan.bigrams_of(template))
        best = 0.0
        for a in range(len(grams) if name not in found else 0):
            own = set()
            for b in range(a, len(grams)):
                own.add(grams[b])
                best = max(best, 2 * len(own & other) / (len(own) + len(other)))
        if best >= threshold:
            out.append((name, round(best, 9)))
    return sorted(out)


def test_embedded_notices_equal_all_runs_and_the_sql(spark, tmp_path):
    import random

    rng = random.Random(6)
    notices = [t for _, t in license_scan.TEMPLATES if len(t) < 500]
    texts = [None, "", "license", "All rights reserved"]
    for k in range(40):
        words = rng.choice(notices).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["other", "software", "license", "\n\n", "\n"])
        before, after = (" ".join(rng.choice(["some", "prose", "the", "license", "of"]) for _ in range(rng.randint(0, 6))) for _ in range(2))
        texts.append(before + rng.choice([" ", "\n", "\n\n"]) + " ".join(words) + rng.choice([" ", "\n# "]) + after)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in license_scan.scan(docs, embedded=True).join(docs, "doc_id").collect():
        units = dice_scan(r["text"], license_scan.TEMPLATES, 0.8)
        want = [(n, d) for _, n, d in units] + brute_embedded(r["text"], license_scan.TEMPLATES, 0.8, {n for _, n, _ in units})
        assert sorted((m["license"], round(m["dice"], 9)) for m in r["matches"]) == sorted(want), r["text"]
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = con.sql(license_scan.oracle()).fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in license_scan.summary(license_scan.scan(docs, embedded=True)).collect())


def test_full_texts_are_found_alone_commented_and_before_code(spark):
    full = {n: t for n, t in license_scan.TEMPLATES if len(t) > 400}
    full["BSD-3-Clause"] = f"{license_scan._BSD} {license_scan._BSD_THIRD} {license_scan._BSD_DISCLAIMER}"
    code = "\nint main(void) {\n  return 0;\n}\n" * 5
    texts = []
    for name, text in full.items():
        lines = re.findall(r".{1,70}(?:\s|$)", " ".join(text.split()))
        texts += [(name, "\n".join(lines)), (name, "\n".join("// " + x for x in lines) + code), (name, "\n".join(lines) + code)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["licenses"].split(",") for r in license_scan.summary(license_scan.scan(docs, embedded=True)).collect()}
    assert set(full) >= {"MIT", "Apache-2.0", "GPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC"}
    assert all(name in found[i] for i, (name, _) in enumerate(texts))


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("A", "one two three"), (None, "x"), ("B", None)], "license string, text string")
    assert license_scan.templates_from(table) == [("A", "one two three")]
    with pytest.raises(ValueError, match="too many"):
        license_scan.templates_from(spark.range(501).selectExpr("'x' AS license", "'a b' AS text"))


def test_no_match_lacks_the_telling_words():
    import random

    rng = random.Random(4)
    for threshold in (0.5, 0.8, 1.0):
        for _ in range(200):
            templates = [("x", " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 12)))) for _ in range(3)]
            words = license_scan.telling_words(templates, threshold)
            unit = " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 12)))
            for text in (unit, templates[0][1], " ".join(templates[1][1].split()[1:])):
                if dice_scan(text, templates, threshold):
                    assert set(text.split()) & set(words)
    assert len(license_scan.telling_words(license_scan.TEMPLATES, 0.8)) < 50 and license_scan.telling_words([], 0.8) == []


def test_license_query_equals_its_sql(spark, small, corpus):
    assert_same(queries.op1_license_scan(spark, small), queries.oracle_sql()["op1_license_scan"], small)


def brute_grams(text, n_buckets):
    """Buckets of the word uni- and bigrams: XXH64 of a word with seed 42, of a pair the second's hash with the first's as seed."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    raw = [h.to_bytes(8, "little") for h in hashes]
    pairs = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(raw, raw[1:], strict=False)]
    return [signed(h) % n_buckets for h in hashes + pairs]


def brute_base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_rules_statistics_and_model(spark, edge, empty, clashing, labelled):
    docs, labels = labelled
    target = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id").select("text")
    buckets, smoothing = 512, 2.0
    flagged = docs.join(labels.where("quality = 1").select("doc_id", F.lit(True).alias("good")), "doc_id", "left")
    model = quality_rules.fit(flagged, F.col("good"), n_buckets=buckets, smoothing=smoothing)
    weights = model.first()[0]
    grams = lambda df: [brute_grams(r["text"], buckets) for r in df.select("text").collect()]
    raw, good = Counter(g for x in grams(docs) for g in x), Counter(g for x in grams(target) for g in x)
    scale = sum(good.values()) / sum(raw.values())
    want = [math.log((good[b] + smoothing) / (raw[b] * scale + smoothing)) for b in range(buckets)]
    assert max(abs(a - b) for a, b in zip(weights, want, strict=True)) < 1e-9
    for df in (edge, clashing):
        rows = quality_rules.judge(df, model, n_buckets=buckets).collect()
        assert len(rows) == df.count() and set(rows[0].asDict()) >= set(df.columns)
        for r, g in zip(rows, grams(df), strict=True):
            q = r["_q"]
            got = (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"])
            assert got == brute_base(r["text"]), r["text"]
            score = sum(want[b] for b in g) / len(g) if g else 0.0
            assert abs(q["score"] - score) < 1e-9
            assert q["kept"] == (not q["base_failed"] and q["score"] >= quality_rules.MIN_SCORE)
            assert len(g) == max(0, 2 * q["n_words"] - 1)
    assert quality_rules.judge(empty, model).count() == 0
    no = F.lit(None).cast("boolean")
    assert quality_rules.fit(docs, no, n_buckets=16).first()[0] == [0.0] * 16
    assert quality_rules.fit(empty, no, n_buckets=16).first()[0] == [0.0] * 16


def test_model_of_counts_whose_products_leave_bigint(spark):
    counts = {0: (6 << 30, 3 << 30), 1: (2 << 30, 2 << 30), 3: (1, 0)}
    rows = spark.createDataFrame([(b, *c) for b, c in counts.items()], "bucket int, r bigint, t bigint")
    got = quality_rules.log_ratios(rows, n_buckets=4, smoothing=2.0).first()[0]
    nr, nt = (sum(c[i] for c in counts.values()) for i in (0, 1))
    want = [math.log((t + 2.0) / (r * nt / nr + 2.0)) for r, t in (counts.get(b, (0, 0)) for b in range(4))]
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-12


def test_rules_tell_the_kinds_apart_and_allow_filters(spark, labelled):
    docs, labels = labelled
    model = quality_rules.fit(docs.join(labels, "doc_id"), F.col("quality") == 1)
    kept = quality_rules.judge(docs, model).where("_q.kept").select("doc_id").collect()
    assert {r["doc_id"] % 2 for r in kept} == {0}


def test_base_columns_of_given_tables(spark, small):
    rows = queries.op2_quality_rules(spark, small)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in rows.collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute_base(texts[r["doc_id"]])


def test_quality_queries_on_awkward_and_empty_tables(spark, corpus, bare_corpus):
    n = spark.read.parquet(f"{corpus}/documents.parquet").count()
    for query in (queries.op2_quality_rules, queries.op4_quality_classifier):
        assert query(spark, corpus).count() == n
        assert query(spark, bare_corpus).count() == 0


# --- classifier ---------------------------------------------------------------


def test_features_are_the_texts_n_grams():
    assert len(quality_classifier.features(None)) == len(quality_classifier.features("")) == 0
    a, b = set(quality_classifier.features("abcd efgh")), set(quality_classifier.features("abcd efgh xyz xyz"))
    assert a < b and list(quality_classifier.features("q q q")) == sorted(set(quality_classifier.features("q q q")))
    repeat = set(quality_classifier._hashed(quality_classifier.np.array([2], "u1"), 1, 200).tolist())
    assert repeat <= b and not repeat <= a


def test_descent_separates_and_meets_the_optimality_conditions():
    np = quality_classifier.np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5))
    y = np.where(x[:, 0] + 0.2 * rng.normal(size=80) > 0, 1.0, -1.0)
    at = np.arange(5)
    costs = np.full(80, 0.5)
    w = quality_classifier.dual_coordinate_descent([(at, row) for row in x], y, costs, 5, epochs=2000, tol=1e-6)

    def primal(w):
        return 0.5 * w @ w + (costs * np.maximum(0, 1 - y * (x @ w))).sum()

    best = primal(w)
    for _ in range(300):
        assert primal(w + rng.normal(size=5) * 0.05) >= best - 1e-4


def test_log_count_ratios(spark):
    rows = [("aaaa", 1), ("aaaa", 1), ("bbbb", 0), (None, 1)]
    got = quality_classifier._log_count_ratios(spark.createDataFrame(rows, "text string, label int"), "text")
    np = quality_classifier.np
    counts = np.ones((2, quality_classifier.N_FEATURES))
    for text, label in rows:
        counts[label][quality_classifier.features(text)] += 1
    want = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.abs(got - want).max() < 1e-9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op4_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = rows.join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    assert len(held) > 500 and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in held)
    good = [r for r in held if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) / len(good) > 0.99


def test_fold_is_never_learned_from(spark, labelled):
    _, labels = labelled
    import zlib

    got = {r["doc_id"] for r in training_labels(labels).collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    assert [(r["doc_id"], r["label"]) for r in training_labels(odd).collect()] == [(1, 1)]
    assert spark.range(1).select(held_out("id")).first()[0] == (zlib.crc32(b"0") % 4 == 2)


def test_missing_classes_and_awkward_rows(spark, edge, empty, clashing, labelled):
    docs, labels = labelled
    train = training_labels(labels)
    for part, constant in ((train.where("label = 1"), 1.0), (train.where("label = 0"), 0.0), (train.limit(0), 1.0)):
        model = quality_classifier.fit(docs, part)
        assert {r["score"] for r in quality_classifier.scores(edge, model).collect()} == {constant}
    model = quality_classifier.fit(docs, train)
    for df in (edge, clashing):
        rows = quality_classifier.scores(df, model).collect()
        assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.scores(empty, model).count() == 0
    scored = {r["doc_id"]: r["score"] for r in quality_classifier.scores(docs, model).collect()}
    assert all((s >= 0.7) == (i % 2 == 0) for i, s in scored.items())
    nowhere = train.select((F.col("doc_id") + 10**6).alias("doc_id"), "label")
    assert quality_classifier.fit(docs, nowhere).constant is not None


def brute_features(text):
    mask, found = (1 << 64) - 1, set()

    def add(data, n, salt):
        for at in range(len(data) - n + 1):
            h = salt
            for byte in data[at : at + n]:
                h = (h ^ byte) * 0x9E3779B97F4A7C15 & mask
                h ^= h >> 29
            found.add(h % quality_classifier.N_FEATURES)

    data = (text or "").encode()
    shape = bytes(ord("a") if b >= 128 or 97 <= b <= 122 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in data)
    add(data, 4, 1)
    add(shape, 2, 102)
    add(shape, 5, 105)
    words, run = (text or "").split(), 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        if 1 < run <= 5:
            add(bytes([run]), 1, 200)
    return sorted(found)


def brute_scores(docs, labels, texts):
    """The whole model in plain Python: ratios, descent, sigmoid; then the score of each text."""
    size, bias = quality_classifier.N_FEATURES, 0.3
    rows = sorted((i, brute_features(t), labels[i]) for i, t in docs if i in labels)
    counts = {c: Counter(f for _, found, label in rows if label == c for f in found) for c in (0, 1)}
    total = {c: sum(counts[c].values()) + size for c in (0, 1)}
    ratio = {f: math.log((counts[1][f] + 1) / total[1]) - math.log((counts[0][f] + 1) / total[0]) for f in range(size)}

    def vector(found):
        length = math.sqrt(sum(ratio[f] ** 2 for f in found)) or 1.0
        return {f: ratio[f] / length for f in found} | {"bias": bias}

    late = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    early = [(vector(found), 1 if label else -1) for (_, found, label), is_late in zip(rows, late, strict=True) if not is_late]
    n_good, n = sum(label for _, _, label in rows), len(rows)
    cost = {1: n / (2 * n_good), -1: n / (2 * (n - n_good))}
    w, alpha = defaultdict(float), [0.0] * len(early)
    rng = np.random.default_rng(0)
    for _ in range(30):
        worst = 0.0
        for i in rng.permutation(len(early)):
            x, y = early[i]
            g = y * sum(w[f] * v for f, v in x.items()) - 1
            worst = max(worst, abs(min(g, 0) if alpha[i] <= 0 else max(g, 0) if alpha[i] >= cost[y] else g))
            new = min(max(alpha[i] - g / sum(v * v for v in x.values()), 0.0), cost[y])
            for f, v in x.items():
                w[f] += (new - alpha[i]) * y * v
            alpha[i] = new
        if worst < 0.01:
            break
    margin = lambda found: sum(w[f] * v for f, v in vector(found).items())
    held = [(margin(found), label) for (_, found, label), is_late in zip(rows, late, strict=True) if is_late]
    n1 = sum(label for _, label in held)
    goal = {1: (n1 + 1) / (n1 + 2), 0: 1 / (len(held) - n1 + 2)}
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps, damped: the loss is convex
        p = [1 / (1 + math.exp(-(a * m + b))) for m, _ in held]
        ga = sum((q - goal[label]) * m for q, (m, label) in zip(p, held, strict=True)) + 2e-3 * a
        gb = sum(q - goal[label] for q, (_, label) in zip(p, held, strict=True))
        haa = sum(q * (1 - q) * m * m for q, (m, _) in zip(p, held, strict=True)) + 2e-3
        hab = sum(q * (1 - q) * m for q, (m, _) in zip(p, held, strict=True))
        hbb = sum(q * (1 - q) for q in p) + 1e-9
        det = haa * hbb - hab * hab
        a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
    return [1 / (1 + math.exp(-(a * margin(brute_features(t)) + b))) for t in texts]


def test_scores_equal_a_model_in_plain_python(spark, labelled):
    docs, labels = labelled
    train = training_labels(labels)
    texts = [r["text"] for r in docs.collect()][:60] + [None, "", "Straße 12 a a a"]
    want = brute_scores([(r["doc_id"], r["text"]) for r in docs.collect()], {r["doc_id"]: r["label"] for r in train.collect()}, texts)
    model = quality_classifier.fit(docs, train)
    got = [model.score(quality_classifier.features(t)) for t in texts]
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-6
    few = quality_classifier.fit(docs, train, max_bytes=20_000)  # some rows only, yet a model
    assert few.constant is None and abs(few.score(quality_classifier.features(texts[0])) - got[0]) < 0.5
