import zlib
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrama.llm import language_id, licenses, quality_classifier, quality_rules, warc
from engrama.llm.common import shared_dir
from engrama.llm.queries import QUERIES
from tests.llm.data import TEXTS, awkward, documents, empty
from tests.llm.test_dedup import WORD

SF = "/root/testdata/sf0.01"


def windows_repeated(words, n=5):
    seen = {}
    for k in range(len(words) - n + 1):
        seen.setdefault(tuple(words[k : k + n]), []).append(k)
    return len({k + j for at in seen.values() if len(at) > 1 for k in at for j in range(n)})


def counted(text):
    words, earlier, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, windows_repeated(words)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_rule_statistics(spark, sf):
    for docs, rows in ((awkward(spark), TEXTS), (spark.read.parquet(f"{sf}/documents.parquet"), [(r["doc_id"], r["text"]) for r in documents(sf)])):
        got = sorted(tuple(r[c] for c in COLUMNS) for r in quality_rules.statistics(docs).collect())
        assert got == sorted(counted(r[1]) for r in rows)
    assert quality_rules.judge(empty(spark), []).count() == 0


def test_decision_list_is_its_column(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 2] > 0.9)
    rules = quality_rules.learn(x, bad)
    covered = np.zeros(len(x), bool)
    for r in rules:
        covered |= r.covers(x)
    assert (covered == bad).mean() > 0.95
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    kept = [r[0] for r in df.select(quality_rules.as_column(rules, {c: F.col(c) for c in "abc"})).collect()]
    assert kept == (~covered).tolist()
    assert quality_rules.learn(x, np.zeros(600, bool)) == []


def quality_of(spark, rows):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["kept"] for r in rows}
    good, bad = ([kept[i] for i, q in labels.items() if q == want] for want in (1, 0))
    return sum(good) / len(good), sum(bad) / len(bad)


@pytest.mark.parametrize(("name", "least_good"), [("op1_quality_rules", 0.97), ("op5_quality_classifier", 0.98)])
def test_quality(spark, name, least_good):
    good, bad = quality_of(spark, QUERIES[name](spark, SF).collect())
    assert good >= least_good and bad <= 0.05


def test_classifier_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (8, 0), (4, 0), (99, 1), (None, 1), (10, None)], "doc_id long, quality int")
    docs = awkward(spark)
    model = quality_classifier.fit(docs, labels)
    scores = {(r["doc_id"], r["score"]) for r in quality_classifier.score(docs, model).collect()}
    assert all(0 <= s <= 1 for _, s in scores) and {i for i, s in scores if s == 0} >= {4, 5, 6}
    out = quality_classifier.filter_quality(docs, model)
    assert out.columns == docs.columns and out.count() <= len(TEXTS)
    none = quality_classifier.fit(docs, labels.where("quality = 1"))
    assert none is None and quality_classifier.filter_quality(docs, none).count() == len(TEXTS) - 3
    assert quality_classifier.score(empty(spark), model).count() == 0


def test_views_agree_after_co_training():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.7).astype(float)
    text, meta = rng.normal(size=(400, 4)) + 2 * y[:, None], rng.normal(size=(400, 2)) + y[:, None]
    training = quality_classifier.CoTraining(text[:60], meta[:60], y[:60])
    sure = {v: [k for k in range(60, 300) if abs(training.models[v].log_odds((text, meta)[v][k : k + 1])[0]) > 3] for v in (0, 1)}
    training.next_round([(v, text[rows], meta[rows], (training.models[v].log_odds((text, meta)[v][rows]) > 0).astype(float)) for v, rows in sure.items()])
    combined, _, _ = training.finish().scores(text[300:], meta[300:])
    assert ((combined > 0.5) == (y[300:] > 0.5)).mean() > 0.95


def test_surest_are_the_surest(spark):
    """Against a sort on the driver; labelled and taken documents are never handed over, repeated ids once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    y, text, meta = quality_classifier._numbers(quality_rules.labelled_sample(docs, labels, "quality", 6000), "_label")
    models = quality_classifier.CoTraining(text, meta, (y > 0).astype(float)).models
    ids, text, meta = quality_classifier._numbers(docs, "doc_id")
    known = {r["doc_id"] for r in labels.collect()}
    taken = set([i for i in ids.tolist() if i not in known][:20])
    got = quality_classifier.surest(docs.unionByName(docs), labels.select("doc_id"), models, taken, (15, 9), 0.95)
    want: dict[int, tuple[int, int]] = {}
    for v, (m, x) in enumerate(zip(models, (text, meta), strict=True)):
        p = 1 / (1 + np.exp(-m.log_odds(x)))
        for label, n, sign in ((1, 15, -1), (0, 9, 1)):
            open_ = [(sign * q, i) for q, i in zip(p.tolist(), ids.tolist(), strict=True) if i not in known | taken | set(want) and (q >= 0.95 if label else q <= 0.05)]
            want |= {i: (v, label) for _, i in sorted(open_)[:n]}
    assert got == want and want


@pytest.mark.parametrize("module", [quality_rules, quality_classifier])
def test_verdicts_on_labels_not_fitted(spark, module):
    """Fitted on three quarters of the labels, judged on the rest."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = module.fit(docs, labels.where("doc_id % 4 <> 1"))
    out = module.judge(docs, model) if module is quality_rules else module.score(docs, model)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    held = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 4 = 1").collect()}
    right = sum(kept[i] == (q == 1) for i, q in held.items()) / len(held)
    assert right >= 0.93, right


def test_rules_from_awkward_labels(spark):
    """Labels without a document, null labels, one document labelled twice, labels of one kind only."""
    labels = spark.createDataFrame([(1, 1), (1, 1), (8, 0), (4, 0), (99, 1), (None, 1), (10, None)], "doc_id long, quality int")
    assert quality_rules.judge(awkward(spark), quality_rules.fit(awkward(spark), labels)).count() == len(TEXTS)
    assert quality_rules.fit(awkward(spark), labels.where("quality = 1")) == [] == quality_rules.fit(awkward(spark), labels.where("doc_id = 99"))


def licenses_brute(rows, templates, n=5):
    out = set()
    for i, t in rows:
        w = licenses.words(t or "")
        for name, text in templates.items():
            own = licenses.words(text)
            m = min(n, len(own))
            have, wanted = set(licenses.word_shingles(w, m)), licenses.word_shingles(own, m)
            if wanted and m and sum(s in have for s in wanted) >= 0.8 * len(wanted):
                out.add((i, name))
    return out


def test_licenses(spark, sf):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = licenses.scan(docs).collect()
    want = licenses_brute([(r["doc_id"], r["text"]) for r in documents(SF)], licenses.TEMPLATES)
    assert {(r["doc_id"], r["license"]) for r in got} == want and want
    assert all(0.8 <= r["containment"] <= 1 for r in got)


def test_license_texts_inside_others(spark):
    filler = "lorem ipsum dolor sit amet " * 40
    changed = licenses.TEMPLATES["mit"].replace("free of charge", "at no cost")
    rows = [(1, filler + licenses.TEMPLATES["mit"] + filler), (2, filler + changed + filler), (3, filler), (4, None), (5, ""), (6, licenses.TEMPLATES["apache-2.0"]), (6, filler + licenses.TEMPLATES["bsd"]), (None, licenses.TEMPLATES["isc"])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == licenses_brute(rows, licenses.TEMPLATES)
    assert next(r for r in got if r["doc_id"] == 1)["containment"] == 1.0
    assert licenses.scan(empty(spark)).count() == 0 and licenses.scan(awkward(spark)).count() == 0


def test_short_templates(spark):
    rows = [(1, "all rights reserved"), (2, "some rights reserved"), (3, "public domain")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"arr": "All rights reserved.", "pd": "Public domain", "none": "!!"}).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(1, "arr"), (3, "pd")}


PAGES = [(3, "http://a", "x" * 100), (1, "http://b", "x" * 100), (2, None, "x" * 100), (4, "u\r\nInjected: 1", "é" * 49), (5, "http://c", "é" * 49), (6, "http://d", None), (None, "http://e", "x" * 100), (7, "http://f", "é" * 50), (7, "http://f", "é" * 50), (8, "http://g", "\r\n\r\nWARC/1.1\r\n" * 5000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "extra", 1) for p in PAGES], "page_id long, url string, html string, digest string, size int")
    folder = shared_dir(spark, "warc-test")
    index = warc.write(pages, folder, date=datetime(2020, 1, 1, tzinfo=UTC))
    assert index.count() == len(PAGES)
    rows = warc.read(index).collect()
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows), key=str)
    want = [(0, "revisit", 1, 100), (1, "response", None, 100), (2, "revisit", 1, 100), (3, "revisit", 1, 100), (4, "response", None, 98), (5, "response", None, 98), (6, "response", None, 0), (7, "response", None, 100), (7, "response", None, 100), (8, "response", None, len(PAGES[-1][2]))]
    assert got == sorted(want, key=str)
    payload = {r["page_id"]: r["payload"] for r in rows if r["record_type"] == "response"}
    assert bytes(payload[8]).decode() == PAGES[-1][2] and payload[6] == b""
    some = warc.read(index.where("url = 'http://c' or payload_digest = (select max(payload_digest) from values ('0') t(payload_digest))")).collect()
    assert [r["page_id"] for r in some] == [5]
    nothing = warc.write(pages.where("false"), shared_dir(spark, "warc-test"))
    assert warc.read(nothing).count() == 0


def test_ranges_merge():
    assert warc.merged_ranges([0, 10, 100, 5000], [10, 20, 5, 5], gap=70) == [(0, 3, 0, 105), (3, 4, 5000, 5005)]
    assert warc.merged_ranges([0, 10], [10, 10], gap=0, most=15) == [(0, 1, 0, 10), (1, 2, 10, 20)]
    assert warc.merged_ranges([], []) == []


def ppm_bits(trees, k, text, order=3):
    counts = [{} for _ in range(order + 1)]
    for code, n in zip(trees.codes[k], trees.times[k], strict=True):
        w = int(code).to_bytes(4, "big")
        for o in range(order + 1):
            at = counts[o].setdefault(w[3 - o : 3], {})
            at[w[3]] = at.get(w[3], 0) + n
    data, bits = b"   " + text.lower().encode(), 0.0
    for i in range(3, len(data)):
        for o in range(order, -1, -1):
            m = counts[o].get(data[i - o : i])
            if not m:
                continue
            total, kinds = sum(m.values()), len(m)
            if data[i] in m:
                bits += np.log2((total + kinds) / m[data[i]])
                break
            bits += np.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trees = next(language_id.fit(docs, 20))
    text = pytest.importorskip("pyarrow").array(["The quick brown fox", "", "Straße über alles 漢字 \x01", "a"])
    from engrama.llm.arrow_text import chunks

    for _, _, data, offsets in chunks(language_id._lowered(text)):
        bits = trees.unfold().bits(data, offsets)
        for row, t in zip(bits, text.to_pylist(), strict=True):
            assert row == pytest.approx([ppm_bits(trees, k, t) for k in range(len(trees.langs))], rel=1e-5)


def test_language_accuracy(spark):
    docs = {r["doc_id"]: r for r in documents(SF)}
    got = QUERIES["op10_language_id"](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_awkward(spark):
    docs = awkward(spark)
    trees = list(language_id.fit(docs))
    assert [g.langs for g in trees] == [["de", "en"]]
    und = {r["doc_id"] for r in language_id.predict(docs, trees).where("lang_pred = 'und'").collect()}
    assert und == {4, 5, 6}
    nothing = language_id.fit(empty(spark))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty(spark), trees).count() == 0


def test_languages_in_groups(spark):
    """As many passes as languages give what one pass gives; of languages with equal trees the first wins."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    twins = docs.where("lang is not null").unionByName(docs.where("lang is not null").withColumn("lang", F.concat("lang", F.lit("-twin"))))
    one, many = list(language_id.fit(twins, 50)), list(language_id.fit(twins, 50, table_bytes=1))
    assert len(one) == 1 and [g.langs for g in many] == [[lang] for lang in one[0].langs]
    got, want = (sorted(map(tuple, language_id.predict(docs, g).collect())) for g in (many, one))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(a[2] == pytest.approx(b[2], abs=1e-9) and a[3] == pytest.approx(b[3]) for a, b in zip(got, want, strict=True))
    assert not any(r[1].endswith("-twin") for r in want)


def test_language_groups_stay_in_bounds():
    contexts = {f"l{k}": 100 * (k + 1) for k in range(9)}
    groups = language_id.grouped(contexts, 3_000_000)
    assert sum(groups, []) == sorted(contexts) and len(groups) > 1
    assert all(len(g) == 1 or sum(contexts[x] for x in g) * len(g) * 257 * 4 <= 3_000_000 for g in groups)
    assert language_id.grouped({}, 10) == []
