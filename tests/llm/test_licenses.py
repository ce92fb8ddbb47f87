import random
import re
from collections import Counter

import pytest
from lotwise.llm import licenses
from lotwise.llm.licenses import BASE, PASSAGES, Template

SCHEMA = "doc_id long, text string, words array<string>, n_words string, part int, template string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_base(text):
    found, got = words(text), []
    for t in BASE:
        n = len(t.words)
        got += [(i, t.label) for i in range(len(found) - n + 1) if found[i : i + n] == t.words]
    return len(found), len(got), min(got)[0] if got else None, max(got)[0] if got else None, ",".join(sorted({label for _, label in got}))


def scan(spark, rows, **kwargs):
    frame = spark.createDataFrame([(*r, ["x"], "y", 3, "z") for r in rows], SCHEMA).repartition(3)
    got = licenses.licenses(frame, **kwargs)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return got.collect()


def test_base_places_equal_a_plain_search(spark):
    rnd = random.Random(4)
    lexicon = ["CC", "by", "cc-by", "All", "rights", "reserved.", "General", "public", "LICENSE", "é", "the", "K", "&", "0"]
    texts = [None, "", " \n--", "cc by", "CC\x00by", "CC by cc BY cc cc by", "all rights reserved" * 2, "cc by"]
    texts += [" ".join(rnd.choice(lexicon) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    texts += ["cc by " * 30_000, "word " * 50_000 + "all rights reserved"]
    rows = list(enumerate(texts)) + [(None, "cc by")] * 3 + [(5, "cc by"), (5, "cc by"), (5, "other")]
    got = Counter(tuple(r)[:6] for r in scan(spark, rows))
    assert got == Counter((d, *plain_base(t)) for d, t in rows)


def test_passages_with_changed_words_are_found_and_others_not(spark):
    own = {t.text: t for t in PASSAGES}
    rows, want = [], {}
    for i, t in enumerate(own.values()):
        w = t.words
        rows.append((10 * i, "noise before. " + t.text.upper() + " and after"))
        want[10 * i] = t.label
        if len(w) > 15:
            rows.append((10 * i + 1, " ".join([*w[: len(w) // 2], "inserted", "words", *w[len(w) // 2 :]])))
            want[10 * i + 1] = t.label
            rows.append((10 * i + 2, " ".join([*w[:5], "x", *w[6:]])))
            want[10 * i + 2] = t.label
            rows.append((10 * i + 3, " ".join(w[: len(w) // 2])))
            rows.append((10 * i + 4, " ".join(sorted(w))))
    for r in scan(spark, rows):
        labels = set(filter(None, r.labels.split(",")))
        assert set(filter(None, r.base_labels.split(","))) <= labels
        if r.doc_id in want:
            assert want[r.doc_id] in labels and r.score >= 0.8
        else:
            assert labels <= {"gpl"} and r.score < 0.8 or r.n_base
        if r.doc_id % 10 == 0:
            assert r.score == 1.0


def test_own_templates_and_limits(spark):
    t = [Template("short", "alpha beta"), Template("long", "one two three four five six seven eight nine ten")]
    texts = ["alpha beta", "one two three four five", "one two three four five six seven eight x nine ten", "one two three " * 50]
    got = sorted(scan(spark, list(enumerate(texts)), templates=t))
    assert [(r.labels, r.score) for r in got] == [("short", 1.0), ("", 0.5), ("long", 0.8), ("", 0.3)]
    with pytest.raises(ValueError):
        licenses.licenses(spark.createDataFrame([], "doc_id long, text string"), templates=[Template("a", "one")])


def test_empty_table_and_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([], SCHEMA)
    found = licenses.licenses(frame)
    assert found.collect() == []
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_its_sql(spark, tiny):
    from lotwise.llm.queries import ORACLES, QUERIES
    from oracle import connect, differences

    assert differences(spark, connect(tiny), tiny, QUERIES["op12_licenses"], ORACLES["op12_licenses"]) is None
