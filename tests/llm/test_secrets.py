import random
import re
from hashlib import md5, sha1

import pytest
from lotwise.llm import secrets
from pyspark.sql import functions as F

PATTERN = re.compile(secrets.CANDIDATE)


def judged(forest, features):
    """Votes of the trees, walked in Python."""
    votes = 0
    for n in forest.roots:
        while forest.feature[n] >= 0:
            n = forest.left[n] if features[forest.feature[n]] <= forest.threshold[n] else forest.right[n]
        votes += forest.vote[n]
    return votes / len(forest.roots)


def features(words, value, before, after):
    """The features written a second time, in Python."""
    told = "|".join(secrets.ANNOUNCING)
    classes = re.sub("[^aA0]+", "-", re.sub("[0-9]+", "0", re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", value))))
    listed = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    n = max(1, len(value))
    return [
        len(value), (len(classes) - 1) / n, len(re.findall("[0-9]", value)) / n, len(re.findall("[A-Z]", value)) / n,
        bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", value)), len(set(value)) / n, 1 - len(re.sub(listed, "", value.lower())) / n,
        len(re.findall(r"[/.\\]", value)), "@" in value or after == "@", bool(re.fullmatch(r"[0-9]+([.\-/][0-9]+)+", value)),
        bool(re.search(rf"({told})[^a-z0-9]*$", before.lower())), bool(re.search(r"[=:]\s*[\"']?$", before)), bool(re.search("[\"'`]$", before)),
    ]


def plain(forest, text):
    """(spans, masked text)."""
    spans, out, at = [], "", 0
    for m in PATTERN.finditer(text or ""):
        score = judged(forest, features(forest.dictionary, m.group(), text[max(0, m.start() - secrets.BESIDE) : m.start()], text[m.end() : m.end() + 1]))
        spans.append((m.start() + 1, len(m.group()), score >= 0.5))
        out += text[at : m.start()] + (secrets.MASK if score >= 0.5 else m.group())
        at = m.end()
    return spans, None if text is None else out + text[at:]


def made(n=240):
    rnd = random.Random(9)
    words = ["river", "stone", "house", "light", "green", "garden", "window", "paper", "winter", "summer"]
    rows = []
    for i in range(n):
        h, w = sha1(str(i).encode()).hexdigest(), rnd.choice(words)
        extra = rnd.choice([f'token = "{h}"', f"password={h[:18]}", f"see {w}.{i}@mail.example.com", f"password={w}{w}2024", "1.22.333.44", f"/{w}/{w}/v2/x.html", f"commit {h}", ""])
        text = [rnd.choice(words) for _ in range(rnd.randint(2, 60))]
        text.insert(rnd.randrange(len(text)), extra)
        rows.append((i, " ".join(text)))
    return rows


ODD = [
    (900, None), (901, ""), (902, "x"), (903, "AKIA" + md5(b"1").hexdigest()[:16].upper()), (904, 'token = "' + sha1(b"2").hexdigest() + '"' * 2),
    (904, 'token = "' + sha1(b"2").hexdigest() + '"' * 2), (905, "ab12ab12ab12=== é" + "z" * 50_000), (906, "$1 \\ password=" + sha1(b"3").hexdigest() + "\n" + "é" * 30),
    (None, "password=" + sha1(b"4").hexdigest()), (907, ("1" * 15 + " ") * 2_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "p") for r in made() + ODD], "doc_id long, text string, candidates int, `__parts` string")


@pytest.fixture(scope="module")
def forest(docs):
    return secrets.trained(docs)


def test_the_forest_walks_like_the_trained_one(spark, docs):
    words = secrets.dictionary(docs)
    found = secrets.labelled_findings(docs, words)
    forest = secrets.fit(found, words)
    assert len(forest.roots) == secrets.TREES and max(forest.feature) < len(secrets.FEATURES)
    rows = found.select("*", F.expr(f"transform(array(struct(value, before, after)), c -> {secrets._features(words)})").alias("f"))
    rows = rows.select("*", F.expr(f"transform(f, x -> {forest.score('x')})[0]").alias("score")).collect()
    for r in rows:
        assert [float(x) for x in features(words, r.value, r.before, r.after)] == pytest.approx(list(r.f[0]))
        assert r.score == pytest.approx(judged(forest, r.f[0]))
    right = [(r.score >= 0.5) == bool(r.label) for r in rows]
    assert sum(right) / len(right) > 0.97


def test_trees_are_read_from_their_printed_form():
    tree = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 1.5)
   If (feature 2 <= 0.25)
    Predict: 0.0
   Else (feature 2 > 0.25)
    Predict: 1.0
  Else (feature 0 > 1.5)
   If (feature 1 <= 7.0)
    Predict: 1.0
   Else (feature 1 > 7.0)
    If (feature 2 <= 3.0)
     Predict: 0.0
    Else (feature 2 > 3.0)
     Predict: 1.0"""
    forest = secrets.Forest.of_trees([], [tree, "x\n  Predict: 1.0"], 3)
    assert len(forest.roots) == 2
    for f, want in [((1, 0, 0), 0), ((1, 0, 1), 1), ((2, 7, 0), 1), ((2, 8, 3), 0), ((2, 8, 4), 1)]:
        assert judged(forest, f) == (want + 1) / 2


def test_scan_equals_plain_python(docs, forest):
    text_of = dict(made() + ODD)
    rows = secrets.scanned(docs, forest).collect()
    assert len(rows) == len(made()) + len(ODD)
    hits = 0
    for r in rows:
        spans, clean = plain(forest, text_of[r.doc_id])
        assert [(c.start, c.length, c.secret) for c in r.candidates] == spans
        assert r.clean_text == clean and r["__parts"] == "p"
        hits += sum(s[2] for s in spans)
    assert hits > 50


def test_masked_documents_keep_their_columns(spark, docs, forest):
    mine = docs.withColumn("n_chars", F.length("text")).withColumn("__clean_text", F.lit(3)).withColumn("__spans", F.lit("a")).withColumn("__clean", F.lit(4))
    out = secrets.masked(mine, forest, length="n_chars")
    assert out.columns == mine.columns and out.dtypes == mine.dtypes
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[904].text == f'token = "{secrets.MASK}""' and rows[904].n_chars == len(rows[904].text)
    assert rows[900].text is None and rows[901].text == "" and rows[902].text == "x"
    assert {(r["__clean_text"], r["__spans"], r["__clean"]) for r in rows.values()} == {(3, "a", 4)}
    assert secrets.masked(mine.limit(0), forest).collect() == []


def test_without_findings_every_candidate_counts(spark, docs):
    forest = secrets.trained(docs.limit(0))
    assert [c.secret for c in secrets.scanned(docs.where("doc_id = 904").limit(1), forest).first().candidates] == [True]


def test_no_python_in_the_plan(docs, forest):
    plan = secrets.scanned(docs, forest)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_query_finds_known_formats(spark, tiny):
    from lotwise.llm.queries import QUERIES

    known = re.compile(r"\bAKIA[0-9A-Z]{16}\b|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}")
    rows = {r.doc_id: r for r in QUERIES["op7_secrets"](spark, tiny).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        assert rows[i].spans == ",".join(f"{m.start() + 1}+{len(m.group())}" for m in known.finditer(text))


ASSIGNED = [
    ("password=Pa$$w0rd! then", ["Pa$$w0rd!"]), ("pwd: abc", ["abc"]), ("SECRET_KEY = 'a#b%c d&e'", ["a#b%c d&e"]), ('{"api_key": "x!y", "n": 1}', ["x!y"]),
    ("Authorization: Bearer aaaa.bbbb.cccc\n", ["aaaa.bbbb.cccc"]), ("a Bearer zzzz, b", ["zzzz"]), ("https://h/?token=abc&page=2", ["abc"]), ("<password>q*r</password>", ["q*r"]),
    ('passwd := "say \\" it"', ['say \\" it']), ("secret: password=hunter", ["hunter"]), ('\\"token\\": \\"u!v\\"', ["u!v"]), ("pwd=a pwd=b pwd=c", ["a", "b", "c"]),
    ("password=one.", ["one"]), ("password: ", []), ("a passing token of love", []), ("MY_DB_PASSWORD_12345=x1y2", ["x1y2"]), ("see ghp_0123456789abcdef end", ["ghp_0123456789abcdef"]),
    ("password=" + "k" * 100_000, ["k" * 100_000]), ('password="' + "a b" * 50_000, ["a"]), ("password=" + ",=" * 50_000, []), ("token=" * 20_000 + "v", ["v"]),
]


def test_what_a_word_assigns_is_a_candidate(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ASSIGNED)], "doc_id long, text string")
    found = {r.doc_id: r.candidates for r in secrets.scanned(docs, secrets.Forest.always([])).collect()}
    for i, (text, want) in enumerate(ASSIGNED):
        got = [text[c.start - 1 : c.start - 1 + c.length] for c in found[i]]
        assert [v for v in got if v not in ("MY_DB_PASSWORD_12345=",)] == want, text[:80]


def test_context_is_read_from_the_text(spark):
    texts = ["pwd=a1 pwd=b2 pwd=c3 password=ddd", "x" * 60 + " token=e\u00e9 id 1234567890123 abcdefghijk12 z", "MY_DB_PASSWORD_12345=x1y2"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    at = {}
    for r in secrets.candidates(docs).collect():
        text = texts[r.doc_id]
        at[r.doc_id] = text.index(r.value, at.get(r.doc_id, 0)) + len(r.value)
        start = at[r.doc_id] - len(r.value)
        assert (r.before, r.after) == (text[max(0, start - secrets.BESIDE) : start], text[at[r.doc_id] : at[r.doc_id] + 1])
    assert len(at) == 3


def test_undecided_candidates_have_no_label(spark):
    texts = ["see 7f3kQz81LmXw0p2 there", "note Zk4Vn8Qp1Lr6Tx3 end", "ghp_" + "a1B2" * 9, "at 110.20.30.40 now", "see /usr/lib/v2/x1/site there"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.value: r.label for r in secrets.labelled_findings(docs, []).collect()}
    assert found == {"ghp_" + "a1B2" * 9: 1, "110.20.30.40": 0}


def test_formats_that_training_never_saw(spark, forest):
    rnd = random.Random(4)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    mark = lambda n: "".join(rnd.choices(letters, k=n))
    secret = lambda: rnd.choice([f"npm_{mark(36)}", f"glpat-{mark(20)}", f"xoxb-{mark(12)}-{mark(24)}", f"github_pat_{mark(22)}_{mark(40)}"])
    shapes = [lambda: f"see {secret()} there", lambda: f'client_secret="{mark(6)}%{mark(6)}"', lambda: f"credential: {mark(16)}", lambda: f"<password>{mark(5)}&{mark(4)}*</password>"]
    clear = ["password: river", "the token: window", "host 10.1.22.7 up", "mail stone.7@mail.example.com", "secret: <paper>", "see /stone/river/v3/index.html"]
    docs = [(i, shapes[i % 4]()) for i in range(200)] + [(1000 + i, t) for i, t in enumerate(clear)]
    rows = secrets.scanned(spark.createDataFrame(docs, "doc_id long, text string"), forest).collect()
    hit = [any(c.secret for c in r.candidates) for r in rows if r.doc_id < 1000]
    assert sum(hit) / len(hit) > 0.95
    assert [r.clean_text for r in rows if r.doc_id >= 1000 and secrets.MASK in r.clean_text] == []


def test_the_sample_of_findings_has_long_ones(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SAMPLE", 200)
    rows = [(f"{i:06d}ab" + "c" * 4, "see ", " ", 0) for i in range(1000)] + [(sha1(str(i).encode()).hexdigest(), "token=", " ", 1) for i in range(1000)]
    forest = secrets.fit(spark.createDataFrame(rows, "value string, before string, after string, label int"), [])
    assert len(forest.roots) == secrets.TREES
    assert judged(forest, features([], "f" * 20 + "0123456789" * 2, "token=", " ")) > 0.5 > judged(forest, features([], "000001abcccc", "see ", " "))
