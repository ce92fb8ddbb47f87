import re

import corpus_pipeline
import pytest
from lotwise.llm.corpus import written
from test_decontaminate import plain as plain_hits
from test_simhash import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.01"
SECRET = re.compile(r"\bAKIA[0-9A-Z]{16}\b|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}")


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of every stage, by name."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, FOLDER), name)
        out[name] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()])
        assert after.columns == columns or name == "bpe"
        docs = after
    return out


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "bpe"]


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    before, after = steps["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r[0] for r in after}
    assert set(after) <= set(before)
    toxic, clean = [i for i, x in labels.items() if x], [i for i, x in labels.items() if not x]
    assert sum(i in kept for i in toxic) / len(toxic) < 0.15
    assert sum(i in kept for i in clean) / len(clean) > 0.98


def test_one_document_of_each_group_stays(steps):
    before, after = steps["simhash_near_dedup"]
    roots = plain_components({r[0]: plain_fingerprint(r[1]) for r in before})
    assert sorted(after) == sorted(r for r in before if roots[r[0]] == r[0])


def test_contaminated_documents_go(spark, steps):
    before, after = steps["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {w[0] for w in plain_hits([r[:2] for r in before], items) if w[-1]}
    assert bad and sorted(after) == sorted(r for r in before if r[0] not in bad)


def test_secrets_are_masked_and_nothing_else_changes(steps):
    before, after = steps["secret_scan"]
    want = []
    for doc, text, lang, source, n in before:
        clean = SECRET.sub("<secret>", text)
        want.append((doc, clean, lang, source, n if clean == text else len(clean)))
    assert any(SECRET.search(r[1]) for r in before) and sorted(after) == sorted(want)


def test_tokens_equal_the_library(steps):
    from hashlib import sha256

    from test_bpe import PATH

    tokenizer = __import__("tokenizers").Tokenizer.from_file(PATH)
    before, after = steps["bpe"]
    want = []
    for doc, text, *_ in before:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        want.append((doc, len(ids), sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), sha256(text.encode()).hexdigest()))
    assert sorted(after) == sorted(want)


def test_run_equals_the_stages(spark, steps):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(steps["bpe"][1])


def test_odd_and_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (-1, None, "en", None, 0), (-2, "", "en", "s", 0), (-3, "x y", "en", "s", 3), (-3, "x y", "en", "s", 3), (-4, "z" * 50_000, None, "s", None)], docs.schema
    )
    for frame, rows in ((odd, 4), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = written(stage(spark, frame, FOLDER), "odd")
        assert frame.count() == rows
