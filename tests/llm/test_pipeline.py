"""Every stage of the corpus pipeline: nulls, empty texts, repeats, an empty table, columns; and brute force."""

import random
import re

import pytest

import corpus_pipeline as cp
from vocarium.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(cp.STAGES)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def sets(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of one small corpus: near copies, repeated rows, a leak of the benchmark, personal data."""
    rng, path = random.Random(5), tmp_path_factory.mktemp("corpus")
    vocab = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(40):
        t = [rng.choice(vocab) for _ in range(60)]
        rows.append((k, " ".join(t)))
        if k % 4 == 0:
            t[rng.randrange(60)] = "other"
            rows.append((100 + k, " ".join(t)))
    item = " ".join(vocab[:12])
    rows += [(200, "before it " + item + " and after"), (201, "Mr Alex Smith has the mail a.smith@example.org and no other"), (201, "Mr Alex Smith has the mail a.smith@example.org and no other"), (202, None), (203, ""), (204, " \t"), (None, "a text without any id")]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in rows], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def kept(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


@pytest.mark.parametrize("name", list(STAGES))
def test_an_empty_table_stays_empty(spark, folder, name):
    path, docs = folder
    out = STAGES[name](spark, docs.limit(0), path)
    assert out.count() == 0 and (name == "packing" or out.schema.names == docs.schema.names)


def test_quality_filter_keeps_what_the_model_keeps(spark, folder):
    path, docs = folder
    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet").where(quality.fold(cp.F.col("doc_id"), 4) != 2))
    scored = {(r["doc_id"], r["text"]): r["score"] for r in quality.with_score(docs, model).collect()}
    want = kept(r for r in docs.collect() if not words(r["text"]) or scored[r["doc_id"], r["text"]] >= 0.7)
    assert kept(STAGES["quality_filter"](spark, docs, path).collect()) == want


def test_near_duplicates_keep_one_of_a_group(spark, folder):
    path, docs = folder
    rows = docs.collect()
    alike = lambda a, b: sets(a) and sets(b) and 100 * len(sets(a) & sets(b)) >= 80 * len(sets(a) | sets(b))
    gone = {r["doc_id"] for r in rows if r["doc_id"] is not None and any(o["doc_id"] is not None and o["doc_id"] < r["doc_id"] and alike(o["text"], r["text"]) for o in rows)}
    got = STAGES["near_duplicates"](spark, docs, path).collect()
    assert gone and kept(got) == kept({(r["doc_id"], r["text"]): r for r in rows if r["doc_id"] not in gone}.values())


def test_decontamination_drops_leaks_alone(spark, folder):
    path, docs = folder
    assert kept(STAGES["decontamination"](spark, docs, path).collect()) == kept(r for r in docs.collect() if r["doc_id"] != 200)


def test_personal_data_changes_what_holds_it(spark, folder):
    path, docs = folder
    before, after = kept(docs.collect()), kept(STAGES["personal_data"](spark, docs, path).collect())
    changed = [(a, b) for a, b in zip(before, after, strict=True) if a != b]
    assert len(changed) == 2 and all(a[0] == b[0] == 201 for a, b in changed)
    assert all("Smith" not in b[1] and "a.smith" not in b[1] for _, b in changed)


def test_packing_has_every_row(spark, folder):
    path, docs = folder
    pieces = STAGES["packing"](spark, docs, path).collect()
    assert sum(r["start"] == 0 for r in pieces) == docs.count()
    assert all(sum(r["length"] for r in pieces if r["sequence_id"] == s) <= 2048 for s in {r["sequence_id"] for r in pieces})


def test_the_whole_run(spark, folder):
    path, _ = folder
    out = cp.run(spark, path).collect()
    assert {201, 202, 203, 204} <= {r["doc_id"] for r in out} and not any(r["doc_id"] == 200 for r in out)
