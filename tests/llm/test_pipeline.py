import random

import corpus_pipeline
import pyarrow as pa
import pytest

from stockflow.llm import common, near_dup, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string"


@pytest.fixture(scope="module")
def corpus(spark, sf, tmp_path_factory):
    """Documents of the test tables with planted ones, and the benchmark, in a folder of their own."""
    rng = random.Random(11)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect() if len(r.text) > 100)
    clean = next(r[1] for r in rows if 2000 < len(r[1]) < 6000)
    edited = clean.split()
    edited[len(edited) // 2] = "changed"
    planted = {9001: clean, 9002: " ".join(edited), 9003: "Words before. " + item.replace("e", "3", 2) + " Words after.", 9004: "my password: Zq9xLm3PvR and more of the text", 9005: "".join(rng.choice("qxzjkvwQXZ qz") for _ in range(600)), 9006: None, 9007: ""}
    folder = tmp_path_factory.mktemp("corpus")
    table = [(*r, "clash") for r in rows] + [(k, t, None if k == 9005 else "en", f"s{k}", len(t or ""), "clash") for k, t in planted.items()]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {r[0]: r[1] for r in rows}, planted


def test_stages(spark, corpus):
    folder, texts, planted = corpus
    docs = common.table(spark, folder, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
            seen[name] = {r.doc_id: r for r in docs.collect()}
    everything = {*texts, *planted}
    assert everything - set(seen["language_id"]) == {9005}
    after = set(seen["near_duplicates"])
    assert not {9001, 9002} & after and {9003, 9004, 9006} <= after
    assert 9003 not in seen["decontamination"] and {9004, 9006, 9007} <= set(seen["decontamination"])
    assert set(seen["secrets"]) == set(seen["decontamination"])
    assert "Zq9xLm3PvR" not in seen["secrets"][9004].text and seen["secrets"][9004].n_chars == len(seen["secrets"][9004].text)
    assert seen["secrets"][9006].text is None
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(seen["secrets"])
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    again = corpus_pipeline.run(spark, folder)
    assert again.columns == packing.PACKED.names and again.count() == len(packed)


def test_empty_table(spark, corpus, tmp_path):
    folder, _, _ = corpus
    docs = common.table(spark, folder, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder), f"empty-{name}")
        assert docs.count() == 0


class InThisProcess:
    """Documents whose mapInArrow runs here, as one task."""

    def __init__(self, rows):
        self.batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])

    def select(self, *names):
        return self

    def mapInArrow(self, func, schema):
        return sum(b.num_rows for b in func(iter([self.batch])))


def test_tasks_leave_no_words_to_their_workers(monkeypatch):
    """A worker lives on for the tasks of all stages: what each keeps would add up."""
    docs, tokenizer = InThisProcess([(1, "some words of a text"), (2, None), (3, "other words")]), packing.default_tokenizer()
    assert near_dup.sketches(docs, 2) == 3 and not near_dup.WORDS
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0), "taskAttemptId": classmethod(lambda c: 0)}))
    monkeypatch.setattr(packing, "KEPT_WORDS", 2)
    assert packing.pieces(docs, tokenizer) == 3 and not packing.encoder(tokenizer).words
