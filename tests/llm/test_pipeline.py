import pytest

import corpus_pipeline
from test_decontaminate import words
from test_jaccard import brute
from yieldscope.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned on the smallest tables, the input first."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def test_columns_stay_and_rows_only_go(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == before.columns and after.count() <= before.count()
    assert stages[4].count() == stages[3].count() == stages[5].count()


def test_near_copies_and_benchmark_windows_go(spark, stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    kept = sorted(i for i, n, low in ((int(i), n, low) for i, n, low in brute(rows, 5, 80)) if i == low)
    assert sorted(r.doc_id for r in stages[2].collect()) == kept
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))}

    def clean(text):
        w = words(text)
        return not any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9))

    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(r.doc_id for r in stages[2].collect() if clean(r.text))


def test_the_run_gives_the_last_stage(spark, stages):
    got = {r.doc_id: (r.n_tokens, r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r.doc_id: (r.n_tokens, r.ids) for r in stages[5].collect()}


def test_queries_have_the_columns_agreed(spark):
    agreed = {"op1": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2": "query_id rank vec_id score",
              "op3": "doc_id n_bytes n_removed n_spans kept_sha256", "op5": "doc_id n_shingles component_id",
              "op6": "doc_id start n_tokens ids_crc32", "op7": "doc_id n_words n_hit n_items items_sha256 contaminated",
              "op9": "doc_id size text_crc32 law shard slot grown_shard", "op10": "doc_id held_out score predicted",
              "op11": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
              "op12": "doc_id held_out lang_pred score",
              "op13": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"}
    for name, columns in agreed.items():
        query = next(q for q in catalog.QUERIES if q.startswith(f"{name}_"))
        found = catalog.QUERIES[query](spark, SF)
        assert set(columns.split()) <= set(found.columns), name


def test_without_evidence_all_documents_stay(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for n in (0, 4):
        labels = spark.read.parquet(f"{SF}/labels.parquet").limit(n)
        folder = f"{tmp_path}/{n}"
        labels.write.parquet(f"{folder}/labels.parquet")
        docs.write.parquet(f"{folder}/documents.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == docs.count()
        assert catalog.QUERIES["op10_toxicity"](spark, folder).where("predicted <> 0").count() == 0


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"}
    rows = [(1, text["a"]), (1, text["a"]), (1, text["a"]),  # repeated rows
            (2, text["b"]), (None, text["b"]),  # a null id that copies a row with one
            (None, text["c"]), (None, text["c"] + " more"), (None, text["c"]),  # null ids only
            (3, text["d"]), (5, text["d"]), (5, text["e"]),  # one id, two texts, one of them a copy
            (6, text["f"]), (6, text["f"] + " more"),  # one id, near copies
            (7, ""), (7, ""), (None, None), (8, None)]  # no shingles
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, lang string").repartition(4)
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    got = [(r.doc_id, (r.text or "-")[0], r.lang) for r in got.collect()]
    keys = [(1, "a"), (2, "b"), (None, "c"), (3, "d"), (5, "e"), (6, "f"), (7, "-"), (7, "-"), (None, "-"), (8, "-")]
    assert sorted(map(str, got)) == sorted(str((*k, "en")) for k in keys)
